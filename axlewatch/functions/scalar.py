"""Scalar functions as Column expressions."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def compressor_state(current: Column, off: float = 2.0, loaded: float = 5.0) -> Column:
    """0 off, 1 unloaded, 2 loaded."""
    return F.when(current < off, 0).when(current < loaded, 1).otherwise(2)


def series_id(run: Column, component: Column) -> Column:
    return F.concat_ws("/", run, component)


def opaque_series_id(sid: Column) -> Column:
    return F.concat(F.lit("rec_"), F.substring(F.sha2(sid, 256), 1, 12))


def component_side(name: Column) -> Column:
    return F.regexp_extract(name, "_([LR])", 1)


def component_index(name: Column) -> Column:
    return F.nullif(F.regexp_extract(name, "([0-9]+)$", 1), F.lit("")).cast("int")


def bogie_partner(index: Column) -> Column:
    """1 with 2, 3 with 4."""
    return F.when(index % 2 == 1, index + 1).otherwise(index - 1)


def severity_from_level(level: Column) -> Column:
    return F.least(F.lit(1.0), F.lit(0.2) + F.lit(0.2) * (level - 1))


def parse_native_ts(s: Column) -> Column:
    """Y-M-D-H-M-S-ms without padding, else ISO."""
    part = F.split(s, "-")
    native = F.make_timestamp(*[F.get(part, i).cast("int") for i in range(5)], (F.get(part, 5).cast("decimal(8,6)") + F.get(part, 6).cast("decimal(12,6)") / 1000).cast("decimal(8,6)"))
    return F.when(s.rlike(r"^\d+(-\d+){6}$"), native).otherwise(F.try_to_timestamp(s))


def format_native_ts(ts: Column) -> Column:
    ms = F.pmod(F.unix_millis(ts), F.lit(1000))
    return F.concat_ws("-", F.year(ts), F.month(ts), F.day(ts), F.hour(ts), F.minute(ts), F.second(ts), ms)


def natural_number(s: Column) -> Column:
    """The first number in a name; order by it, then by the name."""
    return F.nullif(F.regexp_extract(s, "([0-9]+)", 1), F.lit("")).cast("long")


def bearing_factors(n: Column, ratio: Column) -> dict[str, Column]:
    """Multiples of shaft speed at zero contact angle; ratio is ball over pitch diameter."""
    return {"bpfo": n / 2 * (1 - ratio), "bpfi": n / 2 * (1 + ratio), "bsf": (1 - ratio * ratio) / (2 * ratio), "ftf": (1 - ratio) / 2}


def hz_from_rpm(rpm: Column) -> Column:
    return rpm / 60.0


def hz_from_speed(metres_per_second: Column, wheel_diameter: float) -> Column:
    return metres_per_second / (math.pi * wheel_diameter)


def power_db(x: Column, floor: float = 1e-12) -> Column:
    return 10 * F.log10(F.greatest(x, F.lit(floor)))


def amplitude_db(x: Column, floor: float = 1e-6) -> Column:
    return 20 * F.log10(F.greatest(x, F.lit(floor)))


def hour_cyclic(ts: Column) -> tuple[Column, Column]:
    angle = F.lit(2 * math.pi) * (F.hour(ts) + F.minute(ts) / 60.0) / 24
    return F.sin(angle), F.cos(angle)


def clip_ratio(x: Column) -> Column:
    return F.least(F.greatest(F.coalesce(x, F.lit(1.0)), F.lit(0.0)), F.lit(10.0))


def clip_z(z: Column) -> Column:
    return F.least(F.greatest(F.coalesce(z, F.lit(0.0)), F.lit(-25.0)), F.lit(25.0))


def to_log_features(df: DataFrame, positive: list[str], floor: float = 1e-12) -> DataFrame:
    """Replaces each column that is positive by definition with log_<column>."""
    return df.select(*[F.log(F.greatest(F.col(c), F.lit(floor))).alias(f"log_{c}") if c in positive else F.col(c) for c in df.columns])


def plausible_mean(value: str, low: float, high: float) -> Column:
    """An aggregate: the mean of values in range, else the median of all."""
    return F.coalesce(F.avg(F.when(F.col(value).between(low, high), F.col(value))), F.percentile(value, 0.5))
