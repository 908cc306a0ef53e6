"""Recorded files as tables: compressor, bearing, door, rail and stress recordings, and panels of cars.

Files are read in parallel; what a file's name says comes from its metadata, and the place of a row in its file from the
block it stands in and its order there, so nothing depends on how files are dealt. A file that breaks a rule is an error
that names it.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from axlewatch.operators.ranked import running_sums

#: Tokens that stand for a missing value, and the standard acceleration of gravity.
MISSING = ["", "na", "n/a", "nan", "null", "none", "-", "--"]
GRAVITY = 9.80665


def rows_of(spark: SparkSession, path: str, header: bool = True) -> DataFrame:
    """All columns as strings, with file and the keys of a row's place, _block and _in."""
    df = spark.read.option("header", header).option("pathGlobFilter", "*.csv").csv(path)
    return df.select(*[F.col(f"`{c}`").alias(c.strip().lstrip("﻿")) for c in df.columns], F.col("_metadata.file_name").alias("file"), F.col("_metadata.file_block_start").alias("_block"), F.monotonically_increasing_id().alias("_in"))


def placed(df: DataFrame) -> DataFrame:
    """Adds place, a row's number in its file from 0."""
    out = running_sums(df, ["_block", "_in"], {"place": F.lit(1).cast("long")}, ["file"])
    return out.withColumn("place", F.col("place") - 1).drop("_block", "_in")


def number(name: str):
    return F.expr(f"try_cast(trim(`{name}`) as double)")


def required(df: DataFrame, names: list[str], what: str) -> None:
    if lost := [n for n in names if n not in df.columns]:
        raise ValueError(f"{what}: missing column(s) {lost}; there are {[c for c in df.columns if c[0] != '_']}")


def compressor(spark: SparkSession, path: str, signals: list[str]) -> DataFrame:
    """file, t (epoch microseconds, the recorder's clock is UTC), signal, value: a row for each channel and sample; an index column is dropped."""
    df = rows_of(spark, path)
    required(df, ["timestamp", *signals], "compressor recording")
    t = F.unix_micros(F.to_timestamp("timestamp"))
    return df.select("file", t.alias("t"), *[number(s).alias(s) for s in signals]).unpivot(["file", "t"], signals, "signal", "value")


def bearing(spark: SparkSession, path: str, channels: dict[str, float]) -> DataFrame:
    """file, place, kind, bearing, state, and the channels times their factor. Files are named <kind>_<bearing>_<state>.csv, kind one of H, I, O, B, C and state 0 to 2."""
    df = rows_of(spark, path)
    required(df, list(channels), "bearing recording")
    pattern = r"^([HIOBC])_(\d+)_([012])\.csv$"
    part = [F.regexp_extract("file", pattern, i) for i in (1, 2, 3)]
    kind = F.when(part[0] == "", F.raise_error(F.concat(F.lit("bearing recording: unknown file name "), "file"))).otherwise(part[0])
    return placed(df).select("file", "place", kind.alias("kind"), F.expr(f"try_cast(regexp_extract(file, '{pattern}', 2) as int)".replace("\\", "\\\\")).alias("bearing"), part[2].alias("state"), *[(number(c) * f).alias(c) for c, f in channels.items()])


def plain(name: str) -> str:
    """A header without case, white space and signs."""
    return re.sub(r"[^a-z0-9]", "", name.lower())


def door(spark: SparkSession, path: str, aliases: dict[str, list[str]], needed: list[str], time: str = "datetime") -> DataFrame:
    """file, place (in order of time), t (epoch microseconds) and the canonical columns: each takes the first of its aliases that the file has, compared without case and signs; others are NULL. Times are Y-M-D-H-M-S-ms, unpadded; one that isn't is an error."""
    df = rows_of(spark, path)
    have = {plain(c): c for c in df.columns}
    found = {canon: next((have[plain(a)] for a in [canon, *names] if plain(a) in have), None) for canon, names in aliases.items()}
    if lost := [n for n in [time, *needed] if not found.get(n)]:
        raise ValueError(f"door recording: missing column(s) {lost}; there are {df.columns[:-3]}")
    part = F.split(F.trim(F.col(f"`{found[time]}`")), "-")
    stamp = F.concat(F.concat_ws("-", *[F.lpad(F.get(part, i), w, "0") for i, w in ((0, 4), (1, 2), (2, 2))]), F.lit(" "), F.concat_ws(":", *[F.lpad(F.get(part, i), 2, "0") for i in (3, 4, 5)]), F.lit("."), F.lpad(F.get(part, 6), 3, "0"))
    t = F.unix_micros(F.try_to_timestamp(stamp, F.lit("yyyy-MM-dd HH:mm:ss.SSS")))
    t = F.when((F.size(part) != 7) | t.isNull(), F.raise_error(F.concat(F.lit("door recording: no time of a row in "), "file"))).otherwise(t)
    x = df.select("file", t.alias("t"), *[(number(found[c]) if found[c] else F.lit(None).cast("double")).alias(c) for c in aliases if c != time], "_block", "_in")
    out = running_sums(x, ["t", "_block", "_in"], {"place": F.lit(1).cast("long")}, ["file"])
    return out.withColumn("place", F.col("place") - 1).drop("_block", "_in")


def rail(spark: SparkSession, path: str, boxes: int = 64) -> DataFrame:
    """file, place, pulse, box (from 1), vibration, shock: the pulse and two channels for each axle box; what isn't a finite number is 0."""
    df = rows_of(spark, path)
    names = df.columns[:-3]
    if len(names) != 2 * boxes + 1:
        raise ValueError(f"rail recording: {2 * boxes + 1} columns are due (a pulse and {boxes} boxes of two channels), there are {len(names)}")
    finite = [F.when(F.abs(number(c)) < float("inf"), number(c)).otherwise(0.0) for c in names]
    each = F.array(*[F.struct(F.lit(b + 1).alias("box"), finite[2 * b + 1].alias("vibration"), finite[2 * b + 2].alias("shock")) for b in range(boxes)])
    return placed(df.select(finite[0].alias("pulse"), each.alias("_e"), "file", "_block", "_in")).select("file", "place", "pulse", F.explode("_e").alias("_x")).select("file", "place", "pulse", "_x.*")


def stress(spark: SparkSession, path: str, most_bad: float = 0.01, by_folder: bool = False, named: bool = False) -> DataFrame:
    """file (its whole path if files lie in folders), place, value: one sample a line, no header. named: a file holds many recordings, each whole, and a line is a recording's name, a comma and a sample; file is that name. Gaps are blended linearly between the samples around them and held at the ends; a file with a larger share of bad lines is an error."""
    df = spark.read.option("pathGlobFilter", "*.txt" if named else "*.csv").option("recursiveFileLookup", by_folder).text(path)
    v = F.expr(f"try_cast(trim({'substring_index(value, chr(44), -1)' if named else 'value'}) as double)")
    file = F.expr("substring(value, 1, length(value) - length(substring_index(value, chr(44), -1)) - 1)") if named else F.col("_metadata.file_path" if by_folder else "_metadata.file_name")
    x = df.select(file.alias("file"), F.col("_metadata.file_block_start").alias("_block"), F.monotonically_increasing_id().alias("_in"), F.when(F.abs(v) < float("inf"), v).alias("v"))
    x = placed(x).checkpoint()
    bad = x.groupBy("file").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("v").isNull()).alias("bad")).where(F.col("bad") > F.floor(F.col("n") * most_bad)).orderBy("file").first()
    if bad:
        raise ValueError(f"stress recording: {bad.bad} of {bad.n} lines of {bad.file} aren't numbers")
    w = Window.partitionBy("file").orderBy("place")
    known = F.when(F.col("v").isNotNull(), F.struct("place", "v"))
    x = x.withColumns({"_a": F.last(known, True).over(w.rowsBetween(Window.unboundedPreceding, 0)), "_b": F.first(known, True).over(w.rowsBetween(0, Window.unboundedFollowing))})
    a, b = F.coalesce("_a", "_b"), F.coalesce("_b", "_a")
    t = (F.col("place") - a["place"]) / F.nullif(b["place"] - a["place"], F.lit(0))
    return x.select("file", "place", F.coalesce(a["v"] + (b["v"] - a["v"]) * t, a["v"]).alias("value"))


CAR = re.compile(r"^Car\s+(\d{1,2})\s*-\s*(.+)$")


def panel_header(columns: list[str], synonyms: dict[str, list[str]], cars: int | None = None) -> list[str]:
    """What is wrong with a panel's header, as sentences; none if it can be read."""
    parts = [m.groups() for c in columns if (m := CAR.match(c.strip()))]
    known = {plain(s) for names in synonyms.values() for s in names}
    wrong = [] if any(c.strip().lower() == "time" for c in columns) else ["there is no Time column"]
    if not parts:
        return [*wrong, "there is no column 'Car <n> - <parameter>'"]
    if not any(plain(p) in known for _, p in parts):
        wrong.append("no parameter is known")
    if cars is not None and len({c for c, _ in parts}) != cars:
        wrong.append(f"there are {len({c for c, _ in parts})} cars, not {cars}")
    return wrong


def panel(spark: SparkSession, path: str, synonyms: dict[str, list[str]], text: list[str] = []) -> DataFrame:  # noqa: B006
    """file, t, car (as its header spells it), field, value, word: wide columns 'Car <n> - <parameter>' as rows.

    A field has several names, the most specific first; each car takes the first of them that has any data in its file.
    Fields named in `text` come as word, others as value; tokens for missing values are NULL. Rows without a time are left out.
    """
    df = rows_of(spark, path)
    names = df.columns[:-3]
    if wrong := panel_header(names, synonyms):
        raise ValueError(f"panel: {'; '.join(wrong)}")
    place = {plain(s): (field, i) for field, all_ in synonyms.items() for i, s in enumerate(all_)}
    found = [(c, m[1], *place[plain(m[2])]) for c in names if (m := CAR.match(c.strip())) and plain(m[2]) in place]
    clock = next(c for c in names if c.strip().lower() == "time")
    cells = F.array(*[F.struct(F.lit(car).alias("car"), F.lit(field).alias("field"), F.lit(i).alias("rank"), F.trim(F.col(f"`{c}`")).alias("raw")) for c, car, field, i in found])
    x = df.select("file", F.unix_micros(F.expr(f"try_cast(`{clock}` as timestamp)")).alias("t"), F.explode(cells).alias("_x")).where("t is not null").select("file", "t", "_x.*")
    x = x.withColumn("raw", F.when(~F.lower("raw").isin(MISSING), F.col("raw")))
    is_text, v = F.col("field").isin(text) if text else F.lit(False), F.expr("try_cast(raw as double)")
    x = x.select("file", "t", "car", "field", "rank", F.when(~is_text & (F.abs(v) < float("inf")), v).alias("value"), F.when(is_text, F.col("raw")).alias("word"))
    best = x.where("value is not null or word is not null").groupBy(*[F.col(c).alias(f"_{c}") for c in ("file", "car", "field")]).agg(F.min("rank").alias("_rank"))
    return x.join(best, [F.col(c) == F.col(f"_{c}") for c in ("file", "car", "field", "rank")]).select("file", "t", "car", "field", "value", "word")
