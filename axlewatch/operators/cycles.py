"""Features of machine cycles: a compressor's duty cycles and a door's strokes, as windows over samples and one aggregate a cycle."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Currents (A) below which a compressor is off and from which it is loaded; seconds that a sample stands for at most; samples of a cycle whose current is the start's.
OFF_BELOW, LOADED_FROM, LONGEST, START = 2.0, 5.0, 60.0, 4
#: Shares of the travel at which a door's phases meet.
PHASES = (0.15, 0.85)


def compressor_cycle_features(df: DataFrame, keys: list[str], time: str, tie: str, transition: Column | None = None) -> DataFrame:
    """keys, cycle (from 0), t_start, t_end and 17 features of each duty cycle, from one start of the motor to the next.

    Channels by name: Motor_current, Reservoirs, Oil_temperature, TP2, TP3, H1, LPS, Towers, Pressure_switch; time in
    microseconds. A sample stands for the time to the next, the last for the median step, and 60 s at most. A rate belongs
    to the sample at which a step ends, so the step into a phase counts for it. Samples before the first start are left out.
    """
    w = Window.partitionBy(*keys).orderBy(time, tie)
    up, whole = w.rowsBetween(Window.unboundedPreceding, 0), Window.partitionBy(*keys)
    current = F.coalesce(F.col("Motor_current"), F.lit(0.0))
    x = df.withColumn("_s", F.when(current < OFF_BELOW, 0).when(current >= LOADED_FROM, 2).otherwise(1)).withColumn("_tr", F.coalesce(transition if transition is not None else F.lit(False), F.lit(False)).cast("double"))
    ahead, back = (F.lead(time).over(w) - F.col(time)) / 1e6, (F.col(time) - F.lag(time).over(w)) / 1e6
    start = (F.col("_s") != 0) & (F.coalesce(F.lag("_s").over(w), F.lit(0)) == 0)
    x = x.withColumns({"_ahead": ahead, "_back": F.least(back, F.lit(LONGEST)), "_start": start.cast("int"), "_step": F.col("Reservoirs") - F.lag("Reservoirs").over(w), "_first": F.row_number().over(w) == 1})
    flip = F.coalesce(F.col("Towers") != F.lag("Towers").over(w), F.lit(False))
    rise = F.coalesce((F.col("Pressure_switch") > 0.5) & (F.lag("Pressure_switch").over(w) <= 0.5), F.lit(False))
    x = x.withColumns({"cycle": F.sum("_start").over(up) - 1, "_flip": flip.cast("int"), "_rise": rise.cast("int"), "_usual": F.percentile("_ahead", 0.5).over(whole)})
    x = x.withColumns({"_dt": F.least(F.coalesce("_ahead", "_usual", F.lit(0.0)), F.lit(LONGEST)), "_rate": F.when(F.col("_first"), 0.0).otherwise(F.col("_step") / F.nullif(F.col("_back"), F.lit(0.0)))})
    x = x.where("cycle >= 0").withColumn("_p", F.row_number().over(Window.partitionBy(*keys, "cycle").orderBy(time, tie)))

    def during(state: int, value: Column | str) -> Column:
        return F.when(F.col("_s") == state, F.col(value) if isinstance(value, str) else value)

    g = x.groupBy(*keys, "cycle").agg(
        F.min(time).alias("t_start"), F.max(time).alias("t_end"),
        *[F.coalesce(F.sum(during(s, "_dt")), F.lit(0.0)).alias(n) for s, n in ((2, "t_loaded"), (1, "t_unloaded"), (0, "t_off"))],
        F.avg(F.when(F.col("_p") > START, during(2, "Motor_current"))).alias("I_loaded_mean"), F.max("Motor_current").alias("I_start_peak"), F.max("Oil_temperature").alias("T_oil_max"),
        F.avg(during(2, F.col("TP2") - F.col("TP3"))).alias("TP2_minus_TP3_mean"), F.avg(during(2, "H1")).alias("H1_loaded_mean"), F.coalesce(F.max("LPS") > 0.5, F.lit(False)).alias("LPS_any"),
        F.avg("_tr").alias("transition_frac"), F.avg(during(2, "_rate")).alias("dP_dt_loaded"), F.avg(during(0, "_rate")).alias("dP_dt_off"), F.sum("_flip").alias("tower_switches"), F.sum("_rise").alias("purge_count"),
    )
    run = F.col("t_loaded") + F.col("t_unloaded") + F.col("t_off")
    at = F.timestamp_micros("t_start")
    return g.withColumns({"duty_ratio": F.col("t_loaded") / F.nullif(run, F.lit(0.0)), "idle_run_ratio": F.col("t_off") / F.nullif(F.col("t_loaded"), F.lit(0.0)), "hour_of_day": F.hour(at) + F.minute(at) / 60})


def door_cycle_features(df: DataFrame, keys: list[str], time: str, tie: str) -> DataFrame:
    """keys and the features of each door cycle (a span of a stream), by the phases of its travel.

    Channels by name: current, voltage, emf, position, open_time, close_time; time in microseconds. Travel runs from the first
    position to the last; a cycle that ends where it began takes the least and greatest instead. A speed is the slope at a
    sample by its unequal steps on both sides. Without a sample between 15 % and 85 % of the travel all count as cruise.
    """
    w, whole = Window.partitionBy(*keys).orderBy(time, tie), Window.partitionBy(*keys)
    full = w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    x = df.withColumns({"_i": F.abs("current"), "_p0": F.first("position").over(full), "_p1": F.last("position").over(full), "_lo": F.min("position").over(whole), "_hi": F.max("position").over(whole), "_x": (F.col(time) - F.min(time).over(whole)) / 1e6, "_n": F.count(F.lit(1)).over(whole)})
    net = F.col("_p1") - F.col("_p0")
    still = F.abs(net) < 1e-9
    reach = F.col("_hi") - F.col("_lo")
    x = x.withColumns({"_travel": F.when(still, F.when(reach > 0, reach).otherwise(1.0)).otherwise(net), "_from": F.when(still, F.col("_lo")).otherwise(F.col("_p0"))})
    x = x.withColumn("_f", F.least(F.greatest(F.coalesce((F.col("position") - F.col("_from")) / F.col("_travel"), F.lit(0.0)), F.lit(0.0)), F.lit(1.0)))
    mid = (F.col("_f") >= PHASES[0]) & (F.col("_f") <= PHASES[1])
    x = x.withColumn("_any", F.max(mid.cast("int")).over(whole)).withColumns({"_cr": mid | (F.col("_any") == 0), "_op": F.col("_f") < PHASES[0], "_cl": F.col("_f") > PHASES[1]})
    hs, hd = F.col("_x") - F.lag("_x").over(w), F.lead("_x").over(w) - F.col("_x")
    before, after = F.lag("_f").over(w), F.lead("_f").over(w)
    zero = F.lit(0.0)
    inner = (hs * hs * after + (hd * hd - hs * hs) * F.col("_f") - hd * hd * before) / F.nullif(hs * hd * (hs + hd), zero)
    slope = F.when(before.isNull(), (after - F.col("_f")) / F.nullif(hd, zero)).when(after.isNull(), (F.col("_f") - before) / F.nullif(hs, zero)).otherwise(inner)
    x = x.withColumns({"_dt": F.coalesce(hs, zero), "_v": F.when((F.col("_n") > 2) & (F.max("_x").over(whole) > 0), F.abs(slope)).otherwise(zero)})
    names = {"opening": "_op", "cruise": "_cr", "closing": "_cl"}

    def at(phase: str, value: str) -> Column:
        return F.when(F.col(names[phase]), F.col(value))

    register = F.when(F.col("_travel") > 0, F.col("open_time")).otherwise(F.col("close_time"))
    g = x.groupBy(*keys).agg(
        F.first("_travel").alias("_travel"), F.count(F.lit(1)).alias("n_rows"), F.max("_x").alias("duration"), F.avg("_i").alias("i_mean"), F.sqrt(F.avg(F.col("_i") * F.col("_i"))).alias("i_rms"), F.stddev_pop("_i").alias("i_std"), F.percentile("_i", 0.5).alias("i_med"), F.max("_i").alias("i_peak"),
        F.min_by("_f", F.struct(-F.col("_i"), time, tie)).alias("i_peak_frac"), F.sum(F.col("_i") * F.col("_dt")).alias("charge"), F.sum(F.col("_i") * F.col("voltage") * 10 * F.col("_dt")).alias("energy"), F.avg("voltage").alias("v_mean"), F.avg("emf").alias("emf_mean"),
        *[f(at(p, "_i")).alias(f"i_{n}_{p}") for p in names for n, f in (("mean", F.avg), ("max", F.max))], F.stddev_pop(at("cruise", "_i")).alias("i_std_cruise"), F.avg(at("cruise", "voltage")).alias("v_mean_cruise"), F.avg(at("cruise", "emf")).alias("emf_mean_cruise"),
        *[F.coalesce(F.sum(at(p, "_dt")), zero).alias(f"dur_{p}") for p in names], F.avg(at("cruise", "_v")).alias("speed_cruise"), F.percentile(F.when(register > 0, register), 0.5).alias("_cmd"),
    )
    tiny = F.lit(1e-6)
    return g.withColumns({
        "operation": F.when(F.col("_travel") > 0, "Open").otherwise("Close"), "travel": F.abs("_travel"), "speed_mean": 1 / F.nullif(F.col("duration"), zero), "r_proxy": (10 * F.col("v_mean_cruise") - F.col("emf_mean_cruise")) / F.greatest("i_mean_cruise", tiny),
        "i_per_speed": F.col("i_mean_cruise") / F.greatest("speed_cruise", tiny), "emf_per_speed": F.col("emf_mean_cruise") / F.greatest("speed_cruise", tiny), "duration_vs_cmd": F.col("duration") / (F.col("_cmd") * 0.1),
    }).drop("_travel", "_cmd")
