"""Segments by an automaton with memory, run over blocks of rows in parallel.

A cycle ends where the command changes, or where the position, having swept far enough one way, turns back by more than a
band. The rule needs the state that the rows before have left, so a series is cut into blocks that all start at once from
a guess: as if a cycle began at the block's first row. Each block gives its cuts and the state it leaves. Then every block
whose guess isn't what the block before has left runs again, from that state, until none differs. A cut wipes the memory,
so what a wrong guess changes ends at a block's first common cut and few blocks run more than twice. The result is that of
a run row by row, whatever the block size, and a task holds one block.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from axlewatch.operators.ranked import running_sums
from axlewatch.operators.segments import gap_segments

#: anchor (where the sweep began), extreme (how far it came), direction (0 until it has left the band)
STATE = "struct<anchor: double, extreme: double, direction: int>"
BLOCK = 4096


def swept(state: tuple[float, float, int], positions: list[float], edges: list[bool], band: float, need: float) -> tuple[tuple[float, float, int], list[int]]:
    """(the state after these rows, the places where a cycle begins)."""
    anchor, extreme, way = state
    cuts = []
    for i, (p, edge) in enumerate(zip(positions, edges, strict=True)):
        if edge:
            cuts.append(i)
            anchor, extreme, way = p, p, 0
        elif way == 0:
            if abs(p - anchor) > band:
                extreme, way = p, 1 if p > anchor else -1
        elif (p - extreme) * way > 0:
            extreme = p
        elif (extreme - p) * way > band and abs(extreme - anchor) >= need:
            cuts.append(i)
            anchor, extreme, way = p, p, 0
    return (anchor, extreme, way), cuts


def run_blocks(blocks: DataFrame, keys: list[str]) -> DataFrame:
    """blocks(keys, block, ps, edges, held, band, need, entry) -> keys, block, entry, left (state), cuts.

    held stands for missing positions before the block's first; a null entry is a cycle that begins with its first row.
    """
    schema = T.StructType([*[blocks.schema[c] for c in (*keys, "block", "entry")], T.StructField("left", blocks.schema["entry"].dataType), T.StructField("cuts", T.ArrayType(T.IntegerType()))])
    state_type = pa.struct([("anchor", pa.float64()), ("extreme", pa.float64()), ("direction", pa.int32())])

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            left, cuts = [], []
            for known, edges, held, band, need, entry in zip(*(batch.column(c).to_pylist() for c in ("ps", "edges", "held", "band", "need", "entry")), strict=True):
                ps = [held := held if p is None else p for p in known]
                start = (ps[0], ps[0], 0) if entry is None else (entry["anchor"], entry["extreme"], entry["direction"])
                state, found = swept(start, ps, edges, band, need)
                left.append(dict(zip(("anchor", "extreme", "direction"), state, strict=True))), cuts.append(found)
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in (*keys, "block", "entry")], pa.array(left, state_type), pa.array(cuts, pa.list_(pa.int32()))], names=schema.names)

    return blocks.select(*keys, "block", "ps", "edges", "held", "band", "need", "entry").mapInArrow(each, schema)


def settled_blocks(blocks: DataFrame, keys: list[str], rounds: int = 1_000_000) -> DataFrame:
    """blocks as run_blocks takes them, without entry -> keys, block, left, cuts, each run from what the block before has left."""
    none = F.lit(None).cast(STATE)
    done = run_blocks(blocks.withColumn("entry", none), keys).checkpoint()
    before = Window.partitionBy(*keys).orderBy("block")
    for _ in range(rounds):
        due = done.withColumn("due", F.lag("left").over(before)).where(~F.col("due").eqNullSafe(F.col("entry"))).select(*keys, "block", F.col("due").alias("entry")).checkpoint()
        if not due.limit(1).count():
            break
        again = run_blocks(blocks.join(due, [*keys, "block"]), keys)
        done = done.join(due.select(*keys, "block"), [*keys, "block"], "left_anti").unionByName(again).checkpoint()
    return done.select(*keys, "block", "left", "cuts")


def state_segments(df: DataFrame, keys: list[str], time: str, tie: str, position: str, command: str, min_rows: int = 25, hysteresis: float = 0.08, travel: float = 0.5, least: float = 1.0, block: int = BLOCK) -> DataFrame:
    """Adds segment, from 0. keys must not be null.

    The band is `hysteresis` and the sweep that a turn needs is `travel` of the series' range of positions, `least` at
    least. A missing position is the one before, or the first one there is. Spans under min_rows belong to the span before
    them; the first span stays. A series without any position is one segment; a null command is a command of its own.
    """
    x = df.select(*keys, F.struct("*").alias("_row"), F.col(time).alias("_t"), F.col(tie).alias("_tie"), F.col(position).cast("double").alias("_x"), F.col(command).alias("_c"))
    x = x.withColumn("_x", F.when(F.abs("_x") < math.inf, F.col("_x")))
    x = running_sums(x, ["_t", "_tie"], {"_n": F.lit(1).cast("long")}, keys).withColumn("block", F.floor((F.col("_n") - 1) / block)).checkpoint()
    ordered = F.array_sort(F.collect_list(F.struct("_n", "_x", "_c")))
    rows = x.groupBy(*keys, "block").agg(ordered.alias("rows"), F.max_by("_x", F.when(F.col("_x").isNotNull(), F.col("_n"))).alias("final_x"), F.min_by("_x", F.when(F.col("_x").isNotNull(), F.col("_n"))).alias("first_x"), F.max("_x").alias("high"), F.min("_x").alias("low"))
    up, whole = Window.partitionBy(*keys).orderBy("block"), Window.partitionBy(*keys)
    held = F.coalesce(F.last("final_x", True).over(up.rowsBetween(Window.unboundedPreceding, -1)), F.first("first_x", True).over(up.rowsBetween(0, Window.unboundedFollowing)))
    span = F.max("high").over(whole) - F.min("low").over(whole)
    rows = rows.withColumns({"held": held, "last_c": F.element_at("rows", -1)["_c"], "band": F.greatest(hysteresis * span, F.lit(least)), "need": F.greatest(travel * span, F.lit(least))})
    rows = rows.withColumn("before_c", F.lag(F.struct("last_c")).over(up)).where("held is not null")
    commands = F.transform("rows", lambda r: r["_c"])
    edges = F.transform(commands, lambda c, i: F.when(i == 0, F.col("before_c").isNotNull() & ~F.col("before_c.last_c").eqNullSafe(c)).otherwise(~F.get(commands, i - 1).eqNullSafe(c)))
    blocks = rows.select(*keys, "block", F.transform("rows", lambda r: r["_x"]).alias("ps"), edges.alias("edges"), "held", "band", "need").checkpoint()
    cuts = settled_blocks(blocks, keys).select(*keys, "block", F.explode("cuts").alias("_at")).select(*keys, (F.col("block") * block + F.col("_at") + 1).alias("_n"))
    starts = cuts.unionByName(x.where("_n = 1").select(*keys, "_n")).distinct()
    total = x.groupBy(*keys).agg(F.max("_n").alias("_total"))
    order = Window.partitionBy(*keys).orderBy("_n")
    spans = starts.join(total, keys).withColumn("_end", F.coalesce(F.lead("_n").over(order), F.col("_total") + 1))
    spans = spans.withColumn("_new", ((F.col("_n") == 1) | (F.col("_end") - F.col("_n") >= min_rows)).cast("int"))
    spans = spans.withColumn("segment", F.sum("_new").over(order.rowsBetween(Window.unboundedPreceding, 0)) - 1).where("_new = 1").select(*keys, "_n", "segment")
    return rows_of_spans(x, spans, keys)


def rows_of_spans(x: DataFrame, spans: DataFrame, keys: list[str]) -> DataFrame:
    """x(keys, _row, _n), spans(keys, _n: first place, segment) -> the rows with their segment, the running maximum of the span numbers."""
    marked = x.join(spans, [*keys, "_n"], "left").withColumn("_s", F.coalesce("segment", F.lit(0)))
    parts = marked.withColumn("_block", F.floor(F.col("_n") / BLOCK))
    tops = parts.groupBy(*keys, "_block").agg(F.max("_s").alias("_top"))
    tops = tops.withColumn("_ahead", F.max("_top").over(Window.partitionBy(*keys).orderBy("_block").rowsBetween(Window.unboundedPreceding, -1))).drop("_top")
    inside = F.max("_s").over(Window.partitionBy(*keys, "_block").orderBy("_n").rowsBetween(Window.unboundedPreceding, 0))
    return parts.join(tops, [*keys, "_block"]).select("_row.*", F.greatest(inside, F.coalesce("_ahead", F.lit(0))).alias("segment"))


def cycle_segments(df: DataFrame, keys: list[str], time: str, tie: str, position: str, command: str, max_gap: int, method: str = "auto", **rules) -> DataFrame:
    """Adds segment by method: 'gap' cuts at steps above max_gap, 'state' by the automaton, 'hybrid' by the automaton inside each stretch between gaps, 'auto' by gaps in a series that has one and by the automaton in others."""
    if method == "gap":
        return gap_segments(df, keys, time, max_gap, tie)
    if method == "state":
        return state_segments(df, keys, time, tie, position, command, **rules)
    columns = df.columns
    gaps = gap_segments(df, keys, time, max_gap, tie).withColumnRenamed("segment", "_gap")
    if method == "hybrid":
        inner = state_segments(gaps, [*keys, "_gap"], time, tie, position, command, **rules)
        each = inner.groupBy(*keys, "_gap").agg((F.max("segment") + 1).alias("_k"))
        ahead = F.coalesce(F.sum("_k").over(Window.partitionBy(*keys).orderBy("_gap").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
        return inner.join(each.select(*keys, "_gap", ahead.alias("_ahead")), [*keys, "_gap"]).select(*columns, (F.col("segment") + F.col("_ahead")).alias("segment"))
    if method != "auto":
        raise ValueError(f"method must be gap, state, hybrid or auto, not {method!r}")
    has = gaps.groupBy(*keys).agg((F.max("_gap") > 0).alias("_has"))
    both = gaps.join(has, keys)
    by_state = state_segments(both.where("not _has").select(*columns), keys, time, tie, position, command, **rules)
    return both.where("_has").select(*columns, F.col("_gap").alias("segment")).unionByName(by_state)
