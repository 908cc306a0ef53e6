"""Stream queries: each reads the events as a stream with availableNow, writes to the shared folder and returns what was written."""

from __future__ import annotations

import contextlib
import tempfile
import uuid
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from axlewatch.plans.registry import query, r6
from axlewatch.sources.bind import TEL, read
from axlewatch.streaming import alarms, streams


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    schema = read(spark, sf_dir, "events").schema
    e = spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(sf_dir)
    ts = F.col("ts").cast("timestamp")
    return e.select("event_id", F.col("user_id").alias("component_id"), ts.alias("ts"), F.unix_micros(ts).alias("t"), "value")


def shared(spark: SparkSession) -> str:
    """The folder that the driver and all executors see; one of our own in local mode only."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder and not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return (folder or "file://" + tempfile.mkdtemp(prefix="spark-shared-")).rstrip("/")


@contextlib.contextmanager
def rocks(spark: SparkSession) -> Iterator[None]:
    """Streams that start inside keep their state in RocksDB, as timers need it."""
    key = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(key)
    spark.conf.set(key, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        yield
    finally:
        spark.conf.set(key, before)


def drained(spark: SparkSession, stream: DataFrame, mode: str) -> DataFrame:
    path = f"{shared(spark)}/stream-{uuid.uuid4().hex}"
    name = f"{path}/out"
    stream.writeStream.foreachBatch(lambda df, i: df.write.mode("overwrite" if mode == "complete" else "append").parquet(name)).outputMode(mode).option("checkpointLocation", f"{path}/state").trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(stream.schema).parquet(name)


@query(f"with {TEL} select component_id, t // 86400000000 as day, round(avg(value), 6) as mean, max(value) as peak, count(value) as n from tel group by 1, 2")
def stream_bins(spark, sf_dir):
    out = drained(spark, streams.stream_bins(events(spark, sf_dir)), "complete")
    return out.select("component_id", F.floor(F.unix_micros(F.col("w.start")) / 86_400_000_000).alias("day"), r6("mean"), "peak", "n")


@query(f"with recursive {TEL}, z as (select *, (value - 50) / 50 as z from tel), p as (select *, sum(z - 0.5) over w as u, sum(-z - 0.5) over w as d from z window w as (partition by component_id order by t, event_id rows unbounded preceding)), m as (select *, row_number() over (partition by component_id order by t, event_id) as n, value as x from tel), e as (select component_id, n, event_id, x as ewma from m where n = 1 union all select m.component_id, m.n, m.event_id, 0.8::double * e.ewma + 0.2::double * m.x from e join m on m.component_id = e.component_id and m.n = e.n + 1), c as (select event_id, round(greatest(u - least(0, min(u) over w), d - least(0, min(d) over w)), 5) as cusum from p window w as (partition by component_id order by t, event_id rows unbounded preceding)) select event_id, cusum, round(ewma, 6) as ewma from c join e using (event_id)")
def stream_ewma_cusum(spark, sf_dir):
    return drained(spark, streams.stream_ewma_cusum(events(spark, sf_dir)), "append").select("event_id", F.round("cusum", 5).alias("cusum"), r6("ewma"))


@query(f"""with {TEL}, s as (select component_id, t, case when t - lag(t) over w < 259200000000 then 0 else 1 end as new from tel window w as (partition by component_id order by t)), n as (select *, sum(new) over (partition by component_id order by t) as n from s)
select component_id, min(t) as first, max(t) as last, count(*) as n from n group by component_id, n""")
def stream_gap_sessions(spark, sf_dir):
    out = drained(spark, streams.stream_gap_sessions(events(spark, sf_dir)), "complete")
    return out.select("component_id", F.unix_micros("first").alias("first"), F.unix_micros("last").alias("last"), "n")


@query("select component_id, t, count(*) as n from (select distinct event_id, user_id as component_id, epoch_us(ts) as t from events) group by 1, 2")
def stream_dedup(spark, sf_dir):
    """Every event is delivered twice; each is kept once."""
    e = events(spark, sf_dir)
    out = drained(spark, streams.stream_dedup(e.unionByName(events(spark, sf_dir)), ["event_id"]), "append")
    return out.groupBy("component_id", "t").agg(F.count(F.lit(1)).alias("n"))
