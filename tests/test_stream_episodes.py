"""Episodes of a stream equal those of the batch operator on the rows that the watermark has passed."""

import datetime
import random
import uuid

import pandas as pd
import pytest
from pyspark.sql import functions as F

from axlewatch.operators import episodes
from axlewatch.plans.streams import drained, rocks, shared
from axlewatch.streaming import alarms

K, GAP, STEP, THR = 2, 40_000_000, 30_000_000, 10.0
ZERO = datetime.datetime(2024, 1, 1, tzinfo=datetime.timezone.utc)


def rows(seed):
    rng = random.Random(seed)
    out = []
    for c in range(4):
        t = 0
        for _ in range(120):
            t += rng.choice([0, 1, 5, 10, 29, 30, 31, 45, 70]) * 1_000_000
            out.append((c, len(out), t, None if rng.random() < 0.05 else rng.uniform(0, 25)))
    return out


def run(spark, data, batches, late):
    path = f"{shared(spark)}/in-{uuid.uuid4().hex}"
    schema = "component_id long, event_id long, t long, value double"
    for i, part in enumerate(batches(data)):
        df = spark.createDataFrame(part, schema).withColumn("ts", F.timestamp_micros(F.lit(int(ZERO.timestamp()) * 1_000_000) + F.col("t"))).withColumn("t", F.unix_micros("ts"))
        df.coalesce(1).write.mode("append").parquet(f"{path}/b={i:03d}")
    stream = spark.readStream.schema(f"{schema}, ts timestamp").option("maxFilesPerTrigger", 1).parquet(f"{path}/*")
    with rocks(spark):
        return sorted(tuple(r)[:1] + tuple(r)[2:] for r in drained(spark, alarms.stream_episodes(stream, THR, K, GAP, STEP, late), "append").collect())


def batch(spark, data):
    df = spark.createDataFrame([(c, i, int(ZERO.timestamp()) * 1_000_000 + t, x) for c, i, t, x in data], "component_id long, event_id long, t long, score double")
    ep = episodes.episodes(df, ["component_id"], "t", "event_id", F.col("score") > THR, "score", K, GAP, STEP)
    return sorted(tuple(r) for r in ep.select("component_id", "t_start", "t_end", "n_rows", "peak").collect())


@pytest.mark.parametrize("seed", [1, 2])
def test_closed_episodes_equal_the_batch_operator(spark, seed):
    data = rows(seed)
    end = max(t for _, _, t, _ in data)
    data += [(9, 10_000 + i, end + 3_600_000_000 + i, 0.0) for i in range(2)]  # another series moves the watermark past all others
    want = [e for e in batch(spark, data) if e[0] != 9]

    def shuffled(rows):
        """In three files; rows come up to 20 minutes late."""
        rng = random.Random(seed)
        late = sorted(rows, key=lambda r: r[2] + rng.uniform(0, 1_200_000_000) if r[0] != 9 else r[2] + 10**12)
        return [late[:200], late[200:400], late[400:]]

    got = run(spark, data, shuffled, "30 minutes")
    assert [e[0] for e in got] and got == want


def test_take_and_close_row_by_row():
    rule = alarms.EpisodeRule(2, 40, 30)
    s = dict(alarms.NOTHING)
    assert [rule.take(s, t, x, x > 10) for t, x in [(0, 11.0), (10, 12.0), (20, 1.0), (45, 13.0), (46, 20.0)]] == [None] * 5
    assert (s["start"], s["end"], s["n"], s["peak"]) == (0, 46, 5, 20.0)
    assert rule.passed(s, 85) == (None, 86) and rule.passed(s, 86)[0] == (0, 0, 46, 5, 20.0)
    assert rule.passed(s, 90) == (None, None)


class OneState:
    """A handle that counts what a call asks of the state store."""

    def __init__(self):
        self.held, self.asked, self.timers = None, 0, []

    def getValueState(self, name, schema):
        return self

    def get(self):
        self.asked += 1
        return self.held

    def update(self, new):
        self.asked += 1
        self.held = new

    def registerTimer(self, at):
        self.asked += 1
        self.timers.append(at)


def test_a_call_reads_and_writes_the_state_once_however_many_rows_wait():
    p, handle = alarms.Episodes(2, 40_000, 30_000), OneState()
    p.init(handle)
    rows = pd.DataFrame({"t": [1_000_000 + 10_000 * (i % 500) for i in range(1000)], "event_id": range(1000), "score": [None if i % 7 == 0 else 20.0 for i in range(1000)], "above": [i % 7 > 0 for i in range(1000)]})
    assert list(p.move((5,), 0, [alarms.packed(rows[k::3]) for k in range(3)])) == [] and handle.asked == 3 and handle.timers == [1000]
    (out,) = p.move((5,), 10_000_000, [])
    assert handle.asked == 5 and handle.held[-1] == b"" and len(out) == 1 and tuple(out.iloc[0])[:2] == (5, 0) and out["peak"][0] == 20.0 and out["n_rows"][0] > 900
