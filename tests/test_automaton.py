"""The automaton over blocks equals a run row by row, whatever the block size."""

import math
import random

import pytest

from axlewatch.operators import automaton


def brute(rows, min_rows, hysteresis=0.08, travel=0.5):
    """rows of one series in order: (position, command) -> segments."""
    known = [p for p, _ in rows if p is not None and math.isfinite(p)]
    if not known:
        return [0] * len(rows)
    now, ps = None, []
    for p, _ in rows:
        now = p if p is not None and math.isfinite(p) else now
        ps.append(now)
    ps = [known[0] if p is None else p for p in ps]
    span = max(known) - min(known)
    band, need = max(hysteresis * span, 1.0), max(travel * span, 1.0)
    cuts, anchor, extreme, way = [0], ps[0], ps[0], 0
    for i in range(1, len(rows)):
        p = ps[i]
        if rows[i][1] != rows[i - 1][1]:
            cuts.append(i)
            anchor, extreme, way = p, p, 0
        elif way == 0:
            if abs(p - anchor) > band:
                way, extreme = (1 if p > anchor else -1), p
        elif (way > 0 and p > extreme) or (way < 0 and p < extreme):
            extreme = p
        elif (extreme - p if way > 0 else p - extreme) > band and abs(extreme - anchor) >= need:
            cuts.append(i)
            anchor, extreme, way = p, p, 0
    cuts.append(len(rows))
    out, segment = [], -1
    for a, b in zip(cuts, cuts[1:]):
        if segment < 0 or b - a >= min_rows:
            segment += 1
        out += [segment] * (b - a)
    return out


def series(seed, n):
    rng = random.Random(seed)
    p, out, c = 0.0, [], 0
    for i in range(n):
        p = 50 + 45 * math.sin(i / (5 + seed)) + rng.uniform(-6, 6)
        c = rng.randint(0, 2) if rng.random() < 0.03 else c
        out.append((None if rng.random() < 0.1 else math.nan if rng.random() < 0.05 else p, None if c == 2 else c))
    return out


@pytest.mark.parametrize("block", [9, 64, 4096])
def test_block_size_changes_nothing(spark, block):
    data = {k: series(k, 150 + k) for k in range(3)} | {7: [(None, 1)] * 5, 8: [(1.0, 1)], 9: [(None, 0)] * 20 + [(5.0, 0), (90.0, 0), (1.0, 0)]}
    rows = [(k, i // 2, i, p, c) for k, s in data.items() for i, (p, c) in enumerate(s)]
    df = spark.createDataFrame(rows, "k long, t long, tie long, p double, c int").repartition(4)
    got = automaton.state_segments(df, ["k"], "t", "tie", "p", "c", min_rows=4, block=block)
    assert got.columns == [*df.columns, "segment"]
    found = {}
    for r in got.orderBy("k", "tie").collect():
        found.setdefault(r.k, []).append(r.segment)
    assert found == {k: brute(s, 4) for k, s in data.items()}


def test_methods(spark):
    first, second, third = [0.0, 50.0, 100.0, 0.0, 0.0, 50.0], [0.0, 100.0, 0.0, 0.0], [0.0, 100.0, 0.0]
    rows = [(1, t, t, p, 0) for t, p in enumerate(first)] + [(1, t + 100, t + 100, p, 0) for t, p in enumerate(second)] + [(2, t, t, p, 0) for t, p in enumerate(third)]
    df = spark.createDataFrame(rows, "k long, t long, tie long, p double, c int")

    def by(method):
        out = automaton.cycle_segments(df, ["k"], "t", "tie", "p", "c", 10, method, min_rows=1)
        return [r.segment for r in out.orderBy("k", "t").collect()]

    def state(ps):
        return brute([(p, 0) for p in ps], 1)

    assert by("gap") == [0] * 6 + [1] * 4 + [0] * 3
    assert by("state") == state(first + second) + state(third)
    assert by("hybrid") == state(first) + [max(state(first)) + 1 + s for s in state(second)] + state(third)
    assert by("auto") == [0] * 6 + [1] * 4 + state(third)
    with pytest.raises(ValueError, match="method"):
        by("other")
    assert automaton.state_segments(df.limit(0), ["k"], "t", "tie", "p", "c").count() == 0
