"""Damage of every prefix equals rainflow on that prefix alone."""

import random

import pytest

from axlewatch.operators.fatigue import count_cycles
from axlewatch.streaming.prefix import PrefixDamage


def whole(xs):
    xs = [x for i, x in enumerate(xs) if i == 0 or x != xs[i - 1]]
    points = [x for i, x in enumerate(xs) if i in (0, len(xs) - 1) or (x - xs[i - 1]) * (xs[i + 1] - x) < 0]
    stack, ranges = [], []
    for p in points:
        ranges += [r for r, _ in count_cycles(stack, p)]
    half = [abs(b - a) for a, b in zip(stack, stack[1:])]
    return len(ranges) + len(half) / 2, (sum((r / 2) ** 3 for r in ranges) + sum((h / 2) ** 3 for h in half) / 2) / 10.0


@pytest.mark.parametrize("seed", range(3))
def test_every_prefix(seed):
    rng = random.Random(seed)
    xs = [float(rng.randint(0, 9)) for _ in range(120)]
    now = PrefixDamage(3.0, 10.0)
    for i, x in enumerate(xs):
        cycles, damage = now.take(x)
        want = whole(xs[: i + 1])
        assert cycles == want[0] and damage == pytest.approx(want[1])
        now = PrefixDamage(3.0, 10.0, now.stack, now.last, now.closed, now.damage)  # as the state carries it on
    assert now.take(None) == (cycles, damage) and PrefixDamage(3.0, 10.0).take(None) == (0.0, 0.0)


def test_the_stream_ends_where_the_batch_does(spark):
    from axlewatch.operators import fatigue
    from axlewatch.plans.fatigue import cycles
    from axlewatch.plans.queries import QUERIES

    sf = "/root/testdata/sf0.001"
    batch = {r.component_id: r.damage for r in fatigue.miner_damage(cycles(spark, sf), ["component_id"], 3.0, 1e9).collect()}
    top = {}
    for r in QUERIES["stream_prefix_damage"](spark, sf).collect():
        top[r.component_id] = max(top.get(r.component_id, (-1, 0)), (r.event_id, r.damage))
    assert {k: v[1] for k, v in top.items() if k in batch} == pytest.approx(batch, abs=2e-9)
