"""Chunks of sweeps where a group's rows crowd together: about equally large, in order, and right at every edge."""

import random
from collections import Counter

import pytest
from helpers import frame
from pyspark.sql import functions as F

from rangeloom.operators import algebra
from rangeloom.plans import extremes, sweep


@pytest.fixture
def small(monkeypatch):
    """Chunks of 50 rows, as if there were many."""
    for module in (sweep, extremes, algebra):
        monkeypatch.setattr(module, "ROWS", 50)


def crowded(n, seed=3):
    """99% of the rows in 1% of the positions."""
    rng = random.Random(seed)
    return [rng.randint(400_000, 409_999) if rng.random() < 0.99 else rng.randint(-100_000, 899_999) for _ in range(n)]


def dealt(df, by=("space",)):
    return [tuple(r) for r in sweep.chunked(df, "start", by=by).select(*by, "start", "_chunk").collect()]


def test_crowded_rows_are_dealt_evenly(spark, small):
    rows = dealt(frame(spark, [(p, p) for p in crowded(5000)]))
    assert len(rows) == 5000
    sizes = Counter(c for _, _, c in rows)
    middle = sorted(sizes.values())[len(sizes) // 2]
    assert max(sizes.values()) <= 2 * middle
    rows.sort(key=lambda r: r[1])
    assert all(a[2] <= b[2] for a, b in zip(rows, rows[1:], strict=False))


def test_every_size_and_kind_of_group(spark, small):
    """Groups of one row, of two chunks, of equal positions, of huge positions, and no group at all."""
    spaces = {0: [7], 1: list(range(100)), 2: list(range(101)), 3: [5] * 300, 4: [-(1 << 62), 1 << 62] + [1 << 40] * 200, 5: crowded(400, 8)}
    df = spark.createDataFrame([(s, p) for s, ps in spaces.items() for p in ps], "space long, start long")
    rows = dealt(df)
    assert Counter((s, p) for s, p, _ in rows) == Counter((s, p) for s, ps in spaces.items() for p in ps)
    for space in spaces:
        own = sorted((p, c) for s, p, c in rows if s == space)
        assert all(a[1] <= b[1] for a, b in zip(own, own[1:], strict=False))
        places = {}
        for p, c in own:
            assert places.setdefault(p, c) == c
    for wanted, n in (("space in (2, 5)", 501), ("space = 1", 100), ("space = 0", 1)):
        one = dealt(df.filter(wanted).select("start"), by=())
        assert len(one) == n and all(c is not None for _, c in one)
    assert dealt(df.filter("space = 9")) == [] and dealt(df.filter("space = 9").select("start"), by=()) == []


def test_sweeps_over_crowded_rows(spark, small):
    rng = random.Random(9)
    pairs = [(p, p + rng.choice([-1, 0, 3, 40, 5000])) for p in crowded(1200, 5)]
    df = frame(spark, pairs)
    numbered = sweep.running(df, {"n": ("sum", F.lit(1))}, "start", ["start", "rid"]).select("rid", "n").collect()
    order = sorted(range(len(pairs)), key=lambda i: (pairs[i][0], i))
    assert {r.rid: r.n for r in numbered} == {i + 1: k for k, i in enumerate(order, 1)}
    merged = []
    for a, b in sorted(p for p in pairs if p[1] >= p[0]):
        if merged and a <= merged[-1][1] + 1:
            merged[-1][1] = max(merged[-1][1], b)
        else:
            merged.append([a, b])
    got = algebra.reduce(df, drop_empty=True).select("start", "end").collect()
    assert sorted(map(tuple, got)) == [tuple(m) for m in merged]


def test_extremes_over_crowded_runs(spark, small):
    rng = random.Random(12)
    starts = sorted(set(crowded(900, 6)))
    ends = [b - 1 for b in starts[1:]] + [starts[-1] + 3]
    values = [rng.randint(-50, 50) for _ in starts]
    runs = spark.createDataFrame([(0, a, b, v) for a, b, v in zip(starts, ends, values, strict=True)], "space long, start long, end long, value long")
    asks = [(i, *sorted(rng.choice([rng.choice(starts), rng.randint(-200_000, 999_999)]) for _ in range(2))) for i in range(200)]
    asked = spark.createDataFrame([(0, *a) for a in asks], "space long, rid long, low long, high long")
    want = {}
    for i, low, high in asks:
        seen = [(v, a) for a, v in zip(starts, values, strict=True) if low <= a <= high]
        if seen:
            want[i] = (min(seen), (max(v for v, _ in seen), min(a for v, a in seen if v == max(v for v, _ in seen))))
    got = {r.rid: ((r.lo.value, r.lo.start), (r.hi.value, r.hi.start)) for r in extremes.between(runs, asked).collect()}
    assert got == want
