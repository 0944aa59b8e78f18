"""Bins fitted to the data, overfull bins cut into blocks, stored indexes and circles."""

import functools
import random
from collections import Counter

import pytest
from helpers import frame
from pyspark.sql import functions as F

from rangeloom.operators import overlaps
from rangeloom.plans import binning


def crowded(rng, n):
    """Most ranges at one place, some wide, some far away, some empty."""
    out = []
    for _ in range(n):
        a = rng.choice([500, 500, 501, rng.randint(-2000, 100_000)])
        out.append((a, a + rng.choice([-1, 0, 2, 2, 9, 30_000])))
    return out


@pytest.mark.parametrize("most", [0, 100_000])
def test_overfull_bins_are_cut(spark, monkeypatch, most):
    rng = random.Random(41)
    q, s = crowded(rng, 150), crowded(rng, 260)
    want = Counter((i, j) for i, x in enumerate(q, 1) for j, y in enumerate(s, 1) if x[0] <= y[1] and y[0] <= x[1])
    cut = []

    def watched(*sides, **how):
        left, right, blocks = binning.cut_blocks(*sides, block=16, most=most)
        cut.append((left, right, blocks))
        return left, right, blocks

    monkeypatch.setattr(overlaps, "cut_blocks", watched)
    got = Counter((r.query_id, r.subject_id) for r in overlaps.find(frame(spark, q), frame(spark, s)).collect())
    assert got == want
    ((left, right, blocks),) = cut
    assert blocks == ["_row", "_column"]
    # no task meets more than a block of either side, but for chance
    keys = [*binning.KEYS, *blocks]
    met = left.groupBy(*keys).count().withColumnRenamed("count", "l").join(right.groupBy(*keys).count().withColumnRenamed("count", "r"), keys)
    assert met.agg(F.max(F.greatest("l", "r"))).first()[0] <= 40
    touched = {r.query_id for r in overlaps.find(frame(spark, q), frame(spark, s), pairs=False).collect()}
    assert touched == {i for i, _ in want}


def test_bins_follow_the_data(spark):
    wide = frame(spark, [(i * 10_000, i * 10_000 + 5000) for i in range(50)])
    fine = frame(spark, [(i, i + 2) for i in range(50)] + [(0, 9_000_000)])
    assert binning.tune(wide).width == 5001 and binning.tune(fine).width == 3
    assert binning.tune(fine).levels > binning.tune(wide).levels
    assert binning.tune(wide.limit(0)) == binning.Bins(1, 1)


def test_index(spark, tmp_path):
    rng = random.Random(42)
    q, s = crowded(rng, 80), crowded(rng, 120)
    built = overlaps.build_index(frame(spark, s), "bins_of_s", buckets=4, path=str(tmp_path / "index"))
    index = overlaps.open_index(spark, "bins_of_s")
    assert index.bins == built.bins
    for gap in (-1, 0, 5):
        want = Counter((i, j) for i, x in enumerate(q, 1) for j, y in enumerate(s, 1) if x[0] <= y[1] + gap + 1 and y[0] <= x[1] + gap + 1)
        assert Counter((r.query_id, r.subject_id) for r in overlaps.find_in_index(frame(spark, q), index, maxgap=gap).collect()) == want
    index.drop()


def test_an_index_is_not_moved(spark, tmp_path):
    """The plan has no exchange above the scan of the indexed side."""
    index = overlaps.build_index(frame(spark, [(i, i + 5) for i in range(400)]), "bins_of_t", buckets=8, path=str(tmp_path / "index"))
    old = {k: spark.conf.get(k) for k in ("spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.enabled")}
    try:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
        spark.conf.set("spark.sql.adaptive.enabled", "false")
        plan = overlaps.find_in_index(frame(spark, [(i, i + 2) for i in range(300)]), index)._jdf.queryExecution().executedPlan().toString()
    finally:
        for k, v in old.items():
            spark.conf.set(k, v)
        index.drop()
    scan = plan.index("bins_of_t")
    join = plan.index("Join")
    above = plan[join:scan].splitlines()
    depth = lambda line: len(line) - len(line.lstrip(" :+-"))
    branch, level = [], depth(above[-1])
    for line in reversed(above[:-1]):
        if depth(line) < level:
            branch.append(line)
            level = depth(line)
    assert branch and not any("Exchange" in line for line in branch), plan
    assert plan.count("Exchange hashpartitioning") == 1


@pytest.mark.parametrize("how", [{}, {"maxgap": 3}, {"maxgap": 200}, {"minoverlap": 4}, {"type": "within"}, {"type": "within", "maxgap": 5}, {"type": "extend"}, {"type": "start", "maxgap": 2}, {"type": "end"}, {"type": "equal", "maxgap": 1}], ids=str)
def test_circles(spark, how):
    rng, length = random.Random(43), 50
    some = lambda n: [(a, a + rng.choice([-1, 0, 3, 20, 49, 50, 130])) for a in (rng.randint(-120, 200) for _ in range(n))]
    q, s = some(40), some(50)

    def hit(x, y):
        kind, gap, least = how.get("type", "any"), how.get("maxgap", -1), how.get("minoverlap", 0)
        g = max(gap, 0)
        round_ = lambda a, b: min((a - b) % length, (b - a) % length) <= g
        if kind == "start":
            return round_(x[0], y[0])
        if kind == "end":
            return round_(x[1], y[1])
        if kind == "equal":
            return round_(x[0], y[0]) and round_(x[1], y[1]) and abs((x[1] - x[0]) - (y[1] - y[0])) <= 2 * g
        for turn in range(-15, 16):
            a, z = x[0] + turn * length, x[1] + turn * length
            if kind == "any" and (min(z, y[1]) - max(a, y[0]) + 1 >= least if least else a <= y[1] + gap + 1 and y[0] <= z + gap + 1):
                return True
            if kind == "within" and y[0] <= a and z <= y[1] and (not g or (y[1] - y[0]) - (z - a) <= g):
                return True
            if kind == "extend" and a <= y[0] and y[1] <= z:
                return True
        return False

    got = Counter((r.query_id, r.subject_id) for r in overlaps.find_circular(frame(spark, q), frame(spark, s), length, **how).collect())
    assert got == Counter((i, j) for i, x in enumerate(q, 1) for j, y in enumerate(s, 1) if hit(x, y))
