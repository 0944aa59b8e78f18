"""Small cases with known results."""

import pytest
from pyspark.sql import functions as F
from helpers import frame, got, ranges, widths

from rangeloom import model
from rangeloom.functions import compare, intra, lists
from rangeloom.operators import algebra, nearest, overlaps, views


def hits(df):
    return got(df, "query_id", "subject_id")


Q1 = [(1, 5), (4, 7), (9, 10)]
S1 = [(2, 2), (2, 3), (10, 12)]


def test_overlaps(spark):
    q, s = frame(spark, Q1), frame(spark, S1)
    assert hits(overlaps.find(q, s)) == [(1, 1), (1, 2), (3, 3)]
    assert hits(overlaps.find(q, s, maxgap=0)) == [(1, 1), (1, 2), (2, 2), (3, 3)]
    assert hits(overlaps.find(q, s, minoverlap=2)) == [(1, 2)]
    assert hits(overlaps.find(q, s, minoverlap=3)) == []
    found = overlaps.find(q, s)
    first = sorted((r.query_id, r.subject_id) for r in overlaps.select(q, found, "first").collect())
    assert first == [(1, 1), (2, None), (3, 3)]
    assert got(overlaps.select(q, found, "count"), "query_id", "n") == [(1, 2), (2, 0), (3, 1)]


def test_overlaps_of_empty_ranges(spark):
    q, s = frame(spark, [(i, i - 1) for i in range(9, 15)]), frame(spark, S1)
    assert hits(overlaps.find(q, s)) == [(3, 3), (4, 3)]
    assert hits(overlaps.find(q, s, maxgap=0)) == [(i, 3) for i in range(2, 6)]
    assert hits(overlaps.find(q, s, maxgap=1)) == [(i, 3) for i in range(1, 7)]
    assert hits(overlaps.find(q, s, minoverlap=1)) == []


def test_overlap_types(spark):
    q, s = frame(spark, [(1, 2), (5, 6), (3, 6), (4, 9)]), frame(spark, [(1, 4), (3, 6), (5, 9), (6, 9)])
    assert hits(overlaps.find(q, s, type="start")) == [(1, 1), (2, 3), (3, 2)]
    assert hits(overlaps.find(q, s, type="end")) == [(2, 2), (3, 2), (4, 3), (4, 4)]
    assert hits(overlaps.find(q, s, type="within")) == [(1, 1), (2, 2), (2, 3), (3, 2)]
    assert hits(overlaps.find(q, s, type="equal")) == [(3, 2)]
    assert hits(overlaps.find(q, s, type="start", minoverlap=3)) == [(3, 2)]
    with pytest.raises(ValueError):
        overlaps.find(q, s, maxgap=1, minoverlap=1)


def test_subset(spark):
    x, r = frame(spark, [(9, 15), (10, 15), (11, 15), (12, 15)]), frame(spark, [(1, 10)])
    assert got(overlaps.subset(x, r), "rid") == [(1,), (2,)]
    assert got(overlaps.subset(x, r, invert=True), "rid") == [(3,), (4,)]
    assert got(overlaps.subset(x, r, maxgap=0), "rid") == [(1,), (2,), (3,)]


def runs(df):
    rows = sorted((r.start, r.end, r.value) for r in df.collect())
    return [v for *_, v in rows], [e - s + 1 for s, e, _ in rows]


def test_coverage(spark):
    x = widths(spark, [1, 8, 14, 15, 19, 34, 40], [12, 6, 6, 15, 6, 2, 7])
    assert runs(algebra.coverage(x)) == ([1, 2, 1, 2, 3, 2, 1, 0, 1, 0, 1], [7, 5, 2, 4, 1, 5, 5, 4, 2, 4, 7])
    y = widths(spark, [-2, 6, 9, -4, 1, 0, -6, 10], [5, 0, 6, 1, 4, 3, 2, 3])
    assert runs(algebra.coverage(y)) == ([3, 1, 0, 1, 2, 1], [2, 2, 4, 1, 3, 2])
    assert runs(algebra.coverage(y, shift=7)) == ([1, 0, 1, 2, 3, 1, 0, 1, 2, 1], [3, 1, 2, 1, 2, 2, 4, 1, 3, 2])
    assert runs(algebra.coverage(y, shift=7, width=27)) == ([1, 0, 1, 2, 3, 1, 0, 1, 2, 1, 0], [3, 1, 2, 1, 2, 2, 4, 1, 3, 2, 6])


X3 = ([7, 3, -2, 6, 7, -10, -2, 3], [3, 1, 0, 0, 0, 0, 8, 0])


@pytest.mark.parametrize("chunk", [2, 1 << 16])
def test_reduce(spark, chunk):
    x = widths(spark, *X3)
    assert ranges(algebra.reduce(x, chunk=chunk)) == [(-10, -11), (-2, 5), (7, 9)]
    assert ranges(algebra.reduce(x, drop_empty=True, chunk=chunk)) == [(-2, 5), (7, 9)]
    assert ranges(algebra.reduce(x, min_gap=0, chunk=chunk)) == [(-10, -11), (-2, -3), (-2, 5), (6, 5), (7, 6), (7, 9)]
    for gap in (2, 8):
        assert ranges(algebra.reduce(x, min_gap=gap, chunk=chunk)) == [(-10, -11), (-2, 9)]
    assert ranges(algebra.reduce(x, min_gap=9, chunk=chunk)) == [(-10, 9)]
    assert got(algebra.inframe(x, chunk=chunk), "rid", "inframe") == list(zip(range(1, 9), [9, 6, 1, 9, 9, 1, 1, 6], strict=True))


def test_reduce_revmap(spark):
    x = widths(spark, [1, 2, 3, 4, 10, 11, 11], [0, 1, 1, 0, 0, 0, 1])
    rows = {(r.start, r.end): r.revmap for r in algebra.reduce(x, revmap=True).collect()}
    assert rows == {(1, 0): [1], (2, 3): [2, 3, 4], (10, 9): [5], (11, 11): [6, 7]}
    y = frame(spark, [(15, 15), (45, 100), (20, 80), (1, 5)])
    rows = {(r.start, r.end): r.revmap for r in algebra.reduce(y, revmap=True).collect()}
    assert rows == {(1, 5): [4], (15, 15): [1], (20, 100): [3, 2]}


def test_gaps(spark):
    x = frame(spark, [(2, 3)])
    cases = {(None, None): [], (2, None): [], (4, None): [], (0, None): [(0, 1)], (None, 1): [], (None, 3): [], (None, 5): [(4, 5)], (0, 5): [(0, 1), (4, 5)]}
    for (low, high), want in cases.items():
        assert ranges(algebra.gaps(x, low, high)) == want, (low, high)
    none = x.filter("rid < 0")
    assert ranges(algebra.gaps(none, 1, 4, spaces=x.select("space"))) == [(1, 4)]
    assert ranges(algebra.gaps(none, None, 4, spaces=x.select("space"))) == []


@pytest.mark.parametrize("chunk", [3, 1 << 16])
def test_disjoin(spark, chunk):
    x = frame(spark, [(1, 6), (21, 20), (10, 9), (1, 3), (15, 14), (5, 11), (20, 20), (20, 19)])
    out = algebra.disjoin(x, revmap=True, chunk=chunk)
    assert {(r.start, r.end): r.revmap for r in out.collect()} == {(1, 3): [1, 4], (4, 4): [1], (5, 6): [1, 6], (7, 9): [6], (10, 11): [6], (20, 20): [7]}


def test_disjoint_bins(spark):
    assert got(algebra.disjoint_bins(frame(spark, [(3, 5), (1, 12), (10, 13)])), "rid", "bin") == [(1, 2), (2, 1), (3, 2)]
    assert got(algebra.disjoint_bins(frame(spark, [(1, 5), (3, 12), (10, 13)])), "rid", "bin") == [(1, 1), (2, 2), (3, 1)]


@pytest.mark.parametrize("chunk", [2, 1 << 16])
def test_set_operations(spark, chunk):
    x, y = frame(spark, Q1), frame(spark, S1)
    assert ranges(algebra.union(x, y, chunk=chunk)) == [(1, 7), (9, 12)]
    assert ranges(algebra.intersect(x, y, chunk=chunk)) == [(2, 3), (10, 10)]
    assert ranges(algebra.setdiff(x, y, chunk=chunk)) == [(1, 1), (4, 7), (9, 9)]
    assert ranges(algebra.setdiff(y, x, chunk=chunk)) == [(11, 12)]


def pairs(spark, x, y):
    rows = [(i, *a, *b) for i, (a, b) in enumerate(zip(x, y, strict=True), 1)]
    return spark.createDataFrame(rows, "rid long, xs long, xe long, ys long, ye long")


def test_pintersect(spark):
    df = pairs(spark, [(22, 28)] * 4 + [(22, 21)] * 2, [(25, 30), (30, 40), (29, 40), (25, 24), (22, 21), (22, 29)])
    a, b = compare.pintersect("xs", "xe", "ys", "ye", resolve_empty="max.start")
    assert [tuple(r) for r in df.orderBy("rid").select(a, b).collect()] == [(25, 28), (30, 29), (29, 28), (25, 24), (22, 21), (22, 21)]
    a, b = compare.pintersect("xs", "xe", "ys", "ye", resolve_empty="start.x")
    assert tuple(df.filter("rid = 2").select(a, b).first()) == (22, 21)
    a, b = compare.pintersect("xs", "xe", "ys", "ye", resolve_empty="none")
    with pytest.raises(Exception, match="no determined place"):
        df.select(a, b).collect()


def test_precede_follow_nearest(spark):
    q, s = widths(spark, [6, 11, 1, 13, 18], [2] * 5), widths(spark, [1, 2, 9, 15, 15], [4, 3, 2, 2, 3])
    assert hits(nearest.precede(q, s, all=True)) == [(1, 3), (2, 4), (2, 5), (3, 3), (4, 4), (4, 5)]
    assert hits(nearest.follow(q, s, all=True)) == [(1, 1), (1, 2), (2, 3), (4, 3), (5, 5)]
    assert hits(nearest.nearest(q, s, all=True)) == [(1, 1), (1, 2), (1, 3), (2, 3), (3, 1), (3, 2), (4, 4), (4, 5), (5, 5)]
    q, s = frame(spark, [(1, 3), (3, 7), (9, 10)]), frame(spark, [(3, 3), (10, 12), (2, 5)])
    one = lambda df: [r.subject_id for r in df.orderBy("query_id").collect()]
    assert one(nearest.precede(q, s)) == [2, 2, None]
    assert one(nearest.follow(q, s)) == [None, None, 3]


def test_distance(spark):
    df = pairs(spark, [(1, 2), (3, 7), (9, 10)], [(3, 3), (5, 6), (12, 12)])
    assert [r[0] for r in df.orderBy("rid").select(compare.distance("xs", "xe", "ys", "ye")).collect()] == [0, 0, 1]
    far = nearest.distance_to_nearest(frame(spark, [(2, 2), (4, 3), (12, 13), (15, 14)]), frame(spark, [(1, 10)]))
    assert got(far, "query_id", "distance") == [(1, 0), (2, 0), (3, 1), (4, 4)]


def test_views(spark):
    subject = spark.createDataFrame([(0, 1, 1, 1), (0, 2, 3, 3), (0, 4, 6, None), (0, 7, 10, 7), (0, 11, 15, 9)], "space long, start long, end long, value long")
    v = frame(spark, [(1, 0), (1, 20)])
    rows = views.summarize(v, subject, na_rm=True, parity=True).orderBy("rid").collect()
    assert [(r.view_min, r.view_max, r.view_sum, r.view_mean, r.which_min, r.which_max) for r in rows] == [(2147483647, -2147483647, 0, None, None, None), (1, 9, 80, 20 / 3, 1, 11)]


def test_tiles(spark):
    assert ranges(intra.tile(frame(spark, [(1, 5)]), n=3)) == [(1, 1), (2, 3), (4, 5)]
    assert ranges(intra.tile(frame(spark, [(1, 4)]), n=3)) == [(1, 1), (2, 2), (3, 4)]
    out = intra.sliding_windows(frame(spark, [(1, 5), (2, 5), (3, 5)]), 3, 2)
    assert got(out, "rid", "start", "end") == [(1, 1, 3), (1, 3, 5), (2, 2, 4), (2, 4, 5), (3, 3, 5)]
    with pytest.raises(Exception, match="more tiles"):
        intra.tile(frame(spark, [(1, 2)]), n=3).collect()


@pytest.mark.parametrize(
    ("x", "y", "want"),
    [
        ([(i, i + 3) for i in range(6, 17)], (11, 14), [-6, -5, -4, -4, -4, 0, 4, 4, 4, 5, 6]),
        ([(i, i + 5) for i in range(4, 17)], (11, 14), [-6, -5, -4, -4, -4, -3, -2, 1, 4, 4, 4, 5, 6]),
        ([(i, i + 1) for i in range(8, 17)], (11, 14), [-6, -5, -4, -1, 2, 3, 4, 5, 6]),
        ([(i, i - 1) for i in range(10, 17)], (11, 14), [-6, -5, 2, 2, 2, 5, 6]),
        ([(i, i - 1) for i in range(10, 17)], (13, 12), [-6, -6, -6, 0, 6, 6, 6]),
    ],
)
def test_codes(spark, x, y, want):
    df = pairs(spark, x, [y] * len(x)).orderBy("rid")
    assert [r[0] for r in df.select(compare.code("xs", "xe", "ys", "ye")).collect()] == want
    assert [r[0] for r in df.select(compare.code("ys", "ye", "xs", "xe")).collect()] == [-w for w in want]


def in_order(df):
    return [(r.start, r.end) for r in df.orderBy("rid").collect()]


def test_transforms(spark):
    x = frame(spark, [(2, 3), (5, 7), (1, 3)])
    assert [s for s, _ in in_order(intra.resize(x, 10, "end"))] == [-6, -2, -6]
    assert [s for s, _ in in_order(intra.resize(x, 10, "center"))] == [-2, 1, -3]
    assert in_order(intra.flank(x, 2)) == [(0, 1), (3, 4), (-1, 0)]
    assert in_order(intra.flank(x, 2, start=False)) == [(4, 5), (8, 9), (4, 5)]
    assert in_order(intra.flank(x, F.when(F.col("rid") == 2, -2).otherwise(2))) == [(0, 1), (5, 6), (-1, 0)]
    assert in_order(intra.flank(x, 2, both=True)) == [(0, 3), (3, 6), (-1, 2)]
    assert in_order(intra.restrict(x, 1, 2)) == [(2, 2), (1, 2)]
    assert in_order(intra.restrict(x, 1, 2, keep_all=True)) == [(2, 2), (3, 2), (1, 2)]
    z = frame(spark, [(1, 3), (5, 10)])
    assert in_order(intra.zoom(z, F.col("rid"))) == [(1, 3), (6, 8)]
    assert in_order(intra.zoom(z, -2)) == [(-1, 4), (2, 13)]
    bounds = spark.createDataFrame([(1, 0, 10), (2, 5, 6), (3, 3, 9)], "rid long, a long, b long")
    assert in_order(intra.reflect(x.join(bounds, "rid"), "a", "b")) == [(7, 8), (4, 6), (9, 11)]
    with pytest.raises(Exception, match="leaves the allowed range"):
        intra.shift(x, 2**31 - 2).collect()


def test_circular(spark):
    q = widths(spark, range(-2, 18), [3] * 20)
    s = frame(spark, [(4, 7), (-1, 0), (599, 999)])
    found = set(hits(overlaps.find_circular(q, s, 10)))

    def on_circle(a, b):
        return {p % 10 for p in range(a[0], a[1] + 1)} & {p % 10 for p in range(b[0], b[1] + 1)}

    want = {(i, j) for i, a in enumerate([(k, k + 2) for k in range(-2, 18)], 1) for j, b in enumerate([(4, 7), (-1, 0), (599, 999)], 1) if on_circle(a, b)}
    assert found == want


def lists_of(spark, *rows):
    return spark.createDataFrame([(i, list(r)) for i, r in enumerate(rows)], "k int, v array<double>").orderBy("k")


def test_running_sums(spark):
    df = lists_of(spark, [None, 1.0, 1.0])
    assert df.select(lists.running("v", 2, "sum", na_rm=True)).first()[0] == [1.0, 2.0]
    assert df.select(lists.running("v", 2, "sum")).first()[0] == [None, 2.0]


def test_running_medians(spark):
    df = lists_of(spark, [1.0, 9.0, 2.0, 8.0, 3.0, 7.0, 100.0], [5.0, 4.0])
    keep = [r[0] for r in df.select(lists.running_median("v", 3, rule="keep")).collect()]
    assert keep == [[1.0, 2.0, 8.0, 3.0, 7.0, 7.0, 100.0], [5.0, 4.0]]
    constant = df.select(lists.running_median("v", 3, rule="constant")).first()[0]
    assert constant == [2.0, 2.0, 8.0, 3.0, 7.0, 7.0, 7.0]
    # Tukey's rule: median of the end value, its neighbour and 3 a - 2 b of the next two
    smoothed = df.select(lists.running_median("v", 3)).first()[0]
    assert smoothed == [1.0, 2.0, 8.0, 3.0, 7.0, 7.0, 7.0]


def test_constructors(spark):
    df = spark.createDataFrame([(1, None, 3), (None, 5, 2)], "a long, b long, w long")
    assert ranges(model.ranges(df, start="a", end="b", width="w")) == [(1, 3), (4, 5)]
    with pytest.raises(Exception, match="can't be solved"):
        model.ranges(spark.createDataFrame([(1, 5, 3)], "a long, b long, w long"), start="a", end="b", width="w").collect()
    text = spark.createDataFrame([("3-5",), ("-2..4",), ("-7--3",), (" 8 ",)], "t string")
    assert ranges(model.from_text(text, "t")) == [(-7, -3), (-2, 4), (3, 5), (8, 8)]
    with pytest.raises(Exception, match="not a range"):
        model.from_text(spark.createDataFrame([("x",)], "t string"), "t").collect()
    pos = spark.createDataFrame([(0, i, p) for i, p in enumerate([44, 45, 46, 10, 9, 10, 11])], "space long, rid long, pos long")
    assert got(model.from_integers(pos), "rid", "start", "end") == [(1, 44, 46), (2, 10, 10), (3, 9, 11)]


def test_empty_frames(spark):
    none = frame(spark, [(1, 2)]).filter("rid < 0")
    some = frame(spark, [(1, 2)])
    assert algebra.reduce(none).collect() == algebra.coverage(none).collect() == algebra.disjoin(none).collect() == []
    assert overlaps.find(none, some).collect() == overlaps.find(some, none).collect() == []
    assert ranges(algebra.union(none, some)) == [(1, 2)]
    assert nearest.nearest(none, some).collect() == []
