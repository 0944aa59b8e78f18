"""Yes/no and single answers, circles, partitions with empty ranges, long groups and the options of list operators."""

import random

import pytest
from helpers import frame
from pyspark.sql import functions as F

from rangeloom.functions import lists as X
from rangeloom.operators import groups, nearest, overlaps


def some(rng, n, low=-60, high=60):
    return [(a, a + rng.choice([0, 0, 1, 3, 12, 40]) - 1) for a in (rng.randint(low, high) for _ in range(n))]


def test_nearest_against_definition(spark):
    rng = random.Random(1)
    q, s = some(rng, 60, -400, 400), some(rng, 40, -400, 400) + [(900, 905)] * 3
    touch = lambda a, b: a[0] <= b[1] + 1 and b[0] <= a[1] + 1
    gap = lambda a, b: max(max(a[0], b[0]) - min(a[1], b[1]) - 1, 0)
    all_, one = set(), {}
    for i, a in enumerate(q, 1):
        near = [j for j, b in enumerate(s, 1) if touch(a, b)]
        if near:
            one[i] = min(near)
        else:
            least = min(gap(a, b) for b in s)
            near = [j for j, b in enumerate(s, 1) if gap(a, b) == least]
            left = [j for j in near if s[j - 1][1] < a[0]]
            one[i] = max(left) if left else min(near)
        all_ |= {(i, j) for j in near}
    fq, fs = frame(spark, q), frame(spark, s)
    for chunk in (None, 16):
        assert {(r.query_id, r.subject_id) for r in nearest.nearest(fq, fs, all=True, chunk=chunk).collect()} == all_
        assert {r.query_id: r.subject_id for r in nearest.nearest(fq, fs, chunk=chunk).collect()} == one
    assert {r.subject_id for r in nearest.nearest(fq, fs.limit(0)).collect()} == {None}


def test_many_ties(spark):
    """A position that very many subjects share costs a single answer no row for each of them."""
    n = 300_000
    subject = spark.range(1, n + 1).select(F.lit(0).cast("long").alias("space"), F.col("id").alias("rid"), F.lit(50).cast("long").alias("start"), F.lit(60).cast("long").alias("end"))
    queries = frame(spark, [(i, i + 1) for i in range(100)])
    got = {r.query_id: r.subject_id for r in nearest.nearest(queries, subject).collect()}
    assert got == {i + 1: n if i > 61 else 1 for i in range(100)}
    hit = {r.rid: r.hit for r in overlaps.any_overlap(queries, subject).collect()}
    assert hit == {i + 1: 49 <= i <= 60 for i in range(100)}
    assert overlaps.subset(queries, subject, type="within").count() == 10


@pytest.mark.parametrize("type", overlaps.TYPES)
def test_any_hit_against_pairs(spark, type):
    rng = random.Random(2)
    fq, fs = frame(spark, some(rng, 50)), frame(spark, some(rng, 30))
    for how in ({}, {"maxgap": 2}, {"minoverlap": 2}):
        pairs = {r.query_id for r in overlaps.find(fq, fs, type=type, **how).collect()}
        assert {r.rid for r in overlaps.touched(fq, fs, type=type, **how).collect()} == pairs, how


@pytest.mark.parametrize("type", ["any", "start", "end", "equal"])
def test_circles(spark, type):
    rng = random.Random(3)
    length = 10
    q, s = ([(a, a + rng.randint(0, 25)) for a in (rng.randint(-30, 30) for _ in range(25))] for _ in range(2))
    round_ = lambda x, y: min((x - y) % length, (y - x) % length)

    def meets(a, b, g):
        if type == "any":
            return bool({p % length for p in range(a[0], a[1] + 1)} & {p % length for p in range(b[0], b[1] + 1)})
        if type == "equal":
            return round_(a[0], b[0]) <= g and round_(a[1], b[1]) <= g and abs((a[1] - a[0]) - (b[1] - b[0])) <= 2 * g
        return round_(a[type == "end"], b[type == "end"]) <= g

    for g in (0,) if type == "any" else (0, 2):
        want = {(i, j) for i, a in enumerate(q, 1) for j, b in enumerate(s, 1) if meets(a, b, g)}
        got = overlaps.find_circular(frame(spark, q), frame(spark, s), length, type=type, maxgap=g if g else -1).collect()
        assert {(r.query_id, r.subject_id) for r in got} == want


def test_circle_end_after_whole_turns(spark):
    got = overlaps.find_circular(frame(spark, [(1, 1)]), frame(spark, [(1, 21)]), 10, type="end").collect()
    assert [(r.query_id, r.subject_id) for r in got] == [(1, 1)]


def test_partition_with_empty_ranges(spark):
    blocks = frame(spark, [(1, 5), (6, 5), (6, 10), (11, 12)])
    query = frame(spark, [(4, 7), (3, 2), (6, 5), (1, 0), (13, 12)])
    hits = lambda **how: {(r.query_id, r.subject_id) for r in overlaps.in_partition(query, blocks, **how).collect()}
    assert hits() == {(1, 1), (1, 3)}
    assert hits(empty_queries=True) == {(1, 1), (1, 3), (2, 1)}  # at a border no block holds it
    assert hits(empty_blocks=True) == {(1, 1), (1, 3), (1, 2)}


def test_long_groups(spark):
    rng = random.Random(4)
    rows = [(rng.choice([None, 1, 1, 1, 2, 5]), i, rng.randint(0, 99)) for i in range(500)]
    df = spark.createDataFrame(rows, "g long, rid long, v long")
    line = sorted((g, i, v) for g, i, v in rows if g is not None)
    assert {r.rid: r.pos for r in groups.in_line(df, "g").collect()} == {i: k for k, (_, i, _) in enumerate(line, 1)}
    cuts = spark.createDataFrame([(1, 1, 70), (2, 101, 333)], "rid long, start long, end long")
    got = {r.rid: r.range_id for r in groups.fragmented(groups.in_line(df, "g"), cuts).collect()}
    assert got == {i: 1 if k <= 70 else 2 for k, (_, i, _) in enumerate(line, 1) if k <= 70 or 101 <= k <= 333}
    supers = spark.createDataFrame([(1, 7), (2, 8), (5, 7)], "g long, s long")
    got = {r.rid: (r.s, r.place) for r in groups.regrouped(df, supers, "g", "s").collect()}
    want, n = {}, {7: 0, 8: 0}
    for g, i, _ in line:
        s = 8 if g == 2 else 7
        n[s] += 1
        want[i] = (s, n[s])
    assert got == want
    new = spark.createDataFrame([(1, 1, 100), (1, 2, 200)], "g long, place long, v long")
    got = {r.rid: r.v for r in groups.assigned(df.filter("g is not null"), ["g"], new, "v").collect()}
    k, want = 0, {}
    for g, i, v in line:
        if g == 1:
            want[i], k = (100, 200)[k % 2], k + 1
        else:
            want[i] = v
    assert got == want
    with pytest.raises(ValueError):
        groups.crossed(df, ["rid", "v"], most=10)
    assert groups.crossed(df, ["rid", "v"], empty=False).count() == 500


def test_list_options(spark):
    df = spark.createDataFrame([([3.0, None, 1.0, 2.0, 10.0], [1.0, 2.0, None, 4.0, 9.0], 7)], "a array<double>, b array<double>, n long")
    one = lambda e: df.select(e.alias("r")).first().r
    assert one(X.order("a")) == [3, 4, 1, 5, 2]
    assert one(X.order("a", na_last=False)) == [2, 3, 4, 1, 5] and one(X.order("a", na_last=None)) == [3, 4, 1, 5]
    assert one(X.list_mean("a", na_rm=True, trim=0.25)) == 2.5 and one(X.list_mean("a", na_rm=True, trim=0.5)) == 2.5
    assert one(X.which_min("a", before="n")) == 10 and one(X.which_max("a")) == 5
    x, y = [3.0, 2.0, 10.0], [1.0, 4.0, 9.0]
    cov = sum((p - 5) * (q - 14 / 3) for p, q in zip(x, y, strict=True)) / 2
    for use in ("complete.obs", "na.or.complete", "pairwise.complete.obs"):
        assert abs(one(X.list_cov("a", "b", use=use)) - cov) < 1e-9
    assert one(X.list_cov("a", "b")) is None
    with pytest.raises(Exception, match="missing values"):
        one(X.list_cov("a", "b", use="all.obs"))
    ties = spark.createDataFrame([([2, None, 1, 2, 3, 1],)], "a array<long>")
    row = ties.select(X.rank("a", "average").alias("a"), X.rank("a", "first").alias("f"), X.duplicated("a").alias("d"), X.duplicated("a", from_last=True).alias("e"), X.self_match("a").alias("m")).first()
    assert row.a == [3.5, None, 1.5, 3.5, 5.0, 1.5] and row.f == [3.0, None, 1.0, 4.0, 5.0, 2.0]
    assert row.d == [False, False, False, True, False, True] and row.e == [True, False, True, False, False, False]
    assert row.m == [1, None, 3, 1, 5, 3]


def test_windows_on_a_stream(spark, tmp_path):
    """Sliding windows of a real stream with a watermark."""
    from rangeloom.streaming import windows

    spark.createDataFrame([(i, i * 60) for i in range(100)], "id long, at long").select("id", F.timestamp_seconds("at").alias("ts")).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("id long, ts timestamp").parquet(str(tmp_path / "in"))
    out = windows.sliding(stream, "ts", "20 minutes", "10 minutes", late="5 minutes", n=F.count(F.lit(1)))
    query = out.writeStream.format("memory").queryName("windows_out").outputMode("complete").trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "state")).start()
    query.awaitTermination(120)
    got = {r.start: r.n for r in spark.sql("select unix_seconds(start) as start, n from windows_out").collect()}
    want = {}
    for i in range(100):
        for start in (i * 60 // 600 * 600, i * 60 // 600 * 600 - 600):
            want[start] = want.get(start, 0) + 1
    assert got == want


def test_self_match_and_python_views(spark):
    """Repeated ranges name their first row; a Python function sees each view once and whole, however batches fall."""
    from rangeloom.functions import compare
    from rangeloom.operators import views

    pairs = [(1, 5), (2, 5), (1, 5), (1, 5), (2, 5), (9, 8)]
    out = compare.self_match(frame(spark, pairs))
    assert out.columns == ["space", "rid", "start", "end", "match", "duplicated"]
    assert sorted((r.rid, r.match, r.duplicated) for r in out.collect()) == [(i, pairs.index(p) + 1, pairs.index(p) + 1 < i) for i, p in enumerate(pairs, 1)]

    seen = [(a, a + a % 7) for a in range(1, 2400)]
    runs = spark.range(1, 2410).select(F.lit(0).cast("long").alias("space"), F.col("id").alias("start"), F.col("id").alias("end"), (F.col("id") * 7 % 101).alias("value"))

    def spread(pdf):
        return pdf.head(1)[["space", "rid"]].assign(n=len(pdf), total=int(pdf["value"].sum()))

    batch = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "13")
    try:
        got = {r.rid: (r.n, r.total) for r in views.apply_python(frame(spark, seen), runs, spread, "space long, rid long, n long, total long").collect()}
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", batch)
    assert got == {i: (b - a + 1, sum(x * 7 % 101 for x in range(a, b + 1))) for i, (a, b) in enumerate(seen, 1)}
