"""Overlap joins, nearest lookups and matches."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import compare
from ..operators import algebra, groups, nearest, overlaps
from ..sources import scratch
from .base import C, FOLD, K, L, O, P, Registry, T

R = Registry()
add = R.add


def ab(s, d):
    """All orders and all lines, in spaces so many that a range meets few others."""
    return C(s, d, FOLD), K(s, d, FOLD)


ANY = "a.s <= b.e AND b.s <= a.e"


def hits(on: str) -> str:
    return f"SELECT a.space, a.rid AS query_id, b.rid AS subject_id FROM a JOIN b ON a.space = b.space AND {on}"


def find(name: str, on: str, **how) -> None:
    add(name, lambda s, d: overlaps.find(*ab(s, d), **how), hits(on), frames="ab")


SHARED = "least(a.e, b.e) - greatest(a.s, b.s) + 1"
find("j1_find_any", ANY)
find("j1b_find_any_maxgap", "a.s <= b.e + 4 AND b.s <= a.e + 4", maxgap=3)
find("j1c_find_any_minoverlap", f"{SHARED} >= 5", minoverlap=5)
find("j2_find_start", "a.s = b.s", type="start")
find("j2b_find_start_maxgap", "abs(a.s - b.s) <= 2", type="start", maxgap=2)
find("j2c_find_end", f"a.e = b.e AND {SHARED} >= 3", type="end", minoverlap=3)
find("j2d_find_end_maxgap", "abs(a.e - b.e) <= 2", type="end", maxgap=2)
find("j3_find_within", "a.s >= b.s AND a.e <= b.e", type="within")
find("j3b_find_within_maxgap", "a.s >= b.s AND a.e <= b.e AND (a.s - b.s) + (b.e - a.e) <= 5", type="within", maxgap=5)
find("j4_find_extend", "b.s >= a.s AND b.e <= a.e", type="extend")
find("j5_find_equal", "a.s = b.s AND a.e = b.e", type="equal")
find("j5b_find_equal_maxgap", "abs(a.s - b.s) <= 2 AND abs(a.e - b.e) <= 2", type="equal", maxgap=2)
for which, expr in (("first", "min(l.rid)"), ("last", "max(l.rid)"), ("arbitrary", "min(l.rid)")):
    add(f"j6_select_{which}", lambda s, d, which=which: overlaps.one_hit(O(s, d), L(s, d), which), f"SELECT o.space, o.rid AS query_id, {expr} AS subject_id FROM o LEFT JOIN l ON o.space = l.space AND o.s <= l.e AND l.s <= o.e GROUP BY 1, 2", frames="ol")
add("j6_select_count", lambda s, d: overlaps.count(O(s, d), L(s, d)).select("space", F.col("rid").alias("query_id"), "n"), "SELECT o.space, o.rid AS query_id, count(l.rid) AS n FROM o LEFT JOIN l ON o.space = l.space AND o.s <= l.e AND l.s <= o.e GROUP BY 1, 2", frames="ol")
SELF = "b AS (SELECT * FROM a)"
add("j7_self", lambda s, d: overlaps.find_self(ab(s, d)[0]), hits(ANY), frames="a", more=SELF)
add("j7b_self_drop", lambda s, d: overlaps.find_self(ab(s, d)[0], drop_self=True, drop_redundant=True), hits(ANY + " AND a.rid < b.rid"), frames="a", more=SELF)
add("j8_points", lambda s, d: overlaps.find(overlaps.points(ab(s, d)[0], "start"), ab(s, d)[1]), hits("a.s <= b.e AND b.s <= a.s"), frames="ab")
add("j9_spaces_by_name", lambda s, d: overlaps.find(C(s, d), K(s, d, FOLD)), hits(ANY).replace("FROM a JOIN", "FROM src a JOIN"), frames="cb")


def pair_frame(s, d):
    a = ab(s, d)[0]
    return a.select("space", "rid", F.struct("start", "end").alias("first"), F.struct((F.col("start") + 100).alias("start"), (F.col("end") + 100).alias("end")).alias("second"))


add("j10_pairs_input", lambda s, d: overlaps.find_pairs(pair_frame(s, d), ab(s, d)[1]), hits(f"(({ANY}) OR (a.s + 100 <= b.e AND b.s <= a.e + 100))"), frames="ab")
ROUND = "(s - 1) % 365 + 1 AS s, (s - 1) % 365 + 1 + e - s AS e"
CIRC = f"c AS (SELECT space, rid, {ROUND} FROM a), k AS (SELECT space, rid, {ROUND} FROM b)"
ON_CIRCLE = "SELECT c.space, c.rid AS query_id, count(DISTINCT k.rid) AS n, sum(DISTINCT k.rid)::BIGINT AS total FROM c JOIN k ON c.space = k.space AND {on} GROUP BY 1, 2"


def circular(s, d, **how):
    found = overlaps.find_circular(*ab(s, d), 365, **how)
    return found.groupBy("space", "query_id").agg(F.count(F.lit(1)).alias("n"), F.sum("subject_id").alias("total"))


add("j11_circular", lambda s, d: overlaps.count_circular(*ab(s, d), 365), ON_CIRCLE.format(on="EXISTS (SELECT 1 FROM (VALUES (-365), (0), (365)) t(v) WHERE c.s + v <= k.e AND k.s <= c.e + v)"), frames="ab", more=CIRC)
add("j11b_circular_end", lambda s, d: circular(s, d, type="end", maxgap=1), ON_CIRCLE.format(on="least(((c.e - k.e) % 365 + 365) % 365, ((k.e - c.e) % 365 + 365) % 365) <= 1"), frames="ab", more=CIRC)
add(
    "j12_grouped_codes",
    lambda s, d: overlaps.find_grouped(*[x.withColumnRenamed("space", "group").withColumn("code", F.col("rid") % 3) for x in ab(s, d)]),
    f"SELECT a.space AS \"group\", a.rid AS query_id, b.rid AS subject_id FROM a JOIN b ON a.space = b.space AND {ANY} AND (a.rid % 3 = 0 OR b.rid % 3 = 0 OR a.rid % 3 = b.rid % 3)",
    frames="ab",
)
add("j13_local_ids", lambda s, d: overlaps.find_local(*ab(s, d)), "SELECT x.space, x.i AS query_id, y.i AS subject_id FROM x JOIN y ON x.space = y.space AND x.s <= y.e AND y.s <= x.e", frames="ab", more="x AS (SELECT *, row_number() OVER (PARTITION BY space ORDER BY rid) AS i FROM a), y AS (SELECT *, row_number() OVER (PARTITION BY space ORDER BY rid) AS i FROM b)")


def flagship(s, d):
    return overlaps.count(O(s, d), L(s, d).select("space", "rid", "start", "end"))


#: Counted per order: lines that end before it starts and lines that start behind its end are those that don't overlap.
COUNT = """SELECT o.space, o.rid, o.s AS start, o.e AS "end", count(l.rid) AS n FROM o LEFT JOIN l ON o.space = l.space AND o.s <= l.e AND l.s <= o.e GROUP BY 1, 2, 3, 4"""
add("count_overlaps", flagship, COUNT, frames="ol")
add("j14_count_overlaps", lambda s, d: overlaps.count(*ab(s, d), maxgap=0), "SELECT a.space, a.rid, a.s AS start, a.e AS \"end\", count(b.rid) AS n FROM a LEFT JOIN b ON a.space = b.space AND a.s <= b.e + 1 AND b.s <= a.e + 1 GROUP BY 1, 2, 3, 4", frames="ab")
for name, on, how in (
    ("j14b_count_within", "o.s >= l.s AND o.e <= l.e", {"type": "within"}),
    ("j14c_count_extend", "l.s >= o.s AND l.e <= o.e AND l.e - l.s + 1 >= 3", {"type": "extend", "minoverlap": 3}),
    ("j14d_count_minoverlap", "least(o.e, l.e) - greatest(o.s, l.s) + 1 >= 5", {"minoverlap": 5}),
    ("j14e_count_within_maxgap", "o.s >= l.s AND o.e <= l.e AND (o.s - l.s) + (l.e - o.e) <= 9", {"type": "within", "maxgap": 9}),
    ("j14f_count_equal_maxgap", "abs(o.s - l.s) <= 2 AND abs(o.e - l.e) <= 2", {"type": "equal", "maxgap": 2}),
    ("j14g_count_start_maxgap", "abs(o.s - l.s) <= 2", {"type": "start", "maxgap": 2}),
):
    add(name, lambda s, d, how=how: overlaps.count(O(s, d), L(s, d), **how).select("space", "rid", "n"), f"SELECT o.space, o.rid, count(l.rid) AS n FROM o LEFT JOIN l ON o.space = l.space AND {on} GROUP BY 1, 2", frames="ol")
add("j15_any_overlap", lambda s, d: overlaps.any_overlap(*ab(s, d)), f'SELECT space, rid, s AS start, e AS "end", EXISTS (SELECT 1 FROM b WHERE a.space = b.space AND {ANY}) AS hit FROM a', frames="ab")
add("j15b_within_any", lambda s, d: overlaps.any_overlap(*ab(s, d), type="within"), 'SELECT space, rid, s AS start, e AS "end", EXISTS (SELECT 1 FROM b WHERE a.space = b.space AND a.s >= b.s AND a.e <= b.e) AS hit FROM a', frames="ab")
add("j15c_outside", lambda s, d: overlaps.any_overlap(*ab(s, d)).select("space", "rid", (~F.col("hit")).alias("outside")), f"SELECT space, rid, NOT EXISTS (SELECT 1 FROM b WHERE a.space = b.space AND {ANY}) AS outside FROM a", frames="ab")
add("j16_subset", lambda s, d: overlaps.subset(*ab(s, d)), 'SELECT space, rid, s AS start, e AS "end" FROM a WHERE EXISTS (SELECT 1 FROM b WHERE a.space = b.space AND a.s <= b.e AND b.s <= a.e)', frames="ab")
add("j16b_subset_invert", lambda s, d: overlaps.subset(*ab(s, d), invert=True), 'SELECT space, rid, s AS start, e AS "end" FROM a WHERE NOT EXISTS (SELECT 1 FROM b WHERE a.space = b.space AND a.s <= b.e AND b.s <= a.e)', frames="ab")
add("j17_intersections", lambda s, d: overlaps.intersections(*ab(s, d)), f'SELECT a.space, a.rid AS query_id, b.rid AS subject_id, greatest(a.s, b.s) AS start, least(a.e, b.e) AS "end" FROM a JOIN b ON a.space = b.space AND {ANY}', frames="ab")
add("j18_merge", lambda s, d: overlaps.merge(ab(s, d)[0], L(s, d, (F.col("l_partkey") % FOLD).cast("long"))).select("space", "q_rid", "q_start", "q_end", "s_rid", "s_start", "s_end", "s_weight"), f"SELECT a.space, a.rid AS q_rid, a.s AS q_start, a.e AS q_end, b.rid AS s_rid, b.s AS s_start, b.e AS s_end, b.w AS s_weight FROM a JOIN b ON a.space = b.space AND {ANY}", frames="ab")
add("j19_pairs", lambda s, d: overlaps.pairs(*ab(s, d)).select("space", F.col("first.rid").alias("a"), F.col("second.rid").alias("b"), (F.col("second.start") - F.col("first.start")).alias("delta")), f"SELECT a.space, a.rid AS a, b.rid AS b, b.s - a.s AS delta FROM a JOIN b ON a.space = b.space AND {ANY}", frames="ab")


def blocks(s, d):
    from .. import model

    return model.chunks(s, 12000, size=37).withColumn("start", F.col("start")).crossJoin(s.range(8).select(F.col("id").alias("k"))).select(F.col("k").alias("space"), "rid", "start", "end")


BLOCKS = "k AS MATERIALIZED (SELECT sp AS space, i + 1 AS rid, i * 37 + 1 AS s, least((i + 1) * 37, 12000) AS e FROM (SELECT unnest(generate_series(0, 324)) AS i), (SELECT unnest(generate_series(0, 7)) AS sp))"
add("j20_partition_subject", lambda s, d: overlaps.in_partition(O(s, d), blocks(s, d)), "SELECT o.space, o.rid AS query_id, k.rid AS subject_id FROM o JOIN k ON o.space = k.space AND o.s <= k.e AND k.s <= o.e WHERE o.e >= o.s", more=BLOCKS)


def _cuts(s, d, size):
    """The numbers of all lines in chunks of a size."""
    from .. import model

    return model.chunks(s, T(s, d, "lineitem").count(), size=size)


add(
    "j21_partition_partition",
    lambda s, d: overlaps.partition_overlaps(_cuts(s, d, 37), _cuts(s, d, 50)).drop("space"),
    "SELECT greatest(x.s, y.s) AS start, least(x.e, y.e) AS \"end\", x.i AS x_id, y.i AS y_id FROM (SELECT i + 1 AS i, i * 37 + 1 AS s, least((i + 1) * 37, c) AS e FROM (SELECT unnest(generate_series(0, (SELECT count(*) - 1 FROM lineitem) // 37)) AS i), (SELECT count(*) AS c FROM lineitem)) x JOIN (SELECT i + 1 AS i, i * 50 + 1 AS s, least((i + 1) * 50, c) AS e FROM (SELECT unnest(generate_series(0, (SELECT count(*) - 1 FROM lineitem) // 50)) AS i), (SELECT count(*) AS c FROM lineitem)) y ON x.s <= y.e AND y.s <= x.e",
    frames="",
)


def indexed(s, d):
    """The lines as a stored index, under a name of its own."""
    place = scratch.path(s, "index")
    return overlaps.build_index(ab(s, d)[1], "index_" + place[-32:], buckets=16, path=place)


add("j22_prepared_subject", lambda s, d: overlaps.find_in_index(ab(s, d)[0], indexed(s, d)), hits(ANY), frames="ab")

# ---- nearest ---------------------------------------------------------------------------------------------------------

add("j23_precede", lambda s, d: nearest.precede(*ab(s, d)), "SELECT a.space, a.rid AS query_id, (SELECT b.rid FROM b WHERE b.space = a.space AND b.s > a.e ORDER BY b.s, b.rid LIMIT 1) AS subject_id FROM a", frames="ab")
add("j23b_precede_all", lambda s, d: nearest.precede(*ab(s, d), all=True), "SELECT space, query_id, subject_id FROM (SELECT a.space, a.rid AS query_id, b.rid AS subject_id, rank() OVER (PARTITION BY a.space, a.rid ORDER BY b.s) AS r FROM a JOIN b ON a.space = b.space AND b.s > a.e) WHERE r = 1", frames="ab")
add("j24_follow", lambda s, d: nearest.follow(*ab(s, d)), "SELECT a.space, a.rid AS query_id, (SELECT b.rid FROM b WHERE b.space = a.space AND b.e < a.s ORDER BY b.e DESC, b.rid DESC LIMIT 1) AS subject_id FROM a", frames="ab")
add("j24b_follow_all", lambda s, d: nearest.follow(*ab(s, d), all=True), "SELECT space, query_id, subject_id FROM (SELECT a.space, a.rid AS query_id, b.rid AS subject_id, rank() OVER (PARTITION BY a.space, a.rid ORDER BY b.e DESC) AS r FROM a JOIN b ON a.space = b.space AND b.e < a.s) WHERE r = 1", frames="ab")
DIST = "greatest(greatest(a.s, b.s) - least(a.e, b.e) - 1, 0)"
#: Everything that overlaps or touches counts as nearest; else the least distance.
NEAR = """j AS (SELECT a.space, a.rid AS q, b.rid AS t, a.s <= b.e + 1 AND b.s <= a.e + 1 AS touch, b.s > a.e AS behind, """ + DIST + """ AS dist FROM a JOIN b ON a.space = b.space),
n AS (SELECT * FROM (SELECT *, rank() OVER (PARTITION BY space, q ORDER BY touch DESC, CASE WHEN touch THEN 0 ELSE dist END) AS r FROM j) WHERE r = 1)"""
add("j25_nearest_all", lambda s, d: nearest.nearest(*ab(s, d), all=True), "SELECT space, q AS query_id, t AS subject_id FROM n", frames="ab", more=NEAR)
add("j25b_nearest", lambda s, d: nearest.nearest(*ab(s, d)), "SELECT a.space, a.rid AS query_id, (SELECT t FROM n WHERE n.space = a.space AND n.q = a.rid ORDER BY CASE WHEN touch THEN 0 WHEN behind THEN 2 ELSE 1 END, CASE WHEN touch OR behind THEN t ELSE -t END LIMIT 1) AS subject_id FROM a", frames="ab", more=NEAR)
add("j26_distance", lambda s, d: O(s, d).join(L(s, d).select("rid", F.col("start").alias("ys"), F.col("end").alias("ye")), "rid").select("rid", compare.distance("start", "end", "ys", "ye").alias("distance")), "SELECT a.rid, " + DIST + " AS distance FROM o a JOIN l b USING (rid)", frames="ol")
add("j27_distance_to_nearest", lambda s, d: nearest.distance_to_nearest(*ab(s, d), all=True), "SELECT space, q AS query_id, t AS subject_id, dist AS distance FROM n", frames="ab", more=NEAR)
add("j28_select_nearest", lambda s, d: nearest.select_nearest({"maxgap": 10}, *ab(s, d)), "SELECT space, q AS query_id, t AS subject_id FROM (SELECT *, rank() OVER (PARTITION BY space, q ORDER BY dist) AS r FROM (SELECT a.space, a.rid AS q, b.rid AS t, " + DIST + " AS dist FROM a JOIN b ON a.space = b.space AND a.s <= b.e + 11 AND b.s <= a.e + 11)) WHERE r = 1", frames="ab")
add("j29_match", lambda s, d: compare.match(O(s, d), L(s, d).select("space", "rid", "start", "end")).select("rid", "match"), "SELECT o.rid, min(l.rid) AS match FROM o LEFT JOIN l ON o.space = l.space AND o.s = l.s AND o.e = l.e GROUP BY 1", frames="ol")
add("j29b_self_match", lambda s, d: compare.self_match(L(s, d).select("space", "rid", "start", "end")).select("rid", "match", "duplicated"), "SELECT rid, m AS match, m < rid AS duplicated FROM (SELECT rid, min(rid) OVER (PARTITION BY space, s, e) AS m FROM l)", frames="l")
add("j31_unique", lambda s, d: compare.unique(L(s, d)).select("space", "rid", "start", "end"), 'SELECT space, min(rid) AS rid, s AS start, e AS "end" FROM l GROUP BY space, s, e', frames="l")
def regrouped(s, d):
    """Lists in long form: all starts of a space, put together by a map of the spaces."""
    rows = O(s, d).withColumnRenamed("space", "group_id")
    return groups.regrouped(rows, s.range(8).select(F.col("id").alias("group_id"), (F.col("id") % 2).alias("super_id")))


add(
    "j32_regroup",
    lambda s, d: regrouped(s, d).groupBy("super_id").agg(F.count(F.lit(1)).alias("n"), F.min_by("start", "place").alias("first"), F.max_by("start", "place").alias("last"), F.sum(F.col("place") * F.col("start") % 1009).alias("digest")),
    "SELECT super_id, count(*) AS n, arg_min(s, i) AS \"first\", arg_max(s, i) AS \"last\", sum(i * s % 1009)::BIGINT AS digest FROM (SELECT space % 2 AS super_id, s, row_number() OVER (PARTITION BY space % 2 ORDER BY space, rid) AS i FROM o) GROUP BY 1",
)


def values(s, d, modulo: int):
    return algebra.runs_of(O(s, d).select(F.lit(0).cast("long").alias("space"), "rid", (F.floor(F.col("rid") / modulo) % 5).alias("value")))


def dense(modulo: int) -> str:
    return f"(rid // {modulo}) % 5"


add(
    "j33_align_runs",
    lambda s, d: algebra.align(values(s, d, 7), values(s, d, 11)).select(F.explode(F.sequence("start", "end")).alias("rid"), "v1", "v2"),
    f"SELECT rid, {dense(7)} AS v1, {dense(11)} AS v2 FROM o",
)
add("j34_find_run", lambda s, d: nearest.find_run(O(s, d).select(F.lit(0).cast("long").alias("space"), "rid", (F.col("start") + 100).alias("pos")), values(s, d, 7)).select("rid", "pos", "value"), f"SELECT a.rid, a.s + 100 AS pos, {dense(7).replace('rid', 'b.rid')} AS value FROM o a LEFT JOIN o b ON b.rid = a.s + 100")

# ---- points in time --------------------------------------------------------------------------------------------------

add("event_neighbours", lambda s, d: overlaps.count(P(s, d), P(s, d), maxgap=3600).select("space", "rid", "n"), "SELECT a.space, a.rid, count(*) AS n FROM p a JOIN p b ON a.space = b.space AND a.s <= b.s + 3601 AND b.s <= a.s + 3601 GROUP BY 1, 2", frames="p")
add("event_following", lambda s, d: nearest.follow(P(s, d), P(s, d)), "SELECT space, rid AS query_id, (SELECT max(b.rid) FROM p b WHERE b.space = a.space AND b.s = m) AS subject_id FROM (SELECT space, rid, max(s) OVER (PARTITION BY space ORDER BY s RANGE BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS m FROM p) a", frames="p")

QUERIES, ORACLES = R.queries, R.oracles
