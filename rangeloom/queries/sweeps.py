"""Interval algebra, coverage, masks and views."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import model
from ..functions import compare
from ..model import sizes
from ..operators import algebra, groups, masks, overlaps, views
from .base import C, FOLD, K, L, O, Registry
from .rows import ISLANDS, NEAR, PAIRED, bounds, near_pairs, paired

R = Registry()
add = R.add


OUT = 'SELECT space, min(s) AS start, max(e) AS "end" FROM i GROUP BY space, g'


def isl(gap: int) -> str:
    """Islands of the orders of each customer."""
    return ISLANDS.format(gap=gap, src="src")


add("i1_range", lambda s, d: algebra.hull(O(s, d)), 'SELECT space, min(s) AS start, max(e) AS "end" FROM o GROUP BY space')
add("i2_reduce", lambda s, d: algebra.reduce(C(s, d)), OUT, frames="c", more=isl(1))
add("i2_reduce_gap", lambda s, d: algebra.reduce(C(s, d), min_gap=5), OUT, frames="c", more=isl(5))
add("i2_reduce_lines", lambda s, d: algebra.reduce(K(s, d, FOLD)), OUT, frames="b", more=ISLANDS.format(gap=1, src="b"))
add("i2_reduce_dense", lambda s, d: algebra.reduce(L(s, d).select("space", "rid", "start", "end")), OUT, frames="l", more=ISLANDS.format(gap=1, src="l"))
add("i2a_reduce_drop_empty", lambda s, d: algebra.reduce(C(s, d), drop_empty=True, min_gap=3), 'SELECT space, min(s) FILTER (e >= s) AS start, max(e) AS "end" FROM i GROUP BY space, g HAVING bool_or(e >= s)', frames="c", more=isl(3))
add("i2b_reduce_gap_0", lambda s, d: algebra.reduce(C(s, d), min_gap=0), 'SELECT space, start, "end" FROM (SELECT space, min(s) AS start, max(e) AS "end", bool_or(e >= s) AS f, min(rid) AS r FROM i GROUP BY space, g) WHERE f UNION ALL SELECT DISTINCT space, start, "end" FROM (SELECT space, min(s) AS start, max(e) AS "end", bool_or(e >= s) AS f FROM i GROUP BY space, g) WHERE NOT f', frames="c", more=isl(0))
add("i2c_reduce_revmap", lambda s, d: algebra.reduce(C(s, d), revmap=True).withColumn("revmap", F.array_join(F.transform("revmap", lambda x: x.cast("string")), ",")), 'SELECT space, min(s) AS start, max(e) AS "end", string_agg(CAST(rid AS VARCHAR), \',\' ORDER BY s, e, rid) AS revmap FROM i GROUP BY space, g', frames="c", more=isl(1))
add(
    "i2d_reduce_inframe",
    lambda s, d: algebra.inframe(C(s, d)).select("space", "rid", "inframe"),
    "SELECT i.space, i.rid, (i.s - m.a + m.b + 1)::BIGINT AS inframe FROM i JOIN (SELECT space, g, a, coalesce(sum(z - a + 1) OVER (PARTITION BY space ORDER BY g ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS b FROM (SELECT space, g, min(s) AS a, max(e) AS z FROM i GROUP BY space, g)) m USING (space, g)",
    frames="c",
    more=isl(1),
)
add("i3_reduce_list", lambda s, d: algebra.reduce(C(s, d).withColumn("space", F.col("space") * 10 + F.col("rid") % 3)), OUT, frames="c", more="part AS (SELECT space * 10 + rid % 3 AS space, rid, s, e FROM src), " + ISLANDS.format(gap=1, src="part"))
#: Runs of positions, given one by one.
RUN = 'SELECT space, min(dd) AS start, max(dd) AS "end" FROM (SELECT *, dd - row_number() OVER (PARTITION BY space ORDER BY dd) AS g FROM {f}) GROUP BY space, g'
#: Gaps between islands, with an empty island at each bound.
FULL = "full_src AS (SELECT * FROM src WHERE e >= s), " + ISLANDS.format(gap=1, src="full_src") + ", m AS MATERIALIZED (SELECT space, min(s) AS s, max(e) AS e FROM i GROUP BY space, g)"
GAPS = 'SELECT space, a AS start, s - 1 AS "end" FROM (SELECT space, s, max(e) OVER (PARTITION BY space ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) + 1 AS a FROM {f}) WHERE s > a'
BOUNDS = "n AS (SELECT * FROM m UNION ALL SELECT DISTINCT space, {low}, {low} - 1 FROM src UNION ALL SELECT DISTINCT space, {high} + 1, {high} FROM src)"
add("i4_gaps_bounded", lambda s, d: algebra.gaps(C(s, d), 7000, 13000), GAPS.format(f="n"), frames="c", more=FULL + ", " + BOUNDS.format(low=7000, high=13000))
add("i4b_gaps_inner", lambda s, d: algebra.gaps(C(s, d)), GAPS.format(f="m"), frames="c", more=FULL)


def mask_set(s, d):
    """A mask per customer: its reduced orders; every other one is inactive."""
    one = algebra.reduce(C(s, d), drop_empty=True).select(F.col("space").alias("mask_id"), "start", "end")
    name = F.concat(F.lit("m"), F.col("mask_id").cast("string"))
    head = C(s, d).select(F.col("space").alias("mask_id")).distinct().select("mask_id", name.alias("name"), F.lit(None).cast("string").alias("desc"), (F.col("mask_id") % 2 == 1).alias("active"), F.lit(13000).cast("long").alias("width"))
    return masks.Masks(head, one)


MASK = FULL.replace("SELECT space, min(s)", "SELECT space AS id, min(s)") + ", h AS (SELECT DISTINCT space AS id FROM src)"
add("i5_gaps_masks", lambda s, d: mask_set(s, d).gaps().ranges, 'SELECT id AS mask_id, start, "end" FROM (SELECT id, coalesce(lag(e) OVER w, 0) + 1 AS start, s - 1 AS "end" FROM m WINDOW w AS (PARTITION BY id ORDER BY s) UNION ALL SELECT id, coalesce(max(e), 0) + 1, 13000 FROM h LEFT JOIN m USING (id) GROUP BY id) WHERE "end" >= start', frames="c", more=MASK)
CUTS = """ct AS (SELECT DISTINCT space, p FROM (SELECT space, s AS p FROM src UNION ALL SELECT space, e + 1 FROM src)), sg AS (SELECT space, p AS a, lead(p) OVER (PARTITION BY space ORDER BY p) - 1 AS z FROM ct),
dj AS MATERIALIZED (SELECT * FROM sg WHERE EXISTS (SELECT 1 FROM src WHERE src.space = sg.space AND src.e >= src.s AND src.s <= a AND src.e >= z AND z >= a))"""
add("i6_disjoin", lambda s, d: algebra.disjoin(C(s, d)), 'SELECT space, a AS start, z AS "end" FROM dj', frames="c", more=CUTS)
add("i6b_disjoin_revmap", lambda s, d: algebra.disjoin(C(s, d), revmap=True).withColumn("revmap", F.array_join(F.transform("revmap", lambda x: x.cast("string")), ",")), "SELECT dj.space, a AS start, z AS \"end\", string_agg(CAST(rid AS VARCHAR), ',' ORDER BY rid) AS revmap FROM dj JOIN src ON src.space = dj.space AND src.e >= src.s AND src.s <= a AND src.e >= z GROUP BY 1, 2, 3", frames="c", more=CUTS)
#: Range after range of a space: the first bin whose last end lies before it, or a new one.
BINS = """i AS (SELECT space, bool_and(ok) AS f FROM (SELECT space, coalesce(s >= lag(s) OVER (PARTITION BY space ORDER BY rid), true) AS ok FROM o) GROUP BY space),
n AS MATERIALIZED (SELECT space, rid, s, e, row_number() OVER (PARTITION BY space ORDER BY s, CASE WHEN f THEN 0 ELSE e END, rid) AS n FROM o JOIN i USING (space)),
r AS (SELECT space, rid, s, e, n, 1 AS bin, [e] AS ends FROM n WHERE n = 1
  UNION ALL
  SELECT space, rid, s, e, n, b, CASE WHEN b > len(ends) THEN list_append(ends, e) ELSE list_transform(ends, lambda x, j: CASE WHEN j = b THEN e ELSE x END) END
  FROM (SELECT n.*, r.ends, coalesce(list_position(list_transform(r.ends, lambda x: x < n.s), true), len(r.ends) + 1) AS b FROM r JOIN n ON n.space = r.space AND n.n = r.n + 1))"""
add("i7_disjoint_bins", lambda s, d: algebra.disjoint_bins(O(s, d)), 'SELECT space, rid, s AS start, e AS "end", CAST(bin AS BIGINT) AS bin FROM r', more=BINS, recursive=True)
add("i7b_disjoint_bins_lines", lambda s, d: algebra.disjoint_bins(L(s, d)).select("space", "rid", "bin"), "SELECT space, rid, CAST(bin AS BIGINT) AS bin FROM r", frames="l", more=BINS.replace("FROM o)", "FROM l)").replace("FROM o JOIN", "FROM l JOIN"), recursive=True)


def two(s, d):
    """Orders by customer, and lines by order number: short lists on both sides, most of their spaces in common."""
    y = L(s, d, (F.col("l_orderkey") % 20011).cast("long")).select("space", "rid", "start", "end")
    return C(s, d), y


#: Where both sides begin and end, how many ranges are open there, and the stretches on which a condition holds.
TWO = """y AS (SELECT l_orderkey % 20011 AS space, date_diff('day', DATE '1970-01-01', CAST(l_shipdate AS DATE)) AS s, date_diff('day', DATE '1970-01-01', CAST(l_shipdate AS DATE)) + CAST(l_quantity AS INT) - 1 AS e FROM lineitem),
ev AS (SELECT space, s AS p, 1 AS x, 0 AS y FROM src WHERE e >= s UNION ALL SELECT space, e + 1, -1, 0 FROM src WHERE e >= s UNION ALL SELECT space, s, 0, 1 FROM y WHERE e >= s UNION ALL SELECT space, e + 1, 0, -1 FROM y WHERE e >= s),
st AS (SELECT space, p, sum(sum(x)) OVER w > 0 AS x, sum(sum(y)) OVER w > 0 AS y FROM ev GROUP BY space, p WINDOW w AS (PARTITION BY space ORDER BY p)),
ch AS (SELECT *, {on} AS now, coalesce(lag({on}) OVER (PARTITION BY space ORDER BY p), false) AS was FROM st)"""
STRETCH = 'SELECT space, start, "end" FROM (SELECT space, now, p AS start, lead(p) OVER (PARTITION BY space ORDER BY p) - 1 AS "end" FROM ch WHERE now <> was) WHERE now'
for name, op, on in (("i8_union", algebra.union, "x OR y"), ("i9_intersect", algebra.intersect, "x AND y"), ("i10_setdiff", algebra.setdiff, "x AND NOT y")):
    add(name, lambda s, d, op=op: op(*two(s, d)), STRETCH, frames="c", more=TWO.replace("{on}", f"({on})"))
add("i11_setdiff_empty", lambda s, d: algebra.setdiff(C(s, d).filter("false"), two(s, d)[1]), 'SELECT space, s AS start, e AS "end" FROM o WHERE false')
add("i12_punion", lambda s, d: bounds(paired(s, d), compare.punion("xs", "xe", "ys", "ye", fill_gap=True)), 'SELECT rid, least(xs, ys) AS start, greatest(xe, ye) AS "end" FROM x', frames="ol", more=PAIRED)
add(
    "i13_pintersect",
    lambda s, d: bounds(near_pairs(s, d), compare.pintersect("xs", "xe", "ys", "ye", resolve_empty="max.start")),
    'SELECT rid, a AS start, CASE WHEN f THEN a - 1 ELSE least(xe, ye) END AS "end" FROM (SELECT *, CASE WHEN ky THEN ys WHEN kx THEN xs ELSE greatest(xs, ys) END AS a, kx OR ky OR least(xe, ye) < greatest(xs, ys) AS f FROM (SELECT *, xe < xs AND (xs BETWEEN ys AND ye OR (xs = ys AND ye < ys)) AS kx, ye < ys AND ys BETWEEN xs AND xe AS ky FROM y))',
    frames="ol",
    more=NEAR,
)
add("i14_psetdiff", lambda s, d: bounds(near_pairs(s, d).filter("not (ys > xs and ye < xe)"), compare.psetdiff("xs", "xe", "ys", "ye")), 'SELECT rid, CASE WHEN h AND ye < xe THEN ye + 1 ELSE xs END AS start, CASE WHEN h AND ye >= xe THEN greatest(xs, ys) - 1 ELSE xe END AS "end" FROM (SELECT *, least(xe, ye) >= greatest(xs, ys) AS h FROM y WHERE NOT (ys > xs AND ye < xe))', frames="ol", more=NEAR)
add("i15_pgap", lambda s, d: bounds(near_pairs(s, d), compare.pgap("xs", "xe", "ys", "ye")), 'SELECT rid, least(xe, ye) + 1 AS start, least(xe, ye) + greatest(greatest(xs, ys) - least(xe, ye) - 1, 0) AS "end" FROM y', frames="ol", more=NEAR)
add("i17_list_setops", lambda s, d: algebra.intersect(*[x.withColumn("space", F.col("space") % 3) for x in two(s, d)]), STRETCH, frames="c", more=TWO.replace("{on}", "(x AND y)").replace("SELECT space, s AS p, 1", "SELECT space % 3 AS space, s AS p, 1").replace("SELECT space, e + 1, -1", "SELECT space % 3, e + 1, -1").replace("SELECT space, s, 0, 1", "SELECT space % 3, s, 0, 1").replace("SELECT space, e + 1, 0, -1", "SELECT space % 3, e + 1, 0, -1"))

# ---- coverage --------------------------------------------------------------------------------------------------------

#: Coverage position by position, then runs of equal values.
RLE = 'SELECT space, min(dd) AS start, max(dd) AS "end", value FROM (SELECT *, sum(f) OVER (PARTITION BY space ORDER BY dd) AS g FROM (SELECT *, CASE WHEN value IS DISTINCT FROM lag(value) OVER (PARTITION BY space ORDER BY dd) THEN 1 ELSE 0 END AS f FROM cov)) GROUP BY space, value, g'


def cov(src: str, weight: str, top: str, low: str = "1") -> str:
    return f"""top AS (SELECT space, {top} AS t, {low} AS b FROM {src} GROUP BY space), pos AS (SELECT space, unnest(generate_series(b, t)) AS dd FROM top),
    ev AS (SELECT space, greatest(s, b) AS p, {weight} AS v FROM {src} JOIN top USING (space) WHERE least(e, t) >= greatest(s, b) UNION ALL SELECT space, least(e, t) + 1, -{weight} FROM {src} JOIN top USING (space) WHERE least(e, t) >= greatest(s, b)),
    cov AS (SELECT space, dd, (sum(coalesce(v, 0)) OVER (PARTITION BY space ORDER BY dd)) AS value FROM (SELECT space, dd, (SELECT sum(v) FROM ev WHERE ev.space = pos.space AND ev.p = dd) AS v FROM pos))"""


BIG = RLE.replace("end\", value FROM", 'end", CAST(value AS BIGINT) AS value FROM')
add("i18_coverage", lambda s, d: algebra.coverage(O(s, d)), BIG, more=cov("o", "1", "max(e)"))
add("i18b_coverage_shift_width", lambda s, d: algebra.coverage(O(s, d), shift=-9000, width=1000), BIG, more="sh AS (SELECT space, s - 9000 AS s, e - 9000 AS e FROM o), " + cov("sh", "1", "1000"))
add("i19_coverage_double_weight", lambda s, d: algebra.coverage(L(s, d), weight=F.col("weight") / 4), RLE.replace("end\", value FROM", 'end", CAST(value AS DOUBLE) AS value FROM'), frames="l", more=cov("l", "w / 4.0", "max(e)"))
add("i20_coverage_circular", lambda s, d: algebra.coverage(algebra.circular(O(s, d), 365), width=365), BIG, more="ps AS (SELECT space, (dd - 1) % 365 + 1 AS s FROM (SELECT space, unnest(generate_series(s, e)) AS dd FROM o)), cov AS (SELECT p.space, p.dd, count(ps.s) AS value FROM (SELECT sp AS space, dd FROM (SELECT unnest(generate_series(0, 7)) AS sp), (SELECT unnest(generate_series(1, 365)) AS dd)) p LEFT JOIN ps ON ps.space = p.space AND ps.s = p.dd GROUP BY 1, 2)")
add("i21_coverage_weight_column", lambda s, d: algebra.coverage(L(s, d), weight="weight"), BIG, frames="l", more=cov("l", "w", "max(e)"))
add("i22_coverage_list", lambda s, d: algebra.coverage(O(s, d).withColumn("len", 9000 + F.col("space") * 10), width="len"), BIG, more=cov("o", "1", "9000 + any_value(space) * 10"))
add("i23_window_coverage", lambda s, d: algebra.window_coverage(O(s, d), collapse=False), "SELECT space, dd AS pos, value::BIGINT AS value FROM cov", more=cov("o", "1", "max(e)", "min(s)"))
add("i24_slice", lambda s, d: algebra.slice_runs(algebra.coverage(O(s, d), dealt=True), 3, 5), RUN.format(f="(SELECT * FROM cov WHERE value BETWEEN 3 AND 5)"), more=cov("o", "1", "max(e)"))

# ---- masks -----------------------------------------------------------------------------------------------------------

add("i26_mask_measures", lambda s, d: mask_set(s, d).measured(), "SELECT id AS mask_id, 'm' || id AS name, id % 2 = 1 AS active, coalesce(sum(e - s + 1), 0)::BIGINT AS masked_width, coalesce(sum(e - s + 1), 0) / 13000.0::DOUBLE AS masked_ratio, min(s) AS \"first\", max(e) AS \"last\" FROM h LEFT JOIN m USING (id) GROUP BY id", frames="c", more=MASK)
add("i27_mask_collapse", lambda s, d: mask_set(s, d).collapse().ranges.select("start", "end"), 'SELECT min(s) AS start, max(e) AS "end" FROM (SELECT *, sum(f) OVER (ORDER BY s, e) AS g FROM (SELECT *, CASE WHEN s - max(e) OVER (ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) - 1 < 1 THEN 0 ELSE 1 END AS f FROM m WHERE id % 2 = 1)) GROUP BY g', frames="c", more=MASK)
add("i28_mask_sets", lambda s, d: mask_set(s, d).subset(1, 2).append(mask_set(s, d).subset(3)).activate(F.col("mask_id") == 2).named(F.concat(F.lit("n"), F.col("mask_id").cast("string"))).masks.select("mask_id", "name", "active"), "SELECT id AS mask_id, 'n' || id AS name, id % 2 = 1 OR id = 2 AS active FROM h WHERE id IN (1, 2) UNION ALL SELECT id + (SELECT max(id) FROM h WHERE id IN (1, 2)), 'n' || (id + (SELECT max(id) FROM h WHERE id IN (1, 2))), true FROM h WHERE id = 3", frames="c", more=MASK)
add("i29_mask_narrow", lambda s, d: mask_set(s, d).narrow(8500, 9500).ranges, 'SELECT id AS mask_id, greatest(s, 8500) - 8499 AS start, least(e, 9500) - 8499 AS "end" FROM m WHERE least(e, 9500) >= greatest(s, 8500)', frames="c", more=MASK)

# ---- pieces of lists and runs ----------------------------------------------------------------------------------------


def line(s, d):
    """All lists (a space's weights) one behind the other, in long form."""
    return groups.in_line(L(s, d).select(F.col("space").alias("group_id"), "rid", "weight"), "group_id")


def cuts(s, d):
    """Pieces of 1000 that cover all elements."""
    n = L(s, d).agg(F.count(F.lit(1))).first()[0]
    return model.chunks(s, max(n, 1), size=1000)


LISTS = "f AS (SELECT space, w, row_number() OVER (ORDER BY space, rid) AS n FROM l)"
FRAG = "SELECT space AS group_id, (n - 1) // 1000 + 1 AS range_id, count(*) AS size, sum(w)::BIGINT AS total, arg_min(w, n) AS \"first\" FROM f GROUP BY 1, 2"


def fragments(s, d):
    out = groups.fragmented(line(s, d), cuts(s, d))
    return out.groupBy("group_id", "range_id").agg(F.count(F.lit(1)).alias("size"), F.sum("weight").alias("total"), F.min_by("weight", "pos").alias("first"))


add("i30_list_fragments", fragments, FRAG, frames="l", more=LISTS)
add("i31_equisplit", lambda s, d: fragments(s, d).groupBy("range_id").agg(F.sum("size").alias("size"), F.sum("total").alias("total")), "SELECT (n - 1) // 1000 + 1 AS range_id, count(*)::BIGINT AS size, sum(w)::BIGINT AS total FROM f GROUP BY 1", frames="l", more=LISTS)


def super_lists(s, d):
    rows = L(s, d).select(F.col("space").alias("group_id"), "rid", "weight")
    return groups.regrouped(rows, s.range(8).select(F.col("id").alias("group_id"), F.floor(F.col("id") / 3).alias("super_id")))


add("i32_regroup_supergroup", lambda s, d: super_lists(s, d).groupBy("super_id").agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("place") * F.col("weight") % 1009).alias("digest")), "SELECT super_id, count(*) AS n, sum(i * w % 1009)::BIGINT AS digest FROM (SELECT space // 3 AS super_id, w, row_number() OVER (PARTITION BY space // 3 ORDER BY space, rid) AS i FROM l) GROUP BY 1", frames="l")


def coarse(s, d):
    return algebra.runs_of(O(s, d).select(F.lit(0).cast("long").alias("space"), "rid", (F.floor(F.col("rid") / 700) % 4).alias("value")))


CR = "r AS (SELECT (rid // 700) % 4 AS value, min(rid) AS a, max(rid) AS z FROM o GROUP BY rid // 700)"
add("i33_split_runs", lambda s, d: algebra.split_runs(coarse(s, d)).select("value", F.array_join("ranges", ",").alias("ranges")), "SELECT value, string_agg(a || '-' || z, ',' ORDER BY a) AS ranges FROM r GROUP BY value", more=CR)
add("i34_order_runs", lambda s, d: algebra.order_runs(coarse(s, d)).select("place", "start", "end", "value"), 'SELECT row_number() OVER (ORDER BY value, a) AS place, a AS start, z AS "end", value FROM r', more=CR)


def whole_rows(s, d):
    """Pieces of 1000 rows from row 0 to the largest number of an order."""
    pieces = model.chunks(s, O(s, d).agg(F.coalesce(F.max("rid"), F.lit(0)) + 1).first()[0], size=1000)
    return pieces.withColumns({"start": F.col("start") - 1, "end": F.col("end") - 1})


add("i35_dice_runs", lambda s, d: algebra.dice(coarse(s, d), whole_rows(s, d)).select("part", "start", "end", "value"), 'SELECT rid // 1000 + 1 AS part, min(rid) AS start, max(rid) AS "end", (rid // 700) % 4 AS value FROM o GROUP BY rid // 1000, rid // 700, (rid // 700) % 4')
add("i36_space_summary", lambda s, d: sizes(O(s, d)).select("space", "length", "width_sum"), "SELECT space, count(*) AS length, sum(e - s + 1)::BIGINT AS width_sum FROM o GROUP BY space")
add("i37_min_max_normal", lambda s, d: algebra.hull(algebra.reduce(C(s, d), drop_empty=True)).select("space", F.col("start").alias("low"), F.col("end").alias("high")), "SELECT space, min(s) AS low, max(e) AS high FROM src WHERE e >= s GROUP BY space", frames="c")

# ---- views -----------------------------------------------------------------------------------------------------------


def subject(s, d):
    """Coverage of the lines as a run table with some nulls."""
    return algebra.coverage(L(s, d)).withColumn("value", F.when(F.col("value") != 77, F.col("value")))


VW = "a AS (SELECT * FROM o), " + cov("l", "1", "max(e)").replace("cov AS (", "cov0 AS (") + ", cov AS MATERIALIZED (SELECT space, dd, CASE WHEN value <> 77 THEN value::BIGINT END AS value FROM cov0), j AS MATERIALIZED (SELECT a.space, a.rid, cov.dd, cov.value FROM a LEFT JOIN cov ON cov.space = a.space AND cov.dd BETWEEN a.s AND a.e)"
G = " FROM j GROUP BY space, rid"
add("v1_views", lambda s, d: views.clipped(O(s, d), subject(s, d).groupBy("space").agg(F.max("end").alias("length"))), 'SELECT a.space, rid, CASE WHEN s > t + 1 THEN t + 1 ELSE s END AS start, CASE WHEN s > t + 1 THEN t ELSE least(e, t) END AS "end" FROM a JOIN top USING (space)', frames="ol", more=VW)
for name, column, expr in (("v2_view_mins", "view_min", "min(value)"), ("v3_view_maxs", "view_max", "max(value)"), ("v4_view_sums", "view_sum", "coalesce(sum(value), 0)::BIGINT"), ("v5_view_means", "view_mean", "avg(value)::DOUBLE"), ("v6_view_which_mins", "which_min", "arg_min(dd, value * 100000 + dd) FILTER (value IS NOT NULL)"), ("v6b_view_which_maxs", "which_max", "arg_max(dd, value * 100000 - dd) FILTER (value IS NOT NULL)")):
    add(name, lambda s, d, column=column: views.summarize(O(s, d), subject(s, d), na_rm=True, columns=[column]).select("space", "rid", column), f"SELECT space, rid, {expr} AS {column}{G}", frames="ol", more=VW)
add(
    "v9_view_summary_nulls",
    lambda s, d: views.summarize(O(s, d), subject(s, d), columns=["n", "view_min", "view_sum", "which_max"]).select("space", "rid", "n", "view_min", "view_sum", "which_max"),
    "SELECT space, rid, count(dd) AS n, CASE WHEN count(dd) = count(value) THEN min(value) END AS view_min, CASE WHEN count(dd) = count(value) THEN coalesce(sum(value), 0)::BIGINT END AS view_sum, arg_max(dd, value * 100000 - dd) FILTER (value IS NOT NULL AND dd < coalesce(nl, 1000000)) AS which_max FROM (SELECT *, min(CASE WHEN value IS NULL THEN dd END) OVER (PARTITION BY space, rid) AS nl FROM j) GROUP BY space, rid",
    frames="ol",
    more=VW,
)
add("v7_view_range_maxs", lambda s, d: views.extreme_runs(O(s, d), subject(s, d), largest=True, na_rm=True).select("space", "rid", "pos", "value"), "SELECT space, rid, arg_max(dd, value * 100000 - dd) AS pos, max(value) AS value FROM j WHERE value IS NOT NULL GROUP BY space, rid", frames="ol", more=VW)
add("v8_view_apply", lambda s, d: views.apply(O(s, d), subject(s, d), F.count_distinct("value")).select("space", "rid", F.coalesce("result", F.lit(0)).alias("result")), f"SELECT space, rid, count(DISTINCT value) AS result{G}", frames="ol", more=VW)


def _spreads(pdf):
    v = pdf.groupby(["space", "rid"], sort=False)["value"]
    return (v.max() - v.min()).astype("float64").reset_index(name="spread")


add("v8b_view_apply_python", lambda s, d: views.apply_python(O(s, d).filter("end >= start"), subject(s, d), _spreads, "space long, rid long, spread double", together=True), "SELECT space, rid, (max(value) - min(value))::DOUBLE AS spread FROM j WHERE dd IS NOT NULL GROUP BY space, rid", frames="ol", more=VW)
add("v10_views_list", lambda s, d: views.summarize(O(s, d), subject(s, d), na_rm=True, columns=["view_sum"]).groupBy("space").agg(F.sum("view_sum").alias("total")), "SELECT space, coalesce(sum(value), 0)::BIGINT AS total FROM j GROUP BY space", frames="ol", more=VW)
add("v11_unlist_views", lambda s, d: views.unlisted(O(s, d), subject(s, d)), "SELECT space, rid, dd AS pos, value FROM j WHERE dd IS NOT NULL", frames="ol", more=VW)
add("v11b_view_matrix", lambda s, d: views.matrix(O(s, d), subject(s, d), 3).select("space", "rid", F.get("values", F.lit(0)).alias("c1"), F.get("values", F.lit(2)).alias("c3")), "SELECT space, rid, max(value) FILTER (i = 1) AS c1, max(value) FILTER (i = 3) AS c3 FROM (SELECT *, row_number() OVER (PARTITION BY space, rid ORDER BY dd) AS i FROM j) GROUP BY space, rid", frames="ol", more=VW)
add("v12_paired_spaces", lambda s, d: views.paired(O(s, d), subject(s, d)), 'SELECT space, rid, s AS start, e AS "end" FROM a', frames="ol", more=VW)
add("v13_concat_views", lambda s, d: views.combined(*[O(s, d).withColumn("subject", F.lit("x"))] * 2).groupBy("space").agg(F.count(F.lit(1)).alias("n"), F.max("rid").alias("last")), "SELECT space, 2 * count(*) AS n, 2 * count(*) AS \"last\" FROM a GROUP BY space", frames="ol", more=VW)

QUERIES, ORACLES = R.queries, R.oracles
