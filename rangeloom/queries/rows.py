"""Sources, accessors and row-wise transforms."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import model
from ..functions import compare, intra
from ..operators import algebra, groups, masks
from ..sources import masks as readers
from ..sources import scratch
from .base import C, L, O, Registry, T

R = Registry()
add = R.add


def rng(s: str, e: str, more: str = "", frm: str = "o", where: str = "") -> str:
    return f'SELECT space, rid, CAST({s} AS BIGINT) AS start, CAST({e} AS BIGINT) AS "end"{more} FROM {frm}{where}'


def wide(s, d, least: int):
    return O(s, d).filter(F.col("end") - F.col("start") + 1 >= least)


def paired(s, d):
    """Orders beside the lines of the same number."""
    x = O(s, d).select(F.col("rid"), F.col("start").alias("xs"), F.col("end").alias("xe"))
    y = L(s, d).select(F.col("rid"), F.col("start").alias("ys"), F.col("end").alias("ye"))
    return x.join(y, "rid")


PAIRED = "x AS MATERIALIZED (SELECT rid, o.s AS xs, o.e AS xe, l.s AS ys, l.e AS ye FROM o JOIN l USING (rid))"


def bounds(df, pair):
    return df.select("rid", pair[0].alias("start"), pair[1].alias("end"))


# ---- sources ---------------------------------------------------------------------------------------------------------

add("s1_ranges_from_start_width", lambda s, d: model.ranges(O(s, d).select(F.col("space").alias("k"), F.col("rid").alias("n"), F.col("start").alias("a"), (F.col("end") - F.col("start") + 1).alias("w")), start="a", width="w", space="k", rid="n").drop("a", "w", "k", "n"), rng("s", "e"))
add("s1b_ranges_from_end_width", lambda s, d: model.ranges(O(s, d).select(F.col("space").alias("k"), F.col("rid").alias("n"), F.when(F.col("rid") % 2 == 0, F.col("start")).alias("a"), F.when(F.col("rid") % 2 == 1, F.col("end")).alias("b"), (F.col("end") - F.col("start") + 1).alias("w")), start="a", end="b", width="w", space="k", rid="n").drop("a", "b", "w", "k", "n"), rng("s", "e"))


def _solved(s, d):
    df = O(s, d).withColumn("ref", F.col("end") - F.col("start") + 5)
    a, b = model.solve_window("ref", F.lit(2), F.lit(-2))
    return df.select("rid", a.alias("start"), b.alias("end"))


add("s2_solve_window", _solved, 'SELECT rid, CAST(2 AS BIGINT) AS start, e - s + 5 - 1 AS "end" FROM o')
add("s3_from_text", lambda s, d: model.from_text(O(s, d).select("space", "rid", F.when(F.col("rid") % 2 == 0, F.concat_ws("..", "start", "start")).when(F.col("end") == F.col("start"), F.col("start").cast("string")).otherwise(F.concat_ws("-", "start", "end")).alias("t")).select(F.col("space").alias("k"), F.col("rid").alias("n"), "t"), "t", space="k", rid="n").select("space", "rid", "start", "end"), rng("s", "CASE WHEN rid % 2 = 0 THEN s ELSE e END"))
add(
    "s4_from_integers",
    lambda s, d: model.from_integers(O(s, d).select("space", "rid", (F.col("rid") + F.floor(F.col("rid") / 50)).alias("pos"))),
    """SELECT space, island AS rid, min(pos) AS start, max(pos) AS "end" FROM (
       SELECT *, sum(f) OVER (PARTITION BY space ORDER BY rid)::BIGINT AS island FROM (
         SELECT space, rid, pos, CASE WHEN pos = lag(pos) OVER (PARTITION BY space ORDER BY rid) + 1 THEN 0 ELSE 1 END AS f
         FROM (SELECT space, rid, (rid + floor(rid / 50))::BIGINT AS pos FROM o))) GROUP BY space, island""",
)
add(
    "s5_from_logical",
    lambda s, d: model.from_logical(O(s, d).select(F.lit(0).cast("long").alias("space"), "rid", (F.col("start") % 3 > 0).alias("value"))),
    """SELECT CAST(0 AS BIGINT) AS space, row_number() OVER (ORDER BY min(rid)) AS rid, min(rid) AS start, max(rid) AS "end" FROM (
       SELECT rid, rid - row_number() OVER (ORDER BY rid) AS g FROM o WHERE s % 3 > 0) GROUP BY g""",
)
RUNS_SQL = """v AS (SELECT CAST(0 AS BIGINT) AS space, rid, s % 3 AS value FROM o),
runs AS MATERIALIZED (SELECT space, min(rid) AS s, max(rid) AS e, any_value(value) AS value FROM (
  SELECT *, sum(f) OVER (ORDER BY rid) AS g FROM (SELECT *, CASE WHEN value IS DISTINCT FROM lag(value) OVER (ORDER BY rid) THEN 1 ELSE 0 END AS f FROM v)) GROUP BY space, g)"""


def runs(s, d):
    return algebra.runs_of(O(s, d).select(F.lit(0).cast("long").alias("space"), "rid", (F.col("start") % 3).alias("value")))


add("s6_from_logical_runs", lambda s, d: model.from_logical_runs(runs(s, d).withColumn("value", F.col("value") == 1)), 'SELECT space, row_number() OVER (ORDER BY s) AS rid, s AS start, e AS "end" FROM runs WHERE value = 1', more=RUNS_SQL)
add("s7_positions", lambda s, d: model.positions(O(s, d)), "SELECT space, rid, unnest(generate_series(s, e)) AS pos FROM o WHERE e >= s")
add(
    "s8_stitch",
    lambda s, d: model.stitch(O(s, d).select("space", "rid", (F.col("rid") * 2).alias("start"), (F.col("rid") * 2 + F.col("start") % 20).alias("end"))),
    """SELECT space, island AS rid, min(s) AS start, max(e) AS "end" FROM (SELECT *, sum(f) OVER (PARTITION BY space ORDER BY rid)::BIGINT AS island FROM (
       SELECT *, CASE WHEN s = lag(e) OVER (PARTITION BY space ORDER BY rid) + 1 THEN 0 ELSE 1 END AS f FROM (SELECT space, rid, rid * 2 AS s, rid * 2 + s % 20 AS e FROM o))) GROUP BY space, island""",
)
add(
    "s9_successive",
    lambda s, d: model.successive(O(s, d).select("space", "rid", (F.col("end") - F.col("start") + 1).alias("width")), gap=2, first=10).select("space", "rid", "start", "end"),
    """SELECT space, rid, st AS start, st + w - 1 AS "end" FROM (SELECT space, rid, w, (10 + coalesce(sum(w + 2) OVER (PARTITION BY space ORDER BY rid ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))::BIGINT AS st
       FROM (SELECT space, rid, e - s + 1 AS w FROM o))""",
)
add("s10_sliding", lambda s, d: model.sliding(s, T(s, d, "lineitem").count(), 20, 7), 'SELECT CAST(0 AS BIGINT) AS space, i + 1 AS rid, i * 7 + 1 AS start, i * 7 + 20 AS "end" FROM (SELECT unnest(generate_series(0, ((SELECT count(*) FROM lineitem) - 20) // 7)) AS i)', frames="")
add("s11_chunks", lambda s, d: model.chunks(s, T(s, d, "lineitem").count(), n=10).unionByName(model.chunks(s, T(s, d, "lineitem").count(), size=100).withColumn("space", F.lit(1).cast("long"))), 'SELECT CAST(0 AS BIGINT) AS space, i + 1 AS rid, (i * c) // 10 + 1 AS start, ((i + 1) * c) // 10 AS "end" FROM (SELECT unnest(generate_series(0, 9)) AS i), (SELECT count(*) AS c FROM lineitem) UNION ALL SELECT 1, i + 1, i * 100 + 1, least((i + 1) * 100, c) FROM (SELECT unnest(generate_series(0, (SELECT count(*) - 1 FROM lineitem) // 100)) AS i), (SELECT count(*) AS c FROM lineitem)', frames="")
add("s12_centered", lambda s, d: model.centered(O(s, d), "start", 3), rng("s - 3", "s + 3"))
ISLANDS = """i AS (SELECT *, sum(f) OVER (PARTITION BY space ORDER BY s, e, rid) AS g FROM (SELECT *, CASE WHEN pm IS NULL OR s - pm - 1 >= {gap} THEN 1 ELSE 0 END AS f FROM (
  SELECT *, max(e) OVER (PARTITION BY space ORDER BY s, e, rid ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS pm FROM {src})))"""
add("s13_as_normal", lambda s, d: algebra.reduce(C(s, d), drop_empty=True), 'SELECT space, min(s) FILTER (e >= s) AS start, max(e) AS "end" FROM i GROUP BY space, g HAVING bool_or(e >= s)', frames="c", more=ISLANDS.format(gap=1, src="src"))
add("s14_grouped", lambda s, d: model.grouped(O(s, d), "space", ["start", "end"]).select("space", F.size("rows").cast("long").alias("n"), F.get("rows", F.lit(0))["start"].alias("first_start"), F.get("rows", F.size("rows") - 1)["end"].alias("last_end")), "SELECT space, count(*) AS n, arg_min(s, rid) AS first_start, arg_max(e, rid) AS last_end FROM o GROUP BY space")


def _normal(s, d):
    """All orders in one mask: each customer's days stand in a stretch of its own."""
    moved = C(s, d).filter("end >= start").select(F.lit(1).cast("long").alias("space"), "rid", *[(F.col("space") * 20000 + F.col(c)).alias(c) for c in ("start", "end")])
    return algebra.reduce(moved, drop_empty=True).select("start", "end")


NORMAL = "mv AS (SELECT 1 AS space, rid, space * 20000 + s AS s, space * 20000 + e AS e FROM src WHERE e >= s), " + ISLANDS.format(gap=1, src="mv") + ", n AS (SELECT min(s) AS s, max(e) AS e FROM i GROUP BY g)"
add("s15_mask", lambda s, d: masks.mask(s, 4_000_000_000, _normal(s, d), name="m", beyond=True).measured(), "SELECT CAST(1 AS BIGINT) AS mask_id, 'm' AS name, true AS active, sum(e - s + 1)::BIGINT AS masked_width, sum(e - s + 1) / 4000000000.0::DOUBLE AS masked_ratio, min(s) AS \"first\", max(e) AS \"last\" FROM n", frames="c", more=NORMAL)

# Files of the five mask formats are written from the orders and read back.


def _file(s, d, name: str, line, frame=None):
    path, frame = scratch.path(s, name), O(s, d) if frame is None else frame
    line(frame.filter("end >= start")).select(F.col("l").alias("value")).write.text(path)
    return path


def _tab(*cols):
    return F.concat_ws("\t", *[F.col(c).cast("string") if isinstance(c, str) else c.cast("string") for c in cols])


def SEQ():
    return F.concat(F.lit("chr"), F.col("space").cast("string"))


def W():
    return F.col("end") - F.col("start") + 1


def agp_file(s, d):
    kind = F.when(F.col("rid") % 3 == 0, "N").otherwise("F")
    return _file(s, d, "agp", lambda df: df.withColumn("l", _tab(SEQ(), "start", "end", "rid", kind, W(), F.when(F.col("rid") % 2 == 0, "clone").otherwise("contig"), F.lit("no"))))


def gap_file(s, d):
    return _file(s, d, "gap", lambda df: df.withColumn("l", _tab(F.lit(585), SEQ(), F.col("start") - 1, "end", "rid", F.lit("N"), W(), F.lit("contig"), F.lit("no"))))


def rm_file(s, d):
    heads = ["   SW  perc perc perc  query      position in query", "score  div. del. ins.  sequence    begin     end", ""]
    body = lambda df: df.withColumn("l", F.concat(F.lit("  "), F.concat_ws("  ", F.lit("100"), F.lit("1.0"), F.lit("0.0"), F.lit("0.0"), SEQ(), F.col("start").cast("string"), F.col("end").cast("string"), F.lit("(5)"), F.lit("+"), F.lit("x"), F.lit("y"), F.lit("1"), F.lit("2"), F.lit("(3)"), F.col("rid").cast("string"))))
    path = _file(s, d, "rm", body)
    s.createDataFrame([(h,) for h in heads], "value string").write.mode("append").text(path)
    return path


def trf_file(s, d):
    return _file(s, d, "trf", lambda df: df.withColumn("l", _tab(SEQ(), F.col("start") - 1, "end", F.lit("trf"), *[F.lit(1)] * 12)))


def lift_file(s, d):
    contigs = lambda df: algebra.reduce(df, min_gap=1).withColumn("l", _tab(F.col("start") - 1, F.lit("c"), W(), SEQ(), F.lit(20000)))
    return _file(s, d, "lift", contigs, C(s, d))


add("s16_read_agp", lambda s, d: readers.agp(s, agp_file(s, d)), "SELECT 'chr' || space AS seqname, s AS start, e AS \"end\", CASE WHEN rid % 2 = 0 THEN 'clone' ELSE 'contig' END AS gap_type FROM o WHERE e >= s AND rid % 3 = 0")
add("s17_read_gap", lambda s, d: readers.ucsc_gap(s, gap_file(s, d)), "SELECT 'chr' || space AS seqname, s AS start, e AS \"end\", 'contig' AS gap_type FROM o WHERE e >= s")
add(
    "s18_read_lift",
    lambda s, d: readers.lift(s, lift_file(s, d)),
    """SELECT 'chr' || space AS seqname, start, "end" FROM (SELECT space, coalesce(lag(e) OVER w, 0) + 1 AS start, s - 1 AS "end" FROM m WINDOW w AS (PARTITION BY space ORDER BY s)
       UNION ALL SELECT space, max(e) + 1, 20000 FROM m GROUP BY space) WHERE "end" >= start""",
    frames="c",
    more="full_src AS (SELECT * FROM src WHERE e >= s), " + ISLANDS.format(gap=1, src="full_src") + ", m AS (SELECT space, min(s) AS s, max(e) AS e FROM i GROUP BY space, g)",
)
add("s19_read_rm", lambda s, d: readers.repeat_masker(s, rm_file(s, d)), "SELECT 'chr' || space AS seqname, s AS start, e AS \"end\", CAST(rid AS VARCHAR) AS id FROM o WHERE e >= s")
add("s20_read_trf", lambda s, d: readers.tandem_repeats(s, trf_file(s, d)), "SELECT 'chr' || space AS seqname, s AS start, e AS \"end\" FROM o WHERE e >= s")
add("s21_seqnames", lambda s, d: readers.seqnames(s, trf_file(s, d), "trf"), "SELECT DISTINCT 'chr' || space AS seqname FROM o WHERE e >= s")
add("s22_empty_mask", lambda s, d: masks.empty(s, T(s, d, "lineitem").count(), name="x").measured().select("name", "masked_width", "masked_ratio"), "SELECT 'x' AS name, CAST(0 AS BIGINT) AS masked_width, 0 / count(*)::DOUBLE AS masked_ratio FROM lineitem", frames="")
add("s23_to_text", lambda s, d: O(s, d).select("rid", model.to_text().alias("text")), "SELECT rid, CASE WHEN s = e THEN CAST(s AS VARCHAR) ELSE s || '-' || e END AS text FROM o")
add("s24_positions_frame", lambda s, d: model.positions(O(s, d)).groupBy("pos").agg(F.count(F.lit(1)).alias("n")), "SELECT pos, count(*) AS n FROM (SELECT unnest(generate_series(s, e)) AS pos FROM o WHERE e >= s) GROUP BY pos")
add("s25_summary", lambda s, d: model.sizes(O(s, d)), "SELECT space, count(*) AS length, sum(e - s + 1)::BIGINT AS width_sum, max(e - s + 1) = 0 AS all_empty FROM o GROUP BY space")

# ---- accessors, setters, predicates ----------------------------------------------------------------------------------

add("p1_getters", lambda s, d: O(s, d).select("rid", model.width().alias("width"), model.mid().alias("mid")), "SELECT rid, e - s + 1 AS width, s + CAST(trunc((e - s) / 2.0) AS BIGINT) AS mid FROM o")
add("p2_setters", lambda s, d: model.set_width(model.set_end(model.set_start(O(s, d), F.col("start") - 1), F.col("end") + 2), 9), rng("s - 1", "s + 7"))
add("p3_update", lambda s, d: model.update(O(s, d), end=F.col("end") + 1, width=4), rng("e - 2", "e + 1"))
add("p4_take_ranges", lambda s, d: model.take_ranges(O(s, d), O(s, d).select(F.col("rid").alias("start"), (F.col("rid") + F.col("rid") % 4 - 1).alias("end"))), rng("s", "e", frm="o JOIN (SELECT unnest(generate_series(rid, rid + rid % 4 - 1)) AS rid FROM o) USING (rid)"))
add("p4b_take", lambda s, d: model.take(O(s, d), O(s, d).select((-F.col("rid")).alias("n"), "rid")), 'SELECT -rid AS n, rid, space, s AS start, e AS "end" FROM o')
add("p5_assign", lambda s, d: model.assign(O(s, d), O(s, d).filter("rid % 5 = 0").withColumn("start", F.col("end"))), rng("CASE WHEN rid % 5 = 0 THEN e ELSE s END", "e"))
add("p6_element", lambda s, d: O(s, d).filter("space = 3"), rng("s", "e", where=" WHERE space = 3"))
add(
    "p7_replace_window",
    lambda s, d: model.replace_window(O(s, d), 11, 20, s.createDataFrame([(9, 1, 1, 2), (9, 2, 3, 4)], "space long, rid long, start long, end long")),
    'SELECT space, rid, s AS start, e AS "end" FROM o WHERE rid < 11 UNION ALL SELECT space, rid - 8, s, e FROM o WHERE rid > 20 UNION ALL VALUES (9, 11, 1, 2), (9, 12, 3, 4)',
)
add("p8_sizes", lambda s, d: O(s, d).groupBy("space").agg(F.count(F.lit(1)).alias("n")), "SELECT space, count(*) AS n FROM o GROUP BY space")
add(
    "p9_is_normal",
    lambda s, d: model.is_normal(O(s, d)),
    "SELECT space, NOT bool_or(bad) AS normal, min(rid) FILTER (bad) AS first_bad FROM (SELECT *, e < s OR coalesce(s < lag(e) OVER (PARTITION BY space ORDER BY rid) + 2, false) AS bad FROM o) GROUP BY space",
)
add("p10_is_disjoint", lambda s, d: model.is_disjoint(C(s, d)), "SELECT space, NOT bool_or(bad) AS disjoint FROM (SELECT *, coalesce(s <= lag(e) OVER (PARTITION BY space ORDER BY s, e, rid), false) AS bad FROM src) GROUP BY space", frames="c")
add("p11_squeeze", lambda s, d: L(s, d).select("space", "rid", "start", "end"), rng("s", "e", frm="l"), frames="l")
add("p12_space", lambda s, d: O(s, d).select("space", "rid"), "SELECT space, rid FROM o")
add(
    "p13_merge_lists",
    lambda s, d: model.concat(O(s, d), L(s, d).select("space", "rid", "start", "end")),
    'SELECT space, row_number() OVER (PARTITION BY space ORDER BY k, rid) AS rid, s AS start, e AS "end" FROM (SELECT 0 AS k, space, rid, s, e FROM o UNION ALL SELECT 1, space, rid, s, e FROM l)',
    frames="ol",
)
add(
    "p14_poverlaps",
    lambda s, d: paired(s, d).select("rid", *[compare.paired_overlap("xs", "xe", "ys", "ye", maxgap=g, minoverlap=k, type=t).alias(n) for n, t, g, k in (("any_0", "any", 0, 1), ("any_400", "any", 400, 1), ("start_99", "start", 99, 0), ("end_99", "end", 99, 0), ("within", "within", 0, 0), ("equal_300", "equal", 300, 0))]),
    """SELECT rid, least(xe, ye) - greatest(xs, ys) + 1 >= 1 AS any_0, least(xe + 400, ye) - greatest(xs - 400, ys) + 1 >= 1 AS any_400, abs(xs - ys) <= 99 AND k >= 0 AS start_99,
       abs(xe - ye) <= 99 AND k >= 0 AS end_99, xs >= ys AND xe <= ye AS within, abs(xs - ys) <= 300 AND abs(xe - ye) <= 300 AND k >= 0 AS equal_300 FROM (SELECT *, least(xe, ye) - greatest(xs, ys) + 1 AS k FROM x)""",
    frames="ol",
    more=PAIRED,
)
CODE = """CASE WHEN xe + 1 < ys THEN -6 WHEN xe + 1 = ys AND xe < xs AND ye < ys THEN 0 WHEN xe + 1 = ys THEN -5 WHEN ye + 1 < xs THEN 6 WHEN ye + 1 = xs THEN 5
  ELSE CASE sign(xs - ys) WHEN -1 THEN -3 + sign(xe - ye) WHEN 0 THEN sign(xe - ye) ELSE 3 + sign(xe - ye) END END"""
CODE = CODE.replace("-3 + sign(xe - ye)", "CASE sign(xe - ye) WHEN -1 THEN -4 WHEN 0 THEN -3 ELSE -2 END")


def near_pairs(s, d):
    return paired(s, d).select("rid", "xs", "xe", (F.col("xs") + F.col("rid") % 41 - 20).alias("ys"), (F.col("xs") + F.col("rid") % 41 - 20 + F.col("ye") - F.col("ys")).alias("ye"))


NEAR = PAIRED + ", y AS MATERIALIZED (SELECT rid, xs, xe, xs + rid % 41 - 20 AS ys, xs + rid % 41 - 20 + ye - ys AS ye FROM x)"
def code():
    return compare.code("xs", "xe", "ys", "ye")

add("p15_pcompare", lambda s, d: near_pairs(s, d).select("rid", code().cast("int").alias("code"), compare.letter(code()).alias("letter")), f"SELECT rid, CAST({CODE} AS INT) AS code, substr('abcdefghijklm', CAST({CODE} AS INT) + 7, 1) AS letter FROM y", frames="ol", more=NEAR)
add("p16_comparisons", lambda s, d: near_pairs(s, d).select("rid", (F.struct("xs", "xe") < F.struct("ys", "ye")).alias("lt"), (F.struct("xs", "xe") <= F.struct("ys", "ye")).alias("le"), (F.struct("xs", "xe") == F.struct("ys", "ye")).alias("eq")), "SELECT rid, xs < ys OR (xs = ys AND xe < ye) AS lt, xs < ys OR (xs = ys AND xe <= ye) AS le, xs = ys AND xe = ye AS eq FROM y", frames="ol", more=NEAR)
add("p17_selection", lambda s, d: groups.selection(L(s, d), O(s, d).filter("end - start = 3"), ["weight"]), "SELECT space, rid, w AS weight FROM l WHERE EXISTS (SELECT 1 FROM o WHERE o.space = l.space AND o.e - o.s = 3 AND l.s <= o.e AND o.s <= l.e)", frames="ol")
add("p18_names", lambda s, d: groups.renamed(groups.described(O(s, d), "start", unit="day"), {"start": "day_from", "end": "day_to"}), "SELECT space, rid, s AS day_from, e AS day_to FROM o")
add("p19_transform", lambda s, d: groups.transformed(L(s, d).select("rid", "weight"), double=F.col("weight") * 2, plus=F.col("double") + 1), "SELECT rid, w AS weight, w * 2 AS double, w * 2 + 1 AS plus FROM l", frames="l")

# ---- transforms ------------------------------------------------------------------------------------------------------

add("t1_shift", lambda s, d: intra.shift(O(s, d), F.col("rid") % 7 - 3), rng("s + rid % 7 - 3", "e + rid % 7 - 3"))
add("t2_narrow", lambda s, d: intra.narrow(wide(s, d, 4), start=2, end=-2), rng("s + 1", "e - 1", where=" WHERE e - s + 1 >= 4"))
def FIX():
    return F.element_at(F.array(F.lit("start"), F.lit("end"), F.lit("center")), (F.col("rid") % 3 + 1).cast("int"))


add("t3_resize", lambda s, d: intra.resize(O(s, d), 10, FIX()), 'SELECT space, rid, a AS start, a + 9 AS "end" FROM (SELECT *, CAST(CASE rid % 3 WHEN 0 THEN s WHEN 1 THEN e - 9 ELSE s + floor((e - s + 1 - 10) / 2.0) END AS BIGINT) AS a FROM o)')
add("t4_flank", lambda s, d: intra.flank(O(s, d), F.col("rid") % 9 - 4, start=F.col("rid") % 2 == 0), 'SELECT space, rid, CASE WHEN rid % 2 = 0 THEN CASE WHEN f >= 0 THEN s - f ELSE s END ELSE CASE WHEN f >= 0 THEN e + 1 ELSE e + f + 1 END END AS start, CASE WHEN rid % 2 = 0 THEN CASE WHEN f >= 0 THEN s - 1 ELSE s - f - 1 END ELSE CASE WHEN f >= 0 THEN e + f ELSE e END END AS "end" FROM (SELECT *, rid % 9 - 4 AS f FROM o)')
add("t4b_flank_both", lambda s, d: intra.flank(O(s, d), 3, start=F.col("rid") % 2 == 0, both=True), rng("CASE WHEN rid % 2 = 0 THEN s - 3 ELSE e - 2 END", "CASE WHEN rid % 2 = 0 THEN s + 2 ELSE e + 3 END"))
add("t5_promoters", lambda s, d: intra.promoters(O(s, d), 20, 5), rng("s - 20", "s + 4"))
add("t6_terminators", lambda s, d: intra.terminators(O(s, d), 20, 5), rng("e - 20", "e + 4"))
add("t7_reflect", lambda s, d: intra.reflect(O(s, d), 8000, F.lit(12000)), rng("20000 - e", "20000 - s"))
add("t8_restrict", lambda s, d: intra.restrict(O(s, d), 8500, 9500), rng("greatest(s, 8500)", "least(e, 9500)", where=" WHERE e >= 8499 AND s <= 9501"))
add("t8b_restrict_keep", lambda s, d: intra.restrict(O(s, d), 8500, 9500, keep_all=True), rng("CASE WHEN e < 8499 THEN 8500 WHEN s > 9501 THEN 9501 ELSE greatest(s, 8500) END", "CASE WHEN e < 8499 THEN 8499 WHEN s > 9501 THEN 9500 ELSE least(e, 9500) END"))
add("t8c_restrict_drop", lambda s, d: intra.restrict(O(s, d), 8500, 9500, drop_empty=True), rng("greatest(s, 8500)", "least(e, 9500)", where=" WHERE least(e, 9500) >= greatest(s, 8500)"))
add("t9_three_bands", lambda s, d: intra.three_bands(wide(s, d, 4), start=2, width_=2), 'SELECT space, rid, band, CASE band WHEN \'left\' THEN s WHEN \'middle\' THEN s + 1 ELSE s + 3 END AS start, CASE band WHEN \'left\' THEN s WHEN \'middle\' THEN s + 2 ELSE e END AS "end" FROM o, (VALUES (\'left\'), (\'middle\'), (\'right\')) b(band) WHERE e - s + 1 >= 4')
add("t10_zoom", lambda s, d: intra.zoom(O(s, d), F.when(F.col("rid") % 2 == 0, 2).otherwise(-2)), 'SELECT space, rid, a AS start, a + CAST(floor((e - s + 1) / f) AS BIGINT) - 1 AS "end" FROM (SELECT *, CAST(ceil((s + e) / 2.0 - (e - s + 1) / (2 * f)) AS BIGINT) AS a FROM (SELECT *, CASE WHEN rid % 2 = 0 THEN 2.0 ELSE 0.5 END AS f FROM o))')
add("t11_grow", lambda s, d: intra.grow(O(s, d), 3), rng("s - 3", "e + 3"))
add("t12_reverse", lambda s, d: intra.reverse(O(s, d)), 'SELECT space, rid, min(s) OVER w + max(e) OVER w - e AS start, min(s) OVER w + max(e) OVER w - s AS "end" FROM o WINDOW w AS (PARTITION BY space)')
add("t13_tile", lambda s, d: intra.tile(wide(s, d, 3), n=3), 'SELECT space, rid, i AS tile, s + (i - 1) * w // 3 AS start, s + i * w // 3 - 1 AS "end" FROM (SELECT *, e - s + 1 AS w, unnest([1, 2, 3]) AS i FROM o WHERE e - s + 1 >= 3)')
add("t13b_tile_size", lambda s, d: intra.tile(wide(s, d, 1), size=7), 'SELECT space, rid, i AS tile, s + (i - 1) * w // n AS start, s + i * w // n - 1 AS "end" FROM (SELECT *, unnest(generate_series(1, n)) AS i FROM (SELECT *, e - s + 1 AS w, CAST(ceil((e - s + 1) / 7.0) AS BIGINT) AS n FROM o WHERE e >= s))')
add("t14_sliding_windows", lambda s, d: intra.sliding_windows(O(s, d), 5, 3), 'SELECT space, rid, i + 1 AS "window", s + i * 3 AS start, least(s + i * 3 + 4, e) AS "end" FROM (SELECT *, unnest(generate_series(0, CAST(ceil(greatest(e - s + 1 - 5, 0) / 3.0) AS BIGINT))) AS i FROM o)')
add("t15_first_circle", lambda s, d: intra.to_first_circle(intra.shift(O(s, d), -9000), 365), 'SELECT space, rid, a AS start, a + e - s AS "end" FROM (SELECT *, ((s - 9000 - 1) % 365 + 365) % 365 + 1 AS a FROM o)')
add("t16_trim", lambda s, d: intra.trim(intra.shift(O(s, d), -9000), 500), 'SELECT space, rid, CASE WHEN e < 0 THEN 1 WHEN s > 501 THEN 501 ELSE greatest(s, 1) END AS start, CASE WHEN e < 0 THEN 0 WHEN s > 501 THEN 500 ELSE least(e, 500) END AS "end" FROM (SELECT space, rid, s - 9000 AS s, e - 9000 AS e FROM o)')
add("t16b_subviews", lambda s, d: intra.subviews(wide(s, d, 4), 100000, start=2, end=-1), rng("s + 1", "e", where=" WHERE e - s + 1 >= 4"))
add("t17_successive_views", lambda s, d: intra.trim(model.successive(O(s, d).select("space", "rid", (F.col("end") - F.col("start") + 1).alias("width"))).drop("width"), 5000), 'SELECT space, rid, CASE WHEN e < 0 THEN 1 WHEN s > 5001 THEN 5001 ELSE greatest(s, 1) END AS start, CASE WHEN e < 0 THEN 0 WHEN s > 5001 THEN 5000 ELSE least(e, 5000) END AS "end" FROM (SELECT space, rid, b - w + 1 AS s, b AS e FROM (SELECT space, rid, e - s + 1 AS w, (sum(e - s + 1) OVER (PARTITION BY space ORDER BY rid))::BIGINT AS b FROM o))')

QUERIES, ORACLES = R.queries, R.oracles
