"""List columns, running values, orders, groupings and streaming forms."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import compare
from ..functions import lists as X
from ..functions import moving, ranks
from ..operators import algebra, groups, overlaps
from ..streaming import windows as stream
from ..plans.sweep import running
from .base import C, FOLD, K, L, O, Q, Registry, T

R = Registry()
add = R.add


def joined(values):
    """A list as text: elements with commas, nulls as NA."""
    return F.array_join(F.transform(values, lambda x: F.coalesce(x.cast("string"), F.lit("NA"))), ",")


def text(expr: str) -> str:
    return f"array_to_string(list_transform({expr}, lambda x: coalesce(CAST(x AS VARCHAR), 'NA')), ',')"


def digest(values):
    """A long list as the digest of its text."""
    return F.md5(joined(values))


def two(s, d):
    """Per supplier its whole list of quantities: plain (v), with nulls (a, some of them empty), backwards (w), and a
    short list that is recycled against it (b)."""
    q = Q(s, d)
    k = F.col("key")
    a = F.when(k % 5 > 0, F.transform("values", lambda x, i: F.when((x + i) % 4 == 0, None).otherwise(x))).otherwise(F.slice("values", 1, 0))
    return q.select("key", a.alias("a"), F.slice("values", F.lit(3), (k % 3 + 1).cast("int")).alias("b"), F.col("values").alias("v"), F.reverse("values").alias("w"))


TWO = """t AS MATERIALIZED (SELECT key, CASE WHEN key % 5 > 0 THEN list_transform(vals, lambda x, i: CASE WHEN (x + i - 1) % 4 = 0 THEN NULL ELSE x END) ELSE [] END AS a, vals[3:3 + key % 3] AS b, vals AS v, list_reverse(vals) AS w FROM q)"""
#: The same lists in long form: element by element.
LONG = TWO + """, la AS MATERIALIZED (SELECT key, unnest(a) AS x, unnest(generate_series(1, len(a))) AS i FROM t), lv AS MATERIALIZED (SELECT key, unnest(v) AS x, unnest(generate_series(1, len(v))) AS i FROM t), ks AS (SELECT key FROM t)"""


def q(name: str, column, sql: str, out: str = "r", more: str = TWO, text: bool = False) -> None:
    """A query with one column beside the key; of a list's text (in SQL too) the digest."""
    value = (lambda: F.md5(column())) if text else column
    add(name, lambda s, d: two(s, d).select("key", value().alias(out)), f"SELECT key, md5(r) AS r FROM ({sql})" if text else sql, frames="q", more=more)


def by_a(expr: str, na_rm: bool = False) -> str:
    """An aggregate over the long form of list a; without ``na_rm`` a null makes it null."""
    inner = f"CASE WHEN count(la.i) = count(la.x) THEN {expr} END" if not na_rm else expr
    return f"SELECT ks.key, {inner} AS r FROM ks LEFT JOIN la USING (key) GROUP BY ks.key"


def by_v(expr: str, out: str = "r") -> str:
    return f"SELECT key, {expr} AS {out} FROM lv GROUP BY key"


REC = "CASE WHEN len(b) = 0 OR len(v) = 0 THEN [] ELSE list_transform(generate_series(1, greatest(len(b), len(v))), lambda i: {e}) END"
BV, VV = "b[(i - 1) % len(b) + 1]", "v[(i - 1) % len(v) + 1]"
q("l1_add", lambda: joined(X.zipped("v", "b", lambda x, y: x + y)), f"SELECT key, {text(REC.format(e=VV + ' + ' + BV))} AS r FROM t", text=True)
q("l1b_compare", lambda: joined(X.zipped("v", "b", lambda x, y: (x < y).cast("int"))), f"SELECT key, {text(REC.format(e='CAST(' + VV + ' < ' + BV + ' AS INT)'))} AS r FROM t", text=True)
q("l1c_floor_mod", lambda: joined(X.zipped(X.each("v", lambda x: x - 5), "b", lambda x, y: X.floor_mod(x, y).cast("long"))), f"SELECT key, {text(REC.format(e='((' + VV + ' - 5) % ' + BV + ' + ' + BV + ') % ' + BV))} AS r FROM t", text=True)
q("l2_scalar", lambda: joined(X.with_scalar("a", "key", lambda x, k: x * k)), f"SELECT key, {text('list_transform(a, lambda x: x * key)')} AS r FROM t", text=True)
q("l3_negate", lambda: joined(X.each("a", lambda x: -x)), f"SELECT key, {text('list_transform(a, lambda x: -x)')} AS r FROM t", text=True)
q("l4_math", lambda: joined(X.each("v", lambda x: F.floor(F.sqrt(x.cast("double")) + F.abs(x - 9)))), f"SELECT key, {text('list_transform(v, lambda x: CAST(floor(sqrt(x) + abs(x - 9)) AS BIGINT))')} AS r FROM t", text=True)
q("l5_round", lambda: joined(X.each("v", lambda x: F.round(X.signif((x * 1001).cast("double"), 2)).cast("long"))), f"SELECT key, {text('list_transform(v, lambda x: CAST(round(round(x * 1001 / pow(10, floor(log10(x * 1001)) - 1)) * pow(10, floor(log10(x * 1001)) - 1)) AS BIGINT))')} AS r FROM t", text=True)
add("l6_complex", lambda s, d: L(s, d).select("rid", *[F.round(e, 6).alias(k) for k, e in X.complex_parts(F.col("weight").cast("double"), F.col("space").cast("double")).items()]), "SELECT rid, round(sqrt(w * w + space * space), 6) AS mod, round(atan2(space, w), 6) AS arg, w::DOUBLE AS conj_re, CAST(0 - space AS DOUBLE) AS conj_im FROM l", frames="l")
q("l7_sum", lambda: X.list_sum("a"), by_a("coalesce(sum(x), 0)::BIGINT"), more=LONG)
q("l7b_sum_na_rm", lambda: X.list_sum("a", na_rm=True), by_a("coalesce(sum(x), 0)::BIGINT", True), more=LONG)
q("l7c_prod", lambda: X.list_prod("a", na_rm=True), by_a("coalesce(product(x), 1)::DOUBLE", True), more=LONG)
q("l8_min", lambda: X.list_min("a"), by_a("min(x)"), more=LONG)
q("l8b_max_na_rm", lambda: X.list_max("a", na_rm=True), by_a("max(x)", True), more=LONG)
q("l8c_range", lambda: X.list_range("v")["high"] - X.list_range("v")["low"], by_v("max(x) - min(x)"), more=LONG)
q("l9_any", lambda: X.any_true(X.each("a", lambda x: x > 2)).cast("int"), by_a("CASE WHEN count(*) FILTER (x > 2) > 0 THEN 1 WHEN count(la.i) > count(x) THEN NULL ELSE 0 END", True), more=LONG)
q("l9b_all", lambda: X.all_true(X.each("a", lambda x: x > 0)).cast("int"), by_a("CASE WHEN count(*) FILTER (NOT x > 0) > 0 THEN 0 WHEN count(la.i) > count(x) THEN NULL ELSE 1 END", True), more=LONG)
q("l9c_any_null", lambda: X.any_null("a"), by_a("count(la.i) > count(x)", True), more=LONG)
q("l10_which_min", lambda: X.which_min("a"), by_a("arg_min(i, x * 1000000 + i) FILTER (x IS NOT NULL)", True), more=LONG)
q("l10b_which_max", lambda: X.which_max("a"), by_a("arg_max(i, x * 1000000 - i) FILTER (x IS NOT NULL)", True), more=LONG)
q("l11_mean", lambda: F.round(X.list_mean("a", na_rm=True), 9), by_a("round(avg(x), 9)", True), more=LONG)
q("l12_var", lambda: F.round(X.list_var("v"), 6), by_v("round(var_samp(x), 6)"), more=LONG)
q("l12b_sd", lambda: F.round(X.list_sd("v"), 6), by_v("round(stddev_samp(x), 6)"), more=LONG)
q("l12c_cov", lambda: F.round(X.list_cov("v", X.each("v", lambda x: x * x % 11)), 6), by_v("round(covar_samp(x, x * x % 11), 6)"), more=LONG)
q("l12d_cor", lambda: F.round(X.list_cor("v", F.transform("v", lambda x, i: x + i)), 6), by_v("CASE WHEN min(x) < max(x) THEN round(corr(x, x + i - 1), 6) END"), more=LONG)
RANKS = ", rk AS (SELECT key, i, (rank() OVER (PARTITION BY key ORDER BY x) + rank() OVER (PARTITION BY key ORDER BY x) + count(*) OVER (PARTITION BY key, x) - 1) / 2.0 AS ra, (2 * rank() OVER (PARTITION BY key ORDER BY x * 7 % 13) + count(*) OVER (PARTITION BY key, x * 7 % 13) - 1) / 2.0 AS rb FROM lv)"
q("l12e_spearman", lambda: F.round(X.list_spearman("v", X.each("v", lambda x: x * 7 % 13)), 6), "SELECT key, CASE WHEN min(ra) < max(ra) AND min(rb) < max(rb) THEN round(corr(ra, rb), 6) END AS r FROM rk GROUP BY key", more=LONG + RANKS)
q("l12f_kendall", lambda: F.round(X.list_kendall("v", X.each("v", lambda x: x * 7 % 13)), 6), "SELECT a.key, round(sum(sign(a.x - b.x) * sign(a.x * 7 % 13 - b.x * 7 % 13)) / nullif(sqrt(sum(abs(sign(a.x - b.x))) * sum(abs(sign(a.x * 7 % 13 - b.x * 7 % 13)))), 0), 6) AS r FROM lv a JOIN lv b USING (key) GROUP BY a.key", more=LONG)
q("l13_median", lambda: X.list_median("v"), by_v("median(x)::DOUBLE"), more=LONG)
q("l14_quantile", lambda: F.round(X.list_quantile("v", 0.3), 6), by_v("round(quantile_cont(x, 0.3), 6)"), more=LONG)
q("l14b_iqr", lambda: F.round(X.list_iqr("v"), 6), by_v("round(quantile_cont(x, 0.75) - quantile_cont(x, 0.25), 6)"), more=LONG)
q("l14c_mad", lambda: F.round(X.list_mad("v"), 6), "SELECT key, round(1.4826 * median(abs(x - m)), 6) AS r FROM lv JOIN (SELECT key, median(x) AS m FROM lv GROUP BY key) USING (key) GROUP BY key", more=LONG)
q("l15_pmin", lambda: joined(X.pairwise("a", F.transform("a", lambda x, i: i * 2 + 1))), "SELECT key, array_to_string(list_transform(a, lambda x, i: CASE WHEN x IS NULL THEN 'NA' ELSE CAST(least(x, i * 2 - 1) AS VARCHAR) END), ',') AS r FROM t", text=True)
q("l16_if_else", lambda: joined(X.if_else(X.each("a", lambda x: x > 2), F.transform("a", lambda x, i: i + 1), F.array(F.lit(0)))), "SELECT key, array_to_string(list_transform(a, lambda x, i: CASE WHEN x IS NULL THEN 'NA' WHEN x > 2 THEN CAST(i AS VARCHAR) ELSE '0' END), ',') AS r FROM t", text=True)
q("l17_which", lambda: joined(X.which(X.each("a", lambda x: x > 1))), by_a("coalesce(string_agg(CAST(i AS VARCHAR), ',' ORDER BY i) FILTER (x > 1), '')", True), more=LONG, text=True)
q("l18_is_null", lambda: joined(X.each(X.is_null("a"), lambda x: x.cast("int"))), f"SELECT key, {text('list_transform(a, lambda x: CAST(x IS NULL AS INT))')} AS r FROM t", text=True)
q("l19_unique", lambda: joined(X.unique("v")), "SELECT key, string_agg(CAST(x AS VARCHAR), ',' ORDER BY i) AS r FROM (SELECT key, x, min(i) AS i FROM lv GROUP BY key, x) GROUP BY key", more=LONG, text=True)
q("l19b_duplicated", lambda: joined(X.each(X.duplicated("v"), lambda x: x.cast("int"))), "SELECT key, string_agg(CASE WHEN i > m THEN '1' ELSE '0' END, ',' ORDER BY i) AS r FROM (SELECT *, min(i) OVER (PARTITION BY key, x) AS m FROM lv) GROUP BY key", more=LONG, text=True)
q("l19c_duplicated_last", lambda: joined(X.each(X.duplicated("v", from_last=True), lambda x: x.cast("int"))), "SELECT key, string_agg(CASE WHEN i < m THEN '1' ELSE '0' END, ',' ORDER BY i) AS r FROM (SELECT *, max(i) OVER (PARTITION BY key, x) AS m FROM lv) GROUP BY key", more=LONG, text=True)
q("l19d_self_match", lambda: joined(X.self_match("v")), "SELECT key, string_agg(CAST(m AS VARCHAR), ',' ORDER BY i) AS r FROM (SELECT *, min(i) OVER (PARTITION BY key, x) AS m FROM lv) GROUP BY key", more=LONG, text=True)
add("l20_table", lambda s, d: groups.contingency(two(s, d).select("key", F.col("v").alias("values")), "key"), "SELECT key, x AS value, count(*) AS n FROM lv GROUP BY key, x", frames="q", more=LONG)
WORDS = "w AS MATERIALIZED (SELECT doc_id, string_split(text, ' ') AS ws FROM documents)"


def words(s, d):
    return T(s, d, "documents").select("doc_id", F.split("text", " ").alias("ws"))


def strings(name: str, column, expr: str) -> None:
    add(name, lambda s, d: words(s, d).select("doc_id", F.md5(column()).alias("r")), f"SELECT doc_id, md5({expr}) AS r FROM w", frames="", more=WORDS)


def mapped(expr: str) -> str:
    return f"array_to_string(list_transform(ws, lambda x: {expr}), '|')"


def bar(a):
    return F.array_join(F.transform(a, lambda x: x.cast("string")), "|")


strings("l21_nchar", lambda: bar(X.each("ws", F.length)), mapped("CAST(length(x) AS VARCHAR)"))
strings("l22_case", lambda: bar(X.each("ws", lambda x: F.translate(F.concat(F.upper(F.translate(F.substring(x, 1, 1), "ß", "s")), F.lower(x)), "ae", "43"))), mapped("translate(concat(upper(translate(x[1:1], 'ß', 's')), lower(x)), 'ae', '43')"))
strings("l23_sub", lambda: bar(X.sub("ws", "[aeo]", "_")), mapped("regexp_replace(x, '[aeo]', '_')"))
strings("l23b_gsub", lambda: bar(X.gsub("ws", "[aeo]+", "_")), mapped("regexp_replace(x, '[aeo]+', '_', 'g')"))
strings("l24_grepl", lambda: bar(X.each(X.grepl("ws", "^[A-Z].*e"), lambda x: x.cast("int"))), mapped("CAST(CAST(regexp_matches(x, '^[A-Z].*e') AS INT) AS VARCHAR)"))
strings("l24b_grep_value", lambda: bar(X.grep("ws", "th", value=True, invert=True)), "array_to_string(list_filter(ws, lambda x: NOT contains(x, 'th')), '|')")
strings("l25_starts_ends", lambda: bar(X.each("ws", lambda x: (x.startswith("th") | x.endswith("n")).cast("int"))), mapped("CAST(CAST(starts_with(x, 'th') OR ends_with(x, 'n') AS INT) AS VARCHAR)"))
strings("l26_substr", lambda: bar(X.each("ws", lambda x: F.substring(x, 2, 3))), mapped("substr(x, 2, 3)"))
strings("l27_paste", lambda: X.paste("ws", F.transform("ws", lambda x, i: (i + 1).cast("string")), "-", "+"), "array_to_string(list_transform(ws, lambda x, i: x || '-' || i), '+')")
add("l28_unlist", lambda s, d: two(s, d).select("key", F.posexplode("a").alias("place", "value")), "SELECT key, i - 1 AS place, x AS value FROM la", frames="q", more=LONG)
add("l28b_drop_matrix", lambda s, d: two(s, d).select("key", F.get("w", F.lit(0)).alias("c1"), F.get("w", F.lit(2)).alias("c3")), "SELECT key, w[1] AS c1, w[3] AS c3 FROM t", frames="q", more=TWO)
add("l29_runs", lambda s, d: algebra.runs_of(two(s, d).select(F.col("key").alias("space"), F.posexplode("v").alias("i", "value")).select("space", (F.col("i") + 1).cast("long").alias("rid"), "value")).select("space", "start", (F.col("end") - F.col("start") + 1).alias("run_length"), F.col("value").alias("run_value")), "SELECT key AS space, min(i) AS start, count(*) AS run_length, x AS run_value FROM lv GROUP BY key, x", frames="q", more=LONG)
add("l30_levels", lambda s, d: T(s, d, "orders").groupBy((F.col("o_custkey") % 8).cast("long").alias("key")).agg(F.array_join(F.array_sort(F.collect_set("o_orderpriority")), ",").alias("levels")), "SELECT CAST(o_custkey % 8 AS BIGINT) AS key, string_agg(DISTINCT o_orderpriority, ',' ORDER BY o_orderpriority) AS levels FROM orders GROUP BY 1", frames="")


def status(s, d):
    o = T(s, d, "orders")
    return o.select(F.col("o_orderkey").cast("long").alias("rid"), F.when(F.col("o_orderkey") % 7 > 0, F.col("o_orderpriority")).alias("prio"), (F.col("o_custkey") % 3).cast("long").alias("k"))


ST = "st AS MATERIALIZED (SELECT CAST(o_orderkey AS BIGINT) AS rid, CASE WHEN o_orderkey % 7 > 0 THEN o_orderpriority END AS prio, CAST(o_custkey % 3 AS BIGINT) AS k FROM orders)"
add("l31_split", lambda s, d: groups.split(status(s, d), ["prio", "k"], "rid").select("prio", "k", digest(F.col("values")).alias("r")), "SELECT prio, k, md5(string_agg(CAST(rid AS VARCHAR), ',' ORDER BY rid)) AS r FROM st WHERE prio IS NOT NULL GROUP BY 1, 2", frames="", more=ST)
add("l31b_split_levels", lambda s, d: groups.split(status(s, d).filter("k < 3"), ["k"], "rid", levels=s.range(4).select(F.col("id").alias("k"))).select("k", digest(F.col("values")).alias("r")), "SELECT v.k, md5(coalesce(string_agg(CAST(rid AS VARCHAR), ',' ORDER BY rid), '')) AS r FROM (SELECT unnest(generate_series(0, 3)) AS k) v LEFT JOIN st ON st.k = v.k GROUP BY 1", frames="", more=ST)
add("l31c_multisplit", lambda s, d: groups.multisplit(status(s, d).withColumn("ks", F.array("k", F.col("k") + 10)), "ks", "rid").select("key", F.size("values").cast("long").alias("n")), "SELECT key, count(*) AS n FROM (SELECT unnest([k, k + 10]) AS key FROM st) GROUP BY 1", frames="", more=ST)
add("l31d_unsplit", lambda s, d: groups.unsplit(groups.split(status(s, d), ["k"], "rid"), ["k"]), "SELECT k, (row_number() OVER (PARTITION BY k ORDER BY rid))::INT AS place, rid AS value FROM st", frames="", more=ST)
add("l31e_relist", lambda s, d: groups.relist(L(s, d).select("rid", F.col("weight").alias("value")), O(s, d).select(F.col("rid").alias("group_id"), (F.col("rid") * 3).alias("start"), (F.col("rid") * 3 + F.col("rid") % 4 - 1).alias("end"))).select("group_id", joined(F.col("values")).alias("r")), "SELECT o.rid AS group_id, coalesce(string_agg(CAST(l.w AS VARCHAR), ',' ORDER BY l.rid), '') AS r FROM o LEFT JOIN (SELECT rid AS g, unnest(generate_series(rid * 3, rid * 3 + rid % 4 - 1)) AS p FROM o) x ON x.g = o.rid LEFT JOIN l ON l.rid = x.p GROUP BY 1", frames="ol")
add("l32_extract", lambda s, d: groups.extract(L(s, d).select("rid", F.col("weight").alias("value")), O(s, d).select(F.col("rid").alias("group_id"), F.when(F.col("rid") % 5 > 0, F.array("rid", F.floor(F.col("rid") / 2) + 1, "rid")).otherwise(F.array().cast("array<long>")).alias("places"))).select("group_id", joined(F.col("values")).alias("r")), "SELECT g AS group_id, coalesce(string_agg(CAST(w AS VARCHAR), ',' ORDER BY i), '') AS r FROM (SELECT rid AS g, unnest([1, 2, 3]) AS i, CASE WHEN rid % 5 > 0 THEN unnest([rid, rid // 2 + 1, rid]) END AS p FROM o) LEFT JOIN l ON l.rid = p GROUP BY 1", frames="ol")


def _top(pdf):
    return pdf.nlargest(2, ["weight", "rid"])[["space", "rid", "weight"]]


add("l33_apply", lambda s, d: groups.apply_in_parts(L(s, d).select("space", "rid", "weight"), ["space"], _top, "space long, rid long, weight long"), "SELECT space, rid, w AS weight FROM (SELECT *, row_number() OVER (PARTITION BY space ORDER BY w DESC, rid DESC) AS n FROM l) WHERE n <= 2", frames="l")
add("l33b_tapply", lambda s, d: groups.tapply(status(s, d), ["prio", "k"], n=F.count(F.lit(1)), top=F.max("rid")), "SELECT prio, k, count(*) AS n, max(rid) AS top FROM st GROUP BY 1, 2", frames="", more=ST)
add("l34_stack", lambda s, d: groups.stacked({"a": O(s, d), "b": L(s, d)}).groupBy("name").agg(F.count(F.lit(1)).alias("n"), F.sum("weight").alias("weight")), "SELECT 'a' AS name, count(*) AS n, NULL::BIGINT AS weight FROM o UNION ALL SELECT 'b', count(*), sum(w)::BIGINT FROM l", frames="ol")
add("l34b_bind", lambda s, d: groups.bound(O(s, d).select("rid", "start"), L(s, d).select("rid", "weight"), ["rid"]), "SELECT rid, o.s AS start, l.w AS weight FROM o JOIN l USING (rid)", frames="ol")
q("l35_concat", lambda: joined(F.concat("b", "w")), f"SELECT key, {text('list_concat(b, w)')} AS r FROM t", text=True)
q("i16_intersect_lists", lambda: joined(F.array_sort(X.each(X.set_intersect("v", "b"), lambda x: x.cast("string")))), "SELECT t.key, coalesce(string_agg(DISTINCT CAST(x AS VARCHAR), ',' ORDER BY CAST(x AS VARCHAR)), '') AS r FROM t LEFT JOIN lv ON lv.key = t.key AND list_contains(b, x) GROUP BY t.key", more=LONG, text=True)
q("j30_match_table", lambda: joined(X.match_table("v", F.array(F.lit(2), F.lit(1)).cast("array<bigint>"))), f"SELECT key, {text('list_transform(v, lambda x: CASE x WHEN 2 THEN 1 WHEN 1 THEN 2 END)')} AS r FROM t", text=True)

# ---- running values --------------------------------------------------------------------------------------------------


def lst(e):
    return joined(F.transform(e, lambda x: F.round(x * 1000).cast("long")))


def win(expr: str, keep: str, over: str = "ROWS BETWEEN CURRENT ROW AND 2 FOLLOWING") -> str:
    return f"SELECT key, string_agg(CAST(CAST(round(z * 1000) AS BIGINT) AS VARCHAR), ',' ORDER BY i) AS r FROM (SELECT key, i, {expr} AS z, count(*) OVER (PARTITION BY key ORDER BY i {over}) AS c FROM lv) WHERE {keep} GROUP BY key"


OVER = "OVER (PARTITION BY key ORDER BY i ROWS BETWEEN CURRENT ROW AND 2 FOLLOWING)"
q("w1_runsum", lambda: lst(X.running("v", 3, "sum")), win(f"sum(x) {OVER}", "c = 3"), more=LONG, text=True)
q("w2_runmean", lambda: lst(X.running("v", 3, "mean")), win(f"avg(x) {OVER}", "c = 3"), more=LONG, text=True)
q("w3_runwtsum", lambda: lst(X.running("v", 3, "wtsum", weights=[1, 2, 4])), win("x + 2 * lead(x, 1) OVER (PARTITION BY key ORDER BY i) + 4 * lead(x, 2) OVER (PARTITION BY key ORDER BY i)", "c = 3"), more=LONG, text=True)
q("w4_runq", lambda: lst(X.running(F.reverse("v"), 3, "q", nth=2)), win(f"median(x) {OVER}", "c = 3").replace("ORDER BY i) AS r", "ORDER BY i DESC) AS r"), more=LONG, text=True)
#: Running medians of five, medians of three next to the ends (d), and Tukey's rule for the ends themselves.
MEDIANS = """SELECT key, string_agg(CAST(CAST(round(r * 1000) AS BIGINT) AS VARCHAR), ',' ORDER BY i) AS r FROM (
  SELECT key, i, CASE WHEN n < 3 OR i NOT IN (1, n) THEN d ELSE x + g + (3 * g - 2 * h) - least(x, g, 3 * g - 2 * h) - greatest(x, g, 3 * g - 2 * h) END AS r FROM (
    SELECT *, CASE WHEN i = 1 THEN lead(d, 1) OVER u ELSE lag(d, 1) OVER u END AS g, CASE WHEN i = 1 THEN lead(d, 2) OVER u ELSE lag(d, 2) OVER u END AS h FROM (
      SELECT key, i, x, n, CASE WHEN i IN (1, n) THEN x WHEN i IN (2, n - 1) THEN median(x) OVER (u ROWS BETWEEN 1 PRECEDING AND 1 FOLLOWING) ELSE {inner} END AS d
      FROM (SELECT key, i, CAST(x * 7 % 13 AS DOUBLE) AS x, count(*) OVER (PARTITION BY key) AS n FROM lv) WINDOW u AS (PARTITION BY key ORDER BY i)
    ) WINDOW u AS (PARTITION BY key ORDER BY i))) GROUP BY key"""
q("w5_runmed", lambda: lst(X.running_median(F.transform("v", lambda x: x * 7 % 13), 5)), MEDIANS.format(inner="median(x) OVER (u ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING)"), more=LONG, text=True)
q("w6_smooth_ends", lambda: lst(X.smooth_ends(F.transform("v", lambda x: (x * 7 % 13).cast("double")), 5)), MEDIANS.format(inner="x"), more=LONG, text=True)
# The same over vectors in long form: the weights of a space's lines, one behind the other.
LINES = "x AS (SELECT space, w, row_number() OVER (PARTITION BY space ORDER BY rid) AS place FROM l)"
NEXT = "OVER (PARTITION BY space ORDER BY place ROWS BETWEEN CURRENT ROW AND {} FOLLOWING)"


def moved(name: str, k: int, how: str, expr: str, **more) -> None:
    over = NEXT.format(k - 1)
    add(name, lambda s, d: moving.moving(L(s, d), k, how, value="weight", **more), f"SELECT space, place, CAST({expr.format(over=over)} AS DOUBLE) AS result FROM x QUALIFY count(*) {over} = {k}", frames="l", more=LINES)


moved("w1b_moving_sum", 25, "sum", "sum(w) {over}")
moved("w2b_moving_mean", 25, "mean", "avg(w) {over}")
moved("w3b_moving_wtsum", 3, "wtsum", "w + 2 * lead(w, 1) OVER (PARTITION BY space ORDER BY place) + 4 * lead(w, 2) OVER (PARTITION BY space ORDER BY place)", weights=[1, 2, 4])
moved("w4b_moving_q", 9, "q", "list_sort(list(w) {over})[3]", nth=3)
MEDIAN_OF = """SELECT space, place, CASE WHEN place IN (1, n) THEN m1 + g + (3 * g - 2 * h) - least(m1, g, 3 * g - 2 * h) - greatest(m1, g, 3 * g - 2 * h) ELSE m1 END AS result FROM (
  SELECT *, CASE WHEN place = 1 THEN lead(m1, 1) OVER u ELSE lag(m1, 1) OVER u END AS g, CASE WHEN place = 1 THEN lead(m1, 2) OVER u ELSE lag(m1, 2) OVER u END AS h FROM (
    SELECT space, place, n, CASE WHEN place IN (1, n) THEN w::DOUBLE WHEN place IN (2, n - 1) THEN median(w) OVER (u ROWS BETWEEN 1 PRECEDING AND 1 FOLLOWING) ELSE median(w) OVER (u ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING) END AS m1
    FROM (SELECT *, count(*) OVER (PARTITION BY space) AS n FROM x) WINDOW u AS (PARTITION BY space ORDER BY place)) WINDOW u AS (PARTITION BY space ORDER BY place))"""
add("w5b_moving_median", lambda s, d: moving.moving_median(L(s, d), 5, value="weight"), MEDIAN_OF, frames="l", more=LINES)
RANKED = {"average": "rank() OVER u + (count(*) OVER (PARTITION BY space, w) - 1) / 2.0", "first": "row_number() OVER (PARTITION BY space ORDER BY w, rid)", "dense": "dense_rank() OVER u"}
for method, expr in RANKED.items():
    add(f"w9b_long_rank_{method}", lambda s, d, method=method: ranks.ranks(L(s, d), "weight", method=method).select("space", "rid", "rank"), f"SELECT space, rid, ({expr})::DOUBLE AS rank FROM l WINDOW u AS (PARTITION BY space ORDER BY w)", frames="l")
add("l14d_long_quantiles", lambda s, d: ranks.quantiles(L(s, d), "weight", [0.1, 0.5, 0.9]).select("space", "p", F.round("quantile", 6).alias("quantile")), " UNION ALL ".join(f"SELECT space, {p}::DOUBLE AS p, round(quantile_cont(w::DOUBLE, {p}), 6) AS quantile FROM l GROUP BY space" for p in (0.1, 0.5, 0.9)), frames="l")
add("l12g_long_kendall", lambda s, d: ranks.kendall(O(s, d).withColumn("width", F.col("end") - F.col("start")), "start", "width").select("space", F.round("tau", 9).alias("tau")), "SELECT a.space, round(sum(sign(a.s - b.s) * sign(a.e - a.s - b.e + b.s)) / sqrt(count(*) FILTER (a.s <> b.s) * count(*) FILTER (a.e - a.s <> b.e - b.s)::DOUBLE), 9) AS tau FROM o a JOIN o b ON a.space = b.space AND a.rid < b.rid GROUP BY 1")
UP = "OVER (PARTITION BY key ORDER BY i)"
q("w7_cumsum", lambda: lst(X.cumulate("v", "sum")), win(f"sum(x) {UP}", "true"), more=LONG, text=True)
q("w7b_cummax", lambda: lst(X.cumulate(X.each("v", lambda x: x * 7 % 13), "max")), win(f"max(x * 7 % 13) {UP}", "true"), more=LONG, text=True)
q("w7c_cumprod", lambda: lst(X.cumulate(X.each("v", lambda x: x % 2 * 2 - 1), "prod")), win(f"product(x % 2 * 2 - 1) {UP}", "true"), more=LONG, text=True)
q("w8_diff", lambda: joined(X.diff("v", 2)), win(f"(lead(x, 2) {UP} - x) / 1000.0", "c = 3"), more=LONG, text=True)
RANK = {"average": "(2 * rank() OVER (PARTITION BY key ORDER BY x) + count(*) OVER (PARTITION BY key, x) - 1) / 2.0", "min": "rank() OVER (PARTITION BY key ORDER BY x)", "max": "rank() OVER (PARTITION BY key ORDER BY x) + count(*) OVER (PARTITION BY key, x) - 1", "first": "row_number() OVER (PARTITION BY key ORDER BY x, i)"}
for how, expr in RANK.items():
    q(f"w9_rank_{how}", lambda how=how: lst(X.rank("v", how)), win(expr, "true"), more=LONG, text=True)
q("w10_order", lambda: joined(X.order(X.each("v", lambda x: x * 7 % 13))), "SELECT key, string_agg(CAST(i AS VARCHAR), ',' ORDER BY x * 7 % 13, i) AS r FROM lv GROUP BY key", more=LONG, text=True)
add("w11_group_ranks", lambda s, d: groups.dense_groups(status(s, d), "prio").select("rid", "representative", "group_rank"), "SELECT rid, m AS representative, (dense_rank() OVER (ORDER BY m))::BIGINT AS group_rank FROM (SELECT rid, min(rid) OVER (PARTITION BY prio) AS m FROM st)", frames="", more=ST)
add("w12_running_reach", lambda s, d: running(O(s, d), {"reach": ("max", F.col("end")), "total": ("sum", F.col("end") - F.col("start") + 1)}, "start", ["start", "end", "rid"], chunk=100).select("rid", "reach", "total"), "SELECT rid, max(e) OVER w AS reach, (sum(e - s + 1) OVER w)::BIGINT AS total FROM o WINDOW w AS (PARTITION BY space ORDER BY s, e, rid ROWS UNBOUNDED PRECEDING)")

# ---- orders and parts ------------------------------------------------------------------------------------------------

add("o1_order", lambda s, d: compare.ordered(O(s, d)).select("rid", "place", "rank"), "SELECT rid, row_number() OVER (PARTITION BY space ORDER BY s, e, rid) AS place, rank() OVER (PARTITION BY space ORDER BY s, e) AS rank FROM o")
add("o2_is_unsorted", lambda s, d: compare.unsorted(O(s, d)), "SELECT space, bool_or(bad) AS unsorted FROM (SELECT space, coalesce(s < lag(s) OVER w OR (s = lag(s) OVER w AND e < lag(e) OVER w), false) AS bad FROM o WINDOW w AS (PARTITION BY space ORDER BY rid)) GROUP BY space")
q("o2b_is_unsorted_lists", lambda: X.is_unsorted(X.each("v", lambda x: x * 7 % 13)), "SELECT key, coalesce(bool_or(x * 7 % 13 < p), false) AS r FROM (SELECT *, lag(x * 7 % 13) OVER (PARTITION BY key ORDER BY i) AS p FROM lv) GROUP BY key", more=LONG)
q("o3_heads", lambda: F.concat_ws("/", joined(X.heads("v", 2)), joined(X.heads("v", -7))), f"SELECT key, {text('v[1:2]')} || '/' || {text('v[1:greatest(len(v) - 7, 0)]')} AS r FROM t", text=True)
q("o3b_tails", lambda: F.concat_ws("/", joined(X.tails("v", 2)), joined(X.tails("v", -7))), f"SELECT key, {text('v[greatest(len(v) - 1, 1):len(v)]')} || '/' || {text('v[8:len(v)]')} AS r FROM t", text=True)
q("o4_windows", lambda: joined(X.windows("v", start=2, end=-2)), f"SELECT key, {text('v[2:len(v) - 1]')} AS r FROM t", text=True)
q("o5_reverse_elements", lambda: joined(X.reverse_if("v", F.col("key") % 2 == 0)), f"SELECT key, {text('CASE WHEN key % 2 = 0 THEN list_reverse(v) ELSE v END')} AS r FROM t", text=True)
add("o6_mapped_order", lambda s, d: groups.mapped_order(status(s, d).withColumn("map_order", -F.col("rid"))).select("rid", "place"), "SELECT rid, row_number() OVER (ORDER BY -rid) AS place FROM st", frames="", more=ST)

# ---- groupings -------------------------------------------------------------------------------------------------------


def counts(s, d):
    return T(s, d, "orders").groupBy((F.col("o_custkey") % 20 + 1).cast("long").alias("group_id")).agg(F.count(F.lit(1)).alias("width"))


CT = "ct AS (SELECT CAST(o_custkey % 20 + 1 AS BIGINT) AS group_id, count(*) AS width FROM orders GROUP BY 1), pt AS (SELECT *, (sum(width) OVER (ORDER BY group_id))::BIGINT AS z FROM ct)"
add("g1_partition_by_width", lambda s, d: groups.by_width(counts(s, d)), 'SELECT group_id, width, z - width + 1 AS start, z AS "end" FROM pt', frames="", more=CT)
add("g1b_partition_by_end", lambda s, d: groups.by_end(groups.by_width(counts(s, d)).select("group_id", "end")), 'SELECT group_id, z - width + 1 AS start, z AS "end" FROM pt', frames="", more=CT)
add("g1c_tabulate", lambda s, d: groups.tabulated(T(s, d, "orders").select((F.col("o_custkey") % 20 + 1).cast("long").alias("group_id")), 25), "SELECT g AS group_id, coalesce(width, 0) AS width FROM (SELECT unnest(generate_series(1, 25)) AS g) LEFT JOIN ct ON group_id = g", frames="", more=CT)
add("g2_group_lengths", lambda s, d: groups.lengths(O(s, d), "space"), "SELECT space, count(*) AS n FROM o GROUP BY 1")
add("g3_members", lambda s, d: groups.members(O(s, d), [1, 3], "space", "rid").select("space", digest(F.col("members")).alias("r")), "SELECT space, md5(string_agg(CAST(rid AS VARCHAR), ',' ORDER BY rid)) AS r FROM o WHERE space IN (1, 3) GROUP BY 1")
add("g4_to_group", lambda s, d: groups.with_group_length(O(s, d), "space").select("rid", "space", "group_length"), "SELECT rid, space, count(*) OVER (PARTITION BY space) AS group_length FROM o")
add("g5_high_to_low", lambda s, d: groups.high_to_low(status(s, d), "prio").select("rid", "low"), "SELECT rid, CASE WHEN m < rid THEN m END AS low FROM (SELECT rid, min(rid) OVER (PARTITION BY prio) AS m FROM st)", frames="", more=ST)
add("g5b_low_to_high", lambda s, d: groups.low_to_high(status(s, d), "prio").select("rid", digest(F.col("high")).alias("r")), "SELECT m AS rid, md5(string_agg(CAST(rid AS VARCHAR), ',' ORDER BY rid)) AS r FROM (SELECT rid, min(rid) OVER (PARTITION BY prio) AS m FROM st) WHERE m < rid GROUP BY m", frames="", more=ST)
add("g6_duplicated", lambda s, d: groups.high_to_low(status(s, d), "prio").select("rid", F.col("low").isNotNull().alias("duplicated")), "SELECT rid, rid > min(rid) OVER (PARTITION BY prio) AS duplicated FROM st", frames="", more=ST)
add("g7_crossed_groups", lambda s, d: groups.crossed(status(s, d), ["prio", "k"]).select("prio", "k", digest(F.col("members")).alias("r")), "SELECT a.prio, b.k, md5(coalesce(string_agg(CAST(rid AS VARCHAR), ',' ORDER BY rid), '')) AS r FROM (SELECT DISTINCT prio FROM st WHERE prio IS NOT NULL) a CROSS JOIN (SELECT DISTINCT k FROM st) b LEFT JOIN st ON st.prio = a.prio AND st.k = b.k GROUP BY 1, 2", frames="", more=ST)
add("g8_truncate", lambda s, d: groups.truncated(O(s, d).select("rid", "space"), 50), "SELECT rid, space FROM o WHERE rid <= 50")
add("g9_hits_by_query", lambda s, d: groups.hits_by_query(overlaps.find(C(s, d, FOLD), K(s, d, FOLD)), C(s, d, FOLD)).select("space", "query_id", joined(F.col("subjects")).alias("r")), "SELECT a.space, a.rid AS query_id, coalesce(string_agg(CAST(b.rid AS VARCHAR), ',' ORDER BY b.rid), '') AS r FROM a LEFT JOIN b ON a.space = b.space AND a.s <= b.e AND b.s <= a.e GROUP BY 1, 2", frames="ab")

# ---- streaming forms, run as batches ---------------------------------------------------------------------------------


def timed(s, d):
    return T(s, d, "events").select("user_id", F.col("ts").cast("timestamp").alias("ts"))


add("stream_sliding_windows", lambda s, d: stream.sliding(timed(s, d), "ts", "10 days", "5 days", late="1 day", n=F.count(F.lit(1))).select(F.unix_seconds("start").alias("start"), "n"), "SELECT CAST(b AS BIGINT) AS start, count(*) AS n FROM (SELECT unnest([floor(epoch(ts) / 432000) * 432000, floor(epoch(ts) / 432000) * 432000 - 432000]) AS b FROM events) GROUP BY 1", frames="")
add("stream_session_windows", lambda s, d: stream.merged(timed(s, d), "ts", "1 day", late="1 day", by=("user_id",), n=F.count(F.lit(1))).select("user_id", F.unix_seconds("start").alias("start"), "n"), "SELECT user_id, CAST(floor(epoch(min(ts))) AS BIGINT) AS start, count(*) AS n FROM (SELECT *, sum(f) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS g FROM (SELECT *, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) < INTERVAL 1 DAY THEN 0 ELSE 1 END AS f FROM events)) GROUP BY user_id, g", frames="")

QUERIES, ORACLES = R.queries, R.oracles
