"""The corpus operators as queries over the test tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import decontam, divergence, html, lines, mixing, ngram, quality, search, sharding, tokens, urls, vectors, warc


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = mixing.mix_report(table(spark, sf_dir, "documents"), weights=(5, 2, 1), max_repeats=3)
    return out.select(F.col("id").alias("doc_id"), "size", "source_size", F.round("target", 6).alias("target"), "taken")


def op2_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = quality.fit(docs, table(spark, sf_dir, "labels"))
    out = quality.score(docs, model, keep=["doc_id"])
    return out.select("doc_id", quality.held_out("doc_id").alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op3_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = vectors.near_duplicates(table(spark, sf_dir, "embeddings"), threshold=0.93)
    return out.select(F.col("id").alias("vec_id"), "n_links", "component_id", F.col("id").eqNullSafe(F.col("component_id")).alias("kept"))


def op4_shard(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = sharding.place(table(spark, sf_dir, "documents"), shards=16)
    return out.select(F.col("id").alias("doc_id"), "size", "text_crc32", F.lit(sharding.LAW).alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op5_token_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    docs = table(spark, sf_dir, "documents")
    return tokens.write_and_read(docs, vocabulary=public_tokenizers.path("word_bpe_49k.json"), end_id=2).withColumnRenamed("id", "doc_id")


def op6_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = html.extract(table(spark, sf_dir, "pages"))
    return out.select(F.col("id").alias("page_id"), "url", "text", F.length("text").cast("long").alias("n_chars"))


def op7_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.archive_report(table(spark, sf_dir, "pages"), min_bytes=0).withColumnRenamed("id", "page_id")


def op8_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = decontam.find_leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), rate=0.1)
    return out.select(F.col("id").alias("doc_id"), F.col("item").alias("item_id"), "distance", "item_chars")


def op9_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = lines.dedup_lines(table(spark, sf_dir, "documents"), min_docs=10, min_chars=1)
    return out.select(F.col("id").alias("doc_id"), "n_lines", "n_dropped", F.sha2("kept", 256).alias("kept_sha256"))


def op10_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = ngram.join(table(spark, sf_dir, "documents"), words=5, threshold=0.8)
    return out.select(F.col("id").alias("doc_id"), "class_id", "n_links", F.col("id").eqNullSafe(F.col("class_id")).alias("kept"))


def op11_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.audit(table(spark, sf_dir, "documents"), min_docs=30, top=50)


def op12_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = urls.judge(table(spark, sf_dir, "pages"), min_support=0.01, min_confidence=0.8)
    return out.select(F.col("id").alias("page_id"), "host", "path", "rule", "verdict")


def op13_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = search.search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), top=50)
    return out.select(F.col("item").alias("item_id"), "rank", F.col("id").alias("doc_id"), "score")


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


def queries() -> dict:
    return {k: f for k, f in globals().items() if k.startswith("op") and callable(f)} | {"pipeline": pipeline}


#: Sizes, sources and targets as plain SQL; thresholds by a running sum over the sorted hashes.
MIX_SQL = r"""
WITH d AS (
  SELECT doc_id, CASE WHEN source IS NULL THEN 'n' ELSE 's' || source END AS k,
         len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size,
         ('0x' || substr(md5(coalesce(doc_id::VARCHAR, '') || ':' || md5(coalesce(text, ''))), 1, 11))::BIGINT >> 2 AS p
  FROM documents),
s AS (SELECT k, sum(size)::BIGINT AS source_size FROM d GROUP BY k),
w AS (SELECT *, [5.0, 2.0, 1.0][1 + (row_number() OVER (ORDER BY k = 'n', k) - 1) % 3]::DOUBLE AS w, 3.0 * source_size AS lim,
             (SELECT sum(size) FROM d)::DOUBLE AS t FROM s),
-- the level: where the shares, cut at the limits, add up to everything
x AS (SELECT a.k, (any_value(a.t) - coalesce(sum(b.lim) FILTER (b.lim / b.w < a.lim / a.w), 0))
                  / sum(b.w) FILTER (b.lim / b.w >= a.lim / a.w) AS level, any_value(a.lim / a.w) AS ratio
      FROM w a, w b GROUP BY a.k),
t AS (SELECT k, source_size, least(lim, w * (SELECT max(level) FROM x WHERE ratio > level))::DOUBLE AS target FROM w),
r AS (SELECT *, CASE WHEN source_size > 0 THEN floor(target / source_size) ELSE 0 END::BIGINT AS repeats FROM t),
h AS (SELECT k, p, sum(size) AS n FROM d GROUP BY k, p),
c AS (SELECT k, p, n, sum(n) OVER (PARTITION BY k ORDER BY p) - n AS before FROM h)
SELECT d.doc_id, d.size, r.source_size, round(r.target, 6) AS target,
       (d.size * (r.repeats + CASE WHEN r.target - r.repeats * r.source_size > c.before + c.n / 2 THEN 1 ELSE 0 END))::BIGINT AS taken
FROM d JOIN r USING (k) JOIN c ON c.k = d.k AND c.p = d.p
"""


#: Lines counted and put together again in SQL.
LINES_SQL = r"""
WITH d AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents),
l AS (SELECT doc_id, unnest(ls) AS line, generate_subscripts(ls, 1) AS i FROM d),
k AS (SELECT *, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
                          'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM l),
c AS (SELECT key FROM k WHERE key <> '' GROUP BY key HAVING count(DISTINCT doc_id) >= 10)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (key IN (FROM c)) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (key NOT IN (FROM c)), '')) AS kept_sha256
FROM k GROUP BY doc_id
"""


#: All pairs, and the least id reachable by links.
VECTORS_SQL = """
WITH RECURSIVE v AS (SELECT vec_id, label, embedding::DOUBLE[] AS e FROM embeddings),
n AS (SELECT *, sqrt(list_sum(list_transform(e, lambda x: x * x))) AS l FROM v),
p AS (SELECT a.vec_id AS a, b.vec_id AS b FROM n a JOIN n b ON a.label = b.label AND a.vec_id <> b.vec_id
      WHERE list_dot_product(a.e, b.e) / (a.l * b.l) >= 0.93),
r AS (SELECT vec_id AS a, vec_id AS b FROM v UNION SELECT r.a, p.b FROM r JOIN p ON p.a = r.b),
m AS (SELECT a AS vec_id, min(b) AS component_id FROM r GROUP BY a),
k AS (SELECT a AS vec_id, count(*) AS n_links FROM p GROUP BY a)
SELECT vec_id, coalesce(n_links, 0)::BIGINT AS n_links, component_id, vec_id = component_id AS kept
FROM m LEFT JOIN k USING (vec_id)
"""


#: Digests of the payloads in base32, five hexadecimal digits at a time.
WARC_SQL = """
WITH p AS (SELECT page_id, strlen(coalesce(html, ''))::BIGINT AS payload_bytes, sha1(coalesce(html, '')) AS x FROM pages),
f AS (SELECT *, min(page_id) OVER (PARTITION BY x) AS first FROM p)
SELECT page_id, payload_bytes,
       array_to_string(list_transform(generate_series(0, 7), lambda i: array_to_string(list_transform([15, 10, 5, 0], lambda s:
         substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', (((('0x' || substr(x, (5 * i + 1)::INT, 5))::INT >> s) & 31) + 1)::INT, 1)), '')), '') AS payload_digest,
       CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id <> first THEN first END AS refers_to
FROM f
"""


#: All pairs of texts that share a run, and the least id reachable by links.
RUNS_SQL = r"""
WITH RECURSIVE d AS MATERIALIZED (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
n AS MATERIALIZED (SELECT w, min(doc_id) AS node, count(*) AS copies FROM d WHERE len(w) > 0 GROUP BY w),
g AS MATERIALIZED (SELECT node, unnest(list_distinct(list_transform(generate_series(1, greatest(len(w) - 4, 1)), lambda i: array_to_string(w[i:i + 4], ' ')))) AS run FROM n),
z AS (SELECT node, count(*) AS n FROM g GROUP BY node),
s AS (SELECT x.node AS a, y.node AS b, count(*) AS c FROM g x JOIN g y ON x.run = y.run AND x.node < y.node GROUP BY ALL),
o AS MATERIALIZED (SELECT a, b FROM s JOIN z x ON x.node = a JOIN z y ON y.node = b WHERE 5 * c >= 4 * (x.n + y.n - c)),
p AS MATERIALIZED (SELECT a, b FROM o UNION ALL SELECT b, a FROM o),
r AS (SELECT node AS a, node AS b FROM n UNION SELECT r.a, p.b FROM r JOIN p ON p.a = r.b),
m AS (SELECT a AS node, min(b) AS class_id FROM r GROUP BY a),
k AS (SELECT p.a AS node, sum(n.copies) AS links FROM p JOIN n ON n.node = p.b GROUP BY p.a)
SELECT doc_id, coalesce(class_id, doc_id) AS class_id, (coalesce(links, 0) + coalesce(copies - 1, 0))::BIGINT AS n_links, doc_id = coalesce(class_id, doc_id) AS kept
FROM d LEFT JOIN n USING (w) LEFT JOIN m USING (node) LEFT JOIN k USING (node)
"""


#: Counts by term in numbers of any size.
DIVERGENCE_SQL = r"""
WITH d AS (SELECT coalesce(lang, '') AS lang, coalesce(source, '') AS source,
                  regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS w FROM documents),
g AS (SELECT DISTINCT lang, source FROM d),
k AS (SELECT lang, term FROM (SELECT lang, unnest(list_distinct(w)) AS term FROM d) GROUP BY ALL HAVING count(*) >= 30),
o AS (SELECT lang, source, term, count(*) AS c FROM (SELECT lang, source, unnest(w) AS term FROM d) SEMI JOIN k USING (lang, term) GROUP BY ALL),
v AS (SELECT lang, count(*) AS v FROM k GROUP BY lang),
f AS (SELECT lang, source, term, coalesce(c, 0) AS c, sum(coalesce(c, 0)) OVER (PARTITION BY lang, source) AS n FROM g JOIN k USING (lang) LEFT JOIN o USING (lang, source, term)),
t AS (SELECT lang, term, sum(c) AS c FROM f GROUP BY ALL),
l AS (SELECT lang, term, c, sum(c) OVER (PARTITION BY lang) AS n FROM t),
p AS (SELECT lang, source, term, c, (1 + (1000000000::HUGEINT * (c + 5)) // (n + 5 * v))::BIGINT AS p FROM f JOIN v USING (lang)),
q AS (SELECT lang, term, (1 + (1000000000::HUGEINT * (c + 5)) // (n + 5 * v))::BIGINT AS q FROM l JOIN v USING (lang)),
s AS (SELECT a.lang, a.source, b.source AS item, sum(abs(a.p - b.p)) AS value FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
r AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(s.value, 0) AS value
      FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source LEFT JOIN s ON s.lang = a.lang AND s.source = a.source AND s.item = b.source
      UNION ALL SELECT lang, source, 'term', term, p - q FROM p JOIN q USING (lang, term) WHERE c > 0 AND p > q)
SELECT lang, source, part, item, value::BIGINT AS value, (row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item))::INT AS rank
FROM r QUALIFY part = 'pair' OR rank <= 50
"""


#: All combinations of a labelled URL's tokens, counted.
URLS_SQL = r"""
WITH u AS (SELECT page_id, url, CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) END AS rest FROM pages),
h AS (SELECT *, coalesce(translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '') AS host,
             coalesce(regexp_extract(rest, '^[^/?#]*([^?#]*)', 1), '') AS path, coalesce(regexp_extract(rest, '^[^?#]*\?([^#]*)', 1), '') AS query FROM u),
list AS (FROM (VALUES ('allow', 'org', '/'), ('block', 'example.org', '/es/'), ('block', 'example.org', '/en/1'), ('allow', 'com', '/fr/'), ('block', 'com', '/de/')) x(verdict, host, path)),
m AS (SELECT h.*, arg_max({'n': x.host || x.path, 'v': x.verdict}, length(x.host || x.path) * 1000 + length(x.host)) AS r
      FROM h LEFT JOIN list x ON (h.host = x.host OR ends_with(h.host, '.' || x.host)) AND starts_with(h.path, x.path) GROUP BY ALL),
t AS MATERIALIZED (SELECT page_id, host, path, r, list_sort(list_distinct(
        list_transform(list_filter(string_split(host, '.'), lambda x: x <> ''), lambda x: 'h:' || x)
        || list_transform(list_filter(string_split(path, '/'), lambda x: x <> ''), lambda x: 'p:' || regexp_replace(translate(x, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[0-9]+', '#', 'g'))
        || list_transform(list_filter(string_split(query, '&'), lambda x: x <> ''), lambda x: 'q:' || regexp_extract(translate(x, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '^[^=]*')))) AS tokens FROM m),
a AS MATERIALIZED (SELECT tokens, r.v AS verdict FROM t WHERE r IS NOT NULL AND len(tokens) BETWEEN 1 AND 16),
b AS (SELECT verdict, list_filter(tokens, lambda x, i: (k >> (i - 1)) & 1 = 1) AS items FROM (SELECT *, unnest(range(1, 1 << len(tokens))) AS k FROM a)),
n AS (SELECT items, count(*) AS n, count(*) FILTER (verdict = 'allow') AS ok FROM b GROUP BY items),
s AS (SELECT items, 'allow' AS verdict, ok AS support, ok / n AS confidence FROM n UNION ALL SELECT items, 'block', n - ok, (n - ok) / n FROM n),
f AS MATERIALIZED (FROM s WHERE confidence >= 0.8::DOUBLE AND support >= greatest(10, (SELECT ceil(count(*) * 0.01::DOUBLE) FROM a))),
z AS MATERIALIZED (FROM f WHERE NOT EXISTS (FROM f o WHERE o.verdict = f.verdict AND len(o.items) = len(f.items) - 1 AND o.confidence >= f.confidence AND list_has_all(f.items, o.items))),
y AS (SELECT page_id, host, path, arg_max(z.verdict, {'c': z.confidence, 's': z.support, 'n': len(z.items), 'a': z.verdict = 'allow', 'i': z.items}) AS v
      FROM t JOIN z ON r IS NULL AND list_has_all(t.tokens, z.items) GROUP BY ALL)
SELECT t.page_id, t.host, t.path, r.n AS rule, coalesce(r.v, y.v, 'allow') AS verdict FROM t LEFT JOIN y USING (page_id)
"""


#: Every document that shares a term is scored.
SEARCH_SQL = r"""
WITH d AS MATERIALIZED (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS w FROM documents),
c AS (SELECT count(*)::BIGINT AS nn, sum(len(w))::BIGINT AS ll FROM d WHERE len(w) > 0),
i AS (SELECT item_id, unnest(list_distinct(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+'))) AS term FROM benchmark),
p AS (SELECT doc_id, len(w)::BIGINT AS n, unnest(w) AS term FROM d),
q AS (SELECT doc_id, n, term, count(*)::BIGINT AS tf FROM p SEMI JOIN i USING (term) GROUP BY ALL),
w AS (SELECT term, floor(1000 * ln(((2 * nn + 2)::DOUBLE) / ((2 * count(*) + 1)::DOUBLE)))::BIGINT AS w FROM q, c GROUP BY term, nn),
s AS (SELECT item_id, doc_id, sum(w * ((1000000000 * tf) // (1000 * tf + 20 * (50 + (50 * n * nn) // ll))))::BIGINT AS score FROM i JOIN q USING (term) JOIN w USING (term), c GROUP BY ALL)
SELECT item_id, (row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id))::INT AS rank, doc_id, score FROM s WHERE score > 0 QUALIFY rank <= 50
"""


def oracle_sql() -> dict[str, str]:
    return {"op11_source_divergence": DIVERGENCE_SQL, "op12_url_filter": URLS_SQL, "op13_search": SEARCH_SQL, "op1_mix_sources": MIX_SQL, "op3_embedding_dedup": VECTORS_SQL, "op7_warc": WARC_SQL, "op9_line_dedup": LINES_SQL, "op10_ngram_join": RUNS_SQL}
