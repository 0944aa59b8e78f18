"""Divergence audit, URL filters and ranked search against plain versions, with awkward rows."""

import math
import random
import re
from collections import Counter, defaultdict
from itertools import combinations

import numpy as np
import pyarrow as pa
import pytest
from corpus_helpers import words
from pyspark.sql import functions as F

from rangeloom.llm import divergence, search, urls
from rangeloom.llm.terms import LETTERS, LETTERS_AND_DIGITS, cut_terms

LETTER_RE = re.compile(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")
WORD_RE = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
UPPER = {i: i + 32 for i in range(65, 91)}

AWKWARD = ["", " ", "É ß 漢字 x9y ABC-abc\u0000z", "a" * 3_000_000, "A b " * 400_000, "\U0001f600ok\ud7ff"]


@pytest.mark.parametrize("text", AWKWARD)
@pytest.mark.parametrize("most", [1, 7, 1 << 20])
def test_terms(text, most):
    if most < 100:
        text = text[:2000]
    for table, regex in ((LETTERS, LETTER_RE), (LETTERS_AND_DIGITS, WORD_RE)):
        got = [t.decode() for some in cut_terms(text.encode(), table, most=most) for t in some]
        assert got == [t.translate(UPPER) for t in regex.findall(text)]


# ---- divergence ------------------------------------------------------------------------------------------------------


def plain_audit(rows, min_docs, top):
    docs = [(lang or "", source or "", [t.translate(UPPER) for t in LETTER_RE.findall(text or "")]) for text, lang, source in rows]
    groups, held = defaultdict(Counter), defaultdict(Counter)
    for lang, source, terms in docs:
        groups[lang, source].update(terms)
        held[lang].update(set(terms))
    out = []
    for lang in held:
        kept = sorted((t for t, n in held[lang].items() if n >= min_docs), key=str.encode)
        v = len(kept)
        share = lambda c: {t: 1 + 10**9 * (c[t] + 5) // (sum(c[k] for k in kept) + 5 * v) for t in kept}  # noqa: E731, B023
        whole = Counter()
        mine = {s: c for (x, s), c in groups.items() if x == lang}
        for c in mine.values():
            whole.update(c)
        q, p = share(whole), {s: share(c) for s, c in mine.items()}
        for s, c in mine.items():
            pairs = sorted(((-sum(abs(p[s][t] - p[o][t]) for t in kept), o.encode()) for o in mine if o != s))
            terms = sorted((q[t] - p[s][t], t.encode()) for t in kept if c[t] > 0 and p[s][t] > q[t])[:top]
            for part, found in (("pair", pairs), ("term", terms)):
                out += [(lang, s, part, item.decode(), -value, i + 1) for i, (value, item) in enumerate(found)]
    return Counter(out)


def audit_rows(rng):
    vocabulary = {x: [words(rng, 1) for _ in range(60)] for x in ("en", "de", None)}
    rows = []
    for i in range(400):
        lang = rng.choice(["en", "en", "de", None])
        source = rng.choice(["hot", "hot", "b", "ç", None, "Ünit"])
        rows.append((" ".join(rng.choice(vocabulary[lang][: 20 + 8 * len(source or "")]) for _ in range(rng.randint(0, 30))), lang, source))
    rows += [(None, "en", "hot"), ("", "en", "only empty"), ("one doc", "xx", "a"), ("another", "xx", "b"), ("x", "single", "s"), ("Zz " * 50_000 + "é漢", "en", "b")] + [("tie tie", "en", "hot")] * 9
    return rows


@pytest.mark.parametrize("how", [{}, {"width": 3, "block": 2, "hold": 10}])
def test_audit(spark, how):
    rows = audit_rows(random.Random(5))
    df = spark.createDataFrame([(*r, 1, "x") for r in rows], "text string, lang string, source string, Part int, `n.head` string").repartition(5)
    got = divergence.audit(df, min_docs=6, top=7, **how)
    assert got.columns == ["lang", "source", "part", "item", "value", "rank"]
    assert Counter(tuple(r) for r in got.collect()) == plain_audit(rows, 6, 7)


def test_a_pair_is_summed_over_arrays_in_whatever_order_its_sources_come(spark):
    """Without adaptive coalescing the rows of different arrays come in different orders."""
    rng = random.Random(14)
    rows = [(" ".join(rng.choice(["aa", "bb", "é", "dd", "cc", "ee"]) for _ in range(3)), "l", f"s{i % 140}") for i in range(1400)]
    df = spark.createDataFrame(rows, "text string, lang string, source string").repartition(5)
    changed = {"spark.sql.adaptive.enabled": "false", "spark.sql.autoBroadcastJoinThreshold": "-1"}
    before = {k: spark.conf.get(k) for k in changed}
    try:
        for k, v in changed.items():
            spark.conf.set(k, v)
        got = divergence.audit(df, min_docs=30, top=7, width=2).collect()
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    assert Counter(tuple(r) for r in got) == plain_audit(rows, 30, 7)


def test_a_pair_is_named_one_way():
    rows = [{"head": b"l", "source": s, "block": 0, "i": 0, "j": 0, "low": 0, "width": 2, "n_group": 3, "v": 2, "ids": [0], "counts": [n]} for s, n in (("ç", 1), ("a", 2), ("", 3))]
    kind = pa.schema([("head", pa.binary()), ("source", pa.string()), ("block", pa.int32()), ("i", pa.int32()), ("j", pa.int32()), ("low", pa.int32()), ("width", pa.int32()), ("n_group", pa.int64()), ("v", pa.int64()), ("ids", pa.list_(pa.int32())), ("counts", pa.list_(pa.int64()))])
    run = divergence._apart(10**9, 5)
    one, other = (sorted(run(pa.Table.from_pylist(x, kind)).to_pylist(), key=str) for x in (rows, rows[::-1]))
    assert one == other and len(one) == 3


def test_counts_of_terms_in_few_documents_are_not_stored(spark, monkeypatch):
    """Most terms are in few documents; their counts are not sorted and encoded with the others."""
    rows, seen, store = audit_rows(random.Random(8)), {}, divergence.stored

    def watched(df, name):
        seen[name] = store(df, name)
        return seen[name]

    monkeypatch.setattr(divergence, "stored", watched)
    df = spark.createDataFrame(rows, "text string, lang string, source string").repartition(5)
    got = divergence.audit(df, min_docs=30, top=7).collect()
    assert Counter(tuple(r) for r in got) == plain_audit(rows, 30, 7)
    docs, want = defaultdict(set), Counter()
    for i, (text, lang, _) in enumerate(rows):
        for t in LETTER_RE.findall(text or ""):
            docs[lang or "", t.translate(UPPER)].add(i)
    for text, lang, source in rows:
        for t in (t.translate(UPPER) for t in LETTER_RE.findall(text or "")):
            if len(docs[lang or "", t]) >= 30:
                want[divergence.lang_key(lang or "") + t.encode(), source or ""] += 1
    assert len(docs) > len({k for k, _ in want}) > 10
    assert {(bytes(r.key), r.source): r.tf for r in seen["term-counts"].collect()} == want


def test_audit_of_nothing(spark):
    df = spark.createDataFrame([("a b", "en", "s"), (None, None, None)], "text string, lang string, source string")
    assert divergence.audit(df.limit(0)).collect() == []
    assert divergence.audit(df).collect() == []  # no pairs, no kept terms


def test_many_sources_are_dealt_to_several_tasks(spark, monkeypatch):
    rng = random.Random(6)
    rows = [(words(rng, 6), "en", f"s{i % 2100}") for i in range(4200)]
    df = spark.createDataFrame(rows, "text string, lang string, source string")
    got = divergence.audit(df, min_docs=200, top=3).filter("part = 'term'").collect()
    want = {k for k in plain_terms(rows, 200, 3)}
    assert {tuple(r) for r in got} == want


def plain_terms(rows, min_docs, top):
    held, whole, groups = Counter(), Counter(), defaultdict(Counter)
    for text, _, s in rows:
        held.update(set(text.split())), whole.update(text.split()), groups[s].update(text.split())
    kept = sorted(t for t, n in held.items() if n >= min_docs)
    share = lambda c, n: {t: 1 + 10**9 * (c[t] + 5) // (n + 5 * len(kept)) for t in kept}
    q = share(whole, sum(whole[t] for t in kept))
    for s, c in groups.items():
        p = share(c, sum(c[t] for t in kept))
        found = sorted((q[t] - p[t], t) for t in kept if c[t] and p[t] > q[t])[:top]
        yield from (("en", s, "term", t, -value, i + 1) for i, (value, t) in enumerate(found))


def test_shares_are_exact():
    rng = random.Random(7)
    for _ in range(300):
        v, n = rng.randint(1, 10**6), rng.randint(0, 9 * 10**15 - 5 * 10**6)
        counts = np.array([0, n, rng.randint(0, n)], "i8")
        assert divergence.shares(counts, n, v, 10**9, 5).tolist() == [1 + 10**9 * (int(x) + 5) // (n + 5 * v) for x in counts]


# ---- URL filters -----------------------------------------------------------------------------------------------------


def plain_parts(url):
    at = (url or "").find("://")
    rest = url[at + 3 :] if at >= 0 else ""
    host = re.match(r"[^/?#]*", rest)[0]
    path = re.match(r"[^?#]*", rest[len(host) :])[0]
    query = re.match(r"\?([^#]*)", rest[len(host) + len(path) :])
    return host.translate(UPPER), path, query[1] if query else ""


def plain_rule(host, path):
    fits = [r for r in urls.RULES if (host == r.host or host.endswith("." + r.host)) and path.startswith(r.path)]
    return max(fits, key=lambda r: len(r.name), default=None)


def plain_tokens(url):
    host, path, query = plain_parts(url)
    found = {"h:" + x for x in host.split(".") if x} | {"p:" + re.sub("[0-9]+", "#", x.translate(UPPER)) for x in path.split("/") if x}
    return frozenset(found | {"q:" + re.match("[^=]*", x.translate(UPPER))[0] for x in query.split("&") if x})


def plain_judge(pages, labels=None, min_support=0.01, least=10, min_confidence=0.8):
    """Every combination of tokens counted."""
    parts = [plain_parts(u) for _, u in pages]
    ruled = [plain_rule(h, p) for h, p, _ in parts]
    told = labels or [r.verdict if r else None for r in ruled]
    labelled = [(plain_tokens(u), v) for (_, u), v in zip(pages, told, strict=True) if v and 0 < len(plain_tokens(u)) <= 16]
    n, all_, both = len(labelled), Counter(), Counter()
    for tokens, v in labelled:
        for k in range(1, len(tokens) + 1):
            for some in combinations(sorted(tokens), k):
                all_[some] += 1
                both[some, v] += 1
    needed = max(least, math.ceil(n * min_support))
    rules = {(s, v): (k / all_[s], k) for (s, v), k in both.items() if k >= needed and k / all_[s] >= min_confidence}
    kept = {(s, v): r for (s, v), r in rules.items() if not any((o, v) in rules and rules[o, v][0] >= r[0] for o in combinations(s, len(s) - 1))}
    out = []
    for (page, url), (host, path, _), rule in zip(pages, parts, ruled, strict=True):
        mine = plain_tokens(url)
        fit = [(c, k, len(s), v == "allow", s, v) for (s, v), (c, k) in kept.items() if mine.issuperset(s)]
        verdict = rule.verdict if rule else max(fit)[-1] if fit else "allow"
        out.append((page, host, path, rule.name if rule else None, verdict))
    return Counter(out), len(kept)


def url_rows(rng):
    hosts = ["a.example.org", "EXAMPLE.org", "www.shop.com", "bets.com", "bets.net", "x.net", "notexample.org", "org", "com", "example.org.net", "user@a.org:80"]
    paths = ["/es/1", "/en/17", "/en/2", "/de/5.html", "/fr/9", "/fr", "", "/", "?q=/es/", "/es?x=1&y=2#/t", "#f", "/En/1", "/a//b/"]
    found = [(i, f"{rng.choice(['http', 'https'])}://{rng.choice(hosts)}{rng.choice(paths)}") for i in range(500)]
    odd = [None, "", "no scheme/org/", "://", "http://", "a://b://c/d", "http://é.org/es/", "http://x.org/\nes/", "http://deep.net/" + "/".join(f"d{i}x" for i in range(3000)), "http://x.com/de/" + "y" * 300_000]
    return found + [(1000 + i, u) for i, u in enumerate(odd)] + [(1, "http://bets.net/de/4")] * 3 + [(None, "http://bets.net/de/4")]


def test_urls(spark):
    pages = url_rows(random.Random(8))
    df = spark.createDataFrame([(*p, "h", 1) for p in pages], "page_id long, url string, host string, `rule.x` int")
    got = urls.judge(df)
    want, rules = plain_judge(pages)
    assert rules > 3
    assert Counter((r.id, r.host, r.path, r.rule, r.verdict) for r in got.collect()) == want
    assert {r.by for r in got.collect()} == {"list", "mined", "default"}
    assert urls.judge(df.limit(0)).collect() == []


def test_own_labels(spark):
    rng = random.Random(9)
    pages = url_rows(rng)
    labels = [None if not u or rng.random() < 0.3 else "block" if "bets" in u else "allow" for _, u in pages]
    df = spark.createDataFrame([(*p, v) for p, v in zip(pages, labels, strict=True)], "page_id long, url string, label string")
    got = urls.judge(df, label_col="label", min_support=0.02, min_confidence=0.9)
    want, _ = plain_judge(pages, labels, 0.02, 10, 0.9)
    assert Counter((r.id, r.host, r.path, r.rule, r.verdict) for r in got.collect()) == want
    blocked = [r for r in got.collect() if r.by == "mined" and r.verdict == "block"]
    assert blocked and all("bets" in r.host for r in blocked)


def test_long_urls_are_learnt_from(spark):
    """Labelled URLs of more than ``fit_tokens`` tokens, which share paths of many depths."""
    rng = random.Random(15)
    pages, depths = [], {"block": Counter(), "allow": Counter()}
    for i in range(400):
        verdict, depth = ("block", rng.randint(1, 40)) if rng.random() < 0.7 else ("allow", min(rng.randint(1, 40), rng.randint(1, 40)))
        depths[verdict][depth] += 1
        pages.append((i, f"http://x{i}.com/{'de' if verdict == 'block' else 'fr'}/" + "/".join(f"s{chr(97 + d // 26)}{chr(97 + d % 26)}" for d in range(depth))))
    n = lambda verdict, d: sum(k for depth, k in depths[verdict].items() if depth >= d)
    want = {}
    for d in range(1, 41):  # its first d parts: of the rules that fit the surest decides, and each part's rule is as sure as any with it as deepest
        fit = [(n(v, x) / (n("block", x) + n("allow", x)), n(v, x), v) for x in range(1, d + 1) for v in depths if n(v, x) >= 10]
        fit = [f for f in fit if f[0] >= 0.8]
        want[1000 + d] = max(fit)[2] if fit else "allow"
        pages.append((1000 + d, "http://y.net/" + "/".join(f"s{chr(97 + x // 26)}{chr(97 + x % 26)}" for x in range(d))))
    assert set(want.values()) == {"allow", "block"}
    df = spark.createDataFrame(pages, "page_id long, url string")
    assert {r.id: r.verdict for r in urls.judge(df).collect() if r.id >= 1000} == want


@pytest.mark.parametrize("fit_tokens", [1, 16])
def test_grown_combinations_are_those_of_fp_growth(spark, fit_tokens):
    rng = random.Random(16)
    pages, labels = [], []
    for i in range(400):
        some = [x for x in "abcdefghij" if rng.random() < 0.45]
        pages.append((i, "http://" + ".".join(some[:2]) + "/" + "/".join(some[2:])))
        labels.append(None if i % 4 == 0 else "block" if ("a" in some) != ("c" in some and "e" in some) or rng.random() < 0.1 else "allow")
    df = spark.createDataFrame([(*p, v) for p, v in zip(pages, labels, strict=True)], "page_id long, url string, label string")
    got = urls.judge(df, label_col="label", min_support=0.02, min_confidence=0.7, fit_tokens=fit_tokens)
    want, rules = plain_judge(pages, labels, 0.02, 10, 0.7)
    assert rules > 20
    assert Counter((r.id, r.host, r.path, r.rule, r.verdict) for r in got.collect()) == want
    told = df.select(urls.tokens(F.col("url")).alias("tokens"), F.col("label").alias("verdict"))
    mined = urls.mine(told, min_support=0.02, min_confidence=0.7, fit_tokens=fit_tokens)
    assert mined.count() == rules and mined.filter("size(items) > 2").count() > 0


def test_index_of_any_size(spark):
    pages = url_rows(random.Random(10))
    df = spark.createDataFrame(pages, "page_id long, url string")
    told = df.select("url", urls.listed(urls.host_of(F.col("url")), urls.path_of(F.col("url"))).alias("r"))
    rules = urls.mine(told.select(urls.tokens(F.col("url")).alias("tokens"), F.col("r.verdict").alias("verdict")))
    small, large = (Counter(tuple(map(str, r)) for r in urls.match(df, rules, most=most).collect()) for most in (100_000, 0))
    assert small == large and small


# ---- search ----------------------------------------------------------------------------------------------------------


def plain_search(rows, items, top):
    docs = [(i, [t.translate(UPPER) for t in WORD_RE.findall(text or "")]) for i, text in rows]
    docs = [(i, Counter(t), len(t)) for i, t in docs if t]
    n, total = len(docs), sum(k for _, _, k in docs)
    df = Counter(t for _, c, _ in docs for t in c)
    out = []
    for item, text in items:
        terms = {t.translate(UPPER) for t in WORD_RE.findall(text or "")}
        weight = {t: math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) for t in terms}
        scored = []
        for i, c, k in docs:
            m = 100 - 50 + (50 * k * n) // total
            score = sum(weight[t] * ((10**9 * c[t]) // (1000 * c[t] + 20 * m)) for t in terms if c[t])
            if score > 0:
                scored.append((-score, i is not None, i or 0, i))
        out += [(item, r + 1, i, -s) for r, (s, _, _, i) in enumerate(sorted(scored)[:top])]
    return out


@pytest.mark.parametrize("shard_docs, pass_chars", [(4096, 4 << 20), (7, 40)])
def test_search(spark, shard_docs, pass_chars):
    rng = random.Random(11)
    rows = [(i, words(rng, rng.randint(1, 60))) for i in range(500)]
    rows += [(600 + i, rows[3][1]) for i in range(90)]  # copies: equal scores beyond the heap
    rows += [(None, rows[3][1]), (1, None), (2, ""), (3, "--"), (7, rows[7][1]), (7, rows[7][1]), (900, " ".join([rows[5][1]] * 3000)), (901, "É 漢字 42 x")]
    items = [(i, words(rng, 12)) for i in range(12)] + [(20, rows[3][1]), (20, rows[3][1]), (21, None), (22, "zzzz yyyy"), (23, "é 漢字 É 42 X"), (24, rows[5][1].upper()), (None, "ta ro")]
    df = spark.createDataFrame([(*r, "e", 0) for r in rows], "doc_id long, text string, item string, `score` int").repartition(6)
    asked = spark.createDataFrame([(*r, 1) for r in items], "item_id long, text string, rank int")
    got = search.search(df, asked, top=20, shard_docs=shard_docs, pass_chars=pass_chars)
    assert got.columns == ["item", "rank", "id", "score"]
    assert Counter(tuple(r) for r in got.collect()) == Counter(plain_search(rows, items, 20))


def test_search_of_nothing(spark):
    docs, items = spark.createDataFrame([(1, "a b")], "doc_id long, text string"), spark.createDataFrame([(1, "a")], "item_id long, text string")
    assert search.search(docs.limit(0), items).collect() == []
    assert search.search(docs, items.limit(0)).collect() == []
    assert [tuple(r) for r in search.search(docs.withColumn("doc_id", F.lit("né")), items).collect()] == [(1, 1, "né", 287 * (10**9 // (1000 + 20 * 100)))]


def test_long_documents_need_no_more_than_64_bits():
    lengths = np.array([1, 10**7], "i8")
    assert search.lengthiness(lengths, 10**11, 10**14, 50, 50).tolist() == [50 + 50 * 10**11 // 10**14, 50 + 50 * 10**7 * 10**11 // 10**14]


def test_pivots_skip(monkeypatch):
    """With a heap that is hard to enter, documents with weak terms only are not scored, and nothing is lost."""
    rng = random.Random(12)
    lengths = np.array([rng.randint(5, 50) for _ in range(300)], "i8")
    posted = sorted({(rng.choice([0, 0, 0, 1, 2, 3]), rng.randrange(300)) for _ in range(400)})
    terms, sizes = np.unique([t for t, _ in posted], return_counts=True)
    docs, tfs = np.array([d for _, d in posted], "i4"), np.array([rng.randint(1, 4) for _ in posted], "i4")
    weights = np.array([5, 900, 1500, 2500], "i8")
    shard = search.Shard(terms, sizes, docs, tfs, search.lengthiness(lengths, 300, int(lengths.sum()), 50, 50), weights)
    whole = Counter()
    for t, (own, impact) in shard.lists.items():
        for d, x in zip(own, impact, strict=True):
            whole[int(d)] += int(x)
    for enough in (1, 100_000, 1_000_000, max(whole.values()), max(whole.values()) + 1):
        found, scores = shard.best([0, 1, 2, 3], enough, 5)
        best = sorted((s for s in whole.values() if s >= enough), reverse=True)
        least = best[4] if len(best) > 4 else enough
        assert Counter(dict(zip(found.tolist(), scores.tolist(), strict=True))) == Counter({d: s for d, s in whole.items() if s >= least})
