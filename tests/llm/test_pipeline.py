"""The pipeline's stages one after the other on a small corpus, each against a plain version of what it decides."""

import random
from collections import Counter, defaultdict

import pytest
from corpus_helpers import awkward, documents, row, words
from pyspark.sql import functions as F

import corpus_pipeline
from rangeloom.llm import decontam, quality
from rangeloom.llm.common import WORD_RE


def runs_of(text):
    w = WORD_RE.findall(text or "")
    return frozenset(tuple(w[i : i + 5]) for i in range(len(w) - 4)) if len(w) >= 5 else frozenset({tuple(w)} - {()})


def alike(a, b):
    return bool(a) and bool(b) and len(a & b) >= 0.8 * len(a | b)


@pytest.fixture(scope="module")
def corpus(spark, tmp_path_factory):
    rng = random.Random(41)
    good = lambda n: ". ".join(words(rng, 9).capitalize() for _ in range(n))
    bad = lambda n: " | ".join(words(rng, 1).upper() + "!!" for _ in range(n * 9))
    items = [words(rng, 25) for _ in range(4)]
    rows = awkward(rng) + [row(100 + i, good(8), "abc"[i % 3]) for i in range(240)] + [row(1000 + i, bad(8), "a") for i in range(160)]
    rows += [row(2000 + i, rows[20 + i % 9][1], "b") for i in range(30)]  # exact copies
    near = good(14).split()
    rows += [row(3000 + i, " ".join(near[:i] + ["edited"] + near[i + 1 :]), None) for i in range(12)]
    rows += [row(4000 + i, good(4) + " " + items[i % 4] + " " + good(4), "c") for i in range(12)]
    folder = tmp_path_factory.mktemp("sf")
    more = [(*r, i, "x", (1, "y"), "z", None) for i, r in enumerate(rows)]
    docs = spark.createDataFrame(more, "doc_id long, text string, lang string, source string, n_chars long, Shard int, score string, `meta.lang` struct<`a b`:int,`c.d`:string>, `x-y` string, `n chars` int")
    docs.write.parquet(str(folder / "documents.parquet"))
    spark.createDataFrame([(100 + i, 1, 0) for i in range(0, 240, 2)] + [(1000 + i, 0, 1) for i in range(0, 160, 2)] + [(None, 1, None), (7, None, None)], "doc_id long, quality int, toxic int").write.parquet(str(folder / "labels.parquet"))
    spark.createDataFrame([(i, t) for i, t in enumerate(items)] + [(9, None), (10, ""), (11, "the")], "item_id long, text string").write.parquet(str(folder / "benchmark.parquet"))
    return str(folder), docs.columns, items


def test_stages(spark, corpus):
    folder, columns, items = corpus
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    before = docs.collect()
    kept = {}
    for name, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, folder)
        path = f"{folder}/out-{name.replace(' ', '-')}"
        docs.write.parquet(path)
        docs = spark.read.parquet(path)
        kept[name] = docs.collect()
        if name != "sharding":
            assert docs.columns == columns
    # quality: what the model says of each whole text
    model = quality.fit(spark.read.parquet(f"{folder}/documents.parquet"), spark.read.parquet(f"{folder}/labels.parquet"))
    key = lambda r: (r.doc_id, r.text, r.source)
    want = Counter(key(r) for r in before if quality.score_text((r.text or "").encode(), model) >= 0.5)
    first = kept["quality classifier"]
    assert Counter(map(key, first)) == want
    assert sum(1000 <= (r.doc_id or 0) < 2000 for r in first) <= 3 and sum(100 <= (r.doc_id or 0) < 340 for r in first) >= 235
    # near copies: one of each group, that with the least id; texts without words all stay
    sets = [runs_of(r.text) for r in first]
    group = list(range(len(first)))
    changed = True
    while changed:
        changed = False
        for i in range(len(first)):
            for j in range(i):
                if group[i] != group[j] and (sets[i] == sets[j] and sets[i] or alike(sets[i], sets[j])):
                    low = min(group[i], group[j])
                    group[i] = group[j] = low
                    changed = True
    members = defaultdict(list)
    for i, g in enumerate(group):
        members[g].append(i)
    ids = Counter()
    for m in members.values():
        if sets[m[0]]:
            known = [first[i].doc_id for i in m if first[i].doc_id is not None]
            ids[min(known) if known else None] += 1
        else:
            ids.update(first[i].doc_id for i in m)
    second = kept["n-gram Jaccard join"]
    assert Counter(r.doc_id for r in second) == ids
    # leaks: no item within a tenth of edits
    third = kept["benchmark decontamination"]

    def leaks(text):
        matcher = decontam.Matcher([(i, decontam.normal(t)) for i, t in enumerate(items)], 0.1)
        return bool(matcher.find(decontam.normal(text or "")))

    assert Counter(map(key, third)) == Counter(key(r) for r in second if not leaks(r.text))
    assert not any((r.doc_id or 0) >= 4000 for r in third) and sum(len(t) > 40 for t in items) == 4
    # the mix: copies of documents, none more than three times, words near each source's target
    fourth = kept["mixing sources"]
    times = Counter(map(key, fourth))
    assert set(times) <= set(map(key, third))
    size = lambda r: len(WORD_RE.findall(r.text or ""))
    plain, mixed = Counter(), Counter()
    for r in third:
        plain[r.source] += size(r)
        assert times[key(r)] <= 3 * sum(key(x) == key(r) for x in third)
    for r in fourth:
        mixed[r.source] += size(r)
    assert all(mixed[s] <= 3 * plain[s] + 200 for s in plain)
    # shards: each row once, slots without gaps, equal texts together, clashing columns set aside
    last = kept["sharding"]
    assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars", "_Shard", "score", "meta.lang", "x-y", "n chars", "shard", "slot"]
    assert Counter(map(key, last)) == times
    slots = defaultdict(list)
    for r in last:
        slots[r.shard].append(r.slot)
    assert set(slots) <= set(range(16)) and all(sorted(s) == list(range(len(s))) for s in slots.values())


def test_run_gives_the_last_stage(spark, corpus):
    folder, _, _ = corpus
    got = corpus_pipeline.run(spark, folder)
    assert got.columns[-2:] == ["shard", "slot"]
    again = corpus_pipeline.run(spark, folder)
    key = lambda df: Counter((r.doc_id, r.text, r["shard"], r.slot) for r in df.select("doc_id", "text", F.col("`shard`"), "slot").collect())
    assert key(got) == key(again)


def test_empty_tables(spark, tmp_path):
    documents(spark, []).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    spark.createDataFrame([], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).collect() == []
