"""The corpus operators on small tables, against brute force, with awkward rows."""

import base64
import hashlib
import math
import random
import zlib
from collections import Counter, defaultdict
from itertools import combinations

import numpy as np
import pytest
from corpus_helpers import awkward, documents, row, words
from pyspark.sql import functions as F

from rangeloom.llm import components, decontam, html, lines, mixing, ngram, quality, sharding, tokens, vectors, warc
from rangeloom.llm.common import WORD_RE

VOCABULARY = "word_bpe_49k.json"


def sizes(text):
    return len(WORD_RE.findall(text or ""))


# ---- mixing ----------------------------------------------------------------------------------------------------------


def water(totals, weights, limit):
    """Share by weight, cut at the limit, share the excess again, until nothing is above."""
    target, full, left = dict.fromkeys(totals, 0.0), set(), float(sum(totals.values()))
    while True:
        open_ = [s for s in totals if s not in full]
        if not open_:
            return target
        unit = left / sum(weights[s] for s in open_)
        over = [s for s in open_ if weights[s] * unit >= limit * totals[s]]
        if not over:
            return target | {s: weights[s] * unit for s in open_}
        for s in over:
            target[s] = limit * totals[s]
            full.add(s)
            left -= target[s]


def test_mix(spark):
    rng = random.Random(1)
    rows = awkward(rng) + [row(100 + i, words(rng, rng.randint(1, 60)), rng.choice(["a", "b", "b", "b", "ç", "d"])) for i in range(600)]
    df = documents(spark, rows)
    got = mixing.mix_report(df).collect()
    assert len(got) == len(rows)
    totals = defaultdict(int)
    for r in rows:
        totals[r[3]] += sizes(r[1])
    names = sorted((s for s in totals if s is not None), key=str) + [None] * (None in totals)
    want = water(totals, {s: [5, 2, 1][i % 3] for i, s in enumerate(names)}, 3)
    source = {totals[s]: s for s in totals}
    taken = defaultdict(int)
    for r in got:
        s = source[r.source_size]
        assert abs(r.target - want[s]) < 1e-6
        assert r.taken in (0, r.size, 2 * r.size, 3 * r.size)
        taken[s] += r.taken
    for s in totals:
        largest = max(sizes(r[1]) for r in rows if r[3] == s)
        assert abs(taken[s] - want[s]) <= 2 * largest
    key = lambda rs: Counter((r.id, r.size, r.taken) for r in rs)
    assert key(mixing.mix_report(df.repartition(7)).collect()) == key(got)
    mixed = mixing.mix(df)
    assert mixed.columns == df.columns
    assert Counter(sizes(r.text) for r in mixed.collect() if r.text)[60_000] in (0, 2, 4, 6)
    assert mixing.mix_report(df.limit(0)).collect() == []


def test_nested_thresholds(spark):
    rng = random.Random(2)
    df = documents(spark, [row(i, words(rng, 5), "a") for i in range(300)] + [row(1000 + i, words(rng, 5), "b") for i in range(300)])
    chosen = []
    for weight in (1, 2, 4):
        got = mixing.mix_report(df, weights=(weight, 10), max_repeats=3).collect()
        chosen.append({r.id for r in got if r.id < 1000 and r.taken})
    assert chosen[0] < chosen[1] < chosen[2]


# ---- quality ---------------------------------------------------------------------------------------------------------


def test_quality(spark):
    rng = random.Random(3)
    good = [row(i, ". ".join(words(rng, 12).capitalize() for _ in range(8))) for i in range(160)]
    bad = [row(1000 + i, " | ".join(words(rng, 1).upper() + "!!" for _ in range(80))) for i in range(160)]
    df = documents(spark, good + bad + awkward(rng))
    labels = spark.createDataFrame([(i, 1, 0) for i in range(160)] + [(1000 + i, 0, 0) for i in range(160)] + [(7, None, None)], "doc_id long, quality int, toxic int")
    model = quality.fit(df, labels)
    got = {r.doc_id: r.score for r in quality.score(df, model, keep=["doc_id"]).collect()}
    hold = [i for i in [*range(160), *range(1000, 1160)] if zlib.crc32(str(i).encode()) % 3 == 1]
    assert np.mean([(got[i] >= 0.5) == (i < 1000) for i in hold]) > 0.97
    assert all(0 <= s <= 1 and not math.isnan(s) for s in got.values())
    kept = quality.keep_good(df, model)
    assert kept.columns == df.columns and {r.doc_id for r in kept.collect()} >= {i for i in hold if i < 1000}
    none = quality.fit(df, labels.limit(0))
    assert {r.score for r in quality.score(df, none, keep=["doc_id"]).collect()} == {0.5}
    clash = quality.score(df.withColumn("Score", F.lit(9)), model)
    assert clash.columns == [*df.columns, "_Score", "score"] and {r._Score for r in clash.collect()} == {9}
    # an id that is held out changes nothing in the fit
    flipped = labels.withColumn("quality", F.when(quality.held_out("doc_id"), 1 - F.col("quality")).otherwise(F.col("quality")))
    assert quality.fit(df, flipped) == model
    assert quality.score(df.limit(0), model).collect() == []


def test_whole_texts_are_learnt(spark):
    """Texts of 30,000 characters that differ only at their ends."""
    rng = random.Random(31)
    same = words(rng, 4000)[:28_000]
    tail = lambda good: " ".join(words(rng, 4).capitalize() + "." if good else words(rng, 2).upper() + "!! |" for _ in range(80))
    df = documents(spark, [row(i, same + tail(i < 120)) for i in range(240)])
    labels = spark.createDataFrame([(i, int(i < 120), 0) for i in range(240)], "doc_id long, quality int, toxic int")
    got = {r.doc_id: r.score for r in quality.score(df, quality.fit(df, labels), keep=["doc_id"]).collect()}
    hold = [i for i in range(240) if zlib.crc32(str(i).encode()) % 3 == 1]
    assert np.mean([(got[i] >= 0.5) == (i < 120) for i in hold]) > 0.95


def test_score_by_hand(spark):
    """A score is what the model says of the whole text, block by block."""
    import zstandard

    rng = random.Random(32)
    df = documents(spark, [row(i, words(rng, 40) if i % 2 else words(rng, 40).upper()) for i in range(200)] + awkward(rng))
    model = quality.fit(df, spark.createDataFrame([(i, i % 2) for i in range(200)], "doc_id long, quality int"))
    assert model.good and model.bad
    books = [zstandard.ZstdCompressionDict(x) for x in (model.good, model.bad)]
    for r in quality.score(df, model, keep=["text"]).collect():
        raw = (r.text or "").encode()
        want = model.prior
        if raw:
            sizes = [0, 0]
            for k in (0, 1):
                z = zstandard.ZstdCompressor(dict_data=books[k], write_content_size=False, write_checksum=False, write_dict_id=False)
                sizes[k] = sum(len(z.compress(raw[a : a + 2048])) for a in range(0, len(raw), 2048))
            want = 1 / (1 + math.exp(-(model.bias + model.weight * (sizes[1] - sizes[0]) / len(raw))))
        assert abs(r.score - want) < 0.02


# ---- vectors ---------------------------------------------------------------------------------------------------------


def groups_of(n, links):
    label = list(range(n))

    def find(a):
        while label[a] != a:
            a = label[a]
        return a

    for a, b in links:
        a, b = find(a), find(b)
        label[max(a, b)] = min(a, b)
    return [find(i) for i in range(n)]


@pytest.mark.parametrize("block_rows", [5, 1024])
def test_vectors(spark, block_rows):
    rng = np.random.default_rng(4)
    base = rng.standard_normal((40, 16))
    rows = []
    for i in range(300):
        v = base[rng.integers(40)] + rng.standard_normal(16) * rng.choice([0.02, 0.2, 0.5])
        rows.append((i, [float(x) for x in v], int(rng.integers(3))))
    rows += [(300 + i, rows[0][1], rows[0][2]) for i in range(30)]
    odd = [(900, None, 1), (901, [], 1), (902, [0.0] * 16, 1), (903, [float("nan")] * 16, 1), (904, [None] + [1.0] * 15, 1), (905, rows[0][1], None), (906, rows[0][1][:8], rows[0][2]), (907, [float("inf")] * 16, 0), (908, [1e200] * 16, 2)]
    df = spark.createDataFrame(rows + odd, "vec_id long, embedding array<double>, label int")
    got = {r.id: (r.n_links, r.component_id) for r in vectors.near_duplicates(df, block_rows=block_rows, cell_rows=8).collect()}
    x = np.array([r[1] for r in rows])
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    close = (x @ x.T >= 0.93) & np.equal.outer([r[2] for r in rows], [r[2] for r in rows])
    np.fill_diagonal(close, False)
    group = groups_of(len(rows), [(a, b) for a, b in combinations(range(len(rows)), 2) if close[a, b]])
    found = sum(got[i][0] for i in range(len(rows)))
    assert found >= 0.99 * close.sum()
    assert all(got[i][0] <= close[i].sum() for i in range(len(rows)))
    if found == close.sum():
        assert all(got[i] == (close[i].sum(), group[i]) for i in range(len(rows)))
    assert all(got[i] == (0, i) for i in (*range(900, 908),))
    assert vectors.near_duplicates(df.limit(0)).collect() == []


def test_codebooks_follow_the_large_label(spark, monkeypatch):
    """One label with nearly all vectors and many small ones: cells are sized for the vectors' own label."""
    rng = np.random.default_rng(16)
    base = rng.normal(size=(60, 8))
    rows = [(i, (base[i % 60] + rng.normal(size=8) * 0.02).tolist(), "large") for i in range(900)] + [(1000 + i, rng.normal(size=8).tolist(), f"small{i // 2}") for i in range(240)]
    words = []
    build = vectors.build
    monkeypatch.setattr(vectors, "build", lambda sample, k, *more: words.append(k) or build(sample, k, *more))
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label string")
    got = {r.id: r.n_links for r in vectors.near_duplicates(df, threshold=0.93).collect()}
    peers = (900**2 + 120 * 2**2) / 1140
    assert words == [math.ceil(math.sqrt(peers / 32))] and words[0] > 2
    unit = np.array([v for _, v, _ in rows])
    unit /= np.linalg.norm(unit, axis=1, keepdims=True)
    near = (unit @ unit.T >= 0.93) & (np.array([r[2] for r in rows])[:, None] == np.array([r[2] for r in rows])[None, :])
    want = {r[0]: int(near[i].sum()) - 1 for i, r in enumerate(rows)}
    assert sum(got.values()) >= 0.99 * sum(want.values()) and all(got[i] <= want[i] for i in want)


def test_traversal_order():
    rng = np.random.default_rng(5)
    x, a, b = rng.standard_normal((20, 8)), rng.standard_normal((6, 4)), rng.standard_normal((7, 4))
    got = vectors.nearest_cells(x, a, b, 12)
    for v, cells in zip(x, got, strict=True):
        cost = ((v[:4] - a) ** 2).sum(1)[:, None] + ((v[4:] - b) ** 2).sum(1)[None, :]
        assert cells.tolist() == np.argsort(cost.reshape(-1), kind="stable")[:12].tolist()


@pytest.mark.parametrize("k", [56, 256])
def test_index_recall(k):
    """Of all pairs over the threshold, found by brute force, the index brings nearly all together."""
    rng = np.random.default_rng(k)
    base = rng.standard_normal((400, 32))
    x = vectors.unit(base[rng.integers(400, size=6000)] + rng.standard_normal((6000, 32)) * rng.choice([0.1, 0.2, 0.26], 6000)[:, None])
    index = vectors.build(x[:4000], k, 0.93, 0.999)
    assert len(index.first) == len(index.second) == k and index.visits < k * k / 4
    a, b = np.nonzero(np.triu(x @ x.T >= 0.93, 1))
    cells = vectors.nearest_cells(x, index.first, index.second, index.visits)
    found = (cells[a] == cells[b, :1]).any(1) | (cells[b] == cells[a, :1]).any(1)
    assert len(a) > 5000 and found.mean() >= 0.99


# ---- sharding --------------------------------------------------------------------------------------------------------


def test_shards(spark):
    rng = random.Random(6)
    rows = awkward(rng) + [row(100 + i, words(rng, rng.randint(1, 40))) for i in range(3000)] + [row(10_000 + i, "hot text " * 5) for i in range(1500)] + [row(20_000 + i, "") for i in range(1500)]
    df = documents(spark, rows)
    got = sharding.place(df, shards=16).collect()
    assert Counter(r.id for r in got) == Counter(r[0] for r in rows)
    slots, size = defaultdict(list), Counter()
    for r in got:
        slots[r.shard].append(r.slot)
        size[r.shard] += r.size
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert set(slots) <= set(range(16))
    where = defaultdict(set)
    texts = {r[0]: r[1] or "" for r in rows if r[0] is not None}
    for r in got:
        if r.id is not None:
            assert r.size == len(texts[r.id].encode()) + 1 and r.text_crc32 == zlib.crc32(texts[r.id].encode())
            where[texts[r.id]].add(r.shard)
    # a text stays whole unless a shard can't hold it: here only the two copies of the very long one are over a sixteenth
    most = sum(size.values()) / 16
    sums = Counter()
    for r in rows:
        sums[r[1] or ""] += len((r[1] or "").encode()) + 1
    assert all(len(s) == 1 for t, s in where.items() if sums[t] <= most)
    # without the two very long texts the shards are near equal
    even = sharding.place(df.filter("n_chars is null or n_chars < 100000")).groupBy("shard").agg(F.sum("size").alias("s")).collect()
    mean = sum(r.s for r in even) / 16
    assert len(even) == 16 and max(abs(r.s - mean) for r in even) < 0.06 * mean
    whole = sharding.shard(df)
    assert whole.columns == [*df.columns, "shard", "slot"] and whole.count() == len(rows)
    assert sharding.place(df.limit(0)).collect() == []
    clash = sharding.shard(df.withColumn("Slot", F.lit(1)).withColumn("_slot", F.lit(2)))
    assert clash.columns == [*df.columns, "__Slot", "_slot", "shard", "slot"] and clash.filter("__Slot = 1 and _slot = 2").count() == len(rows)


def test_range_size_follows_bytes(spark):
    rng = random.Random(61)
    df = documents(spark, [row(i, words(rng, 30)) for i in range(2000)] + [row(10_000 + i, "hot text") for i in range(3000)])
    few, many = (sharding.place(df, shards=4, ranges_per_shard=1, range_bytes=size).collect() for size in (1 << 40, 2000))
    for got in (few, many):
        where = defaultdict(set)
        for r in got:
            where["hot" if r.id >= 10_000 else r.id].add(r.shard)
        assert all(len(s) == 1 for s in where.values())
        load = Counter()
        for r in got:
            load[r.shard] += r.size
        assert len(load) == 4
    assert max(load.values()) < 1.05 * sum(load.values()) / 4


# ---- tokens ----------------------------------------------------------------------------------------------------------


@pytest.mark.parametrize("bits", [1, 8])
def test_planes(bits):
    rng = np.random.default_rng(7)
    for n, top in ((0, 1), (1, 1), (5, 1), (1000, 50_000), (70_000, 2**32)):
        ids = rng.integers(0, top, n, dtype="u8").astype("u4")
        cuts = np.sort(rng.integers(0, n + 1, 3))
        lengths = np.diff([0, *cuts, n])
        a, b = tokens.unpack(tokens.pack(ids, lengths, chunk=4096, bits=bits))
        assert (a == ids).all() and (b == lengths).all()
    with pytest.raises(ValueError):
        tokens.unpack(b"x" * 60)


def test_runs_of_a_file():
    rng = np.random.default_rng(71)
    ids = rng.integers(0, 50_000, 10_000, dtype="u8").astype("u4")
    content = tokens.pack(ids, np.array([10_000]), chunk=1000)
    for first, count in ((0, 10), (995, 10), (999, 2002), (9990, 100), (10_000, 5), (0, 10_000), (5, 0)):
        assert (tokens.unpack_run(content, first, count) == ids[first : first + count]).all()
    # chunks outside the run aren't read
    assert (tokens.unpack_run(content[:4] + b"x" * 100 + content[104:], 5000, 100) == ids[5000:5100]).all()


def test_ids_are_the_librarys():
    """Texts of letters that change when they are composed or lower-cased, beside marks; and a tokenizer of another kind."""
    public = pytest.importorskip("public_tokenizers")
    import pyarrow as pa
    from tokenizers import Tokenizer

    rng = random.Random(72)
    letters = "aDKİéßñçıſŉǰ\u0958\ufb1d\u0301\u0323\u0307\u0338'’漢字ΑΣς1٣𝐀"
    texts = ["".join(rng.choice(letters + ".,!?;:%*#$&-|<>() \n\u00a0") for _ in range(rng.randint(0, 14))) for _ in range(50_000)]
    texts += [f"a{chr(i)}{mark}b" for i in range(0x24F) for mark in ".*"] + ["DAKİ. aİ* İ..", "x<|endoftext|>.y"]
    for name, some in ((VOCABULARY, texts), ("byte_bpe_50k.json", texts[:2000])):
        path = public.path(name)
        codes = tokens.encoder(path)
        assert isinstance(codes, tokens.WordEncoder) == (name == VOCABULARY)
        flat, sizes = codes.encode(pa.array(some), 2)
        want = [[*e.ids, 2] for e in Tokenizer.from_file(path).encode_batch(some, add_special_tokens=False)]
        assert sizes.tolist() == list(map(len, want)) and flat.tolist() == [x for ids in want for x in ids]


class Counting:
    """A tokenizer that counts the words it is given."""

    def __init__(self, tokenizer):
        self.tokenizer, self.model, self.given = tokenizer, tokenizer.model, Counter()

    def __getattr__(self, name):
        return getattr(self.tokenizer, name)

    def encode(self, text, **kw):
        self.given.update(text.split())
        return self.tokenizer.encode(text, **kw)

    def encode_batch(self, texts, **kw):
        self.given.update(w for t in texts for w in t.split())
        return self.tokenizer.encode_batch(texts, **kw)

    def encode_batch_fast(self, texts, **kw):
        self.given.update(w for t in texts for w in t.split())
        return self.tokenizer.encode_batch_fast(texts, **kw)


def test_common_words_are_encoded_once():
    """Words that come again and again, in several spellings, among more other words than the memory holds."""
    public = pytest.importorskip("public_tokenizers")
    import pyarrow as pa
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(public.path(VOCABULARY))
    rng = random.Random(73)
    word = lambda: "".join(rng.choice("aeiourstnlmé") for _ in range(rng.randint(4, 9)))
    common = sorted({word() for _ in range(300)})
    counted = Counting(library)
    codes = tokens.WordEncoder(counted, most=2000)
    for _ in range(12):
        some = [f(w) for w in common for f in (str, str.upper, str.capitalize)] + [word() + word() for _ in range(700)] + ["9" * rng.randint(40, 60) for _ in range(5)]
        rng.shuffle(some)
        texts = ["", *(" ".join(some[a : a + 40]) + rng.choice(["", ".", " ?!"]) for a in range(0, len(some), 40)), "", " \n"]
        flat, sizes = codes.encode(pa.array(texts), 2)
        want = [[*e.ids, 2] for e in library.encode_batch(texts, add_special_tokens=False)]
        assert sizes.tolist() == list(map(len, want)) and flat.tolist() == [x for ids in want for x in ids]
        assert len(codes.place) <= 2000
    for w in common:
        assert sum(counted.given[f(w)] for f in (str, str.upper, str.capitalize)) == 1, w
    flat, sizes = codes.encode(pa.array(["", " "]), 5)
    assert flat.tolist() == [5, 5] and sizes.tolist() == [1, 1]
    flat, sizes = codes.encode(pa.array([], pa.string()), 5)
    assert len(flat) == len(sizes) == 0


def test_words_of_a_vocabulary_that_marks_no_ends():
    """Where no suffix ends a word, the library tells which ids are a word's."""
    public = pytest.importorskip("public_tokenizers")
    import json

    import pyarrow as pa
    from tokenizers import Tokenizer

    told = json.loads(Tokenizer.from_file(public.path("byte_bpe_50k.json")).to_str())
    told |= {"normalizer": tokens.KNOWN_NORMALIZER, "pre_tokenizer": {"type": "Sequence", "pretokenizers": [tokens.KNOWN_SPLIT, {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False}]}, "post_processor": None}
    library = Tokenizer.from_str(json.dumps(told))
    assert tokens.cuts_at_spaces(library) and not library.model.end_of_word_suffix
    texts = ["Some wondrously long words, said Éva (twice).", "", "ΑΣ some WORDS 12 漢字"]
    flat, sizes = tokens.WordEncoder(library).encode(pa.array(texts), 2)
    want = [[*e.ids, 2] for e in library.encode_batch(texts, add_special_tokens=False)]
    assert sizes.tolist() == list(map(len, want)) and flat.tolist() == [x for ids in want for x in ids]


def test_latin_letters_have_one_lower_case():
    """Lower-casing before the library gives what its normaliser gives, whatever Latin letters stand beside."""
    public = pytest.importorskip("public_tokenizers")
    import re

    import pyarrow as pa
    import pyarrow.compute as pc
    from tokenizers import Tokenizer

    normal = Tokenizer.from_file(public.path(VOCABULARY)).normalizer
    letters = [chr(i) for i in range(0x250) if re.match(tokens.LATIN, chr(i))]
    rng = random.Random(74)
    some = letters + ["".join(rng.choice(letters) for _ in range(rng.randint(2, 8))) for _ in range(20_000)]
    assert pc.all(pc.match_substring_regex(pa.array(some), tokens.LATIN)).as_py() and len(letters) > 200
    assert pc.utf8_lower(pa.array(some)).to_pylist() == [normal.normalize_str(w) for w in some]


def test_tokens(spark):
    public = pytest.importorskip("public_tokenizers")
    from tokenizers import Tokenizer

    path = public.path(VOCABULARY)
    library = Tokenizer.from_file(path)
    rng = random.Random(8)
    odd = ["<|endoftext|> x<|startoftext|>y", "it's we'll THEY'RE 'tis a.b,c 1,234.5 %%% é. ́x .́", "İstanbul ΑΣ. ΣΑΣ ﬁ ｆｕｌｌ", "a b c​d　e", "x\x00y\x1fz", "🙂👍🏽.🙂", "..a..b", "'s's 's"]
    rows = awkward(rng) + [row(50 + i, t) for i, t in enumerate(odd)] + [row(500 - i, words(rng, rng.randint(0, 80)) + rng.choice(["", ".", "?!", " ,"])) for i in range(200)]
    df = documents(spark, rows).repartition(5)
    got = sorted(tokens.write_and_read(df, vocabulary=path, end_id=2, file_ids=3000, chunk=512).collect(), key=lambda r: r.start)
    want = {}
    for r in rows:
        ids = [*library.encode(r[1] or "", add_special_tokens=False).ids, 2]
        want.setdefault(r[0], []).append((len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
    assert [r.id for r in got] == sorted((r[0] for r in rows), key=lambda i: (i is not None, i or 0))
    start = 0
    for r in got:
        assert r.start == start
        assert (r.n_tokens, r.ids_crc32) in want[r.id], r.id
        start += r.n_tokens
    assert tokens.write_and_read(df.limit(0), vocabulary=path, end_id=2).collect() == []


# ---- pages -----------------------------------------------------------------------------------------------------------


def test_marginals_against_enumeration():
    rng = random.Random(9)
    model = html.Model({f: rng.uniform(-2, 2) for f in ("always", "tag p", "tag div", "tag body", "tag #run", "links few")}, {k: tuple(rng.uniform(-2, 2) for _ in range(4)) for k in ("run", "section", "top", "inner")})
    nodes = html.parse("<div><p>one two</p><p>three</p>four</div><p>five</p>")
    n = len(nodes)
    total, on = 0.0, [0.0] * n
    for code in range(1 << n):
        y = [code >> i & 1 for i in range(n)]
        s = sum(sum(model.weights.get(f, 0.0) for f in html.looks(x, nodes[0].chars)) for x, v in zip(nodes, y, strict=True) if v)
        s += sum(model.edges[html.edge(nodes[nodes[i].parent], nodes[i])][2 * y[nodes[i].parent] + y[i]] for i in range(1, n))
        total += math.exp(s)
        for i in range(n):
            on[i] += math.exp(s) * y[i]
    assert np.allclose(html.marginals(nodes, model), [v / total for v in on])


def test_extraction(spark):
    page = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var t="</p>";</script></head><body><nav><ul><li><a href="/x">x</a></li><li><a href="/y">y</a></li></ul></nav>
    <!-- ad --><div class="ad">Buy this thing now.</div><article><h1>A &amp; B</h1><p><b>First  part of a long sentence that goes on.<br><p>Second&nbsp;part &lt;here&gt;, with <a href="z">a link</a> in it and more words.</p><p>Third.</p>
    <section class="comments"><p>A reader says something about it.</p></section></article><footer>&copy; someone. All of it.</footer></body></html>"""
    want = "A & B\nFirst part of a long sentence that goes on.\nSecond part <here>, with a link in it and more words.\nThird."
    df = spark.createDataFrame([(1, "u", page), (2, None, None), (3, "v", ""), (None, "w", "no tags at all, but a sentence of some length in any case"), (4, "u", "<div><p>unclosed <b>bold"), (1, "u", page), (5, "x", "<p>" * 3000)], "page_id long, url string, html string")
    got = html.extract(df).collect()
    assert [r.text for r in got if r.id == 1] == [want, want]
    assert {r.id: r.text for r in got}[2] == {r.id: r.text for r in got}[3] == ""
    assert html.extract(df.limit(0)).collect() == []


S = "Some sentence that is reasonably long and tells a story, word by word."
#: Layouts that the training pages don't have, and their texts.
LAYOUTS = [
    (f"<article><h1>Title</h1><p>{S}<datalist><option value=a></datalist></p><p>{S} 1</p><p>{S} 2<button>Click</p><p>{S} 3</p></article>", ["Title", S, S + " 1", S + " 2", S + " 3"]),
    (f"<article><p class=it's>{S}</p><p title='a>b' id=\"x\">{S} 1</p><p>1 < 2 and 3 > 2. {S}</p></article>", [S, S + " 1", "1 < 2 and 3 > 2. " + S]),
    (f"<div class='page-wrap comment-open'><div class=navMenu><a href=x>One</a><a href=y>Two</a></div><article><h1>T it is</h1><p>{S}</p><p>{S} 1</p></article></div>", ["T it is", S, S + " 1"]),
    (f"<div class='page-wrap comment-open'><div class='siteNav'><a href=x>One</a> <a href=y>Two</a></div><div class=entry-content><p>{S}</p><p>{S} 1</p></div><div class=cookieNotice><p>We use cookies on it.</p></div></div>", [S, S + " 1"]),
    (f"<header><div class=logo>Site</div></header><main><h1>News</h1><p>The <ruby>漢<rt>kan</rt></ruby> word. {S}</p><p>Let <math><mi>x</mi><mo>=</mo><mn>2</mn></math> be. {S}</p><noscript><p>{S} 3</p></noscript></main><footer>c 2020</footer>", ["News", f"The 漢kan word. {S}", f"Let x=2 be. {S}", S + " 3"]),
    (f"<nav><a href=a>A</a><a href=b>B</a></nav><div class='news-story'><h1>Big news today</h1><p>{S} {S}</p><p>{S}</p><aside class=pullquote><p>Buy more now please.</p></aside><p>{S} {S}</p></div><div id=disqus_comments><p>Nice one, friend. I agree with it all.</p></div><footer><p>All rights reserved.</p></footer>", ["Big news today", f"{S} {S}", S, f"{S} {S}"]),
    (f"<div id=top-nav><ul><li><a href=1>One</a><li><a href=2>Two</a></ul></div><div id=main-content><h2>On words</h2><p>{S}</p><ol><li>{S} a<li>{S} b</ol><p>{S} {S}</p><form><label>Email</label><input><button>Go</button></form></div><div class=sidebar-widget><h3>More</h3><p>{S}</p></div>", ["On words", S, S + " a", S + " b", f"{S} {S}"]),
    (f"<div class=shareBar><a href=1>Tweet</a></div><section><article><header><h1>Head</h1><p>By someone</p></header><p>{S}</p><pre>x = 1</pre><p>{S} {S}</p></article></section><div class=commentList><div class=comment><p>{S}</p></div></div>", ["Head", "By someone", S, "x = 1", f"{S} {S}"]),
    (f"<noscript>Please enable JavaScript.</noscript><div class='promo-box'><p>{S}</p></div><article><p>{S}</p><p>{S} 2</p></article>", [S, S + " 2"]),
]


@pytest.mark.parametrize("layout", range(len(LAYOUTS)))
def test_held_out_layouts(layout):
    page, want = LAYOUTS[layout]
    assert html.main_text(f"<html><body>{page}</body></html>", html.default_model()) == "\n".join(want)


@pytest.mark.parametrize("page", ["<a \"<a \"" * 125_000, '<p title="' * 100_000 + ">", "<a b='c>" * 125_000 + "'", "<" * 1_000_000, "<button>" * 120_000, "<textarea>" * 100_000, "<option>x<b>y" * 80_000, "<!--" * 250_000, "</" * 500_000])
def test_odd_pages_take_no_longer(page):
    import time

    began = time.time()
    html.parse(page)
    assert time.time() - began < 6  # quadratic work would take hours


def test_labelled_pages_are_learnt():
    from rangeloom.llm.labelled_pages import PAGES

    model, rng, wrong, n = html.default_model(), random.Random(10), 0, 0
    for page in PAGES * 3:
        nodes = html.parse(html._fill(page, rng))
        for node, y, p in zip(nodes, html.labels(nodes), html.marginals(nodes, model), strict=True):
            if node.text is not None:
                n += 1
                wrong += (p >= 0.5) != bool(y)
    assert wrong <= 0.03 * n


# ---- archives --------------------------------------------------------------------------------------------------------


def page_rows(rng):
    rows = [(i, f"http://x/{i}?a b\r\n", words(rng, rng.randint(1, 400)) + "".join(chr(rng.randint(32, 0x2FF)) for _ in range(300))) for i in range(120)]
    rows += [(200 + i, "u", "same page") for i in range(20)] + [(150, "u", "same page"), (300, None, None), (301, "u", ""), (None, "u", "no id"), (None, "v", "same page")]
    return rows


@pytest.mark.parametrize("split", ["4k", "256m"])
def test_archives(spark, split):
    rows = page_rows(random.Random(11))
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", split)
    try:
        got = warc.archive_report(df).collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
    assert Counter(r.id for r in got) == Counter(r[0] for r in rows)
    first = {}
    for i, _, body in rows:
        first[body or ""] = min(first.get(body or "", math.inf), math.inf if i is None else i)
    by_digest = {base64.b32encode(hashlib.sha1(b.encode()).digest()).decode(): b for b in first}
    for r in got:
        body = by_digest[r.payload_digest]
        assert r.payload_bytes == len(body.encode())
        own = first[body] in (math.inf, r.id) and not (r.id is None and first[body] != math.inf)
        assert (r.record_type, r.refers_to) == (("response", None) if own else ("revisit", first[body])), (r, body)


def test_small_payloads_are_responses(spark):
    df = spark.createDataFrame([(1, "u", "ab"), (2, "u", "ab"), (3, "u", "long enough"), (4, "u", "long enough")], "page_id long, url string, html string")
    got = {r.id: r.record_type for r in warc.archive_report(df, min_bytes=5).collect()}
    assert got == {1: "response", 2: "response", 3: "response", 4: "revisit"}
    assert warc.archive_report(df.limit(0)).collect() == []


def test_false_magic():
    """Members stored without compression that hold the three bytes themselves, cut at every place."""
    bodies = [b"WARC/1.0\r\nWARC-Type: x\r\n\r\n" + bytes([i]) * 10 + warc.MAGIC + b"abc" + warc.MAGIC * 2 + bytes(40) for i in range(6)]
    data = b"".join(warc.member(b, level=0) for b in bodies)
    lines = data.split(warc.MAGIC)[1:]
    assert len(lines) > len(bodies) * 3
    members = warc.Members()
    for line in lines:
        members.feed(line)
    assert members.done == bodies
    import pyarrow as pa

    for cut in range(1, len(lines)):
        batches = []
        for split, part in ((0, [b"", *lines[:cut]]), (1, lines[cut:])):
            batches.append(pa.RecordBatch.from_arrays([pa.array(part, pa.binary()), pa.array(["f"] * len(part)), pa.array([split * 100] * len(part), pa.int64())], ["line", "file", "start"]))
        done = pa.Table.from_batches(list(warc._scan(iter(batches))))
        whole = sum(v is not None for v in done.column("record_type").to_pylist())
        pieces = done.filter(pa.compute.is_valid(done.column("piece"))).sort_by([("split", "ascending"), ("seq", "ascending")])
        chain = pa.table({"file": pieces.column("file"), "chain": [0] * len(pieces), "piece": pieces.column("piece")})
        assert whole + sum(map(len, warc._join_pieces(iter(chain.to_batches())))) == len(bodies)


def test_damaged_archives(spark, tmp_path):
    """Damage costs the members it hits, and its pieces don't come together in one group."""
    rng = random.Random(18)
    bodies = [rng.randbytes(rng.randint(100, 900)) + warc.MAGIC * (i % 3) for i in range(120)]
    members = [warc.member(warc.record(f"x{i}", "u", body, None, "d"), level=i % 2) for i, body in enumerate(bodies)]
    hit = set(range(40, 60))
    data = b"".join(m if i not in hit else m[:30] + rng.randbytes(len(m) - 30).replace(warc.MAGIC, b"abc") for i, m in enumerate(members))
    (tmp_path / "a.warc.gz").write_bytes(data)
    (tmp_path / "b.warc.gz").write_bytes(b"".join(rng.randbytes(50) + warc.MAGIC for _ in range(2000)))  # no archive at all
    old = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    spark.conf.set("spark.sql.files.maxPartitionBytes", "2k")
    spark.conf.set("spark.sql.files.openCostInBytes", "1")
    try:
        got = Counter(r.record_id for r in warc.read_archive(spark, str(tmp_path)).collect())
    finally:
        for k, v in old.items():
            spark.conf.set(k, v)
    assert got == Counter(f"urn:page:x{i}" for i in range(120) if i not in hit)


@pytest.mark.parametrize("broadcast_rows", [0, 1000])
def test_ids_in_headers(spark, broadcast_rows, tmp_path):
    rows = [("a\r\nWARC-Type: x", "u", "one"), ("b>c <d", "u", "one"), ("50%25", "u", "two"), ("50%", "u", "two"), (None, "u", "one"), ("é", None, "three")] + [(f"k{i}", "u", "hot") for i in range(300)]
    df = spark.createDataFrame(rows, "page_id string, url string, html string")
    warc.write_archive(df, str(tmp_path / "x"), broadcast_rows=broadcast_rows)
    got = Counter((r.record_id.removeprefix("urn:page:"), r.record_type, r.refers_to and r.refers_to.removeprefix("urn:page:")) for r in warc.read_archive(spark, str(tmp_path / "x")).collect())
    first = {}
    for i, _, body in rows:
        if i is not None:
            first[body] = min(first.get(body, i), i)
    n = Counter(r[2] for r in rows)
    assert got == Counter((i or "", "response" if i == first[b] or n[b] == 1 else "revisit", None if i == first[b] or n[b] == 1 else first[b]) for i, _, b in rows)


@pytest.mark.parametrize("split", ["2k", "256m"])
def test_gz_names(spark, split, tmp_path):
    """Archives with the usual name give every record once, and are read in byte ranges."""
    rng = random.Random(17)
    names = ["a.warc.gz", "b c.warc.gz", "plain.warc", "d%20$1.gz"]
    want = Counter()
    for name in names:
        members = []
        for i in range(40):
            body = rng.randbytes(rng.randint(0, 900)) + warc.MAGIC * (i % 3)
            want[f"urn:page:{name[0]}{i}", body] += 1
            members.append(warc.member(warc.record(f"{name[0]}{i}", "u", body, None, "d"), level=i % 2))
        (tmp_path / name).write_bytes(b"".join(members))
    old = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    spark.conf.set("spark.sql.files.maxPartitionBytes", split)
    spark.conf.set("spark.sql.files.openCostInBytes", "1")
    try:
        for path in (str(tmp_path), f"file://{tmp_path}/*.warc.gz", str(tmp_path / "a.warc.gz")):
            some = {k: n for k, n in want.items() if path == str(tmp_path) or k[0][9] in ("ab" if "*" in path else "a")}
            got = warc.read_archive(spark, path)
            assert Counter((r.record_id, bytes(r.payload)) for r in got.collect()) == some
        ranges = Counter(r.file for r in warc._candidates(spark, str(tmp_path)).select("file", "start").distinct().collect())
        assert len(ranges) == len(names) and (split != "2k" or min(ranges.values()) > 4)
    finally:
        for k, v in old.items():
            spark.conf.set(k, v)


def test_unpacked_archive_is_an_error(spark, tmp_path):
    (tmp_path / "x.warc").write_bytes(warc.record("1", "u", b"body", None, "d"))
    with pytest.raises(Exception, match="not an archive of gzip members"):
        warc.read_archive(spark, str(tmp_path)).collect()


# ---- leaks -----------------------------------------------------------------------------------------------------------


def distance(p, t):
    before = [0] * (len(t) + 1)
    for i in range(1, len(p) + 1):
        now = [i] + [0] * len(t)
        for j in range(1, len(t) + 1):
            now[j] = min(before[j] + 1, now[j - 1] + 1, before[j - 1] + (p[i - 1] != t[j - 1]))
        before = now
    return min(before)


def test_edit_distance():
    rng = random.Random(12)
    for _ in range(1500):
        p = "".join(rng.choice("abc") for _ in range(rng.randint(1, 12)))
        t = "".join(rng.choice("abc") for _ in range(rng.randint(0, 20)))
        assert decontam.least_distance(decontam.masks(p), len(p), t) == distance(p, t)


@pytest.mark.parametrize("pass_chars", [60, 1 << 20])
def test_leaks(spark, pass_chars):
    rng = random.Random(13)
    items = [(i, words(rng, rng.randint(8, 20))) for i in range(6)] + [(6, None), (7, ""), (8, "short"), (9, None), (1, words(rng, 10))]
    real = [(i, t) for i, t in items if t and len(decontam.normal(t)) >= 20]
    rows = awkward(rng)
    for i in range(60):
        key, text = rng.choice(real)
        edited = list(decontam.normal(text))
        for _ in range(rng.randint(0, len(edited) // 7)):
            edited[rng.randrange(len(edited))] = rng.choice("xyzq")
        rows.append(row(100 + i, words(rng, 15) + "\n " + rng.choice([str.upper, str.title, str])("".join(edited)) + "\t" + words(rng, 15)))
    rows += [row(200 + i, words(rng, 40)) for i in range(20)]
    df = documents(spark, rows)
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = Counter((r.id, r.item, r.distance) for r in decontam.find_leaks(df, bench, pass_chars=pass_chars).collect())
    want = Counter()
    for r in rows:
        if r[1] and len(r[1]) < 5000:
            for key, text in real:
                p = decontam.normal(text)
                d = distance(p, decontam.normal(r[1]))
                if d <= int(len(p) * 0.1):
                    want[(r[0], key, d)] += 1
    assert got == want and len(want) > 20
    kept = decontam.without_leaks(df, bench, pass_chars=pass_chars)
    assert kept.columns == df.columns
    assert Counter(r.doc_id for r in kept.collect()) == Counter(r[0] for r in rows if r[0] not in {k[0] for k in want})
    assert decontam.find_leaks(df, bench.limit(0)).collect() == decontam.find_leaks(df.limit(0), bench).collect() == []


def nearest_stretch(item, text):
    """The least distance of the item to any stretch from a word's beginning to a word's end, tried one by one."""
    p, t = decontam.normal(item), decontam.normal(text or "")
    spans = [(a, b) for a in range(len(t)) for b in range(a + 1, min(len(t), a + len(p) + 2) + 1) if decontam.bounded(t, a, b)]
    return min((decontam.edits(p, t[a:b]) for a, b in spans), default=99)


def test_short_items(spark):
    """Items under the least length have the same budget as others and must stand between word boundaries."""
    items = [(1, "Blue  whale"), (2, "42"), (3, "漢字"), (4, " \n"), (5, None), (6, "c++"), (7, "what is the sum"), (8, "abcdefghi"), (9, "a tale of 2 cities"), (10, "nineteen characters")]
    texts = ["a blue\nWHALE.", "blue whales", "the bluewhale", "is 42", "is 421 or x42", "(42)", "これは漢字です", "use c++ now", "blue whole", "c++", "", None, "bluewhales"]
    texts += ["so what is thx sum of it", "so whatis the sum", "what is a sum", "overwhat is the sum", "what was the sum", "abcdefghx", "xabcdefghi", "abcdefghi", "a tale of two cities", "a tale of 3 cities!", "nineteen-characters", "nineteen characterss", "nineten charaters"]
    rng = random.Random(15)
    for _ in range(60):
        edited = list(rng.choice(["what is the sum", "a tale of 2 cities", "nineteen characters", "blue whale"]))
        for _ in range(rng.randint(0, 2)):
            at = rng.randrange(len(edited))
            edited[at : at + rng.randint(0, 1)] = rng.choice(["", "x", " ", "q", "e"])
        texts.append(rng.choice(["", "so ", "so"]) + "".join(edited) + rng.choice(["", " it", "s"]))
    df = documents(spark, [row(i, t) for i, t in enumerate(texts)])
    bench = spark.createDataFrame(items, "item_id long, text string")
    want = Counter()
    for i, text in enumerate(texts):
        for key, item in items:
            if item and item.strip() and (d := nearest_stretch(item, text)) <= int(len(decontam.normal(item)) * 0.1):
                want[i, key, d] += 1
    for size in (4, 1 << 20):
        found = decontam.find_leaks(df, bench, pass_chars=size).collect()
        assert Counter((r.id, r.item, r.distance) for r in found) == want
    assert sum(d for _, _, d in want) > 15 and (13, 7, 1) in want and (16, 7, 0) not in want
    assert {r.doc_id for r in decontam.without_leaks(df, bench).collect()} == set(range(len(texts))) - {i for i, _, _ in want}
    for least, out in ((2, {2, 3, 6, 8}), (5, {1, 2, 3, 6, 7, 8, 10})):
        found = decontam.find_leaks(df, bench, least_words=least).collect()
        assert Counter((r.id, r.item, r.distance) for r in found) == Counter({k: n for k, n in want.items() if k[1] not in out})


# ---- lines -----------------------------------------------------------------------------------------------------------


@pytest.mark.parametrize("broadcast_limit", [0, 1000])
def test_lines(spark, broadcast_limit):
    rng = random.Random(14)
    pool = [words(rng, 4) for _ in range(30)]
    rows = awkward(rng)
    for i in range(120):
        rows.append(row(100 + i, "\n".join(rng.choice(["", " ", "\t"]) + rng.choice([str, str.upper])(rng.choice(pool)) + rng.choice(["", "\r"]) for _ in range(rng.randint(0, 6))) + rng.choice(["", "\n", "\nÄ only " + str(i)])))
    df = documents(spark, rows)
    table = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})
    key = lambda x: x.strip(" \t\n\x0b\x0c\r").translate(table)
    seen = Counter()
    for r in rows:
        seen.update({key(x) for x in (r[1] or "").split("\n")} - {""})
    common = {k for k, n in seen.items() if n >= 10}
    assert common

    def want(text):
        parts = (text or "").split("\n")
        kept = [x for x in parts if key(x) not in common]
        return "\n".join(kept).encode(), len(parts), len(parts) - len(kept)

    got = Counter((r.id, bytes(r.kept), r.n_lines, r.n_dropped) for r in lines.dedup_lines(df, min_docs=10, broadcast_limit=broadcast_limit).collect())
    assert got == Counter((r[0], *want(r[1])) for r in rows)
    clean = lines.without_common_lines(df, min_docs=10)
    assert clean.columns == df.columns
    assert Counter((r.doc_id, r.text) for r in clean.collect()) == Counter((r[0], want(r[1])[0].decode()) for r in rows)
    assert lines.dedup_lines(df.limit(0)).collect() == []
    odd = lines.without_common_lines(df.withColumnsRenamed({"n_chars": "n chars", "lang": "meta.lang"}), min_docs=10)
    assert odd.columns == ["doc_id", "text", "meta.lang", "source", "n chars"] and Counter((r.doc_id, r.text) for r in odd.collect()) == Counter((r.doc_id, r.text) for r in clean.collect())


# ---- near copies -----------------------------------------------------------------------------------------------------


def runs_of(text):
    w = WORD_RE.findall(text or "")
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} - {()}


@pytest.mark.parametrize("block_rows", [4, 512])
def test_ngram_join(spark, block_rows):
    rng = random.Random(15)
    rows = awkward(rng)
    base = [words(rng, rng.randint(20, 120)).split() for _ in range(12)]
    for i in range(150):
        w = list(rng.choice(base))
        for _ in range(rng.choice([0, 0, 1, 1, 2, 4])):
            w[rng.randrange(len(w))] = words(rng, 1)
        rows.append(row(100 + i, rng.choice([" ", "\n", "  "]).join(w)))
    rows += [row(400 + i, "short text here") for i in range(3)] + [row(500, "short text there")]
    df = documents(spark, rows).repartition(3)
    sets = [runs_of(r[1]) for r in rows]
    links = [(a, b) for a, b in combinations(range(len(rows)), 2) if sets[a] and sets[b] and len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b])]
    group = groups_of(len(rows), links)
    count = Counter(x for pair in links for x in pair)
    least = {}
    for i, g in enumerate(group):
        if rows[i][0] is not None:
            least[g] = min(least.get(g, math.inf), rows[i][0])
    want = Counter((rows[i][0], least.get(g), count[i]) for i, g in enumerate(group))
    got = ngram.join(df, block_rows=block_rows, broadcast_rows=0 if block_rows == 4 else 1000).collect()
    assert Counter((r.id, r.class_id, r.n_links) for r in got) == want
    kept = ngram.keep_first(df, broadcast_rows=0 if block_rows == 4 else 1000)
    assert kept.columns == df.columns
    per_group = Counter()
    for r in kept.collect():
        if runs_of(r.text):
            i = next(k for k, x in enumerate(rows) if (x[0], x[1]) == (r.doc_id, r.text))
            per_group[group[i]] += 1
    assert set(per_group.values()) == {1} and set(per_group) == {g for i, g in enumerate(group) if sets[i]}
    assert sum(not runs_of(r.text) for r in kept.collect()) == sum(not s for s in sets)
    assert ngram.join(df.limit(0)).collect() == []


@pytest.mark.parametrize("block_rows", [8, 10_000])
def test_chain_of_near_copies(spark, block_rows):
    """Texts that each resemble only their neighbours hang together, but few of their pairs are candidates."""
    rng = random.Random(151)
    w = words(rng, 700).split()
    texts = [w[i * 5 : i * 5 + 100] for i in range(120)]
    df = documents(spark, [row(i, " ".join(t)) for i, t in enumerate(texts)])
    got = sorted((r.id, r.class_id, r.n_links) for r in ngram.join(df, block_rows=block_rows).collect())
    sets = [runs_of(" ".join(t)) for t in texts]
    near = lambda a, b: 0 <= b < 120 and a != b and len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b])
    assert got == [(i, 0, near(i, i - 1) + near(i, i + 1) + near(i, i - 2) + near(i, i + 2)) for i in range(120)]
    import pyarrow as pa

    signed = [b for batch in ngram._signatures(5, 15, 4)(iter([pa.record_batch([pa.array([" ".join(t) for t in texts])], names=["text"])])) for b in batch.column("bands").to_pylist()]
    pairs = ngram.candidates(np.array(signed), -1)
    assert 119 <= pairs.sum() / 2 < 0.15 * 120 * 119 / 2
    # a pair counts in the first band that it shares, and in that one alone
    bands = np.array(signed)
    times = sum((ngram.candidates(bands, k) & (bands[:, k][:, None] == bands[:, k][None, :])).astype(int) for k in range(15))
    assert (times == pairs).all()


def test_banding():
    bands, rows = ngram.banding(0.8, 0.9995)
    assert 1 - (1 - 0.8**rows) ** bands >= 0.9995


def test_components(spark):
    rng = random.Random(16)
    links = [(i, i + 1) for i in range(200)] + [(rng.randint(300, 400), rng.randint(300, 400)) for _ in range(80)] + [(500, 500 + i) for i in range(1, 50)]
    got = {r.node: r.root for r in components.components(spark.createDataFrame(links, "a long, b long")).collect()}
    group = groups_of(600, links)
    assert got == {n: group[n] for pair in links if pair[0] != pair[1] for n in pair}
