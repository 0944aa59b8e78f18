"""Token ids in bit-plane files.

A file holds the ids of consecutive documents in chunks of fixed size.  Each chunk's ids are transposed into bit
planes (or byte planes), every plane is compressed with zstandard on its own, and an index of the chunks stands behind
them, so that a reader can fetch any run of ids without touching the rest::

    "BPL1" | planes of chunk 0, 1, ... | chunk index | document lengths | footer

    chunk index   per chunk: ids, planes, then the byte length of each plane, all unsigned 32-bit little-endian
    lengths       ids per document as zstandard of unsigned 64-bit little-endian
    footer        offset of the index, number of chunks, offset of the lengths, number of documents, plane width, magic

Files are rows of a Parquet table (part, file, content), so they live in any store that Spark writes, whole or not at
all, and a lost executor's files are written again.

Defined results: a null or empty text has only the end id; documents are in ascending id order, null ids first, repeated
ids by the text's hash; an empty table gives no files and an empty result.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import bounded_batches, c, new_path, slices, text_or_empty, tidied

MAGIC = b"BPL1"
FOOTER = struct.Struct("<QQQQI4s")

# ---- the file format -------------------------------------------------------------------------------------------------


def to_planes(ids: np.ndarray, bits: int) -> list[bytes]:
    """Transpose ids (unsigned) into planes of ``bits`` bits each (1 or 8), lowest first, as many as the largest id needs."""
    top = int(ids.max()).bit_length() if len(ids) else 0
    n = -(-top // bits)
    if bits == 8:
        return [((ids >> np.uint32(8 * k)) & np.uint32(255)).astype("u1").tobytes() for k in range(n)]
    raw = np.ascontiguousarray(ids.astype("<u4")).view("u1").reshape(-1, 4)
    return [np.packbits((raw[:, k // 8] >> np.uint8(k % 8)) & np.uint8(1), bitorder="little").tobytes() for k in range(n)]


def from_planes(planes: list[bytes], n: int, bits: int) -> np.ndarray:
    raw = np.zeros((n, 4), "u1")
    for k, plane in enumerate(planes):
        if bits == 8:
            raw[:, k] = np.frombuffer(plane, "u1")
        else:
            raw[:, k // 8] |= np.unpackbits(np.frombuffer(plane, "u1"), count=n, bitorder="little") << np.uint8(k % 8)
    return raw.view("<u4").reshape(-1)


def pack(ids: np.ndarray, lengths: np.ndarray, *, chunk: int = 1 << 16, bits: int = 1, level: int = 1) -> bytes:
    """One file with the ids of consecutive documents, ``lengths`` ids each."""
    z = zstandard.ZstdCompressor(level=level)
    out, index, at = [MAGIC], [], len(MAGIC)
    for a in range(0, len(ids), chunk):
        part = ids[a : a + chunk]
        planes = [z.compress(p) for p in to_planes(part, bits)]
        index += [len(part), len(planes), *map(len, planes)]
        out += planes
        at += sum(map(len, planes))
    table = np.array(index, "<u4").tobytes()
    sizes = z.compress(np.asarray(lengths, "<u8").tobytes())
    footer = FOOTER.pack(at, -(-len(ids) // chunk), at + len(table), len(lengths), bits, MAGIC)
    return b"".join([*out, table, sizes, footer])


def _tables(content: bytes) -> tuple[list[tuple[int, int, list[int]]], np.ndarray, int]:
    """The chunks (offset, ids, plane lengths), the documents' lengths and the plane width of a file."""
    index_at, chunks, sizes_at, docs, bits, magic = FOOTER.unpack(content[-FOOTER.size :])
    if magic != MAGIC or content[:4] != MAGIC:
        raise ValueError("not a bit-plane file")
    index = np.frombuffer(content[index_at:sizes_at], "<u4").tolist()
    sizes = zstandard.ZstdDecompressor().decompress(content[sizes_at : -FOOTER.size], max_output_size=max(8 * docs, 1))
    table, at, i = [], len(MAGIC), 0
    for _ in range(chunks):
        n, planes = index[i : i + 2]
        table.append((at, n, index[i + 2 : i + 2 + planes]))
        at += sum(table[-1][2])
        i += 2 + planes
    return table, np.frombuffer(sizes, "<u8").astype("i8"), bits


def _chunk(content: bytes, at: int, n: int, lengths: list[int], bits: int) -> np.ndarray:
    z, got = zstandard.ZstdDecompressor(), []
    for length in lengths:
        got.append(z.decompress(content[at : at + length], max_output_size=n))
        at += length
    return from_planes(got, n, bits)


def unpack(content: bytes) -> tuple[np.ndarray, np.ndarray]:
    """The ids and the documents' lengths of a file."""
    table, sizes, bits = _tables(content)
    return np.concatenate([np.zeros(0, "<u4"), *(_chunk(content, at, n, lengths, bits) for at, n, lengths in table)]), sizes


def unpack_run(content: bytes, first: int, count: int) -> np.ndarray:
    """The ids from place ``first`` of a file on, ``count`` at most: only the chunks that hold them are decompressed."""
    table, _, bits = _tables(content)
    out, place = [np.zeros(0, "<u4")], 0
    for at, n, lengths in table:
        if place < first + count and first < place + n:
            out.append(_chunk(content, at, n, lengths, bits)[max(first - place, 0) : first + count - place])
        place += n
    return np.concatenate(out)


# ---- encoding --------------------------------------------------------------------------------------------------------

#: A Latin letter, then punctuation that the splitter below never joins to it; a space between changes no token.  The
#: letters are those that composing and lower-casing leave letters (a capital dotted I, say, would leave a mark behind it).
LETTER_MARK = r"([A-Za-zÀ-ÖØ-öø-įı-ſ])([.,!?;:%*#$&]+)"

#: Words of such letters: composing leaves them as they are, and each letter has one in lower case.
LATIN = "^[A-Za-zÀ-ÖØ-öø-įı-ſ]+$"

#: The normaliser and the splitter with which a text's ids are its pieces' ids in a row.
KNOWN_NORMALIZER = {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "}, {"type": "Lowercase"}]}
KNOWN_SPLIT = {"type": "Split", "pattern": {"Regex": "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"}, "behavior": "Removed", "invert": True}


def cuts_at_spaces(tokenizer) -> bool:
    """Whether a tokenizer composes and lower-cases characters and then cuts at white space and around letters, so that
    no token crosses such a cut and :class:`WordEncoder` may be used."""
    import json

    told = json.loads(tokenizer.to_str())
    split = (told.get("pre_tokenizer") or {}).get("pretokenizers") or [{}]
    rest = [x.get("type") == "ByteLevel" and not x.get("add_prefix_space") and not x.get("use_regex") for x in split[1:]]
    plain = all(not x.get("lstrip") and not x.get("rstrip") and not x.get("single_word") and " " not in x.get("content", "") for x in told.get("added_tokens", []))
    return told.get("normalizer") == KNOWN_NORMALIZER and split[0] == KNOWN_SPLIT and all(rest) and plain and told.get("post_processor") is None


class TextEncoder:
    """Encodes whole texts by the library alone: for any tokenizer."""

    def __init__(self, tokenizer):
        self.tokenizer = tokenizer

    def encode(self, texts: pa.Array, end_id: int) -> tuple[np.ndarray, np.ndarray]:
        """All ids of the texts in a row, each text's followed by ``end_id``, and the number of ids of each text."""
        got = [[*e.ids, end_id] for e in self.tokenizer.encode_batch(texts.to_pylist(), add_special_tokens=False)]
        sizes = np.fromiter(map(len, got), "i8", len(got))
        return np.fromiter((x for ids in got for x in ids), "u4", int(sizes.sum())), sizes


class WordEncoder:
    """Encodes texts piece by piece and remembers the pieces: for tokenizers of which :func:`cuts_at_spaces` holds.

    A text's ids are its pieces' ids in a row.  A piece is encoded by the library when it is met first, a word of Latin
    letters in lower case, as the normaliser would make it.  When the memory would hold more than ``most`` pieces, the half
    met least often leaves it, and so do pieces of more than ``LONG`` ids, which hardly come again.
    """

    #: Words that go through the library as one text, and ids of a piece that isn't kept for long.
    JOINED, LONG = 1000, 16

    def __init__(self, tokenizer, most: int = 800_000):
        self.tokenizer = tokenizer
        self.most = most
        # which ids end a word, if the vocabulary tells
        self.ends = None
        if suffix := getattr(tokenizer.model, "end_of_word_suffix", None):
            vocabulary = tokenizer.get_vocab()
            self.ends = np.zeros(max(vocabulary.values(), default=0) + 1, "?")
            self.ends[[i for word, i in vocabulary.items() if word.endswith(suffix)]] = True
        self._empty()

    def _empty(self) -> None:
        # piece i has the ids from byte stop[i] to byte stop[i + 1]; piece 0 is the end id
        self.place: dict[str, int] = {}
        self.ids = np.zeros(1 << 20, "u4")
        self.stop, self.met = np.zeros(1 << 16, "i8"), np.zeros(1 << 16, "i4")
        self.stop[1] = 4

    def _used(self) -> int:
        return int(self.stop[len(self.place) + 1]) // 4

    def _leave(self) -> None:
        """Forget the pieces met least often; those that stay lose half of their count."""
        n = len(self.place)
        size, met = np.diff(self.stop[: n + 2])[1:] // 4, self.met[1 : n + 1].copy()
        met[size > self.LONG] = -1
        stays = np.sort(np.argsort(-met, kind="stable")[: min(self.most // 2, int((met >= 0).sum()))])
        words, ids, first = list(self.place), self.ids, self.stop[1 : n + 1][stays] // 4
        kept = size[stays]
        flat = ids[np.arange(kept.sum()) + np.repeat(first - (np.cumsum(kept) - kept), kept)]
        self._empty()
        self._keep([words[i] for i in stays.tolist()], flat, kept)
        self.met[1 : len(stays) + 1] = met[stays] // 2

    def _learn(self, words: list[str]) -> None:
        # words of letters alone are one piece each: many go through the library as one text
        plain = [w for w in words if w.isalpha() and w.lower().isalpha()]
        other = [w for w in words if not (w.isalpha() and w.lower().isalpha())]
        for a in range(0, len(plain), self.JOINED):
            other += self._joined(plain[a : a + self.JOINED])
        for a in range(0, len(other), 20_000):
            some = other[a : a + 20_000]
            got = [e.ids for e in self.tokenizer.encode_batch_fast(some, add_special_tokens=False)]
            sizes = np.fromiter(map(len, got), "i8", len(got))
            self._keep(some, np.fromiter((x for ids in got for x in ids), "u4", int(sizes.sum())), sizes)

    def _joined(self, words: list[str]) -> list[str]:
        """Keep words of letters alone, encoded as one text; returns them if the ids can't be told apart."""
        text = " ".join(words)
        if self.ends is None:
            got = self.tokenizer.encode(text, add_special_tokens=False)
            flat, sizes = np.array(got.ids, "u4"), np.bincount(np.array(got.word_ids, "i8"), minlength=len(words))
        else:
            flat = np.array(self.tokenizer.encode_batch_fast([text], add_special_tokens=False)[0].ids, "u4")
            sizes = np.diff(np.flatnonzero(self.ends[flat]) + 1, prepend=0)
        if len(sizes) != len(words) or sizes.sum() != len(flat) or not sizes.all():
            return words
        self._keep(words, flat, sizes)
        return []

    def _keep(self, words: list[str], flat: np.ndarray, sizes: np.ndarray) -> None:
        n, used = len(self.place), self._used()
        while used + len(flat) > len(self.ids):
            self.ids = np.concatenate([self.ids, np.zeros_like(self.ids)])
        while n + len(words) + 2 > len(self.stop):
            self.stop, self.met = np.concatenate([self.stop, np.zeros_like(self.stop)]), np.concatenate([self.met, np.zeros_like(self.met)])
        self.ids[used : used + len(flat)] = flat
        self.stop[n + 2 : n + 2 + len(words)] = 4 * (used + np.cumsum(sizes))
        self.place.update(zip(words, range(n + 1, n + 1 + len(words)), strict=True))

    def encode(self, texts: pa.Array, end_id: int) -> tuple[np.ndarray, np.ndarray]:
        """All ids of the texts in a row, each text's followed by ``end_id``, and the number of ids of each text."""
        if len(texts) == 0:
            return np.zeros(0, "u4"), np.zeros(0, "i8")
        pieces = pc.ascii_split_whitespace(pc.replace_substring_regex(texts, LETTER_MARK, r"\1 \2"))
        ends = np.cumsum(pc.list_value_length(pieces).to_numpy(zero_copy_only=False), dtype="i8")
        coded = pieces.flatten().dictionary_encode()
        met = coded.dictionary
        met = pc.if_else(pc.match_substring_regex(met, LATIN), pc.utf8_lower(met), met).dictionary_encode()
        words = met.dictionary.to_numpy(zero_copy_only=False).tolist()
        if len(self.place) + len(words) > self.most or self._used() > 16 * self.most:
            self._leave()
        at = np.fromiter(map(self.place.get, words, repeat(0)), "i4", len(words))
        if len(new := np.flatnonzero(at == 0)):
            some = [words[i] for i in new.tolist()]
            self._learn(some)
            at[new] = np.fromiter(map(self.place.__getitem__, some), "i4", len(some))
        self.met[at] += 1
        # each text ends with one more piece: the end id
        self.ids[0] = end_id
        row = np.insert(at[met.indices.to_numpy(zero_copy_only=False)][coded.indices.to_numpy(zero_copy_only=False)], ends, 0)
        n = len(self.place) + 1
        memory = pa.Array.from_buffers(pa.large_binary(), n, [None, pa.py_buffer(self.stop), pa.py_buffer(self.ids)])
        _, stop, ids = memory.take(pa.array(row)).buffers()
        last = np.frombuffer(stop, "i8", len(row) + 1)[1 + ends + np.arange(len(ends))] // 4
        return np.frombuffer(ids, "u4", int(last[-1])), np.diff(last, prepend=0)


_encoders: dict[str, WordEncoder | TextEncoder] = {}


def encoder(path: str) -> WordEncoder | TextEncoder:
    """The encoder for a vocabulary file, made once a process."""
    if path not in _encoders:
        import os

        from tokenizers import Tokenizer

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        tokenizer = Tokenizer.from_file(path)
        _encoders[path] = WordEncoder(tokenizer) if cuts_at_spaces(tokenizer) else TextEncoder(tokenizer)
    return _encoders[path]


def _write(vocabulary: str, end_id: int, file_ids: int, chunk: int, bits: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        codes, part, file = encoder(vocabulary), TaskContext.get().partitionId(), 0
        ids, lengths, waiting = [], [], 0

        def close() -> pa.RecordBatch:
            nonlocal file, waiting
            flat, sizes = np.concatenate(ids), np.concatenate(lengths)
            content = pack(flat, sizes, chunk=chunk, bits=bits)
            row = pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([file], pa.int32()), pa.array([len(flat)], pa.int64()), docs(), pa.array([content], pa.binary())], ["part", "file", "n_ids", "ids", "content"])
            file, waiting = file + 1, 0
            ids.clear(), lengths.clear(), names.clear()
            return row

        names: list[pa.Array] = []

        def docs() -> pa.Array:
            flat = pa.concat_arrays(names)
            return pa.ListArray.from_arrays(pa.array([0, len(flat)], pa.int32()), flat)

        for whole in batches:
            for batch in slices(whole, 0, 2 << 20):
                flat, sizes = codes.encode(batch.column(0), end_id)
                ids.append(flat), lengths.append(sizes), names.append(batch.column(1))
                waiting += len(flat)
                if waiting >= file_ids:
                    yield close()
        if ids:
            yield close()

    return tidied(run)


def write_tokens(
    df: DataFrame, path: str, *, vocabulary: str, end_id: int, id_col: str = "doc_id", text_col: str = "text", file_ids: int = 1 << 20, chunk: int = 1 << 16, bits: int = 1, task_bytes: int = 64 << 20
) -> None:
    """Encode every text and write the ids in ascending id order as bit-plane files of about ``file_ids`` ids.

    A task sorts about ``task_bytes`` bytes of text: there are as many tasks as the measured texts need, and at least
    ``spark.sql.shuffle.partitions``.
    """
    bounded_batches(df.sparkSession)
    kind = df.schema[id_col].dataType.simpleString()
    docs = df.select(text_or_empty(text_col).alias("text"), c(id_col).alias("id"))
    total = docs.agg(F.coalesce(F.sum(F.octet_length("text").cast("long")), F.lit(0))).first()[0]
    parts = max(1, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-total // task_bytes))
    ordered = docs.repartitionByRange(parts, F.col("id").asc_nulls_first()).sortWithinPartitions(F.col("id").asc_nulls_first(), F.xxhash64("text"))
    out = f"part int, file int, n_ids long, ids array<{kind}>, content binary"
    ordered.mapInArrow(_write(vocabulary, end_id, file_ids, chunk, bits), out).write.parquet(path)


@tidied
def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for i in range(len(batch)):
            ids, lengths = unpack(batch.column("content")[i].as_py())
            raw = memoryview(np.ascontiguousarray(ids, "<u4")).cast("B")
            stop = np.cumsum(lengths)
            crc = [zlib.crc32(raw[4 * a : 4 * b]) for a, b in zip((stop - lengths).tolist(), stop.tolist(), strict=True)]
            offset = batch.column("before")[i].as_py()
            yield pa.RecordBatch.from_arrays(
                [batch.column("ids")[i].values, pa.array(offset + stop - lengths, pa.int64()), pa.array(lengths, pa.int64()), pa.array(crc, pa.int64())], ["id", "start", "n_tokens", "ids_crc32"]
            )


def token_report(spark, path: str) -> DataFrame:
    """Read bit-plane files back.  Per document: id, start (ids before it), n_tokens and ids_crc32.

    Starts come from the files' counts: first over the parts (as many as the writer had partitions), then inside each.
    """
    bounded_batches(spark)
    files = spark.read.parquet(path)
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    inside = Window.partitionBy("part").orderBy("file").rowsBetween(Window.unboundedPreceding, -1)
    parts = files.groupBy("part").agg(F.sum("n_ids").alias("n_ids")).select("part", F.coalesce(F.sum("n_ids").over(before), F.lit(0)).alias("first"))
    counts = files.select("part", "file", F.coalesce(F.sum("n_ids").over(inside), F.lit(0)).alias("earlier"))
    starts = counts.join(parts, "part").select("part", "file", (F.col("first") + F.col("earlier")).alias("before"))
    kind = files.schema["ids"].dataType.elementType.simpleString()
    return files.join(starts, ["part", "file"]).select("ids", "content", "before").mapInArrow(_read, f"id {kind}, start long, n_tokens long, ids_crc32 long")


def write_and_read(df: DataFrame, **options) -> DataFrame:
    """Write ``df``'s texts as bit-plane files in the shared folder and report what the files hold."""
    path = new_path(df.sparkSession, "tokens")
    write_tokens(df, path, **options)
    return token_report(df.sparkSession, path)
