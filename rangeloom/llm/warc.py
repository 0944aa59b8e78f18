"""WARC archives: a writer, and a reader that splits compressed archives.

An archive is a row of gzip members, one record each.  A reading task gets a byte range of a file.  Spark's line reader,
with the three bytes that begin a member as its line separator, scans the range for them; a line is what stands between
two such places, and belongs to the range in which it starts.  Each line is a candidate: it counts as a member only if
its header and its data decode.  Where the three bytes occur inside a member's data, the pieces are put together again;
pieces on the two sides of a range's end meet in a small second step.

The writer puts members into files through Spark's text writer, byte for byte, so archives live in any store that Spark
writes.  That writer ends each row with a separator: here the zero byte with which a member's length field ends (where it
doesn't, an empty member follows).

Names that end in ``.gz`` would make Spark unpack the file as one stream.  Such files are read under another name (a mount
of Hadoop's view file system, which adds an ending and leads to the same bytes in any store), in byte ranges like all others.

Ids and URLs stand in header lines: characters that would break a line or the brackets around an id are written as %XX,
the percent sign too in ids, and read back.

Defined results: a null or empty payload has 0 bytes and the digest of nothing; rows that repeat both page_id and payload
are each written as a response if theirs is the smallest page_id; a null page_id comes after all others; an empty table
gives no records.
"""

from __future__ import annotations

import base64
import hashlib
import re
import zlib
from collections.abc import Iterator
from urllib.parse import unquote, urlsplit

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import bounded_batches, c, cut, new_path, slices, stored, tidied

MAGIC = b"\x1f\x8b\x08"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
#: A member of no bytes; it ends with a zero byte.
EMPTY = bytes.fromhex("1f8b080000000000000303000000000000000000")


def digest_of(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload, usedforsecurity=False).digest()).decode()


def _field(value: str, also: str = "") -> str:
    """A header value on one line."""
    return re.sub(rf"[\x00-\x20\x7f{also}]", lambda m: f"%{ord(m[0]):02X}", value)


def _urn(name: str) -> str:
    return f"<urn:page:{_field(name, '<>%')}>"


def record(name: str, url: str, payload: bytes, refers_to: str | None, date: str) -> bytes:
    """One record: the response with its HTTP head and payload, or a revisit with the head alone."""
    head = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = head if refers_to is not None else head + payload
    lines = ["WARC/1.0", f"WARC-Type: {'response' if refers_to is None else 'revisit'}", f"WARC-Record-ID: {_urn(name)}", f"WARC-Date: {date}", f"WARC-Target-URI: {_field(url)}", f"WARC-Payload-Digest: sha1:{digest_of(payload)}"]
    if refers_to is not None:
        lines += [f"WARC-Refers-To: {_urn(refers_to)}", f"WARC-Profile: {PROFILE}"]
    lines += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}", "", ""]
    return "\r\n".join(lines).encode() + block + b"\r\n\r\n"


def member(data: bytes, level: int = 6) -> bytes:
    z = zlib.compressobj(level, zlib.DEFLATED, 31)
    out = z.compress(data) + z.flush()
    return out if out[-1] == 0 else out + EMPTY


def _members(date: str, row_bytes: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out, size = [], 0

        def row() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([b"".join(out)[:-1]], pa.binary())], ["data"])

        for whole in batches:
            for batch in slices(whole, 0):
                for payload, name, url, refers_to in zip(*(batch.column(i).to_pylist() for i in range(4)), strict=True):
                    out.append(member(record(name or "", url or "", payload or b"", refers_to, date)))
                    size += len(out[-1])
                    if size >= row_bytes:
                        yield row()
                        out, size = [], 0
        if out:
            yield row()

    return tidied(run)


def write_archive(df: DataFrame, path: str, *, id_col: str = "page_id", url_col: str = "url", body_col: str = "html", min_bytes: int = 0, date: str = "2000-01-01T00:00:00Z", row_bytes: int = 1 << 20, broadcast_rows: int = 200_000) -> None:
    """Write a record per row.  Of rows with equal payloads of at least ``min_bytes`` bytes the one with the smallest
    id is a response and the others revisit it; smaller payloads are all responses.

    Who revisits whom is found on digests and ids alone.  Up to ``broadcast_rows`` repeated payloads are then sent to the
    executors, a digest and an id each, and the payloads stay where they are; beyond that the rows meet their marks by
    digest and id, so that a payload which very many rows share is dealt out by their ids.
    """
    bounded_batches(df.sparkSession)
    rows = df.select(F.encode(F.coalesce(c(body_col).cast("string"), F.lit("")), "UTF-8").alias("payload"), c(id_col).alias("id"), c(url_col).cast("string").alias("url"))
    rows = rows.withColumn("digest", F.unhex(F.sha1("payload")))
    large = rows.filter(F.octet_length("payload") >= min_bytes).select("digest", "id")
    first = cut(large.groupBy("digest").agg(F.min("id").alias("first"), F.count(F.lit(1)).alias("n")).filter("n > 1").select("digest", "first"))
    if first.limit(broadcast_rows + 1).count() <= broadcast_rows:
        told = rows.join(F.broadcast(first), "digest", "left")
    else:
        marks = large.distinct().join(first, "digest").select(F.col("digest").alias("_digest"), F.col("id").alias("_id"), "first")
        told = rows.join(marks, (F.col("digest") == F.col("_digest")) & F.col("id").eqNullSafe(F.col("_id")), "left")
    own = F.col("first").isNull() | F.coalesce(F.col("id") == F.col("first"), F.lit(False))
    marked = told.select("payload", F.col("id").cast("string").alias("id"), "url", F.when(~own, F.col("first").cast("string")).alias("refers_to"))
    data = marked.mapInArrow(_members(date, row_bytes), "data binary")
    data.select(F.col("data").cast("string").alias("value")).write.option("lineSep", "\x00").text(path)


# ---- reading ---------------------------------------------------------------------------------------------------------


class Members:
    """Puts candidates together to members.

    ``feed`` takes what follows a magic, with a tag; members come out of ``done``, and lines before the first of them
    that belong to no member that could be decided, with their tags, out of ``lost``.
    """

    def __init__(self):
        self.done: list[bytes] = []
        self.restart()

    def restart(self) -> None:
        """Forget everything but the members that are done."""
        self.lost: list[tuple[int, bytes]] = []
        self.raw: list[tuple[int, bytes]] = []  # the open member's lines
        self.open = None
        self.out: list[bytes] = []
        self.count = 0  # members decided

    def feed(self, line: bytes, tag: int = 0) -> None:
        """Take a line as the rest of the open member, or as the start of one.

        If the open member fails, its first line is lost and those behind it are tried as starts themselves.
        """
        waiting = [(tag, line)]
        while waiting:
            tag, line = waiting.pop()
            if self.open is not None:
                if self._take(self.open, line, tag):
                    continue
                waiting.append((tag, line))
                waiting += self.raw[:0:-1]
                self._lose(*self.raw[0])
                self.open, self.out, self.raw = None, [], []
            elif (line[:1] and line[0] & 0xE0) or not self._take(zlib.decompressobj(31), line, tag):  # reserved flags
                self.open, self.out, self.raw = None, [], []
                self._lose(tag, line)

    def _lose(self, tag: int, line: bytes) -> None:
        if self.count == 0:
            self.lost.append((tag, line))

    def _take(self, z, line: bytes, tag: int) -> bool:
        try:
            self.out.append(z.decompress(MAGIC + line))
        except zlib.error:
            return False
        self.open = z
        self.raw.append((tag, line))
        if z.eof:
            whole = b"".join(self.out)
            self.open, self.out, self.raw = None, [], []
            self.count += 1
            if whole.startswith(b"WARC/"):
                self.done.append(whole)
        return True


FIELDS = pa.schema([("record_id", pa.string()), ("record_type", pa.string()), ("url", pa.string()), ("date", pa.string()), ("payload_digest", pa.string()), ("refers_to", pa.string()), ("payload", pa.binary()), ("payload_bytes", pa.int64())])
DDL = "record_id string, record_type string, url string, date string, payload_digest string, refers_to string, payload binary, payload_bytes long"


def parse(whole: bytes) -> tuple:
    """The fields of one record.  A revisit's payload_bytes is what its HTTP head says; its payload is null."""
    head, _, rest = whole.partition(b"\r\n\r\n")
    fields = {}
    for line in head.decode("utf-8", "replace").split("\r\n")[1:]:
        name, _, value = line.partition(":")
        fields[name.strip().lower()] = value.strip()
    block = rest[: int(fields.get("content-length", "0") or 0)]
    kind = fields.get("warc-type")
    payload, size = block, len(block)
    if "application/http" in fields.get("content-type", ""):
        http, _, payload = block.partition(b"\r\n\r\n")
        size = len(payload)
        if kind == "revisit":
            told = re.search(rb"(?im)^content-length:\s*(\d+)", http)
            payload, size = None, int(told[1]) if told else None
    digest = fields.get("warc-payload-digest")
    if payload is not None and kind == "response":
        digest = "sha1:" + digest_of(payload)
    bare = lambda x: x and (unquote if x.startswith("<urn:page:") else str)(x.removeprefix("<").removesuffix(">"))
    return bare(fields.get("warc-record-id")), kind, fields.get("warc-target-uri"), fields.get("warc-date"), digest and digest.rpartition(":")[2], bare(fields.get("warc-refers-to")), payload, size


def _parsed(found: list[bytes]) -> pa.RecordBatch:
    rows = [parse(x) for x in found]
    cols = list(zip(*rows, strict=True)) if rows else [[]] * len(FIELDS)
    return pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(cols, FIELDS, strict=True)], schema=FIELDS)


#: A row is a record, or a piece of what a range can't decide alone (seq from 0), or says that a range has been read
#: (seq -1): ``open`` if a member runs on behind its end, ``through`` if it decided nothing.
SCAN_DDL = f"{DDL}, file string, split long, seq long, piece binary, open boolean, through boolean"
EXTRA = {"file": pa.string(), "split": pa.int64(), "seq": pa.int64(), "piece": pa.binary(), "open": pa.bool_(), "through": pa.bool_()}


@tidied
def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Decode the members of each range.  Undecided are the lines before its first member, which may go on one from the
    range before, and the open member at its end; what fails between two members is damage and is left out."""
    at, members, seq = None, Members(), 0

    def emit(more: list[tuple]) -> Iterator[pa.RecordBatch]:
        if members.done or more:
            known = _parsed(members.done)
            members.done = []
            n, k = len(known), len(more)
            cols = [pa.concat_arrays([known.column(i), pa.nulls(k, f.type)]) for i, f in enumerate(FIELDS)]
            extra = list(zip(*more, strict=True)) if more else [[]] * len(EXTRA)
            cols += [pa.concat_arrays([pa.nulls(n, t), pa.array(x, t)]) for x, t in zip(extra, EXTRA.values(), strict=True)]
            yield pa.RecordBatch.from_arrays(cols, [*FIELDS.names, *EXTRA])

    def undecided() -> list[tuple]:
        lost, members.lost = members.lost, []
        return [(*at, tag, line, None, None) for tag, line in lost]

    def end() -> list[tuple]:
        out = undecided() + [(*at, tag, line, None, None) for tag, line in members.raw]
        if seq:
            out.append((*at, -1, None, members.open is not None, members.count == 0))
        members.restart()
        return out

    for whole in batches:
        for batch in slices(whole, 0, 4 << 20):
            more: list[tuple] = []
            for line, file, start in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                if (file, start) != at:
                    if at:
                        more += end()
                    at, seq = (file, start), 0
                    if start == 0:
                        if line.startswith(b"WARC/"):
                            raise ValueError(f"not an archive of gzip members: {file}")
                        continue  # what stands before the file's first member
                members.feed(line, seq)
                more += undecided()
                seq += 1
            yield from emit(more)
    if at:
        yield from emit(end())


@tidied
def _join_pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Put pieces together: input sorted by (file, chain, split, seq).  What is held is one open member."""
    key, members = None, Members()
    for batch in batches:
        for file, chain, piece in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
            if (file, chain) != key:
                members.restart()
                key = (file, chain)
            members.feed(piece)
            members.lost.clear()
        if members.done:
            found, members.done = members.done, []
            yield _parsed(found)


def _candidates(spark: SparkSession, path: str) -> DataFrame:
    """What stands between two magics: line, file, start of the byte range.  No file is unpacked, whatever its name."""

    def lines(paths: str | list[str], **options: str) -> DataFrame:
        found = spark.read.option("lineSep", MAGIC.decode("latin-1")).option("encoding", "ISO-8859-1").options(**options).text(paths)
        return found.select(F.col("value").cast("binary").alias("line"), F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("start"))

    plain = lines(path)
    files = plain.inputFiles()
    if not any(f.endswith(".gz") for f in files):
        return plain
    by_store: dict[str, list[str]] = {}
    for parts in map(urlsplit, files):
        by_store.setdefault(f"{parts.scheme}://{parts.netloc}", []).append(parts.path.replace("*", "%2A"))  # as in a URI, which the mount makes of it again
    out = None
    for store, names in sorted(by_store.items()):
        mount = "rangeloom-" + hashlib.sha1(store.encode(), usedforsecurity=False).hexdigest()
        own = lines([f"viewfs://{mount}{name}.members" for name in names], **{f"fs.viewfs.mounttable.{mount}.linkRegex.#.^(?<name>.+)[.]members$": store + "${name}"})
        out = own if out is None else out.unionByName(own)
    return out


def read_archive(spark: SparkSession, path: str, *, payloads: bool = True) -> DataFrame:
    """The records of all archives at ``path``: see ``DDL`` for the columns; without ``payloads`` that one is null.

    Pieces that no range could decide on its own (members cut by a false magic near a range's end) are few whatever the
    input: three given bytes come up once in 16 MB of compressed data.  A range's pieces go on those of the range before
    it if a member was open there; such chains are put together side by side, a line at a time.  A damaged or foreign
    file opens no members, so its pieces don't hang together and are left out.
    """
    bounded_batches(spark)
    found = _candidates(spark, path).mapInArrow(_scan, SCAN_DDL)
    scanned = stored(found if payloads else found.withColumn("payload", F.lit(None).cast("binary")), "records")
    names = FIELDS.names
    along = Window.partitionBy("file").orderBy("split")
    before = along.rowsBetween(Window.unboundedPreceding, -1)
    # a range goes on if the one before it left a member open, or decided nothing and went on itself from an open one
    reach = F.last(F.when(F.col("open") | ~F.col("through"), F.col("open")), ignorenulls=True).over(before)
    goes_on = F.coalesce((F.lag("open").over(along) | F.lag("through").over(along)) & reach, F.lit(False))
    ranges = scanned.filter("seq = -1").select("file", "split", "open", (~goes_on).cast("int").alias("new"))
    ranges = ranges.withColumn("chain", F.sum("new").over(along)).select("file", "split", "chain", (F.max("open").over(Window.partitionBy("file", "chain"))).alias("some"))
    pieces = scanned.filter("piece is not null").select("file", "split", "seq", "piece").join(ranges.filter("some"), ["file", "split"])
    ordered = pieces.repartition("file", "chain").sortWithinPartitions("file", "chain", "split", "seq").select("file", "chain", "piece")
    joined = ordered.mapInArrow(_join_pieces, DDL)
    return scanned.filter("file is null").select(*names).unionByName(joined)


def archive_report(df: DataFrame, *, id_col: str = "page_id", url_col: str = "url", body_col: str = "html", min_bytes: int = 0) -> DataFrame:
    """Write ``df`` as archives in the shared folder, read them back, and report each record:
    id, payload_bytes, payload_digest, record_type and refers_to (the response's id)."""
    spark = df.sparkSession
    path = new_path(spark, "warc")
    write_archive(df, path, id_col=id_col, url_col=url_col, body_col=body_col, min_bytes=min_bytes)
    kind = df.schema[id_col].dataType
    ident = lambda name: F.nullif(F.regexp_replace(name, "^urn:page:", ""), F.lit("")).cast(kind)
    return read_archive(spark, path, payloads=False).select(ident("record_id").alias("id"), "payload_bytes", "payload_digest", "record_type", ident("refers_to").alias("refers_to"))
