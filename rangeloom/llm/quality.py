"""Quality classifier by compression.

Two zstandard dictionaries are trained, one on good and one on bad labelled text.  A text is cut into blocks, each block
is compressed with either dictionary, and the difference of the two total sizes over the text's length says which kind of
text it resembles.  A logistic curve, fitted on labelled texts that the dictionaries have not seen, turns the difference
into a score.

The fit uses a bounded sample of labelled rows; of those it reads whole texts, and scoring covers all rows and whole
texts.  Two parameters bound the sample: ``most_labels`` rows of each label, and of these, for the dictionaries alone,
as many rows as fit into ``most_bytes`` for each label (a text that doesn't fit is left out whole, never cut).

Defined results: null or empty texts get the score of a text about which nothing is known, the share of good labels in
the sample; with no labels, or labels of one kind only, all texts get that share (0.5 with none); labels that are null
or neither 0 nor 1 are ignored; an id with both labels counts as bad; where an id stands on several rows the least text
(by bytes) is the labelled one; an empty table gives an empty result.  A column of the input that is called like the
score keeps its place under a free name: underscores are put before it.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import aside, bounded_batches, c, shape, slices, stored, text_or_empty, tidied

BLOCK = 2048


@dataclass(frozen=True)
class Model:
    """Dictionaries (raw bytes) and the calibration: score = 1 / (1 + exp(-(bias + weight * difference)))."""

    good: bytes
    bad: bytes
    bias: float
    weight: float
    prior: float


_ready: dict[int, tuple[Model, list]] = {}


def _compressors(model: Model) -> list:
    held = _ready.get(id(model))
    if held is None or held[0] is not model:
        made = []
        for raw in (model.good, model.bad):
            d = zstandard.ZstdCompressionDict(raw)
            d.precompute_compress(level=3)
            made.append(zstandard.ZstdCompressor(dict_data=d, write_content_size=False, write_checksum=False, write_dict_id=False))
        _ready.clear()
        held = _ready[id(model)] = (model, made)
    return held[1]


def difference(text: bytes, compressors: list) -> float:
    """The size under the bad dictionary less that under the good one, over the length."""
    good = bad = 0
    for a in range(0, len(text), BLOCK):
        part = text[a : a + BLOCK]
        good += len(compressors[0].compress(part))
        bad += len(compressors[1].compress(part))
    return (bad - good) / max(len(text), 1)


def score_text(text: bytes, model: Model) -> float:
    if not text or not model.good:
        return model.prior
    z = model.bias + model.weight * difference(text, _compressors(model))
    return 1 / (1 + math.exp(-max(-500.0, min(500.0, z))))


def _logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1e-3, rounds: int = 60) -> tuple[float, float]:
    """Bias and weight by Newton's method with a small ridge on the standardised feature."""
    mean, std = x.mean(), x.std() + 1e-12
    z = np.column_stack([np.ones(len(x)), (x - mean) / std])
    w = np.zeros(2)
    penalty = np.diag([0.0, ridge * len(x)])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
        step = np.linalg.solve(z.T @ (z * (p * (1 - p))[:, None]) + penalty + 1e-9 * np.eye(2), z.T @ (p - y) + penalty @ w)
        w -= step
        if np.abs(step).max() < 1e-8:
            break
    return float(w[0] - w[1] * mean / std), float(w[1] / std)


def dictionaries(good: list[bytes], bad: list[bytes], *, dictionary_bytes: int = 112_640) -> tuple[bytes, bytes] | None:
    """Both dictionaries from whole texts, or nothing if there is too little text."""
    made = []
    for texts in (good, bad):
        samples = [text[a : a + BLOCK] for text in texts for a in range(0, len(text), BLOCK)]
        if len(samples) < 8:
            return None
        size = min(dictionary_bytes, max(1024, sum(map(len, samples)) // 4))
        try:
            made.append(zstandard.train_dictionary(size, samples).as_bytes())
        except zstandard.ZstdError:  # too little text to train on
            return None
    return made[0], made[1]


def held_out(id_col: str) -> Column:
    """Rows that no fit may see: crc32 of the id as text leaves 1 when divided by 3."""
    return F.coalesce(F.crc32(c(id_col).cast("string")) % 3 == 1, F.lit(False))


def fit(docs: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", most_labels: int = 6000, most_bytes: int = 8 << 20) -> Model:
    """Train on labelled rows that aren't held out: at most ``most_labels`` of each label, chosen by a hash of the id.

    In the order of that hash three rows of five are for the dictionaries and two for the calibration.  Whole texts of the
    first come to the driver, at most ``most_bytes`` for each label; the others' differences are computed where the texts
    are, and only those numbers come back.
    """
    bounded_batches(docs.sparkSession)
    known = labels.select(c(id_col).alias("id"), c(label_col).cast("int").alias("label")).filter(F.col("label").isin(0, 1) & F.col("id").isNotNull() & ~held_out("id"))
    known = known.groupBy("id").agg(F.min("label").alias("label")).withColumn("draw", F.xxhash64("id", F.lit(7)))
    chosen = None
    for label in (0, 1):
        some = known.filter(F.col("label") == label).orderBy("draw", "id").limit(most_labels)
        chosen = some if chosen is None else chosen.unionByName(some)
    texts = docs.select(c(id_col).alias("id"), F.encode(text_or_empty(text_col), "UTF-8").alias("text"))
    rows = texts.join(F.broadcast(chosen), "id").groupBy("id").agg(F.min("draw").alias("draw"), F.min("label").alias("label"), F.min("text").alias("text"))
    rows = stored(rows.filter(F.octet_length("text") > 0), "labelled")
    slim = rows.select("id", "draw", "label", F.octet_length("text").alias("bytes")).toPandas().sort_values(["draw", "id"])
    prior = float(slim["label"].mean()) if len(slim) else 0.5
    unknown = Model(b"", b"", 0.0, 0.0, prior)
    role = slim.groupby("label").cumcount() % 5
    for_books = slim[role.isin((0, 2, 4))]
    taken, room = [], {0: most_bytes, 1: most_bytes}
    for r in for_books.itertuples():
        if r.bytes <= room[r.label]:
            room[r.label] -= r.bytes
            taken.append(r.id)
    if not taken or len(taken) == len(slim):
        return unknown
    spark = docs.sparkSession
    kind = f"id {rows.schema['id'].dataType.simpleString()}"
    few = lambda ids: F.broadcast(spark.createDataFrame([(x,) for x in ids], kind))
    got = sorted(rows.join(few(taken), "id").select("draw", "id", "label", "text").collect())
    books = dictionaries(*([bytes(r.text) for r in got if r.label == label] for label in (1, 0)))
    rest = slim[role.isin((1, 3))]
    if books is None or rest["label"].nunique() < 2:
        return unknown
    held = spark.sparkContext.broadcast(Model(*books, 0.0, 0.0, prior))
    numbers = rows.join(few(rest["id"].tolist()), "id").select("text", "draw", "id", "label").mapInArrow(_differences(held), f"draw long, {kind}, label int, x double")
    points = numbers.toPandas().sort_values(["draw", "id"])
    return Model(*books, *_logistic(points["x"].to_numpy(), points["label"].to_numpy("f8")), prior)


def _differences(held):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        compressors = _compressors(held.value)
        for whole in batches:
            for batch in slices(whole, 0):
                x = [difference(t.as_buffer().to_pybytes(), compressors) for t in batch.column(0)]
                yield pa.RecordBatch.from_arrays([*batch.columns[1:], pa.array(x, pa.float64())], [*batch.schema.names[1:], "x"])

    return tidied(run)


def _scores(held, least: float | None):
    """Rows (text, further columns) with their score; with ``least`` only those that reach it, without the score."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = held.value
        for whole in batches:
            for batch in slices(whole, 0):
                scores = [score_text(x.as_buffer().to_pybytes() if x.is_valid else b"", model) for x in batch.column(0)]
                if least is None:
                    yield pa.RecordBatch.from_arrays([*batch.columns[1:], pa.array(scores, pa.float64())], [*batch.schema.names[1:], "score"])
                else:
                    yield batch.filter(pa.array([s >= least for s in scores], pa.bool_()))

    return tidied(run)


def score(df: DataFrame, model: Model, *, text_col: str = "text", keep: list[str] | None = None) -> DataFrame:
    """The columns ``keep`` (default all) and score, from each row's whole text."""
    bounded_batches(df.sparkSession)
    keep = df.columns if keep is None else keep
    held = df.sparkSession.sparkContext.broadcast(model)
    packed = df.select(c(text_col).cast("string").alias("text"), F.struct(*[c(k) for k in keep]).alias("row"))
    out = packed.mapInArrow(_scores(held, None), shape(row=packed.schema["row"].dataType, score="double"))
    return out.select(*[F.col("row").getField(k).alias(new) for k, new in zip(keep, aside(keep, "score"), strict=True)], "score")


def keep_good(df: DataFrame, model: Model, *, text_col: str = "text", least: float = 0.5) -> DataFrame:
    """The rows, with all their columns, whose text scores at least ``least``."""
    bounded_batches(df.sparkSession)
    held = df.sparkSession.sparkContext.broadcast(model)
    others = [x for x in df.columns if x != text_col]
    rest = F.struct(*[c(x) for x in others]) if others else F.struct(F.lit(0).alias("none"))
    packed = df.select(c(text_col).cast("string").alias("text"), rest.alias("row"))
    good = packed.mapInArrow(_scores(held, least), shape(text="string", row=packed.schema["row"].dataType))
    return good.select(*[F.col("text").alias(x) if x == text_col else F.col("row").getField(x).alias(x) for x in df.columns])
