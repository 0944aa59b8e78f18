"""From raw documents to shards: quality, near duplicates, benchmark leaks, source weights, shards.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame that is written as Parquet and reread as the next
stage's ``docs``.  All but the last return the columns of their input.

In every stage a null text is an empty one, null ids and sources are values like others, rows that repeat are judged
each, an empty table gives an empty result, and columns may have any names (those that a stage adds itself get an
underscore before them).  Texts without words are no near duplicates of each other and hold no item; they have the
score that the classifier gives an empty text, weigh nothing in the mix and one byte in a shard.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from rangeloom.llm import decontam, mixing, ngram, quality, sharding
from rangeloom.llm.common import stored


#: Words that a benchmark item must have to remove documents.
LEAST_WORDS = 3


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier accepts.

    It is trained on the labelled documents of the input that aren't held out.
    """
    model = quality.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return quality.keep_good(docs, model, least=0.5)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of texts that share four fifths of their runs of five words."""
    return ngram.keep_first(docs, words=5, threshold=0.8)


def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which no benchmark item occurs, with up to a tenth of its characters edited.

    Items of fewer than ``LEAST_WORDS`` words are names that clean documents hold too; they remove none.
    """
    return decontam.without_leaks(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"), rate=0.1, least_words=LEAST_WORDS)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix of sources by weights 5, 2, 1 takes them, three times at most."""
    return mixing.mix(docs, weights=(5, 2, 1), max_repeats=3)


def into_shards(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents with their shard (0 to 15, of about equal bytes) and their slot in it."""
    return sharding.shard(docs, shards=16)


STAGES = [
    ("quality classifier", keep_quality),
    ("n-gram Jaccard join", drop_near_duplicates),
    ("benchmark decontamination", drop_leaks),
    ("mixing sources", mix_sources),
    ("sharding", into_shards),
]

#: SQL has no compressor, so the first stage can't be expressed; the stages are tested one by one by brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = stage(spark, docs, sf_dir)
        if stage is not STAGES[-1][1]:
            docs = stored(docs, name.replace(" ", "-"))
    return docs
