"""Connected components by alternating star contractions, without collecting links anywhere."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut


def _stars(links: DataFrame, small: bool) -> DataFrame:
    """Point each node's neighbours at the node's least neighbour.

    ``links`` has a > b.  The large step looks at all neighbours of a node and moves the larger ones; the small step
    looks at the smaller neighbours and moves them and the node.  Minima are summed on the map side and joined back,
    so a node with very many links is spread by the skewed-join split rather than gathered in one task.
    """
    if small:
        least = links.groupBy("a").agg(F.min("b").alias("m"))
        moved = links.join(least, "a")
        out = moved.select(F.col("b").alias("a"), F.col("m").alias("b")).filter("a <> b").union(least.select("a", F.col("m").alias("b")))
    else:
        both = links.select(F.col("a").alias("u"), F.col("b").alias("v")).union(links.select(F.col("b").alias("u"), F.col("a").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        out = both.filter("v > u").join(least, "u").select(F.col("v").alias("a"), F.col("m").alias("b"))
    return out.distinct()


def _state(links: DataFrame) -> tuple:
    return tuple(links.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())


def components(links: DataFrame, *, most_rounds: int = 60) -> DataFrame:
    """Per node that has a link: node, root (the least node of its component).

    ``links`` has columns a and b of any ordered type.  Rounds grow with the logarithm of the longest path.
    """
    links = links.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    links = cut(links)
    state = _state(links)
    for _ in range(most_rounds):
        if state[0] == 0:
            break
        links = cut(_stars(_stars(links, small=False), small=True))
        now = _state(links)
        if now == state:
            break
        state = now
    else:
        raise RuntimeError("components did not settle")
    own = links.select(F.col("b").alias("node")).distinct()
    return links.select(F.col("a").alias("node"), F.col("b").alias("root")).union(own.select("node", F.col("node").alias("root")))
