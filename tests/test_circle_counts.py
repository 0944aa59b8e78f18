"""Counts and sums of the hits on circles, without pairs, against the pairs."""

import random

import pytest
from helpers import frame
from pyspark.sql import functions as F
from test_moved_rows import nodes

from rangeloom.operators import overlaps


@pytest.mark.parametrize("most", [4, 25])
def test_counts_on_circles(spark, most):
    rng = random.Random(most)
    some = lambda n: [(a, a + rng.randint(-1, most) - (most < 9)) for a in (rng.randint(-30, 30) for _ in range(n))]
    some = lambda n, plain=some: [(a, max(z, a - 1)) for a, z in plain(n)]
    q, s = frame(spark, some(40)).unionByName(frame(spark, some(3), space=2)), frame(spark, some(50)).unionByName(frame(spark, some(3), space=1))
    for gap in (-1, 0, 2):
        pairs = overlaps.find_circular(q, s, 12, maxgap=gap).groupBy("space", "query_id").agg(F.count("*"), F.sum("subject_id"))
        counted = overlaps.count_circular(q, s, 12, maxgap=gap)
        assert sorted(map(tuple, counted.collect())) == sorted(map(tuple, pairs.collect())), gap
    if most == 4:
        assert nodes(overlaps.count_circular(q, s, 100), "Generate explode(sequence") == 0  # no bins: no pairs
