"""Overlap joins against the plain definition, over types, tolerances, bin widths and levels."""

import random

import pytest
from helpers import frame

from rangeloom.operators import overlaps
from rangeloom.plans.binning import Bins, tune


def plain(q, s, type, maxgap, minoverlap):
    out = set()
    g = max(maxgap, 0)
    for i, (a, b) in enumerate(q, 1):
        for j, (c, d) in enumerate(s, 1):
            shared = min(b, d) - max(a, c) + 1
            if type == "any":
                hit = shared >= minoverlap if minoverlap else a <= d + maxgap + 1 and c <= b + maxgap + 1
            elif type == "start":
                hit = abs(a - c) <= g and (not minoverlap or shared >= minoverlap)
            elif type == "end":
                hit = abs(b - d) <= g and (not minoverlap or shared >= minoverlap)
            elif type == "equal":
                hit = abs(a - c) <= g and abs(b - d) <= g and (not minoverlap or shared >= minoverlap)
            else:
                if type == "extend":
                    a1, b1, c1, d1 = c, d, a, b
                else:
                    a1, b1, c1, d1 = a, b, c, d
                hit = a1 >= c1 and b1 <= d1 and b1 - a1 + 1 >= minoverlap and (g == 0 or (a1 - c1) + (d1 - b1) <= g)
            if hit:
                out.add((i, j))
    return out


@pytest.mark.parametrize("type", overlaps.TYPES)
def test_against_definition(spark, type):
    rng = random.Random(97)
    some = lambda n: [(a, a + rng.choice([0, 1, 2, 5, 30, 400]) - 1) for a in (rng.randint(-60, 60) for _ in range(n))]
    q, s = some(60), some(60)
    fq, fs = frame(spark, q), frame(spark, s)
    for maxgap, minoverlap in ((-1, 0), (0, 0), (3, 0), (-1, 1), (-1, 3)):
        for bins in (Bins(4, 1), Bins(3, 3), tune(fq, fs)):
            rows = [(r.query_id, r.subject_id) for r in overlaps.find(fq, fs, type=type, maxgap=maxgap, minoverlap=minoverlap, bins=bins).collect()]
            assert len(rows) == len(set(rows))
            assert set(rows) == plain(q, s, type, maxgap, minoverlap), (maxgap, minoverlap, bins)


@pytest.mark.parametrize("maxgap", [-1, 0, 3])
def test_counts_by_rank(spark, maxgap):
    rng = random.Random(5)
    some = lambda n: [(a, a + rng.choice([0, 0, 1, 3, 40]) - 1) for a in (rng.randint(-20, 20) for _ in range(n))]
    q, s = some(80), some(80)
    got = {r.rid: r.n for r in overlaps.count(frame(spark, q), frame(spark, s), maxgap=maxgap, chunk=7).collect()}
    hits = plain(q, s, "any", maxgap, 0)
    assert got == {i: sum(a == i for a, _ in hits) for i in range(1, len(q) + 1)}
