"""Nearest subjects: each once, with their distance, and no hit moved for either."""

import random
from collections import Counter

from helpers import frame
from test_moved_rows import nodes

from rangeloom.operators import nearest, overlaps


def some(rng, n):
    return [(a, a + rng.choice([-1, -1, 0, 2, 9])) for a in (rng.randint(0, 900) for _ in range(n))]


def test_each_hit_once_with_its_distance(spark):
    rng = random.Random(7)
    q, s = some(rng, 60), some(rng, 50) + [(400, 399), (400, 400), (950, 949)]
    far = lambda a, b: max(max(a[0], b[0]) - min(a[1], b[1]) - 1, 0)
    want = Counter((i, j, far(a, b)) for i, a in enumerate(q, 1) for j, b in enumerate(s, 1) if far(a, b) == min(far(a, c) for c in s))
    fq, fs = frame(spark, q), frame(spark, s)
    got = nearest.distance_to_nearest(fq, fs, all=True)
    assert Counter((r.query_id, r.subject_id, r.distance) for r in got.collect()) == want
    hits = nearest.nearest(fq, fs, all=True)
    assert Counter((r.query_id, r.subject_id) for r in hits.collect()) == Counter((i, j) for i, j, _ in want.elements())
    assert nodes(got, "Join") == nodes(hits, "Join") == 2 and nodes(got, "Aggregate") == nodes(hits, "Aggregate") == 0
    for how in ({"maxgap": 6}, {"maxgap": 0}, {}, {"type": "start", "maxgap": 4}):
        made = nearest.select_nearest(overlaps.find(fq, fs, **how), fq, fs)
        assert Counter(map(tuple, nearest.select_nearest(how, fq, fs).collect())) == Counter(map(tuple, made.collect())), how
    assert nodes(nearest.select_nearest({"maxgap": 6}, fq, fs), "Window") == 0
