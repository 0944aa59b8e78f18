"""Sweeps against position sets, with chunks small enough that everything crosses their edges."""

import random

import pytest
from helpers import frame, ranges

from rangeloom.operators import algebra


def some(seed, n=80, low=-40, high=120, top=12):
    rng = random.Random(seed)
    return [(a, a + rng.randint(0, top) - 1) for a in (rng.randint(low, high) for _ in range(n))]


def as_ranges(positions):
    out = []
    for p in sorted(positions):
        if out and out[-1][1] == p - 1:
            out[-1][1] = p
        else:
            out.append([p, p])
    return [tuple(x) for x in out]


def covered(rows):
    return {p for a, b in rows for p in range(a, b + 1)}


@pytest.mark.parametrize("chunk", [1, 7, 1 << 16])
def test_positions(spark, chunk):
    x, y = some(1, 25), some(2, 25)
    fx, fy = frame(spark, x), frame(spark, y)
    cx, cy = covered(x), covered(y)
    assert ranges(algebra.union(fx, fy, chunk=chunk)) == as_ranges(cx | cy)
    assert ranges(algebra.intersect(fx, fy, chunk=chunk)) == as_ranges(cx & cy)
    assert ranges(algebra.setdiff(fx, fy, chunk=chunk)) == as_ranges(cx - cy)
    assert ranges(algebra.gaps(fx, -50, 150, chunk=chunk)) == as_ranges(set(range(-50, 151)) - cx)
    assert ranges(algebra.reduce(fx, drop_empty=True, chunk=chunk)) == as_ranges(cx)


@pytest.mark.parametrize("chunk", [5, 1 << 16])
def test_coverage(spark, chunk):
    x = some(3)
    runs = algebra.coverage(frame(spark, x), chunk=chunk).collect()
    dense = {p: r.value for r in runs for p in range(r.start, r.end + 1)}
    assert dense == {p: sum(a <= p <= b for a, b in x) for p in range(1, max(b for _, b in x) + 1)}
    ordered = sorted((r.start, r.value) for r in runs)
    assert all(v != w for (_, v), (_, w) in zip(ordered, ordered[1:], strict=False))


def test_disjoin_and_bins(spark):
    x = some(5)
    parts = ranges(algebra.disjoin(frame(spark, x), chunk=9))
    assert all(b < c for (_, b), (c, _) in zip(parts, parts[1:], strict=False))
    assert covered(parts) == covered(x)
    full = [r for r in x if r[1] >= r[0]]
    bins = {r.rid: r.bin for r in algebra.disjoint_bins(frame(spark, full)).collect()}
    for i, a in enumerate(full, 1):
        for j, b in enumerate(full, 1):
            if i < j and a[0] <= b[1] and b[0] <= a[1]:
                assert bins[i] != bins[j]


def test_a_long_island_is_coloured_piece_by_piece(spark):
    """One island over all rows, many short ones beside it, both orders of rows."""
    import heapq

    rng = random.Random(51)
    for in_order in (True, False):
        spans = [(a, a + rng.choice([-1, 0, 5, 30, 200])) for a in sorted(rng.randint(0, 900) for _ in range(600))] + [(5000 + 10 * i, 5000 + 10 * i + rng.randint(-1, 12)) for i in range(200)]
        if not in_order:
            rng.shuffle(spans)
        order = sorted(range(len(spans)), key=lambda i: (spans[i][0], 0 if in_order else spans[i][1], i))
        free, busy, top, want = [], [], 0, {}
        for i in order:
            while busy and busy[0][0] < spans[i][0]:
                heapq.heappush(free, heapq.heappop(busy)[1])
            if not free:
                top += 1
                heapq.heappush(free, top)
            want[i + 1] = heapq.heappop(free)
            heapq.heappush(busy, (spans[i][1], want[i + 1]))
        df = frame(spark, spans).unionByName(frame(spark, spans[:40], space=1))
        for piece in (7, 64, 100_000):
            got = {r.rid: r.bin for r in algebra.disjoint_bins(df, piece=piece).filter("space = 0").collect()}
            assert got == want
            if piece == 64:
                break
