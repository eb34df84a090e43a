"""Depths of borders that are drawn, side by side, and the settling of bricks against plain lists."""

import random

from folio.operators import bricks

PX = "page_id long, y int, x int, v int"


def by_side(df):
    out = {}
    for r in df.orderBy("page_id", "side", "brick").collect():
        out.setdefault((r.page_id, r.side), []).append(r.depth)
    return out


def test_depths(spark):
    """Left: 6 deep, a break of two, 3 more; right: 4 deep, in the lower half only; a dark block in the middle is no border; a page with none."""
    rng = random.Random(5)

    def v(y, x):
        if x < 6 or 8 <= x < 11 or (x >= 60 and y >= 32):
            return 20
        return 30 if 28 <= x < 36 and 28 <= y < 36 else 220 + rng.randrange(5)

    px = [(1, y, x, v(y, x)) for y in range(64) for x in range(64)] + [(2, y, x, 200) for y in range(64) for x in range(64)]
    found = bricks.depths(spark.createDataFrame(px, PX), 64, 64, 8, 0.25, gap=2)
    got = by_side(found)
    assert got[1, "left"] == [11] * 8 and got[1, "right"] == [0] * 4 + [4] * 4
    assert got[1, "top"][:2] == [16, 16] and got[1, "top"][2:7] == [0] * 5  # columns of the left border are dark as deep as one looks
    assert all(d == [0] * 8 for (p, _), d in got.items() if p == 2)
    assert by_side(bricks.depths(spark.createDataFrame(px, PX), 64, 64, 8, 0.25, gap=1))[1, "left"] == [6] * 8
    cut = bricks.kept(bricks.sides(bricks.settled(found.where("side in ('left', 'right') or page_id = 2"))), 64, 64)
    assert sorted(map(tuple, cut.collect())) == [(1, 11, 0, 49, 64), (2, 0, 0, 64, 64)]


def test_settled(spark):
    rng = random.Random(9)
    pages = {p: [rng.choice([0, 0, 1, 2, 5, 9, 10, 12, 13]) for _ in range(rng.randint(1, 30))] for p in range(60)}
    want = {}
    for p, d in pages.items():
        some = sorted(x for x in d if x)
        least = max(2, round(some[len(some) // 2] * 0.4)) if some else 2
        d = [x if x > least else 0 for x in d]
        full = list(d)
        for i, x in enumerate(d):
            left, right = [j for j in range(i) if d[j]], [j for j in range(i + 1, len(d)) if d[j]]
            if not x and left and right and right[0] - left[-1] - 1 <= 2:
                full[i] = (d[left[-1]] + d[right[0]]) // 2
        near = [[y for y in full[max(0, i - 1) : i + 2] if y] for i in range(len(full))]
        want[p, "top"] = [round(sum(n) / len(n)) if x else 0 for x, n in zip(full, near)]
    rows = [(p, "top", i, x) for p, d in pages.items() for i, x in enumerate(d)]
    found = bricks.settled(spark.createDataFrame(rows, "page_id long, side string, brick long, depth long"))
    assert by_side(found) == want
    sides = {r.page_id: (r.least, r.average) for r in bricks.sides(found).collect()}
    for p in pages:
        some = [x for x in want[p, "top"] if x]
        assert sides[p] == ((min(some), sum(some) / len(some)) if some else (0, 0.0))


def test_empty(spark):
    assert bricks.kept(bricks.sides(bricks.settled(bricks.depths(spark.createDataFrame([], PX), 64, 64))), 64, 64).isEmpty()
