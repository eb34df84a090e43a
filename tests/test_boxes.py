"""Joined boxes against plain versions: random pages, heaps, chains, and pages that are painted."""

import random

import numpy as np
import pytest

from folio.kernels.components import labelled
from folio.kernels.masks import merged_boxes
from folio.operators import boxes

COLUMNS = "page_id long, x long, y long, w long, h long"


def rows_of(df):
    out = {}
    for r in df.collect():
        out.setdefault(r.page_id, []).append((r.x, r.y, r.w, r.h))
    return {p: sorted(v) for p, v in out.items()}


def some(seed, n, size, longest):
    rng = random.Random(seed)
    return [(rng.randrange(-5, size), rng.randrange(-5, size), rng.randint(1, longest), rng.randint(1, longest)) for _ in range(n)]


@pytest.mark.parametrize("gap", [0, 30])
def test_merged(spark, gap):
    pages = {p: some(p, n, size, longest) for p, (n, size, longest) in enumerate([(60, 400, 12), (40, 4000, 900), (80, 1000, 30), (1, 10, 5), (30, 60, 60)])}
    pages[9] = [(4 * i, 2 * i, 4, 1) for i in range(100)]  # a chain
    pages[10] = [(i % 3, i // 3, 50, 40) for i in range(30)] + [(500, 500, 1, 1)]  # a heap
    rows = [(p, *b) for p, bs in pages.items() for b in bs] * 2 + [(None, 1, 1, 1, 1), (7, None, 1, 1, 1), (7, 1, 1, 0, 1)]
    assert rows_of(boxes.merged(spark.createDataFrame(rows, COLUMNS).repartition(5), gap)) == {p: merged_boxes(b, gap, 2.0, -1.0) for p, b in pages.items()}


def test_merged_by_centres(spark):
    def plain(left, gap, share):
        left = merged_boxes(left, gap, 2.0, -1.0)
        near = lambda a, b: (2 * a[0] + a[2] - 2 * b[0] - b[2]) ** 2 + (2 * a[1] + a[3] - 2 * b[1] - b[3]) ** 2 < (2 * share * max(a[2], a[3], b[2], b[3])) ** 2
        groups = []
        for b in left:
            mine = [g for g in groups if any(near(b, c) for c in g)]
            groups = [g for g in groups if g not in mine] + [[b, *[c for g in mine for c in g]]]
        new = [(min(b[0] for b in g), min(b[1] for b in g), max(b[0] + b[2] for b in g) - min(b[0] for b in g), max(b[1] + b[3] for b in g) - min(b[1] for b in g)) for g in groups]
        return sorted(left) if len(new) == len(left) else plain(new, gap, share)

    pages = {p: some(50 + p, 40, 3000, 400) for p in range(4)}
    pages[4] = [(0, 0, 100, 10), (0, 64, 100, 10), (300, 0, 10, 10)]  # centres 64 apart
    rows = [(p, *b) for p, bs in pages.items() for b in bs]
    for share in (0.6,):
        assert rows_of(boxes.merged(spark.createDataFrame(rows, COLUMNS), 2, share)) == {p: plain(b, 2, share) for p, b in pages.items()}
    assert len(rows_of(boxes.merged(spark.createDataFrame(rows, COLUMNS), 2, 0.6))[4]) == 3
    with pytest.raises(ValueError, match="gap"):
        boxes.merged(spark.createDataFrame(rows, COLUMNS), -1)


def test_hot_page_is_many_tasks(spark):
    """A page of 100,000 boxes in small heaps: neither a pair for each two nor one task."""
    rows = spark.range(100_000).selectExpr("1L AS page_id", "(id div 10 % 100) * 21 + id % 3 AS x", "(id div 1000) * 21 + id % 4 AS y", "10L + id % 2 AS w", "8L AS h")
    heaps = boxes.heaped(boxes.whole(rows))
    assert heaps.count() < 40_000
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        sizes = [n for (n,) in boxes.near(heaps, 2).selectExpr("spark_partition_id() AS p").groupBy("p").count().select("count").collect()]
    finally:
        spark.conf.unset("spark.sql.adaptive.enabled")
    assert len(sizes) == 8 and max(sizes) < 2 * sum(sizes) / 8
    out = rows_of(boxes.merged(rows, 2))[1]
    assert len(out) == 10_000 and {b[2:] for b in out} <= {(w, h) for w in (11, 12, 13) for h in (8, 9, 10, 11)}


def test_empty(spark):
    none = spark.createDataFrame([], COLUMNS + ", label string")
    assert boxes.merged(none, 5).count() == boxes.merged(none, 5, 0.6).count() == boxes.inflated(none, 90, 90).count() == 0


def test_inflated(spark):
    width, height = 900, 300
    pages = {p: [(x, y, w, h) for x, y, w, h in some(80 + p, n, 880, longest)] for p, (n, longest) in enumerate([(25, 60), (2, 90), (40, 20), (30, 200)])}
    rows = [(p, *b) for p, bs in pages.items() for b in bs]
    got = rows_of(boxes.inflated(spark.createDataFrame(rows * 2, COLUMNS), width, height, 4, 0.15, 2))
    want = {}
    for p, bs in pages.items():
        bs = sorted(set(bs))
        mask = np.zeros((height, width), bool)
        for x, y, w, h in bs:
            extra = round(max(4, max(w, h) * 0.15))
            x, y, w, h = max(0, x - extra), max(0, y - extra), w + 2 * extra, h + 2 * extra
            mask[y : y + min(height - y, h) if y < height else y, x : x + min(width - x, w) if x < width else x] = True
        k = max(3, min(max(width, height) // 200, 31))
        if len(bs) >= 3:
            typical = max(sorted(b[2] for b in bs)[len(bs) // 2], sorted(b[3] for b in bs)[len(bs) // 2])
            k = max(3, min(max(3, typical // 4), k))
        for _ in range(2):
            wide = np.zeros_like(mask)
            for dy in range(k):
                for dx in range(k):
                    sy, sx = dy - k // 2, dx - k // 2  # a pixel is set where one of those at these offsets is
                    part = mask[max(0, sy) : height + min(0, sy), max(0, sx) : width + min(0, sx)]
                    wide[max(0, -sy) : max(0, -sy) + part.shape[0], max(0, -sx) : max(0, -sx) + part.shape[1]] |= part
            mask = wide
        names = labelled(mask)
        found = []
        for name in np.unique(names[mask]):
            ys, xs = np.nonzero(names == name)
            if np.ptp(xs) >= 2 and np.ptp(ys) >= 2:
                found.append((xs.min(), ys.min(), np.ptp(xs) + 1, np.ptp(ys) + 1))
        if found:
            want[p] = sorted(tuple(map(int, b)) for b in found)
    assert got == want


def test_inflated_on_large_pages(spark):
    """A page of 100,000,000 lines: its boxes are the work, not its pixels."""
    far = 50_000_000
    rows = [(1, 0, 0, far, far), (1, 100_000, far + 40_000_000, 10, 10), (1, far + 45_000_000, 5, 10, 10)]
    got = rows_of(boxes.inflated(spark.createDataFrame(rows, COLUMNS), 2 * far, 2 * far, 12, 0.0, 1))
    painted = lambda x, y, w, h: (max(0, max(0, x - 12) - (k - 1 - k // 2)), max(0, max(0, y - 12) - (k - 1 - k // 2)), max(0, x - 12) + w + 24 + k // 2, max(0, y - 12) + h + 24 + k // 2)
    k = max(3, min(max(3, 10 // 4), 31))
    want = sorted((l, t, r - l, b - t) for l, t, r, b in (painted(*row[1:]) for row in rows))
    assert got == {1: want}
