"""Components, holes and shapes by runs against plain searches."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from folio import rasters
from folio.operators import runs

DATA = "/root/testdata/sf0.001"


def flood(mask, steps):
    """Components of a mask: (first pixel by rows) -> set of pixels."""
    left, out = set(zip(*map(list, np.nonzero(mask)))), {}
    for start in sorted(left):
        if start not in left:
            continue
        todo, seen = [start], {start}
        left.discard(start)
        while todo:
            y, x = todo.pop()
            for dy, dx in steps:
                if (q := (y + dy, x + dx)) in left:
                    left.discard(q)
                    seen.add(q)
                    todo.append(q)
        out[start] = seen
    return out


SIDES = [(0, 1), (0, -1), (1, 0), (-1, 0)]
EIGHT = [(a, b) for a in (-1, 0, 1) for b in (-1, 0, 1) if (a, b) != (0, 0)]


def spiral(n):
    m = np.zeros((n, n), bool)
    for k in range(0, n // 2, 2):
        m[k, k : n - k] = m[n - 1 - k, k : n - k] = m[k : n - k, n - 1 - k] = m[k + 2 : n - k, k] = True
        if k + 2 < n // 2:
            m[k + 2, k : k + 3] = True
    return m


@pytest.fixture(scope="module")
def masks():
    rng = np.random.default_rng(8)
    return [rng.random((40, 150)) < 0.35, rng.random((40, 150)) < 0.6, np.zeros((40, 150), bool), np.ones((40, 150), bool), np.pad(spiral(40), ((0, 0), (0, 110))), np.indices((40, 150)).sum(0) % 2 == 0]


@pytest.fixture(scope="module")
def px(spark, masks):
    rows = [(p, y, x, 0 if m[y, x] else 255) for p, m in enumerate(masks) for y in range(40) for x in range(150)]
    return spark.createDataFrame(rows, "page_id long, y int, x int, v int").repartition(6).cache()


def test_components(px, masks):
    got = {(r.page_id, r.top, r.first_x): (r.area, r.left_x, r.right_x, r.bottom) for r in runs.components(runs.labelled(px, F.col("v") == 0)).collect()}
    want = {}
    for p, m in enumerate(masks):
        for (y, x), of in flood(m, EIGHT).items():
            want[p, y, x] = (len(of), min(b for _, b in of), max(b for _, b in of), max(a for a, _ in of))
    assert got == want


def test_holes(spark, px, masks):
    heights = spark.createDataFrame([(p, 40) for p in range(len(masks))], "page_id long, height int")
    got = {(r.page_id, r.y, x) for r in runs.holes(px, F.col("v") == 0, 150, heights).collect() for x in range(r.x0, r.x1 + 1)}
    want = {(p, *q) for p, m in enumerate(masks) for of in flood(~m, SIDES).values() if not any(y in (0, 39) or x in (0, 149) for y, x in of) for q in of}
    assert got == want and want


def test_shapes(px, masks):
    got = {(r.page_id, r.label // runs.ROW, r.label % runs.ROW): r for r in runs.shapes(runs.labelled(px, F.col("v") == 0)).collect()}
    n = 0
    for p, m in enumerate(masks):
        for start, of in flood(m, EIGHT).items():
            r = got[(p, *start)]
            alone = np.ones((42, 152), bool)
            for y, x in of:
                alone[y + 1, x + 1] = False
            assert (r.area, r.perimeter, r.n_holes) == (len(of), sum((y + a, x + b) not in of for y, x in of for a, b in SIDES), len(flood(alone, SIDES)) - 1)
            n += 1
    assert n == len(got)


def test_whole_text_pages(spark):
    """Pages of full size: components of the letters of all documents, as a search finds them."""
    texts = rasters.text_pages(spark, DATA).where("page_id < 12")
    got = {(r.page_id, r.top, r.first_x, r.area) for r in runs.components(runs.labelled(texts, F.col("v") > 64)).collect()}
    want = set()
    by_page = {}
    for r in texts.select("page_id", "y", "x", "v").collect():
        by_page.setdefault(r.page_id, []).append((r.y, r.x, r.v))
    for p, points in by_page.items():
        m = np.zeros((max(y for y, _, _ in points) + 1, 64), bool)
        for y, x, v in points:
            m[y, x] = v > 64
        want |= {(p, y, x, len(of)) for (y, x), of in flood(m, EIGHT).items()}
    assert got == want and len(want) > 12


def test_nothing(px):
    assert runs.components(runs.labelled(px.where("page_id < 0"), F.col("v") == 0)).count() == 0
    assert runs.shapes(runs.labelled(px.where("page_id = 2"), F.col("v") == 0)).count() == 0
