"""Seams against a plain programme, ties and single rows among them."""

import random

from pyspark.sql import functions as F

from folio.operators import seams


def plain(cost):
    own, back = list(cost[0]), []
    for line in cost[1:]:
        step, new = [], []
        for i, c in enumerate(line):
            best, to = own[i], 0
            if i and own[i - 1] < best:
                best, to = own[i - 1], -1
            if i + 1 < len(own) and own[i + 1] < best:
                best, to = own[i + 1], 1
            step.append(to)
            new.append(best + c)
        own, back = new, [*back, step]
    at = own.index(min(own))
    path = [at]
    for step in reversed(back):
        at += step[at]
        path.append(at)
    return path[::-1], min(own)


def test_paths(spark):
    rng = random.Random(11)
    pages = {p: [[rng.randrange(rng.choice((2, 100))) for _ in range(w)] for _ in range(h)] for p, (w, h) in enumerate([(1, 1), (1, 6), (7, 1), (2, 9), (9, 40), (5, 200), (12, 12)])}
    pages[8] = [[0] * 4] * 5  # all the same
    rows = [(p, y + 3, x, c) for p, page in pages.items() for y, line in enumerate(page) for x, c in enumerate(line)]
    df = spark.createDataFrame(rows, "page_id long, y int, x int, cost long")
    for low in (0, 1):
        got = {r.page_id: (r.top, r.path, r.split_x, r.total) for r in seams.paths(df, low, 99).collect()}
        for p, page in pages.items():
            if len(page[0]) <= low:
                assert p not in got
                continue
            path, total = plain([line[low:] for line in page])
            path = [x + low for x in path]
            assert got[p] == (3, path, sorted(path)[len(path) // 2], total)


def test_one_exchange(spark):
    px = spark.createDataFrame([(1, 0, 0, 5)], "page_id long, y int, x int, v int")
    found = seams.paths(seams.costs(seams.by_page(px), F.col("v") < 9), 0, 5)
    assert found._jdf.queryExecution().sparkPlan().toString().count("Exchange") <= 1
    assert found._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning") == 1
    assert [tuple(r) for r in seams.steps(found).collect()] == [(1, 0, 0)]


def test_costs(spark):
    """A light gutter between dark halves is cheap, its edges are dear."""
    px = spark.createDataFrame([(1, y, x, 255 if 3 <= x <= 7 else 0) for y in range(4) for x in range(11)], "page_id long, y int, x int, v int")
    line = [r.cost for r in seams.costs(px, F.col("v") < 128).where("y = 2").orderBy("x").collect()]
    dark, edge = 17 * 255, 3 * 128  # one slope of 255 and none: 127.5, half to even
    assert line == [dark, dark, dark + edge, edge, 0, 0, 0, edge, dark + edge, dark, dark]


def test_packed_pages(spark):
    """Costs and paths of packed pages are those of exploded ones; ties are frequent."""
    rng = random.Random(5)
    sizes = [(1, 1), (1, 6), (7, 1), (2, 9), (9, 40), (9, 1), (9, 2), (5, 200), (12, 12), (9, 3)]
    pages = [(p, w, [rng.randrange(256) if p % 2 else rng.choice((0, 128, 255)) for _ in range(w * h)]) for p, (w, h) in enumerate(sizes)] + [(20, 8, [7] * 40)]
    packed = spark.createDataFrame([(p, w, bytearray(v)) for p, w, v in pages] + [(30, 4, None), (31, 4, bytearray())], "page_id long, width int, pixels binary").coalesce(1)
    px = spark.createDataFrame([(p, i // w, i % w, c) for p, w, v in pages for i, c in enumerate(v)], "page_id long, y int, x int, v int")
    cost = seams.costs(seams.by_page(px), F.col("v") <= 100)
    assert sorted(map(tuple, seams.page_costs(packed, 100).collect())) == sorted(map(tuple, cost.collect()))
    for low, high in ((0, 99), (1, 6), (3, 3)):
        got, want = ({r.page_id: tuple(r) for r in df.collect()} for df in (seams.page_paths(packed, 100, low, high), seams.paths(cost, low, high)))
        assert got == want and got


def test_queries_shuffle_nothing(spark):
    from folio import catalog_seams

    found = seams.steps(catalog_seams.found_paths(spark, "/root/testdata/sf0.001"))
    assert "Exchange" not in found._jdf.queryExecution().executedPlan().toString()
