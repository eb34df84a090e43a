"""Border colours of frames that are drawn, and groups against a plain version."""

import random

from folio.operators import colour_groups as groups

PX = "page_id long, y int, x int, b int, g int, r int"


def drawn(page, size, colour):
    return [(page, y, x, *colour(y, x)) for y in range(size) for x in range(size)]


def plain(colours, rounds=10):
    a, z = ([16 * c for c in pick(colours, key=lambda q: (sum(q), *q))] for pick in (min, max))
    for _ in range(rounds):
        far = lambda q, m: sum((16 * c - k) ** 2 for c, k in zip(q, m))
        one = [q for q in colours if far(q, a) <= far(q, z)]
        two = [q for q in colours if far(q, a) > far(q, z)]
        mean = lambda some, old: [(32 * sum(q[i] for q in some) + len(some)) // (2 * len(some)) for i in range(3)] if some else old
        new = mean(one, a), mean(two, z)
        if new == (a, z):
            break
        a, z = new
    far = lambda q, m: sum((16 * c - k) ** 2 for c, k in zip(q, m))
    n = sum(far(q, a) <= far(q, z) for q in colours)
    return (*a, n, *z, len(colours) - n)


def test_border_colours(spark):
    """Page 1: an even frame; 2: dark left and top, light rest; 3: of one colour; the inside is never looked at."""
    rng = random.Random(2)
    inner = lambda y, x: 1 <= x <= 38 and 1 <= y <= 38
    two = lambda y, x: (9, 99, 200) if inner(y, x) else (20, 30, 40) if x == 0 and y < 30 else (200 + rng.randrange(3), 210, 220)
    px = drawn(1, 40, lambda y, x: (0, 0, 0) if inner(y, x) else (100 + x % 3, 50, 70)) + drawn(2, 40, two) + drawn(3, 40, lambda y, x: (7, 8, 9))
    samples = groups.frame(spark.createDataFrame(px, PX), 40, 40)
    assert {r.page_id: r.n for r in samples.groupBy("page_id").sum("n").withColumnRenamed("sum(n)", "n").collect()} == {1: 156, 2: 156, 3: 156}
    got = {r.page_id: (r.grouped, r.b, r.g, r.r) for r in groups.border_colours(samples).collect()}
    # The mean of page 1 is 100.5.
    assert got == {1: (False, 100, 50, 70), 2: (True, 201, 210, 220), 3: (False, 7, 8, 9)}
    found = {r.page_id: tuple(r)[1:] for r in groups.two_groups(samples).collect()}
    assert found[3] == (112, 128, 144, 156, 112, 128, 144, 0)
    assert found[2][:4] == (320, 480, 640, 30)


def test_groups_as_plain(spark):
    rng = random.Random(8)
    pages = {p: [tuple(rng.randrange(256) for _ in range(3)) for _ in range(rng.choice((1, 2, 40, 300)))] for p in range(12)}
    rows = [(p, *q, 1) for p, colours in pages.items() for q in colours]
    df = spark.createDataFrame(rows, "page_id long, b int, g int, r int, n long")
    for rounds in (0, 1, 10):
        assert {r.page_id: tuple(r)[1:] for r in groups.two_groups(df, rounds).collect()} == {p: plain(c, rounds) for p, c in pages.items()}
    assert groups.border_colours(df.limit(0)).count() == 0


def test_sampling_and_means(spark):
    px = spark.range(0, 100 * 100).selectExpr("1L as page_id", "cast(id div 100 as int) as y", "cast(id % 100 as int) as x", "cast(id % 100 as int) as b", "10 as g", "cast(id div 100 as int) as r")
    assert groups.frame(px, 100, 100, most=100).agg({"n": "sum"}).first()[0] == len({(x, y) for x in range(0, 100, 2) for y in range(0, 100, 2) if x in (0, 99) or y in (0, 99)})
    got = groups.page_and_border(px, 100, 100, 10).first()
    assert [round(got[c] * 255, 6) for c in ("page_b", "page_g", "border_g", "border_b")] == [49.0, 10.0, 10.0, 49.5]
