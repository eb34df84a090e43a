"""Boxes joined into larger ones, all pages at once: no page is a group, and no pairs are made of boxes that lie on one heap.

Boxes are (page_id, x, y, w, h) in whole pixels; those with a null or without an area are left out, repeated ones count once.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from folio.operators import runs
from folio.sources.steps import cut

SIDES = ("x", "y", "w", "h")


def whole(boxes: DataFrame) -> DataFrame:
    """The distinct boxes that have an area."""
    return boxes.select(*[F.col(c).cast("long").alias(c) for c in ("page_id", *SIDES)]).where("page_id is not null and x is not null and y is not null and w > 0 and h > 0").distinct()


def level(e: Column) -> Column:
    """The number of binary digits of a length."""
    return F.length(F.bin(e))


def around() -> tuple[Column, ...]:
    """Aggregates for the common box of a group."""
    l, t = F.min("x"), F.min("y")
    return l.alias("x"), t.alias("y"), (F.max(F.col("x") + F.col("w")) - l).alias("w"), (F.max(F.col("y") + F.col("h")) - t).alias("h")


def heaped(boxes: DataFrame) -> DataFrame:
    """Boxes of about one size whose centres share a cell no larger than any of them overlap for sure: one sum makes them one box, without pairs."""
    lw, lh = level(F.col("w")), level(F.col("h"))
    cell = lambda at, side, of: F.floor((2 * F.col(at) + F.col(side)) / F.pow(F.lit(2.0), of))
    keyed = boxes.withColumn("lw", lw).withColumn("lh", lh).withColumn("cx", cell("x", "w", lw)).withColumn("cy", cell("y", "h", lh))
    return keyed.groupBy("page_id", "lw", "lh", "cx", "cy").agg(*around()).select("page_id", *SIDES)


def near(boxes: DataFrame, gap: int, centre: float | None = None) -> DataFrame:
    """(page_id, a, b): distinct boxes that are no further apart than ``gap`` along both axes or, with ``centre``, whose centres are nearer than that share of the longer
    side of either. A box waits in cells of its own size, stretched by how far it reaches, and smaller boxes look there: 16 cells and 4 a size at most."""
    if gap < 0 or not 0 <= (centre or 0) <= 1:
        raise ValueError(f"gap {gap} below 0, or centre {centre} not a share")
    longest = F.greatest("w", "h")
    sized = boxes.withColumn("level", level(F.greatest(longest, F.lit(gap)))).withColumn("box", F.struct(*SIDES))
    sizes = sorted(r.level for r in sized.select("level").distinct().collect())  # of 64 at most
    if not sizes:
        return sized.select("page_id", F.col("box").alias("a"), F.col("box").alias("b"))

    def cells(df: DataFrame, reach: Column) -> DataFrame:
        unit = F.pow(F.lit(2.0), F.col("level"))
        span = lambda at, side: F.explode(F.sequence(F.floor((F.col(at) - reach) / unit), F.floor((F.col(at) + F.col(side) + reach) / unit)))
        return df.withColumn("cx", span("x", "w")).withColumn("cy", span("y", "h"))

    reach = F.lit(gap) if centre is None else F.ceil(longest * centre)
    waiting = cells(sized, reach).select("page_id", "level", "cx", "cy", F.col("box").alias("b"), longest.alias("long_b"))
    levels = F.array(*[F.lit(n) for n in sizes])
    asking = sized.withColumn("own", F.col("level")).withColumn("level", F.explode(F.filter(levels, lambda n: n >= F.col("own"))))
    met = cells(asking, F.lit(0)).select("page_id", "level", "cx", "cy", F.col("box").alias("a"), longest.alias("long_a")).join(waiting, ["page_id", "level", "cx", "cy"]).where("a <> b")
    if centre is None:
        apart = lambda at, side: F.greatest(F.col(f"b.{at}") - F.col(f"a.{at}") - F.col(f"a.{side}"), F.col(f"a.{at}") - F.col(f"b.{at}") - F.col(f"b.{side}"))
        linked = (apart("x", "w") <= gap) & (apart("y", "h") <= gap)
    else:
        twice = lambda at, side: (2 * F.col(f"a.{at}") + F.col(f"a.{side}") - 2 * F.col(f"b.{at}") - F.col(f"b.{side}")).cast("double")
        most = 2 * centre * F.greatest("long_a", "long_b")
        linked = twice("x", "w") * twice("x", "w") + twice("y", "h") * twice("y", "h") < most * most
    return met.where(linked).select("page_id", "a", "b")


def joined(boxes: DataFrame, links: DataFrame) -> DataFrame:
    """One box around all that hang together by the links."""
    roots = runs.contracted(links)
    named = boxes.withColumn("node", F.struct(*SIDES)).join(roots, ["page_id", "node"], "left").withColumn("node", F.coalesce("root", "node"))
    return named.groupBy("page_id", "node").agg(*around()).select("page_id", *SIDES)


def closed(boxes: DataFrame, gap: int) -> DataFrame:
    """Distinct boxes, grown until none are within ``gap``. A round takes each box to that around all within its reach, so that chains shrink to a third or less a round."""
    left = cut(heaped(boxes))
    while True:
        links = near(left, gap)
        own = left.select("page_id", F.struct(*SIDES).alias("a"), F.struct(*SIDES).alias("b"))
        both = own.unionByName(links).unionByName(links.select("page_id", F.col("b").alias("a"), F.col("a").alias("b")))
        grown = cut(both.select("page_id", "a", "b.*").groupBy("page_id", "a").agg(*around()).withColumn("moved", F.col("a") != F.struct(*SIDES)))
        if grown.where("moved").isEmpty():
            return left
        left = cut(heaped(grown.select("page_id", *SIDES).distinct()))


def merged(boxes: DataFrame, gap: int = 30, centre: float | None = None) -> DataFrame:
    """(page_id, x, y, w, h): boxes joined into their common box until no two of a page are within ``gap``; what overlaps is within any gap.

    A larger box has every neighbour that its parts have, so the result is one, whatever the order. With ``centre`` (a share of the longer side of either) what hangs
    together by near centres is then joined at once, and both steps take turns until nothing changes. Each round is written to the checkpoint folder.
    """
    left = closed(cut(whole(boxes)), gap)
    while centre is not None:
        before = left.count()
        left = closed(joined(left, near(left, gap, centre)), gap)
        if left.count() == before:
            break
    return left


def inflated(boxes: DataFrame, width: int, height: int, padding: int = 12, share: float = 0.15, times: int = 2) -> DataFrame:
    """(page_id, x, y, w, h): around what touches, corners too, after boxes are widened and painted, in pages of one size.

    Each side grows by ``share`` of a box's longer side, ``padding`` at least, rounded half to even; a square then widens what is painted, ``times`` over: a quarter of the median box (upper
    medians; with three boxes or more) between 3 and a two-hundredth of the page, 31 at most. Rows and columns are those between two sides of painted boxes of the page, so that the work
    is that of its boxes, not of its pixels, and no more than that of its lines. Results of two pixels or less on a side go; what lies in a hole of another result stays.
    """
    most = max(3, min(max(width, height) // 200, 31))
    boxes = cut(whole(boxes))
    median = lambda side: F.expr(f"percentile_disc(0.5) WITHIN GROUP (ORDER BY {side} DESC)")
    base = F.floor(F.greatest("mw", "mh") / 4)
    square = F.when(F.col("n") >= 3, F.greatest(F.lit(3), F.least(F.greatest(F.lit(3), base), F.lit(most)))).otherwise(most)
    squares = boxes.groupBy("page_id").agg(median("w").alias("mw"), median("h").alias("mh"), F.count("*").alias("n")).select("page_id", square.cast("long").alias("k"))
    extra = F.bround(F.greatest(F.lit(float(padding)), F.greatest("w", "h") * F.lit(share)), 0).cast("long")
    back, ahead = times * (F.col("k") - 1 - F.floor(F.col("k") / 2)), times * F.floor(F.col("k") / 2)

    def side(at: str, length: str, whole: int, first: str, last: str) -> tuple[Column, Column]:
        start = F.greatest(F.lit(0), F.col(at) - F.col("extra"))
        end = start + F.least(whole - start, F.col(length) + 2 * F.col("extra"))
        # Nothing is painted where no pixel of the page is reached.
        return F.when(end > start, F.greatest(F.lit(0), start - back)).alias(first), (F.least(F.lit(whole), end + ahead) - 1).alias(last)

    grown = boxes.join(squares, "page_id").withColumn("extra", extra)
    painted = cut(grown.select("page_id", *side("x", "w", width, "x0", "x1"), *side("y", "h", height, "y0", "y1")).where("x0 is not null and y0 is not null").distinct())
    # The sides of a page, in order: no more than it has lines. Between two of them everything is alike; neighbours stay neighbours, and a gap is a place of its own.
    sides = lambda first, last: F.array_sort(F.array_distinct(F.concat(F.collect_set(first), F.collect_set(F.col(last) + 1))))
    marks = painted.groupBy("page_id").agg(sides("x0", "x1").alias("xs"), sides("y0", "y1").alias("ys"))
    place = lambda of, at: F.array_position(of, at) - 1
    placed = painted.join(marks, "page_id").select(
        "page_id", F.explode(F.sequence(place("ys", F.col("y0")), place("ys", F.col("y1") + 1) - 1)).alias("y"), place("xs", F.col("x0")).alias("x0"), (place("xs", F.col("x1") + 1) - 1).alias("x1")
    )
    rows = placed.distinct()
    line = Window.partitionBy("page_id", "y").orderBy("x0", "x1")
    fresh = F.col("x0") > F.coalesce(F.max("x1").over(line.rowsBetween(Window.unboundedPreceding, -1)) + 1, F.lit(-1))
    islands = rows.withColumn("island", F.sum(fresh.cast("long")).over(line.rowsBetween(Window.unboundedPreceding, 0)))
    stretches = islands.groupBy("page_id", "y", "island").agg(F.min("x0").alias("x0"), F.max("x1").alias("x1")).drop("island")
    found = runs.components(runs.rooted(stretches)).join(marks, "page_id")
    at = lambda of, i: F.get(of, i.cast("int"))
    x, y = at("xs", F.col("left_x")), at("ys", F.col("top"))
    out = found.select("page_id", x.alias("x"), y.alias("y"), (at("xs", F.col("right_x") + 1) - x).alias("w"), (at("ys", F.col("bottom") + 1) - y).alias("h"))
    return out.where("w > 2 and h > 2")
