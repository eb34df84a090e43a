"""Components and shapes of pages of any size without a task a page: runs of pixels, joins of neighbouring rows, and contraction by rounds.

A page is its runs (page_id, y, x0, x1), x1 included. Runs of neighbouring rows that touch, corners too, are links; components come from rounds of grouped minima over
all pages at once, each round written to the checkpoint folder. Holes are components of the ground that don't reach the edge of the page. Shapes are counted from the 2x2
windows that a component's pixels make, so neither outlines are followed nor neighbours looked up.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from folio.sources.steps import cut

CELL = 64  # columns that runs share a key by
ROW = 2**31  # a place as one number: y * ROW + x


def runs(px: DataFrame, on: Column) -> DataFrame:
    """(page_id, y, x0, x1): the longest stretches of pixels that are ``on``."""
    row = Window.partitionBy("page_id", "y").orderBy("x")
    marked = px.where(on).select("page_id", F.col("y").cast("long").alias("y"), F.col("x").cast("long").alias("x")).withColumn("island", F.col("x") - F.row_number().over(row))
    return marked.groupBy("page_id", "y", "island").agg(F.min("x").alias("x0"), F.max("x").alias("x1")).drop("island")


def touching(found: DataFrame, corners: bool = True) -> DataFrame:
    """(page_id, a, b): runs of neighbouring rows that touch, as places of their first pixels. They meet by the cells of columns that they reach, so a long row isn't squared."""
    reach = 1 if corners else 0
    cells = lambda low, high: F.explode(F.sequence(F.floor(low / CELL), F.floor(high / CELL)))
    place = F.col("y") * ROW + F.col("x0")
    above = found.select("page_id", (F.col("y") + 1).alias("y"), place.alias("a"), F.col("x0").alias("l"), F.col("x1").alias("r"), cells(F.col("x0") - reach, F.col("x1") + reach).alias("cell"))
    below = found.select("page_id", "y", place.alias("b"), "x0", "x1", cells(F.col("x0"), F.col("x1")).alias("cell"))
    met = above.join(below, ["page_id", "y", "cell"]).where((F.col("x0") <= F.col("r") + reach) & (F.col("x1") >= F.col("l") - reach))
    return met.select("page_id", "a", "b").distinct()


def contracted(links: DataFrame) -> DataFrame:
    """(page_id, node, root): of each node with links (page_id, a, b) the least node that it reaches. Rounds until nothing changes."""
    edges = cut(links.where("a <> b").select("page_id", F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct())
    weight = lambda e: tuple(e.agg(F.count("*"), F.sum(F.xxhash64("page_id", "u", "v").cast("decimal(38,0)"))).first())
    before = weight(edges)
    while before[0]:
        both = edges.unionByName(edges.select("page_id", F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("page_id", "u").agg(F.min("v").alias("m")).select("page_id", "u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(least, ["page_id", "u"]).select("page_id", F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        lesser = large.groupBy("page_id", "u").agg(F.min("v").alias("m"))
        pairs = F.explode(F.array(F.struct(F.col("v").alias("u"), F.col("m").alias("v")), F.struct("u", F.col("m").alias("v")))).alias("e")
        edges = cut(large.join(lesser, ["page_id", "u"]).select("page_id", pairs).select("page_id", "e.u", "e.v").where("u <> v").distinct())
        after = weight(edges)
        if after == before:
            break
        before = after
    return edges.select("page_id", F.col("u").alias("node"), F.col("v").alias("root")).unionByName(edges.select("page_id", F.col("v").alias("node"), F.col("v").alias("root")).distinct())


def labelled(px: DataFrame, on: Column, corners: bool = True) -> DataFrame:
    """(page_id, y, x0, x1, label): runs with the place of the first pixel, by rows, of their component."""
    return rooted(runs(px, on), corners)


def rooted(found: DataFrame, corners: bool = True) -> DataFrame:
    """``labelled`` for runs that are there already; those of a row are apart from each other."""
    found = cut(found)
    roots = contracted(touching(found, corners))
    node = F.col("y") * ROW + F.col("x0")
    return found.withColumn("node", node).join(roots, ["page_id", "node"], "left").select("page_id", "y", "x0", "x1", F.coalesce("root", "node").alias("label"))


def components(rows: DataFrame) -> DataFrame:
    """(page_id, top, first_x, area, left_x, right_x, bottom): each component of ``labelled`` runs, named by its first pixel."""
    of = rows.groupBy("page_id", "label").agg(F.sum(F.col("x1") - F.col("x0") + 1).alias("area"), F.min("x0").alias("left_x"), F.max("x1").alias("right_x"), F.max("y").alias("bottom"))
    return of.select("page_id", F.floor(F.col("label") / ROW).alias("top"), (F.col("label") % ROW).alias("first_x"), "area", "left_x", "right_x", "bottom")


def holes(px: DataFrame, on: Column, width: int, heights: DataFrame) -> DataFrame:
    """Runs of the ground that is enclosed: components (sides only) of what isn't ``on`` that reach no edge. heights: page_id, height."""
    ground = labelled(px, ~on, corners=False)
    edged = ground.join(heights, "page_id").withColumn("open", (F.col("x0") == 0) | (F.col("x1") == width - 1) | (F.col("y") == 0) | (F.col("y") == F.col("height") - 1))
    closed = edged.groupBy("page_id", "label").agg(F.bool_or("open").alias("open")).where("not open").select("page_id", "label")
    return ground.join(closed, ["page_id", "label"]).select("page_id", "y", "x0", "x1", "label")


#: Patterns of a 2x2 window (bits: upper left 1, upper right 2, lower left 4, lower right 8) by how many pixels they hold; two across are their own kind.
ONE, TWO, THREE, ACROSS = (1, 2, 4, 8), (3, 5, 10, 12), (7, 11, 13, 14), (6, 9)


def shapes(rows: DataFrame) -> DataFrame:
    """(page_id, label, area, perimeter, euler, n_holes, circularity) of ``labelled`` runs, from the patterns of their 2x2 windows.

    perimeter counts sides of pixels; euler is components less holes where corners connect; circularity is 4 pi area / perimeter squared.
    """
    pixels = rows.select("page_id", "label", "y", F.explode(F.sequence("x0", "x1")).alias("x"))
    corners = F.explode(F.array(*[F.struct((F.col("y") + dy).alias("wy"), (F.col("x") + dx).alias("wx"), F.lit(bit).alias("bit")) for dy, dx, bit in ((0, 0, 8), (0, 1, 4), (1, 0, 2), (1, 1, 1))])).alias("c")
    windows = pixels.select("page_id", "label", corners).groupBy("page_id", "label", "c.wy", "c.wx").agg(F.sum("c.bit").alias("pattern"))
    n = lambda of: F.count_if(F.col("pattern").isin(*of))
    counted = windows.groupBy("page_id", "label").agg(n(ONE).alias("q1"), n(TWO).alias("q2"), n(THREE).alias("q3"), n(ACROSS).alias("qd"), F.count_if(F.col("pattern") == 15).alias("q4"))
    area = (F.col("q1") + 2 * F.col("q2") + 3 * F.col("q3") + 4 * F.col("q4") + 2 * F.col("qd")) / 4
    perimeter = F.col("q1") + F.col("q2") + F.col("q3") + 2 * F.col("qd")
    euler = (F.col("q1") - F.col("q3") - 2 * F.col("qd")) / 4
    out = counted.select("page_id", "label", area.cast("long").alias("area"), perimeter.alias("perimeter"), euler.cast("long").alias("euler"))
    return out.withColumn("n_holes", 1 - F.col("euler")).withColumn("circularity", 4 * math.pi * F.col("area") / (F.col("perimeter") * F.col("perimeter")))


def stamps(found: DataFrame, least_area: int, round_: float, most_holes: int | None = None) -> DataFrame:
    """Of ``shapes``, those that a stamp may be: large and round, with few holes."""
    out = found.where((F.col("area") >= least_area) & (F.col("circularity") >= round_))
    return out if most_holes is None else out.where(F.col("n_holes") <= most_holes)
