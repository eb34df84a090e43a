"""How deep borders reach in, brick by brick, from all four sides of all pages at once, in whole numbers.

A brick is some lines of a side (rows for left and right, columns for top and bottom); a step is a distance from that side. Pixels become sums by brick and step in one
exchange; what follows is a row a brick and step, then a row a brick.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

SIDES = ("left", "right", "top", "bottom")


def brick_sums(px: DataFrame, width: int, height: int, brick: int, most: float) -> DataFrame:
    """(page_id, side, brick, step, s, n): sums of pages of one size, to ``most`` of the side that is gone into, one step at least."""
    x, y = F.col("x").cast("long"), F.col("y").cast("long")
    place = {"left": (y, x), "right": (y, width - 1 - x), "top": (x, y), "bottom": (x, height - 1 - y)}
    cap = {side: max(1, int((width if side in ("left", "right") else height) * most)) for side in SIDES}
    each = [F.when(step < cap[side], F.struct(F.lit(side).alias("side"), F.floor(line / brick).alias("brick"), step.alias("step"))) for side, (line, step) in place.items()]
    rows = px.select("page_id", F.col("v").cast("long").alias("v"), F.explode(F.array_compact(F.array(*each))).alias("e"))
    return rows.groupBy("page_id", "e.side", "e.brick", "e.step").agg(F.sum("v").alias("s"), F.count("v").alias("n"))


def middle(px: DataFrame, width: int, height: int) -> DataFrame:
    """(page_id, page_s, page_n): the sum of the page without a quarter at each side."""
    inner = F.col("x").between(width // 4, width - width // 4 - 1) & F.col("y").between(height // 4, height - height // 4 - 1)
    return px.groupBy("page_id").agg(F.sum(F.when(inner, F.col("v").cast("long"))).alias("page_s"), F.count(F.when(inner, F.col("v"))).alias("page_n"))


def references(sums: DataFrame, edge: int, seed: int) -> DataFrame:
    """(page_id, side, ref_s, ref_n): what a side's border looks like: the sum of the bricks whose first ``edge`` steps leave the page's mean by ``seed`` levels or more.
    A side has none if fewer than an eighth of its bricks, or than four, do: a stamp in a corner is no border."""
    first = sums.where(F.col("step") < edge).groupBy("page_id", "side", "brick").agg(F.sum("s").alias("s"), F.sum("n").alias("n"), F.first("page_s").alias("page_s"), F.first("page_n").alias("page_n"))
    seeded = F.abs(F.col("s") * F.col("page_n") - F.col("page_s") * F.col("n")) >= seed * F.col("n") * F.col("page_n")
    of = first.withColumn("seeded", seeded).groupBy("page_id", "side").agg(F.count("*").alias("bricks"), F.count_if("seeded").alias("found"), F.sum(F.when(F.col("seeded"), F.col("s"))).alias("ref_s"), F.sum(F.when(F.col("seeded"), F.col("n"))).alias("ref_n"))
    return of.where(F.col("found") >= F.greatest(F.lit(4), F.floor(F.col("bricks") / 8))).select("page_id", "side", "ref_s", "ref_n")


def depths(px: DataFrame, width: int, height: int, brick: int = 16, most: float = 0.25, strong: int = 40, seed: int = 15, edge: int = 3, gap: int = 3) -> DataFrame:
    """(page_id, side, brick, depth): steps that are border, from the side on, with breaks of up to ``gap`` steps between.

    A step of a brick is border if its mean leaves the page's by more than ``strong`` levels or, where the side has a reference, is nearer to that than to the page's.
    """
    sums = brick_sums(px, width, height, brick, most).join(middle(px, width, height).where("page_n > 0"), "page_id")
    told = sums.join(references(sums, edge, seed), ["page_id", "side"], "left")
    s, n, page_s, page_n, ref_s, ref_n = map(F.col, ("s", "n", "page_s", "page_n", "ref_s", "ref_n"))
    off = F.abs(s * page_n - page_s * n)
    nearer = (F.abs(s * ref_n - ref_s * n).cast("decimal(38,0)") * page_n.cast("decimal(18,0)")) < off.cast("decimal(38,0)") * ref_n.cast("decimal(18,0)")
    marked = told.withColumn("border", (off > strong * n * page_n) | F.coalesce(nearer, F.lit(False)))
    line = Window.partitionBy("page_id", "side", "brick").orderBy("step")
    before = F.max(F.when(F.col("border"), F.col("step"))).over(line.rowsBetween(Window.unboundedPreceding, -1))
    broken = marked.withColumn("broken", F.col("border") & (F.col("step") - F.coalesce(before, F.lit(-1)) - 1 > gap))
    open_ = broken.withColumn("over", F.bool_or("broken").over(line.rowsBetween(Window.unboundedPreceding, 0)))
    return open_.groupBy("page_id", "side", "brick").agg(F.coalesce(F.max(F.when(F.col("border") & ~F.col("over"), F.col("step") + 1)), F.lit(0)).cast("long").alias("depth"))


def settled(found: DataFrame, weak: int = 2, weak_share: float = 0.4, bridge: int = 2, around: int = 1) -> DataFrame:
    """``depths`` as a border is: weak bricks (no deeper than ``weak``, or than a share of the upper median of the side's depths) count as none; up to ``bridge`` bricks
    without depth between two with one take the mean of these, rounded down; then each takes the mean of those with a depth within ``around`` bricks, half to even."""
    side = Window.partitionBy("page_id", "side")
    usual = found.where("depth > 0").groupBy("page_id", "side").agg(F.expr("percentile_disc(0.5) WITHIN GROUP (ORDER BY depth DESC)").alias("usual"))
    least = F.greatest(F.lit(weak), F.bround(F.col("usual") * F.lit(weak_share), 0).cast("long"))
    firm = found.join(usual, ["page_id", "side"], "left").withColumn("depth", F.when(F.col("depth") > least, F.col("depth")).otherwise(0))
    order = side.orderBy("brick")
    with_ = F.when(F.col("depth") > 0, F.struct("brick", "depth"))
    seen = firm.withColumn("l", F.last(with_, True).over(order.rowsBetween(Window.unboundedPreceding, -1))).withColumn("r", F.first(with_, True).over(order.rowsBetween(1, Window.unboundedFollowing)))
    bridged = (F.col("depth") == 0) & (F.col("r.brick") - F.col("l.brick") - 1 <= bridge)
    filled = seen.withColumn("depth", F.when(bridged, F.floor((F.col("l.depth") + F.col("r.depth")) / 2)).otherwise(F.col("depth")))
    mean = F.avg(F.when(F.col("depth") > 0, F.col("depth"))).over(order.rowsBetween(-around, around))
    return filled.select("page_id", "side", "brick", F.when(F.col("depth") > 0, F.bround(mean, 0)).otherwise(0).cast("long").alias("depth"))


def sides(found: DataFrame) -> DataFrame:
    """(page_id, side, least, average): of the bricks of a side that have a depth; 0 if none has."""
    some = F.when(F.col("depth") > 0, F.col("depth"))
    return found.groupBy("page_id", "side").agg(F.coalesce(F.min(some), F.lit(0)).alias("least"), F.coalesce(F.avg(some), F.lit(0.0)).alias("average"))


def kept(by_side: DataFrame, width: int, height: int) -> DataFrame:
    """(page_id, x, y, w, h): what a cut by the least depth of each side leaves; by the average, rounded half to even, where a side has no least. The whole page if nothing would be left."""
    depth: Column = F.when(F.col("least") > 0, F.col("least")).otherwise(F.bround("average", 0)).cast("long")
    of = by_side.groupBy("page_id").agg(*[F.coalesce(F.max(F.when(F.col("side") == side, depth)), F.lit(0)).alias(side) for side in SIDES])
    some = (F.col("left") + F.col("right") < width) & (F.col("top") + F.col("bottom") < height)
    take = lambda e, other: F.when(some, e).otherwise(other).cast("long")
    return of.select("page_id", take(F.col("left"), 0).alias("x"), take(F.col("top"), 0).alias("y"), take(width - F.col("left") - F.col("right"), width).alias("w"), take(height - F.col("top") - F.col("bottom"), height).alias("h"))
