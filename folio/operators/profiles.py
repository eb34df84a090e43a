"""Operators of rows and columns: profiles, stripes, borders, splits and skew."""

from __future__ import annotations

from math import cos, radians, sin

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def ink(v: Column | str = "v", t: int = 128) -> Column:
    return (F.col(v) <= t).cast("int") if isinstance(v, str) else (v <= t).cast("int")


def profile(px: DataFrame, axis: str) -> DataFrame:
    """Sum, count, mean and deviation of each row (``y``) or column (``x``), and its ink."""
    return px.groupBy("page_id", F.col(axis).alias("i")).agg(F.sum("v").alias("s"), F.count("*").alias("n"), F.sum(ink()).alias("ink"), F.sum(F.col("v") * F.col("v")).alias("s2"))


def moving(profiles: DataFrame, r: int) -> DataFrame:
    """The moving average, cut off at the edges, as exact numerator and denominator."""
    w = Window.partitionBy("page_id").orderBy("i").rowsBetween(-r, r)
    return profiles.withColumns({"near": F.sum("ink").over(w), "near_n": F.count("*").over(w)})


def stripes(px: DataFrame, axis: str = "y", k: float = 3.0, window: int = 3) -> DataFrame:
    """Rows (or columns) whose mean leaves the moving average by more than ``k`` times the mean departure."""
    w = Window.partitionBy("page_id").orderBy("i").rowsBetween(-(window // 2), window // 2)
    p = profile(px, axis).withColumn("mean", F.col("s") / F.col("n"))
    p = p.withColumn("off", F.abs(F.col("mean") - F.avg("mean").over(w)))
    usual = F.avg("off").over(Window.partitionBy("page_id"))
    return p.withColumn("striped", F.round(F.col("off"), 9) > F.round(k * usual, 9)).select("page_id", "i", "striped")


def remove_stripes(px: DataFrame, axis: str = "y", k: float = 3.0, window: int = 3) -> DataFrame:
    """Striped rows take the pixels of the nearest clean row, the one before of equals; pages without clean rows stay."""
    marked = stripes(px, axis, k, window)
    up, down = Window.partitionBy("page_id").orderBy("i").rowsBetween(Window.unboundedPreceding, 0), Window.partitionBy("page_id").orderBy("i").rowsBetween(0, Window.unboundedFollowing)
    clean = F.when(~F.col("striped"), F.col("i"))
    near = marked.withColumns({"a": F.last(clean, True).over(up), "b": F.first(clean, True).over(down)})
    source = F.coalesce(F.when(F.col("b").isNull() | (F.col("i") - F.col("a") <= F.col("b") - F.col("i")), F.col("a")), F.col("b"), F.col("i"))
    moves = near.select("page_id", F.col("i").alias(axis), source.alias("from"))
    other = "x" if axis == "y" else "y"
    return moves.join(px.withColumnRenamed(axis, "from"), ["page_id", "from"]).select("page_id", axis, other, "v")


def contrast_borders(px: DataFrame, width: int, height: int, contrast: int = 30, least: float = 0.4, most: float = 0.45, sample: float = 0.3) -> DataFrame:
    """Depth of the contrasting border on each side: leading rows (columns) of which over ``least`` differ from the median of the centre by more than ``contrast``, ``most`` of the side at the most."""
    x0, y0 = int(width * (1 - sample) / 2), int(height * (1 - sample) / 2)
    centre = px.where(F.col("x").between(x0, width - x0 - 1) & F.col("y").between(y0, height - y0 - 1))
    s = F.sort_array(F.collect_list("v"))
    n = F.size(s)
    median = F.floor((F.get(s, F.floor(n / 2).cast("int")) + F.get(s, F.floor((n - 1) / 2).cast("int"))) / 2)
    off = px.join(centre.groupBy("page_id").agg(median.alias("med")), "page_id").withColumn("bad", (F.abs(F.col("v") - F.col("med")) > contrast).cast("int"))
    depths = None
    for axis, length, names in (("y", height, ("top", "bottom")), ("x", width, ("left", "right"))):
        lines = off.groupBy("page_id", axis).agg(F.sum("bad").alias("bad"), F.count("*").alias("n"))
        fine = F.when(F.col("bad") <= F.col("n") * F.lit(least), F.col(axis))
        cap = round(length * most)
        side = lines.groupBy("page_id").agg(F.least(F.lit(cap), F.coalesce(F.min(fine), F.lit(length))).alias(names[0]), F.least(F.lit(cap), F.coalesce(length - 1 - F.max(fine), F.lit(length))).alias(names[1]))
        depths = side if depths is None else depths.join(side, "page_id")
    return depths


def whiten_borders(px: DataFrame, depths: DataFrame, width: int, height: int) -> DataFrame:
    inside = (F.col("y") >= F.col("top")) & (F.col("y") < height - F.col("bottom")) & (F.col("x") >= F.col("left")) & (F.col("x") < width - F.col("right"))
    return px.join(depths, "page_id").withColumn("v", F.when(inside, F.col("v")).otherwise(255))


def split_column(px: DataFrame, width: int, window: int = 3, band: tuple[float, float] = (0.4, 0.6)) -> DataFrame:
    """The column of least smoothed ink in the central band, the most central of equals, then the first."""
    lo, hi = int(width * band[0]), int(width * band[1])
    columns = moving(profile(px, "x"), window // 2).where(F.col("i").between(lo, hi))
    order = Window.partitionBy("page_id").orderBy(F.col("near") / F.col("near_n"), F.abs(2 * F.col("i") - (width - 1)), "i")
    return columns.withColumn("nth", F.row_number().over(order)).where("nth = 1").select("page_id", F.col("i").alias("split_x"), "near", "near_n")


def ink_band(px: DataFrame, low: float = 0.02, high: float = 0.98) -> DataFrame:
    """First columns at which the running share of ink reaches ``low`` and ``high``; pages without ink are left out."""
    run = Window.partitionBy("page_id").orderBy("i").rowsBetween(Window.unboundedPreceding, 0)
    p = profile(px, "x").withColumns({"cum": F.sum("ink").over(run), "total": F.sum("ink").over(Window.partitionBy("page_id"))}).where("total > 0")
    first = lambda share: F.min(F.when(F.col("cum") >= F.col("total") * F.lit(share), F.col("i")))
    return p.groupBy("page_id").agg(first(low).alias("band_start"), first(high).alias("band_end"))


def dense_rect(px: DataFrame, least: float = 0.65) -> DataFrame:
    """First and last rows and columns of which at least ``least`` of the densest is inked."""
    sides = []
    for axis, names in (("y", ("top", "bottom")), ("x", ("left", "right"))):
        p = profile(px, axis).withColumn("most", F.max("ink").over(Window.partitionBy("page_id")))
        full = F.when((F.col("ink") > 0) & (F.col("ink") >= F.col("most") * F.lit(least)), F.col("i"))
        sides.append(p.groupBy("page_id").agg(F.min(full).alias(names[0]), F.max(full).alias(names[1])))
    return sides[0].join(sides[1], "page_id")


def text_rows(px: DataFrame, width: int) -> DataFrame:
    """Rows that hold more ink than a fortieth of the width, and than ``1`` pixel."""
    return profile(px, "y").select("page_id", "i", (F.col("ink") > max(1, width / 40)).alias("text_row"))


def moments_angle(px: DataFrame, least: int = 5) -> DataFrame:
    """Skew by central moments of the ink, in degrees: half the atan2 of 2 m11 and m20 - m02; pages of less ink are left out."""
    dots = px.where(ink() == 1)
    m = dots.groupBy("page_id").agg(*[F.sum(c.cast("bigint")).alias(n) for n, c in (("m00", F.lit(1)), ("m10", F.col("x")), ("m01", F.col("y")), ("m11", F.col("x") * F.col("y")), ("m20", F.col("x") * F.col("x")), ("m02", F.col("y") * F.col("y")))])
    c11 = F.col("m00") * F.col("m11") - F.col("m10") * F.col("m01")
    c20, c02 = F.col("m00") * F.col("m20") - F.col("m10") * F.col("m10"), F.col("m00") * F.col("m02") - F.col("m01") * F.col("m01")
    return m.where(F.col("m00") >= least).select("page_id", "m00", F.degrees(0.5 * F.atan2((2 * c11).cast("double"), (c20 - c02).cast("double"))).alias("angle"))


def normal_angle(a: Column) -> Column:
    """Within (-45, 45]; under 0.005 it is 0."""
    turned = F.when(a > 45, a - 90).when(a <= -45, a + 90).otherwise(a)
    return F.when(F.abs(turned) < 0.005, 0.0).otherwise(turned)


def projection_scores(px: DataFrame, angles: list[float]) -> DataFrame:
    """For each page and angle the variance of the row sums of the turned ink: a few angles a pixel, summed map-side."""
    turns = F.explode(F.array(*[F.struct(F.lit(a).alias("angle"), F.lit(cos(radians(a))).alias("c"), F.lit(sin(radians(a))).alias("s")) for a in angles])).alias("t")
    dots = px.where(ink() == 1).select("page_id", "y", "x", turns)
    row = F.floor(F.round(F.col("y") * F.col("t.c") - F.col("x") * F.col("t.s") + 0.5, 9)).cast("int")
    rows = dots.groupBy("page_id", F.col("t.angle").alias("angle"), row.alias("row")).agg(F.count("*").alias("n"))
    return rows.groupBy("page_id", "angle").agg(F.sum(F.col("n") * F.col("n")).alias("energy"))


def projection_angle(px: DataFrame, angles: list[float]) -> DataFrame:
    """The angle of greatest energy, the smallest turn of equals."""
    order = Window.partitionBy("page_id").orderBy(F.col("energy").desc(), F.abs("angle"), "angle")
    return projection_scores(px, angles).withColumn("nth", F.row_number().over(order)).where("nth = 1").select("page_id", "angle", "energy")


def consensus(candidates: DataFrame, gap: float = 1.5) -> DataFrame:
    """Clusters of angles (page_id, angle, weight) no further apart than ``gap``; of the best supported the weighted mean."""
    by = Window.partitionBy("page_id").orderBy("angle", "weight")
    island = F.sum((F.col("angle") - F.lag("angle").over(by) > gap).cast("int")).over(by.rowsBetween(Window.unboundedPreceding, 0))
    groups = candidates.withColumn("island", F.coalesce(island, F.lit(0))).groupBy("page_id", "island").agg(F.count("*").alias("support"), F.sum("weight").alias("weight"), (F.sum(F.col("angle") * F.col("weight")) / F.sum("weight")).alias("angle"), (F.max("angle") - F.min("angle")).alias("wide"))
    best = Window.partitionBy("page_id").orderBy(F.col("support").desc(), F.col("weight").desc(), "wide", "island")
    return groups.withColumn("nth", F.row_number().over(best)).where("nth = 1").select("page_id", "support", "angle")


def pca_angle(px: DataFrame, below: int = 128, least: int = 50) -> DataFrame:
    """(page_id, n, angle in degrees, confidence) of the main axis of the ink; pages of fewer than ``least`` ink pixels have no row."""
    x, y = F.col("x").cast("double"), F.col("y").cast("double")
    sums = px.where(F.col("v") < below).groupBy("page_id").agg(F.count("*").alias("n"), *[F.sum(c).alias(k) for c, k in ((x, "sx"), (y, "sy"), (x * x, "sxx"), (y * y, "syy"), (x * y, "sxy"))])
    n = F.col("n")
    spread = lambda ab, a, b: F.col(ab) / n - (F.col(a) / n) * (F.col(b) / n)
    half = F.atan2(2 * spread("sxy", "sx", "sy"), spread("sxx", "sx", "sx") - spread("syy", "sy", "sy")) / 2
    angle = F.degrees(half)
    unit = lambda c: F.least(F.lit(1.0), F.greatest(F.lit(0.0), c))
    sure = 0.35 * unit(F.log1p(n.cast("double")) / F.log1p(F.lit(20000.0))) * (0.5 + 0.5 * unit((25.0 - F.abs(angle)) / 25.0))
    return sums.where(n >= least).select("page_id", "n", angle.alias("angle"), sure.alias("confidence"))


def lightness_columns(px: DataFrame, light: Column) -> DataFrame:
    """(page_id, x, mean, deviation) of the lightness of each column (of the population)."""
    return px.groupBy("page_id", "x").agg(F.avg(light).alias("mean"), F.stddev_pop(light).alias("deviation"))
