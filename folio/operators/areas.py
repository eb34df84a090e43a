"""Operators of neighbourhoods and histograms: windows and grouped sums, partitioned by page throughout."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from folio.operators.points import saturate


def along_x(r: int, to: int | None = None):
    return Window.partitionBy("page_id", "y").orderBy("x").rowsBetween(-r, r if to is None else to)


def along_y(r: int, to: int | None = None):
    return Window.partitionBy("page_id", "x").orderBy("y").rowsBetween(-r, r if to is None else to)


def box_sums(px: DataFrame, r: int) -> DataFrame:
    """s, s2 and n of the (2r + 1)-square around each pixel, cut off at the edges, by two passes."""
    w, h = along_x(r), along_y(r)
    one = px.withColumns({"s": F.sum("v").over(w), "s2": F.sum(F.col("v") * F.col("v")).over(w), "n": F.count("v").over(w)})
    return one.withColumns({c: F.sum(c).over(h) for c in ("s", "s2", "n")})


def adaptive_mean(px: DataFrame, block: int = 3, c: float = 14) -> DataFrame:
    """White where v > mean - c; a block is odd and at least 3."""
    r = max(3, block + (block % 2 == 0)) // 2
    return box_sums(px, r).select("page_id", "y", "x", F.when(F.col("v") > F.col("s") / F.col("n") - c, 255).otherwise(0).alias("v"))


def sauvola(px: DataFrame, window: int = 25, k: float = 0.3, r: float = 180.0, boost: int = 0) -> DataFrame:
    """White where v > min(255, m (1 + k (s / r - 1)) + boost), with the population deviation s."""
    half = max(3, window + (window % 2 == 0)) // 2
    m = F.col("s") / F.col("n")
    deviation = F.sqrt(F.greatest(F.lit(0.0), F.col("s2") / F.col("n") - m * m))
    t = F.least(F.lit(255.0), m * (1 + k * (deviation / r - 1)) + boost)
    return box_sums(px, half).select("page_id", "y", "x", F.when(F.col("v") > t, 255).otherwise(0).alias("v"))


def morph(px: DataFrame, grow: bool, rx: int = 1, ry: int = 1) -> DataFrame:
    """Dilation (greatest) or erosion (least) by a rectangle, one pass an axis."""
    pick = F.max if grow else F.min
    if rx:
        px = px.withColumn("v", pick("v").over(along_x(rx)))
    return px.withColumn("v", pick("v").over(along_y(ry))) if ry else px


def opened(px: DataFrame, r: int = 1) -> DataFrame:
    return morph(morph(px, False, r, r), True, r, r)


def closed(px: DataFrame, r: int = 1) -> DataFrame:
    return morph(morph(px, True, r, r), False, r, r)


def gradient(px: DataFrame) -> DataFrame:
    """Sobel sums of both directions, replicated edges, as |gx| + |gy|."""
    before = lambda c, w: F.coalesce(F.lag(c).over(w), F.col(c))
    after = lambda c, w: F.coalesce(F.lead(c).over(w), F.col(c))
    wx, wy = Window.partitionBy("page_id", "y").orderBy("x"), Window.partitionBy("page_id", "x").orderBy("y")
    one = px.withColumns({"dx": after("v", wx) - before("v", wx), "sx": before("v", wx) + 2 * F.col("v") + after("v", wx)})
    gx = before("dx", wy) + 2 * F.col("dx") + after("dx", wy)
    gy = after("sx", wy) - before("sx", wy)
    return one.withColumn("g", F.abs(gx) + F.abs(gy)).select("page_id", "y", "x", "g")


def blur3(px: DataFrame) -> DataFrame:
    """Weights 1 2 1 both ways over sixteenths, replicated edges, half to even."""
    near = lambda c, w: F.coalesce(F.lag(c).over(w), F.col(c)) + 2 * F.col(c) + F.coalesce(F.lead(c).over(w), F.col(c))
    wx, wy = Window.partitionBy("page_id", "y").orderBy("x"), Window.partitionBy("page_id", "x").orderBy("y")
    return px.withColumn("h", near("v", wx)).withColumn("t", near("h", wy)).select("page_id", "y", "x", saturate(F.col("t") / 16.0).alias("v"))


def histogram(px: DataFrame) -> DataFrame:
    """page_id, v, n and the running count, for levels that occur."""
    counts = px.groupBy("page_id", "v").agg(F.count("*").alias("n"))
    run = Window.partitionBy("page_id").orderBy("v")
    return counts.withColumn("cum", F.sum("n").over(run.rowsBetween(Window.unboundedPreceding, 0)))


def otsu(px: DataFrame) -> DataFrame:
    """The threshold of greatest variance between classes, the first of equals; exact integers. A flat page has its own level.

    With w pixels up to t, of sum m, of n and s in all: (s w - m n)^2 / (w (n - w)) is compared.
    """
    h = px.groupBy("page_id", "v").agg(F.count("*").alias("c"))
    run, page = Window.partitionBy("page_id").orderBy("v").rowsBetween(Window.unboundedPreceding, 0), Window.partitionBy("page_id")
    h = h.withColumns({"w": F.sum("c").over(run), "m": F.sum(F.col("c") * F.col("v")).over(run), "n": F.sum("c").over(page), "s": F.sum(F.col("c") * F.col("v")).over(page)})
    apart = (F.col("s") * F.col("w") - F.col("m") * F.col("n")).cast("double")
    h = h.withColumn("between", F.when(F.col("w") < F.col("n"), apart * apart / (F.col("w") * (F.col("n") - F.col("w"))).cast("double")).otherwise(0.0))
    rank = F.row_number().over(page.orderBy(F.col("between").desc(), "v"))
    return h.withColumn("nth", rank).where("nth = 1").select("page_id", F.col("v").alias("t"))


def binary_pages(px: DataFrame) -> DataFrame:
    """Whether a page holds black and white only, and its threshold otherwise."""
    kinds = px.groupBy("page_id").agg(F.min(F.col("v").isin(0, 255)).alias("is_binary"))
    return kinds.join(otsu(px), "page_id").select("page_id", "is_binary", F.when(~F.col("is_binary"), F.col("t")).alias("t"))


def black_white_points(px: DataFrame, black: float = 1.0, white: float = 95.0) -> DataFrame:
    """First levels whose running share reaches the given percents; 0 and 255 where they don't part."""
    total = F.sum("n").over(Window.partitionBy("page_id"))
    h = histogram(px).withColumn("total", total)
    first = lambda p: F.min(F.when(F.col("cum") >= F.col("total") * F.lit(p / 100), F.col("v")))
    points = h.groupBy("page_id").agg(first(black).alias("lo"), first(white).alias("hi"))
    parted = F.col("hi") > F.col("lo")
    return points.select("page_id", F.when(parted, F.col("lo")).otherwise(0).alias("lo"), F.when(parted, F.col("hi")).otherwise(255).alias("hi"))


def levels(px: DataFrame, black: float = 1.0, white: float = 95.0, gamma: float = 0.85, target: int = 255) -> DataFrame:
    """Levels and gamma between the points of each page."""
    share = F.least(F.lit(1.0), F.greatest(F.lit(0.0), (F.col("v") - F.col("lo")) / (F.col("hi") - F.col("lo")).cast("double")))
    return px.join(black_white_points(px, black, white), "page_id").select("page_id", "y", "x", saturate(F.pow(share, F.lit(gamma)) * target).alias("v"))


def median_of(c: Column | str, kind: str = "upper") -> Column:
    """Three medians of a group: the upper one, the mean of two, the truncated mean of two."""
    s = F.sort_array(F.collect_list(c))
    n = F.size(s)
    hi, lo = F.get(s, F.floor(n / 2).cast("int")), F.get(s, F.floor((n - 1) / 2).cast("int"))
    return {"upper": hi, "mean": (hi + lo) / 2.0, "truncated": F.floor((hi + lo) / 2)}[kind]


def local_equalised(px: DataFrame, width: int, height: int, grid: int = 2, clip: float = 4.0) -> DataFrame:
    """Contrast-limited equalisation of tiles, blended between the four nearest tile centres; exact integers.

    A tile's counts above ``clip`` times the mean of its 256 levels (1 at least) are spread over all levels. Levels of a
    tile become round(255 (clipped running count + share of the excess) / pixels). Tables have 256 rows a tile.
    Pages without any level in 1..254 stay as they are. The last tiles of a side are smaller where ``grid`` doesn't divide it.
    """
    tw, th = -(-width // grid), -(-height // grid)
    across, down = -(-width // tw), -(-height // th)
    tiles = px.groupBy("page_id", F.floor(F.col("x") / tw).cast("int").alias("tx"), F.floor(F.col("y") / th).cast("int").alias("ty"))
    counts = tiles.agg(*[F.count_if(F.col("v") == 0).alias("zero")]).drop("zero")
    levels_ = counts.withColumn("v", F.explode(F.sequence(F.lit(0), F.lit(255))))
    found = tiles.agg(F.collect_list("v").alias("vs")).withColumn("v", F.explode("vs")).groupBy("page_id", "tx", "ty", "v").agg(F.count("*").alias("n"))
    run = Window.partitionBy("page_id", "tx", "ty").orderBy("v").rowsBetween(Window.unboundedPreceding, 0)
    tile = Window.partitionBy("page_id", "tx", "ty")
    table = levels_.join(found, ["page_id", "tx", "ty", "v"], "left").withColumn("n", F.coalesce("n", F.lit(0)))
    table = table.withColumn("area", F.sum("n").over(tile)).withColumn("limit", F.greatest(F.lit(1), F.floor(F.col("area") * F.lit(clip / 256))))
    table = table.withColumns({"kept": F.sum(F.least("n", "limit")).over(run), "over": F.sum(F.greatest(F.col("n") - F.col("limit"), F.lit(0))).over(tile)})
    table = table.select("page_id", "tx", "ty", "v", saturate((F.col("kept") * 256 + F.col("over") * (F.col("v") + 1)) * 255 / (F.col("area") * F.lit(256.0))).alias("new"))
    # weights in halves of a tile, so that they are whole
    at = lambda c, n: F.floor((2 * F.col(c) - n) / F.lit(2.0 * n)).cast("int")
    near = px.withColumns({"x0": at("x", tw), "y0": at("y", th), "mid": (F.col("v").between(1, 254)).cast("int")})
    near = near.withColumns({"wx": 2 * F.col("x") - tw - F.col("x0") * 2 * tw, "wy": 2 * F.col("y") - th - F.col("y0") * 2 * th})
    corner = lambda i, j: F.struct(F.greatest(F.lit(0), F.least(F.lit(across - 1), F.col("x0") + i)).alias("tx"), F.greatest(F.lit(0), F.least(F.lit(down - 1), F.col("y0") + j)).alias("ty"), ((F.col("wx") if i else 2 * tw - F.col("wx")) * (F.col("wy") if j else 2 * th - F.col("wy"))).alias("w"))
    four = near.withColumn("c", F.explode(F.array(*[corner(i, j) for i in (0, 1) for j in (0, 1)]))).select("page_id", "y", "x", "v", "mid", F.col("c.tx").alias("tx"), F.col("c.ty").alias("ty"), F.col("c.w").alias("w"))
    blended = four.join(table, ["page_id", "tx", "ty", "v"]).groupBy("page_id", "y", "x").agg(F.first("v").alias("v"), F.max("mid").alias("mid"), F.sum(F.col("w") * F.col("new")).alias("s"))
    some = F.max("mid").over(Window.partitionBy("page_id"))
    return blended.withColumn("some", some).select("page_id", "y", "x", F.when(F.col("some") == 1, saturate(F.col("s") / F.lit(float(4 * tw * th)))).otherwise(F.col("v")).alias("v"))


def gaussian(px: DataFrame, sigma: float, column: str = "v") -> DataFrame:
    """Weighted means by exp(-d^2 / 2 sigma^2) up to three sigma, first along rows, then along columns; edges renormalise. Result in ``low``."""
    r = max(1, round(3 * sigma))

    def mean(c: str, at: str, w) -> Column:
        near = F.collect_list(F.struct(F.col(at).cast("double").alias("p"), F.col(c).cast("double").alias("q"))).over(w)
        weight = lambda s: F.exp(-(s["p"] - F.col(at)) * (s["p"] - F.col(at)) / (2 * sigma * sigma))
        zero = F.lit(0.0)
        return F.aggregate(near, zero, lambda a, s: a + weight(s) * s["q"]) / F.aggregate(near, zero, lambda a, s: a + weight(s))

    return px.withColumn("low", mean(column, "x", along_x(r))).withColumn("low", mean("low", "y", along_y(r)))


def homomorphic(px: DataFrame, sigma: float = 50, gamma_high: float = 1.8, gamma_low: float = 0.6, eps: float = 1e-6, mode: str = "LogHighpass", clamp: float = 4.0) -> DataFrame:
    """Illumination (low) and detail (high) of the logarithm of a page parted and weighed: ``e`` is gamma_high * high, or exp of both sums within the clamp."""
    logs = px.withColumn("l", F.log(F.greatest(F.lit(eps), F.col("v") / 255.0)))
    parted = gaussian(logs, sigma, "l").withColumn("high", (F.col("l") - F.col("low")) * gamma_high)
    both = F.exp(F.least(F.lit(clamp), F.greatest(F.lit(-clamp), F.col("high") + gamma_low * F.col("low"))))
    return parted.select("page_id", "y", "x", (F.col("high") if mode == "LogHighpass" else both).alias("e"))


def normalised(values: DataFrame, low: float = 0.5, high: float = 99.5) -> DataFrame:
    """Values ``e`` to 0..255 between two percentiles of the page (values that occur); a flat page is 0."""
    at = lambda p: F.expr(f"percentile_disc({p / 100}) within group (order by e)")
    page = values.groupBy("page_id").agg(at(low).alias("lo"), at(high).alias("hi"))
    share = (F.col("e") - F.col("lo")) * 255 / (F.col("hi") - F.col("lo"))
    return values.join(page, "page_id").select("page_id", "y", "x", F.when(F.col("hi") - F.col("lo") < 1e-9, 0).otherwise(saturate(share)).alias("v"))


def majority(px: DataFrame, base: int = 128, reach: int = 30, step: int = 10) -> DataFrame:
    """Black where at least half of the thresholds base - reach .. base + reach (both ends included) say so: an expression, no row a threshold."""
    offsets = sorted({*range(-reach, reach + 1, step), -reach, reach})
    votes = sum(((F.col("v") <= base + d).cast("int") for d in offsets), F.lit(0))
    return px.withColumn("v", F.when(votes >= (len(offsets) + 1) // 2, 0).otherwise(255))


def palette_unpacked(packed: DataFrame, bits: int, width: int, palette: list[int]) -> DataFrame:
    """Indices of 1, 2, 4 or 8 bits (page_id, y, byte, packed), the highest first, looked up in a palette; indices past its end take its last."""
    per = 8 // bits
    places = packed.withColumn("k", F.explode(F.sequence(F.lit(0), F.lit(per - 1)))).withColumn("x", (F.col("byte") * per + F.col("k")).cast("int")).where(F.col("x") < width)
    index = F.expr(f"shiftright(cast(packed as int), cast(8 - {bits} * (k + 1) as int)) & {2**bits - 1}")
    return places.select("page_id", "y", "x", F.get(F.array(*map(F.lit, palette)), F.least(index, F.lit(len(palette) - 1))).alias("v"))
