"""Operators of single pixels and of their places: pure expressions, no shuffle."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def saturate(c: Column) -> Column:
    """Rounded half to even and kept within 0..255."""
    return F.least(F.lit(255), F.greatest(F.lit(0), F.bround(c, 0))).cast("int")


def gray(b: Column, g: Column, r: Column) -> Column:
    """Luma of integer channels by weights of thousandths, half to even (exact)."""
    return F.bround(((299 * r + 587 * g + 114 * b) / F.lit(1000).cast("decimal(12,0)")).cast("decimal(12,3)"), 0).cast("int")


def threshold(px: DataFrame, t: int = 128) -> DataFrame:
    return px.withColumn("v", F.when(F.col("v") > t, 255).otherwise(0))


def invert(px: DataFrame) -> DataFrame:
    return px.withColumn("v", 255 - F.col("v"))


def brightness_contrast(px: DataFrame, brightness: float = 0, contrast: float = 0) -> DataFrame:
    """v * a + brightness with a = (contrast + 100) / 100 within 0..3."""
    a = min(3.0, max(0.0, (contrast + 100) / 100))
    return px.withColumn("v", saturate(F.col("v") * F.lit(a) + F.lit(float(brightness))))


def scale_channels(px: DataFrame, red: float = 0, green: float = 0, blue: float = 0) -> DataFrame:
    """Each channel times 1 + percent / 100."""
    return px.withColumns({c: saturate(F.col(c) * F.lit(1 + p / 100)) for c, p in (("b", blue), ("g", green), ("r", red))})


def cmyk_to_rgb(px: DataFrame) -> DataFrame:
    """Channels c, m, y_, k (0..255) to r, g, b: 1 - min(1, c (1 - k) + k), times 255, a half up."""
    k = F.col("k") / 255.0
    one = lambda c: F.floor((1 - F.least(F.lit(1.0), F.col(c) / 255.0 * (1 - k) + k)) * 255 + 0.5).cast("int")
    return px.withColumns({"r": one("c"), "g": one("m"), "b": one("y_")})


def crop(px: DataFrame, left: int, top: int, width: int, height: int) -> DataFrame:
    inside = F.col("x").between(left, left + width - 1) & F.col("y").between(top, top + height - 1)
    return px.where(inside).withColumns({"x": F.col("x") - left, "y": F.col("y") - top})


def fill_outside(px: DataFrame, left: int, top: int, right: int, bottom: int, width: int, height: int, fill: int = 255) -> DataFrame:
    """Manual borders: what lies within the given depths of the edges gets one colour; with nothing left the page stays as it is."""
    if width - left - right <= 0 or height - top - bottom <= 0:
        return px
    inside = F.col("x").between(left, width - right - 1) & F.col("y").between(top, height - bottom - 1)
    return px.withColumn("v", F.when(inside, F.col("v")).otherwise(fill))


def orient(px: DataFrame, tag: int, width: int, height: int) -> DataFrame:
    """Undoes one of the eight camera orientations."""
    x, y, w, h = F.col("x"), F.col("y"), width - 1, height - 1
    to = {1: (x, y), 2: (w - x, y), 3: (w - x, h - y), 4: (x, h - y), 5: (y, x), 6: (h - y, x), 7: (h - y, w - x), 8: (y, w - x)}.get(tag, (x, y))
    return px.select(*[c for c in px.columns if c not in ("x", "y")], to[0].cast("int").alias("x"), to[1].cast("int").alias("y"))


def resize_nearest(px: DataFrame, width: int, height: int, to_width: int, to_height: int, keep_aspect: bool = False) -> DataFrame:
    """Nearest pixels by integer arithmetic: each source pixel is copied to the places that take it, so nothing is joined."""
    if keep_aspect:
        scale = min(to_width / width, to_height / height)
        to_width, to_height = max(1, int(width * scale)), max(1, int(height * scale))
    taken = lambda c, n, m: F.filter(F.sequence(F.lit(0), F.lit(m - 1)), lambda i: F.floor(((2 * i + 1) * n) / (2 * m)) == F.col(c))
    wide = px.withColumn("x", F.explode(taken("x", width, to_width)))
    return wide.withColumn("y", F.explode(taken("y", height, to_height)))


def split_at(px: DataFrame, width: int, percent: float, overlap: int = 0) -> DataFrame:
    """Manual split: two pages a spread, with column ``side``; the overlap belongs to both."""
    at = min(width - 1, max(1, round(width * percent / 100)))
    sides = F.filter(F.array(F.lit(1), F.lit(2)), lambda s: F.when(s == 1, F.col("x") < min(width, at + overlap)).otherwise(F.col("x") >= max(0, at - overlap)))
    return px.withColumn("side", F.explode(sides)).withColumn("x", F.when(F.col("side") == 1, F.col("x")).otherwise(F.col("x") - max(0, at - overlap)))


def edge_bands(px: DataFrame, width: int, height: int, left: int, right: int, top: int, bottom: int) -> DataFrame:
    """Whether a pixel lies where punch holes are looked for."""
    return px.withColumn("searched", (F.col("x") < left) | (F.col("x") >= width - right) | (F.col("y") < top) | (F.col("y") >= height - bottom))


def pack_bits(px: DataFrame) -> DataFrame:
    """One bit a pixel, the highest first, set where the gray level's high bit is."""
    bit = F.shiftright("v", 7) * F.expr("shiftleft(1, cast(7 - x % 8 as int))")
    return px.groupBy("page_id", "y", F.floor(F.col("x") / 8).cast("int").alias("byte")).agg(F.sum(bit).alias("packed"))
