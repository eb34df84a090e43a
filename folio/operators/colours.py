"""Operators of colour pixels (b, g, r in 0..255): pure expressions, no shuffle."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folio.operators.points import saturate


def weighted_gray(px: DataFrame, red: float = 0.299, green: float = 0.587, blue: float = 0.114) -> DataFrame:
    """Gray by weights of one's own, as ``v``."""
    return px.select("page_id", "y", "x", saturate(F.col("r") * F.lit(red) + F.col("g") * F.lit(green) + F.col("b") * F.lit(blue)).alias("v"))


def as_bgr(px: DataFrame) -> DataFrame:
    """Pixels of one (v), three or four channels (b, g, r[, a]) as b, g, r."""
    have = "v" if "v" in px.columns else None
    return px.select("page_id", "y", "x", *[F.col(have or c).cast("int").alias(c) for c in ("b", "g", "r")])


def hsv(b: Column, g: Column, r: Column) -> tuple[Column, Column, Column]:
    """Hue in half degrees 0..180, saturation and value 0..255, as doubles."""
    top, low = F.greatest(b, g, r), F.least(b, g, r)
    span = top - low
    sector = F.when(span == 0, 0.0).when(top == r, 60.0 * (g - b) / span).when(top == g, 120.0 + 60.0 * (b - r) / span).otherwise(240.0 + 60.0 * (r - g) / span)
    hue = F.when(sector < 0, sector + 360.0).otherwise(sector) / 2
    return hue, F.when(top == 0, 0.0).otherwise(255.0 * span / top), top.cast("double")


def shift_hue(px: DataFrame, degrees: float = 0, saturation: float = 0) -> DataFrame:
    """Hue turned by some degrees and saturation scaled by 1 + percent / 100, then back to b, g, r."""
    h, s, v = hsv(F.col("b").cast("double"), F.col("g").cast("double"), F.col("r").cast("double"))
    turned = F.pmod(h + F.lit(degrees / 2), F.lit(180.0)) / 30.0
    full = F.least(F.lit(255.0), F.greatest(F.lit(0.0), s * F.lit(1 + saturation / 100))) / 255.0
    wide = px.withColumns({"hue": turned, "full": full, "value": v})
    part, sector = F.col("hue") - F.floor("hue"), F.floor("hue") % 6
    p, q, t = F.col("value") * (1 - F.col("full")), F.col("value") * (1 - F.col("full") * part), F.col("value") * (1 - F.col("full") * (1 - part))
    value = F.col("value")
    of = lambda *six: saturate(F.round(F.element_at(F.array(*six), (sector + 1).cast("int")), 6))
    out = {"r": of(value, q, p, p, t, value), "g": of(t, value, value, q, p, p), "b": of(p, p, t, value, value, q)}
    return wide.withColumns(out).select("page_id", "y", "x", "b", "g", "r")


def lightness(b: Column, g: Column, r: Column) -> Column:
    """L of CIE Lab (white of D65) scaled to 0..255, as a double."""
    linear = lambda c: F.when(c / 255.0 <= 0.04045, c / 255.0 / 12.92).otherwise(F.pow((c / 255.0 + 0.055) / 1.055, 2.4))
    y = 0.212671 * linear(r) + 0.715160 * linear(g) + 0.072169 * linear(b)
    return F.when(y > 0.008856, 116.0 * F.cbrt(y) - 16.0).otherwise(903.3 * y) * 2.55


def in_range(px: DataFrame, low: tuple[int, int, int], high: tuple[int, int, int]) -> DataFrame:
    """255 where all of b, g, r lie in their ranges, ends included."""
    inside = F.lit(True)
    for c, a, z in zip(("b", "g", "r"), low, high):
        inside = inside & F.col(c).between(a, z)
    return px.select("page_id", "y", "x", F.when(inside, 255).otherwise(0).alias("v"))


def combine(px: DataFrame, left: str, right: str, how: str) -> DataFrame:
    """``left`` and ``right`` channels as ``v``: and, or, xor, or the absolute difference."""
    a, b = F.col(left), F.col(right)
    v = {"and": a.bitwiseAND(b), "or": a.bitwiseOR(b), "xor": a.bitwiseXOR(b), "absdiff": F.abs(a - b)}[how]
    return px.select("page_id", "y", "x", v.cast("int").alias("v"))


def masked_set(px: DataFrame, mask: Column, value: int) -> DataFrame:
    return px.withColumn("v", F.when(mask, value).otherwise(F.col("v")))


def padded(px: DataFrame, width: int, height: int, border: int, fill: int = 255) -> DataFrame:
    """Pages with a border of one colour on all sides."""
    moved = px.select("page_id", (F.col("y") + border).alias("y"), (F.col("x") + border).alias("x"), "v")
    span = lambda n: F.sequence(F.lit(0), F.lit(n + 2 * border - 1))
    frame = px.select("page_id").distinct().withColumn("y", F.explode(span(height))).withColumn("x", F.explode(span(width)))
    inside = F.col("x").between(border, border + width - 1) & F.col("y").between(border, border + height - 1)
    return moved.unionByName(frame.where(~inside).withColumn("v", F.lit(fill)))
