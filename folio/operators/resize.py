"""Resizing by tables of weights, one for each axis: any ratio, up and down, in whole numbers."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def weight_rows(source: int, target: int, how: str) -> list[tuple[int, int, int]]:
    """(target place, source place, weight) of an axis; the weights of a target place sum up to ``unit``.

    Area: the share that a source pixel has of the stretch that a target pixel covers. Linear: the two pixels whose centres are around that of the target; beyond
    the outer centres the outer pixel alone.
    """
    if how == "Area":
        # A target place covers t * source .. (t + 1) * source, a source place s * target .. (s + 1) * target, in parts of a pixel.
        return [(t, s, min((t + 1) * source, (s + 1) * target) - max(t * source, s * target)) for t in range(target) for s in range(t * source // target, -(-(t + 1) * source // target))]
    if how != "Linear":
        raise ValueError(f"no way to resize: {how}")
    out: dict[tuple[int, int], int] = {}
    for t in range(target):
        s, part = divmod((2 * t + 1) * source - target, 2 * target)
        for place, weight in ((s, 2 * target - part), (s + 1, part)):
            key = (t, min(max(place, 0), source - 1))
            out[key] = out.get(key, 0) + weight
    return [(t, s, w) for (t, s), w in out.items() if w]


def unit(source: int, target: int, how: str) -> int:
    return source if how == "Area" else 2 * target


def weights(spark: SparkSession, source: int, target: int, how: str, axis: str) -> DataFrame:
    """A row or two a pixel of the longer side: bounded by the size of a page, so it is broadcast."""
    return F.broadcast(spark.createDataFrame(weight_rows(source, target, how), f"to_{axis} int, {axis} int, weight_{axis} long"))


def resized(px: DataFrame, width: int, height: int, to_width: int, to_height: int, how: str = "Area") -> DataFrame:
    """Exploded gray pages of one size in another; levels are rounded half to even. Rows are summed along x first, so what is exchanged is of the target's width."""
    spark = px.sparkSession
    across = px.join(weights(spark, width, to_width, how, "x"), "x").groupBy("page_id", "y", "to_x").agg(F.sum(F.col("v").cast("long") * F.col("weight_x")).alias("s"))
    down = across.join(weights(spark, height, to_height, how, "y"), "y").groupBy("page_id", F.col("to_y").alias("y"), F.col("to_x").alias("x")).agg(F.sum(F.col("s") * F.col("weight_y")).alias("s"))
    whole = float(unit(width, to_width, how) * unit(height, to_height, how))
    return down.select("page_id", "y", "x", F.bround(F.col("s") / F.lit(whole), 0).cast("int").alias("v"))
