"""Colours of pages and of their borders: samples of the frame as counts of colours, two groups found in rounds over all pages at once, and plain means."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folio.sources.steps import cut

BGR = ("b", "g", "r")
PARTS = 16  # centres are whole numbers of these parts of a level


def frame(px: DataFrame, width: int, height: int, share: float = 0.01, most: int = 12000) -> DataFrame:
    """(page_id, b, g, r, n): how often each colour occurs in the frame of pages of one size, ``share`` of the lesser side wide. Of frames with more than about ``most``
    pixels every k-th row and column is looked at."""
    deep = max(1, round(min(width, height) * share))
    size = 2 * deep * (width + height)
    k = 1 if size <= most else math.ceil(math.sqrt(size / most))
    inside = F.col("x").between(deep, width - deep - 1) & F.col("y").between(deep, height - deep - 1)
    return px.where(~inside & (F.col("x") % k == 0) & (F.col("y") % k == 0)).groupBy("page_id", *BGR).agg(F.count("*").alias("n"))


def spread(samples: DataFrame) -> DataFrame:
    """(page_id, n, mean_b, mean_g, mean_r, deviation): the mean of the three standard deviations is the last."""
    sums = samples.groupBy("page_id").agg(F.sum("n").alias("n"), *[F.sum(F.col("n") * F.col(c)).alias(f"s{c}") for c in BGR], *[F.sum(F.col("n") * F.col(c) * F.col(c)).alias(f"q{c}") for c in BGR])
    deviation = lambda c: F.sqrt(F.col("n") * F.col(f"q{c}") - F.col(f"s{c}") * F.col(f"s{c}")) / F.col("n")
    return sums.select("page_id", "n", *[(F.col(f"s{c}") / F.col("n")).alias(f"mean_{c}") for c in BGR], ((deviation("b") + deviation("g") + deviation("r")) / 3).alias("deviation"))


def _far(place: str) -> Column:
    off = lambda c: PARTS * F.col(c) - F.col(f"{place}{c}")
    return off("b") * off("b") + off("g") * off("g") + off("r") * off("r")


def _sums(samples: DataFrame, centres: DataFrame) -> DataFrame:
    """Per page what each group counts and sums up to: colours as near to both belong to the first. Sums are partial before anything is exchanged but the samples themselves."""
    first = _far("a") <= _far("z")
    of = lambda place, e: F.coalesce(F.sum(F.when(first if place == "a" else ~first, e)), F.lit(0))
    keys = [f"{place}{c}" for place in "az" for c in BGR]
    sums = [of(place, F.col("n") * F.col(c)).alias(f"s{place}{c}") for place in "az" for c in BGR]
    return samples.join(centres, "page_id").groupBy("page_id", *keys).agg(of("a", F.col("n")).alias("na"), of("z", F.col("n")).alias("nz"), *sums)


def two_groups(samples: DataFrame, rounds: int = 10) -> DataFrame:
    """(page_id, ab, ag, ar, na, zb, zg, zr, nz): centres, in PARTS of a level, and sizes of the two groups of each page.

    Begins with the darkest and the lightest colour, the same on every run; a round takes all pages on by a join and grouped sums, and its centres, a row a page, are
    written to the checkpoint folder. Ends when no centre moves, or after ``rounds``. A group that loses all keeps its centre; of a page of one colour the second is empty.
    """
    samples = cut(samples.where(" and ".join(f"{c} is not null" for c in BGR)).select("page_id", *BGR, "n"))
    key = F.struct((F.col("b") + F.col("g") + F.col("r")).alias("light"), *BGR)
    ends = samples.groupBy("page_id").agg(F.min(key).alias("a"), F.max(key).alias("z"))
    places = [f"{place}{c}" for place in "az" for c in BGR]
    centres = cut(ends.select("page_id", *[(PARTS * F.col(f"{p[0]}.{p[1]}")).cast("long").alias(p) for p in places]))
    for _ in range(rounds):
        moved = _sums(samples, centres).select(
            "page_id", *[F.when(F.col(f"n{p[0]}") == 0, F.col(p)).otherwise(F.expr(f"({2 * PARTS} * s{p} + n{p[0]}) div (2 * n{p[0]})")).alias(p) for p in places], F.struct(*places).alias("was")
        )
        moved = cut(moved.withColumn("same", F.struct(*places) == F.col("was")).drop("was"))
        centres = moved.drop("same")
        if moved.where("not same").isEmpty():
            break
    return _sums(samples, centres).select("page_id", "ab", "ag", "ar", "na", "zb", "zg", "zr", "nz")


def border_colours(samples: DataFrame, even: float = 10.0, few: int = 50) -> DataFrame:
    """(page_id, grouped, b, g, r): the colour of each page's frame: the mean where it is even or has less than ``few`` samples, half to even, else the centre of the larger group
    (the darker, of two as large)."""
    samples = cut(samples)
    facts = spread(samples).withColumn("grouped", ~((F.col("deviation") < even) | (F.col("n") < few)))
    plain = facts.where("not grouped").select("page_id", "grouped", *[F.bround(f"mean_{c}", 0).cast("long").alias(c) for c in BGR])
    # Only the pages that need them are grouped.
    found = two_groups(samples.join(facts.where("grouped").select("page_id"), "page_id", "left_semi"))
    level = lambda c: F.expr(f"(if(na >= nz, a{c}, z{c}) + {PARTS // 2}) div {PARTS}").cast("long").alias(c)
    return plain.unionByName(found.select("page_id", F.lit(True).alias("grouped"), *map(level, BGR)))


def page_and_border(px: DataFrame, width: int, height: int, strip: int = 32) -> DataFrame:
    """(page_id, page_b, .., border_r): means, as shares of 255, of the middle third each way and of the strips along the four edges; corners belong to two of them."""
    w, h, deep = max(1, width // 3), max(1, height // 3), max(1, min(strip, min(width, height) // 4))
    left, top = (width - w) // 2, (height - h) // 2
    inside = F.col("x").between(left, left + w - 1) & F.col("y").between(top, top + h - 1)
    along = lambda c, n: (F.col(c) < deep).cast("int") + (F.col(c) >= n - deep).cast("int")
    weight = along("x", width) + along("y", height)
    pages = [(F.sum(F.when(inside, F.col(c))) / (255.0 * F.count_if(inside))).alias(f"page_{c}") for c in BGR]
    return px.groupBy("page_id").agg(*pages, *[(F.sum(F.col(c) * weight) / (255.0 * F.sum(weight))).alias(f"border_{c}") for c in BGR])
