"""Lines and circles by voting tables: edge pixels name the lines or circles that they may lie on, in whole numbers, and the counts are summed before they are exchanged.

An angle of a page is the upper median of its lines, with a confidence by their number and spread; a circle is confirmed by its contrast with the ring around it.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

UNIT = 65536  # of the whole numbers that stand for sines and cosines


def edges(px: DataFrame, on: Column) -> DataFrame:
    """(page_id, y, x): pixels that are ``on`` and have one beside, above or below that isn't. The page's own edge is none."""
    marked = px.select("page_id", "y", "x", F.coalesce(on, F.lit(False)).alias("on"))
    row, column = Window.partitionBy("page_id", "y").orderBy("x"), Window.partitionBy("page_id", "x").orderBy("y")
    beside = lambda w: F.coalesce(F.lag("on").over(w), F.lit(True)) & F.coalesce(F.lead("on").over(w), F.lit(True))
    return marked.withColumn("inner", beside(row)).withColumn("inner", F.col("inner") & beside(column)).where("on and not inner").select("page_id", F.col("y").cast("long").alias("y"), F.col("x").cast("long").alias("x"))


def line_votes(points: DataFrame, limit: float = 45.0, step: float = 1.0) -> DataFrame:
    """(page_id, angle, distance, n): the lines through edge pixels. ``angle`` counts steps of ``step`` degrees, -limit to limit, positive where a line falls to the right;
    ``distance`` is that of the line from the first pixel, rounded half up."""
    count = int(limit / step)
    table = F.array(*[F.struct(F.lit(k).cast("long").alias("angle"), *[F.lit(round(f(math.radians(k * step)) * UNIT)).cast("long").alias(n) for n, f in (("c", math.cos), ("s", math.sin))]) for k in range(-count, count + 1)])
    named = points.select("page_id", "y", "x", F.explode(table).alias("of")).select("page_id", "of.angle", F.floor((F.col("y") * F.col("of.c") - F.col("x") * F.col("of.s") + UNIT // 2) / UNIT).alias("distance"))
    return named.groupBy("page_id", "angle", "distance").agg(F.count("*").alias("n"))


def lines(votes: DataFrame, least: int) -> DataFrame:
    """Lines with ``least`` votes that none beside them, by a step of angle or distance or both, outvotes; of equals the lesser angle, then distance, stays."""
    strong = votes.where(F.col("n") >= least)
    rank = F.struct(F.col("n"), (-F.col("angle")).alias("a"), (-F.col("distance")).alias("d"))
    shifts = F.explode(F.array(*[F.struct(F.lit(a).alias("a"), F.lit(d).alias("d")) for a in (-1, 0, 1) for d in (-1, 0, 1)]))
    told = strong.withColumn("rank", rank).withColumn("to", shifts)
    best = told.groupBy("page_id", (F.col("angle") + F.col("to.a")).alias("angle"), (F.col("distance") + F.col("to.d")).alias("distance")).agg(F.max("rank").alias("best"))
    return best.where((F.col("best.a") == -F.col("angle")) & (F.col("best.d") == -F.col("distance"))).select("page_id", "angle", "distance", F.col("best.n").alias("n"))


def skew(found: DataFrame, step: float = 1.0) -> DataFrame:
    """(page_id, angle, n, deviation, confidence): the upper median of the angles of a page's lines in degrees, their mean distance from it, and how sure that is:
    by number up to 30 lines, and by spread down from 3 degrees. Lines are summed by angle first, so a page is as many rows as there are angles."""
    angles = found.groupBy("page_id", "angle").agg(F.count("*").alias("m"))
    median = angles.groupBy("page_id").agg(F.sum("m").alias("n"), F.sort_array(F.collect_list(F.struct("angle", "m"))).alias("by"))  # one entry an angle
    past = F.aggregate("by", F.struct(F.lit(0).cast("long").alias("seen"), F.lit(None).cast("long").alias("at")), lambda s, e: F.struct((s["seen"] + e["m"]).alias("seen"), F.coalesce(s["at"], F.when(s["seen"] + e["m"] > F.floor(F.col("n") / 2), e["angle"])).alias("at")))
    at = median.withColumn("at", past["at"])
    off = F.aggregate("by", F.lit(0).cast("long"), lambda s, e: s + F.abs(e["angle"] - F.col("at")) * e["m"])
    out = at.select("page_id", (F.col("at") * F.lit(step)).alias("angle"), "n", (off * F.lit(step) / F.col("n")).alias("deviation"))
    share = lambda e: F.greatest(F.lit(0.0), F.least(F.lit(1.0), e))
    return out.withColumn("confidence", share(F.log(1.0 + F.col("n")) / math.log(31.0)) * share((3.0 - F.col("deviation")) / 3.0))


def rim(radius: int) -> int:
    """How many pixels of a disc have one beside, above or below that is no longer of it."""
    side = lambda x, y: x * x + y * y <= radius * radius
    whole = range(-radius, radius + 1)
    return sum(side(x, y) and not (side(abs(x) + 1, y) and side(x, abs(y) + 1)) for y in whole for x in whole)


def circle_votes(points: DataFrame, least: int, most: int, width: int, height: int) -> DataFrame:
    """(page_id, cy, cx, r, n): centres within the page, of radii ``least`` to ``most``, by how many edge pixels lie in the outermost pixel of the disc: further than
    r - 1 and no further than r. All edges of a true disc do."""
    r, dy = F.col("r"), F.col("dy")
    on = lambda dx: (dx * dx + dy * dy > (r - 1) * (r - 1)) & (dx * dx + dy * dy <= r * r)
    at = points.withColumn("r", F.explode(F.sequence(F.lit(least).cast("long"), F.lit(most).cast("long")))).withColumn("dy", F.explode(F.sequence(-r, r)))
    named = at.select("page_id", (F.col("y") + dy).alias("cy"), "x", "r", F.explode(F.filter(F.sequence(-r, r), on)).alias("dx")).withColumn("cx", F.col("x") + F.col("dx"))
    inside = named.where((F.col("cx") >= 0) & (F.col("cx") < width) & (F.col("cy") >= 0) & (F.col("cy") < height))
    return inside.groupBy("page_id", "cy", "cx", "r").agg(F.count("*").alias("n"))


def circles(votes: DataFrame, least: int, most: int, round_: float, apart: int) -> DataFrame:
    """(page_id, cy, cx, r, score): circles of which a share ``round_`` is there, where none within ``apart`` pixels has a greater score; of equals the lesser r, cy, cx stays.

    The score is in millionths of the rim of a disc, so it is exact. Candidates meet in cells as wide as ``apart``, which hold no more than their pixels times the radii."""
    whole = F.create_map(*[F.lit(n).cast("long") for r in range(least, most + 1) for n in (r, rim(r))])
    scored = votes.withColumn("score", F.least(F.lit(1_000_000), F.floor(1_000_000 * F.col("n") / whole[F.col("r")]))).where(F.col("score") >= round(round_ * 1_000_000))
    best = scored.groupBy("page_id", "cy", "cx").agg(F.max(F.struct("score", (-F.col("r")).alias("r"), (-F.col("cy")).alias("y"), (-F.col("cx")).alias("x"))).alias("rank"))
    cell = lambda at: F.floor(F.col(at) / apart)
    own = best.select("page_id", "cy", "cx", "rank", cell("cy").alias("gy"), cell("cx").alias("gx"))
    there = own.select("page_id", F.col("cy").alias("oy"), F.col("cx").alias("ox"), F.col("rank").alias("other"), F.explode(F.sequence(F.col("gy") - 1, F.col("gy") + 1)).alias("gy"), "gx")
    there = there.withColumn("gx", F.explode(F.sequence(F.col("gx") - 1, F.col("gx") + 1)))
    close = (F.col("oy") - F.col("cy")) * (F.col("oy") - F.col("cy")) + (F.col("ox") - F.col("cx")) * (F.col("ox") - F.col("cx")) <= apart * apart
    left = own.join(there.where("other is not null"), ["page_id", "gy", "gx"]).where(close).groupBy("page_id", "cy", "cx", "rank").agg(F.max("other").alias("strongest")).where("strongest = rank")
    return left.select("page_id", "cy", "cx", (-F.col("rank.r")).alias("r"), "rank.score")


def confirmed(found: DataFrame, px: DataFrame, dark: bool = True, inner: int = 3, outer: int = 6, least: float = 8.0) -> DataFrame:
    """``circles`` whose disc is darker by more than ``least`` levels than the ring from ``inner`` to ``outer`` pixels beyond it; if not ``dark``, lighter or darker.

    A circle asks for the pixels of its square, so pages and circles meet by pixel; one whose ring has no pixel in the page goes. Adds inside and around, the means."""
    r = F.col("r")
    at = found.withColumn("dy", F.explode(F.sequence(-(r + outer), r + outer))).withColumn("dx", F.explode(F.sequence(-(r + outer), r + outer)))
    far = F.col("dy") * F.col("dy") + F.col("dx") * F.col("dx")
    asked = at.withColumn("in", far <= r * r).withColumn("out", (far > (r + inner) * (r + inner)) & (far <= (r + outer) * (r + outer))).where(F.col("in") | F.col("out"))
    met = asked.withColumn("y", F.col("cy") + F.col("dy")).withColumn("x", F.col("cx") + F.col("dx")).join(px.select("page_id", F.col("y").cast("long").alias("y"), F.col("x").cast("long").alias("x"), "v"), ["page_id", "y", "x"])
    means = met.groupBy("page_id", "cy", "cx", "r", "score").agg(F.avg(F.when(F.col("in"), F.col("v"))).alias("inside"), F.avg(F.when(F.col("out"), F.col("v"))).alias("around"))
    contrast = F.col("around") - F.col("inside")
    return means.where((contrast if dark else F.abs(contrast)) > least)
