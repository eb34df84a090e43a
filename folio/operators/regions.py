"""Operators of component tables: ranking, and the joins by distance that tell specks from text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def largest(components: DataFrame) -> DataFrame:
    """The component of greatest area of each page, the least label of equals."""
    order = Window.partitionBy("page_id").orderBy(F.col("area").desc(), "label")
    return components.withColumn("nth", F.row_number().over(order)).where("nth = 1").drop("nth")


def centred(components: DataFrame) -> DataFrame:
    return components.withColumns({"cx": F.col("left_x") + F.col("width") / 2.0, "cy": F.col("top") + F.col("height") / 2.0})


def near_big(components: DataFrame, big: int, radius: float) -> DataFrame:
    """Components under ``big`` pixels whose centre is nearer than ``radius`` to the box of one that isn't; pages meet by their id only once, as a semi-join."""
    boxes = components.where(F.col("area") >= big).select(F.col("page_id").alias("page"), F.col("left_x").alias("l"), F.col("top").alias("t"), (F.col("left_x") + F.col("width")).alias("r"), (F.col("top") + F.col("height")).alias("b"))
    dx = F.greatest(F.col("l") - F.col("cx"), F.lit(0.0), F.col("cx") - F.col("r"))
    dy = F.greatest(F.col("t") - F.col("cy"), F.lit(0.0), F.col("cy") - F.col("b"))
    return centred(components.where(F.col("area") < big)).join(boxes, (F.col("page_id") == F.col("page")) & (dx * dx + dy * dy < radius * radius), "left_semi")


def clustered(specks: DataFrame, dx: float, dy: float) -> DataFrame:
    """Components with another one whose centre is within ``dx`` and ``dy``: an equi-join on grid cells, each speck also standing in the cells around."""
    here = centred(specks).withColumns({"gx": F.floor(F.col("cx") / dx), "gy": F.floor(F.col("cy") / dy)})
    around = F.flatten(F.transform(F.sequence(F.lit(-1), F.lit(1)), lambda i: F.transform(F.sequence(F.lit(-1), F.lit(1)), lambda j: F.struct((F.col("gx") + i).alias("x"), (F.col("gy") + j).alias("y")))))
    others = here.select(F.col("page_id").alias("page"), F.col("label").alias("other"), F.col("cx").alias("ox"), F.col("cy").alias("oy"), F.explode(around).alias("cell"))
    close = (F.abs(F.col("cx") - F.col("ox")) <= dx) & (F.abs(F.col("cy") - F.col("oy")) <= dy) & (F.col("label") != F.col("other"))
    return here.join(others, (F.col("page_id") == F.col("page")) & (F.col("gx") == F.col("cell.x")) & (F.col("gy") == F.col("cell.y")) & close, "left_semi")


def half_even(c: Column) -> Column:
    return F.bround(c, 0).cast("int")


def specks(components: DataFrame, text_rows: DataFrame, multiplier: float = 0.5, absolute: int | None = None, dot_height: float = 0.35, radius: float = 0.8, squareness: float = 0.6, keep_clusters: bool = True, max_aspect: float | None = None, min_height: int = 3) -> DataFrame:
    """Every small component with what is known of it and whether it goes (``remove``).

    Sizes are shares of the upper median height of a page's components of at least ``min_height`` (20 without any).
    A component is small by area (under multiplier times the height's square, or ``absolute`` pixels) or by height.
    It stays near a bigger one; on a text row it stays if it is about square or, with ``keep_clusters``, has another
    small one close by; all others go, and so do ones as long as ``max_aspect``. ``text_rows`` is (page_id, i, text_row).
    Components of a page meet only within cells of a grid as wide as the radius, so no page is squared.
    """
    tall = F.sort_array(F.collect_list(F.when(F.col("height") >= min_height, F.col("height"))))
    sizes = components.groupBy("page_id").agg(tall.alias("tall")).select("page_id", F.coalesce(F.get("tall", F.floor(F.size("tall") / 2).cast("int")), F.lit(20)).cast("int").alias("mh"))
    mh = F.col("mh")
    limit = F.greatest(F.lit(1), half_even(multiplier * mh * mh)) if absolute is None else F.lit(max(1, absolute))
    known = components.join(sizes, "page_id").withColumn("small", (F.col("area") < limit) | (F.col("height") <= F.greatest(F.lit(1), half_even(dot_height * mh))))
    known = known.withColumns({"cx": F.floor(F.col("left_x") + F.floor(F.col("width") / 2)).cast("int"), "cy": F.floor(F.col("top") + F.floor(F.col("height") / 2)).cast("int")})
    known = known.withColumns({"reach": F.greatest(F.lit(1.0), radius * mh), "rows": F.greatest(F.lit(1), F.floor(mh / 3)).cast("int"), "wide": F.greatest(F.lit(3), F.floor(mh * 0.6)).cast("int")})
    small = known.where("small")
    keys = ["page_id", "label"]

    cell = lambda c: F.floor(F.col(c) / F.col("reach"))
    boxes = known.where("not small").withColumn("gx", F.explode(F.sequence(F.floor((F.col("left_x") - F.col("reach")) / F.col("reach")), F.floor((F.col("left_x") + F.col("width") + F.col("reach")) / F.col("reach")))))
    boxes = boxes.withColumn("gy", F.explode(F.sequence(F.floor((F.col("top") - F.col("reach")) / F.col("reach")), F.floor((F.col("top") + F.col("height") + F.col("reach")) / F.col("reach")))))
    boxes = boxes.select("page_id", "gx", "gy", F.col("left_x").alias("l"), F.col("top").alias("t"), (F.col("left_x") + F.col("width")).alias("r"), (F.col("top") + F.col("height")).alias("b"))
    dx = F.greatest(F.col("l") - F.col("cx"), F.lit(0), F.col("cx") - F.col("r"))
    dy = F.greatest(F.col("t") - F.col("cy"), F.lit(0), F.col("cy") - F.col("b"))
    near = small.withColumns({"gx": cell("cx"), "gy": cell("cy")}).join(boxes, ["page_id", "gx", "gy"]).where(dx * dx + dy * dy < F.col("reach") * F.col("reach")).select(*keys).distinct().withColumn("near_big", F.lit(True))

    inked = text_rows.where("text_row").select("page_id", F.col("i").alias("row"))
    lines = small.withColumn("row", F.explode(F.sequence(F.col("cy") - F.col("rows"), F.col("cy") + F.col("rows")))).join(inked, ["page_id", "row"]).select(*keys).distinct().withColumn("on_line", F.lit(True))

    grid = small.withColumns({"gx": F.floor(F.col("cx") / F.col("wide")), "gy": F.floor(F.col("cy") / F.col("rows"))})
    spread = grid.select("page_id", F.col("label").alias("other"), F.col("cx").alias("ox"), F.col("cy").alias("oy"), F.explode(F.sequence(F.col("gx") - 1, F.col("gx") + 1)).alias("gx"), "gy").withColumn("gy", F.explode(F.sequence(F.col("gy") - 1, F.col("gy") + 1)))
    close = (F.col("label") != F.col("other")) & (F.abs(F.col("ox") - F.col("cx")) <= F.col("wide")) & (F.abs(F.col("oy") - F.col("cy")) <= F.col("rows"))
    groups = grid.join(spread, ["page_id", "gx", "gy"]).where(close).select(*keys).distinct().withColumn("in_group", F.lit(True))

    found = small
    for facts in (near, lines, groups):
        found = found.join(facts, keys, "left")
    found = found.withColumns({c: F.coalesce(F.col(c), F.lit(False)) for c in ("near_big", "on_line", "in_group")})
    square = F.abs(F.col("width") - F.col("height")) <= F.greatest(F.lit(1.0), F.col("height") * min(1.0, max(0.0, squareness)))
    stays = F.col("near_big") | (F.col("on_line") & (square | (F.col("in_group") & F.lit(keep_clusters))))
    if max_aspect is not None:
        stays &= F.greatest(F.col("width") / F.col("height"), F.col("height") / F.col("width")) < max_aspect
    return found.withColumn("remove", ~stays).select(*keys, "near_big", "on_line", "in_group", "remove")


def edge_touching(components: DataFrame, width: int, height: int, span: float = 0.6) -> DataFrame:
    """Components taken for a border: touching an edge, and spanning ``span`` of a side or touching opposite edges."""
    right, bottom = F.col("left_x") + F.col("width"), F.col("top") + F.col("height")
    l, t, r, b = F.col("left_x") == 0, F.col("top") == 0, right == width, bottom == height
    long = (F.col("width") >= span * width) | (F.col("height") >= span * height)
    return components.where((l | t | r | b) & (long | (l & r) | (t & b)))


def boundary(boxes: DataFrame, width: int, height: int, margin: int = 0) -> DataFrame:
    """One rectangle around all boxes (page_id, x, y, w, h) of each page, with a margin, within the page."""
    g = boxes.groupBy("page_id").agg(F.min("x").alias("l"), F.min("y").alias("t"), F.max(F.col("x") + F.col("w")).alias("r"), F.max(F.col("y") + F.col("h")).alias("b"))
    l, t = F.greatest(F.lit(0), F.col("l") - margin), F.greatest(F.lit(0), F.col("t") - margin)
    return g.select("page_id", l.alias("x"), t.alias("y"), (F.least(F.lit(width), F.col("r") + margin) - l).alias("w"), (F.least(F.lit(height), F.col("b") + margin) - t).alias("h"))


def decoded_boxes(cells: DataFrame, stride: int, least: float, width: int, height: int) -> DataFrame:
    """Boxes of score cells (page_id, cy, cx, score, up, right, down, left): corners by distance, cut to the page, none of a pixel or less."""
    x, y = F.col("cx") * stride, F.col("cy") * stride
    l, t = F.greatest(F.lit(0.0), x - F.col("left")), F.greatest(F.lit(0.0), y - F.col("up"))
    r, b = F.least(F.lit(float(width)), x + F.col("right")), F.least(F.lit(float(height)), y + F.col("down"))
    return cells.where(F.col("score") >= least).select("page_id", F.floor(l).alias("x"), F.floor(t).alias("y"), F.floor(r - l).alias("w"), F.floor(b - t).alias("h"), "score").where("w > 1 and h > 1")


def overlaps(boxes: DataFrame) -> DataFrame:
    """Likeness (intersection over union) of boxes of a page that meet; pairs are made within cells of 64 pixels."""
    side = 64
    cells = boxes.withColumn("gx", F.explode(F.sequence(F.floor(F.col("x") / side), F.floor((F.col("x") + F.col("w") - 1) / side)))).withColumn("gy", F.explode(F.sequence(F.floor(F.col("y") / side), F.floor((F.col("y") + F.col("h") - 1) / side))))
    a, b = cells.alias("a"), cells.alias("b")
    pairs = a.join(b, (F.col("a.page_id") == F.col("b.page_id")) & (F.col("a.gx") == F.col("b.gx")) & (F.col("a.gy") == F.col("b.gy")) & (F.col("a.box_id") < F.col("b.box_id")))
    w = F.least(F.col("a.x") + F.col("a.w"), F.col("b.x") + F.col("b.w")) - F.greatest(F.col("a.x"), F.col("b.x"))
    h = F.least(F.col("a.y") + F.col("a.h"), F.col("b.y") + F.col("b.h")) - F.greatest(F.col("a.y"), F.col("b.y"))
    both = pairs.where((w > 0) & (h > 0)).withColumn("inter", w * h)
    union = F.col("a.w") * F.col("a.h") + F.col("b.w") * F.col("b.h") - F.col("inter")
    return both.select(F.col("a.page_id").alias("page_id"), F.col("a.box_id").alias("box_id"), F.col("b.box_id").alias("other_id"), "inter", (F.col("inter") / union).alias("iou")).distinct()


def confirmed(read: DataFrame, least_sure: float = 50, least_count: int = 3, least_share: float = 0.5) -> DataFrame:
    """Boxes whose recognised ``text`` (with its confidence ``sure``, 0..100) is writing: sure enough with enough letters and digits, by number and by share of
    what is visible; or, as short numbers are, at 30 with nine tenths of them."""
    text = F.trim(F.coalesce("text", F.lit("")))
    count = F.length(F.regexp_replace(text, r"[^\p{L}\p{N}]", ""))
    seen = F.length(F.regexp_replace(text, r"[\p{Cc}\s]", ""))
    share = F.when(seen > 0, count / seen).otherwise(0.0)
    passed = ((F.col("sure") >= least_sure) & (count >= least_count) & (share >= least_share)) | ((F.col("sure") >= 30) & (count >= 1) & (share >= 0.9))
    return read.withColumn("confirmed", passed)
