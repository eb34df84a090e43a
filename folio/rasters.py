"""Pages as data.

Two shapes of a page: *packed*, one row with its pixels as bytes, for kernels and sinks; and *exploded*, one row a pixel
(page_id, y, x, v), for everything that SQL can say. A window or sum over exploded pages is an exchange of its own, by page and row
or column; whole pages of scans belong into the kernels, which shuffle nothing.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Packed pages: row-major pixels, channels interleaved as B, G, R[, A].
PAGE = "page_id bigint, width int, height int, channels int, pixels binary"
#: Side of the pages made of embeddings, and width of those made of texts.
SIDE, TEXT_WIDTH = 8, 64


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def level(e: Column) -> Column:
    """A coordinate of an embedding as a gray level."""
    return F.least(F.lit(255), F.greatest(F.lit(0), F.floor((e.cast("double") + 0.5) * 255))).cast("int")


def gray_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Exploded 8x8 gray pages, one of each embedding."""
    e = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("page_id"), F.posexplode("embedding").alias("i", "e"))
    return e.select("page_id", F.floor(F.col("i") / SIDE).cast("int").alias("y"), (F.col("i") % SIDE).cast("int").alias("x"), level(F.col("e")).alias("v"))


def colour_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Exploded 8x8 pages with channels b, g, r: the embedding turned by 0, 21 and 42 places."""
    e = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("page_id"), "embedding", F.posexplode("embedding").alias("i", "e"))
    turned = lambda by: level(F.get("embedding", (F.col("i") + by) % 64))
    return e.select("page_id", F.floor(F.col("i") / SIDE).cast("int").alias("y"), (F.col("i") % SIDE).cast("int").alias("x"), turned(0).alias("b"), turned(21).alias("g"), turned(42).alias("r"))


def spreads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Exploded 16x8 spreads: pages 2k and 2k + 1 side by side; an odd last page stands alone."""
    px = gray_pages(spark, sf_dir)
    return px.select(F.floor(F.col("page_id") / 2).alias("page_id"), "y", (F.col("x") + SIDE * (F.col("page_id") % 2)).cast("int").alias("x"), "v")


def text_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Exploded pages 64 wide, a gray level for each character of a document; the last row is as short as it comes."""
    c = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("page_id"), F.length("text").alias("n"), F.posexplode(F.split("text", "")).alias("i", "c")).where("i < n")
    return c.select("page_id", "n", F.floor(F.col("i") / TEXT_WIDTH).cast("int").alias("y"), (F.col("i") % TEXT_WIDTH).cast("int").alias("x"), F.least(F.lit(255), F.ascii("c")).alias("v"))


def filled_text_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The text pages with the rest of the last row white."""
    n = F.length("text")
    c = table(spark, sf_dir, "documents").where(n > 0).select(F.col("doc_id").alias("page_id"), F.posexplode(F.split(F.rpad("text", (F.ceil(n / TEXT_WIDTH) * TEXT_WIDTH).cast("int"), F.lit("\u00ff")), "")).alias("i", "c")).where("c <> ''")
    return c.select("page_id", F.floor(F.col("i") / TEXT_WIDTH).cast("int").alias("y"), (F.col("i") % TEXT_WIDTH).cast("int").alias("x"), F.least(F.lit(255), F.ascii("c")).alias("v"))


def sheets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Exploded 32x32 colour pages, four by four of the 8x8 ones; the last is as full as it comes."""
    px, tile = colour_pages(spark, sf_dir), F.col("page_id") % 16
    return px.select(F.floor(F.col("page_id") / 16).alias("page_id"), (F.floor(tile / 4) * SIDE + F.col("y")).cast("int").alias("y"), (tile % 4 * SIDE + F.col("x")).cast("int").alias("x"), "b", "g", "r")


def packed_gray(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The gray pages packed, without a shuffle. What an embedding lacks of a page is level 0, as in the SQL, and what it has beyond is left out."""
    each = F.transform(F.sequence(F.lit(0), F.lit(SIDE * SIDE - 1)), lambda i: level(F.get("embedding", i)))
    hexed = F.array_join(F.transform(each, lambda v: F.lpad(F.hex(v.cast("long")), 2, "0")), "")
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("page_id"), F.lit(SIDE).alias("width"), F.lit(SIDE).alias("height"), F.lit(1).alias("channels"), F.unhex(hexed).alias("pixels"))


def packed_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole documents as packed pages 64 wide, without a shuffle: a byte a character (others than Latin-1 are question marks), the last row filled with white."""
    text = F.col("text")
    height = F.ceil(F.length(text) / TEXT_WIDTH).cast("int")
    pixels = F.encode(F.rpad(text, height * TEXT_WIDTH, F.lit("\u00ff")), "ISO-8859-1")
    rows = table(spark, sf_dir, "documents").where(F.length("text") > 0)
    return rows.select(F.col("doc_id").alias("page_id"), F.lit(TEXT_WIDTH).alias("width"), height.alias("height"), F.lit(1).alias("channels"), pixels.alias("pixels"))


def level_texts(spark: SparkSession, sf_dir: str, filled: bool = False) -> DataFrame:
    """The pixels of ``text_pages`` (or ``filled_text_pages``) packed, without a shuffle: (page_id, width, pixels), a byte a character, characters beyond Latin-1 are 255."""
    n = F.length("text")
    text = F.regexp_replace("text", "[^\\x00-\\xff]", "\u00ff")
    if filled:
        text = F.rpad(text, (F.ceil(n / TEXT_WIDTH) * TEXT_WIDTH).cast("int"), F.lit("\u00ff"))
    rows = table(spark, sf_dir, "documents").where(n > 0)
    return rows.select(F.col("doc_id").alias("page_id"), F.lit(TEXT_WIDTH).alias("width"), F.encode(text, "ISO-8859-1").alias("pixels"))


def pack(px: DataFrame) -> DataFrame:
    """Exploded gray pages, packed; one exchange by page."""
    rows = px.groupBy("page_id").agg(F.sort_array(F.collect_list(F.struct("y", "x", "v"))).alias("p"), (F.max("x") + 1).alias("width"), (F.max("y") + 1).alias("height"))
    hexed = F.array_join(F.transform("p", lambda q: F.lpad(F.hex(q["v"].cast("long")), 2, "0")), "")
    return rows.select("page_id", "width", "height", F.lit(1).alias("channels"), F.unhex(hexed).alias("pixels"))


def unpack(pages: DataFrame) -> DataFrame:
    """Packed gray pages, exploded."""
    i = F.posexplode(F.expr("transform(sequence(1, length(pixels)), i -> cast(conv(hex(substring(pixels, i, 1)), 16, 10) as int))")).alias("i", "v")
    rows = pages.where("channels = 1 and length(pixels) > 0").select("page_id", "width", i)
    return rows.select("page_id", F.floor(F.col("i") / F.col("width")).cast("int").alias("y"), (F.col("i") % F.col("width")).cast("int").alias("x"), "v")
