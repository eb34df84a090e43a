"""Queries of page files: trees written and read by the data source, scans, and the errors of a run."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from folio import rasters
from folio.catalog import FILES, PX, files, register
from folio.sources import batch, images, page_files, scratch


def relative(path: Column, root: str) -> Column:
    """What follows the name of the folder ``root`` in a path or URI."""
    return F.regexp_replace(path, f"^.*/{root.rpartition('/')[2]}/?", "")


def tree(spark: SparkSession, sf_dir: str) -> str:
    """A tree with a file for each web page, of as many bytes as its number has digits; every eleventh is in a folder that is passed over."""
    hidden = F.when(F.col("page_id") % 11 == 0, F.lit("/.thumbs")).otherwise("")
    rows = files(spark, sf_dir).select(F.concat("folder", hidden).alias("folder"), F.concat("base_name", F.lit("."), "ext").alias("name"), F.col("page_id").cast("string").cast("binary").alias("content"), F.lit(None).cast("string").alias("error"))
    root = scratch.folder(spark)
    page_files.write(rows, root)
    return root




@register("o001_scan", "SELECT folder, base_name, ext FROM files WHERE ext <> 'txt' AND page_id % 11 <> 0", FILES)
def scanned(spark: SparkSession, sf_dir: str) -> DataFrame:
    root = tree(spark, sf_dir)
    found = batch.scan(spark, root, recursive=True)
    return found.where(~F.col("folder").endswith(".thumbs")).select(relative(F.col("folder"), root).alias("folder"), "base_name", "ext")


@register("o004_tree_walk", "SELECT folder || '/' || base_name || '.' || ext AS path, folder, ext, CAST(length(CAST(page_id AS VARCHAR)) AS BIGINT) AS bytes, CAST(page_id AS VARCHAR) AS content FROM files WHERE ext <> 'txt' AND page_id % 11 <> 0", FILES)
def walked(spark: SparkSession, sf_dir: str) -> DataFrame:
    root = tree(spark, sf_dir)
    found = page_files.read(spark, root, bytes=2000)
    return found.select(relative(F.col("path"), root).alias("path"), relative(F.col("folder"), root).alias("folder"), "ext", F.col("length").alias("bytes"), F.col("content").cast("string").alias("content"))


def pages_and_errors(spark: SparkSession, sf_dir: str) -> str:
    """The gray pages as image files of three kinds, by folder; every tenth page fails."""
    pages = rasters.packed_gray(spark, sf_dir)
    out = None
    for at, form in enumerate(("png", "bmp", "tif")):
        some = images.encoded(pages.where((F.col("page_id") % 3 == at) & (F.col("page_id") % 10 != 9)), form).select("page_id", F.lit(form).alias("form"), "content", F.lit(None).cast("string").alias("error"))
        out = some if out is None else out.unionByName(some)
    failed = pages.where("page_id % 10 = 9").select("page_id", F.lit("png").alias("form"), F.lit(None).cast("binary").alias("content"), F.concat(F.lit("page "), F.col("page_id").cast("string"), F.lit(" is torn")).alias("error"))
    rows = out.unionByName(failed).select(F.concat(F.lit("shelf"), (F.col("page_id") % 4).cast("string")).alias("folder"), F.concat(F.col("page_id").cast("string"), F.lit("."), "form").alias("name"), "content", "error")
    root = scratch.folder(spark)
    page_files.write(rows, root)
    return root


@register("o136_page_files", "SELECT page_id, 'shelf' || CAST(page_id % 4 AS VARCHAR) AS folder, y, x, v FROM px WHERE page_id % 10 <> 9", PX)
def page_files_and_back(spark: SparkSession, sf_dir: str) -> DataFrame:
    root = pages_and_errors(spark, sf_dir)
    back = images.decoded(page_files.read(spark, root, bytes=100_000))
    named = back.select(F.regexp_extract("path", r"/(\d+)\.\w+$", 1).cast("bigint").alias("page_id"), F.regexp_extract("path", r"/(\w+)/[^/]+$", 1).alias("folder"), "width", "height", "channels", "pixels")
    px = rasters.unpack(named).join(named.select("page_id", "folder"), "page_id")
    return px.select("page_id", "folder", *[F.col(c).cast("bigint").alias(c) for c in ("y", "x", "v")])


@register("o158_errors", "SELECT 'shelf' || CAST(vec_id % 4 AS VARCHAR) AS folder, CAST(vec_id AS VARCHAR) || '.png' AS name, 'page ' || CAST(vec_id AS VARCHAR) || ' is torn' AS error FROM embeddings WHERE vec_id % 10 = 9")
def errors_of_a_run(spark: SparkSession, sf_dir: str) -> DataFrame:
    return page_files.errors(spark, pages_and_errors(spark, sf_dir))
