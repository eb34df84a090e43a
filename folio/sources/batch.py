"""The batch engine as relations: catalogs of files, natural order, done work, sides, numbering, progress and logs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Extensions of pages, and the narrower set that makes a folder worth a visit.
IMAGES = ("jpg", "jpeg", "png", "bmp", "gif", "tif", "tiff")
VISITED = ("jpg", "jpeg", "png", "tif", "tiff")


def scan(spark: SparkSession, path: str, recursive: bool = False) -> DataFrame:
    """Files of pages under a folder, without their content (it is pruned until it is asked for)."""
    found = spark.read.format("binaryFile").option("recursiveFileLookup", str(recursive).lower()).load(path)
    return parts(found.select("path")).where(F.col("ext").isin(*IMAGES))


def parts(files: DataFrame) -> DataFrame:
    """path with its folder, base name and lower-case extension."""
    name = F.regexp_extract("path", r"([^/]*)$", 1)
    return files.select("path", F.regexp_extract("path", r"^(.*)/[^/]*$", 1).alias("folder"), F.regexp_replace(name, r"\.[^.]*$", "").alias("base_name"), F.lower(F.regexp_extract(name, r"\.([^.]*)$", 1)).alias("ext"))


def natural_key(name: Column) -> Column:
    """Sorts digit runs by their numbers: each padded to 20 places, the rest in lower case."""
    runs = F.regexp_extract_all(F.lower(name), F.lit(r"([0-9]+|[^0-9]+)"), F.lit(1))
    return F.array_join(F.transform(runs, lambda r: F.when(r.rlike("^[0-9]"), F.lpad(r, 20, "0")).otherwise(r)), "")


def side(base_name: Column) -> Column:
    """Left for an odd last digit, else right."""
    digit = F.regexp_extract(base_name, r"([0-9])[^0-9]*$", 1)
    return F.when((digit != "") & (F.try_to_number(digit, F.lit("9")) % 2 == 1), "Left").otherwise("Right")


def folders_with_pages(files: DataFrame) -> DataFrame:
    return files.groupBy("folder").agg(F.bool_or(F.col("ext").isin(*VISITED)).alias("has_pages")).where("has_pages").select("folder")


def not_done(files: DataFrame, done: DataFrame) -> DataFrame:
    """Files without an output of their base name, letter case aside."""
    keys = done.select(F.lower("base_name").alias("done")).distinct()
    return files.join(keys, F.lower("base_name") == F.col("done"), "left_anti")


def numbered(files: DataFrame) -> DataFrame:
    """New names 001, 002, ... within each folder in natural order."""
    order = Window.partitionBy("folder").orderBy(natural_key(F.col("base_name")), "base_name")
    return files.withColumn("n", F.row_number().over(order)).withColumn("new_name", F.format_string("%03d", "n"))


def progress(done: DataFrame) -> DataFrame:
    """Percent done after each file of a folder, half to even."""
    run = Window.partitionBy("folder").orderBy("seq").rowsBetween(Window.unboundedPreceding, 0)
    return done.withColumn("percent", F.bround(100.0 * F.count("*").over(run) / F.count("*").over(Window.partitionBy("folder")), 0).cast("int"))


def log(done: DataFrame) -> DataFrame:
    """One row a folder: files, errors, and seconds as hours, minutes and seconds."""
    g = done.groupBy("folder").agg(F.count("*").alias("total"), F.count("error").alias("errors"), F.sum("seconds").alias("seconds"))
    s = F.col("seconds")
    return g.select("folder", "total", "errors", F.floor(s / 3600).alias("h"), F.floor(s % 3600 / 60).alias("m"), (s % 60).alias("s"))


def split_names(files: DataFrame) -> DataFrame:
    """(folder, base_name, ext, side, output): the two outputs of a split scan, as jpg unless the scan is a png."""
    ext = F.when(F.lower("ext") == "png", "png").otherwise("jpg")
    return files.withColumn("side", F.explode(F.array(F.lit(1), F.lit(2)))).withColumn("output", F.concat("base_name", F.lit("_"), F.col("side").cast("string"), F.lit("."), ext))


def resized_names(files: DataFrame) -> DataFrame:
    """Where a resized scan goes: a folder beside its own, under its own name and format."""
    return files.withColumns({"out_folder": F.concat("folder", F.lit("_resized")), "output": F.concat("base_name", F.lit("."), F.lower("ext"))})


def left_over(outputs: DataFrame) -> DataFrame:
    """Outputs (folder, name) that an interrupted run left unfinished: hidden names that end in .tmp."""
    return outputs.where(F.col("name").rlike(r"^\..*\.tmp$"))


def to_delete(outputs: DataFrame, overwritten: DataFrame) -> DataFrame:
    """All outputs of the folders (folder) that are overwritten: nothing in such a folder outlives the new run."""
    return outputs.join(overwritten.select("folder").distinct(), "folder", "left_semi")


#: Answers to the question what to do with outputs that are there.
ANSWERS = ("Yes", "No", "YesToAll", "NoToAll", "Cancel")


def answered(folders: DataFrame) -> DataFrame:
    """(batch, seq, folder, n_existing, answer) -> what is done with each folder: overwrite, keep or cancelled.

    Only folders with outputs ask. An answer to all holds for the folders after it; once cancelled, nothing more of the batch runs.
    """
    before = Window.partitionBy("batch").orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)
    asks = F.col("n_existing") > 0
    sticky = F.first(F.when(asks & F.col("answer").isin("YesToAll", "NoToAll", "Cancel"), F.col("answer")), ignorenulls=True).over(before)
    said = F.coalesce(sticky, F.when(asks, F.col("answer")))
    done = F.when(said == "Cancel", "cancelled").when(~asks, "fresh").when(said.isin("Yes", "YesToAll"), "overwrite").otherwise("keep")
    return folders.withColumn("done", done)


def gated(files: DataFrame, left: bool, right: bool) -> DataFrame:
    """Whether manual borders apply to a scan, by the page side of its name (column ``side``: Left or Right)."""
    return files.withColumn("applies", F.when(F.col("side") == "Left", F.lit(left)).otherwise(F.lit(right)))


def until_cancelled(work: DataFrame, cancels: DataFrame) -> DataFrame:
    """Work (folder, started) that began before its folder, or with a null folder the whole batch, was cancelled (folder, at)."""
    by_folder = cancels.where("folder is not null").groupBy("folder").agg(F.min("at").alias("at"))
    for_all = cancels.where("folder is null").groupBy(F.lit(0).alias("key")).agg(F.min("at").alias("all_at"))  # one row at most
    out = work.join(by_folder, "folder", "left").withColumn("key", F.lit(0)).join(F.broadcast(for_all), "key", "left")
    return out.where((F.col("at").isNull() | (F.col("started") < F.col("at"))) & (F.col("all_at").isNull() | (F.col("started") < F.col("all_at")))).select(*work.columns)


def offsets(selected: DataFrame) -> DataFrame:
    """Selections (x, y, w, h on a shown page of ``scale``; page of width, height) as the four depths of manual borders, in page pixels."""
    px = lambda c: F.floor(c / F.col("scale") + 0.5)
    left, top, right, bottom = px(F.col("x")), px(F.col("y")), F.col("width") - px(F.col("x") + F.col("w")), F.col("height") - px(F.col("y") + F.col("h"))
    kept = lambda c: F.greatest(F.lit(0), c).cast("long")
    return selected.withColumns({"left_px": kept(left), "top_px": kept(top), "right_px": kept(right), "bottom_px": kept(bottom)})
