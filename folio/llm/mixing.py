"""Mixing sources to target weights (operator 5) by a multivariate-hypergeometric splitting tree.

Targets: sources in code point order (null last) weigh 5, 2, 1, 5, ... and share all words; a target
stops at ``most`` times its source's size and the excess is reshared by weight, i.e. the least level
x is found for which min(most * size, x * weight) sums to the total.

Draws: the documents of a source are permuted by a hash and cut into blocks of about ``BLOCK``
documents. A source takes all blocks as often as its target holds its size, and then a prefix of the
permutation; in the block where the target falls, documents are taken greedily, the largest first, while
they fit, so the words taken come within the smallest documents of that block. What is to be taken of a
source is thus an exact quota of block draws. A splitting tree deals these quotas out to the output
shards: at each node the draws of the left half are multivariate-hypergeometric, so each shard is a
uniform random part of the mix. Every shard finds its own draws by walking from the root (the node's
number is the seed), without a driver that deals. Sources come in lots of ``LOT``: a node first splits the sums of the lots,
then what falls to a lot among its sources, which is the same distribution, so no task holds the quotas of more than one
lot, and the driver holds one number a lot. A draw is a source's rank in its permuted sequence of
blocks, so shards are disjoint. In a shard documents are ordered by a hash of their own.

Null and empty texts have size 0: they take part in nothing and are taken 0 times. Equal ids and texts are
separate rows, but rows of equal id and source are permuted alike. All results depend on rows and seed alone. Sizes are
counted once and kept in the shared folder; texts are moved only by :func:`mixed`. The empty table gives no rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from folio.llm.common import DOCUMENT, WORD, arrow_schema, conform, fraction, meet
from folio.llm.common import cut as cut_lineage

WEIGHTS = (5.0, 2.0, 1.0)
BLOCK = 48
GROUP = 64  # blocks summed at once on the way to a prefix sum
SHARD_WORDS = 1_000_000
LOT = 50_000
STRIDE = 64  # shards that are dealt from one row of quotas


def place_of() -> Column:
    """A document's place in the permutation of its source."""
    return fraction("source", "doc_id", seed=5)


def sized(docs: DataFrame) -> DataFrame:
    """doc_id, source, size and the place in the permutation."""
    size = F.when(F.col("text").isNull(), 0).otherwise(F.regexp_count("text", F.lit(WORD))).cast("long")
    return conform(docs, DOCUMENT).select("doc_id", "source", size.alias("size"), place_of().alias("place"))


def targets(sizes: DataFrame, most: float = 3.0) -> DataFrame:
    """(src, source, n_docs, source_size, weight, target), one row a source; ``src`` is its number in code point order, null last."""
    by = sizes.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("n_docs"))
    rank = Window.orderBy(F.col("source").asc_nulls_last())  # over one row a source
    by = by.withColumn("src", F.row_number().over(rank).cast("long") - 1)
    weight = F.element_at(F.array(*map(F.lit, WEIGHTS)), (F.col("src") % len(WEIGHTS) + 1).cast("int"))
    cap = F.col("source_size") * F.lit(float(most))
    level = Window.orderBy("bound", F.col("source").asc_nulls_last())
    everything = level.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    before = level.rowsBetween(Window.unboundedPreceding, -1)
    flooded = (
        by.withColumn("weight", weight)
        .withColumn("cap", cap)
        .withColumn("bound", F.col("cap") / F.col("weight"))
        .withColumn("total", F.sum("source_size").over(everything).cast("double"))
        .withColumn("left", F.col("total") - F.coalesce(F.sum("cap").over(before), F.lit(0.0)))
        .withColumn("heavy", F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(before), F.lit(0.0)))
        # the level if all sources before stop at their caps; the first that doesn't exceed its bound holds for all after
        .withColumn("level", F.col("left") / F.col("heavy"))
        .withColumn("final", F.min(F.when(F.col("level") <= F.col("bound"), F.struct("bound", "source", "level"))).over(everything)["level"])
    )
    return flooded.select("src", "source", "n_docs", "source_size", "weight", F.coalesce(F.least(F.col("cap"), F.col("final") * F.col("weight")), "cap").alias("target"))


def block_of(place: str, n_docs: str, size: int):
    return F.floor(F.col(place) * F.ceil(F.col(n_docs) / size)).cast("long")


def blocks(rows: DataFrame, size: int) -> DataFrame:
    """(src, block, times, words, limit): each block is taken ``times`` times, and ``limit`` words of it once more."""
    cut = rows.withColumn("block", block_of("place", "n_docs", size))
    summed = cut.groupBy("src", "block").agg(F.sum("size").alias("words"), F.first("source_size").alias("source_size"), F.first("target").alias("target"))
    # prefix sums in two steps: within groups of GROUP blocks, and over the sums of the groups
    summed = summed.withColumn("group", F.floor(F.col("block") / GROUP))
    by_group = summed.groupBy("src", "group").agg(F.sum("words").alias("words"))
    groups = by_group.select("src", "group", (F.sum("words").over(Window.partitionBy("src").orderBy("group")) - F.col("words")).alias("base"))
    placed = summed.join(groups, ["src", "group"])
    start = F.col("base") + F.sum("words").over(Window.partitionBy("src", "group").orderBy("block")) - F.col("words")
    times = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("int")
    rest = F.round(F.col("target") - F.col("times") * F.col("source_size")).cast("long") - F.col("start")
    out = placed.withColumn("start", start).withColumn("times", times).withColumn("limit", F.greatest(F.lit(0).cast("long"), F.least(rest, F.col("words"))))
    return out.select("src", "block", "times", "words", "limit")


def split(lots: np.ndarray, lot: int, quotas: np.ndarray, shards: int, shard: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """(first rank, count) of the draws that one shard has of each source of a lot, by the walk from the root of the tree.

    ``lots`` are the draws of all lots, ``quotas`` those of the sources of ``lot``.
    """
    left, right, sums, at, have = 0, shards, lots.astype(np.int64), np.zeros(len(quotas), np.int64), quotas.astype(np.int64)
    total = int(sums.sum())
    edge = lambda i: total * i // shards  # noqa: E731  shards of equal draws, to one
    while right - left > 1:
        middle = (left + right) // 2
        node = np.random.default_rng([seed, left, right])
        lesser = node.multivariate_hypergeometric(sums, edge(middle) - edge(left), method="marginals")
        own = np.random.default_rng([seed, left, right, lot]).multivariate_hypergeometric(have, int(lesser[lot]), method="marginals")
        if shard < middle:
            right, have, sums = middle, own, lesser
        else:
            left, at, have, sums = middle, at + own, have - own, sums - lesser
    return at, have


DEALT = T.StructType([T.StructField("src", T.LongType()), T.StructField("block", T.LongType()), T.StructField("rank", T.LongType()), T.StructField("shard", T.IntegerType())])


def deal(ends: DataFrame, shards: int, seed: int) -> DataFrame:
    """(src, block, rank, shard) for all draws of ``ends`` (src, quota, width: draws and blocks of a source), each shard by itself."""
    spark, schema = ends.sparkSession, arrow_schema(DEALT)
    lots = ends.groupBy(F.floor(F.col("src") / LOT).cast("int").alias("lot")).agg(F.sort_array(F.collect_list(F.struct("src", "quota", "width"))).alias("own"))  # LOT small entries at most
    lots = cut_lineage(lots)
    sums = [r["n"] for r in lots.select("lot", F.aggregate("own", F.lit(0).cast("long"), lambda a, x: a + x["quota"]).alias("n")).orderBy("lot").collect()]  # a number for each lot
    numbers = spark.sparkContext.broadcast(np.array(sums, np.int64))
    rows = lots.withColumn("from", F.explode(F.sequence(F.lit(0), F.lit(shards - 1), F.lit(STRIDE))))
    rows = rows.repartition(max(1, min(shards // STRIDE + 1, 4096) * max(1, min(len(sums), 16))), "lot", "from")

    def run(batches):
        for b in batches:
            for lot, own, begin in zip(*(b[c].to_pylist() for c in ("lot", "own", "from"))):
                src, quota, width = (np.array([x[c] for x in own], np.int64) for c in ("src", "quota", "width"))
                for shard in range(begin, min(begin + STRIDE, shards)):
                    first, count = split(numbers.value, lot, quota, shards, shard, seed)
                    rank = np.arange(int(count.sum())) - np.repeat(np.cumsum(count) - count, count) + np.repeat(first, count)
                    columns = np.repeat(src, count), rank % np.repeat(width, count), rank, np.full(len(rank), shard)
                    for at in range(0, len(rank), 100_000):
                        yield pa.RecordBatch.from_arrays([pa.array(x[at : at + 100_000], f.type) for x, f in zip(columns, schema)], schema=schema)

    return rows.mapInArrow(run, DEALT)


def mix(docs: DataFrame, text: bool = False, most: float = 3.0, shard_words: int = SHARD_WORDS, seed: int = 5) -> DataFrame:
    """One row per document: size, source_size, target, and ``shards``, the output shards it was drawn to, one entry a draw.

    With ``text`` rows carry the columns of ``documents``, and documents without words have no size. Whatever there is of each
    source is a table; the driver holds sums over all sources only.
    """
    narrow = cut_lineage(sized(docs))  # texts are counted once
    sources = cut_lineage(targets(narrow, most)).withColumnRenamed("source", "named")
    n_docs, words = sources.agg(F.coalesce(F.sum("n_docs"), F.lit(0)), F.coalesce(F.sum("source_size"), F.lit(0))).first()
    size = BLOCK * (1 + int(n_docs * (most + 1) / (BLOCK * 9e8)))  # draws are under 1e9
    based = meet(narrow, sources, "source", "named")
    cut = cut_lineage(blocks(based, size))
    # A source's draws in rank order: its whole passes, then its prefix.
    ends = cut.groupBy("src").agg(F.max("times").alias("times"), F.max("block").alias("last"), F.max(F.when(F.col("limit") > 0, F.col("block"))).alias("end"))
    width = F.col("last") + 1
    ends = ends.select("src", (F.col("times") * width + F.coalesce(F.col("end") + 1, F.lit(0))).cast("long").alias("quota"), width.alias("width"))
    shards = int(max(1, min(2**20, words // shard_words)))
    dealt = deal(ends, shards, seed)
    dealt = dealt.groupBy("src", "block").agg(F.sort_array(F.collect_list(F.struct("rank", "shard"))).alias("dealt"))  # one for each pass
    # The one block of a source in which its target falls: the largest documents first, while they fit.
    falls = cut.where((F.col("limit") > 0) & (F.col("limit") < F.col("words"))).select("src", "block", "limit")
    placed = based.withColumn("block", block_of("place", "n_docs", size))
    units = placed.join(falls, ["src", "block"]).groupBy("src", "block", "limit", "place", "doc_id").agg(F.sum("size").alias("size"))
    listed = units.groupBy("src", "block").agg(F.first("limit").alias("limit"), F.sort_array(F.collect_list(F.struct((-F.col("size")).alias("less"), "place", "doc_id"))).alias("units"))
    fits = F.aggregate(
        "units",
        F.struct(F.col("limit").alias("left"), F.expr("cast(array() as array<struct<place: double, doc_id: bigint>>)").alias("taken")),
        lambda a, x: F.when((x["less"] < 0) & (-x["less"] <= a["left"]), F.struct((a["left"] + x["less"]).alias("left"), F.array_append(a["taken"], F.struct(x["place"].alias("place"), x["doc_id"].alias("doc_id"))).alias("taken"))).otherwise(a),
    )["taken"]
    chosen = listed.select("src", "block", fits.alias("chosen"))
    plan = cut.join(dealt, ["src", "block"], "left").join(chosen, ["src", "block"], "left").select("src", "block", "times", "words", "limit", F.transform(F.coalesce("dealt", F.array()), lambda d: d["shard"]).alias("draws"), "chosen")
    if text:
        own = conform(docs, DOCUMENT).withColumns({"size": F.coalesce(F.col("text").rlike(WORD), F.lit(False)).cast("long"), "place": place_of()})
        placed = meet(own, sources, "source", "named").withColumn("block", block_of("place", "n_docs", size))
    placed = placed.join(plan, ["src", "block"])
    more = F.when(F.col("limit") <= 0, 0).when(F.col("limit") >= F.col("words"), 1)
    more = more.otherwise(F.exists(F.coalesce("chosen", F.array()), lambda c: (c["place"] == F.col("place")) & c["doc_id"].eqNullSafe(F.col("doc_id"))).cast("int"))
    drawn = F.when(F.col("size") == 0, F.expr("cast(array() as array<int>)")).otherwise(F.slice("draws", 1, F.col("times") + more))
    carry = DOCUMENT.names if text else ["doc_id", "source", "size", "source_size", "target"]
    return placed.select(*carry, drawn.alias("shards"))


def taken(docs: DataFrame) -> DataFrame:
    """The digest: how many words of each document the mix takes."""
    return mix(docs).select("doc_id", "source", "size", "source_size", "target", (F.col("size") * F.size("shards")).alias("taken"))


def mixed(docs: DataFrame) -> DataFrame:
    """The documents as drawn, one row a draw, dealt to their shards and shuffled within them. Documents that are not drawn go."""
    drawn = mix(docs, text=True).select(*DOCUMENT.names, F.posexplode("shards").alias("copy", "shard"))
    return drawn.repartition("shard").sortWithinPartitions("shard", fraction("doc_id", "copy", seed=55), "doc_id").select(*DOCUMENT.names)
