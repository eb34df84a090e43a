"""Importance resampling towards a target (operator 13): hashed word n-grams, a dictionary of distinct features, and Gumbel top-k.

* Features are runs of one to two words (see ``words``). A slice of documents keeps its distinct words and its stream of word numbers; its distinct features go, with
  their counts, to the shards of ``packed``. A shard's dictionary has each distinct string once, is the only place where strings are hashed (crc32 of
  their bytes), and sums counts by bucket; it answers each slice with the buckets of what it was asked.
* Buckets of all documents and of all target texts give 10,000 gains (that table is what tasks are handed, whatever the input). They are joined to the feature
  counts of each document through the answers to its slice, and summed.
* The noise of a document depends on its id and the seed alone. The drawn are found by order without a global window: rows are dealt by ranges of the order, a rank is the place in
  the range plus what the ranges before it hold.

Result: doc_id, n_features, weight, score, rank for every row. Null and empty texts have no features and weight 0. A null id has the noise of an empty id and counts as the
least in ties; rows of one id share their noise, repeated rows are drawn each, next to each other, ties of score and id by weight and features. Very long texts are whole. Empty tables (of documents or of the target) give an empty result
and gains against nothing. Columns other than id and text are ignored, also clashing ones.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from folio.llm import packed
from folio.llm.common import conform, cut, map_batches

BUCKETS, SEED, LEAST_WORDS, PERCENT = 10_000, 7, 20, 25
#: Bytes of words, lower-cased; all others are blanks.
LETTERS = bytes(c + 32 if 65 <= c <= 90 else c if c >= 128 or 48 <= c <= 57 or 97 <= c <= 122 else 32 for c in range(256))
IDENTITY = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType())])


def words(text: str | None) -> list[bytes]:
    """Runs of letters, digits and everything beyond ASCII, A-Z lower-cased."""
    return (text or "").encode("utf-8", "surrogatepass").translate(LETTERS).split()


def sliced(docs: DataFrame) -> DataFrame:
    """The header of each slice: a: ids and which are null, b: words of each document, c: distinct words, d: the stream of words as numbers."""

    def make():
        numbers = packed.slice_numbers()

        def step(batch: pa.RecordBatch) -> dict:
            number: dict[bytes, int] = {}
            stream, lengths = [], []
            for text in batch["text"].to_pylist():
                found = words(text)
                lengths.append(len(found))
                stream.append(np.fromiter((number.setdefault(w, len(number)) for w in found), np.uint32, len(found)))
            ids = batch["doc_id"].to_pylist()
            known = np.array([i is not None for i in ids])
            a = np.array([i or 0 for i in ids], np.int64).tobytes() + known.tobytes()
            return packed.columns([(next(numbers), packed.HEADER, packed.press(a), packed.press(np.array(lengths, np.int64)), packed.press(b"\n".join(number)), packed.press(np.concatenate(stream)))], packed.PACKED)

        return step

    return map_batches(conform(docs, IDENTITY), packed.PACKED, make, rows=100_000, size=packed.SLICE)


def features(b: bytes, c: bytes, d: bytes) -> tuple:
    """Of a header: lengths, distinct words, the stream, and distinct pairs (as one number) with the pair of each place that begins one."""
    lengths, stream = np.frombuffer(packed.unpress(b), np.int64), np.frombuffer(packed.unpress(d), np.uint32)
    vocabulary = packed.unpress(c).split(b"\n") if len(stream) else []
    ends = np.cumsum(lengths)
    inner = np.ones(max(len(stream) - 1, 0), bool)
    last = ends[:-1] - 1
    inner[last[(last >= 0) & (last < len(inner))]] = False  # a pair doesn't reach over the end of its document
    begins = np.flatnonzero(inner)
    pairs, of, counts = np.unique(stream[begins].astype(np.int64) * max(len(vocabulary), 1) + stream[begins + 1], return_inverse=True, return_counts=True)
    return lengths, vocabulary, stream, begins, pairs, of, counts


def shard_of(vocabulary: list[bytes], pairs: np.ndarray, shards: int) -> np.ndarray:
    """The shards of all features of a slice, words first. A shard depends on the words alone, so equal strings meet."""
    hashes = np.fromiter(map(xxhash.xxh3_64_intdigest, vocabulary), np.uint64, len(vocabulary))
    first, second = (hashes[x] for x in np.divmod(pairs, max(len(vocabulary), 1)))
    both = (first ^ (first >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15) + second
    both ^= both >> np.uint64(29)
    return (np.concatenate([hashes, both]) % np.uint64(shards)).astype(np.int64)


def asked(headers: DataFrame, shards: int) -> DataFrame:
    """For each slice and shard: a: distinct features, b: how often the slice has each."""

    def make():
        def step(batch: pa.RecordBatch) -> dict:
            out = []
            for slice_, b, c, d in zip(*(batch[x].to_pylist() for x in ("slice", "b", "c", "d"))):
                _, vocabulary, stream, _, pairs, _, counts = features(b, c, d)
                first, second = (x.tolist() for x in np.divmod(pairs, max(len(vocabulary), 1)))
                often = np.concatenate([np.bincount(stream, minlength=len(vocabulary)), counts]).astype(np.uint32)
                for k, places in packed.by_shard(shard_of(vocabulary, pairs, shards), shards):
                    at = (places - len(vocabulary)).tolist()
                    strings = b"\n".join([vocabulary[first[i]] + b" " + vocabulary[second[i]] if i >= 0 else vocabulary[i + len(vocabulary)] for i in at])
                    out.append((slice_, k, packed.press(strings), packed.press(often[places]), None, None))
            return packed.columns(out, packed.PACKED)

        return step

    return map_batches(headers, packed.PACKED, make, rows=1)


class Dictionary(dict):
    """The bucket of each distinct string, hashed when it is first met."""

    def __init__(self, buckets: int):
        self.buckets = buckets

    def __missing__(self, feature: bytes) -> int:
        got = self[feature] = zlib.crc32(feature) % self.buckets
        return got


def answered(buckets: int):
    """For ``packed.grouped`` by shard: the buckets of each slice's features (a), and after each shard its sums of counts (slice -1, b)."""

    def make() -> tuple:
        known, sums = Dictionary(buckets), np.zeros(buckets, np.int64)

        def row(slice_, shard, a, b, c, d):
            strings = packed.unpress(a).split(b"\n")
            of = np.fromiter(map(known.__getitem__, strings), np.uint16 if buckets <= 65536 else np.uint32, len(strings))
            np.add.at(sums, of, np.frombuffer(packed.unpress(b), np.uint32).astype(np.int64))
            return [(slice_, shard, of.tobytes(), None, None, None)]

        def end(shard):
            told = sums.tobytes()
            known.clear()
            sums[:] = 0
            return [(-1, shard, None, packed.press(told), None, None)]

        return row, end

    return make


def counted(headers: DataFrame, shards: int, buckets: int) -> DataFrame:
    return packed.grouped(asked(headers, shards), "shard", "slice", packed.PACKED, answered(buckets))


def totals(answers: DataFrame, buckets: int) -> np.ndarray:
    """Features of each bucket: sums of one array a shard, added up by place."""
    kind = T.StructType([T.StructField("n", T.ArrayType(T.LongType()))])

    def run(batches):
        total = np.zeros(buckets, np.int64)
        for batch in batches:
            for told in batch["b"].to_pylist():
                total += np.frombuffer(packed.unpress(told), np.int64)
        yield pa.RecordBatch.from_arrays([pa.array([total.tolist()], pa.list_(pa.int64()))], names=["n"])

    rows = answers.where("slice = -1").select("b").mapInArrow(run, kind).select(F.posexplode("n").alias("bucket", "n")).where("n > 0")
    out = np.zeros(buckets, np.int64)
    for bucket, n in rows.groupBy("bucket").agg(F.sum("n").alias("n")).collect():  # a row a bucket at most
        out[bucket] = n
    return out


def gains(s: np.ndarray, t: np.ndarray) -> np.ndarray:
    """floor(1000 * ln((t + 1) * (S + buckets) / ((s + 1) * (T + buckets)))) of each bucket."""
    ratio = ((t + 1.0) * float(s.sum() + len(s))) / ((s + 1.0) * float(t.sum() + len(t)))
    return np.floor(1000 * np.log(ratio)).astype(np.int64)


SUMS = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("n_words", T.LongType()), T.StructField("n_features", T.LongType()), T.StructField("weight", T.LongType())])


def weighed(gain: np.ndarray, shards: int):
    """For ``packed.grouped`` by slice: joins gains to the features of each document."""

    def make() -> tuple:
        held: list = []
        told: dict[int, bytes] = {}

        def row(slice_, shard, a, b, c, d):
            if shard == packed.HEADER:
                held.append((a, b, c, d))
            else:
                told[shard] = a
            return []

        def end(slice_):
            a, b, c, d = held.pop()
            lengths, vocabulary, stream, begins, pairs, of, _ = features(b, c, d)
            worth = np.zeros(len(vocabulary) + len(pairs), np.int64)
            for k, places in packed.by_shard(shard_of(vocabulary, pairs, shards), shards):
                worth[places] = gain[np.frombuffer(told[k], np.uint16 if len(gain) <= 65536 else np.uint32)]
            told.clear()
            at = np.zeros(len(stream) + 1, np.int64)
            each = worth[: len(vocabulary)][stream]
            each[begins] += worth[len(vocabulary) :][of]
            np.cumsum(each, out=at[1:])
            ends = np.cumsum(lengths)
            sums, n = at[ends] - at[ends - lengths], np.maximum(2 * lengths - 1, 0)
            ids = packed.unpress(a)
            known = np.frombuffer(ids, bool, offset=8 * len(lengths)).tolist()
            ids = np.frombuffer(ids, np.int64, count=len(lengths)).tolist()
            return list(zip([i if k else None for i, k in zip(ids, known)], lengths.tolist(), n.tolist(), np.where(n > 0, sums // np.maximum(n, 1), 0).tolist()))

        return row, end

    return make


def weights(docs: DataFrame, target: DataFrame, buckets: int = BUCKETS) -> DataFrame:
    """doc_id, n_words, n_features and weight (the floored mean gain) of every row."""
    headers, shards = cut(sliced(docs)), packed.shards_of(docs)
    answers = cut(counted(headers, shards, buckets))
    aims = counted(sliced(target), packed.shards_of(target), buckets)
    gain = gains(totals(answers, buckets), totals(aims, buckets))
    return packed.grouped(headers.union(answers.where("slice >= 0")), "slice", "shard", SUMS, weighed(gain, shards))


def resample(docs: DataFrame, target: DataFrame, percent: int = PERCENT, seed: int = SEED, least_words: int = LEAST_WORDS, buckets: int = BUCKETS) -> DataFrame:
    """doc_id, n_features, weight, score and rank (of the drawn; others null) of every row."""
    noise = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), 256), 1, 8), 16, 10).cast("long")
    score = F.col("weight") + F.floor(-1000 * F.log(-F.log((noise + 0.5) / 4294967296.0)))
    rows = weights(docs, target, buckets).withColumn("score", score.cast("long")).withColumn("able", F.col("n_words") >= least_words)
    order = [F.col("able").desc(), F.col("score").desc(), F.col("doc_id").asc_nulls_first(), "weight", "n_features"]
    dealt = cut(rows.repartitionByRange(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), *order).sortWithinPartitions(*order))
    # The number that Spark gives to a row is its partition, and its place there.
    placed = dealt.withColumn("at", F.monotonically_increasing_id()).withColumn("part", F.shiftright("at", 33)).withColumn("at", F.col("at").bitwiseAND(2**33 - 1))
    before, sums, able = 0, [], 0
    for part, n, fit in sorted(placed.groupBy("part").agg(F.count("*"), F.count_if("able")).collect()):  # a row a partition
        sums.append((part, before))
        before, able = before + n, able + fit
    starts = docs.sparkSession.createDataFrame(sums, "part long, start long")
    rank = F.col("start") + F.col("at") + 1
    out = placed.join(F.broadcast(starts), "part")
    return out.select("doc_id", "n_features", "weight", "score", F.when(F.col("able") & (rank <= percent * able // 100), rank).alias("rank"))
