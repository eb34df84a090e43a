"""Document fingerprints (operator 1) by locally consistent parsing.

A text is a sequence of names, at first its code points. At each level runs of equal names become one
name, then deterministic coin tossing (two names are compared at their lowest differing bit) shrinks
the alphabet to a few labels, and local maxima of the labels begin the phrases. A phrase is named by a
hash of what it holds. Where phrases begin depends on a few names around only, so equal substrings get
equal phrases inside, at whatever offset they stand. Levels repeat until one phrase is left.

The names of levels two and up (all levels if there are none) form a set; its ``SKETCH`` smallest
hashes are the fingerprint, and two fingerprints estimate the Jaccard likeness of the sets. Equal
texts have equal fingerprints. The empty (or null) text has an empty fingerprint, likeness 1 to
itself and 0 to others.

The next document is found without one global sort: ids are cut into buckets of some ``BUCKET_ROWS`` rows at
quantiles, the first document of each bucket is sent to the bucket before as well, and tasks read their buckets in
order, row by row. Beyond ``MOST_BUCKETS`` buckets they grow (their tasks hold one slice at a time all the same).
Rows of null id come first; rows of one id are ordered by a hash of their text, then by the text, and an id of more rows
than a bucket is cut by that hash. Very long texts are parsed whole. The empty table has no rows; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import json
from collections import Counter
from collections.abc import Iterator
from itertools import accumulate, pairwise
from math import isqrt

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from folio.llm.common import arrow_schema, documents, slices

SKETCH = 64
LEVELS = 24
MOST_BUCKETS = 16_384
BUCKET_ROWS = 2000

ODD, ODD2, ODD3 = np.uint32(0x9E3779B1), np.uint32(0x85EBCA6B), np.uint32(0xC2B2AE35)
SALTS = np.arange(LEVELS, dtype=np.uint32) * ODD
BRUIJN = np.uint32(0x077CB531)


def lowest_bits() -> np.ndarray:
    out = np.zeros(32, np.uint8)
    for i in range(32):
        out[((1 << i) * int(BRUIJN) & 0xFFFFFFFF) >> 27] = i
    return out


def toss_table(size: int) -> np.ndarray:
    """[label before, label] -> next label, for labels under ``size``."""
    a, b = np.meshgrid(np.arange(size, dtype=np.uint32), np.arange(size, dtype=np.uint32), indexing="ij")
    x = (a ^ b).astype(np.int64)
    k = np.where(x == 0, 0, np.log2(np.maximum(x & -x, 1)).astype(np.int64))
    return (2 * k + (b >> k & 1)).astype(np.uint8)


LOWEST, TOSS64, TOSS12 = lowest_bits(), toss_table(64).ravel(), toss_table(12).ravel()


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint32(16))) * ODD2
    x ^= x >> np.uint32(13)
    x *= ODD3
    x ^= x >> np.uint32(16)
    return x


POWERS = np.cumprod(np.full(4096, ODD, np.uint32), dtype=np.uint32)


def parse(names: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """One level over many sequences: the names of the phrases, and where each sequence starts now. ``starts`` has no empty sequence."""
    n = len(names)
    first = np.zeros(n, bool)
    first[starts] = True
    # runs of equal names become one
    new = first.copy()
    new[1:] |= names[1:] != names[:-1]
    at = np.flatnonzero(new)
    if len(at) < n:
        runs = np.diff(at, append=n).astype(np.uint32)
        names, first = names[at], first[at]
        many = runs > 1
        names[many] = mix(names[many] + runs[many] * ODD)
        n = len(names)
    low = names
    # coin tossing: 32 bits -> 64 labels -> 12 -> 8
    before = np.empty_like(low)
    before[1:], before[0] = low[:-1], 0
    before[first] = 0
    x = low ^ before
    k = LOWEST[((x & (~x + np.uint32(1))) * BRUIJN) >> np.uint32(27)]
    label = (2 * k + (low >> k & np.uint32(1))).astype(np.uint8)
    for table, width in ((TOSS64, 64), (TOSS12, 12)):
        pair = np.empty(n, np.int32)
        pair[1:] = label[:-1]
        pair[0] = 0
        pair[first] = 0
        label = table[pair * width + label]
    head = first.copy()
    head[1:-1] |= (label[1:-1] > label[:-2]) & (label[1:-1] > label[2:])
    last = np.append(np.flatnonzero(first)[1:], n) - 1
    head[last] = first[last]  # whatever sequence comes next
    if n > 1:  # a phrase of one name at the very start of a sequence joins what follows
        alone = np.flatnonzero(first[:-1]) + 1
        head[alone[~first[alone]]] = False
    heads = np.flatnonzero(head)
    sizes = np.diff(heads, append=n)
    place = np.arange(n, dtype=np.int32)
    place -= np.repeat(place[heads], sizes)
    hashed = mix(names + ODD)
    hashed *= POWERS[place]  # phrases are a few names long
    return mix(np.add.reduceat(hashed, heads, dtype=np.uint32) + sizes.astype(np.uint32)), np.flatnonzero(first[heads])


def name_sets(texts: list[str]) -> list[np.ndarray]:
    """The bottom sketch (sorted uint32) of the phrase names of each text."""
    sizes = np.array([len(t) for t in texts], np.int64)
    full = np.flatnonzero(sizes)
    out = [np.empty(0, np.uint32)] * len(texts)
    if not len(full):
        return out
    names = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32)
    starts = np.cumsum(sizes[full]) - sizes[full]
    whose, owner, values, rest = np.arange(len(full)), [], [], full
    for level in range(1, LEVELS):
        names, starts = parse(names, starts)
        lengths = np.diff(starts, append=len(names))
        ends = lengths == 1
        keep = np.ones(len(names), bool) if level > 1 else np.repeat(ends, lengths)  # a text of one phrase has that
        owner.append(np.repeat(whose, lengths)[keep])
        values.append(mix(names[keep] + SALTS[level]))
        if ends.all():
            break
        on = ~ends
        names, whose, lengths = names[np.repeat(on, lengths)], whose[on], lengths[on]
        starts = np.cumsum(lengths) - lengths
    both = np.sort(np.concatenate(owner).astype(np.uint64) << np.uint64(32) | np.concatenate(values))
    both = both[np.append(True, both[1:] != both[:-1])]
    owners = (both >> np.uint64(32)).astype(np.int64)
    edges = np.searchsorted(owners, np.arange(len(full) + 1))
    low = (both & np.uint64(0xFFFFFFFF)).astype(np.uint32)
    for i, (a, b) in enumerate(pairwise(edges.tolist())):
        out[rest[i]] = low[a : min(b, a + SKETCH)]
    return out


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    """Jaccard likeness by the smallest names of the union."""
    if not len(a) or not len(b):
        return float(len(a) == len(b))
    both = np.intersect1d(a, b, assume_unique=True)
    union = np.union1d(a, b)[:SKETCH]
    return float(np.count_nonzero(both <= union[-1]) / len(union))


def written(sketch: np.ndarray) -> str:
    return sketch.astype(">u4").tobytes().hex()


def edited(text: str, after: str) -> str:
    half = len(text) // 2
    return text[: len(text) - half] + after[:half]


FINGERPRINT = T.StructType(
    [
        T.StructField("doc_id", T.LongType()),
        T.StructField("n_chars", T.LongType()),
        T.StructField("edited_sha256", T.StringType()),
        T.StructField("fingerprint", T.StringType()),
        T.StructField("edited_fingerprint", T.StringType()),
        T.StructField("near_edited", T.DoubleType()),
        T.StructField("near_next", T.DoubleType()),
    ]
)


def bucket_of(cuts: list[int], place: Column, order: Column) -> Column:
    """The number of a row's bucket, in the order of (place, order): one more for each cut that is not after the row.

    A cut that comes ``m`` times belongs to an id of many rows, which is cut in ``m`` by the hash. Cuts are searched in
    two steps, in some of them and then between two of those.
    """
    if not cuts:
        return F.lit(0)
    many = sorted(Counter(cuts).items())
    step = isqrt(len(many)) + 1
    numbered = [(c, m, number) for (c, m), number in zip(many, accumulate((m for _, m in many), initial=1))]  # (cut, how often, buckets before)
    lists = [numbered[i : i + step] for i in range(0, len(numbered), step)]
    known = F.from_json(F.lit(json.dumps(lists)), "array<array<array<bigint>>>")  # folded into a constant
    top = F.split(F.lit(",".join(str(x[0][0]) for x in lists)), ",").cast("array<bigint>")
    first = F.size(F.filter(top, lambda c: c <= place))
    near = F.element_at(known, F.greatest(first, F.lit(1)))
    last = F.element_at(near, F.greatest(F.size(F.filter(near, lambda x: x[0] <= place)), F.lit(1)))
    share = F.floor((F.shiftrightunsigned(order, 1) / F.lit(2.0**63)) * last[1])
    return F.when(first == 0, 0).otherwise(last[2] + F.when(place == last[0], share).otherwise(last[1] - 1)).cast("int")


def in_order(docs: DataFrame) -> DataFrame:
    """(bucket, copy, doc_id, text), each bucket whole and in order within one task; the row with copy 1 that ends a bucket follows its last document."""
    texts = documents(docs).select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    base = texts.select("*", F.coalesce("doc_id", F.lit(-(2**63))).alias("place"), F.xxhash64("text").alias("hash"))
    base = base.withColumn("order", F.expr("hash ^ (-9223372036854775807L - 1)"))  # as an unsigned number the hash keeps its order
    buckets = min(MOST_BUCKETS, base.count() // BUCKET_ROWS + 1)
    cuts = sorted(map(int, base.approxQuantile("place", [i / buckets for i in range(1, buckets)], 0.2 / buckets))) if buckets > 1 else []
    based = base.withColumn("bucket", bucket_of(cuts, F.col("place"), F.col("order")))
    heads = sorted((r["bucket"], r["head"]["place"], r["head"]["hash"]) for r in based.groupBy("bucket").agg(F.min(F.struct("place", "hash")).alias("head")).collect())  # a row for each bucket
    if not heads:
        return based.select("bucket", F.lit(0).alias("copy"), "doc_id", "text")
    spark = docs.sparkSession
    before = spark.createDataFrame([(place, of, heads[i - 1][0]) for i, (_, place, of) in enumerate(heads)], "place long, hash long, before int")  # MOST_BUCKETS rows at most
    own = F.struct(F.col("bucket"), F.lit(0).alias("copy"))
    both = F.when(F.col("before").isNull(), F.array(own)).otherwise(F.array(own, F.struct(F.col("before").alias("bucket"), F.lit(1).alias("copy"))))
    dealt = based.join(F.broadcast(before), ["place", "hash"], "left").select("doc_id", "text", "place", "hash", F.explode(both).alias("to"))
    dealt = dealt.select("to.bucket", "to.copy", "doc_id", "text", "place", "hash")
    return dealt.repartition(len(heads), "bucket").sortWithinPartitions("bucket", "copy", "place", "hash", "text").select("bucket", "copy", "doc_id", "text")


def fingerprint(docs: DataFrame) -> DataFrame:
    """One row per document: its fingerprint, that of its edited text, and both likenesses."""
    schema = arrow_schema(FINGERPRINT)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        for batch in batches:
            for piece in slices(batch, 48, 200_000):  # arrays of this size stay in the cache and cost no page faults
                rows = held + list(zip(*(piece[c].to_pylist() for c in ("bucket", "copy", "doc_id", "text"))))
                held = rows[-1:]
                pairs = [(i, i + 1) for i in range(len(rows) - 1) if not rows[i][1] and rows[i][0] == rows[i + 1][0]]
                changed = [edited(rows[i][3], rows[j][3]) for i, j in pairs]
                sets = name_sets([r[3] for r in rows] + changed)
                others = sets[len(rows) :]
                columns = [
                    [rows[i][2] for i, _ in pairs],
                    [len(rows[i][3]) for i, _ in pairs],
                    [hashlib.sha256(c.encode("utf-8", "surrogatepass")).hexdigest() for c in changed],
                    [written(sets[i]) for i, _ in pairs],
                    [written(x) for x in others],
                    [likeness(sets[i], x) for (i, _), x in zip(pairs, others)],
                    [likeness(sets[i], sets[j]) for i, j in pairs],
                ]
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema)], schema=schema)

    return in_order(docs).mapInArrow(run, FINGERPRINT)
