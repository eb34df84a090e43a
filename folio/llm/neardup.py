"""MinHash near-dedup (operator 8) with tensored banding, every link confirmed on full shingle sets.

* Words are runs of anything but ASCII white space after lower-casing A-Z; a document's set is its distinct
  ``n``-word shingles (with fewer words the whole sequence as one; without words or text the set is empty and
  linked with nothing). Shingles are 64-bit hashes.
* Documents of equal sets form a class at once, by a grouped minimum, so any number of exact copies is one row.
  A class is named by a 64-bit hash of its set, so rows without an id, or of one id and several texts, are apart.
* Tensored banding: two small collections of ``r`` keys, each of ``k`` minhashes, are combined pairwise into
  ``r * r`` table keys, of 2 * k minhashes each: 2 * r * k minhashes do the work of 2 * r * r * k. Two documents
  meet in a table iff they share a key of either collection, so documents that share none are set aside before
  the keys are combined. At likeness 0.8 the defaults miss a pair with a chance of 0.0004.
* The tables link each document to the least of its bucket: linear in the bucket, no pairs. Components of those
  links are clusters: whatever meets in a table is in one cluster.
* In clusters *all* likenesses are counted exactly, by an inverted index over the sets. Clusters of many
  shingles are cut into blocks and each two blocks meet in a task of their own, so no task holds a large group.
  What leaves a task is a spanning forest of the links. Components of those are the result.

An empty table gives an empty one; columns other than those of ``documents`` are ignored, also clashing ones; repeated rows are each told; very long texts are whole.
Component ids are least doc_ids; a null id counts as the least (-2^63), so components that both have a null id, or one
repeated id, as their least share that number. One row of each component is kept: of the least id, and of rows of that
id the one whose columns have the least hash (of wholly equal rows, any). Empty documents have the component of their
own id and are kept.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from folio.llm.common import DOCUMENT, arrow_schema, conform, cut, map_batches

KEYS, PER_KEY = 12, 3
CLUSTER_SHINGLES = 300_000
SALTS = 32  # tasks that share the rows of one large component
SPREAD = 8  # and of one hot node or table key
PRIME_A, PRIME_B = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)


class WordHashes(dict):
    def __missing__(self, word: bytes) -> int:
        if len(self) > 400_000:
            self.clear()
        got = self[word] = xxhash.xxh3_64_intdigest(word)
        return got


def shingles(text: str | None, n: int, hashes: WordHashes) -> np.ndarray:
    """The sorted distinct hashes of a text's ``n``-word shingles."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()  # bytes: ASCII case and white space only
    if not words:
        return np.empty(0, np.uint64)
    h = np.fromiter(map(hashes.__getitem__, words), np.uint64, len(words))
    n = min(n, len(h))
    out = h[: len(h) - n + 1].copy()
    for k in range(1, n):
        out = (out ^ (out >> np.uint64(31))) * PRIME_A + h[k : len(h) - n + 1 + k]
    out = (out ^ (out >> np.uint64(29)) ^ np.uint64(n)) * PRIME_B
    return np.unique(out ^ (out >> np.uint64(32)))


def coefficients(count: int) -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(8)
    return rng.integers(0, 2**63, count, np.uint64) * np.uint64(2) + np.uint64(1), rng.integers(0, 2**63, count, np.uint64)


A, B = coefficients(2 * KEYS * PER_KEY)


def keys_of(found: np.ndarray) -> np.ndarray:
    """The 2 * KEYS keys (uint32) of a set: KEYS of either collection."""
    least = np.full(len(A), np.iinfo(np.uint32).max, np.uint32)
    for at in range(0, len(found), 4096):
        part = found[at : at + 4096]
        np.minimum(least, ((A[:, None] * part + B[:, None]) >> np.uint64(32)).min(axis=1).astype(np.uint32), out=least)
    key = np.zeros(2 * KEYS, np.uint64)
    for m in least.reshape(2 * KEYS, PER_KEY).astype(np.uint64).T:
        key = (key ^ m) * PRIME_A
        key ^= key >> np.uint64(29)
    return (key >> np.uint64(32)).astype(np.uint32)


SIGNED = T.StructType(
    [
        T.StructField("doc_id", T.LongType()),
        T.StructField("seal", T.LongType()),
        T.StructField("n_shingles", T.LongType()),
        T.StructField("set_key", T.BinaryType()),
        T.StructField("keys", T.ArrayType(T.IntegerType())),
    ]
)


def sealed(docs: DataFrame) -> DataFrame:
    """The rows with ``id``, which is never null, and ``seal``, a hash of all columns."""
    return conform(docs, DOCUMENT).withColumn("id", F.coalesce("doc_id", F.lit(-(2**63)))).withColumn("seal", F.xxhash64(*DOCUMENT.names))


def signed(docs: DataFrame, n: int) -> DataFrame:
    def make():
        hashes = WordHashes()

        def step(batch: pa.RecordBatch) -> dict:
            sets = [shingles(t, n, hashes) for t in batch["text"].to_pylist()]
            return {
                "doc_id": batch["doc_id"],
                "seal": batch["seal"],
                "n_shingles": [len(s) for s in sets],
                "set_key": [xxhash.xxh3_128_digest(s.tobytes()) if len(s) else None for s in sets],
                "keys": [keys_of(s).view(np.int32) if len(s) else None for s in sets],
            }

        return step

    return map_batches(sealed(docs).select("doc_id", "text", "seal"), SIGNED, make)


def spread(column: str) -> Column:
    return F.pmod(F.xxhash64(column), F.lit(SPREAD)).cast("int")


def salted(df: DataFrame, salts: int = SPREAD) -> DataFrame:
    """Each row once for each salt, for the lesser side of a join with a hot key."""
    return df.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))


def components(links: DataFrame) -> DataFrame:
    """(node, root) of the components of (a, b) links, for nodes that have any; root is the least node.

    Large-star and small-star rounds until nothing changes, some log n squared of them; each is two grouped minima and joins, and is
    checkpointed, so nothing grows on one task and a lost executor costs one round.
    """
    edges = cut(links.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct())

    def weight(e: DataFrame) -> tuple:
        return tuple(e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())

    before = weight(edges)
    while before[0]:
        both = edges.select("u", "v").union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").withColumn("salt", spread("v")).join(salted(least), ["u", "salt"]).select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = large.where("u <> v").distinct()
        lesser = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(lesser, "u").select(F.explode(F.array(F.struct(F.col("v").alias("u"), F.col("m").alias("v")), F.struct("u", F.col("m").alias("v")))).alias("e")).select("e.u", "e.v")
        edges = cut(small.where("u <> v").distinct())
        after = weight(edges)
        if after == before:
            break
        before = after
    return edges.select(F.col("u").alias("node"), F.col("v").alias("root")).union(edges.select("v", "v").distinct())


def clusters(classes: DataFrame) -> DataFrame:
    """(node, root): which classes (id, keys) meet in tables, directly or over others."""
    # Keys of one collection that more than one class has; only classes with such keys of both can meet in a table.
    each = classes.select("id", F.posexplode("keys").alias("i", "k"))
    shared = each.groupBy("i", "k").agg(F.count("*").alias("n")).where("n > 1").select("i", "k")
    alive = cut(each.join(shared, ["i", "k"]).groupBy("id").agg(F.collect_list(F.struct("i", "k")).alias("kept")))
    first, second = F.filter("kept", lambda x: x["i"] < KEYS), F.filter("kept", lambda x: x["i"] >= KEYS)
    tables = alive.select("id", F.explode(first).alias("a"), second.alias("bs")).select("id", "a", F.explode("bs").alias("b"))
    tables = tables.select("id", F.xxhash64("a.i", "a.k", "b.i", "b.k").alias("table_key"))
    hubs = tables.groupBy("table_key").agg(F.min("id").alias("hub"), F.count("*").alias("n")).where("n > 1").select("table_key", "hub")
    met = tables.withColumn("salt", spread("id")).join(salted(hubs), ["table_key", "salt"]).where("id <> hub").select(F.col("id").alias("a"), F.col("hub").alias("b")).distinct()
    return components(met)


SETS = T.StructType([T.StructField("root", T.LongType()), T.StructField("id", T.LongType()), T.StructField("blocks", T.IntegerType()), T.StructField("block", T.IntegerType()), T.StructField("shingles", T.BinaryType())])
LINK = T.StructType([T.StructField("a", T.LongType()), T.StructField("b", T.LongType())])


def forest(left: list[tuple[int, np.ndarray]], right: list[tuple[int, np.ndarray]] | None, percent: int) -> list[tuple[int, int]]:
    """Spanning links of all documents of ``left`` among themselves, or with those of ``right``, at ``percent`` or more; likenesses are exact."""
    other = right if right is not None else left
    ids = [i for i, _ in left] + ([i for i, _ in right] if right is not None else [])
    up = {i: i for i in ids}

    def root(i: int) -> int:
        while up[i] != i:
            up[i] = i = up[up[i]]
        return i

    sizes = np.array([len(s) for _, s in other])
    values = np.concatenate([s for _, s in other])
    owners = np.repeat(np.arange(len(other)), sizes)
    order = np.argsort(values, kind="stable")
    values, owners = values[order], owners[order]
    out = []
    for at, (i, s) in enumerate(left):
        lo, hi = np.searchsorted(values, s, "left"), np.searchsorted(values, s, "right")
        n = hi - lo
        hits = owners[np.repeat(lo - np.concatenate([[0], np.cumsum(n)[:-1]]), n) + np.arange(n.sum())]
        both = np.bincount(hits, minlength=len(other))
        linked = np.flatnonzero(100 * both >= percent * (sizes + len(s) - both))
        for j in linked.tolist():
            if right is not None or j < at:
                a, b = root(i), root(other[j][0])
                if a != b:
                    up[max(a, b)] = min(a, b)
                    out.append((i, other[j][0]))
    return out


def links(docs: DataFrame, grouped: DataFrame, n: int, percent: int) -> DataFrame:
    """(a, b): a spanning forest of the true links, of classes that ``grouped`` (node, root, n_shingles, and id and seal of a row) puts together."""

    def make():
        hashes = WordHashes()
        return lambda batch: {c: batch[c] for c in ("root", "id", "blocks", "block")} | {"shingles": [shingles(t, n, hashes).tobytes() for t in batch["text"].to_pylist()]}

    sums = grouped.groupBy("root").agg(F.sum("n_shingles").alias("total")).select("root", F.ceil(F.col("total") / CLUSTER_SHINGLES).cast("int").alias("blocks"))
    texts = sealed(docs).select("id", "seal", "text")
    # A large cluster is many tasks, and so are rows that are repeated very often.
    placed = grouped.withColumn("salt", spread("node")).join(salted(sums), ["root", "salt"]).withColumn("block", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int")).drop("salt")
    full = texts.withColumn("salt", (F.monotonically_increasing_id() % SPREAD).cast("int")).join(salted(placed), ["id", "seal", "salt"]).select("root", F.col("node").alias("id"), "text", "blocks", "block").dropDuplicates(["id"])
    sets = map_batches(full, SETS, make)
    pairs = F.transform(F.sequence(F.lit(0), F.col("blocks") - 1), lambda j: F.struct(F.least("block", j).alias("x"), F.greatest("block", j).alias("y")))
    dealt = sets.select("root", "id", "shingles", "block", F.explode(pairs).alias("pair")).select("root", "pair.x", "pair.y", "block", "id", "shingles")
    dealt = dealt.repartition("root", "x", "y").sortWithinPartitions("root", "x", "y", "id")
    out = arrow_schema(LINK)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[int, int, np.ndarray]] = []
        now, found = None, []

        def end() -> None:
            if len(held) > 1 and now is not None:
                left = [(i, s) for block, i, s in held if block == now[1]]
                right = None if now[1] == now[2] else [(i, s) for block, i, s in held if block == now[2]]
                if left and (right is None or right):
                    found.extend(forest(left, right, percent))
            held.clear()

        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                piece = batch.slice(at, 512)
                for root, x, y, block, i, s in zip(*(piece[c].to_pylist() for c in ("root", "x", "y", "block", "id", "shingles"))):
                    if (root, x, y) != now:
                        end()
                        now = (root, x, y)
                    held.append((block, i, np.frombuffer(s, np.uint64)))
            if found:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*found)], schema=out)
                found.clear()
        end()
        if found:
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*found)], schema=out)

    return dealt.mapInArrow(run, LINK)


def judged(docs: DataFrame, n: int, percent: int) -> DataFrame:
    """doc_id, id, seal, n_shingles, component_id, kept for every row."""
    all_rows = cut(signed(docs, n).withColumn("id", F.coalesce("doc_id", F.lit(-(2**63)))).withColumn("row", F.monotonically_increasing_id()))
    full = all_rows.where("set_key is not null")
    # One row a class, with map-side minima: hot copies are one row a task.
    by_set = cut(full.groupBy("set_key").agg(F.min(F.struct("id", "seal", "row", "n_shingles", "keys")).alias("of"), F.count("*").alias("copies")).withColumn("node", F.xxhash64("set_key")))
    classes = by_set.select(F.col("node").alias("id"), "of.n_shingles", "of.keys")
    grouped = clusters(classes).join(by_set.select("node", "of.n_shingles", "of.id", "of.seal"), "node")
    roots = cut(components(links(docs, grouped, n, percent)))
    first = by_set.select("node", F.struct("of.id", "of.seal", "of.row").alias("least"))
    heads = roots.join(first, "node").groupBy("root").agg(F.min("least").alias("head"))
    # A large component is many tasks.
    headed = roots.withColumn("salt", F.pmod(F.xxhash64("node"), F.lit(SALTS)).cast("int")).join(salted(heads, SALTS), ["root", "salt"]).select("node", "head")
    # What classes of one row, alone in their component, are told is what they are. A class of very many copies is many tasks, as
    # its rows meet it by salt; rows without words meet nothing.
    by_class = by_set.join(headed, "node", "left").where("head is not null or copies > 1").select("set_key", F.coalesce("head", F.struct("of.id", "of.seal", "of.row")).alias("head"))
    rows = full.withColumn("salt", F.pmod(F.xxhash64("row"), F.lit(SALTS)).cast("int"))
    parts = cut(rows.select("set_key", "salt").distinct().join(by_class, "set_key"))
    out = rows.join(parts, ["set_key", "salt"], "left").drop("salt").unionByName(all_rows.where("set_key is null"), allowMissingColumns=True)
    kept = F.col("head").isNull() | (F.col("row") == F.col("head.row"))
    return out.select("doc_id", "id", "seal", "n_shingles", F.coalesce("head.id", "id").alias("component_id"), kept.alias("kept"))


def near_duplicates(docs: DataFrame, n: int = 5, percent: int = 80) -> DataFrame:
    """doc_id, n_shingles, component_id, kept for every row."""
    return judged(docs, n, percent).select("doc_id", "n_shingles", "component_id", "kept")


def keep_one(docs: DataFrame, n: int = 5, percent: int = 80) -> DataFrame:
    """One row of each group of near copies; empty documents stay."""
    by_row = judged(docs, n, percent).groupBy("id", "seal").agg(F.count("*").alias("n"), F.count_if("kept").alias("stay"))
    some = cut(by_row.where("stay < n"))
    rows = sealed(docs)
    out = rows.join(some, ["id", "seal"], "left_anti")
    again = some.where("stay > 0").select("id", "seal")  # equal rows, of which one stays
    if not again.isEmpty():
        out = out.union(rows.join(again, ["id", "seal"], "left_semi").select(*out.columns).dropDuplicates(["id", "seal"]))
    return out.select(*DOCUMENT.names)
