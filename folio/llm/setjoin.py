"""Exact n-gram Jaccard join (operator 12): set-relation skipping over word shingles.

* Words are runs of anything but ASCII white space after lower-casing A-Z; a document's set is its distinct ``n``-word shingles (with
  fewer words the whole sequence as one) as 64-bit hashes in ascending order: that order is the same for all sets, and a token's
  place in it is its position. Equal sets are one class from the start.
* **Which sets can link at all.** Let t be the threshold. Two linked sets have at least l tokens in common among the first n - ceil(t n) + l of
  each, l being the lesser of a fifth of their sizes. These tokens go to the shards of ``packed``, which count how many sets hold them and
  give back those that more than one holds. A set with fewer of them than any partner must share has no link and is done:
  most sets of a corpus end here.
* **Index lists.** Of what is left each set is indexed under its rarest tokens, as many as no partner can avoid. Whatever shares a list is
  joined into clusters by links to the least of the list (no pairs), so every linked pair is in one cluster.
* **In clusters** the join is exact. Clusters of many shingles are cut by size and hash into blocks, and each two blocks whose sizes can link meet in a task:
  index lists hold prefixes by position, as blocks of equal position and size that are skipped at once where the tokens before and after can't
  make up the overlap; sets that differ little form groups, of which one set's overlaps with all others are counted from the full lists, and each other's
  are *derived* from those by the few tokens in which it differs, gained and lost. So near copies cost their differences, not their lengths.
* What leaves a task is, for each set, how many documents it links with, and a spanning forest of the links: never the pairs of a group.

Result: doc_id, n_shingles, component_id, n_links (other documents that this one links with, exact copies among them). Null, empty and blank texts have an empty
set, no link and their own id as component. A null id counts as the least, -(2^63); rows of one id and several texts are rows of their own, and so are repeated
rows, which link with each other. Very long texts are whole. An empty table gives an empty one. Columns other than those of ``documents`` are ignored, also those that clash with
names used here.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from folio.llm import packed
from folio.llm.common import arrow_schema, cut, give_back, map_batches
from folio.llm.neardup import SPREAD, WordHashes, components, sealed, shingles, spread

BLOCK_SHINGLES = 300_000
SALTS = 32  # tasks that share the rows of one large cluster or class
CELLS = 2_000_000  # overlaps held at once
NEAR = 4  # a set differs little from another if by a NEARth of its size at most
FIRST = 8  # tokens by which a similar set is looked for


def least_overlap(n: np.ndarray | int, percent: int) -> np.ndarray | int:
    """What a set of ``n`` tokens shares with any partner at least."""
    return -(-percent * n // 100)


def share(n: np.ndarray | int) -> np.ndarray | int:
    return np.maximum(1, n // 5)


def signature_size(n: int, percent: int) -> int:
    return min(n, n - least_overlap(n, percent) + int(share(n)))


def least_shared(n: np.ndarray, percent: int) -> np.ndarray:
    """How many signature tokens a set of ``n`` shares with any partner at least; partners have ``least_overlap`` tokens or more."""
    return np.minimum(share(n), share(least_overlap(n, percent)))


def node_of(found: np.ndarray) -> int:
    return int.from_bytes(xxhash.xxh3_64_digest(found.tobytes()), "little", signed=True)


KEYED = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("id", T.LongType()), T.StructField("seal", T.LongType()), T.StructField("n_shingles", T.LongType()), T.StructField("node", T.LongType())])


def keyed(docs: DataFrame, n: int) -> DataFrame:
    """doc_id, id, seal, n_shingles and the name of the set (null: empty) of every row."""

    def make():
        hashes = WordHashes()

        def step(batch: pa.RecordBatch) -> dict:
            sets = [shingles(t, n, hashes) for t in batch["text"].to_pylist()]
            return {c: batch[c] for c in ("doc_id", "id", "seal")} | {"n_shingles": [len(s) for s in sets], "node": [node_of(s) if len(s) else None for s in sets]}

        return step

    return map_batches(sealed(docs).select("doc_id", "id", "seal", "text"), KEYED, make)


def asked(docs: DataFrame, n: int, percent: int, shards: int) -> DataFrame:
    """Packed rows: the header of each slice (a: names of its sets, b: their sizes), and for each shard the signature tokens (a: places of the sets, b: tokens)."""

    def make():
        hashes, numbers = WordHashes(), packed.slice_numbers()

        def step(batch: pa.RecordBatch) -> dict:
            sets: dict[int, np.ndarray] = {}
            sizes: list[int] = []
            for text in batch["text"].to_pylist():
                found = shingles(text, n, hashes)
                if len(found) and (node := node_of(found)) not in sets:  # copies in a slice are one
                    sets[node] = found[: signature_size(len(found), percent)]
                    sizes.append(len(found))
            if not sets:
                return packed.columns([], packed.PACKED)
            at = next(numbers)
            tokens = np.concatenate(list(sets.values()))
            owner = np.repeat(np.arange(len(sets), dtype=np.int32), [len(s) for s in sets.values()])
            out = [(at, packed.HEADER, np.array(list(sets), np.int64).tobytes(), np.array(sizes, np.int64).tobytes(), None, None)]
            for k, places in packed.by_shard((tokens % np.uint64(shards)).astype(np.int64), shards):
                out.append((at, k, packed.press(owner[places]), tokens[places].tobytes(), None, None))
            return packed.columns(out, packed.PACKED)

        return step

    return map_batches(docs.select("text"), packed.PACKED, make, rows=100_000, size=packed.SLICE)


def shared_tokens() -> tuple:
    """For ``packed.grouped`` by shard: gives back, to each slice, the tokens that more than one row holds (a: places, b: tokens, c: counts)."""
    held: list[tuple[int, np.ndarray, np.ndarray]] = []

    def row(slice_, shard, a, b, c, d):
        if shard == packed.HEADER:
            return [(slice_, shard, a, b, c, d)]
        held.append((slice_, np.frombuffer(packed.unpress(a), np.int32), np.frombuffer(b, np.uint64)))
        return []

    def end(shard):
        if not held:
            return
        _, inverse, counts = np.unique(np.concatenate([t for _, _, t in held]), return_inverse=True, return_counts=True)
        count, start = counts[inverse], 0
        for slice_, places, tokens in held:
            n = count[start : start + len(tokens)]
            start += len(tokens)
            if (n > 1).any():
                yield slice_, shard, packed.press(places[n > 1]), tokens[n > 1].tobytes(), packed.press(n[n > 1].astype(np.int64)), None
        held.clear()

    return row, end


INDEX = T.StructType([T.StructField("token", T.LongType()), T.StructField("node", T.LongType())])


def index_rows(percent: int):
    """For ``packed.grouped`` by slice: the rarest tokens of each set that can link."""

    def make() -> tuple:
        kept: dict[str, object] = {}
        parts: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []

        def row(slice_, shard, a, b, c, d):
            if shard == packed.HEADER:
                kept["nodes"], kept["sizes"] = np.frombuffer(a, np.int64), np.frombuffer(b, np.int64)
            else:
                parts.append((np.frombuffer(packed.unpress(a), np.int32), np.frombuffer(b, np.uint64), np.frombuffer(packed.unpress(c), np.int64)))
            return []

        def end(slice_):
            if not parts:
                return
            owner, token, count = (np.concatenate(x) for x in zip(*parts))
            order = np.lexsort((token, count, owner))
            owner, token = owner[order], token[order]
            nodes, sizes = kept["nodes"], kept["sizes"]
            have = np.bincount(owner, minlength=len(nodes))
            take = have - least_shared(sizes, percent) + 1
            rank = np.arange(len(owner)) - np.repeat(np.cumsum(have) - have, have)
            good = rank < take[owner]
            parts.clear()
            yield from zip(token[good].view(np.int64).tolist(), nodes[owner[good]].tolist())

        return row, end

    return make


def clusters(lists: DataFrame) -> DataFrame:
    """(node, root): which sets (token, node) share a list, directly or over others."""
    hubs = lists.groupBy("token").agg(F.min("node").alias("hub"), F.count("*").alias("n")).where("n > 1").select("token", "hub")
    hubs = hubs.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SPREAD - 1))))  # a long list is several tasks
    met = lists.withColumn("salt", spread("node")).join(hubs, ["token", "salt"]).where("node <> hub").select(F.col("node").alias("a"), F.col("hub").alias("b"))
    return components(met.distinct())


def common(s: np.ndarray, other: np.ndarray) -> int:
    return len(np.intersect1d(s, other, assume_unique=True))


class Lists:
    """Inverted lists of some sets: whole ones, and those of prefixes in blocks of one token, position and size."""

    def __init__(self, sets: list[np.ndarray], percent: int):
        self.percent, self.sets, self.sizes = percent, sets, np.array([len(s) for s in sets], np.int64)
        values, owners = np.concatenate(sets), np.repeat(np.arange(len(sets)), self.sizes)
        places = np.arange(len(values)) - np.repeat(np.cumsum(self.sizes) - self.sizes, self.sizes)
        order = np.argsort(values, kind="stable")
        self.values, self.owners = values[order], owners[order]
        part = np.flatnonzero(places <= self.sizes[owners] - least_overlap(self.sizes, percent)[owners])
        v, p, o = values[part], places[part], owners[part]
        by = np.lexsort((self.sizes[o], p, v))
        v, p, o = v[by], p[by], o[by]
        new = np.ones(len(v), bool)
        new[1:] = (v[1:] != v[:-1]) | (p[1:] != p[:-1]) | (self.sizes[o[1:]] != self.sizes[o[:-1]])
        first = np.flatnonzero(new)
        self.token, self.place, self.size, self.bounds, self.members = v[first], p[first], self.sizes[o[first]], np.append(first, len(v)), o

    @staticmethod
    def spans(low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """All of low..high - 1 of each span, and which span each is of."""
        n = high - low
        return np.repeat(low - (np.cumsum(n) - n), n) + np.arange(n.sum()), np.repeat(np.arange(len(n)), n)

    def overlaps(self, tokens: np.ndarray, row: np.ndarray, rows: int) -> np.ndarray:
        """How many of each row's tokens each set has."""
        at, token = self.spans(np.searchsorted(self.values, tokens, "left"), np.searchsorted(self.values, tokens, "right"))
        return np.bincount(row[token] * len(self.sets) + self.owners[at], minlength=rows * len(self.sets)).reshape(rows, -1)

    def linked(self, sizes: np.ndarray, both: np.ndarray) -> np.ndarray:
        return 100 * both >= self.percent * (sizes[:, None] + self.sizes - both)

    def search(self, s: np.ndarray) -> np.ndarray:
        """The sets that link with ``s``: blocks that can't reach the overlap are skipped, what is left is compared whole."""
        n, percent = len(s), self.percent
        prefix = s[: n - least_overlap(n, percent) + 1]
        block, i = self.spans(np.searchsorted(self.token, prefix, "left"), np.searchsorted(self.token, prefix, "right"))
        size, j = self.size[block], self.place[block]
        most = np.minimum(i, j) + 1 + np.minimum(n - i, size - j) - 1
        good = block[(100 * size >= percent * n) & (100 * n >= percent * size) & (most * (100 + percent) >= percent * (n + size))]
        at, _ = self.spans(self.bounds[good], self.bounds[good + 1])
        met = np.unique(self.members[at])
        both = np.array([common(s, self.sets[k]) for k in met.tolist()], np.int64)
        return met[100 * both >= percent * (n + self.sizes[met] - both)]


def groups(sets: list[np.ndarray]) -> dict[int, list[int]]:
    """Sets that differ little from a first one, by that one."""
    by_token: dict[int, int] = {}
    out: dict[int, list[int]] = {}
    for at, s in enumerate(sets):
        first = s[:FIRST].tolist()
        near = next((by_token[t] for t in first if t in by_token), None)
        if near is not None and (len(s) + len(sets[near]) - 2 * common(s, sets[near])) * NEAR <= len(s):
            out[near].append(at)
        else:
            out[at] = [at]
            by_token.update(dict.fromkeys(first, at))
    return out


def answers(sets: list[np.ndarray], lists: Lists) -> Iterator[tuple[list[int], np.ndarray]]:
    """(some of ``sets``, their links as rows of booleans over the sets of ``lists``)."""
    chunk = max(1, CELLS // len(lists.sets))
    for lead, members in groups(sets).items():
        if len(members) == 1:
            line = np.zeros((1, len(lists.sets)), bool)
            line[0, lists.search(sets[lead])] = True
            yield members, line
            continue
        base = lists.overlaps(sets[lead], np.zeros(len(sets[lead]), np.int64), 1)
        for low in range(0, len(members), chunk):
            some = members[low : low + chunk]
            more = [np.setdiff1d(sets[m], sets[lead], assume_unique=True) for m in some]
            less = [np.setdiff1d(sets[lead], sets[m], assume_unique=True) for m in some]
            gained, lost = (lists.overlaps(np.concatenate(x), np.repeat(np.arange(len(x)), [len(d) for d in x]), len(x)) for x in (more, less))
            yield some, lists.linked(np.array([len(sets[m]) for m in some]), base + gained - lost)


class Forest:
    """Spanning links; labels are whole after each step."""

    def __init__(self, n: int):
        self.label, self.found = np.arange(n), []

    def join(self, at: int, others: np.ndarray) -> None:
        labels = self.label[others]
        while len(other := np.flatnonzero(labels != self.label[at])):
            k = other[0]
            self.found.append((at, int(others[k])))
            self.label[self.label == labels[k]] = self.label[at]
            labels = self.label[others]


def compared(left: list[tuple], right: list[tuple] | None, percent: int) -> list[tuple[int, int, int]]:
    """(node, node, links) of sets given as (node, copies, tokens): links to count for a node, and (a, b, 0) for a spanning forest of the links."""
    sets, other = [s for *_, s in left], [s for *_, s in (right if right is not None else left)]
    lists = Lists(other, percent)
    names = [i for i, *_ in left] + ([i for i, *_ in right] if right is not None else [])
    copies = np.array([c for _, c, _ in left], np.int64)
    copies_other = copies if right is None else np.array([c for _, c, _ in right], np.int64)
    links, links_other, forest, skip = np.zeros(len(sets), np.int64), np.zeros(len(other), np.int64), Forest(len(names)), 0 if right is None else len(left)
    for some, lines in answers(sets, lists):
        if right is None:
            lines[np.arange(len(some)), some] = False
        links[some] = lines @ copies_other
        if right is not None:
            links_other += copies[some] @ lines
        for at, line in zip(some, lines):
            forest.join(at, np.flatnonzero(line) + skip)
    out = [(names[a], names[b], 0) for a, b in forest.found]
    out += [(i, i, n) for i, n in zip(names, [*links.tolist(), *(links_other.tolist() if right is not None else [])]) if n]
    return out


SETS = T.StructType([T.StructField("root", T.LongType()), T.StructField("x", T.LongType()), T.StructField("y", T.LongType()), T.StructField("block", T.LongType()), T.StructField("node", T.LongType()), T.StructField("copies", T.LongType()), T.StructField("tokens", T.BinaryType())])
LINK = T.StructType([T.StructField("a", T.LongType()), T.StructField("b", T.LongType()), T.StructField("links", T.LongType())])


def salt(column: str | Column) -> Column:
    return F.pmod(F.xxhash64(column), F.lit(SALTS)).cast("int")


def placed(members: DataFrame) -> DataFrame:
    """Each set of a cluster (root, node, n_shingles) with its block and the pairs of blocks (x, y) that it has to be in.

    Blocks are numbers, size class times 2^32 and a part. A class is of sizes within 1.26 times each other, so sets of classes that aren't neighbours can't
    link at 80 % or more; small clusters are one block, and so are the classes of lower thresholds.
    """
    sums = members.groupBy("root").agg(F.sum("n_shingles").alias("total"))
    salted = sums.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))  # a large cluster is many tasks
    sized = members.withColumn("salt", salt("node")).join(salted, ["root", "salt"])
    sized = sized.withColumn("k", F.when(F.col("total") > BLOCK_SHINGLES, F.floor(F.log("n_shingles") / math.log(1.26))).otherwise(0))
    kinds = sized.groupBy("root", "k").agg(F.ceil(F.sum("n_shingles") / BLOCK_SHINGLES).alias("parts"))
    layout = kinds.groupBy("root").agg(F.collect_list(F.struct("k", "parts")).alias("layout"))  # a few dozen classes at most
    layout = layout.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    rows = sized.join(layout, ["root", "salt"])
    own = F.element_at(F.filter("layout", lambda x: x["k"] == F.col("k")), 1)["parts"]
    block = F.col("k") * F.lit(2**32) + F.pmod(F.xxhash64("node", F.lit(12)), own)
    near = F.filter("layout", lambda x: F.abs(x["k"] - F.col("k")) <= 1)
    others = F.flatten(F.transform(near, lambda x: F.transform(F.sequence(F.lit(0).cast("long"), x["parts"] - 1), lambda p: x["k"] * F.lit(2**32) + p)))
    rows = rows.select("root", "node", block.alias("block"), others.alias("others"))
    return rows.select("root", "node", "block", F.transform("others", lambda o: F.struct(F.least("block", o).alias("x"), F.greatest("block", o).alias("y"))).alias("pairs"))


def links(docs: DataFrame, members: DataFrame, n: int, percent: int) -> DataFrame:
    """(a, b, links), as ``compared`` says, of all clusters; members: root, node, n_shingles, copies, and id and seal of a row that has the set."""
    full = sealed(docs).select("id", "seal", "text").join(members.select("node", "id", "seal", "copies"), ["id", "seal"]).dropDuplicates(["node"])
    texts = full.select("node", "copies", "text").join(placed(members), "node")

    def make():
        hashes = WordHashes()
        return lambda batch: {c: batch[c] for c in ("root", "block", "node", "copies", "pairs")} | {"tokens": [shingles(t, n, hashes).tobytes() for t in batch["text"].to_pylist()]}

    pair = T.ArrayType(T.StructType([T.StructField("x", T.LongType()), T.StructField("y", T.LongType())]))
    sets = mapped(texts.select("root", "block", "node", "copies", "pairs", "text"), T.StructType([*(T.StructField(c, T.LongType()) for c in ("root", "block", "node", "copies")), T.StructField("pairs", pair), T.StructField("tokens", T.BinaryType())]), make)
    dealt = sets.select("root", F.explode("pairs").alias("pair"), "block", "node", "copies", "tokens").select("root", "pair.x", "pair.y", "block", "node", "copies", "tokens")
    dealt = dealt.repartition("root", "x", "y").sortWithinPartitions("root", "x", "y", "node")
    out = arrow_schema(LINK)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[int, int, int, np.ndarray]] = []
        now, found = None, []

        def end() -> None:
            if len(held) > 1 and now is not None:
                left = [x[1:] for x in held if x[0] == now[1]]
                right = None if now[1] == now[2] else [x[1:] for x in held if x[0] == now[2]]
                if left and (right is None or right):
                    found.extend(compared(left, right, percent))
            held.clear()

        def flush() -> pa.RecordBatch:
            batch = pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*found)], schema=out)
            found.clear()
            return batch

        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                piece = batch.slice(at, 512)
                for root, x, y, block, node, copies, tokens in zip(*(piece[c].to_pylist() for c in SETS.names)):
                    if (root, x, y) != now:
                        end()
                        now = (root, x, y)
                    held.append((block, node, copies, np.frombuffer(tokens, np.uint64)))
            if found:
                yield flush()
        end()
        if found:
            yield flush()
        give_back()

    return dealt.select(*SETS.names).mapInArrow(run, LINK)


def mapped(df: DataFrame, schema: T.StructType, make) -> DataFrame:
    """``map_batches`` for a schema that takes a column over as it is."""
    names = schema.names

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        step = make()
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                got = step(batch.slice(at, 512))
                yield pa.RecordBatch.from_arrays([x if isinstance(x, pa.Array) else pa.array(x, pa.binary()) for x in (got[c] for c in names)], names=names)
        give_back()

    return df.mapInArrow(run, schema)


def join(docs: DataFrame, n: int = 5, percent: int = 80) -> DataFrame:
    """doc_id, n_shingles, component_id, n_links for every row."""
    if not 80 <= percent <= 100:
        raise ValueError("thresholds are from 80 to 100 percent")
    rows = cut(keyed(docs, n).withColumn("salt", salt(F.monotonically_increasing_id())))
    full = rows.where("node is not null")
    classes = cut(full.groupBy("node").agg(F.min(F.struct("id", "seal")).alias("of"), F.first("n_shingles").alias("n_shingles"), F.count("*").alias("copies")))
    counted = packed.grouped(asked(docs, n, percent, packed.shards_of(docs)), "shard", "slice", packed.PACKED, shared_tokens)
    lists = cut(packed.grouped(counted, "slice", "shard", INDEX, index_rows(percent)).distinct())
    members = cut(clusters(lists).join(classes, "node").select("root", "node", "n_shingles", "copies", "of.id", "of.seal"))
    linked = cut(links(docs, members, n, percent))
    roots = cut(components(linked.select("a", "b")))
    heads = roots.join(classes.select("node", "of.id"), "node").groupBy("root").agg(F.min("id").alias("head"))
    heads = heads.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))  # a large component is many tasks
    headed = roots.withColumn("salt", salt("node")).join(heads, ["root", "salt"]).select("node", "head")
    more = linked.where("links > 0").groupBy(F.col("a").alias("node")).agg(F.sum("links").alias("links"))
    told = classes.join(headed, "node", "left").join(more, "node", "left").where("copies > 1 or head is not null")
    told = told.select("node", F.coalesce("head", "of.id").alias("head"), (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("links"))
    # A class of very many copies is as many tasks as its rows have salts.
    parts = full.select("node", "salt").distinct().join(told, "node")
    out = full.join(parts, ["node", "salt"], "left").select("doc_id", "id", "n_shingles", "head", "links")
    out = out.unionByName(rows.where("node is null").select("doc_id", "id", "n_shingles", F.lit(None).cast("long").alias("head"), F.lit(None).cast("long").alias("links")))
    return out.select("doc_id", "n_shingles", F.coalesce("head", "id").alias("component_id"), F.coalesce("links", F.lit(0).cast("long")).alias("n_links"))


#: The same in DuckDB: all links of sets with a shingle in common, and what they reach.
SQL = """
WITH RECURSIVE words AS (
    SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') AS w FROM documents
), placed AS (SELECT doc_id, len(w) AS n, unnest(w) AS w, generate_subscripts(w, 1) AS i FROM words),
runs AS (
    SELECT doc_id, n, i, concat_ws(' ', w, lead(w, 1) OVER o, lead(w, 2) OVER o, lead(w, 3) OVER o, lead(w, 4) OVER o) AS shingle FROM placed WINDOW o AS (PARTITION BY doc_id ORDER BY i)
), each AS (SELECT DISTINCT doc_id, shingle FROM runs WHERE i <= n - 4 OR (i = 1 AND n < 5)),
sized AS (SELECT doc_id, count(*) AS n FROM each GROUP BY doc_id),
often AS (SELECT shingle FROM each GROUP BY shingle HAVING count(*) > 1),
met AS (
    SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS n FROM (SELECT * FROM each SEMI JOIN often USING (shingle)) a JOIN each b ON a.shingle = b.shingle AND a.doc_id <> b.doc_id GROUP BY ALL
), links AS (SELECT x, y FROM met JOIN sized a ON a.doc_id = x JOIN sized b ON b.doc_id = y WHERE 100 * met.n >= 80 * (a.n + b.n - met.n)),
reached AS (SELECT x, y FROM links UNION SELECT r.x, l.y FROM reached r JOIN links l ON r.y = l.x),
least_of AS (SELECT x, min(y) AS y FROM reached GROUP BY x), counts AS (SELECT x, count(*) AS n FROM links GROUP BY x)
SELECT d.doc_id, coalesce(s.n, 0) AS n_shingles, least(d.doc_id, coalesce(l.y, d.doc_id)) AS component_id, coalesce(c.n, 0) AS n_links
FROM documents d LEFT JOIN sized s ON s.doc_id = d.doc_id LEFT JOIN least_of l ON l.x = d.doc_id LEFT JOIN counts c ON c.x = d.doc_id
"""
