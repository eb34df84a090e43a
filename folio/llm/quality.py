"""Quality classifier (operator 3): hashed word n-grams, logistic regression, follow the regularised leader.

Tokens are runs of word characters and runs of other signs; single tokens and pairs are hashed into
``2**BITS`` weights. Training takes at most about ``sample`` labelled rows (a documented bound: the
rows of lowest hash), whose features are made where the rows are and learned in one task in the order
of the hash, per coordinate with L1 and L2 regularisation. A score is a sparse dot product.

Only ``text`` is an input of a score. Rows whose crc32(doc_id) mod 4 is 2 are never learned from; a
null id counts as not held out. Empty and null texts get the score of the bias alone. Labels that are
null, or whose document is missing, are left out; without labels every score is 0.5.
"""

from __future__ import annotations

import re
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from folio.llm.common import arrow_schema, documents, map_batches

BITS = 18
TOKEN = re.compile(r"\w+|[^\w\s]+")
SCALE = 24.0
SAMPLE = 16_000


class Hashes(dict):
    """crc32 of tokens, kept while they are few."""

    def __missing__(self, token: str) -> int:
        if len(self) > 400_000:
            self.clear()
        got = self[token] = zlib.crc32(token.encode("utf-8", "surrogatepass"))
        return got


def features(text: str, hashes: Hashes) -> np.ndarray:
    """Places of the n-grams of a text, repeats included."""
    tokens = TOKEN.findall(text)
    h = np.fromiter(map(hashes.__getitem__, tokens), np.uint32, len(tokens))
    pairs = (h[:-1] * np.uint32(0x85EBCA6B)) ^ (h[1:] * np.uint32(0xC2B2AE35))
    pairs[h[:-1] == h[1:]] = 1  # "the same again", whatever the word: one pair for all
    echoes = np.full(np.count_nonzero((h[2:] == h[:-2]) & (h[2:] != h[1:-1])), 2, np.uint32)
    return (np.concatenate([h * np.uint32(0x9E3779B1), pairs * np.uint32(0x27D4EB2F), echoes * np.uint32(0x27D4EB2F)]) >> np.uint32(32 - BITS)).astype(np.int32)


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def learn(rows: list[tuple[tuple[np.ndarray, np.ndarray], int]], alpha: float, beta: float, l1: float, l2: float, epochs: int) -> np.ndarray:
    """FTRL-proximal over ((distinct places, counts), label); the last weight is the bias."""
    size = (1 << BITS) + 1
    z, n = np.zeros(size), np.zeros(size)

    def weights(i: np.ndarray) -> np.ndarray:
        return np.where(np.abs(z[i]) <= l1, 0.0, (np.sign(z[i]) * l1 - z[i]) / ((beta + np.sqrt(n[i])) / alpha + l2))

    for _ in range(epochs):
        for places, y in rows:
            i = np.append(places[0], size - 1)
            x = np.append(places[1] * (SCALE / max(1, places[1].sum())), 1.0)
            w = weights(i)
            g = (1 / (1 + np.exp(-np.clip(w @ x, -35, 35))) - y) * x
            z[i] += g - (np.sqrt(n[i] + g * g) - np.sqrt(n[i])) / alpha * w
            n[i] += g * g
    return weights(np.arange(size)).astype(np.float32)


EXAMPLE = T.StructType([T.StructField("place", T.LongType()), T.StructField("y", T.IntegerType()), T.StructField("places", T.BinaryType()), T.StructField("counts", T.BinaryType())])
MODEL = T.StructType([T.StructField("weights", T.BinaryType())])


def train(docs: DataFrame, labels: DataFrame, label: str = "quality", sample: int = SAMPLE, alpha: float = 0.3, beta: float = 1.0, l1: float = 0.02, l2: float = 0.1, epochs: int = 2) -> np.ndarray:
    """The weights. Only the bounded list of sampled ids is broadcast; texts are not moved before they are features."""
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(label).cast("int").alias("y"))
    chosen = known.where(F.col("doc_id").isNotNull() & F.col("y").isNotNull() & ~held_out(F.col("doc_id")))
    chosen = chosen.groupBy("doc_id").agg(F.max("y").alias("y")).withColumn("place", F.xxhash64("doc_id")).orderBy("place").limit(sample)

    def make():
        hashes = Hashes()

        def step(batch: pa.RecordBatch) -> dict:
            found = [np.unique(features(t or "", hashes), return_counts=True) for t in batch["text"].to_pylist()]  # 2**BITS places at most
            return {"place": batch["place"], "y": batch["y"], "places": [p.tobytes() for p, _ in found], "counts": [c.astype(np.int32).tobytes() for _, c in found]}

        return step

    examples = map_batches(documents(docs).select("doc_id", "text").join(F.broadcast(chosen), "doc_id").select("place", "y", "text"), EXAMPLE, make)

    def run(batches):
        rows = [x for b in batches for x in zip(*(b[c].to_pylist() for c in EXAMPLE.names))]
        rows.sort()
        model = learn([((np.frombuffer(p, np.int32), np.frombuffer(c, np.int32)), y) for _, y, p, c in rows], alpha, beta, l1, l2, epochs)
        yield pa.RecordBatch.from_arrays([pa.array([model.tobytes()], pa.binary())], schema=arrow_schema(MODEL))

    got = examples.repartition(1).mapInArrow(run, MODEL).collect()
    return np.frombuffer(got[0][0], np.float32) if got else np.zeros((1 << BITS) + 1, np.float32)


SCORE = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("held_out", T.BooleanType()), T.StructField("score", T.DoubleType()), T.StructField("predicted", T.IntegerType())])


def score(docs: DataFrame, weights: np.ndarray, least: float = 0.7) -> DataFrame:
    """One row per document; the weights (1 MB, whatever the input) are broadcast."""
    shared = docs.sparkSession.sparkContext.broadcast(weights)

    def make():
        hashes, w = Hashes(), shared.value.astype(np.float64)  # so a score doesn't depend on what else is in its slice

        def step(batch: pa.RecordBatch) -> dict:
            found = [features(t or "", hashes) for t in batch["text"].to_pylist()]
            dots = np.array([w[f].sum() * (SCALE / len(f)) if len(f) else 0.0 for f in found]) + w[-1]
            scores = 1 / (1 + np.exp(-np.clip(dots, -35, 35)))
            return {"doc_id": batch["doc_id"], "held_out": batch["held_out"], "score": scores, "predicted": (scores >= least).astype(np.int32)}

        return step

    return map_batches(documents(docs).select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "text"), SCORE, make)
