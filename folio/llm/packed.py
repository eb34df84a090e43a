"""Slices and shards: what operators 12 and 13 exchange instead of a row a token.

A task works on slices of its rows (some megabytes of text). What a slice asks about its tokens goes out as one packed row
for each shard of the token space, and the shard answers with one packed row for each slice. Shards grow in number with the
text, so a shard's tokens fit into a task at any size; where shards are many, packed rows get short, down to a row a token, which is
the plain exchange. A token is sent once a slice, so a frequent one is a few rows, and hashes deal tokens evenly.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from folio.llm.common import arrow_schema, give_back

SLICE, SHARD = 8_000_000, 4_000_000  # characters of text
HEADER = -1  # the shard of what a slice keeps for itself

PACKED = T.StructType([T.StructField("slice", T.LongType()), T.StructField("shard", T.IntegerType()), *(T.StructField(c, T.BinaryType()) for c in ("a", "b", "c", "d"))])


def press(values: np.ndarray | bytes) -> bytes:
    """Length and compressed bytes."""
    raw = values if isinstance(values, bytes) else values.tobytes()
    return len(raw).to_bytes(8, "little") + pa.compress(raw, codec="zstd", asbytes=True)


def unpress(packed: bytes) -> bytes:
    return pa.decompress(packed[8:], int.from_bytes(packed[:8], "little"), codec="zstd", asbytes=True)


def shards_of(docs: DataFrame, size: int = SHARD) -> int:
    """How many shards the text of ``docs`` is worth."""
    return max(16, math.ceil((docs.agg(F.sum(F.length("text"))).first()[0] or 0) / size))


def slice_numbers() -> Iterator[int]:
    """Numbers of the slices of this task, which no other task has."""
    at = (TaskContext.get().partitionId() if TaskContext.get() else 0) << 32
    while True:
        yield at
        at += 1


def by_shard(shard: np.ndarray, shards: int) -> Iterator[tuple[int, np.ndarray]]:
    """(shard, places of its members, ascending) for shards that have any."""
    order = np.argsort(shard, kind="stable")
    ends = np.searchsorted(shard[order], np.arange(shards), "right")
    start = 0
    for k, end in enumerate(ends.tolist()):
        if end > start:
            yield k, order[start:end]
        start = end


def columns(rows: list[tuple], schema: T.StructType) -> dict:
    return dict(zip(schema.names, zip(*rows))) if rows else {f.name: [] for f in schema}


def grouped(rows: DataFrame, key: str, then: str, schema: T.StructType, make: Callable[[], tuple[Callable, Callable]]) -> DataFrame:
    """``mapInArrow`` over ``rows`` dealt by ``key``, in order of (key, then).

    ``make`` gives a task's two functions: ``row(*columns)`` is called for each row and gives rows of the result, ``end(key)`` after the last of each
    key. The task holds what they hold: one key at a time.
    """
    out, names = arrow_schema(schema), rows.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        row, end = make()

        def results() -> Iterator[tuple]:
            now = None
            for batch in batches:
                for at in range(batch.num_rows):
                    values = [batch.column(c)[at].as_py() for c in names]
                    k = values[names.index(key)]
                    if now is not None and k != now:
                        yield from end(now)
                    now = k
                    yield from row(*values)
            if now is not None:
                yield from end(now)

        found, size = [], 0
        for result in results():
            found.append(result)
            size += sum(len(x) if isinstance(x, bytes) else 8 for x in result)
            if size > 4_000_000:
                yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*found), out)], schema=out)
                found, size = [], 0
        if found:
            yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*found), out)], schema=out)
        give_back()

    return rows.repartition(key).sortWithinPartitions(key, then).mapInArrow(run, schema)
