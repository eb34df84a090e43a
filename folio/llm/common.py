"""Small helpers that the operators of this subpackage share."""

from __future__ import annotations

import ctypes
import re
import tempfile
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: The words of the contracts: runs of anything but ASCII white space (Java pattern).
WORD = r"[^\x20\x09-\x0D]+"
#: The columns of ``documents`` that stages of the pipeline pass on.
DOCUMENT = T.StructType(
    [
        T.StructField("doc_id", T.LongType()),
        T.StructField("text", T.StringType()),
        T.StructField("lang", T.StringType()),
        T.StructField("source", T.StringType()),
        T.StructField("n_chars", T.LongType()),
    ]
)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def conform(df: DataFrame, schema: T.StructType) -> DataFrame:
    """The named columns, cast; a column that is missing is null, others are dropped."""
    return df.select(*[(F.col(f"`{f.name}`") if f.name in df.columns else F.lit(None)).cast(f.dataType).alias(f.name) for f in schema])


def documents(df: DataFrame) -> DataFrame:
    """``df`` with the columns of ``documents`` only; null texts stay null."""
    return conform(df, DOCUMENT)


def cut(df: DataFrame) -> DataFrame:
    """Ends the lineage of ``df`` in the shared checkpoint folder, so lost executors cost no more than one step.

    The folder is that of ``spark.checkpoint.dir``. Only a session of one machine may go without: it gets a folder of its own.
    """
    sc = df.sparkSession.sparkContext
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        folder = df.sparkSession.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir")
        if not folder and not re.fullmatch(r"local(\[.*\])?", sc.master):
            raise ValueError("spark.checkpoint.dir is not set: executors need a folder that all of them share")
        sc.setCheckpointDir(folder or tempfile.mkdtemp(prefix="checkpoints"))
    return df.checkpoint()


def meet(df: DataFrame, small: DataFrame, key: str, named: str, most: int = 100_000, salts: int = 64) -> DataFrame:
    """``df`` with the columns of ``small`` (one row a value of ``named``, null among them) where ``key`` equals ``named``.

    ``small`` is broadcast while it is counted to be ``most`` rows at most; beyond that both sides meet by value and salt, so a
    hot value is many tasks.
    """
    same = F.col(key).eqNullSafe(F.col(named))
    if small.count() <= most:
        return df.join(F.broadcast(small), same)
    salted = small.withColumn("meet_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    rows = df.withColumn("own_salt", F.pmod(F.xxhash64(*df.columns), F.lit(salts)).cast("int"))
    return rows.join(salted, same & (F.col("own_salt") == F.col("meet_salt"))).drop("own_salt", "meet_salt")


def arrow_type(kind: T.DataType) -> pa.DataType:
    if isinstance(kind, T.ArrayType):
        return pa.list_(arrow_type(kind.elementType))
    return {
        T.LongType(): pa.int64(),
        T.IntegerType(): pa.int32(),
        T.StringType(): pa.string(),
        T.DoubleType(): pa.float64(),
        T.FloatType(): pa.float32(),
        T.BooleanType(): pa.bool_(),
        T.BinaryType(): pa.binary(),
    }[kind]


def arrow_schema(schema: T.StructType) -> pa.Schema:
    return pa.schema([(f.name, arrow_type(f.dataType)) for f in schema])


def map_batches(df: DataFrame, schema: T.StructType, make: Callable[[], Callable[[pa.RecordBatch], dict]], rows: int = 1024, size: int = 4_000_000) -> DataFrame:
    """``mapInArrow`` in slices of at most ``rows`` rows and about ``size`` bytes of text (one row at least).

    ``make`` is called once a task (models and caches are built there) and returns a function from
    a slice to the columns of the result; so a worker holds one slice as Python objects at a time.
    """
    out = arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        step = make()
        for batch in batches:
            for piece in slices(batch, rows, size):
                columns = step(piece)
                yield pa.RecordBatch.from_arrays([x if isinstance(x, pa.Array) else pa.array(x, t) for x, t in ((columns[f.name], f.type) for f in out)], schema=out)
                del columns
        del step
        give_back()

    return df.mapInArrow(run, schema)


def give_back() -> None:
    """Returns freed memory to the system: workers outlive their task, and a later stage's share the executor with them."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except AttributeError:  # a C library without it
        pass


def slices(batch: pa.RecordBatch, rows: int, size: int) -> Iterator[pa.RecordBatch]:
    lengths = pc.fill_null(pc.binary_length(batch["text"]), 0).to_numpy(zero_copy_only=False) if "text" in batch.schema.names else np.zeros(batch.num_rows, np.int64)
    ends, at = np.cumsum(lengths), 0
    while at < batch.num_rows:
        to = int(np.searchsorted(ends, (ends[at - 1] if at else 0) + size, "right"))
        to = min(max(to, at + 1), at + rows, batch.num_rows)
        yield batch.slice(at, to - at)
        at = to


def fraction(*columns: Column | str, seed: int = 0) -> Column:
    """A number in [0, 1) that depends on the columns and the seed alone."""
    return (F.shiftrightunsigned(F.xxhash64(F.lit(seed), *columns), 11)).cast("double") * F.lit(2.0**-53)
