"""Batch control as a stream against the same rows at rest, over restarts and late rows."""

import datetime
import random

import pytest
from pyspark.sql import functions as F

from folio.sources import batch
from folio.streaming import control

START = datetime.datetime(2024, 1, 1)


def happened(seed):
    rng, out = random.Random(seed), []

    def add(b, seconds, kind, folder=None, n=None, answer=None):
        out.append((b, len(out), START + datetime.timedelta(seconds=seconds), kind, folder, n, answer))

    for b in ("one", "two", "three"):
        at = 0
        for k in range(14):
            at += rng.randint(1, 40)
            add(b, at, "ask", f"f{k}", rng.choice([0, 1, 3]), rng.choice(["Yes", "No", "Yes", "No", *(["YesToAll", "NoToAll", "Cancel"] if k > 5 else [])]))
            files = rng.randint(1, 9)
            add(b, at + 1, "open", f"f{k}", files)
            for i in range(files):
                add(b, at + 2 * i, "start", f"f{k}")
                add(b, at + 2 * i + 2, "done", f"f{k}")
            if rng.random() < 0.3:
                add(b, at + rng.randint(0, 12), "cancel", f"f{k}")
        if b == "two":
            add(b, at - 30, "cancel")
    return out


def at_rest(spark, rows):
    """The three static operators on what happened."""
    df = spark.createDataFrame(rows, control.ROWS)
    want = set()
    for r in batch.answered(df.where("kind = 'ask'").selectExpr("batch", "seq", "folder", "n as n_existing", "answer")).collect():
        want.add((r.batch, r.seq, "ask", r.folder, r.done, None))
    done = df.where("kind = 'done'").select("batch", F.concat("batch", F.lit("/"), "folder").alias("folder"), F.col("folder").alias("own"), F.struct("at", "seq").alias("seq"))
    for r in batch.progress(done).collect():
        want.add((r.batch, r.seq.seq, "done", r.own, None, r.percent))
    for b in ("one", "two", "three"):
        work = df.where(F.col("batch") == b).where("kind = 'start'").select("seq", "folder", F.col("at").alias("started"))
        cancels = df.where(F.col("batch") == b).where("kind = 'cancel'").select("folder", "at")
        runs = {r.seq for r in batch.until_cancelled(work, cancels).collect()}
        want |= {(b, r.seq, "start", r.folder, "runs" if r.seq in runs else "cancelled", None) for r in work.collect()}
    return want


@pytest.mark.parametrize("seed", [1, 2])
def test_stream_says_what_tables_say(spark, tmp_path, seed):
    """Rows arrive in any order within the lateness, in several files and over two starts of the query; each is told once."""
    rows = happened(seed)
    rng = random.Random(seed)
    arriving = sorted(rows, key=lambda r: (r[2] - START).total_seconds() + rng.randint(0, 500))
    end = [("zz", 10**6, START + datetime.timedelta(days=2), "ask", "last", 0, None)]
    middle = len(arriving) // 2
    given, out, kept = (str(tmp_path / n) for n in ("in", "out", "kept"))
    told = {}
    for part in (arriving[:middle], arriving[middle:] + end, end):
        for at in range(0, len(part), 40):
            spark.createDataFrame(part[at : at + 40], control.ROWS).coalesce(1).write.mode("append").parquet(given)
        stream = spark.readStream.schema(control.ROWS).option("maxFilesPerTrigger", 1).parquet(given)
        q = control.controlled(stream).writeStream.format("parquet").option("path", out).option("checkpointLocation", kept).trigger(availableNow=True).start()
        assert q.awaitTermination(300)
        told = [tuple(r) for r in spark.read.schema(control.OUT).parquet(out).collect()]
    assert len(told) == len(set(told))
    assert {t for t in told if t[0] != "zz"} == at_rest(spark, rows)


def test_order_of_one_instant():
    memory = control.fresh()
    assert control.take(memory, 5, 1, "cancel", "f", None, None) is None
    assert control.take(memory, 5, 2, "start", "f", None, None)[3] == "cancelled" and control.take(memory, 4, 3, "start", "g", None, None)[3] == "runs"
    assert control.take(memory, 6, 4, "done", "g", None, None)[4] is None  # a folder of unknown size
    control.take(memory, 7, 5, "open", "h", 8, None)
    assert [control.take(memory, 8, 6 + i, "done", "h", None, None)[4] for i in range(8)] == [12, 25, 38, 50, 62, 75, 88, 100]
    assert "h" not in memory["total"]
