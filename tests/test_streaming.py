import numpy as np
from pyspark.sql import functions as F

from folio.sources import images
from folio.streaming import watch

DATA = "/root/testdata/sf0.001"


def test_watched_folder(spark, tmp_path):
    folder, out, kept = (str(tmp_path / n) for n in ("in", "out", "kept"))
    (tmp_path / "in").mkdir()
    for i in range(5):
        (tmp_path / "in" / f"p{i}.png").write_bytes(images.png(np.full((2, 2 + i, 1), i, np.uint8)))
    (tmp_path / "in" / "bad.tif").write_bytes(b"II*\0")
    (tmp_path / "in" / "note.txt").write_bytes(b"no page")
    change = lambda b: b.select(F.regexp_extract("path", "([^/]*)$", 1).alias("name"), "width", "error")
    for _ in range(2):  # a second run finds nothing new
        q = watch.processed(watch.arriving(spark, folder, per_batch=2), change, out, kept, once=True)
        assert q.awaitTermination(120)
        rows = {r.name: r for r in spark.read.parquet(out).collect()}
        assert len(rows) == spark.read.parquet(out).count() == 6
        assert rows["p3.png"].width == 5 and rows["bad.tif"].error and rows["p0.png"].error is None


def test_activity(spark, tmp_path):
    events = spark.read.parquet(f"{DATA}/events.parquet").select("ts", "event_type")
    events.repartition(4).write.parquet(str(tmp_path / "events"))
    stream = spark.readStream.schema(events.schema).parquet(str(tmp_path / "events"))
    q = watch.activity(stream, "1 day").writeStream.format("memory").queryName("activity").outputMode("complete").trigger(availableNow=True).start()
    assert q.awaitTermination(120)
    want = watch.activity(events, "1 day")
    got = spark.table("activity")
    assert got.exceptAll(want).count() == want.exceptAll(got).count() == 0 and got.count() > 0
