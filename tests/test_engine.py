"""Pipelines over packed pages, and what becomes of pages that fail."""

import numpy as np
import pytest

from folio import rasters
from folio.plans import engine, presets
from folio.plans.presets import NotAvailable, Operation

PAGE = rasters.PAGE


def pages(spark, *rasters_):
    rows = [(i, v.shape[1], v.shape[0], 1 if v.ndim == 2 else v.shape[2], bytearray(v.tobytes())) for i, v in enumerate(rasters_)]
    return spark.createDataFrame(rows, PAGE)


def every(kind, **given):
    return Operation(kind, given=given)


METHODS = [(t, name, option) for t, known in presets.REGISTRY.items() for name, first in [next(iter(known.items()))] for option in (first.options if isinstance(first, presets.Choice) else [None])]


@pytest.mark.parametrize("kind, name, option", METHODS)
def test_every_method_runs_or_says_so(spark, kind, name, option):
    rng = np.random.default_rng(1)
    v = np.full((90, 120), 235, np.uint8)
    v[10:80:9, 15:105] = rng.integers(0, 80, (8, 90))
    o = Operation(kind, given={name: option} if option else {})
    try:
        engine.change_of(o)
    except NotAvailable:
        assert (kind, option) in {("Deskew", "Text aware"), ("SmartCrop", "U-net"), ("SmartCrop", "EAST"), ("Enhance", "Auto orient")}
        return
    for page in (v, np.repeat(v[:, :, None], 3, 2)):
        out, failed, error = engine.folded(page, [(kind, engine.change_of(o))])
        assert failed is None and error is None and len(out) == (2 if kind == "SplitPage" else 1)
        assert all(new.dtype == np.uint8 and new.size for new in out)


def test_errors_stay_with_their_page(spark):
    good, two = np.full((6, 6), 200, np.uint8), np.full((6, 6, 2), 128, np.uint8)
    rows = pages(spark, good, two).unionByName(spark.createDataFrame([(7, 4, 4, 1, None), (8, 4, 4, 1, bytearray(b"abc")), (None, 2, 2, 1, bytearray(4))], PAGE))
    out = {r.page_id: r for r in engine.run(rows, [every("Invert", invertMethod="Invert whole page"), every("Binarize", threshold=100), every("Deskew", deskewAlgorithm="Hough")]).collect()}
    assert set(out[0].pixels) == {0} and out[0].error is None  # 200 inverted is 55
    assert out[1].operation == "Binarize" and set(out[1].pixels) == {127} and out[1].channels == 2  # what was done so far
    assert out[7].pixels is None and out[8].operation == "load" and out[None].error is None
    assert engine.errors(engine.run(rows, [every("Binarize")])).count() == 3


def test_forgiving_operations_leave_pages(spark):
    two = np.full((60, 60, 2), 128, np.uint8)
    out = engine.run(pages(spark, two), [every("Deskew"), every("BordersRemove"), every("PunchHolesRemove")]).collect()[0]
    assert out.error is None and bytes(out.pixels) == two.tobytes()


def test_sides_and_splits(spark):
    v = np.arange(48, dtype=np.uint8).reshape(4, 12)
    p = pages(spark, v, v).selectExpr("*", "if(page_id = 0, 'Left', 'Right') as side")
    manual = Operation("BordersRemove", given={"borderRemovalAlgorithm": "Manual", "manualLeft": 2, "applyToLeftPage": False, "cutMethod": True})
    out = {r.page_id: r for r in engine.run(p, [manual]).collect()}
    assert out[0].width == 12 and out[1].width == 10 and bytes(out[1].pixels) == v[:, 2:].tobytes()
    halves = engine.run(p, [Operation("SplitPage", given={"splitMethod": "Manual", "manualOverlapPx": 1})]).orderBy("page_id", "part").collect()
    assert [(r.part, r.width) for r in halves] == [(1, 7), (2, 7)] * 2
    off = Operation("Invert", given={"invertMethod": "Invert whole page"}, in_pipeline=False)
    assert bytes(engine.run(p, [off]).collect()[0].pixels) == v.tobytes()


def test_unknown_parameters_are_refused():
    for kind, given in (("Deskew", {"maxLineGap": 3}), ("BordersRemove", {"borderRemovalAlgorithm": "Integral", "textureAllowance": 0.5}), ("PunchHolesRemove", {"density": 0.5}), ("Despeckle", {"despeckleMethod": "Effective", "useDilateBeforeCC": True})):
        with pytest.raises(NotAvailable):
            engine.change_of(Operation(kind, given=given))


def test_split_settings():
    p = Operation("SplitPage", given={"centralBandStart": 0.7, "centralBandEnd": 0.3, "smoothWindowPx": 10, "useLabConfirmation": False, "weightProjection": 0.2}).parameters
    got = engine.split_settings(p)
    assert got["band"] == (0.3, 0.7) and got["smooth_px"] == 11 and got["weights"] == (1.0, 0.0)
    assert engine.split_settings(Operation("SplitPage", given={"weightProjection": 0, "weightLab": 0}).parameters)["weights"] == (0.5, 0.5)
    rng = np.random.default_rng(2)
    v = np.full((80, 1000), 235, np.uint8)
    for y in range(8, 72, 8):
        v[y : y + 3, 40:460] = rng.integers(0, 90, (3, 420))
        v[y : y + 3, 540:960] = rng.integers(0, 90, (3, 420))
    left, right = engine.auto_split(v, Operation("SplitPage", given={"analysisMaxWidth": 400}).parameters)
    assert abs(left.shape[1] - right.shape[1]) < 90


def test_pages_of_one_file_are_many_tasks(spark):
    from pyspark.sql import functions as F

    from folio.plans import engine, presets

    rows = spark.range(400).coalesce(1).selectExpr("id AS page_id", "2 AS width", "2 AS height", "1 AS channels", "cast('abcd' AS binary) AS pixels")
    done = engine.run(rows, [presets.Operation("Invert", given={})])
    sizes = [r.n for r in done.groupBy(F.spark_partition_id()).agg(F.count("*").alias("n")).collect()]
    assert sum(sizes) == 400 and len(sizes) >= 24 and max(sizes) < 60
