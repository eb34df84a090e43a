import json

import pytest

from folio import rasters
from folio.operators import points
from folio.plans import presets

DATA = "/root/testdata/sf0.001"


def test_coercion():
    n, c, f = presets.Number(5, 0, 10), presets.Choice(("Aa", "B"), "B"), presets.Flag(True)
    assert [presets.coerce(n, x) for x in (3, "4.5", 99, -1, "x", None, True, "nan")] == [3, 4.5, 10, 0, 5, 5, 5, 5]
    assert [presets.coerce(c, x) for x in ("Aa", "aA", 0, 7, "z", None)] == ["Aa", "Aa", "Aa", "B", "B", "B"]
    assert [presets.coerce(f, x) for x in (0, 1, "false", "TRUE", "x", None)] == [False, True, False, True, True, True]


def test_load_and_save():
    assert presets.load("{broken") == [] and presets.load("null") == [] and presets.save([]) == ""
    text = json.dumps([{"type": 2, "parameters": {"threshold": "300", "other": 1}}, {"Type": 77}, {"Type": 9}, {"Type": 3}])
    got = presets.load(text)
    assert [o.type for o in got] == ["SplitPage"]  # a split keeps a Deskew only
    whole = presets.load(json.dumps([{"type": 2, "parameters": {"threshold": "300", "other": 1}}, {"Type": 77}, {"Type": 3}]))
    assert [o.type for o in whole] == ["Binarize", "Invert"] and whole[0].parameters["threshold"] == 255
    assert [o.parameters for o in presets.load(presets.save(whole))] == [o.parameters for o in whole]
    assert presets.load('[{"Type": 1, "Parameters": {"treshFrac": 0.7}}]')[0].parameters["threshFrac"] == 0.7


def test_apply(spark):
    px = rasters.gray_pages(spark, DATA)
    chain = [presets.Operation("Invert", given={"invertMethod": "Invert whole page"}), presets.Operation("Binarize", given={"threshold": 100}), presets.Operation("Invert", in_pipeline=False)]
    want = points.threshold(points.invert(px), 100)
    got = presets.apply(px, chain, 8, 8)
    assert got.exceptAll(want).count() == 0 and got.count() == want.count() == 500 * 64
    split = presets.apply(rasters.spreads(spark, DATA), [presets.Operation("SplitPage", given={"splitMethod": "Manual"})], 16, 8)
    assert split.exceptAll(px).count() == 0
    borders = presets.apply(px, [presets.Operation("BordersRemove", given={"borderRemovalAlgorithm": "By Contrast", "centralSample": 0.3}), presets.Operation("LinesRemove", given={"orientation": "Both"})], 8, 8)
    assert borders.count() == 500 * 64
    with pytest.raises(presets.NotAvailable):
        presets.apply(px, [presets.Operation("Deskew")], 8, 8)


def test_registry_and_structure():
    assert set(presets.REGISTRY) == set(presets.TYPES) and sum(map(len, presets.REGISTRY.values())) == 186
    for o in map(presets.Operation, presets.TYPES):
        for name, kind in presets.REGISTRY[o.type].items():
            assert presets.coerce(kind, o.parameters[name]) == kind.default, (o.type, name)
    deskew, split, invert = (presets.Operation(t) for t in ("Deskew", "SplitPage", "Invert"))
    chain = presets.added([*presets.default(), deskew, invert], split)
    assert chain == [deskew, split]
    assert presets.added(chain, invert) == chain == presets.added(chain, deskew) == presets.added(chain, split)
    assert presets.added([split], deskew) == [deskew, split] and presets.added([invert], deskew, 0) == [deskew, invert]
    marked = [presets.Operation("Invert", checkpoint="a"), presets.Operation("Binarize"), presets.Operation("Despeckle", checkpoint="a")]
    assert {k: len(v) for k, v in presets.branches(marked).items()} == {"a": 1, "a 2": 3, "Full pipeline": 3}


def test_branches_and_kernels(spark):
    px = rasters.gray_pages(spark, DATA)
    invert = presets.Operation("Invert", given={"invertMethod": "Invert whole page"}, checkpoint="negative")
    got = presets.apply_branches(px, [invert, presets.Operation("Binarize", given={"threshold": 100})], 8, 8)
    assert got["negative"].exceptAll(points.invert(px)).count() == 0
    assert got[presets.FULL].exceptAll(points.threshold(points.invert(px), 100)).count() == 0
    few = px.where("page_id < 20")
    chain = [presets.Operation("Enhance"), presets.Operation("BordersRemove"), presets.Operation("Binarize", given={"method": "Majority"}), presets.Operation("Despeckle"), presets.Operation("Invert")]
    for o in chain:
        assert presets.apply(few, [o], 8, 8).count() == 20 * 64, o.type
    retinex = presets.Operation("Enhance", given={"enhanceMethod": 1, "retinexSigma": 5})
    assert presets.apply(few, [retinex], 8, 8).count() == 20 * 64
    assert presets.apply(few.where("x < 7"), [presets.Operation("Enhance", given={"claheGridSize": 3})], 7, 8).count() == 20 * 56
