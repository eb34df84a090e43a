"""Presets in bulk against the same rules for one preset in Python."""

import json
import random

import pytest

from folio.plans import preset_tables, presets

ODD = [
    None,
    "",
    "  ",
    "[1",
    "null",
    "[]",
    '{"Type": 1}',
    "[5, null, [1]]",
    '[{"Type": 1.0}, {"Type": "1"}, {"Type": null}, {"Parameters": {}}, {"Type": 10}, {"Type": -1}]',
    '[{"tYpE": 2, "displayNAME": "mine", "PARAMETERS": {"method": "SAUVOLA", "sauvolaK": " 0.5 ", "useGaussian": 1}}]',
    '[{"Type": 2, "DisplayName": 7, "Parameters": [1, 2]}, {"Type": 2, "Parameters": {"Method": "Sauvola", "threshold": "1e2", "meanC": "nan", "blockSize": "1_0"}}]',
    '[{"Type": 1, "Parameters": {"treshFrac": 0.7, "threshFrac": 0.6}}, {"Type": 1, "Parameters": {"treshFrac": 0.9, "contrastThr": 1e9, "bgColor": -5}}]',
    '[{"Type": 0}, {"Type": 2}, {"Type": 0, "Parameters": {"deskewAlgorithm": 2}}, {"Type": 9, "Parameters": {"splitMethod": "manual"}}, {"Type": 3}, {"Type": 9}]',
    '[{"Type": 9}, {"Type": 0}]',
    '[{"Type": 5, "Parameters": {"smallAreaRelative": 0.5, "keepClusters": 3000000000, "useDilateBeforeCC": " True ", "enableDustRemoval": "yes", "dilateKernel": true, "dilateIter": true}}]',
]


def texts():
    rng, out = random.Random(3), list(ODD)
    for _ in range(120):
        items = []
        for _ in range(rng.randint(1, 4)):
            kind = rng.randrange(11)
            given = {}
            for key, of in rng.sample(list(presets.REGISTRY[presets.TYPES[min(kind, 9)]].items()), 4):
                values = [0, 1, -1, 2.5, True, None, "x", "3", [1], {"a": 1}, 10**12]
                if isinstance(of, presets.Choice):
                    values += [*of.options, of.options[0].upper()] * 2
                given[key] = rng.choice(values)
            items.append({"Type": kind, "Parameters": given})
        out.append(json.dumps(items))
    return out


@pytest.fixture(scope="module")
def saved(spark):
    return spark.createDataFrame(list(enumerate(texts())), "preset_id long, text string").repartition(4)


def test_values_are_those_of_one_preset(saved):
    got = {}
    for r in preset_tables.values(preset_tables.operations(saved)).collect():
        got[r.preset_id, r.position, r.type, r.key] = r.number if r.kind == "number" else r.option if r.kind == "choice" else r.flag
    want = {(i, at, o.type, k): v for i, t in enumerate(texts()) for at, o in enumerate(presets.opened(t), 1) for k, v in o.parameters.items()}
    assert got == want
    names = {(r.preset_id, r.position): r.display_name for r in preset_tables.operations(saved).collect()}
    assert names == {(i, at): o.display_name or o.type for i, t in enumerate(texts()) for at, o in enumerate(presets.opened(t), 1)}


def test_compiled_texts_are_read_as_they_were(saved):
    ops = preset_tables.operations(saved)
    again = preset_tables.operations(preset_tables.compiled(ops))
    assert preset_tables.values(again).exceptAll(preset_tables.values(ops)).isEmpty() and preset_tables.values(ops).exceptAll(preset_tables.values(again)).isEmpty()
    for r in preset_tables.compiled(ops).collect():
        assert [o.parameters for o in presets.load(r.text)] == [o.parameters for o in presets.opened(texts()[r.preset_id])]


def test_structure_and_branches(saved):
    ops = preset_tables.operations(saved)
    assert {(r.preset_id, r.type): r.allowed for r in preset_tables.may_add(ops).collect()} == {
        (i, k): presets.may_add(presets.opened(t), k) for i, t in enumerate(texts()) if presets.opened(t) for k in presets.TYPES
    }
    marks = ops.where("type in ('Binarize', 'Deskew')").selectExpr("preset_id", "position", "'kept' as name")
    got = {(r.preset_id, r.branch): r.types for r in preset_tables.branches(ops, marks).collect()}
    want = {}
    for i, t in enumerate(texts()):
        chain = presets.opened(t)
        for o in chain:
            o.checkpoint = "kept" if o.type in ("Binarize", "Deskew") else None
        if chain:
            want |= {(i, name): [o.type for o in steps] for name, steps in presets.branches(chain).items()}
    assert got == want


def test_rules_name_what_there_is(spark, saved):
    for name, key, control, allowed in preset_tables.rule_rows():
        of = presets.REGISTRY[name][control]
        assert key in presets.REGISTRY[name] and key != control
        assert set(allowed) <= (set(of.options) if isinstance(of, presets.Choice) else {"true", "false"})
    text = json.dumps([{"Type": 2, "Parameters": {"method": "Adaptive", "useMorphology": True}}, {"Type": 3, "Parameters": {"invertMethod": "Invert whole page"}}, {"Type": 8, "Parameters": {"enhanceMethod": 1, "retinexRobustNormalize": 0}}])
    found = preset_tables.visible(preset_tables.values(preset_tables.operations(spark.createDataFrame([(1, text)], "preset_id long, text string"))))
    shown = {}
    for r in found.where("visible").collect():
        shown.setdefault(r.type, set()).add(r.key)
    assert shown["Binarize"] == {"method", "blockSize", "meanC", "useGaussian", "useMorphology", "morphKernelBinarize", "morphIterationsBinarize"}
    assert shown["Invert"] == {"invertMethod"}
    assert shown["Enhance"] == {"enhanceMethod", "retinexOutputMode", "retinexUseLabL", "retinexSigma", "retinexGammaHigh", "retinexGammaLow", "retinexEps", "retinexRobustNormalize", "retinexExpClamp"}


def test_asked_is_visible_without_an_exchange(spark):
    """What is asked for is told of each operation alone, and equals what a join of all values finds."""
    from folio import catalog_presets
    from folio.plans import preset_tables

    ops = catalog_presets.operations(spark, "/root/testdata/sf0.001").where("position < 4")
    columns = ["preset_id", "position", "key", "visible"]
    got, want = (sorted(map(tuple, df.select(*columns).collect())) for df in (preset_tables.asked(ops), preset_tables.visible(preset_tables.values(ops))))
    assert got == want and {True, False} == {r[3] for r in got}
    count = lambda df: df._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning")
    assert count(preset_tables.asked(ops)) == count(ops)
