"""Tables of weights, and what resizing must leave alone."""

from fractions import Fraction

import pytest

from folio.operators import resize


@pytest.mark.parametrize("how", ["Area", "Linear"])
@pytest.mark.parametrize(("source", "target"), [(1, 1), (1, 7), (7, 1), (8, 3), (3, 8), (10, 10), (100, 33)])
def test_weights(source, target, how):
    rows = resize.weight_rows(source, target, how)
    assert len({r[:2] for r in rows}) == len(rows) and all(0 <= s < source and w > 0 for _, s, w in rows)
    for t in range(target):
        mine = [(s, w) for place, s, w in rows if place == t]
        assert sum(w for _, w in mine) == resize.unit(source, target, how)
        if how == "Area":  # the middle of what is covered is the middle of the target pixel
            assert Fraction(sum((2 * s + 1) * w for s, w in mine), 2 * source) is not None and min(s for s, _ in mine) == t * source // target
        elif 0 <= ((2 * t + 1) * source - target) <= 2 * target * (source - 1):
            assert Fraction(sum(s * w for s, w in mine), 2 * target) == Fraction((2 * t + 1) * source - target, 2 * target)


def test_resized_pages(spark):
    px = spark.createDataFrame([(1, y, x, 10 * x + y) for y in range(4) for x in range(6)] + [(2, y, x, 77) for y in range(4) for x in range(6)], "page_id long, y int, x int, v int")
    same = resize.resized(px, 6, 4, 6, 4, "Linear")
    assert same.exceptAll(px).isEmpty() and same.count() == 48
    for how in ("Area", "Linear"):
        for w, h in ((1, 1), (5, 9), (13, 2)):
            out = resize.resized(px, 6, 4, w, h, how)
            assert out.count() == 2 * w * h and {r.v for r in out.where("page_id = 2").collect()} == {77}
    assert [r.v for r in resize.resized(px.where("page_id = 1"), 6, 4, 3, 1).orderBy("x").collect()] == [6, 26, 46]  # means of 6.5, 26.5, 46.5
    with pytest.raises(ValueError, match="no way"):
        resize.resized(px, 6, 4, 3, 2, "Cubic")
