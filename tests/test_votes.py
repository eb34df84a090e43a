"""Lines and circles that are drawn are found, and nothing else; odd pages give nothing."""

import math

import pytest
from pyspark.sql import functions as F

from folio.operators import votes

PX = "page_id long, y int, x int, v int"


def page(page_id, width, height, dark):
    return [(page_id, y, x, 0 if dark(y, x) else 220) for y in range(height) for x in range(width)]


@pytest.mark.parametrize("slope", [-7, 0, 4])
def test_skew(spark, slope):
    """Bars of six pixels at a slope: the lines of their two sides, in the very distance, whose median is the slope."""
    tan, cos = math.tan(math.radians(slope)), math.cos(math.radians(slope))
    tops = [40, 70, 100]
    bar = lambda y, x: any(t <= y - x * tan < t + 6 for t in tops)
    px = spark.createDataFrame(page(1, 160, 140, bar) + page(2, 20, 20, lambda y, x: False) + page(3, 20, 20, lambda y, x: True), PX)
    found = votes.lines(votes.line_votes(votes.edges(px, F.col("v") < 110), 15, 1), 90)
    got = {r.page_id: r for r in votes.skew(found).collect()}
    assert set(got) == {1} and got[1].angle == slope and 0 < got[1].confidence <= 1
    distances = [r.distance for r in found.where(F.col("angle") == slope).collect()]
    assert all(any(abs(d - (t + more) * cos) <= 1.5 for d in distances) for t in tops for more in (0, 5))


def test_median_and_spread(spark):
    rows = [(1, a, d, 9) for a, d in [(-2, 1), (0, 1), (0, 5), (1, 1), (3, 7), (3, 9)]] + [(2, 4, 0, 9)]
    got = {r.page_id: r for r in votes.skew(spark.createDataFrame(rows, "page_id long, angle long, distance long, n long"), 0.5).collect()}
    assert (got[1].angle, got[1].n, got[1].deviation) == (0.5, 6, pytest.approx(0.5 * (3 + 1 + 1 + 0 + 2 + 2) / 6))
    assert (got[2].angle, got[2].deviation, got[2].confidence) == (2.0, 0.0, pytest.approx(math.log(2) / math.log(31)))


def test_circles(spark):
    holes = [(30, 25, 8), (70, 60, 10)]
    disc = lambda y, x: any((y - cy) ** 2 + (x - cx) ** 2 <= r * r for cy, cx, r in holes)
    box = lambda y, x: 20 <= y < 60 and 20 <= x < 34
    px = spark.createDataFrame(page(1, 90, 100, disc) + page(2, 90, 100, box) + [(3, 0, 0, 0), (3, 0, 1, None)], PX)
    edge = votes.edges(px, F.col("v") < 110)
    found = votes.circles(votes.circle_votes(edge, 7, 11, 90, 100), 7, 11, 0.8, 16)
    assert {(r.page_id, r.cy, r.cx, r.r) for r in found.collect()} == {(1, *h) for h in holes}
    sure = votes.confirmed(found, px)
    assert {(r.cy, r.cx, r.inside, r.around) for r in sure.collect()} == {(cy, cx, 0.0, 220.0) for cy, cx, _ in holes}
    pale = px.withColumn("v", 255 - F.col("v"))
    assert votes.confirmed(found, pale).isEmpty() and votes.confirmed(found, pale, dark=False).count() == 2
    none = spark.createDataFrame([], PX)
    assert votes.circles(votes.circle_votes(votes.edges(none, F.col("v") < 110), 2, 3, 9, 9), 2, 3, 0.5, 4).isEmpty()


def test_rim():
    assert [votes.rim(r) for r in (1, 2, 5)] == [4, 8, 28] and all(abs(votes.rim(r) - 4 * math.sqrt(2) * r) < 8 for r in range(3, 40))
