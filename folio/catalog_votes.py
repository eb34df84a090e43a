"""Queries of lines and circles by votes, on spreads of 16x8 pixels and pages of 8x8."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folio import rasters
from folio.catalog import PX, SPREAD, longs, register
from folio.operators import votes


def _edges(pages: str) -> str:
    return f"edge AS (SELECT page_id, y, x FROM {pages} p WHERE v < 110 AND EXISTS (SELECT 1 FROM {pages} q WHERE q.page_id = p.page_id AND abs(q.y - p.y) + abs(q.x - p.x) = 1 AND q.v >= 110))"


_LINES = """turn AS (SELECT a, CAST(round(cos(radians(a * 3.0::DOUBLE)) * 65536) AS BIGINT) AS c, CAST(round(sin(radians(a * 3.0::DOUBLE)) * 65536) AS BIGINT) AS s FROM range(-15, 16) t(a)),
  vote AS (SELECT page_id, a AS angle, (y * c - x * s + 32768) >> 16 AS distance, count(*) AS n FROM edge, turn GROUP BY ALL),
  line AS (SELECT * FROM vote v WHERE n >= 5 AND NOT EXISTS (SELECT 1 FROM vote o WHERE o.page_id = v.page_id AND abs(o.angle - v.angle) <= 1 AND abs(o.distance - v.distance) <= 1
    AND (o.n > v.n OR o.n = v.n AND (o.angle < v.angle OR o.angle = v.angle AND o.distance < v.distance)))),
  mid AS (SELECT page_id, count(*) AS n, list_sort(list(angle))[count(*) // 2 + 1] AS middle FROM line GROUP BY page_id),
  sk AS (SELECT page_id, 3.0::DOUBLE * any_value(middle) AS angle, any_value(mid.n) AS n, 3.0::DOUBLE * sum(abs(line.angle - middle)) / any_value(mid.n) AS deviation FROM line JOIN mid USING (page_id) GROUP BY page_id)"""


def found_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return votes.lines(votes.line_votes(votes.edges(rasters.spreads(spark, sf_dir), F.col("v") < 110), 45, 3), 5)


register("o040_line_votes", "SELECT page_id, CAST(angle AS BIGINT) AS angle, CAST(distance AS BIGINT) AS distance, n FROM line", PX, SPREAD, _edges("spr"), _LINES)(lambda spark, d: longs(found_lines(spark, d), "page_id", "angle", "distance", "n"))
register(
    "o040_line_angle",
    "SELECT page_id, n, round(angle, 6) AS angle, round(deviation, 6) AS deviation, round(least(1, ln(1 + n) / ln(31)) * greatest(0, least(1, (3 - deviation) / 3)), 6) AS confidence FROM sk",
    PX,
    SPREAD,
    _edges("spr"),
    _LINES,
)(lambda spark, d: longs(votes.skew(found_lines(spark, d), 3), "page_id", "n", doubles=("angle", "deviation", "confidence")))

_CIRCLES = """rim AS (SELECT r, dy, dx FROM range(1, 3) a(r), range(-2, 3) b(dy), range(-2, 3) c(dx) WHERE dx * dx + dy * dy > (r - 1) * (r - 1) AND dx * dx + dy * dy <= r * r),
  size AS (SELECT r, count(*) AS whole FROM rim GROUP BY r),
  around AS (SELECT page_id, y + dy AS cy, x + dx AS cx, r, 1000000 * count(*) // any_value(whole) AS score FROM edge, rim JOIN size USING (r) WHERE y + dy BETWEEN 0 AND 7 AND x + dx BETWEEN 0 AND 7 GROUP BY ALL),
  cand AS (SELECT *, row_number() OVER (PARTITION BY page_id ORDER BY score DESC, r, cy, cx) AS nth FROM around WHERE score >= 600000),
  circle AS (SELECT * FROM cand c WHERE NOT EXISTS (SELECT 1 FROM cand o WHERE o.page_id = c.page_id AND o.nth < c.nth AND (o.cy - c.cy) * (o.cy - c.cy) + (o.cx - c.cx) * (o.cx - c.cx) <= 9)),
  mean AS (SELECT c.page_id, cy, cx, r, score, avg(v) FILTER ((y - cy) * (y - cy) + (x - cx) * (x - cx) <= r * r) AS inside, avg(v) FILTER ((y - cy) * (y - cy) + (x - cx) * (x - cx) > (r + 1) * (r + 1) AND (y - cy) * (y - cy) + (x - cx) * (x - cx) <= (r + 2) * (r + 2)) AS around
    FROM circle c JOIN px USING (page_id) GROUP BY ALL)"""


def found_circles(spark: SparkSession, sf_dir: str) -> DataFrame:
    ballot = votes.circle_votes(votes.edges(rasters.gray_pages(spark, sf_dir), F.col("v") < 110), 1, 2, 8, 8)
    return votes.circles(ballot, 1, 2, 0.6, 3)


register("o099_circle_votes", "SELECT page_id, CAST(cy AS BIGINT) AS cy, CAST(cx AS BIGINT) AS cx, r, CAST(score AS BIGINT) AS score FROM circle", PX, _edges("px"), _CIRCLES)(lambda spark, d: longs(found_circles(spark, d), "page_id", "cy", "cx", "r", "score"))
register("o099_dark_circles", "SELECT page_id, CAST(cy AS BIGINT) AS cy, CAST(cx AS BIGINT) AS cx, r, round(inside, 6) AS inside, round(around, 6) AS around FROM mean WHERE around - inside > 8", PX, _edges("px"), _CIRCLES)(
    lambda spark, d: longs(votes.confirmed(found_circles(spark, d), rasters.gray_pages(spark, d), True, 1, 2), "page_id", "cy", "cx", "r", doubles=("inside", "around"))
)
