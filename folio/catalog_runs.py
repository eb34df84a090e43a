"""Queries of components and shapes by runs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folio import rasters
from folio.catalog import LABELS, PX, longs, register
from folio.operators import runs

def dark_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return runs.labelled(rasters.gray_pages(spark, sf_dir), F.col("v") < 110)


register(
    "o068_run_components",
    "SELECT page_id, CAST(label // 8 AS BIGINT) AS top, CAST(label % 8 AS BIGINT) AS first_x, count(*) AS area, CAST(min(x) AS BIGINT) AS left_x, CAST(max(x) AS BIGINT) AS right_x, CAST(max(y) AS BIGINT) AS bottom FROM cc JOIN m USING (page_id, id) GROUP BY page_id, label",
    "RECURSIVE " + PX,
    LABELS,
)(lambda spark, d: longs(runs.components(dark_runs(spark, d)), "page_id", "top", "first_x", "area", "left_x", "right_x", "bottom"))

_SIDES = """part AS (SELECT page_id, label, y, x FROM cc JOIN m USING (page_id, id)),
  sides AS (SELECT p.page_id, p.label, count(*) AS n FROM part p, (VALUES (0, 1), (0, -1), (1, 0), (-1, 0)) d(dy, dx) WHERE NOT EXISTS (SELECT 1 FROM part q WHERE q.page_id = p.page_id AND q.label = p.label AND q.y = p.y + dy AND q.x = p.x + dx) GROUP BY ALL),
  areas AS (SELECT page_id, label, count(*) AS area FROM part GROUP BY ALL),
  box AS (SELECT a.page_id, a.label, y, x FROM areas a, range(-1, 9) r(y), range(-1, 9) s(x)),
  ground AS (SELECT b.* FROM box b ANTI JOIN part p ON p.page_id = b.page_id AND p.label = b.label AND p.y = b.y AND p.x = b.x),
  outside(page_id, label, y, x) AS (SELECT page_id, label, -1, -1 FROM areas UNION SELECT g.page_id, g.label, g.y, g.x FROM outside o JOIN ground g ON g.page_id = o.page_id AND g.label = o.label AND abs(g.y - o.y) + abs(g.x - o.x) = 1),
  inner_ AS (SELECT g.* FROM ground g ANTI JOIN outside o ON o.page_id = g.page_id AND o.label = g.label AND o.y = g.y AND o.x = g.x),
  pool(page_id, label, id, seen) AS (SELECT page_id, label, y * 16 + x, y * 16 + x FROM inner_ UNION SELECT p.page_id, p.label, p.id, j.y * 16 + j.x FROM pool p JOIN inner_ i ON i.page_id = p.page_id AND i.label = p.label AND i.y * 16 + i.x = p.seen JOIN inner_ j ON j.page_id = i.page_id AND j.label = i.label AND abs(j.y - i.y) + abs(j.x - i.x) = 1),
  lakes AS (SELECT page_id, label, count(DISTINCT root) AS n FROM (SELECT page_id, label, id, min(seen) AS root FROM pool GROUP BY ALL) GROUP BY ALL),
  facts AS (SELECT a.page_id, a.label, a.area, s.n AS perimeter, 1 - coalesce(l.n, 0) AS euler, coalesce(l.n, 0) AS n_holes, 4 * pi() * a.area / (s.n * s.n) AS circularity FROM areas a JOIN sides s USING (page_id, label) LEFT JOIN lakes l USING (page_id, label))"""


def facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return runs.shapes(dark_runs(spark, sf_dir)).withColumn("label", F.floor(F.col("label") / runs.ROW) * 8 + F.col("label") % runs.ROW)


register("o070_shape_facts", "SELECT page_id, CAST(label AS BIGINT) AS label, area, perimeter, CAST(euler AS BIGINT) AS euler, CAST(n_holes AS BIGINT) AS n_holes, round(circularity, 6) AS circularity FROM facts", "RECURSIVE " + PX, LABELS, _SIDES)(
    lambda spark, d: longs(facts(spark, d), "page_id", "label", "area", "perimeter", "euler", "n_holes", doubles=("circularity",))
)
register("o107_stamps", "SELECT page_id, CAST(label AS BIGINT) AS label, area, round(circularity, 6) AS circularity FROM facts WHERE area >= 4 AND circularity >= 0.5 AND n_holes <= 1", "RECURSIVE " + PX, LABELS, _SIDES)(
    lambda spark, d: longs(runs.stamps(facts(spark, d), 4, 0.5, 1), "page_id", "label", "area", doubles=("circularity",))
)
