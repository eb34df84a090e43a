"""Queries of border depths by bricks, on 8x8 pages: bricks of a line, half a page deep."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from folio import rasters
from folio.catalog import PX, register
from folio.operators import bricks

_DEPTHS = """side AS (SELECT page_id, 'left' AS side, y AS brick, x AS step, v FROM px UNION ALL SELECT page_id, 'right', y, 7 - x, v FROM px UNION ALL SELECT page_id, 'top', x, y, v FROM px UNION ALL SELECT page_id, 'bottom', x, 7 - y, v FROM px),
  page AS (SELECT page_id, sum(v) AS ps, count(*) AS pn FROM px WHERE x BETWEEN 2 AND 5 AND y BETWEEN 2 AND 5 GROUP BY page_id),
  edge AS (SELECT page_id, side, brick, sum(v) AS s, count(*) AS n FROM side WHERE step < 2 GROUP BY ALL),
  ref AS (SELECT page_id, side, sum(s) AS rs, sum(n) AS rn FROM edge JOIN page USING (page_id) WHERE abs(s * pn - ps * n) >= 30 * n * pn GROUP BY ALL HAVING count(*) >= 4),
  mark AS (SELECT page_id, side, brick, step, abs(v * pn - ps) > 70 * pn OR coalesce(abs(v * rn - rs) * pn < abs(v * pn - ps) * rn, false) AS border FROM side JOIN page USING (page_id) LEFT JOIN ref USING (page_id, side) WHERE step < 4),
  gone AS (SELECT page_id, side, brick, min(step) AS first_gone FROM mark m WHERE border AND step > 1 AND NOT EXISTS (SELECT 1 FROM mark o WHERE o.page_id = m.page_id AND o.side = m.side AND o.brick = m.brick AND o.border AND o.step BETWEEN m.step - 2 AND m.step - 1) GROUP BY ALL),
  deep AS (SELECT page_id, side, brick, CAST(coalesce(max(step + 1) FILTER (border AND step < coalesce(first_gone, 99)), 0) AS BIGINT) AS depth FROM mark LEFT JOIN gone USING (page_id, side, brick) GROUP BY ALL),
  usual AS (SELECT page_id, side, list_sort(list(depth))[count(*) // 2 + 1] AS u FROM deep WHERE depth > 0 GROUP BY ALL),
  firm AS (SELECT page_id, side, brick, CASE WHEN depth > greatest(1, CAST(round_even(u * 0.4::DOUBLE, 0) AS BIGINT)) THEN depth ELSE 0 END AS depth FROM deep LEFT JOIN usual USING (page_id, side)),
  fill AS (SELECT f.page_id, f.side, f.brick, CASE WHEN f.depth > 0 THEN f.depth ELSE coalesce((SELECT (l.depth + r.depth) // 2 FROM firm l, firm r WHERE l.page_id = f.page_id AND r.page_id = f.page_id AND l.side = f.side AND r.side = f.side AND l.depth > 0 AND r.depth > 0
    AND l.brick < f.brick AND r.brick > f.brick AND r.brick - l.brick <= 3 AND NOT EXISTS (SELECT 1 FROM firm z WHERE z.page_id = f.page_id AND z.side = f.side AND z.depth > 0 AND z.brick > l.brick AND z.brick < r.brick)), 0) END AS depth FROM firm f),
  smooth AS (SELECT f.page_id, f.side, f.brick, CASE WHEN any_value(f.depth) = 0 THEN 0 ELSE CAST(round_even(avg(o.depth) FILTER (o.depth > 0), 0) AS BIGINT) END AS depth FROM fill f JOIN fill o ON o.page_id = f.page_id AND o.side = f.side AND abs(o.brick - f.brick) <= 1 GROUP BY ALL),
  bord AS (SELECT page_id, side, coalesce(min(depth) FILTER (depth > 0), 0) AS least, coalesce(avg(depth) FILTER (depth > 0), 0) AS average FROM smooth GROUP BY ALL),
  four AS (SELECT page_id, max(least) FILTER (side = 'left') AS l, max(least) FILTER (side = 'right') AS r, max(least) FILTER (side = 'top') AS t, max(least) FILTER (side = 'bottom') AS b FROM bord GROUP BY page_id)"""


def depths(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bricks.depths(rasters.gray_pages(spark, sf_dir), 8, 8, 1, 0.5, strong=70, seed=30, edge=2, gap=1)


def settled(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bricks.settled(depths(spark, sf_dir), weak=1)


register("o057_brick_depths", "SELECT page_id, side, CAST(brick AS BIGINT) AS brick, depth FROM deep", PX, _DEPTHS)(depths)
register("o057_settled_depths", "SELECT page_id, side, CAST(brick AS BIGINT) AS brick, depth FROM smooth", PX, _DEPTHS)(settled)
register("o057_side_depths", "SELECT page_id, side, least, round(average, 6) AS average FROM bord", PX, _DEPTHS)(lambda spark, d: bricks.sides(settled(spark, d)).selectExpr("page_id", "side", "least", "round(average, 6) AS average"))
register(
    "o057_cut",
    "SELECT page_id, CAST(CASE WHEN l + r < 8 AND t + b < 8 THEN l ELSE 0 END AS BIGINT) AS x, CAST(CASE WHEN l + r < 8 AND t + b < 8 THEN t ELSE 0 END AS BIGINT) AS y, CAST(CASE WHEN l + r < 8 AND t + b < 8 THEN 8 - l - r ELSE 8 END AS BIGINT) AS w, CAST(CASE WHEN l + r < 8 AND t + b < 8 THEN 8 - t - b ELSE 8 END AS BIGINT) AS h FROM four",
    PX,
    _DEPTHS,
)(lambda spark, d: bricks.kept(bricks.sides(settled(spark, d)), 8, 8))
