"""Queries of the cheapest way down a page, on whole texts as pages 64 wide: columns 26 to 38, from the first line to the last."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from folio import rasters
from folio.catalog import longs, register
from folio.operators import seams

FILLED = """filled AS (SELECT doc_id AS page_id, i // 64 AS y, i % 64 AS x, CASE WHEN i < n THEN CAST(least(255, ord(t[i + 1])) AS BIGINT) ELSE 255 END AS v
  FROM (SELECT doc_id, t, n, unnest(range((n + 63) // 64 * 64)) AS i FROM (SELECT doc_id, string_split(text, '') AS t, length(text) AS n FROM documents WHERE length(text) > 0)))"""
_COST = """side AS (SELECT *, coalesce(lag(v) OVER r, lead(v) OVER r, v) AS l, coalesce(lead(v) OVER r, lag(v) OVER r, v) AS q FROM filled WINDOW r AS (PARTITION BY page_id, y ORDER BY x)),
  half AS (SELECT page_id, y, x, v, q - l AS dx, l + 2 * v + q AS sx FROM side),
  slope AS (SELECT *, coalesce(lag(dx) OVER c, lead(dx) OVER c, dx) + 2 * dx + coalesce(lead(dx) OVER c, lag(dx) OVER c, dx) AS gx, coalesce(lead(sx) OVER c, lag(sx) OVER c, sx) - coalesce(lag(sx) OVER c, lead(sx) OVER c, sx) AS gy
    FROM half WINDOW c AS (PARTITION BY page_id, x ORDER BY y)),
  price AS (SELECT page_id, y, x, CAST(12 * CASE WHEN v <= 100 THEN 255 ELSE 0 END + 5 * (255 - v) + 3 * round_even((least(255, abs(gx)) + least(255, abs(gy)))::DOUBLE / 2, 0) AS BIGINT) AS cost FROM slope)"""
_WAYS = """ln AS (SELECT page_id, y, list(cost ORDER BY x) AS line FROM price WHERE x BETWEEN 26 AND 38 GROUP BY page_id, y),
  walk(page_id, y, own) AS (SELECT page_id, y, line FROM ln WHERE y = 0 UNION ALL
    SELECT l.page_id, l.y, [l.line[i] + least(k.own[i], CASE WHEN i > 1 THEN k.own[i - 1] END, k.own[i + 1]) FOR i IN range(1, 14)] FROM walk k JOIN ln l ON l.page_id = k.page_id AND l.y = k.y + 1),
  done AS MATERIALIZED (SELECT *, max(y) OVER (PARTITION BY page_id) AS last FROM walk),
  way(page_id, y, i) AS (SELECT page_id, y, list_position(own, list_min(own)) FROM done WHERE y = last UNION ALL
    SELECT d.page_id, d.y, w.i + CASE WHEN d.own[w.i + 1] < least(d.own[w.i], CASE WHEN w.i > 1 THEN d.own[w.i - 1] END) THEN 1 WHEN w.i > 1 AND d.own[w.i - 1] < d.own[w.i] THEN -1 ELSE 0 END
    FROM way w JOIN done d ON d.page_id = w.page_id AND d.y = w.y - 1)"""


def found_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    return seams.page_paths(rasters.level_texts(spark, sf_dir, filled=True), 100, 26, 38)


register("o120_pixel_costs", "SELECT page_id, y, x, cost FROM price", FILLED, _COST)(lambda spark, d: longs(seams.page_costs(rasters.level_texts(spark, d, filled=True), 100), "page_id", "y", "x", "cost"))
register("o120_seam_path", "SELECT page_id, y, CAST(i + 25 AS BIGINT) AS x FROM way", "RECURSIVE " + FILLED, _COST, _WAYS)(lambda spark, d: longs(seams.steps(found_paths(spark, d)), "page_id", "y", "x"))
register(
    "o120_seam_column",
    "SELECT page_id, CAST(split_x AS BIGINT) AS split_x, CAST(total AS BIGINT) AS total FROM (SELECT page_id, list_sort(list(i + 25))[count(*) // 2 + 1] AS split_x FROM way GROUP BY page_id) JOIN (SELECT page_id, list_min(own) AS total FROM done WHERE y = last) USING (page_id)",
    "RECURSIVE " + FILLED,
    _COST,
    _WAYS,
)(lambda spark, d: longs(found_paths(spark, d), "page_id", "split_x", "total"))
