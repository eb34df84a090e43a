"""Queries of resizing by weights: three ratios, up, down and both at once."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folio import rasters
from folio.catalog import PX, longs, register
from folio.operators import resize

SIZES = ((3, 5), (5, 12), (12, 3), (8, 8))
_WEIGHTS = """lengths AS (SELECT unnest([3, 5, 8, 12]) AS m),
  pos AS (SELECT m, t, CAST(floor(((2 * t + 1) * 8 - m) / (2 * m)) AS BIGINT) AS i, (2 * t + 1) * 8 - m AS p FROM lengths, range(12) r(t) WHERE t < m),
  axis AS (SELECT 'Area' AS how, m, t, s, least((t + 1) * 8, (s + 1) * m) - greatest(t * 8, s * m) AS w, 8 AS whole FROM lengths, range(12) a(t), range(8) b(s) WHERE t < m AND least((t + 1) * 8, (s + 1) * m) > greatest(t * 8, s * m)
    UNION ALL SELECT 'Linear', m, t, least(7, greatest(0, i + k)), CASE k WHEN 0 THEN 2 * m - (p - i * 2 * m) ELSE p - i * 2 * m END, 2 * m FROM pos, range(2) r(k)),
  size(w, h) AS (VALUES (3, 5), (5, 12), (12, 3), (8, 8))"""


def resized(spark: SparkSession, sf_dir: str, how: str) -> DataFrame:
    px = rasters.gray_pages(spark, sf_dir)
    each = [longs(resize.resized(px, 8, 8, w, h, how), "page_id", "y", "x", "v").select(F.lit(w).cast("bigint").alias("width"), F.lit(h).cast("bigint").alias("height"), "page_id", "y", "x", "v") for w, h in SIZES]
    return reduce(DataFrame.unionByName, each)


for _how in ("Area", "Linear"):
    register(
        f"o062_resize_{_how.lower()}",
        f"""SELECT CAST(size.w AS BIGINT) AS width, CAST(size.h AS BIGINT) AS height, page_id, CAST(b.t AS BIGINT) AS y, CAST(a.t AS BIGINT) AS x, CAST(round_even(CAST(sum(v * a.w * b.w) AS DOUBLE) / max(a.whole * b.whole), 0) AS BIGINT) AS v
        FROM size JOIN axis a ON a.m = size.w AND a.how = '{_how}' JOIN axis b ON b.m = size.h AND b.how = '{_how}' JOIN px ON px.x = a.s AND px.y = b.s GROUP BY size.w, size.h, page_id, b.t, a.t""",
        PX,
        _WEIGHTS,
    )(lambda spark, d, how=_how: resized(spark, d, how))
