"""Queries of border and page colours, on 32x32 colour pages."""

from __future__ import annotations

from pyspark.sql import functions as F

from folio import rasters
from folio.catalog import PXC, longs, register
from folio.operators import colour_groups as groups

SHEETS = "sheet AS (SELECT page_id // 16 AS page_id, page_id % 16 // 4 * 8 + y AS y, page_id % 4 * 8 + x AS x, b, g, r FROM pxc)"
_SAMPLES = """smp AS (SELECT page_id, b, g, r, count(*) AS n FROM sheet WHERE x < 1 OR y < 1 OR x > 30 OR y > 30 GROUP BY ALL),
  facts AS (SELECT page_id, sum(n) AS c, sum(n * b) AS sb, sum(n * g) AS sg, sum(n * r) AS sr, sum(n * b * b) AS qb, sum(n * g * g) AS qg, sum(n * r * r) AS qr FROM smp GROUP BY page_id)"""
_NEAR = "((16 * b - ab) ** 2 + (16 * g - ag) ** 2 + (16 * r - ar) ** 2 <= (16 * b - zb) ** 2 + (16 * g - zg) ** 2 + (16 * r - zr) ** 2)"
_NEXT = ", ".join(f"CAST(coalesce((32 * sum(n * {c}) FILTER ({test}) + sum(n) FILTER ({test})) // (2 * sum(n) FILTER ({test})), {place}{c}) AS BIGINT)" for place, test in (("a", _NEAR), ("z", "NOT " + _NEAR)) for c in "bgr")
_MEANS = f"""RECURSIVE km(page_id, i, ab, ag, ar, zb, zg, zr) AS (SELECT page_id, 0, 16 * lo[2], 16 * lo[3], 16 * lo[4], 16 * hi[2], 16 * hi[3], 16 * hi[4] FROM (SELECT page_id, min([b + g + r, b, g, r]) AS lo, max([b + g + r, b, g, r]) AS hi FROM smp GROUP BY page_id)
    UNION ALL SELECT page_id, i + 1, {_NEXT} FROM km JOIN smp USING (page_id) WHERE i < 10 GROUP BY page_id, i, ab, ag, ar, zb, zg, zr),
  two AS (SELECT page_id, ab, ag, ar, CAST(coalesce(sum(n) FILTER ({_NEAR}), 0) AS BIGINT) AS na, zb, zg, zr, CAST(coalesce(sum(n) FILTER (NOT {_NEAR}), 0) AS BIGINT) AS nz FROM km JOIN smp USING (page_id) WHERE i = 10 GROUP BY page_id, ab, ag, ar, zb, zg, zr)"""
_MEANS = _MEANS.removeprefix("RECURSIVE ")

register("o050_two_groups", "SELECT * FROM two", "RECURSIVE " + PXC, SHEETS, _SAMPLES, _MEANS)(
    lambda spark, d: longs(groups.two_groups(groups.frame(rasters.sheets(spark, d), 32, 32)), "page_id", "ab", "ag", "ar", "na", "zb", "zg", "zr", "nz")
)
register(
    "o050_border_colour",
    """SELECT page_id, grouped, CAST(CASE WHEN grouped THEN (CASE WHEN na >= nz THEN ab ELSE zb END + 8) // 16 ELSE round_even(sb / c, 0) END AS BIGINT) AS b,
      CAST(CASE WHEN grouped THEN (CASE WHEN na >= nz THEN ag ELSE zg END + 8) // 16 ELSE round_even(sg / c, 0) END AS BIGINT) AS g, CAST(CASE WHEN grouped THEN (CASE WHEN na >= nz THEN ar ELSE zr END + 8) // 16 ELSE round_even(sr / c, 0) END AS BIGINT) AS r
    FROM (SELECT *, NOT ((sqrt(c * qb - sb * sb) / c + sqrt(c * qg - sg * sg) / c + sqrt(c * qr - sr * sr) / c) / 3 < 36 OR c < 50) AS grouped FROM facts JOIN two USING (page_id))""",
    "RECURSIVE " + PXC,
    SHEETS,
    _SAMPLES,
    _MEANS,
)(lambda spark, d: groups.border_colours(groups.frame(rasters.sheets(spark, d), 32, 32), even=36).select("page_id", "grouped", "b", "g", "r"))
register(
    "o059_page_and_border",
    "SELECT page_id, "
    + ", ".join(f"round(sum({c}) FILTER (x BETWEEN 11 AND 20 AND y BETWEEN 11 AND 20) / (255.0::DOUBLE * count(*) FILTER (x BETWEEN 11 AND 20 AND y BETWEEN 11 AND 20)), 6) AS page_{c}, round(sum({c} * k) / (255.0::DOUBLE * sum(k)), 6) AS border_{c}" for c in "bgr")
    + " FROM (SELECT *, CAST(x < 8 AS INT) + CAST(x > 23 AS INT) + CAST(y < 8 AS INT) + CAST(y > 23 AS INT) AS k FROM sheet) GROUP BY page_id",
    PXC,
    SHEETS,
)(lambda spark, d: longs(groups.page_and_border(rasters.sheets(spark, d), 32, 32), "page_id", doubles=tuple(f"{p}_{c}" for p in ("page", "border") for c in "bgr")))
