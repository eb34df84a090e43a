"""Queries of boxes that are joined."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from folio import catalog
from folio.catalog import BOXES, LABELS, PX, register
from folio.operators import boxes


def spread_boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The boxes of dark components, on pages a hundred times as large, each 60 pixels short of its cells."""
    return catalog.boxes(spark, sf_dir).selectExpr("page_id", "100 * x AS x", "100 * y AS y", "100 * w - 60 AS w", "100 * h - 60 AS h")


def _merging(first: str, gap: int) -> tuple[str, str]:
    """A round takes each box to that around all within reach of it; what no longer changes is joined."""
    reached = f"p.l - q.r <= {gap} AND q.l - p.r <= {gap} AND p.t - q.b <= {gap} AND q.t - p.b <= {gap}"
    of = lambda f, side: f"'{side}': {f}([q.{side} FOR q IN k IF {reached}])"
    box = "{" + ", ".join((of("list_min", "l"), of("list_min", "t"), of("list_max", "r"), of("list_max", "b"))) + "}"
    rounds = f"""rounds AS (SELECT page_id, 0 AS nth, list_sort(list({first})) AS k FROM bx GROUP BY page_id
      UNION ALL SELECT page_id, nth + 1, n FROM (SELECT page_id, nth, k, list_sort(list_distinct([{box} FOR p IN k])) AS n FROM rounds) WHERE n <> k)"""
    return rounds, "SELECT page_id, CAST(k.l AS BIGINT) AS x, CAST(k.t AS BIGINT) AS y, CAST(k.r - k.l AS BIGINT) AS w, CAST(k.b - k.t AS BIGINT) AS h FROM (SELECT page_id, unnest(arg_max(k, nth)) AS k FROM rounds GROUP BY page_id)"


_ROUNDS, _LAST = _merging("{'l': l, 't': t, 'r': r, 'b': b}", 0)
register("o110_merged_boxes", _LAST, "RECURSIVE " + PX, LABELS, BOXES, _ROUNDS)(lambda spark, d: boxes.merged(catalog.boxes(spark, d), 0))
_ROUNDS, _LAST = _merging("{'l': 100 * l, 't': 100 * t, 'r': 100 * r - 60, 'b': 100 * b - 60}", 60)
register("o110_merged_near", _LAST, "RECURSIVE " + PX, LABELS, BOXES, _ROUNDS)(lambda spark, d: boxes.merged(spread_boxes(spark, d), 60))

_INFLATED = """sb AS (SELECT page_id, label, 100 * l AS x, 100 * t AS y, 100 * (r - l) - 60 AS w, 100 * (b - t) - 60 AS h FROM bx),
  sq AS (SELECT page_id, CASE WHEN count(*) >= 3 THEN greatest(3, least(greatest(3, greatest(list_sort(list(w))[count(*) // 2 + 1], list_sort(list(h))[count(*) // 2 + 1]) // 4), 4)) ELSE 4 END AS k FROM sb GROUP BY page_id),
  wide AS (SELECT page_id, label, k, greatest(0, x - e) AS x, greatest(0, y - e) AS y, w + 2 * e AS w, h + 2 * e AS h FROM (SELECT *, CAST(round_even(greatest(12.0::DOUBLE, greatest(w, h) * 0.15::DOUBLE), 0) AS BIGINT) AS e FROM sb) JOIN sq USING (page_id)),
  painted AS (SELECT page_id, label, greatest(0, x - 2 * (k - 1 - k // 2)) AS l, greatest(0, y - 2 * (k - 1 - k // 2)) AS t, least(800, x + least(800 - x, w) + 2 * (k // 2)) AS r, least(800, y + least(800 - y, h) + 2 * (k // 2)) AS b FROM wide),
  hang(page_id, label, seen) AS (SELECT page_id, label, label FROM painted UNION SELECT g.page_id, g.label, q.label FROM hang g JOIN painted p ON p.page_id = g.page_id AND p.label = g.seen JOIN painted q ON q.page_id = p.page_id AND q.l <= p.r AND p.l <= q.r AND q.t <= p.b AND p.t <= q.b),
  of AS (SELECT page_id, label, min(seen) AS one FROM hang GROUP BY ALL)"""
register("o109_inflated_boxes", "SELECT page_id, CAST(min(l) AS BIGINT) AS x, CAST(min(t) AS BIGINT) AS y, CAST(max(r) - min(l) AS BIGINT) AS w, CAST(max(b) - min(t) AS BIGINT) AS h FROM painted JOIN of USING (page_id, label) GROUP BY page_id, one", "RECURSIVE " + PX, LABELS, BOXES, _INFLATED)(
    lambda spark, d: boxes.inflated(spread_boxes(spark, d), 800, 800)
)
