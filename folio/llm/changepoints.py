"""Penalised change points (operator 11): the daily sums of each vendor, cut by optimal partitioning.

Rows meet by vendor and day first, with map-side sums, so a vendor with a third of all rows is a few sums a task and
one row a day after that. A series (one row a day, days without rows filled with 0) is then one group of ``applyInPandas``; its
size is the number of days, not of rows.

For each end day the programme takes the least (cost, segments) over all starts at once: costs of segments
come from prefix sums of values and squares, in whole numbers. The first start of the least is the earliest, and as the best of a
prefix is itself unique, following the starts backwards gives the answer of the contract.

Defined results: rows with a null quantity or day, or of other flags (null among them), are left out; a null vendor is a
vendor of its own; repeated rows count each; a series of one day, and any under twice ``least`` days, is one segment; an empty table
gives an empty result; columns other than the four read are ignored, whatever their names. What is beyond 64 bits (squares times days)
is worked out in whole numbers of any size; a spread beyond them is reported as 2^63 - 1. Quantities may be negative or zero. Series of many years
cost the square of their days in time; memory is a few arrays of the days and a block of ``BLOCK`` costs.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

LEAST, PENALTY = 5, 10_000
BLOCK = 2_000_000  # costs held at once
SEGMENT = "vendor_id long, segment_no int, first_day long, n_days long, total long, spread long, cost long, n_segments long, best_cost long"


def prefix(values: np.ndarray) -> np.ndarray:
    return np.concatenate([np.zeros(1, values.dtype), np.cumsum(values)])


def spreads(n: np.ndarray, s: np.ndarray, q: np.ndarray) -> np.ndarray:
    """1 + floor((n * q - s * s) / (n * n)) of days, sums and sums of squares."""
    return 1 + (n * q - s * s) // (n * n)


def costs(n: np.ndarray, spread: np.ndarray) -> np.ndarray:
    return n * np.floor(1000 * np.log(spread.astype(np.float64))).astype(np.int64)


def starts_of(values: np.ndarray, least: int = LEAST, penalty: int = PENALTY) -> list[int]:
    """Where the segments of the best partition of ``values`` start, ascending."""
    days = len(values)
    if days < 2 * least:
        return [0]
    sums, squares = prefix(values), prefix(values * values)
    # (cost, segments) as one number, cost * unit + segments; what no partition ends at is beyond all. A start but the first has a penalty.
    unit, back = days + 1, np.zeros(days + 1, np.int64)
    best = np.full(days + 1, 2**62, np.int64)
    best[0] = 0
    block = max(1, BLOCK // days)
    for low in range(least, days + 1, block):
        ends = np.arange(low, min(low + block, days + 1))
        first = np.arange(0, ends[-1] - least + 1)
        n = np.maximum(ends[:, None] - first, 1)
        cost = costs(n, np.maximum(spreads(n, sums[ends][:, None] - sums[first], squares[ends][:, None] - squares[first]), 1)) * unit + 1
        cost[:, 1:] += penalty * unit
        for row, end in zip(cost, ends.tolist()):
            total = row[: end - least + 1] + best[: end - least + 1]
            back[end] = start = int(total.argmin())
            best[end] = total[start]
    out, at = [], days
    while at:
        at = int(back[at])
        out.append(at)
    return out[::-1]


def exact(values: list[int]) -> np.ndarray:
    """``values`` as 64-bit numbers if all that is worked out of them fits, otherwise as Python's."""
    squares, n = sum(v * v for v in values), len(values)
    return np.array(values, np.int64 if n * squares < 2**62 and sum(map(abs, values)) < 2**31 else object)


def segments(vendor, days: np.ndarray, sums: list[int], least: int = LEAST, penalty: int = PENALTY) -> pd.DataFrame:
    """The segments of one vendor's series, given by the sums of the days that have rows."""
    first = int(days.min())
    filled = [0] * (int(days.max()) - first + 1)
    for day, value in zip(days.tolist(), sums):
        filled[day - first] = int(value)
    values = exact(filled)
    starts = np.array(starts_of(values, least, penalty), np.int64)
    n = np.diff(np.append(starts, len(values)))
    total = np.add.reduceat(values, starts)
    spread = spreads(n if values.dtype != object else n.astype(object), total, np.add.reduceat(values * values, starts))
    cost = costs(n, spread)
    return pd.DataFrame(
        {
            "vendor_id": pd.array([vendor] * len(starts), "Int64"),
            "segment_no": np.arange(1, len(starts) + 1, dtype=np.int32),
            "first_day": first + starts,
            "n_days": n,
            "total": total.astype(np.int64),
            "spread": np.minimum(spread, 2**63 - 1).astype(np.int64),
            "cost": cost,
            "n_segments": np.full(len(starts), len(starts), np.int64),
            "best_cost": np.full(len(starts), int(cost.sum()) + penalty * (len(starts) - 1), np.int64),
        }
    )


def daily(lines: DataFrame, flags: tuple[str, ...] = ("kept", "swapped")) -> DataFrame:
    """(vendor_id, day, amount): the sum of quantity of each vendor and day with rows."""
    taken = lines.where(F.col("flag").isin(*flags) & F.col("quantity").isNotNull() & F.col("shipped_at").isNotNull())
    rows = taken.select(F.col("vendor_id").cast("long").alias("vendor_id"), F.unix_date(F.to_date("shipped_at")).cast("long").alias("day"), F.col("quantity").cast("long").alias("amount"))
    return rows.groupBy("vendor_id", "day").agg(F.sum("amount").alias("amount"))


def change_points(lines: DataFrame, least: int = LEAST, penalty: int = PENALTY) -> DataFrame:
    """vendor_id, segment_no, first_day, n_days, total, spread, cost, n_segments, best_cost for each segment of each vendor."""
    if least < 1:
        raise ValueError("a segment has one day at least")

    def cut(key: tuple, group: pd.DataFrame) -> pd.DataFrame:
        vendor = None if key[0] is None or key[0] != key[0] else int(key[0])
        return segments(vendor, group["day"].to_numpy(np.int64), group["amount"].tolist(), least, penalty)

    parts = int(lines.sparkSession.conf.get("spark.sql.shuffle.partitions"))  # said, as a few rows are much work and would be put together
    return daily(lines).repartition(parts, "vendor_id").groupBy("vendor_id").applyInPandas(cut, SEGMENT)


#: The same in DuckDB: best prefixes grow day by day in lists, and the starts are followed back.
SQL = """
WITH RECURSIVE daily AS (
    SELECT vendor_id, date_diff('day', DATE '1970-01-01', CAST(shipped_at AS DATE)) AS day, CAST(sum(quantity) AS BIGINT) AS amount
    FROM sale_lines WHERE flag IN ('kept', 'swapped') AND quantity IS NOT NULL AND shipped_at IS NOT NULL GROUP BY ALL
), span AS (SELECT vendor_id, min(day) AS first_day, max(day) AS last_day FROM daily GROUP BY vendor_id),
filled AS (
    SELECT s.vendor_id, s.first_day, g.day, CAST(coalesce(d.amount, 0) AS HUGEINT) AS v
    FROM (SELECT *, unnest(range(first_day, last_day + 1)) AS day FROM span) g JOIN span s ON s.vendor_id IS NOT DISTINCT FROM g.vendor_id
    LEFT JOIN daily d ON d.vendor_id IS NOT DISTINCT FROM g.vendor_id AND d.day = g.day
), summed AS (
    SELECT vendor_id, first_day, day, sum(v) OVER w AS s, sum(v * v) OVER w AS q FROM filled WINDOW w AS (PARTITION BY vendor_id ORDER BY day ROWS UNBOUNDED PRECEDING)
), series AS (
    SELECT vendor_id, first_day, count(*) AS n, list_concat([CAST(0 AS HUGEINT)], list(s ORDER BY day)) AS s, list_concat([CAST(0 AS HUGEINT)], list(q ORDER BY day)) AS q
    FROM summed GROUP BY vendor_id, first_day
), programme AS (
    SELECT vendor_id, n, s, q, CAST(0 AS BIGINT) AS t, [{'c': CAST(0 AS BIGINT), 'p': CAST(0 AS BIGINT), 'b': CAST(0 AS BIGINT)}] AS best FROM series
    UNION ALL
    SELECT vendor_id, n, s, q, t + 1, list_append(best, list_min(list_transform(
        list_filter(range(0, t + 2), lambda j: j = 0 OR (j >= 5 AND j <= t + 1 - 5)),
        lambda j: {'c': CAST(best[j + 1].c + CASE WHEN j > 0 THEN 10000 ELSE 0 END
                + (t + 1 - j) * floor(1000 * ln(CAST(1 + ((t + 1 - j) * (q[t + 2] - q[j + 1]) - (s[t + 2] - s[j + 1]) * (s[t + 2] - s[j + 1])) // ((t + 1 - j) * (t + 1 - j)) AS DOUBLE))) AS BIGINT),
            'p': CAST(best[j + 1].p + 1 AS BIGINT), 'b': CAST(j AS BIGINT)})))
    FROM programme WHERE t < n
), ends AS (SELECT * FROM programme WHERE t = n),
cuts AS (
    SELECT vendor_id, n, s, q, best, n AS upto, best[n + 1].b AS start FROM ends
    UNION ALL
    SELECT vendor_id, n, s, q, best, start, best[start + 1].b FROM cuts WHERE start > 0
), parts AS (
    SELECT c.vendor_id, r.first_day + start AS first_day, upto - start AS n_days, s[upto + 1] - s[start + 1] AS total, q[upto + 1] - q[start + 1] AS squares, best[c.n + 1].p AS n_segments, best[c.n + 1].c AS best_cost
    FROM cuts c JOIN (SELECT vendor_id, first_day FROM series) r ON r.vendor_id IS NOT DISTINCT FROM c.vendor_id
)
SELECT vendor_id, CAST(row_number() OVER (PARTITION BY vendor_id ORDER BY first_day) AS INTEGER) AS segment_no, CAST(first_day AS BIGINT) AS first_day, CAST(n_days AS BIGINT) AS n_days,
    CAST(total AS BIGINT) AS total, CAST(1 + (n_days * squares - total * total) // (n_days * n_days) AS BIGINT) AS spread,
    CAST(n_days * floor(1000 * ln(CAST(1 + (n_days * squares - total * total) // (n_days * n_days) AS DOUBLE))) AS BIGINT) AS cost, CAST(n_segments AS BIGINT) AS n_segments, CAST(best_cost AS BIGINT) AS best_cost
FROM parts
"""
