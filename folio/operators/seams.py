"""The cheapest way down a page between its halves: costs of pixels, a fold over the rows of a page, and the path back.

A page is one group, as its rows depend on each other; what is held is the columns of the band only. Costs are whole numbers, so paths are exact. Exploded pages
are sorted and folded in the JVM; packed pages (:func:`page_costs`, :func:`page_paths`) have it done where they lie, a batch at a time, and nothing is shuffled.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, LongType

from folio.operators.run_codes import buffers, chunks, fields

#: Shares of ink, darkness and slope in a pixel's cost; a cost of 1 is UNIT.
INK, DARKNESS, SLOPE = 12, 5, 3
UNIT = 255 * (INK + DARKNESS + SLOPE)


def by_page(px: DataFrame) -> DataFrame:
    """Pages whole in their partitions: the one exchange that costs, rows and paths need."""
    return px.repartition("page_id")


def slopes(px: DataFrame) -> DataFrame:
    """Adds ``slope``: the mean of both Sobel sums, each at most 255, half to even; beyond an edge the pixels before it are mirrored."""
    wx, wy = Window.partitionBy("page_id", "y").orderBy("x"), Window.partitionBy("page_id", "x").orderBy("y")

    def sides(c: str, w) -> tuple[Column, Column]:
        back, on = F.lag(c).over(w), F.lead(c).over(w)
        return F.coalesce(back, on, F.col(c)), F.coalesce(on, back, F.col(c))

    (left, right) = sides("v", wx)
    one = px.withColumns({"dx": right - left, "sx": left + 2 * F.col("v") + right})
    (dx0, dx1), (sx0, sx1) = sides("dx", wy), sides("sx", wy)
    part = lambda c: F.least(F.lit(255), F.abs(c))
    return one.withColumn("slope", F.bround((part(dx0 + 2 * F.col("dx") + dx1) + part(sx1 - sx0)) / 2.0, 0).cast("long")).drop("dx", "sx")


def costs(px: DataFrame, ink: Column) -> DataFrame:
    """(page_id, y, x, cost) of pixels of a lightness ``v``: what is ``ink``, dark, or on an edge is dear; at most UNIT."""
    dark = F.when(ink, 255).otherwise(0)
    return slopes(px).select("page_id", "y", "x", (INK * dark + DARKNESS * (255 - F.col("v")) + SLOPE * F.col("slope")).cast("long").alias("cost"))


def paths(cost: DataFrame, first: Column | int, last: Column | int) -> DataFrame:
    """(page_id, top, path, split_x, total) of the cheapest way from the first row of each page to its last within the columns first..last, at most one
    column aside a row. Ties go straight, then left; of ends that cost the same, the leftmost. split_x is the upper median of the path, path[i] the column in row top + i.

    Every row has every column of the band; pages without a pixel there have no path.
    """
    lines = (
        cost.where(F.col("x").between(first, last)).groupBy("page_id", "y").agg(F.array_sort(F.collect_list(F.struct("x", "cost"))).alias("p"))
        .select("page_id", "y", F.col("p")[0]["x"].alias("low"), F.col("p")["cost"].alias("line"))
    )
    pages = lines.groupBy("page_id").agg(F.array_sort(F.collect_list(F.struct("y", "line"))).alias("lines"), F.min("y").alias("top"), F.min("low").alias("low"))

    def step(own: Column, i: Column) -> Column:
        here, left, right = F.get(own, i), F.get(own, i - 1), F.get(own, i + 1)
        beside = F.coalesce(left < here, F.lit(False))
        return F.when(F.coalesce(right < F.least(here, left), F.lit(False)), 1).when(beside, -1).otherwise(0)

    def down(state: Column, line: Column) -> Column:
        own = state["own"]
        return F.struct(
            F.transform(line["line"], lambda c, i: c + F.least(F.get(own, i), F.get(own, i - 1), F.get(own, i + 1))).alias("own"),
            F.array_append(state["back"], F.transform(own, lambda _, i: step(own, i))).alias("back"),
        )

    start = F.struct(F.col("lines")[0]["line"].alias("own"), F.expr("cast(array() as array<array<int>>)").alias("back"))
    folded = pages.select("page_id", "top", "low", F.aggregate(F.slice("lines", 2, F.greatest(F.size("lines"), F.lit(1))), start, down).alias("f"))
    ends = folded.withColumns({"total": F.array_min("f.own"), "end": (F.array_position("f.own", F.array_min("f.own")) - 1).cast("int")})

    def up(state: Column, back: Column) -> Column:
        at = state["at"] + F.get(back, state["at"])
        return F.struct(at.alias("at"), F.array_append(state["path"], at).alias("path"))

    walked = F.aggregate(F.reverse("f.back"), F.struct(F.col("end").alias("at"), F.array("end").alias("path")), up)["path"]
    path = F.transform(F.reverse(walked), lambda at: at + F.col("low"))
    out = ends.select("page_id", "top", path.alias("path"), "total")
    return out.select("page_id", "top", "path", F.sort_array("path")[F.floor(F.size("path") / 2).cast("int")].alias("split_x"), "total")


def steps(found: DataFrame) -> DataFrame:
    """(page_id, y, x): the paths, a row a line."""
    return found.select("page_id", "top", F.posexplode("path").alias("i", "x")).select("page_id", (F.col("top") + F.col("i")).alias("y"), "x")


# ---- packed pages
def costs_of(v: np.ndarray, first: np.ndarray, last: np.ndarray, most: int) -> np.ndarray:
    """``costs`` of pages of one width that lie below each other; ``first`` and ``last`` mark the rows that begin and end a page."""
    row, column = np.arange(len(v)), np.arange(v.shape[1])
    v = v.astype(np.int32)

    def sides(q: np.ndarray, at: np.ndarray, begins: np.ndarray, ends: np.ndarray, axis: int) -> tuple[np.ndarray, np.ndarray]:
        back, on = np.where(begins, np.where(ends, at, at + 1), at - 1), np.where(ends, np.where(begins, at, at - 1), at + 1)
        return q.take(back, axis), q.take(on, axis)

    left, right = sides(v, column, column == 0, column == v.shape[1] - 1, 1)
    dx, sx = right - left, left + 2 * v + right
    (dx0, dx1), (sx0, sx1) = sides(dx, row, first, last, 0), sides(sx, row, first, last, 0)
    twice = np.minimum(255, np.abs(dx0 + 2 * dx + dx1)) + np.minimum(255, np.abs(sx1 - sx0))
    return INK * np.where(v <= most, 255, 0) + DARKNESS * (255 - v) + SLOPE * np.rint(twice / 2.0).astype(np.int32)


def costs_by_batch(pixels: pa.Array, width: pa.Array, most: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(page, its rows, costs) of stretches of pages of one width; pages without whole rows are left out."""
    data, at = buffers(pixels)
    size, wide = np.diff(at), width.fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
    good = (size > 0) & (wide > 0) & (size % np.maximum(wide, 1) == 0)
    for w in np.unique(wide[good]):
        pages = np.flatnonzero(good & (wide == w))
        for s in chunks(size[pages]):
            own = pages[s]
            rows = size[own] // w
            v = np.concatenate([data[at[p] : at[p + 1]] for p in own]).reshape(-1, w)
            ends = np.cumsum(rows)
            first, last = np.zeros(len(v), bool), np.zeros(len(v), bool)
            first[ends - rows], last[ends - 1] = True, True
            yield own, rows, costs_of(v, first, last, most)


def page_costs(pages: DataFrame, most: int) -> DataFrame:
    """``costs`` of packed pages of one channel (page_id, width, pixels), ink up to the level ``most``. Rows leave a task some pages at a time."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            names = b.column("page_id").to_numpy(zero_copy_only=False)
            for own, rows, cost in costs_by_batch(b.column("pixels"), b.column("width"), most):
                w = cost.shape[1]
                each = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(rows * w)]), pa.int32()), pa.array(cost.ravel().astype(np.int32)))
                yield pa.RecordBatch.from_arrays([pa.array(names[own]), pa.array(np.full(len(own), w, np.int32)), each], names=["page_id", "width", "cost"])

    found = pages.select("page_id", "width", "pixels").mapInArrow(task, "page_id bigint, width int, cost array<int>")
    i = found.select("page_id", "width", F.posexplode("cost").alias("i", "cost"))
    return i.select("page_id", F.floor(F.col("i") / F.col("width")).cast("int").alias("y"), (F.col("i") % F.col("width")).cast("int").alias("x"), F.col("cost").cast("long").alias("cost"))


def walked(lines: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(column of each row, total of each page): the cheapest way down each of the pages that lie below each other in ``lines``. A step takes all pages a row on."""
    begin = np.cumsum(rows) - rows
    deep = np.argsort(-rows, kind="stable")  # the pages that go on are always the first ones
    rows, begin = rows[deep], begin[deep]
    back = np.zeros(lines.shape, np.int8)
    own = lines[begin].astype(np.int64)
    far = np.full((len(rows), 1), np.iinfo(np.int64).max // 2)
    for y in range(1, int(rows[0])):
        n = int(np.searchsorted(-rows, -y, "left"))  # pages with more than y rows
        here = own[:n]
        left, right = np.concatenate([far[:n], here[:, :-1]], 1), np.concatenate([here[:, 1:], far[:n]], 1)
        best = np.minimum(here, left)
        back[begin[:n] + y] = np.where(right < best, 1, np.where(left < here, -1, 0))
        own[:n] = np.minimum(best, right) + lines[begin[:n] + y]
    path = np.zeros(len(lines), np.int64)
    at = own.argmin(1)
    for y in range(int(rows[0]) - 1, -1, -1):
        n = int(np.searchsorted(-rows, -y, "left"))
        path[begin[:n] + y] = at[:n]
        at[:n] += back[begin[:n] + y, at[:n]]
    total = np.zeros(len(rows), np.int64)
    total[deep] = own.min(1)
    return path, total


@F.arrow_udf(fields(path=ArrayType(IntegerType()), split_x=IntegerType(), total=LongType()))
def path_of_pixels(pixels: pa.Array, width: pa.Array, most: pa.Array, first: pa.Array, last: pa.Array) -> pa.Array:
    low, high = max(0, first[0].as_py()) if len(first) else 0, last[0].as_py() if len(last) else 0
    bands: dict[int, list] = {}
    for own, rows, cost in costs_by_batch(pixels, width, most[0].as_py() if len(most) else 0):
        band = cost[:, low : high + 1]
        if band.shape[1]:
            bands.setdefault(band.shape[1], []).append((own, rows, band.copy()))
    found: list = [None] * len(pixels)
    for parts in bands.values():
        own, rows, lines = (np.concatenate(a) for a in zip(*parts))
        path, total = walked(lines, rows)
        for p, way, t in zip(own.tolist(), np.split(path + low, np.cumsum(rows)[:-1]), total.tolist()):
            found[p] = (way, t)
    sizes = np.array([0 if f is None else len(f[0]) for f in found], np.int64)
    flat = np.concatenate([np.zeros(0, np.int64), *[f[0] for f in found if f is not None]])
    none = np.array([f is None for f in found], bool)
    path = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(sizes)]), pa.int32()), pa.array(flat, pa.int32()))
    split = pa.array([None if f is None else int(np.partition(f[0], len(f[0]) // 2)[len(f[0]) // 2]) for f in found], pa.int32())
    return pa.StructArray.from_arrays([path, split, pa.array([f and f[1] for f in found], pa.int64())], ["path", "split_x", "total"], mask=pa.array(none))


def page_paths(pages: DataFrame, most: int, first: int, last: int) -> DataFrame:
    """``paths`` of packed pages of one channel (page_id, width, pixels), ink up to the level ``most``."""
    found = pages.select("page_id", path_of_pixels("pixels", "width", F.lit(most), F.lit(first), F.lit(last)).alias("f")).where("f is not null")
    return found.select("page_id", F.lit(0).alias("top"), "f.path", "f.split_x", "f.total")
