"""What is done to packed gray pages by masks: painting components, filling holes, selective inversion, crops."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folio.kernels.components import labelled
from folio.rasters import PAGE


def each_page(pages: DataFrame, change: Callable[[np.ndarray, pd.Series], np.ndarray], *extra: str) -> DataFrame:
    """``change`` on each one-channel page (raster, row); others pass as they are. A page that fails ends the job with its id: pixels that were not changed
    would look like a result. :mod:`folio.plans.engine` goes on and keeps the errors by page."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for row in b.itertuples(index=False):
                w, h, pixels = row.width, row.height, row.pixels
                if row.channels == 1 and pixels:
                    try:
                        new = np.ascontiguousarray(change(np.frombuffer(pixels, np.uint8).reshape(h, w), row), np.uint8)
                        (h, w), pixels = new.shape, new.tobytes()
                    except Exception as e:
                        raise ValueError(f"page {row.page_id}, {w} x {h}, {len(row.pixels)} bytes: {type(e).__name__}: {e}") from e
                out.append((row.page_id, w, h, row.channels, pixels))
            yield pd.DataFrame(out, columns=["page_id", "width", "height", "channels", "pixels"])

    return pages.select("page_id", "width", "height", "channels", "pixels", *extra).mapInPandas(run, PAGE)


def paint(pages: DataFrame, removed: DataFrame, fill: int = 255, below: int = 128) -> DataFrame:
    """Components named in ``removed`` (page_id, label) get one colour. Labels of a page are as many as it has components."""
    labels = removed.groupBy("page_id").agg(F.collect_set("label").alias("gone"))

    def change(v: np.ndarray, row) -> np.ndarray:
        if row.gone is None or not len(row.gone):
            return v
        return np.where(np.isin(labelled(v < below), np.asarray(row.gone)), fill, v)

    return each_page(pages.join(labels, "page_id", "left"), change, "gone")


def without_holes(mask: np.ndarray) -> np.ndarray:
    """A mask with what no path along rows and columns joins to the outside."""
    outside = np.pad(~mask, 1, constant_values=True)
    open_ = np.zeros_like(outside)
    open_[0] = True
    while True:
        grown = open_.copy()
        grown[1:] |= open_[:-1]
        grown[:-1] |= open_[1:]
        grown[:, 1:] |= open_[:, :-1]
        grown[:, :-1] |= open_[:, 1:]
        grown &= outside
        if np.array_equal(grown, open_):
            return ~open_[1:-1, 1:-1]
        open_ = grown


def invert_dark(pages: DataFrame, method: str = "mask", single: bool = False, below: int = 110, least: float = 0.02, trim: float = 0.65) -> DataFrame:
    """Inverts dark areas of at least ``least`` of the page: by their filled ``mask``, by their ``rect`` (trimmed to rows and columns of which ``trim`` of the densest is dark), or both (``hybrid``). ``single``: the largest only."""

    def change(v: np.ndarray, row) -> np.ndarray:
        label = labelled(v < below)
        names, counts = np.unique(label[label >= 0], return_counts=True)
        big = names[counts >= least * v.size]
        if single and len(big):
            big = big[[np.argmax(counts[np.isin(names, big)])]]
        chosen = np.zeros(v.shape, bool)
        for name in big:
            own = label == name
            area = without_holes(own)
            if method != "mask":
                dense = [own.sum(axis) for axis in (1, 0)]
                (t, b), (l, r) = ((np.flatnonzero(d >= d.max() * trim)[[0, -1]]) for d in dense)
                rect = np.zeros(v.shape, bool)
                rect[t : b + 1, l : r + 1] = True
                area = rect if method == "rect" else area & rect
            chosen |= area
        return np.where(chosen, 255 - v.astype(np.int16), v)

    return each_page(pages, change)


def crop_to(pages: DataFrame, boxes: DataFrame) -> DataFrame:
    """Pages cut to their box (page_id, x, y, w, h); without one, or an empty one, they stay whole."""

    def change(v: np.ndarray, row) -> np.ndarray:
        if pd.isna(row.x):
            return v
        cut = v[int(row.y) : int(row.y + row.h), int(row.x) : int(row.x + row.w)]
        return cut if cut.size else v

    return each_page(pages.join(boxes.select("page_id", "x", "y", "w", "h"), "page_id", "left"), change, "x", "y", "w", "h")


def kept_boxes(x: np.ndarray, y: np.ndarray, w: np.ndarray, h: np.ndarray, most: float) -> np.ndarray:
    """Which of boxes in their order are kept: a box goes if it overlaps a kept one by more than ``most``."""
    size, left, out = w * h, np.arange(len(x)), np.zeros(len(x), bool)
    while len(left):
        top, left = left[0], left[1:]
        out[top] = True
        wide = np.minimum(x[left] + w[left], x[top] + w[top]) - np.maximum(x[left], x[top])
        high = np.minimum(y[left] + h[left], y[top] + h[top]) - np.maximum(y[left], y[top])
        inter = np.maximum(wide, 0) * np.maximum(high, 0)
        left = left[inter <= most * (size[left] + size[top] - inter)]
    return out


def suppressed(boxes: DataFrame, most: float = 0.4) -> DataFrame:
    """Boxes left by suppression: the larger first, then the lower box_id; what overlaps a kept one by more than ``most`` goes.

    One exchange by page; a task reads its pages one after another and holds the boxes of one page.
    """
    names = ["page_id", "box_id", "x", "y", "w", "h"]
    schema = pa.schema([(c, pa.int64()) for c in names])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []  # the rows of the page that may go on
        for b in batches:
            rows = np.stack([b[c].to_numpy(zero_copy_only=False) for c in names], 1)
            edges = np.flatnonzero(np.diff(rows[:, 0])) + 1
            parts = np.split(rows, edges)
            if held and len(rows) and held[-1][-1, 0] == rows[0, 0]:
                parts[0] = np.concatenate([*held, parts[0]])
            elif held:
                parts.insert(0, np.concatenate(held))
            held = [parts.pop()] if len(rows) else held
            if parts:
                yield told(parts)
        if held:
            yield told([np.concatenate(held)])

    def told(pages: list[np.ndarray]) -> pa.RecordBatch:
        left = np.concatenate([p[kept_boxes(*p[:, 2:].T, most)] for p in pages if len(p)] or [np.empty((0, 6), np.int64)])
        return pa.RecordBatch.from_arrays([pa.array(c) for c in left.T], schema=schema)

    rows = boxes.select(*[F.col(c).cast("bigint").alias(c) for c in names]).where("page_id is not null")
    order = rows.repartition("page_id").sortWithinPartitions("page_id", (F.col("w") * F.col("h")).desc(), "box_id")
    return order.mapInArrow(run, ", ".join(f"{c} bigint" for c in names))


def seams(pages: DataFrame, band: tuple[float, float] = (0.4, 0.6)) -> DataFrame:
    """Cheapest seam from top to bottom within the central band: darkness in tenths of a level, steps of one column at most, ties to the straight way, then the left.

    Returns (page_id, split_x: the upper median of the seam, cost: its whole sum, exact).
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for row in b.itertuples(index=False):
                if row.channels != 1 or not row.pixels:
                    continue
                v = 255 - np.frombuffer(row.pixels, np.uint8).reshape(row.height, row.width).astype(np.int64)
                lo, hi = int(row.width * band[0]), int(row.width * band[1])
                cost, back = v[0, lo : hi + 1].copy(), []
                for line in v[1:, lo : hi + 1]:
                    edge = np.pad(cost, 1, constant_values=np.iinfo(np.int64).max // 2)
                    three = np.stack([edge[1:-1], edge[:-2], edge[2:]])
                    step = three.argmin(0)
                    back.append(np.array([0, -1, 1])[step])
                    cost = three.min(0) + line
                at = int(cost.argmin())
                total, path = int(cost[at]), [at]
                for step in reversed(back):
                    at += int(step[at])
                    path.append(at)
                out.append((row.page_id, lo + sorted(path)[len(path) // 2], total))
            yield pd.DataFrame(out, columns=["page_id", "split_x", "cost"])

    return pages.select("page_id", "width", "height", "channels", "pixels").mapInPandas(run, "page_id bigint, split_x bigint, cost bigint")


def merged_boxes(rows: list[tuple[int, int, int, int]], gap: int, overlap: float, centre: float) -> list[tuple[int, int, int, int]]:
    """(x, y, w, h) boxes joined into their common box while two are nearer than ``gap``, overlap by ``overlap`` of their union, or have centres
    within ``centre``; the result, in order, doesn't depend on the order they came in.

    In each round all boxes that hang together are joined at once, so rounds are few; a round compares boxes within sorted windows.
    """
    left = sorted(set(rows))
    while True:
        up = list(range(len(left)))

        def root(i: int) -> int:
            while up[i] != i:
                up[i] = i = up[up[i]]
            return i

        widest = max((w for _, _, w, _ in left), default=0)
        for i, (x, y, w, h) in enumerate(left):
            for j in range(i + 1, len(left)):
                x2, y2, w2, h2 = left[j]
                if x2 - x > max(widest + gap, centre + widest):
                    break
                dx, dy = max(0, x2 - x - w, x - x2 - w2), max(0, y2 - y - h, y - y2 - h2)
                inter = max(0, min(x + w, x2 + w2) - max(x, x2)) * max(0, min(y + h, y2 + h2) - max(y, y2))
                far = np.hypot(x + w / 2 - x2 - w2 / 2, y + h / 2 - y2 - h2 / 2)
                if (dx <= gap and dy <= gap) or inter > overlap * (w * h + w2 * h2 - inter) or far <= centre:
                    a, b = root(i), root(j)
                    up[max(a, b)] = min(a, b)
        groups: dict[int, list] = {}
        for i, box in enumerate(left):
            groups.setdefault(root(i), []).append(box)
        new = sorted({(min(b[0] for b in g), min(b[1] for b in g), max(b[0] + b[2] for b in g) - min(b[0] for b in g), max(b[1] + b[3] for b in g) - min(b[1] for b in g)) for g in groups.values()})
        if new == left:
            return left
        left = new
