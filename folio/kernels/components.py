"""Connected components of dark pixels (eight neighbours) of packed gray pages, with box and area."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

COMPONENT = "page_id bigint, label bigint, area bigint, left_x bigint, top bigint, width bigint, height bigint"


def labelled(mask: np.ndarray) -> np.ndarray:
    """Labels of a boolean raster: the least row-major index of each component, -1 outside.

    Runs of pixels are joined with those that they touch in the row below, so that the work is that of the runs, whatever way a component winds.
    """
    h, w = mask.shape
    out = np.full((h, w), -1, np.int64)
    wide = np.zeros((h, w + 1), np.int8)  # a column of ground ends each row
    wide[:, :w] = mask
    turns = np.flatnonzero(np.diff(wide.ravel(), prepend=0))
    first, end = turns[::2], turns[1::2]
    if not len(first):
        return out
    low, high = np.searchsorted(end, first + w + 1, "left"), np.searchsorted(first, end + w + 1, "right")
    n = np.maximum(high - low, 0)
    above = np.repeat(np.arange(len(first)), n)
    below = np.arange(len(above)) - np.repeat(np.cumsum(n) - n - low, n)
    root = list(range(len(first)))
    for a, b in zip(above.tolist(), below.tolist()):
        while root[a] != a:
            root[a] = a = root[root[a]]
        while root[b] != b:
            root[b] = b = root[root[b]]
        if a < b:
            root[b] = a
        else:
            root[a] = b
    for i, r in enumerate(root):  # a root comes before what hangs on it
        root[i] = root[r]
    of = np.array(root)
    out[mask] = np.repeat((first - first // (w + 1))[of], end - first)
    return out


def boxes(page_id: int, label: np.ndarray) -> list[tuple]:
    y, x = np.nonzero(label >= 0)
    if not len(y):
        return []
    names, at = np.unique(label[y, x], return_inverse=True)
    n = len(names)
    low = [np.full(n, 2**31) for _ in range(2)]
    high = [np.full(n, -1) for _ in range(2)]
    for k, c in enumerate((x, y)):
        np.minimum.at(low[k], at, c)
        np.maximum.at(high[k], at, c)
    area = np.bincount(at)
    return [(page_id, int(names[i]), int(area[i]), int(low[0][i]), int(low[1][i]), int(high[0][i] - low[0][i] + 1), int(high[1][i] - low[1][i] + 1)) for i in range(n)]


def components(pages: DataFrame, darkest: int = 0, below: int = 128) -> DataFrame:
    """A row for each component of pixels with ``darkest`` <= v < ``below``. Pages of other than one channel, or without pixels, have none."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = [c.split()[0] for c in COMPONENT.split(", ")]
        for b in batches:
            rows: list[tuple] = []
            for page, w, h, channels, pixels in zip(b.page_id, b.width, b.height, b.channels, b.pixels):
                if channels == 1 and pixels:
                    v = np.frombuffer(pixels, np.uint8).reshape(h, w)
                    rows += boxes(page, labelled((v >= darkest) & (v < below)))
            yield pd.DataFrame(rows, columns=names)

    return pages.select("page_id", "width", "height", "channels", "pixels").mapInPandas(run, COMPONENT)
