"""What page kernels are made of: windows, morphology, edges, lines, shapes, rotation and repair of one raster in NumPy.

Rasters are uint8, (h, w) or (h, w, channels). Windows are cut off at the edges unless said otherwise. Costs are linear in the pixels
(morphology: times the log of the radius), so a page needs memory of a few times its size, and nothing is shuffled.
"""

from __future__ import annotations

from math import ceil, cos, radians, sin

import numpy as np

from folio.kernels.components import labelled


def gray(v: np.ndarray) -> np.ndarray:
    """One channel of one, three (b, g, r) or four channels; luma in thousandths, half to even."""
    if v.ndim == 2:
        return v
    if v.shape[2] == 1:
        return v[:, :, 0]
    if v.shape[2] not in (3, 4):
        raise ValueError(f"pages have 1, 3 or 4 channels, not {v.shape[2]}")
    b, g, r = (v[:, :, c].astype(np.int64) for c in range(3))
    t = 299 * r + 587 * g + 114 * b
    low, rest = t // 1000, t % 1000
    return (low + ((rest > 500) | ((rest == 500) & (low % 2 == 1)))).astype(np.uint8)


def saturate(x: np.ndarray) -> np.ndarray:
    return np.clip(np.rint(x), 0, 255).astype(np.uint8)


def box(v: np.ndarray, r: int) -> tuple[np.ndarray, np.ndarray]:
    """Sum and number of the (2r + 1)-square around each pixel."""
    h, w = v.shape
    total = np.zeros((h + 1, w + 1), np.int64 if v.dtype.kind in "ui" else np.float64)
    total[1:, 1:] = v.cumsum(0, dtype=total.dtype).cumsum(1)
    t, b = np.maximum(np.arange(h) - r, 0), np.minimum(np.arange(h) + r + 1, h)
    x, z = np.maximum(np.arange(w) - r, 0), np.minimum(np.arange(w) + r + 1, w)
    return total[b][:, z] - total[t][:, z] - total[b][:, x] + total[t][:, x], np.outer(b - t, z - x)


def weighted(v: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """Both axes convolved with symmetric weights, edges repeated; doubles."""
    r, out = len(weights) // 2, v.astype(np.float64)
    for axis in (0, 1):
        wide = np.pad(out, [(r, r) if k == axis else (0, 0) for k in range(2)], mode="edge")
        n = v.shape[axis]
        out = sum(wk * (wide[k : k + n] if axis == 0 else wide[:, k : k + n]) for k, wk in enumerate(weights))
    return out


def gaussian(v: np.ndarray, size: int = 0, sigma: float = 0.0) -> np.ndarray:
    """By an odd size, or by the deviation alone (three of them to either side)."""
    size = size or 2 * ceil(3 * sigma) + 1
    sigma = sigma or 0.3 * ((size - 1) * 0.5 - 1) + 0.8
    x = np.arange(size) - size // 2
    weights = np.exp(-(x * x) / (2 * sigma * sigma))
    return weighted(v, weights / weights.sum())


def median(v: np.ndarray, r: int = 1) -> np.ndarray:
    """Of the (2r + 1)-square, edges repeated."""
    wide = np.pad(v, r, mode="edge")
    h, w = v.shape
    return np.median(np.stack([wide[dy : dy + h, dx : dx + w] for dy in range(2 * r + 1) for dx in range(2 * r + 1)]), axis=0).astype(v.dtype)


def extreme(v: np.ndarray, r: int, axis: int, most: bool) -> np.ndarray:
    """Greatest or least of 2r + 1 neighbours along an axis, by windows that double."""
    if r < 1:
        return v
    pick, edge = (np.maximum, 0) if most else (np.minimum, 255)
    wide = np.pad(v, [(r, r) if k == axis else (0, 0) for k in range(2)], constant_values=edge)
    n, span, width = v.shape[axis], 1, 2 * r + 1
    cut = lambda x, a, b: x[a:b] if axis == 0 else x[:, a:b]
    while span * 2 <= width:
        m = wide.shape[axis]
        wide = pick(cut(wide, 0, m - span), cut(wide, span, m))
        span *= 2
    return pick(cut(wide, 0, n), cut(wide, width - span, width - span + n))


def grown(v: np.ndarray, rx: int = 1, ry: int | None = None) -> np.ndarray:
    return extreme(extreme(v, rx, 1, True), rx if ry is None else ry, 0, True)


def shrunk(v: np.ndarray, rx: int = 1, ry: int | None = None) -> np.ndarray:
    return extreme(extreme(v, rx, 1, False), rx if ry is None else ry, 0, False)


def elliptic(v: np.ndarray, r: int, most: bool) -> np.ndarray:
    """Greatest or least within a disc of radius ``r``."""
    pick, edge = (np.maximum, 0) if most else (np.minimum, 255)
    out = None
    for dy in range(-r, r + 1):
        reach = int(np.sqrt(r * r - dy * dy) + 0.5)
        row = np.pad(extreme(v, reach, 1, most), ((r, r), (0, 0)), constant_values=edge)[r + dy : r + dy + v.shape[0]]
        out = row if out is None else pick(out, row)
    return out


def otsu(v: np.ndarray) -> int:
    """The level that parts dark from light best; the lowest of equals."""
    n = np.bincount(v.ravel(), minlength=256).astype(np.float64)
    below, mass = n.cumsum(), (n * np.arange(256)).cumsum()
    above = below[-1] - below
    with np.errstate(all="ignore"):
        between = below * above * (mass / below - (mass[-1] - mass) / above) ** 2
    return int(np.nan_to_num(between).argmax())


def slopes(v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    p = np.pad(v.astype(np.int32), 1, mode="edge")
    gx = (p[:-2, 2:] + 2 * p[1:-1, 2:] + p[2:, 2:]) - (p[:-2, :-2] + 2 * p[1:-1, :-2] + p[2:, :-2])
    gy = (p[2:, :-2] + 2 * p[2:, 1:-1] + p[2:, 2:]) - (p[:-2, :-2] + 2 * p[:-2, 1:-1] + p[:-2, 2:])
    return gx, gy


def edges(v: np.ndarray, low: int = 50, high: int = 150) -> np.ndarray:
    """Thin edges: ridges of the slope of ``low`` or more that hang together with one of ``high``."""
    gx, gy = slopes(v)
    g = np.abs(gx) + np.abs(gy)
    p = np.pad(g, 1)
    h, w = v.shape
    at = lambda dy, dx: p[1 + dy : 1 + dy + h, 1 + dx : 1 + dx + w]
    flat, steep = np.abs(gy) * 1000 < np.abs(gx) * 414, np.abs(gx) * 1000 < np.abs(gy) * 414
    same = (gx >= 0) == (gy >= 0)
    before = np.where(flat, at(0, -1), np.where(steep, at(-1, 0), np.where(same, at(-1, -1), at(-1, 1))))
    after = np.where(flat, at(0, 1), np.where(steep, at(1, 0), np.where(same, at(1, 1), at(1, -1))))
    ridge = (g >= low) & (g > before) & (g >= after)
    label = labelled(ridge)
    return ridge & np.isin(label, np.unique(label[ridge & (g >= high)]))


def hull(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Corners of the convex hull, counted round; points on its sides are left out."""
    points = np.unique(np.stack([x, y], 1), axis=0).astype(np.int64)
    if len(points) < 3:
        return points

    def half(line):
        out: list = []
        for p in line:
            while len(out) > 1 and (out[-1][0] - out[-2][0]) * (p[1] - out[-2][1]) - (out[-1][1] - out[-2][1]) * (p[0] - out[-2][0]) <= 0:
                out.pop()
            out.append(p)
        return out

    # only the ends of each row can be corners
    return np.array(half(points)[:-1] + half(points[::-1])[:-1])


def rim(mask: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First and last pixel of each row of a mask (all its hull needs)."""
    rows = np.flatnonzero(mask.any(1))
    first, last = mask[rows].argmax(1), mask.shape[1] - 1 - mask[rows][:, ::-1].argmax(1)
    return np.concatenate([first, last]), np.concatenate([rows, rows])


def area(corners: np.ndarray) -> float:
    if len(corners) < 3:
        return 0.0
    x, y = corners[:, 0].astype(float), corners[:, 1].astype(float)
    return abs(float(x @ np.roll(y, -1) - y @ np.roll(x, -1))) / 2


def least_rect(corners: np.ndarray) -> tuple[float, float, float, np.ndarray]:
    """(width, height, angle in degrees of the width, four corners) of the smallest rectangle round a hull; a side of it lies on a side of the hull."""
    if len(corners) < 3:
        d = corners[-1] - corners[0]
        return float(np.hypot(*d)), 0.0, float(np.degrees(np.arctan2(d[1], d[0]))), np.array([corners[0], corners[-1]] * 2, float)
    side = np.roll(corners, -1, 0) - corners
    turn = np.arctan2(side[:, 1], side[:, 0])
    u = np.stack([np.cos(turn), np.sin(turn)], 1)
    n = np.stack([-u[:, 1], u[:, 0]], 1)
    along, across = corners @ u.T, corners @ n.T
    w, h = np.ptp(along, axis=0), np.ptp(across, axis=0)
    k = int((w * h).argmin())
    ends = [(along[:, k].min(), across[:, k].min()), (along[:, k].max(), across[:, k].min()), (along[:, k].max(), across[:, k].max()), (along[:, k].min(), across[:, k].max())]
    return float(w[k]), float(h[k]), float(np.degrees(turn[k])), np.array([a * u[k] + c * n[k] for a, c in ends])


def distance(mask: np.ndarray, most: int) -> np.ndarray:
    """Euclidean distance of each pixel of a mask to the nearest outside it, ``most`` at the utmost; the page's edge is outside."""
    h, w = mask.shape
    down = np.zeros((h, w), np.int64)
    run = np.zeros(w, np.int64)
    for order in (range(h), range(h - 1, -1, -1)):
        run = np.zeros(w, np.int64)
        for y in order:
            run = np.where(mask[y], run + 1, 0)
            down[y] = run if order.step > 0 else np.minimum(down[y], run)
    far = np.minimum(down, most) ** 2
    wide = np.pad(far, ((0, 0), (most, most)))
    out = far
    for k in range(1, most + 1):
        out = np.minimum(out, np.minimum(wide[:, most - k : most - k + w], wide[:, most + k : most + k + w]) + k * k)
    return np.sqrt(out)


def turned(v: np.ndarray, degrees: float, fill: int = 255) -> np.ndarray:
    """Turned counter-clockwise about the centre on a canvas that holds all of it, bilinear in fixed point (exact): sines in 2**16, shares in 2**8."""
    h, w = v.shape[:2]
    c, s = round(cos(radians(degrees)) * 65536), round(sin(radians(degrees)) * 65536)
    to_w, to_h = (abs(c) * w + abs(s) * h + 32768) // 65536, (abs(s) * w + abs(c) * h + 32768) // 65536
    x, y = 2 * np.arange(to_w) + 1 - to_w, (2 * np.arange(to_h) + 1 - to_h)[:, None]
    u = x * c - y * s + ((w - 1) << 16)
    t = x * s + y * c + ((h - 1) << 16)
    left, top = u >> 17, t >> 17
    fx, fy = (u >> 9) & 255, (t >> 9) & 255
    wide = np.pad(v, [(1, 1), (1, 1)] + [(0, 0)] * (v.ndim - 2), constant_values=fill).astype(np.int64)
    at = lambda dy, dx: wide[np.clip(top + dy + 1, 0, h + 1), np.clip(left + dx + 1, 0, w + 1)]
    if v.ndim == 3:
        fx, fy = fx[:, :, None], fy[:, :, None]
    upper, lower = at(0, 0) * (256 - fx) + at(0, 1) * fx, at(1, 0) * (256 - fx) + at(1, 1) * fx
    return ((upper * (256 - fy) + lower * fy + 32768) >> 16).astype(np.uint8)


def warped(v: np.ndarray, corners: np.ndarray, to_w: int, to_h: int) -> np.ndarray:
    """The quadrangle (top left, top right, bottom right, bottom left) as an upright page, bilinear."""
    goal = np.array([(0, 0), (to_w - 1, 0), (to_w - 1, to_h - 1), (0, to_h - 1)], float)
    rows, right = [], []
    for (x, y), (u, t) in zip(goal, corners):
        rows += [[x, y, 1, 0, 0, 0, -u * x, -u * y], [0, 0, 0, x, y, 1, -t * x, -t * y]]
        right += [u, t]
    m = np.append(np.linalg.solve(np.array(rows), np.array(right)), 1.0).reshape(3, 3)
    x, y = np.meshgrid(np.arange(to_w), np.arange(to_h))
    under = m[2, 0] * x + m[2, 1] * y + 1
    u, t = (m[0, 0] * x + m[0, 1] * y + m[0, 2]) / under, (m[1, 0] * x + m[1, 1] * y + m[1, 2]) / under
    u, t = np.clip(u, 0, v.shape[1] - 1), np.clip(t, 0, v.shape[0] - 1)
    left, top = np.minimum(u.astype(int), max(0, v.shape[1] - 2)), np.minimum(t.astype(int), max(0, v.shape[0] - 2))
    fx, fy = u - left, t - top
    if v.ndim == 3:
        fx, fy = fx[:, :, None], fy[:, :, None]
    r, b = np.minimum(left + 1, v.shape[1] - 1), np.minimum(top + 1, v.shape[0] - 1)
    return saturate((v[top, left] * (1 - fx) + v[top, r] * fx) * (1 - fy) + (v[b, left] * (1 - fx) + v[b, r] * fx) * fy)


def repaired(v: np.ndarray, mask: np.ndarray, rounds: int = 20) -> np.ndarray:
    """The masked pixels filled from their surroundings: ring by ring with the mean of what is known, then evened out among themselves.

    A plain diffusion; nothing is claimed of equality with marching or flow methods. A wholly masked page stays.
    """
    if not mask.any() or mask.all():
        return v
    out, known = v.astype(np.float64), ~mask

    def near(x: np.ndarray) -> np.ndarray:
        p = np.pad(x, [(1, 1), (1, 1)] + [(0, 0)] * (x.ndim - 2))
        h, w = x.shape[:2]
        return sum(p[dy : dy + h, dx : dx + w] for dy in range(3) for dx in range(3) if (dy, dx) != (1, 1))

    lift = (lambda m: m[:, :, None]) if v.ndim == 3 else (lambda m: m)
    while not known.all():
        count = near(known.astype(np.float64))
        ring = ~known & (count > 0)
        total = near(np.where(lift(known), out, 0.0))
        out = np.where(lift(ring), total / lift(np.maximum(count, 1)), out)
        known = known | ring
    inside = near(np.ones(mask.shape))
    for _ in range(rounds):
        out = np.where(lift(mask), near(out) / lift(inside), out)
    return np.where(lift(mask), saturate(out), v)


def to_lab(v: np.ndarray) -> np.ndarray:
    """b, g, r as L (0..255), a, b of CIE Lab under D65; doubles."""
    c = v[:, :, 2::-1][:, :, :3] / 255.0
    c = np.where(c <= 0.04045, c / 12.92, ((c + 0.055) / 1.055) ** 2.4)
    xyz = c @ np.array([[0.412453, 0.212671, 0.019334], [0.357580, 0.715160, 0.119193], [0.180423, 0.072169, 0.950227]]) / np.array([0.950456, 1.0, 1.088754])
    f = np.where(xyz > 0.008856, np.cbrt(xyz), 7.787 * xyz + 16 / 116)
    light = np.where(xyz[:, :, 1] > 0.008856, 116 * f[:, :, 1] - 16, 903.3 * xyz[:, :, 1])
    return np.stack([light * 2.55, 500 * (f[:, :, 0] - f[:, :, 1]), 200 * (f[:, :, 1] - f[:, :, 2])], 2)


def from_lab(lab: np.ndarray) -> np.ndarray:
    light = lab[:, :, 0] / 2.55
    y = np.where(light > 7.9996, ((light + 16) / 116) ** 3, light / 903.3)
    fy = np.where(y > 0.008856, np.cbrt(y), 7.787 * y + 16 / 116)
    back = lambda f: np.where(f > 0.206893, f**3, (f - 16 / 116) / 7.787)
    xyz = np.stack([back(fy + lab[:, :, 1] / 500) * 0.950456, y, back(fy - lab[:, :, 2] / 200) * 1.088754], 2)
    c = xyz @ np.array([[3.240479, -0.969256, 0.055648], [-1.537150, 1.875991, -0.204043], [-0.498535, 0.041556, 1.057311]])
    c = np.clip(c, 0, 1)
    c = np.where(c <= 0.0031308, 12.92 * c, 1.055 * c ** (1 / 2.4) - 0.055)
    return saturate(c[:, :, ::-1] * 255)


def equalised(v: np.ndarray, clip: float, grid: int) -> np.ndarray:
    """Local equalisation: clipped histograms of grid tiles, their curves blended between tile centres; flat without midtones."""
    if not ((v > 0) & (v < 255)).any():
        return v
    h, w = v.shape
    tall, wide = max(1, -(-h // grid)), max(1, -(-w // grid))
    padded = np.pad(v, ((0, tall * grid - h), (0, wide * grid - w)), mode="symmetric" if tall * grid - h <= h and wide * grid - w <= w else "edge")
    tiles = padded.reshape(grid, tall, grid, wide).swapaxes(1, 2).reshape(grid * grid, -1)
    n = np.stack([np.bincount(t, minlength=256) for t in tiles])
    if clip > 0:
        most = max(1, int(clip * tall * wide / 256))
        over = np.maximum(n - most, 0).sum(1)
        n = np.minimum(n, most) + (over // 256)[:, None] + (np.arange(256) * 256 < (over % 256 * 256)[:, None])
    curve = saturate(n.cumsum(1) * (255.0 / (tall * wide))).reshape(grid, grid, 256).astype(np.float64)
    ty, tx = (np.arange(h) + 0.5) / tall - 0.5, (np.arange(w) + 0.5) / wide - 0.5
    y0, x0 = np.floor(ty).astype(int), np.floor(tx).astype(int)
    fy, fx = (ty - y0)[:, None], (tx - x0)[None, :]
    at = lambda dy, dx: curve[np.clip(y0 + dy, 0, grid - 1)[:, None], np.clip(x0 + dx, 0, grid - 1)[None, :], v]
    return saturate((at(0, 0) * (1 - fx) + at(0, 1) * fx) * (1 - fy) + (at(1, 0) * (1 - fx) + at(1, 1) * fx) * fy)


def tiles_equalised(v: np.ndarray, grid: int, clip: float) -> np.ndarray:
    """:func:`folio.operators.areas.local_equalised` of one gray page: the same whole numbers, so the same levels."""
    if not ((v > 0) & (v < 255)).any():
        return v
    h, w = v.shape
    tw, th = -(-w // grid), -(-h // grid)
    across, down = -(-w // tw), -(-h // th)
    y, x = np.arange(h), np.arange(w)
    tile = (y // th)[:, None] * across + x // tw
    n = np.bincount((tile * 256 + v).ravel(), minlength=across * down * 256).reshape(-1, 256)
    area = n.sum(1, keepdims=True)
    limit = np.maximum(1, np.floor(area * (clip / 256))).astype(np.int64)
    over = np.maximum(n - limit, 0).sum(1, keepdims=True)
    table = saturate((np.minimum(n, limit).cumsum(1) * 256 + over * np.arange(1, 257)) * 255 / (area * 256.0)).astype(np.int64)
    # weights in halves of a tile, so that they are whole
    x0, y0 = (2 * x - tw) // (2 * tw), (2 * y - th) // (2 * th)
    wx, wy = 2 * x - tw - x0 * 2 * tw, 2 * y - th - y0 * 2 * th
    total = np.zeros((h, w), np.int64)
    for j in (0, 1):
        for i in (0, 1):
            of = np.clip(y0 + j, 0, down - 1)[:, None] * across + np.clip(x0 + i, 0, across - 1)
            total += (wy if j else 2 * th - wy)[:, None] * (wx if i else 2 * tw - wx) * table[of, v]
    return saturate(total / float(4 * tw * th))


def reduced(v: np.ndarray, width: int) -> np.ndarray:
    """A page brought down to a width by the mean of the area that falls on each pixel; pages that are not wider stay."""
    h, w = v.shape[:2]
    if not 0 < width < w:
        return v
    height = max(1, round(h * width / w))
    out = v.astype(np.float64)
    for axis, n, m in ((0, h, height), (1, w, width)):
        total = np.concatenate([np.zeros_like(out.take([0], axis)), out.cumsum(axis)], axis)
        at = np.arange(m + 1) * n / m
        low = np.minimum(at.astype(int), n - 1)
        share = (at - low).reshape([-1 if k == axis else 1 for k in range(out.ndim)])
        edge = total.take(low, axis) + share * (total.take(low + 1, axis) - total.take(low, axis))
        out = np.diff(edge, axis=axis) * (m / n)
    return saturate(np.round(out, 6))
