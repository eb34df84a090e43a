"""The operations on one page in NumPy: binarization, deskew, punch holes, splits, borders, colour, specks and lines.

Each takes a raster (h, w) or (h, w, channels) and plain numbers, and returns a raster, or raises ValueError for what it can't be
asked. Formulas are our own exact or documented ones; no equality of bits with a native image library is claimed.
"""

from __future__ import annotations

from math import ceil, cos, hypot, log1p, radians, sin

import numpy as np

from folio.kernels import vision
from folio.kernels.components import boxes, labelled


def checked(v: np.ndarray | None) -> np.ndarray:
    if v is None:
        raise ValueError("no page")
    if v.size == 0:
        raise ValueError("the page is empty")
    if v.dtype != np.uint8:
        raise ValueError(f"pages are of bytes, not of {v.dtype}")
    return v


def colour(v: np.ndarray) -> np.ndarray:
    """Three channels b, g, r of one, three or four."""
    v = checked(v)
    if v.ndim == 2 or v.shape[2] == 1:
        return np.repeat(vision.gray(v)[:, :, None], 3, 2)
    if v.shape[2] not in (3, 4):
        raise ValueError(f"pages have 1, 3 or 4 channels, not {v.shape[2]}")
    return v[:, :, :3]


# ---- binarization
def odd(n: int, least: int = 3) -> int:
    return max(least, n + (n % 2 == 0))


def local_mean(v: np.ndarray, block: int, smooth: bool) -> np.ndarray:
    if smooth:
        return vision.gaussian(v, block)
    total, n = vision.box(v, block // 2)
    return total / n


def threshold(v: np.ndarray, t: int) -> np.ndarray:
    return np.where(v > t, 255, 0).astype(np.uint8)


def adaptive(v: np.ndarray, block: int = 0, c: float = 14, smooth: bool = False, kernel: int = 0, times: int = 1) -> np.ndarray:
    """White above the mean (or Gaussian mean) around it less ``c``; without a block one of a thirtieth of the shorter side. ``kernel``: opened by an ellipse."""
    block = odd(block if block > 0 else max(3, min(201, min(v.shape) // 30)))
    out = np.where(v > local_mean(v, block, smooth) - c, 255, 0).astype(np.uint8)
    for most in (False, True) if kernel > 1 else ():
        for _ in range(times):
            out = vision.elliptic(out, kernel // 2, most)
    return out


def sauvola(v: np.ndarray, window: int = 25, k: float = 0.3, r: float = 180.0, boost: int = 0, clip: float = 0.0, grid: int = 8, radius: int = 0) -> np.ndarray:
    """``clip``: locally equalised first; ``radius``: opened and closed after."""
    if clip:
        v = vision.equalised(v, clip, grid)
    half = odd(window) // 2
    (s, n), (s2, _) = vision.box(v, half), vision.box(v.astype(np.int64) ** 2, half)
    m = s / n
    deviation = np.sqrt(np.maximum(0.0, s2 / n - m * m))
    out = np.where(v > np.minimum(255.0, m * (1 + k * (deviation / r - 1)) + boost), 255, 0).astype(np.uint8)
    if radius:
        out = vision.grown(vision.shrunk(out, radius), radius)
        out = vision.shrunk(vision.grown(out, radius), radius)
    return out


def majority(v: np.ndarray, t: int = 128, reach: int = 30, dots: int = 0) -> np.ndarray:
    """Black where half or more of thresholds around ``t`` say so; components of up to ``dots`` pixels of the plain threshold are added back."""
    levels = sorted({*range(t - reach, t + reach + 1, 10), t + reach})
    votes = sum((v <= x).astype(np.int16) for x in levels)
    black = votes >= (len(levels) + 1) // 2
    if dots:
        label = labelled(v <= t)
        names, count = np.unique(label[label >= 0], return_counts=True)
        black |= np.isin(label, names[count <= dots])
    return np.where(black, 0, 255).astype(np.uint8)


# ---- levels and colour
def on_lightness(v: np.ndarray, change) -> np.ndarray:
    """``change`` on a gray page, or on the lightness of a colour page."""
    if v.ndim == 2 or v.shape[2] == 1:
        return change(vision.gray(v))
    lab = vision.to_lab(colour(v))
    light = vision.saturate(lab[:, :, 0])
    new = change(light)
    if np.array_equal(new, light):
        return colour(v)
    lab[:, :, 0] = new
    return vision.from_lab(lab)


def levels(v: np.ndarray, black: float = 1.0, white: float = 95.0, gamma: float = 0.85, target: int = 255) -> np.ndarray:
    share = np.bincount(v.ravel(), minlength=256).cumsum() / v.size
    b, w = int(np.argmax(share >= black / 100)), int(np.argmax(share >= white / 100))
    if w <= b:
        b, w = 0, 255
    return vision.saturate(np.clip((np.arange(256.0) - b) / (w - b), 0, 1) ** gamma * target)[v]


def normalised(x: np.ndarray, low: float, high: float, bins: int, robust: bool = True) -> np.ndarray:
    """Stretched to 0..255 between two percentiles of a histogram of ``bins``, or between the extremes; large pages are counted at half size; flat ones are 0."""
    least, most = float(x.min()), float(x.max())
    if not most > least:
        return np.zeros(x.shape, np.uint8)
    a, z = least, most
    if robust:
        some = x[::2, ::2] if max(x.shape) > 900 else x
        n = np.histogram(some, bins, (least, most))[0].cumsum()
        edge = lambda p: least + (most - least) * int(np.argmax(n >= p / 100 * n[-1])) / bins
        a, z = edge(low), edge(high)
        if not z > a:
            a, z = least, most
    return vision.saturate((x - a) * (255.0 / (z - a)))


def retinex(v: np.ndarray, sigma: float = 50, high: float = 1.8, low: float = 0.6, eps: float = 1e-6, mode: str = "LogHighpass", use_light: bool = True, clamp: float = 4.0, low_percent: float = 0.5, high_percent: float = 99.5, bins: int = 2048, robust: bool = True) -> np.ndarray:
    light = vision.saturate(vision.to_lab(v)[:, :, 0]) if use_light and v.ndim == 3 and v.shape[2] >= 3 else vision.gray(v)
    logs = np.log(np.maximum(light / 255.0, eps))
    base = vision.gaussian(logs, sigma=sigma)
    out = high * (logs - base)
    if mode == "ReconstructExp":
        out = np.exp(np.clip(out + low * base, -clamp, clamp))
    return normalised(np.round(out, 9), low_percent, high_percent, bins, robust)


def toned(v: np.ndarray, red: float = 0, green: float = 0, blue: float = 0, hue: float = 0, saturation: float = 0) -> np.ndarray:
    """Channels scaled by percents, then hue turned by degrees and saturation scaled."""
    x = vision.saturate(colour(v) * np.array([1 + blue / 100, 1 + green / 100, 1 + red / 100])).astype(np.float64)
    if hue or saturation:
        top, low = x.max(2), x.min(2)
        span = np.where(top > low, top - low, 1)
        b, g, r = x[:, :, 0], x[:, :, 1], x[:, :, 2]
        deg = np.where(top == low, 0, np.where(top == r, 60 * (g - b) / span, np.where(top == g, 120 + 60 * (b - r) / span, 240 + 60 * (r - g) / span)))
        h, s = (deg + hue) % 360 / 60, np.clip(np.where(top > 0, (top - low) / np.maximum(top, 1), 0) * (1 + saturation / 100), 0, 1)
        x = np.stack([top * (1 - s * np.clip(np.minimum((n + h) % 6, 4 - (n + h) % 6), 0, 1)) for n in (1, 3, 5)], 2)
    return vision.saturate(x)


# ---- ground colours
def ground(v: np.ndarray) -> np.ndarray | int:
    """The colour of the page's frame: the mean of sampled frame pixels, or of the larger of two groups if they differ much."""
    h, w = v.shape[:2]
    d = max(1, min(h, w) // 50)
    frame = np.ones((h, w), bool)
    frame[d : h - d, d : w - d] = False
    some = v[frame].reshape(int(frame.sum()), -1).astype(np.float64)
    some = some[:: max(1, len(some) // 12_000)]
    if some.std(0).mean() >= 10:
        bright = some.mean(1)
        centres = np.stack([some[bright.argmin()], some[bright.argmax()]])
        for _ in range(20):
            own = ((some[:, None] - centres) ** 2).sum(2).argmin(1)
            new = np.stack([some[own == k].mean(0) if (own == k).any() else centres[k] for k in (0, 1)])
            if np.array_equal(new, centres):
                break
            centres = new
        some = centres[[int((own == 1).sum() > (own == 0).sum())]]
    out = vision.saturate(some.mean(0))
    return int(out[0]) if v.ndim == 2 else out


def black_point(v: np.ndarray, shift: float = 0.25, margin: float = 0.1) -> int:
    """A level between the dark and the light mean of the page's middle, nearer to the dark by ``shift``."""
    g = vision.gray(v)
    h, w = g.shape
    y, x = int(h * margin), int(w * margin)
    middle = vision.saturate(vision.weighted(g[y : h - y or h, x : w - x or w], np.array([0.25, 0.5, 0.25])))
    t = vision.otsu(middle)
    dark, light = middle[middle <= t], middle[middle > t]
    if not len(dark) or not len(light):
        return 40
    return int(np.clip(np.rint(dark.mean() + (light.mean() - dark.mean()) * (0.5 - shift)), 1, 250))


# ---- deskew
def ink(v: np.ndarray) -> np.ndarray:
    g = vision.gray(v)
    return g <= vision.otsu(g) if g.min() < g.max() else np.zeros(g.shape, bool)


def profile_score(mask: np.ndarray, degrees: float) -> float:
    """Variance of the ink in the rows of the page turned by ``degrees``; rows by fixed-point sines, so scores are exact."""
    h, w = mask.shape
    c, s = round(cos(radians(degrees)) * 65536), round(sin(radians(degrees)) * 65536)
    rows = max(1, (abs(s) * w + abs(c) * h + 32768) // 65536)
    y, x = np.nonzero(mask)
    at = ((2 * y + 1 - h) * c - (2 * x + 1 - w) * s + rows * 65536) // 131072
    n = np.bincount(np.clip(at, 0, rows - 1), minlength=rows)
    return float((rows * int((n.astype(np.int64) ** 2).sum()) - int(n.sum()) ** 2) / rows**2)


def angle_by_projection(v: np.ndarray, low: float = -15, high: float = 15, coarse: float = 1.0, fine: float = 0.2) -> tuple[float, float]:
    """(degrees to turn by, confidence): the best of a coarse scan, refined around it; of equals the first. The second best is that of another angle."""
    mask = ink(v)
    if not mask.any():
        return float("nan"), 0.0
    seen: dict[float, float] = {}

    def scan(a: float, z: float, step: float) -> None:
        for k in range(int((z - a) / step + 1e-9) + 1):
            angle = round(a + k * step, 6)
            if angle not in seen:
                seen[angle] = profile_score(mask, angle)

    scan(low, high, coarse)
    first = max(seen, key=seen.__getitem__)
    scan(max(low, first - coarse), min(high, first + coarse), fine)
    best = max(seen, key=seen.__getitem__)
    second = max((s for a, s in seen.items() if a != best), default=None)
    sure = 0.15 if second is None else min(1.0, max(0.0, (seen[best] - second) / (abs(seen[best]) + 1e-9) / 0.25))
    return best, sure


def moments(v: np.ndarray) -> tuple[int, float, float, float]:
    y, x = np.nonzero(ink(v))
    if not len(x):
        return 0, 0.0, 0.0, 0.0
    return len(x), float(x.var()), float(y.var()), float((x * y).mean() - x.mean() * y.mean())


def angle_by_axis(v: np.ndarray) -> tuple[float, float]:
    """The main axis of the ink (principal component, or central moments: the same angle), downhill positive."""
    n, xx, yy, xy = moments(v)
    if n < 50:
        return float("nan"), 0.0
    angle = float(np.degrees(np.arctan2(2 * xy, xx - yy) / 2))
    unit = lambda c: min(1.0, max(0.0, c))
    return angle, 0.35 * unit(log1p(n) / log1p(20000)) * (0.5 + 0.5 * unit((25 - abs(angle)) / 25))


def angle_by_lines(v: np.ndarray, low: int = 50, high: int = 150, least_votes: int = 80, length: float = 200, reach: float = 45.0, step: float = 0.25) -> tuple[float, float]:
    """Upper median of the slopes of straight lines: edge pixels vote for (slope, distance), and lines of half the length or more count."""
    g = vision.saturate(vision.weighted(vision.gray(v), np.array([0.25, 0.5, 0.25])))
    y, x = np.nonzero(vision.edges(g, low, high))
    found: list[float] = []
    spread = int(hypot(*g.shape)) + 1
    for k in range(int(2 * reach / step) + 1) if len(x) else ():
        a = -reach + k * step
        rho = np.rint(y * cos(radians(a)) - x * sin(radians(a))).astype(np.int64) + spread
        votes = np.bincount(rho, minlength=2 * spread + 1)
        found += [a] * int((votes >= max(least_votes, length / 2)).sum())
    if not found:
        return float("nan"), 0.0
    found.sort()
    middle = found[len(found) // 2]
    apart = sorted(abs(a - middle) for a in found)[len(found) // 2]
    return middle, min(1.0, len(found) / 20) * max(0.0, 1 - apart / 5)


def page_shape(v: np.ndarray, close: int = 2) -> np.ndarray | None:
    """Hull corners of the largest thing on the page that stands out, or None."""
    g = vision.gray(v)
    mask = np.where(adaptive(g, odd(min(g.shape) // 8), 5) == 0, 255, 0).astype(np.uint8)
    mask = vision.shrunk(vision.grown(mask, close), close) > 0
    label = labelled(mask)
    best, corners = 0.0, None
    for _, name, size, left, top, w, h in boxes(0, label):
        if w * h > best:
            own = label[top : top + h, left : left + w] == name
            shape = vision.hull(*vision.rim(own)) + np.array([left, top])
            if vision.area(shape) > best:
                best, corners = vision.area(shape), shape
    return corners


def angle_by_borders(v: np.ndarray) -> tuple[float, float]:
    corners = page_shape(v)
    if corners is None or vision.area(corners) < 0.2 * v.shape[0] * v.shape[1]:
        return float("nan"), 0.0
    w, h, angle, _ = vision.least_rect(corners)
    angle = normal_angle(angle if w >= h else angle + 90)
    return (float("nan"), 0.0) if abs(angle) < 0.02 else (angle, min(1.0, vision.area(corners) / (v.shape[0] * v.shape[1])))


def normal_angle(a: float) -> float:
    a = (a + 45) % 90 - 45
    a = 45.0 if a == -45 else a
    return 0.0 if abs(a) < 0.005 else a


def signed(v: np.ndarray, a: float) -> float:
    """The angle or its opposite, whichever makes the rows of ink stand out more (small angles stay)."""
    if abs(a) < 0.3:
        return a
    mask = ink(v)
    return a if profile_score(mask, a) >= profile_score(mask, -a) else -a


def agreed(found: list[tuple[float, float]], gap: float = 1.5) -> float:
    """The weighted mean of the cluster of angles (neighbours within ``gap``) with the most members, then the most weight, then the least width."""
    found = sorted(f for f in found if f[0] == f[0])
    if not found:
        return 0.0
    groups = [[found[0]]]
    for f in found[1:]:
        if f[0] - groups[-1][-1][0] <= gap:
            groups[-1].append(f)
        else:
            groups.append([f])
    best = max(groups, key=lambda g: (len(g), sum(w for _, w in g), g[0][0] - g[-1][0]))
    weight = sum(w for _, w in best)
    return sum(a * w for a, w in best) / weight if weight > 0 else sum(a for a, _ in best) / len(best)


def upright(v: np.ndarray, strength: float = 5) -> np.ndarray:
    """Perspective: the page's four corners (ends of x + y and of x - y) become a rectangle; pages without a large shape stay."""
    corners = page_shape(v)
    least = max(0.02, 0.12 - 0.01 * strength)
    if corners is None or len(corners) < 4 or vision.area(corners) < least * v.shape[0] * v.shape[1]:
        return v
    s, d = corners.sum(1), corners[:, 0] - corners[:, 1]
    four = corners[[s.argmin(), d.argmax(), s.argmax(), d.argmin()]].astype(float)
    if len(np.unique(four, axis=0)) < 4:
        return v
    side = lambda a, b: hypot(*(four[a] - four[b]))
    w, h = int(round(max(side(0, 1), side(3, 2)))) + 1, int(round(max(side(0, 3), side(1, 2)))) + 1
    return vision.warped(v, four, w, h) if w > 1 and h > 1 else v


def deskewed(v: np.ndarray, method: str = "Auto", **p) -> np.ndarray:
    """Turned upright on a larger canvas of the frame's colour. Auto agrees on lines and projection with default parameters."""
    lines = {k: p[n] for k, n in (("low", "cannyTresh1"), ("high", "cannyTresh2"), ("least_votes", "houghTreshold"), ("length", "minLineLength")) if n in p}
    scan = {k: p[n] for k, n in (("low", "projMinAngle"), ("high", "projMaxAngle"), ("coarse", "projCoarseStep"), ("fine", "projRefineStep")) if n in p}
    if method == "Perspective":
        return upright(v, p.get("perspectiveStrength", 5))
    if method == "Auto":
        angle = agreed([angle_by_lines(v), angle_by_projection(v)])
    else:
        angle, _ = {"Hough": lambda: angle_by_lines(v, **lines), "Projection": lambda: angle_by_projection(v, **scan), "PCA": lambda: angle_by_axis(v), "Moments": lambda: angle_by_axis(v), "ByBorders": lambda: angle_by_borders(v)}[method]()
    if angle != angle:
        return v
    angle = normal_angle(angle)
    angle = signed(v, angle) if method in ("PCA", "Moments", "ByBorders") else angle
    if angle == 0:
        return v
    return vision.turned(v, angle, ground(v))


# ---- punch holes
def search_mask(h: int, w: int, left: int, right: int, top: int, bottom: int) -> np.ndarray:
    mask = np.zeros((h, w), np.uint8)
    mask[:, : min(w, left)] = mask[:, max(0, w - right) if right else w :] = 255
    mask[: min(h, top)] = mask[max(0, h - bottom) if bottom else h :] = 255
    return vision.grown(mask, 1) > 0


def stands_out(g: np.ndarray, inside: np.ndarray, around: np.ndarray, least: float = 8.0) -> bool:
    return bool(inside.any() and around.any() and abs(float(g[inside].mean()) - float(g[around].mean())) > least)


def circles(g: np.ndarray, searched: np.ndarray, radius: float, tolerance: float, roundness: float) -> list[tuple[int, int, int]]:
    """(x, y, r): edge pixels vote for centres along their slope; centres with votes of most of a circle, the best first, none within another."""
    gx, gy = vision.slopes(g)
    edge = vision.edges(g, 40, 100)
    y, x = np.nonzero(edge)
    size = np.maximum(np.hypot(gx[y, x], gy[y, x]), 1e-9)
    ux, uy = gx[y, x] / size, gy[y, x] / size
    h, w = g.shape
    found = []
    for r in range(max(1, int(radius)), ceil(radius * (1 + tolerance)) + 1):
        votes = np.zeros(h * w)
        for side in (-1, 1):
            cx, cy = np.rint(x + side * r * ux).astype(int), np.rint(y + side * r * uy).astype(int)
            ok = (cx >= 0) & (cx < w) & (cy >= 0) & (cy < h)
            votes += np.bincount(cy[ok] * w + cx[ok], minlength=h * w)
        near = vision.box(votes.reshape(h, w).astype(np.int64), 1)[0]
        for at in np.flatnonzero((near >= roundness * 0.5 * 2 * np.pi * r).ravel() & searched.ravel()).tolist():
            found.append((float(near.ravel()[at]) / r, at % w, at // w, r))
    kept: list[tuple[int, int, int]] = []
    for _, cx, cy, r in sorted(found, reverse=True):
        if all(hypot(cx - a, cy - b) > max(r, q) for a, b, q in kept):
            kept.append((cx, cy, r))
    return kept


def without_holes(v: np.ndarray, shape: str = "Circle", diameter: float = 50, roundness: float = 0.9, width: int = 50, height: int = 80, fill: float = 0.9, tolerance: float = 0.8, left: int = 100, right: int = 100, top: int = 100, bottom: int = 100) -> np.ndarray:
    """Holes near the edges filled from their surroundings; as three channels if any is found, else the page as it is."""
    g = vision.gray(checked(v))
    h, w = g.shape
    searched = search_mask(h, w, left, right, top, bottom)
    yy, xx = np.ogrid[:h, :w]
    mask, radii = np.zeros((h, w), np.uint8), []
    if shape in ("Circle", "Both"):
        for cx, cy, r in circles(g, searched, diameter / 2, tolerance, roundness):
            far = np.hypot(xx - cx, yy - cy)
            if stands_out(g, far <= 0.8 * r, (far > 1.1 * r) & (far <= 1.5 * r + 1)):
                mask[far <= r + 1] = 255
                radii.append(r)
    if shape in ("Rect", "Both"):
        label = labelled((g <= local_mean(g, 11, False) - 2) & searched)
        for _, name, size, x, y, bw, bh in boxes(0, label):
            if size >= 10 and width <= bw <= ceil(width * (1 + tolerance)) and height <= bh <= ceil(height * (1 + tolerance)) and size >= fill * bw * bh:
                around = np.zeros((h, w), bool)
                around[max(0, y - 4) : y + bh + 4, max(0, x - 4) : x + bw + 4] = True
                inside = np.zeros((h, w), bool)
                inside[y : y + bh, x : x + bw] = True
                if stands_out(g, inside, around & ~inside):
                    mask[inside] = 255
    if not mask.any():
        return v
    wide = vision.grown(mask, max(2, round(sum(radii) / len(radii) / 8) if radii else 2)) > 0
    return vision.repaired(colour(v), wide)


# ---- splits
def running_mean(x: np.ndarray, window: int) -> np.ndarray:
    r, total = odd(window, 1) // 2, np.concatenate([[0.0], x.cumsum()])
    a, z = np.maximum(np.arange(len(x)) - r, 0), np.minimum(np.arange(len(x)) + r + 1, len(x))
    return (total[z] - total[a]) / (z - a)


def ink_band(columns: np.ndarray) -> tuple[int, int]:
    """Where 2 % to 98 % of the ink lies, with a margin of a fiftieth (five at least)."""
    total, n = columns.cumsum(), len(columns)
    if total[-1] <= 0:
        return 0, n - 1
    a, z = int(np.argmax(total >= 0.02 * total[-1])), int(np.argmax(total >= 0.98 * total[-1]))
    margin = max(5, n // 50)
    return max(0, a - margin), min(n - 1, z + margin)


def split_scores(columns: np.ndarray, smooth: np.ndarray, mean: np.ndarray, deviation: np.ndarray, a: int, z: int) -> np.ndarray:
    """How good a split each column of the band a..z is: near the middle, little ink, balanced halves, bright, even."""
    n, x, unit = len(columns), np.arange(a, z + 1), lambda c: np.clip(c, 0, 1)
    local = running_mean(columns, odd(max(3, n // 80)))[x]
    middle = float(np.median(smooth[x]))
    scaled = lambda c: (c[x] - c[x].min()) / np.ptp(c[x]) if np.ptp(c[x]) > 1e-6 else None
    bright, rough = scaled(mean), scaled(deviation)
    total, left = columns.sum(), columns.cumsum()[x]
    centre = np.maximum(0, 1 - 2.5 * np.abs(x - 0.5 * (a + z)) / max(1.0, z - a))
    empty = 1 - unit(local / middle) if middle > 0 else np.zeros(len(x))
    balance = 1 - unit(np.abs(2 * left - total) / total) if total > 1e-6 else np.full(len(x), 0.5)
    return 0.60 * centre + 0.20 * empty + 0.15 * balance + 0.03 * (0.5 if bright is None else bright) + 0.02 * (0.5 if rough is None else 1 - rough)


def seam(cost: np.ndarray, a: int, z: int) -> tuple[int, float]:
    """(upper median column, cost) of the cheapest way from top to bottom within a..z, one column aside a row at most; ties go straight, then left."""
    own, back = cost[0, a : z + 1].astype(float), []
    wide = np.full(len(own) + 2, np.inf)
    left, here, right = wide[:-2], wide[1:-1], wide[2:]
    for line in cost[1:, a : z + 1]:
        here[:] = own
        best = np.minimum(here, left)
        back.append(np.where(right < best, 1, np.where(left < here, -1, 0)))
        own = np.minimum(best, right) + line
    at = int(own.argmin())
    total, path = float(own[at]), [at]
    for step in reversed(back):
        at += int(step[at])
        path.append(at)
    return a + sorted(path)[len(path) // 2], total


def split_column(v: np.ndarray, band: tuple[float, float] = (0.4, 0.6), smooth_px: int = 31, clip: float = 2.0, grid: int = 8, block: int = 51, c: float = 10, close_share: float = 0.02, close_px: int = 3, weights: tuple[float, float] = (0.7, 0.3), most_width: int = 0, gutter: int = 18, beside: int = 70, brighter: float = 6.0, evener: float = 0.88) -> tuple[int, float]:
    """(column, confidence) where a spread is cut: the best-scoring column of the band, refined, or the cheapest seam, if that scores as well or nearly.

    Pages wider than ``most_width`` are looked at in that width. The confidence weighs how deep the valley of ink is and how much brighter and
    evener the ``gutter`` is than what lies ``beside`` it; what is 0 has no weight. Nothing is rejected.
    """
    if most_width and v.shape[1] > most_width:
        small = vision.reduced(v, most_width)
        x, sure = split_column(small, band, smooth_px, clip, grid, block, c, close_share, close_px, weights, 0, gutter, beside, brighter, evener)
        return min(v.shape[1] - 1, round(x * v.shape[1] / small.shape[1])), sure
    g = vision.gray(v)
    h, w = g.shape
    light = vision.saturate(vision.to_lab(colour(v))[:, :, 0])
    flat = vision.saturate(vision.gaussian(vision.equalised(g, clip, grid) if clip else g, 5))
    dark = np.where(flat <= vision.gaussian(flat, odd(block)) - c, 255, 0).astype(np.uint8)
    rx, ry = max(15, round(w * close_share)) // 2, close_px // 2
    dark = vision.shrunk(vision.grown(dark, rx, ry), rx, ry)
    columns, mean, deviation = (dark > 0).sum(0).astype(float), light.mean(0), light.std(0)
    a, z = (min(w - 1, max(0, round(w * b))) for b in band)
    own = ink_band(columns)
    third = max(0, w // 3), min(w - 1, 2 * w // 3)
    a, z = (a, z) if z > a else third
    a, z = max(a, own[0]), min(z, own[1])
    a, z = (a, z) if z > a else third
    smooth = running_mean(columns, smooth_px)
    score = split_scores(columns, smooth, mean, deviation, a, z)
    x = a + int(score.argmax())
    fine, reach = running_mean(columns, max(3, smooth_px // 3)), max(5, w // 50)
    lo = max(0, x - reach)
    x = lo + int(fine[lo : min(w, x + reach + 1)].argmin())
    gx, gy = vision.slopes(light)
    slope = (np.minimum(np.abs(gx), 255) + np.minimum(np.abs(gy), 255)) / 2
    other, _ = seam((0.6 * dark + 0.25 * (255.0 - light) + 0.15 * slope) / 255, a, z)
    at = lambda k: float(score[k - a]) if a <= k <= z else float(split_scores(columns, smooth, mean, deviation, min(a, k), max(z, k))[k - min(a, k)])
    here, there, middle = at(x), at(other), 0.5 * (a + z)
    nearer = other if abs(other - middle) <= abs(x - middle) else x
    x = nearer if there >= 0.95 * here else x
    usual = float(np.median(smooth[a : z + 1]))
    valley = max(0.0, 1 - min(1.0, smooth[x] / usual)) if usual >= 1 else 0.0
    lo, hi = max(0, x - gutter), min(w, x + gutter + 1)
    sides = np.concatenate([light[:, max(0, lo - beside) : lo], light[:, hi : hi + beside]], 1).astype(float)
    inner, lab = light[:, lo:hi].astype(float), 0.0
    if sides.size:
        bright = min(1.0, max(0.0, (inner.mean() - sides.mean()) / (2 * max(brighter, 1e-6))))
        even = min(1.0, max(0.0, 1 - inner.std() / (max(evener, 1e-6) * sides.std() + 1e-6)))
        lab = 0.65 * bright + 0.35 * even
    parts = [(q, k) for q, k in zip((valley, lab), weights) if q > 0]
    return x, min(1.0, sum(q * k for q, k in parts) / sum(k for _, k in parts)) if parts else 0.0


def halves(v: np.ndarray, x: int, pad: int, border: int = 50) -> tuple[np.ndarray, np.ndarray]:
    """Both pages of a spread cut at ``x``, ``pad`` columns over it, with a border of the corners' colour but at the cut."""
    h, w = v.shape[:2]
    corner = max(1, min(h, w) // 50)
    patch = np.concatenate([v[y, c].reshape(-1, *v.shape[2:]) for y in (slice(0, corner), slice(h - corner, h)) for c in (slice(0, corner), slice(w - corner, w))])
    fill = vision.saturate(patch.astype(float).mean(0))

    def framed(page: np.ndarray, left: int, right: int) -> np.ndarray:
        out = np.empty((page.shape[0] + 2 * border, page.shape[1] + left + right, *page.shape[2:]), np.uint8)
        out[:] = fill
        out[border : border + page.shape[0], left : left + page.shape[1]] = page
        return out

    first, from_ = v[:, : min(w, max(1, x + pad))], min(w - 1, max(0, x - pad))
    return framed(first, border, 0), framed(v[:, from_:], 0, border)


# ---- borders
def contour_page(v: np.ndarray, low: int = 50, high: int = 150, kernel: int = 5, least: float = 0.1, pad: int = 10, cut: bool = True) -> np.ndarray:
    """The page by its outline: cropped to it, or all outside its hull filled; by edges, else by difference from the corners."""
    g = vision.gray(v)
    h, w = g.shape
    r = max(1, kernel // 2)

    def largest(mask: np.ndarray) -> np.ndarray | None:
        closed = vision.shrunk(vision.grown(np.where(mask, 255, 0).astype(np.uint8), r), r) > 0
        label = labelled(closed)
        shapes = [vision.hull(*vision.rim(label[t : t + bh, x : x + bw] == name)) + np.array([x, t]) for _, name, _, x, t, bw, bh in boxes(0, label) if bw * bh >= least * h * w]
        shapes = [s for s in shapes if vision.area(s) >= least * h * w]
        return max(shapes, key=vision.area) if shapes else None

    shape = largest(vision.grown(np.where(vision.edges(g, low, high), 255, 0).astype(np.uint8), 1) > 0)
    if shape is None:
        far = np.abs(g.astype(int) - int(np.median([g[0, 0], g[0, -1], g[-1, 0], g[-1, -1]]))).astype(np.uint8)
        shape = largest(far > vision.otsu(far)) if far.any() else None
    if shape is None:
        return v
    (x, y), (x2, y2) = shape.min(0), shape.max(0)
    if cut:
        return v[max(0, y - pad) : y2 + pad + 1, max(0, x - pad) : x2 + pad + 1]
    yy, xx = np.mgrid[:h, :w]
    inside = np.ones((h, w), bool)
    for p, q in zip(shape, np.roll(shape, -1, 0)):
        inside &= (q[0] - p[0]) * (yy - p[1]) - (q[1] - p[1]) * (xx - p[0]) >= -pad * hypot(*(q - p))
    out = v.copy()
    out[~inside] = 255
    return out


def brick_depths(light: np.ndarray, step: int, most: float, strictness: float = 1.0, gap: int = 3) -> np.ndarray:
    """For bricks of ``step`` rows how deep a border reaches in from the left: columns unlike the page's middle, up to ``gap`` like it between them.

    Weak depths (under 40 % of the usual) are none, short breaks are bridged, neighbours are averaged.
    """
    h, w = light.shape
    inner = light[h // 4 : h - h // 4 or h, w // 4 : w - w // 4 or w].astype(float)
    mean, spread = inner.mean(), max(4.0, inner.std())
    n = -(-h // step)
    rows = np.stack([light[k * step : (k + 1) * step].mean(0) for k in range(n)])
    unlike = np.abs(rows - mean) > 2.0 * strictness * spread + 10
    limit = max(1, int(w * most))
    depth = np.zeros(n)
    for k in range(n):
        last = -1
        for at in np.flatnonzero(unlike[k, :limit]).tolist():
            if at - last > gap + 1:
                break
            last = at
        depth[k] = last + 1
    some = np.sort(depth[depth > 0])
    if len(some):
        depth[depth <= 0.4 * some[len(some) // 2]] = 0
        for k in np.flatnonzero(depth == 0).tolist():
            if 0 < k < n - 1 and depth[k - 1] > 0 and depth[k + 1] > 0:
                depth[k] = (depth[k - 1] + depth[k + 1]) / 2
        depth = np.array([depth[max(0, k - 1) : k + 2].mean() if depth[k] > 0 else 0.0 for k in range(n)])
    return np.minimum(np.repeat(np.ceil(depth).astype(int), step)[:h], limit)


def integral_borders(v: np.ndarray, step: int = 16, most: tuple[float, float, float, float] = (0.25,) * 4, strictness: float = 1.0, offset: int = 5, mode: str = "Fill", cut: bool = False) -> np.ndarray:
    """Borders by bricks, side by side (left, right, top, bottom): filled with the page's colour, repaired, or cut off by each side's least depth. Small pages stay."""
    h, w = v.shape[:2]
    if min(h, w) < 40:
        return v
    light = vision.saturate(vision.to_lab(colour(v))[:, :, 0])
    views = (light, light[:, ::-1], light.T, light.T[:, ::-1])
    depth = [brick_depths(x, max(1, step), m, strictness) for x, m in zip(views, most)]
    depth = [np.where(d > 0, np.maximum(0, d + offset), 0) for d in depth]
    if cut:
        l, r, t, b = (int(d[d > 0].min()) if (d > 0).any() else 0 for d in depth)
        return v[t : h - b, l : w - r] if t + b < h and l + r < w else v
    x, y = np.arange(w), np.arange(h)
    mask = (x < depth[0][:, None]) | (x >= w - depth[1][:, None]) | (y[:, None] < depth[2][None]) | (y[:, None] >= h - depth[3][None])
    if not mask.any() or mask.all():
        return v
    if mode != "Fill":
        return vision.repaired(v, mask)
    out = v.copy()
    out[mask] = vision.saturate(np.median(v[~mask].reshape(int((~mask).sum()), -1), axis=0)) if v.ndim == 3 else int(np.median(v[~mask]))
    return out


# ---- specks
def despeckled(v: np.ndarray, multiplier: float = 0.5, absolute: int = 0, squareness: float = 0.6, keep_clusters: bool = True, max_aspect: float = 0.0, min_solidity: float = 0.0) -> np.ndarray:
    """The effective method: ink by difference from its blur (narrow pages) or adaptively; small components go, unless they are square and on a text line."""
    g = vision.gray(v)
    if g.shape[1] < 1200:
        diff = np.maximum(vision.gaussian(g, 15) - g, 0).astype(np.uint8)
        mask = diff > vision.otsu(diff) if diff.any() else np.zeros(g.shape, bool)
    else:
        mask = adaptive(g, 25, 15) == 0
    label = labelled(mask)
    parts = boxes(0, label)
    heights = sorted(p[6] for p in parts if p[6] >= 3)
    usual = heights[len(heights) // 2] if heights else 20
    limit = absolute or max(1, round(multiplier * usual * usual))
    tall = {p[1] for p in parts if p[6] >= 0.5 * usual}
    on_line = np.isin(label, list(tall)).any(1) if tall else np.zeros(g.shape[0], bool)
    lines = np.concatenate([[0], np.cumsum(on_line)]).tolist()
    gone = []
    for _, name, size, x, y, w, h in parts:
        if size >= limit:
            continue
        square = abs(w - h) / max(w, h) <= squareness
        if keep_clusters and square and lines[y + h] > lines[y]:
            own = label[y : y + h, x : x + w] == name
            solid = size / max(1.0, vision.area(vision.hull(*vision.rim(own)))) if min_solidity else 1.0
            if not (max_aspect and max(w, h) / min(w, h) > max_aspect) and solid >= min_solidity:
                continue
        gone.append(name)
    out = v.copy()
    out[np.isin(label, gone)] = 255
    return out


def without_dust(v: np.ndarray, median: int = 3, kernel: int = 3, times: int = 1) -> np.ndarray:
    """Ink after a median and an opening of so many pixels."""
    dark = 255 - vision.median(v, max(1, median // 2))
    r = max(1, kernel // 2)
    for f in (vision.shrunk, vision.grown):
        for _ in range(times):
            dark = f(dark, r)
    return 255 - dark


# ---- lines
def without_stripes(v: np.ndarray, axis: str = "y", times: float = 3.0, window: int = 21) -> np.ndarray:
    """Rows (columns) whose mean in the blurred page is far from that of their surroundings are replaced by the clean neighbour that differs less."""
    if axis == "x":
        return without_stripes(v.swapaxes(0, 1), "y", times, window).swapaxes(0, 1)
    g = vision.gray(v)
    means = vision.weighted(g, np.array([0.25, 0.5, 0.25])).mean(1)
    smooth = running_mean(means, window)
    off = np.abs(means - smooth)
    bad = off > times * max(float(off.mean()), 1e-9)
    clean = np.flatnonzero(~bad)
    out = v.copy()
    for y in np.flatnonzero(bad).tolist() if len(clean) else ():
        k = int(np.searchsorted(clean, y))
        near = [clean[i] for i in (k - 1, k) if 0 <= i < len(clean)]
        out[y] = v[min(near, key=lambda i: (abs(means[i] - smooth[y]), i))]
    return out


def without_lines(v: np.ndarray, axis: str = "x", thick: int = 1, share: float = 0.5, offset: int = -1, rgb: tuple[int, int, int] = (-1, -1, -1), tolerance: int = 40) -> np.ndarray:
    """Long straight lines of a colour (or dark ones): components that are long enough, thin enough, and begin at ``offset`` if that is given."""
    if axis == "y":
        return without_lines(v.swapaxes(0, 1), "x", thick, share, offset, rgb, tolerance).swapaxes(0, 1)
    c = colour(v).astype(int)
    mask = np.abs(c - np.array(rgb[::-1])).max(2) <= tolerance if min(rgb) >= 0 else vision.gray(v) < 128
    label = labelled(mask)
    gone = []
    for _, name, size, x, y, w, h in boxes(0, label):
        own = label[y : y + h, x : x + w] == name
        depth = vision.distance(np.pad(own, 1), 2 * thick + 2)[1:-1, 1:-1][own]
        if h >= share * v.shape[0] and 2 * np.percentile(depth, 90) - 1 <= thick and (offset < 0 or abs(x - offset) <= max(3, thick)):
            gone.append(name)
    return vision.repaired(v, vision.grown(np.where(np.isin(label, gone), 255, 0).astype(np.uint8), 1) > 0) if gone else v


def edge_stripes(v: np.ndarray, thick: int = 3, share: float = 0.5) -> np.ndarray:
    """Upright streaks at the left or right edge: strong slopes across, long along the edge, thin; repaired."""
    g = vision.gray(v)
    gx = np.minimum(np.abs(vision.slopes(g)[0]), 255).astype(np.uint8)
    long = max(1, int(g.shape[0] * share) // 2)
    streak = np.where(gx > vision.otsu(gx), 255, 0).astype(np.uint8)
    streak = vision.grown(vision.shrunk(vision.shrunk(vision.grown(streak, 1, 3), 1, 3), 0, long), 0, long) > 0
    label, most = labelled(streak), max(3 * thick, thick + 6)
    gone = [name for _, name, _, x, _, w, _ in boxes(0, label) if w <= most and (x <= 2 or x + w >= g.shape[1] - 2)]
    return vision.repaired(v, vision.grown(np.where(np.isin(label, gone), 255, 0).astype(np.uint8), 2, 0) > 0) if gone else v


def auto_borders(v: np.ndarray, dark: int = 40, auto: bool = True, margin: float = 10, shift: float = 0.25, fill: int = 255, least: int = 2000, span: float = 0.6, solid: float = 0.6, depth: float = 0.2, feather: int = 6, repair: bool = True) -> np.ndarray:
    """Dark components at the edges that are long, reach from edge to edge, or lie thinly within the border band; grown (or shrunk) by ``feather`` and filled.

    A component whose part inside the band is all but solid ink of the page's middle is left alone: with more than half of the page dark nothing is done.
    """
    g = vision.gray(v)
    h, w = g.shape
    mask = g <= (black_point(v, shift, margin / 100) if auto else dark)
    if mask.mean() > 0.5:
        return v
    label = labelled(mask)
    deep = np.ones((h, w), bool)
    y, x = int(h * depth), int(w * depth)
    deep[y : h - y, x : w - x] = False
    gone = np.zeros((h, w), bool)
    for _, name, size, left, top, bw, bh in boxes(0, label):
        sides = (left == 0, left + bw == w, top == 0, top + bh == h)
        if not any(sides):
            continue
        own = label == name
        long = bw >= span * w and (sides[2] or sides[3]) or bh >= span * h and (sides[0] or sides[1])
        across = sides[0] and sides[1] or sides[2] and sides[3]
        thin = size >= min(least, h * w // 100) and size < solid * bw * bh and not (own & ~deep).any()
        if long or across or thin:
            gone |= own & deep
    if not gone.any():
        return v
    r = abs(feather) if min(h, w) > 8 * abs(feather) else 0
    wide = np.where(gone, 255, 0).astype(np.uint8)
    gone = (vision.grown(wide, r) if feather > 0 else vision.shrunk(wide, r)) > 0 if r else gone
    if repair and gone.mean() < 0.2 and min(h, w) >= 64:
        return vision.repaired(v, gone)
    out = v.copy()
    out[gone] = fill
    return out


def contrast_borders(v: np.ndarray, contrast: int = 50, least: float = 0.4, most: float = 0.45, sample: float = 0.1) -> np.ndarray:
    """White over the leading rows and columns of which more than ``least`` differs from the middle's median by more than ``contrast``."""
    g = vision.gray(v)
    h, w = g.shape
    y, x = int(h * (1 - sample) / 2), int(w * (1 - sample) / 2)
    middle = np.sort(g[y : h - y, x : w - x], axis=None).astype(int)
    off = np.abs(g.astype(int) - (middle[len(middle) // 2] + middle[(len(middle) - 1) // 2]) // 2) > contrast
    out = v.copy()
    for axis, length in ((1, h), (0, w)):
        fine = np.flatnonzero(off.mean(axis) <= least)
        cap = round(length * most)
        first, last = (min(cap, fine[0]), min(cap, length - 1 - fine[-1])) if len(fine) else (cap, cap)
        lines = out if axis == 1 else out.swapaxes(0, 1)
        lines[:first] = 255
        lines[length - last :] = 255
    return out


def without_specks(v: np.ndarray, multiplier: float = 0.5, absolute: int = 0, dot_height: float = 0.35, radius: float = 0.8, squareness: float = 0.6, keep_clusters: bool = True, max_aspect: float = 0.0, min_solidity: float = 0.0, dilate: tuple[int, int, int] = (0, 0, 0)) -> np.ndarray:
    """The classic method on a gray page: small components go, but those near a big one, and on text rows square ones or (with ``keep_clusters``) those with another close by.

    A page that is mostly dark is taken for a negative. ``dilate``: half widths and rounds by which ink grows before it is taken apart. Components
    are compared within sorted windows, so a page of specks is not squared.
    """
    g = vision.gray(v)
    dark = g < 128 if (g >= 128).mean() >= 0.5 else g >= 128
    paper = 255 if (g >= 128).mean() >= 0.5 else 0
    whole = np.where(dark, 255, 0).astype(np.uint8)
    for _ in range(dilate[2]):
        whole = vision.grown(whole, dilate[0], dilate[1])
    label = labelled(whole > 0)
    parts = np.array(boxes(0, label), np.int64).reshape(-1, 7)
    if not len(parts):
        return v
    name, size, x, y, w, h = parts[:, 1:].T
    tall = np.sort(h[h >= 3])
    usual = int(tall[len(tall) // 2]) if len(tall) else 20
    limit = absolute or max(1, round(multiplier * usual * usual))
    small = (size < limit) | (h <= max(1, round(dot_height * usual)))
    cx, cy = x + w // 2, y + h // 2
    reach, rows, wide = max(1.0, radius * usual), max(1, usual // 3), max(3, int(usual * 0.6))
    text = np.flatnonzero(dark.sum(1) > max(10, g.shape[1] / 40))
    big = np.flatnonzero(~small)
    gone, order = [], np.flatnonzero(small)[np.argsort(cx[small], kind="stable")]
    for k in order.tolist():
        near = big[(x[big] - reach < cx[k]) & (x[big] + w[big] + reach > cx[k])]
        dx = np.maximum(0, np.maximum(x[near] - cx[k], cx[k] - x[near] - w[near]))
        dy = np.maximum(0, np.maximum(y[near] - cy[k], cy[k] - y[near] - h[near]))
        stays = bool((dx * dx + dy * dy < reach * reach).any())
        if not stays and np.searchsorted(text, cy[k] - rows) < np.searchsorted(text, cy[k] + rows, "right"):
            lo, hi = np.searchsorted(cx[order], cx[k] - wide), np.searchsorted(cx[order], cx[k] + wide, "right")
            close = np.abs(cy[order[lo:hi]] - cy[k]) <= rows
            stays = abs(int(w[k]) - int(h[k])) <= max(1.0, h[k] * min(1.0, squareness)) or (keep_clusters and int(close.sum()) > 1)
        if stays and max_aspect and max(w[k] / h[k], h[k] / w[k]) >= max_aspect:
            stays = False
        if stays and min_solidity:
            own = label[y[k] : y[k] + h[k], x[k] : x[k] + w[k]] == name[k]
            corners = vision.hull(*vision.rim(own))
            stays = size[k] >= min_solidity * max(1.0, vision.area(corners))
        if not stays:
            gone.append(name[k])
    out = v.copy()
    out[np.isin(label, gone) & dark] = paper
    return out


def inverted_dark(v: np.ndarray, method: str = "hybrid", single: bool = False, trim: float = 0.65, pads: tuple[int, int, int, int] | None = None, repair: int = 0) -> np.ndarray:
    """Dark areas in negative: ink of a blurred page closed into areas of 2 % of it or more (5000 pixels on pages that large), by mask, by rectangle, or both.

    ``pads``: by how much the rectangle grows on its left, right, top and bottom; None: it is trimmed to its dense rows and columns.
    ``repair``: how wide a rim of the area is evened out.
    """
    g = vision.gray(v)
    h, w = g.shape
    flat = vision.saturate(vision.gaussian(g, 5))
    dark = np.where(flat <= vision.otsu(flat), 255, 0).astype(np.uint8)
    r = max(7, min(h, w) // 60) // 2
    dark = vision.shrunk(vision.grown(dark, r), r)
    dark = vision.grown(vision.shrunk(dark, 1), 1) > 0
    label = labelled(dark)
    least = max(min(5000, 0.05 * h * w), 0.02 * h * w)
    areas = sorted((p for p in boxes(0, label) if p[2] >= least), key=lambda p: -p[2])
    chosen = np.zeros((h, w), bool)
    for _, name, _, x, y, bw, bh in areas[: 1 if single else None]:
        own = label == name
        l, t, rt, b = x, y, x + bw, y + bh
        if pads is None:
            dense = [own.sum(axis) for axis in (1, 0)]
            (t, b), (l, rt) = ((int(np.flatnonzero(d >= d.max() * trim)[0]), int(np.flatnonzero(d >= d.max() * trim)[-1]) + 1) for d in dense)
        else:
            l, rt, t, b = max(0, l - pads[0]), min(w, rt + pads[1]), max(0, t - pads[2]), min(h, b + pads[3])
        rect = np.zeros((h, w), bool)
        rect[t:b, l:rt] = True
        filled = ~outside(own)
        chosen |= {"mask": filled, "rect": rect, "hybrid": filled & rect}[method]
    out = v.copy()
    out[chosen] = 255 - out[chosen]
    if repair and chosen.any():
        mask = np.where(chosen, 255, 0).astype(np.uint8)
        out = vision.repaired(out, (vision.grown(mask, repair) > 0) & ~(vision.shrunk(mask, repair) > 0))
    return out


def outside(mask: np.ndarray) -> np.ndarray:
    """What a way along rows, columns and diagonals joins to the page's edge without crossing the mask."""
    label = labelled(np.pad(~mask, 1, constant_values=True))
    return (label == label[0, 0])[1:-1, 1:-1]
