"""Whole-page kernels on pages made by hand, case by case."""

import math

import numpy as np
import pytest

from folio.kernels import operations as op
from folio.kernels import vision


def page(h, w, v=255, c=1):
    return np.full((h, w) if c == 1 else (h, w, c), v, np.uint8)


def lines(h=120, w=160, angle=0.0):
    v = page(h, w)
    for y in range(15, h - 10, 12):
        v[y : y + 3, 20 : w - 20] = 0
    return vision.turned(v, angle, 255) if angle else v


def test_pages_that_cannot_be():
    for bad in (None, np.empty((0, 0), np.uint8), np.full((5, 5), 0.5, np.float32)):
        with pytest.raises(ValueError):
            op.checked(bad)
    with pytest.raises(ValueError):
        vision.gray(page(5, 5, 128, 2))


def test_gray_of_channels():
    assert vision.gray(page(2, 2, 7, 3)).tolist() == [[7, 7], [7, 7]]
    assert vision.gray(np.array([[[10, 20, 30, 0]]], np.uint8))[0, 0] == round(0.299 * 30 + 0.587 * 20 + 0.114 * 10)


@pytest.mark.parametrize("size", [(1, 1), (2, 2), (9, 9), (15, 15), (60, 60)])
@pytest.mark.parametrize("more", [{}, {"smooth": True}, {"kernel": 3}, {"block": 0}, {"block": 8}])
def test_adaptive(size, more):
    out = op.adaptive(page(*size, 120), **more)
    assert out.shape == size and set(np.unique(out)) <= {0, 255}


def test_adaptive_by_hand():
    rng = np.random.default_rng(1)
    v = rng.integers(0, 256, (12, 17), dtype=np.uint8)
    out = op.adaptive(v, 5, 3)
    for y in range(12):
        for x in range(17):
            near = v[max(0, y - 2) : y + 3, max(0, x - 2) : x + 3].astype(float)
            assert out[y, x] == (255 if v[y, x] > near.mean() - 3 else 0)


@pytest.mark.parametrize("window", [2, 10, 25])
def test_sauvola(window):
    rng = np.random.default_rng(2)
    v = rng.integers(0, 256, (20, 20), dtype=np.uint8)
    out, r = op.sauvola(v, window), max(3, window + (window % 2 == 0)) // 2
    near = v[max(0, 10 - r) : 10 + r + 1, max(0, 7 - r) : 7 + r + 1].astype(float)
    assert out[10, 7] == (255 if v[10, 7] > min(255, near.mean() * (1 + 0.3 * (near.std() / 180 - 1))) else 0)
    assert op.sauvola(v, window, clip=2.0, radius=1).shape == v.shape


def test_majority_adds_dots_back():
    v = page(10, 10, 200)
    v[2, 2] = 128  # black by half of the thresholds and more
    v[7, 7] = 130
    out = op.majority(v, 128, 30)
    assert out[2, 2] == 0 and out[7, 7] == 255
    assert op.majority(v, 135, 0, dots=4)[7, 7] == 0


def test_windows_by_hand():
    rng = np.random.default_rng(3)
    v = rng.integers(0, 256, (9, 14), dtype=np.uint8)
    for r in (1, 2, 5):
        big, small = vision.grown(v, r, 1), vision.shrunk(v, r, 1)
        for y, x in ((0, 0), (4, 7), (8, 13)):
            near = v[max(0, y - 1) : y + 2, max(0, x - r) : x + r + 1]
            assert big[y, x] == near.max() and small[y, x] == near.min()
    disc = vision.elliptic(v, 3, True)
    assert disc[4, 7] == max(v[4 + dy, 7 + dx] for dy in range(-3, 4) for dx in range(-3, 4) if abs(dx) <= int(math.sqrt(9 - dy * dy) + 0.5))
    assert vision.median(v)[4, 7] == np.median(v[3:6, 6:9])


def test_flat_pages_of_enhancement():
    black = page(10, 10, 0)
    assert (vision.equalised(black, 2.0, 4) == black).all()
    assert op.on_lightness(page(8, 12, 200, 4), lambda g: vision.equalised(g, 2.0, 2)).shape == (8, 12, 3)
    assert op.on_lightness(page(10, 10, 128), lambda g: vision.equalised(g, 2.0, 2)).shape == (10, 10)
    for mode in ("LogHighpass", "ReconstructExp"):
        for light in (True, False):
            for robust in (True, False):
                out = op.retinex(page(16, 16, 180, 3), 5, 1.8, 0.6, 1e-6, mode, light, robust=robust)
                assert out.shape == (16, 16) and out.min() == out.max()
    out = op.normalised(np.zeros((16, 16)), 0.5, 99.5, 64)
    assert out.min() == out.max() == 0
    assert op.levels(page(8, 8, 120), 95, 1).shape == (8, 8)


def test_lab_and_back():
    rng = np.random.default_rng(4)
    v = rng.integers(0, 256, (20, 20, 3), dtype=np.uint8)
    assert np.abs(vision.from_lab(vision.to_lab(v)).astype(int) - v).max() <= 1
    assert np.allclose(vision.to_lab(page(1, 1, 255, 3))[0, 0], [255, 0, 0], atol=0.1)


def test_tones():
    v = np.array([[[10, 20, 200]]], np.uint8)
    turned = op.toned(v, hue=120)[0, 0].tolist()  # red becomes green
    assert turned[1] == 200 and sorted(turned) == [10, 20, 200]
    assert op.toned(v, red=10)[0, 0].tolist() == [10, 20, 220]
    assert len(set(op.toned(v, saturation=-100)[0, 0].tolist())) == 1


@pytest.mark.parametrize("angle", [-6.0, -2.4, 0.0, 3.0, 7.0])
def test_skew_is_found(angle):
    v = lines(angle=angle)
    best, sure = op.angle_by_projection(v)
    assert abs(best + angle) <= 0.4 and 0 <= sure <= 1
    out = op.deskewed(v, "Projection")
    assert abs(op.angle_by_projection(out)[0]) <= 0.4


def test_skew_by_axis_and_lines():
    v = page(100, 300)
    v[45:55, 20:280] = 0
    for angle in (-8.0, 5.0):
        turned = vision.turned(v, angle, 255)
        assert abs(op.angle_by_axis(turned)[0] + angle) < 0.5
        assert abs(op.angle_by_lines(turned, least_votes=40, length=100)[0] + angle) < 1.0
        for method in ("PCA", "Moments", "Auto"):
            fixed = op.deskewed(turned, method)
            assert abs(op.angle_by_axis(fixed)[0]) < 1.5, method
    assert math.isnan(op.angle_by_axis(page(20, 20))[0])
    assert (op.deskewed(page(20, 20), "Hough") == 255).all()


def test_agreement():
    assert op.agreed([(1.0, 1.0), (2.0, 1.0), (9.0, 5.0)]) == 1.5
    assert op.agreed([(float("nan"), 0.0)]) == 0.0
    assert op.normal_angle(50) == -40 and op.normal_angle(-45) == 45 and op.normal_angle(0.004) == 0


def test_turning_keeps_all():
    rng = np.random.default_rng(5)
    v = rng.integers(0, 256, (7, 11), dtype=np.uint8)
    assert (vision.turned(v, 90) == np.rot90(v)).all() and (vision.turned(v, 180) == np.rot90(v, 2)).all()
    assert vision.turned(page(30, 40, 9, 3), 20, 9).min() == 9
    assert abs(int((255 - vision.turned(lines(), 10).astype(int)).sum()) / int((255 - lines().astype(int)).sum()) - 1) < 0.02


def test_shapes():
    yy, xx = np.mgrid[:60, :80]
    mask = (xx >= 10) & (xx < 50) & (yy >= 20) & (yy < 35)
    corners = vision.hull(*vision.rim(mask))
    assert vision.area(corners) == 39 * 14 and sorted(vision.least_rect(corners)[:2]) == [14, 39]
    far = vision.distance(mask, 20)
    assert far[27, 30] == 8 and far[20, 10] == 1 and far[0, 0] == 0
    disc = np.hypot(xx - 30, yy - 30) <= 20
    assert abs(vision.distance(disc, 30).max() - 20.5) < 1


def test_perspective():
    v = page(100, 120, 30)
    yy, xx = np.mgrid[:100, :120]
    v[(yy > 15 + xx * 0.05) & (yy < 85 - xx * 0.05) & (xx > 15) & (xx < 105)] = 240
    out = op.upright(v)
    assert out.mean() > v.mean() and abs(out.shape[1] - 90) < 12


def test_punch_holes():
    with pytest.raises(ValueError):
        op.without_holes(None)
    black = page(40, 40, 0)
    assert op.without_holes(black) is black
    v = page(60, 80, 255, 3)
    v[5:15, 10:30] = 0
    out = op.without_holes(v, "Rect", width=20, height=10, fill=0.5, tolerance=0.2, top=20, left=0, right=0, bottom=0)
    assert out.shape == v.shape and out.min() > 200
    assert op.without_holes(v, "Rect", width=22, height=10, fill=0.5, tolerance=0.2, top=20, left=0, right=0, bottom=0) is v
    yy, xx = np.mgrid[:120, :160]
    round_ = page(120, 160, 240)
    round_[np.hypot(xx - 25, yy - 60) <= 12] = 20
    out = op.without_holes(round_, "Circle", diameter=22, tolerance=0.3, roundness=0.8, left=60, right=0, top=0, bottom=0)
    assert out.ndim == 3 and out.min() > 180
    assert op.without_holes(round_, "Circle", diameter=22, tolerance=0.3, left=0, right=40, top=0, bottom=0) is round_


def test_split():
    rng = np.random.default_rng(6)
    v = page(120, 300, 235)
    for x0, x1 in ((15, 135), (165, 285)):
        for y in range(10, 110, 8):
            v[y : y + 3, x0:x1] = rng.integers(0, 90, (3, x1 - x0))
    x, sure = op.split_column(v)
    assert 135 <= x <= 165 and 0 < sure <= 1
    left, right = op.halves(v, x, 3)
    assert left.shape == (220, x + 3 + 50) and right.shape == (220, 300 - x + 3 + 50)
    assert (left[:50] == 235).all()
    cost = np.ones((6, 9))
    cost[:, 4] = 0
    assert op.seam(cost, 1, 7) == (4, 0.0)


def test_seam_is_cheapest():
    rng = np.random.default_rng(7)
    cost = rng.integers(0, 9, (6, 5)).astype(float)
    best = min(sum(cost[y, x] for y, x in enumerate(path)) for path in __import__("itertools").product(range(5), repeat=6) if all(abs(a - b) <= 1 for a, b in zip(path, path[1:])))
    assert op.seam(cost, 0, 4)[1] == best


def test_borders():
    v = page(120, 140, 30)
    v[20:100, 25:120] = 230
    cropped = op.contour_page(v, pad=0)
    assert abs(cropped.shape[0] - 80) <= 6 and abs(cropped.shape[1] - 95) <= 6
    filled = op.contour_page(v, cut=False, pad=0)
    assert filled[5, 5] == 255 and filled[60, 70] == 230
    assert op.contour_page(page(50, 50, 99)).shape == (50, 50)
    edge = page(160, 160, 220)
    edge[:, :12] = 10
    out = op.integral_borders(edge)
    assert out[:, :12].min() == 220 and (out[:, 30:] == 220).all()
    assert op.integral_borders(edge, cut=True).shape[1] <= 148
    small = page(30, 30)
    assert op.integral_borders(small) is small


def test_specks_and_stripes():
    v = page(80, 200)
    for x in range(20, 180, 12):
        v[30:45, x : x + 6] = 0
    v[70, 100] = 0
    out = op.despeckled(v)
    assert out[70, 100] == 255 and (out[30:45, 20:26] == 0).all()
    assert op.without_dust(v)[70, 100] == 255
    s = page(60, 60, 200)
    s[30] = 20
    assert op.without_stripes(s, "y")[30].min() > 150
    assert op.without_stripes(s.T, "x")[:, 30].min() > 150
    long = page(100, 80, 230)
    long[:, 40] = 0
    assert op.without_lines(long, "x")[:, 40].min() > 150
    assert op.without_lines(long, "x", offset=10)[50, 40] == 0
    assert op.without_lines(np.repeat(long[:, :, None], 3, 2), "x", rgb=(0, 0, 0))[:, 40].min() > 150
    streak = page(100, 80, 230)
    streak[:, 1:3] = 40
    assert op.edge_stripes(streak).mean() > streak.mean()


def test_ground_and_black_point():
    v = page(100, 100, 200)
    v[40:60, 40:60] = 20
    assert op.ground(v) == 200 and 20 < op.black_point(v) < 110
    v[:1] = 0  # a minority of the frame
    assert op.ground(v) == 200
    assert op.black_point(page(20, 20, 50)) == 40


def test_auto_borders():
    v = page(200, 160, 230)
    v[:, :10] = 5
    v[100:110, 70:90] = 5
    out = op.auto_borders(v)
    assert out[:, :10].min() > 150 and (out[100:110, 70:90] == 5).all()
    assert (op.auto_borders(page(50, 50, 5), auto=False) == 5).all()


def test_classic_specks():
    v = page(80, 200)
    for x in range(20, 180, 12):
        v[30:45, x : x + 6] = 0
    v[70, 100] = v[36, 192] = 0
    v[47, 30:32] = 0  # near a letter
    out = op.without_specks(v)
    assert out[70, 100] == 255 and out[36, 192] == 0 and (out[47, 30:32] == 0).all() and (out[30:45, 20:26] == 0).all()
    assert (op.without_specks(255 - v)[70, 100], op.without_specks(255 - v)[35, 22]) == (0, 255)
    grown = op.without_specks(v, dilate=(1, 1, 1))
    assert grown[70, 100] == 255 and (grown[30:45, 20:26] == 0).all()
    assert op.without_specks(page(9, 9)).min() == 255


def test_contrast_borders():
    v = page(40, 60, 200)
    v[:5] = v[:, 55:] = 10
    out = op.contrast_borders(v)
    assert (out[:5] == 255).all() and (out[:, 55:] == 255).all() and (out[6:, :54] == 200).all()


def test_dark_areas():
    v = page(120, 160, 220)
    v[20:80, 30:110] = 15
    v[40:45, 50:80] = 230
    for method in ("mask", "rect", "hybrid"):
        out = op.inverted_dark(v, method)
        assert out[30, 60] == 240 and out[42, 60] == 25 and out[100, 140] == 220, method
    assert op.inverted_dark(v, "rect", pads=(5, 5, 5, 5))[18, 60] == 255 - 220
    assert op.inverted_dark(v, "mask", repair=2).shape == v.shape


def test_downscaling():
    rng = np.random.default_rng(9)
    v = rng.integers(0, 256, (9, 12), dtype=np.uint8)
    out = vision.reduced(v, 4)
    assert out.shape == (3, 4) and out[1, 2] == round(float(v[3:6, 6:9].mean()))
    assert vision.reduced(v, 12) is v and vision.reduced(page(10, 7, 9, 3), 3).tolist() == page(4, 3, 9, 3).tolist()


def test_merging_boxes():
    from folio.kernels.masks import merged_boxes

    rows = [(0, 0, 5, 5), (7, 0, 5, 5), (30, 30, 4, 4), (31, 31, 4, 4), (15, 2, 2, 2)]
    assert merged_boxes(rows, 3, 0.9, 0.0) == merged_boxes(rows[::-1], 3, 0.9, 0.0) == [(0, 0, 17, 5), (30, 30, 5, 5)]
    assert merged_boxes(rows, 0, 0.3, 0.0) == sorted([*rows[:2], (30, 30, 5, 5), rows[4]])
    assert merged_boxes([], 3, 0.1, 0.0) == []


def test_labels_of_winding_shapes():
    """One line that winds through 1,500 rows: labels that fell by rounds took one for each of its turns."""
    import time

    from folio.kernels.components import labelled

    mask = np.zeros((1500, 1500), bool)
    mask[::2] = True
    mask[1::4, -1] = mask[3::4, 0] = True
    began = time.time()
    label = labelled(mask)
    assert time.time() - began < 10
    assert (label[mask] == 0).all() and (label[~mask] == -1).all()
