import numpy as np
import pytest

from folio import rasters
from folio.kernels import masks
from folio.sources import images


@pytest.mark.parametrize("channels", (1, 3, 4))
def test_round_trips(channels):
    rng = np.random.default_rng(channels)
    for h, w in ((1, 1), (7, 5), (300, 133)):
        for v in (rng.integers(0, 256, (h, w, channels)), np.full((h, w, channels), 7), (np.arange(h * w * channels) // 9 % 256).reshape(h, w, channels)):
            v = v.astype(np.uint8)
            files = [images.png(v), images.bmp(v)] + [images.tiff(v, packing=p, description="[]") for p in images.PACKINGS]
            for f in files:
                got, dpi = images.decode(f)
                assert np.array_equal(got, v) and dpi == 300


def test_row_filters():
    """Each filter of PNG rows, written by its definition."""
    rng = np.random.default_rng(5)
    want = rng.integers(0, 256, (5, 12)).astype(np.int64)
    body = bytearray()
    for y in range(5):
        body.append(y)
        for x in range(12):
            a, b, c = (want[y, x - 3] if x > 2 else 0), (want[y - 1, x] if y else 0), (want[y - 1, x - 3] if y and x > 2 else 0)
            near = min((a, b, c), key=lambda q: abs(a + b - c - q))
            body.append(int(want[y, x] - (0, a, b, (a + b) // 2, near)[y]) & 255)
    assert np.array_equal(images.unfilter(bytes(body), 5, 12, 3), want.astype(np.uint8))


def test_known_lzw():
    # the codes of 7 7 7 8 8 7 7 6 6: clear, 7, 258, 8, 8, 258, 6, 6, end
    codes = (256, 7, 258, 8, 8, 258, 6, 6, 257)
    bits = "".join(f"{c:09b}" for c in codes)
    packed = int(bits.ljust(-(-len(bits) // 8) * 8, "0"), 2).to_bytes(-(-len(bits) // 8), "big")
    raw = bytes((7, 7, 7, 8, 8, 7, 7, 6, 6))
    assert images.from_lzw(packed) == raw and images.lzw(raw) == packed


def test_damage_is_a_row(spark):
    good = images.png(np.zeros((2, 3, 1), np.uint8))
    bad = [b"", None, b"BM", b"II*\0\xff\xff\xff\x7f", good[:40], good[:-20]]
    rows = [(str(i), c) for i, c in enumerate([good, *bad])]
    got = {r.path: r for r in images.decoded(spark.createDataFrame(rows, "path string, content binary")).collect()}
    assert got["0"].error is None and got["0"].width == 3 and len(got) == 7
    assert all(got[str(i)].error and got[str(i)].pixels is None for i in range(1, 7))


def test_save(spark, tmp_path):
    pages = spark.createDataFrame([(1, 2, 1, 1, b"\x01\x02"), (2, 1, 1, 3, b"\x01\x02\x03")], rasters.PAGE)
    files = images.encoded(pages, "png").selectExpr("concat(page_id, '.png') as name", "content")
    assert sorted(r.name for r in images.save(files, str(tmp_path)).collect()) == ["1.png", "2.png"]
    assert images.decode((tmp_path / "2.png").read_bytes())[0].tolist() == [[[1, 2, 3]]]


def reachable(mask):
    h, w = mask.shape
    seen, todo = set(), [(y, x) for y in range(-1, h + 1) for x in (-1, w)] + [(y, x) for y in (-1, h) for x in range(-1, w + 1)]
    while todo:
        y, x = todo.pop()
        if (y, x) in seen or not (-1 <= y <= h and -1 <= x <= w) or (0 <= y < h and 0 <= x < w and mask[y, x]):
            continue
        seen.add((y, x))
        todo += [(y + 1, x), (y - 1, x), (y, x + 1), (y, x - 1)]
    return seen


def test_holes():
    rng = np.random.default_rng(3)
    for _ in range(50):
        mask = rng.random((9, 11)) < 0.6
        outside = reachable(mask)
        want = np.array([[(y, x) not in outside for x in range(11)] for y in range(9)])
        assert np.array_equal(masks.without_holes(mask), want)


def test_inversion(spark):
    v = np.full((6, 6), 200, np.uint8)
    v[1:5, 1:5] = 20
    v[2, 2] = 210  # a hole, which the mask fills
    v[0, 5] = 0  # touches the square by a corner only, so it belongs to it
    page = spark.createDataFrame([(1, 6, 6, 1, v.tobytes()), (2, 0, 0, 1, b""), (3, 2, 1, 3, b"\0" * 6)], rasters.PAGE)
    for method in ("mask", "rect", "hybrid"):
        got = {r.page_id: bytes(r.pixels) for r in masks.invert_dark(page, method).collect()}
        new = np.frombuffer(got[1], np.uint8).reshape(6, 6)
        want = v.copy()
        want[1:5, 1:5] = 255 - want[1:5, 1:5]
        if method == "mask":
            want[0, 5] = 255
        assert np.array_equal(new, want), method
        assert got[2] == b"" and got[3] == b"\0" * 6


def test_suppression(spark):
    rng = np.random.default_rng(8)
    rows = [(p, i, int(x), int(y), int(w), int(h)) for p in range(3) for i, (x, y, w, h) in enumerate(rng.integers(1, 12, (25, 4)))]
    got = {(r.page_id, r.box_id) for r in masks.suppressed(spark.createDataFrame(rows, "page_id long, box_id long, x long, y long, w long, h long"), 0.3).collect()}
    want = set()
    for p in range(3):
        kept = []
        for _, i, x, y, w, h in sorted((r for r in rows if r[0] == p), key=lambda r: (-r[4] * r[5], r[1])):
            meets = lambda o: max(0, min(x + w, o[0] + o[2]) - max(x, o[0])) * max(0, min(y + h, o[1] + o[3]) - max(y, o[1]))
            if all(meets(o) / (w * h + o[2] * o[3] - meets(o)) <= 0.3 for o in kept):
                kept.append((x, y, w, h))
                want.add((p, i))
    assert got == want
