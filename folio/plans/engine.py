"""Pipelines over packed pages: all operations of a page in one task, one after another, page by page.

Pages are dealt evenly once, as a file of many pages may be one task's, and no page waits for another. What goes wrong stays with its page, as a batch of scans wants it: a page
that can't be read is skipped with its error; an operation that fails ends its page's pipeline, and what was done so far is kept with
the error; operations that only clean (:data:`FORGIVING`) leave a page as it was when they can't do their work.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folio.kernels import operations as op
from folio.kernels import vision
from folio.plans.presets import REGISTRY, NotAvailable, Operation

OUT = "page_id bigint, part int, width int, height int, channels int, pixels binary, operation string, error string"
#: Operations whose failure leaves the page as it is.
FORGIVING = ("Deskew", "BordersRemove", "Despeckle", "PunchHolesRemove")
BATCH_BYTES = 4_000_000
#: Tasks a core, at least, among which pages are dealt: what is done to a page takes far longer than to send it.
TASKS = 4

Change = Callable[[np.ndarray], list[np.ndarray]]


#: Parameters that the methods here have no notion of: any but their default raises. (The stripes of LinesRemove take no other
#: parameter than the orientation, whatever a preset says.)
UNKNOWN: dict[tuple[str, str | None], tuple[str, ...]] = {
    ("Deskew", None): ("morphKernel", "maxLineGap"),
    ("BordersRemove", "Auto"): ("bgColor",),
    ("BordersRemove", "Integral"): ("seedBrightnessStrictness", "textureAllowance", "inpaintRadius", "borderColorVariation", "kInterpolation"),
    ("BordersRemove", "Manual"): ("manualCutDebug",),
    ("PunchHolesRemove", None): ("density",),
    ("Despeckle", None): ("sizeTolerance",),
    ("Despeckle", "Effective"): ("useDilateBeforeCC", "maxDotHeightFraction", "proximityRadiusFraction"),
}


def change_of(o: Operation, side: str = "Right") -> Change:
    """What an operation does to a raster; pages of the other side pass manual borders as they are.

    Raises NotAvailable for a method without an operator and for a parameter that it doesn't know.
    """
    p = o.parameters
    for method in (None, next(iter(p.values()))):
        for name in UNKNOWN.get((o.type, method), ()):
            if p[name] != REGISTRY[o.type][name].default:
                raise NotAvailable(f"{o.type}: {name} = {p[name]}")
    n = lambda name: int(p[name])
    one = lambda f: lambda v: [f(v)]
    gray = lambda f: one(lambda v: f(vision.gray(v)))
    match o.type, next(iter(p.values())):
        case "Deskew", "Text aware":
            raise NotAvailable("Deskew: Text aware needs a text recogniser")
        case "Deskew", method:
            return one(lambda v: op.deskewed(v, method, **{k: p[k] for k in p if k != "deskewAlgorithm"}))
        case "BordersRemove", "Auto":
            return one(lambda v: op.auto_borders(v, n("darkThreshold"), p["autoThresh"], p["marginPercent"], p["shiftFactor"], 255, n("minAreaPx"), p["minSpanFraction"], p["solidityThreshold"], p["minDepthFraction"], n("featherPx"), p["useTeleaHybrid"]))
        case "BordersRemove", "By Contrast":
            return one(lambda v: op.contrast_borders(v, n("contrastThr"), p["threshFrac"], p["maxRemoveFrac"], p["centralSample"]))
        case "BordersRemove", "By Contours":
            return one(lambda v: op.contour_page(v, n("contourCannyLow"), n("contourCannyHigh"), n("contourMorphKernel"), p["contourMinAreaFrac"], n("contourPaddingPx"), p["contourCut"]))
        case "BordersRemove", "Integral":
            most = (0.35,) * 4 if p["autoMaxBorderDepthFrac"] else tuple(p[f"maxBorderDepthFrac{s}"] for s in ("Left", "Right", "Top", "Bottom"))
            return one(lambda v: op.integral_borders(v, n("scanStepPx"), most, p["seedContrastStrictness"], n("borderSafetyOffsetPx"), p["inpaintMode"], p["integralCut"]))
        case "BordersRemove", "Manual":
            if not p["applyToLeftPage" if side == "Left" else "applyToRightPage"]:
                return lambda v: [v]
            depths = [n(f"manual{s}") for s in ("Left", "Top", "Right", "Bottom")]
            return one(lambda v: manual(v, *depths, p["cutMethod"]))
        case "Binarize", "Threshold":
            return gray(lambda g: op.threshold(g, n("threshold")))
        case "Binarize", "Adaptive":
            return gray(lambda g: op.adaptive(g, n("blockSize"), p["meanC"], p["useGaussian"], n("morphKernelBinarize") if p["useMorphology"] else 0, n("morphIterationsBinarize")))
        case "Binarize", "Sauvola":
            return gray(lambda g: op.sauvola(g, n("sauvolaWindowSize"), p["sauvolaK"], p["sauvolaR"], n("pencilStrokeBoost"), p["sauvolaClaheClip"] if p["sauvolaUseClahe"] else 0.0, n("sauvolaClaheGridSize"), n("sauvolaMorphRadius")))
        case "Binarize", "Majority":
            return gray(lambda g: op.majority(g, n("threshold"), abs(n("majorityOffset")), dots=4))
        case "PunchHolesRemove", shape:
            return one(lambda v: op.without_holes(v, shape, p["diameter"], p["roundness"], n("width"), n("height"), p["fillRatio"], p["sizeTolerance"], n("leftOffset"), n("rightOffset"), n("topOffset"), n("bottomOffset")))
        case "Despeckle", "Effective":
            shape = p["enableDustShapeFilter"]
            before = (lambda g: op.without_dust(g, n("dustMedianKsize"), n("dustOpenKernel"), n("dustOpenIter"))) if p["enableDustRemoval"] else (lambda g: g)
            return gray(lambda g: op.despeckled(before(g), p["smallAreaMultiplier"], 0 if p["smallAreaRelative"] else n("smallAreaAbsolutePx"), p["squarenessTolerance"], p["keepClusters"], p["dustMaxAspectRatio"] if shape else 0.0, p["dustMinSolidity"] if shape else 0.0))
        case "Despeckle", "Classic":
            shape, size = p["enableDustShapeFilter"], 0 if p["smallAreaRelative"] else n("smallAreaAbsolutePx")
            grow = {"1x3": (1, 0), "3x1": (0, 1), "3x3": (1, 1)}[p["dilateKernel"]] + (n("dilateIter"),) if p["useDilateBeforeCC"] else (0, 0, 0)
            before = (lambda g: op.without_dust(g, n("dustMedianKsize"), n("dustOpenKernel"), n("dustOpenIter"))) if p["enableDustRemoval"] else (lambda g: g)
            return gray(lambda g: op.without_specks(before(g), p["smallAreaMultiplier"], size, p["maxDotHeightFraction"], p["proximityRadiusFraction"], p["squarenessTolerance"], p["keepClusters"], p["dustMaxAspectRatio"] if shape else 0.0, p["dustMinSolidity"] if shape else 0.0, grow))
        case "LinesRemove", orientation:  # stripes; the other parameters belong to lines of a colour
            axes = {"Horizontal": "y", "Vertical": "x", "Both": "xy"}[orientation]
            return one(lambda v: op.without_stripes(v, axes) if len(axes) == 1 else op.without_stripes(op.without_stripes(v, "x"), "y"))
        case "Invert", "Invert whole page":
            return one(lambda v: 255 - v)
        case "Invert", method:
            kind = {"Invert hybrid": "hybrid", "Invert by mask": "mask", "Invert by rect mask": "rect"}[method]
            pads = tuple(n(f"invertRectPad{s}") for s in ("Left", "Right", "Top", "Bottom")) if p["invertRectPaddingMode"] == "Manual" else None
            return one(lambda v: op.inverted_dark(v, kind, p["invertObjectCount"] == "Single", p["invertRectAutoTrimSensitivity"], pads, n("invertInpaintRadiusPx")))
        case "Enhance", "CLAHE":
            return one(lambda v: op.on_lightness(v, lambda g: vision.equalised(g, p["claheClipLimit"], n("claheGridSize"))))
        case "Enhance", "Homomorphic Retinex":
            stretch = {"low_percent": p["retinexPercentLow"], "high_percent": p["retinexPercentHigh"], "bins": n("retinexHistBins"), "robust": p["retinexRobustNormalize"]}
            return one(lambda v: op.retinex(v, p["retinexSigma"], p["retinexGammaHigh"], p["retinexGammaLow"], p["retinexEps"], p["retinexOutputMode"], p["retinexUseLabL"], p["retinexExpClamp"], **stretch))
        case "Enhance", "Levels & Gamma":
            black, white = min(20.0, p["levelsBlackPercent"]), max(p["levelsWhitePercent"], min(20.0, p["levelsBlackPercent"]) + 0.1)
            return one(lambda v: op.on_lightness(v, lambda g: op.levels(g, black, white, min(5.0, max(0.05, p["levelsGamma"])), n("levelsTargetWhite"))))
        case "Enhance", "Color Adjust":
            return one(lambda v: op.toned(v, p["colorRed"], p["colorGreen"], p["colorBlue"], p["colorHue"], p["colorSaturation"]))
        case "Enhance", "Brightness & Contrast":
            return one(lambda v: vision.saturate(v * min(3.0, max(0.0, (p["contrast"] + 100) / 100)) + p["brightness"]))
        case "SplitPage", "Auto":
            return lambda v: list(auto_split(v, p))
        case "SplitPage", "Manual":
            return lambda v: manual_split(v, p["manualCutLinePercent"], n("manualOverlapPx"))
        case kind, method:
            raise NotAvailable(f"{kind}: {method}")


def manual(v: np.ndarray, left: int, top: int, right: int, bottom: int, cut: bool) -> np.ndarray:
    h, w = v.shape[:2]
    if w - left - right <= 0 or h - top - bottom <= 0:
        return v
    inner = (slice(top, h - bottom), slice(left, w - right))
    if cut:
        return v[inner]
    out = np.full_like(v, 255)
    out[inner] = v[inner]
    return out


def split_settings(p: dict) -> dict:
    """The parameters of an automatic split, made fit: the band in order, odd windows, weights that sum to one (evenly, if both are 0)."""
    a, z = sorted((p["centralBandStart"], p["centralBandEnd"]))
    ink, lab = p["weightProjection"], p["weightLab"] if p["useLabConfirmation"] else 0.0
    weights = (ink / (ink + lab), lab / (ink + lab)) if ink + lab > 0 else (0.5, 0.5)
    clip = p["claheClipLimit"] if p["useClahe"] else 0.0
    whole = lambda name: int(p[name])
    return {
        "band": (a, z), "smooth_px": op.odd(whole("smoothWindowPx")), "clip": clip, "grid": whole("claheTileGrid"), "block": op.odd(whole("adaptiveBlockSize")), "c": p["adaptiveC"],
        "close_share": p["closeKernelWidthFrac"], "close_px": whole("closeKernelHeightPx"), "weights": weights, "most_width": whole("analysisMaxWidth"),
        "gutter": whole("labGutterHalfWidthPx"), "beside": whole("labNeighborWidthPx"), "brighter": p["minLDiff"], "evener": p["maxGutterStdRatio"],
    }


def auto_split(v: np.ndarray, p: dict) -> tuple[np.ndarray, np.ndarray]:
    x, _ = op.split_column(v, **split_settings(p))
    pad = round(v.shape[1] * p["padPercent"] / 100) if p["padPercent"] > 0 else max(0, int(p["padPx"]))
    return op.halves(v, x, pad)


def manual_split(v: np.ndarray, percent: float, overlap: int) -> list[np.ndarray]:
    w = v.shape[1]
    at = min(w - 1, max(1, round(w * percent / 100)))
    return [v[:, : min(w, at + overlap)], v[:, max(0, at - overlap) :]]


def folded(v: np.ndarray, operations: list[tuple[str, Change]]) -> tuple[list[np.ndarray], str | None, str | None]:
    """(pages, operation that failed, its error) after as many operations as went well."""
    pages = [v]
    for name, change in operations:
        try:
            done = [new for page in pages for new in change(page)]
            if not done or any(new is None or new.size == 0 for new in done):
                raise ValueError("the operation left no page")
        except Exception as e:  # whatever a page does to an operation is that page's error
            if name in FORGIVING:
                continue
            return pages, name, f"{type(e).__name__}: {e}"
        pages = done
    return pages, None, None


def run(pages: DataFrame, pipeline: list[Operation]) -> DataFrame:
    """(page_id, part, width, height, channels, pixels, operation, error): the pages after the pipeline; parts of a split are 1 and 2.

    ``pages`` may carry ``side`` (Left or Right). Operations that are switched off are left out; one without an operator raises
    NotAvailable at once. Rows without pixels, or with fewer than their size says, are read errors: part 0, no pixels.
    """
    active = [o for o in pipeline if o.in_pipeline]
    for o in active:
        change_of(o)
    names = ["page_id", "width", "height", "channels", "pixels"]
    spark = pages.sparkSession
    tasks = max(TASKS * spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))
    rows = pages.select(*names, (F.col("side") if "side" in pages.columns else F.lit("Right")).alias("side")).repartition(tasks, "page_id")

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        plans = {side: [(o.type, change_of(o, side)) for o in active] for side in ("Left", "Right")}
        for b in batches:
            for k in range(b.num_rows):
                page, w, h, c, pixels, side = (b[n][k].as_py() for n in [*names, "side"])
                if not pixels or not w or not h or not c or len(pixels) != w * h * c:
                    yield page, 0, w, h, c, None, "load", "ValueError: no pixels, or not as many as the size says"
                    continue
                v = np.frombuffer(pixels, np.uint8).reshape((h, w) if c == 1 else (h, w, c))
                out, failed, error = folded(v, plans["Left" if side == "Left" else "Right"])
                for part, new in enumerate(out, 1):
                    yield page, part, new.shape[1], new.shape[0], 1 if new.ndim == 2 else new.shape[2], np.ascontiguousarray(new).tobytes(), failed, error

    kinds = [pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.int32(), pa.binary(), pa.string(), pa.string()]
    schema = pa.schema([(c.split()[0], t) for c, t in zip(OUT.split(", "), kinds)])

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for row in each(batches):
            held.append(row)
            size += len(row[5] or b"") + 64
            if size >= BATCH_BYTES:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*held), kinds)], schema=schema)
                held, size = [], 0
        if held:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*held), kinds)], schema=schema)

    return rows.mapInArrow(task, OUT)


def errors(done: DataFrame) -> DataFrame:
    """(page_id, operation, error), a row for each page that had one."""
    return done.where("error is not null").select("page_id", "operation", "error").distinct()
