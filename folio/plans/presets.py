"""Pipelines as data: typed operations with clamped parameters, read from and written to JSON, compiled to DataFrame operators.

All operation types and their parameters are registered; ``apply`` raises NotAvailable for methods without an operator. A preset is a list of {Type, DisplayName, Parameters}; names
of keys are taken in any case, unknown types and keys are passed over, malformed JSON gives an empty pipeline, and
nothing is read after a split.
"""

from __future__ import annotations

import json
import re
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folio import rasters
from folio.kernels import components, masks
from folio.operators import areas, points, profiles, regions

#: Numbers of the operation types in saved presets, in order.
TYPES = ("Deskew", "BordersRemove", "Binarize", "Invert", "PunchHolesRemove", "Despeckle", "LinesRemove", "SmartCrop", "Enhance", "SplitPage")


@dataclass(frozen=True)
class Number:
    default: float
    least: float
    most: float


@dataclass(frozen=True)
class Choice:
    options: tuple[str, ...]
    default: str


@dataclass(frozen=True)
class Flag:
    default: bool


#: Parameters with their defaults and ranges.
REGISTRY: dict[str, dict[str, Number | Choice | Flag]] = {
    "Deskew": {
        "deskewAlgorithm": Choice(("Auto", "ByBorders", "Hough", "Projection", "PCA", "Moments", "Perspective", "Text aware"), "Auto"),
        "cannyTresh1": Number(50, 10, 250),
        "cannyTresh2": Number(150, 10, 250),
        "morphKernel": Number(5, 1, 10),
        "perspectiveStrength": Number(5, 0, 10),
        "minLineLength": Number(200, 0, 20000),
        "houghTreshold": Number(80, 5, 250),
        "maxLineGap": Number(20, 0, 500),
        "projMinAngle": Number(-15.0, -45.0, 0.0),
        "projMaxAngle": Number(15.0, 0.0, 45.0),
        "projCoarseStep": Number(1.0, 0.1, 5.0),
        "projRefineStep": Number(0.2, 0.05, 2.0),
    },
    "BordersRemove": {
        "borderRemovalAlgorithm": Choice(("Auto", "Integral", "By Contrast", "By Contours", "Manual"), "Auto"),
        "threshFrac": Number(0.40, 0.05, 1.00),
        "contrastThr": Number(50, 1, 255),
        "centralSample": Number(0.10, 0.01, 1.00),
        "maxRemoveFrac": Number(0.45, 0.01, 1.00),
        "contourCannyLow": Number(50, 5, 200),
        "contourCannyHigh": Number(150, 10, 300),
        "contourMorphKernel": Number(5, 1, 25),
        "contourMinAreaFrac": Number(0.10, 0.01, 0.90),
        "contourPaddingPx": Number(10, 0, 200),
        "contourCut": Flag(True),
        "autoThresh": Flag(True),
        "marginPercent": Number(10, 0, 100),
        "shiftFactor": Number(0.25, 0.0, 3.0),
        "darkThreshold": Number(40, 0, 255),
        "bgColor": Number(0, 0, 255),
        "minAreaPx": Number(2000, 0, 2000000),
        "minSpanFraction": Number(0.6, 0.0, 1.0),
        "solidityThreshold": Number(0.6, 0.0, 1.0),
        "minDepthFraction": Number(0.20, 0.0, 1.0),
        "featherPx": Number(6, -10, 200),
        "useTeleaHybrid": Flag(True),
        "manualLeft": Number(0, 0, 10000),
        "manualRight": Number(0, 0, 10000),
        "manualTop": Number(0, 0, 10000),
        "manualBottom": Number(0, 0, 10000),
        "cutMethod": Flag(False),
        "manualCutDebug": Flag(False),
        "applyToLeftPage": Flag(True),
        "applyToRightPage": Flag(True),
        "seedContrastStrictness": Number(1.0, 0.05, 3.0),
        "seedBrightnessStrictness": Number(1.0, 0.05, 3.0),
        "textureAllowance": Number(1.0, 0.05, 2.0),
        "scanStepPx": Number(16, 1, 100),
        "inpaintRadius": Number(3, 1, 50),
        "inpaintMode": Choice(("Fill", "Telea", "NS"), "Fill"),
        "borderColorVariation": Number(0.5, 0.05, 1.0),
        "borderSafetyOffsetPx": Number(5, -30, 30),
        "integralCut": Flag(False),
        "autoMaxBorderDepthFrac": Flag(True),
        "maxBorderDepthFracLeft": Number(0.25, 0, 1),
        "maxBorderDepthFracRight": Number(0.25, 0, 1),
        "maxBorderDepthFracTop": Number(0.25, 0, 1),
        "maxBorderDepthFracBottom": Number(0.25, 0, 1),
        "kInterpolation": Number(0, 0, 50),
    },
    "Binarize": {
        "method": Choice(("Threshold", "Sauvola", "Adaptive", "Majority"), "Threshold"),
        "threshold": Number(128, 0, 255),
        "blockSize": Number(3, 3, 255),
        "meanC": Number(14, -50.0, 50.0),
        "sauvolaWindowSize": Number(25, 1, 500),
        "sauvolaK": Number(0.30, 0.01, 1.00),
        "sauvolaR": Number(180.0, 1.0, 256.0),
        "pencilStrokeBoost": Number(0, 0, 30),
        "sauvolaUseClahe": Flag(True),
        "sauvolaClaheClip": Number(2.0, 0.01, 255.0),
        "sauvolaClaheGridSize": Number(8, 8, 64),
        "sauvolaMorphRadius": Number(0, 0, 7),
        "majorityOffset": Number(30, -120, 120),
        "useGaussian": Flag(False),
        "useMorphology": Flag(False),
        "morphKernelBinarize": Number(3, 1, 21),
        "morphIterationsBinarize": Number(1, 0, 5),
    },
    "Invert": {
        "invertMethod": Choice(("Invert hybrid", "Invert by mask", "Invert by rect mask", "Invert whole page"), "Invert hybrid"),
        "invertObjectCount": Choice(("Auto", "Single"), "Auto"),
        "invertRectPaddingMode": Choice(("Auto", "Manual"), "Auto"),
        "invertRectAutoTrimSensitivity": Number(0.65, 0.01, 0.99),
        "invertRectPadLeft": Number(0, -300, 300),
        "invertRectPadRight": Number(0, -300, 300),
        "invertRectPadTop": Number(0, -300, 300),
        "invertRectPadBottom": Number(0, -300, 300),
        "invertInpaintRadiusPx": Number(0, 0, 50),
    },
    "PunchHolesRemove": {
        "punchShape": Choice(("Circle", "Rect", "Both"), "Circle"),
        "diameter": Number(50, 1, 500),
        "roundness": Number(0.9, 0.01, 1.00),
        "height": Number(80, 1, 500),
        "width": Number(50, 1, 500),
        "fillRatio": Number(0.9, 0.01, 1.0),
        "density": Number(1.00, 0.00, 1.00),
        "sizeTolerance": Number(0.8, 0.0, 2.0),
        "leftOffset": Number(100, 0, 1500),
        "rightOffset": Number(100, 0, 1500),
        "topOffset": Number(100, 0, 1500),
        "bottomOffset": Number(100, 0, 1500),
    },
    "Despeckle": {
        "despeckleMethod": Choice(("Classic", "Effective"), "Classic"),
        "smallAreaRelative": Flag(True),
        "smallAreaMultiplier": Number(0.50, 0.01, 50),
        "smallAreaAbsolutePx": Number(64, 1, 1000),
        "maxDotHeightFraction": Number(0.35, 0.01, 5.00),
        "proximityRadiusFraction": Number(0.80, 0.01, 5.00),
        "squarenessTolerance": Number(0.60, 0.00, 3.00),
        "keepClusters": Flag(True),
        "useDilateBeforeCC": Flag(False),
        "dilateKernel": Choice(("1x3", "3x1", "3x3"), "1x3"),
        "dilateIter": Number(1, 1, 5),
        "enableDustRemoval": Flag(False),
        "dustMedianKsize": Number(3, 1, 15),
        "dustOpenKernel": Number(3, 1, 15),
        "dustOpenIter": Number(1, 1, 5),
        "enableDustShapeFilter": Flag(False),
        "dustMinSolidity": Number(0.60, 0.05, 1.00),
        "dustMaxAspectRatio": Number(3.00, 1.00, 20.00),
        "sizeTolerance": Number(0.4, 0.0, 5.0),
        "showDespeckleDebug": Flag(True),
    },
    "LinesRemove": {
        "orientation": Choice(("Horizontal", "Vertical", "Both"), "Vertical"),
        "lineWidthPx": Number(1, 1, 20),
        "minLengthFraction": Number(0.5, 0.05, 1),
        "offsetStartPx": Number(-1, -1, 500),
        "lineColorRed": Number(-1, -1, 255),
        "lineColorGreen": Number(-1, -1, 255),
        "lineColorBlue": Number(-1, -1, 255),
        "colorTolerance": Number(40, 0, 255),
    },
    "SmartCrop": {
        "autoCropMethod": Choice(("U-net", "EAST"), "U-net"),
        "cropLevel": Number(62, 0, 100),
        "preset": Choice(("Fast", "Balance", "Quality"), "Fast"),
        "eastInputWidth": Number(1280, 1, 1600),
        "eastInputHeight": Number(1280, 1, 1600),
        "eastScoreThreshold": Number(0.5, 0.1, 1.0),
        "eastNmsThreshold": Number(0.4, 0.1, 1.0),
        "tesseractMinConfidence": Number(50, 5, 100),
        "paddingPx": Number(20, 0, 300),
        "downscaleMaxWidth": Number(1600, -1, 2400),
        "includeHandwritten": Flag(True),
        "handwrittenSensitivity": Number(15, 0, 100),
        "includeStamps": Flag(True),
        "eastDebug": Flag(True),
    },
    "Enhance": {
        "enhanceMethod": Choice(("CLAHE", "Homomorphic Retinex", "Levels & Gamma", "Color Adjust", "Brightness & Contrast", "Auto orient"), "CLAHE"),
        "autoOrientMinConfidence": Number(4.0, 1.0, 20.0),
        "claheClipLimit": Number(4.0, 0.5, 12.0),
        "claheGridSize": Number(8, 2, 64),
        "retinexOutputMode": Choice(("LogHighpass", "ReconstructExp"), "LogHighpass"),
        "retinexUseLabL": Flag(True),
        "retinexSigma": Number(50, 5, 200),
        "retinexGammaHigh": Number(1.8, 0.1, 4.0),
        "retinexGammaLow": Number(0.6, 0.01, 2.0),
        "retinexEps": Number(0.000001, 0.000001, 0.01),
        "retinexRobustNormalize": Flag(True),
        "retinexPercentLow": Number(0.5, 0.0, 5.0),
        "retinexPercentHigh": Number(99.5, 95.0, 100.0),
        "retinexHistBins": Number(2048, 32, 4096),
        "retinexExpClamp": Number(4.0, 1.0, 8.0),
        "levelsBlackPercent": Number(1.0, 0.0, 20.0),
        "levelsWhitePercent": Number(95.0, 50.0, 100.0),
        "levelsGamma": Number(0.85, 0.1, 3.0),
        "levelsTargetWhite": Number(255, 128, 255),
        "colorRed": Number(0, -100, 100),
        "colorGreen": Number(0, -100, 100),
        "colorBlue": Number(0, -100, 100),
        "colorHue": Number(0, -180, 180),
        "colorSaturation": Number(0, -100, 100),
        "brightness": Number(0, -100, 100),
        "contrast": Number(0, -100, 100),
    },
    "SplitPage": {
        "splitMethod": Choice(("Auto", "Manual"), "Auto"),
        "manualCutLinePercent": Number(50.0, 0.0, 100.0),
        "manualOverlapPx": Number(0, 0, 500),
        "centralBandStart": Number(0.40, 0.0, 1.0),
        "centralBandEnd": Number(0.60, 0.0, 1.0),
        "padPercent": Number(1.0, 0.0, 20.0),
        "padPx": Number(0, 0, 200),
        "analysisMaxWidth": Number(1400, 200, 6000),
        "useClahe": Flag(True),
        "claheClipLimit": Number(2.0, 0.1, 10.0),
        "claheTileGrid": Number(8, 2, 64),
        "adaptiveBlockSize": Number(31, 3, 255),
        "adaptiveC": Number(10.0, -50.0, 50.0),
        "closeKernelWidthFrac": Number(0.025, 0.005, 0.12),
        "closeKernelHeightPx": Number(3, 1, 25),
        "smoothWindowPx": Number(41, 3, 301),
        "useLabConfirmation": Flag(True),
        "labGutterHalfWidthPx": Number(18, 1, 100),
        "labNeighborWidthPx": Number(70, 1, 200),
        "minLDiff": Number(6.0, 0.0, 50.0),
        "maxGutterStdRatio": Number(0.88, 0.0, 1.5),
        "weightProjection": Number(0.70, 0.0, 1.0),
        "weightLab": Number(0.30, 0.0, 1.0),
    },
}
#: Other spellings that are read.
SPELLINGS = {"treshFrac": "threshFrac", "borderColorTolerance": "borderColorVariation"}


#: Texts that are read as numbers.
NUMERAL = re.compile(r"[+-]?(?:[0-9]+\.?[0-9]*|\.[0-9]+)(?:[eE][+-]?[0-9]+)?")


def coerce(kind: Number | Choice | Flag, raw: object) -> object:
    """A saved value as the parameter takes it; what can't be taken is the default. Flags and options take whole numbers, not fractions."""
    index = raw if isinstance(raw, int) and not isinstance(raw, bool) and -(2**31) <= raw < 2**31 else None
    if isinstance(kind, Flag):
        if isinstance(raw, str):
            return {"true": True, "false": False}.get(raw.strip().lower(), kind.default)
        return raw if isinstance(raw, bool) else kind.default if index is None else index != 0
    if isinstance(kind, Choice):
        if isinstance(raw, str):
            return next((o for o in kind.options if o == raw), next((o for o in kind.options if o.lower() == raw.lower()), kind.default))
        return kind.options[index] if index is not None and 0 <= index < len(kind.options) else kind.default
    if isinstance(raw, str):
        value = float(raw) if NUMERAL.fullmatch(raw.strip(" ")) else kind.default
    else:
        value = float(raw) if isinstance(raw, (int, float)) and not isinstance(raw, bool) else kind.default
    return kind.default if value != value else min(kind.most, max(kind.least, value))


@dataclass
class Operation:
    type: str
    display_name: str = ""
    given: dict[str, object] = field(default_factory=dict)
    in_pipeline: bool = True
    checkpoint: str | None = None  # name of the branch that ends here

    def __post_init__(self) -> None:
        known = REGISTRY[self.type]
        given = {SPELLINGS[k]: v for k, v in self.given.items() if k in SPELLINGS} | self.given
        self.parameters = {k: coerce(kind, given[k]) if k in given else kind.default for k, kind in known.items()}


def load(text: str) -> list[Operation]:
    try:
        rows = json.loads(text)
    except (TypeError, ValueError):
        return []
    out: list[Operation] = []
    for row in rows if isinstance(rows, list) else []:
        if not isinstance(row, dict):
            continue
        row = {k.lower(): v for k, v in row.items()}
        kind = row.get("type")
        name = TYPES[kind] if isinstance(kind, int) and not isinstance(kind, bool) and 0 <= kind < len(TYPES) else None
        if name not in REGISTRY:
            continue
        parameters = row.get("parameters")
        shown = row.get("displayname")
        out = added(out, Operation(name, shown if isinstance(shown, str) and shown else name, parameters if isinstance(parameters, dict) else {}))
        if name == "SplitPage":
            break
    return out


def save(pipeline: list[Operation]) -> str:
    rows = [{"Type": TYPES.index(o.type), "DisplayName": o.display_name or o.type, "Parameters": o.parameters} for o in pipeline if o.in_pipeline]
    return json.dumps(rows) if rows else ""


def default() -> list[Operation]:
    return [Operation("BordersRemove"), Operation("Binarize")]


def opened(text: str | None) -> list[Operation]:
    """What a start finds: the saved pipeline, or the default one where nothing was saved."""
    try:
        rows = json.loads(text or "")
    except ValueError:
        return default()
    return load(text) if isinstance(rows, list) and rows else default()


def may_add(pipeline: list[Operation], kind: str) -> bool:
    """A split ends a pipeline: after it only one Deskew, put before it, may come."""
    types = [o.type for o in pipeline]
    return "SplitPage" not in types or (kind == "Deskew" and "Deskew" not in types)


def added(pipeline: list[Operation], o: Operation, at: int | None = None) -> list[Operation]:
    """The pipeline with one more operation. A split keeps nothing but the first Deskew before it; what may not come is left out."""
    if not may_add(pipeline, o.type):
        return list(pipeline)
    if o.type == "SplitPage":
        return [d for d in pipeline if d.type == "Deskew"][:1] + [o]
    last = next((i for i, x in enumerate(pipeline) if x.type == "SplitPage"), len(pipeline))
    at = last if at is None else max(0, min(at, last))
    return [*pipeline[:at], o, *pipeline[at:]]


#: Fixed value: the name of the branch of all operations.
FULL = "Full pipeline"


def branches(pipeline: list[Operation]) -> dict[str, list[Operation]]:
    """A prefix for each checkpoint, and the whole; a name used twice gets a number."""
    out: dict[str, list[Operation]] = {}
    for i, o in enumerate([*pipeline, None], 1):
        name = FULL if o is None else o.checkpoint
        if name is None:
            continue
        n, whole = 2, name
        while name in out:
            name, n = f"{whole} {n}", n + 1
        out[name] = pipeline[:i]
    return out


def apply_branches(px: DataFrame, pipeline: list[Operation], width: int, height: int) -> dict[str, DataFrame]:
    """The pages at each branch: every operation stands once in the plans, and pages are kept where branches part."""
    out: dict[str, DataFrame] = {}
    done = 0
    named = branches(pipeline)
    for name, prefix in named.items():
        px = apply(px, prefix[done:], width, height)
        done = len(prefix)
        out[name] = px
    return out


class NotAvailable(ValueError):
    """An operation, or a method of one, without an operator here."""


#: Parameters that :func:`apply` can't honour on exploded pages, by operation and method, with the value that asks for nothing.
#: :func:`folio.plans.engine.run` honours all of them on packed pages.
NEUTRAL: dict[tuple[str, str], dict[str, object]] = {
    ("Despeckle", "Classic"): {"enableDustRemoval": False, "useDilateBeforeCC": False},
    ("Invert", "Invert hybrid"): {"invertRectPaddingMode": "Auto", "invertInpaintRadiusPx": 0},
    ("Invert", "Invert by mask"): {"invertInpaintRadiusPx": 0},
    ("Invert", "Invert by rect mask"): {"invertRectPaddingMode": "Auto", "invertInpaintRadiusPx": 0},
    ("BordersRemove", "Manual"): {"applyToLeftPage": True, "applyToRightPage": True},
}


def packed(px: DataFrame, o: Operation) -> DataFrame:
    """An operation that keeps a page's size, on packed pages and back. A page on which it fails stays as it is."""
    from folio.plans import engine

    return rasters.unpack(engine.run(rasters.pack(px), [o]).select("page_id", "width", "height", "channels", "pixels"))


def apply(px: DataFrame, pipeline: list[Operation], width: int, height: int) -> DataFrame:
    """The pages after all operations that are in the pipeline: one plan, so Catalyst sees them together.

    Raises NotAvailable for a method without an operator on exploded pages, and for a parameter that it can't honour.
    """
    for o in pipeline:
        if not o.in_pipeline:
            continue
        p = o.parameters
        method = next(iter(p.values()))
        for name, neutral in NEUTRAL.get((o.type, method), {}).items():
            if p[name] != neutral:
                raise NotAvailable(f"{o.type}, {method}: {name} = {p[name]}")
        if o.type == "Despeckle" and p["enableDustShapeFilter"] and p["dustMinSolidity"] > 0.05:
            raise NotAvailable(f"Despeckle, {method}: dustMinSolidity = {p['dustMinSolidity']}")
        match o.type, method:
            case "BordersRemove", "By Contrast":
                px = profiles.whiten_borders(px, profiles.contrast_borders(px, width, height, int(p["contrastThr"]), p["threshFrac"], p["maxRemoveFrac"], p["centralSample"]), width, height).select("page_id", "y", "x", "v")
            case "BordersRemove", "Auto":
                px = packed(px, o)
            case "Despeckle", "Classic":
                pages = rasters.pack(px)
                size = {} if p["smallAreaRelative"] else {"absolute": int(p["smallAreaAbsolutePx"])}
                aspect = p["dustMaxAspectRatio"] if p["enableDustShapeFilter"] else None
                gone = regions.specks(components.components(pages), profiles.text_rows(px, width), p["smallAreaMultiplier"], dot_height=p["maxDotHeightFraction"], radius=p["proximityRadiusFraction"], squareness=p["squarenessTolerance"], keep_clusters=p["keepClusters"], max_aspect=aspect, **size)
                px = rasters.unpack(masks.paint(pages, gone.where("remove")))
            case "Despeckle", "Effective":
                px = packed(px, o)
            case "BordersRemove", "Manual":
                depths = [int(p[f"manual{s}"]) for s in ("Left", "Top", "Right", "Bottom")]
                left, top, right, bottom = depths
                if p["cutMethod"] and width - left - right > 0 and height - top - bottom > 0:
                    width, height = width - left - right, height - top - bottom
                    px = points.crop(px, left, top, width, height)
                elif not p["cutMethod"]:
                    px = points.fill_outside(px, *depths, width, height)
            case "Binarize", "Threshold":
                px = points.threshold(px, int(p["threshold"]))
            case "Binarize", "Adaptive":
                px = packed(px, o) if p["useGaussian"] or p["useMorphology"] else areas.adaptive_mean(px, int(p["blockSize"]), p["meanC"])
            case "Binarize", "Sauvola":
                if p["sauvolaUseClahe"]:
                    px = areas.local_equalised(px, width, height, int(p["sauvolaClaheGridSize"]), p["sauvolaClaheClip"])
                px = areas.sauvola(px, int(p["sauvolaWindowSize"]), p["sauvolaK"], p["sauvolaR"], int(p["pencilStrokeBoost"]))
                if r := int(p["sauvolaMorphRadius"]):
                    px = areas.closed(areas.opened(px, r), r)
            case "Binarize", "Majority":
                px = areas.majority(px, int(p["threshold"]), abs(int(p["majorityOffset"])))
            case "Invert", "Invert whole page":
                px = points.invert(px)
            case "Invert", method:
                kind = {"Invert hybrid": "hybrid", "Invert by mask": "mask", "Invert by rect mask": "rect"}[method]
                px = rasters.unpack(masks.invert_dark(rasters.pack(px), kind, p["invertObjectCount"] == "Single", trim=p["invertRectAutoTrimSensitivity"]))
            case "Enhance", "CLAHE":
                px = areas.local_equalised(px, width, height, int(p["claheGridSize"]), p["claheClipLimit"])
            case "Enhance", "Homomorphic Retinex":
                e = areas.homomorphic(px, p["retinexSigma"], p["retinexGammaHigh"], p["retinexGammaLow"], p["retinexEps"], p["retinexOutputMode"], p["retinexExpClamp"])
                px = areas.normalised(e, *((p["retinexPercentLow"], p["retinexPercentHigh"]) if p["retinexRobustNormalize"] else (0, 100)))
            case "LinesRemove", orientation:
                for axis in {"Horizontal": "y", "Vertical": "x", "Both": "xy"}[orientation]:  # stripes know no width or colour
                    px = profiles.remove_stripes(px, axis, 3.0, 21)
            case "Enhance", "Levels & Gamma":
                px = areas.levels(px, p["levelsBlackPercent"], p["levelsWhitePercent"], p["levelsGamma"], int(p["levelsTargetWhite"]))
            case "Enhance", "Brightness & Contrast":
                px = points.brightness_contrast(px, p["brightness"], p["contrast"])
            case "SplitPage", "Manual":
                px = points.split_at(px, width, p["manualCutLinePercent"], int(p["manualOverlapPx"])).withColumn("page_id", 2 * F.col("page_id") + F.col("side") - 1).drop("side")
            case kind, method:
                raise NotAvailable(f"{kind}: {method}")
    return px
