"""Presets in bulk: any number of saved pipelines as relations, from JSON text to compiled branches, in one plan.

``presets`` is (preset_id, text). Texts are parsed as variants; what follows is joins with small fixed tables (the parameters of
:data:`folio.plans.presets.REGISTRY` and the rules of ``VISIBLE``), windows within a preset, and arrays. Nothing is done on the driver, and a preset is the largest
thing that a task holds.

The rules are those of :mod:`folio.plans.presets`, which does the same for one preset in Python: a text that is null, blank, malformed (keys that repeat
within an object are malformed) or no array, and an empty array, leave the default pipeline; names of keys are taken in any case, unknown types and unknown parameters are passed
over, nothing is read after a split, and a split keeps only the first Deskew before it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from folio.plans import presets
from folio.plans.presets import FULL, REGISTRY, SPELLINGS, TYPES, Choice, Flag, Number

#: Which parameters are asked for, by the options of others. A parameter has to meet all its rules; those without any are always asked for.
VISIBLE: dict[str, dict[str, dict[str, tuple[str, ...]]]] = {
    "Deskew": {
        "cannyTresh1": {"deskewAlgorithm": ("ByBorders", "Hough")},
        "cannyTresh2": {"deskewAlgorithm": ("ByBorders", "Hough")},
        "morphKernel": {"deskewAlgorithm": ("ByBorders", "Perspective")},
        "perspectiveStrength": {"deskewAlgorithm": ("Auto", "Perspective")},
        **{k: {"deskewAlgorithm": ("Hough",)} for k in ("minLineLength", "houghTreshold", "maxLineGap")},
        **{k: {"deskewAlgorithm": ("Projection",)} for k in ("projMinAngle", "projMaxAngle", "projCoarseStep", "projRefineStep")},
    },
    "BordersRemove": {
        **{k: {"borderRemovalAlgorithm": ("Auto",)} for k in ("autoThresh", "useTeleaHybrid", "minAreaPx", "minSpanFraction", "solidityThreshold", "minDepthFraction", "featherPx")},
        **{k: {"borderRemovalAlgorithm": ("Auto",), "autoThresh": ("true",)} for k in ("marginPercent", "shiftFactor")},
        **{k: {"borderRemovalAlgorithm": ("Auto",), "autoThresh": ("false",)} for k in ("bgColor", "darkThreshold")},
        **{k: {"borderRemovalAlgorithm": ("By Contrast",)} for k in ("threshFrac", "contrastThr", "centralSample", "maxRemoveFrac")},
        **{k: {"borderRemovalAlgorithm": ("By Contours",)} for k in ("contourCannyLow", "contourCannyHigh", "contourMorphKernel", "contourMinAreaFrac", "contourPaddingPx", "contourCut")},
        **{k: {"borderRemovalAlgorithm": ("Manual",)} for k in ("manualLeft", "manualTop", "manualRight", "manualBottom", "cutMethod", "manualCutDebug", "applyToLeftPage", "applyToRightPage")},
        **{
            k: {"borderRemovalAlgorithm": ("Integral",)}
            for k in ("seedContrastStrictness", "seedBrightnessStrictness", "textureAllowance", "scanStepPx", "inpaintRadius", "inpaintMode", "borderColorVariation", "borderSafetyOffsetPx", "autoMaxBorderDepthFrac", "kInterpolation", "integralCut")
        },
        **{k: {"borderRemovalAlgorithm": ("Integral",), "autoMaxBorderDepthFrac": ("false",)} for k in ("maxBorderDepthFracLeft", "maxBorderDepthFracRight", "maxBorderDepthFracTop", "maxBorderDepthFracBottom")},
    },
    "Binarize": {
        "threshold": {"method": ("Threshold", "Majority")},
        "majorityOffset": {"method": ("Majority",)},
        **{k: {"method": ("Adaptive",)} for k in ("blockSize", "meanC", "useGaussian", "useMorphology")},
        **{k: {"method": ("Adaptive",), "useMorphology": ("true",)} for k in ("morphKernelBinarize", "morphIterationsBinarize")},
        **{k: {"method": ("Sauvola",)} for k in ("sauvolaWindowSize", "sauvolaK", "sauvolaR", "sauvolaUseClahe", "sauvolaMorphRadius", "pencilStrokeBoost")},
        **{k: {"method": ("Sauvola",), "sauvolaUseClahe": ("true",)} for k in ("sauvolaClaheClip", "sauvolaClaheGridSize")},
    },
    "Invert": {
        **{k: {"invertMethod": ("Invert by mask", "Invert by rect mask", "Invert hybrid")} for k in ("invertObjectCount", "invertInpaintRadiusPx")},
        "invertRectPaddingMode": {"invertMethod": ("Invert by rect mask", "Invert hybrid")},
        "invertRectAutoTrimSensitivity": {"invertMethod": ("Invert by rect mask", "Invert hybrid"), "invertRectPaddingMode": ("Auto",)},
        **{k: {"invertMethod": ("Invert by rect mask", "Invert hybrid"), "invertRectPaddingMode": ("Manual",)} for k in ("invertRectPadLeft", "invertRectPadRight", "invertRectPadTop", "invertRectPadBottom")},
    },
    "PunchHolesRemove": {
        **{k: {"punchShape": ("Circle", "Both")} for k in ("diameter", "roundness")},
        **{k: {"punchShape": ("Rect", "Both")} for k in ("width", "height", "fillRatio")},
    },
    "Despeckle": {
        "smallAreaMultiplier": {"smallAreaRelative": ("true",)},
        "smallAreaAbsolutePx": {"smallAreaRelative": ("false",)},
        **{k: {"enableDustRemoval": ("true",)} for k in ("dustMedianKsize", "dustOpenKernel", "dustOpenIter")},
        **{k: {"enableDustShapeFilter": ("true",)} for k in ("dustMinSolidity", "dustMaxAspectRatio")},
    },
    "SmartCrop": {
        "cropLevel": {"autoCropMethod": ("U-net",)},
        **{
            k: {"autoCropMethod": ("EAST",)}
            for k in ("preset", "eastInputWidth", "eastInputHeight", "eastScoreThreshold", "eastNmsThreshold", "tesseractMinConfidence", "paddingPx", "downscaleMaxWidth", "includeHandwritten", "handwrittenSensitivity", "includeStamps", "eastDebug")
        },
    },
    "Enhance": {
        **{k: {"enhanceMethod": ("CLAHE",)} for k in ("claheClipLimit", "claheGridSize")},
        **{k: {"enhanceMethod": ("Homomorphic Retinex",)} for k in ("retinexOutputMode", "retinexUseLabL", "retinexSigma", "retinexGammaHigh", "retinexGammaLow", "retinexEps", "retinexRobustNormalize", "retinexExpClamp")},
        **{k: {"enhanceMethod": ("Homomorphic Retinex",), "retinexRobustNormalize": ("true",)} for k in ("retinexPercentLow", "retinexPercentHigh", "retinexHistBins")},
        **{k: {"enhanceMethod": ("Levels & Gamma",)} for k in ("levelsBlackPercent", "levelsWhitePercent", "levelsGamma", "levelsTargetWhite")},
        **{k: {"enhanceMethod": ("Color Adjust",)} for k in ("colorRed", "colorGreen", "colorBlue", "colorHue", "colorSaturation")},
        **{k: {"enhanceMethod": ("Brightness & Contrast",)} for k in ("brightness", "contrast")},
        "autoOrientMinConfidence": {"enhanceMethod": ("Auto orient",)},
    },
    "SplitPage": {
        **{k: {"splitMethod": ("Manual",)} for k in ("manualCutLinePercent", "manualOverlapPx")},
        **{k: {"splitMethod": ("Auto",)} for k in REGISTRY["SplitPage"] if k not in ("splitMethod", "manualCutLinePercent", "manualOverlapPx")},
    },
}

#: JSON numbers and texts that are read as numbers.
NUMERAL = r"^[+-]?(?:[0-9]+\.?[0-9]*|\.[0-9]+)(?:[eE][+-]?[0-9]+)?$"


def registry_rows() -> list[tuple]:
    """(type, key, kind, number, least, most, options, option, flag) of every parameter."""
    out = []
    for name, parameters in REGISTRY.items():
        for key, kind in parameters.items():
            match kind:
                case Number(default, least, most):
                    out.append((name, key, "number", float(default), float(least), float(most), None, None, None))
                case Choice(options, default):
                    out.append((name, key, "choice", None, None, None, list(options), default, None))
                case Flag(default):
                    out.append((name, key, "flag", None, None, None, None, None, default))
    return out


def registry(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(registry_rows(), "type string, key string, kind string, least_number double, least double, most double, options array<string>, least_option string, least_flag boolean").withColumnsRenamed(
        {"least_number": "default_number", "least_option": "default_option", "least_flag": "default_flag"}
    )


def rule_rows() -> list[tuple]:
    """(type, key, control, allowed) of every rule of ``VISIBLE``."""
    return [(name, key, control, list(allowed)) for name, keys in VISIBLE.items() for key, rules in keys.items() for control, allowed in rules.items()]


def rules(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(rule_rows(), "type string, key string, control string, allowed array<string>")


def kind_of(value: Column) -> Column:
    """STRING, BIGINT, DECIMAL, DOUBLE, BOOLEAN, VOID, OBJECT or ARRAY."""
    return F.regexp_extract(F.schema_of_variant(value), "^[A-Z]+", 0)


def entry(fields: Column, name: str) -> Column:
    """The value of the last key of this name, in any case."""
    return F.try_element_at(F.filter(F.map_entries(fields), lambda e: F.lower(e["key"]) == name), F.lit(-1))["value"]


def whole(value: Column) -> Column:
    """A JSON number without fraction or exponent, of 32 bits."""
    n = F.try_variant_get(value, "$", "bigint")
    return F.when((kind_of(value) == "BIGINT") & n.between(-(2**31), 2**31 - 1), n)


def saved(presets_: DataFrame) -> DataFrame:
    """(preset_id, at, type, display_name, parameters): the operations that a text has, before the rules of structure; parameters are a map of variants."""
    parsed = presets_.select("preset_id", F.try_variant_get(F.try_parse_json("text"), "$", "array<variant>").alias("items"))
    found = parsed.select("preset_id", F.posexplode("items").alias("at", "item")).select("preset_id", "at", F.try_variant_get("item", "$", "map<string,variant>").alias("fields"))
    found = found.withColumns({"number": whole(entry(F.col("fields"), "type")), "named": entry(F.col("fields"), "displayname"), "given": entry(F.col("fields"), "parameters")})
    kinds = F.array(*map(F.lit, TYPES))
    known = found.where(F.col("number").between(0, len(TYPES) - 1)).withColumn("type", F.element_at(kinds, (F.col("number") + 1).cast("int")))
    name = F.when(kind_of(F.col("named")) == "STRING", F.nullif(F.try_variant_get("named", "$", "string"), F.lit("")))
    return known.select("preset_id", "at", "type", F.coalesce(name, "type").alias("display_name"), F.try_variant_get("given", "$", "map<string,variant>").alias("parameters"))


def operations(presets_: DataFrame) -> DataFrame:
    """(preset_id, position, type, display_name, parameters): the pipeline of each preset, numbered from 1.

    Up to the first split; with a split, only it and the first Deskew before it. The default pipeline where nothing was saved.
    """
    rows = saved(presets_)
    preset = Window.partitionBy("preset_id")
    rows = rows.withColumn("split", F.min(F.when(F.col("type") == "SplitPage", F.col("at"))).over(preset)).withColumn("deskew", F.min(F.when(F.col("type") == "Deskew", F.col("at"))).over(preset))
    kept = rows.where(F.col("split").isNull() | (F.col("at") == F.col("split")) | ((F.col("at") == F.col("deskew")) & (F.col("at") < F.col("split"))))
    items = F.try_variant_get(F.try_parse_json("text"), "$", "array<variant>")
    unread = presets_.where(F.coalesce(F.size(items), F.lit(0)) <= 0)
    standard = F.explode(F.array(*[F.struct(F.lit(i).alias("at"), F.lit(o.type).alias("type")) for i, o in enumerate(presets.default())]))
    given = unread.select("preset_id", standard.alias("o")).select("preset_id", "o.at", "o.type", F.col("o.type").alias("display_name"), F.lit(None).cast("map<string,variant>").alias("parameters"))
    both = kept.select(*given.columns).unionByName(given)
    return both.select("preset_id", F.row_number().over(preset.orderBy("at")).alias("position"), "type", "display_name", "parameters")


def raw_of(key: Column) -> Column:
    """What the parameters of an operation say of a key, by its own or its other spelling."""
    other = F.create_map(*[F.lit(x) for old, new in SPELLINGS.items() for x in (new, old)])
    return F.coalesce(F.try_element_at("parameters", key), F.try_element_at("parameters", F.try_element_at(other, key)))


def option_of(raw: Column, options: Column, default: Column) -> Column:
    said, text, index = F.try_variant_get(raw, "$", "string"), kind_of(raw) == "STRING", whole(raw)
    exact = F.when(text & F.array_contains(options, F.coalesce(said, F.lit(""))), said)
    folded = F.when(text, F.try_element_at(F.filter(options, lambda o: F.lower(o) == F.lower(said)), F.lit(1)))
    return F.coalesce(exact, folded, F.when(index >= 0, F.try_element_at(options, (index + 1).cast("int"))), default)


def flag_of(raw: Column, default: Column) -> Column:
    said, json = F.try_variant_get(raw, "$", "string"), kind_of(raw)
    low = F.lower(F.trim(said))
    return F.coalesce(F.when(json == "BOOLEAN", said == "true"), whole(raw) != 0, F.when((json == "STRING") & low.isin("true", "false"), low == "true"), default)


def values(ops: DataFrame, *own: str) -> DataFrame:
    """(preset_id, position, type, key, kind, number, option, flag): every parameter of every operation, as saved if that can be taken, else its default; then ``own`` columns of the operation."""
    known = F.broadcast(registry(ops.sparkSession))  # some 200 fixed rows
    rows = ops.join(known, "type").withColumn("raw", raw_of(F.col("key")))
    said, json = F.try_variant_get("raw", "$", "string"), kind_of(F.col("raw"))
    trimmed = F.trim(said)
    read = F.when(json.isin("BIGINT", "DECIMAL", "DOUBLE"), F.try_variant_get("raw", "$", "double")).when((json == "STRING") & trimmed.rlike(NUMERAL), trimmed.cast("double"))
    option, flag = option_of(F.col("raw"), F.col("options"), F.col("default_option")), flag_of(F.col("raw"), F.col("default_flag"))
    number = F.least("most", F.greatest("least", F.coalesce(read, "default_number")))
    only = lambda kind, value: F.when(F.col("kind") == kind, value)
    return rows.select("preset_id", "position", "type", "key", "kind", only("number", number).alias("number"), only("choice", option).alias("option"), only("flag", flag).alias("flag"), *own)


def asked(ops: DataFrame) -> DataFrame:
    """(preset_id, position, type, key, visible): ``visible`` of all parameters of operations, from what each says of the controls itself, so that no row waits for another."""
    facts = {(r[0], r[1]): r for r in registry_rows()}
    of: dict[tuple[str, str], list] = {(r[0], r[1]): [] for r in registry_rows()}
    for name, key, control, allowed in rule_rows():
        if (name, control) in facts and (name, key) in of:
            _, _, kind, _, _, _, options, option, flag = facts[name, control]
            of[name, key].append((control, kind, options, option, flag, allowed))
    schema = "type string, key string, rules array<struct<control: string, kind: string, options: array<string>, default_option: string, default_flag: boolean, allowed: array<string>>>"
    known = F.broadcast(ops.sparkSession.createDataFrame([(*k, v) for k, v in of.items()], schema))  # some 200 fixed rows
    met = F.lit(True)
    for i in range(max(map(len, of.values()))):  # two rules a parameter at most
        r = F.get("rules", F.lit(i))
        raw = raw_of(r["control"])
        said = F.when(r["kind"] == "choice", option_of(raw, r["options"], r["default_option"])).when(r["kind"] == "flag", flag_of(raw, r["default_flag"]).cast("string"))
        met = met & (r.isNull() | F.coalesce(F.array_contains(r["allowed"], said), F.lit(True)))
    return ops.join(known, "type").select("preset_id", "position", "type", "key", met.alias("visible"))


def visible(found: DataFrame) -> DataFrame:
    """``values`` with ``visible``: whether the parameter is asked for, given what its operation has chosen."""
    said = found.select("preset_id", "position", "type", F.col("key").alias("control"), F.coalesce("option", F.col("flag").cast("string")).alias("said"))
    ruled = said.join(F.broadcast(rules(found.sparkSession)), ["type", "control"])  # some 120 fixed rows
    met = ruled.groupBy("preset_id", "position", "key").agg(F.bool_and(F.array_contains("allowed", F.col("said"))).alias("met"))
    return found.join(met, ["preset_id", "position", "key"], "left").withColumn("visible", F.coalesce("met", F.lit(True))).drop("met")


def may_add(ops: DataFrame) -> DataFrame:
    """(preset_id, type, allowed): which types a pipeline still takes. After a split only one Deskew."""
    has = ops.groupBy("preset_id").agg(F.bool_or(F.col("type") == "SplitPage").alias("split"), F.bool_or(F.col("type") == "Deskew").alias("deskew"))
    kinds = has.withColumn("type", F.explode(F.array(*map(F.lit, TYPES))))
    return kinds.select("preset_id", "type", (~F.col("split") | ((F.col("type") == "Deskew") & ~F.col("deskew"))).alias("allowed"))


def branches(ops: DataFrame, checkpoints: DataFrame) -> DataFrame:
    """(preset_id, branch, steps, types): a prefix for each checkpoint (preset_id, position, name) and the full pipeline; a name used again in a preset gets a number."""
    whole_ = ops.groupBy("preset_id").agg(F.array_sort(F.collect_list(F.struct("position", "type"))).alias("all"))  # a pipeline is some operations
    ends = checkpoints.select("preset_id", "position", "name").unionByName(whole_.select("preset_id", F.size("all").alias("position"), F.lit(FULL).alias("name")).withColumn("position", F.col("position").cast("int")))
    full = (F.col("name") == FULL).cast("int")
    again = F.row_number().over(Window.partitionBy("preset_id", "name").orderBy("position", full))
    named = ends.withColumn("branch", F.when(again == 1, F.col("name")).otherwise(F.concat("name", F.lit(" "), again.cast("string"))))
    out = named.join(whole_, "preset_id").withColumn("types", F.transform(F.filter("all", lambda o: o["position"] <= F.col("position")), lambda o: o["type"]))
    return out.select("preset_id", "branch", F.size("types").alias("steps"), "types")


def compiled(ops: DataFrame) -> DataFrame:
    """(preset_id, text): each pipeline as it is saved: numbers of types, names, and all parameters."""
    found = values(ops, "display_name")
    said = F.when(F.col("kind") == "number", F.to_json(F.struct(F.col("number").alias("v")))).when(F.col("kind") == "choice", F.to_json(F.struct(F.col("option").alias("v")))).otherwise(F.to_json(F.struct(F.col("flag").alias("v"))))
    pair = F.concat(F.lit('"'), F.col("key"), F.lit('": '), F.regexp_extract(said, r'^\{"v":(.*)\}$', 1))
    texts = found.groupBy("preset_id", "position", "type", "display_name").agg(F.array_join(F.array_sort(F.collect_list(pair)), ", ").alias("pairs"))
    number = F.array_position(F.array(*map(F.lit, TYPES)), F.col("type")) - 1
    name = F.regexp_extract(F.to_json(F.struct(F.col("display_name").alias("v"))), r'^\{"v":(.*)\}$', 1)
    item = F.concat(F.lit('{"Type": '), number.cast("string"), F.lit(', "DisplayName": '), name, F.lit(', "Parameters": {'), "pairs", F.lit("}}"))
    rows = texts.groupBy("preset_id").agg(F.array_sort(F.collect_list(F.struct("position", item.alias("item")))).alias("items"))
    return rows.select("preset_id", F.concat(F.lit("["), F.array_join(F.transform("items", lambda x: x["item"]), ", "), F.lit("]")).alias("text"))
