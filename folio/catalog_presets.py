"""Queries of presets in bulk: texts of saved pipelines made of all events, five to a preset, with every way to spell a value and texts that can't be read."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folio import rasters
from folio.catalog import register
from folio.plans import preset_tables
from folio.plans.presets import REGISTRY, SPELLINGS, TYPES, Choice, Flag, Number

BACK = {new: old for old, new in SPELLINGS.items()}


def case(on: str, forms: list[str]) -> str:
    return f"CASE {on} " + " ".join(f"WHEN {i} THEN '{f}'" for i, f in enumerate(forms)) + " END"


def forms_of(kind: Number | Choice | Flag) -> list[str]:
    """Eight ways in which a preset may say a value of this kind, as JSON."""
    if isinstance(kind, Choice):
        return [f'"{kind.options[-1]}"', f'"{kind.options[1].upper()}"', "1", "0", "-1", '"none"', "99", "true"]
    if isinstance(kind, Flag):
        return ["true", "false", "0", "2", '"TRUE"', '" false "', "1.5", '"yes"']
    middle = (kind.least + kind.most) / 2
    return [f"{middle}", f'"{middle}"', '" 7 "', "1e3", "true", "null", '"x"', "-100000"]


def parameters_text() -> str:
    """The parameters of an operation as SQL that both engines take, by its type k % 12."""
    whens = []
    for at, name in enumerate(TYPES):
        by_kind: dict[type, list[str]] = {}
        for key, kind in REGISTRY[name].items():
            by_kind.setdefault(type(kind), []).append(key)
        pairs = []
        for key, on in zip([*by_kind.get(Choice, [])[:2], *by_kind.get(Flag, [])[:3], *by_kind.get(Number, [])[:3]], ("event_id % 8", "k % 8", "(event_id + k) % 8", "k % 7", "event_id % 7", "(event_id + 3 * k) % 8", "k % 5", "event_id % 6")):
            pairs.append(f"""'"{BACK.get(key, key)}": ' || {case(on, forms_of(REGISTRY[name][key]))}""")
        whens.append(f"""WHEN {at} THEN {" || ', ' || ".join(pairs)}""")
    return f"CASE k % 12 {' '.join(whens)} ELSE '\"other\": [1, 2]' END"


#: One operation an event.
ITEM = f"""'{{' || {case("k % 3", ['"Type"', '"type"', '"TYPE"'])} || ': ' || CASE WHEN k = 71 THEN '"2"' ELSE CAST(k % 12 AS STRING) END || ', "DisplayName": "' || CASE WHEN k % 4 = 0 THEN '' ELSE event_type END || '", "Parameters": {{"unknown": {{"a": [1]}}, ' || {parameters_text()} || '}}}}'"""
#: All operations of a preset, some texts of which are broken, missing, empty or no array.
TEXT = """CASE WHEN preset_id % 13 = 5 THEN left(items, length(items) - 1) WHEN preset_id % 17 = 3 THEN NULL WHEN preset_id % 19 = 2 THEN '[]' WHEN preset_id % 23 = 1 THEN '{"a": 1}' WHEN preset_id % 29 = 7 THEN '  ' ELSE items END"""
EVENT = "SELECT event_id, event_type, coalesce(TRY_CAST(regexp_extract(props, '([0-9]+)', 1) AS INT), 0) AS k, CAST(floor(event_id / 5) AS BIGINT) AS preset_id FROM {}"

_REGISTRY = ", ".join(
    f"('{t}', '{k}', '{kind}', {n if n is not None else 'NULL'}::DOUBLE, {lo if lo is not None else 'NULL'}::DOUBLE, {hi if hi is not None else 'NULL'}::DOUBLE, {[*o] if o else 'NULL'}::VARCHAR[], {repr(d) if d else 'NULL'}::VARCHAR, {f if f is not None else 'NULL'}::BOOLEAN)"
    for t, k, kind, n, lo, hi, o, d, f in preset_tables.registry_rows()
)
_RULES = ", ".join(f"('{t}', '{k}', '{c}', {allowed}::VARCHAR[])" for t, k, c, allowed in preset_tables.rule_rows())
PRESETS = f"""item AS (SELECT event_id, preset_id, {ITEM} AS item FROM ({EVENT.format("events")})),
  joined AS (SELECT preset_id, '[' || string_agg(item, ', ' ORDER BY event_id) || ']' AS items FROM item GROUP BY preset_id), presets AS (SELECT preset_id, {TEXT} AS text FROM joined)"""
OPERATIONS = f"""{PRESETS}, read AS MATERIALIZED (SELECT preset_id, text, CASE WHEN json_valid(text) THEN CASE WHEN json_type(text) = 'ARRAY' THEN CAST(json_array_length(text) AS BIGINT) END END AS n FROM presets),
  elements AS (SELECT preset_id, idx, json_extract(text, '$[' || idx || ']') AS item FROM (SELECT preset_id, text, unnest(range(n)) AS idx FROM read WHERE n > 0)),
  typed AS (SELECT preset_id, idx, item, coalesce(json_extract(item, '$.Type'), json_extract(item, '$.type'), json_extract(item, '$.TYPE')) AS t FROM elements),
  named AS (SELECT preset_id, idx, item, {list(TYPES)}[CAST(t AS INT) + 1] AS type FROM typed WHERE json_type(t) = 'UBIGINT' AND CAST(t AS INT) < 10),
  marked AS (SELECT *, min(CASE WHEN type = 'SplitPage' THEN idx END) OVER p AS split, min(CASE WHEN type = 'Deskew' THEN idx END) OVER p AS deskew FROM named WINDOW p AS (PARTITION BY preset_id)),
  kept AS (SELECT preset_id, idx, type, coalesce(nullif(item->>'$.DisplayName', ''), type) AS display_name, json_extract(item, '$.Parameters') AS given FROM marked WHERE split IS NULL OR idx = split OR (idx = deskew AND idx < split)
    UNION ALL SELECT preset_id, idx, type, type, NULL FROM read, (VALUES (0, 'BordersRemove'), (1, 'Binarize')) d(idx, type) WHERE coalesce(n, 0) = 0),
  ops AS (SELECT preset_id, row_number() OVER (PARTITION BY preset_id ORDER BY idx) AS position, type, display_name, given FROM kept)"""
VALUES = f"""{OPERATIONS}, registry(type, key, kind, number, least, most, options, option, flag) AS (VALUES {_REGISTRY}),
  raws AS (SELECT o.preset_id, o.position, r.*, json_extract(given, '$."' || key || '"') AS raw, CASE key {" ".join(f"WHEN '{new}' THEN json_extract(given, '$.{old}')" for old, new in SPELLINGS.items())} END AS old FROM ops o JOIN registry r ON r.type = o.type),
  said AS (SELECT *, json_type(coalesce(raw, old)) AS j, coalesce(raw, old)->>'$' AS s FROM raws),
  found AS (SELECT preset_id, position, type, key, kind,
    CASE WHEN kind = 'number' THEN least(most, greatest(least, coalesce(CASE WHEN j IN ('UBIGINT', 'BIGINT', 'DOUBLE', 'VARCHAR') THEN TRY_CAST(trim(s) AS DOUBLE) END, number))) END AS number,
    CASE WHEN kind = 'choice' THEN coalesce(CASE WHEN j = 'VARCHAR' THEN coalesce(list_filter(options, lambda o: o = s)[1], list_filter(options, lambda o: lower(o) = lower(s))[1]) WHEN j = 'UBIGINT' THEN options[CAST(s AS INT) + 1] END, option) END AS option,
    CASE WHEN kind = 'flag' THEN coalesce(CASE WHEN j = 'BOOLEAN' THEN s = 'true' WHEN j IN ('UBIGINT', 'BIGINT') THEN CAST(s AS INT) <> 0 WHEN j = 'VARCHAR' AND lower(trim(s)) IN ('true', 'false') THEN lower(trim(s)) = 'true' END, flag) END AS flag FROM said)"""


def presets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(preset_id, text) of all events."""
    events = rasters.table(spark, sf_dir, "events").select("event_id", "event_type", F.expr("coalesce(try_cast(regexp_extract(props, '([0-9]+)', 1) as int), 0)").alias("k"), F.expr("cast(floor(event_id / 5) as bigint)").alias("preset_id"))
    items = events.select("event_id", "preset_id", F.expr(ITEM).alias("item")).groupBy("preset_id").agg(F.array_sort(F.collect_list(F.struct("event_id", "item"))).alias("of"))
    return items.select("preset_id", F.concat(F.lit("["), F.array_join(F.transform("of", lambda o: o["item"]), ", "), F.lit("]")).alias("items")).select("preset_id", F.expr(TEXT).alias("text"))


def operations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return preset_tables.operations(presets(spark, sf_dir))


def checkpoints(ops: DataFrame) -> DataFrame:
    """A checkpoint after each Binarize and Enhance, under the name of the operation."""
    return ops.where(F.col("type").isin("Binarize", "Enhance")).select("preset_id", "position", F.lower("type").alias("name"))


register("o142_preset_operations", "SELECT preset_id, position, type, display_name FROM ops", OPERATIONS)(lambda spark, d: operations(spark, d).select("preset_id", F.col("position").cast("bigint").alias("position"), "type", "display_name"))
register("o143_preset_values", "SELECT preset_id, position, key, kind, round(number, 6) AS number, option, flag FROM found", VALUES)(
    lambda spark, d: preset_tables.values(operations(spark, d)).select("preset_id", F.col("position").cast("bigint").alias("position"), "key", "kind", F.round("number", 6).alias("number"), "option", "flag")
)
register("o145_may_add", f"SELECT preset_id, t AS type, NOT bool_or(o.type = 'SplitPage') OR (t = 'Deskew' AND NOT bool_or(o.type = 'Deskew')) AS allowed FROM ops o, (SELECT unnest({list(TYPES)}) AS t) GROUP BY preset_id, t", OPERATIONS)(
    lambda spark, d: preset_tables.may_add(operations(spark, d))
)
register(
    "o146_preset_branches",
    """SELECT preset_id, CASE n WHEN 1 THEN name ELSE name || ' ' || n END AS branch, position AS steps, (SELECT string_agg(o.type, ' > ' ORDER BY o.position) FROM ops o WHERE o.preset_id = e.preset_id AND o.position <= e.position) AS types
    FROM (SELECT *, row_number() OVER (PARTITION BY preset_id, name ORDER BY position) AS n FROM (
      SELECT preset_id, position, lower(type) AS name FROM ops WHERE type IN ('Binarize', 'Enhance') UNION ALL SELECT preset_id, max(position), 'Full pipeline' FROM ops GROUP BY preset_id)) e""",
    OPERATIONS,
)(lambda spark, d: (lambda ops: preset_tables.branches(ops, checkpoints(ops)).select("preset_id", "branch", F.col("steps").cast("bigint").alias("steps"), F.array_join("types", " > ").alias("types")))(operations(spark, d)))
register(
    "o148_preset_visible",
    """SELECT f.preset_id, f.position, f.key, coalesce(bool_and(list_contains(u.allowed, coalesce(c.option, CAST(c.flag AS VARCHAR)))), true) AS visible
    FROM found f LEFT JOIN rules u ON u.type = f.type AND u.key = f.key LEFT JOIN found c ON c.preset_id = f.preset_id AND c.position = f.position AND c.key = u.control GROUP BY f.preset_id, f.position, f.key""",
    VALUES,
    f"rules(type, key, control, allowed) AS (VALUES {_RULES})",
)(lambda spark, d: preset_tables.asked(operations(spark, d)).select("preset_id", F.col("position").cast("bigint").alias("position"), "key", "visible"))
register(
    "o141_preset_round_trip",
    "SELECT key, kind, count(*) AS n, round(sum(number), 3) AS total, count(DISTINCT option) AS options, CAST(count(*) FILTER (WHERE flag) AS BIGINT) AS flags FROM found GROUP BY key, kind",
    VALUES,
)(
    lambda spark, d: preset_tables.values(preset_tables.operations(preset_tables.compiled(operations(spark, d))))
    .groupBy("key", "kind")
    .agg(F.count("*").alias("n"), F.round(F.sum("number"), 3).alias("total"), F.countDistinct("option").alias("options"), F.count_if("flag").alias("flags"))
)
