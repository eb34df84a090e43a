"""PII (operator 9) by weak supervision, in DataFrame functions only.

Every text is searched whole for candidates of seven kinds. The four base kinds are kept as they match; the
other three (phones without a plus, spelled-out addresses, social security numbers) are weaker. Three
labelers vote on each candidate, yes, no or nothing: the form (regex), a gazetteer (top-level domains, country
codes, card issuers, reserved networks) and cue words in the 40 characters before. Expectation-maximisation over
the counts of vote patterns (a grouped sum of a few hundred rows at most, whatever the input) estimates the
prior of each kind and how reliable each labeler is; a logistic span classifier is then trained on the patterns
with the posteriors as soft labels, and its weights become a Column. Weaker candidates that it accepts are added.

Patterns are possessive, and sums over the matches of a text run in blocks (:func:`running`), so time is nearly linear in
the text and its matches. Null and empty texts have no spans. Repeated rows give repeated results; rows of null id are
rows; no candidates at all mean no model and no spans. The empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from math import exp, log

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folio.llm.common import DOCUMENT, conform, cut

#: Kinds in the order of the contract, the added ones last: (name, pattern, what a text must hold).
#: A match of the contract's pattern begins where a run of its first class does, or where the last match ended,
#: and never needs to give back what it took; said so, long runs cost no more than their length.
KINDS = (
    ("email", r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++", "@"),
    ("ip", r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++", "."),
    ("card", r"[0-9](?:[ -]?[0-9])++", None),
    ("phone", r"\+[0-9][ ().0-9-]+[0-9]", "+"),
    ("local_phone", r"(?<![0-9+.)-])(?:\([0-9]{3}\) ?|[0-9]{3}[ .-])[0-9]{3}[ .-][0-9]{4}(?![0-9.-])", None),
    ("spelled_email", r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]++ ?[\[(]at[\])] ?[A-Za-z0-9-]++(?: ?(?:\.|[\[(]dot[\])]) ?[A-Za-z0-9-]++)++", "at"),
    ("ssn", r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])", "-"),
)
BASE = 4
BYTE = "0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[0-9]{1,2})"
#: Gazetteers.
DOMAINS = "com|org|net|edu|gov|mil|int|info|biz|io|co|uk|de|fr|es|it|nl|be|ch|at|pl|pt|se|no|dk|fi|ie|us|ca|au|nz|jp|cn|in|br|mx|ar|ru|eu"
COUNTRIES = "1|7|20|27|3[0-469]|4[013-9]|5[1-8]|6[0-6]|8[1246]|9[0-58]|2[1-69][0-9]|35[0-9]|37[0-9]|38[0-9]|42[013]|50[0-9]|59[0-9]|67[0-9]|68[0-9]|85[0-9]|88[0-9]|9[679][0-9]"
CUES = "mail|contact|phone|tel|call|mobile|fax|sms|whatsapp|reach|address|host|server|card|visa|credit|payment|account|ssn|social|write to|correo|courriel|telefon|teléfono|téléphone"
AGAINST = r"version|isbn|issn|order|invoice|ref\b|page|chapter|section|doi|serial|build|release|figure|table"
LABELERS = ("form", "gazetteer", "context")


def digits(m: Column) -> Column:
    return F.regexp_replace(m, "[^0-9]", "")


def luhn(number: Column) -> Column:
    n = F.length(number)
    place = lambda i: F.substr(number, n - i, F.lit(1)).cast("int")  # noqa: E731  from the right
    value = lambda i: F.when(i % 2 == 0, place(i)).when(place(i) > 4, place(i) * 2 - 9).otherwise(place(i) * 2)
    return F.aggregate(F.sequence(F.lit(0), n - 1), F.lit(0), lambda a, i: a + value(i)) % 10 == 0


def valid(kind: str, m: Column) -> Column:
    n = F.length(digits(m))
    if kind == "ip":
        return m.rlike(rf"^{BYTE}(?:\.{BYTE}){{3}}$")
    if kind == "card":
        return n.between(14, 19) & F.when(n.between(14, 19), luhn(digits(m))).otherwise(False)
    if kind == "phone":
        return n.between(10, 15)
    return F.lit(True)


def gazetteer(kind: str, m: Column) -> Column:
    if "email" in kind:
        return m.rlike(rf"(?i)(?:{DOMAINS})$")
    if kind == "ip":
        return ~m.rlike(r"^(?:0+|127|255|22[4-9]|2[34][0-9])\.")
    if kind == "card":
        return m.rlike("^[3-6]")
    if kind == "phone":
        return digits(m).rlike(f"^(?:{COUNTRIES})")
    return ~digits(m).rlike("^(?:000|666|9)" if kind == "ssn" else "^[01]")


def form(kind: str, m: Column) -> Column:
    """The regex labeler: a clean form; for the weaker kinds no opinion unless it is spoiled."""
    if kind == "email":
        return ~m.rlike(r"\.\.|^[.-]|@-|[0-9]{12}")
    if kind in ("local_phone", "ssn"):
        return F.when(digits(m).rlike(r"^([0-9])\1+$|^1234"), False)
    return F.lit(True) if kind in ("ip", "card", "phone") else F.lit(None).cast("boolean")


def let(value: Column, body) -> Column:
    """``body`` of a value that is computed once, however often the body names it."""
    return F.element_at(F.transform(F.array(value), body), 1)


def running(values: Column, add, zero: int, block: int = 64) -> Column:
    """The running totals of an array of numbers, each with its own value in it.

    Arrays are copied when something is appended, so totals are taken within blocks and over the sums of blocks: the cost of
    n values is about n * block / 2 + (n / block) ** 2 / 2 copied numbers.
    """
    none, first = F.expr("cast(array() as array<int>)"), F.lit(zero).cast("int")
    starts = F.sequence(F.lit(1), F.greatest(F.size(values), F.lit(1)), F.lit(block))
    cut_up = let(values, lambda v: F.transform(starts, lambda at: F.slice(v, at, block)))
    # (last total, totals): the state after a block or a value
    step = lambda a, x: F.struct(add(a["at"], x).cast("int").alias("at"), F.array_append(a["out"], add(a["at"], x).cast("int")).alias("out"))

    def within(blocks: Column) -> Column:
        sums = F.transform(blocks, lambda b: F.aggregate(b, first, lambda a, x: add(a, x).cast("int")))
        after = F.aggregate(sums, F.struct(first.alias("at"), none.alias("out")), step, lambda a: a["out"])
        before = F.slice(F.concat(F.array(first), after), 1, F.size(blocks))
        return F.flatten(F.zip_with(blocks, before, lambda b, at: F.aggregate(b, F.struct(at.alias("at"), none.alias("out")), step, lambda a: a["out"])))

    return let(cut_up, within)


def candidates(text: Column, number: int) -> Column:
    """Array of (start, kind, end, votes of the labelers, width) of one kind; positions are code points."""
    kind, pattern, must = KINDS[number]
    pieces = F.zip_with(F.split(text, pattern, -1), F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), lambda gap, m: F.struct((F.length(gap) + F.coalesce(F.length(m), F.lit(0))).alias("width"), m.alias("m"), F.lower(F.substring(gap, -40, 40)).alias("near")))
    joined = let(pieces, lambda p: F.zip_with(p, running(F.transform(p, lambda x: x["width"]), lambda a, x: a + x, 0), lambda x, end: F.struct(end.alias("end"), x["m"].alias("m"), x["near"].alias("near"))))
    found = F.transform(F.filter(joined, lambda x: x["m"].isNotNull()), lambda x: F.struct((x["end"] - F.length(x["m"])).alias("start"), x["end"].alias("end"), x["m"].alias("m"), x["near"].alias("near")))
    placed = F.filter(found, lambda s: valid(kind, s["m"]))
    vote = lambda c: c.cast("int")
    voted = F.transform(
        placed,
        lambda s: F.struct(
            s["start"].alias("start"),
            F.lit(number).alias("kind"),
            s["end"].alias("end"),
            vote(form(kind, s["m"])).alias("form"),
            vote(gazetteer(kind, s["m"])).alias("gazetteer"),
            vote(F.when(s["near"].rlike(AGAINST), False).when(s["near"].rlike(CUES), True)).alias("context"),
            F.least(F.lit(3), F.floor(F.length(s["m"]) / 10)).cast("int").alias("width"),
        ),
    )
    here = F.contains(text, F.lit(must)) if must else text.rlike("[0-9][ ().-]?[0-9]")
    none = F.expr("cast(array() as array<struct<start: int, kind: int, end: int, form: int, gazetteer: int, context: int, width: int>>)")
    return F.when(here, voted).otherwise(none)


def estimate(patterns: list[tuple], rounds: int = 30) -> dict[tuple, float]:
    """Expectation-maximisation over (kind, votes...) -> count: each pattern's posterior of being personal data.

    Labelers err alike in all kinds; each kind has a prior of its own. Every parameter is smoothed towards a labeler that is right four times in five.
    """
    prior = dict.fromkeys({p[0] for p, _ in patterns}, 0.5)
    right = {(j, z): 0.8 for j in range(len(LABELERS)) for z in (0, 1)}  # P(vote = z | truth z)
    posterior: dict[tuple, float] = {}
    for _ in range(rounds):
        for p, _ in patterns:
            odds = log(prior[p[0]] / (1 - prior[p[0]]))
            for j, v in enumerate(p[1 : 1 + len(LABELERS)]):
                if v is not None:
                    yes = right[j, 1] if v else 1 - right[j, 1]
                    no = 1 - right[j, 0] if v else right[j, 0]
                    odds += log(yes / no)
            posterior[p] = 1 / (1 + exp(-max(-30.0, min(30.0, odds))))
        for kind in prior:
            own = [(posterior[p], n) for p, n in patterns if p[0] == kind]
            prior[kind] = (1 + sum(q * n for q, n in own)) / (2 + sum(n for _, n in own))
        for j, z in right:
            seen = [((posterior[p] if z else 1 - posterior[p]) * n, p[1 + j] == z) for p, n in patterns if p[1 + j] is not None]
            weight = sum(w for w, _ in seen)
            smooth = 4 + 0.05 * weight
            right[j, z] = min(0.995, max(0.5, (0.8 * smooth + sum(w for w, ok in seen if ok)) / (smooth + weight)))
    return posterior


def features(p: tuple) -> list[tuple[str, object]]:
    """Named values of a pattern (kind, votes..., width)."""
    return [("kind", p[0]), *((name, v) for name, v in zip(LABELERS, p[1:]) if v is not None), ("width", p[-1])]


def fit(patterns: list[tuple], posterior: dict[tuple, float], steps: int = 400, rate: float = 0.5, decay: float = 1e-3) -> dict:
    """Logistic regression on patterns with soft labels; returns weights by (name, value) and the bias under None."""
    weights: dict = {None: 0.0}
    total = sum(n for _, n in patterns) or 1
    for _ in range(steps):
        slope: dict = {}
        for p, n in patterns:
            named = [None, *features(p)]
            s = 1 / (1 + exp(-max(-30.0, min(30.0, sum(weights.get(f, 0.0) for f in named)))))
            for f in named:
                slope[f] = slope.get(f, 0.0) + (s - posterior[p]) * n / total
        for f, g in slope.items():
            weights[f] = weights.get(f, 0.0) - rate * (g + decay * weights.get(f, 0.0))
    return weights


def searched(docs: DataFrame) -> DataFrame:
    text = F.coalesce("text", F.lit(""))
    return conform(docs, DOCUMENT).select("doc_id", F.sort_array(F.concat(*[candidates(text, k) for k in range(len(KINDS))])).alias("found"))


def find(docs: DataFrame, least: float = 0.5) -> DataFrame:
    """One row per document: counts of the base kinds, their digest, and all spans."""
    rows = cut(searched(docs))  # narrow: texts are searched once, for training and for the result
    names = ["kind", *LABELERS, "width"]
    counted = rows.select(F.explode("found").alias("s")).groupBy(*[F.col(f"s.{c}").alias(c) for c in names]).count().collect()  # 7 * 27 * 4 at most
    patterns = sorted((((*(r[c] for c in names),), r["count"]) for r in counted), key=str)
    weights = fit(patterns, estimate(patterns))

    def accepted(s: Column) -> Column:
        total = F.lit(float(weights[None]))
        for f, w in weights.items():
            if f is not None:
                total = total + F.when(s[f[0]] == f[1], F.lit(float(w))).otherwise(F.lit(0.0))
        return (s["kind"] < BASE) | (total >= log(least / (1 - least)))

    named = F.array(*[F.lit(k[0]) for k in KINDS])
    told = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.element_at(named, s["kind"] + 1), s["start"].cast("string"), s["end"].cast("string"))), ",")
    base = F.filter("found", lambda s: s["kind"] < BASE)
    # Weaker spans that meet a base span go: the furthest end of base spans before, and the nearest start of one after.
    reach = running(F.transform("found", lambda s: F.when(s["kind"] < BASE, s["end"]).otherwise(0)), F.greatest, 0)
    next_ = F.reverse(running(F.reverse(F.transform("found", lambda s: F.when(s["kind"] < BASE, s["start"]).otherwise(2**31 - 1))), F.least, 2**31 - 1))
    apart = F.filter(F.arrays_zip(F.col("found").alias("s"), reach.alias("reach"), next_.alias("next")), lambda x: (x["s"]["kind"] < BASE) | ((x["reach"] <= x["s"]["start"]) & (x["next"] >= x["s"]["end"])))
    spans = F.filter(F.when(F.exists("found", lambda s: s["kind"] >= BASE), F.transform(apart, lambda x: x["s"])).otherwise(F.col("found")), accepted)
    counts = [F.size(F.filter("found", _is(number))).cast("long").alias(f"n_{KINDS[number][0]}") for number in range(BASE)]
    return rows.select("doc_id", *counts, F.sha2(told(base), 256).alias("base_sha256"), told(spans).alias("spans"))


def _is(number: int):
    return lambda s: s["kind"] == number
