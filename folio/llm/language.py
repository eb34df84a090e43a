"""Language ID (operator 6) by Bayesian evidence fusion.

Four sources of evidence meet in one posterior per document:

* the text: naive Bayes over hashed letter trigrams, learned from about ``PER_LANGUAGE`` labelled rows of each language, however rare it is among
  all; labels of fewer than ``LEAST_ROWS`` rows are no language. All tables together are bounded (``CELLS``; at most ``MOST_LANGUAGES``, those with the most
  rows). Trigrams of one text say much the same, so n of them count
  as sqrt(n) that are independent: evidence grows with the text, and what is ambiguous or short is left to the priors;
* the declared language (``<html lang=...>`` in the text, else the declared column), weighed by how often
  declarations agree with texts over the whole corpus;
* the suffix of the address, and
* the host: its language counts over the whole corpus, smoothed by those of its suffix, which are smoothed
  by those of the corpus. A host with addresses of several suffixes counts for each of them by itself. Counts
  come from grouped aggregation with map-side sums, one row a host, suffix and language.

Labels and declarations are compared by their primary part, without case (``EN``, ``en-US`` and ``en`` are one).

Rejected are documents whose best language stays under ``least``, with too few letters among their signs
(empty and null texts among them), or with ``SURE_TRIGRAMS`` trigrams or more that are as unlike their best language as texts of other languages are: those are
of languages that were not learned. Null declarations, hosts and addresses count as no evidence of their own
(null hosts share one prior). Ties go to the first language by code point. If no row has a language to learn
from, nothing can be told apart: language null, confidence 0, and documents with letters are kept. Repeated rows each get the same answer and count each; a very long text is
whole; an empty table gives an empty result; columns that ``documents`` (or ``pages``) doesn't have are ignored, also clashing ones.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from folio.llm.common import DOCUMENT, arrow_schema, conform, cut, fraction, map_batches

BITS = 17
CELLS = 1 << 22  # numbers in all tables together: with more than 32 languages there are fewer buckets
PER_LANGUAGE, LEAST_ROWS, MOST_LANGUAGES = 2_000, 3, 1_024
SURE_TRIGRAMS, FAR = 30, 0.8  # how far from a language's own rows towards those of others is no longer of it
SLICE = 300_000  # bytes of text at once: arrays of this size stay in the cache
MOST_BROADCAST, SALTS = 100_000, 64
HOST_WEIGHT, SUFFIX_WEIGHT = 20.0, 50.0
MARKUP = re.compile("<html", re.IGNORECASE)
LANG = re.compile(r"""\blang\s*=\s*["']?([A-Za-z]{2,3})""", re.IGNORECASE)
LETTER = np.array([chr(i).isalpha() for i in range(0x110000)])


@dataclass
class Model:
    languages: list[str]
    table: np.ndarray  # log likelihood of trigrams, by bucket and language
    floor: np.ndarray | None = None  # of each language, the mean log likelihood under which a text is of none


def trigrams(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Buckets of all trigrams that hold a letter, whose they are, and the share of letters among the signs of each text."""
    joined = "\n" + "\n\n\n".join(texts).lower() + "\n"  # a text counts the same wherever it stands in its slice
    codes = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32)
    lengths = np.array([len(t.lower()) for t in texts], np.int64)
    starts = np.cumsum(lengths + 3) - lengths - 2
    letters = LETTER[codes]
    codes = np.where(letters, codes, np.uint32(32))
    h = ((codes[:-2] * np.uint32(0x9E3779B1)) ^ (codes[1:-1] * np.uint32(0x85EBCA6B)) ^ (codes[2:] * np.uint32(0xC2B2AE35))) * np.uint32(0x27D4EB2F)
    used = np.flatnonzero(letters[1:-1])
    owner = np.searchsorted(starts, used + 1, "right") - 1
    of = np.bincount(np.searchsorted(starts, np.flatnonzero(letters), "right") - 1, minlength=len(texts))
    signs = np.array([len(t) - t.count(" ") - t.count("\n") for t in texts])
    return (h[used] >> np.uint32(32 - BITS)).astype(np.int32), owner, of / np.maximum(signs, 1)


def likelihoods(model: Model, texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sums of log likelihoods by text and language, trigrams of each text, and shares of letters."""
    h, owner, share = trigrams(texts)
    n, k = np.bincount(owner, minlength=len(texts)), len(model.languages)
    out = np.zeros((len(texts), k))
    if k and len(h):
        h = h >> (BITS - (len(model.table).bit_length() - 1))
        if k <= 16:
            for i in range(k):
                out[:, i] = np.bincount(owner, model.table[h, i], len(texts))
        else:  # a row of the table at a time
            for at in range(0, len(h), step := max(1, (1 << 22) // k)):
                part = owner[at : at + step]
                first = np.flatnonzero(np.diff(part, prepend=-1))
                out[part[first]] += np.add.reduceat(model.table[h[at : at + step]], first, axis=0, dtype=np.float64)
    return out, n, share


def log_likelihoods(model: Model, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    out, n, share = likelihoods(model, texts)
    return out / np.sqrt(np.maximum(n, 1))[:, None], share


def of_none(model: Model, sums: np.ndarray, n: np.ndarray, best: np.ndarray) -> np.ndarray:
    """Whether a text is far from what the rows of its language are like."""
    if model.floor is None:
        return np.zeros(len(n), bool)
    return (n >= SURE_TRIGRAMS) & (sums[np.arange(len(n)), best] < model.floor[best] * n)


COUNTS = T.StructType([T.StructField("lang", T.StringType()), T.StructField("n", T.LongType()), T.StructField("counts", T.BinaryType())])


def primary(label: Column) -> Column:
    """The primary part of a label, in lower case: en of EN, en-US and en_us; null where there is none."""
    lower = F.lower(F.trim(label))
    return F.nullif(F.when(lower.rlike("^[a-z]{2,3}[-_]"), F.regexp_extract(lower, "^[a-z]+", 0)).otherwise(lower), F.lit(""))


def primary_of(label: str) -> str:
    lower = label.strip(" ").lower()
    return m.group(1) if (m := re.match("([a-z]{2,3})[-_]", lower)) else lower


def train(docs: DataFrame, per_language: int = PER_LANGUAGE, least_rows: int = LEAST_ROWS) -> Model:
    """Trigram tables of all languages with ``least_rows`` labelled rows: of each about ``per_language`` rows, those of the lowest hash."""
    spark = docs.sparkSession
    rows = conform(docs, DOCUMENT).select(primary(F.col("lang")).alias("lang"), "text", "doc_id").where(F.col("lang").isNotNull() & F.col("text").isNotNull())
    labels = rows.groupBy("lang").count().where(F.col("count") >= least_rows).orderBy(F.col("count").desc(), "lang").limit(MOST_LANGUAGES).collect()
    if not labels:
        return Model([], np.zeros((1 << BITS, 0), np.float32))
    bits = min(BITS, (CELLS // len(labels)).bit_length() - 1)
    part = spark.createDataFrame([(r["lang"], min(1.0, per_language / r["count"])) for r in labels], "lang string, part double")
    taken = rows.join(F.broadcast(part), "lang").where((F.col("part") >= 1) | (fraction("doc_id", "text", seed=6) < F.col("part")))

    def run(batches):
        tables: dict[str, np.ndarray] = {}
        for b in batches:
            by: dict[str, list[str]] = {}
            for lang, text in zip(b["lang"].to_pylist(), b["text"].to_pylist()):
                by.setdefault(lang, []).append(text)
            for lang, texts in by.items():
                for at in range(0, len(texts), 500):
                    h, _, _ = trigrams(texts[at : at + 500])
                    tables[lang] = tables.get(lang, 0) + np.bincount(h >> (BITS - bits), minlength=1 << bits)
        schema = arrow_schema(COUNTS)
        for lang, t in tables.items():
            yield pa.RecordBatch.from_arrays([pa.array([lang]), pa.array([int(t.sum())]), pa.array([t.astype(np.float32).tobytes()], pa.binary())], schema=schema)

    found = sorted((r["lang"], r["counts"]) for r in taken.select("lang", "text").repartition("lang").mapInArrow(run, COUNTS).collect())
    counts = np.stack([np.frombuffer(c, np.float32) for _, c in found], axis=1).astype(np.float64)
    overall = counts.sum(axis=1, keepdims=True) + 0.1
    smooth = counts + 200.0 * overall / overall.sum()  # rare trigrams fall back to the corpus
    logs = np.log(smooth / smooth.sum(axis=0))
    met = (counts / np.maximum(counts.sum(axis=0), 1)).T @ logs  # the mean of each language's trigrams in each one's table
    own, k = np.diag(met), len(found)
    floor = own - FAR * (own - (met.sum(axis=0) - own) / (k - 1)) if k > 1 else None
    return Model([lang for lang, _ in found], logs.astype(np.float32), floor)


def suffix_of(address: Column, host: Column) -> Column:
    """The language-like part of an address: its first path segment of two letters, else the last label of a dotted host."""
    path = F.regexp_extract(F.coalesce(address, F.lit("")), r"^[a-zA-Z]+://[^/]*/([a-zA-Z]{2})(?:/|$)", 1)
    label = F.regexp_extract(F.coalesce(host, F.lit("")), r"\.([A-Za-z]{2,})$", 1)
    return F.lower(F.when(path != "", path).otherwise(label))


#: What is asked about: texts with their evidence; ``key`` and ``page`` only pass through.
EVIDENCE = ("text", "declared", "host", "suffix")
SEEN = T.StructType([T.StructField("host", T.StringType()), T.StructField("suffix", T.StringType()), T.StructField("declared", T.IntegerType()), T.StructField("best", T.IntegerType())])


def marked(text: str) -> str | None:
    """What the first html tag with a language declares, wherever it stands; each tag is read once."""
    at = 0 if "<" in text else len(text)
    while m := MARKUP.search(text, at):
        at = text.find(">", m.end())
        at = at if at >= 0 else len(text)
        if found := LANG.search(text, m.end(), at):
            return found.group(1).lower()
    return None


def declared_index(model: Model, texts: list[str], declared: list[str | None]) -> np.ndarray:
    """Number of the declared language: -1 none, and one past the last for a language that isn't known."""
    known = {x: i for i, x in enumerate(model.languages)}
    out = []
    for text, said in zip(texts, declared):
        said = marked(text) or (primary_of(said) if said else None)
        out.append(-1 if not said else known.get(said, len(known)))
    return np.array(out, np.int64)


def evidence(df: DataFrame, host: Column, declared: Column, address: Column | None = None) -> DataFrame:
    """``df`` with its own text and columns host, declared and suffix for :func:`identify`."""
    host = F.coalesce(host.cast("string"), F.lit(""))
    return df.withColumns({"evidence_declared": declared.cast("string"), "evidence_host": host, "evidence_suffix": suffix_of(address if address is not None else F.lit(None).cast("string"), host)})


def priors(df: DataFrame, model: Model) -> tuple[DataFrame, np.ndarray]:
    """(host, suffix, log prior of each language), and log P(declared | language); all rows of ``df`` count."""
    k = len(model.languages)
    shared = df.sparkSession.sparkContext.broadcast(model)

    def make():
        def step(batch: pa.RecordBatch) -> dict:
            texts = [t or "" for t in batch["text"].to_pylist()]
            ll, _ = log_likelihoods(shared.value, texts)
            return {"host": batch["host"], "suffix": batch["suffix"], "declared": declared_index(shared.value, texts, batch["declared"].to_pylist()), "best": ll.argmax(axis=1)}

        return step

    narrow = df.select("text", *[F.col(f"evidence_{c}").alias(c) for c in EVIDENCE[1:]])
    seen = cut(map_batches(narrow, SEEN, make, size=SLICE).groupBy("host", "suffix", "declared", "best").count())  # texts are read once for all sums
    pairs = seen.groupBy("declared", "best").agg(F.sum("count").alias("n")).collect()  # languages squared at most
    agree = np.full((k + 1, k), 0.02)
    total = np.ones(k)
    for r in pairs:
        total[r["best"]] += r["n"]
        if r["declared"] >= 0:
            agree[r["declared"], r["best"]] += r["n"]
    total /= total.sum()
    each = [F.sum(F.when(F.col("best") == i, F.col("count")).otherwise(0)).cast("double") for i in range(k)]
    by_host = seen.groupBy("host", "suffix").agg(F.array(*each).alias("own"))
    by_suffix = seen.groupBy("suffix").agg(F.array(*each).alias("around"))
    base = F.array(*[F.lit(float(x)) for x in total])
    size = lambda c: F.aggregate(c, F.lit(0.0), lambda a, x: a + x)
    smooth = lambda own, above, weight: F.zip_with(own, above, lambda n, p: (n + weight * p) / (size(own) + weight))
    joined = by_host.join(by_suffix, "suffix", "left")
    prior = smooth(F.col("own"), smooth(F.col("around"), base, SUFFIX_WEIGHT), HOST_WEIGHT)
    return joined.select(F.col("host").alias("prior_host"), F.col("suffix").alias("prior_suffix"), F.transform(prior, lambda p: F.log(p)).alias("prior")), np.log(agree / agree.sum(axis=0))


def with_priors(df: DataFrame, prior: DataFrame) -> DataFrame:
    """Texts stay where they are while hosts are counted to be ``MOST_BROADCAST`` at most; beyond that both sides meet by host and salt, so a hot host is many tasks."""
    prior = cut(prior)
    same = (F.col("evidence_host") == F.col("prior_host")) & (F.col("evidence_suffix") == F.col("prior_suffix"))
    if prior.count() <= MOST_BROADCAST:
        return df.join(F.broadcast(prior), same, "left")
    salted = prior.withColumn("prior_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    salt = (F.monotonically_increasing_id() % SALTS).cast("int")
    return df.withColumn("evidence_salt", salt).join(salted, same & (F.col("evidence_salt") == F.col("prior_salt")), "left")


VERDICT = [
    T.StructField("identified", T.StringType()),
    T.StructField("confidence", T.DoubleType()),
    T.StructField("text_lang", T.StringType()),
    T.StructField("kept", T.BooleanType()),
]


def identify(df: DataFrame, model: Model, carry: list[str], least: float = 0.5, least_letters: float = 0.2, strangers: bool = False) -> DataFrame:
    """The ``carry`` columns of ``df`` (made by :func:`evidence`), what was identified, how sure, and whether the document is kept.

    Texts that are like no learned language go unless ``strangers`` may stay, as raw pages do, whose markup is of no language.
    """
    fields = [df.schema[c] for c in carry] + VERDICT
    if not model.languages:
        prior, agree = None, None
        joined = df.withColumn("prior", F.lit(None).cast("array<double>"))
    else:
        prior, agree = priors(df, model)
        joined = with_priors(df, prior)
    shared = df.sparkSession.sparkContext.broadcast((model, agree))

    def make():
        model, agree = shared.value
        k = len(model.languages)

        def step(batch: pa.RecordBatch) -> dict:
            texts = [t or "" for t in batch["text"].to_pylist()]
            out = {c: batch[c] for c in carry}
            sums, n, share = likelihoods(model, texts)
            ll = sums / np.sqrt(np.maximum(n, 1))[:, None]
            if not k:
                return out | {"identified": [None] * len(texts), "confidence": [0.0] * len(texts), "text_lang": [None] * len(texts), "kept": share >= least_letters}
            declared = declared_index(model, texts, batch["evidence_declared"].to_pylist())
            given = np.array([p if p else [0.0] * k for p in batch["prior"].to_pylist()]).reshape(len(texts), k)
            both = ll + given + np.where(declared[:, None] >= 0, agree[declared], 0.0)
            p = np.exp(both - both.max(axis=1, keepdims=True))
            p /= p.sum(axis=1, keepdims=True)
            best, sure = p.argmax(axis=1), p.max(axis=1)
            name = np.array(model.languages, object)
            return out | {"identified": name[best].tolist(), "confidence": sure, "text_lang": name[ll.argmax(axis=1)].tolist(), "kept": (sure >= least) & (share >= least_letters) & (strangers | ~of_none(model, sums, n, best))}

        return step

    needed = dict.fromkeys([*carry, "text", "evidence_declared", "prior"])
    return map_batches(joined.select(*needed), T.StructType(fields), make, size=SLICE)


def identify_documents(docs: DataFrame, carry: list[str]) -> DataFrame:
    """For ``documents``: ``lang`` is the declared language, ``source`` the host."""
    rows = conform(docs, DOCUMENT)
    return identify(evidence(rows, F.col("source"), F.col("lang")), train(rows), carry)


def keep_identified(docs: DataFrame) -> DataFrame:
    """The documents that are kept, ``lang`` set to what was identified."""
    found = identify_documents(docs, DOCUMENT.names).where("kept")
    return found.select("doc_id", "text", F.coalesce("identified", "lang").alias("lang"), "source", "n_chars")


def identify_pages(pages: DataFrame, model: Model) -> DataFrame:
    """For ``pages`` (page_id, url, html): markup, path or host suffix, and the host of the address as evidence."""
    rows = conform(pages, T.StructType([T.StructField("page_id", T.LongType()), T.StructField("url", T.StringType()), T.StructField("html", T.StringType())]))
    host = F.regexp_extract(F.coalesce("url", F.lit("")), r"^[a-zA-Z]+://([^/:?#]+)", 1)
    return identify(evidence(rows.withColumnRenamed("html", "text"), host, F.lit(None).cast("string"), F.col("url")), model, ["page_id", "url"], strangers=True)
