"""Secret scans (operator 4).

Three fixed patterns give the base spans. In addition, values that stand in a credential context
("pwd: ...", "Authorization: Bearer ...") are priced by the number of guesses that an informed
attacker needs: a dynamic programme over the value finds the cheapest segmentation into common
words, dates, repeats, keyboard walks and brute-force spans. Expensive values become ``guess`` spans, whatever
characters they are of. The words are a short list of usual passwords and the whole words of the public 32k piece
vocabulary by rank, so that prose in credential context ("the password is ...") stays cheap.

Null and empty texts have no spans. Repeated rows give repeated results. Texts are scanned whole.
"""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_left
from functools import cache
from itertools import accumulate
from math import log2

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from folio.llm.common import DOCUMENT, conform, documents, map_batches
from folio.llm.pieces import DEFAULT_MODEL, MARK

#: The base patterns, as the contract has them.
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
# A run that starts or holds a match is maximal, so asking for the length at once finds the same spans.
ACCESS = re.compile(r"AKIA[A-Z0-9]{16,}")
HEX = re.compile(r"[0-9a-f]{24,}")
KINDS = ("assign", "access", "hex", "guess")

#: Where a value may be a credential. The value is the last group.
CONTEXT = re.compile(
    r"""(?<![A-Za-z0-9])(?:pass(?:word|wd|phrase|code)?|pwd|pin|secret|token|api[_-]?key|(?:access|private|client|account)[_-]?(?:key|secret)|auth(?:orization)?|bearer|credentials?|login)\b["']?\s{0,4}(?:(?::=|=>|[:=])\s{0,4}|\bis\s{1,4})(?:bearer\s{1,4})?["']?([^\s"'<>,;]{6,})""",
    re.IGNORECASE | re.ASCII,
)
#: Words that guessers try first, most usual first.
COMMON = """password admin welcome login letmein monkey dragon football baseball master sunshine princess shadow
superman michael jordan hunter ranger buster soccer harley batman andrew tigger charlie robert thomas hockey killer
george summer winter spring autumn secret token key access user root test guest demo default change changeme system
server database oracle public private example sample hello world love money pass code love star blue green black white
orange silver golden london paris computer internet service manager office""".split()
KEYBOARD = ("`1234567890-=", "qwertyuiop[]", "asdfghjkl;'", "zxcvbnm,./", "abcdefghijklmnopqrstuvwxyz")
PLAIN = str.maketrans("430@$51!7", "aeoassiit")
DATE = re.compile(r"(?=((?:19|20)\d\d([-/._]?)(?:0[1-9]|1[0-2])\2(?:0[1-9]|[12]\d|3[01])|(?:0[1-9]|[12]\d|3[01])([-/._]?)(?:0[1-9]|1[0-2])\3(?:19|20)\d\d))")
YEAR = re.compile(r"(?=((?:19|20)\d\d))")
REPEAT = re.compile(r"(.{1,8}?)\1{2,}", re.DOTALL)
NEXT_TO = {(a, b) for row in KEYBOARD for x, y in zip(row, row[1:]) for a, b in ((x, y), (y, x))}
SEGMENT_BITS = 1.0  # an attacker tries short segmentations first


@cache
def word_bits() -> tuple[dict[str, float], int]:
    """Bits of words by rank, the usual ones before the whole words (three letters or more) of the vocabulary; and the most letters."""
    import sentencepiece as sp

    m = sp.SentencePieceProcessor(model_file=DEFAULT_MODEL)
    pieces = map(m.id_to_piece, range(m.get_piece_size()))
    whole = (p[1:].lower() for p in pieces if p.startswith(MARK))
    words = dict.fromkeys([*COMMON, *(w for w in whole if len(w) > 2 and w.isalpha())])
    return {w: log2(rank + 2) for rank, w in enumerate(words)}, max(map(len, words))


def char_bits(c: str) -> float:
    """Brute-force bits of one character by its class."""
    if c.isdigit() and c.isascii():
        return log2(10)
    if c.isalpha() and c.isascii():
        return log2(26)
    return log2(33) if c.isascii() else log2(1000)


def segments(value: str) -> list[tuple[int, int, float, str]]:
    """(start, end, bits, what) of all patterned spans of a value."""
    low, found = value.lower(), []
    plain, n, (words, longest) = low.translate(PLAIN), len(value), word_bits()
    for i in range(n):
        for j in range(i + 3, min(n, i + longest) + 1):
            bits = words.get(low[i:j])
            if bits is None and (other := words.get(plain[i:j])) is not None:
                bits = other + 1.5
            if bits is not None:
                found.append((i, j, bits + (value[i:j] != low[i:j]), "word"))
    for pattern, bits, what in ((DATE, log2(365 * 120 * 4), "date"), (YEAR, log2(120), "date")):
        found += [(m.start(1), m.end(1), bits, what) for m in pattern.finditer(value)]
    for m in REPEAT.finditer(value):
        unit = m.group(1)
        found.append((m.start(), m.end(), sum(map(char_bits, unit)) + log2(len(m.group()) // len(unit)), "repeat"))
    i = 0
    while i < n - 2:
        j = i + 1
        while j < n and (low[j - 1], low[j]) in NEXT_TO:
            j += 1
        if j - i >= 3:
            found.append((i, j, log2(47) + log2(j - i), "walk"))
        i = max(j - 1, i + 1)
    return found


def guess_bits(value: str) -> float:
    """log2 of the guesses of the cheapest segmentation; linear in the length of the value."""
    ending: dict[int, list[tuple[int, float]]] = {}
    for i, j, bits, _ in segments(value):
        ending.setdefault(j, []).append((i, bits + SEGMENT_BITS))
    best, brute = [0.0], [float("inf")]  # brute: the last span is brute force
    for j, c in enumerate(value, 1):
        spent = char_bits(c)
        brute.append(min(best[j - 1] + SEGMENT_BITS, brute[j - 1]) + spent)
        best.append(min([brute[j], *(best[i] + bits for i, bits in ending.get(j, ()))]))
    return best[-1]


def spans_of(text: str, least_bits: float) -> tuple[list[tuple[int, int, int]], float]:
    """(start, number of kind, end) in order, and the most bits of any value in context."""
    found = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 6]
    found += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text)]
    found += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    covered, most = sorted((a, b) for a, _, b in found), 0.0
    reach = list(accumulate((b for _, b in covered), max))  # how far the first spans go
    for m in CONTEXT.finditer(text):
        value = m.group(1)
        most = max(most, bits := guess_bits(value))
        before = bisect_left(covered, (m.end(1),))  # spans that begin before the value ends
        if bits >= least_bits and not (before and reach[before - 1] > m.start(1)):
            found.append((m.start(1), 3, m.end(1)))
    return sorted(found), most


def told(found: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in found)


SCAN = T.StructType(
    [T.StructField("doc_id", T.LongType())]
    + [T.StructField(f"n_{k}", T.LongType()) for k in KINDS]
    + [T.StructField("base_sha256", T.StringType()), T.StructField("spans", T.StringType()), T.StructField("max_guess_bits", T.DoubleType())]
)


def scan(docs: DataFrame, least_bits: float = 36.0) -> DataFrame:
    """One row per document with its secret spans (code points, end exclusive)."""

    def make():
        def step(batch: pa.RecordBatch) -> dict:
            out: dict[str, list] = {f.name: [] for f in SCAN}
            for i, text in zip(batch["doc_id"].to_pylist(), batch["text"].to_pylist()):
                found, most = spans_of(text or "", least_bits)
                out["doc_id"].append(i)
                for k, kind in enumerate(KINDS):
                    out[f"n_{kind}"].append(sum(x[1] == k for x in found))
                out["base_sha256"].append(hashlib.sha256(told([x for x in found if x[1] < 3]).encode()).hexdigest())
                out["spans"].append(told(found))
                out["max_guess_bits"].append(most)
            return out

        return step

    return map_batches(documents(docs).select("doc_id", "text"), SCAN, make)


def redact(docs: DataFrame, mark: str = "<secret>", least_bits: float = 36.0) -> DataFrame:
    """The documents with each run of overlapping secret spans replaced by ``mark``; n_chars follows.

    No document goes; texts without secrets, and null texts, stay as they are.
    """

    def make():
        def clean(text: str | None) -> str | None:
            found, _ = spans_of(text or "", least_bits)
            if not found:
                return text
            parts, at = [], 0
            for a, _, b in found:
                if a >= at:
                    parts += [text[at:a], mark]
                at = max(at, b)
            return "".join([*parts, text[at:]])

        def step(batch: pa.RecordBatch) -> dict:
            out = {name: batch[name] for name in batch.schema.names}
            was = batch["text"].to_pylist()
            out["text"] = [clean(t) for t in was]
            out["n_chars"] = [n if t == old else len(t) for n, t, old in zip(batch["n_chars"].to_pylist(), out["text"], was)]
            return out

        return step

    return map_batches(conform(docs, DOCUMENT), DOCUMENT, make)
