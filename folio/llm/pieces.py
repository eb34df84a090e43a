"""SentencePiece encoding and decoding (operator 10) by a shared-prefix forward pass.

Text is marked as SentencePiece does it (a dummy mark in front, spaces become marks) and cut where
no piece of the vocabulary can cross. Per slice of documents the *distinct* marked words are sorted,
which is a depth-first walk of their trie: the stack of forward states of the common prefix with the
word before is kept and only the new characters are scored. A task keeps the ids of ``RECENT`` words at most from one slice to
the next, so words that come again and again are walked once.

What a forward state is depends on the kind of the model:

* unigram: the best sum of scores of a segmentation of the prefix, and its last piece (Viterbi);
* BPE (as in the public 32k file): scores are merge ranks, and the best sum of them is *not* what the
  library returns. The state is then the last piece of the prefix's own encoding: of the pieces that
  end here, the one whose neighbour on its left is the last piece of the remaining prefix and for
  which the two alone encode to themselves. That piece is unique, and prefixes of an encoding are
  encodings, so the same walk and the same reuse give exactly the library's ids.

Null texts count as empty (no ids). Decoding of the ids gives the text back exactly, except that a
mark U+2581 in the text itself returns as a space, as in the library; ``round_trip`` says whether it did.
"""

from __future__ import annotations

import gc
import hashlib
import os
import re
from array import array
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from folio.llm.common import DOCUMENT, conform, documents, map_batches

MARK = "▁"
DEFAULT_MODEL = "/opt/tokenizers/piece_bpe_32k.model"
NORMAL, UNKNOWN, BYTE = 1, 2, 6  # kinds of pieces that matter here
FLOOR = -1e30
MOVES = 400_000  # of the automaton that are kept
RECENT = 300_000  # words whose ids a worker keeps between slices


class Vocabulary:
    """Pieces, scores and kinds; ``bpe`` says which forward state is meant. Ids of words are kept as the bytes of int32 numbers."""

    def __init__(self, pieces: list[str], scores: list[float], kinds: list[int], bpe: bool):
        self.pieces, self.bpe = pieces, bpe
        self.ids = {p: i for i, p in enumerate(pieces) if kinds[i] == NORMAL}
        self.scores = {p: scores[i] for p, i in self.ids.items()}
        self.bytes = {int(p[3:5], 16): i for i, p in enumerate(pieces) if kinds[i] == BYTE}
        self.unknown = next((i for i, k in enumerate(kinds) if k == UNKNOWN), 0)
        self.single = {p for p in self.ids if len(p) == 1}
        self.shown = list(pieces)
        for b, i in self.bytes.items():
            self.shown[i] = chr(b if b < 128 else 0xDC00 + b)
        self.begun = {p[:k] for p in self.ids for k in range(len(p) + 1)} | {""}
        self.checked: dict[str, dict[str, bool]] = {}  # piece -> piece before it -> whether the two stay
        self.n_checked = 0
        self.nodes: dict[str, tuple[list, dict]] = {}
        self.n_moves = 0
        self.root = self.node("")
        self.recent: dict[str, bytes] = {}
        self.penalty = min(self.scores.values(), default=0.0) - 10.0

    def of_char(self, c: str) -> list[int]:
        """Ids of a character that is no piece: its bytes, or the unknown piece."""
        return [self.bytes[b] for b in c.encode("utf-8", "surrogatepass")] if self.bytes else [self.unknown]

    def node(self, end: str) -> tuple[list, dict]:
        """A state of the automaton over all pieces, by the longest end of the text that begins a piece: the pieces that
        end here, longest first, each with its length and what is known of its neighbours; and the states after it."""
        if end not in self.nodes:
            here = [end[k:] for k in range(len(end)) if end[k:] in self.ids]
            self.nodes[end] = ([(len(p), p, self.checked.setdefault(p, {})) for p in here], {"": end})
        return self.nodes[end]

    def after(self, node: tuple[list, dict], c: str) -> tuple[list, dict]:
        end = node[1][""] + c
        while end not in self.begun:
            end = end[1:]
        got = self.node(end)
        if end:  # characters of no piece are too many to be kept
            node[1][c] = got
            self.n_moves += 1
            if self.n_moves > MOVES:
                self.nodes, self.n_moves = {}, 0
        return got

    def stays(self, left: str, right: str) -> bool:
        """Whether the merges leave just these two pieces of their concatenation."""
        if self.n_checked > 500_000:
            for known in self.checked.values():
                known.clear()
            self.n_checked = 0
        self.n_checked += 1
        got = self.checked[right][left] = merged(left + right, self.scores) == [x for x in (left, right) if x]
        return got

    def encode_sorted(self, words: list[str]) -> dict[str, bytes]:
        """Ids of sorted distinct words; each prefix is scored once."""
        out, before = {}, ""
        # By length of the prefix: last piece, what it is to its neighbour (nothing, if it is no piece), best sum (unigram), state.
        last, left, score, nodes = [""], [""], [0.0], [self.root]
        ids, scores, single, bpe = self.ids, self.scores, self.single, self.bpe
        for word in words:
            shared = 0
            for a, b in zip(before, word):
                if a != b:
                    break
                shared += 1
            del last[shared + 1 :], left[shared + 1 :], score[shared + 1 :], nodes[shared + 1 :]
            node, end = nodes[shared], shared
            for c in word[shared:]:
                node = node[1].get(c) or self.after(node, c)
                end += 1
                chosen, own, top = c, c if c in single else "", FLOOR
                if bpe:
                    for n, piece, known in node[0]:
                        stays = known.get(left[end - n])
                        if stays if stays is not None else self.stays(left[end - n], piece):
                            chosen = own = piece
                            break
                else:
                    for n, piece, _ in node[0]:
                        if (s := score[end - n] + scores[piece]) > top:
                            chosen, top = piece, s
                    if c not in single and (s := score[end - 1] + self.penalty) > top:
                        chosen, top = c, s
                last.append(chosen)
                left.append(own)
                score.append(top)
                nodes.append(node)
            found, end = [], len(word)
            while end:
                piece = last[end]
                found.append(piece)
                end -= len(piece)
            got: list[int] = []
            for piece in reversed(found):
                if piece in ids:
                    got.append(ids[piece])
                else:
                    got += self.of_char(piece)
            out[word] = array("i", got).tobytes()
            before = word
        return out

    def encode_batch(self, texts: list[str]) -> list[np.ndarray]:
        """Ids of each text, by the distinct words of all of them. Words of texts just before are not encoded again."""
        seen: dict[str, str] = {}
        cut = [list(map(seen.setdefault, words, words)) for words in map(words_of, texts)]  # equal words share one string
        gc.disable()  # nothing here is cyclic, and full collections would walk all words again and again
        try:
            known = {w: ids for w in seen if (ids := self.recent.get(w)) is not None}
            known.update(self.encode_sorted(sorted(seen.keys() - known.keys())))
            of = known.__getitem__
            out = [np.frombuffer(b"".join(map(of, words)), np.int32) for words in cut]
            if len(self.recent) + len(known) > RECENT:  # those of this slice stay
                self.recent = known if len(known) <= RECENT else {}
            else:
                self.recent.update(known)
            return out
        finally:
            gc.enable()

    def decode(self, ids: np.ndarray | list[int]) -> str:
        """Joins pieces, bytes as UTF-8, and takes the dummy mark away."""
        text = "".join(map(self.shown.__getitem__, ids.tolist() if isinstance(ids, np.ndarray) else ids))
        if not text.isascii():  # escaped bytes become what they spell
            text = text.encode("utf-8", "surrogateescape").decode("utf-8", "replace")
        return text.replace(MARK, " ")[1:]


#: A word: the marks before it and all up to the next mark or line end. No piece crosses there.
CUT = re.compile(f"{MARK}+[^{MARK}\n]*|[^{MARK}\n]+|\n")


def words_of(text: str) -> list[str]:
    return CUT.findall(MARK + text.replace(" ", MARK)) if text else []


def merged(text: str, scores: dict[str, float]) -> list[str]:
    """The merges themselves on a short string: the best-scoring pair first, the leftmost of equals."""
    parts = list(text)
    while len(parts) > 1:
        top, at = None, -1
        for i in range(len(parts) - 1):
            s = scores.get(parts[i] + parts[i + 1])
            if s is not None and (top is None or s > top):
                top, at = s, i
        if at < 0:
            break
        parts[at : at + 2] = [parts[at] + parts[at + 1]]
    return parts


@lru_cache(maxsize=2)
def load(model: str, stamp: float = 0.0) -> Vocabulary:
    import sentencepiece as sp

    m = sp.SentencePieceProcessor(model_file=model)
    n = m.get_piece_size()
    kinds = [UNKNOWN if m.is_unknown(i) else BYTE if m.is_byte(i) else 3 if m.is_control(i) or m.is_unused(i) else NORMAL for i in range(n)]
    pieces, scores = [m.id_to_piece(i) for i in range(n)], [m.get_score(i) for i in range(n)]
    normal = [scores[i] for i in range(n) if kinds[i] == NORMAL]
    return Vocabulary(pieces, scores, kinds, bpe=all(s == int(s) for s in normal))


ENCODED = T.StructType(
    [
        T.StructField("doc_id", T.LongType()),
        T.StructField("n_chars", T.LongType()),
        T.StructField("n_pieces", T.LongType()),
        T.StructField("ids", T.ArrayType(T.IntegerType())),
        T.StructField("decoded_sha256", T.StringType()),
        T.StructField("round_trip", T.BooleanType()),
    ]
)


def lists(rows: list[np.ndarray]) -> pa.Array:
    """A list array without Python boxes on the way."""
    ends = np.cumsum([0, *map(len, rows)], dtype=np.int32)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate([*rows, np.empty(0, np.int32)])))


def proof(decoded: str, text: str) -> tuple[str, bool]:
    return hashlib.sha256(decoded.encode("utf-8", "surrogatepass")).hexdigest(), decoded == text


def encode(docs: DataFrame, model: str = DEFAULT_MODEL) -> DataFrame:
    """Ids of each whole text, decoded again to prove the round trip. The model's path must exist on the executors."""

    def make():
        vocabulary = load(model, os.path.getmtime(model))

        def step(batch: pa.RecordBatch) -> dict:
            texts = [t or "" for t in batch["text"].to_pylist()]
            ids = vocabulary.encode_batch(texts)
            proofs = [proof(vocabulary.decode(x), t) for x, t in zip(ids, texts)]  # one decoded text at a time
            return {
                "doc_id": batch["doc_id"],
                "n_chars": [len(t) for t in texts],
                "n_pieces": [len(x) for x in ids],
                "ids": lists(ids),
                "decoded_sha256": [p[0] for p in proofs],
                "round_trip": [p[1] for p in proofs],
            }

        return step

    return map_batches(documents(docs).select("doc_id", "text"), ENCODED, make, rows=8192, size=4_000_000)


TEXT = T.StructType([DOCUMENT["doc_id"], DOCUMENT["text"]])


def decode(encoded: DataFrame, model: str = DEFAULT_MODEL) -> DataFrame:
    """(doc_id, text) of (doc_id, ids); null ids give an empty text."""

    def make():
        vocabulary = load(model, os.path.getmtime(model))
        return lambda batch: {"doc_id": batch["doc_id"], "text": [vocabulary.decode(x or []) for x in batch["ids"].to_pylist()]}

    ids = T.StructType([DOCUMENT["doc_id"], ENCODED["ids"]])
    return map_batches(conform(encoded, ids), TEXT, make)
