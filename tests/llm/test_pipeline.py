"""The pipeline as a whole, stage by stage, against plain versions."""

import collections
import math
import random
import re

import pytest

import corpus_pipeline
from folio.llm import mixing, pieces
from folio.llm.common import DOCUMENT, table

DATA = "/root/testdata/sf0.001"
COLUMNS = "doc_id long, text string, lang string, source string, n_chars long"
SAID = {"en": "the and with house water over under between people".split(), "fr": "être où garçon maison leçon très déjà forêt élève".split()}


def planted(n=90, seed=3):
    """Documents of two languages with copies, near copies, secrets, and every odd case."""
    rng, out = random.Random(seed), []
    for i in range(n):
        lang = ("en", "fr")[i % 2]
        words = [rng.choice(SAID[lang]) + rng.choice(["", "s", "a"]) for _ in range(rng.randint(40, 90))]
        if i % 10 == 7:
            words = out[-2][1].split()
            words[-1] = "fin"  # a near copy
        elif i % 10 == 9:
            words = out[-2][1].split()  # a copy
        text = " ".join(words)
        if i % 15 == 4:
            text += " password = hunter2hunter2 end"
        out.append((i, text, out[-2][2] if i % 10 in (7, 9) else lang, f"s{i % 4}", len(text)))
    return out


ODD = [(None, "the people with water over the house and under " * 3, None, None, None), (200, None, None, None, None), (201, "", "en", "s0", 0), (202, "12 34 !! 56", "en", "s1", 11), (203, "the water and the house " * 4000, "en", "s2", 96000), (0, "where people and water are with the house between them", "en", "s1", 53)]


def plain_groups(rows, n=5):
    """doc position -> position of the group's row that stays: least id, then whatever the operator keeps."""
    sets = []
    for r in rows:
        w = (r[1] or "").encode().lower().split()
        sets.append({tuple(w[i : i + min(n, len(w))]) for i in range(len(w) - min(n, len(w)) + 1)} if w else set())
    group = list(range(len(rows)))

    def root(i):
        while group[i] != i:
            i = group[i]
        return i

    for a in range(len(rows)):
        for b in range(a):
            if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
                group[root(a)] = root(b)
    return [root(i) for i in range(len(rows))], sets


def plain_draws(rows, place):
    """How often each (doc_id, source) is drawn: whole passes, a prefix of the blocks, and the largest that fit of the last."""
    sizes, order = collections.Counter(), sorted({r[3] for r in rows} - {None}) + [None] * any(r[3] is None for r in rows)
    size = {(r[0], r[3]): len(re.findall(r"[^\x20\x09-\x0D]+", r[1] or "")) for r in rows}
    for (_, s), n in size.items():
        sizes[s] += n
    total, capped, share = sum(sizes.values()), {}, {}
    while True:
        free = {s: mixing.WEIGHTS[i % 3] for i, s in enumerate(order) if s not in capped}
        left = total - sum(capped.values())
        share = {s: left * w / sum(free.values()) for s, w in free.items()}
        over = {s: 3.0 * sizes[s] for s in share if share[s] > 3 * sizes[s]}
        if not over:
            break
        capped |= over
    draws = {}
    for s, target in (capped | share).items():
        own = [k for k in size if k[1] == s]
        n_blocks, whole = math.ceil(len(own) / mixing.BLOCK), sizes[s]
        times = int(target // whole) if whole else 0
        rest = round(target - times * whole)
        for block in range(n_blocks):
            here = sorted((k for k in own if int(place[k] * n_blocks) == block), key=lambda k: (-size[k], place[k]))
            words = sum(size[k] for k in here)
            left = max(0, min(rest, words))
            rest -= words
            for k in here:
                fits = 0 < size[k] <= left if left < words else size[k] > 0
                left -= size[k] if fits else 0
                draws[k] = (times if size[k] else 0) + fits
    return draws


@pytest.fixture(scope="module")
def docs(spark):
    rows = planted() + ODD
    return spark.createDataFrame([(*r, "clash", 1, "x") for r in rows], COLUMNS + ", size string, id int, seal string").repartition(3)


def test_stages(spark, tmp_path):
    docs = table(spark, DATA, "documents")
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, DATA)
        if k + 1 < len(corpus_pipeline.STAGES):
            assert out.columns == DOCUMENT.names, name
        out.write.parquet(str(tmp_path / str(k)))
        docs = spark.read.parquet(str(tmp_path / str(k)))
    assert docs.count() and docs.where("not round_trip").count() == 0


def test_empty_tables(spark):
    none = spark.createDataFrame([], COLUMNS)
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, none, DATA).count() == 0, name


def test_language_stage(spark, docs):
    """Texts without letters go; the others stay whole and in the language they were made of."""
    got = corpus_pipeline.identify_language(spark, docs, DATA).collect()
    want = {(r[0], r[1]): (r[2] or "en", r[3], r[4]) for r in planted() + ODD if r[0] not in (200, 201, 202)}
    assert len(got) == len(want) and {(r.doc_id, r.text): (r.lang, r.source, r.n_chars) for r in got} == want


def test_near_duplicate_stage(spark, docs):
    rows = planted() + ODD
    group, sets = plain_groups(rows)
    got = collections.Counter((r.doc_id, r.text) for r in corpus_pipeline.drop_near_duplicates(spark, docs, DATA).collect())
    want = collections.Counter()
    for g in set(group):
        members = [rows[i] for i in range(len(rows)) if group[i] == g]
        head = min(members, key=lambda r: -(2**63) if r[0] is None else r[0])
        want[head[0], head[1]] += 1
    assert got == want and sum(got.values()) < len(rows)


def test_secret_stage(spark, docs):
    rows = {(r[0], r[2], r[3]): r for r in planted() + ODD}
    got = corpus_pipeline.redact_secrets(spark, docs, DATA).collect()
    assert len(got) == len(planted() + ODD)
    for r in got:
        was = rows[r.doc_id, r.lang, r.source][1]
        if was is not None and "password = " in was:
            assert r.text == re.sub(r"password = [A-Za-z0-9+/_.=-]+", "<secret>", was) and r.n_chars == len(r.text)
        else:
            assert r.text == was


def test_secrets_are_gone(spark):
    docs = corpus_pipeline.redact_secrets(spark, table(spark, DATA, "documents"), DATA)
    assert docs.where(r"text rlike '[0-9a-f]{24,}'").count() == 0 and docs.count() == 200


def test_mixing_stage(spark):
    rows = [r for r in planted(300, 5)] + [(None, "a b c", "en", None, 5), (400, None, None, None, None)]
    docs = spark.createDataFrame(rows, COLUMNS).repartition(4)
    place = {(r.doc_id, r.source): r.place for r in docs.select("doc_id", "source", mixing.place_of().alias("place")).collect()}
    got = collections.Counter((r.doc_id, r.source) for r in corpus_pipeline.mix_sources(spark, docs, DATA).collect())
    assert got == {k: n for k, n in plain_draws(rows, place).items() if n}


def test_piece_stage(spark, docs):
    import sentencepiece as sp

    m = sp.SentencePieceProcessor(model_file=pieces.DEFAULT_MODEL)
    got = corpus_pipeline.encode_pieces(spark, docs, DATA).collect()
    want = sorted(([r[0], m.encode(r[1] or "")] for r in planted() + ODD), key=str)
    assert sorted(([r.doc_id, list(r.ids)] for r in got), key=str) == want and all(r.round_trip for r in got)
