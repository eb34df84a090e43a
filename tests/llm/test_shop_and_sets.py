"""Operators 11 to 13 against plain versions, with odd rows."""

import collections
import datetime
import hashlib
import math
import random
import re
import zlib

import numpy as np
import pytest

from folio.llm import changepoints, language, neardup, packed, resample, setjoin

LINES = "sale_id long, vendor_id long, quantity int, flag string, shipped_at timestamp_ntz, day int, amount double, key int, v long"


def lines(rows):
    """(vendor, quantity, flag, day) as rows with columns that clash with names the operator uses."""
    return [(1, v, q, f, None if d is None else datetime.datetime(2024, 1, 1, 13, 5) + datetime.timedelta(days=d), 9, 9.5, 9, 9) for v, q, f, d in rows]


def brute_segments(rows, least=5, penalty=10_000):
    series = collections.defaultdict(collections.Counter)
    for v, q, f, d in rows:
        if f in ("kept", "swapped") and q is not None and d is not None:
            series[v][d + 19723] += q
    out = set()
    for v, days in series.items():
        first, n = min(days), max(days) - min(days) + 1
        x = [days.get(first + i, 0) for i in range(n)]

        def cost(i, j):
            m, s, q = j - i, sum(x[i:j]), sum(a * a for a in x[i:j])
            spread = 1 + (m * q - s * s) // (m * m)
            return m * math.floor(1000 * math.log(spread)), s, spread

        # (cost, segments, starts from the last backwards) of every partition, compared as the contract says
        best = {0: (0, 0, ())}
        for end in range(1, n + 1):
            found = [(best[i][0] + cost(i, end)[0] + penalty * (i > 0), best[i][1] + 1, (i, *best[i][2])) for i in range(end) if i in best and (end - i >= least or (i, end) == (0, n))]
            if found:
                best[end] = min(found)
        total, k, starts = best[n]
        starts = starts[::-1]
        for no, (i, j) in enumerate(zip(starts, [*starts[1:], n]), 1):
            c, s, spread = cost(i, j)
            out.add((v, no, first + i, j - i, s, spread, c, k, total))
    return out


def shop(seed):
    rng, rows = random.Random(seed), []
    for v in [1, 2, 3, 4, None, 7]:
        level, day = rng.choice([2, 20, 300]), rng.randint(0, 40)
        for _ in range(rng.choice([1, 3, 9, 25, 60])):
            if rng.random() < 0.15:
                level = rng.choice([1, 5, 40, 1000])
            rows += [(v, rng.randint(level, 2 * level), rng.choice(["kept", "swapped", "returned", None]), day)] * rng.randint(1, 3)
            day += rng.choice([0, 1, 1, 1, 2, 6])
    rows += [(5, 7, "kept", d) for d in range(23)]  # ties throughout
    rows += [(6, -3, "kept", 0), (6, 4, "swapped", 30), (8, None, "kept", 1), (8, 5, "kept", None), (9, 1, "returned", 3)]
    return rows


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_change_points(spark, seed):
    rows = shop(seed)
    got = changepoints.change_points(spark.createDataFrame(lines(rows), LINES).repartition(3)).collect()
    assert len(got) == len(set(map(tuple, got)))
    assert set(map(tuple, got)) == brute_segments(rows)


def test_change_points_of_nothing(spark):
    assert changepoints.change_points(spark.createDataFrame([], LINES)).count() == 0


def test_series_in_blocks_and_beyond_64_bits(monkeypatch):
    rng = random.Random(5)
    x = [rng.choice([0, 1, 9]) * rng.choice([1, 100]) for _ in range(80)]
    whole = changepoints.starts_of(np.array(x))
    assert changepoints.starts_of(np.array(x, object)) == whole
    monkeypatch.setattr(changepoints, "BLOCK", 200)
    assert changepoints.starts_of(np.array(x)) == whole
    large = [v * 10**12 for v in x]
    assert changepoints.exact(large).dtype == object and changepoints.exact(x).dtype == np.int64
    got = changepoints.segments(1, np.arange(80), large)
    assert got["total"].sum() == sum(large) and got["n_days"].sum() == 80


SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, node long, salt int, root long, token long"
WORDS = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma tau".split()


def texts(seed=1, n=150):
    rng, out, base, passage = random.Random(seed), [], None, "one passage of boilerplate that many of the documents here have in common with each other"
    for i in range(n):
        words = [rng.choice(WORDS) + str(rng.randint(0, 60)) for _ in range(rng.choice([1, 4, 5, 6, 30, 90, 200]))]
        if i % 3 and base:
            words = list(base)
            for _ in range(rng.randint(0, max(1, len(words) // 30))):
                words[rng.randrange(len(words))] = rng.choice(["changed", "altered"])
        elif i % 5 == 0:
            words += passage.split()
        base = words
        out.append((i, " ".join(words).upper() if i % 7 == 0 else "\t".join(words)))
    odd = [None, None, "", " \n\t\x0b", "one", "ONE", "é" * 3, "É" * 3, "1 " * 9000, "x" * 30000, "a b c d", "A b\nc d", "a b c d e"]
    return out + [(n + k, t) for k, t in enumerate(odd)]


def frame(spark, rows):
    return spark.createDataFrame([(i, t, "en", "a", 1, 5, 6, 7, 8) for i, t in rows], SCHEMA).repartition(5)


def brute_join(rows, n=5, percent=80):
    lower = str.maketrans({c: c.lower() for c in "ABCDEFGHIJKLMNOPQRSTUVWXYZ"})
    sets = []
    for i, t in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate(lower))
        sets.append({tuple(w[k : k + n]) for k in range(max(1, len(w) - n + 1))} if w else set())
    ids = [-(2**63) if i is None else i for i, _ in rows]
    links = [[b for b in range(len(rows)) if b != a and sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b])] for a in range(len(rows))]
    out = []
    for a in range(len(rows)):
        seen, todo = {a}, [a]
        while todo:
            new = [b for b in links[todo.pop()] if b not in seen]
            seen.update(new)
            todo += new
        out.append((rows[a][0], len(sets[a]), min(ids[b] for b in seen), len(links[a])))
    return sorted(out, key=str)


@pytest.mark.parametrize("seed", [1, 2])
def test_set_join(spark, seed):
    rows = texts(seed)
    assert sorted(map(tuple, setjoin.join(frame(spark, rows)).collect()), key=str) == brute_join(rows)


@pytest.mark.parametrize("percent", [80, 90])
def test_set_join_in_blocks(spark, monkeypatch, percent):
    monkeypatch.setattr(setjoin, "BLOCK_SHINGLES", 150)
    rows = texts(3) + [(i, t) for i, t in texts(3)[:20]] + [(None, texts(3)[1][1]), (None, "another text without an id, of its own kind")]
    assert sorted(map(tuple, setjoin.join(frame(spark, rows), 2, percent).collect()), key=str) == brute_join(rows, 2, percent)


def test_set_join_of_copies_and_of_nothing(spark):
    assert setjoin.join(frame(spark, [])).count() == 0
    assert {tuple(r)[1:] for r in setjoin.join(frame(spark, [(i, None) for i in range(9)])).collect()} == {(0, i, 0) for i in range(9)}
    rows = [(i, "the same words in each of these rows and no others") for i in range(3000)]
    assert {tuple(r)[1:] for r in setjoin.join(frame(spark, rows)).collect()} == {(7, 0, 2999)}


def test_lists_skip_and_derive_nothing_wrong():
    rng = np.random.default_rng(4)
    base = [np.unique(rng.integers(0, 2**63, rng.integers(1, 80)).astype(np.uint64)) for _ in range(30)]
    sets = []
    for s in base:
        for _ in range(4):
            keep = s[rng.random(len(s)) < rng.choice([0.7, 0.9, 0.97])]
            sets.append(np.unique(np.append(keep, rng.integers(0, 2**63, rng.integers(1, 4)).astype(np.uint64))))
    sets += [np.arange(k, k + 40, dtype=np.uint64) for k in range(60)]  # all share tokens
    lists = setjoin.Lists(sets, 80)
    want = np.array([[100 * len(np.intersect1d(a, b)) >= 80 * len(np.union1d(a, b)) for b in sets] for a in sets])
    for at, s in enumerate(sets):
        assert (np.sort(lists.search(s)) == np.flatnonzero(want[at])).all()
    seen = set()
    for some, found in setjoin.answers(sets, lists):
        assert (found == want[some]).all()
        seen |= set(some)
    assert seen == set(range(len(sets)))
    assert any(len(m) > 3 for m in setjoin.groups(sets).values())


def brute_resample(rows, bench, percent=25):
    pattern = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")

    def features(t):
        w = pattern.findall("".join(x.lower() if "A" <= x <= "Z" else x for x in t or ""))
        return len(w), [zlib.crc32(f.encode()) % 10_000 for f in [*w, *map(" ".join, zip(w, w[1:]))]]

    found = [(i, *features(t)) for i, t in rows]
    s, t = collections.Counter(b for x in found for b in x[2]), collections.Counter(b for x in bench for b in features(x)[1])
    n, m, out = sum(s.values()), sum(t.values()), []
    for i, k, of in found:
        weight = sum(math.floor(1000 * math.log(((t[b] + 1) * (m * 0 + n + 10_000)) / ((s[b] + 1) * (m + 10_000)))) for b in of) // len(of) if of else 0
        h = int(hashlib.sha256(f"7:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        out.append([i, len(of), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), k])
    fit = sorted((x for x in out if x[4] >= 20), key=lambda x: (-x[3], -(2**63) if x[0] is None else x[0], x[2], x[1]))
    drawn = {id(x): r for r, x in enumerate(fit[: percent * len(fit) // 100], 1)}
    return sorted([(*x[:4], drawn.get(id(x))) for x in out], key=str)


@pytest.mark.parametrize("size", [2_000, 8_000_000])
def test_resample(spark, monkeypatch, size):
    monkeypatch.setattr(packed, "SLICE", size)
    rows = texts(4, 300) + [(7, t) for _, t in texts(5, 30)] + [(None, "Straße CAFÉ x-1 " * 30)] * 3
    bench = [t for _, t in texts(6, 20)] + [None, ""]
    target = spark.createDataFrame([(k, t, "clash") for k, t in enumerate(bench)], "item_id long, text string, doc_id string").select("item_id", "text")
    got = sorted([(r.doc_id, r.n_features, r.weight, r.score, r["rank"]) for r in resample.resample(frame(spark, rows), target).collect()], key=str)
    assert got == brute_resample(rows, bench)


def test_resample_of_nothing(spark):
    none = frame(spark, [])
    assert resample.resample(none, none).count() == 0
    rows = texts(7, 40)
    got = sorted([(r.doc_id, r.n_features, r.weight, r.score, r["rank"]) for r in resample.resample(frame(spark, rows), none).collect()], key=str)
    assert got == brute_resample(rows, [])


def made_up(code, rng):
    """A language of its own: syllables of few letters."""
    letters = rng.sample("abcdefghijklmnopqrstuvwxyzäöüéèñçøåßł", 9)
    syllables = ["".join(rng.choice(letters) for _ in range(rng.choice([2, 3]))) for _ in range(25)]
    vocabulary = ["".join(rng.choice(syllables) for _ in range(rng.choice([1, 2, 3]))) for _ in range(150)]
    return lambda: " ".join(rng.choice(vocabulary) for _ in range(rng.randint(40, 80)))


SHAPE = "doc_id long, text string, lang string, source string, n_chars long, suffix string, best int"


def told(spark, rows):
    frame_ = spark.createDataFrame([(i, t, k, h, 1, "clash", 7) for i, t, k, h in rows], SHAPE).repartition(4)
    return {r.doc_id: r for r in language.identify_documents(frame_, ["doc_id", "lang"]).collect()}


def test_rare_languages_are_kept(spark):
    rng = random.Random(21)
    write = {k: made_up(k, rng) for k in ("en", "fr", "sw", "xx")}
    rows = [(i, write[k](), k, "web") for i in range(2000) for k in ["sw" if i % 200 == 0 else ("en", "fr")[i % 2]]]
    rows += [(5000, write["xx"](), None, "web"), (5001, write["sw"](), "en", "web"), (5002, write["sw"]() * 200, None, None)]
    got = told(spark, rows)
    assert all(got[i].identified == "sw" and got[i].kept for i in range(0, 2000, 200))
    assert got[5001].identified == got[5002].identified == "sw"
    assert not got[5000].kept  # a language that nobody has labelled
    assert all(got[i].identified == got[i].lang and got[i].kept for i in range(2000))
    kept = language.keep_identified(spark.createDataFrame([(i, t, k, h, 1, "clash", 7) for i, t, k, h in rows], SHAPE))
    assert kept.count() == 2002 and kept.where("lang = 'sw'").count() == 12


def test_a_hundred_languages(spark):
    rng = random.Random(22)
    codes = [a + b for a in "abcdefghij" for b in "klmnopqrst"]
    write = {k: made_up(k, rng) for k in codes}
    drawn = [k for n, k in enumerate(codes) for _ in range(8 + (n % 10) * 8)]
    rows = [(i, write[k](), rng.choice([k, k.upper(), f"{k}-XX", f" {k}_yy"]), "web") for i, k in enumerate(drawn)]
    got = told(spark, rows)
    right = collections.Counter(k for i, k in enumerate(drawn) if got[i].identified == k and got[i].kept)
    assert all(right[k] >= 0.9 * drawn.count(k) for k in codes)


def test_labels_and_declarations_by_their_primary_part(spark):
    for label in ("EN", "en-US", " en_gb ", "eng", "English", "", "x-y", "zh-Hant"):
        want = language.primary_of(label) or None
        assert spark.range(1).select(language.primary(language.F.lit(label)).alias("p")).first().p == want
    assert [language.primary_of(x) for x in ("EN", "en-US", "en_gb", "eng", "English")] == ["en", "en", "en", "eng", "english"]


def test_language_of_documents_is_that_of_a_plain_version(spark):
    """All that op6_language returns, from the model's tables on, on odd rows too."""
    rng = random.Random(23)
    write = {k: made_up(k, rng) for k in ("en", "fr", "de")}
    rows = [(i, rng.choice([write[k](), write[k]()[:9], "7 %", ""]), rng.choice([k, k, None, "FR", "qq"]), rng.choice(["a.fr", "b", "c.de", None])) for i in range(240) for k in [("en", "fr", "de")[i % 3]]]
    rows += [(None, None, None, None), (7, rows[7][1], rows[7][2], rows[7][3]), (8, '<HTML class=x lang="fr-FR"> ' + write["en"](), "en", "b")]
    frame_ = spark.createDataFrame([(i, t, k, h, 1, "clash", 7) for i, t, k, h in rows], SHAPE)
    model = language.train(frame_)
    known, n = model.languages, len(rows)
    ll, share = language.log_likelihoods(model, [t or "" for _, t, _, _ in rows])
    best = ll.argmax(axis=1).tolist()
    place = [(h or "", h.rpartition(".")[2] if h and "." in h else "") for *_, h in rows]
    said = ["fr" if "lang=" in (t or "") else language.primary_of(k) if k else None for _, t, k, _ in rows]
    said = [None if x is None else known.index(x) if x in known else len(known) for x in said]
    total = [1 + best.count(k) for k in range(len(known))]
    base = [x / sum(total) for x in total]

    def share_of(at, above, weight):
        return [(sum(best[j] == k for j in at) + weight * above[k]) / (len(at) + weight) for k in range(len(known))]

    want = []
    for i in range(n):
        around = share_of([j for j in range(n) if place[j][1] == place[i][1]], base, language.SUFFIX_WEIGHT)
        p = np.log(share_of([j for j in range(n) if place[j] == place[i]], around, language.HOST_WEIGHT)) + ll[i]
        if said[i] is not None:
            agree = [[0.02 + sum(said[j] == d and best[j] == k for j in range(n)) for k in range(len(known))] for d in range(len(known) + 1)]
            p = p + [math.log(agree[said[i]][k] / sum(a[k] for a in agree)) for k in range(len(known))]
        p = np.exp(p - p.max())
        p /= p.sum()
        sums, grams, _ = language.likelihoods(model, [rows[i][1] or ""])
        far = grams[0] >= 30 and sums[0, p.argmax()] / max(grams[0], 1) < model.floor[p.argmax()]
        want.append((rows[i][0], known[int(p.argmax())], round(float(p.max()), 6), known[best[i]], bool(p.max() >= 0.5 and share[i] >= 0.2 and not far)))
    got = [(r.doc_id, r.identified, round(r.confidence, 6), r.text_lang, r.kept) for r in language.identify_documents(frame_, ["doc_id"]).collect()]
    assert sorted(got, key=str) == sorted(want, key=str), [x for x in zip(sorted(got, key=str), sorted(want, key=str), strict=True) if x[0] != x[1]]
    assert {w[4] for w in want} == {True, False}


@pytest.mark.parametrize("text", [None, "one and the same text of some words in all of these rows"])
def test_hot_rows_are_dealt_out(spark, text):
    """Rows without words, or copies of one text (with one id, or none), are many tasks, without help at run time."""
    docs = spark.createDataFrame([(None if i % 2 else i, text) for i in range(20_000)] + [(30_000 + i, f"text {i} " * 9) for i in range(50)], "doc_id long, text string").repartition(4)
    for key in ("spark.sql.adaptive.enabled", "spark.sql.autoBroadcastJoinThreshold"):
        spark.conf.set(key, {"spark.sql.adaptive.enabled": "false"}.get(key, "-1"))
    try:
        for out in (neardup.judged(docs, 2, 80), setjoin.join(docs)):
            rows = out.groupBy(language.F.spark_partition_id().alias("p")).count().collect()
            assert sum(r["count"] for r in rows) == 20_050
            assert max(r["count"] for r in rows) < 8_000
    finally:
        for key in ("spark.sql.adaptive.enabled", "spark.sql.autoBroadcastJoinThreshold"):
            spark.conf.unset(key)
