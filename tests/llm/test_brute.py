"""The operators against plain versions of what they compute, on small tables with every odd case."""

import collections
import hashlib
import math
import random
import re
from itertools import product

import pytest

from folio.llm import catalog, chat, fingerprints, language, mixing, neardup, personal, pieces, quality, search, secrets
from folio.llm.common import table

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, set_key string, id long, bucket int, target string"
WORDS = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma tau".split()


def rows(n=120, seed=1):
    rng, out, base = random.Random(seed), [], None
    for i in range(n):
        words = [rng.choice(WORDS) + str(rng.randint(0, 40)) for _ in range(rng.randint(1, 120))]
        if i % 4 == 1 and base:
            words = list(base)
            for _ in range(rng.randint(0, len(words) // 12)):
                words[rng.randrange(len(words))] = "changed"
        base = words
        text = " ".join(words)
        if i % 17 == 0:
            text += ' token = "deadbeefdeadbeefdeadbeefdead" mail joe.x@mail.example.com +1 (555) 123-4567 4111 1111 1111 1111 10.0.0.1'
        out.append((i, text, rng.choice(["en", "fr", None]), rng.choice(["a", "b", "a", None]), len(text), "clash", 1, 2, "clash"))
    odd = [None, "", " \n\t ", "one", "ONE", "é" * 3, "a▁b", "x" * 30000, "1 " * 9000]
    return out + [(n + k, t, None, None, None, "clash", 1, 2, "clash") for k, t in enumerate(odd)]


@pytest.fixture(scope="module")
def data():
    return rows()


@pytest.fixture(scope="module")
def docs(spark, data):
    return spark.createDataFrame(data, SCHEMA).repartition(5).cache()


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


def test_empty_tables(spark, none):
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    for f in (fingerprints.fingerprint, secrets.scan, secrets.redact, mixing.taken, mixing.mixed, neardup.near_duplicates, neardup.keep_one, personal.find, pieces.encode, language.keep_identified):
        assert f(none).count() == 0
    assert quality.score(none, quality.train(none, labels)).count() == 0
    assert search.search(none, none).count() == 0
    assert chat.format_conversations(spark.createDataFrame([], "conv_id long, turn long, role string, text string")).count() == 0


def test_null_ids_and_repeats(spark):
    d = spark.createDataFrame([(None, "same words here twice"), (None, "same words here twice"), (3, "same words here twice"), (3, "same words here twice")], "doc_id long, text string")
    assert fingerprints.fingerprint(d).count() == 4
    assert {r.component_id for r in neardup.near_duplicates(d).collect()} == {-(2**63)}
    assert mixing.taken(d).count() == 4
    assert personal.find(d).count() == secrets.scan(d).count() == pieces.encode(d).count() == 4


def test_fingerprints(docs, data):
    got = {r.doc_id: r for r in fingerprints.fingerprint(docs).collect()}
    texts = [r[1] or "" for r in sorted(data)]
    for i, (t, after) in enumerate(zip(texts, texts[1:] + texts[:1])):
        half = len(t) // 2
        edited = t[: len(t) - half] + after[:half]
        assert got[i].n_chars == len(t) and got[i].edited_sha256 == hashlib.sha256(edited.encode()).hexdigest()
        assert 0 <= got[i].near_edited <= 1 and 0 <= got[i].near_next <= 1
    same = collections.defaultdict(set)
    for i, t in enumerate(texts):
        same[t].add(got[i].fingerprint)
    assert all(len(v) == 1 for v in same.values())


@pytest.mark.parametrize("size", [10, 3])
def test_fingerprint_buckets(docs, monkeypatch, size):
    one = sorted(fingerprints.fingerprint(docs).collect())
    monkeypatch.setattr(fingerprints, "BUCKET_ROWS", size)
    assert sorted(fingerprints.fingerprint(docs).collect()) == one


def test_fingerprints_of_hot_ids(spark, monkeypatch):
    """An id of most rows is many buckets; every row still meets the next of the one order."""
    rng = random.Random(2)
    d = [(rng.choice([None, 7, 7, 7, i]), " ".join(rng.choice(WORDS) for _ in range(rng.randint(0, 9)))) for i in range(400)] + [(9, None)]
    docs = spark.createDataFrame(d, "doc_id long, text string").repartition(4)
    one = sorted(fingerprints.fingerprint(docs).collect(), key=str)
    hashed = {r.text: r.h for r in docs.selectExpr("coalesce(text, '') as text", "xxhash64(coalesce(text, '')) as h").collect()}
    order = sorted(((i if i is not None else -(2**63), hashed[t or ""], t or "") for i, t in d))
    want = collections.Counter((i if i != -(2**63) else None, hashlib.sha256(fingerprints.edited(t, order[(k + 1) % len(order)][2]).encode()).hexdigest()) for k, (i, _, t) in enumerate(order))
    assert collections.Counter((r.doc_id, r.edited_sha256) for r in one) == want
    monkeypatch.setattr(fingerprints, "BUCKET_ROWS", 8)
    dealt = fingerprints.in_order(docs)
    assert max(r["count"] for r in dealt.groupBy("bucket").count().collect()) < 60
    assert sorted(fingerprints.fingerprint(docs).collect(), key=str) == one


def plain_names(text):
    """The set of names of one text, name by name."""
    u32, odd = 0xFFFFFFFF, 0x9E3779B1

    def mix(x):
        x = ((x ^ (x >> 16)) * 0x85EBCA6B) & u32
        x = ((x ^ (x >> 13)) * 0xC2B2AE35) & u32
        return x ^ (x >> 16)

    def toss(before, now):
        if before == now:
            return now & 1
        k = ((before ^ now) & -(before ^ now)).bit_length() - 1
        return 2 * k + (now >> k & 1)

    def level(names):
        runs = []
        for x in names:
            if runs and runs[-1][0] == x:
                runs[-1][1] += 1
            else:
                runs.append([x, 1])
        names = [mix((x + n * odd) & u32) if n > 1 else x for x, n in runs]
        labels = names
        for _ in range(3):
            labels = [toss(labels[i - 1] if i else 0, x) for i, x in enumerate(labels)]
        heads = [0]
        for i in range(2, len(labels) - 1):  # a first phrase of one name, and a last one, would stand alone
            if labels[i - 1] < labels[i] > labels[i + 1]:
                heads.append(i)
        out = []
        for a, b in zip(heads, [*heads[1:], len(names)]):
            out.append(mix((sum(mix((x + odd) & u32) * pow(odd, k + 1, 2**32) for k, x in enumerate(names[a:b])) + b - a) & u32))
        return out

    names, found = [ord(c) for c in text], set()
    for depth in range(1, fingerprints.LEVELS):
        names = level(names)
        if depth > 1 or len(names) == 1:
            found |= {mix((x + depth * odd) & u32) for x in names}
        if len(names) == 1:
            break
    return sorted(found)


def test_names_one_by_one(data):
    texts = [r[1] or "" for r in data][:80] + ["", "a", "ab", "aab", "aaaaaa", "abc" * 50, "xyzzy", "\x00\x01", "😀é" * 9]
    got = fingerprints.name_sets(texts)
    plain = [plain_names(t) if t else [] for t in texts]
    assert [g.tolist() for g in got] == [p[: fingerprints.SKETCH] for p in plain]
    for a, b in [(0, 1), (4, 5), (8, 9), (1, 70)]:
        union = sorted(set(plain[a][:64]) | set(plain[b][:64]))[:64]
        share = sum(x in plain[a][:64] and x in plain[b][:64] for x in union) / len(union)
        assert fingerprints.likeness(got[a], got[b]) == pytest.approx(share)


def test_interior_phrases_do_not_depend_on_offset():
    rng = random.Random(3)
    text = "".join(rng.choice("abcdefgh ijklm") for _ in range(6000))
    a, b = fingerprints.name_sets([text, "something in front " + text])
    assert fingerprints.likeness(a, b) > 0.9


def brute_search(data, asking, k):
    """[(query_id, rank, doc_id, score)] by scoring every document."""
    counts = [(r[0], collections.Counter(re.findall(r"\w+", (r[1] or "").lower()))) for r in data if r[0] is not None]
    n, total = len(counts), sum(sum(c.values()) for _, c in counts)
    df, out = collections.Counter(t for _, c in counts for t in c), []
    for q, asked in {(r[0], tuple(sorted(collections.Counter(re.findall(r"\w+", (r[1] or "").lower())).items()))) for r in asking if r[0] is not None}:
        scores = []
        for d, c in counts:
            s = sum(w * math.log1p((n - df[t] + 0.5) / (df[t] + 0.5)) * c[t] * 2.2 / (c[t] + 1.2 * (0.25 + 0.75 * sum(c.values()) / (total / n))) for t, w in asked if t in c)
            if s:
                scores.append((-round(s, 9), d))
        out += [(q, rank, d, -s) for rank, (s, d) in enumerate(sorted(scores)[:k], 1)]
    return sorted(out)


def same_hits(got, want):
    got = sorted((r.query_id, r["rank"], r.doc_id, r.score) for r in got)
    assert [x[:3] for x in got] == [x[:3] for x in want]
    assert [x[3] for x in got] == pytest.approx([x[3] for x in want], abs=1e-7)


@pytest.mark.parametrize("head", [2048, 5])
def test_search_is_exact(docs, data, head, monkeypatch):
    """Ids, ranks, ties and scores, in few and in many shards, blocks and lots."""
    monkeypatch.setattr(search, "HEAD", head)
    want = brute_search(data, [r for r in data if r[0] % 3 == 0], 5)
    same_hits(search.search(docs, docs.where("doc_id % 3 = 0"), k=5).collect(), want)


def test_search_in_lots(docs, data, monkeypatch):
    monkeypatch.setattr(search, "QUERY_TERMS", 400)
    monkeypatch.setattr(search, "SHARD_ROWS", 7)
    monkeypatch.setattr(search, "FIRST_ROWS", 4)  # several steps
    monkeypatch.setattr(search, "STEP", 3)
    same_hits(search.search(docs, docs.where("doc_id % 5 = 0"), k=3).collect(), brute_search(data, [r for r in data if r[0] % 5 == 0], 3))


def test_search_ties_repeats_and_nulls(spark):
    d = [(i, "same text for all of these") for i in range(40)] + [(7, "same text for all of these"), (None, "same text"), (50, None), (51, ""), (52, "quite another thing"), (52, "same thing")]
    docs = spark.createDataFrame(d, "doc_id long, text string").repartition(3)
    same_hits(search.search(docs, docs, k=4).collect(), brute_search(d, d, 4))


def index_of(texts, asked, k_least=0.0):
    hashes, np = search.TermHashes(), search.np
    bags = [search.bag(t, hashes) for t in texts]
    df = collections.Counter(int(v) for b, _ in bags for v in b)
    found = [search.bag(t, hashes) for t in asked]
    q = search.gather([v for v, _ in found], [c for _, c in found], len(texts), lambda words: np.array([df[int(w)] for w in words]), 8)
    lengths = np.array([c.sum() for _, c in bags])
    return q, search.Shard(np.arange(len(texts)), lengths, np.array([len(v) for v, _ in bags]), np.concatenate([v for v, _ in bags]), np.concatenate([c for _, c in bags]), q, lengths.mean())


def test_search_skips_blocks(data):
    rng, np = random.Random(4), search.np
    topics = [[f"t{k}w{i}" for i in range(12)] for k in range(20)]
    texts = [" ".join(rng.choice(topics[i % 20]) for _ in range(30)) for i in range(4000)]
    q, shard = index_of(texts, texts[:40])
    everything = [shard.exact(np.arange(4000), q.places[a:b], q.weights[a:b]) for a, b in zip(q.starts, q.starts[1:])]
    best = [sorted(zip(-s, shard.ids))[:10] for s in everything]
    for least, most in ((0.0, 1.0), (0.8, 1.0), (1.0, 0.5)):
        q.least[:] = [least * -b[-1][0] for b in best]
        read, scored = [], shard.scored
        shard.scored = lambda scores, rare, opened, asked: (read.append(opened.sum()), scored(scores, rare, opened, asked))
        got = {i: sorted(zip(-s, d)) for i, d, s in shard.top(q, 0, 40, 10)}
        assert [got[i] for i in range(40)] == best
        assert sum(read) <= most * 40 * len(shard.edges)  # with the threshold known most blocks are never read
        shard.scored = scored


def test_search_deals_out_queries(docs, data, monkeypatch):
    """Steps of few shards are many tasks, each of a part of the queries; the first step was one task, however many queries and cores there are."""
    seen, hits = [], search.hits
    monkeypatch.setattr(search, "hits", lambda *given: (seen.append(given[4:]), hits(*given))[1])
    monkeypatch.setattr(search, "PART", 2)
    same_hits(search.search(docs, docs.where("doc_id % 3 = 0"), k=5).collect(), brute_search(data, [r for r in data if r[0] % 3 == 0], 5))
    assert len(seen) == seen[0][1] > 1 and sorted(p for p, _ in seen) == list(range(len(seen)))
    q, shard = index_of([r[1] or "" for r in data], [r[1] for r in data if r[1]][:50])
    n = len(q.least)
    for parts in (1, 3, 7, n):
        assert [i for part in range(parts) for lo, hi in shard.chunks(q, part, parts) for i in range(lo, hi)] == list(range(n))


def test_search_orders_queries_by_kind(monkeypatch):
    """Texts of two kinds that come by turns are asked one kind after the other, by the terms of their kind alone, with the same hits."""
    rng, np = random.Random(9), search.np
    texts = [" ".join(rng.choice([f"k{i % 2}w{j}" for j in range(6)]) for _ in range(20)) for i in range(400)]
    q, shard = index_of(texts, texts[:60])
    got, order = search.alike(q)
    assert sorted(order) == list(range(60)) and sum(a % 2 != b % 2 for a, b in zip(order, order[1:])) <= search.KINDS
    for i, j in enumerate(order):
        a, b, c, d = *got.starts[i : i + 2], *q.starts[j : j + 2]
        assert (got.places[a:b] == q.places[c:d]).all() and (got.weights[a:b] == q.weights[c:d]).all()
    want = {j: sorted(zip(-s, d)) for j, d, s in shard.top(q, 0, 60, 5)}
    assert {order[i]: sorted(zip(-s, d)) for i, d, s in shard.top(got, 0, 60, 5)} == want


def test_quality_scores_one_by_one(spark):
    """The learner against follow-the-regularised-leader written weight by weight, and scores that don't depend on their slice."""
    rng, np = random.Random(6), quality.np
    texts = [" ".join(rng.choice(WORDS) + ("!!" if i % 2 else "") for _ in range(rng.randint(1, 12))) for i in range(60)]
    found = [np.unique(quality.features(t, quality.Hashes()), return_counts=True) for t in texts]
    got = quality.learn([(f, i % 2) for i, f in enumerate(found)], 0.3, 1.0, 0.02, 0.1, 2)
    z, n = collections.Counter(), collections.Counter()

    def weight(i):
        return 0.0 if abs(z[i]) <= 0.02 else (math.copysign(0.02, z[i]) - z[i]) / ((1.0 + math.sqrt(n[i])) / 0.3 + 0.1)

    for _ in range(2):
        for k, (places, counts) in enumerate(found):
            x = {int(p): c * quality.SCALE / sum(counts) for p, c in zip(places, counts)} | {1 << quality.BITS: 1.0}
            w = {i: weight(i) for i in x}
            p = 1 / (1 + math.exp(-sum(w[i] * x[i] for i in x)))
            for i in x:
                g = (p - k % 2) * x[i]
                z[i] += g - (math.sqrt(n[i] + g * g) - math.sqrt(n[i])) / 0.3 * w[i]
                n[i] += g * g
    assert max(abs(float(got[i]) - weight(i)) for i in z) < 1e-6 and np.count_nonzero(got) == sum(weight(i) != 0 for i in z)
    rows = [(i, t) for i, t in enumerate(texts)]
    one = {r.doc_id: r.score for r in quality.score(spark.createDataFrame(rows, "doc_id long, text string"), got).collect()}
    for i, t in rows:
        dot = sum(float(got[p]) * c for p, c in zip(*found[i])) * quality.SCALE / found[i][1].sum() + float(got[-1])
        assert one[i] == pytest.approx(1 / (1 + math.exp(-dot)), abs=1e-12)
    more = spark.createDataFrame(rows + [(1000 + k, None) for k in range(40)], "doc_id long, text string").repartition(7)
    assert {r.doc_id: r.score for r in quality.score(more, got).where("doc_id < 1000").collect()} == one


def test_quality_learns(spark):
    rng = random.Random(5)
    d = [(i, " ".join(rng.choice(WORDS) + ("***" if i % 3 == 0 else "") for _ in range(60))) for i in range(900)]
    docs = spark.createDataFrame(d + [(900, None), (901, "")], "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i % 3 != 0)) for i in range(900)], "doc_id long, quality int")
    out = {r.doc_id: r for r in quality.score(docs, quality.train(docs, labels)).collect()}
    held = [i for i in range(900) if out[i].held_out]
    assert 150 < len(held) < 300 and all(0 <= r.score <= 1 for r in out.values())
    assert sum(out[i].predicted == int(i % 3 != 0) for i in held) / len(held) > 0.97
    assert out[900].score == out[901].score


BASE = (secrets.ASSIGN, re.compile("AKIA[A-Z0-9]+"), re.compile("[0-9a-f]+"))


def test_secrets_base(docs, data):
    rng = random.Random(7)
    bits = ["password", "Token", " = ", ":", '"', "AKIA", "ABCDEF0123456789", "deadbeef", "0123456789abcdef", "é", " ", "api_key", "apikey", "x", "=", "ſecret", "toKen"]
    texts = [r[1] or "" for r in data] + ["".join(rng.choice(bits) for _ in range(rng.randint(1, 14))) for _ in range(3000)]
    for t in texts:
        want = [(m.start(), 0, m.end()) for m in BASE[0].finditer(t) if len(m.group(2)) >= 6]
        want += [(m.start(), 1, m.end()) for m in BASE[1].finditer(t) if len(m.group()) >= 20]
        want += [(m.start(), 2, m.end()) for m in BASE[2].finditer(t) if len(m.group()) >= 24]
        assert [x for x in secrets.spans_of(t, 36.0)[0] if x[1] < 3] == sorted(want)


def test_guess_bits_is_the_least():
    def brute(value):
        spans = {(i, j): min(b for a, c, b, _ in secrets.segments(value) if (a, c) == (i, j)) for i, j, _, _ in secrets.segments(value)}
        best = math.inf
        for cuts in product([0, 1], repeat=len(value) - 1):
            edges = [0, *[k + 1 for k, c in enumerate(cuts) if c], len(value)]
            cost = 0.0
            for i, j in zip(edges, edges[1:]):
                cost += secrets.SEGMENT_BITS + min(spans.get((i, j), math.inf), sum(map(secrets.char_bits, value[i:j])))
            best = min(best, cost)
        return best

    for v in ("password12", "qwerty1999", "aaaaaa7", "zX9$kq", "dr4g0n111"):
        assert secrets.guess_bits(v) == pytest.approx(brute(v))


def test_guess_cost_decides_alone():
    for text in ("pwd: kQzTvLwXbNmRpHsd", "pin: 839201748365", "login = vq#Kd!xw-Rz(Lp)", "DB_PWD=zkQwvXjTnbRd", "AWS_SECRET_ACCESS_KEY=wJalrXUtnFEMI/K7MDENG/bPxRfiCYzQvKtLwXhJ"):
        at = re.search(r"[:=] ?", text).end()
        assert secrets.spans_of(text, 36.0)[0] == [(at, 3, len(text))], text
    for text in ("the password is complicated", "their secret is unknown, the pin is important", "the login is understanding", "pwd: password123", "mypwd: kQzTvLwXbNmRpHsd"):
        assert secrets.spans_of(text, 36.0)[0] == [], text


def test_redaction(docs):
    out = secrets.redact(docs)
    assert out.count() == docs.count() and out.where("text like '%deadbeefdead%'").count() == 0
    assert out.where("text like '%<secret>%' and n_chars <> length(text)").count() == 0


def test_mixing(docs, data):
    got = mixing.taken(docs).collect()
    sizes = collections.Counter()
    for r in data:
        sizes[r[3]] += len(re.findall(r"[^\x20\x09-\x0D]+", r[1] or ""))
    order = sorted((s for s in sizes if s is not None)) + [None]
    total, capped = sum(sizes.values()), {}
    while True:
        free = {s: mixing.WEIGHTS[i % 3] for i, s in enumerate(order) if s not in capped}
        left = total - sum(capped.values())
        share = {s: left * w / sum(free.values()) for s, w in free.items()}
        over = {s: 3.0 * sizes[s] for s in share if share[s] > 3 * sizes[s]}
        if not over:
            break
        capped |= over
    want = capped | share
    for s in order:
        own = [r for r in got if r.source == s]
        assert own[0].target == pytest.approx(want[s]) and own[0].source_size == sizes[s]
        assert abs(sum(r.taken for r in own) - want[s]) <= 0.05 * want[s] + 20
    assert all(r.taken <= 3 * r.size for r in got)
    assert sorted(map(str, mixing.taken(docs).collect())) == sorted(map(str, got))
    # Document by document: whole passes, a prefix of the blocks, and the largest that fit of the block where the target falls.
    rows_of = [(r.doc_id, r.source, r.size, r.place) for r in mixing.sized(docs).collect()]
    draws = {}
    for s in order:
        own = [r for r in rows_of if r[1] == s]
        n_blocks, total_size = math.ceil(len(own) / mixing.BLOCK), sum(r[2] for r in own)
        times = int(want[s] // total_size) if total_size else 0
        rest = round(want[s] - times * total_size)
        for block in range(n_blocks):
            here = sorted((r for r in own if int(r[3] * n_blocks) == block), key=lambda r: (-r[2], r[3], r[0]))
            whole = sum(r[2] for r in here)
            left = max(0, min(rest, whole))
            rest -= whole
            for r in here:
                fits = 0 < r[2] <= left if left < whole else r[2] > 0
                left -= r[2] if fits else 0
                draws[r[0]] = (times if r[2] else 0) + fits
    assert {r.doc_id: r.taken for r in got} == {r.doc_id: r.size * draws[r.doc_id] for r in got}
    assert all(len(r.shards) == draws[r.doc_id] for r in mixing.mix(docs, text=True).collect())


def test_mixing_in_lots(docs, monkeypatch):
    one = sorted(map(str, mixing.taken(docs).collect()))
    monkeypatch.setattr(mixing, "LOT", 2)
    assert sorted(map(str, mixing.taken(docs).collect())) == one
    many = mixing.mix(docs, shard_words=200)
    sent = collections.Counter(s for r in many.collect() for s in r.shards)
    assert len(sent) > 5 and sum(sent.values()) == mixing.mixed(docs).count()


def test_splitting_tree_deals_exactly():
    np = mixing.np
    lots = [np.array([17, 0, 240, 3]), np.array([5, 80])]
    sums = np.array([q.sum() for q in lots])
    for lot, quotas in enumerate(lots):
        parts = [mixing.split(sums, lot, quotas, 6, k, 1) for k in range(6)]
        assert (sum(c for _, c in parts) == quotas).all()
        for s in range(len(quotas)):
            edge = 0
            for first, count in parts:
                assert first[s] == edge
                edge += count[s]
    each = [sum(int(mixing.split(sums, lot, q, 6, k, 1)[1].sum()) for lot, q in enumerate(lots)) for k in range(6)]
    assert max(each) - min(each) <= 1


def test_language(spark):
    rng = random.Random(2)
    said = {"en": "the and with house water over".split(), "fr": "être où garçon maison leçon très".split()}
    d = [(i, " ".join(rng.choice(said[k]) for _ in range(40)), k, f"host{i % 3}.{k}", 0) for i in range(300) for k in [("en", "fr")[i % 2]]]
    wrong = [(1000, "the and with house water over " * 5, "fr", "host.fr", 0), (1001, "12 34 %% !!", "en", "a", 0), (1002, None, None, None, None)]
    out = {r.doc_id: r for r in language.identify_documents(spark.createDataFrame(d + wrong, "doc_id long, text string, lang string, source string, n_chars long"), ["doc_id", "lang"]).collect()}
    assert all(out[i].identified == out[i].lang and out[i].kept for i in range(300))
    assert out[1000].identified == "en" and not out[1001].kept and not out[1002].kept


def test_priors_decide_what_is_ambiguous(spark):
    """Equal texts that say little get the language of their host; texts that say much keep their own."""
    rng = random.Random(12)
    said = {"en": "the and with house water over".split(), "fr": "être où garçon maison leçon très".split()}
    d = [(i, " ".join(rng.choice(said[k]) for _ in range(40)), k, f"host.{k}", 0) for i in range(300) for k in [("en", "fr")[i % 2]]]
    d += [(1000, "qzk", None, "host.en", 0), (1001, "qzk", None, "host.fr", 0), (1002, "the house and the water", None, "host.fr", 0), (1003, "𐐀𐐁𐐂 𐐃𐐄", None, "host.fr", 0)]
    d += [(2000 + i, "the house", f"x{i}", "dirty", 0) for i in range(2)]  # rare labels are no languages of their own
    out = {r.doc_id: r for r in language.identify_documents(spark.createDataFrame(d, "doc_id long, text string, lang string, source string, n_chars long"), ["doc_id"]).collect()}
    assert [out[i].identified for i in (1000, 1001, 1002)] == ["en", "fr", "en"]
    assert out[1000].text_lang == out[1001].text_lang  # the text alone can't tell
    assert out[1003].kept  # letters beyond the first plane are letters
    assert {r.identified for r in out.values()} == {"en", "fr"}


def test_language_with_many_hosts(docs, monkeypatch):
    few = sorted(language.identify_documents(docs, ["doc_id"]).collect(), key=str)
    monkeypatch.setattr(language, "MOST_BROADCAST", 0)
    many = sorted(language.identify_documents(docs, ["doc_id"]).collect(), key=str)
    assert [(r.doc_id, r.identified, r.kept) for r in few] == [(r.doc_id, r.identified, r.kept) for r in many]


def test_page_language(spark, tmp_path):
    rng, np = random.Random(6), language.np
    said = {"en": "the and with house water over".split(), "fr": "être où garçon maison leçon très".split()}
    docs = [(i, " ".join(rng.choice(said[k]) for _ in range(40)), k) for i in range(200) for k in [("en", "fr")[i % 2]]]
    spark.createDataFrame(docs, "doc_id long, text string, lang string").write.parquet(str(tmp_path / "documents.parquet"))
    pages = []
    for i in range(120):
        k = ("en", "fr")[i % 3 == 0]
        body = " ".join(rng.choice(said[k]) for _ in range(rng.choice([0, 1, 30])))
        lang = rng.choice([f' lang="{k}"', f" class=x LANG = {k}-XX", ' lang="xx"', ""])
        url = rng.choice([f"https://both.example.org/{k}/{i}", f"http://h{i % 4}.{k}:80/p", f"https://{k}.example.com/{k}", None])
        pages.append((i, url, f"<!DOCTYPE html><html{lang}><p>{body}</p></html>"))
    pages += [(None, "https://both.example.org/fr/x", None), (200, "", ""), (201, "https://both.example.org/fr/y", "<html><p></p>"), (201, "https://both.example.org/en/y", "<html><p></p>")]
    spark.createDataFrame(pages, "page_id long, url string, html string").write.parquet(str(tmp_path / "pages.parquet"))
    model = language.train(table(spark, str(tmp_path), "documents"))
    texts = [html or "" for _, _, html in pages]
    ll, share = language.log_likelihoods(model, texts)
    best, known = ll.argmax(axis=1).tolist(), model.languages
    place, told = [], []
    for _, url, html in pages:
        host = (re.match(r"[a-zA-Z]+://([^/:?#]+)", url or "") or ["", ""])[1]
        path, label = re.match(r"[a-zA-Z]+://[^/]*/([a-zA-Z]{2})(?:/|$)", url or ""), re.search(r"\.([A-Za-z]{2,})$", host)
        place.append((host, path[1].lower() if path else label[1].lower() if label else ""))
        m = re.search(r"""<html[^>]*?\blang\s*=\s*["']?([A-Za-z]{2,3})""", html or "", re.IGNORECASE)
        told.append(None if not m else known.index(m[1].lower()) if m[1].lower() in known else len(known))
    all_, total = range(len(pages)), [1 + best.count(k) for k in range(2)]
    share_of = lambda at, above, weight: [(sum(best[j] == k for j in at) + weight * above[k]) / (len(at) + weight) for k in range(2)]
    want = {}
    for i in all_:
        around = share_of([j for j in all_ if place[j][1] == place[i][1]], [t / sum(total) for t in total], language.SUFFIX_WEIGHT)
        p = np.log(share_of([j for j in all_ if place[j] == place[i]], around, language.HOST_WEIGHT)) + ll[i]
        if told[i] is not None:
            agree = [[0.02 + sum(told[j] == d and best[j] == k for j in all_) for k in range(2)] for d in range(3)]
            p = p + [math.log(agree[told[i]][k] / sum(a[k] for a in agree)) for k in range(2)]
        p = np.exp(p - p.max())
        p /= p.sum()
        want.setdefault((pages[i][0], pages[i][1]), (known[int(p.argmax())], round(float(p.max()), 6), known[best[i]], bool(p.max() >= 0.5 and share[i] >= 0.2)))
    out = catalog.queries()["op6_page_language"](spark, str(tmp_path)).collect()
    assert len(out) == len(pages)
    assert {(r.page_id, r.url): (r.identified, round(r.confidence, 6), r.text_lang, r.kept) for r in out} == want
    assert want[201, pages[-2][1]][0] == "fr" and want[201, pages[-1][1]][0] == "en"  # the path alone


def test_markup_is_found_anywhere():
    plain, rng = re.compile(r"""<html[^>]*?\blang\s*=\s*["']?([A-Za-z]{2,3})""", re.IGNORECASE), random.Random(8)
    long = ["<!-- " + "x" * 9000 + ' --><html lang="fr">', "<html " + "data=1 " * 200 + "lang=fr>", "<html lang" + " " * 20 + "=" + " " * 20 + "fr>"]
    assert [language.marked(t) for t in long] == ["fr"] * 3
    model = language.Model(["en", "fr"], None)
    assert language.declared_index(model, long, ["en"] * 3).tolist() == [1, 1, 1]
    bits = ["<html", "<HTML ", " lang", "=", ' "en', "fr-FR", ">", " ", "x", "<p lang='de'>", "lang=es"]
    for t in ("".join(rng.choice(bits) for _ in range(rng.randint(1, 12))) for _ in range(5000)):
        m = plain.search(t)
        assert language.marked(t) == (m[1].lower() if m else None)
    assert language.marked("<html " * 200_000) is None


def brute_components(data, n, percent):
    sets = {}
    for r in data:
        w = (r[1] or "").encode().lower().split()
        sets[r[0]] = {tuple(w[i : i + min(n, len(w))]) for i in range(len(w) - min(n, len(w)) + 1)} if w else set()
    up = {i: i for i in sets}

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    for a in sets:
        for b in sets:
            if a < b and sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]):
                x, y = root(a), root(b)
                up[max(x, y)] = min(x, y)
    return {i: (len(s), root(i)) for i, s in sets.items()}


@pytest.mark.parametrize("n", [2, 5])
def test_near_duplicates(docs, data, n):
    want = brute_components(data, n, 80)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in neardup.near_duplicates(docs, n).collect()}
    assert got == want


def test_near_duplicates_in_blocks(docs, data, monkeypatch):
    monkeypatch.setattr(neardup, "CLUSTER_SHINGLES", 60)
    assert {r.doc_id: r.component_id for r in neardup.near_duplicates(docs, 2).collect()} == {i: c for i, (_, c) in brute_components(data, 2, 80).items()}


def test_one_row_of_each_group_stays(spark):
    rng = random.Random(9)
    texts = [" ".join(rng.choice(WORDS) + str(rng.randint(0, 40)) for _ in range(60)) for _ in range(12)]
    near = [t + " more" for t in texts]
    d = [(None, t) for t in texts] * 3 + [(7, t) for t in near[:6]] + [(i + 50, t) for i, t in enumerate(near[6:])] + [(None, None), (None, None), (3, "")]
    d += [(8, "one lone text here")] * 4 + [(9, "first of a repeated id"), (9, "and quite another text of it")]
    docs = spark.createDataFrame(d, "doc_id long, text string").repartition(4)
    out = neardup.near_duplicates(docs, 2).collect()
    assert len(out) == len(d) and sum(r.kept for r in out) == 12 + 3 + 1 + 2
    assert {r.component_id for r in out if r.doc_id in (7, *range(50, 56))} == {-(2**63)}  # near copies of rows without an id
    want = sorted([(None, t) for t in texts] + [(None, None)] * 2 + [(3, ""), (8, "one lone text here"), (9, "first of a repeated id"), (9, "and quite another text of it")], key=str)
    assert sorted([(r.doc_id, r.text) for r in neardup.keep_one(docs, 2).collect()], key=str) == want


def test_components(spark):
    rng = random.Random(4)
    links = [(i, i + 1) for i in range(0, 60) if i % 20 != 19] + [(rng.randrange(100, 160), rng.randrange(100, 160)) for _ in range(50)]
    up = {i: i for ab in links for i in ab}

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    for a, b in links:
        x, y = root(a), root(b)
        up[max(x, y)] = min(x, y)
    got = {r.node: r.root for r in neardup.components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {i: root(i) for i in up if any(i in ab and ab[0] != ab[1] for ab in links)}


PII = (r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", r"[0-9]([\x20-]?[0-9])+", r"\+[0-9][\x20().0-9-]+[0-9]")


def luhn(d):
    return sum(c if i % 2 == 0 else c * 2 - 9 * (c > 4) for i, c in enumerate(map(int, reversed(d)))) % 10 == 0


def personal_spans(t):
    out = []
    for k, p in enumerate(PII):
        for m in re.finditer(p, t):
            d = re.sub("[^0-9]", "", m.group())
            if k == 0 or k == 1 and all(int(x) <= 255 for x in m.group().split(".")) or k == 2 and 14 <= len(d) <= 19 and luhn(d) or k == 3 and 10 <= len(d) <= 15:
                out.append((m.start(), k, m.end()))
    return sorted(out)


def test_personal_base(spark, data):
    rng = random.Random(1)
    bits = ["a@b.cd", "_x@e.f.g", "@", "1.2.3.4", "256.1.1.1", ".5", "4111 1111 1111 1111", "4111-1111-1111-1112", "+1 (555) 123-4567", " ", "é", "😀", "+", "0", "12", "3.", "-", "..", "tel ", "\n", "(212) 555-0100", "123-45-6789"]
    texts = [r[1] for r in data] + ["".join(rng.choice(bits) for _ in range(rng.randint(1, 25))) for _ in range(800)] + ["a.b@c" + ".d" * 9000, "a" * 50000]
    got = {r.doc_id: r for r in personal.find(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(4)).collect()}
    for i, t in enumerate(texts):
        want = personal_spans(t or "")
        told = ",".join(f"{personal.KINDS[k][0]}:{a}:{b}" for a, k, b in want)
        assert got[i].base_sha256 == hashlib.sha256(told.encode()).hexdigest()
        assert set(told.split(",")) - {""} <= set(got[i].spans.split(","))
        assert [got[i].n_email, got[i].n_ip, got[i].n_card, got[i].n_phone] == [sum(k == j for _, k, _ in want) for j in range(4)]


def test_personal_running_totals(spark):
    rng = random.Random(3)
    lists = [[rng.randint(0, 9) for _ in range(n)] for n in (0, 1, 63, 64, 65, 128, 300)]
    F = personal.F
    got = spark.createDataFrame([(x,) for x in lists], "x array<int>").select("x", personal.running(F.col("x"), lambda a, b: a + b, 0).alias("sum"), personal.running(F.col("x"), F.greatest, 0).alias("top")).collect()
    for r in got:
        assert list(r.sum) == [sum(r.x[: i + 1]) for i in range(len(r.x))]
        assert list(r.top) == [max(r.x[: i + 1]) for i in range(len(r.x))]


def test_votes_estimate_reliability():
    """Labelers of known reliability vote on things of known truth; expectation-maximisation finds the truth, and the classifier learns it."""
    rng = random.Random(8)
    seen, true = collections.Counter(), collections.Counter()
    reliable = (0.95, 0.85, 0.7)
    for _ in range(20_000):
        kind = rng.choice([0, 4, 6])
        truth = rng.random() < {0: 0.9, 4: 0.5, 6: 0.2}[kind]
        votes = [int(truth if rng.random() < r else not truth) if rng.random() < 0.9 else None for r in reliable]
        key = (kind, *votes, rng.randint(0, 3))
        seen[key] += 1
        true[key] += truth
    patterns = sorted(seen.items(), key=str)
    posterior = personal.estimate(patterns)
    assert sum((posterior[p] >= 0.5) * true[p] + (posterior[p] < 0.5) * (n - true[p]) for p, n in patterns) / 20_000 > 0.9
    assert sum(abs(posterior[p] - true[p] / n) * n for p, n in patterns) / 20_000 < 0.06
    weights = personal.fit(patterns, posterior)
    told = {p: sum(weights.get(f, 0.0) for f in [None, *personal.features(p)]) >= 0 for p, _ in patterns}
    assert sum(n for p, n in patterns if told[p] == (posterior[p] >= 0.5)) / 20_000 > 0.95


def test_weaker_kinds_are_found(spark):
    """Recall of every kind over planted spans, and no spans in plain text."""
    rng = random.Random(5)
    digit = lambda n: "".join(rng.choice("23456789") for _ in range(n))
    make = {
        "email": lambda: f"{rng.choice(WORDS)}@{rng.choice(WORDS)}.com",
        "ip": lambda: f"10.{rng.randint(0, 255)}.{rng.randint(0, 255)}.7",
        "card": lambda: "4111 1111 1111 1111",
        "phone": lambda: f"+1 (555) {digit(3)}-{digit(4)}",
        "local_phone": lambda: f"({digit(3)}) {digit(3)}-{digit(4)}",
        "spelled_email": lambda: f"{rng.choice(WORDS)} [at] {rng.choice(WORDS)} [dot] com",
        "ssn": lambda: f"{rng.randint(100, 600)}-{digit(2)}-{digit(4)}",
    }
    cue = {"email": "mail", "ip": "server", "card": "credit card", "phone": "call", "local_phone": "phone", "spelled_email": "contact", "ssn": "ssn"}
    texts, planted = [], []
    for i in range(420):
        kind = [*make, None, None][i % 9]
        words = " ".join(rng.choice(WORDS) for _ in range(rng.randint(3, 30)))
        lead = f"{words} {cue[kind]}: " if kind else words
        value = make[kind]() if kind else ""
        texts.append(f"{lead}{value} {rng.choice(WORDS)}")
        planted.append((kind, len(lead), len(lead) + len(value)))
    got = {r.doc_id: (r.spans or "").split(",") for r in personal.find(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    for kind in make:
        own = [i for i, p in enumerate(planted) if p[0] == kind]
        assert sum(f"{kind}:{planted[i][1]}:{planted[i][2]}" in got[i] for i in own) >= 0.9 * len(own), kind
    assert all(got[i] == [""] for i, p in enumerate(planted) if p[0] is None)


def test_weaker_spans_give_way(spark):
    d = [(1, "call (212) 555-0100@x.com now"), (2, "card 4111 1111 1111 1111 212-555-0100"), (3, "mail joe [at] x.com@y.org")] + [(i, f"phone (212) 555-01{i} today") for i in range(10, 40)]
    for r in personal.find(spark.createDataFrame(d, "doc_id long, text string")).collect():
        spans = [(k, int(a), int(b)) for k, a, b in (x.split(":") for x in r.spans.split(",") if x)]
        base = [x for x in spans if x[0] in ("email", "ip", "card", "phone")]
        assert all(b <= a2 or b2 <= a for k, a, b in spans if (k, a, b) not in base for _, a2, b2 in base)
        assert r.doc_id < 10 or [x[0] for x in spans] == ["local_phone"]


def test_pieces_like_the_library(docs, data):
    import sentencepiece as sp

    m = sp.SentencePieceProcessor(model_file=pieces.DEFAULT_MODEL)
    got = pieces.encode(docs)
    for r in got.collect():
        assert list(r.ids) == m.encode(data[r.doc_id][1] or "")
    assert got.where("not round_trip").count() == 1  # the text with a mark of its own
    back = {r.doc_id: r.text for r in pieces.decode(got).collect()}
    assert all(back[r[0]] == (r[1] or "").replace("▁", " ") for r in data)


def test_words_kept_between_slices(data, monkeypatch):
    v = pieces.Vocabulary(["<unk>", *"▁abcdeilotg", "al", "▁a", "be", "ta", "▁al"], [0.0, *[-20.0 - k for k in range(11)], -1.0, -2.0, -3.0, -4.0, -5.0], [2] + [1] * 16, bpe=True)
    texts = [(r[1] or "")[:300] for r in data]
    whole = [x.tolist() for x in v.encode_batch(texts)]
    for most in (0, 30, 1000):
        monkeypatch.setattr(pieces, "RECENT", most)
        v.recent = {}
        assert [x.tolist() for at in range(0, len(texts), 7) for x in v.encode_batch(texts[at : at + 7])] == whole
        assert len(v.recent) <= most


def test_unigram_viterbi():
    words = ["▁", "a", "b", "c", "ab", "bc", "abc", "▁a", "ca"]
    scores = [-2.0, -3.0, -3.1, -2.9, -4.0, -3.7, -7.5, -3.3, -4.4]
    v = pieces.Vocabulary(["<unk>", *words], [0.0, *scores], [2] + [1] * len(words), bpe=False)

    def brute(w):
        best = (-math.inf, None)
        for cuts in product([0, 1], repeat=len(w) - 1):
            edges = [0, *[k + 1 for k, c in enumerate(cuts) if c], len(w)]
            parts = [w[i:j] for i, j in zip(edges, edges[1:])]
            if all(p in v.scores for p in parts):
                best = max(best, (sum(v.scores[p] for p in parts), tuple(v.ids[p] for p in parts)))
        return best[1]

    words = sorted({"▁" + "".join(x) for k in range(1, 6) for x in product("abc", repeat=k)})
    got = v.encode_sorted(words)
    got = {w: pieces.np.frombuffer(x, pieces.np.int32).tolist() for w, x in got.items()}
    assert all(sum(v.scores[v.pieces[i]] for i in got[w]) == pytest.approx(sum(v.scores[v.pieces[i]] for i in brute(w))) for w in words)


def test_chat_is_cheapest():
    def cheapest(said):
        costs = {chat.START: 0.0}
        for r in said:
            new = {}
            for s, c in costs.items():
                for role in range(3):
                    for empties in [(), *[(e,) for e in range(3)]]:
                        at, cost = s, c + chat.INSERT * len(empties)
                        if empties and empties[0] not in chat.FOLLOWS[at]:
                            continue
                        at = empties[0] if empties else at
                        cost += 0 if role == r else chat.UNKNOWN if r == chat.OTHER else chat.RELABEL[r, role]
                        if role in chat.FOLLOWS[at]:
                            new[role] = min(new.get(role, math.inf), cost)
                        if role == at and not empties:
                            new[role] = min(new.get(role, math.inf), cost + chat.MERGE)
            costs = new
        return min(c + chat.ENDS[s][0] for s, c in costs.items())

    for n in range(1, 6):
        for said in product(range(4), repeat=n):
            cost, _ = chat.chain([chat.matrix(list(said))])
            assert cost == pytest.approx(cheapest(said))
            cut = n // 2
            if cut:
                assert chat.chain([chat.matrix(list(said[:cut])), chat.matrix(list(said[cut:]))])[0] == pytest.approx(cost)


def test_chat_rows(spark):
    turns = [(1, 0, "human", "hi <|x"), (1, 1, "user", "there"), (1, 2, None, "yes"), (2, 0, "assistant", None), (None, None, "system", "s")]
    out = {r.conv_id: r for r in chat.format_conversations(spark.createDataFrame(turns, "conv_id long, turn long, role string, text string")).collect()}
    assert out[1].rendered == "<|user|>\nhi < |x\nthere\n<|assistant|>\nyes\n" and out[1].n_merge == 1
    assert out[2].rendered == "<|user|>\n\n<|assistant|>\n\n"
    assert out[None].rendered == "<|user|>\ns\n<|assistant|>\n\n"  # a lone system turn is cheaper as a user's than with two empty turns


def test_chat_many_parts_and_odd_rows(spark, monkeypatch):
    """Parts of long conversations join to what the whole gives; turns without a conversation stand alone; columns that clash are ignored."""
    rng = random.Random(11)
    turns = [(c, t, rng.choice(["system", "user", "assistant", "bot", "tool", None]), rng.choice(["hi", "", None, "<|x"])) for c in range(6) for t in range(rng.randint(1, 40))]
    turns += [(7, 3, "user", "same")] * 3 + [(None, None, "user", "lone")] * 50 + [(None, 9, None, None)]
    df = spark.createDataFrame([(*t, "clash", 1) for t in turns], "conv_id long, turn long, role string, text string, conv string, part int").repartition(4)
    whole = {r.conv_id: (r.rendered, r.cost, r.n_turns) for r in chat.format_conversations(df).where("conv_id is not null").collect()}
    for c in whole:
        own = sorted([t[1:] for t in turns if t[0] == c], key=lambda t: (t[0], t[1] is not None, t[1] or "", t[2] is not None, t[2] or ""))
        roles = [chat.role_of(t[1]) for t in own]
        cost, states = chat.chain([chat.matrix(roles)])
        ways = chat.repair(roles)
        assert whole[c] == (chat.render(ways, [t[2] for t in own], chat.ENDS[states[-1]][1]), pytest.approx(cost), len(own))
    alone = chat.format_conversations(df).where("conv_id is null").collect()
    assert len(alone) == 51 and sum(r.rendered == "<|user|>\nlone\n<|assistant|>\n\n" for r in alone) == 50
    monkeypatch.setattr(chat, "PART", 8)
    parts = collections.defaultdict(list)
    for r in chat.format_conversations(df).where("conv_id is not null").collect():
        parts[r.conv_id].append((r.part, r.rendered, r.cost))
    assert {c: ("".join(x[1] for x in sorted(p)), pytest.approx(sum(x[2] for x in p))) for c, p in parts.items()} == {c: w[:2] for c, w in whole.items()}
