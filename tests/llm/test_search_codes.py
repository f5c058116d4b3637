"""Vector codes, suffix dedup and ranked search against plain versions and on odd tables."""

import hashlib
import math
import random
import re
from collections import Counter

import numpy as np
import pytest

from siftwork.llm import codes, search, suffixes


def rows(df):
    return [tuple(r) for r in df.collect()]


# --- vector codes ----------------------------------------------------------------------------


def plain_codes(vectors, parts=4, entries=256, rounds=4):
    """``vectors``: (id, list, label), all of one length; every distance is computed."""
    kept = sorted((i, [math.floor(1024 * x) for x in v], l) for i, v, l in vectors)
    width = len(kept[0][1]) // parts
    x = np.array([v for _, v, _ in kept], np.int64).reshape(len(kept), parts, width)
    books = [x[:entries, p].copy() for p in range(parts)]
    assign = lambda: [((x[:, p, None, :] - books[p][None]) ** 2).sum(axis=2) for p in range(parts)]
    for _ in range(rounds):
        for p, d in enumerate(assign()):
            to = d.argmin(axis=1)
            for e in set(to.tolist()):
                books[p][e] = x[to == e, p].sum(axis=0) // (to == e).sum()
    last = assign()
    code = np.stack([d.argmin(axis=1) for d in last], axis=1)
    error = sum(d.min(axis=1) for d in last)
    by_label = Counter()
    for (_, _, l), e in zip(kept, error.tolist()):
        by_label[l] += e
    sha = hashlib.sha256(",".join(str(v) for b in books for v in b.ravel().tolist()).encode()).hexdigest()
    return [(i, "".join(f"{c:02x}" for c in cs), e, by_label[l], sha) for (i, _, l), cs, e in zip(kept, code.tolist(), error.tolist())]


VECTORS = "vec_id bigint, embedding array<float>, label int, x int, code string, label_error int"


def vectors(spark, data):
    return spark.createDataFrame([(i, v, l, 1, "c", 2) for i, v, l in data], VECTORS)


@pytest.mark.parametrize(("seed", "dim", "spread"), [(1, 16, 1.0), (2, 32, 0.02), (3, 12, 40.0), (4, 4, 0.003)])
def test_codes_equal_full_search(spark, seed, dim, spread):
    draw = np.random.default_rng(seed)
    data = [(k, draw.normal(0, spread, dim).astype(np.float32).tolist(), None if k % 7 == 0 else k % 3) for k in range(400)]
    data += [(1000 + k, data[5][1], 1) for k in range(60)]  # a common vector
    assert sorted(rows(codes.compress(vectors(spark, data)))) == sorted(plain_codes(data))


def test_codes_of_odd_rows(spark):
    good = [(k, [0.1 * k, -0.2, 0.3, 0.4], k % 2) for k in range(6)]
    odd = [(50, None, 1), (51, [0.1, None, 0.2, 0.3], 1), (52, [0.1, float("nan"), 0.2, 0.3], 1), (53, [float("inf"), 0.0, 0.0, 0.0], 1)]
    assert sorted(rows(codes.compress(vectors(spark, good + odd)))) == sorted(plain_codes(good))
    other = rows(codes.compress(vectors(spark, good + [(60, [1.0, 2.0], 1), (None, [0.1, -0.2, 0.3, 0.4], None)])))
    assert len(other) == 8 and [(r[1], r[2]) for r in other if r[0] == 60] == [(None, None)]
    assert [r[1] for r in other if r[0] is None] == [next(r[1] for r in other if r[0] == 1)]
    assert rows(codes.compress(vectors(spark, []))) == [] and rows(codes.compress(vectors(spark, [(1, [], 1)]))) == [(1, None, None, None, hashlib.sha256(b"").hexdigest())]
    with pytest.raises(ValueError, match="equal parts"):
        codes.compress(vectors(spark, [(1, [1.0, 2.0, 3.0], 1)]))
    with pytest.raises(ValueError, match="beyond"):
        codes.compress(vectors(spark, [(1, [1e30, 2.0, 3.0, 4.0], 1)]))


def test_bounds_save_distances():
    draw = np.random.default_rng(5)
    centres = draw.normal(0, 3, (40, 16))
    book = np.floor(1024 * np.repeat(centres, 6, axis=0) + draw.normal(0, 20, (240, 16))).astype(np.int64)
    x = np.floor(1024 * centres[draw.integers(0, 40, 3000)] + draw.normal(0, 20, (3000, 16))).astype(np.int64)
    index, distance, exact = codes.nearest(x, book)
    every = ((x[:, None] - book[None]) ** 2).sum(axis=2)
    assert (index == every.argmin(axis=1)).all() and (distance == every.min(axis=1)).all()
    assert exact < every.size / 4


# --- suffix dedup ----------------------------------------------------------------------------


def plain_removed(texts, length=200):
    data = [(i, (t or "").encode()) for i, t in texts]
    seen = Counter(x[k : k + length] for _, x in data for k in range(len(x) - length + 1))
    out = []
    for i, x in data:
        gone = bytearray(len(x))
        for k in range(len(x) - length + 1):
            if seen[x[k : k + length]] > 1:
                gone[k : k + length] = b"\1" * length
        kept = bytes(v for v, g in zip(x, gone) if not g)
        spans = sum(1 for k in range(len(gone)) if gone[k] and (k == 0 or not gone[k - 1]))
        out.append((i, len(x), sum(gone), spans, hashlib.sha256(kept).hexdigest()))
    return out


def corpus(seed):
    """Random words with passages of 190 to 420 bytes copied between and inside texts."""
    r = random.Random(seed)
    words = ["".join(r.choice("abcdeäß字") for _ in range(r.randint(1, 7))) for _ in range(60)]
    text = lambda n: " ".join(r.choice(words) for _ in range(n))
    passages = [text(60)[:n] for n in (120, 195, 200, 201, 230, 300)]
    out = []
    for k in range(60):
        parts = [text(r.randint(0, 40))]
        for _ in range(r.randint(0, 3)):
            parts += [r.choice(passages), text(r.randint(0, 30))]
        out.append((k, r.choice(["", " "]).join(parts)))
    out += [(100 + k, out[3][1]) for k in range(3)]  # exact copies
    near = text(200)
    for k in range(12):
        at = r.randrange(len(near))
        out.append((200 + k, near[:at] + "X" + near[at + 1 :]))
    return out


EDGES = [(300, "9" * 900), (301, "ab" * 150), (302, "ab" * 99), (303, None), (304, ""), (305, "q" * 200), (306, "q" * 199), (307, "ab" * 100 + "c"), (None, "z" * 200), (None, "z" * 201)]


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_removed_equals_plain(spark, seed):
    texts = corpus(seed) + EDGES
    docs = spark.createDataFrame([(i, t, 1, "k", "b") for i, t in texts], "doc_id bigint, text string, n int, key string, body string")
    want = sorted(plain_removed(texts), key=str)
    got = lambda crowd: sorted(rows(suffixes.removed(docs, crowd=crowd).drop("kept")), key=str)
    assert got(suffixes.CROWD) == want
    if seed == 1:
        assert got(300) == want  # nearly all minima are taken apart


def test_kept_text(spark):
    texts = corpus(4)
    docs = spark.createDataFrame(texts, "doc_id bigint, text string")
    whole = dict(texts)
    for doc_id, n, gone, _, sha, kept in rows(suffixes.removed(docs)):
        left = whole[doc_id].encode() if kept is None else bytes(kept)
        assert len(left) == n - gone and hashlib.sha256(left).hexdigest() == sha


def test_removed_from_odd_tables(spark, docs, none):
    got = rows(suffixes.removed(docs).drop("kept"))
    texts = [tuple(r) for r in docs.select("doc_id", "text").collect()]
    assert sorted(got, key=str) == sorted(plain_removed(texts), key=str)
    assert {r[0]: r[2] for r in got if r[0] == 12} == {12: 60_000}  # a run of one digit repeats itself
    assert rows(suffixes.removed(none)) == []


@pytest.mark.parametrize("seed", range(6))
def test_suffixes_of_a_group(seed):
    r = random.Random(seed)
    core = bytes(r.choice(b"ab") for _ in range(400))
    pieces = [core[a : a + 200 + r.randint(0, 40)] for a in (r.randint(0, 150) for _ in range(25))] + [bytes(r.choice(b"ab") for _ in range(230))]
    pieces = [p for p in pieces if len(p) >= 200]
    seen = Counter(p[k : k + 200] for p in pieces for k in range(len(p) - 199))
    assert [f.tolist() for f in suffixes.repeated(pieces)] == [[seen[p[k : k + 200]] > 1 for k in range(len(p) - 199)] for p in pieces]


# --- ranked search ---------------------------------------------------------------------------


def plain_ranked(docs, items, top):
    term = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    bags = [(i, Counter(term(t))) for i, t in docs if term(t)]
    every, total = len(bags), sum(sum(b.values()) for _, b in bags)
    df = Counter(w for _, b in bags for w in b)
    out = []
    for item, text in items:
        scored = []
        for i, b in bags:
            m = 100 - 50 + (50 * sum(b.values()) * every) // total
            s = sum(math.floor(1000 * math.log((2 * every + 2) / (2 * df[w] + 1))) * ((1_000_000_000 * b[w]) // (1000 * b[w] + 20 * m)) for w in set(term(text)) if w in b)
            if s > 0:
                scored.append((-s, i is not None, i or 0, i))
        out += [(item, k + 1, s[3], -s[0]) for k, s in enumerate(sorted(scored, key=lambda s: s[:3])[:top])]
    return out


def shelf(seed, n=300):
    r = random.Random(seed)
    words = [f"w{k}" for k in range(80)] + ["Ärger", "字", "X1"]
    bag = lambda: " ".join(r.choice(words[: r.choice((5, 20, 83))]) for _ in range(r.randint(0, 60)))
    docs = [(k, bag()) for k in range(n)]
    docs += [(n + k, docs[7][1]) for k in range(20)] + [(None, docs[8][1]), (9, "w1 w1 w2"), (400, None), (401, "?!")]
    r.shuffle(docs)
    return docs, [(k, bag()) for k in range(20)] + [(90, None), (91, "nowhere"), (90, "w1"), (None, "W1, w2; x1 ärger Ärger")]


@pytest.mark.parametrize(("seed", "shard", "block", "top"), [(1, 64, 4096, 50), (2, 7, 5, 3), (3, 8192, 9, 10)])
def test_ranked_equals_full_scores(spark, seed, shard, block, top):
    docs, items = shelf(seed)
    d = spark.createDataFrame([(i, t, 5, "r", 1) for i, t in docs], "doc_id bigint, text string, rank int, score string, n int")
    q = spark.createDataFrame([(i, t, 2) for i, t in items], "item_id int, text string, place int")
    got = rows(search.ranked(d, q, top=top, shard=shard, block=block))
    assert sorted(got, key=str) == sorted(plain_ranked(docs, items, top), key=str)
    assert rows(search.ranked(d.limit(0), q)) == [] and rows(search.ranked(d, q.limit(0))) == []


def test_best_first_leaves_most_nodes():
    draw = np.random.default_rng(1)
    n, terms = 4096, 6
    doc = np.concatenate([draw.choice(n, 1500, replace=False) for _ in range(terms)])
    term = np.repeat(np.arange(terms), 1500)
    impact = draw.pareto(1.0, len(doc)).clip(0, 1000) * 1000 // 1
    tree = search.build(list(range(n)), doc, term, impact.astype(np.int64), terms)
    weights = np.arange(1, terms + 1)
    found, expanded = search.best(tree, np.arange(terms), weights, 10)
    score = np.zeros(n, np.int64)
    np.add.at(score, doc, weights[term] * impact.astype(np.int64))
    want = sorted(((-s, k) for k, s in enumerate(score.tolist())))[:10]
    assert found == [(-s, k) for s, k in want]
    assert expanded < n / 2
