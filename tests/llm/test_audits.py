"""Toxicity, manifests and divergence, each against a plain version."""

import hashlib
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from tests.llm.conftest import SCHEMA, odd_documents, sentence
from tidemark.llm import divergence, merkle, toxicity

H = lambda parts: hashlib.sha256("".join(parts).encode()).hexdigest()


# manifests


def levels_of(nodes):
    out = [nodes]
    while len(out[-1]) > 1:
        out.append([H(out[-1][a : a + 8]) for a in range(0, len(out[-1]), 8)])
    return out


def plain_manifest(rows):
    said = lambda v: "-" if v is None else f"{len(str(v).encode())}:{v}"
    leaf = lambda r, text: H(map(said, (r[0], r[3], r[2], r[4], text)))
    groups = defaultdict(list)
    for r in rows:
        altered = None
        if r[0] is not None and zlib.crc32(str(r[0]).encode()) % 3 == 0:
            altered = leaf(r, r[1] and re.sub("[A-Z]", lambda m: m[0].lower(), r[1]))
        groups["" if r[2] is None else "=" + r[2]].append(((r[0] is not None, r[0] or 0), leaf(r, r[1]), altered, r[0]))
    trees = {k: levels_of([x[1] for x in sorted(v, key=lambda x: x[:2])]) for k, v in groups.items()}
    names = sorted(trees, key=str.encode)
    upper = levels_of([trees[k][-1][0] for k in names])
    out = Counter()
    for k, v in groups.items():
        for i, (_, own, altered, doc_id) in enumerate(sorted(v, key=lambda x: x[:2])):
            others, now = [], altered or own
            for at, levels in ((i, trees[k]), (names.index(k), upper)):
                for level in levels[:-1]:
                    first = at - at % 8
                    run = level[first : first + 8]
                    others += run[: at % 8] + run[at % 8 + 1 :]
                    now, at = H([*run[: at % 8], now, *run[at % 8 + 1 :]]), at // 8
            out[(doc_id, own, trees[k][-1][0], upper[-1][0], H(others), now, now == upper[-1][0])] += 1
    return out


@pytest.mark.parametrize("levels", [1, 2, 4])
def test_manifest_by_definition(spark, levels):
    rows = [r[:5] for r in odd_documents()]
    rows += [(1000 + k, f"Text {k}", f"l{k % 11}" if k % 2 else "en", "s", k) for k in range(150)] + [(-5, "x", "EN", None, None), (-5, "x", "EN", None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").repartition(5)
    assert Counter(map(tuple, merkle.prove(docs, levels).collect())) == plain_manifest(rows)


def test_manifest_of_few_rows(spark, no_docs):
    assert merkle.prove(no_docs).count() == 0
    one = [(7, "A", None, None, None)]
    docs = spark.createDataFrame(one, "doc_id long, text string, lang string, source string, n_chars long").withColumns({})
    assert Counter(map(tuple, merkle.prove(docs).collect())) == plain_manifest(one)


@pytest.mark.parametrize("n", [1, 2, 7, 8, 9, 63, 64, 65, 200, 513])
def test_positions_follow_the_log(n):
    log = merkle.postorder([bytes([k % 251]) * 32 for k in range(n)], merkle.height(n))
    assert [merkle.position(level, i, n) for level, i, _ in log] == list(range(len(log)))


def test_paths_survive_packing():
    path = [(3, [b"a" * 32, b"b" * 32]), (0, []), (1, [b"c" * 32])]
    assert merkle.unpack(merkle.pack(path)) == path


# divergence


def plain_audit(rows, at_least, ranks):
    docs = [(r[2] or "", r[3] or "", re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), r[1] or ""))) for r in rows]
    out = Counter()
    for lang in {d[0] for d in docs}:
        mine = [d for d in docs if d[0] == lang]
        df = Counter(t for d in mine for t in set(d[2]))
        kept = {t for t, n in df.items() if n >= at_least}
        counts = {s: Counter() for s in {d[1] for d in mine}}
        for _, s, found in mine:
            counts[s].update(t for t in found if t in kept)
        whole = sum(counts.values(), Counter())
        share = lambda c: {t: 1 + 1_000_000_000 * (c[t] + 5) // (sum(c.values()) + 5 * len(kept)) for t in kept}
        p, q = {s: share(c) for s, c in counts.items()}, share(whole)
        for s in counts:
            pair = [(sum(abs(p[s][t] - p[o][t]) for t in kept), o) for o in counts if o != s]
            term = [(p[s][t] - q[t], t) for t in kept if counts[s][t] and p[s][t] > q[t]]
            for part, found, most in (("pair", pair, None), ("term", term, ranks)):
                for k, (value, item) in enumerate(sorted(found, key=lambda x: (-x[0], x[1].encode()))[:most], 1):
                    out[(lang, s, part, item, value, k)] += 1
    return out


@pytest.fixture(scope="module")
def sourced():
    rng = np.random.default_rng(5)
    rows = [r[:4] for r in odd_documents()]
    words = [f"w{'abcdefghij'[k % 10]}{'klmnopqrst'[k // 10]}ö" for k in range(100)]
    for k in range(300):
        at = rng.integers(0, 100, 30) if k % 3 else rng.integers(0, 20, 60)
        rows.append((500 + k, " ".join(words[i] for i in at) + " The END", ("en", "de", None)[k % 3], f"s{k % 7}" if k % 5 else None))
    return [*rows, (9, "lonely", "zz", "a"), (10, None, "en", "empty"), (11, "x", "yy", "a"), (12, "y", "yy", "b")]


@pytest.mark.parametrize(("bits", "held", "tile", "cells"), [(64, 400_000, 256, 1 << 18), (6, 50, 256, 1 << 18), (64, 50, 3, 64), (0, 400_000, 2, 1000)])
def test_audit_by_definition(spark, sourced, bits, held, tile, cells):
    docs = spark.createDataFrame(sourced, "doc_id long, text string, lang string, source string").repartition(4)
    for at_least, ranks in ((5, 7),) if bits < 64 or tile < 256 else ((5, 7), (30, 50)):
        got = Counter(map(tuple, divergence.audit(docs, at_least, ranks, bits, held, tile, cells).collect()))
        assert got == plain_audit(sourced, at_least, ranks)


def test_audit_of_nothing(no_docs):
    assert divergence.audit(no_docs).count() == 0


def test_shares_are_exact_beyond_64_bits():
    n = np.array([[10**12, 3]])
    assert divergence._shares(n, np.array([2 * 10**12 + 7])).tolist() == [[1 + (10**12 + 5) * 10**9 // (2 * 10**12 + 7), 1 + 8 * 10**9 // (2 * 10**12 + 7)]]


# toxicity


def test_gradients_are_those_of_the_loss():
    net = toxicity.Network.fresh({"aa": 1, "bb": 2})
    net.p = {k: v.astype(np.float64) for k, v in net.p.items()}
    words = ["aa", "bb", "cat"]
    ids = np.array([[1, 2, 3, 3], [3, 1, 0, 2], [2, 2, 0, 0]])
    label, weight = np.array([1.0, 0, 1, 0]), np.array([1.0, 2, 1, 1])
    own, grams = np.array([1, 2, 0]), toxicity.grams_of(words)

    def loss():
        logit = net.pooled(ids, (h := np.empty((3, 2 * toxicity.HIDDEN, 4)), [net.states(ids, net.tables(net.vectors(words))[d], d, h[:, p]) for d, p in toxicity._LAYERS])[0])[3]
        return float((weight * (np.log1p(np.exp(logit)) - label * logit)).sum() / weight.sum())

    g = net.gradients(ids, label, weight, net.vectors(words), (own, *grams))
    for name, values in net.p.items():
        dense = np.zeros(values.shape)
        if isinstance(g[name], tuple):
            dense[g[name][0]] = g[name][1]
        else:
            dense[...] = g[name]
        for at in [np.unravel_index(k, values.shape) for k in np.argsort(-np.abs(dense).ravel())[:4]]:
            keep = values[at]
            values[at] = keep + 1e-3
            up = loss()
            values[at] = keep - 1e-3
            down = loss()
            values[at] = keep
            assert abs((up - down) / 2e-3 - dense[at]) < 2e-5, name


def test_scoring_in_place_gives_the_same_states():
    rng = np.random.default_rng(1)
    net = toxicity.Network.fresh({})
    words = [f"w{k}" for k in range(50)]
    ids, tables = rng.integers(0, 51, (32, 40)), net.tables(net.vectors(words))
    for d, _ in toxicity._LAYERS:
        a, b = (np.empty((32, toxicity.HIDDEN, 40), np.float32) for _ in range(2))
        net.states(ids, tables[d], d, a)
        net.states_in_place(ids, tables[d], d, b)
        assert np.abs(a - b).max() < 1e-5


def test_words_and_windows():
    texts = [None, "", "Hello, wörld_x y", ".. ", "x" * 60 + " abc", "don't stop me now  ", " a\x1cb ,c.", "İ ẞ Σ"]
    codes, n, distinct = toxicity.words_in(texts)
    at = np.cumsum(n) - n
    assert [[distinct[k] for k in codes[a : a + m]] for a, m in zip(at, n, strict=True)] == [toxicity.words_of(t or "") for t in texts]
    for n in range(200):
        starts = list(toxicity.window_starts(n))
        assert (not starts) == (n == 0) and (not n or starts[-1] + toxicity.WINDOW >= n) and all(b - a == toxicity.STRIDE for a, b in zip(starts, starts[1:]))


def toxic_rows():
    rng = __import__("random").Random(11)
    rows, labels = [], []
    for k in range(500):
        toxic = k % 4 == 0
        words = sentence(rng, rng.randrange(20, 300)).split()
        for _ in range(1 + len(words) // 60 if toxic else 0):
            words.insert(rng.randrange(len(words)), rng.choice(["vilest", "rotten", "scoundrel", "zubb" + rng.choice("aeiou") + rng.choice("klmn")]))
        rows.append((k, " ".join(words)))
        labels.append((k, int(toxic)))
    return rows, labels


def test_toxic_texts_are_found(spark):
    rows, labels = toxic_rows()
    docs = spark.createDataFrame([(i, t, "x", 5) for i, t in rows] + [(None, "rotten vilest", "x", 1), (900, None, None, None), (901, "", "", 0), (902, "...", "", 0), rows[3] + ("y", 2)], "doc_id long, text string, labels string, toxic long").repartition(3)
    marks = spark.createDataFrame(labels + [(None, 1), (3, None), (9999, 1)], "doc_id long, toxic int")
    got = toxicity.score_documents(docs, marks).collect()
    assert len(got) == 505 and got[0].asDict().keys() == {"doc_id", "held_out", "score", "predicted"}
    held = [(r["predicted"], dict(labels)[r["doc_id"]]) for r in got if r["held_out"] and r["doc_id"] in dict(labels)]
    assert all(r["held_out"] == (r["doc_id"] is not None and zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) for r in got)
    assert np.mean([a == b for a, b in held]) > 0.97 and len(held) > 70
    assert all(r["score"] == 0 for r in got if r["doc_id"] in (900, 901, 902)) and all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.5) for r in got)


def test_nothing_to_learn_from(spark, no_docs):
    docs = spark.createDataFrame([(1, "a b"), (2, None)], "doc_id long, text string")
    labels = spark.createDataFrame([(1, 1)], "doc_id long, toxic int")
    assert [tuple(r) for r in toxicity.score_documents(docs, labels).orderBy("doc_id").collect()] == [(1, False, 0.0, 0), (2, False, 0.0, 0)]
    assert toxicity.score_documents(no_docs, labels.limit(0)).count() == 0


@pytest.mark.parametrize("logit", [[0.0], [1.0, 2, 3]])
def test_threshold(logit):
    label = np.array([0, 0, 1])[-len(logit) :]
    t = toxicity.threshold(np.array(logit), label)
    assert ((np.array(logit) > t) == label).all()
