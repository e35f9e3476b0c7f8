"""Toxicity by a bidirectional gated recurrent network with attention pooling, trained here in numpy.

A text is its words (runs of letters and digits, small, at most `LONGEST` characters a piece), cut into windows of
`WINDOW` words, of which each begins `STRIDE` words after the one before, so that they overlap. A word enters the network as its own vector, if it is in the vocabulary, and the mean of the
vectors of its character n-grams with marks at its ends. Two gated recurrent layers read the window from both ends,
attention pools their states, and the pooled state gives the window's score; a text scores what its worst window does,
and every window of every text is scored.

Labels are those of whole texts, so learning goes in turns: after a first pass in which a toxic text's windows all count as
toxic, only the windows that the network itself finds worst stand for a text, toxic or not. A tenth of the sample is
kept from learning to place the threshold at a score of 0.5.

Learning reads a bounded sample: at most `SAMPLES` labelled rows of each label, chosen by hash, of each at most
`WINDOWS` windows, chosen by hash where the text is longer. All sizes of the network are parameters too. So what the
driver holds, and what it sends to the tasks, does not grow with the tables.

Defined cases: null and empty texts, and those without words, score 0; without labels of both kinds every text scores 0; a doc_id
with labels of both kinds counts as toxic, a null label as none; a null doc_id is not learned from and not held out; of
repeated rows of a doc_id one is learned from, and each is scored; columns other than `doc_id` and `text` are not read.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import batch_rows, map_arrow

WINDOW, STRIDE, LONGEST = 32, 24, 24
SAMPLES, WINDOWS, SEED = 2048, 256, 42
#: Sizes of the network: vocabulary, buckets of n-grams, vectors, states of one direction, attention.
WORDS, GRAMS, VECTOR, HIDDEN, ATTENTION = 1 << 16, 1 << 16, 8, 8, 8
NGRAMS = (3, 4, 5)
#: Windows computed together.
TOGETHER = 1024

_LAYERS = (("f", slice(0, HIDDEN)), ("b", slice(HIDDEN, 2 * HIDDEN)))  # forwards and backwards
_WORD = re.compile(r"\w+")
_FACTOR = np.uint32(0x9E3779B1)


def words_of(text: str) -> list[str]:
    """The words of a text; longer ones in pieces."""
    found = _WORD.findall(text.lower().replace("_", " "))
    if found and max(map(len, found)) > LONGEST:
        found = [w[a : a + LONGEST] for w in found for a in range(0, len(w), LONGEST)]
    return found


def words_in(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, list[str]]:
    """The same for many texts: places of their words, one text after the other, how many words each has, and the distinct words.

    Texts are split at white space; only distinct chunks are looked at more closely."""
    split = [(t or "").lower().split() for t in texts]
    codes, chunks = pd.factorize(np.array([c for cs in split for c in cs], object))
    found = [[c] if len(c) <= LONGEST and c.isalnum() else [c[:-1]] if c[-1] in ".,!?" and 1 < len(c) <= LONGEST and c[:-1].isalnum() else words_of(c) for c in chunks]
    n = np.array([len(f) for f in found], np.int64)
    of_chunk, distinct = pd.factorize(np.array([w for ws in found for w in ws], object))
    each = n[codes] if len(codes) else np.zeros(0, np.int64)
    ends = np.cumsum(each)
    places = np.repeat((np.cumsum(n) - n)[codes] - (ends - each), each) + np.arange(ends[-1]) if len(ends) else np.zeros(0, np.int64)
    edges = np.cumsum([len(cs) for cs in split])
    upto = np.r_[0, ends][edges]
    return of_chunk[places], np.diff(np.r_[0, upto]), list(distinct)


def window_starts(n: int) -> range:
    """Where the windows of n words begin; the last reaches the end."""
    return range(0, max(n - WINDOW + STRIDE, 1), STRIDE) if n else range(0)


def grams_of(words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each size of n-grams and each character of the marked words: the bucket of the n-gram that begins there (0: none). Then
    where each word begins, and how many n-grams it has."""
    size = np.array([len(w) for w in words]) + 2
    points = np.frombuffer(f"<{'><'.join(words)}>".encode("utf-32-le", "surrogatepass"), np.uint32)
    ends = np.cumsum(size)
    left = np.repeat(ends, size) - np.arange(len(points))  # characters from here to the word's end
    buckets = np.zeros((len(NGRAMS), len(points)), np.int32)
    mixed = np.zeros(len(points), np.uint32)
    for k in range(max(NGRAMS)):
        mixed[: len(points) - k] += points[k:] + np.uint32(1)
        mixed *= _FACTOR
        mixed ^= mixed >> np.uint32(15)
        if k + 1 in NGRAMS:
            bucket = (mixed * _FACTOR >> np.uint32(32 - (GRAMS - 1).bit_length())).astype(np.int32)
            buckets[NGRAMS.index(k + 1)] = np.where(left > k, np.maximum(bucket, 1), 0)
    first = ends - size
    return buckets, first, sum(np.maximum(size - k + 1, 0) for k in NGRAMS)


def sigmoid(x: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        e = np.exp(-x)
    e += np.float32(1)
    return np.divide(np.float32(1), e, out=e)


def tanh(x: np.ndarray) -> np.ndarray:
    """By the same fast exponential; numpy's own takes three times as long."""
    y = sigmoid(np.float32(2) * x)
    y *= np.float32(2)
    y -= np.float32(1)
    return y


@dataclass
class Network:
    """Parameters, all float32; `words` is the vocabulary, from 1 on; row 0 of the vectors is for what is in none."""

    words: dict[str, int]
    p: dict[str, np.ndarray] = field(default_factory=dict)

    @classmethod
    def fresh(cls, words: dict[str, int], seed: int = SEED) -> Network:
        rng = np.random.default_rng(seed)
        shapes = {"own": (len(words) + 1, VECTOR), "gram": (GRAMS, VECTOR), "attend": (2 * HIDDEN, ATTENTION), "attend_by": (ATTENTION,), "asked": (ATTENTION,), "out": (2 * HIDDEN,), "out_by": (1,)}
        shapes |= {f"{k}_{d}": s for d in "fb" for k, s in (("in", (2 * VECTOR, 3 * HIDDEN)), ("in_by", (3 * HIDDEN,)), ("carry", (HIDDEN, 3 * HIDDEN)))}
        p = {k: (rng.standard_normal(s) * (0 if k.endswith("_by") else 0.1 if k in ("own", "gram") else 0.3)).astype(np.float32) for k, s in shapes.items()}
        p["own"][0] = p["gram"][0] = 0
        return cls(words, p)

    def vectors(self, words: list[str]) -> np.ndarray:
        """A vector for each word."""
        return self.joined(np.array([self.words.get(w, 0) for w in words]), *grams_of(words))

    def joined(self, own: np.ndarray, buckets: np.ndarray, first: np.ndarray, n: np.ndarray) -> np.ndarray:
        """Vectors of words by their places in the vocabulary and their n-grams."""
        gram = self.p["gram"]
        each = np.take(gram, buckets[0], axis=0)
        for of in buckets[1:]:
            each += np.take(gram, of, axis=0)
        return np.concatenate([self.p["own"][own], np.add.reduceat(each, first) / n[:, None].astype(np.float32)], axis=1)

    def tables(self, x: np.ndarray) -> dict[str, np.ndarray]:
        """What each word (from column 1 on) adds to the gates of both layers. Column 0 pads a window: its update gate is shut."""
        shut = np.zeros((3 * HIDDEN, 1), np.float32)
        shut[:HIDDEN] = -40
        return {d: np.concatenate([shut, self.p[f"in_{d}"].T @ x.T + self.p[f"in_by_{d}"][:, None]], axis=1) for d in "fb"}

    def states(self, ids: np.ndarray, table: np.ndarray, d: str, out: np.ndarray) -> list:
        """A layer's states after each step go to `out` (steps x states x windows); `ids` is steps x windows.
        What each step computed is returned."""
        carry, kept = np.ascontiguousarray(self.p[f"carry_{d}"].T), []
        h = np.zeros((HIDDEN, ids.shape[1]), np.float32)
        for t in range(len(ids)) if d == "f" else range(len(ids) - 1, -1, -1):
            x, u = np.take(table, ids[t], axis=1), carry @ h
            gates = sigmoid(x[: 2 * HIDDEN] + u[: 2 * HIDDEN])
            z, r, uc = gates[:HIDDEN], gates[HIDDEN:], u[2 * HIDDEN :]
            c = tanh(x[2 * HIDDEN :] + r * uc)
            kept.append((t, h, z, r, c, uc))
            h = h + z * (c - h)
            out[t] = h
        return kept

    def states_in_place(self, ids: np.ndarray, table: np.ndarray, d: str, out: np.ndarray) -> None:
        """The same states, in two buffers and with exponentials of what is scaled beforehand; for scoring."""
        scale = np.r_[np.full(2 * HIDDEN, -1), np.full(HIDDEN, -2)].astype(np.float32)[:, None]
        carry, table = np.ascontiguousarray(self.p[f"carry_{d}"].T) * scale, table * scale
        x, u = (np.empty((3 * HIDDEN, ids.shape[1]), np.float32) for _ in range(2))
        gates, c, uc = x[: 2 * HIDDEN], x[2 * HIDDEN :], u[2 * HIDDEN :]
        h = np.zeros((HIDDEN, ids.shape[1]), np.float32)
        with np.errstate(over="ignore"):
            for t in range(len(ids)) if d == "f" else range(len(ids) - 1, -1, -1):
                np.take(table, ids[t], axis=1, out=x, mode="clip")
                np.matmul(carry, h, out=u)
                gates += u[: 2 * HIDDEN]
                np.exp(gates, out=gates)
                gates += 1
                np.reciprocal(gates, out=gates)
                uc *= gates[HIDDEN:]
                c += uc
                np.exp(c, out=c)
                c += 1
                np.divide(2, c, out=c)
                c -= 1
                c -= h
                c *= gates[:HIDDEN]
                h = np.add(h, c, out=out[t])

    def pooled(self, ids: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, ...]:
        """Attention over the steps: its inner values, its weights, the pooled state, and the windows' logits."""
        inner = tanh(np.ascontiguousarray(self.p["attend"].T) @ h + self.p["attend_by"][:, None])
        weight = self.p["asked"] @ inner
        weight[ids == 0] = -1e9
        weight = np.exp(weight - weight.max(axis=0))
        weight /= weight.sum(axis=0)
        pool = np.zeros(h.shape[1:], np.float32)
        for t in range(len(h)):
            pool += weight[t] * h[t]
        return inner, weight, pool, self.p["out"] @ pool + self.p["out_by"]

    def logits(self, ids: np.ndarray, tables: dict[str, np.ndarray]) -> np.ndarray:
        """Of windows (steps x windows of columns of the tables)."""
        h = np.empty((len(ids), 2 * HIDDEN, ids.shape[1]), np.float32)
        for d, part in _LAYERS:
            self.states_in_place(ids, tables[d], d, h[:, part])
        return self.pooled(ids, h)[3]

    def gradients(self, ids: np.ndarray, label: np.ndarray, weight_of: np.ndarray, x: np.ndarray, context: tuple) -> dict:
        """Of the weighted logistic loss, by parameter; those of vectors as (rows, values)."""
        p, tables = self.p, self.tables(x)
        h = np.empty((len(ids), 2 * HIDDEN, ids.shape[1]), np.float32)
        kept = {d: self.states(ids, tables[d], d, h[:, part]) for d, part in _LAYERS}
        inner, a, pool, logit = self.pooled(ids, h)
        d_logit = ((sigmoid(logit) - label) * weight_of / weight_of.sum()).astype(np.float32)
        g: dict = {"out": pool @ d_logit, "out_by": d_logit.sum(keepdims=True)}
        d_pool = p["out"][:, None] * d_logit
        d_a = np.einsum("thn,hn->tn", h, d_pool)
        d_score = a * (d_a - (a * d_a).sum(axis=0))
        g["asked"] = np.einsum("tn,tan->a", d_score, inner)
        d_inner = d_score[:, None] * p["asked"][:, None] * (1 - inner * inner)
        g["attend"] = (h @ d_inner.transpose(0, 2, 1)).sum(axis=0)
        g["attend_by"] = d_inner.sum(axis=(0, 2))
        d_h = a[:, None] * d_pool + p["attend"] @ d_inner
        flat, order = ids.ravel(), np.argsort(ids.ravel(), kind="stable")
        begin = np.flatnonzero(np.r_[True, np.diff(flat[order]) > 0])
        rows = flat[order][begin]
        d_x = np.zeros_like(x)
        for d, part in _LAYERS:
            carry = p[f"carry_{d}"]
            d_carry, back = np.zeros_like(carry), np.zeros((HIDDEN, ids.shape[1]), np.float32)
            d_in = np.empty((len(ids), 3 * HIDDEN, ids.shape[1]), np.float32)
            for t, before, z, r, c, uc in reversed(kept[d]):
                back = back + d_h[t, part]
                d_c = back * z * (1 - c * c)
                d_z = back * (c - before) * z * (1 - z)
                d_r = d_c * uc * r * (1 - r)
                d_in[t] = np.concatenate([d_z, d_r, d_c])
                d_u = np.concatenate([d_z, d_r, d_c * r])
                d_carry += before @ d_u.T
                back = back * (1 - z) + carry @ d_u
            by_word = np.add.reduceat(d_in.transpose(0, 2, 1).reshape(-1, 3 * HIDDEN)[order], begin)
            by_word, real = (by_word[1:], rows[1:] - 1) if rows[0] == 0 else (by_word, rows - 1)
            g[f"carry_{d}"], g[f"in_{d}"], g[f"in_by_{d}"] = d_carry, x[real].T @ by_word, by_word.sum(axis=0)
            d_x[real] += by_word @ p[f"in_{d}"].T
        own, buckets, first, n = context
        known = own > 0
        g["own"] = (own[known], d_x[known, :VECTOR])
        each = np.repeat(d_x[:, VECTOR:] / n[:, None].astype(np.float32), np.diff(np.r_[first, buckets.shape[1]]), axis=0)
        used = np.zeros(GRAMS, bool)
        used[buckets] = True
        used[0] = False
        total = np.stack([sum(np.bincount(of, each[:, k], GRAMS) for of in buckets)[used] for k in range(VECTOR)], axis=1)
        g["gram"] = (np.flatnonzero(used), total.astype(np.float32))
        return g


class Learner:
    """Adam for the network's matrices, AdaGrad for the rows of vectors that a step touches."""

    def __init__(self, net: Network, rate: float = 0.01, vector_rate: float = 0.03):
        self.net, self.rate, self.vector_rate, self.steps = net, rate, vector_rate, 0
        self.first = {k: np.zeros_like(v) for k, v in net.p.items()}
        self.second = {k: np.zeros_like(v) for k, v in net.p.items()}

    def step(self, gradients: dict) -> None:
        self.steps += 1
        for k, g in gradients.items():
            if isinstance(g, tuple):
                rows, g = g
                self.second[k][rows] += g * g
                self.net.p[k][rows] -= self.vector_rate * g / (np.sqrt(self.second[k][rows]) + 1e-8)
                continue
            self.first[k] = 0.9 * self.first[k] + 0.1 * g
            self.second[k] = 0.99 * self.second[k] + 0.01 * g * g
            scaled = self.first[k] / (1 - 0.9**self.steps) / (np.sqrt(self.second[k] / (1 - 0.99**self.steps)) + 1e-6)
            self.net.p[k] -= (self.rate * scaled).astype(np.float32)


def fit(texts: Iterable[tuple[list[list[str]], int]], seed: int = SEED, turns: int = 4, least_steps: int = 80) -> Network | None:
    """A network from texts, each a list of windows of words and a label; None without both labels. Words become numbers as they come."""
    place: dict[str, int] = {}
    rows, many, labels = [], [], []
    for windows, toxic in texts:
        mine = np.zeros((len(windows), WINDOW), np.int32)
        for row, window in zip(mine, windows, strict=True):
            row[: len(window)] = [place.setdefault(w, len(place) + 1) for w in window]
        rows.append(mine)
        many.append(len(windows))
        labels.append(toxic)
    if len(set(labels)) < 2:
        return None
    ids, of, label = np.concatenate(rows), np.repeat(np.arange(len(many)), many), np.array(labels, np.float32)
    del rows
    every = list(place)
    pairs = np.unique(of[:, None] * (len(every) + 1) + ids)  # which texts have a word
    word = pairs % (len(every) + 1)
    seen = np.bincount(word, minlength=len(every) + 1)[1:].astype(float)
    bad = np.bincount(word, label[pairs // (len(every) + 1)], len(every) + 1)[1:]
    del pairs, word, place
    common = np.flatnonzero(seen > 2)
    common = common[np.argsort(-seen[common], kind="stable")][: WORDS - 1]
    net = Network.fresh({every[k]: n for n, k in enumerate(common, 1)}, seed)
    own = np.zeros(len(every), np.int64)
    own[common] = np.arange(1, len(common) + 1)
    buckets, first, n = grams_of(every)
    size = np.diff(np.r_[first, buckets.shape[1]])

    # what is oftener in toxic texts than chance has it starts ahead: each vector's first value is its deviation
    share = np.mean(labels)
    known = own > 0
    net.p["own"][own[known], 0] = _deviation(bad[known], seen[known] * share)
    at, gram_seen, gram_bad = buckets.ravel(), *(sum(np.bincount(of, np.repeat(v, size), GRAMS) for of in buckets) for v in (seen, bad))
    net.p["gram"][:, 0] = np.where(np.bincount(at, minlength=GRAMS) > 0, _deviation(gram_bad, gram_seen * share), 0)
    net.p["gram"][0] = 0

    def spelling(some: np.ndarray) -> tuple[np.ndarray, ...]:
        """What `joined` needs for some words."""
        ends = np.cumsum(size[some])
        begin = ends - size[some]
        return own[some], buckets[:, np.repeat(first[some] - begin, size[some]) + np.arange(ends[-1])], begin, n[some]

    rng = np.random.default_rng(seed)
    kept = rng.permutation(len(many)) % 10 == 0  # texts for the threshold
    learner = Learner(net)

    def passes(chosen: np.ndarray, times: int, vectors: bool, together: int = 256) -> None:
        share = label[of[chosen]].mean()
        weight = np.where(label[of[chosen]] > 0, 0.5 / max(share, 1e-3), 0.5 / max(1 - share, 1e-3)).astype(np.float32)
        for _ in range(times):
            order = rng.permutation(len(chosen))
            for a in range(0, len(order), together):
                part = chosen[order[a : a + together]]
                rows, local = np.unique(ids[part].T, return_inverse=True)
                local = local.reshape(WINDOW, len(part))
                context = spelling(rows[rows > 0] - 1)
                g = net.gradients(local if rows[0] == 0 else local + 1, label[of[part]], weight[order[a : a + together]], net.joined(*context), context)
                learner.step({k: v for k, v in g.items() if vectors or k not in ("own", "gram")})

    def all_logits() -> np.ndarray:
        tables = net.tables(np.concatenate([net.joined(*spelling(np.arange(a, min(a + 50_000, len(every))))) for a in range(0, len(every), 50_000)]))
        return np.concatenate([net.logits(np.ascontiguousarray(ids[a : a + TOGETHER].T), tables) for a in range(0, len(ids), TOGETHER)])

    def worst(score: np.ndarray, n: int) -> np.ndarray:
        order = np.lexsort((-score, of))
        begin = np.searchsorted(of[order], of[order])
        return order[np.arange(len(order)) - begin < n]

    learns = ~kept[of]
    some = worst(rng.random(len(ids)), 8)
    some = some[learns[some]]
    # the vectors stay as they are at first, else few texts would be learned by heart
    passes(some, max(2, -(-least_steps * 256 // max(len(some), 1))), False)
    for turn in range(turns):
        found = worst(all_logits(), 2 if turn < turns // 2 else 1)
        clean = worst(np.where(learns, rng.random(len(ids)), -1), 1)
        clean = clean[label[of[clean]] == 0]
        chosen = np.concatenate([found, clean])
        chosen = chosen[learns[chosen]]
        passes(chosen, max(1, -(-least_steps * 64 // max(len(chosen), 1))), turn > 0)
    top = np.maximum.reduceat(all_logits(), np.flatnonzero(np.r_[True, np.diff(of) > 0]))
    seen = np.unique(of)
    use = kept[seen] if len(set(label[seen][kept[seen]].tolist())) == 2 else np.ones(len(seen), bool)
    net.p["out_by"] -= np.float32(threshold(top[use], label[seen][use]))
    return net


def _deviation(found: np.ndarray, expected: np.ndarray) -> np.ndarray:
    return np.clip((found - expected) / np.sqrt(expected + 1) / 3, -3, 3)


def threshold(logit: np.ndarray, label: np.ndarray) -> float:
    """Where fewest are on the wrong side: the middle of the widest of the best gaps; 0 if nothing is better than it."""
    order = np.argsort(logit, kind="stable")
    x, y = logit[order], label[order]
    wrong = np.r_[0, np.cumsum(y)] + np.r_[np.cumsum((1 - y)[::-1])[::-1], 0]
    edges = np.r_[x[0] - 2, x, x[-1] + 2]
    best = np.flatnonzero(wrong == wrong.min())
    gaps = edges[best + 1] - edges[best]
    k = best[np.argmax(gaps)]
    return float((edges[k] + edges[k + 1]) / 2)


def _chosen(n: int, most: int) -> list[int]:
    """Starts of at most `most` windows of n words, by hash."""
    starts = window_starts(n)
    return list(starts) if len(starts) <= most else sorted(sorted(starts, key=lambda s: xxhash.xxh64_intdigest(str(s)))[:most])


def learn(docs: DataFrame, labels: DataFrame, samples: int = SAMPLES, windows: int = WINDOWS) -> Network | None:
    """From the rows of `docs` (`doc_id, text`) that have a label in `labels` (`doc_id, toxic`) and are not held out."""
    of = (
        labels.filter(F.col("doc_id").isNotNull() & F.col("toxic").isNotNull() & (F.crc32(F.col("doc_id").cast("string")) % 5 != 0))
        .groupBy("doc_id").agg((F.max("toxic") > 0).cast("int").alias("toxic")).withColumn("mix", F.xxhash64("doc_id")).withColumn("bucket", F.pmod("mix", F.lit(samples)))
    )
    picked = of.groupBy("toxic", "bucket").agg(F.min_by("doc_id", "mix").alias("doc_id")).select("doc_id", "toxic")  # at most `samples` of each label
    rows = docs.filter(F.col("text").isNotNull()).select("doc_id", "text").join(F.broadcast(picked), "doc_id")

    def cut(batches: Iterator[list]) -> Iterator[dict[str, list]]:
        for doc_ids, toxic, texts in batches:
            found = [words_of(t) for t in texts]
            yield {"doc_id": doc_ids, "toxic": toxic, "windows": ["\n".join(" ".join(w[s : s + WINDOW]) for s in _chosen(len(w), windows)) for w in found]}

    once = map_arrow(rows, ["doc_id", "toxic", "text"], cut, "doc_id long, toxic int, windows string")
    got = sorted(once.groupBy("doc_id").agg(F.max("toxic").alias("toxic"), F.min("windows").alias("windows")).filter("windows <> ''").collect())
    return fit(([w.split(" ") for w in r["windows"].split("\n")], r["toxic"]) for r in got)


def scores(net: Network | None, texts: list[str | None]) -> np.ndarray:
    """Of each text the score of its worst window."""
    out = np.zeros(len(texts))
    codes, n, distinct = words_in(texts)
    if net is None or not len(codes):
        return out
    codes = np.r_[codes + 1, 0].astype(np.int32)
    tables = net.tables(net.vectors(distinct))
    per = np.where(n > 0, np.maximum(-(-(n - WINDOW) // STRIDE), 0) + 1, 0)
    of = np.repeat(np.arange(len(texts)), per)
    ends = np.cumsum(n)
    start = (ends - n)[of] + STRIDE * (np.arange(len(of)) - np.repeat(np.cumsum(per) - per, per))
    best = np.full(len(texts), -np.inf)
    for a in range(0, len(of), TOGETHER):
        part = slice(a, a + TOGETHER)
        at = start[part] + np.arange(WINDOW)[:, None]
        at = np.where(at < ends[of[part]], at, len(codes) - 1)
        np.maximum.at(best, of[part], net.logits(codes[at], tables))
    has = n > 0
    out[has] = np.round(1 / (1 + np.exp(-best[has])), 6)
    return out


def score_documents(docs: DataFrame, labels: DataFrame, samples: int = SAMPLES) -> DataFrame:
    """`doc_id, held_out, score, predicted` of each row of `docs` (see the module's docstring)."""
    batch_rows(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(learn(docs, labels, samples))

    def work(batches: Iterator[list]) -> Iterator[dict[str, list]]:
        for doc_ids, texts in batches:
            found = scores(shared.value, texts)
            yield {"doc_id": doc_ids, "score": found.tolist(), "predicted": (found >= 0.5).astype(int).tolist()}

    held = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 5 == 0, F.lit(False))
    return map_arrow(docs, ["doc_id", "text"], work, "doc_id long, score double, predicted int").select("doc_id", held.alias("held_out"), "score", "predicted")
