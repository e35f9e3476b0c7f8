"""Language identification by prediction by partial matching.

For each language a tree of byte contexts up to `ORDER` bytes holds how often each byte followed. A byte is coded in
its longest known context; where the context never saw it, an escape (method C: as likely as the context has
different followers) is paid and the next shorter context asked, down to eight bits for a byte never seen. The
statistics are frozen after learning, so the code length of a text is a sum over its 4-grams, and the language with
the shortest code is predicted. Bytes are those of the lower-cased text, with ASCII that is no letter as spaces.

Learning reads at most `samples` rows of each language, a bound that does not depend on the table, and their whole
texts; their 4-grams are counted where the rows are, and only the counts come to the driver. Prediction reads whole
texts. A letter is what Unicode calls one (categories L).

Defined cases: a null text, and one without a letter, is `und` with score 0; if no language could be learned, all
texts are; a null doc_id is neither held out nor learned from; languages with equal code lengths: the first by name.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import map_arrow

ORDER = 3
SAMPLES = 256
UNDETERMINED = "und"
BLOCK = 1 << 20

_LETTER = regex.compile(r"\p{L}")
_BLANK = bytes(b if b >= 128 or chr(b).isalpha() else 32 for b in range(256))


def grams(text: str) -> np.ndarray:
    """For each byte of the prepared text: it and the ORDER bytes before it as one number; the text starts after spaces."""
    data = np.frombuffer(b" " * ORDER + text.lower().encode("utf-8", "surrogatepass").translate(_BLANK), np.uint8).astype(np.uint32)
    out = data[ORDER:].copy()
    for k in range(1, ORDER + 1):
        out |= data[ORDER - k : len(data) - k] << np.uint32(8 * k)
    return out


class ContextTrees:
    """Frozen code lengths: for each order the known grams, and the bits each costs in each language."""

    def __init__(self, counts: dict[str, tuple[np.ndarray, np.ndarray]]):
        self.languages = sorted(counts)
        if not counts:
            return  # nothing was learned: every prediction is undetermined
        counted = [counts[x] for x in self.languages]
        width = len(self.languages)
        self.known: list[np.ndarray] = []  # by order: grams of so many bytes before the last
        self.bits: list[np.ndarray] = []
        self.contexts: list[np.ndarray] = []
        self.escapes: list[np.ndarray] = []
        lower = np.full((0, width), 8.0)
        for order in range(ORDER + 1):
            mask = np.uint32((1 << 8 * (order + 1)) - 1)
            per = [_sums(g & mask, n) for g, n in counted]
            known = np.unique(np.concatenate([g for g, _ in per]))
            contexts = np.unique(known >> np.uint32(8))
            escapes = np.zeros((len(contexts), width))
            bits = np.full((len(known), width), 8.0) if not order else lower[np.searchsorted(self.known[-1], known & (mask >> np.uint32(8)))]
            of = np.searchsorted(contexts, known >> np.uint32(8))
            for k, (g, n) in enumerate(per):
                at = np.searchsorted(known, g)
                total = np.bincount(of[at], n, len(contexts))
                different = np.bincount(of[at], minlength=len(contexts))
                seen = total > 0
                escapes[seen, k] = np.log2((total + different)[seen] / different[seen])
                bits[:, k] += escapes[of, k]
                bits[at, k] = np.log2((total + different)[of[at]] / n)
            self.known.append(known)
            self.bits.append(bits)
            self.contexts.append(contexts)
            self.escapes.append(escapes)
            lower = bits

    def code_lengths(self, text: str) -> np.ndarray:
        """The bits that the whole text costs in each language."""
        total = np.zeros(len(self.languages))
        every = grams(text)
        for a in range(0, len(every), BLOCK):
            found, n = np.unique(every[a : a + BLOCK], return_counts=True)
            for order in range(ORDER, -1, -1):
                known, contexts = self.known[order], self.contexts[order]
                at = np.minimum(np.searchsorted(known, found), len(known) - 1)
                hit = known[at] == found
                total += n[hit] @ self.bits[order][at[hit]]
                found, n = found[~hit], n[~hit]
                if not len(found):
                    break
                context = found >> np.uint32(8)
                at = np.minimum(np.searchsorted(contexts, context), len(contexts) - 1)
                seen = contexts[at] == context
                total += n[seen] @ self.escapes[order][at[seen]]
                found = found & np.uint32((1 << 8 * order) - 1) if order else found
                if order:
                    found, inverse = np.unique(found, return_inverse=True)
                    n = np.bincount(inverse, n, len(found))
            else:
                total += 8.0 * n.sum()
        return total

    def predict(self, text: str | None) -> tuple[str, float]:
        """The language of the shortest code, and its share of the languages' likelihoods."""
        if not text or not self.languages or not _LETTER.search(text):
            return UNDETERMINED, 0.0
        bits = self.code_lengths(text)
        best = int(np.argmin(bits))
        return self.languages[best], float(1 / np.exp2(np.maximum(bits[best] - bits, -1000)).sum())


def _sums(values: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    distinct, inverse = np.unique(values, return_inverse=True)
    return distinct, np.bincount(inverse, counts, len(distinct))


def learn(docs: DataFrame, samples: int = SAMPLES) -> ContextTrees:
    """Trees from a bounded sample of `docs` (`doc_id, text, lang`), whose rows with doc_ids to hold out are not read."""
    fold = F.crc32(F.col("doc_id").cast("string")) % 4
    rows = docs.filter(F.col("lang").isNotNull() & F.col("doc_id").isNotNull() & (fold != 2) & F.col("text").isNotNull())
    mix = F.xxhash64("doc_id")
    named = rows.select("lang", F.pmod(mix, F.lit(samples)).alias("bucket"), mix.alias("mix"))
    chosen = named.groupBy("lang", "bucket").agg(F.min("mix").alias("mix"))
    # at most `samples` rows a language; repeated rows of a chosen doc_id give one
    picked = (
        rows.withColumn("bucket", F.pmod(mix, F.lit(samples))).withColumn("mix", mix).join(F.broadcast(chosen), ["lang", "bucket", "mix"])
        .groupBy("lang", "bucket").agg(F.min("text").alias("text"))
    )

    def count(batches: Iterator[list]) -> Iterator[dict[str, list]]:
        for languages, texts in batches:
            for lang, text in zip(languages, texts, strict=True):
                found, n = np.unique(grams(text), return_counts=True)
                yield {"lang": [lang] * len(found), "gram": found.astype(np.int64).tolist(), "n": n.tolist()}

    summed = map_arrow(picked, ["lang", "text"], count, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    table = summed.toPandas().sort_values("gram")
    return ContextTrees({lang: (of["gram"].to_numpy(np.uint32), of["n"].to_numpy(np.int64)) for lang, of in table.groupby("lang")})


def identify(docs: DataFrame, columns: list[str], trees: ContextTrees) -> DataFrame:
    """`columns` of `docs` (long or string) with `lang_pred` and `score` of its column `text`."""
    shared = docs.sparkSession.sparkContext.broadcast(trees)
    types = dict(docs.dtypes)

    def work(batches: Iterator[list]) -> Iterator[dict[str, list]]:
        model = shared.value
        for *kept, texts in batches:
            found = [model.predict(t) for t in texts]
            yield dict(zip(columns, kept, strict=True)) | {"lang_pred": [f[0] for f in found], "score": [f[1] for f in found]}

    schema = ", ".join(f"{c} {'long' if types[c] == 'bigint' else types[c]}" for c in columns)
    return map_arrow(docs, [*columns, "text"], work, f"{schema}, lang_pred string, score double")


def predict_languages(docs: DataFrame) -> DataFrame:
    """One row per row of `docs`: `doc_id, held_out, lang_pred, score` (see the module's docstring)."""
    named = identify(docs, ["doc_id"], learn(docs))
    held = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 4 == 2, F.lit(False))
    return named.select("doc_id", held.alias("held_out"), "lang_pred", "score")


def keep_identified(docs: DataFrame, wanted: list[str] | None = None, least: float = 0.5) -> DataFrame:
    """The rows of `docs` whose text is in a wanted language with a score of at least `least`; `lang` becomes the predicted one.

    `wanted` None: every language that was learned. A row whose text has no letter, or no language that could be learned, goes.
    """
    trees = docs.sparkSession.sparkContext.broadcast(learn(docs))

    @F.pandas_udf("string")
    def language(texts):
        found = (trees.value.predict(t) for t in texts)
        return pd.Series([name if score >= least and name != UNDETERMINED and (wanted is None or name in wanted) else None for name, score in found], dtype=object)

    named = docs.select(F.struct(*docs.columns).alias("row"), language("text").alias("named")).filter("named IS NOT NULL")
    return named.select(*[F.col("named").alias(c) if c == "lang" else F.col("row")[c].alias(c) for c in docs.columns])
