"""How far the sources of a language are apart in the words they use.

Texts are counted where they lie: a task keeps one counter of terms for each (lang, source) and one of documents for
each lang, and hands on rows of 64-bit digests. Strings go along once, a row for each term of a language and task, to
find how many documents have a digest and its smallest and largest string. Where these two differ, several terms share
the digest, and the terms of that digest alone are counted again by their strings. What is shuffled by source, joined,
and compared holds digests only; strings come back by a join for the ranks that are returned.

Differences between sources are sums over terms. A task gets a block of a language's terms and two tiles of its sources,
so that a language with many sources or terms is many tasks. A term that no source of a tile has adds the same
difference as any other such term, so only terms that occur are sent.

Defined cases: null text, lang and source count as ''; repeated rows are documents of their own; other columns, `doc_id`
included, are not read; a language without kept terms has differences of 0 between its sources and no ranks of terms; a
language of one source has no pairs; an empty table gives no rows.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.common import batch_rows, map_arrow, materialise, or_empty

DOCUMENTS, PRIOR, SCALE, RANKS = 30, 5, 1_000_000_000, 50
#: Entries that a task's counters hold before they are handed on.
HELD = 400_000
#: Sources in a tile and cells (sources times terms) of a block: what one comparison holds.
TILE, CELLS = 256, 1 << 15
#: Count rows of a term are dealt over so many join keys, by their source: a common word has a row for each source and task.
DEALT = 8

#: Letters A-Z become small, every other ASCII byte that is no letter a space; bytes of other characters stay.
_TERM_BYTES = bytes(b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


def terms(text: str) -> list[bytes]:
    """The terms of a text, in order, as UTF-8."""
    return text.encode("utf-8", "surrogatepass").translate(_TERM_BYTES).split()


def _count(docs: DataFrame, bits: int, held: int, by_string: bool = False) -> DataFrame:
    """Per task: rows of documents (`n` in a group), of terms in a lang (`term`, `docs`), and of digests in a group (`n`).

    With `by_string` the last have `term` and `docs` too, and there are no others.
    """
    mask = (1 << bits) - 1

    def digests(found: list[bytes]) -> list[int]:
        return [xxhash.xxh64_intdigest(t) & mask for t in found]

    def rows(lang: str, source: str | None, ids: list[int], n, docs, strings) -> dict[str, list]:
        size = len(ids)
        signed = np.array(ids, np.uint64).view(np.int64)
        return {"lang": [lang] * size, "source": [source] * size, "digest": signed, "n": n or [None] * size, "docs": docs or [None] * size, "term": [t.decode("utf-8", "replace") for t in strings] if strings else [None] * size}

    def work(batches: Iterator[list]) -> Iterator[dict[str, list]]:
        counted: dict[tuple[str, str], Counter] = {}
        present: dict[object, Counter] = {}
        groups: Counter = Counter()
        size = 0

        def hand_on():
            if by_string:
                for (lang, source), c in counted.items():
                    found = list(c)
                    yield rows(lang, source, digests(found), list(c.values()), [present[lang, source][t] for t in found], found)
            else:
                for lang, c in present.items():
                    found = list(c)
                    ids = digests(found)
                    yield rows(lang, None, ids, None, list(c.values()), found)
                    known = dict(zip(found, ids, strict=True))
                    for (other, source), of in counted.items():
                        if other == lang:
                            yield rows(lang, source, [known[t] for t in of], list(of.values()), None, None)
            counted.clear()
            present.clear()

        for langs, sources, texts in batches:
            for lang, source, text in zip(langs, sources, texts, strict=True):
                groups[lang, source] += 1
                found = terms(text)
                c = counted.setdefault((lang, source), Counter())
                size -= len(c)
                c.update(found)
                size += len(c)
                present.setdefault((lang, source) if by_string else lang, Counter()).update(set(found))
                if size >= held:
                    yield from hand_on()
                    size = 0
        yield from hand_on()
        if groups and not by_string:
            lists = list(zip(*groups, strict=True))
            empty = [None] * len(groups)
            yield {"lang": list(lists[0]), "source": list(lists[1]), "digest": empty, "n": list(groups.values()), "docs": empty, "term": empty}

    named = docs.select(or_empty("lang").alias("lang"), or_empty("source").alias("source"), or_empty("text").alias("text"))
    return map_arrow(named, ["lang", "source", "text"], work, "lang string, source string, digest long, n long, docs long, term string")


def _kept(docs: DataFrame, at_least: int, bits: int, held: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Groups `lang, source`; kept terms `lang, digest, part, term`; counts `lang, source, digest, part, n` of them.

    `part` is empty for a digest of one term, else the term itself.
    """
    raw = materialise(_count(docs, bits, held))
    groups = materialise(raw.filter("digest IS NULL").select("lang", "source").distinct())
    found = materialise(
        raw.filter("term IS NOT NULL").groupBy("lang", "digest").agg(F.sum("docs").alias("docs"), F.min("term").alias("low"), F.max("term").alias("high"))
        .filter(F.col("docs") >= at_least)
    )
    whole = found.filter("low = high").select("lang", "digest", F.lit("").alias("part"), F.col("low").alias("term"))
    salt = F.pmod(F.xxhash64("source"), F.lit(DEALT)).cast("int").alias("salt")
    keys = whole.select("lang", "digest", F.explode(F.sequence(F.lit(0), F.lit(DEALT - 1))).alias("salt"))
    counts = (
        raw.filter("term IS NULL AND digest IS NOT NULL").select("lang", "source", "digest", "n", salt).join(keys.hint("shuffle_hash"), ["lang", "digest", "salt"])
        .groupBy("lang", "digest", "salt", "source").agg(F.sum("n").alias("n")).select("lang", "source", "digest", F.lit("").alias("part"), "n")
    )
    shared = found.filter("low <> high").select("lang", "digest")
    if not shared.isEmpty():
        again = materialise(
            _count(docs, bits, held, by_string=True).join(shared, ["lang", "digest"], "left_semi")
            .groupBy("lang", "source", "digest", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))
        )
        split = again.groupBy("lang", "digest", "term").agg(F.sum("docs").alias("docs")).filter(F.col("docs") >= at_least)
        split = materialise(split.select("lang", "digest", F.col("term").alias("part"), "term"))
        whole = whole.unionByName(split)
        counts = counts.unionByName(again.join(split.select("lang", "digest", "term"), ["lang", "digest", "term"]).select("lang", "source", "digest", F.col("term").alias("part"), "n"))
    return groups, whole, materialise(counts)


def _share(count: str, total: str) -> Column:
    """1 + floor(SCALE * (count + PRIOR) / total), exact."""
    return F.expr(f"1L + (CAST({count} + {PRIOR} AS DECIMAL(20,0)) * {SCALE}) DIV CAST({total} AS DECIMAL(20,0))")


def _shares(n: np.ndarray, total: np.ndarray) -> np.ndarray:
    """The same for rows of counts, a total each; counts too large for 64 bits as Python's integers."""
    if n.size and int(n.max()) + PRIOR > (1 << 63) // SCALE:
        n, total = n.astype(object), total.astype(object)
    return (1 + (n + PRIOR) * SCALE // total[:, None]).astype(np.int64)


def _compare(key: tuple, counts: pd.DataFrame, groups: pd.DataFrame) -> pd.DataFrame:
    """Differences between the sources of two tiles over a block's terms; block 0 adds what terms without counts amount to."""
    lang, left, right, block = key
    groups = groups.sort_values("source", ignore_index=True)
    total, kept = groups["total"].to_numpy(np.int64), int(groups["kept"].iloc[0])
    row = pd.Index(groups["source"]).get_indexer(counts["source"])
    columns = counts.groupby(["digest", "part"], sort=False).ngroup().to_numpy()
    n = np.zeros((len(groups), int(columns.max()) + 1 if len(columns) else 0), np.int64)
    n[row, columns] = counts["n"]
    share, none = (_shares(n, total), _shares(np.zeros((len(groups), 1), np.int64), total)[:, 0]) if kept else (n, np.zeros(len(groups), np.int64))
    rest = (kept if block == 0 else 0) - n.shape[1]
    a, b = (np.flatnonzero(groups["tile"] == t) for t in (left, right))
    out = []
    for i in a:
        j = b[b > i] if left == right else b
        value = np.abs(share[j] - share[i]).sum(axis=1) + rest * np.abs(none[j] - none[i])
        out.append(pd.DataFrame({"i": i, "j": j, "value": value}))
    pairs = pd.concat(out) if out else pd.DataFrame({"i": [], "j": [], "value": []}).astype("int64")
    names = groups["source"].to_numpy()
    return pd.DataFrame({"lang": lang, "source": names[pairs["i"]], "item": names[pairs["j"]], "value": pairs["value"].to_numpy(np.int64)})


def _between_sources(counts: DataFrame, sizes: DataFrame, tile: int, cells: int) -> DataFrame:
    """`lang, source, item, value` for each two sources of a language, in both orders. `sizes` is `lang, source, total, kept, sources`."""
    tiles = F.ceil(F.col("sources") / tile)
    blocks = F.greatest(F.lit(1), F.ceil(F.col("kept") * F.least(F.col("sources"), F.lit(2 * tile)) / cells))
    dealt = sizes.select("lang", "source", "total", "kept", F.pmod(F.xxhash64("source"), tiles).cast("int").alias("tile"), tiles.cast("int").alias("tiles"), blocks.cast("long").alias("blocks"))
    other = F.explode(F.sequence(F.lit(0), F.col("tiles") - 1)).alias("other")
    key = [F.least("tile", "other").alias("left"), F.greatest("tile", "other").alias("right")]
    sources = dealt.withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).select("*", other).select("lang", *key, "block", "source", "total", "kept", "tile")
    rows = counts.join(dealt, ["lang", "source"]).withColumn("block", F.pmod("digest", "blocks")).select("*", other).select("lang", *key, "block", "source", "digest", "part", "n")
    by = ["lang", "left", "right", "block"]
    some = rows.groupBy(*by).cogroup(sources.groupBy(*by)).applyInPandas(_compare, "lang string, source string, item string, value long")
    once = some.groupBy("lang", "source", "item").agg(F.sum("value").alias("value"))
    both = F.explode(F.array(F.struct("source", "item"), F.struct(F.col("item").alias("source"), F.col("source").alias("item")))).alias("p")
    return once.select("lang", both, "value").select("lang", "p.source", "p.item", "value")


def audit(docs: DataFrame, at_least: int = DOCUMENTS, ranks: int = RANKS, bits: int = 64, held: int = HELD, tile: int = TILE, cells: int = CELLS) -> DataFrame:
    """`lang, source, part, item, value, rank` of `docs` (`text, lang, source`): other sources by their difference (`pair`),
    and the terms that a source has more of than its language, the first `ranks` (`term`).

    Terms in fewer than `at_least` documents of a language are not kept. `bits` is the digests' width; results do not
    depend on it, nor on `held`, `tile` and `cells`.
    """
    batch_rows(docs.sparkSession)
    groups, kept, counts = _kept(docs, at_least, bits, held)
    in_source = counts.groupBy("lang", "source").agg(F.sum("n").alias("total"))
    of_lang = groups.groupBy("lang").agg(F.count("*").alias("sources")).join(kept.groupBy("lang").agg(F.count("*").alias("kept")), "lang", "left")
    sizes = materialise(
        groups.join(in_source, ["lang", "source"], "left").join(of_lang, "lang")
        .select("lang", "source", "sources", F.coalesce("kept", F.lit(0)).alias("kept"), (F.coalesce("total", F.lit(0)) + PRIOR * F.coalesce("kept", F.lit(0))).alias("total"))
    )
    in_lang = sizes.groupBy("lang").agg((F.sum(F.col("total") - PRIOR * F.col("kept")) + PRIOR * F.first("kept")).alias("lang_total"))
    pairs = _between_sources(counts, sizes, tile, cells)

    of_term = counts.groupBy("lang", "digest", "part").agg(F.sum("n").alias("lang_n")).join(in_lang, "lang")
    key = ["lang", "digest", "part"]
    valued = counts.join(of_term.select(*key, _share("lang_n", "lang_total").alias("q")), key).join(sizes.select("lang", "source", "total"), ["lang", "source"])
    valued = valued.select(*key, "source", (_share("n", "total") - F.col("q")).alias("value")).filter("value > 0")
    best = valued.withColumn("place", F.rank().over(Window.partitionBy("lang", "source").orderBy(F.desc("value")))).filter(F.col("place") <= ranks)
    said = best.join(kept, key).select("lang", "source", F.col("term").alias("item"), "value")  # the strings of kept ranks, ties at the end included

    place = F.row_number().over(Window.partitionBy("lang", "source").orderBy(F.desc("value"), F.asc("item"))).alias("rank")
    pair = pairs.select("lang", "source", F.lit("pair").alias("part"), "item", "value", place)
    term = said.select("lang", "source", F.lit("term").alias("part"), "item", "value", place).filter(F.col("rank") <= ranks)
    return pair.unionByName(term)
