"""Document fingerprints from prefix polynomial hashes.

`PrefixHash` holds, for one text, the hash of every prefix under two prime moduli. Any span's hash follows from
two prefixes, so spans are compared in constant time, and the longest common extension of two positions is found
by binary search. A document's fingerprint is a one-permutation MinHash of the hashes of all spans of `WIDTH`
code points that end at some position of the text (the first ones reach into a constant margin before it), so
that a text whose tail was replaced keeps the rows that its head decided. An edited text's prefixes are its original's
as far as they agree, and so are the minima of its spans there.

Defined cases: a null text counts as empty; the empty text's fingerprint is all zeros and is like itself only;
equal texts have equal fingerprints; repeated rows are fingerprinted each, and count as next documents too; rows of
one doc_id are ordered by a hash of the text; a null doc_id comes before all others; an empty table gives no rows;
columns other than `doc_id` and `text` are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import map_arrow, materialise

#: Two primes below 2**31 and a base for each: products of residues stay below 2**62.
MODULI = (2_147_483_647, 2_147_483_629)
BASES = (911_382_323, 972_663_749)
WIDTH = 12
ROWS = 128
BLOCK = 1 << 16


def code_points(text: str) -> np.ndarray:
    """The text's code points plus one, so that no symbol is zero."""
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4").astype(np.int64) + 1


def _powers(base: int, modulus: int, n: int) -> np.ndarray:
    out = np.ones(n, np.int64)
    done = 1
    while done < n:
        out[done : 2 * done] = out[: min(done, n - done)] * pow(base, done, modulus) % modulus
        done *= 2
    return out


_UP = [_powers(b, m, BLOCK + WIDTH) for b, m in zip(BASES, MODULI, strict=True)]
_DOWN = [_powers(pow(b, -1, m), m, BLOCK + WIDTH) for b, m in zip(BASES, MODULI, strict=True)]


class PrefixHash:
    """prefix[k][i]: sum of symbol j times base_k**j over j < i, modulo the k-th prime. Eight bytes a code point."""

    def __init__(self, codes: np.ndarray, head: PrefixHash | None = None, kept: int = 0):
        """Of the symbols `codes`, after the first `kept` ones of `head` if there is one."""
        self.n = kept + len(codes)
        self.prefix = []
        for k, m in enumerate(MODULI):
            out = np.zeros(self.n + 1, np.uint32)
            if head:
                out[: kept + 1] = head.prefix[k][: kept + 1]
            for a in range(0, len(codes), BLOCK):
                part, at = codes[a : a + BLOCK], kept + a
                local = np.cumsum(part * _UP[k][: len(part)] % m) % m
                out[at + 1 : at + 1 + len(part)] = (int(out[at]) + local * pow(BASES[k], at, m) % m) % m
            self.prefix.append(out)

    def span(self, start: int, end: int) -> tuple[int, ...]:
        """The hash of the text from `start` to `end`, the same wherever that text stands."""
        return tuple(
            (int(p[end]) - int(p[start])) * pow(BASES[k], -start, MODULI[k]) % MODULI[k] for k, p in enumerate(self.prefix)
        )

    def spans(self, start: int, end: int) -> Iterator[np.ndarray]:
        """The hashes of all spans of WIDTH symbols that begin from `start` to before `end`, both moduli in one number, in blocks."""
        for a in range(start, end, BLOCK):
            n = min(BLOCK, end - a)
            sides = []
            for k, (p, m) in enumerate(zip(self.prefix, MODULI, strict=True)):
                side = (p[a + WIDTH : a + WIDTH + n].astype(np.int64) - p[a : a + n]) % m * _DOWN[k][:n] % m
                sides.append((side * pow(BASES[k], -a, m) % m if a else side).astype(np.uint64))
            yield (sides[0] << np.uint64(32)) ^ sides[1]

    def extension(self, i: int, other: PrefixHash, j: int) -> int:
        """How many code points from `i` here equal those from `j` there: binary search over span equality."""
        low, high = 0, min(self.n - i, other.n - j)
        while low < high:
            mid = (low + high + 1) // 2
            if self.span(i, i + mid) == other.span(j, j + mid):
                low = mid
            else:
                high = mid - 1
        return low


#: Stands before a text, so that a span ends at each of its code points.
MARGIN = np.ones(WIDTH - 1, np.int64)


def span_minima(whole: PrefixHash, start: int, end: int) -> np.ndarray:
    """For each sketch row the least 57-bit value of the mixed hashes of the spans that end at code points from `start` to
    before `end` of a text with its margin; rows without a span hold the maximum."""
    least = np.full(ROWS, np.iinfo(np.uint64).max, np.uint64)
    for hashes in whole.spans(start, end):
        mixed = _mix(hashes)
        np.minimum.at(least, (mixed & np.uint64(ROWS - 1)).astype(np.int64), mixed >> np.uint64(7))
    return least


def _mix(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit numbers (xor-shifts and odd multipliers)."""
    for shift, factor in ((33, 0xFF51AFD7ED558CCD), (33, 0xC4CEB9FE1A85EC53)):
        x = (x ^ (x >> np.uint64(shift))) * np.uint64(factor)
    return x ^ (x >> np.uint64(33))


def sketch(least: np.ndarray) -> np.ndarray:
    """16 bits for each row of minima: zero for a row without a span."""
    filled = least != np.iinfo(np.uint64).max
    return np.where(filled, _mix(least) % np.uint64(0xFFFF) + np.uint64(1), np.uint64(0)).astype(">u2")


class Fingerprinted:
    """A text with its prefix hashes and its fingerprint; the minima of the part that an edit keeps stand by themselves."""

    def __init__(self, text: str):
        self.text, self.kept = text, len(text) - len(text) // 4
        self.hashes = PrefixHash(np.concatenate([MARGIN, code_points(text)]))
        self.head = span_minima(self.hashes, 0, self.kept)
        self.sketch = sketch(np.minimum(self.head, span_minima(self.hashes, self.kept, len(text))))

    def edited(self, changed: str) -> tuple[np.ndarray, int]:
        """The fingerprint of a text that begins as this one does up to `kept`, and the length of their common prefix."""
        other = PrefixHash(code_points(changed[self.kept :]), self.hashes, len(MARGIN) + self.kept)
        return sketch(np.minimum(self.head, span_minima(other, self.kept, len(changed)))), self.hashes.extension(0, other, 0) - len(MARGIN)


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    """Rows that agree among those that hold a span of either text; 1 for two empty texts."""
    held = (a != 0) | (b != 0)
    return float(((a == b) & held).sum() / held.sum()) if held.any() else 1.0


def edited(text: str, following: str) -> str:
    """`text` with its last quarter replaced by as many first code points of `following` (or all of it)."""
    quarter = len(text) // 4
    return text[: len(text) - quarter] + following[:quarter]


def _row(doc_id: int | None, own: Fingerprinted, following: Fingerprinted) -> dict:
    changed = edited(own.text, following.text)
    other, common = own.edited(changed)
    return {
        "doc_id": doc_id,
        "n_chars": len(own.text),
        "edited_sha256": hashlib.sha256(changed.encode("utf-8", "surrogatepass")).digest(),
        "fingerprint": own.sketch.tobytes(),
        "edited_fingerprint": other.tobytes(),
        "near_edited": likeness(own.sketch, other),
        "near_next": likeness(own.sketch, following.sketch),
        "common_prefix": common,
    }


_COLUMNS = {
    "doc_id": "long", "n_chars": "long", "edited_sha256": "binary", "fingerprint": "binary",
    "edited_fingerprint": "binary", "near_edited": "double", "near_next": "double", "common_prefix": "long",
}
_EDGE = {"part": "long", "first_id": "long", "first_text": "string", "last_id": "long", "last_text": "string"}


def fingerprint_documents(docs: DataFrame) -> DataFrame:
    """One row per document with its fingerprint and its likeness to its edited text and to the next document.

    The texts move once, into ranges of `doc_id`; there a document's successor is the next row. Only the first
    and last row of each range are set aside, and joined with each other afterwards.
    """
    schema = ", ".join(f"{k} {v}" for k, v in (_COLUMNS | _EDGE).items())
    spark = docs.sparkSession
    # a range holds about as much as a partition of the input, whatever the setting
    ranges = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")), docs.rdd.getNumPartitions())
    sorted_docs = (
        docs.select("doc_id", "text").repartitionByRange(ranges, "doc_id", F.xxhash64("text")).sortWithinPartitions("doc_id", F.xxhash64("text"), "text")
        .withColumn("part", F.spark_partition_id().cast("long"))
    )

    def work(batches: Iterator[list]) -> Iterator[dict[str, list]]:
        held = first = None
        part = 0
        for doc_ids, texts, parts in batches:
            rows = []
            for doc_id, text in zip(doc_ids, texts, strict=True):
                now = Fingerprinted(text or "")
                if held is None:
                    first = (doc_id, now.text)
                else:
                    rows.append(_row(*held, now))
                held, part = (doc_id, now), parts[0]
            if rows:
                yield {c: [r[c] for r in rows] for c in _COLUMNS} | {c: [None] * len(rows) for c in _EDGE}
        if held is not None:
            yield {c: [None] for c in _COLUMNS} | {"part": [part], "first_id": [first[0]], "first_text": [first[1]], "last_id": [held[0]], "last_text": [held[1].text]}

    out = materialise(map_arrow(sorted_docs, ["doc_id", "text", "part"], work, schema))
    inner = out.filter("part is null").select(*_COLUMNS)
    edges = out.filter("part is not null").select(*_EDGE)
    # one row per range: their order is that of a table as long as there are ranges
    order = edges.select("part").collect()
    parts = sorted(r["part"] for r in order)
    follows = spark.createDataFrame(
        pa.table({"part": pa.array(parts, pa.int64()), "after": pa.array(parts[1:] + parts[:1], pa.int64())})
    ) if parts else spark.createDataFrame([], "part long, after long")
    pairs = (
        edges.select("part", "last_id", "last_text").join(follows, "part")
        .join(edges.select(F.col("part").alias("after"), "first_text"), "after")
    )

    def last(batches: Iterator[list]) -> Iterator[dict[str, list]]:
        for ids, texts, following in batches:
            rows = [_row(i, Fingerprinted(t), Fingerprinted(f)) for i, t, f in zip(ids, texts, following, strict=True)]
            if rows:
                yield {c: [r[c] for r in rows] for c in _COLUMNS}

    every = inner.unionByName(map_arrow(pairs, ["last_id", "last_text", "first_text"], last, ", ".join(f"{k} {v}" for k, v in _COLUMNS.items())))
    # digits only now: in the table that is written they would take twice the space
    return every.select(*[F.lower(F.hex(c)).alias(c) if kind == "binary" else F.col(c) for c, kind in _COLUMNS.items()])
