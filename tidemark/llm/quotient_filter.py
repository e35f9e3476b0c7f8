"""Exact duplicates by counting quotient filters.

Each partition builds a counting quotient filter of its texts' 64-bit fingerprints. A fingerprint's high bits, the
quotient, address a slot; its low bits, the remainder, are kept there or, if the slot is taken, in the next one that is
free. The remainders of a quotient stand in one run, ascending, and three bits a slot say which quotients occur, which
slots go on a run, and which remainders were shifted from their place; a count stands beside each remainder. Nothing
else is stored: the fingerprints follow from slots and bits.

Read from left to right a filter gives its fingerprints in ascending order, so filters merge without loss in one pass
over sorted remainders, and equal ones add their counts. Merging goes by levels: in each, a filter is parted by the next
bits of its quotients into `FAN` ranges, and `FAN` neighbouring filters of a range become one. A level moves what the
filters hold once, in `FAN` pieces for each filter, until a range has one filter left. Only fingerprints counted more
than once go on to byte verification, where the texts themselves are grouped; their SHA-256 then names the group to
every row.

Defined cases: a null text counts as empty; of rows that share the largest doc_id of a group one stays;
a null doc_id is smaller than any other, and stays only in a group of nulls; an empty table gives no rows; columns
other than `doc_id` and `text` are carried by `keep_last` and ignored elsewhere.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import join_dealt, map_arrow, materialise, or_empty

FAN_BITS = 6
#: Filters that a merge takes, and ranges that it gives.
FAN = 1 << FAN_BITS
#: Largest share of the slots that are filled when a filter is loaded; slots are a power of two.
LOAD = 0.9
#: A count of this and more stands in a table of its own, with its slot.
LARGE = 255


class CountingQuotientFilter:
    """A filter of the fingerprints that have `skip` given high bits; those are not stored.

    `bits` of the rest are the quotient. `remainders` has a row of bytes for each slot, `counts` a byte; `occupied` is
    set at the quotients that occur, `continued` and `shifted` at slots, as described above.
    """

    def __init__(self, skip: int, bits: int, remainders: np.ndarray, occupied: np.ndarray, continued: np.ndarray, shifted: np.ndarray, counts: np.ndarray, large: np.ndarray):
        self.skip, self.bits, self.remainders, self.counts, self.large = skip, bits, remainders, counts, large
        self.occupied, self.continued, self.shifted = occupied, continued, shifted

    @classmethod
    def load(cls, own: np.ndarray, counts: np.ndarray, skip: int = 0) -> CountingQuotientFilter:
        """The filter of distinct ascending fingerprints (without their `skip` high bits) and their counts."""
        bits = max(1, int(len(own) / LOAD - 1).bit_length()) if len(own) else 1
        rest = 64 - skip - bits
        quotient = (own >> np.uint64(rest)).astype(np.int64)
        place = np.arange(len(own))
        # the next free slot at or after the quotient's own
        slot = np.maximum.accumulate(quotient - place) + place if len(own) else place
        size = max(1 << bits, int(slot[-1]) + 1 if len(own) else 0)
        remainders = np.zeros((size, -(-rest // 8)), np.uint8)
        remainders[slot] = (own & np.uint64((1 << rest) - 1)).astype("<u8").view(np.uint8).reshape(-1, 8)[:, : remainders.shape[1]]
        occupied, continued, shifted = np.zeros((3, size), bool)
        occupied[quotient] = True
        continued[slot[1:]] = quotient[1:] == quotient[:-1]
        shifted[slot] = slot != quotient
        counted = np.zeros(size, np.uint8)
        counted[slot] = np.minimum(counts, LARGE)
        many = counts >= LARGE
        return cls(skip, bits, remainders, occupied, continued, shifted, counted, np.stack([slot[many], counts[many]], axis=1).astype(np.int64))

    @classmethod
    def of(cls, fingerprints: np.ndarray) -> CountingQuotientFilter:
        """The filter of unsigned 64-bit fingerprints."""
        distinct, counts = np.unique(fingerprints, return_counts=True)
        return cls.load(distinct, counts.astype(np.int64))

    def contents(self) -> tuple[np.ndarray, np.ndarray]:
        """What was put in, ascending and without repeats, and how often: the k-th run belongs to the k-th quotient that occurs."""
        used = np.flatnonzero(self.occupied | self.continued | self.shifted)
        run = np.cumsum(~self.continued[used]) - 1
        quotient = np.flatnonzero(self.occupied)[run].astype(np.uint64)
        wide = np.zeros((len(used), 8), np.uint8)
        wide[:, : self.remainders.shape[1]] = self.remainders[used]
        counts = np.zeros(len(self.counts), np.int64)
        counts[:] = self.counts
        counts[self.large[:, 0]] = self.large[:, 1]
        return quotient << np.uint64(64 - self.skip - self.bits) | wide.view("<u8")[:, 0], counts[used]

    def count(self, own: int) -> int:
        """How often one fingerprint was put in, by its slot: rank of its quotient, the run of that rank, its remainders."""
        rest = 64 - self.skip - self.bits
        quotient = own >> rest
        if not self.occupied[quotient]:
            return 0
        used = self.occupied | self.continued | self.shifted
        at = int(np.flatnonzero(used & ~self.continued)[np.count_nonzero(self.occupied[:quotient])])
        wanted = (own & ((1 << rest) - 1)).to_bytes(8, "little")[: self.remainders.shape[1]]
        while True:
            if self.remainders[at].tobytes() == wanted:
                large = self.large[self.large[:, 0] == at, 1]
                return int(large[0]) if len(large) else int(self.counts[at])
            at += 1
            if at == len(self.counts) or not self.continued[at]:
                return 0

    @staticmethod
    def merged(filters: Sequence[CountingQuotientFilter]) -> CountingQuotientFilter:
        """All that `filters` of one range hold: one pass over sorted fingerprints, equal ones add their counts."""
        held, counts = (np.concatenate(x) for x in zip(*(f.contents() for f in filters), strict=True))
        order = np.argsort(held, kind="stable")  # merges sorted stretches
        held, counts = held[order], counts[order]
        first = np.flatnonzero(np.r_[True, held[1:] != held[:-1]]) if len(held) else np.zeros(0, int)
        return CountingQuotientFilter.load(held[first], np.add.reduceat(counts, first) if len(held) else counts, filters[0].skip)

    def ranges(self) -> Iterator[tuple[int, CountingQuotientFilter]]:
        """A filter for each range of the next bits that holds something, with the range's number."""
        own, counts = self.contents()
        rest = np.uint64(64 - self.skip - FAN_BITS)
        which = (own >> rest).astype(np.int64)
        starts = np.flatnonzero(np.r_[True, which[1:] != which[:-1]]) if len(which) else []
        for a, b in zip(starts, [*starts[1:], len(which)], strict=True):
            yield int(which[a]), CountingQuotientFilter.load(own[a:b] & np.uint64((1 << int(rest)) - 1), counts[a:b], self.skip + FAN_BITS)

    def to_bytes(self) -> bytes:
        """A head of four numbers, remainders, the three bits of the slots, counts, and the large counts."""
        head = np.array([self.skip, self.bits, len(self.counts), len(self.large)], "<i8")
        bits = [np.packbits(x) for x in (self.occupied, self.continued, self.shifted)]
        return b"".join(x.tobytes() for x in (head, self.remainders, *bits, self.counts, self.large.astype("<i8")))

    @classmethod
    def from_bytes(cls, data: bytes) -> CountingQuotientFilter:
        """The inverse of `to_bytes`."""
        skip, bits, size, n_large = np.frombuffer(data, "<i8", 4).tolist()
        width, packed, at = -(-(64 - skip - bits) // 8), -(-size // 8), 32
        remainders = np.frombuffer(data, np.uint8, size * width, at).reshape(size, width)
        at += size * width
        flags = [np.unpackbits(np.frombuffer(data, np.uint8, packed, at + k * packed), count=size).astype(bool) for k in range(3)]
        at += 3 * packed
        counts = np.frombuffer(data, np.uint8, size, at)
        return cls(skip, bits, remainders, *flags, counts, np.frombuffer(data, "<i8", 2 * n_large, at + size).reshape(-1, 2))


_PIECES = "range long, part long, filter binary"


def _pieces(whole: CountingQuotientFilter, prefix: int, part: int) -> Iterator[tuple[int, int, bytes]]:
    for k, piece in whole.ranges():
        yield prefix << FAN_BITS | k, part >> FAN_BITS, piece.to_bytes()


def counted_fingerprints(fingerprints: DataFrame) -> DataFrame:
    """`fp, n` of the fingerprints (column `fp`, long) that the merged filters count more than once."""
    parts = fingerprints.rdd.getNumPartitions()
    levels = max(1, -(-(max(parts, 1) - 1).bit_length() // FAN_BITS))
    numbered = fingerprints.select("fp", F.spark_partition_id().cast("long").alias("part"))

    def build(batches: Iterator[list]) -> Iterator[dict[str, list]]:
        held, part = [], 0
        for fps, numbers in batches:
            if numbers:
                held.append(np.array(fps, np.int64))
                part = numbers[0]
        if held:
            rows = list(_pieces(CountingQuotientFilter.of(np.concatenate(held).view(np.uint64)), 0, part))
            yield dict(zip(("range", "part", "filter"), map(list, zip(*rows, strict=True)), strict=True))

    def merge(rows: pd.DataFrame) -> CountingQuotientFilter:
        return CountingQuotientFilter.merged([CountingQuotientFilter.from_bytes(x) for x in rows["filter"]])

    def again(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame(list(_pieces(merge(rows), int(key[0]), int(key[1]))), columns=["range", "part", "filter"])

    def last(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        own, counts = merge(rows).contents()
        whole = own[counts > 1] | np.uint64(int(key[0]) << (64 - FAN_BITS * levels))
        return pd.DataFrame({"fp": whole.view(np.int64), "n": counts[counts > 1]})

    filters = map_arrow(numbered, ["fp", "part"], build, _PIECES)
    for _ in range(levels - 1):
        filters = filters.groupBy("range", "part").applyInPandas(again, _PIECES)
    return filters.groupBy("range").applyInPandas(last, "fp long, n long")


def _keyed(docs: DataFrame) -> DataFrame:
    return docs.withColumn("text", or_empty("text")).withColumn("fp", F.xxhash64("text"))


def duplicate_groups(docs: DataFrame) -> DataFrame:
    """`text_sha256, keep_id, group_size` of every text that more than one row has, verified byte by byte."""
    keyed = _keyed(docs.select("doc_id", "text"))
    suspects = materialise(counted_fingerprints(keyed.select("fp")))
    # a hot text's rows are dealt out; grouping by the text compares bytes, and equal texts collapse in each of these tasks
    verified = join_dealt(keyed, suspects, ["fp"], "n").groupBy("text").agg(F.max("doc_id").alias("keep_id"), F.count("*").alias("group_size"))
    return verified.filter("group_size > 1").select(F.sha2("text", 256).alias("text_sha256"), "keep_id", "group_size")


def mark_duplicates(docs: DataFrame) -> DataFrame:
    """One row per row of `docs`: `doc_id, keep_id, group_size, kept, text_sha256` (see the module)."""
    groups = materialise(duplicate_groups(docs))
    rows = docs.select("doc_id", F.sha2(or_empty("text"), 256).alias("text_sha256"))
    # repeated rows are counted, and told apart again by a number: one of them may stay
    same = rows.groupBy("doc_id", "text_sha256").agg(F.count("*").alias("n"))
    joined = join_dealt(same, groups, ["text_sha256"], "group_size", "left").withColumn("turn", F.explode(F.sequence(F.lit(1), F.col("n").cast("int"))))
    alone = F.col("group_size").isNull()
    keep = F.when(alone, F.col("doc_id")).otherwise(F.col("keep_id"))
    return joined.select(
        "doc_id", keep.alias("keep_id"), F.coalesce("group_size", F.lit(1).cast("long")).alias("group_size"),
        (alone | (F.col("doc_id").eqNullSafe(F.col("keep_id")) & (F.col("turn") == 1))).alias("kept"), "text_sha256",
    )


def keep_last(docs: DataFrame) -> DataFrame:
    """The rows of `docs` that stay, all columns as they are; names that begin with two underscores are taken.

    The texts are shuffled once, whatever the groups' number, so that a larger table has no other plan.
    """
    groups = materialise(duplicate_groups(docs)).select(F.col("text_sha256").alias("__sha"), F.col("keep_id").alias("__keep"), F.col("group_size").alias("__many"))
    named = docs.withColumn("__sha", F.sha2(or_empty("text"), 256))
    # texts whose doc_id that stays is that of several rows: few if ids are unique, and then the second pass is a small join
    rows = join_dealt(named.select("doc_id", "__sha"), groups, ["__sha"], "__many").filter(F.col("doc_id").eqNullSafe(F.col("__keep")))
    tied = materialise(rows.groupBy("__sha").agg(F.count("*").alias("__rows")).filter("__rows > 1"))
    groups = groups.join(tied.select("__sha", F.lit(True).alias("__tied")), "__sha", "left")
    stays = F.col("__many").isNull() | (F.col("doc_id").eqNullSafe(F.col("__keep")) & F.col("__tied").isNull())
    alone = join_dealt(named, groups, ["__sha"], "__many", "left").filter(stays)
    again = named.join(tied.select("__sha"), "__sha").join(groups.select("__sha", "__keep"), "__sha").filter(F.col("doc_id").eqNullSafe(F.col("__keep"))).dropDuplicates(["__sha"])
    columns = [F.col(f"`{c}`") for c in docs.columns]
    return alone.select(*columns).unionByName(again.select(*columns))
