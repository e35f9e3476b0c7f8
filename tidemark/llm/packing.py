"""Bounded-space online best-fit packing of token pieces into sequences.

A document's ids, followed by one separator id, are cut into pieces of at most `capacity` ids. Each piece is placed as
it arrives and stays where it is: in the open sequence whose free space exceeds it least, found in a bitset keyed by
free space, so a choice costs one shift and one lowest bit. Only `open_bins` sequences stay open: beyond that the
fullest closes first. These are all that a task remembers, whatever the number of pieces.

Cutting comes first, where the texts are; then only the pieces' places and lengths travel, to one packing task for each
`per_task` pieces. They arrive there in the order of a hash, so that lengths come mixed even if the table is sorted by
them, and small partitions of the table do not each leave sequences unfilled.

Defined cases: a null or empty text is the separator alone, one piece of length 1; repeated rows are packed each; a
null doc_id is packed like any other; of sequences with equal free space the one that got to it last is taken; an empty
table gives no rows; columns other than `doc_id` and `text` are not read.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.bpe import encoder
from tidemark.llm.common import map_arrow, materialise

PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"


class OpenBins:
    """The open sequences of one task: numbers from 0, free space in a bitset."""

    def __init__(self, capacity: int, most: int):
        self.capacity, self.most = capacity, most
        self.bits = 0  # bit s: some open sequence has s free places
        self.by_free: list[list[int]] = [[] for _ in range(capacity + 1)]
        self.open = self.made = 0

    def place(self, length: int) -> tuple[int, int]:
        """The sequence that takes a piece of `length`, and the piece's offset there."""
        fits = self.bits >> length
        if fits:
            free = length + (fits & -fits).bit_length() - 1
            number = self._take(free)
        else:
            if self.open == self.most:
                self._take((self.bits & -self.bits).bit_length() - 1)  # the fullest closes
            number, free = self.made, self.capacity
            self.made += 1
        if left := free - length:
            self.by_free[left].append(number)
            self.bits |= 1 << left
            self.open += 1
        return number, self.capacity - free

    def _take(self, free: int) -> int:
        number = self.by_free[free].pop()
        if not self.by_free[free]:
            self.bits ^= 1 << free
        self.open -= 1
        return number


def pieces(docs: DataFrame, vocabulary: str, capacity: int, separator: int) -> DataFrame:
    """One row per piece: `doc_id, piece, start, length, ids_crc32`."""

    def work(batches: Iterator[list]) -> Iterator[dict[str, list]]:
        enc, end = encoder(vocabulary), separator.to_bytes(4, "little")
        for doc_ids, texts in batches:
            split = [enc.chunks(t or "") for t in texts]
            known = enc.learn(split)
            cut = []
            for doc_id, chunks in zip(doc_ids, split, strict=True):
                ids = b"".join([known[c] for c in chunks]) + end
                for k, a in enumerate(range(0, len(ids), 4 * capacity)):
                    part = ids[a : a + 4 * capacity]
                    cut.append((doc_id, k, a // 4, len(part) // 4, zlib.crc32(part)))
            if cut:
                yield dict(zip(("doc_id", "piece", "start", "length", "ids_crc32"), map(list, zip(*cut, strict=True)), strict=True))

    return map_arrow(docs, ["doc_id", "text"], work, PIECES)


def place(cut: DataFrame, capacity: int, open_bins: int, per_task: int) -> DataFrame:
    """`cut` (`doc_id, piece, length` and more) with `sequence_id` and `offset`."""
    tasks = max(1, -(-cut.count() // per_task))
    arriving = cut.withColumn("__at", F.xxhash64("doc_id", "piece")).repartition(tasks, "__at").sortWithinPartitions("__at", "doc_id", "piece")
    kept = cut.columns
    types = dict(cut.dtypes)

    def work(batches: Iterator[list]) -> Iterator[dict[str, list]]:
        bins = OpenBins(capacity, open_bins)
        for columns in batches:
            rows = dict(zip(kept, columns, strict=True))
            placed = [bins.place(n) for n in rows["length"]]
            yield rows | {"local_id": [p[0] for p in placed], "offset": [p[1] for p in placed]}

    schema = ", ".join(f"{c} {'long' if types[c] == 'bigint' else types[c]}" for c in kept)
    packed = map_arrow(arriving, kept, work, f"{schema}, local_id long, offset long")
    # a sequence's number: its task's, then its own
    sequence = F.shiftleft(F.spark_partition_id().cast("long"), 33) + F.col("local_id")
    return packed.select(*kept, sequence.alias("sequence_id"), "offset")


def pack(docs: DataFrame, vocabulary: str, capacity: int = 2048, separator: int = 0, open_bins: int = 4096, per_task: int = 1 << 18) -> DataFrame:
    """One row per piece: `doc_id, piece, start, length, ids_crc32, sequence_id, offset` (see the module)."""
    return place(materialise(pieces(docs, vocabulary, capacity, separator)), capacity, open_bins, per_task)
