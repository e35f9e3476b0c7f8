"""SimHash near-duplicates by bit-sliced comparison.

A text's fingerprint has a bit set where over half of its shingles' hashes have it. Fingerprints that differ in at
most `RADIUS` of 64 bits are linked. As six blocks of bits cannot all be touched by three changes, two linked
fingerprints agree in at least three blocks: each distinct fingerprint goes under the 20 choices of three blocks,
and only those that share such a key are compared. The comparison is bit-sliced: a block of fingerprints is held
as bit planes, one word for 64 of them; the planes of differences are added by carry-save counters for all at once,
and a block is abandoned as soon as every counter has passed the radius. A bucket answers with one tree of links
for each group it finds, so no group emits its pairs; buckets above `CHUNK` are dealt out as pairs of chunks.
Groups are then joined across buckets by alternating large-star and small-star rounds.

Three bits are few: texts that share 0.8 of their shingles mostly differ in more. `near_copies` finds those: texts
that agree in a band of shingle minima, or whose fingerprints are linked, make families, and within a family the whole
sets of shingles decide which texts are linked. No number of bits keeps a text out of a family.

Defined cases: a null or empty text has the fingerprint zero, linked like any other; equal rows are in one group;
a null doc_id is linked, but is never the smallest of a group that has another; an empty table gives no rows.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import combinations, groupby

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import join_dealt, map_arrow, materialise, or_empty

RADIUS = 3
WORDS = 3
SEED = 42
#: Fingerprints that one comparison holds as a block.
CHUNK = 2048
#: Groups over which the rows of one key are dealt out.
DEALT = 64

_WORD = re.compile(rb"[^\x20\x09-\x0D]+")
_LOWER = bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123)))
#: Six blocks of bits, and the masks of each choice of three.
BLOCKS = [((1 << b) - (1 << a)) & (1 << 64) - 1 for a, b in ((0, 11), (11, 22), (22, 33), (33, 44), (44, 54), (54, 64))]
MASKS = [a | b | c for a, b, c in combinations(BLOCKS, 3)]


def shingle_hashes(text: str, words: int = WORDS) -> np.ndarray:
    """XXH64 of each run of `words` words (of all words, if fewer), lower-cased, joined by spaces."""
    found = _WORD.findall(text.encode("utf-8", "surrogatepass").translate(_LOWER))
    if not found:
        return np.zeros(0, np.uint64)
    # between words stands one space, so a shingle is a slice of the whole
    whole = b" ".join(found)
    sizes = np.fromiter(map(len, found), np.int64, len(found)) + 1
    starts = np.cumsum(sizes) - sizes
    n = max(1, len(found) - words + 1)
    ends = (starts + sizes - 1)[min(words, len(found)) - 1 :]
    digest = xxhash.xxh64_intdigest
    return np.array([digest(whole[a:b], SEED) for a, b in zip(starts[:n].tolist(), ends.tolist(), strict=True)], np.uint64)


def fingerprint(text: str, words: int = WORDS) -> int:
    """The 64-bit fingerprint, unsigned."""
    return fingerprint_of(shingle_hashes(text, words))


def fingerprint_of(hashes: np.ndarray) -> int:
    """The fingerprint of a text's shingle hashes."""
    ones = np.zeros(64, np.int64)
    for a in range(0, len(hashes), 1 << 15):
        bits = np.unpackbits(hashes[a : a + (1 << 15)].astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        ones += bits.sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(hashes), bitorder="little").view("<u8")[0])


def planes(fingerprints: np.ndarray) -> np.ndarray:
    """64 rows of bits: row b holds bit b of every fingerprint, 64 of them to a word."""
    padded = np.zeros(-(-len(fingerprints) // 64) * 64, "<u8")
    padded[: len(fingerprints)] = fingerprints
    bits = np.unpackbits(padded.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    return np.ascontiguousarray(np.packbits(bits.T, axis=1, bitorder="little")).view("<u8")


def beyond(left: np.ndarray, right: np.ndarray, bits: list[int], radius: int = RADIUS) -> np.ndarray:
    """Bit-sliced distances over `bits` of two arrays of planes that broadcast: set where more than `radius` differ.

    Each plane of differences is added by carry-save: a counter holds one bit of all distances, its carry goes to
    the next, and what leaves the last one stays. Counting starts so high that this is the radius plus one.
    """
    counters = radius.bit_length()
    start = (1 << counters) - 1 - radius
    sums: list[np.ndarray] = []
    over = None
    for k, b in enumerate(bits):
        carry = left[b] ^ right[b]
        if over is None:
            sums = [np.full_like(carry, 2**64 - 1 if start >> c & 1 else 0) for c in range(counters)]
            over = np.zeros_like(carry)
        for c in range(counters):
            sums[c], carry = sums[c] ^ carry, sums[c] & carry
        over |= carry
        if k % 8 == 7 and bool((over == np.uint64(2**64 - 1)).all()):
            break  # every distance in the block has passed the radius
    return over


def _spread(queries: np.ndarray) -> np.ndarray:
    """Planes of single fingerprints: all ones where the bit is set, one column each."""
    bits = (queries[None, :] >> np.arange(64, dtype=np.uint64)[:, None]) & np.uint64(1)
    return (np.uint64(0) - bits)[:, :, None]


def trees(fingerprints: np.ndarray, bits: list[int], radius: int = RADIUS) -> list[tuple[int, int]]:
    """For distinct fingerprints: links (position, position) that join each group of linked ones, one less than its size."""
    n = len(fingerprints)
    block = planes(fingerprints)[:, None, :]
    near = np.zeros((n, block.shape[2]), np.uint64)
    for a in range(0, n, 256):
        near[a : a + 256] = ~beyond(_spread(fingerprints[a : a + 256]), block, bits, radius)
    real = np.zeros(block.shape[2] * 64, np.uint8)
    real[:n] = 1
    todo = np.packbits(real, bitorder="little").view("<u8").copy()
    links: list[tuple[int, int]] = []
    for seed in range(n):
        if not todo[seed // 64] >> np.uint64(seed % 64) & np.uint64(1):
            continue
        todo[seed // 64] &= ~(np.uint64(1) << np.uint64(seed % 64))
        edge = np.array([seed])
        while len(edge):
            reached = np.bitwise_or.reduce(near[edge], axis=0) & todo
            todo &= ~reached
            edge = np.flatnonzero(np.unpackbits(reached.view(np.uint8), bitorder="little"))
            links += [(seed, int(x)) for x in edge]
    return links


def _small_links(key: np.ndarray, fps: np.ndarray, most: int, radius: int = RADIUS) -> tuple[np.ndarray, np.ndarray]:
    """Linked pairs inside buckets of at most `most`, all buckets together: the planes hold pairs instead of fingerprints."""
    left, right = [], []
    for step in range(1, most):
        i = np.flatnonzero(key[:-step] == key[step:])
        if not len(i):
            break
        differ = fps[i] ^ fps[i + step]
        over = beyond(planes(differ), np.zeros((64, 1), np.uint64), list(range(64)), radius)
        hit = i[np.unpackbits(over.view(np.uint8), bitorder="little")[: len(i)] == 0]
        left.append(hit)
        right.append(hit + step)
    return np.concatenate(left or [np.zeros(0, int)]), np.concatenate(right or [np.zeros(0, int)])


def bucket_links(fingerprints: DataFrame) -> DataFrame:
    """`a, b`: linked fingerprints (column `fp`, distinct), enough of them to join every group."""
    masks = F.array(*[F.lit(m - (1 << 64) if m >= 1 << 63 else m) for m in MASKS])
    keyed = fingerprints.select(F.col("fp").alias("node"), "fp", F.posexplode(masks).alias("choice", "mask")).select(
        "node", "fp", "choice", F.col("fp").bitwiseAND(F.col("mask")).alias("key")
    )
    # the bits of a key are equal in its bucket
    return links_in_buckets(keyed, [[k for k in range(64) if not m >> k & 1] for m in MASKS], RADIUS)


def links_in_buckets(keyed: DataFrame, bits: list[list[int]], radius: int) -> DataFrame:
    """`a, b`: nodes of a bucket (`node, fp, choice, key`) whose fingerprints differ in at most `radius` of the choice's bits."""
    counts = keyed.groupBy("choice", "key").agg(F.count("*").alias("n")).filter("n > 1")
    counts = counts.withColumn("chunks", F.ceil(F.col("n") / CHUNK).cast("int"))
    shared = keyed.join(counts, ["choice", "key"])
    # a bucket of several chunks is dealt out: each pair of chunks is a cell, and a row goes to the cells of its chunk
    chunk = F.pmod(F.xxhash64("node", "key"), F.col("chunks")).cast("int")
    other = F.sequence(F.lit(0), F.col("chunks") - 1)
    cells = F.transform(other, lambda o: F.least(o, F.col("chunk")) * F.col("chunks") + F.greatest(o, F.col("chunk")))
    dealt = shared.withColumn("chunk", chunk).select("choice", "key", F.explode(cells).alias("cell"), "fp", "node")
    n = int(keyed.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    sorted_ = dealt.repartition(n, "choice", "key", "cell").sortWithinPartitions("choice", "key", "cell", "node")
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64())])

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for choice, key, cell, fps, nodes in _whole_buckets(batches):
            starts = np.flatnonzero(np.r_[True, (choice[1:] != choice[:-1]) | (key[1:] != key[:-1]) | (cell[1:] != cell[:-1])])
            sizes = np.diff(np.r_[starts, len(key)])
            unsigned = fps.view(np.uint64)
            number = np.repeat(np.arange(len(starts)), sizes)
            small = np.repeat(sizes <= 16, sizes)
            i, j = _small_links(number[small], unsigned[small], 16, radius)
            a, b = [nodes[small][i]], [nodes[small][j]]
            for at, size in zip(starts[sizes > 16].tolist(), sizes[sizes > 16].tolist(), strict=True):
                found = trees(unsigned[at : at + size], bits[int(choice[at])], radius)
                links = np.array(found or np.zeros((0, 2)), np.int64).reshape(-1, 2) + at
                a.append(nodes[links[:, 0]])
                b.append(nodes[links[:, 1]])
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(a), pa.int64()), pa.array(np.concatenate(b), pa.int64())], schema=schema)

    return sorted_.mapInArrow(compare, "a long, b long").distinct()


def _whole_buckets(batches: Iterator[pa.RecordBatch]) -> Iterator[list[np.ndarray]]:
    """Columns of the sorted rows in pieces that end where a bucket ends."""
    rest: list[np.ndarray] | None = None
    for batch in batches:
        now = [c.to_numpy(zero_copy_only=False) for c in batch.columns]
        if rest is not None:
            now = [np.concatenate([r, x]) for r, x in zip(rest, now, strict=True)]
        if not len(now[0]):
            continue
        same = (now[0] == now[0][-1]) & (now[1] == now[1][-1]) & (now[2] == now[2][-1])
        cut = len(same) - int(np.argmin(same[::-1])) if not same.all() else 0
        rest = [x[cut:] for x in now]
        if cut:
            yield [x[:cut] for x in now]
    if rest is not None and len(rest[0]):
        yield rest


def with_least(rows: DataFrame, keys: list[str], value: str, least: str) -> DataFrame:
    """`rows` with the column `least`: the smallest `value` of the rows with equal `keys`.

    A key's rows are dealt out over `DEALT` groups and meet one row of their group, so that a key which holds a third
    of all rows is in no task as a whole.
    """
    dealt = rows.withColumn("__group", F.pmod(F.xxhash64(value), F.lit(DEALT)))
    groups = dealt.groupBy(*keys, "__group").agg(F.min(value).alias(least))
    whole = groups.groupBy(*keys).agg(F.min(least).alias(least))
    found = groups.select(*keys, "__group").join(whole, keys)
    return dealt.join(found.hint("merge"), [*keys, "__group"]).drop("__group")


def join_groups(links: DataFrame) -> DataFrame:
    """`node, root` for every node of `links` (`a`, `b`): the smallest node it is connected with, itself included.

    Alternating rounds: large-star hangs a node's larger neighbours on the smallest node it knows, small-star does
    so with the node and its smaller ones. Each round is a grouping and a join; nothing comes to the driver but
    one number a round, by which the rounds end.
    """
    edges = materialise(links.filter("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct())
    before = None
    while True:
        both = edges.select("u", "v").union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = with_least(both, ["u"], "v", "m").filter("v > u").select(F.col("v").alias("u"), F.least("u", "m").alias("v"))
        large = materialise(large.distinct())
        small = with_least(large, ["u"], "v", "m").select(F.explode(F.array(F.struct(F.col("v").alias("u"), F.col("m").alias("v")), F.struct("u", F.col("m").alias("v")))).alias("e")).select("e.*")
        edges = materialise(small.filter("u <> v").distinct())
        # the sum of what nodes hang on falls in every round until all hang on their roots
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == before:
            return edges.select(F.col("u").alias("node"), F.col("v").alias("root"))
        before = now


def with_fingerprints(docs: DataFrame, words: int = WORDS) -> DataFrame:
    """`doc_id, fp` of every row."""

    def work(batches: Iterator[list]) -> Iterator[dict[str, list]]:
        for doc_ids, texts in batches:
            values = np.array([fingerprint(t, words) for t in texts], np.uint64).view(np.int64)
            yield {"doc_id": doc_ids, "fp": values.tolist()}

    return map_arrow(docs.select("doc_id", or_empty("text").alias("text")), ["doc_id", "text"], work, "doc_id long, fp long")


def hex_of(fp: Column) -> Column:
    """16 lower-case hex digits of a 64-bit number."""
    return F.lower(F.lpad(F.hex(fp), 16, "0"))


def fingerprint_groups(prints: DataFrame) -> DataFrame:
    """`fp, component_id` of each distinct fingerprint of `prints` (`doc_id, fp`)."""
    # a fingerprint stands for all its rows: equal texts cost nothing from here on
    distinct = materialise(prints.groupBy("fp").agg(F.min("doc_id").alias("first_id")))
    roots = join_groups(bucket_links(distinct.select("fp"))).withColumnRenamed("node", "fp")
    rooted = distinct.join(roots, "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    smallest = rooted.groupBy("root").agg(F.min("first_id").alias("component_id"))
    return rooted.join(smallest, "root").select("fp", "component_id")


def near_duplicates(docs: DataFrame, words: int = WORDS) -> DataFrame:
    """One row per row of `docs`: `doc_id, fingerprint, component_id` (see the module's docstring)."""
    prints = materialise(with_fingerprints(docs, words))
    return prints.join(fingerprint_groups(prints), "fp").select("doc_id", hex_of(F.col("fp")).alias("fingerprint"), "component_id")


#: For copies of a stated similarity: minima of shingle hashes, in bands of so many.
BANDS, ROWS_IN_BAND = 12, 2
#: Bytes of shingle hashes that one part of a family may hold; a cell holds two parts.
CHUNK_BYTES = 16 << 20
#: A factor for each row of minima, drawn independently: factors in a fixed proportion have their minima at the same shingle.
_FACTORS = np.array([xxhash.xxh64_intdigest(b"row %d" % k, SEED) | 1 for k in range(BANDS * ROWS_IN_BAND)], np.uint64)
_MIX = np.uint64(0xD6E8FEB86659FD93)


def minima(hashes: np.ndarray) -> np.ndarray:
    """The least hash of the last axis in each row's own order, by bands: multiply, shift, multiply."""
    spread = hashes ^ (hashes >> np.uint64(29))
    rows = []
    for factor in _FACTORS:
        mixed = spread * factor
        mixed ^= mixed >> np.uint64(32)
        mixed *= _MIX
        rows.append(mixed.min(axis=-1))
    return np.stack(rows, axis=-1).reshape(*hashes.shape[:-1], BANDS, ROWS_IN_BAND)


def band_keys(hashes: np.ndarray) -> list[int]:
    """A key for each band of minima: by calculation texts of 0.8 similarity miss all bands once in 200,000 times."""
    least = minima(hashes)
    return (least[:, 0] * np.uint64(31) + (least[:, 1] >> np.uint64(7))).view(np.int64).tolist()


def similar_links(sets: list[np.ndarray], parts: np.ndarray, similarity: float) -> list[tuple[int, int]]:
    """Links (position, position) that join all sets with at least `similarity` in common, through others as well.

    Where the sets come from two parts, only those of different parts are compared. A set is held against all that
    it is not joined with yet by going through the owners of each of its members.
    """
    n = len(sets)
    sizes = np.array([len(x) for x in sets])
    ends = np.cumsum(sizes)
    _, number, held = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    owners = np.repeat(np.arange(n), sizes)[np.argsort(number, kind="stable")]
    first = np.cumsum(held) - held
    crossing = bool((parts != parts[0]).any())
    label = np.arange(n)
    links: list[tuple[int, int]] = []
    for x in range(n - 1):
        apart = label != label[x]
        apart[: x + 1] = False
        apart &= np.minimum(sizes, sizes[x]) >= similarity * np.maximum(sizes, sizes[x])
        if crossing:
            apart &= parts != parts[x]
        if not apart.any():
            continue
        mine = number[ends[x] - sizes[x] : ends[x]]
        many = held[mine]
        at = np.repeat(first[mine] - (np.cumsum(many) - many), many) + np.arange(many.sum())
        both = np.bincount(owners[at], minlength=n)
        for y in np.flatnonzero(apart & (both >= similarity * (sizes + sizes[x] - both))).tolist():
            if label[y] != label[x]:
                label[label == label[y]] = label[x]
                links.append((x, y))
    return links


def _members(links: DataFrame) -> DataFrame:
    """`node, root` of all nodes of `links`, roots included."""
    rooted = join_groups(links)
    return rooted.union(rooted.select("root", "root").distinct())


def family_links(sketches: DataFrame) -> DataFrame:
    """`a, b`: nodes (`node, fp, bands`) of one family, enough of them to join it; texts without a word are in none.

    Each bucket of equal band keys hangs on its smallest node, and so do texts of equal fingerprints; of fingerprints
    that `bucket_links` finds, those smallest nodes are linked.
    """
    worded = sketches.filter(F.size("bands") > 0)
    buckets = worded.select(F.col("node").alias("a"), F.posexplode("bands").alias("choice", "key"))
    agreeing = with_least(buckets, ["choice", "key"], "a", "b").filter("a <> b").select("a", "b")
    prints = materialise(with_least(worded.select(F.col("node").alias("a"), "fp"), ["fp"], "a", "b"))
    first = prints.filter("a = b").select("fp", F.col("a").alias("first"))
    near = bucket_links(first.select("fp"))
    near = near.join(first.select(F.col("fp").alias("a"), F.col("first").alias("u")), "a").join(first.select(F.col("fp").alias("b"), F.col("first").alias("v")), "b")
    return agreeing.union(prints.filter("a <> b").select("a", "b")).union(near.select("u", "v"))


def _sha(text: Column) -> Column:
    return F.unhex(F.sha2(text, 256))


def near_copies(docs: DataFrame, words: int = 5, similarity: float = 0.8) -> DataFrame:
    """`sha, root` of texts (by their SHA-256) that share at least `similarity` of their shingles, through others as well.

    Texts that agree in a band of shingle minima, or whose fingerprints (of distinct shingles) are linked, are of one
    family. Each family gathers its texts' whole sets of shingles once, dealt out as pairs of parts if it is large,
    and `similar_links` finds the links in it: none between unlike texts, and none lost inside a family.
    """
    keyed = docs.select(or_empty("text").alias("text")).filter("text <> ''").withColumn("sha", _sha(F.col("text")))

    def sketch(batches: Iterator[list]) -> Iterator[dict[str, list]]:
        for shas, texts in batches:
            hashes = [np.unique(shingle_hashes(t, words)) for t in texts]
            fps = [int(np.uint64(fingerprint_of(h)).view(np.int64)) for h in hashes]
            yield {"sha": shas, "fp": fps, "bands": [band_keys(h) if len(h) else [] for h in hashes]}

    distinct = map_arrow(keyed, ["sha", "text"], sketch, "sha binary, fp long, bands array<bigint>")
    distinct = distinct.groupBy("sha").agg(F.first("fp").alias("fp"), F.first("bands").alias("bands"), F.count("*").alias("n"))
    # a number for each distinct text, which no two texts share
    sketches = materialise(distinct.withColumn("node", F.monotonically_increasing_id()))
    families = _members(family_links(sketches)).withColumnRenamed("root", "family")
    families = materialise(sketches.select("node", "sha", "n").join(families, "node"))

    def sets(batches: Iterator[list]) -> Iterator[dict[str, list]]:
        for nodes, owners, texts in batches:
            yield {"node": nodes, "family": owners, "shingles": [np.unique(shingle_hashes(t, words)).tobytes() for t in texts]}

    texts = join_dealt(keyed, families, ["sha"], "n")
    sets_ = materialise(map_arrow(texts, ["node", "family", "text"], sets, "node long, family long, shingles binary").dropDuplicates(["node"]))
    rooted = join_groups(links_in_families(sets_, similarity))
    named = families.select("node", "sha")
    return rooted.join(named, "node").join(named.select(F.col("node").alias("root"), F.col("sha").alias("root_sha")), "root").select("sha", F.col("root_sha").alias("root"))


def links_in_families(sets: DataFrame, similarity: float) -> DataFrame:
    """`a, b`: nodes of a family (`node, family, shingles`) with `similarity` in common, enough of them to join every group."""
    sizes = sets.groupBy("family").agg(F.count("*").alias("n"), F.sum(F.length("shingles")).alias("bytes"))
    parts = F.ceil(F.greatest(F.col("n") / CHUNK, F.col("bytes") / CHUNK_BYTES)).cast("long")
    sizes = materialise(sizes.select("family", "n", parts.alias("parts")))
    placed = join_dealt(sets, sizes, ["family"], "n").withColumn("part", F.pmod(F.xxhash64("node"), F.col("parts")))
    # as with buckets: each pair of parts is a cell, and a row goes to the cells of its part
    other = F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)
    cells = F.transform(other, lambda o: F.least(o, F.col("part")) * F.col("parts") + F.greatest(o, F.col("part")))
    dealt = placed.select("family", F.explode(cells).alias("cell"), "part", "node", "shingles")
    n = int(sets.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    sorted_ = dealt.repartition(n, "family", "cell").sortWithinPartitions("family", "cell", "node")

    def hold(batches: Iterator[list]) -> Iterator[dict[str, list]]:
        rows = (row for columns in batches for row in zip(*columns, strict=True))
        for _, cell in groupby(rows, key=lambda row: row[:2]):
            parts, nodes, texts = zip(*(row[2:] for row in cell), strict=True)
            found = similar_links([np.frombuffer(t, np.uint64) for t in texts], np.array(parts), similarity)
            yield {"a": [nodes[i] for i, _ in found], "b": [nodes[j] for _, j in found]}

    return map_arrow(sorted_, ["family", "cell", "part", "node", "shingles"], hold, "a long, b long")


def keep_first(docs: DataFrame, words: int = 5, similarity: float = 0.8) -> DataFrame:
    """The rows of `docs` whose doc_id is the smallest of their group of near copies, all columns as they are.

    Equal texts are one group; of their rows all that have the smallest doc_id stay. Empty texts are a group.
    """
    roots = near_copies(docs, words, similarity)
    ids = docs.select("doc_id", _sha(or_empty("text")).alias("sha"))
    rooted = ids.join(roots, "sha", "left").withColumn("root", F.coalesce("root", "sha"))
    # what goes: as most documents are alone, this is the smaller table; joined by sorting, however small it is
    gone = with_least(rooted, ["root"], "doc_id", "least").filter(~F.col("doc_id").eqNullSafe(F.col("least")))
    gone = materialise(gone.select(F.col("doc_id").alias("__id"), F.col("sha").alias("__sha")).distinct()).hint("merge")
    named = docs.withColumn("__n", _sha(or_empty("text")))
    return named.join(gone, (F.col("__n") == F.col("__sha")) & F.col("doc_id").eqNullSafe(F.col("__id")), "left_anti").drop("__n")
