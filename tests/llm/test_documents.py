"""Operators on documents, each against brute force over the odd cases."""

import hashlib
import re
import unicodedata
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
import regex
import xxhash
from pyspark.sql import functions as F
from tokenizers import Tokenizer, normalizers

from tests.llm.conftest import odd_documents
from tidemark.llm import bpe, common, disclosure, packing, ppm_language, prefix_hash, quotient_filter, simhash

VOCABULARY = public_tokenizers.path("word_bpe_49k.json")
ROWS = [(r[0], r[1] or "") for r in odd_documents()]


def sha(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


def rows(df):
    return [tuple(r) for r in df.collect()]


def test_bpe_equals_the_library(odd_docs):
    lib = Tokenizer.from_file(VOCABULARY)
    want = Counter()
    for doc_id, text in ROWS:
        ids = lib.encode(text, add_special_tokens=False).ids
        want[(doc_id, len(ids), sha(" ".join(map(str, ids))), sha(lib.decode(ids, skip_special_tokens=False)))] += 1
    assert Counter(rows(bpe.encode_documents(odd_docs, VOCABULARY))) == want


def test_bpe_of_all_code_points():
    lib, enc = Tokenizer.from_file(VOCABULARY), bpe.Encoder(VOCABULARY)
    points = [*range(0xD800), *range(0xE000, 0x20000, 3), *range(0x20000, 0x110000, 97)]
    for a in range(0, len(points), 20_000):
        texts = [f"ab{chr(c)}c 1{chr(c)}" for c in points[a : a + 20_000]]
        assert enc.encode_batch(texts) == [e.ids for e in lib.encode_batch(texts, add_special_tokens=False)]


def test_bpe_of_all_pairs_of_marks():
    """Every two combining marks after a letter are composed and ordered as in the library, and so are all letters' parts."""
    nfc = normalizers.NFC()
    marks = [chr(c) for c in range(0x110000) if unicodedata.combining(chr(c))]
    wrong = [a + b for a in marks for b in marks if bpe.normalised(f"e{a}{b}") != nfc.normalize_str(f"e{a}{b}")]
    assert not wrong and len(marks) > 900
    letters = [chr(c) for c in range(0x110000) if not 0xD800 <= c < 0xE000]
    assert all(bpe.normalised(s) == nfc.normalize_str(s) for c in letters for s in (c, unicodedata.normalize("NFD", c)))
    lib, enc = Tokenizer.from_file(VOCABULARY), bpe.Encoder(VOCABULARY)
    some = [f"{base}{a}{b} x" for base in "aक" for a in marks[::7] for b in marks[::11]]
    assert enc.encode_batch(some) == [e.ids for e in lib.encode_batch(some, add_special_tokens=False)]


def test_bpe_memory_is_bounded():
    enc = bpe.Encoder(VOCABULARY)
    enc.REMEMBERED = 10
    texts = [f"word{k} other{k}" for k in range(100)]
    lib = Tokenizer.from_file(VOCABULARY)
    for t in texts:
        assert enc.encode_batch([t])[0] == lib.encode(t, add_special_tokens=False).ids
    assert len(enc._memory) <= 13


def test_packing_cuts_and_fills(odd_docs):
    lib = Tokenizer.from_file(VOCABULARY)
    got = packing.pack(odd_docs, VOCABULARY).collect()
    want = Counter()
    for doc_id, text in ROWS:
        ids = [*lib.encode(text, add_special_tokens=False).ids, 0]
        for k, a in enumerate(range(0, len(ids), 2048)):
            part = ids[a : a + 2048]
            want[(doc_id, k, a, len(part), zlib.crc32(np.array(part, "<u4").tobytes()))] += 1
    assert Counter(tuple(r)[:5] for r in got) == want
    sequences = defaultdict(list)
    for r in got:
        sequences[r["sequence_id"]].append((r["offset"], r["length"]))
    for parts in sequences.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 2048


def test_the_fullest_closes_first():
    bins = packing.OpenBins(10, 2)
    assert [bins.place(n) for n in (6, 7, 5, 4)] == [(0, 0), (1, 0), (2, 0), (0, 6)]


def naive_best_fit(lengths: list[int], capacity: int, most: int) -> list[tuple[int, int]]:
    """By looking at every open sequence for every piece; of equal ones the last that got to this free space."""
    free: list[list[int]] = []  # number, free space, in the order in which they got it
    made, out = 0, []
    for n in lengths:
        fits = [b for b in free if b[1] >= n]
        if fits:
            least = min(b[1] for b in fits)
            best = [b for b in fits if b[1] == least][-1]
            free.remove(best)
        else:
            if len(free) == most:
                fullest = min(b[1] for b in free)
                free.remove([b for b in free if b[1] == fullest][-1])
            best, made = [made, capacity], made + 1
        out.append((best[0], capacity - best[1]))
        if best[1] > n:
            free.append([best[0], best[1] - n])
    return out


@pytest.mark.parametrize("most", [1, 3, 50])
def test_best_fit_by_definition(most):
    rng = np.random.default_rng(most)
    lengths = rng.integers(1, 65, 600).tolist()
    bins = packing.OpenBins(64, most)
    assert [bins.place(n) for n in lengths] == naive_best_fit(lengths, 64, most)
    assert bins.open <= most


def test_pieces_in_any_order_and_partition_share_sequences(spark):
    rng = np.random.default_rng(3)
    lengths = [*rng.integers(1100, 1301, 3000).tolist(), *rng.integers(700, 801, 3000).tolist()]
    for partitions in (1, 200):
        df = spark.createDataFrame(list(enumerate(lengths)), "doc_id long, length long").withColumn("piece", F.lit(0)).repartitionByRange(partitions, "doc_id")
        got = packing.place(df, 2048, 4096, 65_536).collect()
        sequences = defaultdict(list)
        for r in got:
            sequences[r["sequence_id"]].append((r["offset"], r["length"]))
        for parts in sequences.values():
            ends = np.cumsum([0, *(n for _, n in sorted(parts))])
            assert [o for o, _ in sorted(parts)] == ends[:-1].tolist() and ends[-1] <= 2048
        assert sum(map(len, sequences.values())) == len(lengths) and len(sequences) < 1.03 * 3000


def test_prefix_hash_spans_and_extensions():
    text = "abracadabra" * 20_000
    whole = prefix_hash.PrefixHash(prefix_hash.code_points(text))
    assert whole.span(0, 11) == whole.span(110_000, 110_011) != whole.span(1, 12)
    other = prefix_hash.PrefixHash(prefix_hash.code_points(text[:150_000] + "X" + text[150_001:]))
    assert whole.extension(0, other, 0) == 150_000
    assert whole.extension(11, other, 0) == 150_000
    assert whole.extension(len(text), other, 0) == 0


def test_fingerprints_and_edits(spark, odd_docs):
    got = prefix_hash.fingerprint_documents(odd_docs).collect()
    assert len(got) == len(ROWS)
    order = sorted(ROWS, key=lambda r: (r[0] is not None, r[0] or 0))
    successors = defaultdict(set)
    for k, (doc_id, text) in enumerate(order):
        successors[(doc_id, len(text))].update(sha(prefix_hash.edited(text, n[1])) for n in order[k + 1 : k + 3] + order[:1])
    for r in got:
        assert r["edited_sha256"] in successors[(r["doc_id"], r["n_chars"])]
        assert 0 <= r["near_next"] <= 1 and 0 <= r["near_edited"] <= 1
        if r["n_chars"] > 200:
            assert r["near_edited"] > r["near_next"] or r["near_next"] > 0.9
    by_text = defaultdict(set)
    texts = {(i, len(t)): t for i, t in ROWS}
    for r in got:
        by_text[texts[(r["doc_id"], r["n_chars"])]].add(r["fingerprint"])
    assert all(len(v) == 1 for v in by_text.values())


def naive_sketch(text: str) -> list[int]:
    """Span by span with Python's integers."""
    symbols = [1] * (prefix_hash.WIDTH - 1) + [ord(c) + 1 for c in text]
    least: dict[int, int] = {}
    for i in range(len(text)):
        span = symbols[i : i + prefix_hash.WIDTH]
        a, b = (sum(x * pow(base, j, m) for j, x in enumerate(span)) % m for base, m in zip(prefix_hash.BASES, prefix_hash.MODULI, strict=True))
        mixed = int(prefix_hash._mix(np.array([a << 32 ^ b], np.uint64))[0])
        row = mixed % prefix_hash.ROWS
        least[row] = min(least.get(row, 2**64), mixed >> 7)
    return [int(prefix_hash._mix(np.array([least[r]], np.uint64))[0]) % 65535 + 1 if r in least else 0 for r in range(prefix_hash.ROWS)]


def test_fingerprints_by_definition(spark, monkeypatch):
    import random

    rng = random.Random(8)
    texts = ["", "a", "abc", "x" * 40, "é\U0001f600" * 30] + ["".join(rng.choices("abcdefgh \n", k=rng.randrange(400))) for _ in range(40)]
    texts += [texts[9], texts[9] + "z", texts[9][:-1]]
    ids = [*rng.sample(range(1000), len(texts) - 1), None]
    df = spark.createDataFrame(list(zip(ids, texts, strict=True)), "doc_id long, text string").repartition(4)
    got = {r["doc_id"]: r for r in prefix_hash.fingerprint_documents(df).collect()}
    order = sorted(zip(ids, texts, strict=True), key=lambda r: -1 if r[0] is None else r[0])
    as_hex = lambda rows: b"".join(x.to_bytes(2, "big") for x in rows).hex()
    like = lambda a, b: sum(x == y != 0 for x, y in zip(a, b, strict=True)) / n if (n := sum(bool(x or y) for x, y in zip(a, b, strict=True))) else 1.0
    for (doc_id, text), (_, following) in zip(order, order[1:] + order[:1], strict=True):
        quarter = len(text) // 4
        changed = text[: len(text) - quarter] + following[:quarter]
        own, other, after = map(naive_sketch, (text, changed, following))
        r = got[doc_id]
        common = next((i for i, (x, y) in enumerate(zip(text, changed, strict=False)) if x != y), min(len(text), len(changed)))
        assert (r["n_chars"], r["edited_sha256"], r["fingerprint"], r["edited_fingerprint"], r["common_prefix"]) == (len(text), sha(changed), as_hex(own), as_hex(other), common)
        assert (r["near_edited"], r["near_next"]) == (like(own, other), like(own, after))


def test_long_texts_are_hashed_in_blocks(monkeypatch):
    text = "".join(map(chr, np.random.default_rng(1).integers(97, 123, 1000)))
    want = prefix_hash.Fingerprinted(text)
    changed = text[:750] + text[:250]
    want_edited = want.edited(changed)
    monkeypatch.setattr(prefix_hash, "BLOCK", 64)
    got = prefix_hash.Fingerprinted(text)
    assert (got.sketch == want.sketch).all() and got.sketch.tolist() == naive_sketch(text)
    assert (got.edited(changed)[0] == want_edited[0]).all() and got.edited(changed)[1] == want_edited[1] == 750


def test_prefix_hash_of_one_row(spark):
    one = spark.createDataFrame([(5, "abcdefgh")], "doc_id long, text string")
    r = prefix_hash.fingerprint_documents(one).collect()
    assert [x["edited_sha256"] for x in r] == [sha("abcdefab")]


@pytest.fixture
def no_adaptive_help(spark):
    """Sixteen shuffle partitions as they are: none split or merged at run time."""
    names = {"spark.sql.adaptive.skewJoin.enabled": "false", "spark.sql.adaptive.coalescePartitions.enabled": "false", "spark.sql.shuffle.partitions": "16"}
    before = {k: spark.conf.get(k) for k in names}
    for k, v in names.items():
        spark.conf.set(k, v)
    yield
    for k, v in before.items():
        spark.conf.set(k, v)


@pytest.mark.parametrize("how", ["inner", "left"])
def test_hot_keys_are_dealt_out(spark, no_adaptive_help, how):
    held = spark.range(60_000).select(F.when(F.col("id") % 3 == 0, 7).when(F.col("id") % 1000 == 1, None).otherwise(F.col("id") % 9000).alias("key"), F.concat(F.lit("text "), "id").alias("text"))
    per_key = common.materialise(held.groupBy("key").agg(F.count("*").alias("size"), F.max("text").alias("most")).filter("key is null or key % 5 <> 0"))
    found = common.join_dealt(held, per_key, ["key"], "size", how)
    assert found.columns == ["key", "text", "size", "most"]
    assert Counter(rows(found)) == Counter(rows(held.join(per_key, "key", how)))
    in_tasks = sorted(r["count"] for r in found.filter("key is not null").groupBy(F.spark_partition_id()).count().collect())
    assert len(in_tasks) == 16 and in_tasks[-1] <= 2 * in_tasks[7]
    # at most so many keys are broadcast, though each of them holds the same share
    even = common.materialise(spark.range(2000).select(F.col("id").alias("key"), F.lit(1).alias("size")))
    assert common.join_dealt(spark.range(2000).select(F.col("id").alias("key")), even, ["key"], "size").count() == 2000


def test_operators_with_a_hot_text_need_no_adaptive_split(spark, no_adaptive_help):
    hot = [(k, "the same text " * 10, "x") for k in range(300)]
    some = [(k, f"text {k % 590}", "y") for k in range(300, 900)]
    docs = spark.createDataFrame(hot + some, "doc_id long, text string, source string").repartition(5)
    last = {t: max(k for k, u, _ in hot + some if u == t) for t in {t for _, t, _ in hot + some}}
    assert {(r["doc_id"], r["text"]) for r in quotient_filter.keep_last(docs).collect()} == {(k, t) for t, k in last.items()}
    marked = quotient_filter.mark_duplicates(docs).collect()
    assert len(marked) == 900 and {r["doc_id"] for r in marked if r["kept"]} == set(last.values())
    assert all(r["group_size"] == (300 if r["doc_id"] < 300 else 1 + (r["doc_id"] - 300 < 10) + (r["doc_id"] >= 890)) for r in marked)


def test_exact_duplicates(odd_docs):
    groups = defaultdict(list)
    for doc_id, text in ROWS:
        groups[text].append(doc_id)
    want = Counter()
    for text, ids in groups.items():
        keep = max((i for i in ids if i is not None), default=None)
        first = True
        for i in ids:
            want[(i, keep, len(ids), i == keep and first, sha(text))] += 1
            first = first and i != keep
    assert Counter(rows(quotient_filter.mark_duplicates(odd_docs))) == want
    kept = quotient_filter.keep_last(odd_docs)
    assert kept.columns == odd_docs.columns
    assert sorted((r["text"] or "") for r in kept.collect()) == sorted(groups)


def naive_quotient_filter(counts: dict[int, int], bits: int) -> dict[int, tuple[int, int, int]]:
    """Slots by linear probing, one fingerprint after another: quotient, remainder and count of each slot in use."""
    slots: dict = {}
    at = -1
    for fp in sorted(counts):
        quotient, remainder = divmod(fp, 1 << (64 - bits))
        at = max(at + 1, quotient)
        slots[at] = (quotient, remainder, counts[fp])
    return slots


@pytest.mark.parametrize("n", [0, 1, 2, 500, 3000])
def test_quotient_filter_slots(n):
    rng = np.random.default_rng(n)
    drawn = rng.integers(0, 2**64, n, dtype=np.uint64)
    drawn[: n // 2] >>= np.uint64(9)  # many low quotients: long runs and clusters
    drawn = np.r_[drawn, drawn[: n // 3], np.repeat(drawn[:1], 700)]
    counts = Counter(drawn.tolist())
    f = quotient_filter.CountingQuotientFilter.of(drawn)
    slots = naive_quotient_filter(counts, f.bits)
    for at in range(len(f.counts)):
        quotient, remainder, count = slots.get(at, (None, None, None))
        before = slots.get(at - 1, (None,))[0]
        assert f.occupied[at] == any(q == at for q, _, _ in slots.values())
        assert f.continued[at] == (quotient is not None and quotient == before) and f.shifted[at] == (quotient is not None and quotient != at)
        if quotient is not None:
            assert int.from_bytes(f.remainders[at].tobytes(), "little") == remainder and f.counts[at] == min(count, 255)
    g = quotient_filter.CountingQuotientFilter.from_bytes(f.to_bytes())
    held, held_counts = g.contents()
    assert dict(zip(held.tolist(), held_counts.tolist(), strict=True)) == counts and (np.diff(held.astype(object)) > 0).all()
    assert all(g.count(x) == c for x, c in counts.items()) and g.count(12345) == counts[12345]
    assert len(f.to_bytes()) < 20 * len(counts) + 100


def test_quotient_filters_merge_without_loss():
    rng = np.random.default_rng(3)
    parts = [rng.integers(0, 2**64, 500 * k, dtype=np.uint64) for k in range(4)]
    parts[1][:100] = parts[2][:100]
    parts[3][:307] = 0
    cqf = quotient_filter.CountingQuotientFilter
    want = Counter(np.concatenate(parts).tolist())
    merged = cqf.merged([cqf.of(p) for p in parts])
    whole, counts = merged.contents()
    assert dict(zip(whole.tolist(), counts.tolist(), strict=True)) == want
    # in ranges, and these in ranges again, nothing is lost either
    found = Counter()
    for a, outer in merged.ranges():
        for b, inner in cqf.from_bytes(outer.to_bytes()).ranges():
            own, n = inner.contents()
            found.update(dict(zip([(a << 58 | b << 52) + x for x in own.tolist()], n.tolist(), strict=True)))
    assert found == want


@pytest.mark.parametrize("parts", [1, 3, 70])
def test_filters_of_many_partitions(spark, parts):
    rng = np.random.default_rng(parts)
    fps = rng.integers(-(2**63), 2**63, 400)
    fps = np.r_[fps, fps[:150], fps[:20], np.repeat(fps[-1:], 300), [-1, -1, 0, 0, 0, 5]]
    df = spark.createDataFrame([(int(x),) for x in fps], "fp long").repartition(parts)
    got = {r["fp"]: r["n"] for r in quotient_filter.counted_fingerprints(df).collect()}
    assert got == {x: n for x, n in Counter(fps.tolist()).items() if n > 1}


def naive_fingerprint(text: str) -> int:
    words = re.findall(rb"[^\x20\x09-\x0D]+", re.sub(rb"[A-Z]", lambda m: m[0].lower(), text.encode()))
    shingles = [b" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))] if words else []
    ones = Counter(b for s in shingles for h in [xxhash.xxh64_intdigest(s, 42)] for b in range(64) if h >> b & 1)
    return sum(1 << b for b in range(64) if 2 * ones[b] > len(shingles))


def components(prints: list[int], labels: list) -> list:
    """Smallest label that each row reaches, by comparing every pair."""
    parent = list(range(len(prints)))

    def root(x: int) -> int:
        while parent[x] != x:
            x = parent[x]
        return x

    for i, a in enumerate(prints):
        for j in range(i):
            if (a ^ prints[j]).bit_count() <= 3:
                parent[root(i)] = root(j)
    least: dict = {}
    for i, label in enumerate(labels):
        if label is not None:
            least[root(i)] = min(least.get(root(i), label), label)
    return [least.get(root(i)) for i in range(len(prints))]


def test_simhash(odd_docs):
    prints = [naive_fingerprint(t) for _, t in ROWS]
    found = components(prints, [i for i, _ in ROWS])
    want = Counter((i, f"{p:016x}", c) for (i, _), p, c in zip(ROWS, prints, found, strict=True))
    assert Counter(rows(simhash.near_duplicates(odd_docs))) == want


def shingles(text: str) -> set:
    words = re.findall(rb"[^\x20\x09-\x0D]+", re.sub(rb"[A-Z]", lambda m: m[0].lower(), text.encode()))
    return {b" ".join(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def smallest_of_copies(rows: list[tuple]) -> set:
    """The smallest doc_id of each group of texts that are equal or share 0.8 of their five-word shingles."""
    sets = [shingles(t) for _, t in rows]
    parent = list(range(len(rows)))

    def root(x: int) -> int:
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if rows[i][1] == rows[j][1] or both and both >= 0.8 * len(sets[i] | sets[j]):
                parent[root(i)] = root(j)
    groups = defaultdict(list)
    for i, (doc_id, _) in enumerate(rows):
        groups[root(i)].append(doc_id)
    return {min((x for x in g if x is not None), default=None) for g in groups.values()}


def test_near_copies_of_stated_similarity(odd_docs):
    kept = simhash.keep_first(odd_docs)
    assert kept.columns == odd_docs.columns
    assert {r["doc_id"] for r in kept.collect()} == smallest_of_copies(ROWS)


def edits(n: int, texts: int, most: int) -> list[tuple]:
    """A family: texts of `n` words of which up to `most` were changed, so that some are 0.8 alike and others are not."""
    rng = np.random.default_rng(n)
    base = [f"w{k}" for k in range(n)]
    made = set()
    while len(made) < texts:
        words = list(base)
        for k in rng.integers(0, n, rng.integers(0, most)).tolist():
            words[k] = f"x{rng.integers(0, 3)}"
        made.add(" ".join(words))
    return list(enumerate(sorted(made)))


@pytest.mark.parametrize("chunk", [2048, 60])
def test_no_link_is_lost_within_a_family(spark, monkeypatch, chunk):
    monkeypatch.setattr(simhash, "CHUNK", chunk)
    rows = edits(150, 200, 25) + [(1000 + i, t) for i, t in edits(40, 100, 8)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    want = smallest_of_copies(rows)
    assert 20 < len(want) < 280
    assert {r["doc_id"] for r in simhash.keep_first(df).collect()} == want


def test_repeated_lines_and_short_texts_are_copies(spark):
    rng = np.random.default_rng(11)
    word = lambda: f"w{rng.integers(0, 10**9)}"
    rows = []
    for k in range(20):
        line, rest = " ".join(word() for _ in range(20)), " ".join(word() for _ in range(200))
        rows += [(2 * k, f"{line} {rest}"), (2 * k + 1, f"{line} " * 60 + rest)]
    for k in range(20, 1020):
        words = [word() for _ in range(9)]
        rows += [(2 * k, " ".join(words[:8])), (2 * k + 1, " ".join(words))]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert {r["doc_id"] for r in simhash.keep_first(df).collect()} == {2 * k for k in range(1020)}


@pytest.mark.parametrize("shared,apart", [(4, 0), (40, 5), (160, 20)])
def test_bands_miss_no_pair_of_stated_similarity(shared, apart):
    rng = np.random.default_rng(shared)
    missed = 0
    for _ in range(5000):
        hashes = rng.integers(0, 2**64, shared + max(2 * apart, 1), dtype=np.uint64)
        left, right = hashes[: shared + apart], np.r_[hashes[:shared], hashes[shared + apart :]]
        missed += not any(a == b for a, b in zip(simhash.band_keys(left), simhash.band_keys(right), strict=True))
    assert missed == 0


@pytest.mark.parametrize("radius", [3, 15, 20])
def test_bit_sliced_distances(radius):
    rng = np.random.default_rng(radius)
    prints = rng.integers(0, 2**64, 200, dtype=np.uint64) & rng.integers(0, 2**64, 200, dtype=np.uint64)
    over = simhash.beyond(simhash._spread(prints), simhash.planes(prints)[:, None, :], list(range(64)), radius)
    bits = np.unpackbits(over.view(np.uint8), axis=1, bitorder="little")[:, :200]
    assert (bits == (np.bitwise_count(prints[:, None] ^ prints) > radius)).all()


@pytest.mark.parametrize("n", [2, 17, 300, 2500])
def test_simhash_links_join_every_group(spark, n):
    rng = np.random.default_rng(n)
    centres = rng.integers(0, 2**64, 5, dtype=np.uint64)
    flips = np.uint64(1) << rng.integers(0, 64, (n, 2)).astype(np.uint64)
    prints = np.unique(centres[rng.integers(0, 5, n)] ^ flips[:, 0] ^ flips[:, 1])
    df = spark.createDataFrame([(int(x),) for x in prints.view(np.int64)], "fp long")
    roots = {r["node"]: r["root"] for r in simhash.join_groups(simhash.bucket_links(df)).collect()}
    if n > 300:
        centre = {int(x): int(np.bitwise_count(centres ^ x).argmin()) for x in prints}
        groups = defaultdict(set)
        for x in prints:
            groups[centre[int(x)]].add(roots.get(int(x.view(np.int64)), int(x.view(np.int64))))
        assert all(len(g) == 1 for g in groups.values())
    else:
        signed = prints.view(np.int64).tolist()
        want = components([int(x) for x in prints], signed)
        assert [roots.get(x, x) for x in signed] == want


PATTERNS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def base_spans(text: str) -> list[str]:
    def luhn(s: str) -> bool:
        doubled = (int(c) * (1 + k % 2) for k, c in enumerate(reversed(s)))
        return sum(x - 9 if x > 9 else x for x in doubled) % 10 == 0

    def passes(kind: str, value: str) -> bool:
        digits = re.sub("[^0-9]", "", value)
        if kind == "ip":
            return all(int(p) <= 255 for p in value.split("."))
        if kind == "card":
            return 13 <= len(digits) <= 19 and luhn(digits)
        return kind == "email" or 9 <= len(digits) <= 15

    return [f"{k}:{m.start()}:{m.end()}" for k, p in PATTERNS.items() for m in re.finditer(p, text) if passes(k, m[0])]


def test_personal_data(odd_docs):
    got = disclosure.find_personal_data(odd_docs).collect()
    spans = [base_spans(t) for _, t in ROWS]
    want = Counter((i, *(sum(x.startswith(k + ":") for x in s) for k in PATTERNS), sha(",".join(s))) for (i, _), s in zip(ROWS, spans, strict=True))
    assert Counter(tuple(r)[:6] for r in got) == want
    assert sum(map(len, spans)) >= 6


def test_patterns_are_scanned_in_linear_time(spark):
    long = ["a" * 60_000, "1" * 60_000, "1." * 30_000, "a." * 30_000 + "@", "1 " * 30_000, "+1" * 30_000]
    df = spark.createDataFrame(list(enumerate(long)), "doc_id long, text string")
    got = {r["doc_id"]: r["base_sha256"] for r in disclosure.find_personal_data(df).collect()}
    assert got[0] == got[1] == sha("")


def disclosing_by_definition(texts: list[str], guess: float, prior: float) -> list[set[tuple[int, int, str]]]:
    """For each text the spans of terms to mask and their masks: counted pair by pair."""
    bare, entities = [], []
    for t in texts:
        found = base_spans(t)
        blank = list(t)
        for span in found:
            _, a, b = span.split(":")
            blank[int(a) : int(b)] = " " * (int(b) - int(a))
        bare.append("".join(blank))
        entities.append({f"{k}:{t[int(a):int(b)].lower()}" for k, a, b in (x.split(":") for x in found)})
    term = regex.compile(r"(?:(?![\p{Han}\p{Hiragana}\p{Thai}])[\p{L}\p{N}]\p{M}*)+|[\p{Han}\p{Hiragana}\p{Thai}]\p{M}*")
    words = lambda t: {w.lower() for w in term.findall(t)}
    wider = lambda w: w[: min(3, len(w) - 1)] + "*"
    terms = lambda t: words(t) | {wider(w) for w in words(t)}
    counted = [k for k, t in enumerate(texts) if not entities[k] or texts.index(t) == k]
    inside = {k: terms(bare[k] if entities[k] else texts[k]) for k in counted}
    # words inside personal data count in how often a term occurs, not in what stands beside an entity
    n_term = Counter(t for k in counted for t in terms(texts[k]))
    n_entity = Counter(e for k in counted for e in entities[k])
    n_both = Counter((t, e) for k in counted for t in inside[k] for e in entities[k])
    out = []
    for k, t in enumerate(texts):
        def tells(term: str, k: int = k) -> bool:
            for e in entities[k]:
                chance = n_entity[e] / len(counted)
                p = (n_both[term, e] + prior * chance) / (n_term[term] + prior)
                if p >= guess and p >= 2 * chance:
                    return True
            return False

        found = [(m.start(), m.end(), m[0].lower()) for m in term.finditer(bare[k])]
        out.append({(a, b, "" if tells(wider(w)) else wider(w)) for a, b, w in found if tells(w)})
    return out


def test_terms_that_disclose_an_entity_by_definition(spark):
    import random

    rng = random.Random(5)
    names = [f"p{k}@mail.example.com" for k in range(6)]
    secret = {n: [f"{'Quv' if k % 2 else 'Zor'}{c}lin{'xyzuvw'[k]}" for c in "abc"] for k, n in enumerate(names)}
    # short names, numbers, and names in a script without spaces
    for n, more in zip(names, (["Li", "李小龙"], ["Bo", "47b"], ["9081"], ["Ü"], ["ไทยา", "x"], ["नाम", "Nguyễn"]), strict=True):
        secret[n] += more
    common = ["River", "stone", "rivet", "quart", "Zone", "mail", "example", "stony", "ʼnaïve", "größe"]
    texts = []
    for k in range(150):
        said = rng.choices(common, k=6)
        if k % 3 == 0:
            name = rng.choice(names)
            said += [name, *rng.sample(secret[name], 3)] + ([rng.choice(names), "10.0.0.7"] if k % 9 == 0 else [])
        rng.shuffle(said)
        texts.append(" ".join(said))
    texts += [texts[0]] * 4 + [texts[1]] * 3 + [f"{w} alone" for w in secret[names[0]]]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(5)
    for guess, prior in ((0.5, 2.0), (0.8, 0.5)):
        want = disclosing_by_definition(texts, guess, prior)
        assert 20 < sum(map(len, want)) < 400
        told = {t[a:b] for t, spans in zip(texts, want, strict=True) for a, b, _ in spans}
        assert {"Li", "Bo", "李", "47b", "9081", "Ü", "ไ", "नाम", "Nguyễn"} - told == set() or guess > 0.5
        got = {r["doc_id"]: r["spans"] for r in disclosure.find_personal_data(df, guess, prior).collect()}
        assert {k: {x for x in v.split(",") if x.startswith("term")} for k, v in got.items()} == {k: {f"term:{a}:{b}" for a, b, _ in x} for k, x in enumerate(want)}
        clean = {r["doc_id"]: r["text"] for r in disclosure.sanitise(df, guess, prior).collect()}
        for k, t in enumerate(texts):
            masks = want[k] | {(int(a), int(b), f"[{kind.upper()}]") for kind, a, b in (x.split(":") for x in base_spans(t))}
            for a, b, mask in sorted(masks, reverse=True):
                t = t[:a] + mask + t[b:]
            assert clean[k] == t


def test_sums_and_masks_of_long_arrays(spark):
    import itertools
    import random

    rng = random.Random(3)
    for n in (0, 1, 127, 128, 129, 600):
        values = [rng.randrange(9) for _ in range(n)]
        text = "".join(rng.choice("abé\U0001f600 ") for _ in range(3 * n + 5))
        masks = sorted((a := rng.randrange(len(text)), min(len(text), a + rng.randrange(1, 6)), f"[{k}]") for k in range(n))
        at, want, blank = 0, [], list(text)
        for a, b, mask in masks:
            blank[a:b] = " " * (b - a)
            if a >= at:
                want += [text[at:a], mask]
            at = max(at, b)
        df = spark.createDataFrame([(values, text, masks)], "v array<int>, t string, m array<struct<start:int,end:int,mask:string>>")
        sums, largest = disclosure.running(F.col("v"), lambda x, y: x + y), disclosure.running(F.col("v"), F.greatest)
        got = df.select(sums, largest, disclosure.masked(F.col("t"), F.col("m")), disclosure.masked(F.col("t"), F.col("m"), blank=True)).first()
        assert list(got) == [list(itertools.accumulate(values)), list(itertools.accumulate(values, max)), "".join([*want, text[at:]]), "".join(blank)]


def test_sanitised_columns_and_clean_rows(odd_docs):
    out = disclosure.sanitise(odd_docs)
    assert out.columns == odd_docs.columns
    assert out.count() == odd_docs.count()
    want = Counter(t for _, t in ROWS if not base_spans(t))
    got = Counter(r["text"] or "" for r in out.collect())
    assert all(got[t] >= n for t, n in want.items())


LANGUAGES = {"en": "the quick brown fox and the other dogs were running over there with their friends", "de": "der schnelle braune fuchs und die anderen hunde liefen dort mit ihren freunden ueber", "fr": "le renard brun rapide et les autres chiens couraient avec leurs amis vers la riviere"}


def test_language_of_held_out_texts(spark):
    import random

    rng = random.Random(1)
    made = []
    for k in range(240):
        lang = ("en", "de", "fr")[k % 3]
        words = LANGUAGES[lang].split()
        made.append((k, " ".join(rng.choice(words) for _ in range(12)), lang))
    made += [(900, None, "en"), (901, "123 ...", "de"), (902, "", None), (903, "½ ² Ⅷ ① 5_", None), (904, "½ ª", None), (None, made[0][1], None)]
    df = spark.createDataFrame(made, "doc_id long, text string, lang string")
    got = {r["doc_id"]: r for r in ppm_language.predict_languages(df).collect()}
    truth = {k: lang for k, _, lang in made[:240]}
    held = [k for k in truth if got[k]["held_out"]]
    assert held and all(got[k]["held_out"] == (zlib.crc32(str(k).encode()) % 4 == 2) for k in truth)
    assert sum(got[k]["lang_pred"] == truth[k] for k in held) / len(held) > 0.95
    assert [got[k]["lang_pred"] for k in (900, 901, 902, 903)] == ["und"] * 4
    assert got[904]["lang_pred"] != "und"  # an ordinal indicator is a letter
    assert not got[None]["held_out"] and got[None]["lang_pred"] == "en"
    assert all(0 <= r["score"] <= 1 for r in got.values())
    kept = ppm_language.keep_identified(df)
    assert kept.columns == df.columns and kept.count() == 242


def test_languages_are_learned_from_whole_texts(spark):
    long = "x" * 50_000 + " quux quux"
    df = spark.createDataFrame([(k, long + str(k), "xx") for k in range(4)] + [(9, "abc", "yy"), (10, "abd", "yy"), (11, "abe", "yy")], "doc_id long, text string, lang string").repartition(3)
    trees = ppm_language.learn(df)
    known = [k for k in range(4) if zlib.crc32(str(k).encode()) % 4 != 2]
    want = Counter(g for k in known for g in ppm_language.grams(long + str(k)).tolist())
    assert trees.languages == ["xx", "yy"] and len(want)
    assert np.isin(np.unique(ppm_language.grams(long)), trees.known[3]).all()
    assert trees.predict("quux")[0] == "xx"


def test_code_lengths_equal_a_slow_coder():
    counted = {x: np.unique(ppm_language.grams(LANGUAGES[x]), return_counts=True) for x in ("en", "de")}
    trees = ppm_language.ContextTrees(counted)
    counts: dict = defaultdict(Counter)
    data = b"   " + LANGUAGES["en"].encode()
    for i in range(3, len(data)):
        for k in range(4):
            counts[data[i - k : i]][data[i]] += 1
    text = b"   the foxes were zz running"
    bits = 0.0
    for i in range(3, len(text)):
        for k in range(3, -2, -1):
            if k < 0:
                bits += 8
                break
            seen = counts.get(text[i - k : i])
            if not seen:
                continue
            n, d = sum(seen.values()), len(seen)
            if text[i] in seen:
                bits += np.log2((n + d) / seen[text[i]])
                break
            bits += np.log2((n + d) / d)
    assert trees.code_lengths(text[3:].decode())[trees.languages.index("en")] == pytest.approx(bits)


def test_nothing_gives_nothing(no_docs):
    for df in (
        bpe.encode_documents(no_docs, VOCABULARY), packing.pack(no_docs, VOCABULARY), prefix_hash.fingerprint_documents(no_docs), quotient_filter.mark_duplicates(no_docs),
        quotient_filter.keep_last(no_docs), simhash.near_duplicates(no_docs), simhash.keep_first(no_docs), disclosure.find_personal_data(no_docs), disclosure.sanitise(no_docs),
        ppm_language.predict_languages(no_docs), ppm_language.keep_identified(no_docs),
    ):
        assert df.count() == 0
