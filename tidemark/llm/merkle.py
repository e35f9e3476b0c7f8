"""A Merkle manifest of a dataset, written as logs of nodes in postorder, with a proof for every row.

Leaves of a group lie in order and every eight nodes become their parent's digest, the last run fewer, until one is
left. All leaves are equally deep, so a node is a level and an index, and where it stands in the postorder of its tree
follows from the sizes of the subtrees before it (`position`). Builders take aligned blocks of 8^k leaves, of which
none needs another, and append each node as soon as it is complete; the blocks' tops are the leaves of the next round,
so a group of n leaves takes log n / log 8^k rounds. Proofs go the other way: a builder's log, cut out by its block, is
met by the one path from its top to the root, and the siblings of each of its leaves are read at their positions.

No task holds more than a block, and no group is one task: rows are numbered by a range sort and the counts of its
partitions. Documents are hashed once, by Spark's own functions; only digests of 32 bytes are shuffled.

Defined cases: nulls have a form of their own in a leaf (`-`), and a null lang is a group that stands before all others;
rows with equal doc_id (or none, they come first) lie in the order of their digests; repeated rows are leaves each; a
row without doc_id is never tampered with; other columns are not read; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.common import materialise

WAYS, BLOCK_LEVELS = 8, 4
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
_CAPITALS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def combine(digests: Sequence[bytes]) -> bytes:
    """The parent of a run of digests: SHA-256 of their hexadecimal text, one after the other."""
    return hashlib.sha256("".join(d.hex() for d in digests).encode()).digest()


def height(leaves: int) -> int:
    """How many levels stand above `leaves` leaves."""
    levels = 0
    while leaves > 1:
        leaves, levels = -(-leaves // WAYS), levels + 1
    return levels


def position(level: int, index: int, leaves: int) -> int:
    """Where a node stands in the postorder of a tree of `leaves` leaves.

    Before a node whose subtree is whole stand all whole subtrees of the leaves before its last one, and its own levels
    below. The nodes at the right edge that are not whole come after all whole ones, from the lowest up.
    """
    levels = height(leaves)
    end = (index + 1) * WAYS**level
    if end <= leaves:
        return sum((end - 1) // WAYS**m for m in range(levels + 1)) + level
    lowest = next(m for m in range(levels + 1) if leaves % WAYS**m)
    return sum(leaves // WAYS**m for m in range(levels + 1)) + level - lowest


def postorder(leaves: Sequence[bytes], levels: int) -> list[tuple[int, int, bytes]]:
    """Nodes `(level, index, digest)` of a block up to `levels`, each as soon as it is complete."""
    log: list[tuple[int, int, bytes]] = []
    waiting: list[list[bytes]] = [[] for _ in range(levels + 1)]
    made = [0] * (levels + 1)

    def add(level: int, digest: bytes) -> None:
        log.append((level, made[level], digest))
        made[level] += 1
        waiting[level].append(digest)
        if level < levels and len(waiting[level]) == WAYS:
            close(level)

    def close(level: int) -> None:
        run, waiting[level] = waiting[level], []
        add(level + 1, combine(run))

    for leaf in leaves:
        add(0, leaf)
    for level in range(levels):
        if waiting[level]:
            close(level)
    return log


def runs(log: Sequence[bytes], leaves: int, levels: int) -> list[list[list[bytes]]]:
    """For each level below the top of a block its runs of siblings, read from the log at their positions."""
    out = []
    for level in range(levels):
        n = -(-leaves // WAYS**level)
        nodes = [log[position(level, i, leaves)] for i in range(n)] if level < height(leaves) else [log[-1 - (levels - level)]]
        out.append([nodes[a : a + WAYS] for a in range(0, n, WAYS)])
    return out


def siblings(runs_of: list[list[list[bytes]]], leaf: int) -> list[tuple[int, list[bytes]]]:
    """For each level of a block: the place of the leaf's ancestor in its run, and the run's others."""
    path = []
    for level, of in enumerate(runs_of):
        run, at = of[leaf // WAYS ** (level + 1)], leaf // WAYS**level % WAYS
        path.append((at, [*run[:at], *run[at + 1 :]]))
    return path


def fold(digest: bytes, path: Sequence[tuple[int, list[bytes]]]) -> bytes:
    """The root that a leaf and its siblings give."""
    for at, others in path:
        digest = combine([*others[:at], digest, *others[at:]])
    return digest


def pack(path: Sequence[tuple[int, list[bytes]]]) -> bytes:
    """A path as bytes: for each level the place, the number of siblings, the siblings."""
    return b"".join(bytes([at, len(others)]) + b"".join(others) for at, others in path)


def unpack(data: bytes) -> list[tuple[int, list[bytes]]]:
    """What `pack` was given."""
    path, k = [], 0
    while k < len(data):
        at, n = data[k], data[k + 1]
        path.append((at, [data[k + 2 + 32 * i : k + 34 + 32 * i] for i in range(n)]))
        k += 2 + 32 * n
    return path


def leaf_digest(columns: dict[str, Column]) -> Column:
    """SHA-256 of a row's fields, 32 bytes."""
    said = [c.cast("string") for c in columns.values()]
    return F.unhex(F.sha2(F.concat(*[F.when(c.isNull(), F.lit("-")).otherwise(F.concat(F.octet_length(c).cast("string"), F.lit(":"), c)) for c in said]), 256))


def numbered(rows: DataFrame, group: str, order: Sequence[str]) -> DataFrame:
    """`rows` with `index`, their place in their group from 0, and `leaves`, the group's size; no group is sorted by one task."""
    placed = materialise(rows.repartitionByRange(group, *order).sortWithinPartitions(group, *order).withColumn("at", F.monotonically_increasing_id()))
    part = F.shiftright("at", 33)  # the number of the range
    counts = placed.groupBy(group, part.alias("range")).agg(F.count("*").alias("n"), F.min("at").alias("first"))
    before = Window.partitionBy(group).orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.withColumn("start", F.coalesce(F.sum("n").over(before), F.lit(0))).withColumn("leaves", F.sum("n").over(Window.partitionBy(group)))
    return placed.withColumn("range", part).join(starts, [group, "range"]).withColumn("index", F.col("at") - F.col("first") + F.col("start")).drop("at", "first", "start", "n", "range")


def _build(levels: int, keep: Sequence[str]):
    """A builder: the log of one block, in order; its leaves keep the columns `keep`."""

    def build(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("index", ignore_index=True)
        top = min(levels, height(int(rows["leaves"].iloc[0])))
        log = postorder(list(rows["digest"]), top)
        leaf = [i if level == 0 else -1 for level, i, _ in log]
        out = {k: [rows[k].iloc[0]] * len(log) for k in ("tree", "block", "leaves")}
        out |= {"place": range(len(log)), "level": [n[0] for n in log], "index": [n[1] for n in log], "digest": [n[2] for n in log], "top": [n[0] == top for n in log]}
        for k in keep:
            values = list(rows[k])
            out[k] = [None if i < 0 or values[i] is None or values[i] is pd.NA else values[i] for i in leaf]
        return pd.DataFrame(out).astype({"index": "int64", "place": "int64"})

    return build


def build_logs(leaves: DataFrame, keep: dict[str, str], levels: int = BLOCK_LEVELS) -> list[DataFrame]:
    """One written log for each round, from the leaves (`tree, index, leaves, digest` and the columns `keep`) up."""
    size = WAYS**levels
    logs: list[DataFrame] = []
    most = leaves.agg(F.max("leaves")).first()[0] or 0
    extra = keep
    while True:
        schema = "tree string, block long, leaves long, place long, level int, index long, digest binary, top boolean" + "".join(f", {k} {t}" for k, t in extra.items())
        blocks = leaves.withColumn("block", F.expr(f"index DIV {size}"))
        logs.append(materialise(blocks.groupBy("tree", "block").applyInPandas(_build(levels, list(extra)), schema)))
        if most <= size:
            return logs
        # tops of blocks are the next round's leaves; a tree that is done goes no further
        tops = logs[-1].filter(f"top AND leaves > {size}")
        leaves = tops.select("tree", F.col("block").alias("index"), F.expr(f"(leaves + {size - 1}) DIV {size}").alias("leaves"), "digest")
        most, extra = -(-most // size), {}


def roots(logs: Sequence[DataFrame], levels: int = BLOCK_LEVELS) -> DataFrame:
    """`tree, root` of all trees."""
    size = WAYS**levels
    found = [log.filter(f"top AND leaves <= {size}").select("tree", F.col("digest").alias("root")) for log in logs]
    out = found[0]
    for more in found[1:]:
        out = out.unionByName(more)
    return out


def _paths(levels: int, finish, columns: Sequence[str]):
    """Read the siblings of each leaf of a block out of its log; `above` has the path from the block's top on."""

    def extract(log: pd.DataFrame, above: pd.DataFrame) -> pd.DataFrame:
        if not len(log):
            return pd.DataFrame(columns=columns)
        log = log.sort_values("place", ignore_index=True)
        digests, leaves = list(log["digest"]), int((log["level"] == 0).sum())
        top, upper = int(log["level"].max()), unpack(above["path"].iloc[0])
        of, own = runs(digests, leaves, top), log[log["level"] == 0]
        return pd.DataFrame([finish(leaf, siblings(of, i) + upper, above) for i, leaf in enumerate(own.itertuples(index=False))], columns=columns)

    return extract


def _path_only(leaf, path, above) -> tuple:
    return leaf.tree, leaf.block, leaf.index, pack(path)


def extract_paths(logs: Sequence[DataFrame], above: DataFrame, finish, schema: str, levels: int = BLOCK_LEVELS) -> DataFrame:
    """`finish` for each leaf of the lowest log, given `above` (`tree, path` and what else it needs) for each tree's root."""
    size = WAYS**levels
    tall = None  # paths for the tops of the blocks of the round below
    for k in range(len(logs) - 1, -1, -1):
        done = logs[k].filter(f"leaves <= {size} AND top").select("tree", "block")
        start = done.join(above, "tree")
        if tall is not None:
            start = start.unionByName(tall.join(above.drop("path"), "tree"))
        start = start.toDF(*start.columns)  # columns of their own: both sides come from the log
        if k:
            step = logs[k].groupBy("tree", "block").cogroup(start.groupBy("tree", "block")).applyInPandas(
                _paths(levels, _path_only, ["tree", "block", "index", "path"]), "tree string, block long, index long, path binary")
            tall = materialise(step.select("tree", (F.col("block") * size + F.col("index")).alias("block"), "path"))
    names = [f.split()[0] for f in schema.split(", ")]
    return logs[0].groupBy("tree", "block").cogroup(start.groupBy("tree", "block")).applyInPandas(_paths(levels, finish, names), schema)


def _proof(leaf, path, above) -> tuple:
    said = hashlib.sha256("".join(d.hex() for _, others in path for d in others).encode()).hexdigest()
    root = above["root"].iloc[0].hex()
    folded = fold(leaf.digest if leaf.altered is None else leaf.altered, path).hex()
    return leaf.doc_id, leaf.digest.hex(), above["subroot"].iloc[0].hex(), root, said, folded, folded == root


def prove(docs: DataFrame, levels: int = BLOCK_LEVELS) -> DataFrame:
    """For each row of `docs` (`doc_id, source, lang, n_chars, text`) its leaf, its group's root, the root, the digest of its
    proof, and the root that follows from the row as it is or, where 3 divides the crc32 of its doc_id, tampered with."""
    fields = {f: F.col(f) for f in FIELDS}
    tampered = fields | {"text": F.translate("text", _CAPITALS, _CAPITALS.lower())}
    chosen = F.crc32(F.col("doc_id").cast("string")) % 3 == 0
    # a group's name: nulls as the empty string, which is before all others
    tree = F.coalesce(F.concat(F.lit("="), "lang"), F.lit(""))
    hashed = docs.select(tree.alias("tree"), F.col("doc_id").cast("long").alias("doc_id"), leaf_digest(fields).alias("digest"), F.when(chosen, leaf_digest(tampered)).alias("altered"))
    leaves = numbered(materialise(hashed), "tree", ["doc_id", "digest"]).withColumn("doc_id", F.col("doc_id").cast("string"))  # pandas has no null integers
    logs = build_logs(leaves, {"doc_id": "string", "altered": "binary"}, levels)
    tops = materialise(roots(logs, levels))
    one = numbered(tops.select(F.lit("").alias("tree"), F.col("tree").alias("name"), F.col("root").alias("digest")), "tree", ["name"])
    upper = build_logs(one, {"name": "string"}, levels)
    root = roots(upper, levels).withColumn("path", F.lit(b""))
    found = extract_paths(upper, root, _group_path, "tree string, path binary, subroot binary, root binary", levels)
    schema = "doc_id string, leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean"
    return extract_paths(logs, materialise(found), _proof, schema, levels).withColumn("doc_id", F.col("doc_id").cast("long"))


def _group_path(leaf, path, above) -> tuple:
    return leaf.name, pack(path), leaf.digest, above["root"].iloc[0]
