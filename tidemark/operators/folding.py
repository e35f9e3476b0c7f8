"""Ordered folds with a small state: rows of a key in order, read batch by batch, so that no key has to fit a worker."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame


def fold_sorted(df: DataFrame, keys: list[str], order: list[str], start: Callable[[tuple], object], schema: str) -> DataFrame:
    """Rows that folds give. `start(key)` makes a key's fold: `step(row)` for each row (a dict without the keys) and `finish()` give lists of tuples.

    Keys are dealt out by hash and sorted once. A task holds one batch and one state; keys run in parallel, so put
    folds, strategies and parameters into the key.
    """
    names = [f.split()[0] for f in schema.split(", ")]
    columns = [*keys, *[c for c in df.columns if c not in keys]]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key = fold = None
        for batch in batches:
            out: list[tuple] = []
            for row in zip(*(batch[c].tolist() for c in columns), strict=True):
                now = tuple(None if k is None or k != k else k for k in row[: len(keys)])  # a null key is a key
                if now != key or fold is None:
                    if fold is not None:
                        out += [(*key, *r) for r in fold.finish()]
                    key, fold = now, start(now)
                out += [(*key, *r) for r in fold.step(dict(zip(columns, row, strict=True)))]
            if out:
                yield pd.DataFrame(out, columns=names)
        if fold is not None and (out := [(*key, *r) for r in fold.finish()]):
            yield pd.DataFrame(out, columns=names)

    return df.select(*columns).repartition(*keys).sortWithinPartitions(*keys, *order).mapInPandas(run, schema)
