"""Helpers shared by the text operators."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.storage import materialise

__all__ = ["batch_rows", "documents", "join_dealt", "map_arrow", "materialise", "or_empty", "table"]

#: Rows and bytes in an Arrow batch sent to Python: a bound on what one task holds, since texts may be long.
ROWS_PER_BATCH, BYTES_PER_BATCH = 500, "32m"


def batch_rows(spark: SparkSession) -> None:
    """Keep Arrow batches small, so that a task's memory follows a few long texts, not ten thousand.

    Both are settings of the session and stay so: the plan is made only when the caller runs it.
    """
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(ROWS_PER_BATCH))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", BYTES_PER_BATCH)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The Parquet table `name` below `sf_dir`, by whatever store Spark can read."""
    batch_rows(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """`doc_id` and `text` of all documents; a null text counts as empty."""
    return table(spark, sf_dir, "documents").select("doc_id", or_empty("text").alias("text"))


def or_empty(name: str) -> Column:
    """The text column `name` with null as the empty text."""
    return F.coalesce(F.col(name), F.lit(""))


def map_arrow(
    df: DataFrame,
    columns: Sequence[str],
    work: Callable[[Iterator[list]], Iterator[dict[str, list]]],
    schema: str,
) -> DataFrame:
    """Run `work` once per partition: it gets, per batch, the lists of `columns`, and yields dicts of lists."""
    fields = T.StructType.fromDDL(schema)
    arrow = pa.schema([(f.name, _ARROW[type(f.dataType)]) for f in fields])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lists = ([c.to_pylist() for c in b.columns] for b in batches)
        for out in work(lists):
            yield pa.RecordBatch.from_arrays([pa.array(out[f.name], f.type) for f in arrow], schema=arrow)

    return df.select(*columns).mapInArrow(run, fields)


def join_dealt(rows: DataFrame, per_key: DataFrame, keys: Sequence[str], size: str, how: str = "inner") -> DataFrame:
    """`rows` joined on `keys` with `per_key`, a written table of one row a key, by sorting; no task gets a hot key as a whole.

    `size` names the column of `per_key` that counts a key's rows, about. A key is hot if it has more than a `SHARES`-th of
    all that are counted for each shuffle partition: at most `SHARES` keys a partition are, whatever the tables' size, so
    they are broadcast; their rows are dealt out by their values, and meet as many copies of the key's row. Rows
    with a null key meet nothing and keep their place. The plan is the same at every size.
    """
    partitions = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    # one number comes to the driver
    share = max(1, -(-(per_key.agg(F.sum(size)).first()[0] or 0) // (SHARES * partitions)))
    parts = F.ceil(F.col(size) / F.lit(share)).cast("int")
    hot = per_key.filter(F.col(size) > share).select(*keys, parts.alias("__parts"))
    dealt = rows.join(F.broadcast(hot), list(keys), "left")
    part = F.when(F.col("__parts").isNull(), 0).otherwise(F.pmod(F.xxhash64(*rows.columns), F.col("__parts"))).cast("int")
    dealt = dealt.select(*rows.columns, part.alias("__part"))
    copies = per_key.withColumn("__part", F.explode(F.sequence(F.lit(0), F.greatest(parts, F.lit(1)) - 1)))
    return dealt.join(copies.hint("merge"), [*keys, "__part"], how).drop("__part")


#: Hot keys for each shuffle partition, at most (see `join_dealt`).
SHARES = 16

_ARROW = {
    T.LongType: pa.int64(),
    T.IntegerType: pa.int32(),
    T.StringType: pa.string(),
    T.DoubleType: pa.float64(),
    T.BooleanType: pa.bool_(),
    T.BinaryType: pa.binary(),
    T.ArrayType: pa.list_(pa.int64()),
}
