"""Tables written to the folder that driver and executors share."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The folder named in spark.checkpoint.dir; where that is unset on a single machine, as in tests, one of our own.

    On a cluster the setting is demanded: a folder of the driver's machine would not be there for executors.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        named = getattr(spark, "_tidemark_folder", None) or tempfile.mkdtemp(prefix="tidemark-")
        spark._tidemark_folder = named
    return named.rstrip("/")


def materialise(df: DataFrame) -> DataFrame:
    """Write `df` as Parquet to the shared folder and read it back.

    It cuts lineage in a way that survives lost executors, and gives the planner the table's true size, so
    that a join with it is broadcast only if it is known to be small. The files go when the JVM ends.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/tidemark/{uuid.uuid4().hex}"
    df.write.parquet(path)
    jvm_path = spark._jvm.org.apache.hadoop.fs.Path(path)
    jvm_path.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(jvm_path)
    return spark.read.schema(df.schema).parquet(path)
