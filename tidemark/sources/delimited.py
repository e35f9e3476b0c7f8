"""Delimited text read by column name: each file by its own header, all files in one scan."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


_END = "\x01"


def logical_path(path: Column) -> Column:
    """A file's path; of a file that Spark wrote as a folder (`name.csv/part-...`, or `file=name.csv/part-...`) the folder's."""
    return F.regexp_replace(F.regexp_replace(path, "/part-[^/]*$", ""), "/file=([^/]*)$", "/$1")


def folder_of(path: Column) -> Column:
    """The folder of a logical path."""
    return F.regexp_extract(path, "^(.*)/[^/]+$", 1)


def name_of(path: Column) -> Column:
    """The file name of a logical path."""
    return F.regexp_extract(path, "([^/]+)$", 1)


def lines_of(spark: SparkSession, root: str, names: str, empty: bool = False) -> DataFrame:
    """`file, part, place, value`: the lines of files below `root` whose name matches `names`, and the order in which they stand.

    The names are looked at when files are listed, so other files are not opened. Lines of spaces go, unless `empty` is set.
    """
    part = F.col("_metadata.file_path")
    raw = spark.read.option("recursiveFileLookup", True).text(root).filter(name_of(logical_path(part)).rlike(names))
    placed = raw.select(part.alias("part"), F.struct(F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("n")).alias("place"), "value")
    placed = placed.withColumn("file", logical_path(F.col("part")))
    return placed if empty else placed.filter(F.trim("value") != "")


def read_by_name(spark: SparkSession, root: str, names: str = r"\.csv$") -> DataFrame:
    """`file, part, place, row, header, n_values`: `row` maps a file's column names, trimmed and in lower case, to a row's values.

    Files may have different columns, and the same ones in different orders. A row with more or fewer values than its
    header is read as far as both go; `n_values` tells. A file of many parts has a header in each.
    """
    lines = lines_of(spark, root, names)
    heads = lines.groupBy("part").agg(F.min_by("value", "place").alias("head"), F.min("place").alias("first"))
    # quoted commas make this too large at most
    width = heads.agg(F.max(F.size(F.split("head", ",")))).first()[0] or 1
    schema = ", ".join(f"c{k} string" for k in range(width + 1))

    def values(line: str) -> Column:
        parsed = F.from_csv(F.concat(line, F.lit("," + _END)), F.lit(schema), {"escape": '"'})
        every = F.array(*[F.coalesce(parsed[f"c{k}"], F.lit("")) for k in range(width + 1)])
        # empty values are NULL, as missing ones are: the mark behind the last one tells how many there are; it is lost in too long a row
        count = lambda a: F.coalesce(F.nullif(F.array_position(a, _END), F.lit(0)) - 1, F.lit(width + 1)).cast("int")
        return F.transform(F.array(every), lambda a: F.slice(a, 1, count(a)))[0]

    named = heads.select("part", "first", F.transform(values("head"), lambda n: F.lower(F.trim(n))).alias("header"))
    rows = lines.join(named, "part").filter(F.col("place") != F.col("first")).withColumn("values", values("value"))
    n = F.least(F.size("header"), F.size("values"))
    pairs = F.arrays_zip(F.slice("header", 1, n).alias("k"), F.slice("values", 1, n).alias("v"))
    pairs = F.filter(pairs, lambda p, i: F.array_position("header", p["k"]) == i + 1)  # of columns of one name the first counts
    row = F.map_from_entries(F.transform(pairs, lambda p: F.struct(p["k"], F.nullif(F.trim(p["v"]), F.lit("")))))
    return rows.select("file", "part", "place", row.alias("row"), "header", F.size("values").alias("n_values"))


def value_of(names: tuple[str, ...] | list[str]) -> Column:
    """The value of the first of `names` that a row's file has, whatever the value is."""
    there = F.filter(F.array(*[F.lit(n.lower()) for n in names]), lambda n: F.array_contains("header", n))
    return F.try_element_at("row", F.try_element_at(there, F.lit(1)))


def file_problems(rows: DataFrame, required: list[tuple[str, ...]], numbers: list[tuple[str, ...]] | None = None) -> DataFrame:
    """`file, problem` of each file that lacks a required column (one of each tuple), has a name twice, rows that do not fit its
    header, or text in a column of `numbers`; nothing is raised, and rows are read as far as they go."""
    lacking = [F.when(~F.arrays_overlap(F.col("header"), F.array(*[F.lit(n.lower()) for n in names])), F.lit(f"no column {names[0]}")) for names in required]
    ragged = F.when(F.col("n_values") != F.size("header"), F.lit("a row that does not fit the header"))
    twice = F.when(F.size(F.array_distinct("header")) < F.size("header"), F.lit("a column name twice"))
    texts = [F.when(value_of(names).isNotNull() & value_of(names).try_cast("double").isNull(), F.lit(f"no number in {names[0]}")) for names in numbers or []]
    return rows.select("file", F.explode(F.array_compact(F.array(*lacking, ragged, twice, *texts))).alias("problem")).distinct()
