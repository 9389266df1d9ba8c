"""Byte-bounded chunks of requests, planned as a window, and index sizing."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from waymark.spec import FILE, OFFSET, SIZE, SUB_OFFSET, ReaderOptions


def running_bytes(df: DataFrame, new_file_cost: int, within: str, size: str = SIZE) -> DataFrame:
    """``__sum``: bytes so far in ``within``'s group, each newly opened file at a fixed cost more."""
    w = Window.partitionBy(within).orderBy(FILE, OFFSET, SUB_OFFSET)
    opened = F.lag(FILE).over(w)
    cost = F.greatest(F.col(size), F.lit(1)).cast("bigint") + F.when(opened.isNull() | (opened != F.col(FILE)), new_file_cost).otherwise(0)
    return df.withColumn("__cost", cost).withColumn("__sum", F.sum("__cost").over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("__cost")


def chunked(df: DataFrame, options: ReaderOptions) -> DataFrame:
    """Requests dealt so that a task reads about ``max_bytes``; sorted for sequential reading.

    Groups for the running sum are ranges of rows of a file, so no group grows with the file.
    """
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    groups = max(n // options.repartition_ratio, 1)
    part = df.withColumn("__part", F.concat_ws(":", F.pmod(F.hash(FILE), F.lit(groups)), F.floor(F.col(OFFSET) / options.rows_per_task)))
    summed = running_bytes(part, options.new_file_cost, "__part")
    out = summed.withColumn("__chunk", F.floor(F.col("__sum") / options.max_bytes).cast("int"))
    if options.debug:
        chunk_stats(out).show(truncate=False)
    return out.repartition("__part", "__chunk").sortWithinPartitions(FILE, OFFSET, SUB_OFFSET).drop("__part", "__chunk", "__sum")


def chunk_stats(df: DataFrame) -> DataFrame:
    """Rows and bytes of each chunk."""
    return df.groupBy("__part", "__chunk").agg(F.count(F.lit(1)).alias("rows"), F.sum(SIZE).alias("bytes"))


def tree_height(rows: int, interval: int) -> int:
    """Levels that a tree of this fan-out would need, for reports; row-group statistics take the tree's place."""
    return max(1, math.ceil(math.log(max(rows, 2)) / math.log(max(interval, 2))))


def bucket_count(rows: float, row_bytes: float, target_file_mb: int) -> int:
    """Buckets so that each file of a partition's index is about the target size."""
    return max(1, math.ceil(rows * row_bytes / (target_file_mb << 20)))


#: Bytes that a locator takes in a written index: its offset and size; the file's name is in a dictionary.
LOCATOR_BYTES = 12


def sampled_size(df: DataFrame, columns: list[str], rate: float) -> tuple[int, float]:
    """Rows of a plain scan, and mean bytes of an index row, from the columns of a sample of its files.

    Files are picked by a hash of their names, three at least; Spark then opens no others. Their
    rows are scaled up by the number of files. Where none is picked, all files are looked into.
    """
    files = len(df._jdf.inputFiles())  # names stay in the JVM, which lists them for any scan
    if not files:
        return 0, 0.0
    name = F.col("_metadata.file_path") if _has_metadata(df) else F.input_file_name()
    rate = min(1.0, max(rate, 3 / files))
    size = sum([F.coalesce(F.octet_length(F.col(f"`{c}`").cast("string")), F.lit(0)) for c in columns], F.lit(0))

    def told(part: DataFrame):
        return part.select(name.alias("__f"), size.alias("__b")).agg(F.count(F.lit(1)).alias("n"), F.sum("__b").alias("b"), F.approx_count_distinct("__f", 0.01).alias("files")).first()

    got = told(df.where(F.pmod(F.xxhash64(name), F.lit(1 << 20)) < int(rate * (1 << 20)))) if rate < 1 else None
    if got is None or not got["n"]:
        got = told(df)
        return int(got["n"]), (got["b"] or 0) / max(got["n"], 1) + LOCATOR_BYTES
    return max(1, round(got["n"] * files / max(1, got["files"]))), (got["b"] or 0) / got["n"] + LOCATOR_BYTES


def _has_metadata(df: DataFrame) -> bool:
    """Whether the scan tells a row's file by a hidden column, by which Spark prunes files before it opens them."""
    from pyspark.errors import AnalysisException

    try:
        df.select("_metadata.file_path")
    except AnalysisException:
        return False
    return True
