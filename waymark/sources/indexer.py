"""Per-format indexers: rows with their locators, and the way back from locators to rows.

Locators: Parquet has the file's row number in ``data_offset`` and the mean row size; ORC,
SequenceFile, Avro and text have the ordinal of the row in the file, sub-offset 0 and size -1.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from waymark.operators.reader import load_rows, read_many, read_one
from waymark.sources.files import normal_path
from waymark.spec import FILE, LOCATOR, OFFSET, SIZE, SUB_OFFSET, ReaderOptions

#: Marks of each format in a table's provider, input format or SerDe, first match wins.
FORMATS = (("sequence", "sequence"), ("avro", "avro"), ("parquet", "parquet"), ("orc", "orc"), ("text", "text"), ("csv", "csv"), ("json", "json"))

#: Byte ranges that are sent to every executor, a path and three numbers each: some 64 MB.
SENT_RANGES = 250_000


def resolve_format(spark: SparkSession, table: str) -> str:
    """The storage format of a catalog table, from its description."""
    rows = {r[0].strip().lower(): str(r[1]).lower() for r in spark.sql(f"DESCRIBE FORMATTED {table}").collect() if r[0]}
    told = " ".join(rows.get(k, "") for k in ("inputformat", "serde library", "provider"))
    for mark, name in FORMATS:
        if mark in told:
            return name
    raise ValueError(f"no indexer for the format of {table}: {told.strip() or 'unknown'}")


def with_locators(df: DataFrame, fmt: str) -> DataFrame:
    """All of ``df``'s columns and the four locator columns. ``df`` must be a plain scan.

    Parquet takes the scan's own row numbers, without any shuffle. Formats whose readers number no
    rows are numbered by file, in the order of byte ranges and of rows within them: a byte range's rows
    stand together in one partition of the scan, so its first row's number, and the rows of the ranges
    before it, are all that is needed. Those are a row a range, from a pass that reads no columns; rows
    of the data aren't moved where that table's proven bound lets it be sent around.
    """
    if clash := set(df.columns) & set(LOCATOR):
        raise ValueError(f"the data has reserved column names: {sorted(clash)}")
    if fmt == "parquet":
        m = df.select("*", F.col("_metadata.file_path").alias(FILE), F.col("_metadata.row_index").alias(OFFSET))
        return m.select(*[f"`{c}`" for c in df.columns], normal_path(F.col(FILE)).alias(FILE), OFFSET, F.lit(0).alias(SUB_OFFSET), F.lit(-1).alias(SIZE))
    m = df.select("*", normal_path(F.input_file_name()).alias(FILE), F.input_file_block_start().alias("__start"), F.monotonically_increasing_id().alias("__id"))
    ranges = m.groupBy(FILE, "__start").agg(F.min("__id").alias("__low"), F.count(F.lit(1)).alias("__n"))
    before = F.sum("__n").over(Window.partitionBy(FILE).orderBy("__start").rowsBetween(Window.unboundedPreceding, -1))
    ranges = ranges.select(FILE, "__start", "__low", F.coalesce(before, F.lit(0)).alias("__before"))
    if most_ranges(df) <= SENT_RANGES:
        ranges = F.broadcast(ranges)
    rows = m.join(ranges, [FILE, "__start"]).withColumn(OFFSET, F.col("__before") + F.col("__id") - F.col("__low"))
    return rows.select(*[f"`{c}`" for c in df.columns], FILE, OFFSET, F.lit(0).alias(SUB_OFFSET), F.lit(-1).alias(SIZE))


def most_ranges(df: DataFrame) -> int:
    """At most that many byte ranges are in a plain scan: its partitions, by the ranges that fit in one."""
    conf = df.sparkSession._jsparkSession.sessionState().conf()
    fit = conf.filesMaxPartitionBytes() // max(conf.filesOpenCostInBytes(), 1) + 1
    return df._jdf.queryExecution().toRdd().getNumPartitions() * fit


def with_row_sizes(indexed: DataFrame, data: DataFrame) -> DataFrame:
    """``data_size`` of Parquet rows: their file's mean bytes of a row, at least 1. ``data`` is the scan that was indexed.

    Sizes and row counts come from a scan of ``data`` that reads no columns, a row a file.
    """
    files = data.select(normal_path(F.col("_metadata.file_path")).alias(FILE), F.col("_metadata.file_size").alias("__fs"))
    mean = F.greatest(F.lit(1), (F.max("__fs") / F.count(F.lit(1))).cast("int"))
    per = files.groupBy(FILE).agg(mean.alias("__mean"))
    return indexed.join(per, FILE, "left").withColumn(SIZE, F.coalesce("__mean", F.lit(-1))).select(*indexed.columns)


class TableIndexer:
    """Manual, manager-free indexing of one data set: ``TableIndexer.parquet(spark, path)``."""

    def __init__(self, data: DataFrame, fmt: str, options: ReaderOptions | None = None):
        self.data, self.fmt = data, fmt
        self.spark = data.sparkSession
        self.options = options or ReaderOptions.of(self.spark)

    @classmethod
    def parquet(cls, spark: SparkSession, *paths: str, **kw) -> TableIndexer:
        return cls(spark.read.parquet(*paths), "parquet", **kw)

    @classmethod
    def orc(cls, spark: SparkSession, *paths: str, **kw) -> TableIndexer:
        return cls(spark.read.orc(*paths), "orc", **kw)

    @classmethod
    def text(cls, spark: SparkSession, *paths: str, **kw) -> TableIndexer:
        return cls(spark.read.text(*paths), "text", **kw)

    @classmethod
    def table(cls, spark: SparkSession, name: str, **kw) -> TableIndexer:
        return cls(spark.table(name), resolve_format(spark, name), **kw)

    def create_index_df(self, fields: list[str], name_like: str = "%") -> DataFrame:
        """``fields`` and locators of every row whose file name is LIKE the pattern."""
        df = with_locators(self.data, self.fmt).select(*[f"`{c}`" for c in fields], *LOCATOR)
        return df if name_like == "%" else df.where(F.element_at(F.split(FILE, "/"), -1).like(name_like))

    def payload_schema(self, fields: list[str] | None) -> StructType:
        s = self.data.schema
        return s if fields is None else StructType([s[f] for f in fields])

    def load_by_index(self, index: DataFrame, fields: list[str] | None = None) -> DataFrame:
        """One row for each index row: its own columns but the locators and clashing names, then the payload."""
        return load_rows(index, self.payload_schema(fields), self.fmt, self.data, self.options)

    def read_payload(self, locator, fields: list[str] | None = None) -> dict:
        """The payload of one locator, read on the driver."""
        return read_one(self.spark, locator, self.payload_schema(fields), self.fmt, self.data)

    def read_payloads(self, locators, fields: list[str] | None = None, parts: list[str] = ()):
        """Payloads of many locators in their order, read on the driver; neighbours of one file share what is open."""
        return read_many(self.spark, locators, self.payload_schema(fields), self.fmt, self.data, parts)
