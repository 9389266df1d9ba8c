"""Continuous indexing: new files of a growing data folder go to an index folder as they come."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from waymark.functions.buckets import bucket_of
from waymark.sources.files import normal_path
from waymark.spec import FILE, LOCATOR, OFFSET, SIZE, SUB_OFFSET


def index_stream(spark: SparkSession, data_folder: str, schema, keys: list[str], index_folder: str, checkpoint: str, more_fields: list[str] | None = None, n_buckets: int = 8, once: bool = True):
    """Start a query that indexes files not seen before; the file source's log is what has been indexed.

    Each batch goes to its own ``__batch`` folder, overwritten when a batch is run again after a
    failure, so that every row is indexed once. Returns the streaming query.
    """
    fields = [*keys, *(more_fields or [])]
    stream = spark.readStream.schema(schema).parquet(data_folder)
    rows = stream.select(*[f"`{c}`" for c in fields], normal_path(F.col("_metadata.file_path")).alias(FILE), F.col("_metadata.row_index").alias(OFFSET)).withColumns({SUB_OFFSET: F.lit(0), SIZE: F.lit(-1)})

    def put(batch: DataFrame, epoch: int) -> None:
        dealt = batch.repartition(n_buckets, bucket_of(keys, n_buckets)).sortWithinPartitions(*keys)
        dealt.write.mode("overwrite").parquet(f"{index_folder}/__batch={epoch}")

    q = stream_writer = rows.writeStream.foreachBatch(put).option("checkpointLocation", checkpoint)
    return (q.trigger(availableNow=True) if once else stream_writer).start()


def read_stream_index(spark: SparkSession, index_folder: str) -> DataFrame:
    """The index so far."""
    df = spark.read.parquet(index_folder).drop("__batch")
    return df.select(*[c for c in df.columns if c not in LOCATOR], *LOCATOR)
