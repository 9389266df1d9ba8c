"""Index specification, and the options that sessions may set."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field, replace

from pyspark.sql import SparkSession

#: Fixed names of the four locator columns.
FILE, OFFSET, SUB_OFFSET, SIZE = "data_filename", "data_offset", "data_sub_offset", "data_size"
LOCATOR = (FILE, OFFSET, SUB_OFFSET, SIZE)
LOCATOR_DDL = f"{FILE} string, {OFFSET} bigint, {SUB_OFFSET} int, {SIZE} int"


@dataclass(frozen=True)
class IndexSpec:
    """What to index: ``keys`` and ``more_fields`` of ``data_table`` go to ``index_table``."""

    data_table: str
    index_table: str
    keys: tuple[str, ...]
    more_fields: tuple[str, ...] = ()

    def __post_init__(self):
        object.__setattr__(self, "keys", tuple(self.keys))
        object.__setattr__(self, "more_fields", tuple(self.more_fields or ()))
        if not self.keys:
            raise ValueError("an index needs at least one key")
        names = self.keys + self.more_fields
        if len(set(names)) != len(names):
            raise ValueError(f"repeated fields in the index: {names}")
        if taken := set(names) & set(LOCATOR):
            raise ValueError(f"reserved column names: {sorted(taken)}")


def _conf(spark: SparkSession, key: str, default, kind: Callable):
    value = spark.conf.get(key, None)
    if value is None:
        return default
    if kind is bool:
        if value.lower() not in ("true", "false"):
            raise ValueError(f"{key} must be true or false, not {value!r}")
        return value.lower() == "true"
    return kind(value)


@dataclass(frozen=True)
class WriterOptions:
    """How an index or key-value folder is laid out.

    ``num_parts`` buckets per partition (-1: from sizes), ``interval`` rows in a row group's page
    run, ``height`` is accepted and unused (row-group statistics take the place of tree levels).
    """

    file_filter: str = "%"
    interval: int = 1000
    height: int = -1
    num_parts: int = -1
    sample_rate: float = 0.05
    target_file_mb: int = 50
    cast_decimal_to_double: bool = False
    compression: str = "zstd"

    #: Codecs that the Parquet writer takes.
    CODECS = ("none", "uncompressed", "snappy", "gzip", "lz4", "zstd")

    def __post_init__(self):
        if self.compression not in self.CODECS:
            raise ValueError(f"unknown codec {self.compression!r}; known: {self.CODECS}")
        if self.interval < 1 or self.target_file_mb < 1 or not 0 < self.sample_rate <= 1:
            raise ValueError(f"out of range: {self}")

    @classmethod
    def of(cls, spark: SparkSession, **changed) -> WriterOptions:
        keys = {
            "file_filter": ("index.manager.file.filter", str),
            "interval": ("index.manager.btree.interval", int),
            "height": ("index.manager.btree.height", int),
            "num_parts": ("index.manager.btree.num.parts", int),
            "sample_rate": ("indexer.sampler.files.rate", float),
            "target_file_mb": ("index.manager.targetFileSizeMB", int),
            "cast_decimal_to_double": ("indexer.castDecimalToDouble", bool),
        }
        base = cls()
        return replace(base, **{n: _conf(spark, k, getattr(base, n), t) for n, (k, t) in keys.items()} | changed)


@dataclass(frozen=True)
class ReaderOptions:
    """How payloads are read back.

    ``chunks`` bounds a task's work by bytes; ``strategy`` is ``seek`` (row groups by Arrow),
    ``scan`` (a join on the scan's own row numbers, for stores that only Spark reads) or ``auto``:
    ``seek`` where Arrow reaches the files. A seek moves locators alone and decodes a row group once
    a task, so it is about as fast as the scan where all rows are wanted. ``rows_per_task`` is the range of a file that
    one task serves; by default by the data's size. ``metrics`` is a
    :class:`waymark.operators.reader.Metrics` that counts over all tasks.
    """

    ignore_failures: bool = False
    chunks: bool = False
    repartition_ratio: int = 100
    max_bytes: int = 20 << 20
    new_file_cost: int = 1 << 20
    debug: bool = False
    reporter: object = None
    strategy: str = "auto"
    rows_per_task: int | None = None
    metrics: object = None
    extra: dict = field(default_factory=dict)

    def __post_init__(self):
        if self.strategy not in ("auto", "seek", "scan"):
            raise ValueError(f"unknown strategy {self.strategy!r}")

    @classmethod
    def of(cls, spark: SparkSession, **changed) -> ReaderOptions:
        keys = {
            "ignore_failures": ("indexer.reader.ignore.failures", bool),
            "chunks": ("indexer.reader.chunks", bool),
            "repartition_ratio": ("indexer.reader.repartitionRatio", int),
            "max_bytes": ("indexer.reader.maxBytes", int),
            "new_file_cost": ("indexer.reader.newFileCostInBytes", int),
            "debug": ("indexer.reader.debug", bool),
            "reporter": ("indexer.reader.reporter", str),
        }
        base = cls()
        return replace(base, **{n: _conf(spark, k, getattr(base, n), t) for n, (k, t) in keys.items()} | changed)
