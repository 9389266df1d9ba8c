"""Stand-alone key-value stores: one sorted file, or a folder of hash buckets of sorted files."""

from __future__ import annotations

import json
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F

from waymark.functions.buckets import bucket_of, literals
from waymark.operators.layout import co_partition
from waymark.sources.files import open_input
from waymark.spec import WriterOptions

META, BUCKET = "_waymark_kv.json", "__bucket"


def _write_text(spark: SparkSession, path: str, text: str) -> None:
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    p = jvm.org.apache.hadoop.fs.Path(path)
    out = p.getFileSystem(conf).create(p, True)
    out.write(bytearray(text.encode()))
    out.close()


def _read_text(spark: SparkSession, path: str) -> str | None:
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    p = jvm.org.apache.hadoop.fs.Path(path)
    fs = p.getFileSystem(conf)
    if not fs.exists(p):
        return None
    stream = fs.open(p)
    try:
        return bytes(jvm.org.apache.commons.io.IOUtils.toByteArray(stream)).decode()
    finally:
        stream.close()


def write_kv(df: DataFrame, keys: list[str], folder: str, n_buckets: int, mode: str = "overwrite", rows_per_group: int = 10_000, compression: str = "zstd") -> None:
    """Hash buckets of ``keys``, each sorted; the bucket count is kept beside the data, never guessed from files."""
    write_partitioned_kv(df, keys, folder, [({}, n_buckets)], mode, rows_per_group, compression)


def write_partitioned_kv(df: DataFrame, keys: list[str], folder: str, specs: list[tuple[dict, int]], mode: str = "overwrite", rows_per_group: int = 10_000, compression: str = "zstd") -> None:
    """The same below partition folders, with a bucket count for each partition. No spec: nothing is written."""
    if not specs:
        return
    if missing := [k for k in keys if k not in df.columns]:
        raise ValueError(f"no such key columns: {missing}")
    spark, parts = df.sparkSession, list(dict.fromkeys(k for s, _ in specs for k in s))
    old = _read_text(spark, f"{folder}/{META}") if mode == "append" else None
    number = None
    for s, n in specs:
        hit = F.lit(True)
        for k, v in s.items():
            hit = hit & (F.col(f"`{k}`").cast("string") == F.lit(str(v)))
        number = F.when(hit, F.lit(n)) if number is None else number.when(hit, F.lit(n))
    out = co_partition(df, keys, specs).withColumn(BUCKET, bucket_of(keys, number))
    out.write.mode(mode).option("parquet.block.row.count.limit", rows_per_group).option("parquet.page.row.count.limit", max(1, rows_per_group // 10)).option("compression", compression).partitionBy(*parts, BUCKET).parquet(folder)
    known = {tuple(sorted(x["spec"].items())): x for x in (json.loads(old)["specs"] if old else [])}
    known |= {tuple(sorted((k, str(v)) for k, v in s.items())): {"spec": {k: str(v) for k, v in s.items()}, "buckets": n} for s, n in specs}
    _write_text(spark, f"{folder}/{META}", json.dumps({"keys": keys, "parts": parts, "specs": list(known.values()), "schema": df.drop(*parts).schema.jsonValue()}))


@dataclass(frozen=True)
class KVOptions:
    """What a key-value writer may be told by name; every name is checked before anything is written.

    ``keys`` and ``values`` are columns of the frame, ``interval`` the rows in a page (a row group has ten
    times as many), ``buckets`` the files. ``height`` is accepted and has no effect, as row-group
    statistics take a tree's place. With ``cleanup`` what is in the folder goes; else it must be empty.
    """

    keys: tuple[str, ...]
    values: tuple[str, ...]
    interval: int = 1000
    height: int = 4
    compression: str = "zstd"
    buckets: int = 1
    cleanup: bool = True

    #: Fixed names of the options.
    NAMES = {"key.fields": "keys", "value.fields": "values", "btree.interval": "interval", "btree.height": "height", "compression": "compression", "buckets": "buckets", "cleanup": "cleanup"}

    @classmethod
    def of(cls, options: dict[str, object], columns: list[str]) -> KVOptions:
        """Options by their names, as strings or values, for a frame of ``columns``."""
        if unknown := sorted(set(options) - set(cls.NAMES)):
            raise ValueError(f"unknown options {unknown}; known: {sorted(cls.NAMES)}")
        if missing := [n for n in ("key.fields", "value.fields") if not options.get(n)]:
            raise ValueError(f"options missing: {missing}")
        got: dict[str, object] = {}
        for name, value in options.items():
            field = cls.NAMES[name]
            if field in ("keys", "values"):
                got[field] = tuple(x.strip() for x in (value.split(",") if isinstance(value, str) else value))
            elif field == "cleanup":
                if str(value).lower() not in ("true", "false"):
                    raise ValueError(f"cleanup is true or false, not {value!r}")
                got[field] = str(value).lower() == "true"
            else:
                got[field] = str(value) if field == "compression" else int(value)
        out = cls(**got)
        every = out.keys + out.values
        if lost := [c for c in every if c not in columns]:
            raise ValueError(f"no such columns: {lost}")
        if len(set(every)) != len(every):
            raise ValueError(f"a column is a key or a value, and once: {every}")
        if out.compression not in WriterOptions.CODECS:
            raise ValueError(f"unknown codec {out.compression!r}; known: {WriterOptions.CODECS}")
        if out.interval < 1 or out.buckets < 1:
            raise ValueError(f"out of range: {out}")
        return out


class KVWriter:
    """Writes a frame as a key-value folder by named options: ``KVWriter(df).option("key.fields", "id").option("value.fields", "a,b").save(folder)``."""

    def __init__(self, df: DataFrame):
        self.df, self.told = df, {}

    def option(self, name: str, value) -> KVWriter:
        self.told[name] = value
        return self

    def options(self, **named) -> KVWriter:
        self.told |= {k.replace("_", "."): v for k, v in named.items()}
        return self

    def save(self, folder: str) -> None:
        """Sorted files of the key and value columns alone, one a bucket."""
        o = KVOptions.of(self.told, self.df.columns)
        rows = self.df.select(*[f"`{c}`" for c in (*o.keys, *o.values)])
        write_kv(rows, list(o.keys), folder, o.buckets, "overwrite" if o.cleanup else "error", 10 * o.interval, o.compression)


class KVFolder:
    """Point reads of a folder written by :func:`write_kv`; a key's bucket and row groups alone are read."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder
        told = _read_text(spark, f"{folder}/{META}")
        if told is None:
            raise FileNotFoundError(f"{folder} is no key-value folder")
        m = json.loads(told)
        from pyspark.sql.types import StructType

        self.keys, self.parts = m["keys"], m["parts"]
        self.buckets = {tuple(sorted(x["spec"].items())): x["buckets"] for x in m["specs"]}
        self.schema = StructType.fromJson(m["schema"])

    def scan(self) -> DataFrame:
        """Every record, values and partitions too."""
        return self.spark.read.parquet(self.folder).drop(BUCKET)

    def where(self, key: dict | list, partition: dict | None = None) -> DataFrame:
        """The records of one key as a frame; partition, bucket and row-group statistics prune the scan."""
        key = dict(zip(self.keys, key, strict=True)) if not isinstance(key, dict) else key
        if set(key) != set(self.keys):
            raise ValueError(f"a key has {self.keys}, not {list(key)}")
        spec = {k: str(v) for k, v in (partition or {}).items()}
        n = self.buckets.get(tuple(sorted(spec.items())))
        df = self.spark.read.parquet(self.folder)
        if n is None or any(v is None for v in key.values()):
            return df.where(F.lit(False)).drop(BUCKET)
        ordered = {k: key[k] for k in self.keys}
        bucket = self.spark.range(1).select(bucket_of(literals(self.schema, ordered), n)).first()[0]
        df = df.where(F.col(BUCKET) == bucket)
        for k, v in spec.items():
            df = df.where(F.col(f"`{k}`").cast("string") == v)
        for k, lit in zip(self.keys, literals(self.schema, ordered), strict=True):
            df = df.where(F.col(f"`{k}`") == lit)
        return df.drop(BUCKET)

    def get(self, key, partition: dict | None = None) -> Row | None:
        """One record of the key, or None."""
        return next(iter(self.where(key, partition).take(1)), None)

    def get_iterator(self, key=None, partition: dict | None = None) -> Iterator[Row]:
        """All records of a key, duplicates too; without a key, all records."""
        return (self.scan() if key is None else self.where(key, partition)).toLocalIterator()


class KVFile:
    """One sorted file on the driver: for small stores beside a job, such as settings or dictionaries."""

    def __init__(self, path: str, keys: list[str]):
        import pyarrow.parquet as pq

        self.path, self.keys = path, keys
        self.file = pq.ParquetFile(open_input(path))

    @staticmethod
    def write(rows: Iterable[dict], path: str, keys: list[str], interval: int = 1000, pre_sort: bool = True, schema=None) -> KVFile:
        """Write ``rows`` sorted by ``keys``, ``interval`` rows in a group; unsorted input without ``pre_sort`` is an error."""
        import pyarrow as pa
        import pyarrow.parquet as pq

        rows = list(rows)
        order = [tuple((r[k] is not None, r[k]) for k in keys) for r in rows]
        if pre_sort:
            rows = [rows[i] for i in sorted(range(len(rows)), key=order.__getitem__)]
        elif any(a > b for a, b in zip(order, order[1:], strict=False)):
            raise ValueError("keys must not decrease")
        pq.write_table(pa.Table.from_pylist(rows, schema=schema), path, row_group_size=interval, compression="zstd")
        return KVFile(path, keys)

    def get_iterator(self, key: list | None = None) -> Iterator[dict]:
        """Records in key order; of one key, only from row groups whose statistics admit it."""
        names = self.file.schema_arrow.names
        first = names.index(self.keys[0])
        for g in range(self.file.num_row_groups):
            if key is not None:
                st = self.file.metadata.row_group(g).column(first).statistics
                if st and st.has_min_max and not st.min <= key[0] <= st.max:
                    continue
            for r in self.file.read_row_group(g).to_pylist():
                if key is None or [r[k] for k in self.keys] == list(key):
                    yield r

    def get(self, key: list) -> dict | None:
        return next(self.get_iterator(key), None)
