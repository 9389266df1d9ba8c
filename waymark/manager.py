"""Index manager: define, reopen, fill and query an index that lives in the catalog."""

from __future__ import annotations

import json
from collections.abc import Iterable, Iterator
from itertools import chain, tee
from urllib.parse import unquote

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, MapType, StructType

from waymark.functions.buckets import bucket_of, partition_predicate
from waymark.operators.join import JOIN_CONF, LOOKUP_CONF, join_with_index, missing_partitions, settings
from waymark.operators.layout import guard_decimals, rebalanced
from waymark.plans.chunks import bucket_count, sampled_size
from waymark.sources.indexer import TableIndexer, resolve_format, with_row_sizes
from waymark.spec import FILE, LOCATOR, LOCATOR_DDL, IndexSpec, ReaderOptions, WriterOptions

#: Fixed names of the table properties that make an index reopenable.
PROP_DATA, PROP_KEYS, PROP_MORE, PROP_BUCKETS, PROP_OPEN = "index.meta.dataTableName", "index.meta.keys", "index.meta.moreFields", "index.meta.buckets", "index.meta.buckets.open"
#: Fixed value: how the catalog writes a null partition value.
NULL_PARTITION = "__HIVE_DEFAULT_PARTITION__"
#: Rows of one key that a lookup takes at once; a key with more is streamed.
AT_ONCE = 10_000
#: Shuffled MB that a task of an append has at least, where files are to be smaller.
LEAST_TASK_MB = 16


def _quoted(name: str) -> str:
    parts = name.split(".")
    if not 1 <= len(parts) <= 3 or not all(parts):
        raise ValueError(f"a table is t, db.t or catalog.db.t, not {name!r}")
    return ".".join(f"`{p}`" for p in parts)


def _sql_str(x: str) -> str:
    return "'" + x.replace("\\", "\\\\").replace("'", "\\'") + "'"


class IndexManager:
    """An index of ``spec.data_table``. Use :meth:`create_new` or :meth:`load`."""

    def __init__(self, spark: SparkSession, spec: IndexSpec, reader: ReaderOptions | None = None, writer: WriterOptions | None = None):
        self.spark, self.spec = spark, spec
        self.reader = reader or ReaderOptions.of(spark)
        self.writer = writer or WriterOptions.of(spark)
        self.format = resolve_format(spark, _quoted(spec.data_table))
        self.parts = [c.name for c in spark.catalog.listColumns(spec.data_table) if c.isPartition]

    # -- definition -------------------------------------------------------------------------------

    @classmethod
    def create_new(cls, spark: SparkSession, data: str, index: str, keys: list[str], more_fields: list[str] | None = None, num_buckets: int | None = None, location: str | None = None, **kw) -> IndexManager:
        """Define an empty index. The bucket count is given, or from a sample of the data's files: so many that a
        file of each partition is about the target size. Where there are no data yet, the first append decides."""
        spec = IndexSpec(data, index, tuple(keys), tuple(more_fields or ()))
        self = cls(spark, spec, **kw)
        if spark.catalog.tableExists(index):
            raise ValueError(f"{index} exists already")
        table = spark.table(data)
        if missing := [c for c in spec.keys + spec.more_fields if c not in table.columns]:
            raise ValueError(f"no such columns in {data}: {missing}")
        if bad := [k for k in spec.keys if isinstance(table.schema[k].dataType, ArrayType | MapType | StructType)]:
            raise ValueError(f"nested columns can't be keys: {bad}")
        if both := [c for c in spec.keys + spec.more_fields if c in self.parts]:
            raise ValueError(f"partition columns are part of every index already: {both}")
        chosen = guard_decimals(table.select(*[f"`{c}`" for c in spec.keys + spec.more_fields]), self.writer.cast_decimal_to_double)
        n = num_buckets or (self.writer.num_parts if self.writer.num_parts > 0 else None)
        sized = n or self._sized(table, self._partition_total())
        self._define(table, sized or 1, location, open_=sized is None)
        return self

    @classmethod
    def load(cls, spark: SparkSession, index: str, **kw) -> IndexManager:
        """Reopen an index from its table's properties."""
        props = {r[0]: r[1] for r in spark.sql(f"SHOW TBLPROPERTIES {_quoted(index)}").collect()}
        if PROP_DATA not in props:
            raise ValueError(f"{index} is no index")
        return cls(spark, IndexSpec(props[PROP_DATA], index, tuple(json.loads(props[PROP_KEYS])), tuple(json.loads(props[PROP_MORE]))), **kw)

    def _define(self, table: DataFrame, n: int, location: str | None, open_: bool) -> None:
        """Create the index table; ``open_``: its bucket count is yet to be decided."""
        spec = self.spec
        chosen = guard_decimals(table.select(*[f"`{c}`" for c in spec.keys + spec.more_fields]), self.writer.cast_decimal_to_double)
        cols = [f"`{f.name}` {f.dataType.simpleString()}" for f in chosen.schema] + [LOCATOR_DDL] + [f"`{p}` {table.schema[p].dataType.simpleString()}" for p in self.parts]
        keys_sql = ", ".join(f"`{k}`" for k in spec.keys)
        self.spark.sql(
            f"CREATE TABLE {_quoted(spec.index_table)} ({', '.join(cols)}) USING parquet"
            + f" OPTIONS ('parquet.page.row.count.limit' = '{self.writer.interval}', 'compression' = '{self.writer.compression}')"
            + (f" PARTITIONED BY ({', '.join(f'`{p}`' for p in self.parts)})" if self.parts else "")
            + f" CLUSTERED BY ({keys_sql}) SORTED BY ({keys_sql}) INTO {n} BUCKETS"
            + (f" LOCATION {_sql_str(location)}" if location else "")
            + f" TBLPROPERTIES ({_sql_str(PROP_DATA)} = {_sql_str(spec.data_table)}, {_sql_str(PROP_KEYS)} = {_sql_str(json.dumps(spec.keys))}, {_sql_str(PROP_MORE)} = {_sql_str(json.dumps(spec.more_fields))}, {_sql_str(PROP_BUCKETS)} = '{n}', {_sql_str(PROP_OPEN)} = '{str(open_).lower()}')"
        )

    def _partition_total(self) -> int:
        """Partitions of the data, as the catalog lists them, or else as they are found; 1 without any."""
        if not self.parts:
            return 1
        listed = self._listed(self.spec.data_table)
        return max(1, (self.partitions() if listed is None else listed).count())

    def _sized(self, table: DataFrame, partitions: int) -> int | None:
        """Buckets of a partition from a sample of files, or None where those have no rows."""
        fields = [*self.spec.keys, *self.spec.more_fields]
        rows, row_bytes = sampled_size(table, fields, self.writer.sample_rate)
        return bucket_count(rows / partitions, row_bytes, self.writer.target_file_mb) if rows else None

    def _props(self) -> dict[str, str]:
        return {r[0]: r[1] for r in self.spark.sql(f"SHOW TBLPROPERTIES {_quoted(self.spec.index_table)}").collect()}

    def _decide(self, data: DataFrame, partitions: int) -> None:
        """The bucket count of an index that was defined before there were data, from the first of them."""
        if self._props().get(PROP_OPEN) != "true" or self.get_index().take(1):
            return
        n = self._sized(data, partitions)
        if n is None:
            return
        told = {r[0].strip(): r[1] for r in self.spark.sql(f"DESCRIBE FORMATTED {_quoted(self.spec.index_table)}").collect()}
        location = told.get("Location") if told.get("Type", "").upper() == "EXTERNAL" else None
        self.drop()
        self._define(self.spark.table(self.spec.data_table), n, location, open_=False)

    @property
    def num_buckets(self) -> int:
        return int(self._props()[PROP_BUCKETS])

    @property
    def index_folder(self) -> str:
        return self.partition_location(None, self.spec.index_table)

    def partition_location(self, spec: dict | None = None, table: str | None = None) -> str:
        """Folder of a table or of one of its partitions, as the catalog has it."""
        part = " PARTITION (" + ", ".join(f"`{k}` = {_sql_str(str(v))}" for k, v in spec.items()) + ")" if spec else ""
        rows = self.spark.sql(f"DESCRIBE FORMATTED {_quoted(table or self.spec.data_table)}{part}").collect()
        return next(r[1] for r in rows if r[0].strip() == "Location")

    # -- partitions -------------------------------------------------------------------------------

    def partitions(self, table: str | None = None) -> DataFrame:
        """Partition values that a table has rows of, from a scan that reads no other columns."""
        return self.spark.table(table or self.spec.data_table).select(*[f"`{p}`" for p in self.parts]).distinct()

    def _listed(self, table: str) -> DataFrame | None:
        """Names of partitions (``dt=1/seq=2``) in the catalog, or None where it keeps none for the table."""
        try:
            return self.spark.sql(f"SHOW PARTITIONS {_quoted(table)}")
        except AnalysisException:
            return None

    def get_missing_partitions(self) -> list[dict]:
        """Partitions with rows in the data that the index lacks; an unpartitioned table is one partition, ``{}``.

        The catalog's names tell which may be missing, so that only those are looked into; without
        names in the catalog both tables are.
        """
        if not self.parts:
            return [{}] if not self.get_index().take(1) else []
        data, index = self.partitions(), self.partitions(self.spec.index_table)
        a, b = self._listed(self.spec.data_table), self._listed(self.spec.index_table)
        if a is not None and b is not None:
            may = [dict(x.split("=", 1) for x in r[0].split("/")) for r in a.subtract(b).collect()]
            if not may:
                return []
            kind = {p: data.schema[p].dataType for p in self.parts}
            # values in the columns' own types: 0.42 in a name may be 0.42000 in the table
            may = [{p: F.lit(None if s[p] == NULL_PARTITION else unquote(s[p])).try_cast(kind[p]) for p in self.parts} for s in may]
            data, index = data.where(partition_predicate(may, data.schema)), index.where(partition_predicate(may, index.schema))
        rows = missing_partitions(data, index, self.parts)
        return [r.asDict() for r in rows.orderBy(*self.parts).collect()]

    def append_missing_partitions(self) -> list[dict]:
        missing = self.get_missing_partitions()
        self.append_new_partitions(missing)
        return missing

    def append_new_partitions(self, specs: list[dict]) -> None:
        """Index the given partitions, replacing just those. One scan, one shuffle, no driver rows.

        Rows are dealt by partition and bucket. Adaptive execution splits what is larger than a file is to be, such
        as a hot key's bucket, which then has several files, and gives one task several small buckets.
        """
        specs = [dict(s) for s in specs]
        if not specs:
            return
        if bad := [s for s in specs if set(s) != set(self.parts)]:
            raise ValueError(f"a partition has {self.parts}: {bad}")
        data = self.spark.table(self.spec.data_table)
        if self.parts:
            data = data.where(partition_predicate(specs, data.schema))
        self._decide(data, len(specs))
        rows = self.index_rows(data)
        # the table's own order is the writer's to sort by
        rows = rows.withColumn("__bucket", bucket_of(list(self.spec.keys), self.num_buckets))
        rows = rebalanced(rows, [*[F.col(f"`{p}`") for p in self.parts], F.col("__bucket")], max(self.writer.target_file_mb, LEAST_TASK_MB) << 20).drop("__bucket")
        with settings(self.spark, {"spark.sql.sources.partitionOverwriteMode": "dynamic"}):
            rows.write.insertInto(_quoted(self.spec.index_table), overwrite=True)

    def index_rows(self, data: DataFrame) -> DataFrame:
        """The index's rows for a scan of the data table."""
        fields = [*self.spec.keys, *self.spec.more_fields]
        rows = TableIndexer(data, self.format, self.reader).create_index_df([*fields, *self.parts], self.writer.file_filter)
        if self.format == "parquet" and self.reader.chunks:
            rows = with_row_sizes(rows, data)
        return guard_decimals(rows.select(*[f"`{c}`" for c in fields], *LOCATOR, *[f"`{p}`" for p in self.parts]), self.writer.cast_decimal_to_double)

    # -- queries ----------------------------------------------------------------------------------

    def get_index(self) -> DataFrame:
        return self.spark.table(self.spec.index_table)

    def payload_fields(self, fields: list[str] | None) -> list[str]:
        """``keys + fields``; None: all columns but partitions."""
        if fields is None:
            return [c for c in self.spark.table(self.spec.data_table).columns if c not in self.parts]
        return list(dict.fromkeys([*self.spec.keys, *fields]))

    def _indexer(self) -> TableIndexer:
        return TableIndexer(self.spark.table(self.spec.data_table), self.format, self.reader)

    def load_by_index(self, index: DataFrame, fields: list[str] | None = None) -> DataFrame:
        """Payload columns of each row of ``index`` (any frame with its locator columns).

        Partition columns are those of ``index``, where it has them: they stand in no file.
        """
        own = set(self.parts) & set(index.columns)
        return self._indexer().load_by_index(index, [f for f in self.payload_fields(fields) if f not in own])

    def read_payload(self, row, fields: list[str] | None = None) -> dict:
        return next(self._payloads([row], fields))

    def _payloads(self, rows: Iterable, fields: list[str] | None) -> Iterator[dict]:
        """Payloads of index rows in their order; the rows tell their own partitions, where they have those columns."""
        rows = (r.asDict() if hasattr(r, "asDict") else dict(r) for r in rows)
        first = next(rows, None)
        if first is None:
            return
        own, asked = [p for p in self.parts if p in first], self.payload_fields(fields)
        kept, sought = tee(chain([first], rows))
        got = self._indexer().read_payloads(sought, [f for f in asked if f not in own], own)
        for row, payload in zip(kept, got, strict=True):
            yield {f: row[f] if f in own else payload[f] for f in asked}

    def _of_key(self, key, partition: dict | None) -> DataFrame:
        key = key if isinstance(key, dict) else dict(zip(self.spec.keys, key if isinstance(key, list | tuple) else [key], strict=True))
        if set(key) != set(self.spec.keys):
            raise ValueError(f"a key has {self.spec.keys}, not {list(key)}")
        df = self.get_index()
        if partition:
            df = df.where(partition_predicate([partition], df.schema))
        for k, v in key.items():
            df = df.where(F.col(f"`{k}`") == F.lit(v).cast(df.schema[k].dataType))
        return df

    def fetch(self, key, partition: dict | None = None, fields: list[str] | None = None) -> dict | None:
        """One row of the key as a dict (that of the smallest locator), or None."""
        with settings(self.spark, LOOKUP_CONF):
            found = self._of_key(key, partition).select(*LOCATOR, *[f"`{p}`" for p in self.parts]).orderBy(*LOCATOR[:3]).take(1)
        return self.read_payload(found[0], fields) if found else None

    def fetch_all(self, key, partition: dict | None = None, fields: list[str] | None = None) -> Iterator[dict]:
        """All rows of the key, in locator order: a lookup of its bucket alone, then driver-side reads of its row groups.

        The driver never holds the locators of a key with more than ``AT_ONCE`` rows: they stream.
        """
        with settings(self.spark, LOOKUP_CONF):
            every = self._of_key(key, partition).select(*LOCATOR, *[f"`{p}`" for p in self.parts]).orderBy(*LOCATOR[:3])
            found = every.take(AT_ONCE + 1)
            if len(found) > AT_ONCE:
                found = every.toLocalIterator()
        yield from self._payloads(found, fields)

    def join_with_index(self, probe: DataFrame, match: str = "first") -> DataFrame:
        if self.parts:
            for k, v in JOIN_CONF.items():
                self.spark.conf.set(k, v)
        return join_with_index(probe, self.get_index(), list(self.spec.keys), self.parts, match)

    def drop(self) -> None:
        self.spark.sql(f"DROP TABLE IF EXISTS {_quoted(self.spec.index_table)}")


__all__ = ["FILE", "IndexManager"]
