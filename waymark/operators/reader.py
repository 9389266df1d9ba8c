"""Locators back to rows: an Arrow seek reader, and a scan join for stores only Spark reads."""

from __future__ import annotations

import importlib
import time
from collections.abc import Iterable, Iterator
from dataclasses import replace
from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import MapType, StructType

from waymark.functions.buckets import partition_predicate
from waymark.operators.layout import rebalanced
from waymark.plans.chunks import chunked
from waymark.sources.files import arrow_reaches, normal_path, open_input
from waymark.sources.sequence import SERDE, reader_of, separators
from waymark.spec import FILE, LOCATOR, OFFSET, SIZE, SUB_OFFSET, ReaderOptions


class Reporter:
    """Hooks of the seek reader; the base class says nothing. ``start_read`` and ``end_read`` frame what is taken of one row group."""

    def partition_start(self): ...

    def open_file(self, path: str): ...

    def close_file(self, path: str, rows: int, seconds: float): ...

    def start_read(self): ...

    def end_read(self, rows: int, nbytes: int): ...

    def partition_done(self, files: int, rows: int): ...


class Metrics:
    """Accumulators of what seek readers did in all tasks: files opened, groups decoded, rows and bytes given out.

    Pass one as ``ReaderOptions(metrics=Metrics(spark))`` and read it after an action. A task run again counts again.
    """

    NAMES = ("files", "groups", "rows", "bytes")

    def __init__(self, spark: SparkSession):
        for n in self.NAMES:
            setattr(self, n, spark.sparkContext.accumulator(0))

    def values(self) -> dict[str, int]:
        return {n: getattr(self, n).value for n in self.NAMES}


class LogReporter(Reporter):
    """Says what each file took in the worker's log."""

    def close_file(self, path, rows, seconds):
        print(f"waymark: {rows} rows of {path} in {seconds:.2f} s", flush=True)


def reporter_of(x) -> Reporter:
    """None: the quiet one; ``log``; ``none``; an instance; or a dotted class name."""
    if x is None or x == "none":
        return Reporter()
    if x == "log":
        return LogReporter()
    if isinstance(x, str):
        module, _, name = x.rpartition(".")
        return getattr(importlib.import_module(module), name)()
    return x


class _Seeker:
    """One open file: row groups (Parquet), stripes (ORC) or blocks (Avro, SequenceFile) by cumulated row counts, columns pruned.

    The last group stays decoded, so that requests in order decode each group once, however they come in batches.
    """

    def __init__(self, uri: str, fmt: str, columns: list[str], layout: tuple | None = None):
        self.uri, self.columns, self.fmt = uri, columns, fmt
        self.handle = open_input(uri)
        try:
            if fmt == "parquet":
                import pyarrow.parquet as pq

                self.file = pq.ParquetFile(self.handle)
                counts = [self.file.metadata.row_group(i).num_rows for i in range(self.file.num_row_groups)]
                self._decode = lambda i: self.file.read_row_group(i, columns=columns)
            elif fmt == "avro":
                from waymark.sources.avro import AvroFile

                self.file = AvroFile(self.handle, columns)
                counts, self._decode = self.file.counts, self.file.table
            elif fmt == "sequence":
                from waymark.sources.sequence import SequenceFile

                self.file = SequenceFile(self.handle, *layout, columns)
                counts, self._decode = self.file.counts, self.file.table
            else:
                import pyarrow as pa
                import pyarrow.orc as orc

                # Arrow tells no stripe's rows without decoding one of its columns; that is done once a file, not once a batch
                self.file = orc.ORCFile(self.handle)
                counts = [self.file.nrows] if self.file.nstripes == 1 else [self.file.read_stripe(i, columns=columns[:1]).num_rows for i in range(self.file.nstripes)]
                self._decode = lambda i: pa.Table.from_batches([self.file.read_stripe(i, columns=columns)])
        except Exception:
            self.handle.close()
            raise
        import numpy as np

        self.starts = np.concatenate([[0], np.cumsum(counts)]).astype("int64")
        self.last, self.decoded, self.began, self.given = (-1, None), 0, time.time(), 0

    def group(self, i: int):
        if self.last[0] != i:
            self.last = (-1, None)  # two groups are never held
            self.last = (i, self._decode(i))
            self.decoded += 1
        return self.last[1]

    def rows(self, offsets):
        """Tables in the order of the sorted ``offsets``; repeats are read once and taken again."""
        import numpy as np

        if len(offsets) and (offsets[0] < 0 or offsets[-1] >= self.starts[-1]):
            raise IndexError(f"row {offsets[-1]} is outside the file's {self.starts[-1]} rows")
        of = np.searchsorted(self.starts, offsets, side="right") - 1
        cuts = [0, *(np.nonzero(of[1:] != of[:-1])[0] + 1), len(of)] if len(of) else [0]
        for a, b in zip(cuts[:-1], cuts[1:], strict=True):
            at = offsets[a:b] - self.starts[of[a]]
            group = self.group(int(of[a]))
            # a run of neighbours is a slice: nothing is copied
            yield group.slice(int(at[0]), len(at)) if at[-1] - at[0] == len(at) - 1 and (len(at) == 1 or (at[1:] - at[:-1] == 1).all()) else group.take(at)

    def close(self):
        self.last = (-1, None)
        self.handle.close()


def _seek(fmt: str, out_schema: StructType, kept: list[str], payload: list[str], ignore: bool, reporter, metrics: Metrics | None = None, layout: tuple | None = None) -> callable:
    """The kernel: requests come sorted by file and offset; a task opens each file once and decodes each of its groups once."""

    def run(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa
        from pyspark.sql.pandas.types import to_arrow_schema

        target = to_arrow_schema(out_schema)
        told = reporter_of(reporter)
        told.partition_start()
        files = total = 0
        seeker: _Seeker | None = None
        bad = None  # a file that can't be opened isn't tried again for each batch

        def leave():
            nonlocal seeker
            if seeker is not None:
                seeker.close()
                told.close_file(seeker.uri, seeker.given, time.time() - seeker.began)
                if metrics is not None:
                    metrics.groups.add(seeker.decoded)
                seeker = None

        try:
            for batch in batches:
                if not batch.num_rows:
                    continue
                table = pa.Table.from_batches([batch])
                names = np.array([n or "" for n in table.column(FILE).to_pylist()], dtype=object)
                offsets = table.column(OFFSET).to_numpy()
                order = np.lexsort((offsets, names))
                if (np.diff(order) != 1).any():
                    table, names = table.take(order), names[order]
                cuts = [0, *(np.nonzero(names[1:] != names[:-1])[0] + 1), len(names)]
                for a, b in zip(cuts[:-1], cuts[1:], strict=True):
                    part = table.slice(a, b - a)
                    if seeker is None or seeker.uri != names[a]:
                        leave()
                        if ignore and bad == names[a]:
                            continue
                        try:
                            told.open_file(names[a])
                            seeker = _Seeker(names[a], fmt, payload, layout)
                        except Exception:
                            if not ignore:
                                raise
                            bad = names[a]
                            continue
                        files += 1
                    offsets = part.column(OFFSET).to_numpy()
                    if ignore:
                        good = (offsets >= 0) & (offsets < seeker.starts[-1])
                        part, offsets = part.filter(pa.array(good)), offsets[good]
                    at = 0
                    told.start_read()
                    for got in seeker.rows(offsets):
                        own = part.slice(at, got.num_rows)
                        at += got.num_rows
                        cols = [own.column(c) for c in kept] + [got.column(c) for c in payload]
                        cols = [c.cast(f.type) for c, f in zip(cols, target, strict=True)]
                        out = pa.Table.from_arrays(cols, schema=target)
                        told.end_read(out.num_rows, out.nbytes)
                        if metrics is not None:
                            metrics.bytes.add(out.nbytes)
                        total += out.num_rows
                        seeker.given += out.num_rows
                        yield from out.to_batches(max_chunksize=10_000)
        finally:
            leave()
        told.partition_done(files, total)
        if metrics is not None:
            metrics.files.add(files)
            metrics.rows.add(total)

    return run


#: Names of the zone without offset or changes.
UTC = ("UTC", "Etc/UTC", "GMT", "Z", "Universal", "Zulu")


def _seekable(fmt: str, payload: StructType, data: DataFrame) -> bool:
    """Whether rows of the format can be sought from Python. Times in text, and in Avro outside UTC, depend on the
    SerDe's reading of them, and partition columns stand in no file."""
    if set(payload.names) & _partition_columns(data):
        return False
    if fmt == "sequence":
        layout = text_layout(data, fmt)
        return layout is not None and all(reader_of(f.dataType, layout[1]) for f in payload)
    if fmt == "avro" and "timestamp" in payload.simpleString():
        # the scan reads them by the JVM's zone, which the reader knows for UTC alone
        return data.sparkSession._jvm.java.util.TimeZone.getDefault().getID() in UTC
    return fmt in ("parquet", "orc", "avro")


def _tables(df: DataFrame) -> list:
    """Scans of Hive's tables in the analysed plan."""
    plan = df._jdf.queryExecution().analyzed().collectLeaves()
    return [plan.apply(i) for i in range(plan.size()) if plan.apply(i).getClass().getSimpleName() == "HiveTableRelation"]


def _partition_columns(data: DataFrame) -> set[str]:
    kinds = [leaf.relation().partitionSchema() for leaf in _leaves(data)] + [t.tableMeta().partitionSchema() for t in _tables(data)]
    return {n for k in kinds for n in k.fieldNames()}


def text_layout(data: DataFrame, fmt: str) -> tuple[StructType, list[bytes]] | None:
    """Columns in their order in a row's text, and its separators, of a table of SequenceFiles that Hive's simple
    SerDe reads; None for other SerDes, or where the table asks it for more than separators."""
    tables = _tables(data) if fmt == "sequence" else []
    if len(tables) != 1:
        return None
    meta = tables[0].tableMeta()
    serde, props = meta.storage().serde(), meta.storage().properties()
    keys = props.keys().toSeq()
    seps = separators({keys.apply(i): props.apply(keys.apply(i)) for i in range(keys.size())})
    if serde.isEmpty() or serde.get() != SERDE or seps is None:
        return None
    own = set(meta.dataSchema().fieldNames())
    return StructType([f for f in data.schema if f.name in own]), seps


def _root(data: DataFrame) -> str | None:
    """A root folder or file of a plain scan, without listing what is in it."""
    for leaf in _leaves(data):
        roots = leaf.relation().location().rootPaths()
        return roots.head().toString() if roots.nonEmpty() else None
    return None


def _leaves(df: DataFrame) -> list:
    """Scans of files in the analysed plan."""
    plan, out = df._jdf.queryExecution().analyzed().collectLeaves(), []
    for i in range(plan.size()):
        leaf = plan.apply(i)
        if leaf.getClass().getSimpleName() == "LogicalRelation" and leaf.relation().getClass().getSimpleName() == "HadoopFsRelation":
            out.append(leaf)
    return out


def _reached(data: DataFrame) -> bool:
    """Whether Python workers can open the data's files, told from the scan's root alone where it has one."""
    root = _root(data)
    if root is not None:
        return arrow_reaches(root)
    files = data._jdf.inputFiles()  # stays in the JVM: one name is enough
    return len(files) > 0 and arrow_reaches(files[0])


#: Rows of a file that one task serves: of large data, so many that a row group is seldom decoded by several tasks;
#: of data that are less than TASK_BYTES a core, so few that all cores have a part.
LARGE_RANGE, SMALL_RANGE, TASK_BYTES = 1 << 20, 1 << 17, 128 << 20
RANGE = "__range"
#: Shuffled bytes of requests that a task sorts at most, about: sorted rows take some 20 times as much.
MOST_SHUFFLED = 24 << 20


def range_rows(data: DataFrame) -> int:
    """Rows of a file for one task, by what the catalog or the scan's own listing says of the data's size."""
    sizes = [leaf.relation().sizeInBytes() for leaf in _leaves(data)]
    small = sizes and sum(sizes) < TASK_BYTES * data.sparkSession.sparkContext.defaultParallelism
    return SMALL_RANGE if small else LARGE_RANGE


def task_bytes(spark: SparkSession) -> int:
    """Shuffled bytes of requests for one task: ``MOST_SHUFFLED``, or the session's own size where that is less."""
    return min(MOST_SHUFFLED, spark._jsparkSession.sessionState().conf().getConf(spark._jvm.org.apache.spark.sql.internal.SQLConf.ADVISORY_PARTITION_SIZE_IN_BYTES()))


def load_rows(index: DataFrame, payload: StructType, fmt: str, data: DataFrame, options: ReaderOptions) -> DataFrame:
    """One row for each request; columns of ``index`` without locators and payload names, then the payload.

    Requests are dealt by file and row range, so a large file's requests are shared by many tasks; adaptive
    execution gives a range that is asked for over and over to several.
    """
    names = payload.fieldNames()
    kept = [c for c in index.columns if c not in names and c not in LOCATOR]
    schema = StructType([index.schema[c] for c in kept] + list(payload))
    strategy = options.strategy
    if strategy == "auto":
        strategy = "seek" if _seekable(fmt, payload, data) and _reached(data) else "scan"
    if strategy == "scan" or not _seekable(fmt, payload, data):
        return _scan_join(index, kept, names, fmt, data, options)
    options = replace(options, rows_per_task=options.rows_per_task or range_rows(data))
    need = index.select(*[f"`{c}`" for c in kept], *LOCATOR)
    if options.chunks:
        need = chunked(need, options)
    else:
        # the kernel takes the file and the row alone; what else a locator has would be sorted for nothing
        need = need.drop(SUB_OFFSET, SIZE).withColumn(RANGE, F.floor(F.col(OFFSET) / options.rows_per_task))
        need = rebalanced(need, [F.col(FILE), F.col(RANGE)], task_bytes(data.sparkSession)).drop(RANGE).sortWithinPartitions(FILE, OFFSET)
    return need.mapInArrow(_seek(fmt, schema, kept, names, options.ignore_failures, options.reporter, options.metrics, text_layout(data, fmt)), schema)


def _scan_join(index: DataFrame, kept: list[str], names: list[str], fmt: str, data: DataFrame, options: ReaderOptions) -> DataFrame:
    from waymark.sources.indexer import with_locators

    rows = with_locators(data, fmt).select(*[F.col(f"`{n}`").alias(f"__p_{i}") for i, n in enumerate(names)], F.col(FILE).alias("__f"), F.col(OFFSET).alias("__o"))
    own = index.select(*[f"`{c}`" for c in kept], normal_path(F.col(FILE)).alias("__rf"), F.col(OFFSET).alias("__ro"))
    got = own.join(rows, (F.col("__rf") == F.col("__f")) & (F.col("__ro") == F.col("__o")), "inner" if options.ignore_failures else "left")
    if not options.ignore_failures:
        got = got.withColumn("__ok", F.when(F.col("__f").isNull(), F.raise_error(F.concat(F.lit("no row at "), F.coalesce("__rf", F.lit("null"))))).otherwise(F.lit(True))).where("__ok")
    return got.select(*[f"`{c}`" for c in kept], *[F.col(f"__p_{i}").alias(n) for i, n in enumerate(names)])


def _as_rows_have_it(v):
    """Instants as Spark's rows have them in Python: local, without a zone; in lists, maps and records too."""
    if isinstance(v, datetime) and v.tzinfo is not None:
        return v.astimezone().replace(tzinfo=None)
    if isinstance(v, dict):
        return {k: _as_rows_have_it(x) for k, x in v.items()}
    return type(v)(map(_as_rows_have_it, v)) if isinstance(v, list | tuple) else v


def read_one(spark: SparkSession, locator, payload: StructType, fmt: str, data: DataFrame) -> dict:
    """One locator's payload as a dict, on the driver, without executors where Arrow reaches the file."""
    return next(read_many(spark, [locator], payload, fmt, data))


def read_many(spark: SparkSession, locators: Iterable, payload: StructType, fmt: str, data: DataFrame, parts: Iterable[str] = ()) -> Iterator[dict]:
    """Payloads as dicts, in the order of the locators; neighbours of one file share an open file and its decoded group.

    Where a scan has to find the row, it reads the locator's partition alone, by the values of ``parts`` beside it.
    """
    names, seeker = payload.fieldNames(), None
    layout, seeks = text_layout(data, fmt), _seekable(fmt, payload, data)
    maps = {n for n in names if isinstance(payload[n].dataType, MapType)}
    try:
        for locator in locators:
            at = locator.asDict() if hasattr(locator, "asDict") else dict(locator)
            if seeks and arrow_reaches(at[FILE]):
                import numpy as np

                if seeker is None or seeker.uri != at[FILE]:
                    if seeker is not None:
                        seeker.close()
                    seeker = _Seeker(at[FILE], fmt, names, layout)
                row = _as_rows_have_it(next(seeker.rows(np.array([at[OFFSET]], "int64"))).to_pylist()[0])
                yield {n: dict(row[n]) if n in maps and row[n] is not None else row[n] for n in names}
            else:
                one = spark.createDataFrame([(at[FILE], at[OFFSET], 0, -1)], ", ".join(f"{n} {t}" for n, t in zip(LOCATOR, ("string", "bigint", "int", "int"), strict=True)))
                near = data.where(partition_predicate([{p: at[p] for p in parts}], data.schema)) if parts else data
                yield _scan_join(one, [], names, fmt, near, ReaderOptions()).take(1)[0].asDict()
    finally:
        if seeker is not None:
            seeker.close()
