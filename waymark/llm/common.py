"""What the operators share: the shared folder, written tables, Arrow helpers, components, tokens."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows, and bytes, of what a kernel takes at once: texts may be long. A single longer row is taken alone.
BATCH_ROWS, BATCH_BYTES = 256, 2 << 20
#: Rows that Spark sends to a worker at once.
ARROW_KEY, ARROW_ROWS = "spark.sql.execution.arrow.maxRecordsPerBatch", 1000


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share, as the session names it; the warehouse's where it names none."""
    at = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    return (at or f"{spark.conf.get('spark.sql.warehouse.dir').rstrip('/')}/_shared").rstrip("/")


def new_folder(spark: SparkSession, name: str) -> str:
    """A folder of this application's own in the shared one; :func:`clean` deletes them all."""
    return f"{shared_dir(spark)}/waymark-{spark.sparkContext.applicationId}/waymark-{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` as a table in the shared folder: lineage ends there, and lost executors lose nothing."""
    spark = df.sparkSession
    path = new_folder(spark, name)
    small_batches(spark)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def _delete(spark: SparkSession, folder: str) -> None:
    p = spark._jvm.org.apache.hadoop.fs.Path(folder)
    p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


def dropped(*tables: DataFrame) -> None:
    """Delete tables made by :func:`written`, once nothing reads them any more."""
    for df in tables:
        for f in {x.rpartition("/")[0] for x in df.inputFiles()}:
            if "/waymark-" in f:
                _delete(df.sparkSession, f)


def small_batches(spark: SparkSession) -> None:
    """Texts go to workers a thousand rows at a time, unless the session has a size of its own; :func:`clean` takes that back.

    Spark reads the size when a result is planned, which is after the operator has returned.
    """
    if int(spark.conf.get(ARROW_KEY)) == 10_000:
        spark.conf.set(ARROW_KEY, str(ARROW_ROWS))


def clean(spark: SparkSession) -> None:
    """Delete what this application has written to the shared folder; results that still read from there end with it."""
    if spark.conf.get(ARROW_KEY) == str(ARROW_ROWS):
        spark.conf.unset(ARROW_KEY)
    _delete(spark, f"{shared_dir(spark)}/waymark-{spark.sparkContext.applicationId}")


def utf8(column) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of an Arrow string array, without copies; nulls have no bytes."""
    import pyarrow as pa

    column = column.cast(pa.large_string())
    if column.null_count:
        column = column.fill_null("")
    _, offsets, data = column.buffers()
    o = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    b = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return b[o[0] : o[-1]], o - o[0]


# -- words as hashes ------------------------------------------------------------------------------

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_WORD = np.zeros(256, bool)
_WORD[48:58] = _WORD[65:91] = _WORD[97:123] = _WORD[128:] = True
_TO_LOWER, _TO_WORD = _LOWER.tobytes(), _WORD.tobytes()
#: Bytes worked off at a time, so that what is made of them stays in a core's cache.
PIECE = 1 << 18
#: By rule: the low n bytes of eight.
_LOW_BYTES = np.array([(1 << (8 * n)) - 1 for n in range(9)], np.uint64)


def mixed(x: np.ndarray) -> np.ndarray:
    """A finishing mix of 64-bit values, so that all bits depend on all bits."""
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15)
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(32))


class Words:
    """Words of many texts: runs of ASCII letters, digits and non-ASCII bytes, lower-cased by ASCII.

    ``hash`` of each word, ``head`` (its first eight bytes as a number), ``length`` in bytes, and
    ``doc``, the word numbers at which texts begin and the last one ends. Texts of any length are
    worked off in pieces; a word longer than a piece makes the piece longer.
    """

    def __init__(self, data: np.ndarray, offsets: np.ndarray):
        hashes, heads, starts, lengths = [], [], [], []
        at, n = 0, len(data)
        while at < n:
            end = min(at + PIECE, n)
            while end < n and _WORD[data[end]] and _WORD[data[end - 1]]:
                more = np.nonzero(~_WORD[data[end : end + PIECE]])[0]
                end = end + int(more[0]) if len(more) else min(end + PIECE, n)
            # a text may end within the run: its words are cut there
            h, f, s, k = self._piece(data[at:end], offsets[np.searchsorted(offsets, at, "right") : np.searchsorted(offsets, end, "left")] - at)
            hashes.append(h), heads.append(f), starts.append(s + at), lengths.append(k)
            at = end
        join = lambda x, t: np.concatenate(x) if x else np.zeros(0, t)
        self.hash, self.head = join(hashes, np.uint64), join(heads, np.uint64)
        self.length, start = join(lengths, np.int64), join(starts, np.int64)
        self.doc = np.append(np.searchsorted(start, offsets[:-1], "left"), len(start))

    @staticmethod
    def _piece(data, cuts):
        low = np.zeros(len(data) + 8, np.uint8)
        raw = data.tobytes()
        low[: len(data)] = np.frombuffer(raw.translate(_TO_LOWER), np.uint8)
        inside = np.zeros(len(data) + 2, bool)
        inside[1:-1] = np.frombuffer(raw.translate(_TO_WORD), bool)
        edge = inside[1:] != inside[:-1]
        cuts = np.unique(cuts)
        joint = cuts[inside[cuts] & inside[cuts + 1]]  # where a text ends and the next begins within a run
        edges = np.nonzero(edge)[0]
        if len(joint):
            edges = np.sort(np.concatenate([edges, joint, joint]))
        starts, length = edges[::2], edges[1::2] - edges[::2]
        eight = np.ndarray(len(data) + 1, "<u8", low, strides=(1,))
        head = eight[starts] & _LOW_BYTES[np.minimum(length, 8)]
        h = mixed(head + length.astype(np.uint64))
        long, at = np.nonzero(length > 8)[0], 8
        while len(long):
            rest = eight[starts[long] + at] & _LOW_BYTES[np.minimum(length[long] - at, 8)]
            h[long] = mixed((h[long] * np.uint64(0x9E3779B97F4A7C15)) ^ rest)
            at += 8
            long = long[length[long] > at]
        return h, head, starts, length


# -- connected components -------------------------------------------------------------------------


def components(edges: DataFrame, rounds: int = 40) -> DataFrame:
    """``node, root`` (the least node of its component) for every node of ``edges(a, b)``.

    Large-star and small-star rounds, each written to the shared folder. Neighbourhoods are never
    gathered: each round takes minima, combined before the shuffle, and joins them back on nodes,
    from written tables on both sides, so that hubs' partitions can be split. No edge: no row.
    """
    e = written(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct(), "edges")
    before = None
    for _ in range(rounds):
        both = e.select(F.col("a").alias("u"), F.col("b").alias("v")).union(e.select(F.col("b").alias("u"), F.col("a").alias("v")))
        least = written(both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")), "least")
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("a"), F.col("m").alias("b"))
        e2 = written(large.where("a <> b").distinct(), "large")
        least2 = written(e2.groupBy(F.col("a").alias("u")).agg(F.min("b").alias("m")), "small")
        small = e2.join(least2, e2.a == least2.u).select(F.col("b").alias("a"), F.col("m").alias("b")).union(least2.select(F.col("u").alias("a"), F.col("m").alias("b")))
        e3 = written(small.where("a <> b").distinct(), "edges")
        state = tuple(e3.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())
        for x in (e, least, e2, least2):
            dropped(x)
        e = e3
        if state == before:
            break
        before = state
    else:
        raise RuntimeError(f"components did not settle in {rounds} rounds")
    roots = e.groupBy("a").agg(F.min("b").alias("root")).select(F.col("a").alias("node"), "root")
    return written(roots.union(e.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct()), "components")


def batches(rows: Iterator) -> Iterator:
    """What Arrow brings, in slices of bounded rows and bytes, without copies and whatever the session's own batches are."""
    for b in rows:
        for a in range(0, b.num_rows, BATCH_ROWS):
            todo = [b.slice(a, BATCH_ROWS)]
            while todo:
                part = todo.pop()
                if part.num_rows > 1 and part.nbytes > BATCH_BYTES:
                    half = part.num_rows // 2
                    todo += [part.slice(half), part.slice(0, half)]
                else:
                    yield part


def by_slices(column, f, dtype: type) -> np.ndarray:
    """``f`` over slices of one Arrow column, joined: what scalar kernels use."""
    import pyarrow as pa

    got = [f(b.column(0)) for b in batches([pa.RecordBatch.from_arrays([column], names=["x"])])]
    return np.concatenate(got) if got else np.zeros(0, dtype)
