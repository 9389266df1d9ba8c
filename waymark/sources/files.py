"""Files of a table: distributed listing, name filter, byte ranges, and opening them from Python."""

from __future__ import annotations

from functools import cache
from urllib.parse import unquote, urlsplit

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def normal_path(col: Column) -> Column:
    """``file:///x`` and ``file:/x`` are one file; the scan's two spellings are brought together."""
    return F.regexp_replace(col, "^file:/+", "file:/")


def list_files(spark: SparkSession, folders: list[tuple[dict, str]], chunk_mb: int | None = None, split: bool | None = None, name_like: str = "%") -> DataFrame:
    """One row for each byte range of each file right below the folders.

    Columns: ``partition_def`` map, ``path``, ``file``, ``start_position``, ``end_position``.
    Missing folders and empty files give no rows. Only names and lengths are read, in one scan of
    Spark's reader for all folders; what is not given comes from ``indexer.files.chunkMB`` (50) and
    ``indexer.files.chunk.split`` (true). A folder that is given twice counts once for each.
    """
    chunk_mb = int(spark.conf.get("indexer.files.chunkMB", "50")) if chunk_mb is None else chunk_mb
    split = spark.conf.get("indexer.files.chunk.split", "true").lower() == "true" if split is None else split
    if chunk_mb < 1:
        raise ValueError(f"a chunk has 1 MB at least, not {chunk_mb}")
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    there = []
    for part, folder in folders:
        p = jvm.org.apache.hadoop.fs.Path(folder)
        fs = p.getFileSystem(conf)
        if fs.exists(p):
            there.append((fs.makeQualified(p).toString().rstrip("/"), {str(k): str(v) for k, v in part.items()}, folder))
    schema = "partition_def map<string,string>, path string, file string, start_position bigint, end_position bigint"
    if not there:
        return spark.createDataFrame([], schema)
    df = spark.read.format("binaryFile").option("recursiveFileLookup", "false").load(sorted({t[0] for t in there})).select("path", "length").where("length > 0")
    df = df.select(normal_path(F.regexp_replace("path", "/[^/]*$", "")).alias("__at"), F.element_at(F.split("path", "/"), -1).alias("file"), "length")
    df = df.where(F.col("file").like(name_like) & ~F.col("file").rlike("^[._]"))
    own = spark.createDataFrame(there, "__at string, partition_def map<string,string>, path string").withColumn("__at", normal_path(F.col("__at")))
    size = F.lit(chunk_mb << 20) if split else F.col("length")
    df = df.join(F.broadcast(own), "__at")  # a row a folder, as they were given to this call
    df = df.withColumn("__n", F.explode(F.sequence(F.lit(0).cast("bigint"), F.ceil(F.col("length") / size).cast("bigint") - 1)))
    return df.select("partition_def", "path", "file", (F.col("__n") * size).alias("start_position"), F.least((F.col("__n") + 1) * size, F.col("length")).alias("end_position"))


#: Schemes that Arrow opens, and the name it knows each by.
ARROW_SCHEMES = {"": "file", "file": "file", "hdfs": "hdfs", "viewfs": "viewfs", "s3": "s3", "s3a": "s3", "s3n": "s3", "gs": "gs", "abfs": "abfs", "abfss": "abfss"}


def open_input(uri: str):
    """A seekable Arrow file for a locator's file name; names are URL-encoded by the scan."""
    import pyarrow.fs as pafs

    parts = urlsplit(uri)
    if parts.scheme in ("", "file"):
        return pafs.LocalFileSystem().open_input_file(unquote(parts.path))
    fs, path = _file_system(f"{ARROW_SCHEMES.get(parts.scheme, parts.scheme)}://{parts.netloc}")
    bucket = unquote(path).strip("/")
    return fs.open_input_file(f"{bucket}/{unquote(parts.path).lstrip('/')}" if bucket else unquote(parts.path))


@cache
def _file_system(root: str):
    """A store's file system, one a worker: making one may ask the store for its region or keys."""
    import pyarrow.fs as pafs

    return pafs.FileSystem.from_uri(f"{root}/")


@cache
def _opens(root: str) -> bool:
    """Whether this installation of Arrow has what the store needs, such as the HDFS library."""
    try:
        _file_system(root)
    except Exception:  # whatever is missing, the scan strategy takes over
        return False
    return True


def arrow_reaches(uri: str) -> bool:
    """Whether Python workers can open this store at all; else the scan strategy is taken."""
    parts = urlsplit(uri)
    if parts.scheme not in ARROW_SCHEMES:
        return False
    return ARROW_SCHEMES[parts.scheme] == "file" or _opens(f"{ARROW_SCHEMES[parts.scheme]}://{parts.netloc}")
