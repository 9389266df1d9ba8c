"""What keeps tasks small as tables grow."""

import uuid

from pyspark.sql import functions as F

from waymark import IndexManager, ReaderOptions, TableIndexer, queries
from waymark.operators import reader
from waymark.operators.layout import rebalanced
from waymark.operators.reader import Metrics
from waymark.queries import QUERIES


def in_files(spark, sf, table, folder, n=4, times=1):
    """A table's rows as ``n`` files in a folder of their own, keys shifted where they are repeated."""
    df = spark.read.parquet(f"{sf}/{table}.parquet")
    key = df.columns[0]
    df = df.crossJoin(spark.range(times).withColumnRenamed("id", "__i")).withColumn(key, F.col(key) + F.col("__i") * 1_000_000).drop("__i")
    df.repartition(n).write.parquet(f"{folder}/{table}.parquet")
    return str(folder)


def test_partitions_written_by_many(spark, sf, tmp_path):
    """No single task writes a partition of a table, however few partitions it has."""
    d, before = in_files(spark, sf, "lineitem", tmp_path), {t.name for t in spark.catalog.listTables()}
    assert QUERIES["manager_missing"](spark, d).count() == 2
    name = next(t.name for t in spark.catalog.listTables() if t.name not in before and not t.name.endswith("_index"))
    for flag in ("A", "N", "R"):
        assert len(spark.table(name).where(F.col("l_returnflag") == flag).select(F.input_file_name()).distinct().collect()) > 1


def test_sized_rebalance(spark):
    """Tasks are as large as the frame asks for, not as the session does; an index's files follow its own target."""
    key, name = "spark.sql.adaptive.advisoryPartitionSizeInBytes", f"d_{uuid.uuid4().hex[:8]}"
    df = spark.range(0, 200_000, 1, 8).withColumn("k", F.lit(1))
    tasks = [len(rebalanced(df, [F.col("k")], most).groupBy(F.spark_partition_id()).agg(F.sum("id")).collect()) for most in (16 << 10, 64 << 20)]
    assert tasks[0] > 1 and tasks[1] == 1
    df.write.saveAsTable(name)
    m = IndexManager.create_new(spark, name, f"{name}_i", ["id"], num_buckets=2)
    spark.conf.set(key, "16k")
    try:
        m.append_missing_partitions()
    finally:
        spark.conf.unset(key)
    assert len(m.get_index().inputFiles()) == 2 and m.get_index().count() == 200_000


def test_tasks_of_requests(spark, sf, monkeypatch):
    """A task's requests are bounded by the reader, where the session's own size would let one task have them all."""
    monkeypatch.setattr(reader, "MOST_SHUFFLED", 16 << 10)
    seen = Metrics(spark)
    one = TableIndexer.parquet(spark, f"{sf}/orders.parquet", options=ReaderOptions(metrics=seen))
    asked = spark.range(0, 200_000, 1, 8).withColumnRenamed("id", "n").crossJoin(F.broadcast(one.create_index_df(["o_orderkey"]).where("o_orderkey = 7")))
    got = one.load_by_index(asked, ["o_totalprice"]).groupBy("o_orderkey").agg(F.count("o_totalprice").alias("rows"), F.countDistinct("n").alias("n")).collect()
    assert [(r["rows"], r["n"]) for r in got] == [(200_000, 200_000)] and seen.values()["files"] > 1


def test_files_without_moving_rows(spark, sf, tmp_path, monkeypatch):
    """A table is put into so many files without a shuffle of its rows; none is lost, and the files are alike."""
    monkeypatch.setattr(type(spark.range(0)), "repartition", None)
    assert [tuple(r) for r in QUERIES["files_listed"](spark, sf).collect()] == [("a", 5, 5)]
    df = spark.read.parquet(f"{sf}/lineitem.parquet")
    queries._save_files(spark, df, 5, str(tmp_path / "f"))
    got = spark.read.parquet(str(tmp_path / "f"))
    per = [r["count"] for r in got.groupBy(F.input_file_name()).count().collect()]
    assert len(per) == 5 and max(per) - min(per) <= 1 and got.columns == df.columns and got.exceptAll(df).isEmpty() and df.exceptAll(got).isEmpty()
    queries._save_files(spark, df.limit(0), 5, str(tmp_path / "none"))
    assert spark.read.schema(df.schema).parquet(str(tmp_path / "none")).isEmpty()


def test_files_of_buckets(spark, sf, tmp_path):
    """Where a partition's index has several buckets, each is one file."""
    d, key = in_files(spark, sf, "orders", tmp_path, times=120), "index.manager.targetFileSizeMB"
    spark.conf.set(key, "1")
    try:
        got = QUERIES["index_files"](spark, d).collect()
        assert queries._manager(spark, d, "orders", ["o_orderkey"], ["o_custkey"], "o_orderstatus").num_buckets > 1
    finally:
        spark.conf.unset(key)
    assert len(got) == 3 and {r["files"] for r in got} == {1} and sum(r["n"] for r in got) == spark.read.parquet(f"{d}/orders.parquet").count()
