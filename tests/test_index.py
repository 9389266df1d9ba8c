"""Lifecycle of an index, after the invariants every format must keep."""

import datetime
import uuid
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from waymark import IndexManager, IndexSpec, KVFile, KVFolder, KVOptions, KVWriter, ReaderOptions, TableIndexer, WriterOptions, write_kv, write_partitioned_kv
from waymark.functions.buckets import SPELT_OUT, partition_predicate
from waymark.operators import reader
from waymark.operators.join import join_with_index
from waymark.operators.layout import co_partition
from waymark.operators.reader import Metrics, Reporter
from waymark.plans.chunks import bucket_count, sampled_size, tree_height
from waymark.sources.files import ARROW_SCHEMES, arrow_reaches, list_files
from waymark.spec import FILE, OFFSET
from waymark.streaming.append import index_stream, read_stream_index


def rows(df):
    return sorted(map(str, df.select(*sorted(df.columns)).collect()))


def make(spark, n=300, fmt="parquet", parts=True):
    name = f"d_{uuid.uuid4().hex[:8]}"
    df = spark.range(1, n + 1, 1, 3).select(
        F.concat(F.lit("msg_"), "id").alias("id_col"), F.concat(F.lit("meta_"), "id").alias("meta_field"), F.concat(F.lit("var_a_"), "id").alias("var1"), F.col("id").cast("int").alias("var2"),
        F.create_map(F.lit("k"), F.concat(F.lit("v"), "id")).alias("var_map"), F.array(F.col("id")).alias("arr"), F.when(F.col("id") > n // 2, "2021-02-03").otherwise("2021-02-04").alias("dt"),
    )
    w = df.write.format(fmt).option("parquet.block.size", 4096).option("orc.stripe.size", 4096)
    (w.partitionBy("dt") if parts else w).saveAsTable(name)
    return name


@pytest.fixture(scope="module", params=["parquet", "orc"])
def made(spark, request):
    name = make(spark, fmt=request.param)
    m = IndexManager.create_new(spark, name, f"{name}_i", ["id_col"], ["meta_field"], num_buckets=4)
    missing = m.get_missing_partitions()
    m.append_missing_partitions()
    return m, spark.table(name), missing


def test_fill_and_reopen(spark, made):
    m, data, missing = made
    assert [x["dt"] for x in missing] == ["2021-02-03", "2021-02-04"]
    assert m.get_missing_partitions() == []
    assert m.get_index().count() == data.count() == m.get_index().select(FILE, OFFSET).distinct().count()
    again = IndexManager.load(spark, m.spec.index_table)
    assert again.spec == m.spec and again.num_buckets == 4
    m.append_new_partitions([{"dt": "2021-02-03"}])  # idempotent
    assert m.get_index().count() == 300
    with pytest.raises(ValueError):
        IndexManager.create_new(spark, m.spec.data_table, m.spec.index_table, ["id_col"])
    with pytest.raises(ValueError):
        m.append_new_partitions([{"x": 1}])


def test_locations(spark, made):
    """Folders as the catalog has them: of the index, of the data, and of a partition of each."""
    m, data, _ = made
    at = {"dt": "2021-02-03"}
    for table, folder in ((m.spec.index_table, m.index_folder), (m.spec.data_table, m.partition_location())):
        assert folder.rstrip("/").endswith(table) and m.partition_location(at, table) == f"{folder}/dt=2021-02-03"
    assert spark.read.parquet(m.partition_location(at, m.spec.index_table)).count() == m.get_index().where("dt = '2021-02-03'").count()


def test_files_of_index(spark, made):
    """Each bucket of each partition is one file, in key order, written with the options asked for."""
    import pyarrow.parquet as pq

    m, _, _ = made
    files = [f.removeprefix("file:").replace("///", "/") for f in m.get_index().inputFiles()]
    assert len(files) == 2 * 4
    for f in files:
        keys = pq.read_table(f, partitioning=None).column("id_col").to_pylist()
        assert keys == sorted(keys)
        assert pq.ParquetFile(f).metadata.row_group(0).column(0).compression == "ZSTD"


def test_partitions_by_the_catalog(spark):
    """Names that need escapes, nulls and numbers; a partition of the catalog without rows isn't missing."""
    name = f"d_{uuid.uuid4().hex[:8]}"
    rows_ = [(i, Decimal(i) / 4 if i % 5 else None, f"a b/{i % 4}=%" if i % 3 else None) for i in range(60)]
    spark.createDataFrame(rows_, "id int, p decimal(10,5), q string").write.partitionBy("p", "q").saveAsTable(name)
    spark.sql(f"ALTER TABLE {name} ADD PARTITION (p = 99, q = 'none')")
    m = IndexManager.create_new(spark, name, f"{name}_i", ["id"], num_buckets=2)
    first = m.get_missing_partitions()
    assert len(first) > SPELT_OUT and {(r["p"], r["q"]) for r in first} == {(r[1], r[2]) for r in rows_}
    m.append_new_partitions(first[:20])
    assert m.get_missing_partitions() == first[20:]
    m.append_missing_partitions()
    assert m.get_missing_partitions() == []
    assert rows(m.get_index().select("id", "p", "q")) == rows(spark.table(name))


def test_hot_key_streams(spark, monkeypatch):
    name = f"d_{uuid.uuid4().hex[:8]}"
    spark.range(50).select(F.lit("one").alias("k"), "id").coalesce(1).write.saveAsTable(name)
    m = IndexManager.create_new(spark, name, f"{name}_i", ["k"], num_buckets=2)
    m.append_missing_partitions()
    monkeypatch.setattr("waymark.manager.AT_ONCE", 7)
    assert [r["id"] for r in m.fetch_all("one", fields=["id"])] == list(range(50))
    assert m.fetch("one", fields=["id"])["id"] == 0 and m.fetch("two") is None


def test_row_sizes(spark):
    """Every file has a size, in all partition folders."""
    name = make(spark)
    m = IndexManager.create_new(spark, name, f"{name}_i", ["id_col"], num_buckets=2, reader=ReaderOptions(chunks=True))
    m.append_missing_partitions()
    assert m.get_index().where("data_size < 1 or data_size is null").count() == 0


def test_load(spark, made):
    m, data, _ = made
    assert rows(m.load_by_index(m.get_index())) == rows(data)
    some = m.get_index().where("meta_field like '%1'")
    three = some.union(some).union(some)
    got = m.load_by_index(three, ["var1"])
    assert got.columns == ["meta_field", "dt", "id_col", "var1"] and got.count() == 3 * some.count()
    chunked = IndexManager.load(spark, m.spec.index_table, reader=ReaderOptions(chunks=True, max_bytes=1000, debug=True))
    assert rows(chunked.load_by_index(three, ["var1"])) == rows(got)
    scan = IndexManager.load(spark, m.spec.index_table, reader=ReaderOptions(strategy="scan"))
    assert rows(scan.load_by_index(three, ["var1"])) == rows(got)
    assert m.load_by_index(some.limit(0), ["var1"]).count() == 0


def test_fetch(made):
    m, _, _ = made
    at = {"dt": "2021-02-04"}
    assert m.fetch("msg_7", at, ["var2", "var_map"]) == {"id_col": "msg_7", "var2": 7, "var_map": {"k": "v7"}}
    assert m.fetch(["msg_7"], {"dt": "2021-02-03"}) is None and m.fetch("none") is None and m.fetch([None]) is None
    assert m.fetch({"id_col": "msg_9"})["arr"] == [9]
    with pytest.raises(ValueError):
        m.fetch({"var1": 1})
    assert list(m.fetch_all("none")) == []


def test_bad_locators(spark, made):
    m, _, _ = made
    bad = m.get_index().limit(3).withColumn(OFFSET, F.lit(10**9).cast("bigint"))
    lost = m.get_index().limit(2).withColumn(FILE, F.lit("file:/nowhere.parquet"))
    mixed = m.get_index().limit(5).union(bad).union(lost)
    with pytest.raises(Exception):  # noqa: B017
        m.load_by_index(mixed, ["var1"]).collect()
    for strategy in ("seek", "scan"):
        lax = IndexManager.load(spark, m.spec.index_table, reader=ReaderOptions(ignore_failures=True, strategy=strategy))
        assert lax.load_by_index(mixed, ["var1"]).count() == 5


def test_files_open_once(spark, tmp_path):
    """A task opens each of its files once and decodes each of its groups once, however small Arrow's batches are."""
    one, many = str(tmp_path / "one"), str(tmp_path / "many")
    df = spark.range(0, 60_000, 1, 1).withColumn("v", F.col("id") * 3)
    df.write.parquet(one)
    df.write.option("parquet.block.row.count.limit", 7000).parquet(many)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "500")
    try:
        for path, groups in ((one, 1), (many, 9)):
            told = Metrics(spark)
            t = TableIndexer.parquet(spark, path, options=ReaderOptions(strategy="seek", metrics=told))
            got = t.load_by_index(t.create_index_df(["id"]).where("id % 4 <> 1"), ["v"])
            assert got.agg(F.sum("v"), F.count("v")).first() == (3 * sum(i for i in range(60_000) if i % 4 != 1), 45_000)
            assert told.values() == {"files": 1, "groups": groups, "rows": 45_000, "bytes": told.bytes.value} and told.bytes.value >= 45_000 * 16
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_ranges_by_size(spark, tmp_path, monkeypatch):
    """Small data are shared by all cores; large data in ranges that row groups fit in."""
    path = str(tmp_path / "d")
    spark.range(1000).write.parquet(path)
    df = spark.read.parquet(path)
    assert reader.range_rows(df) == reader.SMALL_RANGE
    monkeypatch.setattr(reader, "TASK_BYTES", 1)
    assert reader.range_rows(df) == reader.LARGE_RANGE
    t = TableIndexer(df, "parquet", ReaderOptions(rows_per_task=100))
    assert t.load_by_index(t.create_index_df(["id"])).count() == 1000


def test_fetch_all_opens_once(spark, monkeypatch):
    name = f"d_{uuid.uuid4().hex[:8]}"
    spark.range(300).select(F.lit(1).alias("k"), "id").repartition(2).write.saveAsTable(name)
    m = IndexManager.create_new(spark, name, f"{name}_i", ["k"], num_buckets=2)
    m.append_missing_partitions()
    opened = []
    plain = reader.open_input
    monkeypatch.setattr(reader, "open_input", lambda uri: (opened.append(uri), plain(uri))[1])
    assert sorted(r["id"] for r in m.fetch_all(1, fields=["id"])) == list(range(300)) and len(opened) == 2


def test_schemes():
    assert arrow_reaches("/a/b") and arrow_reaches("file:/a/b") and not arrow_reaches("wasbs://c@a/b") and not arrow_reaches("odd://x/y")
    assert {s: ARROW_SCHEMES[s] for s in ("s3a", "abfss", "viewfs")} == {"s3a": "s3", "abfss": "abfss", "viewfs": "viewfs"}


def test_partitions_prune(spark):
    """Predicates compare in the columns' own types, so that they become partition filters, few or many."""
    name = f"d_{uuid.uuid4().hex[:8]}"
    spark.range(60).select("id", (F.col("id") % 30).cast("int").alias("p"), F.to_date(F.lit("2024-01-01")).alias("day")).write.partitionBy("p", "day").saveAsTable(name)
    df = spark.table(name)
    for n in (1, 2, SPELT_OUT + 4):
        some = df.where(partition_predicate([{"p": i, "day": "2024-01-01"} for i in range(n)], df.schema))
        plan = some._jdf.queryExecution().executedPlan().toString()
        part = plan[plan.index("PartitionFilters") :]
        assert "p#" in part.split("PushedFilters")[0] and (n > SPELT_OUT or "cast(p#" not in part)
        assert some.count() == 2 * n
    assert df.where(partition_predicate([{"p": None, "day": None}], df.schema)).count() == 0


def test_sizing(spark):
    """Buckets are counted for a partition, not for the table; an index defined before its data is sized by the first append."""
    name = f"d_{uuid.uuid4().hex[:8]}"
    spark.range(0, 200_000, 1, 8).select(F.sha2(F.col("id").cast("string"), 256).alias("k"), (F.col("id") % 8).cast("int").alias("p")).repartition("p").write.partitionBy("p").saveAsTable(name)
    total = bucket_count(*sampled_size(spark.table(name), ["k"], 1.0), 1)
    assert 12 <= total <= 20
    m = IndexManager.create_new(spark, name, f"{name}_i", ["k"], writer=WriterOptions(target_file_mb=1))
    assert 1 <= m.num_buckets <= 3
    m.append_missing_partitions()
    assert len(m.get_index().inputFiles()) <= 8 * m.num_buckets and m.get_index().count() == 200_000
    empty = f"d_{uuid.uuid4().hex[:8]}"
    spark.sql(f"CREATE TABLE {empty} (k string) USING parquet")
    e = IndexManager.create_new(spark, empty, f"{empty}_i", ["k"], writer=WriterOptions(target_file_mb=1))
    assert e.num_buckets == 1 and e.append_missing_partitions() == [{}] and e.num_buckets == 1
    spark.table(name).select("k").write.insertInto(empty)
    e.append_missing_partitions()
    assert e.num_buckets == total and e.get_index().count() == 200_000 and e.get_missing_partitions() == []


def test_first_of_hot_key(spark):
    """A key of a million rows is one row a task before anything is moved."""
    index = spark.range(0, 1_000_000, 1, 8).select(F.when(F.col("id") % 100 == 7, F.col("id")).otherwise(F.lit(-1)).alias("k"), F.lit("f").alias(FILE), F.col("id").alias(OFFSET), F.lit(0).alias("data_sub_offset"), F.lit(-1).alias("data_size"))
    got = {r["k"]: r[OFFSET] for r in join_with_index(spark.createDataFrame([(-1,), (7,), (8,)], "k bigint"), index, ["k"], []).collect()}
    assert got == {-1: 0, 7: 7}


def test_join(spark, made):
    m, data, _ = made
    probe = data.where("var2 % 3 = 0").select("dt", "id_col", F.col("var2").alias("p")).union(spark.createDataFrame([("2021-02-03", "none", 1), ("1999", "msg_1", 1), ("2021-02-04", None, 5)], "dt string, id_col string, p int"))
    for how in ("first", "all"):
        got = m.join_with_index(probe, how)
        assert got.count() == 100 and got.columns[:4] == ["dt", "id_col", "p", "meta_field"]
    none = m.join_with_index(probe.where("dt = '1999'"))
    assert none.count() == 0 and "meta_field" in none.columns
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        plan = m.join_with_index(probe, "all")._jdf.queryExecution().executedPlan().toString()
        assert plan.count("Exchange hashpartitioning") == 1, plan
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
        spark.conf.unset("spark.sql.adaptive.enabled")


def test_not_unique(spark):
    name = f"n_{uuid.uuid4().hex[:8]}"
    spark.createDataFrame([(f"k_{i - (1 - i % 2)}", f"v_{i}") for i in range(1, 31)] + [(None, "n")], "key string, val string").repartition(3).write.saveAsTable(name)
    m = IndexManager.create_new(spark, name, f"{name}_i", ["key"])
    m.append_missing_partitions()
    assert m.get_missing_partitions() == []
    both = sorted(x["val"] for x in m.fetch_all("k_1"))
    assert both == ["v_1", "v_2"] and m.fetch("k_1")["val"] in both and m.fetch("k_2") is None
    probe = spark.createDataFrame([("k_1",), ("k_1",), ("k_3",), (None,)], "key string")
    assert m.join_with_index(probe).count() == 3 and m.join_with_index(probe, "all").count() == 6
    m.drop()
    assert not spark.catalog.tableExists(m.spec.index_table)


def test_types(spark):
    name = f"t_{uuid.uuid4().hex[:8]}"
    data = [(i, Decimal(i) / 4, i % 2 == 0, float(i), datetime.date(2020, 1, 1), datetime.datetime(2020, 1, 1, 1, 2, i), bytes([i]), {"a": [i]}) for i in range(40)]
    spark.createDataFrame(data, "id bigint, d decimal(10,5), b boolean, f float, day date, ts timestamp_ntz, raw binary, m map<string,array<int>>").write.saveAsTable(name)
    m = IndexManager.create_new(spark, name, f"{name}_i", ["d", "id"], writer=WriterOptions(cast_decimal_to_double=True))
    m.append_missing_partitions()
    assert dict(m.get_index().dtypes)["d"] == "double"
    back = m.load_by_index(m.get_index())
    assert back.schema["d"].dataType == spark.table(name).schema["d"].dataType
    assert rows(back) == rows(spark.table(name))
    own = IndexManager.create_new(spark, name, f"{name}_j", ["d"])
    own.append_missing_partitions()
    assert own.fetch(Decimal("2.25"))["id"] == 9
    with pytest.raises(ValueError):
        IndexManager.create_new(spark, name, f"{name}_k", ["m"])


def test_manual(spark, sf):
    one = TableIndexer.parquet(spark, f"{sf}/lineitem.parquet")
    index = one.create_index_df(["l_orderkey", "l_linenumber"]).where("l_orderkey % 100 = 7")
    want = spark.read.parquet(f"{sf}/lineitem.parquet").where("l_orderkey % 100 = 7").select("l_orderkey", "l_linenumber", "l_extendedprice", "l_shipdate")
    assert rows(one.load_by_index(index, ["l_extendedprice", "l_shipdate"])) == rows(want)
    at = index.first()
    assert set(one.read_payload(at, ["l_tax"])) == {"l_tax"}
    assert one.create_index_df(["l_orderkey"], "no%").count() == 0


def test_text(spark, tmp_path):
    (tmp_path / "a").write_text("".join(f"line {i}\n" for i in range(50)))
    one = TableIndexer.text(spark, str(tmp_path / "a"))
    index = one.create_index_df(["value"])
    assert sorted(r[OFFSET] for r in index.collect()) == list(range(50))
    assert one.read_payload(index.where("value = 'line 33'").first()) == {"value": "line 33"}


def test_files(spark, tmp_path):
    (tmp_path / "x.bin").write_bytes(b"1" * (5 << 20))
    (tmp_path / "y.bin").write_bytes(b"1")
    (tmp_path / "z.bin").write_bytes(b"")
    got = list_files(spark, [({"dt": "a'b"}, str(tmp_path)), ({"dt": "2"}, str(tmp_path / "none"))], chunk_mb=2)
    assert sorted((r.file, r.start_position, r.end_position) for r in got.collect()) == [("x.bin", 0, 2 << 20), ("x.bin", 2 << 20, 4 << 20), ("x.bin", 4 << 20, 5 << 20), ("y.bin", 0, 1)]
    assert got.select("partition_def.dt").distinct().first()[0] == "a'b"
    assert list_files(spark, [({}, str(tmp_path / "none"))]).count() == 0
    assert list_files(spark, [({}, str(tmp_path))], split=False, name_like="x%").count() == 1
    spark.conf.set("indexer.files.chunkMB", "1")
    try:
        assert list_files(spark, [({}, str(tmp_path))], name_like="x%").count() == 5
        spark.conf.set("indexer.files.chunk.split", "false")
        assert list_files(spark, [({"a": 1}, str(tmp_path)), ({"a": 2}, str(tmp_path))], name_like="x%").count() == 2
    finally:
        spark.conf.unset("indexer.files.chunkMB")
        spark.conf.unset("indexer.files.chunk.split")


def test_kv(spark, tmp_path):
    folder = str(tmp_path / "kv")
    df = spark.range(100).select("id", (F.col("id") * 2).alias("val1"), F.when(F.col("id") < 50, "small").otherwise("big").alias("prt"))
    write_partitioned_kv(df, ["id"], folder, [({"prt": "small"}, 3), ({"prt": "big"}, 50)])
    kv = KVFolder(spark, folder)
    assert all(kv.get([i], {"prt": "small"}).val1 == 2 * i for i in (0, 7, 49)) and kv.get([60], {"prt": "big"}).val1 == 120
    assert kv.get([60], {"prt": "small"}) is None and kv.get([1], {"prt": "other"}) is None and kv.scan().count() == 100
    write_kv(df.union(df).drop("prt"), ["id"], str(tmp_path / "kv2"), 4)
    assert len(list(KVFolder(spark, str(tmp_path / "kv2")).get_iterator([5]))) == 2
    write_partitioned_kv(df, ["id"], str(tmp_path / "no"), [])
    assert not (tmp_path / "no").exists()
    for bad in ([({"prt": "small"}, 1), ({"prt": "small"}, 2)],):
        with pytest.raises(ValueError):
            write_partitioned_kv(df, ["id"], folder, bad)
    with pytest.raises(Exception):  # noqa: B017
        co_partition(df, ["id"], [({"prt": "small"}, 2)]).collect()


def test_kv_options(spark, tmp_path):
    """Named options are checked before anything is written, and take effect."""
    import pyarrow.parquet as pq

    df = spark.range(5000).select("id", (F.col("id") * 2).alias("v"), F.lit("x").alias("other"))
    folder = str(tmp_path / "kv")
    KVWriter(df).options(key_fields="id", value_fields="v", btree_interval="100", compression="gzip", buckets=2).save(folder)
    kv = KVFolder(spark, folder)
    assert sorted(kv.scan().columns) == ["id", "v"] and kv.scan().count() == 5000 and kv.get([77]).v == 154
    f = pq.ParquetFile(next(tmp_path.glob("kv/*/*.parquet")))
    assert f.metadata.row_group(0).column(0).compression == "GZIP" and f.metadata.row_group(0).num_rows == 1000
    with pytest.raises(Exception, match="already exists"):
        KVWriter(df).options(key_fields="id", value_fields="v", cleanup=False).save(folder)
    good = {"key.fields": "id", "value.fields": "v"}
    assert KVOptions.of(good, df.columns).cleanup and KVOptions.of(good | {"cleanup": "FALSE"}, df.columns).cleanup is False
    for bad in ({"key.fields": "id"}, good | {"key.fields": "no"}, good | {"value.fields": "id"}, good | {"cleanup": "maybe"}, good | {"compression": "odd"}, good | {"btree.interval": "0"}, good | {"odd": 1}):
        with pytest.raises(ValueError):
            KVOptions.of(bad, df.columns)


@pytest.mark.parametrize("interval", [1, 3, 10, 1000])
def test_kv_file(tmp_path, interval):
    entries = [{"k": k, "v": i} for i, k in enumerate(["b1", "a1", "c", "a1", "d", "a1"])]
    f = KVFile.write(entries, str(tmp_path / "f"), ["k"], interval)
    assert [r["k"] for r in f.get_iterator()] == ["a1", "a1", "a1", "b1", "c", "d"]
    assert len(list(f.get_iterator(["a1"]))) == 3 and f.get(["a0"]) is None and f.get(["z"]) is None and f.get(["bb"]) is None
    with pytest.raises(ValueError):
        KVFile.write(entries, str(tmp_path / "g"), ["k"], pre_sort=False)


def test_options(spark):
    spark.conf.set("index.manager.targetFileSizeMB", "7")
    spark.conf.set("indexer.reader.chunks", "true")
    try:
        assert WriterOptions.of(spark).target_file_mb == 7 and ReaderOptions.of(spark).chunks
        spark.conf.set("indexer.reader.chunks", "maybe")
        with pytest.raises(ValueError):
            ReaderOptions.of(spark)
    finally:
        spark.conf.unset("index.manager.targetFileSizeMB")
        spark.conf.unset("indexer.reader.chunks")
    for bad in (lambda: WriterOptions(compression="x"), lambda: WriterOptions(interval=0), lambda: IndexSpec("a", "b", ()), lambda: IndexSpec("a", "b", ("k", "k")), lambda: IndexSpec("a", "b", (FILE,))):
        with pytest.raises(ValueError):
            bad()
    assert tree_height(60_000, 1000) == 2 and isinstance(Reporter(), Reporter)


def test_stream(spark, tmp_path):
    src, out, cp = (str(tmp_path / x) for x in ("src", "out", "cp"))
    spark.range(10).withColumn("v", F.lit("a")).write.parquet(src)
    schema = spark.read.parquet(src).schema
    index_stream(spark, src, schema, ["id"], out, cp).awaitTermination()
    assert read_stream_index(spark, out).count() == 10
    spark.range(10, 15).withColumn("v", F.lit("b")).write.mode("append").parquet(src)
    index_stream(spark, src, schema, ["id"], out, cp).awaitTermination()
    got = read_stream_index(spark, out)
    assert got.count() == 15 and rows(TableIndexer.parquet(spark, src).load_by_index(got, ["v"])) == rows(spark.read.parquet(src))


def test_hot_locator(spark, sf):
    """A row that is asked for over and over is read by several tasks."""
    key = "spark.sql.adaptive.advisoryPartitionSizeInBytes"
    spark.conf.set(key, "16k")
    try:
        seen = Metrics(spark)
        one = TableIndexer.parquet(spark, f"{sf}/orders.parquet", options=ReaderOptions(metrics=seen))
        index = one.create_index_df(["o_orderkey"])
        asked = spark.range(0, 200_000, 1, 8).withColumnRenamed("id", "n").crossJoin(F.broadcast(index.where("o_orderkey = 7")))
        got = one.load_by_index(asked, ["o_totalprice"]).groupBy("o_orderkey", "o_totalprice").agg(F.count(F.lit(1)).alias("rows"), F.countDistinct("n").alias("n")).collect()
        assert [(r["rows"], r["n"]) for r in got] == [(200_000, 200_000)]
        assert seen.values()["files"] > 1
    finally:
        spark.conf.unset(key)
