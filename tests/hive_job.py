"""Formats that only a catalog with Hive's SerDes reads, in a session of its own: run as ``hive_job.py FOLDER``."""

import sys
from decimal import Decimal

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from waymark import IndexManager, ReaderOptions, TableIndexer
from waymark.operators.reader import text_layout
from waymark.sources.avro import AvroFile
from waymark.sources.files import open_input
from waymark.sources.sequence import SequenceFile
from waymark.spec import FILE, OFFSET

base = sys.argv[1]
spark = (
    SparkSession.builder.master("local[4]").config("spark.sql.shuffle.partitions", "4").config("spark.ui.enabled", "false").config("spark.sql.warehouse.dir", f"{base}/w").config("spark.checkpoint.dir", f"{base}/c")
    .config("spark.sql.session.timeZone", "UTC").config("spark.hadoop.javax.jdo.option.ConnectionURL", f"jdbc:derby:;databaseName={base}/m;create=true").config("spark.hadoop.hive.exec.dynamic.partition.mode", "nonstrict")
    .config("spark.hadoop.hive.exec.compress.output", "true").config("spark.hadoop.avro.output.codec", "snappy").config("spark.driver.extraJavaOptions", f"-Duser.timezone=UTC -Dderby.system.home={base}").enableHiveSupport().getOrCreate()
)
spark.sparkContext.setLogLevel("ERROR")
N = 6000


def rows(df):
    return sorted(map(str, df.select(*sorted(df.columns)).collect()))


def seeks(df):
    return "MapInArrow" in df._jdf.queryExecution().toString()


for i, told in enumerate(sys.argv[2:]):
    fmt, kind, codec = (*told.split("/"), "", "")[:3]
    t = f"t_{fmt}_{i}"
    spark.conf.set("hive.exec.compress.output", str(kind != "NONE").lower())
    spark.conf.set("mapreduce.output.fileoutputformat.compress.type", kind or "RECORD")
    spark.conf.set("mapreduce.output.fileoutputformat.compress.codec", f"org.apache.hadoop.io.compress.{codec or 'Default'}Codec")
    spark.sql(f"CREATE TABLE {t} (id_col string, meta_field string, var1 string, var2 int, var_map map<string,string>, d decimal(10,5), arr array<bigint>, s struct<a:int,b:string>, f float, g double, ok boolean, day date) PARTITIONED BY (dt string) STORED AS {fmt}")
    spark.range(1, N + 1, 1, 3).select(
        F.concat(F.lit("msg_"), "id"), F.concat(F.lit("meta_"), "id"), F.when(F.col("id") % 7 > 0, F.repeat(F.concat(F.lit("é"), "id"), 20)), (F.col("id") - 50).cast("int"), F.create_map(F.lit("k"), F.concat(F.lit("v"), "id")),
        (F.col("id") - 100).cast("decimal(10,5)") / 8, F.array("id", F.lit(2**40)), F.struct(F.col("id").cast("int"), F.lit("x")), F.col("id").cast("float") / 3, F.col("id") / 3, F.col("id") % 2 == 0, F.date_add(F.lit("2020-01-01"), F.col("id").cast("int")),
        F.when(F.col("id") > N // 2, "2021-02-03").otherwise("2021-02-04"),
    ).write.insertInto(t)
    data = spark.table(t)
    m = IndexManager.create_new(spark, t, f"{t}_i", ["id_col"], ["meta_field"], num_buckets=3)
    assert [x["dt"] for x in m.append_missing_partitions()] == ["2021-02-03", "2021-02-04"] and m.get_missing_partitions() == []
    index = m.get_index()
    assert index.count() == index.select(FILE, OFFSET).distinct().count() == N
    per = index.groupBy(FILE).agg(F.min(OFFSET).alias("a"), F.max(OFFSET).alias("b"), F.count(F.lit(1)).alias("n")).collect()
    assert all(r["a"] == 0 and r["b"] == r["n"] - 1 for r in per)
    loaded = m.load_by_index(index)
    assert seeks(loaded) == (fmt != "textfile"), fmt
    assert rows(loaded) == rows(data)
    some = index.where("meta_field like '%1'")
    three = some.union(some).union(some)
    scan = IndexManager.load(spark, f"{t}_i", reader=ReaderOptions(strategy="scan"))
    assert rows(m.load_by_index(three, ["var1", "d"])) == rows(scan.load_by_index(three, ["var1", "d"]))
    at = {"dt": "2021-02-04"}
    assert m.fetch("msg_7", at, ["var1", "var2", "var_map", "d"]) == {"id_col": "msg_7", "var1": None, "var2": -43, "var_map": {"k": "v7"}, "d": Decimal("-11.62500")}
    assert m.fetch("msg_7", {"dt": "2021-02-03"}) is None and m.fetch("none") is None
    both = m.load_by_index(some, ["var2", "dt"])  # partition columns stand in no file
    assert seeks(both) == seeks(loaded) and rows(both.drop("meta_field")) == rows(data.where("meta_field like '%1'").select("id_col", "var2", "dt"))
    assert m.fetch("msg_7", fields=["dt"]) == {"id_col": "msg_7"} | at
    lone = m.load_by_index(some.drop("dt"), ["dt"])
    assert not seeks(lone) and lone.where("dt is null").count() == 0 < lone.count()
    assert m.join_with_index(data.where("var2 % 3 = 0").select("dt", "id_col", "var2")).count() == N // 3
    bad = index.limit(3).withColumn(OFFSET, F.lit(10**9).cast("bigint"))
    lax = IndexManager.load(spark, f"{t}_i", reader=ReaderOptions(ignore_failures=True))
    assert lax.load_by_index(some.limit(5).union(bad), ["var1"]).count() == 5
    try:
        m.load_by_index(bad, ["var1"]).collect()
        raise SystemExit(f"{fmt}: bad locators are no error")
    except Exception as e:  # noqa: BLE001
        assert "row" in str(e)
    if fmt == "avro":
        one = AvroFile(open_input(per[0][FILE]), ["id_col"])
        assert one.codec == "snappy" and len(one.counts) > 1, (one.codec, one.counts)
    if fmt == "avro":
        days = ["2020-01-01 00:00:00.123", "1900-01-01 00:00:00", "1582-10-15 00:00:00", "1582-10-04 23:59:59.999", "1500-03-01 12:00:00", "1500-02-28 01:02:03", "1000-01-01 00:00:00", "0004-02-29 10:00:00", "0001-01-01 00:00:00", "9999-12-31 23:59:59"]
        spark.sql("CREATE TABLE times (a int, t timestamp, more array<timestamp>) STORED AS AVRO")
        spark.createDataFrame([*enumerate(days), (-1, None)], "a int, s string").coalesce(1).selectExpr("a", "cast(s as timestamp)", "array(cast(s as timestamp), null)").write.insertInto("times")
        one = TableIndexer.table(spark, "times")
        index = one.create_index_df(["a"])
        got = one.load_by_index(index)
        assert seeks(got)
        a, b = ({r["a"]: (r["s"], r["m"]) for r in x.selectExpr("a", "cast(t as string) s", "cast(more as string) m").collect()} for x in (got, one.data))
        assert a == b, (a, b)
        first = index.where("a = 0").first()
        assert one.read_payload(first) == one.data.where("a = 0").first().asDict()
        spark._jvm.java.util.TimeZone.setDefault(spark._jvm.java.util.TimeZone.getTimeZone("Europe/Oslo"))
        assert not seeks(one.load_by_index(index)) and seeks(one.load_by_index(index, ["a"]))
        spark._jvm.java.util.TimeZone.setDefault(spark._jvm.java.util.TimeZone.getTimeZone("UTC"))
    if fmt == "sequencefile":
        one = SequenceFile(open_input(per[0][FILE]), *text_layout(data, "sequence"), ["id_col"])
        assert one.blocked == (kind == "BLOCK") and (one.codec is None) == (kind == "NONE"), (one.codec, one.blocked)
        assert sum(one.counts) == per[0]["n"], one.counts
    print(told, "fine", flush=True)

if "sequencefile" in sys.argv:  # text that is no value of its column reads as the scan reads it
    odd = ["", "\\N", "7", "+7", "-7", "007", "7.9", "7.", ".5", " 7", "7x", "300", "40000", "3000000000", "-9223372036854775808", "9223372036854775808", "1e3", "NaN", "-Infinity", "inf", "1_0", ".", "-.5", "-", "7.x", "1.", "1e400", "0x1", "1f", "-2.5e1D", "1ff", "7 ", "1e-7", "1e4", "127.9", "-129", "TRUE", "False", "tru", "2020-02-29", "2020-2-3", "2021-13-01", "é"]
    odd += ["12345.678905", "99999.999995", "a\x02b\x02\\N", "1\x022\x02x", "k\x03v\x02k\x03w\x02q\x02\\N\x03z", "1\x02a\x02b", "\x02"]
    types = ["string", "tinyint", "smallint", "int", "bigint", "float", "double", "boolean", "date", "decimal(10,5)", "array<string>", "array<int>", "map<string,string>", "struct<a:int,b:string>", "array<struct<a:string>>"]
    spark.sql(f"CREATE TABLE raw ({', '.join(f'c{i} string' for i in range(len(types) - 1))}, n string) STORED AS SEQUENCEFILE")
    spark.createDataFrame([(*[x] * (len(types) - 1), str(i)) for i, x in enumerate(odd)], ", ".join(f"c{i} string" for i in range(len(types) - 1)) + ", n string").coalesce(1).write.insertInto("raw")
    at = spark.sql("DESCRIBE FORMATTED raw").where("col_name = 'Location'").first()[1]
    wrong = []
    for i, kind in enumerate(types):
        cols = [f"c{j} {'string' if j != i else kind}" for j in range(len(types) - 1)]
        if i == len(types) - 1:
            cols[0] = f"c0 {kind}"
        spark.sql(f"CREATE EXTERNAL TABLE odd_{i} ({', '.join(cols)}, n string, more int) STORED AS SEQUENCEFILE LOCATION '{at}'")
        one = TableIndexer.table(spark, f"odd_{i}")
        got = one.load_by_index(one.create_index_df(["n"]))
        assert seeks(got)
        at_n = [{r["n"]: str(r[f"c{0 if i == len(types) - 1 else i}"]) for r in x.collect()} for x in (got, one.data)]
        wrong += [(kind, x, at_n[0][str(j)], at_n[1][str(j)]) for j, x in enumerate(odd) if at_n[0][str(j)] != at_n[1][str(j)]]
    assert not wrong, wrong
    spark.sql("CREATE TABLE timed (a int, t timestamp) STORED AS SEQUENCEFILE")
    spark.sql("INSERT INTO timed VALUES (1, timestamp'2020-01-01 00:00:00'), (2, null)")
    one = TableIndexer.table(spark, "timed")
    assert not seeks(one.load_by_index(one.create_index_df(["a"]))) and seeks(one.load_by_index(one.create_index_df(["a"]), ["a"]))
    print("odd text fine", flush=True)
spark.stop()
