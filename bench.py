"""Headline queries over $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line."""

import json
import os
import tempfile
import time

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

D = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
CPUS = os.environ.get("BENCH_CPUS", "8")
#: A bench's own folder, as the session of the bench is local.
WORK = os.environ.get("BENCH_WORK") or tempfile.mkdtemp(prefix="waymark-bench-")


def main() -> None:
    import shutil

    shutil.rmtree(WORK, ignore_errors=True)
    spark = (
        SparkSession.builder.master(f"local[{CPUS}]").config("spark.sql.shuffle.partitions", CPUS).config("spark.driver.memory", "16g").config("spark.ui.enabled", "false")
        .config("spark.sql.session.timeZone", "UTC").config("spark.sql.warehouse.dir", f"{WORK}/warehouse").config("spark.checkpoint.dir", f"{WORK}/checkpoints").config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    from waymark import IndexManager, TableIndexer
    from waymark.queries import QUERIES

    took: dict[str, float] = {}

    def timed(name, f):
        t = time.time()
        df = f()
        if df is not None:
            df.write.format("noop").mode("overwrite").save()
        took[name] = round(time.time() - t, 3)

    data = spark.read.parquet(f"{D}/lineitem.parquet")
    # two layouts: Spark's own, where all rows are one row group, and many groups of 10,000 rows
    data.coalesce(1).write.mode("overwrite").parquet(f"{WORK}/lineitem")
    data.coalesce(1).write.option("parquet.block.row.count.limit", 10_000).mode("overwrite").parquet(f"{WORK}/lineitem_groups")
    payload = ["l_extendedprice", "l_discount", "l_tax", "l_shipdate"]
    for layout, suffix in (("lineitem_groups", "_groups"), ("lineitem", "")):
        one = TableIndexer.parquet(spark, f"{WORK}/{layout}")
        index = one.create_index_df(["l_orderkey", "l_linenumber"])
        timed("warm_up", lambda: one.load_by_index(index.where("l_orderkey = 1"), payload))
        for share, mod in (("0.1", 1000), ("1", 100), ("10", 10), ("100", 1)):
            wanted = index.where(F.col("l_orderkey") % mod == 0)
            timed(f"seek_{share}pct{suffix}", lambda w=wanted: one.load_by_index(w, payload))
            timed(f"scan_{share}pct{suffix}", lambda w=wanted: one.data.join(w.select("l_orderkey", "l_linenumber").distinct(), ["l_orderkey", "l_linenumber"], "left_semi").select(*payload))
    spark.sql(f"CREATE TABLE li USING parquet LOCATION '{WORK}/lineitem'")
    made = IndexManager.create_new(spark, "li", "li_index", ["l_orderkey"], ["l_linenumber"], num_buckets=int(CPUS))
    timed("index_append", lambda: made.append_missing_partitions() and None)
    probe = spark.read.parquet(f"{D}/orders.parquet").select(F.col("o_orderkey").alias("l_orderkey"))
    timed("join_bucketed", lambda: made.join_with_index(probe, "all"))
    timed("join_plain", lambda: probe.join(index, "l_orderkey"))
    timed("fetch_cold", lambda: made.fetch(77) and None)
    timed("fetch_warm", lambda: made.fetch(78) and None)
    for name in ("index_build", "load_by_index", "join_first", "load_documents", "kv_all", "running_bytes"):
        timed(name, lambda n=name: QUERIES[n](spark, D))
    took.pop("warm_up")
    print(json.dumps({"metric": "total_seconds", "value": round(sum(took.values()), 3), "unit": "sec", "queries": took, "sf": os.path.basename(D.rstrip("/")).removeprefix("sf")}))
    spark.stop()
    shutil.rmtree(WORK, ignore_errors=True)


if __name__ == "__main__":
    main()
