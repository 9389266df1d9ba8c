"""Co-partitioning and sorting before writes."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DecimalType

from waymark.functions.buckets import bucket_of


def co_partition(df: DataFrame, keys: list[str], specs: list[tuple[dict, int]]) -> DataFrame:
    """Task = files of the earlier specs + the key's bucket in its own spec; sorted by partitions and keys.

    Rows of no spec are an error, as are repeated specs.
    """
    seen = [tuple(sorted((k, str(v)) for k, v in s.items())) for s, _ in specs]
    if len(set(seen)) != len(seen):
        raise ValueError(f"repeated partition spec: {specs}")
    total, at, case = sum(n for _, n in specs), 0, None
    for s, n in specs:
        hit = reduce(lambda a, b: a & b, [F.col(f"`{k}`").cast("string") == F.lit(str(v)) for k, v in s.items()], F.lit(True))
        place = F.lit(at) + bucket_of(keys, n)
        case = F.when(hit, place) if case is None else case.when(hit, place)
        at += n
    if case is None:
        raise ValueError("no partition spec")
    parts = list(dict.fromkeys(k for s, _ in specs for k in s))
    dealt = df.withColumn("__task", case.otherwise(F.raise_error(F.lit("a row is in none of the partition specs")).cast("int")))
    return dealt.repartitionById(total, "__task").drop("__task").sortWithinPartitions(*parts, *keys)


def rebalanced(df: DataFrame, by: list[Column], most: int) -> DataFrame:
    """Rows dealt by ``by``, in tasks that adaptive execution keeps at about ``most`` shuffled bytes, whatever the session's own size.

    Spark's hint takes no size; its plan does, which then goes with the frame, as frames are planned when they run.
    """
    spark, hinted = df.sparkSession, df.hint("rebalance", *by)
    jvm, plan = spark._jvm, hinted._jdf.queryExecution().analyzed()
    size = jvm.scala.jdk.javaapi.OptionConverters.toScala(jvm.java.util.stream.LongStream.range(most, most + 1).boxed().findFirst())
    sized = jvm.org.apache.spark.sql.catalyst.plans.logical.RebalancePartitions(plan.partitionExpressions(), plan.child(), plan.optNumPartitions(), size)
    return DataFrame(jvm.org.apache.spark.sql.classic.Dataset.ofRows(spark._jsparkSession, sized), spark)


def guard_decimals(df: DataFrame, cast: bool) -> DataFrame:
    """Decimals as doubles where asked for; else they stay decimals, which Parquet and hashes take."""
    if not cast:
        return df
    return df.withColumns({f.name: F.col(f"`{f.name}`").cast("double") for f in df.schema if isinstance(f.dataType, DecimalType)})


def first_match(index: DataFrame, by: list[str], order: list[Column | str]) -> DataFrame:
    """The first row of each key by ``order``, combined map-side: a hot key is one row a task before any shuffle."""
    rest = [c for c in index.columns if c not in by]
    head = F.min_by(F.struct(*[F.col(f"`{c}`") for c in rest]), F.struct(*order)).alias("__m")
    return index.groupBy(*[f"`{c}`" for c in by]).agg(head).select(*[f"`{c}`" for c in by], *[F.col(f"__m.`{c}`") for c in rest])
