"""Joins of a probe frame with an index; the index side isn't shuffled where its buckets allow."""

from __future__ import annotations

from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from waymark.operators.layout import first_match
from waymark.spec import LOCATOR

#: A join on partitions and keys may use buckets of the keys alone. A partitioned index sets it when it
#: is joined, and it then holds for the session, as frames are planned when they run; it changes plans, never results.
JOIN_CONF = {"spark.sql.requireAllClusterKeysForCoPartition": "false"}
#: A lookup reads only its key's bucket. It holds while the lookup runs.
LOOKUP_CONF = {"spark.sql.sources.bucketing.autoBucketedScan.enabled": "false"}


@contextmanager
def settings(spark: SparkSession, conf: dict):
    """Session settings for the time of planning, put back afterwards."""
    old = {k: spark.conf.get(k, None) for k in conf}
    try:
        for k, v in conf.items():
            spark.conf.set(k, v)
        yield
    finally:
        for k, v in old.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def join_with_index(probe: DataFrame, index: DataFrame, keys: list[str], parts: list[str], match: str = "first") -> DataFrame:
    """Inner equi-join on partitions and keys: all probe columns, then the index's other columns.

    ``first``: at most one index row for each key, that of the smallest locator, so the probe's
    multiplicity is kept; ``all``: every match. Null keys never match. No match gives no rows of
    the full schema. The index is brought down to a row a key before the join, map-side first.
    """
    if match not in ("first", "all"):
        raise ValueError(f"match is first or all, not {match!r}")
    on = [*parts, *keys]
    rest = [c for c in index.columns if c not in on]
    if clash := set(rest) & set(probe.columns):
        index = index.drop(*clash)
        rest = [c for c in rest if c not in clash]
    if match == "first":
        order = [c for c in LOCATOR[:3] if c in index.columns] or keys
        index = first_match(index, on, order) if rest else index.distinct()
    return probe.join(index, on, "inner").select(*[f"`{c}`" for c in probe.columns], *[f"`{c}`" for c in rest])


def common_partitions(a: DataFrame, b: DataFrame, parts: list[str]) -> DataFrame:
    """Partition values on both sides."""
    return a.select(*parts).intersect(b.select(*parts))


def missing_partitions(a: DataFrame, b: DataFrame, parts: list[str]) -> DataFrame:
    """Partition values of ``a`` that ``b`` lacks."""
    return a.select(*parts).distinct().subtract(b.select(*parts))
