"""Bucket of a key: Spark's own murmur hash, on typed values, never through strings."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def bucket_of(keys: list[str | Column], n: int | Column) -> Column:
    """``pmod(hash(keys), n)``, as ``bucketBy`` has it."""
    return F.pmod(F.hash(*keys), F.lit(n) if isinstance(n, int) else n)


def literals(schema, key: dict) -> list[Column]:
    """The key's values as literals of the index's own types, so that 1 and 1L hash alike."""
    return [F.lit(v).cast(schema[k].dataType) for k, v in key.items()]


#: Partition specs up to which a predicate is spelt out; more are looked up in a set.
SPELT_OUT = 16


def _spec_key(values: list[Column]) -> Column:
    """One string for several values, nulls too; lengths keep it unambiguous."""
    text = [v.cast("string") for v in values]
    return F.concat(*[F.coalesce(F.concat(F.length(t), F.lit(":"), t), F.lit("-")) for t in text])


def partition_predicate(specs: list[dict], schema=None) -> Column:
    """Any of the partition specs; none at all matches nothing. Values go in as literals, unspliced.

    With the table's ``schema``, values take the columns' own types, so that the catalog prunes by
    them. Many specs of the same columns are one set, as a chain of thousands of alternatives is too
    deep to plan; each column's own values go before it, for the catalog.
    """
    from functools import reduce

    def typed(k, v):
        lit = v if isinstance(v, Column) else F.lit(v)
        return lit if schema is None else lit.cast(schema[k].dataType)

    def own(k):
        return F.col(f"`{k}`") if schema is not None else F.col(f"`{k}`").cast("string")

    def value(k, v):
        return typed(k, v) if schema is not None else typed(k, v).cast("string")

    names = list(specs[0]) if specs else []
    if len(specs) > SPELT_OUT and names and all(set(s) == set(names) for s in specs):
        exact = _spec_key([F.col(f"`{k}`") for k in names]).isin(*[_spec_key([typed(k, s[k]) for k in names]) for s in specs])
        for k in names:
            if all(s[k] is None or not isinstance(s[k], Column) for s in specs):
                among = F.col(f"`{k}`").isin(*[value(k, v) for v in dict.fromkeys(s[k] for s in specs if s[k] is not None)]) if schema is not None else F.lit(True)
                exact = (among | F.col(f"`{k}`").isNull() if any(s[k] is None for s in specs) else among) & exact
        return exact
    one = [reduce(lambda a, b: a & b, [own(k).isNull() if v is None else own(k).eqNullSafe(value(k, v)) if isinstance(v, Column) else own(k) == value(k, v) for k, v in s.items()], F.lit(True)) for s in specs]
    return reduce(lambda a, b: a | b, one, F.lit(False))
