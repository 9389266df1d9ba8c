"""Mixing sources to target weights, on a curriculum: DataFrame operations only.

Each source's share is its weight's part of all words, but no more than ``max_repeats`` times its
size; what is above goes to the others by weight. The words of a source are laid end to end in a
fixed pseudo-random order of documents and repeated; the mix takes them up to the target, so the
last document may be taken in part. A source's weight changes over training along a line through
evenly spaced points; that schedule is integrated, and the inverse of the integral turns the words
already taken into a position in [0, 1]. Sorting by position makes the training order.

Null or empty texts have size 0 and are taken 0 times; a null source is a source of its own, last in
order; repeated rows count each; ties in the order are between equal rows only. An empty table
gives no rows. Other columns are ignored by :func:`mix` and kept by :func:`corpus`.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import MapType, VariantType

from waymark.llm.common import dropped, written

#: Weights of sources in order, repeating.
WEIGHTS = (1.0, 2.0, 3.0)
#: How weights change over training, by place in WEIGHTS: what each is multiplied by at evenly spaced times.
SCHEDULES = ((1.5, 0.5), (1.0, 1.0), (0.5, 1.5))
#: Parts into which each source is dealt for its running sum, so that no task holds a source.
PARTS = 4096


def size_of(text: Column) -> Column:
    """Words of a text: runs of anything but ASCII white space; null has none."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("bigint")


def targets(sizes: DataFrame, max_repeats: int = 3, weights: tuple = WEIGHTS) -> DataFrame:
    """``source, source_size, place, target`` from ``source, source_size``, a row for each source.

    With sources in the order of ``max_repeats * size / weight``, those at their limit come first;
    the level of the others is what is left over the weight left, as soon as the next one fits.
    """
    by_name = Window.orderBy(F.col("source").isNull(), "source")
    place = (F.row_number().over(by_name) - 1) % len(weights)
    s = sizes.withColumn("place", place).withColumn("weight", F.array(*map(F.lit, weights))[F.col("place")])
    s = s.withColumn("limit", F.col("source_size") * F.lit(float(max_repeats)))
    by_ratio = Window.orderBy(F.col("limit") / F.col("weight"), F.col("source").isNull(), "source")
    before = by_ratio.rowsBetween(Window.unboundedPreceding, -1)
    every = Window.orderBy(F.lit(0)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    left = F.sum("source_size").over(every).cast("double") - F.coalesce(F.sum("limit").over(before), F.lit(0.0))
    weight_left = F.sum("weight").over(by_ratio.rowsBetween(0, Window.unboundedFollowing))
    s = s.withColumn("level", left / weight_left).withColumn("fits", F.col("level") * F.col("weight") <= F.col("limit"))
    s = s.withColumn("final", F.min(F.when(F.col("fits"), F.struct(F.col("limit") / F.col("weight"), F.col("source").isNull(), F.coalesce("source", F.lit("")), "level"))).over(every)["level"])
    return s.select("source", "source_size", "place", F.least("limit", F.coalesce(F.col("final") * F.col("weight"), F.col("limit"))).alias("target"))


def position(share: Column, knots: tuple[float, ...]) -> Column:
    """Where in training a schedule through ``knots`` has given out ``share`` of its words.

    The integral up to there equals the share of the whole. Between two knots it is a square, and its
    root the position.
    """
    if len(knots) < 2 or min(knots) < 0 or sum(knots) <= 0:
        raise ValueError(f"a schedule has two points at least, none below and not all at zero: {knots}")
    areas = [(a + b) / 2 for a, b in zip(knots, knots[1:], strict=False)]
    area, n = share * F.lit(sum(areas)), len(areas)
    out, before = F.lit(1.0), sum(areas)
    for i in range(n - 1, -1, -1):
        a, b = float(knots[i]), float(knots[i + 1])
        before -= areas[i]
        own = area - F.lit(before) if i else area
        inner = F.lit(a * a) + F.lit(2 * (b - a)) * own
        root = F.when(own <= 0, F.lit(0.0)).otherwise(2 * own / (F.lit(a) + F.sqrt(F.greatest(inner, F.lit(0.0)))))
        at = (F.lit(float(i)) + F.least(F.lit(1.0), root)) / n
        out = at if i == n - 1 else F.when(area <= F.lit(before + areas[i]), at).otherwise(out)
    return F.when(share <= 0, F.lit(0.0)).otherwise(out)


def _row_key(docs: DataFrame) -> list[Column]:
    """128 bits that tell rows apart; only equal rows share them."""
    cols = [F.col(f"`{f.name}`") for f in docs.schema if not isinstance(f.dataType, MapType | VariantType)]
    return [F.xxhash64(*cols).alias("k1"), F.xxhash64(F.lit("row"), *reversed(cols)).alias("k2")]


def _planned(docs: DataFrame, max_repeats: int, weights: tuple, schedules: tuple, parts: int, id_col: str) -> DataFrame:
    """``k1, k2, doc_id, source, size, source_size, target, taken, copies`` for every row."""
    # the first 60 bits of a digest, which any SQL engine computes alike
    digest = F.md5(F.concat(F.coalesce(F.col(f"`{id_col}`").cast("string"), F.lit("")), F.lit(":mix")).cast("binary"))
    order = F.conv(F.substring(digest, 1, 15), 16, 10).cast("bigint")
    narrow = docs.select(*_row_key(docs), F.col(f"`{id_col}`").alias("doc_id"), F.col("source"), size_of(F.col("text")).alias("size"), order.alias("at"))
    # the part keeps the order: the higher bits of the order itself
    narrow = narrow.withColumn("part", F.shiftright("at", 60 - parts.bit_length() + 1))
    narrow = written(narrow, "sizes")
    sums = written(narrow.groupBy("source", "part").agg(F.sum("size").alias("part_size")), "parts")
    sizes = sums.groupBy("source").agg(F.sum("part_size").alias("source_size"))
    goal = written(targets(sizes, max_repeats, weights), "targets")
    upto = Window.partitionBy("source").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = written(sums.withColumn("before", F.coalesce(F.sum("part_size").over(upto), F.lit(0))).drop("part_size"), "offsets")
    dropped(sums)
    # sources are few against documents, and a row each; parts join on both columns
    plan = offsets.alias("p").join(goal.alias("g"), F.col("p.source").eqNullSafe(F.col("g.source"))).select("p.source", "part", "before", "source_size", "place", "target")
    own = Window.partitionBy(F.col("d.source"), F.col("d.part")).orderBy("at", "doc_id", "size", "k1", "k2").rowsBetween(Window.unboundedPreceding, -1)
    d = narrow.alias("d").join(plan.alias("q"), F.col("d.source").eqNullSafe(F.col("q.source")) & (F.col("d.part") == F.col("q.part")))
    begin = F.col("before") + F.coalesce(F.sum("size").over(own), F.lit(0))
    d = d.select("k1", "k2", "doc_id", F.col("d.source").alias("source"), "size", "source_size", "place", "target", begin.alias("begin"))
    whole = F.round("target").cast("bigint")
    each = []
    for e in range(max_repeats):
        from_ = F.col("begin") + F.col("source_size") * e
        words = F.greatest(F.lit(0).cast("bigint"), F.least(F.col("size"), whole - from_))
        share = F.when(F.col("target") > 0, F.least(F.lit(1.0), from_ / F.col("target"))).otherwise(F.lit(0.0))
        at = F.lit(0.0)
        for i, knots in enumerate(schedules):
            at = F.when(F.col("place") == i, position(share, knots)).otherwise(at)
        each.append(F.struct(F.lit(e).alias("epoch"), words.alias("words"), at.alias("position")))
    d = d.withColumn("copies", F.filter(F.array(*each), lambda c: c["words"] > 0))
    d = d.withColumn("taken", F.aggregate("copies", F.lit(0).cast("bigint"), lambda acc, c: acc + c["words"]))
    return d.drop("begin", "place")


def mix(docs: DataFrame, max_repeats: int = 3, weights: tuple = WEIGHTS, schedules: tuple = SCHEDULES, parts: int = PARTS, id_col: str = "doc_id") -> DataFrame:
    """``doc_id, source, size, source_size, target, taken, position, copies`` for every row, range-sorted by first position.

    ``copies`` has ``epoch, words, position`` of each time that the document is taken; ``position`` is that of
    the first, or null. Texts are read once; what follows works on a narrow written table. Running sums
    are two-level: sums of each source's parts are summed up in order, then documents within a part, so
    that a source with a third of all rows is shared by many tasks.
    """
    d = _planned(docs, max_repeats, weights, schedules, parts, id_col).withColumn("position", F.get("copies", F.lit(0))["position"])
    n = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    last = F.coalesce("position", F.lit(2.0))
    d = d.repartitionByRange(n, last, "doc_id").sortWithinPartitions(last, "doc_id")
    return d.select("doc_id", "source", "size", "source_size", "target", "taken", "position", "copies")


def training_order(mixed: DataFrame) -> DataFrame:
    """A row each time a document is taken, range-sorted by position: ``position, doc_id, source, epoch, words``."""
    rows = mixed.select("doc_id", "source", F.explode("copies").alias("c")).select(F.col("c.position").alias("position"), "doc_id", "source", F.col("c.epoch").alias("epoch"), F.col("c.words").alias("words"))
    n = int(mixed.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return rows.repartitionByRange(n, "position", "doc_id", "epoch").sortWithinPartitions("position", "doc_id", "epoch")


def first_words(text: Column, n: Column) -> Column:
    """The text up to the end of its ``n``-th word, white space as it was."""
    pieces = F.split(text, r"(?<=[^\x20\x09-\x0D])(?=[\x20\x09-\x0D])")
    return F.array_join(F.slice(pieces, F.lit(1), n.cast("int")), "")


def corpus(docs: DataFrame, max_repeats: int = 3, weights: tuple = WEIGHTS, schedules: tuple = SCHEDULES, parts: int = PARTS, id_col: str = "doc_id") -> DataFrame:
    """The mixed corpus: ``docs``' columns, ``position, epoch, words``, a row each time that a document is taken, in training order.

    What is taken in part has its first words alone, and ``n_chars``, where there is one, of those. Rows
    meet their places by a key of the whole row, so repeated rows and repeated identifiers stay apart. The
    order is dealt by position itself, which a schedule spreads over [0, 1]; texts are moved twice.
    """
    if clash := {"position", "epoch", "words"} & set(docs.columns):
        docs = docs.drop(*clash)
    spark, columns = docs.sparkSession, docs.columns
    plan = _planned(docs, max_repeats, weights, schedules, parts, id_col).select("k1", "k2", "size", F.explode("copies").alias("c"))
    plan = plan.select(F.col("k1").alias("__k1"), F.col("k2").alias("__k2"), F.col("size").alias("__size"), F.col("c.epoch").alias("epoch"), F.col("c.words").alias("words"), F.col("c.position").alias("position"))
    keyed = docs.select(*[k.alias(f"__d{i}") for i, k in enumerate(_row_key(docs))], *[F.col(f"`{c}`") for c in columns])
    keyed = keyed.repartition("__d0", "__d1").dropDuplicates(["__d0", "__d1"])  # equal rows are equal texts; the plan has them each
    taken = keyed.join(plan, (F.col("__d0") == F.col("__k1")) & (F.col("__d1") == F.col("__k2")))
    partly = F.col("words") < F.col("__size")
    taken = taken.withColumn("text", F.when(partly, first_words(F.col("text"), F.col("words"))).otherwise(F.col("text")))
    if "n_chars" in columns:
        taken = taken.withColumn("n_chars", F.when(partly & F.col("n_chars").isNotNull(), F.length("text").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("n_chars")))
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    dealt = taken.repartitionById(n, F.least(F.lit(n - 1), F.floor(F.col("position") * n)).cast("int")).sortWithinPartitions("position", F.col(f"`{id_col}`"), "epoch")
    return dealt.select(*[f"`{c}`" for c in columns], "position", "epoch", "words")
