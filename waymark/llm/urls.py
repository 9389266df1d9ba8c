"""URL filters: rules first, then a tree of path templates for each host. DataFrame operations only.

A rule is a host and the start of a path; it fits the host and its subdomains, and the longest wins.
URLs with a rule are the labelled ones. For the others, paths become templates segment by segment:
numbers, hexadecimal runs and long mixed names are wildcards at once; at each level of a host's
tree, a branch whose values are nearly as many as its pages is one wildcard, and sibling branches that are
statistically similar are merged: what follows in their paths has the shapes that it has in the node's labelled
branches, by Hoeffding's bound on the distance of two samples, and the blocked share of those with labels is not
significantly another. So branches without labels can come under a template that has some. A template is
rejected where its blocked share is high, smoothed towards one half by a few pages, and by part of those
without a label, so that few labels say little about many pages; without any label it is not.

The tree goes as deep as paths do; runs of segments without a branch are one step, so the number of
passes is that of the levels at which paths part. Only counts of (host, template) move between
levels, combined before each shuffle; pages join the verdicts of their templates at the end. A null URL, or one without ``://``, has an empty host and
path, fits no rule and is allowed like any host without labels. Repeated rows count each. Empty
tables give no rows. Other columns are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from waymark.llm.common import dropped, new_folder, written


@dataclass(frozen=True)
class Rule:
    """``pattern`` is a host and a path's start, joined: ``com/en/``."""

    verdict: str
    pattern: str

    @property
    def host(self) -> str:
        return self.pattern.partition("/")[0].lower()

    @property
    def path(self) -> str:
        return "/" + self.pattern.partition("/")[2]


#: Rules of the contract.
RULES = (Rule("block", "com/en/"), Rule("allow", "example.com/en/7"), Rule("allow", "net/de/"), Rule("block", "example.net/de/8"), Rule("block", "org/es/"))
#: Levels that the SQL of ``op6_urls`` goes down; the operator has no limit unless it is given one.
DEPTH = 5
#: A branch is variable from that many values, if there is more than one value for each so many pages.
VALUES, SPREAD = 20, 4
#: Sibling branches merge within so many standard errors; pages that the prior share counts for; that share; share that rejects.
ERRORS, PRIOR, NEUTRAL, REJECT = 2.0, 4.0, 0.5, 0.7
#: Part of a page without a label that counts for the prior share; factor of Hoeffding's bound at one in twenty: sqrt(ln(2 / 0.05) / 2).
UNTOLD, BOUND = 0.2, 1.3581015157406195


def parts(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path of a URL."""
    rest = F.when(F.coalesce(F.instr(url, "://"), F.lit(0)) > 0, F.substring(url, F.instr(url, "://") + 3, F.length(url))).otherwise(F.lit(""))
    host = F.regexp_extract(rest, r"^([^/?#]*)", 1)
    path = F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)
    return F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), path


def matched(host: Column, path: Column, rules: tuple[Rule, ...]) -> tuple[Column, Column]:
    """Pattern and verdict of the longest rule that fits, or nulls."""
    pattern = verdict = F.lit(None).cast("string")
    for r in sorted(rules, key=lambda r: (len(r.pattern), r.verdict == "block")):  # the last that fits wins
        fits = ((host == r.host) | host.endswith("." + r.host)) & path.startswith(r.path)
        pattern, verdict = F.when(fits, F.lit(r.pattern)).otherwise(pattern), F.when(fits, F.lit(r.verdict)).otherwise(verdict)
    return pattern, verdict


def segments(path: Column, depth: int | None = None) -> Column:
    """The path's segments with plain wildcards; with a ``depth``, the last one stands for all that is deeper."""
    s = F.filter(F.split(path, "/"), lambda x: x != "")

    def general(x):
        bare = F.regexp_replace(x, r"\.[A-Za-z]{1,5}$", "")
        ending = F.regexp_extract(x, r"(\.[A-Za-z]{1,5})$", 1)
        kind = F.when(bare.rlike(r"^[0-9]+$"), "{n}").when(bare.rlike(r"^[0-9a-fA-F-]{8,}$") & bare.rlike("[0-9]"), "{h}").when((F.length(bare) >= 20) | (bare.rlike("[0-9]") & bare.rlike("[A-Za-z]") & (F.length(bare) >= 6)), "{v}")
        return F.when(kind.isNotNull(), F.concat(kind, ending)).otherwise(x)

    s = F.transform(s, general)
    if depth is None:
        return s
    return F.when(F.size(s) > depth, F.concat(F.slice(s, 1, depth - 1), F.array(F.lit("{*}")))).otherwise(s)


def tree(labelled: DataFrame) -> DataFrame:
    """``host, segs, template, share, rejected`` for every distinct (host, generalised path): the fate of its template.

    ``labelled`` has ``host, segs, blocked`` (1, 0, or null without a label). Level by level, each
    (host, template so far) is a node; what its children are is decided from their counts alone. The
    segments that all paths of a node have in common are taken in one step, as no count changes there.
    """
    spark = labelled.sparkSession
    leaves = labelled.groupBy("host", "segs").agg(F.count(F.lit(1)).alias("n"), F.count("blocked").alias("known"), F.coalesce(F.sum("blocked"), F.lit(0)).alias("bad"))
    at = written(leaves.withColumns({"template": F.lit(""), "share": F.lit(NEUTRAL), "rest": F.col("segs")}), "leaves")
    ended, path = at.select("host", "segs", "template", "share"), new_folder(spark, "ended")

    def smoothed(bad, known, pages):
        weak = F.lit(PRIOR) + F.lit(UNTOLD) * (F.col(pages) - F.col(known))
        return (F.col(bad) + F.lit(NEUTRAL) * weak) / (F.col(known) + weak)

    def alike(bad, known, pooled):
        error = F.sqrt(F.greatest(pooled * (1 - pooled), F.lit(0.01)) / F.greatest(F.col(known), F.lit(1)))
        return (F.col(known) == 0) | (F.abs(F.col(bad) / F.greatest(F.col(known), F.lit(1)) - pooled) <= F.lit(ERRORS) * error)

    pooled = smoothed("all_bad", "all_known", "all_known")  # of labels alone
    ended.limit(0).write.parquet(path)
    done = [at]  # tables that the next step still reads
    while not at.isEmpty():
        # what all paths of a node begin with: what the least and the greatest have in common
        run = at.groupBy("host", "template").agg(F.min("rest").alias("low"), F.max("rest").alias("high"), F.sum("n").alias("pages"), F.sum("known").alias("all_known"), F.sum("bad").alias("all_bad"))
        parted = F.array_position(F.zip_with("low", "high", lambda x, y: x.eqNullSafe(y)), F.lit(False))
        run = run.withColumns({"common": F.when(parted == 0, F.size("low")).otherwise(parted - 1).cast("int"), "down": smoothed("all_bad", "all_known", "pages")})
        merges = alike("all_bad", "all_known", pooled)
        names = F.transform(F.slice("low", F.lit(1), F.col("common")), lambda x: F.concat(F.lit("/"), F.when(F.col("merges"), "{~}").otherwise(x)))
        run = run.withColumn("merges", merges).withColumn("more", F.concat_ws("", names))
        run = written(run.select("host", "template", "common", "more", "down", (F.col("low") == F.col("high")).alias("ends")), "runs")
        share = F.when(F.col("common") > 0, F.col("down")).otherwise(F.col("share"))
        rest = F.slice("rest", F.col("common") + 1, F.greatest(F.size("rest"), F.lit(1)))
        at = at.join(run, ["host", "template"]).select("host", "segs", "n", "known", "bad", F.concat("template", "more").alias("template"), share.alias("share"), rest.alias("rest"), "ends")
        at = written(at, "runs-taken")
        dropped(*done)
        done = [at]
        at.where("ends").select(*ended.columns).write.mode("append").parquet(path)
        at = at.where("not ends").drop("ends").withColumn("seg", F.coalesce(F.get("rest", F.lit(0)), F.lit("")))
        at = at.withColumn("shape", F.array_join(F.transform(F.slice("rest", F.lit(2), F.size("rest")), lambda x: F.when(x.startswith("{"), x).otherwise("w")), "/"))
        branch = at.groupBy("host", "template", "seg").agg(F.sum("n").alias("n"), F.sum("known").alias("known"), F.sum("bad").alias("bad"))
        branch = written(branch, "branches")
        node = branch.groupBy("host", "template").agg(F.count(F.lit(1)).alias("values"), F.sum("n").alias("pages"), F.sum("known").alias("all_known"), F.sum("bad").alias("all_bad"))
        node = written(node, "nodes")
        # distance of a branch's shapes from those of the node's labelled branches, or of all where none is: what it has of some above their share
        shapes = at.where("seg <> ''").groupBy("host", "template", "seg", "shape").agg(F.sum("n").alias("c"), F.sum("known").alias("k"))
        own, labelled_c = Window.partitionBy("host", "template", "seg"), F.sum(F.when(F.col("told"), F.col("c")).otherwise(0))
        shapes = written(shapes.withColumns({"nb": F.sum("c").over(own), "told": F.sum("k").over(own) > 0}).drop("k"), "shapes")
        common = shapes.groupBy("host", "template", "shape").agg(F.sum("c").alias("ca"), labelled_c.alias("ct"))
        going = shapes.groupBy("host", "template").agg(F.sum("c").alias("ga"), labelled_c.alias("gt"))
        far = shapes.join(common, ["host", "template", "shape"]).join(going, ["host", "template"])
        some = F.col("gt") > 0
        base = F.when(some, F.col("gt")).otherwise(F.col("ga"))
        excess = F.greatest(F.lit(0.0), F.col("c") / F.col("nb") - F.when(some, F.col("ct")).otherwise(F.col("ca")) / base)
        far = far.groupBy("host", "template", "seg").agg(F.sum(excess).alias("far"), F.max("nb").alias("nb"), F.max(base).alias("base"))
        far = written(far.select("host", "template", "seg", (F.col("far") <= F.lit(BOUND) * (1 / F.sqrt("nb") + 1 / F.sqrt("base"))).alias("shaped")), "shaped")
        b = branch.join(node, ["host", "template"]).join(far, ["host", "template", "seg"], "left")
        variable = (F.col("values") >= VALUES) & (F.col("values") * SPREAD >= F.col("pages"))
        name = F.when(F.col("seg") == "", "").when(variable & ~F.col("seg").startswith("{"), "{*}").when(F.col("shaped") & alike("bad", "known", pooled), "{~}").otherwise(F.col("seg"))
        b = written(b.select("host", "template", "seg", name.alias("name"), "n", "known", "bad"), "named")
        merged = b.groupBy("host", "template", "name").agg(F.sum("n").alias("p"), F.sum("known").alias("k"), F.sum("bad").alias("m"))
        merged = written(merged.select("host", "template", "name", smoothed("m", "k", "p").alias("down")), "merged")
        step = b.select("host", "template", "seg", "name").join(merged, ["host", "template", "name"])
        step = written(step, "steps")
        at = at.join(step, ["host", "template", "seg"]).select("host", "segs", "n", "known", "bad", F.when(F.col("name") == "", F.col("template")).otherwise(F.concat("template", F.lit("/"), "name")).alias("template"), F.when(F.col("name") == "", F.col("share")).otherwise(F.col("down")).alias("share"), "rest", "name")
        at = written(at, "level")
        dropped(run, branch, node, shapes, far, b, merged, step, *done)
        done = [at]
        at.where("name = ''").select(*ended.columns).write.mode("append").parquet(path)
        at = at.where("name <> ''").drop("name").withColumn("rest", F.slice("rest", F.lit(2), F.size("rest")))
    return spark.read.schema(ended.schema).parquet(path).withColumn("rejected", F.col("share") >= REJECT)


def judged(pages: DataFrame, rules: tuple[Rule, ...] = RULES, depth: int | None = None) -> DataFrame:
    """``page_id, host, path, rule, verdict, template, share`` of every row."""
    host, path = parts(F.col("url").cast("string"))
    p = pages.select("page_id", host.alias("host"), path.alias("path"))
    rule, verdict = matched(F.col("host"), F.col("path"), rules)
    p = p.withColumns({"rule": rule, "told": verdict, "segs": segments(F.col("path"), depth)})
    p = written(p, "urls")  # narrow: what the tree needs again and again
    fates = tree(p.select("host", "segs", (F.col("told") == "block").cast("int").alias("blocked")))
# one row for each host and generalised path; hot ones meet a single row, so their rows can be split
    out = p.join(fates, ["host", "segs"], "left")
    return out.select("page_id", "host", "path", "rule", F.coalesce("told", F.when(F.col("rejected"), "block").otherwise("allow")).alias("verdict"), "template", "share")


def filtered(pages: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """``pages`` without those judged to be blocked; identifiers tell rows apart."""
    blocked = written(judged(pages, rules).where("verdict = 'block'").select(F.col("page_id").alias("__page")).distinct(), "blocked")
    return pages.join(blocked, pages["page_id"].eqNullSafe(blocked["__page"]), "left_anti")


__all__ = ["RULES", "Rule", "filtered", "judged", "matched", "parts", "segments", "tree"]
