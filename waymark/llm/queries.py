"""One query for each operator, over its whole table with production parameters, and the pipeline; SQL where it can tell."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from waymark.llm import chat, cotrain, decontam, kdtree, mixing, pipeline, secrets, simhash, toxicity, urls, warc


def _table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def op1_warc(spark: SparkSession, d: str) -> DataFrame:
    """Every page as a record in archives, read back."""
    got = warc.round_trip(_table(spark, d, "pages"))
    return got.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op2_cotraining(spark: SparkSession, d: str) -> DataFrame:
    """Quality of every document; ``keep`` from a score of one half."""
    s = cotrain.scored(_table(spark, d, "documents"), _table(spark, d, "labels"))
    return s.select(F.col("id").alias("doc_id"), "score", "text_score", "meta_score", (F.col("score") >= cotrain.KEEP).alias("keep"))


def op3_simhash(spark: SparkSession, d: str) -> DataFrame:
    """Fingerprints and components of all documents."""
    got = simhash.near_duplicates(_table(spark, d, "documents"), simhash.EXACT)
    return got.select(F.col("id").alias("doc_id"), F.lower(F.lpad(F.hex("f0"), 16, "0")).alias("fingerprint"), F.col("component").alias("component_id"))


def op4_topk(spark: SparkSession, d: str) -> DataFrame:
    """The five best of every 50th vector among all others."""
    v = kdtree.quantised(_table(spark, d, "embeddings"))
    return kdtree.top_k(v, v.where("id % 50 = 0"), 5)


def op5_chat(spark: SparkSession, d: str) -> DataFrame:
    """Roles and canonical text of every conversation, from transcripts of its turns."""
    return chat.formatted(_table(spark, d, "conversations"))


def op6_urls(spark: SparkSession, d: str) -> DataFrame:
    """The verdict on every page's URL."""
    return urls.judged(_table(spark, d, "pages")).select("page_id", "host", "path", "rule", "verdict")


def op7_toxicity(spark: SparkSession, d: str) -> DataFrame:
    """Toxicity of every document."""
    docs = _table(spark, d, "documents")
    s = toxicity.score(docs, toxicity.train(docs, _table(spark, d, "labels")))
    return s.select(F.col("id").alias("doc_id"), toxicity.held_out(F.col("id")).alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted"))


def op8_decontam(spark: SparkSession, d: str) -> DataFrame:
    """Benchmark items in documents, and how near they are."""
    return decontam.leaks(_table(spark, d, "documents"), _table(spark, d, "benchmark")).withColumnRenamed("id", "doc_id")


def op9_secrets(spark: SparkSession, d: str) -> DataFrame:
    """Spans of secrets in every document."""
    return secrets.scan_documents(_table(spark, d, "documents")).withColumnRenamed("id", "doc_id")


def op10_mix(spark: SparkSession, d: str) -> DataFrame:
    """What the mix takes of every document."""
    mix = mixing.mix(_table(spark, d, "documents"))
    return mix.select("doc_id", "size", "source_size", "target", "taken", F.round("position", 9).alias("position"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_warc": op1_warc, "op2_cotraining": op2_cotraining, "op3_simhash": op3_simhash, "op4_topk": op4_topk, "op5_chat": op5_chat, "op6_urls": op6_urls,
    "op7_toxicity": op7_toxicity, "op8_decontam": op8_decontam, "op9_secrets": op9_secrets, "op10_mix": op10_mix, "pipeline": pipeline.run,
}

SQL: dict[str, str] = {
    # DuckDB's own SHA-1 of the payload tells what each record is
    "op1_warc": """
        with p as (select page_id, coalesce(html, '') as h from pages),
        q as (select page_id, octet_length(encode(h)) as n, sha1(h) as d from p),
        w as (select d, max(page_id) as last from q where n >= 1000 group by d)
        select q.page_id, cast(n as bigint) as payload_bytes, q.d as payload_digest,
               case when n >= 1000 and q.page_id <> last then 'revisit' else 'response' end as record_type,
               case when n >= 1000 and q.page_id <> last then last end as refers_to
        from q left join w on q.d = w.d""",
    # 128-bit products, as 64 bits may not hold those that aren't returned
    "op4_topk": """
        with v as (select vec_id, list_transform(embedding, lambda x: cast(floor(256 * cast(x as double)) as bigint)) as e from embeddings
                   where vec_id is not null and embedding is not null and len(embedding) > 0 and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
        s as (select q.vec_id as query_id, c.vec_id, list_sum(list_transform(list_zip(q.e, c.e), lambda z: cast(z[1] as hugeint) * z[2])) as score
              from v q join v c on q.vec_id <> c.vec_id and len(q.e) = len(c.e) where q.vec_id % 50 = 0),
        r as (select *, cast(row_number() over (partition by query_id order by score desc, vec_id) as int) as rank from s)
        select query_id, rank, vec_id, cast(score as bigint) as score from r where rank <= 5""",
    # shares up to the limits in one pass: sources by limit over weight; then running sums in the digest's order; then the schedule's inverse
    "op10_mix": r"""
        with d as (select doc_id, source, cast(coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) as bigint) as size,
                          cast('0x' || substr(md5(coalesce(cast(doc_id as varchar), '') || ':mix'), 1, 15) as bigint) as at from documents),
        s as (select source, cast(sum(size) as bigint) as source_size from d group by source),
        w as (select *, 3.0::double * source_size as lim, (row_number() over (order by source nulls last) - 1) % 3 as place, cast(1 + place as double) as weight from s),
        l as (select *, (cast(sum(source_size) over () as double) - coalesce(sum(lim) over (order by lim / weight, source nulls last rows between unbounded preceding and 1 preceding), 0))
                        / sum(weight) over (order by lim / weight, source nulls last rows between current row and unbounded following) as level from w),
        f as (select (select level from l where level * weight <= lim order by lim / weight, source nulls last limit 1) as final),
        t as (select source, source_size, place, least(lim, coalesce(final * weight, lim)) as target from l, f),
        b as (select d.doc_id, d.size, t.source_size, t.target, t.place, cast(round(t.target) as bigint) as whole,
                     coalesce(sum(d.size) over (partition by d.source order by d.at, d.doc_id nulls first, d.size rows between unbounded preceding and 1 preceding), 0) as begins
              from d join t on d.source is not distinct from t.source),
        c as (select *, cast(greatest(0, least(size, whole - begins)) + greatest(0, least(size, whole - begins - source_size)) + greatest(0, least(size, whole - begins - 2 * source_size)) as bigint) as taken,
                     least(1.0::double, begins / target) as share, 1.5::double - 0.5::double * place as p, 0.5::double + 0.5::double * place as q from b),
        e as (select *, share * ((p + q) / 2.0::double) as area from c)
        select doc_id, size, source_size, target, taken,
               case when taken > 0 then round(case when share <= 0 then 0.0::double else least(1.0::double, 2 * area / (p + sqrt(greatest(p * p + 2 * (q - p) * area, 0)))) end, 9) end as position
        from e""",
}


def _urls_sql() -> str:
    """Rules, then the template tree level by level; constants are the operator's own."""
    rules = sorted(urls.RULES, key=lambda r: (len(r.pattern), r.verdict == "block"), reverse=True)
    case = {
        what: "case " + " ".join(f"when (host = '{r.host}' or ends_with(host, '.{r.host}')) and starts_with(path, '{r.path}') then '{getattr(r, what)}'" for r in rules) + " end"
        for what in ("pattern", "verdict")
    }
    weak = f"({urls.PRIOR}::double + {urls.UNTOLD}::double * ({{pages}} - {{known}}))"
    smoothed = f"({{bad}} + {urls.NEUTRAL}::double * {weak}) / ({{known}} + {weak})"
    out = [rf"""
        with u as materialized (select page_id, case when contains(url, '://') then substr(url, strpos(url, '://') + 3) else '' end as rest from pages),
        h as materialized (select page_id, translate(regexp_extract(rest, '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as host, regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) as path from u),
        g as materialized (select page_id, host, path, {case["pattern"]} as rule, {case["verdict"]} as told,
            list_transform(list_filter(string_split(path, '/'), lambda x: x <> ''), lambda x: struct_pack(whole := x, bare := regexp_replace(x, '\.[A-Za-z]{{1,5}}$', ''), ending := regexp_extract(x, '(\.[A-Za-z]{{1,5}})$', 1))) as parts from h),
        k as materialized (select page_id, host, path, rule, told, list_transform(parts, lambda x: case
            when regexp_matches(x.bare, '^[0-9]+$') then '{{n}}' || x.ending
            when regexp_matches(x.bare, '^[0-9a-fA-F-]{{8,}}$') and regexp_matches(x.bare, '[0-9]') then '{{h}}' || x.ending
            when length(x.bare) >= 20 or (regexp_matches(x.bare, '[0-9]') and regexp_matches(x.bare, '[A-Za-z]') and length(x.bare) >= 6) then '{{v}}' || x.ending
            else x.whole end) as every from g),
        p as materialized (select page_id, host, path, rule, told, case when len(every) > {urls.DEPTH} then list_append(every[1:{urls.DEPTH - 1}], '{{*}}') else every end as segs from k),
        at0 as materialized (select host, segs, count(*) as n, count(told) as known, count(*) filter (told = 'block') as bad, '' as template, {urls.NEUTRAL}::double as share from p group by host, segs)"""]
    for i in range(urls.DEPTH):
        own, pooled = "bad / greatest(known, 1)::double", smoothed.format(bad="all_bad", known="all_known", pages="all_known")
        out.append(f"""
        s{i} as materialized (select *, coalesce(segs[{i + 1}], '') as seg, array_to_string(list_transform(segs[{i + 2}:], lambda x: case when starts_with(x, '{{') then x else 'w' end), '/') as shape from at{i}),
        z{i} as materialized (select *, sum(c) over (partition by host, template, seg) as nb, sum(k) over (partition by host, template, seg) > 0 as told
            from (select host, template, seg, shape, sum(n) as c, sum(known) as k from s{i} where seg <> '' group by all)),
        y{i} as materialized (select host, template, shape, sum(c) as ca, coalesce(sum(c) filter (told), 0) as ct from z{i} group by all),
        x{i} as materialized (select host, template, sum(c) as ga, coalesce(sum(c) filter (told), 0) as gt from z{i} group by all),
        w{i} as materialized (select host, template, seg, sum(greatest(0::double, c / nb::double - case when gt > 0 then ct / gt::double else ca / ga::double end))
                <= {urls.BOUND}::double * (1 / sqrt(max(nb)) + 1 / sqrt(max(case when gt > 0 then gt else ga end))) as shaped
            from z{i} join y{i} using (host, template, shape) join x{i} using (host, template) group by host, template, seg),
        b{i} as materialized (select host, template, seg, sum(n) as n, sum(known) as known, sum(bad) as bad from s{i} group by all),
        n{i} as materialized (select host, template, count(*) as vals, sum(n) as pages, sum(known) as all_known, sum(bad) as all_bad from b{i} group by all),
        r{i} as materialized (select b.*, vals, pages, {pooled} as pooled, {own} as own, shaped from b{i} b join n{i} using (host, template) left join w{i} using (host, template, seg)),
        c{i} as materialized (select host, template, seg, n, known, bad, case when seg = '' then ''
            when vals >= {urls.VALUES} and vals * {urls.SPREAD} >= pages and not starts_with(seg, '{{') then '{{*}}'
            when shaped and (known = 0 or abs(own - pooled) <= {urls.ERRORS}::double * sqrt(greatest(pooled * (1 - pooled), 0.01::double) / greatest(known, 1)::double)) then '{{~}}' else seg end as name from r{i}),
        m{i} as materialized (select host, template, name, {smoothed.format(bad="sum(bad)", known="sum(known)", pages="sum(n)")} as down from c{i} group by host, template, name),
        at{i + 1} as materialized (select host, segs, n, s.known, s.bad, case when name = '' then template else template || '/' || name end as template, case when name = '' then share else down end as share
            from s{i} s join (select host, template, seg, name, down from c{i} join m{i} using (host, template, name)) using (host, template, seg))""")
    return ",".join(out) + f"""
        select page_id, host, path, rule, coalesce(told, case when share >= {urls.REJECT}::double then 'block' else 'allow' end) as verdict
        from p left join at{urls.DEPTH} using (host, segs)"""


SQL["op6_urls"] = _urls_sql()
if pipeline.ORACLE_SQL:
    SQL["pipeline"] = pipeline.ORACLE_SQL
