"""Queries that apply the library's operators to the star schema, each with its SQL."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import replace

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import Config
from ..functions import columns as C
from ..functions import ledger
from ..functions.classify import RuleClassifier, ask_checks, ask_titles
from ..operators import assemble, convolution, encode, linear, model_store, report, sampling, screen, titles, train
from ..operators.ranking import ranked
from ..schema import POSTING_COLUMNS
from ..sources.postings import parse_lines, read_screened_csv, read_shards, read_table_csv, shard_paths
from ..sources.shard_files import write_shards
from ..sources.sinks import row_count, write_csv, write_stage
from ..sources.stages import new_path

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}
_LINE_KEY = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"]


def _query(sql: str | None = None) -> Callable[[Callable[..., DataFrame]], Query]:
    """Register a function of (get), get(name) being a table; sql is what it must equal."""

    def take(f: Callable[..., DataFrame]) -> Query:
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return f(lambda name: spark.read.parquet(f"{sf_dir}/{name}.parquet"))

        QUERIES[f.__name__] = run
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return run

    return take


@_query("""
    with p as (
        select l_orderkey, l_linenumber, l_partkey, n_name as city, s_name as company, p_name as title,
               l_shipmode_ as source, strftime(l_shipdate, '%Y-%m') as month
        from (select *, l_returnflag || l_linestatus as l_shipmode_ from lineitem)
        join part on l_partkey = p_partkey join supplier on l_suppkey = s_suppkey join nation on s_nationkey = n_nationkey
        where l_returnflag || l_linestatus in ('AF', 'NO', 'RF')
    ), f as (
        select *, row_number() over (partition by company, title, city, month order by l_orderkey, l_linenumber, l_partkey) as n from p
    )
    select title, count(*) as count from f where n = 1 group by title having count(*) >= 6""")
def screened_title_counts(get):
    joined = get("lineitem").join(get("part"), F.col("l_partkey") == F.col("p_partkey")).join(get("supplier"), F.col("l_suppkey") == F.col("s_suppkey"))
    joined = joined.join(F.broadcast(get("nation")), F.col("s_nationkey") == F.col("n_nationkey"))  # 25 rows by its nature
    posted = joined.select(
        "l_orderkey",
        "l_linenumber",
        "l_partkey",
        F.col("n_name").alias("city"),
        F.col("s_name").alias("company_id"),
        F.col("p_name").alias("title"),
        F.concat("l_returnflag", "l_linestatus").alias("source"),
        C.month_key(F.col("l_shipdate").cast("string")).alias("date"),
    )
    kept = screen.allowed(posted, replace(Config(), allowed_sources=("AF", "NO", "RF")))
    first = screen.keep_first(kept, list(Config().dedup_keys), ["l_orderkey", "l_linenumber", "l_partkey"])
    return titles.frequent(first, Config().min_title_count)


@_query("""
    select 'c' || c_custkey as posting_id, c_name as company_id, c_mktsegment as company_name, cast(c_nationkey as varchar) as city,
           case when c_acctbal >= 0 then 'x' end as source
    from customer where c_mktsegment <> 'BUILDING'""")
def parse_lines_of_fields(get):
    """Lines of 14 fields for accounts in debt, of 15 for others, and of too many for one segment."""
    some = F.when(F.col("c_acctbal") >= 0, "@!".join("x" * 11)).otherwise("@!".join("x" * 10))
    many = F.when(F.col("c_mktsegment") == "BUILDING", "@!@!@!").otherwise("")
    fields = [F.concat(F.lit("c"), F.col("c_custkey").cast("string")), "c_name", "c_mktsegment", F.col("c_nationkey").cast("string"), F.concat(some, many)]
    return parse_lines(get("customer").select(F.concat_ws("@!", *fields).alias("value"))).select("posting_id", "company_id", "company_name", "city", "source")


@_query("select l_orderkey, l_linenumber, l_partkey, l_suppkey, coalesce(nullif(l_returnflag, 'N'), l_linestatus) as filled from lineitem")
def sentinel_fill(get):
    filled = F.coalesce(C.missing_to_null(F.col("l_returnflag"), ("N",)), F.col("l_linestatus"))
    return get("lineitem").select(*_LINE_KEY, filled.alias("filled"))


@_query("""
    select * from (select l_orderkey, l_linenumber, l_partkey, l_suppkey, nullif(l_returnflag, 'N') as title from lineitem)
    where title is distinct from 'A'""")
def exclude_nullsafe(get):
    rows = get("lineitem").select(*_LINE_KEY, C.missing_to_null(F.col("l_returnflag"), ("N",)).alias("title"))
    return screen.not_part_time(rows, replace(Config(), part_time_title="A"))


@_query("select p_partkey, p_name from part where not contains(p_name, 'red')")
def exclude_containing(get):
    cfg = replace(Config(), part_time_title="red", part_time_match="contains")
    return screen.not_part_time(get("part").select("p_partkey", "p_name"), cfg, "p_name")


@_query("select o_orderkey, o_orderpriority from orders where o_orderpriority in ('1-URGENT', '2-HIGH')")
def source_allowlist(get):
    cfg = replace(Config(), allowed_sources=("1-URGENT", "2-HIGH"))
    return screen.allowed(get("orders").select("o_orderkey", "o_orderpriority"), cfg, "o_orderpriority")


@_query("""
    select event_id, user_id, event_type, date from (
        select event_id, user_id, event_type, strftime(ts, '%Y-%m') as date,
               row_number() over (partition by user_id, event_type, strftime(ts, '%Y-%m') order by event_id) as n
        from events)
    where n = 1""")
def dedup_month(get):
    rows = get("events").select("event_id", "user_id", "event_type", C.month_key(F.col("ts").cast("string")).alias("date"))
    return screen.keep_first(rows, ["user_id", "event_type", "date"], ["event_id"])


@_query("""
    select event_id, user_id, event_type from (
        select event_id, user_id, event_type, row_number() over (partition by event_id % 7, user_id, event_type order by event_id) as n from events)
    where n = 1""")
def dedup_within_shard(get):
    rows = get("events").select("event_id", "user_id", "event_type", (F.col("event_id") % 7).alias("shard"))
    return screen.keep_first(rows, ["user_id", "event_type"], ["event_id"], "shard").drop("shard")


@_query("select event_type, count(*) as count from events group by event_type order by count desc, event_type limit 20")
def source_census(get):
    return screen.source_census(get("events"), "event_type", Config().census_top)


@_query("select event_id, event_type, count(event_type) over (partition by event_type) as n from events")
def group_counts(get):
    return screen.with_group_size(get("events").select("event_id", "event_type"), "event_type")


#: Documents as postings: every seventh has no title, every fifth no date.
_POSTINGS = r"""
    select cast(doc_id as varchar) as posting_id, source as company_id, 'c' || source as company_name, lang as city, null::varchar as company_area, '' as salary,
           '\N' as education, 'any' as experience, text as description, 'p' || cast(doc_id % 9 as varchar) as position_name,
           case when doc_id % 7 = 0 then '\N' else 't' || cast(doc_id % 50 as varchar) end as title, cast(n_chars % 5 as varchar) as headcount,
           case when doc_id % 5 = 0 then '\N' else '2024-01-0' || cast(1 + doc_id % 4 as varchar) end as publish_date, 'i' as industry, source from documents"""


def _postings(docs: DataFrame) -> DataFrame:
    return docs.sparkSession.sql(_POSTINGS.replace("::varchar", "").replace("null as company_area", "cast(null as string) as company_area").replace("varchar", "string").replace("from documents", "from {documents}").replace(r"'\N'", r"r'\N'"), documents=docs)


@_query(rf"select * replace (nullif(salary, '') as salary, nullif(education, '\N') as education, coalesce(nullif(title, '\N'), position_name) as title) from ({_POSTINGS}) where publish_date <> '\N'")
def clean_postings(get):
    return screen.clean(_postings(get("documents")))


@_query(f"select * exclude (description) from ({_POSTINGS})")
def split_attributes(get):
    return screen.attributes(_postings(get("documents")))


@_query(f"select posting_id, company_id, description from ({_POSTINGS})")
def split_descriptions(get):
    return screen.descriptions(_postings(get("documents")))


@_query("select p_name, count(*) as count from part group by p_name having count(*) > 30")
def frequent_titles(get):
    return titles.frequent(get("part"), 31, "p_name")


@_query("select p_name, n as count, ntile(7) over (order by n desc, p_name) as shard from (select p_name, count(*) as n from part group by p_name having count(*) > 20)")
def title_shards(get):
    return titles.shards(titles.frequent(get("part"), 21, "p_name"), 7, "p_name")


@_query("select cast(sum(n) as bigint) as total from (select count(*) as n from part group by p_name having count(*) > 30)")
def title_total(get):
    return titles.total(titles.frequent(get("part"), 31, "p_name"))


@_query(r"select doc_id, nullif(regexp_extract(text, '([0-9]{2}-[0-9]{4})', 1), '') as soc_code from documents where regexp_matches(text, '[0-9]{2}-[0-9]{4}')")
def extract_code(get):
    answers = get("documents").select(F.col("doc_id").alias("title"), F.col("text").alias("answer"))
    return titles.labels(answers).withColumnRenamed("title", "doc_id")


@_query("select page_id, replace(url, '.', '') as answer from pages")
def normalise_answer(get):
    return get("pages").select("page_id", C.without_dots(F.col("url")).alias("answer"))


@_query("select o_orderkey, replace(o_orderpriority, '-', '') as code from orders")
def code_without_dash(get):
    return get("orders").select("o_orderkey", C.without_dashes(F.col("o_orderpriority")).alias("code"))


@_query("select distinct left(c_name, length(c_name) - 1) || '0' as c_name from customer")
def broad_code(get):
    return titles.universe(get("customer"), "c_name")


@_query("select doc_id, source, quality, toxic from documents join labels using (doc_id)")
def label_join(get):
    return titles.label_join(get("documents").select("doc_id", "source"), get("labels"), "doc_id")


@_query("select o_orderkey, o_custkey from orders where o_custkey in (select c_custkey from customer where c_mktsegment = 'BUILDING')")
def universe_semi(get):
    codes = get("customer").filter("c_mktsegment = 'BUILDING'").select(F.col("c_custkey").alias("o_custkey"))
    return titles.within(get("orders").select("o_custkey", "o_orderkey"), codes, "o_custkey")


@_query("select o_orderkey, o_custkey from (select *, count(*) over (partition by o_custkey) as n from orders) where n > 10")
def group_size_filter(get):
    return titles.large_groups(get("orders").select("o_custkey", "o_orderkey"), 11, "o_custkey")


@_query("""
    select doc_id, lang from (
        select doc_id, lang, row_number() over (partition by lang order by md5('42:' || cast(doc_id as varchar)), doc_id) as n from documents)
    where n <= 120""")
def stratified_sample(get):
    return sampling.per_group(get("documents").select("doc_id", "lang"), "lang", 120, "doc_id", 42)


@_query("""
    select coalesce(l.doc_id, d.doc_id) as doc_id, l.quality, d.source,
           case when d.doc_id is null then 'left_only' when l.doc_id is null then 'right_only' else 'both' end as merge
    from labels l full outer join documents d on l.doc_id = d.doc_id""")
def merge_indicator(get):
    return assemble.merge_indicator(get("labels").select("doc_id", "quality"), get("documents").select("doc_id", "source"), "doc_id")


@_query("select doc_id, quality, toxic from labels where doc_id not in (select doc_id from labels where quality = 1)")
def unpassed_pool(get):
    return assemble.unpassed(get("labels"), get("labels").filter("quality = 1"), "doc_id")


@_query("""
    with pool as (
        select doc_id, lang as soc_code, quality from documents join labels using (doc_id)
    ), checked as (
        select doc_id, soc_code, case when quality = 1 then 'Yes' else 'No' end as true_ind from (
            select *, row_number() over (partition by soc_code order by md5('42:' || cast(doc_id as varchar)), doc_id) as n from pool)
        where n <= 30
    ), part1 as (
        select * from checked where true_ind = 'Yes'
    ), part2 as (
        select doc_id, soc_code, null as true_ind from (
            select *, row_number() over (partition by soc_code order by md5('42:' || cast(doc_id as varchar)), doc_id) as n
            from pool where doc_id not in (select doc_id from part1))
        where n <= 40
    )
    select doc_id, soc_code, true_ind, case when true_ind is not null then 1.0::double else 0.5::double end as weight
    from (select * from part1 union all select * from part2) where soc_code not like 'es%'""")
def estimation_sample(get):
    pool = get("documents").join(get("labels"), "doc_id").select("doc_id", F.col("lang").alias("soc_code"), "quality")
    checked = sampling.per_group(pool, "soc_code", 30, "doc_id", 42).withColumn("answer", F.when(F.col("quality") == 1, "Yes.").otherwise("No."))
    checked = assemble.checked_answers(checked).drop("answer", "quality")
    cfg = replace(Config(), rest_cap=40, excluded_code_prefix="es")
    return assemble.estimation(pool.drop("quality"), checked, cfg, "doc_id")


@_query("select source, cast(dense_rank() over (order by source) - 1 as bigint) as label_id from (select distinct source from documents)")
def label_encode(get):
    return encode.label_ids(get("documents"), "source")


@_query("select count(distinct source) as labels from documents")
def label_count(get):
    return encode.label_count(get("documents"), "source")


@_query("select doc_id, lang, row_number() over (order by md5('42:' || cast(doc_id as varchar)), doc_id) - 1 as place from documents")
def batch_shuffle(get):
    return train.shuffled(get("documents").select("doc_id", "lang"), 42, "doc_id")


@_query("""
    with ids as (select source, cast(dense_rank() over (order by source) - 1 as bigint) as label_id from (select distinct source from documents))
    select doc_id, label_id from documents left join ids using (source)""")
def label_lookup(get):
    docs = get("documents").select("doc_id", "source")
    return encode.encode(docs, encode.label_ids(docs, "source"), "source").select("doc_id", "label_id")


@_query("select doc_id, source as name from documents")
def label_reverse_lookup(get):
    docs = get("documents").select("doc_id", "source")
    ids = encode.label_ids(docs, "source")
    coded = encode.encode(docs, ids, "source").select("doc_id", F.col("label_id").alias("name"))
    return encode.decode(coded, ids, "source", "name")


@_query("""
    with r as (
        select doc_id, row_number() over (order by md5('42:' || cast(doc_id as varchar)), doc_id) as n, count(*) over () as m from documents
    ), c as (
        select *, m - cast(floor((2 * m + 4) / 5) as bigint) as n_train, cast(floor((2 * m + 4) / 5) as bigint) as n_rest from r
    )
    select doc_id, case when n <= n_train then 'train' when n <= m - cast(floor((n_rest + 1) / 2) as bigint) then 'valid' else 'test' end as split from c""")
def split_60_20_20(get):
    return sampling.split(get("documents").select("doc_id"), "doc_id", 42)


@_query("select lang, (select count(*) from documents) / ((select count(distinct lang) from documents) * count(*)) as class_weight from documents group by lang")
def class_weights(get):
    return encode.class_weights(get("documents"), "lang")


@_query("select doc_id, md5(repeat(coalesce(source, 'nan') || ' ', 2) || coalesce(text, 'nan')) as digest from documents")
def feature_text(get):
    return get("documents").select("doc_id", F.md5(C.feature_text(F.col("source"), F.col("text"), 2).cast("binary")).alias("digest"))


_SAID = "select l.quality as label, case when n_chars > 400 then 1 else 0 end as prediction from documents join labels l using (doc_id)"


def _said(get):
    return get("documents").select("doc_id", "n_chars").join(get("labels"), "doc_id").select(
        F.col("quality").alias("label"), F.when(F.col("n_chars") > 400, 1).otherwise(0).alias("prediction")
    )


@_query(f"select label, prediction, count(*) as n from ({_SAID}) group by all")
def confusion(get):
    return report.confusion(_said(get))


@_query(f"""
    with said as ({_SAID}), classes as (select label as c from said union select prediction from said),
    e as (
        select cast(c as varchar) as label,
               (select count(*) from said where said.label = c) as support, (select count(*) from said where prediction = c) as named,
               (select count(*) from said where said.label = c and prediction = c) as hit
        from classes
    ), s as (
        select label, support, hit, case when named = 0 then 0 else hit / named end as precision, case when support = 0 then 0 else hit / support end as recall from e
    ), f as (
        select *, case when precision + recall = 0 then 0 else 2 * precision * recall / (precision + recall) end as f1_score from s
    ), m as (
        select sum(hit) / sum(support) as acc, avg(precision) as mp, avg(recall) as mr, avg(f1_score) as mf, sum(precision * support) / sum(support) as wp,
               sum(recall * support) / sum(support) as wr, sum(f1_score * support) / sum(support) as wf, sum(support) as n
        from f
    )
    select label, round(precision::double, 9) as precision, round(recall::double, 9) as recall, round(f1_score::double, 9) as f1_score, round(support::double, 9) as support from (
        select label, precision, recall, f1_score, support from f
        union all select 'accuracy', acc, acc, acc, acc from m
        union all select 'macro avg', mp, mr, mf, n from m
        union all select 'weighted avg', wp, wr, wf, n from m)""")
def classification_report(get):
    found = report.classification_report(_said(get))
    return found.select("label", *[F.round(c, 9).alias(c) for c in ("precision", "recall", "f1_score", "support")])


@_query(f"select round(avg(case when label = prediction then 1.0 else 0.0 end)::double, 9) as accuracy from ({_SAID})")
def accuracy(get):
    return report.accuracy(_said(get)).select(F.round("accuracy", 9).alias("accuracy"))


@_query("""
    select event_id, case when event_id % 4 <> 0 then event_type end as answer, json_extract_string(props, '$.k') as k,
           case when event_id % 4 = 0 then 'quota of ' || event_type end as error from events""")
def json_answer(get):
    said = F.concat(F.lit('{"choices":[{"message":{"content":"'), F.col("event_type"), F.lit('"}}]}'))
    failed = F.concat(F.lit('{"error":{"message":"quota of '), F.col("event_type"), F.lit('"}}'))
    response = F.when(F.col("event_id") % 4 == 0, failed).otherwise(said)
    return get("events").select("event_id", C.answer_of(response).alias("answer"), F.get_json_object("props", "$.k").alias("k"), C.error_of(response).alias("error"))


@_query("""
    select p_partkey,
           'The most likely Standard Occupational Classification title and code the occupation fall into: "' || p_name || '", only show the SOC code.' as title_prompt,
           'Based on this job description (in Chinese): ''' || p_name || ''' Is this Standard Occupational Classification code: ''' || p_brand
             || ''' a reasonable classification (at broad group level)? Only tell me yes or no.' as check_prompt
    from part""")
def prompt_text(get):
    return get("part").select("p_partkey", C.title_prompt(F.col("p_name")).alias("title_prompt"), C.check_prompt(F.col("p_name"), F.col("p_brand")).alias("check_prompt"))


@_query("""select p_partkey, '{"model":"gpt-3.5-turbo-0301","messages":[{"role":"user","content":"' || p_name || '"}]}' as body from part""")
def request_body(get):
    return get("part").select("p_partkey", C.request_body(F.col("p_name")).alias("body"))


@_query("select l_orderkey, l_linenumber, l_partkey, l_suppkey, coalesce(nullif(l_returnflag, 'N') <> '', false) as flag from lineitem")
def truthy_flag(get):
    return get("lineitem").select(*_LINE_KEY, C.truthy(C.missing_to_null(F.col("l_returnflag"), ("N",))).alias("flag"))


@_query("select doc_id, case when quality = 1 then 1.0::double else 0.5::double end as weight from labels")
def sample_weight(get):
    return get("labels").select("doc_id", C.sample_weight(F.col("quality") == 1, 1.0, 0.5).alias("weight"))


@_query("select event_id, loss from (select event_id, (event_id * 7919 + 13) % 1000003 as loss from events) order by loss limit 1")
def best_run(get):
    return report.best_run(get("events").select("event_id", ((F.col("event_id") * 7919 + 13) % 1000003).alias("loss")))


@_query("select p_partkey, case when p_size % 5 >= p_size % 7 then 0 else 1 end::bigint as prediction from part")
def argmax_prediction(get):
    scores = F.array((F.col("p_size") % 5), (F.col("p_size") % 7))
    return get("part").select("p_partkey", C.argmax(scores).cast("bigint").alias("prediction"))


@_query("""
    with chars as (select unnest(string_split(text, '')) as token from documents),
    v as (select token, row_number() over (order by n desc, token) + 1 as id from (select token, count(*) as n from chars where token <> '' group by token order by n desc, token limit 64)),
    f as (select doc_id, left(repeat(source || ' ', 2) || text, 512) as t from documents),
    c as (select doc_id, i, substr(t, i, 1) as token from f, unnest(range(1, 513)) as r(i)),
    k as (select doc_id, i, case when c.token = '' then 0 else coalesce(v.id, 1) end as id from c left join v on c.token = v.token)
    select doc_id, string_agg(cast(id as varchar), ',' order by i) as input_ids, string_agg(case when id = 0 then '0' else '1' end, ',' order by i) as attention_mask
    from k group by doc_id""")
def token_ids(get):
    docs = get("documents")
    out = encode.tokens(docs, encode.vocabulary(docs, "text", 64), Config().max_length, "source", "text")
    return out.select("doc_id", *[F.concat_ws(",", F.transform(c, lambda x: x.cast("string"))).alias(c) for c in ("input_ids", "attention_mask")])


@_query("select 'kept' as name, count(*) as rows from documents where n_chars > 400")
def observe_counts(get):
    return row_count(get("documents").filter("n_chars > 400").select("doc_id", "source"), "kept")


@_query("select round(sum(-ln((1 + p_size) / 52.0) * p_retailprice) / sum(p_retailprice), 9) as loss from part")
def weighted_loss(get):
    rows = get("part").select(((F.col("p_size") + 1) / F.lit(52.0)).alias("probability"), F.col("p_retailprice").alias("loss_weight"))
    return report.weighted_loss(rows).select(F.round("loss", 9).alias("loss"))


@_query("select p_name as title, case when p_name like '%green%' then '37-3011' when p_name like '%red%' then '51-2090' else 'N/A' end as answer from (select distinct p_name from part where p_name is not null)")
def asked_titles(get):
    rules = RuleClassifier([("green", "37-3011"), ("red", "51-2090")])
    return ask_titles(get("part").select(F.col("p_name").alias("title")), rules, 8, 4)


@_query("select doc_id, lang as soc_code, text as description, case when lang = 'de' and contains(text, 'und') then 'Yes.' else 'No.' end as answer from documents")
def asked_checks(get):
    rows = get("documents").select("doc_id", F.col("lang").alias("soc_code"), F.col("text").alias("description"))
    return ask_checks(rows, RuleClassifier([("und", "de")]), 8, 4)


@_query("""
    with pool as (select doc_id as posting_id, source as soc_code, case when doc_id % 3 <> 0 then lang end as description from documents),
    checked as (select doc_id as posting_id, source as soc_code, lang as description, case when quality = 1 then 'Yes' else 'No' end as true_ind from labels join documents using (doc_id)),
    part1 as (select * from checked where true_ind = 'Yes'),
    rest as (select *, row_number() over (partition by soc_code order by md5('42:' || cast(posting_id as varchar)), posting_id) as n
             from pool where description is not null and posting_id not in (select posting_id from part1))
    select posting_id, soc_code, description, true_ind, 1.0::double as weight from part1
    union all select posting_id, soc_code, description, null, 0.5::double from rest where n <= 9""")
def estimation_with_descriptions(get):
    docs = get("documents").select(F.col("doc_id").alias("posting_id"), F.col("source").alias("soc_code"), "lang", "doc_id")
    pool = docs.select("posting_id", "soc_code", F.when(F.col("posting_id") % 3 != 0, F.col("lang")).alias("description"))
    said = F.when(F.col("quality") == 1, "Yes").otherwise("No").alias("true_ind")
    checked = docs.join(get("labels"), "doc_id").select("posting_id", "soc_code", F.col("lang").alias("description"), said)
    return assemble.estimation(pool, checked, replace(Config(), rest_cap=9)).select("posting_id", "soc_code", "description", "true_ind", "weight")


_PIECES = ["[PAD]", "[UNK]", "[CLS]", "[SEP]", "src", "##0", "##1", "##2", "##3", "##4", "##5", "##6", "##7", "##8", "##9"]


@_query("""
    with t as (select doc_id, substr(source, 4) as n from documents),
    w as (select doc_id, '4,' || string_agg(cast(5 + ascii(substr(n, i, 1)) - 48 as varchar), ',' order by i) as word, max(length(n)) + 1 as k from t, unnest(range(1, 3)) as r(i) where i <= length(n) group by doc_id)
    select doc_id, '2,' || word || ',' || word || ',' || word || ',3' || repeat(',0', cast(14 - 3 * k as bigint)) as input_ids,
           repeat('1,', cast(3 * k + 2 as bigint)) || repeat('0,', cast(14 - 3 * k as bigint)) as attention_mask from w""")
def wordpiece_ids(get):
    docs = get("documents").select("doc_id", F.upper("source").alias("title"), F.col("source").alias("description"))
    out = encode.wordpieces(docs, _PIECES, 16)
    return out.select("doc_id", F.array_join("input_ids", ",").alias("input_ids"), F.concat(F.array_join("attention_mask", ","), F.lit(",")).alias("attention_mask"))


@_query("select doc_id, lang, source, quality from documents left join (select doc_id, quality from labels where quality = 1) using (doc_id) union all select doc_id, lang, source, null from documents where lang = 'es'")
def union_missing_columns(get):
    docs = get("documents").select("doc_id", "lang", "source")
    return docs.join(get("labels").filter("quality = 1").select("doc_id", "quality"), "doc_id", "left").unionByName(docs.filter("lang = 'es'"), allowMissingColumns=True)


@_query("select o_orderkey, row_number() over (order by o_orderdate desc, o_orderkey) - 1 as place from orders")
def global_rank(get):
    return ranked(get("orders"), F.desc("o_orderdate"), F.asc("o_orderkey"), name="place").select("o_orderkey", "place")


@_query("select token, count(*) as count from (select unnest(string_split(text, '')) as token from documents) where token <> '' group by token")
def character_counts(get):
    return encode.character_counts(get("documents"), "text")


@_query("select doc_id, text from documents")
def bytes_without_errors(get):
    """Texts with bytes put in that aren't UTF-8, some of them the begin of a character, are read as they were."""
    broken = F.concat(F.unhex(F.lit("FF")), F.left("text", F.lit(5)).cast("binary"), F.unhex(F.lit("E4B8")), F.substring("text", 6, 1 << 30).cast("binary"), F.unhex(F.lit("F09F98")))
    return get("documents").select("doc_id", C.decodable(broken.cast("string")).alias("text"))


@_query("""
    select source as shard, cast(count(*) as bigint) as rows, cast(count(distinct posting_id) as bigint) as ids, cast(count(distinct position) as bigint) as places, max(length(title)) as longest
    from (select source, cast(doc_id as varchar) as posting_id, doc_id as position, 't' || doc_id || '�' as title from documents where source in ('src0', 'src1', 'src3')) group by source""")
def read_back_shards(get):
    """Lines of postings written as numbered text shards, of which some are read: every row has a place of its own."""
    docs = get("documents")
    fields = [F.col("doc_id").cast("string") if c == "posting_id" else F.concat(F.lit("t"), "doc_id", F.lit("\ufffd")) if c == "title" else F.lit("x") for c in POSTING_COLUMNS]
    path = new_path(docs.sparkSession, "shards")
    lines = docs.select("source", F.concat_ws("@!", *fields).alias("value"))
    lines.repartition("source").write.partitionBy("source").text(path)
    rows = read_shards(docs.sparkSession, shard_paths(path, "source=src%d", [0, 1, 3]))
    source = F.regexp_extract(F.col("position.file_path"), "source=([^/]*)/", 1)
    return rows.groupBy(source.alias("shard")).agg(
        F.count("*").alias("rows"), F.countDistinct("posting_id").alias("ids"), F.countDistinct("position").alias("places"), F.max(F.length("title")).alias("longest")
    )


@_query("""
    select cast(p_partkey as varchar) as posting_id, p_name as company_id, p_brand || '?"' || p_type as title, cast(p_size as varchar) as headcount, 'x' as city
    from part where p_size % 3 = 1""")
def shard_files_round_trip(get):
    """Shards written as one file each, with a byte-order mark, and read back by position."""
    spark = get("part").sparkSession
    own = {"posting_id": F.col("p_partkey"), "company_id": F.col("p_name"), "title": F.concat("p_brand", F.lit('?"'), "p_type"), "headcount": F.col("p_size"), "city": F.lit("x")}
    rows = get("part").filter("p_size % 3 = 1").select(*[own.get(c, F.lit(None)).cast("string").alias(c) for c in POSTING_COLUMNS], F.lit("2024-01").alias("date"), F.col("p_size").alias("shard"))
    path = new_path(spark, "shard-files")
    write_shards(rows, path)
    return read_screened_csv(spark, path).select("posting_id", "company_id", "title", "headcount", "city")


@_query("select cast(doc_id as varchar) as doc_id, lang, source, left(text, 40) || '\"?,' as begin from documents where lang <> 'en'")
def table_round_trip(get):
    """A table stored by language and read back in part, then exported as text with all fields quoted and read again."""
    spark, path = get("documents").sparkSession, new_path(get("documents").sparkSession, "tables")
    rows = get("documents").select(F.col("doc_id").cast("string").alias("doc_id"), "lang", "source", F.concat(F.left("text", F.lit(40)), F.lit('"?,')).alias("begin"))
    write_stage(rows, f"{path}/stage", "lang")
    write_csv(spark.read.parquet(f"{path}/stage").filter("lang <> 'en'"), f"{path}/text", quote_all=True)
    return read_table_csv(spark, f"{path}/text").select("doc_id", "lang", "source", "begin")


@_query("""
    with c as (select doc_id, unicode(unnest(string_split(text, ''))) as u from documents),
    n as (select doc_id, ((u * 2654435761) % 4294967296 // 128) % 64 as b, count(*) as n from c group by all),
    x as (select doc_id, b, n / sqrt(sum(n * n) over (partition by doc_id)) as x from n),
    s as (select doc_id, k, sum(x * sin(3 * b + k)) + any_value(k) / 10 as s from x, range(4) as r(k) group by doc_id, k),
    p as (select doc_id, k, exp(s) / sum(exp(s)) over (partition by doc_id) as p from s)
    select doc_id, cast(arg_max(k, p) as bigint) as prediction, round(max(p), 6) as most from p group by doc_id""")
def stored_model_scores(get):
    """Whole texts scored by a model that executors read from the store, its weights set by a rule."""
    docs = get("documents")
    grid = linear.Grid(64, 4, (0.0,), (0.0,))
    weights = np.sin(3 * np.arange(65)[:, None] + np.arange(4))
    weights[-1] = np.arange(4) / 10
    path = new_path(docs.sparkSession, "model")
    model_store.save(docs.sparkSession, {"at": weights}, path)
    said = linear.predict(linear.hashed_counts(docs.select("doc_id", "text"), "text", 64), grid, np.ones(64), path, 0)
    return said.select("doc_id", "prediction", F.round(F.array_max("probability"), 6).alias("most"))


@_query("select p_name as title, case when p_name like '%green%' then '37-3011' when p_name like '%red%' then '51-2090' else 'N/A' end as answer, cast(count(*) as bigint) as rows from part where p_name is not null group by p_name")
def ledger_answers(get):
    """Titles asked in two runs, of which the second finds what the first was told."""
    rules, path = RuleClassifier([("green", "37-3011"), ("red", "51-2090")]), new_path(get("part").sparkSession, "ledger")
    rows = get("part").select(F.col("p_name").alias("title"))
    ledger.ask(rows.filter("title like '%green%'"), path, rules.title, "title", 8, 4)
    ledger.ask(rows, path, rules.title, "title", 8, 4)
    return ledger.with_answers(rows.filter("title is not null").groupBy("title").agg(F.count("*").alias("rows")), path, "title")


def _language_rows(get):
    """Documents with their language as label, weighted by class, split, and with their characters counted; stored."""
    docs = get("documents").select("doc_id", "lang", F.col("text").alias("description"))
    ids = encode.label_ids(docs, "lang")
    whole = encode.encode(sampling.split(docs, "doc_id", 42), ids, "lang").withColumn("weight", F.lit(1.0)).drop("lang")
    whole = whole.withColumn("text", C.feature_text(F.lit(""), F.col("description"), 2)).drop("description")
    path = new_path(docs.sparkSession, "features")
    linear.hashed_counts(whole, "text", 1 << 14).write.partitionBy("split").parquet(path)
    rows = docs.sparkSession.read.parquet(path)
    weighted = train.loss_weight(rows, encode.class_weights(rows.filter("split = 'train'"), "label_id"), "label_id")
    return {k: weighted.filter(F.col("split") == k) for k in ("train", "valid", "test")}, max(1, ids.count())


def _fitted(get):
    parts, classes = _language_rows(get)
    grid = linear.Grid.of(Config(), 1 << 14, classes)
    idf = linear.rarity(parts["train"], grid.features)
    path = new_path(get("documents").sparkSession, "model")
    linear.fit(parts["train"], grid, idf, path)
    return parts, grid, idf, path


@_query()
def grid_run_table(get):
    """All points of the grid, trained together: loss and accuracy on the validation split."""
    parts, grid, idf, path = _fitted(get)
    return linear.run_table(parts["valid"], grid, idf, path)


@_query()
def train_predict(get):
    """Fit the grid of classifiers of the language on the training split, choose by the validation split and report on
    the test split."""
    parts, grid, idf, path = _fitted(get)
    best = report.best_run(linear.run_table(parts["valid"], grid, idf, path)).first()
    said = linear.predict(parts["test"].select("label_id", "places", "counts"), grid, idf, path, best.model)
    return report.classification_report(said.select("label_id", "prediction"), "label_id", "prediction")


@_query("""
    with chars as (select unnest(string_split(text, '')) as token from documents),
    v as (select token, row_number() over (order by n desc, token) + 1 as id from (select token, count(*) as n from chars where token <> '' group by token order by n desc, token limit 64)),
    f as (select doc_id, left(repeat(source || ' ', 2) || text, 64) as t from documents),
    c as (select doc_id, i, substr(t, i, 1) as token from f, unnest(range(1, 65)) as r(i)),
    k as (select doc_id, i, case when c.token = '' then 0 else coalesce(v.id, 1) end as id from c left join v on c.token = v.token),
    look as (select id, k, f, case when id = 0 then 0 else sum(sin(0.7 * id + 1.3 * d) * cos(k + 2 * d + 3 * f)) end as x
             from range(66) as a(id), range(3) as b(k), range(2) as c(f), range(3) as e(d) group by id, k, f),
    windows as (select doc_id, i - k + 1 as i, f, sum(x) as s from k join look using (id) where i - k + 1 between 1 and 64 group by doc_id, i - k + 1, f),
    seen as (select doc_id, f, greatest(max(s) + 0.1 * f, 0) as r from windows group by doc_id, f),
    inner_ as (select doc_id, h, greatest(sum(r * sin(1 + f + 2 * h)) + 0.05, 0) as r from seen, range(3) as a(h) group by doc_id, h),
    out as (select doc_id, c, sum(r * cos(h + 3 * c)) as s from inner_, range(4) as a(c) group by doc_id, c),
    said as (select doc_id, c, s - ln(sum(exp(s)) over (partition by doc_id)) as s from out)
    select doc_id, cast(arg_max(c, s) as bigint) as prediction, round(max(s), 4) as most from said group by doc_id""")
def convolution_scores(get):
    """Texts scored by a convolutional model from the store, its weights set by a rule."""
    docs, n = get("documents"), np.arange
    rows = encode.tokens(docs, encode.vocabulary(docs, "text", 64), 64, "source", "text")
    words = np.sin(0.7 * n(66)[:, None] + 1.3 * n(3))
    words[0] = 0
    weights = {
        "words": words, "look": np.cos(n(3)[:, None, None] + 2 * n(3)[:, None] + 3 * n(2)), "look_bias": 0.1 * n(2), "mid": np.sin(1 + n(2)[:, None] + 2 * n(3)),
        "mid_bias": np.full(3, 0.05), "out": np.cos(n(3)[:, None] + 3 * n(4)), "out_bias": np.zeros(4),
    }
    path = new_path(docs.sparkSession, "model")
    convolution.save(docs.sparkSession, weights, path)
    said = convolution.predict(rows.select("doc_id", "input_ids"), convolution.load(path))
    return said.select("doc_id", "prediction", F.round(F.array_max("scores").cast("double"), 4).alias("most"))


@_query()
def cnn_train_predict(get):
    """Fit the convolutional classifier of the language on the training split, stopping early by the validation
    split, and report on the test split."""
    docs = get("documents").select("doc_id", "lang", F.lit("").alias("title"), F.col("text").alias("description"))
    ids = encode.label_ids(docs, "lang")
    whole = encode.encode(sampling.split(docs, "doc_id", 42), ids, "lang").withColumn("weight", F.lit(1.0))
    fit_on = whole.filter("split = 'train'")
    vocab = encode.vocabulary(fit_on, "description", 1000)
    weighted = train.loss_weight(whole, encode.class_weights(fit_on, "label_id"), "label_id")
    rows = encode.tokens(weighted, vocab, Config().max_length).select("doc_id", "split", "label_id", "loss_weight", "input_ids")
    path = new_path(docs.sparkSession, "rows")
    write_stage(rows, path, "split")  # each epoch reads the validation rows again
    stored = docs.sparkSession.read.schema(rows.schema).parquet(path)
    part = lambda name: stored.filter(F.col("split") == name)
    w, _ = convolution.fit(part("train"), part("valid"), convolution.initial(1002, max(1, ids.count())), "doc_id")
    said = convolution.predict(part("test"), w)
    return report.classification_report(said.select("label_id", "prediction"), "label_id", "prediction")
