"""The queries of this subpackage: each applies one operator to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import audit, language_id, lexical, token_files, toxicity, warc
from .bloom_dedup import exact_dedup
from .chosen_path import near_duplicates
from .common import LOWER, UPPER, new_path, table
from .histogram_sort import shard_by_bytes
from .html_text import extract
from .mixing import ROUNDS, Marginal, mix
from .packing import pack
from .subspace_join import near_vectors

#: The mix that is asked for: large sources, languages and topics shrink and small ones grow, whatever their
#: names and shares. Mild powers, so that most documents can stay.
TARGETS = [
    Marginal("source", flatten=0.8),
    Marginal("lang", flatten=0.9),
    Marginal("topic", flatten=0.95),
]
KEEP = 0.7


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def op1_toxicity_chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    quality, toxic = F.col("quality"), F.col("toxic")
    # the labels tell two kinds of toxic texts apart; what the chain says of each informs the answer at its end
    categories = {"toxic_prose": (toxic == 1) & (quality == 1), "toxic_junk": (toxic == 1) & (quality == 0), "toxic": toxic == 1}
    chain = toxicity.fit(docs, table(spark, sf_dir, "labels"), categories)
    return toxicity.classify(docs, chain).select("doc_id", F.col("is_toxic").alias("toxic"), "p_toxic", "p_toxic_prose", "p_toxic_junk")


def op2_naive_bayes_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    held_out = language_id.is_held_out(F.col("doc_id"))
    model = language_id.fit(docs.filter(~held_out))
    scored = language_id.identify(docs.select("doc_id", "text"), model)
    return scored.select("doc_id", held_out.alias("held_out"), "lang_pred", "score")


def op3_raked_mixture(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mix(table(spark, sf_dir, "documents"), TARGETS, KEEP)
    rounded = [F.round(c, 6).alias(c) for c in ("weight", "probability")]
    return mixed.select("doc_id", "source", "lang", "topic", "tokens", *rounded, "kept")


def op4_tiered_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    pieces = pack(table(spark, sf_dir, "documents"), tokenizer_path())
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset", "tier", "step_group")


def op5_warc_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = new_path(spark, "warc")
    warc.write_warc(table(spark, sf_dir, "pages").select("page_id", "url", "html"), path)
    page = lambda c: F.nullif(F.regexp_extract(c, "^<urn:page:(.*)>$", 1), F.lit("")).cast("long")
    responses = warc.read_warc(spark, path, ["record_id", "warc_type", "payload"]).filter("warc_type = 'response'").select(
        page("record_id").alias("page_id"),
        F.octet_length("payload").cast("long").alias("payload_bytes"),
        warc.sha1_base32(F.col("payload")).alias("payload_digest"),
        F.col("warc_type").alias("record_type"),
        F.lit(None).cast("long").alias("refers_to"),
    )
    revisits = warc.read_warc(spark, path, ["record_id", "warc_type", "payload_digest", "refers_to", "payload_length"]).filter("warc_type = 'revisit'").select(
        page("record_id").alias("page_id"),
        F.col("payload_length").alias("payload_bytes"),
        F.regexp_replace("payload_digest", "^sha1:", "").alias("payload_digest"),
        F.col("warc_type").alias("record_type"),
        page("refers_to").alias("refers_to"),
    )
    return responses.unionByName(revisits)


def op6_line_block_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(table(spark, sf_dir, "pages").select("page_id", "url", "html"))


def op7_subspace_near_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_vectors(table(spark, sf_dir, "embeddings").select("vec_id", "embedding"))


def op8_bloom_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return exact_dedup(docs).select("doc_id", "keep_id", "group_size", "kept", "text_sha256")


def op9_histogram_sort_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    docs = docs.withColumn("text_crc32", F.crc32(F.coalesce(F.col("text"), F.lit("")).cast("binary")))
    return shard_by_bytes(docs, shards=8).select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard")
    )


def op10_chosen_path_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op11_packed_token_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = new_path(spark, "tokens")
    token_files.write_tokens(table(spark, sf_dir, "documents").select("doc_id", "text"), path, tokenizer_path())
    return token_files.read_tokens(spark, path).select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))


def op12_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "source")
    return audit.audit(audit.flagged(docs, table(spark, sf_dir, "labels").select("doc_id", "quality", "toxic")))


def op13_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, items = (table(spark, sf_dir, name) for name in ("documents", "benchmark"))
    return lexical.search(docs.select("doc_id", "text"), items.select("item_id", "text"), k=10)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_toxicity_chain": op1_toxicity_chain,
    "op2_naive_bayes_language": op2_naive_bayes_language,
    "op3_raked_mixture": op3_raked_mixture,
    "op4_tiered_packing": op4_tiered_packing,
    "op5_warc_round_trip": op5_warc_round_trip,
    "op6_line_block_text": op6_line_block_text,
    "op7_subspace_near_vectors": op7_subspace_near_vectors,
    "op8_bloom_exact_dedup": op8_bloom_exact_dedup,
    "op9_histogram_sort_shards": op9_histogram_sort_shards,
    "op10_chosen_path_near_dedup": op10_chosen_path_near_dedup,
    "op11_packed_token_ids": op11_packed_token_ids,
    "op12_filter_audit": op12_filter_audit,
    "op13_lexical_search": op13_lexical_search,
}


def _mixture_sql() -> str:
    """Raking as a recursion over the cells, its three steps being window sums. All values are named; null is other."""
    goals = []
    for i, m in enumerate(TARGETS):
        if m.flatten is not None:
            goals.append(f"g{i} as (select c{i}, power(sum(n) / (select sum(n) from cells), {m.flatten!r}) as g from cells group by c{i})")
        else:
            named = " ".join(f"when {v!r} then {x!r}" for v, x in m.targets.items())
            goals.append(f"g{i} as (select distinct c{i}, case c{i} {named} end::double as g from cells)")
    goal = ", ".join(f"h{i} as (select c{i}, g / sum(g) over () * (select sum(n) from cells) as g{i} from g{i})" for i in range(len(TARGETS)))
    step = f"it where k < {ROUNDS}"
    for i in range(len(TARGETS)):
        step = f"(select * exclude (w), w * g{i} / sum(n * w) over (partition by c{i}) as w from {step})"
    return rf"""
        with recursive s as (
            select doc_id, source, lang, coalesce(text, '') as t from documents
        ), t as (
            select doc_id, source, lang, case when length(t) < 400 then 'note' when length(t) < 2000 then 'article' when length(t) < 10000 then 'essay' else 'book' end as topic,
                   strlen(t) // 4 + 1 as tokens
            from s
        ), l as (
            select *, coalesce(source, 'other') as c0, coalesce(lang, 'other') as c1, topic as c2 from t
        ), cells as (
            select c0, c1, c2, sum(tokens)::double as n from l group by c0, c1, c2
        ), {", ".join(goals)}, {goal}, it as (
            select c0, c1, c2, n, g0, g1, g2, 0 as k, 1.0::double as w from cells join h0 using (c0) join h1 using (c1) join h2 using (c2)
            union all
            select c0, c1, c2, n, g0, g1, g2, k + 1 as k, w from {step}
        ), r as (
            select c0, c1, c2, w, least({KEEP!r}, 1 / max(w) over ()) as rate from it where k = {ROUNDS}
        )
        select doc_id, source, lang, topic, tokens, round(w, 6) as weight, round(least(1.0, rate * w), 6) as probability,
               cast('0x' || substr(md5('42:' || coalesce(cast(doc_id as varchar), '')), 1, 12) as bigint) / {2.0**48!r} < least(1.0, rate * w) as kept
        from l join r using (c0, c1, c2)"""


#: Smallest node that each node reaches by links l(a, b).
_REACHED = """e as (
            select a, b from l union all select b, a from l
        ), r(node, root) as (
            select id, id from ids union select e.b, r.root from r join e on e.a = r.node
        ), c as (
            select node as id, min(root) as component_id from r group by node
        )"""

ORACLE_SQL: dict[str, str] = {
    "op3_raked_mixture": _mixture_sql(),
    "op5_warc_round_trip": """
        with bits as (
            select page_id, strlen(coalesce(html, '')) as payload_bytes, sha1(coalesce(html, '')) as digest from pages
        ), based as (
            select page_id, payload_bytes, digest, min(page_id) over (partition by digest) as first,
                   array_to_string(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
                     1 + cast((cast('0x' || substr(digest, cast(1 + 5 * (i // 4) as bigint), 5) as bigint) >> cast(5 * (3 - i % 4) as bigint)) & 31 as bigint), 1)), '') as payload_digest
            from bits
        )
        select page_id, cast(payload_bytes as bigint) as payload_bytes, payload_digest,
               case when page_id > first then 'revisit' else 'response' end as record_type,
               case when page_id > first then first end as refers_to
        from based""",
    "op7_subspace_near_vectors": f"""
        with recursive ids as (
            select vec_id as id from embeddings
        ), v as (
            select vec_id, list_transform(embedding, lambda x: cast(x as double)) as v from embeddings where embedding is not null
        ), n as (
            select vec_id, v, sqrt(list_dot_product(v, v)) as s from v where isfinite(list_dot_product(v, v)) and list_dot_product(v, v) > 0
        ), l as (
            select x.vec_id as a, y.vec_id as b from n x join n y on x.vec_id < y.vec_id where list_dot_product(x.v, y.v) / (x.s * y.s) >= 0.95
        ), {_REACHED}
        select id as vec_id, (select count(*) from e where e.a = c.id) as n_links, component_id, id = component_id as kept from c""",
    "op8_bloom_exact_dedup": f"""
        with t as (select doc_id, translate(coalesce(text, ''), '{UPPER}', '{LOWER}') as norm from documents)
        select doc_id, max(doc_id) over (partition by norm) as keep_id,
               count(*) over (partition by norm) as group_size,
               row_number() over (partition by norm order by doc_id desc) = 1 as kept,
               sha256(norm) as text_sha256
        from t""",
    "op10_chosen_path_near_dedup": rf"""
        with recursive ids as (
            select doc_id as id from documents
        ), w as (
            select doc_id, regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '[^\x20\x09-\x0D]+') as w from documents
        ), g as (
            select distinct doc_id, unnest(case when len(w) >= 5 then list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' '))
                                                when len(w) > 0 then [array_to_string(w, ' ')] end) as g
            from w
        ), n as (
            select doc_id, count(*) as n from g group by doc_id
        ), p as (
            select x.doc_id as a, y.doc_id as b, count(*) as k from g x join g y on x.g = y.g and x.doc_id < y.doc_id group by all
        ), l as (
            select a, b from p join n x on a = x.doc_id join n y on b = y.doc_id where 100 * k >= 85 * (x.n + y.n - k)
        ), {_REACHED}
        select id as doc_id, coalesce(n.n, 0) as n_shingles, component_id, id = component_id as kept from c left join n on id = n.doc_id""",
    "op12_filter_audit": r"""
        with d as (
            select doc_id, coalesce(source, '') as part, coalesce(text, '') as t from documents
        ), w as (
            select *, regexp_extract_all(t, '[^\x20\x09-\x0D]+') as w from d
        ), x as (
            select doc_id, part, t, (len(w) < 200)::int + 2 * (100 * len(list_distinct(w)) < 50 * len(w))::int
                   + 4 * (100 * len(regexp_extract_all(t, '[A-Z]')) > 2 * length(t))::int + 8 * regexp_matches(t, '[#$%&*|]')::int
                   + 16 * coalesce(doc_id > min(doc_id) over (partition by t), false)::int as fails
            from w
        ), l as (
            select doc_id, max((quality = 1)::int) as good, max((toxic = 1)::int) as toxic from labels group by doc_id
        ), c as (
            select part, fails, count(*) as n, coalesce(sum(good), 0) as good, coalesce(sum(toxic), 0) as toxic from x left join l using (doc_id) group by all
        ), letters as (
            select unnest(['A', 'B', 'C', 'D', 'E']) as f, unnest([1, 2, 4, 8, 16]) as bit
        ), o as (
            select a.f || b.f || c.f || d.f || e.f as filter_order, [a.bit, b.bit, c.bit, d.bit, e.bit] as bits
            from letters a, letters b, letters c, letters d, letters e where a.bit | b.bit | c.bit | d.bit | e.bit = 31
        ), s as (
            select filter_order, cast(k as int) as step, bits[k] as bit, cast(coalesce(list_sum(bits[1:k - 1]), 0) as int) as before from o, range(1, 6) as r(k)
        ), m as (
            select part, filter_order, step, bit,
                   sum(case when fails & (before | bit) = 0 then n else 0 end) as kept,
                   sum(case when fails & before = 0 and fails & bit > 0 then n else 0 end) as removed,
                   sum(case when fails & before > 0 and fails & bit > 0 then n else 0 end) as redundant,
                   sum(case when fails = bit then n else 0 end) as unique_fails,
                   sum(case when fails & before = 0 and fails & bit > 0 then good else 0 end) as good_lost,
                   sum(case when fails & before = 0 and fails & bit > 0 then toxic else 0 end) as toxic_lost
            from c, s group by all
        )
        select part, filter_order, step, cast(kept as bigint) as kept, cast(removed as bigint) as removed, cast(redundant as bigint) as redundant,
               cast(unique_fails as bigint) as unique_fails, cast(good_lost as bigint) as good_lost, cast(toxic_lost as bigint) as toxic_lost,
               cast(sum(removed) over (partition by part, bit) as bigint) as shapley
        from m""",
    "op13_lexical_search": rf"""
        with d as (
            select doc_id, regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') as w from documents
        ), c as (
            select count(*) filter (len(w) > 0) as n_docs, coalesce(sum(len(w)), 0)::bigint as n_terms from d
        ), i as (
            select item_id, unnest(list_distinct(regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+'))) as term from benchmark
        ), u as (
            select doc_id, len(w) as n, unnest(w) as term from d
        ), p as (
            select doc_id, n, term, count(*) as tf from u where term in (select term from i) group by all
        ), t as (
            select term, cast(floor(1000 * ln((2 * n_docs + 2) / (2 * count(*) + 1))) as bigint) as w from p, c group by term, n_docs
        ), s as (
            select item_id, doc_id, sum(w * ((1000000000 * tf) // (1000 * tf + 8 * (10 + (90 * n * n_docs) // n_terms)))) as score
            from i join p using (term) join t using (term), c group by all
        ), r as (
            select item_id, row_number() over (partition by item_id order by score desc, doc_id) as rank, doc_id, score from s where score > 0
        )
        select item_id, cast(rank as int) as rank, doc_id, cast(score as bigint) as score from r where rank <= 10""",
}
