"""The opN_ queries: each applies one operator, with production parameters, to its whole table
and derives the agreed digest columns from the operator's result."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wayfare.llm import chunk_dedup, decontamination, embedding_graph, html_extract, minhash, packing, secrets, sharding, suffix_dedup, toxicity
from wayfare.llm.common import ship, short_batches, text_or_empty


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    ship(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_factorization_machine_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    short_batches(spark)
    model = toxicity.fit(docs, _table(spark, sf_dir, "labels").select("doc_id", "toxic"))
    scored = toxicity.score(docs.withColumn("held_out", toxicity.held_out()), model)
    return scored.select("doc_id", "held_out", "score", "predicted")


def op2_pruned_graph_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_graph.near_duplicates(_table(spark, sf_dir, "embeddings").select("vec_id", "embedding"))


def op3_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = suffix_dedup.remove_repeats(_table(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select(
        "doc_id",
        "n_bytes",
        (F.col("n_bytes") - F.octet_length("kept")).cast("long").alias("n_removed"),
        F.size("removed").cast("long").alias("n_spans"),
        F.sha2("kept", 256).alias("kept_sha256"),
    )


def op4_bm25_wand_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    found = decontamination.find_leaks(docs, _table(spark, sf_dir, "benchmark").select("item_id", "text"))
    return found.select("doc_id", F.explode("leaks").alias("leak")).select("doc_id", "leak.*")


def tokenizer_path(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op5_grouping_genetic_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(_table(spark, sf_dir, "documents").select("doc_id", "text"), tokenizer_path(), 2048)


def op6_histogram_sort_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    shards = sharding.shard_documents(_table(spark, sf_dir, "documents").select("doc_id", "text"), shards=8)
    return shards.select(
        "doc_id",
        "size",
        F.crc32(F.encode(text_or_empty(), "UTF-8")).alias("text_crc32"),
        F.lit("bytes").alias("law"),
        "shard",
        "slot",
        F.lit(None).cast("int").alias("grown_shard"),
    )


def op7_signature_join_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(_table(spark, sf_dir, "documents").select("doc_id", "text"))


def op8_flat_block_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_extract.extract(_table(spark, sf_dir, "pages").select("page_id", "url", "html")).drop("html")


def op9_gear_chunk_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents that lose something, with the documents that have it first."""
    found = chunk_dedup.remove_repeats(_table(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.where(F.size("removed") > 0).select(
        "doc_id",
        "n_bytes",
        (F.col("n_bytes") - F.octet_length("kept_text")).cast("long").alias("n_removed"),
        F.size("removed").cast("long").alias("n_spans"),
        F.sha2(F.encode("kept_text", "UTF-8"), 256).alias("kept_sha256"),
        "first_doc_ids",
    )


def op10_trigram_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    scanned = secrets.scan_secrets(_table(spark, sf_dir, "documents").select("doc_id", "text"))
    base = F.filter("secret_spans", lambda s: s["kind"].isin(*[r.kind for r in secrets.RULES if r.base]))

    def count(kind):
        return F.size(F.filter("secret_spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

    return scanned.select(
        "doc_id",
        count("assign"),
        count("access"),
        count("hex"),
        F.sha2(F.encode(secrets.spans_text(base), "UTF-8"), 256).alias("base_sha256"),
        secrets.spans_text(F.col("secret_spans")).alias("spans"),
    )


def _secret_sql() -> str:
    """Every rule on every text, without an index."""
    parts = []
    for rank, rule in enumerate(secrets.RULES):
        pattern = rule.pattern.replace("'", "''")
        parts.append(
            f"""select r, '{rule.kind}' as kind, {rank} as rank, {str(rule.base).lower()} as base, unnest(list_transform(range(1, len(hits) + 1), lambda i: {{
              'start': list_sum(list_transform(gaps[1:i], lambda g: length(g)))::bigint + coalesce(list_sum(list_transform(hits[1:i-1], lambda g: length(g))), 0)::bigint,
              'size': length(hits[i]), 'part': length(parts[i])}})) as s
            from (select r, string_split_regex(x, '{pattern}') as gaps, regexp_extract_all(x, '{pattern}') as hits,
              regexp_extract_all(x, '{pattern}', {rule.group}) as parts from t where regexp_matches(x, '{pattern}'))"""
        )
    keep = " or ".join(f"(kind = '{r.kind}' and s.part >= {r.least})" for r in secrets.RULES)
    return f"""with t as (select row_number() over () as r, doc_id, coalesce(text, '') as x from documents),
    found as (select * from ({' union all '.join(parts)}) where {keep}),
    said as (select r, kind, rank, base, s.start as a, s.start + s.size as b, concat(kind, ':', s.start, ':', s.start + s.size) as span from found),
    per as (select r, count(*) filter (kind = 'assign') as n_assign, count(*) filter (kind = 'access') as n_access,
      count(*) filter (kind = 'hex') as n_hex, string_agg(span, ',' order by a, rank, b) filter (base) as base_spans,
      string_agg(span, ',' order by a, rank, b) as spans from said group by r)
    select doc_id, coalesce(n_assign, 0) as n_assign, coalesce(n_access, 0) as n_access, coalesce(n_hex, 0) as n_hex,
      sha256(coalesce(base_spans, '')) as base_sha256, coalesce(spans, '') as spans from t left join per using (r)"""


_SUFFIX_SQL = """with t as (select row_number() over () as r, doc_id, coalesce(text, '') as x, hex(encode(coalesce(text, ''))) as h from documents),
w as (select r, doc_id, p, substr(h, 2 * p + 1, 100) as s from (select r, doc_id, h, unnest(range(0, greatest(length(h) // 2 - 49, 0))) as p from t) where doc_id is not null),
f as (select s, min(doc_id) as first from w group by s),
g as (select r, p, p > coalesce(lag(p) over (partition by r order by p) + 50, -1) as starts from w join f using (s) where first < doc_id),
n as (select r, min(p) as a, max(p) + 50 as b from (select r, p, sum(starts::int) over (partition by r order by p) as run from g) group by r, run),
k as (select t.r, n.a, n.b, substr(h, 2 * coalesce(lag(n.b) over v, 0) + 1, 2 * (n.a - coalesce(lag(n.b) over v, 0))) as part, max(n.b) over (partition by t.r) as last
  from t join n using (r) window v as (partition by t.r order by n.a)),
c as (select r, string_agg(part, '' order by a) as parts, sum(b - a) as gone, count(*) as spans, any_value(last) as last from k group by r)
select doc_id, length(h) // 2 as n_bytes, coalesce(gone, 0)::bigint as n_removed, coalesce(spans, 0)::bigint as n_spans,
  sha256(unhex(coalesce(parts, '') || substr(h, 2 * coalesce(last, 0) + 1))) as kept_sha256 from t left join c using (r)"""

_SHINGLE_SQL = r"""with recursive t as (select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') as w from documents),
s as (select doc_id, list_distinct(case when len(w) > 1 then list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]) else w end) as own from t),
u as (select doc_id, len(own) as n, unnest(own) as sh from s),
l as (select a.doc_id as x, b.doc_id as y from u a join u b on a.sh = b.sh and a.doc_id < b.doc_id group by a.doc_id, b.doc_id, a.n, b.n having 100 * count(*) >= 80 * (a.n + b.n - count(*))),
e as (select x, y from l union all select y, x from l),
r(x, y) as (select doc_id, doc_id from s union select r.x, e.y from r join e on r.y = e.x)
select doc_id, len(own) as n_shingles, component_id, doc_id = component_id as kept from s join (select x as doc_id, min(y) as component_id from r group by x) using (doc_id)"""

_LINK_SQL = """with recursive t as (select row_number() over () as r, vec_id, list_transform(embedding, lambda x: x::double) as e from embeddings),
g as (select * from t where len(e) > 0 and len(list_filter(e, lambda x: x is null or not isfinite(x))) = 0 and len(list_filter(e, lambda x: x <> 0)) > 0),
l as (select a.r as x, b.r as y from g a join g b on len(a.e) = len(b.e) and a.r <> b.r where list_cosine_similarity(a.e, b.e) >= 0.95),
c(x, y) as (select r, r from t union select c.x, l.y from c join l on c.y = l.x),
m as (select x, min(vec_id) as component_id from c join t on t.r = c.y group by x),
n as (select x, count(*) as n from l group by x)
select vec_id, coalesce(n, 0)::bigint as n_links, component_id, coalesce(vec_id = component_id, component_id is null) as kept
from t join m on m.x = t.r left join n on n.x = t.r"""

QUERIES = {
    "op1_factorization_machine_toxicity": op1_factorization_machine_toxicity,
    "op2_pruned_graph_near_dedup": op2_pruned_graph_near_dedup,
    "op3_suffix_array_dedup": op3_suffix_array_dedup,
    "op4_bm25_wand_decontamination": op4_bm25_wand_decontamination,
    "op5_grouping_genetic_packing": op5_grouping_genetic_packing,
    "op6_histogram_sort_shards": op6_histogram_sort_shards,
    "op7_signature_join_near_dedup": op7_signature_join_near_dedup,
    "op8_flat_block_html_extraction": op8_flat_block_html_extraction,
    "op9_gear_chunk_dedup": op9_gear_chunk_dedup,
    "op10_trigram_secret_scan": op10_trigram_secret_scan,
}

ORACLE_SQL = {
    "op2_pruned_graph_near_dedup": _LINK_SQL,
    "op3_suffix_array_dedup": _SUFFIX_SQL,
    "op7_signature_join_near_dedup": _SHINGLE_SQL,
    "op10_trigram_secret_scan": _secret_sql(),
}
