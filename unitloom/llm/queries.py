"""Registered queries of the operators: production parameters, whole tables, digest columns."""

import uuid

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, functions as F

from unitloom.llm import statements, toxicity
from unitloom.llm.bpe import decode, encode, read_ranks
from unitloom.llm.filter_audit import audit
from unitloom.llm.forest import near_vectors
from unitloom.llm.html_text import page_texts
from unitloom.llm.licenses import scan, scan_sql
from unitloom.llm.linedups import drop_shared_lines
from unitloom.llm.minhash import near_duplicates
from unitloom.llm.mixing import SEEDS, plan
from unitloom.llm.repeats import remove_repeats
from unitloom.llm.shared import shared_folder, small_batches
from unitloom.llm.topk import quantised, top_k
from unitloom.llm.vector_codes import coded
from unitloom.llm.warc import page_of, read_archives, write_archives

QUERIES = {}
SQL = {}


def query(fn):
    QUERIES[fn.__name__] = fn
    return fn


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    if name in ("documents", "pages"):
        small_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@query
def op1_rp_forest(spark, sf_dir):
    """Near duplicates of all vectors within their labels."""
    return near_vectors(table(spark, sf_dir, "embeddings"))


SQL["op1_rp_forest"] = statements.NEAR_VECTORS


@query
def op2_circulant_minhash(spark, sf_dir):
    """Near duplicates of all documents on two-word shingles."""
    found = near_duplicates(table(spark, sf_dir, "documents"), width=2, percent=80)
    return found.select("doc_id", "n_shingles", "component_id", "kept")


SQL["op2_circulant_minhash"] = statements.NEAR_DOCUMENTS


@query
def op4_byte_bpe(spark, sf_dir):
    """Ids and decoded bytes of all documents, as digests."""
    ranks = read_ranks(public_tokenizers.path("byte_bpe_50k.tiktoken"))
    tokens = encode(table(spark, sf_dir, "documents"), ranks, public_tokenizers.PATTERN)
    return decode(tokens, ranks).select(
        "doc_id", F.expr("length(ids) div 4").alias("n_tokens"), F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


@query
def op3_suffix_dedup(spark, sf_dir):
    """Bytes of all documents that lie in an earlier 100-byte string."""
    return remove_repeats(table(spark, sf_dir, "documents")).select(
        "doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256")
    )


SQL["op3_suffix_dedup"] = statements.REPEATS


@query
def op9_exact_topk(spark, sf_dir):
    """The ten best vectors for every hundredth vector, exactly."""
    vectors = quantised(table(spark, sf_dir, "embeddings"))
    return top_k(vectors, vectors.filter("vec_id % 100 = 0"))


SQL["op9_exact_topk"] = """
WITH v AS (
  SELECT DISTINCT vec_id, list_transform(embedding, lambda x: CAST(floor(1024 * CAST(x AS DOUBLE)) AS BIGINT)) AS q
  FROM embeddings
  WHERE vec_id IS NOT NULL AND len(embedding) > 0
    AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0
), s AS (
  SELECT a.vec_id AS query_id, b.vec_id AS vec_id, CAST(list_sum(list_transform(list_zip(a.q, b.q), lambda p: p[1] * p[2])) AS BIGINT) AS score
  FROM v a JOIN v b ON a.vec_id <> b.vec_id AND len(a.q) = len(b.q)
  WHERE a.vec_id % 100 = 0
)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score
FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s)
WHERE rank <= 10
"""


@query
def op5_mix_sources(spark, sf_dir):
    """The mix of all documents: sizes, targets of their sources and words taken."""
    planned = plan(table(spark, sf_dir, "documents"))
    return planned.select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("repeats")).alias("taken"))


SQL["op5_mix_sources"] = f"""
WITH d AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')), 0) AS size FROM documents
), s AS (
  SELECT source, sum(size)::BIGINT AS source_size, (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1 AS weight
  FROM d GROUP BY source
), r AS (
  SELECT *, 3.0::DOUBLE * source_size AS cap,
    coalesce(sum(3.0::DOUBLE * source_size) OVER (ORDER BY 3.0::DOUBLE * source_size / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before,
    sum(weight) OVER (ORDER BY 3.0::DOUBLE * source_size / weight, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS rest
  FROM s
), l AS (SELECT max(((SELECT sum(size) FROM d) - before) / rest) AS level FROM r),
t AS (
  SELECT source, source_size, least(cap, weight * level) AS target,
    CASE WHEN source_size > 0 THEN least(cap, weight * level) / source_size ELSE 0 END AS rate FROM r, l
), n AS (
  SELECT d.*, t.source_size, t.target, floor(t.rate) AS base, t.rate - floor(t.rate) AS fraction, k.seed,
    CAST('0x' || substr(md5(coalesce(doc_id::VARCHAR, 'null') || ':' || k.seed), 1, 13) AS BIGINT)::DOUBLE / 4503599627370496.0 AS u
  FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source, (SELECT unnest(range({SEEDS})) AS seed) k
), m AS (
  SELECT source, seed, abs(any_value(base) * any_value(source_size) + sum(CASE WHEN u < fraction THEN size ELSE 0 END) - any_value(target)) AS miss
  FROM n WHERE size > 0 GROUP BY source, seed
), b AS (SELECT source, min_by(seed, (miss, seed)) AS seed FROM m GROUP BY source)
SELECT n.doc_id, n.size, n.source_size, n.target, CAST(n.size * (base + CASE WHEN u < fraction THEN 1 ELSE 0 END) AS BIGINT) AS taken
FROM n LEFT JOIN b ON n.source IS NOT DISTINCT FROM b.source
WHERE n.seed = coalesce(b.seed, 0)
"""


@query
def op6_license_scan(spark, sf_dir):
    """Licences of all documents; lists as joined text."""
    found = scan(table(spark, sf_dir, "documents"))
    lists = ("sentence_ids", "licenses", "unmatched")
    return found.select("doc_id", "n_sentences", *[F.array_join(c, ",").alias(c) for c in lists])


SQL["op6_license_scan"] = scan_sql()


@query
def op7_line_dedup(spark, sf_dir):
    """Lines that go from all documents, and digests of the remaining texts."""
    kept = drop_shared_lines(table(spark, sf_dir, "documents"))
    return kept.select("doc_id", "n_lines", "n_removed", F.sha2(F.encode("text", "UTF-8"), 256).alias("kept_sha256"))


@query
def op8_toxicity(spark, sf_dir):
    """Toxicity of all documents by a model of the labelled ones that are not held out."""
    docs = table(spark, sf_dir, "documents")
    scored = toxicity.score(docs.select("doc_id", "text"), toxicity.fit(docs, table(spark, sf_dir, "labels")))
    return scored.select("doc_id", toxicity.held_out().alias("held_out"), "score", "predicted")


@query
def op10_html_text(spark, sf_dir):
    """Visible text of all pages."""
    return page_texts(table(spark, sf_dir, "pages"))


@query
def op11_filter_audit(spark, sf_dir):
    """Five filters over all documents, in all orders."""
    return audit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


SQL["op11_filter_audit"] = statements.FILTER_AUDIT


@query
def op12_vector_codes(spark, sf_dir):
    """Codes of all vectors by four codebooks of 256 entries."""
    return coded(table(spark, sf_dir, "embeddings"))


SQL["op12_vector_codes"] = statements.vector_codes(4, 256, 4)


@query
def op13_zstd_warc(spark, sf_dir):
    """All pages through Zstandard archives and back."""
    folder = f"{shared_folder(spark)}/table-warc-{uuid.uuid4()}"
    write_archives(table(spark, sf_dir, "pages"), folder)
    read = read_archives(spark, folder, payloads=False)
    return read.select(page_of(F.col("record_id")).alias("page_id"), "payload_bytes", "payload_digest", "record_type", page_of(F.col("refers_to")).alias("refers_to"))


SQL["op13_zstd_warc"] = statements.WARC
