"""Hybrid search: three cosine lanes minus a text rank, top-k, optional neighbours."""

from pyspark.sql import DataFrame, SparkSession, functions as F

from unitloom.functions import texts
from unitloom.functions.embedding import DEFAULT_MODEL, embed_text
from unitloom.functions.lexical import query_terms
from unitloom.functions.paths import is_test_hit
from unitloom.functions.vectors import lane_weights
from unitloom.operators import graph, topk
from unitloom.schema import EMBED_DIM
from unitloom.sources.tables import bucket_of

HIT_COLUMNS = ["qualified_name", "path", "role", "namespace", "content"]
SCORE_COLUMNS = ["d_func", "d_call", "d_class", "ts_score", "score"]


def one_query(spark: SparkSession, text: str) -> DataFrame:
    return spark.createDataFrame([(0, text)], "query_id long, query string")


def prepare_queries(queries: DataFrame, model: str = DEFAULT_MODEL, dim: int = EMBED_DIM) -> DataFrame:
    """query_id, query -> query_id, qv, terms; each query is embedded once."""
    return queries.select(
        "query_id", embed_text("query", model, dim).alias("qv"), query_terms("query").alias("terms")
    )


def find_hits(
    units: DataFrame, queries: DataFrame, *, lane: str, weights: dict | None = None, k: int = 10,
    namespace: str | None = None, default_namespace: str | None = None,
    deprioritize_tests: bool = True, exclude_tests: bool = False, push_test_filter: bool = False,
    buckets: int | None = None, model: str = DEFAULT_MODEL, dim: int = EMBED_DIM,
) -> DataFrame:
    """At most k ranked hits per query, with the columns a hit carries.

    The namespace filter and, on request, the test filter run before scoring. Without
    `push_test_filter` tests are handled among 3k fetched rows, so fewer than k hits
    can remain. Wide columns are fetched for the winners only; with `buckets` (that of
    the unit table) from the folders that hold a winner.
    """
    namespace = namespace if namespace is not None else default_namespace
    if namespace is not None:
        units = units.filter(F.col("namespace") == namespace)
    searched = units
    if push_test_filter and exclude_tests:
        searched = units.filter(~is_test_hit())
    found = topk.score_units(
        searched, prepare_queries(queries, model, dim), weights=lane_weights(lane, weights),
        fetch=topk.fetch_size(k, deprioritize_tests, exclude_tests), dim=dim,
    ).drop("rank")
    # The winners are at most 3k rows per query of a counted query table.
    bounded = queries.count() * 3 * k <= 1_000_000
    keys = ["id"]
    if buckets:
        found, keys = found.withColumn("bucket", bucket_of("id", buckets)), ["id", "bucket"]
    described = units.select(*keys, *HIT_COLUMNS).withColumn("namespace", F.coalesce("namespace", F.lit("")))
    hits = described.join(F.broadcast(found) if bounded else found, keys)
    hits = topk.settle_tests(hits, k, deprioritize=deprioritize_tests, exclude=exclude_tests)
    return hits.select("query_id", "rank", "id", *HIT_COLUMNS, *SCORE_COLUMNS)


def search(units: DataFrame, queries: DataFrame, **options) -> DataFrame:
    """Units by signature and doc."""
    return find_hits(units, queries, lane="func", **options)


def call_search(units: DataFrame, queries: DataFrame, **options) -> DataFrame:
    """Units by what they call."""
    return find_hits(units, queries, lane="call", **options)


def class_search(units: DataFrame, queries: DataFrame, **options) -> DataFrame:
    """Units by class and inheritance."""
    return find_hits(units, queries, lane="class", **options)


def render_hits(hits: DataFrame, queries: DataFrame) -> DataFrame:
    """One text per query; a query without hits says so. A query has at most k hits."""
    blocks = hits.select("query_id", "rank", texts.hit_block().alias("block"))
    grouped = blocks.groupBy("query_id").agg(
        F.sort_array(F.collect_list(F.struct("rank", "block"))).alias("blocks")
    )
    joined = queries.select("query_id").join(grouped, "query_id", "left")
    text = F.array_join(F.col("blocks.block"), "\n\n")
    return joined.select("query_id", F.coalesce(text, F.lit("no results")).alias("text"))


def search_with_context(
    units: DataFrame, edges: DataFrame, queries: DataFrame, *, k: int = 10, expand_depth: int = 1,
    resolve: str = "exact", page_rows: int = graph.PAGE_ROWS, deprioritize_tests: bool = True,
    exclude_tests: bool = False, **options,
) -> DataFrame:
    """Balanced-lane hits with callees and callers up to `expand_depth` hops.

    Tests are filtered before expansion (the kept set depends on hits only); kept
    hits stay in score order. One row per hit and page of neighbours.
    """
    hits = context_hits(units, queries, k=k, deprioritize_tests=deprioritize_tests, exclude_tests=exclude_tests, **options)
    return graph.with_context(hits, units, edges, depth=expand_depth, resolve=resolve, page_rows=page_rows)


def context_hits(units: DataFrame, queries: DataFrame, *, deprioritize_tests: bool = True, **options) -> DataFrame:
    """Balanced-lane hits in score order, whose neighbours are to be shown."""
    return rerank(find_hits(units, queries, lane="balanced", deprioritize_tests=deprioritize_tests, **options))


def rerank(hits: DataFrame) -> DataFrame:
    """Rank kept hits by score again: the test rule chose the set, not the order."""
    return topk.top_k_per(hits.drop("rank"), "query_id", 2**31 - 1)


def render_contexts(contexts: DataFrame, queries: DataFrame) -> DataFrame:
    """One text per query and neighbour page."""
    blocks = contexts.select(
        "query_id", "page", "rank",
        texts.context_block(n_callees="n_callees", n_callers="n_callers").alias("block"),
    )
    grouped = blocks.groupBy("query_id", "page").agg(
        F.sort_array(F.collect_list(F.struct("rank", "block"))).alias("blocks")
    )
    joined = queries.select("query_id").join(grouped, "query_id", "left")
    text = F.array_join(F.col("blocks.block"), "\n\n")
    return joined.select(
        "query_id", F.coalesce("page", F.lit(0)).alias("page"),
        F.coalesce(text, F.lit("no results")).alias("text"),
    )
