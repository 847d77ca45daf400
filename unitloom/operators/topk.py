"""Top-k selection, test-file handling and the scoring job behind every search."""

from pyspark import TaskContext
from pyspark.sql import DataFrame, Window, functions as F, types as T
from pyspark.sql.pandas.types import to_arrow_type

from unitloom.functions import kernels, shipping  # noqa: F401
from unitloom.functions.lexical import tokens
from unitloom.functions.paths import is_test_hit
from unitloom.operators import block_join
from unitloom.schema import LANES
from unitloom.session import small_batches

# Queries shipped to every task at once; larger query tables stay rows.
QUERIES_PER_PASS = 1024
# Partial results of this many tasks meet in one pre-selection task.
TASKS_PER_MERGE = 64


def by_score():
    return [F.col("score").asc_nulls_last(), F.col("id")]


def top_k(df: DataFrame, k: int) -> DataFrame:
    """First k rows of the whole table, lowest score first, NULL last, ties by id."""
    return df.orderBy(*by_score()).limit(k)


def top_k_per(df: DataFrame, key: str, k: int, salt: str | None = None) -> DataFrame:
    """First k rows per key with `rank`; a salt column adds a pre-selection step."""
    if salt:
        part = Window.partitionBy(key, salt).orderBy(*by_score())
        df = df.withColumn("rank", F.row_number().over(part)).filter(F.col("rank") <= k)
        df = df.drop("rank", salt)
    whole = Window.partitionBy(key).orderBy(*by_score())
    return df.withColumn("rank", F.row_number().over(whole)).filter(F.col("rank") <= k)


def settle_tests(hits: DataFrame, k: int, *, deprioritize: bool, exclude: bool) -> DataFrame:
    """Cut fetched hits to k per query: drop tests, or move them behind, or neither.

    Input is the bounded set fetched by the search (at most 3k rows per query).
    """
    if exclude:
        hits = hits.filter(~is_test_hit())
    order = by_score()
    if deprioritize and not exclude:
        order = [is_test_hit(), *order]
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(*order))
    return hits.withColumn("rank", rank).filter(F.col("rank") <= k)


def fetch_size(k: int, deprioritize: bool, exclude: bool) -> int:
    """Over-fetch three times when hits are filtered or reordered afterwards."""
    return 3 * k if deprioritize or exclude else k


def _partial_schema(query_type, lanes):
    return T.StructType(
        [
            T.StructField("query_id", query_type),
            T.StructField("id", T.StringType()),
            *[T.StructField(f"d_{lane}", T.DoubleType()) for lane in lanes],
            T.StructField("ts_score", T.DoubleType()),
            T.StructField("score", T.DoubleType()),
            T.StructField("salt", T.IntegerType()),
        ]
    )


def score_units(
    units: DataFrame, queries: DataFrame, *, weights: dict, fetch: int, dim: int,
    per_pass: int = QUERIES_PER_PASS, per_block: int = block_join.UNITS_PER_BLOCK,
) -> DataFrame:
    """Exact top `fetch` units per query over the whole unit table.

    units: id, vec_func, vec_call, vec_class, search_text;
    queries: query_id, qv, terms. Up to `per_pass` queries (counted first) are shipped to every task
    and the units are read in one narrow pass. More queries stay rows: blocks of units meet them in
    the tasks. Either way a task keeps `fetch` rows per query, so only partial winners are shuffled
    and pairs never become rows.
    """
    small_batches(units.sparkSession)
    query_type = queries.schema["query_id"].dataType
    schema = _partial_schema(query_type, LANES)
    lean = units.select("id", *[f"vec_{lane}" for lane in LANES], tokens("search_text").alias("tokens"))
    some = queries.limit(per_pass + 1).count()
    if some > per_pass:
        dealt, blocks = block_join.deal(lean, units.count(), per_block)
        asked = queries.withColumn("block", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(blocks - 1).cast("long"))))
        out = block_join.best_per_block(dealt, asked, weights=weights, k=fetch, dim=dim, lanes=LANES, schema=schema)
    elif some:
        block, arrow_type = kernels.QueryBlock(queries.collect(), dim), to_arrow_type(query_type)

        def run(batches):
            task = TaskContext.get().partitionId() // TASKS_PER_MERGE
            return kernels.best_units(batches, block, weights, fetch, arrow_type, task, LANES)

        out = lean.mapInArrow(run, schema)
    else:
        out = units.sparkSession.createDataFrame([], schema)
    return top_k_per(out, "query_id", fetch, salt="salt")
