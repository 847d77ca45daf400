"""Tokens, postings and the text rank."""

from pyspark.sql import Column, DataFrame, Window, functions as F, types as T
from pyspark.sql.pandas.types import to_arrow_type

from unitloom.functions import block_max, shipping  # noqa: F401

# Documents of a block, blocks of a shard and of a writing task, and terms that a search pushes into the scan.
BLOCK_DOCS = 128
SHARD_BLOCKS = 64
TASK_BLOCKS = 16
PUSHED_TERMS = 1_000

NON_WORD = r"[^\p{L}\p{N}_]+"


def tokens(text) -> Column:
    """Lower-cased words in document order, no stemming, no stop words; NULL gives []."""
    text = F.col(text) if isinstance(text, str) else text
    words = F.split(F.lower(F.coalesce(text, F.lit(""))), NON_WORD)
    return F.filter(words, lambda w: w != "")


def query_terms(text) -> Column:
    """Distinct words of a query; all of them belong to the (AND-ed) query."""
    return F.array_distinct(tokens(text))


def write_postings(df: DataFrame, key: str, text: str, path: str, block_docs: int = BLOCK_DOCS, shard_blocks: int = SHARD_BLOCKS) -> None:
    """Postings of the texts as Parquet: shard, block, term, top, posts (key, positions).

    Documents are dealt into blocks of about `block_docs` and blocks into shards, by a hash of the key,
    so a frequent term spreads over all shards and a row holds one block's part of a term. `top` is the
    highest number of positions in the row. Files are sorted by term: a search reads the row groups of
    its terms.
    """
    blocks = max(1, -(-df.count() // block_docs))
    shards = max(-(-blocks // shard_blocks), min(blocks, 4 * df.sparkSession.sparkContext.defaultParallelism))
    tasks = max(-(-blocks // TASK_BLOCKS), min(blocks, df.sparkSession.sparkContext.defaultParallelism))
    # The texts move once, into tasks of few blocks: a block is grouped in Arrow, words never become rows, and the
    # postings of a task are few enough to be sorted in memory.
    dealt = df.select(F.col(key).alias("key"), F.col(text).alias("text")).withColumn("block", F.pmod(F.xxhash64("key"), F.lit(blocks)))
    dealt = dealt.repartition(tasks, "block").sortWithinPartitions("block")
    words = dealt.select("block", "key", tokens("text").alias("words"))
    post = T.StructType([T.StructField("key", df.schema[key].dataType), T.StructField("positions", T.ArrayType(T.IntegerType()))])
    schema = T.StructType([T.StructField("block", T.LongType()), T.StructField("term", T.StringType()), T.StructField("top", T.IntegerType()), T.StructField("posts", T.ArrayType(post))])
    grouped = words.groupBy("block").applyInArrow(block_max.block_postings, schema)
    rows = grouped.withColumn("shard", F.pmod("block", F.lit(shards))).sortWithinPartitions("term", "block")
    rows.select("shard", "block", "term", "top", "posts").write.mode("errorifexists").parquet(path)


def query_rows(queries: DataFrame) -> DataFrame:
    """query_id and the distinct terms of the queries (query_id, query) that have a term."""
    return queries.select("query_id", query_terms("query").alias("terms")).filter(F.size("terms") > 0)


def best_texts(index: DataFrame, queries: DataFrame, k: int = 10) -> DataFrame:
    """query_id, rank, key, ts_score: the k texts of highest text rank for each query, from written postings.

    `queries` has query_id and query. Texts that share a word with the query take part; ranks are
    compared after rounding to 9 digits, ties by key. Only the postings of the queries' terms are
    read; they move to their shards, where blocks are scored by falling bound until none can matter.
    Pairs of query and text never become rows: a shard returns at most k for a query.
    """
    best = _of_shards(index, queries, k)
    order = Window.partitionBy("query_id").orderBy(F.round("ts_score", block_max.DIGITS).desc(), "key")
    return best.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select("query_id", "rank", "key", "ts_score")


def text_ranks(index: DataFrame, queries: DataFrame) -> DataFrame:
    """query_id, key, ts_score: the text rank of every text that shares a word with a query, from written postings.

    As `best_texts`, without a cut: every shard scores all its texts, a bounded number of places at a time,
    and nothing moves but the postings of the queries' terms.
    """
    return _of_shards(index, queries, None)


def _of_shards(index: DataFrame, queries: DataFrame, k: int | None) -> DataFrame:
    asked = query_rows(queries)
    terms = asked.select(F.explode("terms").alias("term")).distinct()
    some = terms.limit(PUSHED_TERMS + 1).collect()
    if len(some) <= PUSHED_TERMS:
        found = index.filter(F.col("term").isin([r["term"] for r in some]))
    else:
        found = index.join(terms, "term", "left_semi")
    shards = index.agg(F.max("shard")).first()[0]
    every = F.explode(F.sequence(F.lit(0).cast("long"), F.lit(shards if shards is not None else -1).cast("long")))
    asked = asked.limit(0) if shards is None else asked
    posts = found.withColumn("role", F.lit(0)).select("shard", "role", "block", "term", "top", "posts")
    waiting = asked.select(F.lit(1).alias("role"), "query_id", "terms", every.alias("shard"))
    n = max(int(index.sparkSession.conf.get("spark.sql.shuffle.partitions")), (shards or 0) + 1)
    both = posts.unionByName(waiting, allowMissingColumns=True).repartition(n, "shard").sortWithinPartitions("shard", "role")
    query_type, key_type = queries.schema["query_id"].dataType, index.schema["posts"].dataType.elementType["key"].dataType
    schema = T.StructType([T.StructField("query_id", query_type), T.StructField("key", key_type), T.StructField("ts_score", T.DoubleType())])
    return both.mapInArrow(block_max.best_of_shards(k, to_arrow_type(query_type), to_arrow_type(key_type)), schema)
