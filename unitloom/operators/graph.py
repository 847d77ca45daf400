"""Call-graph neighbours of a set of hits, level by level, and their nested form.

`edges` is a table of edges or an `Adjacency`, of which a step reads only what its keys lead to.
"""

from pyspark.sql import DataFrame, functions as F, types as T

from unitloom.operators.adjacency import Adjacency, edges_at
from unitloom.operators.documents import numbered
from unitloom.session import cut_lineage, small_side

# Neighbours per nested row; a hit with more of them has further pages, in order.
# Flat rows, one per neighbour, are what `expand` and `neighbours` return.
PAGE_ROWS = 10_000

NODE = T.StructType(
    [
        T.StructField("qualified_name", T.StringType()),
        T.StructField("path", T.StringType()),
        T.StructField("unit_id", T.StringType()),
        T.StructField("callee_raw", T.StringType()),
        T.StructField("depth", T.IntegerType()),
    ]
)
NODE_COLUMNS = NODE.fieldNames()
NODE_ORDER = ["depth", "qualified_name", "unit_id", "path", "callee_raw"]


def _target(resolve: str) -> str:
    """Unit column an edge target names: the full name, or the bare symbol."""
    return {"exact": "qualified_name", "symbol": "symbol"}[resolve]


def named_units(units: DataFrame, key: str, names: DataFrame) -> DataFrame:
    """Rows of `units` whose `key` is among `names`, before any join that would shuffle all units."""
    wanted = names.select(key).distinct()
    return units.join(small_side(wanted, wanted.count()), key, "left_semi")


def callees_of(callers: DataFrame, edges: DataFrame | Adjacency, units: DataFrame, rows: int, resolve: str = "exact") -> DataFrame:
    """Distinct callees of `callers` (column caller_id); unknown targets stay, with NULLs.

    Only edges of the callers reach the join with units.
    """
    keys = callers.select("caller_id").distinct()
    mine = edges_at(edges, "caller_id", keys, rows).select("caller_id", "callee_qname", "callee_raw").join(
        small_side(keys, rows), "caller_id", "left_semi"
    )
    found = units.select(
        F.col(_target(resolve)).alias("callee_qname"), F.col("id").alias("unit_id"), "qualified_name", "path"
    )
    mine = cut_lineage(mine)
    return mine.join(named_units(found, "callee_qname", mine), "callee_qname", "left").distinct()


def callers_of(names: DataFrame, edges: DataFrame | Adjacency, units: DataFrame, rows: int) -> DataFrame:
    """Distinct callers of `names` (column callee_qname); callers must be known units."""
    keys = names.select("callee_qname").distinct()
    mine = edges_at(edges, "callee_qname", keys, rows).select("caller_id", "callee_qname").join(
        small_side(keys, rows), "callee_qname", "left_semi"
    )
    found = units.select(F.col("id").alias("caller_id"), "qualified_name", "path")
    mine = cut_lineage(mine)
    return mine.join(named_units(found, "caller_id", mine), "caller_id").distinct()


def _level(frontier, rows, edges, units, side, resolve):
    """One hop: (hit_id, key) -> (hit_id, name, unit_id, path, callee_raw, next key)."""
    if side == "callees":
        step = small_side(frontier.withColumnRenamed("key", "caller_id"), rows)
        reached = (
            edges_at(edges, "caller_id", step, rows)
            .select("caller_id", "callee_qname", "callee_raw")
            .join(step, "caller_id")
            .groupBy("hit_id", "callee_qname")
            .agg(F.min("callee_raw").alias("callee_raw"))
        )
        found = units.select(
            F.col(_target(resolve)).alias("callee_qname"), F.col("id").alias("unit_id"), "path"
        )
        reached = cut_lineage(reached)
        named = reached.join(named_units(found, "callee_qname", reached), "callee_qname", "left")
        return named.select(
            "hit_id", F.col("callee_qname").alias("qualified_name"), "path", "unit_id", "callee_raw",
            F.col("unit_id").alias("next"),
        )
    step = small_side(frontier.withColumnRenamed("key", "callee_qname"), rows)
    mine = edges_at(edges, "callee_qname", step, rows).select("caller_id", "callee_qname")
    reached = mine.join(step, "callee_qname").select("hit_id", "caller_id")
    found = units.select(
        F.col("id").alias("caller_id"), "qualified_name", "path", F.col(_target(resolve)).alias("next")
    )
    reached = cut_lineage(reached.distinct())
    return reached.join(named_units(found, "caller_id", reached), "caller_id").select(
        "hit_id", "qualified_name", "path", F.col("caller_id").alias("unit_id"),
        F.lit(None).cast("string").alias("callee_raw"), "next",
    )


def expand(hits: DataFrame, edges: DataFrame | Adjacency, units: DataFrame, *, side: str, depth: int, resolve: str = "exact") -> DataFrame:
    """Neighbours of every hit to `depth` hops, all hits together.

    hits: hit_id, key (unit id for callees, edge target name for callers). A name is
    reported once per hit, at its smallest depth, with all units of that name; the
    hit itself can reappear through a cycle. Each level is written to the checkpoint
    folder, counted, and broadcast only if small; the loop ends on an empty level.
    """
    spark = hits.sparkSession
    empty = spark.createDataFrame([], T.StructType([T.StructField("hit_id", T.StringType()), *NODE.fields]))
    if depth <= 0:
        return empty
    frontier = cut_lineage(hits.select("hit_id", "key").distinct())
    levels = []
    for hop in range(1, depth + 1):
        rows = frontier.count()
        if rows == 0:
            break
        reached = _level(frontier, rows, edges, units, side, resolve)
        if levels:
            seen = levels[0].select("hit_id", "qualified_name")
            for older in levels[1:]:
                seen = seen.unionByName(older.select("hit_id", "qualified_name"))
            reached = reached.join(seen.distinct(), ["hit_id", "qualified_name"], "left_anti")
        reached = cut_lineage(reached.withColumn("depth", F.lit(hop)))
        levels.append(reached)
        if hop < depth:
            frontier = cut_lineage(
                reached.filter(F.col("next").isNotNull()).select("hit_id", F.col("next").alias("key")).distinct()
            )
    out = empty
    for level in levels:
        out = out.unionByName(level.select("hit_id", *NODE_COLUMNS))
    return out


def neighbour_pages(nodes: DataFrame, page_rows: int = PAGE_ROWS) -> DataFrame:
    """hit_id, page, n (all neighbours of the hit), nodes (those of the page, in order).

    The neighbours of a hit are numbered where they lie and cut into pages of `page_rows`, so a hub is
    never gathered in one row or one task; page after page is the whole ordered list.
    """
    placed = numbered(nodes, ["hit_id"], NODE_ORDER, "_number")
    counts = placed.groupBy("hit_id").agg(F.max("_number").alias("n"))
    pages = (
        placed.withColumn("page", F.expr(f"(_number - 1) div {int(page_rows)}").cast("int"))
        .groupBy("hit_id", "page")
        .agg(F.sort_array(F.collect_list(F.struct(*NODE_ORDER))).alias("nodes"))
        .withColumn("nodes", F.transform("nodes", lambda n: F.struct(*[n[c].alias(c) for c in NODE_COLUMNS])))
    )
    return pages.join(counts, "hit_id").select("hit_id", "page", "n", "nodes")


def neighbours(hits: DataFrame, units: DataFrame, edges: DataFrame | Adjacency, *, depth: int, resolve: str = "exact") -> DataFrame:
    """side ("callees", "callers"), hit_id and the columns of a node: one row per neighbour of `hits` (id, qualified_name)."""
    name = F.col("qualified_name") if resolve == "exact" else F.element_at(F.split("qualified_name", r"\."), -1)
    sides = []
    for side, key in (("callees", F.col("id")), ("callers", name)):
        keyed = hits.select(F.col("id").alias("hit_id"), key.alias("key"))
        found = expand(keyed, edges, units, side=side, depth=depth, resolve=resolve)
        sides.append(found.select(F.lit(side).alias("side"), "hit_id", *NODE_COLUMNS))
    return sides[0].unionByName(sides[1])


def with_context(hits: DataFrame, units: DataFrame, edges: DataFrame | Adjacency, *, depth: int, resolve: str = "exact", page_rows: int = PAGE_ROWS) -> DataFrame:
    """Hits with `callees` and `callers` arrays, a row per page; hits without neighbours get []."""
    none = F.array().cast(T.ArrayType(NODE))
    if depth <= 0:
        return hits.withColumns(
            {"page": F.lit(0), "n_callees": F.lit(0).cast("long"), "callees": none,
             "n_callers": F.lit(0).cast("long"), "callers": none}
        )
    hits = cut_lineage(hits)
    found = neighbours(hits, units, edges, depth=depth, resolve=resolve)
    # One numbering for both sides: the key of a list is the side and the hit.
    listed = F.concat("side", F.lit(" "), "hit_id")
    pages = neighbour_pages(found.select(listed.alias("hit_id"), *NODE_COLUMNS), page_rows)
    pages = cut_lineage(pages)
    paged = None
    for side in ("callees", "callers"):
        mine = pages.filter(F.col("hit_id").startswith(f"{side} ")).select(
            F.expr(f"substring(hit_id, {len(side) + 2})").alias("id"), "page", F.col("n").alias(f"n_{side}"), F.col("nodes").alias(side)
        )
        paged = mine if paged is None else paged.join(mine, ["id", "page"], "full")
    # Every hit has a page 0, with or without neighbours.
    first = hits.select("id").distinct().withColumn("page", F.lit(0))
    paged = first.join(paged, ["id", "page"], "full")
    out = hits.join(paged, "id")
    return out.withColumns(
        {"callees": F.coalesce("callees", none), "callers": F.coalesce("callers", none),
         "n_callees": F.coalesce("n_callees", F.lit(0).cast("long")),
         "n_callers": F.coalesce("n_callers", F.lit(0).cast("long"))}
    )


def nested_result(contexts: DataFrame, queries: DataFrame) -> DataFrame:
    """One JSON document per query and page: query text and its hits with neighbours."""
    hit = F.struct(
        F.struct(
            "id", "qualified_name", "path", "role", "namespace", "content",
            "score", "d_func", "d_call", "d_class", "ts_score",
        ).alias("hit"),
        "callees", "callers",
    )
    grouped = contexts.groupBy("query_id", "page").agg(
        F.sort_array(F.collect_list(F.struct("rank", hit.alias("entry")))).alias("entries")
    )
    joined = queries.select("query_id", "query").join(grouped, "query_id", "left")
    body = F.struct("query", F.coalesce(F.col("entries.entry"), F.array()).alias("hits"))
    return joined.select(
        "query_id", F.coalesce("page", F.lit(0)).alias("page"),
        F.to_json(body, {"ignoreNullFields": "false"}).alias("result"),
    )
