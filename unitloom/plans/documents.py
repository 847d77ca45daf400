"""Hits with all their neighbours as ordered lines, for documents that no row could hold.

A line has its place (query_id, rank, kind, number); `write_lines` stores lines in this order. Rank 0
opens and LAST closes a query. Neighbours come from `graph.neighbours`, hits from a search.
"""

from pyspark.sql import DataFrame, functions as F

from unitloom.functions import texts
from unitloom.operators.documents import numbered, quoted
from unitloom.operators.graph import NODE_COLUMNS, NODE_ORDER

PLACE = ["query_id", "rank", "kind"]
LAST = 2**31 - 1
HIT_FIELDS = ["id", "qualified_name", "path", "role", "namespace", "content", "score", "d_func", "d_call", "d_class", "ts_score"]
KEEP_NULLS = {"ignoreNullFields": "false"}


def _line(rows: DataFrame, kind, line, rank="rank") -> DataFrame:
    """Lines that are no neighbours; their order columns stay empty."""
    rank = F.col(rank) if isinstance(rank, str) else rank
    empty = [F.lit(None).cast("int" if c == "depth" else "string").alias(c) for c in NODE_ORDER]
    return rows.select("query_id", rank.cast("int").alias("rank"), F.lit(kind).alias("kind"), *empty, line.alias("line"))


def _nodes(hits: DataFrame, found: DataFrame, side: str, kind: int, line) -> DataFrame:
    """A line per hit and neighbour; hits are few against the neighbours of a hub."""
    mine = found.filter(F.col("side") == side).withColumn("line", line)
    return hits.select("query_id", "rank", F.col("id").alias("hit_id")).join(mine, "hit_id").select(
        "query_id", F.col("rank").cast("int").alias("rank"), F.lit(kind).alias("kind"), *NODE_ORDER, "line"
    )


def _ordered(parts: list) -> DataFrame:
    lines = parts[0]
    for part in parts[1:]:
        lines = lines.unionByName(part)
    return numbered(lines, PLACE, NODE_ORDER)


def json_lines(hits: DataFrame, found: DataFrame, queries: DataFrame) -> DataFrame:
    """query_id, rank, kind, number, line: one JSON document per query, {"query", "hits": [{"hit", "callees", "callers"}]}.

    A query without hits has an empty list. Kinds: 0 opens, 1 hit, 2 callee, 3 between, 4 caller, 5 end of a hit.
    """
    hit = F.to_json(F.struct(*HIT_FIELDS), KEEP_NULLS)
    comma = F.when(F.col("rank") > 1, ", ").otherwise("")
    node = F.to_json(F.struct(*NODE_COLUMNS), KEEP_NULLS)
    lines = _ordered(
        [
            _line(queries, 0, F.concat(F.lit('{"query": '), quoted("query"), F.lit(', "hits": [')), F.lit(0)),
            _line(hits, 1, F.concat(comma, F.lit('{"hit": '), hit, F.lit(', "callees": ['))),
            _nodes(hits, found, "callees", 2, node),
            _line(hits, 3, F.lit('], "callers": [')),
            _nodes(hits, found, "callers", 4, node),
            _line(hits, 5, F.lit("]}")),
            _line(queries, 0, F.lit("]}"), F.lit(LAST)),
        ]
    )
    behind = F.col("kind").isin(2, 4) & (F.col("number") > 1)
    return lines.select(*PLACE, "number", F.when(behind, F.concat(F.lit(", "), "line")).otherwise(F.col("line")).alias("line"))


def text_lines(hits: DataFrame, found: DataFrame, queries: DataFrame) -> DataFrame:
    """query_id, rank, kind, number, line: hits and neighbours as text, "no results" for a query without hits.

    Kinds: 0 blank line before a further hit, 1 hit (several text lines), 2 and 4 headings with counts,
    3 callees, 5 callers; a side without neighbours has no heading.
    """
    counts = found.groupBy("hit_id", "side").agg(F.count("*").cast("string").alias("n"))
    headed = hits.select("query_id", "rank", F.col("id").alias("hit_id")).join(counts, "hit_id")
    parts = [
        _line(hits.filter("rank > 1"), 0, F.lit("")),
        _line(hits, 1, texts.context_head()),
        _line(queries.join(hits.select("query_id").distinct(), "query_id", "left_anti"), 1, F.lit("no results"), F.lit(0)),
    ]
    for kind, side, arrow in ((2, "callees", "->"), (4, "callers", "<-")):
        heading = F.concat(F.lit(f"{side} ("), "n", F.lit("):"))
        parts.append(_line(headed.filter(F.col("side") == side), kind, heading))
        parts.append(_nodes(hits, found, side, kind + 1, F.concat(F.lit(f"  {arrow} "), "qualified_name")))
    return _ordered(parts).select(*PLACE, "number", "line")
