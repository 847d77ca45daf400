"""Connected components of a link table, without collecting links anywhere."""

from pyspark.sql import DataFrame, functions as F

from unitloom.llm.shared import drop_saved, saved


def components(edges: DataFrame) -> DataFrame:
    """(node, component) for every node of `edges` (a, b); component is the smallest node id reachable.

    Alternates large-star and small-star steps (each an aggregate plus a join, so a hub is never
    gathered in one task) until the links no longer change. Loops and repeated links are ignored;
    no links give no rows.
    """
    links = saved(
        edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).filter("u <> v").distinct()
    )
    state = _state(links)
    while True:
        both = links.union(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = both.join(low, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        joined = large.join(low, "u")
        star = (
            joined.filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
            .union(low.select("u", F.col("m").alias("v")))
            .distinct()
        )
        new = saved(star)
        drop_saved(links)
        links, before = new, state
        state = _state(links)
        if state == before:
            break
    return links.select(F.col("u").alias("node"), F.col("v").alias("component")).union(
        links.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    )


def _state(links):
    return tuple(links.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v"))).first())
