"""Scores of two large tables: blocks of units meet a stream of queries in the tasks.

Units are dealt into blocks of a bounded size, each query goes once to every block that it asks. A
partition holds its blocks one after the other, units first; a task keeps one block and passes the
queries by it in small batches, so neither side is ever whole in a task or in the driver.
"""

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.pandas.types import to_arrow_type

from unitloom.functions import kernels, shipping  # noqa: F401
from unitloom.session import small_side

UNITS_PER_BLOCK = 32_768
# Partial results of this many blocks meet in one pre-selection task.
BLOCKS_PER_MERGE = 64


def best_per_block(dealt: DataFrame, asked: DataFrame, *, weights: dict, k: int, dim: int, lanes, schema) -> DataFrame:
    """Partial winners, at most k for a query and block.

    dealt: block long, id, a vector for each of `lanes` and, if the text rank counts, tokens;
    asked: block long, query_id, qv and terms. Each block of `dealt` must fit in a task.
    """
    extra = [c for c in dealt.columns if c not in ("block", "id")]
    units = dealt.withColumn("role", F.lit(0)).select("block", "role", "id", *extra)
    queries = asked.select("block", F.lit(1).alias("role"), "query_id", "qv", "terms")
    both = units.unionByName(queries, allowMissingColumns=True)
    n = int(dealt.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    order = both.repartition(n, "block").sortWithinPartitions("block", "role")
    arrow_type = to_arrow_type(asked.schema["query_id"].dataType)
    return order.mapInArrow(_pass_by(["id", *extra], weights, k, dim, lanes, arrow_type), schema)


def _pass_by(unit_columns, weights, k, dim, lanes, query_type):
    def run(batches):
        at, held = None, []
        for batch in batches:
            block, role = batch.column("block").to_numpy(), batch.column("role").to_numpy()
            start = 0
            while start < batch.num_rows:
                same = (block[start:] == block[start]) & (role[start:] == role[start])
                end = start + (int(same.argmin()) if not same.all() else len(same))
                part = batch.slice(start, end - start)
                if block[start] != at:
                    at, held = block[start], []
                if role[start] == 0:
                    held.append(part.select(unit_columns))
                elif held:
                    asked = kernels.QueryBlock.of(part.column("query_id"), part.column("qv"), part.column("terms"), dim)
                    task = int((at >> 32) + (at & 0xFFFFFFFF) // BLOCKS_PER_MERGE) & 0x7FFFFFFF
                    yield from kernels.best_units(held, asked, weights, k, query_type, task, lanes)
                start = end

    return run


def deal(units: DataFrame, rows: int, per_block: int = UNITS_PER_BLOCK) -> tuple[DataFrame, int]:
    """`units` with their block, and the number of blocks, by a hash of the id."""
    blocks = max(1, -(-rows // per_block))
    return units.withColumn("block", F.pmod(F.xxhash64("id"), F.lit(blocks))), blocks


def deal_groups(units: DataFrame, group: str, sizes: DataFrame, groups: int, per_block: int = UNITS_PER_BLOCK) -> tuple[DataFrame, DataFrame]:
    """Blocks within groups: `units` with their block, and (group, block) for all blocks.

    sizes: group, n, one row for each of at most `groups` groups. Crowded groups have several blocks.
    """
    parts = sizes.select(group, F.ceil(F.col("n") / per_block).cast("long").alias("parts"))
    number = F.col(group).cast("long") * (1 << 32)
    dealt = units.join(small_side(parts, groups), group)
    dealt = dealt.withColumn("block", number + F.pmod(F.xxhash64("id"), F.col("parts"))).drop("parts", group)
    blocks = parts.select(group, F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"))
    return dealt, blocks.select(group, (number + F.col("part")).alias("block"))
