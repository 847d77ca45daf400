"""Approximate neighbours by inverted lists: vectors lie by the cell of their nearest centroid.

Centroids are fitted on a bounded sample. The index holds every vector once, sorted by cell, and a
query compares only the cells whose centroids are nearest to it; distances of candidates are exact.
"""

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from unitloom.functions import kernels, shipping  # noqa: F401
from unitloom.operators import block_join, topk

# Rows of the sample that centroids are fitted on, rounds of the fit, and bounds of the parameters.
SAMPLE_ROWS = 20_000
ROUNDS = 8
MOST_CELLS = 2_048
# A query probes one of this many cells.
PROBE_SHARE = 16


def default_cells(rows: int) -> int:
    return max(1, min(MOST_CELLS, round(rows**0.5)))


def fit(units: DataFrame, lane: str = "func", cells: int | None = None, rounds: int = ROUNDS, sample_rows: int = SAMPLE_ROWS) -> np.ndarray:
    """Centroids for `units` (id, vec_lane), at most one for each row of the sample.

    About `sample_rows` rows (at most twice as many) are drawn by a hash of their id and ordered by
    the MD5 of the id; the first are the seeds. NULL, zero and non-finite vectors play no part.
    """
    n = units.count()
    drawn = units.select("id", F.col(f"vec_{lane}").alias("vec")).filter("vec IS NOT NULL")
    if n > sample_rows:
        drawn = drawn.filter(F.pmod(F.xxhash64("id"), F.lit(n)) < sample_rows).limit(2 * sample_rows)
    table = drawn.withColumn("place", F.md5(F.col("id").cast("binary"))).toArrow().sort_by([("place", "ascending"), ("id", "ascending")])
    _, unit = kernels.unit_vectors(table.column("vec").combine_chunks())
    return kernels.fit_cells(unit, cells or default_cells(n), rounds)


def _placed(centre, column, probes, keep):
    """Adds `cell`: a row for each of the nearest `probes` cells; rows without a usable vector go."""

    def run(batches):
        for batch in batches:
            rows, unit = kernels.unit_vectors(batch.column(column))
            if not len(rows):
                continue
            cells = kernels.nearest_cells(unit, centre, probes)
            some = batch.select(keep).take(pa.array(np.repeat(rows, probes)))
            yield pa.RecordBatch.from_arrays([*some.columns, pa.array(cells.reshape(-1).astype(np.int32))], [*keep, "cell"])

    return run


def index_rows(units: DataFrame, centre: np.ndarray, lane: str = "func") -> DataFrame:
    """id, vector, cell: one row for each unit with a usable vector."""
    lean = units.select("id", f"vec_{lane}")
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in lean.schema)
    if not len(centre):
        return lean.limit(0).withColumn("cell", F.lit(0))
    return lean.mapInArrow(_placed(centre, f"vec_{lane}", 1, lean.columns), f"{kinds}, cell int")


def write_index(units: DataFrame, path: str, lane: str = "func", **shape) -> None:
    """The index as Parquet: `vectors` in ranges of cells, sorted by cell so that a lookup skips files and row groups, and `cells`.

    shape: as for `fit`. A crowded cell spreads over several files.
    """
    centre = fit(units, lane, **shape)
    placed = index_rows(units, centre, lane)
    ranged = placed.repartitionByRange("cell", F.xxhash64("id")).sortWithinPartitions("cell")
    ranged.write.mode("errorifexists").parquet(f"{path}/vectors")
    rows = [(k, [float(x) for x in c]) for k, c in enumerate(centre)]
    units.sparkSession.createDataFrame(rows, "cell int, centre array<double>").write.parquet(f"{path}/cells")


def read_index(spark, path: str) -> tuple[DataFrame, np.ndarray]:
    rows = sorted(spark.read.parquet(f"{path}/cells").collect())
    return spark.read.parquet(f"{path}/vectors"), np.array([r["centre"] for r in rows])


def probed(queries: DataFrame, centre: np.ndarray, probes: int) -> DataFrame:
    """query_id, qv, cell: a row for each cell that a query probes."""
    asked = queries.select("query_id", "qv")
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in asked.schema)
    return asked.mapInArrow(_placed(centre, "qv", probes, asked.columns), f"{kinds}, cell int")


def nearest(
    index: DataFrame, centre: np.ndarray, queries: DataFrame, *, k: int, dim: int, lane: str = "func",
    probes: int | None = None, per_block: int = block_join.UNITS_PER_BLOCK,
) -> DataFrame:
    """Top k per query (query_id, qv) among the units of the `probes` cells nearest to it; exact distances.

    Only probed cells are read. Their units are dealt into blocks that meet the queries in the tasks, a
    crowded cell into several, so neither a cell nor the queries are whole anywhere. By default a
    query probes a sixteenth of the cells. Queries without a usable vector have no rows.
    """
    schema = topk._partial_schema(queries.schema["query_id"].dataType, (lane,))
    if not len(centre):
        return topk.top_k_per(queries.sparkSession.createDataFrame([], schema), "query_id", k, salt="salt")
    asked = probed(queries, centre, min(len(centre), probes or -(-len(centre) // PROBE_SHARE)))
    # At most one row for each centroid.
    wanted = [r["cell"] for r in asked.select("cell").distinct().collect()]
    found = index.filter(F.col("cell").isin(wanted)) if len(wanted) < len(centre) else index
    sizes = found.groupBy("cell").agg(F.count("*").alias("n"))
    dealt, blocks = block_join.deal_groups(found.select("id", f"vec_{lane}", "cell"), "cell", sizes, len(centre), per_block)
    asked = asked.join(blocks, "cell").withColumn("terms", F.lit(None).cast("array<string>"))
    weights = {f"w_{lane}": 1.0, "w_fts": 0.0}
    out = block_join.best_per_block(dealt, asked, weights=weights, k=k, dim=dim, lanes=(lane,), schema=schema)
    return topk.top_k_per(out, "query_id", k, salt="salt")
