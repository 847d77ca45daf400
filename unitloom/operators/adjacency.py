"""Call edges stored twice, so that few callers or targets are found without reading all edges.

One copy is dealt into parts by a hash of the caller, the other by a hash of the target; the files
of a part are sorted by that key. A lookup reads the folders of the parts its keys fall into, and few
keys are pushed to the scan, whose row groups know their lowest and highest key. A part that holds a
hub is split over several tasks and files.
"""

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from unitloom.session import cut_lineage

EDGES_PER_PART = 1_000_000
LEAST_PARTS = 16
PUSHED_KEYS = 1_000  # a lookup of up to so many keys pushes them to the scan

COLUMNS = "caller_id string, callee_qname string, callee_raw string"
SIDES = {"caller_id": "by_caller", "callee_qname": "by_target"}


def part_of(key: str, parts: int) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(parts)).cast("int")


class Adjacency:
    """A folder of `write_adjacency`; takes the place of the edge table in `operators.graph`."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")
        self.parts = spark.read.parquet(f"{self.folder}/parts").first()["parts"]

    def copy(self, key: str) -> DataFrame:
        """All edges in the layout of `key`, with their part."""
        return self.spark.read.schema(f"{COLUMNS}, part int").parquet(f"{self.folder}/{SIDES[key]}")

    def lookup(self, key: str, keys: DataFrame, rows: int) -> DataFrame:
        """A superset of the edges whose `key` is in the column `key` of `keys` (of `rows` rows).

        The driver gets the numbers of the parts that are read, and keys up to PUSHED_KEYS.
        """
        wanted = keys.select(key).filter(F.col(key).isNotNull()).distinct()
        scan, number = self.copy(key), part_of(key, self.parts).alias("part")
        if rows <= PUSHED_KEYS:
            found = wanted.select(key, number).collect()
            scan = scan.filter(F.col(key).isin([r[key] for r in found]))
        else:
            found = wanted.select(number).distinct().collect()
        touched = sorted({r["part"] for r in found})
        return (scan if len(touched) == self.parts else scan.filter(F.col("part").isin(touched))).drop("part")


def write_adjacency(edges: DataFrame, folder: str, parts: int | None = None) -> Adjacency:
    """Writes both copies of the edges (caller_id, callee_qname, callee_raw) to a new folder.

    Edges are kept as given, repeated ones and those without a caller or target included. The number
    of parts follows from the number of edges; it is written last, so a folder is whole or not read.
    """
    folder = folder.rstrip("/")
    edges = cut_lineage(edges.selectExpr(*[c.split()[0] for c in COLUMNS.split(", ")]))
    if parts is None:
        parts = max(LEAST_PARTS, -(-edges.count() // EDGES_PER_PART))
    for key, name in SIDES.items():
        dealt = edges.withColumn("part", part_of(key, parts)).hint("rebalance", "part")
        dealt.sortWithinPartitions("part", key).write.partitionBy("part").parquet(f"{folder}/{name}")
    spark = edges.sparkSession
    spark.range(1).select(F.lit(parts).alias("parts")).write.parquet(f"{folder}/parts")
    return Adjacency(spark, folder)


def edges_at(edges: DataFrame | Adjacency, key: str, keys: DataFrame, rows: int) -> DataFrame:
    """The edge table, or of an adjacency the edges that the keys lead to."""
    return edges.lookup(key, keys, rows) if isinstance(edges, Adjacency) else edges
