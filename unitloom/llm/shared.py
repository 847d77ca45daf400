"""Intermediate tables in the folder that driver and executors share."""

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession, functions as F

# A join side is broadcast only after a count of at most this many rows, or list entries, of a few
# numbers each.
BROADCAST_ROWS = 1_000_000
TEXT_ROWS = 1_000
TEXT_BYTES = 4 << 20
# A key value with more than this part of all rows is joined apart from the others.
HOT_PARTS = 10_000


def shared_folder(spark: SparkSession) -> str:
    """The shared folder named by spark.checkpoint.dir; a temporary one only in local mode."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not base:
        master = spark.sparkContext.master
        if not (master == "local" or master.startswith("local[")):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        base = tempfile.mkdtemp(prefix="unitloom-llm-")
        spark.sparkContext.setCheckpointDir(base)
    return base.rstrip("/")


def saved(df: DataFrame) -> DataFrame:
    """Write `df` once as a table in the shared folder and read it back."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/table-{uuid.uuid4()}"
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def small_batches(spark: SparkSession, rows: int = TEXT_ROWS) -> None:
    """For applications: Arrow batches of whole texts with few rows and bytes, so that tasks hold few texts or sets."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    now = spark.conf.get(name, None)
    if now is None or now.lstrip("-").isdigit() and not 0 < int(now) <= TEXT_BYTES:
        spark.conf.set(name, str(TEXT_BYTES))


def drop_saved(*frames: DataFrame) -> None:
    """Delete tables of `saved` that no later read needs."""
    for df in frames:
        spark = df.sparkSession
        for folder in {f.rpartition("/")[0] for f in df.inputFiles()}:
            if folder.rpartition("/")[2].startswith("table-"):
                path = spark._jvm.org.apache.hadoop.fs.Path(folder)
                path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def small(df: DataFrame, cells: str | None = None, limit: int = BROADCAST_ROWS) -> DataFrame:
    """Broadcast hint for a narrow side counted within `limit`; else it shuffles.

    Rows are counted, or the entries of the list column `cells`.
    """
    if cells is None:
        n = df.limit(limit + 1).count()
    else:
        n = df.agg(F.sum(F.size(cells) + 1)).first()[0] or 0
    return F.broadcast(df) if n <= limit else df


def attach(rows: DataFrame, groups: DataFrame, key: str) -> DataFrame:
    """`rows` left-joined to `groups` (key, n, ...: one row for a value, n its rows); null equals null.

    Groups counted small are broadcast. Else the values that hold more than 1/HOT_PARTS of the counted
    rows, fewer than HOT_PARTS by their definition, are broadcast and the others joined by shuffle, so
    no value brings its rows to one task.
    """
    values = [c for c in groups.columns if c not in (key, "n")]

    def joined(left, right, how="left"):
        right = right.select(F.col(key).alias("_key"), *[F.col(c).alias(f"_{c}") for c in values], F.lit(True).alias("_met"))
        found = left.join(right, left[key].eqNullSafe(right["_key"]), how)
        return found.select(*[left[c] for c in left.columns], *[F.col(f"_{c}").alias(c) for c in values], "_met")

    if groups.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS:
        return joined(rows, F.broadcast(groups)).drop("_met")
    total = groups.agg(F.sum("n")).first()[0]
    often = F.col("n") > total / HOT_PARTS
    first = joined(rows, F.broadcast(groups.filter(often)))
    rest = first.filter("_met IS NULL").select(*rows.columns)
    return first.filter("_met").drop("_met").union(joined(rest, groups.filter(~often)).drop("_met"))
