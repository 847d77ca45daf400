"""Session defaults, lineage cuts and checked broadcasts."""

import tempfile

from pyspark.sql import DataFrame, SparkSession, functions as F

# Row bound under which one side of a join may be broadcast.
BROADCAST_ROWS = 200_000
# Rows and bytes of an Arrow batch of whole texts or vectors.
TEXT_ROWS = 500
TEXT_BYTES = 4 << 20


def local_session(cores: str = "8", app: str = "unitloom") -> SparkSession:
    """A session for tests and the bench; a cluster brings its own."""
    spark = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "12g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def shared_folder(spark: SparkSession) -> str:
    """The folder named by spark.checkpoint.dir; only local mode may do without one."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if folder:
        return folder.rstrip("/")
    master = spark.sparkContext.master
    if master == "local" or master.startswith("local["):
        return tempfile.mkdtemp(prefix="unitloom-")
    raise ValueError("set spark.checkpoint.dir to a folder that all executors share")


def cut_lineage(df: DataFrame) -> DataFrame:
    """Materialise `df` in the shared checkpoint folder the cluster names."""
    spark = df.sparkSession
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(shared_folder(spark))
    return df.checkpoint(eager=True)


def small_batches(spark: SparkSession, rows: int = TEXT_ROWS, size: int = TEXT_BYTES) -> None:
    """Arrow batches of whole texts hold few of them, so that a Python worker needs as little memory for many texts as for some.

    Lowers the settings of the session, never raises them.
    """
    for name, most in (("maxRecordsPerBatch", rows), ("maxBytesPerBatch", size)):
        name = f"spark.sql.execution.arrow.{name}"
        now = spark.conf.get(name, None)
        if now is None or now.lstrip("-").isdigit() and not 0 < int(now) <= most:
            spark.conf.set(name, str(most))


def small_side(df: DataFrame, rows: int, limit: int = BROADCAST_ROWS) -> DataFrame:
    """Broadcast hint for a side whose counted size is within `limit`."""
    return F.broadcast(df) if rows <= limit else df


def spread(scan: DataFrame) -> DataFrame:
    """Use all cores on a small scan; a scan with enough splits is left as it is."""
    cores = scan.sparkSession.sparkContext.defaultParallelism
    return scan if scan.rdd.getNumPartitions() >= cores else scan.repartition(cores)
