"""Incremental loads: arriving source files or chunk files are upserted.

Both run with `availableNow`; the checkpoint remembers what was taken. A
replayed micro-batch upserts the same rows again, so the tables end the same.
"""

import functools

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from unitloom.functions import meeting, shipping, texts  # noqa: F401
from unitloom.functions.paths import INDEXABLE, SKIP_DIRS
from unitloom.operators import maintain
from unitloom.plans.index import assembled_units, chunks_and_refs
from unitloom.plans.load import prepare_units
from unitloom.schema import CHUNK, REFS
from unitloom.session import cut_lineage, small_side
from unitloom.sources import files as file_source
from unitloom.sources import jsonl, listing
from unitloom.sources.tables import CodeTables, bucket_of


def _run(arriving: DataFrame, checkpoint: str, take):
    return (
        arriving.writeStream.foreachBatch(take)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )


def stream_repository(
    spark: SparkSession, root: str, table_root: str, checkpoint: str, *, job_prefix: str = "stream",
    buckets: int = 64, context: dict | None = None, **model,
):
    """Source files of `root`, each time they change -> units -> tables.

    The checkpoint remembers the time up to which changes were taken; `root` as for `read_repository`.
    """
    arriving = listing.stream_files(spark, root, INDEXABLE, SKIP_DIRS)
    facts = file_source.root_context(spark, root) | (context or {})

    def take(batch: DataFrame, number: int) -> None:
        units = cut_lineage(assembled_units(batch, **facts))
        if units.isEmpty():
            return
        chunks, refs = chunks_and_refs(units)
        ready = prepare_units(chunks, refs, refs_in_base=True, **model)
        CodeTables(batch.sparkSession, table_root, buckets).upsert_batch(ready, job_id=f"{job_prefix}-{number}")

    return _run(arriving, checkpoint, take)


def stream_chunks(
    spark: SparkSession, folder: str, table_root: str, checkpoint: str, *, job_prefix: str = "stream",
    buckets: int = 64, **model,
):
    """Chunk files of `folder`/chunks.jsonl, with the refs known when they arrive."""
    folder = folder.rstrip("/")

    def take(batch: DataFrame, number: int) -> None:
        here = batch.sparkSession
        refs = jsonl.read_refs(here, f"{folder}/refs.jsonl")
        ready = prepare_units(jsonl.checked_chunks(batch), refs, refs_in_base=True, **model)
        CodeTables(here, table_root, buckets).upsert_batch(ready, job_id=f"{job_prefix}-{number}")

    return _run(jsonl.stream_chunk_lines(spark, f"{folder}/chunks.jsonl"), checkpoint, take)


# How long a chunk or refs wait for their partner: 30 days.
HOLD_MS = 30 * 24 * 3600 * 1000
# Read when the query starts; without new files there is nothing to do, and a run with batches for
# timers alone would not end.
STATE_SETTINGS = {
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    "spark.sql.streaming.noDataMicroBatches.enabled": "false",
}


def _bodies(lines: DataFrame, key, kind: int, body) -> DataFrame:
    """id, kind, place (file, split and row, as text that orders like them) and what is kept of the row."""
    place = F.concat_ws("\x01", jsonl.file_order(), F.lpad(F.col("block").cast("string"), 20, "0"), F.lpad(F.col("row").cast("string"), 20, "0"))
    schema = T.StructType([*lines.schema.fields, T.StructField("row", T.LongType())])
    rows = lines.mapInArrow(meeting.with_rows, schema)
    return rows.select(key.alias("id"), F.lit(kind).alias("kind"), place.alias("place"), body.alias("body"))


def _arrived(rows: DataFrame) -> DataFrame | None:
    """Chunk rows of the files that came with this micro-batch, of each id the last; None without such files."""
    spark = rows.sparkSession
    files = [r["file"] for r in rows.filter("file is not null").select("file").distinct().collect()]
    if not files:
        return None
    chunks = jsonl.checked_chunks(jsonl.read_lines(spark, files, CHUNK))
    twice = not rows.filter("times > 1").isEmpty()
    return maintain.last_of_repeated(chunks, chunks.select("id"), "id", "seq") if twice else chunks


def _again(rows: DataFrame, tables: CodeTables) -> DataFrame | None:
    """Units of the table whose refs come after their chunk, as chunk rows."""
    late = rows.filter("file is null").select("id")
    n = late.count()
    if n == 0:
        return None
    touched = {r["b"] for r in late.select(bucket_of("id", tables.buckets).alias("b")).distinct().collect()}
    units = tables.units(touched).join(small_side(late, n), "id", "left_semi")
    place = F.struct(F.lit("").alias("file"), F.lit(0).cast("long").alias("block"), F.lit(0).cast("long").alias("row"))
    units = units.withColumns({"embed_text": F.col("embed_func_text"), "doc": F.lit(""), "seq": place})
    return units.select(*CHUNK.fieldNames(), "seq")


def stream_chunks_and_refs(
    spark: SparkSession, folder: str, table_root: str, checkpoint: str, *, job_prefix: str = "stream",
    buckets: int = 64, hold_ms: int = HOLD_MS, **model,
):
    """Chunk files and ref files of `folder`, in whatever order they arrive.

    Both are streams that meet by unit id in a state store (RocksDB, in the checkpoint folder), which holds refs and
    the ids of chunks. A chunk is loaded from its file when it arrives, and with refs that arrive up to `hold_ms` later its unit is
    loaded once more as it then stands in the table (a unit that was removed meanwhile stays away); refs wait as long for their chunk. A unit therefore ends as a load of
    all files would make it. A missing folder of either kind is made; a row without an id's
    required keys fails the job, refs without unit id meet nothing.
    """
    folder = folder.rstrip("/")
    for name in ("chunks.jsonl", "refs.jsonl"):
        jsonl.make_folder(spark, f"{folder}/{name}")
    chunks = _bodies(jsonl.stream_lines(spark, f"{folder}/chunks.jsonl", CHUNK), texts.unit_id(), meeting.CHUNK, F.col("file"))
    refs = _bodies(
        jsonl.stream_lines(spark, f"{folder}/refs.jsonl", REFS).filter("unit_id is not null"),
        F.col("unit_id"), meeting.REFS, F.to_json(F.struct(*REFS.fieldNames())),
    )
    met = chunks.unionByName(refs).groupBy("id").transformWithState(
        meeting.Meeting(hold_ms), "id string, file string, times long, refs string", "Update", "ProcessingTime"
    )

    def take(batch: DataFrame, number: int) -> None:
        rows = cut_lineage(batch)
        if rows.isEmpty():
            return
        tables = CodeTables(batch.sparkSession, table_root, buckets)
        chunks = [c for c in (_arrived(rows), _again(rows, tables)) if c is not None]
        if not chunks:
            return
        known = rows.filter("refs is not null").select(F.from_json("refs", jsonl.nullable(REFS)).alias("r")).select("r.*")
        known = known.withColumn("refs", F.coalesce("refs", F.create_map().cast("map<string,string>")))
        # Known to be empty or small, refs move no text.
        n = rows.filter("refs is not null").count()
        known = small_side(known, n) if n else jsonl.no_refs(batch.sparkSession)
        ready = prepare_units(functools.reduce(DataFrame.unionByName, chunks), known, refs_in_base=True, **model)
        tables.upsert_batch(ready, job_id=f"{job_prefix}-{number}")

    before = {name: spark.conf.get(name, None) for name in STATE_SETTINGS}
    try:
        for name, value in STATE_SETTINGS.items():
            spark.conf.set(name, value)
        return (
            met.writeStream.foreachBatch(take).outputMode("update")
            .option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
        )
    finally:
        for name, value in before.items():
            spark.conf.unset(name) if value is None else spark.conf.set(name, value)
