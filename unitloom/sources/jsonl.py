"""Chunk and ref files, one JSON object per line."""

import re

from pyspark.sql import DataFrame, SparkSession, functions as F

from unitloom.functions import texts
from unitloom.operators.maintain import last_wins
from unitloom.schema import CHUNK, CHUNK_REQUIRED, REFS


def nullable(schema):
    out = type(schema)()
    for f in schema.fields:
        out.add(f.name, f.dataType, True)
    return out


def _lines(reader, path, schema):
    return (
        reader.schema(nullable(schema)).option("mode", "FAILFAST").json(path)
        .withColumn("file", F.col("_metadata.file_path"))
        .withColumn("block", F.col("_metadata.file_block_start"))
    )


def file_order(file="file"):
    """A file name as text in which numbers compare as numbers, so part-100000 comes after part-99999."""
    pieces = F.regexp_extract_all(file, F.lit(r"\d+|\D+"), F.lit(0))
    return F.array_join(F.transform(pieces, lambda p: F.when(p.rlike(r"^\d"), F.lpad(p, 20, "0")).otherwise(p)), "")


def with_file_order(df: DataFrame) -> DataFrame:
    """`seq`: position of a row as (file, split, row in split), comparable across tasks."""
    return df.withColumn(
        "seq", F.struct(file_order().alias("file"), "block", F.monotonically_increasing_id().alias("row"))
    ).drop("file", "block")


def checked_chunks(lines: DataFrame) -> DataFrame:
    """Chunk rows with defaults filled and `seq`; a missing required key fails the job.

    Id and hash are derived, not trusted.
    """
    rows = with_file_order(lines)
    required = {
        c: F.when(F.col(c).isNotNull(), F.col(c)).otherwise(
            F.raise_error(F.lit(f"chunk row without required key {c}")).cast(CHUNK[c].dataType)
        )
        for c in CHUNK_REQUIRED
    }
    empty = F.array().cast("array<string>")
    rows = rows.withColumns(required).withColumns(
        {
            "class_chain": F.coalesce("class_chain", empty),
            "calls": F.coalesce("calls", empty),
            **{c: F.coalesce(c, F.lit("")) for c in ("embed_text", "doc", "search_text")},
        }
    )
    rows = rows.withColumns({"id": texts.unit_id(), "content_hash": texts.content_hash()})
    return rows.select(*CHUNK.fieldNames(), "seq")


def read_chunks(spark: SparkSession, path: str) -> DataFrame:
    """Chunk rows of a file or folder; the reader skips blank lines."""
    return checked_chunks(_lines(spark.read, path, CHUNK))


def stream_chunk_lines(spark: SparkSession, path: str) -> DataFrame:
    """Chunk files as they arrive; pass each micro-batch to `checked_chunks`."""
    return stream_lines(spark, path, CHUNK)


def stream_lines(spark: SparkSession, path: str, schema) -> DataFrame:
    return _lines(spark.readStream, path, schema)


def read_lines(spark: SparkSession, files: list, schema) -> DataFrame:
    """Rows of files given by the names that `file` has in rows of `stream_lines`."""
    jvm = spark._jvm
    # The column has escaped names, a reader takes patterns.
    names = [re.sub(r"([{}\[\]*?\\])", r"\\\1", jvm.org.apache.hadoop.fs.Path(jvm.java.net.URI(f)).toString()) for f in files]
    return _lines(spark.read, names, schema)


def make_folder(spark: SparkSession, path: str) -> None:
    """A stream needs its folder to exist."""
    jvm_path = spark._jvm.org.apache.hadoop.fs.Path(path)
    jvm_path.getFileSystem(spark._jsc.hadoopConfiguration()).mkdirs(jvm_path)


def _exists(spark: SparkSession, path: str) -> bool:
    jvm_path = spark._jvm.org.apache.hadoop.fs.Path(path)
    return jvm_path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(jvm_path)


def no_refs(spark: SparkSession) -> DataFrame:
    """No rows, and known to be empty, so a join with it moves no row of the other side."""
    return spark.range(0).select(*[F.lit(None).cast(f.dataType).alias(f.name) for f in REFS.fields])


def read_refs(spark: SparkSession, path: str) -> DataFrame:
    """Refs, the last row per unit_id; an absent file gives no rows."""
    if not _exists(spark, path):
        return no_refs(spark)
    rows = with_file_order(_lines(spark.read, path, REFS))
    rows = rows.withColumn("refs", F.coalesce("refs", F.create_map().cast("map<string,string>")))
    return last_wins(rows, "unit_id", "seq").select(*REFS.fieldNames())


def chunk_record(units: DataFrame) -> DataFrame:
    """Columns of a chunk line in their stored order."""
    return units.select(*CHUNK.fieldNames())


def write_jsonl(chunks: DataFrame, refs: DataFrame, folder: str, mode: str = "errorifexists") -> None:
    """chunks.jsonl and refs.jsonl as folders of part files under `folder`."""
    folder = folder.rstrip("/")
    options = {"ignoreNullFields": "false"}
    chunk_record(chunks).write.mode(mode).options(**options).json(f"{folder}/chunks.jsonl")
    refs.select(*REFS.fieldNames()).write.mode(mode).options(**options).json(f"{folder}/refs.jsonl")
