"""Index: repository files -> units with search text, and class refs."""

from pyspark.sql import DataFrame, SparkSession, functions as F

from unitloom.functions import texts
from unitloom.operators.extract.html_units import with_inline_scripts
from unitloom.operators.extract.registry import extract_all
from unitloom.operators.maintain import ref_eligible
from unitloom.schema import CHUNK
from unitloom.sources import files as file_source
from unitloom.session import cut_lineage, small_batches
from unitloom.sources import jsonl


def found_units(files: DataFrame, languages: list | None = None) -> DataFrame:
    """Unit rows of files with path, text, language, module, package, namespace.

    Narrow from scan to rows. `seq` is the document order over all files.
    """
    small_batches(files.sparkSession)
    df = files.withColumn("text", F.replace("text", F.lit("\r\n"), F.lit("\n")))
    df = with_inline_scripts(df)
    df = df.withColumn("lines", file_source.source_lines("shown"))
    df = extract_all(df, languages)
    keep = ["path", "language", "module", "package", "namespace", "part"]
    # The outer form keeps Spark from a filter on `found` below, which would extract every file a second time.
    rows = df.select(*keep, "lines", F.posexplode_outer("found").alias("at", "unit")).filter("at IS NOT NULL")
    rows = rows.select(*keep, "lines", "at", "unit.*")
    # Row by row: units of a file may share long lines.
    rows = rows.withColumn("content", texts.line_range("lines", F.col("start_line"), F.col("end_line"))).drop("lines")
    rows = rows.withColumn("qualified_name", texts.qualified_name())
    file = F.regexp_replace("path", r":inline:\d+$", "")
    return rows.withColumns(
        {"id": texts.unit_id(), "seq": F.struct(file.alias("file"), "part", "at")}
    ).drop("part", "at")


def index_files(files: DataFrame, languages: list | None = None, **context) -> tuple[DataFrame, DataFrame]:
    """Chunk rows (plus `seq`) and ref rows of files with path and source bytes."""
    return chunks_and_refs(assembled_units(files, languages, **context))


def assembled_units(files: DataFrame, languages: list | None = None, **context) -> DataFrame:
    """Units of files with path and source bytes, with their class refs and `seq`."""
    described = file_source.file_context(files, **context)
    described = described.withColumn("text", file_source.decode("source")).drop("source")
    return found_units(described, languages)


def chunks_and_refs(units: DataFrame) -> tuple[DataFrame, DataFrame]:
    units = units.withColumn("embed_text", texts.embed_text())
    chunks = units.withColumns(
        {
            "embed_text": texts.func_text(),
            "search_text": texts.search_text(),
            "content_hash": texts.content_hash(),
        }
    ).select(*CHUNK.fieldNames(), "seq")
    refs = ref_eligible(units).filter(F.col("refs").isNotNull()).select(
        F.col("id").alias("unit_id"), "qualified_name", "path", "language", "refs", "seq"
    )
    return chunks, refs


def index_repository(spark: SparkSession, root: str, folder: str, *, languages: list | None = None, **context) -> dict:
    """Write chunks.jsonl and refs.jsonl of a repository under `folder`; returns n_units and n_refs.

    Units are extracted once, into the shared folder; both files are written from there. The units
    of a file stay together and in order, so the last duplicate of an id is the last in its file.
    Package root and site-packages are found from `root` unless `context` names them.
    """
    context = file_source.root_context(spark, root) | context
    units = cut_lineage(assembled_units(file_source.read_repository(spark, root), languages, **context))
    chunks, refs = chunks_and_refs(units)
    jsonl.write_jsonl(chunks, refs, folder)
    return {"n_units": units.count(), "n_refs": refs.count()}
