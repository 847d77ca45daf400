"""Load: chunk and ref files -> lane texts -> vectors -> upsert."""

from pyspark.sql import DataFrame, SparkSession

from unitloom.functions import texts
from unitloom.functions.embedding import DEFAULT_MODEL, embed_lanes
from unitloom.operators.maintain import with_refs
from unitloom.schema import CODE_UNITS, EMBED_DIM
from unitloom.sources import jsonl
from unitloom.sources.tables import CodeTables


def prepare_units(chunks: DataFrame, refs: DataFrame, *, refs_in_base: bool = False, model: str = DEFAULT_MODEL, dim: int = EMBED_DIM) -> DataFrame:
    """Chunks with lane texts and vectors.

    `refs_in_base`: the base text of a chunk file already ends with the ref lines;
    they are then not appended a second time.
    """
    joined = with_refs(chunks, refs)
    lanes = texts.lane_texts()
    if refs_in_base:
        lanes["embed_func_text"] = joined["embed_text"]
    ready = embed_lanes(joined.withColumns(lanes), model, dim)
    keep = [c for c in CODE_UNITS.fieldNames() if c not in ("job_id", "updated_at")]
    return ready.select(*keep, *[c for c in ("seq",) if c in ready.columns])


def load(spark: SparkSession, folder: str, table_root: str, *, job_id: str, buckets: int = 64, updated_at=None, **model) -> dict:
    """Upsert the chunk and ref files of `folder`; a repeat with the same input changes nothing."""
    folder = folder.rstrip("/")
    chunks = jsonl.read_chunks(spark, f"{folder}/chunks.jsonl")
    refs = jsonl.read_refs(spark, f"{folder}/refs.jsonl")
    batch = prepare_units(chunks, refs, refs_in_base=True, **model)
    return CodeTables(spark, table_root, buckets).upsert_batch(batch, job_id=job_id, updated_at=updated_at)
