"""Set-based table upkeep: last-wins, edges of a batch, audits, change detection."""

from pyspark.sql import DataFrame, functions as F

from unitloom.functions.texts import REF_ROLES
from unitloom.operators.documents import numbered
from unitloom.operators.graph import PAGE_ROWS
from unitloom.session import cut_lineage, small_side


def last_wins(df: DataFrame, key: str, order: str) -> DataFrame:
    """One row per key: the one with the greatest `order`. Folded map-side first."""
    row = F.struct(*[F.col(c) for c in df.columns])
    return df.groupBy(key).agg(F.max_by(row, order).alias("row")).select("row.*")


def last_of_repeated(df: DataFrame, keys: DataFrame, key: str, order: str) -> DataFrame:
    """`last_wins` that moves only the rows whose key repeats; `keys` holds the key of every row of `df`.

    The keys are counted first; without repeated ones the rows pass as they are. NULL is a key.
    """
    repeated = cut_lineage(keys.groupBy(key).count().filter("count > 1").select(F.col(key).alias("_key")))
    rows = repeated.count()
    if rows == 0:
        return df
    again = small_side(repeated, rows)
    meet = df[key].eqNullSafe(again["_key"])
    several = df.join(again, meet, "left_semi")
    return df.join(again, meet, "left_anti").unionByName(last_wins(several, key, order))


def upsert(existing: DataFrame, batch: DataFrame, key: str) -> DataFrame:
    """Batch rows replace existing rows of the same key; the rest stays."""
    return existing.join(batch.select(key), key, "left_anti").unionByName(batch)


def drop_missing(existing: DataFrame, current: DataFrame, key: str) -> DataFrame:
    """Optional clean-up the plain upsert never does: drop keys no longer present."""
    return existing.join(current.select(key).distinct(), key, "left_semi")


def call_edges(batch: DataFrame) -> DataFrame:
    """One row per call of every batch row, duplicates of an id included."""
    return (
        batch.select(F.col("id").alias("caller_id"), F.explode("calls").alias("callee_qname"))
        .filter(F.col("callee_qname") != "")
        .withColumn("callee_raw", F.col("callee_qname"))
    )


def insert_ignore(edges: DataFrame, order: str | None = None) -> DataFrame:
    """Unique (caller_id, callee_qname), the first by `order` (else smallest raw name) kept."""
    kept = F.min_by("callee_raw", order) if order else F.min("callee_raw")
    return edges.groupBy("caller_id", "callee_qname").agg(kept.alias("callee_raw"))


def drop_edges_of(edges: DataFrame, batch: DataFrame) -> DataFrame:
    callers = batch.select(F.col("id").alias("caller_id")).distinct()
    return edges.join(callers, "caller_id", "left_anti")


def replace_edges(edges: DataFrame, batch: DataFrame) -> DataFrame:
    return drop_edges_of(edges, batch).unionByName(insert_ignore(call_edges(batch)))


def cascade(edges: DataFrame, units: DataFrame) -> DataFrame:
    """Edges whose caller still exists."""
    return edges.join(units.select(F.col("id").alias("caller_id")), "caller_id", "left_semi")


def stamp(df: DataFrame, job_id: str) -> DataFrame:
    return df.withColumn("job_id", F.lit(job_id))


def batch_counts(batch: DataFrame) -> DataFrame:
    """Units and edge insert attempts of a load; attempts count repeats."""
    calls = F.filter(F.coalesce("calls", F.array().cast("array<string>")), lambda c: c != "")
    return batch.agg(
        F.count("*").alias("n_units"), F.coalesce(F.sum(F.size(calls)), F.lit(0)).alias("n_edges")
    )


def ref_eligible(units: DataFrame) -> DataFrame:
    """Units that may carry class refs."""
    return units.filter(F.col("role").isin(REF_ROLES) & (F.size("class_chain") > 0))


def with_refs(units: DataFrame, refs: DataFrame) -> DataFrame:
    """Units with their refs map; units without refs keep NULL."""
    return units.join(refs.select(F.col("unit_id").alias("id"), "refs"), "id", "left")


def changes(before: DataFrame, after: DataFrame, key: str, digest: str) -> DataFrame:
    """new / changed / unchanged / removed per key, by hash."""
    old = before.select(key, F.col(digest).alias("old_hash"))
    new = after.select(key, F.col(digest).alias("new_hash"))
    state = (
        F.when(F.col("old_hash").isNull(), "new")
        .when(F.col("new_hash").isNull(), "removed")
        .when(F.col("old_hash") == F.col("new_hash"), "unchanged")
        .otherwise("changed")
    )
    return old.join(new, key, "full").withColumn("change", state)


def manifest(files: DataFrame, job_id: str, page_rows: int = PAGE_ROWS) -> DataFrame:
    """page, manifest: JSON {"job_id": …, "files": {path: hash}} of `page_rows` files a page, by path.

    files: path, content_hash; they are the manifest as rows. `documents.manifest_lines` is the one
    text of all files.
    """
    entry = F.struct("path", "content_hash")
    placed = numbered(files.select(F.lit(job_id).alias("job_id"), "path", "content_hash"), ["job_id"], ["path"])
    return (
        placed.groupBy("job_id", F.expr(f"(number - 1) div {int(page_rows)}").cast("int").alias("page"))
        .agg(F.sort_array(F.collect_list(entry)).alias("files"))
        .select(
            "page",
            F.to_json(F.struct("job_id", F.map_from_entries("files").alias("files"))).alias("manifest"),
        )
    )


def audit(units: DataFrame, edges: DataFrame) -> DataFrame:
    """Violated key, null, uniqueness and reference rules as (rule, key, n) rows."""

    def report(df, rule, key, n=F.lit(1)):
        return df.select(F.lit(rule).alias("rule"), key.alias("key"), n.cast("long").alias("n"))

    counted = units.groupBy("id").agg(F.count("*").alias("n")).filter("n > 1")
    pairs = edges.groupBy("caller_id", "callee_qname").agg(F.count("*").alias("n")).filter("n > 1")
    orphans = edges.join(
        units.select(F.col("id").alias("caller_id")), "caller_id", "left_anti"
    ).groupBy("caller_id").agg(F.count("*").alias("n"))
    parts = [
        report(counted, "units.id unique", F.col("id"), F.col("n")),
        report(pairs, "edges unique", F.concat_ws(" -> ", "caller_id", "callee_qname"), F.col("n")),
        report(orphans, "edges.caller_id known", F.col("caller_id"), F.col("n")),
    ]
    for column in ("id", "qualified_name", "content"):
        missing = units.filter(F.col(column).isNull())
        parts.append(report(missing, f"units.{column} not null", F.col("id")))
    for column in ("caller_id", "callee_qname"):
        missing = edges.filter(F.col(column).isNull())
        parts.append(report(missing, f"edges.{column} not null", F.col("caller_id")))
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out
