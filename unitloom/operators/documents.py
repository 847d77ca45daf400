"""Numbered rows and ordered text of any length: no task, row or group holds a whole document.

Rows are dealt by ranges of their place, so a long document spans many partitions and a task
passes its rows in batches; what lies before a partition is a sum over earlier partitions.
"""

from pyspark.sql import Column, DataFrame, Window, functions as F, types as T

from unitloom.functions import kernels, shipping  # noqa: F401
from unitloom.session import cut_lineage

PART, BEFORE = "_part", "_before"


def numbered(rows: DataFrame, group: list, order: list, name: str = "number") -> DataFrame:
    """Rows with their place (from 1) within their group by `order`.

    The rows move once, by ranges of (group, order), and are written to the checkpoint folder, as ranges
    are drawn anew by each run. A group may fill any number of partitions: a partition counts its own
    rows, and the one group that it takes over from the partition before gets the rows counted there;
    that is one row per partition, which is broadcast. Rows that are equal in group and order lie in one
    partition and are numbered in any order, so `order` should end in a key. Columns of `group` are
    plain values (no floats, arrays or structs). NULL is a group and comes first. An existing column
    `name` raises ValueError; an empty table stays empty.
    """
    if name in rows.columns:
        raise ValueError(f"the rows have a column {name} already")
    keys = [*group, *order]
    placed = cut_lineage(rows.repartitionByRange(*keys).sortWithinPartitions(*keys))
    placed = placed.withColumn(PART, F.spark_partition_id())
    schema = T.StructType([*placed.schema.fields, T.StructField(name, T.LongType())])
    counted = placed.mapInArrow(kernels.run_places(group, name), schema)

    first = placed.groupBy(PART).agg(F.min(F.struct(*group)).alias("first")).select(PART, "first.*")
    at_edges = F.broadcast(first.select(*group).distinct())
    sizes = placed.alias("p").join(at_edges.alias("e"), _equal("p", "e", group), "left_semi")
    sizes = sizes.groupBy(PART, *group).agg(F.count("*").alias("n"))
    earlier = Window.partitionBy(*group).orderBy(PART).rowsBetween(Window.unboundedPreceding, -1)
    sums = sizes.withColumn(BEFORE, F.sum("n").over(earlier))
    taken_over = sums.alias("s").join(F.broadcast(first).alias("f"), _equal("s", "f", [PART, *group]), "left_semi")
    taken_over = cut_lineage(taken_over.filter(F.col(BEFORE).isNotNull()).select(PART, *group, BEFORE))

    out = counted.alias("c").join(F.broadcast(taken_over).alias("t"), _equal("c", "t", [PART, *group]), "left")
    total = (F.col(f"c.{name}") + F.coalesce(F.col(f"t.{BEFORE}"), F.lit(0))).alias(name)
    return out.select(*[F.col(f"c.`{c}`") for c in rows.columns], total)


def _equal(left, right, columns):
    """Columns equal, NULL equal to NULL."""
    both = F.lit(True)
    for c in columns:
        both = both & F.col(f"{left}.`{c}`").eqNullSafe(F.col(f"{right}.`{c}`"))
    return both


def write_lines(lines: DataFrame, folder: str, order: list, document: str | None = None, mode: str = "errorifexists") -> None:
    """Column `line` as text in the order of `order`; the part files in the order of their numbers are the text.

    With `document` there is a folder `document=value` for each of its values. Every task writes one
    range of the order row by row.
    """
    keys = [*([document] if document else []), *order]
    ranged = lines.repartitionByRange(*keys).sortWithinPartitions(*keys)
    if document is None:
        ranged.select("line").write.mode(mode).text(folder)
    else:
        ranged.select(document, "line").write.mode(mode).partitionBy(document).text(folder)


def quoted(column) -> Column:
    """A string as JSON string; NULL becomes null."""
    inside = F.to_json(F.array(column), {"ignoreNullFields": "false"})
    return inside.substr(F.lit(2), F.length(inside) - 2)


def manifest_lines(files: DataFrame, job_id: str) -> DataFrame:
    """number, line: the JSON manifest {"job_id": …, "files": {path: hash}}, one line per file by path.

    files: path (unique), content_hash; rows without a path are no entry. The lines in order are one
    JSON text, whatever the number of files; `write_lines(…, ["number"])` stores it.
    """
    ends = files.sparkSession.range(1).select(
        F.explode(
            F.array(
                F.struct(F.lit(0).alias("kind"), F.concat(F.lit('{"job_id": '), quoted(F.lit(job_id)), F.lit(', "files": {')).alias("line")),
                F.struct(F.lit(2).alias("kind"), F.lit("}}").alias("line")),
            )
        ).alias("end")
    ).select("end.kind", F.lit("").alias("path"), "end.line")
    entries = files.filter("path is not null").select(
        F.lit(1).alias("kind"), "path", F.concat(quoted("path"), F.lit(": "), quoted("content_hash")).alias("line")
    )
    lines = numbered(ends.unionByName(entries).withColumn("job", F.lit(job_id)), ["job"], ["kind", "path"])
    behind = (F.col("kind") == 1) & (F.col("number") > 2)
    return lines.select("number", F.when(behind, F.concat(F.lit(", "), "line")).otherwise(F.col("line")).alias("line"))
