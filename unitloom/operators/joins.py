"""Interval containment inside one file."""

from pyspark.sql import DataFrame, functions as F, types as T
from pyspark.sql.pandas.types import to_arrow_type

from unitloom.functions import kernels, shipping  # noqa: F401


def innermost_enclosing(units: DataFrame, classes: DataFrame) -> DataFrame:
    """Adds `enclosing`, the class row with the latest start whose lines hold the unit's, else NULL.

    units: path, start_line, end_line; classes the same plus what is to be carried (the class row without
    path and start_line); of classes with one start the greatest carried row counts. Rows with a NULL in
    path or lines hold nothing and lie in nothing. Starts and ends of a file are merged into one order
    and passed once with a stack of the classes that are open there, batch by batch; a file (one
    source row) lies in one partition, its rows never in one row.
    """
    carried = [c for c in classes.columns if c not in ("path", "start_line")]
    row = F.struct(*carried)
    opened = classes.select(
        "path", F.col("start_line").alias("_start"), F.lit(0).alias("_kind"), F.col("end_line").alias("_end"), row.alias("_class"),
        *[F.lit(None).cast(units.schema[c].dataType).alias(c) for c in units.columns if c != "path"],
    )
    held = units.select(
        "path", F.col("start_line").alias("_start"), F.lit(1).alias("_kind"), F.col("end_line").alias("_end"),
        F.lit(None).cast(classes.select(row.alias("c")).schema["c"].dataType).alias("_class"), *[c for c in units.columns if c != "path"],
    )
    events = opened.unionByName(held).repartition("path").sortWithinPartitions("path", "_start", "_kind", "_class")
    enclosing = T.StructField("enclosing", T.StructType([classes.schema[c] for c in carried]))
    schema = T.StructType([T.StructField(f.name, f.dataType) for f in [*units.schema.fields, enclosing]])
    return events.mapInArrow(kernels.sweep(schema.names, [to_arrow_type(f.dataType) for f in schema.fields]), schema)
