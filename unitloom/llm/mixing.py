"""Mixing sources to target weights.

Sizes are summed by source; targets share all words by the sources' weights and stop at a highest
number of repeats. A document is emitted floor(rate) times, plus once more when its hash, read as a
number in [0, 1), is below the fraction of the rate. Of SEEDS fixed hash seeds, each source uses
the one whose draw comes nearest to its target.
"""

from pyspark.sql import DataFrame, Window, functions as F

from unitloom.llm.shared import saved, small

WORDS = r"[^\x20\x09-\x0D]+"
WEIGHTS = (1, 2, 3)
MOST_REPEATS = 3
SEEDS = 16


def size_of(text: str = "text"):
    """Number of words of a text; null has none."""
    return F.coalesce(F.regexp_count(text, F.lit(WORDS)), F.lit(0)).cast("long")


def draw(seed):
    """A number in [0, 1) from the doc_id and a seed; null ids draw as the text 'null'."""
    name = F.concat(F.coalesce(F.col("doc_id").cast("string"), F.lit("null")), F.lit(":"), F.lit(seed).cast("string"))
    return F.conv(F.substring(F.md5(name), 1, 13), 16, 10).cast("double") / float(1 << 52)


def ranked_sources(sizes: DataFrame) -> DataFrame:
    """`sizes` (source, source_size) with `place`, the number of sources before it; null is last.

    Range partitions are ordered on their own; the counts of the partitions before are added.
    """
    n = int(sizes.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    order = [F.col("source").isNull(), F.col("source")]
    dealt = saved(sizes.repartitionByRange(n, *order).withColumn("part", F.spark_partition_id()))
    counts = dealt.groupBy("part").agg(F.count("*").alias("n"))
    before = counts.alias("a").join(counts.withColumnsRenamed({"part": "p", "n": "m"}), F.col("p") < F.col("part"), "left")
    before = before.groupBy("part").agg(F.coalesce(F.sum("m"), F.lit(0)).alias("before"))
    here = F.row_number().over(Window.partitionBy("part").orderBy(*order)) - 1
    return dealt.withColumn("here", here).join(F.broadcast(before), "part").select(
        "source", "source_size", (F.col("before") + F.col("here")).alias("place")
    )


def targets(sizes: DataFrame, weights=WEIGHTS, most: int = MOST_REPEATS) -> DataFrame:
    """(source, source_size, target): shares by weight, capped at `most` times the source's size.

    A round gives the words still free to the open sources by weight and caps those whose share
    exceeds their limit; it ends when none does. Only two sums reach the driver in a round.
    """
    cycle = F.array(*[F.lit(float(w)) for w in weights])
    table = saved(ranked_sources(sizes).withColumns(
        {"weight": cycle[F.pmod("place", F.lit(len(weights))).cast("int")], "cap": F.col("source_size") * float(most)}
    ))
    total = table.agg(F.sum("source_size")).first()[0] or 0
    level = 0.0
    while True:
        full = F.col("cap") <= F.col("weight") * level
        capped, open_weight = table.agg(
            F.coalesce(F.sum(F.when(full, F.col("cap"))), F.lit(0.0)), F.coalesce(F.sum(F.when(~full, F.col("weight"))), F.lit(0.0))
        ).first()
        new = (total - capped) / open_weight if open_weight > 0 else level
        if new <= level:
            break
        level = new
    return table.select("source", "source_size", F.least("cap", F.col("weight") * level).alias("target"))


def plan(docs: DataFrame, weights=WEIGHTS, most: int = MOST_REPEATS) -> DataFrame:
    """`docs` with size, source_size, target (double) and repeats (int) added.

    Sources are ordered by code point, null last, and weigh `weights`, repeating. A source without
    words has target 0 and its documents are not taken. Repeated rows of a doc_id draw alike. No
    document is taken more than `most` times. Clashing columns of `docs` are replaced; an empty table
    gives no rows.
    """
    sized = docs.withColumn("size", size_of())
    slim = sized.select("doc_id", "source", "size")
    sizes = slim.groupBy("source").agg(F.sum("size").alias("source_size"))
    goal = targets(sizes, weights, most).withColumn("rate", F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0))
    goal = saved(goal.withColumn("base", F.floor("rate")).withColumn("fraction", F.col("rate") - F.col("base")))
    bound = small(goal)
    drawn = slim.filter("size > 0").withColumnRenamed("source", "s").join(bound, F.col("s").eqNullSafe(F.col("source")))
    sums = drawn.groupBy("source").agg(
        *[F.sum(F.when(draw(i) < F.col("fraction"), F.col("size")).otherwise(0)).alias(f"x{i}") for i in range(SEEDS)]
    ).withColumnRenamed("source", "s")
    miss = [F.abs(F.col("base") * F.col("source_size") + F.col(f"x{i}") - F.col("target")) for i in range(SEEDS)]
    best = F.array_min(F.array(*[F.struct(m.alias("miss"), F.lit(i).alias("seed")) for i, m in enumerate(miss)]))["seed"]
    seeded = sums.join(bound, F.col("s").eqNullSafe(F.col("source")), "right").select(
        "source", "source_size", "target", "base", "fraction", F.coalesce(best, F.lit(0)).alias("seed")
    )
    seeded = saved(seeded)
    keep = [c for c in docs.columns if c not in ("size", "source_size", "target", "repeats")]
    seeded = seeded.withColumnsRenamed({"source": "_source", "source_size": "_source_size", "target": "_target", "seed": "_seed", "base": "_base", "fraction": "_fraction"})
    out = sized.select(*keep, "size").join(small(seeded), F.col("source").eqNullSafe(F.col("_source")))
    name = F.concat(F.coalesce(F.col("doc_id").cast("string"), F.lit("null")), F.lit(":"), F.col("_seed").cast("string"))
    number = F.conv(F.substring(F.md5(name), 1, 13), 16, 10).cast("double") / float(1 << 52)
    repeats = (F.col("_base") + F.when(number < F.col("_fraction"), 1).otherwise(0)).cast("int")
    return out.select(*keep, "size", F.col("_source_size").alias("source_size"), F.col("_target").alias("target"), repeats.alias("repeats"))


def mixed(docs: DataFrame, weights=WEIGHTS, most: int = MOST_REPEATS) -> DataFrame:
    """The documents of the mix, each as often as it is taken, with the columns of `docs`."""
    planned = plan(docs, weights, most)
    copies = F.explode(F.sequence(F.lit(1), F.col("repeats")))
    return planned.filter("repeats > 0").select(*docs.columns, copies.alias("_copy")).drop("_copy")
