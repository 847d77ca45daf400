"""Audit of document filters: what each one removes, before and after the others.

One table of failing row ids is stored for each filter. Prefixes with the same filters leave the same
rows, so survivors are kept once for each set of filters: a left-anti join with a filter's failing ids
extends a set, a left-semi join counts what the filter removes behind it. Level k holds the survivors
of all sets of k filters, one row for a document and last filter with the list of these sets.
"""

from itertools import combinations, permutations
from math import factorial

from pyspark.sql import DataFrame, functions as F

from unitloom.llm.shared import attach, drop_saved, saved

WORD = r"[^\x20\x09-\x0D]+"
LETTERS = "ABCDE"
COUNTS = ("n", "good", "toxic")


def facts(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """One row for each of `docs` (doc_id, text, source): rid, doc_id, part, good, toxic, digest, A to D.

    part is the source, '' for null; a null text is empty. good and toxic are 1 if any row of `labels`
    with the doc_id has quality = 1 or toxic = 1. A to D are true where the document fails:
    A under 200 words; B fewer than half of the words distinct; C more than 2 % of the characters in A-Z;
    D one of #$%&*| in the text.
    """
    marks = labels.filter("doc_id IS NOT NULL").groupBy("doc_id").agg(
        *[F.max(F.coalesce((F.col(c) == 1).cast("long"), F.lit(0))).alias(k) for c, k in (("quality", "good"), ("toxic", "toxic"))]
    )
    text = F.coalesce("text", F.lit(""))
    read = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("source", F.lit("")).alias("part"), text.alias("text"))
    read = read.withColumn("words", F.regexp_extract_all("text", F.lit(WORD), F.lit(0)))
    judged = read.select(
        "doc_id", "part", F.unhex(F.sha2("text", 256)).alias("digest"),
        (F.size("words") < 200).alias("A"),
        (100 * F.size(F.array_distinct("words")) < 50 * F.size("words")).alias("B"),
        (100 * F.regexp_count("text", F.lit("[A-Z]")).cast("long") > 2 * F.length("text").cast("long")).alias("C"),
        F.col("text").rlike("[#$%&*|]").alias("D"),
    )
    judged = saved(judged.withColumn("rid", F.monotonically_increasing_id()))
    # Rows without an id have no label; their row number keeps them from meeting in one task.
    apart = F.when(F.col("doc_id").isNull(), F.col("rid")).otherwise(F.lit(0))
    known = judged.withColumn("_apart", apart).join(marks.withColumn("_apart", F.lit(0).cast("long")), ["doc_id", "_apart"], "left")
    out = saved(known.drop("_apart").fillna(0, ["good", "toxic"]))
    drop_saved(judged)
    return out


def repeated(rows: DataFrame) -> DataFrame:
    """rid, part of the rows of `rows` (rid, part, doc_id, digest) whose digest a smaller doc_id has too."""
    groups = saved(rows.groupBy("digest").agg(F.min("doc_id").alias("least"), F.count("*").alias("n")).filter("n > 1"))
    out = saved(attach(rows.select("rid", "part", "doc_id", "digest"), groups, "digest").filter("least < doc_id").select("rid", "part"))
    drop_saved(groups)
    return out


def failing_ids(rows: DataFrame) -> dict:
    """The stored failing-id table (rid, part) of each filter, by its letter, for rows of `facts`."""
    return {f: saved(rows.filter(f).select("rid", "part")) for f in "ABCD"} | {"E": repeated(rows)}


def prefix_counts(rows: DataFrame, failing: dict) -> DataFrame:
    """(part, key, n, good, toxic) for rows (rid, part, good, toxic) and failing-id tables by letter.

    Keys: 'S' survivors of the set S of filters ('' for none), 'S>f' rows that f removes behind S, '>f'
    standing for the empty S; '!f' all failing rows of f. Sets are written in the order of the letters.
    """
    count = [F.count("*").alias("n"), F.sum("good").alias("good"), F.sum("toxic").alias("toxic")]
    alive = saved(rows.select("rid", "part", "good", "toxic", F.array(F.lit("")).alias("sets")))
    stored = []
    for level in range(len(failing) + 1):
        open_ = alive.withColumn("set", F.explode("sets"))
        found = [open_.groupBy("part", F.col("set").alias("key")).agg(*count)]
        for f, ids in failing.items() if level < len(failing) else ():
            gone = alive.join(ids.select("rid"), "rid", "left_semi").withColumn("set", F.explode("sets")).filter(~F.contains("set", F.lit(f)))
            found.append(gone.groupBy("part", F.concat("set", F.lit(f">{f}")).alias("key")).agg(*count))
        stored.append(saved(_all(found)))
        if level < len(failing):
            left = [
                alive.join(ids.select("rid"), "rid", "left_anti").withColumn("sets", _extended(f)) for f, ids in failing.items()
            ]
            last, alive = alive, saved(_all(left))
            drop_saved(last)
            alive = alive.filter(F.size("sets") > 0)
    drop_saved(alive)
    zero = F.lit(0).cast("long")
    every = [t.groupBy("part").agg(F.count("*").alias("n")).select("part", F.lit(f"!{f}").alias("key"), "n", zero.alias("good"), zero.alias("toxic")) for f, t in failing.items()]
    out = saved(_all([*stored, *every]))
    drop_saved(*stored)
    return out


def _extended(f):
    """The sets of a row that `f` extends by a last letter."""
    return F.transform(F.filter("sets", lambda s: F.right(s, F.lit(1)) < F.lit(f)), lambda s: F.concat(s, F.lit(f)))


def _all(frames):
    out = frames[0]
    for more in frames[1:]:
        out = out.unionByName(more)
    return out


def orders(counts: DataFrame, letters: str = LETTERS) -> DataFrame:
    """The counts of `prefix_counts` for every order of the filters and each of its steps.

    (part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley).
    A part has at most 2**n + n * 2**(n - 1) + n counts, so they fit in one map a part.
    """
    entry = F.struct("key", F.struct(*COUNTS))
    parts = counts.groupBy("part").agg(F.map_from_entries(F.collect_list(entry)).alias("m"))

    def of(key, field="n"):
        return F.coalesce(F.try_element_at("m", key)[field], F.lit(0))

    totals = []
    for f in letters:
        others = [x for x in letters if x != f]
        weighted = [
            of(F.lit("".join(s) + ">" + f)) * factorial(k) * factorial(len(others) - k) for k in range(len(letters)) for s in combinations(others, k)
        ]
        total = weighted[0]
        for x in weighted[1:]:
            total = total + x
        totals += [F.lit(f), F.struct(total.alias("shapley"), of(F.lit("".join(others) + ">" + f)).alias("alone"))]
    every = F.array(*[F.lit("".join(p)) for p in permutations(letters)])
    walked = parts.withColumn("totals", F.create_map(*totals)).withColumn("filter_order", F.explode(every))
    walked = walked.select("*", F.posexplode(F.split("filter_order", "")).alias("at", "f"))

    def the_set(n):
        return F.array_join(F.array_sort(F.slice(F.split("filter_order", ""), F.lit(1), n)), "")

    walked = walked.withColumns({"behind": F.concat(the_set(F.col("at")), F.lit(">"), "f"), "after": the_set(F.col("at") + 1)})
    return walked.select(
        "part", "filter_order", (F.col("at") + 1).alias("step"), of(F.col("after")).alias("kept"), of(F.col("behind")).alias("removed"),
        (of(F.concat(F.lit("!"), "f")) - of(F.col("behind"))).alias("redundant"), F.col("totals")[F.col("f")]["alone"].alias("unique_fails"),
        of(F.col("behind"), "good").alias("good_lost"), of(F.col("behind"), "toxic").alias("toxic_lost"),
        F.col("totals")[F.col("f")]["shapley"].alias("shapley"),
    )


def audit(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """`orders` of the five filters A to E over `docs` (doc_id, text, source) and `labels` (doc_id, quality, toxic).

    E fails where the same text belongs to a smaller doc_id, in the whole table and removed or not.
    Rows are counted, so rows that repeat a doc_id count each; rows without a doc_id fail E never and
    have no label. Null texts are empty (and equal to empty ones), a null source is the part ''.
    Repeated label rows count once. Further columns play no part; no documents give no rows.
    """
    rows = facts(docs, labels)
    failing = failing_ids(rows)
    counts = prefix_counts(rows, failing)
    drop_saved(rows, *failing.values())
    return orders(counts)
