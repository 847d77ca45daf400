"""Script and style blocks of HTML pages, and the scripts inside as JavaScript text."""

from pyspark.sql import Column, DataFrame, functions as F

from unitloom.functions.texts import html_role
from unitloom.operators.extract.common import all_matches, let, newlines

BLOCK = r"(?is)<script\b.*?</script\s*>|<style\b.*?</style\s*>"
# Every text run up to and including a block; \G keeps runs adjacent and the scan linear.
_STEP = r"(?is)\G.*?(?:<script\b.*?</script\s*>|<style\b.*?</style\s*>)"


def blocks(text) -> Column:
    """tag, block, start_line (of the whole page), end_line in document order.

    The lines before each block are running sums over the runs of text.
    """
    text = F.col(text) if isinstance(text, str) else text

    def place(run, before):
        block = F.regexp_extract(run, BLOCK, 0)
        start = before + newlines(run).cast("int") - newlines(block).cast("int") + 1
        return F.struct(
            F.lower(F.regexp_extract(block, r"^<(\w+)", 1)).alias("tag"),
            block.alias("block"),
            start.alias("start_line"),
            (start + newlines(block).cast("int")).alias("end_line"),
        )

    def sums(runs):
        add = lambda done, run: F.array_append(done, F.element_at(done, -1) + newlines(run).cast("int"))
        return F.aggregate(runs, F.array(F.lit(0)), add)

    return let(
        all_matches(text, _STEP),
        lambda runs: let(sums(runs), lambda before: F.transform(runs, lambda r, i: place(r, F.get(before, i)))),
    )


def script_body(block) -> Column:
    """Script text without its tags; line numbers stay relative to the element."""
    return F.regexp_replace(F.regexp_replace(block, r"(?is)\A<script\b[^>]*>", ""), r"(?is)</script\s*>\z", "")


def extract(df: DataFrame) -> DataFrame:
    """Adds `html`: one unit per block, without calls."""
    mine = F.when(F.col("language") == "html", F.col("text"))

    def unit(b):
        none = F.array().cast("array<string>")
        return F.struct(
            b["start_line"].alias("start_line"),
            b["end_line"].alias("end_line"),
            F.concat(b["tag"], F.lit(":inline:"), b["start_line"].cast("string")).alias("symbol"),
            none.alias("class_chain"),
            html_role(b["tag"]).alias("role"),
            none.alias("calls"),
            F.lit("").alias("doc"),
            F.lit(None).cast("map<string,string>").alias("refs"),
        )

    df = df.withColumn("html_blocks", blocks(mine))
    return df.withColumn("html", F.transform("html_blocks", unit)).drop("html_blocks")


def with_inline_scripts(files: DataFrame) -> DataFrame:
    """Each file, plus one row per script element of a page (path `p:inline:<line>`).

    `part` orders the rows of one file: the page first, then its scripts.
    """
    scripts = F.when(
        F.col("language") == "html", F.filter(blocks("text"), lambda b: b["tag"] == "script")
    )
    inline = F.transform(
        F.coalesce(scripts, F.array().cast("array<struct<tag:string,block:string,start_line:int,end_line:int>>")),
        lambda b: F.struct(
            F.concat("path", F.lit(":inline:"), b["start_line"].cast("string")).alias("path"),
            F.lit("javascript").alias("language"),
            script_body(b["block"]).alias("text"),
            b["block"].alias("shown"),
        ),
    )
    own = F.struct("path", "language", "text", F.col("text").alias("shown"))
    pieces = F.concat(F.array(own), inline)
    rest = [c for c in files.columns if c not in ("path", "language", "text")]
    return files.select(*rest, F.posexplode(pieces).alias("part", "piece")).select(*rest, "part", "piece.*")
