"""Python functions, their calls, docs, enclosing classes and class refs."""

from pyspark.sql import Column, DataFrame, functions as F

from unitloom.functions import marking
from unitloom.functions.texts import line_range, role, strip
from unitloom.operators.extract import docs
from unitloom.operators.extract.common import (
    _col, all_matches, distinct_calls, let, marker, newlines, number_lines,
)

NAME = r"[\p{L}_][\p{L}\p{N}_]*+"
DOTTED = rf"{NAME}(?:\s*\.\s*{NAME})*+"
KEYWORDS = (
    "and|as|assert|async|await|del|elif|else|except|for|from|global|if|import|in|is|"
    "lambda|nonlocal|not|or|pass|raise|return|while|with|yield"
)

# \x02 opens a line that continues the logical line above it.
_HEAD_REST = r"[^\n]*+(?:\n\d++\t\x02[^\n]*+)*+"


def _body(indent_group: int) -> str:
    """Deeper indented or continued lines; blank lines only if such a line follows."""
    return (
        r"(?:(?:\n\d++\t[ \t]*+(?=\n))*+"
        rf"\n\d++\t(?:\x02[^\n]*+|\{indent_group}[ \t]++\S[^\n]*+))*+"
    )


_DEF = r"(?:async[ \t]++)?def[ \t]++"
DEF_BLOCK = rf"(?md)^(?=(\d++\t([ \t]*+){_DEF}{NAME}{_HEAD_REST}{_body(2)}))"
CLASS_BLOCK = rf"(?md)^(?=(\d++\t([ \t]*+)class[ \t]++{NAME}{_HEAD_REST}{_body(2)}))"
_DECORATORS = (
    r"\d++\t([ \t]*+)@[^\n]*+\n(?:\d++\t(?:\x02[^\n]*+|[ \t]*+(?=\n)|\{g}@[^\n]*+)\n)*+"
)
# The run of decorators is consumed, so only its first line opens a unit.
DECORATED_BLOCK = (
    rf"(?md)^(?=({_DECORATORS.replace('{g}', '2')}\d++\t\2{_DEF}{NAME}{_HEAD_REST}{_body(2)}))"
    + _DECORATORS.replace("{g}", "3")
)
_TO_DEF = rf"(?md)^\d++\t[ \t]*+{_DEF}(?s:.*)"

CALL = rf"(?<![\p{{L}}\p{{N}}_])(?!(?:{KEYWORDS})\b)({NAME})[ \t]*+\("
# A name that is defined is no call.
_DEFINED = rf"\b(?:def|class)[ \t]++{NAME}"

# Comments dropped, strings emptied (f-string fields kept), continued lines marked.
blank = marker(marking.blank_python)


def clean(block) -> Column:
    """Block text without line numbers, continued lines joined."""
    return F.regexp_replace(F.regexp_replace(_col(block), r"\n\d++\t\x02", " "), r"(?md)^\d++\t", "")


def _span(block):
    start = F.regexp_extract(block, r"^(\d+)", 1).cast("int")
    return start, start + newlines(block).cast("int")


def _arguments(text) -> Column:
    """Pieces of a text between commas outside all brackets, at any depth."""

    def step(s, t):
        depth = s["depth"] + F.when(t.rlike(r"^[(\[{]"), 1).when(t.rlike(r"^[)\]}]"), -1).otherwise(0)
        cut = (t == ",") & (s["depth"] == 0)
        return F.struct(
            depth.alias("depth"),
            F.when(cut, F.array_append(s["done"], s["part"])).otherwise(s["done"]).alias("done"),
            F.when(cut, F.lit("")).otherwise(F.concat(s["part"], t)).alias("part"),
        )

    start = F.struct(F.lit(0).alias("depth"), F.array().cast("array<string>").alias("done"), F.lit("").alias("part"))
    tokens = all_matches(text, r"[(\[{)\]},]|[^(\[{)\]},]++")
    return F.aggregate(tokens, start, step, lambda s: F.filter(F.array_append(s["done"], s["part"]), lambda p: strip(p) != ""))


def class_header(header) -> Column:
    """name, bases, metaclass of a class header written on one line."""
    header = _col(header)
    args = F.regexp_extract(header, rf"class\s+{NAME}\s*+\((.*)\)\s*+:", 1)
    parts = F.transform(_arguments(args), strip)
    plain = F.filter(parts, lambda p: ~p.rlike(r"^[^(]*+\[") & ~p.rlike(r"^[^(]*+="))
    bases = F.filter(
        F.transform(plain, lambda p: F.regexp_extract(p, rf"^({DOTTED})\s*+(?:\(.*\))?+$", 1)),
        lambda b: b != "",
    )
    metas = F.filter(
        F.transform(parts, lambda p: F.regexp_extract(p, r"^metaclass\s*=\s*(.+)$", 1)), lambda m: m != ""
    )
    return F.struct(
        F.regexp_extract(header, rf"class\s+({NAME})", 1).alias("name"),
        bases.alias("bases"),
        F.coalesce(F.get(metas, F.lit(0)), F.lit("type")).alias("metaclass"),
    )


def static_mro(name, bases) -> Column:
    """Bases, own name, object (in this order)."""
    return F.array_join(F.concat(_col(bases), F.array(_col(name), F.lit("object"))), ", ")


def class_spans(numbered) -> Column:
    def span(block):
        start, end = _span(block)
        head = class_header(F.regexp_extract(clean(block), r"^[^\n]*", 0))
        return let(
            head,
            lambda h: F.struct(
                start.alias("start"), end.alias("end"), h["name"].alias("name"),
                h["bases"].alias("bases"), h["metaclass"].alias("metaclass"),
            ),
        )

    return F.transform(all_matches(numbered, CLASS_BLOCK, 1), span)


def extract(df: DataFrame) -> DataFrame:
    """Adds `python`: the file's units in document order, NULL for other languages.

    A decorated function appears twice, first with and then without its decorators.
    """
    mine = F.when(F.col("language") == "python", F.col("text"))
    df = df.withColumn("py_numbered", number_lines(F.concat(blank(mine), F.lit("\n"))))
    df = df.withColumns(
        {
            "py_classes": class_spans("py_numbered"),
            "py_blocks": F.concat(
                all_matches("py_numbered", DECORATED_BLOCK, 1), all_matches("py_numbered", DEF_BLOCK, 1)
            ),
        }
    )

    def locate(block):
        start, end = _span(block)
        return F.struct(
            start.alias("start"), end.alias("end"), F.regexp_extract(block, _TO_DEF, 0).alias("inner"),
        )

    def surround(b, classes):
        return b.withField(
            "around", F.filter(classes, lambda c: (c["start"] < b["start"]) & (b["end"] <= c["end"]))
        )

    def unit(b, lines):
        start, end, inner, around = b["start"], b["end"], b["inner"], b["around"]
        head_lines = newlines(F.regexp_extract(inner, rf"^{_HEAD_REST}", 0))
        body_start = F.regexp_extract(inner, r"^(\d+)", 1).cast("int") + head_lines.cast("int") + 1
        chain = F.transform(around, lambda c: c["name"])
        owner = F.get(around, F.size(around) - 1)
        refs = F.when(
            F.size(around) > 0,
            F.create_map(
                F.lit("mro"), static_mro(owner["name"], owner["bases"]),
                F.lit("metaclass"), owner["metaclass"],
                F.lit("mro_source"), F.lit("static"),
            ),
        )
        return F.struct(
            start.alias("start_line"),
            end.alias("end_line"),
            F.regexp_extract(inner, rf"{_DEF}({NAME})", 1).alias("symbol"),
            chain.alias("class_chain"),
            role(chain).alias("role"),
            distinct_calls(F.regexp_replace(clean(inner), _DEFINED, " "), CALL).alias("calls"),
            docs.python_doc(
                F.when(body_start <= end, line_range(lines, body_start, end)).otherwise("")
            ).alias("doc"),
            refs.alias("refs"),
        )

    context = F.struct(F.col("py_classes").alias("classes"), "lines")
    units = let(
        context,
        lambda c: F.transform(
            "py_blocks",
            lambda b: let(locate(b), lambda x: let(surround(x, c["classes"]), lambda y: unit(y, c["lines"]))),
        ),
    )
    ordered = F.array_sort(
        units,
        lambda a, b: F.when(a["start_line"] != b["start_line"], a["start_line"] - b["start_line"]).otherwise(0),
    )
    return df.withColumn("python", ordered).drop("py_numbered", "py_classes", "py_blocks")
