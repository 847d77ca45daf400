"""JavaScript, TypeScript, TSX and Rust units."""

from pyspark.sql import Column, DataFrame, functions as F

from unitloom.functions import marking
from unitloom.functions.texts import role, strip
from unitloom.operators.extract import docs
from unitloom.operators.extract.common import (
    ANONYMOUS, BRACES, BRACKETS, GAP, ID, MARK, PARENS, SPACE, TO_MARK, _col, all_matches,
    compiled, distinct_calls, first_match, last_line_like, let, marker, newlines,
    pieces_in, placed, unmark,
)

SCRIPT_LANGUAGES = ["javascript", "typescript", "tsx"]

mark_script, mark_typed, mark_rust = (marker(m) for m in (marking.mark_script, marking.mark_typed, marking.mark_rust))


# -- JavaScript family ---------------------------------------------------------------

_SCRIPT_WORDS = (
    "if|for|while|switch|catch|with|return|function|typeof|new|delete|void|do|else|"
    "case|in|of|instanceof|await|yield|throw|async|import|super"
)
# An arrow with another one behind it belongs to the type of a function.
_TYPE = (
    rf"(?:{GAP}:{GAP}(?:[\w$.<>\[\]|&,'\" \t?\x04-\x07]++|{MARK}|=>(?=[^;{{}}=]*+(?:=(?!>)[^;{{}}=]*+)*+=>)|{PARENS}|{BRACES}(?={GAP}[{{=|&]))++)?+"
)
_VALUE_BEFORE = r"(?<=\x04[\x05-\x07]{0,3})"
_NO_VALUE_BEFORE = r"(?<!\x04[\x05-\x07]{0,3})"
_NO_MODIFIER_BEFORE = r"(?<!\x05[\x06\x07]{0,2})"
_WORD_START = r"(?<![\p{L}\p{N}_$.])"


def _function(name: str) -> str:
    return rf"(?:async{SPACE})?+function\b{GAP}{name}{GAP}{PARENS}{_TYPE}{GAP}{BRACES}"


# Cheap tests come first.
_FUNCTION_START = rf"(?=async[\s\x01]|function\b){_WORD_START}"
DECLARATION = (_FUNCTION_START + _NO_MODIFIER_BEFORE + _NO_VALUE_BEFORE, _function(ID))
EXPRESSIONS = [
    (_FUNCTION_START + _NO_MODIFIER_BEFORE + _VALUE_BEFORE, _function(f"(?:{ID})?+")),
    (_FUNCTION_START + _NO_MODIFIER_BEFORE + _NO_VALUE_BEFORE, _function("")),
]

_MODIFIER = "static|async|get|set|public|private|protected|override|readonly"
_METHOD_NAME = rf"(?:(?:{_MODIFIER}){SPACE}(?=[\p{{L}}\p{{N}}_$#\[*]))*+(?:\*{GAP})?+"
_METHOD_HEAD = rf"{_METHOD_NAME}(?!(?:{_SCRIPT_WORDS})\b)(?:\#?+{ID}|{BRACKETS}){GAP}\??+{GAP}{PARENS}"
METHOD = (
    rf"(?=[\p{{L}}_$#\[*])(?<![\p{{L}}\p{{N}}_$.#]){_NO_MODIFIER_BEFORE}(?={_METHOD_HEAD})",
    rf"{_METHOD_HEAD}{_TYPE}{GAP}{BRACES}",
)
_EXPR = rf"(?:[^()\[\]{{}},;\n]++|{PARENS}|{BRACKETS}|{BRACES}|\n{MARK}(?=\s*+[.?:&|+*]))++"
_ARROW_HEAD = (
    rf"(?:async\b{GAP})?+(?:{PARENS}{_TYPE}|(?!(?:{_SCRIPT_WORDS})\b){ID}){GAP}=>"
)
ARROW = (
    rf"(?=[(\p{{L}}_$]){_WORD_START}(?<!\x06\x07?)(?={_ARROW_HEAD})",
    rf"{_ARROW_HEAD}{GAP}(?:{BRACES}|{_EXPR})",
)
CLASS = (
    rf"(?=class[\s\x01]){_WORD_START}{_NO_MODIFIER_BEFORE}{_NO_VALUE_BEFORE}",
    rf"class{SPACE}{ID}[^{{}}]*+{BRACES}",
)
_TYPE_ONLY = rf"\b(?:interface{SPACE}{ID}[^{{}};]*+{BRACES}|type{SPACE}{ID}{GAP}=(?:[^;{{}}()\n]++|{PARENS}|{BRACES})*+)"

SCRIPT_CALL = (
    rf"(?<![\p{{L}}\p{{N}}_$#\x07])(?!(?:{_SCRIPT_WORDS})\b)({ID})"
    rf"{GAP}(?:\?\.)?+{GAP}(?!{PARENS}(?:{GAP}:{GAP}(?:[\w$][^{{}};()]*+|{BRACES}))?+{GAP}\{{)\("
)


def _spans(marked, before: str, pattern: str, consume: bool = False) -> Column:
    """Blocks of a pattern from every start position (or side by side) with positions.

    `before` looks at what precedes a block; it is not part of what is matched again
    on the captured text.
    """
    # The text behind a block is only looked at, a further block may start there.
    whole = f"(?=({pattern}{TO_MARK}))" + (pattern if consume else "")
    return placed(all_matches(marked, before + whole, pieces_in(before) + 1), pattern)


def _named(spans, symbol) -> Column:
    return F.transform(spans, lambda s: F.struct(s.alias("span"), unmark(symbol(s["marked"])).alias("symbol")))


def _inside(inner, outer) -> Column:
    """Strict containment of spans; positions compare as (line, column)."""
    return (outer["start"] < inner["start"]) & (inner["end"] <= outer["end"])


def _strip_types(marked) -> Column:
    """Interfaces and type aliases go; the marks of their line ends stay."""
    alone = rf"(?<![\p{{L}}\p{{N}}_$]){_TYPE_ONLY}"
    ends = lambda t: F.coalesce(F.array_join(all_matches(t, rf"\n{MARK}"), ""), F.lit(""))
    between = F.split(_col(marked), compiled(alone))
    return F.array_join(F.zip_with(between, all_matches(marked, alone), lambda b, t: F.concat(b, ends(t))), "")


def _by_position(units) -> Column:
    """Document order; an enclosing unit comes first."""

    def compare(a, b):
        x, y = a["span"], b["span"]
        return (
            F.when(x["start"] < y["start"], -1)
            .when(x["start"] > y["start"], 1)
            .when(x["end"] > y["end"], -1)
            .when(x["end"] < y["end"], 1)
            .otherwise(0)
        )

    return F.array_sort(units, compare)


def extract_scripts(df: DataFrame) -> DataFrame:
    """Adds `script`: units of JavaScript, TypeScript and TSX text."""
    is_script = F.col("language").isin(SCRIPT_LANGUAGES)
    mine = F.when(is_script, F.col("text"))
    plain = F.col("language") == "javascript"
    df = df.withColumns({"js_marked": mark_script(F.when(plain, mine)), "ts_marked": mark_typed(F.when(~plain, mine))})
    df = df.withColumn("js_marked", F.when(plain, F.col("js_marked")).otherwise(_strip_types("ts_marked"))).drop("ts_marked")

    def spans(pattern):
        return _spans("js_marked", *pattern)

    df = df.withColumns(
        {
            "js_classes": _named(
                spans(CLASS), lambda b: first_match(b, rf"class{SPACE}({ID})", 1)
            ),
            "js_units": F.concat(
                _named(spans(DECLARATION), lambda b: first_match(b, rf"function{GAP}({ID})", 1)),
                *[_named(spans(e), lambda b: F.lit(ANONYMOUS)) for e in EXPRESSIONS],
                _named(spans(ARROW), lambda b: F.lit(ANONYMOUS)),
                _named(
                    spans(METHOD),
                    lambda b: strip(first_match(b, rf"\A{_METHOD_NAME}(\#?+{ID}|{BRACKETS})", 1)),
                ),
            ),
            "js_not_blank": last_line_like(mine, docs.NOT_BLANK),
            "js_opening": last_line_like(mine, docs.JSDOC_OPEN),
            "js_other": last_line_like(mine, docs.SLASH_OTHER),
        }
    )

    def unit(u, file):
        span = u["span"]
        start, end = span["start"]["line"], span["end"]["line"]
        chain = F.transform(
            F.filter(file["js_classes"], lambda c: _inside(span, c["span"])), lambda c: c["symbol"]
        )
        return F.struct(
            start.alias("start_line"),
            end.alias("end_line"),
            u["symbol"].alias("symbol"),
            chain.alias("class_chain"),
            role(chain).alias("role"),
            distinct_calls(span["marked"], SCRIPT_CALL).alias("calls"),
            docs.js_doc(
                file["lines"], file["js_not_blank"], file["js_opening"], file["js_other"], start
            ).alias("doc"),
            F.lit(None).cast("map<string,string>").alias("refs"),
        )

    context = F.struct("lines", "js_classes", "js_not_blank", "js_opening", "js_other")
    units = let(context, lambda c: F.transform(_by_position("js_units"), lambda u: unit(u, c)))
    return df.withColumn("script", units).drop(
        "js_marked", "js_classes", "js_units",
        "js_not_blank", "js_opening", "js_other",
    )


# -- Rust ------------------------------------------------------------------------------

_RUST_WORDS = "if|while|match|for|return|loop|in|as|move|let|mut|ref|unsafe|else|where|fn|pub|Fn|FnMut|FnOnce|dyn|impl|crate|break"
_RUST_ID = r"[\p{L}_][\p{L}\p{N}_]*+"
FN_ITEM = (
    r"(?<![\p{L}\p{N}_])",
    rf"(?:pub{GAP}(?:{PARENS}{GAP})?+)?+(?:(?:async|const|unsafe|default|extern(?:{GAP}\"\")?+){SPACE})*+"
    rf"fn{SPACE}{_RUST_ID}(?:[^{{}};()\[\]]++|{PARENS}|{BRACKETS})*+{BRACES}",
)
IMPL_ITEM = (r"(?=impl\b)(?<![\p{L}\p{N}_])", rf"impl\b[^{{}};]*+{BRACES}")
RUST_CALL = (
    rf"(?<![\p{{L}}\p{{N}}_])(?!(?:{_RUST_WORDS})\b)({_RUST_ID}){GAP}"
    rf"(?={PARENS}|\()(?!{PARENS}{GAP}(?:=>|=(?!=)|\|(?!\|)|if\b[^{{}}]*=>))\("
)
# The name of an item is no call.
RUST_ITEM = rf"\bfn{SPACE}[\p{{L}}_][\p{{L}}\p{{N}}_]*+"
RUST_MACRO = rf"[\p{{L}}\p{{N}}_]+!{GAP}(?:{PARENS}|{BRACKETS}|{BRACES})|#!?{BRACKETS}"


def _behind_generics(head) -> Column:
    """`head` without the angle brackets it opens with, at any depth."""

    def step(s, t):
        depth = s["depth"] + F.when(t == "<", 1).when(t == ">", -1).otherwise(0)
        return F.when(
            s["open"], F.struct(depth.alias("depth"), (depth > 0).alias("open"), F.lit("").alias("rest"))
        ).otherwise(F.struct(s["depth"], s["open"], F.concat(s["rest"], t).alias("rest")))

    start = F.struct(F.lit(0).alias("depth"), F.lit(True).alias("open"), F.lit("").alias("rest"))
    rest = F.aggregate(all_matches(head, r"->|<|>|[^<>-]++|-"), start, step, lambda s: s["rest"])
    return F.when(_col(head).startswith("<"), rest).otherwise(head)


def impl_type(marked) -> Column:
    """Type an impl block belongs to, as written."""
    head = unmark(F.regexp_extract(_col(marked), r"^[^{]*", 0))
    head = let(F.regexp_replace(head, r"^impl\s*", ""), _behind_generics)
    head = F.regexp_replace(head, r"^(?s:.*)\sfor\s+(?!<)", "")
    return strip(F.regexp_replace(head, r"\s+where\b(?s:.*)", ""))


def extract_rust(df: DataFrame) -> DataFrame:
    """Adds `rust`: `fn` items; a function inside another is part of it, not a unit."""
    mine = F.when(F.col("language") == "rust", F.col("text"))
    df = df.withColumns({"rs_marked": mark_rust(mine), "rs_other": last_line_like(mine, docs.RUST_OTHER)})
    df = df.withColumns(
        {
            "rs_impls": _named(_spans("rs_marked", *IMPL_ITEM), impl_type),
            "rs_units": _spans("rs_marked", *FN_ITEM, consume=True),
        }
    )

    def unit(span, file):
        start, end = span["start"]["line"], span["end"]["line"]
        chain = F.transform(
            F.filter(file["rs_impls"], lambda c: _inside(span, c["span"])), lambda c: c["symbol"]
        )
        # Macro arguments and attributes are token trees, they hold no calls.
        body = F.regexp_replace(span["marked"], compiled(f"{RUST_MACRO}|{RUST_ITEM}"), " ")
        return F.struct(
            start.alias("start_line"),
            end.alias("end_line"),
            F.regexp_extract(span["block"], rf"fn\s+({_RUST_ID})", 1).alias("symbol"),
            chain.alias("class_chain"),
            role(chain).alias("role"),
            distinct_calls(body, RUST_CALL).alias("calls"),
            docs.rust_doc(file["lines"], file["rs_other"], start).alias("doc"),
            F.lit(None).cast("map<string,string>").alias("refs"),
        )

    context = F.struct("lines", "rs_impls", "rs_other")
    units = let(context, lambda c: F.transform("rs_units", lambda s: unit(s, c)))
    return df.withColumn("rust", units).drop(
        "rs_marked", "rs_other", "rs_impls", "rs_units"
    )
