"""Names, hashes and the texts derived from one unit, as column expressions.

Callers pass the standard unit column names; every function returns a Column.
"""

from pyspark.sql import Column, functions as F

EMBED_MAX_LEN = 400
EMBED_CALLS = 10
LANE_CALLS = 15
SNIPPET_LINES = 8

# Line ends as a universal line splitter sees them, and blanks.
LINE_END = r"\r\n|[\n\r\x0b\x0c\x1c\x1d\x1e\x{85}\x{2028}\x{2029}]"
FIRST_LINE = r"^[^\n\r\x0b\x0c\x1c\x1d\x1e\x{85}\x{2028}\x{2029}]*"
BLANK = r"[\s\x1c-\x1f\x{85}\p{Z}]"
EDGE_BLANKS = rf"^{BLANK}+|{BLANK}+$"

REF_ROLES = ["method", "function", "classmethod", "staticmethod"]
HIDDEN_REFS = ["mro_source"]
CLASS_REFS = ["mro", "metaclass"]


def _col(c):
    return F.col(c) if isinstance(c, str) else c


def strip(text) -> Column:
    # Only texts with a blank at an edge are searched; the array binds the text, so it is computed once.
    blank = lambda t: F.left(t, F.lit(1)).rlike(BLANK) | F.right(t, F.lit(1)).rlike(BLANK)
    cut = lambda t: F.when(blank(t), F.regexp_replace(t, EDGE_BLANKS, "")).otherwise(t)
    return F.get(F.transform(F.array(_col(text)), cut), F.lit(0))


def _filled(array) -> Column:
    return F.size(F.coalesce(_col(array), F.array().cast("array<string>"))) > 0


def _some(text) -> Column:
    return F.coalesce(_col(text), F.lit("")) != ""


def qualified_name(module="module", class_chain="class_chain", symbol="symbol") -> Column:
    parts = F.concat(
        F.array(_col(module)),
        F.coalesce(_col(class_chain), F.array().cast("array<string>")),
        F.array(_col(symbol)),
    )
    return F.array_join(F.filter(parts, _some), ".")


def unit_id(path="path", name="qualified_name") -> Column:
    return F.concat(_col(path), F.lit("::"), _col(name))


def line_range(lines, start, end) -> Column:
    """Content of 1-based inclusive lines start..end."""
    start, end = _col(start), _col(end)
    return F.array_join(F.slice(_col(lines), start, end - start + 1), "\n")


def role(class_chain="class_chain") -> Column:
    return F.when(_filled(class_chain), "method").otherwise("function")


def html_role(tag) -> Column:
    return F.when(_col(tag) == "script", "script").otherwise("markup")


def content_hash(content="content") -> Column:
    return F.substring(F.sha2(_col(content), 256), 1, 16)


def signature(content="content") -> Column:
    return strip(F.regexp_extract(_col(content), FIRST_LINE, 0))


def _chain(class_chain) -> Column:
    return F.array_join(_col(class_chain), ".")


def _call_list(calls, limit) -> Column:
    return F.when(_filled(calls), F.array_join(F.slice(_col(calls), 1, limit), ", ")).otherwise("none")


def embed_text() -> Column:
    """Header, doc or first line, first calls; cut to EMBED_MAX_LEN characters."""
    place = F.when(_filled("class_chain"), _chain("class_chain")).otherwise(F.col("module"))
    header = F.concat(
        F.lit("["), "language", F.lit("] "), "role", F.lit(" `"), "symbol",
        F.lit("` in "), place, F.lit(" | path: "), "path",
    )
    about = F.when(_some("doc"), F.col("doc")).when(signature() != "", signature())
    calls = F.concat(F.lit("calls: "), _call_list("calls", EMBED_CALLS))
    return F.substring(F.concat_ws("\n", header, about, calls), 1, EMBED_MAX_LEN)


def search_text() -> Column:
    """Lexical text: labelled names, then the first content line if it has words."""
    return F.concat_ws(
        "\n",
        F.concat(F.lit("[namespace:"), "namespace", F.lit("]")),
        F.concat(F.lit("qualified_name:"), "qualified_name"),
        F.concat(F.lit("module:"), "module"),
        F.concat(F.lit("path:"), "path"),
        F.concat(F.lit("role:"), "role"),
        F.when(_some("package"), F.concat(F.lit("package:"), "package")),
        F.when(_filled("class_chain"), F.concat(F.lit("class:"), _chain("class_chain"))),
        F.when(signature() != "", signature()),
    )


def shown_refs(refs="refs") -> Column:
    """Refs without the keys that only say where they came from."""
    return F.map_filter(_col(refs), lambda k, v: ~k.isin(HIDDEN_REFS))


def func_text(base="embed_text", refs="refs") -> Column:
    """Base text plus one line per ref, in map order; the base is already cut."""
    lines = F.transform(
        F.map_entries(shown_refs(refs)),
        lambda e: F.concat(F.lit("ref: "), e["key"], F.lit(" | "), e["value"]),
    )
    return F.concat_ws("\n", _col(base), lines)


def call_text() -> Column:
    place = F.when(
        _filled("class_chain"), F.concat(F.lit("in "), _chain("class_chain"))
    ).otherwise(F.concat(F.lit("module "), "module"))
    return F.concat(
        F.lit("caller `"), "symbol", F.lit("` ("), "qualified_name", F.lit(") "), place,
        F.lit(" | calls: "), _call_list("calls", LANE_CALLS),
    )


def class_text(refs="refs") -> Column:
    place = F.when(
        _filled("class_chain"), F.concat(F.lit("class: "), _chain("class_chain"))
    ).otherwise(F.concat(F.lit("module: "), "module"))
    lines = F.transform(
        F.map_entries(F.map_filter(_col(refs), lambda k, v: k.isin(CLASS_REFS))),
        lambda e: F.concat(e["key"], F.lit(": "), e["value"]),
    )
    return F.concat_ws("\n", place, lines)


def lane_texts(refs="refs") -> dict:
    return {
        "embed_func_text": func_text(refs=refs),
        "embed_call_text": call_text(),
        "embed_class_text": class_text(refs=refs),
    }


def snippet(content="content", lines: int = SNIPPET_LINES) -> Column:
    parts = F.split(_col(content), LINE_END, lines + 1)
    ended = (F.size(parts) <= lines) & (F.element_at(parts, -1) == "")
    taken = F.least(F.size(parts) - F.when(ended, 1).otherwise(0), F.lit(lines))
    return F.array_join(F.slice(parts, F.lit(1), taken), "\n")


def _head(rank_prefix) -> Column:
    return F.concat(
        *rank_prefix, F.col("qualified_name"), F.lit("  score="),
        F.format_string("%.4f", F.col("score")),
    )


def _place(indent: str) -> Column:
    return F.concat(
        F.lit(f"{indent}path: "), "path", F.lit("  role: "), "role",
        F.lit("  ns: "), F.coalesce("namespace", F.lit("")),
    )


def hit_block() -> Column:
    """One ranked hit as text; needs `rank` and `score`."""
    prefix = (F.col("rank").cast("string"), F.lit(". "))
    return F.concat_ws("\n", _head(prefix), _place("   "), snippet())


def context_head() -> Column:
    """The lines of a hit that its neighbours follow."""
    prefix = (F.col("rank").cast("string"), F.lit(". "))
    return F.concat_ws("\n", _head(prefix), _place(""), snippet())


def context_block(callees="callees", callers="callers", n_callees=None, n_callers=None) -> Column:
    """A hit with its neighbours; an empty section leaves no line."""

    def section(nodes, count, title, arrow):
        nodes = _col(nodes)
        count = F.size(nodes) if count is None else _col(count)
        head = F.concat(F.lit(f"{title} ("), count.cast("string"), F.lit("):"))
        rows = F.transform(nodes, lambda n: F.concat(F.lit(f"  {arrow} "), n["qualified_name"]))
        return F.when(F.size(nodes) > 0, F.concat_ws("\n", head, rows))

    return F.concat_ws(
        "\n", context_head(),
        section(callees, n_callees, "callees", "->"),
        section(callers, n_callers, "callers", "<-"),
    )
