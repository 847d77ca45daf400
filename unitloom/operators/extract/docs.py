"""Documentation text of a unit, by language."""

from pyspark.sql import Column, functions as F

from unitloom.functions.texts import strip
from unitloom.operators.extract.common import _col, at, let

RUST_DOC = r"[ \t]*+//[/!][^\n]*+"
_BLANKS = " \t\x0b\f\r"


def _unless(*starts):
    """Test of a line: neither blank nor, behind blanks, one of `starts`. Such lines end a walk upwards."""

    def wanted(line):
        text = F.ltrim(line, F.lit(_BLANKS))
        found = text != ""
        for start in starts:
            found = found & ~text.startswith(start)
        return found

    return wanted


RUST_OTHER = _unless("#[", "///", "//!")
SLASH_OTHER = _unless("//")
NOT_BLANK = _unless()


def JSDOC_OPEN(line):
    return line.contains("/**")


_DOCSTRING = (
    r"^(?:[ \t]*+(?:#[^\n]*+)?\n)*+[ \t]*+[rRuU]?("
    r'"""(?:[^"\\]++|\\(?s:.)|"(?!""))*+"""'
    r"|'''(?:[^'\\]++|\\(?s:.)|'(?!''))*+'''"
    r'|"(?:[^"\\\n]++|\\(?s:.))*+"'
    r"|'(?:[^'\\\n]++|\\(?s:.))*+')"
    r"[ \t]*+(?:[;#\n]|\z)"
)


def _indent(line) -> Column:
    return F.length(line) - F.length(F.ltrim(line))


def clean_docstring(text) -> Column:
    """Common indentation and outer empty lines removed."""

    def unindent(lines):
        rest = F.slice(lines, F.lit(2), F.size(lines))
        indents = F.transform(F.filter(rest, lambda l: F.ltrim(l) != ""), _indent)
        first = F.ltrim(F.get(lines, F.lit(0)))

        def cut(margin):
            body = F.transform(rest, lambda l: F.substring(l, margin + 1, F.length(l)))
            return F.array_join(F.concat(F.array(first), body), "\n")

        return let(F.coalesce(F.array_min(indents), F.lit(0)), cut)

    def trim(t):
        return F.when(t.startswith("\n") | t.endswith("\n"), F.regexp_replace(t, r"\A\n+|\n+\z", "")).otherwise(t)

    return let(let(F.split(_col(text), "\n"), unindent), trim)


def python_doc(body) -> Column:
    """Docstring that opens a body (the text below the header line), else empty."""

    def unquote(text):
        wide = text.startswith('"""') | text.startswith("'''")
        edge = F.when(wide, 3).otherwise(1)
        return F.substring(text, edge + 1, F.length(text) - 2 * edge)

    literal = F.regexp_extract(_col(body), _DOCSTRING, 1)
    return let(literal, lambda t: F.when(t == "", "").otherwise(clean_docstring(unquote(t))))


def _between(lines, above, below) -> Column:
    """Lines strictly between two line numbers."""
    return F.slice(_col(lines), above + 1, F.greatest(below - above - 1, F.lit(0)))


def rust_doc(lines, other, start) -> Column:
    """`///` and `//!` lines above, over blank and attribute lines.

    `other`: per line the nearest line at or above that is none of these.
    """
    above = F.coalesce(at(other, start - 1), F.lit(0))
    found = F.filter(_between(lines, above, start), lambda l: strip(l).rlike("^//[/!]"))
    return F.array_join(F.transform(found, lambda l: F.regexp_replace(strip(l), r"^[/!]+\s?", "")), "\n")


def js_doc(lines, not_blank, opening, other, start) -> Column:
    """`/** */` block right above (blank lines allowed), else the run of `//` lines.

    `not_blank`, `opening`, `other`: per line the nearest line at or above that is not
    blank, opens a doc block, or is neither blank nor a `//` line.
    """
    lines = _col(lines)
    last = F.coalesce(at(not_blank, start - 1), F.lit(0))
    first = F.coalesce(at(opening, last), F.lit(0))
    closed = strip(at(lines, last)).endswith("*/")
    block = F.array_join(F.slice(lines, first, last - first + 1), "\n")
    inner = F.regexp_replace(F.regexp_replace(block, r"\A/\*\*?", ""), r"\*/\s*$", "")
    # All lines at once; a last line separator other than \n stays, as `$` leaves it.
    rows = F.regexp_replace(inner, r"(?md)^[ \t\x0b\f\r]*+\*[ \t\x0b\f\r]?+", "")
    rows = F.regexp_replace(rows, r"[ \t\x0b\f\r]++(?=[\u0085\u2028\u2029]?+(?:\n|\z))", "")
    above = F.coalesce(at(other, start - 1), F.lit(0))
    slashes = F.filter(_between(lines, above, start), lambda l: strip(l).startswith("//"))
    run = F.array_join(F.transform(slashes, lambda l: strip(F.substring(strip(l), 3, F.length(l)))), "\n")
    return (
        F.when(last == 0, F.lit(""))
        .when((first > 0) & closed, strip(rows))
        .otherwise(run)
    )
