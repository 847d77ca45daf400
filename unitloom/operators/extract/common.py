"""Pattern pieces and line bookkeeping shared by the languages."""

import re
from itertools import count

import pyarrow as pa
from pyspark.sql import Column, functions as F, types as T

from unitloom.functions import marking, shipping  # noqa: F401

ID = r"[\p{L}_$][\p{L}\p{N}_$]*+"
ANONYMOUS = "<anonymous>"

# Marks of marked text, see functions/marking.py.
MARK = r"\x01[^\x02]*+\x02"
GAP = rf"(?:[\s\x04-\x07]|{MARK})*+"
SPACE = rf"(?:[\s\x04-\x07]|{MARK})++"


def _col(c):
    return F.col(c) if isinstance(c, str) else c


def let(value, body) -> Column:
    """`body(x)` with x bound to a value computed once.

    The optimizer may inline a column into a lambda that uses it, where it would run
    once per element; what a lambda needs from outside is therefore bound here.
    """
    return F.get(F.transform(F.array(value), body), F.lit(0))


# Text from a bracket of marked text to its partner, at any depth; `compiled` spells them out.
PARENS, BRACKETS, BRACES = "\ue001", "\ue002", "\ue003"
_PAIRS = {PARENS: "()", BRACKETS: "[]", BRACES: "{}"}


def compiled(pattern: str) -> str:
    """Bracket pieces as an open bracket, anything, and the bracket with the same pair number."""
    numbers = count()

    def spell(piece):
        (opening, closing), name = _PAIRS[piece[0]], f"pair{next(numbers)}"
        place = r"\x01\d++\.\d++\."
        return rf"(?>\{opening}{place}(?<{name}>\d++)\x02(?s:.*?)\{closing}{place}\k<{name}>\x02)"

    return re.sub(f"[{PARENS}{BRACKETS}{BRACES}]", spell, pattern)


def pieces_in(pattern: str) -> int:
    """Groups that `compiled` adds to a pattern."""
    return sum(pattern.count(p) for p in _PAIRS)


def marker(mark):
    """Column function that applies a text function of `marking` in Arrow batches; NULL stays NULL."""

    @F.arrow_udf(T.StringType())
    def marked(column: pa.Array) -> pa.Array:
        return pa.array([None if t is None else mark(t) for t in column.to_pylist()], pa.string())

    return marked


def all_matches(text, pattern: str, group: int = 0) -> Column:
    return F.regexp_extract_all(_col(text), F.lit(compiled(pattern)), F.lit(group))


def first_match(text, pattern: str, group: int = 0) -> Column:
    return F.regexp_extract(_col(text), compiled(pattern), group)


def newlines(text) -> Column:
    text = _col(text)
    return F.length(text) - F.length(F.replace(text, F.lit("\n"), F.lit("")))


def number_lines(text) -> Column:
    """"<n>\\t" before every line."""
    lines = F.split(_col(text), "\n")
    return F.array_join(
        F.transform(lines, lambda line, i: F.concat((i + 1).cast("string"), F.lit("\t"), line)), "\n"
    )


def unmark(text) -> Column:
    return F.regexp_replace(_col(text), rf"{MARK}|[\x04-\x07]", "")


# Runs from the end of a match to the next mark: with it every capture holds a mark.
TO_MARK = r"[^\x01]*+\x01[^\x02]*+\x02"


def placed(captures, pattern: str) -> Column:
    """Blocks with start and end as (line, column), and their text with and without marks.

    A capture is a block of `pattern` and what follows up to the next mark. The first mark behind
    the block's start is on its line and tells the column.
    """

    def place(capture):
        before = F.regexp_extract(capture, r"^[^\x01]*+", 0)
        marked = first_match(capture, rf"\A(?:{pattern})", 0)
        found = F.struct(
            F.regexp_extract(capture, r"^[^\x01]*+\x01(\d+)", 1).cast("int").alias("line"),
            (F.regexp_extract(capture, r"^[^\x01]*+\x01\d++\.(\d+)", 1).cast("int") - F.length(unmark(before)) + 1).alias("col"),
            marked.alias("marked"), unmark(marked).alias("block"),
        )
        return let(found, span)

    def span(f):
        more = newlines(f["block"])
        tail = F.length(F.substring_index(f["block"], "\n", -1))
        return F.struct(
            F.struct(f["line"].alias("line"), f["col"].alias("col")).alias("start"),
            F.struct(
                (f["line"] + more).alias("line"),
                F.when(more == 0, f["col"] + tail).otherwise(tail).alias("col"),
            ).alias("end"),
            f["block"].alias("block"), f["marked"].alias("marked"),
        )

    return F.transform(captures, place)


def last_line_like(text, wanted) -> Column:
    """Per line of `text`, the number of the nearest line at or above for which `wanted` holds (0: none)."""

    def owners(lines):
        found = F.filter(F.transform(lines, lambda l, i: F.when(wanted(l), i + 1)), lambda n: n.isNotNull())
        return let(F.struct(found.alias("found"), (F.size(lines) + 1).alias("end")), fill)

    def fill(f):
        found, end = f["found"], f["end"]
        following = F.slice(F.concat(found, F.array(end)), F.lit(2), F.size(found))
        owned = F.flatten(F.zip_with(found, following, lambda n, after: F.array_repeat(n, after - n)))
        return F.concat(F.array_repeat(F.lit(0), F.coalesce(F.get(found, F.lit(0)), end) - 1), owned)

    return let(F.split(_col(text), "\n"), owners)


def at(array, index) -> Column:
    """1-based element or NULL."""
    return F.get(_col(array), index - 1)


def distinct_calls(text, pattern: str) -> Column:
    """First-occurrence order."""
    return F.array_distinct(all_matches(text, pattern, 1))
