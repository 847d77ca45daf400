"""Line lookups and type aliases of the extractors without a pattern for every line."""

import random
import re

from pyspark.sql import functions as F

from unitloom.operators.extract import brace_units, docs
from unitloom.operators.extract.common import last_line_like
from unitloom.sources.files import source_lines

# What ends a walk upwards, as patterns for one line.
LINES = {
    "NOT_BLANK": r"(?![ \t\x0b\f\r]*$)",
    "SLASH_OTHER": r"(?![ \t\x0b\f\r]*(?://|$))",
    "RUST_OTHER": r"(?![ \t\x0b\f\r]*(?:#\[|//[/!]|$))",
    "JSDOC_OPEN": r"(?=.*?/\*\*)",
}
PIECES = ["", " ", "\t", "\x0b\f\r ", "//", "///", "//!", "#[", "/**", "x /** y", "a", " ", " //", " \t// b", "\r", "é"]


def _texts():
    rnd = random.Random(5)
    return ["", "\n", "a", "\n\n a\n"] + ["\n".join("".join(rnd.choices(PIECES, k=rnd.randrange(3))) for _ in range(rnd.randrange(9))) for _ in range(150)]


def test_nearest_line_equals_a_walk_upwards(spark):
    texts = _texts()
    df = spark.createDataFrame([*enumerate(texts), (len(texts), None)], "i int, text string")
    got = df.select("i", *[last_line_like("text", getattr(docs, n)).alias(n) for n in LINES]).orderBy("i").collect()
    assert all(got[-1][n] is None for n in LINES)
    for text, row in zip(texts, got):
        for name, pattern in LINES.items():
            last, want = 0, []
            for n, line in enumerate(text.split("\n"), 1):
                last = n if re.match(pattern, line, re.S) else last
                want.append(last)
            assert row[name] == want, (name, text)


def test_source_lines_with_any_line_break(spark):
    texts = _texts() + ["a\r\nb\r\n", "a\r", "a\n\r\n", "\r\n", "a\n\n", "é\n"]
    df = spark.createDataFrame([*enumerate(texts), (len(texts), None)], "i int, text string")
    old = F.split(F.regexp_replace("text", r"\r?\n\z", ""), r"\r?\n")
    rows = df.select(source_lines("text").alias("got"), old.alias("want")).collect()
    assert len(rows) == len(texts) + 1 and all(r.got == r.want for r in rows)


def test_type_aliases_and_interfaces_leave_their_line_ends(spark):
    texts = {
        "interface A {\n f(): B;\n}interface B { }\nrun(1)": "\n\n\nrun(1)",
        "type A = {\n b: () => C\n};\nlet $type = 1": "\n\n;\nlet $type = 1",
        "$interface X { a }": "$interface X { a }",
        "mytype A = 3;type B = 4": "mytype A = 3;",
    }
    df = spark.createDataFrame([(i, t) for i, t in enumerate([*texts, None])], "i int, text string")
    marked = df.select("i", brace_units.mark_script("text").alias("m"))
    plan = marked.select("i", brace_units.unmark(brace_units._strip_types("m")).alias("t"))
    assert [r.t for r in plan.orderBy("i").collect()] == [t + "\n" for t in texts.values()] + [None]


def test_comment_lines_lose_star_and_edge_blanks(spark):
    rnd = random.Random(6)
    pieces = [" ", "\t", "*", "* ", "a", " ", "\u0085", "\r", "\x0b", "/", " ", " *  b "]
    blocks = ["/**" + "\n".join("".join(rnd.choices(pieces, k=rnd.randrange(6))) for _ in range(rnd.randrange(1, 6))) + "*/" for _ in range(200)]
    df = spark.createDataFrame([(i, b.split("\n") + ["f()"]) for i, b in enumerate(blocks)], "i int, lines array<string>")
    n = F.size("lines")
    last, first = F.sequence(F.lit(1), n), F.array_repeat(F.lit(1), n)
    inner = F.regexp_replace(F.regexp_replace(F.array_join(F.slice("lines", F.lit(1), n - 1), "\n"), r"\A/\*\*?", ""), r"\*/\s*$", "")
    rows = F.transform(F.split(inner, "\n"), lambda l: F.regexp_replace(F.regexp_replace(l, r"^\s*\*\s?", ""), r"\s+$", ""))
    got = df.select(docs.js_doc("lines", last, first, last, n).alias("got"), docs.strip(F.array_join(rows, "\n")).alias("want"))
    assert all(r.got == r.want for r in got.collect())
