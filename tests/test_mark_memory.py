"""Marking passes a long literal or comment at once, and texts are filled without further passes."""

import tracemalloc

import pytest
from pyspark.sql import functions as F

from checks import extraction
from unitloom.functions import marking, texts
from unitloom.operators.extract import docs

BODY = "some words of a text, * and more\n" * 30_000
LONG = {
    "blank_python": ['"""' + BODY + '"""', "'''" + BODY + "'''", '"""' + BODY],
    "mark_script": ["/* " + BODY + "*/", '"' + BODY.replace("\n", " ") + '"', "`" + BODY + "`"],
    "mark_typed": ["f<" + " " * len(BODY) + "A>(x)", "f<'" + BODY.replace("\n", " ") + "'>(x)"],
    "mark_rust": ["/* " + BODY + "*/", '"' + BODY + '"'],
}


@pytest.mark.parametrize("name", LONG)
def test_a_long_literal_needs_little_memory(name):
    for text in LONG[name]:
        tracemalloc.start()
        getattr(marking, name)(text)
        peak = tracemalloc.get_traced_memory()[1]
        tracemalloc.stop()
        assert peak < 12 * len(text), f"{peak / len(text):.1f} bytes for each character"


def test_literals_end_where_they_did():
    assert marking.blank_python('f("""a\\"""b""" + "c")') == 'f("" + "")'
    assert marking.blank_python('x = "a\\') == 'x = ""\\'
    assert marking.mark_rust("a /* * / ** // */ b /* c").startswith("a  b ")


def test_files_fill_marks_inside_values(spark, tmp_path):
    folder = f"{tmp_path}/t"
    rows = [
        (1, " a {lang} {id}\n\n  {source} {T}\\ ", "en{id}", "web{lang}"), (2, "plain", "de", "news"), (3, None, "de", "news"),
        (4, "x", None, "news"), (5, "x", "de", None), (None, "x", "de", "news"), (7, "", "de", "news"),
    ]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").write.parquet(f"{folder}/documents.parquet")
    for kind, (template, _, margin) in extraction.FILES.items():
        escape = extraction.ESCAPES[kind][0]
        t = F.replace(escape(extraction.trimmed("text")), F.lit("\n"), F.lit("\n" + margin))
        want = F.lit(template)
        for mark, value in {"{T}": t, "{id}": F.col("doc_id").cast("string"), "{source}": F.col("source"), "{lang}": F.col("lang")}.items():
            want = F.replace(want, F.lit(mark), value)
        doc = spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", want.alias("text"))
        found = extraction.files(spark, folder, kind).select("doc_id", "text")
        key = lambda r: (r[0] is None, r[0] or 0)
        assert sorted(map(tuple, found.collect()), key=key) == sorted(map(tuple, doc.collect()), key=key)


def test_strip_and_docs_keep_their_edges(spark):
    values = ["", " ", "a", " a", "a ", " a b\x1c", "a\u0085", " é　", "\n\na\n b\n\n", "a\n", None, "\r\n", "😀 ", " 😀"]
    df = spark.createDataFrame([(v,) for v in values], "t string")
    want = F.regexp_replace("t", texts.EDGE_BLANKS, "")
    for got, wanted in df.select(texts.strip("t"), want).collect():
        assert got == wanted
    cleaned = df.select(docs.clean_docstring("t")).collect()
    assert [r[0] for r in cleaned][8] == "a\n b"
