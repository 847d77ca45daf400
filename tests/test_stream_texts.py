"""The query of the chunk stream: texts of arriving chunks reach the lanes and vectors of the table."""

import checks.all  # noqa: F401
from checks.compare import compare, duck
from checks.registry import QUERIES


def tables(spark, folder):
    docs = [(0, "one, two, three\nmore", "en", "web"), (1, "vier, fünf", "de", "book"), (2, "", "en", "web"), (3, "six seven", "en", "book")]
    frames = {
        "documents": (docs, "doc_id long, text string, lang string, source string"),
        "labels": ([(0, 1, 0), (3, 0, 0)], "doc_id long, quality int, toxic int"),
        "benchmark": ([(0, " first line \nsecond"), (1, "")], "item_id long, text string"),
    }
    for name, (rows, schema) in frames.items():
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(f"{folder}/{name}.parquet")
    return str(folder)


def test_arriving_texts_are_embedded(spark, tmp_path):
    rows = {r.id: r for r in QUERIES["inc_2_streaming_ingest"](spark, tables(spark, tmp_path)).collect()}
    assert len(rows) == 6
    new = rows["new/b0.py::new.b0"]
    assert new.embed_func_text == "[python] function `b0` in new | path: new/b0.py\nfirst line\ncalls: b0" and new.n_func > 5
    changed = rows["src/book/en/d3.py::src.book.en.d3.Cbook.d3"]
    assert changed.job == "stream-1" and "six seven" in changed.embed_func_text and "ref: mro | Base, Cbook, object" in changed.embed_func_text
    assert all(r.n_func > 0 for r in rows.values())


def test_equal_to_sql(spark, tmp_path):
    folder = tables(spark, tmp_path)
    text, _, _ = compare(spark, duck(folder), "inc_2_streaming_ingest", folder)
    assert text.startswith("ok"), text
