"""Numbered rows, manifests and documents in lines against plain Python."""

import glob
import json

import pytest
from pyspark.sql import functions as F

from unitloom.operators import graph
from unitloom.operators.documents import manifest_lines, numbered, write_lines
from unitloom.plans import documents
from unitloom.plans.search import render_contexts


@pytest.fixture
def many_parts(spark):
    """Small inputs in many partitions, as large ones are."""
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "37")
    yield spark
    spark.conf.unset("spark.sql.adaptive.enabled")
    spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def by_hand(rows):
    held = {}
    out = []
    for g, o in sorted(rows, key=lambda r: (r[0] is not None, r[0] or "", r[1])):
        held[g] = held.get(g, 0) + 1
        out.append((g, o, held[g]))
    return sorted(out, key=str)


def test_groups_over_many_partitions_are_numbered_whole(many_parts):
    rows = [("hub", i) for i in range(3000)] + [(None, i) for i in range(700)]
    rows += [(f"g{i}", i) for i in range(50)] + [("z", i) for i in range(400)] + [("", 1)]
    df = many_parts.createDataFrame(rows, "g string, o int").repartition(5)
    out = numbered(df, ["g"], ["o"])
    spread = out.filter("g = 'hub'").select(F.spark_partition_id()).distinct().count()
    assert spread > 2
    assert sorted(((r.g, r.o, r.number) for r in out.collect()), key=str) == by_hand(rows)


def test_two_group_columns_ties_and_empty_tables(many_parts):
    rows = [(1, None, 5)] * 4 + [(1, "a", 5)] * 3 + [(2, "a", 1), (2, "a", 0)]
    df = many_parts.createDataFrame(rows, "a int, b string, o int")
    got = sorted(((r.a, r.b, r.o, r.number) for r in numbered(df, ["a", "b"], ["o"]).collect()), key=str)
    want = [(1, None, 5, i) for i in (1, 2, 3, 4)] + [(1, "a", 5, i) for i in (1, 2, 3)] + [(2, "a", 0, 1), (2, "a", 1, 2)]
    assert got == sorted(want, key=str)
    assert numbered(df.limit(0), ["a"], ["o"]).collect() == []
    with pytest.raises(ValueError):
        numbered(df.withColumn("number", F.lit(1)), ["a"], ["o"])


def test_no_task_holds_a_hub(many_parts):
    nodes = many_parts.range(20000).selectExpr("'hub' hit_id", "lpad(id, 9, '0') unit_id")
    out = numbered(nodes, ["hit_id"], ["unit_id"])
    sizes = [r["count"] for r in out.groupBy(F.spark_partition_id()).count().collect()]
    assert sum(sizes) == 20000 and max(sizes) < 8000
    assert out.filter("number != cast(unit_id as int) + 1").count() == 0


def test_pages_follow_each_other_in_order(many_parts):
    nodes = many_parts.range(2500).selectExpr(
        "'hub' hit_id", "lpad(id, 5, '0') qualified_name", "'p' path", "'u' unit_id", "cast(null as string) callee_raw", "1 depth"
    )
    pages = sorted(graph.neighbour_pages(nodes, page_rows=300).collect(), key=lambda p: p.page)
    assert [p.page for p in pages] == list(range(9)) and {p.n for p in pages} == {2500}
    assert [n.qualified_name for p in pages for n in p.nodes] == [f"{i:05d}" for i in range(2500)]


def read_text(folder):
    return "".join(open(f, encoding="utf-8").read() for f in sorted(glob.glob(f"{folder}/part-*")))


def test_manifest_text_is_one_json(many_parts, tmp_path):
    hashes = {f'dir/"f{i}"\n.py': f"h{i}" for i in range(900)}
    df = many_parts.createDataFrame([*hashes.items(), (None, "x")], "path string, content_hash string")
    write_lines(manifest_lines(df, 'job "1"'), str(tmp_path / "m"), ["number"])
    text = read_text(tmp_path / "m")
    assert json.loads(text) == {"job_id": 'job "1"', "files": hashes}
    assert list(json.loads(text)["files"]) == sorted(hashes)
    empty = manifest_lines(df.limit(0), "j").orderBy("number").collect()
    assert json.loads("".join(r.line for r in empty)) == {"job_id": "j", "files": {}}


@pytest.fixture
def searched(many_parts):
    """Two queries with hits, one of them a hub, and one without."""
    spark = many_parts
    units = spark.range(400).selectExpr("concat('p', id, '.py::m.f', id) id", "concat('m.f', id) qualified_name", "concat('p', id, '.py') path")
    calls = [(f"p{i}.py::m.f{i}", "m.f0", "f0") for i in range(1, 400)] + [("p0.py::m.f0", "m.f7", "f7"), ("p0.py::m.f0", "ext.g", 'g"')]
    edges = spark.createDataFrame(calls, "caller_id string, callee_qname string, callee_raw string")
    asked = spark.createDataFrame([(1, 'find "it"'), (2, "other"), (3, "none")], "query_id long, query string")
    hits = units.filter("id in ('p0.py::m.f0', 'p7.py::m.f7')").crossJoin(asked.filter("query_id < 3").select("query_id"))
    hits = hits.selectExpr(
        "query_id", "cast(if(path = 'p0.py', 1, 2) as int) rank", "id", "qualified_name", "path", "'function' role", "'code' namespace",
        "'def f():\\n  pass' content", "0.5D score", "0.1D d_func", "0.2D d_call", "0.3D d_class", "0D ts_score",
    )
    return hits, units, edges, asked


def test_lines_are_the_nested_documents(searched):
    hits, units, edges, asked = searched
    found = graph.neighbours(hits, units, edges, depth=2)
    nested = graph.nested_result(graph.with_context(hits, units, edges, depth=2), asked)
    want = {r.query_id: json.loads(r.result) for r in nested.collect()}
    rows = documents.json_lines(hits, found, asked).orderBy(*documents.PLACE, "number").collect()
    got = {q: json.loads("\n".join(r.line for r in rows if r.query_id == q)) for q in (1, 2, 3)}
    assert got == want and len(got[1]["hits"][0]["callers"]) >= 399 and got[3]["hits"] == []


def test_text_lines_are_the_rendered_text(searched, tmp_path):
    hits, units, edges, asked = searched
    found = graph.neighbours(hits, units, edges, depth=1)
    want = {r.query_id: r.text for r in render_contexts(graph.with_context(hits, units, edges, depth=1), asked).collect()}
    lines = documents.text_lines(hits, found, asked)
    write_lines(lines, str(tmp_path / "t"), ["rank", "kind", "number"], document="query_id")
    got = {q: read_text(tmp_path / "t" / f"query_id={q}").rstrip("\n") for q in (1, 2, 3)}
    assert got == want and want[3] == "no results"
