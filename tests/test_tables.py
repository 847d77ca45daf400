import json

import pytest
from pyspark.sql import functions as F

from unitloom.functions.paths import module_name, namespace_class, package_name
from unitloom.operators import graph, maintain
from unitloom.plans.load import load, prepare_units
from unitloom.sources import jsonl
from unitloom.sources.tables import CodeTables
from unitloom.streaming.ingest import stream_repository


def chunk(path, name, content, calls=(), **more):
    row = dict(
        qualified_name=name, module="m", language="python", role="function", symbol=name.split(".")[-1],
        class_chain=[], path=path, start_line=1, end_line=1, content=content, calls=list(calls), namespace="code",
    )
    return {**row, **more}


def write(folder, rows, refs=None):
    folder.mkdir(parents=True, exist_ok=True)
    (folder / "chunks.jsonl").write_text("\n\n".join(json.dumps(r) for r in rows) + "\n")
    if refs is not None:
        (folder / "refs.jsonl").write_text("\n".join(json.dumps(r) for r in refs))


def state(store):
    units = {r.id: (r.content, r.job_id) for r in store.units().collect()}
    edges = {(r.caller_id, r.callee_qname) for r in store.edges().collect()}
    return units, edges


def test_load_twice_and_last_wins(spark, tmp_path):
    rows = [chunk("a.py", "m.f", "old", ["x", "", "x"]), chunk("a.py", "m.f", "new", ["y"]), chunk("b.py", "m.g", "g", ["f"])]
    write(tmp_path / "one", rows)
    root = str(tmp_path / "t")
    first = load(spark, str(tmp_path / "one"), root, job_id="j1", buckets=4)
    assert (first["n_units"], first["n_edges"]) == (3, 4)
    store = CodeTables(spark, root, 4)
    want = ({"a.py::m.f": ("new", "j1"), "b.py::m.g": ("g", "j1")}, {("a.py::m.f", "x"), ("a.py::m.f", "y"), ("b.py::m.g", "f")})
    assert state(store) == want
    load(spark, str(tmp_path / "one"), root, job_id="j1", buckets=4)
    assert state(store) == want
    # A second batch replaces the edges of its callers and leaves the rest alone.
    write(tmp_path / "two", [chunk("a.py", "m.f", "newer", ["z"])])
    load(spark, str(tmp_path / "two"), root, job_id="j2", buckets=4)
    assert state(store) == (
        {"a.py::m.f": ("newer", "j2"), "b.py::m.g": ("g", "j1")}, {("a.py::m.f", "z"), ("b.py::m.g", "f")}
    )
    store.prune_missing(spark.createDataFrame([("b.py::m.g",)], "id string"))
    assert state(store) == ({"b.py::m.g": ("g", "j1")}, {("b.py::m.g", "f")})


def test_a_version_is_published_once(spark, tmp_path):
    store = CodeTables(spark, str(tmp_path / "t"), 4)
    store._publish({"version": 1, "units": {}, "edges": {}})
    with pytest.raises(RuntimeError):
        store._publish({"version": 1, "units": {}, "edges": {}})


def test_chunk_reader_defaults_and_required_keys(spark, tmp_path):
    row = chunk("a.py", "m.f", "c")
    for key in ("class_chain", "calls"):
        row.pop(key)
    write(tmp_path / "ok", [row])
    got = jsonl.read_chunks(spark, str(tmp_path / "ok/chunks.jsonl")).first()
    assert (got.class_chain, got.calls, got.doc, got.search_text, got.package) == ([], [], "", "", None)
    bad = chunk("a.py", "m.f", "c")
    bad.pop("namespace")
    write(tmp_path / "bad", [bad])
    with pytest.raises(Exception, match="namespace"):
        jsonl.read_chunks(spark, str(tmp_path / "bad/chunks.jsonl")).collect()


def test_refs_reader(spark, tmp_path):
    assert jsonl.read_refs(spark, str(tmp_path / "none.jsonl")).count() == 0
    ref = lambda mro: dict(unit_id="u", qualified_name="q", path="p", language="python", refs={"mro": mro})
    write(tmp_path, [], [ref("first"), ref("second")])
    rows = jsonl.read_refs(spark, str(tmp_path / "refs.jsonl")).collect()
    assert [r.refs for r in rows] == [{"mro": "second"}]


def test_refs_enter_the_function_lane_once(spark, tmp_path):
    """The base text of a chunk file already holds the ref lines."""
    ref = dict(unit_id="a.py::m.f", qualified_name="m.f", path="a.py", language="python", refs={"mro": "A", "metaclass": "type", "mro_source": "static"})
    write(tmp_path, [chunk("a.py", "m.f", "c", embed_text="base\nref: mro | A")], [ref])
    chunks = jsonl.read_chunks(spark, str(tmp_path / "chunks.jsonl"))
    refs = jsonl.read_refs(spark, str(tmp_path / "refs.jsonl"))
    row = prepare_units(chunks, refs, refs_in_base=True, dim=8).first()
    assert row.embed_func_text == "base\nref: mro | A"
    assert row.embed_class_text == "module: m\nmro: A\nmetaclass: type"


def test_stream_equals_batch(spark, tmp_path, corpus):
    import shutil

    inbox = tmp_path / "in"
    inbox.mkdir()
    context = {"languages": ["python", "html", "javascript"]}
    for files in (["shapes.py"], ["page.html"]):
        for name in files:
            shutil.copy(f"{corpus}/{name}", inbox / name)
        stream_repository(spark, str(inbox), str(tmp_path / "t"), str(tmp_path / "c"), buckets=4, context=context, dim=8).awaitTermination()
    from unitloom.plans.index import index_files
    from unitloom.sources.files import read_repository

    chunks, refs = index_files(read_repository(spark, str(inbox)), **context)
    CodeTables(spark, str(tmp_path / "b"), 4).upsert_batch(prepare_units(chunks, refs, refs_in_base=True, dim=8), job_id="x")
    pick = lambda root: sorted(
        (r.id, r.content_hash, r.embed_func_text, tuple(r.vec_func)) for r in CodeTables(spark, str(tmp_path / root), 4).units().collect()
    )
    assert pick("t") == pick("b") and len(pick("t")) > 8


UNITS = [("a::foo", "pkg.foo", "foo", "a"), ("b::bar", "pkg.bar", "bar", "b"), ("c::baz", "pkg.baz", "baz", "c"), ("m::main", "pkg.main", "main", "m"), ("r::run", "pkg.run", "run", "r")]
EDGES = [("a::foo", "pkg.baz", "baz"), ("b::bar", "pkg.external", "external"), ("m::main", "pkg.foo", "foo"), ("r::run", "pkg.bar", "bar"), ("c::baz", "pkg.foo", "foo")]


@pytest.fixture
def call_graph(spark):
    return (
        spark.createDataFrame(UNITS, "id string, qualified_name string, symbol string, path string"),
        spark.createDataFrame(EDGES, "caller_id string, callee_qname string, callee_raw string"),
    )


def test_depth_one_neighbours(call_graph):
    units, edges = call_graph
    hits = units.filter("id in ('a::foo', 'b::bar')").select("id", "qualified_name")
    rows = {r.id: r for r in graph.with_context(hits, units, edges, depth=1).collect()}
    assert [(n.qualified_name, n.unit_id) for n in rows["a::foo"].callees] == [("pkg.baz", "c::baz")]
    assert [(n.qualified_name, n.unit_id, n.callee_raw) for n in rows["b::bar"].callees] == [("pkg.external", None, "external")]
    assert [n.qualified_name for n in rows["a::foo"].callers] == ["pkg.baz", "pkg.main"]
    assert [n.qualified_name for n in rows["b::bar"].callers] == ["pkg.run"]
    none = graph.with_context(hits, units, edges, depth=0).collect()
    assert all(r.callees == [] and r.callers == [] for r in none)


def test_deeper_levels_contain_shallower_ones(call_graph):
    units, edges = call_graph
    hits = units.select(F.col("id").alias("hit_id"), F.col("id").alias("key"))
    sets = [
        {(r.hit_id, r.qualified_name, r.depth) for r in graph.expand(hits, edges, units, side="callees", depth=d).collect()}
        for d in (0, 1, 2, 4)
    ]
    assert sets[0] == set() and sets[0] < sets[1] < sets[2] <= sets[3]
    # A cycle brings the hit itself back, once.
    assert ("a::foo", "pkg.foo", 2) in sets[2]


def test_pages_hold_every_neighbour_of_a_hub(spark):
    nodes = spark.range(2500).selectExpr(
        "'hub' hit_id", "concat('n', id) qualified_name", "'p' path", "concat('u', id) unit_id", "cast(null as string) callee_raw", "1 depth"
    )
    pages = graph.neighbour_pages(nodes, page_rows=100).collect()
    assert len(pages) == 25 and {p.n for p in pages} == {2500}
    assert len({n.unit_id for p in pages for n in p.nodes}) == 2500
    assert max(len(p.nodes) for p in pages) < 250


def test_insert_ignore_keeps_the_first(spark):
    e = spark.createDataFrame([("a", "x", "late", 2), ("a", "x", "early", 1)], "caller_id string, callee_qname string, callee_raw string, seq int")
    assert [tuple(r) for r in maintain.insert_ignore(e, "seq").collect()] == [("a", "x", "early")]


def test_path_names(spark):
    df = spark.createDataFrame([("pkg/sub/__init__.py",), ("pkg/brokers/redis.py",), ("__init__.py",), ("docs/a.py",)], "path string")
    null = F.lit(None).cast("string")
    got = [tuple(r) for r in df.select(module_name(null, "path"), module_name(F.lit("pkg"), "path"), namespace_class("path", null)).collect()]
    assert got == [
        ("pkg.sub", "pkg.sub", "code"), ("pkg.brokers.redis", "pkg.brokers.redis", "code"),
        ("module", "pkg", "code"), ("docs.a", "pkg.docs.a", "docs"),
    ]
    site = df.limit(1).select(package_name(F.lit("my_pkg-1.0/x.py"), below_site_packages="")).first()[0]
    assert site == "my_pkg"


def test_search_over_tables_reads_only_winning_folders(spark, tmp_path):
    from unitloom.plans.search import one_query, search

    rows = [chunk(f"p{i}.py", f"m.f{i}", f"body {i}", search_text=f"name f{i}", embed_text=f"def f{i}") for i in range(60)]
    write(tmp_path / "in", rows)
    root = str(tmp_path / "t")
    load(spark, str(tmp_path / "in"), root, job_id="j", buckets=8, dim=16)
    units = CodeTables(spark, root, 8).units()
    q = one_query(spark, "def f7 name")
    plain = search(units, q, k=3, dim=16)
    pruned = search(units, q, k=3, dim=16, buckets=8)
    pick = lambda d: sorted((r.rank, r.id, r.content, r.score) for r in d.collect())
    assert pick(pruned) == pick(plain) and len(pick(plain)) == 3
    assert "dynamicpruning" in pruned._jdf.queryExecution().executedPlan().toString()


def test_only_local_mode_goes_without_a_shared_folder(spark):
    from unitloom.session import shared_folder

    class Cluster:
        conf = type("Conf", (), {"get": staticmethod(lambda *a: None)})
        sparkContext = type("Context", (), {"master": "spark://host:7077", "getCheckpointDir": staticmethod(lambda: None)})

    with pytest.raises(ValueError):
        shared_folder(Cluster())
    assert shared_folder(spark)


def test_second_writer_of_a_version_fails_and_half_a_snapshot_is_skipped(spark, tmp_path):
    from unitloom.sources.tables import CodeTables

    tables = CodeTables(spark, str(tmp_path / "t"))
    tables._publish({"version": 1, "buckets": 64, "units": {}, "edges": {}})
    with pytest.raises(RuntimeError):
        tables._publish({"version": 1, "buckets": 64, "units": {"3": "x"}, "edges": {}})
    (tmp_path / "t/_snapshots/2.json").write_text('{"version": 2, "buck')
    assert tables.snapshot()["version"] == 1


def test_numbers_in_file_names_order_as_numbers(spark, tmp_path):
    from pyspark.sql import functions as F
    from unitloom.sources.jsonl import with_file_order

    names = ["part-100000.json", "part-99999.json", "part-7.json"]
    df = spark.createDataFrame([(n, 0) for n in names], "file string, block long")
    rows = with_file_order(df.withColumn("name", F.col("file"))).orderBy("seq.file").collect()
    assert [r.name for r in rows] == ["part-7.json", "part-99999.json", "part-100000.json"]


def test_package_facts_of_a_root(spark, tmp_path):
    from unitloom.plans.index import index_repository
    from unitloom.sources.files import root_context
    from unitloom.sources.jsonl import read_chunks

    site = tmp_path / "lib" / "site-packages"
    (site / "tool-1.0").mkdir(parents=True)
    (site / "app" / "sub").mkdir(parents=True)
    for file in ("app/__init__.py", "app/c.py", "app/sub/a.py", "tool-1.0/b.py"):
        (site / file).write_text("def f():\n    pass\n")
    (tmp_path / "own").mkdir()
    for file in ("__init__.py", "g.py"):
        (tmp_path / "own" / file).write_text("def g():\n    pass\n")
    assert root_context(spark, str(site / "app")) == {"root_name": "app", "root_is_package": True, "below_site_packages": "app"}
    assert root_context(spark, str(tmp_path / "own"))["below_site_packages"] is None

    counts = index_repository(spark, str(site), str(tmp_path / "out"), languages=["python"])
    # The scan reads files whose names start with `_` too.
    assert counts == {"n_units": 4, "n_refs": 0}
    rows = {r.path: (r.package, r.namespace) for r in read_chunks(spark, str(tmp_path / "out/chunks.jsonl")).collect()}
    assert rows == {"app/__init__.py": ("app", "pip"), "app/c.py": ("app", "pip"), "app/sub/a.py": ("app", "pip"), "tool-1.0/b.py": ("tool", "pip")}
    index_repository(spark, str(tmp_path / "own"), str(tmp_path / "out2"), languages=["python"])
    assert read_chunks(spark, str(tmp_path / "out2/chunks.jsonl")).first().package == "own"
