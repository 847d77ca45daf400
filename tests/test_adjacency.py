import contextlib
import io
import random

import pytest

from unitloom.operators import graph
from unitloom.operators.adjacency import Adjacency, write_adjacency

N = 3000


@pytest.fixture(scope="module")
def stored(spark, tmp_path_factory):
    """A random graph in which a third of all edges lead to one hub; some edges repeat or lack an end."""
    rng = random.Random(3)
    rows = [(f"p::u{i}", f"n{0 if rng.random() < 0.34 else rng.randrange(N)}", "raw") for i in range(N) for _ in range(4)]
    rows += rows[:50] + [(None, "n5", "raw"), ("p::u7", None, None)]
    edges = spark.createDataFrame(rows, "caller_id string, callee_qname string, callee_raw string")
    units = spark.range(N).selectExpr("concat('p::u', id) id", "concat('n', id) qualified_name", "concat('n', id) symbol", "'p' path")
    folder = str(tmp_path_factory.mktemp("adjacency") / "edges")
    return edges, units.cache(), write_adjacency(edges, folder, parts=32)


@pytest.mark.parametrize("side, key", [("callees", "p::u"), ("callers", "n")])
@pytest.mark.parametrize("hits", [10, 2000])
def test_neighbours_equal_those_of_the_edge_table(spark, stored, side, key, hits):
    edges, units, adjacency = stored
    start = spark.range(1, hits + 1).selectExpr("cast(id as string) hit_id", f"concat('{key}', id) key")
    depth = 2 if hits == 10 else 1
    got, want = (
        sorted(map(str, graph.expand(start, e, units, side=side, depth=depth).collect())) for e in (adjacency, edges)
    )
    assert got == want and len(got) > hits


def test_both_copies_hold_every_edge(stored):
    edges, _, adjacency = stored
    want = sorted(map(str, edges.collect()))
    for key in ("caller_id", "callee_qname"):
        assert sorted(map(str, adjacency.copy(key).drop("part").collect())) == want


@pytest.mark.parametrize("key, name", [("caller_id", "p::u"), ("callee_qname", "n")])
def test_ten_keys_read_few_files(spark, stored, key, name):
    _, _, adjacency = stored
    keys = spark.range(10).selectExpr(f"concat('{name}', id * 31) {key}")
    found = adjacency.lookup(key, keys, 10)
    plan = io.StringIO()
    with contextlib.redirect_stdout(plan):
        found.explain("formatted")
    filters = {line.split(":")[0]: line for line in plan.getvalue().splitlines() if "Filters: [" in line}
    assert "part" in filters["PartitionFilters"] and f"In({key}" in filters["PushedFilters"]
    folders = lambda df: {r[0] for r in df.selectExpr("regexp_extract(input_file_name(), 'part=([0-9]+)', 1)").distinct().collect()}
    assert len(folders(found)) <= 10 and len(folders(adjacency.copy(key))) == 32


def test_no_edges_and_no_keys(spark, tmp_path):
    empty = spark.createDataFrame([], "caller_id string, callee_qname string, callee_raw string, other int")
    write_adjacency(empty, str(tmp_path / "none"))
    adjacency = Adjacency(spark, str(tmp_path / "none"))
    keys = spark.createDataFrame([(None,)], "caller_id string")
    assert adjacency.parts == 16
    assert adjacency.copy("caller_id").count() == 0 and adjacency.lookup("caller_id", keys, 1).count() == 0
