"""Chunks and refs that arrive in any order end as one load of all files."""

import json
import random

import pytest

from unitloom.plans.load import load
from unitloom.sources.tables import CodeTables
from unitloom.streaming.ingest import stream_chunks_and_refs


def chunk(i, content):
    return dict(
        qualified_name=f"m.C.f{i}", module="m", language="python", role="method", symbol=f"f{i}", class_chain=["C"], path=f"p{i}.py",
        start_line=1, end_line=1, content=content, calls=["g"], namespace="code", embed_text=f"text {content}",
    )


def ref(i, mro):
    return dict(unit_id=f"p{i}.py::m.C.f{i}", qualified_name=f"m.C.f{i}", path=f"p{i}.py", language="python", refs={"mro": mro, "metaclass": "type"})


def put(folder, kind, name, rows):
    place = folder / f"{kind}.jsonl"
    place.mkdir(parents=True, exist_ok=True)
    (place / name).write_text("".join(json.dumps(r) + "\n" for r in rows))


def units(spark, root):
    rows = CodeTables(spark, str(root), 4).units().collect()
    return {r.id: (r.content, r.embed_func_text, r.embed_class_text, tuple(r.vec_class)) for r in rows}


@pytest.fixture
def run(spark, tmp_path):
    def once():
        stream_chunks_and_refs(spark, str(tmp_path / "in"), str(tmp_path / "t"), str(tmp_path / "c"), buckets=4, dim=8).awaitTermination()
        return units(spark, tmp_path / "t")

    return once


def test_refs_may_come_before_with_or_after_their_chunk(spark, tmp_path, run):
    box = tmp_path / "in"
    put(box, "chunks", "part-1.json", [chunk(0, "late"), chunk(1, "draft"), chunk(1, "last"), chunk(4, "alone")])
    put(box, "refs", "part-1.json", [ref(1, "With"), ref(2, "Early")])
    first = run()
    assert first["p0.py::m.C.f0"][2] == "class: C" and "mro: With" in first["p1.py::m.C.f1"][2]
    assert first["p1.py::m.C.f1"][0] == "last" and len(first) == 3
    put(box, "refs", "part-2.json", [ref(0, "Older"), ref(0, "Late"), {**ref(9, "Nobody"), "unit_id": None}])
    second = run()
    assert second["p0.py::m.C.f0"][0] == "late" and "mro: Late" in second["p0.py::m.C.f0"][2]
    put(box, "chunks", "part-3.json", [chunk(2, "after"), chunk(0, "new")])
    third = run()
    assert "mro: Early" in third["p2.py::m.C.f2"][2] and "mro: Late" in third["p0.py::m.C.f0"][2]
    load(spark, str(box), str(tmp_path / "b"), job_id="all", buckets=4, dim=8)
    assert third == units(spark, tmp_path / "b")
    assert third == run()


def test_nothing_arrives(run):
    assert run() == {}


def test_texts_stay_in_their_files(tmp_path, run):
    """The state keeps ids and refs, whatever the texts weigh; a file may have any name."""
    box, rnd = tmp_path / "in", random.Random(1)
    content = "".join(rnd.choices("0123456789abcdefghijklmnopqrstuvwxyz", k=3_000_000))
    put(box, "chunks", "part {1} [a]%20*.json", [chunk(0, content), chunk(1, "other")])
    assert len(run()) == 2
    put(box, "refs", "part-1.json", [ref(0, "Late")])
    after = run()
    assert after["p0.py::m.C.f0"][0] == content and "mro: Late" in after["p0.py::m.C.f0"][2] and "mro" not in after["p1.py::m.C.f1"][2]
    assert sum(f.stat().st_size for f in (tmp_path / "c").rglob("*") if f.is_file()) < len(content) // 4


def test_a_removed_unit_stays_away(spark, tmp_path, run):
    put(tmp_path / "in", "chunks", "part-1.json", [chunk(0, "a"), chunk(1, "b")])
    run()
    kept = spark.createDataFrame([("p1.py::m.C.f1",)], "id string")
    CodeTables(spark, str(tmp_path / "t"), 4).prune_missing(kept)
    put(tmp_path / "in", "refs", "part-1.json", [ref(0, "Late")])
    assert list(run()) == ["p1.py::m.C.f1"]
