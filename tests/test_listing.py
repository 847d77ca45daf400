import os

import pytest

from unitloom.plans.index import index_repository
from unitloom.sources import jsonl
from unitloom.sources.files import read_repository
from unitloom.sources.listing import list_files, wanted
from unitloom.sources.tables import CodeTables
from unitloom.streaming.ingest import stream_repository


def plant(root, files):
    for path, text in files.items():
        place = root / path
        place.parent.mkdir(parents=True, exist_ok=True)
        place.write_text(text)


NAMES = ["pkg/__init__.py", "pkg/_private.py", "pkg/_inner/x.py", "_pkg/x.py", ".hidden/y.py", "pkg/.z.py", "__main__.py", "a b/ü%41.PY", "v1+2/m.py"]


def source(path):
    return f"def made_by_{abs(hash(path)) % 1000}():\n    return '{path}'\n"


@pytest.mark.parametrize("budget", [1, 2, 256])
def test_every_name_is_listed_once(spark, tmp_path, budget):
    plant(tmp_path, {p: source(p) for p in NAMES + ["pkg/readme.md", ".py", "pkg/.py", "x.py.bak", "node_modules/q.py", "a/.git/w.py"]})
    os.symlink(tmp_path / "pkg", tmp_path / "again")
    os.symlink(tmp_path / "__main__.py", tmp_path / "linked.py")
    os.symlink(tmp_path / "nowhere", tmp_path / "broken.py")
    got = list_files(spark, str(tmp_path), [".py"], ["node_modules", ".git"], budget=budget)
    assert sorted(r.path for r in got.collect()) == sorted([*NAMES, "linked.py"])


@pytest.mark.parametrize("scheme", ["", "file://"])
def test_units_of_names_that_spark_hides(spark, tmp_path, scheme):
    plant(tmp_path / "app", {p: source(p) for p in NAMES})
    files = {r.path: r.source for r in read_repository(spark, f"{scheme}{tmp_path}/app").collect()}
    assert files == {p: source(p).encode() for p in NAMES}
    counts = index_repository(spark, f"{scheme}{tmp_path}/app", str(tmp_path / "out"))
    assert counts["n_units"] == len(NAMES)
    modules = {r.path: r.module for r in jsonl.read_chunks(spark, str(tmp_path / "out/chunks.jsonl")).collect()}
    assert modules["pkg/__init__.py"] == "pkg" and modules["_pkg/x.py"] == "_pkg.x" and modules["pkg/_private.py"] == "pkg._private"
    seen = {r.path for r in read_repository(spark, f"{scheme}{tmp_path}/app", complete=False).collect()}
    assert "v1+2/m.py" in seen and "pkg/__init__.py" not in seen


def test_no_files(spark, tmp_path):
    assert read_repository(spark, str(tmp_path)).collect() == []
    assert read_repository(spark, str(tmp_path / "missing")).collect() == []


def test_stream_takes_each_change_once(spark, tmp_path):
    root, args = tmp_path / "in", (str(tmp_path / "t"), str(tmp_path / "c"))

    def run():
        stream_repository(spark, str(root), *args, buckets=2, dim=8).awaitTermination()
        return {r.path: (r.content, r.job_id) for r in CodeTables(spark, args[0], 2).units().collect()}

    plant(root, {p: source(p) for p in NAMES[:4]})
    first = run()
    assert set(first) == set(NAMES[:4])
    # An old modification time, as a copy that keeps times has it, and a changed file.
    plant(root, {p: source(p) for p in NAMES[4:6]} | {NAMES[0]: source(NAMES[0]) + "# more\n"})
    os.utime(root / NAMES[4], (1, 1))
    second = run()
    assert {p for p in second if second[p] != first.get(p)} >= set(NAMES[4:6])
    assert second[NAMES[1]] == first[NAMES[1]] and set(second) == set(NAMES[:6])
    assert run() == second


def test_suffix_rule():
    assert wanted("a/b.PY", {".py"}) and wanted("_x.py", {".py"}) and wanted(".x.py", {".py"})
    assert not wanted(".py", {".py"}) and not wanted("a.py/b", {".py"}) and not wanted("b.", {".py", "."} - {"."})
