"""A load moves the rows whose id repeats, the others stay where they are read."""

import pytest

from unitloom.operators import maintain
from unitloom.sources import jsonl


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def frame(spark, rows):
    return spark.createDataFrame(rows, "id string, seq long, text string")


def test_rows_without_repeated_ids_are_not_moved(spark):
    df = frame(spark, [(f"u{i}", i, "x" * i) for i in range(20)] + [(None, 1, "none")])
    out = maintain.last_of_repeated(df, df.select("id"), "id", "seq")
    assert "Exchange" not in plan(out)
    assert sorted(out.collect(), key=str) == sorted(df.collect(), key=str)


@pytest.mark.parametrize("rows", [
    [("a", 1, "old"), ("a", 2, "new"), ("b", 1, "only"), (None, 1, "x"), (None, 3, "y")],
    [("a", 1, "old"), ("a", 2, "new"), (None, 1, "only")],
    [],
])
def test_the_last_of_repeated_ids_stays(spark, rows):
    df = frame(spark, rows)
    want = maintain.last_wins(df, "id", "seq").collect()
    assert sorted(maintain.last_of_repeated(df, df.select("id"), "id", "seq").collect(), key=str) == sorted(want, key=str)


def test_absent_refs_move_no_units(spark, tmp_path):
    units = frame(spark, [("a", 1, "t")]).repartition(2)
    refs = jsonl.read_refs(spark, str(tmp_path / "refs.jsonl"))
    assert refs.schema.fieldNames() == jsonl.REFS.fieldNames()
    joined = maintain.with_refs(units, refs)
    assert "SortMergeJoin" not in plan(joined) and joined.select("id", "refs").collect() == [("a", None)]
