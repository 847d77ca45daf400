import re
from collections import Counter, defaultdict

from unitloom.llm.mixing import mixed, plan


def goals(rows):
    sizes = defaultdict(int)
    for _, t, s in rows:
        sizes[s] += len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: (1, 2, 3)[i % 3] for i, s in enumerate(names)}
    total, full = sum(sizes.values()), set()
    while True:
        free = total - sum(3 * sizes[s] for s in full)
        open_weight = sum(weight[s] for s in names if s not in full)
        over = {s for s in names if s not in full and weight[s] * free / open_weight >= 3 * sizes[s]} if open_weight else set()
        if not over:
            return sizes, {s: float(3 * sizes[s]) if s in full else weight[s] * free / open_weight for s in names}
        full |= over


def sample(prose):
    sources = ["b", "a", "Z", "é", "\U0001f600", "～", None, "", "tiny", "x1", "x2", "empty"]
    rows = [(i, t, sources[i % 8] if i % 3 else "b") for i, t in enumerate(prose(900, seed=2))]
    return rows + [(5000, "one two", "tiny"), (5001, "w " * 900, "x1"), (5002, None, "empty"), (5003, " ", "x2"), (None, "no id", "a"), (7, "again", "a")]


def test_targets_and_taken_words(spark, prose):
    rows = sample(prose)
    df = spark.createDataFrame([(*r, 1, 2.0) for r in rows], "doc_id long, text string, source string, size int, target double")
    got = plan(df).collect()
    sizes, want = goals(rows)
    taken = Counter()
    for r in got:
        n = len(re.findall(r"[^\x20\x09-\x0D]+", r.text or ""))
        assert r.size == n and r.source_size == sizes[r.source] and abs(r.target - want[r.source]) < 1e-6
        assert 0 <= r.repeats <= 3 and (sizes[r.source] == 0) <= (r.repeats == 0)
        rate = want[r.source] / sizes[r.source] if sizes[r.source] else 0
        assert int(rate) <= r.repeats <= int(rate) + 1
        taken[r.source] += r.size * r.repeats
    for s in sizes:
        if s not in ("tiny", "x1"):
            assert abs(taken[s] - want[s]) <= 0.05 * want[s] + 1
    assert sorted(map(str, got)) == sorted(map(str, plan(df.repartition(7)).collect()))
    out = Counter((r.doc_id, r.text) for r in mixed(df).collect())
    assert out == Counter({k: v for k, v in Counter(x for r in got for x in [(r.doc_id, r.text)] * r.repeats).items()})
    assert mixed(df).columns == df.columns


def test_no_rows(spark):
    df = spark.createDataFrame([], "doc_id long, text string, source string")
    assert plan(df).collect() == [] and mixed(df).collect() == []
