import math

import numpy as np
import pyarrow as pa
import pytest

from unitloom.llm.forest import near_vectors, parted, share_for

SCHEMA = "vec_id long, embedding array<float>, label int, leaf string, n_links int"


def brute(rows, cosine=0.93):
    ok = [
        r for r in rows
        if r[2] is not None and r[1] and all(x is not None and math.isfinite(x) for x in r[1]) and any(x != 0 for x in r[1])
    ]
    links = {id(r): [] for r in rows}
    for a in ok:
        for b in ok:
            if a is not b and a[2] == b[2] and len(a[1]) == len(b[1]):
                x, y = np.array(a[1], np.float32).astype(float), np.array(b[1], np.float32).astype(float)
                if x @ y / np.sqrt((x @ x) * (y @ y)) >= cosine:
                    links[id(a)].append(b)
    out = []
    for r in rows:
        seen, todo = {id(r): r}, [r]
        while todo:
            for b in links[id(todo.pop())]:
                if id(b) not in seen:
                    seen[id(b)] = b
                    todo.append(b)
        comp = min((b[0] for b in seen.values() if b[0] is not None), default=None)
        out.append((r[0], len(links[id(r)]), comp, comp is None or r[0] is None or comp == r[0]))
    return out


def sample(n=500, size=16, seed=1):
    rng = np.random.default_rng(seed)
    base = rng.standard_normal((n, size))
    near = base[: n // 3] + 0.08 * rng.standard_normal((n // 3, size))
    hot = base[5] + 0.12 * rng.standard_normal((150, size))
    every = np.concatenate([base, near, hot, base[:30], np.tile(base[7], (40, 1)), 3 * base[:10]])
    label = rng.choice([1, 1, 1, 2, 3], len(every))
    label[n:] = np.concatenate([label[: n // 3], np.full(150, label[5]), label[:30], np.full(40, label[7]), label[:10]])
    return [(int(i * 2), [float(x) for x in v], int(c)) for i, (v, c) in enumerate(zip(every, label))]


@pytest.mark.parametrize("more", [{}, {"leaf": 64, "max_group": 200}])
def test_links_equal_brute_force(spark, more):
    nan, inf = float("nan"), float("inf")
    odd = [
        (9001, None, 1), (9003, [], 1), (9005, [0.0] * 16, 1), (9007, [1.0] * 15 + [None], 1), (9009, [1.0] * 15 + [nan], 1),
        (9011, [1.0] * 15 + [inf], 1), (9013, [1.0] * 16, None), (9015, [1.0] * 16, None), (9017, [1.0] * 8, 1), (9019, [2.0] * 8, 1),
        (None, [1.0] * 8, 1), (None, None, None), (None, [7.0] + [0.0] * 7, 9), (9021, [1.0] * 8, 2),
    ]
    rows = sample() + odd
    got = near_vectors(spark.createDataFrame([(*r, "x", 1) for r in rows], SCHEMA), **more).collect()
    want = brute(rows)
    if not more:
        assert sorted(map(tuple, got), key=str) == sorted(want, key=str)
        return
    # Small leaves: nothing false, and at least the promised share of the links.
    have, full = {r.vec_id: r for r in got if r.vec_id is not None}, {r[0]: r for r in want if r[0] is not None}
    assert all(have[i].n_links <= full[i][1] for i in full)
    assert sum(r.n_links for r in got) >= 0.9 * sum(r[1] for r in want)


def test_no_rows(spark):
    assert near_vectors(spark.createDataFrame([], SCHEMA)).collect() == []


def test_recall_on_the_given_vectors(spark):
    df = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet")
    rows = [tuple(r) for r in df.select("vec_id", "embedding", "label").collect()]
    got = near_vectors(df, leaf=64).collect()
    truth = brute_matrix(rows)
    assert all(r.n_links <= truth[r.vec_id] for r in got)
    assert sum(r.n_links for r in got) >= 0.9 * sum(truth.values())


def brute_matrix(rows):
    ids, label = np.array([r[0] for r in rows]), np.array([r[2] for r in rows])
    unit = np.array([r[1] for r in rows], float)
    unit /= np.linalg.norm(unit, axis=1)[:, None]
    near = (unit @ unit.T >= 0.93) & (label[:, None] == label[None, :])
    return dict(zip(ids.tolist(), (near.sum(axis=1) - 1).tolist()))


def test_dense_group_above_max_group_is_compared_whole(spark):
    """Near copies of one vector, more than max_group of them: at a root, below a cut, and beside equal rows."""
    rng = np.random.default_rng(3)
    hot = rng.standard_normal(16)
    near = lambda n: hot + 0.1 * rng.standard_normal((n, 16))
    parts = [(near(700), 1), (rng.standard_normal((300, 16)), 1), (near(450), 2), (rng.standard_normal((3000, 16)), 2), (np.tile(hot, (30, 1)), 2)]
    rows = [(v, c) for part, c in parts for v in part]
    rows = [(i, [float(np.float32(x)) for x in v], c) for i, (v, c) in enumerate(rows)]
    got = {r.vec_id: r for r in near_vectors(spark.createDataFrame([(*r, "x", 1) for r in rows], SCHEMA), leaf=64, max_group=200).collect()}
    truth = brute_matrix(rows)
    assert all(got[i].n_links <= truth[i] for i in truth)
    for label in (1, 2):
        mine = [r[0] for r in rows if r[2] == label]
        assert sum(got[i].n_links for i in mine) >= 0.95 * sum(truth[i] for i in mine)
    assert all(got[i].n_links == truth[i] for i in range(1000))
    assert {got[i].component_id for i in range(700)} == {0}


def links_of(unit, cosine=0.93):
    out = np.zeros(len(unit), np.int64)
    for a in range(0, len(unit), 2000):
        out[a : a + 2000] = (unit[a : a + 2000] @ unit.T >= cosine).sum(axis=1) - 1
    return out


@pytest.mark.parametrize("kind", ["one centre", "mixed"])
def test_recall_of_large_labels_at_the_default_parameters(spark, kind, capsys):
    """60,000 vectors of a label: around one centre at cosine 0.95, alone or with as many spread ones, each spread one with a partner."""
    rng = np.random.default_rng(11)
    n, size = 60_000, 64
    near = n if kind == "one centre" else n // 2
    centre, other = rng.standard_normal(size), rng.standard_normal((near, size))
    centre /= np.linalg.norm(centre)
    other -= (other @ centre)[:, None] * centre
    other /= np.linalg.norm(other, axis=1)[:, None]
    unit = 0.95 * centre + math.sqrt(1 - 0.95**2) * other
    wide = rng.standard_normal(((n - near) // 2, size))
    wide /= np.linalg.norm(wide, axis=1)[:, None]
    step = rng.standard_normal(wide.shape)
    step -= (step * wide).sum(axis=1)[:, None] * wide
    step /= np.linalg.norm(step, axis=1)[:, None]
    unit = np.concatenate([unit, wide, 0.935 * wide + math.sqrt(1 - 0.935**2) * step]).astype(np.float32).astype(float)
    unit /= np.linalg.norm(unit, axis=1)[:, None]
    arrow = pa.table({"vec_id": np.arange(n), "embedding": pa.FixedSizeListArray.from_arrays(unit.ravel(), size).cast(pa.list_(pa.float64())), "label": np.ones(n, np.int32)})
    got = near_vectors(spark.createDataFrame(arrow)).select("vec_id", "n_links").toArrow().sort_by("vec_id")
    found, want = got.column("n_links").to_numpy(), links_of(unit)
    parts = {"all": slice(None), "close": slice(0, near), "spread": slice(near, None)}
    recall = {k: found[p].sum() / want[p].sum() for k, p in parts.items() if want[p].sum()}
    with capsys.disabled():
        print(f"\nrecall of {kind}: {({k: round(float(v), 3) for k, v in recall.items()})}, {want.mean():.0f} links a vector")
    assert (found <= want + 2).all() and min(recall.values()) >= 0.9


def test_shares_follow_the_spread():
    assert share_for(60_000, 1.0, 0.93, 1024, 12, 0.06, 1) == 0.06
    assert share_for(60_000, 1 - 0.95**2, 0.93, 1024, 12, 0.06, 12) is None
    assert share_for(60_000, 0.05, 0.93, 1024, 12, 0.06, 1) is None
    rng = np.random.default_rng(3)
    for share, correlation in ((0.06, 0.3), (0.1, 0.6)):
        x = rng.standard_normal((2, 400_000))
        y = correlation * x[0] + math.sqrt(1 - correlation**2) * x[1]
        cut = np.quantile(x[0], 0.5 + share)
        assert parted(share, correlation) == pytest.approx(2 * ((x[0] < -cut) & (y > cut)).mean(), rel=0.05)
