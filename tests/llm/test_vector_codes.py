import hashlib
import math

import numpy as np
import pytest

from unitloom.llm.vector_codes import coded, exact, nearest, reassign, vector_codes

SCHEMA = "vec_id long, embedding array<float>, label string, code string, size int"


def brute(rows, parts, entries, rounds):
    """Plain Lloyd rounds with Python integers."""
    whole = {}
    for r in rows:
        if r[1] is not None and all(x is not None and math.isfinite(x) for x in r[1]):
            v = [math.floor(1024 * float(np.float32(x))) for x in r[1]]
            whole.setdefault(len(v), []).append((r[0], v, r[2]))
    out, labels = [], {}
    for size, vectors in whole.items():
        cuts = [k * size // parts for k in range(parts + 1)]
        vectors.sort(key=lambda r: (r[0] is None, r[0] or 0, r[1]))
        codes, books, errors = [[] for _ in vectors], [], [0] * len(vectors)
        for k in range(parts):
            points = [v[cuts[k] : cuts[k + 1]] for _, v, _ in vectors]
            book = points[:entries]
            for step in range(rounds + 1):
                found = [min((sum((a - b) ** 2 for a, b in zip(p, c)), e) for e, c in enumerate(book)) for p in points]
                if step < rounds:
                    groups = {}
                    for p, (_, e) in zip(points, found):
                        groups.setdefault(e, []).append(p)
                    book = [[sum(c) // len(groups[e]) for c in zip(*groups[e])] if e in groups else b for e, b in enumerate(book)]
            books += book
            for i, (gap, e) in enumerate(found):
                codes[i].append(f"{e:02x}")
                errors[i] += gap
        digest = hashlib.sha256(",".join(str(x) for b in books for x in b).encode()).hexdigest()
        for (vec_id, _, label), code, error in zip(vectors, codes, errors):
            out.append((vec_id, "".join(code), error, label, digest))
            labels[label] = labels.get(label, 0) + error
    long = lambda x: x if x < 1 << 63 else None
    return sorted(((*o[:2], long(o[2]), long(labels[o[3]]), o[4]) for o in out), key=str)


def sample(n=400, size=12, seed=2):
    rng = np.random.default_rng(seed)
    vectors = np.concatenate([rng.standard_normal((n, size)), rng.integers(-2, 3, (n // 2, size)) / 4, np.tile(rng.standard_normal(size), (30, 1))])
    return [(int(3 * i), [float(np.float32(x)) for x in v], rng.choice(["a", "b", None, "c"])) for i, v in enumerate(vectors)]


def run(spark, rows, parts=4, entries=256, rounds=4, split=4):
    df = spark.createDataFrame([(r[0], r[1], None if r[2] is None else str(r[2]), "x", 1) for r in rows], SCHEMA).repartition(split)
    got = coded(df, parts=parts, entries=entries, rounds=rounds)
    assert got.columns == ["vec_id", "code", "error", "label_error", "codebooks_sha256"]
    return sorted(map(tuple, got.collect()), key=str)


@pytest.mark.parametrize("more", [{}, {"parts": 3, "entries": 16, "rounds": 6}, {"rounds": 0}])
def test_codes_equal_plain_rounds(spark, more):
    nan, inf = float("nan"), float("inf")
    odd = [(5000, None, "a"), (5001, [nan] * 12, "a"), (5002, [inf] * 12, "b"), (5003, [1.0] * 11 + [None], None), (None, [0.5] * 12, "a"), (0, [9.0] * 12, "c")]
    odd += [(6000 + i, [0.1 * i] * 7, "a") for i in range(5)] + [(7000, [], "b"), (7001, [0.25], None), (7002, [1e6] * 12, "a"), (7003, [-4e11, *[3e11] * 11], "a")]
    rows = sample() + odd
    assert run(spark, rows, **more) == brute(rows, **{"parts": 4, "entries": 256, "rounds": 4, **more})


def test_fewer_vectors_than_entries_and_none(spark):
    rows = [(i, [float(i), 0.0, 1.0, -1.0], "a") for i in range(3)]
    assert run(spark, rows) == brute(rows, 4, 256, 4)
    assert run(spark, []) == []
    codes, books = vector_codes(spark.createDataFrame([(1, None, "a", "", 0)], SCHEMA))
    assert codes.collect() == [] and books.collect() == []


def test_active_entries_give_what_a_full_scan_gives():
    rng = np.random.default_rng(4)
    for largest in (3, 1000, 1 << 28, 1 << 40):
        points, book = rng.integers(-largest, largest, (500, 3)), rng.integers(-largest, largest, (40, 3))
        book[7], book[11] = book[5], book[3]
        code, gap = nearest(points, book)
        moved = rng.random(40) < 0.3
        book[moved] = rng.integers(-largest, largest, (moved.sum(), 3))
        book[np.flatnonzero(moved)[0]] = book[np.flatnonzero(~moved)[-1]]
        want = nearest(points, book)
        got = reassign(points, book, moved, code, gap)
        assert (got[0] == want[0]).all() and (got[1] == want[1]).all()
    assert exact(10, 4) is np.float64 and exact(1 << 26, 16) is np.int64 and exact(1 << 40, 4) is object


def test_only_moved_entries_are_compared(monkeypatch):
    import unitloom.llm.vector_codes as module

    seen = []
    plain = module.nearest
    monkeypatch.setattr(module, "nearest", lambda p, b: seen.append((len(p), len(b))) or plain(p, b))
    points, book = np.arange(200).reshape(100, 2), np.arange(64).reshape(32, 2) * 3
    code, gap = plain(points, book)
    moved = np.zeros(32, bool)
    moved[4] = True
    module.reassign(points, book, moved, code, gap)
    assert sorted(seen) == sorted([((code == 4).sum(), 32), ((code != 4).sum(), 1)])
