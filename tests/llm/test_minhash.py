import random
import re

import pytest

from unitloom.llm.components import components
from unitloom.llm.minhash import near_duplicates


def brute(rows, width, percent):
    sets = {}
    for d, t in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in t or ""))
        s = {tuple(w)} if 0 < len(w) < width else {tuple(w[i : i + width]) for i in range(len(w) - width + 1)}
        sets.setdefault(d, []).append(s)
    ids = [d for d in sets if d is not None]
    parent = {d: d for d in ids}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in ids:
        for b in ids:
            if a < b and any(x and y and 100 * len(x & y) >= percent * len(x | y) for x in sets[a] for y in sets[b]):
                x, y = sorted((root(a), root(b)))
                parent[y] = x
    out = []
    for d, t in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in t or ""))
        n = len({tuple(w)} if 0 < len(w) < width else {tuple(w[i : i + width]) for i in range(len(w) - width + 1)})
        out.append((d, n, None if d is None else root(d), d is None or root(d) == d))
    return sorted(out, key=str)


@pytest.mark.parametrize("width", [2, 5])
def test_near_duplicates_equal_brute_force(spark, prose, width):
    rng = random.Random(width)
    texts = prose(60, seed=width, words=(0, 80))
    for base in list(texts[:25]):
        for _ in range(4):
            w = base.split(" ")
            for _ in range(rng.randint(0, 4)):
                w[rng.randrange(len(w))] = rng.choice(["new", "word", "here"])
            texts.append(" ".join(w))
    texts += [None, "", " \t\n", "One", "ONE", "one two", "x" * 5000, " ".join(["long"] * 9000), texts[0].upper() + "\r\n"]
    texts += [texts[3]] * 300
    rows = [(i * 3, t) for i, t in enumerate(texts)] + [(0, texts[0]), (9, "another text for id nine"), (None, texts[1]), (None, None)]
    df = spark.createDataFrame([(d, t, 1) for d, t in rows], "doc_id long, text string, component_id int")
    got = near_duplicates(df, width).select("doc_id", "n_shingles", "component_id", "kept").collect()
    assert sorted(map(tuple, got), key=str) == brute(rows, width, 80)


def test_no_rows(spark):
    assert near_duplicates(spark.createDataFrame([], "doc_id long, text string"), 2).collect() == []


def test_components_of_chains_and_hubs(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, 100 + i) for i in range(1, 50)] + [(500, 500)] + [(7, 6), (7, 6)]
    got = dict(components(spark.createDataFrame(edges, "a long, b long")).collect())
    assert got == {**{i: 0 for i in range(41)}, **{100 + i: 100 for i in range(50)}}
