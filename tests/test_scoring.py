import math
import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from unitloom.functions import block_max, kernels, lexical, texts, vectors
from unitloom.functions import embedding
from unitloom.functions.embedding import embed_literal, embed_text
from unitloom.functions.paths import is_test_hit
from unitloom.operators import ann, topk
from unitloom.plans import search

DIM = 16


def brute_rank(tokens, terms):
    terms = sorted(set(terms))
    if not tokens or not terms:
        return 0.0
    pos = {t: [i for i, w in enumerate(tokens) if w == t] for t in terms}
    if len(terms) == 1:
        return 0.1 * sum(1 / j**2 for j in range(1, len(pos[terms[0]]) + 1)) / 1.64493406685
    keep, found = 1.0, False
    for i, a in enumerate(terms):
        for b in terms[i + 1 :]:
            for x in pos[a]:
                for y in pos[b]:
                    d = abs(x - y)
                    near = 1 / (1.005 + 0.05 * math.exp(d / 1.5 - 2)) if d <= 100 else 1e-30
                    keep *= 1 - 0.1 * math.sqrt(near)
                    found = True
    return 1 - keep if found else 1e-20


ASKED = [(0, "a"), (1, "a b"), (2, "c d e c"), (3, "zzz"), (4, "zzz a"), (5, ""), (6, None), (7, "rare x b"), (8, "rare zzz")]


def best_by_brute_force(docs, query, k):
    terms = set((query or "").split())
    rank = [(-round(brute_rank((t or "").split(), terms), 9), d) for d, t in docs if terms & set((t or "").split())]
    return [d for _, d in sorted(rank)[:k]]


@pytest.mark.parametrize("more", [{}, {"block_docs": 3, "shard_blocks": 4}])
def test_best_texts_against_brute_force(spark, tmp_path, more):
    rnd = random.Random(3)
    words = list("abcdefgh")
    docs = [(str(i), " ".join(rnd.choices(words, k=rnd.choice([0, 1, 3, 40, 400])))) for i in range(90)]
    docs += [(f"c{i}", "a b a") for i in range(60)] + [("n", None), ("r", "b rare b"), ("s", "rare")]
    d = spark.createDataFrame(docs, "id string, text string").repartition(5)
    q = spark.createDataFrame(ASKED, "query_id long, query string")
    lexical.write_postings(d, "id", "text", str(tmp_path / "p"), **more)
    index = spark.read.parquet(str(tmp_path / "p"))
    texts_of = dict(docs)
    for k in (1, 7, 500):
        got = {}
        for r in lexical.best_texts(index, q, k).collect():
            got.setdefault(r.query_id, []).append((r.rank, r.key, r.ts_score))
        for qid, query in ASKED:
            found = sorted(got.get(qid, []))
            assert [key for _, key, _ in found] == best_by_brute_force(docs, query, k)
            for _, key, rank in found:
                assert rank == pytest.approx(brute_rank(texts_of[key].split(), query.split()), abs=1e-12)


@pytest.mark.parametrize("more", [{}, {"block_docs": 3, "shard_blocks": 4}])
def test_text_ranks_have_no_cut(spark, tmp_path, more):
    """Every text that shares a word, against brute force; a repeated or missing key is one text."""
    rnd = random.Random(5)
    docs = [(i, " ".join(rnd.choices("abcdefgh", k=rnd.choice([0, 1, 3, 40, 300])))) for i in range(120)]
    d = spark.createDataFrame([*docs, (500, None), (None, "rare x"), (600, "a b"), (600, "c a")], "id long, text string").repartition(5)
    q = spark.createDataFrame(ASKED, "query_id long, query string")
    lexical.write_postings(d, "id", "text", str(tmp_path / "p"), **more)
    index = spark.read.parquet(str(tmp_path / "p"))
    posts = {(r.term, p.key): p.positions for r in index.collect() for p in r.posts}
    assert posts["a", 600] == [1, 2] and posts["rare", None] == [1]
    for r in index.collect():
        assert r.top == max(len(p.positions) for p in r.posts)
    got = {(r.query_id, r.key): r.ts_score for r in lexical.text_ranks(index, q).collect()}
    want = {}
    for qid, query in ASKED:
        terms = set((query or "").split())
        for key, text in [*docs, (None, "rare x")]:
            if terms & set(text.split()):
                want[qid, key] = brute_rank(text.split(), terms)
    assert {k: v for k, v in got.items() if k[1] != 600} == pytest.approx(want, abs=1e-12)
    assert {k[0] for k in got if k[1] == 600} == {qid for qid, query in ASKED if {"a", "b", "c"} & set((query or "").split())}


def test_pairs_of_a_full_rank_are_not_listed(monkeypatch):
    """A long text ranks 1 after its nearest pairs; another one beside it and its rank stay as they are."""
    steps = []

    class Weights(np.ndarray):
        def __getitem__(self, gaps):
            steps.append(np.size(gaps))
            return np.asarray(self)[gaps]

    monkeypatch.setattr(kernels, "_NEAR_LOG", kernels._NEAR_LOG.view(Weights))
    short = "a b x x a".split()
    pos, term = np.concatenate([np.arange(3000), [0, 1, 4]]), np.concatenate([np.arange(3000) % 2, [0, 1, 0]])
    ranks = kernels.group_ranks(np.repeat([0, 1], [3000, 3]), pos, term, np.array([True, True]))
    assert ranks[0] == 1.0 and ranks[1] == pytest.approx(brute_rank(short, ["a", "b"]), abs=1e-12)
    assert sum(steps) < 2 * 3003


def test_all_texts_of_a_shard_in_pieces(monkeypatch):
    rows = [{"block": b, "term": t, "top": 2, "posts": [{"key": b, "positions": [i, i + 7]}]} for b in range(40) for i, t in enumerate(("one", "two"))]
    monkeypatch.setattr(block_max, "PLACES_AT_ONCE", 10)
    parts = list(block_max.Shard(pa.Table.from_pylist(rows)).all(["one", "two", "none"]))
    assert len(parts) == 20 and sorted(k for keys, _ in parts for k in keys.to_pylist()) == list(range(40))
    assert list(block_max.Shard(pa.Table.from_pylist(rows)).all(["none"])) == []


def test_blocks_that_cannot_matter_are_skipped():
    """One shard of 200 blocks; few of them can hold the best texts."""
    rnd = random.Random(9)
    docs = []
    for i in range(4000):
        often = i // 20 in (17, 60, 150)
        docs.append((i, ["one", "two"] * (6 if often and i % 20 < 10 else 1) if rnd.random() < 0.5 else ["one"] + ["x"] * rnd.randint(0, 5)))
    rows = {}
    for i, words in docs:
        for t in set(words):
            rows.setdefault((i // 20, t), []).append({"key": i, "positions": [p for p, w in enumerate(words) if w == t]})
    table = pa.Table.from_pylist([{"block": b, "term": t, "top": max(len(p["positions"]) for p in posts), "posts": posts} for (b, t), posts in rows.items()])
    shard, seen = block_max.Shard(table), []
    for terms in (["one", "two"], ["one"], ["one", "none"]):
        want = sorted((-round(brute_rank(w, terms), 9), i) for i, w in docs if set(terms) & set(w))[:10]
        assert [key for key, _ in shard.best(terms, 10, seen)] == [i for _, i in want]
    assert all(blocks == 200 for _, _, blocks in seen)
    assert seen[0][0] <= 20 and seen[1][0] <= 20 and seen[2][:2] == (0, pytest.approx(1, abs=20))


def test_a_search_pushes_its_terms(spark, tmp_path):
    d = spark.createDataFrame([(i, f"word{i} common") for i in range(50)], "id long, text string")
    lexical.write_postings(d, "id", "text", str(tmp_path / "p"))
    q = spark.createDataFrame([(1, "word7 common")], "query_id long, query string")
    best = lexical.best_texts(spark.read.parquet(str(tmp_path / "p")), q, 3)
    assert "In(term" in best._jdf.queryExecution().toString()
    assert [r.key for r in best.orderBy("rank").collect()] == [7, 0, 1]
    none = lexical.best_texts(spark.read.parquet(str(tmp_path / "p")), q.limit(0), 3)
    assert none.collect() == []
    lexical.write_postings(d.limit(0), "id", "text", str(tmp_path / "e"))
    assert lexical.best_texts(spark.read.parquet(str(tmp_path / "e")), q, 3).collect() == []


def test_known_rank_values():
    one = kernels.group_ranks(np.array([0]), np.array([3]), np.array([0]), np.array([False]))
    two = kernels.group_ranks(np.array([0, 0]), np.array([3, 4]), np.array([0, 1]), np.array([True]))
    assert one[0] == pytest.approx(0.0607927, abs=1e-7)
    assert two[0] == pytest.approx(0.0991032, abs=1e-7)


def make_units(spark, n=300, seed=1, copies=0):
    rnd = random.Random(seed)
    words = ["alpha", "beta", "gamma", "delta", "eps"]
    rows = []
    for i in range(n):
        rows.append((f"u{i:04d}", " ".join(rnd.choices(words, k=8)), rnd.choice(["src/a.py", "pkg/tests/test_a.py"]), rnd.choice(["code", "pip"])))
    rows += [(f"c{i:04d}", "alpha beta alpha", "src/copy.py", "code") for i in range(copies)]
    df = spark.createDataFrame(rows, "id string, search_text string, path string, namespace string").repartition(7)
    df = df.withColumns(
        {"qualified_name": F.concat(F.lit("m."), "id"), "role": F.lit("function"), "content": F.col("search_text")}
    )
    for lane, tail in (("func", ""), ("call", " call"), ("class", " class alpha")):
        df = df.withColumn(f"vec_{lane}", embed_text(F.concat("search_text", F.lit(tail)), dim=DIM))
    return df


def brute_search(rows, query, weights, k):
    q = np.array(embed_literal(query, DIM), float)
    out = []
    for r in rows:
        d = [1 - np.dot(v, q) / np.linalg.norm(v) / np.linalg.norm(q) for v in (np.array(r[f"vec_{l}"], float) for l in ("func", "call", "class"))]
        ts = brute_rank(r.search_text.split(), query.split())
        out.append((round(weights["w_func"] * d[0] + weights["w_call"] * d[1] + weights["w_class"] * d[2] - weights["w_fts"] * ts, 9), r.id))
    return sorted(out)[:k]


def test_search_against_brute_force_with_a_third_of_copies(spark):
    units = make_units(spark, 200, copies=100).cache()
    rows = units.collect()
    asked = [(1, "alpha beta"), (2, "gamma"), (3, "unknown words here")]
    q = spark.createDataFrame(asked, "query_id long, query string")
    hits = search.search(units, q, k=7, dim=DIM, deprioritize_tests=False).collect()
    for qid, text in asked:
        got = [(round(h.score, 9), h.id) for h in sorted(hits, key=lambda h: h.rank) if h.query_id == qid]
        want = brute_search(rows, text, vectors.lane_weights("func"), 7)
        assert [i for _, i in got] == [i for _, i in want]
        assert [s for s, _ in got] == pytest.approx([s for s, _ in want])


def test_query_blocks_give_the_same_result(spark):
    units = make_units(spark)
    q = spark.createDataFrame([(i, f"alpha {w}") for i, w in enumerate("beta gamma delta eps alpha".split())], "query_id long, query string")
    ready = search.prepare_queries(q, dim=DIM)
    w = vectors.lane_weights("call")
    whole = topk.score_units(units, ready, weights=w, fetch=5, dim=DIM)
    parts = topk.score_units(units, ready, weights=w, fetch=5, dim=DIM, per_pass=2)
    pick = lambda d: sorted((r.query_id, r.rank, r.id, r.score) for r in d.collect())
    assert pick(whole) == pick(parts)
    assert len(pick(whole)) == 25


def test_missing_vectors_come_last(spark):
    units = make_units(spark, 5)
    units = units.withColumn("vec_func", F.when(F.col("id") != "u0002", F.col("vec_func")))
    q = search.one_query(spark, "alpha")
    hits = search.search(units, q, k=10, dim=DIM, deprioritize_tests=False).collect()
    last = max(hits, key=lambda h: h.rank)
    assert len(hits) == 5 and last.id == "u0002" and last.score is None


def test_score_falls_with_the_text_weight(spark):
    units = make_units(spark, 50)
    q = search.one_query(spark, "alpha beta")
    score = lambda w: {h.id: h.score for h in search.search(units, q, k=50, dim=DIM, weights={"w_fts": w}, deprioritize_tests=False).collect()}
    low, high = score(0.0), score(0.5)
    assert all(high[i] <= low[i] + 1e-12 for i in low)


HITS = [("a", "pkg/tests/test_foo.py", "code"), ("b", "tests/test_foo.py", "code"), ("c", "pkg/mod.py", "code"), ("d", "pkg/mod.py", "tests"), ("e", "pkg\\tests\\x.py", None)]


def test_test_files(spark):
    df = spark.createDataFrame(HITS, "id string, path string, namespace string")
    assert {r.id: r.t for r in df.select("id", is_test_hit().alias("t")).collect()} == {"a": True, "b": True, "c": False, "d": True, "e": True}


def test_exclude_and_deprioritize(spark):
    rows = [(1, "t", "tests/test_a.py", "code", 0.1), (1, "m", "pkg/mod.py", "code", 0.2)]
    df = spark.createDataFrame(rows, "query_id long, id string, path string, namespace string, score double")
    order = lambda **kw: [r.id for r in topk.settle_tests(df, 10, **kw).orderBy("rank").collect()]
    assert order(deprioritize=True, exclude=False) == ["m", "t"]
    assert order(deprioritize=True, exclude=True) == ["m"]
    assert order(deprioritize=False, exclude=False) == ["t", "m"]


def test_rendering(spark):
    row = spark.createDataFrame([("a\nb\nc",)], "content string")
    assert row.select(texts.snippet(lines=2)).first()[0] == "a\nb"
    hits = spark.createDataFrame(
        [(7, 1, "pkg.fn", "pkg/mod.py", "function", "code", "x\n", 0.42)],
        "query_id long, rank int, qualified_name string, path string, role string, namespace string, content string, score double",
    )
    asked = spark.createDataFrame([(7, "q"), (8, "none")], "query_id long, query string")
    out = {r.query_id: r.text for r in search.render_hits(hits, asked).collect()}
    assert out[7] == "1. pkg.fn  score=0.4200\n   path: pkg/mod.py  role: function  ns: code\nx"
    assert out[8] == "no results"


def test_lane_presets():
    assert set(vectors.LANE_PRESETS) == {"balanced", "func", "call", "class"}
    assert vectors.lane_weights(overrides={"w_fts": 0.0}) == {"w_func": 0.6, "w_call": 0.2, "w_class": 0.2, "w_fts": 0.0}


def clustered(n=6000, dim=24, groups=300, seed=5):
    """Vectors with neighbours, a crowded group and some without a usable vector."""
    rng = np.random.default_rng(seed)
    centre = rng.standard_normal((groups, dim))
    group = np.where(rng.random(n) < 0.3, 0, rng.integers(0, groups, n))
    return centre[group] + 0.25 * rng.standard_normal((n, dim))


def test_inverted_lists_find_neighbours_in_few_cells(spark, tmp_path, capsys):
    vectors = clustered()
    rows = [(f"u{i}", [float(x) for x in v]) for i, v in enumerate(vectors)]
    odd = [("none", None), ("zero", [0.0] * 24), ("nan", [float("nan")] * 24)]
    units = spark.createDataFrame(rows + odd, "id string, vec_func array<float>").repartition(6)
    ann.write_index(units, str(tmp_path / "index"))
    index, centre = ann.read_index(spark, str(tmp_path / "index"))
    assert index.count() == len(rows) and index.select("id").distinct().count() == len(rows)
    asked = spark.createDataFrame([(i, rows[i][1]) for i in range(0, 6000, 40)] + [(-1, None)], "query_id long, qv array<float>")
    probes = 5
    found = {}
    for r in ann.nearest(index, centre, asked, k=10, dim=24, probes=probes, per_block=500).collect():
        found.setdefault(r.query_id, []).append((r.rank, r.id, r.d_func))
    m = vectors.astype(np.float32).astype(float)
    m /= np.linalg.norm(m, axis=1, keepdims=True)
    hits = 0
    for q in range(0, 6000, 40):
        far = 1 - m @ m[q]
        hits += len({f"u{j}" for j in np.argsort(far, kind="stable")[:10]} & {i for _, i, _ in found[q]})
        assert [r for r, _, _ in sorted(found[q])] == list(range(1, 11))
        assert all(d == pytest.approx(far[int(i[1:])], abs=1e-9) for _, i, d in found[q])
    pairs = ann.probed(asked, centre, probes).join(index.groupBy("cell").count(), "cell").agg(F.sum("count")).first()[0]
    share, recall = pairs / (150 * 6000), hits / 1500
    with capsys.disabled():
        print(f"\ninverted lists: {len(centre)} cells, candidates {share:.3f} of the pairs, recall@10 {recall:.3f}")
    assert share <= 0.1 and recall >= 0.9 and -1 not in found


def test_inverted_lists_read_probed_cells_only(spark, tmp_path):
    units = spark.createDataFrame([(f"u{i}", [float(x) for x in v]) for i, v in enumerate(clustered(2000, 8, 50))], "id string, vec_func array<float>")
    ann.write_index(units, str(tmp_path / "index"), cells=40)
    index, centre = ann.read_index(spark, str(tmp_path / "index"))
    asked = spark.createDataFrame([(1, [float(x) for x in clustered(1, 8, 50)[0]])], "query_id long, qv array<float>")
    plan = ann.nearest(index, centre, asked, k=3, dim=8, probes=2)._jdf.queryExecution().toString()
    assert "PushedFilters: [In(cell" in plan.replace("PushedFilters: [IsNotNull(cell), ", "PushedFilters: [")
    empty = ann.fit(units.limit(0))
    assert len(empty) == 0 and ann.nearest(ann.index_rows(units.limit(0), empty), empty, asked, k=3, dim=8).collect() == []


def test_rows_of_queries_meet_blocks_of_units(spark):
    """More queries than are shipped at once, several blocks, a null vector, copies and an unknown word."""
    units = make_units(spark, 200, copies=100).withColumn("vec_func", F.when(F.col("id") != "u0002", F.col("vec_func")))
    q = spark.createDataFrame([(str(i), f"alpha {w}") for i, w in enumerate("beta gamma delta eps alpha unknown".split() * 20)] + [(None, "beta")], "query_id string, query string")
    ready = search.prepare_queries(q, dim=DIM)
    w = vectors.lane_weights("call")
    pick = lambda d: sorted(((r.query_id, r.rank, r.id, r.score, r.d_func, r.ts_score) for r in d.collect()), key=str)
    shipped = pick(topk.score_units(units, ready, weights=w, fetch=5, dim=DIM))
    rows = topk.score_units(units, ready, weights=w, fetch=5, dim=DIM, per_pass=10, per_block=40)
    assert pick(rows) == shipped and len(shipped) == 605


def test_integer_query_ids_and_empty_query_tables(spark):
    from unitloom.operators import ann, topk

    units = spark.createDataFrame(
        [(str(i), [float(i), 1.0], [1.0, float(i)], [1.0, 1.0], "find it") for i in range(5)],
        "id string, vec_func array<float>, vec_call array<float>, vec_class array<float>, search_text string",
    )
    weights = {"w_func": 1.0, "w_call": 0.0, "w_class": 0.0, "w_fts": 0.0}
    asked = spark.createDataFrame([(7, [1.0, 1.0], ["find"])], "query_id int, qv array<float>, terms array<string>")
    rows = topk.score_units(units, asked, weights=weights, fetch=2, dim=2).collect()
    assert [r.query_id for r in rows] == [7, 7] and rows[0].id == "1"
    none = asked.limit(0)
    assert topk.score_units(units, none, weights=weights, fetch=2, dim=2).collect() == []
    centre = ann.fit(units)
    assert ann.nearest(ann.index_rows(units, centre), centre, none, k=3, dim=2).collect() == []


def test_sql_embedding_takes_few_rows_at_a_time(spark):
    """A model never gets a whole Arrow batch of texts; a NULL text or model still gives NULL."""

    def probe(words, dim):
        if len(words) > 64:
            raise ValueError(f"{len(words)} rows at once")
        return kernels.hash_vectors(words, dim)

    embedding.register_model("probe", probe)
    try:
        embedding.register_sql(spark, DIM)
        texts_of = [(i, None if i % 50 == 7 else f"word{i} and word{i % 9}", None if i % 60 == 5 else "probe") for i in range(300)]
        df = spark.createDataFrame(texts_of, "i int, text string, model string").coalesce(1)
        df = df.withColumn("words", lexical.tokens("text"))
        rows = df.selectExpr("i", "embed_text(text, model) AS t", "embed_words(words, model) AS w", "embed_text(text) AS plain").collect()
    finally:
        del embedding._models["probe"]
        embedding.register_sql(spark)
    for r, (i, text, model) in zip(sorted(rows, key=lambda r: r.i), texts_of):
        want = embed_literal(text, DIM) if text else None
        assert r.plain == want and r.t == (want if model else None)
        assert r.w == (None if model is None else want or [0.0] * DIM)


@pytest.mark.parametrize("limits", [{}, {"SQUARE_TERMS": 1}, {"PAIRS_AT_ONCE": 7, "TERM_PAIRS_AT_ONCE": 5}, {"PAIRS_AT_ONCE": 7, "SQUARE_TERMS": 1, "TERM_PAIRS_AT_ONCE": 5}])
def test_ranks_of_many_queries_list_pairs_once(monkeypatch, limits):
    """The ranks of all queries are those of each alone, near pairs are listed once for all of them."""
    for name, value in limits.items():
        monkeypatch.setattr(kernels, name, value)
    rnd = random.Random(3)
    texts_of = [rnd.choices("abcdefghijkl", k=n) for n in (1, 2, 5, 60, 400, 250)]
    queries = [set(rnd.sample("abcdefghijklz", k)) for k in (1, 1, 2, 3, 5, 9, 13)] + [{"y"}]
    rows = {}
    for key, words in enumerate(texts_of):
        for p, w in enumerate(words):
            rows.setdefault((key // 2, w), {}).setdefault(key, []).append(p * 3)
    table = pa.Table.from_pylist([{"block": b, "term": t, "top": 1, "posts": [{"key": k, "positions": p} for k, p in posts.items()]} for (b, t), posts in rows.items()])
    shard, steps = block_max.Shard(table), []
    want = {(n, k): r for n, q in enumerate(queries) for keys, ranks in [shard._ranks(*shard._asked(q))] for k, r in zip(keys.to_pylist(), ranks)}

    class Weights(np.ndarray):
        def __getitem__(self, gaps):
            steps.append(np.size(gaps))
            return np.asarray(self)[gaps]

    monkeypatch.setattr(kernels, "_NEAR_LOG", kernels._NEAR_LOG.view(Weights))
    got = {(n, k): r for query, keys, ranks in shard.ranks(queries) for n, k, r in zip(query.tolist(), keys.to_pylist(), ranks)}
    assert got == pytest.approx(want, rel=1e-12, abs=0) and len({n for n, _ in got}) == 7
    once = sum(1 for words in texts_of for i in range(len(words)) for j in range(i + 1, min(len(words), i + 34)) if words[i] != words[j])
    assert sum(steps) == once
