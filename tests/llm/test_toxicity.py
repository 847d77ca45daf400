import random

import numpy as np
from pyspark.sql import functions as F

from unitloom.llm.toxicity import RATE, RIDGE, STEPS, Features, descend, fit, held_out, score

SF = "/root/testdata/sf0.1"


def test_held_out_rows_of_the_given_labels(spark):
    docs, labels = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")
    scored = score(docs, fit(docs, labels)).filter(held_out()).join(labels.select("doc_id", "toxic"), "doc_id")
    rows = scored.select("predicted", "toxic").collect()
    hit = sum(r.predicted == r.toxic for r in rows) / len(rows)
    found = sum(r.predicted for r in rows if r.toxic == 1) / sum(r.toxic for r in rows)
    false = sum(r.predicted for r in rows if r.toxic == 0) / sum(1 - r.toxic for r in rows)
    print(hit, found, false)
    assert hit > 0.98 and found > 0.88 and false < 0.01


def identity_sample(spark):
    rng = random.Random(3)
    words = ["tree", "house", "river", "light", "paper", "green", "small", "music"]
    rows = []
    for i in range(3000):
        text = [rng.choice(words) for _ in range(12)]
        bad = rng.random() < 0.3
        if bad:
            text.insert(3, rng.choice(["rotten", "vile"]))
        # One group is mentioned far more often in toxic texts.
        if rng.random() < (0.8 if bad else 0.05):
            text.insert(5, "muslim")
        if rng.random() < 0.2:
            text.insert(6, "christian")
        rows.append((i, " ".join(text), int(bad)))
    return spark.createDataFrame(rows, "doc_id long, text string, toxic int")


def test_swapped_identity_terms_score_alike(spark):
    data = identity_sample(spark)
    docs, labels = data.select("doc_id", "text"), data.select("doc_id", "toxic")
    texts = ["tree house river light", "tree house muslim river light", "tree house christian river light", "tree rotten house vile light"]
    asked = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    got = {}
    for penalty in (0.0, 4.0):
        out = score(asked, fit(docs, labels, swap_penalty=penalty)).orderBy("doc_id").collect()
        got[penalty] = [r.score for r in out]
    assert abs(got[4.0][1] - got[4.0][2]) < 0.3 * abs(got[0.0][1] - got[0.0][2])
    assert got[4.0][1] < 0.5 and got[4.0][2] < 0.5 and got[4.0][3] > 0.9


def test_odd_rows(spark):
    docs = spark.createDataFrame(
        [(1, None, "a", 9.0), (None, "rotten vile", "b", 9.0), (3, "", "c", 9.0), (3, "tree rotten", "d", 9.0), (4, "x" * 100_000, None, None), (5, "wörd " * 30_000, "e", 1.0)],
        "doc_id long, text string, lang string, score double",
    )
    data = identity_sample(spark)
    labels = data.select("doc_id", "toxic").union(spark.createDataFrame([(None, 1), (7, None), (8, 5), (9, 0), (9, 1)], "doc_id long, toxic int"))
    model = fit(data.drop("toxic"), labels)
    out = score(docs, model).collect()
    assert len(out) == 6 and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in out)
    assert out[0].score == out[2].score and [r.predicted for r in out[:4]] == [0, 1, 0, 1]
    empty = spark.createDataFrame([], "doc_id long, text string, toxic int")
    assert score(empty, model).collect() == [] and score(docs, fit(empty, empty)).filter("predicted = 1").count() == 0
    assert score(docs, fit(data, data.filter("toxic = 0"))).agg(F.max("score")).first()[0] < 0.01


def test_held_out_rows_never_train(spark):
    data = identity_sample(spark)
    flipped = data.withColumn("toxic", F.when(held_out(), 1 - F.col("toxic")).otherwise(F.col("toxic")))
    a, b = fit(data, data), fit(data, flipped)
    assert np.array_equal(a.features, b.features) and np.array_equal(a.weights, b.weights)


def test_scores_do_not_depend_on_the_file_layout(spark):
    data = identity_sample(spark)
    models = [fit(data.select("doc_id", "text").repartition(n), data.select("doc_id", "toxic").repartition(n)) for n in (1, 7, 50)]
    for m in models[1:]:
        assert np.array_equal(m.features, models[0].features) and np.array_equal(m.weights, models[0].weights) and m.bias == models[0].bias


def dense_fit(own, added, dropped, toxic, n_features, penalty):
    """The same descent on dense matrices, row by row as the formulas read."""
    n = len(toxic)
    x, more, fewer = (np.zeros((n, n_features)) for _ in range(3))
    for matrix, lists in ((x, own), (more, added), (fewer, dropped)):
        for i, found in enumerate(lists):
            matrix[i, list(found)] = 1
    change_of = more - fewer
    mean = toxic.mean()
    bias, weights = np.log((mean + 1e-3) / (1 - mean + 1e-3)), np.zeros(n_features)
    share = min(max(mean, 0.25), 0.75)
    weight_of = np.where(toxic == 1, share / toxic.sum(), (1 - share) / (n - toxic.sum()))
    sums, bias_sum = np.full(n_features, 1e-8), 1e-8
    for _ in range(STEPS):
        score_of = 1 / (1 + np.exp(-(x @ weights + bias)))
        slope = weight_of * (score_of - toxic)
        gradient = x.T @ slope + RIDGE * weights + change_of.T @ (2 * penalty * (change_of @ weights) / n)
        sums += gradient**2
        weights = weights - RATE * gradient / np.sqrt(sums)
        bias_sum += slope.sum() ** 2
        bias -= RATE * slope.sum() / np.sqrt(bias_sum)
    return weights, bias


def test_descent_equals_dense_matrices():
    rng = np.random.default_rng(5)
    n, k = 200, 30
    own = [sorted(rng.choice(k, rng.integers(0, 8), replace=False).tolist()) for _ in range(n)]
    added = [sorted(set(rng.choice(k, 2).tolist()) - set(o)) if i % 3 == 0 else [] for i, o in enumerate(own)]
    dropped = [o[:1] if i % 3 == 0 else [] for i, o in enumerate(own)]
    toxic = (rng.random(n) < 0.3).astype(np.int64)
    for penalty in (0.0, 4.0):
        got, want = descend(own, added, dropped, toxic, k, penalty), dense_fit(own, added, dropped, toxic, k, penalty)
        assert np.allclose(got[0], want[0], atol=1e-9) and abs(got[1] - want[1]) < 1e-9


def test_scores_equal_word_by_word_sums(spark):
    """Features read one at a time from the text: words, and the first letters of longer ones."""
    data = identity_sample(spark)
    model = fit(data.drop("toxic"), data.select("doc_id", "toxic"))
    weight = dict(zip(model.features.tolist(), model.weights.tolist()))
    reader = Features()
    texts = ["tree rotten house", "Muslim vile vile river", "", "nothing known here", "light paper christian rottenness"]
    asked = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    for r in score(asked, model).collect():
        found = {int(f) for w in texts[r.doc_id].split() for f in reader.of_word(w)}
        total = model.bias + sum(weight.get(f, 0.0) for f in found)
        assert abs(r.score - 1 / (1 + np.exp(-total))) < 1e-9
