"""A toxicity classifier that identity terms do not sway.

Logistic regression on the presence of words and word beginnings. Besides the labelled texts the fit sees
their counterfactuals, in which identity terms are swapped for others of their group, and pays for
every change of the score that a swap makes.
"""

import zlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from unitloom.llm.bytes_kernel import SIGNS, Powers, SpanHash, U, byte_codes, chunks, word_bounds
from unitloom.llm.shared import saved, small

# Fit bounds: labelled rows drawn by the hash of their ids, and features kept.
SAMPLE_ROWS, FEATURES = 20_000, 1_024
BEGINNING = 5
STEPS, RATE, RIDGE, SWAP_PENALTY = 300, 0.5, 1e-3, 4.0

# Groups of identity terms that may stand for each other.
IDENTITY = [
    "man woman", "men women", "boy girl", "he she",
    "christian muslim jewish hindu buddhist sikh atheist", "christians muslims jews hindus buddhists atheists",
    "black white asian latino arab", "gay lesbian straight bisexual transgender", "american mexican chinese indian african european",
    "deaf blind disabled", "old young", "immigrant native refugee", "immigrants natives refugees",
]


class Features:
    """Hashes of the words and word beginnings of texts, A-Z in lower case."""

    def __init__(self):
        self.hash = SpanHash(byte_codes(61, fold_case=True), Powers(62))

    def of(self, data, offsets):
        """(text number, feature) pairs, one for each word and for each beginning of a longer word."""
        start, end, words = word_bounds(data, offsets, SIGNS)
        text = np.repeat(np.arange(len(offsets) - 1), np.diff(words))
        read = self.hash.read(data)
        long = np.flatnonzero(end - start > BEGINNING)
        head = read.of(start[long], start[long] + BEGINNING) ^ U(0x9E3779B97F4A7C15)
        return np.r_[text, text[long]], np.r_[read.of(start, end), head]

    def of_word(self, word):
        data = np.frombuffer(word.encode(), np.uint8)
        return self.of(data, np.array([0, len(data)]))[1]


class Vocabulary:
    """Numbers of known features; most others are refused by a small table."""

    def __init__(self, features):
        self.features = np.sort(np.asarray(features, U))
        self.maybe = np.zeros(1 << 18, bool)
        self.maybe[self.features >> U(46)] = True

    def numbers(self, text, feature):
        """Distinct (text, number) pairs of the known features, in order of the texts."""
        some = np.flatnonzero(self.maybe[feature >> U(46)])
        text, feature = text[some], feature[some]
        at = np.minimum(np.searchsorted(self.features, feature), max(len(self.features) - 1, 0))
        known = self.features[at] == feature if len(self.features) else np.zeros(0, bool)
        pairs = np.unique(text[known] * (1 << 20) + at[known])
        return pairs >> 20, pairs & ((1 << 20) - 1)


@dataclass
class Model:
    features: np.ndarray
    weights: np.ndarray
    bias: float


def _counts():
    """(feature, positive, negative) numbers of texts of each batch that hold a feature."""

    def run(batches):
        reader = Features()
        for batch in batches:
            toxic = batch.column("toxic").to_numpy()
            seen, labels = [np.zeros(0, U)], [np.zeros(0, np.int64)]
            for row, data, offsets in chunks(batch.column("text")):
                text, feature = reader.of(data, offsets)
                order = np.lexsort((feature, text))
                text, feature = text[order], feature[order]
                new = np.r_[True, (text[1:] != text[:-1]) | (feature[1:] != feature[:-1])] if len(text) else np.zeros(0, bool)
                seen.append(feature[new])
                labels.append(toxic[row + text[new]])
            names, which = np.unique(np.concatenate(seen), return_inverse=True)
            labels = np.concatenate(labels)
            positive = np.bincount(which.ravel(), labels, len(names)).astype(np.int64)
            total = np.bincount(which.ravel(), minlength=len(names))
            yield pa.RecordBatch.from_arrays([pa.array(names.view(np.int64)), pa.array(positive), pa.array(total - positive)], ["feature", "positive", "negative"])

    return run


def swaps(groups=IDENTITY):
    """Word features of each identity term, and the terms that may replace it."""
    reader = Features()
    terms = [(term, g) for g, group in enumerate(groups) for term in group.split()]
    features = [reader.of_word(term) for term, _ in terms]
    others = [[j for j, (_, h) in enumerate(terms) if h == g and j != i] for i, (_, g) in enumerate(terms)]
    return features, others


def _rows(features, groups):
    """Known features of each labelled text, and the features its counterfactual adds and drops."""

    def run(batches):
        reader, vocabulary = Features(), Vocabulary(features)
        term_features, others = swaps(groups)
        numbers = [set(vocabulary.numbers(np.zeros(len(f), np.int64), f)[1].tolist()) for f in term_features]
        word = {int(np.searchsorted(vocabulary.features, f[0])): i for i, f in enumerate(term_features)}
        for batch in batches:
            out = []
            for _, data, offsets in chunks(batch.column("text")):
                text, number = vocabulary.numbers(*reader.of(data, offsets))
                bounds = np.searchsorted(text, np.arange(len(offsets)))
                for i in range(len(offsets) - 1):
                    own = number[bounds[i] : bounds[i + 1]]
                    found = [word[n] for n in own.tolist() if n in word]
                    dropped = set().union(*(numbers[t] for t in found)) if found else set()
                    # The term that comes in follows from the text, wherever its row lies.
                    pick = zlib.crc32(data[offsets[i] : offsets[i + 1]].tobytes()) if found else 0
                    added = set().union(*(numbers[others[t][(pick + t) % len(others[t])]] for t in found)) if found else set()
                    base = set(own.tolist()) - dropped
                    out.append((own.tolist(), sorted(added - dropped - base), sorted(dropped - added)))
            a, b, c = zip(*out) if out else ([], [], [])
            kind = pa.list_(pa.int32())
            yield pa.RecordBatch.from_arrays([batch.column("toxic"), pa.array(a, kind), pa.array(b, kind), pa.array(c, kind)], ["toxic", "own", "added", "dropped"])

    return run


def _sparse(lists):
    rows = np.repeat(np.arange(len(lists)), [len(x) for x in lists])
    return rows, np.concatenate([np.asarray(x, np.int64) for x in lists]) if len(lists) else np.zeros(0, np.int64)


def descend(own, added, dropped, toxic, n_features, swap_penalty=SWAP_PENALTY):
    """Weights and bias by full-batch adaptive gradient descent; the number of steps is fixed."""
    n = len(toxic)
    rows, cols = _sparse(own)
    more, fewer = _sparse(added), _sparse(dropped)
    weights, bias = np.zeros(n_features), float(np.log((toxic.mean() + 1e-3) / (1 - toxic.mean() + 1e-3)))
    # Both labels weigh alike in the fit, at least by a quarter each.
    share = min(max(toxic.mean(), 0.25), 0.75)
    per_row = np.where(toxic == 1, share / max(toxic.sum(), 1), (1 - share) / max(n - toxic.sum(), 1))
    sums, bias_sum = np.full(n_features, 1e-8), 1e-8
    for _ in range(STEPS):
        score = 1 / (1 + np.exp(-np.clip(bias + np.bincount(rows, weights[cols], n), -30, 30)))
        slope = (score - toxic) * per_row
        change = np.bincount(more[0], weights[more[1]], n) - np.bincount(fewer[0], weights[fewer[1]], n)
        pull = 2 * swap_penalty * change / n
        gradient = np.bincount(cols, slope[rows], n_features) + RIDGE * weights
        gradient += np.bincount(more[1], pull[more[0]], n_features) - np.bincount(fewer[1], pull[fewer[0]], n_features)
        sums += gradient**2
        weights -= RATE * gradient / np.sqrt(sums)
        bias_sum += slope.sum() ** 2
        bias -= RATE * slope.sum() / np.sqrt(bias_sum)
    return weights, bias


def fit(docs: DataFrame, labels: DataFrame, groups=IDENTITY, sample_rows: int = SAMPLE_ROWS, features: int = FEATURES, swap_penalty: float = SWAP_PENALTY) -> Model:
    """A model from at most about `sample_rows` labelled rows; rows whose crc32(doc_id) mod 5 is 0 are never used.

    Labels other than 0 and 1 are ignored; of repeated labels of a document the highest counts. The
    features are those that tell the labels apart best by the log-likelihood ratio, and the identity
    terms. Without both labels the model is the share of label 1.
    """
    marked = labels.filter(F.col("doc_id").isNotNull() & F.col("toxic").isin(0, 1)).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    marked = marked.filter(F.crc32(F.col("doc_id").cast("string")) % 5 != 0)
    total = marked.count()
    kept = marked if total <= sample_rows else marked.filter(F.pmod(F.xxhash64("doc_id"), F.lit(1_000_003)) < int(1_000_003 * sample_rows / total))
    kept = kept.select(F.col("doc_id").alias("_id"), F.col("toxic").cast("long").alias("toxic"))
    sample = saved(docs.select(F.col("doc_id").alias("_doc"), "text").join(small(kept), F.col("_doc") == F.col("_id")).select("text", "toxic"))
    n, positive = sample.agg(F.count("*"), F.sum("toxic")).first()
    if not n or not positive or positive == n:
        return Model(np.zeros(0, U), np.zeros(0), float(np.log(((positive or 0) + 1e-3) / (n - (positive or 0) + 1))))
    counts = sample.mapInArrow(_counts(), "feature long, positive long, negative long").groupBy("feature").agg(
        F.sum("positive").alias("p"), F.sum("negative").alias("q")
    ).filter("p + q >= 3")
    p, q, rest, none = F.col("p"), F.col("q"), F.lit(positive) - F.col("p"), F.lit(n - positive) - F.col("q")
    part = lambda k, row, col: F.when(k > 0, k * F.log(k * F.lit(float(n)) / (row * col))).otherwise(0.0)
    ratio = part(p, p + q, F.lit(positive)) + part(q, p + q, F.lit(n - positive)) + part(rest, rest + none, F.lit(positive)) + part(none, rest + none, F.lit(n - positive))
    best = counts.select("feature", ratio.alias("ratio")).orderBy(F.desc("ratio"), "feature").limit(features).toPandas()["feature"]
    identity = np.concatenate(swaps(groups)[0]) if groups else np.zeros(0, U)
    chosen = np.unique(np.r_[best.to_numpy(np.int64).view(U), identity])
    rows = sample.mapInArrow(_rows(chosen, groups), "toxic long, own array<int>, added array<int>, dropped array<int>").collect()
    # In an order of their own, so that sums do not depend on where the rows lay.
    toxic, own, added, dropped = zip(*sorted(map(tuple, rows)))
    weights, bias = descend(own, added, dropped, np.array(toxic), len(chosen), swap_penalty)
    return Model(chosen, weights, bias)


def score(docs: DataFrame, model: Model) -> DataFrame:
    """`docs` with score (0 to 1; double) and predicted (1 if score >= 0.5) added; only `text` is read.

    Whole texts count; null and empty texts get the score of no features. Repeated rows and ids each
    get their own score; clashing columns are replaced; an empty table gives no rows.
    """
    held = docs.sparkSession.sparkContext.broadcast(model)  # at most FEATURES and the identity terms
    state = []

    @F.arrow_udf("double")
    def scores(texts: pa.Array) -> pa.Array:
        if not state:
            state.extend((Features(), Vocabulary(held.value.features)))
        reader, vocabulary = state
        total = np.full(len(texts), held.value.bias)
        for row, data, offsets in chunks(texts):
            text, number = vocabulary.numbers(*reader.of(data, offsets))
            total[row : row + len(offsets) - 1] += np.bincount(text, held.value.weights[number], len(offsets) - 1)
        return pa.array(1 / (1 + np.exp(-np.clip(total, -500, 500))))

    keep = [c for c in docs.columns if c not in ("score", "predicted")]
    scored = docs.select(*keep, scores("text").alias("score"))
    return scored.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))


def held_out(doc_id: str = "doc_id"):
    """True for rows that the fit never sees; rows without an id are not held out."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string")) % 5 == 0, F.lit(False))
