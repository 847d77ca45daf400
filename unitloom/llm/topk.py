"""Exact top-k by inner product over an impact-ordered index, score at a time.

The index part of a shard of vectors holds, for every dimension, postings in the order of their
quantised impact. For a query, posting segments of all dimensions are processed by descending
contribution level. Partial scores and what is left of each vector bound its final score; processing
stops when few vectors can still be among the best, and those are rescored exactly. The stop is a
proof, so results are exact for any data; without a proof the index is processed to its end.
"""

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

SCALE = 1024
SHARD, QUERY_BLOCK = 8_192, 4_096
# Levels of contribution: each ends at 1 / STEP of the one before.
STEP, LEVELS = 5, 5


class ImpactIndex:
    """Postings of one shard: for each dimension, rows by descending impact."""

    def __init__(self, ids, vectors):
        self.ids, self.vectors = ids, vectors
        order = np.argsort(-vectors, axis=0, kind="stable")
        self.rows = np.ascontiguousarray(order.T)
        self.impacts = np.ascontiguousarray(np.take_along_axis(vectors, order, axis=0).T)
        self.keys = -self.impacts  # ascending, for the search of segment ends
        self.energy = (vectors.astype(np.float64) ** 2).sum(axis=1)

    def _segments(self, dim, weight, above, upto):
        """Ranges of a dimension's postings with above >= |impact * weight| > upto: large impacts, small ones."""
        keys, w = self.keys[dim], abs(weight)
        ends = np.searchsorted(keys, (-(above // w), -(upto // w)), "left")
        starts = np.searchsorted(keys, (upto // w, above // w), "right")
        return slice(*ends), slice(*starts)

    def best(self, query, k, own):
        """(ids, scores) of the k best rows by (score, smaller id), without the row `own`."""
        n = len(self.ids)
        skip = np.flatnonzero(self.ids == own) if own is not None else []
        score, left_energy = np.zeros(n), self.energy.copy()
        left_query = np.full(n, float((query.astype(np.float64) ** 2).sum()))
        unseen = np.full(n, np.count_nonzero(query), np.int64)
        dims = [d for d in np.argsort(-np.abs(query), kind="stable") if query[d]]
        high = int(max((max(self.impacts[d][0], -self.impacts[d][-1]) * abs(query[d]) for d in dims), default=0))
        floor, above, members = None, high, np.arange(n)
        for upto in dict.fromkeys(high // STEP**i for i in range(1, LEVELS)):
            rows, impacts, weights = [], [], []
            for d in dims:
                for part in self._segments(d, int(query[d]), above, upto):
                    if part.start < part.stop:
                        rows.append(self.rows[d][part])
                        impacts.append(self.impacts[d][part])
                        weights.append((len(rows[-1]), query[d]))
            above = upto
            if not rows:
                continue
            rows, impacts = np.concatenate(rows), np.concatenate(impacts).astype(float)
            counts, values = np.array(weights).T
            weights = np.repeat(values.astype(float), counts)
            score += np.bincount(rows, impacts * weights, n)
            left_query -= np.bincount(rows, weights * weights, n)
            left_energy -= np.bincount(rows, impacts * impacts, n)
            unseen -= np.bincount(rows, minlength=n)
            bound = score + np.minimum(unseen * float(upto), np.sqrt(np.maximum(left_query, 0) * np.maximum(left_energy, 0))) + 1
            bound[skip] = -np.inf
            if n > 4 * k:
                likely = np.argpartition(-score, 2 * k)[: 2 * k]
                likely = likely[~np.isin(likely, skip)]
                exact = np.sort(self.vectors[likely] @ query)
                if len(exact) >= k:
                    floor = exact[-k] if floor is None else max(floor, exact[-k])
                    members = np.flatnonzero(bound >= floor)
                    if len(members) <= max(4 * k, n // 8):
                        break
        members = members[~np.isin(members, skip)]
        exact = self.vectors[members] @ query
        order = np.lexsort((self.ids[members], -exact))[:k]
        return self.ids[members][order], exact[order]


def _search(k):
    def run(table):
        kind = table.column("is_query").to_numpy(zero_copy_only=False)
        vectors, lists = _matrix(table.column("q"))
        ids = table.column("vec_id").to_numpy()
        out = ([], [], [])
        for size in np.unique(lists):
            rows, queries = np.flatnonzero(~kind & (lists == size)), np.flatnonzero(kind & (lists == size))
            if not len(rows) or not len(queries) or not size:
                continue
            index = ImpactIndex(ids[rows], np.array([vectors[i] for i in rows], np.int64).reshape(len(rows), size))
            for q in queries:
                found, scores = index.best(np.asarray(vectors[q], np.int64), k, ids[q])
                out[0].append(np.full(len(found), ids[q]))
                out[1].append(found)
                out[2].append(scores)
        cat = lambda parts: np.concatenate(parts).astype(np.int64) if parts else np.zeros(0, np.int64)
        return pa.table({"query_id": cat(out[0]), "vec_id": cat(out[1]), "score": cat(out[2])})

    return run


def _matrix(column):
    column = column.combine_chunks()
    offsets = column.offsets.to_numpy()
    flat = column.flatten().to_numpy()
    offsets = offsets - offsets[0]
    return [flat[a:b] for a, b in zip(offsets[:-1], offsets[1:])], np.diff(offsets)


def quantised(vectors: DataFrame) -> DataFrame:
    """(vec_id, q): components as floor(SCALE * x); vectors that are null, empty or not finite are left out."""
    finite = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return vectors.filter(F.col("vec_id").isNotNull() & F.coalesce(finite, F.lit(False)) & (F.size("embedding") > 0)).select(
        F.col("vec_id").cast("long").alias("vec_id"), F.transform("embedding", lambda x: F.floor(x.cast("double") * SCALE)).alias("q")
    )


def top_k(vectors: DataFrame, queries: DataFrame, k: int = 10, shard: int = SHARD, query_block: int = QUERY_BLOCK) -> DataFrame:
    """(query_id, rank, vec_id, score): the `k` best rows of `vectors` (vec_id, q) for every row of `queries` (vec_id, q).

    Score: integer inner product of vectors of the same length; ties go to the smaller vec_id; a row
    is no candidate for the query of its own vec_id; fewer candidates give fewer rows. Repeated rows
    count once. Vectors are dealt to shards of about `shard` rows by the hash of vec_id, queries to
    blocks of about `query_block`; each shard meets each block in one task, which returns k rows a
    query. Empty tables give no rows; further columns play no part.
    """
    vectors = vectors.select("vec_id", "q").distinct()
    queries = queries.select("vec_id", "q").distinct()
    n, m = vectors.count(), queries.count()
    shards, blocks = max(1, -(-n // shard)), max(1, -(-m // query_block))
    cells = lambda count: F.explode(F.sequence(F.lit(0).cast("long"), F.lit(count - 1).cast("long")))
    rows = vectors.select("vec_id", "q", F.pmod(F.xxhash64("vec_id"), F.lit(shards)).alias("shard"), cells(blocks).alias("block"), F.lit(False).alias("is_query"))
    asked = queries.select("vec_id", "q", cells(shards).alias("shard"), F.pmod(F.xxhash64("vec_id"), F.lit(blocks)).alias("block"), F.lit(True).alias("is_query"))
    found = rows.unionByName(asked).groupBy("shard", "block").applyInArrow(_search(k), "query_id long, vec_id long, score long")
    ranked = found.selectExpr("*", "row_number() over (partition by query_id order by score desc, vec_id) as rank")
    return ranked.filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
