"""Best text ranks of one shard of postings, by blocks with their highest counts.

A shard holds whole documents, dealt into blocks; a row holds the postings of one term in one block
and the highest number of its places in a document. From these numbers follows a bound on the rank of
any document of the block, so blocks are read by falling bound until no further one can matter.
"""

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from unitloom.functions import kernels

# Ranks are compared after rounding to this many digits; a bound is raised by half a unit.
DIGITS = 9
SLACK = 1e-9
# Places that are scored at a time where all documents count.
PLACES_AT_ONCE = 500_000
# Queries whose ranks come from one listing of pairs, and rows that leave at a time.
QUERIES_AT_ONCE, ROWS_AT_ONCE = 256, 65_536
NEAREST_LOG = float(kernels._NEAR_LOG[1:].min())


def bound(sums, squares, multi):
    """Highest rank of a document whose terms occur at most tf times, from the sums of tf and tf * tf."""
    if not multi:
        steps = np.concatenate([[0.0], np.cumsum(1.0 / np.arange(1, int(sums.max(initial=0)) + 1) ** 2.0)])
        return kernels.POSITION_WEIGHT * steps[sums.astype(np.int64)] / kernels.BASEL
    pairs = (sums * sums - squares) / 2.0
    return np.where(pairs > 0, -np.expm1(pairs * NEAREST_LOG), kernels.NO_PAIR)


def block_postings(texts):
    """block, term, top, posts of the texts (block, key, words) of one block; rows of equal keys are one text."""
    column = {n: texts.column(n).combine_chunks() for n in ("key", "words")}
    flat, lengths = kernels._lists(column["words"])
    coded = _chunk(pc.dictionary_encode(column["key"], null_encoding="encode"))
    by_key = pc.array_sort_indices(coded.dictionary, null_placement="at_start")
    place = np.empty(len(by_key), np.int64)
    place[by_key.to_numpy()] = np.arange(len(by_key))
    of_row = place[coded.indices.to_numpy(zero_copy_only=False)]
    words = flat.dictionary_encode()
    key, term, pos = np.repeat(of_row, lengths), words.indices.to_numpy(zero_copy_only=False), _within(lengths) + 1
    order = np.lexsort((pos, key, term))
    key, term, pos = key[order], term[order], pos[order].astype(np.int32)
    new_term = np.diff(term, prepend=-1) != 0
    post = np.flatnonzero(new_term | (np.diff(key, prepend=-1) != 0))
    first = np.flatnonzero(new_term[post])
    count = np.diff(np.append(post, len(pos)))
    positions = pa.ListArray.from_arrays(pa.array(np.append(post, len(pos)), pa.int32()), pa.array(pos))
    keys = coded.dictionary.take(by_key).take(pa.array(key[post]))
    posts = pa.StructArray.from_arrays([keys, positions], ["key", "positions"])
    out = {
        "block": pa.repeat(texts.column("block")[0], len(first)),
        "term": words.dictionary.take(pa.array(term[post][first])),
        "top": pa.array(np.maximum.reduceat(count, first) if len(first) else count, pa.int32()),
        "posts": pa.ListArray.from_arrays(pa.array(np.append(first, len(post)), pa.int32()), posts),
    }
    return pa.table(out)


class Shard:
    """Postings rows (block, term, top, posts) of one shard, in any order."""

    def __init__(self, rows: pa.Table):
        rows = rows.sort_by("term").combine_chunks()
        posts = _chunk(rows.column("posts"))
        flat = posts.flatten()
        self.keys, places = flat.field("key"), flat.field("positions")
        self.places = places.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
        self.post_start = np.concatenate([[0], np.cumsum(np.diff(posts.offsets.to_numpy()))])
        self.place_start = np.concatenate([[0], np.cumsum(np.diff(places.offsets.to_numpy()))])
        self.block, self.top = rows.column("block").to_numpy(), rows.column("top").to_numpy().astype(np.float64)
        terms = rows.column("term").to_pylist()
        self.of_term = {}
        for i, t in enumerate(terms):
            first, _ = self.of_term.get(t, (i, i))
            self.of_term[t] = (first, i + 1)

    def best(self, terms, k, seen=None):
        """At most k (key, rank) of the documents that hold one of the distinct `terms`, best first, ties by key.

        `seen` collects the numbers of blocks scored, of blocks taken by key only and of all blocks.
        """
        rows, term, multi = self._asked(terms)
        if not len(rows):
            return []
        block, local = np.unique(self.block[rows], return_inverse=True)
        sums = np.bincount(local, weights=self.top[rows])
        squares = np.bincount(local, weights=self.top[rows] ** 2)
        most = bound(sums, squares, multi)
        order = np.argsort(local, kind="stable")
        starts = np.searchsorted(local[order], np.arange(len(block) + 1))
        kept, scored, plain, step, at = [], 0, 0, 1, 0
        ranking = np.argsort(-most, kind="stable")
        while at < len(ranking):
            last = kept[-1][0] if len(kept) >= k else None
            if last is not None and -last > most[ranking[at]] + SLACK:
                break
            some = ranking[at : at + step]
            if multi:
                flat = most[some] <= kernels.NO_PAIR
                some = some[: int(flat.argmax())] if flat.any() and not flat[0] else some
            at += len(some)
            if last is not None:
                # Equal to the last one kept at most: a block matters only with a smaller key.
                some = [b for b in some if round(most[b], DIGITS) > -last or self._least(rows[order[starts[b] : starts[b + 1]]]) < kept[-1][1]]
                if not some:
                    continue
            mine = np.concatenate([order[starts[b] : starts[b + 1]] for b in some])
            if multi and most[some[0]] <= kernels.NO_PAIR:
                # No two terms meet in these blocks: every document ranks the same.
                new, plain = self._all_same(rows[mine]), plain + len(some)
            else:
                new, scored = self._exact(rows[mine], term[mine], multi, k), scored + len(some)
            kept = sorted(kept + new)[:k]
            step = min(64, 2 * step)
        if seen is not None:
            seen.append((scored, plain, len(block)))
        return [(key, exact) for _, key, exact in kept]

    def all(self, terms):
        """(keys, ranks) of all documents that hold one of the distinct `terms`, some blocks at a time."""
        for _, keys, ranks in self.ranks([terms]):
            yield keys, ranks

    def ranks(self, queries):
        """(numbers of queries, keys, ranks) for all documents that share a term with lists of terms, some blocks at a time."""
        queries = [set(terms) for terms in queries]
        rows, term, _ = self._asked(known := sorted(set().union(*queries) & self.of_term.keys()))
        member = np.array([[t in q for q in queries] for t in known], np.float64).reshape(len(known), len(queries))
        multi = np.array([len(q) > 1 for q in queries], bool)
        order = np.argsort(self.block[rows], kind="stable")
        rows, term = rows[order], term[order]
        ends = np.append(np.flatnonzero(np.diff(self.block[rows])) + 1, len(rows))
        places = np.cumsum(self.place_start[self.post_start[rows + 1]] - self.place_start[self.post_start[rows]])
        start = done = 0
        for end, after in zip(ends.tolist(), [*ends[1:].tolist(), None]):
            if after is None or places[after - 1] - done > PLACES_AT_ONCE:
                if end > start:
                    keys, key, place, of_place = self._places(rows[start:end], term[start:end])
                    key, query, ranks = kernels.ranks_of_queries(key, place, of_place, member, multi)
                    yield query, keys.take(pa.array(key)), ranks
                    start, done = end, places[end - 1]

    def _asked(self, terms):
        """Rows of the distinct `terms`, the number of the term of each, and whether there are several terms."""
        terms = sorted(set(terms))
        found = [(n, *self.of_term[t]) for n, t in enumerate(terms) if t in self.of_term]
        none = np.zeros(0, np.int64)
        rows = np.concatenate([none, *[np.arange(a, b) for _, a, b in found]])
        return rows, np.concatenate([none, *[np.full(b - a, n) for n, a, b in found]]), len(terms) > 1

    def _least(self, rows):
        return min(self.keys[int(i)].as_py() for i in self.post_start[rows])

    def _posts(self, rows):
        lengths = self.post_start[rows + 1] - self.post_start[rows]
        return np.repeat(self.post_start[rows], lengths) + _within(lengths), lengths

    def _all_same(self, rows):
        posts, _ = self._posts(rows)
        return [(-round(kernels.NO_PAIR, DIGITS), key, kernels.NO_PAIR) for key in set(self.keys.take(pa.array(posts)).to_pylist())]

    def _places(self, rows, term):
        """Distinct keys of the rows, and number of the key, position and term of every place."""
        posts, lengths = self._posts(rows)
        keys = _chunk(pc.dictionary_encode(self.keys.take(pa.array(posts)), null_encoding="encode"))
        code, term = keys.indices.to_numpy().astype(np.int64), np.repeat(term, lengths)
        n = self.place_start[posts + 1] - self.place_start[posts]
        place = self.places[np.repeat(self.place_start[posts], n) + _within(n)]
        return keys.dictionary, np.repeat(code, n), place, np.repeat(term, n)

    def _ranks(self, rows, term, multi):
        keys, key, place, term = self._places(rows, term)
        return keys, kernels.group_ranks(key, place, term, np.full(len(keys), multi))

    def _exact(self, rows, term, multi, k):
        keys, ranks = self._ranks(rows, term, multi)
        rounded = np.round(ranks, DIGITS)
        top = np.arange(len(ranks)) if len(ranks) <= k else np.flatnonzero(rounded >= np.partition(rounded, -k)[-k] - SLACK)
        return [(-round(float(ranks[i]), DIGITS), keys[int(i)].as_py(), float(ranks[i])) for i in top]


def _chunk(column):
    return column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column


def _within(lengths):
    return np.arange(lengths.sum()) - np.repeat(np.cumsum(lengths) - lengths, lengths)


def best_of_shards(k, query_type, key_type):
    """Streams over rows sorted by (shard, role): the postings of a shard, then the queries that ask it.

    Without `k` all documents that share a term with a query are returned.
    """
    names = ["query_id", "key", "ts_score"]

    def run(batches):
        at, held, shard = None, [], None
        for batch in batches:
            number, role = batch.column("shard").to_numpy(), batch.column("role").to_numpy()
            start = 0
            while start < batch.num_rows:
                same = (number[start:] == number[start]) & (role[start:] == role[start])
                end = start + (int(same.argmin()) if not same.all() else len(same))
                part = batch.slice(start, end - start)
                if number[start] != at:
                    at, held, shard = number[start], [], None
                if role[start] == 0:
                    held.append(part.select(["block", "term", "top", "posts"]))
                elif held:
                    shard = shard or Shard(pa.Table.from_batches(held))
                    if k is None:
                        for first in range(0, part.num_rows, QUERIES_AT_ONCE):
                            some = part.slice(first, QUERIES_AT_ONCE)
                            for query, keys, ranks in shard.ranks(some.column("terms").to_pylist()):
                                found = [some.column("query_id").take(pa.array(query)), keys.cast(key_type), pa.array(ranks)]
                                for at in range(0, len(query), ROWS_AT_ONCE):
                                    yield pa.RecordBatch.from_arrays([c.slice(at, ROWS_AT_ONCE) for c in found], names)
                        start = end
                        continue
                    out = [
                        (query, key, rank)
                        for query, terms in zip(part.column("query_id").to_pylist(), part.column("terms").to_pylist())
                        for key, rank in shard.best(terms, k)
                    ]
                    columns = zip(*out) if out else [()] * 3
                    arrays = [pa.array(c, t) for c, t in zip(columns, (query_type, key_type, pa.float64()))]
                    yield pa.RecordBatch.from_arrays(arrays, names)
                start = end

    return run
