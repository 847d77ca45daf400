"""Array helpers that run on Arrow batches inside Spark tasks.

Everything here works on one batch (or one row) at a time; Spark decides the
partitioning, the shuffles and the merge of the partial results.
"""

import hashlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

# Fixed values of the text rank: position weight, far pair, no pair, pi^2/6.
POSITION_WEIGHT = 0.1
FAR_PAIR = 1e-30
NO_PAIR = 1e-20
BASEL = 1.64493406685
NEAR_SPAN = 100

SCORE_DIGITS = 9
CELLS_PER_SLICE = 2_000_000


# Words whose digests a worker keeps, those it met first.
KEPT_WORDS = 50_000
_digests = {}


def _digest(word):
    """The first five bytes of the digest of a word, as a number."""
    found = int.from_bytes(hashlib.md5(word.encode("utf-8")).digest()[:5], "big")
    if len(_digests) < KEPT_WORDS:
        _digests[word] = found
    return found


def _buckets_and_signs(words, dim):
    """Of each word: the first four bytes of its digest modulo `dim`, and the sign by the bit that follows."""
    known = _digests.get
    digests = np.array([d if (d := known(w)) is not None else _digest(w) for w in words], np.int64)
    return (digests >> 8) % dim, np.where(digests & 0x80, -1.0, 1.0)


def _lists(column):
    """Flat values and row lengths of a list column (a NULL row counts 0)."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    lengths = pc.fill_null(pc.list_value_length(column), 0).to_numpy(zero_copy_only=False)
    return pc.list_flatten(column), lengths.astype(np.int64)


class Words:
    """Cuts texts into their lower-cased words, a column at a time; every character is judged by `non_word` once."""

    UNKNOWN = 2

    def __init__(self, non_word):
        self.non_word, self.kind = non_word, np.full(0x110000, self.UNKNOWN, np.uint8)

    def _inside(self, chars):
        kind = self.kind[chars]
        if (new := kind == self.UNKNOWN).any():
            for c in np.unique(chars[new]).tolist():
                self.kind[c] = self.non_word.fullmatch(chr(c)) is None
            kind = self.kind[chars]
        return kind.astype(bool)

    def of(self, texts):
        """list<string> of the words of every text; no text is null."""
        low = [t.lower() for t in texts.to_pylist()]
        ends = np.concatenate([[0], np.cumsum([len(t) for t in low], dtype=np.int64)])
        chars = np.frombuffer("".join(low).encode("utf-32-le"), np.uint32)
        inside = self._inside(chars)
        starts_text = np.zeros(len(chars) + 1, bool)
        starts_text[ends] = True
        begin = inside.copy()
        begin[1:] &= ~inside[:-1] | starts_text[1:-1]
        first = np.flatnonzero(begin)
        size = (1 + (chars > 0x7F) + (chars > 0x7FF) + (chars > 0xFFFF)) * inside
        bounds = np.zeros(len(first) + 1, np.int32)
        if len(first):
            np.cumsum(np.add.reduceat(size, first), out=bounds[1:])
        data = chars[inside].tobytes().decode("utf-32-le").encode("utf-8")
        words = pa.StringArray.from_buffers(len(first), pa.py_buffer(bounds), pa.py_buffer(data))
        return pa.ListArray.from_arrays(pa.array(np.searchsorted(first, ends), pa.int32()), words)


def hash_vectors(tokens, dim):
    """Signed feature hashing: one L2-normed row of `dim` floats per token list."""
    flat, lengths = _lists(tokens)
    n = len(lengths)
    if n == 0:
        return np.zeros((0, dim), np.float32)
    coded = flat.dictionary_encode()
    bucket, sign = _buckets_and_signs(coded.dictionary.to_pylist(), dim)
    code = coded.indices.to_numpy(zero_copy_only=False)
    rows = np.repeat(np.arange(n, dtype=np.int64), lengths)
    if len(code) == 0:
        return np.zeros((n, dim), np.float32)
    sums = np.bincount(rows * dim + bucket[code], weights=sign[code], minlength=n * dim)
    sums = sums.reshape(n, dim)
    norm = np.sqrt((sums * sums).sum(axis=1, keepdims=True))
    norm[norm == 0] = 1.0
    return (sums / norm).astype(np.float32)


def vectors_to_lists(matrix):
    n, dim = matrix.shape
    offsets = pa.array(np.arange(0, (n + 1) * dim, dim, dtype=np.int32))
    return pa.ListArray.from_arrays(offsets, pa.array(matrix.reshape(-1), pa.float32()))


def unit_rows(column, dim):
    """Vectors of a list column scaled to length 1; NaN for NULL or zero vectors."""
    flat, lengths = _lists(column)
    if not np.isin(lengths, (0, dim)).all():
        raise ValueError(f"every vector must have {dim} elements")
    out = np.full((len(lengths), dim), np.nan)
    full = lengths == dim
    values = flat.to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dim)
    norm = np.sqrt((values * values).sum(axis=1, keepdims=True))
    norm[norm == 0] = np.nan
    out[full] = values / norm
    return out


_distances = np.arange(NEAR_SPAN + 1, dtype=np.float64)
_NEAR_LOG = np.log1p(
    -POSITION_WEIGHT * np.sqrt(1.0 / (1.005 + 0.05 * np.exp(_distances / 1.5 - 2.0)))
)
_FAR_LOG = float(np.log1p(-POSITION_WEIGHT * np.sqrt(FAR_PAIR)))
# With a sum of logs below this the rank is 1 in double precision, whatever pairs follow.
FULL_LOG = -40.0


def group_ranks(group, pos, term, multi):
    """Text rank per group of (position, term) rows.

    `group` numbers the groups 0..n-1, `multi[g]` tells whether the query behind
    group g has more than one distinct term. Pairs further apart than NEAR_SPAN all
    weigh the same, so they are counted instead of being listed. All logs are negative, so a group
    whose rank has come to 1 needs no further pairs.
    """
    n = len(multi)
    order = np.lexsort((pos, group))
    group, pos, term = group[order], pos[order], term[order]
    logs = np.zeros(n)
    near = np.zeros(n)
    # Groups lie too far apart to be near; a row whose partner is no longer near has no nearer one further on.
    line = pos + group * (pos.max(initial=0) + NEAR_SPAN + 1)
    left = np.flatnonzero(np.asarray(multi)[group])
    for lag in range(1, NEAR_SPAN + 1):
        left = left[: np.searchsorted(left, len(line) - lag)]
        gap = line[left + lag] - line[left]
        close = gap <= NEAR_SPAN
        left, gap = left[close], gap[close]
        if not len(left):
            break
        hit = term[left + lag] != term[left]
        where = group[left[hit]]
        logs += np.bincount(where, weights=_NEAR_LOG[gap[hit]], minlength=n)
        near += np.bincount(where, minlength=n)
        full = logs <= FULL_LOG
        if full.any():
            left = left[~full[group[left]]]
    size = np.bincount(group, minlength=n).astype(np.float64)
    span = int(term.max()) + 1 if len(term) else 1
    _, owner, count = np.unique(group * span + term, return_index=True, return_counts=True)
    same = np.bincount(group[owner], weights=count.astype(np.float64) ** 2, minlength=n)
    pairs = (size * size - same) / 2.0
    paired = np.where(pairs > 0, -np.expm1(logs + (pairs - near) * _FAR_LOG), NO_PAIR)
    if multi.all():
        return paired
    steps = np.concatenate([[0.0], np.cumsum(1.0 / np.arange(1, int(size.max()) + 1) ** 2.0)])
    alone = POSITION_WEIGHT * steps[size.astype(np.int64)] / BASEL
    return np.where(multi, paired, alone)


# Near pairs that are listed at a time, pairs of terms that are looked up in the queries at a time, and terms of a
# text up to which its pairs are summed in a square.
PAIRS_AT_ONCE = 1_000_000
TERM_PAIRS_AT_ONCE = 4_096
SQUARE_TERMS = 1_500


def _pairs_of_terms(pos, term, n):
    """(first term * n + second, sum of logs, count) over the near pairs of different terms; `pos` ascends.

    Listed some places at a time; a code may come several times.
    """
    fan = np.searchsorted(pos, pos + NEAR_SPAN, "right") - np.arange(len(pos)) - 1
    listed = np.cumsum(fan)
    start = 0
    while start < len(pos):
        before = listed[start - 1] if start else 0
        end = max(start + 1, int(np.searchsorted(listed, before + PAIRS_AT_ONCE, "right")))
        some = fan[start:end]
        first = np.repeat(np.arange(start, end), some)
        second = np.arange(before, listed[end - 1]) - np.repeat(listed[start:end] - some, some) + first + 1
        hit = term[first] != term[second]
        first, second = first[hit], second[hit]
        yield term[first] * n + term[second], _NEAR_LOG[pos[second] - pos[first]]
        start = end


def _sums_of_queries(pos, term, member):
    """Sum of logs and number of the near pairs of different terms of one text, for every query.

    The pairs are summed by their two terms first, once for all queries. member: terms x queries, 0 or 1.
    """
    n, m = member.shape
    logs, near = np.zeros(m), np.zeros(m)
    close = int((np.searchsorted(pos, pos + NEAR_SPAN, "right") - np.arange(len(pos)) - 1).sum())
    if n <= SQUARE_TERMS and n * n <= 10 * close:
        weights, counts = np.zeros(n * n), np.zeros(n * n, np.int64)
        for code, log in _pairs_of_terms(pos, term, n):
            weights += np.bincount(code, weights=log, minlength=n * n)
            counts += np.bincount(code, minlength=n * n)
        # Whole numbers up to 2**24 are exact in 32 bits.
        kind = np.float32 if close < 1 << 24 else np.float64
        narrow = member.astype(kind)
        logs = np.einsum("ij,ij->j", weights.reshape(n, n) @ member, member)
        near = np.einsum("ij,ij->j", counts.reshape(n, n).astype(kind) @ narrow, narrow).astype(np.float64)
        return logs, near
    for code, log in _pairs_of_terms(pos, term, n):
        codes, which = np.unique(code, return_inverse=True)
        weights, counts = np.bincount(which, weights=log), np.bincount(which).astype(np.float64)
        for at in range(0, len(codes), TERM_PAIRS_AT_ONCE):
            part = slice(at, at + TERM_PAIRS_AT_ONCE)
            both = member[codes[part] // n] * member[codes[part] % n]
            logs += weights[part] @ both
            near += counts[part] @ both
    return logs, near


def ranks_of_queries(group, pos, term, member, multi):
    """(group, query, text rank) for the queries that share a term with a group of (position, term) rows.

    As `group_ranks` for many queries at once: the near pairs of a group are listed once for all of them. member:
    terms x queries, 1 where a query has the term; multi: does a query have several terms, known or not?
    """
    order = np.lexsort((pos, group))
    group, pos, term = group[order], pos[order], term[order]
    bounds = np.append(np.flatnonzero(np.diff(group, prepend=-1)), len(group))
    found = []
    for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist()):
        used, local = np.unique(term[a:b], return_inverse=True)
        count = np.bincount(local).astype(np.float64)
        mine = member[used]
        size = count @ mine
        query = np.flatnonzero(size)
        mine = mine[:, query]
        logs, near = _sums_of_queries(pos[a:b], local, mine) if len(used) > 1 else np.zeros((2, len(query)))
        found.append((np.full(len(query), group[a]), query, size[query], (count * count) @ mine, logs, near))
    if not found:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)
    group, query, size, same, logs, near = (np.concatenate(c) for c in zip(*found))
    pairs = (size * size - same) / 2.0
    paired = np.where(pairs > 0, -np.expm1(logs + (pairs - near) * _FAR_LOG), NO_PAIR)
    steps = np.concatenate([[0.0], np.cumsum(1.0 / np.arange(1, int(size.max(initial=0)) + 1) ** 2.0)])
    return group, query, np.where(multi[query], paired, POSITION_WEIGHT * steps[size.astype(np.int64)] / BASEL)


class QueryBlock:
    """A bounded set of queries as the tasks score them."""

    def __init__(self, rows, dim):
        rows = [r.asDict() for r in rows]
        vectors = pa.array([r["qv"] for r in rows], pa.list_(pa.float32()))
        self._take([r["query_id"] for r in rows], vectors, [r.get("terms") for r in rows], dim)

    @classmethod
    def of(cls, ids, vectors, terms, dim):
        """From Arrow columns."""
        block = cls.__new__(cls)
        block._take(ids.to_pylist(), vectors, terms.to_pylist(), dim)
        return block

    def _take(self, ids, vectors, terms, dim):
        self.ids, self.dim = ids, dim
        self.vectors = unit_rows(vectors, dim)
        terms = [sorted(set(t or [])) for t in terms]
        vocab = sorted({t for ts in terms for t in ts})
        number = {t: i for i, t in enumerate(vocab)}
        users = [[] for _ in vocab]
        for q, ts in enumerate(terms):
            for t in ts:
                users[number[t]].append(q)
        self.vocab = pa.array(vocab, pa.string())
        self.start = np.concatenate([[0], np.cumsum([len(u) for u in users])]).astype(np.int64)
        self.user = np.array([q for u in users for q in u], np.int64)
        self.multi = np.array([len(ts) > 1 for ts in terms], bool)

    def text_ranks(self, tokens):
        """Dense units x queries matrix of text ranks."""
        flat, lengths = _lists(tokens)
        n, m = len(lengths), len(self.ids)
        ranks = np.where(self.multi, NO_PAIR, 0.0)[None, :] * (lengths > 0)[:, None]
        if len(flat) == 0 or len(self.vocab) == 0:
            return ranks
        code = pc.index_in(flat, value_set=self.vocab)
        known = np.flatnonzero(code.is_valid().to_numpy(zero_copy_only=False))
        if len(known) == 0:
            return ranks
        code = pc.fill_null(code, 0).to_numpy(zero_copy_only=False)[known].astype(np.int64)
        first = np.cumsum(lengths) - lengths
        row = np.repeat(np.arange(n, dtype=np.int64), lengths)[known]
        pos = known - first[row]
        fan = self.start[code + 1] - self.start[code]
        within = np.arange(fan.sum()) - np.repeat(np.cumsum(fan) - fan, fan)
        query = self.user[np.repeat(self.start[code], fan) + within]
        cell = np.repeat(row, fan) * m + query
        cells, group = np.unique(cell, return_inverse=True)
        score = group_ranks(
            group, np.repeat(pos, fan), np.repeat(code, fan), self.multi[cells % m]
        )
        ranks.reshape(-1)[cells] = score
        return ranks


def _keep_best(table, k):
    """First k rows per query by (score, id), NULL scores last."""
    table = table.sort_by([("q", "ascending"), ("score", "ascending"), ("id", "ascending")])
    q = table["q"].to_numpy()
    _, first = np.unique(q, return_index=True)
    rank = np.arange(len(q)) - np.repeat(first, np.diff(np.append(first, len(q))))
    return table.filter(pa.array(rank < k))


def best_units(batches, block, weights, k, query_type, task, lanes):
    """Partial top-k of one partition: exact scores, at most k rows per query.

    Batches carry id, one vector column per lane and, if the text rank counts, tokens.
    """
    m = len(block.ids)
    worst = np.full(m, np.inf)
    kept = None
    for batch in batches:
        step = max(1, CELLS_PER_SLICE // max(1, m))
        for at in range(0, batch.num_rows, step):
            part = batch.slice(at, step)
            names = part.schema.names
            dist = {}
            for lane in lanes:
                vec = unit_rows(part.column(f"vec_{lane}"), block.dim)
                dist[lane] = 1.0 - vec @ block.vectors.T
            score = sum(weights[f"w_{lane}"] * dist[lane] for lane in lanes)
            ts = np.zeros_like(score)
            if "tokens" in names:
                ts = block.text_ranks(part.column("tokens"))
            score = np.round(score - weights["w_fts"] * ts, SCORE_DIGITS)
            key = np.where(np.isnan(score), np.inf, score)
            limit = worst
            if len(key) > k:
                limit = np.minimum(worst, np.partition(key, k - 1, axis=0)[k - 1])
            unit, query = np.nonzero(key <= limit)
            found = pa.table(
                {
                    "q": pa.array(query, pa.int64()),
                    "id": part.column("id").take(pa.array(unit)),
                    **{f"d_{lane}": _nullable(dist[lane][unit, query]) for lane in lanes},
                    "ts_score": pa.array(ts[unit, query]),
                    "score": _nullable(score[unit, query]),
                }
            )
            kept = found if kept is None else pa.concat_tables([kept, found])
            kept = _keep_best(kept, k)
            q = kept["q"].to_numpy()
            seen = kept["score"].to_numpy(zero_copy_only=False).astype(np.float64)
            top = np.full(m, -np.inf)
            np.maximum.at(top, q, np.where(np.isnan(seen), np.inf, seen))
            worst = np.where(np.bincount(q, minlength=m) == k, top, np.inf)
    if kept is not None and kept.num_rows:
        ids = pa.array(block.ids, query_type).take(kept["q"].combine_chunks())
        salt = pa.array(np.full(kept.num_rows, task, np.int32))
        out = kept.drop_columns(["q"]).add_column(0, "query_id", ids).append_column("salt", salt)
        yield from out.combine_chunks().to_batches()


def _nullable(values):
    return pa.array(values, mask=np.isnan(values))


def unit_vectors(column):
    """(row numbers, unit vectors) of the rows of a list column that are not NULL, zero or non-finite."""
    flat, lengths = _lists(column)
    dim = int(lengths.max()) if len(lengths) else 0
    rows = np.flatnonzero(lengths == dim) if dim else np.zeros(0, np.int64)
    if not np.isin(lengths, (0, dim)).all():
        raise ValueError("vectors differ in length")
    values = flat.to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(rows), dim)
    norm = np.sqrt((values * values).sum(axis=1))
    fine = np.isfinite(norm) & (norm > 0)
    return rows[fine], values[fine] / norm[fine, None]


def fit_cells(unit, cells, rounds):
    """Centroids of unit vectors on the sphere; the first `cells` vectors are the seeds."""
    centre = unit[:cells].copy()
    for _ in range(rounds):
        near = nearest_cells(unit, centre, 1)[:, 0]
        order = np.argsort(near, kind="stable")
        used, first = np.unique(near[order], return_index=True)
        mean = np.add.reduceat(unit[order], first, axis=0)
        norm = np.sqrt((mean * mean).sum(axis=1))
        centre[used[norm > 0]] = (mean / np.where(norm > 0, norm, 1.0)[:, None])[norm > 0]
    return centre


def nearest_cells(unit, centre, probes):
    """The `probes` nearest centroids of each unit vector, nearest first, the lower number on ties."""
    out = np.zeros((len(unit), probes), np.int64)
    step = max(1, CELLS_PER_SLICE // max(1, len(centre)))
    for a in range(0, len(unit), step):
        far = -(unit[a : a + step] @ centre.T)
        out[a : a + step] = np.argmin(far, axis=1)[:, None] if probes == 1 else np.argsort(far, axis=1, kind="stable")[:, :probes]
    return out


def _differs(column) -> np.ndarray:
    """Per row but the first: is the value another one than in the row above? NULL equals NULL."""
    here, above = column.slice(1), column.slice(0, len(column) - 1)
    same = pc.fill_null(pc.equal(here, above), False)
    both_null = pc.and_(pc.is_null(here), pc.is_null(above))
    return ~pc.or_(same, both_null).to_numpy(zero_copy_only=False)


def run_places(group, name):
    """Arrow batches of one partition, each row with its place in its run of equal `group` values."""

    def run(batches):
        last, held = None, 0
        for batch in batches:
            if batch.num_rows == 0:
                continue
            columns = [batch.column(batch.schema.get_field_index(c)) for c in group]
            new = np.zeros(batch.num_rows, bool)
            for column in columns:
                new[1:] |= _differs(column)
            first = [c[0].as_py() for c in columns]
            if first != last:
                held = 0
            place = np.arange(batch.num_rows, dtype=np.int64)
            start = np.maximum.accumulate(np.where(new, place, 0))
            number = place - start + 1 + np.where(start == 0, held, 0)
            last, held = [c[-1].as_py() for c in columns], int(number[-1])
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(number)], [*batch.schema.names, name])

    return run


class OpenSpans:
    """Spans in the order of their starts, those that can still hold something on a stack."""

    def __init__(self):
        self.stack = []

    def open(self, start, end, what):
        self.pass_by(start)
        self.stack.append((end, what))

    def pass_by(self, start):
        """Spans that end before `start` hold nothing from here on; in nested code they lie on top."""
        while self.stack and self.stack[-1][0] < start:
            self.stack.pop()

    def innermost(self, end):
        return next((what for until, what in reversed(self.stack) if until >= end), None)


def sweep(out_names, out_types):
    """Arrow batches ordered by (path, start, class before unit, …) -> units with their innermost class.

    Columns: path, _start, _kind (0 class, 1 unit), _end, _class, and those of the units. The classes open
    at the end of a batch go on into the next one.
    """

    def run(batches):
        path, spans = None, OpenSpans()
        for batch in batches:
            column = {n: batch.column(i) for i, n in enumerate(batch.schema.names)}
            kinds = column["_kind"].to_numpy(zero_copy_only=False)
            rows = zip(column["path"].to_pylist(), column["_start"].to_pylist(), kinds.tolist(), column["_end"].to_pylist())
            held, classes = [], column["_class"]
            for i, (here, start, kind, end) in enumerate(rows):
                if here != path:
                    path, spans = here, OpenSpans()
                known = path is not None and start is not None and end is not None
                if kind == 0:
                    if known:
                        spans.open(start, end, classes[i].as_py())
                    continue
                if known:
                    spans.pass_by(start)
                held.append(spans.innermost(end) if known else None)
            units = batch.filter(pa.array(kinds == 1))
            kept = [units.column(units.schema.get_field_index(n)) for n in out_names[:-1]]
            yield pa.RecordBatch.from_arrays([*kept, pa.array(held, out_types[-1])], out_names)

    return run
