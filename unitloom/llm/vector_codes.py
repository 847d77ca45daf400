"""Vector codes: parts of vectors stand for entries of codebooks fitted by active-entry Lloyd rounds.

Vectors are integers here, so every distance and sum is exact. A round reads the vectors once, with
the codebooks in the closure, and writes them again with their codes and exact distances, along with
the sums of the parts of each entry. In the next round a part whose entry stayed fixed compares only
the entries that moved with its stored distance; the other parts rescan the whole codebook. The driver
holds the codebooks and nothing else: parts x entries x part length numbers for each vector length.
"""

import hashlib
from collections import defaultdict

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from unitloom.llm.shared import attach, drop_saved, saved, small

PARTS = 4
ENTRIES = 256
ROUNDS = 4
SCALE = 1024
# Components beyond this count as this; sums and distances stay exact below.
LARGEST = float(1 << 42)
# A distance that 64 bits do not hold; its part is always rescanned.
FULL = (1 << 63) - 1
STEP = 4096
STATE = "vec_id long, label string, size int, whole array<long>, codes array<int>, gaps array<long>, sums boolean"


def integers(vectors: DataFrame, scale: int = SCALE) -> DataFrame:
    """(vec_id, label, size, whole): floor(scale * x) of the vectors without null or non-finite components."""
    x = F.col("embedding").cast("array<double>")
    fine = F.coalesce(F.forall(x, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf"))), F.lit(False))
    held = F.transform(x, lambda c: F.floor(scale * F.greatest(F.least(c, F.lit(LARGEST)), F.lit(-LARGEST))))
    return vectors.filter(fine).select("vec_id", F.col("label").cast("string").alias("label"), F.size("embedding").alias("size"), held.alias("whole"))


def bounds(size, parts):
    """Where the parts of a vector begin and end."""
    return [k * size // parts for k in range(parts + 1)]


def exact(largest, size):
    """A number type in which squared distances of `size` components up to `largest` are exact."""
    worst = 4 * max(1, size) * max(1, int(largest)) ** 2
    return np.float64 if worst < 1 << 53 else np.int64 if worst < 1 << 63 else object


def nearest(points, book):
    """(index, squared distance) of the nearest row of `book`, the lower index on ties, as exact integers."""
    index, gap = np.zeros(len(points), np.int64), np.zeros(len(points), np.int64)
    largest = max((int(np.abs(a).max()) for a in (points, book) if a.size), default=0)
    kind = exact(largest, points.shape[1])
    book = book.astype(kind)
    norms = (book * book).sum(axis=1)
    for a in range(0, len(points), STEP):
        some = points[a : a + STEP].astype(kind)
        far = (some * some).sum(axis=1)[:, None] - 2 * (some @ book.T) + norms[None, :]
        best = np.argmin(far, axis=1)
        index[a : a + STEP] = best
        least = far[np.arange(len(best)), best]
        gap[a : a + STEP] = np.minimum(least, FULL) if kind is object else least.astype(np.int64)
    return index, gap


def reassign(points, book, moved, code, gap):
    """Codes and distances of a new codebook, from those of the one before and the entries that moved."""
    code, gap = code.copy(), gap.copy()
    anew = moved[code] | (gap == FULL)
    if anew.any():
        code[anew], gap[anew] = nearest(points[anew], book)
    active = np.flatnonzero(moved)
    fixed = np.flatnonzero(~anew)
    if len(active) and len(fixed):
        near, far = nearest(points[fixed], book[active])
        near = active[near]
        better = (far < gap[fixed]) | ((far == gap[fixed]) & (near < code[fixed]))
        code[fixed[better]], gap[fixed[better]] = near[better], far[better]
    return code, gap


class Sums:
    """Sums and counts of the parts of each entry; `full` before a 64-bit sum could overflow."""

    def __init__(self, books):
        self.total = [np.zeros(b.shape, np.int64) for b in books]
        self.count = [np.zeros(len(b), np.int64) for b in books]
        self.reach = 0

    def full(self, largest, rows):
        return self.reach + largest * rows >= 1 << 62

    def add(self, part, points, code):
        order = np.argsort(code, kind="stable")
        entry, start = np.unique(code[order], return_index=True)
        if points.shape[1]:
            self.total[part][entry] += np.add.reduceat(points[order], start, axis=0)
        self.count[part] += np.bincount(code, minlength=len(self.count[part]))

    def rows(self, size):
        for part, (total, count) in enumerate(zip(self.total, self.count)):
            for entry in np.flatnonzero(count):
                yield size, total[entry], [part, entry], [count[entry]]


def _lists(rows, kind):
    flat = np.concatenate([np.asarray(r, np.int64) for r in rows]) if rows else np.zeros(0, np.int64)
    ends = np.cumsum([0, *[len(r) for r in rows]])
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(flat, kind))


def _sum_batch(sums, schema):
    found = [r for size, s in sums.items() for r in s.rows(size)]
    n = len(found)
    columns = [pa.nulls(n, pa.int64()), pa.nulls(n, pa.string()), pa.array([r[0] for r in found], pa.int32())]
    columns += [_lists([r[1] for r in found], pa.int64()), _lists([r[2] for r in found], pa.int32()), _lists([r[3] for r in found], pa.int64())]
    return pa.RecordBatch.from_arrays([*columns, pa.array([True] * n, pa.bool_())], schema)


def _round(books, moved, summed):
    """One pass over the vectors; books[size][part] has the entries, moved[size][part] marks changed ones."""
    names = ["vec_id", "label", "size", "whole", "codes", "gaps", "sums"]

    def run(batches):
        sums = {}
        for batch in batches:
            if not batch.num_rows:
                continue
            size = batch.column("size").to_numpy()
            whole = batch.column("whole")
            flat, at = whole.flatten().to_numpy(), whole.offsets.to_numpy() - whole.offsets[0].as_py()
            parts = len(next(iter(books.values())))
            codes, gaps = np.zeros((len(size), parts), np.int64), np.zeros((len(size), parts), np.int64)
            if moved:
                codes[:] = batch.column("codes").flatten().to_numpy().reshape(-1, parts)
                gaps[:] = batch.column("gaps").flatten().to_numpy().reshape(-1, parts)
            for one in np.unique(size):
                rows = np.flatnonzero(size == one)
                points = flat[at[rows][:, None] + np.arange(one)]
                largest = int(np.abs(points).max()) if points.size else 0
                if summed and one in sums and sums[one].full(largest, len(rows)):
                    yield _sum_batch({one: sums.pop(one)}, names)
                if summed and one not in sums:
                    sums[one] = Sums(books[one])
                cuts = bounds(int(one), parts)
                for k, book in enumerate(books[one]):
                    some = points[:, cuts[k] : cuts[k + 1]]
                    found = reassign(some, book, moved[one][k], codes[rows, k], gaps[rows, k]) if moved else nearest(some, book)
                    codes[rows, k], gaps[rows, k] = found
                    if summed:
                        sums[one].add(k, some, found[0])
                if summed:
                    sums[one].reach += largest * len(rows)
            ends = pa.array(np.arange(len(size) + 1) * parts, pa.int32())
            lists = [pa.ListArray.from_arrays(ends, pa.array(x.ravel(), kind)) for x, kind in ((codes, pa.int32()), (gaps, pa.int64()))]
            rows = [batch.column(c) for c in names[:4]]
            yield pa.RecordBatch.from_arrays([*rows, *lists, pa.array(np.zeros(len(size), bool))], names)
        if sums:
            yield _sum_batch(sums, names)

    return run


def first_books(rows, parts, entries):
    """Codebooks by vector length: the parts of its vectors with the smallest vec_ids, ascending."""
    order = Window.partitionBy("size").orderBy(F.col("vec_id").asc_nulls_last(), "whole")
    seeds = rows.select("vec_id", "size", "whole", F.row_number().over(order).alias("at")).filter(F.col("at") <= entries)
    found = defaultdict(list)
    for r in sorted(seeds.select("size", "at", "whole").collect(), key=lambda r: r["at"]):
        found[r["size"]].append(r["whole"])
    books = {}
    for size, whole in found.items():
        whole, cuts = np.array(whole, np.int64).reshape(len(whole), size), bounds(size, parts)
        books[size] = [whole[:, cuts[k] : cuts[k + 1]] for k in range(parts)]
    return books


def next_books(state, books):
    """The componentwise floor of sum / count for every used entry, and which entries changed."""
    sums = state.filter("sums").select("size", F.col("codes")[0].alias("part"), F.col("codes")[1].alias("entry"), F.col("gaps")[0].alias("n"), "whole")
    # Position -1 holds the count, so entries of empty parts are counted too.
    cells = sums.select("size", "part", "entry", F.posexplode(F.concat(F.array("n"), "whole")).alias("place", "x"))
    cells = cells.groupBy("size", "part", "entry", "place").agg(F.sum(F.col("x").cast("decimal(38,0)")).alias("x"))
    rows = cells.groupBy("size", "part", "entry").agg(F.array_sort(F.collect_list(F.struct("place", "x"))).alias("cells")).collect()
    new = {size: [b.copy() for b in book] for size, book in books.items()}
    for r in rows:
        n, *total = [int(c["x"]) for c in r["cells"]]
        new[r["size"]][r["part"]][r["entry"]] = [x // n for x in total]
    moved = {size: [(a != b).any(axis=1) for a, b in zip(new[size], book)] for size, book in books.items()}
    return new, moved


def digest(book):
    """SHA-256 of a codebook's decimal integers by part, entry and position, joined by commas."""
    return hashlib.sha256(",".join(str(int(x)) for part in book for x in part.ravel()).encode()).hexdigest()


def vector_codes(vectors: DataFrame, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS, scale: int = SCALE):
    """Codes of `vectors` (vec_id, embedding, label) and their codebooks, as two tables.

    (vec_id, label string, size, codes, gaps, error): the entry of each part, its exact squared distance,
    and their sum (null beyond 64 bits); and (size, codebooks_sha256, part, entry, whole): the entries.

    Components become floor(scale * x); those beyond 2**42 count as 2**42. Vectors that are null or hold
    null or non-finite components are dropped. Vectors are cut into consecutive parts, of equal length
    where the vector's length allows; vectors of another length have codebooks of their own, and empty
    ones the empty entry. Seeds are the smallest vec_ids (null last; of rows that repeat one, by value).
    Repeated rows count each. Further columns play no part; no vectors give no rows.
    """
    rows = saved(integers(vectors, scale))
    books = first_books(rows, parts, entries)
    spark = vectors.sparkSession
    state, moved = rows, None
    for k in range(rounds + 1):
        passed = state.filter("NOT sums").select(*state.columns) if moved else state
        new = saved(passed.mapInArrow(_round(books, moved, k < rounds), STATE)) if books else spark.createDataFrame([], STATE)
        drop_saved(state)
        state = new
        if k < rounds and books:
            books, moved = next_books(state, books)
    gaps = F.aggregate("gaps", F.lit(0).cast("decimal(38,0)"), lambda s, x: (s + x).cast("decimal(38,0)"))
    codes = state.filter("NOT sums").select("vec_id", "label", "size", "codes", "gaps", gaps.try_cast("long").alias("error"))
    listed = [
        (size, name, k, e, [int(x) for x in row])
        for size, name, book in [(size, digest(book), book) for size, book in books.items()]
        for k, part in enumerate(book) for e, row in enumerate(part)
    ]
    return codes, spark.createDataFrame(listed, "size int, codebooks_sha256 string, part int, entry int, whole array<long>")


def coded(vectors: DataFrame, **more) -> DataFrame:
    """(vec_id, code, error, label_error, codebooks_sha256): `vector_codes` as text, with the error of each label.

    code has two or more hex digits a part. label_error sums the error over equal labels, nulls together
    (null beyond 64 bits), whatever share of the rows one label has.
    """
    codes, books = vector_codes(vectors, **more)
    labels = saved(codes.groupBy("label").agg(
        F.when(F.count("error") == F.count("*"), F.try_sum("error")).alias("label_error"), F.count("*").alias("n")
    ))
    texts = F.array_join(F.transform("codes", lambda c: F.lower(F.lpad(F.hex(c), 2, "0"))), "")
    out = attach(codes.select("vec_id", "label", "size", texts.alias("code"), "error"), labels, "label")
    digests = books.select("size", "codebooks_sha256").distinct()
    return out.join(small(digests), "size").select("vec_id", "code", "error", "label_error", "codebooks_sha256")
