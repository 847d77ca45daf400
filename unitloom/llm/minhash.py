"""Near-duplicate documents by circulant MinHash.

Two permutations give all signature coordinates: the first maps a shingle to a slot of a circle,
the second orders the slots and is shifted by one slot for each further coordinate. The values a
shingle adds to all coordinates are then one contiguous row of the second permutation. Signatures
are cut into bands; documents that share a band are candidates and are confirmed by the exact
Jaccard similarity of their full shingle sets.
"""

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from unitloom.llm.bytes_kernel import Powers, SpanHash, U, byte_codes, chunks, mix, numbers, utf8, word_bounds
from unitloom.llm.components import components
from unitloom.llm.shared import drop_saved, saved, small

SLOT_BITS = 20
BANDS, ROWS = 32, 6
# A candidate at the threshold 0.8 is missed with probability (1 - 0.8**6)**32 < 7e-5.
MEMBERS_PER_TASK = 256
EXTRA_LEADERS = 4
TILE_SHINGLES = 400_000
# Sets of a task that wait for their batch.
SETS_BYTES = 2 << 20


class Shingles:
    """Distinct shingle hashes of every text of a batch."""

    def __init__(self, width):
        self.width = width
        self.hash = SpanHash(byte_codes(11, fold_case=True), Powers(12))

    def sets(self, column):
        """Yields (row, sorted distinct 64-bit shingle hashes)."""
        for row, data, offsets in chunks(column):
            start, end, words = word_bounds(data, offsets)
            word = self.hash.read(data).of(start, end)
            full = self._fold(word, self.width)
            for i in range(len(offsets) - 1):
                s, e = words[i], words[i + 1]
                if e - s >= self.width:
                    yield row + i, np.unique(full[s : e - self.width + 1])
                elif e > s:
                    yield row + i, self._fold(word[s:e], e - s)
                else:
                    yield row + i, np.zeros(0, U)

    @staticmethod
    def _fold(word, width):
        n = len(word) - width + 1
        if n <= 0:
            return np.zeros(0, U)
        value = mix(word[:n] + U(width))
        for t in range(1, width):
            value = mix(value * U(0xD6E8FEB86659FD93) + word[t : n + t])
        return value


class Circulant:
    """Signatures from one permuted circle of slots."""

    def __init__(self, coordinates):
        size = 1 << SLOT_BITS
        order = np.argsort(numbers(21, size), kind="stable").astype(np.uint32)
        circle = np.concatenate([order, order[:coordinates]])
        self.rows = np.lib.stride_tricks.sliding_window_view(circle, coordinates)
        self.coordinates = coordinates

    def signature(self, shingles):
        slots = mix(shingles ^ U(0xA0761D6478BD642F)) >> U(64 - SLOT_BITS)
        low = np.full(self.coordinates, 0xFFFFFFFF, np.uint32)
        for i in range(0, len(slots), 4096):
            np.minimum(low, self.rows[slots[i : i + 4096]].min(axis=0), out=low)
        return low


def _sketcher(width, bands, rows):
    def run(batches):
        shingles, circle = Shingles(width), Circulant(bands * rows)
        label = numbers(31, bands)
        for batch in batches:
            n = batch.num_rows
            size = np.zeros(n, np.int64)
            sums = np.zeros((2, n), U)
            sig = np.zeros((n, bands, rows), U)
            for i, found in shingles.sets(batch.column("text")):
                size[i] = len(found)
                if len(found):
                    sums[0, i] = mix(found ^ U(1)).sum(dtype=U)
                    sums[1, i] = mix(found ^ U(2)).sum(dtype=U)
                    sig[i] = circle.signature(found).reshape(bands, rows)
            band = np.broadcast_to(label, (n, bands)).copy()
            for r in range(rows):
                band = mix(band * U(0xE7037ED1A0B428DB) + sig[:, :, r])
            lists = pa.ListArray.from_arrays(np.arange(0, n * bands + 1, bands, dtype=np.int32), pa.array(band.view(np.int64).ravel()))
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(size), pa.array(sums[0].view(np.int64)), pa.array(sums[1].view(np.int64)), lists],
                ["doc_id", "n_shingles", "s1", "s2", "bands"],
            )

    return run


def sketches(docs: DataFrame, width: int, bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """One row per document: set size, a 128-bit hash (s1, s2) of the whole set, band values."""
    slim = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return slim.mapInArrow(_sketcher(width, bands, rows), "doc_id long, n_shingles long, s1 long, s2 long, bands array<long>")


def _set_rows(width):
    """Sets of documents for each task that compares them: leader first, then members."""

    def run(batches):
        shingles = Shingles(width)
        for batch in batches:
            bounds = batch.column("roles").offsets.to_numpy()
            roles = batch.column("roles").flatten()
            lead, salt, role = (roles.field(i).to_numpy() for i in range(3))
            held, held_bytes = [], 0
            for i, found in shingles.sets(batch.column("text")):
                for k in range(bounds[i] - bounds[0], bounds[i + 1] - bounds[0]):
                    held.append((lead[k], salt[k], role[k], batch.column("doc_id")[i].as_py(), found.tobytes()))
                    held_bytes += found.nbytes
                    if held_bytes > SETS_BYTES:
                        yield _roles_batch(held)
                        held, held_bytes = [], 0
            if held:
                yield _roles_batch(held)

    def _roles_batch(held):
        lead, salt, role, doc, data = zip(*held)
        return pa.RecordBatch.from_arrays(
            [pa.array(lead, pa.int64()), pa.array(salt, pa.int32()), pa.array(role, pa.int32()), pa.array(doc, pa.int64()), pa.array(data, pa.binary())],
            ["lead", "salt", "role", "doc", "data"],
        )

    return run


def _compare(percent):
    """Streams over rows sorted by (lead, salt, role): keeps one leader's set at a time."""

    def similar(x, y):
        both = len(np.intersect1d(x, y, assume_unique=True))
        return both > 0 and 100 * both >= percent * (len(x) + len(y) - both)

    def run(batches):
        at, own = None, []
        for batch in batches:
            a, b = [], []
            rows = zip(batch.column("lead").to_pylist(), batch.column("salt").to_pylist(), batch.column("role").to_pylist(), batch.column("doc").to_pylist(), batch.column("data"))
            for lead, salt, role, doc, data in rows:
                found = np.frombuffer(data.as_buffer(), U)
                if role == 0:
                    at, own = (lead, salt), [found.copy()] + (own if at == (lead, salt) else [])
                elif at == (lead, salt) and any(similar(x, found) for x in own):
                    a.append(doc)
                    b.append(lead)
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])

    return run


def confirmed(docs: DataFrame, pairs: DataFrame, width: int, percent: int) -> DataFrame:
    """The pairs (doc, lead) whose full sets are similar enough, as (a, b).

    A leader with many members is compared in salted parts of about MEMBERS_PER_TASK members; each
    part gets the leader's set once, so no task holds more than one leader and a stream of members.
    """
    parts = pairs.groupBy("lead").agg(F.ceil(F.count("*") / MEMBERS_PER_TASK).cast("int").alias("parts"))
    parts = saved(parts)
    members = pairs.join(small(parts), "lead").select(
        F.col("doc").alias("doc_id"), "lead", F.pmod(F.xxhash64("doc"), F.col("parts")).cast("int").alias("salt"), F.lit(1).alias("role")
    )
    leaders = parts.select(
        F.col("lead").alias("doc_id"), "lead", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("salt"), F.lit(0).alias("role")
    )
    roles = saved(members.union(leaders).groupBy("doc_id").agg(F.collect_list(F.struct("lead", "salt", "role")).alias("roles")))
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(small(roles, "roles"), "doc_id")
    sets = texts.select("doc_id", "text", "roles").mapInArrow(_set_rows(width), "lead long, salt int, role int, doc long, data binary")
    n = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = sets.repartition(n, "lead", "salt").sortWithinPartitions("lead", "salt", "role")
    out = saved(dealt.mapInArrow(_compare(percent), "a long, b long"))
    drop_saved(roles, parts)
    return out


def _tile(percent):
    """All pairs of a pivot and a member of another component, on their full sets."""

    def run(table):
        docs, comps, is_pivot = (table.column(c).to_numpy() for c in ("doc", "comp", "pivot"))
        sets = [np.frombuffer(x.as_buffer(), U) for x in table.column("data")]
        pivots, members = np.flatnonzero(is_pivot == 1), np.flatnonzero(is_pivot == 0)
        if not len(pivots) or not len(members):
            return pa.table({"a": pa.array([], pa.int64()), "b": pa.array([], pa.int64())})
        size = np.array([len(x) for x in sets])
        names, flat = np.unique(np.concatenate([sets[i] for i in members]), return_inverse=True)
        starts = np.cumsum(size[members]) - size[members]
        held = np.zeros(len(names), np.int64)
        a, b = [], []
        for p in pivots:
            at = np.searchsorted(names, sets[p])
            at = at[(at < len(names)) & (names[np.minimum(at, len(names) - 1)] == sets[p])]
            held[at] = 1
            both = np.add.reduceat(held[flat], starts)
            held[at] = 0
            near = 100 * both >= percent * (size[p] + size[members] - both)
            hits = members[near & (both > 0) & (comps[members] != comps[p])]
            for i in hits[np.unique(comps[hits], return_index=True)[1]]:
                a.append(docs[p])
                b.append(docs[i])
        return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})

    return run


def _tile_sets(width):
    def run(batches):
        shingles = Shingles(width)
        for batch in batches:
            bounds = batch.column("tiles").offsets.to_numpy()
            tiles = batch.column("tiles").flatten()
            band, prow, mrow, comp, pivot = (tiles.field(i).to_numpy() for i in range(5))
            held, size = [], 0

            def flush():
                kinds = (pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.int32(), pa.int64(), pa.binary())
                names = ["band", "prow", "mrow", "comp", "pivot", "doc", "data"]
                return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*held), kinds)], names)

            for i, found in shingles.sets(batch.column("text")):
                doc, data = batch.column("doc_id")[i].as_py(), found.tobytes()
                for k in range(bounds[i] - bounds[0], bounds[i + 1] - bounds[0]):
                    held.append((band[k], prow[k], mrow[k], comp[k], pivot[k], doc, data))
                    size += len(data)
                    if size > SETS_BYTES:
                        yield flush()
                        held, size = [], 0
            if held:
                yield flush()

    return run


def cross_links(docs: DataFrame, state: DataFrame, sizes: DataFrame, width: int, percent: int) -> DataFrame:
    """Links (a, b) between different components within each band of `state` (band, doc, comp).

    Every member outside a band's largest component is a pivot. Pivots and members are dealt to tiles
    of about TILE_SHINGLES shingles each, and each tile compares its pivots with its members; it
    returns one link for a pivot and a component.
    """
    within = state.groupBy("band", "comp").agg(F.count("*").alias("n"))
    largest = within.groupBy("band").agg(F.max_by("comp", F.struct("n", "comp")).alias("main"))
    sized = saved(state.join(small(largest), "band").join(small(sizes), "doc").withColumn("is_pivot", F.col("comp") != F.col("main")))
    blocks = sized.groupBy("band").agg(
        F.ceil(F.sum(F.when(F.col("is_pivot"), F.col("n_shingles"))) / TILE_SHINGLES).cast("int").alias("prows"),
        F.ceil(F.sum("n_shingles") / TILE_SHINGLES).cast("int").alias("mrows"),
    ).filter("prows > 0")
    placed = sized.join(small(saved(blocks)), "band").withColumn("h", F.xxhash64("doc"))
    prow, mrow = F.pmod("h", "prows").cast("int"), F.pmod("h", "mrows").cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    pivots = placed.filter("is_pivot").select("doc", "band", prow.alias("prow"), every("mrows").alias("mrow"), "comp", F.lit(1).alias("pivot"))
    members = placed.select("doc", "band", every("prows").alias("prow"), mrow.alias("mrow"), "comp", F.lit(0).alias("pivot"))
    tiles = pivots.union(members).groupBy(F.col("doc").alias("doc_id")).agg(
        F.collect_list(F.struct("band", "prow", "mrow", "comp", "pivot")).alias("tiles")
    )
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(small(saved(tiles), "tiles"), "doc_id")
    sets = texts.select("doc_id", "text", "tiles").mapInArrow(
        _tile_sets(width), "band long, prow int, mrow int, comp long, pivot int, doc long, data binary"
    )
    return saved(sets.groupBy("band", "prow", "mrow").applyInArrow(_tile(percent), "a long, b long").distinct())


def apart(members: DataFrame, links: DataFrame) -> DataFrame:
    """(band, doc, comp) of the bands whose members lie in several components of `links`."""
    comp = components(links)
    state = members.join(small(comp), members["doc"] == comp["node"], "left").select(
        "band", "doc", F.coalesce("component", "doc").alias("comp")
    ).distinct()
    several = state.groupBy("band").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi")).filter("lo < hi")
    return saved(state.join(small(saved(several.select("band"))), "band", "left_semi"))


def near_duplicates(docs: DataFrame, width: int = 5, percent: int = 80, bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """(doc_id, n_shingles, class_id, component_id, kept) for every row of `docs` (doc_id, text).

    Words are runs of other than space and control white space, A-Z in lower case. A set holds the
    distinct shingles of `width` words; a text with fewer words is one shingle; null, empty and
    blank texts have the empty set and link with nothing. Documents with
    100 * intersection >= percent * union are linked; component_id is the smallest doc_id reachable,
    class_id the smallest doc_id with the same set. Rows that repeat a doc_id are one document with
    several sets. Rows without a doc_id link with nothing: component null, kept. Further columns of
    `docs` play no part. An empty table gives no rows.

    Only classes of equal sets enter the search. In each band a leader is confirmed against all
    members. Members then outside a band's largest component are tried against EXTRA_LEADERS other
    documents of it, and what is still apart is compared in tiles, pair by pair, until every pair of
    a band in different components has been confirmed or refused. No candidate is dropped, and the
    rows made are linear in the members.
    """
    sketch = saved(sketches(docs, width, bands, rows))
    filled = sketch.filter("n_shingles > 0 and doc_id is not null")
    classes = filled.groupBy("s1", "s2").agg(
        F.min("doc_id").alias("rep"), F.min("bands").alias("bands"), F.first("n_shingles").alias("n_shingles")
    )
    member_class = filled.select("doc_id", "s1", "s2").join(classes.select("s1", "s2", "rep"), ["s1", "s2"])
    member_class = saved(member_class.select("doc_id", "rep").distinct())
    banded = classes.select(F.col("rep").alias("doc"), "n_shingles", F.explode("bands").alias("band"))
    shared = banded.groupBy("band").agg(F.countDistinct("doc").alias("n"), F.min("doc").alias("lead")).filter("n > 1")
    members = saved(banded.join(shared.select("band", "lead"), "band"))
    sizes = members.groupBy("doc").agg(F.sum_distinct("n_shingles").alias("n_shingles"))

    stars = saved(members.filter("doc <> lead").select("doc", "lead").distinct())
    links = confirmed(docs, stars, width, percent)
    state = apart(members, links)
    within = state.groupBy("band", "comp").agg(F.count("*").alias("n"))
    largest = within.groupBy("band").agg(F.max_by("comp", F.struct("n", "comp")).alias("main"))
    known = state.join(small(saved(largest)), "band")
    order = "row_number() over (partition by band order by xxhash64(doc, band), doc) as place"
    extra = known.filter("comp = main").selectExpr("band", "doc as lead", order).filter(F.col("place") <= EXTRA_LEADERS)
    more = known.filter("comp <> main").select("band", "doc").join(small(saved(extra.select("band", "lead"))), "band")
    more = saved(more.select("doc", "lead").distinct().join(stars, ["doc", "lead"], "left_anti"))
    links = saved(links.union(confirmed(docs, more, width, percent)))
    state = apart(members, links)
    if not state.isEmpty():
        links = saved(links.union(cross_links(docs, state, sizes, width, percent)))

    linked = member_class.filter("doc_id <> rep").select(F.col("doc_id").alias("a"), F.col("rep").alias("b")).union(links)
    comp = components(linked)
    low = member_class.groupBy("doc_id").agg(F.min("rep").alias("class_id"))
    drop_saved(members, stars, more)
    out = sketch.select("doc_id", "n_shingles").join(low, "doc_id", "left").join(
        comp.withColumnRenamed("node", "doc_id"), "doc_id", "left"
    )
    component = F.coalesce("component", "doc_id")
    return out.select(
        "doc_id", "n_shingles", F.coalesce("class_id", "doc_id").alias("class_id"), component.alias("component_id"),
        F.coalesce(F.col("doc_id") == component, F.lit(True)).alias("kept"),
    )
