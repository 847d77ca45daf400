"""Near-duplicate vectors by a random-projection tree forest.

Every tree splits the vectors of a label recursively by random directions near the median; vectors
close to a split go to both sides. Vectors are compared exactly within leaves only, links are
counted once over all trees, and linked vectors are united.

How many go to both sides follows from the cosine of a link and the spread of a node's vectors: the
narrower they lie, the likelier a random split parts a link. The share is the least with which, over
all trees and the levels to come, the chance of parting a link at the threshold is at most MISS. A node
that would cost more pairs so than as a whole is not cut.

Equal vectors are one node with a multiplicity. Nodes of a tree with more than MAX_GROUP vectors
are split by Spark level by level; smaller ones are split to leaves inside one task. A larger node
in which links are frequent is a leaf as it is: its vectors are dealt into blocks, and each pair of
blocks is compared in a task of its own.
"""

import math
from functools import lru_cache
from statistics import NormalDist

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from unitloom.llm.bytes_kernel import U, mix
from unitloom.llm.components import components
from unitloom.llm.shared import drop_saved, saved, small

TREES = 12
LEAF = 1024
MAX_GROUP = 16_384
# Shares of a tree node on each side of the median that may go to both children, and the least by default.
SPILL = 0.06
SHARES = (0.06, 0.1, 0.15, 0.2, 0.25, 0.3)
# Chance that the trees part a link at the threshold.
MISS = 0.02
BLOCK = 1024
# Cells of a piece of the comparison; vectors of a large node that judge how frequent links are.
CELLS = 1 << 22
SAMPLE = 256


NODE = ("nid", "vec", "copies", "key")


def direction(key, size):
    """A fixed random direction for a tree node."""
    return np.random.default_rng(int(key) & 0x7FFFFFFFFFFFFFFF).standard_normal(size)


def child(key, side):
    return int(mix(np.array([(int(key) * 2 + side) & 0xFFFFFFFFFFFFFFFF], U) ^ U(0x5851F42D4C957F2D))[0].view(np.int64))


def matrix(column, size):
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, size)


def _dense(unit, cosine):
    """True if many of a node's vectors are linked: cutting it further would part links."""
    some = unit[:: max(1, len(unit) // 256)][:256]
    near = some @ some.T >= cosine
    return near.sum() - len(some) > 0.05 * len(some) * (len(some) - 1)


def spread_of(unit):
    """Spread of the vectors around those that lie closest: one minus the mean cosine with their nearest quarter.

    By at most 256 of them; a quarter of the vectors has this spread or less. It is the mean squared
    distance from the mean where all lie alike. A node kept whole for its closest quarter costs at most
    16 times the pairs of that quarter.
    """
    some = unit[:: max(1, len(unit) // 256)][:256]
    m = len(some)
    near = np.sort(some @ some.T, axis=1)[:, ::-1][:, 1 : 1 + max(1, m // 4)]
    return float(np.quantile(1 - near.mean(axis=1), 0.25)) if m > 1 else 0.0


@lru_cache(4096)
def parted(share, correlation):
    """Chance that two normal variables with this correlation lie on different sides of the median, beyond `share` of it."""
    normal = NormalDist()
    cut = normal.inv_cdf(0.5 + share)
    rest = math.sqrt(1 - correlation * correlation)
    step = 0.02
    places = [-cut - (i + 0.5) * step for i in range(400)]
    return 2 * step * sum(normal.pdf(x) * (1 - normal.cdf((cut - correlation * x) / rest)) for x in places)


def share_for(n, spread, cosine, leaf, trees, spill, repeats):
    """The share of `n` vectors that goes to both children on each side, None if they should stay whole.

    Projections of two vectors of a link at `cosine` correlate with 1 - (1 - cosine) / spread.
    `repeats`: how many trees would compare the vectors as a whole but once.
    """
    correlation = round(1 - (1 - cosine) / max(spread, 1e-9), 3)
    if correlation <= 0:
        return None
    for share in [x for x in SHARES if x >= spill] or [spill]:
        levels = max(1, math.ceil(math.log(n / leaf) / -math.log(0.5 + share)))
        stays = (1 - parted(share, min(correlation, 0.999))) ** levels
        if (1 - stays) ** trees <= MISS:
            return share if repeats * leaf * (1 + 2 * share) ** levels < n else None
    return None


def leaves(unit, key, leaf, spill, cosine, trees=TREES):
    """Recursive random splits with overlap: yields (leaf key, row numbers)."""
    todo = [(int(key), np.arange(len(unit)))]
    while todo:
        key, rows = todo.pop()
        share = None
        if len(rows) > leaf and not _dense(unit[rows], cosine):
            share = share_for(len(rows), spread_of(unit[rows]), cosine, leaf, trees, spill, 1)
        if share is None:
            yield key, rows
            continue
        order = rows[np.argsort(unit[rows] @ direction(key, unit.shape[1]), kind="stable")]
        half, over = len(rows) // 2, int(len(rows) * share)
        todo.append((child(key, 0), order[: half + over]))
        todo.append((child(key, 1), order[half - over :]))


def _assign(leaf, spill, cosine, trees):
    def run(table):
        size = len(table.column("vec")[0])
        vectors = matrix(table.column("vec").combine_chunks(), size)
        unit = vectors / np.linalg.norm(vectors, axis=1)[:, None]
        nid = table.column("nid").to_numpy()
        keys, rows = [], []
        for key, found in leaves(unit, table.column("key")[0].as_py(), leaf, spill, cosine, trees):
            keys.append(np.full(len(found), key, np.int64))
            rows.append(found)
        return pa.table({"nid": nid[np.concatenate(rows)], "leaf": np.concatenate(keys)})

    return run


def _links(cosine):
    """Exact links within one leaf or tile, without those that an earlier common leaf counts.

    A tile compares the rows of its lower block with those of its higher block.
    """

    def run(table):
        size = len(table.column("vec")[0])
        vectors = matrix(table.column("vec").combine_chunks(), size)
        unit = vectors / np.linalg.norm(vectors, axis=1)[:, None]
        nid, copies = table.column("nid").to_numpy(), table.column("copies").to_numpy()
        leaf = table.column("leaf")[0].as_py()
        lists = table.column("leaves").combine_chunks()
        flat, owner = lists.flatten().to_numpy(), np.repeat(np.arange(len(nid)), np.diff(lists.offsets.to_numpy()))
        order = np.argsort(flat, kind="stable")
        before = order[flat[order] < leaf]
        cuts = np.flatnonzero(np.diff(flat[before])) + 1
        earlier = [g for g in np.split(owner[before], cuts) if len(g) > 1]
        n = len(nid)
        left = right = np.arange(n)
        if "low" in table.column_names and table.column("low")[0].as_py() != table.column("high")[0].as_py():
            block = table.column("block").to_numpy()
            left, right = (np.flatnonzero(block == table.column(c)[0].as_py()) for c in ("low", "high"))
        column = np.full(n, -1)
        column[right] = np.arange(len(right))
        counts, root, linked = np.zeros(n, np.int64), np.arange(n), np.zeros(n, bool)
        step = min(BLOCK, max(1, CELLS // max(1, len(right))))
        for a in range(0, len(left), step):
            rows = left[a : a + step]
            near = unit[rows] @ unit[right].T >= cosine
            if left is right:
                near[np.arange(len(rows)), rows] = False
            if not near.any():
                continue
            _unite(root, near, rows, right)
            linked[right] |= near.any(axis=0)
            linked[rows] |= near.any(axis=1)
            for group in earlier:
                here, there = np.flatnonzero(np.isin(rows, group)), column[group]
                if len(here):
                    near[np.ix_(here, there[there >= 0])] = False
            counts[rows] += near @ copies[right]
            if left is not right:
                counts[right] += copies[rows] @ near
        root = _roots(root)
        rows = np.flatnonzero(linked)
        least = np.full(n, np.iinfo(np.int64).max)
        np.minimum.at(least, root, nid)
        return pa.table({"nid": nid[rows], "links": counts[rows], "other": least[root[rows]]})

    return run


def _roots(root):
    while True:
        up = root[root]
        if (up == root).all():
            return root
        root = up


def _unite(root, near, rows, columns):
    """Hooks linked rows to the smallest root; repeated until no link joins two roots."""
    i, j = np.nonzero(near)
    i, j = rows[i], columns[j]
    while True:
        root[:] = _roots(root)
        a, b = root[i], root[j]
        apart = a != b
        if not apart.any():
            return
        i, j, a, b = i[apart], j[apart], a[apart], b[apart]
        np.minimum.at(root, np.maximum(a, b), np.minimum(a, b))


def _project():
    def run(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            keys = batch.column("key").to_numpy()
            size = len(batch.column("vec")[0])
            vectors = matrix(batch.column("vec"), size)
            vectors /= np.linalg.norm(vectors, axis=1)[:, None]
            out = np.zeros(len(keys))
            for key in np.unique(keys):
                rows = keys == key
                out[rows] = vectors[rows] @ direction(key, size)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(out)], [*batch.schema.names, "proj"])

    return run


def _judge(cosine, leaf, trees, spill, repeats):
    def run(table):
        vectors = matrix(table.column("vec").combine_chunks(), len(table.column("vec")[0]))
        unit = vectors / np.linalg.norm(vectors, axis=1)[:, None]
        share = None if _dense(unit, cosine) else share_for(table.column("n")[0].as_py(), spread_of(unit), cosine, leaf, trees, spill, repeats)
        return pa.table({"key": table.column("key")[:1], "share": pa.array([share], pa.float64())})

    return run


def _shares(nodes, large, *how):
    """(key, share) for the nodes of `large` (key, n), null where they stay whole, by a sample of each node."""
    some = nodes.join(small(large), "key").filter(F.pmod(F.xxhash64("nid", "key"), F.col("n")) < 2 * SAMPLE)
    return saved(some.select("key", "vec", "n").groupBy("key").applyInArrow(_judge(*how), "key long, share double"))


def _split_large(nodes, max_group, spill, cosine, leaf, trees):
    """Splits tree nodes with more than `max_group` rows by Spark, one level for all of them a round.

    Returns the nodes to be split further in one task each, and the larger ones that stay whole:
    (nid, leaf), and (leaf, blocks) of these. A group whose root stays
    whole is compared to the end there, so it needs one tree only.
    """
    whole, wholes, sizes, root = [], [], [], True
    widths = [x for x in SHARES if x >= spill] or [spill]
    while True:
        counts = nodes.groupBy("key").agg(F.count("*").alias("n"))
        large = saved(counts.filter(F.col("n") > max_group))
        if large.isEmpty():
            whole.append(nodes)
            break
        shares = _shares(nodes, large, cosine, leaf, trees, spill, trees if root else 1)
        dense, cut_up = shares.filter("share IS NULL").select("key"), shares.filter("share IS NOT NULL")
        whole.append(nodes.join(large, "key", "left_anti").select(*NODE))
        rows, kept = nodes.join(small(cut_up), "key"), dense
        if root:
            # All trees of a group share the root: one with frequent links stands for all of them.
            groups = saved(nodes.join(dense, "key", "left_semi").groupBy("group").agg(F.min("key").alias("key")))
            kept = groups.select("key")
            rows = rows.join(groups.select("group"), "group", "left_anti")
        wholes.append(nodes.join(kept, "key", "left_semi").select("nid", F.col("key").alias("leaf")))
        sizes.append(large.join(kept, "key").select(F.col("key").alias("leaf"), F.ceil(F.col("n") / max_group).cast("int").alias("blocks")))
        root = False
        rows = saved(rows.select(*NODE, "share").mapInArrow(_project(), "nid long, vec array<double>, copies long, key long, share double, proj double"))
        places = [0.5 + sign * x for x in widths for sign in (-1, 1)]
        cuts = rows.groupBy("key").agg(F.percentile_approx("proj", places, 1000).alias("cut"), F.first("share").alias("of"))
        at = 2 * (F.array_position(F.array(*map(F.lit, widths)), F.col("of")) - 1).cast("int")
        cuts = cuts.select("key", F.get("cut", at).alias("low"), F.get("cut", at + 1).alias("high"))
        sides = F.when(F.col("proj") < F.col("low"), F.array(F.lit(0))).when(F.col("proj") > F.col("high"), F.array(F.lit(1)))
        both = rows.join(small(cuts), "key").withColumn("side", F.explode(F.coalesce(sides, F.array(F.lit(0), F.lit(1)))))
        nodes = saved(both.select("nid", "vec", "copies", F.xxhash64("key", "side").alias("key")))
    return _union([x.select(*NODE) for x in whole]), _union(wholes), _union(sizes)


def _union(frames):
    out = None
    for more in frames:
        out = more if out is None else out.union(more)
    return out


def _tiles(spread, sizes):
    """Rows of whole large nodes once for every tile of two blocks that they take part in."""
    dealt = spread.join(small(sizes), "leaf").withColumn("block", F.pmod(F.xxhash64("nid", "leaf"), F.col("blocks")).cast("int"))
    met = dealt.withColumn("met", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    return met.withColumns({"low": F.least("block", "met"), "high": F.greatest("block", "met")}).drop("met", "blocks")


def near_vectors(
    vectors: DataFrame, cosine: float = 0.93, trees: int = TREES, leaf: int = LEAF, max_group: int = MAX_GROUP, spill: float = SPILL
) -> DataFrame:
    """(vec_id, n_links, component_id, kept) for every row of `vectors` (vec_id, embedding, label).

    Rows are linked when their labels are equal and not null, the vectors have the same length and
    their cosine in double precision is at least `cosine`. Vectors that are null, empty, zero or hold
    null or non-finite components link with nothing. n_links counts the linked rows other than the
    row itself, component_id is the smallest vec_id reachable. Rows without a vec_id count as links
    of others and have component null if nothing with an id is reachable; they are kept. Further
    columns play no part; an empty table gives no rows.

    Links found are exact; a link is missed only if no tree puts both vectors in one leaf. At least `spill`
    of a node goes to both children on each side, more where the vectors lie close. Tree nodes in which
    links are frequent, or that random splits would not part from their links, are not cut, whatever
    their size, so groups of near copies stay whole; above `max_group` they are compared in tiles of two blocks of about `max_group` rows.
    """
    rows = vectors.select("vec_id", F.col("embedding").cast("array<double>").alias("vec"), "label")
    fine = F.coalesce(F.forall("vec", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))), F.lit(False))
    nonzero = F.coalesce(F.exists("vec", lambda x: x != 0), F.lit(False))
    valid = rows.filter(F.col("label").isNotNull() & fine & nonzero)
    reps = valid.groupBy("label", "vec").agg(F.min("vec_id").alias("first_id"), F.count("*").alias("copies"))
    reps = saved(reps.withColumn("nid", F.monotonically_increasing_id()))
    planted = reps.withColumn("tree", F.explode(F.sequence(F.lit(1), F.lit(trees)))).select(
        "nid", "vec", "copies", F.xxhash64("tree", "label", F.size("vec")).alias("key"), F.xxhash64("label", F.size("vec")).alias("group")
    )
    nodes, wholes, sizes = _split_large(planted, max_group, spill, cosine, leaf, trees)
    placed = nodes.groupBy("key").applyInArrow(_assign(leaf, spill, cosine, trees), "nid long, leaf long")
    placed = saved(placed if wholes is None else placed.union(wholes))
    lists = placed.groupBy("nid").agg(F.collect_set("leaf").alias("leaves"))
    spread = reps.select("nid", "vec", "copies").join(lists, "nid").withColumn("leaf", F.explode("leaves"))
    found = "nid long, links long, other long"
    if wholes is None:
        found = saved(spread.groupBy("leaf").applyInArrow(_links(cosine), found))
    else:
        sizes = saved(sizes)
        tiles = _tiles(spread, sizes).groupBy("leaf", "low", "high").applyInArrow(_links(cosine), found)
        found = saved(spread.join(small(sizes.select("leaf")), "leaf", "left_anti").groupBy("leaf").applyInArrow(_links(cosine), found).union(tiles))
    totals = found.groupBy("nid").agg(F.sum("links").alias("links"))
    comp = components(found.select(F.col("nid").alias("a"), F.col("other").alias("b")))
    named = (
        reps.select("nid", "label", "vec", "copies", "first_id").join(totals, "nid", "left")
        .join(comp.withColumnRenamed("node", "nid"), "nid", "left")
        .withColumn("component", F.coalesce("component", "nid"))
    )
    named = saved(named.select("nid", "label", "vec", "first_id", "component", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links")))
    least = named.groupBy("component").agg(F.min("first_id").alias("component_id"))
    named = named.join(least, "component").select("label", "vec", "n_links", "component_id")
    drop_saved(placed)
    out = rows.join(named, ["label", "vec"], "left")
    component = F.coalesce("component_id", "vec_id")
    return out.select(
        "vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.cast("long").alias("component_id"),
        F.coalesce(F.col("vec_id") == component, F.lit(True)).alias("kept"),
    )
