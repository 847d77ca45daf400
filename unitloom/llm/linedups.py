"""Removal of line blocks that a document shares with an earlier one.

Rare lines of some words lead each later document to all earlier ones that hold them. The shortest runs
of lines from or up to every line that make a block lead to their first holder. Each pair is aligned by
patience diff on line hashes; aligned common blocks go from the later document, and so do blocks that the
earlier one holds in another order. A block held by any earlier document consists of such runs, each of
which goes with its first holder: pairs are linear in the lines and no block stays.
"""

from bisect import bisect_left
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from unitloom.llm.bytes_kernel import Powers, SpanHash, U, byte_codes, chunks, mix, utf8, word_bounds
from unitloom.llm.shared import drop_saved, saved, small

LINK_WORDS = 5
BLOCK_WORDS = 20
RARE = 8
# What counts as a word where blanks do not part words: characters of scripts without blanks, and bytes of any line.
SIGNS_PER_WORD = 2
BYTES_PER_WORD = 32
MEMBERS_PER_TASK = 512
LINE_POWERS = Powers(53)


def unspaced(data):
    """True where a character of a script without blanks between words begins.

    Thai, Lao, Tibetan, Burmese, Khmer, kana and Chinese characters, by the first two bytes.
    """
    b, c = data, np.r_[data[1:], np.zeros(1, np.uint8)]
    out = (b >= 0xE3) & (b <= 0xE9) & ~((b == 0xE3) & (c == 0x80))
    out |= (b == 0xE0) & (c >= 0xB8) | (b == 0xE1) & ((c >= 0x80) & (c <= 0x82) | (c == 0x9E) | (c == 0x9F))
    return out | (b == 0xE2) & (c >= 0xBA) | (b == 0xEF) & (c >= 0xA4) & (c <= 0xAB) | (b == 0xF0) & (c >= 0xA0)


def run_keys(hashes, words, bounds, least):
    """(text, hash) of the shortest runs of lines that hold `least` words, from and up to every line.

    Runs stay within a text (lines `bounds[t]` to `bounds[t + 1]`). A run of one line has its hash.
    """
    n = len(hashes)
    total = np.r_[0, np.cumsum(words)]
    text = np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))
    end = np.searchsorted(total, total[:-1] + least, "left")
    first = np.searchsorted(total, total[1:] - least, "right") - 1
    ahead, back = np.flatnonzero(end <= bounds[text + 1]), np.flatnonzero(first >= bounds[text])
    start, stop = np.r_[ahead, first[back]], np.r_[end[ahead], back + 1]
    up, down = LINE_POWERS.upto(n + 1)
    sums = np.r_[np.zeros(1, U), np.cumsum(hashes.view(U) * up[:n], dtype=U)]
    many = mix((sums[stop] - sums[start]) * down[start] + (stop - start).astype(U) * U(0x9E3779B97F4A7C15))
    keys = np.where(stop - start == 1, hashes[start], many.view(np.int64))
    order = np.lexsort((keys, text[start]))
    text, keys = text[start][order], keys[order]
    new = np.r_[True, (text[1:] != text[:-1]) | (keys[1:] != keys[:-1])] if len(keys) else np.zeros(0, bool)
    return text[new], keys[new]


def _line_hashes(least):
    """(doc_id, places, hashes, words, runs) of the non-blank lines of each text; outer white space is ignored."""

    def run(batches):
        spans = SpanHash(byte_codes(51), Powers(52))
        for batch in batches:
            lists, lengths, runs, n_runs = [[], [], []], [], [], []
            for _, data, offsets in chunks(batch.column("text")):
                read = spans.read(data)
                start, end, word_of_text = word_bounds(data, offsets)
                line = np.searchsorted(np.flatnonzero(data == 10), start, "right")  # the number of the word's line in the chunk
                first_line = np.searchsorted(np.flatnonzero(data == 10), offsets[:-1], "left")
                text = np.repeat(np.arange(len(offsets) - 1), np.diff(word_of_text))
                new = np.r_[True, (line[1:] != line[:-1]) | (text[1:] != text[:-1])] if len(start) else np.zeros(0, bool)
                first = np.flatnonzero(new)
                last = np.r_[first[1:], len(start)] - 1 if len(first) else first
                lists[0].append((line - first_line[text])[first] if len(first) else first)
                lists[1].append(read.of(start[first], end[last]).view(np.int64) if len(first) else first)
                signs = np.r_[0, np.cumsum(unspaced(data))]
                n_bytes, n_signs = end[last] - start[first], signs[end[last]] - signs[start[first]]
                lists[2].append(np.maximum(last - first + 1 + n_signs // SIGNS_PER_WORD, n_bytes // BYTES_PER_WORD))
                lengths.append(np.bincount(text[first], minlength=len(offsets) - 1))
                of_text, keys = run_keys(lists[1][-1], lists[2][-1], np.r_[0, np.cumsum(lengths[-1])], least)
                runs.append(keys)
                n_runs.append(np.bincount(of_text, minlength=len(offsets) - 1))
            n = batch.num_rows
            bounds = np.r_[0, np.cumsum(np.concatenate(lengths))] if n else np.zeros(1)
            columns = [
                pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), pa.array(np.concatenate(x) if n else [], kind))
                for x, kind in zip(lists, (pa.int32(), pa.int64(), pa.int32()))
            ]
            bounds = np.r_[0, np.cumsum(np.concatenate(n_runs))] if n else np.zeros(1)
            columns.append(pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), pa.array(np.concatenate(runs) if n else [], pa.int64())))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *columns], ["doc_id", "places", "hashes", "words", "runs"])

    return run


def longest_rising(values):
    """Indexes of a longest strictly rising subsequence."""
    tails, at, before = [], [], []
    for i, v in enumerate(values):
        k = bisect_left(tails, v)
        before.append(at[k - 1] if k else -1)
        tails[k : k + 1], at[k : k + 1] = [v], [i]
    out, i = [], at[-1] if at else -1
    while i >= 0:
        out.append(i)
        i = before[i]
    return out[::-1]


def longest_matches(a, b):
    """For every line of a: the length of the longest run up to it that b holds, and where b's run ends.

    One pass of a over the suffix automaton of b.
    """
    after, link, size, ends, last = [{}], [-1], [0], [-1], 0
    for j, x in enumerate(b):
        new, p, last = len(after), last, len(after)
        after.append({}), link.append(0), size.append(j + 1), ends.append(j)
        while p >= 0 and x not in after[p]:
            after[p][x] = new
            p = link[p]
        if p >= 0:
            q = after[p][x]
            if size[q] > size[p] + 1:
                after.append(dict(after[q])), link.append(link[q]), size.append(size[p] + 1), ends.append(ends[q])
                link[q], clone = len(after) - 1, len(after) - 1
                while p >= 0 and after[p].get(x) == q:
                    after[p][x] = clone
                    p = link[p]
                q = clone
            link[new] = q
    at, length = 0, 0
    for x in a:
        while at and x not in after[at]:
            at = link[at]
            length = size[at]
        at, length = (after[at][x], length + 1) if x in after[at] else (0, 0)
        yield length, ends[at]


def heaviest_run(a, b, words):
    """(place in a, place in b, length) of the common run of lines with the most `words` (of a's lines)."""
    total = [0, *accumulate(words)]
    best, most = (0, 0, 0), 0
    for i, (length, end) in enumerate(longest_matches(a, b)):
        held = total[i + 1] - total[i + 1 - length]
        if held > most:
            best, most = (i + 1 - length, end + 1 - length, length), held
    return best


def moved_blocks(a, b, words, gone, least):
    """Indexes in a of all common runs of at least `least` words, if `gone` may lack one of them.

    It may where neighbouring lines that b holds, not all of them gone, have so many words.
    """
    held, taken = set(b), set(gone)
    open_, have = False, 0
    for i, x in enumerate([*a, None]):
        if x in held and i < len(a):
            have += words[i]
            open_ |= i not in taken
            continue
        if open_ and have >= least:
            break
        open_, have = False, 0
    else:
        return gone
    total, cover = [0, *accumulate(words)], [0] * (len(a) + 1)
    for i, (length, _) in enumerate(longest_matches(a, b)):
        if total[i + 1] - total[i + 1 - length] >= least:
            cover[i + 1 - length] += 1
            cover[i + 1] -= 1
    return [i for i, n in enumerate(accumulate(cover)) if n and i < len(a)]


def patience(a, b, words=None, least=0):
    """Aligned equal lines of two sequences as pairs of indexes, rising in both.

    Lines that occur once in both, in a longest common order, are anchors; equal lines next to an
    anchor or to an end join it; the gaps between are aligned in the same way. In a gap without such
    lines the common run with the most `words` is the anchor, down to runs of `least` words.
    """
    words = [1] * len(a) if words is None else words
    pairs, todo = [], [(0, len(a), 0, len(b))]
    while todo:
        a0, a1, b0, b1 = todo.pop()
        while a0 < a1 and b0 < b1 and a[a0] == b[b0]:
            pairs.append((a0, b0))
            a0, b0 = a0 + 1, b0 + 1
        while a0 < a1 and b0 < b1 and a[a1 - 1] == b[b1 - 1]:
            a1, b1 = a1 - 1, b1 - 1
            pairs.append((a1, b1))
        if a0 == a1 or b0 == b1:
            continue
        where = {}
        for j in range(b0, b1):
            where[b[j]] = None if b[j] in where else j
        once = {}
        for i in range(a0, a1):
            once[a[i]] = None if a[i] in once else i
        unique = [(i, where[x]) for x, i in once.items() if i is not None and where.get(x) is not None]
        anchors = [unique[k] for k in longest_rising([j for _, j in unique])]
        if not anchors:
            shared = sum(words[i] for i in range(a0, a1) if a[i] in where)
            if not shared or shared < least:
                continue
            i, j, n = heaviest_run(a[a0:a1], b[b0:b1], words[a0:a1])
            if sum(words[a0 + i : a0 + i + n]) < least:
                continue
            anchors = [(a0 + i + k, b0 + j + k) for k in range(n)]
        for (i, j), (p, q) in zip([(a0 - 1, b0 - 1), *anchors], [*anchors, (a1, b1)]):
            todo.append((i + 1, p, j + 1, q))
        pairs += anchors
    return sorted(pairs)


def blocks(pairs, words, least):
    """Indexes in the later sequence of runs aligned line by line that hold at least `least` words."""
    out, run = [], []
    for i, j in [*pairs, (-1, -1)]:
        if run and (i, j) != (run[-1][0] + 1, run[-1][1] + 1):
            if sum(words[k] for k, _ in run) >= least:
                out += [k for k, _ in run]
            run = []
        run.append((i, j))
    return out


def _align(least):
    """Streams over rows sorted by (lead, salt, role): one earlier document, then later ones."""

    def run(batches):
        at, own = None, None
        for batch in batches:
            docs, gone = [], []
            columns = [batch.column(c).to_pylist() for c in ("lead", "salt", "role", "doc", "places", "hashes", "words")]
            for lead, salt, role, doc, places, hashes, words in zip(*columns):
                if role == 0:
                    at, own = (lead, salt), hashes
                elif at == (lead, salt):
                    found = blocks(patience(hashes, own, words, least), words, least)
                    found = moved_blocks(hashes, own, words, found, least)
                    if found:
                        docs.append(doc)
                        gone.append([places[k] for k in found])
            yield pa.RecordBatch.from_arrays([pa.array(docs, pa.int64()), pa.array(gone, pa.list_(pa.int32()))], ["doc", "gone"])

    return run


def overlaps(lines: DataFrame, link_words: int, rare: int) -> DataFrame:
    """(doc, lead): later documents and the earlier ones that share a telling line or a run with them.

    A line held by at most `rare` documents leads to all its earlier holders, a run to its first holder,
    so the pairs are linear in the lines.
    """
    telling = F.filter(F.arrays_zip("hashes", "words"), lambda x: x["words"] >= link_words)
    marked = [F.transform(keys, lambda x: F.struct(x.alias("key"), F.lit(run).alias("run"))) for keys, run in ((F.transform(telling, lambda x: x["hashes"]), False), (F.col("runs"), True))]
    held = saved(lines.select(F.col("doc_id").alias("doc"), F.explode(F.array_distinct(F.concat(*marked))).alias("line")).select("doc", "line.key", "line.run").distinct())
    counts = saved(held.groupBy("key", "run").agg(F.count("*").alias("n"), F.min("doc").alias("lead")).filter(F.col("n").between(2, rare) | F.col("run") & (F.col("n") > 1)))
    first = held.filter("run").join(counts.filter("run").select("key", "lead"), "key").filter("doc > lead").select("doc", "lead")
    few = held.filter("NOT run").join(counts.filter("NOT run").select("key"), "key").select("key", "doc")
    later = few.join(few.select("key", F.col("doc").alias("lead")), "key").filter("doc > lead").select("doc", "lead")
    out = saved(first.union(later).distinct())
    drop_saved(held, counts)
    return out


def removed_lines(docs: DataFrame, link_words: int = LINK_WORDS, block_words: int = BLOCK_WORDS, rare: int = RARE) -> DataFrame:
    """(doc_id, gone): line numbers (from 0) that go from each document of `docs` (doc_id, text)."""
    n = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    slim = docs.filter("doc_id is not null").select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    lines = slim.mapInArrow(_line_hashes(block_words), "doc_id long, places array<int>, hashes array<long>, words array<int>, runs array<long>")
    lines = saved(lines.dropDuplicates(["doc_id", "hashes", "places"]))
    pairs = overlaps(lines, link_words, rare)
    parts = pairs.groupBy("lead").agg(F.ceil(F.count("*") / MEMBERS_PER_TASK).cast("int").alias("parts"))
    parts = saved(parts)
    columns = ["doc", "places", "hashes", "words"]
    lines = lines.withColumnRenamed("doc_id", "doc").select(*columns)
    salt = F.pmod(F.xxhash64("doc"), F.col("parts")).cast("int").alias("salt")
    members = pairs.join(small(parts), "lead").select("doc", "lead", salt).join(lines, "doc").select("lead", "salt", F.lit(1).alias("role"), *columns)
    every = F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("salt")
    leaders = lines.join(parts.withColumnRenamed("lead", "doc"), "doc").select(F.col("doc").alias("lead"), every, F.lit(0).alias("role"), *columns)
    dealt = members.union(leaders).repartition(n, "lead", "salt").sortWithinPartitions("lead", "salt", "role")
    found = saved(dealt.mapInArrow(_align(block_words), "doc long, gone array<int>"))
    lists = F.array_distinct(F.flatten(F.collect_list("gone")))
    return saved(found.groupBy(F.col("doc").alias("doc_id")).agg(lists.alias("gone")))


def drop_shared_lines(docs: DataFrame, link_words: int = LINK_WORDS, block_words: int = BLOCK_WORDS, rare: int = RARE) -> DataFrame:
    """`docs` (doc_id, text, ...) with the shared lines cut from text, and n_lines, n_removed (long) added.

    A line is what stands between line feeds; lines are equal if their words are, up to outer white
    space, and blank lines play no part. A line goes if it lies in a block of neighbouring lines with at
    least `block_words` words that a document with a smaller doc_id holds as neighbouring lines, in
    whatever order blocks follow; all texts are judged as given. In scripts without blanks two characters count as a word
    besides, and a line counts at least a word for every 32 bytes. Null texts stay null with no lines; emptied texts are empty. Rows
    without a doc_id stay whole. Rows that repeat a doc_id with equal lines are one document and lose
    the same lines; doc_ids must otherwise be unique. Clashing columns of `docs` are replaced; an
    empty table gives no rows.
    """
    gone = removed_lines(docs, link_words, block_words, rare).select(F.col("doc_id").alias("_doc"), F.col("gone").alias("_gone"))
    keep = [c for c in docs.columns if c not in ("n_lines", "n_removed")]
    out = docs.select(*keep).join(small(gone, "_gone"), F.col("doc_id").cast("long") == F.col("_doc"), "left")
    lines = F.split("text", "\n")
    rest = F.filter(lines, lambda line, i: ~F.array_contains("_gone", i.cast("int")))
    return out.select(
        *[F.when(F.col("_gone").isNull(), F.col("text")).otherwise(F.array_join(rest, "\n")).alias("text") if c == "text" else F.col(c) for c in keep],
        F.when(F.col("text").isNull(), 0).otherwise(F.size(lines)).cast("long").alias("n_lines"),
        F.when(F.col("_gone").isNull(), 0).otherwise(F.size("_gone")).cast("long").alias("n_removed"),
    )
