"""Byte-level BPE encoding and decoding over a global table of distinct words.

Texts are cut into pre-tokens. A block of texts keeps, for every pre-token position, the number of
its word in the block, and ships each distinct word once to the task that owns the word's hash. There
each distinct word is merged once; its ids go back to the block, which replaces positions by ids.
A frequent word costs one entry per block, not one per occurrence, so no word is a hot key.
Decoding looks ids up in the token-byte table of the fixed vocabulary.
"""

import base64
import zlib

import numpy as np
import pyarrow as pa
import regex
import tiktoken
import zstandard
from pyspark.sql import DataFrame, functions as F

BLOCK_CHARS = 12_000_000
# Bytes of ids that leave a task at once.
IDS_BYTES = 2 << 20
# Words that occur this often in a block are numbered by frequency, so their numbers compress well.
FREQUENT = 3
CODEPOINTS = 0x110000


def read_ranks(path: str) -> dict:
    """Token bytes to rank, from a file of base64 tokens and ranks (read on the driver)."""
    with open(path, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}


def _members(pattern):
    """Code points that one class of the tokenizer's own pattern engine accepts."""
    one = tiktoken.Encoding("class", pat_str=pattern, mergeable_ranks={bytes([i]): i for i in range(256)}, special_tokens={})
    every = "".join(map(chr, (c for c in range(CODEPOINTS) if not 0xD800 <= c < 0xE000)))
    return set(map(ord, bytes(one.encode_ordinary(every)).decode()))


def _ranges(points):
    points = np.array(sorted(points))
    cut = np.flatnonzero(np.diff(points) > 1)
    starts, ends = points[np.r_[0, cut + 1]], points[np.r_[cut, len(points) - 1]]
    return "".join(rf"\U{a:08x}-\U{b:08x}" for a, b in zip(starts, ends))


def splitter_spec(pattern: str) -> tuple:
    """(pattern, pattern with spelled-out classes, class of the code points on which they differ).

    The pattern engine of the tokenizer library knows another Unicode edition than `regex`. Texts
    that hold a code point classed differently are split with the library's own classes.
    """
    letters, numbers = _members(r"\p{L}"), _members(r"\p{N}")
    odd = set()
    for cls, own in ((r"\p{L}", letters), (r"\p{N}", numbers)):
        here = regex.compile(cls)
        odd |= {c for c in range(CODEPOINTS) if not 0xD800 <= c < 0xE000 and (here.match(chr(c)) is not None) != (c in own)}
    spelled = pattern.replace(r"[^\s\p{L}\p{N}]", rf"[^\s{_ranges(letters)}{_ranges(numbers)}]")
    spelled = spelled.replace(r"\p{L}", f"[{_ranges(letters)}]").replace(r"\p{N}", f"[{_ranges(numbers)}]")
    return pattern, spelled, f"[{_ranges(odd)}]" if odd else None


class Splitter:
    def __init__(self, spec):
        pattern, spelled, odd = spec
        self.plain, self.spelled = regex.compile(pattern), spelled
        self.odd = regex.compile(odd) if odd else None

    def __call__(self, text):
        if self.odd is not None and not text.isascii() and self.odd.search(text):
            return regex.findall(self.spelled, text)
        return self.plain.findall(text)


def packed(numbers):
    """Unsigned integers as compressed byte planes."""
    numbers = np.asarray(numbers)
    numbers = numbers.astype("<u4" if numbers.dtype.itemsize <= 4 else "<u8", copy=False)
    width = max(1, (int(numbers.max()).bit_length() + 7) // 8) if len(numbers) else 1
    planes = np.ascontiguousarray(numbers.view(np.uint8).reshape(-1, numbers.itemsize)[:, :width].T)
    return np.array([len(numbers), width], "<i8").tobytes() + zstandard.ZstdCompressor(level=3).compress(planes)


def unpacked(data):
    """Signed integers of 32 bits if they hold the numbers, else of 64."""
    n, width = np.frombuffer(data[:16], "<i8")
    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(data[16:]), np.uint8).reshape(width, n)
    wide = 4 if width < 4 else 8
    out = np.zeros((n, wide), np.uint8)
    out[:, :width] = planes.T
    return out.view(f"<i{wide}").ravel()


def framed(*parts):
    """Byte strings behind their lengths."""
    return np.array([len(parts), *map(len, parts)], "<i8").tobytes() + b"".join(parts)


def unframed(data):
    n = int(np.frombuffer(data[:8], "<i8")[0])
    ends = 8 * (n + 1) + np.cumsum(np.frombuffer(data[8 : 8 * (n + 1)], "<i8"))
    return [data[a:b] for a, b in zip([8 * (n + 1), *ends[:-1].tolist()], ends.tolist())]


def joined(words):
    return framed(packed([len(w) for w in words]), zstandard.ZstdCompressor(level=3).compress(b"".join(words)))


def split_joined(data):
    lengths, body = unframed(data)
    body = zstandard.ZstdDecompressor().decompress(body)
    start = 0
    for end in np.cumsum(unpacked(lengths)).tolist():
        yield body[start:end]
        start = end


PART_SCHEMA = "block long, digit int, place int, data binary, docs array<long>"


def _part_batch(rows):
    block, digit, place, data, docs = zip(*rows)
    return pa.RecordBatch.from_arrays(
        [pa.array(block, pa.int64()), pa.array(digit, pa.int32()), pa.array(place, pa.int32()), pa.array(data, pa.binary()), pa.array(docs, pa.list_(pa.int64()))],
        ["block", "digit", "place", "data", "docs"],
    )


def _positions(spec, digits, block_chars):
    """Blocks of texts: words by digit (place = digit), then positions (place = digits)."""

    def emit(block, docs, counts, seq, words):
        held, seq = seq, np.concatenate(seq) if seq else np.zeros(0, np.int32)
        held.clear()
        times = np.bincount(seq, minlength=len(words))
        raw = [word.encode() for word in words]
        digit = np.array([zlib.crc32(r) % digits for r in raw], np.int64)
        order = np.argsort(-times, kind="stable")
        frequent = order[: np.count_nonzero(times >= FREQUENT)]
        rare = sorted(order[len(frequent) :].tolist(), key=lambda i: (digit[i], raw[i]))
        order = np.concatenate([frequent, np.array(rare, np.int64)])
        for d in range(digits):
            own = order[digit[order] == d]
            if len(own):
                yield block, d, d, joined([raw[i] for i in own]), None
        number = np.zeros(len(words), np.int32)
        number[order] = np.arange(len(words))
        yield block, block % digits, digits, framed(packed(counts), packed(digit[frequent]), packed(number[seq])), docs

    def run(batches):
        from pyspark import TaskContext

        split = Splitter(spec)
        block = TaskContext.get().partitionId() << 32
        docs, counts, seq, words, chars = [], [], [], {}, 0
        for batch in batches:
            for doc, text in zip(batch.column("doc_id").to_pylist(), batch.column("text")):
                text = text.as_py() or ""
                pieces = split(text)
                number = words.setdefault
                seq.append(np.fromiter((number(p, len(words)) for p in pieces), np.int32, len(pieces)))
                docs.append(doc)
                counts.append(len(pieces))
                chars += len(text) + 64
                if chars > block_chars:
                    yield _part_batch(list(emit(block, docs, counts, seq, words)))
                    block, docs, counts, seq, words, chars = block + 1, [], [], [], {}, 0
        if docs:
            yield _part_batch(list(emit(block, docs, counts, seq, words)))

    return run


def _merge(ranks):
    """Replaces the words of each part by their ids; each distinct word is merged once per digit."""

    def run(batches):
        core = tiktoken.Encoding("words", pat_str=r"[\s\S]+", mergeable_ranks=ranks.value, special_tokens={})
        known = {}
        for batch in batches:
            rows = []
            for row in batch.to_pylist():
                if row["docs"] is None:
                    lengths, ids = [], []
                    for word in split_joined(row["data"]):
                        found = known.get(word)
                        if found is None:
                            found = known[word] = tuple(core._encode_single_piece(word))
                        lengths.append(len(found))
                        ids.extend(found)
                    row["data"] = framed(packed(lengths), packed(ids))
                rows.append(tuple(row.values()))
            if rows:
                yield _part_batch(rows)

    return run


def _entry(digit, sizes):
    """Where a word number's entry is in the parts of all digits: frequent words, then rare ones."""
    begin = np.cumsum(sizes) - sizes
    many = np.bincount(digit, minlength=len(sizes))
    order = np.argsort(digit, kind="stable")
    frequent = np.zeros(len(digit), np.int64)
    frequent[order] = np.arange(len(digit)) - np.repeat(np.cumsum(many) - many, many) + np.repeat(begin, many)
    few = sizes - many
    rare = np.arange(few.sum()) - np.repeat(np.cumsum(few) - few, few) + np.repeat(begin + many, few)
    return np.concatenate([frequent, rare])


def _reassemble(digits):
    """Streams over rows sorted by (block, place): the ids of a block's words, then its positions."""

    def run(batches):
        lengths, ids, sizes = [], [], np.zeros(digits, np.int64)
        for batch in batches:
            for i in range(batch.num_rows):
                parts = [unpacked(x) for x in unframed(batch.column("data")[i].as_py())]
                place = batch.column("place")[i].as_py()
                if place < digits:
                    lengths.append(parts[0])
                    ids.append(parts[1])
                    sizes[place] = len(parts[0])
                    continue
                head, digit, tail = parts
                tail = _entry(digit, sizes).astype(np.int32)[tail]
                length = np.concatenate(lengths or [head[:0]])
                flat = np.concatenate(ids or [head[:0]]).astype("<u4")
                start = np.cumsum(length) - length
                lengths, ids, sizes = [], [], np.zeros(digits, np.int64)
                ends = np.cumsum(head)
                docs = batch.column("docs")[i].as_py()
                parts, held = [], 0
                first = 0
                for k, (doc, end) in enumerate(zip(docs, ends.tolist())):
                    words = tail[first:end]
                    n = length[words]
                    at = np.repeat(start[words] - (np.cumsum(n) - n), n) + np.arange(n.sum())
                    parts.append((doc, flat[at].tobytes()))
                    held += len(parts[-1][1])
                    first = end
                    if held > IDS_BYTES or k == len(docs) - 1:
                        a, b = zip(*parts)
                        yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.binary())], ["doc_id", "ids"])
                        parts, held = [], 0

    return run


def encode(docs: DataFrame, ranks: dict, pattern: str, block_chars: int = BLOCK_CHARS) -> DataFrame:
    """(doc_id, ids) for every row of `docs` (doc_id, text); ids are little-endian unsigned 32-bit numbers.

    Each match of `pattern` is merged on its own by `ranks`, without special tokens. A null or empty
    text has no ids. Repeated rows and repeated or null doc_ids each give their own row; further
    columns play no part; an empty table gives no rows. Memory of a task: one block of texts of
    `block_chars` characters (a longer text is a block of its own) and the distinct words of one
    hash range.
    """
    spark = docs.sparkSession
    digits = int(spark.conf.get("spark.sql.shuffle.partitions"))
    held = spark.sparkContext.broadcast(ranks)  # fixed size: one vocabulary
    slim = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    parts = slim.mapInArrow(_positions(splitter_spec(pattern), digits, block_chars), PART_SCHEMA)
    merged = parts.repartition(digits, "digit").mapInArrow(_merge(held), PART_SCHEMA)
    home = merged.repartition(digits, "block").sortWithinPartitions("block", "place")
    return home.mapInArrow(_reassemble(digits), "doc_id long, ids binary")


def decode(tokens: DataFrame, ranks: dict) -> DataFrame:
    """`tokens` (doc_id, ids) with the column `decoded` (binary): the bytes of the ids in order.

    Null ids decode to empty bytes; an id outside the vocabulary is an error.
    """
    size = max(ranks.values(), default=-1) + 1
    by_id = [b""] * size
    for token, rank in ranks.items():
        by_id[rank] = token
    table = tokens.sparkSession.sparkContext.broadcast((b"".join(by_id), np.array([len(t) for t in by_id], np.int64)))

    def run(batches):
        raw, length = table.value
        raw, start = np.frombuffer(raw, np.uint8), np.cumsum(length) - length
        for batch in batches:
            out = []
            for data in batch.column("ids"):
                ids = np.frombuffer(data.as_py() or b"", "<u4")
                parts = []
                for i in range(0, len(ids), 1 << 17):
                    some = ids[i : i + (1 << 17)]
                    n = length[some]
                    parts.append(raw[np.repeat(start[some] - (np.cumsum(n) - n), n) + np.arange(n.sum())].tobytes())
                out.append(b"".join(parts))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("ids"), pa.array(out, pa.binary())], ["doc_id", "ids", "decoded"])

    return tokens.select("doc_id", "ids").mapInArrow(run, "doc_id long, ids binary, decoded binary")
