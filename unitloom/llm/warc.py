"""Zstandard WARC archives: one frame a record, with the dictionary in a leading skippable frame.

Writing is narrow: every task streams its records as frames through Spark's text writer, whose row
separator is an empty skippable frame, so the files are plain .warc.zst archives in any file system
that Spark writes to. Reading takes one archive a row, loads its dictionary, decodes one frame at a
time and checks every header and length.
"""

import base64
import hashlib
import re

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, functions as F

from unitloom.llm.shared import attach, drop_saved, saved

# Fixed values of the formats: frame numbers (little-endian), the dictionary's own frame number,
# the revisit profile, and an empty skippable frame.
FRAME = 0xFD2FB528
SKIPPABLE = range(0x184D2A50, 0x184D2A60)
DICTIONARY = 0x184D2A5D
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
SEPARATOR = "P*M\x18\0\0\0\0"
VERSION = b"WARC/1.1"
MANDATORY = ("WARC-Record-ID", "WARC-Date", "WARC-Type", "Content-Length")
DATE = "1970-01-01T00:00:00Z"

# Bound of the sample that a dictionary is trained on, and of the dictionary.
SAMPLE_ROWS = 1_000
SAMPLE_BYTES = 16_384
DICTIONARY_BYTES = 65_536
LEVEL = 3
RECORD = "archive string, offset long, record_id string, record_type string, target_uri string, refers_to string, payload_bytes long, payload_digest string, payload binary, problem string"
KEPT = ("record_id", "record_type", "target_uri", "refers_to", "payload_bytes", "payload_digest", "payload")


def digest_of(payload):
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def clean(value):
    """A header value on one line: control characters and blanks are percent-encoded."""
    return re.sub(r"[\x00-\x20\x7f]", lambda c: f"%{ord(c[0]):02X}", value)


def record(page, url, payload, refers_to, refers_url, date):
    """The bytes of a response record, or of a revisit record (its payload left out) if refers_to is given."""
    revisit = refers_to is not None
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if revisit else http + payload
    fields = [("WARC-Type", "revisit" if revisit else "response"), ("WARC-Record-ID", f"<urn:page:{'' if page is None else page}>"), ("WARC-Date", date)]
    if url is not None:
        fields.append(("WARC-Target-URI", clean(url)))
    if revisit:
        fields += [("WARC-Profile", PROFILE), ("WARC-Refers-To", f"<urn:page:{refers_to}>")]
        if refers_url is not None:
            fields.append(("WARC-Refers-To-Target-URI", clean(refers_url)))
        fields.append(("WARC-Refers-To-Date", date))
    fields += [
        ("WARC-Payload-Digest", f"sha1:{digest_of(payload)}"), ("WARC-Block-Digest", f"sha1:{digest_of(block)}"),
        ("Content-Type", "application/http; msgtype=response"), ("Content-Length", str(len(block))),
    ]
    head = b"".join(f"{name}: {value}\r\n".encode() for name, value in fields)
    return VERSION + b"\r\n" + head + b"\r\n" + block + b"\r\n\r\n"


def skippable(number, content):
    return number.to_bytes(4, "little") + len(content).to_bytes(4, "little") + content


def train(samples, size=DICTIONARY_BYTES):
    """A dictionary for `samples`; their first bytes as they are where too few or too short to train on."""
    try:
        return zstandard.train_dictionary(size, samples).as_bytes()
    except zstandard.ZstdError:
        return b"".join(samples)[:size]


def loaded(dictionary):
    return zstandard.ZstdCompressionDict(dictionary) if dictionary else None


def _frames(dictionary, date, level):
    def run(batches):
        writer = zstandard.ZstdCompressor(level=level, dict_data=loaded(dictionary))
        head = [skippable(DICTIONARY, dictionary)] if dictionary else []
        for batch in batches:
            columns = [batch.column(c) for c in ("page_id", "url", "payload", "refers_to", "refers_url")]
            out, held = head, 0
            head = []
            for row in range(batch.num_rows):
                out.append(writer.compress(record(*[c[row].as_py() for c in columns], date)))
                held += len(out[-1])
                if held > 8 << 20:
                    yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], ["frame"])
                    out, held = [], 0
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], ["frame"])

    return run


def frame_end(data, at):
    """(end, content start) of the frame at `at`; content start is None but for skippable frames."""
    number = int.from_bytes(data[at : at + 4], "little")
    if number in SKIPPABLE and at + 8 <= len(data):
        end, content = at + 8 + int.from_bytes(data[at + 4 : at + 8], "little"), at + 8
    elif number == FRAME and at + 6 <= len(data):
        flags, content = data[at + 4], None
        single, checksum = flags >> 5 & 1, flags >> 2 & 1
        # Window byte, dictionary id, content size.
        end = at + 5 + (not single) + (0, 1, 2, 4)[flags & 3] + (single, 2, 4, 8)[flags >> 6]
        last = False
        while not last:
            if end + 3 > len(data):
                raise ValueError("frame is cut off")
            block = int.from_bytes(data[end : end + 3], "little")
            last, kind, size = block & 1, block >> 1 & 3, block >> 3
            if kind == 3:
                raise ValueError("unknown kind of block")
            end += 3 + (1 if kind == 1 else size)
        end += 4 * checksum
    else:
        raise ValueError("no frame starts here")
    if end > len(data):
        raise ValueError("frame is cut off")
    return end, content


def decoded(data, reader):
    """The content of one whole frame."""
    one = reader.decompressobj()
    try:
        content = one.decompress(data)
    except zstandard.ZstdError as e:
        raise ValueError(f"frame cannot be decoded: {e}") from None
    if not one.eof or one.unused_data:
        raise ValueError("frame is not whole")
    return content


def fields_of(head):
    """Header fields of `head`, its first line left out, by lower-case name; a folded line goes on with the one before."""
    found, name = {}, None
    for line in head.split(b"\r\n")[1:]:
        line = line.decode("utf-8", "replace")
        if line[:1] in (" ", "\t") and name:
            found[name] += " " + line.strip()
            continue
        name, colon, value = line.partition(":")
        if not colon or not name or name != name.strip():
            raise ValueError(f"header line without a field: {line[:80]!r}")
        name = name.lower()
        found.setdefault(name, value.strip())
    return found


def length_of(fields, what):
    value = fields.get("content-length", "")
    if not re.fullmatch("[0-9]+", value):
        raise ValueError(f"{what} without a length")
    return int(value)


def sha1_of(fields, name):
    kind, _, value = fields.get(name, "").partition(":")
    return value.strip() if kind.lower() == "sha1" else None


def parsed(content):
    """The fields of one record's bytes, as a dict with the keys KEPT; ValueError where it is not valid.

    Lengths, mandatory headers, SHA-1 digests and the closing line ends are checked. payload_bytes and
    payload_digest are of the full payload: of a revisit, as its headers state them; its payload is null.
    """
    head, blank, rest = content.partition(b"\r\n\r\n")
    if not re.match(rb"WARC/[0-9]+\.[0-9]+(\r\n|$)", head) or not blank:
        raise ValueError("no WARC header")
    fields = fields_of(head)
    for name in MANDATORY:
        if not fields.get(name.lower()):
            raise ValueError(f"{name} is missing")
    size = length_of(fields, "record")
    if len(rest) != size + 4 or rest[size:] != b"\r\n\r\n":
        raise ValueError(f"record states {size} bytes, holds {len(rest) - 4}")
    block = rest[:size]
    stated = sha1_of(fields, "warc-block-digest")
    if stated and stated != digest_of(block):
        raise ValueError("block digest differs")
    kind = fields["warc-type"].lower()
    revisit = kind == "revisit"
    payload, full = block, None
    if fields.get("content-type", "").lower().startswith("application/http"):
        http, blank, payload = block.partition(b"\r\n\r\n")
        if not blank or not http.startswith(b"HTTP/"):
            raise ValueError("no HTTP header")
        inner = fields_of(http)
        if "content-length" in inner:
            full = length_of(inner, "HTTP message")
            if not revisit and full != len(payload):
                raise ValueError(f"HTTP message states {full} bytes, holds {len(payload)}")
    if revisit and not fields.get("warc-profile"):
        raise ValueError("revisit without a profile")
    own = digest_of(payload)
    stated = sha1_of(fields, "warc-payload-digest")
    if not revisit and stated and stated != own:
        raise ValueError("payload digest differs")
    if revisit and payload:
        raise ValueError("revisit with a payload")
    known = (fields["warc-record-id"], kind, fields.get("warc-target-uri"), fields.get("warc-refers-to"))
    return dict(zip(KEPT, (*known, full if revisit else len(payload), stated if revisit else own, None if revisit else payload)))


def records_of(data):
    """(offset, fields or None, problem or None) of each record of an archive's bytes.

    The dictionary is that of the leading skippable frame, which may itself be compressed; further
    skippable frames are passed over. After a frame without an end nothing more can be found.
    """
    reader, at, first = zstandard.ZstdDecompressor(), 0, True
    while at < len(data):
        try:
            end, content = frame_end(data, at)
            if content is not None:
                if first and int.from_bytes(data[at : at + 4], "little") == DICTIONARY:
                    held = bytes(data[content:end])
                    held = decoded(held, reader) if held[:4] == FRAME.to_bytes(4, "little") else held
                    reader = zstandard.ZstdDecompressor(dict_data=loaded(held))
                at, first = end, False
                continue
        except ValueError as e:
            yield at, None, str(e)
            return
        first = False
        try:
            yield at, parsed(decoded(data[at:end], reader)), None
        except ValueError as e:
            yield at, None, str(e)
        at = end


def _records(strict, payloads):
    def run(batches):
        for batch in batches:
            for name, content in zip(batch.column("path"), batch.column("content")):
                out, held = [], 0
                for offset, fields, problem in records_of(memoryview(content.as_buffer())):
                    if problem and strict:
                        raise ValueError(f"{name.as_py()} at byte {offset}: {problem}")
                    fields = fields or {}
                    kept = [fields.get(c) for c in KEPT[: None if payloads else -1]]
                    out.append((name.as_py(), offset, *kept, *([] if payloads else [None]), problem))
                    held += (fields.get("payload_bytes") or 0 if payloads else 0) + 500
                    if held > 8 << 20:
                        yield _batch(out)
                        out, held = [], 0
                yield _batch(out)

    return run


def _batch(rows):
    kinds = [pa.string(), pa.int64(), *[pa.string()] * 4, pa.int64(), pa.string(), pa.binary(), pa.string()]
    names = ["archive", "offset", *KEPT, "problem"]
    columns = zip(*rows) if rows else [()] * len(names)
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names)


def payload_rows(pages: DataFrame) -> DataFrame:
    """(page_id long, url, payload) of `pages`: the html as UTF-8, empty for null."""
    return pages.select(F.col("page_id").cast("long").alias("page_id"), "url", F.encode(F.coalesce("html", F.lit("")), "UTF-8").alias("payload"))


def decided(rows: DataFrame, least_bytes: int = 0) -> DataFrame:
    """`rows` with refers_to and refers_url: of equal payloads of `least_bytes` or more, the page that stands for the others.

    That is the one with the largest page_id; it and rows that repeat its page_id, as all smaller
    payloads, refer to nothing. Where all page_ids are null nothing refers.
    """
    keyed = rows.withColumn("key", F.unhex(F.sha2("payload", 256)))
    long_enough = F.octet_length("payload") >= least_bytes
    groups = keyed.filter(long_enough).groupBy("key").agg(F.max(F.struct("page_id", "url")).alias("first"), F.count("*").alias("n")).filter("n > 1")
    out = attach(keyed, saved(groups), "key")
    refers = long_enough & F.col("first.page_id").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("first.page_id"))
    return out.select(
        "page_id", "url", "payload", F.when(refers, F.col("first.page_id")).alias("refers_to"), F.when(refers, F.col("first.url")).alias("refers_url")
    )


def dictionary_of(rows: DataFrame, date: str = DATE) -> bytes:
    """A dictionary trained on about SAMPLE_ROWS records of `payload_rows`, drawn by hash, the first SAMPLE_BYTES of each payload.

    Only drawn rows reach the driver, at most twice SAMPLE_ROWS.
    """
    some = rows.select("page_id", "url", F.substring("payload", 1, SAMPLE_BYTES).alias("payload"))
    n = max(1, rows.count())
    some = some.filter(F.pmod(F.xxhash64("page_id", "payload"), F.lit(n)) < SAMPLE_ROWS).limit(2 * SAMPLE_ROWS)
    drawn = sorted((r["page_id"] or 0, r["url"] or "", bytes(r["payload"])) for r in some.collect())
    return train([record(page, url, payload, None, None, date) for page, url, payload in drawn])


def write_archives(pages: DataFrame, path: str, least_bytes: int = 0, date: str = DATE, level: int = LEVEL) -> None:
    """Writes one WARC record for each row of `pages` (page_id, url, html) as Zstandard archives in the folder `path`.

    An archive holds the rows of one scan task, in the order of the scan. Record ids are <urn:page:ID>,
    ID empty for null; a null url has no target. Null html is an empty payload. Rows that repeat a
    page_id are records of their own. See `decided` for revisits. Further columns play no part; without
    rows no archive holds a record.
    """
    rows = payload_rows(pages)
    dictionary = dictionary_of(rows, date)
    frames = decided(rows, least_bytes).mapInArrow(_frames(dictionary, date, level), "frame binary")
    frames.select(F.col("frame").cast("string").alias("value")).write.option("lineSep", SEPARATOR).option("maxRecordsPerFile", 0).text(path)


def read_archives(spark, path: str, strict: bool = True, payloads: bool = True) -> DataFrame:
    """The records of the Zstandard WARC archives at `path` (a file, folder or pattern).

    (archive, offset, record_id, record_type, target_uri, refers_to, payload_bytes, payload_digest,
    payload, problem). Archives are read one a row, so a task needs memory for a whole compressed
    archive and one decoded record. A frame that cannot be decoded or a record that is not valid raises;
    with strict off it is a row with the problem and no fields. Without `payloads` the payload is null.
    Folders without archives give no rows.
    """
    files = spark.read.format("binaryFile").load(path).select("path", "content")
    return files.mapInArrow(_records(strict, payloads), RECORD)


def page_of(record_id):
    """The page_id of a record id of `write_archives`."""
    return F.nullif(F.regexp_extract(record_id, "^<urn:page:(-?[0-9]*)>$", 1), F.lit("")).cast("long")
