import base64
import hashlib
import random

import pytest
import zstandard
from pyspark.sql import functions as F

from unitloom.llm import warc
from unitloom.llm.warc import page_of, read_archives, write_archives

SCHEMA = "page_id long, url string, html string, payload string, n int, key string"


def frame(spark, rows, parts=3):
    return spark.createDataFrame([(*r, "p", 1, "k") for r in rows], SCHEMA).repartition(parts)


def sample():
    rng = random.Random(6)
    texts = ["<p>" + " ".join(rng.choice(["alpha", "beta", "gämma", "中文", "\r\n\r\n", "\0"]) for _ in range(rng.randint(0, 400))) for _ in range(150)]
    rows = [(5 * i, f"http://h/{i}", t) for i, t in enumerate(texts)] + [(2000 + i, f"http://c/{i}", rng.choice(texts[:4])) for i in range(90)]
    rows += [(None, "http://n", texts[0]), (None, None, "lone"), (None, None, "lone"), (3001, None, None), (3002, "a b\r\nEvil: 1", ""), (3003, "u", "x" * 3_000_000)]
    return rows + [rows[20], rows[20], (2000, "http://other", rows[150][2])]


def expected(rows, least=0):
    out = []
    for page, _, html in rows:
        payload = (html or "").encode()
        ids = [r[0] for r in rows if (r[2] or "").encode() == payload and r[0] is not None]
        refers = max(ids) if ids and len(payload) >= least and page != max(ids) else None
        digest = base64.b32encode(hashlib.sha1(payload).digest()).decode()
        out.append((page, len(payload), digest, "response" if refers is None else "revisit", refers))
    return sorted(out, key=str)


def read(spark, path, **more):
    got = read_archives(spark, path, **more)
    return sorted(map(tuple, got.select(page_of(F.col("record_id")), "payload_bytes", "payload_digest", "record_type", page_of(F.col("refers_to"))).collect()), key=str)


@pytest.mark.parametrize("least", [0, 1, 500])
def test_records_equal_brute_force(spark, tmp_path, least):
    rows, path = sample(), str(tmp_path / "a")
    write_archives(frame(spark, rows), path, least_bytes=least)
    assert read(spark, path) == expected(rows, least)
    payloads = {r.record_id: bytes(r.payload) for r in read_archives(spark, path).collect() if r.record_type == "response"}
    for page, _, html in rows:
        if f"<urn:page:{page}>" in payloads:
            assert payloads[f"<urn:page:{page}>"] == (html or "").encode()
    assert {r.target_uri for r in read_archives(spark, path).filter("record_id = '<urn:page:3002>'").collect()} == {"a%20b%0D%0AEvil:%201"}


def test_hot_payloads_beyond_the_broadcast_limit(spark, tmp_path, monkeypatch):
    import unitloom.llm.shared as shared

    monkeypatch.setattr(shared, "BROADCAST_ROWS", 1)
    monkeypatch.setattr(shared, "HOT_PARTS", 4)
    write_archives(frame(spark, sample()), str(tmp_path / "a"))
    assert read(spark, str(tmp_path / "a")) == expected(sample())


def test_files_are_plain_archives(spark, tmp_path):
    """Read with the library alone: the dictionary first, a frame a record, all frames in one stream."""
    rows = sample()
    write_archives(frame(spark, rows), str(tmp_path / "a"))
    found = 0
    for file in (tmp_path / "a").glob("part-*"):
        data = file.read_bytes()
        assert data[:4] == bytes.fromhex("5d2a4d18")
        end = 8 + int.from_bytes(data[4:8], "little")
        reader = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(data[8:end]))
        whole = b"".join(reader.decompress(f) for f in data[end:].split(warc.SEPARATOR.encode()) if f)
        found += whole.count(b"WARC/1.1\r\nWARC-Type: ")
        with reader.stream_reader(data, read_across_frames=True) as stream:
            assert stream.read() == whole
    assert found == len(rows)


def test_no_rows_and_one(spark, tmp_path):
    write_archives(frame(spark, []), str(tmp_path / "a"))
    assert read_archives(spark, str(tmp_path / "a")).collect() == []
    write_archives(frame(spark, [(1, None, None)]), str(tmp_path / "b"))
    assert read(spark, str(tmp_path / "b")) == expected([(1, None, None)])


def archive(records, dictionary=b"", packed=False):
    """An archive made with the library alone."""
    dict_data = zstandard.ZstdCompressionDict(dictionary) if dictionary else None
    writer = zstandard.ZstdCompressor(dict_data=dict_data, write_content_size=False, write_checksum=True)
    held = zstandard.ZstdCompressor().compress(dictionary) if packed else dictionary
    head = warc.skippable(warc.DICTIONARY, held) if dictionary else b""
    return head + b"".join(writer.compress(r) for r in records)


PLAIN = warc.record(7, "http://x", b"<p>hello</p>", None, None, warc.DATE)
REVISIT = warc.record(6, "http://y", b"<p>hello</p>", 7, "http://x", warc.DATE)
INFO = b"WARC/1.0\r\nWARC-Type: warcinfo\r\nWARC-Record-ID: <urn:i>\r\nWARC-Date: 2020-01-01T00:00:00Z\r\nX-Long: a\r\n b\r\nContent-Length: 4\r\n\r\nabcd\r\n\r\n"


@pytest.mark.parametrize("dictionary, packed", [(b"", False), (PLAIN * 3, False), (PLAIN * 3, True)])
def test_archives_of_others(dictionary, packed):
    data = archive([INFO, PLAIN, REVISIT], dictionary, packed) + warc.skippable(0x184D2A53, b"junk" * 9)
    found = [(f["record_type"], f["payload_bytes"], f["payload_digest"], p) for _, f, p in warc.records_of(memoryview(data))]
    digest = warc.digest_of(b"<p>hello</p>")
    assert found == [("warcinfo", 4, warc.digest_of(b"abcd"), None), ("response", 12, digest, None), ("revisit", 12, digest, None)]


@pytest.mark.parametrize("bad, problem", [
    (PLAIN.replace(b"WARC/1.1", b"WART/1.1"), "no WARC header"),
    (PLAIN.replace(b"WARC-Date", b"WARC-Data"), "WARC-Date is missing"),
    (PLAIN.replace(b"<p>hello", b"<p>hellooo"), "record states"),
    (PLAIN.replace(b"hello", b"jello"), "block digest differs"),
    (PLAIN[:-2], "record states"),
    (PLAIN.replace(b"HTTP/1.1 200", b"HTTQ/1.1 200").replace(b"WARC-Block-Digest", b"X-Digest"), "no HTTP header"),
    (PLAIN.replace(b"Length: 12\r\n\r\n", b"Length: 13\r\n\r\n").replace(b"WARC-Block-Digest", b"X-Digest"), "HTTP message states"),
    (PLAIN.replace(b"hello", b"jello").replace(b"WARC-Block-Digest", b"X-Digest"), "payload digest differs"),
    (REVISIT.replace(b"WARC-Profile", b"WARC-Nothing"), "revisit without a profile"),
    (PLAIN.replace(b"Content-Length: ", b"Content-Length: -", 1), "record without a length"),
    (PLAIN.replace(b"WARC-Date: ", b"no field\r\nWARC-Date: "), "header line without a field"),
])
def test_invalid_records_are_named_and_passed_over(bad, problem):
    found = list(warc.records_of(memoryview(archive([PLAIN, bad, REVISIT], PLAIN * 2))))
    assert [f and f["record_type"] for _, f, _ in found] == ["response", None, "revisit"]
    assert problem in found[1][2]


def test_cut_and_broken_frames(spark, tmp_path):
    whole = archive([PLAIN, REVISIT], PLAIN * 2)
    for end in range(len(whole)):
        found = list(warc.records_of(memoryview(whole[:end])))
        assert len(found) <= 2 and all((f is None) == (p is not None) for _, f, p in found)
    wrong = archive([PLAIN, REVISIT], PLAIN * 2)
    wrong = warc.skippable(warc.DICTIONARY, b"something else") + wrong[8 + 2 * len(PLAIN) :]
    assert all(p for _, _, p in warc.records_of(memoryview(wrong)))
    (tmp_path / "bad.warc.zst").write_bytes(whole[:-5])
    got = read_archives(spark, str(tmp_path / "bad.warc.zst"), strict=False).collect()
    assert [r.record_type for r in got] == ["response", None] and "cut off" in got[1].problem
    with pytest.raises(Exception, match="cut off"):
        read_archives(spark, str(tmp_path / "bad.warc.zst")).collect()
