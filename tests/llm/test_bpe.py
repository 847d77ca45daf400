import hashlib

import numpy as np
import public_tokenizers
import pytest
import tiktoken

from unitloom.llm.bpe import decode, encode, packed, read_ranks, unpacked


@pytest.fixture(scope="module")
def ranks():
    return read_ranks(public_tokenizers.path("byte_bpe_50k.tiktoken"))


def result(spark, ranks, rows, **more):
    df = spark.createDataFrame([(d, t, "x") for d, t in rows], "doc_id long, text string, ids string")
    out = decode(encode(df, ranks, public_tokenizers.PATTERN, **more), ranks)
    return sorted(((r.doc_id, bytes(r.ids), bytes(r.decoded)) for r in out.collect()), key=str)


@pytest.mark.parametrize("block_chars", [300, 12_000_000])
def test_ids_equal_the_tokenizer_library(spark, ranks, prose, block_chars):
    texts = prose(60, seed=4) + [
        None, "", " ", "  \n\n  a  b", "it's we'LL 12ab x　y", "x" * 30_000, "naïve 日本語 \U0001f600\U0001f600 ٣٤", "<|endoftext|>",
        "₏z ՘a ౜b ౜12", "\x00\x01 \x1c\x85 ", " ".join(["many words here"] * 6000),
    ]
    rows = [(i, t) for i, t in enumerate(texts)] + [(3, texts[3]), (None, "no id"), (5, "same id")]
    exact = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    want = sorted(
        ((d, np.array(exact.encode_ordinary(t or ""), "<u4").tobytes(), (t or "").encode()) for d, t in rows), key=str
    )
    assert result(spark, ranks, rows, block_chars=block_chars) == want


def test_no_rows(spark, ranks):
    assert result(spark, ranks, []) == []


@pytest.mark.parametrize("numbers, width", [([], 4), ([0], 4), (range(70_000), 4), ([1 << 23, 5], 4), ([1 << 24, 0], 8), ([7, 1 << 40], 8)])
def test_numbers_are_no_wider_than_they_need(numbers, width):
    for given in (list(numbers), np.array(list(numbers), np.int64)):
        out = unpacked(packed(given))
        assert out.tolist() == list(numbers)
        assert out.dtype.itemsize == width
