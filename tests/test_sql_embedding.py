"""The SQL embedding query embeds a text once; words are cut as the pattern cuts them."""

import hashlib

import pyarrow as pa
import pytest
import regex

import checks.all  # noqa: F401
from checks.registry import QUERIES
from unitloom.functions import embedding, kernels
from unitloom.functions.lexical import NON_WORD


def test_every_text_goes_to_one_call(spark, tmp_path, monkeypatch):
    place = str(tmp_path / "rows")

    def counting(words, dim):
        with open(place, "a") as f:
            f.write(f"{len(words)}\n")
        return kernels.hash_vectors(words, dim)

    docs = [(i, f"word{i} and Word{i % 5}") for i in range(40)] + [(-3, "minus three"), (None, "no id"), (44, None), (46, None), (48, "")]
    spark.createDataFrame(docs, "doc_id long, text string").coalesce(2).write.parquet(str(tmp_path / "documents.parquet"))
    monkeypatch.setitem(embedding._models, embedding.DEFAULT_MODEL, counting)
    try:
        rows = QUERIES["udf_1_sql_embedding"](spark, str(tmp_path)).collect()
    finally:
        monkeypatch.undo()
        embedding.register_sql(spark)
    with open(place) as f:
        assert sum(map(int, f)) == len(docs) - 1  # NULL text 44 goes nowhere; the words of NULL text 46 are none
    want = {(i, b, round(float(w), 6)) for i, t in docs for b, w in enumerate(embedding.embed_literal(t or "")) if w}
    assert {(r.doc_id, r.bucket, r.w) for r in rows} == want and len(rows) == len(want)


@pytest.mark.parametrize("text", ["", "..", "x", " y ", "İstanbul ǅ ß ΑΣ", "áb 1½_x漢字 𝒳𝟘!", "a\x00b\tc"])
def test_words_are_those_of_the_pattern(text):
    cut = regex.compile(NON_WORD)
    words = kernels.Words(cut)
    for _ in range(2):
        column = pa.array(["z", text, "", text, "z"]).slice(1, 4)
        want = [w for w in cut.split(text.lower()) if w]
        assert words.of(column).to_pylist() == [want, [], want, ["z"]]


def test_buckets_and_signs_follow_the_digest(monkeypatch):
    monkeypatch.setattr(kernels, "KEPT_WORDS", 2)
    monkeypatch.setattr(kernels, "_digests", {})
    words = ["the", "ß", "a", "b", "the"]
    for _ in range(2):
        bucket, sign = kernels._buckets_and_signs(words, 384)
        for w, b, s in zip(words, bucket, sign):
            digest = hashlib.md5(w.encode()).hexdigest()
            assert (b, s) == (int(digest[:8], 16) % 384, 1.0 if digest[8] < "8" else -1.0)
    assert len(kernels._digests) == 2
