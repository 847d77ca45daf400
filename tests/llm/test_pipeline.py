"""Every stage on its own input against brute force, over the small tables."""

from collections import Counter

import numpy as np
import public_tokenizers
import tiktoken
from test_linedups import expected
from test_minhash import brute
from test_mixing import goals

import corpus_pipeline
from unitloom.llm import toxicity
from unitloom.llm.bpe import read_ranks
from unitloom.llm.mixing import plan
from unitloom.llm.shared import saved

SF = "/root/testdata/sf0.001"


def rows(df):
    return Counter(map(tuple, df.collect()))


def test_stages_follow_their_input(spark):
    ids = {}
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, steps = docs.columns, [docs]
    for name, stage in corpus_pipeline.STAGES:
        steps.append(saved(stage(spark, steps[-1], SF)))
        ids[name] = steps[-1]
    first, clean, lines, single, mix, tokens = steps
    assert all(s.columns == columns for s in steps[:5])

    model = toxicity.fit(first, spark.read.parquet(f"{SF}/labels.parquet"))
    assert rows(clean) == rows(toxicity.score(first, model).filter("predicted = 0").select(columns))

    want = expected([(r.doc_id, r.text) for r in clean.collect()])
    assert sorted(((r.doc_id, r.text) for r in lines.collect()), key=str) == sorted(((d, t) for d, t, _, _ in want), key=str)
    assert all(r.n_chars == len(r.text) for r in lines.collect())

    kept = {d for d, _, _, keep in brute([(r.doc_id, r.text) for r in lines.collect()], 5, 80) if keep}
    assert rows(single) == Counter({k: v for k, v in rows(lines).items() if k[0] in kept})

    planned = {(r.doc_id): r for r in plan(single).collect()}
    sizes, target = goals([(r.doc_id, r.text, r.source) for r in single.collect()])
    assert all(abs(r.target - target[r.source]) < 1e-6 and r.source_size == sizes[r.source] for r in planned.values())
    copies = Counter(r.doc_id for r in mix.collect())
    assert copies == Counter({d: r.repeats for d, r in planned.items() if r.repeats})

    exact = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=read_ranks(public_tokenizers.path("byte_bpe_50k.tiktoken")), special_tokens={})
    encoded = Counter((r.doc_id, np.array(exact.encode_ordinary(r.text or ""), "<u4").tobytes(), r.text or "") for r in mix.collect())
    assert Counter((r.doc_id, bytes(r.ids), r.text) for r in tokens.collect()) == encoded
    assert all(r.n_tokens == len(r.ids) // 4 for r in tokens.collect())


def test_odd_rows_pass_every_stage(spark):
    df = spark.createDataFrame(
        [(None, None, None, None, None), (1, None, "en", "a", 0), (2, "", "en", "a", 0), (3, "one two three", "en", None, 13), (3, "one two three", "en", None, 13), (4, "x " * 50_000, None, "b", 1), (None, "no id", "en", "b", 5)],
        spark.read.parquet(f"{SF}/documents.parquet").schema,
    )
    for start in (df, df.limit(0)):
        docs = saved(start)
        for name, stage in corpus_pipeline.STAGES:
            docs = saved(stage(spark, docs, SF))
            if name == "near_dedup" and start is df:
                assert Counter(r.doc_id for r in docs.collect()) == Counter([None, 1, 2, 3, 4, None])
        assert start is df or docs.count() == 0
