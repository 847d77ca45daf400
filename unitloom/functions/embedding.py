"""Text embedding with a registry of models.

The shipped model is signed feature hashing (Weinberger et al., 2009). A model is a
function (list column of words, dimension) -> float matrix; a neural model plugs in
through `register_model` and runs in the same Arrow batches.
"""

import functools

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from unitloom.functions import kernels, shipping  # noqa: F401
from unitloom.functions.lexical import NON_WORD, tokens
from unitloom.schema import EMBED_DIM
from unitloom.session import small_batches

DEFAULT_MODEL = "feature-hashing"

# Rows that a SQL function turns into words and vectors at a time.
ROWS_AT_ONCE = 64

_models = {DEFAULT_MODEL: kernels.hash_vectors}


def register_model(name: str, encode) -> None:
    _models[name] = encode


def embed_tokens(words, model: str = DEFAULT_MODEL, dim: int = EMBED_DIM) -> Column:
    encode = _models[model]

    @F.arrow_udf(T.ArrayType(T.FloatType()))
    def embed(column: pa.Array) -> pa.Array:
        return kernels.vectors_to_lists(encode(column, dim))

    return embed(words)


def embed_text(text, model: str = DEFAULT_MODEL, dim: int = EMBED_DIM) -> Column:
    """Vector of a text; words are cut in the JVM, only hashing happens in Arrow."""
    return embed_tokens(tokens(text), model, dim)


def embed_literal(text: str, dim: int = EMBED_DIM, model: str = DEFAULT_MODEL) -> list:
    """Vector of one query string, computed where the query is written down."""
    import regex

    words = [w for w in regex.split(NON_WORD, text.lower()) if w]
    row = _models[model](pa.array([words], pa.list_(pa.string())), dim)
    return [float(x) for x in row[0]]


def register_sql(spark: SparkSession, dim: int = EMBED_DIM) -> None:
    """SQL functions embed_text(text [, model]) and embed_words(array<string> [, model]).

    The default model is the shipped one; a NULL text or model gives NULL. Models are those
    registered so far; call this again after `register_model`.
    """
    small_batches(spark)
    models, default, non_word, step = dict(_models), DEFAULT_MODEL, NON_WORD, ROWS_AT_ONCE

    def vectors(words: pa.Array, names: pa.Array | None) -> pa.Array:
        if names is None:
            return kernels.vectors_to_lists(models[default](words, dim))
        used = names.unique().to_pylist()
        if len(used) == 1:
            return kernels.vectors_to_lists(models[used[0]](words, dim))
        out = np.zeros((len(words), dim), np.float32)
        for name in used:
            rows = np.flatnonzero(pc.equal(names, name).to_numpy(zero_copy_only=False))
            out[rows] = models[name](words.take(pa.array(rows)), dim)
        return kernels.vectors_to_lists(out)

    def sliced(columns, embed) -> pa.Array:
        """Few rows at a time, so that their words are not all held; only rows whose arguments are there are embedded."""
        parts = []
        for at in range(0, len(columns[0]), step):
            part = [c.slice(at, step) for c in columns]
            there = functools.reduce(pc.and_, [c.is_valid() for c in part])
            if there.true_count == 0:
                parts.append(pa.nulls(len(there), pa.list_(pa.float32())))
                continue
            whole = there.true_count == len(there)
            found = embed(*[c if whole else c.filter(there) for c in part])
            if not whole:
                place = np.cumsum(there.to_numpy(zero_copy_only=False)) - 1
                found = found.take(pa.array(place, mask=~there.to_numpy(zero_copy_only=False)))
            parts.append(found)
        return pa.concat_arrays(parts) if parts else pa.array([], pa.list_(pa.float32()))

    @F.arrow_udf(T.ArrayType(T.FloatType()))
    def embed_words(*columns: pa.Array) -> pa.Array:
        found = sliced(columns, lambda words, names=None: vectors(words, names))
        empty = columns[0].is_null() if len(columns) == 1 else pc.and_(columns[0].is_null(), columns[1].is_valid())
        return pc.if_else(empty, pa.scalar([0.0] * dim, found.type), found) if empty.true_count else found

    cutters = []

    @F.arrow_udf(T.ArrayType(T.FloatType()))
    def embed_text(*columns: pa.Array) -> pa.Array:
        import regex

        if not cutters:
            cutters.append(kernels.Words(regex.compile(non_word)))
        return sliced(columns, lambda texts, names=None: vectors(cutters[0].of(texts), names))

    spark.udf.register("embed_words", embed_words)
    spark.udf.register("embed_text", embed_text)


def embed_lanes(df: DataFrame, model: str = DEFAULT_MODEL, dim: int = EMBED_DIM) -> DataFrame:
    """vec_func, vec_call, vec_class from the three lane texts, in one Arrow pass."""
    small_batches(df.sparkSession)
    return df.withColumns(
        {
            f"vec_{lane}": embed_text(f"embed_{lane}_text", model, dim)
            for lane in ("func", "call", "class")
        }
    )
