"""Column layouts of the two tables and of the files exchanged between jobs."""

from pyspark.sql import types as T

EMBED_DIM = 384

_s, _i = T.StringType(), T.IntegerType()
_strings = T.ArrayType(_s)
_vector = T.ArrayType(T.FloatType())


def _struct(*fields):
    return T.StructType([T.StructField(n, t, null) for n, t, null in fields])


# A unit as it leaves extraction; `seq` orders units with one id inside a file.
UNIT = _struct(
    ("id", _s, False),
    ("qualified_name", _s, False),
    ("module", _s, True),
    ("language", _s, True),
    ("role", _s, True),
    ("symbol", _s, True),
    ("class_chain", _strings, True),
    ("path", _s, True),
    ("package", _s, True),
    ("start_line", _i, True),
    ("end_line", _i, True),
    ("content", _s, False),
    ("calls", _strings, True),
    ("embed_text", _s, True),
    ("namespace", _s, True),
    ("doc", _s, True),
)

CHUNK = T.StructType(
    UNIT.fields
    + [T.StructField("search_text", _s, True), T.StructField("content_hash", _s, True)]
)

# Keys a chunk line must carry; the others have defaults.
CHUNK_REQUIRED = [
    "qualified_name", "module", "language", "role", "symbol",
    "path", "start_line", "end_line", "content", "namespace",
]

REFS = _struct(
    ("unit_id", _s, False),
    ("qualified_name", _s, True),
    ("path", _s, True),
    ("language", _s, True),
    ("refs", T.MapType(_s, _s), True),
)

CODE_UNITS = _struct(
    ("id", _s, False),
    ("qualified_name", _s, False),
    ("module", _s, True),
    ("language", _s, True),
    ("role", _s, True),
    ("symbol", _s, True),
    ("class_chain", _strings, True),
    ("path", _s, True),
    ("start_line", _i, True),
    ("end_line", _i, True),
    ("namespace", _s, True),
    ("package", _s, True),
    ("content", _s, False),
    ("search_text", _s, True),
    ("calls", _strings, True),
    ("embed_func_text", _s, True),
    ("embed_call_text", _s, True),
    ("embed_class_text", _s, True),
    ("vec_func", _vector, True),
    ("vec_call", _vector, True),
    ("vec_class", _vector, True),
    ("content_hash", _s, True),
    ("job_id", _s, True),
    ("updated_at", T.TimestampType(), True),
)

CODE_EDGES = _struct(
    ("caller_id", _s, False),
    ("callee_qname", _s, False),
    ("callee_raw", _s, True),
)

LANES = ("func", "call", "class")
