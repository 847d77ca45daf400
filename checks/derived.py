"""Inputs derived from the given tables, in Spark and as SQL common table expressions."""

import uuid

from pyspark.sql import DataFrame, SparkSession, functions as F

from unitloom.functions import texts
from unitloom.functions.embedding import embed_lanes
from unitloom.session import shared_folder, spread


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def scratch(spark: SparkSession) -> str:
    """A fresh folder in the shared folder of the session."""
    return f"{shared_folder(spark)}/{uuid.uuid4()}"


# -- units: one per document ---------------------------------------------------------

COMMA_WORDS = r"(\p{L}+),"


def bare_units(spark, sf_dir) -> DataFrame:
    doc = spread(table(spark, sf_dir, "documents"))
    home = F.when(F.col("doc_id") % 7 == 0, "tests").otherwise("src")
    path = F.concat(home, F.lit("/"), "source", F.lit("/"), "lang", F.lit("/d"), "doc_id", F.lit(".py"))
    chain = F.when(F.col("doc_id") % 3 == 0, F.array(F.concat(F.lit("C"), "source"))).otherwise(
        F.array().cast("array<string>")
    )
    df = doc.select(
        "doc_id", "source", F.col("lang").alias("namespace"), F.col("text").alias("content"),
        path.alias("path"),
        F.concat_ws(".", home, "source", "lang", F.concat(F.lit("d"), "doc_id")).alias("module"),
        F.lit("python").alias("language"),
        F.concat(F.lit("d"), "doc_id").alias("symbol"),
        chain.alias("class_chain"),
        F.when(F.col("doc_id") % 2 == 0, F.col("source")).alias("package"),
        F.regexp_extract_all("text", F.lit(COMMA_WORDS), F.lit(1)).alias("raw_calls"),
        F.lit("").alias("doc"),
        F.lit(1).alias("start_line"),
        (F.length("text") - F.length(F.replace("text", F.lit("\n"), F.lit(""))) + 1).alias("end_line"),
    )
    df = df.withColumns(
        {
            "calls": F.array_distinct("raw_calls"),
            "role": texts.role(),
            "qualified_name": texts.qualified_name(),
        }
    )
    return df.withColumn("id", texts.unit_id())


def refs(spark, sf_dir) -> DataFrame:
    """Two generations of refs for every unit with a class; the later one counts."""
    df = bare_units(spark, sf_dir).filter(F.size("class_chain") > 0)
    df = df.withColumn("seq", F.explode(F.array(F.lit(1), F.lit(2))))
    base = F.when(F.col("seq") == 1, "Old").otherwise("Base")
    refs = F.create_map(
        F.lit("mro"), F.concat(base, F.lit(", C"), "source", F.lit(", object")),
        F.lit("metaclass"), F.lit("type"), F.lit("mro_source"), F.lit("static"),
    )
    return df.select(F.col("id").alias("unit_id"), "qualified_name", "path", "language", refs.alias("refs"), "seq")


def text_units(spark, sf_dir) -> DataFrame:
    """Units with refs, base, search and lane texts."""
    latest = refs(spark, sf_dir).filter("seq = 2").select(F.col("unit_id").alias("id"), "refs")
    df = bare_units(spark, sf_dir).join(latest, "id", "left")
    df = df.withColumns({"embed_text": texts.embed_text(), "search_text": texts.search_text()})
    return df.withColumns({"content_hash": texts.content_hash(), **texts.lane_texts()})


def search_units(spark, sf_dir) -> DataFrame:
    return embed_lanes(text_units(spark, sf_dir))


def queries(spark, sf_dir) -> DataFrame:
    return table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), F.col("text").alias("query"))


def edges(spark, sf_dir) -> DataFrame:
    """Two known targets per unit, one unknown, and a hub that every `en` unit calls."""
    units = bare_units(spark, sf_dir).select("doc_id", "id", "source", "namespace", "qualified_name")
    n = table(spark, sf_dir, "documents").count()
    hub = F.when(F.col("namespace") == "en", F.lit(0))
    links = units.select(
        F.col("id").alias("caller_id"),
        F.explode(F.array((F.col("doc_id") * 7 + 1) % n, (F.col("doc_id") * 3 + 2) % n, hub)).alias("target"),
    )
    names = units.select(F.col("doc_id").alias("target"), F.col("qualified_name").alias("callee_qname"))
    known = links.join(names, "target").select("caller_id", "callee_qname")
    unknown = units.select(F.col("id").alias("caller_id"), F.concat(F.lit("ext."), "source", F.lit(".fn")).alias("callee_qname"))
    raw = F.substring_index("callee_qname", ".", -1)
    return known.unionByName(unknown).distinct().withColumn("callee_raw", raw)


CTES = {}


def cte(name, body, needs=()):
    CTES[name] = (body, needs)


def sql(select: str, *needs: str) -> str:
    """A statement with the named expressions and all they build on."""
    order = []

    def visit(name):
        for other in CTES[name][1]:
            visit(other)
        if name not in order:
            order.append(name)

    for name in needs:
        visit(name)
    if not order:
        return select
    return "WITH " + ",\n".join(f"{n} AS ({CTES[n][0]})" for n in order) + "\n" + select


SQL_BLANKS = r"[\s\x1c-\x1f\x{85}\p{Z}]+"
SQL_FIRST = r"^[^\n\r\x0b\x0c\x1c\x1d\x1e\x{85}\x{2028}\x{2029}]*"


def sql_distinct(values):
    """Distinct list elements in first-occurrence order."""
    return f"list_filter({values}, lambda x, i: list_position({values}, x) = i)"


cte(
    "units",
    """SELECT *, path || '::' || qualified_name AS id FROM (
    SELECT *, module || CASE WHEN len(class_chain) > 0 THEN '.' || class_chain[1] ELSE '' END || '.' || symbol
             AS qualified_name,
           CASE WHEN len(class_chain) > 0 THEN 'method' ELSE 'function' END AS role
    FROM (
      SELECT doc_id, source, lang AS namespace, text AS content,
        (CASE WHEN doc_id % 7 = 0 THEN 'tests/' ELSE 'src/' END) || source || '/' || lang || '/d' || doc_id || '.py' AS path,
        (CASE WHEN doc_id % 7 = 0 THEN 'tests.' ELSE 'src.' END) || source || '.' || lang || '.d' || doc_id AS module,
        'python' AS language, 'd' || doc_id AS symbol,
        CASE WHEN doc_id % 3 = 0 THEN ['C' || source] ELSE CAST([] AS VARCHAR[]) END AS class_chain,
        CASE WHEN doc_id % 2 = 0 THEN source END AS package,
        regexp_extract_all(text, '(\\p{L}+),', 1) AS raw_calls,
        1 AS start_line, CAST(length(text) - length(replace(text, chr(10), '')) + 1 AS INTEGER) AS end_line
      FROM documents))""",
)
cte(
    "called",
    """SELECT *, """ + sql_distinct("raw_calls") + """ AS calls,
    regexp_replace(regexp_extract(content, '""" + SQL_FIRST + """'), '^""" + SQL_BLANKS + "|" + SQL_BLANKS + """$', '', 'g') AS sig
    FROM units""",
    ["units"],
)
cte(
    "texted",
    """SELECT *,
      base || CASE WHEN len(class_chain) > 0 THEN chr(10) || 'ref: mro | Base, C' || source || ', object' || chr(10) || 'ref: metaclass | type' ELSE '' END AS embed_func_text,
      'caller `' || symbol || '` (' || qualified_name || ') '
        || CASE WHEN len(class_chain) > 0 THEN 'in ' || class_chain[1] ELSE 'module ' || module END
        || ' | calls: ' || CASE WHEN len(calls) > 0 THEN array_to_string(calls[1:15], ', ') ELSE 'none' END AS embed_call_text,
      CASE WHEN len(class_chain) > 0
        THEN 'class: ' || class_chain[1] || chr(10) || 'mro: Base, C' || source || ', object' || chr(10) || 'metaclass: type'
        ELSE 'module: ' || module END AS embed_class_text
    FROM (SELECT *,
      left('[python] ' || role || ' `' || symbol || '` in ' || CASE WHEN len(class_chain) > 0 THEN class_chain[1] ELSE module END
        || ' | path: ' || path || CASE WHEN sig <> '' THEN chr(10) || sig ELSE '' END
        || chr(10) || 'calls: ' || CASE WHEN len(calls) > 0 THEN array_to_string(calls[1:10], ', ') ELSE 'none' END, 400) AS base,
      '[namespace:' || namespace || ']' || chr(10) || 'qualified_name:' || qualified_name || chr(10) || 'module:' || module
        || chr(10) || 'path:' || path || chr(10) || 'role:' || role
        || CASE WHEN package IS NOT NULL THEN chr(10) || 'package:' || package ELSE '' END
        || CASE WHEN len(class_chain) > 0 THEN chr(10) || 'class:' || class_chain[1] ELSE '' END
        || CASE WHEN sig <> '' THEN chr(10) || sig ELSE '' END AS search_text
      FROM called)""",
    ["called"],
)
cte("queries", "SELECT item_id AS query_id, text AS query FROM benchmark")
cte(
    "edges",
    """SELECT DISTINCT caller_id, callee_qname, regexp_extract(callee_qname, '[^.]*$') AS callee_raw FROM (
      SELECT a.id AS caller_id, b.qualified_name AS callee_qname
      FROM (SELECT id, unnest([(doc_id * 7 + 1) % n, (doc_id * 3 + 2) % n, CASE WHEN namespace = 'en' THEN 0 END]) AS target
            FROM units, (SELECT count(*) AS n FROM documents)) a
      JOIN units b ON b.doc_id = a.target
      UNION ALL
      SELECT id, 'ext.' || source || '.fn' FROM units)""",
    ["units"],
)


def sql_tokens(text):
    return f"list_filter(regexp_split_to_array(lower({text}), '[^\\p{{L}}\\p{{N}}_]+'), lambda x: x <> '')"


def vector_ctes(name, source, key, text, dim=384, needs=()):
    """`name`(key, bucket, w): non-zero elements of the hashed, normed float vector."""
    cte(
        name,
        f"""SELECT k, bucket, CAST(CAST(w / sqrt(sum(w * w) OVER (PARTITION BY k)) AS FLOAT) AS DOUBLE) AS w FROM (
          SELECT k, CAST('0x' || substr(h, 1, 8) AS BIGINT) % {dim} AS bucket,
                 CAST(sum(CASE WHEN substr(h, 9, 1) < '8' THEN 1 ELSE -1 END) AS DOUBLE) AS w
          FROM (SELECT k, md5(t) AS h FROM (SELECT {key} AS k, unnest({sql_tokens(text)}) AS t FROM {source}))
          GROUP BY 1, 2) WHERE w <> 0""",
        needs,
    )


for lane in ("func", "call", "class"):
    vector_ctes(f"v_{lane}", "texted", "id", f"embed_{lane}_text", needs=["texted"])
    cte(
        f"d_{lane}",
        f"""SELECT l.k AS id, r.query_id, 1 - coalesce(x.dot, 0) / (l.len * r.len) AS d
        FROM (SELECT k, sqrt(sum(w * w)) AS len FROM v_{lane} GROUP BY k) l,
             (SELECT k AS query_id, sqrt(sum(w * w)) AS len FROM v_query GROUP BY k) r
        LEFT JOIN (SELECT a.k AS id, b.k AS query_id, sum(a.w * b.w) AS dot
                   FROM v_{lane} a JOIN v_query b ON a.bucket = b.bucket GROUP BY 1, 2) x
          ON x.id = l.k AND x.query_id = r.query_id""",
        [f"v_{lane}", "v_query"],
    )
vector_ctes("v_query", "queries", "query_id", "query", needs=["queries"])


def rank_ctes(name, source, key, text, needs=()):
    """`name`(query_id, k, ts): text rank of every text sharing a word with a query."""
    cte(
        f"{name}_hits",
        f"""SELECT q.query_id, d.k, d.pos, d.term, q.n_terms
        FROM (SELECT k, unnest(range(1, len(ts) + 1)) AS pos, unnest(ts) AS term
              FROM (SELECT {key} AS k, {sql_tokens(text)} AS ts FROM {source})) d
        JOIN (SELECT query_id, len(ts) AS n_terms, unnest(ts) AS term
              FROM (SELECT query_id, list_distinct({sql_tokens('query')}) AS ts FROM queries)) q ON q.term = d.term""",
        [*needs, "queries"],
    )
    cte(
        name,
        f"""SELECT g.query_id, g.k,
          CASE WHEN g.n_terms = 1 THEN g.alone
               WHEN g.total = g.same THEN 1e-20
               ELSE 1 - exp(coalesce(p.logs, 0) + ((g.total - g.same) - coalesce(p.near, 0)) * ln(1 - 1e-16)) END AS ts
        FROM (SELECT query_id, k, any_value(n_terms) AS n_terms,
                     sum(n) * sum(n) / 2.0 AS total, sum(n * n) / 2.0 AS same, max(alone) AS alone
              FROM (SELECT query_id, k, term, any_value(n_terms) AS n_terms, CAST(count(*) AS DOUBLE) AS n,
                           list_sum(list_transform(range(1, count(*) + 1), lambda j: 1.0::DOUBLE / (j * j))) * 0.1::DOUBLE / 1.64493406685::DOUBLE AS alone
                    FROM {name}_hits GROUP BY 1, 2, 3) GROUP BY 1, 2) g
        LEFT JOIN (SELECT a.query_id, a.k, count(*) AS near,
                     sum(ln(1 - 0.1::DOUBLE * sqrt(1 / (1.005::DOUBLE + 0.05::DOUBLE * exp((b.pos - a.pos) / 1.5::DOUBLE - 2))))) AS logs
                   FROM {name}_hits a JOIN {name}_hits b
                     ON a.query_id = b.query_id AND a.k = b.k AND b.pos > a.pos AND b.pos <= a.pos + 100 AND a.term <> b.term
                   GROUP BY 1, 2) p ON p.query_id = g.query_id AND p.k = g.k""",
        [f"{name}_hits"],
    )


rank_ctes("ranked_text", "texted", "id", "search_text", needs=["texted"])
cte(
    "scored",
    """SELECT f.query_id, f.id, f.d AS d_func, c.d AS d_call, s.d AS d_class, coalesce(t.ts, 1e-20) AS ts_score
    FROM d_func f
    JOIN d_call c ON c.id = f.id AND c.query_id = f.query_id
    JOIN d_class s ON s.id = f.id AND s.query_id = f.query_id
    LEFT JOIN ranked_text t ON t.k = f.id AND t.query_id = f.query_id""",
    ["d_func", "d_call", "d_class", "ranked_text"],
)
SQL_IS_TEST = "(path LIKE '%/tests/%' OR path LIKE 'tests/%' OR contains(path, '/test_') OR namespace = 'tests')"
