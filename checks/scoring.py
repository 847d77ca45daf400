"""Vector and lexical scoring, top-k and the composite searches."""

from pyspark.sql import functions as F

from checks.derived import (
    SQL_IS_TEST, cte, edges, queries, rank_ctes, scratch, search_units, sql, sql_distinct,
    sql_tokens, table, text_units, vector_ctes,
)
from checks.registry import check
from unitloom.functions import embedding, lexical, texts, vectors
from unitloom.functions.paths import is_test_hit
from unitloom.operators import ann, graph, topk
from unitloom.plans import documents, search
from unitloom.session import cut_lineage

QUESTION = "read the parsed configuration from a file"

# -- vectors of the embeddings table ---------------------------------------------------

cte(
    "lanes",
    """SELECT a.vec_id, a.label, CAST(a.embedding AS DOUBLE[]) AS vf, CAST(b.embedding AS DOUBLE[]) AS vc, CAST(c.embedding AS DOUBLE[]) AS vk
    FROM (SELECT *, count(*) OVER () AS n FROM embeddings) a
    JOIN embeddings b ON b.vec_id = (a.vec_id + 1) % a.n
    JOIN embeddings c ON c.vec_id = (a.vec_id + 7) % a.n""",
)
cte(
    "lane_distances",
    """SELECT vec_id, 1 - list_dot_product(vf, vc) / sqrt(list_dot_product(vf, vf) * list_dot_product(vc, vc)) AS d_func,
      1 - list_dot_product(vf, vk) / sqrt(list_dot_product(vf, vf) * list_dot_product(vk, vk)) AS d_call,
      1 - list_dot_product(vc, vk) / sqrt(list_dot_product(vc, vc) * list_dot_product(vk, vk)) AS d_class FROM lanes""",
    ["lanes"],
)


def lanes(spark, sf_dir):
    """Three vectors per row: the embedding and those 1 and 7 places further on."""
    e = table(spark, sf_dir, "embeddings")
    n = e.count()

    def moved(by, name):
        return e.select(
            F.pmod(F.col("vec_id") - by, F.lit(n)).alias("vec_id"), F.col("embedding").alias(name)
        )

    base = e.select("vec_id", "label", F.col("embedding").alias("vec_func"))
    return base.join(moved(1, "vec_call"), "vec_id").join(moved(7, "vec_class"), "vec_id")


def lane_distances(spark, sf_dir):
    return lanes(spark, sf_dir).select(
        "vec_id",
        vectors.cosine_distance("vec_func", "vec_call").alias("d_func"),
        vectors.cosine_distance("vec_func", "vec_class").alias("d_call"),
        vectors.cosine_distance("vec_call", "vec_class").alias("d_class"),
    )


@check(
    "vec_2_cosine_distance",
    sql("SELECT vec_id, round(d_func, 6) AS d_func, round(d_call, 6) AS d_call, round(d_class, 6) AS d_class FROM lane_distances", "lane_distances"),
)
def vec_2(spark, sf_dir):
    d = lane_distances(spark, sf_dir)
    return d.select("vec_id", *[F.round(c, 6).alias(c) for c in ("d_func", "d_call", "d_class")])


cte("asked_text", f"SELECT 0 AS query_id, '{QUESTION}' AS query")
vector_ctes("v_asked", "asked_text", "query_id", "query", dim=64, needs=["asked_text"])
cte("asked", """SELECT list(coalesce(w, 0.0::DOUBLE) ORDER BY b) AS q FROM (SELECT unnest(range(0, 64)) AS b) LEFT JOIN v_asked ON bucket = b""", ["v_asked"])
cte(
    "asked_distances",
    """SELECT vec_id, label, 1 - list_dot_product(vf, q) / sqrt(list_dot_product(vf, vf) * list_dot_product(q, q)) AS d_func,
      1 - list_dot_product(vc, q) / sqrt(list_dot_product(vc, vc) * list_dot_product(q, q)) AS d_call,
      1 - list_dot_product(vk, q) / sqrt(list_dot_product(vk, vk) * list_dot_product(q, q)) AS d_class FROM lanes, asked""",
    ["lanes", "asked"],
)


def asked_distances(spark, sf_dir):
    """One query as a literal vector, so scoring is a plain projection."""
    q = vectors.vector_literal(embedding.embed_literal(QUESTION, 64))
    lanes_ = lanes(spark, sf_dir)
    return lanes_.select(
        "vec_id", "label", *[vectors.cosine_distance(f"vec_{l}", q).alias(f"d_{l}") for l in ("func", "call", "class")]
    ).withColumn("ts_score", F.lit(0.0))


@check(
    "vec_3_lane_fusion",
    sql("SELECT vec_id, round(0.7 * d_func + 0.15 * d_call + 0.05 * d_class, 6) AS score FROM asked_distances", "asked_distances"),
)
def vec_3(spark, sf_dir):
    score = vectors.fused_score(vectors.lane_weights("func"))
    return asked_distances(spark, sf_dir).select("vec_id", F.round(score, 6).alias("score"))


@check(
    "vec_4_lane_presets",
    sql(
        """SELECT vec_id, round(0.6 * d_func + 0.2 * d_call + 0.2 * d_class, 6) AS balanced,
        round(0.7 * d_func + 0.15 * d_call + 0.05 * d_class, 6) AS func,
        round(0.15 * d_func + 0.7 * d_call + 0.05 * d_class, 6) AS call,
        round(0.15 * d_func + 0.05 * d_call + 0.7 * d_class, 6) AS class,
        round(0.6 * d_func + 0.2 * d_call + 0.5 * d_class, 6) AS overridden FROM lane_distances""",
        "lane_distances",
    ),
)
def vec_4(spark, sf_dir):
    d = lane_distances(spark, sf_dir).withColumn("ts_score", F.lit(0.0))
    sets = {name: vectors.lane_weights(name) for name in vectors.LANE_PRESETS}
    sets["overridden"] = vectors.lane_weights(overrides={"w_class": 0.5})
    return d.select("vec_id", *[F.round(vectors.fused_score(w), 6).alias(n) for n, w in sets.items()])


@check(
    "top_1_by_score",
    sql(
        """SELECT vec_id, round(score, 6) AS score FROM (
        SELECT vec_id, CAST(vec_id AS VARCHAR) AS id, round(0.6 * d_func + 0.2 * d_call + 0.2 * d_class, 9) AS score FROM asked_distances)
        ORDER BY round(score, 9) NULLS LAST, id LIMIT 10""",
        "asked_distances",
    ),
)
def top_1(spark, sf_dir):
    d = asked_distances(spark, sf_dir).select(
        "vec_id", F.col("vec_id").cast("string").alias("id"),
        F.round(vectors.fused_score(vectors.DEFAULT_WEIGHTS), 9).alias("score"),
    )
    return topk.top_k(d, 10).select("vec_id", F.round("score", 6).alias("score"))


# -- approximate candidates --------------------------------------------------------------

vector_ctes("v_query64", "queries", "query_id", "query", dim=64, needs=["queries"])
ANN_ROUNDS = 4


def _cells_sql():
    """Unit vectors, their seeds by MD5 of the id, and the rounds of the fit on the sphere."""
    steps = []
    for k in range(ANN_ROUNDS + 1):
        steps.append(f"""a{k} AS MATERIALIZED (SELECT vec_id, arg_min(cell, (-list_dot_product(x, c), cell)) AS cell FROM v, c{k} GROUP BY vec_id)""")
        if k < ANN_ROUNDS:
            steps.append(f"""m{k} AS MATERIALIZED (SELECT cell, list(s ORDER BY i) AS s FROM (
              SELECT cell, i, sum(e) AS s FROM (SELECT cell, unnest(range(64)) AS i, unnest(x) AS e FROM a{k} JOIN v USING (vec_id)) GROUP BY 1, 2) GROUP BY 1),
            c{k + 1} AS MATERIALIZED (SELECT cell, CASE WHEN s IS NULL THEN c ELSE list_transform(s, lambda e: e / sqrt(list_dot_product(s, s))) END AS c
              FROM c{k} LEFT JOIN m{k} USING (cell))""")
    return f"""WITH u AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings),
    v AS MATERIALIZED (SELECT vec_id, list_transform(e, lambda z: z / sqrt(list_dot_product(e, e))) AS x FROM u WHERE list_dot_product(e, e) > 0),
    c0 AS MATERIALIZED (SELECT cell, x AS c FROM (SELECT x, row_number() OVER (ORDER BY md5(CAST(vec_id AS VARCHAR)), CAST(vec_id AS VARCHAR)) - 1 AS cell FROM v)
      WHERE cell < (SELECT round(sqrt(count(*))) FROM v)), {", ".join(steps)}"""


cte("ann_units", _cells_sql() + f" SELECT vec_id, cell FROM a{ANN_ROUNDS}")
cte("ann_cells", _cells_sql() + f" SELECT cell, unnest(range(64)) AS i, unnest(c) AS w FROM c{ANN_ROUNDS}")
cte("ann_probes", """SELECT query_id, cell FROM (
  SELECT query_id, cell, row_number() OVER (PARTITION BY query_id ORDER BY dot DESC, cell) AS place FROM (
    SELECT k AS query_id, cell, sum(a.w * q.w) AS dot FROM v_query64 q JOIN ann_cells a ON i = bucket GROUP BY 1, 2))
  WHERE place <= (SELECT ceil(count(DISTINCT cell) / 16.0) FROM ann_cells)""", ["ann_cells", "v_query64"])
cte("vec_elements", """SELECT vec_id, unnest(range(0, 64)) AS i, unnest(CAST(embedding AS DOUBLE[])) AS x FROM embeddings""")


def _queries64(spark, sf_dir):
    return search.prepare_queries(queries(spark, sf_dir), dim=64)


@check(
    "vec_5_approximate_candidates",
    sql(
        """SELECT query_id, rank, vec_id, round(d_func, 6) AS d_func FROM (
        SELECT query_id, vec_id, d_func, row_number() OVER (PARTITION BY query_id ORDER BY round(d_func, 9), CAST(vec_id AS VARCHAR)) AS rank FROM (
          SELECT c.query_id, c.vec_id, 1 - coalesce(x.dot, 0) / (u.len * q.len) AS d_func
          FROM (SELECT query_id, vec_id FROM ann_units JOIN ann_probes USING (cell)) c
          JOIN (SELECT vec_id, sqrt(sum(x * x)) AS len FROM vec_elements GROUP BY 1) u USING (vec_id)
          JOIN (SELECT k AS query_id, sqrt(sum(w * w)) AS len FROM v_query64 GROUP BY 1) q USING (query_id)
          LEFT JOIN (SELECT k AS query_id, vec_id, sum(x * w) AS dot FROM vec_elements JOIN v_query64 ON i = bucket GROUP BY 1, 2) x
            USING (query_id, vec_id))) WHERE rank <= 10""",
        "ann_units", "ann_probes", "vec_elements",
    ),
)
def vec_5(spark, sf_dir):
    units = table(spark, sf_dir, "embeddings").select(
        F.col("vec_id").cast("string").alias("id"), F.col("embedding").alias("vec_func")
    )
    folder = scratch(spark) + "/cells"
    ann.write_index(units, folder, rounds=ANN_ROUNDS)
    near = ann.nearest(*ann.read_index(spark, folder), _queries64(spark, sf_dir), k=10, dim=64)
    return near.select("query_id", "rank", F.col("id").cast("long").alias("vec_id"), F.round("d_func", 6).alias("d_func"))


# -- embeddings of text --------------------------------------------------------------------


def _elements(df, key, vector):
    # The outer form keeps Spark from a filter on the vector below, which would compute it twice; its rows without an element go.
    return df.select(key, F.posexplode_outer(vector).alias("bucket", "w")).filter("w <> 0").select(
        key, F.col("bucket").cast("long").alias("bucket"), F.round(F.col("w").cast("double"), 6).alias("w")
    )


@check(
    "vec_1_text_embedding",
    sql(
        "\nUNION ALL ".join(f"SELECT k AS id, '{l}' AS lane, bucket, round(w, 6) AS w FROM v_{l}" for l in ("func", "call", "class")),
        "v_func", "v_call", "v_class",
    ),
)
def vec_1(spark, sf_dir):
    df = search_units(spark, sf_dir)
    lane = F.explode(F.array(*[F.struct(F.lit(l).alias("lane"), F.col(f"vec_{l}").alias("v")) for l in ("func", "call", "class")]))
    rows = df.select("id", lane.alias("x")).select("id", "x.lane", F.posexplode("x.v").alias("bucket", "w"))
    return rows.filter("w <> 0").select(
        "id", "lane", F.col("bucket").cast("long").alias("bucket"), F.round(F.col("w").cast("double"), 6).alias("w")
    )


vector_ctes("v_documents", "documents", "doc_id", "text", dim=384)


@check("udf_1_sql_embedding", sql("SELECT k AS doc_id, bucket, round(w, 6) AS w FROM v_documents", "v_documents"))
def udf_1(spark, sf_dir):
    embedding.register_sql(spark)
    # Spark runs the functions of all branches for every row: a call gets the texts of its own rows only.
    call = F.expr("CASE WHEN doc_id % 4 IN (0, 1, 2) THEN doc_id % 4 ELSE 3 END").alias("call")
    df = table(spark, sf_dir, "documents").select("doc_id", "text", call)
    df = df.select("doc_id", "call", *[F.when(F.col("call") == i, F.col("text")).alias(f"text_{i}") for i in (0, 1)],
                   *[F.when(F.col("call") == i, lexical.tokens("text")).alias(f"words_{i}") for i in (2, 3)])
    calls = ["embed_text(text_0)", "embed_text(text_1, 'feature-hashing')", "embed_words(words_2)", "embed_words(words_3, 'feature-hashing')"]
    by_call = F.expr(f"CASE call WHEN 0 THEN {calls[0]} WHEN 1 THEN {calls[1]} WHEN 2 THEN {calls[2]} ELSE {calls[3]} END")
    return _elements(df.select("doc_id", by_call.alias("v")), "doc_id", "v")


# -- lexical ---------------------------------------------------------------------------------


@check(
    "fts_1_tokenize_document",
    f"""SELECT doc_id, len(ts) AS n_tokens, md5(array_to_string(ts, ' ')) AS digest
    FROM (SELECT doc_id, {sql_tokens('text')} AS ts FROM documents)""",
)
def fts_1(spark, sf_dir):
    df = table(spark, sf_dir, "documents").select("doc_id", lexical.tokens("text").alias("ts"))
    return df.select("doc_id", F.size("ts").cast("long").alias("n_tokens"), F.md5(F.array_join("ts", " ").cast("binary")).alias("digest"))


@check(
    "fts_2_tokenize_query",
    f"""SELECT item_id, array_to_string({sql_distinct('ts')}, ' ') AS terms
    FROM (SELECT item_id, {sql_tokens('text')} AS ts FROM benchmark)""",
)
def fts_2(spark, sf_dir):
    df = table(spark, sf_dir, "benchmark")
    return df.select("item_id", F.array_join(lexical.query_terms("text"), " ").alias("terms"))


def _ranked_texts(spark, sf_dir, docs, key, text):
    """Postings are written, then searched for every benchmark text."""
    folder = scratch(spark) + "/postings"
    lexical.write_postings(docs, key, text, folder)
    ranked = lexical.text_ranks(spark.read.parquet(folder), queries(spark, sf_dir))
    return ranked.select("query_id", F.col("key").alias(key), F.round("ts_score", 6).alias("ts_score"))


@check("fts_3_text_rank", sql("SELECT query_id, k AS id, round(ts, 6) AS ts_score FROM ranked_text", "ranked_text"))
def fts_3(spark, sf_dir):
    return _ranked_texts(spark, sf_dir, text_units(spark, sf_dir), "id", "search_text")


rank_ctes("ranked_documents", "documents", "doc_id", "text")


@check(
    "fts_3_text_rank_whole_documents",
    sql("SELECT query_id, k AS doc_id, round(ts, 6) AS ts_score FROM ranked_documents", "ranked_documents"),
)
def fts_3_documents(spark, sf_dir):
    return _ranked_texts(spark, sf_dir, table(spark, sf_dir, "documents"), "doc_id", "text")


@check(
    "fts_4_postings",
    f"""SELECT term, doc_id, count(*) AS tf, md5(string_agg(CAST(pos AS VARCHAR), ',' ORDER BY pos)) AS digest FROM (
      SELECT doc_id, unnest(range(1, len(ts) + 1)) AS pos, unnest(ts) AS term
      FROM (SELECT doc_id, {sql_tokens('text')} AS ts FROM documents)) GROUP BY 1, 2""",
)
def fts_4(spark, sf_dir):
    folder = scratch(spark) + "/postings"
    lexical.write_postings(table(spark, sf_dir, "documents"), "doc_id", "text", folder)
    p = spark.read.parquet(folder).select("term", F.explode("posts").alias("p")).select("term", F.col("p.key").alias("doc_id"), "p.positions")
    digest = F.md5(F.array_join(F.col("positions").cast("array<string>"), ",").cast("binary"))
    return p.select("term", "doc_id", F.size("positions").cast("long").alias("tf"), digest.alias("digest"))


# -- searches ------------------------------------------------------------------------------


def _found(weights, fetch, where="TRUE"):
    w = vectors.lane_weights(weights)
    return f"""SELECT s.query_id, s.id, s.score, u.path, u.namespace, u.qualified_name, u.role, u.content, fetched FROM (
      SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score, id) AS fetched FROM (
        SELECT query_id, id, round({w['w_func']}::DOUBLE * d_func + {w['w_call']}::DOUBLE * d_call + {w['w_class']}::DOUBLE * d_class - {w['w_fts']}::DOUBLE * ts_score, 9) AS score
        FROM scored JOIN units USING (id) WHERE {where})) s JOIN units u USING (id) WHERE fetched <= {fetch}"""


for preset in ("func", "call", "class", "balanced"):
    cte(f"found_{preset}", _found(preset, 30), ["scored", "units"])
cte("found_en", _found("func", 30, "namespace = 'en'"), ["scored", "units"])
cte("found_code", _found("func", 30, f"NOT {SQL_IS_TEST}"), ["scored", "units"])
cte("found_ten", _found("balanced", 10), ["scored", "units"])


def _ranked(source, order=f"{SQL_IS_TEST}, score, id", where="TRUE"):
    return f"""SELECT query_id, rank, id, round(score, 6) AS score FROM (
      SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY {order}) AS rank FROM {source} WHERE {where}) WHERE rank <= 10"""


def _shown(hits):
    return hits.select("query_id", F.col("rank").cast("long").alias("rank"), "id", F.round("score", 6).alias("score"))


def _register_search(name, run, cte_name, **kw):
    options = kw.pop("options", {})

    @check(name, sql(_ranked(cte_name, **kw), cte_name))
    def query(spark, sf_dir):
        return _shown(run(search_units(spark, sf_dir), queries(spark, sf_dir), **options))


_register_search("qry_1_search", search.search, "found_func")
_register_search("qry_2_call_search", search.call_search, "found_call")
_register_search("qry_3_class_search", search.class_search, "found_class")
_register_search("flt_3_namespace_filter", search.search, "found_en", options={"namespace": "en"})
_register_search(
    "flt_5_exclude_tests", search.search, "found_func", order="score, id", where=f"NOT {SQL_IS_TEST}",
    options={"exclude_tests": True},
)
_register_search(
    "flt_5_exclude_tests_before_scoring", search.search, "found_code", order="score, id",
    options={"exclude_tests": True, "push_test_filter": True},
)


@check(
    "top_2_over_fetch",
    sql("SELECT query_id, fetched, id, round(score, 6) AS score FROM found_func", "found_func"),
)
def top_2(spark, sf_dir):
    asked = search.prepare_queries(queries(spark, sf_dir))
    fetch = topk.fetch_size(10, True, False)
    found = topk.score_units(search_units(spark, sf_dir), asked, weights=vectors.lane_weights("func"), fetch=fetch, dim=384)
    return found.select("query_id", F.col("rank").cast("long").alias("fetched"), "id", F.round("score", 6).alias("score"))


@check(
    "top_3_deprioritize_tests",
    sql(f"SELECT query_id, id, {SQL_IS_TEST} AS is_test, row_number() OVER (PARTITION BY query_id ORDER BY {SQL_IS_TEST}, score, id) AS rank FROM found_balanced QUALIFY rank <= 10", "found_balanced"),
)
def top_3(spark, sf_dir):
    hits = search.find_hits(search_units(spark, sf_dir), queries(spark, sf_dir), lane="balanced")
    return hits.select("query_id", "id", is_test_hit().alias("is_test"), F.col("rank").cast("long").alias("rank"))


@check("top_4_per_query", sql(_ranked("found_ten", order="score, id"), "found_ten"))
def top_4(spark, sf_dir):
    hits = search.find_hits(search_units(spark, sf_dir), queries(spark, sf_dir), lane="balanced", deprioritize_tests=False)
    return _shown(hits)


@check(
    "jn_5_query_by_unit_scores",
    sql(
        """SELECT query_id, id, round(d_func, 6) AS d_func, round(d_call, 6) AS d_call, round(d_class, 6) AS d_class, round(ts_score, 6) AS ts_score
        FROM scored JOIN found_ten f USING (query_id, id)""",
        "scored", "found_ten",
    ),
)
def jn_5(spark, sf_dir):
    hits = search.find_hits(search_units(spark, sf_dir), queries(spark, sf_dir), lane="balanced", deprioritize_tests=False)
    return hits.select("query_id", "id", *[F.round(c, 6).alias(c) for c in ("d_func", "d_call", "d_class", "ts_score")])


SQL_SNIPPET = r"array_to_string(regexp_split_to_array(regexp_replace(content, '(\r\n|[\n\r\x0b\x0c\x1c\x1d\x1e\x{85}\x{2028}\x{2029}])\z', ''), '\r\n|[\n\r\x0b\x0c\x1c\x1d\x1e\x{85}\x{2028}\x{2029}]')[1:8], chr(10))"
cte(
    "ranked_func",
    f"SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY {SQL_IS_TEST}, score, id) AS rank FROM found_func QUALIFY rank <= 10",
    ["found_func"],
)


@check("prj_15_snippet", sql(f"SELECT doc_id, {SQL_SNIPPET} AS snippet FROM units", "units"))
def prj_15(spark, sf_dir):
    df = table(spark, sf_dir, "documents")
    return df.select("doc_id", texts.snippet("text").alias("snippet"))


@check(
    "prj_16_hit_blocks",
    sql(
        f"""SELECT query_id, string_agg(rank || '. ' || qualified_name || '  score=' || printf('%.4f', score) || chr(10)
        || '   path: ' || path || '  role: ' || role || '  ns: ' || namespace || chr(10) || {SQL_SNIPPET}, chr(10) || chr(10) ORDER BY rank) AS text
        FROM ranked_func GROUP BY 1""",
        "ranked_func",
    ),
)
def prj_16(spark, sf_dir):
    asked = queries(spark, sf_dir)
    return search.render_hits(search.search(search_units(spark, sf_dir), asked), asked)


# -- context search ----------------------------------------------------------------------

# The kept set comes from the test rule, the order is the score.
cte(
    "kept",
    f"""SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score, id) AS rank FROM (
      SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY {SQL_IS_TEST}, score, id) AS place FROM found_balanced QUALIFY place <= 10)""",
    ["found_balanced"],
)
cte(
    "kept_callees",
    """SELECT DISTINCT k.id, e.callee_qname, u.id AS unit_id FROM (SELECT DISTINCT id FROM kept) k
    JOIN edges e ON e.caller_id = k.id LEFT JOIN units u ON u.qualified_name = e.callee_qname""",
    ["kept", "edges", "units"],
)
cte(
    "kept_callers",
    """SELECT DISTINCT k.id, u.qualified_name, u.id AS unit_id FROM (SELECT DISTINCT id, qualified_name FROM kept) k
    JOIN edges e ON e.callee_qname = k.qualified_name JOIN units u ON u.id = e.caller_id""",
    ["kept", "edges", "units"],
)
cte(
    "contexts",
    """SELECT k.*, coalesce(c.n, 0) AS n_callees, coalesce(r.n, 0) AS n_callers, c.rows AS callee_rows, r.rows AS caller_rows, c.ids AS callee_names, r.ids AS caller_names
    FROM kept k
    LEFT JOIN (SELECT id, count(*) AS n, string_agg('  -> ' || callee_qname, chr(10) ORDER BY callee_qname) AS rows, string_agg(callee_qname, ' ' ORDER BY callee_qname) AS ids FROM kept_callees GROUP BY 1) c USING (id)
    LEFT JOIN (SELECT id, count(*) AS n, string_agg('  <- ' || qualified_name, chr(10) ORDER BY qualified_name) AS rows, string_agg(qualified_name, ' ' ORDER BY qualified_name) AS ids FROM kept_callers GROUP BY 1) r USING (id)""",
    ["kept", "kept_callees", "kept_callers"],
)


def contexts(spark, sf_dir, **options):
    return search.search_with_context(
        search_units(spark, sf_dir), edges(spark, sf_dir), queries(spark, sf_dir), **options
    )


def _context_rows(df):
    def names(c):
        return F.array_join(F.transform(c, lambda n: n["qualified_name"]), " ")

    return df.select(
        "query_id", F.col("rank").cast("long").alias("rank"), "id", F.round("score", 6).alias("score"),
        "n_callees", "n_callers", names("callees").alias("callees"), names("callers").alias("callers"),
    )


@check(
    "qry_4_search_with_context",
    sql("SELECT query_id, rank, id, round(score, 6) AS score, n_callees, n_callers, coalesce(callee_names, '') AS callees, coalesce(caller_names, '') AS callers FROM contexts", "contexts"),
)
def qry_4(spark, sf_dir):
    return _context_rows(contexts(spark, sf_dir))


@check(
    "gra_1_depth_zero",
    sql("SELECT query_id, rank, id, round(score, 6) AS score, 0::BIGINT AS n_callees, 0::BIGINT AS n_callers, '' AS callees, '' AS callers FROM kept", "kept"),
)
def gra_1(spark, sf_dir):
    return _context_rows(contexts(spark, sf_dir, expand_depth=0))


@check(
    "prj_17_context_blocks",
    sql(
        f"""SELECT query_id, 0 AS page, string_agg(rank || '. ' || qualified_name || '  score=' || printf('%.4f', score) || chr(10)
        || 'path: ' || path || '  role: ' || role || '  ns: ' || namespace || chr(10) || {SQL_SNIPPET}
        || CASE WHEN n_callees > 0 THEN chr(10) || 'callees (' || n_callees || '):' || chr(10) || callee_rows ELSE '' END
        || CASE WHEN n_callers > 0 THEN chr(10) || 'callers (' || n_callers || '):' || chr(10) || caller_rows ELSE '' END,
        chr(10) || chr(10) ORDER BY rank) AS text FROM contexts GROUP BY 1""",
        "contexts",
    ),
)
def prj_17(spark, sf_dir):
    # Large pages keep one text per query here; the page number stays part of the key.
    return search.render_contexts(contexts(spark, sf_dir), queries(spark, sf_dir))


@check(
    "gra_5_nested_result",
    sql(
        """SELECT query_id, 0 AS page, any_value(q.query) AS query, string_agg(id, ' ' ORDER BY rank) AS ids,
        sum(n_callees) AS n_callees, sum(n_callers) AS n_callers FROM contexts JOIN queries q USING (query_id) GROUP BY 1""",
        "contexts", "queries",
    ),
)
def gra_5(spark, sf_dir):
    nested = graph.nested_result(contexts(spark, sf_dir), queries(spark, sf_dir))
    shape = "query string, hits array<struct<hit: struct<id: string>, callees: array<struct<path: string>>, callers: array<struct<path: string>>>>"
    parsed = nested.select("query_id", "page", F.from_json("result", shape).alias("r"))

    def total(part):
        return F.aggregate(F.col("r.hits"), F.lit(0).cast("long"), lambda n, h: n + F.size(h[part]))

    return parsed.select(
        "query_id", "page", "r.query", F.array_join(F.transform("r.hits", lambda h: h["hit"]["id"]), " ").alias("ids"),
        total("callees").alias("n_callees"), total("callers").alias("n_callers"),
    )


# Flat neighbours of the kept hits, numbered per query, rank and side.
cte(
    "kept_nodes",
    """SELECT k.query_id, k.rank, n.*, row_number() OVER (PARTITION BY k.query_id, k.rank, side ORDER BY name, unit_id NULLS FIRST) AS number FROM kept k JOIN (
      SELECT id, 'callees' AS side, callee_qname AS name, unit_id FROM kept_callees
      UNION ALL SELECT id, 'callers', qualified_name, unit_id FROM kept_callers) n USING (id)""",
    ["kept", "kept_callees", "kept_callers"],
)


def _hits_and_neighbours(spark, sf_dir):
    units, asked = search_units(spark, sf_dir), queries(spark, sf_dir)
    hits = cut_lineage(search.context_hits(units, asked))
    return hits, graph.neighbours(hits, units, edges(spark, sf_dir), depth=1), asked


@check(
    "prj_17_context_lines",
    sql(
        f"""SELECT query_id, rank, 0 AS kind, 1 AS number, '' AS line FROM kept WHERE rank > 1
        UNION ALL SELECT query_id, rank, 1, 1, rank || '. ' || qualified_name || '  score=' || printf('%.4f', score) || chr(10)
          || 'path: ' || path || '  role: ' || role || '  ns: ' || namespace || chr(10) || {SQL_SNIPPET} FROM kept
        UNION ALL SELECT query_id, rank, CASE side WHEN 'callees' THEN 2 ELSE 4 END, 1, side || ' (' || count(*) || '):' FROM kept_nodes GROUP BY query_id, rank, side
        UNION ALL SELECT query_id, rank, CASE side WHEN 'callees' THEN 3 ELSE 5 END, number, CASE side WHEN 'callees' THEN '  -> ' ELSE '  <- ' END || name FROM kept_nodes""",
        "kept", "kept_nodes",
    ),
)
def prj_17_lines(spark, sf_dir):
    """The text of every query in lines, for hubs of any size."""
    return documents.text_lines(*_hits_and_neighbours(spark, sf_dir))


@check(
    "gra_5_document_lines",
    sql(
        """SELECT query_id, rank, CASE side WHEN 'callees' THEN 2 ELSE 4 END AS kind, number, number > 1 AS comma, name, unit_id FROM kept_nodes
        UNION ALL SELECT query_id, rank, 1, 1, rank > 1, qualified_name, id FROM kept
        UNION ALL SELECT query_id, rank, unnest([3, 5]), 1, false, NULL, NULL FROM kept
        UNION ALL SELECT query_id, unnest([0, 2147483647]), 0, 1, false, NULL, NULL FROM queries""",
        "kept", "kept_nodes", "queries",
    ),
)
def gra_5_lines(spark, sf_dir):
    """The JSON documents of all queries in lines; hits and neighbours are read back from their lines."""
    lines = documents.json_lines(*_hits_and_neighbours(spark, sf_dir))
    # A hit opens a bracket that later lines close.
    body = F.regexp_replace("line", r"^, |, \"callees\": \[$", "")
    body = F.when(F.col("kind") == 1, F.concat(body, F.lit("}"))).when(F.col("kind").isin(2, 4), body)
    name = F.coalesce(F.get_json_object(body, "$.hit.qualified_name"), F.get_json_object(body, "$.qualified_name"))
    return lines.select(
        *documents.PLACE, "number", F.col("line").startswith(", ").alias("comma"), name.alias("name"),
        F.coalesce(F.get_json_object(body, "$.hit.id"), F.get_json_object(body, "$.unit_id")).alias("unit_id"),
    )
