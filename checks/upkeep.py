"""Writes, upserts, audits and change detection."""

from pyspark.sql import functions as F

from checks.derived import (
    SQL_BLANKS, SQL_FIRST, bare_units, cte, edges, refs, scratch, search_units, sql, table, text_units, vector_ctes,
)
from checks.registry import check
from unitloom.functions import texts
from unitloom.operators import documents, maintain
from unitloom.plans.load import load
from unitloom.schema import CODE_UNITS, REFS
from unitloom.sources import files as file_source
from unitloom.sources import jsonl
from unitloom.sources.tables import CodeTables
from unitloom.streaming.ingest import stream_chunks, stream_chunks_and_refs

# A second load: labelled documents with new content, plus one unit per benchmark text;
# every labelled unit comes twice and the later row counts.
cte(
    "batch",
    """SELECT id, content || chr(10) || 'quality ' || quality AS content FROM units JOIN labels USING (doc_id)
    UNION ALL SELECT 'new/b' || item_id || '.py::new.b' || item_id, text FROM benchmark""",
    ["units"],
)
cte("upserted", "SELECT id, content, 'job2' AS job FROM batch UNION ALL SELECT id, content, 'job1' FROM units WHERE id NOT IN (SELECT id FROM batch)", ["batch", "units"])


def batch(spark, sf_dir):
    units = text_units(spark, sf_dir).drop("doc")
    changed = units.join(table(spark, sf_dir, "labels"), "doc_id").withColumn("seq", F.explode(F.array(F.lit(1), F.lit(2))))
    suffix = F.when(F.col("seq") == 1, F.lit("draft")).otherwise(F.concat(F.lit("quality "), "quality"))
    changed = changed.withColumn("content", F.concat("content", F.lit("\n"), suffix))
    first = table(spark, sf_dir, "benchmark").select(
        F.concat(F.lit("new.b"), "item_id").alias("qualified_name"), F.concat(F.lit("new/b"), "item_id", F.lit(".py")).alias("path"),
        F.col("text").alias("content"), F.lit("python").alias("language"), F.lit("function").alias("role"),
        F.lit("new").alias("module"), F.concat(F.lit("b"), "item_id").alias("symbol"), F.lit("code").alias("namespace"),
        F.array().cast("array<string>").alias("class_chain"), F.array(F.lit("b0")).alias("calls"), F.lit(1).alias("start_line"),
        F.lit(1).alias("end_line"), F.lit(1).alias("seq"),
    ).withColumn("id", texts.unit_id())
    rows = changed.unionByName(first, allowMissingColumns=True)
    return rows.withColumn("content_hash", texts.content_hash())


@check("ups_1_upsert_units", sql("SELECT id, md5(content) AS digest, job FROM upserted", "upserted"))
def ups_1(spark, sf_dir):
    old = maintain.stamp(bare_units(spark, sf_dir).select("id", "content"), "job1")
    new = maintain.last_wins(batch(spark, sf_dir).select("id", "content", "seq"), "id", "seq").drop("seq")
    out = maintain.upsert(old, maintain.stamp(new, "job2"), "id")
    return out.select("id", F.md5(F.col("content").cast("binary")).alias("digest"), F.col("job_id").alias("job"))


@check("ups_2_call_edges", sql("SELECT id AS caller_id, callee AS callee_qname, callee AS callee_raw FROM (SELECT id, unnest(raw_calls) AS callee FROM called)", "called"))
def ups_2(spark, sf_dir):
    raw = bare_units(spark, sf_dir).withColumn("calls", F.col("raw_calls"))
    return maintain.call_edges(raw)


@check("ups_3_insert_ignore", sql("SELECT DISTINCT id AS caller_id, callee AS callee_qname FROM (SELECT id, unnest(raw_calls) AS callee FROM called)", "called"))
def ups_3(spark, sf_dir):
    raw = bare_units(spark, sf_dir).withColumn("calls", F.col("raw_calls"))
    return maintain.insert_ignore(maintain.call_edges(raw)).select("caller_id", "callee_qname")


# Edges of the second load: batch callers keep only the batch's calls.
NEW_EDGES = """SELECT caller_id, callee_qname FROM edges WHERE caller_id NOT IN (SELECT id FROM batch)
UNION ALL SELECT id, unnest(calls) FROM called WHERE id IN (SELECT id FROM batch)
UNION ALL SELECT 'new/b' || item_id || '.py::new.b' || item_id, 'b0' FROM benchmark"""


@check("ups_4_replace_edges", sql(NEW_EDGES, "edges", "batch", "called"))
def ups_4(spark, sf_dir):
    return maintain.replace_edges(edges(spark, sf_dir), batch(spark, sf_dir)).select("caller_id", "callee_qname")


def _loadable(df):
    """Batch rows with every table column; vectors left empty where they do not matter."""
    for name in ("vec_func", "vec_call", "vec_class"):
        if name not in df.columns:
            df = df.withColumn(name, F.lit(None).cast("array<float>"))
    for name in ("embed_func_text", "embed_call_text", "embed_class_text", "search_text", "package"):
        if name not in df.columns:
            df = df.withColumn(name, F.lit(None).cast("string"))
    if "seq" not in df.columns:
        df = df.withColumn("seq", F.lit(1))
    return df.select(*[c for c in CODE_UNITS.fieldNames() if c not in ("job_id", "updated_at")], "seq")


def _two_loads(spark, sf_dir):
    store = CodeTables(spark, scratch(spark) + "/tables", buckets=16)
    store.upsert_batch(_loadable(text_units(spark, sf_dir)), job_id="job1")
    store.upsert_batch(_loadable(batch(spark, sf_dir)), job_id="job2")
    return store


@check("snk_2_versioned_unit_table", sql("SELECT id, md5(content) AS digest, job FROM upserted", "upserted"))
def snk_2(spark, sf_dir):
    units = _two_loads(spark, sf_dir).units()
    return units.select("id", F.md5(F.col("content").cast("binary")).alias("digest"), F.col("job_id").alias("job"))


@check(
    "ups_4_versioned_edge_table",
    sql(
        """SELECT id AS caller_id, unnest(calls) AS callee_qname FROM called
        UNION ALL SELECT 'new/b' || item_id || '.py::new.b' || item_id, 'b0' FROM benchmark""",
        "called",
    ),
)
def ups_4_table(spark, sf_dir):
    return _two_loads(spark, sf_dir).edges().select("caller_id", "callee_qname")


@check("ups_6_job_stamp", sql("SELECT id, 'a1b2c3d4e5f6' AS job_id FROM units", "units"))
def ups_6(spark, sf_dir):
    return maintain.stamp(bare_units(spark, sf_dir).select("id"), "a1b2c3d4e5f6")


@check(
    "ups_5_constraint_audit",
    sql(
        """SELECT 'units.id unique' AS rule, id AS key, 2::BIGINT AS n FROM labelled
        UNION ALL SELECT 'edges.caller_id known', caller_id, count(*) FROM edges WHERE caller_id NOT IN (SELECT id FROM labelled) GROUP BY 2
        UNION ALL SELECT 'edges unique', caller_id || ' -> ' || callee_qname, 2 FROM edges
        UNION ALL SELECT 'units.content not null', id, 1 FROM labelled""",
        "labelled", "edges",
    ),
)
def ups_5(spark, sf_dir):
    """Labelled units once whole and once without content, and every edge twice."""
    from checks.graphs import labelled

    units = labelled(spark, sf_dir).select("id", "qualified_name", "content")
    broken = units.unionByName(units.withColumn("content", F.lit(None).cast("string")))
    e = edges(spark, sf_dir)
    report = maintain.audit(broken, e.unionByName(e))
    halved = F.when(F.col("rule") == "edges.caller_id known", F.expr("n div 2")).otherwise(F.col("n"))
    return report.select("rule", "key", halved.cast("long").alias("n"))


@check(
    "inc_1_changed_rows",
    sql(
        """SELECT id, CASE WHEN u.id IS NULL THEN 'new' WHEN b.id IS NULL THEN 'removed' WHEN u.content = b.content THEN 'unchanged' ELSE 'changed' END AS change
        FROM units u FULL JOIN (SELECT * FROM batch UNION ALL SELECT id, content FROM units WHERE namespace = 'en' AND id NOT IN (SELECT id FROM batch)) b USING (id)""",
        "units", "batch",
    ),
)
def inc_1(spark, sf_dir):
    old = bare_units(spark, sf_dir).withColumn("content_hash", texts.content_hash())
    new = maintain.last_wins(batch(spark, sf_dir).select("id", "content_hash", "seq"), "id", "seq").drop("seq")
    same = old.filter("namespace = 'en'").select("id", "content_hash").join(new.select("id"), "id", "left_anti")
    return maintain.changes(old, new.unionByName(same), "id", "content_hash").select("id", "change")


@check(
    "agg_5_manifest",
    "SELECT 'job9' AS job_id, 'd' || doc_id AS path, left(sha256(text), 16) AS hash FROM documents",
)
def agg_5(spark, sf_dir):
    files = table(spark, sf_dir, "documents").select(
        F.concat(F.lit("d"), "doc_id").alias("path"), texts.content_hash("text").alias("content_hash")
    )
    pages = maintain.manifest(files, "job9", page_rows=100)
    parsed = pages.select(F.from_json("manifest", "job_id string, files map<string,string>").alias("m"))
    return parsed.select("m.job_id", F.explode("m.files").alias("path", "hash"))


@check(
    "agg_5_manifest_lines",
    """SELECT number, CASE WHEN number > 2 AND kind = 1 THEN ', ' ELSE '' END || line AS line FROM (
    SELECT *, row_number() OVER (ORDER BY kind, path) AS number FROM (
      SELECT 0 AS kind, '' AS path, '{"job_id": "job9", "files": {' AS line UNION ALL SELECT 2, '', '}}'
      UNION ALL SELECT 1, 'd' || doc_id, '"d' || doc_id || '": "' || left(sha256(text), 16) || '"' FROM documents))""",
)
def agg_5_lines(spark, sf_dir):
    """The manifest of all documents as one JSON text, line by line."""
    files = table(spark, sf_dir, "documents").select(
        F.concat(F.lit("d"), "doc_id").alias("path"), texts.content_hash("text").alias("content_hash")
    )
    return documents.manifest_lines(files, "job9")


# -- files written and read back -----------------------------------------------------------

CHUNK_SQL = """SELECT id, qualified_name, module, language, role, symbol, array_to_string(class_chain, '.') AS class_chain, path, package,
  start_line, end_line, md5(content) AS content, array_to_string(calls, ' ') AS calls, embed_func_text AS embed_text, namespace, '' AS doc,
  search_text, left(sha256(content), 16) AS content_hash FROM texted"""


def _chunks(spark, sf_dir):
    return text_units(spark, sf_dir).withColumn("embed_text", F.col("embed_func_text"))


def _flat(df):
    return df.withColumns(
        {
            "class_chain": F.array_join("class_chain", "."), "calls": F.array_join("calls", " "),
            "content": F.md5(F.col("content").cast("binary")),
        }
    )


@check("snk_3_chunk_record", sql(CHUNK_SQL, "texted"))
def snk_3(spark, sf_dir):
    return _flat(jsonl.chunk_record(_chunks(spark, sf_dir)))


def _written(spark, sf_dir):
    folder = scratch(spark) + "/index"
    jsonl.write_jsonl(_chunks(spark, sf_dir), refs(spark, sf_dir).orderBy("seq"), folder)
    return folder


@check("snk_1_src_4_chunk_files", sql(CHUNK_SQL, "texted"))
def src_4(spark, sf_dir):
    return _flat(jsonl.read_chunks(spark, _written(spark, sf_dir) + "/chunks.jsonl").drop("seq"))


@check(
    "src_5_ref_files",
    sql("SELECT id AS unit_id, qualified_name, path, 'Base, C' || source || ', object' AS mro FROM units WHERE len(class_chain) > 0", "units"),
)
def src_5(spark, sf_dir):
    rows = jsonl.read_refs(spark, _written(spark, sf_dir) + "/refs.jsonl")
    return rows.select("unit_id", "qualified_name", "path", F.col("refs")["mro"].alias("mro"))


def _rename_one(spark, folder, name):
    """Gives one written file of `folder` another name."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    system = path.getFileSystem(spark._jsc.hadoopConfiguration())
    first = system.globStatus(spark._jvm.org.apache.hadoop.fs.Path(f"{folder}/part-*"))[0].getPath()
    system.rename(first, spark._jvm.org.apache.hadoop.fs.Path(f"{folder}/{name}"))


@check(
    "src_1_repository_scan",
    """SELECT line, count(*) AS n FROM (SELECT unnest(string_split(html, chr(10))) AS line FROM pages) WHERE line <> '' GROUP BY 1""",
)
def src_1(spark, sf_dir):
    """Pages written as files, found again by the recursive scan, decoded and split.

    Some lie in a folder `_private`, and every folder has a file `__init__.txt`.
    """
    folder = scratch(spark) + "/site"
    pages = table(spark, sf_dir, "pages").select(F.col("html").alias("value"), F.pmod("page_id", F.lit(4)).alias("part"))
    for part, place in (("part > 1", "open"), ("part = 1", "_private"), ("part = 0", "_private/_more")):
        pages.filter(part).select("value").write.text(f"{folder}/{place}")
        _rename_one(spark, f"{folder}/{place}", "__init__.txt")
    files = file_source.read_repository(spark, folder, [".txt"])
    lines = file_source.line_rows(files.select("path", file_source.decode("source").alias("text")))
    return lines.filter("text <> ''").groupBy(F.col("text").alias("line")).agg(F.count("*").alias("n"))


@check(
    "qry_6_load",
    sql(
        """SELECT t.id, md5(t.content) AS digest, t.embed_func_text, t.embed_class_text, f.n AS n_func, c.n AS n_class FROM texted t
        JOIN (SELECT k, count(*) AS n FROM v_func GROUP BY 1) f ON f.k = t.id JOIN (SELECT k, count(*) AS n FROM v_class GROUP BY 1) c ON c.k = t.id""",
        "texted", "v_func", "v_class",
    ),
)
def qry_6(spark, sf_dir):
    """Chunk and ref files -> lane texts -> vectors -> table."""
    root = scratch(spark) + "/tables"
    load(spark, _written(spark, sf_dir), root, job_id="0123456789ab", buckets=16)
    units = CodeTables(spark, root, 16).units()
    filled = lambda c: F.size(F.filter(c, lambda x: x != 0)).cast("long")
    return units.select(
        "id", F.md5(F.col("content").cast("binary")).alias("digest"), "embed_func_text", "embed_class_text",
        filled("vec_func").alias("n_func"), filled("vec_class").alias("n_class"),
    )


# What the chunk files of both arrivals carry as base text: a changed unit keeps its first line and calls, so its text stays.
cte(
    "arrived",
    """SELECT id, embed_func_text FROM texted
    UNION ALL SELECT 'new/b' || item_id || '.py::new.b' || item_id,
      left('[python] function `b' || item_id || '` in new | path: new/b' || item_id || '.py'
        || CASE WHEN sig <> '' THEN chr(10) || sig ELSE '' END || chr(10) || 'calls: b0', 400)
    FROM (SELECT item_id, regexp_replace(regexp_extract(text, '""" + SQL_FIRST + """'), '^""" + SQL_BLANKS + "|" + SQL_BLANKS + """$', '', 'g') AS sig FROM benchmark)""",
    ["texted"],
)
vector_ctes("v_arrived", "arrived", "id", "embed_func_text", needs=["arrived"])


@check(
    "inc_2_streaming_ingest",
    sql(
        """SELECT id, md5(content) AS digest, CASE job WHEN 'job1' THEN 'stream-0' ELSE 'stream-1' END AS job, embed_func_text, n AS n_func
        FROM upserted JOIN arrived USING (id) JOIN (SELECT k AS id, count(*) AS n FROM v_arrived GROUP BY 1) USING (id)""",
        "upserted", "v_arrived",
    ),
)
def inc_2(spark, sf_dir):
    """Chunk files arrive twice; each run takes the new ones, embeds their texts and upserts them."""
    base = scratch(spark)
    for rows in (_chunks(spark, sf_dir), maintain.last_wins(batch(spark, sf_dir), "id", "seq")):
        rows = rows.withColumn("doc", F.lit(""))
        rows = rows.withColumns({"embed_text": texts.embed_text(), "search_text": texts.search_text()}).withColumn("embed_text", texts.func_text())
        jsonl.chunk_record(rows).write.mode("append").option("compression", "gzip").json(base + "/index/chunks.jsonl")
        stream_chunks(spark, base + "/index", base + "/tables", base + "/stream", buckets=4).awaitTermination()
    units = CodeTables(spark, base + "/tables", 4).units()
    return units.select(
        "id", F.md5(F.col("content").cast("binary")).alias("digest"), F.col("job_id").alias("job"), "embed_func_text",
        F.size(F.filter("vec_func", lambda x: x != 0)).cast("long").alias("n_func"),
    )


@check(
    "inc_2_late_refs",
    sql(
        """SELECT id, md5(content) AS digest, embed_func_text, embed_class_text, CASE WHEN len(class_chain) > 0 THEN 'stream-1' ELSE 'stream-0' END AS job
        FROM texted""",
        "texted",
    ),
)
def inc_2_late(spark, sf_dir):
    """All chunk files arrive first, all refs, in two generations, a batch later."""
    base = scratch(spark)
    jsonl.chunk_record(_chunks(spark, sf_dir)).write.option("compression", "gzip").json(base + "/index/chunks.jsonl")
    stream_chunks_and_refs(spark, base + "/index", base + "/tables", base + "/stream", buckets=4).awaitTermination()
    refs(spark, sf_dir).orderBy("seq").select(*REFS.fieldNames()).write.mode("append").json(base + "/index/refs.jsonl")
    stream_chunks_and_refs(spark, base + "/index", base + "/tables", base + "/stream", buckets=4).awaitTermination()
    units = CodeTables(spark, base + "/tables", 4).units()
    return units.select(
        "id", F.md5(F.col("content").cast("binary")).alias("digest"), "embed_func_text", "embed_class_text", F.col("job_id").alias("job")
    )
