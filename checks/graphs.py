"""Joins, aggregations and call-graph expansion."""

from pyspark.sql import functions as F

from checks.derived import bare_units, cte, edges, queries, refs, scratch, sql, sql_distinct, table, text_units
from checks.registry import check
from unitloom.functions import texts
from unitloom.operators import graph, maintain
from unitloom.operators.adjacency import write_adjacency
from unitloom.operators.documents import numbered

ALL_CALLEES = """SELECT DISTINCT e.caller_id, e.callee_qname, e.callee_raw, u.id AS unit_id, u.qualified_name, u.path
FROM edges e LEFT JOIN units u ON u.qualified_name = e.callee_qname"""
# Callers and names of labelled documents.
cte("labelled", "SELECT u.* FROM units u WHERE doc_id IN (SELECT doc_id FROM labels)", ["units"])


def labelled(spark, sf_dir):
    return bare_units(spark, sf_dir).join(table(spark, sf_dir, "labels").select("doc_id").distinct(), "doc_id", "left_semi")


@check("jn_3_callees", sql(ALL_CALLEES + " WHERE e.caller_id IN (SELECT id FROM labelled)", "edges", "units", "labelled"))
def jn_3(spark, sf_dir):
    callers = labelled(spark, sf_dir).select(F.col("id").alias("caller_id"))
    out = graph.callees_of(callers, edges(spark, sf_dir), bare_units(spark, sf_dir), callers.count())
    return out.select("caller_id", "callee_qname", "callee_raw", "unit_id", "qualified_name", "path")


@check(
    "jn_3_callees_by_symbol",
    sql(
        """SELECT DISTINCT e.caller_id, e.callee_qname, u.id AS unit_id FROM (SELECT caller_id, callee_raw AS callee_qname FROM edges) e
        LEFT JOIN units u ON u.symbol = e.callee_qname WHERE e.caller_id IN (SELECT id FROM labelled)""",
        "edges", "units", "labelled",
    ),
)
def jn_3_symbol(spark, sf_dir):
    """Edges as a load writes them: the target is the bare called name."""
    bare = edges(spark, sf_dir).withColumn("callee_qname", F.col("callee_raw"))
    callers = labelled(spark, sf_dir).select(F.col("id").alias("caller_id"))
    out = graph.callees_of(callers, bare, bare_units(spark, sf_dir), callers.count(), resolve="symbol")
    return out.select("caller_id", "callee_qname", "unit_id")


@check(
    "jn_4_callers",
    sql(
        """SELECT DISTINCT e.callee_qname, e.caller_id, u.qualified_name, u.path FROM edges e JOIN units u ON u.id = e.caller_id
        WHERE e.callee_qname IN (SELECT qualified_name FROM labelled)""",
        "edges", "units", "labelled",
    ),
)
def jn_4(spark, sf_dir):
    names = labelled(spark, sf_dir).select(F.col("qualified_name").alias("callee_qname"))
    out = graph.callers_of(names, edges(spark, sf_dir), bare_units(spark, sf_dir), names.count())
    return out.select("callee_qname", "caller_id", "qualified_name", "path")


@check(
    "agg_6_row_distinct",
    sql("SELECT DISTINCT callee_qname, callee_raw FROM edges", "edges"),
)
def agg_6(spark, sf_dir):
    return edges(spark, sf_dir).select("callee_qname", "callee_raw").distinct()


def _levels(side, depth):
    """Breadth-first levels as one bounded recursion; a name counts at its first level."""
    if side == "callees":
        first = "SELECT u.id AS hit_id, u.id AS node FROM units u"
        step = "SELECT r.hit_id, e.callee_qname AS name, u.id AS node, r.depth + 1 FROM r JOIN edges e ON e.caller_id = r.node LEFT JOIN units u ON u.qualified_name = e.callee_qname"
    else:
        first = "SELECT u.id AS hit_id, u.qualified_name AS node FROM units u"
        step = "SELECT r.hit_id, u.qualified_name AS name, u.qualified_name AS node, r.depth + 1 FROM r JOIN edges e ON e.callee_qname = r.node JOIN units u ON u.id = e.caller_id"
    return f"""SELECT hit_id, name AS qualified_name, depth, u.id AS unit_id FROM (
      SELECT hit_id, name, min(depth) AS depth FROM (
        WITH RECURSIVE r(hit_id, name, node, depth) AS (
          SELECT hit_id, CAST(NULL AS VARCHAR), node, 0 FROM ({first})
          UNION {step} WHERE r.depth < {depth} AND r.node IS NOT NULL)
        SELECT * FROM r WHERE name IS NOT NULL) GROUP BY 1, 2) x LEFT JOIN units u ON u.qualified_name = x.name"""


def _expand(spark, sf_dir, side, depth, layout=edges):
    units = bare_units(spark, sf_dir)
    hits = units.select(F.col("id").alias("hit_id"), F.col("id" if side == "callees" else "qualified_name").alias("key"))
    out = graph.expand(hits, layout(spark, sf_dir), units, side=side, depth=depth)
    return out.select("hit_id", "qualified_name", F.col("depth").cast("int").alias("depth"), "unit_id")


@check("gra_3_callees_to_depth_3", sql(_levels("callees", 3), "edges", "units"))
def gra_3(spark, sf_dir):
    return _expand(spark, sf_dir, "callees", 3)


@check("gra_4_callers_to_depth_2", sql(_levels("callers", 2), "edges", "units"))
def gra_4(spark, sf_dir):
    return _expand(spark, sf_dir, "callers", 2)


def stored_edges(spark, sf_dir):
    return write_adjacency(edges(spark, sf_dir), scratch(spark))


@check("gra_4_callers_by_adjacency", sql(_levels("callers", 2), "edges", "units"))
def gra_4_adjacency(spark, sf_dir):
    """Edges stored by caller and by target; each hop reads the parts its names fall into."""
    return _expand(spark, sf_dir, "callers", 2, stored_edges)


@check("gra_3_callees_by_adjacency", sql(_levels("callees", 3), "edges", "units"))
def gra_3_adjacency(spark, sf_dir):
    return _expand(spark, sf_dir, "callees", 3, stored_edges)


NEIGHBOURS = """SELECT u.id, coalesce(c.n, 0) AS n_callees, coalesce(c.names, '') AS callees, coalesce(r.n, 0) AS n_callers, coalesce(r.names, '') AS callers
FROM units u
LEFT JOIN (SELECT caller_id AS id, count(*) AS n, string_agg(callee_qname, ' ' ORDER BY callee_qname) AS names FROM edges GROUP BY 1) c USING (id)
LEFT JOIN (SELECT callee_qname, count(*) AS n, string_agg(u.qualified_name, ' ' ORDER BY u.qualified_name) AS names
           FROM edges JOIN units u ON u.id = caller_id GROUP BY 1) r ON r.callee_qname = u.qualified_name"""


@check("gra_2_depth_one_all_units", sql(NEIGHBOURS, "edges", "units"))
def gra_2(spark, sf_dir):
    units = bare_units(spark, sf_dir)
    out = graph.with_context(units.select("id", "qualified_name"), units, edges(spark, sf_dir), depth=1)

    def names(c):
        return F.array_join(F.transform(c, lambda n: n["qualified_name"]), " ")

    return out.select("id", "n_callees", names("callees").alias("callees"), "n_callers", names("callers").alias("callers"))


@check(
    "agg_2_neighbours_per_hit",
    sql("SELECT callee_qname AS hit_id, count(*) AS n, count(*) AS listed, min(caller_id) AS first_id, max(caller_id) AS last_id FROM edges GROUP BY 1", "edges"),
)
def agg_2(spark, sf_dir):
    """Paged arrays: the hub's callers fill several rows, the total stays whole."""
    e = edges(spark, sf_dir)
    nodes = e.select(
        F.col("callee_qname").alias("hit_id"), F.col("caller_id").alias("qualified_name"), F.lit(None).cast("string").alias("path"),
        F.col("caller_id").alias("unit_id"), F.lit(None).cast("string").alias("callee_raw"), F.lit(1).alias("depth"),
    )
    pages = graph.neighbour_pages(nodes, page_rows=50)
    ids = F.transform("nodes", lambda n: n["unit_id"])
    return pages.groupBy("hit_id").agg(
        F.max("n").alias("n"), F.sum(F.size("nodes")).alias("listed"),
        F.min(F.array_min(ids)).alias("first_id"), F.max(F.array_max(ids)).alias("last_id"),
    )


@check(
    "agg_2_numbered_neighbours",
    sql("SELECT callee_qname AS hit_id, caller_id AS unit_id, row_number() OVER (PARTITION BY callee_qname ORDER BY caller_id) AS number FROM edges", "edges"),
)
def agg_2_rows(spark, sf_dir):
    """All callers of every name in order, one row each; a hub spans many partitions."""
    nodes = edges(spark, sf_dir).select(F.col("callee_qname").alias("hit_id"), F.col("caller_id").alias("unit_id"))
    return numbered(nodes, ["hit_id"], ["unit_id"])


# -- joins of units with other tables ---------------------------------------------------------


@check(
    "jn_1_units_with_refs",
    sql(
        """SELECT id, CASE WHEN len(class_chain) > 0 THEN 'mro=Base, C' || source || ', object;metaclass=type;mro_source=static' END AS refs FROM units""",
        "units",
    ),
)
def jn_1(spark, sf_dir):
    latest = maintain.last_wins(refs(spark, sf_dir), "unit_id", "seq")
    df = maintain.with_refs(bare_units(spark, sf_dir), latest)
    shown = F.array_join(F.transform(F.map_entries("refs"), lambda e: F.concat(e["key"], F.lit("="), e["value"])), ";")
    return df.select("id", shown.alias("refs"))


@check(
    "agg_4_last_ref_wins",
    sql("SELECT id AS unit_id, 'Base, C' || source || ', object' AS mro FROM units WHERE len(class_chain) > 0", "units"),
)
def agg_4(spark, sf_dir):
    return maintain.last_wins(refs(spark, sf_dir), "unit_id", "seq").select("unit_id", F.col("refs")["mro"].alias("mro"))


@check(
    "flt_6_hidden_ref_keys",
    sql("SELECT id AS unit_id, 2::BIGINT AS shown, 'mro metaclass' AS keys FROM units WHERE len(class_chain) > 0", "units"),
)
def flt_6(spark, sf_dir):
    df = refs(spark, sf_dir).filter("seq = 2").select("unit_id", texts.shown_refs().alias("shown"))
    return df.select("unit_id", F.size("shown").cast("long").alias("shown"), F.array_join(F.map_keys("shown"), " ").alias("keys"))


@check("flt_8_ref_eligible_units", sql("SELECT id, role FROM units WHERE len(class_chain) > 0", "units"))
def flt_8(spark, sf_dir):
    return maintain.ref_eligible(bare_units(spark, sf_dir)).select("id", "role")


@check(
    "agg_1_ordered_distinct_calls",
    sql(f"SELECT doc_id, len(calls) AS n, array_to_string(calls, ' ') AS calls FROM called", "called"),
)
def agg_1(spark, sf_dir):
    df = bare_units(spark, sf_dir)
    return df.select("doc_id", F.size("calls").cast("long").alias("n"), F.array_join("calls", " ").alias("calls"))


@check(
    "agg_3_ingest_counts",
    sql("SELECT count(*) AS n_units, CAST(sum(len(calls)) AS BIGINT) AS n_edges FROM called", "called"),
)
def agg_3(spark, sf_dir):
    return maintain.batch_counts(bare_units(spark, sf_dir))


@check(
    "flt_7_empty_callees",
    sql("SELECT id AS caller_id, unnest(calls) AS callee_qname FROM called", "called"),
)
def flt_7(spark, sf_dir):
    padded = bare_units(spark, sf_dir).withColumn("calls", F.concat("calls", F.array(F.lit(""))))
    return maintain.call_edges(padded).select("caller_id", "callee_qname")


@check(
    "jn_6_drop_edges_of_batch",
    sql("SELECT caller_id, callee_qname FROM edges WHERE caller_id NOT IN (SELECT id FROM labelled)", "edges", "labelled"),
)
def jn_6(spark, sf_dir):
    return maintain.drop_edges_of(edges(spark, sf_dir), labelled(spark, sf_dir)).select("caller_id", "callee_qname")


@check(
    "jn_7_keep_set",
    sql("SELECT id, qualified_name FROM units WHERE id IN (SELECT id FROM labelled)", "units", "labelled"),
)
def jn_7(spark, sf_dir):
    return maintain.drop_missing(bare_units(spark, sf_dir), labelled(spark, sf_dir), "id").select("id", "qualified_name")


@check(
    "jn_8_cascade_delete",
    sql("SELECT caller_id, callee_qname FROM edges WHERE caller_id IN (SELECT id FROM labelled)", "edges", "labelled"),
)
def jn_8(spark, sf_dir):
    return maintain.cascade(edges(spark, sf_dir), labelled(spark, sf_dir)).select("caller_id", "callee_qname")
