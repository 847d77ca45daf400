"""A sample of the registered queries against DuckDB; `python -m checks.compare` runs all."""

import pytest

import checks.all  # noqa: F401
from checks.compare import compare, duck
from checks.registry import QUERIES, SQL

SF = "/root/testdata/sf0.001"
SAMPLE = [
    "qry_1_search", "qry_4_search_with_context", "vec_2_cosine_distance", "fts_3_text_rank", "gra_3_callees_to_depth_3",
    "flt_1_index_policy", "prj_9_base_embed_text", "ups_1_upsert_units", "inc_1_changed_rows", "ext_4_rust_units", "ext_5_html_blocks",
    "ext_2_python_units", "ext_3_script_units", "ext_12_doc_dispatch", "qry_5_index", "udf_1_sql_embedding", "udf_2_language_plug_in",
    "gra_5_nested_result", "prj_17_context_blocks", "inc_2_streaming_ingest", "snk_2_versioned_unit_table",
]


@pytest.mark.parametrize("name", SAMPLE)
def test_equal_to_sql(spark, name):
    text, _, _ = compare(spark, duck(SF), name, SF)
    assert text.startswith("ok"), text


def test_every_query_has_its_sql():
    assert set(SQL) <= set(QUERIES)
