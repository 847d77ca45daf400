"""Times the headline queries; prints one JSON line.

BENCH_SF_DIR (default /root/testdata/sf0.1) and BENCH_CPUS (default 8).
"""

import json
import os
import time

from unitloom.session import local_session

HEADLINE = [
    "qry_1_search",
    "top_4_per_query",
    "qry_4_search_with_context",
    "fts_3_text_rank",
    "fts_4_postings",
    "vec_1_text_embedding",
    "vec_5_approximate_candidates",
    "gra_3_callees_to_depth_3",
    "ups_1_upsert_units",
    "snk_2_versioned_unit_table",
    "ext_2_python_units",
    "ext_3_script_units",
    "ext_5_html_blocks",
    "qry_6_load",
]


def main():
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    spark = local_session(os.environ.get("BENCH_CPUS", "8"), "bench")
    from checks.registry import QUERIES
    import checks.all  # noqa: F401

    spark.range(1).count()
    spent = {}
    for name in HEADLINE:
        start = time.time()
        QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        spent[name] = round(time.time() - start, 3)
    print(
        json.dumps(
            {
                "metric": "headline_queries_total",
                "value": round(sum(spent.values()), 3),
                "unit": "sec",
                "queries": spent,
                "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf"),
            }
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()
