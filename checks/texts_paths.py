"""Path policy, names and derived texts."""

from pyspark.sql import functions as F

from checks.derived import bare_units, cte, sql, table, text_units
from checks.registry import check
from unitloom.functions import paths, texts
from unitloom.functions.paths import is_test_hit
from unitloom.sources import files as file_source

# Fixed folders of the derived file tree, by page_id % 14.
FOLDERS = [
    "src/core", "tests/unit", "docs/guide", "web/node_modules/x", "lib/site-packages/pip/_vendor",
    "lib/site-packages/six-1.0", "usr/lib64", "third/licenses", "pkg/sub", "build/out", "pkg/test_data",
    "doc", "lib/site-packages/setuptools-5", "lib64",
]
NAMES = ["mod.py", "__init__.py", "App.TSX", "view.jsx", "lib.rs", "page.htm", "x.ts", "notes.md", ".py", "a.b.js", "index.html"]

_folders = ", ".join(f"'{f}'" for f in FOLDERS)
_names = ", ".join(f"'{n}'" for n in NAMES)
cte(
    "paths",
    f"""SELECT page_id, ([{_folders}])[page_id % {len(FOLDERS)} + 1] || '/p' || page_id || '/' || ([{_names}])[page_id % {len(NAMES)} + 1] AS path
    FROM pages""",
)
cte(
    "path_parts",
    """SELECT *, string_split(path, '/') AS parts, lower(regexp_extract(path, '[^/](\\.[^./]+)$', 1)) AS ext,
      string_split(path, '/')[-1] AS last FROM paths""",
    ["paths"],
)
cte(
    "policy",
    """SELECT *, (ext IN ('.py', '.rs', '.js', '.jsx', '.ts', '.tsx', '.html', '.htm')
      AND NOT list_has_any(parts, ['__pycache__', '.git', '.venv', 'venv', 'node_modules', '.pytest_cache', 'dist-info', 'egg-info', '.tox', '.mypy_cache', 'dist', 'build', 'target', '.eggs', 'env'])
      AND NOT contains('/' || path, '/lib64/') AND NOT contains('/' || path, '/licenses/')
      AND regexp_extract('/' || path, '/site-packages/([^/-]*)', 1) NOT IN ('pip', 'setuptools', 'wheel', 'pkg_resources')) AS indexed,
      string_split(string_split(path, '/')[1], '-')[1] AS package FROM path_parts""",
    ["path_parts"],
)
_MODULE = """array_to_string(CASE WHEN last = '__init__.py' THEN parts[:-2]
    ELSE list_append(parts[:-2], CASE WHEN last = '.py' THEN last ELSE regexp_replace(last, '\\.[^.]+$', '') END) END, '.')"""


def page_paths(spark, sf_dir):
    pick = lambda values: F.element_at(F.array(*map(F.lit, values)), (F.col("page_id") % len(values) + 1).cast("int"))
    path = F.concat(pick(FOLDERS), F.lit("/p"), "page_id", F.lit("/"), pick(NAMES))
    return table(spark, sf_dir, "pages").select("page_id", path.alias("path"))


@check("flt_1_index_policy", sql("SELECT path FROM policy WHERE indexed", "policy"))
def flt_1(spark, sf_dir):
    return page_paths(spark, sf_dir).filter(paths.should_index("path")).select("path")


@check(
    "flt_2_package_allow_list",
    sql("SELECT path FROM policy WHERE indexed AND (ext <> '.py' OR package IN ('src', 'pkg'))", "policy"),
)
def flt_2(spark, sf_dir):
    df = page_paths(spark, sf_dir).withColumn("package", paths.package_name("path", below_site_packages=""))
    return df.filter(paths.should_index("path", {"src", "pkg"}, "package")).select("path")


@check(
    "prj_1_package_name",
    sql("SELECT page_id, package AS in_site, 'six' AS below_site, 'proj' AS package_root, CAST(NULL AS VARCHAR) AS plain FROM policy", "policy"),
)
def prj_1(spark, sf_dir):
    return page_paths(spark, sf_dir).select(
        "page_id",
        paths.package_name("path", below_site_packages="").alias("in_site"),
        paths.package_name("path", below_site_packages="six-1.0/inner").alias("below_site"),
        paths.package_name("path", root_name="proj", root_is_package=True).alias("package_root"),
        paths.package_name("path", root_name="proj").alias("plain"),
    )


@check(
    "prj_2_module_name",
    sql(
        f"SELECT page_id, {_MODULE} AS plain, 'proj.' || {_MODULE} AS packaged, {_MODULE} AS prefixed FROM policy",
        "policy",
    ),
)
def prj_2(spark, sf_dir):
    df = page_paths(spark, sf_dir).withColumn("package", F.substring_index("path", "/", 1))
    return df.select(
        "page_id",
        paths.module_name(F.lit(None).cast("string"), "path").alias("plain"),
        paths.module_name(F.lit("proj"), "path").alias("packaged"),
        paths.module_name("package", "path").alias("prefixed"),
    )


_NAMESPACE = """CASE WHEN contains('/' || path, '/tests/') OR contains('/' || path, '/test_') THEN 'tests'
    WHEN {pip} THEN 'pip' WHEN list_has_any(parts, ['docs', 'doc', 'documentation']) THEN 'docs' ELSE 'code' END"""


@check(
    "prj_3_namespace_class",
    sql(f"SELECT page_id, {_NAMESPACE.format(pip='FALSE')} AS in_code, {_NAMESPACE.format(pip='TRUE')} AS in_site FROM policy", "policy"),
)
def prj_3(spark, sf_dir):
    package = paths.package_name("path", below_site_packages="")
    return page_paths(spark, sf_dir).select(
        "page_id", paths.namespace_class("path", F.lit(None).cast("string")).alias("in_code"),
        paths.namespace_class("path", package, True).alias("in_site"),
    )


@check(
    "ext_1_language_dispatch",
    sql(
        """SELECT page_id, CASE ext WHEN '.py' THEN 'python' WHEN '.rs' THEN 'rust' WHEN '.js' THEN 'javascript' WHEN '.ts' THEN 'typescript'
        WHEN '.tsx' THEN 'tsx' WHEN '.jsx' THEN 'tsx' WHEN '.html' THEN 'html' WHEN '.htm' THEN 'html' END AS language,
        CASE ext WHEN '.py' THEN 'python' END AS ref_language FROM policy""",
        "policy",
    ),
)
def ext_1(spark, sf_dir):
    return page_paths(spark, sf_dir).select(
        "page_id", paths.language_of("path").alias("language"), paths.ref_language_of("path").alias("ref_language")
    )


@check(
    "src_3_file_context",
    sql(f"SELECT path, CAST(NULL AS VARCHAR) AS package, {_MODULE} AS module, {_NAMESPACE.format(pip='FALSE')} AS namespace FROM policy WHERE indexed", "policy"),
)
def src_3(spark, sf_dir):
    return file_source.file_context(page_paths(spark, sf_dir)).select("path", "package", "module", "namespace")


@check(
    "flt_4_test_files",
    sql(
        """SELECT page_id, (contains(slashed, '/tests/') OR starts_with(slashed, 'tests/') OR contains(slashed, '/test_') OR namespace = 'tests') AS is_test
        FROM (SELECT page_id, CASE WHEN page_id % 2 = 0 THEN path ELSE path END AS slashed, CASE WHEN page_id % 5 = 0 THEN 'tests' END AS ns,
              coalesce(CASE WHEN page_id % 5 = 0 THEN 'tests' END, '') AS namespace FROM paths)""",
        "paths",
    ),
)
def flt_4(spark, sf_dir):
    """Half of the paths come with backslashes, some rows without a namespace."""
    df = page_paths(spark, sf_dir).select(
        "page_id",
        F.when(F.col("page_id") % 2 == 0, F.col("path")).otherwise(F.replace("path", F.lit("/"), F.lit("\\"))).alias("path"),
        F.when(F.col("page_id") % 5 == 0, "tests").alias("namespace"),
    )
    return df.select("page_id", is_test_hit().alias("is_test"))


# -- names and texts of units ------------------------------------------------------------


def _unit_check(name, select, column, needs, build):
    @check(name, sql(f"SELECT doc_id, {select} AS {column} FROM {needs}", needs))
    def query(spark, sf_dir):
        return text_units(spark, sf_dir).select("doc_id", build().alias(column))


_unit_check("prj_4_qualified_name", "qualified_name", "qualified_name", "units", texts.qualified_name)
_unit_check("prj_5_unit_id", "id", "id", "units", texts.unit_id)
_unit_check("prj_8_content_hash", "left(sha256(content), 16)", "content_hash", "units", texts.content_hash)
_unit_check("prj_9_base_embed_text", "base", "embed_text", "texted", texts.embed_text)
_unit_check("prj_10_search_text", "search_text", "search_text", "texted", texts.search_text)
_unit_check("prj_11_func_lane_text", "embed_func_text", "embed_func_text", "texted", texts.func_text)
_unit_check("prj_12_call_lane_text", "embed_call_text", "embed_call_text", "texted", texts.call_text)
_unit_check("prj_13_class_lane_text", "embed_class_text", "embed_class_text", "texted", texts.class_text)


@check(
    "prj_14_embedding_batch",
    sql("SELECT id, qualified_name, embed_func_text AS embed_text, content, namespace FROM texted", "texted"),
)
def prj_14(spark, sf_dir):
    return text_units(spark, sf_dir).select(
        "id", "qualified_name", F.col("embed_func_text").alias("embed_text"), "content", "namespace"
    )


@check(
    "prj_7_role",
    sql("SELECT id, role, CASE WHEN namespace = 'en' THEN 'script' ELSE 'markup' END AS page_role FROM units", "units"),
)
def prj_7(spark, sf_dir):
    tag = F.when(F.col("namespace") == "en", "script").otherwise("style")
    return bare_units(spark, sf_dir).select("id", texts.role().alias("role"), texts.html_role(tag).alias("page_role"))


LINES = "regexp_split_to_array(regexp_replace(text, '\\r?\\n\\z', ''), '\\r?\\n')"


@check(
    "src_2_decoded_lines",
    f"SELECT doc_id, unnest(range(1, len(ls) + 1)) AS line_no, unnest(ls) AS text FROM (SELECT doc_id, {LINES} AS ls FROM documents)",
)
def src_2(spark, sf_dir):
    df = table(spark, sf_dir, "documents").select(
        F.col("doc_id").alias("path"), file_source.decode(F.col("text").cast("binary")).alias("text")
    )
    rows = file_source.line_rows(df)
    return rows.select(F.col("path").alias("doc_id"), F.col("line_no").cast("long").alias("line_no"), "text")


@check(
    "prj_6_line_range",
    f"SELECT doc_id, array_to_string(ls[2:len(ls) // 2 + 2], chr(10)) AS content FROM (SELECT doc_id, {LINES} AS ls FROM documents)",
)
def prj_6(spark, sf_dir):
    df = table(spark, sf_dir, "documents").withColumn("lines", file_source.source_lines("text"))
    end = F.floor(F.size("lines") / 2).cast("int") + 2
    return df.select("doc_id", texts.line_range("lines", F.lit(2), end).alias("content"))
