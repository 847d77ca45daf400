"""Extraction over source files built from the documents: every file holds a whole text."""

import re

from pyspark.sql import functions as F

from checks.derived import cte, scratch, sql, table
from checks.registry import check
from unitloom.functions import texts
from unitloom.operators import joins
from unitloom.operators.extract import html_units, python_units
from unitloom.plans.index import found_units, index_files
from unitloom.session import spread
from unitloom.sources import jsonl

# One template per language. {T} is the document text, {id}, {source}, {lang} its columns.
PYTHON = '''"""Module of {source}."""
import os

class C{id}({source}.Base, mixin({id}), Generic[int], metaclass=M{lang}):
    """Class doc."""

    @wrap(size={id})
    @cached
    def m{id}(self, x):
        """{T}"""
        return helper_{source}(x, self.go(x), "f(")

    def k{id}(
        self,
    ):
        return os.path.join("a)", 'b')

def f{id}(a, b=default()):
    # note(1)
    def g{id}(y):
        return y(a)

    return g{id}(b) + f{id}(a)
'''
SCRIPT = """/**
 * {T}
 * @param a
 */
async function load{id}(a) {
  const s = "} function no() {";
  return fetch{source}(a).then((r) => r.json());
}

// short note
// on two lines
class B{id} extends Base {
  constructor(v) {
    super(v);
    this.v = make(v);
  }
  // size of it
  get size() { return measure(this.v); }
}
"""
RUST = """//! Crate {source}

/// {T}
#[inline]
pub fn run{id}(s: &str) -> usize {
    let c = '{'; // run(1)
    println!("{}", hidden(s));
    Parser::parse{source}(s).size()
}

impl<T> Run for S{id}<T> {
    /// Goes.
    fn go(&self) -> usize { fn inner(x: usize) -> usize { twice(x) } inner(1) }
}
"""
TYPED = """/**
 * {T}
 */
export function pick{id}<T extends { a: () => void }>(x: T, y?: (n: number) => Map<T, { f(): T }>): T {
  run{id}<{ a: number }>(x);
  return other{source}(x < y, y > x) / ({ a: 1 }/2 + third(3)/fourth(1));
}

class D{id}<K> extends Base<K, () => K> {
  handler: (e: Event) => void = (e) => { seen(e) };
  ["k"+{id}]<Q>(q: Q): () => void { return bound?.<Q>(q); }
}
type U{id}<T> =
  | (() => void)
  | { m(): T };
"""
# language -> template, suffix, what opens the lines of {T} after the first
FILES = {
    "python": (PYTHON, ".py", "        "),
    "script": (SCRIPT, ".js", " * "),
    "rust": (RUST, ".rs", "/// "),
    "typed": (TYPED, ".ts", " * "),
}
# What ends the literal or comment that holds the text is written as the language needs it.
ESCAPES = {
    "python": (lambda t: F.regexp_replace(t, r'([\\"])', r"\\$1"), "regexp_replace(t, '([\\\\\"])', '\\\\\\1', 'g')"),
    "script": (lambda t: F.replace(F.replace(t, F.lit("*/"), F.lit("* /")), F.lit("/*"), F.lit("/ *")), "replace(replace(t, '*/', '* /'), '/*', '/ *')"),
    "rust": (lambda t: t, "t"),
}
ESCAPES["typed"] = ESCAPES["script"]


def trimmed(text):
    """A text with trimmed lines and without empty ones."""
    text = F.regexp_replace(text, r"[ \t\r]*\n[ \t\r\n]*", "\n")
    return F.regexp_replace(text, r"^[ \t\r\n]+|[ \t\r\n]+$", "")


def files(spark, sf_dir, kind):
    template, suffix, margin = FILES[kind]
    doc = spread(table(spark, sf_dir, "documents"))
    clean = ESCAPES[kind][0](trimmed("text"))
    doc = doc.select("doc_id", "source", "lang", F.replace(clean, F.lit("\n"), F.lit("\n" + margin)).alias("t"))
    inserts = {"{id}": F.col("doc_id").cast("string"), "{source}": F.col("source"), "{lang}": F.col("lang")}

    def filled(value, marks):
        """Marks that stand in an inserted value are replaced too, in this order."""
        for mark in marks:
            value = F.replace(value, F.lit(mark), inserts[mark])
        return value

    values = {
        "{T}": F.when(F.col("t").contains("{"), filled(F.col("t"), inserts)).otherwise(F.col("t")),
        "{id}": inserts["{id}"], "{source}": filled(F.col("source"), ["{lang}"]), "{lang}": F.col("lang"),
    }
    pieces = re.split(r"(\{T\}|\{id\}|\{source\}|\{lang\})", template)
    # A NULL makes the file NULL, whether the template shows that column or not.
    unused = [F.left(values[mark], F.lit(0)) for mark in values if mark not in pieces]
    text = F.concat(*[values.get(p, F.lit(p)) for p in pieces if p], *unused)
    path = F.concat(F.lit("src/"), "source", F.lit("/"), "lang", F.lit("/d"), "doc_id", F.lit(suffix))
    return doc.select("doc_id", path.alias("path"), text.alias("text"))


def units(spark, sf_dir, kind):
    df = files(spark, sf_dir, kind)
    language = {"python": "python", "script": "javascript", "rust": "rust", "typed": "typescript"}[kind]
    described = df.select(
        "path", "text", F.lit(language).alias("language"),
        F.regexp_replace(F.regexp_replace("path", r"\.\w+$", ""), "/", ".").alias("module"),
        F.lit(None).cast("string").alias("package"), F.lit("code").alias("namespace"),
    )
    return found_units(described, [language])


def _literal(text):
    return "'" + text.replace("'", "''") + "'"


cte(
    "clean",
    """SELECT doc_id, source, lang, t, len(string_split(t, chr(10))) - 1 AS nl, 'src/' || source || '/' || lang || '/d' || doc_id AS stem,
      'src.' || source || '.' || lang || '.d' || doc_id AS module FROM (
      SELECT *, regexp_replace(regexp_replace(text, '[ \\t\\r]*\\n[ \\t\\r\\n]*', chr(10), 'g'), '^[ \\t\\r\\n]+|[ \\t\\r\\n]+$', '', 'g') AS t
      FROM documents)""",
)
for kind, (template, suffix, margin) in FILES.items():
    value = _literal(template)
    for mark, column in (
        ("{T}", f"replace(t, chr(10), chr(10) || '{margin}')"), ("{id}", "CAST(doc_id AS VARCHAR)"),
        ("{source}", "source"), ("{lang}", "lang"),
    ):
        value = f"replace({value}, '{mark}', {column})"
    cte(f"{kind}_files", f"SELECT *, stem || '{suffix}' AS path, string_split({value}, chr(10)) AS ls FROM (SELECT * REPLACE ({ESCAPES[kind][1]} AS t) FROM clean)", ["clean"])


def expected(kind, rows):
    """SELECT of the units a template yields; lines may grow by nl."""
    parts = []
    for first, last, symbol, chain, calls, doc in rows:
        parts.append(
            f"""SELECT doc_id, source, path, module, {first} AS start_line, {last} AS end_line, {symbol} AS symbol, {chain} AS class_chain,
            {calls} AS calls, {doc} AS doc, array_to_string(ls[{first}:{last}], chr(10)) AS content FROM {kind}_files"""
        )
    cte(
        f"{kind}_units",
        "SELECT *, module || CASE WHEN class_chain <> '' THEN '.' || class_chain ELSE '' END || '.' || symbol AS qualified_name,"
        " CASE WHEN class_chain <> '' THEN 'method' ELSE 'function' END AS role FROM (" + " UNION ALL ".join(parts) + ")",
        [f"{kind}_files"],
    )


_c = "'C' || doc_id"
expected(
    "python",
    [
        ("7", "(11 + nl)", "'m' || doc_id", _c, "'helper_' || source || ' go'", "t"),
        ("9", "(11 + nl)", "'m' || doc_id", _c, "'helper_' || source || ' go'", "t"),
        ("(13 + nl)", "(16 + nl)", "'k' || doc_id", _c, "'join'", "''"),
        ("(18 + nl)", "(23 + nl)", "'f' || doc_id", "''", "'default y g' || doc_id || ' f' || doc_id", "''"),
        ("(20 + nl)", "(21 + nl)", "'g' || doc_id", "''", "'y'", "''"),
    ],
)
expected(
    "script",
    [
        ("(5 + nl)", "(8 + nl)", "'load' || doc_id", "''", "'fetch' || source || ' then json'", "t || chr(10) || '@param a'"),
        ("(7 + nl)", "(7 + nl)", "'<anonymous>'", "''", "'json'", "''"),
        ("(13 + nl)", "(16 + nl)", "'constructor'", "'B' || doc_id", "'make'", "''"),
        ("(18 + nl)", "(18 + nl)", "'size'", "'B' || doc_id", "'measure'", "'size of it'"),
    ],
)
expected(
    "rust",
    [
        ("(5 + nl)", "(9 + nl)", "'run' || doc_id", "''", "'parse' || source || ' size'", "'Crate ' || source || chr(10) || t"),
        ("(13 + nl)", "(13 + nl)", "'go'", "'S' || doc_id || '<T>'", "'twice inner'", "'Goes.'"),
    ],
)
expected(
    "typed",
    [
        ("(4 + nl)", "(7 + nl)", "'pick' || doc_id", "''", "'run' || doc_id || ' other' || source || ' third fourth'", "t"),
        ("(10 + nl)", "(10 + nl)", "'<anonymous>'", "'D' || doc_id", "'seen'", "''"),
        ("(11 + nl)", "(11 + nl)", "'[\"k\"+' || doc_id || ']'", "'D' || doc_id", "'bound'", "''"),
    ],
)


def _digest(c):
    return F.md5(F.col(c).cast("binary")).alias(c)


_SPAN_SQL = "SELECT path, start_line, end_line, symbol, role, md5(content) AS content FROM {}_units"


def _spans(df):
    lines = [F.col(c).cast("long").alias(c) for c in ("start_line", "end_line")]
    return df.select("path", *lines, "symbol", "role", _digest("content"))


def _calls(df):
    return df.select("path", F.col("start_line").cast("long").alias("start_line"), F.array_join("calls", " ").alias("calls"))


def _docs(df):
    return df.select("path", F.col("start_line").cast("long").alias("start_line"), _digest("doc"))


_CALLS_SQL = "SELECT path, start_line, calls FROM {}_units"
_DOCS_SQL = "SELECT path, start_line, md5(doc) AS doc FROM {}_units"


@check("ext_2_python_units", sql(_SPAN_SQL.format("python"), "python_units"))
def ext_2(spark, sf_dir):
    return _spans(units(spark, sf_dir, "python"))


@check("ext_3_script_units", sql(_SPAN_SQL.format("script"), "script_units"))
def ext_3(spark, sf_dir):
    return _spans(units(spark, sf_dir, "script"))


@check("ext_3_typed_units", sql(_SPAN_SQL.format("typed"), "typed_units"))
def ext_3_typed(spark, sf_dir):
    return _spans(units(spark, sf_dir, "typed"))


@check("ext_4_rust_units", sql(_SPAN_SQL.format("rust"), "rust_units"))
def ext_4(spark, sf_dir):
    return _spans(units(spark, sf_dir, "rust"))


ALL_KINDS = ("python", "script", "rust")


def _all(spark, sf_dir, shape):
    out = None
    for kind in ALL_KINDS:
        part = shape(units(spark, sf_dir, kind))
        out = part if out is None else out.unionByName(part)
    return out


@check("ext_7_call_names", sql(" UNION ALL ".join(_CALLS_SQL.format(k) for k in ALL_KINDS), *[f"{k}_units" for k in ALL_KINDS]))
def ext_7(spark, sf_dir):
    return _all(spark, sf_dir, _calls)


@check("ext_7_typed_calls", sql(_CALLS_SQL.format("typed"), "typed_units"))
def ext_7_typed(spark, sf_dir):
    """Calls behind types, comparisons that look like types, and division behind an object."""
    return _calls(units(spark, sf_dir, "typed"))


@check(
    "ext_8_class_chain",
    sql(" UNION ALL ".join(f"SELECT path, start_line, class_chain FROM {k}_units" for k in ALL_KINDS), *[f"{k}_units" for k in ALL_KINDS]),
)
def ext_8(spark, sf_dir):
    return _all(
        spark, sf_dir,
        lambda d: d.select("path", F.col("start_line").cast("long").alias("start_line"), F.array_join("class_chain", ".").alias("class_chain")),
    )


@check("ext_9_python_docs", sql(_DOCS_SQL.format("python"), "python_units"))
def ext_9(spark, sf_dir):
    return _docs(units(spark, sf_dir, "python"))


@check("ext_10_rust_docs", sql(_DOCS_SQL.format("rust"), "rust_units"))
def ext_10(spark, sf_dir):
    return _docs(units(spark, sf_dir, "rust"))


@check("ext_11_script_docs", sql(_DOCS_SQL.format("script"), "script_units"))
def ext_11(spark, sf_dir):
    return _docs(units(spark, sf_dir, "script"))


@check("ext_12_doc_dispatch", sql(" UNION ALL ".join(_DOCS_SQL.format(k) for k in ALL_KINDS), *[f"{k}_units" for k in ALL_KINDS]))
def ext_12(spark, sf_dir):
    """All languages in one table; each row takes its own language's rule."""
    out = None
    for kind, language in zip(ALL_KINDS, ("python", "javascript", "rust")):
        part = files(spark, sf_dir, kind).select("path", "text", F.lit(language).alias("language"))
        out = part if out is None else out.unionByName(part)
    described = out.select(
        "path", "text", "language", F.lit("m").alias("module"), F.lit(None).cast("string").alias("package"), F.lit("code").alias("namespace")
    )
    return _docs(found_units(described))


@check(
    "ext_13_bases_and_metaclass",
    "SELECT doc_id, source || '.Base mixin' AS bases, 'M' || lang AS metaclass, 'type' AS plain_metaclass FROM documents",
)
def ext_13(spark, sf_dir):
    doc = table(spark, sf_dir, "documents")
    header = F.concat(
        F.lit("class C"), "doc_id", F.lit("("), "source", F.lit(".Base, mixin("), "doc_id", F.lit("), Generic[int, str], *extra, metaclass=M"), "lang", F.lit("):")
    )
    head = python_units.class_header(header)
    plain = python_units.class_header(F.concat(F.lit("class C"), "doc_id", F.lit(":")))
    return doc.select(
        "doc_id", F.array_join(head["bases"], " ").alias("bases"), head["metaclass"].alias("metaclass"), plain["metaclass"].alias("plain_metaclass")
    )


@check("ext_14_static_mro", "SELECT doc_id, source || '.Base, ' || lang || ', D' || doc_id || ', object' AS mro FROM documents")
def ext_14(spark, sf_dir):
    doc = table(spark, sf_dir, "documents")
    bases = F.array(F.concat("source", F.lit(".Base")), "lang")
    return doc.select("doc_id", python_units.static_mro(F.concat(F.lit("D"), "doc_id"), bases).alias("mro"))


@check(
    "ext_15_unit_refs",
    sql(
        """SELECT path || '::' || qualified_name AS unit_id, source || '.Base, mixin, C' || doc_id || ', object' AS mro, start_line
        FROM python_units WHERE class_chain <> ''""",
        "python_units",
    ),
)
def ext_15(spark, sf_dir):
    df = units(spark, sf_dir, "python").filter(F.col("refs").isNotNull())
    return df.select(
        F.col("id").alias("unit_id"), F.col("refs")["mro"].alias("mro"), F.col("start_line").cast("long").alias("start_line")
    )


@check(
    "ext_16_unit_assembly",
    sql(
        """SELECT path || '::' || qualified_name AS id, start_line, module, qualified_name, 'python' AS language, path, 'code' AS namespace, role,
        '[python] ' || role || ' `' || symbol || '` in ' || CASE WHEN class_chain <> '' THEN class_chain ELSE module END || ' | path: ' || path AS header,
        left(sha256(content), 16) AS content_hash FROM python_units""",
        "python_units",
    ),
)
def ext_16(spark, sf_dir):
    df = units(spark, sf_dir, "python")
    return df.select(
        "id", F.col("start_line").cast("long").alias("start_line"), "module", "qualified_name", "language", "path", "namespace", "role",
        F.substring_index(texts.embed_text(), "\n", 1).alias("header"), texts.content_hash().alias("content_hash"),
    )


@check(
    "jn_2_innermost_class",
    sql("SELECT path, start_line, class_chain AS name FROM python_units WHERE class_chain <> ''", "python_units"),
)
def jn_2(spark, sf_dir):
    """Classes of a file as intervals, met by its units through the path."""
    numbered = python_units.number_lines(python_units.blank("text"))
    # The outer form keeps Spark from a filter below, which would find the classes twice.
    classes = files(spark, sf_dir, "python").select("path", F.explode_outer(python_units.class_spans(numbered)).alias("c"))
    classes = classes.filter("c IS NOT NULL").select("path", "c.name", F.col("c.start").alias("start_line"), F.col("c.end").alias("end_line"))
    found = joins.innermost_enclosing(units(spark, sf_dir, "python").select("path", "start_line", "end_line"), classes)
    return found.filter(F.col("enclosing").isNotNull()).select(
        "path", F.col("start_line").cast("long").alias("start_line"), F.col("enclosing.name").alias("name")
    )


# -- HTML ------------------------------------------------------------------------------------

cte(
    "page_blocks",
    """SELECT page_id, tag, block, len(string_split(left(html, strpos(html, block) - 1), chr(10))) AS start_line,
      len(string_split(block, chr(10))) - 1 AS more, html FROM (
      SELECT page_id, html, 'script' AS tag, regexp_extract(html, '(?is)<script\\b.*?</script\\s*>') AS block FROM pages
      UNION ALL SELECT page_id, html, 'style', regexp_extract(html, '(?is)<style\\b.*?</style\\s*>') FROM pages)""",
)


def pages(spark, sf_dir, text="html"):
    df = spread(table(spark, sf_dir, "pages"))
    return df.select(
        F.concat(F.lit("site/p"), "page_id", F.lit(".html")).alias("path"), (F.expr(text) if isinstance(text, str) else text).alias("text"),
        F.lit("html").alias("language"), F.concat(F.lit("site.p"), "page_id").alias("module"),
        F.lit(None).cast("string").alias("package"), F.lit("code").alias("namespace"),
    )


@check(
    "ext_5_html_blocks",
    sql(
        """SELECT 'site/p' || page_id || '.html' AS path, tag || ':inline:' || start_line AS symbol, start_line, start_line + more AS end_line,
        CASE tag WHEN 'script' THEN 'script' ELSE 'markup' END AS role,
        md5(array_to_string(string_split(html, chr(10))[start_line:start_line + more], chr(10))) AS content FROM page_blocks""",
        "page_blocks",
    ),
)
def ext_5(spark, sf_dir):
    return _spans(found_units(pages(spark, sf_dir), ["html"]))


INLINE = "function p{id}(n) {\n  return track(n);\n}\nvar later = () => ping();"


@check(
    "ext_6_inline_scripts",
    sql(
        """SELECT 'site/p' || page_id || '.html:inline:' || start_line AS path, 1::BIGINT AS start_line, 'p' || page_id AS symbol, 'track' AS calls FROM page_blocks WHERE tag = 'script'
        UNION ALL SELECT 'site/p' || page_id || '.html:inline:' || start_line, 4, '<anonymous>', 'ping' FROM page_blocks WHERE tag = 'script'""",
        "page_blocks",
    ),
)
def ext_6(spark, sf_dir):
    code = F.replace(F.lit("<script>" + INLINE), F.lit("{id}"), F.col("page_id").cast("string"))
    df = pages(spark, sf_dir, F.replace("html", F.lit("<script>"), code))
    found = found_units(df, ["html", "javascript"]).filter(F.col("language") == "javascript")
    return found.select("path", F.col("start_line").cast("long").alias("start_line"), "symbol", F.array_join("calls", " ").alias("calls"))


# -- the whole index job and plug-ins ----------------------------------------------------------


@check(
    "qry_5_index",
    sql(
        """SELECT path || '::' || qualified_name AS id, start_line, calls, left(sha256(content), 16) AS content_hash,
        len(string_split(header_text, chr(10))) AS search_lines FROM (
        SELECT *, 'x' || CASE WHEN class_chain <> '' THEN chr(10) || 'x' ELSE '' END || repeat(chr(10) || 'x', 5) AS header_text FROM python_units)""",
        "python_units",
    ),
)
def qry_5(spark, sf_dir):
    """Source rows -> policy -> units -> chunk files -> read back."""
    source = files(spark, sf_dir, "python").select("path", F.col("text").cast("binary").alias("source"))
    chunks, refs = index_files(source, ["python"])
    folder = scratch(spark) + "/index"
    jsonl.write_jsonl(chunks, refs, folder)
    rows = jsonl.read_chunks(spark, folder + "/chunks.jsonl")
    return rows.select(
        "id", F.col("start_line").cast("long").alias("start_line"), F.array_join("calls", " ").alias("calls"), "content_hash",
        F.size(F.split("search_text", "\n")).cast("long").alias("search_lines"),
    )


@check(
    "udf_2_language_plug_in",
    sql("SELECT path, 1::BIGINT AS start_line, nl + 1 AS end_line, 'C' || source AS symbol FROM (SELECT *, 'notes/d' || doc_id || '.txt' AS path FROM clean)", "clean"),
)
def udf_2(spark, sf_dir):
    """A caller's own language: one unit per plain text, named by its source."""
    doc = spread(table(spark, sf_dir, "documents"))
    clean = trimmed("text")
    described = doc.select(
        F.concat(F.lit("notes/d"), "doc_id", F.lit(".txt")).alias("path"), clean.alias("text"), F.lit("note").alias("language"),
        F.col("source").alias("module"), F.lit(None).cast("string").alias("package"), F.lit("docs").alias("namespace"),
    )
    _register_notes()
    found = found_units(described, ["note"])
    return found.select(
        "path", F.col("start_line").cast("long").alias("start_line"), F.col("end_line").cast("long").alias("end_line"), "symbol"
    )


def _register_notes():
    from unitloom.operators.extract.registry import register_language, register_refs

    def notes(df):
        none = F.array().cast("array<string>")
        unit = F.struct(
            F.lit(1).alias("start_line"), F.size("lines").alias("end_line"), F.concat(F.lit("C"), "module").alias("symbol"),
            F.array("module").alias("class_chain"), F.lit("function").alias("role"), none.alias("calls"),
            F.lit("").alias("doc"), F.lit(None).cast("map<string,string>").alias("refs"),
        )
        return df.withColumn("note", F.when(F.col("language") == "note", F.array(unit)))

    register_language("note", ["note"], notes)
    register_refs("note", lambda u: F.create_map(F.lit("mro"), F.concat(u["symbol"], F.lit(", object"))))


@check(
    "udf_3_ref_plug_in",
    sql("SELECT 'notes/d' || doc_id || '.txt' AS path, 'C' || source || ', object' AS mro FROM documents"),
)
def udf_3(spark, sf_dir):
    """A caller's own class refs for that language."""
    doc = spread(table(spark, sf_dir, "documents"))
    described = doc.select(
        F.concat(F.lit("notes/d"), "doc_id", F.lit(".txt")).alias("path"), "text", F.lit("note").alias("language"),
        F.col("source").alias("module"), F.lit(None).cast("string").alias("package"), F.lit("docs").alias("namespace"),
    )
    _register_notes()
    return found_units(described, ["note"]).select("path", F.col("refs")["mro"].alias("mro"))
