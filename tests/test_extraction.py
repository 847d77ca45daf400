import ast

import pytest

from unitloom.plans.index import found_units, index_files, index_repository
from unitloom.sources.files import read_repository

EXPECTED = {
    # path, start, end, symbol, class chain, calls
    ("app.js", 3, 5, "add", "", ""),
    ("app.js", 11, 15, "load", "", "fetch base json then map report"),
    ("app.js", 14, 14, "<anonymous>", "", "map"),
    ("app.js", 14, 14, "<anonymous>", "", ""),
    ("app.js", 14, 14, "<anonymous>", "", "report"),
    ("app.js", 18, 21, "constructor", "Box", ""),
    ("app.js", 22, 22, "size", "Box", "measure"),
    ("app.js", 23, 25, "walk", "Box", "step"),
    ("app.js", 28, 31, "<anonymous>", "", "f"),
    ("app.js", 29, 30, "<anonymous>", "", "f"),
    ("app.js", 33, 33, "<anonymous>", "", ""),
    ("app.js", 34, 34, "run", "", "go"),
    ("app.js", 34, 34, "<anonymous>", "", ""),
    ("lib.rs", 13, 18, "new", "Point<'a>", "check"),
    ("lib.rs", 20, 26, "check", "Point<'a>", "pow find Some helper"),
    ("lib.rs", 30, 30, "fmt", "Wrapper<T>", ""),
    ("lib.rs", 33, 33, "twice", "", "go"),
    ("lib.rs", 35, 38, "free", "", "trim to_string"),
    ("page.html", 2, 4, "style:inline:2", "", ""),
    ("page.html", 6, 11, "script:inline:6", "", ""),
    ("page.html", 12, 12, "script:inline:12", "", ""),
    ("page.html:inline:6", 2, 4, "hello", "", "track"),
    ("page.html:inline:12", 1, 1, "<anonymous>", "", "ping"),
    ("shapes.py", 5, 15, "traced", "", "wraps log fmt fn"),
    ("shapes.py", 10, 13, "inner", "", "log fmt fn"),
    ("shapes.py", 11, 13, "inner", "", "log fmt fn"),
    ("shapes.py", 21, 32, "area", "Shape", "width compute height"),
    ("shapes.py", 23, 32, "area", "Shape", "width compute height"),
    ("shapes.py", 35, 42, "run", "Shape.Inner", "step"),
    ("shapes.py", 45, 45, "last", "Shape", "join"),
    ("shapes.py", 47, 49, "tail", "", "default g range tail"),
    ("shapes.py", 48, 49, "tail", "", "default g range tail"),
    ("view.ts", 6, 8, "show", "View", "draw"),
    ("view.ts", 9, 11, "draw", "View", "build"),
    ("view.ts", 13, 13, "<anonymous>", "", ""),
    ("view.ts", 15, 15, "over", "", "log"),
}


@pytest.fixture(scope="module")
def indexed(spark):
    import os

    root = os.path.join(os.path.dirname(__file__), "corpus")
    chunks, refs = index_files(read_repository(spark, root))
    return chunks.orderBy("seq").collect(), refs.collect()


def test_units_of_the_corpus(indexed):
    rows, _ = indexed
    got = {(r.path, r.start_line, r.end_line, r.symbol, ".".join(r.class_chain), " ".join(r.calls)) for r in rows}
    assert got == EXPECTED
    # Three anonymous functions of app.js line 14 differ in their calls only.
    assert len(rows) == len(EXPECTED)


def test_units_come_in_document_order(indexed):
    rows, _ = indexed
    for path in ("app.js", "lib.rs", "shapes.py"):
        starts = [r.start_line for r in rows if r.path == path]
        assert starts == sorted(starts)


def test_python_spans_agree_with_the_standard_parser(indexed, corpus):
    rows, _ = indexed
    source = open(f"{corpus}/shapes.py").read()
    want = set()
    for node in ast.walk(ast.parse(source)):
        if isinstance(node, (ast.FunctionDef, ast.AsyncFunctionDef)):
            want.add((node.name, node.lineno, node.end_lineno))
            if node.decorator_list:
                want.add((node.name, node.decorator_list[0].lineno, node.end_lineno))
    assert {(r.symbol, r.start_line, r.end_line) for r in rows if r.path == "shapes.py"} == want


def test_docs(indexed):
    rows, _ = indexed
    docs = {(r.path, r.start_line): r.doc for r in rows if r.doc}
    assert docs == {
        ("app.js", 3): "Adds two\nnumbers.",
        ("app.js", 11): "Fetch it.\n@param {string} u",
        ("lib.rs", 13): "Makes one.\n\nTwice.",
        ("shapes.py", 5): "Wrap a function.\n\nKeeps the name.",
        ("shapes.py", 35): "One line.",
    }


def test_refs(indexed):
    _, refs = indexed
    by_id = {r.unit_id: r.refs for r in refs}
    assert by_id["shapes.py::shapes.Shape.area"] == {
        "mro": "Base, mixins.Named, make_base, Shape, object", "metaclass": "Meta", "mro_source": "static",
    }
    assert by_id["shapes.py::shapes.Shape.Inner.run"]["mro"] == "Inner, object"
    assert len(refs) == 4


def test_content_is_the_line_range(indexed, corpus):
    rows, _ = indexed
    for r in rows:
        if ":inline:" in r.path:
            continue
        lines = open(f"{corpus}/{r.path}").read().splitlines()
        assert r.content == "\n".join(lines[r.start_line - 1 : r.end_line])


def test_long_blocks_do_not_overflow_the_matcher(spark):
    body = "\n".join(f"    x{i} = call_{i}(x)  # note" for i in range(20000))
    text = f"def big(x):\n{body}\n\ndef after():\n    pass\n"
    script = "function big(x) {\n" + "\n".join(f"  if (x) {{ call_{i}(x); }}" for i in range(5000)) + "\n}\nfunction after() {}\n"
    df = spark.createDataFrame(
        [("a/big.py", bytearray(text.encode())), ("a/big.js", bytearray(script.encode()))], "path string, source binary"
    )
    chunks, _ = index_files(df, ["python", "javascript"])
    got = {(r.path, r.symbol, r.start_line, r.end_line, r.n) for r in chunks.selectExpr("path", "symbol", "start_line", "end_line", "size(calls) n").collect()}
    assert got == {
        ("a/big.py", "big", 1, 20001, 20000), ("a/big.py", "after", 20003, 20004, 0),
        ("a/big.js", "big", 1, 5002, 5000), ("a/big.js", "after", 5003, 5003, 0),
    }


def test_index_writes_both_files(spark, corpus, tmp_path):
    from unitloom.sources.jsonl import read_chunks, read_refs

    index_repository(spark, corpus, str(tmp_path / "out"), languages=["python"])
    rows = read_chunks(spark, str(tmp_path / "out/chunks.jsonl"))
    assert rows.count() == 9
    assert read_refs(spark, str(tmp_path / "out/refs.jsonl")).count() == 3
    text = rows.filter("symbol = 'area'").first().embed_text
    assert text.endswith("ref: mro | Base, mixins.Named, make_base, Shape, object\nref: metaclass | Meta")


def units_of(spark, path, text, language):
    df = spark.createDataFrame([(path, bytearray(text.encode()))], "path string, source binary")
    rows = index_files(df, [language])[0].select("symbol", "start_line", "end_line", "calls").collect()
    return sorted((r.symbol, r.start_line, r.end_line, " ".join(r.calls)) for r in rows)


@pytest.mark.parametrize("depth", [61, 500])
def test_brackets_nest_to_any_depth(spark, depth):
    body = "{ a(); " * depth + "}" * depth
    assert units_of(spark, "a/n.js", f"function deep() {{{body}}}\nfunction b() {{ c(); }}", "javascript") == [("b", 2, 2, "c"), ("deep", 1, 1, "a")]
    assert units_of(spark, "a/n.rs", f"fn deep() {{{body}}}\nfn b(x: [u8; 4]) {{ c(); }}", "rust") == [("b", 2, 2, "c"), ("deep", 1, 1, "a")]
    inner = "(" * depth + "1" + ")" * depth
    assert units_of(spark, "a/p.js", f"function f(a = {inner}) {{ g(); }}", "javascript") == [("f", 1, 1, "g")]
    assert units_of(spark, "a/p.py", f"def f(a=(\n{inner}\n), b=2):\n    g()\n", "python") == [("f", 1, 4, "g")]


def test_bases_behind_deep_brackets(spark):
    text = "class C(A, mix(B, " + "(" * 40 + "1" + ")" * 40 + "), D):\n    def m(self):\n        pass\n"
    df = spark.createDataFrame([("c.py", bytearray(text.encode()))], "path string, source binary")
    assert index_files(df, ["python"])[1].first().refs["mro"] == "A, mix, D, C, object"


def test_generics_of_an_impl_nest_to_any_depth(spark):
    text = "impl<T: A<B<C<D<E<F<G>>>>>>> Run for Wrapper<T> {\n fn go(&self) { x() }\n}\n"
    df = spark.createDataFrame([("c.rs", bytearray(text.encode()))], "path string, source binary")
    assert index_files(df, ["rust"])[0].first().class_chain == ["Wrapper<T>"]


def test_literals_and_types_are_told_at_any_distance(spark):
    script = "function f() {\n  x =" + " " * 40 + "/}/;\n  g();\n}\nfunction h(x) {\n  if (x) /}/.test(x);\n  k();\n}"
    assert units_of(spark, "a/r.js", script, "javascript") == [("f", 1, 4, "g"), ("h", 5, 8, "test k")]
    typed = "const f = (a: string): Promise<() => void> => { g(a); }"
    assert units_of(spark, "a/t.ts", typed, "typescript") == [("<anonymous>", 1, 1, "g")]
    nested = "function f() { return `a ${b(`in ${c(1)} {`)} }`; }\nfunction z() { y(); }"
    assert units_of(spark, "a/n.js", nested, "javascript") == [("f", 1, 1, "b c"), ("z", 2, 2, "y")]


def test_one_line_costs_as_much_as_many(spark):
    import time

    parts = [f"function f{i}(x) {{ if (x) {{ g{i}(x); }} }}" for i in range(4000)]
    spent = []
    for glue in ("\n", " "):
        start = time.time()
        assert len(units_of(spark, "a/x.js", glue.join(parts), "javascript")) == 4000
        spent.append(time.time() - start)
    assert spent[1] < 5 * spent[0] + 5


def test_python_spans_agree_with_the_standard_parser_on_generated_files(spark):
    import random

    rng = random.Random(11)

    def block(indent, depth):
        out = []
        for i in range(rng.randint(1, 3)):
            pad, kind = "    " * indent, rng.randint(0, 5)
            if kind < 2 and depth < 6:
                out += [f"{pad}@deco({rng.randint(0, 9)})"] * rng.randint(0, 1)
                out += [f"{pad}{'async ' if kind else ''}def f{rng.randint(0, 99)}(a, b=({'(' * depth}1,", "2" + ")" * depth + ")):"]
                out += block(indent + 1, depth + 1)
            elif kind == 2 and depth < 6:
                out += [f"{pad}class C{rng.randint(0, 99)}(B[{rng.randint(0, 9)}]):"] + block(indent + 1, depth + 1)
            else:
                out += rng.choice([[f"{pad}x = 'def no(): (' # ("], [f'{pad}y = f"""a', "def no():", '  {call(1)} ("""'], [f"{pad}z = call(", "1,", f"{pad})", ""], [f"{pad}pass"]])
        return out

    files = {f"m{i}.py": "\n".join(block(0, 0)) + "\n" for i in range(40)}
    df = spark.createDataFrame([(p, bytearray(t.encode())) for p, t in files.items()], "path string, source binary")
    rows = index_files(df, ["python"])[0].select("path", "symbol", "start_line", "end_line").collect()
    want = set()
    for path, text in files.items():
        for node in ast.walk(ast.parse(text)):
            if isinstance(node, (ast.FunctionDef, ast.AsyncFunctionDef)):
                want.add((path, node.name, node.lineno, node.end_lineno))
                if node.decorator_list:
                    want.add((path, node.name, node.decorator_list[0].lineno, node.end_lineno))
    assert {tuple(r) for r in rows} == want


def test_types_are_no_operators(spark):
    typed = "function q<T extends { a: () => void }>(x: T) { run<{a: number}>(x); other(x) }\n"
    typed += "class A<K> extends B<K> {\n  m = async <T,>(a: T) => { g<() => void>(a) }\n  k<Q = (x: Q) => Q>(x: Q): Map<Q, { f(): Q }> { return h?.<Q>(x) }\n}\n"
    typed += "function r(i: number) { for (let j = 0; j < i; j++) { if (j < n && n > (i)) p(j < i, q > i) } }\n"
    assert units_of(spark, "a/t.ts", typed, "typescript") == [
        ("<anonymous>", 3, 3, "g"), ("k", 4, 4, "h"), ("q", 1, 1, "run other"), ("r", 6, 6, "p"),
    ]
    assert units_of(spark, "a/t.js", "function c() { f(a < b, d > (e(1))); }", "javascript") == [("c", 1, 1, "f e")]


def test_function_types_are_no_units(spark):
    typed = "function f(cb: (a: number) => void, k?: { x: () => T }) { g(c ? a : (x) => y) }\n"
    typed += "const h = (cb: (a: number) => void): ((x: T) => U) => { i() }\n"
    typed += "class A {\n  p: (x: number) => void = (x) => { k() }\n  static q?: () => void\n  m(): () => void { return { a: (x) => l(x) } }\n}\n"
    typed += "type X<T> =\n  | (() => void)\n  | B\nlet z: () => void = n as (x: number) => void\nswitch (x) { case o(x): (a) => b }\n"
    assert units_of(spark, "a/t.ts", typed, "typescript") == [
        ("<anonymous>", 1, 1, ""), ("<anonymous>", 2, 2, "i"), ("<anonymous>", 4, 4, "k"),
        ("<anonymous>", 6, 6, "l"), ("<anonymous>", 12, 12, ""), ("f", 1, 1, "g"), ("m", 6, 6, "l"),
    ]


def test_division_behind_an_object(spark):
    text = "function f(){ return g({a:1}/2 + h(3)/k(1)); }\nfunction i(){ let n = 1; n++ / j(2) / l(3); }\nfunction z(x){ if (x) {} /}/.test(x); }"
    assert units_of(spark, "a/d.js", text, "javascript") == [("f", 1, 1, "g h k"), ("i", 2, 2, "j l"), ("z", 3, 3, "test")]


def test_computed_names_stay_as_written(spark):
    text = "class A {\n  [\"k\"+1]() { a('x'); }\n  static ['b'](x) { c([\"f(\", '}']); }\n}\nconst o = { ['m.n']() {}, x: ['p', '('] };"
    assert units_of(spark, "a/c.js", text, "javascript") == [
        ("[\"k\"+1]", 2, 2, "a"), ("['b']", 3, 3, "c"), ("['m.n']", 5, 5, ""),
    ]


def test_many_type_lists_end_in_linear_time():
    import time

    from unitloom.functions.marking import mark_typed

    n = 20000
    for text in ("a<" * n, "a<" * n + ">" * n + " x", "a<(b" * n, "f<a>(x) < " * n, "a<{b:" * n + "}>" * (n - 1), "a<b,f<c>(" * n,
                 "(a: " * n, "let a: {b: " * n + "}" * n, "let a: (b?: " * n + ") => void" * n, "let a: <T>(x" * n, "(x: [a.b " * n):
        start = time.time()
        mark_typed(text)
        assert time.time() - start < 10


def test_generated_typescript_has_the_units_it_was_made_of(spark):
    import random

    rng = random.Random(7)
    names = iter(range(10**6))

    def type_of(depth):
        kind = rng.randint(0, 7 if depth else 1)
        inner = lambda: type_of(depth - 1)
        return [
            lambda: "T", lambda: rng.choice(["number", "'x'", "A.B", "string[]"]), lambda: f"Map<{inner()}, {inner()}>",
            lambda: f"{{ a: {inner()}; b?: {inner()} }}", lambda: f"(x: {inner()}) => {inner()}",
            lambda: f"[{inner()}, {inner()}]", lambda: f"T extends {inner()} ? {inner()} : never",
            lambda: f"{{\n  a(x: {inner()}): {inner()}\n  readonly b: {inner()}\n}}",
        ][kind]()

    def listed(depth=3):
        return f"<{type_of(depth)}>" if rng.random() < 0.7 else ""

    def statements(depth):
        """Text and calls of the statements; units inside are added to `units` by their symbol."""
        text, calls = [], []
        for _ in range(rng.randint(1, 4)):
            kind, name = rng.randint(0, 6 if depth else 4), f"f{next(names)}"
            if kind == 0:
                text.append(f"{name}{listed()}(a, 'x<y>(z)')")
                calls.append(name)
            elif kind == 1:
                text.append(f"if (a < b && c > (d)) {{ {name}{listed()}(a) }}")
                calls.append(name)
            elif kind == 2:
                text.append(f"for (let i = 0; i < n; i++) {name}(i < n, i > 2)")
                calls.append(name)
            elif kind == 3:
                text.append(f"const {name}: {type_of(2)} = new Map{listed()}()")
            elif kind == 4:
                text.append(f"const {name} = ({{ a: 1 }}/2) + g{name}(3)/h{name}{listed()}(1)")
                calls.extend([f"g{name}", f"h{name}"])
            else:
                more, inside = function(depth - 1)
                text.append(more)
                calls.extend(inside)
        return ";\n".join(text) + ";\n", calls

    def function(depth):
        name = f"u{next(names)}"
        head = f"<T extends {type_of(2)}, U = {type_of(2)}>" if rng.random() < 0.7 else ""
        body, calls = statements(depth)
        units[name] = " ".join(calls)
        return f"function {name}{head}(x: {type_of(2)}, y?: {type_of(2)}): Map<{type_of(1)}, T> {{\n{body}}}", calls

    files, want = [], set()
    for i in range(60):
        units = {}
        text = "\n".join(function(3)[0] for _ in range(3)) + "\n"
        files.append((f"m{i}.ts", bytearray(text.encode())))
        want |= {(f"m{i}.ts", s, c) for s, c in units.items()}
    df = spark.createDataFrame(files, "path string, source binary")
    rows = index_files(df, ["typescript"])[0].select("path", "symbol", "calls").collect()
    assert {(r.path, r.symbol, " ".join(r.calls)) for r in rows} == want


def test_a_file_is_extracted_once_in_small_batches(spark):
    """No filter below the explosion of units repeats the extraction; a file without units gives no row."""
    rows = [("a.py", "def f():\n    return g(1)\n"), ("b.py", "x = 1\n"), ("c.py", None)]
    files = spark.createDataFrame(rows, "path string, text string").selectExpr(
        "path", "text", "'python' AS language", "'m' AS module", "CAST(NULL AS string) AS package", "'code' AS namespace"
    )
    units = found_units(files, ["python"]).select("path", "symbol", "calls")
    assert units._jdf.queryExecution().optimizedPlan().toString().count("ArrowEvalPython") == 1
    assert 0 < int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")) <= 500
    assert [tuple(r) for r in units.collect()] == [("a.py", "f", ["g"])]
