"""Every catalog query against its SQL on the smallest tables."""

import decimal
import os

import duckdb
import pytest

from loomquery.plans import activity, catalog, doclinks, edits, graphs, lookup, takeover, workspace  # noqa: F401

DATA = "/root/testdata/sf0.001"
TABLES = sorted(name.removesuffix(".parquet") for name in os.listdir(DATA) if name.endswith(".parquet"))


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{DATA}/{t}.parquet'")
    return con


def _plain(v):
    return round(float(v), 6) if isinstance(v, (float, decimal.Decimal)) else v


@pytest.mark.parametrize("name", sorted(catalog.oracle_sql()))
def test_matches_sql(spark, duck, name):
    _compare(spark, duck, catalog.queries()[name], catalog.oracle_sql()[name])


@pytest.mark.parametrize("name", sorted(takeover.UNITS))
def test_units_match_sql(spark, duck, name):
    """The operators on the small code base of fixtures."""
    _compare(spark, duck, *takeover.UNITS[name])


def _compare(spark, duck, query, sql):
    df = query(spark, DATA)
    cols = sorted(df.columns)
    got = sorted((tuple(_plain(r[c]) for c in cols) for r in df.collect()), key=str)
    rel = duck.sql(sql)
    at = [list(rel.columns).index(c) for c in cols]
    assert got == sorted((tuple(_plain(r[i]) for i in at) for r in rel.fetchall()), key=str)


def test_greedy_caps(spark):
    from loomquery.operators.retrieval import greedy_caps

    rows = [(0, 1, s, 9.0 - s) for s in range(5)] + [(0, 2, 0, 8.5), (0, 3, 0, 8.4), (0, 4, 0, 8.3)]
    got = greedy_caps(spark.createDataFrame(rows, "grp int, query long, section long, score double"))
    assert {(r["query"], r["section"]) for r in got.collect()} == {(1, 0), (1, 1), (1, 2), (2, 0), (3, 0)}
    import random

    rng = random.Random(1)
    rows = [(0, q, s, float(rng.randint(1, 6))) for q in range(12) for s in range(12) if rng.random() < 0.6]
    want, q, s = set(), {}, {}
    for _, a, b, v in sorted(rows, key=lambda r: (-r[3], r[1], r[2])):
        if q.get(a, 0) < 3 and s.get(b, 0) < 3:
            want.add((a, b))
            q[a], s[b] = q.get(a, 0) + 1, s.get(b, 0) + 1
    got = greedy_caps(spark.createDataFrame(rows, "grp int, query long, section long, score double"))
    assert {(r["query"], r["section"]) for r in got.collect()} == want
    assert greedy_caps(got.limit(0)).count() == 0


def test_near_lines(spark, tmp_path):
    """Every item against every line by brute force: items and documents of any parity, lines past the first full stop."""
    import random
    import re

    rng = random.Random(5)
    vocab = [f"word{c}{d}" for c in "abcdefgh" for d in "klmnopqr"]
    items = [(i, " ".join(rng.sample(vocab, 12))) for i in range(8)] + [(8, None), (9, "two words")]
    docs = []
    for d in range(12):
        near = items[d % 8][1].split()
        near[d % 12] = near[d % 12] if d % 3 else "other"
        docs.append((d, "\n".join(["First. " + " ".join(rng.sample(vocab, 12)), " ".join(near), ""])))
    docs.append((12, None))
    spark.createDataFrame(items, "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    spark.createDataFrame(docs, "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    words = lambda t: set(re.findall("[a-z0-9]{4,}", (t or "").lower()))
    want = {}
    for i, t in items:
        for d, text in docs:
            for n, line in enumerate((text or "").split("\n")):
                a, b = words(t), words(line)
                if min(len(a), len(b)) >= 3 and (score := round(len(a & b) / len(a | b), 6)) >= 0.86:
                    want[i] = min(want.get(i, (0, 0, 0)), (-score, d, n))
    got = {r.item_id: (-r.score, r.doc_id, r.line) for r in catalog.queries()["near_lines"](spark, str(tmp_path)).collect()}
    assert got == want and {(i % 2, v[1] % 2) for i, v in got.items()} == {(0, 0), (1, 1)} and all(v[2] == 1 for v in got.values())


def test_within_vocabulary(spark):
    """A vocabulary too large to gather leaves every row in, and the matches are the same."""
    from loomquery.operators.retrieval import near_matches, within_vocabulary

    left = spark.createDataFrame([(1, ["a", "b", "c"]), (2, ["d", "e", "f", "g"])], "key long, w array<string>")
    right = spark.createDataFrame([(7, ["a", "b", "c"]), (8, ["a", "b", "x"]), (9, [])], "key long, w array<string>")
    few, every = within_vocabulary(right, left, "w"), within_vocabulary(right, left, "w", most=10)
    assert [r.key for r in few.collect()] == [7] and every.count() == 3 and within_vocabulary(right, left.limit(0), "w").count() == 0
    assert near_matches(left, few, "key", "w").collect() == near_matches(left, every, "key", "w").collect()


def test_fields_and_return_types_of_odd_sources(spark):
    from pyspark.sql import functions as F

    from loomquery.sources import declarations

    blocks = [(None, "a.py", None), ("", "a.ts", []), ("record R(int A, string? B = 1)", "a.CS", ["A"]), ("struct S {\n  int (*f)(int);\n  return x;\n}", "a.c", ["x"]), ("x {\n  a: 1\n  a: 2", "a", ["a"])]
    got = [r[0] for r in spark.createDataFrame([(i, b, p) for i, (b, p, _) in enumerate(blocks)], "i int, b string, p string").orderBy("i").select(declarations.struct_fields(F.col("b"), F.col("p"))).collect()]
    assert got == [w for _, _, w in blocks]
    signatures = [(None, "a.go", None, None), ("", "a.py", None, None), ("T f()", "a.c", "void | U", "U"), ("func F() (int, error)", "a.go", None, "func"), ("def f(x)", "a.py", None, "def"), ("f(): A | B {", "a.ts", None, None)]
    got = [r[0] for r in spark.createDataFrame([(i, *x[:3]) for i, x in enumerate(signatures)], "i int, s string, p string, d string").orderBy("i").select(declarations.return_type(F.col("s"), F.col("p"), F.col("d"))).collect()]
    assert got == [x[3] for x in signatures]


def test_python_source_parser(spark):
    from loomquery.sources.readers import PythonCalls, PythonSymbols

    spark.udtf.register("python_symbols", PythonSymbols)
    spark.udtf.register("python_calls", PythonCalls)
    spark.createDataFrame([("a.py", "class A:\n    def f(self, x):\n        return g(x)\n"), ("b.py", "def broken(")], "path string, content string").createOrReplaceTempView("src")
    got = spark.sql("select path, name, kind, parent_class from src, lateral python_symbols(content)").collect()
    assert {tuple(r) for r in got} == {("a.py", "A", "class", None), ("a.py", "f", "method", "A")}
    assert [tuple(r) for r in spark.sql("select callee, line from src, lateral python_calls(content)").collect()] == [("g", 3)]


def test_journal_and_log_readers(spark, tmp_path):
    from loomquery.sources import readers

    (tmp_path / "j").write_text('{"status": "x"}\nbroken\n[1]\n')
    assert sorted(r["ok"] for r in readers.read_journal(spark, str(tmp_path / "j")).collect()) == [False, False, True]
    (tmp_path / "log").write_text("commit a1\n\nx.py\ny.py\ncommit b2\n\nx.py\n")
    assert {tuple(r) for r in readers.parse_log(spark, str(tmp_path / "log")).collect()} == {("a1", "x.py"), ("a1", "y.py"), ("b2", "x.py")}


def test_circuit_breaker_stream(spark, tmp_path):
    from loomquery.streaming.state import circuit_breaker

    rows = [("s", i, ok, fp) for i, (ok, fp) in enumerate([(False, "a"), (False, "a"), (False, "b"), (False, "b"), (False, "b"), (True, None)])]
    spark.createDataFrame(rows, "session string, seq long, ok boolean, fingerprint string").coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("session string, seq long, ok boolean, fingerprint string").parquet(str(tmp_path / "in"))
    q = circuit_breaker(stream).writeStream.format("memory").queryName("breaker").option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start()
    q.awaitTermination()
    assert [tuple(r) for r in spark.sql("select streak, tripped from breaker order by seq").collect()] == [(1, False), (2, False), (1, False), (2, False), (3, True), (0, False)]


def test_dedup_stream(spark, tmp_path):
    """Reads of one content in a row are repeats, across batches too; sessions and files are apart."""
    from loomquery.streaming.state import dedup_reads

    schema = "session string, key string, seq long, digest string"
    parts = [[("s", "f", 1, "a"), ("s", "f", 2, "a"), ("s", "g", 3, "a"), ("t", "f", 4, "a")], [("s", "f", 5, "a"), ("s", "f", 6, "b"), ("t", "f", 7, "a"), ("s", "g", 8, "b")]]
    for n, rows in enumerate(parts):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        stream = dedup_reads(spark.readStream.schema(schema).parquet(str(tmp_path / "in")))
        q = stream.writeStream.format("parquet").option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start(str(tmp_path / "out"))
        q.awaitTermination()
    got = {r["seq"]: r["repeat"] for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    assert got == {1: False, 2: True, 3: False, 4: False, 5: True, 6: False, 7: True, 8: False}


def test_snippets(spark):
    import io
    import zipfile

    from pyspark.sql import functions as F

    from loomquery.functions import snippets as S

    assert S.imbalance('f(a[0]) { "}" } // )') is None
    assert S.imbalance("f(\n]") == "2:]" and S.imbalance("a {\n(") == "2:(" and S.imbalance(None) is None
    raw = io.BytesIO()
    with zipfile.ZipFile(raw, "w") as z:
        z.writestr("word/document.xml", "<w:p><w:t>a &lt; b</w:t></w:p><w:p><w:t>c</w:t></w:p>")
    rows = spark.createDataFrame([(raw.getvalue(),), (b"none",), (None,)], "content binary")
    assert [r[0] for r in rows.select(S.docx(F.col("content"))).collect()] == ["a < b\nc", None, None]
    source = "import x from 'a'\nimport 'b'\nconst c = require(\"c\"); import('d')\nimport (\n\t\"fmt\"\n)\nusing Sys.Text;\nimport y from 'a'"
    one = spark.createDataFrame([(source, "The ＴＥＳＴ of 测试-it", "a.b", "abXcd", "abYYcd", "", "aa")], "src string, t string, q string, o string, n string, e string, r string")
    got = one.select(S.import_specs(F.col("src")), S.normal_instruction(F.col("t"), ["the", "of"]), S.text_delta(F.col("o"), F.col("n")), S.text_delta(F.col("e"), F.col("r")), S.text_delta(F.col("r"), F.lit("aaa"))).first()
    assert sorted(got[0]) == ["Sys.Text", "a", "b", "c", "d", "fmt"]
    assert got[1] == ["test", "测", "试", "it"]
    assert tuple(got[2]) == (2, 2, "X", "YY") and tuple(got[3]) == (0, 0, "", "aa") and tuple(got[4]) == (2, 0, "", "a")
    hit = spark.createDataFrame([("a.b $x",)], "t string").select(*[S.has_identifier(F.col("t"), n) for n in ("a", "x", "$x", "a.b")]).first()
    assert tuple(hit) == (True, False, True, True)


def test_salient_lines_of_runs(spark):
    from pyspark.sql import functions as F

    from loomquery.operators.decisions import salient_lines

    rows = [(1, i, x) for i, x in enumerate("E a b E E c E E E d e".split())] + [(2, i, "x") for i in range(30)]
    got = salient_lines(spark.createDataFrame(rows, "key int, no int, line string"), F.col("line") == "E").collect()
    assert sorted(r.no for r in got if r.key == 1) == [0, 1, 3, 4, 6, 7, 8, 9]
    assert sorted(r.no for r in got if r.key == 2) == [*range(8), *range(18, 30)]


def test_search_cut(spark):
    from loomquery.operators.search import search

    rows = [("a.ts", 1, "cancelOrder", "cancelOrder(id)", True), ("b.ts", 2, "orderTotal", None, None), ("c.test.ts", 3, "cancelOrder", "", True), ("d.ts", 4, "zzz", "", False)]
    symbols = spark.createDataFrame(rows, "path string, line int, name string, signature string, exported boolean")
    assert [(r.path, r.name) for r in search(symbols, "how to find cancelOrder").collect()] == [("a.ts", "cancelOrder")]
    assert {r.path for r in search(symbols, "cancel the order", tests=True).collect()} == {"a.ts", "c.test.ts"}
    assert search(symbols, "nothing here").count() == 0 and search(symbols.limit(0), "order").count() == 0


def test_lexical_nulls(spark):
    from pyspark.sql import functions as F

    from loomquery.functions import lexical as L

    df = spark.createDataFrame([(None,), ("",), ("Ties",)], "t string")
    assert [r[0] for r in df.select(L.stem(F.col("t"))).collect()] == [None, "", "tie"]
    assert [r[0] for r in df.select(L.type_references(F.col("t"))).collect()] == [None, [], ["Ties"]]
    assert L.json_shape(None) is None and L.json_shape("{bad") is None and L.json_shape("3") == "(root): 3"
    deep = '{"a": {"b": {"c": {"d": {"e": 1}}}}, "z": [], "s": "' + "x" * 50 + '"}'
    assert L.json_shape(deep).split("\n") == ["        a.b.c.d: {…} [1 keys, depth cap 4]", "  z: [0 items]", '  s: "' + "x" * 40 + '…"']


def test_pdf_and_config(spark, tmp_path):
    import zlib

    from loomquery.functions.snippets import pdf_text
    from loomquery.sources.readers import load_aliases

    packed = zlib.compress(b"BT [(two) -5 (\\(three\\))] TJ ET")
    raw = b"%PDF-1.4\nBT (one) Tj ET\nstream\n" + packed + b"\nendstream stream\nraw\nendstream"
    assert pdf_text(raw) == "one\ntwo (three)" and pdf_text(b"none") is None and pdf_text(None) is None
    (tmp_path / "base.json").write_text('{ // roots\n "compilerOptions": {"baseUrl": "./src", "paths": {"@/*": ["*"], "x": ["a//b"],},}, }')
    (tmp_path / "tsconfig.json").write_text('{"extends": "./base"}')
    assert load_aliases(spark, str(tmp_path / "tsconfig.json")) == [("@/*", ["src/*"]), ("x", ["src/a/b"])]
    (tmp_path / "none.json").write_text("{}")
    assert load_aliases(spark, str(tmp_path / "none.json")) == []


def test_verified_links_quote(spark):
    from loomquery.operators.graph import verified_links

    links = spark.createDataFrame([("s", "p", "a.b", None), ("s", "p", "axb", None)], "section string, path string, name string, parent_class string")
    got = verified_links(links, spark.createDataFrame([("s", "see a.b")], "section string, text string"), spark.createDataFrame([], "path string, name string")).collect()
    assert [r.name for r in got] == ["a.b"]


def test_import_paths(spark):
    from loomquery.operators import resolve

    files = ["x.ts", "a/x.ts", "a/b/x.ts", "a/b/index.ts", "pkg/mod.py", "pkg/sub/__init__.py", "src/lib.py", "src/net/tcp.rs", "src/net/mod.rs", "include/h.h", "a/h.h"]
    cases = {
        ("a/b/c.ts", "../../x"): "x.ts", ("a/b/c.ts", "../x"): "a/x.ts", ("a/b/c.ts", "./x.js"): "a/b/x.ts", ("a/b/c.ts", "."): "a/b/index.ts", ("a/b/c.ts", "../../../x"): None, ("c.ts", "./x"): "x.ts", ("a/b/c.ts", "x"): None,
        ("pkg/sub/m.py", "..mod"): "pkg/mod.py", ("q/m.py", "pkg.mod"): "pkg/mod.py", ("q/m.py", "lib"): "src/lib.py", ("pkg/m.py", ".sub"): "pkg/sub/__init__.py", ("pkg/m.py", "mod"): "pkg/mod.py",
        ("src/net/a.rs", "super::tcp"): "src/net/tcp.rs", ("src/main.rs", "crate::net::tcp"): "src/net/tcp.rs", ("src/main.rs", "crate::net"): "src/net/mod.rs",
        ("a/b/c.c", "../h.h"): "a/h.h", ("z/c.cpp", "h.h"): "include/h.h", ("z/c.cpp", "../../h.h"): None,
    }
    imports = spark.createDataFrame(list(cases), "path string, module string")
    got = {(r["path"], r["module"]): r["target"] for r in resolve.resolve_imports(imports, spark.createDataFrame([(f,) for f in files], "path string")).collect()}
    assert got == cases


def test_closure_of_a_long_chain(spark):
    from loomquery.operators.graph import closure

    chain = spark.createDataFrame([(i, i + 1) for i in range(40)] + [(50, 51), (51, 50)], "child long, parent long")
    got = {(r["child"], r["ancestor"]): r["depth"] for r in closure(chain).collect()}
    assert got == {**{(i, j): j - i for i in range(41) for j in range(i + 1, 41)}, (50, 51): 1, (51, 50): 1}
    assert closure(chain, 4).agg({"depth": "max"}).first()[0] == 4


def test_files_and_logs(spark, tmp_path):
    from loomquery.sources import readers

    for name, text in {"a/b.js": "x", "node_modules/b.js": "x", "node_modules/a/b.js": "x", "src/big.ts": "x" * 300, "src/s.ts": "é"}.items():
        (tmp_path / "w" / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / "w" / name).write_text(text)
    got = {r["path"].split("/w/")[1]: r["content"] for r in readers.read_files(spark, str(tmp_path / "w"), max_bytes=200).collect()}
    assert got == {"a/b.js": "x", "src/s.ts": "é"}
    readers.append_json_lines(spark.createDataFrame([(0, None)], "id int, note string"), str(tmp_path / "log"))
    (tmp_path / "log" / "bad.json").write_text("[1]\n{bad\n\n")
    rows = [(r["raw"], r["ok"]) for r in readers.read_journal(spark, str(tmp_path / "log")).collect()]
    assert sorted(rows) == sorted([('{"id":0,"note":null}', True), ("[1]", False), ("{bad", False)])
    readers.export_graph(spark.createDataFrame([("a",)], "id string"), spark.createDataFrame([("calls", "a", "a")], "kind string, source string, target string"), f"{tmp_path}/g")
    assert spark.read.json(f"{tmp_path}/g/edges").count() == spark.read.json(f"{tmp_path}/g/nodes").count() == 1


def test_receipts_cover_the_text(spark):
    from loomquery.operators.workspace import receipt_pages

    texts = spark.createDataFrame([(1, "abc" * 100), (2, ""), (3, None), (4, "x" * 36)], "id long, text string")
    rows = receipt_pages(texts, 40).orderBy("id", "start").collect()
    for i, text in ((1, "abc" * 100), (2, ""), (3, ""), (4, "x" * 36)):
        pages = [r for r in rows if r["id"] == i]
        assert "".join(p["body"] for p in pages) == text and [p["next"] for p in pages] == [*(p["start"] for p in pages[1:]), None]
    with pytest.raises(ValueError):
        receipt_pages(texts, 39)
