"""A small code base, already parsed: rows for the resolution queries, for Spark and for SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

SCHEMAS = {
    "files": "path string",
    "symbols": "path string, ordinal int, name string, kind string, exported boolean, first int, last int, params_count int, parent_class string",
    "imports": "path string, module string, names array<string>",
    "calls": "path string, line int, callee string, args_count int, receiver_class string",
    "parents": "child string, parent string",
    "new_symbols": "path string, name string, params_count int",
    "old_fields": "name string, fields array<string>",
    "new_fields": "name string, fields array<string>",
    "commands": "cmd string",
    "names": "a string, b string",
    "macros": "macro string, state string, action string, hash string, saved_hash string",
    "runs": "variant string, success boolean, duration_ms double",
    "outputs": "id int, output string",
    "aliased": "path string, module string",
    "usings": "path string, namespace string",
    "namespaces": "path string, namespace string",
    "reexports": "path string, ordinal int, target string, name string, alias string",
    "wanted": "path string, name string",
    "receivers": "path string, line int, name string, scope int, class string",
    "assignments": "path string, scope int, name string, line int, type string, block int",
    "class_fields": "class string, name string, type string",
    "needed": "path string, name string, uses int",
    "type_files": "path string, ordinal int, name string, kind string",
    "type_imports": "path string, target string, names array<string>, ordinal int",
    "changed": "path string",
    "module_imports": "path string, target string",
    "open_imports": "path string, module string",
    "type_texts": "raw string, type string",
    "sources": "path string, content string",
}
ROWS = {
    "files": [("src/model.ts",), ("src/app.ts",), ("src/util/index.ts",), ("src/ab.ts",), ("py/model.py",), ("py/test_model.py",), ("go/engine.go",), ("go/engine_test.go",), ("dist/app.js",), ("Cargo.lock",), ("cs/OrderTests.cs",), ("src/__tests__/app.spec.ts",)],
    "symbols": [
        ("src/model.ts", 0, "OrderService", "class", True, 1, 20, 0, None), ("src/model.ts", 1, "cancelOrder", "method", False, 3, 9, 2, "OrderService"),
        ("src/model.ts", 2, "audit", "function", True, 22, 30, 1, None), ("src/ab.ts", 0, "A", "class", True, 1, 8, 0, None), ("src/ab.ts", 1, "cancel", "method", False, 2, 5, 0, "A"),
        ("src/ab.ts", 2, "B", "class", True, 10, 18, 0, None), ("src/ab.ts", 3, "cancel", "method", False, 12, 15, 0, "B"), ("src/ab.ts", 4, "C", "class", True, 20, 24, 0, None),
        ("src/util/index.ts", 0, "format", "function", True, 1, 4, 1, None), ("py/model.py", 0, "cancel_order", "function", True, 1, 6, 2, None),
        ("go/engine.go", 0, "Run", "function", True, 1, 9, 1, None), ("go/engine.go", 1, "audit", "function", True, 11, 15, 1, None), ("src/app.ts", 0, "main", "function", True, 1, 12, 0, None), ("src/app.ts", 1, "inner", "function", False, 4, 6, 0, None),
    ],
    "imports": [("src/app.ts", "./model", ["OrderService", "audit"]), ("src/app.ts", "./util", ["format"]), ("src/app.ts", "./missing", ["gone"]), ("src/app.ts", "react", ["React"]), ("src/__tests__/app.spec.ts", "../app", ["main"]), ("src/ab.ts", "./util", ["format"])],
    "calls": [
        ("src/app.ts", 2, "cancelOrder", 2, "OrderService"), ("src/app.ts", 5, "audit", 1, None), ("src/app.ts", 7, "format", 1, None), ("src/app.ts", 8, "inner", 0, None), ("src/app.ts", 9, "cancel", 0, "C"),
        ("src/__tests__/app.spec.ts", 3, "main", 0, None), ("go/engine_test.go", 4, "Run", 1, None), ("py/test_model.py", 6, "cancel_order", 3, None), ("src/ab.ts", 4, "format", 1, None), ("src/app.ts", 11, "nowhere", 0, None),
    ],
    "parents": [("C", "B"), ("D", "C"), ("X", "Y"), ("Y", "X")],
    "new_symbols": [("src/model.ts", "OrderService", 0), ("src/model.ts", "cancelOrder", 1), ("src/util/index.ts", "format", 2), ("py/model.py", "cancel_order", 2)],
    "old_fields": [("Order", ["id", "total", "note"]), ("Line", ["qty"])],
    "new_fields": [("Order", ["id", "total"]), ("Line", ["qty", "price"])],
    "commands": [("npx vitest run src/a.test.ts",), ("npx vitest run src/b.test.ts",), ("git status",), ("ls -la",), ("cargo run",), ("curl http://x/y.json",), ("node scripts/tool.cjs src/a.ts",), ("make",), ("npm run dev &",)],
    "names": [("cancle", "cancel"), ("ordrs", "orders"), ("cat", "cut"), ("order", "border"), ("total", "total"), ("format", "fromat"), ("amount", "account")],
    "macros": [("m1", "discovered", "propose", "h", "h"), ("m2", "approved", "activate", "h", "x"), ("m3", "active", "revoke", "h", "h"), ("m4", "proposed", "revoke", "h", "h")],
    "runs": [("base", True, 100.0), ("base", False, 300.0), ("base", True, 200.0), ("tool", True, 50.0), ("tool", True, 70.0)],
    "outputs": [(1, "PASS\n3 passed"), (2, "FAIL [exit=1]\nFAIL adds items\nError: bad\n  at run (src/a.ts:3:4)"), (3, "TIMEOUT after 5 s"), (4, "NONE [affected-tests]"), (5, "hello")],
    "aliased": [("src/app.ts", "@/util"), ("src/app.ts", "@/model"), ("src/app.ts", "@lib"), ("src/ab.ts", "~x/none"), ("src/ab.ts", "react"), ("src/ab.ts", "py:model:it")],
    "usings": [("cs/a/Main.cs", "Demo.Core"), ("cs/a/Main.cs", "Demo.Util"), ("cs/b/Other.cs", "Demo.Core"), ("cs/b/Other.cs", "System.Text"), ("cs/b/Other.cs", "Lib.Main")],
    "namespaces": [("cs/a/Core.cs", "Demo.Core"), ("cs/b/Core2.cs", "Demo.Core"), ("cs/a/Main.cs", "Demo"), ("cs/b/Util.cs", "Tools"), ("cs/b/Other.cs", "Other")],
    "reexports": [
        ("lib/index.ts", 0, "src/model.ts", "OrderService", "Orders"), ("lib/index.ts", 1, "lib/all.ts", None, None), ("lib/all.ts", 0, "src/util/index.ts", None, None), ("lib/all.ts", 1, "src/ab.ts", None, None),
        ("lib/index.ts", 2, "src/model.ts", "audit", "audit"), ("lib/loop.ts", 0, "lib/pool.ts", None, None), ("lib/pool.ts", 0, "lib/loop.ts", None, None), ("lib/all.ts", 2, "src/app.ts", None, None),
    ],
    "wanted": [("lib/index.ts", "Orders"), ("lib/index.ts", "format"), ("lib/index.ts", "audit"), ("lib/index.ts", "cancel"), ("lib/loop.ts", "format"), ("src/ab.ts", "A"), ("lib/index.ts", "nothing")],
    "receivers": [("a.ts", 5, "x", 1, "C"), ("a.ts", 9, "x", 1, "C"), ("a.ts", 9, "this", 1, "C"), ("a.ts", 9, "super", 1, "C"), ("a.ts", 9, "store", 1, "C"), ("a.ts", 9, "glob", 1, "C"), ("a.ts", 9, "Order", 1, "C"), ("a.ts", 9, "nope", 1, "C"), ("a.ts", 9, "y", 1, "C"), ("a.ts", 2, "x", 1, "C")],
    "assignments": [("a.ts", 1, "x", 3, "A", 1), ("a.ts", 1, "x", 7, "B", 1), ("a.ts", 1, "x", 11, "D", 1), ("a.ts", 1, "y", 4, "A", 1), ("a.ts", 1, "y", 6, "B", 2), ("a.ts", 0, "glob", 1, "G", 0), ("a.ts", 0, "y", 1, "G", 0)],
    "class_fields": [("C", "store", "Store"), ("C", "x", "Never")],
    "needed": [("src/app.ts", "Order", 3), ("src/app.ts", "Line", 5), ("src/app.ts", "Total", 5), ("src/app.ts", "Own", 1), ("src/app.ts", "Lost", 9)],
    "type_files": [("src/app.ts", 0, "Own", "class"), ("src/model.ts", 0, "Order", "class"), ("src/model.ts", 1, "Total", "type"), ("lib/z.ts", 0, "Order", "class"), ("lib/z.ts", 1, "Line", "interface"), ("src/q.ts", 0, "Line", "interface"), ("src/q.ts", 1, "Lost", "function"), ("lib/a.ts", 0, "Own", "class")],
    "type_imports": [("src/app.ts", "lib/z.ts", ["Order"], 0), ("src/app.ts", "src/model.ts", ["*"], 1)],
    "changed": [("src/model.ts",), ("go/engine.go",)],
    "module_imports": [("src/app.ts", "src/model.ts"), ("src/__tests__/app.spec.ts", "src/app.ts"), ("src/ab.ts", "src/util/index.ts"), ("py/test_model.py", "py/model.py")],
    "open_imports": [("src/ab.ts", "pkg/model"), ("cs/OrderTests.cs", "Demo.engine"), ("src/ab.ts", "react")],
    "type_texts": [
        ("readonly Order[]", "Order"), ("Promise<Order | null>", None), ("Map<string, Order>", "string"), ("Order | Line", None), ("Order?", "Order"), ("&mut Engine", "Engine"), ("const std::Engine", "Engine"),
        ("List[app.Order]", "Order"), ("(Order)", "Order"), ("", None), (None, None), ("Order | undefined", "Order"), ("12", None), ("Dict[str, List[int]]", "str"), ("Array<Map<A, B>>", "A"),
    ],
    "sources": [
        ("a.ts", 'import x from "y";\n// class Fake {}\nexport class Order extends Base {\n  constructor(a, b) { this.t = a; }\n  async cancel(id: string, opts = {a: 1, b: [1, 2]}): Promise<void> {\n    if (id) { return this.store.drop(id, "f(x, y)"); }\n  }\n}\nexport const add = (a: number, b: number): number => a + b;\n'),
        ("b.go", "package x\ntype Engine struct { n int }\nfunc (e *Engine) Run(a int, b string) error {\n\treturn e.start(a)\n}\nfunc helper() {}\n"),
        ("c.rs", "pub struct Order<'a> { id: &'a str }\nimpl<'a> Order<'a> {\n    pub fn cancel(&self, x: i32) -> bool { helper('c', \"}\") }\n}\nfn helper(a: char, b: &str) -> bool { true }\n"),
        ("d.cpp", "struct P { int a; };\nint main(int argc, char **argv) { printf(\"hi %d\", argc); return 0; }\nvoid P::go(int a) { main(1, 0); }\n"),
        ("e.cs", "namespace A { public class B : C {\n  public async Task<int> Go(int a, List<int> b) { return await Do(a); }\n  private void Do(int a) => Console.WriteLine(a);\n} }"),
        ("f.txt", "class None {}"), ("g.ts", None), ("h.js", "}}}((("),
    ],
}


def frame(spark: SparkSession, name: str) -> DataFrame:
    return spark.createDataFrame(ROWS[name], SCHEMAS[name])


def _literal(x) -> str:
    if x is None:
        return "NULL"
    if isinstance(x, bool):
        return str(x).upper()
    if isinstance(x, list):
        return "[" + ", ".join(map(_literal, x)) + "]"
    return "'" + x.replace("'", "''") + "'" if isinstance(x, str) else repr(x)


def cte(*names: str) -> str:
    """``name AS (VALUES ...)`` for SQL, to follow WITH."""
    out = []
    for name in names:
        columns = ", ".join(c.split()[0] for c in SCHEMAS[name].split(", "))
        rows = ", ".join("(" + ", ".join(map(_literal, r)) + ")" for r in ROWS[name])
        out.append(f"{name} AS (SELECT * FROM (VALUES {rows}) t({columns}))")
    return ",\n".join(out)
