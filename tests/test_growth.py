"""Plans whose intermediate rows must grow with the input, not with its square: the most rows that any step gives, and the results by direct computation."""

import random
import re
from collections import Counter

import pandas as pd
from pyspark.sql import functions as F

from loomquery.operators import decisions, doclinks, incremental, lookup, mining, resolve, search, sessions
from loomquery.plans import edits, graphs
from loomquery.plans import lookup as plans
from loomquery.sources import declarations


def most_rows(spark, frame, counted="number of output rows"):
    """(rows, the largest number of rows that a step of the plan gave)."""
    rows = frame.collect()
    store = spark._jsparkSession.sharedState().statusStore()
    spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty()
    runs = store.executionsList()
    last = max((runs.apply(i) for i in range(runs.size())), key=lambda e: e.executionId())
    values, most = store.executionMetrics(last.executionId()), 0
    for i in range(last.metrics().size()):
        metric = last.metrics().apply(i)
        value = values.get(metric.accumulatorId())
        if metric.name() == counted and value.isDefined():
            most = max(most, int(value.get().replace(",", "")))
    return rows, most


def test_resolve_calls_of_a_common_name(spark):
    """A name that 400 files declare and 400 lines call, by each of the stages."""
    n = 400
    files = [f"a{i}.ts" for i in range(n)]
    symbols = [(f, "run", None) for f in files] + [("pkg/x.go", "only", None), ("pkg/y.go", "two", None), ("other/z.go", "two", None), ("b.ts", "alone", None), ("b.ts", "run", "C")]
    calls = [(f"c{i}.ts", i, "run", None) for i in range(n)] + [(f, 1, "run", None) for f in files[:3]]
    calls += [("pkg/w.go", 1, "only", None), ("pkg/w.go", 1, "two", None), ("c0.ts", 9, "alone", None), ("c0.ts", 8, "alone", None), ("c0.ts", 8, "alone", None), ("c0.py", 1, "alone", None), ("c0.ts", 7, "run", "C"), ("c1.ts", 3, None, None)]
    imports = [("c0.ts", "a5.ts", ["run"]), ("c0.ts", "a3.ts", ["other", "run"]), ("c1.ts", None, ["run"]), ("c2.ts", "x.py", ["run"]), ("c3.ts", "a7.ts", ["walk"])]
    out = resolve.resolve_calls(
        spark.createDataFrame(calls, "path string, line int, callee string, receiver_class string"), spark.createDataFrame(symbols, "path string, name string, parent_class string"),
        spark.createDataFrame(imports, "path string, target string, names array<string>"),
    )
    rows, most = most_rows(spark, out)
    want = [(f"c{i}.ts", i, "run", "a3.ts" if i == 0 else None, 0.95 if i == 0 else 0.0) for i in range(n)] + [(f, 1, "run", f, 0.9) for f in files[:3]]
    want += [("pkg/w.go", 1, "only", "pkg/x.go", 0.8), ("pkg/w.go", 1, "two", "pkg/y.go", 0.8), ("c0.ts", 9, "alone", "b.ts", 0.6), *[("c0.ts", 8, "alone", None, 0.0)] * 2, ("c0.py", 1, "alone", None, 0.0), ("c1.ts", 3, None, None, 0.0)]
    assert sorted(map(str, map(tuple, rows))) == sorted(map(str, want))
    assert most < 10 * n


def test_resolve_methods_of_a_common_member(spark):
    """A member that 400 files declare for one class and 400 lines call on it and on its heir."""
    n = 400
    symbols = [(f"a{i:03}.ts", "m", "Base", 0) for i in range(n)] + [("h.ts", "k", "Heir", 0), ("h.ts", "Heir", None, 1)]
    calls = [(f"c{i}.ts", i, "m", "Heir" if i % 2 else "Base") for i in range(n)] + [("a007.ts", 1, "m", "Heir"), ("c0.ts", 5, "k", "Heir"), ("c0.ts", 6, "none", "Heir"), ("c0.ts", 7, "m", None), ("c0.ts", 8, "m", "Far")]
    out = resolve.resolve_methods(
        spark.createDataFrame(calls, "path string, line int, callee string, receiver_class string"), spark.createDataFrame(symbols, "path string, name string, parent_class string, ordinal int"),
        spark.createDataFrame([("Heir", "Base", 1), ("Far", "Heir", 1), ("Far", "Base", 2)], "child string, ancestor string, depth int"),
    )
    rows, most = most_rows(spark, out)
    want = {(f"c{i}.ts", i, "m", "Base", "a000.ts", 0.9 if i % 2 else 0.95) for i in range(n)}
    want |= {("a007.ts", 1, "m", "Base", "a007.ts", 0.9), ("c0.ts", 5, "k", "Heir", "h.ts", 0.95), ("c0.ts", 8, "m", "Base", "a000.ts", 0.9)}
    assert {tuple(r) for r in rows} == want and len(rows) == len(want)
    assert most < 10 * n


def test_resolve_imports_once_a_folder(spark):
    """300 files of a folder import the same three modules: their candidates are tried once."""
    n = 300
    imports = [(f"src/a/f{i}.ts", m) for i in range(n) for m in ("./b.js", "../c//d", "../../../far")] + [("x.py", "..m"), ("src/p.py", ".q"), ("p.rs", "crate::a::b"), (None, "./b"), ("src/a/y.ts", None), ("src/a/z.PY", "./b.js")]
    files = spark.createDataFrame([(p,) for p in ("src/a/b.ts", "src/a/b.js", "src/c/d/index.ts", "src/q/__init__.py", "src/a/b.rs", "far.ts")], "path string")
    rows, most = most_rows(spark, resolve.resolve_imports(spark.createDataFrame(imports, "path string, module string"), files))
    found = {"./b.js": "src/a/b.js", "../c//d": "src/c/d/index.ts", ".q": "src/q/__init__.py", "crate::a::b": "src/a/b.rs"}
    assert {tuple(r) for r in rows} == {(p, m, found.get(m) if p else None) for p, m in imports} and len(rows) == len(imports)
    assert most <= len(imports) + 10


def test_concept_scores_meet_shared_tokens_only(spark):
    """40 symbols and 400 sections of 20 out of 100 words: no step gives more rows than there are shared tokens of pairs."""
    rng = random.Random(3)
    side = lambda keys: [(k, f"w{i}", 1.0) for k in range(keys) for i in rng.sample(range(100), 20)]
    symbols, sections = side(40), side(400)
    frame = lambda rows: spark.createDataFrame(rows, "key long, token string, weight double")
    by_token = {}
    for _, token, _ in sections:
        by_token[token] = by_token.get(token, 0) + 1
    rows, most = most_rows(spark, doclinks.concept_scores(frame(symbols), frame(sections)).drop("shared"))
    assert rows and most <= sum(by_token.get(token, 0) for _, token, _ in symbols)


def test_receiver_types_without_broadcasts(spark):
    """Each table grows with the code, so none goes through the driver, however small its files look; a source text is read once for all of its tables."""
    files = spark.createDataFrame([(f"f{i}.py", f"class K{i}:\n    def run(self, p: P{i}):\n        p.a()\n        self.d()\n") for i in range(5)], "path string, content string")
    found = declarations.parse(files, once=True)
    calls = found["calls"].select("path", "line", F.col("receiver").alias("name"), "scope", F.col("owner").alias("class"))
    fields = found["fields"].select(F.col("owner").alias("class"), "name", "type")
    out = lookup.receiver_types(calls, found["bindings"], fields, found["parents"].select("child", F.col("base").alias("parent")), found["symbols"].select("path", "name"))
    assert {tuple(r) for r in out.select("path", "name", "type").collect()} == {x for i in range(5) for x in ((f"f{i}.py", "p", f"P{i}"), (f"f{i}.py", "self", f"K{i}"))}
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "Broadcast" not in plan and "PythonUDTF" not in plan


def test_enclosing_keeps_points_single(spark):
    """2,000 points in spans of all lengths, crossing and apart: no step multiplies the points."""
    rng = random.Random(5)
    spans = [("f", f"s{i}", a, a + rng.choice([0, 1, 7, 100, 4000, 60000]), i) for i, a in enumerate(rng.sample(range(-500, 100_000), 40))] + [(None, "none", 0, 10**6, 90), ("g", "back", 5, 2, 91), ("f", None, 300_000, 300_009, 92)]
    points = [("f", rng.randrange(-1000, 200_000)) for _ in range(2000)] + [("f", 5), ("f", 5), ("f", None), (None, 5), ("g", 3), ("f", 300_003)] + [("f", x + d) for _, _, a, b, _ in spans for x in (a, b) for d in (-1, 0, 1)]
    out = resolve.enclosing(spark.createDataFrame(points, "path string, point long"), spark.createDataFrame(spans, "path string, name string, first long, last long, ordinal int"))
    rows, most = most_rows(spark, out)
    around = lambda p, x: min(((b - a, o, n) for f, n, a, b, o in spans if None not in (f, x) and f == p and a <= x <= b), default=(0, 0, None))[2]
    assert sorted(map(str, map(tuple, rows))) == sorted(str((p, x, around(p, x))) for p, x in points)
    assert most < 2 * len(points)


def test_resolve_calls_in_one_shuffle(spark):
    """Calls pass one shuffle with what is known of their names, keep their callers, and leave out stages below the least confidence."""
    calls = spark.createDataFrame([("a.ts", 1, "f", None, "x"), ("a.ts", 1, "f", None, "y"), ("a.ts", 2, "g", None, "x"), ("a.ts", 3, "h", None, None)], "path string, line int, callee string, receiver_class string, caller string")
    symbols = spark.createDataFrame([("b.ts", "f", None), ("b.ts", "g", None), ("a.ts", "h", None)], "path string, name string, parent_class string")
    out = resolve.resolve_calls(calls, symbols, spark.createDataFrame([("a.ts", "b.ts", ["f"])], "path string, target string, names array<string>"), least=0.75, keep=("caller",))
    assert {tuple(r) for r in out.collect()} == {("a.ts", 1, "f", "b.ts", 0.95, "x"), ("a.ts", 1, "f", "b.ts", 0.95, "y"), ("a.ts", 2, "g", None, 0.0, "x"), ("a.ts", 3, "h", "a.ts", 0.9, None)}
    plan = out._jdf.queryExecution().sparkPlan().toString()
    assert plan.count("line#") and "Join LeftOuter" not in plan


def shuffled_rows(spark, frame):
    """(rows, the largest number of rows that a shuffle of the plan took)."""
    return most_rows(spark, frame, "shuffle records written")


def test_pmi_shuffles_no_pairs(spark):
    """40 windows of 30 and 30 tokens are 36,000 pairs, of which none is shuffled."""
    rng = random.Random(2)
    windows = [(i, [f"z{t}" for t in rng.sample(range(600), 30)], [f"e{t}" for t in rng.sample(range(900), 30)]) for i in range(40)]
    rows, most = shuffled_rows(spark, mining.pmi(spark.createDataFrame(windows, "w long, l array<string>, r array<string>"), "w", "l", "r"))
    assert rows and most < 5000


def test_bridge_links_rows_by_letters(spark):
    """A name of 200 letters gives as many rows, not a row for each of its pieces; tokens of any length are found."""
    n = "abcdefghij" * 20
    names = spark.createDataFrame([("s", n), ("t", "x-" + n[:50]), ("u", "abc"), ("v", None)], "symbol string, name string")
    tokens = [(k, t) for k in range(3) for t in ("abcd", "bcdefg", n[3:120], "zzzz", "abcx", "ab1c")]
    own = spark.createDataFrame([("t", "abcd")], "symbol string, token string")
    rows, most = most_rows(spark, lookup.bridge_links(names, spark.createDataFrame(tokens, "key int, token string"), own))
    assert sorted(map(tuple, rows)) == sorted((s, k, t) for k in range(3) for s, t in (("s", "abcd"), ("s", "bcdefg"), ("s", n[3:120]), ("t", "bcdefg")))
    assert most < 400


def test_basket_hints_make_no_other_pairs(spark):
    """Baskets of 60 edited items and one that is not: 60 pairs each, not 1,830."""
    rows = [(b, i) for b in range(3) for i in range(60)] + [(0, 100), (1, 100), (2, 101)]
    out, most = most_rows(spark, lookup.basket_hints(spark.createDataFrame(rows, "basket int, item int"), spark.createDataFrame([(i,) for i in range(60)], "path int")))
    assert {tuple(r) for r in out} == {(i, 100, 2) for i in range(60)} and most < 400


def test_equal_blocks_are_read_once(monkeypatch):
    read = []
    monkeypatch.setattr(declarations, "fields_of", lambda b, p, f=declarations.fields_of: read.append(p) or f(b, p))
    blocks = pd.Series(["type K struct {\n\ta string\n}", None, "class K:\n    a: int\n"] * 50)
    out = declarations.fields_of_each(blocks, pd.Series(["a.go", "b.go", None] * 50))
    assert len(read) == 3 and out.tolist()[:2] == [["a"], None]


def test_search_scores_a_symbol_once(spark):
    """The query's words are no work of each symbol, and a symbol's own words and stems are worked out once, by 7 expressions with patterns."""
    symbols = [("a.ts", 1, "cancel_all_orders", "f(rod, bolts)", True), ("b.ts", 2, "Ordre", "cancel", None), ("c.ts", 3, None, "cancel rod", True)]
    symbols += [("cancel/rod.ts", 4, "bolted_rods", None, False), ("d.ts", 5, "a_rod_bolt_cancel_order_widget_cold", "rod bolt cancel order widget cold", False)]
    frame = spark.createDataFrame(symbols, "path string, line int, name string, signature string, exported boolean")
    out = search.search(frame, "cancelled orders with cancel, widget, order, rod, bolt, cold", top=9)
    assert [(r.line, r.score) for r in out.collect()] == [(5, 134), (1, 110), (4, 102), (2, 10)]
    plan = out._jdf.queryExecution().optimizedPlan()
    assert len(search_patterns(plan)) <= 10


def search_patterns(plan):
    """Names of the expressions with patterns anywhere in a plan."""
    found, stack = [], [plan]
    while stack:
        node = stack.pop()
        found += [w for w in node.verboseStringWithSuffix(100_000).replace("(", " ").split() if w.startswith("regexp_")]
        stack += [node.children().apply(i) for i in range(node.children().size())]
    return found


def test_merged_pairs_in_places_by_rows(spark, monkeypatch):
    """Rows meet in one shuffle, not in three and after hash tables of all pairs of a file's part, and in more places the more rows there are."""
    plan = plans.merged_pairs(spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1 and "HashAggregate" not in plan[plan.index("Exchange hashpartitioning") :]
    monkeypatch.setattr(sessions, "PLACE_ROWS", 100)
    rng = random.Random(4)
    item = lambda: rng.choice([None, *range(9)])
    sides = [[(item(), item()) for _ in range(n)] for n in (900, 300)]
    counts, want = [Counter(side) for side in sides], {}
    for (a, b), n in [x for c in counts for x in c.items()]:
        pair = sorted(x if x is not None else y for x, y in ((a, b), (b, a))) if a is not None or b is not None else [None, None]
        want[tuple(pair)] = max(n, want.get(tuple(pair), 0))
    out = sessions.merged_pairs(*(spark.createDataFrame(side, "a int, b int") for side in sides))
    rows = [tuple(r) for r in out.collect()]
    assert {(a, b): n for a, b, n in rows} == want and len(rows) == len(want)
    assert out.rdd.getNumPartitions() == 13


def test_step_blocks_shuffle_no_lines(spark, monkeypatch):
    """Orders go to their places and become lines there, sorted once before the groups, in more places the more lines there are."""
    plan = edits.step_blocks(spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1 and plan.index("Generate") < plan.index("Exchange") and plan.count("Sort [") == 1
    monkeypatch.setattr(decisions, "PLACE_LINES", 1000)
    orders = spark.read.parquet("/root/testdata/sf0.001/orders.parquet").count()
    assert edits.step_blocks(spark, "/root/testdata/sf0.001").rdd.getNumPartitions() == 8 * orders // 1000 + 1


def test_step_blocks_by_hand(spark):
    text = "early\n\n[exit=9]\n## step a\n\none\n\ntwo\n\n[exit=1]\nmore\n \n[exit=-2]\nlast\n## step b\n## step c\n[exit=]\n\n".split("\n")
    rows = [(k, n, x) for k in (1, 2) for n, x in enumerate(text)] + [(3, 0, None), (3, 1, " "), (1, 90, None)]
    out = decisions.step_blocks(spark.createDataFrame(rows, "key int, no int, line string"))
    want = [(0, None, "", "", "early\n[exit=9]"), (1, "## step a", "[exit=-2]", "one\n\ntwo", "more\nlast"), (2, "## step b", "", "", ""), (3, "## step c", "", "[exit=]", "")]
    assert sorted((tuple(r) for r in out.select("key", "step", "header", "exit_line", "output", "extra").collect()), key=lambda r: r[:2]) == [(k, *w) for k in (1, 2) for w in want]


def test_full_edges_in_parts_without_broadcasts(spark):
    """Files and symbols grow with the code, so none of them goes through the driver; calls are resolved in plans of their own, not in one with all edges."""
    code = graphs._code(spark, "/root/testdata/sf0.001", 1)
    for out in (incremental.full_edges(code), resolve.resolve_imports(code.imports, code.files)):
        plan = out._jdf.queryExecution().executedPlan().toString()
        assert "Broadcast" not in plan and "Window" not in plan


def test_callers_in_files_that_are_gone(spark):
    """A call is an edge only if its file is known, whichever caller it names."""
    frame = spark.createDataFrame
    calls = [("a.ts", 1, "symbol:a.ts#f", "g", None), ("gone.ts", 1, "symbol:a.ts#f", "h", None), ("gone.ts", 2, None, "h", None), ("a.ts", 3, "file:gone.ts", "g", None), ("a.ts", 4, None, "g", None)]
    code = incremental.Code(
        frame([("a.ts", "1")], "path string, fingerprint string"), frame([("a.ts", "f", None, 0), ("a.ts", "g", None, 1), ("gone.ts", "h", None, 0)], "path string, name string, parent_class string, ordinal int"),
        frame([("gone.ts", "./a", ["g"])], "path string, module string, names array<string>"), frame(calls, "path string, line int, caller string, callee string, receiver_class string"), frame([], "path string, child string, parent string"),
    )
    g = "symbol:a.ts#g"
    want = {("defines", "file:a.ts", "symbol:a.ts#f"), ("defines", "file:a.ts", g), ("calls", "symbol:a.ts#f", g), ("calls", "file:a.ts", g)}
    assert {tuple(r) for r in incremental.full_edges(code).collect()} == want == {tuple(r) for r in incremental.edges(incremental.rebuild(code)).collect()}


def test_candidates_in_known_folders_only(spark, monkeypatch):
    """300 modules with four candidates each, of which one is in a folder that has such files: the others are not shuffled, and change nothing."""
    n = 300
    imports = spark.createDataFrame([("src/a/x.c", f"g{i}.h") for i in range(n)], "path string, module string")
    files = spark.createDataFrame([(f"src/a/g{i}.h",) for i in range(0, n, 2)] + [("lib/b.c",), (None,)], "path string")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)  # as with tables of size
    try:
        rows, most = shuffled_rows(spark, resolve.resolve_imports(imports, files))
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    want = {("src/a/x.c", f"g{i}.h", None if i % 2 else f"src/a/g{i}.h") for i in range(n)}
    assert {tuple(r) for r in rows} == want and most <= n
    monkeypatch.setattr(resolve, "MOST_FOLDERS", 1)
    assert {tuple(r) for r in resolve.resolve_imports(imports, files).collect()} == want


def test_candidates_of_odd_modules(spark):
    """Modules that climb, stay and repeat slashes, by hand."""
    rng = random.Random(8)

    def normal(*parts):
        out = []
        for x in "/".join(parts).split("/"):
            if x == ".." and out and out[-1] != "..":
                out.pop()
            elif x not in ("", "."):
                out.append(x)
        return "/".join(out)

    def tried(folder, ending, module):
        plain = module.lstrip(".")
        dots, dotted, crate = len(module) - len(plain), plain.replace(".", "/"), re.sub("^(crate|super|self)::", "", module).replace("::", "/")
        near = normal(folder, module)
        bare = re.sub(r"\.(js|mjs|cjs)$", "", near, flags=re.IGNORECASE)
        if ending == ".py":
            own = normal(folder, "../" * (dots - 1), dotted)
            found = [own + ".py", own + "/__init__.py"] if dots else [f"{folder}/{dotted}.py" if folder else f"{dotted}.py", f"{dotted}.py", f"src/{dotted}.py", f"{dotted}/__init__.py"] if dotted else []
        elif ending == ".rs":
            found = [f"{normal(folder, crate)}.rs", f"src/{crate}.rs", f"{crate}.rs", f"src/{crate}/mod.rs"]
        elif ending == ".c":
            found = [near, normal(module), normal("include", module), normal("src", module)]
        else:
            found = [near] + [bare + x for x in resolve.TRIED[1:]] if module.startswith(".") else []
        return [x for x in found if not x.startswith("..")]

    part = lambda: rng.choice(["a", "b", "..", ".", "", "x.js", "a.b", "..x", "é"])
    specs = ["".join(rng.choice(["./", "../", "", "/"]) for _ in range(3)) + "/".join(part() for _ in range(rng.randint(0, 3))) for _ in range(150)]
    specs += ["." * rng.randint(0, 3) + ".".join(rng.choice(["a", "b", ""]) for _ in range(3)) for _ in range(40)] + ["crate::a::b", "super::super::c", "self::..::d", "::e", "./x.MJS", ".", ".."]
    places = sorted({(rng.choice(["", "a", "src/a", "é/b/c", "a/../b"]), rng.choice([".py", ".rs", ".c", ".ts", ""]), m) for m in specs for _ in range(2)})
    got = {}
    for *place, prio, candidate in sorted(map(tuple, resolve.import_candidates(spark.createDataFrame(places, "folder string, ending string, module string")).collect())):
        got.setdefault(tuple(place), []).append(candidate)
    assert {p: got.get(p, []) for p in places} == {p: tried(*p) for p in places}
