"""The incremental graph equals the full one after random edits, and redoes few files."""

import random

from loomquery.operators import incremental
from loomquery.operators.incremental import Code

PATHS = [f"p{i % 3}/m{i % 2}/f{i}{end}" for i in range(24) for end in ([".ts"], [".py"])[i % 2]]


def _file(rng, path):
    """Symbols, imports, calls and parents of a file, made of few names, so that they meet."""
    symbols = [(path, f"fn{rng.randint(0, 6)}", None, i) for i in range(rng.randint(0, 2))]
    for i in range(rng.randint(0, 2)):
        owner = f"C{rng.randint(0, 5)}"
        symbols += [(path, owner, None, 10 + i), (path, f"m{rng.randint(0, 3)}", owner, 20 + i)]
    parents = [(path, s[1], f"C{rng.randint(0, 5)}") for s in symbols if s[1].startswith("C") and rng.random() < 0.6]
    stems = [p.rsplit(".", 1)[0] for p in PATHS if p.endswith(path[-3:])]
    spelled = (lambda stem: stem.replace("/", ".")) if path.endswith(".py") else (lambda stem: "../../" + stem)
    imports = [(path, spelled(rng.choice(stems)), [f"fn{rng.randint(0, 6)}"]) for _ in range(rng.randint(0, 2))]
    calls = [(path, line, f"symbol:{path}#x" if line % 2 else None, *rng.choice([(f"fn{rng.randint(0, 6)}", None), (f"m{rng.randint(0, 3)}", f"C{rng.randint(0, 5)}")])) for line in range(rng.randint(0, 4))]
    return {"symbols": symbols, "parents": parents, "imports": imports, "calls": calls}


SCHEMAS = {
    "files": "path string, fingerprint string", "symbols": "path string, name string, parent_class string, ordinal int", "imports": "path string, module string, names array<string>",
    "calls": "path string, line int, caller string, callee string, receiver_class string", "parents": "path string, child string, parent string",
}


def _code(spark, files):
    rows = {k: [r for f in files.values() for r in f[k]] for k in SCHEMAS if k != "files"}
    rows["files"] = [(path, str(hash(str(f)))) for path, f in files.items()]
    return Code(**{k: spark.createDataFrame(rows[k], schema) for k, schema in SCHEMAS.items()})


def _graph(state):
    return {tuple(r) for r in incremental.nodes(state).collect()}, {tuple(r) for r in incremental.edges(state).collect()}


def test_random_edits(spark):
    rng = random.Random(11)
    files = {p: _file(rng, p) for p in PATHS[:18]}
    state = incremental.rebuild(_code(spark, files))
    saved = 0
    for step in range(3):
        for _ in range(step % 3 + 1):
            path = rng.choice(PATHS)
            if path in files and rng.random() < 0.4:
                del files[path]
            else:
                files[path] = _file(rng, path)
        code = _code(spark, files)
        saved += len(files) - incremental.dirty_paths(code, state).count()
        state = incremental.rebuild(code, state)
        full = incremental.rebuild(code)
        assert _graph(state) == _graph(full)
        assert {tuple(r) for r in state.edges.collect()} == {tuple(r) for r in full.edges.collect()}
        assert {tuple(r) for r in state.queried.collect()} == {tuple(r) for r in full.queried.collect()}
    assert {k for k, _, _ in _graph(state)[1]} == {"defines", "imports", "calls"} and saved > 5


def _one(symbols=(), parents=(), imports=(), calls=()):
    return {"symbols": list(symbols), "parents": list(parents), "imports": list(imports), "calls": list(calls)}


def test_changes_far_away(spark):
    """A parent class that changes in a third file, an import that a new file with an earlier ending takes over, and a file that goes."""
    files = {
        "a.ts": _one([("a.ts", "go", None, 0)], imports=[("a.ts", "./lib", ["fn"])], calls=[("a.ts", 3, "symbol:a.ts#go", "m", "R"), ("a.ts", 4, None, "fn", None)]),
        "b.ts": _one([("b.ts", "R", None, 0)], [("b.ts", "R", "A")]), "c.ts": _one([("c.ts", "A", None, 0)], [("c.ts", "A", "B")]),
        "d.ts": _one([("d.ts", "B", None, 0), ("d.ts", "m", "B", 1)]), "e.ts": _one([("e.ts", "D", None, 0), ("e.ts", "m", "D", 1)]), "lib.js": _one([("lib.js", "fn", None, 0)]), "z.ts": _one(),
    }
    state = incremental.rebuild(_code(spark, files))
    calls = lambda: {t for k, s, t in _graph(state)[1] if k == "calls"}
    assert calls() == {"symbol:d.ts#B.m", "symbol:lib.js#fn"}
    steps = [
        ({"c.ts": _one([("c.ts", "A", None, 0)], [("c.ts", "A", "D")])}, {"symbol:e.ts#D.m", "symbol:lib.js#fn"}, {"a.ts", "c.ts"}),
        ({"lib.ts": _one([("lib.ts", "fn", None, 0)])}, {"symbol:e.ts#D.m", "symbol:lib.ts#fn"}, {"a.ts", "lib.ts"}),
        ({"e.ts": None}, {"symbol:lib.ts#fn"}, {"a.ts"}),
    ]
    for change, want, dirty in steps:
        files = {p: f for p, f in {**files, **change}.items() if f is not None}
        code = _code(spark, files)
        assert {r[0] for r in incremental.dirty_paths(code, state).collect()} == dirty
        state = incremental.rebuild(code, state)
        assert calls() == want and _graph(state) == _graph(incremental.rebuild(code))
