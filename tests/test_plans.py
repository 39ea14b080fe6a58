"""Operators that were given linear plans, against brute force; cases that used to be cut off."""

import random
import time

from pyspark.sql import functions as F

from loomquery.functions import text as T
from loomquery.operators import lookup, resolve, retrieval, workspace


def test_enclosing_spans_that_cross(spark):
    rng = random.Random(4)
    spans = [(rng.choice("ab"), f"s{i}", a, a + rng.choice([0, 1, 5, 40, 300]), i) for i in range(120) for a in [rng.randint(-20, 200)]]
    spans += [("a", "back", 50, 40, 900), (None, "n", 0, 9, 901), ("a", None, None, 5, 902), ("b", "twin", 7, 9, 903), ("b", "twin2", 7, 9, 904)]
    points = [(rng.choice("abc"), rng.randint(-30, 520)) for _ in range(400)] + [("a", None), (None, 3), ("b", 8), ("b", 8)]
    got = resolve.enclosing(spark.createDataFrame(points, "path string, point long"), spark.createDataFrame(spans, "path string, name string, first long, last long, ordinal int"))

    def best(path, point):
        around = [(b - a, o, n) for p, n, a, b, o in spans if p == path and p and point is not None and a is not None and a <= point <= b]
        return min(around)[2] if around else None

    assert sorted(map(tuple, got.collect()), key=str) == sorted(((p, x, best(p, x)) for p, x in points), key=str)
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert "Join" in plan and not any(line for line in plan.split("\n") if "Join" in line and (">=" in line or "<=" in line))


def test_last_assignment_by_brute_force(spark):
    rng = random.Random(5)
    sets = [(rng.choice("fg"), rng.randint(0, 2), rng.choice("xy"), rng.randint(1, 30), rng.choice(["A", "B", None]), rng.randint(0, 2)) for _ in range(80)]
    uses = [(rng.choice("fgh"), rng.randint(0, 2), rng.choice("xy"), rng.randint(1, 32)) for _ in range(120)]
    got = lookup.last_assignment(spark.createDataFrame(uses, "path string, scope int, name string, line int"), spark.createDataFrame(sets, "path string, scope int, name string, line int, type string, block int"))
    want = set()
    for use in set(uses):
        before = [s for s in sets if s[:3] == use[:3] and s[3] < use[3]]
        last = max((s[3] for s in before), default=None)
        kinds = {s[4] for s in before if s[4]}
        known = max((s[4] or "" for s in before if s[3] == last), default="") or None
        want.add((*use, bool(before), known if len(kinds) <= 1 or len({s[5] for s in before}) <= 1 else None))
    assert {tuple(r) for r in got.collect()} == want and got.count() == len(want)
    assert "Join" not in got._jdf.queryExecution().optimizedPlan().toString()


def test_long_tokens_inside_names(spark):
    """Tokens of 4 to 100 letters, some that differ only after their first 64."""
    long_, other = "ab" * 33, "ab" * 32 + "zz"
    names = [("s1", f"x.{long_}Q"), ("s2", f"{other}1"), ("s3", "abcd_efgh"), ("s4", "q" * 100)]
    posts = spark.createDataFrame([(1, t) for t in (long_, other, "cdef", "abc", "q" * 100, "q" * 64, "q" * 65)], "key int, token string")
    own = spark.createDataFrame([("s4", "q" * 64)], "symbol string, token string")
    got = {(r["symbol"], r["token"]) for r in lookup.bridge_links(spark.createDataFrame(names, "symbol string, name string"), posts, own).collect()}
    assert got == {("s1", long_), ("s2", other), ("s3", "cdef"), ("s4", "q" * 100), ("s4", "q" * 65)}


def test_chains_of_links_take_few_rounds(spark):
    """A chain of links that wait for each other, by rounds alone, in one task, and in order by hand."""
    rng = random.Random(6)
    chain = [(i // 2, (i + 1) // 2, 1000.0 - i) for i in range(60)]
    wild = [(rng.randint(100, 120), rng.randint(100, 120), float(rng.randint(1, 9))) for _ in range(150)]
    links = spark.createDataFrame(chain + wild, "query long, section long, score double")
    best, room = {}, {}
    for q, s, x in chain + wild:
        best[q, s] = max(x, best.get((q, s), 0))
    want = set()
    for (q, s), x in sorted(best.items(), key=lambda e: (-e[1], e[0])):
        if room.get(("q", q), 0) < 1 and room.get(("s", s), 0) < 2:
            want.add((q, s, x))
            room["q", q], room["s", s] = room.get(("q", q), 0) + 1, room.get(("s", s), 0) + 1
    for few in (100_000, 30):
        got = retrieval.greedy_caps(links, 1, 2, few=few)
        assert {tuple(r) for r in got.collect()} == want and got.count() == len(want)


def test_snippets_in_long_texts(spark):
    """Line by line against trimmed lines by hand; twice the text takes about twice the time."""
    rng = random.Random(7)
    rows = []
    for i in range(200):
        lines = [rng.choice(["a", " a ", "b\t", "", "  ", "ab"]) for _ in range(rng.randint(1, 9))]
        at = rng.randint(0, len(lines) - 1)
        old = "\n".join(rng.choice(["", " "]) + x for x in lines[at : at + rng.randint(1, 3)]) if rng.random() < 0.8 else "zz\na"
        rows.append((i, "\n".join(lines), old))
    got = {r["i"]: r["at"] and tuple(r["at"]) for r in spark.createDataFrame(rows, "i int, t string, o string").select("i", workspace.locate_snippet(F.col("t"), F.col("o")).alias("at")).collect()}
    for i, text, old in rows:
        lines, wanted = [x.strip() for x in text.split("\n")], [x.strip() for x in old.split("\n")]
        loose = next((n for n in range(len(lines) - len(wanted) + 1) if lines[n : n + len(wanted)] == wanted), None)
        first = None if not old else text[: text.index(old)].count("\n") + 1 if old in text else loose + 1 if any(wanted) and loose is not None else None
        assert got[i] == (first and (first, first + len(wanted) - 1)), (text, old)
    times = []
    for n in (4_000, 8_000):
        text = spark.createDataFrame([("\n".join(f" line {i}" for i in range(n)), f"line {n - 2} \n\tline {n - 1}")], "t string, o string")
        start = time.perf_counter()
        assert text.select(workspace.locate_snippet(F.col("t"), F.col("o")).alias("at")).first()[0]["first"] == n - 1
        times.append(time.perf_counter() - start)
    assert times[1] < 4 * times[0] + 2


def test_equal_short_texts(spark):
    left = spark.createDataFrame([(1, " Ja "), (2, "no"), (3, " "), (4, None)], "key int, text string")
    right = spark.createDataFrame([(9, "ja"), (7, "JA"), (8, "nope"), (5, ""), (6, None)], "key int, text string")
    assert [tuple(r) for r in retrieval.equal_texts(left, right, "key", "text").collect()] == [(1, 7, 1.0)]


def test_failure_parts_of_odd_outputs(spark):
    cases = {
        "FAIL [exit=1]\nFAIL adds items\nError: bad\n  at run (src/a.ts:3:4)": ["Error", "src/a.ts:3:4", "adds items", "run (src/a.ts:3:4)"],
        "FAIL [exit=1]\nTS2304 in src\\a.ts:3:4": ["TS2304", "src\\a.ts:3:4", "unknown", "unknown"],
        "x FAIL no\n✗ my test\r\nFAILED two": ["unknown", "unknown", "my test", "unknown"],
        "": ["unknown"] * 4,
    }
    rows = spark.createDataFrame([(x,) for x in cases], "o string").select("o", T.failure_parts(F.col("o")).alias("p"), T.failure_fingerprint(F.lit('a "b"'), F.col("o"), F.lit("h")).alias("f")).collect()
    import hashlib
    import json

    for r in rows:
        assert r["p"] == cases[r["o"]]
        assert r["f"] == "sha256:" + hashlib.sha256(json.dumps(['a "b"', *r["p"], "h"], separators=(",", ":"), ensure_ascii=False).encode()).hexdigest()
    files = spark.createDataFrame([([("b", None), ("a", "x")],)], "f array<struct<path: string, content: string>>")
    want = hashlib.sha256(f"a:{hashlib.sha256(b'x').hexdigest()}|b:missing".encode()).hexdigest()
    assert files.select(T.changed_hash(F.col("f"))).first()[0] == want


def test_glossary_by_pieces(spark):
    keys = spark.createDataFrame([("largest bolt",), ("x",), ("",), (None,), ("bolt",), ("bolt",)], "key string")
    for known, want in ((["olt", "zz"], ["bolt", "bolt", "largest bolt"]), (["x", "largest bolt!"], ["x"]), ([""], ["", "bolt", "bolt", "largest bolt", "x"]), ([], [])):
        got = workspace.glossary_covered(keys, spark.createDataFrame([(k,) for k in known] + [(None,)], "known string"))
        assert sorted(r["key"] for r in got.collect()) == want
