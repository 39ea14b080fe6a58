"""Fielded links and coupled caps against a direct computation."""

import math
import random
from itertools import combinations

from loomquery.operators import doclinks

SYMBOLS, SECTIONS = "key long, token string", "key long, token string"


def _side(rng, fields, keys, words):
    return {f: [(k, rng.choice(words)) for k in keys for _ in range(rng.randint(0, 14))] for f in fields}


def _weights(fields, weights):
    out = {}
    for f, rows in fields.items():
        for k, t in rows:
            if len(t) > 1:
                out.setdefault(k, {}).setdefault(t.lower(), 0)
                out[k][t.lower()] += weights[f]
    return out


def _direct(symbols, sections, generic, boosts, told, accepted, rejected):
    sec_df, sym_df = {}, {}
    for side, df in ((sections, sec_df), (symbols, sym_df)):
        for tokens in side.values():
            for t in tokens:
                df[t] = df.get(t, 0) + 1
    n, m = len(sections), len(symbols)
    average = max(1.0, sum(max(1.0, sum(s.values())) for s in sections.values()) / n)
    idf = {t: math.log(1 + (n - d + 0.5) / (d + 0.5)) for t, d in sec_df.items()}
    fine = {t for t, d in sec_df.items() if t not in generic and not (d >= 4 and d / n >= 0.25) and not (sym_df.get(t, 0) >= 6 and sym_df[t] / m >= 0.35) and idf[t] > 0}
    out = {}
    for a, own in symbols.items():
        for b, sec in sections.items():
            shared = sorted(t for t in own if t in sec and t in fine)
            if len(shared) < 2 or (a, b) in rejected:
                continue
            length = max(1.0, sum(sec.values()))
            score = sum(own[t] * idf[t] * sec[t] * 2.2 / (sec[t] + 1.2 * (0.25 + 0.75 * length / average)) for t in shared)
            rare = sorted((idf[t] for t in shared if sec_df[t] <= 2), reverse=True)[:4]
            score += sum(min(2, x * y * 0.25) for x, y in combinations(rare, 2))
            for t in shared:
                score *= (1 + max(-0.9, min(2, boosts.get(t, 0)))) * (1.15 if t in told else 1)
            score = round(score + 25 * ((a, b) in accepted), 6)
            if (a, b) in accepted or score >= 4 and score / (score + 8) >= 0.32:
                out[a, b] = (score, shared)
    return out


def test_concept_scores(spark):
    """With and without bounds, with feedback: the same links; bounds make fewer pairs."""
    rng = random.Random(12)
    words = [f"w{i}" for i in range(40)] + ["x", "Ab", "generic"]
    skewed = words + words[:6] * 12
    symbol_fields, section_fields = _side(rng, ["name", "doc", "path"], range(40), skewed), _side(rng, ["title", "body"], range(100, 160), skewed)
    frames = lambda fields: {f: spark.createDataFrame(rows, SYMBOLS) for f, rows in fields.items()}
    symbols, sections = doclinks.weighted(frames(symbol_fields), doclinks.SYMBOL_WEIGHTS), doclinks.weighted(frames(section_fields), doclinks.SECTION_WEIGHTS)
    a, b = _weights(symbol_fields, doclinks.SYMBOL_WEIGHTS), _weights(section_fields, doclinks.SECTION_WEIGHTS)
    plain = _direct(a, b, {"generic"}, {}, set(), set(), set())
    some = sorted(plain)
    boosts, told, accepted, rejected = {"w7": 3.0, "w20": -2.0, "w30": 0.5}, {"w9"}, {some[0], (0, 100), (3, 120)}, {some[1], some[2]}
    feedback = {
        "boosts": spark.createDataFrame(list(boosts.items()), "token string, boost double"), "accepted_tokens": spark.createDataFrame([(t,) for t in told], "token string"),
        "accepted": spark.createDataFrame(list(accepted), "symbol long, section long"), "rejected": spark.createDataFrame(list(rejected), "symbol long, section long"),
    }
    for given, want in ((None, plain), (feedback, _direct(a, b, {"generic"}, boosts, told, accepted, rejected))):
        for prune in (True, False):
            got = {(r["symbol"], r["section"]): (r["score"], r["shared"]) for r in doclinks.concept_scores(symbols, sections, ["generic"], given, prune).collect()}
            assert got.keys() == want.keys() and all(got[k][1] == want[k][1] and abs(got[k][0] - want[k][0]) < 1e-5 for k in want)
    assert len(plain) > 30


def test_capped_links(spark):
    rng = random.Random(13)
    explicit = [(rng.randint(0, 9), rng.randint(0, 9), rng.randint(3, 6)) for _ in range(40)]
    concepts = {(rng.randint(0, 12), rng.randint(0, 12)): float(rng.randint(4, 20)) for _ in range(120)}
    got = {(r["symbol"], r["section"], r["score"], r["explicit"]) for r in doclinks.capped_links(spark.createDataFrame(explicit, "symbol long, section long, length int"), spark.createDataFrame([(*k, v) for k, v in concepts.items()], "symbol long, section long, score double"), most=1000).collect()}
    longest = {}
    for s, t, n in explicit:
        longest[s, t] = max(n, longest.get((s, t), 0))
    want, per_section, per_symbol, by_concept = set(), {}, {}, {}
    for (s, t), _ in sorted(longest.items(), key=lambda e: (-e[1], e[0])):
        if per_section.get(t, 0) < 3:
            want.add((s, t, 100.0, True))
            per_section[t], per_symbol[s] = per_section.get(t, 0) + 1, per_symbol.get(s, 0) + 1
    for (s, t), score in sorted(concepts.items(), key=lambda e: (-e[1], e[0])):
        if (s, t, 100.0, True) not in want and per_section.get(t, 0) < 3 and per_symbol.get(s, 0) < 3 and by_concept.get(s, 0) < 2:
            want.add((s, t, score, False))
            per_section[t], per_symbol[s], by_concept[s] = per_section.get(t, 0) + 1, per_symbol.get(s, 0) + 1, by_concept.get(s, 0) + 1
    assert got == want and {e for *_, e in got} == {True, False}


def test_order_that_readers_expect(spark):
    rows = spark.createDataFrame([(x,) for x in ["b", "A", "1", "_x", "a", "é", "Z", "e", "f"]], "x string")
    assert [r[0] for r in rows.orderBy(doclinks.as_read(rows["x"])).collect()] == ["_x", "1", "a", "A", "b", "e", "é", "f", "Z"]
