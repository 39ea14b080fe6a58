"""Point-in-time join, source divergence and personal data, against brute force."""

import hashlib
import random
import re
import time
from collections import Counter

import duckdb
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from loomquery.llm import divergence, pii, point_in_time, registry

DOCS = "doc_id long, text string, lang string, source string, n_chars long, key string, slice long, rank long"


def _tables(spark, tmp_path, docs, labels=()):
    rows = [(i, t, lang, s, n, "x", 1, 2) for i, t, lang, s, n in docs]
    spark.createDataFrame(rows, DOCS).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(i, 0, "y") for i in labels], "doc_id long, quality int, t string").write.parquet(f"{tmp_path}/labels.parquet")
    return str(tmp_path)


def _against_sql(spark, where, name):
    con = duckdb.connect()
    for t in ("documents", "labels"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{where}/{t}.parquet/*.parquet'")
    want = con.execute(registry.oracle_sql()[name])
    columns = [c[0] for c in want.description]
    return Counter(tuple(r[c] for c in columns) for r in registry.queries()[name](spark, where).collect()), Counter(map(tuple, want.fetchall()))


@pytest.mark.parametrize("width", [7, 50, 900])
def test_latest_usable(spark, width):
    """Winners by brute force; versions that outlive a slice, equal ones, negative times, nulls and a hot key."""
    rng = random.Random(width)
    versions = []
    for i in range(900):
        event = rng.randint(-40, 300)
        versions.append((rng.choice("aaab") if i % 50 else None, event, event + rng.randint(-5, 40), event + rng.choice([0, 3, 20, 120]), i % 400, f"v{i % 3}"))
    versions += [("a", None, 1, 5, 1, "n"), ("a", 1, None, 5, 1, "n"), ("a", 1, 2, None, 1, "n"), *versions[:5]]
    asks = [(rng.choice("abc") if i % 30 else None, rng.randint(-50, 450) if i % 31 else None) for i in range(400)]
    out = point_in_time.latest_usable(
        spark.createDataFrame(versions, "key string, event long, arrival long, expiry long, rank long, value string"), spark.createDataFrame(asks, "key string, t long"), width
    )
    got = {(r["key"], r["t"]): tuple(r["best"]) if r["best"] else None for r in out.collect()}
    want = {}
    for key, t in set(asks):
        if key is not None and t is not None:
            usable = [v[1:3] + v[4:] for v in versions if v[0] == key and None not in v[1:4] and v[1] <= t and v[2] <= t < v[3]]
            want[key, t] = max(usable, default=None)
    assert got == want and sum(v is not None for v in got.values()) > 50


def test_long_versions_fail(spark):
    one = spark.createDataFrame([("a", 0, 0, 10**9, 1, "v")], "key string, event long, arrival long, expiry long, rank long, value string")
    with pytest.raises(Exception, match="larger width"):
        point_in_time.latest_usable(one, spark.createDataFrame([("a", 5)], "key string, t long"), 5).collect()


def test_point_in_time_query(spark, tmp_path):
    """Nulls, repeated rows and ids, unknown ids, one hot source, columns named as the operator's; then empty tables."""
    rng = random.Random(5)
    docs = [(i, None, rng.choice(["en", None]), rng.choice([None, "s1", *["hot"] * 4]), rng.choice([None, i])) for i in range(3_000)]
    docs += docs[:20] + [(7, "x", "zz", "s1", 1), (None, "x", "en", "hot", 3)]
    where = _tables(spark, tmp_path / "a", docs, [*range(0, 3_100, 2), *range(0, 100), None, None])
    got, want = _against_sql(spark, where, "op11_point_in_time")
    assert got == want
    assert {"fresh", "stale", "none"} <= {r[4] for r in got}
    assert _against_sql(spark, _tables(spark, tmp_path / "b", docs, []), "op11_point_in_time") == (Counter(), Counter())
    got, want = _against_sql(spark, _tables(spark, tmp_path / "c", [], [1, 1, None]), "op11_point_in_time")
    assert got == want and sum(got.values()) == 3


def _words(rng, n):
    return " ".join(rng.choice(["the", "The", "été", "Éa", "x", "yz", "w" * 300, "a1b", "q-r", "漢字", "aa", "ab"]) for _ in range(n))


@pytest.mark.parametrize("block", [divergence.BLOCK_SOURCES, 2])
def test_audit(spark, block, monkeypatch):
    """Dense shares by brute force, at two sizes of blocks and at a small table of held counts; a term of one source alone, a hot source."""
    monkeypatch.setattr(divergence, "BLOCK_SOURCES", block)
    monkeypatch.setattr(divergence, "HELD_TERMS", 5)
    rng = random.Random(1)
    docs = [(rng.choice(["", None, _words(rng, rng.randint(0, 40)), _words(rng, 900)]), rng.choice(["en", None, "fr"]), rng.choice(["s0"] * 4 + ["s1", "S2", None, "é"])) for _ in range(150)]
    docs += [("lonely " * 9, "en", "s9")] * 3 + [(None, "xx", "s1"), ("", "xx", "s2"), ("one word", "yy", None)]
    got = Counter(map(tuple, divergence.audit(spark.createDataFrame(docs, "text string, lang string, source string"), least_docs=3, top=4).select("lang", "source", "part", "item", "value", "rank").collect()))
    low = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    found = [(re.findall("[^\x00-\x40\x5b-\x60\x7b-\x7f]+", (t or "").translate(low)), lang or "", s or "") for t, lang, s in docs]
    want = Counter()
    for lang in {f[1] for f in found}:
        own = [f for f in found if f[1] == lang]
        in_docs = Counter(t for words, _, _ in own for t in set(words))
        kept = sorted(t for t, n in in_docs.items() if n >= 3)
        groups = {s: Counter(t for words, _, x in own if x == s for t in words if in_docs[t] >= 3) for s in {f[2] for f in own}}
        p = lambda c: {t: 1 + 10**9 * (c[t] + 5) // (sum(c.values()) + 5 * len(kept)) for t in kept}
        q = p(sum(groups.values(), Counter()))
        shares = {s: p(c) for s, c in groups.items()}
        for s, mine in shares.items():
            pairs = [(-sum(abs(mine[t] - other[t]) for t in kept), o.encode(), o) for o, other in shares.items() if o != s]
            terms = [(q[t] - mine[t], t.encode(), t) for t in kept if groups[s][t] and mine[t] > q[t]]
            for part, items in (("pair", pairs), ("term", terms)):
                want.update((lang, s, part, item, -v, i) for i, (v, _, item) in enumerate(sorted(items), 1) if part == "pair" or i <= 4)
    assert got == want and any(r[2] == "term" for r in got)


def test_divergence_query(spark, tmp_path):
    rng = random.Random(2)
    docs = [(i, _words(rng, rng.randint(0, 30)), rng.choice(["en", "fr"]), rng.choice(["s0", "s1", None]), 1) for i in range(200)]
    docs += [docs[0]] * 40 + [(None, None, None, None, None)]
    got, want = _against_sql(spark, _tables(spark, tmp_path / "a", docs), "op12_divergence")
    assert got == want and {r[2] for r in got} == {"pair", "term"}
    assert not registry.queries()["op12_divergence"](spark, _tables(spark, tmp_path / "b", [])).count()


PATTERNS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def _plain(text):
    """The base spans as the patterns read."""
    out = {}
    for kind, pattern in PATTERNS.items():
        out[kind] = []
        for m in re.finditer(pattern, text):
            digits = re.sub("[^0-9]", "", m.group())
            sums = sum(sum(divmod(int(d) * 2, 10)) if i % 2 else int(d) for i, d in enumerate(digits[::-1]))
            fine = {"email": True, "ip": all(int(p) <= 255 for p in m.group().split(".")) if kind == "ip" else 0, "card": 16 <= len(digits) <= 19 and sums % 10 == 0, "phone": 8 <= len(digits) <= 15}
            if fine[kind]:
                out[kind].append(m.span())
    return out


@settings(max_examples=400, deadline=None)
@given(st.text(st.sampled_from("a.@-+1234567890 ()é٣"), max_size=60))
def test_base_spans(text):
    assert pii.base_spans(text) == _plain(text)


def test_base_spans_of_written_data():
    rng = random.Random(4)
    for _ in range(3_000):
        card = pii._grouped(pii._cards(rng), (4, 4, 4, 4), rng.choice([" ", "-", "", "."]))
        text = rng.choice(["", "x", "7", "+"]) + rng.choice([card, "a.b@c-d.e.f@g.h", f"+1 ({rng.randint(1, 999)}) 555-{rng.randint(1, 9999)}", "1.2.3.4.5.6.7.8.9", "256.1.1.1.1", "000300.1.1.1", "a@b", card + " " + card]) + rng.choice(["", ".", " 1", "9"])
        assert pii.base_spans(text) == _plain(text)


def test_spans_of_very_long_texts():
    """Time in proportion to the text, whatever it repeats."""
    for unit in ("a", "1", "1.", "a@", "+1", "1 ", "at ", "(", "+1 (", "a:", "0" * 15 + " "):
        for spans in (pii.base_spans, pii.candidates):
            times = []
            for n in (100_000, 400_000):
                start = time.process_time()
                spans(unit * (n // len(unit)))
                times.append(time.process_time() - start)
            assert times[1] < 12 * times[0] + 0.5, (unit, spans.__name__, times)


@pytest.fixture(scope="module")
def model(spark):
    rng = random.Random(9)
    words = ["".join(rng.choice("abcdefghilmnorstu") for _ in range(rng.randint(2, 8))) for _ in range(300)]
    texts = [" ".join(rng.choice(words) if rng.random() < 0.95 else str(rng.randint(1, 10**9)) for _ in range(rng.randint(20, 300))) for _ in range(600)]
    return pii.fit(spark.createDataFrame([(t,) for t in texts], "text string"))


WRITTEN = [
    ("email", "write to ", "bob.smith7 at example dot org", " today"), ("email", "mail ", "ann.lee [at] web.de", " please"), ("email", "so ", "eva(at)post(dot)net", ", yes"), ("email", "of ", "rené.m@exämple.de", " and"),
    ("ip", "from ", "2001:db8::ff00:42:8329", " seen"), ("ip", "the host ", "10[.]0[.]0[.]25", " was"), ("card", "then ", "4111.1111.1111.1111", " or"), ("card", "the card ", "3782 822463 10005", " and"),
    ("card", "no 555-3296 ", "4111111111111111", " the"), ("phone", "call ", "(415) 555-2671", " now"), ("phone", "on ", "0049 30 1234567", " ok"), ("phone", "at ", "+1 (269) 555-3296", " 4111111111111111 the"), ("phone", "tel: ", "4155552671", " and"),
]
CLEAN = ["look at example.com for it", "on 2024-05-17 12:30 we met 1234567890 and 004512", "isbn 978-0-306-40615-7 is it", "std::vector and a::b", "imei 490154203237518 it", "from 10 to 20, 3.14 and 1 000 000", "it was 12:30:45 at noon. com"]


def test_added_spans(model):
    """Spelled and re-formatted data that the exact patterns miss, as whole spans; clean texts stay without."""
    texts = [a + b + c for _, a, b, c in WRITTEN]
    for (kind, before, span, _), (base, found) in zip(WRITTEN, pii.all_spans(texts, model)):
        assert (len(before), len(before) + len(span)) in found[kind], (span, found)
        assert all(set(base[k]) <= set(found[k]) for k in pii.KINDS)
    for text, (_, found) in zip(CLEAN, pii.all_spans(CLEAN, model)):
        assert not any(found.values()), text


def test_find_and_redact(spark, model):
    rows = [(i, a + b + c, "old", [1]) for i, (_, a, b, c) in enumerate(WRITTEN)] + [(50, None, "x", None), (51, "", "x", None), (0, WRITTEN[0][1], None, [])]
    docs = spark.createDataFrame(rows, "doc_id long, text string, __spans string, row array<int>")
    got = pii.find(docs, model).collect()
    assert [(r["doc_id"], r["text"], r["row"]) for r in got] == [(i, t, x) for i, t, _, x in rows]
    assert all(r["__spans"] == pii.joined(pii.all_spans([r["text"] or ""], model)[0][1]) for r in got)
    cut = [r["text"] for r in pii.redacted(docs, model).collect()]
    assert cut[1] == "mail <EMAIL> please" and cut[len(WRITTEN)] is None and cut[len(WRITTEN) + 1] == ""


def test_personal_data_query(spark, tmp_path):
    """One row per row; counts and digest by the plain patterns; spans hold the base spans, in order and inside the text."""
    texts = [a + b + c for _, a, b, c in WRITTEN] + CLEAN + ["a@b.co +1 (222) 333-4444 x 1.2.3.4 y 4111 1111 1111 1111 é z@y.org", None, "", "x" * 50_000 + " q@w.er"] * 3
    where = _tables(spark, tmp_path / "a", [(i if i % 7 else None, t, "en", "s", 1) for i, t in enumerate(texts)])
    got = registry.queries()["op13_personal_data"](spark, where).collect()
    want = Counter()
    for i, t in enumerate(texts):
        base = _plain(t or "")
        want[(i if i % 7 else None, *(len(base[k]) for k in PATTERNS), hashlib.sha256(",".join(f"{k}:{a}:{b}" for k in PATTERNS for a, b in base[k]).encode()).hexdigest())] += 1
    assert Counter((r["doc_id"], r["n_email"], r["n_ip"], r["n_card"], r["n_phone"], r["base_sha256"]) for r in got) == want
    for r in got:
        spans = [s.split(":") for s in r["spans"].split(",") if s]
        assert spans == sorted(spans, key=lambda s: (list(PATTERNS).index(s[0]), int(s[1])))
    assert not registry.queries()["op13_personal_data"](spark, _tables(spark, tmp_path / "b", [])).count()
