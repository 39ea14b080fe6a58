"""Training-data operators on small tables, against brute force."""

import base64
import hashlib
import random
import tracemalloc
from collections import Counter, defaultdict

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from loomquery.llm import _common, chat, decontaminate, embeddings, langid, mixing, quality, sharding, simhash, suffix_dedup, warc
from loomquery.llm.components import connected_components

DOCS = "doc_id long, text string, lang string, source string, n_chars long, id string, key string"


def _docs(spark, texts, ids=None):
    rows = [(i, t, "en", "s", 0, "x", "y") for i, t in zip(ids or range(len(texts)), texts)]
    return spark.createDataFrame(rows, DOCS)


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(3)
    vocab = ["".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 7))) for _ in range(400)]
    words = lambda n: " ".join(rng.choice(vocab) for _ in range(n))
    base, passage = words(120), words(60)
    out = [base, base, base.replace("a", "A", 3), words(30) + passage + words(30), words(10) + passage, passage + words(40), None, "", "  ", "ab", "z" * 900, words(4000) + passage]
    return out + [base[:300] + words(20) + base[300:], "é" * 300, "é" * 299 + "x" + "é" * 250] + [words(rng.randint(1, 80)) for _ in range(20)]


def test_suffix_dedup(spark, texts):
    def brute():
        raws = [(t or "").encode() for t in texts]
        seen = Counter(r[i : i + 200] for r in raws for i in range(len(r) - 199))
        out = []
        for r in raws:
            gone = bytearray(len(r))
            for i in range(len(r) - 199):
                if seen[r[i : i + 200]] > 1:
                    gone[i : i + 200] = b"\1" * 200
            out.append(bytes(a for a, g in zip(r, gone) if not g))
        return out

    want = brute()
    for limit in (suffix_dedup.GROUP_ROWS, 3, 1):  # small: grams are split by the bytes around them, some of them twice
        got = {r["id"]: (bytes(r["kept"]), r["n_bytes"], r["runs"]) for r in suffix_dedup.remove_repeats(_docs(spark, texts), group_rows=limit).collect()}
        assert [got[i][0] for i in range(len(texts))] == want
        assert all(n - sum(b - a for a, b in runs) == len(kept) for kept, n, runs in got.values())
    assert suffix_dedup.remove_repeats(_docs(spark, texts).limit(0)).count() == 0


@pytest.mark.parametrize("limit", [suffix_dedup.GROUP_ROWS, 2])
def test_suffix_dedup_of_one_row_many_times(spark, limit):
    """Copies of a row, and of one that differs in the middle, share their spans: no list grows with the copies."""
    rng = random.Random(8)
    text = "".join(rng.choice("abcdefgh ") for _ in range(3_000))
    texts = [text] * 2_000 + [text[:1_000] + "#" + text[1_000:]] * 1_000 + ["x" * 10 + text[1_500:1_800]]
    ids = [7] * 3_000 + [None]
    got = Counter((r["id"], bytes(r["kept"]), r["n_bytes"]) for r in suffix_dedup.remove_repeats(_docs(spark, texts, ids), group_rows=limit).collect())
    assert got == {(7, b"", 3_000): 2_000, (7, b"", 3_001): 1_000, (None, b"x" * 10, 310): 1}


@pytest.mark.parametrize("limit", [suffix_dedup.GROUP_ROWS, 2])
def test_repeat_groups(spark, texts, limit):
    """Each group holds every occurrence of its string; together they cover every byte of a repeated window."""
    docs = _docs(spark, texts + texts[:4] + [texts[3][100:900]])
    raws = [(t or "").encode() for t in texts + texts[:4] + [texts[3][100:900]]]
    found = defaultdict(set)
    for r in suffix_dedup.repeat_groups(docs, group_rows=limit).collect():
        found[r["repeat"]].add((r["id"], r["start"], r["n_bytes"]))
    covered = [bytearray(len(r)) for r in raws]
    for at in found.values():
        (string,) = {raws[i][a : a + n] for i, a, n in at}
        assert len(string) >= 200 and len(at) > 1
        assert {(i, a) for i, a, _ in at} == {(i, a) for i, r in enumerate(raws) for a in range(len(r)) if r.startswith(string, a)}
        for i, a, n in at:
            covered[i][a : a + n] = b"\1" * n
    seen = Counter(r[i : i + 200] for r in raws for i in range(len(r) - 199))
    for r, c in zip(raws, covered):
        want = bytearray(len(r))
        for i in range(len(r) - 199):
            if seen[r[i : i + 200]] > 1:
                want[i : i + 200] = b"\1" * 200
        assert c == want


def test_anchors_of_slices(monkeypatch):
    """A text cut into slices has the anchors and contexts that it has whole."""
    rng = random.Random(5)
    raw = bytes(rng.choice(b"abcd") for _ in range(5000)) + b"z" * 1500 + bytes(rng.choice(b"ab") for _ in range(900))
    whole = suffix_dedup.anchors([(raw, 0, len(raw) - 199)])
    want = dict(zip(whole[1].tolist(), zip(whole[2].tolist(), whole[3].tolist())))
    monkeypatch.setattr(suffix_dedup, "SLICE", 300)
    got = {}
    for offset, part in suffix_dedup._cut(raw):
        _, pos, gram, context = suffix_dedup.anchors([part])
        got.update(zip((pos + offset).tolist(), zip(gram.tolist(), context.tolist())))
    assert got == want


def test_interval_tree():
    assert list(suffix_dedup.intervals([2, 3, 0, 1])) == [(3, 1, 2), (2, 0, 2), (1, 3, 4)]
    assert suffix_dedup.lce(b"abcd", b"abxd") == 2 and suffix_dedup.lce(b"", b"a") == 0 and suffix_dedup.lce(b"aa", b"aab") == 2


def test_fingerprint(texts):
    for t in texts:
        words = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "").split()
        grams = [" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))] if words else []
        h = [xxhash.xxh64_intdigest(g, 42) for g in grams]
        assert simhash.fingerprint(t) == sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


@pytest.mark.parametrize("bucket", [50_000, 2])
def test_hamming_components(spark, bucket):
    rng = random.Random(9)
    fps = {rng.getrandbits(64) for _ in range(40)}
    for f in list(fps)[:15]:
        for _ in range(4):
            f ^= sum(1 << b for b in rng.sample(range(64), rng.randint(1, 4)))
            fps.add(f)
    fps = sorted(fps)
    parent = list(range(len(fps)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(fps)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= 3:
                a, b = sorted((find(i), find(j)))
                parent[b] = a
    reps = spark.createDataFrame([(i, f - (1 << 64) if f >> 63 else f) for i, f in enumerate(fps)], "id long, fp long")
    parts = {r["node"]: r["component"] for r in connected_components(simhash.hamming_edges(reps, bucket)).collect()}
    assert [parts.get(i, i) for i in range(len(fps))] == [find(i) for i in range(len(fps))]


def test_simhash_edges(spark, texts):
    got = {r["id"]: r for r in simhash.simhash_components(_docs(spark, texts)).collect()}
    assert got[0]["component"] == got[1]["component"] == got[2]["component"] == 0
    assert got[6]["component"] == got[7]["component"] == got[8]["component"] and got[6]["fp"] == 0
    assert simhash.simhash_components(_docs(spark, texts).limit(0)).count() == 0


def test_near_groups(spark):
    """Groups of five-word similarity 0.8 or more, against all pairs of whole texts."""
    rng = random.Random(11)
    vocab = [f"w{i}" for i in range(300)]
    out = [None, "", " ", "one two", "one  two", "a b c d e"]
    for n in (12, 40, 150, 600, 3000):
        base = [rng.choice(vocab) for _ in range(n)]
        for edits in (0, 0, 1, n // 60, n // 45, n // 30, n // 12, n // 5):
            words = list(base)
            for _ in range(edits):
                words[rng.randrange(n)] = "x" + rng.choice(vocab)
            out.append(" ".join(words))
    sets = [set(simhash._shingle_hashes(t, 5).tolist()) for t in out]
    edges = [(i, j) for j in range(len(out)) for i in range(j) if len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j])]
    root = list(range(len(out)))
    for _ in root:
        for i, j in edges:
            root[i] = root[j] = min(root[i], root[j])
    docs = _docs(spark, out)
    got = {r.id: r.component for r in simhash.near_groups(docs.union(docs).union(_docs(spark, ["no one", None], [900, None]))).collect()}
    assert [got[i] for i in range(len(out))] == root
    assert got[900] == 900 and got[None] == 0
    assert simhash.near_groups(docs.limit(0)).count() == 0


def _template(rng, members, near, words=360):
    """Texts that share a passage and are 0.77 alike, the last two of them 0.82."""
    base = [f"b{rng.getrandbits(40)}" for _ in range(words)]
    out = []
    for m in range(members):
        own = [f"m{m}x{rng.getrandbits(40)}" for _ in range(words // 7)]
        out.append(" ".join(base + own))
    twin = out[-1].split()
    twin[-near:] = [f"t{rng.getrandbits(40)}" for _ in range(near)]
    return [*out, " ".join(twin)]


@pytest.mark.parametrize("chunk", [2000, 30])
def test_near_pairs_within_a_template(spark, monkeypatch, chunk):
    """Pairs at 0.8 or more are found although most rows that share their keys are below it to both."""
    monkeypatch.setattr(simhash, "CHUNK", chunk)
    rng = random.Random(8)
    texts = [t for _ in range(12) for t in _template(rng, 80, 40)]
    sets = [set(simhash._shingle_hashes(t, 5).tolist()) for t in texts]
    alike = [(i, j) for j in range(len(texts)) for i in range(j) if len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j])]
    assert len(alike) == 12
    got = {r.id: r.component for r in simhash.near_groups(_docs(spark, texts)).collect()}
    assert all(got[i] == got[j] for i, j in alike)


def test_near_groups_of_repeated_lines(spark):
    """Equal shingle sets are one group, however often a line of them repeats."""
    rng = random.Random(4)
    out = []
    for g in range(25):
        words, line = [f"u{g}x{rng.getrandbits(40)}" for _ in range(120)], [f"r{g}x{rng.getrandbits(40)}" for _ in range(13)]
        out += [" ".join(words + line * 40), " ".join(words + line * 2)]
    far = sum((simhash.fingerprint(a, 5) ^ simhash.fingerprint(b, 5)).bit_count() > simhash.WIDE_HAMMING for a, b in zip(out[::2], out[1::2]))
    got = {r.id: r.component for r in simhash.near_groups(_docs(spark, out)).collect()}
    assert far and [got[i] for i in range(len(out))] == [i - i % 2 for i in range(len(out))]


def test_near_groups_keep_unlike_texts_apart(spark):
    """Texts that one repeated line dominates have close fingerprints, yet are no near copies."""
    rng = random.Random(6)
    line = " ".join(f"r{rng.getrandbits(40)}" for _ in range(13))
    out = [" ".join([line] * 60 + [f"u{g}x{rng.getrandbits(40)}" for _ in range(60)]) for g in range(30)]
    fps = [simhash.fingerprint(t, 5) for t in out]
    assert any((fps[0] ^ f).bit_count() <= 3 for f in fps[1:])
    got = {r.id: r.component for r in simhash.near_groups(_docs(spark, out)).collect()}
    assert got == {i: i for i in range(len(out))}


def test_chain_test_keeps_all_within_the_budget():
    rng = np.random.default_rng(5)
    x = np.zeros(500, dtype=np.uint64)
    for row in range(500):
        for bit in rng.choice(64, rng.integers(0, simhash.WIDE_HAMMING + 1), replace=False):
            x[row] |= np.uint64(1) << np.uint64(bit)
    assert simhash._chain_within(x, simhash.WIDE_HAMMING).all()
    assert not simhash._chain_within(~x[:1] | np.uint64(0xFFFF0000FFFF0000), 8).any()


def test_components_of_a_path(spark):
    e = spark.createDataFrame([(i, i + 1) for i in range(50)] + [(100, 101), (7, 7)], "src long, dst long")
    assert {r["node"]: r["component"] for r in connected_components(e).collect()} == {**{i: 0 for i in range(51)}, 100: 100, 101: 100}


def test_warc(spark, tmp_path):
    rng = random.Random(1)
    same = "<p>same" * 50
    rows = [(i, None if i == 3 else f"http://x/{i}\r\nEvil: é", t) for i, t in enumerate([same, "a", None, "", same, "é", "b" * 5000, same] + [str(rng.random()) * 30 for _ in range(40)])]
    pages = spark.createDataFrame([(*r, "z") for r in rows], "page_id long, url string, html string, digest string")
    names = []
    for k in range(2):
        root = f"file://{tmp_path}/w{k}"
        manifest = warc.write_warc(pages, root, range_bytes=4000, file_bytes=1500)
        names.append({(r["file"], r["sha256"]) for r in manifest.collect()})
        got = {tuple(r) for r in warc.read_warc(manifest, root).collect()}
        ids = defaultdict(list)
        for i, _, t in rows:
            ids[t or ""].append(i)
        want = {(i, len(t.encode()), base64.b32encode(hashlib.sha1(t.encode()).digest()).decode(), "response" if i == max(g) else "revisit", None if i == max(g) else max(g)) for t, g in ids.items() for i in g}
        assert got == want and len(names[k]) > 3
    assert names[0] == names[1] and not list(tmp_path.glob("w*/data/.*tmp"))
    far = [(None, "u", "a"), (-(1 << 63), "u", "b"), ((1 << 63) - 1, None, "b"), (5, "u", None), (5, "u", None), *((i, "u", f"{i}" * 400) for i in range(40))]
    far = spark.createDataFrame([(*r, "z") for r in far], "page_id long, url string, html string, digest string")
    manifest = warc.write_warc(far, f"file://{tmp_path}/f", range_bytes=4000, file_bytes=1500)
    got = warc.read_warc(manifest, f"file://{tmp_path}/f").collect()
    assert sorted((r["page_id"] is not None, r["page_id"] or 0) for r in got) == sorted((r[0] is not None, r[0] or 0) for r in far.collect())
    assert Counter(r["record_type"] for r in got) == {"response": 44, "revisit": 1}
    files = manifest.orderBy("file").collect()
    assert len(files) > 4 and all(a["last_id"] <= b["first_id"] for a, b in zip(files, files[1:]) if a["last_id"] is not None)
    empty = warc.write_warc(pages.limit(0), f"file://{tmp_path}/e")
    assert warc.read_warc(empty, f"file://{tmp_path}/e").count() == 0


def test_chat_escaping():
    for t in ["", "\\", "<s>", "<\\s>", "\\<s>", "a<|end|>b\\\\<|turn|>", "[INST]\\[/INST]\\n<<SYS>>", "\\N"]:
        e = chat.escape(t)
        assert chat.unescape(e) == t and not any(c in e for c in chat.CONTROL)
        assert chat.unescape_role(chat.escape_role(f"r\n{t}")) == f"r\n{t}"


def test_chat_layouts(spark):
    turns = [("user", "hi <s>"), ("assistant", "yo [INST]")]
    layouts = [
        {"messages": [{"role": r, "content": t} for r, t in turns]}, {"conversations": [{"from": {"user": "human"}.get(r, "gpt"), "value": t} for r, t in turns]},
        {"instruction": turns[0][1], "input": None, "output": turns[1][1]}, {"prompt": turns[0][1], "response": turns[1][1], "extra": {"a": [1]}}, {"prompt": turns[0][1], "completion": turns[1][1]},
    ]
    import json

    rows = [(i, 0, json.dumps(x)) for i, x in enumerate(layouts)] + [(90, 0, "[1]"), (91, 0, "{bad"), (92, 0, None), (93, 0, '{"x": 1}')]
    out = chat.format_chat(spark.createDataFrame(rows, "conv_id long, ord long, record string"))
    got = {r["conv_id"]: r for r in out.collect()}
    assert all(chat.parse(got[i]["formatted"]) == turns for i in range(5)) and all(got[i]["layout"] is None and got[i]["formatted"] == "" for i in (90, 91, 92, 93))
    back = {r["conv_id"]: r for r in chat.read_back(out).collect()}
    assert {back[i]["turns_sha256"] for i in range(5)} == {hashlib.sha256("".join(f"{r}\n{t}\n" for r, t in turns).encode()).hexdigest()}
    assert back[0]["loss_sha256"] == hashlib.sha256(b"yo [INST]").hexdigest() and back[0]["loss_chars"] == 9
    assert chat.fingerprint({"a": [{"b": 1}], "c": 2}) == chat.fingerprint({"c": "x", "a": [{"b": None}, {"b": 2}]})


def test_pfair(spark):
    sizes = {"a": 400, "b": 133, "c": 57, None: 21}
    rows = [(i, s) for i, s in enumerate(s for s, n in sizes.items() for _ in range(n))]
    weights = {"a": 5, "b": 3, "c": 2}
    df = spark.createDataFrame([(i, s, "x") for i, s in rows], "doc_id long, source string, rank string")
    got = mixing.pfair_mix(df, weights=weights, default=1, block=2).collect()
    assert len(got) == len(rows) and len({r["__mix_pos"] for r in got}) == len(rows)
    blocks = {r["__mix_block"]: r["source"] for r in got}
    total = Counter(blocks.values())
    assert sorted(blocks) == list(range(len(blocks)))
    done = Counter()
    for t in range(11 * min(total[s] // w for s, w in {**weights, None: 1}.items())):
        done[blocks[t]] += 1
        assert all(abs(done[s] - (t + 1) * w / 11) < 1 for s, w in {**weights, None: 1}.items())
    assert mixing.pfair_mix(df.limit(0)).count() == 0


def _edf(counts):
    """Earliest deadline first, slot by slot."""
    total, done, out = sum(counts), [0] * len(counts), []
    for t in range(total):
        ready = [(-(-(done[s] + 1) * total // c), s) for s, c in enumerate(counts) if done[s] < c and done[s] * total // c <= t]
        s = min(ready)[1]
        done[s] += 1
        out.append(s)
    return out


def test_edf_slots(spark):
    rng = random.Random(3)
    counts = [[rng.randint(0, 9) for _ in range(rng.randint(1, 12))] for _ in range(40)] + [[1], [7, 7], [0, 1, 0]]
    counts = [c for c in counts if sum(c)]
    kinds = spark.createDataFrame([(i, sum(c), c) for i, c in enumerate(counts)], "first long, width long, counts array<bigint>")
    got = {r["first"]: r["slots"] for r in mixing.edf_slots(kinds).collect()}
    assert got == {i: _edf(c) for i, c in enumerate(counts)}


def test_pfair_many_sources(spark):
    """Sources of different sizes: every block has a place, in the periods that the weights give."""
    df = spark.createDataFrame([(i, f"s{i:03d}", i % 37 + 1) for i in range(200)], "k long, source string, blocks long")
    plan = {r["source"]: r for r in mixing.schedule(df.select("source", F.lit(3).alias("weight"), "blocks")).collect()}
    places = []
    for r in df.collect():
        p = plan[r["source"]]
        for b in range(r["blocks"]):
            k = sum(f <= b // 3 for f in p["firsts"]) - 1
            places.append(p["bases"][k] + (b // 3 - p["firsts"][k]) * p["widths"][k] + p["slots"][k][b % 3])
    assert sorted(places) == list(range(len(places)))


def test_pfair_edges(spark):
    """Clashing names, repeated rows, an all-null source, a plan joined by salts."""
    names = "doc_id long, source string, s string, h string, row string, rank long, w long, e long, __mix_pos string, blocks map<string,int>"
    df = spark.createDataFrame([(i // 2, None if i % 3 else "a", "x", "y", "z", 1, 2, 3, "gone", {"a": 1}) for i in range(100)], names)
    before = _common.BROADCAST_BYTES
    try:
        out = []
        for _common.BROADCAST_BYTES in (before, 0):
            got = mixing.pfair_mix(df, weights={"a": 2, None: 1}, block=4)
            assert got.columns == [*(c for c in df.columns if c != "__mix_pos"), "__mix_block", "__mix_pos"]
            out.append(sorted((r["__mix_pos"], r["doc_id"], r["source"] or "") for r in got.collect()))
        assert out[0] == out[1] and len({x[0] for x in out[0]}) == 100
    finally:
        _common.BROADCAST_BYTES = before


def test_decontaminate(spark):
    rng = random.Random(4)
    item = " ".join("".join(rng.choice("abcdefghij") for _ in range(rng.randint(2, 8))) for _ in range(25))
    noise = lambda n: " ".join("".join(rng.choice("klmnop") for _ in range(5)) for _ in range(n))
    edited = list(item)
    for p in rng.sample(range(len(edited)), len(edited) // 20):
        edited[p] = rng.choice(["", "q", edited[p] + "q"])
    texts = [noise(50), noise(20) + " " + item + " " + noise(20), item.upper().replace(" ", ",\n"), noise(5) + " " + "".join(edited) + " " + noise(9), item[: len(item) // 2] + noise(30), None, "", "ab"]
    bench = spark.createDataFrame([(7, item), (8, "short"), (9, None), (None, item)], "item_id long, text string")
    got = {(r["id"], r["item_id"]) for r in decontaminate.benchmark_matches(_docs(spark, texts), bench).collect()}
    assert got == {(1, 7), (2, 7), (3, 7)}
    assert {r["doc_id"] for r in decontaminate.clean_rows(_docs(spark, texts), bench).collect()} == {0, 4, 5, 6, 7}
    assert decontaminate.benchmark_matches(_docs(spark, texts), bench.limit(0)).count() == 0


def _holds(text, item):
    """Fewest edits of a whole item anywhere in a text, by the full table."""
    row = [0] * (len(text) + 1)
    for i, x in enumerate(item, 1):
        new = [i]
        for j, y in enumerate(text, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
        row = new
    return min(row)


@pytest.mark.parametrize("segment, postings", [(1 << 19, 1 << 20), (64, 16)])
def test_decontaminate_brute_force(spark, monkeypatch, segment, postings):
    """All items against all texts: exactly those within the budget, short items as whole words, repeats and clashing names."""
    monkeypatch.setattr(decontaminate, "SEGMENT", segment)
    monkeypatch.setattr(decontaminate, "POSTINGS", postings)
    rng = random.Random(12)
    items = ["".join(rng.choice("abc ") for _ in range(n)) for n in (45, 60, 90, 120, 60)] + ["a" * 50, "yes no", "b", "", "...", "ab ab", None]
    texts = [None, "", "b", "yes, NO!", "abc yes no way", "a" * 400, "xab abx"]
    for i, t in enumerate(items[:5]):
        for edits in (0, 1, len(t) // 10, len(t) // 10 + 4):
            chars = list(decontaminate.normalize(t))
            for p in rng.sample(range(len(chars)), edits):
                chars[p] = rng.choice(["", "x", chars[p] + "y"])
            texts.append("".join(rng.choice("abc ") for _ in range(rng.randint(0, 150))) + " " + "".join(chars) + " " + "".join(rng.choice("xyz ") for _ in range(40)))
    want = set()
    for d, t in enumerate(map(decontaminate.normalize, texts)):
        for i, m in enumerate(map(decontaminate.normalize, items)):
            limit = min(int(decontaminate.EDIT_RATE * len(m)), (len(m) - decontaminate.Q) // decontaminate.Q)
            if (f" {m} " in f" {t} " and m) if len(m) < decontaminate.MIN_CHARS else _holds(t, m) <= limit:
                want.add((d, i))
    bench = spark.createDataFrame([(i, t, "x") for i, t in enumerate(items)] * 2, "item_id long, text string, id string")
    docs = _docs(spark, texts)
    got = Counter((r["id"], r["item_id"]) for r in decontaminate.benchmark_matches(docs.union(docs), bench).collect())
    assert set(got) == want and set(got.values()) == {4} and len(want) > 15
    assert {r["doc_id"] for r in decontaminate.clean_rows(docs, bench).collect()} == set(range(len(texts))) - {d for d, _ in want}


def test_decontaminate_one_character():
    """A text and an item of one character: postings meet all positions, in parts."""
    items = decontaminate.index([(1, "a" * 500)])
    tracemalloc.start()
    assert decontaminate.matches(["a" * 200_000], items) == [(0, 0, 0, 500)]
    assert tracemalloc.get_traced_memory()[1] < 300 << 20
    tracemalloc.stop()


def test_banded_distance_is_the_edit_distance():
    rng = random.Random(2)
    for _ in range(60):
        a = "".join(rng.choice("ab") for _ in range(rng.randint(3, 14)))
        b = "".join(rng.choice("ab") for _ in range(rng.randint(0, 22)))
        row = [0] * (len(b) + 1)
        for x in a:
            new = [row[0] + 1]
            for j, y in enumerate(b, 1):
                new.append(min(row[j] + 1, new[j - 1] + 1, row[j - 1] + (x != y)))
            row = new
        assert decontaminate.banded_distance(a, b, -len(a), len(b), 99)[0] == min(row)


def test_sharding(spark):
    rng = random.Random(6)
    texts = [("é" * rng.randint(0, 300)) if rng.random() < 0.9 else None for _ in range(300)] + ["x" * 5000]
    ids = [*range(300), 999]
    ids[:60] = [5] * 60  # a repeated key
    got = sharding.extendible_shards(_docs(spark, texts, ids), max_bytes=3000).collect()
    assert len(got) == 301
    held = Counter()
    for r in got:
        held[r["__shard"]] += r["__n_bytes"]
        assert "-" in r["__shard"] or r["__shard"] == format(int(hashlib.md5(str(r["doc_id"]).encode()).hexdigest()[:15], 16), "060b")[: r["__depth"]]
    assert {s for s, b in held.items() if b > 3000} == {r["__shard"] for r in got if r["__n_bytes"] > 3000}
    names = sorted(s for s in held if "-" not in s)
    assert not any(b != a and b.startswith(a) for a in names for b in names)
    assert sharding.extendible_shards(_docs(spark, texts).limit(0)).count() == 0
    names = "doc_id long, text string, h long, p string, d int, bytes long, rows long, __shard string, leaf0 int, m map<string,int>"
    odd = spark.createDataFrame([(None, "x" * 90, 1, "p", 2, 3, 4, "gone", 5, {"a": 1})] * 70 + [(1, None, 1, "p", 2, 3, 4, None, 5, None)], names)
    out = sharding.extendible_shards(odd, max_bytes=1000)
    assert out.columns == [*(c for c in odd.columns if c != "__shard"), "__shard", "__depth", "__shard_bytes", "__n_bytes"]
    got = out.collect()
    assert len({r["__shard"] for r in got}) == 71 and all(r["__shard_bytes"] in (0, 90) for r in got)


@pytest.mark.parametrize("part_rows", [4096, 7])
def test_embeddings(spark, part_rows):
    rng = np.random.default_rng(8)
    x = rng.standard_normal((300, 16))
    near = x[:40].repeat(4, axis=0) + rng.standard_normal((160, 16)) * 0.08
    vecs = [*x.tolist(), *near.tolist(), x[0].tolist(), (x[1] * 3).tolist(), None, [], [0.0] * 16, [None] + [1.0] * 15, [float("nan")] * 16, [1.0, 0.0], [2.0, 0.0]]
    df = spark.createDataFrame([(i, v, "x") for i, v in enumerate(vecs)], "vec_id long, embedding array<double>, n string")
    got = {r["id"]: r for r in embeddings.near_duplicates(df, part_rows=part_rows).collect()}
    links = defaultdict(set)
    good = {i: np.array(v, float) for i, v in enumerate(vecs) if v and None not in v and np.isfinite(v).all() and np.any(v)}
    for i, a in good.items():
        for j, b in good.items():
            if j < i and len(a) == len(b) and a @ b / np.linalg.norm(a) / np.linalg.norm(b) >= 0.95:
                links[i].add(j), links[j].add(i)
    found, true = sum(r["n_links"] for r in got.values()), sum(map(len, links.values()))
    assert all(got[i]["n_links"] <= len(links[i]) for i in got) and found >= 0.95 * true
    assert all(got[i]["n_links"] == 0 and got[i]["kept"] for i in range(462, 467))
    assert embeddings.near_duplicates(df.limit(0)).count() == 0


def test_embeddings_recall(spark):
    """Pairs at the threshold and a little above, in many cells: recall against all pairs."""
    rng = np.random.default_rng(21)
    centers = rng.standard_normal((60, 32))
    x = centers[rng.integers(0, 60, 6000)] + rng.standard_normal((6000, 32)) * 0.7
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    noise = rng.standard_normal((2000, 32))
    noise -= (noise * x[:2000]).sum(1)[:, None] * x[:2000]
    noise /= np.linalg.norm(noise, axis=1, keepdims=True)
    cosine = rng.uniform(0.9501, 0.97, (2000, 1))
    vecs = np.concatenate([x, cosine * x[:2000] + np.sqrt(1 - cosine**2) * noise])
    want = (vecs @ vecs.T >= 0.95).sum(axis=1) - 1
    got = {r["id"]: r["n_links"] for r in embeddings.near_duplicates(spark.createDataFrame([(i, v) for i, v in enumerate(vecs.tolist())], "vec_id long, embedding array<double>")).collect()}
    assert all(got[i] <= want[i] for i in got)
    recall = sum(got.values()) / want.sum()
    print("recall", recall, "links", want.sum())
    assert recall >= 0.99


def test_quality_weights(spark):
    """Weights against a direct computation, shrunk and plain, over repeated rows, nulls and clashing names."""
    rng = random.Random(15)
    texts = [" ".join(f"w{int(rng.paretovariate(0.7)) % 300}" for _ in range(30)) for _ in range(150)] + [None, "", "w1", "w1"]
    labels = [(i, int(rng.random() < 0.6), int(rng.random() < 0.2)) for i in range(0, 154, 2)] + [(None, 1, 0), (9999, 1, None)]
    good = {i for i, q, t in labels if q == 1 and not t and i is not None}
    raw, target, each = Counter(), Counter(), []
    for i, t in enumerate(texts):
        bucket = quality.features([t])[0].tolist()
        each.append(bucket)
        raw.update(bucket)
        target.update(bucket if i in good else [])
    share = sum(target.values()) / sum(raw.values())
    docs, frame = _docs(spark, texts), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    for least_z in (quality.LEAST_Z, 0.0):
        ratio = {}
        for b in raw:
            e = raw[b] * share
            z2 = (target[b] - e) ** 2 / (e * (1 - share))
            ratio[b] = np.log((target[b] + 0.1) / (e + 0.1)) * (max(0, 1 - least_z**2 / z2) if z2 else 0)
        got = quality.importance_resample(docs, frame, fraction=0.5, least_z=least_z, smooth=0.1).collect()
        for r in got:
            assert r["log_weight"] == pytest.approx(sum(ratio[b] for b in each[r["id"]]), abs=1e-9) and r["n_features"] == len(each[r["id"]])
        kept = sorted(got, key=lambda r: (-r["key"], r["id"]))[:77]
        assert {r["id"] for r in got if r["kept"]} == {r["id"] for r in kept}


def test_quality(spark):
    rng = random.Random(5)
    good, bad = [f"good{i}" for i in range(60)], [f"bad{i}" for i in range(60)]
    texts = [" ".join(rng.choice(good if i % 4 else bad) for _ in range(40)) for i in range(200)] + [None, ""]
    labels = spark.createDataFrame([(i, int(i % 4 > 0), 0) for i in range(0, 200, 2)] + [(None, 1, 0)], "doc_id long, quality int, toxic int")
    got = {r["id"]: r for r in quality.importance_resample(_docs(spark, texts), labels, fraction=0.5).collect()}
    assert sum(r["kept"] for r in got.values()) == 101 and not any(got[i]["kept"] for i in range(0, 200, 4))
    assert got[200]["log_weight"] == got[201]["log_weight"] == 0
    assert quality.importance_resample(_docs(spark, texts).limit(0), labels).count() == 0


def test_top_k(spark, monkeypatch):
    monkeypatch.setattr(quality, "LAST_ROWS", 5)
    rows = [(i, float(i % 37) ** 3) for i in range(500)]
    df = spark.createDataFrame(rows, "id long, key double")
    want = {i for i, _ in sorted(rows, key=lambda r: (-r[1], r[0]))[:123]}
    assert {r["id"] for r in quality.top_k(df, "key", "id", 123).where("kept").collect()} == want


def test_langid(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    model = langid.train(docs)
    out = langid.predict(docs.withColumn("score", F.lit("clash")), model).where(langid.held_out(F.col("doc_id"))).collect()
    assert sum(r["lang"] == r["__lang_pred"] for r in out) >= 0.95 * len(out)
    odd = {r["doc_id"]: r for r in langid.predict(_docs(spark, [None, "", "123 !", "𠮷"]), model).collect()}
    assert [odd[i]["__lang_pred"] for i in range(3)] == ["und"] * 3 and odd[3]["__lang_pred"] != "und"
    none = langid.train(docs.limit(0))
    assert {r["__lang_pred"] for r in langid.predict(docs.limit(3), none).collect()} == {"und"}


def test_language_stage_drops_unlearned_alphabets(spark):
    import corpus_pipeline

    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rng = random.Random(2)
    words = lambda a, n: " ".join("".join(rng.choice(a) for _ in range(rng.randint(2, 9))) for _ in range(n))
    greek, cyrillic = "αβγδεζηθικλμνξοπρστυφχψω", "абвгдежзийклмнопрстуфхцчшщыэюя"
    odd = [words(a, n) for a in (greek, cyrillic, "".join(map(chr, range(0x4E00, 0x5500))), "bcdfghjklmnpqrstvwxz") for n in (60, 400, 4000)]
    rows = [(1_000_000 + i, t) for i, t in enumerate(odd)]
    more = spark.createDataFrame(rows, "doc_id long, text string")
    got = corpus_pipeline.identify_language(spark, docs.unionByName(more, allowMissingColumns=True), "")
    assert got.where("doc_id >= 1000000").count() == 0
    assert got.count() == docs.where("text is not null").count()


def test_langid_scores(spark):
    """Predictions against kernels and ridge outputs computed text by text; rows repeat, names clash."""
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    model = langid.train(docs)
    rows = docs.limit(40).collect()
    odd = spark.createDataFrame([(r["doc_id"], r["text"], "l", 1.0, "n") for r in rows * 2] + [(None, None, "l", 1.0, "n")], "doc_id long, text string, __lang_pred string, __score double, other string")
    got = langid.predict(odd, model)
    assert got.columns == ["doc_id", "text", "other", "__lang_pred", "__score", "__near"]
    for r in got.collect():
        x = np.zeros((1, langid.SIZE), np.uint8)
        if not langid.presence(r["text"], x[0]):
            assert (r["__lang_pred"], r["__score"]) == ("und", 0)
            continue
        s = model.score(x)[0]
        assert r["__lang_pred"] == model.langs[int(s.argmax())] and r["__score"] == pytest.approx(float(np.clip((s.max() + 1) / 2, 0, 1)), abs=1e-4)


def test_sharding_sql(spark):
    """The registered SQL with a small limit, so that buckets split."""
    import duckdb

    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text")
    sql = sharding.OP7_SQL.replace(str(sharding.MAX_BYTES), "60000").replace("FROM documents", "FROM '/root/testdata/sf0.001/documents.parquet'")
    out = sharding.extendible_shards(docs, max_bytes=60000).select("doc_id", "__n_bytes", "__shard", "__depth", "__shard_bytes")
    got = sorted(tuple(r) for r in out.collect())
    assert got == sorted(duckdb.sql(sql).fetchall()) and len({r[2] for r in got}) > 4


def test_chat_query(spark, tmp_path):
    """The query's digests, conversation -1 included, against a direct computation: nulls, equal turns, an empty table."""
    say = "</s>[INST] ok [/INST]"
    rows = [(1, 0, "user", "hi"), (1, 1, "assistant", None), (1, 2, None, "x<s>"), (2, 0, "assistant", "é𠮷"), (2, 0, "assistant", "é𠮷"), (None, 0, "user", "n"), (3, 1, "assistant", "b"), (3, 0, "assistant", "a\\N\n")]
    for name, part in (("some", rows), ("none", [])):
        spark.createDataFrame(part, "conv_id long, turn long, role string, text string").write.parquet(f"{tmp_path}/{name}/conversations.parquet")
        got = {r["conv_id"]: r for r in chat.op4_chat_format(spark, f"{tmp_path}/{name}").collect()}
        want = defaultdict(list)
        for conv, _, role, text in sorted(part, key=lambda r: (r[0] or 0, r[1])):
            want[conv].append((role or "", text or ""))
        want[-1] = [("user", say), ("assistant", say)]
        assert set(got) == set(want)
        for conv, turns in want.items():
            loss = "".join(t for r, t in turns if r == "assistant")
            assert (got[conv]["n_turns"], got[conv]["loss_chars"]) == (len(turns), len(loss))
            assert got[conv]["turns_sha256"] == hashlib.sha256("".join(f"{r}\n{t}\n" for r, t in turns).encode()).hexdigest()
            assert got[conv]["loss_sha256"] == hashlib.sha256(loss.encode()).hexdigest()


def test_pipeline_stages_by_brute_force(spark, tmp_path):
    """Every stage on nulls, empty texts, repeated rows and clashing names, and on no rows."""
    import corpus_pipeline

    rng = random.Random(31)
    base = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    names = ["row", "id", "__score", "__mix_pos", "__shard", "h", "near_id", "at"]
    docs = base.select("*", *(F.lit(n).alias(n) for n in names))
    first = docs.limit(5).collect()
    extra = [(900001, None), (900002, ""), (900003, "123"), (None, first[0]["text"]), (None, None), (first[1]["doc_id"], first[1]["text"])]
    more = spark.createDataFrame(extra, "doc_id long, text string").withColumns({n: F.lit(n) for n in names})
    docs = docs.unionByName(more, allowMissingColumns=True)
    docs.write.parquet(f"{tmp_path}/docs")
    docs = spark.read.parquet(f"{tmp_path}/docs")
    rows = docs.collect()
    sf_dir = "/root/testdata/sf0.001"

    kept = corpus_pipeline.near_dedup(spark, docs, sf_dir)
    sets = {}
    for r in rows:
        sets.setdefault(r["doc_id"], set(simhash._shingle_hashes(r["text"], 5).tolist()))
    ids = sorted(i for i in sets if i is not None)
    root = {i: i for i in ids}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for n, i in enumerate(ids):
        for j in ids[:n]:
            a, b = sets[i], sets[j]
            if (not a and not b) or (a and b and len(a & b) >= 0.8 * len(a | b)):
                x, y = sorted((find(i), find(j)))
                root[y] = x
    want = Counter([i for i in ids if find(i) == i] + [None] * 2)
    assert Counter(r["doc_id"] for r in kept.collect()) == want and kept.columns == docs.columns

    mixed = corpus_pipeline.mix_sources(spark, docs, sf_dir)
    mixed.write.parquet(f"{tmp_path}/mixed")
    placed = mixing.pfair_mix(docs.select("doc_id", "source", "text"))
    order = [r["doc_id"] for r in placed.orderBy("__mix_pos").collect()]
    out = corpus_pipeline.shard(spark, spark.read.parquet(f"{tmp_path}/mixed"), sf_dir)
    got = out.orderBy("mix_file", "mix_row").collect()
    sources = {r["doc_id"]: r["source"] for r in rows}
    assert [sources[r["doc_id"]] for r in got] == [sources[i] for i in order] and len(got) == len(rows)
    assert set(out.columns) == {*docs.columns, "shard", "shard_depth", "shard_bytes", "mix_file", "mix_row"}

    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs.limit(0), sf_dir).count() == 0
        whole = stage(spark, docs, sf_dir)
        assert set(docs.columns) <= set(whole.columns)
        if name in ("language_id", "decontamination"):
            texts = Counter(r["text"] for r in whole.collect())
            assert texts <= Counter(r["text"] for r in rows) and (None in texts) == (name == "decontamination")


def test_pipeline(spark):
    import corpus_pipeline

    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    out = corpus_pipeline.run(spark, "/root/testdata/sf0.001")
    kept = {r["doc_id"] for r in out.collect()}
    assert kept <= {r["doc_id"] for r in docs.collect()} and len(kept) > 100 and set(docs.columns) < set(out.columns)


def test_quality_drops_marked_words(spark):
    """Held out: no label of the odd ids is seen, a rare word marks the toxic ones, other words are noise."""
    rng = random.Random(6)
    texts = [" ".join([f"w{int(rng.paretovariate(0.5)) % 5000}" for _ in range(60)] + ["vile"] * (i % 8 in (0, 1))) for i in range(1600)]
    labels = spark.createDataFrame([(i, 1, int(i % 8 == 0)) for i in range(0, 1600, 2)], "doc_id long, quality int, toxic int")
    got = {r["id"]: r["kept"] for r in quality.importance_resample(_docs(spark, texts), labels).collect()}
    assert sum(got.values()) == 1200
    assert sum(got[i] for i in range(1, 1600, 8)) <= 20 and sum(got[i] for i in range(3, 1600, 8)) >= 140
