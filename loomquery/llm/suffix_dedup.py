"""Exact repeated passages: sparse suffix groups, scanned as common-prefix interval trees."""

from __future__ import annotations

from itertools import accumulate

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._common import groups, materialize, pieces, table
from ._text import mix

LENGTH = 200
GRAM = 32
LEFT = LENGTH - GRAM
#: Different contexts of one gram that one task's tree holds (370 bytes each); more are split by the bytes around the gram.
GROUP_ROWS = 50_000
#: Cases of the first split (a power of two); the second has one for each place of the gram in a window.
CASES = 8
EDGES = [j * (LEFT + 1) // CASES for j in range(CASES + 1)]
#: Bytes, padding included, that are hashed at once, and anchors among which equal contexts are thinned out before the shuffle.
SLICE, THIN = 256 << 10, 200_000
#: Salts of a gram that holds over 1 / HEAVY of all anchors; so there are fewer than HEAVY such grams.
SALTS, HEAVY = 64, 20_000


def _double(h: np.ndarray, n: int) -> np.ndarray:
    after = h[n:]
    return (h[:-n] * np.uint64(0xC2B2AE3D27D4EB4F)) ^ (after + (after >> np.uint64(29)))


def anchors(parts: list[tuple[bytes, int, int]]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(part number, position, gram hash, context hash) of the anchors of each part's windows.

    ``parts``: (bytes, lo, hi), for the windows that start at lo to hi - 1. Every window of LENGTH bytes has the leftmost
    least GRAM-byte hash in it for its anchor, so equal windows have equal anchors at equal places. The
    context is all that can share a window with the anchor: LEFT bytes before it and LENGTH from it on, cut off at
    the text's ends.
    """
    pad = bytes(LENGTH)
    buf = np.frombuffer(pad + pad.join(raw for raw, _, _ in parts) + pad, np.uint8)
    starts = np.cumsum([LENGTH] + [len(raw) + LENGTH for raw, _, _ in parts])[:-1]
    value, windows = np.zeros(len(buf), np.uint16), np.zeros(len(buf) + 1, np.int8)
    for s, (raw, lo, hi) in zip(starts, parts):
        value[s : s + len(raw)] = 1
        windows[s + lo] += 1
        windows[s + hi] -= 1
    h = mix((value + buf).astype(np.uint64))
    n = 1
    while n < GRAM:
        h = _double(h, n)
        n *= 2
    gram = mix(h)
    while n < 128:
        h = _double(h, n)
        n *= 2
    best = (gram & ~np.uint64(0xFFFFFFFF)) | np.arange(len(gram), dtype=np.uint64)
    span, n = LEFT + 1, 1
    while 2 * n <= span:
        best = np.minimum(best[:-n], best[n:])
        n *= 2
    if span > n:
        best = np.minimum(best[: -(span - n)], best[span - n :])
    first = np.flatnonzero(np.cumsum(windows, dtype=np.int8)[: len(best)] > 0)
    at = (best[first] & np.uint64(0xFFFFFFFF)).astype(np.int64)
    which = np.searchsorted(starts, first, side="right") - 1
    new = np.append(True, (at[1:] != at[:-1]) | (which[1:] != which[:-1])) if len(at) else np.zeros(0, bool)
    at, which = at[new], which[new]
    k = np.uint64(0x9E3779B97F4A7C15)
    context = mix((h[at - LEFT] * k ^ h[at - LEFT + 128]) * k ^ h[at + LENGTH - 128])
    return which, at - starts[which], gram[at], context


def _cut(raw: bytes):
    """(offset, part) of a text's windows: parts of SLICE bytes with all the bytes that their anchors' contexts reach."""
    for a in range(0, len(raw) - LENGTH + 1, SLICE):
        left = max(0, a - 2 * LENGTH)
        yield left, (raw[left : a + SLICE + 2 * LENGTH], a - left, min(a + SLICE, len(raw) - LENGTH + 1) - left)


_ANCHOR = "h bigint, c bigint, dk bigint, pos int, again boolean, first boolean"


def _anchor_rows(batches):
    """The anchors of each text. ``again``: the same context is in this batch of texts too; ``first``: the first of those.

    Only the first ones need to be compared with other batches, which thins out very frequent contexts before the shuffle.
    """
    held, parts, size, last = [], [], 0, (-1, -1)  # parts: text number, its key, offset, part

    def hash_parts():
        nonlocal last
        part, pos, gram, context = anchors([p[3] for p in parts])
        text, key, offset = (np.array([p[c] for p in parts], np.int64)[part] for c in range(3))
        pos = pos + offset
        # the last anchor of a slice can be the first one of the next slice of its text
        new = (np.append(last[0], text[:-1]) != text) | (np.append(last[1], pos[:-1]) != pos)
        last = int(text[-1]), int(pos[-1])
        held.append((gram[new].view(np.int64), context[new].view(np.int64), key[new], pos[new].astype(np.int32)))
        parts.clear()

    def thinned():
        gram, context, key, pos = (np.concatenate(c) for c in zip(*held))
        held.clear()
        order = np.lexsort((context, gram))
        like = (gram[order][1:] == gram[order][:-1]) & (context[order][1:] == context[order][:-1])
        again, first = np.zeros(len(order), bool), np.ones(len(order), bool)
        first[order[1:]] = ~like
        again[order[1:]] = like
        again[order[:-1]] |= like
        for at in range(0, len(order), 50_000):
            on = slice(at, at + 50_000)
            yield pa.RecordBatch.from_arrays([pa.array(x[on]) for x in (gram, context, key, pos, again, first)], ["h", "c", "dk", "pos", "again", "first"])

    texts = 0
    for batch in batches:
        for part in pieces(batch, 1, 1 << 20):
            for key, text in zip(part.column(0).to_pylist(), part.column(1).to_pylist()):
                texts += 1
                for offset, cut in _cut((text or "").encode("utf-8", "surrogatepass")):
                    parts.append((texts, key, offset, cut))
                    size += len(cut[0]) + LENGTH
                    if size >= SLICE:
                        hash_parts()
                        size = 0
            if sum(len(x[0]) for x in held) >= THIN:
                yield from thinned()
    if parts:
        hash_parts()
    if held:
        yield from thinned()


_MARK = "h bigint, c bigint, dk bigint, pos int, covered boolean, ask boolean, own boolean"


def _marks(batches):
    """From first anchors sorted by (h, c): those that repeat.

    ``covered``: the whole context occurs again, in another batch only. ``ask``: the last of each context, where the
    gram has other contexts, as a salted gram is taken to have; ``own``: it occurs nowhere else. A stream: besides a
    batch only its last row is held, however often a gram occurs.
    """
    held = None  # last row, whether the row before it is like it, first context of its gram
    for batch in batches:
        if not batch.num_rows:
            continue
        cols = [batch.column(i).to_numpy(zero_copy_only=False) for i in range(6)]
        if held:
            cols = [np.concatenate([np.array([a], dtype=b.dtype), b]) for a, b in zip(held[0], cols)]
        h, c, dk, pos, again, salt = cols
        same_h = (h[1:] == h[:-1]) & (salt[1:] == salt[:-1])
        same = same_h & (c[1:] == c[:-1])
        before = np.append(held[1] if held else False, same)
        begin = np.maximum.accumulate(np.where(np.append(True, ~same_h), np.arange(len(h)), 0))
        first = c[begin]
        if held:
            first = np.where(begin == 0, held[2], first)
        whole = before[:-1] | same | again[:-1]
        ask = ~same & ((same_h & ~same) | (first[:-1] != c[:-1]) | (salt[:-1] > 0))
        yield _mark_rows(h[:-1], c[:-1], dk[:-1], pos[:-1], whole & ~again[:-1], ask, ~whole)
        held = [x[-1] for x in cols], bool(before[-1]), first[-1]
    if held:
        (h, c, dk, pos, again, salt), before, first = held
        whole = before or bool(again)
        yield _mark_rows(*(np.array([x]) for x in (h, c, dk, pos, whole and not again, first != c or salt > 0, not whole)))


def _mark_rows(h, c, dk, pos, covered, ask, own):
    on = covered | ask
    return pa.RecordBatch.from_arrays([pa.array(x[on]) for x in (h, c, dk, pos.astype(np.int32), covered, ask, own)], ["h", "c", "dk", "pos", "covered", "ask", "own"])


_CONTEXT = "h bigint, dk bigint, pos int, own boolean, before binary, after binary"


def _contexts(batches):
    """The context bytes of the asked-for anchors of each text; ``before`` runs backwards. Of equal rows, which are in one task, only the first counts."""
    seen = set()
    for batch in batches:
        for part in pieces(batch, 1):
            out = []
            for key, text, marks in zip(*(part.column(i).to_pylist() for i in range(3))):
                if key in seen:
                    continue
                seen.add(key)
                raw = (text or "").encode("utf-8", "surrogatepass")
                out += [(m["h"], key, m["pos"], m["own"], raw[max(0, m["pos"] - LEFT) : m["pos"]][::-1], raw[m["pos"] : m["pos"] + LENGTH]) for m in marks]
            cols = list(zip(*out)) if out else [()] * 6
            types = (pa.int64(), pa.int64(), pa.int32(), pa.bool_(), pa.binary(), pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types)], ["h", "dk", "pos", "own", "before", "after"])


def lce(a: bytes, b: bytes) -> int:
    """Length of the common prefix."""
    n = min(len(a), len(b))
    if a[:n] == b[:n]:
        return n
    x = int.from_bytes(a[:n], "big") ^ int.from_bytes(b[:n], "big")
    return n - (x.bit_length() + 7) // 8


def intervals(lcp: list[int]):
    """(depth, first, last) of each interval of a suffix array's LCP tree, children before parents: one stack scan."""
    stack = [(0, 0)]
    for i, depth in enumerate([*lcp, 0], 1):
        left = i - 1
        while stack[-1][0] > depth:
            top, left = stack.pop()
            yield top, left, i - 1
        if stack[-1][0] < depth:
            stack.append((depth, left))


def repeats(members: list[tuple], length: int = LENGTH):
    """(dk, start, end, repeat) for each maximal repeat of ``length`` bytes or more through one anchor.

    ``members``: (dk, pos, own, before, after). Sorted by what follows, they are a sparse suffix array; an interval
    of its LCP tree is a set of anchors that share ``depth`` bytes onwards. Within it, sorted by what
    precedes, neighbours show how far each extends to the left with another one; where all agree to the end
    there is no left diversity and that is the whole extension. All occurrences with ``own`` are reported.
    """
    members = sorted(members, key=lambda m: m[4])
    lcp = [lce(a[4], b[4]) for a, b in zip(members, members[1:])]
    best = [-1] * len(members)
    for depth, lo, hi in intervals(lcp):
        group = range(lo, hi + 1)
        if depth + LEFT < length or not any(members[i][2] and best[i] < LEFT for i in group):
            continue
        order = sorted(group, key=lambda i: members[i][3])
        whole = lce(members[order[0]][3], members[order[-1]][3])
        if whole == len(members[order[0]][3]) == len(members[order[-1]][3]):
            extent = [whole] * len(order)
        else:
            near = [lce(members[i][3], members[j][3]) for i, j in zip(order, order[1:])]
            extent = [max(a, b) for a, b in zip([0, *near], [*near, 0])]
        for i, left in zip(order, extent):
            dk, pos, own, before, after = members[i]
            if own and left > best[i]:
                best[i] = left
                if left + depth >= length:
                    yield dk, pos, pos - left, pos + depth, xxhash.xxh64_intdigest(before[:left][::-1] + after[:depth]) - (1 << 63)


def groups_of(members: list[tuple], length: int = LENGTH):
    """(repeat, left, depth, [(dk, pos), ...]) for each maximal repeat of ``length`` bytes or more through one anchor.

    The same scan as in ``repeats``, with every group whole: in each interval of the tree a second tree over what precedes
    gives the sets that agree further to the left than any larger set does (left diversity); a set within one
    child interval extends further to the right, and is reported there.
    """
    members = sorted(members, key=lambda m: m[4])
    lcp = [lce(a[4], b[4]) for a, b in zip(members, members[1:])]
    for depth, lo, hi in intervals(lcp):
        if depth + LEFT < length:
            continue
        child = dict(zip(range(lo, hi + 1), accumulate([0, *(x == depth for x in lcp[lo:hi])])))
        order = sorted(range(lo, hi + 1), key=lambda i: members[i][3])
        near = [lce(members[i][3], members[j][3]) for i, j in zip(order, order[1:])]
        for left, a, b in [*intervals(near), *([] if min(near) else [(0, 0, len(near))])]:
            found = order[a : b + 1]
            if left + depth >= length and len({child[i] for i in found}) > 1:
                text = members[found[0]][3][:left][::-1] + members[found[0]][4][:depth]
                if left not in anchors([(text, 0, len(text) - length + 1)])[1]:
                    continue  # the gram is an anchor only with what surrounds some occurrences: another one has them all
                yield xxhash.xxh64_intdigest(text) - (1 << 63), left, depth, [members[i][:2] for i in found]


_SPAN = "dk bigint, pos int, start int, stop int, repeat bigint"


def _spans(whole: bool):
    """Tree scans of the groups of a stream sorted by key.

    ``whole``: every maximal repeat with all its occurrences, else only the spans that make one of them longer.
    """

    def scan(members):
        if len(members) < 2:
            return []
        if whole:
            return [(dk, pos, pos - left, pos + depth, name) for name, left, depth, at in groups_of(members) for dk, pos in at]
        return list(repeats(members))

    def run(batches):
        key, members, out = None, [], []
        for k, part in groups(batches, 0):
            if k != key:
                out += scan(members)
                key, members = k, []
            if len(out) > 20_000:
                yield _span_rows(out)
                out = []
            members += zip(*(part.column(i).to_pylist() for i in range(1, 6)))
        yield _span_rows(out + scan(members))

    return run


def _span_rows(rows):
    cols = list(zip(*rows)) if rows else [()] * 5
    types = (pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.int64())
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types)], ["dk", "pos", "start", "stop", "repeat"])


def _case_keys(batches):
    """(key, dk, pos, own) of each context, for each of its cases: a key is the gram and what must agree around it.

    A repeat of LENGTH bytes through a gram has x more bytes after it than the gram's own, and LEFT - x before it, at
    least, for some x from 0 to LEFT. In case j, x is in the j-th of CASES ranges: all occurrences agree on the
    range's least number of bytes after the gram, and before it on LEFT less the greatest. A key's lowest bits are its j.
    """
    for batch in batches:
        keys, take = [], []
        h, before, after = (batch.column(c).to_pylist() for c in (0, 4, 5))
        for i, (g, b, a) in enumerate(zip(h, before, after)):
            for j, (least, beyond) in enumerate(zip(EDGES, EDGES[1:])):
                most = beyond - 1
                if len(a) >= GRAM + least and len(b) >= LEFT - most:
                    keys.append(xxhash.xxh64_intdigest(b"%d,%d," % (g, j) + b[: LEFT - most] + a[: GRAM + least]) // CASES * CASES + j - (1 << 63))
                    take.append(i)
        cols = [batch.column(c).take(pa.array(take, pa.int64())) for c in range(1, 4)]
        yield pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), *cols], ["h", "dk", "pos", "own"])


def _windows(batches):
    """The windows of contexts under case keys, for each x of the key's range, as spans; only those whose own anchor the gram is."""
    for batch in batches:
        for at in range(0, batch.num_rows, 64):
            found, parts = [], []
            for g, dk, pos, b, a in zip(*(batch.slice(at, 64).column(c).to_pylist() for c in (0, 1, 2, 4, 5))):
                for x in range(EDGES[g % CASES], EDGES[g % CASES + 1]):
                    if len(a) >= GRAM + x and len(b) >= LEFT - x:
                        window = b[: LEFT - x][::-1] + a[: GRAM + x]
                        found.append((dk, pos, pos - LEFT + x, pos + GRAM + x, xxhash.xxh64_intdigest(window) - (1 << 63)))
                        parts.append((window, 0, 1))
            if parts:
                place = anchors(parts)[1]
                yield _span_rows([f for f, n in zip(found, place) if n == f[1] - f[2]])


def keyed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    rows = docs.select(F.col(id_col).cast("bigint").alias("id"), F.col(text_col).cast("string").alias("text"))
    return rows.select("id", F.xxhash64("id", "text").alias("dk"), "text")


def _contexts_of(rows: DataFrame, asked: DataFrame) -> DataFrame:
    """The contexts of ``asked(h, dk, pos, own)``; the texts are dealt as they are for removal, so that Spark reuses the exchange."""
    by_text = asked.groupBy("dk").agg(F.collect_list(F.struct("h", "pos", "own")).alias("marks"))
    joined = rows.select("id", "dk", "text").join(by_text.hint("shuffle_hash"), "dk")
    return joined.select("dk", "text", "marks", "id").mapInArrow(_contexts, _CONTEXT)


def _scanned(rows: DataFrame, asked: DataFrame, hot: DataFrame, group_rows: int, whole: bool) -> DataFrame:
    """Spans of the anchors ``asked(h, dk, pos, own)`` by trees; the ``hot`` grams (h), with over ``group_rows`` contexts, are split.

    Only keys are shuffled for a split; contexts that share none of theirs drop out. Groups that a split leaves too large
    are split again, by a case for each place of the gram in a window: what agrees then is one window, an interval
    of the tree without branches, which is read off as a stream.
    """

    def scan(few):
        return _contexts_of(rows, few).repartition("h").sortWithinPartitions("h").mapInArrow(_spans(whole), _SPAN)

    if hot.isEmpty():
        return scan(asked)
    keyed = _contexts_of(rows, asked.join(hot, "h", "left_semi")).mapInArrow(_case_keys, "h bigint, dk bigint, pos int, own boolean")
    keyed = materialize(keyed, "repeat-cases")
    sizes = materialize(keyed.groupBy("h").count().where("count > 1"), "repeat-case-sizes")
    spans = scan(asked.join(hot, "h", "left_anti")).union(scan(keyed.join(sizes.where(F.col("count") <= group_rows), "h", "left_semi")))
    more = sizes.where(F.col("count") > group_rows)
    if more.isEmpty():
        return spans
    windows = materialize(_contexts_of(rows, keyed.join(more, "h", "left_semi")).mapInArrow(_windows, _SPAN), "repeat-windows")
    again = windows.groupBy("repeat").count().where("count > 1").select("repeat")
    return spans.union(windows.join(again, "repeat", "left_semi").select(spans.columns))


def repeat_spans(rows: DataFrame, group_rows: int = GROUP_ROWS) -> DataFrame:
    """(dk, start, stop, repeat): occurrences of maximal repeats; their union is every byte in a repeated window.

    ``rows(id, dk, text)``. Occurrences with equal ``repeat`` hold equal strings. A gram that holds over 1 / HEAVY of all
    anchors is dealt by salts of the context, so that no task reads it whole.
    """
    found = materialize(rows.select("dk", "text").mapInArrow(_anchor_rows, _ANCHOR), "repeat-anchors")
    firsts = found.where("first").select("h", "c", "dk", "pos", "again")
    heavy = firsts.groupBy("h").agg(F.count("*").alias("n")).where(F.col("n") > max(group_rows, found.count() // HEAVY)).select(F.col("h").alias("heavy"))
    salt = F.when(F.col("heavy").isNotNull(), 1 + F.pmod("c", F.lit(SALTS))).otherwise(0).cast("int")
    dealt = firsts.join(F.broadcast(heavy), F.col("h") == F.col("heavy"), "left").select("h", "c", "dk", "pos", "again", salt.alias("salt"))
    marks = materialize(dealt.repartition("h", "salt").sortWithinPartitions("h", "salt", "c").mapInArrow(_marks, _MARK), "repeat-marks")
    asked = marks.where("ask").select("h", "dk", "pos", "own")
    hot = materialize(asked.groupBy("h").count().where(F.col("count") > group_rows).select("h"), "repeat-hot")
    spans = _scanned(rows, asked, hot, group_rows, False).drop("pos")
    covered = marks.where("covered").select("dk", "pos", "c").union(found.where("again").select("dk", "pos", "c"))
    return spans.union(covered.select("dk", F.greatest(F.col("pos") - LEFT, F.lit(0)).alias("start"), (F.col("pos") + LENGTH).alias("stop"), F.col("c").alias("repeat")))


def repeat_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", group_rows: int = GROUP_ROWS) -> DataFrame:
    """(repeat, id, start, n_bytes): all occurrences of each maximal repeat of LENGTH bytes or more in whole texts, as UTF-8.

    A repeat is maximal within the reach of its anchor: LEFT bytes before it and LENGTH from it on, so a longer passage is a
    chain of overlapping groups, one an anchor. ``repeat`` is a hash of the string. Equal contexts are one leaf of
    the tree, expanded in the end. Near copies of a text form groups for each set of them that agrees further, so the
    output can be much larger than the input; ``remove_repeats`` needs only the spans that make an occurrence longer. A group
    of over ``group_rows`` contexts that share a window is given window by window. Null texts are empty; rows of equal id and
    text are an occurrence each. An empty table gives no rows.
    """
    rows = keyed(docs, id_col, text_col)
    rows = materialize(rows.select("id", "text").withColumn("dk", F.monotonically_increasing_id()), "group-rows")
    found = materialize(rows.select("dk", "text").mapInArrow(_anchor_rows, _ANCHOR).select("h", "c", "dk", "pos"), "group-anchors")
    leaves = found.groupBy("h", "c").agg(F.count("*").alias("n"), F.min(F.struct("dk", "pos")).alias("at"))
    leaves = materialize(leaves.select("h", "c", "n", "at.dk", "at.pos"), "group-leaves")
    # a leaf of several occurrences is two suffixes for the tree, so that it is an interval by itself too
    sizes = leaves.groupBy("h").agg(F.sum(F.least("n", F.lit(2))).alias("count"))
    twice = F.explode(F.when(F.col("n") > 1, F.array(F.lit(True), F.lit(True))).otherwise(F.array(F.lit(True)))).alias("own")
    asked = leaves.join(sizes.where("count > 1"), "h", "left_semi").select("h", "dk", "pos", twice)
    hot = materialize(sizes.where(F.col("count") > group_rows).select("h"), "group-hot")
    spans = _scanned(rows, asked, hot, group_rows, True).distinct()
    spans = spans.join(leaves.select("dk", "pos", "c"), ["dk", "pos"]).select("c", (F.col("start") - F.col("pos")).alias("start"), (F.col("stop") - F.col("pos")).alias("stop"), "repeat")
    at = found.join(spans, "c")
    at = at.select("dk", (F.col("pos") + F.col("start")).alias("start"), (F.col("stop") - F.col("start")).alias("n_bytes"), "repeat")
    return at.join(rows.select("dk", "id"), "dk").select("repeat", "id", "start", "n_bytes")


def merge(spans: list[tuple[int, int]], size: int) -> list[tuple[int, int]]:
    """Disjoint runs that cover the same bytes, in order; ends are cut off at ``size``."""
    out: list[list[int]] = []
    for a, b in sorted(spans):
        b = min(b, size)
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        elif b > a:
            out.append([a, b])
    return [(a, b) for a, b in out]


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", group_rows: int = GROUP_ROWS) -> DataFrame:
    """(id, kept binary, n_bytes, runs) of each row: whole texts, as UTF-8, without their repeated windows.

    A byte goes if any LENGTH-byte string over it also starts elsewhere, in this or another text; ``runs`` are the
    maximal removed [start, stop). Null text is empty; texts shorter than LENGTH never change. A repeated
    row is a copy like any other; equal rows share one set of spans. An empty table gives no rows.
    """
    rows = keyed(docs, id_col, text_col)
    spans = repeat_spans(rows, group_rows).groupBy("dk").agg(F.collect_set(F.struct("start", "stop")).alias("spans"))
    joined = rows.select("id", "dk", "text").join(spans.hint("shuffle_hash"), "dk", "left")

    def run(batches):
        for batch in batches:
            for part in pieces(batch, 1):
                kept, sizes, runs = [], [], []
                for text, spans in zip(part.column(1).to_pylist(), part.column(2).to_pylist()):
                    raw = (text or "").encode("utf-8", "surrogatepass")
                    gone = merge([(s["start"], s["stop"]) for s in spans or []], len(raw))
                    edges = [0, *(x for r in gone for x in r), len(raw)]
                    kept.append(b"".join(raw[a:b] for a, b in zip(edges[::2], edges[1::2])))
                    sizes.append(len(raw)), runs.append([list(r) for r in gone])
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(kept, pa.binary()), pa.array(sizes, pa.int64()), pa.array(runs, pa.list_(pa.list_(pa.int64())))], ["id", "kept", "n_bytes", "runs"])

    return joined.select("id", "text", "spans").mapInArrow(run, "id bigint, kept binary, n_bytes bigint, runs array<array<bigint>>")


def op1_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every whole text of ``documents`` without its repeated 200-byte strings, as counts and a digest; cases as in ``remove_repeats``."""
    out = remove_repeats(table(spark, sf_dir, "documents"))
    return out.select(
        F.col("id").alias("doc_id"),
        "n_bytes",
        (F.col("n_bytes") - F.octet_length("kept")).cast("bigint").alias("n_removed"),
        F.size("runs").cast("bigint").alias("n_spans"),
        F.sha2("kept", 256).alias("kept_sha256"),
    )
