"""Benchmark decontamination by the q-gram lemma in diagonal bands, verified by banded alignment."""

from __future__ import annotations

import re
from dataclasses import dataclass
from functools import reduce

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._common import pieces, table
from ._text import code_points, mix

Q = 8
#: Edits allowed for each character of a benchmark item, and the shortest normalised item that they are allowed in.
EDIT_RATE, MIN_CHARS = 0.1, 40
#: Characters of a text that are searched at once, and postings that are expanded at once.
SEGMENT, POSTINGS = 1 << 19, 1 << 20
#: Benchmark text that one pass holds in each task; a larger benchmark is searched in several passes.
PASS_BYTES = 8 << 20
SLOT_BITS = 20
_GAP = re.compile(r"[\W_]+")


def normalize(text: str | None) -> str:
    """Lower case; each run of other characters than letters and digits becomes one space."""
    return _GAP.sub(" ", (text or "").lower()).strip()


def grams(points: np.ndarray) -> np.ndarray:
    """Hash of each q-gram (Q is a power of two), at its start."""
    h = points.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    n, k = 1, np.uint64(0xC2B2AE3D27D4EB4F)
    while n < Q:
        h = (h[:-n] * k) ^ (h[n:] + (h[n:] >> np.uint64(29))) if len(h) > n else h[:0]
        n *= 2
    return mix(h)


@dataclass
class Items:
    """Benchmark items with an index of their q-grams: slots filters, keys sorted, postings by key.

    ``short``: those under MIN_CHARS, as whole words.
    """

    ids: list[int]
    texts: list[str]
    budget: np.ndarray
    need: np.ndarray
    slots: np.ndarray
    keys: np.ndarray
    first: np.ndarray
    item: np.ndarray
    at: np.ndarray
    short: list[tuple[int, str]]
    longest: int


def index(rows: list[tuple[int, str]]) -> Items:
    """A match with e edits keeps m - Q + 1 - Q e of an item's m - Q + 1 q-grams.

    An item's most frequent q-grams (over the benchmark) are left out of the index, as long as its
    requirement, lowered by one for each, stays at a quarter: the lemma then still misses nothing.
    """
    short, rows = [(i, t) for i, t in rows if 0 < len(t) < MIN_CHARS], [(i, t) for i, t in rows if len(t) >= MIN_CHARS]
    budget = np.array([min(int(EDIT_RATE * len(t)), (len(t) - Q) // Q) for _, t in rows], np.int64)
    hashes = [grams(code_points(t)) for _, t in rows]
    need = np.array([len(h) - Q * e for h, e in zip(hashes, budget)], np.int64)
    flat = np.concatenate([*hashes, np.zeros(0, np.uint64)])
    item = np.repeat(np.arange(len(rows)), [len(h) for h in hashes])
    at = np.concatenate([*(np.arange(len(h)) for h in hashes), np.zeros(0, int)]).astype(np.int64)
    _, inverse, count = np.unique(flat, return_inverse=True, return_counts=True)
    order = np.lexsort((at, -count[inverse], item)) if len(flat) else np.zeros(0, int)
    place = np.arange(len(flat)) - np.searchsorted(item[order], item[order])
    spare = need - np.maximum(1, -(-need // 4))
    keep = order[(place >= spare[item[order]]) | (count[inverse][order] == 1)]
    need = need - (np.bincount(item, minlength=len(rows)) - np.bincount(item[keep], minlength=len(rows)))
    keep = keep[np.argsort(flat[keep], kind="stable")]
    keys, first = np.unique(flat[keep], return_index=True)
    slots = np.zeros(1 << SLOT_BITS, bool)
    slots[(keys >> np.uint64(64 - SLOT_BITS)).astype(np.intp)] = True
    return Items([i for i, _ in rows], [t for _, t in rows], budget, need, slots, keys, np.append(first, len(keep)), item[keep], at[keep], short, max((len(t) for _, t in rows), default=0))


def banded_distance(item: str, region: str, low: int, high: int, limit: int) -> tuple[int, int]:
    """(edits, end) of the best match of a whole item in a region, over diagonals low to high.

    Start and end in the region are free. Edits are limit + 1 if there is no match within the limit.
    """
    at = region.find(item)
    if at >= 0:
        return 0, at + len(item)
    a, n, width = code_points(item), len(region), high - low + 1
    padded = np.zeros(len(a) + width + max(0, -low) + n + 1, np.uint32)
    shift = max(0, -low)
    padded[shift : shift + n] = code_points(region)
    ramp, big = np.arange(width), 1 << 30
    row = np.where((low + ramp >= 0) & (low + ramp <= n), 0, big)
    for i in range(len(a)):
        lo = low + i + shift
        window = padded[lo : lo + width] if lo >= 0 else np.zeros(width, np.uint32)
        new = row + (window != a[i])
        new[:-1] = np.minimum(new[:-1], row[1:] + 1)
        row = np.minimum.accumulate(new - ramp) + ramp
        end = low + i + 1 + ramp
        row = np.where((end >= 0) & (end <= n), row, big)
        if row.min() > limit:
            return limit + 1, -1
    best = int(row.argmin())
    return (int(row[best]), low + len(a) + best) if row[best] <= limit else (limit + 1, -1)


def _band_counts(points: np.ndarray, starts: np.ndarray, items: Items) -> tuple[np.ndarray, ...]:
    """(text, item, band, shared q-grams), sorted, of all bands of one step that hold any."""
    h = grams(points)
    pos = np.flatnonzero(items.slots[(h >> np.uint64(64 - SLOT_BITS)).astype(np.intp)])
    k = np.minimum(np.searchsorted(items.keys, h[pos]), len(items.keys) - 1)
    good = items.keys[k] == h[pos]
    pos, k = pos[good], k[good]
    n = items.first[k + 1] - items.first[k]
    doc = np.searchsorted(starts, pos, side="right") - 1
    bands, many = len(points) + 2 * items.longest + 1, len(items.ids)
    out, ends = [], np.cumsum(n)
    a = 0
    while a < len(pos):  # a frequent q-gram of a text may meet many postings
        b = max(a + 1, int(np.searchsorted(ends, (ends[a - 1] if a else 0) + POSTINGS, side="right")))
        m = n[a:b]
        post = np.repeat(items.first[k[a:b]] - np.cumsum(m) + m, m) + np.arange(m.sum())
        item = items.item[post]
        band = (np.repeat(pos[a:b] - starts[doc[a:b]] + items.longest, m) - items.at[post]) // (items.budget[item] + 1)
        out.append(_counted((np.repeat(doc[a:b], m) * many + item) * bands + band))
        if len(out) > 8:
            out = [_merged(out)]
        a = b
    cell, count = _merged(out)
    return cell // bands // many, cell // bands % many, cell % bands, count


def _counted(cells: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct numbers, sorted, with their counts."""
    low = cells.min()
    if cells.max() - low < 1 << 22:
        count = np.bincount(cells - low)
        at = np.flatnonzero(count)
        return at + low, count[at]
    return np.unique(cells, return_counts=True)


def _merged(parts: list[tuple]) -> tuple[np.ndarray, np.ndarray]:
    if not parts:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    cells, counts = (np.concatenate(x) for x in zip(*parts))
    order = cells.argsort(kind="stable")
    cells, counts = cells[order], counts[order]
    at = np.flatnonzero(np.append(True, cells[1:] != cells[:-1]))
    return cells[at], np.add.reduceat(counts, at)


def matches(texts: list[str], items: Items) -> list[tuple[int, int, int, int]]:
    """(text number, item number, edits, end) of each item found in each normalised text, at its best.

    Texts of over SEGMENT characters are searched in parts that overlap by more than any match's length.
    Items under MIN_CHARS, numbered after the others, are found as whole words, without edits.
    """
    found = {}
    if items.short:
        words = ahocorasick.Automaton()
        for i, (_, t) in enumerate(items.short):
            words.add_word(f" {t} ", [*words.get(f" {t} ", []), i])
        words.make_automaton()
        for d, t in enumerate(texts):
            for end, which in words.iter(f" {t} "):
                for i in which:
                    found.setdefault((d, len(items.ids) + i), (0, end - 1))
    if items.ids:
        overlap = items.longest + int(items.budget.max()) + Q
        parts = [(d, a, t[a : a + SEGMENT + overlap]) for d, t in enumerate(texts) for a in range(0, max(1, len(t)), SEGMENT)]
        while parts:
            take, size = 0, 0
            while take < len(parts) and (not take or size + len(parts[take][2]) <= 2 * SEGMENT):
                size += len(parts[take][2])
                take += 1
            for (p, i), (e, end) in _best([t for _, _, t in parts[:take]], items).items():
                d, a, _ = parts[p]
                found[d, i] = min(found.get((d, i), (1 << 30, 0)), (e, a + end))
            del parts[:take]
    return [(d, i, e, end) for (d, i), (e, end) in sorted(found.items())]


def _best(texts: list[str], items: Items) -> dict[tuple[int, int], tuple[int, int]]:
    """{(text number, item number): (edits, end)} at the fewest edits, then the first end."""
    points = code_points("\0".join(texts) + "\0")
    starts = np.concatenate([[0], np.cumsum([len(t) + 1 for t in texts])[:-1]])
    doc, item, band, count = _band_counts(points, starts, items)
    follows = np.zeros(len(doc), np.int64)  # bands overlap: each is two steps wide, one step apart
    if len(doc) > 1:
        adjacent = (doc[1:] == doc[:-1]) & (item[1:] == item[:-1]) & (band[1:] == band[:-1] + 1)
        follows[:-1][adjacent] = count[1:][adjacent]
    best: dict[tuple[int, int], tuple[int, int]] = {}
    for c in np.flatnonzero(count + follows >= items.need[item]):
        d, i = int(doc[c]), int(item[c])
        have = best.get((d, i), (1 << 30, -1))
        if have[0] == 0:
            continue
        text, b, e = items.texts[i], int(band[c]), int(items.budget[i])
        low = b * (e + 1) - items.longest
        low, high = low - e, low + 2 * (e + 1) + e
        a = max(0, low)
        edits, end = banded_distance(text, texts[d][a : high + len(text) + e], low - a, high - a, e)
        if edits <= e and (edits, a + end) < have:
            best[d, i] = edits, a + end
    return best


def _passes(bench: DataFrame, text_col: str, id_col: str) -> list[DataFrame]:
    """The benchmark cut, by a hash of its ids, into parts of about PASS_BYTES."""
    total = bench.agg(F.coalesce(F.sum(F.octet_length(F.col(text_col))), F.lit(0))).first()[0]
    n = -(-total // PASS_BYTES) or 1
    return [bench.where(F.pmod(F.xxhash64(id_col), F.lit(n)) == k) if n > 1 else bench for k in range(n)]


def benchmark_matches(docs: DataFrame, bench: DataFrame, text_col: str = "text", id_col: str = "doc_id", item_col: str = "item_id") -> DataFrame:
    """(id, item_id, edits, end_char) for each document and each benchmark item that it holds.

    A document holds an item if the whole item occurs in the whole text with at most EDIT_RATE edits a
    character, both normalised (case, punctuation and white space don't count); ``end_char`` is in the
    normalised text. Items under MIN_CHARS normalised characters are held where they occur as whole words, without edits;
    items that normalise to nothing are in no text. Null and empty
    texts hold nothing; repeated items and rows each give their rows. The benchmark's parts, of a
    size that is checked, are the only data that go to every task.
    """
    out = []
    for part in _passes(bench.where(F.col(text_col).isNotNull() & F.col(item_col).isNotNull()), text_col, item_col):
        items = index([(r[0], normalize(r[1])) for r in part.select(F.col(item_col).cast("bigint"), F.col(text_col).cast("string")).orderBy(item_col, text_col).collect()])

        def run(batches, items=items):
            for batch in batches:
                for part in pieces(batch, 1, 1 << 20):
                    found = matches([normalize(t) for t in part.column(1).to_pylist()], items)
                    ids = part.column(0).to_pylist()
                    names = [*items.ids, *(i for i, _ in items.short)]
                    cols = zip(*((ids[d], names[i], e, end) for d, i, e, end in found)) if found else ([], [], [], [])
                    yield pa.RecordBatch.from_arrays([pa.array(list(c), pa.int64()) for c in cols], ["id", "item_id", "edits", "end_char"])

        out.append(docs.select(F.col(id_col).cast("bigint").alias("id"), F.col(text_col).cast("string").alias("t")).mapInArrow(run, "id bigint, item_id bigint, edits bigint, end_char bigint"))
    return reduce(DataFrame.union, out)


def clean_rows(docs: DataFrame, bench: DataFrame, text_col: str = "text", item_col: str = "item_id") -> DataFrame:
    """The rows of ``docs`` that hold no benchmark item; columns unchanged, one pass over the rows each part."""
    at = docs.columns.index(text_col)
    for part in _passes(bench.where(F.col(text_col).isNotNull() & F.col(item_col).isNotNull()), text_col, item_col):
        items = index([(r[0], normalize(r[1])) for r in part.select(F.col(item_col).cast("bigint"), F.col(text_col).cast("string")).orderBy(item_col, text_col).collect()])

        def run(batches, items=items):
            for batch in batches:
                for part in pieces(batch, at, 1 << 20):
                    held = {m[0] for m in matches([normalize(t) for t in part.column(at).to_pylist()], items)}
                    yield part.filter(pa.array([i not in held for i in range(part.num_rows)])) if held else part

        docs = docs.mapInArrow(run, docs.schema)
    return docs


def op6_qgram_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every benchmark item that a whole text of ``documents`` holds, with its edits; cases as in ``benchmark_matches``."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return benchmark_matches(docs, table(spark, sf_dir, "benchmark")).withColumnRenamed("id", "doc_id")
