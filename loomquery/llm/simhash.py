"""Near-duplicate detection with SimHash fingerprints and pigeonring candidate chains."""

from __future__ import annotations

import re
from functools import reduce
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._common import groups, materialize, pieces, table
from ._text import mix
from .components import connected_components

SEED = 42
HAMMING = 3
SEGMENTS, WIDTH = 4, 16
#: Distinct fingerprints that one candidate bucket may hold in memory (16 bytes each); larger buckets take the refined keys.
BUCKET = 50_000


_SPACES = re.compile(rb"[\x09-\x0d\x20]+")
#: Shingles that are hashed at once.
HASHED = 1 << 15


def _digests(text: str | bytes | None, shingle: int):
    """Hashes of the word shingles of a whole text, repeats included, in arrays of HASHED at most; none for a text without words."""
    raw = text.encode("utf-8") if isinstance(text, str) else text or b""
    joined = _SPACES.sub(b" ", raw.lower()).strip(b" ")
    if not joined:
        return
    digest = xxhash.xxh64_intdigest
    gaps = np.flatnonzero(np.frombuffer(joined, np.uint8) == 32)
    n = max(1, len(gaps) + 2 - shingle)
    starts, ends = np.append(0, gaps + 1)[:n], np.append(gaps, len(joined))[-n:]
    for at in range(0, n, HASHED):
        pairs = zip(starts[at : at + HASHED].tolist(), ends[at : at + HASHED].tolist())
        yield np.array([digest(joined[a:b], SEED) for a, b in pairs], dtype="<u8")


class _Bits:
    """Counts how often each bit is set in hashes that are added."""

    def __init__(self):
        self.over, self.n = np.zeros(64, dtype=np.int64), 0

    def add(self, h: np.ndarray) -> np.ndarray:
        self.over += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
        self.n += len(h)
        return h

    def fingerprint(self) -> int:
        return int.from_bytes(np.packbits(2 * self.over > self.n, bitorder="little").tobytes(), "little")


def fingerprint(text: str | bytes | None, shingle: int = 3) -> int:
    """64-bit SimHash of the word shingles of a text, repeats included; zero for a text without words."""
    bits = _Bits()
    for h in _digests(text, shingle):
        bits.add(h)
    return bits.fingerprint()


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3) -> DataFrame:
    """(id, fp bigint) of every row, over whole texts; null and wordless texts get zero."""

    def run(batches):
        for batch in batches:
            for part in pieces(batch, 1):
                fps = np.array([fingerprint(t, shingle) for t in part.column(1).to_pylist()], dtype="<u8").view("<i8")
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(fps)], ["id", "fp"])

    return docs.select(F.col(id_col).cast("bigint").alias("id"), F.col(text_col).cast("string").alias("t")).mapInArrow(run, "id bigint, fp bigint")


def _chain_keys(fp):
    """Keys that any two fingerprints within 3 bits share at least one of.

    Ring of four 16-bit segments, budget 3: some segment i starts a chain whose first l segments
    differ in at most floor(3 l / 4) bits for every l, that is 0, 1, 2 and 3. So segment i is equal and
    the next differs in one bit at most, hence agrees on three of its four nibbles: 28 bits of key.
    """
    keys = []
    for i in range(SEGMENTS):
        r = F.shiftrightunsigned(fp, WIDTH * i).bitwiseOR(F.shiftleft(fp, 64 - WIDTH * i)) if i else fp
        own = r.bitwiseAND(F.lit(0xFFFF))
        after = F.shiftrightunsigned(r, WIDTH).bitwiseAND(F.lit(0xFFFF))
        for q in range(4):
            rest = after.bitwiseAND(F.lit(0xFFFF & ~(0xF << 4 * q)))
            keys.append(F.shiftleft(F.lit(i * 4 + q).cast("bigint"), 32).bitwiseOR(F.shiftleft(rest, 16)).bitwiseOR(own))
    return F.array(*keys)


_M = (1 << 64) - 1


def _masks(i: int) -> list[np.uint64]:
    """Bits of the first 2, 3 and 4 segments of the chain that starts at segment i."""
    seg = [0xFFFF << WIDTH * ((i + k) % SEGMENTS) for k in range(SEGMENTS)]
    return [np.uint64(reduce(int.__or__, seg[:k])) for k in (2, 3, 4)]


def _links(fps: np.ndarray, ids: list[int], start: int | None):
    """Spanning edges among the fingerprints of a bucket: each round links all unreached ones to one reached.

    start: the chain's first segment, whose proportional budgets prune before the full distance; None
    for refined keys, where only the full distance counts.
    """
    masks = [] if start is None else list(zip(_masks(start)[:2], (1, 2)))
    left = np.arange(len(fps))
    while left.size > 1:
        queue, left = [left[0]], left[1:]
        while queue and left.size:
            at = queue.pop()
            x = fps[left] ^ fps[at]
            near = np.bitwise_count(x) <= HAMMING
            for m, budget in masks:
                near &= np.bitwise_count(x & m) <= budget
            for j in left[near]:
                queue.append(j)
                yield ids[at], ids[j]
            left = left[~near]


def _bucket_edges(limit: int, chained: bool):
    """Streams buckets sorted by key; one that outgrows the limit is passed on whole instead (kind 1)."""

    def run(batches):
        key, ids, fps, spilled = None, [], [], False

        def close():
            if spilled or len(ids) < 2:
                return []
            start = int(key) >> 34 if chained else None
            return list(_links(np.array(fps, dtype="<i8").view("<u8"), ids, start))

        def edges(pairs):
            if pairs:
                a, b = zip(*pairs)
                yield pa.RecordBatch.from_arrays([pa.array([0] * len(a), pa.int32()), pa.array(a, pa.int64()), pa.array(b, pa.int64()), pa.array([None] * len(a), pa.int64())], ["kind", "a", "b", "fp"])

        def over():
            if ids:
                yield pa.RecordBatch.from_arrays([pa.array([1] * len(ids), pa.int32()), pa.array(ids, pa.int64()), pa.array([int(key)] * len(ids), pa.int64()), pa.array(fps, pa.int64())], ["kind", "a", "b", "fp"])
                ids.clear(), fps.clear()

        out = []
        for k, part in groups(batches, 0):
            if k != key:
                if spilled:
                    yield from over()
                out += close()
                if len(out) > 10_000:
                    yield from edges(out)
                    out = []
                key, ids, fps, spilled = k, [], [], False
            ids += part.column(1).to_pylist()
            fps += part.column(2).to_pylist()
            if limit and len(ids) > limit:
                spilled = True
            if spilled:
                yield from over()
        if spilled:
            yield from over()
        out += close()
        yield from edges(out)

    return run


_EDGE = "kind int, a bigint, b bigint, fp bigint"


def hamming_edges(reps: DataFrame, bucket: int = BUCKET) -> DataFrame:
    """Edges (src, dst) that connect exactly what links at 3 bits or fewer connect.

    ``reps(id, fp)`` has one row for each distinct fingerprint. A bucket of more than ``bucket`` rows
    is refined: the 36 free bits fall into 12 blocks of 3, any pair agrees on 9 of them, so each of 220
    keys fixes all but 9 bits and a refined bucket can hold 512 distinct fingerprints at most.
    """
    keyed = reps.select(F.explode(_chain_keys(F.col("fp"))).alias("key"), "id", "fp")
    found = materialize(keyed.repartition("key").sortWithinPartitions("key").mapInArrow(_bucket_edges(bucket, True), _EDGE), "simhash-edges")
    edges = found.where("kind = 0").select(F.col("a").alias("src"), F.col("b").alias("dst"))
    large = found.where("kind = 1")
    if large.isEmpty():
        return edges
    refined = []
    for i in range(SEGMENTS):
        for q in range(4):
            fixed = 0xFFFF << WIDTH * i | (0xFFFF & ~(0xF << 4 * q)) << WIDTH * ((i + 1) % SEGMENTS)
            free = [b for b in range(64) if not fixed >> b & 1]
            blocks = [reduce(int.__or__, (1 << b for b in free[3 * k : 3 * k + 3])) for k in range(12)]
            masks = [_M & ~reduce(int.__or__, dropped) for dropped in combinations(blocks, 3)]
            signed = [m - (1 << 64) if m >> 63 else m for m in masks]
            key = F.explode(F.array(*[F.xxhash64(F.lit(n), F.col("b"), F.col("fp").bitwiseAND(F.lit(m))) for n, m in enumerate(signed)])).alias("key")
            refined.append(large.where(F.shiftright("b", 32) == i * 4 + q).select(key, F.col("a").alias("id"), "fp"))
    more = reduce(DataFrame.union, refined).repartition("key").sortWithinPartitions("key").mapInArrow(_bucket_edges(0, False), _EDGE)
    return edges.union(more.select("a", "b"))


def simhash_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3, bucket: int = BUCKET) -> DataFrame:
    """(id, fp, component) of every row: near-duplicate groups of whole texts.

    Equal fingerprints are one class with its smallest id for a representative; only classes enter the
    candidate search, so thousands of copies cost one row there. Rows with a null id take part with
    their fingerprint's component. An empty table gives no rows; repeated rows each get a result.
    """
    fps = materialize(fingerprints(docs, id_col, text_col, shingle), "simhash-fp")
    reps = fps.groupBy("fp").agg(F.min("id").alias("id"))
    reps = materialize(reps, "simhash-classes")
    parts = connected_components(hamming_edges(reps.where("id is not null"), bucket))
    named = reps.join(parts, reps.id == parts.node, "left").select("fp", F.coalesce("component", "id").alias("component"))
    return fps.join(named, "fp", "left").select("id", "fp", "component")


#: Band keys of a set, and the min-wise hashes that each is made of.
BANDS, ROWS = 20, 6
#: Bins of a sketch: a byte of the least hash in each, 0 where there is none.
BINS = 512
#: Bits that texts of similarity 0.8 or more and few repeats differ in at most: 9.7 are expected, with a deviation of 2.9. Not a filter of
#: ``wide_edges``: texts of one shingle set differ in more if one repeats a line.
WIDE_HAMMING, WIDE_SEGMENTS = 24, 8
#: Deviations that an estimate must lie off the threshold to decide; nearer ones are settled by the texts.
DEVIATIONS = 4
#: Rows of a band key that a probe is compared with in one task at once.
CHUNK = 2000


def _shingle_hashes(text: str | bytes | None, shingle: int) -> np.ndarray:
    """Distinct hashes of the word shingles of a whole text, as ``fingerprint`` takes them."""
    return np.unique(np.concatenate([np.zeros(0, np.uint64), *_digests(text, shingle)]))


def _bands(least: np.ndarray) -> np.ndarray:
    """One key a band from the minima of a set."""
    rows, key = mix(least).reshape(BANDS, ROWS), np.arange(BANDS, dtype=np.uint64)
    for c in range(ROWS):
        key = mix(key * np.uint64(0x9E3779B97F4A7C15) + rows[:, c])
    return key


def _sketch(h: np.ndarray) -> bytes:
    """One byte, never 0, of the least of the sorted hashes in each of BINS ranges; a small set is there nearly whole."""
    out, bins = np.zeros(BINS, np.uint8), (h >> np.uint64(65 - BINS.bit_length())).astype(np.intp)
    first = np.flatnonzero(np.append(True, bins[1:] != bins[:-1]))
    out[bins[first]] = 1 + mix(h[first]) % np.uint64(255)
    return out.tobytes()


def sketches(docs: DataFrame, id_col: str, text_col: str, shingle: int) -> DataFrame:
    """(id, fp, cls, bands, sketch) of every row; one pass over the shingles gives all of them.

    cls: hash of the whole shingle set, so that texts of one class are at similarity 1.
    """

    def run(batches):
        rng = np.random.default_rng(SEED)
        flip, odd = rng.integers(0, 1 << 64, (2, BANDS * ROWS, 1), dtype=np.uint64)
        odd |= np.uint64(1)
        for batch in batches:
            for part in pieces(batch, 1, 1 << 20):
                fps, classes, bands, kept = [], [], [], []
                for t in part.column(1).to_pylist():
                    bits = _Bits()
                    h = np.unique(np.concatenate([np.zeros(0, np.uint64), *(bits.add(x) for x in _digests(t, shingle))]))
                    fps.append(bits.fingerprint())
                    classes.append(xxhash.xxh64_intdigest(h.tobytes(), SEED))
                    if not len(h):
                        bands.append([]), kept.append(b"")
                        continue
                    least = np.full(BANDS * ROWS, (1 << 64) - 1, dtype=np.uint64)
                    for at in range(0, len(h), 1024):
                        mixed = h[at : at + 1024] ^ flip
                        mixed *= odd
                        np.minimum(least, mixed.min(axis=1), out=least)
                    bands.append(_bands(least).view("<i8").tolist()), kept.append(_sketch(h))
                numbers = [pa.array(np.array(x, dtype="<u8").view("<i8")) for x in (fps, classes)]
                arrays = [part.column(0), *numbers, pa.array(bands, pa.list_(pa.int64())), pa.array(kept, pa.binary())]
                yield pa.RecordBatch.from_arrays(arrays, ["id", "fp", "cls", "bands", "sketch"])

    rows = docs.select(F.col(id_col).cast("bigint").alias("id"), F.col(text_col).cast("string").alias("t"))
    return rows.mapInArrow(run, "id bigint, fp bigint, cls bigint, bands array<bigint>, sketch binary")


def _chain_within(x: np.ndarray, budget: int) -> np.ndarray:
    """Pigeonring test of fingerprint differences: some chain of segments stays within its share of the budget throughout."""
    n = np.bitwise_count(x[:, None] >> (np.arange(WIDE_SEGMENTS, dtype=np.uint64) * np.uint64(64 // WIDE_SEGMENTS)) & np.uint64((1 << 64 // WIDE_SEGMENTS) - 1)).astype(np.int64)
    share = np.arange(1, WIDE_SEGMENTS + 1) * budget // WIDE_SEGMENTS
    return np.any([np.all(np.cumsum(np.roll(n, -i, axis=1), axis=1) <= share, axis=1) for i in range(WIDE_SEGMENTS)], axis=0)


_PAIR = "src bigint, dst bigint, sure boolean"


def _estimates(similarity: float):
    """(src, dst, sure) of the pairs that may have the similarity, by their sketches alone: fingerprints count repeats, similarity does not."""

    def run(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 2048):
                part = batch.slice(at, 2048)
                a, b = (np.frombuffer(b"".join(part.column(c).to_pylist()), dtype=np.uint8).reshape(-1, BINS) for c in (2, 3))
                may, sure = _decided(a, b, similarity)
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(sure)], ["src", "dst", "sure"]).filter(pa.array(may))

    return run


def _decided(a: np.ndarray, b: np.ndarray, similarity: float) -> tuple[np.ndarray, np.ndarray]:
    """Whether pairs of sketches may have the similarity, and whether they have it beyond doubt.

    The k bins that either fills are a sample of the n hashes in either set, without replacement; bytes of
    different hashes are equal by a chance of 1 in 255. DEVIATIONS are taken at the threshold, and one hash more.
    """
    k = np.maximum(((a != 0) | (b != 0)).sum(axis=1), 1)
    both, same = ((a != 0) & (b != 0)).sum(axis=1), ((a == b) & (a != 0)).sum(axis=1)
    estimate = (same - both / 255) / (1 - 1 / 255) / k
    n = np.maximum(-BINS * np.log(np.maximum(1 - k / BINS, 1e-9)), k)
    spread = similarity * (1 - similarity) / k * (1 - k / n) + (1 - similarity) / (255 * k)
    margin = DEVIATIONS * np.sqrt(spread) + 1 / k
    return estimate >= similarity - margin, estimate >= similarity + margin


def _linked(found: DataFrame, docs: DataFrame, id_col: str, text_col: str, shingle: int, similarity: float) -> DataFrame:
    """Edges (src, dst) among ``found(src, dst, sure)``: the others by the whole texts."""
    close = found.where("not sure").select("src", "dst")
    whole = docs.select(F.col(id_col).cast("bigint").alias("id"), F.col(text_col).cast("string").alias("t"))
    whole = whole.join(close.select(F.explode(F.array("src", "dst")).alias("id")), "id", "left_semi").groupBy("id").agg(F.min("t").alias("t"))
    text = lambda c, n: whole.select(F.col("id").alias(c), F.col("t").alias(f"t{n}"))
    exact = close.join(text("src", 1), "src").join(text("dst", 2), "dst").select("src", "dst", "t1", "t2")

    def verify(batches):
        for batch in batches:
            keep = []
            for i in range(batch.num_rows):
                a, b = (_shingle_hashes(batch.column(c)[i].as_py(), shingle) for c in (2, 3))
                common = len(np.intersect1d(a, b, assume_unique=True))
                keep.append(common >= similarity * (len(a) + len(b) - common) > 0)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], ["src", "dst"]).filter(pa.array(keep, pa.bool_()))

    return found.where("sure").select("src", "dst").union(exact.mapInArrow(verify, "src bigint, dst bigint"))


def wide_edges(reps: DataFrame, docs: DataFrame, id_col: str, text_col: str, shingle: int, similarity: float, also: DataFrame | None = None) -> DataFrame:
    """Edges (src, dst) between texts whose shingle sets have the given Jaccard similarity or more.

    ``reps(id, bands, sketch)`` has one row for each distinct shingle set. Candidates are rows that share a band key,
    which a pair at 0.8 does with probability 0.998, and the pairs of ``also(src, dst)``. First all rows
    that share a key are compared with one of them, another one for each key: a group gives a star of
    edges a band. Then the rows of a key that are not yet connected are compared with each other, so each pair that
    shares a key is compared or connected. Sketches decide clear cases, whole texts the others.
    """
    keyed = reps.select(F.explode("bands").alias("key"), "id")
    hubs = keyed.groupBy("key").agg(F.min_by("id", F.xxhash64("key", "id")).alias("hub"), F.count("*").alias("n")).where("n > 1").drop("n")
    pairs = keyed.join(hubs, "key").where("id <> hub").select(F.least("id", "hub").alias("src"), F.greatest("id", "hub").alias("dst"))
    pairs = (pairs.union(also.select(F.least("src", "dst"), F.greatest("src", "dst"))) if also is not None else pairs).distinct()
    side = lambda c, n: reps.select(F.col("id").alias(c), F.col("sketch").alias(f"sketch{n}"))
    both = pairs.join(side("src", 1), "src").join(side("dst", 2), "dst").select("src", "dst", "sketch1", "sketch2")
    found = materialize(both.mapInArrow(_estimates(similarity), _PAIR), "simhash-wide")
    stars = _linked(found, docs, id_col, text_col, shingle, similarity)
    parts = materialize(connected_components(stars), "simhash-parts")
    rest = materialize(_unconnected(reps, hubs, parts).mapInArrow(_cross(similarity), _PAIR), "simhash-cross")
    joined = parts.select(F.col("component").alias("src"), F.col("node").alias("dst"))
    return joined.union(_linked(rest, docs, id_col, text_col, shingle, similarity))


def _unconnected(reps: DataFrame, hubs: DataFrame, parts: DataFrame) -> DataFrame:
    """Rows (grp, probe, key, id, part, bands, sketch) of the keys whose rows, without the hub, are in several parts.

    A key's rows are dealt to chunks of about CHUNK; those outside its largest part go as probes to all of them.
    """
    named = reps.where(F.size("bands") > 0).join(parts, reps.id == parts.node, "left").select("id", "bands", "sketch", F.coalesce("component", "id").alias("part"))
    keyed = named.select(F.explode("bands").alias("key"), "id", "part").join(hubs, "key").where("id <> hub").drop("hub")
    sizes = keyed.groupBy("key", "part").agg(F.count("*").alias("n"))
    keys = sizes.groupBy("key").agg(F.max_by("part", F.struct("n", "part")).alias("big"), F.sum("n").alias("n"), F.count("*").alias("k")).where("k > 1")
    chunks = F.ceil(F.col("n") / CHUNK)
    rows = keyed.join(keys, "key").withColumn("chunks", chunks).drop("n", "k")
    own = rows.select("key", "id", "big", F.pmod(F.xxhash64("id"), "chunks").alias("chunk"), F.lit(False).alias("probe"))
    probes = rows.where("part <> big").select("key", "id", "big", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("chunks") - 1)).alias("chunk"), F.lit(True).alias("probe"))
    dealt = own.union(probes).join(named, "id").withColumn("grp", F.xxhash64("key", "chunk"))
    return dealt.select("grp", "probe", "key", "id", "part", F.col("part") == F.col("big"), "bands", "sketch").repartition("grp").sortWithinPartitions("grp", "probe")


def _cross(similarity: float):
    """(src, dst, sure) of pairs of a probe and a row of another part, at the first key that the two share.

    Parts that a sure pair connects are one from then on, so a group costs a pair for each part; only pairs in doubt that
    are still apart are given all.
    """

    def columns(batch):
        ints = [batch.column(c).to_numpy(zero_copy_only=False) for c in (2, 3, 4, 5)]
        bands = np.asarray(batch.column(6).flatten()).reshape(-1, BANDS)
        return [*ints, bands, np.frombuffer(b"".join(batch.column(7).to_pylist()), dtype=np.uint8).reshape(-1, BINS)]

    def run(batches):
        grp, held, index, label = None, [], None, {}

        def name(part):
            while label.get(part, part) != part:
                part = label[part]
            return part

        for g, part in groups(batches, 0):
            if g != grp:
                grp, held, index, label = g, [], None, {}
            probe = part.column(1).to_numpy(zero_copy_only=False)
            first = int((~probe).sum())  # rows of the chunk come before its probes
            if first:
                held.append(columns(part.slice(0, first)))
            if first == part.num_rows:
                continue
            index = index or [np.concatenate(x) for x in zip(*held)]
            _, ids, parts, big, bands, sketch = index
            sure_, doubt = [], []
            for key, i, own, _, b, s in zip(*columns(part.slice(first))):
                mine = name(int(own))
                at = np.flatnonzero((parts != mine) & (big | (ids > i)))  # two probes meet twice: once counts
                same = bands[at] == b
                at = at[same.any(axis=1) & (b[same.argmax(axis=1)] == key)]
                if not at.size:
                    continue
                may, sure = _decided(sketch[at], s, similarity)
                for other, j in dict(zip(parts[at[sure]].tolist(), at[sure].tolist())).items():
                    sure_.append((int(i), int(ids[j])))
                    label[other] = mine
                    parts[parts == other] = mine
                doubt += [(int(i), int(own), j) for j in at[may & ~sure].tolist()]
            doubt = [(i, int(ids[j])) for i, own, j in doubt if parts[j] != name(own)]
            rows = sure_ + doubt
            if rows:
                src, dst = zip(*rows)
                yield pa.RecordBatch.from_arrays([pa.array(src, pa.int64()), pa.array(dst, pa.int64()), pa.array([True] * len(sure_) + [False] * len(doubt))], ["src", "dst", "sure"])

    return run


def near_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 5, similarity: float = 0.8, bucket: int = BUCKET) -> DataFrame:
    """(id, fp, component) of every row: groups linked by shingle sets of the given similarity.

    Texts of equal shingle sets are one class. Fingerprints within 3 bits only give candidates, checked like
    those of the band keys. Nulls, repeated rows and empty tables as in ``simhash_components``.
    """
    rows = materialize(sketches(docs, id_col, text_col, shingle), "simhash-sketches")
    classes = materialize(rows.groupBy("cls").agg(F.min("id").alias("id")), "simhash-classes")
    reps = rows.join(classes.where("id is not null"), ["id", "cls"], "left_semi").groupBy("id", "cls").agg(*(F.first(c).alias(c) for c in ("fp", "bands", "sketch")))
    reps = materialize(reps.where(F.size("bands") > 0), "simhash-reps")
    firsts = reps.groupBy("fp").agg(F.min("id").alias("first"))
    near = hamming_edges(firsts.select(F.col("first").alias("id"), "fp"), bucket)
    near = near.union(reps.join(firsts, "fp").where("id <> first").select("first", "id"))
    parts = connected_components(wide_edges(reps, docs, id_col, text_col, shingle, similarity, near))
    named = classes.join(parts, classes.id == parts.node, "left").select("cls", F.coalesce("component", "id").alias("component"))
    return rows.select("id", "fp", "cls").join(named, "cls", "left").select("id", "fp", "component")


def op2_simhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprint and near-duplicate component of every row of ``documents``; cases as in ``simhash_components``."""
    out = simhash_components(table(spark, sf_dir, "documents"))
    return out.select(
        F.col("id").alias("doc_id"), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), F.col("component").alias("component_id")
    )
