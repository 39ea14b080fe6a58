"""Embedding near-duplicates with an inverted multi-index: product cells, multi-sequence traversal, exact check."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._common import materialize, table
from .components import connected_components

COSINE = 0.95
#: Vectors that codebooks are fitted on, at most, those that calibrate the traversal, and codewords of a half, at most.
FIT_ROWS, CALIBRATION, MAX_CODES = 20_000, 1000, 4096
#: Vectors that a cell aims at; members that one task holds of a cell (larger cells are cut, each part sees all visitors).
CELL_ROWS, PART_ROWS = 200, 4096
RECALL = 0.998


def unit(x: np.ndarray) -> np.ndarray:
    x = x.astype(np.float64)
    x /= np.abs(x).max(axis=1, keepdims=True)  # so that squares of very large or small components stay finite
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def _distances(x: np.ndarray, codes: np.ndarray) -> np.ndarray:
    return np.maximum((x * x).sum(1)[:, None] - 2 * x @ codes.T + (codes * codes).sum(1), 0)


def _codebook(x: np.ndarray, k: int, rounds: int = 10) -> np.ndarray:
    codes = x[np.linspace(0, len(x) - 1, k).astype(int)].copy()
    for _ in range(rounds):
        own = np.concatenate([_distances(x[i : i + 2048], codes).argmin(1) for i in range(0, len(x), 2048)])
        sums = np.zeros_like(codes)
        np.add.at(sums, own, x)
        n = np.bincount(own, minlength=k)
        codes[n > 0] = sums[n > 0] / n[n > 0, None]
    return codes


@dataclass
class MultiIndex:
    """A codebook for each half of the unit vectors of one dimension, and how many cells a vector visits."""

    first: np.ndarray
    second: np.ndarray
    visits: int

    def halves(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        cut = self.first.shape[1]
        return _distances(x[:, :cut], self.first), _distances(x[:, cut:], self.second)

    def home(self, x: np.ndarray) -> np.ndarray:
        a, b = self.halves(x)
        return a.argmin(1) * len(self.second) + b.argmin(1)

    def traverse(self, x: np.ndarray) -> np.ndarray:
        """The ``visits`` nearest cells of each row, nearest first.

        The multi-sequence order over both sorted lists: the pair of ranks (i, j), from 0, can only come among
        the first t if (i + 1)(j + 1) <= t, so these pairs alone are weighed.
        """
        t = self.visits
        a, b = self.halves(x)
        ia, ib = a.argsort(axis=1, kind="stable")[:, :t], b.argsort(axis=1, kind="stable")[:, :t]
        ranks = np.array([(i, j) for i in range(ia.shape[1]) for j in range(min(ib.shape[1], t // (i + 1)))])
        rows = np.arange(len(x))[:, None]
        pa_, pb = ia[:, ranks[:, 0]], ib[:, ranks[:, 1]]
        order = (a[rows, pa_] + b[rows, pb]).argsort(axis=1, kind="stable")[:, :t]
        return pa_[rows, order] * len(self.second) + pb[rows, order]


def fit(sample: np.ndarray, total: int, recall: float = RECALL, seed: int = 5) -> MultiIndex:
    """Codebooks from a sample of unit vectors; ``visits`` reaches the target recall at the threshold.

    Recall is measured on vectors turned by exactly the threshold angle in random directions, the hardest
    pairs that count: the share whose home cell is among the cells visited.
    """
    k = int(np.clip(round(np.sqrt(total / CELL_ROWS)), 1, min(MAX_CODES, len(sample))))
    cut = max(1, sample.shape[1] // 2)
    apart = CALIBRATION if len(sample) >= 4 * CALIBRATION else 0  # where there are enough, recall is measured on vectors that no codebook was fitted on
    model = MultiIndex(_codebook(sample[apart:, :cut], k), _codebook(sample[apart:, cut:], k), 1)
    x = sample[:CALIBRATION]
    noise = np.random.default_rng(seed).standard_normal(x.shape)
    noise -= (noise * x).sum(1)[:, None] * x
    norm = np.linalg.norm(noise, axis=1, keepdims=True)
    y = COSINE * x + np.sqrt(1 - COSINE**2) * noise / np.where(norm > 0, norm, 1)
    (a, b), home = model.halves(x), model.home(y)
    at = a[np.arange(len(x)), home // k] + b[np.arange(len(x)), home % k]
    rank = np.array([np.searchsorted(np.sort(bi), at_i - ai, side="right").sum() for ai, bi, at_i in zip(a, b, at)])
    model.visits = int(np.clip(np.quantile(rank, recall, method="higher"), 1, k * k))
    return model


_ROUTED = "cell bigint, kind int, id bigint, n bigint, home bigint, visited binary, vec binary"


def _route(models: dict[int, MultiIndex], dtype: str):
    """Each vector as a member of its home cell (kind 0) and as a visitor of the cells it traverses (kind 1)."""

    def run(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 1024):
                part = batch.slice(at, 1024)
                ids, n, vecs = (part.column(i).to_pylist() for i in range(3))
                dims = np.array([len(v) for v in vecs])
                for dim in np.unique(dims):
                    take = np.flatnonzero(dims == dim)
                    x = np.array([vecs[i] for i in take], dtype=dtype)
                    base = int(dim) << 32
                    if dim in models:
                        u = unit(x)
                        home, cells = base + models[dim].home(u), base + models[dim].traverse(u)
                    else:  # a dimension too rare for the sample: one cell
                        home, cells = np.full(len(x), base), np.full((len(x), 1), base)
                    out = []
                    for r, i in enumerate(take):
                        raw = x[r].tobytes()
                        out.append((home[r], 0, ids[i], n[i], home[r], cells[r].astype("<i8").tobytes(), raw))
                        out += [(c, 1, ids[i], n[i], home[r], None, raw) for c in cells[r]]
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(c, t) for c, t in zip(zip(*out), (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.binary()))],
                        ["cell", "kind", "id", "n", "home", "visited", "vec"],
                    )

    return run


def _spanning(linked: np.ndarray, left: np.ndarray, right: np.ndarray) -> list[tuple[int, int]]:
    """Edges that connect what a block of links (left x right ids) connects."""
    rows, cols = np.flatnonzero(linked.any(axis=1)), np.flatnonzero(linked.any(axis=0))
    if not len(rows):
        return []
    b, lr, lc = linked[np.ix_(rows, cols)], left[rows].copy(), right[cols].copy()
    big = np.iinfo(np.int64).max
    while True:
        nc = np.minimum(lc, np.where(b, lr[:, None], big).min(axis=0))
        nr = np.minimum(lr, np.where(b, nc[None, :], big).min(axis=1))
        if (nc == lc).all() and (nr == lr).all():
            break
        lr, lc = nr, nc
    pairs = {*zip(left[rows].tolist(), lr.tolist()), *zip(right[cols].tolist(), lc.tolist())}
    return [p for p in pairs if p[0] != p[1]]


_FOUND = "id bigint, n bigint, other bigint"


def _verify(dtype: str, threshold: float):
    """Links between the members and the visitors of each (cell, part), by cosine in double precision.

    A link between x and y is counted for x where x visits y's cell; where y does not visit x's home in turn,
    it is counted for y there too, so both ends count every link once.
    """

    def run(batches):
        key, members, packed = None, [], None
        found: list[tuple] = []
        for batch in batches:
            if not batch.num_rows:
                continue
            cell, part, kind = (batch.column(i).to_numpy() for i in range(3))
            cuts = np.flatnonzero((cell[1:] != cell[:-1]) | (part[1:] != part[:-1]) | (kind[1:] != kind[:-1])) + 1
            for a, b in zip([0, *cuts], [*cuts, batch.num_rows]):
                here = (cell[a], part[a])
                if here != key:
                    key, members, packed = here, [], None
                run_ = batch.slice(a, b - a)
                if kind[a] == 0:
                    members.append(run_)
                    continue
                if not members:
                    continue
                if packed is None:
                    m = pa.Table.from_batches(members)
                    packed = _unpack(m, dtype), np.array([np.frombuffer(v, "<i8") for v in m.column("visited").to_pylist()])
                (mi, mn, _, mx), visited = packed
                for at in range(0, run_.num_rows, 256):
                    vi, vn, vh, vx = _unpack(pa.Table.from_batches([run_.slice(at, 256)]), dtype)
                    linked = (vx @ mx.T >= threshold) & (vi[:, None] != mi[None, :])
                    if not linked.any():
                        continue
                    sums = linked @ mn
                    found += [(int(i), int(s), None) for i, s in zip(vi, sums) if s]
                    one_way = linked & ~(visited[None, :, :] == vh[:, None, None]).any(axis=2) if len(mi) * len(vi) * visited.shape[1] < 1 << 25 else _one_way(linked, visited, vh)
                    found += [(int(i), int(s), None) for i, s in zip(mi, vn @ one_way) if s]
                    found += [(x, 0, y) for x, y in _spanning(linked, vi, mi)]
            if len(found) > 20_000:
                yield _found(found)
                found = []
        yield _found(found)

    return run


def _one_way(linked: np.ndarray, visited: np.ndarray, homes: np.ndarray) -> np.ndarray:
    out = linked.copy()
    for h in np.unique(homes):
        out[np.ix_(homes == h, (visited == h).any(axis=1))] = False
    return out


def _found(rows: list[tuple]) -> pa.RecordBatch:
    cols = list(zip(*rows)) if rows else [()] * 3
    return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols], ["id", "n", "other"])


def _unpack(t: pa.Table, dtype: str):
    x = np.frombuffer(b"".join(t.column("vec").to_pylist()), dtype=dtype).reshape(t.num_rows, -1)
    return t.column("id").to_numpy(), t.column("n").to_numpy(), t.column("home").to_numpy(), unit(x)


def near_duplicates(vectors: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", threshold: float = COSINE, part_rows: int = PART_ROWS, recall: float = RECALL) -> DataFrame:
    """(id, n_links, component, kept) for each row.

    Equal vectors are one class, looked up once with its count; each class visits the cells nearest to it.
    Vectors that are null, empty, zero, or hold null or non-finite components have no links, nor have rows with
    a null id. Vectors of different dimensions never link. A repeated id counts as often as it
    occurs. An empty table gives no rows.
    """
    rows = vectors.select(F.col(id_col).cast("bigint").alias("id"), F.col(vec_col).alias("v"))
    double = "double" in dict(rows.dtypes)["v"]
    dtype = "<f8" if double else "<f4"
    rows = rows.withColumn("v", F.col("v").cast("array<double>" if double else "array<float>"))
    fine = F.expr("id is not null and size(v) > 0 and not exists(v, x -> x is null or isnan(x) or abs(x) = double('infinity')) and exists(v, x -> x <> 0)")
    keyed = materialize(rows.select("id", F.when(fine, F.col("v")).alias("v")).withColumn("h", F.when(F.col("v").isNotNull(), F.xxhash64("v"))), "vectors")
    classes = materialize(keyed.where("v is not null").groupBy("h", "v").agg(F.min("id").alias("rep"), F.count("*").alias("n")), "vector-classes")
    total = classes.count()
    sample = [np.asarray(r[0], np.float64) for r in classes.select("v").orderBy(F.xxhash64("rep"), "rep").limit(FIT_ROWS).collect()]
    dims = {len(v) for v in sample}
    models = {d: fit(unit(np.array([v for v in sample if len(v) == d])), total * sum(len(v) == d for v in sample) // len(sample), recall) for d in dims}
    routed = classes.select("rep", "n", "v").mapInArrow(_route(models, dtype), _ROUTED)
    routed = materialize(routed, "vector-cells")
    hot = materialize(routed.where("kind = 0").groupBy("cell").agg(F.ceil(F.count("*") / part_rows).cast("int").alias("parts")).where("parts > 1"), "vector-hot-cells")
    if hot.isEmpty():
        parted = routed.withColumn("part", F.lit(0))
    else:
        parts = F.coalesce("parts", F.lit(1))
        own = F.array(F.pmod(F.xxhash64("id"), parts).cast("int"))
        parted = routed.join(hot, "cell", "left").withColumn("part", F.explode(F.when(F.col("kind") == 0, own).otherwise(F.sequence(F.lit(0), parts - 1))))
    ordered = parted.repartition("cell", "part").sortWithinPartitions("cell", "part", "kind", "id")
    found = ordered.select("cell", "part", "kind", "id", "n", "home", "visited", "vec").mapInArrow(_verify(dtype, threshold), _FOUND)
    found = materialize(found, "vector-links")
    links = found.where("other is null").groupBy("id").agg(F.sum("n").alias("links"))
    parts = connected_components(found.where("other is not null").select(F.col("id").alias("src"), F.col("other").alias("dst")))
    named = classes.select("h", "v", "rep", "n").join(links, F.col("rep") == links.id, "left").drop("id").join(parts, F.col("rep") == F.col("node"), "left")
    named = named.select("h", F.col("v").alias("w"), (F.coalesce("links", F.lit(0)) + F.col("n") - 1).alias("n_links"), F.coalesce("component", "rep").alias("component"))
    out = keyed.alias("k").join(named.alias("c"), (F.col("k.h") == F.col("c.h")) & (F.col("k.v") == F.col("c.w")), "left")
    out = out.select("id", F.coalesce("n_links", F.lit(0)).cast("bigint").alias("n_links"), F.coalesce("component", "id").alias("component"))
    return out.withColumn("kept", F.col("id").eqNullSafe(F.col("component")))


def op8_multi_index_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links and component of every row of ``embeddings``, whatever its label; cases as in ``near_duplicates``."""
    out = near_duplicates(table(spark, sf_dir, "embeddings"))
    return out.select(F.col("id").alias("vec_id"), "n_links", F.col("component").alias("component_id"), "kept")
