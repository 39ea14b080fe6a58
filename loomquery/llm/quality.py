"""Quality selection by importance resampling with hashed n-gram models."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ._common import materialize, pieces, table
from ._text import mix, word_hashes

#: Hash buckets: few enough for one array a task, so many that a marked word shares its bucket with little else.
BUCKETS = 1 << 20
#: Standard deviations that a bucket's target count must lie off the count expected from the raw model to weigh at all.
LEAST_Z = 3.0
#: Count added to both sides of a ratio.
SMOOTH = 0.1
#: Labelled target documents that the target model is fitted on, at most; the raw model always covers all documents.
TARGET_ROWS = 20_000
SEED = 17
#: Bins of each pass of the exact top-k search, and rows that its last step may sort.
BINS, LAST_ROWS = 4096, 2000


def features(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """(bucket, text number) of every word and every pair of adjacent words."""
    h, doc = word_hashes(texts)
    pair = mix(h[:-1] * np.uint64(0x9E3779B97F4A7C15) + h[1:])[doc[:-1] == doc[1:]] if len(h) else h
    return (np.concatenate([h, pair]) >> np.uint64(65 - BUCKETS.bit_length())).astype(np.int64), np.concatenate([doc, doc[:-1][doc[:-1] == doc[1:]]])


def _count(batches):
    raw, target = np.zeros(BUCKETS, np.int64), np.zeros(BUCKETS, np.int64)
    for batch in batches:
        for part in pieces(batch, 0):
            bucket, doc = features(part.column(0).to_pylist())
            raw += np.bincount(bucket, minlength=BUCKETS)
            on = part.column(1).to_numpy(zero_copy_only=False)[doc]
            target += np.bincount(bucket[on], minlength=BUCKETS)
    seen = np.flatnonzero(raw)
    for at in np.array_split(seen, len(seen) // 50_000 + 1):
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(raw[at]), pa.array(target[at])], ["bucket", "raw", "target"])


def log_ratio(docs: DataFrame, targets: DataFrame, text_col: str = "text", id_col: str = "doc_id", least_z: float = LEAST_Z, smooth: float = SMOOTH) -> np.ndarray:
    """log(p_target / p_raw) of each bucket, by models smoothed with ``smooth``, shrunk by its evidence.

    With e the target count that the raw model expects and z the deviation from it in standard deviations, the ratio
    is log((target + smooth) / (e + smooth)) * max(0, 1 - (least_z / z) ** 2): else the sum over a text's many rare
    buckets, each nearly without evidence, drowns the few that tell. ``least_z`` 0 gives the plain ratio of the models. Counts are summed and weighed in the executors;
    the driver gets the buckets that weigh, BUCKETS rows at most whatever the corpus. ``targets(id)`` must be bounded
    (TARGET_ROWS): it is broadcast.
    """
    flagged = docs.join(F.broadcast(targets.select(F.col("id").alias("__t")).distinct()), F.col(id_col) == F.col("__t"), "left")
    counts = flagged.select(F.col(text_col).cast("string").alias("t"), F.col("__t").isNotNull().alias("on")).mapInArrow(_count, "bucket bigint, raw bigint, target bigint")
    counts = materialize(counts.groupBy("bucket").agg(F.sum("raw").alias("raw"), F.sum("target").alias("target")), "quality-counts")
    all_raw, all_target = counts.agg(F.sum("raw"), F.sum("target")).first()
    ratio = np.zeros(BUCKETS)
    if not all_target:
        return ratio
    share = all_target / all_raw
    expected, target = F.col("raw") * F.lit(share), F.col("target")
    chance = F.lit(float(least_z) ** 2) * expected * F.lit(1 - share) / F.pow(target - expected, F.lit(2))
    weighed = F.log((target + smooth) / (expected + smooth)) * (1 - chance)
    rows = counts.where((target != expected) & (chance < 1)).select("bucket", weighed.alias("ratio")).toArrow()
    ratio[rows.column(0).to_numpy()] = rows.column(1).to_numpy()
    return ratio


def scores(docs: DataFrame, ratio: np.ndarray, text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """(id, log_weight, n_features) of every row; an empty or null text has weight 0."""

    def run(batches):
        for batch in batches:
            for part in pieces(batch, 1):
                bucket, doc = features(part.column(1).to_pylist())
                n = part.num_rows
                w, c = np.bincount(doc, weights=ratio[bucket], minlength=n), np.bincount(doc, minlength=n)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(w), pa.array(c)], ["id", "log_weight", "n_features"])

    return docs.select(F.col(id_col).cast("bigint").alias("id"), F.col(text_col).cast("string").alias("t")).mapInArrow(run, "id bigint, log_weight double, n_features bigint")


def gumbel(key: Column, seed: int = SEED) -> Column:
    """Standard Gumbel noise as a function of a row's id and the seed alone."""
    u = (F.shiftrightunsigned(F.xxhash64(key, F.lit(seed)), 11) + F.lit(0.5)) / F.lit(float(1 << 53))
    return -F.log(-F.log(u))


def top_k(df: DataFrame, key: str, tie: str, k: int) -> DataFrame:
    """``df`` with kept: whether a row is among the k largest by ``key``, ties by the smaller ``tie``.

    The threshold comes from histograms, each over the bin of the one before that holds rank k, so no
    task sorts more than LAST_ROWS rows or those that share one value. Repeated rows past the
    threshold fall to both sides in arbitrary order, but exactly k rows stay (all if there are fewer).
    """
    lo, hi, n = df.agg(F.min(key), F.max(key), F.count("*")).first()
    if n <= k or k <= 0:
        return df.withColumn("kept", F.lit(k > 0))
    need = k
    inside = df.count()
    while inside > LAST_ROWS and hi > lo:
        step = (hi - lo) / BINS
        bin_ = F.least(F.lit(BINS - 1), F.floor((F.col(key) - F.lit(lo)) / F.lit(step))) if step > 0 else F.lit(0)
        counts = df.where(F.col(key).between(lo, hi)).groupBy(bin_.alias("b")).agg(F.count("*").alias("n"), F.min(key).alias("lo"), F.max(key).alias("hi")).collect()
        for r in sorted(counts, key=lambda r: -r["lo"]):
            if r["n"] >= need:
                shrunk = (r["lo"], r["hi"]) != (lo, hi)
                lo, hi, inside = r["lo"], r["hi"], r["n"]
                break
            need -= r["n"]
        if not shrunk:
            break
    edge = df.where(F.col(key).between(lo, hi)).withColumn("__r", F.row_number().over(Window.orderBy(F.col(key).desc(), tie)))
    edge = edge.withColumn("kept", F.col("__r") <= need).drop("__r")
    return df.where(F.col(key) > hi).withColumn("kept", F.lit(True)).union(edge).union(df.where(F.col(key) < lo).withColumn("kept", F.lit(False)))


def target_sample(labels: DataFrame, rows: int = TARGET_ROWS) -> DataFrame:
    """Ids of good and harmless labelled documents, the first ``rows`` in hash order."""
    good = labels.where("quality = 1 and coalesce(toxic, 0) = 0 and doc_id is not null")
    return good.select(F.col("doc_id").alias("id")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows)


def importance_resample(docs: DataFrame, labels: DataFrame, fraction: float | None = None, temperature: float = 1.0, least_z: float = LEAST_Z, smooth: float = SMOOTH) -> DataFrame:
    """(id, log_weight, n_features, key, kept): documents resampled towards the labelled good ones.

    The log weight of a text is the sum over its hashed words and word pairs of log(p_target / p_raw), shrunk
    towards 0 as far as chance explains the difference (see ``log_ratio``).
    ``key`` adds Gumbel noise; the top k keys are a sample without replacement in proportion to the
    weights to the power 1 / ``temperature``. k is ``fraction`` of all rows, by default the share of good documents among the labelled.
    Null and empty texts have weight 0; without labels all weights are 0. Empty in, empty out.
    """
    share = labels.agg(F.avg(F.expr("cast(quality = 1 and coalesce(toxic, 0) = 0 as double)"))).first()[0]
    ratio = log_ratio(docs, target_sample(labels), least_z=least_z, smooth=smooth)
    out = scores(docs, ratio).withColumn("key", F.col("log_weight") / F.lit(temperature) + gumbel(F.coalesce("id", F.lit(-1))))
    out = materialize(out, "quality-scores")
    n = out.count()
    return top_k(out, "key", "id", round(n * (fraction if fraction is not None else 1.0 if share is None else share)))


def op9_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Weight, noisy key and choice of every row of ``documents`` by ``labels``; cases as in ``importance_resample``."""
    out = importance_resample(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "labels"))
    return out.select(F.col("id").alias("doc_id"), "log_weight", "n_features", F.col("key").alias("gumbel_key"), "kept")
