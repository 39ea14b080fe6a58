"""Point-in-time feature join by range-frame windows, in DataFrame operations only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ._common import table

#: Seconds of a slice of time, and of the frame that looks back; the lifetime of a version is below it in op11's table.
SLICE = 900
#: A version that is valid for so many slices fails: it would be copied to each.
MOST_SLICES = 100_000
FRESH_SECONDS = 20


def live_pieces(versions: DataFrame, width: int = SLICE) -> DataFrame:
    """``versions(key, event, arrival, expiry, rank, value)`` as pieces (key, slice, start, stop, at, best), without those that can't win.

    A version is usable from max(event, arrival) until expiry. It is cut where slices of ``width`` seconds meet, so one slice holds all
    that is usable in it, and ``at``, its event or the start of the slice, is less than ``width`` before any second of the piece.
    ``best`` orders usable versions. Of pieces of equal bounds one stays, before the shuffle already; of pieces of equal start one that
    ends no later than a better one goes, so a second of a key holds ``width`` of them at most, few as a rule, however many versions there are.
    """
    usable = versions.where("key is not null and greatest(event, arrival) < expiry and event is not null and arrival is not null").select(
        "key", F.greatest("event", "arrival").alias("first"), F.col("expiry").alias("end"), F.struct("event", "arrival", "rank", "value").alias("best")
    )
    first, last = F.floor(F.col("first") / width), F.floor((F.col("end") - 1) / width)
    long = F.raise_error(F.concat(F.lit("a version is valid for over "), F.lit(MOST_SLICES), F.lit(" slices: choose a larger width")))
    usable = usable.select("*", F.explode(F.sequence(first, F.when(last - first < MOST_SLICES, last).otherwise(long.cast("bigint")))).alias("slice"))
    piece = usable.select(
        "key", "slice", F.greatest(F.col("first"), F.col("slice") * width).alias("start"), F.least(F.col("end"), (F.col("slice") + 1) * width).alias("stop"), "best"
    )
    piece = piece.groupBy("key", "slice", "start", "stop").agg(F.max("best").alias("best"))
    longer = Window.partitionBy("key", "slice", "start").orderBy(F.desc("stop")).rowsBetween(Window.unboundedPreceding, -1)
    piece = piece.withColumn("over", F.max("best").over(longer)).where("over is null or best > over").drop("over")
    return piece.withColumn("at", F.greatest(F.col("best.event"), F.col("slice") * width))


def latest_usable(versions: DataFrame, asks: DataFrame, width: int = SLICE) -> DataFrame:
    """(key, t, best): for each different ``asks(key, t)`` the winner of ``versions``, null where none is usable.

    Versions and asks of a key and slice are united in the order of time; a range frame of ``width`` seconds before an ask collects
    the pieces, those not arrived or expired at t are filtered out, and the largest (event, arrival, rank) of the rest wins.
    No group is larger than a slice's seconds allow: pieces are bounded as above and asks are distinct, so a hot key is many groups.
    """
    pieces = live_pieces(versions, width).select("key", "slice", "at", F.struct("start", "stop", "best").alias("piece"))
    asks = asks.where("key is not null and t is not null").select("key", F.floor(F.col("t") / width).alias("slice"), F.col("t").alias("at")).distinct()
    both = pieces.unionByName(asks, allowMissingColumns=True)
    frame = Window.partitionBy("key", "slice").orderBy("at").rangeBetween(-(width - 1), 0)
    seen = both.withColumn("seen", F.collect_list("piece").over(frame)).where("piece is null")
    usable = F.filter("seen", lambda p: (p.start <= F.col("at")) & (F.col("at") < p.stop))
    return seen.select("key", F.col("at").alias("t"), F.array_max(F.transform(usable, lambda p: p.best)).alias("best"))


def hash_group(key: Column, n: int) -> Column:
    """The n-th group of eight hex digits of the sha256 of a number in decimals, as an unsigned integer."""
    return F.conv(F.substring(F.sha2(key.cast("string").cast("binary"), 256), 8 * n + 1, 8), 16, 10).cast("bigint")


def op11_point_in_time(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The version of its source that each label's document saw at the label's time.

    One row per row of ``labels``, repeated ones too. A null doc_id has t null and finds nothing; so does one that ``documents`` lacks, or
    whose source is null. An id of several rows there asks about the least of their sources; each of them is a version, and of
    versions alike in event, arrival and doc_id the one of larger n_chars, then lang, counts. Other columns are not read; empty
    labels give no rows, empty documents no winners.
    """
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").cast("bigint").alias("doc_id"), "source", F.col("n_chars").cast("bigint").alias("n_chars"), F.col("lang").cast("string").alias("lang"))
    event = hash_group(F.col("doc_id"), 0) % 200_000
    versions = docs.select(
        F.col("source").alias("key"), event.alias("event"), (event - 60 + hash_group(F.col("doc_id"), 1) % 1200).alias("arrival"), (event + hash_group(F.col("doc_id"), 2) % 900).alias("expiry"),
        F.col("doc_id").alias("rank"), F.struct("n_chars", "lang").alias("value"),
    )
    labels = table(spark, sf_dir, "labels").select(F.col("doc_id").cast("bigint").alias("doc_id"))
    owner = docs.groupBy("doc_id").agg(F.min("source").alias("key")).hint("shuffle_merge")
    labels = labels.join(owner, "doc_id", "left").withColumn("t", hash_group(F.col("doc_id"), 3) % 200_000)
    won = latest_usable(versions, labels).hint("shuffle_merge")
    best, fresh = F.col("best"), F.col("age") <= FRESH_SECONDS
    out = labels.join(won, ["key", "t"], "left").select("doc_id", "t", best.rank.alias("version_id"), (F.col("t") - best.event).alias("age"), "best")
    return out.select(
        "doc_id", "t", "version_id", "age", F.when(F.col("version_id").isNull(), "none").when(fresh, "fresh").otherwise("stale").alias("status"),
        F.when(fresh, best.value.n_chars).alias("n_chars"), F.when(fresh, best.value.lang).alias("lang"),
    )


OP11_SQL = """
WITH docs AS (SELECT doc_id, source, n_chars, lang, sha256(CAST(doc_id AS VARCHAR)) AS h FROM documents),
hashed AS (
  SELECT *, CAST('0x' || substr(h, 1, 8) AS BIGINT) AS a, CAST('0x' || substr(h, 9, 8) AS BIGINT) AS b, CAST('0x' || substr(h, 17, 8) AS BIGINT) AS c FROM docs WHERE doc_id IS NOT NULL),
versions AS (SELECT doc_id, source, n_chars, lang, a % 200000 AS event, a % 200000 - 60 + b % 1200 AS arrival, a % 200000 + c % 900 AS expiry FROM hashed),
owners AS (SELECT doc_id, min(source) AS source FROM documents GROUP BY doc_id),
asks AS (
  SELECT row_number() OVER () AS ask, l.doc_id, CAST('0x' || substr(sha256(CAST(l.doc_id AS VARCHAR)), 25, 8) AS BIGINT) % 200000 AS t, o.source
  FROM labels l LEFT JOIN owners o ON l.doc_id = o.doc_id),
ranked AS (
  SELECT a.ask, v.*, row_number() OVER (PARTITION BY a.ask ORDER BY v.event DESC, v.arrival DESC, v.doc_id DESC, v.n_chars DESC NULLS LAST, v.lang DESC NULLS LAST) AS place
  FROM asks a JOIN versions v ON a.source = v.source AND v.event <= a.t AND v.arrival <= a.t AND a.t < v.expiry)
SELECT a.doc_id, a.t, w.doc_id AS version_id, a.t - w.event AS age,
  CASE WHEN w.doc_id IS NULL THEN 'none' WHEN a.t - w.event > 20 THEN 'stale' ELSE 'fresh' END AS status,
  CASE WHEN a.t - w.event <= 20 THEN w.n_chars END AS n_chars, CASE WHEN a.t - w.event <= 20 THEN w.lang END AS lang
FROM asks a LEFT JOIN ranked w ON w.ask = a.ask AND w.place = 1
"""
