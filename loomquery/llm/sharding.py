"""Byte-limited sharding by extendible hashing, in DataFrame operations only."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ._common import broadcast_checked, materialize, table

HASH_BITS = 60
MAX_BYTES = 8 << 20
#: Cells the first directory has for each full shard, and bits each further level adds.
SLACK_BITS, LEVEL_BITS = 3, 8
#: Bytes that a row of the directory counts for where it is to be broadcast, and bits of the text's hash by which rows of one key are dealt.
ROW_BYTES, RANK_BITS = 80, 12


def hash60(key: Column) -> Column:
    """The first 60 bits of the MD5 of a key's text; a null key counts as the empty text."""
    return F.conv(F.substring(F.md5(F.coalesce(key.cast("string"), F.lit("")).cast("binary")), 1, 15), 16, 10).cast("bigint")


def _prefix(h: str, bits) -> Column:
    return F.expr(f"shiftright({h}, {HASH_BITS} - {bits})")


def extendible_shards(df: DataFrame, key: str = "doc_id", text: str = "text", max_bytes: int = MAX_BYTES) -> DataFrame:
    """``df`` with __shard, __depth, __shard_bytes and __n_bytes; every shard holds at most ``max_bytes``.

    A directory indexed by the leading hash bits starts as one bucket; only a bucket over the limit is
    split on its next bit. Bytes are first summed by cell at the depth that the total asks for; cells
    still over the limit are summed again some bits deeper, alone. Rows whose keys share all 60 bits
    (repeated or null keys) and together exceed the limit get a shard of their own each, ``<bits>-<n>``, numbered in
    the order of a hash of their text; a single row over the limit stays whole in such a shard. Null text has 0 bytes.
    Columns with the names of the results are replaced, all others pass through. An empty table gives no rows.
    """
    kept = [c for c in df.columns if c not in ("__shard", "__depth", "__shard_bytes", "__n_bytes")]
    size = F.coalesce(F.octet_length(F.col(text).cast("string")), F.lit(0)).cast("bigint")
    rows = df.select(hash60(F.col(key)).alias("h"), size.alias("n_bytes"), F.xxhash64(F.col(text).cast("string")).alias("th"), F.struct(*kept).alias("row"))
    sizes = materialize(rows.groupBy("h").agg(F.sum("n_bytes").alias("b"), F.count("*").alias("c")), "shard-sizes")
    total = sizes.agg(F.coalesce(F.sum("b"), F.lit(0))).first()[0]
    above, depth, pending, out = -1, min(HASH_BITS, SLACK_BITS + max(0, math.ceil(math.log2(max(1, total / max_bytes))))), sizes, []
    while True:
        cells = materialize(pending.groupBy(_prefix("h", depth).alias("cell")).agg(F.sum("b").alias("b"), F.sum("c").alias("c")), "shard-cells")
        spread = cells.select("cell", "b", "c", F.explode(F.sequence(F.lit(above + 1), F.lit(depth))).alias("d")).withColumn("p", F.expr(f"shiftright(cell, {depth} - d)"))
        nodes = spread.groupBy("d", "p").agg(F.sum("b").alias("bytes"), F.sum("c").alias("rows"))
        fits = nodes.where((F.col("bytes") <= max_bytes) | (F.col("d") == HASH_BITS))
        parents = nodes.where(F.col("bytes") > max_bytes).select((F.col("d") + 1).alias("d"), F.col("p").alias("q"))
        leaf = fits.withColumn("q", F.shiftright("p", 1)).join(parents, ["d", "q"], "left_semi")
        tops = fits.where(F.col("d") == above + 1) if above else fits
        leaves = leaf.select("d", "p", "bytes", "rows").union(tops.select("d", "p", "bytes", "rows")).distinct()
        directory = spread.join(leaves, ["d", "p"]).select("cell", F.struct("d", "p", "bytes", "rows").alias("leaf"))
        out.append((depth, materialize(directory, "shard-directory")))
        if depth == HASH_BITS:
            break
        over = cells.where(F.col("b") > max_bytes).select(F.col("cell").alias("over"))
        if over.isEmpty():
            break
        pending = pending.join(over, _prefix("h", depth) == F.col("over"), "left_semi")
        above, depth = depth, min(HASH_BITS, depth + LEVEL_BITS)
    for n, (level, directory) in enumerate(out):
        named = directory.select(F.col("cell").alias("c2"), F.col("leaf").alias(f"leaf{n}"))
        rows = rows.join(broadcast_checked(named, F.lit(ROW_BYTES)), _prefix("h", level) == F.col("c2"), "left").drop("c2")
    rows = rows.withColumn("leaf", F.coalesce(*(f"leaf{n}" for n in range(len(out))))).select("h", "n_bytes", "th", "row", "leaf.*")
    bits = F.lpad(F.bin("p"), F.col("d").cast("int"), F.lit("0"))
    rows = rows.withColumn("shard", F.coalesce(bits, F.lit(""))).withColumn("shard_bytes", F.col("bytes").cast("bigint"))
    if depth == HASH_BITS:
        full = (F.col("bytes") > max_bytes) & (F.col("rows") > 1)
        rows = rows.where(~full).select(*rows.columns).unionByName(_singles(rows.where(full)))
    return rows.select("row.*", F.col("shard").alias("__shard"), F.coalesce("d", F.lit(0)).cast("int").alias("__depth"), F.coalesce("shard_bytes", F.lit(0).cast("bigint")).alias("__shard_bytes"), F.col("n_bytes").alias("__n_bytes"))


def _singles(rows: DataFrame) -> DataFrame:
    """Rows of equal hash, numbered from 1 in the order of (hash of the text, bytes): ranked in buckets of that hash, each with the count of those before it."""
    rows = rows.withColumn("bucket", F.shiftrightunsigned("th", 64 - RANK_BITS))
    size = rows.groupBy("h", "bucket").agg(F.count("*").alias("n"))
    before = F.coalesce(F.sum("n").over(Window.partitionBy("h").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    offset = size.select(F.col("h").alias("h2"), F.col("bucket").alias("bucket2"), before.alias("before"))
    rank = F.row_number().over(Window.partitionBy("h", "bucket").orderBy("th", "n_bytes"))
    rows = rows.withColumn("i", rank).join(offset, (F.col("h") == F.col("h2")) & (F.col("bucket") == F.col("bucket2")))
    rows = rows.withColumn("shard", F.concat("shard", F.lit("-"), F.col("before") + F.col("i"))).withColumn("shard_bytes", F.col("n_bytes"))
    return rows.drop("bucket", "h2", "bucket2", "before", "i")


def op7_extendible_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shard of every row of ``documents``; cases as in ``extendible_shards``."""
    out = extendible_shards(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", F.col("__n_bytes").alias("n_bytes"), F.col("__shard").alias("shard"), F.col("__depth").alias("depth"), F.col("__shard_bytes").alias("shard_bytes"))


OP7_SQL = f"""
WITH d AS (
  SELECT doc_id, CAST(octet_length(encode(coalesce(text, ''))) AS BIGINT) AS n,
         CAST('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), '')), 1, 15) AS BIGINT) AS h
  FROM documents),
nodes AS (
  SELECT g.depth, h >> ({HASH_BITS} - g.depth)::INT AS p, sum(n) AS bytes
  FROM d, (SELECT unnest(range(0, {HASH_BITS + 1})) AS depth) g GROUP BY ALL),
leaf AS (
  SELECT d.doc_id, d.n, d.h, nodes.depth, nodes.p, nodes.bytes,
         row_number() OVER (PARTITION BY d.doc_id ORDER BY nodes.depth) AS k
  FROM d JOIN nodes ON nodes.p = d.h >> ({HASH_BITS} - nodes.depth)::INT WHERE nodes.bytes <= {MAX_BYTES})
SELECT doc_id, n AS n_bytes,
       CASE WHEN depth = 0 THEN '' ELSE lpad(bin(p), depth::INT, '0') END AS shard,
       CAST(depth AS INT) AS depth, CAST(bytes AS BIGINT) AS shard_bytes
FROM leaf WHERE k = 1"""
