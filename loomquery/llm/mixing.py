"""Mixing sources to target weights by proportionate-fair scheduling, in DataFrame operations only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ._common import broadcast_checked, materialize, salted_join, table
from .sharding import hash60

#: Blocks that a source gets in each period while it lasts: its target weight, as a whole number.
WEIGHTS = {"src0": 12, "src1": 6, "src2": 6, "src3": 4}
DEFAULT_WEIGHT = 3
BLOCK_ROWS = 16
#: Rows that one rank bucket aims at; bits of a pending block's number that name its source.
BUCKET_ROWS, SOURCE_BITS = 4_000, 20


def edf_slots(kinds: DataFrame) -> DataFrame:
    """(first, slots): the source of each slot of a period, for ``kinds(first, width, counts)``, width the sum of the counts.

    Block i (from 0) of a source with c of L slots is released at floor(i L / c) and due at
    ceil((i + 1) L / c). Each slot goes to the released block that is due first, ties to the earlier
    source. On one processor that order meets every deadline, so in each prefix of the period
    a source is less than one block from its share. A pending block is one number, its deadline before its source;
    a slot costs three passes over the pending blocks, of which each source has one at most.
    """
    shares = kinds.select("first", "width", F.posexplode("counts").alias("s", "c")).where("c > 0")
    blocks = shares.select("first", "width", "s", "c", F.explode(F.expr("sequence(0L, c - 1)")).alias("i"))
    jobs = blocks.select("first", F.expr("(i * width) div c").alias("t"), F.expr(f"shiftleft(((i + 1) * width + c - 1) div c, {SOURCE_BITS}) | s").alias("job"))
    times = kinds.select("first", F.explode(F.expr("sequence(0L, width - 1)")).alias("t"), F.expr("cast(null as bigint)").alias("job"))
    released = jobs.union(times).groupBy("first", "t").agg(F.collect_list("job").alias("jobs"))
    periods = released.groupBy("first").agg(F.array_sort(F.collect_list(F.struct("t", "jobs"))).alias("released"))
    step = f"""
      (x, r) -> transform(array(concat(x.pending, r.jobs)), p -> struct(
        array_remove(p, array_min(p)) as pending, concat(x.slots, array(cast(array_min(p) & {(1 << SOURCE_BITS) - 1} as int))) as slots))[0]"""
    none = "struct(cast(array() as array<bigint>) as pending, cast(array() as array<int>) as slots)"
    return periods.select("first", F.expr(f"aggregate(released, {none}, {step}, x -> x.slots)").alias("slots"))


def source_key(source: Column) -> Column:
    """A text for each source that is never null: a null source has one of its own."""
    return F.coalesce(F.concat(F.lit("="), source.cast("string")), F.lit(""))


def _ranked(rows: DataFrame, ties: list[Column]) -> DataFrame:
    """``rows(s, h, key, ...)`` with rank from 0 within its source, in the order of (hash of key, key, ties).

    A source is cut into hash-prefix buckets of about BUCKET_ROWS rows: a bucket's offset is the count of
    the buckets before it, so no task sorts a whole source, however hot.
    """
    n = rows.count()
    bits = max(0, (n // BUCKET_ROWS).bit_length() + (1 if n > BUCKET_ROWS else 0))
    rows = rows.withColumn("b", F.shiftright("h", 60 - bits) if bits else F.lit(0).cast("bigint"))
    size = rows.groupBy("s", "b").agg(F.count("*").alias("n"))
    before = F.coalesce(F.sum("n").over(Window.partitionBy("s").orderBy("b").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    offset = materialize(size.select(F.col("s").alias("s2"), F.col("b").alias("b2"), before.alias("before")), "mix-offsets")
    rows = rows.withColumn("i", F.row_number().over(Window.partitionBy("s", "b").orderBy("h", "key", *ties)))
    rows = rows.join(broadcast_checked(offset, F.octet_length("s2") + 40), (F.col("s") == F.col("s2")) & (F.col("b") == F.col("b2")))
    return rows.withColumn("rank", F.col("before") + F.col("i") - 1).drop("s2", "b2", "before", "i", "b")


def schedule(counts: DataFrame) -> DataFrame:
    """Slots of each source: ``counts(source, weight, blocks)``, no source twice, to (source, weight, firsts, bases, widths, slots).

    Periods run until all blocks are placed. In period e a source has min(weight, blocks left) blocks, so
    periods between two sources' ends are alike: at most two kinds for each source. The arrays list a source's kinds by
    first period: that period, its first slot, the slots of a period, and those of this source in it.
    """
    all_ = counts.agg(F.array_sort(F.collect_list(F.struct(source_key(F.col("source")).alias("o"), "source", "weight", "blocks"))).alias("all"))
    ends = F.array_distinct(F.flatten(F.transform("all", lambda x: F.array(F.floor(x.blocks / x.weight), F.ceil(x.blocks / x.weight)))))
    kinds = all_.select("all", F.explode(F.array_union(F.array(F.lit(0).cast("bigint")), ends)).alias("first"))
    share = lambda x: F.greatest(F.lit(0).cast("bigint"), F.least(x.weight.cast("bigint"), x.blocks - F.col("first") * x.weight))
    kinds = kinds.select(
        "first",
        F.transform("all", share).alias("counts"),
        F.aggregate("all", F.lit(0).cast("bigint"), lambda a, x: a + F.least(x.blocks, F.col("first") * x.weight)).alias("base"),
    ).withColumn("width", F.aggregate("counts", F.lit(0).cast("bigint"), lambda a, c: a + c))
    kinds = materialize(kinds.where("width > 0"), "mix-kinds")
    placed = edf_slots(kinds).select("first", F.posexplode("slots").alias("slot", "s"))
    per = placed.groupBy("s", "first").agg(F.array_sort(F.collect_list("slot")).alias("slots"))
    per = per.join(kinds.select("first", "base", "width"), "first").groupBy("s").agg(F.array_sort(F.collect_list(F.struct("first", "base", "width", "slots"))).alias("k"))
    named = all_.select(F.posexplode("all").alias("s", "x")).select("s", "x.source", "x.weight")
    return named.join(per, "s").select("source", "weight", F.col("k.first").alias("firsts"), F.col("k.base").alias("bases"), F.col("k.width").alias("widths"), F.col("k.slots").alias("slots"))


def pfair_mix(df: DataFrame, source: str = "source", key: str = "doc_id", weights: dict | None = None, default: int = DEFAULT_WEIGHT, block: int = BLOCK_ROWS) -> DataFrame:
    """``df`` with __mix_block and __mix_pos: the place of each row in the mixture. No row is dropped.

    A source's rows, in hash order, form blocks; blocks follow the schedule above, so at every
    block boundary each source with blocks left is within one block of its share of the weights, and
    the weights of exhausted sources pass to the rest in proportion. A null source is a source of its own;
    sources without a weight get ``default``. The last block of a source may be short. Equal keys are ordered by the other
    columns. Columns named __mix_block or __mix_pos are replaced, all others pass through. Empty in, empty out.
    The plan's size depends on the number of sources and the sum of their weights alone.
    """
    weights = WEIGHTS if weights is None else weights
    kept = [c for c in df.columns if c not in ("__mix_block", "__mix_pos")]
    rows = df.select(source_key(F.col(source)).alias("s"), hash60(F.col(key)).alias("h"), F.col(key).alias("key"), F.struct(*kept).alias("row"))
    ties = [F.xxhash64(F.col("row")[c]) for c, t in df.dtypes if c in kept and c not in (source, key) and "map<" not in t and "variant" not in t]
    rows = _ranked(rows, ties)
    known = F.create_map(*(x for name, w in weights.items() for x in (source_key(F.lit(name).cast("string")), F.lit(w))))
    given = F.coalesce(F.element_at(known, source_key(F.col("source"))), F.lit(default)) if weights else F.lit(default)
    counts = df.groupBy(F.col(source).cast("string").alias("source")).agg(F.ceil(F.count("*") / block).alias("blocks")).withColumn("weight", given)
    plan = schedule(materialize(counts, "mix-counts"))
    plan = materialize(plan.select(source_key(F.col("source")).alias("s2"), F.col("weight").alias("w"), "firsts", "bases", "widths", "slots"), "mix-plan")
    size = F.octet_length("s2") + 32 * F.size("firsts") + 4 * F.size(F.flatten("slots")) + 100
    rows = salted_join(rows, plan, "s", "s2", F.col("h"), size)
    rows = rows.withColumn("block", F.floor(F.col("rank") / block)).withColumns({"e": F.floor(F.col("block") / F.col("w")), "j": (F.col("block") % F.col("w")).cast("int")})
    rows = rows.withColumn("k", F.expr("size(filter(firsts, f -> f <= e))"))
    place = F.expr("element_at(bases, k) + (e - element_at(firsts, k)) * element_at(widths, k) + element_at(element_at(slots, k), j + 1)").cast("bigint")
    return rows.select("row.*", place.alias("__mix_block"), (place * block + F.col("rank") % block).alias("__mix_pos"))


def op5_pfair_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Place of every row of ``documents`` in the mixture of their sources; cases as in ``pfair_mix``."""
    out = pfair_mix(table(spark, sf_dir, "documents").select("doc_id", "source"))
    return out.select("doc_id", "source", F.col("__mix_block").alias("mix_block"), F.col("__mix_pos").alias("mix_pos"))
