"""History and habit mining: co-change, sequences, co-occurrence."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


#: Pairs of tokens that one task counts, on average.
PLACE_PAIRS = 4_000_000


def baskets(df: DataFrame, basket: str, item: str, most: int = 20) -> DataFrame:
    """Distinct (basket, item) rows of baskets with 1 to ``most`` items."""
    rows = df.select(F.col(basket).alias("basket"), F.col(item).alias("item")).distinct()
    sizes = rows.groupBy("basket").agg(F.count("*").alias("n")).where(F.col("n") <= most)
    return rows.join(sizes, "basket", "left_semi")


def hotspots(rows: DataFrame, top: int = 15) -> DataFrame:
    return rows.groupBy("item").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "item").limit(top)


def percent(n: Column, d: Column) -> Column:
    """n / d to two places, halves up, in whole numbers."""
    return F.floor((200 * n + d) / (2 * d)) / 100


def cochange_pairs(rows: DataFrame, support: int = 2, confidence: float = 0.5, top: int = 50) -> DataFrame:
    """Strongest unordered pairs of items that share baskets; basket sizes are bounded, so is the join."""
    count = rows.groupBy("item").agg(F.count("*").alias("n"))
    a, b = rows.alias("a"), rows.alias("b")
    pairs = a.join(b, (F.col("a.basket") == F.col("b.basket")) & (F.col("a.item") < F.col("b.item"))).groupBy(F.col("a.item").alias("item_a"), F.col("b.item").alias("item_b")).agg(F.count("*").alias("support"))
    pairs = pairs.where(F.col("support") >= support)
    pairs = pairs.join(count.select(F.col("item").alias("item_a"), F.col("n").alias("na")), "item_a").join(count.select(F.col("item").alias("item_b"), F.col("n").alias("nb")), "item_b")
    pairs = pairs.withColumn("confidence", F.greatest(percent(F.col("support"), F.col("na")), percent(F.col("support"), F.col("nb"))))
    return pairs.where(F.col("confidence") >= confidence).select("item_a", "item_b", "support", "confidence").orderBy(F.desc("support"), F.desc("confidence"), "item_a", "item_b").limit(top)


def global_lead(df: DataFrame, seq: str, columns: list[str]) -> DataFrame:
    """next_<column> of the following row in the order of ``seq``, over all rows.

    Adjacency is global by definition. To keep rows off one task, the rows are laid out in ranges of
    ``seq``; within a range it is a window, and across ranges the first row of the next one fills in.
    """
    ranged = df.repartitionByRange(seq).withColumn("__p", F.spark_partition_id())
    w = Window.partitionBy("__p").orderBy(seq)
    inner = ranged.select("*", *(F.lead(c).over(w).alias(f"next_{c}") for c in columns), F.lead(seq).over(w).alias("__n"))
    heads = ranged.groupBy("__p").agg(*(F.min_by(c, seq).alias(f"__h_{c}") for c in columns))
    heads = heads.select(*(F.lead(f"__h_{c}").over(Window.orderBy("__p")).alias(f"__h_{c}") for c in columns), F.col("__p").alias("__q"))
    out = inner.join(F.broadcast(heads), F.col("__p") == F.col("__q"))  # one row for each range
    return out.select(*df.columns, *(F.coalesce(f"next_{c}", F.when(F.col("__n").isNull(), F.col(f"__h_{c}"))).alias(f"next_{c}") for c in columns))


def sequence_pairs(events: DataFrame, seq: str, session: str, kind: str, support: int = 2) -> DataFrame:
    """Adjacent events of different kinds, adjacent over all sessions and then of one session."""
    pairs = global_lead(events.select(seq, session, kind), seq, [session, kind])
    pairs = pairs.where((F.col(session) == F.col(f"next_{session}")) & (F.col(kind) != F.col(f"next_{kind}")))
    return pairs.groupBy(F.col(kind).alias("first_kind"), F.col(f"next_{kind}").alias("second_kind")).agg(F.count("*").alias("support")).where(F.col("support") >= support)


def latest(df: DataFrame, seq: str, keep: int = 500) -> DataFrame:
    return df.orderBy(F.desc(seq)).limit(keep)


def bundles(df: DataFrame, group: str, item: str, low: int = 2, high: int = 6, support: int = 2) -> DataFrame:
    """How often the same set of items makes up a group."""
    sets = df.groupBy(group).agg(F.array_sort(F.collect_set(item)).alias("items")).where(F.size("items").between(low, high))
    return sets.groupBy(F.array_join(F.transform("items", lambda x: x.cast("string")), ",").alias("bundle")).agg(F.count("*").alias("support")).where(F.col("support") >= support)


def pmi(windows: DataFrame, window: str, left: str, right: str, top: int = 4) -> DataFrame:
    """Top partners of each left token by pointwise mutual information over windows with both sides.

    ``windows`` has distinct rows (window, left array, right array). Pairs are made where they are counted, so none of them is shuffled.
    """
    both = windows.where((F.size(left) > 0) & (F.size(right) > 0))
    total, pairs = both.agg(F.count("*"), F.coalesce(F.sum(F.size(left).cast("bigint") * F.size(right)), F.lit(0))).first()

    def counted(side, token, n, rate):
        # tokens in over a tenth or so of the windows say nothing, once there are some windows
        rows = both.select(window, F.explode(side).alias(token))
        counts = rows.groupBy(token).agg(F.count("*").alias(n))
        return rows.join(counts.where(F.col(n) / total <= rate) if total >= 20 else counts, token)

    partners = counted(right, "e", "ec", 0.08).groupBy(window).agg(F.collect_list(F.struct("e", "ec")).alias("es"))
    # a token goes to its place with the partners of a window in one row; there they are counted, scored and ranked, in places by the pairs there are
    partners = partners.select(window, F.col("es.e").alias("e"), F.col("es.ec").cast("array<int>").alias("ec"))  # plain arrays take half of the room
    placed = counted(left, "z", "zc", 0.12).join(partners, window).select("z", "zc", "e", "ec").repartition(pairs // PLACE_PAIRS + 1, "z")
    pairs = placed.select("z", "zc", F.explode(F.arrays_zip("e", "ec")).alias("p")).select("z", "zc", "p.e", "p.ec").groupBy("z", "zc", "e", "ec").agg(F.count("*").alias("s"))
    scored = pairs.withColumn("pmi", F.log2(F.col("s") * F.lit(total) / (F.col("zc") * F.col("ec"))))
    perfect = (F.col("zc") == F.col("ec")) & (F.col("ec") == F.col("s"))
    weak = ((F.col("s") == 1) & (F.col("ec") > 1) & (F.col("pmi") < 2)) | (F.col("pmi") <= 0)
    kept = scored.where(perfect | ~weak).withColumn("score", F.round("pmi", 6))
    w = Window.partitionBy("z").orderBy(F.desc("score"), F.desc("s"), "e")
    return kept.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= top).select("z", "e", F.col("s").alias("support"), "score", "rank")
