"""Links of documents' sections and symbols: weighted fields, bounds that prune before pairs are made, feedback, and coupled caps."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomquery.operators._lineage import written
from loomquery.operators.retrieval import B, K1, VOCABULARY_BYTES, greedy_caps

# Weights of a symbol's and a section's fields.
SYMBOL_WEIGHTS = {"name": 3.0, "parent": 1.5, "signature": 0.8, "doc": 1.0, "path": 0.3, "imports": 0.2}
SECTION_WEIGHTS = {"body": 1.0, "title": 2.0, "identifiers": 2.5}
# Least score and confidence of a link by concepts, softness of the confidence, what accepted links and tokens add, the score of an explicit link.
LEAST_SCORE, LEAST_CONFIDENCE, SOFTNESS, ACCEPTED_LINK, ACCEPTED_TOKEN, EXPLICIT_SCORE = 4.0, 0.32, 8.0, 25.0, 1.15, 100.0
# Tokens are common in so many sections and share of them, or symbols; rare in so many sections; rare pairs of a link and their bonus.
COMMON_SECTIONS, COMMON_SYMBOLS, RARE, RARE_TOKENS, PAIR_WEIGHT, PAIR_MOST = (4, 0.25), (6, 0.35), 2, 4, 0.25, 2.0
# Links of a section, of a symbol, of a symbol by concepts, and in all.
PER_SECTION, PER_SYMBOL, CONCEPTS_PER_SYMBOL, MOST_LINKS = 3, 3, 2, 400

#: Tokens of pairs of a symbol and a section that a task sums, about.
TASK_HITS = 2_000_000


def weighted(fields: dict[str, DataFrame], weights: dict[str, float]) -> DataFrame:
    """(key, token, weight) of ``(key, token)`` rows of each field, one a row, to be summed: every occurrence has its field's weight; tokens of one letter don't count."""
    rows = [f.select("key", F.lower("token").alias("token"), F.lit(weights[name]).alias("weight")) for name, f in fields.items()]
    return reduce(DataFrame.union, rows).where(F.length("token") >= 2)


def _common(df: Column, n: int, limits: tuple[int, float]) -> Column:
    return (df >= limits[0]) & (df / F.lit(max(n, 1)) >= limits[1])


def concept_scores(symbols: DataFrame, sections: DataFrame, generic: list[str] = (), feedback: dict[str, DataFrame] | None = None, prune: bool = True) -> DataFrame:
    """(symbol, section, score, shared) of links by shared concepts, over ``(key, token, weight)`` of both sides, weights of equal keys and tokens being summed.

    A token's part is its weight in the symbol, its idf and its saturated weight in the section. Common tokens and ``generic`` ones are no evidence. Two
    tokens have to be shared; pairs of rare ones add to the score. ``feedback`` may hold boosts(token, boost), accepted_tokens(token), and
    accepted and rejected (symbol, section): boosts scale a link's score, accepted links gain and need no least score, rejected ones go.

    A token's part is at most its bound, that in the best section. Of each symbol's tokens, those of the least bounds that together stay below the least
    score can't make a link alone: pairs that share none of the others go before they are scored. Rare and boosted tokens, whose gains come
    on top, always count, and accepted links stay, so the result is that without bounds (``prune=False``).

    Symbols' tokens are broadcast if few; then only sections' tokens are shuffled, by their section, and neither tokens of pairs nor pairs.
    """
    given = feedback or {}
    summed = lambda rows: rows.groupBy("key", "token").agg(F.sum("weight").alias("weight"))
    symbols = written(summed(symbols), "link-symbols")
    lengths = sections.groupBy("key").agg(F.greatest(F.lit(1.0), F.sum("weight")).alias("len"))
    n_sections, average = lengths.agg(F.count("*"), F.avg("len")).first()
    n_symbols = symbols.select("key").distinct().count()
    wanted = symbols.groupBy("token").agg(F.count("*").alias("symbol_df")).where(~_common(F.col("symbol_df"), n_symbols, COMMON_SYMBOLS) & ~F.col("token").isin(list(generic)))
    known = written(wanted.select("token"), "link-known")
    if (known.agg(F.sum(F.octet_length("token") + 64)).first()[0] or 0) <= VOCABULARY_BYTES:
        known = F.broadcast(known)
    mine = summed(sections.join(known, "token", "left_semi")).join(lengths, "key")  # other tokens are not shuffled
    saturated = F.col("weight") * (K1 + 1) / (F.col("weight") + K1 * (1 - B + B * F.col("len") / F.lit(max(1.0, average or 1.0))))
    mine = mine.select(F.col("key").alias("section"), "token", saturated.alias("tf"))
    stats = mine.groupBy("token").agg(F.count("*").alias("df"), F.max("tf").alias("most")).where(~_common(F.col("df"), n_sections, COMMON_SECTIONS))
    idf_of = lambda df: F.log(1 + (F.lit(n_sections) - df + 0.5) / (df + 0.5))
    stats = stats.select("token", "df", "most", idf_of(F.col("df")).alias("idf")).where("idf > 0")
    postings = written(mine.join(stats.select("token"), "token", "left_semi"), "link-postings")
    asked = symbols.join(stats, "token").select(F.col("key").alias("symbol"), "token", "df", "idf", (F.col("weight") * F.col("idf")).alias("w"), "most")
    special = F.col("df") <= RARE
    for name in ("boosts", "accepted_tokens"):
        if name in given:
            marked = given[name].select("token", F.lit(True).alias(name + "_")).distinct()
            asked = asked.join(marked, "token", "left")
            special = special | F.coalesce(F.col(name + "_"), F.lit(False))
    ascending = Window.partitionBy("symbol").orderBy(F.col("w") * F.col("most"), "token")
    asked = asked.withColumn("leads", special | (F.sum(F.col("w") * F.col("most")).over(ascending) >= LEAST_SCORE - 1e-9))
    asked = written(asked.select("symbol", "token", "df", "idf", "w", "leads"), "link-tokens")
    rows, size = asked.agg(F.sum("df"), F.sum(F.octet_length("token") + 64)).first()
    # A section's tokens are laid together before they meet the symbols', so what they make of each pair is summed where it arises.
    parts = max(int(postings.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-(rows or 0) // TASK_HITS))
    hits = postings.repartition(parts, "section").join(F.broadcast(asked), "token") if (size or 0) <= VOCABULARY_BYTES else postings.join(asked, "token")
    boost, accepted = F.lit(1.0), F.lit(False)
    if "boosts" in given:
        hits = hits.join(given["boosts"].groupBy("token").agg(F.max("boost").alias("boost")), "token", "left")
        boost = 1 + F.greatest(F.lit(-0.9), F.least(F.lit(2.0), F.coalesce("boost", F.lit(0.0))))
    if "accepted_tokens" in given:
        hits = hits.join(given["accepted_tokens"].select("token", F.lit(ACCEPTED_TOKEN).alias("told")).distinct(), "token", "left")
        boost = boost * F.coalesce("told", F.lit(1.0))
    # The idf depends on the df alone, so rare tokens are counted by it, the rarest first.
    found = hits.groupBy("symbol", "section").agg(
        F.sum(F.col("w") * F.col("tf")).alias("sum"), F.product(boost).alias("boost"), F.count("*").alias("n"), F.bool_or("leads").alias("leads"), F.array_sort(F.collect_list("token")).alias("shared"),
        *(F.count_if(F.col("df") == df).cast("int").alias(f"n{df}") for df in range(1, RARE + 1)),
    ).where("n >= 2")
    rare = F.slice(F.concat(*(F.array_repeat(idf_of(F.lit(df)), F.least(F.col(f"n{df}"), F.lit(RARE_TOKENS))) for df in range(1, RARE + 1))), 1, RARE_TOKENS)
    found = found.withColumn("rare", rare)
    of_pair = lambda i, j: F.when(F.size("rare") > j, F.least(F.lit(PAIR_MOST), F.get("rare", F.lit(i)) * F.get("rare", F.lit(j)) * PAIR_WEIGHT)).otherwise(0.0)
    bonus = sum(of_pair(i, j) for i in range(RARE_TOKENS) for j in range(i + 1, RARE_TOKENS))
    found = found.withColumn("score", (F.col("sum") + bonus) * F.col("boost"))
    if "rejected" in given:
        found = found.join(given["rejected"].select("symbol", "section"), ["symbol", "section"], "left_anti")
    if "accepted" in given:
        found = found.join(given["accepted"].select("symbol", "section", F.lit(True).alias("told")).distinct(), ["symbol", "section"], "left")
        accepted = F.coalesce("told", F.lit(False))
        found = found.withColumn("score", F.col("score") + F.when(accepted, ACCEPTED_LINK).otherwise(0.0))
    if prune:
        found = found.where(F.col("leads") | accepted)
    kept = found.withColumn("score", F.round("score", 6)).where(accepted | ((F.col("score") >= LEAST_SCORE) & (F.col("score") / (F.col("score") + SOFTNESS) >= LEAST_CONFIDENCE)))
    return kept.select("symbol", "section", "score", "shared")


def capped_links(explicit: DataFrame, concepts: DataFrame, names: Column | None = None, most: int = MOST_LINKS) -> DataFrame:
    """(symbol, section, score, explicit): the links that are kept of ``explicit(symbol, section, length)`` and ``concepts(symbol, section, score)``.

    A section takes its explicit links first, the longest matched names before others. Then links by concepts, best first, while their section has had
    fewer than PER_SECTION, their symbol fewer than PER_SYMBOL, and of that kind fewer than CONCEPTS_PER_SYMBOL. At most ``most`` in all, by
    score, then by ``names``, a text column of both tables, in the order of letters that readers expect.
    """
    told = explicit.groupBy("symbol", "section").agg(F.max("length").alias("length"))
    first = Window.partitionBy("section").orderBy(F.desc("length"), "symbol")
    told = written(told.withColumn("n", F.row_number().over(first)).where(F.col("n") <= PER_SECTION).select("symbol", "section"), "links-explicit")
    used = lambda key, name: told.groupBy(key).agg(F.count("*").cast("int").alias(name))
    rest = concepts.select("symbol", "section", "score").join(told, ["symbol", "section"], "left_anti").join(used("symbol", "us"), "symbol", "left").join(used("section", "ut"), "section", "left")
    room = rest.select(
        F.col("symbol").alias("query"), "section", "score", F.least(F.lit(CONCEPTS_PER_SYMBOL), PER_SYMBOL - F.coalesce("us", F.lit(0))).alias("rq"), (PER_SECTION - F.coalesce("ut", F.lit(0))).alias("rs")
    ).where("rq > 0 and rs > 0")
    taken = greedy_caps(room, CONCEPTS_PER_SYMBOL, PER_SECTION).select(F.col("query").alias("symbol"), "section", "score", F.lit(False).alias("explicit"))
    every = told.select("symbol", "section", F.lit(EXPLICIT_SCORE).alias("score"), F.lit(True).alias("explicit")).unionByName(taken)
    return every.orderBy(F.desc("score"), *([as_read(names)] if names is not None else []), "section", "symbol").limit(most)


def as_read(text: Column) -> Column:
    """A text in the order of letters that readers expect: marks, digits, then letters, small before capital ones of a kind."""
    return F.collate(text.cast("string"), "UNICODE")
