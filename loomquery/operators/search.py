"""Ranked search of symbols by the words of a query."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomquery.functions import lexical as L
from loomquery.functions import text as T

# Words that a query does not search for.
STOP_WORDS = (
    "in on at by to of as is be or an it do if no so up we the and for with from that this what where when which who how why can could would should will please help find show all any into about does "
    "code file files function functions method methods logic impl implementation"
).split()
# Weights of a match and how many of a kind count.
PATH_NAME, PATH_WORD, EXACT, PART_OF_NAME, WORD, LONG_PART, SHORT_PART, SIGNATURE, STEM, NEAR_STEM, EXPORTED = 12, 3, 50, 20, 15, 14, 6, 2, 10, 8, 2
MOST_PARTS, MOST_WORDS, MOST_SIGNATURE, MOST_STEMS, LEAST_SCORE = 2, 4, 3, 3, 6


def query_words(text: Column) -> Column:
    return F.filter(T.words(text), lambda w: ~w.isin(STOP_WORDS))


def stems(words: Column) -> Column:
    return F.filter(F.array_distinct(F.transform(words, L.stem)), lambda s: F.length(s) >= 2)


def parts(query: Column) -> list[Column]:
    """What a query asks for: exact names, words and their stems."""
    names = F.transform(F.regexp_extract_all(query, F.lit(r"[a-zA-Z_$][a-zA-Z0-9_$/.:-]+"), F.lit(0)), F.lower)
    return [F.filter(F.array_distinct(names), lambda x: ~x.isin(STOP_WORDS)).alias("exact"), query_words(query).alias("words"), stems(query_words(query)).alias("stems")]


def score(path: Column, name: Column, signature: Column, exported: Column, exact: Column, words: Column, asked: Column) -> Column:
    """Score of a symbol for the ``parts`` of a query.

    A word counts in the name while fewer than MOST_WORDS did, else, where the signature holds it, there; words and stems
    take their turn in the order of the query. A symbol's own words and stems are worked out once.
    """

    def by_path(low):
        return PATH_NAME * F.size(F.filter(exact, low.contains)) + PATH_WORD * F.size(F.filter(words, low.contains))

    def by_name(s):
        low, whole = s["name"], lambda w: (s["name"] == w) | F.array_contains(s["own"], w)
        gain = lambda w: F.when(whole(w), WORD).when(F.length(w) >= 5, LONG_PART).otherwise(SHORT_PART)
        whole_name = F.when(F.array_contains(exact, low), EXACT).otherwise(PART_OF_NAME * F.least(F.lit(MOST_PARTS), F.size(F.filter(exact, low.contains))))
        first = F.slice(F.filter(words, lambda w: low.contains(w) | whole(w)), 1, MOST_WORDS)
        signed = lambda named: F.filter(words, lambda w: low.isNotNull() & ~F.array_contains(named, w) & s["signature"].contains(w))
        by_words = lambda named: F.aggregate(named, F.lit(0), lambda n, w: n + gain(w)) + SIGNATURE * F.least(F.lit(MOST_SIGNATURE), F.size(signed(named)))
        return whole_name + T.let(first, by_words)

    def by_stems(own):
        alike = lambda a: (F.length(a) >= 4) & F.exists(own, lambda o: T.fuzzy_equal(a, o))
        first = F.slice(F.filter(asked, lambda a: F.array_contains(own, a) | alike(a)), 1, MOST_STEMS)
        return F.aggregate(first, F.lit(0), lambda n, a: n + F.when(F.array_contains(own, a), STEM).otherwise(NEAR_STEM))

    symbol = F.struct(F.lower(name).alias("name"), F.lower(signature).alias("signature"), query_words(name).alias("own"))
    return T.let(F.lower(path), by_path) + T.let(symbol, lambda s: by_name(s) + T.let(stems(s["own"]), by_stems)) + F.when(exported, EXPORTED).otherwise(0)


def search(symbols: DataFrame, query: str, top: int | None = None, tests: bool = False) -> DataFrame:
    """(path, line, name, score) of the best symbols(path, line, name, signature, exported) of a query in English.

    Without ``top``, three at most: one alone if it scores 28 or more and leads by 45 percent, none below 72 percent of
    the best. Files of tests are left out unless asked for. One pass and a distributed top list, no shuffle of symbols.
    """
    rows = symbols if tests else symbols.where(~(F.col("path").startswith("tests/") | F.col("path").startswith("benchmarks/") | F.col("path").contains(".test.")))
    asked = symbols.sparkSession.range(0, 1, 1, 1).select(*parts(F.lit(query))).first()  # once: Spark folds no lambdas of constants
    points = score(F.col("path"), F.col("name"), F.coalesce("signature", F.lit("")), F.coalesce("exported", F.lit(False)), *(F.array(*map(F.lit, x)).cast("array<string>") for x in asked))
    scored = rows.select("path", "line", "name", points.alias("score"))
    best = scored.orderBy(F.desc("score"), "path", "line", "name").limit(top or 3).where(F.col("score") >= LEAST_SCORE)  # before the limit, the filter would work out the score again
    if top is not None:
        return best
    ranked = best.groupBy().agg(F.sort_array(F.collect_list(F.struct(-F.col("score"), "path", "line", "name", "score"))).alias("r"))
    first, second = F.col("r")[0]["score"], F.coalesce(F.try_element_at("r", F.lit(2))["score"], F.lit(0))
    alone = ((first - second) / first >= 0.45) & (first >= 28)
    kept = F.when(alone, F.slice("r", 1, 1)).otherwise(F.filter("r", lambda x: x["score"] >= first * 0.72))
    return ranked.where(F.size("r") > 0).select(F.explode(kept).alias("r")).select("r.path", "r.line", "r.name", "r.score")
