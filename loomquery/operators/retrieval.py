"""Inverted index, BM25, reciprocal ranks and near matches."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomquery.functions import text as T
from loomquery.operators._lineage import checkpointed, written

K1, B = 1.2, 0.75

#: Bytes of the words, 64 more for each, that ``within_vocabulary`` gathers and ``bm25`` broadcasts at most.
VOCABULARY_BYTES = 16 << 20
#: Links left at most that ``greedy_caps`` takes in one task.
FEW_LINKS = 100_000


def postings(df: DataFrame, key: str, tokens: Column, marked: bool = False) -> DataFrame:
    """(key, len, token): a row for each token, with the number of tokens of its key; ``marked``: and one of the empty token for each key that has any."""
    each = df.select(F.col(key).alias("key"), tokens.alias("tokens")).withColumn("len", F.size("tokens").cast("bigint"))
    return each.select("key", "len", F.explode(F.when(F.size("tokens") > 0, F.array_append("tokens", F.lit("")))) if marked else F.explode("tokens")).toDF("key", "len", "token")


def document_frequency(index: DataFrame) -> DataFrame:
    return index.groupBy("token").agg(F.count("*").alias("df"))


def mentions(index: DataFrame, names: DataFrame, name: str) -> DataFrame:
    """Three-valued: names under three characters are not indexed, so unknown (null)."""
    found = index.join(names.select(F.col(name).alias("token")), "token").groupBy("token").agg(F.count("*").alias("n"))
    out = names.join(found, names[name] == found.token, "left")
    return out.select(name, F.when(F.length(name) < 3, F.lit(None)).otherwise(F.coalesce("n", F.lit(0)) > 0).alias("mentioned"))


def bm25(queries: DataFrame, sections: DataFrame, least_shared: int = 2) -> DataFrame:
    """(query, section, shared, score) over ``postings`` on both sides, those of the sections marked, tokens distinct by key.

    Tokens in a quarter of the sections or more (four at least) are no evidence. Only sections' tokens that a query has are
    shuffled; each comes with its section's length. They are written once, with the sections' marks, and read for the number of sections, the
    frequencies and the hits, so texts are cut into tokens once.
    """
    wanted = written(queries.select("token").union(queries.sparkSession.createDataFrame([("",)], "token string")).distinct(), "bm25-tokens")
    if (wanted.agg(F.sum(F.octet_length("token") + 64)).first()[0] or 0) <= VOCABULARY_BYTES:
        wanted = F.broadcast(wanted)  # else all tokens of the sections are shuffled
    mine = written(sections.join(wanted, "token", "left_semi").select(F.col("key").alias("section"), "len", "token"), "bm25-postings")
    n, average = mine.where("token = ''").agg(F.count("*"), F.avg("len")).first()
    mine = mine.where("token <> ''")
    df = document_frequency(mine).where(~((F.col("df") >= 4) & (F.col("df") / F.lit(n or 1) >= 0.25)))
    idf = df.select("token", F.log(1 + (F.lit(n) - F.col("df") + 0.5) / (F.col("df") + 0.5)).alias("idf"))
    hits = queries.select(F.col("key").alias("query"), "token").join(idf, "token").join(mine, "token")
    tf = (K1 + 1) / (1 + K1 * (1 - B + B * F.col("len") / F.lit(average or 1.0)))
    return hits.groupBy("query", "section").agg(F.count("*").alias("shared"), F.round(F.sum(F.col("idf") * tf), 6).alias("score")).where(F.col("shared") >= least_shared)


def reciprocal_top(links: DataFrame, k: int = 3, margin: float = 0.72, least: float = 4.0, confidence: float = 0.32) -> DataFrame:
    """Links among the best k of both their ends, then within a margin of the best survivor of the query."""
    q = F.row_number().over(Window.partitionBy("query").orderBy(F.desc("score"), "section"))
    s = F.row_number().over(Window.partitionBy("section").orderBy(F.desc("score"), "query"))
    both = links.withColumns({"rq": q, "rs": s}).where((F.col("rq") <= k) & (F.col("rs") <= k))
    best = F.max("score").over(Window.partitionBy("query"))
    kept = both.withColumn("best", best).where((F.col("score") >= F.greatest(F.lit(least), margin * F.col("best"))) & (F.col("score") / (F.col("score") + 8) >= confidence))
    return kept.select("query", "section", "score")


def near_matches(left: DataFrame, right: DataFrame, key: str, words: str, least: float = 0.86) -> DataFrame:
    """Best partner of each left row by Jaccard of word sets; candidates share one of the rarest words."""
    index = right.select(F.col(key).alias("other"), F.col(words).alias("ow"), F.explode(words).alias("token"))
    df = index.groupBy("token").agg(F.count("*").alias("df"))
    # A pair at least this similar shares more than half of the words, so one of the rarer ones of the left set.
    ranked = left.select(F.col(key).alias("own"), F.col(words).alias("w"), F.explode(words).alias("token")).join(df, "token", "left")
    rank = F.row_number().over(Window.partitionBy("own").orderBy(F.coalesce("df", F.lit(0)), "token"))
    probes = ranked.withColumn("r", rank).where(F.col("r") <= F.floor(F.size("w") * (1 - least)) + 1)
    pairs = probes.join(index, "token").select("own", "w", "other", "ow").distinct()
    scored = pairs.withColumn("score", F.round(T.jaccard(F.col("w"), F.col("ow")), 6)).where(F.col("score") >= least)
    best = F.row_number().over(Window.partitionBy("own").orderBy(F.desc("score"), "other"))
    return scored.withColumn("rank", best).where("rank = 1").select("own", "other", "score")


def equal_texts(left: DataFrame, right: DataFrame, key: str, text: str) -> DataFrame:
    """(own, other, score): the least key of ``right`` with each left row's text, white space at its ends and case apart; blank texts have none."""
    plain = F.lower(F.trim(F.col(text)))
    others = right.select(plain.alias("plain"), F.col(key).alias("other"))
    own = left.select(F.col(key).alias("own"), plain.alias("plain")).where("plain <> ''")
    first = others.join(own.select("plain").distinct(), "plain", "left_semi").groupBy("plain").agg(F.min("other").alias("other"))
    return own.join(first, "plain").select("own", "other", F.lit(1.0).alias("score"))


def within_vocabulary(rows: DataFrame, left: DataFrame, words: str, least: float = 0.86, most: int = VOCABULARY_BYTES) -> DataFrame:
    """The ``rows`` that ``near_matches`` can give a left row for, and maybe others: ``least`` of their words are words of the left rows.

    A vocabulary of over ``most`` bytes is not gathered; then all rows stay, and only the rarest words decide.
    """
    vocabulary = left.select(F.explode(words).alias("word")).distinct()
    if (vocabulary.agg(F.sum(F.octet_length("word") + 64)).first()[0] or 0) > most:
        return rows
    known = frozenset(r[0] for r in vocabulary.collect())
    share = F.pandas_udf(lambda lists: lists.map(lambda ws: sum(w in known for w in ws) / max(len(ws), 1)), "double")
    return rows.where(share(words) >= least - 1e-6)  # scores are rounded to six places


def capped_ranking(scored: DataFrame, group: str, item: str, score: str, per_group: int, top: int, cut: float = 0.72) -> DataFrame:
    """Global top rows with at most ``per_group`` of a group, cut off below a share of the best score."""
    scored = written(scored, "scored")  # read for the best score and for the rest
    w = Window.partitionBy(group).orderBy(F.desc(score), item)
    capped = scored.withColumn("rank_in_group", F.row_number().over(w)).where(F.col("rank_in_group") <= per_group)
    best = scored.agg(F.max(score)).first()[0]
    return capped.where(F.col(score) >= F.lit(cut) * F.lit(best)).select(group, item, score).orderBy(F.desc(score), group, item).limit(top)


def _in_order(frames):
    """Takes the links of one task, sorted, while both ends have room; ``rq`` and ``rs`` are the room of the ends at first."""
    used_q, used_s = {}, {}
    for frame in frames:
        keep = []
        for q, s, rq, rs in zip(frame["query"], frame["section"], frame["rq"], frame["rs"]):
            fits = used_q.get(q, 0) < rq and used_s.get(s, 0) < rs
            keep.append(fits)
            if fits:
                used_q[q], used_s[s] = used_q.get(q, 0) + 1, used_s.get(s, 0) + 1
        yield frame[keep][["query", "section", "score"]]


def greedy_caps(links: DataFrame, per_query: int = 3, per_section: int = 3, few: int = FEW_LINKS) -> DataFrame:
    """Takes links best first, ties by (query, section), while both ends have room.

    In rounds: a link that is among the best left of each end, as many as that end has room for, is taken whatever
    becomes of the others; then ends without room lose what they have left. The best link left is always taken, and links that share no
    end don't wait for each other. When ``few`` links or less are left, as in the end of long chains, one task takes them in order. Rows of
    equal ends count once. ``rq`` and ``rs``, if the links have them, are the room of their query and section.
    """
    order = (F.desc("score"), "query", "section")
    room = {c: F.min(c) if c in links.columns else F.lit(most) for c, most in (("rq", per_query), ("rs", per_section))}
    left = checkpointed(links.groupBy("query", "section").agg(F.max("score").alias("score"), *(c.cast("int").alias(n) for n, c in room.items())))
    taken = None
    while (rest := left.count()) > few:
        ranks = {"kq": F.row_number().over(Window.partitionBy("query").orderBy(*order)), "ks": F.row_number().over(Window.partitionBy("section").orderBy(*order))}
        ranked = left.withColumns(ranks).withColumn("now", (F.col("kq") <= F.col("rq")) & (F.col("ks") <= F.col("rs")))
        used = {"uq": F.sum(F.col("now").cast("int")).over(Window.partitionBy("query")), "us": F.sum(F.col("now").cast("int")).over(Window.partitionBy("section"))}
        ranked = checkpointed(ranked.withColumns(used))
        now = ranked.where("now").select("query", "section", "score")
        taken = now if taken is None else taken.union(now)
        left = ranked.where("not now and uq < rq and us < rs").select("query", "section", "score", (F.col("rq") - F.col("uq")).cast("int").alias("rq"), (F.col("rs") - F.col("us")).cast("int").alias("rs"))
    kinds = ", ".join(f"{c} {dict(left.dtypes)[c]}" for c in ("query", "section", "score"))
    last = left.coalesce(1).sortWithinPartitions(*order).mapInPandas(_in_order, kinds) if rest else left.select("query", "section", "score")
    return last if taken is None else taken.union(last)
