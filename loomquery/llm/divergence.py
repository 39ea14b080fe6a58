"""Divergence of the sources of each language by smoothed term shares, over an inverted index of terms."""

from __future__ import annotations

import re
from collections import Counter

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ._common import materialize, pieces, salted_join, table

LEAST_DOCS, SMOOTH, SCALE, TOP_TERMS = 30, 5, 1_000_000_000, 50
#: Sources of a posting list's block; pairs of blocks are rows of their own, so a term of very many sources is many rows.
BLOCK_SOURCES = 256
#: Entries of a task's table of counts before it is emitted.
HELD_TERMS = 200_000

_TERM = re.compile(rb"[a-z\x80-\xff]+")
_COUNTS = pa.schema([("lang", pa.string()), ("source", pa.string()), ("term", pa.string()), ("n", pa.int64()), ("docs", pa.int64())])


def term_counts(docs: DataFrame) -> DataFrame:
    """(lang, source, term, n, docs): occurrences and documents of each term, of ``docs(text, lang, source)`` without nulls.

    A term is a run of letters of ASCII and characters beyond it, with A-Z lower-cased. Tasks add up what they read before the shuffle.
    """

    def count(batches):
        held = {}

        def emit():
            rows = [(lang, source, term.decode("utf-8", "replace"), n, d) for (lang, source), (terms, in_docs) in held.items() for term, n in terms.items() for d in (in_docs[term],)]
            columns = list(zip(*rows)) or [()] * 5
            held.clear()
            for i in range(0, len(rows), 20_000):
                yield pa.RecordBatch.from_arrays([pa.array(c[i : i + 20_000], f.type) for c, f in zip(columns, _COUNTS)], schema=_COUNTS)

        for batch in batches:
            for piece in pieces(batch, 0):
                for text, lang, source in zip(*(piece.column(i).to_pylist() for i in range(3))):
                    found = Counter(_TERM.findall(text.encode("utf-8", "surrogatepass").lower()))
                    terms, in_docs = held.setdefault((lang, source), (Counter(), Counter()))
                    terms.update(found)
                    in_docs.update(found.keys())
                if sum(len(t) for t, _ in held.values()) > HELD_TERMS:
                    yield from emit()
        yield from emit()

    counted = docs.select("text", "lang", "source").mapInArrow(count, "lang string, source string, term string, n bigint, docs bigint")
    return counted.groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))


def share(n: Column, total: Column, terms: Column) -> Column:
    """1 + floor(SCALE (n + SMOOTH) / (total + SMOOTH terms)), exact for any count that a bigint holds."""
    wide = lambda c: c.cast("decimal(19,0)")
    return F.call_function("div", wide(n + SMOOTH) * F.lit(SCALE).cast("decimal(10,0)"), wide(total + SMOOTH * terms)) + 1


def audit(docs: DataFrame, least_docs: int = LEAST_DOCS, top: int = TOP_TERMS) -> DataFrame:
    """(lang, source, part, item, value, rank): how far the sources of a language are from each other, and each one's marked terms.

    ``docs(text, lang, source)``; nulls are empty texts. With z the difference of two sources' shares of a term that neither holds, their
    distance starts at V z. A term of one source adds |p - z'| - z, z' the other's share of no occurrence: that is summed for all terms of a source at
    once, from its counts of terms of each share below the language's largest z'. Only terms of both, the postings, then give corrections.
    """
    docs = docs.select(*(F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("text", "lang", "source")))
    counts = materialize(term_counts(docs), "audit-counts")
    terms = counts.groupBy("lang", "term").agg(F.sum("n").alias("lang_n"), F.sum("docs").alias("docs")).where(F.col("docs") >= least_docs).drop("docs")
    kept = materialize(counts.drop("docs").join(terms.hint("shuffle_merge"), ["lang", "term"]), "audit-kept")
    # Every group and language that occurs, also those without terms.
    sums = kept.groupBy("lang", "source").agg(F.sum("n").alias("size"), F.count("*").alias("own"))
    groups = materialize(docs.select("lang", "source").distinct().join(sums.hint("shuffle_merge"), ["lang", "source"], "left").na.fill(0), "audit-groups")
    words = kept.groupBy("lang", "term").agg(F.max("lang_n").alias("n")).groupBy("lang").agg(F.count("*").alias("V"), F.sum("n").alias("lang_size"))
    langs = groups.groupBy("lang").agg(F.ceil(F.count("*") / BLOCK_SOURCES).alias("blocks"), F.min("size").alias("least"))
    langs = langs.join(words.hint("shuffle_merge"), "lang", "left").na.fill(0).withColumnRenamed("lang", "lang2")
    groups = salted_join(groups, materialize(langs, "audit-langs"), "lang", "lang2", F.xxhash64("source"), F.octet_length("lang2") + 60)
    zero = lambda n: F.when(F.col("V") > 0, share(F.lit(0), n, F.col("V"))).otherwise(0)
    groups = groups.select(
        F.struct("lang", "source").alias("group"), "own", "size", "V", "lang_size", zero(F.col("size")).alias("zero"), zero(F.col("least")).alias("most"),
        F.pmod(F.xxhash64("source"), F.col("blocks")).alias("block"),
    )
    groups = materialize(groups, "audit-shares")
    held = kept.select(F.struct("lang", "source").alias("g"), "term", "n", "lang_n")
    held = salted_join(held, groups, "g", "group", F.xxhash64("term"), F.octet_length("group.lang") + F.octet_length("group.source") + 100)
    held = held.select("g.*", "term", "block", "zero", "most", share(F.col("n"), F.col("size"), F.col("V")).alias("p"), share(F.col("lang_n"), F.col("lang_size"), F.col("V")).alias("q"))
    held = materialize(held, "audit-postings")
    marked = held.select("lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"), (F.col("p") - F.col("q")).alias("value")).where("value > 0")
    # What the terms of one source add to a distance.
    low = held.where("p < most").groupBy("lang", "source", "p").agg(F.count("*").alias("terms")).groupBy("lang", "source").agg(F.collect_list(F.struct("p", "terms")).alias("low"))
    total = held.groupBy("lang", "source").agg(F.sum("p").alias("total"))
    sides = groups.select("group.*", "block", "V", "own", "zero").join(total.hint("shuffle_merge"), ["lang", "source"], "left").join(low.hint("shuffle_merge"), ["lang", "source"], "left")
    side = F.struct(F.col("source").alias("name"), "zero", "own", F.coalesce("total", F.lit(0)).alias("total"), F.coalesce("low", F.array()).alias("low"))
    pairs = block_pairs(materialize(sides.select("lang", "block", "V", side.alias("s")), "audit-sides"), ["lang"])
    a, b, z = F.col("a"), F.col("b"), F.abs(F.col("a.zero") - F.col("b.zero"))
    start = F.col("V") * z + own_terms(a, b.zero) - a.own * z + own_terms(b, a.zero) - b.own * z
    starts = pairs.select("lang", a["name"].alias("x"), b["name"].alias("y"), start.alias("value"))
    # What terms of both correct.
    both = block_pairs(held.select("lang", "term", "block", F.struct(F.col("source").alias("name"), "p", "zero").alias("s")), ["lang", "term"])
    fix = F.abs(a.p - b.p) - F.abs(a.p - b.zero) - F.abs(b.p - a.zero) + z
    fixes = both.select("lang", a["name"].alias("x"), b["name"].alias("y"), fix.alias("value")).where("value != 0")
    distance = starts.unionByName(fixes).groupBy("lang", "x", "y").agg(F.sum("value").alias("value"))
    ways = F.explode(F.array(F.struct(F.col("x").alias("source"), F.col("y").alias("item")), F.struct(F.col("y").alias("source"), F.col("x").alias("item"))))
    distance = distance.select("lang", ways.alias("way"), "value").select("lang", "way.source", F.lit("pair").alias("part"), "way.item", "value")
    order = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    ranked = marked.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)
    return distance.withColumn("rank", F.row_number().over(order)).unionByName(ranked)


def own_terms(one: Column, zero: Column) -> Column:
    """Sum of |p - zero| over the terms of a source."""
    below = F.aggregate(one.low, F.lit(0).cast("bigint"), lambda s, x: s + F.when(x.p < zero, x.terms * (zero - x.p)).otherwise(0))
    return one.total - one.own * zero + 2 * below


def block_pairs(rows: DataFrame, keys: list[str]) -> DataFrame:
    """All pairs (a, b) of the items s of a key with a.name < b.name: each item meets its key's blocks, of BLOCK_SOURCES items or so."""
    blocks = rows.groupBy(*keys, "block").agg(F.collect_list("s").alias("others")).drop("block")
    met = rows.join(blocks.hint("shuffle_merge"), keys)
    later = F.filter("others", lambda o: o["name"] > F.col("s")["name"])
    return met.select(*(c for c in rows.columns if c not in ("block", "s")), F.col("s").alias("a"), F.explode(later).alias("b"))


def op12_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distances of all sources of each language, and the terms that mark each source.

    Null and empty texts have no terms but their group occurs; repeated rows count as documents of their own. A language
    without kept terms has distances 0, in the order of names. Other columns are not read. An empty table gives no rows.
    """
    return audit(table(spark, sf_dir, "documents"))


OP12_SQL = """
WITH docs AS (
  SELECT row_number() OVER () AS r, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
    regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS words
  FROM documents),
tokens AS (SELECT r, lang, source, unnest(words) AS term FROM docs),
kept AS (SELECT lang, term FROM tokens GROUP BY lang, term HAVING count(DISTINCT r) >= 30),
counts AS (SELECT t.lang, t.source, t.term, count(*) AS n FROM tokens t JOIN kept k ON t.lang = k.lang AND t.term = k.term GROUP BY ALL),
groups AS (SELECT DISTINCT lang, source FROM docs),
sizes AS (SELECT lang, count(*) AS V FROM kept GROUP BY lang),
totals AS (SELECT lang, source, sum(n) AS N FROM counts GROUP BY ALL),
dense AS (SELECT g.lang, g.source, k.term, s.V, coalesce(t.N, 0) AS total FROM groups g JOIN kept k ON g.lang = k.lang JOIN sizes s ON g.lang = s.lang LEFT JOIN totals t ON g.lang = t.lang AND g.source = t.source),
shares AS (
  SELECT d.lang, d.source, d.term, coalesce(c.n, 0) AS n, 1 + (1000000000::HUGEINT * (coalesce(c.n, 0) + 5)) // (d.total + 5 * d.V) AS p
  FROM dense d LEFT JOIN counts c ON d.lang = c.lang AND d.source = c.source AND d.term = c.term),
whole AS (
  SELECT l.lang, l.term, 1 + (1000000000::HUGEINT * (l.n + 5)) // (sum(l.n) OVER (PARTITION BY l.lang) + 5 * s.V) AS q
  FROM (SELECT lang, term, sum(n) AS n FROM counts GROUP BY ALL) l JOIN sizes s ON l.lang = s.lang),
pairs AS (
  SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(f.value, 0) AS value
  FROM groups a JOIN groups b ON a.lang = b.lang AND a.source <> b.source
  LEFT JOIN (SELECT x.lang, x.source, y.source AS item, sum(abs(x.p - y.p)) AS value FROM shares x JOIN shares y ON x.lang = y.lang AND x.term = y.term AND x.source <> y.source GROUP BY ALL) f
    ON f.lang = a.lang AND f.source = a.source AND f.item = b.source),
marked AS (SELECT s.lang, s.source, 'term' AS part, s.term AS item, s.p - w.q AS value FROM shares s JOIN whole w ON s.lang = w.lang AND s.term = w.term WHERE s.n > 0 AND s.p > w.q),
ranked AS (
  SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS rank
  FROM (SELECT * FROM pairs UNION ALL SELECT * FROM marked))
SELECT lang, source, part, item, CAST(value AS BIGINT) AS value, CAST(rank AS INTEGER) AS rank FROM ranked WHERE part = 'pair' OR rank <= 50
"""
