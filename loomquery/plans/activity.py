"""Named queries of journals, assignments and intervals, over logs and code that are made of the standard tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from loomquery.operators import chinese
from loomquery.operators._lineage import shared_path
from loomquery.plans.catalog import _query, _table
from loomquery.sources import journal

# A journal line of each click. Properties that are no JSON make the whole line malformed.
_LINE = """'{"instruction": ' || CASE WHEN kind IS NULL THEN '" "' ELSE '"' || kind || '"' END || ', "client": ' || coalesce(CAST(client_id AS VARCHAR(20)), 'null')
|| ', "steps": ' || CASE WHEN click_id % 7 = 0 THEN '[]' WHEN click_id % 7 = 1 THEN '[" ", {"cwd": "x"}]' WHEN click_id % 7 = 2 THEN '[{"cmd": "go"}]' ELSE '["go", 3]' END
|| ', "props": ' || coalesce(CASE WHEN click_id % 11 = 0 THEN substr(props, 2) ELSE props END, 'null') || '}'"""


@_query(f"""WITH lines AS (SELECT click_id, client_id, {_LINE} AS line, kind FROM clicks),
read AS (SELECT client_id, json_valid(line) AND kind IS NOT NULL AND click_id % 7 > 1 AS fine FROM lines)
SELECT 'c' || coalesce(CAST(client_id AS VARCHAR), 'null') AS file, count(*) AS entries, count(*) FILTER (NOT fine) AS invalid, count(*) FILTER (fine) AS uses FROM read GROUP BY 1""")
def journal_harvest(spark, sf_dir):
    """Entries, invalid ones and uses of each client's journal: written in two parts, read by a stream that is started again on its checkpoint."""
    lines = _table(spark, sf_dir, "clicks").select(F.expr(_LINE).alias("value"), F.pmod(F.xxhash64("click_id"), F.lit(2)).alias("part"))
    log, out, check = (shared_path(spark, f"journal-{x}") for x in ("log", "out", "check"))

    def keep(batch, number):
        # A batch that is run again after a failure replaces its own part.
        journal.harvest(journal.parsed(batch)).write.mode("overwrite").parquet(f"{out}/batch={number}")

    for part in range(2):
        lines.where(F.col("part") == part).select("value").write.mode("append").text(log)
        rows = journal.tail_journal(spark, log)
        rows = rows.select(F.concat(F.lit("c"), F.regexp_extract("raw", '"client": ([0-9]+|null)', 1)).alias("file"), "raw")
        rows.writeStream.trigger(availableNow=True).option("checkpointLocation", check).foreachBatch(keep).start().awaitTermination()
    return spark.read.parquet(out).groupBy("file").agg(*(F.sum(c).alias(c) for c in ("entries", "invalid", "uses")))


# Names of parts in Chinese characters, one a letter, the space being a stop word; pieces of names are the lexicon.
_LETTERS, _CHARS = "abcdefghijklmnopqrstuvwxyz ", "订单支付微信超时取消验签回调退款测试登录用户数据接口的"
_HAN = f"translate(lower(p_name), '{_LETTERS}', '{_CHARS}')"
_PIECE = "substr({x}, 1 + p_size % 6, 2 + p_partkey % 3)"
_GREEDY_SQL = """{n} AS (SELECT p_partkey, run, {start} AS i, '' AS out, 0 AS singles FROM names
  UNION ALL SELECT p_partkey, run, i {sign} n, {join}, singles + CAST(n = 1 AS INT)
  FROM (SELECT r.*, coalesce(list_filter([4, 3, 2], lambda k: {fits} AND list_contains(lex.l, {piece}))[1], 1) AS n FROM {n} r, lex WHERE {more}) t)"""


def _greedy_sql(name: str, back: bool) -> str:
    piece = "substr(run, i - {k} + 1, {k})" if back else "substr(run, i, {k})"
    token = f"(CASE WHEN n > 1 THEN '|' || {piece.format(k='n')} || '|' WHEN {piece.format(k='1')} = '的' THEN '|' ELSE {piece.format(k='1')} END)"
    return _GREEDY_SQL.format(
        n=name, start="length(run)" if back else "1", sign="-" if back else "+", join=f"{token} || out" if back else f"out || {token}", fits="i - k >= 0" if back else "i + k - 1 <= length(run)",
        piece=piece.format(k="CAST(k AS INT)"), more="i > 0" if back else "i <= length(run)",
    )


@_query(f"""WITH RECURSIVE names AS (SELECT p_partkey, {_HAN} AS run FROM part),
lex AS (SELECT list(DISTINCT w) AS l FROM (SELECT {_PIECE.format(x=_HAN)} AS w FROM part WHERE p_partkey % 7 = 0) WHERE length(w) > 1 AND NOT contains(w, '的')),
{_greedy_sql('ahead', False)}, {_greedy_sql('back', True)},
best AS (SELECT a.p_partkey, CASE WHEN b.singles <= a.singles THEN b.out ELSE a.out END AS out FROM ahead a JOIN back b ON a.p_partkey = b.p_partkey AND a.i > length(a.run) AND b.i = 0),
u AS (SELECT p_partkey, unnest(string_split(out, '|')) AS w, generate_subscripts(string_split(out, '|'), 1) AS o FROM best)
SELECT p_partkey, string_agg(w, ' ' ORDER BY o) AS words FROM (SELECT p_partkey, w, min(o) AS o FROM u WHERE length(w) > 1 GROUP BY ALL) GROUP BY 1""")
def chinese_words(spark, sf_dir):
    """Words of Chinese names by matches from either end."""
    part = _table(spark, sf_dir, "part")
    pieces = part.where("p_partkey % 7 = 0").select(F.expr(_PIECE.format(x=_HAN)).alias("word")).where("length(word) > 1 and not contains(word, '的')").distinct()
    none = lambda schema: spark.createDataFrame([], schema)
    lexicon = chinese.Lexicon(
        pieces, spark.createDataFrame([("的",)], "word string"), none("typo string, word string, ordinal int"), none("char string, sound string"), none("word string, peer string, ordinal int"),
        none("word string, english string, place int, ordinal int"),
    )
    found = part.select("p_partkey", chinese.segmented(F.expr(_HAN), chinese.automaton(lexicon))["words"].alias("w"))
    return found.where("size(w) > 0").select("p_partkey", F.array_join("w", " ").alias("words"))
