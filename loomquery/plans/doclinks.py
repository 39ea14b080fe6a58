"""Named queries of links between documents and symbols with weighted fields and coupled caps."""

from __future__ import annotations

from pyspark.sql import functions as F

from loomquery.functions import text as T
from loomquery.operators import doclinks, documents, retrieval
from loomquery.plans.catalog import _query, _table, _words_sql

# Benchmark items are symbols, named by their first 40 characters; documents are sections, titled by their first line.
_FIELDS = f"""w AS (SELECT key, token, sum(weight) AS weight FROM (
  SELECT item_id AS key, unnest({_words_sql('left(text, 40)')}) AS token, 3.0 AS weight FROM benchmark UNION ALL SELECT item_id, unnest({_words_sql('text')}), 1.0 FROM benchmark) GROUP BY ALL),
s AS (SELECT key, token, sum(weight) AS weight FROM (
  SELECT doc_id AS key, unnest({_words_sql("split_part(text, chr(10), 1)")}) AS token, 2.0 AS weight FROM documents UNION ALL SELECT doc_id, unnest({_words_sql('text')}), 1.0 FROM documents) GROUP BY ALL),
len AS (SELECT key, greatest(1.0, sum(weight)) AS len FROM s GROUP BY 1), t AS (SELECT count(*) AS n, greatest(1.0, avg(len)) AS average, (SELECT count(DISTINCT key) FROM w) AS m FROM len),
sd AS (SELECT token, count(*) AS df FROM s GROUP BY 1), wd AS (SELECT token, count(*) AS df FROM w GROUP BY 1),
idf AS (SELECT sd.token, sd.df, ln(1 + (n - sd.df + 0.5) / (sd.df + 0.5)) AS idf FROM sd JOIN wd ON sd.token = wd.token, t
  WHERE NOT (sd.df >= 4 AND sd.df / n >= 0.25) AND NOT (wd.df >= 6 AND wd.df / m >= 0.35)),
hits AS (SELECT w.key AS symbol, s.key AS section, idf.df, idf.idf, w.weight * idf.idf * s.weight * 2.2 / (s.weight + 1.2 * (0.25 + 0.75 * len.len / average)) AS part
  FROM w JOIN idf ON w.token = idf.token JOIN s ON s.token = w.token JOIN len ON len.key = s.key, t),
sums AS (SELECT symbol, section, sum(part) AS part, list_reverse_sort(coalesce(list(idf) FILTER (df <= 2), []))[1:4] AS r FROM hits GROUP BY ALL HAVING count(*) >= 2),
links AS (SELECT symbol, section, round(part + CASE WHEN len(r) >= 2 THEN least(2.0, r[1] * r[2] * 0.25) ELSE 0 END + CASE WHEN len(r) >= 3 THEN least(2.0, r[1] * r[3] * 0.25) ELSE 0 END + CASE WHEN len(r) >= 4 THEN least(2.0, r[1] * r[4] * 0.25) ELSE 0 END
  + CASE WHEN len(r) >= 3 THEN least(2.0, r[2] * r[3] * 0.25) ELSE 0 END + CASE WHEN len(r) >= 4 THEN least(2.0, r[2] * r[4] * 0.25) ELSE 0 END + CASE WHEN len(r) >= 4 THEN least(2.0, r[3] * r[4] * 0.25) ELSE 0 END, 6) AS score FROM sums),
strong AS (SELECT * FROM links WHERE score >= 4 AND score / (score + 8) >= 0.32),
ranked AS (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY score DESC, section) AS rq, row_number() OVER (PARTITION BY section ORDER BY score DESC, symbol) AS rs FROM strong),
best AS (SELECT *, max(score) OVER (PARTITION BY symbol) AS top FROM ranked WHERE rq <= 3 AND rs <= 3),
pruned AS (SELECT symbol, section, score FROM best WHERE score >= greatest(4, 0.72 * top))"""
_EXPLICIT = "SELECT b.item_id AS symbol, d.doc_id AS section, 3 + d.doc_id % 5 AS length FROM benchmark b JOIN documents d ON b.item_id % 40 = d.doc_id % 40 AND (b.item_id + d.doc_id) % 3 = 0"


def _concepts(spark, sf_dir):
    part = lambda table, key, text: _table(spark, sf_dir, table).select(F.col(key).alias("key"), F.explode(T.words(text, 4)).alias("token"))
    text = F.col("text")
    symbols = doclinks.weighted({"name": part("benchmark", "item_id", F.substring("text", 1, 40)), "doc": part("benchmark", "item_id", text)}, doclinks.SYMBOL_WEIGHTS)
    sections = doclinks.weighted({"title": part("documents", "doc_id", F.split(text, "\n")[0]), "body": part("documents", "doc_id", text)}, doclinks.SECTION_WEIGHTS)
    scored = doclinks.concept_scores(symbols, sections)
    return retrieval.reciprocal_top(scored.select(F.col("symbol").alias("query"), "section", "score")).withColumnRenamed("query", "symbol")


@_query(f"WITH {_FIELDS} SELECT symbol, section, score FROM pruned")
def fielded_links(spark, sf_dir):
    """Links of benchmark items and documents by weighted fields, among the best of both their ends."""
    return _concepts(spark, sf_dir)


@_query(f"""WITH {_FIELDS}, e AS ({_EXPLICIT}), told AS (SELECT symbol, section FROM e QUALIFY row_number() OVER (PARTITION BY section ORDER BY length DESC, symbol) <= 3),
us AS (SELECT symbol, count(*) AS n FROM told GROUP BY 1), ut AS (SELECT section, count(*) AS n FROM told GROUP BY 1),
room AS (SELECT p.*, least(2, 3 - coalesce(us.n, 0)) AS rq, 3 - coalesce(ut.n, 0) AS rs FROM pruned p LEFT JOIN us ON us.symbol = p.symbol LEFT JOIN ut ON ut.section = p.section
  WHERE NOT EXISTS (SELECT 1 FROM told t WHERE t.symbol = p.symbol AND t.section = p.section)),
k AS (SELECT list([{{'q': symbol, 's': section, 'v': score, 'rq': rq, 'rs': rs}}] ORDER BY score DESC, symbol, section) AS l FROM room WHERE rq > 0 AND rs > 0),
g AS (SELECT unnest(list_reduce(l, lambda a, x: CASE WHEN len(list_filter(a, lambda y: y.q = x[1].q)) < x[1].rq AND len(list_filter(a, lambda y: y.s = x[1].s)) < x[1].rs THEN list_concat(a, x) ELSE a END)) AS x FROM k),
every AS (SELECT symbol, section, 100.0 AS score, TRUE AS explicit FROM told UNION ALL SELECT x.q, x.s, x.v, FALSE FROM g)
SELECT symbol, section, score, explicit FROM every ORDER BY score DESC, section, symbol LIMIT 100000""")
def capped_doc_links(spark, sf_dir):
    """Explicit links, then links by concepts, under the caps of sections and symbols."""
    items, docs = _table(spark, sf_dir, "benchmark").select("item_id"), _table(spark, sf_dir, "documents").select("doc_id")
    items, docs = items.withColumn("k", F.col("item_id") % 40), docs.withColumn("k", F.col("doc_id") % 40)
    explicit = items.join(docs, "k").where("(item_id + doc_id) % 3 = 0").select(F.col("item_id").alias("symbol"), F.col("doc_id").alias("section"), (3 + F.col("doc_id") % 5).alias("length"))
    return doclinks.capped_links(explicit, _concepts(spark, sf_dir), most=100_000)


# Documents of three formats made of the pages' HTML: as it is, as elements with names, and with short lines as headings.
_KIND = "CASE page_id % 3 WHEN 0 THEN 'html' WHEN 1 THEN 'md' ELSE 'xml' END"
_CONTENT = "CASE page_id % 3 WHEN 0 THEN html WHEN 1 THEN replace(replace(html, '<p>', chr(10)), '<h', chr(10) || '# <h') ELSE replace(replace(html, '<h', chr(10) || '<part name=\"a' || page_id || '\" h'), '<p>', chr(10) || '<p>') END"


@_query(f"""WITH p AS (SELECT page_id, {_KIND} AS format, {_CONTENT} AS content FROM pages),
h AS (SELECT page_id, format, regexp_replace(regexp_replace(regexp_replace(regexp_replace(content, '<(script)\\b[^>]*>.*?</script>', '', 'gis'), '<(style)\\b[^>]*>.*?</style>', '', 'gis'), '<h[1-4]\\b[^>]*>(.*?)</h[1-4]>', chr(10) || '# \\1' || chr(10), 'gis'), '<[^>]+>', ' ', 'g') AS t FROM p WHERE format = 'html'),
x AS (SELECT page_id, format, array_to_string(list_filter(flatten(list_transform(string_split_regex(content, '\\r?\\n'), lambda l: [
    CASE WHEN regexp_matches(l, '(?i)<([a-z0-9_:-]+)\\b[^>]*\\b(?:name|id|key|symbol)="([^"]+)"') THEN '# ' || regexp_extract(l, '(?i)<([a-z0-9_:-]+)\\b[^>]*\\b(?:name|id|key|symbol)="([^"]+)"', 1) || ': ' || regexp_extract(l, '(?i)<([a-z0-9_:-]+)\\b[^>]*\\b(?:name|id|key|symbol)="([^"]+)"', 2) END,
    nullif(replace(replace(replace(replace(replace(trim(regexp_replace(l, '<[^>]+>', ' ', 'g')), '&lt;', '<'), '&gt;', '>'), '&amp;', '&'), '&quot;', '"'), '&apos;', ''''), '')])), lambda y: y IS NOT NULL), chr(10)) AS t FROM p WHERE format = 'xml'),
d AS (SELECT page_id, format, replace(replace(replace(replace(replace(t, '&lt;', '<'), '&gt;', '>'), '&amp;', '&'), '&quot;', '"'), '&apos;', '''') AS t FROM h UNION ALL SELECT * FROM x UNION ALL SELECT page_id, format, content FROM p WHERE format = 'md'),
l AS (SELECT page_id, format, unnest(string_split_regex(t, '\\r?\\n')) AS line, generate_subscripts(string_split_regex(t, '\\r?\\n'), 1) AS no FROM d WHERE regexp_matches(t, '\\S')),
m AS (SELECT *, regexp_matches(line, '^#{{1,4}}\\s+.') AS heading, regexp_replace(line, '^\\s+|\\s+$', '', 'g') AS trimmed FROM l),
r AS (SELECT *, sum(CAST(heading AS INT)) OVER (PARTITION BY page_id ORDER BY no) AS n FROM m),
s AS (SELECT page_id, format, n, max(regexp_replace(regexp_replace(line, '^#{{1,4}}\\s+', ''), '\\s+$', '')) FILTER (heading) AS title, min(no) AS first, max(no) AS last, coalesce(string_agg(trimmed, chr(10) ORDER BY no) FILTER (NOT heading AND trimmed <> ''), '') AS body FROM r GROUP BY ALL),
k AS (SELECT *, max(CAST(body <> '' AS INT)) OVER (PARTITION BY page_id) AS any_body, max(n) OVER (PARTITION BY page_id) AS final FROM s)
SELECT 'docs/' || page_id || '.' || format AS path, CAST(row_number() OVER (PARTITION BY page_id ORDER BY n) AS INT) AS n, coalesce(title, page_id || '.' || format) AS title, CAST(CASE WHEN n = 0 THEN 1 ELSE first END AS INT) AS start_line, CAST(last AS INT) AS end_line,
  substr(regexp_replace(body, '\\s+', ' ', 'g'), 1, 220) AS summary FROM k WHERE body <> '' OR (any_body = 0 AND n = final)""")
def document_outline(spark, sf_dir):
    """Sections of documents in three formats."""
    pages = _table(spark, sf_dir, "pages").selectExpr(f"concat('docs/', page_id, '.', {_KIND}) AS path", f"{_KIND} AS format", f"{_CONTENT} AS content")
    return documents.sections(pages).select("path", "n", "title", "start_line", "end_line", "summary")
