"""Named queries over the standard tables, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from loomquery.functions import text as T
from loomquery.operators import folding, graph, mining, resolve, retrieval, sessions
from loomquery.operators._lineage import written
from loomquery.plans.fixtures import cte, frame

_QUERIES: dict = {}
_SQL: dict[str, str] = {}


def _query(sql: str | None = None):
    def add(f):
        _QUERIES[f.__name__] = f
        if sql:
            _SQL[f.__name__] = sql
        return f

    return add


def queries() -> dict:
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(_SQL)


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _words_sql(column: str, least: int = 4) -> str:
    split = f"regexp_replace(regexp_replace({column}, '([A-Z]+)([A-Z][a-z])', '\\1 \\2', 'g'), '([a-z0-9])([A-Z])', '\\1 \\2', 'g')"
    return f"list_distinct(regexp_extract_all(lower({split}), '[a-z0-9]{{{least},}}'))"


# History mining

_BASKETS = """rows AS (SELECT DISTINCT l_orderkey AS basket, l_partkey AS item FROM lineitem
  WHERE l_orderkey IN (SELECT l_orderkey FROM lineitem GROUP BY 1 HAVING count(DISTINCT l_partkey) <= 20)),
n AS (SELECT item, count(*) AS n FROM rows GROUP BY 1)"""


def _baskets(spark, sf_dir):
    return mining.baskets(_table(spark, sf_dir, "lineitem"), "l_orderkey", "l_partkey", 20)


@_query(f"""WITH {_BASKETS},
p AS (SELECT a.item AS item_a, b.item AS item_b, count(*) AS support FROM rows a JOIN rows b ON a.basket = b.basket AND a.item < b.item GROUP BY ALL HAVING count(*) >= 2),
c AS (SELECT p.*, greatest(((200 * support + a.n) // (2 * a.n)) / 100, ((200 * support + b.n) // (2 * b.n)) / 100) AS confidence
  FROM p JOIN n a ON a.item = item_a JOIN n b ON b.item = item_b)
SELECT item_a, item_b, support, CAST(confidence AS DOUBLE) AS confidence FROM c WHERE confidence >= 0.05 ORDER BY support DESC, confidence DESC, item_a, item_b LIMIT 50""")
def cochange_pairs(spark, sf_dir):
    return mining.cochange_pairs(_baskets(spark, sf_dir), confidence=0.05)


@_query(f"WITH {_BASKETS} SELECT item, n FROM n ORDER BY n DESC, item LIMIT 15")
def hotspots(spark, sf_dir):
    return mining.hotspots(_baskets(spark, sf_dir))


@_query("""WITH e AS (SELECT user_id, event_type, lead(user_id) OVER (ORDER BY ts) AS nu, lead(event_type) OVER (ORDER BY ts) AS nk FROM events)
SELECT event_type AS first_kind, nk AS second_kind, count(*) AS support FROM e WHERE user_id = nu AND event_type <> nk GROUP BY ALL HAVING count(*) >= 2""")
def pipeline_pairs(spark, sf_dir):
    return mining.sequence_pairs(_table(spark, sf_dir, "events"), "ts", "user_id", "event_type")


@_query("SELECT event_id, event_type FROM events ORDER BY ts DESC LIMIT 500")
def retained_events(spark, sf_dir):
    return mining.latest(_table(spark, sf_dir, "events"), "ts").select("event_id", "event_type")


@_query("""WITH g AS (SELECT o_custkey, list_sort(list_distinct(list(o_orderpriority))) AS s FROM orders GROUP BY 1)
SELECT array_to_string(s, ',') AS bundle, count(*) AS support FROM g WHERE len(s) BETWEEN 2 AND 6 GROUP BY 1 HAVING count(*) >= 2""")
def read_bundles(spark, sf_dir):
    return mining.bundles(_table(spark, sf_dir, "orders"), "o_custkey", "o_orderpriority")


@_query(f"""WITH w AS (SELECT conv_id, list_distinct(flatten(list({_words_sql('text', 5)}) FILTER (role = 'user'))) AS z,
  list_distinct(flatten(list({_words_sql('text', 5)}) FILTER (role = 'assistant'))) AS e FROM conversations GROUP BY 1),
b AS (SELECT * FROM w WHERE len(z) > 0 AND len(e) > 0), t AS (SELECT count(*) AS n FROM b),
zz AS (SELECT x AS z, count(*) AS zc FROM (SELECT unnest(z) AS x FROM b) GROUP BY 1),
ee AS (SELECT x AS e, count(*) AS ec FROM (SELECT unnest(e) AS x FROM b) GROUP BY 1),
s AS (SELECT zx AS z, ex AS e, count(*) AS s FROM (SELECT zx, unnest(e) AS ex FROM (SELECT unnest(z) AS zx, e FROM b)) GROUP BY ALL),
j AS (SELECT s.*, zc, ec, log2(s * n / (zc * ec)) AS pmi FROM s JOIN zz USING (z) JOIN ee USING (e), t WHERE n < 20 OR (zc / n <= 0.12 AND ec / n <= 0.08)),
k AS (SELECT z, e, s AS support, round(pmi, 6) AS score FROM j WHERE (zc = ec AND ec = s) OR NOT ((s = 1 AND ec > 1 AND pmi < 2) OR pmi <= 0))
SELECT z, e, support, score, CAST(row_number() OVER (PARTITION BY z ORDER BY score DESC, support DESC, e) AS INT) AS rank FROM k
QUALIFY row_number() OVER (PARTITION BY z ORDER BY score DESC, support DESC, e) <= 4""")
def pmi_pairs(spark, sf_dir):
    rows = _table(spark, sf_dir, "conversations").withColumn("w", T.words(F.coalesce("text", F.lit("")), 5))
    side = lambda role: F.array_distinct(F.flatten(F.collect_list(F.when(F.col("role") == role, F.col("w")))))
    windows = rows.groupBy("conv_id").agg(side("user").alias("zs"), side("assistant").alias("es"))
    return mining.pmi(windows, "conv_id", "zs", "es")


# Retrieval

@_query("""WITH p AS (SELECT doc_id, unnest(list_distinct(regexp_extract_all(text, '[A-Za-z_$][A-Za-z0-9_$]{2,}'))) AS token FROM documents)
SELECT token, count(*) AS df FROM p GROUP BY 1""")
def identifier_postings(spark, sf_dir):
    docs = _table(spark, sf_dir, "documents")
    return retrieval.document_frequency(docs.select(F.explode(T.name_tokens(F.col("text"))).alias("token")))


@_query("""WITH p AS (SELECT DISTINCT unnest(regexp_extract_all(text, '[A-Za-z_$][A-Za-z0-9_$]{2,}')) AS token FROM documents), q AS (SELECT DISTINCT unnest(['the', 'is', 'token', 'idiot', 'License', 'nosuchword']) AS name)
SELECT name, CASE WHEN length(name) < 3 THEN NULL ELSE name IN (SELECT token FROM p) END AS mentioned FROM q""")
def mentions(spark, sf_dir):
    index = retrieval.postings(_table(spark, sf_dir, "documents"), "doc_id", T.name_tokens(F.col("text")))
    names = spark.createDataFrame([(x,) for x in ("the", "is", "token", "idiot", "License", "nosuchword")], "name string")
    return retrieval.mentions(index, names, "name")


_BM25 = f"""q AS (SELECT DISTINCT item_id AS query, unnest({_words_sql('text')}) AS token FROM benchmark),
s AS (SELECT DISTINCT doc_id AS section, unnest({_words_sql('text')}) AS token FROM documents),
len AS (SELECT section, count(*) AS len FROM s GROUP BY 1), t AS (SELECT count(*) AS n, avg(len) AS average FROM len),
df AS (SELECT token, count(*) AS df FROM s GROUP BY 1),
idf AS (SELECT token, ln(1 + (n - df + 0.5) / (df + 0.5)) AS idf FROM df, t WHERE NOT (df >= 4 AND df / n >= 0.25)),
links AS (SELECT query, section, count(*) AS shared, round(sum(idf * 2.2 / (1 + 1.2 * (0.25 + 0.75 * len / average))), 6) AS score
  FROM q JOIN idf USING (token) JOIN s USING (token) JOIN len USING (section), t GROUP BY ALL HAVING count(*) >= 2)"""


def _bm25(spark, sf_dir):
    words = lambda name, key, marked: retrieval.postings(_table(spark, sf_dir, name), key, T.words(F.col("text"), 4), marked)
    return retrieval.bm25(words("benchmark", "item_id", False), words("documents", "doc_id", True))


_RECIPROCAL = """r AS (SELECT *, row_number() OVER (PARTITION BY query ORDER BY score DESC, section) AS rq, row_number() OVER (PARTITION BY section ORDER BY score DESC, query) AS rs FROM links),
b AS (SELECT *, max(score) OVER (PARTITION BY query) AS best FROM r WHERE rq <= 3 AND rs <= 3)"""


@_query(f"WITH {_BM25}, {_RECIPROCAL} SELECT query, section, score FROM b WHERE score >= greatest(4, 0.72 * best) AND score / (score + 8) >= 0.32")
def bm25_links(spark, sf_dir):
    return retrieval.reciprocal_top(_bm25(spark, sf_dir))


@_query(f"""WITH {_BM25}, c AS (SELECT *, row_number() OVER (PARTITION BY query ORDER BY score DESC, section) AS k FROM links)
SELECT query, section, score FROM c WHERE k <= 2 AND score >= 0.72 * (SELECT max(score) FROM links) ORDER BY score DESC, query, section LIMIT 20""")
def capped_search(spark, sf_dir):
    return retrieval.capped_ranking(_bm25(spark, sf_dir), "query", "section", "score", 2, 20)


_GREEDY = """r AS (SELECT *, row_number() OVER (PARTITION BY query ORDER BY score DESC, section) AS rq, row_number() OVER (PARTITION BY section ORDER BY score DESC, query) AS rs FROM links),
b AS (SELECT *, max(score) OVER (PARTITION BY query) AS best FROM r WHERE rq <= 8 AND rs <= 8),
k AS (SELECT list([{'q': query, 's': section, 'v': score}] ORDER BY score DESC, query, section) AS l FROM b WHERE score >= greatest(4, 0.2 * best) AND score / (score + 8) >= 0.32),
g AS (SELECT unnest(list_reduce(l, lambda a, x: CASE WHEN len(list_filter(a, lambda y: y.q = x[1].q)) < 3 AND len(list_filter(a, lambda y: y.s = x[1].s)) < 3 THEN list_concat(a, x) ELSE a END)) AS x FROM k)"""


@_query(f"WITH {_BM25}, {_GREEDY} SELECT x.q AS query, x.s AS section, x.v AS score FROM g")
def greedy_doc_links(spark, sf_dir):
    return retrieval.greedy_caps(retrieval.reciprocal_top(_bm25(spark, sf_dir), k=8, margin=0.2))


_SENTENCES_SQL = """SELECT {key}, place, text, {words} AS w FROM (SELECT {key}, unnest(l) AS text, generate_subscripts(l, 1) - 1 AS place FROM (SELECT {key}, string_split_regex(text, '[.!?\\n]+') AS l FROM {table}))"""


@_query(f"""WITH a AS ({_SENTENCES_SQL.format(key='item_id', table='benchmark', words=_words_sql('text'))}), b AS ({_SENTENCES_SQL.format(key='doc_id', table='documents', words=_words_sql('text'))}),
p AS (SELECT item_id, a.place AS sentence, doc_id, b.place AS doc_sentence, round(len(list_intersect(a.w, b.w)) / len(list_distinct(list_concat(a.w, b.w))), 6) AS score
  FROM a JOIN b ON len(a.w) >= 3 AND len(b.w) >= 3 AND len(b.w) BETWEEN 0.85 * len(a.w) AND len(a.w) / 0.85
  UNION ALL SELECT item_id, a.place, doc_id, b.place, 1.0 FROM a JOIN b ON len(a.w) < 3 AND lower(trim(a.text)) = lower(trim(b.text)) AND trim(a.text) <> '')
SELECT item_id, CAST(sentence AS INT) AS sentence, doc_id, CAST(doc_sentence AS INT) AS doc_sentence, score FROM p WHERE score >= 0.86
QUALIFY row_number() OVER (PARTITION BY item_id, sentence ORDER BY score DESC, doc_id, doc_sentence) = 1""")
def near_match(spark, sf_dir):
    """Best document sentence of each benchmark sentence, of the whole texts: by words, those of under three words by the whole text."""
    def sentences(name, key):
        rows = _table(spark, sf_dir, name).select(key, F.posexplode(F.split("text", "[.!?\n]+")).alias("place", "text"))
        return rows.select(F.struct(key, "place").alias("key"), "text", T.words(F.col("text"), 4).alias("w"))

    left, right = sentences("benchmark", "item_id"), sentences("documents", "doc_id")
    some = F.size("w") >= 3
    near = written(retrieval.within_vocabulary(right.where(some).drop("text"), left.where(some), "w"), "near-sentences")  # read twice
    best = retrieval.near_matches(left.where(some), near, "key", "w").unionByName(retrieval.equal_texts(left.where(~some), right, "key", "text"))
    return best.select("own.item_id", F.col("own.place").alias("sentence"), "other.doc_id", F.col("other.place").alias("doc_sentence"), "score")


@_query()
def near_lines(spark, sf_dir):
    """Best document line of each benchmark item: all items against all lines of the whole texts, items of under three words by the whole text."""
    words, some = T.words(F.col("text"), 4), F.size("w") >= 3
    line = F.posexplode(F.split("text", "\r?\n")).alias("line", "text")
    lines = _table(spark, sf_dir, "documents").select("doc_id", line).select(F.struct("doc_id", "line").alias("key"), "text", words.alias("w"))
    items = _table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("key"), "text", words.alias("w"))
    near = written(retrieval.within_vocabulary(lines.where(some).drop("text"), items.where(some), "w"), "near-lines")  # read twice
    best = retrieval.near_matches(items.where(some), near, "key", "w").unionByName(retrieval.equal_texts(items.where(~some), lines, "key", "text"))
    return best.select(F.col("own").alias("item_id"), "other.doc_id", "other.line", "score")


@_query(f"""WITH {_BM25}, r AS (SELECT query, section, row_number() OVER (PARTITION BY query ORDER BY score DESC, section) AS rank FROM links)
SELECT CAST(count(*) AS BIGINT) AS n_queries, round(avg(CASE WHEN rank <= 1 THEN 1.0 ELSE 0 END), 6) AS p_at_1 FROM
(SELECT query, min(rank) AS rank FROM r JOIN documents d ON d.doc_id = section JOIN benchmark b ON b.item_id = query AND contains(d.text, b.text) GROUP BY 1)""")
def recall_at_1(spark, sf_dir):
    links = _bm25(spark, sf_dir)
    ranked = links.withColumn("rank", F.row_number().over(Window.partitionBy("query").orderBy(F.desc("score"), "section")))
    docs = _table(spark, sf_dir, "documents").select(F.col("doc_id").alias("section"), F.col("text").alias("dt"))
    bench = _table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query"), F.col("text").alias("bt"))
    gold = ranked.join(docs, "section").join(bench, "query").where(F.contains("dt", F.col("bt"))).groupBy("query").agg(F.min("rank").alias("rank"))
    return gold.agg(F.count("*").alias("n_queries"), F.round(F.avg(F.when(F.col("rank") <= 1, 1.0).otherwise(0.0)), 6).alias("p_at_1"))


# Graph

@_query("""SELECT l_partkey AS id, count(DISTINCT l_suppkey) AS importers FROM lineitem GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 6""")
def hub_in_degree(spark, sf_dir):
    rows = _table(spark, sf_dir, "lineitem")
    edges = rows.select(F.concat(F.lit("s"), F.col("l_suppkey")).alias("source"), F.col("l_partkey").cast("string").alias("target"))
    parts = rows.select(F.col("l_partkey").alias("key"), F.col("l_partkey").cast("string").alias("id")).distinct()
    top = parts.join(edges.groupBy("target").agg(F.countDistinct("source").alias("importers")), parts.id == F.col("target"))
    return top.select(F.col("key").alias("id"), "importers").orderBy(F.desc("importers"), "id").limit(6)


@_query("""WITH RECURSIVE e AS (SELECT 'c' || c_custkey AS s, 'n' || c_nationkey AS t FROM customer UNION SELECT 'n' || n_nationkey, 'r' || n_regionkey FROM nation UNION SELECT 'r' || n_regionkey, 'n' || n_nationkey FROM nation),
r(node, hops) AS (SELECT 'c1', 0 UNION SELECT t, hops + 1 FROM r JOIN e ON s = node WHERE hops < 6) SELECT node, CAST(min(hops) AS INT) AS hops FROM r GROUP BY 1""")
def reach_6(spark, sf_dir):
    c, n = _table(spark, sf_dir, "customer"), _table(spark, sf_dir, "nation")
    name = lambda p, k: F.concat(F.lit(p), F.col(k))
    edges = c.select(name("c", "c_custkey").alias("source"), name("n", "c_nationkey").alias("target"))
    edges = edges.union(n.select(name("n", "n_nationkey"), name("r", "n_regionkey"))).union(n.select(name("r", "n_regionkey"), name("n", "n_nationkey"))).distinct()
    return graph.reachable(spark.createDataFrame([("c1",)], "node string"), edges)


_SNAPSHOTS = """a AS (SELECT o_orderkey AS path, CAST(o_totalprice AS VARCHAR) AS f FROM orders WHERE o_orderstatus <> 'P'),
b AS (SELECT o_orderkey AS path, CASE WHEN o_orderpriority = '2-HIGH' THEN 'new' ELSE CAST(o_totalprice AS VARCHAR) END AS f FROM orders WHERE o_orderpriority <> '1-URGENT')"""


@_query(f"""WITH {_SNAPSHOTS} SELECT coalesce(a.path, b.path) AS path, CASE WHEN a.path IS NULL THEN 'added' WHEN b.path IS NULL THEN 'removed' WHEN a.f = b.f THEN 'same' ELSE 'changed' END AS status FROM a FULL JOIN b ON a.path = b.path""")
def fingerprint_diff(spark, sf_dir):
    """Two states of a store: before, open orders are not in it; after, urgent ones are gone and high ones changed."""
    path, price = F.col("o_orderkey").alias("path"), F.col("o_totalprice").cast("string")
    orders = _table(spark, sf_dir, "orders")
    old = orders.where("o_orderstatus <> 'P'").select(path, price.alias("fingerprint"))
    new = orders.where("o_orderpriority <> '1-URGENT'").select(path, F.when(F.col("o_orderpriority") == "2-HIGH", "new").otherwise(price).alias("fingerprint"))
    return graph.fingerprint_diff(old, new)


@_query(f"""WITH {_SNAPSHOTS}, d AS (SELECT coalesce(a.path, b.path) AS path, CASE WHEN a.path IS NULL THEN 'added' WHEN b.path IS NULL THEN 'removed' WHEN a.f = b.f THEN 'same' ELSE 'changed' END AS status FROM a FULL JOIN b ON a.path = b.path),
names AS (SELECT DISTINCT o_custkey FROM orders JOIN d ON path = o_orderkey AND status <> 'same')
SELECT path FROM d WHERE status IN ('added', 'changed') UNION SELECT o_orderkey FROM orders WHERE o_custkey IN (SELECT o_custkey FROM names) UNION SELECT o_orderkey FROM orders WHERE o_orderstatus = 'P'""")
def dirty_set(spark, sf_dir):
    diff = fingerprint_diff(spark, sf_dir)
    orders = _table(spark, sf_dir, "orders")
    names = orders.select(F.col("o_orderkey").alias("path"), F.col("o_custkey").alias("name"))
    return graph.dirty_files(diff, names, names, orders.where("o_orderstatus = 'P'").select(F.col("o_orderkey").alias("path")))


@_query(f"""WITH RECURSIVE {cte('parents')}, k(child, ancestor, depth) AS (SELECT child, parent, 1 FROM parents UNION SELECT k.child, p.parent, depth + 1 FROM k JOIN parents p ON p.child = k.ancestor WHERE depth < 8)
SELECT child, ancestor, CAST(min(depth) AS INT) AS depth FROM k WHERE child <> ancestor GROUP BY ALL""")
def inheritance_closure(spark, sf_dir):
    return graph.closure(frame(spark, "parents"))


@_query(f"""WITH {cte('files', 'symbols', 'calls')}, e AS (SELECT 'defines' AS kind, 1 AS k, path AS source, path || '#' || name AS target FROM symbols
UNION SELECT 'calls', 3, c.path, s.path || '#' || s.name FROM calls c JOIN symbols s ON s.name = c.callee)
SELECT kind, source, target FROM e WHERE source IN (SELECT path FROM files)""")
def code_graph(spark, sf_dir):
    files, symbols, calls = (frame(spark, n) for n in ("files", "symbols", "calls"))
    node = F.concat("path", F.lit("#"), "name")
    defines = symbols.select(F.lit("defines").alias("kind"), F.col("path").alias("source"), node.alias("target"), "ordinal")
    targets = symbols.select("name", node.alias("target"))
    used = calls.join(targets, calls.callee == targets.name).select(F.lit("calls"), "path", "target", "line")
    nodes = files.select(F.col("path").alias("id")).union(symbols.select(node))
    return graph.merge_edges(defines.union(used), nodes)


# Resolution on the parsed code base

_IMPORTS = """tried AS (SELECT path, module, names, p.i AS prio, regexp_replace(CASE WHEN module LIKE '../%' THEN regexp_extract(regexp_extract(path, '^(.*)/[^/]*$', 1), '^(.*?)/?[^/]*$', 1) || '/' || regexp_replace(module, '^\\.\\./', '')
  ELSE regexp_extract(path, '^(.*)/[^/]*$', 1) || '/' || regexp_replace(module, '^\\./', '') END, '(^/|\\.js$)', '', 'g') || p.s AS candidate
  FROM imports, (VALUES (0, ''), (1, '.ts'), (2, '.tsx'), (3, '.js'), (4, '.jsx'), (5, '.py'), (6, '/index.ts'), (7, '/index.js'), (8, '/__init__.py')) p(i, s) WHERE module LIKE '.%'),
best AS (SELECT t.path, module, arg_min(candidate, prio) AS target FROM tried t JOIN files f ON f.path = candidate GROUP BY ALL)"""


@_query(f"WITH {cte('imports', 'files')}, {_IMPORTS} SELECT i.path, i.module, target FROM imports i LEFT JOIN best b ON b.path = i.path AND b.module = i.module")
def import_resolution(spark, sf_dir):
    return resolve.resolve_imports(frame(spark, "imports"), frame(spark, "files"))


@_query(f"""WITH {cte('calls', 'symbols')}, h AS (SELECT c.path, c.line AS point, s.name, row_number() OVER (PARTITION BY c.path, c.line ORDER BY s.last - s.first, ordinal) AS k FROM calls c JOIN symbols s ON s.path = c.path AND c.line BETWEEN s.first AND s.last)
SELECT c.path, c.line AS point, h.name FROM calls c LEFT JOIN h ON h.path = c.path AND h.point = c.line AND k = 1""")
def enclosing_symbol(spark, sf_dir):
    return resolve.enclosing(frame(spark, "calls").select("path", F.col("line").alias("point")), frame(spark, "symbols"))


@_query("""WITH s AS (SELECT user_id, event_type, min(event_id) AS a, max(event_id) AS b FROM events GROUP BY ALL),
h AS (SELECT e.event_id, s.event_type AS name, row_number() OVER (PARTITION BY e.event_id ORDER BY b - a, a) AS k FROM events e JOIN s ON s.user_id = e.user_id AND e.event_id BETWEEN a AND b)
SELECT e.user_id AS path, e.event_id AS point, name FROM events e LEFT JOIN h ON h.event_id = e.event_id AND k = 1""")
def enclosing_interval(spark, sf_dir):
    events = _table(spark, sf_dir, "events")
    spans = events.groupBy(F.col("user_id").alias("path"), F.col("event_type").alias("name")).agg(F.min("event_id").alias("first"), F.max("event_id").alias("last"))
    return resolve.enclosing(events.select(F.col("user_id").alias("path"), F.col("event_id").alias("point")), spans.withColumn("ordinal", F.col("first")))


@_query(f"""WITH RECURSIVE {cte('calls', 'symbols', 'parents')}, k(child, ancestor, depth) AS (SELECT DISTINCT receiver_class, receiver_class, 0 FROM calls WHERE receiver_class IS NOT NULL
  UNION SELECT k.child, p.parent, depth + 1 FROM k JOIN parents p ON p.child = k.ancestor WHERE depth < 30),
h AS (SELECT c.path, c.line, c.callee, s.parent_class AS target_class, s.path AS target_path, CAST(CASE WHEN k.depth = 0 THEN 0.95 ELSE 0.9 END AS DOUBLE) AS confidence,
  row_number() OVER (PARTITION BY c.path, c.line, c.callee ORDER BY k.depth, s.path <> c.path, s.path, s.ordinal) AS r
  FROM calls c JOIN k ON k.child = c.receiver_class JOIN symbols s ON s.name = c.callee AND s.parent_class = k.ancestor)
SELECT path, line, callee, target_class, target_path, confidence FROM h WHERE r = 1""")
def method_resolution(spark, sf_dir):
    return resolve.resolve_methods(frame(spark, "calls"), frame(spark, "symbols"), graph.closure(frame(spark, "parents")))


def _resolved(spark):
    return resolve.resolve_calls(frame(spark, "calls"), frame(spark, "symbols"), resolve.resolve_imports(frame(spark, "imports"), frame(spark, "files")).join(frame(spark, "imports"), ["path", "module"]))


_FAMILY = "CASE WHEN {0} LIKE '%.ts' THEN 'js' WHEN {0} LIKE '%.py' THEN 'python' WHEN {0} LIKE '%.go' THEN 'go' ELSE 'other' END"
_CALLS = f"""{cte('calls', 'symbols', 'imports', 'files')}, {_IMPORTS},
free AS (SELECT name AS callee, path AS tp, {_FAMILY.format('path')} AS fam FROM symbols WHERE parent_class IS NULL),
plain AS (SELECT path, line, callee, {_FAMILY.format('path')} AS fam FROM calls WHERE receiver_class IS NULL),
pairs AS (SELECT plain.*, tp, count(*) OVER (PARTITION BY path, line, plain.callee) AS c FROM plain JOIN free ON free.callee = plain.callee AND free.fam = plain.fam),
named AS (SELECT b.path, target, unnest(names) AS callee FROM best b JOIN imports i ON i.path = b.path AND i.module = b.module),
staged AS (SELECT *, 1 AS stage, 0.9 AS confidence FROM pairs WHERE tp = path UNION ALL SELECT p.*, 2, 0.95 FROM pairs p WHERE EXISTS (SELECT 1 FROM named n WHERE n.path = p.path AND n.target = p.tp AND n.callee = p.callee)
  UNION ALL SELECT *, 3, 0.8 FROM pairs WHERE fam = 'go' AND tp <> path AND regexp_extract(tp, '^(.*)/', 1) = regexp_extract(path, '^(.*)/', 1) UNION ALL SELECT *, 4, 0.6 FROM pairs WHERE c = 1),
resolved AS (SELECT p.path, p.line, p.callee, arg_min(tp, stage) AS target_path, CAST(coalesce(arg_min(confidence, stage), 0) AS DOUBLE) AS confidence FROM plain p LEFT JOIN staged s ON s.path = p.path AND s.line = p.line AND s.callee = p.callee GROUP BY ALL)"""


@_query(f"WITH {_CALLS} SELECT * FROM resolved")
def call_resolution(spark, sf_dir):
    return _resolved(spark)


@_query(f"WITH {_CALLS} SELECT path, line, path LIKE '%.spec.%' AS is_test, count(*) OVER () AS total, CAST(row_number() OVER (ORDER BY path LIKE '%.spec.%', path, line) AS INT) AS rank FROM resolved WHERE target_path = 'src/util/index.ts' AND callee = 'format' AND confidence >= 0.75")
def blast_radius(spark, sf_dir):
    return resolve.blast_radius(_resolved(spark), "src/util/index.ts", "format")


@_query("""WITH m AS (SELECT DISTINCT l_suppkey, l_returnflag FROM lineitem), r AS (SELECT DISTINCT l_returnflag FROM lineitem)
SELECT l_suppkey AS type, 'flags' AS interface FROM m GROUP BY 1 HAVING count(*) = (SELECT count(*) FROM r)""")
def interface_division(spark, sf_dir):
    rows = _table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("type"), F.col("l_returnflag").alias("member")).distinct()
    return resolve.implementers(rows, rows.select(F.lit("flags").alias("interface"), "member").distinct())


@_query(f"""WITH {cte('calls', 'symbols', 'new_symbols')}, d AS (SELECT s.name, s.params_count AS was, n.params_count AS now FROM symbols s JOIN new_symbols n ON n.name = s.name WHERE s.params_count <> n.params_count)
SELECT path, line, callee, args_count, was, now FROM calls JOIN d ON d.name = callee WHERE args_count > now OR (now > was AND args_count < now)""")
def guard_arity(spark, sf_dir):
    return resolve.arity_guard(frame(spark, "calls"), frame(spark, "symbols"), frame(spark, "new_symbols"))


@_query(f"""WITH {cte('calls', 'symbols', 'new_symbols')}, g AS (SELECT path AS from_path, name FROM symbols s WHERE exported AND NOT EXISTS (SELECT 1 FROM new_symbols n WHERE n.path = s.path AND n.name = s.name))
SELECT from_path, name, count(*) AS uses FROM g JOIN calls ON callee = name AND path <> from_path GROUP BY ALL""")
def guard_removed(spark, sf_dir):
    return resolve.removed_exports(frame(spark, "symbols"), frame(spark, "new_symbols"), frame(spark, "calls"))


@_query(f"WITH {cte('old_fields', 'new_fields')} SELECT o.name, x.field FROM old_fields o JOIN new_fields n ON n.name = o.name, (SELECT unnest(o.fields) AS field) x WHERE NOT list_contains(n.fields, x.field)")
def guard_fields(spark, sf_dir):
    return resolve.removed_fields(frame(spark, "old_fields"), frame(spark, "new_fields"))


@_query(f"WITH {cte('imports', 'files')}, {_IMPORTS} SELECT i.path, i.module FROM imports i LEFT JOIN best b ON b.path = i.path AND b.module = i.module WHERE i.module LIKE '.%' AND target IS NULL")
def guard_imports(spark, sf_dir):
    imports = frame(spark, "imports")
    return resolve.broken_imports(imports.where("false"), imports, frame(spark, "files"))


# Sessions

@_query("""WITH e AS (SELECT *, event_type = 'error' AS f FROM events), i AS (SELECT *, sum(CASE WHEN f THEN 0 ELSE 1 END) OVER (PARTITION BY user_id ORDER BY event_id ROWS UNBOUNDED PRECEDING) AS island FROM e)
SELECT user_id, min(event_id) AS first_seq, count(*) AS streak FROM i WHERE f GROUP BY user_id, island HAVING count(*) >= 2""")
def failure_streaks(spark, sf_dir):
    return sessions.failure_streaks(_table(spark, sf_dir, "events"), "user_id", "event_id", F.col("event_type") == "error", trip=2)


@_query("""WITH r AS (SELECT *, lag(text) OVER (PARTITION BY conv_id, role ORDER BY turn) = text AS same FROM conversations) SELECT conv_id, turn, coalesce(same, false) AS repeat FROM r""")
def read_dedup(spark, sf_dir):
    rows = _table(spark, sf_dir, "conversations")
    return sessions.repeated_reads(rows, "conv_id", "role", "turn", F.sha2("text", 256)).select("conv_id", "turn", "repeat")


@_query("""WITH e AS (SELECT *, CAST(floor(epoch(ts)) AS BIGINT) AS s FROM events), n AS (SELECT max(s) AS now FROM e)
SELECT event_type AS status, count(*) AS n, count(*) FILTER (now - s > 864000) AS expired, max(now - s) AS oldest FROM e, n GROUP BY 1""")
def ttl_report(spark, sf_dir):
    rows = _table(spark, sf_dir, "events").select("event_type", F.unix_seconds(F.col("ts").cast("timestamp")).alias("created"))
    now = rows.agg(F.max("created")).first()[0] or 0
    return sessions.expiry_report(rows, "created", "event_type", F.lit(now), 864000)


@_query("SELECT user_id, event_id FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY event_id) = 2")
def promotions(spark, sf_dir):
    return sessions.promotions(_table(spark, sf_dir, "events"), "user_id", "event_id")


@_query(f"""WITH {cte('macros')} SELECT macro, state, action, CASE WHEN hash = saved_hash THEN CASE state || '-' || action WHEN 'discovered-propose' THEN 'proposed' WHEN 'proposed-approve' THEN 'approved' WHEN 'approved-activate' THEN 'active'
WHEN 'active-revoke' THEN 'revoked' WHEN 'approved-revoke' THEN 'revoked' END END AS next_state FROM macros""")
def macro_trust(spark, sf_dir):
    return sessions.trust_steps(frame(spark, "macros"))


@_query(f"""WITH {cte('runs')}, r AS (SELECT *, row_number() OVER (PARTITION BY variant ORDER BY duration_ms) AS k, count(*) OVER (PARTITION BY variant) AS n FROM runs)
SELECT variant, CAST(count(*) AS BIGINT) AS n_runs, avg(duration_ms) AS mean_ms, max(CASE WHEN k = ceil(0.95 * n) THEN duration_ms END) AS p95_ms, round(avg(success::INT), 6) AS success_rate FROM r GROUP BY 1""")
def ab_report(spark, sf_dir):
    runs = frame(spark, "runs").withColumns({"k": F.row_number().over(Window.partitionBy("variant").orderBy("duration_ms")), "n": F.count("*").over(Window.partitionBy("variant"))})
    p95 = F.max(F.when(F.col("k") == F.ceil(0.95 * F.col("n")), F.col("duration_ms")))
    return runs.groupBy("variant").agg(F.count("*").alias("n_runs"), F.avg("duration_ms").alias("mean_ms"), p95.alias("p95_ms"), F.round(F.avg(F.col("success").cast("int")), 6).alias("success_rate"))


# Folding

@_query("""WITH h AS (SELECT page_id AS key, unnest(regexp_extract_all(html, '(?is)<h[1-4][^>]*>.*?</h[1-4]>')) AS raw, generate_subscripts(regexp_extract_all(html, '(?is)<h[1-4][^>]*>.*?</h[1-4]>'), 1) - 1 AS n FROM pages)
SELECT key, CAST(n AS INT) AS n, CAST(regexp_extract(raw, '(?i)^<h([1-4])', 1) AS INT) AS level,
replace(replace(replace(replace(replace(trim(regexp_replace(regexp_replace(raw, '<[^>]*>', ' ', 'g'), '\\s+', ' ', 'g')), '&lt;', '<'), '&gt;', '>'), '&amp;', '&'), '&quot;', '"'), '&apos;', '''') AS title FROM h""")
def page_headings(spark, sf_dir):
    return folding.headings(_table(spark, sf_dir, "pages"), "page_id", "html")


@_query("""WITH l AS (SELECT doc_id AS key, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS no FROM documents),
s AS (SELECT key, sum(CASE WHEN length(line) < 20 THEN 1 ELSE 0 END) OVER (PARTITION BY key ORDER BY no ROWS UNBOUNDED PRECEDING) AS section FROM l)
SELECT key, CAST(section AS BIGINT) AS section, count(*) AS n_lines FROM s GROUP BY ALL""")
def document_sections(spark, sf_dir):
    rows = folding.lines(_table(spark, sf_dir, "documents"), "doc_id", "text")
    return folding.sections(rows, F.length("line") < 20).groupBy("key", "section").agg(F.count("*").alias("n_lines"))


@_query("""WITH l AS (SELECT doc_id AS key, len(string_split(text, chr(10))) AS n FROM documents WHERE text IS NOT NULL)
SELECT key, CAST(CASE WHEN n <= 12 THEN n ELSE least(n, 8) END AS BIGINT) AS shown, CAST(CASE WHEN n <= 12 THEN 0 ELSE greatest(n - 8, 0) END AS BIGINT) AS omitted FROM l""")
def log_fold(spark, sf_dir):
    return folding.head_tail(folding.lines(_table(spark, sf_dir, "documents"), "doc_id", "text"), 12, 4, 4)


@_query("""WITH l AS (SELECT page_id AS key, unnest(string_split(html, '<p>')) AS line, generate_subscripts(string_split(html, '<p>'), 1) AS no FROM pages),
c AS (SELECT key, sum(length(line) + 1) OVER (PARTITION BY key ORDER BY no) AS up, sum(length(line) + 1) OVER (PARTITION BY key ORDER BY no DESC) AS down FROM l)
SELECT key, count(*) FILTER (up <= 1300 OR down <= 700) AS kept, count(*) FILTER (NOT (up <= 1300 OR down <= 700)) AS omitted FROM c GROUP BY 1""")
def budget_fold(spark, sf_dir):
    rows = _table(spark, sf_dir, "pages").select(F.col("page_id").alias("key"), F.posexplode(F.split("html", "<p>")).alias("no", "line"))
    return folding.budget_fit(rows, 2000)


# Scalar functions

# Paths of sixteen kinds, made of the keys of a table, in the dialect of both engines.
_PATH_KINDS = """CASE p_partkey % 16 WHEN 0 THEN 'src/m' || p_partkey || '.ts' WHEN 1 THEN 'src/__tests__/m' || p_partkey || '.tsx' WHEN 2 THEN 'py/test_m' || p_partkey || '.py' WHEN 3 THEN 'py/m' || p_partkey || '_test.py'
WHEN 4 THEN 'py/tests/conftest.py' WHEN 5 THEN 'go/m' || p_partkey || '_test.go' WHEN 6 THEN 'cs/M' || p_partkey || 'Tests.cs' WHEN 7 THEN 'cs/M' || p_partkey || 'Test.cs' WHEN 8 THEN 'web/m' || p_partkey || '.spec.js'
WHEN 9 THEN 'rs/m' || p_partkey || '_test.rs' WHEN 10 THEN 'dist/m' || p_partkey || '.js' WHEN 11 THEN 'a/Cargo.lock' WHEN 12 THEN 'src/m' || p_partkey || '/index.ts' WHEN 13 THEN 'tests/m' || p_partkey || '.go'
WHEN 14 THEN 'py/m' || p_partkey || '/__init__.py' ELSE 'c/m' || p_partkey || '.cpp' END"""


@_query(f"""WITH f AS (SELECT DISTINCT {_PATH_KINDS} AS path FROM part), n AS (SELECT path, regexp_extract(path, '([^/]*)$', 1) AS base, lower(regexp_extract(path, '(\\.[^./]*)$', 1)) AS ext, regexp_extract(path, '([^/]+)/[^/]*$', 1) AS parent FROM f),
s AS (SELECT *, regexp_replace(regexp_replace(regexp_replace(regexp_replace(base, '(\\.(test|spec))?\\.(ts|tsx|js|py|go|rs|cs|cpp)$', ''), '^test_', ''), '_test$', ''), 'Tests?$', '') AS stem FROM n)
SELECT path, CASE WHEN ext IN ('.ts', '.tsx', '.js') THEN 'js' WHEN ext = '.py' THEN 'python' WHEN ext = '.go' THEN 'go' WHEN ext = '.rs' THEN 'rust' WHEN ext = '.cs' THEN 'csharp' WHEN ext = '.cpp' THEN 'c' ELSE 'other' END AS family,
NOT (starts_with(path, 'dist/') OR base = 'Cargo.lock') AS trackable,
CASE WHEN base IN ('conftest.py', '__init__.py') THEN FALSE WHEN ext = '.py' THEN starts_with(base, 'test_') OR ends_with(base, '_test.py') WHEN ext = '.go' THEN ends_with(base, '_test.go') WHEN ext = '.cs' THEN ends_with(base, 'Test.cs') OR ends_with(base, 'Tests.cs')
  ELSE regexp_matches(path, '(^|/)(test|tests|__tests__|spec)/') OR contains(path, '.test.') OR contains(path, '.spec.') OR ends_with(base, '_test.rs') END AS is_test,
CASE WHEN stem IN ('index', '__init__', 'mod') AND parent <> '' THEN stem || ',' || parent ELSE stem END AS stems FROM s""")
def path_functions(spark, sf_dir):
    p = F.col("path")
    paths = _table(spark, sf_dir, "part").selectExpr(f"{_PATH_KINDS} AS path").distinct()
    return paths.select("path", T.language_family(p).alias("family"), T.is_trackable(p).alias("trackable"), T.is_test_path(p).alias("is_test"), F.array_join(T.path_stems(p), ",").alias("stems"))


@_query(f"""WITH {cte('commands')} SELECT cmd, cmd IN ('git status', 'ls -la') AS noise, cmd IN ('cargo run', 'npm run dev &') OR contains(cmd, 'vite') AS long_running,
CASE WHEN cmd LIKE '%.test.ts' THEN 'npx vitest run {{{{arg1}}}}' WHEN cmd LIKE 'curl%' THEN 'curl {{{{arg1}}}}' WHEN cmd LIKE 'node%' THEN 'node scripts/tool.cjs {{{{arg1}}}}' ELSE cmd END AS template, CASE WHEN cmd LIKE 'curl%' THEN 'process-start,external-network' ELSE 'process-start' END AS permissions FROM commands""")
def command_functions(spark, sf_dir):
    c = F.col("cmd")
    return frame(spark, "commands").select("cmd", T.is_noise_command(c).alias("noise"), T.is_long_running(c).alias("long_running"), T.command_template(c).alias("template"), F.array_join(T.permissions(F.lit("pipeline"), c), ",").alias("permissions"))


@_query(f"""WITH {cte('names')} SELECT a, b, a = b OR (least(length(a), length(b)) >= 4 AND a[1] = b[1] AND damerau_levenshtein(a, b) <= 1) AS fuzzy FROM names""")
def fuzzy_tokens(spark, sf_dir):
    return frame(spark, "names").select("a", "b", T.fuzzy_equal(F.col("a"), F.col("b")).alias("fuzzy"))


@_query("""SELECT item_id, CAST(greatest(1, ceil(length(text) / 4)) AS BIGINT) AS tokens, regexp_replace(lower(text), '[^a-z0-9]', '', 'g') AS key, sha256(text) AS digest FROM benchmark""")
def text_functions(spark, sf_dir):
    t = F.col("text")
    return _table(spark, sf_dir, "benchmark").select("item_id", T.token_estimate(t).alias("tokens"), T.identifier_key(t).alias("key"), F.sha2(t, 256).alias("digest"))


# Outputs of runs; the status line of a failed one comes before the names of its tests.
_OUTPUT = """CASE event_id % 6 WHEN 0 THEN 'PASS' || chr(10) || user_id || ' passed' WHEN 1 THEN 'FAIL [exit=' || (user_id % 3) || ']' || chr(10) || CASE WHEN user_id % 4 = 0 THEN '' ELSE 'FAIL' || CASE WHEN user_id % 4 = 1 THEN 'ED' ELSE '' END || ' adds item ' || user_id || chr(10) END
|| CASE WHEN user_id % 3 = 0 THEN 'TS2304: no name' ELSE 'AssertionError: ' || event_type END || chr(10) || '  at run (src' || CASE WHEN user_id % 5 = 0 THEN chr(92) ELSE '/' END || 'a' || (user_id % 9) || '.ts:3:' || event_id || ')'
WHEN 2 THEN 'TIMEOUT after 5 s' WHEN 3 THEN 'NONE [affected-tests]' WHEN 4 THEN 'x' || chr(10) || 'FAIL [exit=1] y' || chr(10) || '✗ ' || event_type || chr(13) || chr(10) || 'EACCES lib.py:7 seen' ELSE 'hello' END"""
_PART = "coalesce(nullif(regexp_extract({x}, '{p}', 1), ''), 'unknown')"
_PARTS_SQL = [
    _PART.format(x="output", p="\\b(TS[0-9]{4}|E[A-Z_]{2,}|AssertionError|Error)\\b"), _PART.format(x="output", p="\\b([a-zA-Z0-9_./\\\\-]+\\.(?:ts|tsx|js|py|go|rs|cs|cpp|c):[0-9]+(?::[0-9]+)?)"),
    _PART.format(x="regexp_replace(output, '(?m)^FAIL \\[exit=', '.', 'g')", p="(?m)^(?:FAIL|FAILED|✗)\\s+([^\\r\\n]{1,100})"), _PART.format(x="output", p="\\bat\\s+([^\\r\\n]{1,100})"),
]


@_query(f"""WITH o AS (SELECT event_id, 'run ' || (user_id % 7) AS command, {_OUTPUT} AS output FROM events),
p AS (SELECT event_id, command, output, [{', '.join(_PARTS_SQL)}] AS parts FROM o)
SELECT event_id, CASE WHEN regexp_matches(output, '(?m)^TIMEOUT\\b') THEN 'TIMEOUT' WHEN regexp_matches(output, '(?m)^NONE \\[affected-tests\\]') THEN 'NO_TESTS' WHEN regexp_matches(output, '(?m)^PASS\\b') THEN 'PASS' WHEN regexp_matches(output, '(?m)^FAIL\\b') THEN 'FAIL' ELSE 'UNKNOWN' END AS status,
  array_to_string(parts, '|') AS parts, 'sha256:' || sha256('["' || command || '","' || array_to_string(list_transform(parts, lambda x: replace(x, chr(92), chr(92) || chr(92))), '","') || '","h"]') AS fingerprint FROM p""")
def output_functions(spark, sf_dir):
    rows = _table(spark, sf_dir, "events").selectExpr("event_id", "'run ' || (user_id % 7) AS command", f"{_OUTPUT} AS output")
    o = F.col("output")
    return rows.select("event_id", T.run_status(o).alias("status"), F.array_join(T.failure_parts(o), "|").alias("parts"), T.failure_fingerprint(F.col("command"), o, F.lit("h")).alias("fingerprint"))


@_query("SELECT s_name AS name, regexp_replace(s_name, '[^A-Za-z0-9._-]+', '_', 'g')[1:48] || '-' || sha1(s_name)[1:8] AS branch FROM supplier")
def branch_keys(spark, sf_dir):
    return _table(spark, sf_dir, "supplier").select(F.col("s_name").alias("name"), T.branch_key(F.col("s_name")).alias("branch"))


@_query("""SELECT event_type AS kind, count(*) AS n, CAST(sum(greatest(1, ceil(length(props) / 4))) AS BIGINT) AS tokens FROM events GROUP BY 1""")
def kind_histogram(spark, sf_dir):
    return _table(spark, sf_dir, "events").groupBy(F.col("event_type").alias("kind")).agg(F.count("*").alias("n"), F.sum(T.token_estimate(F.col("props"))).alias("tokens"))
