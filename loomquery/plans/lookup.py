"""Queries on aliases, exports, receivers, types, documents, affected tests, habits and words; registered with the catalog."""

from __future__ import annotations

from pyspark.sql import functions as F

from loomquery.functions import lexical as L
from loomquery.functions import text as T
from loomquery.operators import folding, graph, lookup, mining, retrieval, search, sessions
from loomquery.plans.catalog import _query, _table, _words_sql
from loomquery.plans.fixtures import cte, frame
from loomquery.sources.structural import StructuralCalls, StructuralSymbols

_ALIASES = [("@/*", ["gen/*", "src/*"]), ("@lib", ["src/util"]), ("py:*:it", ["py/*"])]
_DIR = "regexp_extract({0}, '^(.*)/', 1)"


@_query(f"""WITH {cte('aliased', 'files')}, a AS (SELECT * FROM (VALUES (0, '@/', '', 'gen/', TRUE), (1, '@/', '', 'src/', TRUE), (2, '@lib', '', 'src/util', FALSE), (3, 'py:', ':it', 'py/', TRUE)) t(o, head, tail, target, star)),
e AS (SELECT * FROM (VALUES (0, ''), (1, '.ts'), (2, '.tsx'), (3, '.js'), (4, '.jsx'), (5, '.py'), (6, '/index.ts'), (7, '/index.js')) t(i, ending)),
c AS (SELECT x.path, module, o, i, CASE WHEN star THEN target || substr(module, length(head) + 1, length(module) - length(head) - length(tail)) ELSE target END || ending AS file
  FROM aliased x, a, e WHERE CASE WHEN star THEN starts_with(module, head) AND suffix(module, tail) ELSE module = head END)
SELECT x.path, x.module, r.target FROM aliased x LEFT JOIN (SELECT c.path, module, arg_min(file, o * 100 + i) AS target FROM c JOIN files f ON f.path = file GROUP BY ALL) r ON r.path = x.path AND r.module = x.module""")
def alias_resolution(spark, sf_dir):
    return lookup.resolve_aliases(frame(spark, "aliased"), frame(spark, "files"), _ALIASES)


@_query(f"""WITH {cte('usings', 'namespaces')}, c AS (SELECT u.path, u.namespace, n.path AS target, 0 AS stage FROM usings u JOIN namespaces n ON n.namespace = u.namespace
UNION ALL SELECT u.path, u.namespace, n.path, 1 FROM usings u JOIN namespaces n ON n.path <> u.path AND lower(regexp_extract(n.path, '([^/]*)[.]cs$', 1)) = lower(regexp_extract(u.namespace, '([^.]*)$', 1)))
SELECT u.path, u.namespace, arg_min(c.target, (stage, {_DIR.format('c.target')} <> {_DIR.format('c.path')}, c.target)) AS target FROM usings u LEFT JOIN c ON c.path = u.path AND c.namespace = u.namespace GROUP BY ALL""")
def namespace_resolution(spark, sf_dir):
    declared = frame(spark, "namespaces")
    return lookup.resolve_namespaces(frame(spark, "usings"), declared, declared.select("path"))


@_query(f"""WITH RECURSIVE {cte('wanted', 'symbols', 'reexports')}, w AS (SELECT path, name, path AS file, name AS is_, CAST([] AS INT[]) AS trail FROM wanted
  UNION ALL SELECT w.path, w.name, e.target, coalesce(e.name, w.is_), list_append(w.trail, CASE WHEN e.name IS NULL THEN e.ordinal + 1000000 ELSE e.ordinal END) FROM w JOIN reexports e ON e.path = w.file AND (e.alias IS NULL OR e.alias = w.is_)
  WHERE len(w.trail) < 8 AND (w.file, w.is_) NOT IN (SELECT (path, name) FROM symbols)),
h AS (SELECT w.path, w.name, arg_min({{'f': w.file, 'n': w.is_}}, w.trail) AS t FROM w JOIN symbols s ON s.path = w.file AND s.name = w.is_ GROUP BY ALL)
SELECT a.path, a.name, t.f AS target, t.n AS target_name FROM wanted a LEFT JOIN h ON h.path = a.path AND h.name = a.name""")
def export_resolution(spark, sf_dir):
    return lookup.resolve_exports(frame(spark, "wanted"), frame(spark, "symbols"), frame(spark, "reexports"))


@_query("""WITH u AS (SELECT DISTINCT user_id, event_id FROM events WHERE event_type = 'purchase'),
p AS (SELECT u.user_id, u.event_id, e.event_id AS pos, e.event_type AS type, e.event_id // 100 AS block FROM u JOIN events e ON e.user_id = u.user_id AND e.event_id < u.event_id AND e.event_type <> 'purchase'),
g AS (SELECT user_id, event_id, arg_max(type, pos) AS last, count(DISTINCT type) AS types, count(DISTINCT block) AS blocks FROM p GROUP BY ALL)
SELECT u.user_id, u.event_id, g.last IS NOT NULL AS found, CASE WHEN types <= 1 OR blocks <= 1 THEN last END AS type FROM u LEFT JOIN g USING (user_id, event_id)""")
def last_assignment(spark, sf_dir):
    rows = _table(spark, sf_dir, "events").select(F.lit("e").alias("path"), F.col("user_id").alias("scope"), F.lit("x").alias("name"), F.col("event_id").alias("line"), F.col("event_type").alias("type"), F.floor(F.col("event_id") / 100).alias("block"))
    out = lookup.last_assignment(rows.where("type = 'purchase'"), rows.where("type <> 'purchase'"))
    return out.select(F.col("scope").alias("user_id"), F.col("line").alias("event_id"), "found", "type")


@_query("""SELECT * FROM (VALUES ('a.ts', 5, 'x', 'A'), ('a.ts', 9, 'x', 'B'), ('a.ts', 9, 'this', 'C'), ('a.ts', 9, 'super', 'B'), ('a.ts', 9, 'store', 'Store'), ('a.ts', 9, 'glob', 'G'), ('a.ts', 9, 'Order', 'Order'),
('a.ts', 9, 'nope', NULL), ('a.ts', 9, 'y', NULL), ('a.ts', 2, 'x', 'Never')) t(path, line, name, type)""")
def receiver_types(spark, sf_dir):
    types = frame(spark, "symbols").where("kind = 'class'").select("path", "name")
    return lookup.receiver_types(frame(spark, "receivers"), frame(spark, "assignments"), frame(spark, "class_fields"), frame(spark, "parents"), types)


@_query(f"""WITH {cte('needed', 'type_files', 'type_imports')}, p AS (SELECT n.path, n.name, uses, t.path AS target, kind, CASE WHEN t.path = n.path THEN 0 WHEN i.ordinal IS NOT NULL THEN 1 ELSE 2 END AS s,
  CASE WHEN t.path = n.path THEN t.ordinal WHEN i.ordinal IS NOT NULL THEN i.ordinal ELSE CAST({_DIR.format('t.path')} <> {_DIR.format('n.path')} AS INT) END AS k
  FROM needed n JOIN type_files t ON t.name = n.name AND kind <> 'function' LEFT JOIN type_imports i ON i.path = n.path AND i.target = t.path AND (list_contains(names, '*') OR list_contains(names, n.name))),
b AS (SELECT path, name, uses, min((s, k, target)) AS m, arg_min(target, (s, k, target)) AS target, arg_min(kind, (s, k, target)) AS kind FROM p GROUP BY ALL)
SELECT path, name, target, CAST(row_number() OVER (PARTITION BY path ORDER BY kind = 'type', uses DESC, m, name) AS INT) AS rank FROM b""")
def type_closure(spark, sf_dir):
    return lookup.type_closure(frame(spark, "needed"), frame(spark, "type_files"), frame(spark, "type_imports"))


@_query("SELECT * FROM (VALUES ('src/__tests__/app.spec.ts'), ('py/test_model.py'), ('go/engine_test.go'), ('cs/OrderTests.cs')) t(path)")
def affected_tests(spark, sf_dir):
    return lookup.affected_tests(frame(spark, "changed"), frame(spark, "module_imports"), frame(spark, "open_imports"), frame(spark, "files"))


@_query("""WITH k AS (SELECT c_custkey AS symbol, unnest(['c' || c_custkey, 'c' || c_custkey || 'n' || c_nationkey]) AS k FROM customer), d AS (SELECT o_orderkey AS section, unnest(list_distinct(['c' || o_custkey, 'c' || o_custkey || 'n' || o_orderkey % 25])) AS k FROM orders)
SELECT symbol, section, max(length(k)) AS length FROM k JOIN d USING (k) WHERE length('c' || symbol) >= 3 GROUP BY ALL""")
def explicit_links(spark, sf_dir):
    key, told = F.concat(F.lit("c"), F.col("c_custkey").cast("string")), F.concat(F.lit("c"), F.col("o_custkey").cast("string"))
    symbols = _table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("symbol"), key.alias("key"), F.concat(key, F.lit("n"), F.col("c_nationkey").cast("string")).alias("qualified"))
    sections = _table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("section"), F.array(told, F.concat(told, F.lit("n"), (F.col("o_orderkey") % 25).cast("string"))).alias("keys"))
    return lookup.explicit_links(symbols, sections).withColumn("length", F.col("length").cast("bigint"))


@_query(f"""WITH names AS (SELECT DISTINCT url AS symbol FROM pages), t AS (SELECT item_id AS key, unnest({_words_sql('text')}) AS token FROM benchmark),
own AS (SELECT symbol, unnest({_words_sql('symbol')}) AS token FROM names)
SELECT symbol, t.key, t.token FROM names JOIN t ON contains(regexp_replace(lower(symbol), '[^a-z0-9]', '', 'g'), t.token) WHERE regexp_matches(t.token, '^[a-z]{{4,}}$') AND NOT EXISTS (SELECT 1 FROM own WHERE own.symbol = names.symbol AND own.token = t.token)""")
def bridge_links(spark, sf_dir):
    names = _table(spark, sf_dir, "pages").select(F.col("url").alias("symbol")).distinct()
    postings = retrieval.postings(_table(spark, sf_dir, "benchmark"), "item_id", T.words(F.col("text"), 4))
    own = names.select("symbol", F.explode(T.words(F.col("symbol"), 4)).alias("token"))
    return lookup.bridge_links(names.select("symbol", F.col("symbol").alias("name")), postings, own)


@_query("""WITH r AS (SELECT DISTINCT l_orderkey AS o, l_partkey AS p FROM lineitem), n AS (SELECT a.p AS a, b.p AS b, count(*) AS n FROM r a JOIN r b ON a.o = b.o AND a.p < b.p GROUP BY ALL HAVING count(*) >= 2),
e AS (SELECT DISTINCT p FROM r WHERE o % 3 = 0), both_ AS (SELECT a AS path, b AS partner, n FROM n UNION ALL SELECT b, a, n FROM n)
SELECT * FROM both_ WHERE path IN (SELECT p FROM e) AND partner NOT IN (SELECT p FROM e)""")
def partner_hints(spark, sf_dir):
    rows = _table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("basket"), F.col("l_partkey").alias("item")).distinct()
    return lookup.basket_hints(rows, rows.where("basket % 3 = 0").select(F.col("item").alias("path")))


@_query("""WITH b AS (SELECT o_custkey AS id, list_distinct(list(o_orderpriority)) AS steps FROM orders GROUP BY 1)
SELECT id, len(list_filter(steps, lambda s: s NOT IN ('1-URGENT', '2-HIGH'))) AS others FROM b WHERE list_has_any(steps, ['1-URGENT', '2-HIGH']) AND len(list_filter(steps, lambda s: s NOT IN ('1-URGENT', '2-HIGH'))) > 0""")
def bundle_hints(spark, sf_dir):
    bundles = _table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("id")).agg(F.collect_set("o_orderpriority").alias("steps"))
    return lookup.bundle_hints(bundles, ["1-URGENT", "2-HIGH"]).select("id", F.size("others").cast("bigint").alias("others"))


@_query("""SELECT trim(p_type) AS old, trim(p_brand) AS new, count(*) AS uses, count(DISTINCT p_size) AS files FROM part WHERE trim(p_type) <> trim(p_brand) GROUP BY ALL HAVING count(*) >= 2""")
def codemod_mining(spark, sf_dir):
    edits = _table(spark, sf_dir, "part").select(F.col("p_size").alias("file"), F.concat(F.lit("  "), "p_type").alias("old"), F.concat("p_brand", F.lit(" ")).alias("new"))
    return lookup.codemods(edits)


_STEMS = (
    "WITH w AS (SELECT DISTINCT unnest(regexp_extract_all(lower(text), '[a-z]+')) AS w FROM documents), c AS (SELECT w, regexp_extract(w, '^(.{3,}?)(" + "|".join(L.SUFFIXES) + ")$', 1) AS cut, regexp_extract(w, '^(.{3,}?)("
    + "|".join(L.SUFFIXES) + ")$', 2) AS suf FROM w), d AS (SELECT w, CASE WHEN suf = '' OR (suf = 's' AND w[-2:] IN ('ss', 'us', 'is')) THEN w WHEN suf IN ('ies', 'ied') THEN cut || 'y' ELSE cut END AS x FROM c), "
    "e AS (SELECT w, CASE WHEN length(x) >= 4 AND x[-1] = x[-2] AND x[-1] NOT IN ('l', 's', 'z') THEN x[:-2] ELSE x END AS x FROM d), i AS (SELECT * FROM (VALUES "
    + ", ".join(f"('{w}', '{base}')" for w, base in L.STEMS.items()) + ") t(w, own)) "
    "SELECT e.w AS word, CASE WHEN length(e.w) <= 3 THEN e.w WHEN own IS NOT NULL THEN own WHEN length(x) >= 5 AND x[-1] = 'e' THEN x[:-2] ELSE x END AS stem FROM e LEFT JOIN i ON i.w = e.w"
)


@_query(_STEMS)
def word_stems(spark, sf_dir):
    words = _table(spark, sf_dir, "documents").select(F.explode(F.regexp_extract_all(F.lower("text"), F.lit("[a-z]+"), F.lit(0))).alias("word")).distinct()
    return words.select("word", L.stem(F.col("word")).alias("stem"))


@_query(f"""SELECT doc_id, list_sort(list_filter(list_distinct(regexp_extract_all(text, '\\b[A-Z][a-zA-Z0-9_]*\\b')), lambda n: length(n) > 1 AND NOT (regexp_matches(n, '^[A-Z0-9_]+$') AND length(n) > 2)
AND n NOT IN ({', '.join(f"'{x}'" for x in L.BUILTIN_TYPES)}))) AS types FROM documents""")
def type_references(spark, sf_dir):
    return _table(spark, sf_dir, "documents").select("doc_id", F.array_sort(L.type_references(F.col("text"))).alias("types"))


@_query(f"WITH {cte('type_texts')} SELECT * FROM type_texts")
def type_unwrapping(spark, sf_dir):
    return frame(spark, "type_texts").select("raw", L.unwrap_type(F.col("raw")).alias("type"))


@_query("""WITH r AS (SELECT c_mktsegment AS key, c_custkey AS k, c_custkey || ',' || left(c_name, 40) || ',' || c_nationkey AS line FROM customer), n AS (SELECT *, row_number() OVER (PARTITION BY key ORDER BY k) AS no, count(*) OVER (PARTITION BY key) AS n FROM r)
SELECT key, CASE WHEN min(n) + 1 > 40 THEN '   1: id,name,nation' || chr(10) || string_agg(lpad(CAST(no + 1 AS VARCHAR), 4, ' ') || ': ' || line, chr(10) ORDER BY no) FILTER (no <= 3) || chr(10) || '(+' || (min(n) - 3) || ' more rows)' END AS skeleton FROM n GROUP BY 1""")
def delimited_skeleton(spark, sf_dir):
    rows = _table(spark, sf_dir, "customer").select("c_mktsegment", F.struct("c_custkey", F.concat_ws(",", "c_custkey", "c_name", "c_nationkey").alias("line")).alias("r"))
    files = rows.groupBy(F.col("c_mktsegment").alias("key")).agg(F.concat(F.lit("id,name,nation\n"), F.array_join(F.sort_array(F.collect_list("r"))["line"], "\n")).alias("content"))
    return files.select("key", L.delimited_skeleton(F.col("content")).alias("skeleton"))


@_query("""SELECT conv_id, '  turns: [' || count(*) || ' items]' || chr(10) || '      turns[0].role: "' || arg_min(role, turn) || '"' || chr(10) || '  id: ' || conv_id AS skeleton FROM conversations WHERE role IS NOT NULL GROUP BY 1""")
def json_skeleton(spark, sf_dir):
    turns = _table(spark, sf_dir, "conversations").where("role is not null").groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("turn", "role"))).alias("t"))
    content = F.to_json(F.struct(F.transform("t", lambda x: F.struct(x["role"].alias("role"))).alias("turns"), F.col("conv_id").alias("id")))
    return turns.select("conv_id", L.json_skeleton(content).alias("skeleton"))


_UNITS = "(length({0}) + len(regexp_extract_all({0}, '[\\x{{10000}}-\\x{{10FFFF}}]')))"
_TOKENS = "CAST(sum(greatest(1, (" + _UNITS + " + 3) // 4)) AS BIGINT)"


@_query(f"""WITH d AS (SELECT source, text, string_split_regex(text, '\\r?\\n') AS l FROM documents),
f AS (SELECT source, text, CASE WHEN len(l) > 12 THEN array_to_string(l[1:4] || ['... ' || (len(l) - 8) || ' lines'] || l[-4:], chr(10)) ELSE text END AS kept FROM d),
s AS (SELECT source, {_TOKENS.format('text')} AS raw_tokens, {_TOKENS.format('kept')} AS kept_tokens FROM f GROUP BY 1) SELECT *, round(100 - 100 * kept_tokens / raw_tokens, 1) AS saved FROM s""")
def token_savings(spark, sf_dir):
    docs = _table(spark, sf_dir, "documents")
    sums = docs.groupBy("source").agg(F.sum(T.token_estimate(F.col("text"))).alias("raw_tokens"), F.sum(T.token_estimate(folding.folded(F.col("text"), 12, 4, 4))).alias("kept_tokens"))
    return sums.select("source", "raw_tokens", "kept_tokens", F.round(100 - 100 * F.col("kept_tokens") / F.col("raw_tokens"), 1).alias("saved"))


@_query(f"WITH {cte('files', 'imports', 'symbols')} SELECT (SELECT count(*) FROM files) AS files, (SELECT count(DISTINCT module) FROM imports) AS modules, (SELECT count(*) FROM symbols) AS declarations, (SELECT count(*) FROM symbols WHERE exported) AS exported")
def index_stats(spark, sf_dir):
    counts = frame(spark, "symbols").agg(F.count("*").alias("declarations"), F.count_if("exported").alias("exported"))
    files, modules = frame(spark, "files").agg(F.count("*").alias("files")), frame(spark, "imports").agg(F.countDistinct("module").alias("modules"))
    return files.crossJoin(modules).crossJoin(counts)


@_query("""SELECT * FROM (VALUES ('a.ts', 'Order', 'class', TRUE, 3, 8, 0, NULL), ('a.ts', 'constructor', 'method', FALSE, 4, 4, 2, 'Order'), ('a.ts', 'cancel', 'method', FALSE, 5, 7, 2, 'Order'), ('a.ts', 'add', 'function', TRUE, 9, 9, 2, NULL),
('b.go', 'Engine', 'struct', TRUE, 2, 2, 0, NULL), ('b.go', 'Run', 'method', TRUE, 3, 5, 2, 'Engine'), ('b.go', 'helper', 'function', FALSE, 6, 6, 0, NULL), ('c.rs', 'Order', 'struct', TRUE, 1, 1, 0, NULL), ('c.rs', 'cancel', 'method', TRUE, 3, 3, 2, 'Order'),
('c.rs', 'helper', 'function', FALSE, 5, 5, 2, NULL), ('d.cpp', 'P', 'struct', TRUE, 1, 1, 0, NULL), ('d.cpp', 'main', 'function', TRUE, 2, 2, 2, NULL), ('d.cpp', 'go', 'method', TRUE, 3, 3, 1, 'P'), ('e.cs', 'B', 'class', TRUE, 1, 4, 0, NULL),
('e.cs', 'Go', 'method', TRUE, 2, 2, 2, 'B'), ('e.cs', 'Do', 'method', FALSE, 3, 3, 1, 'B')) t(path, name, kind, exported, "first", "last", params_count, parent_class)""")
def source_symbols(spark, sf_dir):
    spark.udtf.register("structural_symbols", StructuralSymbols)
    return spark.sql("select path, s.* from {src}, lateral structural_symbols(path, content) s", src=frame(spark, "sources"))


@_query("""SELECT * FROM (VALUES ('a.ts', 'drop', 'store', 2, 6), ('b.go', 'start', 'e', 1, 4), ('c.rs', 'helper', NULL, 2, 3), ('d.cpp', 'printf', NULL, 2, 2), ('d.cpp', 'main', NULL, 2, 3), ('e.cs', 'Do', NULL, 1, 2),
('e.cs', 'WriteLine', 'Console', 1, 3)) t(path, callee, receiver, args_count, line)""")
def source_calls(spark, sf_dir):
    spark.udtf.register("structural_calls", StructuralCalls)
    return spark.sql("select path, s.* from {src}, lateral structural_calls(path, content) s", src=frame(spark, "sources"))


_SEARCH_TEXT = "How to find largest_bolts of smal widgets, cold rod or bolt"
_SEARCH = f"""WITH t AS (SELECT p_partkey, 'src/' || lower(p_type) || '.ts' AS path, lower(replace(p_name, ' ', '_')) AS name, 'def ' || p_name || '(rod, bolt, cold)' AS sig, p_size % 2 = 0 AS exported FROM part),
q AS (SELECT * FROM (VALUES (0, 'largest'), (1, 'bolts'), (2, 'smal'), (3, 'widgets'), (4, 'cold'), (5, 'rod'), (6, 'bolt')) t(o, w)), x AS (SELECT * FROM (VALUES ('largest_bolts'), ('smal'), ('widgets'), ('cold'), ('rod'), ('bolt')) t(e)),
qs AS (SELECT * FROM (VALUES (0, 'largest'), (1, 'bolt'), (2, 'smal'), (3, 'widget'), (4, 'cold'), (5, 'rod')) t(o, s)), ow AS (SELECT p_partkey, unnest(string_split(name, '_')) AS w FROM t),
h AS (SELECT t.p_partkey, q.o, q.w, contains(name, q.w) AS part, q.w IN (SELECT w FROM ow WHERE ow.p_partkey = t.p_partkey) AS whole, contains(sig, q.w) AS s FROM t, q),
k AS (SELECT *, (part OR whole) AND sum(CAST(part OR whole AS INT)) OVER (PARTITION BY p_partkey ORDER BY o) <= 4 AS named FROM h),
z AS (SELECT p_partkey, sum(CASE WHEN named THEN CASE WHEN whole THEN 15 WHEN length(w) >= 5 THEN 14 ELSE 6 END ELSE 0 END) + 2 * least(3, count(*) FILTER (NOT named AND s)) AS n FROM k GROUP BY 1),
g AS (SELECT t.p_partkey, qs.o, max(CASE WHEN ow.w = qs.s THEN 10 WHEN least(length(ow.w), length(qs.s)) >= 4 AND ow.w[1] = qs.s[1] AND damerau_levenshtein(ow.w, qs.s) <= 1 THEN 8 ELSE 0 END) AS p FROM t JOIN ow USING (p_partkey), qs GROUP BY ALL),
y AS (SELECT p_partkey, sum(p) AS n FROM (SELECT * FROM g WHERE p > 0 QUALIFY row_number() OVER (PARTITION BY p_partkey ORDER BY o) <= 3) GROUP BY 1),
e AS (SELECT p_partkey, 12 * count(*) FILTER (contains(path, e)) AS p, CASE WHEN bool_or(name = e) THEN 50 ELSE 20 * least(2, count(*) FILTER (contains(name, e))) END AS n FROM t, x GROUP BY 1),
r AS (SELECT path, p_partkey AS line, name, CAST(e.p + e.n + (SELECT 3 * count(*) FROM q WHERE contains(path, q.w)) + z.n + coalesce(y.n, 0) + CASE WHEN exported THEN 2 ELSE 0 END AS INT) AS score FROM t JOIN e USING (p_partkey) JOIN z USING (p_partkey) LEFT JOIN y USING (p_partkey))
SELECT path, line, name, score FROM r WHERE score >= 6 ORDER BY score DESC, path, line, name LIMIT 50"""


@_query(_SEARCH)
def symbol_search(spark, sf_dir):
    part = _table(spark, sf_dir, "part")
    path, signature = F.concat(F.lit("src/"), F.lower("p_type"), F.lit(".ts")), F.concat(F.lit("def "), "p_name", F.lit("(rod, bolt, cold)"))
    symbols = part.select(path.alias("path"), F.col("p_partkey").alias("line"), F.lower(F.replace("p_name", F.lit(" "), F.lit("_"))).alias("name"), signature.alias("signature"), (F.col("p_size") % 2 == 0).alias("exported"))
    return search.search(symbols, _SEARCH_TEXT, top=50)


_FOLD_LINES = """l AS (SELECT doc_id AS key, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS n FROM documents)"""


@_query(f"""WITH {_FOLD_LINES}, m AS (SELECT key, max(n) AS n FROM l GROUP BY 1), s AS (SELECT l.*, m.n AS total, CASE WHEN m.n >= 9 AND l.n = 3 THEN 8 END AS last FROM l JOIN m USING (key)),
k AS (SELECT *, trim(line, ' ') = '' AS blank FROM s WHERE NOT (total >= 9 AND n BETWEEN 4 AND 8)), f AS (SELECT *, blank AND last IS NULL AND coalesce(lag(blank AND last IS NULL) OVER (PARTITION BY key ORDER BY n), FALSE) AS again FROM k)
SELECT key, sha256(string_agg(lpad(CAST(n AS VARCHAR), 4, ' ') || ':' || CASE WHEN last IS NOT NULL THEN ' ' || rtrim(line, ' ') || CASE WHEN contains(line, '{{') THEN '' ELSE ' {{' END || ' /* ... lines 4-8 folded ... */ }}' WHEN blank THEN '' ELSE ' ' || line END, chr(10) ORDER BY n)) AS digest FROM f WHERE NOT again GROUP BY 1""")
def code_skeleton(spark, sf_dir):
    rows = folding.lines(_table(spark, sf_dir, "documents"), "doc_id", "text")
    symbol = lambda name, first, last: F.struct(F.lit(name).alias("name"), F.lit("function").alias("kind"), F.lit(first).alias("first"), F.lit(last).alias("last"))
    symbols = rows.groupBy("key").agg(F.count("*").alias("n")).where("n >= 9").select("key", F.explode(F.array(symbol("f", 3, 8), symbol("inner", 4, 8), symbol("small", 1, 2), symbol("kept", 1, 9))).alias("s")).select("key", "s.*")
    return folding.code_skeleton(rows, symbols, ["kept"]).select("key", F.sha2("skeleton", 256).alias("digest"))


@_query("SELECT o_orderkey FROM orders WHERE NOT (o_orderstatus = 'P' AND datediff('day', o_orderdate, TIMESTAMP '1998-12-31') > 1000)")
def live_rows(spark, sf_dir):
    days = F.datediff(F.col("o_orderdate").cast("date"), F.lit("1970-01-01").cast("date")).cast("string")
    rows = _table(spark, sf_dir, "orders").select("o_orderkey", days.alias("created"), F.when(F.col("o_orderstatus") == "P", "pending").otherwise("done").alias("status"))
    return sessions.live_rows(rows, "created", "status", F.datediff(F.lit("1998-12-31").cast("date"), F.lit("1970-01-01").cast("date")), 1000).select("o_orderkey")


@_query("SELECT o_custkey, o_orderkey FROM orders WHERE o_orderstatus <> 'P' QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) >= 8")
def pruned_scopes(spark, sf_dir):
    return sessions.pruned_scopes(_table(spark, sf_dir, "orders"), "o_custkey", "o_orderkey", "o_totalprice", F.col("o_orderstatus") == "P")


@_query("""WITH a AS (SELECT l_partkey AS a, l_suppkey AS b, count(*) AS n FROM lineitem GROUP BY ALL UNION ALL SELECT l_suppkey, l_partkey, count(*) FROM lineitem WHERE l_returnflag = 'R' GROUP BY ALL) SELECT least(a, b) AS a, greatest(a, b) AS b, max(n) AS n FROM a GROUP BY 1, 2""")
def merged_pairs(spark, sf_dir):
    lines = _table(spark, sf_dir, "lineitem")
    known = lines.where("l_returnflag = 'R'").select(F.col("l_suppkey").alias("a"), F.col("l_partkey").alias("b"))
    return sessions.merged_pairs(lines.select(F.col("l_partkey").alias("a"), F.col("l_suppkey").alias("b")), known)


_VERIFY = [("s1", "src/ab.ts", "cancel", "A"), ("s1", "src/model.ts", "audit", None), ("s2", "src/ab.ts", "cancel", "A"), ("s3", "src/ab.ts", "cancel", "B"), ("s3", "src/util/index.ts", "format", None), ("s4", "src/model.ts", "cancelOrder", "OrderService"), ("s5", "lib/c.ts", "cancel", "Q")]
_TEXTS = [("s1", "Use a.cancel, not audit_log or Audit."), ("s2", "We cancel things."), ("s3", "See ab.ts: cancel and format()."), ("s4", "cancelOrder$ or cancelOrder"), ("s5", "cancel only")]


@_query("SELECT * FROM (VALUES ('s1', 'src/ab.ts', 'cancel', 'A'), ('s3', 'src/ab.ts', 'cancel', 'B'), ('s3', 'src/util/index.ts', 'format', NULL), ('s4', 'src/model.ts', 'cancelOrder', 'OrderService')) t(section, path, name, parent_class)")
def verified_links(spark, sf_dir):
    symbols = frame(spark, "symbols").select("path", "name").union(spark.createDataFrame([("lib/c.ts", "cancel")], "path string, name string"))
    links = spark.createDataFrame(_VERIFY, "section string, path string, name string, parent_class string")
    return graph.verified_links(links, spark.createDataFrame(_TEXTS, "section string, text string"), symbols)


@_query("""SELECT 'hub' AS part, CAST(row_number() OVER (ORDER BY n DESC, path) AS INT) AS rank, path || ' (imported by ' || n || ')' AS line FROM (SELECT p_type AS path, count(*) AS n FROM part GROUP BY 1) QUALIFY row_number() OVER (ORDER BY n DESC, path) <= 6
UNION ALL SELECT 'activity', CAST(row_number() OVER (ORDER BY event_id DESC) AS INT), event_type FROM events QUALIFY row_number() OVER (ORDER BY event_id DESC) <= 5
UNION ALL SELECT 'link', CAST(row_number() OVER (ORDER BY p_retailprice DESC, p_name) AS INT), p_name FROM part QUALIFY row_number() OVER (ORDER BY p_retailprice DESC, p_name) <= 5
UNION ALL SELECT 'macro', CAST(row_number() OVER (ORDER BY n_nationkey) AS INT), n_name FROM nation QUALIFY row_number() OVER (ORDER BY n_nationkey) <= 4
UNION ALL SELECT 'pair', CAST(row_number() OVER (ORDER BY c_custkey DESC) AS INT), c_name FROM customer QUALIFY row_number() OVER (ORDER BY c_custkey DESC) <= 4""")
def onboarding_brief(spark, sf_dir):
    part = _table(spark, sf_dir, "part")
    hubs = part.groupBy(F.col("p_type").alias("path")).agg(F.count("*").alias("n"))
    activities = _table(spark, sf_dir, "events").select(F.col("event_id").alias("seq"), F.col("event_type").alias("line"))
    links = part.select(F.col("p_retailprice").alias("score"), F.col("p_name").alias("line"))
    macros = _table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("id"), F.col("n_name").alias("line"))
    return graph.brief(hubs, activities, links, macros, _table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("n"), F.col("c_name").alias("line")))
