"""Named queries of the workspace operators, over code, references and logs that are made of the standard tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from loomquery.operators import resolve
from loomquery.operators import workspace as W
from loomquery.plans.catalog import _query, _table
from loomquery.sources import declarations

# Files of four languages, and imports between them that climb none, one or two folders. The expressions are both Spark's and SQL's.
_PLACE = "'p' || ({k} % 3) || '/m' || ({k} % 5) || '/f' || {k}"
_EXT = "CASE {k} % 4 WHEN 0 THEN '.ts' WHEN 1 THEN '.py' WHEN 2 THEN '.rs' ELSE '.c' END"


def _path(key: str) -> str:
    return f"{_PLACE.format(k=key)} || {_EXT.format(k=key)}"


_T = "l_suppkey"
_DOTTED, _COLONS = (f"'p' || ({_T} % 3) || '{x}m' || ({_T} % 5) || '{x}f' || {_T}" for x in (".", "::"))
_MODULE = f"""CASE l_partkey % 4
WHEN 0 THEN CASE l_linenumber % 3 WHEN 0 THEN '../../' || {_PLACE.format(k=_T)} WHEN 1 THEN './f' || {_T} ELSE '../m' || ({_T} % 5) || '/f' || {_T} || '.js' END
WHEN 1 THEN CASE l_linenumber % 3 WHEN 0 THEN {_DOTTED} WHEN 1 THEN '.f' || {_T} ELSE '...' || {_DOTTED} END
WHEN 2 THEN CASE l_linenumber % 3 WHEN 0 THEN 'crate::' || {_COLONS} WHEN 1 THEN 'self::f' || {_T} ELSE 'super::f' || {_T} END
ELSE CASE l_linenumber % 3 WHEN 0 THEN '../../' || {_PLACE.format(k=_T)} || '.c' WHEN 1 THEN 'f' || {_T} || '.c' ELSE {_PLACE.format(k=_T)} || '.c' END END"""


def _normal_sql(x: str) -> str:
    x = f"regexp_replace({x}, '(^|/)\\./', '\\1', 'g')"
    for _ in range(4):
        x = f"regexp_replace({x}, '(^|/)[^/.][^/]*/\\.\\./', '\\1')"
    return x


_CODE_SQL = f"""files AS (SELECT {_path('p_partkey')} AS path FROM part),
imports AS (SELECT DISTINCT {_path('l_partkey')} AS path, {_MODULE} AS module FROM lineitem),
x AS (SELECT path, module, regexp_extract(path, '^(.*)/[^/]*$', 1) AS folder, length(regexp_extract(module, '^(\\.*)', 1)) AS dots,
  replace(regexp_replace(module, '^\\.+', ''), '.', '/') AS py, replace(regexp_replace(module, '^(crate|super|self)::', ''), '::', '/') AS rs,
  regexp_replace(module, '\\.(js|mjs|cjs)$', '') AS js FROM imports),
l AS (SELECT path, module, CASE WHEN path LIKE '%.py' AND dots > 0 THEN [folder || '/' || repeat('../', dots - 1) || py || '.py', folder || '/' || repeat('../', dots - 1) || py || '/__init__.py']
  WHEN path LIKE '%.py' THEN [folder || '/' || py || '.py', py || '.py', 'src/' || py || '.py', py || '/__init__.py']
  WHEN path LIKE '%.rs' THEN [folder || '/' || rs || '.rs', 'src/' || rs || '.rs', rs || '.rs', 'src/' || rs || '/mod.rs']
  WHEN path LIKE '%.c' THEN [folder || '/' || module, module, 'include/' || module, 'src/' || module]
  ELSE [folder || '/' || module, folder || '/' || js || '.ts', folder || '/' || js || '.tsx', folder || '/' || js || '.js', folder || '/' || js || '.mjs', folder || '/' || js || '/index.ts', folder || '/' || js || '/index.js'] END AS c FROM x),
u AS (SELECT path, module, unnest(c) AS candidate, generate_subscripts(c, 1) AS prio FROM l),
best AS (SELECT u.path, module, arg_min(files.path, prio) AS target FROM u JOIN files ON files.path = {_normal_sql('candidate')} GROUP BY ALL),
resolved AS (SELECT i.path, i.module, target FROM imports i LEFT JOIN best b ON b.path = i.path AND b.module = i.module)"""


def _resolved(spark, sf_dir):
    files = _table(spark, sf_dir, "part").selectExpr(f"{_path('p_partkey')} AS path")
    imports = _table(spark, sf_dir, "lineitem").selectExpr(f"{_path('l_partkey')} AS path", f"{_MODULE} AS module").distinct()
    return resolve.resolve_imports(imports, files)


@_query(f"WITH {_CODE_SQL} SELECT path, module, target FROM resolved")
def code_imports(spark, sf_dir):
    return _resolved(spark, sf_dir)


@_query(f"WITH {_CODE_SQL} SELECT path, module FROM resolved WHERE target IS NULL AND (module LIKE '.%' OR path NOT LIKE '%.ts')")
def code_broken_imports(spark, sf_dir):
    return _resolved(spark, sf_dir).where("target is null and (module like '.%' or path not like '%.ts')").select("path", "module")


_REEXPORTS = "o_custkey % 400 AS module, CASE WHEN o_orderpriority LIKE '5%' THEN '*' ELSE o_orderpriority END AS name, (o_orderkey * 7) % 400 AS next"


@_query(f"""WITH RECURSIVE e AS (SELECT DISTINCT {_REEXPORTS} FROM orders),
r AS (SELECT DISTINCT module, name, module AS target, 0 AS hops FROM e WHERE name <> '*' UNION SELECT r.module, r.name, e.next, hops + 1 FROM r JOIN e ON e.module = r.target AND e.name IN (r.name, '*') WHERE hops < 3)
SELECT DISTINCT module, name, target FROM r WHERE target <> module""")
def module_reach(spark, sf_dir):
    parts = [x.strip() for x in ("o_custkey % 400 AS module", "CASE WHEN o_orderpriority LIKE '5%' THEN '*' ELSE o_orderpriority END AS name", "(o_orderkey * 7) % 400 AS next")]
    return W.module_reach(_table(spark, sf_dir, "orders").selectExpr(*parts))


_SYMBOLS = [
    "CAST(l_orderkey % 500 AS BIGINT) AS path", "l_partkey * 10 + l_linenumber AS ordinal", "CASE WHEN l_partkey % 7 = 0 THEN 'C' || (l_suppkey % 9) ELSE 'm' || (l_partkey % 20) END AS name",
    "CASE WHEN l_partkey % 7 = 0 THEN 'class' ELSE 'method' END AS kind", "CASE WHEN l_partkey % 5 = 0 THEN 'C' || (l_suppkey % 9) END AS parent_class", "l_partkey AS first",
    "l_partkey + CASE WHEN l_partkey % 7 = 0 THEN 60 ELSE 2 END AS last",
]
_LOOKUPS = ["CAST(o_orderkey % 500 AS BIGINT) AS path", "CASE o_custkey % 4 WHEN 0 THEN ' m' || (o_custkey % 20) WHEN 1 THEN 'C' || (o_custkey % 9) || '.m' || (o_custkey % 20) WHEN 2 THEN 'C' || (o_custkey % 9) || '::m' || (o_custkey % 20) ELSE 'C' || (o_custkey % 9) || '::m' || (o_custkey % 20) || '.x' END AS query"]


@_query(f"""WITH s AS (SELECT {', '.join(_SYMBOLS)} FROM lineitem),
q AS (SELECT *, split_part(clean, '.', 1) AS container, CASE WHEN contains(clean, '.') THEN split_part(clean, '.', 2) END AS member FROM (
  SELECT *, trim(query) AS raw, CASE WHEN contains(query, '::') THEN trim(substr(query, 1, instr(query, '::') - 1) || '.' || substr(query, instr(query, '::') + 2)) ELSE trim(query) END AS clean FROM (SELECT DISTINCT {', '.join(_LOOKUPS)} FROM orders))),
blocks AS (SELECT path, name, first, last FROM s WHERE kind = 'class' QUALIFY row_number() OVER (PARTITION BY path, name ORDER BY ordinal) = 1),
hits AS (SELECT q.path, query, ordinal, 1 AS rule FROM q JOIN s ON s.path = q.path AND s.name = member AND parent_class = container
  UNION SELECT q.path, query, ordinal, 2 FROM q JOIN s ON s.path = q.path AND s.name = member JOIN blocks b ON b.path = q.path AND b.name = container WHERE s.first >= b.first AND s.last <= b.last
  UNION SELECT q.path, query, ordinal, 3 FROM q JOIN s ON s.path = q.path AND s.name IN (clean, raw))
SELECT path, query, ordinal FROM hits QUALIFY rule = min(rule) OVER (PARTITION BY path, query)""")
def symbol_lookup(spark, sf_dir):
    symbols = _table(spark, sf_dir, "lineitem").selectExpr(*_SYMBOLS)
    return W.symbol_lookup(_table(spark, sf_dir, "orders").selectExpr(*_LOOKUPS), symbols)


@_query(f"""WITH s AS (SELECT {', '.join(_SYMBOLS)} FROM lineitem)
SELECT ordinal, path || ':' || first || '-' || last || ' ' || kind || ' ' || name AS locate, path || ':' || first || '-' || last || ' ' || coalesce('def ' || parent_class || '.' || name, name) AS summary FROM s""")
def symbol_details(spark, sf_dir):
    s = _table(spark, sf_dir, "lineitem").selectExpr(*_SYMBOLS)
    at = [F.col("path").cast("string"), *(F.col(c) for c in ("first", "last", "kind", "name")), F.concat(F.lit("def "), "parent_class", F.lit("."), "name")]
    return s.select("ordinal", *(W.symbol_detail(*at, detail).alias(detail) for detail in ("locate", "summary")))


_HABITS = [
    "ts AS seq", "user_id % 4 AS session", "CASE event_type WHEN 'click' THEN 'edit' WHEN 'view' THEN 'exec' WHEN 'purchase' THEN 'edit' ELSE 'read' END AS kind",
    "CASE WHEN event_type = 'view' THEN 'run ' || (event_id % 4) WHEN event_id % 11 = 0 THEN 'root.ts' ELSE 'src/d' || (event_id % 5) || '/f' || (event_id % 3) || '.ts#s' || event_id END AS item", "value > 1 AS ok",
]


@_query(f"""WITH e AS (SELECT {', '.join(_HABITS)} FROM events), k AS (SELECT *, split_part(item, '#', 1) AS f FROM e WHERE kind IN ('edit', 'exec') AND ok),
n AS (SELECT *, lead(session) OVER w AS ns, lead(kind) OVER w AS nk, lead(item) OVER w AS ni, lead(f) OVER w AS nf FROM k WINDOW w AS (ORDER BY seq)),
h AS (SELECT 'co-edit' AS habit, least(f, nf) AS "left", greatest(f, nf) AS "right" FROM n WHERE session = ns AND kind = 'edit' AND nk = 'edit' AND f <> nf
  UNION ALL SELECT 'verify', regexp_extract(f, '^(.*)/[^/]*$', 1), ni FROM n WHERE session = ns AND kind = 'edit' AND nk = 'exec' AND contains(f, '/'))
SELECT habit, "left", "right", count(*) AS support FROM h GROUP BY ALL HAVING count(*) >= 2""")
def edit_habits(spark, sf_dir):
    return W.edit_habits(_table(spark, sf_dir, "events").selectExpr(*_HABITS))


_TRIM = "regexp_replace({x}, '^\\s+|\\s+$', '', 'g')"


@_query(f"""WITH o AS (SELECT doc_id, text, list_filter(string_split(text, chr(10)), lambda x: {_TRIM.format(x='x')} <> '') AS lines FROM documents WHERE text IS NOT NULL),
h AS (SELECT *, list_filter(lines, lambda x: regexp_matches(x, '{W.PASSED}')) AS hits FROM o)
SELECT doc_id, CASE WHEN length(text) BETWEEN 1 AND 240 THEN text WHEN len(hits) > 0 THEN array_to_string(list_transform(hits[-2:], lambda x: {_TRIM.format(x='x')}), ' | ')
  WHEN len(lines) <= 3 THEN array_to_string(lines, ' | ') ELSE len(lines) || ' lines (' || substr({_TRIM.format(x='lines[-1]')}, 1, 100) || ')' END AS summary FROM h""")
def pass_summaries(spark, sf_dir):
    docs = _table(spark, sf_dir, "documents").where("text is not null")
    return docs.select("doc_id", W.pass_summary(F.col("text")).alias("summary"))


_FRAME = "CASE event_id % 5 WHEN 0 THEN '  at f (node_modules/x.js:' || event_id || ')' WHEN 1 THEN 'see node_modules/x' WHEN 2 THEN '/usr/lib/site-packages/' || event_type WHEN 3 THEN '   at /rustc/' || event_id ELSE 'at src/' || event_type END"


@_query(f"SELECT event_id, {_FRAME} AS frame FROM events WHERE event_id % 5 NOT IN (0, 2, 3)")
def own_frames(spark, sf_dir):
    frames = _table(spark, sf_dir, "events").selectExpr("event_id", f"{_FRAME} AS frame")
    return frames.where(~W.is_foreign_frame(F.col("frame")))


@_query("""SELECT p_partkey, lower(printf('%x', list_reduce(list_transform(string_split(p_name, ''), lambda c: CAST(unicode(c) AS BIGINT)), lambda h, c: (xor(h, c) * 16777619) & 4294967295, 2166136261::BIGINT))) AS fnv,
lower(printf('%x', list_reduce(list_transform(string_split(p_name, ''), lambda c: CAST(unicode(c) AS BIGINT)), lambda h, c: (h * 33 + c) & 4294967295, 5381::BIGINT))) AS times33 FROM part""")
def name_hashes(spark, sf_dir):
    return _table(spark, sf_dir, "part").select("p_partkey", W.fnv1a(F.col("p_name")).alias("fnv"), W.times33(F.col("p_name")).alias("times33"))


@_query("SELECT c_custkey AS path FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'F' AND o_orderkey % 5 = 0)")
def stale_paths(spark, sf_dir):
    return W.stale_paths(_table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("path")), _table(spark, sf_dir, "orders").where("o_orderstatus = 'F' and o_orderkey % 5 = 0").select(F.col("o_custkey").alias("path")))


_REFERENCES = ["l_orderkey AS path", "l_partkey % 50 AS name", "CASE l_suppkey % 4 WHEN 0 THEN 'import' WHEN 1 THEN 'call' WHEN 2 THEN 'type' ELSE 'property' END AS kind", "l_linenumber * 100 + l_suppkey AS line"]


@_query(f"""WITH r AS (SELECT {', '.join(_REFERENCES)} FROM lineitem),
k AS (SELECT *, list_position(['import', 'call', 'type', 'property'], kind) AS rank FROM r WHERE name % 3 = 0 AND NOT EXISTS (SELECT 1 FROM orders WHERE o_orderkey = path AND o_custkey % 50 = name))
SELECT path, name, kind, line FROM k QUALIFY row_number() OVER (PARTITION BY path, name ORDER BY rank, line) = 1""")
def rename_residue(spark, sf_dir):
    renamed = _table(spark, sf_dir, "part").selectExpr("p_partkey % 50 AS name").distinct().where("name % 3 = 0")
    declaring = _table(spark, sf_dir, "orders").selectExpr("o_orderkey AS path", "o_custkey % 50 AS name")
    return W.rename_residue(_table(spark, sf_dir, "lineitem").selectExpr(*_REFERENCES), renamed, declaring)


@_query(f"""WITH d AS (SELECT doc_id, text, string_split(text, chr(10)) AS l FROM documents WHERE text IS NOT NULL),
s AS (SELECT *, CASE doc_id % 3 WHEN 0 THEN coalesce(l[2] || chr(10) || l[3], l[1]) WHEN 1 THEN '  ' || coalesce(l[2] || chr(10) || chr(9) || l[3], l[1]) || ' ' ELSE l[1] || ' not there' END AS old FROM d),
t AS (SELECT *, string_split(old, chr(10)) AS w, instr(text, old) AS place, list_transform(l, lambda x: {_TRIM.format(x='x')}) AS lt, list_transform(string_split(old, chr(10)), lambda x: {_TRIM.format(x='x')}) AS wt FROM s),
f AS (SELECT doc_id, len(w) AS n, CASE WHEN place > 0 THEN len(string_split(substr(text, 1, place - 1), chr(10))) WHEN len(list_filter(wt, lambda x: x <> '')) > 0
  THEN list_filter(range(1, len(l) - len(w) + 2), lambda i: lt[i:i + len(w) - 1] = wt)[1] END AS first FROM t)
SELECT doc_id, CAST(first AS INT) AS first, CAST(first + n - 1 AS INT) AS last FROM f""")
def snippet_lines(spark, sf_dir):
    docs = _table(spark, sf_dir, "documents").where("text is not null").withColumn("l", F.split("text", "\n"))
    line = lambda i: F.get("l", F.lit(i - 1))
    two = lambda between: F.coalesce(F.concat(line(2), F.lit(between), line(3)), line(1))
    old = F.when(F.col("doc_id") % 3 == 0, two("\n")).when(F.col("doc_id") % 3 == 1, F.concat(F.lit("  "), two("\n\t"), F.lit(" "))).otherwise(F.concat(line(1), F.lit(" not there")))
    return docs.select("doc_id", W.locate_snippet(F.col("text"), old).alias("at")).select("doc_id", "at.first", "at.last")


_LEVEL = "CASE o_custkey % 3 WHEN 0 THEN 'full' WHEN 1 THEN 'safe' ELSE 'fast' END"


@_query(f"""WITH t AS (SELECT o_orderkey, o_custkey, list_sort(list('t' || l_partkey || '.py') FILTER (l_suppkey % 5 = 0)) AS found FROM orders JOIN lineitem ON l_orderkey = o_orderkey GROUP BY ALL),
p AS (SELECT o_orderkey, ['f' || o_orderkey || '.py'] AS changes, coalesce(found, []) AS tests, {_LEVEL} AS level, o_custkey % 4 > 0 AS has_suite FROM t),
q AS (SELECT *, (level = 'full' OR (level = 'safe' AND len(tests) = 0)) AND has_suite AS whole FROM p),
r AS (SELECT *, CASE WHEN whole THEN ['<npm test full suite>'] ELSE tests END AS selected, CASE WHEN whole THEN 'npm test' ELSE 'pytest ' || array_to_string(tests, ' ') END AS run FROM q)
SELECT o_orderkey, array_to_string(selected, ',') AS selected, run, CASE WHEN len(tests) > 0 THEN 'TARGETED' ELSE 'UNKNOWN' END AS coverage,
  'sha256:' || sha256('[["' || array_to_string(changes, '","') || '"],' || CASE WHEN len(selected) = 0 THEN '[]' ELSE '["' || array_to_string(selected, '","') || '"]' END || ',"' || run || '"]') AS plan_hash FROM r""")
def test_plans(spark, sf_dir):
    lines = _table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.array_sort(F.collect_list(F.when(F.col("l_suppkey") % 5 == 0, F.concat(F.lit("t"), "l_partkey", F.lit(".py"))))).alias("tests"))
    plans = _table(spark, sf_dir, "orders").join(lines, F.col("o_orderkey") == F.col("l_orderkey"))
    plans = plans.select("o_orderkey", F.array(F.concat(F.lit("f"), "o_orderkey", F.lit(".py"))).alias("changes"), "tests", F.expr(_LEVEL).alias("level"), (F.col("o_custkey") % 4 > 0).alias("has_suite"), F.concat(F.lit("pytest "), F.array_join("tests", " ")).alias("command"))
    return W.test_plan(plans).select("o_orderkey", F.array_join("selected", ",").alias("selected"), "run", "coverage", "plan_hash")


@_query("""WITH d AS (SELECT doc_id AS id, coalesce(text, '') AS text, 1600 - 110 - length('// [Receipt ' || doc_id || ']' || chr(10)) AS room FROM documents),
p AS (SELECT id, text, room, unnest(range(0, greatest(length(text), 1), room)) AS start FROM d)
SELECT id, CAST(start AS INT) AS start, sha256(substr(text, start + 1, room)) AS body, CAST(CASE WHEN start + room < length(text) THEN start + room END AS INT) AS next FROM p""")
def receipt_pages(spark, sf_dir):
    docs = _table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), "text")
    return W.receipt_pages(docs, 400).withColumn("body", F.sha2("body", 256))


_STATES = ["event_id", "CAST(event_id % 6 AS INT) AS failures", "'run ' || (user_id % 2) AS last_command", "CASE WHEN user_id % 5 > 0 THEN 'p' || (user_id % 3) END AS last_patch", "CASE event_id % 7 WHEN 0 THEN '' WHEN 1 THEN NULL ELSE event_type END AS fingerprint", "'run ' || (event_id % 2) AS command", "'p' || (event_id % 3) AS patch"]


@_query(f"WITH s AS (SELECT {', '.join(_STATES)} FROM events) SELECT event_id, failures >= 3 AND last_command = command AND last_patch IS NOT NULL AND coalesce(last_patch = patch, FALSE) AND fingerprint IS NOT NULL AND fingerprint <> '' AS stop FROM s")
def repeated_failure_stops(spark, sf_dir):
    return W.stop_repeated(_table(spark, sf_dir, "events").selectExpr(*_STATES)).select("event_id", "stop")


_NAMES = ["l_orderkey AS path", "CASE WHEN l_partkey % 3 = 0 THEN 'T' ELSE 't' END || (l_suppkey % 30) AS name"]


@_query(f"""WITH n AS (SELECT DISTINCT {', '.join(_NAMES)} FROM lineitem)
SELECT path, name FROM n WHERE regexp_matches(name, '^[A-Z]') OR EXISTS (SELECT 1 FROM orders WHERE o_orderkey = path AND name IN ('t' || (o_custkey % 30), 't' || (o_custkey % 7)))""")
def plausible_types(spark, sf_dir):
    orders = _table(spark, sf_dir, "orders")
    declared = orders.selectExpr("o_orderkey AS path", "'t' || (o_custkey % 30) AS name")
    imported = orders.selectExpr("o_orderkey AS path", "array('t' || (o_custkey % 7)) AS names")
    return W.plausible_types(_table(spark, sf_dir, "lineitem").selectExpr(*_NAMES).distinct(), declared, imported)


# Class headers of four language families; every seventh one names no base that counts.
_CLASS = """CASE p_partkey % 4 WHEN 0 THEN 'export class K' || (p_partkey % 90) || '<T> extends ns.B' || (p_size % 9) || ' {'
WHEN 1 THEN 'class K' || (p_partkey % 90) || '(object, ' || CASE WHEN p_partkey % 7 = 0 THEN 'low' ELSE 'pkg.known' END || ', B' || (p_size % 9) || '):'
WHEN 2 THEN '  public sealed class K' || (p_partkey % 90) || ' : Ns.B' || (p_size % 9) || ', IFace {'
ELSE 'template <class T> class K' || (p_partkey % 90) || ' : public virtual ns::' || CASE WHEN p_partkey % 7 = 0 THEN 'low' ELSE 'B' || (p_size % 9) END || ' {' END"""
_CLASS_FILE = "CASE p_partkey % 4 WHEN 0 THEN '.ts' WHEN 1 THEN '.py' WHEN 2 THEN '.cs' ELSE '.cpp' END"


@_query("""WITH c AS (SELECT p_partkey AS path, 'K' || (p_partkey % 90) AS name, CASE WHEN p_partkey % 4 = 1 AND p_partkey % 7 > 0 THEN 'known' WHEN p_partkey % 4 = 3 AND p_partkey % 7 = 0 THEN NULL ELSE 'B' || (p_size % 9) END AS parent FROM part)
SELECT name, arg_min(parent, path) AS parent FROM c WHERE parent IS NOT NULL GROUP BY 1""")
def class_parents(spark, sf_dir):
    files = _table(spark, sf_dir, "part").selectExpr(f"p_partkey || {_CLASS_FILE} AS path", f"{_CLASS} AS content")
    parents = declarations.parse(files)["parents"].withColumnRenamed("child", "name")
    bases = F.transform(F.array_sort(F.collect_list(F.struct("ordinal", "base"))), lambda b: b.base)
    family = F.expr("element_at(map('ts', 'js', 'py', 'python', 'cs', 'csharp', 'cpp', 'c'), split_part(path, '.', -1))")
    headers = parents.groupBy("path", "name", "line").agg(bases.alias("bases")).select("*", family.alias("family"), F.array(F.lit("known")).alias("known"))
    return W.class_parents(headers.withColumn("path", F.split("path", r"\.")[0].cast("bigint")))


@_query("SELECT DISTINCT p_name AS key FROM part WHERE EXISTS (SELECT 1 FROM region WHERE contains(lower(p_name), substr(lower(r_name), 2, 1)))")
def glossary_covered(spark, sf_dir):
    keys = _table(spark, sf_dir, "part").select(F.col("p_name").alias("key")).distinct()
    known = _table(spark, sf_dir, "region").select(F.substring(F.lower("r_name"), 2, 1).alias("known"))
    return W.glossary_covered(keys.select("key"), known)


# Type blocks of six languages, with a comment, a method or a call among the fields.
_BLOCK = """CASE p_partkey % 6
WHEN 0 THEN 'class K:' || chr(10) || '    a{s}: int' || chr(10) || '    # c: no' || chr(10) || '    def f(self):' || chr(10) || '        self.B{s} = 1' || chr(10) || '        self.a{s}: int = 2'
WHEN 1 THEN 'type K struct {{' || chr(10) || chr(9) || 'a{s} string' || chr(10) || chr(9) || 'B{s} *pkg.T' || chr(10) || '}}'
WHEN 2 THEN 'pub struct K {{' || chr(10) || '    pub a{s}: u32,' || chr(10) || '    // c: u8' || chr(10) || '    pub(crate) B{s}: String,' || chr(10) || '}}'
WHEN 3 THEN 'public record K(string a{s}, int B{s})' || chr(13) || chr(10) || '{{' || chr(10) || '    public int C{s} {{ get; set; }}' || chr(10) || '    public void M() {{ }}' || chr(10) || '}}'
WHEN 4 THEN 'struct K {{' || chr(10) || '  const int a{s} = 3;' || chr(10) || '  void m(int x);' || chr(10) || '  std::vector<int> *B{s};' || chr(10) || '}};'
ELSE 'interface K {{' || chr(10) || '  readonly a{s}?: string;' || chr(10) || '  m();' || chr(10) || '  B{s}: (x: number) => void;' || chr(10) || '}}' END""".format(s="' || p_size || '")
_ENDING = "'f' || p_partkey || CASE p_partkey % 6 WHEN 0 THEN '.py' WHEN 1 THEN '.go' WHEN 2 THEN '.rs' WHEN 3 THEN '.cs' WHEN 4 THEN '.hpp' ELSE '.ts' END"


@_query("SELECT p_partkey, 'a' || p_size || ',B' || p_size || CASE WHEN p_partkey % 6 = 3 THEN ',C' || p_size ELSE '' END AS fields FROM part")
def struct_fields(spark, sf_dir):
    blocks = _table(spark, sf_dir, "part").selectExpr("p_partkey", f"{_BLOCK} AS block", f"{_ENDING} AS path")
    return blocks.select("p_partkey", F.array_join(declarations.struct_fields(F.col("block"), F.col("path")), ",").alias("fields"))


# Signatures that give the type T of the part's size, or none; every tenth size has a declared type too.
_SIGNATURE = """CASE p_partkey % 6
WHEN 0 THEN 'def f(x: int) -> Optional[T{s}]:'
WHEN 1 THEN 'func (r *R) F(a map[string]int) *T{s} {{'
WHEN 2 THEN 'fn f(&self) -> Result<T{s}, Error> {{'
WHEN 3 THEN '(int x)'
WHEN 4 THEN 'static const ns::T{s} Foo::bar(int x)'
ELSE 'export function f(a: number): Promise<T{s}[]> {{' END""".format(s="' || p_size || '")


@_query("SELECT p_partkey, CASE WHEN p_size % 10 = 0 THEN 'D' || p_size WHEN p_partkey % 6 <> 3 THEN 'T' || p_size END AS type FROM part")
def return_types(spark, sf_dir):
    rows = _table(spark, sf_dir, "part").selectExpr("p_partkey", f"{_SIGNATURE} AS signature", f"{_ENDING} AS path", "CASE WHEN p_size % 10 = 0 THEN 'D' || p_size || '[]' END AS declared")
    return rows.select("p_partkey", declarations.return_type(F.col("signature"), F.col("path"), F.col("declared")).alias("type"))
