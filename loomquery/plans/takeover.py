"""Queries that used to read a small fixed code base, over the standard tables; the former ones stay as units of the tests."""

from __future__ import annotations

from pyspark.sql import functions as F

from loomquery.functions import text as T
from loomquery.operators import lookup, sessions
from loomquery.plans import catalog, graphs, lookup as lookup_plans  # noqa: F401
from loomquery.plans.catalog import _QUERIES, _SQL, _query, _table

#: Former queries by name: function and SQL.
UNITS: dict = {}

_MACROS = ["event_id AS macro", "CASE user_id % 5 WHEN 0 THEN 'discovered' WHEN 1 THEN 'proposed' WHEN 2 THEN 'approved' WHEN 3 THEN 'active' ELSE 'revoked' END AS state", "CASE event_id % 4 WHEN 0 THEN 'propose' WHEN 1 THEN 'approve' WHEN 2 THEN 'activate' ELSE 'revoke' END AS action", "'h' || (event_id % 3) AS hash", "'h' || (user_id % 3) AS saved_hash"]


@_query(f"""WITH m AS (SELECT {', '.join(_MACROS)} FROM events) SELECT macro, state, action, CASE WHEN hash = saved_hash THEN CASE state || '-' || action WHEN 'discovered-propose' THEN 'proposed' WHEN 'proposed-approve' THEN 'approved'
WHEN 'approved-activate' THEN 'active' WHEN 'active-revoke' THEN 'revoked' WHEN 'approved-revoke' THEN 'revoked' END END AS next_state FROM m""")
def event_macro_trust(spark, sf_dir):
    return sessions.trust_steps(_table(spark, sf_dir, "events").selectExpr(*_MACROS))


_RUNS = ["'v' || (event_id % 3) AS variant", "CAST((event_id * 7919) % 997 AS DOUBLE) AS duration_ms", "event_id % 5 > 0 AS success"]


@_query(f"""WITH runs AS (SELECT {', '.join(_RUNS)} FROM events), r AS (SELECT *, row_number() OVER (PARTITION BY variant ORDER BY duration_ms) AS k, count(*) OVER (PARTITION BY variant) AS n FROM runs)
SELECT variant, CAST(count(*) AS BIGINT) AS n_runs, round(avg(duration_ms), 6) AS mean_ms, max(CASE WHEN k = ceil(0.95 * n) THEN duration_ms END) AS p95_ms, round(avg(success::INT), 6) AS success_rate FROM r GROUP BY 1""")
def event_ab_report(spark, sf_dir):
    """Runs of each variant; the 95th percentile is that of the nearest rank, from counts of values."""
    p95 = F.expr("percentile_disc(0.95) WITHIN GROUP (ORDER BY duration_ms)")
    runs = _table(spark, sf_dir, "events").selectExpr(*_RUNS)
    return runs.groupBy("variant").agg(F.count("*").alias("n_runs"), F.round(F.avg("duration_ms"), 6).alias("mean_ms"), p95.alias("p95_ms"), F.round(F.avg(F.col("success").cast("int")), 6).alias("success_rate"))


_A = "replace(lower(p_name), ' ', '')"
_B = f"CASE p_partkey % 6 WHEN 0 THEN {_A} WHEN 1 THEN substr({_A}, 1, 3) || substr({_A}, 5) WHEN 2 THEN substr({_A}, 1, 2) || substr({_A}, 4, 1) || substr({_A}, 3, 1) || substr({_A}, 5) WHEN 3 THEN 'z' || substr({_A}, 2) WHEN 4 THEN substr({_A}, 1, 3) ELSE {_A} || 'xy' END"


@_query(f"WITH names AS (SELECT DISTINCT {_A} AS a, {_B} AS b FROM part) SELECT a, b, a = b OR (least(length(a), length(b)) >= 4 AND a[1] = b[1] AND damerau_levenshtein(a, b) <= 1) AS fuzzy FROM names")
def part_fuzzy_tokens(spark, sf_dir):
    names = _table(spark, sf_dir, "part").selectExpr(f"{_A} AS a", f"{_B} AS b").distinct()
    return names.select("a", "b", T.fuzzy_equal(F.col("a"), F.col("b")).alias("fuzzy"))


_CS = "'cs/d' || ({k} % 20) || '/F' || {k} || '.cs'"
_USINGS = [f"{_CS.format(k='l_partkey')} AS path", "'N' || (l_suppkey % 50) || '.' || CASE WHEN l_linenumber % 2 = 0 THEN 'f' ELSE 'F' END || l_suppkey AS namespace"]


@_query(f"""WITH usings AS (SELECT DISTINCT {', '.join(_USINGS)} FROM lineitem), files AS (SELECT {_CS.format(k='p_partkey')} AS path, p_partkey FROM part),
namespaces AS (SELECT path, 'N' || (p_partkey % 50) || '.F' || p_partkey AS namespace FROM files WHERE p_partkey % 3 = 0 UNION ALL SELECT path, 'N' || (p_partkey % 50) || '.F' || (p_partkey // 2) FROM files WHERE p_partkey % 4 = 0),
c AS (SELECT u.path, u.namespace, n.path AS target, 0 AS stage FROM usings u JOIN namespaces n ON n.namespace = u.namespace
  UNION ALL SELECT u.path, u.namespace, f.path, 1 FROM usings u JOIN files f ON f.path <> u.path AND lower(regexp_extract(f.path, '([^/]*)[.]cs$', 1)) = lower(regexp_extract(u.namespace, '([^.]*)$', 1)))
SELECT u.path, u.namespace, arg_min(c.target, (stage, regexp_extract(c.target, '^(.*)/', 1) <> regexp_extract(c.path, '^(.*)/', 1), c.target)) AS target FROM usings u LEFT JOIN c ON c.path = u.path AND c.namespace = u.namespace GROUP BY ALL""")
def part_namespaces(spark, sf_dir):
    usings, part = _table(spark, sf_dir, "lineitem").selectExpr(*_USINGS), _table(spark, sf_dir, "part")
    files = part.selectExpr(f"{_CS.format(k='p_partkey')} AS path")
    first = part.where("p_partkey % 3 = 0").selectExpr(f"{_CS.format(k='p_partkey')} AS path", "'N' || (p_partkey % 50) || '.F' || p_partkey AS namespace")
    second = part.where("p_partkey % 4 = 0").selectExpr(f"{_CS.format(k='p_partkey')} AS path", "'N' || (p_partkey % 50) || '.F' || (p_partkey div 2) AS namespace")
    return lookup.resolve_namespaces(usings, first.union(second), files)


_ALIASED = ["'a/f' || l_partkey || '.ts' AS path", "CASE l_linenumber % 4 WHEN 0 THEN '@lib' WHEN 1 THEN '@/f' || l_suppkey WHEN 2 THEN 'py:f' || l_suppkey || ':it' ELSE 'react' || l_suppkey END AS module"]
_FILES = "CASE p_partkey % 6 WHEN 0 THEN 'gen/f' || p_partkey || '.ts' WHEN 1 THEN 'src/f' || p_partkey || '.js' WHEN 2 THEN 'py/f' || p_partkey || '.py' WHEN 3 THEN 'src/f' || p_partkey || '/index.ts' WHEN 4 THEN 'gen/f' || (p_partkey + 1) || '.jsx' ELSE 'src/util.ts' END"


@_query(f"""WITH aliased AS (SELECT DISTINCT {', '.join(_ALIASED)} FROM lineitem), files AS (SELECT DISTINCT {_FILES} AS path FROM part),
a AS (SELECT * FROM (VALUES (0, '@/', '', 'gen/', TRUE), (1, '@/', '', 'src/', TRUE), (2, '@lib', '', 'src/util', FALSE), (3, 'py:', ':it', 'py/', TRUE)) t(o, head, tail, target, star)),
e AS (SELECT * FROM (VALUES (0, ''), (1, '.ts'), (2, '.tsx'), (3, '.js'), (4, '.jsx'), (5, '.py'), (6, '/index.ts'), (7, '/index.js')) t(i, ending)),
c AS (SELECT x.path, module, o, i, CASE WHEN star THEN target || substr(module, length(head) + 1, length(module) - length(head) - length(tail)) ELSE target END || ending AS file
  FROM aliased x, a, e WHERE CASE WHEN star THEN starts_with(module, head) AND suffix(module, tail) ELSE module = head END)
SELECT x.path, x.module, r.target FROM aliased x LEFT JOIN (SELECT c.path, module, arg_min(file, o * 100 + i) AS target FROM c JOIN files f ON f.path = file GROUP BY ALL) r ON r.path = x.path AND r.module = x.module""")
def part_aliases(spark, sf_dir):
    files = _table(spark, sf_dir, "part").selectExpr(f"{_FILES} AS path").distinct()
    return lookup.resolve_aliases(_table(spark, sf_dir, "lineitem").selectExpr(*_ALIASED), files, lookup_plans._ALIASES)


_NOW = graphs._parts(1)


@_query(f"""WITH files AS ({_NOW['files']}), imports AS ({_NOW['imports']}), symbols AS ({_NOW['symbols']})
SELECT (SELECT count(*) FROM files) AS files, (SELECT count(DISTINCT module) FROM imports) AS modules, (SELECT count(*) FROM symbols) AS declarations, (SELECT count(*) FROM symbols WHERE parent_class IS NULL) AS exported""")
def code_index_stats(spark, sf_dir):
    code = graphs._code(spark, sf_dir, 1)
    counts = code.symbols.agg(F.count("*").alias("declarations"), F.count_if(F.col("parent_class").isNull()).alias("exported"))
    return code.files.agg(F.count("*").alias("files")).crossJoin(code.imports.agg(F.countDistinct("module").alias("modules"))).crossJoin(counts)


for _old, _new in {
    "inheritance_closure": "class_lineage", "call_resolution": "code_calls", "method_resolution": "code_methods", "blast_radius": "code_blast_radius", "guard_arity": "code_guard_arity", "guard_removed": "code_guard_removed",
    "guard_fields": "code_guard_fields", "guard_imports": "code_guard_imports", "code_graph": "graph_kinds", "macro_trust": "event_macro_trust", "ab_report": "event_ab_report", "fuzzy_tokens": "part_fuzzy_tokens",
    "namespace_resolution": "part_namespaces", "alias_resolution": "part_aliases", "index_stats": "code_index_stats",
}.items():
    UNITS[_old] = _QUERIES[_old], _SQL[_old]
    _QUERIES[_old], _SQL[_old] = _QUERIES.pop(_new), _SQL.pop(_new)
for _old, _same in {"import_resolution": "code_imports", "enclosing_symbol": "enclosing_interval", "receiver_types": "typed_calls"}.items():
    UNITS[_old] = _QUERIES[_old], _SQL[_old]
    _QUERIES[_old], _SQL[_old] = _QUERIES[_same], _SQL[_same]
