"""Queries on snippets and on decisions about edits, tests and workspaces, with their SQL; registered with the catalog."""

from __future__ import annotations

from pyspark.sql import functions as F

from loomquery.functions import snippets as S
from loomquery.operators import decisions, folding, resolve
from loomquery.plans.catalog import _CALLS, _query, _resolved, _table
from loomquery.plans.fixtures import frame

_NAMES = ["the", "token", "License", "is", "nosuchword"]
_LINES = "l AS (SELECT doc_id AS key, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS no FROM documents)"


@_query(" UNION ALL ".join(f"SELECT '{n}' AS name, count(*) AS n FROM documents WHERE regexp_matches(text, '(^|[^\\p{{L}}\\p{{N}}_$]){n}([^\\p{{L}}\\p{{N}}_$]|$)')" for n in _NAMES))
def boundary_matches(spark, sf_dir):
    docs = _table(spark, sf_dir, "documents")
    hits = docs.agg(*[F.count_if(S.has_identifier(F.col("text"), n)).alias(n) for n in _NAMES])
    return hits.select(F.explode(F.array(*[F.struct(F.lit(n).alias("name"), F.col(n).alias("n")) for n in _NAMES])).alias("s")).select("s.*")


@_query("""SELECT doc_id, (SELECT coalesce(string_agg(lpad(CAST(i AS VARCHAR), 4, ' ') || ': ' || s[i], chr(10) ORDER BY i), '') FROM (SELECT unnest(range(2, least(len(s), 5) + 1)) AS i)) AS shown
FROM (SELECT doc_id, string_split(text, chr(10)) AS s FROM documents)""")
def line_ranges(spark, sf_dir):
    return _table(spark, sf_dir, "documents").select("doc_id", S.numbered_lines(F.col("text"), 2, 5).alias("shown"))


@_query("SELECT DISTINCT p_brand || '::' || p_type || '.tail' AS name, p_brand AS parent, p_type AS member FROM part UNION ALL SELECT DISTINCT p_type, NULL, p_type FROM part")
def qualified_names(spark, sf_dir):
    part = _table(spark, sf_dir, "part")
    names = part.select(F.concat("p_brand", F.lit("::"), "p_type", F.lit(".tail")).alias("name")).distinct().union(part.select("p_type").distinct())
    return names.select("name", S.qualified_parts(F.col("name")).alias("q")).select("name", "q.parent", "q.member")


@_query(r"""WITH t AS (SELECT 'see `' || p_name || '`, get' || p_type[1] || lower(p_type[2:]) || ' or ' || lower(p_type) || '_size, aB of it' AS text FROM part),
c AS (SELECT unnest(list_distinct(list_concat(regexp_extract_all(text, '`([^`\n]+)`', 1), list_filter(list_concat(regexp_extract_all(text, '\b[A-Za-z]*[a-z][A-Z][A-Za-z0-9]*\b'), regexp_extract_all(text, '\b[A-Za-z0-9]+_[A-Za-z0-9_]+\b')), lambda x: length(x) >= 4)))) AS name FROM t)
SELECT name, count(*) AS n FROM c GROUP BY 1""")
def document_candidates(spark, sf_dir):
    lower = F.lower("p_type")
    text = F.concat(F.lit("see `"), F.col("p_name"), F.lit("`, get"), F.initcap(lower), F.lit(" or "), lower, F.lit("_size, aB of it")).alias("text")
    return _table(spark, sf_dir, "part").select(text).select(F.explode(S.identifier_candidates(F.col("text"))).alias("name")).groupBy("name").agg(F.count("*").alias("n"))


@_query("SELECT p_partkey, p_name AS plain FROM part")
def ansi_free(spark, sf_dir):
    coloured = F.concat(F.lit("\x1b[1;31m"), F.col("p_name"), F.lit("\x1b[0m\x1b[2K"))
    return _table(spark, sf_dir, "part").select("p_partkey", S.strip_ansi(coloured).alias("plain"))


@_query("""WITH p AS (SELECT a.p_partkey, a.p_name AS o, b.p_name AS n FROM part a JOIN part b ON b.p_partkey = a.p_partkey + 1),
q AS (SELECT *, len(list_filter(range(1, least(length(o), length(n)) + 1), lambda i: left(o, i) = left(n, i))) AS prefix FROM p),
r AS (SELECT *, len(list_filter(range(1, least(length(o), length(n)) - prefix + 1), lambda i: right(o, i) = right(n, i))) AS suffix FROM q)
SELECT p_partkey, CAST(prefix AS INT) AS prefix, CAST(suffix AS INT) AS suffix, substr(o, prefix + 1, length(o) - prefix - suffix) AS removed, substr(n, prefix + 1, length(n) - prefix - suffix) AS added FROM r""")
def text_deltas(spark, sf_dir):
    part = _table(spark, sf_dir, "part")
    after = part.select((F.col("p_partkey") - 1).alias("p_partkey"), F.col("p_name").alias("n"))
    return part.join(after, "p_partkey").select("p_partkey", S.text_delta(F.col("p_name"), F.col("n")).alias("d")).select("p_partkey", "d.*")


@_query(f"""WITH {_LINES}, e AS (SELECT *, regexp_matches(line, '(?i)error|fail|password|secret|token') AS e FROM l),
r AS (SELECT *, sum(CAST(NOT e AS INT)) OVER (PARTITION BY key ORDER BY no) AS run FROM e), a AS (SELECT *, sum(CAST(e AS INT)) OVER (PARTITION BY key, run ORDER BY no) AS pos FROM r),
k AS (SELECT *, e OR coalesce(lag(pos) OVER (PARTITION BY key ORDER BY no) % 2 = 1, FALSE) AS keep FROM a),
f AS (SELECT *, sum(CAST(keep AS INT)) OVER (PARTITION BY key ORDER BY no) AS rank, bool_or(e) OVER (PARTITION BY key) AS hit, count(*) OVER (PARTITION BY key) AS n FROM k)
SELECT key, count(*) AS shown, sha256(string_agg(line, chr(10) ORDER BY no)) AS digest FROM f WHERE CASE WHEN hit THEN keep AND rank <= 35 ELSE no < 8 OR no >= n - 12 END GROUP BY 1""")
def salient_output(spark, sf_dir):
    rows = folding.lines(_table(spark, sf_dir, "documents"), "doc_id", "text")
    kept = decisions.salient_lines(rows, F.col("line").rlike("(?i)error|fail|password|secret|token"))
    ordered = F.array_sort(F.collect_list(F.struct("no", "line")))
    return kept.groupBy("key").agg(F.count("*").alias("shown"), ordered.alias("l")).select("key", "shown", F.sha2(F.array_join("l.line", "\n"), 256).alias("digest"))


@_query("""SELECT l_orderkey, bool_and(l_returnflag IN ('N', 'R')) AS recoverable, CAST(CASE WHEN bool_and(l_returnflag IN ('N', 'R')) THEN count(*) FILTER (l_returnflag = 'R') ELSE 0 END AS BIGINT) AS to_restore FROM lineitem GROUP BY 1""")
def recovery_classes(spark, sf_dir):
    return decisions.recovery(_table(spark, sf_dir, "lineitem"), "l_orderkey", F.col("l_returnflag"), F.lit("N"), F.lit("R"))


@_query("""WITH c AS (SELECT l_orderkey, count(*) FILTER (l_returnflag = 'R') AS ours, count(*) FILTER (l_returnflag = 'A') AS foreign_ FROM lineitem GROUP BY 1)
SELECT l_orderkey, ours, foreign_ AS "foreign", CASE WHEN foreign_ = 0 THEN 'keep' WHEN ours = 0 THEN 'drop' ELSE 'conflict' END AS decision FROM c""")
def receiver_partition(spark, sf_dir):
    return decisions.receiver_partition(_table(spark, sf_dir, "lineitem"), "l_orderkey", F.col("l_returnflag") == "R", F.col("l_returnflag") == "A")


@_query("""SELECT l_orderkey, l_linenumber, l_linestatus FROM lineitem a WHERE l_linestatus <> 'O' OR NOT EXISTS (SELECT 1 FROM lineitem b WHERE b.l_orderkey = a.l_orderkey AND b.l_linestatus <> 'O')""")
def prototype_dedupe(spark, sf_dir):
    return decisions.without_declarations(_table(spark, sf_dir, "lineitem"), ["l_orderkey"], F.col("l_linestatus") == "O").select("l_orderkey", "l_linenumber", "l_linestatus")


@_query("""SELECT o_orderkey, CASE WHEN datediff('day', o_orderdate, TIMESTAMP '1998-12-31') > 1000 THEN 'expired' WHEN l_linestatus IS NULL THEN 'missing' WHEN l_linestatus <> o_orderstatus THEN 'rejected' ELSE 'applicable' END AS status
FROM orders LEFT JOIN (SELECT l_orderkey, min(l_linestatus) AS l_linestatus FROM lineitem GROUP BY 1) ON l_orderkey = o_orderkey""")
def edit_proposals(spark, sf_dir):
    now = _table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.min("l_linestatus").alias("digest"))
    age = F.datediff(F.lit("1998-12-31").cast("date"), F.col("o_orderdate").cast("date"))
    return decisions.proposal_status(_table(spark, sf_dir, "orders"), now, "o_orderkey", "o_orderstatus", "digest", age, 1000)


@_query("""WITH d AS (SELECT DISTINCT p_brand, './' || lower(p_type) AS dir FROM part) SELECT p_brand, 'go test ' || string_agg(dir, ' ' ORDER BY dir) AS command FROM d GROUP BY 1""")
def test_commands(spark, sf_dir):
    tests = _table(spark, sf_dir, "part").select("p_brand", F.concat(F.lit("./"), F.lower("p_type")).alias("dir"))
    return decisions.command_groups(tests, "p_brand", "dir", F.lit("go test"))


@_query("""WITH c AS (SELECT user_id, CASE event_type WHEN 'error' THEN 0 WHEN 'purchase' THEN 1 ELSE 2 END AS priority, epoch_us(ts) AS t FROM events), b AS (SELECT user_id, min(priority) AS priority FROM c GROUP BY 1)
SELECT b.user_id, b.priority, max(t) AS newest_us FROM b JOIN c USING (user_id, priority) GROUP BY ALL""")
def workspace_candidates(spark, sf_dir):
    priority = F.when(F.col("event_type") == "error", 0).when(F.col("event_type") == "purchase", 1).otherwise(2).alias("priority")
    return decisions.ranked_candidates(_table(spark, sf_dir, "events").select("user_id", priority, "ts"), "user_id", "priority", "ts")


@_query("""WITH p AS (SELECT DISTINCT regexp_replace(url, '^[a-z]+://', '') AS path FROM pages), s AS (SELECT path, string_split(path, '/') AS s FROM p),
a AS (SELECT path, k, array_to_string(s[1:len(s) - k], '/') AS folder FROM (SELECT path, s, unnest(range(1, least(len(s) - 1, 10) + 1)) AS k FROM s)),
m AS (SELECT folder FROM a WHERE k = 1 GROUP BY 1 HAVING count(*) >= 2) SELECT p.path, r.root FROM p LEFT JOIN (SELECT path, arg_min(folder, k) AS root FROM a WHERE folder IN (SELECT folder FROM m) GROUP BY 1) r USING (path)""")
def nearest_roots(spark, sf_dir):
    paths = _table(spark, sf_dir, "pages").select(F.regexp_replace("url", "^[a-z]+://", "").alias("path")).distinct()
    markers = paths.select(decisions.ancestors(F.col("path"))[0].alias("folder")).groupBy("folder").count().where("count >= 2 and folder is not null")
    return decisions.nearest_root(paths, "path", markers, "folder")


@_query("SELECT doc_id FROM documents WHERE contains(text, 'License')")
def codemod_targets(spark, sf_dir):
    return _table(spark, sf_dir, "documents").where(F.col("text").contains("License")).select("doc_id")


@_query(f"""WITH {_LINES}, n AS (SELECT key, count(*) AS n FROM l GROUP BY 1), w AS (SELECT l.key, no, CASE WHEN no = 1 THEN 'first patch' WHEN no = least(4, n - 1) THEN 'second patch' ELSE line END AS line FROM l JOIN n USING (key)
WHERE n < 3 OR no NOT IN (2))
SELECT key, sha256(string_agg(line, chr(10) ORDER BY no)) AS digest FROM (SELECT key, no, line FROM w WHERE key IN (SELECT key FROM n WHERE n >= 5) UNION ALL SELECT key, no, line FROM l WHERE key IN (SELECT key FROM n WHERE n < 5)) GROUP BY 1""")
def multi_patch(spark, sf_dir):
    rows = folding.lines(_table(spark, sf_dir, "documents"), "doc_id", "text")
    long_ = rows.groupBy("key").agg(F.count("*").alias("n")).where("n >= 5")
    patch = lambda first, last, text: F.struct(F.lit(first).alias("first"), F.lit(last).alias("last"), F.lit(text).alias("text"))
    patches = long_.select("key", F.explode(F.array(patch(1, 2, "first patch"), patch(4, 4, "second patch"))).alias("p")).select("key", "p.*")
    return decisions.apply_patches(rows, patches).select("key", F.sha2("text", 256).alias("digest"))


@_query("""SELECT o_orderkey, count(l_partkey) AS n_files, count(*) FILTER (p_size > 25) AS n_live FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey LEFT JOIN part ON p_partkey = l_partkey GROUP BY 1 HAVING count(l_partkey) = 0 OR count(*) FILTER (p_size > 25) > 0""")
def live_activities(spark, sf_dir):
    lines = _table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("o_orderkey"), F.col("l_partkey").alias("p_partkey"))
    activities = _table(spark, sf_dir, "orders").select("o_orderkey").join(lines, "o_orderkey", "left")
    return decisions.live_activities(activities, _table(spark, sf_dir, "part").where("p_size > 25"), "o_orderkey", "p_partkey")


@_query("SELECT doc_id, CASE WHEN source = 'code' OR len(string_split(text, chr(10))) <= 12 THEN 'allow' ELSE 'fold' END AS policy FROM documents")
def read_policy(spark, sf_dir):
    docs = _table(spark, sf_dir, "documents")
    return decisions.read_policy(docs, F.size(F.split("text", "\n")), F.col("source") == "code", 12).select("doc_id", "policy")


@_query("SELECT doc_id, sha256(text)[1:12] AS handle, array_to_string(string_split(text, chr(10))[2:3], chr(10)) AS recalled FROM documents WHERE length(text) >= 400")
def output_archive(spark, sf_dir):
    out = decisions.archive(_table(spark, sf_dir, "documents"), F.col("text"))
    return out.select("doc_id", "handle", F.array_join(F.slice(F.split("text", "\n"), 2, 2), "\n").alias("recalled"))


@_query("""WITH f AS (SELECT p_brand, p_name, min(p_partkey) AS pos FROM part WHERE p_brand IN (SELECT p_brand FROM part WHERE p_size = 1) GROUP BY ALL)
SELECT p_brand, p_name, CAST(row_number() OVER (PARTITION BY p_brand ORDER BY pos, p_name) AS INT) AS rank FROM f QUALIFY row_number() OVER (PARTITION BY p_brand ORDER BY pos, p_name) <= 4""")
def dictionary_meanings(spark, sf_dir):
    part = _table(spark, sf_dir, "part")
    return decisions.dictionary(part, "p_brand", "p_name", "p_partkey", part.where("p_size = 1").select("p_brand").distinct())


@_query("""WITH m AS (SELECT p_name AS phrase, p_brand AS macro, count(*) AS uses FROM part GROUP BY ALL), b AS (SELECT phrase, macro FROM m QUALIFY row_number() OVER (PARTITION BY phrase ORDER BY uses DESC, macro) = 1)
SELECT upper(phrase) || ' ?!' AS prompt, macro FROM b""")
def prompt_triggers(spark, sf_dir):
    part = _table(spark, sf_dir, "part")
    macros = part.groupBy(F.col("p_name").alias("phrase"), F.col("p_brand").alias("name")).agg(F.count("*").alias("uses"))
    prompts = part.select(F.concat(F.upper("p_name"), F.lit(" ?!")).alias("prompt")).distinct()
    return decisions.triggers(prompts, "prompt", macros, "phrase", "name", "uses")


@_query("SELECT user_id, event_type, arg_max(value, event_id) AS boost, count(*) AS n FROM events GROUP BY ALL")
def link_feedback(spark, sf_dir):
    return _table(spark, sf_dir, "events").groupBy("user_id", "event_type").agg(F.max_by("value", "event_id").alias("boost"), F.count("*").alias("n"))


@_query()
def bracket_balance(spark, sf_dir):
    """First bracket of each page that does not match; no SQL, tested by itself."""
    return _table(spark, sf_dir, "pages").select("page_id", S.bracket_imbalance(F.col("html")).alias("first"))


@_query("""SELECT o_custkey AS key, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS step, '## step ' || o_orderkey AS header, CASE WHEN o_orderstatus = 'F' THEN '[exit=1]' ELSE '[exit=0]' END AS exit_line,
o_orderpriority || chr(10) || chr(10) || o_orderstatus AS output, CASE WHEN o_orderstatus = 'P' THEN 'after' ELSE '' END AS extra FROM orders""")
def step_blocks(spark, sf_dir):
    status = F.col("o_orderstatus")
    block = F.array(F.concat(F.lit("## step "), F.col("o_orderkey").cast("string")), F.lit(""), F.col("o_orderpriority"), F.lit(""), status, F.lit(""), F.when(status == "F", "[exit=1]").otherwise("[exit=0]"), F.when(status == "P", "after").otherwise(" "))
    orders = _table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("key"), "o_orderkey", "o_orderpriority", "o_orderstatus")
    # orders go to their place, where they become lines, so that no line is shuffled
    places = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 8 * orders.count() // decisions.PLACE_LINES + 1)
    rows = orders.repartition(places, "key").select("key", "o_orderkey", F.posexplode(block).alias("i", "line"))
    return decisions.step_blocks(rows.select("key", (F.col("o_orderkey") * 10 + F.col("i")).alias("no"), "line"))


@_query("""SELECT DISTINCT 'src/' || p_type || '.ts' AS target, 'file' AS kind, 'src/' || p_type || '.ts' AS path, NULL AS symbol, NULL::INT AS "first", NULL::INT AS "last" FROM part
UNION ALL SELECT DISTINCT 'src/' || p_type || '.ts#' || p_brand, 'symbol', 'src/' || p_type || '.ts', p_brand, NULL, NULL FROM part
UNION ALL SELECT DISTINCT 'a.ts:' || p_size, 'range', 'a.ts', NULL, p_size, p_size + 40 FROM part
UNION ALL SELECT DISTINCT 'a.ts:' || p_size || '-' || (p_size + 7), 'range', 'a.ts', NULL, p_size, p_size + 7 FROM part
UNION ALL VALUES ('@brief', 'brief', NULL, NULL, NULL, NULL), ('docs/x.MD', 'document', 'docs/x.MD', NULL, NULL, NULL)""")
def read_targets(spark, sf_dir):
    file, size = F.concat(F.lit("src/"), F.col("p_type"), F.lit(".ts")), F.col("p_size").cast("string")
    ranged = F.concat(F.lit("a.ts:"), size)
    every = F.array(file, F.concat(file, F.lit("#"), F.col("p_brand")), ranged, F.concat(ranged, F.lit("-"), (F.col("p_size") + 7).cast("string")), F.lit("@brief"), F.lit("docs/x.MD"))
    targets = _table(spark, sf_dir, "part").select(F.explode(every).alias("target")).distinct()
    return targets.select("target", S.read_target(F.col("target")).alias("t")).select("target", "t.*")


_IMPACT = """impact AS (SELECT path FROM symbols WHERE path = 'src/util/index.ts' AND name = 'format' UNION SELECT path FROM named WHERE target = 'src/util/index.ts' AND callee = 'format'
  UNION SELECT path FROM resolved WHERE target_path = 'src/util/index.ts' AND callee = 'format' AND confidence >= 0.75)"""


def _impact(spark):
    imports = resolve.resolve_imports(frame(spark, "imports"), frame(spark, "files")).join(frame(spark, "imports"), ["path", "module"])
    return decisions.rename_impact(frame(spark, "symbols"), imports, _resolved(spark), "src/util/index.ts", "format")


@_query(f"WITH {_CALLS}, {_IMPACT} SELECT path FROM impact")
def rename_impact(spark, sf_dir):
    return _impact(spark)


@_query(f"WITH {_CALLS}, {_IMPACT} SELECT DISTINCT path, name FROM symbols WHERE name = 'cancel' AND path IN (SELECT path FROM impact)")
def rename_conflicts(spark, sf_dir):
    none = spark.createDataFrame([], "path string, name string")
    return decisions.rename_conflicts(_impact(spark), frame(spark, "symbols"), none, "cancel")
