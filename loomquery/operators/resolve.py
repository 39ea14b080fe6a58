"""Name resolution on symbol tables, and the guards of edits."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from loomquery.functions import text as T


def enclosing(points: DataFrame, spans: DataFrame) -> DataFrame:
    """Innermost span around each point of the same file; ties to the first declared. Spans may cross.

    ``points(path, point)``, ``spans(path, name, first, last, ordinal)``, in whole numbers. The ends of a file's spans cut it into stretches, numbered in
    order, with the same spans around all their numbers. A span is cut into aligned pieces of 1, 2, 4 ... stretches, two of a size at most, and the best
    span of each piece is kept; a stretch looks up the piece of each size that holds it. A point then takes the stretch that starts last before it, in
    one window over both, so points pass one shuffle as they are, and only spans are multiplied, by a logarithm of their number in a file.
    """
    spans = spans.where("first <= last and path is not null").select("path", F.struct((F.col("last") - F.col("first")).alias("long"), "ordinal", "name").alias("span"), F.col("first").cast("bigint").alias("a"), (F.col("last").cast("bigint") + 1).alias("b"))
    ends = spans.select("path", "span", F.explode(F.array("a", "b")).alias("start"), "a")
    numbered = ends.withColumn("n", F.dense_rank().over(Window.partitionBy("path").orderBy("start")).cast("bigint"))
    ranked = numbered.groupBy("path", "span", "a").agg(F.min("n").alias("first"), (F.max("n") - 1).alias("last"))
    cut = F.expr("""aggregate(sequence(0, cast(log2(last - first + 1) as int) + 1), struct(first as a, last as b, cast(array() as array<struct<size: int, piece: bigint>>) as p), (s, i) ->
      if(s.a > s.b, s, struct(shiftright(s.a + 1, 1) as a, shiftright(s.b - 1, 1) as b, concat(s.p, if(s.a & 1 = 1, array(struct(i as size, s.a as piece)), array()), if(s.b & 1 = 0, array(struct(i as size, s.b as piece)), array())) as p)), s -> s.p)""")
    best = ranked.select("path", "span", F.explode(cut).alias("c")).groupBy("path", "c.size", "c.piece").agg(F.min("span").alias("span"))
    sizes = best.groupBy("path").agg(F.collect_set("size").alias("sizes"))
    stretches = numbered.select("path", "n", "start").distinct()
    asked = stretches.join(sizes, "path").select("path", "start", "n", F.explode("sizes").alias("size")).withColumn("piece", F.expr("shiftright(n, size)"))
    # a stretch that no span is around ends the one before it
    inner = asked.join(best, ["path", "size", "piece"], "left").groupBy("path", "start").agg(F.min("span").alias("span"))
    starts = inner.select("path", F.col("start").alias("at"), F.struct(F.col("span.name").alias("name")).alias("starts"))
    both = points.select("path", F.col("point").cast("bigint").alias("at"), "point").unionByName(starts, allowMissingColumns=True)
    name = F.last("starts", ignorenulls=True).over(Window.partitionBy("path").orderBy("at", F.col("starts").isNull()).rowsBetween(Window.unboundedPreceding, 0))["name"]
    return both.withColumn("name", name).where("starts is null").select("path", "point", "name")


#: Endings tried after a path without one, in order, by language.
TRIED = ["", ".ts", ".tsx", ".js", ".mjs", "/index.ts", "/index.js"]
C_FILES = r"\.(c|h|cc|cpp|hpp|cxx|hxx)$"


#: Segments that a normal path does not have.
_ODD = r"(^|/)\.{0,2}(/|$)"


def normal_path(path):
    """A path without ``.`` and empty segments, ``..`` resolved; those that lead out of the root stay in front."""

    def step(out, part):
        up = (part == "..") & (F.size(out) > 0) & (F.element_at(F.concat(F.array(F.lit("..")), out), -1) != "..")
        return F.when(part.isin("", "."), out).when(up, F.slice(out, 1, F.greatest(F.size(out) - 1, F.lit(0)))).otherwise(F.concat(out, F.array(part)))

    plain = ~F.rlike(path, F.lit(_ODD))  # most have nothing to resolve
    return F.when(plain, path).otherwise(F.array_join(F.aggregate(F.split(path, "/"), F.expr("cast(array() as array<string>)"), step), "/"))


def inside(folder, ups, rest, odd):
    """``rest`` beside ``ups`` folders above ``folder``, normal; one outside the root starts with ``..``. Only where either is ``odd`` are segments resolved one by one."""
    deep = F.when(folder == "", 0).otherwise(F.length(folder) - F.length(F.replace(folder, F.lit("/"), F.lit(""))) + 1)
    above = F.call_function("substring_index", folder, F.lit("/"), deep - ups)
    quick = F.when(ups < deep, F.concat(above, F.lit("/"), rest)).when(ups == deep, rest).otherwise(F.concat(F.lit("../"), rest))
    return F.when(odd, normal_path(F.concat_ws("/", folder, F.repeat(F.lit("../"), ups), rest))).otherwise(quick)


#: What the candidates of an import depend on, besides the files there are.
PLACE = ["folder", "ending", "module"]

#: So many pairs of a folder and an ending go through the driver at most.
MOST_FOLDERS = 2000


def _folder_and_ending(path: str):
    last = F.substring_index(path, "/", -1)
    ending = F.when(F.contains(last, F.lit(".")), F.concat(F.lit("."), F.substring_index(last, ".", -1))).otherwise("")
    return F.left(path, F.length(path) - F.length(last) - 1), ending


def placed(imports: DataFrame) -> DataFrame:
    """``imports(path, module)`` with the folder and the ending of the importing file."""
    return imports.withColumns(dict(zip(PLACE, _folder_and_ending("path"))))


def import_candidates(places: DataFrame) -> DataFrame:
    """(folder, ending, module, prio, candidate): candidate files of imports, in order, by the rules of the importing file's language; none outside the root.

    What several candidates share is a column of its own, so it is computed once, and by generated code unless a path has segments to resolve.
    """
    folder, spec, ending, near, rest, ups = (F.col(c) for c in ("folder", "module", "ending", "near", "rest", "ups"))
    kind = F.when(ending.rlike(r"\.pyi?$"), "python").when(ending.rlike(r"\.rs$"), "rust").when(ending.rlike(C_FILES), "c").otherwise("script")
    python, rust, c, script = (F.col("kind") == x for x in ("python", "rust", "c", "script"))
    name, climb = F.ltrim(spec, F.lit(".")), F.regexp_extract(spec, r"^((?:\.{1,2}/)*)", 1)
    relative = F.length(spec) > F.length(name)
    rows = places.withColumns({"kind": kind, "relative": relative, "climb": climb}).withColumns({
        "ups": F.when(python, F.length(spec) - F.length(name) - 1).when(rust, 0).otherwise(F.length("climb") - F.length(F.replace("climb", F.lit("../"), F.lit("..")))),
        "rest": F.when(python, F.replace(name, F.lit("."), F.lit("/"))).when(rust, F.replace(F.regexp_replace(spec, "^(crate|super|self)::", ""), F.lit("::"), F.lit("/"))).otherwise(F.substr(spec, F.length("climb") + 1)),
    })
    rows = rows.withColumn("odd", F.rlike(rest, F.lit(_ODD)))
    at = lambda top: inside(F.lit(top), ups, rest, F.col("odd"))
    rows = rows.withColumn("near", F.when(~python | F.col("relative"), inside(folder, ups, rest, F.col("odd") | ((folder != "") & F.rlike(folder, F.lit(_ODD))))))
    rows = rows.withColumn("bare", F.when(script, F.regexp_replace(near, r"(?i)\.(js|mjs|cjs)$", "")))
    ends = lambda path, *endings: [F.concat(path, F.lit(x)) for x in endings]
    tops = (F.concat_ws("/", F.nullif(folder, F.lit("")), rest), rest, F.concat(F.lit("src/"), rest))
    found = F.when(python & F.col("relative"), F.array(*ends(near, ".py", "/__init__.py"))).when(python & (rest != ""), F.array(*(F.concat(x, F.lit(".py")) for x in tops), *ends(rest, "/__init__.py")))
    found = found.when(rust, F.array(*ends(near, ".rs"), *ends(F.concat(F.lit("src/"), rest), ".rs"), *ends(rest, ".rs"), *ends(F.concat(F.lit("src/"), rest), "/mod.rs")))
    found = found.when(c, F.array(near, at(""), at("include"), at("src"))).when(script & spec.startswith("."), F.array(near, *ends(F.col("bare"), *TRIED[1:])))
    return rows.select(*PLACE, F.posexplode(found).alias("prio", "candidate")).where(~F.col("candidate").startswith(".."))


def tried_files(imports: DataFrame, files: DataFrame) -> DataFrame:
    """The candidates of imports, once for all files of a folder and an ending, without those in whose folder no file of ``files(path)`` has their ending.

    So most candidates are left out before they are shuffled. With more than MOST_FOLDERS folders and endings of files all are kept.
    """
    known = lambda path: F.concat_ws("/", *_folder_and_ending(path))
    asked = placed(imports.where("path is not null and module is not null").select("path", "module")).select(*PLACE).distinct()
    there = [r[0] for r in files.where("path is not null").select(known("path")).distinct().limit(MOST_FOLDERS + 1).collect()]
    tried = import_candidates(asked)
    return tried if len(there) > MOST_FOLDERS else tried.where(known("candidate").isin(there))


def resolve_imports(imports: DataFrame, files: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """(path, module, target): the first candidate that is a known file, or null; each once, or, with other columns to keep, each row of ``imports``.

    Candidates depend on the importing file's folder and ending alone, so a module is resolved once for all files of a folder and an ending. Files and
    places grow with the code, so neither is broadcast; a task holds those of its part, each once.
    """
    rows = imports.select("path", "module", *keep)
    known = files.select(F.col("path").alias("candidate")).hint("shuffle_hash")
    best = tried_files(imports, files).join(known, "candidate", "left_semi").groupBy(*PLACE).agg(F.min_by("candidate", "prio").alias("target"))
    return placed(rows if keep else rows.distinct()).join(best.hint("shuffle_hash"), PLACE, "left").select("path", "module", *keep, "target")


def resolve_methods(calls: DataFrame, symbols: DataFrame, closure: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """Member calls with a known receiver class: own method 0.95, the nearest inherited one 0.9; of its files the caller's own, else the first.

    The classes of a lineage are searched once for each receiver and member, not for each call, and by the first file of a member; a call then asks
    only whether its own file declares the member too, so no call meets all the files that do. Calls and declarations of a file and member
    pass one shuffle for that. Calls of a line are told apart by the columns to ``keep``, which come last.
    """
    lineage = symbols.select(F.col("parent_class").alias("child")).where("child is not null").distinct()
    lineage = lineage.select("child", F.col("child").alias("ancestor"), F.lit(0).alias("depth")).union(closure)
    owned = symbols.where("parent_class is not null").select(F.col("parent_class").alias("ancestor"), F.col("name").alias("callee"), F.col("path").alias("target_path"), F.col("ordinal").alias("o"))
    first = owned.groupBy("ancestor", "callee").agg(F.min("target_path").alias("first"))
    calls = calls.where("receiver_class is not null").select("path", "line", "callee", "receiver_class", *keep)
    asked = calls.select(F.col("receiver_class").alias("child"), "callee").distinct()
    found = asked.join(lineage.hint("shuffle_hash"), "child").join(first.hint("shuffle_hash"), ["ancestor", "callee"])
    least = F.min("depth").over(Window.partitionBy("child", "callee"))
    found = found.withColumn("least", least).where("depth = least").select(F.col("child").alias("receiver_class"), "callee", "ancestor", "depth", "first")
    here = owned.select(F.col("target_path").alias("path"), "callee", "ancestor").where("path is not null").distinct().withColumn("own", F.lit(True))
    hits = calls.join(found, ["receiver_class", "callee"]).drop("receiver_class").unionByName(here, allowMissingColumns=True).repartition("path", "callee")
    hits = hits.withColumn("own", F.max("own").over(Window.partitionBy("path", "callee", "ancestor"))).where("depth is not null")
    target = F.when(F.col("own"), F.col("path")).otherwise(F.col("first"))
    best = hits.groupBy("path", "line", "callee", *keep).agg(F.min(F.struct("depth", target != F.col("path"), target.alias("target_path"), "ancestor")).alias("t"))
    return best.select("path", "line", "callee", F.col("t.ancestor").alias("target_class"), F.col("t.target_path").alias("target_path"), F.when(F.col("t.depth") == 0, 0.95).otherwise(0.9).alias("confidence"), *keep)


def resolve_calls(calls: DataFrame, symbols: DataFrame, imports: DataFrame, least: float = 0.0, keep: tuple[str, ...] = ()) -> DataFrame:
    """Plain calls: same file 0.9, imported 0.95, same package if unique 0.8, unique in the language family 0.6.

    Each stage joins on equal keys with one row a key, and names that several files declare are counted before they are joined, so a call never
    meets all the declarations of its name. What counts for a name in a file is found once for all its lines, and meets them in one window.
    Stages below the confidence ``least`` are left out, so what they alone would find is unresolved. The columns to ``keep`` come last.
    """
    family = T.language_family(F.col("path"))
    folder = lambda c: F.regexp_extract(c, r"^(.*)/[^/]*$", 1)
    free = symbols.where("parent_class is null and path is not null and name is not null").select(F.col("name").alias("callee"), "path")
    plain = calls.where("receiver_class is null").select("path", "line", "callee", *keep)
    own = free.distinct().withColumn("own", F.lit(True))
    named = imports.where("target is not null and path is not null").select("path", F.col("target").alias("target_path"), F.explode("names").alias("callee"))
    named = named.join(free.select(F.col("path").alias("target_path"), "callee").hint("shuffle_hash"), ["target_path", "callee"], "left_semi")
    alike = F.when(family == T.language_family(F.col("target_path")), F.col("target_path"))  # not a filter: it would become a key of the join, computed at each comparison
    facts = [own, named.select("path", "callee", alike.alias("brought"))]
    by_family = free.withColumns({"family": family, "folder": folder("path")})
    asked = plain.where("path is not null").select("path", "callee").withColumns({"family": family, "folder": folder("path")})
    packages = F.col("family").isin("go", "csharp")
    stages = [("beside", 0.8, packages, ["callee", "family", "folder"]), ("alone", 0.6, F.lit(True), ["callee", "family"])]
    for name, confidence, where, keys in stages:
        single = by_family.where(where).groupBy(*keys).agg(F.count("*").alias("n"), F.min("path").alias(name)).where("n = 1").drop("n")
        if confidence >= least:
            facts.append(asked.where(where).distinct().join(single.hint("shuffle_hash"), keys).select("path", "callee", name))
    rows = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), facts, plain.withColumn("call", F.lit(1)))
    rows = rows.withColumns({name: F.lit(None).cast("string") for name, *_ in stages if name not in rows.columns})
    # A call that comes twice in a line is not the only one of its name there, so the last two stages leave it.
    once = F.sum("call").over(Window.partitionBy("path", "line", "callee")) == 1
    of_name = Window.partitionBy("path", "callee")
    rows = rows.repartition("path", "callee").withColumns({"own": F.max("own").over(of_name), **{c: F.min(c).over(of_name) for c in ("brought", "beside", "alone")}}).where("call = 1").withColumn("once", once)
    pick = lambda target, confidence: F.struct(target.alias("target_path"), F.lit(confidence).alias("confidence"))
    ways = [(F.col("own"), F.col("path"), 0.9), (F.col("brought").isNotNull(), F.col("brought"), 0.95), (F.col("once") & F.col("beside").isNotNull(), F.col("beside"), 0.8), (F.col("once") & F.col("alone").isNotNull(), F.col("alone"), 0.6)]
    best = reduce(lambda c, way: c.when(way[0], pick(*way[1:])), ways, F).otherwise(pick(F.lit(None).cast("string"), 0.0))
    return rows.withColumn("t", best).select("path", "line", "callee", "t.target_path", "t.confidence", *keep)


def implementers(members: DataFrame, required: DataFrame) -> DataFrame:
    """Relational division: types that have every member an interface requires, if only one interface fits.

    ``members(type, member)``, ``required(interface, member)``, both distinct.
    """
    need = required.groupBy("interface").agg(F.count("*").alias("need"))
    have = members.join(required, "member").groupBy("type", "interface").agg(F.count("*").alias("have"))
    full = have.join(need, "interface").where("have = need")
    return full.withColumn("c", F.count("*").over(Window.partitionBy("type"))).where("c = 1").select("type", "interface")


def blast_radius(resolved: DataFrame, target_path: str, name: str, show: int = 6) -> DataFrame:
    """Proven callers of a symbol, production before tests, the first ``show``; the total counts all of them."""
    hits = resolved.where((F.col("target_path") == target_path) & (F.col("callee") == name) & (F.col("confidence") >= 0.75))
    test = T.is_test_path(F.col("path"))
    first = hits.select("path", "line", test.alias("is_test")).orderBy("is_test", "path", "line").limit(show)
    ranked = first.withColumn("rank", F.row_number().over(Window.orderBy("is_test", "path", "line")))
    return ranked.join(F.broadcast(hits.agg(F.count("*").alias("total"))), how="cross").select("path", "line", "is_test", "total", "rank")  # one row


def arity_guard(calls: DataFrame, old: DataFrame, new: DataFrame) -> DataFrame:
    """Calls that a changed parameter count breaks."""
    change = old.select("name", F.col("params_count").alias("was")).join(new.select("name", F.col("params_count").alias("now")), "name").where("was <> now")
    return calls.join(change, calls.callee == change.name).where("args_count > now or (now > was and args_count < now)").select("path", "line", "callee", "args_count", "was", "now")


def removed_exports(old: DataFrame, new: DataFrame, calls: DataFrame) -> DataFrame:
    """Exported names that an edit removes although other files still call them."""
    gone = old.where("exported").join(new, ["path", "name"], "left_anti").select(F.col("path").alias("from_path"), "name")
    used = calls.join(gone, calls.callee == gone.name).where("path <> from_path")
    return used.groupBy("from_path", "name").agg(F.count("*").alias("uses"))


def removed_fields(old: DataFrame, new: DataFrame) -> DataFrame:
    pair = old.select("name", F.col("fields").alias("was")).join(new.select("name", F.col("fields").alias("now")), "name")
    return pair.select("name", F.explode(F.array_except("was", "now")).alias("field"))


def broken_imports(old: DataFrame, new: DataFrame, files: DataFrame) -> DataFrame:
    """New relative imports that lead nowhere."""
    fresh = new.join(old, ["path", "module"], "left_anti")
    return resolve_imports(fresh, files).where(F.col("target").isNull() & F.col("module").startswith(".")).select("path", "module")
