"""The code graph as a view of what each file contributes, kept up by redoing only the files that a change can reach."""

from __future__ import annotations

from dataclasses import dataclass, fields, replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomquery.operators import graph, resolve
from loomquery.operators._lineage import written

#: Least confidence of a call that becomes an edge.
CONFIDENT = 0.75


@dataclass
class Code:
    """A parsed code base.

    ``files(path, fingerprint)``, ``symbols(path, name, parent_class, ordinal)``, ``imports(path, module, names)``, names being an array,
    ``calls(path, line, caller, callee, receiver_class)``, receiver_class being null where unknown, ``parents(path, child, parent)``.
    """

    files: DataFrame
    symbols: DataFrame
    imports: DataFrame
    calls: DataFrame
    parents: DataFrame

    def of(self, paths: DataFrame) -> "Code":
        """What some files hold, among the parents of all."""
        rows = {f.name: getattr(self, f.name).join(paths, "path", "left_semi") for f in fields(self) if f.name != "parents"}
        return replace(self, **rows)


@dataclass
class State:
    """What a build leaves for the next: ``edges(path, kind, source, target)`` are each file's own contribution, ``queried(path, name)`` the names
    and receiver classes of its calls. The rest is the code's own. What follows from it, the candidates of imports and the ancestors of classes, is
    not kept for each file, for it is much larger: the next build derives it once for all files."""

    files: DataFrame
    symbols: DataFrame
    parents: DataFrame
    edges: DataFrame
    queried: DataFrame
    imports: DataFrame


def file_id(path: Column) -> Column:
    return F.concat(F.lit("file:"), path)


def symbol_id(path: Column, name: Column, parent_class: Column) -> Column:
    return F.concat(F.lit("symbol:"), path, F.lit("#"), F.concat_ws(".", parent_class, name))


def _lineage(parents: DataFrame) -> DataFrame:
    """(child, ancestor, depth) of all classes, over the declarations of all files."""
    return graph.closure(parents.select("child", "parent"))


def contribution(code: Code, all_files: Code) -> DataFrame:
    """edges(path, kind, source, target) of the files of ``code``, resolved among ``all_files``, over tables in the shared folder.

    Each kind of call is written by itself: one plan of all would be more than a driver holds. A caller that a call names may be of any file, so its
    file is looked up here; other sources are the files themselves, and ``edges`` looks up those.
    """
    brought = resolve.resolve_imports(code.imports, all_files.files, keep=("names",)).where("target is not null").select("path", "target", "names")
    brought, lineage = written(brought.distinct(), "graph-brought"), written(_lineage(all_files.parents), "graph-lineage")
    here = file_id(F.col("path"))
    imports = brought.where("target <> path").select("path", F.lit("imports").alias("kind"), here.alias("source"), file_id(F.col("target")).alias("target"))
    defines = code.symbols.select("path", F.lit("defines").alias("kind"), here.alias("source"), symbol_id(F.col("path"), F.col("name"), F.col("parent_class")).alias("target"))
    calls = code.calls.select("path", "line", "callee", "receiver_class", F.coalesce("caller", here).alias("caller"))
    plain = resolve.resolve_calls(calls, all_files.symbols, brought, least=CONFIDENT, keep=("caller",)).withColumn("target_class", F.lit(None).cast("string"))
    # Equal calls of a file are resolved once, whatever their lines; a receiver stands for the line.
    typed = resolve.resolve_methods(calls.withColumn("line", F.col("receiver_class")), all_files.symbols, lineage, keep=("caller",))
    edges = defines.distinct().union(imports.distinct())
    for hits in (plain, typed):
        hits = hits.where(F.col("confidence") >= CONFIDENT).select("path", "callee", "caller", "target_class", "target_path").distinct()
        hits = hits.select("path", F.lit("calls").alias("kind"), F.col("caller").alias("source"), symbol_id(F.col("target_path"), F.col("callee"), F.col("target_class")).alias("target"))
        hits = written(hits.where("source <> target"), "graph-calls")
        named = hits.where(F.col("source") != here).join(code.files.select("path").hint("shuffle_hash"), "path", "left_semi")
        edges = edges.union(hits.where(F.col("source") == here)).union(named)
    return edges


def dirty_paths(code: Code, old: State) -> DataFrame:
    """Files whose contribution may differ from the one in ``old``.

    Those that are new or changed; those that looked up a name of which a declaration or a parent class came, went or moved; and those with an
    import that a file that came or went is a candidate of. A clean file's edges depend on nothing else.
    """
    status = written(graph.fingerprint_diff(old.files, code.files).where("status <> 'same'"), "graph-status")
    moved = status.where("status in ('added', 'removed')").select("path")

    def shift(was: DataFrame, now: DataFrame, *columns: str) -> DataFrame:
        sides = was.select(*columns, F.lit(1).alias("side")).union(now.select(*columns, F.lit(-1).alias("side")))
        return sides.groupBy(*columns).agg(F.sum("side").alias("more")).where("more <> 0")

    named = shift(old.symbols, code.symbols, "path", "name", "parent_class").select(F.explode(F.array_compact(F.array("name", "parent_class"))).alias("name"))
    above = shift(old.parents, code.parents, "path", "child", "parent").select(F.col("child").alias("name"))
    names = written(named.union(above).distinct(), "graph-names")
    heirs = _lineage(old.parents).join(names.withColumnRenamed("name", "ancestor"), "ancestor", "left_semi").select(F.col("child").alias("name"))
    names = written(names.union(heirs).distinct(), "graph-names")
    asked = old.queried.join(names, "name", "left_semi").select("path")
    places = resolve.tried_files(old.imports, moved).join(moved.withColumnRenamed("path", "candidate").hint("shuffle_hash"), "candidate", "left_semi").select(*resolve.PLACE).distinct()
    probed = resolve.placed(old.imports).join(places.hint("shuffle_hash"), resolve.PLACE, "left_semi").select("path")
    dirty = status.where("status in ('added', 'changed')").select("path").union(asked).union(probed).distinct()
    return dirty.join(code.files.select("path").hint("shuffle_hash"), "path", "left_semi")


def build(code: Code, old: State | None = None) -> DataFrame:
    """edges(path, kind, source, target) of ``code``, whose symbols are written: of all files, or, given the state before, of the dirty ones and what
    stays of it. Where most files are dirty, all are done: to tell the others' imports and calls would take longer than they do."""
    if old is None:
        return contribution(code, code)
    dirty = written(dirty_paths(code, old), "graph-dirty")
    if 2 * dirty.count() > code.files.count():
        return contribution(code, code)
    kept = code.files.select("path").join(dirty, "path", "left_anti")
    return written(contribution(code.of(dirty), code).union(old.edges.join(kept, "path", "left_semi")), "graph-edges")


def rebuild(code: Code, old: State | None = None) -> State:
    """The state of ``code``, in the shared folder, made from the state before, if given. What files ask for is read from ``code``, not resolved, so it is
    that of all files."""
    code = replace(code, symbols=written(code.symbols, "graph-symbols"))
    asked = code.calls.select("path", F.explode(F.array_compact(F.array("callee", "receiver_class"))).alias("name"))
    tables = {"files": code.files.select("path", "fingerprint"), "parents": code.parents.select("path", "child", "parent"), "queried": asked, "imports": code.imports.select("path", "module")}
    return State(symbols=code.symbols, edges=build(code, old), **{k: written(rows, f"graph-{k}") for k, rows in tables.items()})


def nodes(state: State | Code) -> DataFrame:
    """(id, kind) of the files and symbols of a state or of code."""
    symbols = state.symbols.select(symbol_id(F.col("path"), F.col("name"), F.col("parent_class")).alias("id"), F.lit("symbol").alias("kind")).distinct()
    return state.files.select(file_id(F.col("path")).alias("id"), F.lit("file").alias("kind")).union(symbols)


def edges(state: State) -> DataFrame:
    """(kind, source, target) of a state, both ends known, each once.

    A target is a file or symbol that the code declares, or its file would have been dirty, so only sources, which callers name, are looked up; the rows
    of a source are then made distinct where they are.
    """
    return known_edges(state.edges, nodes(state))


def known_edges(rows: DataFrame, known: DataFrame) -> DataFrame:
    known = known.select(F.col("id").alias("source")).hint("shuffle_hash")  # as many as files and symbols, so not broadcast
    return rows.select("kind", "source", "target").join(known, "source", "left_semi").distinct().select("kind", "source", "target")


def full_edges(code: Code, old: State | None = None) -> DataFrame:
    """(kind, source, target) of ``code``, made from the state before, if given, without a state for a next build."""
    code = replace(code, symbols=written(code.symbols, "graph-symbols"))
    return known_edges(build(code, old), nodes(code))
