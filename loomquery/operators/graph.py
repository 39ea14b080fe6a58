"""Code graph: edges, closures, reachability and incremental plans."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from loomquery.operators._lineage import checkpointed

KINDS = ["defines", "imports", "calls", "doc-links-code", "co-edit"]
MAX_EDGES = 5000


def merge_edges(edges: DataFrame, nodes: DataFrame, cap: int = MAX_EDGES) -> DataFrame:
    """First of each (kind, source, target), both ends known, in the order of kinds; ``cap`` accepted at most.

    ``edges(kind, source, target, ordinal)``.
    """
    rank = F.array_position(F.array(*map(F.lit, KINDS)), F.col("kind"))
    known = edges.join(nodes.select(F.col("id").alias("source")), "source", "left_semi").join(nodes.select(F.col("id").alias("target")), "target", "left_semi")
    first = known.groupBy("kind", "source", "target").agg(F.min("ordinal").alias("ordinal"))
    return first.withColumn("kind_rank", rank).orderBy("kind_rank", "ordinal", "source", "target").limit(cap).select("kind", "source", "target")


def hubs(files: DataFrame, imports: DataFrame, top: int = 6) -> DataFrame:
    """Files by the number of distinct files that import them, those without importers included."""
    degree = imports.where("source <> target").groupBy("target").agg(F.countDistinct("source").alias("n"))
    return files.join(degree, files.id == degree.target, "left").select("id", F.coalesce("n", F.lit(0)).alias("importers")).orderBy(F.desc("importers"), "id").limit(top)


def closure(parents: DataFrame, depth: int | None = None) -> DataFrame:
    """(child, ancestor, depth) of a single-parent hierarchy, nearest depth first, safe on cycles; ``depth`` levels, by default all.

    Doubles path lengths each round, so a chain takes as many joins as its length has bits; rows are checkpointed each round.
    """
    known = parents.where("child <> parent").groupBy("child").agg(F.min("parent").alias("ancestor")).withColumn("depth", F.lit(1))
    known, reach, n = checkpointed(known), 1, -1
    while (depth is None or reach < depth) and (m := known.count()) != n:
        n = m
        a, b = known.alias("a"), known.alias("b")
        longer = a.join(b, F.col("a.ancestor") == F.col("b.child")).select("a.child", "b.ancestor", (F.col("a.depth") + F.col("b.depth")).alias("depth")).where("child <> ancestor")
        if depth is not None:
            longer = longer.where(F.col("depth") <= depth)
        known = checkpointed(known.union(longer).groupBy("child", "ancestor").agg(F.min("depth").alias("depth")))
        reach *= 2
    return known


def reachable(seeds: DataFrame, edges: DataFrame, hops: int = 6) -> DataFrame:
    """(node, hops): nodes reached from ``seeds(node)`` along ``edges(source, target)`` within some hops.

    Each hop is one join and one partial aggregation; the plan grows by as much, not by all of the hops before.
    """
    out = seeds.select("node").distinct().withColumn("hops", F.lit(0))
    edges = edges.select("source", "target")
    for _ in range(hops):
        stay, go = F.struct("node", "hops"), F.struct(F.col("target").alias("node"), (F.col("hops") + 1).alias("hops"))
        both = out.join(edges, F.col("node") == F.col("source"), "left").select(F.explode(F.array(stay, go)).alias("s")).select("s.*")
        out = both.where("node is not null").groupBy("node").agg(F.min("hops").alias("hops"))
    return out


def fingerprint_diff(old: DataFrame, new: DataFrame, key: str = "path", fingerprint: str = "fingerprint") -> DataFrame:
    """(key, status): added, removed, changed or same."""
    a, b = old.select(F.col(key).alias("ko"), F.col(fingerprint).alias("fo")), new.select(F.col(key).alias("kn"), F.col(fingerprint).alias("fn"))
    status = F.when(F.col("ko").isNull(), "added").when(F.col("kn").isNull(), "removed").when(F.col("fo").eqNullSafe(F.col("fn")), "same").otherwise("changed")
    return a.join(b, F.col("ko") == F.col("kn"), "full").select(F.coalesce("ko", "kn").alias(key), status.alias("status"))


def dirty_files(diff: DataFrame, declared: DataFrame, queried: DataFrame, unresolved: DataFrame) -> DataFrame:
    """Files to rebuild: changed ones, those that queried a name changed files declare, and, if the set of
    files changed, those with unresolved imports. ``declared`` and ``queried`` are (path, name) rows of both states."""
    changed = diff.where("status <> 'same'").select("path")
    names = declared.join(changed, "path", "left_semi").select("name").distinct()
    asked = queried.join(names, "name", "left_semi").select("path")
    moved = diff.where("status in ('added', 'removed')").limit(1).select(F.lit(1).alias("m"))
    open_ = unresolved.select("path").where(F.lit(not moved.isEmpty()))
    return diff.where("status in ('added', 'changed')").select("path").union(asked).union(open_).distinct()


def generic_names(names: DataFrame, column: str, generic: list[str]) -> DataFrame:
    return names.where(~F.lower(column).isin(generic))


def verified_links(links: DataFrame, sections: DataFrame, symbols: DataFrame) -> DataFrame:
    """Explicit links(section, path, name, parent_class) whose section shows the bare name between boundaries.

    Members of a class whose name several files declare also need their qualified name, in any case, or their file in
    the section. ``sections(section, text)``, ``symbols(path, name)``.
    """
    edge = r"[\p{javaUnicodeIdentifierPart}$]"
    quoted = lambda c: F.concat(F.lit(rf"(?<!{edge})\Q"), c, F.lit(rf"\E(?!{edge})"))
    several = symbols.groupBy("name").agg((F.countDistinct("path") > 1).alias("several"))
    rows = links.join(sections, "section").join(several, "name", "left")
    shown = F.rlike("text", quoted(F.col("name")))
    exact = F.contains("text", F.regexp_extract("path", r"([^/]*)$", 1)) | F.rlike(F.lower("text"), quoted(F.lower(F.concat_ws(".", "parent_class", "name"))))
    return rows.where(shown & (F.col("parent_class").isNull() | ~F.coalesce("several", F.lit(False)) | exact)).select(*links.columns)


def brief(hubs_: DataFrame, activities: DataFrame, links: DataFrame, macros: DataFrame, pairs: DataFrame) -> DataFrame:
    """(part, rank, line) of an overview: 6 hubs(path, n), the last 5 activities(seq, line), 5 links(score, line),
    4 macros(id, line) and 4 pairs(n, line); each part is a top list."""
    parts = [
        ("hub", hubs_.withColumn("line", F.concat("path", F.lit(" (imported by "), F.col("n").cast("string"), F.lit(")"))), [F.desc("n"), "path"], 6),
        ("activity", activities, [F.desc("seq"), "line"], 5), ("link", links, [F.desc("score"), "line"], 5), ("macro", macros, ["id", "line"], 4), ("pair", pairs, [F.desc("n"), "line"], 4),
    ]
    out = None
    for part, rows, order, most in parts:
        top = rows.orderBy(*order).limit(most).withColumn("rank", F.row_number().over(Window.orderBy(*order)))
        top = top.select(F.lit(part).alias("part"), "rank", "line")
        out = top if out is None else out.union(top)
    return out
