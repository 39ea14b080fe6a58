"""Decisions on edits, tests and workspaces, as grouped or joined conditions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Lines of step blocks that one task sorts, on average.
PLACE_LINES = 3_000_000


def recovery(files: DataFrame, journal: str, found: Column, before: Column, after: Column) -> DataFrame:
    """A journal is recoverable where each file equals its state before or after; those as after are restored."""
    rows = files.select(journal, F.coalesce(found.isin(before, after), F.lit(False)).alias("known"), F.coalesce(found == after, F.lit(False)).alias("changed"))
    out = rows.groupBy(journal).agg(F.bool_and("known").alias("recoverable"), F.count_if("changed").alias("n"))
    return out.select(journal, "recoverable", F.when(F.col("recoverable"), F.col("n")).otherwise(0).alias("to_restore"))


def receiver_partition(calls: DataFrame, file: str, ours: Column, foreign: Column) -> DataFrame:
    """drop: only foreign calls; conflict: both; keep: none foreign."""
    out = calls.groupBy(file).agg(F.count_if(ours).alias("ours"), F.count_if(foreign).alias("foreign"))
    decision = F.when(F.col("foreign") == 0, "keep").when(F.col("ours") == 0, "drop").otherwise("conflict")
    return out.select(file, "ours", "foreign", decision.alias("decision"))


def without_declarations(symbols: DataFrame, key: list[str], declaration_only: Column) -> DataFrame:
    """Symbols less the declarations whose key is defined too."""
    flagged = symbols.withColumn("__d", F.coalesce(declaration_only, F.lit(False)))
    defined = flagged.where(~F.col("__d")).select(*key).distinct().withColumn("__has", F.lit(True))
    return flagged.join(defined, key, "left").where(~F.col("__d") | F.col("__has").isNull()).drop("__d", "__has")


def proposal_status(proposals: DataFrame, current: DataFrame, key: str, base: str, digest: str, age: Column, most: int) -> DataFrame:
    """expired by age, else missing or rejected where the present digest is not the recorded one, else applicable."""
    rows = proposals.join(current.select(key, F.col(digest).alias("__now")), key, "left")
    status = F.when(age > most, "expired").when(F.col("__now").isNull(), "missing").when(F.col("__now") != F.col(base), "rejected").otherwise("applicable")
    return rows.select(key, status.alias("status"))


def command_groups(tests: DataFrame, group: str, directory: str, prefix: Column) -> DataFrame:
    """One command a group with its distinct directories in order."""
    rows = tests.select(group, directory).distinct().groupBy(group).agg(F.array_sort(F.collect_list(directory)).alias("d"))
    return rows.select(group, F.concat_ws(" ", prefix, F.array_join("d", " ")).alias("command"))


def ranked_candidates(candidates: DataFrame, path: str, priority: str, newest: str) -> DataFrame:
    """Distinct paths by their best priority, then the newest first; the order is a global sort, ranks are left to the reader."""
    best = candidates.groupBy(path).agg(F.min(F.struct(F.col(priority), (-F.unix_micros(F.col(newest).cast("timestamp"))).alias("t"))).alias("b"))
    return best.select(path, F.col(f"b.{priority}").alias(priority), (-F.col("b.t")).alias("newest_us")).orderBy(priority, F.desc("newest_us"), path)


def ancestors(path: Column, most: int = 10) -> Column:
    """The folders above a path, the nearest first."""
    parts = F.split(path, "/")
    up = F.sequence(F.lit(1), F.least(F.size(parts) - 1, F.lit(most)))
    return F.when(F.size(parts) > 1, F.transform(up, lambda k: F.array_join(F.slice(parts, F.lit(1), F.size(parts) - k), "/")))


def nearest_root(paths: DataFrame, path: str, markers: DataFrame, folder: str) -> DataFrame:
    """(path, root): the nearest folder above that has a marker; null without one."""
    rows = paths.select(path, F.posexplode(ancestors(F.col(path))).alias("up", folder))
    near = rows.join(markers.select(folder).distinct(), folder, "left_semi").groupBy(path).agg(F.min_by(folder, "up").alias("root"))
    return paths.select(path).distinct().join(near, path, "left")


def salient_lines(rows: DataFrame, is_error: Column, most: int = 35, head: int = 8, tail: int = 12) -> DataFrame:
    """Error lines and the line after each, ``most`` at most; texts without any keep their first and last lines.

    A line taken as the one after an error does not take another, so only runs of an odd length take the line after them.
    """
    w = Window.partitionBy("key").orderBy("no")
    rows = rows.withColumn("e", is_error).withColumn("run", F.sum((~F.col("e")).cast("int")).over(w))
    rows = rows.withColumn("at", F.sum(F.col("e").cast("int")).over(Window.partitionBy("key", "run").orderBy("no")))
    rows = rows.withColumn("keep", F.col("e") | F.coalesce(F.lag("at").over(w) % 2 == 1, F.lit(False)))
    whole = Window.partitionBy("key")
    rows = rows.withColumns({"rank": F.sum(F.col("keep").cast("int")).over(w), "any": F.max("e").over(whole), "n": F.count("*").over(whole)})
    ends = (F.col("no") < head) | (F.col("no") >= F.col("n") - tail)
    return rows.where(F.when(F.col("any"), F.col("keep") & (F.col("rank") <= most)).otherwise(ends)).select("key", "no", "line")


def apply_patches(rows: DataFrame, patches: DataFrame) -> DataFrame:
    """(key, text) after all patches(key, first, last, text), whose line numbers are those of the original lines(key, no, line)."""
    gone = rows.join(patches.select("key", "first", "last"), (rows.key == patches.key) & rows.no.between(F.col("first"), F.col("last")), "left_anti")
    new = patches.select("key", F.col("first").alias("no"), F.col("text").alias("line"))
    return gone.select("key", "no", "line").union(new).groupBy("key").agg(F.array_sort(F.collect_list(F.struct("no", "line"))).alias("l")).select("key", F.array_join(F.col("l.line"), "\n").alias("text"))


def live_activities(activities: DataFrame, files: DataFrame, key: str, file: str) -> DataFrame:
    """Activities that name no file, or a file that still exists."""
    known = activities.select(key, file).join(files.select(file, F.lit(True).alias("live")).distinct(), file, "left")
    return known.groupBy(key).agg(F.count(file).alias("n_files"), F.count_if(F.coalesce("live", F.lit(False))).alias("n_live")).where("n_files = 0 or n_live > 0")


def read_policy(rows: DataFrame, n_lines: Column, bounded: Column, most: int = 250) -> DataFrame:
    """allow bounded and short reads, fold the others."""
    return rows.withColumn("policy", F.when(bounded | (n_lines <= most), "allow").otherwise("fold"))


def archive(rows: DataFrame, text: Column, least: int = 400) -> DataFrame:
    """Outputs of ``least`` characters or more with the handle by which they are recalled."""
    return rows.where(F.length(text) >= least).withColumn("handle", F.substring(F.sha2(text, 256), 1, 12))


def dictionary(rows: DataFrame, key: str, meaning: str, order: str, vocabulary: DataFrame, most: int = 4) -> DataFrame:
    """The first ``most`` distinct meanings of each key of the vocabulary."""
    first = rows.join(vocabulary, key, "left_semi").groupBy(key, meaning).agg(F.min(order).alias("at"))
    rank = F.row_number().over(Window.partitionBy(key).orderBy("at", meaning))
    return first.withColumn("rank", rank).where(F.col("rank") <= most).select(key, meaning, "rank")


def triggers(prompts: DataFrame, prompt: str, macros: DataFrame, phrase: str, macro: str, uses: str) -> DataFrame:
    """(prompt, macro): the most used macro of the prompt's phrase, without case and closing punctuation."""
    plain = lambda c: F.regexp_replace(F.trim(F.lower(F.col(c))), r"[\s.!?,;:]+$", "")
    best = macros.groupBy(plain(phrase).alias("__p")).agg(F.min_by(macro, F.struct(-F.col(uses), F.col(macro))).alias("macro"))
    return prompts.withColumn("__p", plain(prompt)).join(best, "__p").select(prompt, "macro")


def step_blocks(rows: DataFrame) -> DataFrame:
    """(key, step, header, exit_line, output, extra) of step headers in lines(key, no, line).

    Output ends at the first exit line; what follows it, blank lines aside, is extra, as is what comes before the first
    header (step 0). The last exit line of a block counts. Empty lines around the output go. Lines that lie by key already
    are not shuffled; they are sorted once, and what is done is told by a block's first exit line.
    """
    head, ends = F.col("line").startswith("## step "), F.col("line").rlike(r"^\[exit=-?\d+\]$")
    rows = rows.withColumns({"h": head, "x": ends, "step": F.sum(head.cast("int")).over(Window.partitionBy("key").orderBy("no"))})
    last = F.max_by("line", F.when(F.col("x") & (F.col("step") > 0), F.col("no")))
    blocks = rows.groupBy("key", "step").agg(
        F.max_by("line", F.when(F.col("h"), F.col("no"))).alias("header"), F.coalesce(last, F.lit("")).alias("exit_line"),
        F.min(F.when(F.col("x"), F.struct("no"))).alias("first"), F.array_sort(F.collect_list(F.when(~F.col("h"), F.struct("no", "line", "x")))).alias("lines"),
    )
    done = lambda r: F.coalesce(F.struct(r["no"]) >= F.col("first"), F.lit(False))
    output = F.filter("lines", lambda r: (F.col("step") > 0) & ~done(r))
    late = F.filter("lines", lambda r: (F.trim(r["line"]) != "") & ((F.col("step") == 0) | done(r) & ~r["x"]))
    out = blocks.select("key", "step", "header", "exit_line", F.regexp_replace(F.array_join(output["line"], "\n"), r"^\n+|\n+$", "").alias("output"), F.array_join(late["line"], "\n").alias("extra"))
    return out.where("step > 0 or extra <> ''")


def rename_impact(symbols: DataFrame, imports: DataFrame, resolved: DataFrame, path: str, name: str) -> DataFrame:
    """(path) of all files that a renamed symbol touches: its own, importers by name and proven callers."""
    own = symbols.where((F.col("path") == path) & (F.col("name") == name)).select("path")
    named = imports.where((F.col("target") == path) & F.array_contains("names", name)).select("path")
    used = resolved.where((F.col("target_path") == path) & (F.col("callee") == name) & (F.col("confidence") >= 0.75)).select("path")
    return own.union(named).union(used).distinct()


def rename_conflicts(impact: DataFrame, symbols: DataFrame, allowed: DataFrame, new_name: str) -> DataFrame:
    """Touched files that declare the new name already, less the allowed declarations (path, name)."""
    declared = symbols.where(F.col("name") == new_name).select("path", "name").distinct()
    return declared.join(impact, "path", "left_semi").join(allowed, ["path", "name"], "left_anti")
