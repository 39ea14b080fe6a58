"""Readers of source trees, journals and logs."""

from __future__ import annotations

import ast
import json
import posixpath
import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.functions import udtf

from loomquery.functions import text as T
from loomquery.sources.journal import parsed

#: Larger files are not read.
MAX_FILE_BYTES = 2 << 20


def read_files(spark: SparkSession, root: str, pattern: str = "*", max_bytes: int = MAX_FILE_BYTES) -> DataFrame:
    """(path, content, size, mtime_ms) of the text files under a folder, state and generated folders and large files left out."""
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", pattern).load(root).where(F.col("length") <= max_bytes)
    rows = raw.select(F.col("path"), F.decode("content", "UTF-8").alias("content"), F.col("length").alias("size"), (F.unix_millis("modificationTime")).cast("double").alias("mtime_ms"))
    base = re.sub(r"^file:/*", "/", root).rstrip("/")
    inside = F.regexp_replace(F.regexp_replace("path", "^file:/*", "/"), "^" + re.escape(base) + "/", "")
    return rows.where(T.is_trackable(inside))


def append_json_lines(df: DataFrame, path: str) -> None:
    """Appends the rows of a table to a JSON-lines log."""
    df.write.mode("append").option("ignoreNullFields", "false").json(path)


def export_graph(nodes: DataFrame, edges: DataFrame, path: str) -> None:
    """Writes a graph's nodes and edges as JSON lines, sorted, for viewers."""
    nodes.orderBy("id").write.mode("overwrite").json(f"{path}/nodes")
    edges.orderBy("kind", "source", "target").write.mode("overwrite").json(f"{path}/edges")


def read_journal(spark: SparkSession, path: str) -> DataFrame:
    """(raw, value, ok) of a JSON-lines log; lines that are no JSON object are kept with ok = false."""
    return parsed(spark.read.text(path).where("trim(value) <> ''").select(F.col("value").alias("raw")))


def parse_log(spark: SparkSession, path: str) -> DataFrame:
    """(commit_id, file) of ``git log --name-only`` output with ``commit <id>`` headers, read as whole commits."""
    blocks = spark.read.option("lineSep", "\ncommit ").text(path)
    parts = F.split(F.regexp_replace("value", r"^commit ", ""), r"\r?\n")
    files = F.filter(F.slice(parts, 2, 1 << 20), lambda x: F.trim(x) != "")
    return blocks.select(F.trim(parts[0]).alias("commit_id"), F.explode(files).alias("file"))


def porcelain_paths(raw):
    """Changed paths of ``git status --porcelain -z`` output; of a rename, the new one."""
    entries = F.split(raw, "\u0000")
    kept = F.filter(entries, lambda e: F.length(e) > 3)
    return F.transform(F.filter(kept, lambda e: e.rlike(r"^[ MADRCU?!]{2} ")), lambda e: F.substring(e, 4, 1 << 20))


def strip_json_comments(text):
    """JSON with // and block comments outside strings removed."""
    return F.regexp_replace(text, r'("(?:\\.|[^"\\])*")|//[^\n]*|/\*(?s:.*?)\*/', "$1")


@udtf(returnType="name string, kind string, line int, end_line int, params_count int, parent_class string, ordinal int")
class PythonSymbols:
    """Functions and classes of a Python source text; none if it does not parse."""

    def eval(self, content: str):
        try:
            tree = ast.parse(content or "")
        except (SyntaxError, ValueError):
            return
        n = 0
        stack = [(tree, None)]
        while stack:
            node, owner = stack.pop(0)
            for child in getattr(node, "body", []):
                if isinstance(child, (ast.FunctionDef, ast.AsyncFunctionDef)):
                    yield child.name, "method" if owner else "function", child.lineno, child.end_lineno, len(child.args.args), owner, n
                    n += 1
                elif isinstance(child, ast.ClassDef):
                    yield child.name, "class", child.lineno, child.end_lineno, 0, None, n
                    n += 1
                    stack.append((child, child.name))


@udtf(returnType="callee string, line int, args_count int, receiver string")
class PythonCalls:
    """Call sites of a Python source text."""

    def eval(self, content: str):
        try:
            tree = ast.parse(content or "")
        except (SyntaxError, ValueError):
            return
        for node in ast.walk(tree):
            if isinstance(node, ast.Call):
                if isinstance(node.func, ast.Name):
                    yield node.func.id, node.lineno, len(node.args), None
                elif isinstance(node.func, ast.Attribute):
                    yield node.func.attr, node.lineno, len(node.args), node.func.value.id if isinstance(node.func.value, ast.Name) else None


def load_aliases(spark: SparkSession, path: str, depth: int = 8) -> list[tuple[str, list[str]]]:
    """Alias patterns of a compiler configuration for ``resolve_aliases``; what it extends is read where it has none itself.

    Comments and trailing commas are allowed. Targets are joined to ``baseUrl``, relative to the file that sets them.
    """
    for _ in range(depth):
        raw = spark.read.text(path, wholetext=True).select(strip_json_comments(F.col("value"))).first()[0]
        config = json.loads(re.sub(r",(\s*[}\]])", r"\1", raw))
        options = config.get("compilerOptions", {})
        if "paths" in options:
            base = posixpath.normpath(options.get("baseUrl", "."))
            return [(pattern, [posixpath.normpath(posixpath.join(base, t)) for t in targets]) for pattern, targets in options["paths"].items()]
        parent = config.get("extends")
        if not isinstance(parent, str) or not parent.startswith("."):
            return []
        path = posixpath.normpath(posixpath.join(posixpath.dirname(path), parent))
        path += "" if path.endswith(".json") else ".json"
    return []
