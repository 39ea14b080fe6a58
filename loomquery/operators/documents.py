"""Development documents: which of a tree count, and their sections."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from loomquery.functions import text as T

# Endings of documents by format, folders that hold none, and limits of a scan and of a summary.
FORMATS = {"md": ["md", "markdown"], "html": ["html", "htm"], "xml": ["xml"], "docx": ["docx"], "pdf": ["pdf"]}
IGNORED = ["node_modules", ".git", "dist", "build", "coverage", "vendor", "third_party", "target"]
MOST_DOCUMENTS, MOST_DEPTH, MOST_BYTES, SUMMARY = 200, 6, 5_000_000, 220


def format_of(path: Column) -> Column:
    """Format of a document by its ending, null for other files."""
    ending = F.lower(F.regexp_extract(path, r"\.([^./]+)$", 1))
    out = F.lit(None).cast("string")
    for name, endings in FORMATS.items():
        out = F.when(ending.isin(endings), name).otherwise(out)
    return out


def listed(files: DataFrame, nested: DataFrame | None = None, most: int | None = MOST_DOCUMENTS) -> DataFrame:
    """Documents among ``files(path, size)``, paths being relative: by ending, depth and size, none in hidden or ignored folders or in those
    of ``nested(folder)``, other repositories inside this one. The first ``most`` by path; None lists all."""
    parts = F.split("path", "/")
    folders = F.slice(parts, 1, F.size(parts) - 1)
    fine = format_of(F.col("path")).isNotNull() & (F.size(folders) <= MOST_DEPTH) & (F.col("size") <= MOST_BYTES) & ~F.exists(parts, lambda p: p.startswith(".")) & ~F.arrays_overlap(folders, F.array(*map(F.lit, IGNORED)))
    rows = files.where(fine)
    if nested is not None:
        above = F.transform(F.sequence(F.lit(1), F.size(folders)), lambda n: F.array_join(F.slice(folders, 1, n), "/"))
        inside = rows.where(F.size(folders) > 0).select("path", F.explode(above).alias("folder")).join(nested.select("folder"), "folder", "left_semi").select("path").distinct()
        rows = rows.join(inside, "path", "left_anti")
    return rows if most is None else rows.orderBy("path").limit(most)


def scan(spark: SparkSession, root: str, most: int | None = MOST_DOCUMENTS) -> DataFrame:
    """(path, format, size, content) of the documents below a folder; contents are read of those that count only.

    Folders with a ``.git`` of their own are other repositories; they are found by their names alone.
    """
    base = re.sub(r"^file:/*", "/", root).rstrip("/")
    inside = lambda c: F.regexp_replace(F.regexp_replace(c, "^file:/*", "/"), "^" + re.escape(base) + "/", "")
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
    jvm = spark.sparkContext._jvm
    store = jvm.org.apache.hadoop.fs.Path(root).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    found = [s.getPath().getParent().toUri().getPath() for n in range(1, MOST_DEPTH + 1) for s in store.globStatus(jvm.org.apache.hadoop.fs.Path(root.rstrip("/") + "/*" * n + "/.git")) or []]
    nested = spark.createDataFrame([(p[len(base) + 1 :],) for p in found], "folder string")
    few = listed(raw.select(inside("path").alias("path"), F.col("length").alias("size")), nested, most)
    rows = raw.select(inside("path").alias("path"), F.decode("content", "UTF-8").alias("content")).join(few, "path")
    return rows.select("path", format_of(F.col("path")).alias("format"), "size", "content")


def marked_text(format_: Column, content: Column) -> Column:
    """A document's text with ``#`` before its headings: those of HTML, and in XML the names that elements carry."""
    html = F.regexp_replace(content, r"(?is)<(script|style)\b[^>]*>.*?</\1>", "")
    html = F.regexp_replace(html, r"(?is)<h[1-4]\b[^>]*>(.*?)</h[1-4]>", "\n# $1\n")
    html = T.decode_entities(F.regexp_replace(html, "<[^>]+>", " "))
    named = r'(?i)<([a-z0-9_:-]+)\b[^>]*\b(?:name|id|key|symbol)="([^"]+)"'
    head = lambda line: F.when(line.rlike(named), F.concat(F.lit("# "), F.regexp_extract(line, named, 1), F.lit(": "), F.regexp_extract(line, named, 2)))
    rest = lambda line: F.nullif(T.decode_entities(F.trim(F.regexp_replace(line, "<[^>]+>", " "))), F.lit(""))
    xml = F.array_join(F.flatten(F.transform(F.split(content, r"\r?\n"), lambda line: F.array_compact(F.array(head(line), rest(line))))), "\n")
    return F.when(format_ == "html", html).when(format_ == "xml", xml).otherwise(content)


def sections(documents: DataFrame, fences: bool = False) -> DataFrame:
    """(path, format, n, title, start_line, end_line, summary, text) of ``documents(path, format, content)``; blank documents have none.

    A heading of up to four ``#`` begins a section, which reaches to the line before the next one; headings without a line of their own are
    passed over. Lines before the first heading are titled by the file's name. A document of headings alone is one section, of the last.
    ``fences``: a ``#`` between code fences is no heading. The lines of a document are one group, documents being bounded in bytes.
    """
    blank = F.regexp_replace("body", r"\s+", "") == ""
    docs = documents.select("path", "format", marked_text(F.col("format"), F.col("content")).alias("body")).where(~blank)
    rows = docs.select("path", "format", F.posexplode(F.split("body", r"\r?\n")).alias("no", "line"))
    by_line = Window.partitionBy("path", "format").orderBy("no")
    heading = F.col("line").rlike(r"^#{1,4}\s+.")
    if fences:
        rows = rows.withColumn("fence", F.sum(F.col("line").rlike(r"^\s*(```|~~~)").cast("int")).over(by_line))
        heading = heading & (F.col("fence") % 2 == 0)
    trimmed = F.regexp_replace("line", r"^\s+|\s+$", "")
    rows = rows.withColumn("heading", heading).withColumn("n", F.sum(F.col("heading").cast("int")).over(by_line))
    lines = F.transform(F.array_sort(F.collect_list(F.when(~F.col("heading") & (trimmed != ""), F.struct("no", trimmed.alias("line"))))), lambda x: x.line)
    title = F.max(F.when(F.col("heading"), F.regexp_replace(F.regexp_extract("line", r"^#{1,4}\s+(.+)$", 1), r"\s+$", "")))
    found = rows.groupBy("path", "format", "n").agg(title.alias("title"), (F.min("no") + 1).alias("first"), (F.max("no") + 1).alias("last"), F.array_join(lines, "\n").alias("body"))
    of_doc = Window.partitionBy("path", "format")
    found = found.withColumns({"some": F.max((F.col("body") != "").cast("int")).over(of_doc), "final": F.max("n").over(of_doc)})
    kept = found.where((F.col("body") != "") | ((F.col("some") == 0) & (F.col("n") == F.col("final"))))
    name = F.coalesce("title", F.regexp_extract("path", r"([^/]*)$", 1))
    summary = F.substring(F.regexp_replace("body", r"\s+", " "), 1, SUMMARY)
    return kept.select("path", "format", F.row_number().over(Window.partitionBy("path", "format").orderBy("n")).alias("n"), name.alias("title"), F.when(F.col("n") == 0, 1).otherwise(F.col("first")).alias("start_line"), F.col("last").alias("end_line"), summary.alias("summary"), F.concat_ws("\n", name, "body").alias("text"))
