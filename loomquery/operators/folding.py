"""Folding of texts: sections, heads and tails, blank runs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomquery.functions import text as T


def lines(df: DataFrame, key: str, text: str) -> DataFrame:
    return df.select(F.col(key).alias("key"), F.posexplode(F.split(F.col(text), r"\r?\n")).alias("no", "line"))


def headings(pages: DataFrame, key: str, html: str) -> DataFrame:
    """(key, n, level, title) of h1 to h4 headings, in order."""
    found = F.regexp_extract_all(F.col(html), F.lit(r"(?is)<h[1-4][^>]*>.*?</h[1-4]>"), F.lit(0))
    rows = pages.select(F.col(key).alias("key"), F.posexplode(found).alias("n", "raw"))
    return rows.select("key", "n", F.regexp_extract("raw", r"(?i)^<h([1-4])", 1).cast("int").alias("level"), T.decode_entities(T.strip_tags(F.col("raw"))).alias("title"))


def sections(rows: DataFrame, is_heading: Column) -> DataFrame:
    """Lines with the running number of the heading above them; 0 before the first."""
    w = Window.partitionBy("key").orderBy("no")
    return rows.withColumn("section", F.sum(F.when(is_heading, 1).otherwise(0)).over(w))


def head_tail(rows: DataFrame, most: int, head: int, tail: int) -> DataFrame:
    """All lines of texts of at most ``most`` lines, else the first and last ones; omitted counts the rest."""
    n = F.count("*").over(Window.partitionBy("key"))
    out = rows.withColumn("n", n).where((F.col("n") <= most) | (F.col("no") < head) | (F.col("no") >= F.col("n") - tail))
    return out.groupBy("key").agg(F.count("*").alias("shown"), (F.max("n") - F.count("*")).alias("omitted"))


def folded(text: Column, most: int, head: int, tail: int) -> Column:
    """A text of over ``most`` lines as its first and last ones, with the number of those left out between them."""
    rows = F.split(text, r"\r?\n")
    note = F.concat(F.lit("... "), (F.size(rows) - (head + tail)).cast("string"), F.lit(" lines"))
    short = F.concat(F.slice(rows, 1, head), F.array(note), F.slice(rows, -tail, tail))
    return F.when(F.size(rows) > most, F.array_join(short, "\n")).otherwise(text)


def squeeze_blanks(rows: DataFrame) -> DataFrame:
    """Runs of blank lines become one."""
    w = Window.partitionBy("key").orderBy("no")
    blank = F.trim("line") == ""
    return rows.withColumn("b", blank).where(~(F.col("b") & F.coalesce(F.lag(blank).over(w), F.lit(False)))).drop("b")


def budget_fit(rows: DataFrame, budget: int, head_share: float = 0.65) -> DataFrame:
    """Lines that fit a character budget, most of it from the start and the rest from the end."""
    up = F.sum(F.length("line") + 1).over(Window.partitionBy("key").orderBy("no"))
    down = F.sum(F.length("line") + 1).over(Window.partitionBy("key").orderBy(F.desc("no")))
    fit = rows.withColumns({"up": up, "down": down}).withColumn("keep", (F.col("up") <= int(budget * head_share)) | (F.col("down") <= budget - int(budget * head_share)))
    return fit.groupBy("key").agg(F.count_if("keep").alias("kept"), F.count_if(~F.col("keep")).alias("omitted"))


def code_skeleton(rows: DataFrame, symbols: DataFrame, expand: list[str] | None = None) -> DataFrame:
    """(key, skeleton) of lines(key, no, line), numbered from 0: bodies of functions over 4 lines and of types over 20 are
    folded into their first line, runs of blank lines become one. ``symbols(key, name, kind, first, last)`` count from 1.

    The outermost fold wins: a line belongs to the first fold that reaches it, found by a running maximum of ends.
    """
    span = F.col("last") - F.col("first") + 1
    types = F.col("kind").isin("interface", "type", "enum", "struct")
    long_ = (F.col("kind").isin("function", "method") & (span > 4)) | (types & (span > 20))
    folds = symbols.where(long_ & ~F.col("name").isin(expand or [])).groupBy("key", F.col("first").alias("n")).agg(F.max_by("last", "last").alias("last"), F.max_by(types, "last").alias("is_type"))
    marked = rows.select("key", (F.col("no") + 1).alias("n"), "line").join(folds, ["key", "n"], "left")
    before = Window.partitionBy("key").orderBy("n").rowsBetween(Window.unboundedPreceding, -1)
    shown = marked.withColumn("end", F.max("last").over(before)).where("end is null or n > end")
    blank = F.trim("line") == ""
    shown = shown.withColumn("again", blank & F.col("last").isNull() & F.coalesce(F.lag(blank & F.col("last").isNull()).over(Window.partitionBy("key").orderBy("n")), F.lit(False))).where("not again")
    note = F.concat(F.lit(" /* ... lines "), (F.col("n") + 1).cast("string"), F.lit("-"), F.col("last").cast("string"), F.lit(" folded"))
    count = F.concat(F.lit(" ("), (F.col("last") - F.col("n") + 1).cast("string"), F.lit(" lines) ... */ }"))
    opened = F.concat(F.rtrim("line"), F.when(F.col("is_type") | F.col("line").contains("{"), "").otherwise(" {"), note, F.when(F.col("is_type"), count).otherwise(F.lit(" ... */ }")))
    text = F.concat(F.lpad(F.col("n").cast("string"), 4, " "), F.lit(":"), F.when(F.col("last").isNotNull(), F.concat(F.lit(" "), opened)).when(blank, "").otherwise(F.concat(F.lit(" "), F.col("line"))))
    ordered = F.sort_array(F.collect_list(F.struct("n", text.alias("text"))))
    return shown.groupBy("key").agg(F.array_join(ordered["text"], "\n").alias("skeleton"))
