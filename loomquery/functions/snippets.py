"""Scalar functions on snippets of text: boundaries, ranges, qualified names, common ends, brackets."""

from __future__ import annotations

import io
import re
import zipfile
import zlib

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

_ESCAPES = r"\x1B\[[0-9;?]*[ -/]*[@-~]"


def has_identifier(text: Column, name: str) -> Column:
    """True where the name stands in the text with no identifier character or ``$`` beside it."""
    edge = r"[\p{javaUnicodeIdentifierPart}$]"
    return text.rlike(f"(?<!{edge})" + re.sub(r"([^\w])", r"\\\1", name) + f"(?!{edge})")


def strip_ansi(text: Column) -> Column:
    return F.regexp_replace(text, _ESCAPES, "")


def numbered_lines(text: Column, start: int, end: int) -> Column:
    """Lines start to end, one-based and clamped, each after its number padded to four."""
    every = F.split(text, r"\r?\n")
    first = max(1, start)
    part = F.slice(every, first, F.greatest(F.least(F.size(every), F.lit(end)) - first + 1, F.lit(0)))
    return F.array_join(F.transform(part, lambda line, i: F.concat(F.lpad((i + first).cast("string"), 4, " "), F.lit(": "), line)), "\n")


def qualified_parts(name: Column) -> Column:
    """struct(parent, member): the first ``::`` counts as a dot; only the first two dotted parts are used."""
    parts = F.split(F.regexp_replace(name, "^(.*?)::", "$1."), r"\.")
    return F.when(F.size(parts) > 1, F.struct(parts[0].alias("parent"), parts[1].alias("member"))).otherwise(F.struct(F.lit(None).cast("string").alias("parent"), parts[0].alias("member")))


def read_target(target: Column, documents: tuple[str, ...] = ("md", "html", "xml", "txt", "docx", "pdf"), span: int = 40) -> Column:
    """struct(kind, path, symbol, first, last) of a target: @brief, file#symbol, file:line[-line], a document or a file."""
    lines = r"^(.+):(\d+)(?:-(\d+))?$"
    part = lambda i: F.regexp_extract(target, lines, i)
    symbol, ranged, doc = F.instr(target, "#") > 1, target.rlike(lines), F.lower(target).rlike(r"\.(" + "|".join(documents) + ")$")
    kind = F.when(target == "@brief", "brief").when(doc, "document").when(symbol, "symbol").when(ranged, "range").otherwise("file")
    is_ = lambda k: kind == k
    first = F.when(is_("range"), part(2).try_cast("int"))
    last = F.when(is_("range"), F.coalesce(part(3).try_cast("int"), first + span))
    path = F.when(is_("symbol"), F.substring_index(target, "#", 1)).when(is_("range"), part(1)).when(~is_("brief"), target)
    return F.struct(kind.alias("kind"), path.alias("path"), F.when(is_("symbol"), F.regexp_extract(target, "#(.*)$", 1)).alias("symbol"), first.alias("first"), last.alias("last"))


def identifier_candidates(text: Column) -> Column:
    """Distinct back-ticked spans, camel-case and snake-case names of four characters or more."""
    spans = F.regexp_extract_all(text, F.lit(r"`([^`\n]+)`"), F.lit(1))
    camel = F.regexp_extract_all(text, F.lit(r"\b[A-Za-z]*[a-z][A-Z][A-Za-z0-9]*\b"), F.lit(0))
    snake = F.regexp_extract_all(text, F.lit(r"\b[A-Za-z0-9]+_[A-Za-z0-9_]+\b"), F.lit(0))
    return F.array_distinct(F.concat(spans, F.filter(F.concat(camel, snake), lambda x: F.length(x) >= 4)))


def import_specs(content: Column) -> Column:
    """Distinct module names that a source imports: quoted, dynamic, grouped and namespace forms."""
    found = lambda pattern: F.regexp_extract_all(content, F.lit(pattern), F.lit(1))
    grouped = F.flatten(F.transform(found(r"(?s)\bimport\s*\(\s*\n(.*?)\)"), lambda b: F.regexp_extract_all(b, F.lit('"([^"]+)"'), F.lit(1))))
    every = F.concat(found(r"""\bfrom\s+['"]([^'"]+)['"]"""), found(r"""\bimport\s+['"]([^'"]+)['"]"""), found(r"""\b(?:import|require)\s*\(\s*['"]([^'"]+)['"]"""), grouped, found(r"(?m)^\s*using\s+([A-Za-z_][A-Za-z0-9_.]*)\s*;"))
    return F.array_distinct(F.filter(F.transform(every, lambda x: F.trim(x)), lambda x: x != ""))


def common_prefix(a: Column, b: Column) -> Column:
    """Number of leading characters that both texts share."""
    same = F.zip_with(F.split(a, ""), F.split(b, ""), lambda x, y: F.coalesce(x == y, F.lit(False)))
    end = F.array_position(same, False)
    return F.when((F.length(a) == 0) | (F.length(b) == 0), 0).when(end == 0, F.size(same)).otherwise(end - 1).cast("int")


def text_delta(old: Column, new: Column) -> Column:
    """struct(prefix, suffix, removed, added): the span between the common ends of two texts."""
    p = common_prefix(old, new)
    rest = lambda t: F.substring(t, p + 1, F.length(t))
    s = common_prefix(F.reverse(rest(old)), F.reverse(rest(new)))
    middle = lambda t: F.substring(t, p + 1, F.length(t) - p - s)
    return F.struct(p.alias("prefix"), s.alias("suffix"), middle(old).alias("removed"), middle(new).alias("added"))


def imbalance(source: str | None) -> str | None:
    """First bracket that does not match, as ``line:bracket``; strings and comments are blanked before."""
    pairs, open_ = {")": "(", "]": "[", "}": "{"}, []
    blank = lambda m: re.sub(r"[^\n]", " ", m.group())
    text = re.sub(r"""//[^\n]*|/\*.*?\*/|"(?:\\.|[^"\\\n])*"|'(?:\\.|[^'\\\n])*'|`(?:\\.|[^`\\])*`""", blank, source or "", flags=re.S)
    line = 1
    for c in text:
        if c == "\n":
            line += 1
        elif c in "([{":
            open_.append((c, line))
        elif c in pairs and (not open_ or open_.pop()[0] != pairs[c]):
            return f"{line}:{c}"
    return f"{open_[-1][1]}:{open_[-1][0]}" if open_ else None


def docx_text(raw: bytes | None) -> str | None:
    """Text of a word-processor archive, one line a paragraph; null where it is no such archive."""
    try:
        with zipfile.ZipFile(io.BytesIO(raw or b"")) as z:
            xml = z.read("word/document.xml").decode("utf-8", "replace")
    except (zipfile.BadZipFile, KeyError):
        return None
    text = re.sub(r"<[^>]+>", "", re.sub(r"<w:(?:br|tab)[^>]*/>", " ", re.sub(r"</w:p>", "\n", xml)))
    for name, sign in (("lt", "<"), ("gt", ">"), ("quot", '"'), ("apos", "'"), ("amp", "&")):
        text = text.replace(f"&{name};", sign)
    return text.strip()


def bracket_imbalance(source: Column) -> Column:
    return F.pandas_udf(lambda s: s.map(imbalance), "string")(source)


def docx(content: Column) -> Column:
    return F.pandas_udf(lambda s: s.map(docx_text), "string")(content)


def normal_instruction(text: Column, stop_words: list[str]) -> Column:
    """Words of an instruction after compatibility composition, lower-cased, CJK by character, without stop words."""
    stop = set(stop_words)

    def words(s: pd.Series) -> pd.Series:
        import unicodedata

        split = lambda t: [w for w in re.findall(r"[一-鿿]|[^\W_一-鿿]+", unicodedata.normalize("NFKC", t or "").lower()) if w not in stop]
        return s.map(split)

    return F.pandas_udf(words, "array<string>")(text)


def pdf_text(raw: bytes | None) -> str | None:
    """Text shown by a page-description file, one line a text block, packed streams included; null for other content."""
    if not raw or not raw.startswith(b"%PDF"):
        return None
    chunks = [raw.decode("latin-1")]
    for m in re.finditer(rb"stream\r?\n?(.*?)endstream", raw, re.S):
        try:
            chunks.append(zlib.decompressobj().decompress(m[1]).decode("utf-8", "replace"))
        except zlib.error:
            continue
    lines, text = [], r"\(((?:[^()\\]|\\.)*)\)"
    for chunk in chunks:
        for block in re.findall(r"\bBT\s(.*?)\sET\b", chunk, re.S):
            shown = re.findall(rf"{text}\s*Tj", block, re.S)
            for group in re.findall(rf"\[((?:[^\[\]()]|{text})*)\]\s*TJ", block, re.S):
                shown += re.findall(text, group[0], re.S)
            line = " ".join(re.sub(r"\\([()\\])", r"\1", s) for s in shown).strip()
            if line:
                lines.append(line)
    return "\n".join(lines)


def pdf(content: Column) -> Column:
    return F.pandas_udf(lambda s: s.map(pdf_text), "string")(content)
