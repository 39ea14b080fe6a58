"""Symbols and calls of brace languages, found by declaration patterns on text whose strings and comments are blanked.

One pass over a file pairs its brackets; a declaration reaches to the bracket that closes its body, and belongs to the
innermost type around it. There is no full grammar: regular expressions of JavaScript are not told from divisions, and
declarations built by macros or preprocessors are not seen.
"""

from __future__ import annotations

import re
from bisect import bisect_right

from pyspark.sql.functions import udtf

_NAME = r"([A-Za-z_$][\w$]*)"
_TEXTS = r'//[^\n]*|/\*.*?(?:\*/|\Z)|"(?:\\.|[^"\\\n])*"|'
_BLANK = {
    "js": re.compile(_TEXTS + r"'(?:\\.|[^'\\\n])*'|`(?:\\.|[^`\\])*`", re.S),
    "go": re.compile(_TEXTS + r"'(?:\\.|[^'\\\n])+'|`[^`]*`", re.S),
    "rust": re.compile(_TEXTS + r"'(?:\\.[^']*|[^'\\\n])'", re.S),
    "c": re.compile(_TEXTS + r"'(?:\\.|[^'\\\n])*'", re.S),
    "csharp": re.compile(r'@"(?:""|[^"])*"|' + _TEXTS + r"'(?:\\.|[^'\\\n])*'", re.S),
}
# (kind, pattern); groups: out (the mark of an exported one), owner, name. The kind None takes the word found as kind.
_MODIFIERS = r"(?:(?:private|protected|internal|static|async|abstract|override|virtual|sealed|readonly|partial|unsafe|extern|new)\s+)*"
_RULES = {
    "js": [
        (None, rf"(?P<out>export\s+)?(?:default\s+)?(?:declare\s+)?(?:abstract\s+)?(?P<kind>class|interface|enum)\s+(?P<name>{_NAME})"),
        ("type", rf"(?P<out>export\s+)?type\s+(?P<name>{_NAME})\s*(?:<[^=]*>)?="),
        ("function", rf"(?P<out>export\s+)?(?:default\s+)?(?:async\s+)?function\s*\*?\s*(?P<name>{_NAME})\s*(?:<[^(]*>)?\("),
        ("function", rf"(?P<out>export\s+)?(?:const|let|var)\s+(?P<name>{_NAME})\s*(?::[^=\n]+)?=\s*(?:async\s+)?(?:function\b|\([^()]*\)\s*(?::[^=\n]+)?=>|{_NAME}\s*=>)"),
        ("method", rf"(?:(?:public|private|protected|static|async|override|readonly|get|set)\s+)*\*?\s*(?P<name>#?{_NAME})\s*(?:<[^(\n]*>)?\("),
    ],
    "go": [
        (None, rf"type\s+(?P<name>{_NAME})(?:\[[^\]]*\])?\s+(?P<kind>struct|interface)\b"),
        ("function", rf"func\s+(?:\(\s*(?:\w+\s+)?\*?(?P<owner>\w+)[^)]*\)\s*)?(?P<name>{_NAME})\s*[\[(]"),
    ],
    "rust": [
        (None, rf"(?P<out>pub(?:\([^)]*\))?\s+)?(?P<kind>struct|enum|trait)\s+(?P<name>{_NAME})"),
        ("impl", rf"(?:unsafe\s+)?impl\b(?:\s*<[^>]*>)?\s*(?:[^{{;]*?\bfor\s+)?(?P<name>{_NAME})"),
        ("function", rf"(?P<out>pub(?:\([^)]*\))?\s+)?(?:(?:async|const|unsafe|extern)\s+)*fn\s+(?P<name>{_NAME})"),
    ],
    "c": [
        (None, rf"(?:typedef\s+)?(?P<kind>class|struct|enum)\s+(?:class\s+)?(?P<name>{_NAME})[^;(){{}}]*\{{"),
        ("function", rf"(?:[\w:<>,*&~\[\]]+\s+[*&]*)+(?:(?P<owner>\w+)::)?(?P<name>~?{_NAME})\s*\("),
    ],
    "csharp": [
        (None, rf"(?P<out>public\s+)?{_MODIFIERS}(?P<kind>class|interface|struct|enum|record)\s+(?P<name>{_NAME})"),
        ("method", rf"(?P<out>public\s+)?{_MODIFIERS}(?:[\w<>\[\],.?]+\s+)?(?P<name>{_NAME})\s*(?:<[^(]*>)?\("),
    ],
}
# What follows the closing parenthesis of a declaration, where its head alone does not tell it from a call.
_FOLLOWS = {
    ("js", "method"): re.compile(r"\s*(?::[^;{}=]+)?\{"),
    ("c", "function"): re.compile(r"(?:\s|const\b|noexcept\b|override\b)*\{"),
    ("csharp", "method"): re.compile(r"\s*(?:where[^{;]*)?(?:\{|=>)"),
}
_COMPILED = {family: [(kind, re.compile(r"(?:^|(?<=[{};]))[ \t]*" + rule, re.M)) for kind, rule in rules] for family, rules in _RULES.items()}
_EXTENSIONS = {"js": "ts tsx js jsx mjs cjs", "go": "go", "rust": "rs", "c": "c h cc cpp hpp cxx hxx", "csharp": "cs"}
_FAMILY = {ext: family for family, exts in _EXTENSIONS.items() for ext in exts.split()}
# Words before a parenthesis that call nothing.
NO_CALL = set("if for while switch catch return sizeof alignof typeof delete new throw case match loop where lock using fixed checked unchecked nameof default function func fn await else do in of".split())
_TYPES = {"class", "interface", "struct", "enum", "record", "trait", "impl"}


def family_of(path: str | None) -> str | None:
    return _FAMILY.get((path or "").rsplit(".", 1)[-1].lower())


def blanked(content: str, family: str) -> str:
    """The text with comments and what strings hold as spaces; quotes, lines and positions stay."""
    space = lambda x: re.sub(r"[^\n]", " ", x)
    return _BLANK[family].sub(lambda m: space(m[0]) if m[0][0] == "/" else m[0][0] + space(m[0][1:-1]) + m[0][-1], content)


def brackets(text: str) -> dict[int, int]:
    """Position of each opening bracket to that of its closing one; unmatched ones are left out."""
    pairs, open_ = {}, []
    for m in re.finditer(r"[()\[\]{}]", text):
        if m[0] in "([{":
            open_.append(m.start())
        else:
            want = "([{"[")]}".index(m[0])]
            while open_ and text[open_[-1]] != want:
                open_.pop()
            if open_:
                pairs[open_.pop()] = m.start()
    return pairs


def _arguments(text: str, pairs: dict[int, int], at: int) -> int:
    """Top-level items between a parenthesis and its end; brackets inside are jumped over."""
    end, i, n, some = pairs.get(at, at), at + 1, 0, False
    while i < end:
        if i in pairs:
            some, i = True, pairs[i] + 1
            continue
        if text[i] == ",":
            n, some = n + some, False
        elif not text[i].isspace():
            some = True
        i += 1
    return n + some


def symbols_of(path: str | None, content: str | None) -> list[tuple]:
    """(name, kind, exported, first, last, params, parent) in the order of lines; nothing for other languages."""
    family = family_of(path)
    if family is None or not content:
        return []
    text = blanked(content, family)
    pairs, starts = brackets(text), [0, *(m.end() for m in re.finditer("\n", text))]
    found, seen = [], set()
    for kind, rule in _COMPILED[family]:
        for m in rule.finditer(text):
            name, groups = m["name"], m.groupdict()
            if name in NO_CALL or m.start("name") in seen:
                continue
            if kind == "method" and re.match(r"\s*(?:return|else|await|throw|new)\b", m[0]):
                continue
            paren = text.find("(", m.end("name")) if kind in ("function", "method") else -1
            follow = _FOLLOWS.get((family, kind))
            if follow and (paren not in pairs or not follow.match(text, pairs[paren] + 1)):
                continue
            seen.add(m.start("name"))
            stop = re.compile(r"[{;]").search(text, pairs.get(paren, m.end("name")))
            end = pairs.get(stop.start(), m.end()) if stop and stop[0] == "{" else m.end()
            if family == "go":
                out = name[0].isupper()
            else:
                out = family == "c" or groups.get("out") is not None
            found.append([m.start("name"), end, name, groups.get("kind") or kind, out, _arguments(text, pairs, paren) if paren >= 0 else 0, groups.get("owner")])
    found.sort(key=lambda f: (f[0], -f[1]))
    line = lambda pos: bisect_right(starts, pos)
    rows, around = [], []
    for at, end, name, kind, out, params, owner in found:
        while around and around[-1][0] < at:
            around.pop()
        parent = owner or (around[-1][1] if around else None)
        if kind in _TYPES:
            around.append((end, name))
        if kind == "impl" or (kind == "method" and family == "js" and parent is None):
            continue
        kind = "method" if kind == "function" and parent and family in ("go", "rust", "c") else kind
        rows.append((name, kind, out, line(at), line(end), params, parent if kind == "method" else None))
    return rows


def calls_of(path: str | None, content: str | None) -> list[tuple]:
    """(callee, receiver, args, line) of call sites, declarations left out."""
    family = family_of(path)
    if family is None or not content:
        return []
    text = blanked(content, family)
    pairs, starts = brackets(text), [0, *(m.end() for m in re.finditer("\n", text))]
    declared = {(name, first) for name, _, _, first, *_ in symbols_of(path, content)}
    rows = []
    for m in re.finditer(rf"(?:(?P<on>[A-Za-z_$][\w$]*)\s*(?:\.|::|->|\?\.)\s*)?(?<![\w$])(?P<name>{_NAME})\s*\(", text):
        line = bisect_right(starts, m.start("name"))
        if m["name"] not in NO_CALL and (m["name"], line) not in declared:
            rows.append((m["name"], m["on"], _arguments(text, pairs, m.end() - 1), line))
    return rows


@udtf(returnType="name string, kind string, exported boolean, first int, last int, params_count int, parent_class string")
class StructuralSymbols:
    """Symbols of a JavaScript, TypeScript, Go, Rust, C, C++ or C# source text."""

    def eval(self, path: str, content: str):
        yield from symbols_of(path, content)


@udtf(returnType="callee string, receiver string, args_count int, line int")
class StructuralCalls:
    """Call sites of a JavaScript, TypeScript, Go, Rust, C, C++ or C# source text."""

    def eval(self, path: str, content: str):
        yield from calls_of(path, content)
