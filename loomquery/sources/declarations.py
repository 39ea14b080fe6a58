"""Declarations of source texts, read statement by statement: symbols, imports, bases, fields and the types that names are bound to.

A text becomes tokens, with Python's indentation as braces. Statements end at braces and semicolons, in some languages at line ends too. A stack of
scopes says what a statement is in: a type, a function or a block. There is no full grammar: what macros and generated code declare is not seen.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import udtf

from loomquery.functions.lexical import unwrap_type, unwrapped
from loomquery.operators._lineage import written
from loomquery.sources.structural import NO_CALL, family_of

_WORD = r"[A-Za-z_$][\w$]*"
_MARK = r"=>|::|->|:=|\?\.|\.\.\.|==|!=|<=|>=|&&|\|\||[^\s\w]"
_COMMENT, _QUOTED = r"//[^\n]*|/\*.*?(?:\*/|\Z)", r'"(?:\\.|[^"\\\n])*"?'
_SKIPPED = {
    "js": (_COMMENT, _QUOTED + r"|'(?:\\.|[^'\\\n])*'?|`(?:\\.|[^`\\])*`?"),
    "go": (_COMMENT, _QUOTED + r"|'(?:\\.|[^'\\\n])+'|`[^`]*`?"),
    "rust": (_COMMENT + r"|#!?\[[^\]\n]*\]|'[A-Za-z_]\w*(?!')", _QUOTED + r"|'(?:\\.[^']*|[^'\\\n])'"),
    "c": (_COMMENT + r"|^[ \t]*\#(?![ \t]*include\b)(?:\\\n|[^\n])*", _QUOTED + r"|'(?:\\.|[^'\\\n])*'?|(?<=include )[ \t]*<[^>\n]*>|(?<=include)<[^>\n]*>"),
    "csharp": (_COMMENT + r"|^[ \t]*\#[^\n]*", r'@"(?:""|[^"])*"?|' + _QUOTED + r"|'(?:\\.|[^'\\\n])*'?"),
    "python": (r"#[^\n]*|\\\n", r'[A-Za-z]{0,2}(?:"""(?:\\.|[^\\])*?(?:"""|\Z)|' + r"'''(?:\\.|[^\\])*?(?:'''|\Z)|" + r'"(?:\\.|[^"\\\n])*"?|' + r"'(?:\\.|[^'\\\n])*'?)"),
}
_TOKENS = {f: re.compile(rf"(?P<skip>{skip})|(?P<text>{text})|(?P<word>{_WORD})|(?P<number>[0-9][\w.]*)|(?P<line>\n)|(?P<mark>{_MARK})", re.S | re.M) for f, (skip, text) in _SKIPPED.items()}
_PAIRS = {"(": ")", "[": "]", "{": "}"}
#: Marks after which a line of scripts and Go goes on, and before which it does.
_GOES_ON, _FOLLOWS = set("= + - * / % & | ^ < > ? : , . ( [ { ! ~ => := && || == != <= >= ?. -> ::".split()), set(". ?. ? : + * / % & | => && || == != ) ]".split())
#: Words before a declared name, words that declare a type, and words by language that no declaration starts with.
MODIFIERS = set("public private protected internal static async abstract override virtual sealed readonly partial unsafe extern new export default declare const let var mut pub final inline explicit constexpr friend mutable volatile required get set accessor async typedef using required".split())
TYPES = {"class", "interface", "struct", "enum", "trait", "record", "impl", "union"}
_STARTS = {
    "": "return if else for while switch case throw do try catch finally break continue", "js": "delete in of await yield typeof", "python": "elif except with raise del pass assert not lambda print yield await global nonlocal",
    "go": "defer go select range package", "rust": "match loop unsafe where impl", "c": "delete goto operator", "csharp": "foreach lock fixed yield await checked goto when",
}
STATEMENTS = {family: set(f"{_STARTS['']} {words}".split()) for family, words in _STARTS.items() if family}


class Token(NamedTuple):
    text: str
    kind: str
    line: int


@dataclass
class Found:
    """Rows of a file; lines count from 1. A binding's scope is the first line of its function, 0 outside; its block a number of the innermost braces."""

    symbols: list = field(default_factory=list)  # name, kind, exported, line, end_line, params, parent_class, returns
    imports: list = field(default_factory=list)  # module, names, line
    parents: list = field(default_factory=list)  # child, base, line
    fields: list = field(default_factory=list)  # owner, name, type, line
    bindings: list = field(default_factory=list)  # scope, owner, name, type, line, block
    calls: list = field(default_factory=list)  # callee, receiver, line, scope, owner, args


def tokens(content: str, family: str) -> list[Token]:
    """Words, numbers, texts and marks; line ends only where they can end a statement, Python's blocks as braces."""
    out, line, depth, indents, fresh, directive = [], 1, 0, [0], True, False
    soft = family in ("js", "go", "python")
    for m in _TOKENS[family].finditer(content):
        kind, text = m.lastgroup, m[0]
        if kind == "line" or kind == "skip":
            line += text.count("\n")
            if kind == "line":
                if (soft and not depth or directive) and out and out[-1].kind != "end":
                    out.append(Token("\n", "end", line - 1))
                fresh, directive = True, False
            continue
        if family == "python" and fresh and not depth:
            column = m.start() - (content.rfind("\n", 0, m.start()) + 1)
            if column > indents[-1] and len(out) > 1 and out[-2].text == ":":
                out[-2:] = [Token("{", "mark", out[-2].line)]
                indents.append(column)
            while column < indents[-1]:
                indents.pop()
                out.append(Token("}", "mark", line - 1))
        directive |= fresh and text == "#" and family == "c"
        fresh = False
        if kind == "mark" and text in "([" or family == "python" and text == "{":
            depth += 1
        elif kind == "mark" and text in ")]" or family == "python" and text == "}":
            depth = max(0, depth - 1)
        if family == "python" and text in ("{", "}"):
            kind = "brace"
        out.append(Token(text, kind, line))
        line += text.count("\n")
    return out + [Token("\n", "end", line)] + [Token("}", "mark", line)] * (len(indents) - 1)


def _closing(t: list[Token], i: int, to: int) -> int:
    """Place of the bracket that closes the one at i, ``to`` if none does."""
    want, depth = t[i].text, 0
    other = _PAIRS[want]
    for j in range(i, to):
        depth += (t[j].text == want) - (t[j].text == other)
        if not depth:
            return j
    return to


def _angle(t: list[Token], i: int, to: int) -> int:
    """Place after the type parameters that open at i, i if none do."""
    if i >= to or t[i].text != "<":
        return i
    depth = 0
    for j in range(i, to):
        depth += (t[j].text == "<") - (t[j].text == ">")
        if not depth:
            return j + 1
    return to


def joined(t: list[Token]) -> str:
    """Tokens as a type is written: with a space between words only."""
    out = ""
    for a in t:
        out += " " * (bool(out) and a.kind in ("word", "number") and (out[-1].isalnum() or out[-1] in "_$")) + a.text
    return out


def _split(t: list[Token]) -> list[list[Token]]:
    """Items between top-level commas; brackets and type parameters count."""
    out, depth = [[]], 0
    for a in t:
        depth += (a.text in "([{<") - (a.text in ")]}>") if a.kind in ("mark", "brace") else 0
        if a.text == "," and not depth:
            out.append([])
        else:
            out[-1].append(a)
    return [x for x in out if x]


class _Reader:
    def __init__(self, content: str, family: str):
        self.family, self.out, self.stack, self.blocks, self.starts = family, Found(), [], 0, STATEMENTS[family]
        self.t = tokens(content, family)

    # Scopes: [kind, name, block, first line, symbol row]

    def owner(self) -> str | None:
        """The type that a statement here is declared in."""
        return next((s[1] for s in reversed(self.stack) if s[0] == "type"), None)

    def inside(self) -> str:
        return next((s[0] for s in reversed(self.stack) if s[0] != "block"), "module")

    def direct_type(self) -> str | None:
        return self.stack[-1][1] if self.stack and self.stack[-1][0] == "type" else None

    def scope(self) -> tuple[int, str | None]:
        """First line of the function around, and its class."""
        for s in reversed(self.stack):
            if s[0] == "function":
                return s[3], s[1]
        return 0, self.owner()

    def read(self) -> Found:
        t, i, start = self.t, 0, 0
        while i < len(t):
            text, kind = t[i].text, t[i].kind
            if kind == "mark" and text in "([":
                i = min(_closing(t, i, len(t)) + 1, len(t))
                continue
            if kind == "mark" and text == "{":
                i = self.opened(start, i)
                start = i
                continue
            ends = kind == "end" and not self.goes_on(i) or kind == "mark" and text in ";}"
            if ends:
                self.statement(start, i, None)
                if text == "}" and self.stack:
                    top = self.stack.pop()
                    if top[4] is not None:
                        self.out.symbols[top[4]][4] = t[i].line
                start = i + 1
            i += 1
        self.statement(start, len(t), None)
        for s in self.stack:
            if s[4] is not None:
                self.out.symbols[s[4]][4] = t[-1].line
        self.out.symbols = [tuple(s) for s in self.out.symbols]
        return self.out

    def goes_on(self, i: int) -> bool:
        """Whether the statement goes on after a line end."""
        if self.family == "python" or not i:
            return False
        after = self.t[i + 1] if i + 1 < len(self.t) else None
        return self.t[i - 1].text in _GOES_ON or self.family == "js" and after is not None and after.kind == "mark" and after.text in _FOLLOWS

    def opened(self, start: int, i: int) -> int:
        """Reads the head before a brace and opens its scope, or steps over a list of imported names or a type written in braces."""
        head = [a for a in self.t[start:i] if a.kind != "end"]
        words = {a.text for a in head}
        if self.family in ("js", "rust") and head and (head[0].text in ("import", "use") or head[0].text in ("export", "pub") and (len(head) == 1 or "use" in words)):
            end = _closing(self.t, i, len(self.t))
            stop = end + 1
            while stop < len(self.t) and self.t[stop].text not in (";", "\n"):
                stop += 1
            self.statement(start, stop, None)
            return stop + 1
        kind, name, row = "block", None, None
        self.blocks += 1
        before = len(self.out.symbols)
        opened = self.statement(start, i, self.blocks)
        if opened:
            kind, name = opened
            row = before if len(self.out.symbols) > before else None
        self.stack.append([kind, name, self.blocks, head[0].line if head else self.t[i].line, row])
        if kind == "function" and row is not None:
            self.stack[-1][3] = self.out.symbols[row][3]
        return i + 1

    def statement(self, start: int, end: int, opens: int | None) -> tuple[str, str | None] | None:
        """Reads one statement; if it opens a block, gives the scope's kind and, for types, their name or, for functions, their class."""
        t = [a for a in self.t[start:end] if a.kind != "end"]
        while self.family != "python" and len(t) > 1 and t[0].text in ("public", "private", "protected", "default", "case") and ":" in (t[1].text, t[-1].text if t[0].text == "case" else ""):
            t = t[2:] if t[1].text == ":" else []
        if not t or self.imported(t):
            return None
        i = 0
        while i < len(t) - 1 and (t[i].text in MODIFIERS or t[i].text == "@" and self.family in ("js", "python") or self.family == "csharp" and t[i].text == "[" or self.family == "c" and t[i].text == "template"):
            if t[i].text == "@":
                i += 2
                while i < len(t) and t[i].text == ".":
                    i += 2
            elif t[i].text == "template":
                i += 1
                i = _angle(t, i, len(t))
                continue
            elif t[i].text == "[":
                i = _closing(t, i, len(t)) + 1
                continue
            else:
                i += 1
            if i < len(t) and t[i].text == "(":
                i = _closing(t, i, len(t)) + 1
        if i >= len(t):
            return None
        exported = any(a.text in ("export", "public", "pub") for a in t[:i])
        before = len(self.out.symbols)
        kind = self.type_head(t, i, opens, exported) or self.function_head(t, i, opens, exported)
        if kind is None and len(self.out.symbols) == before:
            self.bound(t, i, opens)
        if kind is None or "=>" in [a.text for a in t]:
            self.called(t, {s[0] for s in self.out.symbols[before:]})
        return kind

    def called(self, t: list[Token], declared: set[str]) -> None:
        """Words before a parenthesis, with the word that a dot, an arrow or a double colon joins to them."""
        scope, owner = self.scope()
        args, open_ = {}, []  # items in each bracket; of an open one: its place, items so far, whether one has begun
        for n, a in enumerate(t):
            if open_ and a.text not in (",", ")", "]", "}"):
                open_[-1][2] = True
            if a.text in ("(", "[", "{"):
                open_.append([n, 0, False])
            elif open_ and a.text == ",":
                open_[-1][1:] = [open_[-1][1] + open_[-1][2], False]
            elif open_ and a.text in (")", "]", "}"):
                at, items, begun = open_.pop()
                args[at] = items + begun
        start = 0 if self.direct_type() is None else next((n for n, a in enumerate(t) if a.text == "="), len(t))
        for n, a in enumerate(t[:-1]):
            typed = self.family in ("c", "csharp") and n and t[n - 1].kind == "word" and t[n - 1].text not in self.starts | {"await", "else", "in"}
            if n < start or typed or a.text in MODIFIERS:
                continue
            paren = n + 1 if t[n + 1].text == "(" else _angle(t, n + 1, min(len(t), n + 12)) if self.family in ("csharp", "js", "c") else n
            if a.kind == "word" and paren < len(t) and t[paren].text == "(" and a.text not in NO_CALL and a.text not in self.starts and a.text not in declared and (not n or t[n - 1].text not in ("new", "function", "def", "fn", "func")):
                on = t[n - 2].text if n > 1 and t[n - 1].text in (".", "->", "::", "?.") and t[n - 2].kind == "word" else None
                self.out.calls.append((a.text, on, a.line, scope, owner, args.get(paren, 0)))

    def imported(self, t: list[Token]) -> bool:
        first, line = t[0].text, t[0].line
        names: list[str] = []
        add = lambda module, names: self.out.imports.append((module.strip("\"'`<> \t"), names, line))
        if self.family == "js" and first in ("import", "export"):
            text = next((a.text for a in t if a.kind == "text"), None)
            if text is None or first == "export" and not any(a.text == "from" for a in t):
                return False
            parts = [a for a in t[1 : next(i for i, a in enumerate(t) if a.kind == "text")]]
            for j, a in enumerate(parts):
                if a.text == "*":
                    names.append("*")
                elif a.kind == "word" and a.text not in ("from", "as", "type") and (not j or parts[j - 1].text != "as"):
                    names.append(a.text)
            add(text, names)
            return True
        if self.family == "python" and first == "from" and any(a.text == "import" for a in t):
            at = next(i for i, a in enumerate(t) if a.text == "import")
            items = [a for a in t[at + 1 :] if a.text not in "()"]
            add(joined(t[1:at]).replace(" ", ""), [x[0].text for x in _split(items)])
            return True
        if self.family == "python" and first == "import":
            for item in _split(t[1:]):
                add("".join(a.text for a in item if a.kind == "word" and a.text != "as" or a.text == ".") if not any(a.text == "as" for a in item) else joined(item[: [a.text for a in item].index("as")]), [])
            return True
        if self.family == "go" and first == "import":
            for a in t:
                if a.kind == "text":
                    add(a.text, ["*"])
            return True
        if self.family == "rust" and "use" in (first, t[1].text if len(t) > 1 else "", t[4].text if len(t) > 4 else ""):
            t = t[[a.text for a in t].index("use") + 1 :]
            brace = next((i for i, a in enumerate(t) if a.text == "{"), None)
            if brace is not None:
                add(joined(t[:brace]).rstrip(":"), [x[0].text for x in _split(t[brace + 1 : _closing(t, brace, len(t))])])
            elif t:
                path = t[: [a.text for a in t].index("as")] if any(a.text == "as" for a in t) else t
                add(joined(path[:-2]) if len(path) > 2 else joined(path), [a.text for a in path[-1:]])
            return True
        if self.family == "csharp" and first == "using" and len(t) > 1 and t[1].text not in ("(", "var") and not self.stack:
            add(joined([a for a in t[1:] if a.text != "static"]).split("=")[-1], ["*"])
            return True
        if self.family == "c" and first == "#":
            text = next((a.text for a in t if a.kind == "text"), None)
            if text:
                add(text, ["*"])
            return bool(text)
        return False

    def type_head(self, t, i, opens, exported):
        """``type Name struct`` of Go, else a word that declares a type, a name, type parameters and bases."""
        if self.family == "go":
            if t[i].text != "type" or len(t) < i + 3:
                return None
            j = i + 2
            if t[j].text == "[":
                j = _closing(t, j, len(t)) + 1
            if j >= len(t) or t[j].text not in ("struct", "interface"):
                return None
            return self.declare_type(t[i + 1], t[j].text, t[i + 1].text[0].isupper(), opens)
        if t[i].text not in TYPES or i + 1 >= len(t):
            return None
        kind, j = t[i].text, i + 1
        if kind == "enum" and t[j].text in ("class", "struct"):
            j += 1
        if kind == "impl":
            j = _angle(t, j, len(t))
            names = [a for a in t[j:] if a.text == "for"]
            j = next(n for n, a in enumerate(t) if a is names[-1]) + 1 if names else j
            name = next((a for a in t[j:] if a.kind == "word" and a.text not in ("dyn", "mut")), None)
            return ("type", name.text) if name and opens else None
        if kind == "record" and t[j].text in ("class", "struct"):
            j += 1
        if j >= len(t) or t[j].kind != "word" or self.family == "c" and not opens:
            return None
        name, after = t[j], _angle(t, j + 1, len(t))
        if self.family == "csharp" and after < len(t) and t[after].text == "(":
            end = _closing(t, after, len(t))
            for p in _split(t[after + 1 : end]):
                if p[-1].kind == "word":
                    self.out.fields.append((name.text, p[-1].text, joined(p[:-1]), p[-1].line))
            after = end + 1
        self.bases(name, t[after:])
        return self.declare_type(name, kind, exported or self.family in ("c", "python"), opens)

    def bases(self, name: Token, t: list[Token]) -> None:
        if not t:
            return
        if self.family == "js":
            at = next((n for n, a in enumerate(t) if a.text == "extends"), None)
            listed = [] if at is None else _split(t[at + 1 : next((n for n, a in enumerate(t) if a.text == "implements"), len(t))])
        elif self.family == "python":
            listed = [x for x in _split(t[1 : _closing(t, 0, len(t))]) if len(x) < 2 or x[1].text != "="] if t[0].text == "(" else []
        elif self.family in ("csharp", "c") and t[0].text == ":":
            listed = _split(t[1 : next((n for n, a in enumerate(t) if a.text == "where"), len(t))])
        else:
            listed = []
        for item in listed:
            words = [a.text for a in item[: next((n for n, a in enumerate(item) if a.text in "<[("), len(item))] if a.kind == "word" and a.text not in MODIFIERS]
            if words:
                self.out.parents.append((name.text, words[-1], name.line))

    def declare_type(self, name: Token, kind: str, exported: bool, opens: int | None):
        self.out.symbols.append([name.text, kind, exported, name.line, name.line, 0, None, None])
        return ("type", name.text) if opens else None

    def function_head(self, t, i, opens, exported):
        """``def``, ``func``, ``fn`` and ``function`` name one; else it is a name before parentheses, with a type before it or in a class, that opens a block."""
        owner, arrow, receiver = self.direct_type(), False, None
        word = {"python": "def", "go": "func", "rust": "fn", "js": "function"}.get(self.family)
        at = next((n for n in range(i, min(len(t), i + 4)) if t[n].text == word), None)
        if at is not None and len(t) > at + 1:
            j = at + 1
            if self.family == "go" and t[j].text == "(":
                end = _closing(t, j, len(t))
                receiver, j = t[j + 1 : end], end + 1
            if self.family == "js" and t[j].text == "*":
                j += 1
            if j >= len(t) or t[j].kind != "word":
                return ("function", self.scope()[1]) if opens else None
            name, paren = t[j], _angle(t, j + 1, len(t))
            if self.family == "go" and paren < len(t) and t[paren].text == "[":
                paren = _closing(t, paren, len(t)) + 1
        elif self.family == "js" and opens and t[-1].text == "=>" and i + 1 < len(t) and t[i].kind == "word" and t[i + 1].text in ("=", ":"):
            arrow, name = True, t[i]
            paren = next((n for n in range(i, len(t)) if t[n].text == "(" and t[n - 1].text in ("=", "async", ">")), None)
            if paren is None:
                return ("function", owner or self.scope()[1])
        elif (opens or self.family == "csharp" and owner and "=>" in [a.text for a in t]) and self.family in ("js", "c", "csharp") and t[0].text not in self.starts and "=" not in [a.text for a in t[: next((n for n, a in enumerate(t) if a.text == "("), len(t))]]:
            paren = next((n for n, a in enumerate(t) if a.text == "(" and n > i - 1 and n and (t[n - 1].kind == "word" or t[n - 1].text == ">")), None)
            if paren is None or self.family in ("js", "csharp") and not owner:
                return None
            at = paren - 1
            while at > 0 and t[at].text != "<" and t[at].kind != "word":
                at -= 1
            name = t[paren - 1] if t[paren - 1].kind == "word" else t[max(0, at - 1)]
            if name.text in self.starts or name.kind != "word" or self.family == "c" and not owner and (self.inside() == "function" or t[0] is name):
                return None
            if self.family == "c" and paren > 2 and t[paren - 2].text == "::":
                owner = t[paren - 3].text
        else:
            return None
        if paren >= len(t) or t[paren].text != "(":
            return ("function", owner or self.scope()[1]) if opens else None
        end = _closing(t, paren, len(t))
        params = _split([a for a in t[paren + 1 : end]])
        if receiver:
            words = [a.text for a in receiver if a.kind == "word"]
            owner = words[1] if len(words) > 1 else words[0] if words else None
        if owner is None and self.family in ("python", "js", "csharp", "rust", "c"):
            owner = self.direct_type()
        kind = "method" if owner else "function"
        shown = [p for n, p in enumerate(params) if not (owner and not n and any(a.text in ("self", "cls") for a in p[:4]))]
        out = name.text[0].isupper() if self.family == "go" else exported or self.family in ("c", "python")
        self.out.symbols.append([name.text, kind, out, name.line, t[-1].line, len(shown), owner, self.returned(t, t.index(name), paren, end)])
        if opens:
            for p in params + ([receiver] if receiver else []):
                self.parameter(p, name.line, owner, opens)
        return ("function", owner) if opens else None

    def returned(self, t, at: int, paren: int, end: int) -> str | None:
        """What a function gives: after an arrow or a colon, after the last parenthesis in Go, before the name in C and C#."""
        rest = t[end + 1 :]
        if self.family in ("python", "rust"):
            mark = next((n for n, a in enumerate(rest) if a.text == "->"), None)
            rest = [] if mark is None else rest[mark + 1 :]
            stop = next((n for n, a in enumerate(rest) if a.text in (":", "where") and self.family == "python" or a.text == "where"), len(rest))
            return joined(rest[:stop]) or None
        if self.family == "go":
            return joined(rest) or None
        if self.family == "js":
            return joined([a for a in rest[1:] if a.text != "=>"]) or None if rest and rest[0].text == ":" else None
        before = [a for a in t[:at] if a.text not in MODIFIERS]
        while len(before) > 1 and before[-1].text == "::":
            before = before[:-2]
        return joined(before) or None

    def parameter(self, p: list[Token], line: int, owner: str | None, block: int) -> None:
        p = [a for a in p if a.text not in MODIFIERS or a.text == "new"]
        stop = next((n for n, a in enumerate(p) if a.text == "="), len(p))
        p = p[:stop]
        colon = next((n for n, a in enumerate(p) if a.text == ":"), None)
        if self.family in ("js", "python", "rust"):
            if colon:
                words = [a for a in p[:colon] if a.kind == "word"]
                if words:
                    self.bind(words[-1].text, joined(p[colon + 1 :]), line, block, line, owner)
        elif len(p) > 1:
            name, kind = (p[0], p[1:]) if self.family == "go" else (p[-1], p[:-1])
            if name.kind == "word":
                self.bind(name.text, joined(kind), line, block, line, owner)

    def bound(self, t, i, opens):
        """Variables, fields and assignments."""
        block = self.stack[-1][2] if self.stack else 0
        owner, inside = self.direct_type(), self.inside()
        scope, around = self.scope()
        texts = [a.text for a in t]
        if self.family == "go" and owner and not opens and t[0].kind == "word":
            listed = _split([a for a in t if a.kind != "text"])
            kind = listed[-1][1:]
            if not kind or kind[0].text == ".":
                self.out.parents.append((owner, listed[-1][-1].text, t[0].line))
            elif kind[0].text != "(":
                self.out.fields += [(owner, p[0].text, joined(kind), p[0].line) for p in listed]
            return None
        if self.family == "go" and owner and t[0].text == "*" and len(t) > 1:
            self.out.parents.append((owner, [a for a in t if a.kind == "word"][-1].text, t[0].line))
            return None
        if self.family == "rust" and owner and not opens:
            for item in _split(t):
                n = next((n for n, a in enumerate(item) if a.text == ":"), None)
                if n:
                    self.out.fields.append((owner, item[n - 1].text, joined(item[n + 1 :]), item[n - 1].line))
            return None
        if self.family in ("js", "rust") and not owner and not any(a.text in ("const", "let", "var", "static", "this", "self") for a in t[:3]) and ":" in texts[1:3]:
            return None  # an item of a literal
        if t[i].text in self.starts and not owner:
            return None
        equal = next((n for n, a in enumerate(t) if a.text in ("=", ":=")), None)
        left, right = (t, []) if equal is None else (t[:equal], t[equal + 1 :])
        if not left:
            return None
        if self.family == "go" and left[0].text == "var":
            left = left[1:]
        elif self.family == "rust" and left[0].text == "let":
            left = left[1:]
        left = [a for n, a in enumerate(left) if a.text not in MODIFIERS or n and left[n - 1].text == ":"]
        own = len(left) > 2 and left[0].text in ("self", "this") and left[1].text in (".", "->")
        left = left[2:] if own else left
        colon = next((n for n in (1, 2) if self.family in ("js", "python", "rust") and len(left) > n and left[n].text == ":" and (n == 1 or left[1].text in ("?", "!"))), None)
        name = kind = None
        if colon:
            name, kind = left[0], joined(left[colon + 1 :])
        elif self.family in ("c", "csharp") and len(left) > 1 and left[-1].kind == "word" and not any(a.text in ("(", ")", ".", "->", "?", "+") for a in left):
            name, kind = left[-1], joined(left[:-1])
        elif self.family == "c" and opens is None and not owner and inside == "function" and len(left) > 2 and left[0].kind == left[1].kind == "word" and left[2].text == "(":
            name, kind = left[1], left[0].text
        elif self.family == "go" and len(left) > 1 and equal is None and left[0].kind == "word" and t[0].text == "var":
            name, kind = left[0], joined(left[1:])
        elif self.family == "go" and len(left) > 1 and t[0].text == "var":
            name, kind = left[0], joined(left[1:])
        elif self.family == "csharp" and opens and owner and len(t) > 1 and "(" not in texts and t[-1].kind == "word":
            name, kind = t[-1], joined([a for a in t[:-1] if a.text not in MODIFIERS])
        elif len(left) == 1 and right:
            name = left[0]
        if name is None or name.kind != "word" or name.text in self.starts:
            return None
        if self.family in ("c", "csharp") and "," in [a.text for a in left] and len(_split(left)) > 1:
            listed = _split(left)
            names, kind = [listed[0][-1], *(p[-1] for p in listed[1:])], joined(listed[0][:-1])
            for n in names:
                if owner:
                    self.out.fields.append((owner, n.text, kind, n.line))
                else:
                    self.bind(n.text, kind, n.line, block, scope, around)
            return None
        made = self.made(right)
        if kind in (None, "var", "auto", "let", "const") or kind and kind.split(" ")[-1] in ("auto", "var"):
            kind = made
        if owner and not own and self.family != "go":
            if kind or colon:
                self.out.fields.append((owner, name.text, kind, name.line))
        elif own:
            if around:
                self.out.fields.append((around, name.text, kind, name.line))
        else:
            self.bind(name.text, kind, name.line, block, scope, around)
        return None

    def made(self, t: list[Token]) -> str | None:
        """The type that an expression makes: ``new T(``, ``T(`` of Python, ``T{`` and ``new(T)`` of Go, ``T::new(`` and ``T {`` of Rust."""
        while t and t[0].text in ("await", "&", "*", "(", "mut"):
            t = t[1:]
        if not t:
            return None
        if t[0].text == "new":
            if self.family == "go":
                return joined(t[2:-1]) or None
            stop = next((n for n, a in enumerate(t) if a.text in "([{" and n), len(t))
            return joined(t[1:stop]) or None
        stop = next((n for n, a in enumerate(t) if a.text in ("(", "{")), len(t))
        name = t[:stop]
        if not name or any(a.kind != "word" and a.text not in (".", "::", "<", ">", ",") for a in name):
            return None
        if self.family == "rust" and stop < len(t) and t[stop].text == "(" and len(name) > 2:
            return joined(name[:-2]) if name[-1].text[0].islower() and name[-3].text[0].isupper() or name[-3].text == ">" else None
        last = name[-1].text
        if self.family == "python" and stop < len(t) and last[0].isupper():
            return joined(name)
        if stop == len(t) and self.family in ("go", "rust") or stop < len(t) and t[stop].text == "{":
            return joined(name) if last[0].isupper() else None
        return None

    def bind(self, name: str, kind: str | None, line: int, block: int, scope: int, owner: str | None) -> None:
        """A row for a variable's type; one without a type is a row too, for it ends the search for one."""
        self.out.bindings.append((scope, owner, name, kind, line, block))


def declarations(path: str | None, content: str | None) -> Found:
    family = _family(path)
    if family is None or not content:
        return Found()
    out = _Reader(content, family).read()
    for n, (scope, owner, name, kind, line, block) in enumerate(out.bindings):
        kind = unwrapped(re.sub(r"[*&]+|&?\bmut\b", " ", kind.strip("\"'")).strip()) if kind else None
        out.bindings[n] = (scope, owner, name, owner if kind == "Self" else None if kind == name else kind, line, block)
    return out


#: The head of a type with no name that matters, by language.
_HEADS = {"python": "class K:\n", "go": "type K struct {\n", "rust": "struct K {\n", "c": "struct K {\n", "csharp": "class K {\n", "js": "class K {\n"}


def _family(path: str | None) -> str | None:
    return "python" if (path or "").lower().endswith((".py", ".pyi")) else family_of(path)


def fields_of(block: str | None, path: str | None) -> list[str] | None:
    """Different names of the fields that a type's source block declares, in order; a C# record's parameters count. Null for a null block."""
    if block is None:
        return None
    family = _family(path) or "js"
    head, mark, body = block.partition("\n" if family == "python" else "{")
    found = _Reader(head + " {}", family).read().fields if family == "csharp" and "record" in head else []
    found = found + _Reader(_HEADS[family] + body, family).read().fields if mark else found
    return list(dict.fromkeys(f[1] for f in found))


def returned_by(signature: str | None, path: str | None) -> str | None:
    """The type that a signature gives by its language's rule, else what stands before the name; null if neither names one."""
    family = _family(path) or "js"
    t = [a for a in tokens(signature or "", family) if a.kind != "end"]
    while t and t[-1].text in ("{", ":", "=>", "}"):
        t.pop()
    at = next((n + 1 for n, a in enumerate(t) if a.text in ("def", "func", "fn", "function")), None)
    if family == "go" and at is not None and at < len(t) and t[at].text == "(":
        at = _closing(t, at, len(t)) + 1
    if at is None or at >= len(t) or t[at].kind != "word":
        at = next((n - 1 for n, a in enumerate(t) if n and a.text == "(" and t[n - 1].kind == "word"), None)
    if at is None:
        return None
    paren = _angle(t, at + 1, len(t))
    if paren >= len(t) or t[paren].text != "(":
        return None
    rule = _Reader("", family).returned(t, at, paren, _closing(t, paren, len(t)))
    return unwrapped(rule) or unwrapped(joined([a for a in t[:at] if a.text not in MODIFIERS]))


def fields_of_each(blocks, paths):
    """``fields_of`` of two series; equal blocks in files of one ending are read once."""
    known, out = {}, []
    for block, path in zip(blocks, paths):
        key = block, (path or "").rpartition(".")[2]
        if key not in known:
            known[key] = fields_of(block, path)
        out.append(known[key])
    return type(blocks)(out, index=blocks.index, dtype=object)


def struct_fields(block: Column, path: Column) -> Column:
    return F.pandas_udf(lambda b, p: fields_of_each(b, p), "array<string>")(block, path)


def return_type(signature: Column, path: Column, declared: Column) -> Column:
    """Name of the type that a function gives: the declared one, else the signature's."""
    return F.coalesce(unwrap_type(declared), F.pandas_udf(lambda s, p: s.combine(p, returned_by), "string")(signature, path))


_ROWS = {
    "symbols": "name string, kind string, exported boolean, line int, end_line int, params int, parent_class string, returns string",
    "imports": "module string, names array<string>, line int", "parents": "child string, base string, line int", "fields": "owner string, name string, type string, line int",
    "bindings": "scope int, owner string, name string, type string, line int, block int", "calls": "callee string, receiver string, line int, scope int, owner string, args int",
}


@udtf(returnType=", ".join(f"{k} array<struct<{re.sub(r'(\w+) (?=[a-z])', r'\1: ', v)}>>" for k, v in _ROWS.items()))
class Declarations:
    """What a source text declares, as one row of arrays."""

    def eval(self, path: str, content: str):
        found = declarations(path, content)
        yield tuple(getattr(found, k) for k in _ROWS)


def parse(files: DataFrame, once: bool = False) -> dict[str, DataFrame]:
    """Tables of symbols, imports, parents, fields and bindings of ``files(path, content)``, each with the path.

    ``once`` writes what was read of each file to the shared folder, for callers that use several of the tables; the files are dealt out first, as small
    ones come in few splits. Texts are far larger than their compressed files, so joins of the tables must not be planned by the sizes of these.
    """
    spark = files.sparkSession
    spark.udtf.register("loomquery_declarations", Declarations)
    files = files.repartition(4 * spark.sparkContext.defaultParallelism, "path") if once else files
    files.createOrReplaceTempView("loomquery_files")
    parsed = spark.sql("SELECT f.path, d.* FROM loomquery_files f, LATERAL loomquery_declarations(f.path, f.content) d")
    parsed = written(parsed, "declarations") if once else parsed
    return {k: parsed.select("path", F.posexplode(k).alias("ordinal", "row")).select("path", "ordinal", "row.*") for k in _ROWS}
