"""Word stems, type expressions and skeletons of data files, as Column expressions."""

from __future__ import annotations

import json
import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from loomquery.functions.text import let

# Words with a stem of their own, and that stem.
STEMS = {
    "authentication": "auth", "authenticate": "auth", "authenticated": "auth", "authorization": "auth", "authorize": "auth",
    "authorized": "auth", "configuration": "config", "configure": "config", "configured": "config", "cancellation": "cancel",
    "cancelled": "cancel", "canceling": "cancel", "canceled": "cancel", "cancle": "cancel", "expiration": "expir", "expired": "expir",
    "expiring": "expir", "expires": "expir", "expire": "expir", "expried": "expir", "validation": "valid", "validator": "valid",
    "validate": "valid", "validated": "valid", "verification": "verifi", "verified": "verifi", "verifier": "verifi", "verify": "verifi",
    "connection": "connect", "connected": "connect", "connecting": "connect", "execution": "exec", "execute": "exec", "executed": "exec",
    "executing": "exec", "compression": "compress", "compressed": "compress", "dehydration": "dehydr", "dehydrate": "dehydr",
    "dehydrated": "dehydr", "dehydrator": "dehydr", "encryption": "encrypt", "encrypted": "encrypt", "decryption": "decrypt",
    "decrypted": "decrypt", "transaction": "tx", "transactions": "tx", "repository": "repo", "repositories": "repo", "initialize": "init",
    "initialized": "init", "initialization": "init", "signature": "sign", "signatures": "sign", "signed": "sign", "signing": "sign",
    "payment": "pay", "payments": "pay", "paid": "pay", "paying": "pay",
}
# Suffixes, the first that leaves three letters is cut.
SUFFIXES = ["izations", "ization", "ational", "fulness", "ousness", "iveness", "ements", "ement", "ations", "ation", "ances", "ance", "ences", "ence", "ings", "ing", "ions", "ion", "able", "ible", "ness", "less", "ment", "ities", "ity", "ies", "ied", "ed", "es", "s"]
# Names of languages and libraries that are no types of a code base.
BUILTIN_TYPES = (
    "Array ReadonlyArray Promise Record Partial Required Readonly Pick Omit Exclude Extract NonNullable ReturnType Parameters InstanceType Map Set WeakMap WeakSet Date RegExp Error TypeError SyntaxError "
    "Buffer Uint8Array Float32Array Int32Array Object Function String Number Boolean Symbol BigInt AbortSignal AbortController NodeJS Iterable AsyncIterable Iterator Optional Union List Dict Tuple FrozenSet "
    "Sequence Mapping MutableMapping Callable Any Literal Final ClassVar TypeVar Generic Protocol TypedDict NamedTuple Self None True False Exception ValueError RuntimeError KeyError BaseModel Option Result "
    "Vec Box Rc Arc RefCell Mutex RwLock HashMap HashSet BTreeMap BTreeSet Cow Pin PhantomData Some Ok Err Default Clone Copy Debug Display Send Sync Context WaitGroup Writer Task IEnumerable IList "
    "IDictionary IReadOnlyList CancellationToken Action Func Guid DateTime TimeSpan ArgumentException InvalidOperationException"
).split()


def stem(word: Column) -> Column:
    """Stem of a lower-case English word: its irregular one, else without the longest known suffix that leaves three
    letters, then without a doubled last letter or a silent e. Words of up to three letters stay."""
    pattern = f"^(.{{3,}}?)({'|'.join(SUFFIXES)})$"

    def cut(w):
        parts = F.struct(F.regexp_extract(w, pattern, 1).alias("cut"), F.regexp_extract(w, pattern, 2).alias("suffix"))
        kept = lambda p: (p["suffix"] == "") | ((p["suffix"] == "s") & w.rlike("(s|u|i)s$"))
        return let(parts, lambda p: F.when(kept(p), w).when(p["suffix"].isin("ies", "ied"), F.concat(p["cut"], F.lit("y"))).otherwise(p["cut"]))

    single = lambda x: F.when(F.length(x) >= 4, F.regexp_replace(x, r"([^lsz])\1$", "$1")).otherwise(x)
    silent = lambda x: F.when(F.length(x) >= 5, F.regexp_replace(x, "e$", "")).otherwise(x)
    own = F.create_map(*[F.lit(x) for pair in STEMS.items() for x in pair])
    return let(F.trim(F.lower(word)), lambda w: F.when(F.length(w) <= 3, w).otherwise(F.coalesce(F.try_element_at(own, w), let(let(cut(w), single), silent))))


def type_references(text: Column, own: Column | None = None) -> Column:
    """Distinct capitalised names that may be types: no built-in ones, constants, single letters or the name itself."""
    names = F.array_distinct(F.regexp_extract_all(text, F.lit(r"(?<![A-Za-z0-9_])[A-Z][a-zA-Z0-9_]*"), F.lit(0)))
    out = F.filter(names, lambda n: (F.length(n) > 1) & ~(n.rlike("^[A-Z0-9_]+$") & (F.length(n) > 2)) & ~n.isin(BUILTIN_TYPES))
    return out if own is None else F.array_remove(out, own)


# Words before a type, and types that stand for no value.
QUALIFIERS = ["readonly", "const", "mut", "static", "final", "volatile", "unsigned", "signed", "long", "short", "async"]
NO_VALUE = ["null", "undefined", "none", "nil", "void", "never"]


def unwrapped(raw: str | None, left: int = 8) -> str | None:
    """Name of the type inside qualifiers, pointers, arrays, nullability and the first generic argument; null for true unions."""
    words = (raw or "").split()
    while words and (words[0][0] in "&*" or len(words) > 1 and words[0].lower() in QUALIFIERS):
        words = [w for w in [words[0].lstrip("&*")] if w and w.lower() not in QUALIFIERS] + words[1:]
    text = " ".join(words)
    if text.startswith("(") and text.endswith(")"):
        return unwrapped(text[1:-1], left - 1) if left else None
    text = re.sub(r"[\s?]*(\[\s*\][\s?]*)*$", "", text)
    some = [p for p in map(str.strip, text.split("|")) if p and p.lower() not in NO_VALUE]
    if "|" in text:
        return unwrapped(some[0], left - 1) if len(some) == 1 and left else None
    generic = re.fullmatch(r"[^<\[]+<(.*)>|[^\[]+\[(.*)\]", text)
    if generic and left:
        inner, depth = generic[1] or generic[2] or "", 0
        for i, ch in enumerate(inner):
            depth += (ch in "<[(") - (ch in ">])")
            if ch == "," and not depth:
                inner = inner[:i]
                break
        return unwrapped(inner, left - 1)
    name = re.fullmatch(r"(?:.*[.:])?\s*([A-Za-z_][A-Za-z0-9_]*)", text)
    return name[1] if name else None


def unwrap_type(raw: Column) -> Column:
    return F.pandas_udf(lambda s: s.map(unwrapped), "string")(raw)


def json_shape(content: str | None, depth_cap: int = 4, siblings: int = 30, most: int = 400, width: int = 40) -> str | None:
    """One line a key path of a JSON text: lengths of arrays with their first item, scalars cut; null if it is no JSON."""
    try:
        root = json.loads(content or "")
    except ValueError:
        return None
    lines: list[str] = []
    stack = [(root, "", 0)]
    while stack and len(lines) < most:
        value, label, depth = stack.pop()
        pad = "  " * min(depth, depth_cap)
        if value is ...:
            lines.append(pad + label)
        elif isinstance(value, list):
            lines.append(f"{pad}{label}: [{len(value)} items]")
            if value and depth < depth_cap:
                stack.append((value[0], f"{label}[0]", depth + 1))
        elif isinstance(value, dict) and value and depth < depth_cap:
            keys = list(value)
            if len(keys) > siblings:
                stack.append((..., f"…(+{len(keys) - siblings} more keys)", depth + 1))
            stack.extend((value[k], f"{label}.{k}" if label else k, depth + 1) for k in reversed(keys[:siblings]))
        elif isinstance(value, dict):
            lines.append(f"{pad}{label}: " + (f"{{…}} [{len(value)} keys, depth cap {depth_cap}]" if value else "{}"))
        else:
            if isinstance(value, float) and value.is_integer():
                value = int(value)
            flat = " ".join(value.split()) if isinstance(value, str) else value
            cut = flat[:width] + "…" if isinstance(flat, str) and len(flat) > width else flat
            lines.append(f"{pad}{label or '(root)'}: {json.dumps(cut, ensure_ascii=False)}")
    if stack:
        lines.append(f"…(+output capped at {most} lines)")
    return "\n".join(lines)


def json_skeleton(content: Column) -> Column:
    return F.pandas_udf(lambda s: s.map(json_shape), "string")(content)


def delimited_skeleton(content: Column, delimiter: str = ",", most: int = 40, sample: int = 3, width: int = 40) -> Column:
    """Header and first rows with their line numbers and how many follow; null up to ``most`` rows, blank lines left out."""
    rows = F.filter(F.transform(F.split(content, r"\r?\n"), lambda x, i: F.struct((i + 1).alias("no"), x.alias("text"))), lambda r: F.trim(r["text"]) != "")
    flat = lambda c: F.trim(F.regexp_replace(c, r"\s+", " "))
    cell = lambda c: F.when(F.length(flat(c)) > width, F.concat(F.substring(flat(c), 1, width), F.lit("…"))).otherwise(flat(c))
    line = lambda r: F.concat(F.lpad(r["no"].cast("string"), 4, " "), F.lit(": "), F.array_join(F.transform(F.split(r["text"], re.escape(delimiter)), cell), delimiter))
    more = F.concat(F.lit("(+"), (F.size(rows) - (1 + sample)).cast("string"), F.lit(" more rows)"))
    return F.when(F.size(rows) > most, F.array_join(F.array_append(F.transform(F.slice(rows, 1, 1 + sample), line), more), "\n"))
