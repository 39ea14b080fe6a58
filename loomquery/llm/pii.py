"""Personal data: exact patterns, and candidates of wider generators that boosted trees select."""

from __future__ import annotations

import ipaddress
import random
import re
import zlib
from bisect import bisect_left

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import _boost
from ._common import pieces, table

KINDS = ("email", "ip", "card", "phone")
#: Rows whose excerpts the trees are fitted on, characters of an excerpt, and the share of correct ones among what a threshold selects of the held-out fifth.
SAMPLE_ROWS, EXCERPT, PRECISION = 1_000, 2_000, 0.98
#: Characters beside a candidate that features see.
NEAR = 32

_DOMAIN = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_LOCAL = re.compile(r"[A-Za-z0-9._%+-]+")
_DOTTED = re.compile(r"[0-9]++(?:\.[0-9]++)*+")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")


def luhn(digits: str) -> bool:
    return sum(d if i % 2 == 0 else (d * 2 if d < 5 else d * 2 - 9) for i, d in enumerate(map(int, reversed(digits)))) % 10 == 0


def _digits(text: str) -> str:
    return "".join(c for c in text if "0" <= c <= "9")


def base_spans(text: str) -> dict[str, list[tuple[int, int]]]:
    """Spans of each kind by the exact patterns, leftmost and non-overlapping, in time linear in the text.

    An email is searched from its @, an ip in runs of dotted numbers: of these, four parts each are a match.
    """
    out = {k: [] for k in KINDS}
    end, at = 0, text.find("@")
    while at >= 0:
        domain = _DOMAIN.match(text, at)
        if domain:
            low = max(end, text.rfind("@", 0, at) + 1)
            local = _LOCAL.match(text[low:at][::-1])
            if local:
                out["email"].append((at - local.end(), domain.end()))
                end = domain.end()
        at = text.find("@", at + 1)
    for run in _DOTTED.finditer(text):
        if run.group().count(".") < 3:
            continue
        parts = list(re.finditer("[0-9]+", run.group()))
        for four in (parts[i : i + 4] for i in range(0, len(parts) - 3, 4)):
            if all(len(p.group().lstrip("0")) <= 3 and int(p.group().lstrip("0") or 0) <= 255 for p in four):
                out["ip"].append((run.start() + four[0].start(), run.start() + four[3].end()))
    for m in _CARD.finditer(text):
        if 16 <= m.end() - m.start() <= 40 and 16 <= len(d := _digits(m.group())) <= 19 and luhn(d):
            out["card"].append(m.span())
    for m in _PHONE.finditer(text):
        if 8 <= sum("0" <= c <= "9" for c in m.group()) <= 15:
            out["phone"].append(m.span())
    return out


# Generators: wider than the patterns, so that most of what they propose is none.
_AT = r"(?:\s?[\[({<]\s?(?:at|AT|@|arroba|chez)\s?[\])}>]\s?|\s(?:at|AT|arroba|chez)\s|\s?@\s?|\s?＠\s?)"
_DOT = r"(?:\.|\s?[\[({<]\s?(?:dot|DOT|punto|punkt|point|\.)\s?[\])}>]\s?|\s(?:dot|DOT|punto|punkt|point)\s)"
_AT_MARK, _AT_WORD = re.compile(_AT), re.compile(r"\b(?:at|AT|arroba|chez)\b|[@＠]")
_HOST = re.compile(rf"[\w-]{{1,63}}(?:{_DOT}[\w-]{{1,63}}){{0,6}}{_DOT}[^\W\d_]{{2,24}}")
_NAME = re.compile(r"[\w.%+-]{1,64}")
_FOUR = re.compile(r"(?<![0-9.])[0-9]{1,3}(?:(?:\s?(?:\.|[\[({]\s?(?:\.|dot)\s?[\])}])\s?|\sdot\s)[0-9]{1,3}){3}(?![0-9])")
_SIX = re.compile(r"(?<![\w:.])[0-9A-Fa-f:]{2,45}(?![\w:])")
_RUN = re.compile(r"[0-9](?:[\x20\-./_\u00a0\u2007\u202f\u2010-\u2015]?[0-9])++")
_DIALLED = re.compile(r"(?:[+＋]\s?|(?<![0-9])00\s?)[1-9](?:[\x20()./\u00a0\u2007\u202f\u2010-\u2015-]{0,3}[0-9])++")
_AREA = re.compile(r"(?<![\w+])(?:1[\x20.-])?(?:\([2-9][0-9]{2}\)[\x20-]?|[2-9][0-9]{2}[\x20./\u2010-\u2015-])[0-9]{3}[\x20./\u2010-\u2015-]?[0-9]{4}(?![0-9])")
_TRUNK = re.compile(r"(?<![\w+.,-])\(?0[1-9](?:[\x20()/.-]{0,2}[0-9]){6,10}(?![\w])")
_CALLED = re.compile(r"(?i:\b(?:tel[eéè]?(?:fono|fon|phone)?|phone|fon|mobile|mobil|móvil|cell|call|handy|fax|whatsapp)\b)[\x20.:#]{1,3}[+＋(]{0,2}\Z")
_NUMBER = re.compile(r"[0-9](?:[\x20()./\u00a0\u2010-\u2015-]{0,3}[0-9]){5,16}(?![0-9])")
#: Digits with at most 12 other characters between them, more than any of these patterns have.
_ZONE = re.compile(r"[0-9](?:[^0-9]{0,12}[0-9])++")

WORDS = {
    "phone": ("tel", "phone", "fon", "fax", "mobil", "móvil", "cell", "call", "handy", "whatsapp", "dial"),
    "card": ("card", "visa", "mastercard", "amex", "credit", "karte", "carte", "tarjeta", "cvv", "exp"),
    "ip": ("ip", "host", "server", "address", "addr", "login", "client", "ping", "from"),
    "email": ("mail", "contact", "write", "schreib", "correo", "courriel", "reach"),
    "other": ("isbn", "order", "invoice", "version", "v", "total", "date", "serial", "ref", "no", "id", "imei", "page", "chapter", "look", "meet"),
}
_WORD = re.compile(r"[^\W\d_]+")
#: First digits of card numbers and the lengths that go with them.
ISSUERS = (("4", (13, 16, 19)), ("51 52 53 54 55", (16,)), ("22 23 24 25 26 27", (16,)), ("34 37", (15,)), ("6011 64 65", (16, 19)), ("35", (16,)), ("30 36 38", (14,)))


def _issued(digits: str) -> bool:
    return any(digits.startswith(tuple(first.split())) and len(digits) in lengths for first, lengths in ISSUERS)


def candidates(text: str) -> list[tuple[str, int, int]]:
    """Proposed spans, which may overlap: spelled-out and international addresses, windows over groups of digits, numbers as they are dialled."""
    found = set()
    last = 0
    for word in _AT_WORD.finditer(text):
        m = next((m for back in (3, 2, 1, 0) if word.start() >= back and (m := _AT_MARK.match(text, word.start() - back)) and m.end() >= word.end()), None)
        if not m:
            continue
        host = _HOST.match(text, m.end())
        name = _NAME.match(text[max(last, m.start() - 64) : m.start()][::-1]) if host else None
        if name:
            found.add(("email", m.start() - name.end(), host.end()))
        last = m.end()
    if text.count(":") >= 2:
        for m in _SIX.finditer(text):
            if m.group().count(":") >= 2:
                try:
                    ipaddress.IPv6Address(m.group())
                except ValueError:
                    continue
                found.add(("ip", *m.span()))
    for zone in _ZONE.finditer(text):
        if zone.end() - zone.start() >= 6:
            _numbers(text, max(0, zone.start() - 3), min(len(text), zone.end() + 2), found)
            if _CALLED.search(text[max(0, zone.start() - 24) : zone.start()]) and (m := _NUMBER.match(text, zone.start())):
                lead = text[max(0, zone.start() - 2) : zone.start()]
                found.add(("phone", m.start() - len(lead) + len(lead.rstrip("+＋(")), m.end()))
    return sorted(found)


def _numbers(text: str, low: int, high: int, found: set) -> None:
    """Adds the candidates of digits between two places."""
    for m in _FOUR.finditer(text, low, high):
        if all(int(p) <= 255 for p in re.findall("[0-9]+", m.group())):
            found.add(("ip", *m.span()))
    for m in _RUN.finditer(text, low, high):
        if m.end() - m.start() < 13:
            continue
        parts = [(m.start() + p.start(), m.start() + p.end()) for p in re.finditer("[0-9]+", m.group())]
        for i in range(len(parts)):
            n = 0
            for j in range(i, len(parts)):
                n += parts[j][1] - parts[j][0]
                if n > 19:
                    break
                if n >= 13 and luhn(_digits(text[parts[i][0] : parts[j][1]])):
                    found.add(("card", parts[i][0], parts[j][1]))
    for m in _DIALLED.finditer(text, low, high):
        n = 0
        for p in re.finditer("[0-9]+", m.group()):
            n += p.end() - p.start()
            if n > 17:
                break
            if n >= 8:
                found.add(("phone", m.start(), m.start() + p.end()))
    for pattern in (_AREA, _TRUNK):
        found.update(("phone", *m.span()) for m in pattern.finditer(text, low, high))


def _says(before: list[str], words: tuple[str, ...]) -> bool:
    """Short words count whole, longer ones as the start of a word."""
    return any(w == b if len(w) < 4 else b.startswith(w) for w in words for b in before)


def features(text: str, kind: str, start: int, end: int) -> list[float]:
    """Format and context of a span: nothing here tells whether an exact pattern matched it."""
    span, left, right = text[start:end], text[max(0, start - NEAR) : start], text[end : end + NEAR]
    digits = _digits(span)
    groups = [len(g) for g in re.findall("[0-9]+", span)] or [0]
    marks = re.sub(r"\w", "", span)
    near = lambda side: next((i for i, c in enumerate(side) if c.isdigit()), NEAR)
    edge = lambda c: [c.isdigit(), c.isalpha(), c.isspace(), c in ".,;:!?)\"'" if c else True, c in "-_/=+#@&%$" if c else False]
    before = [w.lower() for w in _WORD.findall(left)]
    name = span.split("@")[0].split("＠")[0].split(" ")[0]
    last = re.split(r"[^\w]+", span)[-1]
    return [
        len(span), len(digits), len(groups), max(groups), min(groups), groups[0], groups[-1], len(set(groups)),
        len(set(marks)), marks.count(" "), marks.count("-"), marks.count("."), marks.count("/"), marks.count(":"), sum(marks.count(c) for c in "([{<"),
        span[0] in "+＋", span.startswith("00"), span.startswith("0"), span.startswith("("), "@" in span or "＠" in span,
        bool(re.search(r"[\[({<]\s?(?:at|arroba|chez|@)", span, re.I)), bool(re.search(r"\s(?:at|AT|arroba|chez)\s", span)), len(re.findall(r"(?<!\w)(?:dot|punto|punkt|point)(?!\w)", span, re.I)), bool(re.search(r"[\[({<]\s?\.", span)),
        luhn(digits) if digits else 0, _issued(digits), len(name), any(c.isdigit() for c in name), "." in name, len(last), sum(c.isalpha() for c in span), "::" in span,
        bool(re.match(r"(?:19|20)[0-9]{2}[-./ ](?:0[1-9]|1[0-2])|[0-3][0-9][-./ ](?:0[1-9]|1[0-2])[-./ ](?:19|20)?[0-9]{2}", span)),
        near(left[::-1]), near(right), *edge(left[-1:]), *edge(right[:1]),
        *(_says(before[-4:], words) for words in WORDS.values()),
    ]


# Examples: written into excerpts of the corpus, so that their surroundings are its own.
def _cards(rng: random.Random) -> str:
    first, lengths = rng.choice(ISSUERS)
    first, n = rng.choice(first.split()), rng.choice(lengths)
    body = first + "".join(rng.choice("0123456789") for _ in range(n - len(first) - 1))
    return next(body + c for c in "0123456789" if luhn(body + c))


def _grouped(digits: str, sizes: tuple[int, ...], mark: str) -> str:
    out, at = [], 0
    for n in sizes:
        out.append(digits[at : at + n])
        at += n
    return mark.join([*out, digits[at:]] if digits[at:] else out)


def _some(rng: random.Random, n: int, letters: str = "0123456789") -> str:
    return "".join(rng.choice(letters) for _ in range(n))


def example(rng: random.Random, word: str) -> tuple[str, str, str, str, bool]:
    """(kind, text before, span, text after, personal): one written example; ``word`` is a word of the corpus."""
    kind, personal, d = rng.choice(KINDS), rng.random() < 0.6, lambda n: _some(rng, n)
    before = after = ""
    letters = "abcdefghijklmnopqrstuvwxyz"
    name = word.lower() + rng.choice(["", "." + _some(rng, 5, letters), d(2), "_" + _some(rng, 3, letters), "." + d(2)])
    host, end = rng.choice(["mail", "post", "example", "web", "inbox", word.lower()]) + rng.choice(["", d(1), "-" + _some(rng, 3, letters)]), rng.choice(["com", "org", "net", "de", "fr", "es", "io", "co.uk", "edu"])
    if kind == "email" and personal:
        at, dot = rng.choice([("@", "."), (" at ", " dot "), (" [at] ", "."), ("(at)", "."), (" (at) ", " (dot) "), ("[at]", "[dot]"), (" @ ", "."), ("＠", "."), (" AT ", " DOT "), ("@", " dot "), ("@", "[.]"), ("{at}", "."), (" arroba ", " punto ")])
        span = name + at + host + dot + end.replace(".", dot)
    elif kind == "email":
        before, span = rng.choice([("", f"{word} at {host}.{end}"), ("", f"{name} at {host}.{end}"), ("", f"{word} at {word} dot {word}"), ("meet", f"{word} at {host}. {word}"), ("", f"{word} @ {word}. {word}"), ("", f"{word} at {word}.{word}")])
    elif kind == "ip" and personal:
        six = [_some(rng, rng.randint(1, 4), "0123456789abcdef") for _ in range(8)]
        four = [str(rng.randint(1, 254)) for _ in range(4)]
        span = rng.choice([":".join(six), "2001:db8::" + ":".join(six[:3]), "fe80::" + ":".join(six[:4]), ".".join(four), ".".join(four), "[.]".join(four), " . ".join(four), "(.)".join(four), "[dot]".join(four), " dot ".join(four)])
        before = rng.choice(["", "", "ip", "host", "from", "address"])
    elif kind == "ip":
        before, span = rng.choice([("", f"{word[:2]}::{word[:3]}"), ("", f"a::{word[:1]}"), ("", "::"), ("", f"{rng.randint(1, 9)}. {rng.randint(10, 99)}. {rng.randint(1, 9)}. {rng.randint(1, 99)}"), ("v", f"::{rng.randint(1, 9)}")])
    elif kind == "card" and personal:
        digits, mark = _cards(rng), rng.choice([" ", "-", "", ".", "\u00a0", "/", "_", "\u2011"])
        span = _grouped(digits, (4, 6, 5) if len(digits) == 15 else (4, 6, 4) if len(digits) == 14 else (4, 4, 4, 4), mark)
        before = rng.choice(["", "", "", "card", "visa", "card no", "credit card", d(4), d(10), f"no {d(3)}-{d(4)}", f"+1 ({d(3)}) {d(3)}-{d(4)}", f"{d(3)} {d(3)}-{d(4)}"])
        after = rng.choice(["", "", "", d(2) + "/" + d(2), d(3), "exp " + d(2) + "/" + d(2), d(4), d(10)])
    elif kind == "card":
        body = rng.choice(["978", "17", "10", "0", "9", "8", "1", "49015"])
        body += d(rng.choice([13, 13, 14, 15, 16, 17, 18, 19]) - len(body) - 1)
        digits = next(body + c for c in "0123456789" if luhn(body + c))
        before, span = rng.choice(["isbn", "imei", "id", "order", "ref", "", ""]), rng.choice([digits, _grouped(digits, (3, 1, 2, 6), "-"), _grouped(digits, (3, 3, 3, 3), " "), _grouped(digits, (2,) * 9, " "), _grouped(digits, (1,) * 19, " "), _grouped(digits, (5, 5, 5), " ")])
    elif kind == "phone" and personal:
        area, local, country = rng.choice("23456789") + d(2), rng.choice("23456789") + d(2) + " " + d(4), rng.choice(["1", "44", "49", "33", "34", "39", "351"])
        dash = local.replace(" ", "-")
        before, span = rng.choice([
            ("", f"+{country} ({area}) {dash}"), ("", f"+{country} {area} {local}"), ("", f"({area}) {dash}"), ("", f"({area}){dash}"), ("", f"{area}-{dash}"), ("", f"{area}.{local.replace(' ', '.')}"), ("", f"1-{area}-{dash}"), ("", f"00{country} {area} {local}"),
            ("", f"00{country}{area}{d(6)}"), ("", f"+{country}/{area}/{d(6)}"), ("", f"＋{country} {area} {local}"), ("", f"+{country}\u00a0{area}\u00a0{d(6)}"), ("", f"+33 {d(1)} {d(2)} {d(2)} {d(2)} {d(2)}"), ("", f"0{rng.randint(1, 9)} {d(2)} {d(2)} {d(2)} {d(2)}"),
            ("", f"0{rng.choice('123456789')}{d(2)}/{d(7)}"), ("", f"+49 (0){d(2)} {d(7)}"), ("tel:", f"{area}{d(7)}"), ("phone", f"{area} {local}"), ("call", f"{area}{d(4)}"), ("fax:", f"0{area} {d(6)}"), ("tel.", f"{area}-{d(4)}"), ("", f"+{country}{area}{d(6)}"),
        ])
        after = rng.choice(["", "", "", "", d(8), d(12)]) if span[0] == "+" else ""
    else:
        date = f"{rng.choice(['19', '20'])}{d(2)}-{rng.randint(1, 12):02}-{rng.randint(1, 28):02}"
        before, span = rng.choice([("", date), ("", date.replace("-", ".")), ("", f"0{rng.randint(1, 9)}/{rng.randint(1, 12):02}/{d(4)} {d(2)}:{d(2)}"), ("", f"{rng.randint(200, 999)} {d(3)} {d(4)}"), ("no", f"0{rng.choice('123456789')}{d(8)}"), ("id", f"00{rng.choice('123456789')}{d(9)}"), ("order", f"{rng.randint(200, 999)}-{d(3)}-{d(4)}"), ("", f"00{rng.choice('123456789')}{d(14)}"), ("", f"0{rng.choice('123456789')}.{d(7)}"), ("", f"0{rng.choice('123456789')}{d(9)}")])
    return kind, before, span, after, personal


def training_rows(text: str) -> list[tuple[str, bool, bool, list[float]]]:
    """(kind, personal, held out, features) from an excerpt.

    Its own candidates are personal if an exact pattern matches that very span, and left out if one meets it or would match if it stood alone. Then examples are written between its words: a candidate that is
    a personal example is personal, others that touch an example are not.
    """
    rng = random.Random(zlib.crc32(text.encode("utf-8", "surrogatepass")))
    held, out = rng.random() < 0.2, []
    base = base_spans(text)
    for kind, a, b in candidates(text):
        if (a, b) in base[kind] or not any(a < y and x < b for x, y in base[kind]) and not base_spans(text[a:b])[kind]:
            out.append((kind, (a, b) in base[kind], held, features(text, kind, a, b)))
    words = [m for m in _WORD.finditer(text) if m.group().isascii()]
    for _ in range(20 if words else 0):
        at = rng.choice(words)
        meant, before, span, after, personal = example(rng, rng.choice(words).group())
        left = text[max(0, at.start() - 80) : at.start()] + before + " " * bool(before)
        written = left + span + rng.choice([" ", " ", ". ", ", ", "\n"] if not after else [" "]) + after + " " + text[at.start() : at.end() + 80]
        for kind, a, b in candidates(written):
            if a < len(left) + len(span) and len(left) < b:
                exact = (a, b) == (len(left), len(left) + len(span))
                out.append((kind, personal and exact and kind == meant, held, features(written, kind, a, b)))
    return out


def fit(docs: DataFrame, sample_rows: int = SAMPLE_ROWS, precision: float = PRECISION) -> dict:
    """Trees and threshold of each kind, from excerpts of about ``sample_rows`` texts of ``docs(text)``, chosen by their hash.

    The threshold is the least, at log odds of 0 or more, at which the selected part of the held-out fifth is correct to ``precision``; it lies
    halfway to the next score. A kind without such a one adds nothing.
    """
    size = F.length("text")
    at = F.pmod(F.xxhash64("text", F.lit(1)), F.greatest(size - EXCERPT, F.lit(1))).cast("int") + 1
    one_in = max(1, docs.count() // sample_rows)
    chosen = docs.select("text", F.xxhash64("text").alias("h")).where(F.col("text").isNotNull() & (F.pmod("h", F.lit(one_in)) == 0))
    chosen = chosen.select("h", F.substring("text", at, F.lit(EXCERPT)).alias("excerpt")).dropDuplicates(["h"])

    def rows(batches):
        for batch in batches:
            found = [r for text in batch.column(0).to_pylist() for r in training_rows(text)]
            if found:
                kind, personal, held, x = zip(*found)
                yield pa.RecordBatch.from_arrays([pa.array(kind), pa.array(personal), pa.array(held), pa.array([np.array(v, dtype=np.float32).tobytes() for v in x])], ["kind", "personal", "held", "x"])

    sample = chosen.select("excerpt").mapInArrow(rows, "kind string, personal boolean, held boolean, x binary").toPandas().sort_values(["kind", "personal", "held", "x"])
    model = {}
    for kind in KINDS:
        own = sample[sample.kind == kind]
        if not own.personal.any():
            continue
        x, y, held = np.stack([np.frombuffer(v, dtype=np.float32) for v in own.x]), own.personal.to_numpy(dtype=float), own.held.to_numpy(dtype=bool)
        trees = _boost.fit(x[~held], y[~held])
        score = _boost.predict(trees, x[held])
        order = np.argsort(-score, kind="stable")
        right = np.cumsum(y[held][order]) / np.arange(1, held.sum() + 1)
        last = np.append(score[order][1:] < score[order][:-1], True) if held.any() else np.zeros(0, bool)
        fine = np.flatnonzero((right >= precision) & last)
        if len(fine):
            ranked = score[order]
            model[kind] = (trees, float(max((ranked[fine[-1]] + ranked[min(fine[-1] + 1, len(ranked) - 1)]) / 2, 0.0)))
    return model


def _free(taken: list[tuple[int, int]], a: int, b: int) -> int | None:
    """Where (a, b) goes in the sorted list of disjoint spans, None if it meets one."""
    i = bisect_left(taken, (a, b))
    if (i and taken[i - 1][1] > a) or (i < len(taken) and taken[i][0] < b):
        return None
    return i


def all_spans(texts: list[str], model: dict) -> list[tuple[dict, dict]]:
    """(base, all) spans of each text, by kind. An added span reaches its kind's threshold, and meets no base span and no better added one.

    Only an email may be wider than the base span of its kind that it holds, as where letters beyond ASCII precede that.
    """
    base = [base_spans(t) for t in texts]
    offered = {k: [] for k in model}
    for i, text in enumerate(texts):
        for kind, a, b in candidates(text):
            if kind in model and (a, b) not in base[i][kind]:
                offered[kind].append((i, a, b))
    scored = []
    for kind, spans in offered.items():
        trees, least = model[kind]
        for at in range(0, len(spans), 20_000):
            part = spans[at : at + 20_000]
            score = _boost.predict(trees, np.array([features(texts[i], kind, a, b) for i, a, b in part], dtype=np.float32))
            scored += [(-float(s), i, kind, a, b) for s, (i, a, b) in zip(score, part) if s >= least]
    taken = [sorted(s for spans in b.values() for s in spans) for b in base]
    for i, spans in enumerate(taken):  # base spans of two kinds can meet
        joined = []
        for a, b in spans:
            if joined and a < joined[-1][1]:
                joined[-1] = (joined[-1][0], max(b, joined[-1][1]))
            else:
                joined.append((a, b))
        taken[i] = joined
    out = [{k: list(v) for k, v in b.items()} for b in base]
    for _, i, kind, a, b in sorted(scored):
        wider = kind == "email" and any(a <= x and y <= b for x, y in base[i]["email"])
        at = _free(taken[i], a, b)
        if at is not None:
            taken[i].insert(at, (a, b))
        if at is not None or wider:
            out[i][kind].append((a, b))
    return [(b, {k: sorted(v) for k, v in o.items()}) for b, o in zip(base, out)]


def joined(spans: dict) -> str:
    return ",".join(f"{k}:{a}:{b}" for k in KINDS for a, b in spans[k])


def find(docs: DataFrame, model: dict) -> DataFrame:
    """``docs`` with __base and __spans, both ``kind:start:end`` of code points, by kind and start, joined by commas, and __counts, of base spans by kind.

    A null or empty text has none; other columns pass, those named alike are replaced. A task holds the candidates of about 4 MB of texts at a time.
    """
    kept = [c for c in docs.columns if c not in ("__base", "__spans", "__counts")]
    packed = docs.select("text", F.struct(*kept).alias("row"))
    out = f"row {packed.schema['row'].dataType.simpleString()}, __base string, __spans string, __counts array<bigint>"

    def spans(batches):
        for batch in batches:
            for piece in pieces(batch, 0):
                found = all_spans([t or "" for t in piece.column(0).to_pylist()], model)
                counts = pa.array([[len(b[k]) for k in KINDS] for b, _ in found], pa.list_(pa.int64()))
                yield pa.RecordBatch.from_arrays([piece.column(1), pa.array([joined(b) for b, _ in found], pa.string()), pa.array([joined(a) for _, a in found], pa.string()), counts], ["row", "__base", "__spans", "__counts"])

    return packed.mapInArrow(spans, out).select("row.*", "__base", "__spans", "__counts")


def redacted(docs: DataFrame, model: dict) -> DataFrame:
    """``docs`` with each span of its text as ``<KIND>``; spans that meet are one, named by the first. A null text stays null."""
    kept = docs.columns
    packed = docs.select("text", F.struct(*kept).alias("row"))

    def cut(batches):
        for batch in batches:
            for piece in pieces(batch, 0):
                texts = piece.column(0).to_pylist()
                new = []
                for text, (_, found) in zip(texts, all_spans([t or "" for t in texts], model)):
                    out, end = [], 0
                    for a, b, kind in sorted((a, b, k) for k, v in found.items() for a, b in v):
                        if a >= end:
                            out += [text[end:a], f"<{kind.upper()}>"]
                        end = max(end, b)
                    new.append(None if text is None else "".join(out) + text[end:])
                yield pa.RecordBatch.from_arrays([piece.column(1), pa.array(new, pa.string())], ["row", "__text"])

    out = packed.mapInArrow(cut, f"row {packed.schema['row'].dataType.simpleString()}, __text string")
    return out.select(*(F.col("__text").alias(c) if c == "text" else F.col("row")[c].alias(c) for c in kept))


def op13_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Personal data in every text of ``documents``: counts and digest of the base spans, and all spans.

    The counts, like the digest, are of base spans; ``spans`` holds those and the ones that the trees add. One row per row, repeated ones
    too, with their doc_id, null ones too. Null and empty texts have no spans and the digest of the empty string. An empty table gives no rows.
    """
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = find(docs, fit(docs))
    counts = [F.col("__counts")[i].alias(f"n_{k}") for i, k in enumerate(KINDS)]
    return found.select("doc_id", *counts, F.sha2(F.col("__base").cast("binary"), 256).alias("base_sha256"), F.col("__spans").alias("spans"))
