"""Chat formatting: heterogeneous records to canonical turns, and a reversible template with a loss mask."""

from __future__ import annotations

import hashlib
import json
import re

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._common import table

OPEN, MIDDLE, CLOSE = "<|turn|>", "\n", "<|end|>"
#: Strings with a meaning to public chat templates.
CONTROL = ["<|turn|>", "<|end|>", "<|im_start|>", "<|im_end|>", "<|endoftext|>", "<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>"]
_CONTROL = re.compile("|".join(map(re.escape, CONTROL)))
_ESCAPED = re.compile(r"\\(\\?)")


def escape(text: str) -> str:
    """Doubles each backslash and puts one after the first character of each control string."""
    return _CONTROL.sub(lambda m: m[0][0] + "\\" + m[0][1:], text.replace("\\", "\\\\"))


def unescape(text: str) -> str:
    return _ESCAPED.sub(r"\1", text) if "\\" in text else text


def escape_role(role: str) -> str:
    return escape(role).replace("\n", "\\N")


def unescape_role(role: str) -> str:
    return re.sub(r"\\(\\|N|)", lambda m: {"N": "\n"}.get(m[1], m[1]), role)


def fingerprint(value) -> str:
    """Hash of the nested field paths of a record with their kinds; lists merge the paths of their items."""
    return hashlib.sha256("\n".join(sorted(paths(value))).encode()).hexdigest()[:16]


def paths(value, at: str = "") -> set[str]:
    if isinstance(value, dict):
        return set().union(*(paths(v, f"{at}.{k}" if at else k) for k, v in value.items())) if value else {f"{at}{{}}"}
    if isinstance(value, list):
        return set().union(*(paths(v, f"{at}[]") for v in value)) if value else {f"{at}[]"}
    return {at}


#: Declarative mappings: required paths, and how turns are read. ``each``: the list of turns; ``fields``: role to
#: path of single texts, in order; ``row``: the record is one turn itself.
MAPPINGS = [
    {"name": "turn_row", "needs": {"role", "text", "turn"}, "row": ("role", "text")},
    {"name": "messages", "needs": {"messages[].role", "messages[].content"}, "each": ("messages", "role", "content")},
    {"name": "conversations", "needs": {"conversations[].from", "conversations[].value"}, "each": ("conversations", "from", "value")},
    {"name": "instruction", "needs": {"instruction", "output"}, "fields": [("system", "system"), ("user", "instruction"), ("user", "input"), ("assistant", "output")]},
    {"name": "prompt_response", "needs": {"prompt", "response"}, "fields": [("system", "system"), ("user", "prompt"), ("assistant", "response")]},
    {"name": "prompt_completion", "needs": {"prompt", "completion"}, "fields": [("system", "system"), ("user", "prompt"), ("assistant", "completion")]},
]
ROLES = {"human": "user", "gpt": "assistant", "bot": "assistant"}
_CHOSEN: dict[str, dict | None] = {}
#: Layouts that a worker remembers the mapping of.
LAYOUTS = 10_000


def mapping(value) -> dict | None:
    """The mapping for a record, looked up by its schema fingerprint.

    A fingerprint not seen before is matched once: the first mapping, most required paths first, whose
    required paths the record has; extra fields don't matter. None if there is no such mapping.
    """
    key = fingerprint(value)
    if key not in _CHOSEN:
        have = paths(value)
        if len(_CHOSEN) >= LAYOUTS:
            _CHOSEN.clear()
        _CHOSEN[key] = next((m for m in sorted(MAPPINGS, key=lambda m: -len(m["needs"])) if m["needs"] <= have), None)
    return _CHOSEN[key]


def canonical(value) -> list[tuple[str, str]]:
    """(role, text) turns of a record, in order; no turns if no mapping fits. Null roles and texts are empty.

    A single-text field that is missing or null (say, an instruction's input) is no turn.
    """
    m = mapping(value)
    if m is None:
        return []
    if "row" in m:
        role, text = m["row"]
        return [(value.get(role) or "", value.get(text) or "")]
    if "each" in m:
        items, role, text = m["each"]
        return [(ROLES.get(t.get(role), t.get(role) or ""), t.get(text) or "") for t in value[items] if isinstance(t, dict)]
    return [(role, value[f]) for role, f in m["fields"] if value.get(f) is not None]


def segment(role: str, text: str) -> tuple[str, int, int]:
    """A formatted turn and the span of it under the loss mask (empty but for assistants)."""
    head, body = f"{OPEN}{escape_role(role)}{MIDDLE}", escape(text)
    return f"{head}{body}{CLOSE}", len(head), len(head) + (len(body) if role == "assistant" else 0)


def parse(formatted: str) -> list[tuple[str, str]]:
    """The (role, text) turns of a formatted string, unescaped."""
    out = []
    for part in formatted.split(CLOSE)[:-1]:
        role, _, text = part.removeprefix(OPEN).partition(MIDDLE)
        out.append((unescape_role(role), unescape(text)))
    return out


def format_chat(records: DataFrame) -> DataFrame:
    """``records(conv_id, ord, record)``, JSON records, to (conv_id, ord, layout, formatted, masks).

    Each record gives one piece of its conversation's formatted string, pieces in the order of ``ord``; masks are
    [start, end) code-point spans of the piece under the loss mask. A record that is no JSON object
    or fits no mapping has a null layout and an empty piece. Work is by row: a conversation of any length
    is never gathered.
    """

    def run(batches):
        for batch in batches:
            layout, texts, masks = [], [], []
            for raw in batch.column(2).to_pylist():
                value = _load(raw)
                m = mapping(value) if value is not None else None
                piece, spans, size = [], [], 0
                for role, text in canonical(value) if m else []:
                    s, a, b = segment(role, str(text))
                    piece.append(s)
                    if role == "assistant":
                        spans.append([size + a, size + b])
                    size += len(s)
                layout.append(m and m["name"]), texts.append("".join(piece)), masks.append(spans)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(layout, pa.string()), pa.array(texts, pa.string()), pa.array(masks, pa.list_(pa.list_(pa.int64())))],
                ["conv_id", "ord", "layout", "formatted", "masks"],
            )

    return records.select(F.col("conv_id").cast("bigint"), F.col("ord").cast("bigint"), F.col("record").cast("string")).mapInArrow(
        run, "conv_id bigint, ord bigint, layout string, formatted string, masks array<array<bigint>>"
    )


def _load(raw: str | None):
    try:
        value = json.loads(raw) if raw else None
    except ValueError:
        return None
    return value if isinstance(value, dict) else None


class _Digest:
    def __init__(self):
        self.turns, self.loss = hashlib.sha256(), hashlib.sha256()
        self.n_turns = self.loss_chars = self.chars = 0

    def add(self, formatted: str, masks):
        for role, text in parse(formatted):
            self.n_turns += 1
            self.turns.update(f"{role}\n{text}\n".encode("utf-8", "surrogatepass"))
        for a, b in masks or []:
            text = unescape(formatted[a:b])
            self.loss_chars += len(text)
            self.loss.update(text.encode("utf-8", "surrogatepass"))
        self.chars += len(formatted)

    def row(self, conv):
        return conv, self.n_turns, self.turns.hexdigest(), self.loss_chars, self.loss.hexdigest(), self.chars


_DIGEST = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]


def read_back(formatted: DataFrame) -> DataFrame:
    """Digests of each conversation, parsed from its formatted pieces.

    A sorted stream, piece by piece: a task holds one piece and one running digest, however long a
    conversation is. Null conversation ids are one conversation.
    """

    def run(batches):
        key, digest, rows = object(), None, []
        for batch in batches:
            for conv, text, masks in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).to_pylist()):
                if conv != key or digest is None:
                    if digest is not None:
                        rows.append(digest.row(key))
                    key, digest = conv, _Digest()
                digest.add(text, masks)
            if len(rows) > 5000:
                yield _rows(rows)
                rows = []
        if digest is not None:
            rows.append(digest.row(key))
        yield _rows(rows)

    ordered = formatted.repartition("conv_id").sortWithinPartitions("conv_id", "ord", "formatted")
    return ordered.select("conv_id", "formatted", "masks").mapInArrow(run, "conv_id bigint, n_turns bigint, turns_sha256 string, loss_chars bigint, loss_sha256 string, formatted_chars bigint")


def _rows(rows):
    cols = list(zip(*rows)) if rows else [()] * 6
    types = (pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64())
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types)], _DIGEST)


def turn_records(conversations: DataFrame) -> DataFrame:
    """A row of (conv_id, turn, role, text) as a JSON record of one turn; further columns are left out."""
    fields = F.struct("turn", "role", "text")
    return conversations.select("conv_id", F.col("turn").alias("ord"), F.to_json(fields, {"ignoreNullFields": "false"}).alias("record"))


def op4_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digests of every conversation of ``conversations``, and conversation -1, read back from their formatted strings.

    Null texts and roles are empty; rows of equal turn are ordered by their formatted text, those of a null turn come first;
    null conversation ids are one conversation. Conversation -1 is there for an empty table too.
    """
    rows = turn_records(table(spark, sf_dir, "conversations"))
    say = "</s>[INST] ok [/INST]"
    probe = json.dumps({"messages": [{"role": "user", "content": say}, {"role": "assistant", "content": say}]})
    extra = spark.range(1).select(F.lit(-1).cast("bigint").alias("conv_id"), F.lit(0).cast("bigint").alias("ord"), F.lit(probe).alias("record"))
    return read_back(format_chat(rows.union(extra)))
