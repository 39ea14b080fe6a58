"""A stream of logs that grow: every complete line once, by its place in its file."""

from __future__ import annotations

import hashlib
import io
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition

#: Bytes of a log that one task reads, bytes searched at once for the last line's end, and bytes at a file's start that tell it from its successor.
CHUNK, BLOCK, HEAD = 32 << 20, 64 << 10, 256
SCHEMA = "file string, at bigint, raw string"


@dataclass
class Range(InputPartition):
    """Lines of a file that start in [low, high); the first line read there starts at ``first`` or later, all end by ``end``."""

    file: str
    first: int
    low: int
    high: int
    end: int


def _store(uri: str):
    """(file system, path in it) of a folder or file; a plain path is local."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri) if "://" in uri or uri.startswith("file:") else (fs.LocalFileSystem(), uri)


def _head(stream, size: int) -> str:
    stream.seek(0)
    return hashlib.sha256(stream.read(size)).hexdigest()[:16]


class JournalReader(DataSourceStreamReader):
    """The offset is {file: "end of its last complete line, bytes of its head, digest of these"}.

    A line without its newline waits. A file that is shorter than its offset, or whose head has changed, was replaced and is read from 0.
    Planning reads at most BLOCK bytes or the unfinished line at each grown file's end, and its head; tasks read the lines, CHUNK bytes each.
    """

    def __init__(self, options):
        self.folder, self.chunk = options["path"], int(options.get("chunk", CHUNK))
        self.known: dict[str, tuple] = {}

    def initialOffset(self) -> dict:
        return {}

    def latestOffset(self) -> dict:
        from pyarrow import fs

        store, root = _store(self.folder)
        found, known = store.get_file_info(fs.FileSelector(root, recursive=True, allow_not_found=True)), {}
        for info in found:
            inside = info.path[len(root.rstrip("/")) + 1 :]
            if info.type != fs.FileType.File or any(part[0] in "._" for part in inside.split("/")):
                continue
            stamp = info.size, info.mtime_ns
            if self.known.get(inside, (None,))[0] == stamp:
                known[inside] = self.known[inside]
                continue
            with store.open_input_file(info.path) as stream:
                end = _last_line_end(stream, info.size)
                size = min(HEAD, end)
                known[inside] = stamp, f"{end} {size} {_head(stream, size)}"
        self.known = known
        return {file: offset for file, (_, offset) in sorted(known.items())}

    def partitions(self, start: dict, end: dict) -> list[Range]:
        store, root = _store(self.folder)
        out = []
        for file, to in end.items():
            if start.get(file) == to:
                continue
            stop, first = int(to.split(" ")[0]), 0
            if file in start:
                first, size, head = start[file].split(" ")
                first = int(first)
                with store.open_input_file(f"{root.rstrip('/')}/{file}") as stream:
                    first = first if first <= stop and _head(stream, int(size)) == head else 0
            out += [Range(file, first, low, min(low + self.chunk, stop), stop) for low in range(first, stop, self.chunk)]
        return out

    def read(self, partition: Range):
        store, root = _store(self.folder)
        with io.BufferedReader(store.open_input_file(f"{root.rstrip('/')}/{partition.file}"), BLOCK) as stream:
            at = partition.low
            if at > partition.first:  # the line that the byte before belongs to is the former task's
                at -= 1
                stream.seek(at)
                at += len(stream.readline())
            stream.seek(at)
            while at < min(partition.high, partition.end):
                line = stream.readline()
                if not line.endswith(b"\n"):
                    break
                text = line.decode("utf-8", "replace").rstrip("\r\n")
                if text.strip():
                    yield partition.file, at, text
                at += len(line)


def _last_line_end(stream, size: int) -> int:
    """Bytes up to and with the last newline, searched backwards."""
    at = size
    while at > 0:
        low = max(0, at - BLOCK)
        stream.seek(low)
        found = stream.read(at - low).rfind(b"\n")
        if found >= 0:
            return low + found + 1
        at = low
    return 0


class JournalSource(DataSource):
    """``spark.readStream.format("journal").load(folder)``, once registered: (file, at, raw), at being the line's first byte."""

    @classmethod
    def name(cls) -> str:
        return "journal"

    def schema(self) -> str:
        return SCHEMA

    def streamReader(self, schema) -> JournalReader:
        return JournalReader(self.options)


def parsed(rows: DataFrame) -> DataFrame:
    """``rows(raw)`` with value, the parsed JSON, and ok: whether it is an object."""
    rows = rows.withColumn("value", F.expr("try_parse_json(raw)"))
    return rows.withColumn("ok", F.coalesce(F.expr("startswith(schema_of_variant(value), 'OBJECT')"), F.lit(False)))


def tail_journal(spark: SparkSession, folder: str, **options: str) -> DataFrame:
    """A stream of (file, at, raw, value, ok) of the JSON-lines logs below a folder, hidden files and folders left out.

    Lines appended to a file arrive once, when they are complete; malformed ones with ok = false. Its checkpoint resumes at each file's byte.
    """
    spark.dataSource.register(JournalSource)
    return parsed(spark.readStream.format("journal").options(**options).load(folder))


def harvest(rows: DataFrame) -> DataFrame:
    """(file, entries, invalid, uses) of journal rows: an entry is valid as an object with a text ``instruction`` and steps, each a text or with a ``cmd``."""
    steps = F.expr("try_variant_get(value, '$.steps', 'array<variant>')")
    named = lambda s: F.coalesce(F.when(F.schema_of_variant(s) == "STRING", F.try_variant_get(s, "$", "string")), F.try_variant_get(s, "$.cmd", "string"), F.lit(""))
    some = F.exists(F.coalesce(steps, F.array()), lambda s: F.trim(named(s)) != "")
    said = F.when(F.expr("schema_of_variant(try_variant_get(value, '$.instruction', 'variant'))") == "STRING", F.expr("try_variant_get(value, '$.instruction', 'string')"))
    fine = F.col("ok") & F.coalesce(F.trim(said) != "", F.lit(False)) & some
    return rows.groupBy("file").agg(F.count("*").alias("entries"), F.count_if(~fine).alias("invalid"), F.count_if(fine).alias("uses"))
