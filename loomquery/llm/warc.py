"""WARC archives: a deterministic sharded writer with revisit records, and a reader."""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib
from functools import reduce
from urllib.parse import quote

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ._common import broadcast_checked, materialize, new_path, table

DATE = "2024-01-01T00:00:00Z"
#: Payload bytes that a range of keys aims at, compressed bytes at which a file is closed.
RANGE_BYTES, FILE_BYTES = 64 << 20, 32 << 20
#: Cells that the first histogram of ids has for each range, as bits, bits that a further level adds, and bits of the first level at most.
SLACK_BITS, LEVEL_BITS, FIRST_BITS = 3, 8, 22
#: Tasks of the writer and the reader, at most.
TASKS = 20_000
LEVEL = 6


def base32_sha1(raw: bytes) -> str:
    return base64.b32encode(hashlib.sha1(raw).digest()).decode()


def record_id(page_id: int | None, digest: str) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'page:{page_id}:{digest}')}>"


def record(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None) -> bytes:
    """One WARC/1.1 record with headers and digests made anew; a revisit has HTTP headers but no payload."""
    digest = base32_sha1(payload)
    target = quote(url, safe="%/:?#[]@!$&'()*+,;=~-._") if url else f"urn:page:{page_id}"
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if refers_to is not None else http + payload
    head = [
        "WARC/1.1",
        f"WARC-Type: {'response' if refers_to is None else 'revisit'}",
        f"WARC-Record-ID: {record_id(page_id, digest)}",
        f"WARC-Date: {DATE}",
        f"WARC-Target-URI: {target}",
        f"WARC-Payload-Digest: sha1:{digest}",
        f"WARC-Block-Digest: sha1:{base32_sha1(block)}",
        "Content-Type: application/http; msgtype=response",
        f"Content-Length: {len(block)}",
        f"Page-ID: {'' if page_id is None else page_id}",
    ]
    if refers_to is not None:
        head += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: {record_id(refers_to, digest)}", f"Refers-To-Page-ID: {refers_to}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


class _Files:
    """Writes gzip members into files under temporary names of this attempt alone."""

    def __init__(self, root: str, limit: int):
        self.fs, self.root = fs.FileSystem.from_uri(root)
        self.fs.create_dir(self.root, recursive=True)
        self.limit, self.out, self.done = limit, None, []

    def add(self, shard: int, data: bytes, page_id: int | None):
        if self.out and (self.shard != shard or self.size + len(data) > self.limit):
            self.close()
        if not self.out:
            self.part = self.part + 1 if getattr(self, "shard", None) == shard else 0
            self.shard, self.size, self.rows, self.first, self.sha = shard, 0, 0, page_id, hashlib.sha256()
            self.temp = f"{self.root}/.{uuid.uuid4().hex}.tmp"
            self.out = self.fs.open_output_stream(self.temp, compression=None)
        self.out.write(data)
        self.sha.update(data)
        self.size, self.rows, self.last = self.size + len(data), self.rows + 1, page_id

    def close(self):
        if self.out:
            self.out.close()
            name = f"pages-{self.shard:06d}-{self.part:04d}.warc.gz"
            self.done.append((self.temp.rpartition("/")[2], name, self.size, self.rows, self.first, self.last, self.sha.hexdigest()))
            self.out = None


_MANIFEST = "file string, bytes bigint, records bigint, first_id bigint, last_id bigint, sha256 string"
_WRITTEN = f"temp string, {_MANIFEST}"


def _writer(root: str, limit: int):
    def run(batches):
        files, flags, at = _Files(root, limit), {}, None
        for batch in batches:
            shard, page, kind, url, html, ref, digest = (batch.column(i) for i in range(7))
            for i in range(batch.num_rows):
                page_id = page[i].as_py()
                if page_id != at:
                    flags, at = {}, page_id
                if kind[i].as_py() == 0:  # what the records of this page refer to comes before them
                    flags[digest[i].as_py()] = ref[i].as_py()
                    continue
                payload = html[i].as_py() or b""
                target = flags.get(hashlib.sha1(payload).hexdigest()) if flags else None
                pack = zlib.compressobj(LEVEL, zlib.DEFLATED, 31)
                files.add(shard[i].as_py(), pack.compress(record(page_id, url[i].as_py(), payload, target)) + pack.flush(), page_id)
        files.close()
        cols = list(zip(*files.done)) if files.done else [()] * 7
        types = (pa.string(), pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string())
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types)], ["temp", "file", "bytes", "records", "first_id", "last_id", "sha256"])

    return run


def _publish(root: str):
    """Renames the written files to their final names; a retry finds those that an attempt before it has renamed."""

    def run(batches):
        files, base = fs.FileSystem.from_uri(root)
        for batch in batches:
            for temp, name in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if files.get_file_info(f"{base}/{temp}").type == fs.FileType.File:
                    files.move(f"{base}/{temp}", f"{base}/{name}")
                elif files.get_file_info(f"{base}/{name}").type != fs.FileType.File:
                    raise FileNotFoundError(f"{base}/{temp}")
            yield pa.RecordBatch.from_arrays(batch.columns[1:], batch.schema.names[1:])

    return run


def id_ranges(rows: DataFrame, range_bytes: int) -> tuple[list[tuple[int, DataFrame]], int]:
    """([(shift, table(cell, shard))], least id): consecutive ids whose payloads sum up to about ``range_bytes`` have one shard.

    A cell is a prefix of id - least id, as an unsigned number without its lowest ``shift`` bits. Cells of more than
    ``range_bytes`` are split on further bits, alone, until they hold less or one id; so an outlying id costs a level
    and no balance. The shards depend on the rows alone. Null ids are in no cell.
    """
    lo, hi, total = rows.agg(F.min("page_id"), F.max("page_id"), F.sum(F.octet_length("payload"))).first()
    if lo is None:
        return [], 0
    bits = (hi - lo).bit_length()
    shift = bits - min(bits, FIRST_BITS, SLACK_BITS + (total // range_bytes).bit_length())
    sizes = rows.where("page_id is not null").groupBy(_offset(lo).alias("u")).agg(F.sum(F.octet_length("payload")).alias("b"))
    sizes, levels = materialize(sizes, "warc-sizes"), []
    pending = sizes
    while True:
        cells = materialize(pending.groupBy(F.shiftrightunsigned("u", shift).alias("cell")).agg(F.sum("b").alias("b")), "warc-cells")
        over = cells.where((F.col("b") > range_bytes) & F.lit(shift > 0)).select(F.col("cell").alias("over"))
        levels.append((shift, cells.join(over, F.col("cell") == F.col("over"), "left_anti")))
        if not shift or over.isEmpty():
            break
        pending = pending.join(over, F.shiftrightunsigned("u", shift) == F.col("over"), "left_semi")
        shift = max(0, shift - LEVEL_BITS)
    every = reduce(DataFrame.union, (cells.select(F.lit(s).alias("shift"), "cell", F.shiftleft("cell", s).alias("start"), "b") for s, cells in levels))
    # one number a cell, 8 cells a range or so, in one task: starts are compared as unsigned numbers
    before = F.coalesce(F.sum("b").over(Window.orderBy(F.shiftrightunsigned("start", 1), F.col("start").bitwiseAND(F.lit(1))).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    shards = materialize(every.select("shift", "cell", F.floor(before / range_bytes).cast("bigint").alias("shard")), "warc-shards")
    return [(s, shards.where(F.col("shift") == s).select(F.col("cell").alias(f"cell{s}"), F.col("shard").alias(f"shard{s}"))) for s, _ in levels], lo


def _offset(lo: int) -> Column:
    """id - lo modulo 2 ** 64."""
    return F.expr(f"cast((cast(page_id as decimal(20,0)) - {lo}BD + 9223372036854775808BD) % 18446744073709551616BD - 9223372036854775808BD as bigint)")


def revisits(pages: DataFrame, min_bytes: int = 0) -> DataFrame:
    """(page_id, digest, ref) of each page whose payload a page of larger id has too; payloads are not shuffled."""
    meta = pages.select("page_id", F.sha1("payload").alias("digest"), F.octet_length("payload").alias("n")).where(F.col("n") >= min_bytes)
    last = meta.groupBy("digest").agg(F.max("page_id").alias("ref"), F.count("*").alias("c")).where("c > 1").drop("c")
    return meta.join(last, "digest").where("page_id < ref").select("page_id", "digest", "ref").distinct()


def write_warc(pages: DataFrame, root: str, min_bytes: int = 0, range_bytes: int = RANGE_BYTES, file_bytes: int = FILE_BYTES) -> DataFrame:
    """Writes ``pages(page_id, url, html)`` as WARC files under ``root``; returns the committed manifest.

    Of equal payloads of at least ``min_bytes`` bytes, the page with the largest id is a response and
    those with smaller ids revisit it; repeated rows of that largest id are all responses. Records are
    sorted by page id, and ranges of about ``range_bytes`` payload form shards (``id_ranges``). Names and contents depend on
    the rows and parameters alone. A shard's files roll at ``file_bytes`` compressed bytes (a larger record has a file
    of its own). Tasks write under temporary names of their own; Spark commits the list of what finished tasks wrote, the
    files on it are renamed, and the manifest is committed last: the archive is what it lists. Null html is
    empty, a null url becomes urn:page:<id>, a null page id sorts first. An empty table gives an empty manifest.
    """
    rows = pages.select(F.col("page_id").cast("bigint").alias("page_id"), F.col("url").cast("string").alias("url"), F.coalesce(F.col("html").cast("string").cast("binary"), F.lit(b"")).alias("payload"))
    same = revisits(rows, min_bytes)
    levels, lo = id_ranges(rows, range_bytes)
    none = F.lit(None)
    placed = rows.select("page_id", F.lit(1).alias("kind"), "url", "payload", none.cast("bigint").alias("ref"), none.cast("string").alias("digest")).union(
        same.select("page_id", F.lit(0), none.cast("string"), none.cast("binary"), "ref", "digest")
    )
    for shift, shards in levels:
        placed = placed.join(broadcast_checked(shards, F.lit(40)), F.shiftrightunsigned(_offset(lo), shift) == F.col(f"cell{shift}"), "left").drop(f"cell{shift}")
    shard = F.coalesce(*(f"shard{shift}" for shift, _ in levels), F.lit(0).cast("bigint"))
    placed = placed.select(shard.alias("shard"), "page_id", "kind", "url", "payload", "ref", "digest")
    ranges = max([1, *(shards.agg(F.coalesce(F.max(f"shard{s}"), F.lit(0))).first()[0] + 1 for s, shards in levels)])
    order = ["shard", "page_id", "kind", F.col("url"), F.sha1("payload")]
    spark = pages.sparkSession
    tasks = min(ranges, TASKS)
    placed = placed.repartitionById(tasks, F.pmod("shard", F.lit(tasks)).cast("int"))  # a task a shard; hashes of few shards collide
    done = placed.sortWithinPartitions(*order).mapInArrow(_writer(f"{root}/data", file_bytes), _WRITTEN)
    done.write.parquet(f"{root}/written")
    written = spark.read.schema(_WRITTEN).parquet(f"{root}/written")
    written.mapInArrow(_publish(f"{root}/data"), _MANIFEST).write.parquet(f"{root}/manifest")
    return spark.read.schema(_MANIFEST).parquet(f"{root}/manifest")


def _members(stream):
    """The decompressed gzip members of a stream, one record each."""
    data, pack, out = b"", zlib.decompressobj(31), []
    while True:
        data = data or stream.read(1 << 20)
        if not data:
            return
        out.append(pack.decompress(data))
        data = pack.unused_data
        if pack.eof:
            yield b"".join(out)
            pack, out = zlib.decompressobj(31), []


def parse(raw: bytes) -> tuple:
    """(page_id, payload_bytes, digest, type, refers_to) of a record; raises ValueError if a digest or length is wrong."""
    head, _, rest = raw.partition(b"\r\n\r\n")
    fields = dict(x.split(": ", 1) if ": " in x else (x.rstrip(":"), "") for x in head.decode().split("\r\n")[1:])
    block = rest[: int(fields["Content-Length"])]
    if f"sha1:{base32_sha1(block)}" != fields["WARC-Block-Digest"]:
        raise ValueError(f"block digest of {fields['WARC-Record-ID']} is wrong")
    http, _, payload = block.partition(b"\r\n\r\n")
    n = int(http.rpartition(b"Content-Length: ")[2])
    digest = fields["WARC-Payload-Digest"].removeprefix("sha1:")
    if fields["WARC-Type"] == "response" and (len(payload) != n or base32_sha1(payload) != digest):
        raise ValueError(f"payload of {fields['WARC-Record-ID']} is wrong")
    ref = fields.get("Refers-To-Page-ID")
    return int(fields["Page-ID"]) if fields["Page-ID"] else None, n, digest, fields["WARC-Type"], int(ref) if ref else None


def read_warc(manifest: DataFrame, root: str) -> DataFrame:
    """One row for each record of the files that the manifest lists; record by record, files in parallel."""

    def run(batches):
        files, base = fs.FileSystem.from_uri(f"{root}/data")
        for batch in batches:
            for name in batch.column(0).to_pylist():
                rows = []
                with files.open_input_stream(f"{base}/{name}", compression=None) as stream:
                    for raw in _members(stream):
                        rows.append(parse(raw))
                        if len(rows) == 10_000:
                            yield _batch(rows)
                            rows = []
                yield _batch(rows)

    files = manifest.select("file")
    files = files.repartition(max(1, min(files.count(), TASKS)))
    return files.mapInArrow(run, "page_id bigint, payload_bytes bigint, payload_digest string, record_type string, refers_to bigint")


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    cols = list(zip(*rows)) if rows else [()] * 5
    types = (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64())
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types)], ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"])


def op3_warc_archive(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every row of ``pages`` written to WARC files and read back from them; cases as in ``write_warc``."""
    root = new_path(spark, "warc")
    return read_warc(write_warc(table(spark, sf_dir, "pages"), root), root)
