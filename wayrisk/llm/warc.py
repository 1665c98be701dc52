"""WARC archives with a two-level capture index.

Pages become WARC records, each a gzip member of its own; a page whose payload an earlier page
has becomes a revisit.  The capture index holds one line per record, sorted by the URL's
reversed-host key: level one are blocks of lines, each compressed on its own, in index files of
one key range each; level two is the sparse directory of an index file, the first key, offset
and length of every block.  A look-up goes to the index file of its key range, searches the
directory by bisection, reads that block alone, and then the record by its byte range.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import json
import uuid
import zlib
from bisect import bisect_right
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wayrisk.llm.common import lower_ascii, open_store, shared_folder, written


@dataclass(frozen=True)
class Settings:
    """``min_payload``: bytes from which equal payloads become revisits."""

    min_payload: int = 0
    archive_bytes: int = 1 << 30  # an archive file ends after the record that reaches this
    block_lines: int = 500
    level: int = 4
    date: str = "2020-01-01T00:00:00Z"  # the pages carry no capture time


REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
ROWS_AT_ONCE = 64
CAPTURE = "surt string, date string, page_id long, record_type string, digest string, file string, offset long, length long"
_CAPTURE_ARROW = pa.schema([(n, pa.int64() if t == "long" else pa.string()) for n, t in (f.split() for f in CAPTURE.split(", "))])


def surt(url: Column) -> Column:
    """Sort key: host labels reversed and joined by commas, `)`, then the rest; null and URLs without `://` as they are."""
    url = F.coalesce(url, F.lit(""))
    rest = url.substr(F.locate("://", url) + F.lit(3), F.length(url))  # behind the first one: others belong to the rest
    host = lower_ascii(F.regexp_extract(rest, "^[^/?#]*", 0))
    tail = F.regexp_replace(rest, "^[^/?#]*", "")
    return F.when(url.contains("://"), F.concat(F.array_join(F.reverse(F.split(host, "[.]")), ","), F.lit(")"), tail)).otherwise(url)


def with_first_copies(pages: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """``page_id, url, html`` plus ``refers_to``: the smallest page with the same payload, null for that page itself.

    Payloads are compared by SHA-1 and length.  Null and empty payloads are equal.  Pages
    without an id are responses, and so is every page of a payload below ``min_payload``.
    """
    body = F.coalesce("html", F.lit(""))
    rows = pages.select("page_id", "url", body.alias("html"), F.sha1(body.cast("binary")).alias("sha1"), F.octet_length(body).alias("bytes"))
    firsts = rows.groupBy("sha1", "bytes").agg(F.min("page_id").alias("first"), F.count(F.lit(1)).alias("n"))
    shared = firsts.where((F.col("n") > 1) & (F.col("bytes") >= settings.min_payload)).drop("n")
    joined = rows.join(shared, ["sha1", "bytes"], "left")
    return joined.select("page_id", "url", "html", F.when(F.col("first") != F.col("page_id"), F.col("first")).alias("refers_to"))


# --- records ------------------------------------------------------------------
def record_id(page_id: int | None) -> str:
    return f"<urn:page:{page_id}>" if page_id is not None else f"<urn:uuid:{uuid.uuid4()}>"


def page_of(record: str | None) -> int | None:
    return int(record[len("<urn:page:") : -1]) if record and record.startswith("<urn:page:") else None


def header_url(url: str) -> str:
    """Control characters would end a header line; they are percent-encoded."""
    return "".join(f"%{ord(c):02X}" if c < " " or c == "\x7f" else c for c in url)


def record(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None, settings: Settings) -> tuple[bytes, str]:
    """One WARC record and its payload digest."""
    digest = base64.b32encode(hashlib.sha1(payload).digest()).decode()
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http + (payload if refers_to is None else b"")
    head = [("WARC-Type", "response" if refers_to is None else "revisit"), ("WARC-Record-ID", record_id(page_id)), ("WARC-Date", settings.date)]
    if url is not None:
        head.append(("WARC-Target-URI", header_url(url)))
    head.append(("WARC-Payload-Digest", f"sha1:{digest}"))
    if refers_to is not None:
        head += [("WARC-Profile", REVISIT_PROFILE), ("WARC-Refers-To", record_id(refers_to))]
    head += [("Content-Type", "application/http; msgtype=response"), ("Content-Length", str(len(block)))]
    lines = "WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in head) + "\r\n"
    return lines.encode("utf-8", "replace") + block + b"\r\n\r\n", digest


def parse_record(raw: bytes) -> dict:
    """Headers, payload, its size and digest of one record.

    A response's digest and size are computed from its payload, a revisit's are the ones it states.
    """
    head, _, rest = raw.partition(b"\r\n\r\n")
    fields = dict(line.split(": ", 1) for line in head.decode("utf-8", "replace").split("\r\n")[1:])
    block = rest[: int(fields["Content-Length"])]
    http, _, payload = block.partition(b"\r\n\r\n")
    revisit = fields["WARC-Type"] == "revisit"
    sizes = [int(line.split(b":")[1]) for line in http.split(b"\r\n") if line.lower().startswith(b"content-length:")]
    digest = fields["WARC-Payload-Digest"].removeprefix("sha1:") if revisit else base64.b32encode(hashlib.sha1(payload).digest()).decode()
    return {
        "page_id": page_of(fields["WARC-Record-ID"]), "url": fields.get("WARC-Target-URI"), "date": fields["WARC-Date"], "record_type": fields["WARC-Type"],
        "refers_to": page_of(fields.get("WARC-Refers-To")), "payload_bytes": sizes[0] if revisit else len(payload), "payload_digest": digest, "payload": None if revisit else payload,
    }


def write_archives(pages: DataFrame, folder: str, settings: Settings = Settings()) -> DataFrame:
    """Write the pages as WARC files below ``folder``; returns their captures (``CAPTURE``).

    A retried task writes files of other names; captures name those of its finished attempt.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, root = open_store(folder)
        file, name, at = None, "", 0
        for batch in batches:
            for begin in range(0, batch.num_rows, ROWS_AT_ONCE):  # few payloads at a time as Python strings
                found = []
                for row in batch.slice(begin, ROWS_AT_ONCE).to_pylist():
                    if file is None:
                        name, at = f"pages-{uuid.uuid4().hex}.warc.gz", 0
                        file = store.open_output_stream(f"{root}/{name}", compression=None)
                    raw, digest = record(row["page_id"], row["url"], row["html"].encode("utf-8", "replace"), row["refers_to"], settings)
                    member = gzip.compress(raw, settings.level, mtime=0)
                    file.write(member)
                    kind = "response" if row["refers_to"] is None else "revisit"
                    found.append({"surt": row["surt"], "date": settings.date, "page_id": row["page_id"], "record_type": kind, "digest": digest, "file": name, "offset": at, "length": len(member)})
                    at += len(member)
                    if at >= settings.archive_bytes:
                        file.close()
                        file = None
                yield pa.RecordBatch.from_pylist(found, _CAPTURE_ARROW)
        if file is not None:
            file.close()

    rows = with_first_copies(pages, settings).select("page_id", "url", "html", "refers_to", surt(F.col("url")).alias("surt"))
    return written(rows.mapInArrow(run, CAPTURE), "captures")


# --- index --------------------------------------------------------------------
def _key(surt_key: str, page_id: int | None) -> tuple[str, bool, int]:
    """Order of the index: pages without an id stand apart, before the others of their URL."""
    return surt_key, page_id is not None, page_id or 0


def write_index(captures: DataFrame, folder: str, settings: Settings = Settings()) -> DataFrame:
    """Write the index files; returns ``name, first_surt, first_page`` of each, one row per key range."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, root = open_store(folder)
        name, file, at, directory, lines = f"index-{uuid.uuid4().hex}", None, 0, [], []

        def close_block() -> None:
            nonlocal at
            data = zlib.compress("\n".join(json.dumps(x) for x in lines).encode())
            file.write(data)
            directory.append([lines[0]["surt"], lines[0]["page_id"], at, len(data)])
            at += len(data)
            lines.clear()

        for batch in batches:
            for row in batch.to_pylist():
                file = file or store.open_output_stream(f"{root}/{name}.blocks", compression=None)
                lines.append(row)
                if len(lines) >= settings.block_lines:
                    close_block()
        if lines:
            close_block()
        if file is not None:
            file.close()
            with store.open_output_stream(f"{root}/{name}.directory", compression=None) as out:
                out.write(json.dumps(directory).encode())
            yield pa.RecordBatch.from_pydict({"name": [name], "first_surt": [directory[0][0]], "first_page": [directory[0][1]]})

    ordered = captures.repartitionByRange("surt", "page_id").sortWithinPartitions("surt", "page_id")  # nulls first
    return written(ordered.mapInArrow(run, "name string, first_surt string, first_page long"), "index-files")


class _IndexFile:
    """Directory of one index file, and the block read last."""

    def __init__(self, store, root: str, name: str):
        with store.open_input_stream(f"{root}/{name}.directory") as file:
            self.directory = json.loads(file.read())
        self.firsts = [_key(d[0], d[1]) for d in self.directory]
        self.blocks, self.place, self.lines = store.open_input_file(f"{root}/{name}.blocks"), -1, {}

    def find(self, key: tuple[str, bool, int]) -> list[dict]:
        place = bisect_right(self.firsts, key) - 1
        found: list[dict] = []
        # equal keys (repeated rows, rows without an id) may begin in blocks before
        while place >= 0:
            self._load(place)
            found = self.lines.get(key, []) + found
            if self.firsts[place] < key:
                break
            place -= 1
        return found

    def _load(self, place: int) -> None:
        if place == self.place:
            return
        _, _, offset, length = self.directory[place]
        self.place, self.lines = place, {}
        for line in zlib.decompress(self.blocks.read_at(length, offset)).decode().split("\n"):
            row = json.loads(line)
            self.lines.setdefault(_key(row["surt"], row["page_id"]), []).append(row)


READ = "page_id long, url string, date string, record_type string, refers_to long, payload_bytes long, payload_digest string, payload binary"
_READ_ARROW = pa.schema([(n, {"long": pa.int64(), "string": pa.string(), "binary": pa.binary()}[t]) for n, t in (f.split() for f in READ.split(", "))])


def look_up(wanted: DataFrame, folder: str, index: DataFrame, with_payload: bool = True) -> DataFrame:
    """Records (``READ``) of the captures of ``wanted`` (``surt, page_id``, distinct), read by byte range.

    The list of index files, one key each, is what the driver holds; directories are read by
    the tasks that need them.  What they find is sorted by archive and offset and dealt by range,
    so a task opens few archives, each once, and reads it forwards.
    """
    files = sorted((_key(r["first_surt"], r["first_page"]), r["name"]) for r in index.collect())
    firsts, names = [f[0] for f in files], [f[1] for f in files]

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys = [_key(s, p) for s, p in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True)]
            parts = [max(0, bisect_right(firsts, k) - 1) for k in keys]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(parts, pa.int32())], names=["surt", "page_id", "part"])

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, root = open_store(folder)
        part, index_file = -1, None
        for batch in batches:
            hits = []
            for row in batch.to_pylist():
                if row["part"] != part:
                    if index_file is not None:
                        index_file.blocks.close()
                    part, index_file = row["part"], _IndexFile(store, root, names[row["part"]])
                hits += [(hit["file"], hit["offset"], hit["length"]) for hit in index_file.find(_key(row["surt"], row["page_id"]))]
            columns = zip(*hits, strict=True) if hits else ([], [], [])
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.string(), pa.int64(), pa.int64()), strict=True)], names=["file", "offset", "length"])

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, root = open_store(folder)
        name, archive = None, None
        for batch in batches:
            for at in range(0, batch.num_rows, ROWS_AT_ONCE):
                out = []
                for file, offset, length in zip(*[c.to_pylist() for c in batch.slice(at, ROWS_AT_ONCE).columns], strict=True):
                    if file != name:
                        if archive is not None:
                            archive.close()
                        name, archive = file, store.open_input_file(f"{root}/{file}")
                    found = parse_record(gzip.decompress(archive.read_at(length, offset)))
                    out.append(found if with_payload else found | {"payload": None})
                yield pa.RecordBatch.from_pylist(out, _READ_ARROW)
        if archive is not None:
            archive.close()

    if not files:
        return wanted.sparkSession.createDataFrame([], READ)
    placed = wanted.select("surt", "page_id").mapInArrow(place, "surt string, page_id long, part int")
    dealt = placed.repartition(max(1, len(files)), "part").sortWithinPartitions("part", "surt", "page_id")
    hits = written(dealt.mapInArrow(find, "file string, offset long, length long"), "capture-hits")
    tasks = int(wanted.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return hits.repartitionByRange(tasks, "file", "offset").sortWithinPartitions("file", "offset").mapInArrow(read, READ)


def round_trip(pages: DataFrame, settings: Settings = Settings(), with_payload: bool = False) -> DataFrame:
    """Write ``page_id, url, html`` as archives and index, look every page up and read it back."""
    folder = shared_folder(pages.sparkSession, "warc")
    store, root = open_store(folder)
    store.create_dir(root, recursive=True)
    captures = write_archives(pages, folder, settings)
    index = write_index(captures, folder, settings)
    wanted = pages.select(surt(F.col("url")).alias("surt"), "page_id").distinct()
    return look_up(wanted, folder, index, with_payload)
