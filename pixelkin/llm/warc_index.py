"""WARC archives with a two-level capture index.

Every page becomes one gzip member of an archive, one archive per task. Captures are then sorted by their key, the URL with
its host reversed and the page id after it, by ranges: each range writes compressed blocks of sorted lines and, at its
end, a sparse directory with the first key of every block. One row per range (first key, file) leads to the directories.

Reading goes the same way back: a key picks its range by binary search, then its block in that range's directory, reads
the bytes of that block only, finds its line, and reads the bytes of its record only. Keys are looked up in order, so each
block is read once.

Of records with equal payloads the one with the smallest page id is a response and the others revisit it; payloads below
``least_bytes`` are always responses. A lost task writes its files anew under other names; only files named by stored rows are read.

Defined results: null html is the empty payload; a null URL has the key "-"; rows that repeat the smallest page id of their payload
are responses too; a null page id counts as larger than all others; an empty table gives an empty one.
"""

from __future__ import annotations

import base64
import hashlib
import json
import uuid
import zlib
from bisect import bisect_right
from urllib.parse import urlsplit

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pixelkin.session import materialize, scratch_dir

BLOCK_LINES = 1000
#: The capture date of pages that come without one.
DATE = "2000-01-01T00:00:00Z"


def _place(path: str) -> tuple[fs.FileSystem, str]:
    """File system and inner path; ``file:/x`` and ``file:///x`` are local."""
    if path.startswith("file:/"):
        return fs.LocalFileSystem(), "/" + path[5:].lstrip("/")
    return fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path)


def capture_key(url: str | None, page_id: int | None) -> str:
    """Reversed host, path and query, page id: captures of one URL follow each other."""
    if url is None:
        return f"- {page_id}"
    try:
        parts = urlsplit(url)
        host, port = parts.hostname or "", parts.port
    except ValueError:
        return f"{url.replace(chr(10), ' ')} {page_id}"
    host = ",".join(reversed(host.split("."))) + (f":{port}" if port else "")
    rest = (parts.path or "/") + (f"?{parts.query}" if parts.query else "")
    return f"{host}){rest} {page_id}".replace("\n", " ")


def _record(url: str | None, page_id, first, digest: str, payload: bytes) -> bytes:
    """One WARC record; ``first`` is the page that a revisit refers to."""
    kind = "response" if first is None else "revisit"
    head = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    body = head + (payload if first is None else b"")
    target = (url or "").replace("\r", "%0D").replace("\n", "%0A")
    lines = [
        "WARC/1.1",
        f"WARC-Type: {kind}",
        f"WARC-Record-ID: <urn:page:{page_id}>",
        f"WARC-Date: {DATE}",
        f"WARC-Target-URI: {target}",
        f"WARC-Payload-Digest: sha1:{digest}",
        f"Content-Type: application/http; msgtype=response",
        f"Content-Length: {len(body)}",
    ]
    if first is not None:
        lines += [
            "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest",
            f"WARC-Refers-To: <urn:page:{first}>",
        ]
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + body + b"\r\n\r\n"


def parse_record(member: bytes) -> tuple[dict[str, str], dict[str, str], bytes]:
    """(WARC headers, HTTP headers, payload) of one gzip member."""
    record = zlib.decompress(member, 31)
    head, _, rest = record.partition(b"\r\n\r\n")
    fields = dict(line.split(": ", 1) for line in head.decode().split("\r\n")[1:])
    body = rest[: int(fields["Content-Length"])]
    http, _, payload = body.partition(b"\r\n\r\n")
    return fields, dict(line.split(": ", 1) for line in http.decode().split("\r\n")[1:]), payload


def _gzip(data: bytes) -> bytes:
    pack = zlib.compressobj(3, zlib.DEFLATED, 31)
    return pack.compress(data) + pack.flush()


def _write_archives(folder: str, kind: str):
    names = ["key", "page_id", "archive", "at", "size"]

    def run(batches):
        system, inner = _place(folder)
        name = f"{uuid.uuid4().hex}.warc.gz"
        out, at = None, 0
        try:
            for batch in batches:
                if batch.num_rows and out is None:
                    out = system.open_output_stream(f"{inner}/{name}", compression=None)
                rows = []
                for page, url, html, sha, first in zip(*(batch.column(k).to_pylist() for k in range(5))):
                    digest = base64.b32encode(bytes.fromhex(sha)).decode()
                    member = _gzip(_record(url, page, first, digest, (html or "").encode()))
                    out.write(member)
                    rows.append((capture_key(url, page), page, name, at, len(member)))
                    at += len(member)
                kinds = [pa.string(), batch.column(0).type, pa.string(), pa.int64(), pa.int64()]
                columns = list(zip(*rows)) or [()] * 5
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names)
        finally:
            if out is not None:
                out.close()

    return run


def write_archives(pages: DataFrame, folder: str, least_bytes: int = 0) -> DataFrame:
    """Archives of ``pages`` (page_id, url, html) in ``folder``; stored rows (key, page_id, archive, at, size)."""
    payload = F.encode(F.coalesce(F.col("html"), F.lit("")), "UTF-8")
    digested = pages.select("page_id", "url", "html", F.sha1(payload).alias("sha"), F.octet_length(payload).alias("_bytes"))
    # Digests are counted in the tasks first; only those of several records are kept. Spark sees the size of that table.
    several = (
        digested.where(F.col("_bytes") >= least_bytes)
        .groupBy("sha").agg(F.min("page_id").alias("first"), F.count("*").alias("n")).where("n > 1").drop("n")
    )
    several = materialize(several, "payloads")
    joined = digested.join(several, "sha", "left")
    refers = F.when(~F.coalesce(F.col("page_id") == F.col("first"), F.col("first").isNull()), F.col("first"))
    kind = pages.schema["page_id"].dataType.simpleString()
    _ensure(folder)
    return materialize(
        joined.select("page_id", "url", "html", "sha", refers.alias("first")).mapInArrow(
            _write_archives(folder, kind), f"key string, page_id {kind}, archive string, at long, size long"
        ),
        "captures",
    )


def _ensure(folder: str) -> None:
    system, inner = _place(folder)
    system.create_dir(inner, recursive=True)


def _write_index(folder: str):
    def run(batches):
        system, inner = _place(folder)
        name, first, directory, lines, at, out = f"{uuid.uuid4().hex}.idx", None, [], [], 0, None

        def flush():
            nonlocal at
            block = zlib.compress("\n".join(lines).encode(), 6)
            directory.append((json.loads(lines[0])[0], at, len(block)))
            out.write(block)
            at += len(block)
            lines.clear()

        try:
            for batch in batches:
                for key, archive, offset, size in zip(*(batch.column(k).to_pylist() for k in range(4))):
                    if out is None:
                        out, first = system.open_output_stream(f"{inner}/{name}", compression=None), key
                    lines.append(json.dumps([key, archive, offset, size]))
                    if len(lines) == BLOCK_LINES:
                        flush()
            if lines:
                flush()
            if out is not None:
                tail = zlib.compress(json.dumps(directory).encode())
                out.write(tail)
                yield pa.RecordBatch.from_pydict({"first": [first], "index": [name], "at": [at], "size": [len(tail)]})
        finally:
            if out is not None:
                out.close()

    return run


def write_index(captures: DataFrame, folder: str) -> list[tuple[str, str, int, int]]:
    """The index of ``captures`` in ``folder``: (first key, file, place and size of its directory) of every range, in order."""
    parts = int(captures.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = captures.select("key", "archive", "at", "size").repartitionByRange(parts, "key").sortWithinPartitions("key")
    ranges = materialize(ranged.mapInArrow(_write_index(folder), "first string, index string, at long, size long"), "ranges")
    # One row for each range, as many as the session has shuffle partitions.
    return sorted(tuple(r) for r in ranges.collect())


class _Reader:
    """Looks keys up in order; keeps the directory and the block that served the key before."""

    def __init__(self, folder: str, ranges: list[tuple[str, str, int, int]]) -> None:
        self.system, self.inner = _place(folder)
        self.ranges, self.starts = ranges, [r[0] for r in ranges]
        self.files: dict[str, object] = {}
        self.directory: tuple = (None, [], [])
        self.block: tuple = (None, {})

    def read(self, name: str, at: int, size: int) -> bytes:
        if name not in self.files:
            if len(self.files) > 64:
                self.files.pop(next(iter(self.files))).close()
            self.files[name] = self.system.open_input_file(f"{self.inner}/{name}")
        return self.files[name].read_at(size, at)

    def find(self, key: str) -> list[tuple[str, int, int]]:
        """(archive, place, size) of every capture with the key."""
        found, k = [], bisect_right(self.starts, key) - 1
        while k >= 0:
            _, index, at, size = self.ranges[k]
            if self.directory[0] != index:
                entries = json.loads(zlib.decompress(self.read(index, at, size)))
                self.directory = (index, entries, [e[0] for e in entries])
            _, entries, firsts = self.directory
            b = bisect_right(firsts, key) - 1
            while b >= 0:
                _, place, length = entries[b]
                if self.block[0] != (index, place):
                    lines: dict[str, list] = {}
                    for line in zlib.decompress(self.read(index, place, length)).decode().split("\n"):
                        name, *rest = json.loads(line)
                        lines.setdefault(name, []).append(tuple(rest))
                    self.block = ((index, place), lines)
                found += self.block[1].get(key, [])
                if firsts[b] != key:
                    return found
                b -= 1
            # Equal keys may begin in the range before.
            k -= 1
        return found


def _valid(fields: dict, http: dict, payload: bytes) -> bool | None:
    """Whether a response's payload has the digest and length that its record states."""
    if fields["WARC-Type"] != "response":
        return None
    digest = base64.b32encode(hashlib.sha1(payload).digest()).decode()
    return fields["WARC-Payload-Digest"] == f"sha1:{digest}" and int(http["Content-Length"]) == len(payload)


def _page_of(urn: str | None) -> int | None:
    return None if urn is None or urn.endswith(":None>") else int(urn[len("<urn:page:") : -1])


def _read_back(folder: str, ranges: list, payloads: bool):
    names = ["page_id", "url", "payload_digest", "payload_bytes", "record_type", "refers_to", "payload_valid"]
    names += ["payload"] * payloads

    def run(batches):
        reader = _Reader(folder, ranges)
        current, places = None, []
        for batch in batches:
            rows = []
            for page, key in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                # Rows with one key follow each other, across batches too, and take its captures one after the other.
                if key != current:
                    current, places = key, list(reader.find(key))
                fields, http, payload = parse_record(reader.read(*places[0]))
                if len(places) > 1:
                    places.pop(0)
                row = (
                    page, fields["WARC-Target-URI"], fields["WARC-Payload-Digest"].removeprefix("sha1:"),
                    int(http["Content-Length"]), fields["WARC-Type"], _page_of(fields.get("WARC-Refers-To")),
                    _valid(fields, http, payload),
                )
                rows.append((*row, payload) if payloads else row)
            of_id = batch.column(0).type
            kinds = [of_id, pa.string(), pa.string(), pa.int64(), pa.string(), of_id, pa.bool_(), pa.binary()]
            columns = list(zip(*rows)) or [()] * len(names)
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names)

    return run


def read_captures(
    keys: DataFrame, folder: str, ranges: list[tuple[str, str, int, int]], payloads: bool = True
) -> DataFrame:
    """Records of ``keys`` (page_id, key) through the index: url, the record's own fields, and the payload if wanted.

    ``payload_valid`` tells whether a response's payload has the digest and length that its record states.
    """
    kind = keys.schema["page_id"].dataType.simpleString()
    parts = int(keys.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ordered = keys.select("page_id", "key").repartitionByRange(parts, "key").sortWithinPartitions("key")
    return ordered.mapInArrow(
        _read_back(folder, ranges, payloads),
        f"page_id {kind}, url string, payload_digest string, payload_bytes long, record_type string, refers_to {kind}, "
        "payload_valid boolean" + ", payload binary" * payloads,
    )


def archived(pages: DataFrame, least_bytes: int = 0, payloads: bool = True) -> DataFrame:
    """``pages`` written to archives with an index, and every capture read back through it."""
    folder = f"{scratch_dir(pages.sparkSession)}/warc-{uuid.uuid4().hex}"
    captures = write_archives(pages, folder, least_bytes)
    return read_captures(captures, folder, write_index(captures, folder), payloads)
