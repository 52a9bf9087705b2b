"""WARC archives and a globally ordered capture index by external merging.

Writers stream records into gzip-per-record archives in the shared folder. Each archive comes
with a capture run: its index entries sorted by URL key and timestamp. Runs are dealt by key
range, and within a range a loser tree merges the k runs that reach into it, reading each as a
stream of small slices, so that ranges in order are the globally ordered capture histories.
Records are read back through that index by archive and offset.
"""

from __future__ import annotations

import base64
import hashlib
import io
import uuid
import zlib
from collections.abc import Iterable, Iterator
from datetime import datetime, timezone
from urllib.parse import urlsplit

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import byte_list, keyed_join, materialize, shared_path, slices

ARCHIVE_BYTES, READ_BYTES, SLICE_BYTES, RANGE_ROWS, BROADCAST_ROWS, LEVEL = 64 << 20, 8 << 20, 1 << 20, 100_000, 500_000, 4
INDEX = "url_key string, ts long, page_id long, archive string, offset long, length long, run string, seq long"
_DEFAULT_PORTS = {"http": 80, "https": 443}


def url_key(url: str | None) -> str:
    """Sort-friendly key: reversed host, then path and query; scheme, ``www.``, default ports,
    user and fragment are dropped. A null URL has the empty key."""
    if not url:
        return ""
    try:
        parts = urlsplit(url.strip())
        host, port = (parts.hostname or "").removeprefix("www."), parts.port
    except ValueError:
        return url.strip().lower()
    if not host:
        return url.strip().lower()
    tail = f":{port}" if port and port != _DEFAULT_PORTS.get(parts.scheme) else ""
    return ",".join(reversed(host.split("."))) + tail + ")" + (parts.path or "/") + (f"?{parts.query}" if parts.query else "")


def digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record(page_id: int, url: str | None, ts: int, payload: bytes, refers_to: int | None) -> bytes:
    """One WARC 1.1 record, gzip-compressed: a response with its payload, or a revisit that
    names the response with the same payload."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http + (payload if refers_to is None else b"")
    target = (url or "").replace("\r", "%0D").replace("\n", "%0A")
    head = [
        "WARC/1.1",
        f"WARC-Type: {'response' if refers_to is None else 'revisit'}",
        f"WARC-Record-ID: <urn:page:{page_id}>",
        f"WARC-Date: {datetime.fromtimestamp(ts, timezone.utc):%Y-%m-%dT%H:%M:%SZ}",
        f"WARC-Target-URI: {target}",
        f"WARC-Payload-Digest: sha1:{digest(payload)}",
        f"WARC-Payload-Length: {len(payload)}",
        "Content-Type: application/http; msgtype=response",
        f"Content-Length: {len(block)}",
    ]
    if refers_to is not None:
        head += [f"WARC-Refers-To: <urn:page:{refers_to}>", "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"]
    packer = zlib.compressobj(LEVEL, wbits=31)
    return packer.compress("\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n") + packer.flush()


def parse(member: bytes) -> tuple[dict[str, str], bytes]:
    """Headers and payload of one compressed record; its digest is verified for a response."""
    raw = zlib.decompress(member, wbits=31)
    head, _, rest = raw.partition(b"\r\n\r\n")
    lines = head.decode().split("\r\n")
    if not lines[0].startswith("WARC/"):
        raise ValueError("not a WARC record")
    headers = dict(line.split(": ", 1) if ": " in line else (line.rstrip(":"), "") for line in lines[1:])
    block = rest[: int(headers["Content-Length"])]
    payload = block.partition(b"\r\n\r\n")[2]
    if headers["WARC-Type"] == "response" and f"sha1:{digest(payload)}" != headers["WARC-Payload-Digest"]:
        raise ValueError(f"payload digest differs in {headers['WARC-Record-ID']}")
    return headers, payload


class LoserTree:
    """k-way merge of sorted iterators: each inner node keeps the loser of its match, so the
    next winner takes one comparison per level. Ties go to the earlier iterator."""

    def __init__(self, runs: list[Iterator]) -> None:
        self.runs, self.k = runs, max(1, len(runs))
        self.heads = [next(r, None) for r in runs] or [None]
        self.tree = [-1] * self.k
        winners = [-1] * self.k + list(range(self.k))
        for node in range(self.k - 1, 0, -1):
            a, b = winners[2 * node], winners[2 * node + 1]
            winners[node], self.tree[node] = (a, b) if self._before(a, b) else (b, a)
        self.tree[0] = winners[1] if self.k > 1 else 0

    def _before(self, a: int, b: int) -> bool:
        x, y = self.heads[a], self.heads[b]
        return x is not None and (y is None or (x, a) < (y, b))

    def __iter__(self):
        while (head := self.heads[winner := self.tree[0]]) is not None:
            yield head
            self.heads[winner] = next(self.runs[winner], None)
            node = (winner + self.k) // 2
            while node:
                if self._before(self.tree[node], winner):
                    self.tree[node], winner = winner, self.tree[node]
                node //= 2
            self.tree[0] = winner


def _filesystem(path: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(path)


def write(pages: DataFrame, ts: Column, smallest_revisit: int = 0, root: str | None = None) -> DataFrame:
    """Write ``pages(page_id, url, html)`` as archives in the folder ``root`` (or a new one in the
    shared folder); returns the runs (schema ``INDEX``), already written, so a task that is tried
    again leaves at most an unlisted archive behind.

    Of rows with equal payloads of at least ``smallest_revisit`` bytes, those with the smallest
    page_id are responses and the others revisits of it. A null html is an empty payload; a
    null url has an empty key; rows without an id are left out; of repeated rows each is written;
    further columns are ignored; an empty table gives no archive. Payloads are equal if their
    SHA-256 is. They are shuffled only if there are more than ``BROADCAST_ROWS`` groups of
    copies, and those of hot groups not even then.
    """
    spark = pages.sparkSession
    html = F.coalesce("html", F.lit(""))
    rows = pages.where("page_id is not null").select(F.col("page_id").cast("long"), "url", html.alias("html"), ts.cast("long").alias("ts"), F.sha2(html.cast("binary"), 256).alias("same"))
    groups = rows.where(F.octet_length("html") >= smallest_revisit).groupBy("same").agg(F.min("page_id").alias("first"), F.count(F.lit(1)).alias("n"))
    copies = materialize(groups.where("n > 1").select("same", "first"), "copies")
    large = F.octet_length("html") >= smallest_revisit
    joined = rows.join(F.broadcast(copies), "same", "left") if copies.count() <= BROADCAST_ROWS else keyed_join(rows, copies, "same", "left")
    marked = joined.withColumn("refers_to", F.when(large & (F.col("first") != F.col("page_id")), F.col("first")))
    root = root.rstrip("/") if root else shared_path(spark, "archives")

    def store(batches):
        files, root_path = _filesystem(root)
        files.create_dir(root_path, recursive=True)
        out, entries, name, at = None, [], "", 0

        def close():
            out.close()
            entries.sort()
            columns = list(zip(*((*e[:3], f"{root}/{name}", *e[3:], name, i) for i, e in enumerate(entries))))
            kinds = (pa.string(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.int64())
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names=[x.split()[0] for x in INDEX.split(", ")])

        for b in slices(batches, 64):
            page, url, stamp, refers = (b.column(i).to_pylist() for i in (0, 1, 2, 4))
            for p, u, t, payload, r in zip(page, url, stamp, byte_list(b.column(3)), refers):
                if out is None:
                    name, at, entries = f"{uuid.uuid4().hex}.warc.gz", 0, []
                    out = files.open_output_stream(f"{root_path}/{name}", compression=None)
                member = record(p, u, t, payload, r)
                out.write(member)
                entries.append((url_key(u), t, p, at, len(member)))
                at += len(member)
                if at >= ARCHIVE_BYTES:
                    yield close()
                    out = None
        if out is not None:
            yield close()

    return materialize(marked.select("page_id", "url", "ts", "html", "refers_to").mapInArrow(store, INDEX), "runs")


def _run_rows(parts: Iterable[pa.RecordBatch], rows: int = 64) -> Iterator[tuple]:
    for part in parts:
        for at in range(0, part.num_rows, rows):
            yield from zip(*(c.to_pylist() for c in part.slice(at, rows).columns))


def merge(runs: DataFrame, range_rows: int = RANGE_ROWS) -> DataFrame:
    """Merge written runs by URL key and timestamp: the index with ``part`` and ``place``, whose
    order is the global order of captures. Ties are ordered by page_id, archive and offset;
    repeated entries stay; an empty table gives an empty one. A task holds a range's entries, about
    ``range_rows``."""
    ranges = max(1, -(-runs.count() // range_rows))
    dealt = runs.repartitionByRange(ranges, "url_key", "ts", "page_id").sortWithinPartitions("run", "seq")
    names = [x.split()[0] for x in INDEX.split(", ")][:6]

    def run(batches):
        from pyspark import TaskContext

        part, place, held = TaskContext.get().partitionId(), 0, {}
        for b in batches:
            owner = b.column(6).to_pylist()
            at = 0
            for i in range(1, len(owner) + 1):
                if i == len(owner) or owner[i] != owner[at]:
                    held.setdefault(owner[at], []).append(b.select(names).slice(at, i - at))
                    at = i
        kinds = [pa.string(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64()]
        out: list[tuple] = []

        def pack():
            columns = [pa.array(c, k) for c, k in zip(zip(*out), kinds)]
            n = len(out)
            return pa.RecordBatch.from_arrays([*columns, pa.array([part] * n, pa.int32()), pa.array(range(place - n, place), pa.int64())], names=[*names, "part", "place"])

        for entry in LoserTree([_run_rows(parts) for _, parts in sorted(held.items())]):
            out.append(entry)
            place += 1
            if len(out) == 8192:
                yield pack()
                out = []
        if out:
            yield pack()

    return materialize(dealt.mapInArrow(run, ", ".join(INDEX.split(", ")[:6]) + ", part int, place long"), "captures")


def read(captures: DataFrame, payloads: bool = False) -> DataFrame:
    """Read the records of an index back: ``page_id, payload_bytes, payload_digest,
    record_type, refers_to``, with ``payloads`` also the payload (null for revisits).

    Records are dealt by slices of ``SLICE_BYTES`` of an archive to tasks of about ``READ_BYTES``, and
    read in their order there; repeated entries are read as often; an empty index gives an empty
    result.
    """
    tasks = max(1, -(-(captures.agg(F.sum("length")).first()[0] or 0) // READ_BYTES))
    schema = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long" + ", payload binary" * payloads
    kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.binary()][: 5 + payloads]
    names = [x.split()[0] for x in schema.split(", ")]

    def run(batches):
        name, source = None, io.BytesIO()
        for b in slices(batches, 128):
            out = []
            for archive, offset, length in zip(*(c.to_pylist() for c in b.columns)):
                if archive != name:
                    source.close()
                    files, path = _filesystem(archive)
                    name, source = archive, files.open_input_file(path)
                source.seek(offset)
                headers, payload = parse(source.read(length))
                kind, refers = headers["WARC-Type"], headers.get("WARC-Refers-To")
                row = (int(headers["WARC-Record-ID"][10:-1]), int(headers["WARC-Payload-Length"]), headers["WARC-Payload-Digest"].removeprefix("sha1:"), kind, refers and int(refers[10:-1]))
                out.append((*row, payload if kind == "response" else None) if payloads else row)
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out), kinds)], names=names)

    dealt = captures.select("archive", "offset", "length").repartition(tasks, F.col("archive"), F.floor(F.col("offset") / SLICE_BYTES))
    return dealt.sortWithinPartitions("archive", "offset").mapInArrow(run, schema)
