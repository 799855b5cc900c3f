"""WARC archives with a two-level capture index.

Writing: each task writes one ``.warc.gz`` of gzip members, one record each,
into the shared folder; equal payloads get one response and revisit records.
Indexing: lines keyed by reversed-host URL and page are range-sorted into
compressed blocks (the ``.cdx.gz`` files); a sparse directory beside each file
(``.dir``) holds every block's first key and byte range.  Reading: binary search
over the files' first keys, then over a file's directory, then within the block;
then a range read of the record.  Bulk reads look all their keys up in that way,
in key order, so a task loads each directory and block that it needs once.

A digest is computed once as 20 bytes and stored; base32 is made where a record
or a result is written.  File names are unique to a task attempt and only a
committed attempt's rows enter the index, so lost executors leave unreferenced
files at worst.

Defined results: null html is an empty payload; a null URL is the empty URL;
equal rows are each a record (of the largest page_id, each is a response); rows
of one page_id with different payloads are records of their own; a row without
page_id revisits a page with its payload, else it is a response; an empty table
gives empty archives; further columns are ignored.
"""

from __future__ import annotations

import base64
import bisect
import hashlib
import uuid
import zlib
from collections.abc import Iterator
from urllib.parse import quote, urlsplit

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import range_count, scratch_path, text_or_empty, write_scratch

BLOCK_LINES = 1024
LEVEL = 3
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
HTTP = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"
CAPTURED = "2024-01-01T00:00:00Z"
NO_PAGE = "-"
INDEX = "surt string, page_id bigint, record_type string, payload_digest string, file string, offset bigint, length bigint"
FILES = "first_key string, first_page bigint, name string, blocks bigint"


def sha1_bytes(data: Column) -> Column:
    """The 20 bytes; the default keeps a join from adding a null test, which would
    digest once more."""
    return F.coalesce(F.unhex(F.sha1(data)), F.lit(b""))


def base32(digest: bytes) -> str:
    return base64.b32encode(digest).decode("ascii")


def surt(url: str) -> str:
    """Reversed-host key: ``http://a.example.org/x`` -> ``org,example,a)/x``."""
    try:
        parts = urlsplit(url.strip())
        host, port = parts.hostname or "", parts.port
    except ValueError:
        return quote(url, safe="/?=&%:,;()~+*!@$'")
    key = ",".join(reversed(host.split(".")))
    if port and port not in (80, 443):
        key += f":{port}"
    path = (parts.path or "/") + (f"?{parts.query}" if parts.query else "")
    return quote(key + ")" + path, safe="/?=&%:,;()~+*!@$'")


def _filesystem(uri: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(uri)


def record_id(page_id: int | None, digest: str) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'page:{page_id}:{digest}')}>"


def record(page_id: int | None, url: str, payload: bytes, digest: str, refers_to: int | None) -> bytes:
    """One compressed record."""
    body = HTTP if refers_to is not None else HTTP + payload
    lines = [
        "WARC/1.1", f"WARC-Type: {'response' if refers_to is None else 'revisit'}", f"WARC-Record-ID: {record_id(page_id, digest)}", f"WARC-Page-ID: {NO_PAGE if page_id is None else page_id}", f"WARC-Date: {CAPTURED}",
        f"WARC-Target-URI: {quote(url, safe=chr(37) + '/?=&:,;()~+*!@$#' + chr(39))}", f"WARC-Payload-Digest: sha1:{digest}", "Content-Type: application/http; msgtype=response", f"Content-Length: {len(body)}",
    ]
    if refers_to is not None:
        lines += [f"WARC-Refers-To: {record_id(refers_to, digest)}", f"WARC-Refers-To-Page-ID: {refers_to}", f"WARC-Profile: {PROFILE}"]
    packer = zlib.compressobj(LEVEL, zlib.DEFLATED, 31)
    return packer.compress("\r\n".join(lines).encode("utf-8") + b"\r\n\r\n" + body + b"\r\n\r\n") + packer.flush()


def parse(member: bytes) -> tuple[dict[str, str], bytes]:
    """Header fields and payload of a compressed record."""
    raw = zlib.decompress(member, 31)
    head, _, rest = raw.partition(b"\r\n\r\n")
    fields = dict(x.split(": ", 1) for x in head.decode("utf-8").split("\r\n")[1:])
    body = rest[: int(fields["Content-Length"])]
    return fields, body.partition(b"\r\n\r\n")[2]


def payload_info(pages: DataFrame, id_col: str = "page_id", html_col: str = "html", least_bytes: int = 0) -> DataFrame:
    """page_id, digest, refers_to (null for a response), once for equal rows."""
    html = text_or_empty(html_col)
    narrow, _ = write_scratch(pages.select(pages[id_col].alias("page_id"), sha1_bytes(html.cast("binary")).alias("digest"), F.octet_length(html).alias("n")), "payload-digests")
    latest = narrow.where(F.col("n") >= least_bytes).groupBy("digest").agg(F.max("page_id").alias("latest"))
    latest, _ = write_scratch(latest, "latest-captures")  # a stored side, so that a payload of very many pages can be split
    refers = F.when((F.col("n") >= least_bytes) & ~F.col("latest").eqNullSafe(F.col("page_id")), F.col("latest"))
    return narrow.join(latest, "digest", "left").select("page_id", "digest", refers.alias("refers_to")).distinct()


def write_archives(pages: DataFrame, out_dir: str, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", least_bytes: int = 0) -> DataFrame:
    """Write all records; return the index lines (already stored)."""
    info = payload_info(pages, id_col, html_col, least_bytes).select(F.col("page_id").alias("of_page"), F.col("digest").alias("of_digest"), "refers_to")
    wide = pages.select(pages[id_col].alias("page_id"), text_or_empty(url_col).alias("url"), text_or_empty(html_col).cast("binary").alias("html"))
    wide = wide.withColumn("digest", sha1_bytes(F.col("html")))
    wide = wide.join(info, (wide["digest"] == info["of_digest"]) & wide["page_id"].eqNullSafe(info["of_page"])).select("page_id", "url", "html", "digest", "refers_to")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, root = _filesystem(out_dir)
        fs.create_dir(root, recursive=True)
        name, at, out = f"{uuid.uuid4().hex}.warc.gz", 0, None
        try:
            for batch in batches:
                lines = []
                for page, url, html, digest, refers in zip(*batch.columns, strict=True):
                    out = out or fs.open_output_stream(f"{root}/{name}", compression=None)
                    page, url, digest, refers = page.as_py(), url.as_py(), base32(digest.as_py()), refers.as_py()
                    data = record(page, url, html.as_py(), digest, refers)
                    out.write(data)
                    lines.append((surt(url), page, "response" if refers is None else "revisit", digest, name, at, len(data)))
                    at += len(data)
                if lines:
                    yield _batch(lines, INDEX)
        finally:
            if out is not None:
                out.close()

    return write_scratch(wide.mapInArrow(run, INDEX), "capture-lines")[0]


def _place(key: str, page: int | None) -> tuple[str, bool, int]:
    """Where a line stands in the order: no page comes first."""
    return key, page is not None, page or 0


def _batch(rows: list[tuple], schema: str) -> pa.RecordBatch:
    kinds = {"string": pa.string(), "bigint": pa.int64()}
    names, types = zip(*(x.split() for x in schema.split(", ")), strict=True)
    return pa.RecordBatch.from_arrays([pa.array(c, kinds[t]) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names=list(names))


def build_index(lines: DataFrame, out_dir: str, block_lines: int = BLOCK_LINES) -> DataFrame:
    """Range-sort the lines into compressed blocks; return one row for each index
    file with its first key.  The blocks' directory stands beside the file."""
    parts = range_count(lines, 160)
    ordered = lines.repartitionByRange(parts, "surt", "page_id").sortWithinPartitions("surt", "page_id")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, root = _filesystem(out_dir)
        fs.create_dir(root, recursive=True)
        name, at, out, held, rows = uuid.uuid4().hex, 0, None, [], []

        def block(held):
            nonlocal at, out
            out = out or fs.open_output_stream(f"{root}/{name}.cdx.gz", compression=None)
            packer = zlib.compressobj(6, zlib.DEFLATED, 31)
            data = packer.compress("".join(" ".join(NO_PAGE if x is None else str(x) for x in line) + "\n" for line in held).encode("utf-8")) + packer.flush()
            out.write(data)
            rows.append((held[0][0], held[0][1], at, len(data)))
            at += len(data)

        try:
            for batch in batches:
                held += zip(*[c.to_pylist() for c in batch.columns], strict=True)
                while len(held) >= block_lines:
                    block(held[:block_lines])
                    held = held[block_lines:]
            if held:
                block(held)
        finally:
            if out is not None:
                out.close()
        if rows:
            with fs.open_output_stream(f"{root}/{name}.dir", compression=None) as side:
                side.write("".join(f"{key} {NO_PAGE if page is None else page} {offset} {n}\n" for key, page, offset, n in rows).encode("utf-8"))
            yield _batch([(rows[0][0], rows[0][1], name, len(rows))], FILES)

    return write_scratch(ordered.mapInArrow(run, FILES), "capture-files")[0]


class CaptureIndex:
    """Binary search at every level, then range reads.

    Held: the first key of every index file (as many as range partitions), the
    directory of one file and one block.  A copy works inside a task.
    """

    def __init__(self, files: DataFrame, out_dir: str):
        rows = sorted((_place(r["first_key"], r["first_page"]), r["name"]) for r in files.collect())
        self.out_dir, self.firsts, self.names = out_dir, [r[0] for r in rows], [r[1] for r in rows]
        self._directory = self._block = (None, None)

    def _open(self, path: str) -> pafs.NativeFile:
        fs, root = _filesystem(self.out_dir)
        return fs.open_input_file(f"{root}/{path}")

    def directory(self, name: str) -> tuple[list[tuple], list[tuple[int, int]]]:
        """First places and byte ranges of a file's blocks."""
        if self._directory[0] != name:
            with self._open(f"{name}.dir") as f:
                rows = [x.split(" ") for x in f.read().decode("utf-8").splitlines()]
            self._directory = name, ([_place(k, None if p == NO_PAGE else int(p)) for k, p, _, _ in rows], [(int(at), int(n)) for _, _, at, n in rows])
        return self._directory[1]

    def block(self, name: str, at: int, n: int) -> tuple[list[tuple], list[tuple]]:
        """Places and lines of a block."""
        if self._block[0] != (name, at):
            with self._open(f"{name}.cdx.gz") as f:
                data = f.read_at(n, at)
            lines = []
            for line in zlib.decompress(data, 31).decode("utf-8").splitlines():
                key, page, kind, digest, file, offset, length = line.split(" ")
                lines.append((key, None if page == NO_PAGE else int(page), kind, digest, file, int(offset), int(length)))
            self._block = (name, at), ([_place(x[0], x[1]) for x in lines], lines)
        return self._block[1]

    def between(self, first: tuple, last: tuple) -> Iterator[tuple]:
        """Index lines from one place to another, both included."""
        at = max(0, bisect.bisect_left(self.firsts, first) - 1)
        while at < len(self.names) and self.firsts[at] <= last:
            firsts, ranges = self.directory(self.names[at])
            k = max(0, bisect.bisect_left(firsts, first) - 1)
            while k < len(ranges) and firsts[k] <= last:
                places, lines = self.block(self.names[at], *ranges[k])
                for j in range(bisect.bisect_left(places, first), len(lines)):
                    if places[j] > last:
                        return
                    yield lines[j]
                k += 1
            at += 1

    def captures(self, url: str) -> list[tuple[dict[str, str], bytes]]:
        """Header fields and payload of all captures of a URL."""
        key, out = surt(url), []
        for line in self.between((key, False, 0), (key, True, 2**63)):
            with self._open(line[4]) as w:
                out.append(parse(w.read_at(line[6], line[5])))
        return out


def look_up(index: CaptureIndex, keys: DataFrame) -> DataFrame:
    """Index lines of all captures of keys (url, page_id)."""

    def name(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array([surt(x) for x in batch.column(0).to_pylist()], pa.string()), batch.column(1)], names=["surt", "page_id"])

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        before = None
        for batch in batches:
            lines = []
            for key, page in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                place = _place(key, page)
                if place != before:  # equal keys stand together and are looked up once
                    lines += index.between(place, place)
                before = place
            if lines:
                yield _batch(lines, INDEX)

    named = keys.mapInArrow(name, "surt string, page_id bigint")
    parts = max(2, len(index.names))  # as the index is cut, so that a task meets few files
    return named.repartitionByRange(parts, "surt", "page_id").sortWithinPartitions("surt", "page_id").mapInArrow(search, INDEX)


def read_records(lines: DataFrame, out_dir: str, parts: int) -> DataFrame:
    """The records of index lines by range reads: page_id, payload_bytes,
    payload_digest, record_type, refers_to; a revisit takes the size of the
    response that it names by page and digest.

    ``parts`` is fixed, since lines are too small to tell what their records cost.
    """

    def fetch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, root = _filesystem(out_dir)
        name, f = None, None
        for batch in batches:
            rows = []
            for file, at, n in zip(*[batch.column(c).to_pylist() for c in ("file", "offset", "length")], strict=True):
                if file != name:
                    if f is not None:
                        f.close()
                    name, f = file, fs.open_input_file(f"{root}/{file}")
                fields, payload = parse(f.read_at(n, at))
                refers, page = fields.get("WARC-Refers-To-Page-ID"), fields["WARC-Page-ID"]
                digest = fields["WARC-Payload-Digest"].removeprefix("sha1:")
                if refers is None and digest != base32(hashlib.sha1(payload).digest()):
                    raise ValueError(f"record {fields['WARC-Record-ID']} is damaged")
                rows.append((None if page == NO_PAGE else int(page), len(payload) if refers is None else None, digest, fields["WARC-Type"], None if refers is None else int(refers)))
            if rows:
                yield _batch(rows, READ)
        if f is not None:
            f.close()

    ordered = lines.select("file", "offset", "length").repartition(parts, "file").sortWithinPartitions("file", "offset")
    read, _ = write_scratch(ordered.mapInArrow(fetch, READ), "records-read")
    responses = read.where("record_type = 'response'")
    # equal rows give several responses of one page with the same payload
    of = responses.select(F.col("page_id").alias("refers_to"), "payload_bytes", "payload_digest").dropDuplicates(["refers_to", "payload_digest"])
    revisits = read.where("record_type = 'revisit'").drop("payload_bytes").join(of, ["refers_to", "payload_digest"])
    columns = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"]
    return responses.select(columns).union(revisits.select(columns))


READ = "page_id bigint, payload_bytes bigint, payload_digest string, record_type string, refers_to bigint"


def round_trip(pages: DataFrame, least_bytes: int = 0, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """Write, index, and read back all pages below the shared folder: every page's
    URL is looked up through the index."""
    out_dir = scratch_path(pages.sparkSession, "warc")
    index = CaptureIndex(build_index(write_archives(pages, out_dir, id_col, url_col, html_col, least_bytes), out_dir), out_dir)
    keys = pages.select(text_or_empty(url_col).alias("url"), pages[id_col].cast("bigint").alias("page_id"))
    return read_records(look_up(index, keys), out_dir, max(2, len(index.names)))
