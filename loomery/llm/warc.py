"""WARC archives of pages, and their capture index by external merge (operator 11).

Every page becomes one gzip member of an archive: a ``response`` with its payload, or a ``revisit`` that refers to the page
with the smallest id among those with an equal payload.  Each writing task fills archives of up to ``ARCHIVE_BYTES`` in the
shared folder and hands on one index row a record; the rows of an archive, sorted by URL key and time when it is closed, are
a run.  Only rows of tasks that ended well are kept, so an archive left by a lost or repeated task is read by nobody.

The index of all archives is an external merge: rows go to ranges of (URL key, time), each with some ``RANGE_ROWS`` rows
however often a URL was captured, and a loser tree merges the pieces of all runs that meet in a range.  What comes out is in
order over all ranges: the history of every URL.  Archives are read back from start to end, and their records meet the
index by archive and offset.

A payload that many pages share is paired with its first page without a hot key: payloads with at least a thousandth of all
rows are at most a thousand and are joined by broadcast; no other has more rows than that.

Defined cases: a null html is the empty payload, a null URL has the key ``)/``; a null page id counts as no candidate for the
smallest one (if all are null, all are responses) and comes first among captures of one time; rows that repeat an id and
its payload are captures of their own with the same type; an empty table gives no archives and no rows; further columns are
ignored, whatever their names; payloads are written whole, and a task holds one record at a time.
"""

from __future__ import annotations

import base64
import datetime
import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator
from urllib.parse import quote

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import arrow, cut, shared_path, slices

ARCHIVE_BYTES, RANGE_ROWS = 1 << 30, 100_000
#: A payload is hot from this share of all rows on (one in so many).
HOT = 1000
#: Compressed bytes read at a time.
READ = 1 << 17
# fixed values of the format
_END = b"\r\n\r\n"
_PROFILE = b"http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"

_RUNS = pa.schema(
    [("archive", pa.string()), ("seq", pa.int64()), ("offset", pa.int64()), ("size", pa.int64()), ("url_key", pa.string()), ("captured", pa.string()), ("page_id", pa.int64()), ("digest", pa.string())]
)
_RUNS_DDL = "archive string, seq long, offset long, size long, url_key string, captured string, page_id long, digest string"
_MERGED_DDL = "archive string, offset long, url_key string, captured string, page_id long, range int, place long, nth long"
_RECORDS_DDL = "archive string, offset long, page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long"


def url_key(url: Column) -> Column:
    """The host's labels backwards without ``www``, then the path and query; scheme, port and fragment don't count."""
    url = F.coalesce(url, F.lit(""))
    host = F.regexp_replace(F.lower(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#:]*)", 1)), r"^www[0-9]*\.", "")
    rest = F.regexp_replace(F.regexp_replace(url, r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*", ""), r"(?s)#.*$", "")
    return F.concat(F.array_join(F.reverse(F.split(host, r"\.")), ","), F.lit(")"), F.when(rest == "", "/").otherwise(F.lower(rest)))


def typed(pages: DataFrame) -> DataFrame:
    """(page_id, url, captured, html, digest, first): ``first`` is the smallest page id with an equal payload, where another page has it too."""
    rows = pages.withColumn("_html", F.coalesce("html", F.lit(""))).withColumn("_sha1", F.sha1("_html"))
    keys = rows.groupBy("_sha1").agg(F.min("page_id").alias("_first"), F.count("*").alias("_n"))
    # read twice: for the hot ones, and for the rest
    keys = cut(keys.where("_n > 1"), "payloads")
    total = pages.count()
    hot = keys.where(F.col("_n") * HOT >= max(total, HOT))
    rows = rows.join(F.broadcast(hot.select("_sha1", F.col("_first").alias("_hot"), F.lit(True).alias("_is_hot"))), "_sha1", "left")
    # rows of hot payloads have their answer: they are dealt by a key of their own that meets none
    rows = rows.withColumn("_key", F.when(F.col("_is_hot"), F.concat(F.lit("-"), F.xxhash64("page_id", "url").cast("string"))).otherwise(F.col("_sha1")))
    rest = keys.where(F.col("_n") * HOT < max(total, HOT)).select(F.col("_sha1").alias("_key"), F.col("_first").alias("_other"))
    rows = rows.join(rest, "_key", "left").select(F.col("page_id").cast("long").alias("page_id"), "url", "_captured", "_html", F.coalesce("_hot", "_other").cast("long").alias("first"))
    return rows.select("page_id", "url", F.col("_captured").alias("captured"), F.col("_html").alias("html"), "first", url_key(F.col("url")).alias("url_key"))


def _file_system(folder: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(re.sub(r"^s3[an]:", "s3:", folder))


def _id(page_id: int | None) -> bytes:
    return b"<urn:page:%s>" % (b"" if page_id is None else str(page_id).encode())


def record(page_id: int | None, url: str | None, date: str, payload: bytes, digest: str, refers_to: int | None) -> bytes:
    """One record; a revisit has the response's HTTP head, but no payload."""
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d" % len(payload) + _END
    revisit = refers_to is not None
    block = http if revisit else http + payload
    head = [
        b"WARC/1.1",
        b"WARC-Type: " + (b"revisit" if revisit else b"response"),
        b"WARC-Record-ID: " + _id(page_id),
        b"WARC-Date: " + date.encode(),
        b"WARC-Target-URI: " + quote(url or "", safe="!#$%&'()*+,/:;=?@[]~").encode(),
        b"WARC-Payload-Digest: sha1:" + digest.encode(),
        *([b"WARC-Profile: " + _PROFILE, b"WARC-Refers-To: " + _id(refers_to)] if revisit else []),
        b"Content-Type: application/http; msgtype=response",
        b"Content-Length: %d" % len(block),
    ]
    return b"\r\n".join(head) + _END + block + _END


def _member(data: bytes) -> bytes:
    packer = zlib.compressobj(6, zlib.DEFLATED, 31)
    return packer.compress(data) + packer.flush()


def write(rows: DataFrame, folder: str, archive_bytes: int = ARCHIVE_BYTES) -> DataFrame:
    """Archives in ``folder``; returns their index rows, each archive's a sorted run (``seq`` counts within it)."""

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, root = _file_system(folder)
        out, name, at = None, "", 0
        # (offset, size, url_key, captured, page_id, digest) of each record
        run: list[tuple] = []

        def closed() -> pa.RecordBatch:
            out.close()
            run.sort(key=lambda r: (r[2], r[3], r[4] is not None, r[4] or 0, r[5]))
            return pa.RecordBatch.from_arrays([pa.array([name] * len(run)), pa.array(range(len(run)), pa.int64()), *(pa.array(c, t) for c, t in zip(zip(*run), _RUNS.types[2:]))], schema=_RUNS)

        for b in slices(batches, "html"):
            for page_id, url, seconds, html, first, key in zip(*(b.column(c) if c == "html" else b.column(c).to_pylist() for c in ("page_id", "url", "captured", "html", "first", "url_key"))):
                if out is None:
                    name = f"{uuid.uuid4().hex}.warc.gz"
                    files.create_dir(root, recursive=True)
                    # members are compressed here, one by one
                    out = files.open_output_stream(f"{root}/{name}", compression=None)
                    info = b"software: loomery\r\nformat: WARC File Format 1.1\r\n"
                    at = out.write(_member(b"WARC/1.1\r\nWARC-Type: warcinfo\r\nWARC-Record-ID: <urn:uuid:%s>\r\nWARC-Date: 2024-01-01T00:00:00Z\r\nContent-Type: application/warc-fields\r\nContent-Length: %d" % (str(uuid.uuid4()).encode(), len(info)) + _END + info + _END))
                payload = html.as_py().encode()
                digest = base64.b32encode(hashlib.sha1(payload).digest()).decode()
                date = datetime.datetime.fromtimestamp(seconds, datetime.UTC)
                refers_to = first if first is not None and first != page_id else None
                member = _member(record(page_id, url, date.strftime("%Y-%m-%dT%H:%M:%SZ"), payload, digest, refers_to))
                out.write(member)
                run.append((at, len(member), key, date.strftime("%Y%m%d%H%M%S"), page_id, digest))
                at += len(member)
                if at >= archive_bytes:
                    yield closed()
                    out, run = None, []
        if out is not None:
            yield closed()

    return arrow(rows, kernel, _RUNS_DDL)


class LoserTree:
    """k-way merge of sorted iterators of tuples: inner nodes hold the losers of their matches, so that the row after the winner takes one path of log2(k) comparisons."""

    def __init__(self, runs: list[Iterator[tuple]]):
        self.runs, k = runs, len(runs)
        self.heads = [next(r, None) for r in runs]
        self.losers = [-1] * k
        winners = [-1] * k + list(range(k))
        for node in range(k - 1, 0, -1):
            a, b = winners[2 * node], winners[2 * node + 1]
            winners[node], self.losers[node] = (a, b) if self._before(a, b) else (b, a)
        self.winner = winners[1] if k > 1 else k - 1

    def _before(self, a: int, b: int) -> bool:
        x, y = self.heads[a], self.heads[b]
        return y is None or (x is not None and x <= y)

    def __iter__(self) -> Iterator[tuple]:
        k = len(self.runs)
        while self.winner >= 0 and self.heads[self.winner] is not None:
            w = self.winner
            yield self.heads[w]
            self.heads[w] = next(self.runs[w], None)
            node = (w + k) // 2
            while node:
                if not self._before(w, self.losers[node]):
                    w, self.losers[node] = self.losers[node], w
                node //= 2
            self.winner = w


def _merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One range of keys: rows come run after run, each sorted, and leave in the order of all."""
    from pyspark import TaskContext

    held = [b for b in batches if b.num_rows]
    if not held:
        return
    rows = pa.Table.from_batches(held)
    pid = TaskContext.get().partitionId()
    names = rows.column("archive").to_pylist()
    starts = [0, *(i for i in range(1, len(names)) if names[i] != names[i - 1]), len(names)]
    columns = [rows.column(c).to_pylist() for c in ("url_key", "captured", "page_id", "digest", "offset")]

    def run(lo: int, hi: int) -> Iterator[tuple]:
        for i in range(lo, hi):
            key, captured, page_id, digest, offset = (c[i] for c in columns)
            yield key, captured, page_id is not None, page_id or 0, digest, names[i], offset

    out, key, nth = [], None, 0
    for place, (k, captured, known, page_id, _, archive, offset) in enumerate(LoserTree([run(a, b) for a, b in zip(starts, starts[1:])])):
        key, nth = k, nth + 1 if k == key else 0
        out.append((archive, offset, k, captured, page_id if known else None, pid, place, nth))
        if len(out) == 10_000:
            yield _merged(out)
            out = []
    if out:
        yield _merged(out)


def _merged(rows: list[tuple]) -> pa.RecordBatch:
    kinds = (pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.int32(), pa.int64(), pa.int64())
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), kinds)], names=["archive", "offset", "url_key", "captured", "page_id", "range", "place", "nth"])


def merge(runs: DataFrame, range_rows: int = RANGE_ROWS) -> DataFrame:
    """All runs' rows with ``cdx_rank``, from 0 in the order of (url_key, captured, page_id), and ``capture_no``, from 1 within a URL key."""
    ranges = max(1, -(-runs.count() // range_rows))
    dealt = runs.repartitionByRange(ranges, "url_key", "captured", "page_id", "digest", "archive", "offset").sortWithinPartitions("archive", "seq")
    merged = cut(arrow(dealt, _merge, _MERGED_DDL), "index")
    # one row a range: where it starts, and how many captures of its first URL lie in ranges before it
    ends = merged.groupBy("range").agg(F.count("*").alias("_rows"), F.min("url_key").alias("_first"), F.max("url_key").alias("_last"), (F.max_by("nth", "place") + 1).alias("_of_last"))
    before = Window.orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    ends = ends.withColumn("_start", F.coalesce(F.sum("_rows").over(before), F.lit(0)))
    edges = ends.select("range", F.explode(F.array(F.struct(F.col("_last").alias("key"), F.col("_of_last").alias("n"), F.lit(1).alias("end")), F.struct(F.col("_first").alias("key"), F.lit(0).cast("long").alias("n"), F.lit(0).alias("end")))).alias("_e"))
    earlier = Window.partitionBy("_e.key").orderBy("range").rangeBetween(Window.unboundedPreceding, -1)
    carried = edges.withColumn("_carried", F.coalesce(F.sum("_e.n").over(earlier), F.lit(0))).where("_e.end = 0").select("range", "_carried")
    starts = cut(ends.select("range", "_start").join(carried, "range"), "ranges")
    # rows of a range's first URL have as many rows before them as captures of it
    nth = F.col("nth") + F.when(F.col("nth") == F.col("place"), F.col("_carried")).otherwise(0) + 1
    return merged.join(starts, "range").select("archive", "offset", "url_key", "captured", "page_id", (F.col("_start") + F.col("place")).cast("long").alias("cdx_rank"), nth.cast("long").alias("capture_no"))


def members(stream) -> Iterator[tuple[int, bytes]]:
    """(offset, record) of each gzip member of an open archive."""
    start = at = 0
    data, packed, parts = b"", None, []
    while True:
        if not data:
            data = stream.read(READ)
            if not data:
                if packed is not None:
                    raise ValueError("an archive ends within a record")
                return
        if packed is None:
            packed, parts, start = zlib.decompressobj(31), [], at
        parts.append(packed.decompress(data))
        at += len(data) - len(packed.unused_data)
        data = packed.unused_data
        if packed.eof:
            yield start, b"".join(parts)
            packed = None


def parse(data: bytes) -> tuple[dict[bytes, bytes], dict[bytes, bytes], bytes]:
    """Headers, HTTP headers and payload of one record."""
    head, _, rest = data.partition(_END)
    headers = dict(line.split(b": ", 1) for line in head.split(b"\r\n")[1:])
    block = rest[: int(headers[b"Content-Length"])]
    if len(rest) != len(block) + len(_END):
        raise ValueError("a record isn't as long as it says")
    if not headers[b"Content-Type"].startswith(b"application/http"):
        return headers, {}, block
    http, _, payload = block.partition(_END)
    return headers, dict(line.split(b": ", 1) for line in http.split(b"\r\n")[1:]), payload


def _number(name: bytes) -> int | None:
    found = name.removeprefix(b"<urn:page:").removesuffix(b">")
    return int(found) if found else None


def read(archives: DataFrame, folder: str) -> DataFrame:
    """Every page's record in the archives named by ``archive``; a response's digest and length are those of the payload read."""

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, root = _file_system(folder)
        kinds = (pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64())
        for b in batches:
            for name in b.column("archive").to_pylist():
                rows: list[tuple] = []
                with files.open_input_stream(f"{root}/{name}", compression=None) as stream:
                    for offset, data in members(stream):
                        headers, http, payload = parse(data)
                        kind = headers[b"WARC-Type"].decode()
                        if kind == "warcinfo":
                            continue
                        digest = headers[b"WARC-Payload-Digest"].removeprefix(b"sha1:").decode()
                        size, refers_to = int(http[b"Content-Length"]), None
                        if kind == "revisit":
                            refers_to = _number(headers[b"WARC-Refers-To"])
                        else:
                            size, stated = len(payload), digest
                            digest = base64.b32encode(hashlib.sha1(payload).digest()).decode()
                            if digest != stated:
                                raise ValueError(f"{name} at {offset}: the payload isn't what its digest says")
                        rows.append((name, offset, _number(headers[b"WARC-Record-ID"]), size, digest, kind, refers_to))
                        if len(rows) == 10_000:
                            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), kinds)], names=_names(_RECORDS_DDL))
                            rows = []
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), kinds)], names=_names(_RECORDS_DDL))

    return arrow(archives.select("archive"), kernel, _RECORDS_DDL)


def _names(ddl: str) -> list[str]:
    return [c.split()[0] for c in ddl.split(", ")]


def histories(pages: DataFrame, captured: Column | None = None, archive_bytes: int = ARCHIVE_BYTES, range_rows: int = RANGE_ROWS) -> DataFrame:
    """Write, index and read back all pages; ``captured`` is the time of capture in seconds (default: a stand-in that follows page_id)."""
    seconds = captured if captured is not None else F.lit(1_704_067_200) + F.pmod(F.coalesce(F.col("page_id").cast("long"), F.lit(0)), F.lit(100_000_000))
    folder = shared_path(pages.sparkSession, "archives")
    rows = typed(pages.select("page_id", "url", "html", seconds.cast("long").alias("_captured")))
    runs = cut(write(rows, folder, archive_bytes), "runs")
    archives = runs.select("archive").distinct()
    read_back = read(archives.repartition(max(1, archives.count())), folder)
    index = merge(runs, range_rows).drop("page_id")
    # the size of what a reader returns is unknown to the planner, so that it must not choose a broadcast
    return read_back.hint("merge").join(index, ["archive", "offset"]).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "url_key", "captured", "capture_no", "cdx_rank")
