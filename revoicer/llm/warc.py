"""WARC archives with a two-level capture index.

Writing: captures are sorted by their reversed-host key over range partitions; every
task writes one archive (a gzip member per record) and one index file of compressed
blocks of index lines in key order, closed by a sparse directory of its blocks (first
key, place of the block, extent of its records in the archive). The table of files
(first and last key of each) is the upper level.

Reading: a key is looked up by binary search in the table of files, in the file's
directory, and in one block, then one range of the archive is read. A full read takes
each block's records, which lie side by side, with one range read.

Files have names of their own for each attempt of a task, and only files that the
table lists count, so lost executors and repeated tasks leave nothing wrong behind.
"""

from __future__ import annotations

import base64
import hashlib
import json
import uuid
import zlib
from bisect import bisect_left, bisect_right
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .shared import arrow_schema, column, file_system, fresh_folder, materialise, record
from .url_filter import AUTHORITY, NAME

BLOCK = 512
LEVEL = 4
#: Bytes of payload that an archive holds about, where there are more than tasks can share.
ARCHIVE_BYTES = 256 << 20
#: Rows of about 80 bytes that may be sent to every task.
BROADCAST = 100_000
RECORD_URI = "urn:revoicer:page:"
EXACT_URI = "X-Exact-Target-URI"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
FILES = "file string, first_key string, last_key string, records bigint, directory_offset bigint, directory_length bigint"
CAPTURES = "page_id bigint, url string, payload_bytes bigint, payload_digest string, record_type string, refers_to bigint, payload binary"


def url_key(url: Column) -> Column:
    """Reversed host, then path and query: ``https://a.b.com/x`` is ``com,b,a)/x``. The
    host is lower-cased; scheme, user, port and fragment go; a null or odd URL without a
    host is kept whole behind a closing bracket."""
    url = F.coalesce(url, F.lit(""))
    pattern = AUTHORITY + NAME + r"(?::[0-9]*)?([^#]*)"
    host = F.lower(F.regexp_extract(url, pattern, 1))
    reversed_host = F.when(F.startswith(host, F.lit("[")), host).otherwise(F.array_join(F.reverse(F.split(host, r"\.")), ","))
    return F.when(host != "", F.concat(reversed_host, F.lit(")"), F.regexp_extract(url, pattern, 2))).otherwise(F.concat(F.lit(")"), url))


# ---- records ----------------------------------------------------------------


def clean(value: str) -> str:
    """A header value on one line; EXACT_URI then has the value itself."""
    return value.replace("\r", "%0D").replace("\n", "%0A")


def record_bytes(page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None) -> bytes:
    """One WARC/1.1 record; a revisit has the HTTP head of its capture, not the payload."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http + payload if refers_to is None else http
    head = ["WARC/1.1", f"WARC-Type: {'response' if refers_to is None else 'revisit'}", f"WARC-Record-ID: <{RECORD_URI}{'' if page_id is None else page_id}>", "WARC-Date: 1970-01-01T00:00:00Z"]
    if url is not None:
        head.append(f"WARC-Target-URI: {clean(url)}")
        if clean(url) != url:
            head.append(f"{EXACT_URI}: {json.dumps(url)}")
    head.append(f"WARC-Payload-Digest: sha1:{digest}")
    if refers_to is not None:
        head += [f"WARC-Refers-To: <{RECORD_URI}{refers_to}>", f"WARC-Profile: {PROFILE}"]
    head += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def parsed(raw: bytes) -> dict:
    """The capture in one record; a damaged one raises."""
    head, _, rest = raw.partition(b"\r\n\r\n")
    first, *lines = head.decode().split("\r\n")
    if not first.startswith("WARC/"):
        raise ValueError("not a WARC record")
    fields = {k.lower(): v for k, v in (line.split(": ", 1) for line in lines)}
    block = rest[: int(fields["content-length"])]
    http, _, payload = block.partition(b"\r\n\r\n")
    size = next(int(x.split(b":", 1)[1]) for x in http.split(b"\r\n") if x.lower().startswith(b"content-length:"))
    own, digest, revisit = fields["warc-record-id"][len(RECORD_URI) + 1 : -1], fields["warc-payload-digest"].removeprefix("sha1:"), fields["warc-type"] == "revisit"
    if not revisit and (len(payload) != size or sha1(payload) != digest):
        raise ValueError(f"payload of record {own} does not match its digest")
    return {
        "page_id": int(own) if own else None, "url": json.loads(fields[EXACT_URI.lower()]) if EXACT_URI.lower() in fields else fields.get("warc-target-uri"), "payload_bytes": size, "payload_digest": digest,
        "record_type": fields["warc-type"], "refers_to": int(fields["warc-refers-to"][len(RECORD_URI) + 1 : -1]) if revisit else None, "payload": None if revisit else payload,
    }


def sha1(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload, usedforsecurity=False).digest()).decode()


def gzipped(data: bytes, level: int = LEVEL) -> bytes:
    packer = zlib.compressobj(level, zlib.DEFLATED, 31)
    return packer.compress(data) + packer.flush()


def gunzipped(data: bytes) -> bytes:
    return zlib.decompress(data, 31)


# ---- writing ----------------------------------------------------------------


def roles(pages: DataFrame, min_bytes: int) -> DataFrame:
    """key, page_id, url, html, refers_to of every page.

    Copies are found on (hash, size) alone, and only groups of two and more are joined
    back: from memory where they are at most BROADCAST rows, so that pages move once, to
    their place in the archives; else by an ordinary join, whose large groups are split.
    """
    plain = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.coalesce(F.col("html").cast("string"), F.lit("")).alias("html"))
    plain = plain.withColumn("hash", F.sha1("html")).withColumn("size", F.octet_length("html"))
    groups = plain.where(F.col("size") >= min_bytes).groupBy("hash", "size").agg(F.max("page_id").alias("newest"), F.count(F.lit(1)).alias("n")).where("n > 1").drop("n")
    groups = materialise(groups, "copies")
    joined = plain.join(F.broadcast(groups) if groups.count() <= BROADCAST else groups, ["hash", "size"], "left")
    refers = F.when(F.col("page_id").eqNullSafe(F.col("newest")), F.lit(None)).otherwise(F.col("newest"))
    return joined.select(url_key(F.col("url")).alias("key"), "page_id", "url", "html", refers.cast("long").alias("refers_to"))


def write_archives(pages: DataFrame, folder: str, min_bytes: int = 0, archives: int | None = None) -> DataFrame:
    """Write archives and index to ``folder``; returns the table of files.

    Of pages with equal payloads of at least min_bytes bytes, that with the largest
    page_id is written in full, others as revisits of it. Edge cases: null html is an
    empty payload; a null url has no target; rows that repeat the largest page_id of
    their payload are full each; a null page_id is a revisit where its payload has a
    page with an id; an empty table gives no archive.
    """
    spark = pages.sparkSession
    if archives is None:
        size = pages.agg(F.sum(F.octet_length("html"))).first()[0] or 0
        archives = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-size // ARCHIVE_BYTES))
    rows = roles(pages, min_bytes).repartitionByRange(archives, "key", "page_id", F.xxhash64("html")).sortWithinPartitions("key", "page_id")
    struct = T._parse_datatype_string(FILES)
    arrow = arrow_schema(struct)

    def run(batches):
        captures = ((k, p, u, (h or "").encode(), r) for b in batches for k, p, u, h, r in zip(*(column(b, c).to_pylist() for c in ("key", "page_id", "url", "html", "refers_to")), strict=True))
        if (first := next(captures, None)) is None:
            return
        fs, root = file_system(folder)
        fs.create_dir(root, recursive=True)
        name = f"part-{TaskContext.get().partitionId():06d}-{uuid.uuid4().hex}"
        with fs.open_output_stream(f"{root}/{name}.warc.gz", compression=None) as archive, fs.open_output_stream(f"{root}/{name}.idx", compression=None) as index:
            yield record({k: [v] for k, v in written(name, first, captures, archive, index).items()}, arrow)

    return materialise(rows.mapInArrow(run, struct), "warc_files")


def written(name: str, first: tuple, captures: Iterator[tuple], archive, index) -> dict:
    """Write one archive and its index; its row of the table of files."""
    at = start = place = count = 0
    lines, directory = [], []

    def flush() -> None:
        nonlocal lines, start, place
        data = gzipped("\n".join(lines).encode())
        index.write(data)
        directory.append([json.loads(lines[0])[0], place, len(data), start, at - start])
        place, start, lines = place + len(data), at, []

    last = first
    for capture in (x for part in ([first], captures) for x in part):
        key, page_id, url, payload, refers_to = last = capture
        data = gzipped(record_bytes(page_id, url, payload, sha1(payload), refers_to))
        archive.write(data)
        lines.append(json.dumps([key, page_id, at, len(data)]))
        at, count = at + len(data), count + 1
        if len(lines) == BLOCK:
            flush()
    if lines:
        flush()
    tail = gzipped(json.dumps(directory).encode())
    index.write(tail)
    return {"file": name, "first_key": first[0], "last_key": last[0], "records": count, "directory_offset": place, "directory_length": len(tail)}


# ---- reading ----------------------------------------------------------------


class Archive:
    """Range reads of one archive and its index."""

    def __init__(self, folder: str, row: dict):
        fs, root = file_system(folder)
        self.records, self.index = fs.open_input_file(f"{root}/{row['file']}.warc.gz"), fs.open_input_file(f"{root}/{row['file']}.idx")
        self.directory = json.loads(gunzipped(self.index.read_at(row["directory_length"], row["directory_offset"])))
        self.firsts = [d[0] for d in self.directory]
        self.last: tuple = (None, [], [])  # the block that was searched last

    def block(self, i: int) -> list[list]:
        _, place, length, _, _ = self.directory[i]
        return [json.loads(x) for x in gunzipped(self.index.read_at(length, place)).decode().split("\n")]

    def all(self) -> Iterator[dict]:
        for i, (_, _, _, start, extent) in enumerate(self.directory):
            data = self.records.read_at(extent, start)
            for _, _, at, length in self.block(i):
                yield parsed(gunzipped(data[at - start : at - start + length]))

    def find(self, key: str) -> Iterator[dict]:
        """Captures of a key: binary search over blocks, then within them; those of a block
        lie side by side and are read at once."""
        for i in range(max(0, bisect_left(self.firsts, key) - 1), bisect_right(self.firsts, key)):
            if self.last[0] != i:
                lines = self.block(i)
                self.last = (i, lines, [x[0] for x in lines])
            _, lines, own = self.last
            found = lines[bisect_left(own, key) : bisect_right(own, key)]
            if found:
                start = found[0][2]
                data = self.records.read_at(found[-1][2] + found[-1][3] - start, start)
                for _, _, at, length in found:
                    yield parsed(gunzipped(data[at - start : at - start + length]))

    def close(self) -> None:
        self.records.close()
        self.index.close()


def emitted(found: Iterator[dict], names: list[str], arrow: pa.Schema, more: dict | None = None) -> Iterator[pa.RecordBatch]:
    rows: list[dict] = []
    size = 0
    for x in found:
        rows.append(x | (more or {}))
        size += 256 + (len(x["payload"] or b"") if "payload" in names else 0)
        if size > 4 << 20:
            yield record({n: [r[n] for r in rows] for n in names}, arrow)
            rows, size = [], 0
    if rows:
        yield record({n: [r[n] for r in rows] for n in names}, arrow)


def read_archives(files: DataFrame, folder: str, payloads: bool = False) -> DataFrame:
    """Every capture in the archives that ``files`` lists, a task for some files each."""
    struct = T._parse_datatype_string(CAPTURES if payloads else CAPTURES.removesuffix(", payload binary"))
    arrow = arrow_schema(struct)
    spread = files.select("file", "directory_offset", "directory_length")
    n = max(1, spread.count())

    def run(batches):
        for batch in batches:
            for row in batch.to_pylist():
                archive = Archive(folder, row)
                yield from emitted(archive.all(), arrow.names, arrow)
                archive.close()

    return spread.repartitionByRange(n, "file").mapInArrow(run, struct)


def lookup(files: DataFrame, folder: str, urls: DataFrame) -> DataFrame:
    """Captures that share a key with the urls (column ``url``): asked, and the columns of
    a capture."""
    return search(files, folder, urls.select(F.col("url").cast("string").alias("asked"), url_key(F.col("url")).alias("key")).distinct())


def search(files: DataFrame, folder: str, asked: DataFrame, payloads: bool = True) -> DataFrame:
    """Captures of each (asked, key) row: asked, and the columns of a capture.

    The table of files has a row per archive, not per page, and is searched on every
    executor; each file's requests then go to one task, split where they are many.
    """
    table = sorted((r["first_key"], r["last_key"], r["file"], r["directory_offset"], r["directory_length"]) for r in files.collect())
    firsts, lasts = [t[0] for t in table], [t[1] for t in table]
    routed = T._parse_datatype_string("asked string, key string, file int")
    routed_arrow = arrow_schema(routed)

    def route(batches):
        for batch in batches:
            keys = column(batch, "key").to_pylist()
            spans = [range(bisect_left(lasts, k), bisect_right(firsts, k)) for k in keys]
            at = np.repeat(np.arange(len(keys)), [len(s) for s in spans])
            yield record({"asked": column(batch, "asked").take(pa.array(at)), "key": column(batch, "key").take(pa.array(at)), "file": [i for s in spans for i in s]}, routed_arrow)

    struct = T._parse_datatype_string("asked string, " + (CAPTURES if payloads else CAPTURES.removesuffix(", payload binary")))
    arrow = arrow_schema(struct)

    def run(batches):
        opened: tuple[int, Archive] | None = None
        for batch in batches:
            for asked_url, key, file in zip(*(column(batch, c).to_pylist() for c in ("asked", "key", "file")), strict=True):
                if opened is None or opened[0] != file:
                    if opened:
                        opened[1].close()
                    _, _, name, offset, length = table[file]
                    opened = (file, Archive(folder, {"file": name, "directory_offset": offset, "directory_length": length}))
                yield from emitted(opened[1].find(key), arrow.names, arrow, {"asked": asked_url})

    to = asked.mapInArrow(route, routed)
    return to.repartition("file", F.pmod(F.xxhash64("key"), F.lit(16))).sortWithinPartitions("file", "key").mapInArrow(run, struct)


def archive_folder(df: DataFrame) -> str:
    return fresh_folder(df.sparkSession, "warc")


def round_trip(pages: DataFrame, min_bytes: int = 0) -> DataFrame:
    """Write every page to archives and find each again by its key through the index:
    page_id, url, payload_bytes, payload_digest, record_type, refers_to. A record that the
    search missed would be missing here; :func:`read_archives` reads without a search."""
    folder = archive_folder(pages)
    keys = pages.select(url_key(F.col("url").cast("string")).alias("key")).distinct().select(F.lit(None).cast("string").alias("asked"), "key")
    return search(write_archives(pages, folder, min_bytes), folder, keys, payloads=False).drop("asked")
