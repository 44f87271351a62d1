"""WARC archives with revisit records, and the global capture index over them.

Records are Spark text rows that end in an empty line, so Spark's own writer makes
the archives, on any file system and with its commit protocol. Every archive is
sorted by URL key and time: a sorted run. Reading an archive gives its part of the
index in that order; the index rows are dealt out by key range, and in each range
a loser tree merges the runs into one ordered history.
"""

from __future__ import annotations

import hashlib
import math
import zlib
from base64 import b32encode

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from glyphlake.llm.common import written
from glyphlake.llm.url_filter import url_parts

GAP = "\r\n\r\n"
BASE32 = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
#: Captures in one range of the merged index, about.
RANGE_ROWS = 100_000


def base32(hexadecimal: Column) -> Column:
    """Upper-case base32 of the 40 hex digits of a SHA-1: ten of them are eight base32 digits."""
    parts = [F.lpad(F.conv(F.substring(hexadecimal, at, 10), 16, 32), 8, "0") for at in (1, 11, 21, 31)]
    return F.translate(F.concat(*parts), "0123456789ABCDEFGHIJKLMNOPQRSTUV", BASE32)


def url_key(url: Column) -> Column:
    """Host labels in reverse, then path and query, for sorting; empty without host."""
    host, path, query = url_parts(url)
    return F.concat(F.array_join(F.reverse(F.split(host, "[.]")), ","), F.when(host != "", ")").otherwise(""), path,
                    F.when(query != "", F.concat(F.lit("?"), query)).otherwise(""))


def write_archives(pages: DataFrame, path: str, min_bytes: int = 0, page_id: str = "page_id", url: str = "url",
                   html: str = "html", max_records: int = 20_000) -> None:
    """One record per row of ``pages`` in gzipped archives under ``path``.

    Of rows with equal payloads of ``min_bytes`` or more, those with the largest
    id are responses and the others revisit it; every other row is a response. A
    null payload is empty, a null id is smaller than any id, a null URL leaves
    its header out. Control characters and blanks in a URL are percent-encoded
    in the header. The capture time is derived from the id.
    """
    rows = pages.select(F.col(page_id).alias("page_id"), F.col(url).alias("url"),
                        F.coalesce(F.col(html), F.lit("")).alias("payload"))
    rows = rows.withColumns({"sha1": F.sha1("payload"), "bytes": F.octet_length("payload")})
    repeated = (rows.where(F.col("bytes") >= min_bytes).groupBy("sha1")
                .agg(F.max("page_id").alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1").drop("n"))
    rows = rows.join(repeated, "sha1", "left")
    revisit = (F.col("bytes") >= min_bytes) & F.col("first").isNotNull() & ~F.col("first").eqNullSafe(F.col("page_id"))
    uri = F.col("url")
    for c in [*map(chr, range(33)), "\x7f"]:
        uri = F.replace(uri, F.lit(c), F.lit(f"%{ord(c):02X}"))
    uri = F.when(F.col("url").rlike(r"[\x00-\x20\x7f]"), uri).otherwise(F.col("url"))
    seconds = F.timestamp_seconds(1_600_000_000 + F.coalesce(F.col("page_id"), F.lit(0)) % 1_000_000_000)
    date = F.date_format(F.to_utc_timestamp(seconds, F.current_timezone()), "yyyy-MM-dd'T'HH:mm:ss'Z'")
    rows = rows.select("page_id", "payload", "bytes", "first", uri.alias("uri"), date.alias("date"),
                       base32(F.col("sha1")).alias("digest"), revisit.alias("revisit"))
    name = F.coalesce(F.col("page_id").cast("string"), F.lit("null"))
    kept = F.when(F.col("revisit"), 0).otherwise(F.col("bytes"))
    head = F.concat(
        F.lit("WARC/1.1\r\nWARC-Type: "), F.when(F.col("revisit"), "revisit").otherwise("response"),
        F.lit("\r\nWARC-Record-ID: <urn:page:"), name, F.lit(">"),
        F.coalesce(F.concat(F.lit("\r\nWARC-Target-URI: "), "uri"), F.lit("")),
        F.lit("\r\nWARC-Date: "), "date", F.lit("\r\nWARC-Payload-Digest: sha1:"), "digest",
        F.when(F.col("revisit"), F.concat(
            F.lit("\r\nWARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
                  "\r\nWARC-Refers-To: <urn:page:"), "first", F.lit(">\r\nX-Payload-Length: "), "bytes")).otherwise(""),
        F.lit("\r\nContent-Type: text/html\r\nContent-Length: "), kept, F.lit(GAP))
    body = F.when(F.col("revisit"), "").otherwise(F.col("payload"))
    (rows.select(url_key(F.col("uri")).alias("key"), "date", "page_id", F.concat(head, body).alias("record"))
     .sortWithinPartitions("key", "date", "page_id").select("record")
     .write.option("lineSep", GAP).option("compression", "gzip").option("maxRecordsPerFile", max_records).text(path))


def _records(packed: bytes):
    """(offset, headers, payload) of every record of a gzipped archive, one at a time."""
    unzip, at, have = zlib.decompressobj(31), 0, bytearray()
    chunks = (packed[i:i + 65_536] for i in range(0, len(packed), 65_536))

    def more():
        for chunk in chunks:
            got = unzip.decompress(chunk)
            if got:
                have.extend(got)
                return True
        return False

    while have or more():
        seen = 0
        while (end := have.find(b"\r\n\r\n", seen)) < 0:
            seen = max(0, len(have) - 3)
            if not more():
                raise ValueError("an archive ends inside a header")
        lines = have[:end].decode().split("\r\n")
        if not lines[0].startswith("WARC/"):
            raise ValueError("a record does not start where the last one ended")
        headers = dict(line.split(": ", 1) for line in lines[1:])
        stop = end + 4 + int(headers["Content-Length"])
        while len(have) < stop + 4:
            if not more():
                raise ValueError("an archive ends inside a payload")
        yield at, headers, bytes(have[end + 4:stop])
        del have[:stop + 4]
        at += stop + 4


_INDEX = ("archive string, offset bigint, uri string, date string, page_id bigint, payload_bytes bigint, "
          "payload_digest string, record_type string, refers_to bigint")


def read_archives(spark: SparkSession, path: str) -> DataFrame:
    """One index row per record, in the order of each archive; payloads are checked against their digests."""
    names = [c.split()[0] for c in _INDEX.split(", ")]
    types = [pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64()]

    def number(urn):
        digits = urn[len("<urn:page:"):-1] if urn else "null"
        return None if digits == "null" else int(digits)

    def run(batches):
        for batch in batches:
            for name, packed in zip(batch.column("path").to_pylist(), batch.column("content")):
                out = []
                for at, h, payload in _records(packed.as_py()):
                    digest, kind = h["WARC-Payload-Digest"].removeprefix("sha1:"), h["WARC-Type"]
                    if kind == "response" and b32encode(hashlib.sha1(payload).digest()).decode() != digest:
                        raise ValueError(f"wrong payload digest in {name} at {at}")
                    out.append((name, at, h.get("WARC-Target-URI"), h["WARC-Date"], number(h["WARC-Record-ID"]),
                                len(payload) if kind == "response" else int(h["X-Payload-Length"]), digest, kind,
                                number(h.get("WARC-Refers-To"))))
                if out:
                    yield pa.RecordBatch.from_arrays(list(map(pa.array, zip(*out), types)), names)

    files = (spark.read.format("binaryFile").option("pathGlobFilter", "part-*").schema(
        "path string, modificationTime timestamp, length bigint, content binary").load(path))
    return files.select("path", "content").mapInArrow(run, _INDEX)


class LoserTree:
    """Smallest first out of k sorted lists. Inner nodes hold the loser of their match, node 0 the winner."""

    def __init__(self, runs, key):
        self.runs, self.key, k = [iter(r) for r in runs], key, len(runs)
        self.heads = [next(r, None) for r in self.runs]
        self.keys = [None if h is None else key(h) for h in self.heads]
        self.k, self.tree = k, [0] * max(k, 1)
        winners = [0] * k + list(range(k))
        for node in range(k - 1, 0, -1):
            a, b = winners[2 * node], winners[2 * node + 1]
            winners[node], self.tree[node] = (a, b) if self._before(a, b) else (b, a)
        self.tree[0] = winners[1] if k > 1 else 0

    def _before(self, a, b):
        x, y = self.keys[a], self.keys[b]
        return y is None or (x is not None and (x, a) < (y, b))

    def __iter__(self):
        while self.k and self.keys[self.tree[0]] is not None:
            run = self.tree[0]
            yield self.heads[run]
            self.heads[run] = head = next(self.runs[run], None)
            self.keys[run] = None if head is None else self.key(head)
            node = (run + self.k) // 2
            while node:
                if self._before(self.tree[node], run):
                    run, self.tree[node] = self.tree[node], run
                node //= 2
            self.tree[0] = run


def merge_runs(index: DataFrame) -> DataFrame:
    """The index of all archives in one order of URL key, time and page, over its partitions in order.

    A range has about ``RANGE_ROWS`` narrow rows however often one URL occurs,
    because time and page are part of the key.
    """
    table = written(index.withColumn("key", F.coalesce(url_key(F.col("uri")), F.lit(""))), "captures")
    ranges = max(1, math.ceil(table.count() / RANGE_ROWS))
    dealt = (table.repartitionByRange(ranges, "key", "date", "page_id", "archive", "offset")
             .sortWithinPartitions("archive", "offset"))
    names = table.columns

    def run(batches):
        runs: dict[str, list] = {}
        schema = None
        for batch in batches:
            schema = batch.schema
            for row in zip(*(c.to_pylist() for c in batch.columns)):
                runs.setdefault(row[0], []).append(row)
        if not runs:
            return
        key, date, page = names.index("key"), names.index("date"), names.index("page_id")
        tree = LoserTree(runs.values(), lambda r: (r[key], r[date], r[page] is not None, r[page] or 0))
        out = []
        for row in tree:
            out.append(row)
            if len(out) == 10_000:
                yield pa.RecordBatch.from_arrays(list(map(pa.array, zip(*out), schema.types)), schema=schema)
                out = []
        if out:
            yield pa.RecordBatch.from_arrays(list(map(pa.array, zip(*out), schema.types)), schema=schema)

    return dealt.mapInArrow(run, table.schema)
