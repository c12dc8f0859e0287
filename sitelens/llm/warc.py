"""WARC archives of web pages and a globally ordered index of their captures.

Writing: of pages with equal payloads the one with the largest id is stored as a
response, the others as revisits that refer to it. Records are written by Spark's
text writer, whose line separator is the end of a record, so the archives may lie
in any store that Spark reaches.

Reading: each archive is parsed by one task and gives a run of index entries,
sorted by URL key and time of capture. Runs are dealt to ranges of that order;
each range merges its parts of the runs with a loser tree, and sums over the
ranges number the captures globally.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import uuid
from collections.abc import Iterator
from urllib.parse import unquote, urlsplit

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sitelens.llm.store import settle, shared_folder

RECORD_END = "\r\n\r\n"
#: Bytes of payload in an archive, about; entries in a range of the merge, about, and ranges beyond those.
ARCHIVE_BYTES, RANGE_ROWS, SPARE_RANGES = 16 << 20, 16384, 24
_TRIPLES = "0123456789ABCDEFGHIJKLMNOPQRSTUV"
_BASE32 = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
ENTRY = (
    "url_key string, captured string, page string, url string, record_type string, payload_bytes bigint, "
    "payload_digest string, refers_to string, archive string, at bigint, length bigint"
)


def sha1_base32(payload: Column) -> Column:
    """SHA-1 in upper-case base 32: five hexadecimal digits are four digits of base 32."""
    digest = F.sha1(payload)
    parts = [F.lpad(F.conv(F.substring(digest, 1 + 5 * i, 5), 16, 32), 4, "0") for i in range(8)]
    return F.translate(F.concat(*parts), _TRIPLES, _BASE32)


def url_key(url: str) -> str:
    """Host labels from the top domain down, then path and sorted query, in small letters; no scheme or fragment."""
    try:
        parts = urlsplit(url.strip())
        host, port = (parts.hostname or ""), parts.port
    except ValueError:
        return url.strip().lower()
    labels = host.removeprefix("www.").split(".")
    standard = port is None or (parts.scheme, port) in (("http", 80), ("https", 443))
    query = "&".join(sorted(parts.query.split("&"))) if parts.query else ""
    return (",".join(reversed(labels)) + ("" if standard else f":{port}") + ")" + (parts.path or "/") + ("?" + query if query else "")).lower()


def classified(pages: DataFrame, page: str, url: str, html: str, captured: Column, least_bytes: int) -> DataFrame:
    """(page, url, payload, captured, digest, n, refers_to): refers_to is null for responses."""
    body = F.coalesce(F.col(f"`{html}`").cast("string"), F.lit(""))
    rows = pages.select(
        F.col(f"`{page}`").alias("page"),
        F.coalesce(F.col(f"`{url}`").cast("string"), F.lit("")).alias("url"),
        body.alias("payload"),
        captured.alias("captured"),
        sha1_base32(body.cast("binary")).alias("digest"),
        F.octet_length(body).cast("bigint").alias("n"),
    )
    narrow = settle(rows.filter(F.col("n") >= least_bytes).select("page", "digest"), "payload-digests")
    largest = narrow.groupBy("digest").agg(F.max("page").alias("refers_to"))
    again = narrow.join(largest, "digest").filter("refers_to is not null and (page is null or page < refers_to)").distinct()
    again = settle(again.select(F.col("page").alias("old_page"), F.col("digest").alias("old_digest"), "refers_to"), "revisits")
    same = F.col("page").eqNullSafe(F.col("old_page")) & (F.col("digest") == F.col("old_digest"))
    return rows.join(again, same, "left").drop("old_page", "old_digest")


def _header_text(c: Column) -> Column:
    """Text that may stand in a header: per cent signs, control characters and spaces as %XX."""
    for ch in ["%", *[chr(i) for i in range(33)], "\x7f"]:
        c = F.replace(c, F.lit(ch), F.lit("%" + format(ord(ch), "02X")))
    return c


def records(rows: DataFrame) -> DataFrame:
    """One text per record, without the end of the record."""
    http = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "), F.col("n").cast("string"), F.lit("\r\n\r\n"))
    revisit = F.col("refers_to").isNotNull()
    block = F.when(revisit, http).otherwise(F.concat(http, "payload"))
    name = lambda c: F.concat(F.lit("<urn:page:"), F.coalesce(_header_text(c.cast("string")), F.lit("")), F.lit(">"))
    head = F.concat(
        F.lit("WARC/1.1\r\nWARC-Type: "),
        F.when(revisit, "revisit").otherwise("response"),
        F.lit("\r\nWARC-Record-ID: "),
        name(F.col("page")),
        F.lit("\r\nWARC-Date: "),
        F.col("captured"),
        F.lit("\r\nWARC-Target-URI: "),
        _header_text(F.col("url")),
        F.lit("\r\nWARC-Payload-Digest: sha1:"),
        F.col("digest"),
        F.when(
            revisit,
            F.concat(F.lit("\r\nWARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest\r\nWARC-Refers-To: "), name(F.col("refers_to"))),
        ).otherwise(""),
        F.lit("\r\nContent-Type: application/http; msgtype=response\r\nContent-Length: "),
    )
    return rows.withColumn("block", block).select(
        F.concat(head, F.octet_length("block").cast("string"), F.lit("\r\n\r\n"), "block").alias("value")
    )


def write_archives(
    pages: DataFrame,
    folder: str,
    page: str = "page_id",
    url: str = "url",
    html: str = "html",
    captured: Column | None = None,
    least_bytes: int = 0,
) -> None:
    """Write one record per row into compressed archives below ``folder``.

    Payloads of fewer than ``least_bytes`` bytes are never revisits. Null html is
    an empty payload, a null URL an empty one. Rows without an id revisit the
    largest id of their payload, or are responses if there is none; rows that
    repeat the largest id are responses each. ``captured`` is text in ISO form;
    by default seconds counted by the id. Other columns are not written.
    """
    if captured is None:
        second = F.pmod(F.coalesce(F.xxhash64(F.col(f"`{page}`").cast("string")), F.lit(0)), F.lit(10**9))
        kind = pages.schema[page].dataType.typeName()
        if kind in ("long", "integer", "short", "byte"):
            second = F.pmod(F.coalesce(F.col(f"`{page}`").cast("bigint"), F.lit(0)), F.lit(10**9))
        captured = F.date_format(F.timestamp_seconds(second + 10**9), "yyyy-MM-dd'T'HH:mm:ss'Z'")
    rows = classified(pages, page, url, html, captured, least_bytes)
    size, count = pages.agg(F.sum(F.octet_length(F.col(f"`{html}`").cast("string"))), F.count("*")).first()
    per_file = max(1, int(ARCHIVE_BYTES // max(1, (size or 0) // max(1, count) + 512)))
    records(rows).write.option("lineSep", RECORD_END).option("compression", "gzip").option("maxRecordsPerFile", per_file).text(folder)


def parsed(archive: bytes) -> Iterator[dict]:
    """The records of one archive, with their payload; a digest that does not fit is an error."""
    at, end = 0, RECORD_END.encode()
    while at < len(archive):
        stop = archive.index(end, at)
        lines = archive[at:stop].decode().split("\r\n")
        head = dict(x.split(": ", 1) if ": " in x else (x.rstrip(":"), "") for x in lines[1:])
        start = stop + len(end)
        size = int(head["Content-Length"])
        block = archive[start : start + size]
        http, _, payload = block.partition(end)
        n = int(http.rsplit(b"Content-Length: ", 1)[1])
        digest = head["WARC-Payload-Digest"].removeprefix("sha1:")
        kind = head["WARC-Type"]
        if kind == "response" and (len(payload) != n or base64.b32encode(hashlib.sha1(payload).digest()).decode() != digest):
            raise ValueError(f"payload of {head['WARC-Record-ID']} does not fit its digest")
        page = lambda key: unquote(head[key][len("<urn:page:") : -1]) if head.get(key) else None
        following = start + size + len(end)
        yield {
            "head": head,
            "page": page("WARC-Record-ID") or None,
            "refers_to": page("WARC-Refers-To"),
            "url": unquote(head["WARC-Target-URI"]),
            "captured": head["WARC-Date"],
            "record_type": kind,
            "payload": payload,
            "payload_bytes": n,
            "payload_digest": digest,
            "at": at,
            "length": following - at,
        }
        at = following


def _order(entry: dict) -> tuple:
    return entry["url_key"], entry["captured"], entry["page"] or ""


def runs(spark: SparkSession, folder: str) -> DataFrame:
    """Index entries of every archive, each archive's in the order of key, time and page, with their place in that run."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [x.split()[0] for x in ENTRY.split(", ")]
        for batch in batches:
            for path, content in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                entries = []
                for r in parsed(gzip.decompress(content)):
                    r["url_key"], r["archive"] = url_key(r["url"]), path.rsplit("/", 1)[1]
                    del r["payload"], r["head"]
                    entries.append(r)
                entries.sort(key=_order)
                longs = {"payload_bytes", "at", "length"}
                columns = {n: pa.array([e[n] for e in entries], pa.int64() if n in longs else pa.string()) for n in names}
                columns["run"] = pa.array([path.rsplit("/", 1)[1]] * len(entries), pa.string())
                columns["step"] = pa.array(range(len(entries)), pa.int64())
                yield pa.RecordBatch.from_pydict(columns)

    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.gz").load(folder)
    return files.select("path", "content").mapInArrow(read, ENTRY + ", run string, step bigint")


class LoserTree:
    """Merges sorted lists: inner nodes keep the loser of their match, so one path is replayed per item."""

    def __init__(self, lists: list[list]):
        self.lists, self.at, self.k = lists, [0] * len(lists), len(lists)
        self.losers = [-1] * self.k
        for leaf in range(self.k):
            self._replay(leaf)

    def _beats(self, a: int, b: int) -> bool:
        """Whether list a's next item comes before list b's; a spent list loses, ties go to the lower list."""
        if self.at[a] >= len(self.lists[a]):
            return False
        if self.at[b] >= len(self.lists[b]):
            return True
        x, y = self.lists[a][self.at[a]], self.lists[b][self.at[b]]
        return x < y or (x == y and a < b)

    def _replay(self, leaf: int) -> None:
        winner, node = leaf, (leaf + self.k) // 2
        while node > 0:
            if self.losers[node] < 0:
                self.losers[node] = winner
                return
            if self._beats(self.losers[node], winner):
                self.losers[node], winner = winner, self.losers[node]
            node //= 2
        self.losers[0] = winner

    def __iter__(self):
        while self.k and self.at[self.losers[0]] < len(self.lists[self.losers[0]]):
            w = self.losers[0]
            yield self.lists[w][self.at[w]]
            self.at[w] += 1
            self._replay(w)


def merged(entries: DataFrame) -> DataFrame:
    """All runs in one order: the entries with ``position`` (from 0) and ``capture``, their number within the URL key (from 1).

    An empty index gives an empty one. Entries that agree in key, time and page
    stand in the order of their archives.
    """
    entries = settle(entries, "capture-runs")
    ranges = SPARE_RANGES + entries.count() // RANGE_ROWS
    names = entries.columns

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = pa.Table.from_batches(list(batches))
        if not len(table):
            return
        run, lists = table.column("run").to_pylist(), []
        keys = zip(*[table.column(c).to_pylist() for c in ("url_key", "captured", "page")])
        for i, (r, (key, time, page)) in enumerate(zip(run, keys)):
            if not i or r != run[i - 1]:
                lists.append([])
            lists[-1].append((key, time, page or "", i))
        order = [x[3] for x in LoserTree(lists)]
        out = table.take(pa.array(order))
        out = out.append_column("part", pa.array([TaskContext.get().partitionId()] * len(order), pa.int32()))
        yield from out.append_column("place", pa.array(range(len(order)), pa.int64())).combine_chunks().to_batches()

    dealt = entries.repartitionByRange(ranges, "url_key", "captured", F.coalesce("page", F.lit("")))
    ordered = settle(
        dealt.sortWithinPartitions("run", "step").select(*names).mapInArrow(merge, ENTRY + ", run string, step bigint, part int, place bigint"),
        "capture-ranges",
    )
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts = ordered.groupBy("part").agg(F.count("*").alias("n"))
    parts = settle(parts.select("part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base")), "capture-offsets")
    placed = ordered.join(parts, "part").withColumn("position", F.col("base") + F.col("place"))
    firsts = placed.groupBy("url_key").agg(F.min("position").alias("first"))
    return (
        placed.join(firsts, "url_key")
        .withColumn("capture", F.col("position") - F.col("first") + 1)
        .drop("run", "step", "part", "place", "base", "first")
    )


def captured_pages(pages: DataFrame, folder: str | None = None, **names) -> DataFrame:
    """Write the archives, read them back and return the ordered index; ``page`` and ``refers_to`` are text."""
    spark = pages.sparkSession
    folder = folder or f"{shared_folder(spark).rstrip('/')}/archives-{uuid.uuid4().hex}"
    write_archives(pages, folder, **names)
    return merged(runs(spark, folder))
