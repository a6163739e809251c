"""WARC archives of pages, and the merge of their capture indexes."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from urllib.parse import urlsplit

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from genoloom.llm.scratch import Scratch

LEAST_BYTES = 100
RECORDS_PER_ARCHIVE = 2000
RANGE_ROWS = 200_000
#: Capture times run on from here, a second a page id.
EPOCH = 1_577_836_800
INDEX = "url_key string, capture_time long, page_id long, archive string, position long, record_length long, payload_bytes long, payload_digest string, record_type string, refers_to long"


def with_revisits(pages: DataFrame, scratch: Scratch, least: int = LEAST_BYTES) -> DataFrame:
    """page_id, url, html, digest, refers_to: null for a response. Payloads are compared by SHA-256 over all pages."""
    html = F.coalesce(F.col("html"), F.lit(""))
    rows = pages.select("page_id", F.coalesce(F.regexp_replace("url", "[\\r\\n]", ""), F.lit("")).alias("url"), html.alias("html"), F.sha2(html.cast("binary"), 256).alias("digest"))
    groups = rows.filter(F.octet_length("html") >= least).groupBy("digest").agg(F.min("page_id").alias("origin"), F.count("*").alias("n")).filter("n > 1").select("digest", "origin")
    return rows.join(scratch.keep(groups, "groups"), "digest", "left").withColumn("refers_to", F.when(F.col("origin") != F.col("page_id"), F.col("origin"))).drop("origin")


def write_archives(pages: DataFrame, path: str, records: int = RECORDS_PER_ARCHIVE) -> None:
    """One WARC record a row, separated as the format asks, in archives of ``records`` at most.

    A record is header lines, a blank line, the payload and two line ends; the text writer adds the latter. A revisit
    has no payload, but the digest and length of the one it stands for.
    """
    line = "\r\n"
    response = F.col("refers_to").isNull()
    page = F.coalesce(F.col("page_id").cast("string"), F.lit(""))
    head = F.concat(
        F.lit(f"WARC/1.1{line}WARC-Type: "), F.when(response, "response").otherwise("revisit"),
        F.lit(f"{line}WARC-Record-ID: <urn:page:"), page, F.lit(f">{line}WARC-Target-URI: "), F.col("url"),
        F.lit(f"{line}WARC-Date: "), F.date_format(F.timestamp_seconds(F.lit(EPOCH) + F.coalesce(F.pmod("page_id", F.lit(1 << 31)), F.lit(0))), "yyyy-MM-dd'T'HH:mm:ss'Z'"),
        F.lit(f"{line}WARC-Payload-Digest: sha256:"), F.col("digest"), F.lit(f"{line}X-Payload-Length: "), F.octet_length("html").cast("string"),
        F.when(response, "").otherwise(F.concat(F.lit(f"{line}WARC-Refers-To: <urn:page:"), F.col("refers_to").cast("string"), F.lit(">"))),
        F.lit(f"{line}Content-Type: text/html{line}Content-Length: "), F.when(response, F.octet_length("html")).otherwise(0).cast("string"), F.lit(line + line),
    )
    pages.select(F.concat(head, F.when(response, F.col("html")).otherwise("")).alias("value")).write.option("lineSep", line + line).option("maxRecordsPerFile", records).text(path)


def url_key(url: str) -> str:
    """Sort-friendly form: host labels reversed, then port, path and query; scheme, leading www. and fragment go."""
    try:
        parts = urlsplit(url.strip().lower())
        host = re.sub(r"^www\d*\.", "", parts.hostname or "")
        port = f":{parts.port}" if parts.port else ""
    except ValueError:
        return url.strip().lower()
    return ",".join(reversed(host.split("."))) + port + ")" + (parts.path or "/") + (f"?{parts.query}" if parts.query else "")


def page_number(field: str | None) -> int | None:
    digits = (field or "").removeprefix("<urn:page:").removesuffix(">")
    return int(digits) if digits else None


def read_records(archive: bytes) -> Iterator[tuple[int, int, dict[str, str], bytes]]:
    """Position, length, header fields and block of each record, by the lengths that the records state."""
    at = 0
    while at < len(archive):
        body = archive.index(b"\r\n\r\n", at) + 4
        fields = dict(x.split(": ", 1) for x in archive[at : body - 4].decode().split("\r\n")[1:])
        end = body + int(fields["Content-Length"])
        yield at, end - at, fields, archive[body:end]
        if archive[end : end + 4] != b"\r\n\r\n":
            raise ValueError(f"no record end at {end}")
        at = end + 4


def index_entry(name: str, at: int, length: int, fields: dict[str, str], block: bytes, seconds) -> tuple:
    kind = fields["WARC-Type"]
    size, digest = int(fields["X-Payload-Length"]), fields["WARC-Payload-Digest"].removeprefix("sha256:")
    if kind == "response":
        size, digest = len(block), hashlib.sha256(block).hexdigest()
        if f"sha256:{digest}" != fields["WARC-Payload-Digest"]:
            raise ValueError(f"{name}: the payload at {at} is not what its digest says")
    return url_key(fields["WARC-Target-URI"]), seconds(fields["WARC-Date"]), page_number(fields["WARC-Record-ID"]), name, at, length, size, digest, kind, page_number(fields.get("WARC-Refers-To"))


def order(entry: tuple) -> tuple:
    return entry[0], entry[1], entry[2] is not None, entry[2] or 0


def table(entries: list[tuple]) -> pa.RecordBatch:
    names = [x.split() for x in INDEX.split(", ")]
    columns = list(zip(*entries, strict=True)) or [()] * len(names)
    return pa.RecordBatch.from_arrays([pa.array(c, pa.string() if kind == "string" else pa.int64()) for c, (_, kind) in zip(columns, names, strict=True)], [n for n, _ in names])


def capture_runs(spark, path: str) -> DataFrame:
    """The index of each archive, locally sorted: a run. Payloads are read whole and checked against their digests."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from calendar import timegm
        from time import strptime

        for batch in batches:
            for name, content in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                entries = [index_entry(name.rpartition("/")[2], *record, lambda x: timegm(strptime(x, "%Y-%m-%dT%H:%M:%SZ"))) for record in read_records(content.as_py())]
                yield table(sorted(entries, key=order))

    return spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(path).select("path", "content").mapInArrow(run, INDEX)


class LoserTree:
    """Merges sorted iterators: inner nodes hold the losers of their matches, so the next winner costs one path."""

    def __init__(self, runs: list[Iterator[tuple]]):
        self.runs, self.k = runs, max(1, len(runs))
        self.heads = [next(r, None) for r in runs] or [None]
        self.losers = [-1] * self.k
        for i in range(self.k):
            self.replay(i)

    def beats(self, a: int, b: int) -> bool:
        if a < 0 or b < 0:
            return a < 0
        x, y = self.heads[a], self.heads[b]
        return y is None if x is None or y is None else (x[0], a) < (y[0], b)

    def replay(self, winner: int) -> None:
        node = (winner + self.k) // 2
        while node:
            if self.beats(self.losers[node], winner):
                winner, self.losers[node] = self.losers[node], winner
            node //= 2
        self.losers[0] = winner

    def __iter__(self) -> Iterator[tuple]:
        while (head := self.heads[self.losers[0]]) is not None:
            yield head[1]
            winner = self.losers[0]
            self.heads[winner] = next(self.runs[winner], None)
            self.replay(winner)


def merge_runs(runs: DataFrame, partitions: int) -> DataFrame:
    """Capture histories in global order of (url_key, capture_time, page_id), over partitions that follow one another.

    Ranges are cut on the whole order, so captures of one hot URL spread over many. In a range the part that each
    archive's run has there is already in order (or is put in order again), and the parts meet in a loser tree.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts: dict[str, list[tuple]] = {}
        for batch in batches:
            for entry in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                parts.setdefault(entry[3], []).append((order(entry), entry))
        for part in parts.values():
            if any(a[0] > b[0] for a, b in zip(part, part[1:], strict=False)):
                part.sort(key=lambda x: x[0])
        held: list[tuple] = []
        for entry in LoserTree([iter(parts[name]) for name in sorted(parts)]):
            held.append(entry)
            if len(held) == 10_000:
                yield table(held)
                held = []
        if held:
            yield table(held)

    return runs.repartitionByRange(partitions, "url_key", "capture_time", "page_id").mapInArrow(run, INDEX)


def capture_history(pages: DataFrame, least: int = LEAST_BYTES, records: int = RECORDS_PER_ARCHIVE) -> DataFrame:
    """Write ``pages`` (page_id, url, html) as WARC archives, read them back and merge their indexes: columns INDEX.

    Of pages with equal payloads of ``least`` bytes or more that with the smallest page_id is response (all its rows,
    if they repeat; all rows, if no id is known), the others are revisits. Null html is an empty payload, a null url an
    empty one. Archives stay in the shared folder, for the positions to lead to. An empty table has no archive record.
    """
    spark, scratch = pages.sparkSession, Scratch(pages.sparkSession, "warc")
    write_archives(with_revisits(pages.select("page_id", "url", "html"), scratch, least), scratch.path("archives"), records)
    runs = scratch.keep(capture_runs(spark, scratch.path("archives")), "runs")
    return merge_runs(runs, max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-runs.count() // RANGE_ROWS)))


SQL = """
WITH p AS (SELECT page_id, coalesce(html, '') AS html FROM pages),
d AS (SELECT page_id, strlen(html) AS payload_bytes, sha256(html) AS payload_digest FROM p),
f AS (SELECT *, min(page_id) OVER (PARTITION BY payload_digest) AS origin FROM d)
SELECT page_id, payload_bytes, payload_digest,
  CASE WHEN payload_bytes >= 100 AND origin <> page_id THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN payload_bytes >= 100 AND origin <> page_id THEN origin END AS refers_to
FROM f
"""
