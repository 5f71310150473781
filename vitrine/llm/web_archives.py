"""WARC archives of pages and a merged capture index.

Pages become WARC records (repeated payloads as revisits) in gzip files that Spark's text writer puts in the shared
folder: a record is text whose terminator is the line separator. Reading rebuilds the byte stream of each file and
cuts records by their Content-Length. The index is merged from locally sorted capture runs: runs are dealt by ranges
of (URL key, timestamp) and a loser tree merges what each range has of them.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator
from urllib.parse import urlsplit

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType, StructField, StructType

from .staging import ready, shared_path, staged

END = "\r\n\r\n"
RECORDS_PER_FILE = 2000
RUN_ROWS = 50_000
#: Captures of one range of the merged index, about; a range is merged in memory.
RANGE_ROWS = 1 << 17
#: Time of the capture of page 0 where pages have no time of their own; each page is a second later.
FIRST_CAPTURE = 1_577_836_800
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
CAPTURE = "page_id long, url string, urlkey string, timestamp string, record_type string, refers_to long, payload_bytes long, payload_digest string, file string, offset long, length long, intact boolean"


def base32_sha1(payload: Column) -> Column:
    """SHA-1 in upper-case base32, as archives write it."""
    return _base32(F.sha1(payload))


def _base32(digest: Column) -> Column:
    """Ten hex digits at a time as eight digits of base 32, whose digits then become letters."""
    pieces = [F.lpad(F.conv(F.substring(digest, 10 * i + 1, 10), 16, 32), 8, "0") for i in range(4)]
    return F.translate(F.upper(F.concat(*pieces)), "0123456789ABCDEFGHIJKLMNOPQRSTUV", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567")


def write_archives(pages: DataFrame, path: str, revisit_from: int = 0) -> None:
    """Write one WARC record for each row of ``pages`` (``page_id``, ``url``, ``html``) below ``path``.

    Of rows with equal payloads of at least ``revisit_from`` bytes those with the smallest page_id are responses, the
    others revisits without a payload that name it. A null html is an empty payload, a null url or page_id an empty
    header; line ends inside a url are escaped. Repeated rows are separate records. Digests find the first page of a
    payload without it; pages are shuffled once, by page and digest, so that copies of one payload do not meet.
    """
    payload = F.coalesce(F.col("html").cast("string"), F.lit(""))
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), payload.alias("payload"))
    rows = rows.withColumn("bytes", F.octet_length("payload").cast("long")).withColumn("hash", F.sha1("payload"))
    named = rows.where((F.col("bytes") >= revisit_from) & F.col("page_id").isNotNull()).select("page_id", "hash").distinct()
    repeated = named.groupBy("hash").agg(F.min("page_id").alias("first"), F.count("*").alias("n")).where("n > 1").select("hash", "first")
    revisits = named.join(repeated.hint("shuffle_hash"), "hash").where("page_id <> first")
    rows = rows.join(revisits.hint("shuffle_hash"), ["page_id", "hash"], "left").withColumn("digest", _base32(F.col("hash")))
    revisit = F.col("first").isNotNull()
    http = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=UTF-8\r\nContent-Length: "), F.col("bytes").cast("string"), F.lit(END))
    block = F.when(revisit, http).otherwise(F.concat(http, F.col("payload")))
    name = lambda c: F.concat(F.lit("<urn:page:"), F.coalesce(F.col(c).cast("string"), F.lit("")), F.lit(">"))
    url = F.replace(F.replace(F.coalesce("url", F.lit("")), F.lit("\r"), F.lit("%0D")), F.lit("\n"), F.lit("%0A"))
    when = F.date_format(F.timestamp_seconds(F.coalesce("page_id", F.lit(0)) + FIRST_CAPTURE), "yyyy-MM-dd'T'HH:mm:ss'Z'")
    header = F.concat(
        F.lit("WARC/1.1\r\nWARC-Type: "), F.when(revisit, "revisit").otherwise("response"),
        F.lit("\r\nWARC-Record-ID: "), name("page_id"), F.lit("\r\nWARC-Date: "), when, F.lit("\r\nWARC-Target-URI: "), url,
        F.lit("\r\nWARC-Payload-Digest: sha1:"), F.col("digest"),
        F.when(revisit, F.concat(F.lit(f"\r\nWARC-Profile: {PROFILE}\r\nWARC-Refers-To: "), name("first"))).otherwise(""),
        F.lit("\r\nContent-Type: application/http; msgtype=response\r\nContent-Length: "), F.octet_length(block).cast("string"), F.lit(END),
    )
    writer = rows.select(F.concat(header, block).alias("value")).write
    writer.option("lineSep", END).option("compression", "gzip").option("maxRecordsPerFile", RECORDS_PER_FILE).text(path)


def url_key(url: str) -> str:
    """Sort-friendly form of a URL: host labels reversed, then path and sorted query, lower-case, no fragment."""
    try:
        parts = urlsplit(url.strip())
        host = (parts.hostname or "").removeprefix("www.")
        port = f":{parts.port}" if parts.port and parts.port not in (80, 443) else ""
    except ValueError:
        return url.strip().lower()
    query = "&".join(sorted(parts.query.split("&"))) if parts.query else ""
    return f"{','.join(reversed(host.split('.')))}{port}){(parts.path or '/').lower()}{'?' + query.lower() if query else ''}"


def _capture(head: bytes, block: bytes, file: str, offset: int, length: int) -> dict:
    fields = dict(line.split(": ", 1) if ": " in line else (line.rstrip(":"), "") for line in head.decode("utf-8", "replace").split("\r\n")[1:])
    http, _, payload = block.partition(END.encode())
    said = next((int(x.split(b":")[1]) for x in http.split(b"\r\n") if x.lower().startswith(b"content-length:")), 0)
    number = lambda s: int(x) if (x := s[len("<urn:page:") : -1]) else None
    kind, digest = fields["WARC-Type"], fields["WARC-Payload-Digest"].removeprefix("sha1:")
    intact = kind == "revisit" or (len(payload) == said and base64.b32encode(hashlib.sha1(payload).digest()).decode() == digest)
    return {
        "page_id": number(fields["WARC-Record-ID"]), "url": fields["WARC-Target-URI"], "urlkey": url_key(fields["WARC-Target-URI"]),
        "timestamp": fields["WARC-Date"], "record_type": kind, "refers_to": number(fields["WARC-Refers-To"]) if kind == "revisit" else None,
        "payload_bytes": said, "payload_digest": digest, "file": file, "offset": offset, "length": length, "intact": intact,
        "payload": payload if kind == "response" else None,
    }


def read_archives(spark: SparkSession, path: str, payloads: bool = False) -> DataFrame:
    """One row for each record below ``path``: CAPTURE's columns, and ``payload`` (null for revisits) if asked for.

    ``offset`` and ``length`` are the record's place in its unpacked file; ``intact`` tells whether the payload has the
    recorded length and digest. Files are read as streams, a record at a time; a record of any length is held whole. An empty
    header gives a null page and an empty url, repeated records are separate rows, a path without records gives none.
    """
    ready(spark)
    schema = CAPTURE + (", payload binary" if payloads else "")
    names = [f.split()[0] for f in schema.split(", ")]
    arrow = pa.schema([(n, pa.binary() if n == "payload" else pa.bool_() if n == "intact" else pa.int64() if n in ("page_id", "refers_to", "payload_bytes", "offset", "length") else pa.string()) for n in names])
    end = END.encode()

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        file, buffer, offset, wanted, size = None, bytearray(), 0, -1, 0
        for batch in batches:
            rows, held = [], 0
            for name, chunk in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if name != file:
                    file, buffer, offset, wanted = name, bytearray(), 0, -1
                buffer += chunk
                buffer += end
                while True:
                    if wanted < 0:
                        stop = buffer.find(end)
                        if stop < 0:
                            break
                        size = int(bytes(buffer[:stop]).rpartition(b"Content-Length: ")[2].split(b"\r\n")[0])
                        wanted = stop + len(end) + size
                    if len(buffer) < wanted + len(end):
                        break
                    head = bytes(buffer[: wanted - size - len(end)])
                    row = _capture(head, bytes(buffer[wanted - size : wanted]), name.rpartition("/")[2], offset, wanted)
                    rows.append({n: row[n] for n in names})
                    held += size if payloads else 0
                    offset += wanted + len(end)
                    del buffer[: wanted + len(end)]
                    wanted = -1
                    if held > 1 << 24:
                        yield pa.RecordBatch.from_pylist(rows, arrow)
                        rows, held = [], 0
            if rows:
                yield pa.RecordBatch.from_pylist(rows, arrow)

    lines = spark.read.option("lineSep", END).text(path)
    return lines.select("_metadata.file_path", F.col("value").cast("binary").alias("value")).mapInArrow(parse, schema)


class LoserTree:
    """k-way merge of sorted runs: each inner node keeps the loser of its match, the overall winner is on top."""

    def __init__(self, runs: list[Iterator[tuple]]):
        self.runs, self.k = runs, len(runs)
        self.heads = [next(r, None) for r in runs]
        self.losers = [-1] * max(self.k, 1)
        self.winner = self._build(1) if self.k > 1 else 0

    def _less(self, a: int, b: int) -> bool:
        x, y = self.heads[a], self.heads[b]
        return x is not None and (y is None or (x, a) < (y, b))

    def _build(self, node: int) -> int:
        if node >= self.k:
            return node - self.k
        a, b = self._build(2 * node), self._build(2 * node + 1)
        win, self.losers[node] = (a, b) if self._less(a, b) else (b, a)
        return win

    def __iter__(self) -> Iterator[tuple]:
        while self.k and self.heads[self.winner] is not None:
            yield self.heads[self.winner]
            run = self.winner
            self.heads[run] = next(self.runs[run], None)
            node = (run + self.k) // 2
            while node:
                if self._less(self.losers[node], run):
                    self.losers[node], run = run, self.losers[node]
                node //= 2
            self.winner = run


def capture_runs(captures: DataFrame) -> DataFrame:
    """The rows with ``run`` and ``seq``: pieces of up to RUN_ROWS rows, each sorted by URL key, timestamp and page, nulls last.

    Repeated rows stay, an empty table gives no rows; columns named ``run`` or ``seq`` are replaced, others stay.
    """
    captures = captures.drop("run", "seq")

    def sort(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import uuid

        held: list[pa.RecordBatch] = []

        def run() -> Iterator[pa.RecordBatch]:
            table = pa.Table.from_batches(held).sort_by([(c, "ascending") for c in ("urlkey", "timestamp", "page_id")])
            name = uuid.uuid4().hex
            table = table.append_column("run", pa.array([name] * table.num_rows)).append_column("seq", pa.array(range(table.num_rows), pa.int64()))
            yield from table.to_batches()

        for batch in batches:
            held.append(batch)
            if sum(b.num_rows for b in held) >= RUN_ROWS:
                yield from run()
                held = []
        if held:
            yield from run()

    return captures.mapInArrow(sort, StructType([*captures.schema.fields, StructField("run", StringType()), StructField("seq", LongType())]))


def merge_index(runs: DataFrame) -> DataFrame:
    """All captures in global order of (urlkey, timestamp, page_id), with ``range_no`` and ``place`` in the range.

    Each range of the order gets its piece of every run, still sorted, and merges the pieces with a loser tree. Ranges
    are cut within a URL's history too, so one URL of any share of the captures is dealt over several tasks. There are
    more of them as the captures grow, so that a range stays at about RANGE_ROWS. Captures without a URL key, time or
    page come last among their like; repeated captures stay; an empty table gives no rows; ``place`` and ``range_no`` of the
    input are replaced.
    """
    runs = runs.drop("place", "range_no")
    parts = max(int(runs.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-runs.count() // RANGE_ROWS))
    order = ["urlkey", "timestamp", "page_id"]
    dealt = runs.repartitionByRange(parts, *(F.asc_nulls_last(c) for c in order), "run").sortWithinPartitions("run", "seq").withColumn("range_no", F.spark_partition_id())
    columns = [c for c in dealt.columns if c not in ("run", "seq")]
    schema = StructType([*(dealt.schema[c] for c in columns), StructField("place", LongType())])

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = [b for b in batches if b.num_rows]
        if not pieces:
            return
        table = pa.Table.from_batches(pieces)
        run, keys = table.column("run").to_pylist(), [table.column(c).to_pylist() for c in order]
        cuts = [0, *(i for i in range(1, len(run)) if run[i] != run[i - 1]), len(run)]

        def stream(lo: int, hi: int) -> Iterator[tuple]:
            for i in range(lo, hi):
                key, when, page = (k[i] for k in keys)
                yield key is None, key or "", when is None, when or "", page is None, page or 0, i

        taken = pa.array([row[-1] for row in LoserTree([stream(a, b) for a, b in zip(cuts, cuts[1:])])], pa.int64())
        merged = table.select(columns).take(taken)
        yield from merged.append_column("place", pa.array(range(merged.num_rows), pa.int64())).to_batches(max_chunksize=4096)

    return dealt.mapInArrow(merge, schema)


def archive_pages(pages: DataFrame, revisit_from: int = 0) -> DataFrame:
    """Write archives of ``pages`` in the shared folder, read them back and return the merged index (CAPTURE's columns).

    A null html is an empty payload, a null url an empty one, rows without a page_id are responses, repeated rows separate
    captures. An empty table gives no rows; extra columns are not read.
    """
    spark = ready(pages.sparkSession)
    path = shared_path(spark, "archives")
    write_archives(pages, path, revisit_from)
    return merge_index(staged(capture_runs(read_archives(spark, path)), "captures"))
