"""WARC archives of pages, and a two-level capture index over them.

Pages with equal payloads are found by their SHA-1 in one aggregation over small columns; the page with
the smallest id is a response and the others revisit it. Only digests of repeated payloads go back to
the pages: broadcast after their rows are counted, joined by a shuffle beyond that. Each task writes
archives of gzip records, one member a record, rolled over at ROLL bytes, named by its partition and by the attempt: an attempt
that runs beside or after another one never touches the archives whose offsets that one reported.

The index sorts captures by reversed-host URL key into files of compressed blocks. The first level is one
row for each file with its first and last key, the second a sparse directory at each file's end with
the first key of each block. A lookup picks the files by binary search in the broadcast first level (a row for each partition of
the index, whatever the number of captures), the blocks by binary search in the directory, and then reads the record's byte range.

A null html counts as empty, a null url has the empty key; rows that repeat the smallest id are all
responses; a payload whose pages have no id is a response each time; an empty table gives no files and
no rows; further columns are ignored. Page ids are whole numbers; an id that is none raises. Ties in a url's key go by page id; very long pages are one record.
"""

from __future__ import annotations

import base64
import bisect
import gzip
import hashlib
import io
import json
import struct
import uuid
import zlib
from collections.abc import Iterator
from operator import itemgetter
from urllib.parse import urlsplit

import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import files
from .common import fits, shared_dir, stored

ROLL, LEVEL, BLOCK_LINES = 64 << 20, 4, 256
_TAIL = "<QQ8s"
_MAGIC = b"CAPIDX01"
_CAPTURE = "url_key string, page_id long, url string, record_type string, digest string, archive string, offset long, length long"


def url_key(url: str | None) -> str:
    """The host's labels reversed, then path and query: com,example,blog)/a?b; no scheme, user, fragment or leading www."""
    if not url:
        return ""
    try:
        parts = urlsplit(url.strip() if "://" in url else f"//{url.strip()}")
        host, port = parts.hostname or "", parts.port
    except ValueError:
        return url.lower()
    labels = host.removeprefix("www.").split(".")
    named = f":{port}" if port and port not in (80, 443) else ""
    return ",".join(reversed(labels)) + named + ")" + (parts.path or "/").lower() + (f"?{parts.query.lower()}" if parts.query else "")


def digest_of(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record(page_id: int | None, url: str, payload: bytes, digest: str, refers_to: int | None) -> bytes:
    """One WARC/1.1 record: a response with its payload, or a revisit of the response of page refers_to."""
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    revisit = refers_to is not None
    block = http if revisit else http + payload
    lines = ["WARC/1.1", f"WARC-Type: {'revisit' if revisit else 'response'}", f"WARC-Record-ID: <urn:uuid:{uuid.uuid5(uuid.NAMESPACE_OID, f'{page_id} {url}')}>", "WARC-Date: 1970-01-01T00:00:00Z"]
    lines += ["WARC-Target-URI: " + url.replace("\r", "%0D").replace("\n", "%0A"), f"WARC-Payload-Digest: sha1:{digest}", "Content-Type: application/http; msgtype=response"]
    lines += [f"Page-Id: {'' if page_id is None else page_id}", f"Payload-Length: {len(payload)}"]
    if revisit:
        lines += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"Refers-To-Page: {refers_to}"]
    head = "\r\n".join([*lines, f"Content-Length: {len(block)}"]).encode("utf-8", "surrogatepass")
    return head + b"\r\n\r\n" + block + b"\r\n\r\n"


def parse(data: bytes) -> tuple[dict[str, str], bytes]:
    """A record's headers by lower-case name, and its payload (empty for a revisit)."""
    head, _, rest = data.partition(b"\r\n\r\n")
    first, *lines = head.decode("utf-8", "surrogatepass").split("\r\n")
    if not first.startswith("WARC/"):
        raise ValueError("not a WARC record")
    headers = {k.lower(): v.strip() for k, _, v in (x.partition(":") for x in lines)}
    size = int(headers["content-length"])
    if len(rest) != size + 4 or rest[size:] != b"\r\n\r\n":
        raise ValueError("a WARC record of the wrong length")
    return headers, rest[:size].partition(b"\r\n\r\n")[2]


def _packed(data: bytes) -> bytes:
    made = zlib.compressobj(LEVEL, zlib.DEFLATED, 31)
    return made.compress(data) + made.flush()


def write(pages: DataFrame, folder: str | None = None, least: int = 0) -> DataFrame:
    """Writes archives of pages (page_id, url, html); returns a row for each capture. Payloads under least bytes are never revisits."""
    folder = folder or shared_dir(pages.sparkSession, "warc")
    # Ids go to Python as text: whole numbers beside nulls would become floats.
    own = pages.select(F.col("page_id").cast("long").alias("page_id"), F.coalesce("url", F.lit("")).alias("url"), F.encode(F.coalesce("html", F.lit("")), "utf-8").alias("payload"))
    own = own.withColumn("sha", F.sha1("payload"))
    small = own.select("page_id", "sha", F.octet_length("payload").alias("size")).where(F.col("size") >= least)
    repeated = small.groupBy("sha").agg(F.min("page_id").alias("first"), F.count("*").alias("n")).where("n > 1").select("sha", "first")
    rows = own.join(fits(stored(repeated, "repeated"), 300_000), "sha", "left").select(F.col("page_id").cast("string"), "url", "payload", F.when(F.col("page_id") == F.col("first"), None).otherwise(F.col("first")).cast("string").alias("refers_to"))

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        k, n, parts, size, made = f"{TaskContext.get().partitionId():06d}-{uuid.uuid4().hex[:12]}", 0, [], 0, []

        def roll() -> pd.DataFrame:
            nonlocal n, parts, size, made
            uri = f"{folder}/pages-{k}-{n:04d}.warc.gz"
            files.put(uri, parts)
            frame = pd.DataFrame(made, columns=["url_key", "page_id", "url", "record_type", "digest", "offset", "length"], dtype=object)
            n, parts, size, made = n + 1, [], 0, []
            return frame.assign(archive=uri)[[c.split()[0] for c in _CAPTURE.split(", ")]]

        for frame in frames:
            for page_id, url, payload, refers_to in frame.itertuples(index=False, name=None):
                page, back = (None if x is None else int(x) for x in (page_id, refers_to))
                payload = bytes(payload)
                digest = digest_of(payload)
                data = _packed(record(page, url, payload, digest, back))
                made.append((url_key(url), page, url, "response" if back is None else "revisit", digest, size, len(data)))
                parts.append(data)
                size += len(data)
                if size >= ROLL:
                    yield roll()
        if parts:
            yield roll()

    return stored(rows.mapInPandas(run, _CAPTURE), "captures")


def build_index(captures: DataFrame, folder: str | None = None) -> DataFrame:
    """Writes the sorted blocks; returns the first level: uri, first_key, last_key, n_captures, n_blocks of each file."""
    spark = captures.sparkSession
    folder = folder or shared_dir(spark, "capture-index")
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    # Copies of one key are dealt by page_id too, so a hot key's captures do not meet in one task.
    dealt = captures.repartitionByRange(n, "url_key", "page_id").sortWithinPartitions("url_key", "page_id", "archive", "offset")

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        parts, at, lines, directory, count, last = [], 0, [], [], 0, ""

        def flush() -> None:
            nonlocal at, lines
            packed = zlib.compress("\n".join(json.dumps(x) for x in lines).encode(), LEVEL)
            directory.append((lines[0][0], at, len(packed)))
            parts.append(packed)
            at += len(packed)
            lines = []

        for frame in frames:
            for row in frame.itertuples(index=False, name=None):
                lines.append([int(x) if i in (1, 6, 7) and x is not None else x for i, x in enumerate(row)])
                last, count = row[0], count + 1
                if len(lines) == BLOCK_LINES:
                    flush()
        if lines:
            flush()
        if count:
            packed = zlib.compress(json.dumps(directory).encode(), LEVEL)
            uri = f"{folder}/index-{TaskContext.get().partitionId():06d}.cdx"
            files.put(uri, [*parts, packed, struct.pack(_TAIL, at, len(packed), _MAGIC)])
            yield pd.DataFrame({"uri": [uri], "first_key": [directory[0][0]], "last_key": [last], "n_captures": [count], "n_blocks": [len(directory)]})

    dealt = dealt.withColumn("page_id", F.col("page_id").cast("string"))
    return stored(dealt.mapInPandas(run, "uri string, first_key string, last_key string, n_captures long, n_blocks int"), "index-files")


def _directory(uri: str) -> list[tuple[str, int, int]]:
    at, size, magic = struct.unpack(_TAIL, files.get(uri, -struct.calcsize(_TAIL), struct.calcsize(_TAIL)))
    if magic != _MAGIC:
        raise ValueError("not a capture index")
    return [tuple(x) for x in json.loads(zlib.decompress(files.get(uri, at, size)))]


def _block(uri: str, at: int, size: int) -> list[list]:
    return [json.loads(x) for x in zlib.decompress(files.get(uri, at, size)).split(b"\n")]


def captures_of(uri: str, keys: list[str]) -> Iterator[list]:
    """The captures of sorted keys in one index file: for each a binary search of its directory, then reads of the blocks that can hold it."""
    directory = _directory(uri)
    firsts = [x[0] for x in directory]
    at, block = -1, []
    for key in keys:
        for k in range(max(0, bisect.bisect_left(firsts, key) - 1), bisect.bisect_right(firsts, key)):
            if k != at:
                at, block = k, _block(uri, *directory[k][1:])
            yield from block[bisect.bisect_left(block, key, key=itemgetter(0)) : bisect.bisect_right(block, key, key=itemgetter(0))]


def _names() -> list[str]:
    return [c.split()[0] for c in _CAPTURE.split(", ")]


#: A capture as Python returns it: its id as text.
_LINE = _CAPTURE.replace("page_id long", "page_id string")


def _rows(lines: list[list]) -> pd.DataFrame:
    return pd.DataFrame([[x[0], None if x[1] is None else str(x[1]), *x[2:]] for x in lines], columns=_names(), dtype=object)


def _with_ids(captures: DataFrame) -> DataFrame:
    return captures.withColumn("page_id", F.col("page_id").cast("long"))


def lookup(index: DataFrame, urls: DataFrame) -> DataFrame:
    """The captures of each url key of urls (a column url) once, through both levels of the index. Each index file is searched in a task of its own."""
    files_of = sorted((r["first_key"], r["last_key"], r["uri"]) for r in index.select("first_key", "last_key", "uri").collect())  # one row a partition of the index
    sent = index.sparkSession.sparkContext.broadcast(([x[0] for x in files_of], [x[1] for x in files_of], [x[2] for x in files_of]))

    def keyed(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            yield pd.DataFrame({"wanted": [url_key(u) for u in frame["url"]]})

    def placed(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        firsts, lasts, uris = sent.value
        for frame in frames:
            found = [(uris[i], key) for key in frame["wanted"] for i in range(bisect.bisect_left(lasts, key), bisect.bisect_right(firsts, key))]
            yield pd.DataFrame(found, columns=["uri", "wanted"])

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for uri, own in frame.groupby("uri", sort=False):
                yield _rows(list(captures_of(uri, own["wanted"].tolist())))

    wanted = urls.select("url").distinct().mapInPandas(keyed, "wanted string").distinct().mapInPandas(placed, "uri string, wanted string")
    return _with_ids(wanted.repartition(max(1, len(files_of)), "uri").sortWithinPartitions("uri", "wanted").mapInPandas(run, _LINE))


def listed(index: DataFrame) -> DataFrame:
    """All captures, read from the index's blocks."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for uri in frame["uri"]:
                for _, at, size in _directory(uri):
                    yield _rows(_block(uri, at, size))

    n = max(1, min(index.count(), 100_000))
    return _with_ids(index.select("uri").repartition(n, "uri").mapInPandas(run, _LINE))


def read(captures: DataFrame, payloads: bool = False) -> DataFrame:
    """The records of captures, read by byte range and checked: page_id, url, record_type, refers_to, payload_bytes, payload_digest (and payload, empty for revisits)."""
    schema = "page_id string, url string, record_type string, refers_to string, payload_bytes long, payload_digest string" + ", payload binary" * payloads

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            made = []
            for archive, own in frame.groupby("archive", sort=False):
                for at, size in _ranges(list(zip(own["offset"].astype(int), own["length"].astype(int), strict=True))):
                    data = io.BytesIO(files.get(archive, at, sum(size)))
                    for n in size:
                        headers, payload = parse(gzip.decompress(data.read(n)))
                        said = headers["warc-payload-digest"].removeprefix("sha1:")
                        response = headers["warc-type"] == "response"
                        if response and (digest_of(payload) != said or len(payload) != int(headers["payload-length"])):
                            raise ValueError(f"a damaged record in {archive}")
                        page, back = headers["page-id"], headers.get("refers-to-page")
                        made.append((page or None, headers["warc-target-uri"], headers["warc-type"], back or None, int(headers["payload-length"]), said) + ((payload,) if payloads else ()))
            yield pd.DataFrame(made, columns=[c.split()[0] for c in schema.split(", ")], dtype=object)

    # With a number, or Spark would join these few small rows into one task that reads all payloads.
    n = max(int(captures.sparkSession.conf.get("spark.sql.shuffle.partitions")), captures.sparkSession.sparkContext.defaultParallelism)
    dealt = captures.select("archive", "offset", "length").repartition(n, "archive").sortWithinPartitions("archive", "offset").mapInPandas(run, schema)
    return dealt.withColumns({c: F.col(c).cast("long") for c in ("page_id", "refers_to")})


def _ranges(spans: list[tuple[int, int]], most: int = 8 << 20) -> Iterator[tuple[int, list[int]]]:
    """(place, sizes) of neighbouring records to read at once, of at most about so many bytes."""
    at, sizes = 0, []
    for place, size in spans:
        if sizes and (place != at + sum(sizes) or sum(sizes) >= most):
            yield at, sizes
            sizes = []
        if not sizes:
            at = place
        sizes.append(size)
    if sizes:
        yield at, sizes
