"""Operator 7: WARC archives, and a normaliser for monolithic gzip.

Tasks write their pages as WARC/1.1 records in one gzip stream for each file, the form in which a reader
cannot seek. The normaliser inflates such a stream once, piece by piece, rewrites every record as a
gzip member of its own, and writes a sidecar index with each member's offset and length. Readers
then seek by the index.

Of records with equal payloads the one with the smallest page_id is the response; the others are
revisits that refer to it and carry no payload. Payloads below ``min_bytes`` are responses always.
"""

from __future__ import annotations

import base64
import hashlib
import io
import json
import zlib
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from litsieve.llm.common import BROADCAST_BYTES, batches, tidy, tune
from litsieve.llm.files import atomic_write, open_random
from litsieve.storage import fresh_dir

MIN_BYTES, LEVEL, CHUNK = 0, 4, 256 << 10
#: Fixed values of the format (ISO 28500, WARC/1.1).
VERSION = b"WARC/1.1"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
DATE = "1970-01-01T00:00:00Z"
RESULT = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long"


def digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record_uri(page_id: int | None) -> str:
    return f"<urn:page:{'' if page_id is None else page_id}>"


def record(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None) -> bytes:
    """One record; header values keep to one line."""
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    block = http if refers_to is not None else http + payload
    head = [
        ("WARC-Type", "response" if refers_to is None else "revisit"),
        ("WARC-Record-ID", record_uri(page_id)),
        ("WARC-Date", DATE),
        ("WARC-Target-URI", " ".join((url or "").split())),
        ("WARC-Payload-Digest", f"sha1:{digest(payload)}"),
        ("Content-Type", "application/http; msgtype=response"),
    ]
    if refers_to is not None:
        head += [("WARC-Profile", PROFILE), ("WARC-Refers-To", record_uri(refers_to))]
    head.append(("Content-Length", str(len(block))))
    lines = "".join(f"{k}: {v}\r\n" for k, v in head).encode("utf-8", "replace")
    return VERSION + b"\r\n" + lines + b"\r\n" + block + b"\r\n\r\n"


def inflated(stream, chunk: int = CHUNK) -> Iterator[bytes]:
    """The bytes of a gzip stream of any number of members, never more than a few chunks at a time."""
    z = zlib.decompressobj(31)
    while raw := stream.read(chunk):
        while raw:
            got = z.decompress(raw, chunk)
            if got:
                yield got
            if z.eof:
                raw = z.unused_data
                z = zlib.decompressobj(31)
            else:
                raw = z.unconsumed_tail
                if not raw:
                    break


def records(pieces: Iterable[bytes]) -> Iterator[tuple[dict[str, str], bytes]]:
    """``(headers, whole record)`` of an inflated stream; one record is held at a time."""
    held, source = bytearray(), iter(pieces)

    def more() -> bool:
        piece = next(source, None)
        if piece is None:
            return False
        held.extend(piece)
        return True

    while True:
        while (end := held.find(b"\r\n\r\n")) < 0:
            if not more():
                if held.strip():
                    raise ValueError("a record is cut off")
                return
        head = parse_head(bytes(held[:end]))
        size = end + 4 + int(head["content-length"]) + 4
        while len(held) < size:
            if not more():
                raise ValueError("a record is cut off")
        yield head, bytes(held[:size])
        del held[:size]


def parse_head(raw: bytes) -> dict[str, str]:
    lines = raw.decode("utf-8").split("\r\n")
    if not lines[0].startswith("WARC/"):
        raise ValueError("no record starts here")
    return {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines[1:])}


def normalise(stream, out, index) -> int:
    """Rewrite a monolithic stream with a member for each record; index lines are JSON. Returns the records."""
    at = n = 0
    for head, raw in records(inflated(stream)):
        z = zlib.compressobj(LEVEL, wbits=31)
        member = z.compress(raw) + z.flush()
        out.write(member)
        index.write((json.dumps({"offset": at, "length": len(member), "type": head["warc-type"], "id": head["warc-record-id"], "digest": head["warc-payload-digest"]}) + "\n").encode())
        at += len(member)
        n += 1
    return n


def _page(uri: str) -> int | None:
    own = uri.removeprefix("<urn:page:").removesuffix(">")
    return int(own) if own else None


def parse(raw: bytes) -> tuple[int | None, int, str, str, int | None]:
    """A result row of one record; a response's payload is measured and hashed again."""
    end = raw.index(b"\r\n\r\n")
    head = parse_head(raw[:end])
    block = raw[end + 4 : end + 4 + int(head["content-length"])]
    http, _, payload = block.partition(b"\r\n\r\n")
    said = head["warc-payload-digest"].removeprefix("sha1:")
    if head["warc-type"] == "revisit":
        size = next(int(v) for k, _, v in (x.partition(b":") for x in http.split(b"\r\n")) if k.lower() == b"content-length")
        return _page(head["warc-record-id"]), size, said, "revisit", _page(head["warc-refers-to"])
    if digest(payload) != said:
        raise ValueError("a payload does not fit its digest")
    return _page(head["warc-record-id"]), len(payload), said, "response", None


def first_of_equals(pages: DataFrame, min_bytes: int = MIN_BYTES) -> DataFrame:
    """``d, n, first``: for payloads that several pages share, the smallest page_id."""
    own = pages.select("page_id", F.sha2("payload", 256).alias("d"), F.octet_length("payload").alias("n")).where((F.col("n") >= min_bytes) & F.col("page_id").isNotNull())
    return own.groupBy("d", "n").agg(F.min("page_id").alias("first"), F.count("*").alias("c")).where("c > 1").drop("c")


def write(pages: DataFrame, uri: str, min_bytes: int = MIN_BYTES) -> list[str]:
    """Write the pages as monolithic archives below ``uri``; returns the files.

    A null html is an empty payload. A page with a null id is a response and nothing refers to it; rows
    that repeat a page_id with an equal payload are each a response if that id is the smallest. Columns other
    than page_id, url and html are not read; a missing url is an empty one.
    """
    spark = pages.sparkSession
    tune(spark)
    url = F.col("url").cast("string") if "url" in pages.columns else F.lit(None).cast("string")
    own = pages.select(F.col("page_id").cast("long"), url.alias("url"), F.coalesce(F.encode(F.col("html").cast("string"), "UTF-8"), F.lit(b"")).alias("payload"))
    equal = first_of_equals(own, min_bytes)
    n_equal = equal.count()
    side = F.broadcast(equal) if n_equal * 120 <= BROADCAST_BYTES else equal
    rows = (
        own.join(side, (F.sha2("payload", 256) == F.col("d")) & (F.octet_length("payload") == F.col("n")), "left")
        .select("page_id", "url", "payload", F.when(F.col("page_id") > F.col("first"), F.col("first")).alias("refers_to"))
        if n_equal
        else own.withColumn("refers_to", F.lit(None).cast("long"))
    )

    def store(parts: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import uuid

        held = (b for b in parts if b.num_rows)
        first = next(held, None)
        if first is None:
            return
        name = f"{uri}/{uuid.uuid4().hex}.warc.gz"
        z = zlib.compressobj(1, wbits=31)
        with atomic_write(name) as f:
            b = first
            while b is not None:
                for at in range(0, b.num_rows, 64):
                    for row in zip(*(c.slice(at, 64).to_pylist() for c in b.columns), strict=True):
                        f.write(z.compress(record(*row)))
                b = next(held, None)
            f.write(z.flush())
        yield pa.RecordBatch.from_pydict({"uri": [name]})

    return sorted(r[0] for r in rows.mapInArrow(tidy(store), "uri string").collect())


def normalise_all(spark: SparkSession, files: list[str], uri: str) -> list[tuple[int, str, str]]:
    """Normalise each monolithic file in a task of its own; returns ``(number, archive, index)``."""
    if not files:
        return []

    def run(parts: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in parts:
            for k, name in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                out = f"{uri}/part-{k:06d}"
                with open_random(name) as source, atomic_write(f"{out}.warc.gz") as f, atomic_write(f"{out}.cdxj") as index:
                    normalise(source, f, index)
                yield pa.RecordBatch.from_pydict({"k": pa.array([k], pa.int32()), "archive": [f"{out}.warc.gz"], "index": [f"{out}.cdxj"]})

    jobs = spark.createDataFrame(list(enumerate(files)), "k int, uri string").repartitionById(len(files), F.col("k"))
    return sorted(tuple(r) for r in jobs.mapInArrow(tidy(run), "k int, archive string, index string").collect())


def read(spark: SparkSession, archives: list[tuple[int, str, str]]) -> DataFrame:
    """Every record of normalised archives, found by offset; see ``RESULT``.

    A record without a page id comes back under null, a repeated one as often as it was written; no archives, or archives
    without records, give no rows.
    """
    if not archives:
        return spark.createDataFrame([], RESULT)
    schema = pa.schema([("page_id", pa.int64()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64())])

    def run(parts: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows():
            for b in parts:
                for name, index in zip(b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True):
                    with open_random(index) as lines, open_random(name) as archive:
                        for line in io.BufferedReader(lines):
                            at = json.loads(line)
                            archive.seek(at["offset"])
                            yield parse(zlib.decompress(archive.read(at["length"]), 31))

        yield from batches(rows(), schema)

    jobs = spark.createDataFrame(archives, "k int, archive string, index string").repartitionById(len(archives), F.col("k"))
    return jobs.mapInArrow(tidy(run), RESULT)


def op7_warc_normaliser(spark: SparkSession, sf_dir: str) -> DataFrame:
    uri = fresh_dir(spark, "warc")
    files = write(spark.read.parquet(f"{sf_dir}/pages.parquet"), f"{uri}/monolithic")
    return read(spark, normalise_all(spark, files, f"{uri}/normalised"))
