"""WARC archives with an index written first-class: reads are byte ranges of what the index selects.

Archives hold one gzip member a record (WARC/1.1), a warcinfo record first, so that offset and length
of a record in the index are all it takes to read it. Of the pages whose payloads are equal and at least ``REVISIT``
bytes long, that with the smallest id is a response; the others are revisit records that name it.

Writing: payload digests are grouped as narrow rows, what they decide is joined to the pages by
id, and each task writes an archive of its own name. The index, staged when all tasks are done, is
what counts: an archive that a lost task left behind is named nowhere. Reading: the selected index
rows are sorted by archive and offset, neighbours at most ``GAP`` bytes apart are read as one range
of at most ``RANGE`` bytes, and records are cut from it.

Nulls: a null html is an empty payload, a null url an empty one; rows with a null page_id are
written as responses without a page id and never referred to. Rows that share a page_id with the
page a payload first occurs on are responses themselves. Records with empty payloads are responses.
Other columns are left out. An empty table gives no archives and an empty index.
"""

from __future__ import annotations

import hashlib
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import shared_folder, staged
from .frames import arrow_map
from .store import create, opened

REVISIT = 100
GAP = 64 << 10
RANGE = 8 << 20
#: Bytes of one archive after which a task begins another.
ARCHIVE = 1 << 30

INDEX = "page_id long, url string, record_type string, refers_to long, payload_digest string, payload_bytes long, archive string, offset long, length long"
_HTTP = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"


def decisions(pages: DataFrame) -> DataFrame:
    """(page_id, refers_to): the pages that revisit another; pages is (page_id, url, html)."""
    payload = F.coalesce(F.col("html"), F.lit("")).cast("binary")
    digests = staged(
        pages.filter("page_id is not null")
        .select("page_id", F.sha2(payload, 256).alias("digest"), F.length(payload).alias("n"))
        .filter(F.col("n") >= REVISIT)
        .drop("n"),
        "digests",
    )
    first = digests.groupBy("digest").agg(F.min("page_id").alias("refers_to"), F.max("page_id").alias("last")).filter("refers_to < last")
    out = digests.join(first.drop("last"), "digest").filter("page_id > refers_to")
    # a page_id with several payloads revisits for each of them
    return out.select(F.col("page_id").alias("of_page"), F.col("digest").alias("of_digest"), "refers_to").distinct()


def _record_id(page_id, digest: str) -> str:
    """A page's record id: by its id and payload, so that a revisit names it without a look-up."""
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'{page_id}:{digest}')}>"


def _info(uri: str) -> bytes:
    """The warcinfo record of an archive."""
    block = b"software: siltstone\r\nformat: WARC File Format 1.1\r\n"
    head = [
        "WARC/1.1",
        "WARC-Type: warcinfo",
        f"WARC-Record-ID: <urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, uri)}>",
        "WARC-Date: 1970-01-01T00:00:00Z",
        f"WARC-Filename: {uri.rpartition('/')[2]}",
        "Content-Type: application/warc-fields",
        f"Content-Length: {len(block)}",
    ]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def _member(record: bytes) -> bytes:
    press = zlib.compressobj(1, zlib.DEFLATED, 31)
    return press.compress(record) + press.flush()


def _record(page_id, url: str, kind: str, refers_to, payload: bytes, digest: str) -> bytes:
    block = _HTTP + payload if kind == "response" else b""
    url = " ".join((url or "").split())
    head = [
        "WARC/1.1",
        f"WARC-Type: {kind}",
        f"WARC-Record-ID: {_record_id(page_id, digest)}",
        "WARC-Date: 1970-01-01T00:00:00Z",
        f"WARC-Target-URI: {url}",
        f"WARC-Payload-Digest: sha256:{digest}",
        f"WARC-Payload-Length: {len(payload)}",
        f"Content-Type: {'application/http;msgtype=response' if kind == 'response' else 'application/http'}",
    ]
    if page_id is not None:
        head.append(f"WARC-Page-ID: {page_id}")
    if kind == "revisit":
        head.append("WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")
        head.append(f"WARC-Refers-To: {_record_id(refers_to, digest)}")
        head.append(f"WARC-Refers-To-Page-ID: {refers_to}")
    head.append(f"Content-Length: {len(block)}")
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def _write(batches: Iterator[pa.RecordBatch], folder: str) -> Iterator[pa.RecordBatch]:
    out, uri, at, part = None, "", 0, TaskContext.get().partitionId()
    for batch in batches:
        rows = []
        for page_id, url, html, digest, refers_to in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if out is None or at >= ARCHIVE:
                if out is not None:
                    out.close()
                uri = f"{folder}/pages-{part:06d}-{uuid.uuid4().hex}.warc.gz"
                out = create(uri)
                raw = _member(_info(uri))
                out.write(raw)
                at = len(raw)
            payload = (html or "").encode()
            kind = "response" if refers_to is None else "revisit"
            raw = _member(_record(page_id, url, kind, refers_to, payload, digest))
            out.write(raw)
            rows.append((page_id, url, kind, refers_to, digest, len(payload), uri, at, len(raw)))
            at += len(raw)
        if rows:
            names = [x.split()[0] for x in INDEX.split(", ")]
            kinds = [pa.string() if x.endswith("string") else pa.int64() for x in INDEX.split(", ")]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names)
    if out is not None:
        out.close()


def write_archives(df: DataFrame, folder: str | None = None) -> DataFrame:
    """Write a record for each row of ``df`` (page_id, url, html) and return the index, staged."""
    folder = folder or shared_folder(df.sparkSession) + "/warc"
    pages = df.select(F.col("page_id").cast("long"), F.col("url").cast("string"), F.col("html").cast("string"))
    digest = F.sha2(F.coalesce(F.col("html"), F.lit("")).cast("binary"), 256).alias("digest")
    joined = pages.select("*", digest).join(
        decisions(pages), (F.col("page_id") == F.col("of_page")) & (F.col("digest") == F.col("of_digest")), "left"
    )
    return staged(arrow_map(joined.select("page_id", "url", "html", "digest", "refers_to"), _write, INDEX, folder), "index")


def _ranges(offsets: np.ndarray, lengths: np.ndarray) -> Iterator[tuple[int, int]]:
    """Runs [i, j) of sorted records to be read at once."""
    i = 0
    for j in range(1, len(offsets) + 1):
        if j == len(offsets) or offsets[j] - (offsets[j - 1] + lengths[j - 1]) > GAP or offsets[j] + lengths[j] - offsets[i] > RANGE:
            yield i, j
            i = j


def parse(raw: bytes) -> tuple[dict[str, str], bytes]:
    """Header fields (lower-case names) and the block of one uncompressed record."""
    head, _, rest = raw.partition(b"\r\n\r\n")
    lines = head.decode("utf-8").split("\r\n")
    if not lines[0].startswith("WARC/"):
        raise ValueError("not a WARC record")
    fields = {k.lower(): v.strip() for k, _, v in (x.partition(":") for x in lines[1:])}
    return fields, rest[: int(fields["content-length"])]


def _batch(rows: list[tuple], payloads: bool) -> pa.RecordBatch:
    kinds = [pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.binary()]
    names = ["page_id", "url", "record_type", "refers_to", "payload_digest", "payload_bytes", "payload"]
    made = [pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)]
    return pa.RecordBatch.from_arrays(made if payloads else made[:-1], names if payloads else names[:-1])


def _read(batches: Iterator[pa.RecordBatch], payloads: bool) -> Iterator[pa.RecordBatch]:
    uri, file, rows, held = None, None, [], 0
    for batch in batches:
        archives, offsets, lengths = (batch.column(c).to_pylist() for c in ("archive", "offset", "length"))
        bounds = [0, *[i for i in range(1, len(archives)) if archives[i] != archives[i - 1]], len(archives)]
        for a, b in zip(bounds, bounds[1:], strict=False):
            if a == b:
                continue
            if archives[a] != uri:
                uri, file = archives[a], opened(archives[a])
            for i, j in _ranges(np.array(offsets[a:b]), np.array(lengths[a:b])):
                first = offsets[a + i]
                span = file.read_at(offsets[a + j - 1] + lengths[a + j - 1] - first, first)
                for k in range(a + i, a + j):
                    fields, block = parse(zlib.decompress(span[offsets[k] - first : offsets[k] - first + lengths[k]], 31))
                    kind, digest, n = fields["warc-type"], fields["warc-payload-digest"].removeprefix("sha256:"), int(fields["warc-payload-length"])
                    payload = block.partition(b"\r\n\r\n")[2] if kind == "response" else None
                    if payload is not None and (len(payload) != n or hashlib.sha256(payload).hexdigest() != digest):
                        raise ValueError(f"{uri} at {offsets[k]}: payload and digest differ")
                    page, refers = fields.get("warc-page-id"), fields.get("warc-refers-to-page-id")
                    rows.append((page and int(page), fields["warc-target-uri"], kind, refers and int(refers), digest, n, payload if payloads else None))
                    held += len(payload or b"") if payloads else 0
                    if held >= RANGE:  # payloads don't wait for the batch to end
                        yield _batch(rows, payloads)
                        rows, held = [], 0
        if rows:
            yield _batch(rows, payloads)
            rows, held = [], 0


def read_records(index: DataFrame, payloads: bool = True) -> DataFrame:
    """The records that ``index`` (all of it or a selection) names, read from the archives.

    A revisit's payload is null; its digest and length are those of the payload it stands for.
    """
    near = index.select("archive", "offset", "length")
    # what a task has to do is in the archives, not in the rows: so many tasks as their bytes ask for
    tasks = max(near.sparkSession.sparkContext.defaultParallelism, int((near.agg(F.sum("length")).first()[0] or 0) // (4 * RANGE)))
    near = near.repartition(tasks, "archive", F.floor(F.col("offset") / (4 * RANGE))).sortWithinPartitions("archive", "offset")
    schema = "page_id long, url string, record_type string, refers_to long, payload_digest string, payload_bytes long"
    return arrow_map(near, _read, schema + ", payload binary" * payloads, payloads)


def digest(df: DataFrame) -> DataFrame:
    """(page_id, payload_bytes, payload_digest, record_type, refers_to) as the archives give them."""
    return read_records(write_archives(df), payloads=False).drop("url")


ORACLE_SQL = """
WITH p AS (
  SELECT page_id, octet_length(encode(coalesce(html, '')))::BIGINT AS payload_bytes, sha256(coalesce(html, '')) AS payload_digest
  FROM pages
), q AS (
  SELECT *, CASE WHEN payload_bytes >= 100 THEN min(page_id) OVER (PARTITION BY payload_digest) END AS first FROM p
)
SELECT page_id, payload_bytes, payload_digest,
       CASE WHEN first < page_id THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN first < page_id THEN first END AS refers_to
FROM q
"""
