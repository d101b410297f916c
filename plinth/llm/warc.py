"""WARC archives: write, index, and read selected records by byte ranges.

Writing: one record per page, gzip members in archives of about ``ARCHIVE_BYTES``.  Pages with one
payload of at least ``MIN_REVISIT`` bytes share a response record, that of the largest
page_id; the others are revisit records without a payload that name it.  An archive is written
under a name of its attempt and then renamed, so a lost or repeated task leaves whole files.

Index: each written record gives (archive, offset, length, url, digest).  Reading: the wanted
index rows of an archive are sorted by offset, and ranges at most ``JOIN_GAP`` bytes apart are
read together, in one open of the archive.

Files go to the shared folder through pyarrow's file systems, so local, HDFS and object stores
work alike; nothing is left in a task's own folder.

Defined results: a null html is an empty payload; payloads under ``MIN_REVISIT`` bytes are
always responses; rows that repeat the winning page_id with its payload are all responses; rows
whose payload is shared only by null page_ids are responses; a null url is written as an empty
URI; an empty table gives an empty result.
"""

from __future__ import annotations

import gzip
import hashlib
import uuid
import zlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plinth.llm.common import cut, shared_path, table, text_batches

MIN_REVISIT = 1000
JOIN_GAP = 64 << 10
#: Bytes of one joined read at most, unless a single record is larger.
JOIN_MOST = 8 << 20
LEVEL = 1
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
RECORD_ID = "urn:plinth:page:{}"
INDEX = "archive string, offset long, length long, url string, digest string, page_id long"
#: Bytes at which an archive is closed and the next one begins.
ARCHIVE_BYTES = 1 << 30
#: Repeated digests up to which they go to every executor (some 30 MB), so that no html is shuffled.
BROADCAST_ROWS = 500_000


def _filesystem(path: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)


def record(page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None, is_revisit: bool) -> bytes:
    """One WARC/1.1 record, compressed as a gzip member of its own."""
    clean = (url or "").replace("\r", "%0D").replace("\n", "%0A")
    head = [
        "WARC/1.1",
        f"WARC-Type: {'revisit' if is_revisit else 'response'}",
        f"WARC-Record-ID: <{RECORD_ID.format('none' if page_id is None else page_id)}>",
        f"WARC-Target-URI: {clean}",
        "WARC-Date: 1970-01-01T00:00:00Z",
        f"WARC-Payload-Digest: sha1:{digest}",
        f"X-Payload-Bytes: {len(payload)}",
        "Content-Type: text/html; charset=utf-8",
    ]
    body = payload
    if is_revisit:
        head += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: <{RECORD_ID.format(refers_to)}>"]
        body = b""
    head.append(f"Content-Length: {len(body)}")
    return gzip.compress("\r\n".join(head).encode("utf-8", "surrogatepass") + b"\r\n\r\n" + body + b"\r\n\r\n", LEVEL, mtime=0)


def parse(data: bytes) -> tuple[dict[str, str], bytes]:
    """Headers (the version under "") and the block of one record."""
    head, _, rest = data.partition(b"\r\n\r\n")
    lines = head.decode("utf-8", "surrogatepass").split("\r\n")
    headers = {"": lines[0]} | dict(x.split(": ", 1) if ": " in x else (x.rstrip(":"), "") for x in lines[1:])
    size = int(headers["Content-Length"])
    if rest[size:] != b"\r\n\r\n":
        raise ValueError("a record doesn't end where its length says")
    return headers, rest[:size]


def roles(pages: DataFrame) -> DataFrame:
    """``pages(page_id, url, html)`` with digest and refers_to (null: a response)."""
    text = F.coalesce("html", F.lit(""))
    # a small payload gets a key of its own row, so that no join key gathers the empty ones
    key = F.when(F.octet_length("html") >= MIN_REVISIT, F.col("digest")).otherwise(F.concat(F.lit("-"), F.xxhash64("page_id", "url").cast("string")))
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", text.alias("html"))
    rows = rows.withColumn("digest", F.sha1(F.col("html").cast("binary"))).withColumn("key", key)
    first = rows.where(F.octet_length("html") >= MIN_REVISIT).groupBy("key").agg(F.max("page_id").alias("first"), F.count("*").alias("n")).where("n > 1").select("key", "first")
    first = cut(first, "repeated")
    joined = rows.join(F.broadcast(first) if first.count() <= BROADCAST_ROWS else first, "key", "left")
    return joined.select("page_id", "url", "html", "digest", F.when(F.col("first") != F.coalesce("page_id", F.col("first") - 1), F.col("first")).alias("refers_to"))


def _writer(folder: str):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        files, base = _filesystem(folder)
        name, out, at, rows_made = "", None, 0, []

        def closed() -> pd.DataFrame:
            out.close()
            files.move(f"{base}/.{name}", f"{base}/{name}.warc.gz")
            made = pd.DataFrame(rows_made, columns=["offset", "length", "url", "digest", "page_id"])
            made.insert(0, "archive", f"{name}.warc.gz")
            made["page_id"] = pd.array(made["page_id"], dtype="Int64")
            return made

        for rows in batches:
            for page_id, url, html, digest, refers in zip(*(rows[c] for c in ("page_id", "url", "html", "digest", "refers_to")), strict=True):
                if out is not None and at >= ARCHIVE_BYTES:
                    yield closed()
                    out = None
                if out is None:
                    files.create_dir(base, recursive=True)
                    name, at, rows_made = uuid.uuid4().hex, 0, []
                    out = files.open_output_stream(f"{base}/.{name}", compression=None)
                page_id, refers = (None if pd.isna(x) else int(x) for x in (page_id, refers))
                data = record(page_id, url, html.encode("utf-8", "surrogatepass"), digest, refers, refers is not None)
                out.write(data)
                rows_made.append((at, len(data), url, digest, page_id))
                at += len(data)
        if out is not None:
            yield closed()

    return run


def write_archives(rows: DataFrame, folder: str) -> DataFrame:
    """Writes the rows of ``roles`` as archives in ``folder``; the index, which holds the
    archives of the attempts that counted and no others."""
    text_batches(rows.sparkSession)
    return cut(rows.mapInPandas(_writer(folder), INDEX), "index")


def _reader(folder: str):
    def run(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        files, base = _filesystem(folder)
        rows = rows.sort_values(["archive", "offset"])
        out = []
        for archive, part in rows.groupby("archive", sort=False):
            spans, wanted = [], list(zip(part["offset"].astype(int), part["length"].astype(int), strict=True))
            for offset, length in wanted:
                if spans and offset - spans[-1][1] <= JOIN_GAP and offset + length - spans[-1][0] <= JOIN_MOST:
                    spans[-1][1] = max(spans[-1][1], offset + length)
                    spans[-1][2].append((offset, length))
                else:
                    spans.append([offset, offset + length, [(offset, length)]])
            with files.open_input_file(f"{base}/{archive}") as f:
                for start, end, inside in spans:
                    data = f.read_at(end - start, start)
                    for offset, length in inside:
                        headers, body = parse(zlib.decompress(data[offset - start : offset - start + length], 31))
                        kind, refers = headers["WARC-Type"], headers.get("WARC-Refers-To")
                        digest = headers["WARC-Payload-Digest"].removeprefix("sha1:")
                        if kind == "response" and hashlib.sha1(body).hexdigest() != digest:
                            raise ValueError(f"digest of {archive} at {offset} differs")
                        page = headers["WARC-Record-ID"].strip("<>").rpartition(":")[2]
                        out.append((None if page == "none" else int(page), headers["WARC-Target-URI"], int(headers["X-Payload-Bytes"]), digest, kind, int(refers.strip("<>").rpartition(":")[2]) if refers else None, body))
        made = pd.DataFrame(out, columns=["page_id", "url", "payload_bytes", "payload_digest", "record_type", "refers_to", "body"])
        for c in ("page_id", "refers_to"):
            made[c] = pd.array(made[c], dtype="Int64")
        return made

    return run


def read_records(index: DataFrame, folder: str, with_body: bool = True) -> DataFrame:
    """The records that ``index`` rows select.  Rows go to tasks by archive and stretch of it, so
    one archive of any size is read by several tasks, each over a connected part."""
    shape = "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long, body binary"
    run = _reader(folder)
    if not with_body:
        shape = shape.replace(", body binary", "")
        inner, run = run, lambda key, rows: inner(key, rows).drop(columns="body")
    stretch = F.floor(F.col("offset") / JOIN_MOST)
    return index.withColumn("stretch", stretch).groupBy("archive", "stretch").applyInPandas(run, shape)


def archive(pages: DataFrame, folder: str) -> DataFrame:
    """Writes ``pages`` as archives in ``folder``; returns their index."""
    return write_archives(roles(pages), folder)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = shared_path(spark, "warc")
    index = archive(table(spark, sf_dir, "pages").select("page_id", "url", "html"), folder)
    return read_records(index, folder, with_body=False).drop("url")


ORACLE_SQL = f"""
with p as (select page_id, coalesce(html, '') as h, strlen(coalesce(html, '')) as n, sha1(coalesce(html, '')) as d from pages),
f as (select d, max(page_id) as first from p where n >= {MIN_REVISIT} group by d)
select p.page_id, p.n::bigint as payload_bytes, p.d as payload_digest,
       case when p.n >= {MIN_REVISIT} and f.first <> p.page_id then 'revisit' else 'response' end as record_type,
       case when p.n >= {MIN_REVISIT} and f.first <> p.page_id then f.first end as refers_to
from p left join f on p.d = f.d
"""
