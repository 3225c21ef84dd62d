"""WARC archives in Zstandard: a writer with a shared dictionary, and a reader.

An archive starts with a skippable frame (magic 0x184D2A5D) that holds the dictionary, itself a Zstandard frame; then each record is one frame,
compressed with the dictionary. The reader loads the dictionary, walks over the frames by their block headers, decodes one frame
per record, and validates it: version line, required headers, Content-Length against the block, payload digest, closing blank lines. What
fails is kept with its reason in ``error``.

Of records with equal payloads of at least MIN_REVISIT bytes, that with the largest page_id is the response; others become revisit records,
which hold no payload, only headers with its length and digest. Equal payloads are found by SHA-1 and length over the whole table, as an
aggregate and a join, so many copies of one page meet as partial counts, and meet the join's other side by broadcast. Archives are rows of at most ARCHIVE_BYTES and one record, since each task fills its own;
export() writes them as files.

Defined cases: null html is an empty payload; a null url becomes ``about:blank`` and is null again when read; a null page_id is lower than all others, and if no copy has
one, all of them are responses; rows that repeat the largest page_id are all responses; a very long page is one record of one frame; columns beside page_id, url and html are ignored; an
empty table gives no archive and no records.
"""

from __future__ import annotations

import base64
import hashlib
import struct
import uuid

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ploidyne.llm.common import cut, hot_rows, new_path

SKIPPABLE, FRAME = 0x184D2A5D, 0xFD2FB528
MIN_REVISIT = 1000
ARCHIVE_BYTES = 8 << 20
#: Pages that the dictionary is trained on at most, the most bytes taken of each, and its size.
DICTIONARY_PAGES, DICTIONARY_PAGE_BYTES, DICTIONARY_BYTES = 800, 1 << 15, 1 << 16
DATE = "2024-01-01T00:00:00Z"
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
RECORDS = "archive string, position long, page_id long, url string, record_type string, payload_bytes long, payload_digest string, refers_to long, payload binary, error string"


def with_duplicates(pages: DataFrame) -> DataFrame:
    """(page_id, url, html, sha1, n_bytes, keep): keep is the page_id whose record holds the payload, null if it isn't shared."""
    p = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", F.coalesce("html", F.lit("")).alias("html"))
    p = p.withColumn("sha1", F.sha1(F.col("html").cast("binary"))).withColumn("n_bytes", F.octet_length("html").cast("long"))
    shared = p.where(F.col("n_bytes") >= MIN_REVISIT).groupBy("sha1", "n_bytes").agg(F.max("page_id").alias("keep"), F.count(F.lit(1)).alias("copies")).where("copies > 1 and keep is not null")
    shared = cut(shared)
    hot = hot_rows(pages.count())
    few = F.broadcast(shared.where(F.col("copies") > hot).drop("copies"))
    rest = p.join(few, ["sha1", "n_bytes"], "left_anti").join(shared.where(F.col("copies") <= hot).drop("copies"), ["sha1", "n_bytes"], "left")
    return rest.unionByName(p.join(few, ["sha1", "n_bytes"]))


def record_id(page_id) -> str:
    return f"<urn:uuid:{uuid.UUID(bytes=hashlib.md5(f'page:{page_id}'.encode()).digest())}>"


def build_record(page_id, url, payload: bytes, keep) -> bytes:
    digest = base64.b32encode(hashlib.sha1(payload).digest()).decode()
    revisit = keep is not None and page_id != keep
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if revisit else http + payload
    # control characters can't stand in a header
    target = "about:blank" if url is None else "".join(f"%{ord(c):02X}" if c < " " else c for c in url)
    head = ["WARC/1.1", f"WARC-Type: {'revisit' if revisit else 'response'}", f"WARC-Record-ID: {record_id(page_id)}", f"WARC-Date: {DATE}", f"WARC-Target-URI: {target}", f"WARC-Payload-Digest: sha1:{digest}", "Content-Type: application/http;msgtype=response", f"Content-Length: {len(block)}"]
    if page_id is not None:
        head.append(f"X-Page-ID: {page_id}")
    if revisit:
        head += [f"WARC-Profile: {REVISIT_PROFILE}", f"WARC-Refers-To: {record_id(keep)}", f"X-Refers-To-Page: {keep}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def train_dictionary(pages: DataFrame, rows: int = DICTIONARY_PAGES) -> bytes:
    """A dictionary from the pages with the least hashes of page_id and html; raw content if there are too few to train on; may be empty.

    Tasks send hashes alone; then the html of those chosen is fetched, one of equal pages.
    """
    some = pages.where("html is not null and html != ''").select(F.xxhash64("page_id", "html").alias("h"), F.substring("html", 1, DICTIONARY_PAGE_BYTES).alias("html"))
    chosen = pages.sparkSession.createDataFrame([(r.h,) for r in some.select("h").orderBy("h").limit(rows).collect()], "h long").distinct()
    got = some.join(F.broadcast(chosen), "h").groupBy("h").agg(F.min("html").alias("html")).collect()
    sample = [r.html.encode()[:DICTIONARY_PAGE_BYTES] for r in sorted(got)]
    if not sample:
        return b""
    try:
        return zstandard.train_dictionary(DICTIONARY_BYTES, sample).as_bytes()
    except zstandard.ZstdError:
        return b"".join(sample)[:DICTIONARY_BYTES]


def leading_frame(dictionary: bytes) -> bytes:
    body = zstandard.ZstdCompressor().compress(dictionary)
    return struct.pack("<II", SKIPPABLE, len(body)) + body


def frame_end(data: memoryview, at: int) -> int:
    """Where the frame at ``at`` ends, by its header and block headers."""
    if len(data) - at < 5 or struct.unpack_from("<I", data, at)[0] != FRAME:
        raise ValueError(f"no Zstandard frame at byte {at}")
    flags = data[at + 4]
    at += zstandard.frame_header_size(bytes(data[at : at + 18]))
    last = False
    while not last:
        if at + 3 > len(data):
            raise ValueError("a frame is cut off")
        block = data[at] | data[at + 1] << 8 | data[at + 2] << 16
        last, kind, size = block & 1, block >> 1 & 3, block >> 3
        at += 3 + (1 if kind == 1 else size)
    at += 4 if flags & 4 else 0
    if at > len(data):
        raise ValueError("a frame is cut off")
    return at


def parse_record(raw: bytes) -> dict:
    """The fields of a record; raises ValueError if it isn't valid."""
    cut_at = raw.find(b"\r\n\r\n")
    if not raw.startswith(b"WARC/1.") or cut_at < 0:
        raise ValueError("no WARC header")
    head = dict(line.split(": ", 1) for line in raw[:cut_at].decode().split("\r\n")[1:])
    for name in ("WARC-Type", "WARC-Record-ID", "WARC-Date", "Content-Length"):
        if name not in head:
            raise ValueError(f"{name} is missing")
    size = int(head["Content-Length"])
    block = raw[cut_at + 4 : cut_at + 4 + size]
    if len(block) != size or raw[cut_at + 4 + size :] != b"\r\n\r\n":
        raise ValueError("Content-Length is not the block's length")
    http, _, payload = block.partition(b"\r\n\r\n")
    fields = dict(line.split(": ", 1) for line in http.decode().split("\r\n")[1:])
    length = int(fields["Content-Length"])
    digest = base64.b32decode(head["WARC-Payload-Digest"].removeprefix("sha1:")).hex()
    revisit = head["WARC-Type"] == "revisit"
    if not revisit and (len(payload) != length or hashlib.sha1(payload).hexdigest() != digest):
        raise ValueError("the payload is not that of the headers")
    url = head.get("WARC-Target-URI")
    page, other = head.get("X-Page-ID"), head.get("X-Refers-To-Page")
    return {"page_id": page and int(page), "url": None if url == "about:blank" else url, "record_type": head["WARC-Type"], "payload_bytes": length, "payload_digest": digest, "refers_to": other and int(other), "payload": None if revisit else payload}


def read_archive(archive: str, data: bytes):
    """The records of an archive, as dicts with the columns of RECORDS."""
    names = [c.strip().split()[0] for c in RECORDS.split(",")]
    view, at, position = memoryview(data), 0, 0
    decoder = zstandard.ZstdDecompressor()
    if len(view) >= 8 and struct.unpack_from("<I", view)[0] == SKIPPABLE:
        at = 8 + struct.unpack_from("<I", view, 4)[0]
        body = bytes(view[8:at])
        body = zstandard.ZstdDecompressor().decompress(body) if body[:4] == struct.pack("<I", FRAME) else body
        if body:
            decoder = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(body))
    while at < len(view):
        row = dict.fromkeys(names) | {"archive": archive, "position": position}
        try:
            end = frame_end(view, at)
        except (ValueError, zstandard.ZstdError) as e:
            yield row | {"error": str(e)}
            return
        try:
            row |= parse_record(decoder.decompressobj().decompress(view[at:end]))
        except (ValueError, KeyError, zstandard.ZstdError) as e:
            row["error"] = f"{type(e).__name__}: {e}"
        yield row
        at, position = end, position + 1


def write_archives(pages: DataFrame, dictionary: bytes | None = None, archive_bytes: int = ARCHIVE_BYTES) -> DataFrame:
    """(archive, data): archives of all pages. ``pages``: page_id, url, html."""
    dictionary = train_dictionary(pages) if dictionary is None else dictionary
    first = leading_frame(dictionary)

    def run(batches):
        packer = zstandard.ZstdCompressor(level=3, dict_data=zstandard.ZstdCompressionDict(dictionary) if dictionary else None)
        parts, size, digest = [first], 0, hashlib.md5()

        def full():
            return pa.record_batch([pa.array([digest.hexdigest()]), pa.array([b"".join(parts)], pa.binary())], names=["archive", "data"])

        for batch in batches:
            for page_id, url, html, keep in zip(*(batch.column(c) for c in ("page_id", "url", "html", "keep")), strict=True):
                record = build_record(page_id.as_py(), url.as_py(), html.as_py().encode(), keep.as_py())
                frame = packer.compress(record)
                digest.update(frame)
                parts.append(frame)
                size += len(frame)
                if size >= archive_bytes:
                    yield full()
                    parts, size, digest = [first], 0, hashlib.md5()
        if size:
            yield full()

    return with_duplicates(pages).select("page_id", "url", "html", "keep").mapInArrow(run, "archive string, data binary")


def read_archives(archives: DataFrame) -> DataFrame:
    """RECORDS of archives given as (archive, data)."""
    names = [c.strip().split()[0] for c in RECORDS.split(",")]
    kinds = dict(zip(names, [pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.binary(), pa.string()], strict=True))

    def pack(rows):
        return pa.record_batch([pa.array([r[n] for r in rows], kinds[n]) for n in names], names=names)

    def run(batches):
        for batch in batches:
            for archive, data in zip(batch.column("archive"), batch.column("data"), strict=True):
                rows, size = [], 0
                for row in read_archive(archive.as_py(), data.as_py()):
                    rows.append(row)
                    size += len(row["payload"] or b"") + 200
                    if size > 4 << 20:
                        yield pack(rows)
                        rows, size = [], 0
                if rows:
                    yield pack(rows)

    return archives.mapInArrow(run, RECORDS)


def read_files(spark, path: str) -> DataFrame:
    """RECORDS of the ``*.warc.zst`` files at ``path``, wherever Spark reads."""
    return read_archives(spark.read.format("binaryFile").load(path).select(F.col("path").alias("archive"), F.col("content").alias("data")))


def export(archives: DataFrame, folder: str) -> list[str]:
    """Write each archive as a file in ``folder`` (one that this process can write to); returns the paths. Rows pass one by one."""
    paths = []
    for row in archives.toLocalIterator():
        paths.append(f"{folder}/{row.archive}.warc.zst")
        with open(paths[-1], "wb") as out:
            out.write(row.data)
    return paths


ORACLE = """
WITH p AS (SELECT page_id, encode(coalesce(html, '')) AS b FROM pages),
q AS (SELECT page_id, octet_length(b)::BIGINT AS payload_bytes, sha1(b) AS payload_digest FROM p),
r AS (SELECT *, CASE WHEN payload_bytes >= 1000 THEN max(page_id) OVER (PARTITION BY payload_digest, payload_bytes) END AS keep FROM q)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN keep IS NULL OR page_id = keep THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id <> keep THEN keep END AS refers_to
FROM r
"""


def op7(spark, sf_dir: str) -> DataFrame:
    archives = write_archives(spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url", "html"))
    path = new_path(spark, "warc")
    archives.write.option("compression", "none").parquet(path)
    records = read_archives(spark.read.schema(archives.schema).parquet(path))
    # a record that fails stops the query: every page has its row or there is no result
    checked = F.when(F.col("error").isNotNull(), F.raise_error(F.concat(F.lit("not a valid record: "), "error")).cast("string")).otherwise(F.col("payload_digest"))
    return records.select("page_id", "payload_bytes", checked.alias("payload_digest"), "record_type", "refers_to")
