"""WARC archives with a Zstandard dictionary: written, and read back.

Each archive file starts with a skippable frame that holds a dictionary trained on records of that archive; every record is a
frame of its own. Tasks write through ``pyarrow.fs`` into a folder that all executors reach (by default in
the shared folder), under a name used once, and return that name; readers open only returned names, so files of lost or repeated
tasks are never read. A task holds one archive's records (``ARCHIVE_BYTES``) at a time.

Of records with equal payloads of at least ``least`` bytes, the one with the largest id is a response and the others
are revisits of it (rows that repeat the largest id are all responses). A null payload is empty. A null id is kept; it is larger
than no other. A null URL gives no target line. An empty table gives no archive.
"""

from __future__ import annotations

import hashlib
import io
import uuid
from collections.abc import Iterator

import pandas as pd
import zstandard
from pyarrow import fs
from pyspark.sql import DataFrame, functions as F

from logweir.llm.common import carried, numbered, stored
from logweir.session import fresh_path

ARCHIVE_BYTES = 32 << 20
DICTIONARY_BYTES = 64 << 10
#: The magic number of the skippable frame and the WARC names are fixed values of the formats.
DICTIONARY_FRAME = 0x184D2A5D
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
HTTP_HEAD = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"
ROW = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, payload binary"
IDS = ("page_id", "refers_to")


def record_roles(pages: DataFrame, least: int = 1000) -> DataFrame:
    """page_id, url, payload, digest and refers_to (null for responses).

    Only ids and digests are gathered to find the largest id of each payload; payloads move once, by their id.
    """
    facts = pages.select("page_id", F.octet_length("payload").alias("n"), F.unhex(F.sha1("payload")).alias("digest"))
    shared = (
        facts.where(F.col("n") >= least)
        .groupBy("digest", "n")
        .agg(F.count(F.lit(1)).alias("copies"), F.max("page_id").alias("first"))
        .where((F.col("copies") > 1) & F.col("first").isNotNull())
    )
    revisits = facts.join(shared, ["digest", "n"]).where(~F.col("page_id").eqNullSafe(F.col("first")))
    by_id = revisits.select("page_id", "digest", F.col("first").alias("refers_to")).distinct()
    whole = pages.withColumn("digest", F.unhex(F.sha1("payload")))
    known = whole.where(F.col("page_id").isNotNull()).join(by_id.where(F.col("page_id").isNotNull()), ["page_id", "digest"], "left")
    without = whole.where(F.col("page_id").isNull()).join(by_id.where(F.col("page_id").isNull()).drop("page_id"), "digest", "left")
    return known.unionByName(without)


def _text(value: str) -> bytes:
    return value.encode("utf-8", "replace").replace(b"\r", b"%0D").replace(b"\n", b"%0A")


def _record_id(page_id: int | None, digest: bytes) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'page:{page_id}:{digest.hex()}')}>"


def _number(value: str | None) -> int | None:
    return None if value is None else int(value)


def warc_record(page_id: int | None, url: str | None, payload: bytes, digest: bytes, refers_to: int | None, date: str) -> bytes:
    block = HTTP_HEAD + payload if refers_to is None else HTTP_HEAD
    head = [b"WARC/1.1", b"WARC-Type: " + (b"response" if refers_to is None else b"revisit")]
    head += [b"WARC-Record-ID: " + _record_id(page_id, digest).encode(), b"WARC-Date: " + date.encode()]
    if url is not None:
        head.append(b"WARC-Target-URI: " + _text(url))
    head.append(b"WARC-Payload-Digest: sha1:" + digest.hex().encode())
    if refers_to is not None:
        head += [b"WARC-Profile: " + REVISIT_PROFILE.encode(), b"WARC-Refers-To: " + _record_id(refers_to, digest).encode()]
        head += [b"WARC-X-Refers-To-Page: %d" % refers_to, b"WARC-X-Payload-Length: %d" % len(payload)]
    if page_id is not None:
        head.append(b"WARC-X-Page: %d" % page_id)
    head += [b"Content-Type: application/http;msgtype=response", b"Content-Length: %d" % len(block)]
    return b"\r\n".join(head) + b"\r\n\r\n" + block + b"\r\n\r\n"


def _dictionary(records: list[bytes]) -> zstandard.ZstdCompressionDict | None:
    """Trained on records spread evenly over the archive, up to a hundred times the dictionary's size."""
    step = max(1, sum(map(len, records)) // (100 * DICTIONARY_BYTES))
    samples = [r[: 1 << 17] for r in records[::step]]
    try:
        return zstandard.train_dictionary(min(DICTIONARY_BYTES, max(256, sum(map(len, samples)) // 8)), samples, k=256, d=8, level=3)
    except zstandard.ZstdError:
        return None


def _write_archive(folder: str, records: list[bytes]) -> str:
    store, root = fs.FileSystem.from_uri(folder)
    store.create_dir(root, recursive=True)
    name = f"{uuid.uuid4().hex}.warc.zst"
    trained = _dictionary(records)
    packer = zstandard.ZstdCompressor(level=3, dict_data=trained, write_checksum=True)
    with store.open_output_stream(f"{root}/{name}", compression=None) as out:
        if trained is not None:
            raw = trained.as_bytes()
            out.write(DICTIONARY_FRAME.to_bytes(4, "little") + len(raw).to_bytes(4, "little") + raw)
        for r in records:
            out.write(packer.compress(r))
    return name


def write_archives(pages: DataFrame, folder: str, date: str = "2024-01-01T00:00:00Z", archive_bytes: int = ARCHIVE_BYTES) -> DataFrame:
    """Archives of rows ``page_id, url, payload, digest, refers_to``; one row (archive, records) per file, stored."""

    def write(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        records, held = [], 0
        for batch in batches:
            for r in batch.itertuples(index=False):
                records.append(warc_record(_number(r.page_id), r.url, bytes(r.payload), bytes(r.digest), _number(r.refers_to), date))
                held += len(records[-1])
                if held >= archive_bytes:
                    yield pd.DataFrame({"archive": [_write_archive(folder, records)], "records": [len(records)]})
                    records, held = [], 0
        if records:
            yield pd.DataFrame({"archive": [_write_archive(folder, records)], "records": [len(records)]})

    wanted = carried(pages.select("page_id", "url", "payload", "digest", "refers_to"), *IDS)
    return stored(wanted.mapInPandas(write, "archive string, records long"), "warc-manifest")


def _frames(data: io.BufferedIOBase) -> Iterator[bytes]:
    """The records of one archive, one after the other; the dictionary comes from the leading skippable frame."""
    head = data.read(8)
    trained = None
    if head[:4] == DICTIONARY_FRAME.to_bytes(4, "little"):
        trained = zstandard.ZstdCompressionDict(data.read(int.from_bytes(head[4:], "little")))
        head = b""
    left = head
    opener = zstandard.ZstdDecompressor(dict_data=trained)
    while left := left or data.read(1 << 20):
        frame = opener.decompressobj()
        parts = []
        while not frame.eof:
            if not left and not (left := data.read(1 << 20)):
                raise ValueError("the archive ends inside a record")
            parts.append(frame.decompress(left))
            left = frame.unused_data if frame.eof else b""
        yield b"".join(parts)


def parse_record(record: bytes) -> tuple:
    """The fields of ``ROW``, ids as strings. Length and digest of a response come from its payload, which must agree with the header."""
    head, _, rest = record.partition(b"\r\n\r\n")
    fields = dict(line.split(b": ", 1) for line in head.split(b"\r\n")[1:])
    block = rest[: int(fields[b"Content-Length"])]
    page = fields[b"WARC-X-Page"].decode() if b"WARC-X-Page" in fields else None
    stated = fields[b"WARC-Payload-Digest"].removeprefix(b"sha1:").decode()
    if fields[b"WARC-Type"] == b"revisit":
        return page, int(fields[b"WARC-X-Payload-Length"]), stated, "revisit", fields[b"WARC-X-Refers-To-Page"].decode(), None
    payload = block[len(HTTP_HEAD) :]
    digest = hashlib.sha1(payload).hexdigest()
    if digest != stated:
        raise ValueError(f"record {page}: the payload does not have the stated digest")
    return page, len(payload), digest, "response", None, payload


def read_archives(manifest: DataFrame, folder: str, payloads: bool = True, files_per_task: int = 1) -> DataFrame:
    """Every record of the archives that ``manifest`` names, as rows of ``ROW``."""

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = [c.split()[0] for c in ROW.split(", ")][: None if payloads else -1]
        store, root = fs.FileSystem.from_uri(folder)
        for batch in batches:
            for archive in batch["archive"]:
                with store.open_input_stream(f"{root}/{archive}", compression=None) as data:
                    rows, held = [], 0
                    for record in _frames(data):
                        row = parse_record(record)
                        rows.append(row if payloads else row[:-1])
                        held += len(record)
                        if held > 4 << 20:
                            yield pd.DataFrame(rows, columns=names)
                            rows, held = [], 0
                    if rows:
                        yield pd.DataFrame(rows, columns=names)

    tasks = max(1, manifest.count() // files_per_task)
    fields = ROW if payloads else ROW.rpartition(",")[0]
    schema = fields.replace("page_id long", "page_id string").replace("refers_to long", "refers_to string")
    return numbered(manifest.select("archive").repartition(tasks, "archive").mapInPandas(read, schema), *IDS)


def archive_pages(pages: DataFrame, page_id: str = "page_id", url: str = "url", html: str = "html", least: int = 1000) -> tuple[DataFrame, str]:
    """Writes archives of all rows; gives their manifest and folder."""
    spark = pages.sparkSession
    rows = pages.select(
        F.col(f"`{page_id}`").cast("long").alias("page_id"),
        F.col(f"`{url}`").alias("url"),
        F.coalesce(F.col(f"`{html}`"), F.lit("")).cast("binary").alias("payload"),
    )
    folder = fresh_path(spark, "llm-warc")
    return write_archives(record_roles(rows, least), folder), folder
