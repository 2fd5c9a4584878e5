"""Token ids of documents in binary files whose document boundaries are Elias-Fano encoded, and their reading.

A file holds the concatenated ids of its documents (two bytes each where the vocabulary allows it, else four), then the ends of the
documents and their doc_ids, both as ``elias_fano`` bits, then a footer. Select on the ends gives any document's place in the
file without a table of 64-bit offsets; how many ids all files before it hold is kept once per file, in the manifest.

Documents are range-sorted by doc_id (null ids first, equal ids by the hash of their texts), and each task writes its range in files of a bounded
number of ids and documents, under names used once. The manifest holds the files of tasks that ended well, in order, so
files of lost or repeated tasks are never read. Readers take one file at a time.

Null and empty texts have just the end id. Rows are kept one by one, repeated ones too; many rows of one doc_id are dealt to several tasks by
the input partition they came from. Texts of any length are encoded whole. An empty table gives no files. Further columns, whatever their
names, are ignored.
"""

from __future__ import annotations

import struct
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window, functions as F

from logweir.llm import elias_fano
from logweir.llm.cell_table import encoder
from logweir.llm.common import stored
from logweir.session import fresh_path

MAGIC = b"EFTOKEN1"
#: Ids and documents of a file, at most; a longer document has a file of its own.
FILE_IDS = 1 << 24
FILE_DOCS = 1 << 20
READ_IDS = 1 << 20
_FOOTER = struct.Struct("<QQqBQQ")  # documents, of these without an id, smallest id, bytes of an id, bytes of the two Elias-Fano parts


class TokenWriter:
    """One file: ids are written as they come, the index when it is closed."""

    def __init__(self, folder: str, dtype: np.dtype):
        store, root = fs.FileSystem.from_uri(folder)
        store.create_dir(root, recursive=True)
        self.name, self.type = f"{uuid.uuid4().hex}.ids", dtype
        self.out = store.open_output_stream(f"{root}/{self.name}", compression=None)
        self.out.write(MAGIC)
        self.ends: list[np.ndarray] = []
        self.doc_ids: list[int | None] = []
        self.ids = 0

    def add(self, doc_ids: list[int | None], ids: np.ndarray, ends: np.ndarray) -> None:
        """Documents whose ids end at ``ends`` in ``ids``; doc_ids ascend over all calls, null first."""
        self.out.write(ids.tobytes())
        self.ends.append(ends + self.ids)
        self.ids += len(ids)
        self.doc_ids += doc_ids

    def close(self) -> None:
        named = [d for d in self.doc_ids if d is not None]
        least = named[0] if named else 0
        names = elias_fano.packed(np.array([d - least for d in named], np.uint64))
        ends = elias_fano.packed(np.concatenate(self.ends).astype(np.uint64))
        footer = _FOOTER.pack(len(self.doc_ids), len(self.doc_ids) - len(named), least, self.type.itemsize, len(ends), len(names))
        self.out.write(ends + names + footer + MAGIC)
        self.out.close()


class TokenFile:
    """A file of ``TokenWriter``, read in place."""

    def __init__(self, folder: str, name: str):
        store, root = fs.FileSystem.from_uri(folder)
        self.data = store.open_input_file(f"{root}/{name}")
        size, tail = self.data.size(), _FOOTER.size + len(MAGIC)
        raw = self._bytes(size - tail, tail)
        if raw[_FOOTER.size :] != MAGIC or self._bytes(0, len(MAGIC)) != MAGIC:
            raise ValueError(f"{name} is not a whole token file")
        self.documents, self.unnamed, self.least, width, ends, names = _FOOTER.unpack_from(raw)
        self.type = np.dtype(f"<u{width}")
        at = size - tail - ends - names
        self.ends = elias_fano.EliasFano(self._bytes(at, ends))
        self.names = elias_fano.EliasFano(self._bytes(at + ends, names))

    def __enter__(self) -> TokenFile:
        return self

    def __exit__(self, *_: object) -> None:
        self.data.close()

    def _bytes(self, at: int, n: int) -> bytes:
        self.data.seek(at)
        return self.data.read(n)

    def span(self, i: int) -> tuple[int, int]:
        """Where document ``i`` starts and ends, in ids of this file."""
        return self.ends.select(i - 1) if i else 0, self.ends.select(i)

    def ids(self, start: int, end: int) -> np.ndarray:
        width = self.type.itemsize
        return np.frombuffer(self._bytes(len(MAGIC) + width * start, width * (end - start)), self.type)

    def document(self, i: int) -> tuple[int | None, np.ndarray]:
        """doc_id and ids of document ``i``."""
        return None if i < self.unnamed else self.least + self.names.select(i - self.unnamed), self.ids(*self.span(i))

    def doc_ids(self, first: int, after: int) -> pa.Array:
        nulls = np.arange(first, after) < self.unnamed
        known = self.names.values(max(0, first - self.unnamed), max(0, after - self.unnamed))
        out = np.zeros(after - first, np.uint64)
        out[~nulls] = known + np.uint64(self.least % (1 << 64))
        return pa.array(out.astype(np.int64), mask=nulls)


def write_token_files(
    docs: DataFrame, folder: str, tokenizer: str, end_id: int = 2, doc_id: str = "doc_id", text: str = "text", file_ids: int = FILE_IDS, file_docs: int = FILE_DOCS
) -> DataFrame:
    """Files of all documents in ascending doc_id order; gives their manifest (part, seq, file, documents, ids, start), stored."""

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, part, done, out = encoder(tokenizer, end_id), TaskContext.get().partitionId(), [], None
        for batch in batches:
            names = batch.column("doc_id").to_pylist()
            for ids, ends in encode.encode([t or "" for t in batch.column("text").to_pylist()]):
                mine, names = names[: len(ends)], names[len(ends) :]
                doc = start = 0
                while doc < len(ends):
                    out = out or TokenWriter(folder, encode.type)
                    fits = int(np.searchsorted(ends, start + file_ids - out.ids, "right"))
                    after = min(fits, doc + file_docs - len(out.doc_ids))
                    if after <= doc and out.doc_ids:
                        out.close()
                        done.append(out)
                        out = None
                        continue
                    after = max(after, doc + 1)
                    out.add(mine[doc:after], ids[start : ends[after - 1]], ends[doc:after] - start)
                    doc, start = after, int(ends[after - 1])
        if out is not None:
            out.close()
            done.append(out)
        rows = [{"part": part, "seq": k, "file": o.name, "documents": len(o.doc_ids), "ids": o.ids} for k, o in enumerate(done)]
        if rows:
            yield pa.RecordBatch.from_pylist(rows, schema=_manifest_schema())

    rows = docs.select(F.col(f"`{doc_id}`").cast("long").alias("doc_id"), F.col(f"`{text}`").alias("text"))
    keyed = rows.select("*", F.xxhash64("text").alias("hash"), F.spark_partition_id().alias("source"))
    ordered = keyed.repartitionByRange(F.asc_nulls_first("doc_id"), "hash", "source").sortWithinPartitions(F.asc_nulls_first("doc_id"), "hash")
    files = stored(ordered.select("doc_id", "text").mapInArrow(write, "part int, seq int, file string, documents long, ids long"), "token-files")
    # Sums of the ranges first, then inside a range: a row per range is all that one window sees.
    totals = files.groupBy("part").agg(F.sum("ids").alias("n"))
    before = F.coalesce(F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    inside = F.coalesce(F.sum("ids").over(Window.partitionBy("part").orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    started = files.withColumn("inside", inside).join(totals.select("part", before.alias("before")), "part")
    return started.select("part", "seq", "file", "documents", "ids", (F.col("before") + F.col("inside")).alias("start"))


def _manifest_schema() -> pa.Schema:
    return pa.schema([("part", pa.int32()), ("seq", pa.int32()), ("file", pa.string()), ("documents", pa.int64()), ("ids", pa.int64())])


def read_token_files(manifest: DataFrame, folder: str) -> DataFrame:
    """doc_id, start (ids of all documents before), n_tokens and ids_crc32 of every document in the files that ``manifest`` names."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, start in zip(batch.column("file").to_pylist(), batch.column("start").to_pylist(), strict=True):
                with TokenFile(folder, name) as file:
                    for first in range(0, file.documents, 1 << 14):
                        yield _documents(file, first, min(file.documents, first + (1 << 14)), start)

    files = stored(manifest, "token-manifest")
    tasks = max(1, files.count())
    return files.select("file", "start").repartition(tasks, "file").mapInArrow(read, "doc_id long, start long, n_tokens long, ids_crc32 long")


def _documents(file: TokenFile, first: int, after: int, before: int) -> pa.RecordBatch:
    ends = file.ends.values(first, after).astype(np.int64)
    starts = np.r_[file.span(first)[0], ends[:-1]]
    sums, at = [], 0
    while at < len(ends):
        # So many documents as hold READ_IDS ids, or one longer one in pieces.
        upto = max(at + 1, int(np.searchsorted(ends, starts[at] + READ_IDS, "right")))
        if upto == at + 1:
            crc = 0
            for k in range(starts[at], ends[at], READ_IDS):
                crc = zlib.crc32(file.ids(k, min(ends[at], k + READ_IDS)).astype("<u4"), crc)
            sums.append(crc)
        else:
            ids = file.ids(starts[at], ends[upto - 1]).astype("<u4")
            sums += [zlib.crc32(ids[a:b]) for a, b in zip(starts[at:upto] - starts[at], ends[at:upto] - starts[at], strict=True)]
        at = upto
    columns = [file.doc_ids(first, after), pa.array(starts + before), pa.array(ends - starts), pa.array(sums, pa.int64())]
    return pa.RecordBatch.from_arrays(columns, ["doc_id", "start", "n_tokens", "ids_crc32"])


def token_round_trip(docs: DataFrame, tokenizer: str, end_id: int = 2, **settings) -> DataFrame:
    """Writes the token files of ``docs`` to the shared folder and reads them back."""
    folder = fresh_path(docs.sparkSession, "llm-tokens")
    return read_token_files(write_token_files(docs, folder, tokenizer, end_id, **settings), folder)
