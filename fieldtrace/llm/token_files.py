"""Token ids of documents in seekable zstandard files.

File format, all numbers little-endian:

* one independent zstandard frame per document: its ids as unsigned 32-bit integers, end id included;
* a skippable frame (magic 0x184D2A50) with the document keys: a byte mask (1: key given) and signed 64-bit keys;
* a skippable frame (magic 0x184D2A5E) with the seek table: per frame above the compressed size, the size of
  the content and the low 32 bits of the xxh64 of the content; then the number of entries, a descriptor
  byte (0x80: checksums present) and the magic 0x8F92EAB1.

A reader takes the footer, then the seek table, then only the byte ranges of the documents it wants.
"""

from __future__ import annotations

import struct
import uuid
import zlib
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from fieldtrace.llm.common import chunks, shared_folder, written
from fieldtrace.llm.tokens import encoder

# Fixed values of the format.
_KEYS_MAGIC, _TABLE_MAGIC, _SEEK_MAGIC, _CHECKSUMS = 0x184D2A50, 0x184D2A5E, 0x8F92EAB1, 0x80
_FOOTER = struct.Struct("<IBI")
_ENTRY = np.dtype([("packed", "<u4"), ("size", "<u4"), ("check", "<u4")])
#: A file is closed at the first document that ends beyond this size.
FILE_BYTES = 256 << 20

MANIFEST = "part long, number long, file string, n_docs long, n_tokens long, min_key long, max_key long"


class FrameWriter:
    """Appends documents to one open binary file."""

    def __init__(self, sink, level: int = 3):
        import zstandard

        self._sink = sink
        self._pack = zstandard.ZstdCompressor(level=level, write_checksum=True, write_content_size=True).compress
        self._table: list[tuple[int, int, int]] = []
        self._keys: list[int | None] = []
        self.bytes = self.n_tokens = 0

    def add(self, key: int | None, ids: bytes) -> None:
        import xxhash

        frame = self._pack(ids)
        self._sink.write(frame)
        self._table.append((len(frame), len(ids), xxhash.xxh64_intdigest(ids) & 0xFFFFFFFF))
        self._keys.append(key)
        self.bytes += len(frame)
        self.n_tokens += len(ids) // 4

    def finish(self) -> dict:
        mask = np.array([k is not None for k in self._keys], np.uint8).tobytes()
        body = mask + np.array([k or 0 for k in self._keys], "<i8").tobytes()
        self._sink.write(struct.pack("<II", _KEYS_MAGIC, len(body)) + body)
        table = np.array([*self._table, (8 + len(body), 0, 0)], _ENTRY)
        self._sink.write(struct.pack("<II", _TABLE_MAGIC, table.nbytes + _FOOTER.size) + table.tobytes()
                         + _FOOTER.pack(len(table), _CHECKSUMS, _SEEK_MAGIC))
        given = [k for k in self._keys if k is not None]
        return {"n_docs": len(self._keys), "n_tokens": self.n_tokens,
                "min_key": min(given, default=None), "max_key": max(given, default=None)}


def read_frames(source, wanted: set[int] | None = None) -> Iterator[tuple[int, int | None, bytes]]:
    """(frame number, key, ids) of the wanted documents, all without ``wanted``; raises where a checksum differs."""
    import xxhash
    import zstandard

    size = source.size()
    source.seek(size - _FOOTER.size)
    n, flags, magic = _FOOTER.unpack(source.read(_FOOTER.size))
    if magic != _SEEK_MAGIC or flags != _CHECKSUMS:
        raise ValueError("no seek table at the end of the file")
    head = 8 + n * _ENTRY.itemsize + _FOOTER.size
    source.seek(size - head)
    table = np.frombuffer(source.read(head)[8:-_FOOTER.size], _ENTRY)
    starts = np.concatenate([[0], np.cumsum(table["packed"], dtype=np.int64)])
    source.seek(int(starts[-2]) + 8)
    body = source.read(int(table["packed"][-1]) - 8)
    mask, keys = body[:n - 1], np.frombuffer(body, "<i8", offset=n - 1)
    unpack = zstandard.ZstdDecompressor().decompress
    for i in range(n - 1):
        key = int(keys[i]) if mask[i] else None
        if wanted is not None and key not in wanted:
            continue
        source.seek(int(starts[i]))
        ids = unpack(source.read(int(table["packed"][i])))
        if len(ids) != table["size"][i] or xxhash.xxh64_intdigest(ids) & 0xFFFFFFFF != table["check"][i]:
            raise ValueError(f"frame {i} does not have the content its seek table names")
        yield i, key, ids


def _store(folder: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(folder)


def write_token_files(
    docs: DataFrame, tokenizer: str, end_id: int, folder: str | None = None, key: str = "doc_id", text: str = "text",
) -> DataFrame:
    """Write the ids of every whole text, in ascending key order; returns the manifest, one row per file.

    Rows are range-partitioned by key before they are encoded, so each text is encoded once and files
    follow each other in key order (``part``, ``number``).  A null key comes first, equal keys follow by
    text, a null text is an empty one; an empty document holds the end id alone.  Other columns are not
    read.  Each attempt of a task writes files of its own; only those of the manifest count, so a lost
    executor leaves unused files and no wrong ones.
    """
    folder = folder or shared_folder(docs.sparkSession)
    end = struct.pack("<I", end_id)

    def write(batches):
        store, root = _store(folder)
        store.create_dir(root, recursive=True)
        encode, part, files, writer, sink = encoder(tokenizer), TaskContext.get().partitionId(), [], None, None

        def close():
            files.append({"part": part, "number": len(files), "file": f"{folder}/{name}", **writer.finish()})
            sink.close()

        for batch in chunks(batches, text):
            for k, t in zip(batch.column(key).to_pylist(), batch.column(text).to_pylist()):
                if writer is None:
                    name = f"part-{part:06d}-{len(files):04d}-{uuid.uuid4().hex}.tokens.zst"
                    sink = store.open_output_stream(f"{root}/{name}", compression=None, buffer_size=1 << 20)
                    writer = FrameWriter(sink)
                writer.add(k, encode(t) + end)
                if writer.bytes > FILE_BYTES:
                    close()
                    writer = None
        if writer is not None:
            close()
        if files:
            yield pa.RecordBatch.from_pylist(files, schema=pa.schema([
                (c.split()[0], pa.string() if c.endswith("string") else pa.int64()) for c in MANIFEST.split(", ")]))

    ordered = docs.select(F.col(key).cast("long").alias(key), F.col(text)).repartitionByRange(
        key, F.xxhash64(text)).sortWithinPartitions(key, text)
    return written(ordered.mapInArrow(write, MANIFEST))


def read_token_files(manifest: DataFrame, wanted: Sequence[int] | None = None, with_ids: bool = True) -> DataFrame:
    """Documents of the files of a manifest: doc_id, start, n_tokens, ids_crc32 and the ids themselves.

    ``start`` counts the ids of all documents before.  With ``wanted`` only files whose keys can hold one
    of them are opened and only their frames are decompressed; ``start`` is then null.  An empty manifest
    gives no rows.  One task reads one file, frame by frame.
    """
    keys = None if wanted is None else {int(k) for k in wanted}
    files = manifest.withColumn("before", F.coalesce(F.sum("n_tokens").over(
        W.orderBy("part", "number").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)))  # one row per file
    if keys is not None:
        reach = [F.col("min_key").isNotNull() & F.col("min_key").between(min(keys), max(keys))
                 | F.col("max_key").between(min(keys), max(keys))
                 | (F.col("min_key") <= min(keys)) & (F.col("max_key") >= max(keys))] if keys else [F.lit(False)]
        files = files.where(reach[0])
    schema = [("doc_id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64()), ("ids_crc32", pa.int64())]
    schema += [("ids", pa.list_(pa.int64()))] if with_ids else []
    out = pa.schema(schema)

    def read(batches):
        for batch in batches:
            for row in batch.to_pylist():
                store, path = _store(row["file"])
                rows, size, before = [], 0, row["before"]
                with store.open_input_file(path) as source:
                    for _, k, ids in read_frames(source, keys):
                        n = len(ids) // 4
                        rows.append((k, before if keys is None else None, n, zlib.crc32(ids),
                                     *([np.frombuffer(ids, "<u4").astype(np.int64)] if with_ids else [])))
                        before, size = before + n, size + with_ids * n
                        if len(rows) >= 20_000 or size >= 1 << 20:
                            yield _batch(rows, out)
                            rows, size = [], 0
                if rows:
                    yield _batch(rows, out)

    ddl = "doc_id long, start long, n_tokens long, ids_crc32 long" + ", ids array<long>" * with_ids
    tasks = max(1, min(100_000, manifest.count()))
    return files.select("file", "before").repartition(tasks, "file").mapInArrow(read, ddl)


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)], schema=schema)
