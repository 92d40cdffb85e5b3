"""Token-id files by bit-plane shuffling.

A file is: MAGIC; the chunks; the index; the trailer. A chunk holds up to
`block` ids as unsigned 32-bit integers, transposed into planes (32 bit planes
or 4 byte planes), each plane compressed by zstandard on its own, since the high
planes are nearly constant and the low ones are not. The index, compressed too,
has for each chunk its offset, its count of ids and the size of each plane, and
for each document its id and count of ids. So any chunk can be read by itself.
"""

from __future__ import annotations

import struct
import uuid
import zlib
from collections.abc import Iterator
from urllib.parse import urlparse

import numpy as np
import pandas as pd
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import need, new_path, partitions
from .encode import encoder

MAGIC = b"VXPLANE1"
_TRAILER = struct.Struct("<QQQQB7x")  # index offset and size, chunks, documents, planes


def to_planes(ids: np.ndarray, planes: int) -> np.ndarray:
    """The ids' planes, least significant first: shape (planes, bytes of a plane)."""
    by_byte = np.ascontiguousarray(ids, "<u4").view(np.uint8).reshape(-1, 4).T
    if planes == 4:
        return np.ascontiguousarray(by_byte)
    bits = np.unpackbits(by_byte[:, :, None], axis=2, bitorder="little")  # byte, id, bit
    return np.packbits(bits.transpose(0, 2, 1).reshape(32, -1), axis=1, bitorder="little")


def from_planes(planes: np.ndarray, count: int) -> np.ndarray:
    if len(planes) == 4:
        return np.ascontiguousarray(planes.T).view("<u4").ravel()
    bits = np.unpackbits(planes, axis=1, count=count, bitorder="little").reshape(4, 8, count)
    return np.ascontiguousarray(np.packbits(bits, axis=1, bitorder="little").reshape(4, count).T).view("<u4").ravel()


class Writer:
    """Writes one file; holds at most one block of ids and the index."""

    def __init__(self, out, block: int = 65_536, planes: int = 4, level: int = 3) -> None:
        if planes not in (4, 32) or block < 1:
            raise ValueError("planes must be 4 (bytes) or 32 (bits), and block positive")
        self.out, self.block, self.planes = out, block, planes
        self.packer = zstandard.ZstdCompressor(level=level)
        self.rest, self.waiting = [], 0
        self.at, self.chunks, self.docs = len(MAGIC), [], []
        out.write(MAGIC)

    def add(self, doc_id: int | None, ids: bytes) -> None:
        self.docs.append((doc_id is not None, doc_id or 0, len(ids) // 4))
        self.rest.append(ids)
        self.waiting += len(ids) // 4
        if self.waiting >= self.block:
            joined = np.frombuffer(b"".join(self.rest), "<u4")
            whole = len(joined) // self.block * self.block
            for i in range(0, whole, self.block):
                self._chunk(joined[i : i + self.block])
            self.rest, self.waiting = [joined[whole:].tobytes()], len(joined) - whole

    def _chunk(self, ids: np.ndarray) -> None:
        packed = [self.packer.compress(p.tobytes()) for p in to_planes(ids, self.planes)]
        self.chunks.append([self.at, len(ids), *map(len, packed)])
        self.out.write(b"".join(packed))
        self.at += sum(map(len, packed))

    def close(self) -> None:
        if self.waiting:
            self._chunk(np.frombuffer(b"".join(self.rest), "<u4"))
        known, ids, counts = zip(*self.docs, strict=True) if self.docs else ((), (), ())
        index = np.array(self.chunks, "<u8").tobytes() + np.array(ids, "<i8").tobytes() + np.array(counts, "<u8").tobytes() + np.array(known, "u1").tobytes()
        index = self.packer.compress(index)
        self.out.write(index)
        self.out.write(_TRAILER.pack(self.at, len(index), len(self.chunks), len(self.docs), self.planes))


class Reader:
    """Reads a file: its index at once, its chunks one at a time."""

    def __init__(self, source) -> None:
        source.seek(0)
        if source.read(len(MAGIC)) != MAGIC:
            raise ValueError("not a token file")
        source.seek(0, 2)
        end = source.tell()
        source.seek(end - _TRAILER.size)
        at, size, n, docs, self.planes = _TRAILER.unpack(source.read(_TRAILER.size))
        source.seek(at)
        index = zstandard.ZstdDecompressor().decompress(source.read(size))
        wide = 2 + self.planes
        self.source = source
        self.chunks = np.frombuffer(index, "<u8", n * wide).reshape(n, wide).tolist()
        self.doc_ids = np.frombuffer(index, "<i8", docs, n * wide * 8)
        self.counts = np.frombuffer(index, "<u8", docs, (n * wide + docs) * 8).astype(np.int64)
        self.known = np.frombuffer(index, "u1", docs, (n * wide + 2 * docs) * 8).astype(bool)

    def chunk(self, k: int) -> np.ndarray:
        at, count, *sizes = self.chunks[k]
        self.source.seek(at)
        packed, planes, i = self.source.read(sum(sizes)), [], 0
        for s in sizes:
            planes.append(np.frombuffer(zstandard.ZstdDecompressor().decompress(packed[i : i + s]), np.uint8))
            i += s
        return from_planes(np.array(planes), count)

    def documents(self) -> Iterator[tuple[int | None, np.ndarray]]:
        """Each document's id and ids, in the order written."""
        rest, k = np.empty(0, "<u4"), 0
        for known, doc_id, count in zip(self.known.tolist(), self.doc_ids.tolist(), self.counts.tolist(), strict=True):
            parts, have = [rest], len(rest)
            while have < count:
                parts.append(self.chunk(k))
                have, k = have + len(parts[-1]), k + 1
            joined = np.concatenate(parts) if len(parts) > 1 else rest
            yield doc_id if known else None, joined[:count]
            rest = joined[count:]


def _store(uri: str):
    """The file system and path of a URI, as executors open it."""
    from pyarrow import fs

    where = urlparse(uri)
    if where.scheme in ("", "file"):
        return fs.LocalFileSystem(), where.path
    return fs.FileSystem.from_uri(uri)


def write_tokens(docs: DataFrame, tokenizer_path: str, end_id: int, folder: str, block: int = 65_536, planes: int = 4) -> list[tuple[int, str, int, int]]:
    """Encode `documents` and write token files in ascending doc_id order.

    Gives (number, path, documents, ids) of each file, in order; as many entries
    as partitions, whatever the input's size. A file is written under another
    name and renamed when it is whole, and a task that runs again writes a file
    of its own, so neither a lost executor nor a second attempt spoils one.

    Null texts count as empty; rows with equal doc_id stay apart, ordered by
    text; a null doc_id comes first. An empty table gives no files.
    """

    def write(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        codec, writer, end = encoder(tokenizer_path), None, np.array([end_id], "<u4").tobytes()
        store, base = _store(folder)
        number = TaskContext.get().partitionId()
        final = f"{base}/part-{number:05d}-{uuid.uuid4().hex}.tok"
        n_docs = n_ids = 0
        out = None
        for pdf in batches:
            for k in range(0, len(pdf), 256):
                rows = pdf.iloc[k : k + 256]
                for doc_id, null, ids in zip(rows["doc_id"], rows["unknown"], codec.encode(rows["text"].tolist()), strict=True):
                    if writer is None:
                        store.create_dir(base, recursive=True)
                        out = store.open_output_stream(f"{final}.tmp")
                        writer = Writer(out, block, planes)
                    writer.add(None if null else int(doc_id), ids + end)
                    n_docs, n_ids = n_docs + 1, n_ids + len(ids) // 4 + 1
        if writer is not None:
            writer.close()
            out.close()
            store.move(f"{final}.tmp", final)
            yield pd.DataFrame({"number": [number], "path": [final], "n_docs": [n_docs], "n_ids": [n_ids]})

    spark = docs.sparkSession
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = (
        need(docs, "doc_id", "text")
        .select(F.coalesce("doc_id", F.lit(0)).alias("doc_id"), F.col("doc_id").isNull().alias("unknown"), text.alias("text"))
        .repartitionByRange(partitions(spark), F.col("unknown").desc(), F.col("doc_id"))
        .sortWithinPartitions(F.col("unknown").desc(), "doc_id", "text")
    )
    files = rows.mapInPandas(write, "number int, path string, n_docs long, n_ids long").collect()
    return [tuple(f) for f in sorted(files)]


def read_tokens(spark, files: list[tuple[int, str, int, int]], folder: str) -> DataFrame:
    """From token files: doc_id, start, n_tokens and ids_crc32 of each document."""

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        store, _ = _store(folder)
        for pdf in batches:
            for path, at in zip(pdf["path"], pdf["start"], strict=True):
                with store.open_input_file(path) as source:
                    reader, rows = Reader(source), []
                    for doc_id, ids in reader.documents():
                        rows.append((doc_id, at, len(ids), zlib.crc32(ids.astype("<u4", copy=False).tobytes())))
                        at += len(ids)
                        if len(rows) == 10_000:
                            yield _frame(rows)
                            rows = []
                    yield _frame(rows)

    listed, start = [], 0
    for _, path, _, n_ids in files:
        listed.append((path, start))
        start += n_ids
    table = spark.createDataFrame(listed, "path string, start long")
    return table.repartition(max(1, len(listed))).mapInPandas(read, "doc_id long, start long, n_tokens long, ids_crc32 long")


def _frame(rows: list[tuple]) -> pd.DataFrame:
    doc_id, start, n, crc = zip(*rows, strict=True) if rows else ((), (), (), ())
    return pd.DataFrame({"doc_id": pd.array(doc_id, "Int64"), "start": np.array(start, "i8"), "n_tokens": np.array(n, "i8"), "ids_crc32": np.array(crc, "i8")})


def token_output(docs: DataFrame, tokenizer_path: str, end_id: int = 2, block: int = 65_536, planes: int = 4) -> DataFrame:
    """Write the token files of `docs` to the shared folder and read them back."""
    spark = docs.sparkSession
    folder = new_path(spark, "tokens")
    return read_tokens(spark, write_tokens(docs, tokenizer_path, end_id, folder, block, planes), folder)
