"""Operator 10: token ids as fixed-width bit-packed files.

File layout (all integers little-endian): magic ``TKBP0001``; a header of five
unsigned 64-bit numbers (bits per id, ids per block, documents, ids, blocks);
document ids (int64), a null flag for each (uint8), ids per document (uint64),
block offsets (uint64, one more than blocks, from the payload's start); then
the payload.  Each block holds ``block_ids`` ids of ``bits`` bits, least
significant bit first, padded to a whole byte, so that any id is found with
one offset and a shift.
"""

from __future__ import annotations

import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tokentally.llm.shared import prepare, scratch_dir
from tokentally.llm.tokens import encoder

MAGIC = b"TKBP0001"
BLOCK_IDS = 4096
PIECE = 1 << 15


def pack(ids: np.ndarray, bits: int) -> bytes:
    """``bits`` bits an id, least significant first."""
    if len(ids) == 0:
        return b""
    if bits in (8, 16, 32):
        return ids.astype(f"<u{bits // 8}").tobytes()
    out = []
    for i in range(0, len(ids), PIECE):  # a piece ends at a whole byte; its bits as bytes are what memory holds
        flags = ((ids[i : i + PIECE, None] >> np.arange(bits, dtype=np.uint32)) & 1).astype(np.uint8)
        out.append(np.packbits(flags.ravel(), bitorder="little"))
    return b"".join(p.tobytes() for p in out)


def unpack(data: bytes | memoryview, n: int, bits: int, first: int = 0) -> np.ndarray:
    """Ids ``first`` to ``first + n`` of a packed block; each is one unaligned 64-bit load, a shift and a mask."""
    if n == 0:
        return np.zeros(0, dtype=np.uint32)
    if bits in (8, 16, 32):
        return np.frombuffer(data, dtype=f"<u{bits // 8}", count=n, offset=first * (bits // 8)).astype(np.uint32)
    at = (np.arange(first, first + n, dtype=np.int64)) * bits
    raw = np.frombuffer(bytes(data) + b"\0" * 8, dtype=np.uint8)
    words = np.lib.stride_tricks.as_strided(raw[:8].view("<u8"), shape=(len(raw) - 7,), strides=(1,))
    return ((words[at >> 3] >> (at & 7).astype(np.uint64)) & np.uint64((1 << bits) - 1)).astype(np.uint32)


def write_file(ids: np.ndarray, doc_ids: list[int | None], counts: list[int], bits: int, block_ids: int = BLOCK_IDS) -> bytes:
    """A whole file's bytes."""
    n_blocks = -(-len(ids) // block_ids)
    width = (block_ids * bits + 7) // 8
    if block_ids * bits % 8 == 0:
        payload = pack(ids, bits)
    else:
        payload = b"".join(pack(ids[i : i + block_ids], bits) for i in range(0, len(ids), block_ids))
    offsets = np.minimum(np.arange(n_blocks + 1, dtype="<u8") * width, len(payload)).astype("<u8")
    head = np.array([bits, block_ids, len(doc_ids), len(ids), n_blocks], dtype="<u8")
    return b"".join([MAGIC, head.tobytes(), np.array([d or 0 for d in doc_ids], dtype="<i8").tobytes(), np.array([d is None for d in doc_ids], dtype=np.uint8).tobytes(), np.array(counts, dtype="<u8").tobytes(), offsets.tobytes(), payload])


class PackedFile:
    """Random access to the ids of one file, from its bytes or an open file with read_at(bytes, offset); of the payload only what is asked for is read."""

    def __init__(self, data):
        if hasattr(data, "read_at"):
            self._read = lambda at, n: memoryview(data.read_at(n, at))
        else:
            view = memoryview(data)
            self._read = lambda at, n: view[at : at + n]
        head = self._read(0, 48)
        if bytes(head[:8]) != MAGIC:
            raise ValueError("not a bit-packed id file")
        self.bits, self.block_ids, docs, self.n_ids, blocks = np.frombuffer(head, "<u8", 5, 8).astype(int).tolist()
        index = self._read(48, 17 * docs + 8 * (blocks + 1))
        self.doc_ids = np.frombuffer(index, "<i8", docs, 0)
        self.null = np.frombuffer(index, np.uint8, docs, 8 * docs)
        self.counts = np.frombuffer(index, "<u8", docs, 9 * docs).astype(np.int64)
        self.offsets = np.frombuffer(index, "<u8", blocks + 1, 17 * docs).astype(np.int64)
        self.starts = np.concatenate([[0], np.cumsum(self.counts)])
        self.payload = 48 + 17 * docs + 8 * (blocks + 1)

    def ids(self, start: int, n: int) -> np.ndarray:
        """``n`` ids from ``start``; only the blocks that hold them are read, at once."""
        end = min(start + n, self.n_ids)
        if start >= end:
            return np.zeros(0, dtype=np.uint32)
        low, high = start // self.block_ids, (end - 1) // self.block_ids
        offsets = self.offsets[low : high + 2] - self.offsets[low]
        data = self._read(self.payload + int(self.offsets[low]), int(offsets[-1]))
        if self.block_ids * self.bits % 8 == 0:  # blocks without padding are one run of bits
            return unpack(data, end - start, self.bits, start - low * self.block_ids)
        out = []
        for block in range(low, high + 1):
            a, b = max(start, block * self.block_ids), min(end, (block + 1) * self.block_ids)
            out.append(unpack(data[offsets[block - low] : offsets[block - low + 1]], b - a, self.bits, a - block * self.block_ids))
        return np.concatenate(out)

    def document(self, i: int) -> np.ndarray:
        return self.ids(int(self.starts[i]), int(self.counts[i]))

    def all(self) -> np.ndarray:
        return self.ids(0, self.n_ids)


def _open(uri: str):
    """A pyarrow file system and the path in it: local, HDFS or object store alike."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri)


def write_packed(docs: DataFrame, out_dir: str, tokenizer_path: str, end_id: int, file_ids: int = 16_000_000, block_ids: int = BLOCK_IDS) -> DataFrame:
    """Encode ``docs`` (doc_id, text) and write bit-packed files in ascending doc_id order.

    Returns the manifest: file, part, seq, n_docs, n_ids.  The documents are dealt by
    ranges of doc_id, so that the files' order (part, seq) is the ids' order; a
    file is closed at ``file_ids`` ids, which bounds a worker's memory.  A file is
    written under a name of its own and then moved, so a task that runs again
    replaces it whole.  Null texts count as empty; null doc_ids come first; rows
    that share a doc_id are neighbours, ordered by the first 32 characters of their texts, then by the texts'
    hashes, so that any number of them can be dealt to several tasks; further columns are
    ignored; an empty table gives no file.
    """
    spark = docs.sparkSession
    prepare(spark)
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.substring("text", 1, 32).alias("head"), F.xxhash64("text").alias("digest"), F.rand(11).alias("any"))
    dealt = own.repartitionByRange(n, "doc_id", "head", "digest", "any").sortWithinPartitions("doc_id", "head", "digest").select("doc_id", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        enc = encoder(tokenizer_path)
        bits = max(1, (max(enc.size, end_id + 1) - 1).bit_length())
        end = np.array([end_id], dtype="<u4").tobytes()
        part, made = TaskContext.get().partitionId(), []
        fs, base = _open(out_dir)
        fs.create_dir(base, recursive=True)
        raw: list[bytes] = []
        doc_ids: list[int | None] = []
        counts: list[int] = []
        size = 0

        def close() -> None:
            name = f"part-{part:06d}-{len(made):04d}.tkbp"
            ids = np.frombuffer(b"".join(raw), dtype="<u4")
            own = f"{base}/.{name}-{uuid.uuid4().hex}"
            with fs.open_output_stream(own) as f:
                f.write(write_file(ids, doc_ids, counts, bits, block_ids))
            fs.move(own, f"{base}/{name}")
            made.append((f"{out_dir}/{name}", part, len(made), len(doc_ids), len(ids)))
            raw.clear(), doc_ids.clear(), counts.clear()

        for batch in batches:
            for d, data in zip(batch.column(0).to_pylist(), enc.encode(batch.column(1).to_pylist()), strict=True):
                raw += [data, end]
                doc_ids.append(d)
                counts.append(len(data) // 4 + 1)
                size += counts[-1]
                if size >= file_ids:
                    close()
                    size = 0
        if doc_ids:
            close()
        if made:
            yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(zip(*made, strict=True), (pa.string(), pa.int32(), pa.int32(), pa.int64(), pa.int64()), strict=True)], names=["file", "part", "seq", "n_docs", "n_ids"])

    return dealt.mapInArrow(run, "file string, part int, seq int, n_docs long, n_ids long")


def read_packed(spark: SparkSession, files: list[tuple[str, int]], with_ids: bool = True) -> DataFrame:
    """Read packed files back: doc_id, start, n_tokens, ids_crc32 and, if asked for, ids (binary, unsigned 32-bit).

    ``files`` holds each file and the number of ids before it: one entry a file,
    not a document.
    """
    prepare(spark)
    schema = "doc_id long, start long, n_tokens long, ids_crc32 long" + ", ids binary" * with_ids
    if not files:
        return spark.createDataFrame([], schema)
    listed = spark.createDataFrame(files, "file string, before long").repartition(min(len(files), 4096))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for uri, before in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                fs, path = _open(uri)
                with fs.open_input_file(path) as f:
                    packed = PackedFile(f)
                    starts, docs = packed.starts, len(packed.counts)
                    at = 0
                    while at < docs:  # documents of about a million ids, 1,024 at most
                        to = min(at + 1024, docs, max(at + 1, int(np.searchsorted(starts, starts[at] + 1_000_000))))
                        ids = packed.ids(int(starts[at]), int(starts[to] - starts[at]))
                        view, edges = memoryview(ids.astype("<u4", copy=False)).cast("B"), (4 * (starts[at : to + 1] - starts[at])).tolist()
                        spans = [view[a:b] for a, b in zip(edges[:-1], edges[1:], strict=True)]
                        arrays = [
                            pa.array(packed.doc_ids[at:to], pa.int64(), mask=packed.null[at:to].astype(bool)),
                            pa.array(before + starts[at:to], pa.int64()),
                            pa.array(packed.counts[at:to], pa.int64()),
                            pa.array([zlib.crc32(s) for s in spans], pa.int64()),
                        ]
                        names = ["doc_id", "start", "n_tokens", "ids_crc32"]
                        if with_ids:
                            arrays.append(pa.array([bytes(s) for s in spans], pa.binary()))
                            names.append("ids")
                        yield pa.RecordBatch.from_arrays(arrays, names=names)
                        at = to

    return listed.mapInArrow(run, schema)


def token_files(docs: DataFrame, tokenizer_path: str, end_id: int, out_dir: str | None = None, with_ids: bool = False) -> DataFrame:
    """Write ``docs`` as bit-packed files and return what is read back from them.

    The manifest has a row for each file; it alone comes to the driver, which
    adds up the files' sizes to each file's first position.
    """
    spark = docs.sparkSession
    out_dir = out_dir or f"{scratch_dir(spark)}/packed-{uuid.uuid4().hex}"
    made = sorted(write_packed(docs, out_dir, tokenizer_path, end_id).collect(), key=lambda r: (r.part, r.seq))
    files, before = [], 0
    for r in made:
        files.append((r.file, before))
        before += r.n_ids
    return read_packed(spark, files, with_ids)
