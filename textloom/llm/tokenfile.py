"""Token-id files: fixed-width bit packing with block offsets.

A file is one segment: header, table of documents, block offsets, blocks of ``BLOCK`` ids, each id in the least bits
that hold the vocabulary, and an end mark. Blocks unpack as whole numpy arrays, and one document is read by seeking to
its blocks alone. Documents go in ascending doc_id order: ranges of doc_id make shards, a shard is written by one task
as segments of bounded size, and Spark's own text writer puts each image out as a file (its bytes as they are, the end
mark for a line end), so any store that Spark writes to will do and a lost task leaves no half file.

Null text is empty (its document is the end id alone). Rows with equal doc_id stay, in order of their text, in one
shard; null doc_id comes first. An empty table gives no rows.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator
from typing import BinaryIO

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textloom.llm.bpe import encoder, vocabulary
from textloom.llm.common import pick, text_slices
from textloom.session import Workspace, ship_package

MAGIC, MARK, END_ID = b"TLBITS02", b"TLBITSEND\n", 1
#: Ids in a block, and in a segment at least before it is closed.
BLOCK, SEGMENT_IDS = 1 << 16, 1 << 21
HEAD = struct.Struct(">8sQQQQQQQQ")  # magic, shard, segment, ids of the shard before it, documents, ids, bits, block, blocks
#: Where the shard and the number of ids stand, for the JVM (from 1).
SHARD_AT, IDS_AT = 9, 41
NULL_DOC = np.iinfo(np.int64).min


def pack(ids: np.ndarray, bits: int) -> bytes:
    """Each id in ``bits`` bits, lowest first; eight ids fill whole bytes."""
    n = len(ids)
    group = np.zeros((-(-n // 8), 8), np.uint64)
    group.reshape(-1)[:n] = ids
    out = np.zeros((len(group), bits), np.uint8)
    for i in range(8):
        first, shift = divmod(i * bits, 8)
        value = group[:, i] << np.uint64(shift)
        for j in range(first, (i * bits + bits - 1) // 8 + 1):
            out[:, j] |= (value >> np.uint64(8 * (j - first)) & np.uint64(255)).astype(np.uint8)
    return out.tobytes()[: -(-n * bits // 8)]


def unpack(data: bytes | memoryview, n: int, bits: int) -> np.ndarray:
    """The first n ids: a 64-bit load at each id's byte, a shift and a mask."""
    padded = np.frombuffer(bytes(data) + b"\0" * 8, np.uint8)
    loads = np.ndarray(len(padded) - 7, "<u8", padded, strides=(1,))
    at = np.arange(n, dtype=np.int64) * bits
    return (loads[at >> 3] >> (at & 7).astype(np.uint64) & np.uint64((1 << bits) - 1)).astype(np.uint32)


def build_segment(doc_ids: list[int], lengths: list[int], ids: np.ndarray, bits: int, shard: int = 0, segment: int = 0, start: int = 0) -> bytes:
    """The image of a file but for its end mark."""
    blocks = [pack(ids[i : i + BLOCK], bits) for i in range(0, len(ids), BLOCK)]
    offsets = np.cumsum([0, *map(len, blocks)]).astype("<u8")
    starts = np.cumsum([0, *lengths]).astype("<u8")
    head = HEAD.pack(MAGIC, shard, segment, start, len(doc_ids), len(ids), bits, BLOCK, len(blocks))
    return b"".join([head, np.array(doc_ids, "<i8").tobytes(), starts.tobytes(), offsets.tobytes(), *blocks])


class Segment:
    """Reader of one file, given as its bytes or opened for seeking. Of an opened one only what is asked for is read."""

    def __init__(self, source: bytes | memoryview | BinaryIO):
        self.source = memoryview(source) if isinstance(source, bytes | memoryview) else source
        magic, self.shard, self.segment, self.start, docs, self.n_ids, self.bits, self.block, blocks = HEAD.unpack(self._bytes(0, HEAD.size))
        if magic != MAGIC:
            raise ValueError("not a token-id segment")
        tables = np.frombuffer(self._bytes(HEAD.size, 8 * (2 * docs + blocks + 2)), "<i8")
        self.doc_ids, self.starts, self.offsets = tables[:docs], tables[docs : 2 * docs + 1], tables[2 * docs + 1 :]
        self.base = HEAD.size + tables.nbytes

    def _bytes(self, at: int, n: int) -> bytes | memoryview:
        if isinstance(self.source, memoryview):
            return self.source[at : at + n]
        self.source.seek(at)
        return self.source.read(n)

    def read(self, start: int, end: int) -> np.ndarray:
        """Ids from start up to end, from their blocks alone."""
        if start >= end:
            return np.zeros(0, np.uint32)
        first, last = start // self.block, (end - 1) // self.block
        data = self._bytes(self.base + int(self.offsets[first]), int(self.offsets[last + 1] - self.offsets[first]))
        at = self.offsets[first : last + 2] - self.offsets[first]
        parts = [unpack(data[at[k] : at[k + 1]], min(self.block, self.n_ids - (first + k) * self.block), self.bits) for k in range(last - first + 1)]
        whole = np.concatenate(parts) if len(parts) > 1 else parts[0]
        return whole[start - first * self.block : end - first * self.block]

    def document(self, k: int) -> np.ndarray:
        return self.read(int(self.starts[k]), int(self.starts[k + 1]))

    def documents(self) -> Iterator[tuple[int, int, np.ndarray]]:
        """doc_id, start and ids of each document, unpacking every block once or so."""
        k = 0
        while k < len(self.doc_ids):
            e = max(k + 1, int(np.searchsorted(self.starts, self.starts[k] + 16 * self.block, side="right")) - 1)
            ids, base = self.read(int(self.starts[k]), int(self.starts[e])), self.starts[k]
            for i in range(k, e):
                yield int(self.doc_ids[i]), int(self.starts[i]), ids[self.starts[i] - base : self.starts[i + 1] - base]
            k = e


def write_token_files(docs: DataFrame, tokenizer_path: str, path: str) -> None:
    """Write all documents as segment files under ``path``, shards in doc_id order."""
    ship_package(docs.sparkSession)
    config = vocabulary(tokenizer_path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder, shard = encoder(config, library=True), TaskContext.get().partitionId()
        bits = max(1, (len(coder.table.names) - 1).bit_length())
        end = np.array([END_ID], "<u4").tobytes()
        state = {"segment": 0, "start": 0}
        names: list[int] = []
        held: list[bytes] = []

        def close() -> pa.RecordBatch:
            ids = np.frombuffer(b"".join(held), "<u4")
            image = build_segment(names, [len(x) // 4 for x in held], ids, bits, shard, state["segment"], state["start"])
            state["segment"] += 1
            state["start"] += len(ids)
            names.clear()
            held.clear()
            return pa.RecordBatch.from_pydict({"image": pa.array([image], pa.binary())})

        size = 0
        for batch in batches:
            ids = batch.column("doc_id").to_pylist()
            for a, b, texts in text_slices(batch.column("text")):
                for doc, coded in zip(ids[a:b], coder.encode_all(texts), strict=True):
                    names.append(NULL_DOC if doc is None else doc)
                    held.append(coded + end)
                    size += len(coded) // 4 + 1
                    if size >= SEGMENT_IDS:
                        size = 0
                        yield close()
        if names:
            yield close()

    ordered = pick(docs, "doc_id", "text").repartitionByRange("doc_id").sortWithinPartitions("doc_id", "text")
    images = ordered.mapInArrow(run, "image binary").select(F.col("image").cast("string"))
    images.write.mode("overwrite").option("maxRecordsPerFile", 1).option("lineSep", MARK.decode()).text(path)


def read_token_files(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of each document, from the files under ``path``."""
    ship_package(spark)
    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(path).filter("length > 0")
    number = lambda at: F.conv(F.hex(F.substring("content", at, 8)), 16, 10).cast("long")
    ends = files.select(number(SHARD_AT).alias("shard"), number(IDS_AT).alias("n")).groupBy("shard").agg(F.sum("n").alias("n")).collect()  # one row for each writing task
    ends = sorted((r["shard"], r["n"]) for r in ends)
    first = dict(zip([k for k, _ in ends], np.cumsum([0, *(n for _, n in ends)]).tolist(), strict=False))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                file = Segment(memoryview(batch.column("content")[i].as_buffer()))
                base = first[file.shard] + file.start
                rows = [(None if d == NULL_DOC else d, base + s, len(x), zlib.crc32(x.astype("<u4").tobytes())) for d, s, x in file.documents()]
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows, strict=True)], names=["doc_id", "start", "n_tokens", "ids_crc32"])

    return files.select("content").mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long")


def token_file_digests(docs: DataFrame, tokenizer_path: str) -> DataFrame:
    """Write all documents, read the files back, and return what they hold."""
    work = Workspace(docs.sparkSession, "tokenfile")
    write_token_files(docs, tokenizer_path, work.path("segments"))
    return read_token_files(docs.sparkSession, work.path("segments"))
