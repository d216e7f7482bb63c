"""Token ids in binary files: fixed-size blocks of ids, transposed into planes, each plane compressed.

Documents are dealt by ranges of their ids, encoded, and written in ascending order.  A file is one record of the
text sink, which writes the bytes of a string as they are and ends each file with ``END``; the sink's commit shows whole
files only.  A file holds whole documents, ``FILE_IDS`` ids or a little more:

    head     HEAD: magic, planes of a block, ids of a block, task and number in the task, documents, ids
    chunks   for each block of ids its planes, each a zstandard frame: the first bytes (bits) of all its ids, the second ones ...
    index    for each block its place, its ids, and the size of each of its planes
    docs     a zstandard frame: the document ids, which of them are null, how many ids each has
    foot     FOOT: the places of index and docs, the size of docs

Files follow each other by task and number.  Reading takes a file at a time and opens it block by block; a
block is found by the index alone.

A null text is empty; a null document id comes first; rows that repeat an id are documents of their own, the
order of unlike ones decided by a hash of the text.  Bytes that are not UTF-8 count as U+FFFD.  No row gives no file and no row.
"""

from __future__ import annotations

import struct
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lectern.llm import vocab
from lectern.llm.common import for_python, new_path, settle, table

VOCABULARY = "byte_bpe_50k.json"
MAGIC, END = b"LTNIDS\x00\x01", "\nLTNIDS-END\n"
HEAD, FOOT = struct.Struct("<8sII2IQQ"), struct.Struct("<QQQ")
#: Ids of a block, and of a file at least, unless it is the last of its task.
BLOCK_IDS, FILE_IDS = 1 << 16, 1 << 23
#: Planes of a block: 4 of bytes or 32 of bits.
PLANES = 4
#: Bytes of a batch whose texts are encoded together.
SLICE_BYTES = 1 << 20
#: The id that ends each document.
END_ID = 0
LEVEL = 3


def planes_of(ids: np.ndarray, planes: int = PLANES) -> list[bytes]:
    """The bit or byte planes of 32-bit ids."""
    rows = ids.astype("<u4").view(np.uint8).reshape(-1, 4)
    if planes == 32:
        return [np.packbits(p, bitorder="little").tobytes() for p in np.unpackbits(rows, axis=1, bitorder="little").T]
    return [p.tobytes() for p in rows.T]


def ids_of(planes: list[bytes], n: int) -> np.ndarray:
    """The n ids that have these planes."""
    rows = np.array([np.frombuffer(p, np.uint8) for p in planes])
    if len(planes) == 32:
        bits = np.unpackbits(rows, axis=1, count=n, bitorder="little")
        return np.packbits(bits.T, axis=1, bitorder="little").reshape(-1).view("<u4")
    return np.ascontiguousarray(rows.T).reshape(-1).view("<u4")


def _index_type(planes: int) -> np.dtype:
    return np.dtype([("at", "<u8"), ("ids", "<u4"), ("sizes", "<u4", (planes,))])


class Packer:
    """Makes a file of documents as they come: full blocks are compressed at once, so only frames and one block are held."""

    def __init__(self, task: int, number: int, planes: int = PLANES, block: int = BLOCK_IDS):
        self.task, self.number, self.planes, self.block = task, number, planes, block
        self.press = zstandard.ZstdCompressor(level=LEVEL)
        self.frames, self.index, self.at, self.n_ids = [], [], HEAD.size, 0
        self.keys, self.lengths, self.open = [], array("Q"), bytearray()

    def add(self, key: int | None, ids: bytes) -> None:
        self.keys.append(key)
        self.lengths.append(len(ids) // 4)
        self.open += ids
        self.n_ids += len(ids) // 4
        whole = len(self.open) // (4 * self.block) * 4 * self.block
        for i in range(0, whole, 4 * self.block):
            self._block(bytes(self.open[i : i + 4 * self.block]))
        del self.open[:whole]

    def _block(self, ids: bytes) -> None:
        made = [self.press.compress(p) for p in planes_of(np.frombuffer(ids, "<u4"), self.planes)]
        self.index.append((self.at, len(ids) // 4, [len(f) for f in made]))
        self.frames += made
        self.at += sum(map(len, made))

    def finish(self) -> bytes:
        """The file, without its END."""
        if self.open:
            self._block(bytes(self.open))
        index = np.array(self.index, _index_type(self.planes)) if self.index else np.zeros(0, _index_type(self.planes))
        keys = np.array([k or 0 for k in self.keys], "<i8").tobytes() + np.array([k is None for k in self.keys], np.uint8).tobytes()
        listed = self.press.compress(keys + np.array(self.lengths, "<u8").tobytes())
        head = HEAD.pack(MAGIC, self.planes, self.block, self.task, self.number, len(self.keys), self.n_ids)
        return b"".join([head, *self.frames, index.tobytes(), listed, FOOT.pack(self.at, self.at + index.nbytes, len(listed))])


def pack(docs: list[tuple[int | None, bytes]], task: int, number: int, planes: int = PLANES, block: int = BLOCK_IDS) -> bytes:
    """A file of the (document id, 32-bit ids) given, without its END."""
    made = Packer(task, number, planes, block)
    for key, ids in docs:
        made.add(key, ids)
    return made.finish()


class File:
    """An open file of token ids."""

    def __init__(self, content: bytes):
        end = len(content) - len(END)
        self.content = content
        magic, self.planes, self.block, self.task, self.number, n, self.n_ids = HEAD.unpack_from(content)
        if magic != MAGIC or content[end:] != END.encode():
            raise ValueError("not a file of token ids, or not all of one")
        index, docs, size = FOOT.unpack_from(content, end - FOOT.size)
        kind = _index_type(self.planes)
        self.index = np.frombuffer(content, kind, (docs - index) // kind.itemsize, index)
        listed = zstandard.ZstdDecompressor().decompress(content[docs : docs + size])
        self.null = np.frombuffer(listed, np.uint8, n, 8 * n).astype(bool)
        self.keys, self.lengths = np.frombuffer(listed, "<i8", n), np.frombuffer(listed, "<u8", n, 9 * n).astype(np.int64)

    def chunk(self, i: int) -> np.ndarray:
        """The ids of block i."""
        at, n, sizes = self.index[i]
        ends = int(at) + np.cumsum(sizes, dtype=np.int64)
        opener = zstandard.ZstdDecompressor()
        return ids_of([opener.decompress(self.content[e - s : e]) for e, s in zip(ends.tolist(), sizes.tolist())], int(n))

    def slice(self, first: int, end: int) -> np.ndarray:
        """The ids from ``first`` to ``end`` of the file; only the blocks that hold them are opened."""
        end = min(end, self.n_ids)
        blocks = range(first // self.block, -(-end // self.block))
        if first >= end:
            return np.zeros(0, "<u4")
        return np.concatenate([self.chunk(i) for i in blocks])[first - blocks[0] * self.block : end - blocks[0] * self.block]

    def documents(self) -> Iterator[list[bytes]]:
        """The ids of each document, as pieces from the blocks it lies in."""
        i, block, at = 0, b"", 0
        for size in (4 * self.lengths).tolist():
            parts = []
            while size:
                if at == len(block):
                    block, at, i = self.chunk(i).tobytes(), 0, i + 1
                parts.append(block[at : at + size])
                at, size = at + len(parts[-1]), size - len(parts[-1])
            yield parts


def write_ids(docs: DataFrame, path: str, key: str = "doc_id", text: str = "text", vocabulary: str = VOCABULARY, planes: int = PLANES, file_ids: int = FILE_IDS) -> None:
    """Write the ids of all texts of ``docs``, each followed by END_ID, in ascending order of ``key``, a whole number."""
    end = np.array([END_ID], "<u4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, task, number = vocab.byte_level(vocabulary, plain=False), TaskContext.get().partitionId(), 0
        file = Packer(task, number, planes)
        for b in batches:
            step = max(1, len(b) * SLICE_BYTES // max(1, b.nbytes))
            for part in (b.slice(i, step) for i in range(0, len(b), step)):
                for k, ids in zip(part.column("key").to_pylist(), encode(vocab.strings(part.column("text")))):
                    file.add(k, ids + end)
                    if file.n_ids >= file_ids:
                        yield pa.RecordBatch.from_arrays([pa.array([file.finish()], pa.binary())], names=["file"])
                        number += 1
                        file = Packer(task, number, planes)
        if file.keys:
            yield pa.RecordBatch.from_arrays([pa.array([file.finish()], pa.binary())], names=["file"])

    body = F.coalesce(F.col(text).cast("string"), F.lit(""))
    rows = docs.select(F.col(key).cast("long").alias("key"), body.alias("text"), F.xxhash64(body).alias("tie"), F.pmod(F.monotonically_increasing_id(), F.lit(1 << 20)).alias("row"))
    rows = rows.repartitionByRange("key", "tie", "row").sortWithinPartitions("key", "tie", "row").select("key", "text")
    files = for_python(rows).mapInArrow(run, "file binary")
    files.select(F.col("file").cast("string").alias("value")).write.option("lineSep", END).option("maxRecordsPerFile", 1).text(path)


def read_ids(spark: SparkSession, path: str, with_ids: bool = False) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32[, ids]) of every document under ``path``; ``start`` counts the ids of all before it.

    ``ids``, on request, are the document's 32-bit ids, little-endian, with the end id.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for content in b.column("content"):
                f = File(content.as_py())
                crcs, ids = np.zeros(len(f.keys), np.int64), []
                for i, parts in enumerate(f.documents()):
                    crc = 0
                    for p in parts:
                        crc = zlib.crc32(p, crc)
                    crcs[i] = crc
                    if with_ids:
                        ids.append(b"".join(parts))
                one = lambda v, kind: pa.array(np.full(len(crcs), v), kind)
                columns = [one(f.task, pa.int32()), one(f.number, pa.int32()), pa.array(f.keys, pa.int64(), mask=f.null), pa.array(np.cumsum(f.lengths) - f.lengths), pa.array(f.lengths), pa.array(crcs)]
                columns += [pa.array(ids, pa.binary())] if with_ids else []
                yield pa.RecordBatch.from_arrays(columns, names=["task", "number", "doc_id", "inside", "n_tokens", "ids_crc32", *["ids"] * with_ids])

    files = spark.read.format("binaryFile").load(path).filter("length > 0").select("content")
    kind = "task int, number int, doc_id bigint, inside bigint, n_tokens bigint, ids_crc32 bigint" + ", ids binary" * with_ids
    docs = settle(for_python(files).mapInArrow(run, kind), "token-documents")
    sizes = docs.groupBy("task", "number").agg(F.sum("n_tokens").alias("ids"))
    earlier = lambda w: F.coalesce(F.sum("ids").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0).cast("long"))
    tasks = sizes.groupBy("task").agg(F.sum("ids").alias("ids")).select("task", earlier(Window.orderBy("task")).alias("before"))
    sizes = sizes.withColumn("ahead", earlier(Window.partitionBy("task").orderBy("number"))).join(tasks, "task")
    placed = docs.join(sizes.select("task", "number", (F.col("before") + F.col("ahead")).alias("base")), ["task", "number"])
    return placed.select("doc_id", (F.col("base") + F.col("inside")).alias("start"), "n_tokens", "ids_crc32", *["ids"] * with_ids)


def op11_token_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = new_path(spark, "token-ids")
    write_ids(table(spark, sf_dir, "documents"), path)
    return read_ids(spark, path)


QUERIES = {"op11_token_ids": op11_token_ids}
#: SQL has no tokenizers; the tests compare with the library, text by text.
ORACLES: dict[str, str] = {}
