"""Token files: ids bit-packed at the vocabulary's width, in blocks, with random access (operator 2).

One shard, all little-endian:

    b"IDPACK01"
    blocks      ``block`` ids each (the last may hold fewer), ``bits`` per id,
                least significant bit first, every block padded to whole bytes
    blocks'     uint64 byte offset of every block, and of the end
    documents   int64 key, uint8 "key is null", uint64 first id of every document,
                and one more uint64: the number of ids
    trailer     uint64 blocks, documents, ids; uint32 block, bits; b"IDPACK01"

Every attempt of a task writes under names of its own, and nothing is renamed.
The manifest, committed by Spark with the tasks that ended well, is what says
which shards belong to the table; what a lost attempt left is never read.
"""

from __future__ import annotations

import struct
import uuid

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..session import new_folder
from .shared import partitions, store

MAGIC = b"IDPACK01"
TRAILER = struct.Struct("<QQQII8s")
MANIFEST = "part int, shard int, path string, n_docs long, n_ids long, bits int"


def bits_for(vocabulary: int) -> int:
    """Least number of bits that hold every id below ``vocabulary``."""
    return max(1, (vocabulary - 1).bit_length())


def pack(ids: np.ndarray, bits: int) -> bytes:
    if bits in (8, 16, 32):  # the same layout as below
        return ids.astype(f"<u{bits // 8}").tobytes()
    flags = np.unpackbits(ids.astype("<u4").view(np.uint8), bitorder="little").reshape(-1, 32)[:, :bits]
    return np.packbits(flags, bitorder="little").tobytes()


def unpack(raw: bytes, bits: int, n: int) -> np.ndarray:
    if bits in (8, 16, 32):
        return np.frombuffer(raw, f"<u{bits // 8}", n).astype(np.uint32)
    flags = np.unpackbits(np.frombuffer(raw, np.uint8), count=n * bits, bitorder="little").reshape(n, bits)
    wide = np.zeros((n, 32), np.uint8)
    wide[:, :bits] = flags
    return np.packbits(wide, bitorder="little").view("<u4").astype(np.uint32)


def _files(uri: str):
    """File system and path of a Hadoop-style URI; ``s3a`` and ``s3n`` are names of Hadoop's for ``s3``."""
    from pyarrow import fs

    scheme, _, rest = uri.partition("://")
    if rest and scheme in ("s3a", "s3n"):
        uri = f"s3://{rest}"
    return fs.FileSystem.from_uri(uri) if "://" in uri or uri.startswith("file:") else (fs.LocalFileSystem(), uri)


class ShardWriter:
    """Streams ids to a shard; only one block and the document table stay in memory."""

    def __init__(self, uri: str, bits: int, block: int):
        files, path = _files(uri)
        self.out = files.open_output_stream(path)
        self.out.write(MAGIC)
        self.bits, self.block, self.place = bits, block, len(MAGIC)
        self.rest, self.blocks = np.zeros(0, np.uint32), []
        self.keys, self.nulls, self.first, self.n_ids = [], [], [], 0

    def add(self, key: int | None, ids: np.ndarray) -> None:
        self.keys.append(key or 0)
        self.nulls.append(key is None)
        self.first.append(self.n_ids)
        self.n_ids += len(ids)

    def ids(self, ids: np.ndarray, last: bool = False) -> None:
        if len(ids) and int(ids.max()) >> self.bits:
            raise ValueError(f"id {int(ids.max())} needs more than {self.bits} bits")
        self.rest = np.concatenate([self.rest, ids])
        full = len(self.rest) if last else len(self.rest) // self.block * self.block
        for lo in range(0, full, self.block):
            raw = pack(self.rest[lo:lo + self.block], self.bits)
            self.blocks.append(self.place)
            self.out.write(raw)
            self.place += len(raw)
        self.rest = self.rest[full:]

    def close(self) -> None:
        self.ids(np.zeros(0, np.uint32), last=True)
        self.out.write(np.array([*self.blocks, self.place], "<u8").tobytes())
        self.out.write(np.array(self.keys, "<i8").tobytes() + np.array(self.nulls, "<u1").tobytes())
        self.out.write(np.array([*self.first, self.n_ids], "<u8").tobytes())
        self.out.write(TRAILER.pack(len(self.blocks), len(self.keys), self.n_ids, self.block, self.bits, MAGIC))
        self.out.close()


class ShardReader:
    """Random access to a shard: any range of ids, any document."""

    def __init__(self, uri: str):
        fs, path = _files(uri)
        self.file = fs.open_input_file(path)
        size = self.file.size()
        head = TRAILER.unpack(self.file.read_at(TRAILER.size, size - TRAILER.size))
        n_blocks, self.n_docs, self.n_ids, self.block, self.bits, magic = head
        if magic != MAGIC:
            raise ValueError(f"{uri} is not a token file")
        length = 8 * (n_blocks + 1) + 9 * self.n_docs + 8 * (self.n_docs + 1)
        raw = self.file.read_at(length, size - TRAILER.size - length)
        cut = np.cumsum([8 * (n_blocks + 1), 8 * self.n_docs, self.n_docs])
        self.offsets = np.frombuffer(raw[:cut[0]], "<u8").astype(np.int64)
        self.keys = np.frombuffer(raw[cut[0]:cut[1]], "<i8")
        self.nulls = np.frombuffer(raw[cut[1]:cut[2]], "<u1").astype(bool)
        self.first = np.frombuffer(raw[cut[2]:], "<u8").astype(np.int64)

    def range(self, start: int, end: int) -> np.ndarray:
        if end <= start:
            return np.zeros(0, np.uint32)
        lo, hi = start // self.block, (end - 1) // self.block
        raw = self.file.read_at(int(self.offsets[hi + 1] - self.offsets[lo]), int(self.offsets[lo]))
        out = []
        for b in range(lo, hi + 1):
            n = min(self.block, self.n_ids - b * self.block)
            at = self.offsets[b] - self.offsets[lo]
            out.append(unpack(raw[at:at + self.offsets[b + 1] - self.offsets[b]], self.bits, n))
        return np.concatenate(out)[start - lo * self.block:end - lo * self.block]

    def document(self, i: int) -> np.ndarray:
        return self.range(int(self.first[i]), int(self.first[i + 1]))


def ordered(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Documents in ascending key order over range partitions; equal keys are ordered, and split, by their text's hash."""
    by = [F.col("key").asc_nulls_first(), F.col("h")]
    rows = docs.select(F.col(key).cast("long").alias("key"), F.col(text).cast("string").alias("text"))
    rows = rows.withColumn("h", F.xxhash64("text"))
    return rows.repartitionByRange(partitions(docs.sparkSession), *by).sortWithinPartitions(*by).select("key", "text")


def write(
    encoded: DataFrame, vocabulary: int, folder: str | None = None, block: int = 4096, shard_ids: int = 1 << 27
) -> DataFrame:
    """Write ``(key, n_tokens, ids)`` in its present order as shards; returns the manifest ``(…, base, base_doc)``.

    A partition becomes one shard, or several of about ``shard_ids`` ids.  The
    manifest has one row per shard in order, with the ids and documents before
    it.  Documents without ids stay in the document table.  Null keys are kept as
    such, rows that share a key stay rows of their own, and an empty table has an
    empty manifest.
    """
    spark = encoded.sparkSession
    folder = folder or new_folder(spark, "token-shards")
    spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder).getFileSystem(
        spark.sparkContext._jsc.hadoopConfiguration()).mkdirs(spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder))
    bits = bits_for(vocabulary)

    def run(batches):
        part, shard, made, out = TaskContext.get().partitionId(), 0, [], None
        attempt = uuid.uuid4().hex[:12]

        def end():
            out.close()
            made.append((part, shard, uri, len(out.keys), out.n_ids, bits))

        for batch in (b.slice(lo, 256) for b in batches for lo in range(0, b.num_rows, 256)):
            for key, raw in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist()):
                if out is not None and out.n_ids >= shard_ids:
                    end()
                    shard, out = shard + 1, None
                if out is None:
                    uri = f"{folder}/part-{part:06d}-{shard:04d}-{attempt}.ids"
                    out, held, waiting = ShardWriter(uri, bits, block), 0, []
                ids = np.frombuffer(raw, "<u4")
                out.add(key, ids)
                waiting.append(ids)
                held += len(ids)
                if held >= 1 << 18:
                    out.ids(np.concatenate(waiting))
                    held, waiting = 0, []
            if out is not None and waiting:
                out.ids(np.concatenate(waiting))
                held, waiting = 0, []
        if out is not None:
            end()
        if made:
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, t) for c, t in zip(zip(*made), (pa.int32(), pa.int32(), pa.string(), pa.int64(), pa.int64(), pa.int32()))],
                names=["part", "shard", "path", "n_docs", "n_ids", "bits"])

    shards = store(encoded.select("key", "n_tokens", "ids").mapInArrow(run, MANIFEST), "token-manifest")
    before = Window.orderBy("part", "shard").rowsBetween(Window.unboundedPreceding, -1)  # one row per shard
    return shards.select(
        "*", F.coalesce(F.sum("n_ids").over(before), F.lit(0)).alias("base"),
        F.coalesce(F.sum("n_docs").over(before), F.lit(0)).alias("base_doc"),
    )


def read(manifest: DataFrame, group: int = 1 << 20) -> DataFrame:
    """Documents of all shards: ``(key, start, n_tokens, ids)`` with ``start`` counted over all shards.

    Documents without ids come back with none, null keys as null, repeated keys as
    often as they were written; an empty manifest gives no rows.
    """
    spark: SparkSession = manifest.sparkSession

    def run(batches):
        for batch in batches:
            for uri, base in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                shard, lo = ShardReader(uri), 0
                while lo < shard.n_docs:
                    hi = max(lo + 1, int(np.searchsorted(shard.first, shard.first[lo] + group, "right")) - 1)
                    hi = min(hi, shard.n_docs)
                    ids = shard.range(int(shard.first[lo]), int(shard.first[hi]))
                    n = np.diff(shard.first[lo:hi + 1])
                    from .bpe import binary

                    yield pa.RecordBatch.from_arrays([
                        pa.array(shard.keys[lo:hi], pa.int64(), mask=shard.nulls[lo:hi]),
                        pa.array(base + shard.first[lo:hi], pa.int64()), pa.array(n, pa.int64()),
                        binary(ids.astype("<u4"), n * 4),
                    ], names=["key", "start", "n_tokens", "ids"])
                    lo = hi

    return (
        manifest.select("path", "base").repartition(partitions(spark), "path")
        .mapInArrow(run, "key long, start long, n_tokens long, ids binary")
    )
