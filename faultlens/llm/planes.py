"""Token ids in files of compressed byte planes.

The ids of all documents, in ascending order of doc_id, are cut into blocks of a
fixed number of ids. A block is transposed into planes, the lowest byte (or bit)
of every id, then the next, and so on, and each plane is compressed by itself with
zstandard: high planes are nearly empty. Blocks are the rows of a table of files
that Spark's writer commits, so a lost task leaves nothing half-written; the files
hold consecutive ranges of ids and are numbered in their order (``shard``).

The block index is in the small columns: shard, block, first (ids before the block
in the shard), n_ids, the planes' lengths, and the documents that begin in the
block (doc_id, first id in the shard, number of ids) with the one that goes on
from the block before. Reading a document takes the blocks it lies in, alone.

Results in special cases: a null or empty text has the end id alone; null doc_ids
come last; rows that repeat a doc_id are documents of their own, in the order of
their texts; an empty table gives an empty table; other columns are ignored.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from faultlens.llm.storage import shared_folder
from faultlens.llm.tokens import encoder

BLOCK = 1 << 16
LEVEL = 3
BYTES, BITS = "byte", "bit"

SCHEMA = """shard int, block int, first long, n_ids int, kind string, lengths array<int>,
planes binary, doc_ids array<long>, doc_starts array<long>, doc_lengths array<long>"""


def shuffle_planes(ids: np.ndarray, kind: str = BYTES) -> list[bytes]:
    """The planes of a block of unsigned 32-bit ids, compressed; the lowest first."""
    import zstandard

    rows = np.frombuffer(ids.astype("<u4").tobytes(), np.uint8).reshape(-1, 4)
    if kind == BITS:
        rows = np.unpackbits(rows, axis=1, bitorder="little")
        planes = [np.packbits(rows[:, i], bitorder="little") for i in range(32)]
    else:
        planes = [np.ascontiguousarray(rows[:, i]) for i in range(4)]
    compress = zstandard.ZstdCompressor(level=LEVEL).compress
    return [compress(p.tobytes()) for p in planes]


def unshuffle_planes(planes: list[bytes], n: int, kind: str = BYTES) -> np.ndarray:
    import zstandard

    expand = zstandard.ZstdDecompressor().decompress
    raw = [np.frombuffer(expand(p), np.uint8) for p in planes]
    if kind == BITS:
        bits = np.stack([np.unpackbits(p, count=n, bitorder="little") for p in raw], axis=1)
        rows = np.packbits(bits, axis=1, bitorder="little")
    else:
        rows = np.stack(raw, axis=1)
    return np.ascontiguousarray(rows).view("<u4").ravel()


class _Shard:
    """Collects documents and gives out rows for full blocks."""

    def __init__(self, shard: int, block: int, kind: str):
        self.shard, self.size, self.kind = shard, block, kind
        self.number, self.first, self.total = 0, 0, 0
        self.held, self.held_ids = [], 0
        # Documents that begin in the open block or go on into it: (doc_id, start, length).
        self.docs: list[tuple[int | None, int, int]] = []

    def add(self, doc_id, ids: bytes):
        self.docs.append((doc_id, self.total, len(ids) // 4))
        self.held.append(ids)
        self.held_ids += len(ids) // 4
        self.total += len(ids) // 4
        if self.held_ids >= self.size:
            flat = np.frombuffer(b"".join(self.held), "<u4")
            full = len(flat) // self.size * self.size
            for low in range(0, full, self.size):
                yield self._row(flat[low:low + self.size])
            self.held, self.held_ids = [flat[full:].tobytes()], len(flat) - full

    def rest(self):
        if self.held_ids:
            yield self._row(np.frombuffer(b"".join(self.held), "<u4"))

    def _row(self, ids: np.ndarray) -> tuple:
        end = self.first + len(ids)
        inside = [d for d in self.docs if d[1] < end]
        self.docs = [d for d in self.docs if d[1] + d[2] > end]
        planes = shuffle_planes(ids, self.kind)
        row = (self.shard, self.number, self.first, len(ids), self.kind, [len(p) for p in planes],
               b"".join(planes), *([d[i] for d in inside] for i in range(3)))
        self.first, self.number = end, self.number + 1
        return row


def write_ids(
    docs: DataFrame, path: str, tokenizer: str, end_id: int = 2, block: int = BLOCK,
    kind: str = BYTES,
) -> None:
    """Write the ids of ``docs(doc_id, text)`` to the files of the folder ``path``."""
    types = (pa.int32(), pa.int32(), pa.int64(), pa.int32(), pa.string(), pa.list_(pa.int32()),
             pa.binary(), *[pa.list_(pa.int64())] * 3)
    names = ["shard", "block", "first", "n_ids", "kind", "lengths", "planes",
             "doc_ids", "doc_starts", "doc_lengths"]

    def batch_of(rows):
        return pa.record_batch(
            [pa.array(c, t) for c, t in zip(list(zip(*rows)) or [()] * len(types), types)], names=names)

    def encode(batches):
        from pyspark import TaskContext

        shard = _Shard(TaskContext.get().partitionId(), block, kind)
        end = np.array([end_id], "<u4").tobytes()
        for batch in batches:
            ids = encoder(tokenizer).encode_many(t or "" for t in batch.column(1).to_pylist())
            for doc_id, x in zip(batch.column(0).to_pylist(), ids):
                for row in shard.add(doc_id, x + end):
                    yield batch_of([row])
        for row in shard.rest():
            yield batch_of([row])

    order = [F.col("doc_id").asc_nulls_last(), F.col("text")]
    (
        docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
        .repartitionByRange(order[0]).sortWithinPartitions(*order)
        .mapInArrow(encode, SCHEMA)
        .write.option("compression", "none").parquet(path)
    )


def _parts(with_ids: bool):
    """Each document's part of each block, with the part's checksum or its ids."""

    def read(batches):
        for batch in batches:
            rows = []
            for row in batch.to_pylist():
                ends = np.cumsum([0, *row["lengths"]]).tolist()
                ids = unshuffle_planes(
                    [row["planes"][a:b] for a, b in zip(ends, ends[1:])], row["n_ids"], row["kind"])
                raw = np.ascontiguousarray(ids).tobytes()
                first, last = row["first"], row["first"] + row["n_ids"]
                for doc_id, start, n in zip(row["doc_ids"], row["doc_starts"], row["doc_lengths"]):
                    low, high = max(start, first), min(start + n, last)
                    part = raw[4 * (low - first):4 * (high - first)]
                    rows.append((row["shard"], start, doc_id, n, low, high - low,
                                 part if with_ids else zlib.crc32(part)))
            yield pa.record_batch(
                [pa.array(c, t) for c, t in zip(list(zip(*rows)) or [()] * 7, (
                    pa.int32(), *[pa.int64()] * 5, pa.binary() if with_ids else pa.int64()))],
                names=["shard", "shard_start", "doc_id", "n_tokens", "at", "n", "part"])

    return read


def _times(matrix: list[int], vector: int) -> int:
    out = 0
    for column in matrix:
        if vector & 1:
            out ^= column
        vector >>= 1
    return out


def joined_crc(parts: list[tuple[int, int]]) -> int:
    """Checksum of parts laid end to end, from each part's (checksum, bytes).

    A checksum is linear over bits: the one before is carried on over as many zero
    bytes as the next part has, by squaring the step of one zero bit.
    """
    out = 0
    for crc, n in parts:
        step = [0xEDB88320, *(1 << i for i in range(31))]  # one zero bit (fixed value)
        bits = n * 8
        while bits:
            if bits & 1:
                out = _times(step, out)
            step = [_times(step, column) for column in step]
            bits >>= 1
        out ^= crc
    return out


def read_index(spark: SparkSession, path: str) -> DataFrame:
    """The files' documents: start, n_tokens, ids_crc32 by doc_id, from the ids read back."""
    blocks = spark.read.schema(SCHEMA).parquet(path)
    # One row per file; files are ranges of documents and follow one another.
    order = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    shards = blocks.groupBy("shard").agg(F.sum("n_ids").alias("n")).select(
        "shard", F.coalesce(F.sum("n").over(order), F.lit(0)).alias("before"))

    @F.pandas_udf("long")
    def joined(parts):
        import pandas as pd

        return pd.Series([
            None if p is None else joined_crc([(x["part"], 4 * x["n"]) for x in p])
            for p in parts], dtype="Int64")

    # Only documents that go over the end of a block have parts to join.
    several = F.size("parts") > 1

    parts = blocks.mapInArrow(
        _parts(False), "shard int, shard_start long, doc_id long, n_tokens long, at long, n long, part long")
    return (
        parts.groupBy("shard", "shard_start", "doc_id", "n_tokens")
        .agg(F.array_sort(F.collect_list(F.struct("at", "n", "part"))).alias("parts"))
        .join(F.broadcast(shards), "shard")
        .select("doc_id", (F.col("shard_start") + F.col("before")).alias("start"), "n_tokens",
                F.when(several, joined(F.when(several, F.col("parts"))))
                .otherwise(F.col("parts")[0]["part"]).alias("ids_crc32"))
    )


def read_ids(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start (in its shard), ids: the documents read back."""
    blocks = spark.read.schema(SCHEMA).parquet(path)

    @F.pandas_udf("array<long>")
    def ids_of(parts):
        import pandas as pd

        return pd.Series([np.frombuffer(b"".join(x["part"] for x in p), "<u4").tolist() for p in parts])

    parts = blocks.mapInArrow(
        _parts(True), "shard int, shard_start long, doc_id long, n_tokens long, at long, n long, part binary")
    return (
        parts.groupBy("shard", "shard_start", "doc_id")
        .agg(F.array_sort(F.collect_list(F.struct("at", "part"))).alias("parts"))
        .select("doc_id", "shard", F.col("shard_start").alias("start"), ids_of("parts").alias("ids"))
    )


def round_trip(
    docs: DataFrame, tokenizer: str, end_id: int = 2, block: int = BLOCK, kind: str = BYTES
) -> DataFrame:
    """Write all ids to files in the shared folder and read their index back."""
    spark = docs.sparkSession
    path = shared_folder(spark, "token-planes")
    write_ids(docs, path, tokenizer, end_id, block, kind)
    return read_index(spark, path)
