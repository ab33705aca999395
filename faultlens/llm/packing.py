"""Best-fit packing of token pieces into sequences of a fixed size.

Documents become token ids with an end id; only longer ones are cut, and all
their pieces but the first are full. How to fill the sequences depends on the
number of pieces of each length alone, a table of at most ``size`` rows. On it,
minimum bin slack runs bin by bin: subset sums over the lengths that are left,
as bits of an integer, give the fullest feasible sequence; among those it takes
the one with the longest pieces; that combination is removed, as often as it
stays available. The plan is as small as the table. Each piece then finds its
place by its rank among the pieces of its length, which is counted in Spark.

Results in special cases: a null or empty text is one piece with the end id
alone; an empty table gives an empty table; repeated rows and null ids are packed
like any others; other columns are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator, Mapping
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from faultlens.llm.storage import written
from faultlens.llm.tokens import encoder

PIECE_SCHEMA = "doc_id long, piece int, start long, length long, ids_crc32 long"

#: Pieces of one length are ranked in groups of about so many.
RANKED_TOGETHER = 100_000


class Pattern(NamedTuple):
    """``parts``: (length, copies) in a sequence, longest first; ``times``: such sequences."""

    parts: tuple[tuple[int, int], ...]
    times: int


def _subset_sums(lengths: list[int], copies: list[int], size: int) -> list[int]:
    """Entry i: bit s is set if the first i lengths can fill exactly s."""
    mask, bits = (1 << (size + 1)) - 1, 1
    out = [bits]
    for length, n in zip(lengths, copies):
        step = 1
        while n:
            take = min(step, n)
            bits |= (bits << (take * length)) & mask
            n -= take
            step *= 2
        out.append(bits)
    return out


def fill(counts: Mapping[int, int], size: int) -> Iterator[Pattern]:
    """Minimum bin slack over ``counts`` (length: number of pieces)."""
    left = {length: n for length, n in sorted(counts.items()) if n > 0}
    while left:
        lengths = list(left)
        sums = _subset_sums(lengths, [min(left[x], size // x) for x in lengths], size)
        total = sums[-1].bit_length() - 1
        parts = []
        for i in range(len(lengths) - 1, -1, -1):
            length = lengths[i]
            # The most copies of the longest length that the shorter ones can complete.
            for n in range(min(left[length], total // length), 0, -1):
                if sums[i] >> (total - n * length) & 1:
                    parts.append((length, n))
                    total -= n * length
                    break
        times = min(left[length] // n for length, n in parts)
        for length, n in parts:
            left[length] -= n * times
            if not left[length]:
                del left[length]
        yield Pattern(tuple(parts), times)


class Places(NamedTuple):
    """Where the pieces of one length go: one row for each pattern that has the length."""

    first_rank: np.ndarray
    first_sequence: np.ndarray
    copies: np.ndarray
    offset: np.ndarray


def places(counts: Mapping[int, int], size: int) -> dict[int, Places]:
    rows: dict[int, list[tuple[int, int, int, int]]] = {}
    ranks: dict[int, int] = {}
    sequence = 0
    for pattern in fill(counts, size):
        offset = 0
        for length, n in pattern.parts:
            rows.setdefault(length, []).append((ranks.get(length, 0), sequence, n, offset))
            ranks[length] = ranks.get(length, 0) + n * pattern.times
            offset += n * length
        sequence += pattern.times
    return {length: Places(*np.array(x, np.int64).T) for length, x in rows.items()}


def pieces(docs: DataFrame, tokenizer: str, size: int, end_id: int) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32 of each piece of ``docs(doc_id, text)``."""

    def cut(batches):
        encode = encoder(tokenizer).encode_many
        end = np.array([end_id], "<u4").tobytes()
        for batch in batches:
            rows = []
            for doc_id, ids in zip(batch.column(0).to_pylist(),
                                   encode(t or "" for t in batch.column(1).to_pylist())):
                ids += end
                n = len(ids) // 4
                low, high = 0, (n - 1) % size + 1
                for piece in range((n - 1) // size + 1):
                    rows.append((doc_id, piece, low, high - low, zlib.crc32(ids[4 * low:4 * high])))
                    low, high = high, high + size
            columns = list(zip(*rows)) or [()] * 5
            yield pa.record_batch(
                [pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int32(), *[pa.int64()] * 3))],
                names=["doc_id", "piece", "start", "length", "ids_crc32"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(
        cut, PIECE_SCHEMA)


def _ranked(cut: DataFrame, n_pieces: int) -> DataFrame:
    """``cut`` with each piece's rank (from 0) among the pieces of its length.

    A length may hold most pieces, so its pieces are spread over groups by a hash,
    counted per group, and ranked within the group after the groups before it.
    """
    groups = max(16, -(-n_pieces // RANKED_TOGETHER))
    spread = cut.withColumn("spread", F.pmod(
        F.xxhash64("doc_id", "piece", "start", "ids_crc32"), F.lit(groups)).cast("int"))
    before = Window.partitionBy("length").orderBy("spread").rowsBetween(
        Window.unboundedPreceding, -1)
    starts = spread.groupBy("length", "spread").agg(F.count("*").alias("n")).select(
        "length", "spread", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"))
    within = Window.partitionBy("length", "spread").orderBy("doc_id", "piece", "start", "ids_crc32")
    return (
        spread.withColumn("place", F.row_number().over(within) - 1)
        .join(starts, ["length", "spread"])
        .withColumn("rank", F.col("place") + F.col("before"))
        .drop("spread", "place", "before")
    )


def pack(cut: DataFrame, size: int) -> DataFrame:
    """``cut`` (with a column ``length``, 1 to ``size``) with sequence_id and offset.

    ``cut`` must be a table that reads alike each time, such as a written one.
    """
    # At most one row per length up to ``size``: the only thing the driver sees.
    counts = {r["length"]: r["n"] for r in cut.groupBy("length").agg(F.count("*").alias("n")).collect()}
    plan = places(counts, size)

    @F.pandas_udf("struct<sequence_id:long,offset:long>")
    def place(length, rank):
        import pandas as pd

        lengths, ranks = length.to_numpy(), rank.to_numpy()
        sequence, offset = np.zeros(len(ranks), np.int64), np.zeros(len(ranks), np.int64)
        for value in np.unique(lengths):
            at = np.flatnonzero(lengths == value)
            p = plan[int(value)]
            row = np.searchsorted(p.first_rank, ranks[at], side="right") - 1
            which, copy = np.divmod(ranks[at] - p.first_rank[row], p.copies[row])
            sequence[at] = p.first_sequence[row] + which
            offset[at] = p.offset[row] + copy * value
        return pd.DataFrame({"sequence_id": sequence, "offset": offset})

    ranked = _ranked(cut, sum(counts.values()))
    return ranked.withColumn("at", place("length", "rank")).select(
        *cut.columns, "at.sequence_id", "at.offset")


def pack_documents(
    docs: DataFrame, tokenizer: str, size: int = 1024, end_id: int = 2
) -> DataFrame:
    """Every piece of every document, with its sequence and its offset there."""
    return pack(written(pieces(docs, tokenizer, size, end_id), "pieces"), size)


def sequences(
    docs: DataFrame, packed: DataFrame, tokenizer: str, end_id: int = 2
) -> DataFrame:
    """sequence_id, ids: the packed sequences themselves.

    ``docs`` must have unique ids here, by which its texts meet their pieces.
    """

    @F.pandas_udf("array<long>")
    def ids_of(text):
        import pandas as pd

        found = encoder(tokenizer).encode_many(t or "" for t in text)
        return pd.Series([[*np.frombuffer(x, "<u4").tolist(), end_id] for x in found])

    ids = docs.select("doc_id", ids_of(F.col("text")).alias("all_ids"))
    return (
        packed.join(ids, "doc_id")
        .select("sequence_id", "offset", F.slice(
            "all_ids", F.col("start").cast("int") + 1, F.col("length").cast("int")).alias("part"))
        .groupBy("sequence_id")
        .agg(F.flatten(F.transform(
            F.array_sort(F.collect_list(F.struct("offset", "part"))), lambda x: x["part"])).alias("ids"))
    )
