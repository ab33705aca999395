"""Interpolated modified Kneser-Ney language model of any order.

Every job runs over the whole training texts:

1. The grams of the highest order are hashed and counted, and stored as sorted hash
   arrays with their counts; the counts of counts give the discounts.
2. Order by order downwards, each shorter gram's totals are summed with the longer
   grams' counts looked up in those arrays: its occurrences, the sum of what follows it
   as a context, what the discounts free there, and in how many different longer grams
   it comes last, its continuation count (an occurrence of a longer gram that occurs
   n times adds 1/n). They are stored in the same way.
3. Texts are scored by workers that map the arrays into memory.

A text stands after as many starts as a context is long. What the model stores and
gathers grows with the corpus, in shards.

Results in special cases: a null or empty text is its end alone; an unknown word has
the share that is left for words never seen; a context never seen leaves the
distribution of the next shorter one; without training texts every token has probability 1;
rows that repeat a doc_id count each; a null doc_id counts as empty text in the
choice of training rows; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from faultlens.llm import hash_arrays
from faultlens.llm.storage import shared_folder
from faultlens.llm.words import FACTOR, IS_SPACE, Block, Hasher, mix, runs, text_blocks

#: Words of the longest grams of the registered query.
ORDER = 3

#: Bytes of training text for each shard, grams that a worker gathers, bytes of a block.
SHARD, GATHERED, BLOCK = 1 << 25, 1 << 22, 1 << 21

LOWER = np.arange(256, dtype=np.uint8)
LOWER[ord("A"):ord("Z") + 1] += 32
#: Hashes of what stands before and after a text (fixed values).
START, END = np.uint64(0x5354415254000001), np.uint64(0x454E440000000001)

LARGE = 255  # in a column of counts: the number is among the few large ones, beside
#: Columns of counts of the grams below the highest order, which have "token" alone.
COUNTS = ("token", "context", "second")


class Discounts(NamedTuple):
    """What is taken off a count of one, two, and three or more."""

    one: float
    two: float
    more: float

    def of(self, counts: np.ndarray) -> np.ndarray:
        return np.choose(np.minimum(counts, 3).astype(int), [0.0, *self])


def discounts(n1: int, n2: int, n3: int, n4: int) -> Discounts:
    """From the numbers of entries that are counted once, twice, three and four times."""
    if not n1 or not n2:
        return Discounts(0.5, 0.75, 0.9)  # too few to estimate them
    y = n1 / (n1 + 2 * n2)
    one = 1 - 2 * y * n2 / n1
    two = 2 - 3 * y * n3 / n2
    more = 3 - 4 * y * n4 / n3 if n3 else two
    return Discounts(min(max(one, 0.05), 0.95), min(max(two, 0.05), 1.95), min(max(more, 0.05), 2.95))


class Model(NamedTuple):
    """Where the arrays are, and the few numbers beside them."""

    folder: str
    shards: int
    order: int
    discounts: tuple[Discounts, ...]  # of grams of one word, of two, ...
    tokens: int  # training tokens
    words: int  # distinct ones
    pairs: int  # distinct pairs
    freed: float  # what the discounts of single words free, of 1


def _sequences(block: Block, last: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """A block's words with starts and ends, the places of its tokens, and their rows.

    ``last``: the words before the block, where its first row goes on from another;
    as many as there are starts before a row.
    """
    data = LOWER[block.data]
    starts, ends = runs(~IS_SPACE[data], block.bounds[1:-1])
    row = np.searchsorted(block.bounds, starts, side="right") - 1
    n, before = len(block.bounds) - 1, len(last)
    flat = np.full(len(starts) + (before + 1) * n, START)
    of = np.full(len(flat), -1)
    final = np.searchsorted(row, np.arange(n), side="right") + (before + 1) * np.arange(n) + before
    place = np.arange(len(starts)) + (before + 1) * row + before
    flat[final], flat[place] = END, Hasher(data)(starts, ends)
    of[final], of[place] = np.arange(n), row
    if not block.begins:
        flat[:before] = last
    if not block.ends:
        flat, of = flat[:-1], of[:-1]
    at = np.flatnonzero(of >= 0)
    return flat, at, of[at]


def _longer(grams: np.ndarray, words: np.ndarray) -> np.ndarray:
    return mix(grams * np.uint64(FACTOR) + words)


def _tokens(texts: pa.Array, order: int) -> Iterator[tuple[list[np.ndarray], np.ndarray, np.ndarray]]:
    """(hashes, at, row) block by block: the hashes of the grams of one word, of two, ... that
    end at each place of the block, the places of its tokens, and their rows."""
    last = np.full(order - 1, START)
    for block in text_blocks(texts, BLOCK):
        flat, at, row = _sequences(block, last)
        last = flat[len(flat) - order + 1:]
        hashes = [flat]
        for _ in range(order - 1):
            hashes.append(np.concatenate((hashes[-1][:1], _longer(hashes[-1][:-1], flat[1:]))))
        yield hashes, at, row + block.first


def _grams(hashes: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct grams that end with a token or before one, in order; which of them
    ends with each token, and which before it."""
    used = np.zeros(len(hashes), bool)
    used[at] = used[at - 1] = True
    number = np.cumsum(used) - 1
    kinds, of = hash_arrays.distinct(hashes[used])
    return kinds, of[number[at]], of[number[at - 1]]


def _store(folder: str, name: str, shard: int, hashes: np.ndarray,
           counts: dict[str, np.ndarray], **beside: np.ndarray) -> None:
    """Grams that occur once are stored as their hash alone, since all their counts are 1."""
    once = counts["token"] == 1
    hash_arrays.store(folder, f"{name}-once", shard, {"hash": hashes[once]})
    hashes = hashes[~once]
    counts = {key: c[~once] for key, c in counts.items()}
    hash_arrays.store(folder, name, shard, {
        "hash": hashes, **{k: np.minimum(c, LARGE).astype("<u1") for k, c in counts.items()},
        **{k: c[~once] for k, c in beside.items()}})
    for key, c in counts.items():
        large = np.flatnonzero(c >= LARGE)
        hash_arrays.store(folder, f"{name}-{key}", shard, {
            "hash": hashes[large], "count": c[large].astype("<u8")})


def _counts(folder: str, name: str, shards: int, hashes: np.ndarray, keys: tuple[str, ...],
            freed: float | None = None) -> dict[str, np.ndarray]:
    """Columns of sorted distinct grams; ``freed``: what a gram that occurs once has there."""
    once = hash_arrays.holds(folder, f"{name}-once", shards, hashes)
    rest = np.flatnonzero(~once)  # the others alone can be among those that occur more often
    stored = hash_arrays.find(folder, name, shards, hashes[rest], {
        **dict.fromkeys(keys, "<u1"), **({} if freed is None else {"freed": "<f8"})})
    found = {}
    for key in keys:
        counts = stored[key].astype(np.int64)
        large = np.flatnonzero(counts == LARGE)
        if len(large):
            counts[large] = hash_arrays.find(
                folder, f"{name}-{key}", shards, hashes[rest[large]], {"count": "<u8"})["count"]
        found[key] = np.ones(len(hashes), np.int64)
        found[key][rest] = counts
    if freed is not None:
        found["freed"] = np.full(len(hashes), freed)
        found["freed"][rest] = stored["freed"]
    return found


def _pieces(gathered: Iterator[tuple[np.ndarray, list[np.ndarray]]], shards: int, kinds: Sequence[str],
            most: int):
    """Rows (shard, piece) of sums of columns of ``kinds``; ``gathered`` is summed up to
    ``most`` rows at a time."""
    def rows(held):
        hashes, columns = hash_arrays.summed(
            np.concatenate([h for h, _ in held]), map(np.concatenate, zip(*(c for _, c in held))))
        columns = [c.astype(kind, copy=False) for c, kind in zip(columns, kinds)]
        for shard, at in hash_arrays.split(hashes, shards):
            yield pa.record_batch(
                [pa.array([shard], pa.int32()),
                 pa.array([hash_arrays.packed(hashes[at], [c[at] for c in columns])], pa.binary())],
                names=["shard", "piece"])

    held, size = [], 0
    for hashes, columns in gathered:
        held.append((hashes, columns))
        size += len(hashes)
        if size > most:
            yield from rows(held)
            held, size = [], 0
    if size:
        yield from rows(held)


def _by_shard(pieces: DataFrame, shards: int) -> DataFrame:
    return pieces.repartition(shards, "shard").sortWithinPartitions("shard")


def _shard_rows(batches):
    for batch in batches:
        yield from zip(batch.column(0).to_pylist(), batch.column(1).to_pylist())


def _times(counts: np.ndarray) -> list[int]:
    return np.bincount(np.minimum(counts, 5).astype(int), minlength=6)[1:5].tolist()


_TOTALS = "n1 long, n2 long, n3 long, n4 long, kinds long, total long"


def _totals(rows: list[list[int]]) -> pa.RecordBatch:
    return pa.record_batch([pa.array([int(r[i]) for r in rows], pa.int64()) for i in range(6)],
                           names=["n1", "n2", "n3", "n4", "kinds", "total"])


#: Spark's setting by which a query's shuffle files go when it ends.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def _sum(totals: DataFrame) -> list[int]:
    """The sums of the totals. The pieces behind them are stored by then, so that their
    shuffle's files go at once, not when the driver's memory is next collected."""
    conf = totals.sparkSession.conf
    before = conf.get(CLEANUP, None)
    conf.set(CLEANUP, "true")
    try:
        row = totals.agg(*(F.sum(c) for c in totals.columns)).first()
    finally:
        conf.unset(CLEANUP) if before is None else conf.set(CLEANUP, before)
    return [x or 0 for x in row]


def count(docs: DataFrame, order: int = 2) -> Model:
    """The model of the texts of ``docs(text)`` with grams of up to ``order`` (2 or more) words."""
    if order < 2:
        raise ValueError("the order is 2 or more")
    spark = docs.sparkSession
    folder = shared_folder(spark, "grams")
    texts = docs.select(F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    size = texts.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    shards = size // SHARD + 1

    def longest(batches):
        def gathered():
            for batch in batches:
                for grams, at, _ in _tokens(batch.column(0), order):
                    yield (found := np.unique(grams[-1][at], return_counts=True))[0], [found[1].astype(np.uint32)]

        yield from _pieces(gathered(), shards, ["<u4"], GATHERED)

    def store_longest(batches):
        for shard, hashes, (counts,) in hash_arrays.merged(_shard_rows(batches)):
            _store(folder, str(order), shard, hashes, {"token": counts})
            yield _totals([[*_times(counts), len(counts), counts.sum()]])

    found = _sum(_by_shard(
        texts.mapInArrow(longest, "shard int, piece binary"), shards).mapInArrow(store_longest, _TOTALS))
    tokens, taken = found[5], (discounts(*found[:4]),)
    for length in range(order - 1, 0, -1):
        found = _sum(_count_below(texts, folder, shards, order, length, taken[0]))
        taken = (discounts(*found[:4]), *taken)
    n1, n2, _, _, n_words, pairs = found
    freed = (taken[0].one * n1 + taken[0].two * n2 + taken[0].more * (n_words - n1 - n2)) / max(1, pairs)
    return Model(folder, shards, order, taken, tokens, n_words, pairs, freed)


def _count_below(
    texts: DataFrame, folder: str, shards: int, order: int, length: int, above: Discounts,
) -> DataFrame:
    """Store the grams of ``length`` words, from those of one more; totals of continuation counts."""
    longer = length + 1
    # Shares travel as short floats where grams are many: a sum of up to 2**23 is exact when rounded.
    share = "<f4" if length > 1 else "<f8"

    def shorter(batches):
        def gathered():
            for batch in batches:
                for grams, places, _ in _tokens(batch.column(0), order):
                    hashes, at = hash_arrays.distinct(grams[length][places])
                    found = _counts(folder, str(longer), shards, hashes,
                                    ("token",) if longer == order else ("token", "second"))
                    each = (1 / found["token"])[at]  # an occurrence's share of its gram
                    n = found["token" if longer == order else "second"][at]
                    kinds, second, first = _grams(grams[length - 1], places)
                    k = len(kinds)
                    yield kinds, [
                        np.bincount(second, minlength=k).astype(np.uint32),
                        np.bincount(first, n * each, k), np.bincount(first, (n == 1) * each, k),
                        np.bincount(first, (n == 2) * each, k), np.bincount(first, (n > 2) * each, k),
                        np.bincount(second, each, k)]

        yield from _pieces(gathered(), shards, ["<u4", *[share] * 5], GATHERED // 2)

    def store_shorter(batches):
        for shard, hashes, (token, *sums) in hash_arrays.merged(_shard_rows(batches)):
            context, ones, twos, more, second = map(np.rint, sums)
            freed = above.one * ones + above.two * twos + above.more * more
            second = second.astype(np.int64)
            _store(folder, str(length), shard, hashes,
                   {"token": token, "context": context.astype(np.int64), "second": second},
                   freed=(freed / np.maximum(context, 1)).astype("<f8"))
            yield _totals([[*_times(second), (token > 0).sum(), second.sum()]])

    return _by_shard(
        texts.mapInArrow(shorter, "shard int, piece binary"), shards).mapInArrow(store_shorter, _TOTALS)


def token_scores(
    model: Model, grams: list[np.ndarray], at: np.ndarray,
) -> tuple[np.ndarray, np.ndarray]:
    """Probability of each token after its context, and its count in training; ``grams``
    end at each place of a block, ``at`` are the places of its tokens."""
    for length in range(1, model.order + 1):
        if length > 1:
            total, left = found["context"][u], found["freed"][u]
        if length < model.order:
            kinds, w, u = _grams(grams[length - 1], at)
            found = _counts(model.folder, str(length), model.shards, kinds, COUNTS,
                            model.discounts[length].one)
            n = found["second"]
        else:
            kinds, w = hash_arrays.distinct(grams[-1][at])
            n = _counts(model.folder, str(length), model.shards, kinds, ("token",))["token"]
        n = (n - model.discounts[length - 1].of(n))[w]
        if length == 1:
            known = found["token"][w]
            p = n / max(1, model.pairs) + model.freed / (model.words + 1)
        else:
            p = np.where(total > 0, n / np.maximum(total, 1) + left * p, p)
    return p, known


def score(docs: DataFrame, model: Model, held_out: Column) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score of every text."""
    def read(batches):
        for batch in batches:
            n = batch.num_rows
            sums = [np.zeros(n) for _ in range(4)]
            for grams, at, row in _tokens(batch.column(2), model.order):
                if model.tokens:
                    p, known = token_scores(model, grams, at)
                else:
                    p, known = np.ones(len(row)), np.zeros(len(row), np.int64)
                base = np.log10((known + 1) / (model.tokens + model.words + 1))
                for total, values in zip(sums, (np.ones(len(row)), known > 0, base, np.log10(p))):
                    total += np.bincount(row, values, n)
            yield pa.record_batch(
                [batch.column(0), batch.column(1), *(pa.array(x.astype(np.int64)) for x in sums[:2]),
                 pa.array(np.full(n, model.tokens, np.int64)), *map(pa.array, sums[2:])],
                names=["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"])

    return docs.select(
        F.col("doc_id").cast("long"), held_out.alias("held_out"),
        F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"),
    ).mapInArrow(read, """doc_id long, held_out boolean, n_tokens long, n_known long,
        train_tokens long, base_score double, score double""")
