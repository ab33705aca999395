"""Exact top-k search by inner product, block by block under upper bounds.

Vectors are sorted by the nearest of a few pivots and cut into blocks of
consecutive rows, and blocks into ranges. A block keeps its forward index (its
rows) and, per component, its largest and smallest value. A query's bound on a
block is the sum of its terms' maxima: each component times the value that gives
most. Blocks are scored in descending order of bound until the bound falls below
the k-th best score; an equal bound is still scored, as ties go to the smaller id.

A query first searches the range it lies in, which gives it a k-th score; with it,
the other ranges are searched in tiles of queries. Results are exact whatever the
pivots are: they come from a bounded sample and only decide what lies together.

Results in special cases: a vector that is null or holds a null or non-finite
component takes no part, nor does one with a null vec_id, or with a component so large
that scores of such vectors would not fit a long (over 370,000 at 64 components, by
the width of the longest vector); a shorter vector
counts as filled up with zeros; rows that repeat a vec_id are rows of their own, as
candidates and as queries, and a query's own row alone is left out; fewer candidates than k give all; other columns are
ignored.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from faultlens.llm.storage import written

#: Rows of a block, of a range, queries of a tile, and vectors that pivots are taken from.
BLOCK, RANGE, TILE, PIVOTS = 128, 8192, 4096, 64


def whole_vectors(table: DataFrame, scale: int = 1024) -> DataFrame:
    """vec_id, vector (array of long): floor(scale * x) of each component x."""
    width = table.agg(F.max(F.size("embedding"))).first()[0] or 0
    # The sum of ``width`` products of such numbers is below 2**63.
    largest = float(math.isqrt(((1 << 63) - 1) // max(1, width)) - 1)
    scaled = F.transform("embedding", lambda x: F.floor(F.lit(float(scale)) * x.cast("double")))
    fits = F.forall("embedding", lambda x: F.coalesce(
        ~F.isnan(x) & (F.abs(F.lit(float(scale)) * x.cast("double")) <= largest), F.lit(False)))
    return (
        table.select(F.col("vec_id").cast("long"), "embedding")
        .filter(F.col("vec_id").isNotNull() & F.col("embedding").isNotNull())
        .filter(fits)
        .select("vec_id", scaled.cast("array<long>").alias("vector"))
    )


def _matrix(vectors: list, width: int) -> np.ndarray:
    out = np.zeros((len(vectors), width), np.int64)
    for i, v in enumerate(vectors):
        out[i, :len(v)] = v
    return out


def _scores(rows: np.ndarray, queries: np.ndarray) -> np.ndarray:
    """Exact inner products; in doubles where every partial sum is a whole number below 2**53."""
    largest = float(np.abs(rows).max(initial=0)) * float(np.abs(queries).max(initial=0))
    if largest * max(1, rows.shape[1]) < 2**53:
        return (rows.astype(float) @ queries.astype(float).T).astype(np.int64)
    return rows @ queries.T


def _index(vectors: DataFrame, n: int, width: int, pivots: np.ndarray) -> DataFrame:
    """Blocks: range, ids, keys, rows, high, low (bytes of longs)."""

    @F.pandas_udf("int")
    def nearest(vector):
        import pandas as pd

        if not len(pivots):
            return pd.Series(np.zeros(len(vector), np.int32))
        rows = _matrix(list(vector), width).astype(float)
        far = (pivots**2).sum(axis=1)[None, :] - 2 * rows @ pivots.T
        return pd.Series(far.argmin(axis=1).astype(np.int32))

    def cut(batches):
        from pyspark import TaskContext

        here, done, ids, keys, rows = TaskContext.get().partitionId(), 0, [], [], []

        def take(k):
            nonlocal done
            block, of, by = _matrix(rows[:k], width), np.array(ids[:k], np.int64), np.array(keys[:k], np.int64)
            del ids[:k], keys[:k], rows[:k]
            number = here * (1 << 32) + done // RANGE
            done += k
            return pa.record_batch(
                [pa.array([number]), *(pa.array([x.tobytes()], pa.binary()) for x in (
                    of, by, block, block.max(axis=0), block.min(axis=0)))],
                names=["range", "ids", "keys", "rows", "high", "low"])

        for batch in batches:
            ids += batch.column(0).to_pylist()
            keys += batch.column(1).to_pylist()
            rows += batch.column(2).to_pylist()
            while len(ids) >= BLOCK:
                yield take(BLOCK)
        if ids:
            yield take(len(ids))

    placed = vectors.withColumn("pivot", nearest("vector"))
    return (
        placed.repartitionByRange(max(1, -(-n // RANGE)), "pivot", "vec_id", "key")
        .sortWithinPartitions("pivot", "vec_id", "key")
        .select("vec_id", "key", "vector")
        .mapInArrow(cut, "range long, ids binary, keys binary, rows binary, high binary, low binary")
    )


class _Best:
    """The k best (score, id, key) of one query, ties to the smaller id, then key."""

    def __init__(self, k: int, floor: int | None):
        self.k, self.floor = k, floor
        self.scores, self.ids, self.keys = (np.zeros(0, np.int64) for _ in range(3))

    @property
    def kth(self) -> int | None:
        own = int(self.scores[-1]) if len(self.scores) == self.k else None
        return max((x for x in (own, self.floor) if x is not None), default=None)

    def add(self, *found: np.ndarray) -> None:
        if self.kth is not None:
            enough = found[0] >= self.kth
            found = [x[enough] for x in found]
        if not len(found[0]):
            return
        scores, ids, keys = (np.concatenate(x) for x in zip((self.scores, self.ids, self.keys), found))
        best = np.lexsort((keys, ids, -scores))[:self.k]
        self.scores, self.ids, self.keys = scores[best], ids[best], keys[best]


def _search(blocks, queries, k: int, width: int):
    """(query_key, query_id, vec_id, key, score) from the blocks of a range for
    (key, id, vector, kth so far)."""
    decoded = []
    for ids, keys, rows, high, low in blocks:
        of = np.frombuffer(ids, np.int64)
        decoded.append((of, np.frombuffer(keys, np.int64), np.frombuffer(rows, np.int64).reshape(len(of), width),
                        np.frombuffer(high, np.int64), np.frombuffer(low, np.int64)))
    high, low = (np.stack([d[i] for d in decoded]) for i in (3, 4))
    out = []
    for query_key, query_id, vector, floor in queries:
        q = _matrix([vector], width)
        bounds = (_scores(high, np.maximum(q, 0)) + _scores(low, np.minimum(q, 0)))[:, 0]
        best = _Best(k, floor)
        for b in np.argsort(-bounds):
            if best.kth is not None and bounds[b] < best.kth:
                break
            ids, keys, rows = decoded[b][:3]
            scores = _scores(rows, q)[:, 0]
            other = keys != query_key
            best.add(scores[other], ids[other], keys[other])
        out += [(query_key, query_id, int(i), int(j), int(s))
                for i, j, s in zip(best.ids, best.keys, best.scores)]
    return out


FOUND = ("query_key", "query_id", "vec_id", "key", "score")


def _found(rows):
    import pandas as pd

    return pd.DataFrame(
        {name: pd.Series([r[i] for r in rows], dtype="int64")
         for i, name in enumerate(FOUND)})


def _best(found: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("query_key").orderBy(F.col("score").desc(), "vec_id", "key")
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def search(vectors: DataFrame, is_query: Column, k: int = 10) -> DataFrame:
    """query_id, rank, vec_id, score: the k best other rows of each query among ``vectors``.

    ``is_query`` is a condition on ``vectors(vec_id, vector)``; each row has a key of its own.
    """
    vectors = written(vectors.withColumn("key", F.monotonically_increasing_id()), "topk-vectors")
    size = vectors.agg(F.count("*").alias("n"), F.max(F.size("vector")).alias("width")).first()
    n, width = size["n"], size["width"] or 0
    sample = vectors.orderBy(F.xxhash64("vec_id"), "key").limit(PIVOTS).collect()
    pivots = _matrix([r["vector"] for r in sample], width).astype(float)
    blocks = written(_index(vectors, n, width, pivots), "topk-blocks")
    queries = vectors.filter(is_query)

    def at_home(left, right):
        own = [(j, i, v, None) for j, i, v in zip(right["key"], right["vec_id"], right["vector"])]
        rows = left[["ids", "keys", "rows", "high", "low"]].itertuples(index=False)
        return _found(_search(rows, own, k, width) if len(left) else [])

    def away(left, right):
        own = list(zip(right["key"], right["vec_id"], right["vector"], map(int, right["kth"])))
        rows = left[["ids", "keys", "rows", "high", "low"]].itertuples(index=False)
        return _found(_search(rows, own, k, width) if len(left) else [])

    # Where each query lies.
    @F.pandas_udf("array<long>")
    def unpacked(raw):
        return raw.map(lambda x: np.frombuffer(x, np.int64).tolist())

    homes = blocks.select("range", F.explode(unpacked("keys")).alias("key"))
    placed = queries.join(homes, "key").withColumnRenamed("range", "home")
    schema = ", ".join(f"{name} long" for name in FOUND)
    near = written(
        blocks.groupBy("range").cogroup(placed.groupBy("home")).applyInPandas(at_home, schema),
        "topk-near")
    kth = near.groupBy("query_key").agg(
        F.min("score").alias("least"), F.count("*").alias("n")).select(
        F.col("query_key").alias("key"), F.when(F.col("n") >= k, F.col("least")).alias("kth"))
    tiles = max(1, -(-n // (100 * TILE)))
    # The query set against all ranges, tile by tile.
    tile = F.explode(F.sequence(F.lit(0), F.lit(tiles - 1)))
    tiled = (
        placed.join(kth, "key", "left")
        .withColumn("kth", F.coalesce("kth", F.lit(-(1 << 63))))
        .withColumn("tile", F.pmod(F.xxhash64("key"), F.lit(tiles)).cast("int"))
        .join(blocks.select("range").distinct().withColumn("tile", tile), "tile")
        .filter("range != home")
    )
    copies = blocks.withColumn("tile", tile)
    far = copies.groupBy("range", "tile").cogroup(
        tiled.groupBy("range", "tile")).applyInPandas(away, schema)
    return _best(near.union(far), k).select(
        "query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
