"""SimHash fingerprints and exact near-duplicate classes by tiled comparison.

A text's fingerprint sums the bits of the hashes of its word shingles. Distinct
fingerprints are sorted by the population counts of their four 16-bit quarters and
cut into tiles of equal counts. Two fingerprints that differ in at most ``radius``
bits have counts whose differences add up to at most ``radius``, so only such tile
pairs meet, by an equi-join on the counts; each is compared exactly, with numpy's
exclusive-or and bit counts. A tile pair returns no more links than it has
fingerprints (a spanning forest of its links), and the links' connected
components are the classes.

Results in special cases: a null or empty text, or one without a word, has
fingerprint 0 and is linked like any other; rows that repeat a doc_id are rows of
their own; a class whose rows have no doc_id has a null component_id; an empty
table gives an empty table; other columns are ignored.
"""

from __future__ import annotations

import itertools

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from faultlens.llm.components import LEAST_HOT, SHARE, components
from faultlens.llm.storage import written
from faultlens.llm.words import texts_of, word_blocks

#: Fingerprints of a tile.
TILE = 1024
SEED = 42


def _bit_counts(hashes: np.ndarray) -> np.ndarray:
    """How often each of the 64 bits is set, lowest first."""
    bits = np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    return bits.sum(axis=0, dtype=np.int64)


def fingerprint(text: bytes, shingle: int = 4) -> int:
    """Unsigned 64-bit SimHash of the words of a text (UTF-8)."""
    from xxhash import xxh64_intdigest

    counts, n, tail, last = np.zeros(64, np.int64), 0, [], []
    for words in word_blocks(text.lower()):
        last = words = tail + words
        if len(words) < shingle:
            tail = words
            continue
        tail = words[len(words) - shingle + 1:]
        joined = b" ".join(words)
        ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
        starts = np.concatenate(([0], ends[:-1] + 1))
        spans = zip(starts[:len(words) - shingle + 1].tolist(), ends[shingle - 1:].tolist())
        hashes = np.fromiter(
            (xxh64_intdigest(joined[a:b], SEED) for a, b in spans), np.uint64,
            len(words) - shingle + 1)
        for low in range(0, len(hashes), 1 << 16):
            counts += _bit_counts(hashes[low:low + (1 << 16)])
        n += len(hashes)
    if not n:
        return xxh64_intdigest(b" ".join(last), SEED) if last else 0
    return int(np.packbits(counts * 2 > n, bitorder="little").view(np.uint64)[0])


def fingerprints(docs: DataFrame, shingle: int = 4) -> DataFrame:
    """doc_id and fingerprint (a signed long) of ``docs(doc_id, text)``, and the text's hash."""

    def hashed(batches):
        for batch in batches:
            found = [fingerprint(t, shingle) for t in texts_of(batch.column(1))]
            yield pa.record_batch(
                [batch.column(0), pa.array(np.array(found, np.uint64).view(np.int64)), batch.column(2)],
                names=["doc_id", "fingerprint", "text_hash"])

    return docs.select(
        F.col("doc_id").cast("long"), F.col("text").cast("string"),
        F.xxhash64(F.coalesce("text", F.lit(""))).alias("text_hash"),
    ).mapInArrow(hashed, "doc_id long, fingerprint long, text_hash long")


def _quarters(fingerprint_: Column) -> list[Column]:
    return [F.bit_count(F.shiftrightunsigned(fingerprint_, 16 * i).bitwiseAND(F.lit(0xFFFF)))
            for i in range(4)]


#: A cell is the four quarters' counts (0 to 16 each) as digits to this base.
BASE = 17


def _near_cells(radius: int) -> np.ndarray:
    """Differences of counts that add up to ``radius`` at most; of two opposites, one."""
    steps = [d for d in itertools.product(range(-radius, radius + 1), repeat=4)
             if sum(map(abs, d)) <= radius and d >= (0, 0, 0, 0)]
    return np.array(steps)


def _tiles(prints: DataFrame, radius: int) -> DataFrame:
    """Tiles of the distinct ``prints(fingerprint)``: cell, first, near (cells), tile (bytes)."""
    cell = F.lit(0)
    for quarter in _quarters(F.col("fingerprint")):
        cell = cell * BASE + quarter
    order = [F.col("cell"), F.col("fingerprint")]
    steps = _near_cells(radius)

    def cut(batches):
        def tile(cell_, values):
            digits = np.array([cell_ // BASE**i % BASE for i in (3, 2, 1, 0)]) + steps
            near = digits[((digits >= 0) & (digits < BASE)).all(axis=1)] @ [BASE**3, BASE**2, BASE, 1]
            return cell_, int(values[0]), near.astype(np.int32), values.tobytes()

        def rows(tiles):
            return pa.record_batch(
                [pa.array(c, t) for c, t in zip(list(zip(*tiles)) or [()] * 4, (
                    pa.int32(), pa.int64(), pa.list_(pa.int32()), pa.binary()))],
                names=["cell", "first", "near", "tile"])

        # Rows come sorted by cell: a tile is done when the cell changes or it is full.
        kept, held = None, np.zeros(0, np.int64)
        for batch in batches:
            cells, values = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            done = []
            for part, of in zip(np.split(values, np.flatnonzero(np.diff(cells)) + 1),
                                cells[np.r_[True, np.diff(cells) != 0]] if len(cells) else ()):
                if of != kept and len(held):
                    done.append(tile(kept, held))
                    held = held[:0]
                kept, held = int(of), np.concatenate((held, part))
                while len(held) >= TILE:
                    done.append(tile(kept, held[:TILE]))
                    held = held[TILE:]
            yield rows(done)
        if len(held):
            yield rows([tile(kept, held)])

    return (
        prints.select(cell.cast("int").alias("cell"), "fingerprint")
        .repartitionByRange(*order).sortWithinPartitions(*order)
        .mapInArrow(cut, "cell int, first long, near array<int>, tile binary")
    )


def _forest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A few links that connect what the links (a[i], b[i]) connect."""
    nodes, ends = np.unique(np.concatenate((a, b)), return_inverse=True)
    left, right = ends[:len(a)], ends[len(a):]
    label = np.arange(len(nodes))
    while True:
        low = np.minimum(label[left], label[right])
        new = label.copy()
        np.minimum.at(new, left, low)
        np.minimum.at(new, right, low)
        new = new[new]
        if (new == label).all():
            break
        label = new
    moved = label != np.arange(len(nodes))
    return nodes[moved], nodes[label[moved]]


def _compare(radius: int):
    def links(batches):
        for batch in batches:
            found_a, found_b = [], []
            for raw_a, raw_b, same in zip(*(batch.column(i).to_pylist() for i in range(3))):
                a, b = np.frombuffer(raw_a, np.int64), np.frombuffer(raw_b, np.int64)
                i, j = np.nonzero(np.bitwise_count(a[:, None] ^ b[None, :]) <= radius)
                if same:
                    i, j = i[i < j], j[i < j]
                if len(i):
                    x, y = _forest(a[i], b[j])
                    found_a.append(x)
                    found_b.append(y)
            none = np.zeros(0, np.int64)
            yield pa.record_batch(
                [pa.array(np.concatenate([none, *found_a])), pa.array(np.concatenate([none, *found_b]))],
                names=["a", "b"])

    return links


def classes(prints: DataFrame, radius: int = 4) -> DataFrame:
    """fingerprint, class: distinct ``prints(fingerprint)`` and one fingerprint for each class."""
    tiles = written(_tiles(prints, radius), "simhash-tiles")
    left = tiles.select(F.explode("near").alias("cell"), F.col("cell").alias("own"),
                        F.col("first").alias("first_a"), F.col("tile").alias("tile_a"))
    right = tiles.select("cell", F.col("first").alias("first_b"), F.col("tile").alias("tile_b"))
    pairs = (
        left.join(right, "cell")
        .filter("own != cell or first_a <= first_b")
        .select("tile_a", "tile_b", F.expr("own = cell and first_a = first_b").alias("same"))
    )
    links = pairs.mapInArrow(_compare(radius), "a long, b long")
    found = components(written(links, "simhash-links"))
    return prints.join(
        found.withColumnRenamed("node", "fingerprint"), "fingerprint", "left"
    ).select("fingerprint", F.coalesce("root", "fingerprint").alias("class"))


def _with_least(of: DataFrame, smallest: DataFrame) -> DataFrame:
    """fingerprint, class, component_id: the smallest doc_id of each class, at its fingerprints.

    A class of very many fingerprints would fill one task of the join. There are at
    most ``SHARE`` that have over a SHARE-th of all, a table to broadcast.
    """
    bound = max(LEAST_HOT, of.count() // SHARE)
    least = written(of.join(smallest, "fingerprint").groupBy("class").agg(
        F.min("least").alias("component_id"), (F.count("*") > bound).alias("hot")), "simhash-least")
    hot = F.broadcast(least.filter("hot").drop("hot"))
    return of.join(hot, "class").unionByName(
        of.join(hot, "class", "left_anti").join(least.filter("not hot").drop("hot"), "class"))


def near_duplicates(docs: DataFrame, shingle: int = 4, radius: int = 4) -> DataFrame:
    """doc_id, fingerprint (long), text_hash, class (a fingerprint of it), component_id for
    each row of ``docs``."""
    prints = written(fingerprints(docs, shingle), "simhash-prints")
    smallest = written(
        prints.groupBy("fingerprint").agg(F.min("doc_id").alias("least")), "simhash-distinct")
    of = written(classes(smallest.select("fingerprint"), radius), "simhash-classes")
    return prints.join(_with_least(of, smallest), "fingerprint", "left")


def keep_one(docs: DataFrame, shingle: int = 4, radius: int = 4) -> DataFrame:
    """The rows of ``docs``, one of each class: that with the smallest doc_id.

    Rows without a doc_id stay only if their class has no other, one of them.
    """
    found = near_duplicates(docs, shingle, radius)
    kept = found.groupBy("class").agg(F.min(F.struct(
        F.col("doc_id").isNull().alias("nameless"), "doc_id", "text_hash")).alias("least")).select(
        F.col("least.doc_id").alias("kept_id"), F.col("least.text_hash").alias("kept_hash"))
    packed = docs.select(
        F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"),
        F.col("doc_id").cast("long").alias("kept_id"),
        F.xxhash64(F.coalesce("text", F.lit(""))).alias("kept_hash"))
    same = packed["kept_id"].eqNullSafe(kept["kept_id"]) & (packed["kept_hash"] == kept["kept_hash"])
    return (
        packed.join(kept, same, "left_semi")
        .dropDuplicates(["kept_id", "kept_hash"])
        .select("row.*")
    )
