"""Prefix trie of conversations, by range minima over sorted common-prefix lengths.

A conversation becomes the digests of its turns laid end to end, and conversations are
sorted by them. Members of a prefix then stand together: they reach from the
conversation at hand as far as the lengths common to neighbours (LCPs) do not fall
below the prefix's length. A sparse table holds the minimum of the LCPs over every
stretch of a power of two, so each candidate prefix (any depth of any conversation)
finds the left and the right end of its interval by two binary searches that depend
on no other candidate; there is no stack and no order of visits. Everything else
follows from intervals: members are their length, the smallest member a range
minimum, and what is summed over a subtree a difference of prefix sums, since the
nodes below a node are those that begin in its interval.

Sorted conversations are range partitioned and cut into blocks of about ``WEIGHT``
turns. A node that touches neither end of its block is whole there; the others are at
most twice a path a block. Those are put together by the digest of their prefix
(members added, smallest member, longest conversation), go back to the blocks that hold
a part of them, and their sums are added up. So a turn that opens a third of all
conversations, or a conversation repeated as often, is spread over blocks, and a task
sees one block.

The list of conversations that end at a node is hashed from one string a block, in order,
with one string in memory: SHA-256 can't be parted further.

Results in special cases: null role or text is empty; null turns come first; rows of a
conversation with one turn number stand in the order of their digests, repeated rows
count twice; rows without a conv_id belong to no conversation and are left out; a conversation
may be without turns once rebuilt, and is then a member of the root alone; long texts are
hashed by Spark and only their digest goes on; a conversation's digests (24 bytes a
turn) are held by one task; an empty table gives an empty table, without a root; other
columns are ignored.
"""

from __future__ import annotations

from hashlib import sha256

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from faultlens.llm.storage import shared_folder, written

#: Turns (and conversations) of a block.
WEIGHT = 1 << 16
#: Bytes of a turn's digest.
TURN = 16
#: A node's row goes back to many blocks in so many lots.
LOTS = 16
EMPTY = sha256().hexdigest()

SORTED = "part int, block int, conv_id long, path binary, sizes array<long>"
PARTIAL = "key binary, part int, block int, n long, least long, more boolean"
FOUND = """key binary, part int, block int, conv_id long, depth long, parent_conv_id long, n_convs long,
n_children long, n_leaves long, saved_tokens long, ends_sha256 string, ends string"""


def heads_kept(conv_id: Column) -> Column:
    """How many turns a conversation takes from the first of its five."""
    return (F.crc32(conv_id.cast("string").cast("binary")) % 9).cast("int")


def turns_of(conversations: DataFrame) -> DataFrame:
    """conv_id and its turns in order, as structs of digest (hex) and size of the text."""
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("role", "text"))
    digest = F.sha2(F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text), 256)
    turn = F.struct(
        F.col("turn").isNotNull().alias("given"), F.col("turn").alias("turn"),
        F.substring(digest, 1, 2 * TURN).alias("digest"), F.octet_length(text).cast("long").alias("size"))
    return (
        conversations.filter(F.col("conv_id").isNotNull())
        .select(F.col("conv_id").cast("long").alias("conv_id"), turn.alias("turn"))
        .groupBy("conv_id").agg(F.sort_array(F.collect_list("turn")).alias("turns"))
        .select("conv_id", F.transform("turns", lambda t: F.struct(t["digest"], t["size"])).alias("turns"))
    )


def rebuilt(turns: DataFrame, kept: Column, first: Column) -> DataFrame:
    """Every conversation with the first ``kept`` turns of conversation ``first`` in place of its own."""
    nothing = F.array().cast(turns.schema["turns"].dataType)
    heads = turns.join(
        turns.select(first.alias("_head")).distinct(), F.col("conv_id") == F.col("_head"), "left_semi"
    ).select(F.col("conv_id").alias("_head"), F.col("turns").alias("_turns"))
    own = F.slice("turns", kept + 1, F.greatest(F.size("turns"), F.lit(1)))
    return turns.withColumn("_head", first).join(heads, "_head", "left").select(
        "conv_id", F.concat(F.slice(F.coalesce("_turns", nothing), F.lit(1), kept), own).alias("turns"))


class _Block:
    """Intervals of all prefixes of a block of sorted conversations."""

    def __init__(self, table: pa.Table):
        self.paths = table.column("path").to_pylist()
        self.ids = table.column("conv_id").to_numpy()
        self.n = n = len(self.paths)
        self.lengths = np.array([len(p) // TURN for p in self.paths], np.int64)
        sizes = table.column("sizes").to_pylist()
        #: Candidates: depth 0 to all of each conversation, conversation by conversation.
        self.first = np.cumsum(self.lengths + 1) - (self.lengths + 1)
        self.row = np.repeat(np.arange(n), self.lengths + 1)
        self.depth = np.arange(len(self.row)) - self.first[self.row]
        self.size = np.array([x for s in sizes for x in (0, *s)], np.int64)
        self.low = self._levels(self._common(), np.minimum)
        self.left, self.right = self._extents()
        self.node = self.first[self.left] + self.depth
        self.is_node = self.left == self.row

    def _common(self) -> np.ndarray:
        """Turns that each conversation begins with in common with the one before; 0 for the first."""
        flat = np.frombuffer(b"".join(self.paths), "<u8").reshape(-1, 2)
        begin = np.cumsum(self.lengths) - self.lengths
        common = np.zeros(self.n, np.int64)
        common[1:] = np.minimum(self.lengths[1:], self.lengths[:-1])
        row = np.repeat(np.arange(self.n), common)
        step = np.arange(len(row)) - np.repeat(np.cumsum(common) - common, common)
        here, before = flat[begin[row] + step], flat[begin[np.maximum(row, 1) - 1] + step]
        apart = np.flatnonzero((here != before).any(axis=1))
        rows, at = np.unique(row[apart], return_index=True)
        common[rows] = step[apart[at]]
        return common

    @staticmethod
    def _levels(values: np.ndarray, best) -> list[np.ndarray]:
        """Sparse table: level k has the best over 2**k values from each place."""
        levels = [values]
        while 2 << len(levels) - 1 <= len(values):
            last, half = levels[-1], 1 << len(levels) - 1
            levels.append(best(last[:len(last) - half], last[half:]))
        return levels

    def _extents(self) -> tuple[np.ndarray, np.ndarray]:
        """Ends of each candidate's interval, each by a binary search of its own."""
        left, right = self.row.copy(), self.row.copy()
        for k in reversed(range(len(self.low))):
            level, step = self.low[k], 1 << k
            # The LCPs at right + 1 ... right + step.
            fits = np.flatnonzero(right + step < self.n)
            go = fits[level[right[fits] + 1] >= self.depth[fits]]
            right[go] += step
            # The LCPs at left - step + 1 ... left.
            fits = np.flatnonzero(left - step >= 0)
            go = fits[level[left[fits] - step + 1] >= self.depth[fits]]
            left[go] -= step
        return left, right

    def over(self, levels: list[np.ndarray], best, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Range minimum or maximum, from the two stretches that cover a range."""
        k = np.frexp((right - left + 1).astype(np.float64))[1] - 1
        out = np.empty(len(left), np.int64)
        for level in np.unique(k):
            at = np.flatnonzero(k == level)
            x = levels[level]
            out[at] = best(x[left[at]], x[right[at] - (1 << int(level)) + 1])
        return out

    def summary(self, nodes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Members, smallest member, and whether a member goes on, of nodes in this block."""
        left, right = self.left[nodes], self.right[nodes]
        least = self.over(self._levels(self.ids, np.minimum), np.minimum, left, right)
        longest = self.over(self._levels(self.lengths, np.maximum), np.maximum, left, right)
        return right - left + 1, least, longest > self.depth[nodes]

    def at_an_end(self) -> tuple[np.ndarray, list[bytes]]:
        """Nodes that touch an end of the block, with their keys: digests of their prefixes."""
        nodes = np.flatnonzero(self.is_node & ((self.left == 0) | (self.right == self.n - 1)))
        keys: dict[tuple[int, int], bytes] = {}
        for row in {0, self.n - 1}:
            running, path = sha256(), self.paths[row]
            for d in range(self.lengths[row] + 1):
                keys[int(self.left[self.first[row] + d]), d] = running.copy().digest()
                running.update(path[d * TURN:(d + 1) * TURN])
        return nodes, [keys[int(self.left[x]), int(self.depth[x])] for x in nodes]


def _in_order(table: pa.Table) -> pa.Table:
    return table.sort_by([("path", "ascending"), ("conv_id", "ascending")])


def _open_nodes(table: pa.Table) -> pa.Table:
    """The parts of nodes that may go on in other blocks."""
    part, block = (table.column(c)[0].as_py() for c in ("part", "block"))
    here = _Block(_in_order(table))
    nodes, keys = here.at_an_end()
    n, least, more = here.summary(nodes)
    return pa.table({
        "key": pa.array(keys, pa.binary()), "part": pa.array([part] * len(nodes), pa.int32()),
        "block": pa.array([block] * len(nodes), pa.int32()), "n": n, "least": least, "more": more})


def _finished(table: pa.Table, known: pa.Table) -> pa.Table:
    """Whole nodes of a block, and the block's share of the others (with ``key``)."""
    part, block = (table.column(c)[0].as_py() for c in ("part", "block"))
    here = _Block(_in_order(table))
    nodes = np.flatnonzero(here.is_node)
    place = np.full(len(here.row), -1)
    place[nodes] = np.arange(len(nodes))
    n, least, more = here.summary(nodes)
    begins = np.ones(len(nodes), bool)
    ends, keys = here.at_an_end()
    of = {row["key"]: row for row in known.to_pylist()}
    open_key: list[bytes | None] = [None] * len(nodes)
    for x, key in zip(place[ends].tolist(), keys):
        row = of[key]
        open_key[x] = key
        n[x], least[x], more[x] = row["n"], row["least"], row["more"]
        begins[x] = (row["first"]["part"], row["first"]["block"]) == (part, block)

    size = here.size[nodes]
    # Sums over the candidates in order: a subtree is the stretch from a node to the last
    # candidate of its interval.
    def below(values: np.ndarray) -> np.ndarray:
        sums = np.zeros(len(here.row) + 1, np.int64)
        sums[nodes + 1] = np.where(begins, values, 0)
        sums = np.cumsum(sums)
        last = here.right[nodes]
        return sums[here.first[last] + here.lengths[last] + 1] - sums[nodes]

    leaves, saved = below((~more).astype(np.int64)), below((n - 1) * size)
    inner = here.depth[nodes] > 0
    parent = place[here.node[nodes[inner] - 1]]
    children = np.bincount(parent[begins[inner]], minlength=len(nodes))
    above = np.full(len(nodes), -1)
    above[inner] = parent
    # Members that end at a node stand at the left end of its interval.
    place_of_row = place[here.node[here.first + here.lengths]]
    ends_of: list[list[int]] = [[] for _ in range(len(nodes))]
    for x, conv in zip(place_of_row.tolist(), here.ids.tolist()):
        ends_of[x].append(conv)
    listed = [",".join(map(str, e)) for e in ends_of]
    whole = [k is None for k in open_key]
    return pa.table({
        "key": pa.array(open_key, pa.binary()),
        "part": pa.array([part] * len(nodes), pa.int32()), "block": pa.array([block] * len(nodes), pa.int32()),
        "conv_id": least, "depth": here.depth[nodes],
        "parent_conv_id": pa.array([int(least[x]) if x >= 0 else None for x in above], pa.int64()),
        "n_convs": n, "n_children": children, "n_leaves": leaves, "saved_tokens": saved,
        "ends_sha256": pa.array([sha256(e.encode()).hexdigest() if w else None for e, w in zip(listed, whole)],
                                pa.string()),
        "ends": pa.array([None if w or not e else e for e, w in zip(listed, whole)], pa.string())})


def _cut(weight: int):
    """Sorted rows of a partition with the number of their block."""
    def run(batches):
        from pyspark import TaskContext

        part, total = TaskContext.get().partitionId(), 0
        for batch in batches:
            lengths = np.array([len(x) for x in batch.column(2).to_pylist()], np.int64) + 1
            before = total + np.cumsum(lengths) - lengths
            total += int(lengths.sum())
            yield pa.record_batch(
                [pa.array([part] * len(batch), pa.int32()), pa.array((before // weight).astype(np.int32)),
                 *(batch.column(i) for i in range(3))], ["part", "block", "conv_id", "path", "sizes"])

    return run


def _hashed(batches):
    """key and ends_sha256, from a partition's strings in order of key and block."""
    key, running, some = None, None, False
    for batch in batches:
        out = []
        for k, ends in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            if k != key:
                if some:
                    out.append((key, running.hexdigest()))
                key, running, some = k, sha256(), True
            else:
                running.update(b",")
            running.update(ends.encode())
        yield _pairs(out)
    if some:
        yield _pairs([(key, running.hexdigest())])


def _pairs(rows) -> pa.RecordBatch:
    return pa.record_batch([pa.array([r[0] for r in rows], pa.binary()),
                            pa.array([r[1] for r in rows], pa.string())], ["key", "ends_sha256"])


def trie(turns: DataFrame, weight: int = WEIGHT) -> DataFrame:
    """One row per node of the trie of ``turns(conv_id, turns)``, see ``turns_of``."""
    spark = turns.sparkSession
    shared_folder(spark, "trie")
    ranges = int(spark.conf.get("spark.sql.shuffle.partitions"))
    path = F.unhex(F.array_join(F.transform("turns", lambda t: t["digest"]), "")).alias("path")
    ordered = written(
        turns.select("conv_id", path, F.transform("turns", lambda t: t["size"]).alias("sizes"))
        .repartitionByRange(ranges, "path", "conv_id").sortWithinPartitions("path", "conv_id")
        .mapInArrow(_cut(weight), SORTED), "trie-sorted")
    blocks = ordered.groupBy("part", "block")
    partial = written(blocks.applyInArrow(_open_nodes, PARTIAL), "trie-open")
    # Each node that may lie in several blocks, whole, and back in every block.
    merged = partial.groupBy("key").agg(
        F.sum("n").alias("n"), F.min("least").alias("least"), F.bool_or("more").alias("more"),
        F.min(F.struct("part", "block")).alias("first"))
    lot = F.pmod(F.hash("part", "block"), F.lit(LOTS))
    back = partial.select("key", "part", "block", lot.alias("lot")).join(
        merged.withColumn("lot", F.explode(F.sequence(F.lit(0), F.lit(LOTS - 1)))), ["key", "lot"]).drop("lot")
    found = written(
        blocks.cogroup(back.groupBy("part", "block")).applyInArrow(_finished, FOUND), "trie-found")
    columns = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens"]
    whole = found.filter(F.col("key").isNull()).select(*columns, "ends_sha256")
    shares = found.filter(F.col("key").isNotNull())
    hashes = (
        shares.filter(F.col("ends").isNotNull()).select("key", "ends", "part", "block")
        .repartition("key").sortWithinPartitions("key", "part", "block").select("key", "ends")
        .mapInArrow(_hashed, "key binary, ends_sha256 string"))
    several = (
        shares.groupBy("key", "conv_id", "depth", "parent_conv_id", "n_convs")
        .agg(*(F.sum(c).alias(c) for c in columns[4:]))
        .join(hashes, "key", "left")
        .select(*columns, F.coalesce("ends_sha256", F.lit(EMPTY)).alias("ends_sha256")))
    return whole.unionByName(several)


def conversation_trie(conversations: DataFrame, group: int = 5, weight: int = WEIGHT) -> DataFrame:
    """The trie of all conversations, each rebuilt on the first turns of its group's first."""
    conv = F.col("conv_id")
    return trie(rebuilt(written(turns_of(conversations), "trie-turns"), heads_kept(conv), conv - conv % group),
                weight)
