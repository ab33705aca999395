"""A Merkle manifest of a table, by time-forward processing.

A node may be computed once its children are. Nodes are labelled by (last leaf below
them, level), so children come before parents, and a sweep in order of the labels
takes from a priority queue what was sent to the node at hand, hashes it, and sends
the digest on, addressed to the parent's label. A second sweep in the reversed order
sends proofs down: a node receives the siblings of its ancestors and passes them on
to each child, with that child's own siblings in front.

The queue is external. A sweep runs in chunks of ``ARITY ** RISE`` consecutive leaves;
what leaves a chunk, one digest upwards or one proof downwards, is a row of a written
table that Spark sorts to the chunk it is addressed to. Within a chunk the queue holds
at most ``ARITY`` messages a level. So no task sees more than a chunk, however many
leaves a language has, and the rounds number the logarithm of the table to the
base ``ARITY ** RISE``.

Results in special cases: a null field is written ``-``; a null doc_id comes first and
is not tampered with; rows that repeat a doc_id are leaves of their own, in the order
of their digests; a null lang is a language; an empty text has length 0; texts of any
length are hashed whole by Spark; an empty table gives an empty table; other columns
are ignored. Languages are numbered in one task, which sees one row for each.
"""

from __future__ import annotations

import heapq
from hashlib import sha256

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from faultlens.llm.storage import written

#: Children of a node, and levels that a chunk rises in one round.
ARITY, RISE = 8, 4

HEX = 64
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

NODES = "tree int, at long, n long, digest string"
PATHS = "tree int, at long, subroot string, path array<struct<siblings: string, place: int>>"


def digest_of(*inputs: str) -> str:
    return sha256("".join(inputs).encode()).hexdigest()


def depth_of(n: int, arity: int = ARITY) -> int:
    """Levels above ``n`` leaves."""
    depth = 0
    while arity ** depth < n:
        depth += 1
    return depth


def sweep_up(leaves: list[str], levels: int, arity: int = ARITY) -> list[list[str]]:
    """Digests of all nodes over consecutive leaves, by level from the leaves up."""
    nodes: list[list[str]] = [leaves, *([] for _ in range(levels))]
    queue: list[tuple[int, int, int, str]] = []  # (last leaf, level) of the receiver, place, digest
    last = len(leaves) - 1

    def send(level: int, place: int, digest: str) -> None:
        if level < levels:
            end = min((place // arity + 1) * arity ** (level + 1) - 1, last)
            heapq.heappush(queue, (end, level + 1, place, digest))

    for leaf, digest in enumerate(leaves):
        send(0, leaf, digest)
        while queue and queue[0][0] == leaf:
            end, level = queue[0][:2]
            inbox = []
            while queue and queue[0][:2] == (end, level):
                inbox.append(heapq.heappop(queue)[3])
            value = digest_of(*inbox)
            nodes[level].append(value)
            send(level, len(nodes[level]) - 1, value)
    return nodes


Path = tuple[tuple[str, int], ...]


def sweep_down(nodes: list[list[str]], path: Path, arity: int = ARITY) -> list[Path]:
    """Each leaf's path of (siblings, place among them) up to the root, from ``path``,
    that of the top node."""
    levels, last = len(nodes) - 1, len(nodes[0]) - 1
    found: list[Path] = [()] * len(nodes[0])
    queue: list[tuple[int, int, int, Path]] = [(-last, -levels, 0, path)]
    while queue:
        _, level, place, own = heapq.heappop(queue)
        if not level:
            found[place] = own
            continue
        below = -level - 1
        first = place * arity
        run = "".join(nodes[below][first:first + arity])
        for i in range(len(run) // HEX):
            end = min((first + i + 1) * arity ** below - 1, last)
            siblings = run[:i * HEX] + run[(i + 1) * HEX:]
            heapq.heappush(queue, (-end, -below, first + i, ((siblings, i), *own)))
    return found


def fold(leaf: str, path: Path) -> str:
    """The root that a leaf and its proof lead to."""
    for siblings, place in path:
        leaf = digest_of(siblings[:place * HEX], leaf, siblings[place * HEX:])
    return leaf


def _field(value: Column) -> Column:
    value = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(value).cast("string"), F.lit(":"), value), F.lit("-"))


def leaves_of(docs: DataFrame) -> DataFrame:
    """doc_id, lang, leaf, and ``altered``: the leaf of a row that is tampered with, else null."""
    rest = [_field(F.col(c)) for c in ("doc_id", "source", "lang", "n_chars")]
    text = F.col("text").cast("string")
    chosen = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 0
    return docs.select(
        "doc_id", "lang", F.sha2(F.concat(*rest, _field(text)), 256).alias("leaf"),
        F.when(chosen, F.sha2(F.concat(*rest, _field(F.translate(text, UPPER, LOWER))), 256))
        .alias("altered"))


def _numbered(leaves: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Leaves with the number of their language's tree and their place in it; trees with their size.

    Rows are range partitioned and written in order; a row's place is its place in its
    partition, plus the rows of its language in earlier ones.
    """
    order = [F.col("lang").asc_nulls_first(), F.col("doc_id").asc_nulls_first(), F.col("leaf"), F.col("id")]
    given = written(leaves.withColumn("id", F.monotonically_increasing_id()), "merkle-leaves")
    ranges = int(leaves.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    inside = F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))
    ordered = written(
        given.repartitionByRange(ranges, *order).sortWithinPartitions(*order)
        .select("lang", "doc_id", "leaf", "altered", F.spark_partition_id().alias("part"),
                inside.alias("inside")), "merkle-ordered")
    counts = ordered.groupBy("part", "lang").agg(F.count("*").alias("rows"), F.min("inside").alias("first"))
    earlier = Window.partitionBy("lang").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select(
        "part", "lang", (F.coalesce(F.sum("rows").over(earlier), F.lit(0)) - F.col("first")).alias("offset"))
    trees = written(
        counts.groupBy("lang").agg(F.sum("rows").alias("n"))
        .withColumn("tree", F.row_number().over(Window.orderBy(F.col("lang").asc_nulls_first())) - 1),
        "merkle-trees")
    known = offsets.withColumnRenamed("lang", "_lang").join(
        trees, F.col("_lang").eqNullSafe(F.col("lang"))).select(
        F.col("part").alias("_part"), "_lang", "offset", "n", "tree")
    placed = ordered.join(
        known, (F.col("part") == F.col("_part")) & F.col("lang").eqNullSafe(F.col("_lang")))
    return placed.select(
        "tree", (F.col("inside") + F.col("offset")).alias("at"), "n", F.col("leaf").alias("digest"),
        "altered", "doc_id"), trees


def _chunks(nodes: DataFrame, size: int) -> DataFrame:
    return nodes.withColumn("chunk", F.floor(F.col("at") / size).cast("long"))


def _nodes(table: pa.Table, arity: int, rise: int) -> tuple[pa.Table, list[list[str]]]:
    """A chunk in order of its leaves, and its nodes."""
    table = table.sort_by("at")
    leaves = table.column("digest").to_pylist()
    return table, sweep_up(leaves, min(rise, depth_of(table.column("n")[0].as_py(), arity)), arity)


def _rise(nodes: DataFrame, arity: int, rise: int) -> DataFrame:
    """The top node of every chunk, which is a leaf of the next round."""
    size = arity ** rise

    def up(table: pa.Table) -> pa.Table:
        table, found = _nodes(table, arity, rise)
        tree, chunk, n = (table.column(c)[0].as_py() for c in ("tree", "chunk", "n"))
        return pa.table({
            "tree": pa.array([tree], pa.int32()), "at": pa.array([chunk], pa.int64()),
            "n": pa.array([-(-n // size)], pa.int64()), "digest": pa.array(found[-1], pa.string())})

    kept = nodes.select("tree", "at", "n", "digest")
    return _chunks(kept, size).groupBy("tree", "chunk").applyInArrow(up, NODES)


def _paths(nodes: pa.Table, above: pa.Table, arity: int, rise: int) -> tuple[pa.Table, list[Path]]:
    nodes, found = _nodes(nodes, arity, rise)
    top = tuple((x["siblings"], x["place"]) for x in above.column("path")[0].as_py())
    return nodes, sweep_down(found, top, arity)


def _descend(nodes: DataFrame, above: DataFrame, function, schema: str, arity: int, rise: int) -> DataFrame:
    """Bring each chunk together with the path of its top node."""
    return _chunks(nodes, arity ** rise).groupBy("tree", "chunk").cogroup(
        above.withColumnRenamed("at", "chunk").groupBy("tree", "chunk")).applyInArrow(function, schema)


def _rounds(nodes: DataFrame, most: int, name: str, arity: int, rise: int) -> list[DataFrame]:
    """Written tables of nodes, until each tree has one."""
    rounds = [nodes]
    while most > 1:
        nodes = written(_rise(nodes, arity, rise), f"merkle-{name}")
        rounds.append(nodes)
        most = -(-most // arity ** rise)
    return rounds


def _inner(nodes: DataFrame, above: DataFrame, name: str, arity: int, rise: int) -> DataFrame:
    def down(left: pa.Table, right: pa.Table) -> pa.Table:
        left, paths = _paths(left, right, arity, rise)
        return pa.table({
            "tree": left.column("tree"), "at": left.column("at"),
            "subroot": pa.array([right.column("subroot")[0].as_py()] * len(left), pa.string()),
            "path": pa.array([[{"siblings": s, "place": i} for s, i in p] for p in paths],
                             pa.list_(pa.struct([("siblings", pa.string()), ("place", pa.int32())])))})

    return written(_descend(nodes, above, down, PATHS, arity, rise), f"merkle-{name}")


def manifest(docs: DataFrame, arity: int = ARITY, rise: int = RISE) -> DataFrame:
    """doc_id, leaf, subroot, root, proof_sha256, folded_root, verified of every row of
    ``docs(doc_id, source, lang, n_chars, text)``."""
    spark = docs.sparkSession
    kind = docs.schema["doc_id"].dataType.simpleString()
    schema = (f"doc_id {kind}, leaf string, subroot string, root string, proof_sha256 string, "
              "folded_root string, verified boolean")
    leaves, trees = _numbered(leaves_of(docs))
    size = trees.agg(F.max("n").alias("most"), F.count("*").alias("trees")).first()
    if not size["trees"]:
        return spark.createDataFrame([], schema)
    leaves = written(leaves, "merkle-placed")
    rounds = _rounds(leaves, size["most"], "round", arity, rise)
    # The trees' roots are the leaves of one more tree.
    tops = rounds[-1].select(
        F.lit(0).alias("tree"), F.col("tree").cast("long").alias("at"),
        F.lit(size["trees"]).cast("long").alias("n"), "digest")
    upper = _rounds(tops, size["trees"], "top", arity, rise)
    root = upper[-1].first()["digest"]

    no_path = F.array().cast("array<struct<siblings: string, place: int>>")
    paths = upper[-1].select("tree", "at", F.lit("").alias("subroot"), no_path.alias("path"))
    for nodes in reversed(upper[:-1]):
        paths = _inner(nodes, paths, "top-paths", arity, rise)
    subroots = rounds[-1].select("tree", F.col("digest").alias("subroot"))
    paths = paths.select(F.col("at").cast("int").alias("tree"), "path").join(subroots, "tree").select(
        "tree", F.lit(0).cast("long").alias("at"), "subroot", "path")
    for nodes in reversed(rounds[1:-1]):
        paths = _inner(nodes, paths, "paths", arity, rise)

    def proofs(left: pa.Table, right: pa.Table) -> pa.Table:
        left, found = _paths(left, right, arity, rise)
        digests, altered = left.column("digest").to_pylist(), left.column("altered").to_pylist()
        folded = [fold(b or a, p) for a, b, p in zip(digests, altered, found)]
        return pa.table({
            "doc_id": left.column("doc_id"), "leaf": left.column("digest"),
            "subroot": pa.array([right.column("subroot")[0].as_py()] * len(left), pa.string()),
            "root": pa.array([root] * len(left), pa.string()),
            "proof_sha256": pa.array([digest_of(*(s for s, _ in p)) for p in found], pa.string()),
            "folded_root": pa.array(folded, pa.string()),
            "verified": pa.array([x == root for x in folded], pa.bool_())})

    if len(rounds) == 1:  # each tree is a lone leaf, whose path is the top's
        return _descend(leaves, paths, proofs, schema, arity, 0)
    return _descend(leaves, paths, proofs, schema, arity, rise)
