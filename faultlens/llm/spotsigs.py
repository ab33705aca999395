"""SpotSigs fingerprints: chains of content words that follow common words.

Each common word (anchor) of a text and the ``chain`` content words after it form
a signature; a text's fingerprint is the set of its signatures' hashes. Texts are
alike as their sets are (Jaccard). Two sets whose sizes differ by more than a
threshold allows cannot be alike, so sets are partitioned by size.

Results in special cases: a null text is empty; a text without an anchor followed
by a content word has one signature, its whole sequence of words; a text without a
word has an empty set, and two empty sets are alike by 1; null doc_ids come last
in the order of documents, and rows that repeat a doc_id stand in the order of
their texts; an empty table gives an empty table; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from faultlens.llm.storage import written
from faultlens.llm.words import word_blocks

#: Common words of English, German, French and Spanish, lower case.
ANCHORS = frozenset(word.encode() for word in """
the of and to in a is that it on for was with as be by this are at from an or not
der die und den von zu das mit sich des auf für ist im dem nicht ein eine als auch es
de la le les et en un une du que est pour dans qui par sur pas au ne se ce il plus
el los las del y lo por con no su para como al más o pero sus
""".split())

PUNCTUATION = b".,;:!?\"'()[]{}<>|*%$#&"
CHAIN = 2


def signatures(text: bytes, chain: int = CHAIN) -> np.ndarray:
    """The sorted hashes of a text's signatures (UTF-8)."""
    from xxhash import xxh64, xxh64_intdigest

    found: set[bytes] = set()
    # Chains that wait for their next content word, by how many they have.
    waiting: list[set[bytes]] = [set() for _ in range(chain)]
    whole, words_seen = xxh64(), False
    for words in word_blocks(text.lower()):
        for word in words:
            word = word.strip(PUNCTUATION)
            if word in ANCHORS:
                waiting[0].add(word)
            elif word:
                found.update([c + b" " + word for c in waiting[-1]])
                for k in range(chain - 1, 0, -1):
                    waiting[k] = {c + b" " + word for c in waiting[k - 1]}
                waiting[0] = set()
        if not found:
            whole.update(b" ".join(words) + b" ")
            words_seen |= bool(words)
    if not found and words_seen:
        return np.array([whole.intdigest()], np.uint64)
    hashes = np.fromiter(map(xxh64_intdigest, found), np.uint64, len(found))
    hashes.sort()
    return hashes


def digest(sorted_hashes: np.ndarray) -> str:
    """A set as text: its size and a 128-bit checksum of its members."""
    from xxhash import xxh3_128_hexdigest

    return f"{len(sorted_hashes)}:{xxh3_128_hexdigest(sorted_hashes.tobytes())}"


def jaccard(a: np.ndarray, b: np.ndarray, least: float = 0.0) -> float:
    """Likeness of two sets (sorted, distinct); 0 if their sizes keep it below ``least``."""
    if not len(a) and not len(b):
        return 1.0
    if min(len(a), len(b)) < least * max(len(a), len(b)):
        return 0.0
    common = len(np.intersect1d(a, b, assume_unique=True))
    return common / (len(a) + len(b) - common)


def fingerprints(docs: DataFrame, chain: int = CHAIN) -> DataFrame:
    """doc_id, signatures (array of long), fingerprint of ``docs(doc_id, text)``."""

    def read(batches):
        for batch in batches:
            sets = [signatures((t or "").encode(), chain) for t in batch.column(1).to_pylist()]
            yield pa.record_batch(
                [batch.column(0), pa.array([s.view(np.int64).tolist() for s in sets], pa.list_(pa.int64())),
                 pa.array(list(map(digest, sets)), pa.string())],
                names=["doc_id", "signatures", "fingerprint"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(
        read, "doc_id long, signatures array<long>, fingerprint string")


def size_partition(size: Column, threshold: float) -> Column:
    """Number of the partition of sets of a size: bounds grow by the factor 1/threshold."""
    return F.floor(F.log(F.greatest(size, F.lit(1)).cast("double")) / -math.log(threshold)).cast("int")


def near_pairs(prints: DataFrame, threshold: float = 0.8) -> DataFrame:
    """left, right, likeness of distinct fingerprints that are alike by ``threshold``.

    ``prints`` as of ``fingerprints``. Equal sets are one; membership is the column
    ``fingerprint``. A set meets sets of its own and of the next size partition only,
    by one of its first signatures in hash order: two sets as alike as the threshold
    share one among the first ``size - ceil(threshold * size) + 1`` of each.
    """
    sets = written(
        prints.groupBy("fingerprint").agg(F.first("signatures").alias("signatures"))
        .withColumn("size", F.size("signatures")).filter("size > 0"), "spotsigs-sets")
    keep = (F.col("size") - F.ceil(F.col("size") * threshold - 1e-9) + 1).cast("int")
    keys = sets.select(
        "fingerprint", "size", size_partition(F.col("size"), threshold).alias("part"),
        F.explode(F.slice(F.array_sort("signatures"), 1, keep)).alias("signature"))
    left = keys.select(F.col("fingerprint").alias("left"), F.col("size").alias("n"), "signature",
                       F.explode(F.array(F.col("part"), F.col("part") + 1)).alias("part"))
    right = keys.select(F.col("fingerprint").alias("right"), F.col("size").alias("m"), "signature", "part")
    candidates = (
        left.join(right, ["part", "signature"])
        .filter((F.struct("n", "left") < F.struct("m", "right")) & (F.col("n") >= F.col("m") * threshold))
        .select("left", "right").distinct()
    )
    a = sets.select(F.col("fingerprint").alias("left"), F.col("signatures").alias("a"))
    b = sets.select(F.col("fingerprint").alias("right"), F.col("signatures").alias("b"))
    common = F.size(F.array_intersect("a", "b"))
    return (
        candidates.join(a, "left").join(b, "right")
        .select("left", "right", (common / (F.size("a") + F.size("b") - common)).alias("likeness"))
        .filter(F.col("likeness") >= threshold)
    )


def _edited(text: str, following: str) -> str:
    half = len(text) // 2
    return text[:len(text) - half] + following[:half]


class _Read:
    """A document with what is computed once for it."""

    def __init__(self, doc_id, text: str, chain: int):
        self.doc_id, self.text, self.chain = doc_id, text, chain
        self.set = signatures(text.encode(), chain)

    def against(self, following: "_Read") -> tuple:
        edited = _edited(self.text, following.text).encode()
        edited_set = signatures(edited, self.chain)
        return (self.doc_id, len(self.text), hashlib.sha256(edited).hexdigest(), digest(self.set),
                digest(edited_set), jaccard(self.set, edited_set), jaccard(self.set, following.set))


RESULT = """doc_id long, n_chars long, edited_sha256 string, fingerprint string,
edited_fingerprint string, near_edited double, near_next double"""
_TYPES = (pa.int64(), pa.int64(), *[pa.string()] * 3, pa.float64(), pa.float64(),
          pa.int32(), pa.string(), pa.string())
_NAMES = ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint",
          "near_edited", "near_next", "part", "head", "tail"]


def _batch(rows: list[tuple], width: int = len(_NAMES)) -> pa.RecordBatch:
    return pa.record_batch(
        [pa.array(c, t) for c, t in zip(list(zip(*rows)) or [()] * width, _TYPES)], names=_NAMES[:width])


def edit_report(docs: DataFrame, chain: int = CHAIN) -> DataFrame:
    """Each document against its edited text and against the next document.

    The edited text ends with the next document's beginning. Documents are laid out
    in ranges of doc_id, so the next one is the next row; the last of a range waits
    for the first of the range after it, which is one document per range.
    """

    def read(batches):
        from pyspark import TaskContext

        part, first, last = TaskContext.get().partitionId(), None, None
        for batch in batches:
            rows = []
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                here = _Read(doc_id, text or "", chain)
                if last is None:
                    first = here
                else:
                    rows.append((*last.against(here), part, None, None))
                last = here
            yield _batch(rows)
        if last is not None:
            yield _batch([(last.doc_id, *[None] * 6, part, first.text, last.text)])

    def finish(batches):
        for batch in batches:
            yield _batch([
                _Read(doc_id, tail, chain).against(_Read(None, head, chain))
                for doc_id, tail, head in zip(*(batch.column(i).to_pylist() for i in range(3)))], 7)

    order = [F.col("doc_id").asc_nulls_last(), F.col("text")]
    report = written(
        docs.select(F.col("doc_id").cast("long"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
        .repartitionByRange(order[0]).sortWithinPartitions(*order)
        .mapInArrow(read, f"{RESULT}, part int, head string, tail string"), "spotsigs-report")
    ends = report.filter("tail is not null")
    # One short row per range; after the last range comes the first.
    row = Window.orderBy("part")
    after = ends.select("part").select("part", F.coalesce(
        F.lead("part").over(row),
        F.min("part").over(row.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)),
    ).alias("after"))
    closed = (
        ends.select("doc_id", "tail", "part").join(after, "part")
        .join(ends.select(F.col("part").alias("after"), F.col("head").alias("next_head")), "after")
        .select("doc_id", "tail", "next_head").mapInArrow(finish, RESULT)
    )
    return report.filter("tail is null").drop("part", "head", "tail").union(closed)
