"""Mix sources to target weights by repeating documents.

Tokens are summed per source, the sums are turned into repetition rates, and a
document is taken ``floor(rate)`` times plus once more if a number hashed from
its id lies below the rate's fraction. Column expressions only.

Results in special cases: a null text has size 0; a null source is a source of
its own, after all others; an empty table gives an empty table; rows that repeat
a doc_id get the same decision; a null doc_id is decided by its text; a source
without a word has target 0 and its documents are not taken.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from faultlens.llm.storage import written

#: Up to this many sources the table of targets is broadcast; beyond, it is joined by shuffle.
BROADCAST_SOURCES = 10_000

SPACES = " \t\n\x0b\x0c\r"


def word_count(text: Column) -> Column:
    """Number of maximal runs without ASCII white space."""
    one_each = F.regexp_replace(F.coalesce(text, F.lit("")), r"[^\x20\x09-\x0D]++", "x")
    return F.length(F.translate(one_each, SPACES, "")).cast("long")


def targets(
    sizes: DataFrame, weights: Sequence[int], share: float, most_repeats: float
) -> DataFrame:
    """Targets of the sources of ``sizes(source, size)``: source, source_size, target.

    Sources by code point, null last, get ``weights`` in turn and share ``share``
    times all tokens. No target exceeds ``most_repeats`` times its source; what is
    cut goes to the others by weight. The sources that reach their limit are those
    with the smallest limit per weight, so one ordered pass finds the level of the
    rest. The windows run over one row per source.
    """
    n = len(weights)
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    by_level = Window.orderBy(F.col("limit") / F.col("weight"), F.col("place"))
    before = by_level.rowsBetween(Window.unboundedPreceding, -1)
    after = by_level.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    everything = Window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    summed = (
        sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
        .withColumn("place", F.row_number().over(by_name) - 1)
        .withColumn("weight", F.element_at(
            F.array(*(F.lit(float(w)) for w in weights)), (F.col("place") % n + 1).cast("int")))
        .withColumn("limit", F.col("source_size") * F.lit(float(most_repeats)))
        .withColumn("all", F.sum("source_size").over(everything) * F.lit(float(share)))
        .withColumn("left", F.col("all") - F.coalesce(F.sum("limit").over(before), F.lit(0.0)))
        .withColumn("weights_left", F.sum("weight").over(after))
    )
    # The first source, in order of its level, whose even share stays within its limit.
    fits = F.col("weight") * F.col("left") / F.col("weights_left") <= F.col("limit")
    first = F.min(F.when(fits, F.struct(F.col("limit") / F.col("weight"), "place", "left",
                                        "weights_left"))).over(everything)
    return (
        summed.withColumn("level", first)
        .withColumn("target", F.least(
            F.col("limit"),
            F.coalesce(F.col("weight") * F.col("level.left") / F.col("level.weights_left"),
                       F.col("limit"))))
        .select("source", "source_size", "target")
    )


def chance(doc_id: Column, text: Column, seed: int) -> Column:
    """A number in [0, 1) that depends on the document and the seed only."""
    key = F.coalesce(doc_id.cast("string"), F.concat(F.lit("text:"), F.coalesce(text, F.lit(""))))
    digest = F.md5(F.concat(F.lit(f"{seed}:"), key))
    return F.conv(F.substring(digest, 1, 8), 16, 10).cast("double") / F.lit(float(2**32))


def _with_targets(rows: DataFrame, targets_: DataFrame) -> DataFrame:
    """``rows`` (with a column ``source_``) and the columns of their source's target."""
    renamed = targets_.select(F.col("source").alias("source_of_target"), "source_size", "target")
    if renamed.limit(BROADCAST_SOURCES + 1).count() <= BROADCAST_SOURCES:
        renamed = F.broadcast(renamed)
    return rows.join(
        renamed, F.col("source_").eqNullSafe(F.col("source_of_target")), "left"
    ).drop("source_of_target")


def _copies(size: str, chance_: str) -> Column:
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    whole = F.floor(rate)
    return (whole + F.when(F.col(chance_) < rate - whole, 1).otherwise(0)).cast("long")


def mix_report(
    docs: DataFrame, weights: Sequence[int] = (5, 2, 1), share: float = 1.5,
    most_repeats: float = 2.0, seed: int = 7,
) -> DataFrame:
    """doc_id, source, size, source_size, target, copies, taken of every document."""
    sizes = written(docs.select(
        "doc_id", F.col("source").alias("source_"), word_count(F.col("text")).alias("size"),
        chance(F.col("doc_id"), F.col("text"), seed).alias("chance")), "mix-sizes")
    found = written(targets(sizes.select(F.col("source_").alias("source"), "size"),
                            weights, share, most_repeats), "mix-targets")
    return (
        _with_targets(sizes, found)
        .withColumn("copies", _copies("size", "chance"))
        .select("doc_id", F.col("source_").alias("source"), "size", "source_size", "target",
                "copies", (F.col("copies") * F.col("size")).alias("taken"))
    )


def mix(
    docs: DataFrame, weights: Sequence[int] = (5, 2, 1), share: float = 1.5,
    most_repeats: float = 2.0, seed: int = 7,
) -> DataFrame:
    """The mixed documents: every row of ``docs`` as often as the mix takes it.

    Texts are not shuffled; only sums per source are.
    """
    sizes = docs.select("source", word_count(F.col("text")).alias("size"))
    found = written(targets(sizes, weights, share, most_repeats), "mix-targets")
    packed = docs.select(
        F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"),
        F.col("source").alias("source_"), chance(F.col("doc_id"), F.col("text"), seed).alias("chance"))
    return (
        _with_targets(packed, found)
        .select("row", _copies("size", "chance").cast("int").alias("copies"))
        .withColumn("copy", F.explode(F.array_repeat(F.lit(0), F.col("copies"))))
        .select("row.*")
    )


MIX_SQL = r"""
WITH sizes AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS size,
         coalesce(CAST(doc_id AS VARCHAR), 'text:' || coalesce(text, '')) AS key
  FROM {docs}
), summed AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size,
         row_number() OVER (ORDER BY source NULLS LAST) - 1 AS place
  FROM sizes GROUP BY source
), weighed AS (
  SELECT *, CASE place % 3 WHEN 0 THEN 5.0::DOUBLE WHEN 1 THEN 2.0::DOUBLE ELSE 1.0::DOUBLE END AS weight,
         source_size * 2.0::DOUBLE AS cap, 1.5::DOUBLE * sum(source_size) OVER () AS total
  FROM summed
), levels AS (
  SELECT a.source, a.cap, a.weight, a.source_size, a.place,
         a.total - coalesce((SELECT sum(b.cap) FROM weighed b
             WHERE b.cap / b.weight < a.cap / a.weight
                OR (b.cap / b.weight = a.cap / a.weight AND b.place < a.place)), 0) AS rest,
         (SELECT sum(b.weight) FROM weighed b
             WHERE b.cap / b.weight > a.cap / a.weight
                OR (b.cap / b.weight = a.cap / a.weight AND b.place >= a.place)) AS weights_left
  FROM weighed a
), level AS (
  SELECT rest, weights_left FROM levels WHERE weight * rest / weights_left <= cap
  ORDER BY cap / weight, place LIMIT 1
), aims AS (
  SELECT source, source_size,
         least(cap, coalesce(weight * (SELECT rest FROM level) / (SELECT weights_left FROM level), cap)) AS target
  FROM levels
), rated AS (
  SELECT s.*, a.source_size, a.target,
         CASE WHEN a.source_size > 0 THEN a.target / a.source_size ELSE 0 END AS rate,
         ('0x' || substr(md5('7:' || key), 1, 8))::UBIGINT / 4294967296.0::DOUBLE AS chance
  FROM sizes s JOIN aims a ON s.source IS NOT DISTINCT FROM a.source
), counted AS (
  SELECT *, CAST(floor(rate) AS BIGINT) + CASE WHEN chance < rate - floor(rate) THEN 1 ELSE 0 END AS copies
  FROM rated
)
"""

REPORT_SQL = MIX_SQL.format(docs="documents") + """
SELECT doc_id, CAST(size AS BIGINT) AS size, source_size, target,
       CAST(copies * size AS BIGINT) AS taken
FROM counted
"""
