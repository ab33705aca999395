"""Toxicity by a factorization machine over hashed terms.

A document's terms are its distinct words and their beginnings, hashed. Besides a
weight each, terms have short vectors whose inner products weigh pairs of terms, so
that two words can say together what neither says alone. The machine is fitted on a
bounded sample of labelled documents: Spark counts the terms of both classes over
the sample, the terms that set them apart most are kept, and weights and vectors
are fitted on the documents' kept terms, which are few.

Results in special cases: a null text is empty; a text without a kept term has the
score of the bias alone; without labelled rows of both classes the score is the
share of toxic ones, or one half of none; other columns are never read.
"""

from __future__ import annotations

from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from faultlens.llm.labelled import training_texts
from faultlens.llm.storage import written
from faultlens.llm.words import Hasher, mix, runs, text_blocks

#: Labelled rows to learn from at most, terms kept at most, and the rows a kept term is in at least.
SAMPLE, TERMS, LEAST_ROWS = 30_000, 8192, 3
FACTORS, ROUNDS, SEED = 8, 150, 5
#: Lengths in bytes of the beginnings of words.
BEGINNINGS = (4, 5, 6)

LOWER = np.arange(256, dtype=np.uint8)
LOWER[ord("A"):ord("Z") + 1] += 32
IN_WORD = np.zeros(256, bool)
IN_WORD[[*range(ord("a"), ord("z") + 1), *range(ord("0"), ord("9") + 1), *range(128, 256)]] = True


class Machine(NamedTuple):
    """Sorted hashes of the kept terms, their weights and vectors, and the bias."""

    terms: np.ndarray
    weights: np.ndarray
    vectors: np.ndarray
    bias: float


def _block_terms(data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row in the block, term) of each term of a block, repeats included."""
    data = LOWER[data]
    starts, ends = runs(IN_WORD[data], bounds[1:-1])
    rows = np.searchsorted(bounds, starts, side="right") - 1
    hashed = Hasher(data)
    terms, of = [hashed(starts, ends)], [rows]
    for n in BEGINNINGS:
        long = ends - starts > n
        terms.append(mix(hashed(starts[long], starts[long] + n) ^ np.uint64(n)))
        of.append(rows[long])
    return np.concatenate(of), np.concatenate(terms)


def _distinct(rows: np.ndarray, terms: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    order = np.lexsort((terms, rows))
    rows, terms = rows[order], terms[order]
    new = np.ones(len(rows), bool)
    new[1:] = (rows[1:] != rows[:-1]) | (terms[1:] != terms[:-1])
    return rows[new], terms[new]


class _Kept:
    """Finds kept terms: a small table first, since most terms are not kept."""

    BITS = 20

    def __init__(self, terms: np.ndarray):
        self.terms = terms
        self.table = np.zeros(1 << self.BITS, bool)
        self.table[terms >> np.uint64(64 - self.BITS)] = True

    def __call__(self, rows: np.ndarray, terms: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(row, place among the kept) of the kept terms, distinct."""
        maybe = self.table[terms >> np.uint64(64 - self.BITS)]
        rows, terms = rows[maybe], terms[maybe]
        at = np.searchsorted(self.terms, terms)
        at[at == len(self.terms)] = 0
        hit = self.terms[at] == terms if len(self.terms) else np.zeros(len(at), bool)
        return _distinct(rows[hit], at[hit])


def kept_terms(texts: pa.Array, kept: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row, place) of the kept terms of each text; a long text's blocks are joined."""
    find, rows, places = _Kept(kept), [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    for data, bounds, first, *_ in text_blocks(texts):
        r, p = find(*_block_terms(data, bounds))
        rows.append(r + first)
        places.append(p)
    return _distinct(np.concatenate(rows), np.concatenate(places))


def _term_counts(sample: DataFrame) -> DataFrame:
    """term, n, n_toxic over the documents of ``sample(text, label)``."""

    def count(batches):
        for batch in batches:
            rows, terms = [np.zeros(0, np.int64)], [np.zeros(0, np.uint64)]
            labels = batch.column(1).to_numpy(zero_copy_only=False)
            for data, bounds, first, *_ in text_blocks(batch.column(0)):
                r, t = _distinct(*_block_terms(data, bounds))
                rows.append(r + first)
                terms.append(t)
            r, t = _distinct(np.concatenate(rows), np.concatenate(terms))
            found, at, n = np.unique(t, return_inverse=True, return_counts=True)
            toxic = np.bincount(at, labels[r], len(found))
            yield pa.record_batch(
                [pa.array(found.view(np.int64)), pa.array(n.astype(np.int64)),
                 pa.array(toxic.astype(np.int64))], names=["term", "n", "n_toxic"])

    return sample.mapInArrow(count, "term long, n long, n_toxic long").groupBy("term").agg(
        F.sum("n").alias("n"), F.sum("n_toxic").alias("n_toxic"))


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))


def raw_scores(machine: Machine, rows: np.ndarray, places: np.ndarray, n: int) -> np.ndarray:
    """The machine's sum for each of ``n`` documents with the kept terms (row, place)."""
    linear = np.bincount(rows, machine.weights[places], n)
    pairs = np.zeros(n)
    for f in range(machine.vectors.shape[1]):
        v = machine.vectors[places, f]
        pairs += np.bincount(rows, v, n) ** 2 - np.bincount(rows, v * v, n)
    return machine.bias + linear + pairs / 2


def _descend(terms: np.ndarray, rows: np.ndarray, places: np.ndarray, labels: np.ndarray) -> Machine:
    """Fit by gradient descent with momentum and per-weight steps over the whole sample."""
    n, k = len(labels), len(terms)
    rng = np.random.default_rng(SEED)
    share = np.clip(labels.mean(), 1 / (n + 2), 1 - 1 / (n + 2))
    values = [np.array([np.log(share / (1 - share))]), np.zeros(k), rng.normal(0, 0.01, (k, FACTORS))]
    steady, square = ([np.zeros_like(v) for v in values] for _ in range(2))
    decay = (0.0, 1e-4, 1e-3)
    for t in range(1, ROUNDS + 1):
        machine = Machine(terms, values[1], values[2], float(values[0][0]))
        off = (_sigmoid(raw_scores(machine, rows, places, n)) - labels) / n
        each = off[rows]
        grads = [np.array([off.sum()]), np.bincount(places, each, k), np.zeros((k, FACTORS))]
        for f in range(FACTORS):
            v = values[2][places, f]
            grads[2][:, f] = np.bincount(places, each * (np.bincount(rows, v, n)[rows] - v), k)
        for i, g in enumerate(grads):
            g = g + decay[i] * values[i] / np.sqrt(n)
            steady[i] = 0.9 * steady[i] + 0.1 * g
            square[i] = 0.99 * square[i] + 0.01 * g * g
            values[i] = values[i] - 0.05 * (steady[i] / (1 - 0.9**t)) / (
                np.sqrt(square[i] / (1 - 0.99**t)) + 1e-9)
    return Machine(terms, values[1], values[2], float(values[0][0]))


def fit(
    docs: DataFrame, labels: DataFrame, label: str = "toxic", modulus: int = 5, held_out: int = 0,
    most: int = SAMPLE,
) -> Machine:
    """A machine that has learnt ``label`` from at most ``most`` rows outside the held-out fold."""
    sample = written(training_texts(docs, labels, label, modulus, held_out, most), "toxic-sample")
    total = sample.agg(F.count("*").alias("n"), F.sum("label").alias("k")).first()
    n, k = total["n"], total["k"] or 0
    none = np.zeros(0, np.uint64)
    if not 0 < k < n:
        share = (k + 0.5) / (n + 1)
        return Machine(none, np.zeros(0), np.zeros((0, FACTORS)), float(np.log(share / (1 - share))))
    rate = k / n
    apart = F.abs(F.col("n_toxic") - F.col("n") * rate) / F.sqrt(F.col("n") * (rate * (1 - rate)))
    chosen = (
        _term_counts(sample).filter(F.col("n") >= LEAST_ROWS)
        .orderBy(apart.desc(), "term").limit(TERMS).select("term").collect())
    terms = np.sort(np.array([r["term"] for r in chosen], np.int64).view(np.uint64))

    def read(batches):
        for batch in batches:
            rows, places = kept_terms(batch.column(0), terms)
            parts = np.split(places.astype(np.int32), np.searchsorted(rows, np.arange(1, batch.num_rows)))
            yield pa.record_batch(
                [pa.array([p.tobytes() for p in parts[:batch.num_rows]], pa.binary()), batch.column(1)],
                names=["places", "label"])

    # At most ``most`` rows of kept terms; sorted, since the order of rows is not fixed.
    rows = sorted(map(tuple, sample.mapInArrow(read, "places binary, label int").collect()))
    places = [np.frombuffer(p, np.int32) for p, _ in rows]
    return _descend(
        terms, np.repeat(np.arange(len(rows)), list(map(len, places))),
        np.concatenate([np.zeros(0, np.int32), *places]), np.array([y for _, y in rows], float))


def scorer(machine: Machine):
    """A column function: the score (0 to 1) of a text."""

    @F.arrow_udf("double")
    def score(text: pa.Array) -> pa.Array:
        rows, places = kept_terms(text, machine.terms)
        return pa.array(_sigmoid(raw_scores(machine, rows, places, len(text))))

    return lambda text: score(F.coalesce(text.cast("string"), F.lit("")))


def toxicity(docs: DataFrame, labels: DataFrame, text: Column) -> Column:
    """The toxicity of ``text`` by a machine fitted on ``docs`` and ``labels``."""
    return scorer(fit(docs, labels))(text)
