"""Document quality by a linear-chain conditional random field over lines.

Every line is good or bad. What a line looks like, what its neighbours look like,
and its neighbours' states decide; forward-backward gives each line's probability
of being good, and a document's quality is their mean, weighted by the lines'
lengths. Labels are of documents, so in training each line has its document's.

Results in special cases: a null text is empty; a text without a line break is one
line, an empty text one empty line; a line of over a megabyte may count as several;
without labelled rows of both classes the score is the share of good ones, or one
half of none; other columns are never read.
"""

from __future__ import annotations

from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from faultlens.llm.labelled import training_texts
from faultlens.llm.storage import written
from faultlens.llm.words import IS_SPACE, Hasher, mix, runs, text_blocks

#: Labelled rows to learn from at most, and lines of such a row at most.
SAMPLE, LINES = 8000, 2000
ROUNDS, DECAY = 120, 1e-3

NEWLINE = 0x0A


def _members(characters: str) -> np.ndarray:
    out = np.zeros(256, bool)
    out[list(characters.encode())] = True
    return out


IS_UPPER = _members("ABCDEFGHIJKLMNOPQRSTUVWXYZ")
IS_LOWER = _members("abcdefghijklmnopqrstuvwxyz")
IS_DIGIT = _members("0123456789")
IS_STOP = _members(".,;:?'")
IS_SYMBOL = _members("#$%&*@^~_=+<>{}[]\\/")

FEATURES = 14


def _per(count: np.ndarray, of: np.ndarray) -> np.ndarray:
    return count / np.maximum(of, 1)


def _line_features(data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, length, features) of each line of a block; every row has a line."""
    # A line ends after its break, and where its row ends.
    ends = np.union1d(np.flatnonzero(data == NEWLINE) + 1, bounds[1:])
    starts = np.concatenate(([bounds[0]], ends[:-1]))
    nonempty = ends > starts
    starts, ends = starts[nonempty], ends[nonempty]
    empty_rows = np.flatnonzero(bounds[1:] == bounds[:-1])
    row = np.searchsorted(bounds, starts, side="right") - 1
    # Empty rows have an empty line where they stand.
    order = np.argsort(np.concatenate((row, empty_rows)), kind="stable")
    row = np.concatenate((row, empty_rows))[order]
    starts = np.concatenate((starts, bounds[empty_rows]))[order]
    ends = np.concatenate((ends, bounds[empty_rows]))[order]
    n = len(row)

    def count(member: np.ndarray) -> np.ndarray:
        sums = np.concatenate(([0], np.cumsum(member)))
        return (sums[ends] - sums[starts]).astype(float)

    two = np.zeros(len(data), bool)  # capital letters of two bytes: of Latin-1
    two[1:] = (data[:-1] == 0xC3) & (data[1:] >= 0x80) & (data[1:] <= 0x9E)
    small = np.zeros(len(data), bool)
    small[1:] = (data[:-1] == 0xC3) & (data[1:] >= 0x9F)
    length = (ends - starts).astype(float)
    upper, lower = count(IS_UPPER[data] | two), count(IS_LOWER[data] | small)
    letters = upper + lower
    word_starts, word_ends = runs(~IS_SPACE[data], bounds[1:-1])
    line_of = np.searchsorted(starts, word_starts, side="right") - 1
    words = np.bincount(line_of, minlength=n).astype(float)
    hasher = Hasher(data)
    hashed = hasher(word_starts, word_ends)
    again = np.zeros(len(hashed), bool)
    again[1:] = (hashed[1:] == hashed[:-1]) & (line_of[1:] == line_of[:-1])
    repeated = np.bincount(line_of, again, n)
    # Distinct words of a line: the first of equal (line, word) after sorting.
    keyed = np.sort(mix(hashed ^ mix(line_of.astype(np.uint64))))
    firsts = np.searchsorted(keyed, mix(hashed ^ mix(line_of.astype(np.uint64))))
    distinct = np.bincount(
        line_of, 1 / (np.searchsorted(keyed, keyed, side="right")
                      - np.searchsorted(keyed, keyed, side="left"))[firsts], n)
    # Equal lines of a document.
    line_key = mix(hasher(starts, ends) ^ mix(row.astype(np.uint64)))
    _, at, times = np.unique(line_key, return_inverse=True, return_counts=True)
    same = (times[at] > 1) & (length > 1)
    f = np.zeros((n, FEATURES), np.float32)
    f[:, 0] = 1
    f[:, 1] = _per(upper, letters)
    f[:, 2] = f[:, 1] > 0.5
    f[:, 3] = _per(letters, length)
    f[:, 4] = np.minimum(1, _per(count(IS_SYMBOL[data]), words))
    f[:, 5] = np.minimum(1, _per(count(data == ord("|")), words))
    f[:, 6] = np.minimum(1, _per(count(data == ord("!")), words))
    f[:, 7] = _per(count(IS_DIGIT[data]), length)
    f[:, 8] = _per(repeated, words)
    f[:, 9] = np.where(words > 0, _per(distinct, words), 1)
    f[:, 10] = same
    f[:, 11] = np.minimum(1, _per(length, words) / 16)
    f[:, 12] = np.minimum(1, _per(count(IS_STOP[data]), words))
    f[:, 13] = words < 4
    return row, ends - starts, f


def lines_of(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, length, features) of every line of the texts, in order."""
    parts = [(r + first, n, f) for data, bounds, first, *_ in text_blocks(texts)
             for r, n, f in [_line_features(data, bounds)]]
    if not parts:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros((0, FEATURES), np.float32)
    return tuple(np.concatenate(x) for x in zip(*parts))


def with_neighbours(row: np.ndarray, f: np.ndarray) -> np.ndarray:
    """Features of a line, of the line before and of the line after; zeros beyond the ends."""
    before, after = np.zeros_like(f), np.zeros_like(f)
    follows = row[1:] == row[:-1]
    before[1:][follows] = f[:-1][follows]
    after[:-1][follows] = f[1:][follows]
    return np.concatenate((f, before, after), axis=1)


class Field(NamedTuple):
    """``emission``: weights of a line's features for good against bad.
    ``moves``: log potentials from (bad, good) to (bad, good)."""

    emission: np.ndarray
    moves: np.ndarray


class _Chains:
    """Lines as chains, advanced together: step t holds line t of every chain that has one."""

    def __init__(self, row: np.ndarray):
        first = np.flatnonzero(np.r_[True, row[1:] != row[:-1]]) if len(row) else np.zeros(0, np.int64)
        n = np.diff(np.r_[first, len(row)])
        order = np.argsort(-n, kind="stable")
        self.first, self.n = first[order], n[order]
        # How many chains have more than t lines.
        self.alive = np.searchsorted(-self.n, -np.arange(1, (self.n[0] if len(n) else 0) + 1), side="right")

    def steps(self):
        for t, k in enumerate(self.alive):
            yield t, self.first[:k] + t


def marginals(field: Field, x: np.ndarray, row: np.ndarray):
    """P(good) of each line, P(state, next state) of each line and its next, and log Z summed."""
    chains = _Chains(row)
    odds = np.clip(x @ field.emission, -30, 30)
    good = np.exp(odds)
    m = np.exp(field.moves)
    # Forward and backward messages, each scaled to add up to 1 over (bad, good).
    forward, backward = np.zeros((len(row), 2)), np.full((len(row), 2), 0.5)
    log_z = 0.0
    for t, at in chains.steps():
        if t == 0:
            a = np.ones((len(at), 2))
        else:
            a = forward[at - 1] @ m
        a[:, 1] *= good[at]
        total = a.sum(axis=1, keepdims=True)
        log_z += float(np.log(total).sum())
        forward[at] = a / total
    for t in range(len(chains.alive) - 1, 0, -1):
        at = chains.first[:chains.alive[t]] + t
        b = backward[at].copy()
        b[:, 1] *= good[at]
        b = b @ m.T
        backward[at - 1] = b / b.sum(axis=1, keepdims=True)
    p = forward * backward
    p /= p.sum(axis=1, keepdims=True)
    inner = np.flatnonzero(np.r_[row[1:] == row[:-1], False]) if len(row) else np.zeros(0, np.int64)
    step = np.stack((np.ones(len(inner)), good[inner + 1]), axis=1) * backward[inner + 1]
    pairs = forward[inner][:, :, None] * m[None] * step[:, None, :]
    pairs /= pairs.sum(axis=(1, 2), keepdims=True)
    return p[:, 1], pairs, log_z


def _descend(x: np.ndarray, row: np.ndarray, y: np.ndarray, weight: np.ndarray) -> Field:
    """Fit by gradient ascent of the conditional likelihood, with per-weight steps."""
    inner = np.flatnonzero(row[1:] == row[:-1])
    y = y.astype(int)
    seen = np.zeros((2, 2))
    np.add.at(seen, (y[inner], y[inner + 1]), weight[inner])
    values = [np.zeros(x.shape[1]), np.zeros((2, 2))]
    steady, square = ([np.zeros_like(v) for v in values] for _ in range(2))
    total = weight.sum()
    for t in range(1, ROUNDS + 1):
        p, pairs, _ = marginals(Field(*values), x, row)
        grads = [x.T @ (weight * (p - y)) / total,
                 ((weight[inner][:, None, None] * pairs).sum(axis=0) - seen) / total]
        for i, g in enumerate(grads):
            g = g + DECAY * values[i]
            steady[i] = 0.9 * steady[i] + 0.1 * g
            square[i] = 0.99 * square[i] + 0.01 * g * g
            values[i] = values[i] - 0.1 * (steady[i] / (1 - 0.9**t)) / (
                np.sqrt(square[i] / (1 - 0.99**t)) + 1e-9)
    return Field(*values)


def quality_scores(field: Field, texts: pa.Array) -> np.ndarray:
    row, length, f = lines_of(texts)
    p, _, _ = marginals(field, with_neighbours(row, f).astype(float), row)
    weight = np.maximum(length, 1).astype(float)
    return np.bincount(row, p * weight, len(texts)) / np.bincount(row, weight, len(texts))


def fit(
    docs: DataFrame, labels: DataFrame, label: str = "quality", modulus: int = 4, held_out: int = 2,
    most: int = SAMPLE,
) -> Field:
    """A field that has learnt ``label`` from at most ``most`` rows outside the held-out fold.

    Both classes weigh alike per document, and so do long and short documents.
    Labelled documents of more than ``LINES`` lines are not learnt from.
    """
    sample = training_texts(docs, labels, label, modulus, held_out, most)

    def read(batches):
        for batch in batches:
            row, _, f = lines_of(batch.column(0))
            n = np.bincount(row, minlength=batch.num_rows)
            ends = np.cumsum(n)
            short = np.flatnonzero(n <= LINES)
            yield pa.record_batch(
                [pa.array([f[ends[i] - n[i]:ends[i]].tobytes() for i in short], pa.binary()),
                 batch.column(1).take(pa.array(short))], names=["lines", "label"])

    # Numbers of at most ``most`` rows of at most ``LINES`` lines; sorted, since the order is not fixed.
    rows = sorted(map(tuple, written(
        sample.mapInArrow(read, "lines binary, label int"), "quality-sample").collect()))
    k = sum(y for _, y in rows)
    if not 0 < k < len(rows):
        share = (k + 0.5) / (len(rows) + 1)
        emission = np.zeros(3 * FEATURES)
        emission[0] = np.log(share / (1 - share))
        return Field(emission, np.zeros((2, 2)))
    lines = [np.frombuffer(f, np.float32).reshape(-1, FEATURES) for f, _ in rows]
    sizes = np.array(list(map(len, lines)))
    row = np.repeat(np.arange(len(rows)), sizes)
    y = np.array([y for _, y in rows])
    each = np.where(y == 1, 0.5 / k, 0.5 / (len(rows) - k)) / sizes
    return _descend(with_neighbours(row, np.concatenate(lines)).astype(float), row, y[row], each[row])


def scorer(field: Field):
    """A column function: the quality (0 to 1) of a text."""

    @F.arrow_udf("double")
    def score(text: pa.Array) -> pa.Array:
        return pa.array(quality_scores(field, text))

    return lambda text: score(F.coalesce(text.cast("string"), F.lit("")))
