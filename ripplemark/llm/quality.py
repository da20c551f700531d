"""Quality classifier: ordinal cumulative-link regression on graded ratings.

One weight vector over hashed text features serves all grades; ordered
thresholds cut its score: P(grade >= k) = sigmoid(score - threshold_k). It is
fitted on a bounded sample of rated rows (``SAMPLE``, by a hash of the id) and
then read by every task over all whole texts.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .scratch import saved

#: Rated rows that the fit may use at most.
SAMPLE = 12_000
DIMENSIONS = 1 << 18
STEPS, REFIT, RATE, RIDGE, LASSO = 300, 60, 0.05, 1e-5, 1e-4
#: A feature counts from this share of the fitted rows on, and from three rows on.
LEAST_SHARE = 0.001
_MAX_CACHED = 200_000
_PUNCTUATION = bytes(range(0x21, 0x30)) + bytes(range(0x3A, 0x41)) + bytes(range(0x5B, 0x61)) + bytes(range(0x7B, 0x7F))
#: How often in a text counts for shapes, so these weigh as a share times this.
_SHARE = 8.0


def _slot(name: bytes, dimensions: int) -> int:
    return xxhash.xxh64_intdigest(name, 1) % dimensions


class _Tokens(dict):
    """(slot of the word, slot of the shape) of a token; remembers a bounded number of them."""

    def __init__(self, dimensions: int):
        self.dimensions = dimensions

    def __missing__(self, token: bytes) -> tuple[int, int]:
        word = token.strip(_PUNCTUATION)
        lower = word.lower()
        case = b"-" if not word else b"A" if len(word) > 1 and word == word.upper() and word != lower else b"a"
        tail = token[len(token.rstrip(_PUNCTUATION)) :][:3] if word else token[:3]
        found = _slot(b"w " + lower, self.dimensions), _slot(b"s " + case + tail, self.dimensions)
        if len(self) < _MAX_CACHED:
            self[token] = found
        return found


def features(text: bytes | None, tokens: _Tokens) -> tuple[np.ndarray, np.ndarray]:
    """Slots and values of a whole text: words that occur, shares of token shapes, repetition."""
    words = (text or b"").split()
    if not words:
        return np.array([_slot(b"empty", tokens.dimensions)], np.int32), np.ones(1, np.float32)
    times = Counter(words)
    pairs = np.array([tokens[w] for w in times], np.int32).reshape(-1, 2)
    share = np.fromiter(times.values(), np.float64, len(times)) * (_SHARE / len(words))
    shapes, at = np.unique(pairs[:, 1], return_inverse=True)
    known = np.unique(pairs[:, 0])
    again = sum(a == b for a, b in zip(words, words[1:], strict=False)) / len(words)
    lines = (text or b"").split(b"\n")
    extra = [(b"repeated word", again), (b"repeated line", 1 - len(set(lines)) / len(lines)), (b"distinct", len(times) / len(words))]
    slots = np.concatenate([known, shapes, [_slot(n, tokens.dimensions) for n, _ in extra]]).astype(np.int32)
    values = np.concatenate([np.ones(len(known)), np.bincount(at, weights=share), [x * _SHARE for _, x in extra]])
    return slots, values.astype(np.float32)


class Classifier:
    """Shared weights and ascending thresholds, one fewer than grades."""

    def __init__(self, weights: np.ndarray, thresholds: np.ndarray):
        self.weights, self.thresholds = weights, thresholds

    def tails(self, scores: np.ndarray) -> np.ndarray:
        """P(grade >= k) for k from 1, a column each."""
        return 1 / (1 + np.exp(np.clip(self.thresholds[None, :] - scores[:, None], -500, 500)))


def fit(rows: list[tuple[np.ndarray, np.ndarray]], grades: np.ndarray, n_grades: int, dimensions: int) -> Classifier:
    """Penalised maximum likelihood by Adam over all rows; without rows everything gets the top grade.

    The absolute penalty leaves words that tell nothing at zero, so a long text
    does not gather noise; features of few rows are left out for the same.
    """
    if not len(rows):
        return Classifier(np.zeros(dimensions), np.full(n_grades - 1, -4.0) + np.arange(n_grades - 1) * 1e-3)
    n, held = len(rows), np.zeros(dimensions, np.int64)
    for r in rows:
        held[r[0]] += 1  # slots of a row are distinct but for collisions, which count once
    common = held >= max(3, LEAST_SHARE * n)
    rows = [(r[0][m], r[1][m]) for r in rows for m in [common[r[0]]]]  # fewer only where rows come from elsewhere than train()
    slots, values = np.concatenate([r[0] for r in rows]), np.concatenate([r[1] for r in rows])
    of_row = np.repeat(np.arange(n, dtype=np.int32), [len(r[0]) for r in rows])
    del rows
    share = np.array([((grades >= k).sum() + 1) / (n + 2) for k in range(1, n_grades)])
    cuts = np.log((1 - share) / share)
    # thresholds as a first one and positive gaps, so they stay in order
    free = np.concatenate([cuts[:1], np.log(np.maximum(np.diff(cuts), 1e-2))])
    weights = np.zeros(dimensions)
    moments = [np.zeros(dimensions), np.zeros(dimensions), np.zeros(len(free)), np.zeros(len(free))]
    padded = lambda c: np.concatenate(([-np.inf], c, [np.inf]))
    for step in range(1, STEPS + 1):
        if step == STEPS - REFIT:  # the features that are left, without the penalty that chose them
            common &= np.abs(weights) >= RATE
            weights[~common] = 0
            left = common[slots]
            slots, values, of_row = slots[left], values[left], of_row[left]
        cuts = np.concatenate((free[:1], free[0] + np.cumsum(np.exp(free[1:]))))
        score = np.bincount(of_row, weights=weights[slots] * values, minlength=n)
        edges = padded(cuts)
        above = 1 / (1 + np.exp(np.clip(edges[grades] - score, -500, 500)))  # P(grade >= own)
        beyond = 1 / (1 + np.exp(np.clip(edges[grades + 1] - score, -500, 500)))  # P(grade > own)
        own = np.maximum(above - beyond, 1e-12)
        up, down = above * (1 - above) / own, beyond * (1 - beyond) / own
        slope = (up - down) / n
        g_weights = RIDGE * weights + (LASSO if step < STEPS - REFIT else 0) * np.sign(weights) - np.bincount(slots, weights=slope[of_row] * values, minlength=dimensions)
        g_cuts = np.array([(up[grades == k].sum() - down[grades == k - 1].sum()) / n for k in range(1, n_grades)])
        tail = np.cumsum(g_cuts[::-1])[::-1]
        g_free = np.concatenate((tail[:1], np.exp(free[1:]) * tail[1:]))
        for x, g, a, b in ((weights, g_weights, 0, 1), (free, g_free, 2, 3)):
            moments[a] += 0.1 * (g - moments[a])
            moments[b] += 0.01 * (g * g - moments[b])
            x -= RATE * (moments[a] / (1 - 0.9**step)) / (np.sqrt(moments[b] / (1 - 0.99**step)) + 1e-8)
    weights[~common] = 0
    return Classifier(weights, np.concatenate((free[:1], free[0] + np.cumsum(np.exp(free[1:])))))


def train(
    docs: DataFrame, ratings: DataFrame, grade: Column, n_grades: int, *, id_col: str, text_col: str, rating_id: str,
    sample: int = SAMPLE, dimensions: int = DIMENSIONS,
) -> Classifier:
    """Fits on at most ``sample`` ratings of rows of ``docs``; null ids and null grades are left out.

    Of rows that repeat an id, one is read: that whose text has the least hash. What reaches the driver is a row per rating,
    with the features that enough of these rows have.
    """
    rated = ratings.select(F.col(rating_id).alias("_rated"), grade.cast("int").alias("_grade"))
    rated = rated.where("_rated IS NOT NULL AND _grade IS NOT NULL").orderBy(F.xxhash64("_rated"), "_rated", "_grade").limit(sample)
    rated = saved(rated, "rated")
    rows = docs.select(F.col(id_col).alias("_id"), F.col(text_col).cast("binary").alias("_text"))
    rows = rows.join(F.broadcast(rated.select("_rated").distinct()), F.col("_id") == F.col("_rated"))
    rows = rows.groupBy("_rated").agg(F.min_by("_text", F.struct(F.xxhash64("_text"), "_text")).alias("_text"))
    rows = rows.join(F.broadcast(rated), "_rated").select("_grade", "_text")  # at most `sample`

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens = _Tokens(dimensions)
        for b in batches:
            found = [features(t.as_py(), tokens) for t in b.column(1)]
            ends = np.cumsum([0, *(len(x[0]) for x in found)]).astype(np.int32)
            parts = [pa.ListArray.from_arrays(ends, np.concatenate([x[i] for x in found])) for i in (0, 1)]
            yield pa.RecordBatch.from_arrays([b.column(0), *parts], ["grade", "slots", "values"])

    read = saved(rows.mapInArrow(run, "grade int, slots array<int>, values array<float>"), "features")
    held = read.select(F.explode(F.array_distinct("slots")).alias("slot")).groupBy("slot").agg(F.count(F.lit(1)).alias("n"))
    least = max(3, LEAST_SHARE * read.count())
    common = np.zeros(dimensions, bool)
    common[[r["slot"] for r in held.where(F.col("n") >= least).select("slot").collect()]] = True  # at most `dimensions`

    def shorten(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = ([], [])
            for slots, values in zip(b.column(1), b.column(2), strict=True):
                slots = slots.values.to_numpy()
                left = common[slots]
                out[0].append(slots[left].tobytes())
                out[1].append(values.values.to_numpy()[left].tobytes())
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(x, pa.binary()) for x in out)], ["grade", "slots", "values"])

    got = read.mapInArrow(shorten, "grade int, slots binary, values binary").collect()
    got.sort(key=lambda r: (r["grade"], r["slots"], r["values"]))
    grades = np.clip(np.array([r["grade"] for r in got], np.int64), 0, n_grades - 1)
    rows = [(np.frombuffer(r["slots"], np.int32), np.frombuffer(r["values"], np.float32)) for r in got]
    del got
    return fit(rows, grades, n_grades, dimensions)


def _scored(docs: DataFrame, text_col: str, model: Classifier, dimensions: int, keep: list[str]) -> DataFrame:
    """``keep`` columns, then _grade (expected) and _tail (P of the top grade)."""
    sent = docs.sparkSession.sparkContext.broadcast((model.weights.astype(np.float32), model.thresholds))
    rows = docs.select(F.col(text_col).cast("binary").alias("_text"), *[F.col(c) for c in keep])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weights, thresholds = sent.value
        here, tokens = Classifier(weights, thresholds), _Tokens(dimensions)
        for b in batches:
            scores = np.empty(b.num_rows)
            for i, t in enumerate(b.column(0)):
                slots, values = features(t.as_py(), tokens)
                scores[i] = float(np.dot(weights[slots].astype(np.float64), values))
            tails = here.tails(scores)
            yield pa.RecordBatch.from_arrays(
                [*b.columns[1:], pa.array(tails.sum(axis=1)), pa.array(tails[:, -1])], [*keep, "_grade", "_tail"]
            )

    added = [T.StructField("_grade", T.DoubleType()), T.StructField("_tail", T.DoubleType())]
    return rows.mapInArrow(run, T.StructType([*rows.schema.fields[1:], *added]))


def rate(
    docs: DataFrame,
    ratings: DataFrame,
    grade: Column,
    n_grades: int,
    *,
    id_col: str = "doc_id",
    text_col: str = "text",
    rating_id: str = "doc_id",
    least: float = 0.5,
    sample: int = SAMPLE,
    dimensions: int = DIMENSIONS,
) -> DataFrame:
    """One row per row of ``docs``: id, expected_grade, p_top, kept (p_top >= ``least``).

    ``grade`` maps a row of ``ratings`` to 0 .. n_grades - 1. Null and empty
    texts have one feature of their own. Rows may repeat, ids may be null;
    several ratings of a row all count; of rows that
    repeat a rated id, the fit reads one. Without ratings all rows are kept.
    Extra columns, whatever their names, play no part.
    """
    model = train(docs, ratings, grade, n_grades, id_col=id_col, text_col=text_col, rating_id=rating_id, sample=sample, dimensions=dimensions)
    rows = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_body"))
    return _scored(rows, "_body", model, dimensions, ["_id"]).select(
        F.col("_id").alias(id_col),
        F.col("_grade").alias("expected_grade"),
        F.col("_tail").alias("p_top"),
        (F.col("_tail") >= least).alias("kept"),
    )


def select(
    docs: DataFrame,
    ratings: DataFrame,
    grade: Column,
    n_grades: int,
    *,
    id_col: str = "doc_id",
    text_col: str = "text",
    rating_id: str = "doc_id",
    least: float = 0.5,
    sample: int = SAMPLE,
    dimensions: int = DIMENSIONS,
) -> DataFrame:
    """The rows of ``docs`` that :func:`rate` keeps, all columns."""
    model = train(docs, ratings, grade, n_grades, id_col=id_col, text_col=text_col, rating_id=rating_id, sample=sample, dimensions=dimensions)
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row")
    rows = docs.select(row, F.col(text_col).alias("_body"))
    return _scored(rows, "_body", model, dimensions, ["_row"]).where(F.col("_tail") >= least).select("_row.*")


def label_grade() -> Column:
    """Grade of a row of ``labels``: 0 poor, 1 sound but toxic, 2 sound."""
    return F.when(F.col("quality") == 0, 0).when(F.col("toxic") == 1, 1).when(F.col("quality").isNotNull(), 2)


N_GRADES = 3
