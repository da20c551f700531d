"""Language-model scoring with a hidden Markov model.

Words fall into a fixed number of classes by hash, so the model's tables have a
fixed size however large the vocabulary: states emit classes, and a class emits
its words in proportion to their smoothed counts. Every round of Baum-Welch
reads all training tokens: each task sums expected counts, the sums are added
up in slices over the tasks, and only the finished tables reach the driver.

A text's likelihood is exact. The forward recursion is a product of one matrix
per token; it is taken for all segments of all texts at once, scaled as it
goes, and then over the segments of each text.

Word counts never sit in one place either. Words that are frequent enough to
number at most ``HOT_WORDS`` are looked up where the texts are read; the others
are joined by word.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .frequent import least_count
from .scratch import Saved, saved

STATES = 4
ROUNDS = 8
#: A power of two; the class after the last stands for the end of a text, the next for padding.
CLASSES = 1 << 15
SEGMENT = 64
HOT_WORDS = 1 << 17
FOLDS, HELD_OUT = 7, 2
#: Weight, in tokens, of the overall distribution in each state's.
PRIOR = 100.0
_SEED = 42
_SLICES = 16
_RESCALE = 8
_MAX_ROWS = 1 << 15
_MAX_CACHED = 300_000


def words_of(text: bytes | None) -> list[bytes]:
    """Words of a UTF-8 text between runs of space and tab to carriage return, A to Z in lower case."""
    return (text or b"").lower().split()


class _Classes(dict):
    """Class of a word; remembers a bounded number of them."""

    def __init__(self, classes: int):
        self.mask = classes - 1

    def __missing__(self, word: bytes) -> int:
        found = xxhash.xxh64_intdigest(word, _SEED) & self.mask
        if len(self) < _MAX_CACHED:
            self[word] = found
        return found


class _Places(dict):
    """Place of a frequent word in the list of them, -1 of any other."""

    def __missing__(self, word: bytes) -> int:
        return -1


class Model:
    """start (K), move (K x K), emit (K x classes + 1): rows sum to one."""

    def __init__(self, start: np.ndarray, move: np.ndarray, emit: np.ndarray):
        self.start, self.move, self.emit = start, move, emit

    @classmethod
    def initial(cls, mass: np.ndarray, states: int, seed: int = 7) -> Model:
        """The overall distribution, shaken, and states that tend to last."""
        emit = mass * np.random.default_rng(seed).uniform(0.4, 1.6, (states, len(mass)))
        emit /= emit.sum(axis=1, keepdims=True)
        move = np.full((states, states), 0.05 / max(1, states - 1))
        np.fill_diagonal(move, 0.95 if states > 1 else 1.0)
        return cls(np.full(states, 1 / states), move, emit)

    def updated(self, counts: np.ndarray, moves: np.ndarray, starts: np.ndarray, overall: np.ndarray) -> Model:
        emit = counts + PRIOR * overall
        move, start = moves + 1e-3, starts + 1e-3
        return Model(
            start / start.sum(), move / move.sum(axis=1, keepdims=True), emit / emit.sum(axis=1, keepdims=True)
        )


def segments(texts: list[np.ndarray], pad: int, length: int = SEGMENT) -> tuple[np.ndarray, np.ndarray]:
    """Class ids cut into rows of ``length``, padded, and the number of rows of each text."""
    rows = np.array([-(-len(t) // length) for t in texts], dtype=np.int64)
    out = np.full((int(rows.sum()), length), pad, dtype=np.int32)
    flat, at = out.reshape(-1), 0
    for t, n in zip(texts, rows.tolist(), strict=True):
        flat[at : at + len(t)] = t
        at += n * length
    return out, rows


def expected_counts(model: Model, rows: np.ndarray, pad: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Forward-backward over padded segments, each a sequence from the start distribution."""
    k, (n, length) = len(model.start), rows.shape
    obs = np.ascontiguousarray(rows.T)
    emit = np.concatenate([model.emit, np.ones((k, 1))], axis=1).astype(np.float32)
    move, start = model.move.astype(np.float32), model.start.astype(np.float32)
    seen = np.empty((length, k, n), np.float32)
    ahead = np.empty((length, k, n), np.float32)
    last = np.repeat(start[:, None], n, axis=1)
    for t in range(length):
        np.take(emit, obs[t], axis=1, out=seen[t])
        last = (move.T @ last) * seen[t]
        seen[t] /= (scale := last.sum(axis=0))
        last /= scale
        ahead[t] = last
    moves = np.zeros((k, k))
    back = np.ones((k, n), np.float32)
    for t in range(length - 1, -1, -1):
        weighted = seen[t] * back
        before = ahead[t - 1] if t else np.repeat(start[:, None], n, axis=1)
        real = obs[t] != pad
        moves += (before @ np.where(real, weighted, 0).T) * move
        ahead[t] *= back
        back = move @ weighted
    starts = (start[:, None] * back).sum(axis=1, dtype=np.float64)
    flat = obs.reshape(-1)
    counts = np.stack([np.bincount(flat, weights=ahead[:, i, :].reshape(-1), minlength=pad + 1)[:pad] for i in range(k)])
    return counts, moves, starts


def log_likelihoods(start: np.ndarray, move: np.ndarray, emit: np.ndarray, texts: list[np.ndarray]) -> np.ndarray:
    """Natural log of the exact probability of each text; ``emit`` is K x ids, rows of ``texts`` hold ids."""
    k, pad = len(start), emit.shape[1]
    emit = np.concatenate([emit, np.ones((k, 1))], axis=1)
    rows, of = segments(texts, pad)
    total, products, logs = len(rows), np.empty((len(rows), k, k)), np.zeros(len(rows))
    for a in range(0, total, _MAX_ROWS):
        obs = np.ascontiguousarray(rows[a : a + _MAX_ROWS].T)
        length, n = obs.shape
        # product[i, j, r]: from state i before the segment to state j at its end
        product = np.repeat(np.eye(k)[:, :, None], n, axis=2)
        for t in range(length):
            product = np.matmul(move.T, product)
            np.multiply(product, emit[:, obs[t]][None], out=product)
            if t % _RESCALE == _RESCALE - 1 or t == length - 1:
                scale = product.max(axis=(0, 1))
                product /= scale
                logs[a : a + n] += np.log(scale)
                # padding after the end multiplies by the transition alone, which sums to one
        products[a : a + n] = product.transpose(2, 0, 1)
    first = np.concatenate(([0], np.cumsum(of)[:-1])) if len(of) else np.zeros(0, np.int64)
    order = np.argsort(-of, kind="stable")
    state, out = np.repeat(start[None, :], len(of), axis=0), np.zeros(len(of))
    for step in range(int(of.max()) if len(of) else 0):
        live = order[: int(np.searchsorted(-of[order], -step, side="left"))]
        at = first[live] + step
        now = np.einsum("ri,rij->rj", state[live], products[at])
        scale = now.sum(axis=1)
        state[live] = now / scale[:, None]
        out[live] += np.log(scale) + logs[at]
    return out


def _sorted_batches(batches: Iterator[pa.RecordBatch], column: int) -> Iterator[tuple[pa.RecordBatch, list]]:
    """Parts of batches with at most some millions of bytes of text."""
    for b in batches:
        sizes = np.array([len(x) if x is not None else 0 for x in b.column(column).to_pylist()])
        cut = (np.cumsum(sizes) // 16_000_000).tolist() if len(sizes) else []
        at = 0
        while at < len(cut):
            n = next((i for i in range(at, len(cut)) if cut[i] != cut[at]), len(cut)) - at
            part = b.slice(at, n)
            yield part, part.column(column).to_pylist()
            at += n


def word_counts(texts: DataFrame) -> DataFrame:
    """(word, c) over a column of binary texts; each task keeps a bounded table and passes it on when full."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: Counter[bytes] = Counter()

        def out():
            yield pa.RecordBatch.from_arrays(
                [pa.array(counts.keys(), pa.binary()).cast(pa.string()), pa.array(counts.values(), pa.int64())], ["word", "n"]
            )
            counts.clear()

        for b in batches:
            for text in b.column(0):
                counts.update(words_of(text.as_py()))
                if len(counts) > _MAX_CACHED:
                    yield from out()
        yield from out()

    return texts.mapInArrow(run, "word string, n long").groupBy("word").agg(F.sum("n").alias("c"))


def encode(texts: DataFrame, classes: int) -> DataFrame:
    """Texts as arrays of class ids, two bytes each, the end included."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = _Classes(classes)
        for b in batches:
            out = []
            for text in b.column(0):
                words = words_of(text.as_py())
                ids = np.empty(len(words) + 1, "<u2")
                ids[:-1] = np.fromiter(map(known.__getitem__, words), np.int64, len(words))
                ids[-1] = classes
                out.append(ids.tobytes())
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], ["ids"])

    return texts.mapInArrow(run, "ids binary")


def _step(encoded: DataFrame, model: Model, classes: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """One round's expected counts over all of ``encoded``."""
    spark, k, pad = encoded.sparkSession, len(model.start), classes + 1
    sent = spark.sparkContext.broadcast((model.start, model.move, model.emit))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        here = Model(*sent.value)
        sums = [np.zeros((k, pad)), np.zeros((k, k)), np.zeros(k)]
        for b, ids in _sorted_batches(batches, 0):
            rows, _ = segments([np.frombuffer(x, "<u2") for x in ids], pad)
            for a in range(0, len(rows), _MAX_ROWS // 4):
                for total, more in zip(sums, expected_counts(here, rows[a : a + _MAX_ROWS // 4], pad), strict=True):
                    total += more
        flat = np.concatenate([x.reshape(-1) for x in sums])
        parts = [x.astype("<f8").tobytes() for x in np.array_split(flat, _SLICES)]
        task = [TaskContext.get().partitionId()] * _SLICES
        yield pa.RecordBatch.from_arrays([pa.array(range(_SLICES), pa.int32()), pa.array(task, pa.int32()), pa.array(parts, pa.binary())], ["slice", "task", "sums"])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for b in batches:
            for i, x in zip(b.column(0).to_pylist(), b.column(2).to_pylist(), strict=True):
                sums[i] = sums.get(i, 0) + np.frombuffer(x, "<f8")
        yield pa.RecordBatch.from_arrays(
            [pa.array(sums.keys(), pa.int32()), pa.array([x.tobytes() for x in sums.values()], pa.binary())], ["slice", "sums"]
        )

    partial = encoded.mapInArrow(count, "slice int, task int, sums binary").repartition(_SLICES, "slice")
    # in the order of the tasks, so that reruns agree to the last digit
    added = partial.sortWithinPartitions("slice", "task").mapInArrow(add, "slice int, sums binary")
    parts = {r["slice"]: np.frombuffer(r["sums"], "<f8") for r in added.collect()}  # the model's size, whatever the corpus
    sent.destroy()
    flat = np.concatenate([parts[i] for i in range(_SLICES)]) if parts else np.zeros(k * pad + k * k + k)
    return flat[: k * pad].reshape(k, pad), flat[k * pad : k * pad + k * k].reshape(k, k), flat[k * pad + k * k :]


def train(encoded: DataFrame, mass: np.ndarray, states: int = STATES, rounds: int = ROUNDS) -> Model:
    """Baum-Welch from a fixed start; ``mass`` is the smoothed count of each class, the end's last."""
    overall = mass / mass.sum()
    model = Model.initial(overall, states)
    for _ in range(rounds):
        model = model.updated(*_step(encoded, model, len(mass) - 1), overall)
    return model


def score(
    docs: DataFrame,
    *,
    id_col: str = "doc_id",
    text_col: str = "text",
    states: int = STATES,
    rounds: int = ROUNDS,
    classes: int = CLASSES,
    hot_words: int = HOT_WORDS,
    folds: int = FOLDS,
    held_out: int = HELD_OUT,
) -> DataFrame:
    """One row per row of ``docs``: id, held_out, n_tokens, n_known, train_tokens, base_score, score.

    Learns from rows whose crc32(id as text) mod ``folds`` is not ``held_out``
    (a null id counts as the empty text). Null and empty texts are an end
    alone. Scores are log10. Rows may repeat. Extra columns, whatever their
    names, play no part. Where no row is left to learn from, every word is
    unknown and the model is its fixed start. An empty table gives no rows.
    """
    spark = docs.sparkSession
    fold = F.pmod(F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")), F.lit(folds))
    rows = docs.select(
        F.col(text_col).cast("binary").alias("_text"), (fold == held_out).alias("_held"), F.col(id_col).alias("_id")
    )
    learn = rows.where(~F.col("_held")).select("_text")
    encoded = Saved(encode(learn, classes), "encoded")
    counts = saved(word_counts(learn), "counts")
    n_docs = encoded.df.count()
    sums = counts.agg(F.sum("c").alias("n"), F.count(F.lit(1)).alias("v")).first()
    n_train, vocabulary = (sums["n"] or 0) + n_docs, sums["v"] + (n_docs > 0)
    mass = np.ones(classes + 1)
    of_class = F.xxhash64("word").bitwiseAND(F.lit(classes - 1)).alias("class")
    for r in counts.groupBy(of_class).agg(F.sum(F.col("c") + 1).alias("m")).collect():  # at most `classes` rows
        mass[r["class"]] += r["m"]
    mass[classes] = n_docs + 1
    model = train(encoded.df, mass, states, rounds if n_docs else 0)
    encoded.drop()
    least = least_count(counts, hot_words)
    hot = [(r["word"].encode(), r["c"]) for r in counts.where(F.col("c") >= least).toLocalIterator()]  # at most `hot_words`
    sent = spark.sparkContext.broadcast(
        (model.start, model.move, model.emit / mass, [w for w, _ in hot], np.log10(np.array([c for _, c in hot], np.float64) + 1))
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        start, move, emit, frequent, frequent_logs = sent.value
        places = _Places((w, i) for i, w in enumerate(frequent))
        place_class = np.array([xxhash.xxh64_intdigest(w, _SEED) & (classes - 1) for w in frequent], np.int32)
        known = _Classes(classes)
        for b, texts in _sorted_batches(batches, 0):
            ids, sizes, logs, hits, words, times, offsets = [], [], [], [], [], [], [0]
            for text in texts:
                tokens = words_of(text)
                place = np.fromiter(map(places.__getitem__, tokens), np.int64, len(tokens))
                others = np.flatnonzero(place < 0)
                rest = [tokens[i] for i in others.tolist()]
                of = np.empty(len(tokens) + 1, np.int32)
                if len(rest) < len(tokens):
                    of[:-1] = place_class[place]
                of[others] = np.fromiter(map(known.__getitem__, rest), np.int64, len(rest))
                of[-1] = classes
                ids.append(of)
                for w, n in Counter(rest).items():
                    words.append(w)
                    times.append(n)
                sizes.append(len(of))
                logs.append(math.log10(n_docs + 1) + float(frequent_logs[place[place >= 0]].sum()))
                hits.append(len(tokens) - len(rest) + (n_docs > 0))
                offsets.append(len(words))
            pairs = pa.StructArray.from_arrays(
                [pa.array(words, pa.binary()).cast(pa.string()), pa.array(times, pa.int64())], ["word", "n"]
            )
            yield pa.RecordBatch.from_arrays(
                [b.column(1), b.column(2), b.column(3), pa.array(sizes, pa.int64()), pa.array(hits, pa.int64()),
                 pa.array(logs, pa.float64()), pa.array(log_likelihoods(start, move, emit, ids), pa.float64()),
                 pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pairs)],
                ["_held", "_id", "_row", "_size", "_hits", "_log", "_path", "_rest"],
            )

    given = rows.withColumn("_row", F.monotonically_increasing_id())
    pair = T.StructType([T.StructField("word", T.StringType()), T.StructField("n", T.LongType())])
    schema = T.StructType(
        [*given.schema.fields[1:], T.StructField("_size", T.LongType()), T.StructField("_hits", T.LongType()),
         T.StructField("_log", T.DoubleType()), T.StructField("_path", T.DoubleType()), T.StructField("_rest", T.ArrayType(pair))]
    )
    read = saved(given.mapInArrow(run, schema), "scored")
    rare = read.select("_row", F.explode("_rest").alias("p")).select("_row", "p.word", "p.n")
    found = rare.join(counts.where(F.col("c") < least), "word")  # words that no row is known of add log10(1) = 0
    added = found.groupBy("_row").agg(
        F.sum("n").alias("_more"), F.sum(F.col("n") * F.log10((F.col("c") + 1).cast("double"))).alias("_more_log")
    )
    log = F.col("_log") + F.coalesce("_more_log", F.lit(0.0))
    return read.drop("_rest").join(added, "_row", "left").select(
        F.col("_id").alias(id_col),
        F.col("_held").alias("held_out"),
        F.col("_size").alias("n_tokens"),
        (F.col("_hits") + F.coalesce("_more", F.lit(0))).alias("n_known"),
        F.lit(n_train).cast("long").alias("train_tokens"),
        (log - F.col("_size") * F.lit(math.log10(n_train + vocabulary + 1))).alias("base_score"),
        (log + F.col("_path") / F.lit(math.log(10))).alias("score"),
    )
