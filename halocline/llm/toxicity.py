"""Toxicity by non-negative positive-unlabelled learning.

A linear classifier is trained from confirmed toxic texts (P) and unlabelled texts (U) alone.
With class prior pi and loss l, the risk is ``pi E_P[l(f, +1)] + (E_U[l(f, -1)] - pi E_P[l(f, -1)])``;
the bracket estimates the risk on clean text and cannot truly be negative, so a minibatch in
which it is takes a step the other way on that part instead of fitting the unlabelled toxic
texts as clean.

U is every training text, whatever its label; P is at most ``MAX_POSITIVE`` rows of confirmed
ones. The prior too comes from P and U: a share pi of U is distributed like P, so no gram can
be rarer in U than pi times its rate in P, and the telling grams, which clean texts lack, come
close to that bound.

Features are the presence of 4- to 6-character n-grams of lower-cased letter runs with a mark
at either end (19-bit hashes made for a whole text at a time from its code points), of which
those whose document frequency differs most between P and U are kept: at most ``FEATURES``,
each with a log likelihood ratio of ``LEAST_GAIN`` or more. The features of all training rows
are written once; in each of ``ROUNDS`` rounds every task goes on from the common weights over
all of its rows, and the next weights are the means by rows. Scoring runs over every whole
text.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import add_columns, keep_rows, letters, materialize, slices

BITS, ORDERS = 19, (4, 5, 6)
#: Confirmed toxic rows that are learnt from: the one bound on the sample, which is of labelled rows.
MAX_POSITIVE = 8_000
FEATURES, LEAST_GAIN, TELLING = 2_048, 8.0, 32
#: Rows of a task in training, and how many of them are held and passed over until ``STEPS``
#: batches are done in a round, each row once at least.
TASK_ROWS, CHUNK = 65_536, 16_384
ROUNDS, STEPS, BATCH, RATE, DECAY = 4, 160, 512, 0.05, 1e-4
_FACTOR, _SPREAD, _MIX = np.uint32(0x01000193), np.uint32(0x9E3779B1), np.uint32(0x27D4EB2F)


def grams(text: str | None) -> np.ndarray:
    """Numbers of all n-grams of a text, repeats included."""
    code = np.frombuffer(f" {(text or '').lower()} ".encode("utf-32-le", "replace"), np.uint32)
    code = np.where(letters()[code], code, np.uint32(0))
    marks = np.concatenate(([0], np.cumsum(code == 0)))
    code = code + np.uint32(1)
    found, hashed = [], code
    for n in range(2, min(ORDERS[-1], len(code)) + 1):
        hashed = hashed[:-1] * _FACTOR + code[n - 1 :]
        if n in ORDERS:
            inside = marks[n - 1 : len(marks) - 1] - marks[1 : len(marks) - n + 1]
            found.append((hashed[inside == 0] + np.uint32(n) * _MIX) * _SPREAD >> np.uint32(32 - BITS))
    return np.concatenate(found).astype(np.int32) if found else np.zeros(0, np.int32)


@dataclass
class Model:
    table: np.ndarray  # hash -> feature or -1
    weights: np.ndarray
    bias: float
    prior: float

    def features(self, text: str | None) -> np.ndarray:
        """Distinct features of a text."""
        ids = self.table[grams(text)]
        return np.unique(ids[ids >= 0])

    def score(self, text: str | None) -> float:
        f = max(-700.0, self.bias) + self.weights[self.features(text)].sum()
        return float(1 / (1 + np.exp(-np.clip(f, -700, 700))))


class Sparse:
    """Rows of feature numbers: ``flat`` has those of row i from ``cut[i]`` to ``cut[i + 1]``."""

    def __init__(self, rows: list[bytes]) -> None:
        self.flat = np.frombuffer(b"".join(rows), np.uint16).astype(np.int64)
        self.cut = np.concatenate(([0], np.cumsum(np.fromiter(map(len, rows), np.int64, len(rows)) // 2)))

    def __len__(self) -> int:
        return len(self.cut) - 1

    def dot(self, w: np.ndarray, lo: int, hi: int) -> np.ndarray:
        """Sums of the weights of the rows lo to hi - 1."""
        total = np.concatenate(([0.0], np.cumsum(w[self.flat[self.cut[lo] : self.cut[hi]]])))
        at = self.cut[lo : hi + 1] - self.cut[lo]
        return total[at[1:]] - total[at[:-1]]

    def back(self, g: np.ndarray, lo: int, hi: int, size: int) -> np.ndarray:
        """For each feature the sum of the g of the rows lo to hi - 1 that have it."""
        own = self.flat[self.cut[lo] : self.cut[hi]]
        return np.bincount(own, np.repeat(g, np.diff(self.cut[lo : hi + 1])), size)


def _sigmoid(f: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(f, -30, 30)))


def _risk_step(p: Sparse, u: Sparse, at_p: tuple[int, int], at_u: tuple[int, int], w: np.ndarray, b: float, prior: float) -> tuple[np.ndarray, float]:
    """Gradient (of weights and bias) of the non-negative PU risk with the logistic loss on the
    rows ``at_p`` of P and ``at_u`` of U."""
    f_p, f_u = p.dot(w, *at_p) + b, u.dot(w, *at_u) + b
    toxic_p, toxic_u = _sigmoid(f_p), _sigmoid(f_u)
    clean = np.logaddexp(0, f_u).mean() - prior * np.logaddexp(0, f_p).mean()
    g_p, g_u = -prior * toxic_p / len(f_p), toxic_u / len(f_u)
    if clean >= 0:
        g_p = g_p + prior * (toxic_p - 1) / len(f_p)
    else:
        g_p, g_u = -g_p, -g_u
    return p.back(g_p, *at_p, len(w)) + u.back(g_u, *at_u, len(w)), g_p.sum() + g_u.sum()


def _descend(p: Sparse, u: Sparse, w: np.ndarray, b: float, prior: float, rng: np.random.Generator, rate: float) -> tuple[np.ndarray, float]:
    """``STEPS`` batches of U or more, in whole passes, each with one of P beside it, from the
    weights given."""
    w, m, v, mb, vb, t = w.copy(), np.zeros_like(w), np.zeros_like(w), 0.0, 0.0, 0
    cut_u, cut_p = list(range(0, len(u), BATCH)), list(range(0, len(p), BATCH))
    for _ in range(-(-STEPS // len(cut_u))):
        for at in rng.permutation(cut_u).tolist():
            some = cut_p[rng.integers(len(cut_p))]
            g, gb = _risk_step(p, u, (some, min(some + BATCH, len(p))), (at, min(at + BATCH, len(u))), w, b, prior)
            g, t = g + DECAY * w, t + 1
            m, v, mb, vb = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g, 0.9 * mb + 0.1 * gb, 0.99 * vb + 0.01 * gb * gb
            w -= rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.99**t)) + 1e-6)
            b -= rate * (mb / (1 - 0.9**t)) / (np.sqrt(vb / (1 - 0.99**t)) + 1e-6)
    return w, float(b)


def _sweep(made: DataFrame, positive: list[bytes], w: np.ndarray, b: float, prior: float, number: int) -> tuple[np.ndarray, float]:
    """Means by rows of the weights to which the tasks of ``made(ids)`` come from ``w`` and ``b``;
    they are summed in Spark, so what reaches the driver is one model."""

    def run(batches):
        p, own, bias, seen, held = Sparse(positive), w, b, 0, []
        rng = np.random.default_rng(number)

        def train():
            nonlocal own, bias, seen
            own, bias = _descend(p, Sparse(held), own, bias, prior, rng, RATE / (1 + number))
            seen += len(held)
            held.clear()

        for batch in batches:
            for ids in batch.column(0).to_pylist():
                held.append(ids)
                if len(held) == CHUNK:
                    train()
        if held:
            train()
        if seen:
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(own) + 2)), pa.array(np.append(own, [bias, 1.0]) * seen)], names=["at", "x"])

    summed = made.select("ids").mapInArrow(run, "at long, x double").groupBy("at").agg(F.sum("x").alias("x")).toArrow()
    flat = np.zeros(len(w) + 2)
    flat[summed.column(0).to_numpy()] = summed.column(1).to_numpy()
    return flat[:-2] / flat[-1], float(flat[-2] / flat[-1])


def _frequencies(rows: DataFrame) -> DataFrame:
    """``rows(text, positive)`` -> ``(gram, p, u)``: in how many rows of P and of all a gram is;
    under -1 the numbers of rows."""

    def run(batches):
        df, n = np.zeros((2, 1 << BITS), np.int64), np.zeros(2, np.int64)
        for b in slices(batches):
            for text, p in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                ids = np.unique(grams(text))
                df[1, ids] += 1
                df[0, ids] += p
                n += (p, 1)
        ids = np.flatnonzero(df[1])
        yield pa.RecordBatch.from_arrays([pa.array(np.append(ids, -1).astype(np.int32)), *(pa.array(np.append(df[i, ids], n[i])) for i in (0, 1))], names=["gram", "p", "u"])

    return materialize(rows.mapInArrow(run, "gram int, p long, u long").groupBy("gram").agg(F.sum("p").alias("p"), F.sum("u").alias("u")), "frequencies")


def fit(docs: DataFrame, labels: DataFrame, train: Column, max_positive: int = MAX_POSITIVE) -> Model:
    """Train from ``docs(doc_id, text)`` and ``labels(doc_id, toxic)``; ``train`` is a condition
    on doc_id, and labels outside it are never read, nor are those of clean texts.

    Rows with a null text or id are left out; a row that is repeated counts as often; labels of
    one id that differ make it toxic. Without a confirmed toxic text (or with an empty table) the
    model scores everything at 0. What reaches the driver is the kept grams, the features of at
    most ``max_positive`` rows, and one model a round.
    """
    docs, labels = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), labels.select(F.col("doc_id").cast("long").alias("doc_id"), "toxic")
    confirmed = labels.where(train & (F.col("toxic") == 1)).select("doc_id").distinct()
    chosen = materialize(confirmed.orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_positive), "positive")
    rows = docs.where(train & F.col("text").isNotNull()).join(F.broadcast(chosen.withColumn("positive", F.lit(True))), "doc_id", "left")
    rows = rows.select("text", F.coalesce("positive", F.lit(False)).alias("positive"))
    df = _frequencies(rows)
    totals = df.where("gram = -1").first()
    n_p, n_u = (totals.p, totals.u) if totals else (0, 0)
    table = np.full(1 << BITS, -1, np.int32)
    if not n_p:
        return Model(table, np.zeros(0), -np.inf, 0.0)
    p, u = (F.col("p") + 0.5) / (n_p + 1), (F.col("u") + 0.5) / (n_u + 1)
    gain = n_p * (p * F.log(p / u) + (1 - p) * F.log((1 - p) / (1 - u)))
    best = df.where("gram >= 0").select("gram", "p", "u", gain.alias("gain")).orderBy(F.desc("gain"), "gram").limit(FEATURES).collect()
    kept = [r for r in best if r.gain >= LEAST_GAIN] or best[:16]
    table[[r.gram for r in kept]] = np.arange(len(kept))
    prior = class_prior([(r.p, r.u) for r in kept], n_p, n_u)

    def features(batches):
        known = Model(table, np.zeros(0), 0.0, prior).features
        for b in slices(batches):
            ids = pa.array([known(t).astype(np.uint16).tobytes() for t in b.column(0).to_pylist()], pa.binary())
            yield pa.RecordBatch.from_arrays([ids, b.column(1)], names=["ids", "positive"])

    made = rows.mapInArrow(features, "ids binary, positive boolean").repartition(-(-n_u // TASK_ROWS))
    made = materialize(made, "features")
    positive = [bytes(r.ids) for r in made.where("positive").orderBy(F.xxhash64("ids"), "ids").limit(max_positive).collect()]
    positive = [positive[i] for i in np.random.default_rng(7).permutation(len(positive))]
    w, b = np.zeros(len(kept)), float(np.log(prior / (1 - prior)))
    for number in range(ROUNDS):
        w, b = _sweep(made, positive, w, b, prior, number)
    return Model(table, w, b, prior)


def class_prior(counts: list[tuple[int, int]], n_p: int, n_u: int) -> float:
    """Share of U that is distributed like P, from ``(rows of P, rows of U)`` with each kept gram,
    the most telling first: pooled over the ``TELLING`` first that are more frequent in P."""
    telling = [(p, u) for p, u in counts if p * n_u > u * n_p][:TELLING]
    if not telling:
        return 0.5
    return min(0.9, max(1e-3, sum(u for _, u in telling) * n_p / (n_u * sum(p for p, _ in telling))))


def score(docs: DataFrame, model: Model, names: tuple[str, str] = ("score", "predicted")) -> DataFrame:
    """All columns of ``docs`` plus, under ``names``, the score (0 to 1) and the prediction (1 if
    the score is 0.5 or more).

    A null or empty text is scored without features. Repeated rows come back repeated, an empty
    table gives an empty result, and existing columns of those names, in whatever case, are
    replaced.
    """
    def make(texts):
        s = np.array([model.score(t) for t in texts], float)
        return pa.array(s), pa.array((s >= 0.5).astype(np.int32))

    return add_columns(docs, ["text"], lambda: make, names, ("double", "int"))


def clean(docs: DataFrame, model: Model) -> DataFrame:
    """The rows of ``docs``, all columns whatever their names, that are not predicted toxic."""
    return keep_rows(docs, ["text"], lambda: lambda text: model.score(text) < 0.5)
