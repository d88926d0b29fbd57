"""Quality classifier: Naive Bayes support vectors on n-gram indicators.

Features are hashed: bytes in fours with their case, words and word pairs, and
the shapes "word repeats the one before" and "repeats the two before". A
feature counts once per text. Indicators are scaled by the log ratio of the
feature's smoothed share in good and in bad texts, each text is scaled to unit
length before that, and a linear hinge-loss model is fitted by dual coordinate
descent. A sigmoid fitted on margins of held-out halves turns a margin into a
probability. Model size: ``1 << bits`` floats, whatever the data.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .common import frugal, give_back, text_rows, with_text
from .textvec import ngram_hashes, slices, utf8, word_hashes

_REPEAT = np.array([0x1111, 0x2222], np.uint64)


def _bucket(h: np.ndarray, bits: int) -> np.ndarray:
    return (h * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(64 - bits)).astype(np.int32)


def indicators(arr: pa.Array, bits: int) -> Iterator[np.ndarray]:
    """Per text its distinct feature numbers below ``1 << bits``."""
    data, offsets = utf8(arr)
    last = np.zeros(1 << bits, np.int32)
    for i, j in slices(offsets):
        part = offsets[i : j + 1] - offsets[i]
        raw = data[offsets[i] : offsets[j]]
        wide = raw.astype(np.uint64)
        quads = wide[:-3] | wide[1:-2] << np.uint64(8) | wide[2:-1] << np.uint64(16) | wide[3:] << np.uint64(24) if len(raw) > 3 else wide[:0]
        quads = _bucket(quads + np.uint64(1), bits)
        words, at = word_hashes(raw, part)
        pairs, pair_at = ngram_hashes(words, at, 2)
        same = np.zeros(len(words), bool)
        same[1:] = words[1:] == words[:-1]
        same[at[:-1][at[:-1] < len(words)]] = False
        twice = same.copy()
        twice[1:] &= same[:-1]
        singles, doubles = _bucket(words, bits), _bucket(pairs, bits)
        repeat = _bucket(_REPEAT, bits)
        for k in range(j - i):
            found = [quads[part[k] : max(part[k], part[k + 1] - 3)], singles[at[k] : at[k + 1]], doubles[pair_at[k] : pair_at[k + 1]]]
            if same[at[k] : at[k + 1]].any():
                found.append(repeat[: 1 + twice[at[k] : at[k + 1]].any()])
            ids = np.concatenate(found)
            order = np.arange(len(ids), dtype=np.int32)
            last[ids] = order
            yield ids[last[ids] == order]


@dataclass
class QualityModel:
    weights: np.ndarray
    bias: float
    slope: float
    offset: float
    bits: int

    def margin(self, ids: np.ndarray) -> float:
        return self.bias + (float(self.weights[ids].sum()) / np.sqrt(len(ids)) if len(ids) else 0.0)

    def probability(self, margin: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.slope * margin + self.offset, -700, 700)))


def _descend(rows: list[np.ndarray], y: np.ndarray, ratio: np.ndarray, cost: float, epochs: int) -> tuple[np.ndarray, float]:
    """Dual coordinate descent for the hinge loss; both classes weigh the same in total."""
    w, bias, alpha = np.zeros_like(ratio), 0.0, np.zeros(len(rows))
    values = [ratio[r] / np.sqrt(max(len(r), 1)) for r in rows]
    norms = np.array([float(v @ v) + 1 for v in values])
    share = {s: len(y) / (2 * max((y == s).sum(), 1)) for s in (1, -1)}
    upper = np.array([cost * share[s] for s in y])
    rng = np.random.default_rng(7)
    for _ in range(epochs):
        worst = 0.0
        for i in rng.permutation(len(rows)):
            gradient = y[i] * (float(w[rows[i]] @ values[i]) + bias) - 1
            new = min(max(alpha[i] - gradient / norms[i], 0.0), upper[i])
            step = (new - alpha[i]) * y[i]
            if step:
                alpha[i] = new
                w[rows[i]] += step * values[i]
                bias += step
                worst = max(worst, abs(gradient))
        if worst < 1e-3:
            break
    return w, bias


def _sigmoid(margin: np.ndarray, good: np.ndarray) -> tuple[float, float]:
    """Slope and offset by Newton steps on smoothed targets."""
    n1, n0 = good.sum(), (~good).sum()
    target = np.where(good, (n1 + 1) / (n1 + 2), 1 / (n0 + 2))
    x = np.stack([margin, np.ones_like(margin)])
    theta = np.array([1.0, np.log((n1 + 1) / (n0 + 1))])

    def loss(t: np.ndarray) -> float:
        z = t @ x
        return float((np.logaddexp(0, z) - target * z).sum())

    for _ in range(60):
        p = 1 / (1 + np.exp(-np.clip(theta @ x, -500, 500)))
        gradient = x @ (p - target)
        step = np.linalg.solve((x * (p * (1 - p))) @ x.T + 1e-9 * np.eye(2), gradient)
        rate = 1.0
        while rate > 1e-6 and loss(theta - rate * step) > loss(theta):
            rate /= 2
        theta = theta - rate * step
        if np.abs(rate * step).max() < 1e-8:
            break
    return float(theta[0]), float(theta[1])


def log_count_ratios(rows: list[np.ndarray], good: np.ndarray, bits: int, smooth: float) -> np.ndarray:
    """For each feature the log of its smoothed share in good rows over that in bad ones."""
    counts = np.full((2, 1 << bits), smooth)
    for row, label in zip(rows, good):
        counts[int(label)][row] += 1
    return np.log(counts[1] / counts[1].sum()) - np.log(counts[0] / counts[0].sum())


def fit_rows(rows: list[np.ndarray], good: np.ndarray, bits: int, cost: float = 1.0, epochs: int = 20, smooth: float = 1.0) -> QualityModel:
    good = np.asarray(good, bool)
    if not len(rows) or good.all() or not good.any():  # nothing to tell apart: the smoothed share
        share = (good.sum() + 1) / (len(good) + 2)
        return QualityModel(np.zeros(1 << bits, np.float32), 0.0, 0.0, float(np.log(share / (1 - share))), bits)

    def once(which: np.ndarray) -> tuple[np.ndarray, float]:
        own = [rows[i] for i in which]
        ratio = log_count_ratios(own, good[which], bits, smooth)
        w, bias = _descend(own, np.where(good[which], 1, -1), ratio, cost, epochs)
        return w * ratio, bias

    fold, margin = np.zeros(len(rows), int), np.zeros(len(rows))
    for label in (True, False):  # halves with like shares
        own = np.flatnonzero(good == label)
        fold[own] = np.arange(len(own)) % 2
    for k in (0, 1):
        w, bias = once(np.flatnonzero(fold != k))
        for i in np.flatnonzero(fold == k):
            margin[i] = bias + (w[rows[i]].sum() / np.sqrt(len(rows[i])) if len(rows[i]) else 0)
    w, bias = once(np.arange(len(rows)))
    return QualityModel(w.astype(np.float32), bias, *_sigmoid(margin, good), bits)


def _extract(bits: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array([r.tobytes() for r in indicators(batch.column(3), bits)], pa.binary())], names=["h", "id", "good", "ids"])

    return run


def fit_quality(docs: DataFrame, labels: DataFrame, bits: int = 18, max_rows: int = 4000, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality") -> QualityModel:
    """Fit on at most ``max_rows`` labelled rows of ``docs``, those whose ids have the smallest hash.

    Rows with a null label or id are left out; a null text is empty. Rows that
    repeat an id count each, towards the bound too. With one class or no row, the
    score is a constant.
    """
    known = labels.where(F.col(label_col).isNotNull()).select(F.col(id_col).alias("__id"), (F.col(label_col) == 1).alias("good"))
    present = docs.select(F.col(id_col).alias("__id")).join(known, "__id").distinct()  # ids only: no text is shuffled
    chosen = present.orderBy(F.xxhash64("__id"), "__id", "good").limit(max_rows)
    sample = docs.join(F.broadcast(chosen), F.col(id_col) == F.col("__id")).select(  # at most max_rows ids
        F.xxhash64("__id").alias("h"), F.col("__id").cast("string").alias("id"), "good", F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text")
    )
    features = sample.mapInArrow(frugal(docs.sparkSession, _extract(bits)), "h long, id string, good boolean, ids binary")
    got = features.orderBy("h", "id", "good", "ids").limit(max_rows).select("good", "ids").toArrow()
    found = sorted(zip(got.column("good").to_pylist(), got.column("ids").to_pylist()))
    del got
    model = fit_rows([np.frombuffer(r, np.int32) for _, r in found], np.array([g for g, _ in found], bool), bits)
    del found
    give_back()
    return model


def score_quality(docs: DataFrame, model: QualityModel, text_col: str = "text", keep: list[str] | None = None, score_out: str = "score") -> DataFrame:
    """The columns ``keep`` of ``docs`` (all) and ``score_out``, the probability of the good label for each whole text.

    A null text is scored as an empty one; a text without features gets the
    score of the bias. A column of ``docs`` named as the score is replaced. An
    empty table gives an empty result.
    """
    held = docs.sparkSession.sparkContext.broadcast(model)
    carried = [c for c in (docs.columns if keep is None else keep) if c != score_out]
    base, at = with_text(docs, carried, text_col)
    schema = docs.select(*carried).schema.add(score_out, "double")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m, n = held.value, len(carried)
        for whole in batches:
            for i in range(0, whole.num_rows, 2000):
                batch = whole.slice(i, 2000)
                margins = np.array([m.margin(ids) for ids in indicators(batch.column(at), m.bits)])
                yield pa.RecordBatch.from_arrays([*batch.columns[:n], pa.array(m.probability(margins), pa.float64())], names=[*carried, score_out])

    return base.mapInArrow(frugal(docs.sparkSession, run), schema)


def quality_scores(docs: DataFrame, labels: DataFrame, threshold: float = 0.3, **fit) -> DataFrame:
    """doc_id, score and predicted (1 if the score is at least ``threshold``) of every document."""
    scored = score_quality(text_rows(docs), fit_quality(docs, labels, **fit), keep=["doc_id"])
    return scored.select("doc_id", "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
