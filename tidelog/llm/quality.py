"""Quality by positive-unlabelled learning with a non-negative risk estimate.

Trusted positives are training rows with label 1; unlabelled rows are documents at large, label or not. The classifier
minimises  prior * R_p(+) + max(0, R_u(-) - prior * R_p(-)),  with the logistic loss and the gradient step of the
non-negative estimator where the second term falls below zero. The class prior is estimated from positives and unlabelled
texts alone: no share of the unlabelled that a first classifier scores above any threshold can be less than the prior
times that share of the positives, so the least quotient of the two shares, over thresholds that enough positives pass,
bounds the prior. Scores are shifted so that the prior's share of the unlabelled has one half or more. Features are rates over the whole text: of byte classes, of hashed words, of hashed runs of three
bytes, and lengths and repetition of words; labels, lang, source and doc_id are no features.
"""

from __future__ import annotations

from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import text_blocks, word_hashes, word_spans

#: Byte classes: lower-case letters, upper-case letters, digits, blanks, line ends, 14 kinds of punctuation, others, non-ASCII.
_MARKS = b".,!?'\"-*#$%&|@"


def _classes() -> np.ndarray:
    kind = np.full(256, 19, np.int64)
    for b in range(256):
        if 97 <= b <= 122:
            kind[b] = 0
        elif 65 <= b <= 90:
            kind[b] = 1
        elif 48 <= b <= 57:
            kind[b] = 2
        elif b in (9, 32):
            kind[b] = 3
        elif b in (10, 13):
            kind[b] = 4
        elif b >= 128:
            kind[b] = 20
    for k, b in enumerate(_MARKS):
        kind[b] = 5 + k
    return kind


_CLASS = _classes()
_K = 21
_STRETCH = 200  # words whose share of distinct ones is compared, whatever the text's length
_WORDS, _GRAMS = 512, 512  # buckets of words, and of runs of three bytes
_TAIL = _K + _K * _K
WIDTH = _TAIL + 9 + _WORDS + _GRAMS


def _distinct(name: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct words and words of each stretch of a text."""
    part = np.arange(len(name)) // _STRETCH
    order = np.lexsort((name, part))
    name, part = name[order], part[order]
    new = np.append(True, (name[1:] != name[:-1]) | (part[1:] != part[:-1]))
    return np.bincount(part[new]), np.bincount(part)


def features(column: pa.Array) -> np.ndarray:
    """A row for each text: log-scaled rates of byte classes, of neighbouring classes, of words and of runs of three bytes,
    and lengths and repetition of words."""
    n = len(column)
    out = np.zeros((n, WIDTH), np.float32)
    for row, data, offsets in text_blocks(column):
        kind = _CLASS[data]
        first, last, at = word_spans(data, offsets)
        words = (word_hashes(data, offsets, fold=True)[0] >> np.uint64(55)).astype(np.int64)
        low = data.astype(np.uint32)
        grams = (((low[:-2] << np.uint32(16)) | (low[1:-1] << np.uint32(8)) | low[2:]) * np.uint32(2654435761) >> np.uint32(23)).astype(np.int64) if len(data) > 2 else np.zeros(0, np.int64)
        for i in range(len(offsets) - 1):
            a, b = int(offsets[i]), int(offsets[i + 1])
            if a == b:
                continue
            k = kind[a:b]
            one = np.bincount(k, minlength=_K)
            two = np.bincount(k[:-1] * _K + k[1:], minlength=_K * _K)
            x = out[row + i]
            x[:_K] = np.log1p(one * (1000.0 / (b - a)))
            x[_K : _K + _K * _K] = np.log1p(two * (1000.0 / (b - a)))
            w = last[at[i] : at[i + 1]] - first[at[i] : at[i + 1]]
            tail = x[_TAIL : _TAIL + 9]
            x[_TAIL + 9 + _WORDS :] = np.log1p(np.bincount(grams[a : max(a, b - 2)], minlength=_GRAMS) * (1000.0 / (b - a)))
            tail[0] = np.log1p(b - a)
            tail[1] = np.log1p(len(w))
            if len(w):
                x[_TAIL + 9 : _TAIL + 9 + _WORDS] = np.log1p(np.bincount(words[at[i] : at[i + 1]], minlength=_WORDS) * (1000.0 / len(w)))
                s = first[at[i] : at[i + 1]]
                # words told apart by length, first and last byte and one in the middle
                name = w * (1 << 24) + data[s].astype(np.int64) * (1 << 16) + data[s + w - 1].astype(np.int64) * 256 + data[s + w // 2]
                tail[2] = w.mean()
                tail[3] = w.std()
                tail[4] = len(np.unique(name)) / len(w)
                distinct, size = _distinct(name)
                tail[5] = distinct.sum() / size.sum()
                tail[8] = (distinct / size).min()
                tail[6] = np.log1p(w.max())
                tail[7] = np.log1p(1000.0 * one[4] / len(w))
    return out


@dataclass(frozen=True)
class PositiveUnlabelled:
    """rows: bound of each of the two training samples; hidden: width of the model's layer; passed: least share of
    positives above a threshold that the prior is estimated at; hashed: how many times smaller hashed features are scaled."""

    rows: int = 6000
    hidden: int = 32
    epochs: int = 30
    passed: float = 0.5
    hashed: float = 4.0
    rate: float = 3e-3
    seed: int = 5


def train(positive: np.ndarray, unlabelled: np.ndarray, prior: float, p: PositiveUnlabelled) -> dict[str, np.ndarray]:
    """A two-layer network fitted by Adam on mini-batches of the non-negative risk."""
    rng = np.random.default_rng(p.seed)
    both = np.concatenate([positive, unlabelled])
    mean, scale = both.mean(0), both.std(0) + 1e-3
    scale[_TAIL + 9 :] *= p.hashed
    mean, scale = mean.astype(np.float32), scale.astype(np.float32)
    pos, unl = (np.clip((x - mean) / scale, -8, 8) for x in (positive, unlabelled))
    d = pos.shape[1]
    w = {"a": rng.normal(0, 1 / np.sqrt(d), (d, p.hidden)), "b": np.zeros(p.hidden), "c": rng.normal(0, 1 / np.sqrt(p.hidden), p.hidden), "e": np.zeros(1)}
    m, v = ({k: np.zeros_like(x) for k, x in w.items()} for _ in range(2))
    step = 0
    parts = max(1, len(unl) // 256)
    for _ in range(p.epochs):
        po, uo = rng.permutation(len(pos)), rng.permutation(len(unl))
        for k in range(parts):
            x = np.concatenate([pos[po[k::parts]], unl[uo[k::parts]]])
            n = len(po[k::parts])
            h = np.maximum(x @ w["a"] + w["b"], 0)
            z = h @ w["c"] + w["e"][0]
            up, down = 1 / (1 + np.exp(z)), 1 / (1 + np.exp(-z))  # of losses ln(1 + e^-z) and ln(1 + e^z)
            plus, minus = np.zeros(len(x)), np.zeros(len(x))
            plus[:n] = -prior * up[:n] / n
            minus[:n] = -prior * down[:n] / n
            minus[n:] = down[n:] / max(1, len(x) - n)
            risk = np.logaddexp(0, z[n:]).mean() - prior * np.logaddexp(0, z[:n]).mean()
            g = plus + minus if risk >= 0 else -minus
            grad = {"c": h.T @ g, "e": np.array([g.sum()])}
            back = np.outer(g, w["c"]) * (h > 0)
            grad |= {"a": x.T @ back, "b": back.sum(0)}
            step += 1
            for q in w:
                grad[q] = grad[q] + 1e-4 * w[q] * (q in "ac")
                m[q] = 0.9 * m[q] + 0.1 * grad[q]
                v[q] = 0.999 * v[q] + 0.001 * grad[q] ** 2
                w[q] = w[q] - p.rate * (m[q] / (1 - 0.9**step)) / (np.sqrt(v[q] / (1 - 0.999**step)) + 1e-8)
    return w | {"mean": mean, "scale": scale}


def predict(model: dict[str, np.ndarray], x: np.ndarray) -> np.ndarray:
    x = np.clip((x - model["mean"]) / model["scale"], -8, 8)
    z = np.maximum(x @ model["a"] + model["b"], 0) @ model["c"] + model["e"][0]
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def estimate_prior(positive: np.ndarray, unlabelled: np.ndarray, p: PositiveUnlabelled) -> float:
    """The share of positives among the unlabelled, from scores that a classifier gives rows it did not learn from."""
    if len(positive) < 20 or len(unlabelled) < 20:
        return 0.5
    up, uu = [], []
    for half in (0, 1):  # each half is scored by what the other one taught
        model = train(positive[half::2], unlabelled[half::2], 0.5, replace(p, epochs=max(1, p.epochs // 3)))
        up.append(predict(model, positive[1 - half :: 2]))
        uu.append(predict(model, unlabelled[1 - half :: 2]))
    pos, unl = np.sort(np.concatenate(up)), np.sort(np.concatenate(uu))
    at = np.unique(pos)
    share = 1 - np.searchsorted(pos, at, "left") / len(pos)
    among = 1 - np.searchsorted(unl, at, "left") / len(unl)
    enough = share >= p.passed
    return float(np.clip(np.min(among[enough] / share[enough]), 0.02, 0.98))


def train_shifted(positive: np.ndarray, unlabelled: np.ndarray, p: PositiveUnlabelled) -> dict[str, np.ndarray]:
    """Train with the estimated prior, and shift the scores so that this share of the unlabelled has one half or more."""
    prior = estimate_prior(positive, unlabelled, p)
    model = train(positive, unlabelled, prior, p)
    s = np.clip(predict(model, unlabelled).astype(np.float64), 1e-12, 1 - 1e-12)
    return model | {"e": model["e"] - np.quantile(np.log(s / (1 - s)), 1 - prior)}


def _learn(p: PositiveUnlabelled):
    def run(batches):
        kind, x = [], []
        for batch in batches:
            kind.append(batch.column(0).to_numpy())
            x.append(features(batch.column(1)))
        kind, x = np.concatenate(kind or [np.zeros(0)]), np.concatenate(x or [np.zeros((0, WIDTH), np.float32)])
        order = np.lexsort((*x.T[:8], kind))  # whatever the order of arrival
        kind, x = kind[order], x[order]
        pos, unl = x[kind == 1], x[kind == 0]
        if not len(pos) or not len(unl):
            pos = unl = np.concatenate([pos, unl, np.zeros((1, WIDTH), np.float32)])
        model = train_shifted(pos, unl, p)
        names = sorted(model)
        yield pa.RecordBatch.from_arrays([pa.array(names), pa.array([np.ascontiguousarray(model[k], np.float64).tobytes() for k in names], pa.binary())], ["name", "value"])

    return run


def fit(docs: DataFrame, labels: DataFrame, learn_from, params: PositiveUnlabelled = PositiveUnlabelled()) -> dict[str, np.ndarray]:
    """Train on bounded samples, in one task: ``rows`` positives and ``rows`` unlabelled texts, the first by a hash of doc_id.

    Of several texts with one doc_id the one with the least hash is taken.
    """
    p = params
    trusted = labels.where(learn_from(F.col("doc_id"))).where("quality = 1").select("doc_id").distinct()
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    at_large = texts.where(learn_from(F.col("doc_id"))).select("doc_id").distinct()
    ids = [d.orderBy(F.xxhash64(F.lit(s), "doc_id"), "doc_id").limit(p.rows).select("doc_id", F.lit(k).alias("kind")) for d, s, k in ((trusted, 3, 1), (at_large, 4, 0))]
    sample = texts.join(F.broadcast(ids[0].unionByName(ids[1])), "doc_id")  # 2 * rows ids
    sample = sample.groupBy("doc_id", "kind").agg(F.min(F.struct(F.xxhash64("text").alias("h"), "text")).alias("one")).select("kind", "one.text")
    found = {r.name: np.frombuffer(r.value) for r in sample.repartition(1).mapInArrow(_learn(p), "name string, value binary").collect()}  # fixed size
    if not found:  # no text at all
        z = np.zeros((1, WIDTH))
        found = train(z, z, 0.5, p)
    return found | {"a": found["a"].reshape(WIDTH, p.hidden)}


def score(docs: DataFrame, model: dict[str, np.ndarray], held_out) -> DataFrame:
    """One row per row of ``docs`` (doc_id, text): doc_id, held_out, score, predicted. Null and empty texts are scored too."""

    def run(batches):
        for batch in batches:
            for row in range(0, batch.num_rows, 1024):
                part = batch.slice(row, 1024)
                s = predict(model, features(part.column(2)))
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(s), pa.array((s >= 0.5).astype(np.int32))], ["doc_id", "held_out", "score", "predicted"])

    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), held_out(F.col("doc_id")).alias("held_out"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    return texts.mapInArrow(run, "doc_id long, held_out boolean, score double, predicted int")


def classify(docs: DataFrame, labels: DataFrame, held_out, params: PositiveUnlabelled = PositiveUnlabelled()) -> DataFrame:
    """Fit on rows that ``held_out`` (a function of the doc_id column) leaves, and score all.

    Whole texts are scored, however long, null and empty ones as empty. A null doc_id counts as held out. A doc_id with
    the label 1 among others is a positive; labels other than 1 are not looked at. Without positives or other texts the
    model says little. Repeated rows and equal texts get equal scores. Other columns are ignored, whatever their names.
    An empty table gives an empty result.
    """
    model = fit(docs, labels, lambda c: ~held_out(c), params)
    return score(docs, model, held_out)
