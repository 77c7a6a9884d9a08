"""Quality classifier: positive-unlabelled learning by the non-negative unbiased risk."""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import tokens
from .common import table

HASHED = 256
DENSE = 26
BATCH_BYTES = 1 << 20
_CLASS = np.zeros((8, 256), bool)
for _row, _chars in enumerate((b"#*$%&<>", b"|", b"!", b"?.,;:", b"0123456789", b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"\n", b"@=/_{}[]\\~^+")):
    _CLASS[_row, list(_chars)] = True


def features(texts: pa.Array) -> np.ndarray:
    """One float32 row per text: 26 shape measures of the whole text and 256 hashed word frequencies."""
    data, at = tokens.text_bytes(texts)
    starts, ends, first = tokens.word_spans(data, at)
    hashes = tokens.hash_spans(data, starts, ends)
    n_docs = len(at) - 1
    n = np.diff(first).astype(np.float32)
    n1, n_bytes = np.maximum(n, 1), np.maximum(np.diff(at), 1).astype(np.float32)
    doc = np.repeat(np.arange(n_docs), np.diff(first))
    out = np.zeros((n_docs, DENSE + HASHED), np.float32)

    def sums(values: np.ndarray, of: np.ndarray) -> np.ndarray:
        return np.bincount(of, weights=values, minlength=n_docs).astype(np.float32)

    def distinct(values: np.ndarray, of: np.ndarray) -> np.ndarray:
        tagged = np.unique(tokens.mix(values + of.astype(np.uint64) * np.uint64(tokens.BASE)) & ~np.uint64(0xFFFFF) | (of.astype(np.uint64) & np.uint64(0xFFFFF)))
        return np.bincount((tagged & np.uint64(0xFFFFF)).astype(np.int64), minlength=n_docs).astype(np.float32)

    length = (ends - starts).astype(np.float32)
    out[:, 0] = np.log1p(n)
    out[:, 1] = sums(length, doc) / n1 / 10
    out[:, 2] = np.sqrt(np.maximum(sums(length**2, doc) / n1 - (out[:, 1] * 10) ** 2, 0)) / 10
    out[:, 3] = distinct(hashes, doc) / n1
    trigrams, tri_first = tokens.shingles(hashes, first, 3)
    tri_doc = np.repeat(np.arange(n_docs), np.diff(tri_first))
    out[:, 4] = distinct(trigrams, tri_doc) / np.maximum(np.diff(tri_first), 1)
    if len(hashes):
        same = (hashes[1:] == hashes[:-1]) & (doc[1:] == doc[:-1])
        out[:, 5] = sums(same.astype(np.float32), doc[1:]) / n1
        last, head = data[ends - 1], data[starts]

        def per_text(flags: np.ndarray) -> np.ndarray:
            # One running count at a time: few bytes of memory per byte of text.
            run = np.zeros(len(flags) + 1, np.int32)
            np.cumsum(flags, out=run[1:])
            return (run[at[1:]] - run[at[:-1]]) / n_bytes

        for k, c in enumerate(_CLASS):
            out[:, 6 + k] = per_text(c[data])
            if k in (0, 1, 2, 5):
                out[:, 14 + (0, 1, 2, 5).index(k)] = sums(c[last], doc) / n1
        out[:, 18] = sums(_CLASS[5][head], doc) / n1
        out[:, 19] = sums((length == 1).astype(np.float32), doc) / n1
        out[:, 20] = sums((length > 15).astype(np.float32), doc) / n1
        out[:, 21] = per_text(data >= 128)
        out[:, 22] = np.minimum(out[:, 14] * 4, 1)
        out[:, 23] = np.minimum(out[:, 16] * 4, 1)
        out[:, 24] = np.minimum(out[:, 15] * 4, 1)
        out[:, 25] = np.minimum(out[:, 5] * 4, 1)
        bag = np.bincount(doc * HASHED + (hashes & np.uint64(HASHED - 1)).astype(np.int64), minlength=n_docs * HASHED)
        bag = np.sqrt(bag.reshape(n_docs, HASHED) / n1[:, None])
        out[:, DENSE:] = bag
    return out


@dataclass
class Model:
    """A one-hidden-layer network over standardised features; its sigmoid estimates P(good | text)."""

    mean: np.ndarray
    scale: np.ndarray
    w1: np.ndarray
    b1: np.ndarray
    w2: np.ndarray
    b2: float
    prior: float

    def logits(self, x: np.ndarray) -> np.ndarray:
        return np.tanh(np.clip((x - self.mean) * self.scale, -8, 8) @ self.w1 + self.b1) @ self.w2 + self.b2

    def scores(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.logits(x).astype(np.float64), -40, 40)))


def estimate_prior(positive: np.ndarray, unlabelled: np.ndarray, gamma: float = 0.01, delta: float = 0.1) -> float:
    """Best-bin estimate of the share of positives among unlabelled, from scores of rows not fitted on.

    The ratio of the shares above a threshold bounds the prior from above; the threshold is the one of the
    least ratio plus its confidence width.
    """
    cuts = np.sort(positive)
    q_p = 1 - np.arange(len(cuts)) / len(cuts)
    q_u = 1 - np.searchsorted(np.sort(unlabelled), cuts) / len(unlabelled)
    width = np.sqrt(np.log(4 / delta) / 2) * (1 / np.sqrt(len(positive)) + 1 / np.sqrt(len(unlabelled)))
    ratio = q_u / q_p
    best = int(np.argmin(ratio + (1 + gamma) * width / q_p))
    return float(np.clip(ratio[best], 0.02, 0.98))


def fit_pu(positive: np.ndarray, unlabelled: np.ndarray, prior: float, hidden: int = 32, epochs: int = 60, decay: float = 1e-4, seed: int = 7) -> Model:
    """Minimises prior * E_p[l(f)] + max(0, E_u[l(-f)] - prior * E_p[l(-f)]) with the logistic loss l.

    Where the second part of a batch turns negative, the step ascends it instead (non-negative correction).
    """
    rng = np.random.default_rng(seed)
    both = np.vstack([positive, unlabelled])
    mean, sd = both.mean(0), both.std(0)
    scale = (1 / np.maximum(sd, 1e-3)).astype(np.float32)
    # Hashed word frequencies are many and weak; the shape measures are few and strong.
    scale[DENSE:] *= 0.1
    prep = lambda x: np.clip((x - mean) * scale, -8, 8).astype(np.float32)
    p, u = prep(positive), prep(unlabelled)
    d = p.shape[1]
    params = [rng.normal(0, 1 / np.sqrt(d), (d, hidden)), np.zeros(hidden), rng.normal(0, 1 / np.sqrt(hidden), hidden), np.array(0.0)]
    first, second = [np.zeros_like(w) for w in params], [np.zeros_like(w) for w in params]
    size_p, steps = min(256, len(p)), 0
    sig = lambda z: 1 / (1 + np.exp(-np.clip(z, -40, 40)))
    for epoch in range(epochs):
        order = rng.permutation(len(u))
        for lo in range(0, len(u), 512):
            bu, bp = u[order[lo : lo + 512]], p[rng.integers(0, len(p), size_p)]
            x = np.vstack([bp, bu])
            h = np.tanh(x @ params[0] + params[1])
            f = h @ params[2] + params[3]
            fp, fu = f[: len(bp)], f[len(bp) :]
            negative = np.logaddexp(0, fu).mean() - prior * np.logaddexp(0, fp).mean()
            g = np.empty_like(f)
            if negative >= 0:
                g[: len(bp)] = prior * (-sig(-fp) - sig(fp)) / len(bp)
                g[len(bp) :] = sig(fu) / len(bu)
            else:
                g[: len(bp)] = prior * sig(fp) / len(bp)
                g[len(bp) :] = -sig(fu) / len(bu)
            back = np.outer(g, params[2]) * (1 - h**2)
            grads = [x.T @ back, back.sum(0), h.T @ g, g.sum()]
            steps += 1
            rate = 2e-3 * (1 - epoch / epochs)
            for k, grad in enumerate(grads):
                grad = grad + decay * params[k]
                first[k] = 0.9 * first[k] + 0.1 * grad
                second[k] = 0.999 * second[k] + 0.001 * grad**2
                params[k] = params[k] - rate * (first[k] / (1 - 0.9**steps)) / (np.sqrt(second[k] / (1 - 0.999**steps)) + 1e-8)
    w1, b1, w2, b2 = params
    return Model(mean, scale, w1.astype(np.float32), b1.astype(np.float32), w2.astype(np.float32), float(b2), prior)


def _feature_rows(docs: DataFrame) -> np.ndarray:
    def run(it):
        for batch in it:
            texts = batch.column(0)
            for i, j in tokens.batches(texts, BATCH_BYTES):
                yield pa.record_batch([pa.array([r.tobytes() for r in features(texts.slice(i, j - i))], pa.binary())], ["x"])

    rows = docs.select("text").mapInArrow(run, "x binary").collect()
    return np.frombuffer(b"".join(r["x"] for r in rows), np.float32).reshape(len(rows), DENSE + HASHED)


def remainder(doc_id: Column, modulus: int) -> Column:
    return F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(modulus))


def train(docs: DataFrame, labels: DataFrame, train_rows: Column, max_positive: int = 4000, least_unlabelled: int = 8000) -> Model:
    """Fits on at most ``max_positive`` trusted positives (quality = 1) and on unlabelled documents, of which it takes
    four times the root of their number, ``least_unlabelled`` at least: the risk's error falls as the root of that,
    and what one process fits stays small (280,000 rows of 1.1 kB from 5e9 documents).

    Both samples are the rows of least hash among those ``train_rows`` admits; labels of 0 are never read. A
    model of the prior alone (score 0.5 at least) comes back when either sample has under 20 rows, an empty table
    among them. Null doc_ids are not learnt from; repeated ids count once; texts are read whole.
    """
    tokens.small_batches(docs.sparkSession)
    order = F.xxhash64(F.lit("pu"), "doc_id")
    trusted = labels.where("quality = 1").select("doc_id").where(train_rows & F.col("doc_id").isNotNull()).distinct()
    plain = docs.select("doc_id").where(train_rows & F.col("doc_id").isNotNull())
    max_unlabelled = max(least_unlabelled, 4 * math.isqrt(plain.count()))
    pick = lambda ids, n: F.broadcast(ids.orderBy(order, "doc_id").limit(n))  # noqa: E731  (bounded by n)
    x_p = _feature_rows(docs.join(pick(trusted, max_positive), "doc_id", "left_semi").orderBy("doc_id"))
    x_u = _feature_rows(docs.join(pick(plain.distinct(), max_unlabelled), "doc_id", "left_semi").orderBy("doc_id"))
    x_p, x_u = x_p[:max_positive], x_u[:max_unlabelled]
    if min(len(x_p), len(x_u)) < 20:
        d = DENSE + HASHED
        z = np.zeros(d, np.float32)
        return Model(z, z, np.zeros((d, 1), np.float32), np.zeros(1, np.float32), np.zeros(1, np.float32), 0.0, 0.5)
    rng = np.random.default_rng(11)
    x_p, x_u = x_p[rng.permutation(len(x_p))], x_u[rng.permutation(len(x_u))]
    # The prior comes from a model fitted on one half and applied to the other.
    hp, hu = len(x_p) // 2, len(x_u) // 2
    half = fit_pu(x_p[:hp], x_u[:hu], 0.5, epochs=15)
    prior = estimate_prior(half.logits(x_p[hp:]), half.logits(x_u[hu:]))
    return fit_pu(x_p, x_u, prior)


def scorer(model: Model):
    """A column function of the text: P(good | text)."""

    @F.arrow_udf(T.DoubleType())
    def score(texts: pa.Array) -> pa.Array:
        parts = [model.scores(features(texts.slice(i, j - i))) for i, j in tokens.batches(texts, BATCH_BYTES)]
        return pa.array(np.concatenate(parts) if parts else np.empty(0), pa.float64())

    return score


def score_quality(docs: DataFrame, model: Model) -> DataFrame:
    """``docs`` plus ``score`` and ``predicted``. Only the text is read: null counts as empty, and an empty
    text gets the model's score of zero words. Texts of any length are scored whole; equal texts have equal scores;
    an empty table gives an empty result; clashing columns are replaced."""
    tokens.small_batches(docs.sparkSession)
    return docs.withColumn("score", scorer(model)(F.col("text"))).withColumn("predicted", (F.col("score") >= 0.5).cast("int"))


def op1_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores of every row of ``documents``; edge cases as for ``train`` and ``score_quality``."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = train(docs, table(spark, sf_dir, "labels"), remainder(F.col("doc_id"), 3) != 1)
    scored = score_quality(docs, model)
    held_out = F.coalesce(remainder(F.col("doc_id"), 3) == 1, F.lit(False))
    return scored.select("doc_id", held_out.alias("held_out"), "score", "predicted")
