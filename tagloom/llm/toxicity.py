"""Toxicity by non-negative positive-unlabelled learning.

A linear classifier over the set of words of a text (hashed) is trained with numpy from
confirmed toxic examples and unlabelled text. The risk is the class-prior-corrected one of
Kiryo et al. (2017): pi * R_p+ + max(0, R_u- - pi * R_p-).
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import held_out, table

BITS = 18
SIGMAS = 5
POSITIVES, UNLABELLED = 4000, 12000  # bounds of the training sample, rows
_FOLD = bytes(c + 32 if 65 <= c <= 90 else c if c >= 128 or 48 <= c <= 57 or 97 <= c <= 122 else 32 for c in range(256))


def words_of(text: str | None) -> set[bytes]:
    """Distinct words: ASCII letters (lower-cased) and digits, and all that is not ASCII."""
    return set((text or "").encode().translate(_FOLD).split())


def _features(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
    mask = (1 << BITS) - 1
    for texts in batches:
        yield pd.Series([[zlib.crc32(w) & mask for w in words_of(t)] for t in texts])


def training_sample(docs: DataFrame, labels: DataFrame, positives: int = POSITIVES, unlabelled: int = UNLABELLED) -> tuple[list, list, float]:
    """Feature lists of positive and of unlabelled training rows, and the class prior.

    Rows are drawn evenly by a hash of doc_id at a rate that gives about as many as the
    bounds; prior and rates come from counts over all training rows."""
    marks = labels.where("doc_id is not null and toxic is not null and not " + _TEST).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    n_marked, n_toxic = marks.agg(F.count("*"), F.coalesce(F.sum("toxic"), F.lit(0))).first()
    train = docs.where("not " + _TEST).select("doc_id", "text")
    n_train = train.count()
    even = lambda most, n: F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)) < int((1 << 30) * min(1.0, most / max(n, 1)))
    feats = F.pandas_udf(_features, "array<int>")
    chosen = marks.where("toxic = 1").where(even(positives, n_toxic)).select("doc_id")  # about `positives` rows at most
    pos = train.join(F.broadcast(chosen), "doc_id", "left_semi").select("doc_id", feats("text").alias("f")).toPandas()
    unl = train.where(even(unlabelled, n_train)).select("doc_id", feats("text").alias("f")).toPandas()
    tidy = lambda x: [np.asarray(f, np.int64) for f in x.sort_values("doc_id", kind="stable").f]
    return tidy(pos), tidy(unl), n_toxic / n_marked if n_marked else 0.0


_TEST = "crc32(cast(cast(doc_id as string) as binary)) % 5 = 0"


def fit(pos: list, unl: list, prior: float, epochs: int = 60, lr: float = 0.05, decay: float = 1e-4, seed: int = 7) -> tuple[np.ndarray, float]:
    """Weights and bias; without positive or unlabelled rows the model scores 0 for all."""
    w, b = np.zeros(1 << BITS), -6.0
    if not pos or not unl or not prior:
        return w, b
    b = float(np.log(prior / (1 - prior))) if prior < 1 else 0.0
    seen = []
    for rows in (pos, unl):
        seen.append(np.bincount(np.concatenate(rows).astype(np.int64), minlength=len(w)))
    p, u = (seen[0] + 0.5) / (len(pos) + 1), (seen[1] + 0.5) / (len(unl) + 1)
    # words that toxic examples hold more or less often than chance explains; others would be learned by heart
    keep = np.abs(p - u) >= SIGMAS * np.sqrt(u * (1 - np.minimum(u, 0.999)) * (1 / len(pos) + 1 / len(unl)))
    flat = lambda rows: (np.concatenate([f[keep[f]] for f in rows]).astype(np.int64), np.repeat(np.arange(len(rows)), [int(keep[f].sum()) for f in rows]))
    rng, m, v, mb, vb, step = np.random.default_rng(seed), np.zeros_like(w), np.zeros_like(w), 0.0, 0.0, 0
    n = max(1, min(len(pos), len(unl)) // 500)
    for _ in range(epochs):
        ps, us = np.array_split(rng.permutation(len(pos)), n), np.array_split(rng.permutation(len(unl)), n)
        for p, u in zip(ps, us):
            (fp, rp), (fu, ru) = flat([pos[i] for i in p]), flat([unl[i] for i in u])
            sp = 1 / (1 + np.exp(-np.clip(np.bincount(rp, w[fp], len(p)) + b, -30, 30)))
            su = 1 / (1 + np.exp(-np.clip(np.bincount(ru, w[fu], len(u)) + b, -30, 30)))
            # logistic loss: l(+) = -log s, l(-) = -log(1 - s)
            negative = np.mean(-np.log1p(-np.minimum(su, 1 - 1e-12))) - prior * np.mean(-np.log1p(-np.minimum(sp, 1 - 1e-12)))
            gp, gu = prior * (sp - 1) / len(p), su / len(u)
            gp = gp - prior * sp / len(p)
            if negative < 0:  # the corrected negative risk went below zero: step back from it
                gp, gu = prior * sp / len(p), -su / len(u)
            g = np.bincount(fp, gp[rp], len(w)) + np.bincount(fu, gu[ru], len(w)) + decay * w
            gb = gp.sum() + gu.sum()
            step += 1
            m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
            mb, vb = 0.9 * mb + 0.1 * gb, 0.999 * vb + 0.001 * gb * gb
            c1, c2 = 1 - 0.9**step, 1 - 0.999**step
            w -= lr * (m / c1) / (np.sqrt(v / c2) + 1e-6)
            b -= lr * (mb / c1) / (np.sqrt(vb / c2) + 1e-6)
    return w, b


def toxicity(docs: DataFrame, labels: DataFrame, positives: int = POSITIVES, unlabelled: int = UNLABELLED) -> DataFrame:
    """Score every row: doc_id, held_out, score, predicted.

    Learns only from rows whose crc32(doc_id) mod 5 is not 0. A null or empty text has no
    words and gets the model's bias as score. Without usable labels all scores are low.
    A null label is no label; of repeated labels the highest counts. Repeated rows are
    scored alike; other columns are not read."""
    w, b = fit(*training_sample(docs, labels, positives, unlabelled))
    keep = np.abs(w) > 1e-3
    shared = docs.sparkSession.sparkContext.broadcast((np.where(keep, w, 0).astype(np.float32), b))  # 1 MB

    def score(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        weights, bias = shared.value
        mask, known = (1 << BITS) - 1, {}
        for texts in batches:
            out = np.empty(len(texts))
            for k, t in enumerate(texts):
                total = bias
                for x in words_of(t):
                    weight = known.get(x)
                    if weight is None:
                        weight = float(weights[zlib.crc32(x) & mask])
                        if len(known) < 500_000:
                            known[x] = weight
                    total += weight
                out[k] = total
            yield pd.Series(1 / (1 + np.exp(-np.clip(out, -30, 30))))

    rows = docs.select("doc_id", held_out(F.col("doc_id"), 5, 0).alias("held_out"), F.pandas_udf(score, "double")(F.coalesce("text", F.lit(""))).alias("score"))
    return rows.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))


def without_toxic(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of docs that are not predicted toxic, with their columns: one pass, no join."""
    w, b = fit(*training_sample(docs, labels))
    shared = docs.sparkSession.sparkContext.broadcast((np.where(np.abs(w) > 1e-3, w, 0).astype(np.float32), b))

    def clean(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        weights, bias = shared.value
        for texts in batches:
            yield pd.Series([bias + weights[[zlib.crc32(x) & ((1 << BITS) - 1) for x in words_of(t)]].sum() < 0 for t in texts])

    return docs.where(F.pandas_udf(clean, "boolean")(F.coalesce("text", F.lit(""))))


def op10_toxicity(spark, sf_dir):
    return toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
