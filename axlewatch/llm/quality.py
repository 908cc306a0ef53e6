"""Quality classifier by positive-unlabelled learning with the non-negative risk.

Trusted positives (labels of quality 1) and unlabelled documents train a linear model on statistics of the text. With
the prior p of positives, the risk is p * R(positives as 1) + max(0, R(unlabelled as 0) - p * R(positives as 0)); when the
bracket falls below zero, the step instead undoes the overfitting. The prior is estimated without labelled negatives: a first model is fitted
on half of either sample, and on the other half the share of unlabelled documents above a score, over that of positives, bounds the prior
at every score; the score of the least upper bound gives the estimate. Samples of under LEAST_HALF in a half leave it at 0.5.

The fit sees about `fit_rows` positives and `fit_rows` unlabelled documents at most (a documented bound; they are chosen by a
hash of doc_id, and rows of one doc_id are one document, that of the least features); every document is scored over its whole text.

Defined results: a null text counts as empty and gets the score of an empty text; without trusted positives all scores are 0.5; a
null doc_id is not held out; rows repeat as in the input; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

FIT_ROWS = 20_000
LEAST_HALF = 50
MARKS = b"#*$%&|<>!=+@_~^/\\{}[]"


def features(text: str | None) -> np.ndarray:
    """Statistics of one text, all of it; shares rather than counts, so that length alone says little."""
    raw = (text or "").encode("utf-8", "surrogatepass")
    counts = np.bincount(np.frombuffer(raw, dtype=np.uint8), minlength=256).astype(np.float64)
    n = max(len(raw), 1)
    words = raw.split()
    w = max(len(words), 1)
    distinct = len(set(words))
    lines = [x for x in raw.split(b"\n") if x.strip()]
    upper, lower, digit = counts[65:91].sum(), counts[97:123].sum(), counts[48:58].sum()
    marks = counts[list(MARKS)]
    stops = counts[46] + counts[33] + counts[63]
    return np.array(
        [
            np.log1p(len(words)),
            len(raw) / w,
            (len(raw) / w) ** 0.5,
            distinct / w,
            1.0 if w < 10 else 0.0,
            np.log1p(len(lines)),
            len(set(lines)) / max(len(lines), 1),
            upper / max(upper + lower, 1),
            digit / n,
            counts[44] / w,
            stops / w,
            counts[128:].sum() / n,
            marks.sum() / w,
            *np.minimum(marks / w, 3.0),
            counts[46] / w,
            sum(x[:1].isupper() for x in words) / w,
            distinct / np.sqrt(w),
        ]
    )


N_FEATURES = 13 + len(MARKS) + 3


def pu_risk(w: np.ndarray, p: np.ndarray, u: np.ndarray, prior: float) -> tuple[float, float, np.ndarray, np.ndarray]:
    """(risk of positives as 1, risk of negatives, and the gradient of each) of the logistic loss; both carry their share of the prior."""
    sig = lambda z: 1 / (1 + np.exp(-np.clip(z, -30, 30)))
    soft = lambda z: np.logaddexp(0, z)
    zp, zu = p @ w, u @ w
    g_pos = prior * (p.T @ (sig(zp) - 1)) / len(p)
    g_neg = (u.T @ sig(zu)) / len(u) - prior * (p.T @ sig(zp)) / len(p)
    return prior * soft(-zp).mean(), soft(zu).mean() - prior * soft(zp).mean(), g_pos, g_neg


def fit_nnpu(pos: np.ndarray, unl: np.ndarray, prior: float, steps: int = 600, rate: float = 0.05, decay: float = 1e-4) -> dict:
    """Linear weights on standardised, clipped features and their squares, fitted to the non-negative risk by Adam."""
    mean, scale = unl.mean(axis=0), unl.std(axis=0) + 1e-6

    def expand(x: np.ndarray) -> np.ndarray:
        z = np.clip((x - mean) / scale, -6, 6)
        return np.hstack([z, z * z / 6, np.ones((len(z), 1))])

    p, u = expand(pos), expand(unl)
    w, m, v = np.zeros(p.shape[1]), 0.0, 0.0
    for t in range(1, steps + 1):
        _, negatives, g_pos, g_neg = pu_risk(w, p, u, prior)
        g = (g_pos + g_neg if negatives >= 0 else -g_neg) + decay * w
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        w = w - rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
    return {"mean": mean, "scale": scale, "w": w}


def estimated_prior(pos: np.ndarray, unl: np.ndarray, delta: float = 0.1) -> float:
    """The share of positives among the unlabelled, from the scores of both in halves that the scoring model wasn't fitted on."""
    if min(len(pos), len(unl)) < 2 * LEAST_HALF:
        return 0.5
    first = fit_nnpu(pos[::2], unl[::2], 0.5)
    p, u = np.sort(score_of(first, pos[1::2])), np.sort(score_of(first, unl[1::2]))
    cuts = np.unique(p)
    above_p, above_u = 1 - np.searchsorted(p, cuts) / len(p), 1 - np.searchsorted(u, cuts) / len(u)
    slack = np.sqrt(np.log(4 / delta) / 2) * (1 / np.sqrt(len(p)) + 1 / np.sqrt(len(u)))
    best = int(np.argmin((above_u + slack) / above_p))
    return float(np.clip(above_u[best] / above_p[best], 0.01, 0.99))


def score_of(model: dict | None, x: np.ndarray) -> np.ndarray:
    if model is None:
        return np.full(len(x), 0.5)
    z = np.clip((x - model["mean"]) / model["scale"], -6, 6)
    return 1 / (1 + np.exp(-np.clip(np.hstack([z, z * z / 6, np.ones((len(z), 1))]) @ model["w"], -30, 30)))


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string")) % 3 == 1, F.lit(False))


def _share(doc_id: Column, share: float) -> Column:
    """Keeps that share of ids, by hash."""
    return F.pmod(F.xxhash64(F.lit("fit"), doc_id), F.lit(1_000_000)) < F.lit(int(share * 1_000_000))


def _featured(docs: DataFrame) -> DataFrame:
    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = pa.array([features(t.as_py()).tolist() for t in batch.column(1)], pa.list_(pa.float64()))
            yield pa.RecordBatch.from_arrays([batch.column(0), x], names=["doc_id", "x"])

    out = T.StructType([T.StructField("doc_id", docs.schema["doc_id"].dataType), T.StructField("x", T.ArrayType(T.DoubleType()))])
    return docs.select("doc_id", "text").mapInArrow(each, out)


def train(docs: DataFrame, labels: DataFrame, fit_rows: int = FIT_ROWS) -> dict | None:
    """Learns from rows that are not held out. Only features of the bounded sample are shuffled or reach the driver."""
    known = labels.where(F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id"))).groupBy("doc_id").agg(F.max("quality").alias("quality"))
    n_pos = known.where(F.col("quality") == 1).count()
    if not n_pos:
        return None
    rest = docs.select("doc_id", "text").where(F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id")))
    n_docs = rest.select("doc_id").count()
    share_p, share_u = min(1.0, fit_rows / n_pos), min(1.0, fit_rows / max(n_docs, 1))
    x = _featured(rest.where(_share(F.col("doc_id"), max(share_p, share_u)))).groupBy("doc_id").agg(F.min("x").alias("x"))
    k = known.where((F.col("quality") == 1) & _share(F.col("doc_id"), share_p)).select(F.col("doc_id").alias("k_id"))
    rows = x.join(k, x["doc_id"] == k["k_id"], "left").select("doc_id", "x", F.col("k_id").isNotNull().alias("pos"), _share(F.col("doc_id"), share_u).alias("unl"))
    got = rows.where("pos or unl").toPandas()
    if not got["pos"].any() or not got["unl"].any():
        return None
    got = got.iloc[got["doc_id"].astype(str).map(lambda i: hashlib.md5(i.encode()).digest()).argsort()]  # the halves don't depend on partitions
    every = np.array(got["x"].tolist(), dtype=np.float64)
    pos, unl = every[got["pos"].to_numpy()], every[got["unl"].to_numpy()]
    return fit_nnpu(pos, unl, prior=estimated_prior(pos, unl))


def classify(docs: DataFrame, labels: DataFrame, fit_rows: int = FIT_ROWS) -> DataFrame:
    """All columns of docs as struct `row`, with score and predicted."""
    model = train(docs, labels, fit_rows)
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.col("text").alias("text"))

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = np.array([features(t.as_py()) for t in batch.column(1)]).reshape(-1, N_FEATURES)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(score_of(model, x), pa.float64())], names=["row", "score"])

    out = T.StructType([rows.schema["row"], T.StructField("score", T.DoubleType())])
    return rows.mapInArrow(each, out).withColumn("predicted", (F.col("score") >= 0.5).cast("int"))


def quality_scores(docs: DataFrame, labels: DataFrame, fit_rows: int = FIT_ROWS) -> DataFrame:
    """Per document: doc_id, held_out, score, predicted."""
    docs = docs.select("doc_id", "text")
    model = train(docs, labels, fit_rows)

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = np.array([features(t.as_py()) for t in batch.column(1)]).reshape(-1, N_FEATURES)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(score_of(model, x), pa.float64())], names=["doc_id", "score"])

    out = T.StructType([docs.schema["doc_id"], T.StructField("score", T.DoubleType())])
    return docs.mapInArrow(each, out).select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
