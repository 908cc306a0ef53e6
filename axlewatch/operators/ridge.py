"""Ridge regression by group: sums of products for each group in one aggregate, small solves in Arrow batches."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Judged rows that meet their case's models in one task, and predictions that are held at once.
PIECE_ROWS = 20_000
BLOCK = 1 << 20


def fit(rows: DataFrame, group: list[str], features: list[str], target: str, alpha: float = 1.0, least: int = 20) -> DataFrame:
    """group, coefficients (of the features, then the constant) of each group with at least `least` whole rows. The constant isn't penalised."""
    k = len(features)
    x = rows.dropna(subset=[*features, target]).groupBy(*group)
    pairs = [(i, j) for i in range(k + 1) for j in range(i, k + 1)]
    names = [*features, target]
    # covariances are centred as they are summed, so large means cost no digits
    g = x.agg(F.count(F.lit(1)).alias("_n"), F.array(*[F.avg(c) for c in names]).alias("_mu"), F.array(*[F.covar_pop(names[i], names[j]) for i, j in pairs]).alias("_c"))

    @F.pandas_udf("array<double>")
    def solved(n: pd.Series, mu: pd.Series, c: pd.Series) -> pd.Series:
        out = []
        for rows_, means, products in zip(n, mu, c, strict=True):
            s = np.zeros((k + 1, k + 1))
            s[np.triu_indices(k + 1)] = np.asarray(products) * rows_
            s = s + np.triu(s, 1).T
            w = np.linalg.solve(s[:k, :k] + alpha * np.eye(k), s[:k, k])
            out.append([*w, means[k] - float(w @ np.asarray(means[:k]))])
        return pd.Series(out)

    return g.where(F.col("_n") >= least).select(*group, solved("_n", "_mu", "_c").alias("coefficients"))


def predicted(features: list[str], coefficients: str) -> Column:
    w = F.col(coefficients)
    return sum((F.get(w, i) * F.col(f) for i, f in enumerate(features)), F.get(w, len(features)))


def peer_medians(judged: DataFrame, models: DataFrame, case: str, car: str, row_id: list[str], features: list[str], target: str) -> DataFrame:
    """case, car, _over (the target less the median of what the peers' models predict), _k (their number), of the judged rows whose case has a peer's model.

    A case's rows are dealt into pieces of about PIECE_ROWS; each piece meets the coefficients of its case once, and predictions are made
    and forgotten in blocks of about BLOCK, so cars times rows are computed but never shuffled.
    """
    judged, models = judged.dropna(subset=[case, car]), models.dropna(subset=[case, car])
    pieces = judged.groupBy(F.col(case).alias("_case")).agg(F.ceil(F.count(F.lit(1)) / PIECE_ROWS).cast("int").alias("_pieces"))
    dealt = judged.join(pieces, F.col(case) == F.col("_case")).withColumn("_piece", F.pmod(F.xxhash64(car, *row_id), F.col("_pieces")).cast("int"))
    met = models.join(pieces, F.col(case) == F.col("_case")).select(F.col("_case"), F.explode(F.sequence(F.lit(0), F.col("_pieces") - 1)).alias("_piece"), F.col(car).alias("_peer"), "coefficients")

    def each(rows: pd.DataFrame, peers: pd.DataFrame) -> pd.DataFrame:
        if rows.empty or peers.empty:
            return pd.DataFrame({case: [], car: [], "_over": [], "_k": []})
        w = np.stack(peers["coefficients"].to_numpy())
        x, own = rows[features].to_numpy(np.float64), pd.Index(peers["_peer"]).get_indexer(rows[car])
        median, k = np.full(len(rows), np.nan), len(w) - (own >= 0)
        block = max(BLOCK // len(w), 1)
        for a in range(0, len(rows), block):
            p = np.broadcast_to(w[:, -1], (len(x[a : a + block]), len(w))).copy()
            for i in range(len(features)):
                p += x[a : a + block, i, None] * w[None, :, i]
            has = np.flatnonzero(own[a : a + block] >= 0)
            p[has, own[a : a + block][has]] = np.inf  # one's own model comes last
            for n in np.unique(k[a : a + block]):
                if n:
                    at = np.flatnonzero(k[a : a + block] == n)
                    half = np.partition(p[at], n // 2, axis=1)
                    high = half[:, n // 2]
                    median[a + at] = high if n % 2 else 0.5 * half[:, : n // 2].max(axis=1) + 0.5 * high
        out = pd.DataFrame({case: rows[case], car: rows[car], "_over": rows[target] - median, "_k": k})
        return out[k > 0]

    out = T.StructType([judged.schema[case], judged.schema[car], T.StructField("_over", T.DoubleType()), T.StructField("_k", T.LongType())])
    return dealt.select(case, car, *[F.col(c).cast("double").alias(c) for c in [*features, target]], "_piece").groupBy(case, "_piece").cogroup(met.groupBy("_case", "_piece")).applyInPandas(each, out)


def peer_residual(rows: DataFrame, case: str, car: str, row_id: list[str], features: list[str], target: str, usable: Column, hot: Column, alpha: float = 1.0, least: int = 20, peers: int = 2) -> DataFrame:
    """case, car, residual: the mean, over a car's hot rows, of its target less the median of what its peers' models predict for it.

    Each car's model is fitted on its own usable rows; a car with too few rows has none, and a car with fewer than `peers`
    peers' models, or with too few hot rows, has a NULL residual. Rows with a missing feature or target leave the fit.
    """
    ok = rows.where(usable).dropna(subset=[*features, target])
    models = fit(ok, [case, car], features, target, alpha, least)
    ref = peer_medians(ok.where(hot), models, case, car, row_id, features, target)
    mean = ref.groupBy(case, car).agg(F.avg("_over").alias("_m"), F.count(F.lit(1)).alias("_rows"), F.min("_k").alias("_k"))
    every = rows.select(case, car).distinct()
    return every.join(mean, [case, car], "left").select(case, car, F.when((F.col("_rows") >= least) & (F.col("_k") >= peers), F.col("_m")).alias("residual"))
