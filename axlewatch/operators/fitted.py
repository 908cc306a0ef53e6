"""Detectors with a fitted model: discords, an isolation forest, a robust centre and covariance."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from axlewatch.operators.ranked import order_statistics, quantile

# discords


def normalised(x: np.ndarray, m: int) -> np.ndarray:
    """The z-normalised stretches of m samples of x, one a row; a flat stretch is all zeros."""
    s = np.lib.stride_tricks.sliding_window_view(x, m)
    mu, sd = s.mean(axis=1, keepdims=True), s.std(axis=1, keepdims=True)
    return np.where(sd > 1e-12 * np.maximum(1.0, np.abs(mu)), (s - mu) / np.where(sd > 0, sd, 1.0), 0.0)


def sample_blocks(df: DataFrame, keys: list[str], order: list[str], value: str, m: int, block: int) -> DataFrame:
    """keys, b, xs: the samples of the stretches that begin in block b, so that each block also holds the m - 1 samples behind it. Missing samples are left out."""
    w = Window.partitionBy(*keys).orderBy(*order)
    p = df.where(F.col(value).isNotNull() & ~F.isnan(F.col(value).cast("double"))).select(*keys, F.col(value).cast("double").alias("_v"), (F.row_number().over(w) - 1).alias("_p"))
    first = F.greatest(F.ceil((F.col("_p") - m + 1 - (block - 1)) / block), F.lit(0))
    p = p.withColumn("b", F.explode(F.sequence(first, F.floor(F.col("_p") / block))))
    g = p.groupBy(*keys, "b").agg(F.array_sort(F.collect_list(F.struct("_p", "_v"))).alias("_s"))  # block + m - 1 samples at most
    return g.where(F.size("_s") >= m).select(*keys, "b", F.transform("_s", lambda s: s["_v"]).alias("xs"))


def discords(query: DataFrame, reference: DataFrame, keys: list[str], order: list[str], value: str, m: int, block: int = 1024, itself: bool = False) -> DataFrame:
    """keys, i, distance: how far each stretch of m samples (from place i) is from the nearest stretch of the same keys in the reference, z-normalised.

    Blocks of stretches meet as pairs, each pair is one task's matrix product and gives only the least distance of each
    stretch. itself: query and reference are the same series, and stretches nearer than a quarter of m don't count.
    """
    q, r = sample_blocks(query, keys, order, value, m, block), sample_blocks(reference, keys, order, value, m, block)
    other = [F.col(k).alias(f"_{k}") for k in keys]
    pairs = q.join(r.select(*other, F.col("b").alias("c"), F.col("xs").alias("ys")), [F.col(k) == F.col(f"_{k}") for k in keys])
    zone = math.ceil(m / 4) if itself else 0
    schema = T.StructType([*[query.schema[k] for k in keys], T.StructField("i", T.LongType()), T.StructField("distance", T.DoubleType())])

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for n in range(batch.num_rows):
                row = {c: batch.column(c)[n] for c in ("b", "c", "xs", "ys")}
                a, z = (normalised(row[c].values.to_numpy(), m)[:block] for c in ("xs", "ys"))
                i, j = row["b"].as_py() * block + np.arange(len(a)), row["c"].as_py() * block + np.arange(len(z))
                d = (a * a).sum(axis=1)[:, None] + (z * z).sum(axis=1)[None] - 2 * a @ z.T
                if zone:
                    d = np.where(np.abs(i[:, None] - j[None]) < zone, np.inf, d)
                least = np.sqrt(np.maximum(d.min(axis=1), 0.0))
                near = np.isfinite(least)
                yield pa.RecordBatch.from_arrays([*[pa.array([batch.column(k)[n].as_py()] * int(near.sum()), batch.column(k).type) for k in keys], pa.array(i[near]), pa.array(least[near])], names=schema.names)

    return pairs.select(*keys, "b", "c", "xs", "ys").mapInArrow(each, schema).groupBy(*keys, "i").agg(F.min("distance").alias("distance"))


# isolation forest


def mean_depth(n: int) -> float:
    """The mean depth of an unsuccessful search in a binary tree of n values."""
    return 0.0 if n < 2 else 1.0 if n == 2 else 2 * (math.log(n - 1) + 0.5772156649015329) - 2 * (n - 1) / n


def grown(x: np.ndarray, rng: np.random.Generator, most: int) -> list[tuple]:
    """Nodes of a tree: (node, feature or -1, cut, depth that a row has if it ends here); the children of node k are 2k + 1 and 2k + 2."""
    nodes, todo = [], [(0, x, 0)]
    while todo:
        k, rows, depth = todo.pop()
        spread = np.flatnonzero(rows.max(axis=0) > rows.min(axis=0)) if len(rows) else []
        if depth >= most or len(rows) < 2 or not len(spread):
            nodes.append((k, -1, 0.0, depth + mean_depth(len(rows))))
            continue
        f = int(spread[rng.integers(len(spread))])
        cut = float(rng.uniform(rows[:, f].min(), rows[:, f].max()))
        nodes.append((k, f, cut, 0.0))
        todo += [(2 * k + 2, rows[rows[:, f] >= cut], depth + 1), (2 * k + 1, rows[rows[:, f] < cut], depth + 1)]
    return nodes


def isolation_forest(train: DataFrame, row_id: str, features: list[str], trees: int = 100, sample: int = 256, pool: int = 8192, seed: int = 0) -> DataFrame:
    """tree, node, feature, cut, depth: a table of at most 2 * trees * sample nodes.

    The pool is the rows that are least in a hash of their id, a tree takes those of the pool that are least in a hash with
    its number; so the forest is the same however the rows are dealt. Rows with a missing feature aren't drawn.
    """
    known = train.dropna(subset=features).select(F.col(row_id).cast("string").alias("_id"), *[F.col(f).cast("double").alias(f) for f in features])
    drawn = known.withColumn("_h", F.md5(F.concat(F.lit(f"{seed}:"), "_id"))).orderBy("_h", "_id", *features).limit(pool)
    each_tree = drawn.withColumn("tree", F.explode(F.sequence(F.lit(0), F.lit(trees - 1)))).withColumn("_h", F.md5(F.concat_ws(":", "tree", "_h")))
    w = Window.partitionBy("tree").orderBy("_h", "_id", *features)
    picked = each_tree.withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= sample)
    most = max(1, math.ceil(math.log2(sample)))

    def grow(key: tuple, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = pa.Table.from_batches(list(batches)).sort_by("_r")  # `sample` rows
        x = np.column_stack([t[f].to_numpy() for f in features])
        nodes = grown(x, np.random.default_rng([seed, key[0].as_py()]), most)
        yield pa.RecordBatch.from_pydict({"tree": [key[0].as_py()] * len(nodes)} | {n: [r[i] for r in nodes] for i, n in enumerate(("node", "feature", "cut", "depth"))}, schema=pa.schema([("tree", pa.int32()), ("node", pa.int64()), ("feature", pa.int32()), ("cut", pa.float64()), ("depth", pa.float64())]))

    return picked.select("tree", "_r", *features).groupBy("tree").applyInArrow(grow, "tree int, node long, feature int, cut double, depth double")


def isolation_scores(rows: DataFrame, forest: DataFrame, keys: list[str], features: list[str], sample: int = 256) -> DataFrame:
    """keys, score: 2 to the minus mean depth over that of a sample's search; missing features count as 0."""
    trees = {}
    for r in forest.collect():  # bounded by trees and sample
        trees.setdefault(r.tree, {})[r.node] = (r.feature, r.cut, r.depth)
    tables = []
    for nodes in trees.values():
        at = {k: i for i, k in enumerate(sorted(nodes))}
        tables.append(tuple(np.array(c) for c in zip(*[(*nodes[k], at.get(2 * k + 1, 0), at.get(2 * k + 2, 0)) for k in sorted(nodes)], strict=True)))
    scale = mean_depth(sample)
    schema = T.StructType([*[rows.schema[k] for k in keys], T.StructField("score", T.DoubleType())])

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = np.column_stack([batch.column(f"_f{i}").to_numpy(zero_copy_only=False) for i in range(len(features))]) if batch.num_rows else np.zeros((0, len(features)))
            total = np.zeros(len(x))
            for feature, cut, depth, low, high in tables:
                at = np.zeros(len(x), np.int64)
                while (inner := np.flatnonzero(feature[at] >= 0)).size:
                    here = at[inner]
                    at[inner] = np.where(x[inner, feature[here]] < cut[here], low[here], high[here])
                total += depth[at]
            yield pa.RecordBatch.from_arrays([*[batch.column(k) for k in keys], pa.array(2.0 ** (-total / max(len(tables), 1) / scale))], names=schema.names)

    return rows.select(*keys, *[F.coalesce(F.col(f).cast("double"), F.lit(0.0)).alias(f"_f{i}") for i, f in enumerate(features)]).mapInArrow(each, schema)


# robust centre and covariance


def squared_distance(features: list[str], centre: np.ndarray, precision: np.ndarray) -> Column:
    d = [F.col(f) - float(c) for f, c in zip(features, centre, strict=True)]
    return sum(float(precision[i, j] * (1 if i == j else 2)) * d[i] * d[j] for i in range(len(d)) for j in range(i, len(d)))


def robust_covariance(train: DataFrame, features: list[str], share: float = 0.75, steps: int = 30) -> tuple[np.ndarray, np.ndarray, list[float]]:
    """(centre, covariance, determinants): concentration steps on the `share` of rows that lie nearest.

    Each step is one aggregate of the kept rows' sums of products, which gives centre and covariance, and one exact order
    statistic of all rows' distances, which says whom to keep. It begins with the rows nearest to the medians, by their
    deviations from them. Steps end when the determinant falls no further. The covariance is scaled so that the median
    distance is that of a normal distribution. Rows with a missing feature don't count.
    """
    x = train.select(*[F.col(f).cast("double").alias(f) for f in features]).dropna().checkpoint()
    k = len(features)
    middle = [float(quantile(x, f, 0.5)) for f in features]
    mad = [float(quantile(x.select(F.abs(F.col(f) - m).alias("v")), "v", 0.5)) or 1.0 for f, m in zip(features, middle, strict=True)]
    distance = squared_distance(features, np.array(middle), np.diag(1 / np.square(mad)))
    determinants: list[float] = []
    best = None
    for _ in range(steps):
        far = x.withColumn("_d", distance)
        limit = quantile(far, "_d", share)
        kept = far.where(F.col("_d") <= limit)
        row = kept.agg(*[F.avg(f) for f in features], *[F.covar_pop(features[i], features[j]) for i in range(k) for j in range(i, k)]).first()
        centre, products = np.array(row[:k]), row[k:]
        cov = np.zeros((k, k))
        cov[np.triu_indices(k)] = products
        cov = cov + np.triu(cov, 1).T
        det = float(np.linalg.det(cov))
        if determinants and det >= determinants[-1] * (1 - 1e-9):
            break
        determinants.append(det)
        best = centre, cov
        if det <= 0:
            break
        distance = squared_distance(features, centre, np.linalg.inv(cov))
    centre, cov = best
    precision = np.linalg.pinv(cov)
    median = quantile(x.withColumn("_d", squared_distance(features, centre, precision)), "_d", 0.5)
    return centre, cov * (median / (k * (1 - 2 / (9 * k)) ** 3)), determinants


def robust_mahalanobis(rows: DataFrame, train: DataFrame, features: list[str], share: float = 0.75) -> DataFrame:
    """Adds score: the distance to the robust centre in robust covariance; NULL where a feature is missing."""
    centre, cov, _ = robust_covariance(train, features, share)
    d = squared_distance(features, centre, np.linalg.pinv(cov))
    return rows.withColumn("score", F.sqrt(F.when(d < 0, 0.0).otherwise(d)))


# principal components


def principal(train: DataFrame, features: list[str], share: float = 0.9) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(means, deviations, loadings, variances) of the components that explain `share` of the standardised variance: one aggregate of sums of products, a solve of the features' number."""
    x = train.select(*[F.col(f).cast("double").alias(f) for f in features]).dropna()
    k = len(features)
    pairs = [(i, j) for i in range(k) for j in range(i, k)]
    row = x.agg(*[F.avg(f) for f in features], *[F.covar_pop(features[i], features[j]) for i, j in pairs]).first()
    mu, cov = np.array(row[:k]), np.zeros((k, k))
    cov[np.triu_indices(k)] = row[k:]
    cov = cov + np.triu(cov, 1).T
    sd = np.sqrt(np.diag(cov))
    sd = np.where(sd > 0, sd, 1.0)
    values, vectors = np.linalg.eigh(cov / np.outer(sd, sd))
    values, vectors = values[::-1], vectors[:, ::-1]
    n = min(k, int(np.searchsorted(np.cumsum(values) / max(values.sum(), 1e-300), share - 1e-12)) + 1)
    return mu, sd, vectors[:, :n], values[:n]


def pca_spe_t2(rows: DataFrame, train: DataFrame, features: list[str], share: float = 0.9) -> DataFrame:
    """Adds spe (squared residual), t2 (Hotelling's) and score: the sum of both, each over its 99th percentile in training. NULL where a feature is missing."""
    mu, sd, loadings, variances = principal(train, features, share)

    def with_parts(df: DataFrame) -> DataFrame:
        z = [(F.col(f) - float(m)) / float(s) for f, m, s in zip(features, mu, sd, strict=True)]
        scores = [sum(float(loadings[i, j]) * z[i] for i in range(len(z))) for j in range(loadings.shape[1])]
        fit = [sum(float(loadings[i, j]) * scores[j] for j in range(len(scores))) for i in range(len(z))]
        spe = sum((a - b) * (a - b) for a, b in zip(z, fit, strict=True))
        return df.withColumns({"spe": spe, "t2": sum(s * s / max(float(v), 1e-12) for s, v in zip(scores, variances, strict=True))})

    seen = with_parts(train)
    limit = {c: float(order_statistics(seen, c, {"q": 0.99}).first().q or 0.0) for c in ("spe", "t2")}
    return with_parts(rows).withColumn("score", sum(F.col(c) / max(limit[c], 1e-12) for c in ("spe", "t2")))
