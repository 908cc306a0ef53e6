"""Classifiers, clusters, rules and forecasts that are fitted on rows. Missing and NaN features count as 0.

Forests and boosters see a feature by its bin only, so rows of the same bins and label are told to them as one row with
a weight: the rounds' work grows with the cells that are in use, not with the rows.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import dataclass, field
from functools import reduce

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import GBTClassifier, LogisticRegression, RandomForestClassifier
from pyspark.ml.clustering import KMeans
from pyspark.ml.feature import Bucketizer, StandardScaler
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.regression import GBTRegressor
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from axlewatch.operators.ranked import order_statistics

MOST_CLASSES = 50
#: Bins of a feature, as many as Spark's trees make of it; a cell with more than one in so many rows is told as several rows, so that draws of rows stay fine.
BINS, PIECES = 32, 200_000


def number(name: str) -> Column:
    return F.coalesce(F.nanvl(F.col(name).cast("double"), F.lit(0.0)), F.lit(0.0))


def vector(features: list[str]) -> Column:
    return array_to_vector(F.array(*[number(c) for c in features]))


@dataclass
class Bins:
    """For each feature the least values of its bins but the first; few: cells are under a quarter of the rows."""

    starts: dict[str, list[float]]
    few: bool = False

    def columns(self, features: list[str] | None = None) -> list[str]:
        return [f"_bin{i}" for i, f in enumerate(self.starts) if features is None or f in features]

    def vector(self, features: list[str]) -> Column:
        at = {f: i for i, f in enumerate(self.starts)}
        return array_to_vector(F.array(*[F.col(f"_bin{at[f]}") for f in features]))

    def of(self, rows: DataFrame) -> DataFrame:
        """Adds the bins' columns."""
        cut = {f"_bin{i}": [-math.inf, *s, math.inf] for i, s in enumerate(self.starts.values()) if s}
        x = rows.withColumns({f"_in{i}": number(f) for i, f in enumerate(self.starts)} | {f"_bin{i}": F.lit(0.0) for i, s in enumerate(self.starts.values()) if not s})
        if cut:
            x = Bucketizer(splitsArray=list(cut.values()), inputCols=[c.replace("_bin", "_in") for c in cut], outputCols=list(cut)).transform(x)
        return x.drop(*[f"_in{i}" for i in range(len(self.starts))])

    def each(self, rows: DataFrame, add: Callable[[DataFrame], DataFrame]) -> DataFrame:
        """rows with the columns that add gives to rows of bins; each cell once where there are few."""
        x, at = self.of(rows), self.columns()
        if not self.few:
            return add(x).drop(*at)
        told = add(x.select(*at).distinct())
        return x.join(told, at).select(*rows.columns, *[c for c in told.columns if c not in at])


def bins_of(rows: DataFrame, features: list[str]) -> Bins:
    """A bin for each value where there are at most BINS, else bins of about as many rows each (right to one in 1000 ranks), over all rows."""
    x = rows.select(*[number(f).alias(f"_f{i}") for i, f in enumerate(features)])
    seen = x.agg(*[F.approx_count_distinct(c) for c in x.columns], *[F.percentile_approx(c, [j / BINS for j in range(1, BINS)], 1000) for c in x.columns]).first()
    some = [i for i in range(len(features)) if seen[i] <= 2 * BINS]  # these sets are small
    held = dict(zip(some, x.agg(*[F.collect_set(f"_f{i}") for i in some]).first(), strict=True)) if some else {}
    starts = {}
    for i, f in enumerate(features):
        values = sorted(set(held.get(i, ())))
        cut = values[1:] if values and len(values) <= BINS else sorted(set(seen[len(features) + i] or ()))
        starts[f] = [v for v in cut if math.isfinite(v)]
    return Bins(starts)


def cells(train: DataFrame, bins: Bins, label: str, others: list[str] = []) -> DataFrame:  # noqa: B006
    """Labelled rows of the same bins, label and others as one, with _n, their number. Notes in bins whether there are few."""
    g = bins.of(train.where(F.col(label).isNotNull())).groupBy(*bins.columns(), label, *others).agg(F.count(F.lit(1)).alias("_n")).checkpoint()
    n, total = g.agg(F.count(F.lit(1)), F.coalesce(F.sum("_n"), F.lit(0))).first()
    bins.few = 4 * n <= total
    return g


def told(held: DataFrame, bins: Bins, label: str) -> DataFrame:
    """Cells as a model is told them: one row for bins and label, heavy ones as equal parts, over all cores."""
    g = held.groupBy(*bins.columns(), label).agg(F.sum("_n").alias("_n"))
    n, total = g.agg(F.count(F.lit(1)), F.coalesce(F.sum("_n"), F.lit(0))).first()
    parts = F.ceil(F.col("_n") * (PIECES / max(total, 1))).cast("int")
    x = g.select(*bins.columns(), label, (F.col("_n") / parts).alias("_n"), F.explode(F.sequence(F.lit(1), parts)).alias("_part"))
    return x.repartition(max(held.sparkSession.sparkContext.defaultParallelism, n // PIECES), *bins.columns(), "_part").drop("_part")


def classes_of(train: DataFrame, label: str) -> dict[object, int]:
    """Each class with its count, in order; rows without a label are none, cells count as their rows. At most MOST_CLASSES, which is checked."""
    n = F.round(F.sum("_n")).cast("long") if "_n" in train.columns else F.count(F.lit(1))
    rows = train.where(F.col(label).isNotNull()).groupBy(label).agg(n).limit(MOST_CLASSES + 1).collect()
    if len(rows) > MOST_CLASSES:
        raise ValueError(f"{label} has over {MOST_CLASSES} classes")
    if len(rows) < 2:
        raise ValueError(f"{label} has fewer than two classes")
    return {k: n for k, n in sorted(((r[0], r[1]) for r in rows), key=lambda x: x[0])}


def coded(train: DataFrame, label: str, classes: dict[object, int]) -> DataFrame:
    """Adds _y (the place of the class) and _w (its rows weigh as much as those of any other class; a cell as its rows)."""
    n, k = sum(classes.values()), len(classes)
    y = reduce(lambda c, v: c.when(F.col(label) == v[1], float(v[0])), enumerate(classes), F.when(F.lit(False), 0.0))
    w = reduce(lambda c, v: c.when(F.col(label) == v, n / (k * classes[v])), classes, F.when(F.lit(False), 0.0))
    return train.where(F.col(label).isNotNull()).withColumn("_y", y).withColumn("_w", w * F.col("_n") if "_n" in train.columns else w)


@dataclass
class Fitted:
    """Classes in order, and the model or models whose mean probability they get; models of trees are fitted on bins."""

    classes: list
    features: list[list[str]]
    models: list[PipelineModel]
    bins: Bins | None = field(default=None, kw_only=True)

    def probabilities(self, rows: DataFrame, name: str = "probability") -> DataFrame:
        """Adds an array of the classes' probabilities."""
        return self.bins.each(rows, lambda x: self.scored(x, name)) if self.bins else self.scored(rows, name)

    def scored(self, rows: DataFrame, name: str) -> DataFrame:
        """The same, where rows have their bins if there are any."""
        out, parts = rows, []
        for i, (features, model) in enumerate(zip(self.features, self.models, strict=True)):
            model_in = out.withColumn("_x", self.bins.vector(features) if self.bins else vector(features))
            scored = model.transform(model_in)
            drop = [c for c in scored.columns if c not in out.columns and c != "_p"]
            out = scored.withColumn(f"_p{i}", vector_to_array("_p")).drop(*drop, "_p")
            parts.append(f"_p{i}")
        mean = F.transform(F.sequence(F.lit(0), F.lit(len(self.classes) - 1)), lambda j: reduce(lambda a, b: a + b, [F.get(F.col(p), j) for p in parts]) / len(parts))
        return out.withColumn(name, mean).drop(*parts)

    def predicted(self, rows: DataFrame, name: str = "predicted") -> DataFrame:
        """Adds the array of probabilities and the likeliest class (the first of equals)."""
        p = self.probabilities(rows)
        best = F.array_position("probability", F.array_max("probability")).cast("int")
        return p.withColumn(name, F.element_at(F.array(*[F.lit(c) for c in self.classes]), best))


def logistic(train: DataFrame, features: list[str], label: str, penalty: float = 1.0) -> Fitted:
    """Class-balanced logistic regression on standardised features; the squared penalty is divided by the rows, so it weighs less the more there are."""
    classes = classes_of(train, label)
    x = coded(train, label, classes).withColumn("_x", vector(features))
    steps = [StandardScaler(inputCol="_x", outputCol="_z", withMean=True), LogisticRegression(featuresCol="_z", labelCol="_y", weightCol="_w", probabilityCol="_p", rawPredictionCol="_r", predictionCol="_c", regParam=penalty / sum(classes.values()))]
    return Fitted(list(classes), [features], [Pipeline(stages=steps).fit(x)])


def forest(train: DataFrame, features: list[str], label: str, trees: int = 50, depth: int = 8, seed: int = 0) -> Fitted:
    bins = bins_of(train, features)
    return forest_of_cells(told(cells(train, bins, label), bins, label), bins, features, label, trees, depth, seed)


def forest_of_cells(train: DataFrame, bins: Bins, features: list[str], label: str, trees: int = 50, depth: int = 8, seed: int = 0) -> Fitted:
    classes = classes_of(train, label)
    x = coded(train, label, classes).withColumn("_x", bins.vector(features))
    step = RandomForestClassifier(featuresCol="_x", labelCol="_y", weightCol="_w", probabilityCol="_p", rawPredictionCol="_r", predictionCol="_c", numTrees=trees, maxDepth=depth, maxBins=BINS, seed=seed)
    return Fitted(list(classes), [features], [Pipeline(stages=[step]).fit(x)], bins=bins)


@dataclass
class Boosted(Fitted):
    """One booster for each class but where two classes need one only; models come class by class, seed by seed."""

    def scored(self, rows: DataFrame, name: str) -> DataFrame:
        k = len(self.classes)
        sides = 1 if k == 2 else k
        each = len(self.models) // sides
        out, cols = rows, []
        for side in range(sides):
            one = Fitted([0, 1], self.features[side * each : (side + 1) * each], self.models[side * each : (side + 1) * each], bins=self.bins)
            out = one.scored(out, f"_b{side}")
            cols.append(f"_b{side}")
        if k == 2:
            return out.withColumn(name, F.col("_b0")).drop("_b0")
        total = reduce(lambda a, b: a + b, [F.get(F.col(c), 1) for c in cols])
        return out.withColumn(name, F.array(*[F.get(F.col(c), 1) / total for c in cols])).drop(*cols)


def boosted(train: DataFrame, groups: list[list[str]], label: str, seeds: tuple[int, ...] = (0,), rounds: int = 20, depth: int = 4) -> Boosted:
    """Gradient-boosted trees for each group of features and seed; probabilities are their mean. Over two classes are told one from the rest."""
    bins = bins_of(train, list(dict.fromkeys(f for g in groups for f in g)))
    return boosted_of_cells(told(cells(train, bins, label), bins, label), bins, groups, label, seeds, rounds, depth)


def boosted_of_cells(train: DataFrame, bins: Bins, groups: list[list[str]], label: str, seeds: tuple[int, ...] = (0,), rounds: int = 20, depth: int = 4) -> Boosted:
    classes = classes_of(train, label)
    x = coded(train, label, classes)
    models, features = [], []
    for side in [1] if len(classes) == 2 else range(len(classes)):
        for group in groups:
            y = x.withColumn("_x", bins.vector(group)).withColumn("_t", (F.col("_y") == side).cast("double"))
            for seed in seeds:
                step = GBTClassifier(featuresCol="_x", labelCol="_t", weightCol="_w", predictionCol="_c", maxIter=rounds, maxDepth=depth, maxBins=BINS, subsamplingRate=0.8, seed=seed)
                models.append(Pipeline(stages=[step.setProbabilityCol("_p").setRawPredictionCol("_r")]).fit(y))
                features.append(group)
    return Boosted(list(classes), features, models, bins=bins)


REGIMES = ("open", "cruise", "clos")


def regime_groups(features: list[str]) -> list[list[str]]:
    """Three groups of features: those whose name marks opening, cruise or closing, each with the unmarked ones; three near-equal runs where no name is marked."""
    marked = {r: [f for f in features if r in f.lower()] for r in REGIMES}
    if not any(marked.values()):
        edges = [round(i * len(features) / 3) for i in range(4)]
        return [g for a, b in zip(edges, edges[1:], strict=False) if (g := features[a:b])]
    shared = [f for f in features if not any(f in m for m in marked.values())]
    return [g for r in REGIMES if (g := [f for f in features if f in marked[r] or f in shared])]


def three_regime(train: DataFrame, features: list[str], label: str, **rules) -> Boosted:
    return boosted(train, regime_groups(features), label, **rules)


def stacked(train: DataFrame, features: list[str], label: str, fold: Column, folds: int = 3) -> tuple[list[Fitted], Fitted]:
    """A forest and a booster, and a logistic regression on the probabilities that they give rows they were not fitted on. fold is 0 to folds - 1. All see the same bins, which no label enters."""
    bins = bins_of(train, features)
    x = cells(train.withColumn("_fold", fold), bins, label, ["_fold"])

    def fitted(held: DataFrame) -> list[Fitted]:
        rows = told(held, bins, label).checkpoint()
        return [forest_of_cells(rows, bins, features, label), boosted_of_cells(rows, bins, [features], label)]

    whole = fitted(x)
    apart = [_both(x.where(F.col("_fold") == k), fitted(x.where(F.col("_fold") != k)), whole[0].classes) for k in range(folds)]
    k = len(whole[0].classes)
    return whole, logistic(reduce(DataFrame.unionByName, apart).checkpoint(), [f"_s{i}" for i in range(2 * k)], label)


def _both(rows: DataFrame, models: list[Fitted], classes: list) -> DataFrame:
    """rows with their bins -> with the models' probabilities of the classes."""
    k = len(classes)
    out = rows
    for i, m in enumerate(models):
        at = {c: j for j, c in enumerate(m.classes)}  # a fold may lack a class
        out = m.scored(out, "_q").withColumns({f"_s{i * k + j}": F.get("_q", F.lit(at[c])) if c in at else F.lit(0.0) for j, c in enumerate(classes)}).drop("_q")
    return out


def stacked_probabilities(rows: DataFrame, whole: list[Fitted], top: Fitted) -> DataFrame:
    scores = [f"_s{i}" for i in range(2 * len(whole[0].classes))]
    return whole[0].bins.each(rows, lambda x: top.predicted(_both(x, whole, whole[0].classes)).drop(*scores))


# clusters


def clusters(train: DataFrame, features: list[str], k: int = 8, seed: int = 0) -> tuple[list[list[float]], list[int]]:
    """Centres of k-means and the training rows nearest to each."""
    model = KMeans(featuresCol="_x", k=k, seed=seed).fit(train.select(vector(features).alias("_x")))
    return [[float(v) for v in c] for c in model.clusterCenters()], [int(n) for n in model.summary.clusterSizes]


def large_clusters(sizes: list[int], alpha: float = 0.9, beta: float = 5.0) -> list[int]:
    """The places of the clusters that count as large: from the largest, up to where they hold the share alpha of rows, or before a fall by the factor beta.

    Where neither border exists every cluster is large.
    """
    order = sorted(range(len(sizes)), key=lambda i: (-sizes[i], i))
    held = 0
    for j, i in enumerate(order[:-1], 1):
        held += sizes[i]
        if held >= alpha * sum(sizes) or sizes[i] >= beta * max(sizes[order[j]], 1):
            return order[:j]
    return order


def nearest_centre(features: list[str], centres: list[list[float]]) -> Column:
    """The distance to the nearest centre."""
    x = [F.coalesce(F.nanvl(F.col(c).cast("double"), F.lit(0.0)), F.lit(0.0)) for c in features]
    return F.array_min(F.array(*[F.sqrt(reduce(lambda a, b: a + b, [(v - m) * (v - m) for v, m in zip(x, c, strict=True)])) for c in centres]))


# rules


def rule_tree(train: DataFrame, features: list[str], depth: int = 2, tail: float = 0.05) -> dict[int, dict]:
    """Nodes by number (root 1; a node's extreme rows go to twice its number, the others to the next): n, and for inner nodes feature, threshold and up.

    A level takes one aggregate and one order statistic for all of its nodes, at most 2 ** depth rows each. At a node the feature with
    the single most extreme z-score is cut at its tail's quantile, on that reading's side (up if both sides are as far). A node of under 4 rows or
    without a row beyond the quantile is a leaf. Missing features count as 0.
    """
    x = train.select(*[F.coalesce(F.nanvl(F.col(c).cast("double"), F.lit(0.0)), F.lit(0.0)).alias(f"_f{i}") for i, c in enumerate(features)]).withColumn("_node", F.lit(1))
    names = [f"_f{i}" for i in range(len(features))]
    nodes: dict[int, dict] = {}
    for _ in range(depth):
        stats = x.groupBy("_node").agg(F.count(F.lit(1)).alias("n"), *[g(c).alias(f"{c}{s}") for c in names for s, g in (("m", F.avg), ("d", F.stddev_pop), ("l", F.min), ("h", F.max))]).collect()
        cut = {}
        for r in stats:
            if r["_node"] in nodes and "feature" in nodes[r["_node"]]:
                continue
            nodes[r["_node"]] = {"n": r["n"]}
            if r["n"] >= 4:
                far = [max(r[f"{c}h"] - r[f"{c}m"], r[f"{c}m"] - r[f"{c}l"]) / (r[f"{c}d"] + 1e-9) for c in names]
                f = far.index(max(far))
                cut[r["_node"]] = (f, r[f"_f{f}h"] - r[f"_f{f}m"] >= r[f"_f{f}m"] - r[f"_f{f}l"])
        if not cut:
            return nodes
        picked = reduce(lambda c, k: c.when(F.col("_node") == k, F.col(names[cut[k][0]])), cut, F.when(F.lit(False), F.lit(0.0)))
        quantiles = {r["_node"]: r for r in order_statistics(x.withColumn("_v", picked), "_v", {"low": tail, "high": 1 - tail}, ["_node"]).collect()}
        child = F.col("_node")
        for k, (f, up) in cut.items():
            thr = quantiles[k]["high" if up else "low"]
            beyond = F.col(names[f]) > thr if up else F.col(names[f]) < thr
            nodes[k] |= {"feature": features[f], "threshold": thr, "up": up}
            child = F.when(F.col("_node") == k, F.when(beyond, 2 * k).otherwise(2 * k + 1)).otherwise(child)
        x = x.withColumn("_node", child)
        sizes = {r["_node"]: r["count"] for r in x.groupBy("_node").count().collect()}
        whole = [k for k in cut if not sizes.get(2 * k) or not sizes.get(2 * k + 1)]
        for k in whole:
            nodes[k] = {"n": nodes[k]["n"]}
        if whole:
            x = x.withColumn("_node", F.when(F.floor(F.col("_node") / 2).isin(whole), F.floor(F.col("_node") / 2)).otherwise(F.col("_node")).cast("int"))
        nodes |= {k: {"n": n} for k, n in sizes.items() if k // 2 in cut and k // 2 not in whole}
    return nodes


def rule_score(nodes: dict[int, dict], k: int = 1) -> Column:
    """-log((rows of the leaf + 1) / (rows of the root + 1))."""
    node = nodes[k]
    if "feature" not in node:
        return F.lit(-math.log((node["n"] + 1) / (nodes[1]["n"] + 1)))
    v = F.coalesce(F.nanvl(F.col(node["feature"]).cast("double"), F.lit(0.0)), F.lit(0.0))
    return F.when(v > node["threshold"] if node["up"] else v < node["threshold"], rule_score(nodes, 2 * k)).otherwise(rule_score(nodes, 2 * k + 1))


def rule_texts(nodes: dict[int, dict], k: int = 1, so_far: tuple[str, ...] = ()) -> list[tuple[str, int]]:
    """A sentence and a count of rows for each leaf."""
    node = nodes[k]
    if "feature" not in node:
        return [(" and ".join(so_far) or "all", node["n"])]
    signs = (">", "<=") if node["up"] else ("<", ">=")
    return [x for i, s in enumerate(signs) for x in rule_texts(nodes, 2 * k + i, (*so_far, f"{node['feature']} {s} {node['threshold']:.6g}"))]


# forecasts


def forecasts(train: DataFrame, channels: list[str], length: int, rounds: int = 20, depth: int = 4) -> dict[str, tuple[PipelineModel, float]]:
    """For each channel (a column with the array of a window's samples) a booster that foretells its last sample from all earlier ones of all channels, and the deviation of its residuals."""
    last = [F.coalesce(F.nanvl(F.element_at(c, length).cast("double"), F.lit(0.0)), F.lit(0.0)).alias(f"_y{i}") for i, c in enumerate(channels)]
    x = train.where(reduce(lambda a, b: a & b, [F.size(c) == length for c in channels])).select(_earlier(channels, length).alias("_x"), *last).checkpoint()  # read by several passes for each channel
    out = {}
    for i, c in enumerate(channels):
        rows = x.select("_x", F.col(f"_y{i}").alias("_y"))
        model = Pipeline(stages=[GBTRegressor(featuresCol="_x", labelCol="_y", predictionCol="_p", maxIter=rounds, maxDepth=depth, seed=0)]).fit(rows)
        out[c] = (model, (model.transform(rows).agg(F.stddev_pop(F.col("_y") - F.col("_p"))).first()[0] or 0.0) + 1e-9)
    return out


def _earlier(channels: list[str], length: int) -> Column:
    every = F.flatten(F.array(*[F.slice(F.transform(c, lambda v: v.cast("double")), 1, length - 1) for c in channels]))
    return array_to_vector(F.transform(every, lambda v: F.coalesce(F.nanvl(v, F.lit(0.0)), F.lit(0.0))))


def forecast_residuals(rows: DataFrame, models: dict[str, tuple[PipelineModel, float]], length: int) -> DataFrame:
    """Adds z_<channel> (signed, standardised), score (the greatest of their sizes) and channel (the first that has it). Windows of another length are left out."""
    channels = list(models)
    out = rows.where(reduce(lambda a, b: a & b, [F.size(c) == length for c in channels]))
    for c, (model, sd) in models.items():
        out = model.transform(out.withColumn("_x", _earlier(channels, length)))
        out = out.withColumn(f"z_{c}", (F.coalesce(F.nanvl(F.element_at(c, length).cast("double"), F.lit(0.0)), F.lit(0.0)) - F.col("_p")) / sd).drop("_x", "_p")
    sizes = F.array(*[F.abs(F.col(f"z_{c}")) for c in channels])
    return out.withColumn("score", F.array_max(sizes)).withColumn("channel", F.element_at(F.array(*[F.lit(c) for c in channels]), F.array_position(sizes, F.array_max(sizes)).cast("int")))


# folds


def leave_one_out_scores(df: DataFrame, group: str, row_id: list[str], features: list[str], val: Column, q: float = 0.99, most: int = 1000) -> DataFrame:
    """row_id, group, score, threshold, alert: every row scored by means and deviations fitted on the training rows of the other groups, all folds in one job.

    A fold's means and deviations are the sums over all groups less the group's own, so training rows aren't repeated. val marks
    the rows that are kept from the fit; a fold's threshold is the quantile q of the scores its fit gives the other groups' val rows,
    which alone are repeated for each fold (at most `most` groups, which is checked). The score is the greatest of the features' sizes of z;
    a missing feature has none, and so has one without spread.
    """
    x = df.withColumn("_val", F.coalesce(val, F.lit(False)))
    groups = x.select(group).distinct()
    if (n := groups.limit(most + 1).count()) > most:
        raise ValueError(f"leave_one_out_scores: over {n - 1} groups; a fold for each would repeat every row kept from the fit as often")
    whole = x.where("not _val").agg(*[F.avg(f).alias(f"_c{i}") for i, f in enumerate(features)])  # one row: sums are taken about it, so that squares lose no digits
    own = x.join(F.broadcast(whole)).groupBy(group)
    train = [F.when(~F.col("_val"), F.col(f) - F.col(f"_c{i}")) for i, f in enumerate(features)]
    sums = own.agg(*[a(t).alias(f"_{s}{i}") for i, t in enumerate(train) for s, a in (("n", F.count), ("s", F.sum), ("q", lambda c: F.sum(c * c)))], *[F.first(f"_c{i}").alias(f"_c{i}") for i in range(len(features))]).checkpoint()
    zero = [F.coalesce(F.col(f"_{s}{i}"), F.lit(0.0)).alias(f"_{s}{i}") for i in range(len(features)) for s in "nsq"]
    sums = sums.select(group, *zero, *[f"_c{i}" for i in range(len(features))])
    total = sums.agg(*[F.sum(f"_{s}{i}").alias(f"_all_{s}{i}") for i in range(len(features)) for s in "nsq"])
    left = sums.join(F.broadcast(total))  # one row
    fits = [F.col(group).alias("fold")]
    for i in range(len(features)):
        n_, s_, q_ = (F.col(f"_all_{c}{i}") - F.col(f"_{c}{i}") for c in "nsq")
        m = s_ / F.nullif(n_, F.lit(0.0))
        fits += [(m + F.col(f"_c{i}")).alias(f"_m{i}"), F.sqrt(F.greatest(q_ / F.nullif(n_, F.lit(0.0)) - m * m, F.lit(0.0))).alias(f"_d{i}")]
    fits = left.select(*fits)
    z = [F.abs(F.col(f) - F.col(f"_m{i}")) / F.nullif(F.col(f"_d{i}"), F.lit(0.0)) for i, f in enumerate(features)]
    score = F.greatest(*z) if len(z) > 1 else z[0]
    kept = x.where("_val").join(F.broadcast(fits), F.col(group) != F.col("fold"))  # at most `most` rows
    thresholds = order_statistics(kept.select("fold", score.alias("_v")), "_v", {"threshold": q}, ["fold"])
    judged = x.join(F.broadcast(fits), F.col(group) == F.col("fold")).select(*row_id, group, score.alias("score"))
    return judged.join(F.broadcast(thresholds.withColumnRenamed("fold", "_f")), F.col(group) == F.col("_f"), "left").select(*row_id, group, "score", "threshold", F.coalesce(F.col("score") > F.col("threshold"), F.lit(False)).alias("alert"))
