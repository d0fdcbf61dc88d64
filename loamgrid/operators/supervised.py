"""Comparing, checking and applying supervised models."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loamgrid.operators import learning as L
from loamgrid.operators import stats as A

#: Settings under which each classifier runs by default; the network's inner layer is added to the numbers of features and classes.
DEFAULTS = {"rf": {"numTrees": 20, "maxDepth": 8}, "et": {"numTrees": 20, "maxDepth": 8}, "dt": {"maxDepth": 8}, "gbt": {"maxIter": 3, "maxDepth": 3}, "svm": {}, "lr": {}, "sgd": {}, "nb": {}, "mlp": {"maxIter": 40}}


def fit(train: DataFrame, label: str, features: Sequence[str], model: str, scale: str | None = "standard", **options):
    """A classifier by name with its default settings; the network gets its layers from the numbers of features and classes."""
    options = DEFAULTS.get(model, {}) | options
    if model == "mlp" and "layers" not in options:
        options["layers"] = [len(features), 16, train.where(F.col(label).isNotNull()).select(label).distinct().count()]
    return L.train_classifier(train, label, features, model, scale=scale, **options)


def evaluate(model, df: DataFrame, label: str) -> DataFrame:
    """One row of scores of a fitted model on any table with its columns: n, accuracy, kappa, F1 and the rest of ``stats.overall_accuracy``."""
    out = model.transform(df).select(F.col(label).cast("string").alias("t"), F.col("predicted").cast("string").alias("p"))
    return A.overall_accuracy(A.confusion(out, "p", "t"))


def compare(df: DataFrame, label: str, features: Sequence[str], models: Sequence[str], split: str = "split") -> DataFrame:
    """A leaderboard: one row a model with its scores on the test rows, best accuracy first. ``split`` marks rows train or test."""
    train, test = df.where(F.col(split) == "train"), df.where(F.col(split) == "test")
    out = None
    for m in models:
        row = evaluate(fit(train, label, features, m), test, label).withColumn("model", F.lit(m))
        out = row if out is None else out.unionByName(row)
    return out.orderBy(F.desc("accuracy"), "model")


def cross_validate(df: DataFrame, label: str, features: Sequence[str], model: str, group: Column, folds: int = 5, seed: int = 0, **options) -> DataFrame:
    """``fold, n, accuracy, kappa``: rows of one group are in one fold, by a hash."""
    rows = df.withColumn("__fold", F.pmod(F.xxhash64(group, F.lit(seed)), F.lit(folds)).cast("int"))
    out = None
    for k in range(folds):
        fitted = fit(rows.where(F.col("__fold") != k), label, features, model, **options)
        row = evaluate(fitted, rows.where(F.col("__fold") == k), label).select(F.lit(k).alias("fold"), "n", "accuracy", "kappa")
        out = row if out is None else out.unionByName(row)
    return out


def grid_search(df: DataFrame, label: str, features: Sequence[str], model: str, grid: Sequence[dict], group: Column, folds: int = 3) -> tuple[dict, float]:
    """The settings with the best mean accuracy over the folds."""
    scores = [cross_validate(df, label, features, model, group, folds, **g).agg(F.avg("accuracy")).first()[0] for g in grid]
    best = max(range(len(grid)), key=lambda i: (scores[i] or 0.0, -i))
    return dict(grid[best]), scores[best]


def permutation_importance(model, df: DataFrame, label: str, features: Sequence[str], key: str, rows: int = 20_000, repeats: int = 3, seed: int = 0) -> list[tuple[str, float]]:
    """How much accuracy a feature's shuffling costs, shares of the total, largest first.

    Measured on at most ``rows`` rows (those with the smallest hashes of ``key``), which the driver shuffles; the model itself may have learnt from all.
    """
    spark = df.sparkSession
    sample = df.dropna(subset=[label, *features]).orderBy(F.xxhash64(key), key).limit(rows).select(label, *features).toPandas()
    score = lambda pdf: evaluate(model, spark.createDataFrame(pdf), label).first().accuracy
    base, lost, rng = score(sample), {}, np.random.default_rng(seed)
    for f in features:
        drops = []
        for _ in range(repeats):
            mixed = sample.copy()
            mixed[f] = rng.permutation(mixed[f].to_numpy())
            drops.append(base - score(mixed))
        lost[f] = max(0.0, float(np.mean(drops)))
    total = sum(lost.values()) or 1.0
    return sorted(((f, v / total) for f, v in lost.items()), key=lambda x: (-x[1], x[0]))


def predict_pixels(model, pixels: DataFrame, keep: Sequence[str]) -> DataFrame:
    """``keep, predicted, confidence`` (whole percent) of every pixel with all bands: one map over the table, no shuffle."""
    out = model.transform(pixels)
    sure = F.array_max(vector_to_array("probability")) if "probability" in out.columns else F.lit(None).cast("double")
    return out.select(*keep, "predicted", F.bround(sure * 100).cast("int").alias("confidence"))


def class_shares(predicted: DataFrame, cls: str = "predicted") -> DataFrame:
    """``class, pixels, percent`` of a map."""
    g = predicted.groupBy(F.col(cls).alias("class")).agg(F.count("*").alias("pixels"))
    return g.withColumn("percent", 100.0 * F.col("pixels") / F.sum("pixels").over(Window.partitionBy()))  # one row a class


def exact_per_class(df: DataFrame, label: str, per_class: int, key: str, seed: int = 0, parts: int = 64) -> DataFrame:
    """Exactly min(per_class, rows) rows of every class, those with the smallest hashes. A class is ranked in parts first, so a hot class fills no task."""
    h = F.xxhash64(F.col(key), F.lit(seed))
    rows = df.where(F.col(label).isNotNull()).withColumn("__h", h).withColumn("__p", F.pmod(F.xxhash64("__h"), F.lit(parts)))
    best = rows.withColumn("__r", F.row_number().over(Window.partitionBy(label, "__p").orderBy("__h", key))).where(F.col("__r") <= per_class)
    return best.withColumn("__r", F.row_number().over(Window.partitionBy(label).orderBy("__h", key))).where(F.col("__r") <= per_class).drop("__h", "__p", "__r")


def classify_raster(pixels: DataFrame, label: str, features: Sequence[str], key: str, model: str = "rf", per_class: int = 3000) -> tuple[DataFrame, object]:
    """Sample, train and map in one step: every pixel with its predicted class, and the fitted model. The sample takes at most ``per_class`` labelled pixels a class."""
    known = pixels.dropna(subset=list(features))
    fitted = fit(exact_per_class(known, label, per_class, key).select(label, *features), label, features, model)
    return predict_pixels(fitted, known, [key, label]), fitted


def train_regressor(train: DataFrame, target: str, features: Sequence[str], model: str = "linear", transform: str | None = None, **options):
    """A fitted regressor as a function of a table that adds ``predicted``; ``transform`` log1p learns the logarithm and turns it back."""
    y = F.log1p(F.col(target)) if transform == "log1p" else F.col(target)
    rows = train.dropna(subset=[target, *features]).withColumn("__y", y.cast("double"))
    prepared = L.features_pipeline(features).fit(rows)
    fitted = L.REGRESSORS[model](**options).setLabelCol("__y").setFeaturesCol("features").setPredictionCol("__p").fit(prepared.transform(rows))

    def predict(df: DataFrame) -> DataFrame:
        out = fitted.transform(prepared.transform(df.dropna(subset=list(features))))
        return out.select(*df.columns, (F.expm1("__p") if transform == "log1p" else F.col("__p")).alias("predicted"))

    return predict


def vote_unfitted(fitted: DataFrame, rest: DataFrame, features: Sequence[str], label: str, k: int = 10, most: int = 20_000) -> DataFrame:
    """Adds ``label`` to rows of ``rest`` by the distance-weighted vote of the k nearest of at most ``most`` fitted rows (broadcast: a bounded sample)."""
    got = fitted.dropna(subset=[label, *features]).orderBy(F.xxhash64(*features), *features).limit(most).select(label, *features).toPandas()
    shared = rest.sparkSession.sparkContext.broadcast((got[list(features)].to_numpy(float), got[label].to_numpy()))
    kind = dict(fitted.dtypes)[label]
    schema = ", ".join(f"`{n}` {t}" for n, t in [*rest.dtypes, (label, kind)])

    def run(batches):
        x, y = shared.value
        classes, code = np.unique(y, return_inverse=True)
        for pdf in batches:
            out = []
            q = pdf[list(features)].to_numpy(float)
            for a in range(0, len(q), 256):
                d = np.sqrt(((q[a : a + 256, None] - x[None]) ** 2).sum(2))
                near = np.argpartition(d, min(k, len(x)) - 1, 1)[:, :k]
                w = 1 / np.maximum(np.take_along_axis(d, near, 1), 1e-12)
                votes = np.stack([np.where(code[near] == c, w, 0).sum(1) for c in range(len(classes))], 1)
                out.append(classes[votes.argmax(1)])
            yield pdf.assign(**{label: np.concatenate(out) if out else np.zeros(0, y.dtype)})

    return rest.dropna(subset=list(features)).mapInPandas(run, schema)


def spectral(x: np.ndarray, k: int, near: int = 10, rounds: int = 100) -> np.ndarray:
    """Cluster numbers of a bounded sample from the graph of nearest neighbours: leading vectors of its normalised matrix, then k means from far-apart seeds. ``vote_unfitted`` takes them to all rows."""
    n = len(x)
    d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(2))
    order = np.argsort(d, 1)[:, 1 : near + 1]
    w = np.zeros((n, n))
    np.put_along_axis(w, order, 1.0, 1)
    w = (w + w.T) / 2
    root = 1 / np.sqrt(np.maximum(w.sum(1), 1e-12))
    vectors = np.linalg.eigh(w * root[:, None] * root[None])[1][:, -k:]
    y = vectors / np.maximum(np.linalg.norm(vectors, axis=1, keepdims=True), 1e-12)
    seeds = [0]
    while len(seeds) < min(k, n):
        seeds.append(int(((y[:, None] - y[seeds][None]) ** 2).sum(2).min(1).argmax()))
    centres = y[seeds]
    for _ in range(rounds):
        own = ((y[:, None] - centres[None]) ** 2).sum(2).argmin(1)
        new = np.stack([y[own == c].mean(0) if (own == c).any() else centres[c] for c in range(len(centres))])
        if np.allclose(new, centres):
            break
        centres = new
    return own


def k_distances(df: DataFrame, key: str, features: Sequence[str], k: int, queries: int = 2000) -> tuple[pd.DataFrame, float]:
    """Sorted distances to the k-th nearest other row, and the knee (largest rank share minus distance share): an eps for DBSCAN.

    Asked for at most ``queries`` rows (the smallest hashes) against all rows: each task keeps its k best, the partial lists meet. For one feature the
    sorted neighbours say it (``kth_distances``).
    """
    if len(features) == 1:
        every = kth_distances(df, key, features[0], k)
        few = every.orderBy(F.xxhash64("key"), "key").limit(queries)
        return _knee(few.where("d is not null").orderBy("d", "key").toPandas())
    rows = df.dropna(subset=[key, *features]).select(F.col(key).cast("long").alias("key"), F.array(*(F.col(f).cast("double") for f in features)).alias("v"))
    asked = rows.orderBy(F.xxhash64("key"), "key").limit(queries).toPandas()
    shared = df.sparkSession.sparkContext.broadcast((asked["key"].to_numpy(), np.stack(asked["v"].to_numpy()) if len(asked) else np.zeros((0, len(features)))))

    def run(batches):
        ids, q = shared.value
        best = np.full((len(q), k), np.inf)
        for pdf in batches:
            x = np.stack(pdf["v"].to_numpy()) if len(pdf) else np.zeros((0, q.shape[1]))
            for a in range(0, len(x), 2048):
                for c in range(0, len(q), 1024):
                    d = np.sqrt(((q[c : c + 1024, None] - x[None, a : a + 2048]) ** 2).sum(2))
                    d[ids[c : c + 1024, None] == pdf["key"].to_numpy()[None, a : a + 2048]] = np.inf
                    best[c : c + 1024] = np.sort(np.concatenate([best[c : c + 1024], d], 1), 1)[:, :k]
        i, j = np.nonzero(np.isfinite(best))
        yield pd.DataFrame({"key": ids[i], "d": best[i, j]})

    parts = rows.mapInPandas(run, "key long, d double")
    ranked = parts.withColumn("r", F.row_number().over(Window.partitionBy("key").orderBy("d"))).where(F.col("r") == k)
    return _knee(ranked.select("key", "d").orderBy("d", "key").toPandas())


def _knee(got: pd.DataFrame) -> tuple[pd.DataFrame, float]:
    if len(got) < 2 or got["d"].iloc[-1] == got["d"].iloc[0]:
        return got, float(got["d"].iloc[0]) if len(got) else 0.0
    x = np.arange(len(got)) / (len(got) - 1)
    y = (got["d"] - got["d"].iloc[0]) / (got["d"].iloc[-1] - got["d"].iloc[0])
    return got, float(got["d"].iloc[int((x - y).argmax())])


#: Rows of sorted values that one task takes.
SORTED_ROWS = 50_000


def kth_distances(df: DataFrame, key: str, feature: str, k: int) -> DataFrame:
    """``key, d``: the distance of each row's value to the k-th nearest other row's (null with fewer rows).

    Rows are cut at quantiles of the value; a part knows, besides its own values, the k next ones below and above it, so that each row's 2 k sorted neighbours are at hand.
    """
    from loamgrid.storage import Staged

    rows = Staged(df.dropna(subset=[key, feature]).select(F.col(key).cast("long").alias("key"), F.col(feature).cast("double").alias("v")))
    parts = rows.rows // SORTED_ROWS + 1
    cuts = sorted(set(rows.df.approxQuantile("v", [i / parts for i in range(1, parts)], 0.1 / parts))) if parts > 1 else []
    part = F.size(F.filter(F.array(*(F.lit(c) for c in cuts)), lambda c: c < F.col("v"))) if cuts else F.lit(0)
    cut = Staged(rows.df.withColumn("part", part)).df

    def ends(pdf: pd.DataFrame) -> pd.DataFrame:
        v = np.sort(pdf["v"].to_numpy())
        return pd.DataFrame({"part": [pdf["part"].iloc[0]], "least": [v[:k].tolist()], "most": [v[-k:].tolist()]})

    rims = sorted(cut.groupBy("part").applyInPandas(ends, "part int, least array<double>, most array<double>").collect())
    below, above, low, high = {}, {}, [], []
    for r in rims:
        below[r["part"]], low = low, sorted(low + r["most"])[-k:]
    for r in reversed(rims):
        above[r["part"]], high = high, sorted(high + r["least"])[:k]

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf, n = pdf.sort_values(["v", "key"]), int(pdf["part"].iloc[0])
        every = np.concatenate([np.full(k, -np.inf), below[n], pdf["v"].to_numpy(), above[n], np.full(k, np.inf)])
        at = np.arange(len(pdf)) + k + len(below[n])
        d = np.stack([np.abs(every[at + j] - every[at]) for j in (*range(-k, 0), *range(1, k + 1))], 1)
        d = np.sort(d, 1)[:, k - 1]
        return pd.DataFrame({"key": pdf["key"].to_numpy(), "d": pd.array(np.where(np.isfinite(d), d, np.nan), dtype="Float64")})

    out = cut.groupBy("part").applyInPandas(run, "key long, d double")
    return out.withColumn("d", F.when(~F.isnan("d"), F.col("d")))


def linkage(x: np.ndarray) -> np.ndarray:
    """Merge order of a bounded sample by average linkage: rows a, b, distance, size (as in a dendrogram), by chains of nearest neighbours."""
    n = len(x)
    d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(2))
    np.fill_diagonal(d, np.inf)
    size, alive, merges, chain = np.ones(n), np.ones(n, bool), [], []
    while alive.sum() > 1:
        if not chain:
            chain = [int(np.flatnonzero(alive)[0])]
        a = chain[-1]
        row = np.where(alive, d[a], np.inf)
        b = int(row.argmin())
        if len(chain) > 1 and row[chain[-2]] <= row[b]:
            b = chain[-2]
        if len(chain) > 1 and b == chain[-2]:
            merges.append((a, b, d[a, b]))
            chain = chain[:-2]
            mean = (size[a] * d[a] + size[b] * d[b]) / (size[a] + size[b])
            d[a], d[:, a] = mean, mean
            d[a, a] = np.inf
            size[a] += size[b]
            alive[b] = False
        else:
            chain.append(b)
    merges.sort(key=lambda m: m[2])
    name, count, out = {i: i for i in range(n)}, dict.fromkeys(range(n), 1), []
    parent = list(range(n))

    def root(i: int) -> int:
        while parent[i] != i:
            i = parent[i]
        return i

    for k, (a, b, far) in enumerate(merges):
        p, q = root(a), root(b)
        total = count[p] + count[q]
        out.append((min(name[p], name[q]), max(name[p], name[q]), far, total))
        parent[q] = p
        name[p], count[p] = n + k, total
    return np.array(out, float).reshape(-1, 4)


def trustworthiness(x: np.ndarray, y: np.ndarray, k: int = 10) -> float:
    """How far neighbours in a map ``y`` of a bounded sample are neighbours in ``x`` (1: all)."""
    n = len(x)
    k = min(k, max(1, (n - 1) // 2))
    far = lambda a: ((a[:, None] - a[None]) ** 2).sum(2) + np.diag(np.full(n, np.inf))
    rank = np.argsort(np.argsort(far(x), 1), 1) + 1
    near = np.argsort(far(y), 1)[:, :k]
    extra = np.maximum(0, np.take_along_axis(rank, near, 1) - k).sum()
    return float(1 - 2 / (n * k * (2 * n - 3 * k - 1)) * extra) if n > 2 else 1.0
