"""Supervised and unsupervised models over feature columns, embeddings, splits and preparation."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.ml import Pipeline
from pyspark.ml import classification as C
from pyspark.ml import clustering as K
from pyspark.ml import feature as P
from pyspark.ml import regression as R
from pyspark.ml.evaluation import ClusteringEvaluator
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loamgrid.functions.expressions import finite
from loamgrid.operators.quantiles import exact_quantiles
from loamgrid.operators.raster import spread_labels

# --- Embeddings ------------------------------------------------------------------------------------------------------


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, v: s + v)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def unit(a: Column) -> Column:
    """Length 1; a zero vector stays as it is."""
    n = norm(a)
    return F.transform(F.array(n), lambda m: F.transform(a, lambda x: F.coalesce(F.try_divide(x.cast("double"), m), F.lit(0.0))))[0]


def cosine(a: Column, b: Column) -> Column:
    return F.try_divide(dot(a, b), norm(a) * norm(b))


def mean_vectors(df: DataFrame, by: Sequence[str], vector: str) -> DataFrame:
    """``by, mean`` (array) and ``n``: exploded by place and averaged, so it combines map-side."""
    each = df.where(F.col(vector).isNotNull()).select(*by, F.posexplode(vector).alias("i", "x"))
    means = each.groupBy(*by, "i").agg(F.avg(F.col("x").cast("double")).alias("m"), F.count("*").alias("n"))
    return means.groupBy(*by).agg(F.transform(F.sort_array(F.collect_list(F.struct("i", "m"))), lambda s: s["m"]).alias("mean"), F.max("n").alias("n"))


def nearest_mean(df: DataFrame, means: DataFrame, vector: str, label: str, angle: bool = False) -> DataFrame:
    """Adds ``predicted`` and ``score``: the class with the nearest mean, or with the smallest angle to it. Means are one row a class."""
    table = means.agg(F.sort_array(F.collect_list(F.struct(F.col(label).alias("c"), F.col("mean").alias("m")))).alias("__means"))
    v = F.col(vector)
    if angle:
        score = lambda m: F.acos(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), cosine(v, m))))
    else:
        score = lambda m: F.sqrt(F.aggregate(F.zip_with(v, m, lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda s, d: s + d))
    scored = df.join(F.broadcast(table)).withColumn("__best", F.array_min(F.transform("__means", lambda s: F.struct(score(s["m"]).alias("d"), s["c"].alias("c")))))
    return scored.withColumns({"predicted": F.col("__best.c"), "score": F.col("__best.d")}).drop("__means", "__best")


def similarity_summary(df: DataFrame, score: str) -> DataFrame:
    """Mean, exact median and 95 % quantile of a score, and the share over 0.9."""
    q = [F.lit(x).cast("double") for x in exact_quantiles(df, {"s": F.col(score)}, (0.5, 0.95))["s"]]
    return df.agg(F.avg(score).alias("mean"), F.avg((F.col(score) > 0.9).cast("double")).alias("over_09")).select("mean", q[0].alias("p50"), q[1].alias("p95"), "over_09")


def encode_sqrt(v: Column) -> Column:
    """int8 codes: sign(x) * sqrt|x| * 127.5, half to even."""
    return F.transform(v, lambda x: F.greatest(F.lit(-127), F.least(F.lit(127), F.bround(F.signum(x.cast("double")) * F.sqrt(F.abs(x.cast("double"))) * 127.5))).cast("tinyint"))


def decode_sqrt(v: Column) -> Column:
    """Back to numbers; -128 is missing."""
    return F.transform(v, lambda x: F.when(x != -128, F.signum(x.cast("double")) * F.pow(x.cast("double") / 127.5, 2)))


def linear_scales(df: DataFrame, vector: str) -> list[float]:
    """The largest absolute value of each dimension over 127: one number a dimension."""
    rows = df.select(F.posexplode(vector).alias("i", "x")).groupBy("i").agg(F.max(F.abs("x")).alias("m")).orderBy("i").collect()
    return [float(r.m) / 127 or 1.0 for r in rows]


def encode_linear(v: Column, scales: Sequence[float]) -> Column:
    return F.zip_with(v, F.array(*map(F.lit, scales)), lambda x, s: F.bround(x.cast("double") / s).cast("tinyint"))


def neighbours_exact(queries: DataFrame, base: DataFrame, key: str, vector: str, k: int, batch: int = 50_000) -> DataFrame:
    """``query, near, score``: the k most similar rows of ``base`` for each query by cosine, exactly.

    A stated query set against all rows, in blocks: ``batch`` query vectors (bounded) travel to the tasks for one reading of ``base``, so that a reading is
    small beside its products; every task keeps its best k for each query, and the partial lists meet. Rows never pair up with one another.
    """
    spark, out = base.sparkSession, None
    rows = queries.where(F.col(vector).isNotNull()).select(F.col(key).alias("k"), F.col(vector).alias("v"))
    part = base.where(F.col(vector).isNotNull()).select(F.col(key).cast("long").alias("k"), F.col(vector).alias("v"))
    block: list = []

    def ask(block) -> DataFrame:
        q = np.array([r.v for r in block], np.float32)
        q /= np.maximum(np.linalg.norm(q, axis=1, keepdims=True), 1e-12)
        shared = spark.sparkContext.broadcast((np.array([r.k for r in block], np.int64), q))

        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            ids, q = shared.value
            best_s, best_k = np.full((len(q), k), -np.inf, np.float32), np.zeros((len(q), k), np.int64)
            for pdf in batches:
                if not len(pdf):
                    continue
                x = np.stack(pdf["v"].to_numpy()).astype(np.float32)
                x /= np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)
                keys = pdf["k"].to_numpy(np.int64)
                for a in range(0, len(q), 1024):
                    part = slice(a, a + 1024)
                    s = q[part] @ x.T
                    s[ids[part, None] == keys[None]] = -np.inf
                    s, kk = np.concatenate([best_s[part], s], 1), np.concatenate([best_k[part], np.broadcast_to(keys, (len(s), len(keys)))], 1)
                    top = np.argpartition(-s, k - 1, 1)[:, :k]
                    best_s[part], best_k[part] = np.take_along_axis(s, top, 1), np.take_along_axis(kk, top, 1)
            i, j = np.nonzero(np.isfinite(best_s))
            yield pd.DataFrame({"query": ids[i], "near": best_k[i, j], "score": best_s[i, j].astype(float)})

        return part.mapInPandas(run, "query long, near long, score double")

    for r in rows.toLocalIterator():
        block.append(r)
        if len(block) == batch:
            out, block = (ask(block) if out is None else out.unionByName(ask(block))), []
    if block or out is None:
        last = ask(block) if block else base.select(F.col(key).cast("long").alias("query"), F.col(key).cast("long").alias("near"), F.lit(0.0).alias("score")).limit(0)
        out = last if out is None else out.unionByName(last)
    best = out.withColumn("__r", F.row_number().over(Window.partitionBy("query").orderBy(F.desc("score"), "near"))).where(F.col("__r") <= k)
    return best.drop("__r")


def knn_vote(near: DataFrame, labels: DataFrame, key: str, label: str) -> DataFrame:
    """``query, predicted``: the label with the largest similarity sum of the neighbours, the smaller of equals."""
    votes = near.join(labels.select(F.col(key).alias("near"), F.col(label).alias("label")), "near").groupBy("query", "label").agg(F.sum(F.round("score", 6)).alias("s"))
    return votes.groupBy("query").agg(F.max_by("label", F.struct("s", -F.col("label"))).alias("predicted"))


# --- Preparation -----------------------------------------------------------------------------------------------------


def impute(df: DataFrame, numbers: Sequence[str] = (), words: Sequence[str] = ()) -> DataFrame:
    """Exact medians (found before the result is built) for missing numbers, '(missing)' for words."""
    out = df
    if numbers:
        med = exact_quantiles(df, {c: F.col(c) for c in numbers}, (0.5,))
        out = out.withColumns({c: F.coalesce(finite(F.col(c).cast("double")), F.lit(med[c][0]).cast("double")) for c in numbers})
    return out.withColumns({c: F.coalesce(F.nullif(F.col(c), F.lit("")), F.lit("(missing)")) for c in words})


def clip_quantiles(df: DataFrame, columns: Sequence[str], lo: float = 0.01, hi: float = 0.99) -> DataFrame:
    """Values beyond the exact ``lo`` and ``hi`` quantiles become these; null stays null."""
    q = exact_quantiles(df, {c: F.col(c) for c in columns}, (lo, hi))
    clipped = lambda c: F.least(F.greatest(F.col(c), F.lit(q[c][0]).cast("double")), F.lit(q[c][1]).cast("double"))
    return df.withColumns({c: F.when(F.col(c).isNotNull(), clipped(c)) for c in columns})


def yeo_johnson(x: Column, lam: float) -> Column:
    """Power transform for any sign."""
    pos = F.log1p(x) if abs(lam) < 1e-9 else (F.pow(x + 1, F.lit(lam)) - 1) / lam
    neg = -F.log1p(-x) if abs(lam - 2) < 1e-9 else -(F.pow(1 - x, F.lit(2 - lam)) - 1) / (2 - lam)
    return F.when(x >= 0, pos).otherwise(neg)


def fit_yeo_johnson(df: DataFrame, column: str, grid: Sequence[float] = tuple(np.round(np.arange(-2, 4.01, 0.25), 2))) -> float:
    """The exponent with the largest likelihood on a grid, all candidates in one pass."""
    x = finite(F.col(column).cast("double"))
    jac = F.avg(F.signum(x) * F.log1p(F.abs(x)))
    r = df.agg(jac.alias("j"), *(F.var_pop(yeo_johnson(x, float(lam))).alias(f"v{i}") for i, lam in enumerate(grid))).first()
    like = [-0.5 * np.log(r[f"v{i}"]) + (lam - 1) * r["j"] if r[f"v{i}"] else -np.inf for i, lam in enumerate(grid)]
    return float(grid[int(np.argmax(like))])


SCALERS = {"standard": lambda i, o: P.StandardScaler(inputCol=i, outputCol=o, withMean=True), "minmax": lambda i, o: P.MinMaxScaler(inputCol=i, outputCol=o), "robust": lambda i, o: P.RobustScaler(inputCol=i, outputCol=o, withCentering=True)}


def features_pipeline(numbers: Sequence[str], words: Sequence[str] = (), scale: str | None = "standard", components: int = 0) -> Pipeline:
    """Assembled ``features``: scaled numbers, one-hot words, optionally reduced by PCA. Fit it on training rows only."""
    stages = [P.VectorAssembler(inputCols=list(numbers), outputCol="__n", handleInvalid="skip")]
    last = "__n"
    if scale:
        stages.append(SCALERS[scale]("__n", "__s"))
        last = "__s"
    if words:
        stages += [P.StringIndexer(inputCols=list(words), outputCols=[f"__i_{w}" for w in words], handleInvalid="keep"), P.OneHotEncoder(inputCols=[f"__i_{w}" for w in words], outputCols=[f"__o_{w}" for w in words])]
        stages.append(P.VectorAssembler(inputCols=[last, *(f"__o_{w}" for w in words)], outputCol="__a"))
        last = "__a"
    if components:
        stages.append(P.PCA(k=components, inputCol=last, outputCol="features"))
    else:
        stages.append(P.VectorAssembler(inputCols=[last], outputCol="features"))
    return Pipeline(stages=stages)


# --- Models ----------------------------------------------------------------------------------------------------------

CLASSIFIERS = {
    "rf": lambda **o: C.RandomForestClassifier(seed=0, **o), "dt": lambda **o: C.DecisionTreeClassifier(seed=0, **o),
    "et": lambda **o: C.RandomForestClassifier(seed=0, subsamplingRate=0.7, **o), "lr": lambda **o: C.LogisticRegression(**({"regParam": 1e-3} | o)),
    "sgd": lambda **o: C.LogisticRegression(maxIter=20, **o), "nb": lambda **o: C.NaiveBayes(modelType="gaussian", **o),
    "svm": lambda **o: C.OneVsRest(classifier=C.LinearSVC(maxIter=50, **o)), "mlp": lambda layers, **o: C.MultilayerPerceptronClassifier(layers=layers, seed=0, **o),
    "gbt": lambda **o: C.OneVsRest(classifier=C.GBTClassifier(seed=0, **({"maxIter": 10} | o))),
}
REGRESSORS = {"rf": lambda **o: R.RandomForestRegressor(seed=0, **o), "dt": lambda **o: R.DecisionTreeRegressor(seed=0, **o), "gbt": lambda **o: R.GBTRegressor(seed=0, **o), "linear": lambda **o: R.LinearRegression(**({"regParam": 1e-3} | o))}


def task_of(df: DataFrame, target: str) -> str:
    """classification for text and for whole numbers with at most 100 distinct values, else regression."""
    kind = dict(df.dtypes)[target]
    if kind == "string" or kind == "boolean":
        return "classification"
    r = df.agg(F.bool_and(F.col(target) == F.floor(target)).alias("whole"), F.approx_count_distinct(target).alias("n")).first()
    return "classification" if r.whole and r.n <= 100 else "regression"


def gaussian_class_stats(df: DataFrame, label: str, features: Sequence[str]) -> pd.DataFrame:
    """Per class: rows, means and covariances in one aggregation (one row a class comes to the driver)."""
    aggs = [F.count("*").alias("n"), *(F.avg(f).alias(f"m{i}") for i, f in enumerate(features)), *(F.covar_samp(a, b).alias(f"c{i}_{j}") for i, a in enumerate(features) for j, b in enumerate(features) if i <= j)]
    return df.dropna(subset=[label, *features]).groupBy(label).agg(*aggs).orderBy(label).toPandas()


def gaussian_classify(df: DataFrame, stats: pd.DataFrame, label: str, features: Sequence[str], pooled: bool = False, ridge: float = 1e-6) -> DataFrame:
    """Adds ``predicted``: maximum likelihood with each class's covariance, or linear discriminants with the pooled one. Pure Column arithmetic."""
    d = len(features)
    covs = []
    for _, r in stats.iterrows():
        c = np.array([[r[f"c{min(i, j)}_{max(i, j)}"] for j in range(d)] for i in range(d)], float)
        covs.append(np.nan_to_num(c) + ridge * np.eye(d))
    n = stats["n"].to_numpy(float)
    if pooled:
        covs = [sum(c * (k - 1) for c, k in zip(covs, n, strict=True)) / max(1.0, (n - 1).sum())] * len(covs)
    scores = []
    for (_, r), c in zip(stats.iterrows(), covs, strict=True):
        # Whitened by the triangular root: one square for each feature.
        root, (_, logdet) = np.linalg.inv(np.linalg.cholesky(c)), np.linalg.slogdet(c)
        shift = root @ r[[f"m{i}" for i in range(d)]].to_numpy(float)
        quad = F.lit(0.0)
        for i in range(d):
            z = sum((float(root[i, j]) * F.col(features[j]) for j in range(i + 1)), F.lit(-float(shift[i])))
            quad = quad + z * z
        prior = float(np.log(r["n"] / n.sum())) if pooled else 0.0
        label_value = r[label].item() if hasattr(r[label], "item") else r[label]
        scores.append(F.struct((-(quad + float(logdet)) / 2 + prior).alias("s"), F.lit(label_value).alias("c")))
    best = F.greatest(*scores) if len(scores) > 1 else scores[0]
    known = F.lit(True)
    for f in features:
        known = known & F.col(f).isNotNull()
    return df.withColumn("predicted", F.when(known, best["c"]))


def train_classifier(train: DataFrame, label: str, numbers: Sequence[str], model: str = "rf", words: Sequence[str] = (), scale: str | None = "standard", **options):
    """A fitted pipeline: label index, features, model, label text back in ``predicted``."""
    index = P.StringIndexer(inputCol=label, outputCol="__y", handleInvalid="skip").fit(train)
    est = CLASSIFIERS[model](**options)
    est = est.setLabelCol("__y").setFeaturesCol("features")
    back = P.IndexToString(inputCol="prediction", outputCol="predicted", labels=index.labels)
    return Pipeline(stages=[index, features_pipeline(numbers, words, scale), est, back]).fit(train)


def feature_importance(model, numbers: Sequence[str]) -> list[tuple[str, float]]:
    """Tree importances by source column, largest first; the one-hot columns of a word add up under 'words'."""
    imp = model.stages[-2].featureImportances.toArray()
    out = [(c, float(v)) for c, v in zip(numbers, imp, strict=False)]
    if len(imp) > len(numbers):
        out.append(("words", float(imp[len(numbers) :].sum())))
    total = sum(v for _, v in out) or 1.0
    return sorted(((c, v / total) for c, v in out), key=lambda x: -x[1])


# --- Splits ----------------------------------------------------------------------------------------------------------


def hash_fraction(*cols: Column, seed: int = 0) -> Column:
    return F.shiftrightunsigned(F.xxhash64(*cols, F.lit(seed)), 11).cast("double") / float(1 << 53)


def grouped_split(df: DataFrame, group: Column, test: float, seed: int = 0) -> DataFrame:
    """Adds ``split``; all rows of a group land together."""
    return df.withColumn("split", F.when(hash_fraction(group, seed=seed) < test, "test").otherwise("train"))


def block_key(df: DataFrame, x: str, y: str, blocks: int = 8) -> DataFrame:
    """Adds ``block``: the number of the square the point lies in, an eighth of the larger extent wide."""
    e = F.broadcast(df.agg(F.min(x).alias("__x0"), F.min(y).alias("__y0"), F.greatest(F.max(x) - F.min(x), F.max(y) - F.min(y)).alias("__w")))
    side = F.when(F.col("__w") > 0, F.col("__w") / blocks).otherwise(1.0)
    return df.join(e).withColumn("block", (F.floor((F.col(x) - F.col("__x0")) / side) * 1_000_000 + F.floor((F.col(y) - F.col("__y0")) / side)).cast("long")).drop("__x0", "__y0", "__w")


def stratified_split(df: DataFrame, label: str, key: str, test: float, seed: int = 0) -> DataFrame:
    """Adds ``split``; the same share of every class by a hash of class and key."""
    return df.withColumn("split", F.when(hash_fraction(F.col(label).cast("string"), F.col(key), seed=seed) < test, "test").otherwise("train"))


# --- Unsupervised ----------------------------------------------------------------------------------------------------

CLUSTERINGS = {"kmeans": lambda k, seed=0: K.KMeans(k=k, seed=seed), "hierarchical": lambda k, seed=0: K.BisectingKMeans(k=k, seed=seed), "gmm": lambda k, seed=0: K.GaussianMixture(k=k, seed=seed)}


def cluster(df: DataFrame, features: Sequence[str] | str, method: str = "kmeans", k: int = 5, scale: bool = True, seed: int = 0):
    """Adds ``cluster`` (1 is the largest); returns the DataFrame and the fitted model."""
    if isinstance(features, str):
        from pyspark.ml.functions import array_to_vector

        rows = df.where(F.col(features).isNotNull()).withColumn("features", array_to_vector(F.transform(features, lambda x: x.cast("double"))))
    else:
        rows = features_pipeline(list(features), scale="standard" if scale else None).fit(df).transform(df)
    model = CLUSTERINGS[method](k, seed).fit(rows)
    out = model.transform(rows).drop("features", "probability", "__n", "__s")
    return relabel_by_size(out, "prediction", "cluster").drop("prediction"), model


def relabel_by_size(df: DataFrame, label: str, name: str, noise: int | str = -1) -> DataFrame:
    """Labels 1.. by falling size (ties by old label); noise becomes 0."""
    sizes = df.where(F.col(label) != noise).groupBy(F.col(label).alias("__l")).agg(F.count("*").alias("__n"))
    ranks = sizes.select("__l", F.row_number().over(Window.orderBy(F.desc("__n"), "__l")).alias(name))  # one row a cluster
    return df.join(ranks, F.col(label) == F.col("__l"), "left").withColumn(name, F.coalesce(name, F.lit(0))).drop("__l")


def choose_k(df: DataFrame, k_max: int, features: str = "features", seed: int = 0) -> list[tuple[int, float, float, float]]:
    """``k, silhouette, inertia, bic`` for k = 2..k_max on an assembled column; the silhouette is that of squared distances.

    bic = n d ln(inertia / (n d)) + k d ln(n): the lower the better (spherical clusters of one spread).
    """
    out = []
    for k in range(2, k_max + 1):
        model = K.KMeans(k=k, seed=seed, featuresCol=features).fit(df)
        put = model.transform(df)
        n, d, inertia = sum(model.summary.clusterSizes), len(model.clusterCenters()[0]), model.summary.trainingCost
        bic = n * d * float(np.log(max(inertia, 1e-300) / (n * d))) + k * d * float(np.log(n))
        out.append((k, ClusteringEvaluator(featuresCol=features).evaluate(put), inertia, bic))
    return out


def cluster_profile(df: DataFrame, label: str, features: Sequence[str]) -> DataFrame:
    """``cluster, feature, n, mean, z``: means per cluster, and how far from the overall mean in overall deviations."""
    each = df.select(F.col(label).alias("cluster"), F.explode(F.array(*(F.struct(F.lit(f).alias("feature"), F.col(f).cast("double").alias("v")) for f in features))).alias("e")).select("cluster", "e.feature", "e.v")
    total = each.groupBy("feature").agg(F.avg("v").alias("m"), F.stddev_pop("v").alias("s"))
    return each.groupBy("cluster", "feature").agg(F.count("v").alias("n"), F.avg("v").alias("mean")).join(total, "feature").select("cluster", "feature", "n", "mean", F.try_divide(F.col("mean") - F.col("m"), "s").alias("z"))


def cluster_quality(df: DataFrame, label: str, features: Sequence[str]) -> DataFrame:
    """One row: inertia, Calinski-Harabasz and Davies-Bouldin, from class means (no pairs of rows)."""
    d = list(features)
    cen = df.groupBy(label).agg(F.count("*").alias("n"), *(F.avg(f).alias(f"c_{f}") for f in d))
    sq = lambda a, b: sum(((F.col(p) - F.col(q)) ** 2 for p, q in zip(a, b, strict=True)), F.lit(0.0))
    rows = df.join(F.broadcast(cen.drop("n")), label).select(label, sq(d, [f"c_{f}" for f in d]).alias("w"), *d)
    within = rows.groupBy(label).agg(F.sum("w").alias("w"), F.avg(F.sqrt("w")).alias("s"))
    per = cen.join(within, label)
    all_ = df.agg(F.count("*").alias("t"), *(F.avg(f).alias(f"g_{f}") for f in d))
    ch = per.join(F.broadcast(all_)).agg(F.sum("w").alias("inertia"), F.sum(F.col("n") * sq([f"c_{f}" for f in d], [f"g_{f}" for f in d])).alias("between"), F.count("*").alias("k"), F.max("t").alias("t"))
    other = per.select(F.col(label).alias("o"), F.col("s").alias("so"), *(F.col(f"c_{f}").alias(f"o_{f}") for f in d))
    # Clusters against clusters: k x k rows.
    db = per.join(F.broadcast(other), F.col(label) != F.col("o")).groupBy(label).agg(F.max(F.try_divide(F.col("s") + F.col("so"), F.sqrt(sq([f"c_{f}" for f in d], [f"o_{f}" for f in d])))).alias("r")).agg(F.avg("r").alias("davies_bouldin"))
    return ch.join(F.broadcast(db)).select("inertia", F.try_divide(F.col("between") / (F.col("k") - 1), F.col("inertia") / (F.col("t") - F.col("k"))).alias("calinski_harabasz"), "davies_bouldin")


def dbscan(pairs: DataFrame, nodes: DataFrame, min_samples: int) -> DataFrame:
    """``node, cluster`` from neighbour pairs within eps (a < b): cores, their components, border points to the least core's cluster; noise -1."""
    both = pairs.select("a", "b").union(pairs.select("b", "a"))
    cores = nodes.join(both.groupBy("a").agg(F.count("*").alias("n")), F.col("node") == F.col("a"), "left").where(F.coalesce("n", F.lit(0)) + 1 >= min_samples).select("node")
    core_pairs = pairs.join(cores.select(F.col("node").alias("a")), "a", "left_semi").join(cores.select(F.col("node").alias("b")), "b", "left_semi")
    labels = spread_labels(cores, core_pairs)
    border = both.join(labels, both.b == labels.node).groupBy("a").agg(F.min("label").alias("near"))
    out = nodes.join(labels.withColumnRenamed("label", "own"), "node", "left").join(border, F.col("node") == F.col("a"), "left")
    return out.select("node", F.coalesce("own", "near", F.lit(-1)).alias("cluster"))


def principal_components(df: DataFrame, features: Sequence[str] | str, k: int, prefix: str = "pc"):
    """Adds ``<prefix>1..k`` of standardised features, each with its largest loading positive; returns (df, explained, loadings)."""
    if isinstance(features, str):
        from pyspark.ml.functions import array_to_vector

        rows = df.where(F.col(features).isNotNull()).withColumn("__n", array_to_vector(F.transform(features, lambda x: x.cast("double"))))
        rows = P.StandardScaler(inputCol="__n", outputCol="__s", withMean=True).fit(rows).transform(rows)
    else:
        ok = df.dropna(subset=list(features))
        rows = Pipeline(stages=[P.VectorAssembler(inputCols=list(features), outputCol="__n"), P.StandardScaler(inputCol="__n", outputCol="__s", withMean=True)]).fit(ok).transform(ok)
    model = P.PCA(k=k, inputCol="__s", outputCol="__p").fit(rows)
    load = model.pc.toArray()
    sign = np.sign(load[np.abs(load).argmax(0), np.arange(k)])
    out = model.transform(rows).withColumn("__a", vector_to_array("__p"))
    out = out.withColumns({f"{prefix}{i + 1}": F.col("__a")[i] * float(sign[i]) for i in range(k)}).drop("__n", "__s", "__p", "__a")
    return out, model.explainedVariance.toArray().tolist(), (load * sign).tolist()


def factor_model(sample: np.ndarray, method: str, k: int, seed: int = 0, rounds: int = 200) -> dict:
    """A linear transform fitted on a bounded sample: ``svd``, ``nmf``, ``ica`` or ``fa``; apply it with transform_linear."""
    x, rng = np.asarray(sample, float), np.random.default_rng(seed)
    if method == "nmf":
        lo, hi = np.percentile(x, 0.5, 0), np.percentile(x, 99.5, 0)
        y = np.clip((x - lo) / np.maximum(hi - lo, 1e-12), 0, 1)
        w, h = rng.random((len(y), k)) + 0.1, rng.random((k, y.shape[1])) + 0.1
        for _ in range(rounds):
            h *= (w.T @ y) / np.maximum(w.T @ w @ h, 1e-12)
            w *= (y @ h.T) / np.maximum(w @ h @ h.T, 1e-12)
        return {"mean": lo, "scale": np.maximum(hi - lo, 1e-12), "matrix": np.linalg.pinv(h)}
    m, s = x.mean(0), np.maximum(x.std(0), 1e-12)
    z = (x - m) / s
    if method == "svd":
        return {"mean": m * 0, "scale": np.ones_like(s), "matrix": np.linalg.svd(x, full_matrices=False)[2][:k].T}
    u, d, vt = np.linalg.svd(z, full_matrices=False)
    if method == "fa":
        psi = np.ones(z.shape[1])
        for _ in range(rounds):
            q = np.sqrt(psi) + 1e-12
            _, d, vt = np.linalg.svd(z / q / np.sqrt(len(z)), full_matrices=False)
            load = (vt[:k].T * np.sqrt(np.maximum(d[:k] ** 2 - 1, 0))) * q[:, None]
            psi = np.maximum(1 - (load**2).sum(1), 1e-6)
        g = load.T / psi
        return {"mean": m, "scale": s, "matrix": (np.linalg.inv(np.eye(k) + g @ load) @ g).T}
    white = vt[:k].T / np.maximum(d[:k], 1e-12) * np.sqrt(len(z))
    y, w = z @ white, np.linalg.qr(rng.normal(size=(k, k)))[0]
    for _ in range(rounds):
        t = np.tanh(y @ w.T)
        new = t.T @ y / len(y) - np.diag((1 - t**2).mean(0)) @ w
        a, _, b = np.linalg.svd(new)
        w = a @ b
    return {"mean": m, "scale": s, "matrix": white @ w.T}


def transform_linear(df: DataFrame, features: Sequence[str], model: dict, prefix: str = "f") -> DataFrame:
    """The fitted transform as Column arithmetic."""
    z = [(F.col(f) - float(model["mean"][i])) / float(model["scale"][i]) for i, f in enumerate(features)]
    m = np.asarray(model["matrix"])
    return df.withColumns({f"{prefix}{j + 1}": sum((z[i] * float(m[i, j]) for i in range(len(z))), F.lit(0.0)) for j in range(m.shape[1])})


def tsne(x: np.ndarray, perplexity: float = 30.0, rounds: int = 300, seed: int = 0) -> np.ndarray:
    """Two-dimensional map of a bounded sample (rows x features), perplexity at most a third of the rows."""
    n = len(x)
    d2 = ((x[:, None] - x[None]) ** 2).sum(2)
    target, p = np.log(min(perplexity, (n - 1) / 3)), np.zeros((n, n))
    for i in range(n):
        lo, hi, beta = 0.0, np.inf, 1.0
        for _ in range(50):
            e = np.exp(-(d2[i] - d2[i].min()) * beta)
            e[i] = 0
            q = e / max(e.sum(), 1e-300)
            h = -(q[q > 0] * np.log(q[q > 0])).sum()
            lo, hi = (beta, hi) if h > target else (lo, beta)
            beta = beta * 2 if hi == np.inf else (lo + hi) / 2
        p[i] = q
    p = np.maximum((p + p.T) / (2 * n), 1e-12)
    y, v = np.random.default_rng(seed).normal(scale=1e-4, size=(n, 2)), np.zeros((n, 2))
    for t in range(rounds):
        k = 1 / (1 + ((y[:, None] - y[None]) ** 2).sum(2))
        np.fill_diagonal(k, 0)
        g = (p * (12 if t < 100 else 1) - np.maximum(k / k.sum(), 1e-12)) * k
        v = (0.5 if t < 100 else 0.8) * v - 200 * 4 * (np.diag(g.sum(1)) - g) @ y
        y = y + v
    return y


