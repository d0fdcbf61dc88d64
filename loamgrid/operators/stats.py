"""Accuracy, area estimates, agreement, errors and class breaks, from small aggregates."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from loamgrid.functions.expressions import finite
from loamgrid.operators.quantiles import exact_quantiles


def confusion(df: DataFrame, mapped: str, reference: str) -> DataFrame:
    """``map, ref, n`` counts of rows with both."""
    return df.where(F.col(mapped).isNotNull() & F.col(reference).isNotNull()).groupBy(F.col(mapped).alias("map"), F.col(reference).alias("ref")).agg(F.count("*").alias("n"))


def matrix_csv(cm: DataFrame, most: int = 1000) -> str:
    """A confusion matrix as text: a line a mapped class, a column a reference class. At most ``most`` classes (cells of classes come to the driver)."""
    cells = {(str(r.map), str(r.ref)): r.n for r in cm.limit(most * most).collect()}
    names = sorted({n for pair in cells for n in pair})
    quoted = lambda t: '"' + t.replace('"', '""') + '"' if any(ch in t for ch in ',"\n') else t
    head = ",".join(["map \\ reference", *map(quoted, names)])
    return "\n".join([head, *(",".join([quoted(m), *(str(cells.get((m, r), 0)) for r in names)]) for m in names)]) + "\n"


def _margins(cm: DataFrame) -> DataFrame:
    """Per class: mapped, referenced and agreeing rows, and the total. One row a class."""
    both = cm.select(F.explode(F.array(F.struct(F.col("map").alias("class"), F.col("n").alias("mapped"), F.lit(0).cast("long").alias("referenced"), F.when(F.col("map") == F.col("ref"), F.col("n")).otherwise(0).alias("hit")), F.struct(F.col("ref").alias("class"), F.lit(0).cast("long").alias("mapped"), F.col("n").alias("referenced"), F.lit(0).cast("long").alias("hit")))).alias("e")).select("e.*")
    per = both.groupBy("class").agg(F.sum("mapped").alias("mapped"), F.sum("referenced").alias("referenced"), F.sum("hit").alias("hit"))
    return per.withColumn("total", F.sum("mapped").over(Window.partitionBy()))


def class_accuracy(cm: DataFrame) -> DataFrame:
    """Per class: user's (precision) and producer's accuracy (recall), F1, IoU and support."""
    m = _margins(cm)
    users, producers = F.try_divide("hit", "mapped"), F.try_divide("hit", "referenced")
    return m.select("class", users.alias("users"), producers.alias("producers"), F.try_divide(2 * F.col("hit"), F.col("mapped") + F.col("referenced")).alias("f1"), F.try_divide("hit", F.col("mapped") + F.col("referenced") - F.col("hit")).alias("iou"), F.col("referenced").alias("support"))


def overall_accuracy(cm: DataFrame) -> DataFrame:
    """One row: n, accuracy, kappa, balanced accuracy, macro and weighted F1, mean IoU over present classes, Matthews correlation."""
    m = _margins(cm)
    n, hit = F.max("total").cast("double"), F.sum("hit").cast("double")
    agree = F.sum(F.col("mapped").cast("double") * F.col("referenced"))
    map2, ref2 = F.sum(F.pow(F.col("mapped").cast("double"), 2)), F.sum(F.pow(F.col("referenced").cast("double"), 2))
    f1 = F.try_divide(2 * F.col("hit"), F.col("mapped") + F.col("referenced"))
    a = m.agg(n.alias("n"), hit.alias("hit"), agree.alias("agree"), map2.alias("map2"), ref2.alias("ref2"), F.avg(F.try_divide("hit", "referenced")).alias("balanced_accuracy"), F.avg(f1).alias("macro_f1"), (F.sum(f1 * F.col("referenced")) / F.sum("referenced")).alias("weighted_f1"), F.avg(F.try_divide("hit", F.col("mapped") + F.col("referenced") - F.col("hit"))).alias("miou"))
    oa, pe = F.col("hit") / F.col("n"), F.col("agree") / F.col("n") / F.col("n")
    mcc = F.try_divide(F.col("hit") * F.col("n") - F.col("agree"), F.sqrt(F.col("n") * F.col("n") - F.col("map2")) * F.sqrt(F.col("n") * F.col("n") - F.col("ref2")))
    return a.select(F.col("n").cast("long").alias("n"), oa.alias("accuracy"), F.try_divide(oa - pe, 1 - pe).alias("kappa"), "balanced_accuracy", "macro_f1", "weighted_f1", "miou", mcc.alias("mcc"))


def area_estimates(cm: DataFrame, strata: DataFrame, z: float = 1.96) -> DataFrame:
    """Area-weighted estimates per class: ``class, area, ci``, users, producers and, the same in all rows, overall accuracy with its ci.

    ``strata``: class, area (the mapped area). p_ij = W_i n_ij / n_i; variances of stratified sampling.
    """
    n_i = F.sum("n").over(Window.partitionBy("map"))
    share = strata.withColumn("w", F.col("area") / F.sum("area").over(Window.partitionBy())).withColumn("all_area", F.sum("area").over(Window.partitionBy()))
    p = cm.withColumn("n_i", n_i).join(share.select(F.col("class").alias("map"), "w", "all_area"), "map").withColumn("q", F.col("n") / F.col("n_i")).withColumn("p", F.col("w") * F.col("q"))
    p = p.withColumn("v", F.pow("w", F.lit(2)) * F.col("q") * (1 - F.col("q")) / F.when(F.col("n_i") > 1, F.col("n_i") - 1))
    by_ref = p.groupBy(F.col("ref").alias("class")).agg(F.sum("p").alias("p"), F.sqrt(F.sum("v")).alias("se"), F.max("all_area").alias("all_area"), F.sum(F.when(F.col("map") == F.col("ref"), F.col("p"))).alias("hit"))
    by_map = p.groupBy(F.col("map").alias("class")).agg((F.sum(F.when(F.col("map") == F.col("ref"), F.col("q"))).alias("users")))
    total = p.where("map = ref").agg(F.sum("p").alias("overall"), (z * F.sqrt(F.sum("v"))).alias("overall_ci"))
    out = by_ref.join(by_map, "class", "left").join(F.broadcast(total))
    return out.select("class", (F.col("p") * F.col("all_area")).alias("area"), (z * F.col("se") * F.col("all_area")).alias("ci"), "users", F.try_divide("hit", "p").alias("producers"), "overall", "overall_ci")


def regression_metrics(df: DataFrame, actual: str, predicted: str, features: int = 1) -> DataFrame:
    """One row: n, r2, rmse, mae, median absolute error, bias, explained variance, pearson r, adjusted r2, mape, nrmse. One aggregation, and the median by exact_quantiles."""
    a, p = F.col(actual).cast("double"), F.col(predicted).cast("double")
    e, nz = p - a, a != 0
    median = exact_quantiles(df, {"e": F.abs(e)}, (0.5,))["e"][0]
    g = df.where(a.isNotNull() & p.isNotNull()).agg(F.count("*").alias("n"), F.avg(e * e).alias("mse"), F.avg(F.abs(e)).alias("mae"), F.avg(e).alias("bias"), F.var_pop(a).alias("va"), F.var_pop(e).alias("ve"), F.corr(a, p).alias("pearson"), F.avg(nz.cast("double")).alias("nz"), F.avg(F.when(nz, F.abs(e / a))).alias("ape"), (F.max(a) - F.min(a)).alias("range"))
    r2 = 1 - F.try_divide("mse", "va")
    return g.select("n", r2.alias("r2"), F.sqrt("mse").alias("rmse"), "mae", F.lit(median).cast("double").alias("median_ae"), "bias", (1 - F.try_divide("ve", "va")).alias("explained_variance"), "pearson", F.when(F.col("n") > features + 1, 1 - (1 - r2) * (F.col("n") - 1) / (F.col("n") - features - 1)).alias("adjusted_r2"), F.when(F.col("nz") > 0.95, F.col("ape") * 100).alias("mape"), F.try_divide(F.sqrt("mse"), "range").alias("nrmse"))


def agreement(df: DataFrame, a: str, b: str) -> DataFrame:
    """Adjusted Rand index, normalised mutual information, homogeneity, completeness and V-measure of two labelings, from their contingency counts."""
    c = df.where(F.col(a).isNotNull() & F.col(b).isNotNull()).groupBy(F.col(a).alias("a"), F.col(b).alias("b")).agg(F.count("*").cast("double").alias("n"))
    c = c.withColumn("na", F.sum("n").over(Window.partitionBy("a"))).withColumn("nb", F.sum("n").over(Window.partitionBy("b"))).withColumn("all", F.sum("n").over(Window.partitionBy()))
    pairs = lambda x: F.col(x) * (F.col(x) - 1) / 2
    # Each row carries its share of its class's marginal term.
    s = c.agg(F.max("all").alias("t"), F.sum(pairs("n")).alias("same"), F.sum(pairs("na") * F.col("n") / F.col("na")).alias("pa"), F.sum(pairs("nb") * F.col("n") / F.col("nb")).alias("pb"), F.sum(F.col("n") / F.col("all") * F.log(F.col("n") * F.col("all") / F.col("na") / F.col("nb"))).alias("mi"), F.sum(-F.col("n") / F.col("all") * F.log(F.col("na") / F.col("all"))).alias("ha"), F.sum(-F.col("n") / F.col("all") * F.log(F.col("nb") / F.col("all"))).alias("hb"))
    expected = F.try_divide(F.col("pa") * F.col("pb"), pairs("t"))
    ari = F.coalesce(F.try_divide(F.col("same") - expected, (F.col("pa") + F.col("pb")) / 2 - expected), F.lit(1.0))
    h, k = F.coalesce(F.try_divide("mi", "hb"), F.lit(1.0)), F.coalesce(F.try_divide("mi", "ha"), F.lit(1.0))
    return s.select(ari.alias("ari"), F.coalesce(F.try_divide("mi", (F.col("ha") + F.col("hb")) / 2), F.lit(1.0)).alias("nmi"), h.alias("homogeneity"), k.alias("completeness"), F.coalesce(F.try_divide(2 * h * k, h + k), F.lit(0.0)).alias("v_measure"))


def area_by_class(df: DataFrame, cls: str, area: str) -> DataFrame:
    """``class, pixels, hectares, percent``, largest first."""
    g = df.where(F.col(cls).isNotNull()).groupBy(F.col(cls).alias("class")).agg(F.count("*").alias("pixels"), (F.sum(area) / 10_000).alias("hectares"))
    return g.withColumn("percent", F.col("hectares") / F.sum("hectares").over(Window.partitionBy()) * 100).orderBy(F.desc("hectares"), "class")


def value_statistics(df: DataFrame, value: str) -> DataFrame:
    """count, min, max, mean, population std and the exact 2, 25, 50, 75 and 98 % quantiles (found before the result is built)."""
    v = finite(F.col(value).cast("double"))
    q = exact_quantiles(df, {"v": F.col(value)}, (0.02, 0.25, 0.5, 0.75, 0.98))["v"]
    g = df.agg(F.count(v).alias("n"), F.min(v).alias("min"), F.max(v).alias("max"), F.avg(v).alias("mean"), F.stddev_pop(v).alias("std"))
    return g.select("*", *(F.lit(x).cast("double").alias(n) for n, x in zip(("p2", "p25", "median", "p75", "p98"), q, strict=True)))


def label_distribution(df: DataFrame, label: str) -> DataFrame:
    """``label, n, percent`` of each value, null included; the total comes from one row a class."""
    g = df.groupBy(label).agg(F.count("*").alias("n"))
    return g.withColumn("percent", 100.0 * F.col("n") / F.sum("n").over(Window.partitionBy()))


def class_breaks(df: DataFrame, value: str, method: str, classes: int, bins: int = 1000) -> list[float]:
    """Class borders, a handful of numbers on the driver: ``equal`` between the 2 and 98 % quantiles, ``quantile`` (repeats dropped), or ``natural`` (Fisher-Jenks).

    Natural borders come from the value counts where there are at most ``bins`` distinct values, else from the counts and
    means of ``bins`` equal stretches of the range.
    """
    if method == "natural":
        return natural_breaks(*value_bins(df, value, bins), classes)
    qs = [0.02, 0.98] if method == "equal" else [i / classes for i in range(classes + 1)]
    got = exact_quantiles(df, {"v": F.col(value)}, qs)["v"]
    if got[0] is None:
        return []
    return np.linspace(got[0], got[1], classes + 1).tolist() if method == "equal" else sorted(set(got))


def value_bins(df: DataFrame, value: str, bins: int = 1000) -> tuple[list[float], list[int]]:
    """Values and counts: the distinct values if at most ``bins``, else the mean and count of each of ``bins`` equal stretches of the range. Combined map-side."""
    x = df.select(finite(F.col(value).cast("double")).alias("x")).where("x is not null")
    few = x.groupBy("x").agg(F.count("*").alias("n")).limit(bins + 1).collect()
    if len(few) > bins:
        a, b = x.agg(F.min("x"), F.max("x")).first()
        at = F.least(F.lit(bins - 1), F.floor((F.col("x") - a) / (b - a) * bins))
        few = x.groupBy(at.alias("bin")).agg(F.avg("x").alias("x"), F.count("*").alias("n")).collect()
    few.sort(key=lambda r: r.x)
    return [r.x for r in few], [r.n for r in few]


def classify(value, breaks: Sequence[float]):
    """The class 1.. of a value; values beyond the borders belong to the end classes."""
    out = F.when(value.isNull(), F.lit(None).cast("int"))
    for i, b in enumerate(breaks[1:-1], 1):
        out = out.when(value < b, i)
    return out.otherwise(max(1, len(breaks) - 1))


def natural_breaks(values: Sequence[float], counts: Sequence[int], classes: int) -> list[float]:
    """Fisher-Jenks borders (least squared deviation within classes) of distinct values with counts, by dynamic programming with prefix sums."""
    order = np.argsort(np.asarray(values, float), kind="stable")
    x, n = np.asarray(values, float)[order], np.asarray(counts, float)[order]
    k = min(classes, len(x))
    if not k:
        return []
    w, s, q = (np.concatenate(([0.0], np.cumsum(a))) for a in (n, n * x, n * x * x))
    i, j = np.arange(len(x))[:, None], np.arange(len(x))[None, :]
    weight = np.maximum(w[j + 1] - w[i], 1)
    cost = np.where(i <= j, q[j + 1] - q[i] - (s[j + 1] - s[i]) ** 2 / weight, np.inf)
    best, cut = cost[0].copy(), []
    for _ in range(k - 1):
        options = np.concatenate(([np.inf], best[:-1]))[:, None] + cost
        cut.append(options.argmin(0))
        best = options.min(0)
    tops, at = [], len(x) - 1
    for c in reversed(cut):
        tops.append(x[at])
        at = int(c[at]) - 1
    tops.append(x[at])
    return [float(x[0]), *map(float, reversed(tops))]


def probability_metrics(df: DataFrame, truth: str, score: str, positive, bins: int = 10) -> DataFrame:
    """One row: n, ROC AUC (ranks with ties averaged), log loss and expected calibration error of a score in [0, 1].

    Scores are counted before they are ordered, and ordered in 1024 stretches, so no window sees more than the distinct scores of one.
    """
    p, y = F.col(score).cast("double"), (F.col(truth) == F.lit(positive)).cast("double")
    rows = df.where(p.isNotNull() & F.col(truth).isNotNull()).select(p.alias("p"), y.alias("y"))
    by = rows.groupBy("p").agg(F.sum("y").alias("pos"), F.count("*").cast("double").alias("n"))
    # Ordered in stretches of the score: what lies below a stretch comes from at most 1025 sums.
    by = by.withColumn("stretch", F.floor(F.least(F.greatest(F.col("p"), F.lit(0.0)), F.lit(1.0)) * 1024).cast("int"))
    before = lambda w: F.coalesce(F.sum(F.col("n") - F.col("pos")).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    sums = by.groupBy("stretch").agg(F.sum("n").alias("n"), F.sum("pos").alias("pos")).select("stretch", before(Window.orderBy("stretch")).alias("before"))
    by = by.join(F.broadcast(sums), "stretch").withColumn("below", F.col("before") + before(Window.partitionBy("stretch").orderBy("p")))
    auc = by.agg(F.try_divide(F.sum(F.col("pos") * (F.col("below") + (F.col("n") - F.col("pos")) / 2)), F.sum("pos") * F.sum(F.col("n") - F.col("pos"))).alias("auc"))
    q = F.least(F.greatest(F.col("p"), F.lit(1e-15)), F.lit(1 - 1e-15))
    loss = rows.agg(F.count("*").alias("n"), F.avg(-(F.col("y") * F.log(q) + (1 - F.col("y")) * F.log(1 - q))).alias("log_loss"))
    cal = rows.groupBy(F.least(F.lit(bins - 1), F.floor(F.col("p") * bins)).alias("bin")).agg(F.count("*").alias("n"), F.avg("p").alias("p"), F.avg("y").alias("y")).agg((F.sum(F.col("n") * F.abs(F.col("p") - F.col("y"))) / F.sum("n")).alias("ece"))
    return loss.join(F.broadcast(auc)).join(F.broadcast(cal)).select("n", "auc", "log_loss", "ece")


def correlated_columns(df: DataFrame, columns: Sequence[str], threshold: float) -> list[str]:
    """Columns to drop: constant ones, then each later column of a pair with |r| at least the threshold. One pass over the data."""
    pairs = [(i, j) for j in range(len(columns)) for i in range(j)]
    both = lambda i, j, x: F.when(F.col(columns[i]).isNotNull() & F.col(columns[j]).isNotNull(), F.col(x))
    # A constant column has no correlation: its deviation is 0.
    corr = lambda i, j: F.try_divide(F.covar_pop(columns[i], columns[j]), F.stddev_pop(both(i, j, columns[i])) * F.stddev_pop(both(i, j, columns[j])))
    r = df.agg(*(F.stddev_pop(c).alias(f"s{i}") for i, c in enumerate(columns)), *(corr(i, j).alias(f"r{i}_{j}") for i, j in pairs)).first()
    gone = [i for i in range(len(columns)) if not r[f"s{i}"]]
    for j in range(len(columns)):
        if j not in gone and any(i not in gone and abs(r[f"r{i}_{j}"] or 0) >= threshold for i in range(j)):
            gone.append(j)
    return [columns[i] for i in sorted(gone)]
