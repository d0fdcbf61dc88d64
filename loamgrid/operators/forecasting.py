"""Feature rows, training, back-tests and predictions for panels of time series."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml import feature as P
from pyspark.ml import regression as R
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from loamgrid.operators import series as S
from loamgrid.storage import Staged

MODELS = {
    "linear": lambda **o: R.LinearRegression(**({"regParam": 1e-3, "solver": "normal"} | o)),
    "rf": lambda **o: R.RandomForestRegressor(**({"numTrees": 30, "maxDepth": 8, "seed": 0} | o)),
    "gbt": lambda **o: R.GBTRegressor(**({"maxIter": 40, "maxDepth": 4, "stepSize": 0.15, "seed": 0} | o)),
}


def feature_rows(panel: DataFrame, series: str, order: str, value: str, freq: str, leads: Sequence[int], lags: Sequence[int] | None = None, windows: Sequence[int] | None = None) -> tuple[DataFrame, list[str]]:
    """One row for each series, origin step and lead (direct forecasting), and the names of its features.

    Columns: ``series``, ``origin`` (number of the step), ``at`` (the step forecast), ``lead``, ``target`` (null where unknown) and features that are known at
    the origin: the last value, lags, means of the last steps, their deviation, the value whole seasons back, the lead and the calendar of the
    step forecast. One ordering of a series serves all windows; a row carries at most the largest lead of future values.
    """
    kind = S.FREQUENCIES[freq]
    lags, windows, season, far = lags or kind["lags"], windows or kind["windows"], kind["season"], max(leads)
    w = Window.partitionBy(series).orderBy(order)
    v = F.col(value).cast("double")
    base = {"y_last": v} | {f"y_lag_{n}": F.lag(v, n).over(w) for n in lags} | {f"y_mean_{n}": F.avg(v).over(w.rowsBetween(1 - n, 0)) for n in windows}
    base[f"y_std_{max(windows)}"] = F.stddev_samp(v).over(w.rowsBetween(1 - max(windows), 0))
    box = lambda a, b: F.collect_list(F.struct(v.alias("v"), F.col(order).alias("at"))).over(w.rowsBetween(a, b))
    rows = panel.select(series, F.row_number().over(w).alias("origin"), F.col(order).alias("__t"), box(1, far).alias("__ahead"), box(1 - season, 0).alias("__season"), *(c.alias(n) for n, c in base.items()))
    step = F.expr(f"interval 1 {kind['unit']}")
    each = rows.withColumn("lead", F.explode(F.array(*map(F.lit, leads))))
    ahead, back = F.try_element_at("__ahead", F.col("lead")), F.try_element_at("__season", (F.col("lead") - 1) % season + 1)
    each = each.withColumns({"target": ahead["v"], "at": F.coalesce(ahead["at"], F.col("__t") + step * F.col("lead")), "y_season": F.when(F.size("__season") == season, back["v"])})
    calendar = S.calendar_features(each, "at", freq)
    names = [*base, "y_season", "lead", *(c for c in calendar.columns if c not in each.columns)]
    return calendar.select(series, "origin", "at", "target", *names), names


def train(rows: DataFrame, features: Sequence[str], model: str = "linear", validation: float = 0.0, **options) -> PipelineModel:
    """A fitted pipeline: medians for missing features, assembled, scaled, regressed. Rows without a target are left out.

    With ``validation`` a ``gbt`` stops early: the last share of the origins tells when more trees don't help.
    """
    known = rows.where(F.col("target").isNotNull())
    if validation and model == "gbt":
        cut = known.agg(F.percentile_approx("origin", 1 - validation)).first()[0]
        known = known.withColumn("held", F.col("origin") > F.lit(cut))
        options = {"validationIndicatorCol": "held"} | options
    fill = [f"__f_{c}" for c in features]
    kinds = dict(known.dtypes)
    numbers = known.withColumns({c: F.col(c).cast("double") for c in features if kinds[c] != "double"})
    estimator = MODELS[model](featuresCol="features", labelCol="target", predictionCol="forecast", **options)
    stages = [P.Imputer(inputCols=list(features), outputCols=fill, strategy="median"), P.VectorAssembler(inputCols=fill, outputCol="__raw"), P.StandardScaler(inputCol="__raw", outputCol="features", withMean=True), estimator]
    return Pipeline(stages=stages).fit(numbers)


def predict(model: PipelineModel, rows: DataFrame, features: Sequence[str], series: str) -> DataFrame:
    """``series, origin, lead, at, target, forecast``; a saved model (``PipelineModel.load``) serves as well."""
    return model.transform(rows.withColumns({c: F.col(c).cast("double") for c in features})).select(series, "origin", F.col("lead").cast("int").alias("lead"), "at", "target", "forecast")


def latest(rows: DataFrame, series: str) -> DataFrame:
    """The rows of each series' last origin with a value: what comes next."""
    last = rows.where("y_last is not null").groupBy(F.col(series).alias("__s")).agg(F.max("origin").alias("__o"))
    return rows.join(last, (F.col(series) == F.col("__s")) & (F.col("origin") == F.col("__o"))).drop("__s", "__o")


def tune(rows: DataFrame, features: Sequence[str], model: str, trials: Sequence[Mapping], series: str, validation: float = 0.15) -> tuple[dict, float]:
    """Of some settings the one with the least mean absolute error on the last share of the origins."""
    cut = rows.where("target is not null").agg(F.percentile_approx("origin", 1 - validation)).first()[0]
    fit, held = rows.where(F.col("origin") + F.col("lead") <= cut), rows.where((F.col("origin") >= cut) & F.col("target").isNotNull())
    errors = [predict(train(fit, features, model, **t), held, features, series).agg(F.avg(F.abs(F.col("forecast") - F.col("target")))).first()[0] for t in trials]
    best = min(range(len(trials)), key=lambda i: (errors[i] is None, errors[i]))
    return dict(trials[best]), errors[best]


def backtest(panel: DataFrame, series: str, order: str, value: str, freq: str, cutoffs: Sequence[int], horizon: int, models: Sequence[str] = ("linear", "gbt"), leads: Sequence[int] | None = None, **features) -> DataFrame:
    """Train report: ``model, n, mae, rmse, bias, mape, skill`` of models and baselines over the cut-offs, best first.

    For each cut-off a model learns from rows whose target was known by then and forecasts from that step. ``skill`` is the gain in mae over the better
    baseline. Feature rows are written down once.
    """
    spark = panel.sparkSession
    made, names = feature_rows(panel, series, order, value, freq, leads or range(1, horizon + 1), **features)
    rows = Staged(made)
    got = []
    for c in cutoffs:
        for m in models:
            fitted = train(rows.df.where(F.col("origin") + F.col("lead") <= c), names, m)
            out = predict(fitted, rows.df.where(F.col("origin") == c), names, series)
            got.append(out.select(F.col("target").alias("actual"), F.lit(m).alias("model"), "forecast"))
    cuts = spark.createDataFrame([(c,) for c in cutoffs], "cutoff int")
    base = S.baseline_forecasts(panel, series, order, value, cuts, S.FREQUENCIES[freq]["season"], horizon)
    base = base.where(F.col("h").isin(list(leads))) if leads else base
    got += [base.select("actual", F.lit(b).alias("model"), F.col(b).alias("forecast")) for b in ("naive", "seasonal")]
    errors = reduce(DataFrame.unionByName, got).groupBy("model")
    err, known = F.col("forecast") - F.col("actual"), F.col("actual").isNotNull() & F.col("forecast").isNotNull()
    e = F.when(known, err)
    share = F.avg(F.when(known, (F.col("actual") != 0).cast("double")))
    report = errors.agg(F.count(e).alias("n"), F.avg(F.abs(e)).alias("mae"), F.sqrt(F.avg(e * e)).alias("rmse"), F.avg(e).alias("bias"), F.when(share > 0.5, F.avg(F.when(F.col("actual") != 0, F.abs(e / F.col("actual")))) * 100).alias("mape"))
    best = F.broadcast(report.where(F.col("model").isin("naive", "seasonal")).agg(F.min("mae").alias("__best")))
    return report.join(best).withColumn("skill", 1 - F.try_divide("mae", "__best")).drop("__best").orderBy("mae", "model")


def autoregression(panel: DataFrame, series: str, order: str, value: str, lags: int = 1) -> tuple[list[float], float]:
    """Coefficients (newest value first) and intercept of a linear model on the last ``lags`` values, for ``series.recursive_forecast``."""
    w = Window.partitionBy(series).orderBy(order)
    names = [f"x{i}" for i in range(1, lags + 1)]
    rows = panel.select(F.col(value).cast("double").alias("y"), *(F.lag(F.col(value).cast("double"), i).over(w).alias(n) for i, n in enumerate(names, 1))).dropna()
    model = R.LinearRegression(labelCol="y", featuresCol="x", solver="normal").fit(P.VectorAssembler(inputCols=names, outputCol="x").transform(rows))
    return [float(c) for c in model.coefficients], float(model.intercept)


def importance(model: PipelineModel, features: Sequence[str]) -> list[tuple[str, float]]:
    """Shares of feature families (values, means, season, calendar, lead), largest first; linear weights by size, trees by gain."""
    fitted = model.stages[-1]
    raw = fitted.featureImportances.toArray() if hasattr(fitted, "featureImportances") else abs(fitted.coefficients.toArray())
    sums: dict[str, float] = {}
    for name, v in zip(features, raw, strict=True):
        family = "means" if name.startswith(("y_mean", "y_std")) else "season" if name == "y_season" else "values" if name.startswith("y_") else "lead" if name == "lead" else "calendar"
        sums[family] = sums.get(family, 0.0) + float(v)
    total = sum(sums.values()) or 1.0
    return sorted(((k, v / total) for k, v in sums.items()), key=lambda x: (-x[1], x[0]))
