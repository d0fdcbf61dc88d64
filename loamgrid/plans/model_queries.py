"""Queries that train, compare and apply models, forecasts among them; with SQL where a model has a closed form."""

from __future__ import annotations

import numpy as np
from pyspark.ml import PipelineModel
from pyspark.sql import functions as F

from loamgrid.operators import forecasting as S
from loamgrid.operators import learning as L
from loamgrid.operators import raster as R
from loamgrid.operators import series as P
from loamgrid.operators import supervised as M
from loamgrid.plans.table_queries import _PANEL, _panel
from loamgrid.storage import Staged, new_path, read

QUERIES: dict = {}
ORACLE: dict[str, str] = {}


def query(sql: str | None = None):
    def keep(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = sql
        return f

    return keep


# --- Forecasts -------------------------------------------------------------------------------------------------------

_ROWS = """w as (select event_type, step, row_number() over o as origin, v, lag(v, 1) over o as l1, avg(v) over (o rows 2 preceding) as m3, lead(v, 1) over o as t1, lead(v, 2) over o as t2, lag(v, 23) over o as s1, lag(v, 22) over o as s2, count(*) over (o rows 23 preceding) as k from panel window o as (partition by event_type order by step))"""


@query(f"with {_PANEL}, {_ROWS} select event_type, origin, lead, round(case when lead = 1 then t1 else t2 end, 6) as target, round(v, 6) as y_last, round(l1, 6) as y_lag_1, round(m3, 6) as y_mean_3, round(case when k = 24 then case when lead = 1 then s1 else s2 end end, 6) as y_season from w, (select unnest([1, 2]) as lead)")
def forecast_rows(spark, d):
    """Feature rows of direct forecasts."""
    rows, _ = S.feature_rows(_panel(spark, d), "event_type", "step", "v", "h", (1, 2), (1,), (3,))
    return rows.select("event_type", "origin", "lead", *(F.round(c, 6).alias(c) for c in ("target", "y_last", "y_lag_1", "y_mean_3", "y_season")))


_AR = f"with recursive {_PANEL}, p as (select event_type, step, v, lag(v) over (partition by event_type order by step) as x from panel), c as (select regr_slope(v, x) as a, regr_intercept(v, x) as b from p where v is not null and x is not null)"


@query(_AR + " select round(a, 6) as slope, round(b, 5) as intercept from c")
def autoregression(spark, d):
    """A linear model on the value before."""
    c, i = S.autoregression(_panel(spark, d), "event_type", "step", "v")
    return spark.createDataFrame([(round(c[0], 6), round(i, 5))], "slope double, intercept double")


@query(_AR + ", l as (select event_type, max_by(v, step) as v from panel where v is not null group by 1), f(event_type, h, forecast) as (select event_type, 0, v from l union all select event_type, h + 1, a * forecast + b from f, c where h < 12) select event_type, h::int as h, round(forecast, 4) as forecast from f where h > 0")
def recursive_forecasts(spark, d):
    """Each forecast fed back, 12 hours ahead."""
    p = _panel(spark, d)
    c, i = S.autoregression(p, "event_type", "step", "v")
    return P.recursive_forecast(p, "event_type", "step", "v", 12, c, i).select("event_type", F.col("h").cast("int").alias("h"), F.round("forecast", 4).alias("forecast"))


@query()
def direct_forecasts(spark, d):
    """A linear model with all features, one row a series and lead, from the last step."""
    made, names = S.feature_rows(_panel(spark, d), "event_type", "step", "v", "h", (1, 3, 6, 12, 24))
    rows = Staged(made)
    return S.predict(S.train(rows.df, names, "linear"), S.latest(rows.df, "event_type"), names, "event_type").select("event_type", "lead", F.round("forecast", 3).alias("forecast"))


@query()
def forecast_training(spark, d):
    """Train report: linear, forest and boosted trees with two baselines over two cut-offs, 24 hours ahead."""
    panel = _panel(spark, d)
    steps = panel.groupBy("event_type").count().agg(F.max("count")).first()[0] or 0
    cuts = P.backtest_cutoffs(steps, 24, "h", 2)
    report = S.backtest(panel, "event_type", "step", "v", "h", cuts, 24, ("linear", "rf", "gbt"), leads=(1, 6, 12, 24), lags=(1, 2, 3, 24), windows=(3, 24))
    return report.select("model", "n", *(F.round(c, 4).alias(c) for c in ("mae", "rmse", "bias", "mape", "skill")))


@query("select true as same")
def saved_forecast_model(spark, d):
    """A saved and loaded model forecasts the same."""
    rows, names = S.feature_rows(_panel(spark, d), "event_type", "step", "v", "h", (1, 6), (1, 24), (3,))
    model, path = S.train(rows, names, "linear"), new_path(spark)
    model.save(path)
    last = S.latest(rows, "event_type")
    a, b = (S.predict(m, last, names, "event_type").select("event_type", "lead", F.col("forecast").alias(n)) for m, n in ((model, "a"), (PipelineModel.load(path), "b")))
    return a.join(b, ["event_type", "lead"]).agg(F.coalesce(F.bool_and(F.abs(F.col("a") - F.col("b")) < 1e-9), F.lit(True)).alias("same"))


@query()
def tuned_forecast(spark, d):
    """Of two settings of boosted trees the better one, with early stopping."""
    rows, names = S.feature_rows(_panel(spark, d), "event_type", "step", "v", "h", (1, 12), (1, 24), (3, 24))
    rows = Staged(rows).df
    best, mae = S.tune(rows, names, "gbt", [{"maxIter": 5, "maxDepth": 2}, {"maxIter": 15, "maxDepth": 3}], "event_type")
    model = S.train(rows, names, "gbt", validation=0.15, **best)
    return spark.createDataFrame([(best["maxIter"], best["maxDepth"], round(mae, 4), model.stages[-1].getNumTrees, *(k for k, _ in S.importance(model, names)[:1]))], "trees int, depth int, mae double, kept int, most_important string")


# --- Classification --------------------------------------------------------------------------------------------------

_BANDS = ["b02", "b03", "b04", "b08", "b11", "b12"]


def _labelled(spark, d):
    px = R.pixel_table(read(spark, d, "pixels"), _BANDS).where("label_code > 0")
    return px.select("sample_id", "poly_id", F.col("label_code").cast("string").alias("label"), *_BANDS)


def _split(spark, d):
    df = L.grouped_split(_labelled(spark, d), F.coalesce(F.nullif("poly_id", F.lit(0)), -F.col("sample_id")), 0.25)
    return Staged(df.select("sample_id", "label", "split", *_BANDS)).df


@query()
def model_leaderboard(spark, d):
    """Every classifier with its default settings on the same grouped split."""
    board = M.compare(_split(spark, d), "label", _BANDS, ("rf", "et", "dt", "lr", "sgd", "nb", "svm", "mlp", "gbt"))
    return board.select("model", "n", F.round("accuracy", 3).alias("accuracy"), F.round("kappa", 3).alias("kappa"))


@query()
def cross_validation(spark, d):
    """Folds by polygon."""
    df = Staged(_labelled(spark, d)).df
    cv = M.cross_validate(df, "label", _BANDS, "dt", F.coalesce(F.nullif("poly_id", F.lit(0)), -F.col("sample_id")), 3)
    return cv.select("fold", "n", F.round("accuracy", 3).alias("accuracy"), F.round("kappa", 3).alias("kappa"))


@query()
def importances(spark, d):
    """Shares of accuracy that each band is worth: by the trees, and by shuffling."""
    df = _split(spark, d)
    model = M.fit(df.where("split = 'train'"), "label", _BANDS, "rf")
    trees = dict(L.feature_importance(model, _BANDS))
    mixed = dict(M.permutation_importance(model, df.where("split = 'test'"), "label", _BANDS, "sample_id", rows=2000, repeats=1))
    return spark.createDataFrame([(b, round(trees[b], 4), round(mixed[b], 4)) for b in _BANDS], "band string, trees double, shuffled double")


@query()
def raster_classification(spark, d):
    """Sample, train and map in one step: share of each predicted class."""
    out, _ = M.classify_raster(_labelled(spark, d), "label", _BANDS, "sample_id", per_class=200)
    return M.class_shares(out).select("class", "pixels", F.round("percent", 3).alias("percent"))


@query()
def independent_evaluation(spark, d):
    """A model that learnt from the train rows, scored on another table."""
    df = _split(spark, d)
    e = M.evaluate(M.fit(df.where("split = 'train'"), "label", _BANDS, "dt"), df.where("split = 'test'"), "label")
    return e.select("n", *(F.round(c, 3).alias(c) for c in ("accuracy", "kappa", "macro_f1", "mcc")))


_TWO = "px as (select label_code as c, b04 as a, b08 as b from pixels where label_code > 0 and b04 is not null and b08 is not null and b04::varchar <> 'nan' and b08::varchar <> 'nan' and b04 <> -9999 and b08 <> -9999), st as (select c, count(*) as n, avg(a) as ma, avg(b) as mb, covar_samp(a, a) + 1e-6 as va, covar_samp(b, b) + 1e-6 as vb, covar_samp(a, b) as vab from px group by 1)"


def _two(spark, d):
    return R.pixel_table(read(spark, d, "pixels"), ["b04", "b08"]).where("label_code > 0").select("label_code", "b04", "b08")


@query(f"""with {_TWO}, s as (select px.c, st.c as p, row_number() over (partition by rowid_ order by -(vb * power(a - ma, 2) - 2 * vab * (a - ma) * (b - mb) + va * power(b - mb, 2)) / (va * vb - vab * vab) - ln(va * vb - vab * vab) desc, st.c desc) as r from (select *, row_number() over () as rowid_ from px) px, st) select c as label_code, p as predicted, count(*) as n from s where r = 1 group by all""")
def gaussian_two_bands(spark, d):
    """Maximum likelihood on two bands."""
    df, f = _two(spark, d), ["b04", "b08"]
    out = L.gaussian_classify(df, L.gaussian_class_stats(df, "label_code", f), "label_code", f)
    return out.groupBy("label_code", "predicted").agg(F.count("*").alias("n"))


@query(f"""with {_TWO}, w as (select sum(va * (n - 1)) / sum(n - 1) as va, sum(vb * (n - 1)) / sum(n - 1) as vb, sum(vab * (n - 1)) / sum(n - 1) as vab, sum(n) as t from st),
s as (select px.c, st.c as p, row_number() over (partition by rowid_ order by -(w.vb * power(a - ma, 2) - 2 * w.vab * (a - ma) * (b - mb) + w.va * power(b - mb, 2)) / (w.va * w.vb - w.vab * w.vab) / 2 + ln(n / t) desc, st.c desc) as r from (select *, row_number() over () as rowid_ from px) px, st, w) select c as label_code, p as predicted, count(*) as n from s where r = 1 group by all""")
def lda_two_bands(spark, d):
    """Linear discriminants on two bands."""
    df, f = _two(spark, d), ["b04", "b08"]
    out = L.gaussian_classify(df, L.gaussian_class_stats(df, "label_code", f), "label_code", f, pooled=True)
    return out.groupBy("label_code", "predicted").agg(F.count("*").alias("n"))


@query("with c as (select regr_slope(l_extendedprice, l_quantity) as a, regr_intercept(l_extendedprice, l_quantity) as b from lineitem) select l_quantity, round(a * l_quantity + b, 3) as predicted, count(*) as n from lineitem, c group by all")
def linear_regression(spark, d):
    """Least squares of one feature."""
    df = read(spark, d, "lineitem").select("l_quantity", "l_extendedprice")
    out = M.train_regressor(df, "l_extendedprice", ["l_quantity"], "linear", regParam=0.0)(df)
    return out.groupBy("l_quantity", F.round("predicted", 3).alias("predicted")).agg(F.count("*").alias("n"))


@query("with c as (select regr_slope(ln(1 + l_extendedprice), l_quantity) as a, regr_intercept(ln(1 + l_extendedprice), l_quantity) as b from lineitem) select l_quantity, round(exp(a * l_quantity + b) - 1, 2) as predicted, count(*) as n from lineitem, c group by all")
def log_regression(spark, d):
    """Least squares of the target's logarithm, turned back."""
    df = read(spark, d, "lineitem").select("l_quantity", "l_extendedprice")
    out = M.train_regressor(df, "l_extendedprice", ["l_quantity"], "linear", transform="log1p", regParam=0.0)(df)
    return out.groupBy("l_quantity", F.round("predicted", 2).alias("predicted")).agg(F.count("*").alias("n"))


# --- Clusters --------------------------------------------------------------------------------------------------------

_V = "v as (select vec_id as k, embedding::float[64] as v from embeddings where embedding is not null)"


@query("""with p as (select event_id as k, value as x from events where event_id < 0) select 0::bigint as rows, 0.0::double as eps where (select count(*) from p) = 0""")
def knee_of_nothing(spark, d):
    """No rows, no distances."""
    got, eps = M.k_distances(read(spark, d, "events").where("event_id < 0"), "event_id", ["value"], 4)
    return spark.createDataFrame([(len(got), eps)], "rows long, eps double")


@query("with c as (select c_custkey as k, c_acctbal as x from customer where c_acctbal is not null), n as (select a.k, abs(a.x - b.x) as d, row_number() over (partition by a.k order by abs(a.x - b.x)) as r from c a join c b on a.k <> b.k) select k as key, round(d, 4) as d from n where r = 4")
def k_distance_rows(spark, d):
    """Distance of each customer's balance to the fourth nearest other one."""
    return M.kth_distances(read(spark, d, "customer"), "c_custkey", "c_acctbal", 4).where("d is not null").select("key", F.round("d", 4).alias("d"))


@query()
def k_search(spark, d):
    """Silhouette, inertia and BIC for k from 2 to 5."""
    df = L.features_pipeline(_BANDS).fit(rows := _labelled(spark, d)).transform(rows)
    return spark.createDataFrame([(k, round(s, 3), round(i, 1), round(b, 1)) for k, s, i, b in L.choose_k(Staged(df.select("features")).df, 5)], "k int, silhouette double, inertia double, bic double")


@query()
def unfitted_votes(spark, d):
    """Rows without a cluster take the one of the nearest fitted rows: how often that agrees."""
    fitted, _ = L.cluster(_labelled(spark, d), _BANDS, "kmeans", 4)
    fitted = Staged(fitted.select("sample_id", "cluster", *_BANDS)).df
    rest = fitted.where("sample_id % 20 = 0").select("sample_id", F.col("cluster").alias("own"), *_BANDS)
    out = M.vote_unfitted(fitted.where("sample_id % 20 <> 0").select("cluster", *_BANDS), rest, _BANDS, "cluster", most=2000)
    return out.agg(F.count("*").alias("n"), F.round(F.avg((F.col("own") == F.col("cluster")).cast("double")), 2).alias("agreement"))


def _sample(spark, d, rows):
    s = _labelled(spark, d).orderBy(F.xxhash64("sample_id"), "sample_id").limit(rows).select(*_BANDS).toPandas().to_numpy(float)
    return (s - s.mean(0)) / np.maximum(s.std(0), 1e-12) if len(s) else s


@query()
def spectral_clusters(spark, d):
    """Clusters of a sample by its neighbour graph, taken to all pixels by votes."""
    rows = Staged(_labelled(spark, d).select("sample_id", *_BANDS)).df
    sample = rows.orderBy(F.xxhash64("sample_id"), "sample_id").limit(400).toPandas()
    sample["cluster"] = M.spectral(sample[_BANDS].to_numpy(float), 4).astype("int64") if len(sample) else 0
    fitted = spark.createDataFrame(sample[[*_BANDS, "cluster"]], ", ".join(f"{b} double" for b in _BANDS) + ", cluster long")
    return M.vote_unfitted(fitted, rows, _BANDS, "cluster").groupBy("cluster").agg(F.count("*").alias("n"))


@query()
def dendrogram(spark, d):
    """Merge order of a sample of 300 pixels."""
    z = M.linkage(_sample(spark, d, 300))
    return spark.createDataFrame([(i, int(r[0]), int(r[1]), round(float(r[2]), 4), int(r[3])) for i, r in enumerate(z)], "step int, a int, b int, distance double, size int")


@query()
def tsne_map(spark, d):
    """A two-dimensional map of 200 pixels, and how far it can be trusted."""
    x = _sample(spark, d, 200)
    y = L.tsne(x, rounds=150)
    return spark.createDataFrame([(len(y), round(M.trustworthiness(x, y), 2))], "n int, trust double")


@query()
def factor_maps(spark, d):
    """Variance of the first component of each linear transform, fitted on a sample and applied to all pixels."""
    x = R.pixel_table(read(spark, d, "pixels"), _BANDS)
    s = x.orderBy(F.xxhash64("sample_id"), "sample_id").limit(2000).select(*_BANDS).toPandas().to_numpy(float)
    out = None
    for m in ("svd", "nmf", "ica", "fa"):
        row = L.transform_linear(x, _BANDS, L.factor_model(s, m, 2)).agg(F.lit(m).alias("method"), F.count("f1").alias("n"), F.round(F.stddev_pop("f1"), 2).alias("spread"))
        out = row if out is None else out.unionByName(row)
    return out


@query("select 'label' as column, 'classification' as task union all select 'b08', 'regression' union all select 'label_code', 'classification'")
def guessed_tasks(spark, d):
    p = read(spark, d, "pixels").where("not isnan(b08)")
    return spark.createDataFrame([(c, L.task_of(p, c)) for c in ("label", "b08", "label_code")], "`column` string, task string")
