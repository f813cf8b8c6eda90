"""Linear models, tree models, clusters and anomaly queries."""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import functions as F

from tagloom.catalogue.base import TAGS, query, r, rounded
from tagloom.operators import anomaly, linear, models
from tagloom.operators.scaling import fit_scaler
from tagloom.plans import moisture, report

ORDER = ["ts", "event_id"]
FEATURES = ["temp_PV", "temp_SV", "pressure"]

# x: discount in tenths, y: 2x + 1 plus a residual taken from the tax column.
LINE = "l AS (SELECT l_discount * 10 AS x, 2 * (l_discount * 10) + 1 + (l_tax - 0.04) * 10 AS y, l_tax * 10 AS z FROM lineitem)"
MOMENTS = f"""{LINE}, m AS (SELECT count(*) AS n, avg(x) AS mx, avg(y) AS my, avg(x * x) AS mxx, avg(x * y) AS mxy, avg(y * y) AS myy FROM l)"""


def _line(t):
    x = F.col("l_discount") * 10
    return t.lineitem.select(x.alias("x"), (2 * x + 1 + (F.col("l_tax") - 0.04) * 10).alias("y"), (F.col("l_tax") * 10).alias("z"))


def _descent_sql(rates: str) -> str:
    return f"""WITH RECURSIVE {MOMENTS}, g(lr, epoch, w, b, dw, db) AS (
      SELECT CAST(unnest({rates}) AS DOUBLE), 0, CAST(0 AS DOUBLE), CAST(0 AS DOUBLE), CAST(0 AS DOUBLE), CAST(0 AS DOUBLE)
      UNION ALL
      SELECT lr, epoch + 1, w - lr * 2 * (w * mxx + b * mx - mxy), b - lr * 2 * (w * mx + b - my), 2 * (w * mxx + b * mx - mxy), 2 * (w * mx + b - my)
      FROM g, m WHERE epoch < 100)"""


_LOSS = "myy - 2 * w * mxy - 2 * b * my + w * w * mxx + 2 * w * b * mx + b * b"


@query(
    "gd_history",
    _descent_sql("[0.1]") + f" SELECT epoch, {r('w')} AS w, {r('b')} AS b, {r(_LOSS)} AS loss, {r('dw')} AS dw, {r('db')} AS db FROM g, m WHERE epoch > 0",
)
def gd_history(t):
    h = linear.descent_history(_line(t), ["x"], "y", epochs=100, learning_rate=0.1)
    return rounded(h.withColumns({"w": F.col("w")[0], "dw": F.col("dw")[0]}), "w", "b", "loss", "dw", "db")


@query(
    "learning_rates",
    _descent_sql("[0.001, 0.01, 0.1, 0.5]") + f" SELECT lr AS learning_rate, epoch, {r(_LOSS)} AS loss FROM g, m WHERE epoch > 0",
)
def learning_rates(t):
    return rounded(linear.compare_learning_rates(_line(t), ["x"], "y"), "loss")


@query(
    "noise_scenarios",
    f"""WITH RECURSIVE {LINE}, p AS (SELECT s, x, 2 * x + 1 + (y - 2 * x - 1) * s AS y FROM l, (SELECT CAST(unnest([0.1, 0.5, 1.0]) AS DOUBLE) AS s)),
      m AS (SELECT s, avg(x) AS mx, avg(y) AS my, avg(x * x) AS mxx, avg(x * y) AS mxy, avg(y * y) AS myy FROM p GROUP BY s),
      g(s, epoch, w, b) AS (SELECT s, 0, CAST(0 AS DOUBLE), CAST(0 AS DOUBLE) FROM m UNION ALL
        SELECT g.s, epoch + 1, w - 0.1 * 2 * (w * mxx + b * mx - mxy), b - 0.1 * 2 * (w * mx + b - my) FROM g JOIN m USING (s) WHERE epoch < 100)
      SELECT CAST(s AS VARCHAR) AS scenario, {r('w')} AS w, {r('b')} AS b, {r(_LOSS)} AS loss FROM g JOIN m USING (s) WHERE epoch = 100""",
)
def noise_scenarios(t):
    """The same line with the residual at one, five and ten tenths of its size."""
    df = _line(t)
    clean = 2 * F.col("x") + 1
    noisy = {str(s): df.select("x", (clean + (F.col("y") - clean) * s).alias("y")) for s in (0.1, 0.5, 1.0)}
    out = linear.compare_scenarios(noisy, ["x"], "y")
    return rounded(out.withColumn("w", F.col("w")[0]), "w", "b", "loss")


_Z = [f"""(t."{c}" - m{i}) / s{i} AS z{i}""" for i, c in enumerate(FEATURES)]
_STATS = ", ".join(f"""avg("{c}") AS m{i}, stddev_pop("{c}") AS s{i}""" for i, c in enumerate(FEATURES))
_PAIRS = [(i, j) for i in range(3) for j in range(i, 3)]
_c = lambda i, j: f"c{min(i, j)}{max(i, j)}"
_step = lambda i: f"2 * ({' + '.join(f'w{j} * {_c(i, j)}' for j in range(3))} + b * a{i} - y{i})"
_GRAM = ", ".join(
    [f"avg(z{i} * z{j}) AS {_c(i, j)}" for i, j in _PAIRS]
    + [f"avg(z{i}) AS a{i}, avg(z{i} * y) AS y{i}" for i in range(3)]
    + ["avg(y) AS my, avg(y * y) AS myy"]
)
_QUADRATIC = " + ".join(f"{1 if i == j else 2} * w{i} * w{j} * {_c(i, j)}" for i, j in _PAIRS)


@query(
    "gd_multi",
    f"""WITH RECURSIVE {TAGS}, s AS (SELECT {_STATS} FROM tags), z AS (SELECT {", ".join(_Z)}, moisture AS y FROM tags t, s),
      m AS (SELECT {_GRAM} FROM z), g(epoch, w0, w1, w2, b) AS (SELECT 0, CAST(0 AS DOUBLE), CAST(0 AS DOUBLE), CAST(0 AS DOUBLE), CAST(0 AS DOUBLE)
        UNION ALL SELECT epoch + 1, {", ".join(f"w{i} - 0.1 * {_step(i)}" for i in range(3))},
          b - 0.1 * 2 * ({" + ".join(f"w{j} * a{j}" for j in range(3))} + b - my) FROM g, m WHERE epoch < 100)
      SELECT epoch, {", ".join(f"{r(f'w{i}')} AS w{i}" for i in range(3))}, {r('b')} AS b,
        {r(f"myy + b * b - 2 * b * my + {_QUADRATIC} + 2 * ({' + '.join(f'w{i} * (b * a{i} - y{i})' for i in range(3))})")} AS loss FROM g, m WHERE epoch > 0""",
)
def gd_multi(t):
    """Descent on three standardised tags."""
    scaled = fit_scaler(t.tags, FEATURES).transform(t.tags)
    h = linear.descent_history(scaled, FEATURES, "moisture", epochs=100, learning_rate=0.1)
    h = h.select("epoch", *[F.col("w")[i].alias(f"w{i}") for i in range(3)], "b", "loss")
    return rounded(h, "w0", "w1", "w2", "b", "loss")


@query(
    "loss_surface",
    f"""WITH {MOMENTS} SELECT {r('w')} AS w, {r('b')} AS b, {r(_LOSS, 5)} AS loss FROM m,
      (SELECT -1 + i * (5.0 / 49) AS w FROM (SELECT unnest(range(50)) AS i)), (SELECT -2 + j * (5.0 / 49) AS b FROM (SELECT unnest(range(50)) AS j))""",
)
def loss_surface(t):
    grid = linear.loss_surface(_line(t), "x", "y", (-1, 4), (-2, 3))
    return rounded(rounded(grid, "w", "b"), "loss", digits=5)


@query(
    "residual_r2",
    f"""WITH {LINE}, p AS (SELECT y, 2 * x + 1 AS p FROM l) SELECT count(*) AS n, {r('1 - sum(pow(y - p, 2)) / (var_pop(y) * count(*))')} AS r2,
      {r('sqrt(avg(pow(y - p, 2)))')} AS rmse, {r('avg(abs(y - p))')} AS mae, {r('avg(y - p)')} AS mean_residual FROM p""",
)
def residual_r2(t):
    df = _line(t).withColumn("p", 2 * F.col("x") + 1)
    return rounded(linear.evaluate(df, "y", "p"), "r2", "rmse", "mae", "mean_residual")


@query(
    "ridge_cv",
    f"""WITH {TAGS} SELECT '{FEATURES[0]}' AS feature, {r('0.3 * stddev_pop("temp_PV")', 1)} AS coef FROM tags
      UNION ALL SELECT 'temp_SV', {r('-0.1 * stddev_pop("temp_SV")', 1)} FROM tags UNION ALL SELECT 'pressure', {r('0.5 * stddev_pop(pressure)', 1)} FROM tags""",
)
def ridge_cv(t):
    """Moisture is linear in the three tags, so the fit must recover the known coefficients."""
    fit = linear.fit_ridge(t.tags, FEATURES, "moisture", order_by=ORDER)
    return rounded(fit.top_coefficients(t.spark), "coef", digits=1)


@query(
    "ridge_predictions",
    f"WITH {TAGS} SELECT count(*) AS n, count(*) FILTER (moisture IS NOT NULL) AS n_close FROM tags",
)
def ridge_predictions(t):
    fit = linear.fit_ridge(t.tags, FEATURES, "moisture", order_by=ORDER)
    close = F.abs(F.col("prediction") - F.col("moisture")) < 0.05
    return fit.predict(t.tags).agg(F.count(F.lit(1)).alias("n"), F.count_if(close).alias("n_close"))


@query("rf_cv")
def rf_cv(t):
    return models.cross_validate(t.tags, FEATURES, "moisture", models.forest("moisture"), order_by=ORDER)[0]


_FOLDS = "SELECT CAST(f AS VARCHAR) AS fold, n // 6 AS n, true AS good FROM (SELECT count(*) AS n FROM events), (SELECT unnest(range(1, 6)) AS f) UNION ALL SELECT 'all', 5 * (n // 6), true FROM (SELECT count(*) AS n FROM events)"


@query("rf_bounds", _FOLDS)
def rf_bounds(t):
    """Test rows per fold; moisture is linear in the tags, so a forest must explain most of it."""
    return rf_cv(t).select("fold", "n", ((F.col("r2") > 0.8) & (F.col("mae") <= F.col("rmse"))).alias("good"))


@query("rf_importance")
def rf_importance(t):
    return models.select_by_forest(t.tags, FEATURES, "moisture", top=3)


@query("gbt_cv")
def gbt_cv(t):
    make = models.boosted("moisture", max_iter=10, max_depth=4)
    return models.cross_validate(t.tags, FEATURES, "moisture", make, order_by=ORDER, folds=3, early_stop=True)[0]


@query("param_search")
def param_search(t):
    space = {**models.SEARCH_SPACE, "max_depth": (3, 4), "max_iter": (3, 5)}
    return models.search_params(t.tags, FEATURES, "moisture", order_by=ORDER, trials=2, folds=2, space=space)


@query("ensemble")
def ensemble(t):
    make = models.forest("moisture", num_trees=10, max_depth=5)
    _, _, fitted = models.cross_validate(t.tags, FEATURES, "moisture", make, order_by=ORDER, folds=2, fit_on="all")
    scaled = fit_scaler(t.tags, FEATURES).transform(t.tags)
    return models.ensemble(scaled, fitted, [0.3, 0.7]).select("event_id", "prediction")


@query("batch_score")
def batch_score(t):
    make = models.forest("moisture", num_trees=10, max_depth=5)
    _, _, fitted = models.cross_validate(t.tags, FEATURES, "moisture", make, order_by=ORDER, folds=2, fit_on="all")
    return models.score(t.tags, fitted[-1], fit_scaler(t.tags, FEATURES)).select("event_id", "prediction")


@query("moisture_model")
def moisture_model(t):
    """The whole flow: interpolate, clip, features, forest selection, cross-validation."""
    df = t.tags.select("event_id", "ts", "unit", "temp_PV", "temp_SV", "flow_rate", "moisture")
    model = moisture.train_moisture_model(
        df, "moisture", order_by=ORDER, partition_by=["unit"], top=10, num_trees=10, max_depth=5, folds=3
    )
    return model.metrics


SUMMARISED = ["temp_PV", "temp_SV", "flow_rate", "pressure", "moisture"]


@query(
    "closing_summary",
    f"""WITH {TAGS}, c AS ({" UNION ALL ".join(f"SELECT '{a}' AS var1, '{b}' AS var2, corr({chr(34)}{a}{chr(34)}, {chr(34)}{b}{chr(34)}) AS r FROM tags" for a, b in combinations(SUMMARISED, 2))})
      SELECT min(ts) AS first_ts, max(ts) AS last_ts, count(*) AS n_rows, 5 AS n_features, {r("100.0 * (count(*) - count(flow_rate)) / (count(*) * 5)")} AS missing_pct,
        (SELECT arg_max(concat(var1, ':', var2), abs(r)) FROM c) AS strongest_pair, {r("(SELECT max(abs(r)) FROM c)")} AS strongest_r, true AS model_known FROM tags""",
)
def closing_summary(t):
    """All columns; of those that depend on the model whether they are known and whether the advices follow from them."""
    make = models.forest("moisture", num_trees=5, max_depth=4)
    metrics, _, fitted = models.cross_validate(t.tags, FEATURES, "moisture", make, order_by=ORDER, folds=2)
    ranks = models.importance_table(t.spark, FEATURES, fitted[-1].stages[-1].featureImportances.toArray())
    out = moisture.closing_summary(t.tags, SUMMARISED, "ts", metrics, ranks)
    pair, error = F.col("strongest_pair"), F.col("quality")
    advice = (F.col("missing_pct") > 5) == F.array_contains("actions", "improve_data_quality")
    advice &= (error["r2"] < 0.8) == F.array_contains("actions", "improve_model")
    known = F.col("top_feature").isin(FEATURES) & (error["mae"] >= 0) & (error["r2"] <= 1) & advice
    return rounded(
        out.select(
            "first_ts", "last_ts", "n_rows", "n_features", "missing_pct", F.concat_ws(":", pair["var1"], pair["var2"]).alias("strongest_pair"),
            F.abs(pair["r"]).alias("strongest_r"), known.alias("model_known"),
        ),
        "missing_pct", "strongest_r",
    )


@query("pca_variance")
def pca_variance(t):
    return anomaly.pca_variance(t.lineitem, ["l_quantity", "l_extendedprice", "l_discount", "l_tax"])


@query(
    "pca_variance_pair",
    f"""WITH c AS (SELECT abs(corr(l_quantity, l_extendedprice)) AS r FROM lineitem)
      SELECT 1 AS component, {r("(1 + r) / 2")} AS ratio, {r("(1 + r) / 2")} AS cumulative FROM c UNION ALL SELECT 2, {r("(1 - r) / 2")}, 1.0 FROM c""",
)
def pca_variance_pair(t):
    """Of two scaled columns the components carry 1 + |r| and 1 - |r|."""
    return rounded(anomaly.pca_variance(t.lineitem, ["l_quantity", "l_extendedprice"]), "ratio", "cumulative")


@query(
    "process_stability_pair",
    f"""WITH s AS (SELECT abs(corr(l_quantity, l_extendedprice)) AS r FROM lineitem) SELECT {r("sqrt(1 + r)")} AS pc1_std, sqrt(1 + r) > 2.0 AS unstable FROM s""",
)
def process_stability_pair(t):
    return rounded(anomaly.process_stability(anomaly.process_state(t.lineitem, ["l_quantity", "l_extendedprice"], ["l_orderkey"])), "pc1_std")


@query("pca_components")
def pca_components(t):
    return anomaly.components_needed(anomaly.pca_variance(t.lineitem, ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]))


@query("cluster_bounds", "SELECT count(*) AS n, 8::BIGINT AS n_clusters, true AS found FROM events WHERE (SELECT count(*) FROM events) >= 80")
def cluster_bounds(t):
    """Every row has a cluster, there are eight, and the finding counts those that the fit found rows for."""
    sizes = anomaly.cluster_sizes(anomaly.kmeans_clusters(t.tags, [*FEATURES, "flow_rate"]))
    said = report.cluster_finding(t.tags, [*FEATURES, "flow_rate"]).agg(F.max("value").alias("k"))
    counted = sizes.agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("n_clusters"))
    return counted.crossJoin(said).select("n", "n_clusters", (F.col("k") == F.col("n_clusters")).alias("found"))


@query("kmeans_sizes")
def kmeans_sizes(t):
    return anomaly.cluster_sizes(anomaly.kmeans_clusters(t.tags, [*FEATURES, "flow_rate"]))


@query("process_state")
def process_state(t):
    return anomaly.process_state(t.tags, [*FEATURES, "flow_rate"], ["event_id"])


@query("process_stability")
def process_stability(t):
    return anomaly.process_stability(anomaly.process_state(t.tags, [*FEATURES, "flow_rate"], ["event_id"]))


@query("isolation_forest")
def isolation_forest(t):
    scored = anomaly.anomaly_scores(t.tags, [*FEATURES, "flow_rate"], ["event_id"])
    return scored.select("event_id", "score", "is_anomaly")


@query(
    "anomaly_bounds",
    "SELECT count(*) AS n, CAST(floor(0.05 * (count(*) - 1)) + 1 AS BIGINT) AS n_at_most, true AS in_range, true AS lowest_flagged FROM events",
)
def anomaly_bounds(t):
    """Rows, the bound on how many lie below the 5 % threshold, and that exactly the lowest scores are flagged."""
    scored = anomaly.anomaly_scores(t.tags, [*FEATURES, "flow_rate"], ["event_id"], contamination=0.05)
    score, flagged = F.col("score"), F.col("is_anomaly")
    found = scored.agg(
        F.count("score").alias("n"), F.count_if(flagged).alias("flagged"), (F.min(score).between(-1, 0) & F.max(score).between(-1, 0)).alias("in_range"),
        (F.max(F.when(flagged, score)) < F.min(F.when(~flagged, score))).alias("lowest_flagged"),
    )
    most = (F.floor(0.05 * (F.col("n") - 1)) + 1).cast("long")
    return found.select("n", F.when((F.col("flagged") > 0) & (F.col("flagged") <= most), most).alias("n_at_most"), "in_range", "lowest_flagged")


@query("most_anomalous")
def most_anomalous(t):
    scored = anomaly.anomaly_scores(t.tags, [*FEATURES, "flow_rate"], ["event_id"], contamination=0.05, prepare="scaled")
    return scored.select("event_id", "score").orderBy("score", "event_id").limit(5)
