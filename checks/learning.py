"""Detectors and models that iterate or learn."""

from pyspark.ml.functions import array_to_vector
from pyspark.sql import functions as F

from checks.detect import _UNI, MONEY_METRICS, gold_table, money_long, r, text_date, univariate
from checks.features import order_star, t
from checks.views import MONEY, with_rolled
from panelwise.operators import causes, daily, ensemble, evaluation, features, forecast, learning, neighbours
from panelwise.operators.ordering import parts_for
from panelwise.session import cut_lineage
from panelwise.sources import star

QUERIES, SQL = {}, {}
_U = ["value", "rolling_mean", "rolling_std", "deviation", "rate_of_change"]


def panel_points(s, d):
    u = univariate(s, d).withColumn("id", F.unix_date("metric_date").cast("long"))
    return cut_lineage(neighbours.standardised(u, _U).select("id", "metric_date", "features"))


def _add(name):
    def put(fn):
        QUERIES[name] = fn
        return fn
    return put


@_add("d7_local_outlier_factor")
def _lof(s, d):
    return r(neighbours.local_outlier_factor(panel_points(s, d).select("id", "features")), "lof", digits=5)


SQL["d7_local_outlier_factor"] = f"""WITH {with_rolled(MONEY)}, {_UNI},
f AS (SELECT date_diff('day', DATE '1970-01-01', d) AS id, [{", ".join(f"({c} - avg({c}) OVER ()) / stddev_pop({c}) OVER ()" for c in _U)}] AS x FROM u),
p AS (SELECT a.id, b.id AS o, list_distance(a.x, b.x) AS dist, row_number() OVER (PARTITION BY a.id ORDER BY list_distance(a.x, b.x), b.id) AS k FROM f a JOIN f b ON a.id <> b.id),
n AS (SELECT * FROM p WHERE k <= 20), kd AS (SELECT id, max(dist) AS kd FROM n GROUP BY id),
lr AS (SELECT n.id, 1 / (avg(greatest(kd.kd, n.dist)) + 1e-10) AS lrd FROM n JOIN kd ON kd.id = n.o GROUP BY n.id)
SELECT n.id, round(avg(b.lrd) / any_value(a.lrd), 5) AS lof FROM n JOIN lr a ON a.id = n.id JOIN lr b ON b.id = n.o GROUP BY n.id"""


@_add("d8_isolation_forest")
def _forest(s, d):
    return learning.isolation_forest(panel_points(s, d).select("id", "features"))


@_add("d9_reconstruction_error")
def _recon(s, d):
    return text_date(learning.reconstruction_error(panel_points(s, d), "metric_date"))


@_add("f4_forecast_model")
def _forecast(s, d):
    f = forecast.lag_features(money_long(s, d).where("metric_name = 'refund_rate'"))
    return learning.forecast_model(f, [f"lag_{i}" for i in range(14)] + ["mean_7", "std_7", "mean_14", "std_14", "diff_1"])


COLS = ["n_items", "installments", "price", "freight", "weight", "dow", "month", "seller_orders", "daily_orders", "freight_ratio", "price_per_gram", "same_region"]


def labelled(s, d):
    f = features.delivery_features(order_star(s, d), as_of_history=True)
    x = f.select("order_id", *[F.col(c).cast("double").alias(c) for c in COLS], F.col("late").cast("double").alias("label"), "priority").fillna(0.0, subset=COLS)
    return cut_lineage(features.stratified_split(features.class_weights(x, "label"), "order_id", "label"))


def _quality(scored, name):
    return evaluation.auc(scored).withColumn("model", F.lit(name)).withColumn("f1", evaluation.best_threshold(scored).select("f1").scalar())


@_add("l6_oversample")
def _over(s, d):
    x = neighbours.standardised(t(s, d, "customer").where("c_acctbal < 0"), ["c_acctbal", "c_nationkey"]).select(F.col("c_custkey").alias("id"), "features")
    return neighbours.oversample(x, 3).select("id", "draw", F.round(F.col("features")[0], 6).alias("f0"), F.round(F.col("features")[1], 6).alias("f1"))


@_add("l7_binary_models")
def _binary(s, d):
    x, out = labelled(s, d), None
    train, test = x.where("split = 'train'"), x.where("split = 'test'")
    for kind in ("logistic", "forest", "boosted"):
        q = _quality(cut_lineage(learning.score(test, learning.fit_binary(train, COLS, kind, "weight"), {}).select("score", "label")), kind)
        out = q if out is None else out.unionByName(q)
    return out


#: Up to so many labels (16 bytes each) are sent to every task, so that texts without a label are not shuffled.
SENT_LABELS = 2_000_000


def texts(s, d):
    labels = t(s, d, "labels").select("doc_id", "quality")
    docs = t(s, d, "documents").join(F.broadcast(labels) if labels.count() <= SENT_LABELS else labels, "doc_id")
    return cut_lineage(docs.select("doc_id", "text", F.col("quality").cast("double").alias("label")))


@_add("l8_text_models")
def _text(s, d):
    x, out = features.stratified_split(texts(s, d), "doc_id", "label"), None
    x = cut_lineage(x.repartition(parts_for(x.count(), 500)))
    for kind, p in learning.text_predictions(x.where("split = 'train'"), x.where("split <> 'train'")).items():
        m = evaluation.summary_metrics(cut_lineage(p)).withColumn("model", F.lit(kind))
        out = m if out is None else out.unionByName(m)
    return out


@_add("l9_embedding_model")
def _embedding(s, d):
    x = features.stratified_split(t(s, d, "embeddings").withColumn("label", F.col("label").cast("double")), "vec_id", "label")
    m = learning.fit_embedding(x.where("split = 'train'"))
    test = x.where("split <> 'train'").withColumn("features", array_to_vector(F.transform("embedding", lambda v: v.cast("double"))))
    return evaluation.summary_metrics(cut_lineage(m.transform(test).select("label", "prediction")))


@_add("l10_two_stage")
def _two(s, d):
    x = labelled(s, d).withColumn("duration", F.col("price") / 1000 + F.col("label") * 30).withColumn("scheduled", F.lit(60.0))
    fit = learning.fit_two_stage(x.where("split = 'train'"), COLS, "duration", "scheduled")
    return _quality(cut_lineage(fit(x.where("split = 'test'")).select("score", "label")), "two_stage")


@_add("l11_stacked")
def _stack(s, d):
    x = labelled(s, d).select("order_id", *COLS, "label", "split")
    fit = learning.fit_stacked(x.where("split = 'train'").drop("split"), "order_id", COLS, folds=3)
    return _quality(cut_lineage(fit(x.where("split = 'test'").drop("split")).select("score", "label")), "stacked")


@_add("l12_calibration")
def _calibrated(s, d):
    x = labelled(s, d)
    p = learning.score(x.where("split <> 'train'"), learning.fit_binary(x.where("split = 'train'"), COLS, "boosted"), {})
    c = learning.calibrate(cut_lineage(p.select("order_id", "score", "label")))
    return c.groupBy(F.floor(F.col("calibrated") * 10).alias("bin")).agg(F.count("*").alias("n"), F.avg("calibrated").alias("expected"), F.avg("label").alias("observed"))


@_add("l13_batch_scoring")
def _scoring(s, d):
    x = labelled(s, d)
    holes = x.withColumn("weight", F.when(F.col("order_id") % 5 != 0, F.col("weight")))
    return learning.score(holes, learning.fit_binary(x, COLS), {"weight": 25.0}, 0.4).groupBy("split", "prediction").agg(F.count("*").alias("n"), F.avg("score").alias("mean_score"))


@_add("e8_importance")
def _importance(s, d):
    x = labelled(s, d)
    m = learning.fit_binary(x.where("split = 'train'"), COLS, "boosted")
    own = learning.feature_importance(m, COLS, s).withColumnRenamed("importance", "model_importance")
    return learning.permutation_importance(x.where("split = 'test'"), "order_id", COLS, m).join(own, "feature")


@_add("d10_ensemble_days")
def _ensemble(s, d):
    wide = daily.rolling_gold(star.money_events(s, d), MONEY_METRICS)
    return r(text_date(ensemble.anomalous_days(wide, MONEY_METRICS)), "weighted_score")


@_add("r12_granger_edges")
def _granger(s, d):
    return learning.granger_test(causes.metric_edges(s), gold_table(s, d))


@_add("r13_discover_edges")
def _discover(s, d):
    return learning.discover_edges(cut_lineage(money_long(s, d)), MONEY_METRICS)


@_add("r14_granger_like")
def _like(s, d):
    return learning.granger_like(causes.metric_edges(s), gold_table(s, d))


