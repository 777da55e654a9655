"""Metrics of scored predictions: thresholds, confusion, AUC, folds, bands, series."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from panelwise.functions.draws import digest, poisson
from panelwise.operators.ordering import running_totals, with_range
from panelwise.session import written

HALF_WIDTH = 1.96


def score_table(pred: DataFrame, score: str = "score", label: str = "label") -> DataFrame:
    """Positives and negatives per distinct score with totals from the top (a hot score is one row)."""
    y = F.col(label).cast("long")
    per = pred.groupBy(F.col(score).cast("double").alias("s")).agg(F.sum(y).alias("pos"), F.sum(1 - y).alias("neg"))
    return running_totals(per, "s", ["pos", "neg"], ascending=False)


def best_threshold(pred: DataFrame, score: str = "score", label: str = "label") -> DataFrame:
    """Threshold with the highest F1 over all distinct scores (the highest threshold among equals)."""
    t = score_table(pred, score, label)
    f1 = F.coalesce(F.try_divide(2.0 * F.col("cum_pos"), F.col("cum_pos") + F.col("cum_neg") + F.col("all_pos")), F.lit(0.0))
    best = t.withColumn("f1", F.round(f1, 12)).agg(F.max_by(F.struct("s", "f1", "cum_pos", "cum_neg", "all_pos"), F.struct("f1", "s")).alias("b"))
    return best.select(F.col("b.s").alias("threshold"), F.col("b.f1").alias("f1"),
                       F.try_divide("b.cum_pos", F.col("b.cum_pos") + F.col("b.cum_neg")).alias("precision"), F.try_divide("b.cum_pos", "b.all_pos").alias("recall"))


def auc(pred: DataFrame, score: str = "score", label: str = "label") -> DataFrame:
    """ROC area (ties count half), average precision and trapezoid area of the precision-recall curve."""
    t = score_table(pred, score, label)
    prev_pos, prev_neg = F.col("cum_pos") - F.col("pos"), F.col("cum_neg") - F.col("neg")
    p_now = F.try_divide("cum_pos", F.col("cum_pos") + F.col("cum_neg"))
    p_before = F.coalesce(F.try_divide(prev_pos, prev_pos + prev_neg), F.lit(1.0))
    return t.agg(
        F.try_divide(F.sum((F.col("neg") * (prev_pos + F.col("pos") / 2.0)) / F.col("all_neg")), F.max("all_pos")).alias("roc_auc"),
        F.try_divide(F.sum(F.col("pos") * p_now), F.max("all_pos")).alias("average_precision"),
        F.try_divide(F.sum(F.col("pos") * (p_now + p_before) / 2.0), F.max("all_pos")).alias("pr_auc"))


def class_metrics(pred: DataFrame, keys: tuple[str, ...] = ()) -> DataFrame:
    """Precision, recall, F1 and support per class from counts per (label, prediction)."""
    c = pred.groupBy(*keys, "label", "prediction").agg(F.count("*").alias("n"))
    cells = c.select(*keys, F.inline(F.array(
        F.struct(F.col("label").alias("cls"), F.when(F.col("label") == F.col("prediction"), F.col("n")).otherwise(0).alias("tp"), F.col("n").alias("sup"), F.lit(0).cast("long").alias("hit")),
        F.struct(F.col("prediction").alias("cls"), F.lit(0).cast("long").alias("tp"), F.lit(0).cast("long").alias("sup"), F.col("n").alias("hit")))))
    g = cells.groupBy(*keys, "cls").agg(F.sum("tp").alias("tp"), F.sum("sup").alias("support"), F.sum("hit").alias("predicted"))
    zero = F.lit(0.0)
    return g.withColumn("precision", F.coalesce(F.try_divide("tp", "predicted"), zero)).withColumn("recall", F.coalesce(F.try_divide("tp", "support"), zero)) \
        .withColumn("f1", F.coalesce(F.try_divide(2.0 * F.col("tp"), F.col("predicted") + F.col("support")), zero))


def summary_metrics(pred: DataFrame, keys: tuple[str, ...] = ()) -> DataFrame:
    g = class_metrics(pred, keys)
    agg = [(F.sum("tp") / F.sum("support")).alias("accuracy"), F.avg("f1").alias("macro_f1"), (F.sum(F.col("f1") * F.col("support")) / F.sum("support")).alias("weighted_f1")]
    return g.groupBy(*keys).agg(*agg) if keys else g.agg(*agg)


def confusion(pred: DataFrame, classes: list) -> DataFrame:
    return pred.groupBy("label").pivot("prediction", classes).agg(F.count(F.lit(1))).fillna(0)


def kfold_metrics(pred: DataFrame, key: str, k: int = 5) -> DataFrame:
    """Metric per hash fold, then mean, sample deviation and half width over the folds."""
    fold = F.pmod(F.xxhash64(F.lit("fold"), F.col(key)), F.lit(k))
    s = summary_metrics(pred.withColumn("fold", fold), ("fold",)).unpivot(["fold"], ["accuracy", "macro_f1", "weighted_f1"], "metric", "value")
    return s.groupBy("metric").agg(F.count("*").alias("folds"), F.avg("value").alias("mean"), F.stddev_samp("value").alias("std"),
                                   (HALF_WIDTH * F.stddev_samp("value") / F.sqrt(F.count("*").cast("double"))).alias("half_width"))


def series_metrics(pred: DataFrame, series: str, extra: tuple[str, ...] = ()) -> DataFrame:
    """Detector quality per series from one conditional aggregate."""
    y, p = F.col("label").cast("boolean"), F.col("prediction").cast("boolean")
    g = pred.groupBy(series, *extra).agg(F.count_if(y & p).alias("tp"), F.count_if(~y & p).alias("fp"), F.count_if(y & ~p).alias("fn"), F.count_if(~y & ~p).alias("tn"))
    zero = F.lit(0.0)
    return g.withColumns({"precision": F.coalesce(F.try_divide("tp", F.col("tp") + F.col("fp")), zero), "recall": F.coalesce(F.try_divide("tp", F.col("tp") + F.col("fn")), zero),
                          "f1": F.coalesce(F.try_divide(2.0 * F.col("tp"), 2.0 * F.col("tp") + F.col("fp") + F.col("fn")), zero),
                          "flag_rate": (F.col("tp") + F.col("fp")) / (F.col("tp") + F.col("fp") + F.col("fn") + F.col("tn"))})


def roc_band(pred: DataFrame, score: str = "score", label: str = "label", draws: int = 1000, grid: int = 200, seed: int = 11, ranges: int | None = None) -> DataFrame:
    """Percentile band of the ROC curve over bootstrap resamples with Poisson weights, at exact distinct scores.

    The weights of rows with one score and label add up to a Poisson variable
    of their number, so only distinct scores are drawn for, not rows. Draws
    depend on seed, score, label and draw alone. Scores are cut into ranges, whose number follows from theirs; a
    task sums one range of one draw and the totals of higher ranges are added.
    Every draw starts at (0, 0), so all of them count at every false-positive rate.
    """
    y = F.col(label)
    cells = with_range(pred.where(y.isin(0, 1)).groupBy(F.col(score).cast("double").alias("s")).agg(
        F.count_if(y == 1).alias("pos"), F.count_if(y == 0).alias("neg")), "s", "_range", ranges)
    x = written(cells).withColumn("draw", F.explode(F.sequence(F.lit(1), F.lit(draws))))
    for name, kind in (("pos", 1), ("neg", 0)):
        key = digest(F.lit(seed), F.format_string("%.12f", "s"), F.lit(kind), F.col("draw"))
        x = poisson(x, name, key, f"w_{name}")
    x = written(x.select("draw", "_range", "s", "w_pos", "w_neg"))
    totals = x.groupBy("draw", "_range").agg(F.sum("w_pos").alias("p"), F.sum("w_neg").alias("n"))
    above, whole = W.partitionBy("draw").orderBy(F.desc("_range")).rowsBetween(W.unboundedPreceding, -1), W.partitionBy("draw")
    before = totals.select("draw", "_range", F.coalesce(F.sum("p").over(above), F.lit(0)).alias("p0"), F.coalesce(F.sum("n").over(above), F.lit(0)).alias("n0"),
                           F.sum("p").over(whole).alias("p1"), F.sum("n").over(whole).alias("n1"))
    w = W.partitionBy("draw", "_range").orderBy(F.desc("s")).rowsBetween(W.unboundedPreceding, 0)
    c = x.withColumns({"cp": F.sum("w_pos").over(w), "cn": F.sum("w_neg").over(w)}).join(before, ["draw", "_range"]).select(
        "draw", F.try_divide(F.col("cp") + F.col("p0"), "p1").alias("tpr"), F.try_divide(F.col("cn") + F.col("n0"), "n1").alias("fpr"))
    best = c.where("fpr IS NOT NULL").groupBy("draw", F.ceil(F.col("fpr") * grid).cast("int").alias("fpr_grid")).agg(F.max("tpr").alias("tpr"))
    points = pred.sparkSession.range(1, draws + 1).select(F.col("id").cast("int").alias("draw"), F.explode(F.sequence(F.lit(0), F.lit(grid))).alias("fpr_grid"))
    up = W.partitionBy("draw").orderBy("fpr_grid").rowsBetween(W.unboundedPreceding, 0)  # grid + 1 rows
    at = points.join(best, ["draw", "fpr_grid"], "left").withColumn("tpr", F.coalesce(F.max("tpr").over(up), F.lit(0.0)))
    return at.groupBy("fpr_grid").agg(F.avg("tpr").alias("mean_tpr"), F.percentile("tpr", F.lit(0.025)).alias("low"), F.percentile("tpr", F.lit(0.975)).alias("high"))
