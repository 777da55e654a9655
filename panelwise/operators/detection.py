"""Anomaly detection over the long metric panel (every metric and day at once).

All windows are partitioned by series and metric and ordered by date, so a
group is one metric's calendar. Rows with a NULL value keep their slot.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from panelwise.functions.stats import array_mad, array_median

MAD_SCALE = 0.6745
MAD_ZERO_SCORE = 10.0
TOLERANCE = 1e-10
FEATURE_WINDOW = 10


def _by_metric(by: tuple[str, ...]):
    return W.partitionBy(*by, "metric_name").orderBy("metric_date")


def _score(value: Column, median: Column, mad: Column, count: Column) -> Column:
    off = F.when(F.abs(value - median) > TOLERANCE,
                 F.when(value > median, MAD_ZERO_SCORE).otherwise(-MAD_ZERO_SCORE)).otherwise(0.0)
    return F.when(count == 0, 0.0).when(mad == 0, off).otherwise(MAD_SCALE * (value - median) / mad)


def _scored(df: DataFrame, keys: list[str], threshold: float) -> DataFrame:
    z = _score(F.col("metric_value"), F.col("median"), F.col("mad"), F.col("baseline_count"))
    return df.where("metric_value is not null").select(
        *keys, "metric_value",
        F.coalesce("median", "metric_value").alias("median"), F.coalesce("mad", F.lit(0.0)).alias("mad"),
        "baseline_count", z.alias("zscore"), (F.abs(z) > threshold).alias("is_anomaly"))


def mad_zscore(gold: DataFrame, days: int = 30, threshold: float = 3.0, by: tuple[str, ...] = ()) -> DataFrame:
    """Modified z-score against the non-NULL values on the previous ``days`` panel dates.

    The bounded window is held as an array (at most ``days`` values), so the
    median and the MAD need neither a join nor a second shuffle.
    """
    history = F.collect_list("metric_value").over(_by_metric(by).rowsBetween(-days, -1))
    base = gold.withColumn("_h", history)
    base = base.withColumn("baseline_count", F.size("_h")).withColumn("median", array_median(F.col("_h")))
    base = base.withColumn("mad", array_mad(F.col("_h"), F.col("median")))
    return _scored(base, [*by, "metric_name", "metric_date"], threshold)


def mad_zscore_joined(gold: DataFrame, days: int = 30, threshold: float = 3.0, by: tuple[str, ...] = ()) -> DataFrame:
    """Same result as :func:`mad_zscore` by expanding each day to the targets it serves."""
    keys = [*by, "metric_name"]
    indexed = gold.withColumn("_i", F.row_number().over(_by_metric(by)))
    served = indexed.where("metric_value is not null").select(
        *keys, F.col("metric_value").alias("_v"),
        F.explode(F.sequence(F.col("_i") + 1, F.col("_i") + days)).alias("_i"))
    medians = served.groupBy(*keys, "_i").agg(F.median("_v").alias("median"), F.count("_v").alias("baseline_count"))
    mads = served.join(medians, [*keys, "_i"]).groupBy(*keys, "_i").agg(
        F.first("median").alias("median"), F.first("baseline_count").cast("int").alias("baseline_count"),
        F.median(F.abs(F.col("_v") - F.col("median"))).alias("mad"))
    base = indexed.join(mads, [*keys, "_i"], "left").fillna(0, subset=["baseline_count"])
    return _scored(base, [*keys, "metric_date"], threshold)


def baseline_stats(gold: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """Median, MAD, mean, population std, min, max and count per metric."""
    keys = [*by, "metric_name"]
    g = gold.where("metric_value is not null")
    med = g.withColumn("_m", F.median("metric_value").over(W.partitionBy(*keys)))
    return med.groupBy(*keys).agg(
        F.first("_m").alias("median"), F.median(F.abs(F.col("metric_value") - F.col("_m"))).alias("mad"),
        F.avg("metric_value").alias("mean"), F.stddev_pop("metric_value").alias("std"),
        F.min("metric_value").alias("min"), F.max("metric_value").alias("max"), F.count("*").alias("count"))


def changepoints(gold: DataFrame, penalty: str | float = "bic", min_size: int = 5,
                 by: tuple[str, ...] = (), grid: float | None = None) -> DataFrame:
    """Optimal mean-shift segmentation: least squared error plus a penalty per break.

    Candidate breaks lie on multiples of ``min_size``. Prefix sums come from a
    window; one array of candidates per metric is folded through the exact
    recurrence F(j) = min_i F(i) + cost(i, j) + penalty, ties to the earliest i.
    With ``grid``, costs are rounded to its multiples, so that equal costs of
    series of whole numbers stay equal however their sums were added up.
    """
    keys = [*by, "metric_name"]
    order = _by_metric(by)
    whole = W.partitionBy(*keys)
    run = order.rowsBetween(W.unboundedPreceding, 0)
    centred = gold.where("metric_value is not null").select(
        *keys, "metric_date", (F.col("metric_value") - F.avg("metric_value").over(whole)).alias("_c"),
        F.row_number().over(order).alias("i"), F.count("*").over(whole).alias("n"))
    sums = centred.select(*keys, "i", "n", F.sum("_c").over(run).alias("s"),
                          F.sum(F.col("_c") * F.col("_c")).over(run).alias("q"))
    origin = F.array(F.struct(F.lit(0).cast("long").alias("i"), F.lit(0.0).alias("s"), F.lit(0.0).alias("q")))
    cand = sums.where((F.col("i") % min_size == 0) | (F.col("i") == F.col("n"))).groupBy(*keys).agg(
        F.array_sort(F.collect_list(F.struct(F.col("i").cast("long").alias("i"), "s", "q"))).alias("c"),
        F.max("n").cast("long").alias("n")).withColumn("c", F.concat(origin, "c"))
    if penalty == "bic":
        pen = F.log(F.col("n").cast("double"))
    elif penalty == "aic":
        pen = F.lit(2.0)
    else:
        pen = F.lit(float(penalty))
    cand = cand.withColumn("pen", pen)

    def cost(a: Column, b: Column) -> Column:
        gap = F.get("c", b)["s"] - F.get("c", a)["s"]
        return F.get("c", b)["q"] - F.get("c", a)["q"] - gap * gap / (F.get("c", b)["i"] - F.get("c", a)["i"])

    def extend(best: Column, j: Column) -> Column:
        def option(i: Column) -> Column:
            wide_enough = F.get("c", j)["i"] - F.get("c", i)["i"] >= min_size
            total = F.get(best, i)["cost"] + cost(i, j) + F.col("pen")
            total = total if grid is None else F.rint(total / grid) * grid
            return F.struct(F.when(wide_enough, total).otherwise(F.lit(float("inf"))).alias("cost"), i.alias("prev"))
        return F.concat(best, F.array(F.array_min(F.transform(F.sequence(F.lit(0), j - 1), option))))

    start = F.array(F.struct(F.lit(0.0).alias("cost"), F.lit(-1).alias("prev")))
    last = (F.size("c") - 1).cast("int")
    solved = cand.withColumn("best", F.when(
        F.col("n") >= 2 * min_size, F.aggregate(F.sequence(F.lit(1), last), start, extend)))
    walk = F.aggregate(
        F.sequence(F.lit(1), last),
        F.struct(last.alias("at"), F.array().cast("array<bigint>").alias("found")),
        lambda acc, _: F.struct(
            F.greatest(F.get(F.col("best"), acc["at"])["prev"], F.lit(0)).alias("at"),
            F.when(F.get(F.col("best"), acc["at"])["prev"] > 0, F.concat(
                F.array(F.get("c", F.get(F.col("best"), acc["at"])["prev"])["i"]), acc["found"]))
            .otherwise(acc["found"]).alias("found")),
        lambda acc: acc["found"])
    return solved.select(*keys, "n", F.when(F.col("best").isNotNull(), walk)
                         .otherwise(F.array().cast("array<bigint>")).alias("breaks"))


def segments(gold: DataFrame, breaks: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """Mean, first date and length of every segment between breaks."""
    keys = [*by, "metric_name"]
    rows = gold.where("metric_value is not null").withColumn("_i", F.row_number().over(_by_metric(by)) - 1)
    # break arrays hold at most one entry per min_size days of one metric
    return rows.join(breaks.select(*keys, "breaks"), keys) \
        .withColumn("segment", F.size(F.filter("breaks", lambda b: b <= F.col("_i")))) \
        .groupBy(*keys, "segment").agg(F.avg("metric_value").alias("segment_mean"),
                                       F.min("metric_date").alias("start_date"), F.min("_i").alias("start_index"),
                                       F.count("*").alias("length"))


def regime_change(gold: DataFrame, breaks: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """The most recent mean shift of each metric."""
    keys = [*by, "metric_name"]
    w = W.partitionBy(*keys).orderBy("segment")
    seg = segments(gold, breaks, by).withColumn("before_mean", F.lag("segment_mean").over(w)) \
        .withColumn("_last", F.max("segment").over(W.partitionBy(*keys))).where("segment = _last")
    changed = F.col("segment") > 0
    before = F.coalesce("before_mean", "segment_mean")
    shift = F.when(changed, F.col("segment_mean") - before).otherwise(0.0)
    return seg.select(
        *keys, changed.alias("has_change"),
        F.when(changed, F.col("start_date")).alias("change_date"),
        F.when(changed, F.col("start_index")).alias("change_index"),
        before.alias("before_mean"), F.col("segment_mean").alias("after_mean"), shift.alias("mean_shift"),
        F.coalesce(F.try_divide(shift * 100.0, before), F.lit(0.0)).alias("percent_change"),
        F.when(F.abs(shift) < 0.01, "stable").when(shift > 0, "increase").otherwise("decrease").alias("direction"))


def break_flags(gold: DataFrame, breaks: DataFrame, within: int = 7, by: tuple[str, ...] = ()) -> DataFrame:
    """Per metric and day: did a segment start within the last ``within`` rows?"""
    keys = [*by, "metric_name"]
    rows = gold.where("metric_value is not null").withColumn("_i", F.row_number().over(_by_metric(by)) - 1)
    recent = F.exists("breaks", lambda b: (b <= F.col("_i")) & (F.col("_i") - b < within))
    return rows.join(breaks.select(*keys, "breaks"), keys).select(*keys, "metric_date", recent.alias("has_change"))


def temporal_features(gold: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """Value, mean of the prior 7 rows, population std of the prior 14, change over 7 rows."""
    o = _by_metric(by)
    v = F.col("metric_value")
    return gold.select(
        *by, "metric_name", "metric_date", "metric_value",
        F.coalesce(F.avg(v).over(o.rowsBetween(-7, -1)), v).alias("mean_7"),
        F.coalesce(F.stddev_pop(v).over(o.rowsBetween(-14, -1)), F.lit(0.0)).alias("std_14"),
        (v - F.coalesce(F.lag(v, 7).over(o), v)).alias("wow_delta"))


def univariate_features(wide: DataFrame, names: list[str], by: tuple[str, ...] = (),
                        window: int = FEATURE_WINDOW) -> DataFrame:
    """Row mean scaled to 0..1, its trailing mean and std, deviation and first difference."""
    numbers = F.array_compact(F.array(*[F.col(c).cast("double") for c in names]))
    total = F.aggregate(numbers, F.lit(0.0), lambda a, x: a + x)
    base = wide.select(*by, "metric_date", F.coalesce(F.try_divide(total, F.size(numbers)), F.lit(0.0)).alias("_x"))
    whole = W.partitionBy(*by)
    lo, hi = F.min("_x").over(whole), F.max("_x").over(whole)
    scaled = base.select(*by, "metric_date",
                         F.when(hi > lo, (F.col("_x") - lo) / (hi - lo)).otherwise(F.col("_x")).alias("value"))
    o = W.partitionBy(*by).orderBy("metric_date")
    trail = o.rowsBetween(-window, 0)
    mean = F.avg("value").over(trail)
    return scaled.select(
        *by, "metric_date", "value", mean.alias("rolling_mean"), F.stddev_pop("value").over(trail).alias("rolling_std"),
        (F.col("value") - mean).alias("deviation"),
        F.coalesce(F.col("value") - F.lag("value").over(o), F.lit(0.0)).alias("rate_of_change"))


def vote(flags: DataFrame, keys: list[str], min_votes: int, weights: dict[str, float] | None = None) -> DataFrame:
    """Fuse detector flags (rows: keys, detector, flag): anomaly from ``min_votes`` on."""
    w = F.lit(1.0)
    if weights:
        w = F.element_at(F.create_map(*[F.lit(x) for kv in weights.items() for x in kv]), F.col("detector"))
    hit = F.col("flag").cast("int")
    return flags.groupBy(*keys).agg(
        F.sum(hit).alias("votes"), F.count("*").alias("detectors"),
        (F.sum(hit * w) / F.sum(w)).alias("weighted_score")) \
        .withColumn("is_anomaly", F.col("votes") >= min_votes)


def detector_weights(flags: DataFrame, labels: DataFrame, keys: list[str], floor: float = 0.1) -> DataFrame:
    """Weight of each detector: F1 against pseudo-labels, floored and normalised to 1."""
    joined = flags.join(labels, keys)
    f1 = joined.groupBy("detector").agg(
        F.count_if(F.col("flag") & F.col("label")).alias("tp"),
        F.count_if(F.col("flag") & ~F.col("label")).alias("fp"),
        F.count_if(~F.col("flag") & F.col("label")).alias("fn")) \
        .withColumn("f1", F.coalesce(F.try_divide(2.0 * F.col("tp"), 2.0 * F.col("tp") + F.col("fp") + F.col("fn")), F.lit(0.0))) \
        .withColumn("_w", F.greatest(F.col("f1"), F.lit(floor)))
    # one row per detector: the unpartitioned window holds a handful of rows
    return f1.select("detector", "f1", (F.col("_w") / F.sum("_w").over(W.partitionBy())).alias("weight"))
