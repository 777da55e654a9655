"""Model fitting and scoring with pyspark.ml, isolation forest and lagged regressions.

Python appears inside tasks on groups of fixed size (a tree's hash sample, one
metric pair's daily series) and on blocks of terms.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import GBTClassifier, LogisticRegression, RandomForestClassifier
from pyspark.ml.feature import PCA, RegexTokenizer, StandardScaler, StopWordsRemover, VectorAssembler
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.regression import GBTRegressor
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from panelwise.operators import forest, linear, terms
from panelwise.operators.ordering import exact_quantiles, parts_for
from panelwise.operators.terms import Block, TermTable
from panelwise.session import cut_lineage

SEED = 42


# --- isolation forest ------------------------------------------------------------
def isolation_forest(points: DataFrame, trees: int = 200, sample: int = 256, contamination: float = 0.02) -> DataFrame:
    """(id, score, is_anomaly): mean path length over trees grown on hash samples of the rows.

    Each tree takes about ``sample`` rows, whatever the table's size: a pool of
    64 times as many rows is hashed from the table first, and the trees draw
    from the pool, so the table is not multiplied by the number of trees.
    """
    n = points.count()
    depth = math.ceil(math.log2(max(2, min(sample, n))))

    def uniform(*keys: str) -> Column:
        return F.shiftrightunsigned(F.xxhash64(*keys), 11).cast("double") / float(1 << 53)
    pool = cut_lineage(points.select("id", "features").where(uniform("id") < min(1.0, 64 * sample / max(n, 1))))
    rate = min(1.0, sample / max(pool.count(), 1))
    picked = pool.select("id", "features", F.explode(F.sequence(F.lit(0), F.lit(trees - 1))).alias("tree")).where(uniform("id", "tree") < rate)

    def grow(pdf: pd.DataFrame) -> pd.DataFrame:
        tree = int(pdf["tree"].iloc[0])
        x = np.stack(pdf.sort_values("id")["features"].to_numpy())
        rng, rows, stack = np.random.default_rng(SEED + tree), [], [(0, np.arange(len(x)), 0)]
        while stack:
            node, idx, level = stack.pop()
            spread = np.flatnonzero(np.ptp(x[idx], axis=0) > 0) if len(idx) > 1 else []
            if level >= depth or len(spread) == 0:
                rows.append((tree, node, -1, 0.0, level + _average_path(len(idx))))
                continue
            f = int(rng.choice(spread))
            cut = float(rng.uniform(x[idx, f].min(), x[idx, f].max()))
            rows.append((tree, node, f, cut, 0.0))
            left = x[idx, f] < cut
            stack += [(2 * node + 1, idx[left], level + 1), (2 * node + 2, idx[~left], level + 1)]
        return pd.DataFrame(rows, columns=["tree", "node", "feature", "cut", "path"])
    # at most trees x 2 x sample rows: a bounded model table
    nodes = picked.groupBy("tree").applyInPandas(grow, "tree int, node long, feature int, cut double, path double").toPandas()
    forest = {t: g.set_index("node")[["feature", "cut", "path"]].to_dict("index") for t, g in nodes.groupby("tree")}
    model = points.sparkSession.sparkContext.broadcast(forest)
    norm = _average_path(min(sample, n))

    @F.pandas_udf("double")
    def score(v: pd.Series) -> pd.Series:
        x = np.stack(v.to_numpy())
        total = np.zeros(len(x))
        for tree in model.value.values():
            stack = [(0, np.arange(len(x)))]
            while stack:
                node, idx = stack.pop()
                if len(idx) == 0:
                    continue
                spec = tree[node]
                if spec["feature"] < 0:
                    total[idx] += spec["path"]
                    continue
                left = x[idx, int(spec["feature"])] < spec["cut"]
                stack += [(2 * node + 1, idx[left]), (2 * node + 2, idx[~left])]
        return pd.Series(2.0 ** (-total / max(len(model.value), 1) / norm))
    scored = cut_lineage(points.select("id", score("features").alias("score")))
    cut = exact_quantiles(scored, "score", [1 - contamination]).select("quantile").scalar()
    return scored.withColumn("is_anomaly", F.col("score") >= cut)


def _average_path(n: int) -> float:
    return 0.0 if n <= 1 else 1.0 if n == 2 else 2.0 * (math.log(n - 1) + 0.5772156649) - 2.0 * (n - 1) / n


# --- reconstruction error -----------------------------------------------------------
def reconstruction_error(features: DataFrame, order: str, days: int = 7, components: int = 3, quantile: float = 0.995) -> DataFrame:
    """Error of a linear reconstruction of flattened ``days``-row windows against its training quantile."""
    w = W.partitionBy().orderBy(order).rowsBetween(-(days - 1), 0)  # one row per panel day
    x = features.withColumn("_w", F.flatten(F.collect_list("features").over(w)))
    full = x.agg(F.max(F.size("_w")).alias("m")).scalar()
    x = x.where(F.size("_w") == full).withColumn("v", array_to_vector("_w"))
    scaler = StandardScaler(inputCol="v", outputCol="z", withMean=True, withStd=True).fit(x)
    z = cut_lineage(scaler.transform(x).select(order, "z"))
    p = PCA(k=components, inputCol="z", outputCol="c").fit(z).transform(z)
    norm = lambda c: F.aggregate(vector_to_array(c), F.lit(0.0), lambda a, v: a + v * v)
    err = cut_lineage(p.select(order, ((norm("z") - norm("c")) / F.size(vector_to_array("z"))).alias("error")))
    return err.withColumn("is_anomaly", F.col("error") >= exact_quantiles(err, "error", [quantile]).select("quantile").scalar())


# --- supervised models -----------------------------------------------------------------
def _classifier(kind: str, weight: str | None):
    extra = {"weightCol": weight} if weight else {}
    return {"logistic": lambda: LogisticRegression(maxIter=30, regParam=0.01, **extra),
            "forest": lambda: RandomForestClassifier(numTrees=30, maxDepth=6, seed=SEED, **extra),
            "boosted": lambda: GBTClassifier(maxIter=15, maxDepth=4, seed=SEED, **extra)}[kind]()


def fit_binary(train: DataFrame, columns: list[str], kind: str = "logistic", weight: str | None = None) -> PipelineModel:
    """Assemble, standardise and fit; ``label`` is 0/1."""
    return Pipeline(stages=[VectorAssembler(inputCols=columns, outputCol="raw", handleInvalid="keep"),
                            StandardScaler(inputCol="raw", outputCol="features", withMean=True), _classifier(kind, weight)]).fit(train)


def score(df: DataFrame, model: PipelineModel, defaults: dict[str, float], threshold: float = 0.5) -> DataFrame:
    """Batch scoring: missing features get defaults, probability of class 1 against the stored threshold."""
    out = model.transform(df.fillna(defaults))
    return out.withColumn("score", vector_to_array("probability")[1]).withColumn("prediction", (F.col("score") >= threshold).cast("int")) \
        .drop("raw", "features", "rawPrediction", "probability")


def calibrate(scores: DataFrame) -> DataFrame:
    """Sigmoid calibration: a logistic fit on the raw score."""
    v = VectorAssembler(inputCols=["score"], outputCol="_v").transform(scores)
    m = LogisticRegression(featuresCol="_v", probabilityCol="_p", rawPredictionCol="_r", predictionCol="_y").fit(v)
    return m.transform(v).withColumn("calibrated", vector_to_array("_p")[1]).drop("_v", "_p", "_r", "_y")


def fit_two_stage(train: DataFrame, columns: list[str], duration: str, scheduled: str):
    """Duration regressor, then a classifier that also sees predicted minus scheduled duration."""
    first = Pipeline(stages=[VectorAssembler(inputCols=columns, outputCol="f1", handleInvalid="keep"),
                             GBTRegressor(featuresCol="f1", labelCol=duration, predictionCol="predicted_duration", maxIter=10, maxDepth=4, seed=SEED)]).fit(train)

    def with_gap(df: DataFrame) -> DataFrame:
        return first.transform(df).withColumn("gap", F.col("predicted_duration") - F.col(scheduled)).drop("f1")
    second = fit_binary(with_gap(train), [*columns, "predicted_duration", "gap"], "boosted")
    return lambda df: score(with_gap(df), second, {})


def fit_stacked(train: DataFrame, key: str, columns: list[str], kinds: tuple[str, ...] = ("logistic", "boosted"), folds: int = 5):
    """Meta logistic over out-of-fold scores of the base models."""
    x = train.withColumn("_fold", F.pmod(F.xxhash64(F.col(key)), F.lit(folds)))

    def apply(df: DataFrame, models: dict[str, PipelineModel]) -> DataFrame:
        for kind, m in models.items():
            df = score(df, m, {}).withColumnRenamed("score", f"s_{kind}").drop("prediction")
        return df
    parts = None
    for f in range(folds):
        rest = x.where(F.col("_fold") != f)
        part = apply(x.where(F.col("_fold") == f), {k: fit_binary(rest, columns, k) for k in kinds})
        parts = part if parts is None else parts.unionByName(part)
    meta = fit_binary(cut_lineage(parts), [f"s_{k}" for k in kinds])
    base = {k: fit_binary(train, columns, k) for k in kinds}
    return lambda df: score(apply(df, base), meta, {})


def text_tokens(df: DataFrame, text: str = "text") -> DataFrame:
    """Add ``_k``, the words without stop words."""
    words = RegexTokenizer(inputCol=text, outputCol="_w", pattern=r"[^\p{L}\p{N}]+").transform(df)
    return StopWordsRemover(inputCol="_w", outputCol="_k", locale="en_US").transform(words).drop("_w")


def _logistic_terms(table: TermTable, y: np.ndarray, classes: int) -> np.ndarray:
    """Predicted class of the asked rows."""
    send = table.blocks.sparkSession.sparkContext.broadcast

    def times(a: np.ndarray, side: str) -> np.ndarray:
        sent, n = send(a), getattr(table, side)

        def give(block: Block) -> list[np.ndarray]:
            return [np.stack([block.spread(block.gathered(x), side) for x in sent.value.T], axis=1)]
        return table.sums(give, [(n, a.shape[1])], tuple({"known", side}))[0]
    rows, shift, _ = linear.logistic(lambda a: times(a, "known"), y, classes, 20, 0.01)
    margins = times(rows, "asked") + shift
    return (margins[:, 0] > 0).astype(int) if margins.shape[1] == 1 else margins.argmax(axis=1)


def _bayes_terms(table: TermTable, y: np.ndarray, smoothing: float = 1.0) -> np.ndarray:
    """Predicted position among the classes of ``y`` of the asked rows, from counts times idf."""
    kinds, seen = np.unique(y, return_counts=True)
    sent = table.blocks.sparkSession.sparkContext.broadcast((y, kinds))

    def give(block: Block) -> list[np.ndarray]:
        own, of = sent.value
        sums = [block.idf * block.by_term(block.known_counts * (own == c)[block.known_rows]) for c in of]
        logs = np.stack([block.counted(block.idf * np.log(s + smoothing), "asked") for s in sums], axis=1)
        return [np.array([s.sum() for s in sums]), logs, block.counted(block.idf, "asked")]
    total, logs, weight = table.sums(give, [(len(kinds),), (table.asked, len(kinds)), (table.asked,)], ("known", "asked"))
    return (logs - weight[:, None] * np.log(total + smoothing * table.terms) + np.log(seen + smoothing)).argmax(axis=1)


def _support_terms(table: TermTable, y: np.ndarray) -> np.ndarray:
    """Margins of the asked rows by support vectors of label 1 against 0."""
    n, send = table.known, table.blocks.sparkSession.sparkContext.broadcast

    def of(block: Block):
        return lambda rows: block.gathered(rows.value) / n

    def one(rows) -> np.ndarray:
        return np.array([rows.value.sum() / n])

    def gram(done: linear.Steps) -> np.ndarray:
        own = linear.inner_products(one, done)
        return own + table.sums(lambda block: [linear.inner_products(of(block), done)], [own.shape])[0]

    def margins(done: linear.Steps, factors: tuple, lengths: list[float]) -> np.ndarray:
        own = linear.trials(one, done, factors, lengths)
        return np.concatenate(own) + table.sums(lambda block: [np.stack([block.spread(v) for v in linear.trials(of(block), done, factors, lengths)], axis=1)], [(n, len(own))])[0]
    done, _ = linear.support_vectors(gram, margins, send, y, 15)
    return linear.repeated(one, done)[0] + table.sums(lambda block: [block.spread(linear.repeated(of(block), done)[0], "asked")], [(table.asked,)], ("known", "asked"))[0]


def text_predictions(train: DataFrame, test: DataFrame, kinds: tuple[str, ...] = ("logistic", "bayes", "forest", "svm"), text: str = "text",
                     min_df: int = 3) -> dict[str, DataFrame]:
    """(label, prediction) of ``test`` by each kind of text classifier, over words and bigrams that at least ``min_df`` texts of ``train`` have.

    Texts are tokenised and counted once for all kinds, into blocks of terms (``terms.py``). Logistic regression, naive Bayes and
    one support vector model per class are those of ``pyspark.ml`` over counts times idf. The forest takes the counts; idf is a
    factor per term, so it has the same splits. Both tables are read twice and have to have the same rows in the same order: give
    written ones. Labels are 0, 1, ... The driver holds some dozen numbers per text, none per term.
    """
    spark, trees = train.sparkSession, 20
    both = train.select("label", F.lit(False).alias("test"), F.col(text).alias("text")).unionByName(
        test.select("label", F.lit(True).alias("test"), F.col(text).alias("text"))).withColumn("row", F.monotonically_increasing_id())
    rows = both.select("row", "test", "label", F.length("text").alias("size"), F.when(~F.col("test"), forest.weights(F.col("row"), trees)).alias("w")).toArrow()
    known, asked = rows.filter(pc.invert(rows.column("test"))), rows.filter(rows.column("test"))
    labels = known.column("label").to_numpy().astype(float)
    if set(kinds) - {"forest"} and not (len(labels) and (labels >= 0).all() and (labels == np.floor(labels)).all()):
        raise ValueError("labels have to be 0, 1, ...")
    chars = pc.sum(rows.column("size")).as_py() or 0
    tokens = text_tokens(both.coalesce(max(spark.sparkContext.defaultParallelism, parts_for(chars, terms.BLOCK_CHARS))))
    table = terms.from_words(tokens.select("row", "_k"), known.column("row").to_numpy(), asked.column("row").to_numpy(), chars, min_df)
    found, y = sorted(set(labels)), labels.astype(int)
    classes = int(labels.max()) + 1

    def predicted(kind: str) -> np.ndarray:
        if kind == "forest":
            grown = forest.grow(table, np.searchsorted(found, labels), len(found), forest.drawn_weights(known.column("w"), trees), 5)
            return np.array(found)[grown.votes()]
        if kind == "bayes":
            return _bayes_terms(table, y)
        if kind == "logistic":
            return np.full(table.asked, found[0]) if len(found) == 1 else _logistic_terms(table, y, classes)
        if classes <= 2:  # the models of two classes mirror each other
            return _support_terms(table, y) > 0
        return np.stack([_support_terms(table, (y == c).astype(int)) for c in range(classes)], axis=1).argmax(axis=1)
    return {kind: spark.createDataFrame(pa.table({"label": asked.column("label"), "prediction": predicted(kind).astype(float)})) for kind in kinds}


def fit_embedding(train: DataFrame, vector: str = "embedding") -> PipelineModel:
    v = train.withColumn("features", array_to_vector(F.transform(vector, lambda x: x.cast("double"))))
    return Pipeline(stages=[LogisticRegression(maxIter=30, regParam=0.01)]).fit(v)


def forecast_model(feats: DataFrame, lags: list[str], ts: str = "metric_date", train: float = 0.8) -> DataFrame:
    """Boosted regression on lag features of one metric, split in time; train and test mean absolute error."""
    known = feats.where("target is not null").na.drop(subset=lags).withColumn("_d", F.unix_date(ts).cast("double"))
    cut = exact_quantiles(known, "_d", [train]).select("quantile").scalar()
    x = cut_lineage(VectorAssembler(inputCols=lags, outputCol="f").transform(known).withColumn("part", F.when(F.col("_d") <= cut, "train").otherwise("test")))
    m = GBTRegressor(featuresCol="f", labelCol="target", maxIter=15, maxDepth=3, seed=SEED).fit(x.where("part = 'train'"))
    return m.transform(x).groupBy("part").agg(F.avg(F.abs(F.col("prediction") - F.col("target"))).alias("mae"), F.count("*").alias("rows"))


def feature_importance(model: PipelineModel, columns: list[str], spark) -> DataFrame:
    values = model.stages[-1].featureImportances.toArray()
    return spark.createDataFrame([(c, float(v)) for c, v in zip(columns, values)], "feature string, importance double").orderBy(F.desc("importance"), "feature")


def permutation_importance(df: DataFrame, key: str, columns: list[str], model: PipelineModel) -> DataFrame:
    """Loss of accuracy when one column takes the value of another row.

    The donor is the row holding the next position in a hash order within one
    of the hash buckets, whose number follows from that of the rows.
    """
    buckets = parts_for(df.count())
    base = df.withColumn("_b", F.pmod(F.xxhash64(F.lit("perm"), F.col(key)), F.lit(buckets)))
    ring = W.partitionBy("_b").orderBy(F.xxhash64(F.col(key), F.lit(1)))
    whole = W.partitionBy("_b").orderBy(F.xxhash64(F.col(key), F.lit(1))).rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    donor = base.withColumns({f"_p_{c}": F.coalesce(F.lead(c).over(ring), F.first(c).over(whole)) for c in columns})
    donor = cut_lineage(donor)

    def accuracy(x: DataFrame, name: str) -> DataFrame:
        return score(x, model, {}).agg(F.lit(name).alias("feature"), F.avg((F.col("prediction") == F.col("label")).cast("int")).alias("accuracy"))
    out = accuracy(donor, "")
    for c in columns:
        out = out.unionByName(accuracy(donor.withColumn(c, F.col(f"_p_{c}")), c))
    out = cut_lineage(out)
    full = out.where("feature = ''").select("accuracy").scalar()
    return out.where("feature <> ''").select("feature", (full - F.col("accuracy")).alias("importance"))


# --- lagged regressions ------------------------------------------------------------------
def f_tail(f: float, d1: int, d2: int) -> float:
    """P(F > f): regularised incomplete beta by its continued fraction."""
    if not math.isfinite(f):
        return 0.0
    if f <= 0:
        return 1.0
    x, a, b = d2 / (d2 + d1 * f), d2 / 2.0, d1 / 2.0
    if x > (a + 1) / (a + b + 2):
        return 1.0 - _beta_fraction(1 - x, b, a)
    return _beta_fraction(x, a, b)


def _beta_fraction(x: float, a: float, b: float) -> float:
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x)) / a
    value = 1.0
    for m in range(200, 0, -1):  # evaluated from the tail
        even = m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m))
        odd = -(a + m - 1) * (a + b + m - 1) * x / ((a + 2 * m - 2) * (a + 2 * m - 1))
        value = 1.0 + odd / (1.0 + even / value)
    return front / value


def granger_test(pairs: DataFrame, gold: DataFrame, max_lag: int = 7, alpha: float = 0.05, min_extra: int = 20) -> DataFrame:
    """Best lag of each (src, dst) pair: F test of past src values in a regression of dst on its own past.

    A group is one pair's daily series (bounded by the calendar).
    """
    g = gold.where("metric_value is not null")
    a = g.select(F.col("metric_name").alias("src"), "metric_date", F.col("metric_value").alias("x"))
    b = g.select(F.col("metric_name").alias("dst"), "metric_date", F.col("metric_value").alias("y"))
    series = a.join(pairs.select("src", "dst"), "src").join(b, ["dst", "metric_date"])

    def test(pdf: pd.DataFrame) -> pd.DataFrame:
        p = pdf.sort_values("metric_date")
        x, y, n = p["x"].to_numpy(), p["y"].to_numpy(), len(p)
        best = (None, None, None)
        if n >= min_extra + max_lag and np.ptp(x) > 0 and np.ptp(y) > 0:
            for lag in range(1, max_lag + 1):
                own = np.column_stack([np.ones(n - lag)] + [y[lag - i:n - i] for i in range(1, lag + 1)])
                both = np.column_stack([own] + [x[lag - i:n - i] for i in range(1, lag + 1)])
                rss = [float(((y[lag:] - m @ np.linalg.lstsq(m, y[lag:], rcond=None)[0]) ** 2).sum()) for m in (own, both)]
                df2 = n - lag - both.shape[1]
                if df2 <= 0 or rss[1] <= 0:
                    continue
                f = max(0.0, (rss[0] - rss[1]) / lag / (rss[1] / df2))
                pv = f_tail(f, lag, df2)
                if best[1] is None or pv < best[1]:
                    best = (f, pv, lag)
        sig = best[1] is not None and best[1] < alpha
        strength = min(0.99, max(0.1, 1 - best[1])) if sig else 0.1
        return pd.DataFrame([(p["src"].iloc[0], p["dst"].iloc[0], n, best[0], best[1], best[2], bool(sig), strength)],
                            columns=["src", "dst", "n", "f_stat", "p_value", "lag", "significant", "strength"])
    return series.groupBy("src", "dst").applyInPandas(test, "src string, dst string, n long, f_stat double, p_value double, lag int, significant boolean, strength double")


def discover_edges(gold: DataFrame, names: list[str], max_lag: int = 7) -> DataFrame:
    """Significant ordered metric pairs that keep the graph acyclic, strongest first.

    The pair list is built from the (fixed) metric names; accepted edges are a
    few hundred rows at most and are filtered on the driver.
    """
    spark = gold.sparkSession
    pairs = spark.createDataFrame([(a, b) for a in names for b in names if a != b], "src string, dst string")
    found = granger_test(pairs, gold, max_lag).where("significant")
    rows = found.orderBy("p_value", "src", "dst").collect()
    above: dict[str, set[str]] = {m: {m} for m in names}
    keep = []
    for r in rows:
        if r["dst"] in above[r["src"]]:
            continue
        for m in names:
            if r["dst"] in above[m]:
                above[m] |= above[r["src"]]
        keep.append((r["src"], r["dst"], r["p_value"], r["f_stat"], r["lag"], r["strength"]))
    return spark.createDataFrame(keep, "src string, dst string, p_value double, f_stat double, lag int, strength double")


def granger_like(pairs: DataFrame, gold: DataFrame, lags: int = 3) -> DataFrame:
    """1 - p of one F test: do ``lags`` past values of src explain dst beyond its own ``lags`` past values?

    Both regressions are without intercept. Fewer than lags + 5 common days,
    no spare degree of freedom or a perfect fit give 0. A group is one pair's
    daily series (bounded by the calendar).
    """
    g = gold.where("metric_value is not null")
    a = g.select(F.col("metric_name").alias("src"), "metric_date", F.col("metric_value").alias("x"))
    b = g.select(F.col("metric_name").alias("dst"), "metric_date", F.col("metric_value").alias("y"))
    series = a.join(pairs.select("src", "dst"), "src").join(b, ["dst", "metric_date"])

    def test(pdf: pd.DataFrame) -> pd.DataFrame:
        p = pdf.sort_values("metric_date")
        x, y, n, score = p["x"].to_numpy(), p["y"].to_numpy(), len(p), 0.0
        if n >= lags + 5:
            own = np.column_stack([y[lags - i:n - i] for i in range(1, lags + 1)])
            both = np.column_stack([own, *[x[lags - i:n - i] for i in range(1, lags + 1)]])
            rss = [float(((y[lags:] - m @ np.linalg.lstsq(m, y[lags:], rcond=None)[0]) ** 2).sum()) for m in (own, both)]
            spare = n - lags - 2 * lags
            if spare > 0 and rss[1] > 0:
                score = max(0.0, 1.0 - f_tail(max(0.0, (rss[0] - rss[1]) / lags / (rss[1] / spare)), lags, spare))
        return pd.DataFrame([(p["src"].iloc[0], p["dst"].iloc[0], round(score, 4))], columns=["src", "dst", "score"])
    return series.groupBy("src", "dst").applyInPandas(test, "src string, dst string, score double")
