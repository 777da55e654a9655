"""Root-cause search: metric graph, temporal precedence, anomaly statistics, ranking.

Statistics of a metric depend only on the metric and the end day, so they are
computed once per (metric, day) from a bounded window array and then joined to
every incident that needs them; no series is expanded per incident or lag.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from panelwise import config
from panelwise.functions.draws import digest, normals
from panelwise.functions.stats import array_mad, array_median, bind, logistic
from panelwise.session import literal_table

MAX_LAG = 14
MIN_CORRELATION = 0.3
CORRELATION_WEIGHT, LAG_WEIGHT = 0.6, 0.4


def metric_edges(spark: SparkSession) -> DataFrame:
    return literal_table(spark, config.METRIC_EDGES, "src string, dst string")


def graph_closure(edges: DataFrame) -> DataFrame:
    """(metric, upstream, hops, path, proximity) for every reachable pair of the metric graph, plus self.

    The graph is a fixed table of some twenty edges. Of several shortest paths
    the first in name order is kept.
    """
    paths = edges.sparkSession.sql("""
        WITH RECURSIVE walk AS (
          SELECT dst AS metric, src AS upstream, 1 AS hops, array(src, dst) AS path FROM {edges}
          UNION ALL
          SELECT w.metric, e.src, w.hops + 1, concat(array(e.src), w.path) FROM walk w JOIN {edges} e ON e.dst = w.upstream
          WHERE NOT array_contains(w.path, e.src))
        SELECT metric, upstream, min(struct(hops, path)) AS best FROM walk GROUP BY metric, upstream
    """, edges=edges)
    far = paths.select("metric", "upstream", F.col("best.hops").alias("hops"), F.col("best.path").alias("path"))
    nodes = edges.select("src").union(edges.select("dst")).distinct().toDF("metric")
    own = nodes.select("metric", F.col("metric").alias("upstream"), F.lit(0).alias("hops"), F.array("metric").alias("path"))
    return far.unionByName(own).withColumn("proximity", F.when(F.col("hops") == 0, 1.0).otherwise(1.0 / (F.col("hops") + 1)))


def learned_proximity(closure: DataFrame, strengths: DataFrame, default: float = 1.0) -> DataFrame:
    """Proximity times the geometric mean of the learned strengths along the shortest path."""
    steps = closure.where("hops > 0").select("metric", "upstream", "proximity", F.explode(F.expr(
        "transform(sequence(0, size(path) - 2), i -> struct(path[i] AS src, path[i + 1] AS dst))")).alias("e")) \
        .select("metric", "upstream", "proximity", "e.src", "e.dst")
    s = steps.join(F.broadcast(strengths.select("src", "dst", "strength")), ["src", "dst"], "left")
    return s.groupBy("metric", "upstream").agg(
        F.first("proximity").alias("proximity"),
        F.exp(F.avg(F.log(F.coalesce("strength", F.lit(default))))).alias("path_strength")) \
        .withColumn("learned_proximity", F.col("proximity") * F.col("path_strength"))


def window_series(gold: DataFrame, days: int = 14, by: tuple[str, ...] = ()) -> DataFrame:
    """Per metric and day: the non-NULL values of the trailing ``days`` + 1 panel dates."""
    w = W.partitionBy(*by, "metric_name").orderBy("metric_date").rowsBetween(-days, 0)
    return gold.select(*by, "metric_name", "metric_date", F.collect_list("metric_value").over(w).alias("series"))


def _std(a: Column) -> Column:
    mean = F.aggregate(a, F.lit(0.0), lambda s, x: s + x) / F.size(a)
    return bind(mean, lambda m: F.sqrt(F.aggregate(a, F.lit(0.0), lambda s, x: s + (x - m) * (x - m)) / F.size(a)))


def candidate_stats(series: DataFrame) -> DataFrame:
    """Last value, median and robust z-score of each window (std fallback for a flat MAD), and its anomaly window."""
    n = F.size("series")
    s = series.where(n >= 3).withColumn("current_value", F.element_at("series", -1)).withColumn("baseline", array_median(F.col("series")))
    s = s.withColumn("_mad", array_mad(F.col("series"), F.col("baseline"))).withColumn("_std", _std(F.col("series")))
    flat = F.col("_mad") < 1e-10
    z = F.when(~flat, 0.6745 * (F.col("current_value") - F.col("baseline")) / F.col("_mad")) \
        .when(F.col("_std") < 1e-10, 0.0).otherwise((F.col("current_value") - F.col("baseline")) / F.col("_std"))
    scale = F.when(~flat, F.col("_mad")).when(F.col("_std") > 1e-10, F.col("_std") / 0.6745).otherwise(1.0)
    quiet = bind(F.struct(F.col("baseline").alias("b"), F.col("_scale").alias("s")), lambda p: F.filter(
        F.sequence(F.lit(1), n), lambda i: F.abs(0.6745 * (F.element_at("series", i) - p["b"]) / p["s"]) < 2.0))
    run = n - F.coalesce(F.array_max(quiet), F.lit(0))
    return s.withColumn("zscore", z).withColumn("_scale", scale).withColumn("anomalous_days", F.greatest(run, F.lit(1))) \
        .withColumn("anomaly_start", F.date_sub("metric_date", F.col("anomalous_days") - 1)).drop("_mad", "_std", "_scale")


def lagged_correlation(x: Column, y: Column, lag: Column) -> Column:
    """Pearson correlation of x(t - lag) with y(t); NULL below three overlaps or without variance."""
    m = F.size(x) - lag
    a, b = F.slice(x, F.lit(1), F.greatest(m, F.lit(0))), F.slice(y, lag + 1, F.greatest(m, F.lit(0)))
    zero = F.struct(*[F.lit(0.0).alias(k) for k in ("sx", "sy", "xx", "yy", "xy")])
    sums = F.aggregate(F.arrays_zip(a.alias("a"), b.alias("b")), zero, lambda s, p: F.struct(
        (s["sx"] + p["a"]).alias("sx"), (s["sy"] + p["b"]).alias("sy"), (s["xx"] + p["a"] * p["a"]).alias("xx"),
        (s["yy"] + p["b"] * p["b"]).alias("yy"), (s["xy"] + p["a"] * p["b"]).alias("xy")),
        lambda s: F.struct((m * s["xy"] - s["sx"] * s["sy"]).alias("c"), (m * s["xx"] - s["sx"] * s["sx"]).alias("vx"),
                           (m * s["yy"] - s["sy"] * s["sy"]).alias("vy")))
    return F.when(m >= 3, bind(sums, lambda s: F.when((s["vx"] > 1e-12) & (s["vy"] > 1e-12), s["c"] / F.sqrt(s["vx"] * s["vy"]))))


def temporal_precedence(pairs: DataFrame, x: str = "candidate_series", y: str = "target_series", max_lag: int = MAX_LAG) -> DataFrame:
    """Best correlation over lags at which the candidate leads, and the precedence score."""
    n = F.least(F.size(x), F.size(y))

    def centred(series: Column) -> Column:
        """Zero mean, unit spread; NULL for a constant series."""
        tail = F.slice(series, F.size(series) - n + 1, n)
        def scale(v: Column) -> Column:
            stats = F.struct((F.aggregate(v, F.lit(0.0), lambda s, e: s + e) / F.size(v)).alias("m"), _std(v).alias("sd"))
            return bind(stats, lambda k: F.when(k["sd"] >= 1e-10, F.transform(v, lambda e: (e - k["m"]) / k["sd"])))
        return bind(tail, scale)

    def best_of(pair: Column) -> Column:
        options = F.transform(F.sequence(F.lit(0), F.greatest(F.least(F.lit(max_lag), n - 1), F.lit(0))), lambda k: F.struct(
            F.round(lagged_correlation(pair["x"], pair["y"], k), 9).alias("r"), (-k).alias("neg_lag")))
        return F.when((n >= 3) & pair["x"].isNotNull() & pair["y"].isNotNull(), F.array_max(F.filter(options, lambda o: o["r"].isNotNull())))
    best = bind(F.struct(centred(F.col(x)).alias("x"), centred(F.col(y)).alias("y")), best_of)
    # inline() keeps the fold from being repeated by every column that reads it
    p = pairs.select("*", F.inline(F.array(F.struct(best.alias("_best"), F.least(F.lit(max_lag), n - 1).alias("_top")))))
    lag, r = -F.col("_best.neg_lag"), F.col("_best.r")
    lag_score = F.when(lag > 0, F.least(F.lit(1.0), lag / F.col("_top"))).otherwise(0.5)
    # least() skips NULL, so a missing correlation is excluded explicitly
    score = F.when(r.isNotNull(), CORRELATION_WEIGHT * F.least(F.lit(1.0), F.abs(r)) + LAG_WEIGHT * lag_score)
    return p.withColumn("precedence", F.coalesce(score, F.lit(0.0))).withColumn("optimal_lag", F.coalesce(lag, F.lit(0))) \
        .withColumn("max_correlation", F.coalesce(r, F.lit(0.0))) \
        .withColumn("significant", F.coalesce(F.abs(r) >= MIN_CORRELATION, F.lit(False))) \
        .drop("_top", "_best")


def contribution(weights: dict[str, float], z: Column, temporal: Column, proximity: Column, quality: Column) -> Column:
    def unit(c: Column) -> Column:
        return F.greatest(F.lit(0.0), F.least(F.lit(1.0), c))
    raw = weights["anomaly"] * logistic(F.abs(z), 3.0, 0.5) + weights["temporal"] * unit(temporal) \
        + weights["proximity"] * unit(proximity) + weights["quality"] * unit(quality)
    return F.round(unit(raw), 4)


def _score(weights: dict[str, float]) -> Column:
    return contribution(weights, F.col("zscore"), F.col("precedence"), F.col("proximity"), F.col("quality"))


def rank_causes(cands: DataFrame, k: int = 5, weights: dict[str, float] | None = None) -> DataFrame:
    """Top-k candidates per incident (a group holds at most the metrics of the graph)."""
    scored = cands.withColumn("score", _score(weights or config.CAUSE_WEIGHTS))
    w = W.partitionBy("incident_id").orderBy(F.desc("score"), "metric_name")
    return scored.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def relative_importance(ranked: DataFrame) -> DataFrame:
    total = F.sum("score").over(W.partitionBy("incident_id"))
    return ranked.withColumn("importance_pct", F.coalesce(F.try_divide(F.col("score") * 100.0, total), F.lit(0.0)))


def bootstrap_ci(cands: DataFrame, draws: int = 200, noise: float = 0.05, seed: int = 7) -> DataFrame:
    """Percentile interval of the score under relative Gaussian noise on every component.

    The noise follows from seed, incident, metric and draw, so it does not depend on partitioning.
    """
    d = cands.withColumn("_draw", F.explode(F.sequence(F.lit(1), F.lit(draws)))) \
        .withColumn("_md5", digest(F.lit(seed), F.col("incident_id"), F.col("metric_name"), F.col("_draw")))
    for c, z in zip(("zscore", "precedence", "proximity", "quality"), normals(F.col("_md5"))):
        d = d.withColumn(c, F.col(c) * (1 + z * noise))
    s = d.withColumn("_s", _score(config.CAUSE_WEIGHTS)).groupBy("incident_id", "metric_name").agg(
        F.percentile("_s", F.array(F.lit(0.025), F.lit(0.975))).alias("_p"), F.stddev_samp("_s").alias("std_error"))
    point = cands.select("incident_id", "metric_name", _score(config.CAUSE_WEIGHTS).alias("point_estimate"))
    return point.join(s, ["incident_id", "metric_name"]).select(
        "incident_id", "metric_name", "point_estimate", F.col("_p")[0].alias("ci_lower"), F.col("_p")[1].alias("ci_upper"), "std_error",
        (F.col("_p")[0] > 0.05).alias("significant"))


def sensitivity(cands: DataFrame) -> DataFrame:
    """Share of sixteen weight shifts that keep the top cause of an incident."""
    base = config.CAUSE_WEIGHTS
    grids = []
    for name in base:
        for delta in (0.05, -0.05, 0.10, -0.10):
            w = dict(base)
            w[name] = max(0.01, w[name] + delta)
            total = sum(w.values())
            grids.append({k: v / total for k, v in w.items()})
    tops = [F.max_by("metric_name", F.struct(_score(w).alias("s"), -F.col("_order"))).alias(f"t{i}") for i, w in enumerate([base, *grids])]
    order = cands.withColumn("_order", F.row_number().over(W.partitionBy("incident_id").orderBy("metric_name")))
    g = order.groupBy("incident_id").agg(*tops)
    same = sum((F.col(f"t{i}") == F.col("t0")).cast("int") for i in range(1, len(grids) + 1)) / float(len(grids))
    alternatives = F.array_sort(F.filter(F.array_distinct(F.array(*[F.col(f"t{i}") for i in range(1, len(grids) + 1)])), lambda m: m != F.col("t0")))
    return g.select("incident_id", F.col("t0").alias("top_cause"), same.alias("rank_stability"),
                    F.when(same >= 0.85, "high").when(same >= 0.60, "medium").otherwise("low").alias("robustness"), alternatives.alias("alternatives"))


def candidates(inc: DataFrame, gold: DataFrame, edges: DataFrame, days: int = 14, min_z: float = 2.0) -> DataFrame:
    """Scored upstream candidates of every incident whose own anomaly is strong enough."""
    target = F.create_map(*[F.lit(x) for kv in config.INCIDENT_METRIC.items() for x in kv])
    # series windows of every metric and day, small: metrics x calendar days
    series = window_series(gold, days)
    stats = candidate_stats(series).withColumn("quality", _coverage(F.size("series"), days + 1))
    up = F.broadcast(graph_closure(edges).where("hops > 0").select(F.col("metric").alias("target"), F.col("upstream").alias("metric_name"), "proximity"))
    i = inc.select("incident_id", "metric_date", F.element_at(target, F.col("incident_type")).alias("target"))
    c = i.join(up, "target").join(stats.withColumnRenamed("series", "candidate_series"), ["metric_name", "metric_date"]) \
        .where(F.abs("zscore") >= min_z)
    c = c.join(series.select(F.col("metric_name").alias("target"), "metric_date", F.col("series").alias("target_series")), ["target", "metric_date"]) \
        .where(F.size("target_series") >= 3)
    return temporal_precedence(c).drop("candidate_series", "target_series")


def _coverage(actual: Column, expected: int) -> Column:
    share = actual / float(expected)
    return F.when(share >= 0.9, 1.0).when(share >= 0.7, 0.9).when(share >= 0.5, 0.75).otherwise(0.5)


def fallback_chain(edges: list[tuple[str, str]], metric: str, deepest: int = 4) -> list[str]:
    """The graph's account of a metric: everything upstream within ``deepest`` steps, causes before effects, the metric last.

    Causes are visited in the order of the edges, each once. A metric without
    causes is followed by its first effect instead.
    """
    causes_of: dict[str, list[str]] = {}
    for src, dst in edges:
        causes_of.setdefault(dst, []).append(src)
    chain: list[str] = []
    seen = {metric}
    trail = [(metric, iter(causes_of.get(metric, [])))]
    while trail:
        at, left = trail[-1]
        cause = next((c for c in left if c not in seen), None) if len(trail) <= deepest else None
        if cause is None:
            chain.append(at)
            trail.pop()
        else:
            seen.add(cause)
            trail.append((cause, iter(causes_of.get(cause, []))))
    return chain if len(chain) > 1 else chain + [dst for src, dst in edges if src == metric][:1]


def root_causes(inc: DataFrame, cands: DataFrame, edges: DataFrame, k: int = 5) -> DataFrame:
    """Ranked causes; incidents without a qualifying candidate get the graph's chain with decaying scores.

    The graph has at most names x names edges, so its chains (one per incident
    type) are a small table made on the driver.
    """
    ranked = rank_causes(cands, k).select("incident_id", "rank", "metric_name", "score", F.lit("statistical").alias("method"))
    target = F.create_map(*[F.lit(x) for kv in config.INCIDENT_METRIC.items() for x in kv])
    none = inc.join(ranked.select("incident_id").distinct(), "incident_id", "left_anti") \
        .select("incident_id", F.element_at(target, F.col("incident_type")).alias("target"))
    known = [(r["src"], r["dst"]) for r in edges.select("src", "dst").collect()]
    rows = [(m, i + 1, name, 0.95 if name == m else max(0.1, 0.9 - i * 0.15))
            for m in sorted(set(config.INCIDENT_METRIC.values())) for i, name in enumerate(fallback_chain(known, m))]
    chain = literal_table(inc.sparkSession, rows, "target string, rank int, metric_name string, score double")
    return ranked.unionByName(none.join(F.broadcast(chain), "target").select(
        "incident_id", "rank", "metric_name", "score", F.lit("graph").alias("method")))


def evidence_clusters(cands: DataFrame, ev: DataFrame, days: int = 14) -> DataFrame:
    """Count and amount of the events behind each (metric, end day), from daily sums per event type."""
    rows = [(m, t) for m, ts in config.METRIC_EVENTS.items() for t in ts]
    kinds = F.broadcast(literal_table(ev.sparkSession, rows, "metric_name string, event_type string"))
    daily = ev.groupBy("event_type", F.to_date("event_time").alias("d")).agg(F.count("*").alias("n"), F.sum("amount").alias("amount"), F.min("event_id").alias("first_id"))
    want = cands.select("metric_name", "metric_date").distinct().join(kinds, "metric_name") \
        .withColumn("d", F.explode(F.sequence(F.date_sub("metric_date", days), F.col("metric_date"), F.expr("interval 1 day"))))
    return want.join(daily, ["event_type", "d"]).groupBy("metric_name", "metric_date", "event_type").agg(
        F.sum("n").alias("event_count"), F.sum("amount").alias("total_amount"), F.min_by("first_id", "d").alias("sample_event_id"))


def forward_chains(edges: DataFrame, max_nodes: int = 5) -> DataFrame:
    """Simple paths from every metric to the first metric that defines an incident."""
    rows = [(m, t) for t, m in config.INCIDENT_METRIC.items()]
    kinds = literal_table(edges.sparkSession, rows, "metric string, incident_type string")
    return edges.sparkSession.sql("""
        WITH RECURSIVE walk AS (
          SELECT n AS at, array(n) AS path FROM (SELECT src AS n FROM {edges} UNION SELECT dst FROM {edges})
          UNION ALL
          SELECT e.dst, concat(w.path, array(e.dst)) FROM walk w JOIN {edges} e ON e.src = w.at
          WHERE size(w.path) < {max_nodes} AND NOT array_contains(w.path, e.dst) AND w.at NOT IN (SELECT metric FROM {kinds}))
        SELECT path[0] AS start_metric, k.incident_type, w.path FROM walk w JOIN {kinds} k ON k.metric = w.at
    """, edges=edges, kinds=kinds, max_nodes=max_nodes)


def causal_subgraph(inc: DataFrame, edges: DataFrame, status: DataFrame | None = None) -> DataFrame:
    """Edges among the ancestors of an incident's metric and their two-hop successors, with live impact."""
    target = F.create_map(*[F.lit(x) for kv in config.INCIDENT_METRIC.items() for x in kv])
    i = inc.select("incident_id", F.element_at(target, F.col("incident_type")).alias("metric"))
    core = graph_closure(edges).select("metric", F.col("upstream").alias("node"))
    one = core.join(edges.select(F.col("src").alias("node"), "dst"), "node").select("metric", F.col("dst").alias("node"))
    two = one.join(edges.select(F.col("src").alias("node"), "dst"), "node").select("metric", F.col("dst").alias("node"))
    nodes = core.union(one).union(two).distinct()
    sub = nodes.withColumnRenamed("node", "src").join(edges, "src").join(nodes.withColumnRenamed("node", "dst"), ["metric", "dst"])
    if status is not None:
        bad = status.select(F.col("metric_name").alias("dst"), F.col("status").isin("critical", "warning", "degraded").alias("_bad"))
        sub = sub.join(F.broadcast(bad), "dst", "left").withColumn("impact", F.when(F.col("_bad"), "negative").otherwise("static"))
    else:
        sub = sub.withColumn("impact", F.lit("static"))
    return i.join(F.broadcast(sub.select("metric", "src", "dst", "impact")), "metric").select("incident_id", "src", "dst", "impact")
