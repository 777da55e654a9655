"""Total orders over many ranges."""

from pyspark.sql import functions as F

from panelwise.operators import features, ordering


def test_running_totals_over_many_ranges_with_a_hot_value(spark):
    n = 1_000_000
    values = spark.range(n).select((F.col("id") * 7919 % n).cast("double").alias("v"), F.when(F.col("id") * 7919 % n == 500_000, 400_000).otherwise(1).alias("n"))
    for ascending in (True, False):
        got = ordering.running_totals(values, "v", ["n"], ascending=ascending, rows=50_000)
        below = F.col("v") + 1 if ascending else n - F.col("v")
        hot = F.when(F.col("v") >= 500_000 if ascending else F.col("v") <= 500_000, 399_999).otherwise(0)
        assert got.where((F.col("cum_n") != below + hot) | (F.col("all_n") != n + 399_999)).count() == 0
        assert got.count() == n


def test_offsets_are_nested(spark):
    sizes = spark.range(1000).select(F.col("id").cast("int").alias("_range"), (F.col("id") % 5).alias("_t_n"))
    for ascending in (True, False):
        got = {r["_range"]: (r["_o_n"], r["all_n"]) for r in ordering.range_offsets(sizes, ["n"], ascending, nest=7).collect()}
        lower = (lambda i: range(i)) if ascending else (lambda i: range(i + 1, 1000))
        assert got == {i: (sum(j % 5 for j in lower(i)), 2000) for i in range(1000)}


def test_nulls_and_empty_tables(spark):
    table = spark.createDataFrame([(None, 1), (1.0, 2), (float("nan"), 4), (2.0, 8)], "v double, n long")
    got = [r["cum_n"] for r in ordering.running_totals(table, "v", ["n"], ranges=3).orderBy("cum_n").collect()]
    assert got == [1, 3, 11, 15]
    assert ordering.running_totals(table.where("false"), "v", ["n"]).count() == 0
    assert ordering.exact_quantiles(table.where("false"), "v", [0.5]).count() == 0


def test_dense_index_follows_the_order(spark, monkeypatch):
    monkeypatch.setattr(ordering.with_range, "__defaults__", ("_range", None, 100))
    words = spark.range(5000).select(F.format_string("w%04d", F.col("id") % 1234).alias("w"))
    got = {r["w"]: r["i"] for r in ordering.dense_index(words, "w", "i", ranges=None).collect()}
    assert got == {f"w{i:04d}": i for i in range(1234)}


def test_split_does_not_depend_on_the_buckets(spark):
    rows = spark.range(3000).select("id", (F.col("id") % 3 == 0).alias("label"))
    one, many = (sorted(features.stratified_split(rows, "id", "label", rows=k).collect()) for k in (10_000, 50))
    assert one == many
    assert {r["split"] for r in one} == {"train", "valid", "test"}


def test_quantile_bins(spark):
    rows = spark.createDataFrame([(float(v),) for v in [1, 1, 1, 1, 2, 3, 4, 5]] + [(None,)], "v double")
    got = sorted((r["v"], r["v_bin"]) for r in features.quantile_bins(rows, "v", 4).collect() if r["v"] is not None)
    assert got == [(1.0, 0)] * 4 + [(2.0, 2), (3.0, 2), (4.0, 3), (5.0, 3)]  # edges 1, 1.5 and 3.25
    assert features.quantile_bins(rows, "v", 4).where("v IS NULL AND v_bin IS NULL").count() == 1
