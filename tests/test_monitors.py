"""Alert suppression on one monitor that holds nearly all alerts, and on equal and null times."""

import random

from pyspark.sql import functions as F

from panelwise.operators import monitors


def test_suppression_against_a_fold(spark):
    rng = random.Random(2)
    rows, t = [], 0
    for i in range(1500):
        t += rng.choice([0, 60, 1800, 7200, 40000])
        rows.append((i, 1 if i % 50 else 2, t))
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, "alert_id long, monitor_id long, s long").withColumn("triggered_at", F.timestamp_seconds("s"))
    got = {r["alert_id"]: r["suppressed"] for r in monitors.suppress(df, 4).collect()}
    last = {}
    for i, m, s in sorted(rows, key=lambda r: (r[2], r[0])):
        emit = m not in last or s - last[m] >= 4 * 3600
        if emit:
            last[m] = s
        assert got[i] == (not emit), (i, m, s)


def test_suppression_of_nothing_and_of_null_times(spark):
    df = spark.createDataFrame([(1, 1, None)], "alert_id long, monitor_id long, triggered_at timestamp")
    assert monitors.suppress(df.where("false")).count() == 0
    assert [r["suppressed"] for r in monitors.suppress(df).collect()] == [True]
