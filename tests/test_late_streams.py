"""Streams over several files, batches and restarts: late rows, repeats, replays, suppression with timers."""

import datetime as dt
import random
import tempfile

from pyspark.sql import functions as F

from panelwise.operators import monitors
from panelwise.streaming import suppression
from panelwise.streaming.late import LateAware, lateness

ROW = "event_id long, event_type string, event_time timestamp, amount double"
START = dt.datetime(2024, 1, 1)


def parts_of(rng, n=400):
    """Five arrivals of events over 20 days: in order, out of order, very late, repeated, without a time."""
    parts = [[] for _ in range(5)]
    for i in range(n):
        day = i * 20 / n
        at = START + dt.timedelta(days=day, seconds=i)
        part = min(4, int(day // 4) + (1 if i % 7 == 0 else 0)) if i % 29 else 4
        row = (i, "ab"[i % 2], at if i != 33 else None, float(i))
        parts[part].append(row)
        if i % 5 == 0 and i != 33:
            parts[min(4, part + 1)].append(row)
    for p in parts:
        rng.shuffle(p)
    return parts


def late_table(spark, keys=("event_id",), compact=2):
    root = tempfile.mkdtemp(prefix="late-")
    schema = spark.createDataFrame([], ROW).schema
    return LateAware(spark, root, schema, 2.0, ("event_type",), {"n": lambda: F.count("*"), "amount": lambda: F.sum("amount")}, keys=keys, compact=compact)


def expected(parts, delay=dt.timedelta(days=2)):
    seen, late, high = {}, set(), None
    for part in parts:
        mark = None if high is None else high - delay
        for row in part:
            if row[0] not in seen:
                seen[row[0]] = row
                if row[2] is None or (mark is not None and row[2] < mark):
                    late.add(row[0])
        times = [r[2] for r in part if r[2] is not None and seen[r[0]] is r]
        high = max([high, *times] if high else times)
    return seen, late


def test_on_time_and_late_are_everything_over_restarts(spark):
    parts = parts_of(random.Random(1))
    table = late_table(spark)
    source = f"{table.root}/source"
    for part in parts:  # every run is a restart from the checkpoint
        spark.createDataFrame(part, ROW).write.mode("append").parquet(source)
        table.run(spark.readStream.schema(table.schema).parquet(source))
    seen, late = expected(parts)
    assert len(late) > 10
    got = {r["event_id"]: r["late"] for r in table.rows().collect()}
    assert table.rows().count() == len(got) and set(got) == set(seen)
    assert {i for i, x in got.items() if x} == late == {r["event_id"] for r in table.late().collect()}
    days = {}
    for i, (_, kind, at, amount) in seen.items():
        cell = days.setdefault((at and at.date(), kind), [0, 0.0, 0])
        cell[0], cell[1], cell[2] = cell[0] + 1, cell[1] + amount, cell[2] + (i in late)
    assert {(r["day"], r["event_type"]): [r["n"], r["amount"], r["n_late"]] for r in table.daily().collect()} == days
    assert table.marks().agg(F.sum("n")).first()[0] == len(seen)
    week = {(r["first_day"], r["event_type"]): r["n"] for r in table.sliding(7).collect()}
    for (first, kind), n in week.items():
        assert n == sum(c[0] for (d, k), c in days.items() if d and k == kind and 0 <= (d - first).days < 7)
    bands = {r["band"]: r["count"] for r in table.late().withColumn("band", lateness()).groupBy("band").count().collect()}
    assert bands["no_time"] == 1 and sum(bands.values()) == len(late)


def test_many_batches_in_one_run_and_a_replay(spark):
    parts = parts_of(random.Random(2))
    table = late_table(spark)
    for batch, part in enumerate(parts):
        df = spark.createDataFrame(part, ROW)
        table.take(df, batch)
        if batch in (0, 1, 3):  # the batch is replayed after a failure
            table.take(df, batch)
    seen, late = expected(parts)
    assert table.rows().count() == len(seen) and table.late().count() == len(late)
    assert table.daily().agg(F.sum("n"), F.sum("n_late")).first() == (len(seen), len(late))


def test_without_keys_repeats_count(spark):
    table = late_table(spark, keys=())
    parts = parts_of(random.Random(3), 60)
    for batch, part in enumerate(parts):
        table.take(spark.createDataFrame(part, ROW), batch)
    assert table.rows().count() == sum(map(len, parts))


def test_suppression_of_one_hot_monitor_over_batches_equals_the_batch_operator(spark):
    rng = random.Random(6)
    rows, t = [], 1_700_000_000
    for i in range(360):
        t += rng.choice([0, 60, 1800, 7200, 40000])
        rows.append((i, 1 if i % 40 else 2, t))
    root = tempfile.mkdtemp(prefix="alerts-")
    schema = "alert_id long, monitor_id long, s long"
    whole = spark.createDataFrame(rows, schema).withColumn("triggered_at", F.timestamp_seconds("s"))
    source = f"{root}/source"
    cut = [rows[i:i + 90] for i in range(0, 360, 90)]
    for a, b in zip(cut, cut[1:]):  # some alerts change places across files, inside the delay
        if b[0][2] - a[-1][2] < 40000:
            a[-1], b[0] = b[0], a[-1]
    beat = (None, None, t + 10 * 86400)  # a heartbeat without a monitor closes the last buckets
    for part in (*cut, [beat]):
        rng.shuffle(part)
        spark.createDataFrame(part, schema).withColumn("triggered_at", F.timestamp_seconds("s")).drop("s").write.mode("append").parquet(source)
        stream = spark.readStream.schema("alert_id long, monitor_id long, triggered_at timestamp").parquet(source)
        suppression.run(stream, root, 4)
    got = sorted(r["alert_id"] for r in suppression.emitted(spark, root).collect())
    want = sorted(r["alert_id"] for r in monitors.suppress(whole, 4).where("NOT suppressed").collect())
    assert got == want
