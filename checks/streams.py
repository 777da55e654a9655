"""Streams over the events and orders tables, compared with SQL over the same rows."""

import uuid

from pyspark.sql import functions as F

from checks.business import _SUP
from checks.detect import r
from panelwise.session import shared_folder, written
from panelwise.sources.star import activity_from
from panelwise.streaming import streams, suppression
from panelwise.streaming.late import LateAware, lateness

QUERIES, SQL = {}, {}
_KIND = "CASE event_type WHEN 'purchase' THEN 'payment_received' WHEN 'error' THEN 'support_ticket_opened' WHEN 'click' THEN 'support_ticket_closed' WHEN 'signup' THEN 'customer_created' ELSE 'review_submitted' END"


def _dedup(s, d):
    ev = streams.activity_stream(s, d)
    twice = ev.select("*", F.explode(F.array(F.lit(1), F.lit(2))).alias("copy")).drop("copy")
    out = s.read.parquet(streams.run_now(streams.dedup_events(twice), "append"))
    return out.groupBy("event_type").agg(F.count("*").alias("n"), F.count_distinct("event_id").alias("ids"))


QUERIES["st1_dedup_stream"] = _dedup
SQL["st1_dedup_stream"] = f"SELECT {_KIND} AS event_type, count(*) AS n, count(DISTINCT event_id) AS ids FROM events GROUP BY 1"


def _daily(s, d):
    folder = streams.run_now(streams.daily_windows(streams.activity_stream(s, d)), "update")
    out = streams.latest_per_key(s, folder, ["w", "event_type"])
    return r(out.select(F.date_format("w.start", "yyyy-MM-dd").alias("day"), "event_type", "n", "amount"), "amount", digits=2)


QUERIES["st2_daily_stream"] = _daily
SQL["st2_daily_stream"] = f"SELECT strftime(ts, '%Y-%m-%d') AS day, {_KIND} AS event_type, count(*) AS n, round(sum(CASE WHEN event_type = 'purchase' THEN value END), 2) AS amount FROM events GROUP BY 1, 2"


def _sliding(s, d):
    folder = streams.run_now(streams.sliding_rates(streams.activity_stream(s, d)), "update")
    out = streams.latest_per_key(s, folder, ["w"])
    return r(out.select(F.date_format("w.start", "yyyy-MM-dd").alias("first_day"), "opened", "closed", "revenue"), "revenue", digits=2)


QUERIES["st3_sliding_stream"] = _sliding
SQL["st3_sliding_stream"] = """WITH w AS (SELECT DISTINCT CAST(ts AS DATE) - CAST(i AS INTEGER) AS s FROM events, range(7) t(i))
SELECT strftime(s, '%Y-%m-%d') AS first_day, count(*) FILTER (event_type = 'error') AS opened, count(*) FILTER (event_type = 'click') AS closed, round(sum(value) FILTER (event_type = 'purchase'), 2) AS revenue
FROM w JOIN events ON CAST(ts AS DATE) BETWEEN s AND s + 6 GROUP BY s"""


def _suppress(s, d):
    e = streams.table_stream(s, d, "events").where("event_type = 'error'")
    alerts = e.select(F.col("event_id").alias("alert_id"), (F.col("user_id") % 25).alias("monitor_id"), F.col("ts").cast("timestamp").alias("triggered_at"))
    out = s.read.parquet(streams.run_now(streams.suppress_stream(alerts), "append"))
    return out.select("alert_id", "monitor_id")


QUERIES["st4_suppress_stream"] = _suppress
SQL["st4_suppress_stream"] = f"WITH RECURSIVE {_SUP} SELECT id AS alert_id, mon AS monitor_id FROM fo WHERE NOT sup"


def _late(s, d):
    o = streams.table_stream(s, d, "orders").select(
        F.col("o_orderkey").alias("event_id"), F.col("o_orderdate").cast("timestamp").alias("event_time"),
        F.date_add(F.to_date("o_orderdate"), (F.col("o_orderkey") % 40).cast("int")).cast("timestamp").alias("ingested_at"))
    folder = streams.run_now(o, "append", streams.split_late)
    return s.read.parquet(folder).groupBy("band").agg(F.count("*").alias("n"))


QUERIES["st5_late_split"] = _late
SQL["st5_late_split"] = "SELECT CASE WHEN o_orderkey % 40 < 1 THEN 'same_day' WHEN o_orderkey % 40 < 7 THEN 'week' WHEN o_orderkey % 40 < 30 THEN 'month' ELSE 'late' END AS band, count(*) AS n FROM orders GROUP BY 1"

# --- late rows, repeats and restarts: events arrive in six parts, in order but for every 7th (one part later) and every 29th (at the very end);
# every 5th comes a second time in the next part. Each part is one run of the stream from its checkpoint.

PARTS, DELAY_DAYS = 6, 2
_FIELDS = ["event_id", "event_type", "event_time", "amount"]


def _quarter(df, at, shift=0):
    """Number (0 to 3) of the quarter of the table's time span that a time, moved by ``shift``, lies in."""
    lo, hi = df.agg(F.min(at), F.max(at)).first()
    return F.floor((at + shift - F.lit(lo)) * 4 / F.lit(hi - lo + 1)) if lo is not None else F.lit(0)


def _arrivals(s, d):
    """(part, event) of both deliveries."""
    ev = activity_from(s.read.parquet(f"{d}/events.parquet")).select(*_FIELDS)
    number = F.regexp_extract("event_id", r"(\d+)$", 1).cast("long")
    quarter = _quarter(ev, F.unix_micros("event_time"))
    part = F.when(number % 29 == 0, PARTS - 1).otherwise(quarter + F.when(number % 7 == 0, 1).otherwise(0)).cast("int")
    twice = F.when(number % 5 == 0, F.array(part, F.least(part + 1, F.lit(PARTS - 1)))).otherwise(F.array(part))
    return ev.select(F.explode(twice).alias("part"), *_FIELDS)


def _followed(s, d):
    """The tables of a stream that was stopped and started again after every part."""
    root = f"{shared_folder(s)}/late-{uuid.uuid4().hex}"
    arrivals = written(_arrivals(s, d), "arrivals")
    table = LateAware(s, root, arrivals.drop("part").schema, DELAY_DAYS, ("event_type",), {"n": lambda: F.count("*"), "amount": lambda: F.sum("amount")},
                      keys=("event_id",), compact=4)
    for part in range(PARTS):
        arrivals.where(F.col("part") == part).drop("part").write.mode("append").parquet(f"{root}/source")
        table.run(s.readStream.schema(table.schema).parquet(f"{root}/source"))
    return table


QUERIES["st1_dedup_late"] = lambda s, d: _followed(s, d).rows().groupBy("event_type", "late").agg(F.count("*").alias("n"), F.count_distinct("event_id").alias("ids"))
QUERIES["st2_daily_late"] = lambda s, d: r(_followed(s, d).daily().select(F.date_format("day", "yyyy-MM-dd").alias("day"), "event_type", "n", "amount", "n_late"), "amount", digits=2)
QUERIES["st3_sliding_late"] = lambda s, d: r(_followed(s, d).sliding(7).select(F.date_format("first_day", "yyyy-MM-dd").alias("first_day"), "event_type", "n", "amount", "n_late"), "amount", digits=2)
QUERIES["st5_late_side_table"] = lambda s, d: _followed(s, d).late().groupBy("batch", lateness().alias("band")).agg(
    F.count("*").alias("n"), F.max("behind_us").alias("most_behind_us"))
_TWICE = f"""e AS (SELECT event_id AS id, {_KIND} AS event_type, ts, CASE WHEN event_type = 'purchase' THEN value END AS amount, epoch_us(ts) AS t FROM events), b AS (SELECT min(t) AS lo, max(t) AS hi FROM e),
p AS (SELECT e.*, CASE WHEN id % 29 = 0 THEN {PARTS - 1} ELSE (t - lo) * 4 // (hi - lo + 1) + CASE WHEN id % 7 = 0 THEN 1 ELSE 0 END END AS part FROM e, b),
m AS (SELECT part, max(t) AS high FROM p GROUP BY part),
k AS (SELECT p.*, (SELECT max(high) FROM m WHERE m.part < p.part) - {DELAY_DAYS} * 86400000000 AS mark FROM p),
l AS (SELECT *, coalesce(t < mark, false) AS late, CASE WHEN t < mark THEN mark - t ELSE 0 END AS behind FROM k)"""
SQL["st1_dedup_late"] = f"WITH {_TWICE} SELECT event_type, late, count(*) AS n, count(DISTINCT id) AS ids FROM l GROUP BY ALL"
SQL["st2_daily_late"] = f"WITH {_TWICE} SELECT strftime(ts, '%Y-%m-%d') AS day, event_type, count(*) AS n, round(sum(amount), 2) AS amount, count(*) FILTER (late) AS n_late FROM l GROUP BY 1, 2"
SQL["st3_sliding_late"] = f"""WITH {_TWICE}, w AS (SELECT *, unnest(range(7)) AS i FROM l)
SELECT strftime(CAST(ts AS DATE) - CAST(i AS INTEGER), '%Y-%m-%d') AS first_day, event_type, count(*) AS n, round(sum(amount), 2) AS amount, count(*) FILTER (late) AS n_late FROM w GROUP BY 1, 2"""
SQL["st5_late_side_table"] = f"""WITH {_TWICE} SELECT part::INT AS batch, CASE WHEN behind < 86400000000 THEN 'same_day' WHEN behind < 7 * 86400000000 THEN 'week' WHEN behind < 30 * 86400000000 THEN 'month' ELSE 'older' END AS band,
  count(*) AS n, max(behind)::BIGINT AS most_behind_us FROM l WHERE late GROUP BY 1, 2"""


def _timers(s, d):
    """Alerts of 25 monitors, one of which has a third of them, in four parts with neighbours out of order; a heartbeat closes the last buckets."""
    root = f"{shared_folder(s)}/alerts-{uuid.uuid4().hex}"
    at = F.unix_micros(F.col("ts").cast("timestamp"))
    alerts = s.read.parquet(f"{d}/events.parquet").where("event_type = 'error'").select(
        F.col("event_id").alias("alert_id"), F.when(F.col("event_id") % 3 == 0, 0).otherwise(F.col("user_id") % 25).cast("long").alias("monitor_id"), F.col("ts").cast("timestamp").alias("triggered_at"), at.alias("t"))
    late = F.when(F.col("alert_id") % 10 == 0, 36e8).otherwise(0).cast("long")  # arrives an hour later than it happened
    cut = written(alerts.withColumn("part", F.least(_quarter(alerts, F.col("t"), late), F.lit(3).cast("long"))), "alerts")
    beat = cut.agg(F.lit(None).cast("long").alias("alert_id"), F.lit(None).cast("long").alias("monitor_id"), (F.max("triggered_at") + F.expr("INTERVAL 10 DAYS")).alias("triggered_at"))
    source = f"{root}/source"
    for part in range(5):
        rows = cut.where(F.col("part") == part).select("alert_id", "monitor_id", "triggered_at") if part < 4 else beat
        rows.write.mode("append").parquet(source)
        suppression.run(s.readStream.schema("alert_id long, monitor_id long, triggered_at timestamp").parquet(source), root)
    return suppression.emitted(s, root).select("alert_id", "monitor_id")


QUERIES["st4_suppress_timers"] = _timers
SQL["st4_suppress_timers"] = """WITH RECURSIVE a AS (SELECT CASE WHEN event_id % 3 = 0 THEN 0 ELSE user_id % 25 END AS mon, event_id AS id, epoch_us(ts) AS t FROM events WHERE event_type = 'error'),
f AS (SELECT mon, min(t) AS t FROM a GROUP BY mon UNION ALL SELECT f.mon, (SELECT min(t) FROM a WHERE a.mon = f.mon AND a.t >= f.t + 14400000000) FROM f WHERE f.t IS NOT NULL)
SELECT min(id) AS alert_id, mon AS monitor_id FROM a JOIN f USING (mon, t) GROUP BY mon, t"""
