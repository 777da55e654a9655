"""Joins, features, text functions, splits and evaluation."""

from pyspark.sql import functions as F

from checks.detect import r, text_date
from checks.shared import keep
from panelwise.functions import scalar
from panelwise.operators import evaluation, features, reports
from panelwise.sources import star

QUERIES, SQL = {}, {}


def add(name, fn, sql=None):
    QUERIES[name] = fn
    if sql:
        SQL[name] = sql


t = star.table


def items(s, d):
    return t(s, d, "lineitem").select(F.col("l_orderkey").alias("order_id"), F.col("l_extendedprice").alias("price"), (F.col("l_extendedprice") * F.col("l_tax")).alias("freight"))


def panel_orders(s, d):
    first = star.shipped_lines(s, d).groupBy("l_orderkey").agg(F.min("l_shipdate").alias("delivered_at"))
    o = t(s, d, "orders").join(first, F.col("o_orderkey") == F.col("l_orderkey"), "left")
    day, arrived = F.to_date("o_orderdate"), F.to_date("delivered_at")
    return o.select(F.col("o_orderkey").alias("order_id"), F.col("o_custkey").alias("customer_id"), day.alias("day"), arrived.alias("delivered_day"),
                    ((F.unix_micros(F.col("delivered_at").cast("timestamp")) - F.unix_micros(F.col("o_orderdate").cast("timestamp"))) / 86400e6).alias("delivery_days"),
                    (F.datediff(arrived, day) > 365).cast("int").alias("late"))


def panel_reviews(s, d):
    return star.support_panel_events(s, d).where("event_type = 'review_submitted'").select(F.to_date("event_time").alias("day"), F.col("attributes.score").alias("score"))


_PD = ["mean_value", "std_value", "product_revenue", "mean_price", "freight", "mean_freight", "mean_delivery_days", "std_delivery_days", "max_delivery_days", "late_rate", "review_score", "review_std"]
_PW = [f"{c}_{k}_{n}" for c in ("orders", "revenue") for k in ("mean", "std") for n in (7, 14, 30)]
_PL = [f"{c}_lag_{n}" for c in ("orders", "revenue") for n in (1, 7)]
_PC = ["orders", "customers", "revenue", "delivered", "late_count", "reviews", "dow", "day_of_month", "month", *_PD, *_PW, *_PL]
_PF = ["revenue", *_PD, *_PW, "revenue_lag_1", "revenue_lag_7"]
add("g18_order_panel", lambda s, d: r(text_date(features.order_panel(panel_orders(s, d), items(s, d), panel_reviews(s, d)), "day"), *_PF, digits=5).select("day", *_PC),
    f"""WITH v AS (SELECT l_orderkey AS k, sum(l_extendedprice) AS price, sum(l_extendedprice * l_tax) AS freight FROM lineitem GROUP BY 1),
sh AS (SELECT o_orderkey AS k, min(l_shipdate) AS da FROM lineitem JOIN orders ON l_orderkey = o_orderkey WHERE l_shipdate >= o_orderdate GROUP BY 1),
o AS (SELECT o_orderdate::DATE AS day, o_custkey AS c, price, freight, price + freight AS total, da::DATE AS dd, epoch_us(da - o_orderdate) / 86400e6::DOUBLE AS dt, (da::DATE - o_orderdate::DATE > 365)::INT AS late
  FROM orders LEFT JOIN v ON k = o_orderkey LEFT JOIN sh ON sh.k = o_orderkey),
dy AS (SELECT day, count(*) AS orders, count(DISTINCT c) AS customers, sum(total) AS revenue, avg(total) AS mean_value, stddev_samp(total) AS std_value, sum(price) AS product_revenue, avg(price) AS mean_price,
  sum(freight) AS freight, avg(freight) AS mean_freight FROM o GROUP BY 1),
de AS (SELECT dd AS day, count(*) AS delivered, avg(dt) AS mean_delivery_days, stddev_samp(dt) AS std_delivery_days, max(dt) AS max_delivery_days, sum(late)::BIGINT AS late_count, avg(late) AS late_rate FROM o WHERE dd IS NOT NULL GROUP BY 1),
re AS (SELECT o_orderdate::DATE AS day, avg(1 + o_custkey % 5) AS review_score, stddev_samp(1 + o_custkey % 5) AS review_std, count(*) AS reviews FROM orders WHERE o_orderpriority = '3-MEDIUM' GROUP BY 1),
x AS (SELECT dy.* EXCLUDE (revenue), coalesce(revenue, 0) AS revenue, isodow(day) - 1 AS dow, day(day) AS day_of_month, month(day) AS month, {", ".join(f"coalesce({c}, 0) AS {c}" for c in ("delivered", "mean_delivery_days", "std_delivery_days", "max_delivery_days", "late_count", "late_rate", "reviews", "review_std"))},
  coalesce(last_value(review_score IGNORE NULLS) OVER (ORDER BY day), 0) AS review_score FROM dy LEFT JOIN de USING (day) LEFT JOIN re USING (day)),
y AS (SELECT *, {", ".join(f"avg({c}) OVER (ORDER BY day ROWS {n - 1} PRECEDING) AS {c}_mean_{n}, stddev_samp({c}) OVER (ORDER BY day ROWS {n - 1} PRECEDING) AS {c}_std_{n}" for c in ("orders", "revenue") for n in (7, 14, 30))},
  {", ".join(f"lag({c}, {n}) OVER (ORDER BY day) AS {c}_lag_{n}" for c in ("orders", "revenue") for n in (1, 7))} FROM x)
SELECT strftime(day, '%Y-%m-%d') AS day, {", ".join(f"round(coalesce({c}, 0), 5)::DOUBLE AS {c}" if c in _PF else f"coalesce({c}, 0) AS {c}" for c in _PC)} FROM y""")


def order_star(s, d):
    """Orders with their items, customers, sellers and products; late when the last item ships over 900 days after the order."""
    return keep(("star", d), lambda: _order_star(s, d))


def _order_star(s, d):
    lines = star.shipped_lines(s, d)
    li = lines.select(
        F.col("l_orderkey").alias("order_id"), F.concat_ws("-", "l_linenumber", "l_partkey", "l_suppkey", F.unix_date(F.to_date("l_shipdate"))).alias("item_no"), F.col("l_extendedprice").alias("price"),
        (F.col("l_extendedprice") * 0.1).alias("freight"), F.col("l_linenumber").alias("installments"), F.col("l_suppkey").alias("seller_id"), F.col("l_partkey").alias("product_id"))
    due = F.col("ordered_at") + F.expr("interval 900 days")
    o = lines.groupBy(F.col("l_orderkey").alias("order_id")).agg(F.max("l_shipdate").alias("delivered_at")) \
        .join(t(s, d, "orders"), F.col("order_id") == F.col("o_orderkey")) \
        .select("order_id", F.col("o_custkey").alias("customer_id"), F.col("o_orderdate").alias("ordered_at"), F.col("o_orderpriority").alias("priority"), F.col("o_orderpriority").alias("payment_type"), "delivered_at") \
        .withColumn("estimated_at", due).withColumn("delivery_days", (F.unix_micros(F.col("delivered_at").cast("timestamp")) - F.unix_micros(F.col("ordered_at").cast("timestamp"))) / 86400e6) \
        .withColumn("late", (F.col("delivered_at") > F.col("estimated_at")).cast("int")).drop("delivered_at")
    c = t(s, d, "customer").select(F.col("c_custkey").alias("customer_id"), F.col("c_nationkey").alias("customer_region"), (F.col("c_nationkey") * 10 + F.col("c_custkey") % 10).alias("customer_area"))
    sup = t(s, d, "supplier").select(F.col("s_suppkey").alias("seller_id"), F.col("s_nationkey").alias("seller_region"), (F.col("s_nationkey") * 10 + F.col("s_suppkey") % 10).alias("seller_area"))
    k = F.col("p_partkey")
    p = t(s, d, "part").select(k.alias("product_id"), F.col("p_type").alias("category"), F.col("p_size").cast("double").alias("weight"), (k % 40 + 1).cast("double").alias("length"),
                               (k % 7 + 1).cast("double").alias("height"), (k % 5 + 1).cast("double").alias("width"))
    return features.order_star(o, li, c, sup, p)


def _places(s, d):
    """Positions of areas, derived from the nation keys; areas of every seventh nation are unknown."""
    c = t(s, d, "customer").where("c_nationkey % 7 <> 3")
    return c.select((F.col("c_nationkey") * 10 + F.col("c_custkey") % 10).alias("area"), (F.col("c_nationkey") * 3.0 - 30 + F.col("c_custkey") % 10 * 0.1).alias("lat"),
                    (F.col("c_nationkey") * 5.0 - 60 + F.col("c_custkey") % 4 * 0.1).alias("lng"))


_STAR = """sl AS (SELECT *, l_linenumber || '-' || l_partkey || '-' || l_suppkey || '-' || date_diff('day', DATE '1970-01-01', l_shipdate::DATE) AS ino FROM lineitem JOIN orders ON l_orderkey = o_orderkey
  LEFT JOIN part ON p_partkey = l_partkey WHERE l_shipdate >= o_orderdate),
ag AS (SELECT l_orderkey AS k, count(*) AS n_items, sum(l_extendedprice) AS price, sum(l_extendedprice * .1::DOUBLE) AS freight, avg(l_extendedprice) AS mean_item_price, max(l_linenumber) AS installments, arg_min(l_suppkey, ino) AS seller_id, arg_min(l_partkey, ino) AS product_id,
  arg_min(p_type, ino) AS category, avg(p_size) AS weight, avg(l_partkey % 40 + 1) AS length, avg(l_partkey % 7 + 1) AS height, avg(l_partkey % 5 + 1) AS width, max(l_shipdate) AS delivered_at FROM sl GROUP BY 1),
sr AS (SELECT o_orderkey AS order_id, o_custkey AS customer_id, o_orderdate AS ordered_at, o_orderpriority AS priority, ag.* EXCLUDE (k), c_nationkey AS customer_region, s_nationkey AS seller_region, c_nationkey * 10 + c_custkey % 10 AS customer_area, s_nationkey * 10 + s_suppkey % 10 AS seller_area,
  (delivered_at > o_orderdate + INTERVAL 900 DAY)::INT AS late, epoch_us(delivered_at - o_orderdate) / 86400e6::DOUBLE AS delivery_days
  FROM ag JOIN orders ON k = o_orderkey LEFT JOIN customer ON c_custkey = o_custkey LEFT JOIN supplier ON s_suppkey = seller_id)"""
_SC = ["order_id", "n_items", "installments", "seller_id", "product_id", "customer_region", "seller_region", "category", "late"]
_SF = ["price", "freight", "mean_item_price", "weight", "length", "height", "width", "delivery_days"]
add("j1_order_star", lambda s, d: r(order_star(s, d).select(*_SC, *_SF), *_SF, digits=5),
    f"WITH {_STAR} SELECT {', '.join(_SC)}, {', '.join(f'round({c}, 5) AS {c}' for c in _SF)} FROM sr")
_L1I = ["dow", "month", "hour", "weekend", "month_end", "n_items", "installments", "payment_code", "customer_region_code", "seller_region_code", "same_region", "category_code", "seller_orders", "daily_orders", "seller_daily_orders"]
_L1 = [c for c in features.DELIVERY if c not in _L1I]


def _rank(c):
    return f"dense_rank() OVER (ORDER BY coalesce({c}::VARCHAR, 'unknown')) - 1"


def _l1_sql(seller, category, on):
    return f"""WITH {_STAR}, pl AS (SELECT c_nationkey * 10 + c_custkey % 10 AS area, avg(c_nationkey * 3.0::DOUBLE - 30 + c_custkey % 10 * .1::DOUBLE) AS lat, avg(c_nationkey * 5.0::DOUBLE - 60 + c_custkey % 4 * .1::DOUBLE) AS lng FROM customer WHERE c_nationkey % 7 <> 3 GROUP BY 1),
km AS (SELECT sr.*, ordered_at::DATE AS dd, 2 * 6371.0::DOUBLE * asin(sqrt(least(1, pow(sin(radians(b.lat - a.lat) / 2), 2) + cos(radians(a.lat)) * cos(radians(b.lat)) * pow(sin(radians(b.lng - a.lng) / 2), 2)))) AS km
  FROM sr LEFT JOIN pl a ON a.area = customer_area LEFT JOIN pl b ON b.area = seller_area),
md AS (SELECT quantile_cont(km, .5) AS mk, quantile_cont(delivery_days, .5) AS mt FROM km), {seller}, {category}, da AS (SELECT dd, count(*) AS daily_orders FROM km GROUP BY 1), sd AS (SELECT seller_id, dd, count(*) AS seller_daily_orders FROM km GROUP BY 1, 2),
x AS (SELECT order_id, CAST(isodow(ordered_at) - 1 AS INTEGER) AS dow, CAST(month(ordered_at) AS INTEGER) AS month, CAST(hour(ordered_at) AS INTEGER) AS hour, 900.0::DOUBLE AS days_until_estimated, (isodow(ordered_at) >= 6)::INT AS weekend, (last_day(ordered_at::DATE) - ordered_at::DATE <= 2)::INT AS month_end,
  n_items, price + freight AS total_amount, freight, mean_item_price, freight / (price + .01::DOUBLE) AS freight_ratio, installments, {_rank("priority")} AS payment_code, {_rank("customer_region")} AS customer_region_code, {_rank("seller_region")} AS seller_region_code,
  coalesce(km, mk) AS distance_km, coalesce(customer_region = seller_region, false)::INT AS same_region, {_rank("category")} AS category_code, weight, length, length * height * width AS volume, seller_mean_delivery_days, seller_late_rate, seller_orders, category_late_rate, 900 - mt AS buffer_days,
  daily_orders, seller_daily_orders, (price + freight) / greatest(weight, 1) AS price_per_gram FROM km JOIN da USING (dd) JOIN sd USING (seller_id, dd) LEFT JOIN hs USING (seller_id{on}) LEFT JOIN ca USING (category{on}), md)
SELECT order_id, {", ".join(_L1I)}, {", ".join(f"round({c}, 6)::DOUBLE AS {c}" for c in _L1)} FROM x"""


def _delivery(s, d, as_of):
    return r(features.delivery_features(features.with_distance(order_star(s, d), _places(s, d)), as_of).select("order_id", *features.DELIVERY), *_L1, digits=6)


add("l1_delivery_features", lambda s, d: _delivery(s, d, False),
    _l1_sql("hs AS (SELECT seller_id, avg(late) AS seller_late_rate, count(*) AS seller_orders, avg(delivery_days) AS seller_mean_delivery_days FROM km GROUP BY 1)", "ca AS (SELECT category, avg(late) AS category_late_rate FROM km GROUP BY 1)", ""))
_PAST = "ORDER BY dd ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING"
add("l1_delivery_features_as_of", lambda s, d: _delivery(s, d, True),
    _l1_sql(f"""pd AS (SELECT seller_id, dd, sum(late) AS l, sum(delivery_days) AS t, count(*) AS n FROM km GROUP BY 1, 2),
hs AS (SELECT seller_id, dd, sum(l) OVER w / sum(n) OVER w AS seller_late_rate, sum(t) OVER w / sum(n) OVER w AS seller_mean_delivery_days, coalesce(sum(n) OVER w, 0)::BIGINT AS seller_orders FROM pd WINDOW w AS (PARTITION BY seller_id {_PAST}))""",
            f"""pc AS (SELECT category, dd, sum(late) AS l, count(*) AS n FROM km GROUP BY 1, 2), ca AS (SELECT category, dd, sum(l) OVER w / sum(n) OVER w AS category_late_rate FROM pc WINDOW w AS (PARTITION BY category {_PAST}))""", ", dd"))


def _rfm(s, d):
    o = order_star(s, d).join(
        star.shipped_lines(s, d).groupBy(F.col("l_orderkey").alias("order_id")).agg(F.min(F.datediff("l_shipdate", "o_orderdate")).alias("first_days"), F.count_distinct("l_partkey").alias("n_categories")), "order_id")
    return features.rfm_features(o.select("customer_id", "ordered_at", F.col("price").alias("amount"), "installments", F.when(F.col("order_id") % 4 != 0, 1 + F.col("order_id") % 5).alias("review_score"),
                                          F.col("first_days").alias("delivery_days"), "late", "n_items", "n_categories"))


_RF = ["monetary", "log_monetary", "mean_order", "purchase_rate", "mean_review", "delivery_days", "late_rate", "mean_installments"]
_RI = ["recency_days", "frequency", "recency_squared", "recency_frequency", "lifespan_days", "late_orders", "diversity", "items", "complaints", "churned"]
add("l2_rfm_features", lambda s, d: r(_rfm(s, d).select("customer_id", *_RI, *_RF), *_RF, digits=5),
    f"""WITH {_STAR}, dl AS (SELECT l_orderkey AS order_id, min(date_diff('day', o_orderdate::DATE, l_shipdate::DATE)) AS dd, count(DISTINCT l_partkey) AS nc FROM sl GROUP BY 1),
sp AS (SELECT customer_id, epoch(min(ordered_at)) AS a, epoch(max(ordered_at)) AS b FROM sr GROUP BY 1 HAVING count(*) >= 2),
x AS (SELECT sr.*, dd, nc, (a + b) / 2 AS mid, epoch(ordered_at) AS e, CASE WHEN order_id % 4 <> 0 THEN 1 + order_id % 5 END AS rs FROM sr JOIN dl USING (order_id) JOIN sp USING (customer_id)),
g AS (SELECT customer_id, count(*) FILTER (e <= mid) AS frequency, sum(price) FILTER (e <= mid) AS monetary, avg(price) FILTER (e <= mid) AS mean_order, coalesce(avg(rs) FILTER (e <= mid), 3) AS mean_review, coalesce(avg(dd) FILTER (e <= mid), 0) AS delivery_days,
  coalesce(sum(late) FILTER (e <= mid), 0)::BIGINT AS late_orders, coalesce(avg(late) FILTER (e <= mid), 0) AS late_rate, coalesce(avg(installments) FILTER (e <= mid), 0) AS mean_installments, coalesce(sum(nc) FILTER (e <= mid), 0)::BIGINT AS diversity,
  coalesce(sum(n_items) FILTER (e <= mid), 0)::BIGINT AS items, count(*) FILTER (e <= mid AND rs <= 2) AS complaints, floor((any_value(mid) - max(e) FILTER (e <= mid)) / 86400)::BIGINT AS recency_days,
  greatest(floor((max(e) FILTER (e <= mid) - min(e) FILTER (e <= mid)) / 86400)::BIGINT, 1) AS lifespan_days, (count(*) FILTER (e > mid) = 0)::INT AS churned FROM x GROUP BY 1),
y AS (SELECT *, ln(1 + monetary) AS log_monetary, recency_days * recency_days AS recency_squared, recency_days * frequency AS recency_frequency, frequency / lifespan_days AS purchase_rate FROM g)
SELECT customer_id, {", ".join(_RI)}, {", ".join(f"round({c}, 5)::DOUBLE AS {c}" for c in _RF)} FROM y""")


def _cycle(key, values):
    """A text category picked by a number."""
    return F.element_at(F.array(*[F.lit(v) for v in values]), (key % len(values) + 1).cast("int"))


def _case(key, codes):
    """The SQL twin of ``_cycle`` with the values' codes."""
    return "CASE " + " ".join(f"WHEN {key} % {len(codes)} = {i} THEN {c}" for i, c in enumerate(codes)) + " END"


_YN = ("partner", "dependents", "phone", "paperless", "lines", *features.SERVICES)


def _telco(s, d):
    k, n = F.col("c_custkey"), F.col("c_nationkey")
    c = t(s, d, "customer").select(
        k.alias("customer_id"), _cycle(k, ["Male", "Female", "Other"]).alias("gender"), (k % 7 == 0).cast("int").alias("senior"),
        *[_cycle(k + i * n, ["Yes", "No", "No internet service"]).alias(c) for i, c in enumerate(_YN)], _cycle(n, ["DSL", "Fiber optic", "No"]).alias("internet"),
        _cycle(k + n, ["Month-to-month", "One year", "Two year", "other"]).alias("contract"), _cycle(k * 3 + n, [*features.PAYMENTS.values(), "cash"]).alias("payment"),
        (k % 72).alias("tenure"), (F.abs("c_acctbal") / 100).alias("monthly_charges"), F.when(k % 72 > 0, F.abs("c_acctbal")).alias("total_charges"))
    return features.telco_features(c)


_TF = ["monthly_charges", "total_charges", "charges_per_tenure", "charges_ratio"]
_TSQL = {"gender_code": _case("k", (1, 0, 0)), "senior_code": "(k % 7 = 0)::INT", **{f"{c}_code": _case(f"(k + {i} * n)", (1, 0, 0)) for i, c in enumerate(_YN)},
         **{c: _case("n", [int(i == j) for j in range(3)]) for i, c in enumerate(features.INTERNET)}, "contract_code": _case("(k + n)", (0, 1, 2, 0)),
         **{c: _case("(k * 3 + n)", [int(i == j) for j in range(5)]) for i, c in enumerate(features.PAYMENTS)}, "tenure": "(k % 72)::DOUBLE", "monthly_charges": "b / 100",
         "total_charges": "CASE WHEN k % 72 > 0 THEN b ELSE 0 END"}
add("l3_telco_features", lambda s, d: r(_telco(s, d).select("customer_id", *features.TELCO), *_TF, digits=9),
    f"""WITH c AS (SELECT c_custkey AS k, c_nationkey AS n, abs(c_acctbal) AS b FROM customer), x AS (SELECT k AS customer_id, {", ".join(f"{v} AS {c}" for c, v in _TSQL.items())} FROM c),
q AS (SELECT quantile_cont(monthly_charges, .75) AS q FROM x), y AS (SELECT *, {" + ".join(f"{c}_code" for c in features.SERVICES)} AS premium_services, monthly_charges / (tenure + 1) AS charges_per_tenure,
  total_charges / (tenure * monthly_charges + 1) AS charges_ratio, CASE WHEN tenure <= 12 THEN 0 WHEN tenure <= 24 THEN 1 WHEN tenure <= 48 THEN 2 ELSE 3 END AS tenure_band, (monthly_charges > q)::INT AS high_value,
  (contract_code = 0 AND internet_fiber = 1 AND tech_support_code = 0)::INT AS risk_combination FROM x, q)
SELECT customer_id, {", ".join(f"round({c}, 9) AS {c}" if c in _TF else c for c in features.TELCO)} FROM y""")


_MODES, _SEGMENTS, _STATUS = [*features.SHIP_MODES, "other"], [*features.SEGMENTS, "other"], [*features.OPEN_STATUS, "COMPLETE", "CLOSED"]


def _supply(s, d):
    x = t(s, d, "lineitem").join(t(s, d, "orders"), F.col("l_orderkey") == F.col("o_orderkey")).join(t(s, d, "part"), F.col("l_partkey") == F.col("p_partkey"))
    k, price, rate = F.col("l_orderkey"), F.col("l_extendedprice"), F.col("l_discount")
    f = x.select(F.col("o_orderdate").alias("ordered_at"), _cycle(k, _STATUS).alias("status"), _cycle(k + F.col("l_linenumber"), _MODES).alias("mode"), (F.col("l_partkey") % 6).alias("scheduled_days"),
                 _cycle(F.col("o_custkey"), _SEGMENTS).alias("segment"), F.col("o_orderpriority").alias("market"), F.when(F.col("l_suppkey") % 9 != 0, F.col("l_suppkey").cast("string")).alias("region"),
                 F.col("p_type").alias("category"), F.col("p_brand").alias("department"), (price * (1 - rate)).alias("sales_per_customer"), (price * rate).alias("item_discount"), rate.alias("discount_rate"),
                 F.when(F.col("l_linenumber") > 1, F.col("l_tax")).alias("profit_ratio"), F.col("l_quantity").alias("item_quantity"), price.alias("sales"), (price * F.col("l_tax")).alias("profit_per_order"),
                 (price * F.col("l_tax")).alias("benefit_per_order"), (price * (1 - rate)).alias("item_total"), F.col("p_retailprice").alias("product_price"))
    return features.supply_features(f).groupBy("dow", "month").agg(F.count("*").alias("n"), *[F.sum(F.col(c).cast("double")).alias(c) for c in features.SUPPLY])


_LSQL = {"sales_per_customer": "p * (1 - l_discount)", "item_discount": "p * l_discount", "discount_rate": "l_discount", "profit_ratio": "CASE WHEN l_linenumber > 1 THEN l_tax ELSE 0 END", "item_quantity": "l_quantity", "sales": "p",
         "profit_per_order": "p * l_tax", "benefit_per_order": "p * l_tax", "item_total": "p * (1 - l_discount)", "product_price": "p_retailprice", "mode_code": _case("(l_orderkey + l_linenumber)", (0, 1, 2, 3, 0)),
         "segment_code": _case("o_custkey", (0, 1, 2, 0)), "status_code": _case("l_orderkey", (1, 2, 3, 4, 5, 6, 0, 0)), "scheduled_days": "l_partkey % 6", "hour": "hour(o_orderdate)", "day": "day(o_orderdate)",
         "weekend": "(isodow(o_orderdate) >= 6)::INT", "market_code": "dense_rank() OVER (ORDER BY o_orderpriority) - 1", "region_code": "dense_rank() OVER (ORDER BY CASE WHEN l_suppkey % 9 <> 0 THEN l_suppkey::VARCHAR ELSE 'Unknown' END) - 1",
         "category_code": "dense_rank() OVER (ORDER BY p_type) - 1", "department_code": "dense_rank() OVER (ORDER BY p_brand) - 1"}
add("l4_supply_features", lambda s, d: r(_supply(s, d), *features.SUPPLY),
    f"""WITH l AS (SELECT *, l_extendedprice AS p FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN part ON l_partkey = p_partkey),
x AS (SELECT CAST(isodow(o_orderdate) - 1 AS INTEGER) AS dow, CAST(month(o_orderdate) AS INTEGER) AS month, {", ".join(f"{v} AS {c}" for c, v in _LSQL.items())} FROM l),
q AS (SELECT quantile_cont(sales, .75) AS qs, quantile_cont(item_quantity, .75) AS qq FROM x),
y AS (SELECT *, sales / (item_quantity + 1) AS value_per_item, sales * discount_rate AS discount_amount, (sales > qs)::INT AS high_value_order, (mode_code >= 2)::INT AS rush, (item_quantity > qq)::INT AS high_quantity,
  mode_code * scheduled_days AS mode_x_days, (mode_code = 0 AND scheduled_days <= 3)::INT AS tight_schedule, (mode_code = 0 AND segment_code = 0 AND scheduled_days >= 4)::INT AS risk_combination FROM x, q)
SELECT dow, month, count(*) AS n, {", ".join(f"round(sum({c}), 4)::DOUBLE AS {c}" for c in features.SUPPLY)} FROM y GROUP BY 1, 2""")
add("l5_stratified_split", lambda s, d: features.stratified_split(t(s, d, "orders"), "o_orderkey", "o_orderstatus").groupBy("o_orderstatus", "split").agg(F.count("*").alias("n")),
    """WITH n AS (SELECT o_orderstatus, count(*) AS n FROM orders GROUP BY 1), x AS (SELECT o_orderstatus, unnest(range(n)) / n::DOUBLE AS p FROM n)
SELECT o_orderstatus, CASE WHEN p < .7 THEN 'train' WHEN p < .7::DOUBLE + .15::DOUBLE THEN 'valid' ELSE 'test' END AS split, count(*) AS n FROM x GROUP BY 1, 2""")
add("l5_temporal_split", lambda s, d: features.temporal_split(t(s, d, "events"), "ts").groupBy("split").agg(F.count("*").alias("n"), F.max("event_id").alias("last_id")),
    """WITH q AS (SELECT quantile_cont(epoch_us(ts)::DOUBLE, .8) AS c FROM events) SELECT CASE WHEN epoch_us(ts) <= c THEN 'train' ELSE 'test' END AS split, count(*) AS n, max(event_id) AS last_id FROM events, q GROUP BY 1""")
add("l6_class_weights", lambda s, d: r(features.class_weights(t(s, d, "events"), "event_type").groupBy("event_type").agg(F.count("*").alias("n"), F.avg("weight").alias("weight")), "weight", digits=6),
    "SELECT event_type, count(*) AS n, round((SELECT count(*) FROM events) / (5.0::DOUBLE * count(*)), 6) AS weight FROM events GROUP BY 1")

# --- text and scalar functions ------------------------------------------------------------
_LEX = "[" + ", ".join(f"'{w}'" for w in scalar.FRUSTRATION) + "]"
_CALM = "[" + ", ".join(f"'{w}'" for w in scalar.CALM) + "]"
add("x1_lexicon_score", lambda s, d: r(scalar.lexicon_score(t(s, d, "documents"), "text").select("doc_id", F.concat_ws(",", "matched").alias("matched"), "score", "bucket"), "score"),
    f"""WITH x AS (SELECT doc_id, text, list_filter({_LEX}, lambda w: contains(lower(text), w)) AS ng, list_filter({_CALM}, lambda w: contains(lower(text), w)) AS ps FROM documents),
y AS (SELECT *, coalesce(trim(text), '') = '' AS blank, greatest(0, least(100, (8.0 * len(ng) - 3.0 * len(ps)) * CASE WHEN length(text) < 20 THEN .7 ELSE 1 END))::DOUBLE AS s FROM x)
SELECT doc_id, CASE WHEN blank THEN 'no_text' ELSE array_to_string(list_concat(ng, list_transform(ps, lambda w: 'neutral:' || w)), ',') END AS matched, CASE WHEN blank THEN 0.0::DOUBLE ELSE round(s, 4) END AS score,
  CASE WHEN blank OR s < 15 THEN 'low' WHEN s < 35 THEN 'medium' WHEN s < 55 THEN 'high' ELSE 'escalating_frustration' END AS bucket FROM y""")
add("x1_sentiment_summary", lambda s, d: scalar.sentiment_summary(scalar.lexicon_score(t(s, d, "conversations"), "text")),
    f"""WITH x AS (SELECT greatest(0, least(100, (8.0 * len(list_filter({_LEX}, lambda w: contains(lower(text), w))) - 3.0 * len(list_filter({_CALM}, lambda w: contains(lower(text), w)))) * CASE WHEN length(text) < 20 THEN .7 ELSE 1 END))::DOUBLE AS s FROM conversations)
SELECT count(*) AS tickets_analyzed, count(*) FILTER (s >= 55) AS escalating_frustration_count, count(*) FILTER (s >= 35) AS high_risk_count, round(avg(round(s, 1)), 2) AS avg_sentiment_score FROM x""")
_TS = ["n_characters", "n_words", "has_digit", "has_percent", "exclamations", "questions"]
add("x2_text_shape", lambda s, d: r(scalar.text_shape(t(s, d, "conversations"), "text").select("conv_id", "turn", *_TS, "mean_word_length", "upper_ratio"), "mean_word_length", "upper_ratio", digits=6),
    r"""WITH x AS (SELECT *, list_filter(regexp_split_to_array(text, '[ \t\n\r\f\x0B]+'), lambda w: w <> '') AS w, length(regexp_replace(text, '[ \t\n\r\f\x0B]+', '', 'g')) AS l FROM conversations)
SELECT conv_id, turn, CAST(length(text) AS INTEGER) AS n_characters, CAST(len(w) AS INTEGER) AS n_words, regexp_matches(text, '\p{Nd}')::INT AS has_digit, contains(text, '%')::INT AS has_percent,
  CAST(length(text) - length(replace(text, '!', '')) AS INTEGER) AS exclamations, CAST(length(text) - length(replace(text, '?', '')) AS INTEGER) AS questions,
  round(coalesce(l / nullif(len(w), 0)::DOUBLE, 0), 6) AS mean_word_length, round(len(regexp_extract_all(text, '\p{Lu}')) / greatest(length(text), 1)::DOUBLE, 6) AS upper_ratio FROM x""")
add("x3_tfidf", lambda s, d: r(features.tfidf(t(s, d, "conversations").withColumn("k", F.concat_ws("-", "conv_id", "turn")), "k", "text").groupBy("term").agg(F.max("df").alias("df"), F.sum("tf").alias("tf"), F.sum("weight").alias("weight")), "weight"),
    r"""WITH c AS (SELECT conv_id || '-' || turn AS k, list_filter(regexp_split_to_array(lower(text), '[^\p{L}\p{N}]+'), lambda w: length(w) > 1) AS w FROM conversations),
g AS (SELECT k, unnest(w) AS term FROM c UNION ALL SELECT k, unnest(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) FROM c), tf AS (SELECT k, term, count(*) AS tf FROM g GROUP BY 1, 2), n AS (SELECT count(*) AS n FROM conversations),
df AS (SELECT term, count(*) AS df FROM tf GROUP BY 1) SELECT term, max(df) AS df, CAST(sum(tf) AS BIGINT) AS tf, round(sum(tf * (ln((1 + n) / (1.0::DOUBLE + df)) + 1)), 4) AS weight FROM tf JOIN df USING (term), n WHERE df >= 3 AND df <= .95 * n GROUP BY term""")
_STOP = ("about", "and", "are", "but", "can", "for", "how", "in", "is", "it", "not", "of", "on", "that", "the", "this", "to", "was", "what", "with", "you")
add("x3_tfidf_stop_words", lambda s, d: r(features.tfidf(t(s, d, "conversations").withColumn("k", F.concat_ws("-", "conv_id", "turn")), "k", "text", stop_words=_STOP)
    .groupBy("term").agg(F.max("df").alias("df"), F.sum("tf").alias("tf"), F.sum("weight").alias("weight")), "weight"),
    SQL["x3_tfidf"].replace("lambda w: length(w) > 1", f"lambda w: length(w) > 1 AND w NOT IN {_STOP}"))
add("x4_sentiment_label", lambda s, d: scalar.sentiment_label(t(s, d, "documents").withColumn("score", 1 + F.col("doc_id") % 5), "score", "text").groupBy("label").agg(F.count("*").alias("n")),
    "SELECT CASE WHEN 1 + doc_id % 5 <= 2 THEN 0 WHEN 1 + doc_id % 5 = 3 THEN 1 ELSE 2 END AS label, count(*) AS n FROM documents WHERE length(trim(text)) > 10 GROUP BY 1")


def _geo(s, d):
    j = t(s, d, "lineitem").join(t(s, d, "orders"), F.col("l_orderkey") == F.col("o_orderkey"))
    km = scalar.haversine_km(F.col("o_custkey") % 180 - 90.0, F.col("o_custkey") % 360 - 180.0, F.col("l_suppkey") % 180 - 90.0, F.col("l_suppkey") % 360 - 180.0)
    return j.groupBy("l_suppkey").agg(F.avg(km).alias("mean_km"), F.max(km).alias("max_km"))


_H = "2 * 6371 * asin(sqrt(least(1, pow(sin(radians(b - a) / 2), 2) + cos(radians(a)) * cos(radians(b)) * pow(sin(radians(e - c) / 2), 2))))"
add("x5_haversine", lambda s, d: r(_geo(s, d), "mean_km", "max_km"),
    f"""WITH x AS (SELECT l_suppkey, o_custkey % 180 - 90.0::DOUBLE AS a, o_custkey % 360 - 180.0::DOUBLE AS c, l_suppkey % 180 - 90.0::DOUBLE AS b, l_suppkey % 360 - 180.0::DOUBLE AS e FROM lineitem JOIN orders ON l_orderkey = o_orderkey)
SELECT l_suppkey, round(avg({_H}), 4) AS mean_km, round(max({_H}), 4) AS max_km FROM x GROUP BY 1""")
add("x6_calendar_features", lambda s, d: scalar.calendar_features(t(s, d, "events"), "ts").groupBy("dow", "month", "hour", "day", "month_end", "weekend").agg(F.count("*").alias("n")),
    "SELECT CAST(isodow(ts) - 1 AS INTEGER) AS dow, CAST(month(ts) AS INTEGER) AS month, CAST(hour(ts) AS INTEGER) AS hour, CAST(day(ts) AS INTEGER) AS day, (last_day(ts::DATE) - ts::DATE <= 2)::INT AS month_end, (isodow(ts) >= 6)::INT AS weekend, count(*) AS n FROM events GROUP BY ALL")
add("x7_label_encode", lambda s, d: features.label_encode(t(s, d, "part"), "p_brand").select("p_partkey", F.col("p_brand_code").cast("long").alias("code")),
    "SELECT p_partkey, dense_rank() OVER (ORDER BY p_brand) - 1 AS code FROM part")
add("x8_impute_and_flag", lambda s, d: features.impute_and_flag(t(s, d, "orders").select("o_orderkey", F.when(F.col("o_orderkey") % 6 != 0, F.col("o_totalprice")).alias("v")), "v"),
    "WITH o AS (SELECT o_orderkey, CASE WHEN o_orderkey % 6 <> 0 THEN o_totalprice END AS v FROM orders), q AS (SELECT median(v) AS m, quantile_cont(v, .75) AS h FROM o) SELECT o_orderkey, v, coalesce(v, m) AS v_filled, (coalesce(v, m) > h)::INT AS v_high FROM o, q")
add("x8_quantile_bins", lambda s, d: features.quantile_bins(t(s, d, "lineitem").select("l_orderkey", "l_linenumber", F.when(F.col("l_orderkey") % 7 != 0, F.col("l_quantity")).alias("v")), "v", 8)
    .groupBy("v", "v_bin").agg(F.count("*").alias("n")),
    "WITH o AS (SELECT CASE WHEN l_orderkey % 7 <> 0 THEN l_quantity::DOUBLE END AS v FROM lineitem), q AS (SELECT list_distinct(quantile_cont(v, [.125, .25, .375, .5, .625, .75, .875])) AS e FROM o)"
    " SELECT v, CASE WHEN v IS NOT NULL THEN len(list_filter(e, lambda x: x < v)) END::INT AS v_bin, count(*) AS n FROM o, q GROUP BY ALL")
_CC = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]
add("x9_corr_matrix", lambda s, d: r(features.corr_matrix(t(s, d, "lineitem"), _CC), "r", digits=6),
    " UNION ALL ".join(f"SELECT '{a}' AS a, '{b}' AS b, round(corr({a}, {b}), 6) AS r FROM lineitem" for i, a in enumerate(_CC) for b in _CC[i:]))


# --- evaluation ---------------------------------------------------------------------------------
def scored(s, d):
    """A scored binary target over lineitem: return flag R against a price and discount score with many ties."""
    li = t(s, d, "lineitem")
    sc = F.round((F.col("l_extendedprice") / 110000 * 0.6 + F.col("l_discount") * 4 * 0.4) * F.when(F.col("l_returnflag") == "R", 1.1).otherwise(1.0), 3)
    return li.select(F.concat_ws("-", "l_orderkey", "l_linenumber", "l_partkey").alias("id"), sc.alias("score"), (F.col("l_returnflag") == "R").cast("int").alias("label"), "l_suppkey", "l_linestatus") \
        .withColumn("prediction", (F.col("score") > 0.35).cast("int"))


_P = """p AS (SELECT l_suppkey, l_linestatus, round((l_extendedprice / 110000 * .6::DOUBLE + l_discount * 4 * .4::DOUBLE) * CASE WHEN l_returnflag = 'R' THEN 1.1::DOUBLE ELSE 1 END, 3) AS s, (l_returnflag = 'R')::INT AS y FROM lineitem),
pp AS (SELECT *, (s > .35)::INT AS h FROM p), st AS (SELECT s, sum(y) AS pos, sum(1 - y) AS neg FROM p GROUP BY s),
cu AS (SELECT *, sum(pos) OVER w AS cp, sum(neg) OVER w AS cn, sum(pos) OVER () AS ap, sum(neg) OVER () AS an FROM st WINDOW w AS (ORDER BY s DESC))"""
add("e1_best_threshold", lambda s, d: r(evaluation.best_threshold(scored(s, d)), "f1", "precision", "recall", digits=6),
    f"WITH {_P}, f AS (SELECT *, round(2.0::DOUBLE * cp / (cp + cn + ap), 12) AS f1 FROM cu) SELECT s AS threshold, round(f1, 6) AS f1, round(cp / (cp + cn), 6) AS precision, round(cp / ap, 6) AS recall FROM f ORDER BY f1 DESC, s DESC LIMIT 1")
add("e2_confusion", lambda s, d: evaluation.confusion(scored(s, d), [0, 1]).select("label", F.col("0").alias("pred_0"), F.col("1").alias("pred_1")),
    f"WITH {_P} SELECT y AS label, count(*) FILTER (h = 0) AS pred_0, count(*) FILTER (h = 1) AS pred_1 FROM pp GROUP BY y")
_CL = "cl AS (SELECT c, count(*) FILTER (y = c AND h = c) AS tp, count(*) FILTER (y = c) AS su, count(*) FILTER (h = c) AS pr FROM pp, (VALUES (0), (1)) v(c) GROUP BY c), fm AS (SELECT *, 2.0::DOUBLE * tp / (su + pr) AS f FROM cl)"
add("e2_summary_metrics", lambda s, d: r(evaluation.summary_metrics(scored(s, d)), "accuracy", "macro_f1", "weighted_f1", digits=6),
    f"WITH {_P}, {_CL} SELECT round(sum(tp) / sum(su), 6) AS accuracy, round(avg(f), 6) AS macro_f1, round(sum(f * su) / sum(su), 6) AS weighted_f1 FROM fm")
add("e3_auc", lambda s, d: r(evaluation.auc(scored(s, d)), "roc_auc", "average_precision", "pr_auc", digits=6),
    f"""WITH {_P}, rk AS (SELECT y, avg(n) OVER (PARTITION BY s) AS ar FROM (SELECT s, y, row_number() OVER (ORDER BY s) AS n FROM p)), mw AS (SELECT (sum(ar) FILTER (y = 1) - sum(y) * (sum(y) + 1) / 2.0::DOUBLE) / (sum(y)::DOUBLE * sum(1 - y)) AS roc FROM rk),
x AS (SELECT *, cp / (cp + cn) AS pn, coalesce(lag(cp / (cp + cn)) OVER (ORDER BY s DESC), 1) AS pb FROM cu) SELECT round(any_value(roc), 6) AS roc_auc, round(sum(pos * pn) / any_value(ap), 6) AS average_precision, round(sum(pos * (pn + pb) / 2) / any_value(ap), 6) AS pr_auc FROM x, mw""")
add("e4_kfold_metrics", lambda s, d: r(evaluation.kfold_metrics(scored(s, d), "id"), "mean", "std", "half_width", digits=6))
_PU = "(('0x' || substr(h, {}, 8))::BIGINT + 0.5::DOUBLE) / 4294967296::DOUBLE"
add("e5_roc_band", lambda s, d: r(evaluation.roc_band(scored(s, d)), "mean_tpr", "low", "high"),
    f"""WITH {_P}, pt AS (SELECT n, j, sum(exp(j * ln(n::DOUBLE) - n - CASE WHEN j = 0 THEN 0 ELSE lgamma(j + 1) END)) OVER (PARTITION BY n ORDER BY j) AS hi FROM range(1, 65) a(n), range(0, 151) b(j)),
iv AS (SELECT n, j, coalesce(lag(hi) OVER (PARTITION BY n ORDER BY j), 0) AS lo, CASE WHEN j = 150 THEN 2 ELSE hi END AS hi FROM pt),
ce AS (SELECT s, unnest([1, 0]) AS y, unnest([pos, neg])::BIGINT AS n FROM st),
dr AS (SELECT s, y, n, k, md5('11:' || printf('%.12f', s::DOUBLE) || ':' || y || ':' || k) AS h FROM ce, range(1, 1001) t(k) WHERE n > 0),
du AS (SELECT *, {_PU.format(1)} AS u, sqrt(-2 * ln({_PU.format(17)})) * cos(2 * pi() * {_PU.format(25)}) AS z FROM dr),
dw AS (SELECT s, y, k, CASE WHEN du.n > 64 THEN greatest(0, floor(du.n + sqrt(du.n::DOUBLE) * z + (z * z - 1) / 6 + .5))::BIGINT ELSE coalesce(j, 0) END AS w FROM du LEFT JOIN iv ON iv.n = du.n AND u >= lo AND u < hi),
dc AS (SELECT k, s, sum(CASE WHEN y = 1 THEN w ELSE 0 END) AS p, sum(CASE WHEN y = 0 THEN w ELSE 0 END) AS n FROM dw GROUP BY k, s),
rc AS (SELECT k, sum(p) OVER o / nullif(sum(p) OVER (PARTITION BY k), 0)::DOUBLE AS tpr, sum(n) OVER o / nullif(sum(n) OVER (PARTITION BY k), 0)::DOUBLE AS fpr FROM dc WINDOW o AS (PARTITION BY k ORDER BY s DESC)),
gb AS (SELECT k, ceil(fpr * 200)::INT AS g, max(tpr) AS tpr FROM rc WHERE fpr IS NOT NULL GROUP BY 1, 2),
ga AS (SELECT k, g, coalesce(max(tpr) OVER (PARTITION BY k ORDER BY g), 0) AS tpr FROM (SELECT k, g FROM range(1, 1001) a(k), range(0, 201) b(g)) LEFT JOIN gb USING (k, g))
SELECT g::INT AS fpr_grid, round(avg(tpr), 4) AS mean_tpr, round(quantile_cont(tpr, .025), 4) AS low, round(quantile_cont(tpr, .975), 4) AS high FROM ga GROUP BY g""")
add("e6_series_metrics", lambda s, d: r(evaluation.series_metrics(scored(s, d), "l_suppkey", ("l_linestatus",)), "precision", "recall", "f1", "flag_rate", digits=6),
    f"""WITH {_P}, c AS (SELECT l_suppkey, l_linestatus, count(*) FILTER (y = 1 AND h = 1) AS tp, count(*) FILTER (y = 0 AND h = 1) AS fp, count(*) FILTER (y = 1 AND h = 0) AS fn, count(*) FILTER (y = 0 AND h = 0) AS tn FROM pp GROUP BY 1, 2)
SELECT *, round(coalesce(tp / nullif(tp + fp, 0)::DOUBLE, 0), 6) AS precision, round(coalesce(tp / nullif(tp + fn, 0)::DOUBLE, 0), 6) AS recall, round(coalesce(2.0::DOUBLE * tp / nullif(2 * tp + fp + fn, 0), 0), 6) AS f1, round((tp + fp) / (tp + fp + fn + tn)::DOUBLE, 6) AS flag_rate FROM c""")


def _models(s, d):
    x = scored(s, d)
    out = None
    for name, cut in (("strict", 0.5), ("middle", 0.35), ("loose", 0.2)):
        m = evaluation.summary_metrics(x.withColumn("prediction", (F.col("score") > cut).cast("int"))).withColumn("model", F.lit(name))
        out = m if out is None else out.unionByName(m)
    return reports.compare_models(out, ["accuracy", "macro_f1"])


def _msql(name, cut):
    return f"SELECT '{name}' AS model, (SELECT sum(tp) / sum(su) FROM g) AS accuracy, (SELECT avg(f) FROM g) AS macro_f1 FROM (SELECT 1)".replace("FROM g", f"FROM (SELECT *, 2.0::DOUBLE * tp / nullif(su + pr, 0) AS f FROM (SELECT c, count(*) FILTER (y = c AND (s > {cut})::INT = c) AS tp, count(*) FILTER (y = c) AS su, count(*) FILTER ((s > {cut})::INT = c) AS pr FROM p, (VALUES (0), (1)) v(c) GROUP BY c))")


add("e7_compare_models", lambda s, d: r(_models(s, d), "value", digits=6),
    f"""WITH {_P}, m AS ({" UNION ALL ".join(_msql(a, b) for a, b in (("strict", 0.5), ("middle", 0.35), ("loose", 0.2)))}), l AS (SELECT model, 'accuracy' AS metric, accuracy AS value FROM m UNION ALL SELECT model, 'macro_f1', macro_f1 FROM m),
k AS (SELECT *, CAST(row_number() OVER (PARTITION BY metric ORDER BY value DESC, model) AS INTEGER) AS rank FROM l) SELECT model, metric, round(value, 6) AS value, rank, rank = 1 AS is_best FROM k""")
