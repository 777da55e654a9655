"""Feature sets, encodings, splits and text weights as joins and windows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from panelwise.functions.scalar import calendar_features, haversine_km
from panelwise.operators.ordering import RANGE_ROWS, dense_index, exact_quantiles, parts_for
from panelwise.session import written


def order_panel(orders: DataFrame, items: DataFrame, reviews: DataFrame) -> DataFrame:
    """Daily order, delivery and review features with trailing statistics, lags and calendar parts.

    orders(order_id, customer_id, day, delivered_day, delivery_days, late),
    items(order_id, price, freight), reviews(day, score). One row per order
    day; revenue is price plus freight. The mean review score is carried
    forward, everything else that is missing is 0.
    """
    value = items.groupBy("order_id").agg(F.sum("price").alias("price"), F.sum("freight").alias("freight"))
    total = F.col("price") + F.col("freight")
    daily = orders.join(value, "order_id", "left").groupBy("day").agg(
        F.count("*").alias("orders"), F.count_distinct("customer_id").alias("customers"), F.sum(total).alias("revenue"),
        F.avg(total).alias("mean_value"), F.stddev_samp(total).alias("std_value"), F.sum("price").alias("product_revenue"),
        F.avg("price").alias("mean_price"), F.sum("freight").alias("freight"), F.avg("freight").alias("mean_freight"))
    shipped = orders.where("delivered_day is not null").groupBy(F.col("delivered_day").alias("day")).agg(
        F.count("*").alias("delivered"), F.avg("delivery_days").alias("mean_delivery_days"), F.stddev_samp("delivery_days").alias("std_delivery_days"),
        F.max("delivery_days").alias("max_delivery_days"), F.sum("late").alias("late_count"), F.avg("late").alias("late_rate"))
    scored = reviews.groupBy("day").agg(F.avg("score").alias("review_score"), F.stddev_samp("score").alias("review_std"), F.count("*").alias("reviews"))
    x = daily.join(shipped, "day", "left").join(scored, "day", "left")
    o = W.partitionBy().orderBy("day")  # one row per order day
    x = x.withColumn("review_score", F.last("review_score", ignorenulls=True).over(o.rowsBetween(W.unboundedPreceding, 0)))
    x = x.fillna(0).withColumns({"dow": F.weekday("day"), "day_of_month": F.dayofmonth("day"), "month": F.month("day")})
    cols = {}
    for c in ("orders", "revenue"):
        for n in (7, 14, 30):
            cols[f"{c}_mean_{n}"] = F.avg(c).over(o.rowsBetween(-(n - 1), 0))
            cols[f"{c}_std_{n}"] = F.stddev_samp(c).over(o.rowsBetween(-(n - 1), 0))
        cols[f"{c}_lag_1"], cols[f"{c}_lag_7"] = F.lag(c, 1).over(o), F.lag(c, 7).over(o)
    return x.withColumns({c: F.coalesce(v, F.lit(0)) for c, v in cols.items()})


def order_star(orders: DataFrame, items: DataFrame, customers: DataFrame, sellers: DataFrame, products: DataFrame) -> DataFrame:
    """One row per order: item totals, mean product sizes, first seller and category, customer and seller regions.

    items(order_id, item_no, price, freight, installments, seller_id,
    product_id), products(product_id, category, weight, length, height, width).
    Items are reduced per order in one aggregate; dimension joins are left to
    the optimizer, which broadcasts a side only when its size allows it.
    """
    sizes = ("weight", "length", "height", "width")
    agg = items.join(products, "product_id", "left").groupBy("order_id").agg(
        F.count("*").alias("n_items"), F.sum("price").alias("price"), F.sum("freight").alias("freight"), F.avg("price").alias("mean_item_price"),
        F.max("installments").alias("installments"), *[F.avg(c).alias(c) for c in sizes],
        F.min_by(F.struct("seller_id", "product_id", "category"), "item_no").alias("f"))
    return orders.join(agg, "order_id", "left").select("*", "f.seller_id", "f.product_id", "f.category").drop("f") \
        .join(customers, "customer_id", "left").join(sellers, "seller_id", "left")


def with_distance(star: DataFrame, places: DataFrame) -> DataFrame:
    """Add ``distance_km`` between the mean positions of the customer's and the seller's area; the median where one is unknown.

    places(area, lat, lng) may hold many rows per area.
    """
    mean = places.groupBy("area").agg(F.avg("lat").alias("lat"), F.avg("lng").alias("lng"))

    def side(p: str) -> DataFrame:
        return mean.select(F.col("area").alias(f"{p}_area"), F.col("lat").alias(f"_{p}_lat"), F.col("lng").alias(f"_{p}_lng"))
    both = star.join(side("customer"), "customer_area", "left").join(side("seller"), "seller_area", "left")
    far = both.withColumn("distance_km", haversine_km(F.col("_customer_lat"), F.col("_customer_lng"), F.col("_seller_lat"), F.col("_seller_lng")))
    middle = exact_quantiles(far, "distance_km", [0.5]).select("quantile").scalar()
    return far.withColumn("distance_km", F.coalesce("distance_km", middle)).drop(*[f"_{p}_{c}" for p in ("customer", "seller") for c in ("lat", "lng")])


def _history(d: DataFrame, key: str, as_of: bool, stats: dict[str, tuple[str, str]]) -> DataFrame:
    """Means and counts per ``key``: over all rows, or over the earlier days of each row's day (leak free).

    ``stats`` names the output and (column, "mean" or "count").
    """
    days = d.groupBy(key, *(["_day"] if as_of else [])).agg(
        F.count("*").alias("_n"), *[x for c in {c for c, how in stats.values() if how == "mean"} for x in (F.sum(c).alias(f"_s_{c}"), F.count(c).alias(f"_c_{c}"))])
    def total(c: str) -> Column:
        return F.sum(c).over(W.partitionBy(key).orderBy("_day").rowsBetween(W.unboundedPreceding, -1)) if as_of else F.col(c)
    return days.select(key, *(["_day"] if as_of else []), *[
        (F.coalesce(total("_n"), F.lit(0)) if how == "count" else F.try_divide(total(f"_s_{c}"), total(f"_c_{c}"))).alias(out) for out, (c, how) in stats.items()])


DELIVERY = ["dow", "month", "hour", "days_until_estimated", "weekend", "month_end", "n_items", "total_amount", "freight", "mean_item_price", "freight_ratio", "installments",
            "payment_code", "customer_region_code", "seller_region_code", "distance_km", "same_region", "category_code", "weight", "length", "volume",
            "seller_mean_delivery_days", "seller_late_rate", "seller_orders", "category_late_rate", "buffer_days", "daily_orders", "seller_daily_orders", "price_per_gram"]


def delivery_features(star: DataFrame, as_of_history: bool = False) -> DataFrame:
    """The 29 late-delivery features (``DELIVERY``) on top of :func:`order_star`, which should be a written table.

    The star needs ordered_at, estimated_at, delivery_days, late and
    payment_type. Without ``distance_km`` (:func:`with_distance`) another region
    counts as 1000 km. Seller and category history covers all orders; with
    ``as_of_history`` only the earlier days of the seller or category, so no
    label of the same or a later day is used.
    """
    d = calendar_features(star, "ordered_at").withColumn("_day", F.to_date("ordered_at"))
    for c, out in (("payment_type", "payment_code"), ("customer_region", "customer_region_code"), ("seller_region", "seller_region_code"), ("category", "category_code")):
        d = label_code(d.withColumn(f"_{c}", F.col(c).cast("string")), f"_{c}", out, "unknown").drop(f"_{c}")
    middle = exact_quantiles(star, "delivery_days", [0.5]).select("quantile").scalar()
    on = ["_day"] if as_of_history else []
    seller = _history(d, "seller_id", as_of_history, {"seller_mean_delivery_days": ("delivery_days", "mean"), "seller_late_rate": ("late", "mean"), "seller_orders": ("late", "count")})
    category = _history(d, "category", as_of_history, {"category_late_rate": ("late", "mean")})
    per_day = d.groupBy("_day").agg(F.count("*").alias("daily_orders"))
    per_seller = d.groupBy("seller_id", "_day").agg(F.count("*").alias("seller_daily_orders"))
    same = F.coalesce(F.col("customer_region") == F.col("seller_region"), F.lit(False)).cast("int")
    x = d.join(seller, ["seller_id", *on], "left").join(category, ["category", *on], "left").join(per_day, "_day", "left").join(per_seller, ["seller_id", "_day"], "left")
    total = F.col("price") + F.col("freight")
    until = (F.unix_micros(F.col("estimated_at").cast("timestamp")) - F.unix_micros(F.col("ordered_at").cast("timestamp"))) / 86400e6
    return x.withColumns({
        "days_until_estimated": until, "total_amount": total, "freight_ratio": F.col("freight") / (F.col("price") + 0.01), "same_region": same,
        "distance_km": F.col("distance_km") if "distance_km" in star.columns else (1 - same) * 1000.0,
        "volume": F.coalesce("length", F.lit(0.0)) * F.coalesce("height", F.lit(0.0)) * F.coalesce("width", F.lit(0.0)),
        "buffer_days": until - middle, "price_per_gram": total / F.greatest(F.col("weight"), F.lit(1.0))}).drop("_day")


def rfm_features(orders: DataFrame) -> DataFrame:
    """17 customer features before the midpoint of the customer's history, and the churn label after it.

    orders(customer_id, ordered_at, amount, installments, review_score,
    delivery_days, late, n_items, n_categories), one row per order. Repeat
    customers are churned if nothing follows their midpoint. Totals and the
    midpoint come from grouped aggregates with map-side combine; a hot customer
    is never gathered. A complaint is an order with a review of 1 or 2.
    """
    span = orders.groupBy("customer_id").agg(F.unix_timestamp(F.min("ordered_at")).alias("_a"), F.unix_timestamp(F.max("ordered_at")).alias("_b"), F.count("*").alias("_n")) \
        .where("_n >= 2").withColumn("_mid", (F.col("_a") + F.col("_b")) / 2)
    x = orders.join(span, "customer_id").withColumn("_t", F.unix_timestamp("ordered_at"))
    before = F.col("_t") <= F.col("_mid")

    def of(c: str) -> Column:
        return F.when(before, F.col(c))

    g = x.groupBy("customer_id").agg(
        F.count_if(before).alias("frequency"), F.sum(of("amount")).alias("monetary"), F.avg(of("amount")).alias("mean_order"),
        F.avg(of("review_score")).alias("_review"), F.avg(of("delivery_days")).alias("_delivery"), F.sum(of("late")).alias("_late"),
        F.avg(of("late")).alias("_rate"), F.avg(of("installments")).alias("_parts"), F.sum(of("n_categories")).alias("_categories"),
        F.sum(of("n_items")).alias("_items"), F.count_if(before & (F.col("review_score") <= 2)).alias("complaints"),
        F.min(of("_t")).alias("_first"), F.max(of("_t")).alias("_last"), F.first("_mid").alias("_mid"), F.count_if(~before).alias("later"))
    recency = F.floor((F.col("_mid") - F.col("_last")) / 86400)
    lifespan = F.floor((F.col("_last") - F.col("_first")) / 86400)
    known = g.withColumn("recency_days", recency).withColumn("lifespan_days", F.when(lifespan == 0, 1).otherwise(lifespan))
    zero = {c: F.coalesce(F.col(v), F.lit(0)) for c, v in (
        ("delivery_days", "_delivery"), ("late_orders", "_late"), ("late_rate", "_rate"), ("mean_installments", "_parts"), ("diversity", "_categories"), ("items", "_items"))}
    return known.select(
        "customer_id", "recency_days", "frequency", "monetary", F.log1p("monetary").alias("log_monetary"), (F.col("recency_days") * F.col("recency_days")).alias("recency_squared"),
        (F.col("recency_days") * F.col("frequency")).alias("recency_frequency"), "mean_order", "lifespan_days", (F.col("frequency") / F.col("lifespan_days")).alias("purchase_rate"),
        F.coalesce("_review", F.lit(3.0)).alias("mean_review"), *[v.alias(c) for c, v in zero.items()], "complaints", (F.col("later") == 0).cast("int").alias("churned"))


#: Categories of the contract data and what they are coded as.
SERVICES = ("online_security", "online_backup", "device_protection", "tech_support", "streaming_tv", "streaming_movies")
CONTRACTS = {"Month-to-month": 0, "One year": 1, "Two year": 2}
INTERNET = {"internet_dsl": "DSL", "internet_fiber": "Fiber optic", "internet_none": "No"}
PAYMENTS = {"pay_electronic": "Electronic check", "pay_mailed": "Mailed check", "pay_bank_transfer": "Bank transfer (automatic)", "pay_credit_card": "Credit card (automatic)"}
SHIP_MODES = {"Standard Class": 0, "Second Class": 1, "First Class": 2, "Same Day": 3}
SEGMENTS = {"Consumer": 0, "Corporate": 1, "Home Office": 2}
OPEN_STATUS = {"PENDING": 1, "PROCESSING": 2, "PENDING_PAYMENT": 3, "ON_HOLD": 4, "SUSPECTED_FRAUD": 5, "PAYMENT_REVIEW": 6}


def _coded(column: str, codes: dict[str, int]) -> Column:
    """The code of a category; 0 for any other value and for null."""
    out = F.lit(0)
    for name, code in codes.items():
        out = F.when(F.col(column) == name, code).otherwise(out)
    return out


def telco_features(df: DataFrame) -> DataFrame:
    """30 contract features: flags, services, one-hot internet and payment, charge ratios, tenure band, risk combination.

    df(customer_id, gender, senior, partner, dependents, phone, paperless,
    lines, the six services, internet, contract, payment, tenure,
    monthly_charges, total_charges); Yes/No columns are text.
    """
    cut = exact_quantiles(df, "monthly_charges", [0.75]).select("quantile").scalar()

    def yes(c: str) -> Column:
        return F.coalesce((F.col(c) == "Yes").cast("int"), F.lit(0))

    x = df.withColumns({c: F.coalesce(F.col(c).cast("double"), F.lit(0.0)) for c in ("tenure", "monthly_charges", "total_charges")})
    x = x.withColumns({"gender_code": F.coalesce((F.col("gender") == "Male").cast("int"), F.lit(0)), "senior_code": F.col("senior").cast("int"),
                       **{f"{c}_code": yes(c) for c in ("partner", "dependents", "phone", "paperless", "lines", *SERVICES)},
                       **{c: F.coalesce((F.col("internet") == v).cast("int"), F.lit(0)) for c, v in INTERNET.items()},
                       **{c: F.coalesce((F.col("payment") == v).cast("int"), F.lit(0)) for c, v in PAYMENTS.items()}, "contract_code": _coded("contract", CONTRACTS)})
    services = sum((F.col(f"{c}_code") for c in SERVICES[1:]), F.col(f"{SERVICES[0]}_code"))
    t, m = F.col("tenure"), F.col("monthly_charges")
    return x.withColumns({
        "premium_services": services, "charges_per_tenure": m / (t + 1), "charges_ratio": F.col("total_charges") / (t * m + 1),
        "tenure_band": F.when(t <= 12, 0).when(t <= 24, 1).when(t <= 48, 2).otherwise(3), "high_value": (m > cut).cast("int"),
        "risk_combination": ((F.col("contract_code") == 0) & (F.col("internet_fiber") == 1) & (F.col("tech_support_code") == 0)).cast("int")})


TELCO = ["gender_code", "senior_code", *[f"{c}_code" for c in ("partner", "dependents", "phone", "paperless", "lines", *SERVICES)], "premium_services", *INTERNET,
         "contract_code", *PAYMENTS, "tenure", "monthly_charges", "total_charges", "charges_per_tenure", "charges_ratio", "tenure_band", "high_value", "risk_combination"]


def label_code(df: DataFrame, column: str, out: str, missing: str = "Unknown") -> DataFrame:
    """Add the 0-based position of a text category among all categories in sorted order.

    The dictionary is written, so that the optimizer knows its size: a small one
    is broadcast and the rows stay where they are.
    """
    filled = df.withColumn("_c", F.coalesce(F.col(column), F.lit(missing)))
    return filled.join(written(dense_index(filled, "_c", out, ranges=None), "codes"), "_c").drop("_c")


def supply_features(df: DataFrame) -> DataFrame:
    """Order features known before shipment: calendar, money, coded mode, segment, market, region, category, status and their crossings.

    df(ordered_at, status, mode, scheduled_days, segment, market, region,
    category, department, the money columns of ``MONEY``). Every status keeps its
    rows; those past shipment are coded 0. The rows are written once: two
    quantiles, four dictionaries and the features themselves read them.
    """
    df = written(df, "supply")
    cuts = {c: exact_quantiles(df.select(F.coalesce(F.col(c).cast("double"), F.lit(0.0)).alias(c)), c, [0.75]).select("quantile").scalar() for c in ("sales", "item_quantity")}
    x = df.withColumns({c: F.coalesce(F.col(c).cast("double"), F.lit(0.0)) for c in MONEY})
    at = F.col("ordered_at")
    x = x.withColumns({"dow": F.weekday(at), "month": F.month(at), "hour": F.hour(at), "day": F.dayofmonth(at), "weekend": (F.weekday(at) >= 5).cast("int"),
                       "mode_code": _coded("mode", SHIP_MODES), "segment_code": _coded("segment", SEGMENTS), "status_code": _coded("status", OPEN_STATUS)})
    for c in ("market", "region", "category", "department"):
        x = label_code(x, c, f"{c}_code")
    mode, days = F.col("mode_code"), F.col("scheduled_days")
    return x.withColumns({
        "value_per_item": F.col("sales") / (F.col("item_quantity") + 1), "discount_amount": F.col("sales") * F.col("discount_rate"),
        "high_value_order": (F.col("sales") > cuts["sales"]).cast("int"), "rush": (mode >= 2).cast("int"),
        "high_quantity": (F.col("item_quantity") > cuts["item_quantity"]).cast("int"), "mode_x_days": mode * days,
        "tight_schedule": ((mode == 0) & (days <= 3)).cast("int"), "risk_combination": ((mode == 0) & (F.col("segment_code") == 0) & (days >= 4)).cast("int")})


MONEY = ["sales_per_customer", "item_discount", "discount_rate", "profit_ratio", "item_quantity", "sales", "profit_per_order", "benefit_per_order", "item_total", "product_price"]
SUPPLY = ["hour", "day", "weekend", "scheduled_days", *MONEY, "mode_code", "segment_code", "market_code", "region_code", "category_code", "status_code", "department_code",
          "value_per_item", "discount_amount", "high_value_order", "rush", "high_quantity", "mode_x_days", "tight_schedule", "risk_combination"]


def label_encode(df: DataFrame, column: str, unknown: int = -1) -> DataFrame:
    """Sorted position of a category; missing values get ``unknown``."""
    codes = dense_index(df, column, f"{column}_code", ranges=None)
    return df.join(codes, column, "left").fillna(unknown, subset=[f"{column}_code"])


def impute_and_flag(df: DataFrame, column: str) -> DataFrame:
    """Median imputation and a flag above the 75th percentile."""
    q = exact_quantiles(df, column, [0.5, 0.75])
    def at(p: float) -> Column:
        return q.where(F.col("prob") == p).select("quantile").scalar()
    return df.withColumn(f"{column}_filled", F.coalesce(F.col(column).cast("double"), at(0.5))) \
        .withColumn(f"{column}_high", (F.col(f"{column}_filled") > at(0.75)).cast("int"))


def quantile_bins(df: DataFrame, column: str, bins: int) -> DataFrame:
    """Number of the equal-frequency bin of each value, from 0; nulls have none.

    Edges are exact interpolated quantiles; equal edges are one, and a value on
    an edge belongs to the lower bin.
    """
    edges = exact_quantiles(df, column, [i / bins for i in range(1, bins)]).agg(F.array_sort(F.collect_set("quantile")).alias("e")).scalar()
    value = F.col(column).cast("double")
    return df.withColumn("_edges", edges).withColumn(f"{column}_bin", F.when(value.isNotNull(), F.size(F.filter("_edges", lambda e: e < value)))).drop("_edges")


def corr_matrix(df: DataFrame, columns: list[str]) -> DataFrame:
    """Pearson correlation of every column pair from one pass of sums."""
    pairs = [(a, b) for i, a in enumerate(columns) for b in columns[i:]]
    one = df.agg(*[F.try_divide(F.covar_pop(a, b), F.stddev_pop(a) * F.stddev_pop(b)).alias(f"{a}|{b}") for a, b in pairs])
    return one.select(F.inline(F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), F.col(f"`{a}|{b}`").alias("r")) for a, b in pairs])))


def stratified_split(df: DataFrame, key: str, label: str, ratios: tuple[float, float] = (0.70, 0.15), rows: int = RANGE_ROWS) -> DataFrame:
    """train / valid / test by the position of a row's key hash within its label.

    Positions come from counts per hash bucket plus an in-bucket rank, so no
    label is ordered in one task. A bucket is a prefix of the hash, as many bits
    as leave about ``rows`` rows in it; the split does not depend on it.
    """
    bits = (parts_for(df.count(), rows) - 1).bit_length()
    h = df.withColumn("_h", F.xxhash64(F.lit("split"), F.col(key))).withColumn("_b", F.floor(F.col("_h") / float(2 ** (64 - bits))).cast("long"))
    counts = h.groupBy(label, "_b").agg(F.count("*").alias("_n"))
    w = W.partitionBy(label)  # one row per bucket
    base = counts.select(label, "_b", (F.sum("_n").over(w.orderBy("_b").rowsBetween(W.unboundedPreceding, 0)) - F.col("_n")).alias("_o"), F.sum("_n").over(w).alias("_all"))
    pos = (F.row_number().over(W.partitionBy(label, "_b").orderBy("_h", key)) - 1 + F.col("_o")) / F.col("_all")
    share = h.join(base, [label, "_b"]).withColumn("_p", pos)
    return share.withColumn("split", F.when(F.col("_p") < ratios[0], "train").when(F.col("_p") < sum(ratios), "valid").otherwise("test")) \
        .drop("_h", "_b", "_o", "_all", "_p")


def temporal_split(df: DataFrame, ts: str, train: float = 0.8) -> DataFrame:
    """train / test at the time quantile."""
    x = df.withColumn("_s", F.unix_micros(F.col(ts).cast("timestamp")).cast("double"))
    cut = exact_quantiles(x, "_s", [train]).select("quantile").scalar()
    return x.withColumn("split", F.when(F.col("_s") <= cut, "train").otherwise("test")).drop("_s")


def class_weights(df: DataFrame, label: str) -> DataFrame:
    """Inverse-frequency weight per row (the class table has one row per class)."""
    c = df.groupBy(label).agg(F.count("*").alias("_n"))
    total, k = df.agg(F.count("*").alias("t")).scalar(), c.agg(F.count("*").alias("k")).scalar()
    return df.join(c, label).withColumn("weight", total / (k * F.col("_n"))).drop("_n")


def tfidf(df: DataFrame, key: str, text: str, min_df: int = 3, max_df: float = 0.95, bigrams: bool = True,
          stop_words: tuple[str, ...] = ()) -> DataFrame:
    """(key, term, tf, df, weight) with tf x (ln((1 + n) / (1 + df)) + 1), for 1- and 2-grams in range.

    Stop words go before the 2-grams are made, so a 2-gram may span them.
    """
    words = F.filter(F.split(F.lower(F.col(text)), r"[^\p{L}\p{N}]+"), lambda w: (F.length(w) > 1) & ~w.isin(*stop_words) if stop_words else F.length(w) > 1)
    t = df.select(key, words.alias("w"))
    grams = F.col("w")
    if bigrams:
        two = F.when(F.size("w") > 1, F.zip_with(F.slice("w", 1, F.greatest(F.size("w") - 1, F.lit(0))), F.slice("w", 2, F.greatest(F.size("w") - 1, F.lit(0))),
                                                 lambda a, b: F.concat_ws(" ", a, b))).otherwise(F.array().cast("array<string>"))
        grams = F.concat(F.col("w"), two)
    tf = t.select(key, F.explode(grams).alias("term")).groupBy(key, "term").agg(F.count("*").alias("tf"))
    n = df.agg(F.count("*").alias("n")).scalar()
    terms = tf.groupBy("term").agg(F.count("*").alias("df")).where((F.col("df") >= min_df) & (F.col("df") <= max_df * n))
    return tf.join(terms, "term").select(key, "term", "tf", "df", (F.col("tf") * (F.log((1 + n) / (1 + F.col("df"))) + 1)).alias("weight"))
