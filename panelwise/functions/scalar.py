"""Scalar column functions: distances, calendar parts, text shape, lexicon score."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

EARTH_KM = 6371.0

# --- frustration lexicon (fixed values) ------------------------------------------
FRUSTRATION = [
    "escalat", "frustrat", "angry", "angrier", "disappoint", "unacceptable", "refund", "cancel", "cancel my", "terrible",
    "worst", "horrible", "never again", "fed up", "sick of", "complaint", "complain", "unhappy", "furious", "outraged",
    "ridiculous", "absurd", "manager", "supervisor", "executive", "legal", "lawyer", "escalation", "escalate", "speak to",
    "speak with",
]
CALM = ["thank", "thanks", "great", "helpful", "resolved", "appreciate", "question", "inquiry", "info", "information"]


def haversine_km(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    a = F.pow(F.sin(F.radians(lat2 - lat1) / 2), 2) + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.pow(F.sin(F.radians(lon2 - lon1) / 2), 2)
    return 2 * EARTH_KM * F.asin(F.sqrt(F.least(F.lit(1.0), a)))


def calendar_features(df: DataFrame, ts: str) -> DataFrame:
    c = F.col(ts)
    return df.withColumns({
        "dow": F.weekday(c), "month": F.month(c), "hour": F.hour(c), "day": F.dayofmonth(c),
        "month_end": (F.datediff(F.last_day(c), c) <= 2).cast("int"), "weekend": (F.weekday(c) >= 5).cast("int")})


def text_shape(df: DataFrame, col: str) -> DataFrame:
    """Length, words, mean word length, digit, percent and upper-case signals of the whole text."""
    c = F.col(col)
    words = F.filter(F.split(c, r"\s+"), lambda w: w != "")
    letters = F.length(F.regexp_replace(c, r"\s+", ""))
    n = F.length(c)
    return df.withColumns({
        "n_characters": n, "n_words": F.size(words), "mean_word_length": F.coalesce(F.try_divide(letters, F.size(words)), F.lit(0.0)),
        "has_digit": c.rlike(r"\p{Nd}").cast("int"), "has_percent": F.contains(c, F.lit("%")).cast("int"),
        "upper_ratio": F.regexp_count(c, F.lit(r"\p{Lu}")) / F.greatest(n, F.lit(1)),
        "exclamations": n - F.length(F.replace(c, F.lit("!"), F.lit(""))), "questions": n - F.length(F.replace(c, F.lit("?"), F.lit("")))})


def lexicon_score(df: DataFrame, col: str, negative: list[str] = FRUSTRATION, positive: list[str] = CALM) -> DataFrame:
    """+8 per negative stem contained, -3 per positive one, x 0.7 for short text, clamped to 0..100.

    ``matched`` names the negative stems, then the positive ones as
    ``neutral:<stem>``; a text without anything but blanks has ``no_text``.
    The text is lower-cased once and searched for all stems in one pass each.
    """
    lowered = df.withColumn("_low", F.lower(F.col(col)))

    def found(stems: list[str], prefix: str = "") -> Column:
        return F.array_compact(F.array(*[F.when(F.contains(F.col("_low"), F.lit(s)), F.lit(prefix + s)) for s in stems]))

    d = lowered.withColumn("_n", found(negative)).withColumn("_p", found(positive, "neutral:"))
    raw = (8.0 * F.size("_n") - 3.0 * F.size("_p")) * F.when(F.length(col) < 20, 0.7).otherwise(1.0)
    s = F.greatest(F.lit(0.0), F.least(F.lit(100.0), raw))
    blank = F.coalesce(F.trim(F.col(col)) == "", F.lit(True))
    scored = d.withColumn("matched", F.when(blank, F.array(F.lit("no_text"))).otherwise(F.concat("_n", "_p"))) \
        .withColumn("score", F.when(blank, 0.0).otherwise(s))
    bucket = F.when(F.col("score") < 15, "low").when(F.col("score") < 35, "medium").when(F.col("score") < 55, "high").otherwise("escalating_frustration")
    return scored.withColumn("bucket", bucket).drop("_low", "_n", "_p")


def sentiment_summary(scored: DataFrame) -> DataFrame:
    """One row over scored tickets: how many, how many escalating, how many at high risk, and the mean score."""
    return scored.agg(
        F.count("*").alias("tickets_analyzed"), F.count_if(F.col("bucket") == "escalating_frustration").alias("escalating_frustration_count"),
        F.count_if(F.col("bucket").isin("high", "escalating_frustration")).alias("high_risk_count"),
        F.coalesce(F.round(F.avg(F.round("score", 1)), 2), F.lit(0.0)).alias("avg_sentiment_score"))


def top_tickets(scored: DataFrame, key: str, created: str, n: int = 20) -> DataFrame:
    """The ``n`` tickets with the highest scores, oldest first among equals (a report)."""
    return scored.orderBy(F.round("score", 1).desc(), F.col(created), F.col(key)).limit(n)


def sentiment_label(df: DataFrame, score: str, text: str) -> DataFrame:
    """1-2 negative, 3 neutral, 4-5 positive; texts of ten characters or fewer are dropped."""
    s = F.col(score)
    return df.where(F.length(F.trim(F.col(text))) > 10).withColumn("label", F.when(s <= 2, 0).when(s == 3, 1).otherwise(2))
