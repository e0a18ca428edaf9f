"""Projections over days, content plans and posting dates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def impacts(content: DataFrame, as_of: str, days: int = 30) -> DataFrame:
    """SEQ-02 and JOIN-10: the strongest content of each day ahead: the predicted index, else score / 50, else 1."""
    value = F.coalesce("rpi", F.col("score") / 50, F.lit(1.0))
    ahead = F.datediff("scheduled", F.lit(as_of).cast("date"))
    rows = content.withColumn("day", ahead).where(F.col("day").between(1, days))
    return rows.groupBy("business_id", "day").agg(F.max(value).alias("rpi"))


def follower_projection(businesses: DataFrame, impact: DataFrame, as_of: str, days: int = 30) -> DataFrame:
    """SEQ-01: followers day by day: a base rate that compounds, and gains from strong content. A fold over the days of each row.

    Returns business_id, day, date, followers, daily_gain, scenario.
    """
    by_day = impact.groupBy("business_id").agg(F.map_from_entries(F.collect_list(F.struct("day", "rpi"))).alias("impacts"))
    rows = businesses.join(by_day, "business_id", "left")
    start = F.struct(F.col("followers").cast("double").alias("count"), F.expr("cast(array() as array<struct<day: int, followers: bigint, daily_gain: bigint, scenario: string>>)").alias("out"))

    def step(s: Column, d: Column) -> Column:
        rpi = F.try_element_at(F.col("impacts"), d)
        part = F.when(rpi > 1.5, (rpi - 1) * 0.005).when(rpi > 1.1, (rpi - 1) * 0.001).otherwise(0.0)
        scenario = F.when(rpi > 1.5, "viral_spike").when(rpi > 1.1, "high_performance").otherwise("organic")
        gain = s["count"] * F.col("rate") + s["count"] * part
        after = s["count"] + gain
        day = F.struct(d.alias("day"), after.cast("bigint").alias("followers"), gain.cast("bigint").alias("daily_gain"), scenario.alias("scenario"))
        return F.struct(after.alias("count"), F.concat(s["out"], F.array(day)).alias("out"))

    folded = F.aggregate(F.sequence(F.lit(1), F.lit(days)), start, step, lambda s: s["out"])
    made = rows.select("business_id", F.explode(folded).alias("x")).select("business_id", "x.*")
    return made.withColumn("date", F.date_add(F.lit(as_of).cast("date"), F.col("day")))


def content_plan(businesses: DataFrame, mix: DataFrame) -> DataFrame:
    """SEQ-09: pieces of each business by platform and format: shares of ``posts_per_month`` rounded down, the rest to the largest."""
    rows = businesses.withColumn("platform", F.explode("platforms")).join(F.broadcast(mix), "platform")
    each = F.floor(F.col("posts_per_month") / F.size("platforms"))
    count = F.floor(each * F.col("percent") / 100)
    planned = rows.withColumn("pieces", count.cast("int"))
    return planned.where("pieces > 0").select("business_id", "platform", "content_format", F.explode(F.sequence(F.lit(1), F.col("pieces"))).alias("piece"))


def posting_date(month: Column, index: Column, total: Column) -> Column:
    """SEQ-10: days of the month spaced evenly, none beyond its end."""
    size = F.day(F.last_day(month))
    gap = F.greatest(F.floor(size / F.greatest(total, F.lit(1))), F.lit(1))
    return F.least(F.date_add(F.trunc(month, "month"), (index * gap).cast("int")), F.last_day(month))


def posting_time(rows: DataFrame, patterns: DataFrame, defaults: dict[str, str]) -> DataFrame:
    """SEQ-11: the business's first known time, else its platform's."""
    first = patterns.where("pattern_type = 'time'").groupBy("business_id").agg(F.min_by("name", "pattern_id").alias("_time"))
    default = F.lit("12:00")
    for platform, time in defaults.items():
        default = F.when(F.col("platform") == platform, time).otherwise(default)
    return rows.join(first, "business_id", "left").withColumn("posting_time", F.coalesce("_time", default)).drop("_time")


def cold_start(energy: Column, face: Column, kind: Column, hour: Column, tempo: Column, cuts: Column, base: float = 0.6) -> Column:
    """ML-08: a score from rules of thumb, 0 to 2.5."""
    e = F.coalesce(energy, F.lit(0.5))
    made = F.lit(base) + F.when(e >= 0.7, 0.4).when(e >= 0.4, 0.2).otherwise(-0.2) + F.when(F.coalesce(face, F.lit(0)) != 0, 0.2).otherwise(0.0)
    made = made + F.when(kind == "reel", 0.25).when(kind == "video", 0.15).when(kind == "carousel", 0.05).when(kind == "static", -0.05).otherwise(0.0)
    made = made + F.when(hour.between(12, 21), 0.15).when(hour.between(8, 23), 0.05).otherwise(-0.1)
    t, c = F.coalesce(tempo, F.lit(0.0)), F.coalesce(cuts, F.lit(0.0))
    made = made + F.when(t.between(100, 140), 0.1).when(t.between(80, 160), 0.05).otherwise(0.0) + F.when(c.between(20, 60), 0.1).otherwise(0.0)
    return F.least(F.greatest(made, F.lit(0.0)), F.lit(2.5))


def fallback_score(emoji: Column, cta: Column, question: Column, reel: Column) -> Column:
    """ML-09: 50 and points for what helps, 20 to 95."""
    points = F.lit(50) + F.when(emoji > 0, 5).otherwise(0) + F.when(cta > 0, 10).otherwise(0) + F.when(question > 0, 8).otherwise(0) + F.when(reel > 0, 12).otherwise(0)
    return F.least(F.greatest(points, F.lit(20)), F.lit(95))


def idea_relevance(difficulty: Column, minutes: Column, same_platform: Column) -> Column:
    """TOP-14: easy, quick ideas for the platform first."""
    made = F.lit(0.5) + F.when(difficulty == "easy", 0.2).when(difficulty == "medium", 0.1).otherwise(0.0)
    return F.least(made + F.when(minutes <= 30, 0.15).otherwise(0.0) + F.when(same_platform, 0.15).otherwise(0.0), F.lit(1.0))
