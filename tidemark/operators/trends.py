"""Trend velocity: shares of samples by age, status, score, acceleration and peak day."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.operators.ranks import numbered

# Ages in hours, shares that make a status, and weights of the velocity.
RECENT, WEEK, OLD = 48, 168, 336
TRENDING, RISING, STALE = 0.5, 0.3, 0.8


def velocity(samples: DataFrame, least: int = 5) -> DataFrame:
    """AGG-04: samples (trend, age_hours, likes) as one row for each trend. Under ``least`` samples a trend is unknown, and fresh.

    Ages between one and two weeks count in the total only.
    """
    age = F.col("age_hours")
    counts = samples.groupBy("trend").agg(
        F.count("*").alias("n"), F.count_if(age <= RECENT).alias("n48"), F.count_if((age > RECENT) & (age <= WEEK)).alias("nweek"),
        F.count_if(age > OLD).alias("nold"), F.avg("likes").alias("avg_engagement"),
    )
    known = F.col("n") >= least
    share = lambda c: F.when(known, F.col(c) / F.col("n")).otherwise(0.0)
    rows = counts.select("trend", "n", share("n48").alias("pct_last_48h"), share("nweek").alias("pct_last_week"), share("nold").alias("pct_older_2weeks"), F.when(known, F.col("avg_engagement")).otherwise(0.0).alias("avg_engagement"))
    status = (
        F.when(~known, "unknown").when(F.col("pct_older_2weeks") >= STALE, "stale").when(F.col("pct_last_48h") >= TRENDING, "trending")
        .when(F.col("pct_last_48h") + F.col("pct_last_week") >= RISING, "rising").otherwise("stable")
    )
    total = F.col("pct_last_48h") * 3 + F.col("pct_last_week") - F.col("pct_older_2weeks") * 2
    score = F.when(total >= 0, F.least(total / 3, F.lit(1.0))).otherwise(F.greatest(total / 2, F.lit(-1.0)))
    return rows.withColumns({"status": status, "velocity_score": score, "is_fresh": status != "stale", "is_stale": status == "stale"})


def peak_day(samples: DataFrame) -> DataFrame:
    """AGG-05: the first of the days with the most samples."""
    days = samples.groupBy("trend", F.to_date("posted_at").alias("day")).agg(F.count("*").alias("n"))
    place = F.row_number().over(Window.partitionBy("trend").orderBy(F.desc("n"), "day"))
    return days.withColumn("p", place).where("p = 1").select("trend", F.col("day").alias("peak_day"), "n")


def acceleration(samples: DataFrame, ident: str = "event_id", least: int = 10) -> DataFrame:
    """WIN-09: the relative change of density from the earlier half of a trend's samples to the later. Samples are numbered over
    ranges, so a trend is many tasks; a NULL trend is one."""
    placed = numbered(samples.select("trend", "posted_at", ident), ["trend"], [F.col("posted_at"), F.col(ident)])
    sizes = placed.groupBy(F.col("trend").alias("_trend")).agg(F.count("*").alias("n"))
    rows = placed.join(sizes, F.col("trend").eqNullSafe(F.col("_trend")))
    late = F.col("place") >= F.floor(F.col("n") / 2)
    hours = F.unix_micros(F.col("posted_at").cast("timestamp")) / 3.6e9
    ends = lambda c: F.max(F.when(c, hours)) - F.min(F.when(c, hours))
    halves = rows.groupBy("trend").agg(F.max("n").alias("n"), F.count_if(~late).alias("n1"), F.count_if(late).alias("n2"), ends(~late).alias("span1"), ends(late).alias("span2"))
    first, second = F.col("n1") / F.col("span1"), F.col("n2") / F.col("span2")
    made = F.when((F.col("n") >= least) & (F.col("span1") > 0) & (F.col("span2") > 0), (second - first) / first).otherwise(0.0)
    return halves.select("trend", "n", made.alias("acceleration"))


def fresh(velocities: DataFrame) -> DataFrame:
    """TOP-12: what isn't stale, fastest first."""
    return velocities.where("is_fresh").orderBy(F.desc("velocity_score"), "trend")


def recipe_elements(elements: DataFrame, velocities: DataFrame, recipe: str = "recipe_id") -> DataFrame:
    """TOP-12: a recipe's elements (kind: audio or hashtag, name) as validated or filtered, each list of a recipe and kind in order.

    Elements without samples are fresh and unknown. Validated ones stand fastest first, filtered ones by name.
    """
    rows = elements.join(velocities.select(F.col("trend").alias("name"), "status", "velocity_score", "is_stale"), "name", "left")
    stale = F.coalesce("is_stale", F.lit(False))
    rows = rows.withColumns({"list": F.when(stale, "filtered").otherwise("validated"), "status": F.coalesce("status", F.lit("unknown")), "velocity_score": F.coalesce("velocity_score", F.lit(0.0))})
    own = Window.partitionBy(recipe, "kind", "list").orderBy(F.desc(F.when(F.col("list") == "validated", F.col("velocity_score"))), "name")
    return rows.select(recipe, "kind", "name", "list", "status", "velocity_score", F.row_number().over(own).alias("place"))


def ideas_with_status(ideas: DataFrame, velocities: DataFrame) -> DataFrame:
    """TOP-15: ideas (idea_id, trend, potential) with their trend's status; stale ones go, rising ones are worth more."""
    rows = ideas.join(velocities.select("trend", "status", "velocity_score"), "trend", "left").withColumn("status", F.coalesce("status", F.lit("unknown")))
    return rows.where("status <> 'stale'").withColumn("potential", F.when(F.col("status").isin("rising", "trending"), "high").otherwise(F.col("potential")))
