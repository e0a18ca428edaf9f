"""Accounts, competitors and experiments: health, activity, relevance, rankings and roll-ups."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.operators.baselines import latest
from tidemark.operators.ranks import quantiles


def health(posts: DataFrame, authors: DataFrame, recent: int = 10, least: int = 5) -> DataFrame:
    """AGG-03: views of the latest posts against followers, authority band, health and prediction penalty.

    Too few posts, counted before those without views are left out, or none with views, is insufficient data.
    """
    newest = latest(posts, "author_id", recent, [F.desc("posted_at"), F.desc("post_id")])
    seen = F.when(F.col("views") > 0, F.col("views"))
    made = newest.groupBy("author_id").agg(F.count("*").alias("n"), F.avg(seen).alias("avg_views"), F.stddev_pop(seen).alias("std_views"))
    rows = authors.select("author_id", "followers").join(made, "author_id", "left")
    enough = (F.coalesce("n", F.lit(0)) >= least) & F.col("avg_views").isNotNull()
    ratio = F.col("avg_views") / F.greatest(F.col("followers"), F.lit(1))
    band = F.when(~enough, "normal").when(ratio >= 0.2, "high").when(ratio >= 0.1, "normal").when(ratio >= 0.02, "low").otherwise("critical")
    state = F.when(~enough, "insufficient_data").when(F.col("authority_level") == "low", "low_authority").when(F.col("authority_level") == "critical", "possible_shadowban").otherwise("healthy")
    penalty = F.when(F.col("authority_level") == "low", 0.3).when(F.col("authority_level") == "critical", 0.1).otherwise(1.0)
    zero = lambda c: F.when(enough, F.col(c)).otherwise(0.0)
    return rows.withColumn("authority_level", band).select(
        "author_id",
        "followers",
        F.coalesce("n", F.lit(0)).alias("posts_analyzed"),
        zero("avg_views").alias("avg_views"),
        zero("std_views").alias("std_views"),
        F.when(enough, ratio).otherwise(0.0).alias("views_to_followers_ratio"),
        "authority_level",
        state.alias("health_status"),
        penalty.alias("penalty_factor"),
    )


def calibrated(predictions: DataFrame, healths: DataFrame) -> DataFrame:
    """ML-13: predictions (author_id, rpi_score, rpi_raw) under their account's penalty."""
    rows = predictions.join(healths.select("author_id", "penalty_factor"), "author_id", "left")
    penalty = F.coalesce("penalty_factor", F.lit(1.0))
    lower = F.when(penalty > 0, F.col("rpi_score") + F.log(penalty)).otherwise(F.col("rpi_score") - 2.0)
    return rows.withColumns({"calibrated_raw": F.col("rpi_raw") * penalty, "calibrated_score": lower}).drop("penalty_factor")


def recency(days: Column, late: bool) -> Column:
    made = F.when(days <= 3, 100).when(days <= 7, 90).when(days <= 14, 75).when(days <= 30, 50).when(days <= 60, 25)
    return (made.when(days <= 90, 10) if late else made).otherwise(0)


def activity_status(days: Column, monthly: Column) -> Column:
    return (
        F.when(days.isNull() | (days < 0), "unknown")
        .when((days <= 7) & (monthly >= 2), "active")
        .when((days <= 30) & (monthly >= 1), "moderately_active")
        .when(days <= 90, "inactive")
        .otherwise("dormant")
    )


def activity(posts: DataFrame, as_of: str, key: str = "author_id", late: bool = False) -> DataFrame:
    """AGG-06: last post, days since, posts of 30 days, score (recency 40, frequency 40, volume 20 %) and status.

    ``late`` gives the discovery rule: 10 points for 61 to 90 days, one decimal; else the score is a whole number.
    """
    now = F.lit(as_of).cast("timestamp")
    made = posts.where(F.col("posted_at").isNotNull()).groupBy(key).agg(
        F.max("posted_at").alias("last_post_date"), F.count_if(F.col("posted_at") >= now - F.expr("interval 30 days")).alias("posts_last_month"), F.count("*").alias("total_posts")
    )
    days = F.floor((F.unix_timestamp(now) - F.unix_timestamp(F.col("last_post_date").cast("timestamp"))) / 86400).cast("int")
    score = recency(F.col("days_since_last_post"), late) * 0.4 + F.least(F.col("posts_last_month") * 12.5, F.lit(100.0)) * 0.4 + F.least(F.col("total_posts") * 10, F.lit(100)) * 0.2
    made = made.withColumn("days_since_last_post", days)
    return made.withColumns(
        {"activity_score": F.round(score, 1) if late else F.floor(score), "activity_status": activity_status(F.col("days_since_last_post"), F.col("posts_last_month"))}
    )


def relevance(text: Column, places: list[str], niches: list[str], followers: Column, business: Column, category: Column, verified: Column) -> dict[str, Column]:
    """TOP-10: 30 for each place and 20 for each niche word found, with bonuses, 0 to 100, and what was found."""
    found = lambda words: F.filter(F.array(*[F.lit(w.lower()) for w in words]), lambda w: F.contains(text, w))
    where, what = found(places), found(niches)
    points = (
        F.size(where) * 30 + F.size(what) * 20 + F.when(business, 15).otherwise(0) + F.when(F.coalesce(category, F.lit("")) != "", 10).otherwise(0)
        - F.when(verified, 20).otherwise(0) + F.when(followers.between(1000, 15000), 10).otherwise(0)
    )
    return {
        "relevance_score": F.least(F.greatest(points, F.lit(0)), F.lit(100)).cast("double"),
        "location_detected": F.coalesce(F.try_element_at(where, F.lit(1)), F.lit("")),
        "niche_detected": F.array_join(F.slice(what, 1, 3), ", "),
    }


def discovery(profiles: DataFrame, least: int, most: int, days: int, monthly: int, activity_score: float, output: int) -> DataFrame:
    """TOP-09: profiles within size and activity, with a place or niche found, by 0.6 relevance + 0.4 activity."""
    known = F.coalesce("days_since_last_post", F.lit(-1)) >= 0
    active = ~known | ((F.col("days_since_last_post") <= days) & (F.col("posts_last_month") >= monthly) & (F.col("activity_score") >= activity_score))
    kept = profiles.where(F.col("followers").between(least, most) & active & ((F.col("location_detected") != "") | (F.col("niche_detected") != "")))
    rank = F.col("relevance_score") * 0.6 + F.coalesce("activity_score", F.lit(0)) * 0.4
    return kept.withColumn("rank_score", rank).orderBy(F.desc("rank_score"), "username").limit(output)


# Reasons that a discovered account is shown with.
REASON_NICHE, REASON_PLACE, REASON_ACTIVE, REASON_NONE = "🎯 Niche Match", "📍 Location Match", "🔥 Very Active", "Exploración general"


def hashtag_discovery(posts: DataFrame, niches: list[str], places: list[str], least: int, most: int, as_of: str, order: list[Column], days: int | None = None, output: int = 50) -> DataFrame:
    """TOP-11: accounts met by their posts (username, followers, posted_at, caption), with the score and reasons of this search.

    An account is its first post, by ``order``, that passes the size and, with ``days``, the activity filter; users without a
    name are left out, and unknown times count as 999 days ago. 25 for a niche word, 30 for a place, 15 for activity within a
    week, 10 for 1,000 to 50,000 followers, and 10 for all.
    """
    user = F.lower(F.trim("username"))
    since = F.coalesce(F.datediff(F.lit(as_of).cast("date"), F.to_date("posted_at")), F.lit(999))
    rows = posts.withColumns({"username": user, "days_since": since}).where((F.coalesce("username", F.lit("")) != "") & F.col("followers").between(least, most))
    if days is not None:
        rows = rows.where(F.col("days_since") <= days)
    first = F.row_number().over(Window.partitionBy("username").orderBy(*order))
    rows = rows.withColumn("_p", first).where("_p = 1").drop("_p")
    text = F.lower(F.concat_ws(" ", F.coalesce("caption", F.lit("")), "username"))
    has = lambda words: F.exists(F.array(*[F.lit(w.lower()) for w in words]), lambda w: F.contains(text, w)) if words else F.lit(False)
    niche, place, very = has(niches), has(places), F.col("days_since") <= 7
    points = lambda c, n: F.when(c, n).otherwise(0)
    reasons = F.array_compact(F.array(F.when(niche, F.lit(REASON_NICHE)), F.when(place, F.lit(REASON_PLACE)), F.when(very, F.lit(REASON_ACTIVE)), F.when(~niche & ~place, F.lit(REASON_NONE))))
    made = rows.select(
        "username", "followers", "days_since", F.when(very, "Very Active").when(F.col("days_since") <= 30, "Active").otherwise("Inactive").alias("activity_status"),
        (points(niche, 25) + points(place, 30) + points(very, 15) + points(F.col("followers").between(1000, 50000), 10) + 10).alias("relevance_score"), reasons.alias("match_reasons"),
    )
    return made.orderBy(F.desc("relevance_score"), "username").limit(output)


def experiment_statistics(logs: DataFrame) -> DataFrame:
    """AGG-07: logs (delta, high, predicted, actual) in one row."""
    error = F.col("actual") - F.col("predicted")
    return logs.agg(
        F.count("*").alias("total"),
        F.count_if("high").alias("high_priority"),
        F.avg("delta").alias("mean_delta"),
        F.avg(error).alias("bias"),
        F.sqrt(F.avg(error * error)).alias("rmse"),
        F.avg(F.abs(error)).alias("mae"),
        (F.count_if(F.abs("delta") <= 20) / F.count("*") * 100).alias("within_20"),
    )


def feedback_statistics(logs: DataFrame) -> DataFrame:
    """AGG-08."""
    over, under = F.count_if(F.col("delta") < -20), F.count_if(F.col("delta") > 20)
    return logs.agg(
        F.count("*").alias("total"), F.avg("delta").alias("mean_delta"), F.stddev_pop("delta").alias("std_delta"),
        over.alias("overestimated"), under.alias("underestimated"),
        F.when(F.avg("delta") > 5, "underestimating").when(F.avg("delta") < -5, "overestimating").otherwise("balanced").alias("bias"),
    )


def status_counts(competitors: DataFrame, key: str, status: str, values: list[str]) -> DataFrame:
    """AGG-22: a column for each status, and whether any is completed."""
    counts = [F.count_if(F.col(status) == v).alias(v) for v in values]
    return competitors.groupBy(key).agg(F.count("*").alias("total"), *counts).withColumn("ready", F.col("completed") > 0)


def profile_averages(posts: DataFrame, key: str = "author_id") -> DataFrame:
    """AGG-23."""
    mean = lambda c: F.avg(F.coalesce(F.col(c), F.lit(0))).alias(f"avg_{c}")
    return posts.groupBy(key).agg(mean("likes"), mean("comments"))


def calendar_list(calendars: DataFrame, content: DataFrame) -> DataFrame:
    """AGG-25: calendars with their piece counts, newest first, in one join."""
    counts = content.groupBy("calendar_id").agg(F.count("*").alias("pieces"))
    made = calendars.join(counts, "calendar_id", "left").withColumn("pieces", F.coalesce("pieces", F.lit(0)))
    return made.orderBy(F.desc("created_at"), "calendar_id")


def calendar_summary(content: DataFrame, platforms: list[str], formats: list[str]) -> DataFrame:
    """AGG-32: counts by platform and format, the mean score, and the three best pieces of each calendar."""
    by = [F.count_if(F.col("platform") == p).alias(f"platform_{p}") for p in platforms] + [F.count_if(F.col("content_format") == f).alias(f"format_{f}") for f in formats]
    place = F.row_number().over(Window.partitionBy("calendar_id").orderBy(F.desc("engagement_score"), "content_id"))
    ranked = content.withColumn("_place", place)
    best = F.array_sort(F.collect_list(F.when(F.col("_place") <= 3, F.struct("_place", "content_id"))))
    return ranked.groupBy("calendar_id").agg(F.count("*").alias("pieces"), F.avg("engagement_score").alias("avg_score"), *by, F.transform(best, lambda b: b["content_id"]).alias("top_pieces"))


def competitor_analysis(posts: DataFrame, patterns: DataFrame, top: int = 10) -> DataFrame:
    """AGG-20: each competitor's best posts and winning patterns, formats and hashtags as sorted sets."""
    best = latest(posts, "competitor_id", top, [F.desc("engagement_score"), F.asc("post_id")])
    rows = best.groupBy("competitor_id").agg(
        F.transform(F.array_sort(F.collect_list(F.struct((-F.col("engagement_score")).alias("s"), "post_id"))), lambda x: x["post_id"]).alias("top_posts"),
        F.array_sort(F.collect_set("content_format")).alias("formats"),
        F.avg("engagement_score").alias("avg_top_score"),
    )
    kinds = patterns.groupBy("competitor_id").agg(*[F.array_sort(F.collect_set(F.when(F.col("pattern_type") == k, F.col("name")))).alias(f"{k}s") for k in ("hook", "cta", "time", "hashtag")])
    return rows.join(kinds, "competitor_id", "left")


def pattern_summary(patterns: DataFrame, top: int = 10) -> tuple[DataFrame, DataFrame]:
    """AGG-21: counts and the best of each type; and the ``top`` patterns by confidence, then engagement."""
    best = F.max_by("name", F.struct("confidence_score", "avg_engagement_score", "name"))
    types = patterns.groupBy("pattern_type").agg(F.count("*").alias("n"), best.alias("best"))
    return types, patterns.orderBy(F.desc("confidence_score"), F.desc("avg_engagement_score"), "name").limit(top)


def trigger_ranking(rows: DataFrame, triggers: list[str], by: str = "engagement", top: int = 3) -> DataFrame:
    """AGG-24: mean of each trigger among rows above the median, the best first; one row for each trigger."""
    high = rows.where(F.col(by) > F.lit(quantiles(rows, by, [0.5])[0]).cast("double"))
    pairs = F.explode(F.array(*[F.struct(F.lit(t).alias("trigger"), F.col(t).cast("double").alias("v")) for t in triggers])).alias("x")
    return high.select(pairs).groupBy("x.trigger").agg(F.avg("x.v").alias("mean")).orderBy(F.desc("mean"), "trigger").limit(top)


def insight_scores(media: DataFrame) -> DataFrame:
    """AGG-26: frames (video_id, t, diff, cut, face, brightness) as one row for each video."""
    hook = F.col("t") <= 3
    seconds = F.max("t")
    cuts = lambda c: F.count_if(F.col("cut") & c)
    return media.groupBy("video_id").agg(
        F.coalesce(F.avg(F.when(hook, F.col("diff"))), F.lit(0.0)).alias("hook_energy"),
        F.coalesce(F.avg(F.when(~hook, F.col("diff"))), F.lit(0.0)).alias("retention_energy"),
        F.when(seconds > 0, cuts(F.lit(True)) / seconds).otherwise(0.0).alias("cuts_per_second"),
        (cuts(hook) / 3 * 10).alias("hook_cut_rate"),
        F.max(F.when(F.col("face") & hook, 1).otherwise(0)).alias("face_in_hook"),
        F.stddev_pop("brightness").alias("brightness_std"),
        F.count("*").alias("frames"),
    )


def instability(media: DataFrame, shake: float = 0.6, full: float = 0.8) -> DataFrame:
    """AGG-27: mean motion and its spread as instability, the share of shaky frames, quality, and a penalty that grows between
    ``shake`` and ``full``."""
    made = media.groupBy("video_id").agg(F.avg("motion").alias("m"), F.stddev_pop("motion").alias("s"), F.avg((F.col("motion") > shake).cast("double")).alias("shake_ratio"))
    score = F.least(F.lit(1.0), F.col("m") * 0.6 + F.col("s") * 0.4)
    part = F.least(F.lit(1.0), F.greatest(F.lit(0.0), (F.col("instability") - shake) / (full - shake)))
    return made.withColumn("instability", score).withColumn("production_quality", 1 - F.col("instability")).withColumn("penalty", 1 - part * 0.3).drop("m", "s")


def detected_text(detections: DataFrame, confidence: float = 0.5) -> DataFrame:
    """AGG-28: detections (video_id, frame, seq, text, conf, area) above a confidence: boxes, mean area, text in first-seen order."""
    kept = detections.where(F.col("conf") >= confidence)
    texts = F.transform(F.array_sort(F.collect_list(F.struct("frame", "seq", "text"))), lambda x: x["text"])
    return kept.groupBy("video_id").agg(F.count("*").alias("boxes"), F.sum("area").alias("area"), F.array_join(F.array_distinct(texts), " ").alias("text"))


def contributions(rows: DataFrame, top: int, embedding_prefix: str = "emb_") -> DataFrame:
    """AGG-29: mean absolute contribution of each feature, embeddings as one, the ``top`` first."""
    name = F.when(F.startswith("feature", F.lit(embedding_prefix)), "semantic").otherwise(F.col("feature"))
    summed = rows.groupBy("row_id", name.alias("feature")).agg(F.sum("value").alias("value"))
    return summed.groupBy("feature").agg(F.avg(F.abs("value")).alias("importance")).orderBy(F.desc("importance"), "feature").limit(top)


def factors(rows: DataFrame, most: int = 3) -> DataFrame:
    """AGG-33: each row's strongest positive and negative features as text."""
    up = F.row_number().over(Window.partitionBy("row_id").orderBy(F.desc("value"), "feature"))
    down = F.row_number().over(Window.partitionBy("row_id").orderBy(F.asc("value"), "feature"))
    kept = rows.withColumns({"up": up, "down": down})
    names = lambda place, sign: F.array_join(
        F.transform(F.array_sort(F.collect_list(F.when((F.col(place) <= most) & (F.col("value") * sign > 0), F.struct(place, "feature")))), lambda x: x["feature"]), ", "
    )
    return kept.groupBy("row_id").agg(names("up", 1).alias("positive"), names("down", -1).alias("negative"))


def weighted_factors(rows: DataFrame, weights: DataFrame, top: int = 10) -> DataFrame:
    """AGG-34: contributions (target, feature, value) by absolute impact times the target's weight, each feature's best, ranked."""
    impact = F.abs("value") * F.col("weight")
    best = rows.join(F.broadcast(weights), "target").withColumn("impact", impact)
    best = latest(best, "feature", 1, [F.desc("impact"), F.asc("target")])
    return best.select("feature", "target", "impact").orderBy(F.desc("impact"), "feature").limit(top)
