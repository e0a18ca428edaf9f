"""Engagement metrics as column expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.config import KPI, METRICS, Weights
from tidemark.operators.ranks import quantiles

#: The names under which each metric occurs, first one present wins.
ALIASES = {
    "likes": ("likes_count", "likes", "likeCount"),
    "comments": ("comments_count", "comments", "commentCount"),
    "saves": ("saves_count", "saves", "saveCount"),
    "shares": ("shares_count", "shares", "shareCount"),
    "views": ("views_count", "views", "viewCount", "play_count"),
}


def metric(columns: list[str], name: str) -> Column:
    """The metric by its aliases among ``columns``; NULL and absent count 0."""
    found = [F.col(a).cast("double") for a in ALIASES[name] if a in columns]
    return F.coalesce(*found, F.lit(0.0))


def harmonised(posts: DataFrame) -> DataFrame:
    """Posts with the five metrics under their plain names, as doubles without NULLs."""
    return posts.withColumns({m: metric(posts.columns, m) for m in METRICS})


def weighted(weights: Weights) -> Column:
    """MET-01: the weighted sum of harmonised metrics."""
    return sum((F.col(m) * weights.of(m) for m in METRICS), F.lit(0.0))


def ratio(amount: Column, followers: Column) -> Column:
    """MET-02/05: percent of followers, 0 without followers."""
    return F.when(followers > 0, amount / followers * 100).otherwise(0.0)


def score(amount: Column, views: Column, followers: Column | None = None) -> Column:
    """MET-03 with followers, MET-04 without: 0 to 100 by views, else followers, else the size of the amount."""
    by = lambda den: F.least(amount / den * 1000, F.lit(100.0))
    made = F.when(views > 0, by(views))
    if followers is not None:
        made = made.when(followers > 0, by(followers))
    return made.when(amount > 0, F.least(F.log10(amount + 1) * 20, F.lit(100.0))).otherwise(0.0)


def follower_score(amount: Column, followers: Column) -> Column:
    """MET-05: 0 to 100 by followers only."""
    return F.when(followers > 0, F.least(amount / followers * 1000, F.lit(100.0))).otherwise(0.0)


def targets(rate_weight: Weights) -> dict[str, Column]:
    """MET-06: logarithms of the metrics and the engagement rate, over views or, without, a capped share."""
    amount = weighted(rate_weight)
    rate = F.when(F.col("views") > 0, amount / F.col("views") * 100).otherwise(F.least(F.lit(100.0), amount / 10))
    return {f"log_{m}": F.log1p(F.col(m)) for m in METRICS} | {"engagement_rate": rate}


def output_targets(columns: list[str]) -> dict[str, Column]:
    """MET-07: log1p of each metric clipped at 0; 0 for an absent one."""
    return {f"log_{m}": F.log1p(F.greatest(metric(columns, m), F.lit(0.0))) for m in METRICS}


def index(amount: Column, baseline: Column, lowest: float = 0.01, highest: float = 100.0, floor: bool = True) -> Column:
    """MET-08: the raw relative performance index, clipped. A baseline under 1 counts 1, or with ``floor`` off one of 0 or less."""
    base = F.greatest(baseline, F.lit(1.0)) if floor else F.when(baseline <= 0, 1.0).otherwise(baseline)
    return F.least(F.greatest(amount / base, F.lit(lowest)), F.lit(highest))


def from_index(score_: Column, baseline: Column) -> Column:
    """MET-09: the engagement that a logarithmic index stands for."""
    return F.expm1(score_) * baseline


def feedback_score(amount: Column, views: Column) -> Column:
    """MET-10."""
    made = F.when(views > 0, F.least(F.lit(100.0), amount / views * 1000)).otherwise(F.least(F.lit(100.0), amount / 100 * 10))
    return F.round(made, 2)


def scaled_by_quantile(posts: DataFrame, amount: Column, share: float = 0.95) -> DataFrame:
    """MET-11: ``target``, the amount over its quantile in percent, 0 to 100. The quantile is one number."""
    rows = posts.withColumn("_amount", amount)
    top = F.lit(quantiles(rows, "_amount", [share])[0]).cast("double")
    made = F.when(top > 0, F.least(F.greatest(F.col("_amount") / top * 100, F.lit(0.0)), F.lit(100.0))).otherwise(0.0)
    return rows.withColumn("target", made).drop("_amount")


def rate(number: Column, base: Column, percent: bool = False) -> Column:
    """MET-12/13: a share of a base, 0 where there is none."""
    made = number / base * 100 if percent else number / base
    return F.when(F.coalesce(base, F.lit(0)) == 0, 0.0).otherwise(made)


def kpi_index(weights: Weights = KPI) -> dict[str, Column]:
    """MET-14: weighted mean of the metrics, weighted sum, and what each metric adds."""
    amount = weighted(weights)
    mean = F.round(amount / weights.total, 2) if weights.total > 0 else F.lit(0.0)
    return {"weighted_rpi": mean, "raw_weighted_sum": F.round(amount, 2)} | {f"{m}_part": F.round(F.col(m) * weights.of(m), 2) for m in METRICS}


def plain_index(weights: Weights) -> Column:
    """MET-24: the weighted sum over the total weight, or the sum itself without weight."""
    return weighted(weights) / weights.total if weights.total > 0 else weighted(weights)


def log_index(weights: Weights = KPI, scale: float = 15.0, prefix: str = "log_") -> Column:
    """MET-15 (scale 15) and MET-16 (scale 20): the weighted mean of logarithms, scaled, 0 to 100."""
    amount = sum((F.col(prefix + m) * weights.of(m) for m in METRICS), F.lit(0.0))
    return F.least(F.greatest(amount / weights.total * scale, F.lit(0.0)), F.lit(100.0))


def top_metric(weights: Weights) -> str:
    return max(METRICS, key=weights.of)


def preview(weights: Weights) -> dict[str, Column]:
    """MET-16: the index under ``weights`` beside the default one."""
    own, default = log_index(weights, 20.0), log_index(KPI, 20.0)
    return {
        "weighted_rpi": own,
        "default_rpi": default,
        "difference": own - default,
        "percent_change": (own - default) / F.greatest(default, F.lit(1.0)) * 100,
        "top_metric": F.lit(top_metric(weights)),
    }


def relative_score(predicted: str = "", baseline: str = "avg_") -> Column:
    """MET-18: the mean ratio over the metrics whose baseline is positive; NULL if none is."""
    pairs = [F.when(F.col(baseline + m) > 0, F.col(predicted + m) / F.col(baseline + m)) for m in METRICS]
    there = F.array_compact(F.array(*pairs))
    return F.when(F.size(there) > 0, F.aggregate(there, F.lit(0.0), lambda s, x: s + x) / F.size(there))


def parsed_count(text: Column) -> Column:
    """MET-19: counts as people write them: 12, 1,234, 1.2M, 3,4k."""
    clean = F.regexp_replace(F.lower(F.trim(text)), r"\s", "")
    unit = F.regexp_extract(clean, "([kmb])$", 1)
    body = F.regexp_replace(clean, "[kmb]$", "")
    plain = F.regexp_replace(body, ",", "")
    short = F.regexp_replace(body, ",", ".")
    number = F.when(unit == "", plain.try_cast("double")).otherwise(short.try_cast("double"))
    factor = F.when(unit == "k", 1e3).when(unit == "m", 1e6).when(unit == "b", 1e9).otherwise(1.0)
    return F.coalesce(F.round(number * factor).cast("long"), F.lit(0).cast("long"))


def delta(actual: Column, predicted: Column) -> Column:
    """MET-20: percent above the prediction; without one 100 for anything, else 0."""
    return F.when(predicted > 0, (actual - predicted) / predicted * 100).when(actual > 0, 100.0).otherwise(0.0)


def is_high_priority(delta_: Column, threshold: float = 20.0) -> Column:
    return F.abs(delta_) > threshold


def priority(delta_: Column, content_format: Column, views: Column) -> Column:
    """MET-21: training priority from the error, rare formats and volume."""
    size = F.abs(delta_)
    base = F.least(F.lit(1.0), size / 100) * F.when(size > 50, 1.5).when(size > 20, 1.2).otherwise(1.0)
    kind = F.when(content_format == "carousel", 1.3).when(content_format.isin("static", "static_image"), 1.2).otherwise(1.0)
    volume = F.when(views > 10000, 1.3).when(views > 1000, 1.1).otherwise(1.0)
    return F.least(F.lit(1.0), F.greatest(F.lit(0.0), base * kind * volume))


def feedback_notes(delta_: Column) -> Column:
    """MET-22: the direction of the error and telling ratios, as text."""
    percent = lambda x: F.format_string("%.1f", x)
    direction = (
        F.when(delta_ > 20, F.concat(F.lit("Model UNDERESTIMATED by "), percent(delta_), F.lit("%; Content performed better than expected")))
        .when(delta_ < -20, F.concat(F.lit("Model OVERESTIMATED by "), percent(F.abs(delta_)), F.lit("%; Content underperformed expectations")))
        .otherwise(F.concat(F.lit("Prediction within acceptable range (delta: "), percent(delta_), F.lit("%)")))
    )
    notes = [
        F.when(F.col("comments") > F.col("likes") * 0.1, F.lit("High comment ratio suggests strong audience connection")),
        F.when(F.col("saves") > F.col("likes") * 0.05, F.lit("High save ratio indicates valuable/educational content")),
        F.when(F.col("shares") > F.col("likes") * 0.03, F.lit("High share ratio shows viral potential")),
    ]
    return F.concat_ws("; ", direction, *notes)


def satisfaction(label: Column) -> Column:
    """MET-23."""
    return F.when(label == "viral", 1.0).when(label == "good", 0.7).when(label == "flop", 0.1).otherwise(0.5)
