"""Performance relative to an author's own history: baselines, fallbacks and the relative performance index."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.config import RPI, Normalisation, Weights
from tidemark.functions.metrics import harmonised, index, weighted
from tidemark.operators.ranks import Counted, quantiles
from tidemark.operators.tables import Steps


def history(config: Normalisation, author: str = "author_id", order: tuple[str, ...] = ("posted_at", "post_id")):
    """WIN-01: the author's previous posts, the current one left out; ties in time go by id."""
    return Window.partitionBy(author).orderBy(*order).rowsBetween(-config.window, -1)


def _trimmed(values: Column, ends: Column, median: Column) -> Column:
    inner = F.filter(values, lambda x: (x >= ends[0]) & (x <= ends[1]))
    mean = F.aggregate(inner, F.lit(0.0), lambda s, x: s + x) / F.size(inner)
    return F.when(F.size(inner) > 0, mean).otherwise(median)


def _weighted_median(values: Column) -> Column:
    """Weights grow linearly from 0.5 to 1 with recency; the smallest value at which half of the weight is reached."""
    n = F.size(values)
    weight = lambda i: F.when(n == 1, 0.5).otherwise(0.5 + 0.5 * i / (n - 1))
    pairs = F.array_sort(F.transform(values, lambda x, i: F.struct(x.alias("v"), i.alias("i"), weight(i).alias("w"))))
    total = F.aggregate(pairs, F.lit(0.0), lambda s, p: s + p["w"])
    start = F.struct(F.lit(0.0).alias("sum"), F.lit(None).cast("double").alias("v"))

    def step(state: Column, p: Column) -> Column:
        reached = state["sum"] + p["w"]
        return F.struct(reached.alias("sum"), F.when(state["v"].isNull() & (reached >= total / 2 - 1e-9), p["v"]).otherwise(state["v"]).alias("v"))

    return F.aggregate(pairs, start, step, lambda s: s["v"])


def baseline(value: str, config: Normalisation) -> Column:
    """WIN-02…05: the baseline over the history by the strategy; NULL with too little history."""
    w = history(config)
    median = F.expr(f"percentile({value}, 0.5)").over(w)
    if config.strategy == "median":
        made = median
    elif config.strategy == "mean":
        made = F.avg(value).over(w)
    elif config.strategy == "trimmed_mean":
        made = _trimmed(F.collect_list(value).over(w), F.expr(f"percentile({value}, array(0.1D, 0.9D))").over(w), median)
    elif config.strategy == "weighted_median":
        made = _weighted_median(F.collect_list(value).over(w))
    else:
        raise ValueError(f"no baseline strategy {config.strategy!r}")
    return F.when(F.count(value).over(w) >= config.least, made)


def niche_baselines(posts: DataFrame, value: str = "weighted_engagement", niche: str = "niche", least: int = 10) -> DataFrame:
    """AGG-01: median, mean, deviation, size and quartiles of each niche with enough rows: two passes, no niche in one task."""
    rows = posts.where(F.col(niche).isNotNull())
    quartiles = Counted(rows, value, [niche]).quantiles([0.25, 0.5, 0.75]).where(F.col("n") >= least)
    moments = rows.groupBy(niche).agg(F.avg(value).alias("mean_engagement"), F.stddev_samp(value).alias("std_engagement"))
    return quartiles.join(moments, niche).select(
        niche, F.col("q")[1].alias("median_engagement"), "mean_engagement", "std_engagement", F.col("n").alias("sample_size"), F.col("q")[0].alias("percentile_25"), F.col("q")[2].alias("percentile_75")
    )


def with_fallback(posts: DataFrame, niches: DataFrame, overall: DataFrame, default: float = 100.0) -> DataFrame:
    """JOIN-04: ``fallback`` and ``fallback_source``: the niche's median, else the global one, else ``default``.

    Niches are a dimension: one row each, broadcast while small by Spark's own size rule. ``overall`` is one row.
    """
    known = niches.select("niche", F.col("median_engagement").alias("_niche_median"))
    rows = posts.join(known, "niche", "left").crossJoin(F.broadcast(overall))
    return rows.select(
        "*",
        F.coalesce("_niche_median", "global_median", F.lit(default)).alias("fallback"),
        F.when(F.col("_niche_median").isNotNull(), "niche").otherwise("global").alias("fallback_source"),
    ).drop("_niche_median", "global_median")


def relative_performance(posts: DataFrame, config: Normalisation = Normalisation(), weights: Weights = RPI) -> DataFrame:
    """WIN-06: every post with its weighted engagement, baseline and its source, raw and logarithmic index.

    Posts are read once and written. One shuffle by author for the window; the medians of niches and of all posts are read from
    one table of counted values.
    """
    steps = Steps(posts.sparkSession, "performance")
    rows = steps.save(harmonised(posts).withColumn("weighted_engagement", weighted(weights)))
    counted = Counted(rows, "weighted_engagement", ["niche"])
    niches = counted.quantiles([0.5]).where(F.col("n") >= config.least_niche).where("niche is not null").select("niche", F.col("q")[0].alias("median_engagement"))
    overall = counted.quantiles([0.5], []).select(F.col("q")[0].alias("global_median"))
    niches, overall = steps.save(niches), steps.save(overall)
    counted.clear()
    own = rows.withColumn("_own", baseline("weighted_engagement", config))
    made = with_fallback(own, niches, overall, config.default_baseline)
    base = F.coalesce("_own", "fallback")
    raw = index(F.col("weighted_engagement"), base, config.lowest, config.highest)
    return (
        made.withColumns({"baseline_engagement": base, "baseline_source": F.when(F.col("_own").isNotNull(), "personal").otherwise(F.col("fallback_source"))})
        .withColumn("rpi_raw", raw)
        .withColumn("rpi_score", F.log1p("rpi_raw"))
        .drop("_own", "fallback", "fallback_source")
    )


def score_new(known: DataFrame, new: DataFrame, config: Normalisation = Normalisation(), weights: Weights = RPI) -> DataFrame:
    """WIN-07: new posts against the history; the plan is that of the whole table, new rows are kept at the end."""
    both = known.withColumn("_new", F.lit(False)).unionByName(new.withColumn("_new", F.lit(True)), allowMissingColumns=True)
    return relative_performance(both, config, weights).where("_new").drop("_new")


def summary(scored: DataFrame) -> DataFrame:
    """AGG-02: rows by baseline source, the score's distribution and the share of cold starts. Scores are made once and written."""
    scored = Steps(scored.sparkSession, "summary").save(scored.select("baseline_source", "rpi_score"))
    count = lambda s: F.count_if(F.col("baseline_source") == s)
    quarter, half, three = (F.lit(q).cast("double") for q in quantiles(scored, "rpi_score", [0.25, 0.5, 0.75]))
    return scored.agg(
        F.count("*").alias("total_posts"),
        *[count(s).alias(f"{s}_posts") for s in ("personal", "niche", "global")],
        F.avg("rpi_score").alias("rpi_mean"),
        F.stddev_samp("rpi_score").alias("rpi_std"),
        F.min("rpi_score").alias("rpi_min"),
        F.max("rpi_score").alias("rpi_max"),
        quarter.alias("rpi_25"),
        half.alias("rpi_50"),
        three.alias("rpi_75"),
        (1 - count("personal") / F.count("*")).alias("cold_start_rate"),
    )


def latest(rows: DataFrame, key: str, most: int, order: list[Column]) -> DataFrame:
    """WIN-11: the latest ``most`` rows of each key. Spark limits each group before the shuffle."""
    place = F.row_number().over(Window.partitionBy(key).orderBy(*order))
    return rows.withColumn("_place", place).where(F.col("_place") <= most).drop("_place")


def first_of_each(rows: DataFrame, key: str, order: list[Column]) -> DataFrame:
    """WIN-10: the first row of each key."""
    return latest(rows, key, 1, order)
