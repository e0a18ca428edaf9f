"""Model evaluation: errors by segment, drift, calibration, health of models over time. Inputs are tables of (y, p) pairs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.config import EVALUATION, METRICS, Weights
from tidemark.operators.ranks import Counted, quantiles
from tidemark.operators.tables import Steps

# The texts of alerts.
SHIFTED = "Distribution shift detected (KS p=%.4f)"
DEGRADED = "MAE degraded %.1f%% vs baseline"
DRIFTED = "Drift detected"


# Hours of each band, of which the night wraps, and working days.
HOURS = {"morning": (6, 12), "afternoon": (12, 18), "evening": (18, 22), "night": (22, 6)}
LEAST = 5


def errors(y: str = "y", p: str = "p") -> dict[str, Column]:
    """MAE, RMSE, R² (0 without variance) and MAPE over non-zero truths (0 without any)."""
    e = F.col(y) - F.col(p)
    total = F.var_pop(y)
    return {
        "mae": F.avg(F.abs(e)),
        "rmse": F.sqrt(F.avg(e * e)),
        "r2": F.when(total == 0, 0.0).otherwise(1 - F.avg(e * e) / total),
        "mape": F.coalesce(F.avg(F.when(F.col(y) != 0, F.abs(e / F.col(y)))) * 100, F.lit(0.0)),
    }


def long_form(rows: DataFrame, targets: list[str], true: str = "true_", predicted: str = "pred_") -> DataFrame:
    """(target, y, p) rows from one pair of columns for each target."""
    return rows.select(F.explode(F.array(*[F.struct(F.lit(t).alias("target"), F.col(true + t).alias("y"), F.col(predicted + t).alias("p")) for t in targets])).alias("x")).select("x.*")


def by_target(pairs: DataFrame, target: str = "target") -> DataFrame:
    """AGG-09: the errors of each target, and their means as ``_aggregate``."""
    each = pairs.groupBy(target).agg(*[c.alias(k) for k, c in errors().items()])
    return each.unionByName(each.agg(F.lit("_aggregate").alias(target), *[F.avg(k).alias(k) for k in errors()]))


def by_format(pairs: DataFrame, fmt: str = "content_format") -> DataFrame:
    """AGG-10: the errors of formats with enough rows."""
    made = pairs.groupBy(fmt).agg(*[c.alias(k) for k, c in errors().items() if k != "mape"], F.count("*").alias("n_samples"))
    return made.where(F.col("n_samples") >= LEAST)


def format_of_flags(is_reel: Column, is_carousel: Column) -> Column:
    return F.when(is_reel == 1, "reel").when(is_carousel == 1, "carousel").otherwise("static_image")


def by_time(pairs: DataFrame, hour: str = "hour", weekday: str = "weekday") -> DataFrame:
    """AGG-11: MAE by hour band, working days or weekend, and weekday prime time. A row is in up to three segments."""
    h, d = F.col(hour), F.col(weekday)
    band = F.when((h >= 6) & (h < 12), "hour_morning").when((h >= 12) & (h < 18), "hour_afternoon").when((h >= 18) & (h < 22), "hour_evening").otherwise("hour_night")
    day = F.when(d <= 4, "day_weekday").otherwise("day_weekend")
    prime = F.when(h.between(18, 21) & (d <= 4), "prime_time")
    rows = pairs.withColumn("segment", F.explode(F.array_compact(F.array(band, day, prime))))
    made = rows.groupBy("segment").agg(errors()["mae"].alias("mae"), F.count("*").alias("n_samples"))
    return made.where(F.col("n_samples") >= LEAST)


def weighted_index(rows: DataFrame, prefix: str, name: str, weights: Weights = EVALUATION) -> DataFrame:
    """AGG-12: ``name``, the weighted mean of the targets scaled so that the 5th and 95th percentiles are 0 and 100, clipped."""
    mean = sum((F.col(prefix + m) * weights.of(m) for m in METRICS), F.lit(0.0)) / weights.total
    made = rows.withColumn(name, mean)
    low, high = (F.lit(q).cast("double") for q in quantiles(made, name, [0.05, 0.95]))
    scaled = F.when(high > low, F.least(F.greatest((F.col(name) - low) / (high - low) * 100, F.lit(0.0)), F.lit(100.0))).otherwise(F.col(name))
    return made.withColumn(name, scaled)


def index_errors(rows: DataFrame, weights: Weights = EVALUATION) -> DataFrame:
    """AGG-12: errors and correlation of the true and the predicted index (columns true_*, pred_*)."""
    both = weighted_index(weighted_index(rows, "true_", "rpi_true", weights), "pred_", "rpi_pred", weights)
    e = errors("rpi_true", "rpi_pred")
    return both.agg(e["mae"].alias("mae"), e["rmse"].alias("rmse"), F.corr("rpi_true", "rpi_pred").alias("correlation"))


def kolmogorov_smirnov(values: DataFrame, side: str = "side", value: str = "value", key: str | None = None) -> DataFrame:
    """AGG-13: the largest distance of the two sides' distributions, and the asymptotic p-value.

    ``side`` is 0 or 1. Rows become counts by distinct value before the running sums. With ``key`` there is a test for each key,
    whose values stay in one task; without, value ranges are summed apart and their totals added, so no task sees all values.
    """
    keys = [key] if key else []
    counts = values.groupBy(*keys, value).agg(F.count_if(F.col(side) == 0).alias("a"), F.count_if(F.col(side) == 1).alias("b"))
    if key:
        w = Window.partitionBy(key)
        upto = w.orderBy(value).rowsBetween(Window.unboundedPreceding, 0)
        placed = counts.withColumns({"ca": F.sum("a").over(upto), "cb": F.sum("b").over(upto), "n1": F.sum("a").over(w), "n2": F.sum("b").over(w)})
    else:
        shares = ", ".join(str(i / 64) for i in range(1, 64))
        cuts = values.agg(F.expr(f"percentile_approx(cast({value} as double), array({shares}))").alias("c")).first()["c"] or []
        bounds = F.array(*[F.lit(float(c)) for c in sorted(set(cuts))]) if cuts else F.expr("cast(array() as array<double>)")
        ranged = counts.withColumn("_r", F.size(F.filter(bounds, lambda b: b < F.col(value))))
        sizes = ranged.groupBy("_r").agg(F.sum("a").alias("ra"), F.sum("b").alias("rb"))
        before = Window.orderBy("_r").rowsBetween(Window.unboundedPreceding, -1)  # a row for each range
        every = Window.partitionBy(F.lit(0))
        starts = sizes.select("_r", *[F.coalesce(F.sum(c).over(before), F.lit(0)).alias(f"s{c}") for c in ("ra", "rb")], F.sum("ra").over(every).alias("n1"), F.sum("rb").over(every).alias("n2"))
        upto = Window.partitionBy("_r").orderBy(value).rowsBetween(Window.unboundedPreceding, 0)
        placed = ranged.join(F.broadcast(starts), "_r").withColumns({"ca": F.sum("a").over(upto) + F.col("sra"), "cb": F.sum("b").over(upto) + F.col("srb")})
    made = placed.groupBy(*keys).agg(F.max(F.abs(F.col("ca") / F.col("n1") - F.col("cb") / F.col("n2"))).alias("ks"), F.max("n1").alias("n1"), F.max("n2").alias("n2"))
    root = F.sqrt(F.col("n1") * F.col("n2") / (F.col("n1") + F.col("n2")))
    x = (root + 0.12 + 0.11 / root) * F.col("ks")
    series = sum((F.lit((-1.0) ** (j - 1)) * F.exp(-2 * j * j * x * x) for j in range(1, 21)), F.lit(0.0))
    p = F.when(x < 0.2, 1.0).otherwise(F.least(F.greatest(2 * series, F.lit(0.0)), F.lit(1.0)))
    return made.withColumn("p_value", p)


def drift(mae: Column, baseline_mae: Column, ks: Column, p_value: Column) -> dict[str, Column]:
    """AGG-14: relative worsening, the combined score, and an alert above 0.3."""
    increase = F.when(baseline_mae > 0, (mae - baseline_mae) / baseline_mae)
    by_mae = F.when(baseline_mae > 0, F.least(F.greatest(increase, F.lit(0.0)), F.lit(1.0))).otherwise(0.0)
    by_ks = F.least(ks * 2, F.lit(1.0))
    score = F.round(F.when(ks.isNotNull() & baseline_mae.isNotNull(), by_ks * 0.4 + by_mae * 0.6).when(baseline_mae.isNotNull(), by_mae).when(ks.isNotNull(), by_ks).otherwise(0.0), 4)
    parts = F.concat_ws(
        "; ",
        F.when(p_value < 0.05, F.format_string(SHIFTED, p_value)),
        F.when(increase > 0.2, F.format_string(DEGRADED, increase * 100)),
    )
    detected = score > 0.3
    return {"mae_vs_baseline": increase, "drift_score": score, "drift_detected": detected, "alert": F.when(detected, F.when(parts == "", DRIFTED).otherwise(parts))}


def range_drift(pairs: DataFrame, key: str = "niche", threshold: float = 0.3) -> DataFrame:
    """AGG-15: MAE over the range of the truths, for keys with enough rows."""
    made = pairs.groupBy(key).agg(errors()["mae"].alias("mae"), (F.max("y") - F.min("y")).alias("span"), F.count("*").alias("n"))
    score = F.when(F.col("span") > 0, F.col("mae") / F.col("span")).otherwise(0.0)
    return made.where(F.col("n") >= LEAST).select(key, "n", score.alias("drift_score"), (score > threshold).alias("drift"))


def calibration(pairs: DataFrame, bins: int = 10) -> DataFrame:
    """AGG-16: of quantile bins of the prediction the mean percentile of the truths, beside what it should be.

    A truth's percentile is the share of truths at most as large. Pairs are counted by truth and bin, and places are read from the
    counts, so two passes over the pairs are all, and neither they nor a frequent truth meet in one task.
    """
    edges = F.array(*[F.lit(e).cast("double") for e in quantiles(pairs, "p", [i / bins for i in range(1, bins)])])
    binned = pairs.withColumn("bin", F.size(F.filter(edges, lambda e: e <= F.col("p"))))
    cells = Steps(pairs.sparkSession, "calibration").save(binned.groupBy(F.col("y").cast("double").alias("y"), "bin").agg(F.count("*").alias("c")))
    percentiles = Counted(cells, "y", times=F.col("c")).placed([]).select(F.col("_v").alias("y"), ((F.col("_first") + F.col("_c")) / F.col("n") * 100).alias("percentile"))
    made = cells.join(percentiles, "y").groupBy("bin").agg((F.sum(F.col("percentile") * F.col("c")) / F.sum("c")).alias("observed"), F.sum("c").alias("n"))
    return made.withColumn("expected", (F.col("bin") + 0.5) * 100 / bins)


def calibration_error(table: DataFrame) -> DataFrame:
    error = F.coalesce(F.avg(F.abs(F.col("expected") - F.col("observed"))), F.lit(0.0))
    return table.agg(error.alias("calibration_error"), (error < 10).alias("well_calibrated"))


def baseline_mae(history: DataFrame, lookback: int = 10) -> DataFrame:
    """AGG-17: the mean of each niche's last evaluations."""
    place = F.row_number().over(Window.partitionBy("niche").orderBy(F.desc("ts"), "run"))
    return history.withColumn("_p", place).where(F.col("_p") <= lookback).groupBy("niche").agg(F.avg("mae").alias("baseline_mae"), F.count("*").alias("n"))


def insights(drifts: DataFrame, targets: DataFrame, formats: DataFrame, times: DataFrame, calibrations: DataFrame) -> DataFrame:
    """AGG-18: rows of findings from the metric tables; a line that all is well where there are none."""
    row = lambda df, kind, message: df.select(F.lit(kind).alias("kind"), message.alias("message"))
    worst = targets.where("target <> '_aggregate'").orderBy(F.desc("mae"), "target").limit(1)
    mean = formats.agg(F.avg("mae").alias("m"))
    weak = formats.crossJoin(F.broadcast(mean)).where("mae > 1.2 * m")
    value = lambda s: F.max(F.when(F.col("segment") == s, F.col("mae")))
    spans = times.agg(value("day_weekend").alias("e"), value("day_weekday").alias("d"), value("prime_time").alias("p"), F.avg("mae").alias("m"))
    found = row(drifts.where("drift_detected"), "drift", F.coalesce("alert", F.lit("drift")))
    found = found.union(row(worst, "target", F.concat(F.lit("largest error for "), F.col("target"))))
    found = found.union(row(weak, "format", F.concat(F.lit("weak on "), F.col("content_format"))))
    found = found.union(row(spans.where("e > 1.3 * d"), "weekend", F.lit("worse at weekends")))
    found = found.union(row(spans.where("p > m"), "prime_time", F.lit("worse in prime time")))
    found = found.union(row(calibrations.where("not well_calibrated"), "calibration", F.lit("badly calibrated")))
    none = found.agg(F.count("*").alias("n")).where("n = 0").select(F.lit("ok").alias("kind"), F.lit("nothing to report").alias("message"))
    return found.union(none)


def model_health(history: DataFrame) -> DataFrame:
    """AGG-19: each niche's latest evaluation, alert level by drift, and the trend of its error."""
    own = Window.partitionBy("niche").orderBy(F.desc("ts"), "run")
    rows = history.withColumns({"_p": F.row_number().over(own), "previous": F.lead("mae").over(own)}).where("_p = 1")
    level = F.when(F.col("drift_score") > 0.6, "critical").when(F.col("drift_score") > 0.3, "warning").otherwise("ok")
    trend = F.when(F.col("previous").isNull(), "new").when(F.col("mae") < F.col("previous") * 0.95, "improving").when(F.col("mae") > F.col("previous") * 1.05, "degrading").otherwise("stable")
    return rows.select("niche", "ts", "mae", "drift_score", level.alias("alert"), trend.alias("trend"))


def health_summary(health: DataFrame) -> DataFrame:
    return health.agg(F.count("*").alias("niches"), *[F.count_if(F.col("alert") == a).alias(a) for a in ("ok", "warning", "critical")], F.avg("mae").alias("mean_mae"))


def compare(pairs: DataFrame, online: str = "p_online", batch: str = "p_batch") -> DataFrame:
    """AGG-30: the errors of two predictions of the same truths."""
    o, b = F.avg(F.abs(F.col("y") - F.col(online))), F.avg(F.abs(F.col("y") - F.col(batch)))
    return pairs.agg(o.alias("online_mae"), b.alias("batch_mae"), F.when(b > 0, (b - o) / b * 100).otherwise(0.0).alias("improvement"), (o < b).alias("online_better"))


def mean_predictor(train: DataFrame, test: DataFrame) -> DataFrame:
    """AGG-31: the error of predicting the training mean, beside the model's."""
    mean = train.agg(F.avg("y").alias("_mean"))
    rows = test.crossJoin(F.broadcast(mean))
    plain, own = F.avg(F.abs(F.col("y") - F.col("_mean"))), F.avg(F.abs(F.col("y") - F.col("p")))
    return rows.agg(plain.alias("baseline_mae"), own.alias("model_mae"), F.when(plain > 0, (plain - own) / plain * 100).otherwise(0.0).alias("improvement"))


def confidence(n: Column, midpoint: float = 50.0, steepness: float = 0.1, least: int = 30, most: float = 0.95) -> Column:
    """ML-07: the model's share in an ensemble, a sigmoid of its training rows; 0 below ``least`` and without a count."""
    return F.when(n >= least, most / (1 + F.exp(-steepness * (n - midpoint)))).otherwise(0.0)


def interval(score: Column, rmse: Column) -> dict[str, Column]:
    """ML-18: 1.96 standard errors about a score, 0.2 where none is known, and the raw index."""
    half = F.coalesce(rmse * 1.96, F.lit(0.2))
    return {"lower": score - half, "upper": score + half, "raw": F.expm1(F.greatest(score, F.lit(0.0)))}


