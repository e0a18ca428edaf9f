"""Queries over predictions, joins, merges and projections."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark import config as C
from tidemark.functions import text as T
from tidemark.operators import evaluation as E
from tidemark.operators import joins as J
from tidemark.operators import sequences as Q
from tidemark.operators.nearest import nearest_within
from tidemark.plans.register import query, rounded


def _errors(y: str = "y", p: str = "p", mape: bool = True) -> str:
    made = f"""round(avg(abs({y} - {p})), 6) AS mae, round(sqrt(avg(({y} - {p}) * ({y} - {p}))), 6) AS rmse, round(CASE WHEN var_pop({y}) = 0 THEN 0 ELSE 1 - avg(({y} - {p}) * ({y} - {p})) / var_pop({y}) END, 6) AS r2"""
    return made + (f", round(coalesce(avg(CASE WHEN {y} <> 0 THEN abs(({y} - {p}) / {y}) END) * 100, 0), 6) AS mape" if mape else "")


_E4 = ("mae", "rmse", "r2", "mape")


@query(
    f"""WITH t AS (SELECT niche AS target, {_errors()} FROM predictions GROUP BY niche) SELECT * FROM t UNION ALL SELECT '_aggregate', round(avg(mae), 6), round(avg(rmse), 6), round(avg(r2), 6), round(avg(mape), 6) FROM
    (SELECT niche, avg(abs(y - p)) AS mae, sqrt(avg((y - p) * (y - p))) AS rmse, 1 - avg((y - p) * (y - p)) / var_pop(y) AS r2, avg(abs((y - p) / y)) * 100 AS mape FROM predictions GROUP BY niche)""",
    "predictions",
    reads="predictions",
)
def agg_09_errors_by_target(predictions: DataFrame) -> DataFrame:
    made = E.by_target(predictions.withColumnRenamed("niche", "target"))
    return made.select("target", *rounded({c: F.col(c) for c in _E4}))


@query(f"SELECT content_format, {_errors(mape=False)}, count(*) AS n_samples FROM predictions GROUP BY content_format HAVING count(*) >= 5", "predictions", reads="predictions")
def agg_10_errors_by_format(predictions: DataFrame) -> DataFrame:
    return E.by_format(predictions).select("content_format", "n_samples", *rounded({c: F.col(c) for c in _E4[:3]}))


@query(
    """WITH s AS (SELECT *, CASE WHEN hour >= 6 AND hour < 12 THEN 'hour_morning' WHEN hour >= 12 AND hour < 18 THEN 'hour_afternoon' WHEN hour >= 18 AND hour < 22 THEN 'hour_evening' ELSE 'hour_night' END AS segment FROM predictions
    UNION ALL SELECT *, CASE WHEN weekday <= 4 THEN 'day_weekday' ELSE 'day_weekend' END FROM predictions UNION ALL SELECT *, 'prime_time' FROM predictions WHERE hour BETWEEN 18 AND 21 AND weekday <= 4)
    SELECT segment, round(avg(abs(y - p)), 6) AS mae, count(*) AS n_samples FROM s GROUP BY segment HAVING count(*) >= 5""",
    "predictions",
    reads="predictions",
)
def agg_11_errors_by_time(predictions: DataFrame) -> DataFrame:
    return E.by_time(predictions).select("segment", "n_samples", *rounded({"mae": F.col("mae")}))


_INDEX = "({0}likes + {0}comments * 2.0 + {0}shares * 10.0 + {0}saves * 5.0 + {0}views * 0.5::DOUBLE) / 18.5"
_PAIR_SQL = """pairs AS (SELECT post_id, """ + ", ".join(f"ln(1 + {m}) AS true_{m}, ln(1 + {m}) + ((post_id % {7 + i}) - 3) / 10.0::DOUBLE AS pred_{m}" for i, m in enumerate(C.METRICS)) + " FROM posts)"


def _pairs(posts: DataFrame) -> DataFrame:
    made = {}
    for i, m in enumerate(C.METRICS):
        made[f"true_{m}"] = F.log1p(m)
        made[f"pred_{m}"] = F.log1p(m) + (F.col("post_id") % (7 + i) - 3) / 10
    return posts.select("post_id", *[c.alias(k) for k, c in made.items()])


@query(
    f"""WITH {_PAIR_SQL}, x AS (SELECT {_INDEX.format('true_')} AS t, {_INDEX.format('pred_')} AS p FROM pairs), q AS (SELECT quantile_cont(t, 0.05) AS tl, quantile_cont(t, 0.95) AS th, quantile_cont(p, 0.05) AS pl, quantile_cont(p, 0.95) AS ph FROM x),
    s AS (SELECT least(greatest((t - tl) / (th - tl) * 100, 0), 100) AS t, least(greatest((p - pl) / (ph - pl) * 100, 0), 100) AS p FROM x, q)
    SELECT round(avg(abs(t - p)), 6) AS mae, round(sqrt(avg((t - p) * (t - p))), 6) AS rmse, round(corr(t, p), 6) AS correlation FROM s""",
    "posts",
    reads="posts",
)
def agg_12_index_errors(posts: DataFrame) -> DataFrame:
    return E.index_errors(_pairs(posts)).select(*rounded({c: F.col(c) for c in ("mae", "rmse", "correlation")}))


_SERIES = "2 * (" + " + ".join(f"{(-1) ** (j - 1)} * exp(-2 * {j * j} * x * x)" for j in range(1, 21)) + ")"
_SIDES = "s AS (SELECT CAST(l_orderkey % 2 AS INT) AS side, round(p + CASE WHEN l_orderkey % 2 = 1 THEN 0.02 ELSE 0 END, 4) AS value FROM predictions)"
_KS = f"""{_SIDES}, c AS (SELECT value, count(*) FILTER (side = 0) AS a, count(*) FILTER (side = 1) AS b FROM s GROUP BY value),
w AS (SELECT sum(a) OVER u AS ca, sum(b) OVER u AS cb, sum(a) OVER () AS n1, sum(b) OVER () AS n2 FROM c WINDOW u AS (ORDER BY value ROWS UNBOUNDED PRECEDING)),
k AS (SELECT max(abs(ca / n1 - cb / n2)) AS ks, max(n1) AS n1, max(n2) AS n2 FROM w), l AS (SELECT *, (sqrt(n1 * n2 / (n1 + n2)) + 0.12 + 0.11 / sqrt(n1 * n2 / (n1 + n2))) * ks AS x FROM k),
ksp AS (SELECT ks, n1, n2, CASE WHEN x < 0.2 THEN 1 ELSE least(greatest({_SERIES}, 0), 1) END AS p_value FROM l)"""


def _sides(predictions: DataFrame) -> DataFrame:
    side = (F.col("l_orderkey") % 2).cast("int")
    return predictions.select(side.alias("side"), F.round(F.col("p") + F.when(side == 1, 0.02).otherwise(0.0), 4).alias("value"))


@query(f"WITH {_KS} SELECT round(ks, 6) AS ks, round(p_value, 6) AS p_value, CAST(n1 AS BIGINT) AS n1, CAST(n2 AS BIGINT) AS n2 FROM ksp", "predictions", reads="predictions")
def agg_13_kolmogorov_smirnov(predictions: DataFrame) -> DataFrame:
    return E.kolmogorov_smirnov(_sides(predictions)).select("n1", "n2", *rounded({c: F.col(c) for c in ("ks", "p_value")}))


@query(
    f"""WITH {_KS}, m AS (SELECT avg(abs(y - p)) AS mae FROM predictions), d AS (SELECT mae, ks, p_value, (mae - 0.1) / 0.1 AS inc FROM m, ksp)
    SELECT round(inc, 6) AS mae_vs_baseline, round(least(ks * 2, 1) * 0.4 + least(greatest(inc, 0), 1) * 0.6, 4) AS drift_score, round(least(ks * 2, 1) * 0.4 + least(greatest(inc, 0), 1) * 0.6, 4) > 0.3 AS drift_detected FROM d""",
    "predictions",
    reads="predictions",
)
def agg_14_drift(predictions: DataFrame) -> DataFrame:
    mae = predictions.agg(F.avg(F.abs(F.col("y") - F.col("p"))).alias("mae"))
    rows = mae.crossJoin(E.kolmogorov_smirnov(_sides(predictions)))
    made = E.drift(F.col("mae"), F.lit(0.1), F.col("ks"), F.col("p_value"))
    return rows.select(made["drift_score"].alias("drift_score"), made["drift_detected"].alias("drift_detected"), *rounded({"mae_vs_baseline": made["mae_vs_baseline"]}))


@query(
    """SELECT niche, count(*) AS n, round(avg(abs(y - p)) / (max(y) - min(y)), 6) AS drift_score, avg(abs(y - p)) / (max(y) - min(y)) > 0.3 AS drift FROM predictions GROUP BY niche HAVING count(*) >= 5""",
    "predictions",
    reads="predictions",
)
def agg_15_range_drift(predictions: DataFrame) -> DataFrame:
    return E.range_drift(predictions).select("niche", "n", "drift", *rounded({"drift_score": F.col("drift_score")}))


_CAL = """q AS (SELECT quantile_cont(p, [0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9]) AS e FROM r), d AS (SELECT p, cume_dist() OVER (ORDER BY y) * 100 AS o FROM r),
b AS (SELECT len(list_filter(e, lambda x: x <= p)) AS bin, o FROM d, q), cal AS (SELECT bin, avg(o) AS observed, count(*) AS n, (bin + 0.5) * 10 AS expected FROM b GROUP BY bin)"""
_ROUNDED_PAIRS = "r AS (SELECT round(y, 6) AS y, round(p, 6) AS p FROM predictions)"


def _rounded_pairs(predictions: DataFrame) -> DataFrame:
    return predictions.select(F.round("y", 6).alias("y"), F.round("p", 6).alias("p"))


@query(f"WITH {_ROUNDED_PAIRS}, {_CAL} SELECT bin, round(observed, 6) AS observed, n, round(expected, 6)::DOUBLE AS expected FROM cal", "predictions", reads="predictions")
def agg_16_calibration(predictions: DataFrame) -> DataFrame:
    return E.calibration(_rounded_pairs(predictions)).select(F.col("bin").cast("long").alias("bin"), "n", *rounded({c: F.col(c) for c in ("observed", "expected")}))


@query(
    f"WITH {_ROUNDED_PAIRS}, {_CAL} SELECT round(avg(abs(expected - observed)), 6) AS calibration_error, avg(abs(expected - observed)) < 10 AS well_calibrated FROM cal", "predictions", reads="predictions"
)
def agg_16_calibration_error(predictions: DataFrame) -> DataFrame:
    return E.calibration_error(E.calibration(_rounded_pairs(predictions))).select("well_calibrated", *rounded({"calibration_error": F.col("calibration_error")}))


_RUNS = "runs AS (SELECT niche, l_orderkey % 40 AS ts, l_orderkey % 40 AS run, avg(abs(y - p)) AS mae, (l_orderkey % 40) / 40.0 AS drift_score FROM predictions GROUP BY niche, l_orderkey % 40)"


def _runs(predictions: DataFrame) -> DataFrame:
    ts = F.col("l_orderkey") % 40
    made = predictions.groupBy("niche", ts.alias("ts")).agg(F.avg(F.abs(F.col("y") - F.col("p"))).alias("mae"))
    return made.withColumns({"run": F.col("ts"), "drift_score": F.col("ts") / 40})


@query(
    f"WITH {_RUNS}, l AS (SELECT *, row_number() OVER (PARTITION BY niche ORDER BY ts DESC, run) AS p FROM runs) SELECT niche, round(avg(mae), 6) AS baseline_mae, count(*) AS n FROM l WHERE p <= 10 GROUP BY niche",
    "predictions",
    reads="predictions",
)
def agg_17_baseline_mae(predictions: DataFrame) -> DataFrame:
    return E.baseline_mae(_runs(predictions)).select("niche", "n", *rounded({"baseline_mae": F.col("baseline_mae")}))


@query(
    f"""WITH {_RUNS}, l AS (SELECT *, row_number() OVER w AS p, lead(mae) OVER w AS prev FROM runs WINDOW w AS (PARTITION BY niche ORDER BY ts DESC, run))
    SELECT niche, ts, round(mae, 6) AS mae, CASE WHEN drift_score > 0.6 THEN 'critical' WHEN drift_score > 0.3 THEN 'warning' ELSE 'ok' END AS alert,
    CASE WHEN prev IS NULL THEN 'new' WHEN mae < prev * 0.95 THEN 'improving' WHEN mae > prev * 1.05 THEN 'degrading' ELSE 'stable' END AS trend FROM l WHERE p = 1""",
    "predictions",
    reads="predictions",
)
def agg_19_model_health(predictions: DataFrame) -> DataFrame:
    return E.model_health(_runs(predictions)).select("niche", "ts", "alert", "trend", *rounded({"mae": F.col("mae")}))


# Predictions that go wrong at weekends, in prime time and for reels, and drift from what they were.
_OFF = "p + CASE WHEN weekday > 4 THEN 0.4 WHEN hour BETWEEN 18 AND 21 THEN 0.5 ELSE 0 END + CASE content_format WHEN 'reel' THEN 0.6 ELSE 0 END"


@query(
    f"""WITH o AS (SELECT *, {_OFF} AS q FROM predictions), e AS (SELECT *, abs(y - q) AS e FROM o),
    t AS (SELECT niche, avg(e) AS mae FROM e GROUP BY niche), f AS (SELECT content_format, avg(e) AS mae FROM e GROUP BY content_format HAVING count(*) >= 5),
    d AS (SELECT niche, avg(e) / (max(y) - min(y)) AS score FROM e GROUP BY niche HAVING count(*) >= 5),
    s AS (SELECT CASE WHEN hour >= 6 AND hour < 12 THEN 'm' WHEN hour >= 12 AND hour < 18 THEN 'a' WHEN hour >= 18 AND hour < 22 THEN 'v' ELSE 'n' END AS segment, avg(e) AS mae FROM e GROUP BY 1
      UNION ALL SELECT CASE WHEN weekday <= 4 THEN 'd' ELSE 'e' END, avg(e) FROM e GROUP BY 1 UNION ALL SELECT 'p', avg(e) FROM e WHERE weekday <= 4 AND hour BETWEEN 18 AND 21),
    x AS (SELECT max(mae) FILTER (segment = 'e') AS e, max(mae) FILTER (segment = 'd') AS d, max(mae) FILTER (segment = 'p') AS p, avg(mae) AS m FROM s),
    b AS (SELECT y, q, cume_dist() OVER (ORDER BY y) * 100 AS pc FROM o), g AS (SELECT list(edge ORDER BY edge) AS edges FROM (SELECT unnest(quantile_cont(q, [0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9])) AS edge FROM o)),
    c AS (SELECT abs(avg(pc) - (bin + 0.5) * 10) AS off FROM (SELECT pc, len(list_filter(edges, lambda z: z <= q)) AS bin FROM b, g) GROUP BY bin)
    SELECT 'target' AS kind, concat('largest error for ', niche) AS message FROM (SELECT niche FROM t ORDER BY mae DESC, niche LIMIT 1)
    UNION ALL SELECT 'format', concat('weak on ', content_format) FROM f WHERE mae > 1.2 * (SELECT avg(mae) FROM f)
    UNION ALL SELECT 'drift', concat('drift in ', niche) FROM d WHERE score > 0.08 UNION ALL SELECT 'weekend', 'worse at weekends' FROM x WHERE e > 1.3 * d
    UNION ALL SELECT 'prime_time', 'worse in prime time' FROM x WHERE p > m UNION ALL SELECT 'calibration', 'badly calibrated' FROM (SELECT avg(off) AS a FROM c) WHERE a >= 4""",
    "predictions",
    reads="predictions",
)
def agg_18_insights(predictions: DataFrame) -> DataFrame:
    """Every finding read from the metric tables themselves; limits are such that predictions this far off meet all six."""
    rows = predictions.withColumn("p", F.expr(_OFF))
    drifts = E.range_drift(rows, threshold=0.08).select(F.col("drift").alias("drift_detected"), F.concat(F.lit("drift in "), F.col("niche")).alias("alert"))
    error = E.calibration_error(E.calibration(rows)).select((F.col("calibration_error") < 4).alias("well_calibrated"))
    return E.insights(drifts, E.by_target(rows.withColumnRenamed("niche", "target")), E.by_format(rows), E.by_time(rows), error)


@query(
    """WITH x AS (SELECT avg(abs(y - (y * 0.9 + 0.1))) AS o, avg(abs(y - p)) AS b FROM predictions) SELECT round(o, 6) AS online_mae, round(b, 6) AS batch_mae, round((b - o) / b * 100, 6) AS improvement, o < b AS online_better FROM x""",
    "predictions",
    reads="predictions",
)
def agg_30_online_vs_batch(predictions: DataFrame) -> DataFrame:
    rows = predictions.select("y", (F.col("y") * 0.9 + 0.1).alias("p_online"), F.col("p").alias("p_batch"))
    return E.compare(rows).select("online_better", *rounded({c: F.col(c) for c in ("online_mae", "batch_mae", "improvement")}))


@query(
    """WITH m AS (SELECT avg(y) AS m FROM predictions WHERE l_orderkey % 5 <> 0), x AS (SELECT avg(abs(y - m)) AS b, avg(abs(y - p)) AS o FROM predictions, m WHERE l_orderkey % 5 = 0)
    SELECT round(b, 6) AS baseline_mae, round(o, 6) AS model_mae, round((b - o) / b * 100, 6) AS improvement FROM x""",
    "predictions",
    reads="predictions",
)
def agg_31_mean_predictor(predictions: DataFrame) -> DataFrame:
    test = F.col("l_orderkey") % 5 == 0
    return E.mean_predictor(predictions.where(~test), predictions.where(test)).select(*rounded({c: F.col(c) for c in ("baseline_mae", "model_mae", "improvement")}))


@query(
    """SELECT post_id, round(CASE WHEN post_id % 400 < 30 THEN 0 ELSE 0.95 / (1 + exp(-0.1 * (post_id % 400 - 50))) END, 6)::DOUBLE AS alpha, round(ln(1 + views) - 0.2, 6) AS lower, round(ln(1 + views) + 0.2, 6) AS upper, round(views, 6)::DOUBLE AS raw FROM posts""",
    "posts",
    reads="posts",
)
def ml_07_18_confidence_and_interval(posts: DataFrame) -> DataFrame:
    made = {"alpha": E.confidence(F.col("post_id") % 400)} | E.interval(F.log1p("views"), F.lit(None).cast("double"))
    return posts.select("post_id", *rounded(made))


@query(
    """WITH n AS (SELECT l_partkey, count(*) AS n FROM predictions GROUP BY l_partkey),
    r AS (SELECT p.*, n.n, CASE WHEN p.l_partkey % 13 = 0 THEN NULL ELSE p END AS model,
      least(greatest(0.6 - 0.2 + 0.2 + CASE content_format WHEN 'reel' THEN 0.25 WHEN 'carousel' THEN 0.05 ELSE 0 END + CASE WHEN hour BETWEEN 12 AND 21 THEN 0.15 WHEN hour BETWEEN 8 AND 23 THEN 0.05 ELSE -0.1 END, 0), 2.5) AS heuristic FROM predictions p JOIN n USING (l_partkey)),
    a AS (SELECT *, CASE WHEN model IS NULL OR n < 30 THEN 0 ELSE 0.95 / (1 + exp(-0.1 * (n - 50))) END AS alpha FROM r)
    SELECT l_orderkey, l_linenumber, l_partkey, n, round(alpha, 6)::DOUBLE AS alpha, round(alpha * coalesce(model, 0) + (1 - alpha) * heuristic, 6)::DOUBLE AS score, CASE WHEN alpha >= 0.5 THEN 'model' ELSE 'heuristic' END AS explained_by FROM a""",
    "predictions",
    reads="predictions",
)
def ml_07_ensemble(predictions: DataFrame) -> DataFrame:
    """A batch scored by models of parts, which have fewer than thirty rows or more, or none at all, and by rules of thumb."""
    from tidemark.operators.models import ensemble

    counts = predictions.groupBy("l_partkey").agg(F.count("*").alias("n"))
    model = F.when(F.col("l_partkey") % 13 != 0, F.col("p"))
    heuristic = Q.cold_start(F.lit(0.1), F.lit(1), F.col("content_format"), F.col("hour"), F.lit(None).cast("double"), F.lit(None).cast("double"))
    made = ensemble(model, heuristic, F.col("n"))
    rows = predictions.join(counts, "l_partkey")
    return rows.select("l_orderkey", "l_linenumber", "l_partkey", "n", made["explained_by"].alias("explained_by"), *rounded({c: made[c] for c in ("alpha", "score")}))


@query(
    """SELECT post_id, round(least(greatest(0.6 + CASE WHEN post_id % 10 >= 7 THEN 0.4 WHEN post_id % 10 >= 4 THEN 0.2 ELSE -0.2 END + CASE WHEN post_id % 3 = 0 THEN 0.2 ELSE 0 END
    + CASE content_format WHEN 'reel' THEN 0.25 WHEN 'carousel' THEN 0.05 ELSE 0 END + CASE WHEN post_id % 24 BETWEEN 12 AND 21 THEN 0.15 WHEN post_id % 24 BETWEEN 8 AND 23 THEN 0.05 ELSE -0.1 END
    + CASE WHEN post_id % 200 BETWEEN 100 AND 140 THEN 0.1 WHEN post_id % 200 BETWEEN 80 AND 160 THEN 0.05 ELSE 0 END + CASE WHEN post_id % 90 BETWEEN 20 AND 60 THEN 0.1 ELSE 0 END, 0), 2.5), 6)::DOUBLE AS score,
    least(greatest(50 + CASE WHEN post_id % 3 > 0 THEN 5 ELSE 0 END + CASE WHEN post_id % 2 > 0 THEN 10 ELSE 0 END + CASE WHEN post_id % 5 > 0 THEN 8 ELSE 0 END + CASE WHEN post_id % 7 > 0 THEN 12 ELSE 0 END, 20), 95) AS fallback,
    round(CASE WHEN post_id % 3 = 0 THEN 0.7 WHEN post_id % 3 = 1 THEN 0.6 ELSE 0.5 END + CASE WHEN post_id % 60 <= 30 THEN 0.15 ELSE 0 END + CASE WHEN post_id % 2 = 0 THEN 0.15 ELSE 0 END, 6)::DOUBLE AS idea FROM posts""",
    "posts",
    reads="posts",
)
def ml_08_09_top_14_heuristics(posts: DataFrame) -> DataFrame:
    i = F.col("post_id")
    score = Q.cold_start((i % 10) / 10, (i % 3 == 0).cast("int"), F.col("content_format"), i % 24, i % 200, i % 90)
    level = F.when(i % 3 == 0, "easy").when(i % 3 == 1, "medium").otherwise("hard")
    return posts.select("post_id", Q.fallback_score(i % 3, i % 2, i % 5, i % 7).alias("fallback"), *rounded({"score": score, "idea": Q.idea_relevance(level, i % 60, i % 2 == 0)}))


@query(
    "SELECT o.post_id, o.business_id, o.niche FROM (SELECT post_id, a.business_id, a.niche FROM posts p JOIN authors a ON p.author_id = a.author_id) o JOIN nation n ON n.n_nationkey = o.business_id WHERE n.n_regionkey = 1",
    "posts",
    "authors",
    reads="posts authors nation",
)
def join_01_02_11_training_rows(posts: DataFrame, authors: DataFrame, nation: DataFrame) -> DataFrame:
    competitors = authors.select(F.col("author_id").alias("competitor_id"), "business_id", "niche")
    businesses = nation.select(F.col("n_nationkey").cast("long").alias("business_id"), F.col("n_regionkey").cast("string").alias("business_type"))
    rows = posts.select("post_id", F.col("author_id").alias("competitor_id"))
    made = J.training_rows(rows, competitors.withColumn("business_id", F.col("business_id").cast("long")), businesses, "1")
    return made.select("post_id", F.col("business_id").cast("int").alias("business_id"), "niche")


@query("SELECT post_id FROM posts WHERE author_id IN (SELECT author_id FROM authors WHERE author_id % 3 = 0)", "posts", "authors", reads="posts authors")
def join_03_members(posts: DataFrame, authors: DataFrame) -> DataFrame:
    return J.members(posts, authors.where("author_id % 3 = 0"), "author_id").select("post_id")


@query(
    "SELECT author_id, CASE WHEN author_id % 2 = 0 THEN author_id * 10 ELSE followers END AS followers FROM authors", "authors", reads="authors"
)
def join_05_enriched(authors: DataFrame) -> DataFrame:
    details = authors.where("author_id % 2 = 0").select(F.upper("username").alias("username"), (F.col("author_id") * 10).alias("followers"), F.lit(1).alias("seen_at"))
    return J.enriched(authors, details, ["followers"]).select("author_id", "followers")


@query("SELECT c_custkey AS user_id, c_custkey % 4 <> 0 AND c_custkey % 3 = 0 AS is_own FROM customer", reads="customer")
def join_06_own_profile(customer: DataFrame) -> DataFrame:
    """A third of the users wrote their own content; every fourth is anonymous."""
    from tidemark.functions.cleaning import hashed

    user = F.when(F.col("c_custkey") % 4 != 0, F.col("c_custkey"))
    author = F.when(F.col("c_custkey") % 3 == 0, F.col("c_name")).otherwise("someone")
    content = customer.select(F.col("c_custkey").alias("id"), user.alias("user_id"), hashed(author, "salt").alias("author_hash"))
    configs = customer.select(F.col("c_custkey").alias("user_id"), F.col("c_name").alias("own_username"))
    return J.own_profile(content, configs, hashed(F.col("own_username"), "salt")).select(F.col("id").alias("user_id"), "is_own")


@query(
    """WITH f AS (SELECT post_id % 50 AS experiment, CASE post_id % 3 WHEN 0 THEN 'A' WHEN 1 THEN 'A' ELSE 'B' END AS variant, actual AS score FROM ab_logs), g AS (SELECT * FROM f UNION ALL SELECT -1, lower(variant), score FROM f),
    c AS (SELECT experiment, variant, count(*) FILTER (score >= 50) AS w, count(*) FILTER (score < 50) AS l FROM g GROUP BY 1, 2),
    v AS (SELECT DISTINCT author_id % 60 - 1 AS experiment, unnest(['A', 'B', 'a', 'b']) AS variant FROM authors)
    SELECT experiment, variant, 1 + coalesce(w, 0) AS alpha, 1 + coalesce(l, 0) AS beta FROM v LEFT JOIN c USING (experiment, variant)""",
    "ab_logs",
    "authors",
    reads="ab_logs authors",
)
def join_07_seq_04_bandit_counters(logs: DataFrame, authors: DataFrame) -> DataFrame:
    return J.feedback_variants(*_bandits(logs, authors))


def _bandits(logs: DataFrame, authors: DataFrame) -> tuple[DataFrame, DataFrame]:
    k = F.col("post_id") % 3
    feedback = logs.select(F.when(F.col("post_id") % 2 == 0, F.col("post_id") % 50).alias("variation_of"), (F.col("post_id") % 50).alias("content_id"), F.when(k == 0, "A").when(k == 2, "B").alias("label"), F.col("actual").alias("score"))
    variants = authors.select((F.col("author_id") % 60 - 1).alias("experiment")).distinct().withColumn("variant", F.explode(F.array(*[F.lit(x) for x in "ABab"])))
    return feedback, variants.withColumns({"alpha": F.lit(1), "beta": F.lit(1)})


@query(
    """SELECT experiment, variant, round(alpha / (alpha + beta), 6) AS mean, first_value(variant) OVER (PARTITION BY experiment ORDER BY alpha / (alpha + beta) DESC, alpha + beta DESC, variant DESC) AS recommended FROM
    (SELECT author_id AS experiment, unnest(['A', 'B']) AS variant, 1 + author_id % 7 + unnest([0, 1]) AS alpha, 2 + author_id % 5 - unnest([0, 1]) AS beta FROM authors) x""",
    "authors",
    reads="authors",
)
def seq_12_experiment_report(authors: DataFrame) -> DataFrame:
    return J.experiment_report(_variants(authors)).select("experiment", "variant", "recommended", *rounded({"mean": F.col("mean")}))


def _variants(authors: DataFrame) -> DataFrame:
    rows = authors.select(F.col("author_id").alias("experiment"), F.explode(F.array(F.struct(F.lit("A").alias("variant"), F.lit(0).alias("i")), F.struct(F.lit("B").alias("variant"), F.lit(1).alias("i")))).alias("x"))
    return rows.select("experiment", "x.variant", (1 + F.col("experiment") % 7 + F.col("x.i")).alias("alpha"), (2 + F.col("experiment") % 5 - F.col("x.i")).alias("beta"))


@query(reads="authors")
def seq_03_thompson(authors: DataFrame) -> DataFrame:
    """Draws repeat with their seed; a test holds their mean against the posterior's."""
    return J.thompson(_variants(authors))


@query(
    "SELECT author_id AS user_id, CASE WHEN author_id % 3 = 0 THEN NULL ELSE niche END AS niche, CASE WHEN author_id % 2 = 0 THEN author_id % 10 END AS likes_weight FROM authors", "authors", reads="authors"
)
def join_09_weights_in_force(authors: DataFrame) -> DataFrame:
    niche = F.when(F.col("author_id") % 3 != 0, F.col("niche"))
    users = authors.select(F.col("author_id").alias("user_id"), "business_id", niche.alias("niche"))
    weights = users.withColumns({"likes_weight": F.col("user_id") % 10, "is_active": F.col("user_id") % 2 == 0})
    return J.weights_in_force(users, weights).select("user_id", "niche", "likes_weight")


@query(
    """WITH b AS (SELECT c_custkey AS id, 'old' AS v, 1 AS seen, 0 AS added FROM customer UNION ALL SELECT c_custkey, 'new', 1, 1 FROM customer WHERE c_custkey % 3 = 0
      UNION ALL SELECT c_custkey + 100000, 'new', 0, 1 FROM customer WHERE c_custkey % 100 = 0)
    SELECT id, v FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY seen DESC, added DESC) AS p FROM b) WHERE p = 1""",
    reads="customer",
)
def seq_07_08_upserted(customer: DataFrame) -> DataFrame:
    """An added id may be a known customer's, whose row is later and stays."""
    known = customer.select(F.col("c_custkey").alias("id"), F.lit("old").alias("v"), F.lit(1).alias("at"))
    changed = customer.where("c_custkey % 3 = 0").select(F.col("c_custkey").alias("id"), F.lit("new").alias("v"), F.lit(1).alias("at"))
    added = customer.where("c_custkey % 100 = 0").select((F.col("c_custkey") + 100000).alias("id"), F.lit("new").alias("v"), F.lit(0).alias("at"))
    return J.upserted(known, changed.union(added), ["id"], "at").select("id", "v")


def _near(embeddings: DataFrame) -> tuple[DataFrame, DataFrame]:
    known = embeddings.select(F.col("vec_id").alias("known_id"), "label", F.col("embedding").alias("known_vector"))
    bent = F.transform("embedding", lambda x, i: F.when(i == 0, x * 1.05).otherwise(x))
    return embeddings.where("vec_id % 10 = 0").select(F.col("vec_id").alias("query_id"), "label", bent.alias("query_vector")), known


@query(
    """WITH q AS (SELECT vec_id AS query_id, label, list_transform(embedding::DOUBLE[], lambda x, i: CASE WHEN i = 1 THEN (x * 1.05)::FLOAT::DOUBLE ELSE x END) AS v FROM embeddings WHERE vec_id % 10 = 0),
    s AS (SELECT query_id, vec_id AS known_id, list_cosine_similarity(v, embedding::DOUBLE[]) AS sim, row_number() OVER (PARTITION BY query_id ORDER BY list_cosine_similarity(v, embedding::DOUBLE[]) DESC, vec_id) AS p
      FROM q JOIN embeddings e ON q.label = e.label) SELECT query_id, known_id, round(sim, 5) AS similarity FROM s WHERE p = 1 AND sim > 0.9""",
    reads="embeddings",
)
def join_08_nearest_pattern(embeddings: DataFrame) -> DataFrame:
    queries, known = _near(embeddings)
    return nearest_within(queries, known, "label").select("query_id", "known_id", *rounded({"similarity": F.col("similarity")}, 5))


@query(
    """SELECT vec_id AS pattern_id, round(CASE WHEN vec_id % 10 = 0 THEN (vec_id % 100) * 0.3 + 50 * 0.7 ELSE vec_id % 100 END, 6)::DOUBLE AS engagement, CASE WHEN vec_id % 10 = 0 THEN 2 ELSE 1 END AS usage_count,
      CASE WHEN vec_id % 10 <> 0 THEN 'e0,e1,e2,e3,e4,e5,e6,e7,e8' WHEN vec_id % 20 = 0 THEN 'e1,e2,e3,e4,e5,e6,e7,e8,y,z' ELSE 'e0,e1,e2,e3,e4,e5,e6,e7,e8,z' END AS examples FROM embeddings
    UNION ALL SELECT vec_id + 1000000, 50.0, 1, 'y,z' FROM embeddings WHERE vec_id % 10 = 1""",
    reads="embeddings",
)
def seq_06_merge_patterns(embeddings: DataFrame) -> DataFrame:
    known = embeddings.select(F.col("vec_id").alias("pattern_id"), (F.col("vec_id") % 100).cast("double").alias("engagement"), F.lit(1).alias("usage_count"), F.array(*[F.lit(f"e{i}") for i in range(9)]).alias("examples"))
    new = embeddings.where("vec_id % 10 <= 1").select((F.col("vec_id") + 1000000).alias("pattern_id"), F.lit(50.0).alias("engagement"), F.array(F.when(F.col("vec_id") % 20 <= 1, "y").when(F.col("vec_id") % 10 == 1, "y").otherwise("e8"), F.lit("z")).alias("examples"))
    queries, vectors = _near(embeddings)
    matches = nearest_within(queries.withColumn("query_id", F.col("query_id") + 1000000), vectors, "label")
    made = J.merge_patterns(known, new, matches)
    return made.select("pattern_id", "usage_count", F.array_join("examples", ",").alias("examples"), *rounded({"engagement": F.col("engagement")}))


@query(
    """SELECT author_id AS business_id, 1 + post_id % 30 AS day, round(max(CASE WHEN post_id % 3 = 0 THEN (post_id % 20) / 10.0 WHEN post_id % 3 = 1 THEN (post_id % 90) / 50.0 ELSE 1 END), 6)::DOUBLE AS rpi FROM posts GROUP BY 1, 2""",
    "posts",
    reads="posts",
)
def seq_02_join_10_impacts(posts: DataFrame) -> DataFrame:
    return _impacts(posts).select("business_id", F.col("day").cast("long").alias("day"), *rounded({"rpi": F.col("rpi")}))


def _impacts(posts: DataFrame) -> DataFrame:
    i = F.col("post_id")
    day = F.date_add(F.lit("2024-01-01").cast("date"), (1 + i % 30).cast("int"))
    content = posts.select(F.col("author_id").alias("business_id"), day.alias("scheduled"), F.when(i % 3 == 0, i % 20 / 10).alias("rpi"), F.when(i % 3 == 1, i % 90).alias("score"))
    return Q.impacts(content, "2024-01-01")


@query(
    """WITH RECURSIVE imp AS (SELECT author_id AS business_id, 1 + post_id % 30 AS day, max(CASE WHEN post_id % 3 = 0 THEN (post_id % 20) / 10.0 WHEN post_id % 3 = 1 THEN (post_id % 90) / 50.0 ELSE 1 END)::DOUBLE AS rpi FROM
      (SELECT o_orderkey AS post_id, o_custkey AS author_id FROM orders) p GROUP BY 1, 2),
    b AS (SELECT c_custkey AS business_id, (greatest(CAST(0 AS BIGINT), CAST(floor(c_acctbal) AS BIGINT)) * (1 + c_custkey % 40))::DOUBLE AS followers FROM customer),
    walk AS (SELECT business_id, CAST(0 AS BIGINT) AS day, followers AS c, CAST(0 AS DOUBLE) AS gain, 'organic' AS scenario FROM b UNION ALL
      SELECT w.business_id, w.day + 1, w.c + (w.c * 0.001 + w.c * CASE WHEN rpi > 1.5 THEN (rpi - 1) * 0.005 WHEN rpi > 1.1 THEN (rpi - 1) * 0.001 ELSE 0 END),
      w.c * 0.001 + w.c * CASE WHEN rpi > 1.5 THEN (rpi - 1) * 0.005 WHEN rpi > 1.1 THEN (rpi - 1) * 0.001 ELSE 0 END, CASE WHEN rpi > 1.5 THEN 'viral_spike' WHEN rpi > 1.1 THEN 'high_performance' ELSE 'organic' END
      FROM walk w LEFT JOIN imp i ON i.business_id = w.business_id AND i.day = w.day + 1 WHERE w.day < 30)
    SELECT business_id, day, CAST(floor(c) AS BIGINT) AS followers, CAST(floor(gain) AS BIGINT) AS daily_gain, scenario FROM walk WHERE day > 0""",
    reads="posts authors",
)
def seq_01_follower_projection(posts: DataFrame, authors: DataFrame) -> DataFrame:
    businesses = authors.select(F.col("author_id").alias("business_id"), "followers", F.lit(0.001).alias("rate"))
    made = Q.follower_projection(businesses, _impacts(posts), "2024-01-01")
    return made.select("business_id", F.col("day").cast("long").alias("day"), "followers", "daily_gain", "scenario")


_MIX = [("instagram", "reel", 50), ("instagram", "carousel", 30), ("tiktok", "reel", 100)]


@query(
    """WITH b AS (SELECT author_id, 5 + author_id % 20 AS n, CASE WHEN author_id % 2 = 0 THEN ['instagram', 'tiktok'] ELSE ['instagram'] END AS ps FROM authors), p AS (SELECT *, unnest(ps) AS platform FROM b),
    m AS (SELECT * FROM (VALUES ('instagram', 'reel', 50), ('instagram', 'carousel', 30), ('tiktok', 'reel', 100)) x(platform, content_format, percent)),
    c AS (SELECT author_id AS business_id, p.platform, content_format, CAST(floor((n // len(ps)) * percent / 100) AS INT) AS k FROM p JOIN m USING (platform))
    SELECT business_id, platform, content_format, unnest(range(1, k + 1)) AS piece FROM c WHERE k > 0""",
    "authors",
    reads="authors",
)
def seq_09_content_plan(authors: DataFrame) -> DataFrame:
    platforms = F.when(F.col("author_id") % 2 == 0, F.array(F.lit("instagram"), F.lit("tiktok"))).otherwise(F.array(F.lit("instagram")))
    rows = authors.select(F.col("author_id").alias("business_id"), (5 + F.col("author_id") % 20).alias("posts_per_month"), platforms.alias("platforms"))
    mix = authors.sparkSession.createDataFrame(_MIX, "platform string, content_format string, percent int")
    return Q.content_plan(rows, mix).withColumn("piece", F.col("piece").cast("long"))


@query(
    """SELECT post_id, CAST(least(date_trunc('month', posted_at)::DATE + CAST((post_id % 12) * greatest(day(last_day(posted_at)) // (1 + post_id % 10), 1) AS INT), last_day(posted_at)) AS VARCHAR) AS day FROM posts""", "posts", reads="posts"
)
def seq_10_posting_dates(posts: DataFrame) -> DataFrame:
    i = F.col("post_id")
    return posts.select("post_id", Q.posting_date(F.to_date("posted_at"), i % 12, 1 + i % 10).cast("string").alias("day"))


@query("SELECT author_id AS business_id, CASE WHEN author_id % 3 = 0 THEN '09:00' WHEN author_id % 2 = 0 THEN '18:00' ELSE '12:00' END AS posting_time FROM authors", "authors", reads="authors")
def seq_11_posting_time(authors: DataFrame) -> DataFrame:
    rows = authors.select(F.col("author_id").alias("business_id"), F.when(F.col("author_id") % 2 == 0, "tiktok").otherwise("other").alias("platform"))
    patterns = authors.where("author_id % 3 = 0").select(F.col("author_id").alias("business_id"), F.lit("time").alias("pattern_type"), F.lit("09:00").alias("name"), F.lit(1).alias("pattern_id"))
    return Q.posting_time(rows, patterns, {"tiktok": "18:00"}).select("business_id", "posting_time")
