"""Queries over engagement metrics and relative performance."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark import config as C
from tidemark.functions import cleaning as K
from tidemark.functions import metrics as M
from tidemark.operators import baselines as B
from tidemark.operators.ranks import Counted
from tidemark.plans.register import query, rounded

_RPI = "(CAST(likes AS DOUBLE) + comments * 2::DOUBLE + saves * 5::DOUBLE + shares * 10::DOUBLE + views * 0.01::DOUBLE)"
_SCORE = "CAST(likes + comments * 3 + saves * 5 + shares * 4 AS DOUBLE)"


@query(f"SELECT post_id, round({_RPI}, 6) AS weighted_engagement FROM posts", "posts", reads="posts")
def met_01_weighted_engagement(posts: DataFrame) -> DataFrame:
    return M.harmonised(posts).select("post_id", *rounded({"weighted_engagement": M.weighted(C.RPI)}))


@query(
    f"""SELECT post_id, round(CASE WHEN followers > 0 THEN {_SCORE} / followers * 100 ELSE 0 END, 4) AS engagement_ratio,
    round(CASE WHEN followers > 0 THEN least({_SCORE} / followers * 1000, 100) ELSE 0 END, 6) AS row_score
    FROM posts p JOIN authors a ON p.author_id = a.author_id""",
    "posts",
    "authors",
    reads="posts authors",
)
def met_02_05_engagement_ratio(posts: DataFrame, authors: DataFrame) -> DataFrame:
    rows = M.harmonised(posts).join(authors.select("author_id", "followers"), "author_id")
    amount = M.weighted(C.SCORE)
    return rows.select("post_id", F.round(M.ratio(amount, F.col("followers")), 4).alias("engagement_ratio"), *rounded({"row_score": M.follower_score(amount, F.col("followers"))}))


@query(
    f"""SELECT post_id,
    round(CASE WHEN views > 2000 THEN least({_SCORE} / views * 1000, 100) WHEN followers > 0 THEN least({_SCORE} / followers * 1000, 100)
      WHEN {_SCORE} > 0 THEN least(log10({_SCORE} + 1) * 20, 100) ELSE 0 END, 6) AS with_followers,
    round(CASE WHEN views > 2000 THEN least({_SCORE} / views * 1000, 100) WHEN {_SCORE} > 0 THEN least(log10({_SCORE} + 1) * 20, 100) ELSE 0 END, 6) AS without
    FROM posts p JOIN authors a ON p.author_id = a.author_id""",
    "posts",
    "authors",
    reads="posts authors",
)
def met_03_04_engagement_score(posts: DataFrame, authors: DataFrame) -> DataFrame:
    """Views up to 2,000 count as none here, so that every branch occurs."""
    rows = M.harmonised(posts).join(authors.select("author_id", "followers"), "author_id")
    views = F.when(F.col("views") > 2000, F.col("views")).otherwise(0)
    amount = M.weighted(C.SCORE)
    return rows.select("post_id", *rounded({"with_followers": M.score(amount, views, F.col("followers")), "without": M.score(amount, views)}))


@query(
    """SELECT post_id, round(ln(1 + likes), 6) AS log_likes, round(ln(1 + comments), 6) AS log_comments, round(ln(1 + shares), 6) AS log_shares,
    round(ln(1 + saves), 6) AS log_saves, round(ln(1 + views), 6) AS log_views, round(CASE WHEN views > 0
    THEN (likes + comments * 2.0 + saves * 3.0 + shares * 4.0) / views * 100 ELSE least(100, (likes + comments * 2.0 + saves * 3.0 + shares * 4.0) / 10) END, 6) AS engagement_rate
    FROM posts""",
    "posts",
    reads="posts",
)
def met_06_targets(posts: DataFrame) -> DataFrame:
    return M.harmonised(posts).select("post_id", *rounded(M.targets(C.INGEST)))


@query(
    """SELECT post_id, round(ln(1 + likes), 6) AS log_likes, round(ln(1 + comments), 6) AS log_comments, 0.0::DOUBLE AS log_shares,
    round(ln(1 + saves), 6) AS log_saves, round(ln(1 + views), 6) AS log_views FROM posts""",
    "posts",
    reads="posts",
)
def met_07_output_targets(posts: DataFrame) -> DataFrame:
    rows = posts.drop("shares").withColumnRenamed("likes", "likes_count")
    return rows.select("post_id", *rounded(M.output_targets(rows.columns)))


_HISTORY = f"""eng AS (SELECT *, {_RPI} AS e FROM posts),
own AS (SELECT *, CASE WHEN count(e) OVER w >= 5 THEN median(e) OVER w END AS personal, CASE WHEN count(e) OVER w >= 5 THEN avg(e) OVER w END AS mean_base,
  list(e) OVER w AS past FROM eng WINDOW w AS (PARTITION BY author_id ORDER BY posted_at, post_id ROWS BETWEEN 20 PRECEDING AND 1 PRECEDING)),
niches AS (SELECT niche, median(e) AS m, avg(e) AS mean_engagement, stddev_samp(e) AS std_engagement, count(e) AS n, quantile_cont(e, 0.25) AS q1, quantile_cont(e, 0.75) AS q3
  FROM eng WHERE niche IS NOT NULL GROUP BY niche HAVING count(e) >= 10),
overall AS (SELECT median(e) AS g FROM eng),
rpi AS (SELECT o.*, coalesce(personal, m, g, 100.0) AS baseline, CASE WHEN personal IS NOT NULL THEN 'personal' WHEN m IS NOT NULL THEN 'niche' ELSE 'global' END AS source,
  least(greatest(e / greatest(coalesce(personal, m, g, 100.0), 1.0), 0.01), 100.0) AS raw
  FROM own o LEFT JOIN niches USING (niche) CROSS JOIN overall)"""


@query(
    f"WITH {_HISTORY} SELECT post_id, round(e, 6) AS weighted_engagement, round(baseline, 6) AS baseline_engagement, source AS baseline_source, round(raw, 6) AS rpi_raw, round(ln(1 + raw), 6) AS rpi_score FROM rpi",
    "posts",
    reads="posts",
)
def win_06_relative_performance(posts: DataFrame) -> DataFrame:
    made = B.relative_performance(posts)
    return made.select("post_id", "baseline_source", *rounded({c: F.col(c) for c in ("weighted_engagement", "baseline_engagement", "rpi_raw", "rpi_score")}))


@query(f"WITH {_HISTORY} SELECT post_id, round(mean_base, 6) AS mean_baseline, round(personal, 6) AS median_baseline FROM own", "posts", reads="posts")
def win_01_02_03_baselines(posts: DataFrame) -> DataFrame:
    rows = M.harmonised(posts).withColumn("e", M.weighted(C.RPI))
    make = lambda s: B.baseline("e", C.Normalisation(strategy=s))
    return rows.select("post_id", *rounded({"mean_baseline": make("mean"), "median_baseline": make("median")}))


@query(
    f"""WITH {_HISTORY}, ends AS (SELECT post_id, past, personal, list_sort(past) AS s, len(past) AS n FROM own WHERE len(past) >= 5),
    cuts AS (SELECT *, s[1 + CAST(floor((n - 1) * 0.1) AS INT)] + ((n - 1) * 0.1 - floor((n - 1) * 0.1)) * (s[least(n, 2 + CAST(floor((n - 1) * 0.1) AS INT))] - s[1 + CAST(floor((n - 1) * 0.1) AS INT)]) AS lo,
      s[1 + CAST(floor((n - 1) * 0.9) AS INT)] + ((n - 1) * 0.9 - floor((n - 1) * 0.9)) * (s[least(n, 2 + CAST(floor((n - 1) * 0.9) AS INT))] - s[1 + CAST(floor((n - 1) * 0.9) AS INT)]) AS hi FROM ends)
    SELECT o.post_id, round(coalesce(list_avg(list_filter(c.past, lambda x: x >= lo AND x <= hi)), c.personal), 6) AS trimmed_baseline FROM own o LEFT JOIN cuts c USING (post_id)""",
    "posts",
    reads="posts",
)
def win_04_trimmed_baseline(posts: DataFrame) -> DataFrame:
    rows = M.harmonised(posts).withColumn("e", M.weighted(C.RPI))
    return rows.select("post_id", *rounded({"trimmed_baseline": B.baseline("e", C.Normalisation(strategy="trimmed_mean"))}))


@query(
    f"""WITH {_HISTORY}, flat AS (SELECT post_id, len(past) AS n, past[i] AS v, i, CASE WHEN len(past) = 1 THEN 0.5 ELSE 0.5 + 0.5 * (i - 1) / (len(past) - 1) END AS w
      FROM (SELECT post_id, past, unnest(range(1, len(past) + 1)) AS i FROM own WHERE len(past) >= 5) x),
    cum AS (SELECT *, sum(w) OVER (PARTITION BY post_id ORDER BY v, i) AS c, sum(w) OVER (PARTITION BY post_id) AS total FROM flat)
    SELECT o.post_id, round(b.v, 6) AS weighted_baseline FROM own o LEFT JOIN (SELECT post_id, min(v) AS v FROM cum WHERE c >= total / 2 - 1e-9 GROUP BY post_id) b USING (post_id)""",
    "posts",
    reads="posts",
)
def win_05_weighted_median_baseline(posts: DataFrame) -> DataFrame:
    rows = M.harmonised(posts).withColumn("e", M.weighted(C.RPI))
    return rows.select("post_id", *rounded({"weighted_baseline": B.baseline("e", C.Normalisation(strategy="weighted_median"))}))


@query(
    f"WITH {_HISTORY} SELECT post_id, round(raw, 6) AS rpi_raw FROM rpi WHERE post_id % 10 = 0",
    "posts",
    reads="posts",
)
def win_07_score_new(posts: DataFrame) -> DataFrame:
    """The tenth part of the posts counts as new here; all of them stand in each other's history."""
    new = F.col("post_id") % 10 == 0
    return B.score_new(posts.where(~new), posts.where(new)).select("post_id", *rounded({"rpi_raw": F.col("rpi_raw")}))


@query(
    f"""WITH {_HISTORY} SELECT niche, round(m, 6) AS median_engagement, round(mean_engagement, 6) AS mean_engagement, round(std_engagement, 4) AS std_engagement, n AS sample_size,
    round(q1, 6) AS percentile_25, round(q3, 6) AS percentile_75 FROM niches""",
    "posts",
    reads="posts",
)
def agg_01_niche_baselines(posts: DataFrame) -> DataFrame:
    rows = M.harmonised(posts).withColumn("weighted_engagement", M.weighted(C.RPI))
    made = B.niche_baselines(rows)
    values = {c: F.col(c) for c in ("median_engagement", "mean_engagement", "percentile_25", "percentile_75")}
    return made.select("niche", "sample_size", F.round("std_engagement", 4).alias("std_engagement"), *rounded(values))


@query(
    f"""WITH {_HISTORY}, s AS (SELECT source, ln(1 + raw) AS x FROM rpi) SELECT count(*) AS total_posts, count(*) FILTER (source = 'personal') AS personal_posts,
    count(*) FILTER (source = 'niche') AS niche_posts, count(*) FILTER (source = 'global') AS global_posts, round(avg(x), 6) AS rpi_mean, round(stddev_samp(x), 6) AS rpi_std,
    round(min(x), 6) AS rpi_min, round(max(x), 6) AS rpi_max, round(quantile_cont(x, 0.25), 6) AS rpi_25, round(median(x), 6) AS rpi_50, round(quantile_cont(x, 0.75), 6) AS rpi_75,
    round(1 - count(*) FILTER (source = 'personal') / count(*), 6) AS cold_start_rate FROM s""",
    "posts",
    reads="posts",
)
def agg_02_summary(posts: DataFrame) -> DataFrame:
    made = B.summary(B.relative_performance(posts.select("post_id", "author_id", "niche", "posted_at", *C.METRICS)))
    counts = [c for c in made.columns if c.endswith("_posts")]
    return made.select(*counts, *rounded({c: F.col(c) for c in made.columns if c not in counts}))


@query(
    f"""WITH {_HISTORY} SELECT e.post_id, round(coalesce(m, g, 100.0), 6) AS fallback, CASE WHEN m IS NOT NULL THEN 'niche' ELSE 'global' END AS fallback_source
    FROM eng e LEFT JOIN niches USING (niche) CROSS JOIN overall""",
    "posts",
    reads="posts",
)
def join_04_fallback_baseline(posts: DataFrame) -> DataFrame:
    rows = M.harmonised(posts).withColumn("weighted_engagement", M.weighted(C.RPI))
    overall = Counted(rows, "weighted_engagement").quantiles([0.5]).select(F.col("q")[0].alias("global_median"))
    return B.with_fallback(rows, B.niche_baselines(rows), overall).select("post_id", "fallback_source", *rounded({"fallback": F.col("fallback")}))


@query(
    f"""SELECT post_id, round(least(greatest({_RPI} / greatest(views - 2000, 1.0), 0.01), 100.0), 6) AS rpi_raw,
    round(least(greatest({_RPI} / CASE WHEN views - 2000 <= 0 THEN 1.0 ELSE views - 2000 END, 0.01), 100.0), 6) AS rpi_open,
    round((exp(ln(1 + least(greatest({_RPI} / greatest(views - 2000, 1.0), 0.01), 100.0))) - 1) * (views - 2000), 4) AS engagement FROM posts""",
    "posts",
    reads="posts",
)
def met_08_09_index(posts: DataFrame) -> DataFrame:
    base = F.col("views") - 2000
    raw = M.index(M.weighted(C.RPI), base)
    rows = M.harmonised(posts)
    return rows.select("post_id", *rounded({"rpi_raw": raw, "rpi_open": M.index(M.weighted(C.RPI), base, floor=False)}), F.round(M.from_index(F.log1p(raw), base), 4).alias("engagement"))


@query("SELECT post_id, actual AS feedback_score FROM ab_logs", "ab_logs", reads="posts")
def met_10_feedback_score(posts: DataFrame) -> DataFrame:
    return M.harmonised(posts).select("post_id", M.feedback_score(M.weighted(C.SCORE), F.col("views")).alias("feedback_score"))


@query(
    f"""WITH q AS (SELECT quantile_cont({_SCORE}, 0.95) AS top FROM posts) SELECT post_id, round(CASE WHEN top > 0 THEN least(greatest({_SCORE} / top * 100, 0), 100) ELSE 0 END, 6) AS target FROM posts CROSS JOIN q""",
    "posts",
    reads="posts",
)
def met_11_quantile_target(posts: DataFrame) -> DataFrame:
    made = M.scaled_by_quantile(M.harmonised(posts), M.weighted(C.SCORE))
    return made.select("post_id", *rounded({"target": F.col("target")}))


@query(
    """SELECT post_id, round(CASE WHEN views = 0 THEN 0 ELSE (likes + comments + saves + shares) / views END, 6) AS engagement_rate, round(CASE WHEN views = 0 THEN 0 ELSE saves / views END, 6) AS save_rate,
    round(CASE WHEN comments = 0 THEN 0 ELSE likes / comments END, 6) AS likes_per_comment, round(CASE WHEN views = 0 THEN 0 ELSE (likes + comments) / views * 100 END, 6) AS interaction_percent FROM posts""",
    "posts",
    reads="posts",
)
def met_12_13_rates(posts: DataFrame) -> DataFrame:
    c = {m: F.col(m) for m in C.METRICS}
    made = {
        "engagement_rate": M.rate(c["likes"] + c["comments"] + c["saves"] + c["shares"], c["views"]),
        "save_rate": M.rate(c["saves"], c["views"]),
        "likes_per_comment": M.rate(c["likes"], c["comments"]),
        "interaction_percent": M.rate(c["likes"] + c["comments"], c["views"], percent=True),
    }
    return M.harmonised(posts).select("post_id", *rounded(made))


@query(
    """SELECT post_id, round((likes + comments * 2.0 + shares * 10 + saves * 5 + views * 3) / 21, 2) AS weighted_rpi, round(likes + comments * 2.0 + shares * 10 + saves * 5 + views * 3, 2) AS raw_weighted_sum,
    likes::DOUBLE AS likes_part, comments * 2.0::DOUBLE AS comments_part, shares * 10.0::DOUBLE AS shares_part, saves * 5.0::DOUBLE AS saves_part, views * 3.0::DOUBLE AS views_part,
    round((likes * 2 + comments * 3 + shares * 15.0 + saves * 4 + views * 6) / 30, 6) AS plain_index FROM posts""",
    "posts",
    reads="posts",
)
def met_14_24_kpi_index(posts: DataFrame) -> DataFrame:
    made = M.kpi_index(C.KPI)
    return M.harmonised(posts).select("post_id", *[c.alias(k) for k, c in made.items()], *rounded({"plain_index": M.plain_index(C.TEMPLATES["viral"])}))


_LOGS = "ln(1 + likes) * {0} + ln(1 + comments) * {1} + ln(1 + shares) * {2} + ln(1 + saves) * {3} + ln(1 + views) * {4}"


@query(
    f"""WITH x AS (SELECT post_id, least(greatest(({_LOGS.format(1, 2, 10, 5, 3)}) / 21 * 15, 0), 100) AS log_index, least(greatest(({_LOGS.format(2, 10, 5, 4, 3)}) / 24 * 20, 0), 100) AS own,
      least(greatest(({_LOGS.format(1, 2, 10, 5, 3)}) / 21 * 20, 0), 100) AS def FROM posts)
    SELECT post_id, round(log_index, 6) AS log_index, round(own, 6) AS weighted_rpi, round(def, 6) AS default_rpi, round(own - def, 6) AS difference,
    round((own - def) / greatest(def, 1) * 100, 6) AS percent_change, 'comments' AS top_metric FROM x""",
    "posts",
    reads="posts",
)
def met_15_16_17_log_index(posts: DataFrame) -> DataFrame:
    rows = M.harmonised(posts).select("post_id", *[c.alias(k) for k, c in M.targets(C.INGEST).items()])
    made = M.preview(C.TEMPLATES["community"])
    top = made.pop("top_metric")
    return rows.select("post_id", top.alias("top_metric"), *rounded({"log_index": M.log_index(C.KPI)} | made))


@query(
    """WITH b AS (SELECT author_id, avg(likes) AS al, avg(comments) AS ac, avg(shares) AS ah, avg(saves) AS asv, avg(views) AS av FROM posts GROUP BY author_id)
    SELECT post_id, round(list_avg(list_filter([CASE WHEN al > 0 THEN likes / al END, CASE WHEN ac > 0 THEN comments / ac END, CASE WHEN ah > 0 THEN shares / ah END,
      CASE WHEN asv > 0 THEN saves / asv END, CASE WHEN av > 0 THEN views / av END], lambda x: x IS NOT NULL)), 6) AS relative_score FROM posts JOIN b USING (author_id)""",
    "posts",
    reads="posts",
)
def met_18_relative_score(posts: DataFrame) -> DataFrame:
    mean = posts.groupBy("author_id").agg(*[F.avg(m).alias(f"avg_{m}") for m in C.METRICS])
    return posts.join(mean, "author_id").select("post_id", *rounded({"relative_score": M.relative_score()}))


@query(
    """SELECT post_id, CASE post_id % 4 WHEN 0 THEN CAST(round(round(views / 1000.0, 1) * 1000) AS BIGINT) WHEN 3 THEN 0 ELSE views END AS n FROM posts""",
    "posts",
    reads="posts",
)
def met_19_parsed_counts(posts: DataFrame) -> DataFrame:
    """Counts written as people write them, read back."""
    thousands = F.format_number(F.col("views"), 0)
    short = F.concat(F.round(F.col("views") / 1000, 1).cast("decimal(18,1)").cast("string"), F.lit("K"))
    text = F.when(F.col("post_id") % 4 == 0, short).when(F.col("post_id") % 4 == 1, thousands).when(F.col("post_id") % 4 == 2, F.concat(F.lit(" "), F.col("views").cast("string"))).otherwise("n/a")
    return posts.select("post_id", M.parsed_count(text).alias("n"))


_DELTA = "CASE WHEN predicted > 0 THEN (actual - predicted) / predicted * 100 WHEN actual > 0 THEN 100 ELSE 0 END"


@query(
    f"""WITH d AS (SELECT *, {_DELTA} AS delta FROM ab_logs) SELECT post_id, round(delta, 6) AS delta, abs(delta) > 20 AS high,
    round(least(1, greatest(0, least(1, abs(delta) / 100) * CASE WHEN abs(delta) > 50 THEN 1.5 WHEN abs(delta) > 20 THEN 1.2 ELSE 1 END * CASE content_format WHEN 'carousel' THEN 1.3
      WHEN 'static_image' THEN 1.2 ELSE 1 END * CASE WHEN views > 10000 THEN 1.3 WHEN views > 1000 THEN 1.1 ELSE 1 END)), 6) AS priority,
    CASE post_id % 4 WHEN 0 THEN 1.0 WHEN 1 THEN 0.7 WHEN 2 THEN 0.1 ELSE 0.5 END::DOUBLE AS satisfaction,
    regexp_replace(concat_ws('; ', CASE WHEN delta > 20 THEN concat('Model UNDERESTIMATED by ', printf('%.1f', round(delta::DOUBLE, 1)), '%; Content performed better than expected')
      WHEN delta < -20 THEN concat('Model OVERESTIMATED by ', printf('%.1f', round(abs(delta)::DOUBLE, 1)), '%; Content underperformed expectations')
      ELSE concat('Prediction within acceptable range (delta: ', printf('%.1f', round(delta::DOUBLE, 1)), '%)') END,
      CASE WHEN comments > likes * 0.1 THEN 'High comment ratio suggests strong audience connection' END,
      CASE WHEN saves > likes * 0.05 THEN 'High save ratio indicates valuable/educational content' END,
      CASE WHEN shares > likes * 0.03 THEN 'High share ratio shows viral potential' END), '-?[0-9]+[.][0-9]', 'x') AS notes FROM d""",
    "ab_logs",
    reads="ab_logs",
)
def met_20_21_22_23_feedback(logs: DataFrame) -> DataFrame:
    rows = logs.withColumn("delta", M.delta(F.col("actual"), F.col("predicted")))
    d = F.col("delta")
    label = F.element_at(F.array(*[F.lit(x) for x in ("viral", "good", "flop", "other")]), (F.col("post_id") % 4 + 1).cast("int"))
    # The printed digits are left out, as the engines round ties differently.
    return rows.select(
        "post_id", M.is_high_priority(d).alias("high"), M.satisfaction(label).alias("satisfaction"), F.regexp_replace(M.feedback_notes(d), r"-?[0-9]+[.][0-9]", "x").alias("notes"),
        *rounded({"delta": d, "priority": M.priority(d, F.col("content_format"), F.col("views"))}),
    )


@query(
    """SELECT post_id, hour(posted_at + INTERVAL (post_id % 24) HOUR) AS hour_of_day, isodow(posted_at + INTERVAL (post_id % 24) HOUR) - 1 AS day_of_week,
    CAST(isodow(posted_at + INTERVAL (post_id % 24) HOUR) >= 6 AS INT) AS is_weekend, CAST(hour(posted_at + INTERVAL (post_id % 24) HOUR) IN (11, 12, 13, 19, 20, 21) AS INT) AS is_prime_time,
    CAST(content_format IN ('reel', 'tiktok_video') AS INT) AS is_reel, CAST(content_format = 'carousel' AS INT) AS is_carousel, CAST(content_format = 'static_image' AS INT) AS is_static,
    content_format IN ('reel', 'tiktok_video') AS is_video, CASE content_format WHEN 'carousel' THEN 0 WHEN 'reel' THEN 1 WHEN 'story' THEN 3 ELSE -1 END AS encoded FROM posts""",
    "posts",
    reads="posts",
)
def cln_02_03_04_05_08_time_and_format(posts: DataFrame) -> DataFrame:
    at = F.timestamp_seconds(F.unix_timestamp(F.col("posted_at").cast("timestamp")) + F.col("post_id") % 24 * 3600)
    fmt = F.col("content_format")
    none = F.lit(None)
    made = K.hour_and_day(at) | K.format_flags(fmt) | {"is_video": K.is_video(none.cast("string"), none.cast("int"), fmt, none.cast("int")), "encoded": K.encoded(fmt)}
    made["hour_of_day"], made["day_of_week"] = made["hour_of_day"].cast("long"), made["day_of_week"].cast("long")
    return posts.select("post_id", *[c.alias(k) for k, c in made.items()])


@query(
    """SELECT post_id, CASE WHEN post_id % 5 = 4 THEN NULL WHEN post_id % 5 = 1 THEN posted_at ELSE posted_at + INTERVAL 7 HOUR END AS at FROM posts""",
    "posts",
    reads="posts",
)
def cln_01_parsed_time(posts: DataFrame) -> DataFrame:
    later = F.timestamp_seconds(F.unix_timestamp(F.col("posted_at").cast("timestamp")) + 7 * 3600)
    k = F.col("post_id") % 5
    iso = F.when(k == 0, F.date_format(later, "yyyy-MM-dd'T'HH:mm:ss'Z'")).when(k == 1, F.date_format("posted_at", "yyyy-MM-dd")).when(k == 2, F.date_format(later, "yyyy-MM-dd'T'HH:mm:ss"))
    epoch = F.when(k == 3, F.unix_timestamp(later).cast("string"))
    return posts.select("post_id", K.parsed_time(iso, epoch).cast("timestamp_ntz").alias("at"))


@query(
    """SELECT c_custkey AS id, CASE WHEN c_custkey % 11 = 0 THEN NULL ELSE sha256(concat('salt', trim(c_name))) END AS hashed, substr(sha256(concat_ws(':', 'ig', c_custkey, c_name)), 1, 16) AS key FROM customer""",
    reads="customer",
)
def cln_11_14_16_hashes(customer: DataFrame) -> DataFrame:
    name = F.when(F.col("c_custkey") % 11 == 0, "  ").otherwise(F.concat(F.lit(" "), F.col("c_name")))
    return customer.select(F.col("c_custkey").alias("id"), K.hashed(name, "salt").alias("hashed"), K.content_key(F.lit("ig"), F.col("c_custkey").cast("string"), F.col("c_name")).alias("key"))


@query(
    """SELECT doc_id, regexp_replace(regexp_replace(text, '[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\\.[A-Za-z]{2,}', '[EMAIL]', 'g'), '@[A-Za-z0-9_.]+', '[HANDLE]', 'g') AS text FROM documents""",
    reads="documents",
)
def cln_13_redacted(documents: DataFrame) -> DataFrame:
    return documents.select("doc_id", K.redacted(F.col("text")).alias("text"))


@query(
    """SELECT post_id, round(least(greatest(target, 0), 5), 6) AS target, coalesce(f, 0)::DOUBLE AS f FROM (SELECT post_id, CASE WHEN post_id % 9 = 0 THEN NULL ELSE ln(1 + views) - 3 END AS target,
    CASE WHEN post_id % 4 = 0 THEN NULL ELSE likes END AS f FROM posts) x WHERE target IS NOT NULL""",
    "posts",
    reads="posts",
)
def cln_09_validated(posts: DataFrame) -> DataFrame:
    odd = F.when(F.col("post_id") % 18 == 0, F.lit(float("inf"))).when(F.col("post_id") % 9 != 0, F.log1p("views") - 3)
    rows = posts.select("post_id", odd.alias("target"), F.when(F.col("post_id") % 4 != 0, F.col("likes").cast("double")).alias("f"))
    return K.validated(rows, "target", ["f"])[0].select("post_id", "f", *rounded({"target": F.col("target")}))


@query("SELECT post_id FROM posts WHERE likes - 20 < 0 OR saves - 1 < 0", "posts", reads="posts")
def cln_10_quarantined(posts: DataFrame) -> DataFrame:
    rows = posts.select("post_id", (F.col("likes") - 20).alias("likes"), (F.col("saves") - 1).alias("saves"))
    return K.quarantined(rows, ["likes", "saves"])[1].select("post_id")
