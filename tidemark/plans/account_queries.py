"""Queries over accounts, samples, labels and trends."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark import config as C
from tidemark.functions import metrics as M
from tidemark.operators import accounts as A
from tidemark.operators import baselines as B
from tidemark.operators import sampling as S
from tidemark.operators import trends as V
from tidemark.plans.register import query, rounded

_ES = "CAST(likes + comments * 3 + saves * 5 + shares * 4 AS DOUBLE)"
_AS_OF = "1999-01-01"


def _scored(posts: DataFrame) -> DataFrame:
    return posts.withColumn("engagement_score", (F.col("likes") + F.col("comments") * 3 + F.col("saves") * 5 + F.col("shares") * 4).cast("double"))


_HEALTH = """newest AS (SELECT *, row_number() OVER (PARTITION BY author_id ORDER BY posted_at DESC, post_id DESC) AS p FROM posts),
m AS (SELECT author_id, count(*) AS n, avg(views) FILTER (views > 0) AS a, stddev_pop(views) FILTER (views > 0) AS s FROM newest WHERE p <= 10 GROUP BY author_id),
h AS (SELECT x.author_id, followers, coalesce(n, 0) AS n, a, s, coalesce(n, 0) >= 5 AND a IS NOT NULL AS ok, a / greatest(followers, 1) AS r FROM authors x LEFT JOIN m USING (author_id)),
b AS (SELECT *, CASE WHEN NOT ok THEN 'normal' WHEN r >= 0.2 THEN 'high' WHEN r >= 0.1 THEN 'normal' WHEN r >= 0.02 THEN 'low' ELSE 'critical' END AS band FROM h)"""


@query(
    f"""WITH {_HEALTH} SELECT author_id, followers, n AS posts_analyzed, round(CASE WHEN ok THEN a ELSE 0 END, 4) AS avg_views, round(CASE WHEN ok THEN s ELSE 0 END, 4) AS std_views,
    round(CASE WHEN ok THEN r ELSE 0 END, 6) AS views_to_followers_ratio, band AS authority_level, CASE WHEN NOT ok THEN 'insufficient_data' WHEN band = 'low' THEN 'low_authority'
    WHEN band = 'critical' THEN 'possible_shadowban' ELSE 'healthy' END AS health_status, CASE band WHEN 'low' THEN 0.3 WHEN 'critical' THEN 0.1 ELSE 1.0 END::DOUBLE AS penalty_factor FROM b""",
    "posts",
    "authors",
    reads="posts authors",
)
def agg_03_account_health(posts: DataFrame, authors: DataFrame) -> DataFrame:
    made = A.health(posts, authors)
    return made.select("author_id", "followers", "posts_analyzed", "authority_level", "health_status", "penalty_factor", *rounded({c: F.col(c) for c in ("avg_views", "std_views")}, 4), *rounded({"views_to_followers_ratio": F.col("views_to_followers_ratio")}))


@query(
    f"""WITH {_HEALTH} SELECT post_id, round(views * f, 4) AS calibrated_raw, round(ln(1 + views) + ln(f), 6) AS calibrated_score
    FROM posts JOIN (SELECT author_id, CASE band WHEN 'low' THEN 0.3 WHEN 'critical' THEN 0.1 ELSE 1.0 END::DOUBLE AS f FROM b) x USING (author_id)""",
    "posts",
    "authors",
    reads="posts authors",
)
def ml_13_calibrated(posts: DataFrame, authors: DataFrame) -> DataFrame:
    rows = posts.select("post_id", "author_id", F.col("views").cast("double").alias("rpi_raw"), F.log1p("views").alias("rpi_score"))
    made = A.calibrated(rows, A.health(posts, authors))
    return made.select("post_id", F.round("calibrated_raw", 4).alias("calibrated_raw"), *rounded({"calibrated_score": F.col("calibrated_score")}))


def _activity(late: bool) -> str:
    score = "r * 0.4 + least(m * 12.5, 100) * 0.4 + least(n * 10, 100) * 0.2"
    return f"""WITH a AS (SELECT author_id, max(posted_at) AS last, count(*) FILTER (posted_at >= TIMESTAMP '{_AS_OF}' - INTERVAL 30 DAY) AS m, count(*) AS n FROM posts WHERE posted_at < TIMESTAMP '{_AS_OF}' GROUP BY author_id),
    d AS (SELECT *, CAST(floor(epoch(TIMESTAMP '{_AS_OF}' - last) / 86400) AS INT) AS days FROM a),
    s AS (SELECT *, CASE WHEN days <= 3 THEN 100 WHEN days <= 7 THEN 90 WHEN days <= 14 THEN 75 WHEN days <= 30 THEN 50 WHEN days <= 60 THEN 25 {'WHEN days <= 90 THEN 10' if late else ''} ELSE 0 END AS r FROM d)
    SELECT author_id, days AS days_since_last_post, m AS posts_last_month, n AS total_posts, {f'round(({score})::DOUBLE, 1)' if late else f'CAST(floor({score}) AS BIGINT)'} AS activity_score,
    CASE WHEN days <= 7 AND m >= 2 THEN 'active' WHEN days <= 30 AND m >= 1 THEN 'moderately_active' WHEN days <= 90 THEN 'inactive' ELSE 'dormant' END AS activity_status FROM s"""


@query(_activity(False), "posts", reads="posts")
def agg_06_activity(posts: DataFrame) -> DataFrame:
    return A.activity(posts.where(F.col("posted_at") < F.lit(_AS_OF).cast("timestamp_ntz")), _AS_OF).drop("last_post_date")


@query(_activity(True), "posts", reads="posts")
def agg_06_activity_discovery(posts: DataFrame) -> DataFrame:
    return A.activity(posts.where(F.col("posted_at") < F.lit(_AS_OF).cast("timestamp_ntz")), _AS_OF, late=True).drop("last_post_date")


_DELTA = "CASE WHEN predicted > 0 THEN (actual - predicted) / predicted * 100 WHEN actual > 0 THEN 100 ELSE 0 END"


@query(
    f"""WITH d AS (SELECT *, {_DELTA} AS delta FROM ab_logs) SELECT count(*) AS total, count(*) FILTER (abs(delta) > 20) AS high_priority, round(avg(delta), 6) AS mean_delta, round(avg(actual - predicted), 6) AS bias,
    round(sqrt(avg((actual - predicted) * (actual - predicted))), 6) AS rmse, round(avg(abs(actual - predicted)), 6) AS mae, round(count(*) FILTER (abs(delta) <= 20) / count(*) * 100, 6) AS within_20 FROM d""",
    "ab_logs",
    reads="ab_logs",
)
def agg_07_experiment_statistics(logs: DataFrame) -> DataFrame:
    rows = logs.withColumn("delta", M.delta(F.col("actual"), F.col("predicted"))).withColumn("high", M.is_high_priority(F.col("delta")))
    made = A.experiment_statistics(rows)
    return made.select("total", "high_priority", *rounded({c: F.col(c) for c in ("mean_delta", "bias", "rmse", "mae", "within_20")}))


@query(
    f"""WITH d AS (SELECT *, {_DELTA} AS delta FROM ab_logs) SELECT count(*) AS total, round(avg(delta), 6) AS mean_delta, round(stddev_pop(delta), 6) AS std_delta, count(*) FILTER (delta < -20) AS overestimated,
    count(*) FILTER (delta > 20) AS underestimated, CASE WHEN avg(delta) > 5 THEN 'underestimating' WHEN avg(delta) < -5 THEN 'overestimating' ELSE 'balanced' END AS bias FROM d""",
    "ab_logs",
    reads="ab_logs",
)
def agg_08_feedback_statistics(logs: DataFrame) -> DataFrame:
    made = A.feedback_statistics(logs.withColumn("delta", M.delta(F.col("actual"), F.col("predicted"))))
    return made.select("total", "overestimated", "underestimated", "bias", *rounded({c: F.col(c) for c in ("mean_delta", "std_delta")}))


_STATUS = "CASE author_id % 4 WHEN 0 THEN 'completed' WHEN 1 THEN 'pending' WHEN 2 THEN 'failed' ELSE 'processing' END"


@query(
    f"""WITH s AS (SELECT business_id, {_STATUS} AS st FROM authors) SELECT business_id, count(*) AS total, count(*) FILTER (st = 'completed') AS completed, count(*) FILTER (st = 'pending') AS pending,
    count(*) FILTER (st = 'failed') AS failed, count(*) FILTER (st = 'completed') > 0 AS ready FROM s GROUP BY business_id""",
    "authors",
    reads="authors",
)
def agg_22_status_counts(authors: DataFrame) -> DataFrame:
    return A.status_counts(authors.withColumn("st", F.expr(_STATUS)), "business_id", "st", ["completed", "pending", "failed"])


@query("SELECT author_id, round(avg(likes), 6) AS avg_likes, round(avg(comments), 6) AS avg_comments FROM posts GROUP BY author_id", "posts", reads="posts")
def agg_23_profile_averages(posts: DataFrame) -> DataFrame:
    return A.profile_averages(posts).select("author_id", *rounded({c: F.col(c) for c in ("avg_likes", "avg_comments")}))


@query(
    """WITH c AS (SELECT author_id % 50 AS calendar_id, count(*) AS pieces FROM posts WHERE author_id % 50 < 40 GROUP BY 1) SELECT k.calendar_id, k.created_at, coalesce(pieces, 0) AS pieces
    FROM (SELECT DISTINCT author_id % 50 AS calendar_id, author_id % 50 * 3 AS created_at FROM authors) k LEFT JOIN c USING (calendar_id)""",
    "posts",
    "authors",
    reads="posts authors",
)
def agg_25_calendar_list(posts: DataFrame, authors: DataFrame) -> DataFrame:
    calendars = authors.select((F.col("author_id") % 50).alias("calendar_id"), (F.col("author_id") % 50 * 3).alias("created_at")).distinct()
    return A.calendar_list(calendars, posts.select((F.col("author_id") % 50).alias("calendar_id")).where("calendar_id < 40"))


@query(
    f"""WITH x AS (SELECT author_id % 20 AS calendar_id, post_id AS content_id, CASE WHEN post_id % 2 = 0 THEN 'instagram' ELSE 'tiktok' END AS platform, content_format, {_ES} AS e FROM posts),
    r AS (SELECT *, row_number() OVER (PARTITION BY calendar_id ORDER BY e DESC, content_id) AS p FROM x)
    SELECT calendar_id, count(*) AS pieces, round(avg(e), 6) AS avg_score, count(*) FILTER (platform = 'instagram') AS platform_instagram, count(*) FILTER (platform = 'tiktok') AS platform_tiktok,
    count(*) FILTER (content_format = 'reel') AS format_reel, string_agg(content_id::VARCHAR, ',' ORDER BY p) FILTER (p <= 3) AS top_pieces FROM r GROUP BY calendar_id""",
    "posts",
    reads="posts",
)
def agg_32_calendar_summary(posts: DataFrame) -> DataFrame:
    rows = _scored(posts).select((F.col("author_id") % 20).alias("calendar_id"), F.col("post_id").alias("content_id"), F.when(F.col("post_id") % 2 == 0, "instagram").otherwise("tiktok").alias("platform"), "content_format", "engagement_score")
    made = A.calendar_summary(rows, ["instagram", "tiktok"], ["reel"])
    return made.select("calendar_id", "pieces", "platform_instagram", "platform_tiktok", "format_reel", F.array_join(F.filter("top_pieces", lambda x: x.isNotNull()).cast("array<string>"), ",").alias("top_pieces"), *rounded({"avg_score": F.col("avg_score")}))


@query(
    f"""WITH r AS (SELECT *, row_number() OVER (PARTITION BY author_id ORDER BY {_ES} DESC, post_id) AS p, {_ES} AS e FROM posts)
    SELECT author_id AS competitor_id, string_agg(post_id::VARCHAR, ',' ORDER BY p) AS top_posts, string_agg(DISTINCT content_format, ',' ORDER BY content_format) AS formats, round(avg(e), 6) AS avg_top_score,
    (SELECT string_agg(DISTINCT 'h' || (post_id % 3), ',' ORDER BY 'h' || (post_id % 3)) FROM posts q WHERE q.author_id = r.author_id AND post_id % 2 = 0) AS hooks FROM r WHERE p <= 10 GROUP BY author_id""",
    "posts",
    reads="posts",
)
def agg_20_competitor_analysis(posts: DataFrame) -> DataFrame:
    patterns = posts.select(F.col("author_id").alias("competitor_id"), F.when(F.col("post_id") % 2 == 0, "hook").otherwise("cta").alias("pattern_type"), F.concat(F.lit("h"), F.col("post_id") % 3).alias("name"))
    made = A.competitor_analysis(_scored(posts).withColumnRenamed("author_id", "competitor_id"), patterns)
    text = lambda c: F.nullif(F.array_join(F.col(c).cast("array<string>"), ","), F.lit(""))
    return made.select("competitor_id", text("top_posts").alias("top_posts"), text("formats").alias("formats"), text("hooks").alias("hooks"), *rounded({"avg_top_score": F.col("avg_top_score")}))


@query(
    """SELECT label % 5 AS pattern_type, count(*) AS n, max_by('p' || vec_id, (vec_id % 100) * 100000 + vec_id) AS best FROM embeddings GROUP BY 1""",
    reads="embeddings",
)
def agg_21_pattern_summary(embeddings: DataFrame) -> DataFrame:
    rows = embeddings.select((F.col("label") % 5).alias("pattern_type"), F.concat(F.lit("p"), "vec_id").alias("name"), (F.col("vec_id") % 100).alias("confidence_score"), F.col("vec_id").alias("avg_engagement_score"))
    return A.pattern_summary(rows)[0]


@query(
    f"""WITH m AS (SELECT median({_ES}) AS m FROM posts), h AS (SELECT post_id % 2 AS a, post_id % 3 AS b, post_id % 5 AS c, comments AS d FROM posts, m WHERE {_ES} > m)
    SELECT * FROM (SELECT 'a' AS trigger, round(avg(a), 6) AS mean FROM h UNION ALL SELECT 'b', round(avg(b), 6) FROM h UNION ALL SELECT 'c', round(avg(c), 6) FROM h UNION ALL SELECT 'd', round(avg(d), 6) FROM h) ORDER BY mean DESC LIMIT 3""",
    "posts",
    reads="posts",
)
def agg_24_trigger_ranking(posts: DataFrame) -> DataFrame:
    rows = _scored(posts).select(F.col("engagement_score").alias("engagement"), (F.col("post_id") % 2).alias("a"), (F.col("post_id") % 3).alias("b"), (F.col("post_id") % 5).alias("c"), F.col("comments").alias("d"))
    return A.trigger_ranking(rows, ["a", "b", "c", "d"]).select("trigger", *rounded({"mean": F.col("mean")}))


_FRAMES = """f AS (SELECT user_id AS video_id, event_id, (epoch_us(ts) - min(epoch_us(ts)) OVER (PARTITION BY user_id)) * 60.0 / greatest(max(epoch_us(ts)) OVER (PARTITION BY user_id) - min(epoch_us(ts)) OVER (PARTITION BY user_id), 1) AS t,
  value / 500 AS diff, event_type = 'error' AS cut, event_type = 'signup' AS face, value AS brightness FROM events)"""


def _frames(events: DataFrame) -> DataFrame:
    from pyspark.sql import Window

    own = Window.partitionBy("user_id")
    us = F.unix_micros(F.col("ts").cast("timestamp"))
    rows = events.withColumns({"_us": us, "_first": F.min(us).over(own), "_last": F.max(us).over(own)})
    return rows.select(
        F.col("user_id").alias("video_id"), "event_id", ((F.col("_us") - F.col("_first")) * F.lit(60.0) / F.greatest(F.col("_last") - F.col("_first"), F.lit(1))).alias("t"), (F.col("value") / 500).alias("diff"),
        (F.col("event_type") == "error").alias("cut"), (F.col("event_type") == "signup").alias("face"), F.col("value").alias("brightness"), (F.col("value") / 100).alias("motion"),
    )


@query(
    f"""WITH {_FRAMES} SELECT video_id, round(coalesce(avg(diff) FILTER (t <= 3), 0), 6) AS hook_energy, round(coalesce(avg(diff) FILTER (t > 3), 0), 6) AS retention_energy,
    round(CASE WHEN max(t) > 0 THEN count(*) FILTER (cut) / max(t) ELSE 0 END, 6) AS cuts_per_second, round(count(*) FILTER (cut AND t <= 3) / 3 * 10, 6) AS hook_cut_rate,
    max(CASE WHEN face AND t <= 3 THEN 1 ELSE 0 END) AS face_in_hook, round(stddev_pop(brightness), 6) AS brightness_std, count(*) AS frames FROM f GROUP BY video_id""",
    reads="events",
)
def agg_26_video_features(events: DataFrame) -> DataFrame:
    made = A.insight_scores(_frames(events))
    return made.select("video_id", "face_in_hook", "frames", *rounded({c: F.col(c) for c in ("hook_energy", "retention_energy", "cuts_per_second", "hook_cut_rate", "brightness_std")}))


@query(
    """WITH m AS (SELECT user_id AS video_id, avg(value / 100) AS m, stddev_pop(value / 100) AS s, avg(CASE WHEN value / 100 > 0.6 THEN 1.0 ELSE 0 END) AS shake_ratio FROM events GROUP BY 1), i AS (SELECT *, least(1, m * 0.6 + s * 0.4) AS x FROM m)
    SELECT video_id, round(shake_ratio, 6) AS shake_ratio, round(x, 6) AS instability, round(1 - x, 6) AS production_quality, round(1 - least(1, greatest(0, (x - 0.6) / (0.8 - 0.6))) * 0.3, 6) AS penalty FROM i""",
    reads="events",
)
def agg_27_instability(events: DataFrame) -> DataFrame:
    made = A.instability(_frames(events))
    return made.select("video_id", *rounded({c: F.col(c) for c in ("shake_ratio", "instability", "production_quality", "penalty")}))


@query(
    """WITH d AS (SELECT user_id AS video_id, event_id, event_type AS text, value AS area FROM events WHERE (event_id % 10) / 10.0 >= 0.5), f AS (SELECT video_id, text, min(event_id) AS first FROM d GROUP BY 1, 2),
    t AS (SELECT video_id, string_agg(text, ' ' ORDER BY first) AS text FROM f GROUP BY 1) SELECT d.video_id, count(*) AS boxes, round(sum(area), 4) AS area, any_value(t.text) AS text FROM d JOIN t USING (video_id) GROUP BY d.video_id""",
    reads="events",
)
def agg_28_detected_text(events: DataFrame) -> DataFrame:
    rows = events.select(F.col("user_id").alias("video_id"), F.col("event_id").alias("frame"), F.lit(0).alias("seq"), F.col("event_type").alias("text"), (F.col("event_id") % 10 / 10).alias("conf"), F.col("value").alias("area"))
    return A.detected_text(rows).select("video_id", "boxes", "text", *rounded({"area": F.col("area")}, 4))


_CONTRIBUTIONS = "c AS (SELECT l_orderkey AS row_id, concat(CASE WHEN l_partkey % 3 = 0 THEN 'emb_' ELSE 'f_' END, l_partkey % 12) AS feature, l_discount - 0.05 AS value FROM lineitem)"


def _contributions(lineitem: DataFrame) -> DataFrame:
    return lineitem.select(F.col("l_orderkey").alias("row_id"), F.concat(F.when(F.col("l_partkey") % 3 == 0, "emb_").otherwise("f_"), F.col("l_partkey") % 12).alias("feature"), (F.col("l_discount") - 0.05).alias("value"))


@query(
    f"""WITH {_CONTRIBUTIONS}, s AS (SELECT row_id, CASE WHEN feature LIKE 'emb%' THEN 'semantic' ELSE feature END AS feature, sum(value) AS v FROM c GROUP BY 1, 2)
    SELECT feature, round(avg(abs(v)), 6) AS importance FROM s GROUP BY feature ORDER BY avg(abs(v)) DESC, feature LIMIT 5""",
    reads="lineitem",
)
def agg_29_contributions(lineitem: DataFrame) -> DataFrame:
    return A.contributions(_contributions(lineitem), 5).select("feature", *rounded({"importance": F.col("importance")}))


@query(
    f"""WITH {_CONTRIBUTIONS}, g AS (SELECT row_id, feature, round(sum(value), 4) AS value FROM c GROUP BY 1, 2), r AS (SELECT *, row_number() OVER (PARTITION BY row_id ORDER BY value DESC, feature) AS u, row_number() OVER (PARTITION BY row_id ORDER BY value, feature) AS d FROM g)
    SELECT row_id, coalesce(string_agg(feature, ', ' ORDER BY u) FILTER (u <= 3 AND value > 0), '') AS positive, coalesce(string_agg(feature, ', ' ORDER BY d) FILTER (d <= 3 AND value < 0), '') AS negative FROM r GROUP BY row_id""",
    reads="lineitem",
)
def agg_33_factors(lineitem: DataFrame) -> DataFrame:
    rows = _contributions(lineitem).groupBy("row_id", "feature").agg(F.round(F.sum("value"), 4).alias("value"))
    return A.factors(rows)


@query(
    """WITH c AS (SELECT CASE l_linenumber % 3 WHEN 0 THEN 'likes' WHEN 1 THEN 'shares' ELSE 'views' END AS target, 'f_' || (l_partkey % 30) AS feature, round(avg(l_discount - 0.05), 6) AS value FROM lineitem GROUP BY 1, 2),
    w AS (SELECT * FROM (VALUES ('likes', 1.0), ('shares', 10.0), ('views', 3.0)) x(target, weight)), i AS (SELECT *, abs(value) * weight AS impact FROM c JOIN w USING (target)),
    b AS (SELECT *, row_number() OVER (PARTITION BY feature ORDER BY impact DESC, target) AS p FROM i) SELECT feature, target, round(impact, 6)::DOUBLE AS impact FROM b WHERE p = 1 ORDER BY impact DESC, feature LIMIT 10""",
    reads="lineitem",
)
def agg_34_weighted_factors(lineitem: DataFrame) -> DataFrame:
    target = F.element_at(F.array(F.lit("likes"), F.lit("shares"), F.lit("views")), (F.col("l_linenumber") % 3 + 1).cast("int"))
    rows = lineitem.groupBy(target.alias("target"), F.concat(F.lit("f_"), F.col("l_partkey") % 30).alias("feature")).agg(F.round(F.avg(F.col("l_discount") - 0.05), 6).alias("value"))
    weights = lineitem.sparkSession.createDataFrame([("likes", 1.0), ("shares", 10.0), ("views", 3.0)], "target string, weight double")
    return A.weighted_factors(rows, weights).select("feature", "target", *rounded({"impact": F.col("impact")}))


_V = """v AS (SELECT trend, count(*) AS n, count(*) FILTER (age_hours <= 48) AS a, count(*) FILTER (age_hours > 48 AND age_hours <= 168) AS b, count(*) FILTER (age_hours > 336) AS c, avg(likes) AS e FROM trends GROUP BY trend),
p AS (SELECT trend, n, CASE WHEN n >= 5 THEN a / n ELSE 0 END AS pa, CASE WHEN n >= 5 THEN b / n ELSE 0 END AS pb, CASE WHEN n >= 5 THEN c / n ELSE 0 END AS pc, CASE WHEN n >= 5 THEN e ELSE 0 END AS e FROM v),
vel AS (SELECT *, CASE WHEN n < 5 THEN 'unknown' WHEN pc >= 0.8 THEN 'stale' WHEN pa >= 0.5 THEN 'trending' WHEN pa + pb >= 0.3 THEN 'rising' ELSE 'stable' END AS status,
  CASE WHEN pa * 3 + pb - pc * 2 >= 0 THEN least((pa * 3 + pb - pc * 2) / 3, 1) ELSE greatest((pa * 3 + pb - pc * 2) / 2, -1) END AS score FROM p)"""


@query(
    f"""WITH {_V} SELECT trend, n, round(pa, 6) AS pct_last_48h, round(pb, 6) AS pct_last_week, round(pc, 6) AS pct_older_2weeks, round(e, 6) AS avg_engagement, status, round(score, 6) AS velocity_score,
    status <> 'stale' AS is_fresh, status = 'stale' AS is_stale FROM vel""",
    "trends",
    reads="trends",
)
def agg_04_trend_velocity(trends: DataFrame) -> DataFrame:
    made = V.velocity(trends)
    return made.select("trend", "n", "status", "is_fresh", "is_stale", *rounded({c: F.col(c) for c in ("pct_last_48h", "pct_last_week", "pct_older_2weeks", "avg_engagement", "velocity_score")}))


@query(
    """WITH d AS (SELECT trend, CAST(posted_at AS DATE) AS day, count(*) AS n FROM trends GROUP BY 1, 2), r AS (SELECT *, row_number() OVER (PARTITION BY trend ORDER BY n DESC, day) AS p FROM d) SELECT trend, CAST(day AS VARCHAR) AS peak_day, n FROM r WHERE p = 1""",
    "trends",
    reads="trends",
)
def agg_05_peak_day(trends: DataFrame) -> DataFrame:
    return V.peak_day(trends).withColumn("peak_day", F.col("peak_day").cast("string"))


@query(
    """WITH r AS (SELECT *, row_number() OVER (PARTITION BY trend ORDER BY posted_at, event_id) AS p, count(*) OVER (PARTITION BY trend) AS n FROM trends),
    h AS (SELECT trend, max(n) AS n, count(*) FILTER (p <= n // 2) AS n1, count(*) FILTER (p > n // 2) AS n2, (max(epoch_us(posted_at)) FILTER (p <= n // 2) - min(epoch_us(posted_at)) FILTER (p <= n // 2)) / 3.6e9 AS s1,
      (max(epoch_us(posted_at)) FILTER (p > n // 2) - min(epoch_us(posted_at)) FILTER (p > n // 2)) / 3.6e9 AS s2 FROM r GROUP BY trend)
    SELECT trend, n, round(CASE WHEN n >= 10 AND s1 > 0 AND s2 > 0 THEN (n2 / s2 - n1 / s1) / (n1 / s1) ELSE 0 END, 6) AS acceleration FROM h""",
    "trends",
    reads="trends",
)
def win_09_acceleration(trends: DataFrame) -> DataFrame:
    return V.acceleration(trends).select("trend", "n", *rounded({"acceleration": F.col("acceleration")}))


@query(
    f"""WITH {_V}, el AS (SELECT DISTINCT u % 5 AS recipe_id, CASE WHEN event_type IN ('click', 'purchase') THEN 'audio' ELSE 'hashtag' END AS kind, trend AS name FROM trends
      UNION ALL SELECT DISTINCT u % 5, 'audio', concat('unheard_', u) FROM trends),
    j AS (SELECT recipe_id, kind, name, coalesce(status, 'unknown') AS status, coalesce(score, 0) AS score, CASE WHEN status = 'stale' THEN 'filtered' ELSE 'validated' END AS list FROM el LEFT JOIN vel ON trend = name)
    SELECT recipe_id, kind, name, list, status, round(score, 6)::DOUBLE AS velocity_score, row_number() OVER (PARTITION BY recipe_id, kind, list ORDER BY CASE WHEN list = 'validated' THEN score END DESC, name) AS place FROM j""",
    "trends",
    reads="trends",
)
def top_12_recipe_elements(trends: DataFrame) -> DataFrame:
    recipe = (F.col("u") % 5).alias("recipe_id")
    kind = F.when(F.col("event_type").isin("click", "purchase"), "audio").otherwise("hashtag").alias("kind")
    elements = trends.select(recipe, kind, F.col("trend").alias("name")).distinct()
    elements = elements.unionByName(trends.select(recipe, F.lit("audio").alias("kind"), F.concat(F.lit("unheard_"), "u").alias("name")).distinct())
    made = V.recipe_elements(elements, V.velocity(trends))
    return made.select("recipe_id", "kind", "name", "list", "status", F.col("place").cast("long").alias("place"), *rounded({"velocity_score": F.col("velocity_score")}))


@query(f"WITH {_V} SELECT trend, status, round(score, 6) AS velocity_score FROM vel WHERE status <> 'stale'", "trends", reads="trends")
def top_12_fresh_trends(trends: DataFrame) -> DataFrame:
    return V.fresh(V.velocity(trends)).select("trend", "status", *rounded({"velocity_score": F.col("velocity_score")}))


@query(
    f"""WITH {_V}, i AS (SELECT c_custkey AS idea_id, concat(CASE c_custkey % 5 WHEN 0 THEN 'view' WHEN 1 THEN 'click' WHEN 2 THEN 'error' WHEN 3 THEN 'signup' ELSE 'other' END, '_', c_custkey % 20) AS trend FROM customer)
    SELECT idea_id, trend, coalesce(status, 'unknown') AS status, CASE WHEN status IN ('rising', 'trending') THEN 'high' ELSE 'medium' END AS potential FROM i LEFT JOIN vel USING (trend) WHERE coalesce(status, 'unknown') <> 'stale'""",
    "trends",
    reads="trends customer",
)
def top_15_ideas(trends: DataFrame, customer: DataFrame) -> DataFrame:
    kind = F.element_at(F.array(*[F.lit(x) for x in ("view", "click", "error", "signup", "other")]), (F.col("c_custkey") % 5 + 1).cast("int"))
    ideas = customer.select(F.col("c_custkey").alias("idea_id"), F.concat(kind, F.lit("_"), F.col("c_custkey") % 20).alias("trend"), F.lit("medium").alias("potential"))
    return V.ideas_with_status(ideas, V.velocity(trends)).select("idea_id", "trend", "status", "potential")


_RANKED = f"""r AS (SELECT *, {_ES} AS e, row_number() OVER (PARTITION BY niche2 ORDER BY {_ES} DESC, post_id) - 1 AS up, count(*) OVER (PARTITION BY niche2) AS n FROM (SELECT *, CAST(post_id % 700 AS BIGINT) AS niche2 FROM posts) q)"""


def _accounts(posts: DataFrame) -> DataFrame:
    """Accounts of 21 or 22 posts, as authors have too few for every branch."""
    return _scored(posts).withColumn("account", F.col("post_id") % 700)


@query(
    f"""WITH {_RANKED} SELECT post_id, CASE WHEN up < floor(n * 0.2) THEN 'top' WHEN up >= floor(n * 0.8) THEN 'bottom' ELSE 'middle' END AS performance_tier, round((1 - up / n) * 100, 1) AS performance_percentile FROM r""",
    "posts",
    reads="posts",
)
def win_08_tiers(posts: DataFrame) -> DataFrame:
    return S.tiers(_accounts(posts), key="account").select("post_id", "performance_tier", "performance_percentile")


@query(f"WITH {_RANKED} SELECT post_id FROM r WHERE up < 3 UNION ALL SELECT post_id FROM r WHERE n - 1 - up < 2", "posts", reads="posts")
def top_01_04_top_and_bottom(posts: DataFrame) -> DataFrame:
    rows = _accounts(posts)
    return S.top_only(rows, 3, "engagement_score", "account").select("post_id").union(S.bottom_only(rows, 2, "engagement_score", "account").select("post_id"))


@query(f"WITH {_RANKED} SELECT post_id FROM r WHERE n < 20 OR up < 18 OR n - 1 - up < least(5, n - 18)", "posts", reads="posts")
def top_02_balanced(posts: DataFrame) -> DataFrame:
    return S.balanced(_accounts(posts), C.Sampling(top=18), key="account").select("post_id")


@query(
    f"""WITH {_RANKED} SELECT post_id FROM (SELECT *, least(up // greatest(n // 5, 1), 4) AS s FROM r) x WHERE n < 10 OR up - s * (n // 5) < CASE WHEN s IN (0, 4) THEN 6 ELSE 1 END""",
    "posts",
    reads="posts",
)
def top_03_stratified(posts: DataFrame) -> DataFrame:
    return S.stratified(_accounts(posts), 15, key="account").select("post_id")


@query(
    """SELECT post_id, niche FROM (SELECT post_id, niche, row_number() OVER (PARTITION BY niche ORDER BY likes DESC, post_id) AS p FROM posts WHERE niche IS NOT NULL) x WHERE p <= 20""",
    "posts",
    reads="posts",
)
def top_16_best_of_each(posts: DataFrame) -> DataFrame:
    return B.latest(posts.where("niche is not null"), "niche", 20, [F.desc("likes"), F.asc("post_id")]).select("post_id", "niche")


_COMPETING = f"c AS (SELECT p.*, a.business_id, {_ES} AS e, k.caption FROM posts p JOIN authors a USING (author_id) LEFT JOIN (SELECT post_id, caption FROM captions) k USING (post_id))"


def _competing(posts: DataFrame, authors: DataFrame, captions: DataFrame) -> DataFrame:
    return _scored(posts).join(authors.select("author_id", "business_id"), "author_id").join(captions.select("post_id", "caption"), "post_id", "left")


@query(
    f"""WITH {_COMPETING} SELECT business_id, post_id, e AS engagement_score, substring(coalesce(caption, ''), 1, 30) AS caption
    FROM (SELECT *, row_number() OVER (PARTITION BY business_id ORDER BY e DESC, post_id) AS p FROM c) x WHERE p <= 15""",
    "posts", "authors", "captions",
    reads="posts authors captions",
)
def top_05_best_of_business(posts: DataFrame, authors: DataFrame, captions: DataFrame) -> DataFrame:
    """Captions here are short, so the cut is at 30 letters."""
    return S.best_of_business(_competing(posts, authors, captions), longest=30).select("business_id", "post_id", "engagement_score", "caption")


@query(
    f"""WITH {_COMPETING}, n AS (SELECT niche FROM c WHERE niche IS NOT NULL GROUP BY niche HAVING count(*) > 50)
    SELECT post_id, 'best' AS kind FROM (SELECT *, row_number() OVER (PARTITION BY business_id ORDER BY e DESC, post_id) AS p FROM c) x WHERE p <= 20
    UNION ALL SELECT post_id, 'failed' FROM (SELECT *, row_number() OVER (PARTITION BY niche ORDER BY e, post_id) AS p FROM c) y JOIN n USING (niche) WHERE p <= 20""",
    "posts", "authors", "captions",
    reads="posts authors captions",
)
def top_06_best_and_failed(posts: DataFrame, authors: DataFrame, captions: DataFrame) -> DataFrame:
    rows = _competing(posts, authors, captions)
    best = S.top_only(rows, 20, "engagement_score", "business_id").select("post_id", F.lit("best").alias("kind"))
    return best.unionByName(S.failed_of_niche(rows).select("post_id", F.lit("failed").alias("kind")))


_PRIORITY = """least(1, least(1, abs(delta) / 100) * CASE WHEN abs(delta) > 50 THEN 1.5 WHEN abs(delta) > 20 THEN 1.2 ELSE 1 END * CASE content_format WHEN 'carousel' THEN 1.3
WHEN 'static_image' THEN 1.2 ELSE 1 END * CASE WHEN views > 10000 THEN 1.3 WHEN views > 1000 THEN 1.1 ELSE 1 END)"""


@query(
    f"WITH d AS (SELECT *, {_DELTA} AS delta FROM ab_logs), q AS (SELECT post_id, actual, {_PRIORITY} AS p FROM d) SELECT post_id, actual AS engagement_score, round(p, 6)::DOUBLE AS priority FROM q WHERE p >= 0.6",
    "ab_logs",
    reads="ab_logs",
)
def top_07_training_queue(logs: DataFrame) -> DataFrame:
    rows = logs.withColumn("delta", M.delta(F.col("actual"), F.col("predicted")))
    rows = rows.withColumn("priority", M.priority(F.col("delta"), F.col("content_format"), F.col("views")))
    return S.training_queue(rows, 0.6).select("post_id", F.col("actual").alias("engagement_score"), *rounded({"priority": F.col("priority")}))


@query(
    f"WITH d AS (SELECT *, {_DELTA} AS delta FROM ab_logs) SELECT post_id FROM d WHERE abs(delta) > 20 ORDER BY posted_at DESC, post_id LIMIT 50",
    "ab_logs",
    reads="ab_logs",
)
def top_08_high_priority(logs: DataFrame) -> DataFrame:
    rows = logs.withColumn("delta", M.delta(F.col("actual"), F.col("predicted"))).where(M.is_high_priority(F.col("delta")))
    return S.top_rows(rows, 50, [F.desc("posted_at"), F.asc("post_id")]).select("post_id")


_FOUND = """x AS (SELECT lower(username) AS username, followers, date_diff('day', posted_at::DATE, DATE '1998-08-03') AS d, lower(concat_ws(' ', coalesce(caption, ''), lower(username))) AS t,
  row_number() OVER (PARTITION BY username ORDER BY posted_at DESC, post_id DESC) AS p FROM posts JOIN authors USING (author_id) LEFT JOIN (SELECT post_id, caption FROM captions) k USING (post_id)
  WHERE followers BETWEEN 500 AND 100000 AND date_diff('day', posted_at::DATE, DATE '1998-08-03') <= 90),
y AS (SELECT *, contains(t, 'casa') OR contains(t, 'café') AS niche, contains(t, '0001') AS place, d <= 7 AS very FROM x WHERE p = 1)"""


@query(
    f"""WITH {_FOUND} SELECT username, followers, CASE WHEN very THEN 'Very Active' WHEN d <= 30 THEN 'Active' ELSE 'Inactive' END AS activity_status,
    CASE WHEN niche THEN 25 ELSE 0 END + CASE WHEN place THEN 30 ELSE 0 END + CASE WHEN very THEN 15 ELSE 0 END + CASE WHEN followers BETWEEN 1000 AND 50000 THEN 10 ELSE 0 END + 10 AS relevance_score,
    concat_ws('; ', CASE WHEN niche THEN '🎯 Niche Match' END, CASE WHEN place THEN '📍 Location Match' END, CASE WHEN very THEN '🔥 Very Active' END, CASE WHEN NOT niche AND NOT place THEN 'Exploración general' END) AS match_reasons
    FROM y ORDER BY relevance_score DESC, username LIMIT 50""",
    "posts", "authors", "captions",
    reads="posts authors captions",
)
def top_11_hashtag_discovery(posts: DataFrame, authors: DataFrame, captions: DataFrame) -> DataFrame:
    rows = posts.join(authors.select("author_id", "username", "followers"), "author_id").join(captions.select("post_id", "caption"), "post_id", "left")
    made = A.hashtag_discovery(rows, ["casa", "café"], ["0001"], 500, 100_000, "1998-08-03", [F.desc("posted_at"), F.desc("post_id")], days=90)
    return made.select("username", "followers", "activity_status", "relevance_score", F.array_join("match_reasons", "; ").alias("match_reasons"))


_TEXT = "concat_ws(' ', lower(content), lower(username))"
_REL = """CASE WHEN contains(t, 'furn') THEN 30 ELSE 0 END + CASE WHEN contains(t, 'auto') THEN 30 ELSE 0 END + CASE WHEN contains(t, '00012') THEN 20 ELSE 0 END + CASE WHEN contains(t, 'build') THEN 20 ELSE 0 END
+ CASE WHEN author_id % 2 = 0 THEN 15 ELSE 0 END + 10 - CASE WHEN author_id % 9 = 0 THEN 20 ELSE 0 END + CASE WHEN followers BETWEEN 1000 AND 15000 THEN 10 ELSE 0 END"""


@query(
    f"""WITH x AS (SELECT *, lower(concat_ws(' ', niche, username)) AS t FROM authors) SELECT author_id, CAST(least(greatest({_REL}, 0), 100) AS DOUBLE) AS relevance_score,
    CASE WHEN contains(t, 'furn') THEN 'furn' WHEN contains(t, 'auto') THEN 'auto' ELSE '' END AS location_detected, concat_ws(', ', CASE WHEN contains(t, '00012') THEN '00012' END, CASE WHEN contains(t, 'build') THEN 'build' END) AS niche_detected FROM x""",
    "authors",
    reads="authors",
)
def top_10_relevance(authors: DataFrame) -> DataFrame:
    return authors.select("author_id", *[c.alias(k) for k, c in _relevance().items()])


def _relevance():
    text = F.lower(F.concat_ws(" ", "niche", "username"))
    return A.relevance(text, ["furn", "auto"], ["00012", "build"], F.col("followers"), F.col("author_id") % 2 == 0, F.lit("shop"), F.col("author_id") % 9 == 0)


@query(
    f"""WITH x AS (SELECT *, lower(concat_ws(' ', niche, username)) AS t FROM authors), y AS (SELECT author_id, username, followers, least(greatest({_REL}, 0), 100) AS rel, contains(t, 'furn') OR contains(t, 'auto') OR contains(t, '00012') OR contains(t, 'build') AS found,
      author_id % 100 AS act, author_id % 60 AS days FROM x) SELECT author_id, round(rel * 0.6 + act * 0.4, 6)::DOUBLE AS rank_score FROM y WHERE followers BETWEEN 500 AND 50000 AND days <= 30 AND act >= 20 AND found ORDER BY rel * 0.6 + act * 0.4 DESC, username LIMIT 50""",
    "authors",
    reads="authors",
)
def top_09_discovery(authors: DataFrame) -> DataFrame:
    rows = authors.withColumns(_relevance() | {"activity_score": F.col("author_id") % 100, "days_since_last_post": F.col("author_id") % 60, "posts_last_month": F.lit(5)})
    return A.discovery(rows, 500, 50000, 30, 1, 20, 50).select("author_id", *rounded({"rank_score": F.col("rank_score")}))


_RATIO = f"CASE WHEN followers > 0 THEN round({_ES} / followers * 100, 4) ELSE 0 END"


def _ratios(posts: DataFrame, authors: DataFrame) -> DataFrame:
    rows = _scored(posts).join(authors.select("author_id", "followers"), "author_id")
    return rows.withColumn("engagement_ratio", F.round(M.ratio(F.col("engagement_score"), F.col("followers")), 4))


@query(
    f"""WITH x AS (SELECT post_id, {_RATIO} AS r FROM posts JOIN authors USING (author_id)), v AS (SELECT r, row_number() OVER (ORDER BY r DESC) - 1 AS p, count(*) OVER () AS n FROM x WHERE r > 0),
    l AS (SELECT max(r) FILTER (p = CAST(floor(n * 0.2) AS INT) - 1) AS hi, max(r) FILTER (p = CAST(floor(n * 0.8) AS INT)) AS lo FROM v)
    SELECT post_id, CASE WHEN r >= hi THEN 'viral' WHEN r <= lo THEN 'flop' ELSE 'middle' END AS viral_label, CASE WHEN r >= hi THEN 1 WHEN r <= lo THEN 0 END AS is_viral FROM x, l""",
    "posts",
    "authors",
    reads="posts authors",
)
def lab_01_label_by_position(posts: DataFrame, authors: DataFrame) -> DataFrame:
    return S.label_by_position(_ratios(posts, authors)).select("post_id", "viral_label", "is_viral")


@query(
    f"""WITH x AS (SELECT post_id, {_RATIO} AS r FROM posts JOIN authors USING (author_id)), l AS (SELECT quantile_cont(r, 0.8) AS hi, quantile_cont(r, 0.2) AS lo FROM x)
    SELECT post_id, CASE WHEN r >= hi THEN 'viral' WHEN r <= lo THEN 'flop' ELSE 'middle' END AS viral_label, CASE WHEN r >= hi THEN 1 WHEN r <= lo THEN 0 END AS is_viral FROM x, l""",
    "posts",
    "authors",
    reads="posts authors",
)
def lab_02_label_by_quantile(posts: DataFrame, authors: DataFrame) -> DataFrame:
    return S.label_by_quantile(_ratios(posts, authors)).select("post_id", "viral_label", "is_viral")


_KEYED = "('0x' || substr(md5(concat_ws('|', {})), 1, 15))::BIGINT"
_BALANCED = f"""x AS (SELECT post_id, likes, comments, {_RATIO} AS r FROM posts JOIN authors USING (author_id)), v AS (SELECT r, row_number() OVER (ORDER BY r DESC) - 1 AS p, count(*) OVER () AS n FROM x WHERE r > 0),
c AS (SELECT max(r) FILTER (p = CAST(floor(n * 0.2) AS INT) - 1) AS hi, max(r) FILTER (p = CAST(floor(n * 0.95) AS INT)) AS lo FROM v),
l AS (SELECT post_id, likes, comments, CASE WHEN r >= hi THEN 1 WHEN r <= lo THEN 0 END AS is_viral FROM x, c),
t AS (SELECT count(*) FILTER (is_viral = 1) AS p, count(*) FILTER (is_viral = 0) AS n FROM l),
g AS (SELECT *, CASE WHEN p = 0 OR n = 0 OR n / (p + n) >= 0.3 THEN 'plain' WHEN CAST(floor(n * 0.7 / 0.3) AS BIGINT) >= 0.7 * p THEN 'fewer' ELSE 'more' END AS way, CAST(floor(n * 0.7 / 0.3) AS BIGINT) AS keep, CAST(ceil(p * 0.3 / 0.7) AS BIGINT) - n AS wanted FROM t),
o AS (SELECT l.*, row_number() OVER (PARTITION BY is_viral ORDER BY {_KEYED.format('post_id, 42')}, post_id) - 1 AS place FROM l WHERE is_viral IS NOT NULL),
e AS (SELECT post_id, is_viral, likes, comments, unnest(range(1, CAST(floor((wanted - 1 - place) / n) AS BIGINT) + 2)) AS copy FROM o, g WHERE way = 'more' AND is_viral = 0 AND place < wanted),
d AS (SELECT *, {_KEYED.format("post_id, copy, 'likes', 42")} % 1000001 / 1000000 * 2 - 1 AS dl, {_KEYED.format("post_id, copy, 'comments', 42")} % 1000001 / 1000000 * 2 - 1 AS dc FROM e),
b AS (SELECT post_id, is_viral, FALSE AS is_synthetic, post_id AS source_id, CAST(0 AS BIGINT) AS copy, likes, comments FROM o, g WHERE way <> 'fewer' OR is_viral = 0 OR place < keep
  UNION ALL SELECT post_id, is_viral, TRUE, post_id, copy, CAST(greatest(0, floor(likes * (1 + dl * 0.15))) AS BIGINT), CAST(greatest(0, floor(comments * (1 + dc * 0.15))) AS BIGINT) FROM d)"""


@query(f"WITH {_BALANCED} SELECT * FROM b", "posts", "authors", reads="posts authors")
def lab_03_04_05_06_balanced_training_set(posts: DataFrame, authors: DataFrame) -> DataFrame:
    """Ratios, labels and balance in one; rows and noise are drawn by MD5, so that the twin draws the same."""
    rows = S.label_by_position(_ratios(posts, authors), bottom=0.05)
    made = S.balance(rows, ["likes", "comments"], "post_id")
    return made.select("post_id", "is_viral", "is_synthetic", "source_id", F.col("copy").cast("long").alias("copy"), "likes", "comments")


@query(
    f"""WITH {_BALANCED} SELECT count(*) AS input_count, count(*) FILTER (is_viral = 1) AS viral_count, count(*) FILTER (is_viral = 0) AS flop_count, count(*) FILTER (is_viral IS NULL) AS middle_count,
    (SELECT count(*) FROM b) AS output_count, (SELECT count(*) FROM b WHERE is_synthetic) AS synthetic_count, (SELECT round(count(*) FILTER (is_viral = 0) / greatest(count(*), 1), 6) FROM b) AS negative_share FROM l""",
    "posts",
    "authors",
    reads="posts authors",
)
def lab_08_statistics(posts: DataFrame, authors: DataFrame) -> DataFrame:
    rows = S.label_by_position(_ratios(posts, authors), bottom=0.05)
    made = S.statistics(rows, S.balance(rows, ["likes", "comments"], "post_id"))
    return made.select(*[c for c in made.columns if c != "negative_share"], *rounded({"negative_share": F.col("negative_share")}))


@query(
    "SELECT post_id, posted_at > max(posted_at) OVER () - INTERVAL 7 DAY AS is_test, CASE WHEN likes < 50 THEN 3.5 ELSE 1.0 END::DOUBLE AS w, CAST(likes > median(likes) OVER () AS INT) AS high FROM posts",
    "posts",
    reads="posts",
)
def lab_09_11_12_split_and_weights(posts: DataFrame) -> DataFrame:
    made = S.above_median(S.split_by_time(posts, "posted_at"), "likes")
    return made.select("post_id", "is_test", S.sample_weight(F.col("likes"), 50.0).alias("w"), "high")


@query(f"SELECT post_id, {_KEYED.format('post_id, 42')} % 100 >= 80 AS is_test FROM posts", "posts", reads="posts")
def lab_10_split_by_hash(posts: DataFrame) -> DataFrame:
    return S.split_by_hash(posts, "post_id").select("post_id", "is_test")


@query(
    "SELECT author_id, post_id FROM (SELECT *, row_number() OVER (PARTITION BY author_id ORDER BY posted_at, post_id) AS p FROM posts) x WHERE p = 1",
    "posts",
    reads="posts",
)
def win_10_11_first_of_each(posts: DataFrame) -> DataFrame:
    return B.first_of_each(posts, "author_id", [F.asc("posted_at"), F.asc("post_id")]).select("author_id", "post_id")


@query(
    "SELECT post_id, 'real' AS origin, views AS v FROM posts UNION ALL SELECT post_id + 1000000, 'extra', NULL FROM posts WHERE post_id % 10 = 0",
    "posts",
    reads="posts",
)
def set_01_02_union(posts: DataFrame) -> DataFrame:
    extra = posts.where("post_id % 10 = 0").select((F.col("post_id") + 1000000).alias("post_id"), F.lit("extra").alias("origin"))
    return posts.select("post_id", F.lit("real").alias("origin"), F.col("views").alias("v")).unionByName(extra, allowMissingColumns=True)


@query(
    """SELECT author_id, string_agg(content_format, ',' ORDER BY first) AS formats FROM (SELECT author_id, content_format, min(post_id) AS first FROM posts GROUP BY 1, 2) x GROUP BY author_id""",
    "posts",
    reads="posts",
)
def set_03_distinct_in_order(posts: DataFrame) -> DataFrame:
    first = posts.groupBy("author_id", "content_format").agg(F.min("post_id").alias("first"))
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("first", "content_format"))), lambda x: x["content_format"])
    return first.groupBy("author_id").agg(F.array_join(F.slice(ordered, 1, 10), ",").alias("formats"))
