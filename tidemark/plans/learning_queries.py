"""Queries that train, reduce, de-duplicate or learn from streams; most have no SQL twin."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.functions import metrics as M
from tidemark.plans.register import query, rounded
from tidemark.streaming import feedback as S

_FEATURES = ["comments", "saves", "shares", "views", "hour"]


def _training(posts: DataFrame) -> DataFrame:
    rows = M.harmonised(posts).withColumns(M.output_targets(posts.columns))
    return rows.withColumns({"hour": (F.col("post_id") % 24).cast("double"), "fold": (F.col("post_id") % 5).cast("int")})


@query(reads="posts")
def ml_01_02_11_niche_scores(posts: DataFrame) -> DataFrame:
    """Every post scored by its niche's model, else by the base model, and by the incremental one where the niche's model drifts.

    Niches by age of the post make large ones, some of a few hundred posts and some of fewer than thirty.
    """
    from tidemark.operators import models as L
    from tidemark.operators.evaluation import range_drift
    from tidemark.streaming.blocks import online_weights

    small = F.when(F.col("post_id") % 100 == 0, "weekly").when(F.col("post_id") % 700 == 1, "yearly")
    rows = _training(posts).withColumn("niche", F.coalesce(small, F.col("niche")))
    scored = L.niche_scores(rows, _FEATURES, "log_likes", "post_id", base_trees=5, trees=3, depth=3)
    best = F.coalesce("own", "base")
    drift = range_drift(scored.where("niche is not null").select("niche", F.col("log_likes").alias("y"), best.alias("p")), threshold=0.2).select("niche", "drift")
    logs = rows.select("niche", F.col("post_id").alias("seq"), *[F.log1p(f).alias(f) for f in _FEATURES], "log_likes")
    weights = online_weights(logs.where("niche is not null"), _FEATURES, "log_likes")
    made = scored.join(drift, "niche", "left").join(weights, "niche", "left").withColumns({f: F.log1p(f) for f in _FEATURES})
    online = F.when(F.col("online").isNotNull(), L.online_score(F.col("online"), _FEATURES))
    found = L.best_available({"niche": F.col("own"), "base": F.col("base")}, F.coalesce("drift", F.lit(False)), online)
    return made.select("post_id", "niche", "policy", "drift", *[c.alias(k) for k, c in found.items()])


@query(reads="posts")
def ml_03_21_multi_output(posts: DataFrame) -> DataFrame:
    """Posts are made once, and what is learned and scored of them is written."""
    from tidemark.config import METRICS
    from tidemark.operators import models as L
    from tidemark.operators.tables import Steps

    rows = Steps(posts.sparkSession, "outputs").save(_training(posts).select("post_id", *_FEATURES, *[f"log_{m}" for m in METRICS]))
    models = L.five_targets(rows, _FEATURES, trees=2, depth=3)
    return L.score_targets(models, rows, _FEATURES).select("post_id", "weighted_rpi", *[f"pred_{m}" for m in ("likes", "views")])


@query(reads="posts")
def ml_04_20_growth_importances(posts: DataFrame) -> DataFrame:
    from tidemark.operators import models as L

    made = L.growth(_training(posts), _FEATURES, "log_likes", "fold")
    rows = [(f, float(v), float(made["cv_rmse"])) for f, v in made["importances"]]
    return posts.sparkSession.createDataFrame(rows, "feature string, importance double, cv_rmse double")


@query(reads="posts")
def ml_05_classifier_report(posts: DataFrame) -> DataFrame:
    from tidemark.operators import models as L
    from tidemark.operators.sampling import above_median, split_by_hash
    from tidemark.operators.tables import Steps

    known = Steps(posts.sparkSession, "report").save(_training(posts).select("post_id", *_FEATURES, "likes"))
    rows = split_by_hash(above_median(known, "likes"), "post_id")
    made = L.classifier(rows.where("not is_test"), rows.where("is_test"), _FEATURES)
    return posts.sparkSession.createDataFrame([(made["auc"], made["accuracy"], made["majority"])], "auc double, accuracy double, majority double")


@query(reads="posts")
def ml_06_recommended_formats(posts: DataFrame) -> DataFrame:
    from tidemark.operators import models as L

    rows = _training(posts)
    return L.recommended(L.format_recommender(rows, _FEATURES, "likes"), rows).select("post_id", "recommended")


@query(reads="posts")
def ml_10_contributions(posts: DataFrame) -> DataFrame:
    """Shapley values of trees for each content format."""
    from tidemark.operators import grouped_trees as G
    from tidemark.operators.tables import Steps

    rows = Steps(posts.sparkSession, "explained").save(_training(posts).select("post_id", "content_format", *_FEATURES, "log_likes"))
    return G.contributions(G.fit(rows, "content_format", _FEATURES, "log_likes", trees=3, depth=3), rows, "content_format", "post_id")


@query(reads="embeddings")
def ml_14_22_reduced(embeddings: DataFrame) -> DataFrame:
    from tidemark.operators import models as L

    return L.reduced_or_zero(embeddings, "embedding", L.reducer(embeddings, "embedding", 8), 8, "reduced").select("vec_id", "reduced")


@query(reads="embeddings")
def ml_19_components(embeddings: DataFrame) -> DataFrame:
    from pyspark.ml.functions import array_to_vector, vector_to_array

    from tidemark.operators import models as L

    model = L.principal_components(embeddings, "embedding")
    rows = embeddings.withColumn("_v", array_to_vector(F.col("embedding").cast("array<double>")))
    return model.transform(rows).select("vec_id", vector_to_array("components").alias("components"))


@query(
    "SELECT post_id, hour(posted_at)::BIGINT AS hour_of_day, CASE content_format WHEN 'carousel' THEN 0 WHEN 'reel' THEN 1 WHEN 'story' THEN 3 ELSE -1 END AS post_type, likes::DOUBLE AS likes, 0.0::DOUBLE AS semantic FROM posts",
    "posts",
    reads="posts",
)
def ml_17_training_records(posts: DataFrame) -> DataFrame:
    from tidemark.operators.models import training_records

    made = training_records(posts, ["likes", "semantic"])
    return made.select("post_id", F.col("hour_of_day").cast("long").alias("hour_of_day"), "post_type", "likes", "semantic")


@query(
    "SELECT post_id, round(60 + (CASE WHEN likes <> 0 THEN 1 ELSE 0 END + CASE WHEN saves <> 0 THEN 1 ELSE 0 END + CASE WHEN shares <> 0 THEN 1 ELSE 0 END + CASE WHEN views <> 0 THEN 1 ELSE 0 END) / 4 * 35, 6) AS confidence FROM posts",
    "posts",
    reads="posts",
)
def ml_12_feature_confidence(posts: DataFrame) -> DataFrame:
    from tidemark.operators.models import feature_confidence

    return posts.select("post_id", *rounded({"confidence": feature_confidence(["likes", "saves", "shares", "views"])}))


@query(reads="posts")
def lab_07_smote(posts: DataFrame) -> DataFrame:
    """The minority are the posts of least engagement, a tenth of all; there come to be as many again."""
    from tidemark.operators.models import smote
    from tidemark.operators.ranks import quantiles

    rows = _training(posts)
    few = rows.where(F.col("log_likes") <= quantiles(rows, "log_likes", [0.1])[0]).select("post_id", "log_likes", "log_views")
    return smote(few, "post_id", ["log_likes", "log_views"], few.count())


@query(reads="embeddings")
def seq_05_greedy_duplicates(embeddings: DataFrame) -> DataFrame:
    from tidemark.operators.duplicates import greedy

    bent = embeddings.where("vec_id % 10 = 0").withColumns({"vec_id": F.col("vec_id") + 1_000_000, "embedding": F.transform("embedding", lambda x, i: F.when(i == 0, x * 1.05).otherwise(x))})
    return greedy(embeddings.unionByName(bent), "label", "vec_id", "embedding").select("vec_id", "kept_as", "times")


# The learner as a fold over each niche's rows in order; what it holds is carried in the list's own struct.
def _fold(rows: str, shown: str) -> str:
    return f"""r AS ({rows}),
    l AS (SELECT niche, list({{'x': x, 'y': y, 'w': 0.0::DOUBLE, 'b': 0.0::DOUBLE, 'n': 0, 'a': 0.0::DOUBLE, 's': 0.0::DOUBLE, 'sy': 0.0::DOUBLE, 'sq': 0.0::DOUBLE, 'last': NULL::DOUBLE,
      'ev': NULL::STRUCT(n INT, mae DOUBLE, r2 DOUBLE, event VARCHAR)[]}} ORDER BY seq, x, y) AS rows FROM r GROUP BY niche),
    f AS (SELECT niche, list_reduce(rows, lambda g, e: list_transform([{{'p': g.w * e.x + g.b, 'h': {shown}}}], lambda q: list_transform([{{'n': g.n + 1, 'u': 0.5 * (e.y - q.p) / (2 + e.x * e.x),
        'a': g.a + abs(e.y - q.h), 's': g.s + (e.y - q.h) * (e.y - q.h), 'sy': g.sy + e.y, 'sq': g.sq + e.y * e.y}}],
      lambda k: {{'x': e.x, 'y': e.y, 'w': g.w + k.u * e.x, 'b': g.b + k.u, 'n': k.n, 'a': k.a, 's': k.s, 'sy': k.sy, 'sq': k.sq,
        'last': CASE WHEN k.n >= 10 AND k.n % 15 = 0 THEN k.a / k.n ELSE g.last END,
        'ev': list_concat(g.ev, list_transform(list_filter([CASE WHEN k.n >= 10 AND k.n % 15 = 0 THEN CASE WHEN k.a / k.n < 0.95 * g.last THEN 'retrain' ELSE 'steady' END END, CASE WHEN k.n % 50 = 0 THEN 'evaluate' END], lambda v: v IS NOT NULL),
          lambda v: {{'n': k.n, 'mae': k.a / k.n, 'r2': CASE WHEN k.sq - k.sy * k.sy / k.n > 0 THEN 1 - k.s / (k.sq - k.sy * k.sy / k.n) ELSE 0 END, 'event': v}}))}})[1])[1],
      {{'x': 0.0::DOUBLE, 'y': 0.0::DOUBLE, 'w': 0.0::DOUBLE, 'b': 0.0::DOUBLE, 'n': 0, 'a': 0.0::DOUBLE, 's': 0.0::DOUBLE, 'sy': 0.0::DOUBLE, 'sq': 0.0::DOUBLE, 'last': NULL::DOUBLE,
       'ev': []::STRUCT(n INT, mae DOUBLE, r2 DOUBLE, event VARCHAR)[]}}) AS g FROM l),
    events AS (SELECT niche, v.n::BIGINT AS samples, v.mae AS mae, v.r2 AS r2, v.event AS event FROM (SELECT niche, unnest(g.ev) AS v FROM f) u)"""


_SEQ = "l_orderkey * 10 + l_linenumber AS seq"
_LEARNED = _fold(f"SELECT niche, {_SEQ}, p AS x, y FROM predictions", "g.w * e.x + g.b")
_SATISFIED = _fold(
    f"SELECT niche, {_SEQ}, y - p AS x, CASE WHEN y - p > 0.1 THEN 1.0 WHEN y - p < -0.1 THEN 0.1 ELSE 0.7 END::DOUBLE AS y FROM predictions",
    "CASE WHEN g.n = 0 THEN 0.5 ELSE least(greatest(g.w * e.x + g.b, 0.0), 1.0) END",
)


def _feedback(predictions: DataFrame) -> DataFrame:
    return predictions.select("niche", (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("seq"), F.col("p").alias("x"), F.col("y"))


@query(f"WITH {_LEARNED} SELECT niche, 'y' AS target, samples, event, round(mae, 6) AS mae, round(r2, 6) AS r2 FROM events", "predictions", reads="predictions")
def str_03_07_learned(predictions: DataFrame) -> DataFrame:
    made = S.learned(_feedback(predictions), ["x"], ["y"])
    return made.select("niche", "target", "samples", "event", *rounded({c: F.col(c) for c in ("mae", "r2")}))


@query(f"WITH {_SATISFIED} SELECT niche, 'satisfaction' AS target, samples, event, round(mae, 6) AS mae, round(r2, 6) AS r2 FROM events", "predictions", reads="predictions")
def str_05_satisfaction_learned(predictions: DataFrame) -> DataFrame:
    """Labels by how far the truth lies above the prediction."""
    label = F.when(F.col("y") - F.col("p") > 0.1, "viral").when(F.col("y") - F.col("p") < -0.1, "flop").otherwise("good")
    rows = predictions.select("niche", (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("seq"), (F.col("y") - F.col("p")).alias("x"), label.alias("label"))
    made = S.satisfaction_learned(rows, ["x"])
    return made.select("niche", "target", "samples", "event", *rounded({c: F.col(c) for c in ("mae", "r2")}))


@query(
    """WITH RECURSIVE m AS (SELECT concat('https://media.example/', event_type, '/', user_id % 20) AS url, ts FROM events),
    kept AS (SELECT url, min(ts) AS ts FROM m GROUP BY url UNION ALL SELECT m.url, min(m.ts) FROM kept JOIN m ON m.url = kept.url AND m.ts >= kept.ts + INTERVAL 7 DAY GROUP BY m.url)
    SELECT url, sha256(url) AS url_hash, epoch_us(ts) AS seen_at_us FROM kept""",
    reads="events",
)
def str_08_unseen_media(events: DataFrame) -> DataFrame:
    url = F.concat(F.lit("https://media.example/"), "event_type", F.lit("/"), F.col("user_id") % 20)
    made = S.unseen_media(events.select(url.alias("url"), F.col("ts").cast("timestamp").alias("seen_at")))
    return made.select("url", "url_hash", F.unix_micros("seen_at").alias("seen_at_us"))


_STR_02_DELTA = "CASE WHEN predicted > 0 THEN (actual - predicted) / predicted * 100 WHEN actual > 0 THEN 100 ELSE 0 END"


@query(
    f"""WITH d AS (SELECT *, {_STR_02_DELTA} AS delta FROM ab_logs) SELECT post_id, round(actual, 6) AS actual, round(delta, 6)::DOUBLE AS delta, abs(delta) > 20 AS high_priority,
    round(least(1, least(1, abs(delta) / 100) * CASE WHEN abs(delta) > 50 THEN 1.5 WHEN abs(delta) > 20 THEN 1.2 ELSE 1 END * CASE content_format WHEN 'carousel' THEN 1.3 WHEN 'static_image' THEN 1.2 ELSE 1 END
    * CASE WHEN views > 10000 THEN 1.3 WHEN views > 1000 THEN 1.1 ELSE 1 END), 6)::DOUBLE AS priority FROM d""",
    "ab_logs",
    reads="ab_logs posts",
)
def str_02_profile_feedback(logs: DataFrame, posts: DataFrame) -> DataFrame:
    """Own profiles' pages with their recent posts, one of each author and format, as feedback rows."""
    fields = ["post_id", "content_format", "likes", "comments", "saves", "shares", "views", "predicted"]
    rows = logs.join(posts.select("post_id", "author_id"), "post_id")
    pages = rows.groupBy("author_id", "content_format").agg(F.collect_list(F.struct(*fields)).alias("recentPosts"))
    pages = pages.select(F.lit("instagram").alias("platform"), F.struct(F.col("author_id").cast("string").alias("username")).alias("profile"), "recentPosts")
    made = S.feedback_rows(S.profile_grid(pages), F.col("predicted"))
    return made.select("post_id", "high_priority", *rounded({c: F.col(c) for c in ("actual", "delta", "priority")}))


@query(
    """WITH h AS (SELECT trend, date_trunc('hour', posted_at) AS hour, count(*) AS n FROM trends GROUP BY 1, 2), a AS (SELECT *, (epoch(TIMESTAMP '2024-01-31 00:00:00') - epoch(hour)) / 3600 AS age FROM h)
    SELECT trend, CAST(sum(n) AS BIGINT) AS n, round(coalesce(sum(n) FILTER (age <= 48), 0) / sum(n), 6) AS pct_last_48h, round(coalesce(sum(n) FILTER (age > 48 AND age <= 168), 0) / sum(n), 6) AS pct_last_week,
    round(coalesce(sum(n) FILTER (age > 336), 0) / sum(n), 6) AS pct_older_2weeks FROM a GROUP BY trend""",
    "trends",
    reads="trends",
)
def str_09_rolling_shares(trends: DataFrame) -> DataFrame:
    made = S.folded(S.hourly_counts(trends.withColumn("posted_at", F.col("posted_at").cast("timestamp"))), "2024-01-31")
    return made.select("trend", "n", *rounded({c: F.col(c) for c in ("pct_last_48h", "pct_last_week", "pct_older_2weeks")}))


@query(
    "SELECT post_id % 50 AS experiment, content_format AS variant, count(*) FILTER (actual >= 50) AS wins, count(*) FILTER (actual < 50) AS losses FROM ab_logs GROUP BY 1, 2",
    "ab_logs",
    reads="ab_logs",
)
def str_10_bandit_counts(logs: DataFrame) -> DataFrame:
    return S.bandit_counts(logs.select((F.col("post_id") % 50).alias("experiment"), F.col("content_format").alias("variant"), F.col("actual").alias("score")))


@query(
    "SELECT o.o_orderkey AS content_id, l_linenumber FROM orders o JOIN lineitem l ON l_orderkey = o_orderkey WHERE l_shipdate >= o_orderdate + INTERVAL 24 HOUR AND l_shipdate <= o_orderdate + INTERVAL 168 HOUR",
    reads="orders lineitem",
)
def str_11_late_feedback(orders: DataFrame, lineitem: DataFrame) -> DataFrame:
    published = orders.select(F.col("o_orderkey").alias("content_id"), F.col("o_orderdate").cast("timestamp").alias("published_at"))
    measured = lineitem.select(F.col("l_orderkey").alias("content_id"), F.col("l_shipdate").cast("timestamp").alias("measured_at"), F.col("l_linenumber").alias("score"))
    return S.late_feedback(published, measured).select("content_id", F.col("score").alias("l_linenumber"))


@query(
    f"""WITH {_LEARNED} SELECT niche, 'y' AS target, max(samples) AS samples, round(max_by(mae, samples), 6) AS mae, round(max_by(r2, samples), 6) AS r2, round(min(mae), 6) AS best_mae,
    count(*) FILTER (event = 'retrain') AS retrains FROM events GROUP BY niche""",
    "predictions",
    reads="predictions",
)
def str_12_status(predictions: DataFrame) -> DataFrame:
    """The status of what the learner itself has reported."""
    made = S.status(S.learned(_feedback(predictions), ["x"], ["y"]))
    return made.select("niche", "target", "samples", "retrains", *rounded({c: F.col(c) for c in ("mae", "r2", "best_mae")}))


@query(
    "SELECT author_id, count(*) AS posts, CAST(sum(likes) AS BIGINT) AS likes, count(*) FILTER (content_format IN ('reel')) AS reels FROM posts GROUP BY author_id", "posts", reads="posts"
)
def src_06_str_01_ingested(posts: DataFrame) -> DataFrame:
    """Posts as captured payloads, ingested."""
    kind = F.when(F.col("content_format") == "reel", "video").otherwise("image")
    payload = posts.select(
        F.lit("instagram").alias("platform"), kind.alias("contentType"), F.col("post_id").cast("string").alias("contentId"), F.date_format("posted_at", "yyyy-MM-dd").alias("postedAt"),
        F.struct(F.col("author_id").cast("string").alias("username")).alias("author"), F.array(F.struct(kind.alias("type"), F.lit("http://x").alias("url"), F.lit(20.0).alias("duration"))).alias("media"),
        F.struct("likes", "comments", "shares", "saves", "views", F.lit(None).cast("long").alias("plays")).alias("metrics"), "author_id",
    )
    made = S.ingested(payload, "salt")
    return made.groupBy("author_id").agg(F.count("*").alias("posts"), F.sum("likes").alias("likes"), F.count_if(F.col("content_format") == "reel").alias("reels"))


@query(
    "SELECT post_id::VARCHAR AS platform_id, likes, comments, shares, views, author_id::VARCHAR AS author FROM posts WHERE post_id % 2 = 1 UNION ALL SELECT post_id::VARCHAR, likes, comments, 0, views, author_id::VARCHAR FROM posts WHERE post_id % 2 = 0",
    "posts",
    reads="posts",
)
def src_07_08_harmonised_records(posts: DataFrame) -> DataFrame:
    """Even posts as raw Instagram items, odd ones as TikTok items, read back into one table."""
    from pyspark.sql import types as T

    from tidemark.sources import records as R

    def shaped(rows: DataFrame, ddl: str, **values) -> DataFrame:
        fields = T.StructType.fromDDL(ddl).fields
        return rows.select(*[(values[f.name].cast(f.dataType) if f.name in values else F.lit(None).cast(f.dataType)).alias(f.name) for f in fields])

    ident, author = F.col("post_id").cast("string"), F.col("author_id").cast("string")
    at = F.date_format("posted_at", "yyyy-MM-dd")
    even = shaped(posts.where("post_id % 2 = 0"), R.INSTAGRAM, id=ident, type=F.lit("Video"), likesCount=F.col("likes"), commentsCount=F.col("comments"), videoPlayCount=F.col("views"), ownerUsername=author, timestamp=at)
    odd = shaped(
        posts.where("post_id % 2 = 1"), R.TIKTOK, id=ident, diggCount=F.col("likes"), commentCount=F.col("comments"), shareCount=F.col("shares"), playCount=F.col("views"),
        authorMeta=F.struct(author.alias("name"), F.lit(None).cast("long").alias("fans")), createTimeISO=at,
    )
    both = R.instagram(even).unionByName(R.tiktok(odd))
    return both.select("platform_id", "likes", "comments", "shares", "views", "author")


@query(
    """WITH w AS (SELECT * FROM (VALUES ('brand_awareness', 5.0, 2.0, 4.0, 2.0, 8.0), ('community', 2.0, 10.0, 5.0, 4.0, 3.0), ('viral', 2.0, 3.0, 15.0, 4.0, 6.0)) x(name, l, c, h, s, v)),
    r AS (SELECT post_id, name, least(greatest((ln(1 + likes) * l + ln(1 + comments) * c + ln(1 + shares) * h + ln(1 + saves) * s + ln(1 + views) * v) / (l + c + h + s + v) * 15, 0), 100)::DOUBLE AS rpi FROM posts CROSS JOIN w)
    SELECT post_id, max_by(name, rpi) AS best, round(max(rpi), 6) AS best_rpi, round(max(rpi) - min(rpi), 6) AS range FROM r GROUP BY post_id""",
    "posts",
    reads="posts",
)
def top_13_met_17_compare_weights(posts: DataFrame) -> DataFrame:
    from tidemark.config import METRICS, TEMPLATES
    from tidemark.operators.models import compare_weights

    rows = [(n, *[TEMPLATES[n].of(m) for m in METRICS]) for n in ("brand_awareness", "community", "viral")]
    weights = posts.sparkSession.createDataFrame(rows, "name string, " + ", ".join(f"{m} double" for m in METRICS))
    logs = posts.select("post_id", *[F.log1p(m).alias(f"log_{m}") for m in METRICS])
    made = compare_weights(logs, weights)
    return made.select("post_id", "best", *rounded({c: F.col(c) for c in ("best_rpi", "range")}))


@query(reads="posts")
def ml_15_retrain_report(posts: DataFrame) -> DataFrame:
    from tidemark.operators.models import retrain_report

    return retrain_report(_training(posts), _FEATURES, "log_likes", "posted_at", 90)


@query(
    """SELECT post_id, CASE WHEN post_id % 3 = 0 THEN 0.0 ELSE (post_id % 90)::DOUBLE END AS duration, CAST(post_id % 3 <> 0 AND post_id % 90 BETWEEN 15 AND 60 AS INT) AS video_optimal_length, CAST(post_id % 2 = 0 AS INT) AS has_audio,
    CAST(post_id % 2 = 0 AND post_id % 4 <> 0 AS INT) AS is_trending_audio, sha256(concat('salt', 'u', post_id)) AS url FROM posts""",
    "posts",
    reads="posts",
)
def cln_06_07_12_media(posts: DataFrame) -> DataFrame:
    from tidemark.functions import cleaning as K

    i = F.col("post_id")
    item = F.struct(F.when(i % 3 == 0, "image").otherwise("video").alias("type"), F.concat(F.lit("u"), i).alias("url"), (i % 90).cast("double").alias("duration"))
    audio = F.when(i % 4 == 0, "Original sound").when(i % 2 == 0, "hit")
    rows = posts.select("post_id", F.array(item).alias("media"), audio.alias("audio"))
    rows = K.anonymous(rows, "salt", [], "media").withColumn("duration", K.first_video(F.col("media")))
    return rows.select("post_id", "duration", *[c.alias(k) for k, c in K.media_flags(F.col("duration"), F.col("audio")).items()], F.col("media")[0]["url"].alias("url"))
