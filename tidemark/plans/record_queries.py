"""Sources and sinks on the posts of the test tables: files are written and read back, raw items are harmonised.

Files go to a folder of their own for each call under ``spark.checkpoint.dir``, as results read them lazily.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.operators.tables import new_folder
from tidemark.plans.register import query
from tidemark.sources import records as R


def _folder(spark: SparkSession) -> str:
    return new_folder(spark, "records")


@query(
    "SELECT post_id, likes::BIGINT AS likes, (views % 100)::BIGINT AS rpi_score FROM posts WHERE niche = 'BUILDING' AND content_format = 'reel'",
    "posts",
    reads="posts",
)
def src_02_03_05_12_csv_export_read(posts: DataFrame) -> DataFrame:
    """Reels exported as CSV by their ids under names of a spreadsheet, read back by niche with a required column."""
    path = _folder(posts.sparkSession)
    named = posts.select(F.col("post_id").alias("id"), F.col("likes").alias(" Likes"), F.col("niche").alias("Business Type"), F.expr("views % 100").alias("RPI Score"))
    R.export(named, path, ids=posts.where("content_format = 'reel'").select(F.col("post_id").alias("id")))
    rows = R.csv(posts.sparkSession, path, required=("rpi_score",), niche="BUILDING")
    return rows.select(F.col("id").cast("long").alias("post_id"), F.col("likes").cast("long").alias("likes"), F.col("rpi_score").cast("long").alias("rpi_score"))


@query(
    "SELECT post_id, 1 AS niche_gym, likes::BIGINT AS likes FROM posts WHERE niche = 'MACHINERY'",
    "posts",
    reads="posts",
)
def src_02_csv_niche_flag(posts: DataFrame) -> DataFrame:
    """A CSV file without business types is filtered by the niche's flag column."""
    path = _folder(posts.sparkSession)
    R.export(posts.select("post_id", "likes", F.coalesce(F.col("niche") == "MACHINERY", F.lit(False)).cast("int").alias("niche_gym")), path)
    return R.csv(posts.sparkSession, path, schema="post_id long, likes long, niche_gym int", niche="gym").select("post_id", "niche_gym", "likes")


@query(
    "SELECT post_id, form, strftime(posted_at, '%Y-%m-%d') AS published FROM posts CROSS JOIN (VALUES ('csv'), ('json')) f(form)",
    "posts",
    reads="posts",
)
def src_04_dated_files(posts: DataFrame) -> DataFrame:
    """Posts with their dates through a CSV and a JSON file."""
    path, made = _folder(posts.sparkSession), None
    dated = posts.select("post_id", F.date_format("posted_at", "yyyy-MM-dd").alias("published_date"))
    for form in ("csv", "json"):
        R.export(dated, f"{path}/posts.{form}", fmt=form)
        rows = R.dated_file(posts.sparkSession, f"{path}/posts.{form}", "post_id long, published_date string")
        rows = rows.select("post_id", F.lit(form).alias("form"), F.date_format("published_date", "yyyy-MM-dd").alias("published"))
        made = rows if made is None else made.unionByName(rows)
    return made


@query(
    """SELECT post_id::VARCHAR AS platform_id, coalesce(caption, '') AS caption, CASE WHEN content_format = 'carousel' THEN 'linkedin_carousel' ELSE 'linkedin_post' END AS content_format,
      likes::BIGINT AS likes, comments::BIGINT AS comments, shares::BIGINT AS shares, CASE WHEN caption LIKE '%#tag%' THEN 2 ELSE 0 END AS n_hashtags
    FROM posts JOIN captions USING (post_id, content_format)""",
    "posts",
    "captions",
    reads="posts captions",
)
def src_09_linkedin_records(posts: DataFrame, captions: DataFrame) -> DataFrame:
    """Posts as raw LinkedIn items, read back; carousels have a document."""
    raw = posts.join(captions.select("post_id", "caption"), "post_id").select(
        F.col("post_id").cast("string").alias("urn"), F.col("caption").alias("text"), F.col("likes").alias("numLikes"), F.col("comments").alias("numComments"), F.col("shares").alias("numShares"),
        F.date_format("posted_at", "yyyy-MM-dd").alias("postedAt"), F.col("author_id").cast("string").alias("author"), F.when(F.col("content_format") == "carousel", "a.pdf").alias("document"),
        F.lit(None).cast("array<string>").alias("images"),
    )
    made = R.linkedin(raw)
    return made.select("platform_id", "caption", "content_format", "likes", "comments", "shares", F.size("hashtags").alias("n_hashtags"))


@query(
    "SELECT post_id::VARCHAR AS platform_id, (likes + comments)::BIGINT AS interactions FROM posts ORDER BY likes + comments DESC, post_id::VARCHAR LIMIT 50",
    "posts",
    reads="posts",
)
def src_10_trending_records(posts: DataFrame) -> DataFrame:
    """The 50 posts with most likes and comments."""
    best = R.trending(posts.select(F.col("post_id").cast("string").alias("platform_id"), "likes", "comments"))
    return best.select("platform_id", (F.col("likes") + F.col("comments")).cast("long").alias("interactions"))


@query(
    """SELECT author_id, lower(username) AS handle, CASE WHEN author_id % 4 = 1 THEN '' ELSE username END AS full_name, CASE WHEN author_id % 4 = 3 THEN 0 ELSE followers END::BIGINT AS followers
    FROM authors""",
    "authors",
    reads="authors",
)
def src_11_profiles(authors: DataFrame) -> DataFrame:
    """Authors as records of four shapes: flat owner, account without a name, nested owner, author's metadata without followers."""
    name, fans = F.col("username"), F.col("followers")
    shapes = [
        [F.concat(F.lit(" @"), name).alias("ownerUsername"), name.alias("ownerFullName"), fans.alias("ownerFollowerCount")],
        [F.concat(F.lit("@"), name).alias("username"), fans.alias("followersCount")],
        [F.struct(name.alias("username"), name.alias("full_name"), fans.alias("followers")).alias("owner")],
        [F.struct(name.alias("name"), name.alias("nickName"), F.lit(None).cast("long").alias("fans")).alias("authorMeta")],
    ]
    made = None
    for i, shape in enumerate(shapes):
        rows = R.profile(authors.where(F.col("author_id") % 4 == i).select("author_id", *shape)).select("author_id", "handle", "full_name", "followers")
        made = rows if made is None else made.unionByName(rows)
    return made


@query(
    """WITH r AS (SELECT author_id, niche, followers, row_number() OVER (PARTITION BY niche ORDER BY followers DESC, author_id) AS place FROM authors)
    SELECT author_id, niche AS run, form, followers::BIGINT AS followers FROM r CROSS JOIN (VALUES ('csv'), ('json')) f(form) WHERE place <= 20""",
    "authors",
    reads="authors",
)
def src_13_saved_runs(authors: DataFrame) -> DataFrame:
    """The 20 largest authors of each niche as a run of its own, saved as CSV and JSON and read back."""
    from pyspark.sql import Window

    path, spark = _folder(authors.sparkSession), authors.sparkSession
    place = F.row_number().over(Window.partitionBy("niche").orderBy(F.desc("followers"), "author_id"))
    best = authors.withColumn("place", place).where("place <= 20").select("niche", "author_id", "followers")
    for niche in ("AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY"):
        R.save_run(best.where(F.col("niche") == niche).drop("niche"), path, niche)
    schema = T.StructType.fromDDL("author_id long, followers long, run string")
    flat = spark.read.schema(schema).option("header", True).csv(f"{path}/csv").withColumn("form", F.lit("csv"))
    nested = spark.read.schema(schema).json(f"{path}/json").withColumn("form", F.lit("json"))
    return flat.unionByName(nested).select("author_id", "run", "form", "followers")


@query(
    """WITH e AS (SELECT niche, (l_partkey % 150)::BIGINT AS run, count(*) AS n FROM predictions GROUP BY ALL),
    p AS (SELECT *, row_number() OVER (PARTITION BY niche ORDER BY run DESC) AS place FROM e)
    SELECT niche, run, n FROM p WHERE place <= 100""",
    "predictions",
    reads="predictions",
)
def src_14_evaluation_history(predictions: DataFrame) -> DataFrame:
    """Evaluations of 150 runs, appended in two writes; the last 100 of each niche are read."""
    path = _folder(predictions.sparkSession)
    results = predictions.groupBy("niche", (F.col("l_partkey") % 150).cast("long").alias("run")).agg(F.count("*").alias("n")).withColumn("ts", F.col("run"))
    R.append_evaluation(results.where("run < 75"), path)
    R.append_evaluation(results.where("run >= 75"), path)
    return R.evaluation_history(predictions.sparkSession, path).select("niche", "run", "n")


@query(
    "SELECT post_id, actual, date_part('year', posted_at)::INT AS logged_year FROM ab_logs",
    "ab_logs",
    reads="ab_logs",
)
def src_15_appended_logs(ab_logs: DataFrame) -> DataFrame:
    """Logs of predictions appended in two writes, by the day that begins their year."""
    path = _folder(ab_logs.sparkSession)
    logs = ab_logs.select("post_id", "actual", F.date_trunc("year", "posted_at").alias("logged_at"))
    R.append_log(logs.where("post_id % 2 = 0"), path)
    R.append_log(logs.where("post_id % 2 = 1"), path)
    return ab_logs.sparkSession.read.parquet(path).select("post_id", "actual", F.year("day").alias("logged_year"))


@query(
    "SELECT post_id, views::BIGINT AS reach, saves::BIGINT AS saved, shares::BIGINT AS shares, 0::BIGINT AS plays, (likes / 1000)::DOUBLE AS watch_seconds FROM posts",
    "posts",
    reads="posts",
)
def src_16_insights(posts: DataFrame) -> DataFrame:
    """Posts' figures as arrays of names and values, read back as columns."""
    entry = lambda name, column: F.struct(F.lit(name).alias("name"), F.array(F.struct(F.col(column).cast("long").alias("value"))).alias("values"))
    data = F.array(entry("reach", "views"), entry("saved", "saves"), entry("shares", "shares"), entry("ig_reels_video_view_total_time", "likes"))
    return R.insights(posts.select("post_id", data.alias("data"))).select("post_id", "reach", "saved", "shares", F.col("plays").cast("long").alias("plays"), "watch_seconds")
