"""Raw records of several platforms as one post table, and the tables that are written."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.functions.cleaning import parsed_time
from tidemark.functions.text import tags

PAYLOAD = (
    "platform string, contentType string, contentId string, caption string, postedAt string, hashtags array<string>, mentions array<string>, "
    "author struct<username: string>, media array<struct<type: string, url: string, duration: double>>, audio struct<title: string, artist: string>, "
    "metrics struct<likes: bigint, comments: bigint, shares: bigint, saves: bigint, views: bigint, plays: bigint>, "
    "profile struct<username: string, followers: bigint>, recentPosts array<struct<id: string, likes: bigint, comments: bigint, views: bigint>>, extra string"
)
INSTAGRAM = "id string, shortCode string, type string, caption string, likesCount bigint, commentsCount bigint, videoViewCount bigint, videoPlayCount bigint, timestamp string, ownerUsername string, images array<string>, displayUrl string, hashtags array<string>, mentions array<string>, musicInfo struct<song_name: string>"
TIKTOK = "id string, text string, diggCount bigint, commentCount bigint, shareCount bigint, collectCount bigint, playCount bigint, createTimeISO string, authorMeta struct<name: string, fans: bigint>, hashtags array<struct<name: string>>, musicMeta struct<musicName: string>"
LINKEDIN = "urn string, text string, numLikes bigint, numComments bigint, numShares bigint, postedAt string, author string, document string, images array<string>"


def payloads(spark: SparkSession, path: str, streaming: bool = False) -> DataFrame:
    """SRC-06: captured JSON with its schema; what the schema lacks is left out. Batch or stream."""
    reader = spark.readStream if streaming else spark.read
    return reader.schema(PAYLOAD).json(path)


def csv(spark: SparkSession, path: str, schema: str | None = None, required: tuple[str, ...] = (), niche: str | None = None) -> DataFrame:
    """SRC-02/03/05: a CSV file under lower-case names with _ for blanks. Fails where a required column is absent.

    A niche is kept by its business_type, else by its flag column.
    """
    reader = spark.read.option("header", True)
    rows = reader.schema(schema).csv(path) if schema else reader.csv(path)
    rows = rows.toDF(*[c.strip().lower().replace(" ", "_") for c in rows.columns])
    absent = [c for c in required if c not in rows.columns]
    if absent:
        raise ValueError(f"{path} lacks {', '.join(absent)}")
    if niche is None:
        return rows
    if "business_type" in rows.columns:
        return rows.where(F.col("business_type") == niche)
    return rows.where(F.col(f"niche_{niche}").cast("int") == 1) if f"niche_{niche}" in rows.columns else rows.limit(0)


def dated_file(spark: SparkSession, path: str, schema: str, column: str = "published_date") -> DataFrame:
    """SRC-04: CSV or JSON by the file's name, with a parsed time."""
    rows = spark.read.schema(schema).json(path) if path.endswith((".json", ".jsonl")) else spark.read.schema(schema).option("header", True).csv(path)
    return rows.withColumn(column, parsed_time(F.col(column)))


def _count(*columns: str) -> Column:
    return F.coalesce(*[F.col(c) for c in columns], F.lit(0)).cast("long")


def _post(rows: DataFrame, platform: str, **columns: Column) -> DataFrame:
    return rows.select(F.lit(platform).alias("platform"), *[c.alias(k) for k, c in columns.items()])


def instagram(rows: DataFrame) -> DataFrame:
    """SRC-07: posts; a video is a reel, several images a carousel."""
    fmt = F.when(F.lower("type") == "video", "reel").when((F.lower("type") == "sidecar") | (F.coalesce(F.size("images"), F.lit(0)) > 1), "carousel").otherwise("static_image")
    return _post(
        rows, "instagram", platform_id=F.coalesce("id", "shortCode"), author=F.col("ownerUsername"), content_format=fmt, caption=F.coalesce("caption", F.lit("")),
        hashtags=F.coalesce("hashtags", tags(F.col("caption"))), likes=_count("likesCount"), comments=_count("commentsCount"), shares=F.lit(0).cast("long"), saves=F.lit(0).cast("long"),
        views=_count("videoViewCount", "videoPlayCount"), audio=F.col("musicInfo.song_name"), media_urls=F.coalesce("images", F.array("displayUrl")), posted_at=parsed_time(F.col("timestamp")),
    )


def tiktok(rows: DataFrame) -> DataFrame:
    """SRC-08."""
    return _post(
        rows, "tiktok", platform_id=F.col("id"), author=F.col("authorMeta.name"), content_format=F.lit("tiktok_video"), caption=F.coalesce("text", F.lit("")),
        hashtags=F.transform("hashtags", lambda h: h["name"]), likes=_count("diggCount"), comments=_count("commentCount"), shares=_count("shareCount"), saves=_count("collectCount"),
        views=_count("playCount"), audio=F.col("musicMeta.musicName"), media_urls=F.expr("cast(array() as array<string>)"), posted_at=parsed_time(F.col("createTimeISO")),
    )


def linkedin(rows: DataFrame) -> DataFrame:
    """SRC-09: a document makes a carousel."""
    return _post(
        rows, "linkedin", platform_id=F.col("urn"), author=F.col("author"), content_format=F.when(F.col("document").isNotNull(), "linkedin_carousel").otherwise("linkedin_post"), caption=F.coalesce("text", F.lit("")),
        hashtags=tags(F.coalesce("text", F.lit(""))), likes=_count("numLikes"), comments=_count("numComments"), shares=_count("numShares"), saves=F.lit(0).cast("long"),
        views=F.lit(0).cast("long"), audio=F.lit(None).cast("string"), media_urls=F.coalesce("images", F.expr("cast(array() as array<string>)")), posted_at=parsed_time(F.col("postedAt")),
    )


def trending(posts: DataFrame, limit: int = 50) -> DataFrame:
    """SRC-10: search results by likes and comments."""
    return posts.orderBy(F.desc(F.col("likes") + F.col("comments")), "platform_id").limit(limit)


def profile(rows: DataFrame) -> DataFrame:
    """SRC-11: handle, name and followers of records of several shapes: flat, nested owner, author's metadata."""

    def there(path: str) -> bool:
        kind = rows.schema
        for part in path.split("."):
            if not isinstance(kind, T.StructType) or part not in kind.names:
                return False
            kind = kind[part].dataType
        return True

    def pick(*paths: str) -> Column:
        found = [F.col(p) for p in paths if there(p)]
        return F.coalesce(*found) if found else F.lit(None)

    handle = pick("ownerUsername", "username", "owner.username", "authorMeta.name")
    return rows.withColumns(
        {
            "handle": F.lower(F.regexp_replace(F.trim(handle.cast("string")), "^@", "")),
            "full_name": F.coalesce(pick("ownerFullName", "fullName", "owner.full_name", "authorMeta.nickName").cast("string"), F.lit("")),
            "followers": F.coalesce(pick("ownerFollowerCount", "followersCount", "owner.followers", "authorMeta.fans").cast("long"), F.lit(0)),
        }
    )


def insights(rows: DataFrame, data: str = "data") -> DataFrame:
    """SRC-16: an array of (name, values of (value)) as columns; watch time in seconds."""
    value = lambda name: F.try_element_at(F.col("_map"), F.lit(name))
    rows = rows.withColumn("_map", F.map_from_entries(F.transform(data, lambda d: F.struct(d["name"], F.try_element_at(d["values"], F.lit(1))["value"]))))
    plain = ("reach", "saved", "shares", "plays", "total_interactions")
    return rows.withColumns({n: F.coalesce(value(n), F.lit(0)) for n in plain} | {"watch_seconds": F.coalesce(value("ig_reels_video_view_total_time"), F.lit(0)) / 1000}).drop("_map")


def export(content: DataFrame, path: str, fmt: str = "csv", ids: DataFrame | None = None, columns: list[str] | None = None) -> None:
    """SRC-12: content, of some ids, as CSV or JSON; arrays joined by a comma for CSV."""
    rows = content if ids is None else content.join(ids.select("id").distinct(), "id", "left_semi")
    rows = rows.select(*columns) if columns else rows
    if fmt == "csv":
        rows = rows.withColumns({f.name: F.array_join(f.name, ", ") for f in rows.schema if isinstance(f.dataType, T.ArrayType)})
        rows.write.mode("overwrite").option("header", True).csv(path)
    elif fmt == "json":
        rows.write.mode("overwrite").json(path)
    else:
        raise ValueError(f"no export format {fmt!r}")


def save_run(result: DataFrame, path: str, run: str) -> None:
    """SRC-13: a ranked result, by run, as CSV and JSON."""
    named = result.withColumn("run", F.lit(run))
    flat = named.withColumns({f.name: F.array_join(f.name, ", ") for f in named.schema if isinstance(f.dataType, T.ArrayType)})
    flat.write.mode("append").partitionBy("run").option("header", True).csv(f"{path}/csv")
    named.write.mode("append").partitionBy("run").json(f"{path}/json")


def append_evaluation(result: DataFrame, path: str) -> None:
    """SRC-14: evaluations are appended; the bound on what is kept is applied where they are read."""
    result.write.mode("append").partitionBy("niche").parquet(path)


def evaluation_history(spark: SparkSession, path: str, keep: int = 100) -> DataFrame:
    rows = spark.read.parquet(path)
    return rows.withColumn("_p", F.row_number().over(Window.partitionBy("niche").orderBy(F.desc("ts"), "run"))).where(F.col("_p") <= keep).drop("_p")


def append_log(logs: DataFrame, path: str, at: str = "logged_at") -> None:
    """SRC-15: logs appended by date; a day's rows come from few tasks, so that a write makes few files."""
    logs.withColumn("day", F.to_date(at)).hint("rebalance", "day").write.mode("append").partitionBy("day").parquet(path)
