"""Times, formats and privacy as column expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Accepted time formats, hours and formats.
TIME_FORMATS = ("yyyy-MM-dd'T'HH:mm:ss.SSSX", "yyyy-MM-dd'T'HH:mm:ssX", "yyyy-MM-dd'T'HH:mm:ss", "yyyy-MM-dd")
PRIME_HOURS = (11, 12, 13, 19, 20, 21)
VIDEO_KINDS = ("reel", "video", "tiktok", "tiktok_video")
FORMATS = {"image": "static_image", "sidecar": "carousel", "video": "reel", "reel": "reel", "carousel": "carousel", "story": "story"}
POST_TYPES = ("carousel", "reel", "static", "story", "video")


def parsed_time(*texts: Column) -> Column:
    """CLN-01: the first of the texts that is a time: seconds since the epoch, or one of the formats. Never fails."""
    made = []
    for t in texts:
        t = t.cast("string")
        made.append(F.timestamp_seconds(F.when(t.rlike(r"^\d{9,10}(\.\d+)?$"), t).try_cast("double")))
        made.extend(F.try_to_timestamp(t, F.lit(f)) for f in TIME_FORMATS)
    return F.coalesce(*made)


def hour_and_day(at: Column, hour: int = 12, day: int = 2) -> dict[str, Column]:
    """CLN-02/03: hour and weekday, Monday 0, with defaults; weekend and prime time, which without a time are 0 and 1."""
    h, d = F.coalesce(F.hour(at), F.lit(hour)), F.coalesce(F.weekday(at), F.lit(day))
    return {"hour_of_day": h, "day_of_week": d, "is_weekend": (d >= 5).cast("int"), "is_prime_time": h.isin(*PRIME_HOURS).cast("int")}


def content_format(kind: Column, default: str = "static_image") -> Column:
    """CLN-04."""
    made = F.lit(None).cast("string")
    for k, v in FORMATS.items():
        made = F.when(F.lower(kind) == k, v).otherwise(made)
    return F.coalesce(made, F.lit(default))


def format_flags(fmt: Column) -> dict[str, Column]:
    return {
        "is_reel": fmt.isin("reel", "tiktok_video", "video").cast("int"),
        "is_carousel": (fmt == "carousel").cast("int"),
        "is_static": fmt.isin("static_image", "static", "image").cast("int"),
    }


def is_video(media_type: Column, is_reel: Column, fmt: Column, duration: Column) -> Column:
    """CLN-05."""
    yes = lambda c: F.coalesce(c, F.lit(False))
    return yes(F.lower(media_type).isin(*VIDEO_KINDS)) | yes(is_reel == 1) | yes(F.lower(fmt).isin(*VIDEO_KINDS)) | yes(duration > 0)


def first_video(media: Column) -> Column:
    """CLN-06: the duration of the first video of an array of (type, url, duration), 0 if none."""
    return F.coalesce(F.try_element_at(F.filter(media, lambda m: m["type"] == "video"), F.lit(1))["duration"], F.lit(0.0))


def media_flags(duration: Column, audio: Column) -> dict[str, Column]:
    """CLN-07."""
    there = F.coalesce(audio, F.lit("")) != ""
    d = F.coalesce(duration, F.lit(0))
    return {"video_optimal_length": d.between(15, 60).cast("int"), "has_audio": there.cast("int"), "is_trending_audio": (there & ~F.contains(F.lower(F.coalesce(audio, F.lit(""))), F.lit("original"))).cast("int")}


def encoded(value: Column, known: tuple[str, ...] = POST_TYPES, unknown: int = -1) -> Column:
    """CLN-08: the place in alphabetical order."""
    made = F.lit(unknown)
    for i, k in enumerate(sorted(known)):
        made = F.when(F.lower(value) == k, i).otherwise(made)
    return made


def validated(rows: DataFrame, target: str, features: list[str], highest: float = 5.0) -> tuple[DataFrame, DataFrame]:
    """CLN-09: rows with a finite target, clipped, and NULL features as 0; and the counts before and after in one row."""
    good = F.col(target).isNotNull() & ~F.isnan(target) & (F.abs(target) < F.lit(float("inf")))
    counts = rows.agg(F.count("*").alias("before"), F.count_if(good).alias("after"))
    made = rows.where(good).withColumn(target, F.least(F.greatest(F.col(target), F.lit(0.0)), F.lit(highest))).na.fill(0, features)
    return made, counts


def quarantined(rows: DataFrame, metrics: list[str]) -> tuple[DataFrame, DataFrame]:
    """CLN-10: rows without a negative metric, and the others."""
    bad = F.lit(False)
    for m in metrics:
        bad = bad | F.coalesce(F.col(m) < 0, F.lit(False))
    return rows.where(~bad), rows.where(bad)


def hashed(value: Column, salt: str, on: bool = True) -> Column:
    """CLN-11/16: salted SHA-256 of the trimmed value; blank and NULL are NULL. The salt comes from configuration."""
    v = F.trim(value.cast("string"))
    return F.when(v != "", F.sha2(F.concat(F.lit(salt), v), 256)) if on else value


def anonymous(record: DataFrame, salt: str, columns: list[str], media: str | None = None) -> DataFrame:
    """CLN-12: named columns and the addresses in an array of media hashed."""
    made = record.withColumns({c: hashed(F.col(c), salt) for c in columns})
    if media:
        made = made.withColumn(media, F.transform(media, lambda m: m.withField("url", hashed(m["url"], salt))))
    return made


def redacted(t: Column) -> Column:
    """CLN-13: e-mail addresses and handles out of a text."""
    return F.regexp_replace(F.regexp_replace(t, r"[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}", "[EMAIL]"), r"@[A-Za-z0-9_.]+", "[HANDLE]")


def content_key(platform: Column, ident: Column, author: Column) -> Column:
    """CLN-14: 16 hexadecimal digits of a content's identity."""
    return F.substring(F.sha2(F.concat_ws(":", platform, ident, author), 256), 1, 16)


def content_number(key: Column, modulus: int = 1_000_000_000) -> Column:
    """CLN-14: the key as a number below ``modulus``; 64 bits go beyond a long."""
    return F.pmod(F.conv(key, 16, 10).cast("decimal(20,0)"), F.lit(modulus)).cast("long")
