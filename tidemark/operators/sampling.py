"""Ranks within accounts, performance tiers, balanced samples, labels and splits."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.config import Sampling
from tidemark.operators.ranks import quantiles, values_at, with_place


def keyed(*parts: Column | str | int) -> Column:
    """A number of 60 bits drawn by the parts' text, which must name what is drawn for; any engine with MD5 draws the same."""
    text = F.concat_ws("|", *[(F.col(p) if isinstance(p, str) else F.lit(p) if isinstance(p, int) else p).cast("string") for p in parts])
    return F.conv(F.substring(F.md5(text.cast("binary")), 1, 15), 16, 10).cast("long")


def _ranked(posts: DataFrame, by: str, key: str, ident: str) -> DataFrame:
    """``_up`` and ``_down``: places from the best and the worst, from 0; ``_n``: the account's rows. One shuffle by account."""
    own = Window.partitionBy(key)
    best = own.orderBy(F.desc(by), F.asc(ident))
    return posts.withColumns({"_up": F.row_number().over(best) - 1, "_n": F.count("*").over(own)}).withColumn("_down", F.col("_n") - 1 - F.col("_up"))


def tiers(posts: DataFrame, by: str = "engagement_score", key: str = "author_id", ident: str = "post_id") -> DataFrame:
    """WIN-08: tier and percentile of each post among its account's."""
    n, rank = F.col("_n"), F.col("_up")
    tier = F.when(rank < F.floor(n * 0.2), "top").when(rank >= F.floor(n * 0.8), "bottom").otherwise("middle")
    made = _ranked(posts, by, key, ident).withColumns({"performance_tier": tier, "performance_percentile": F.round((1 - rank / n) * 100, 1)})
    return made.drop("_up", "_down", "_n")


def _limited(posts: DataFrame, n: int, key: str, order: list[Column]) -> DataFrame:
    place = F.row_number().over(Window.partitionBy(key).orderBy(*order))
    return posts.withColumn("_place", place).where(F.col("_place") <= n).drop("_place")


def top_only(posts: DataFrame, n: int, by: str, key: str = "author_id", ident: str = "post_id") -> DataFrame:
    """TOP-01/04: the best ``n`` of each account; each task keeps no more of one before the shuffle."""
    return _limited(posts, n, key, [F.desc(by), F.asc(ident)])


def bottom_only(posts: DataFrame, n: int, by: str, key: str = "author_id", ident: str = "post_id") -> DataFrame:
    """TOP-01/04: the worst ``n`` of each account; each task keeps no more of one before the shuffle."""
    return _limited(posts, n, key, [F.asc(by), F.desc(ident)])


def balanced(posts: DataFrame, config: Sampling = Sampling(), by: str = "engagement_score", key: str = "author_id", ident: str = "post_id") -> DataFrame:
    """TOP-02: the best and the worst of each account without overlap; all of an account with few posts."""
    keep = (F.col("_n") < config.least_posts) | (F.col("_up") < config.top) | (F.col("_down") < F.least(F.lit(config.bottom), F.col("_n") - config.top))
    return _ranked(posts, by, key, ident).where(keep).drop("_up", "_down", "_n")


def stratified(posts: DataFrame, top: int = 25, by: str = "engagement_score", key: str = "author_id", ident: str = "post_id") -> DataFrame:
    """TOP-03: quintiles of the ranks, the last with the remainder; twice as many of both ends, half of the middle ones."""
    each = max(top // 5, 2)
    size = F.greatest(F.floor(F.col("_n") / 5), F.lit(1))
    stratum = F.least(F.floor(F.col("_up") / size), F.lit(4))
    place = F.col("_up") - stratum * size
    quota = F.when(stratum.isin(0, 4), each * 2).otherwise(each // 2)
    return _ranked(posts, by, key, ident).where((F.col("_n") < 10) | (place < quota)).drop("_up", "_down", "_n")


def top_rows(posts: DataFrame, n: int, order: list[Column]) -> DataFrame:
    """TOP-04…08, 16: the first rows of the whole table; Spark keeps ``n`` for each task."""
    return posts.orderBy(*order).limit(n)


def label_by_position(posts: DataFrame, by: str = "engagement_ratio", top: float = 0.2, bottom: float = 0.2, least: float = 0.0) -> DataFrame:
    """LAB-01: viral, flop or middle against the values at the cut-off places of the rows above ``least``.

    Rows at or below ``least`` don't move
    the cut-offs but are labelled by them.
    """
    # Places from the largest on; outside the table there is no cut-off.
    high, low = F.floor(F.col("n") * top), F.floor(F.col("n") * (1 - bottom))
    inside = lambda at, place: F.when((at > 0) & (at < F.col("n")), place).otherwise(-1)
    viral_from, flop_to = values_at(posts.where(F.col(by) > least), by, [inside(high, F.col("n") - high), inside(low, F.col("n") - 1 - low)])
    viral = F.lit(False) if viral_from is None else F.coalesce((F.col(by) >= viral_from) & F.lit(viral_from > 0), F.lit(False))
    label = F.when(viral, "viral").when(F.col(by) <= (flop_to or 0.0), "flop").otherwise("middle")
    return _with_class(posts.withColumn("viral_label", label))


def label_by_quantile(posts: DataFrame, by: str = "engagement_ratio", top: float = 0.2, bottom: float = 0.2) -> DataFrame:
    """LAB-02: viral, flop or middle against interpolated quantiles."""
    high, low = (F.lit(q).cast("double") for q in quantiles(posts, by, [1 - top, bottom]))
    label = F.when(F.col(by) >= high, "viral").when(F.col(by) <= low, "flop").otherwise("middle")
    return _with_class(posts.withColumn("viral_label", label))


def _with_class(rows: DataFrame) -> DataFrame:
    return rows.withColumn("is_viral", F.when(F.col("viral_label") == "viral", 1).when(F.col("viral_label") == "flop", 0))


def undersample(rows: DataFrame, keep: int, ident: str, seed: int = 42) -> DataFrame:
    """LAB-04: exactly ``keep`` rows, those of the smallest keyed hashes; the same at any partitioning, and ordered by ranges."""
    placed = with_place(rows.withColumn("_hash", keyed(ident, seed)), "_hash", ident, "_place")
    return placed.where(F.col("_place") < keep).drop("_hash", "_place")


def oversample(rows: DataFrame, wanted: int, metrics: list[str], ident: str, seed: int = 42, noise: float = 0.1) -> DataFrame:
    """LAB-05: ``wanted`` synthetic rows round-robin from ``rows``, with metrics moved by up to ``noise`` and their provenance.

    Each row is copied as often as its turn comes, so no join is needed: the copies are made in place.
    """
    total = rows.count()
    if not total or wanted <= 0:
        return rows.limit(0).withColumns({"is_synthetic": F.lit(True), "source_id": F.col(ident), "copy": F.lit(0)})
    times = F.floor((F.lit(wanted) - 1 - F.col("_place")) / total) + 1
    copies = with_place(rows.withColumn("_hash", keyed(ident, seed)), "_hash", ident, name="_place").drop("_hash").where(F.col("_place") < wanted)
    copies = copies.withColumn("copy", F.explode(F.sequence(F.lit(1), times.cast("int"))))
    draw = lambda m: keyed(ident, "copy", F.lit(m), seed) % 1_000_001 / 1_000_000 * 2 - 1
    moved = {m: F.greatest(F.lit(0), F.floor(F.col(m) * (1 + draw(m) * noise))).cast("long") for m in metrics}
    return copies.withColumns(moved).withColumns({"is_synthetic": F.lit(True), "source_id": F.col(ident)}).drop("_place")


def balance(rows: DataFrame, metrics: list[str], ident: str, least_share: float = 0.3, strategy: str = "hybrid", seed: int = 42) -> DataFrame:
    """LAB-03/06: labelled rows with at least ``least_share`` negatives, by fewer positives or more negatives.

    ``hybrid`` takes fewer positives if seven tenths of them stay. Only the two counts come to the driver.
    """
    labelled = rows.where("is_viral is not null")
    counts = labelled.agg(F.count_if(F.col("is_viral") == 1).alias("p"), F.count_if(F.col("is_viral") == 0).alias("n")).first()
    p, n = counts["p"], counts["n"]
    plain = {"is_synthetic": F.lit(False), "source_id": F.col(ident), "copy": F.lit(0)}
    labelled = labelled.withColumns(plain)
    if not p or not n or n / (p + n) >= least_share:
        return labelled
    fewer = int(n * (1 - least_share) / least_share)
    positive, negative = labelled.where("is_viral = 1"), labelled.where("is_viral = 0")
    if strategy == "undersample" or strategy == "hybrid" and fewer >= 0.7 * p:
        return undersample(positive, fewer, ident, seed).unionByName(negative)
    more = -int(-p * least_share / (1 - least_share) // 1) - n
    extra = oversample(negative.drop(*plain), more, metrics, ident, seed, 0.15 if strategy == "hybrid" else 0.1)
    return labelled.unionByName(extra)


def split_by_time(rows: DataFrame, at: str, days: int = 7) -> DataFrame:
    """LAB-09: ``is_test`` for the last ``days`` days before the latest row."""
    last = rows.agg(F.max(at).alias("_last"))
    return rows.crossJoin(F.broadcast(last)).withColumn("is_test", F.col(at) > F.col("_last") - F.expr(f"interval {days} days")).drop("_last")


def split_by_hash(rows: DataFrame, ident: str, share: int = 80, seed: int = 42) -> DataFrame:
    """LAB-10: ``is_test`` by a keyed hash of the id, the same at any partitioning."""
    return rows.withColumn("is_test", keyed(ident, seed) % 100 >= share)


def sample_weight(target: Column, below: float = 1.0, weight: float = 3.5) -> Column:
    """LAB-11."""
    return F.when(target < below, weight).otherwise(1.0)


def above_median(rows: DataFrame, by: str) -> DataFrame:
    """LAB-12: ``high``: 1 above the median."""
    middle = quantiles(rows, by, [0.5])[0]
    return rows.withColumn("high", (F.col(by) > F.lit(middle).cast("double")).cast("int"))


def statistics(labelled: DataFrame, balanced: DataFrame) -> DataFrame:
    """LAB-08: one row of counts: what went in, its classes, and what balancing gave, with its share of negatives."""
    kind = lambda c: F.count_if(c)
    before = labelled.agg(
        F.count("*").alias("input_count"), kind(F.col("is_viral") == 1).alias("viral_count"), kind(F.col("is_viral") == 0).alias("flop_count"), kind(F.col("is_viral").isNull()).alias("middle_count")
    )
    negative = kind(F.col("is_viral") == 0)
    after = balanced.agg(F.count("*").alias("output_count"), kind(F.col("is_synthetic")).alias("synthetic_count"), (negative / F.greatest(F.count("*"), F.lit(1))).alias("negative_share"))
    return before.crossJoin(after)


def best_of_business(posts: DataFrame, limit: int = 15, business: str = "business_id", by: str = "engagement_score", ident: str = "post_id", longest: int = 300) -> DataFrame:
    """TOP-05: the best posts of each business over all its competitors, with captions cut to ``longest``. NULL captions are empty."""
    place = F.row_number().over(Window.partitionBy(business).orderBy(F.desc(by), F.asc(ident)))
    kept = posts.withColumn("_p", place).where(F.col("_p") <= limit).drop("_p")
    return kept.withColumn("caption", F.substring(F.coalesce("caption", F.lit("")), 1, longest))


def failed_of_niche(posts: DataFrame, limit: int = 20, more_than: int = 50, niche: str = "niche", by: str = "engagement_score", ident: str = "post_id") -> DataFrame:
    """TOP-06: the worst posts of each niche that has over ``more_than`` posts; smaller niches are noise and give none."""
    large = posts.where(F.col(niche).isNotNull()).groupBy(niche).agg(F.count("*").alias("_n")).where(F.col("_n") > more_than).select(niche)
    place = F.row_number().over(Window.partitionBy(niche).orderBy(F.asc(by), F.asc(ident)))
    return posts.withColumn("_p", place).where(F.col("_p") <= limit).drop("_p").join(large, niche, "left_semi")


def training_queue(samples: DataFrame, least: float = 0.0, priority: str = "priority", ident: str = "post_id") -> DataFrame:
    """TOP-07: samples of at least that priority, the most urgent first."""
    return samples.where(F.col(priority) >= least).orderBy(F.desc(priority), ident)
