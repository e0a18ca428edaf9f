"""Streams of captured content and feedback.

Per-niche learning keeps its state in ``transformWithState``: counts and squared errors of predictions made before learning,
the weights of a linear model of each target, and counters for evaluation. The same functions serve batch tests, as a stream
of finished files gives what the whole table gives.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from tidemark.config import INGEST, SCORE
from tidemark.functions import cleaning as K
from tidemark.functions import metrics as M
from tidemark.streaming.blocks import learned_in_blocks


def ingested(payloads: DataFrame, salt: str) -> DataFrame:
    """STR-01: payloads as posts: author hashed, media addresses hashed, times and formats parsed, targets made."""
    rows = payloads.withColumns(
        {
            "content_key": K.content_key(F.col("platform"), F.col("contentId"), F.col("author.username")),
            "author_hash": K.hashed(F.col("author.username"), salt),
            "content_format": K.content_format(F.col("contentType")),
            "video_duration": K.first_video(F.col("media")),
            "posted_at": K.parsed_time(F.col("postedAt")),
            "views": F.coalesce("metrics.views", "metrics.plays", F.lit(0)),
        }
        | {m: F.coalesce(f"metrics.{m}", F.lit(0)) for m in ("likes", "comments", "shares", "saves")}
    )
    rows = rows.withColumns(M.targets(INGEST))
    return rows.withColumn("media", F.transform("media", lambda m: m.withField("url", K.hashed(m["url"], salt)))).drop("author", "metrics")


def feedback_rows(posts: DataFrame, predicted: Column) -> DataFrame:
    """STR-02: own-profile posts with score, error and training priority."""
    actual = M.feedback_score(M.weighted(SCORE), F.col("views"))
    rows = posts.withColumn("actual", actual).withColumn("delta", M.delta(F.col("actual"), predicted))
    return rows.withColumns({"high_priority": M.is_high_priority(F.col("delta")), "priority": M.priority(F.col("delta"), F.col("content_format"), F.col("views"))})


def profile_grid(payloads: DataFrame) -> DataFrame:
    """STR-02: the posts of a profile page, one row each."""
    return payloads.select("platform", F.col("profile.username").alias("username"), F.explode("recentPosts").alias("p")).select("platform", "username", "p.*")


METRIC_SCHEMA = "niche string, target string, samples long, mae double, r2 double, event string"


class Learner(StatefulProcessor):
    """STR-03…07: predict, measure, learn. A normalised least-mean-squares model for each target of a niche.

    State: samples; for each target the weights, and sums of |e|, e², y and y². After ``burn_in`` samples an event row is emitted
    every ``every`` samples, ``retrain`` where the error fell by over 5 % since the last one, else ``steady``; and ``evaluate``
    every ``deep`` samples. With ``bounds`` (STR-05) predictions are clipped to them, and the first one is their middle. Rows
    come in the order of ``seq``, equal ones by their values, batch by batch; no more than a batch of them is in memory.
    """

    def __init__(self, features: list[str], targets: list[str], rate: float = 0.5, burn_in: int = 10, every: int = 15, deep: int = 50, bounds: tuple[float, float] | None = None):
        self.features, self.targets = features, targets
        self.rate, self.burn_in, self.every, self.deep, self.bounds = rate, burn_in, every, deep, bounds

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("model", "samples long, weights array<double>, sums array<double>, last array<double>")

    def _load(self) -> tuple[int, np.ndarray, np.ndarray, np.ndarray]:
        n, k = len(self.features) + 1, len(self.targets)
        if not self.state.exists():
            return 0, np.zeros((k, n)), np.zeros((k, 4)), np.full(k, np.inf)
        samples, weights, sums, last = self.state.get()
        return samples, np.array(weights).reshape(k, n), np.array(sums).reshape(k, 4), np.array(last)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802
        samples, weights, sums, last = self._load()
        out = []
        for x, y in self._samples(rows):
            x = np.append(x, 1.0)
            error = y - weights @ x
            shown = error
            if self.bounds:  # what is shown is clipped; what is learned from is the model's own error
                low, high = self.bounds
                shown = y - (np.clip(y - error, low, high) if samples else np.full(len(y), (low + high) / 2))
            sums += np.stack([np.abs(shown), shown**2, y, y**2], axis=1)
            weights += self.rate * np.outer(error, x) / (1.0 + x @ x)
            samples += 1
            mae = sums[:, 0] / samples
            spread = sums[:, 3] - sums[:, 2] ** 2 / samples
            r2 = np.where(spread > 0, 1 - sums[:, 1] / np.where(spread > 0, spread, 1), 0.0)
            events = []
            if samples >= self.burn_in and samples % self.every == 0:
                events.append("retrain" if np.isfinite(last).all() and mae.mean() < 0.95 * last.mean() else "steady")
                last = mae.copy()
            if samples % self.deep == 0:
                events.append("evaluate")
            out.extend((key[0], t, samples, float(mae[i]), float(r2[i]), e) for e in events for i, t in enumerate(self.targets))
        self.state.update((samples, weights.ravel().tolist(), sums.ravel().tolist(), last.tolist()))
        yield pd.DataFrame(out, columns=["niche", "target", "samples", "mae", "r2", "event"])

    def _samples(self, rows) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        for batch in rows:
            batch = batch.sort_values(["seq", *self.features, *self.targets])
            yield from zip(batch[self.features].to_numpy(float), batch[self.targets].to_numpy(float), strict=True)

    def close(self) -> None:
        pass


def learned(feedback: DataFrame, features: list[str], targets: list[str], **settings) -> DataFrame:
    """Feedback (niche, seq, features, targets) as event rows; rows that lack a feature or a target are left out.

    A stream keeps its niches' models in state and needs the RocksDB state store. A table is learned in blocks, each niche by many
    tasks, with the same results.
    """
    if not feedback.isStreaming:
        return learned_in_blocks(feedback, features, targets, **settings)
    return feedback.na.drop(subset=[*features, *targets]).groupBy("niche").transformWithStateInPandas(Learner(features, targets, **settings), METRIC_SCHEMA, "Append", "None")


def satisfaction_learned(feedback: DataFrame, features: list[str], label: str = "label") -> DataFrame:
    """STR-05: the learner of satisfaction, what a label stands for between 0 and 1; its predictions stay there, 0.5 at first."""
    rows = feedback.withColumn("satisfaction", M.satisfaction(F.col(label)))
    return learned(rows, features, ["satisfaction"], bounds=(0.0, 1.0))


def clipped_satisfaction(prediction: Column) -> Column:
    return F.least(F.greatest(F.coalesce(prediction, F.lit(0.5)), F.lit(0.0)), F.lit(1.0))


class SeenMedia(StatefulProcessor):
    """STR-08 as a stream: an address's state is when it was last kept, and is cleared when its time to live is over."""

    def __init__(self, ttl: pd.Timedelta):
        self.ttl = ttl

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.kept = handle.getValueState("kept", "kept_at timestamp")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802
        out, last = [], pd.Timestamp(self.kept.get()[0]) if self.kept.exists() else None
        for batch in rows:
            for url, at in batch.sort_values("seen_at")[["url", "seen_at"]].itertuples(index=False):
                if last is None or at >= last + self.ttl:
                    out.append((key[0], url, at))
                    last = at
        if out:
            self.kept.update((last.to_pydatetime(),))
            self.handle.registerTimer(int((last + self.ttl).timestamp() * 1000))
        yield pd.DataFrame(out, columns=["url_hash", "url", "seen_at"])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802
        if self.kept.exists() and (pd.Timestamp(self.kept.get()[0]) + self.ttl).timestamp() * 1000 <= expiredTimerInfo.getExpiryTimeInMs():
            self.kept.clear()
        return iter(())

    def close(self) -> None:
        pass


_MEDIA = "url_hash string, url string, seen_at timestamp"


def unseen_media(media: DataFrame, ttl: str = "7 days") -> DataFrame:
    """STR-08: media (url, seen_at) whose address wasn't kept within the time to live before: url_hash, url, seen_at.

    The time to live begins at a kept row and not at each sight, so an address that is seen all the time is kept once in it. Rows
    without an address or time are left out. A stream's state is keyed by the address's hash; rows later than the time to live
    are late. In a table equal sights are one row first, and an address's times then pass a task in order, one at a time.
    """
    span = pd.Timedelta(ttl)
    rows = media.where("url is not null and seen_at is not null").select(F.sha2(F.col("url"), 256).alias("url_hash"), "url", F.col("seen_at").cast("timestamp").alias("seen_at"))
    if media.isStreaming:
        return rows.withWatermark("seen_at", ttl).groupBy("url_hash").transformWithStateInPandas(SeenMedia(span), _MEDIA, "Append", "EventTime")

    def kept(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        name, last = None, None
        for batch in batches:
            keep = []
            for key, at in zip(batch["url_hash"], batch["seen_at"], strict=True):
                fresh = key != name or at >= last + span
                name, last = key, at if fresh else last
                keep.append(fresh)
            yield batch[np.array(keep, bool)]

    return rows.distinct().repartition("url_hash").sortWithinPartitions("url_hash", "seen_at").mapInPandas(kept, _MEDIA)


def hourly_counts(samples: DataFrame, at: str = "posted_at", late: str = "14 days") -> DataFrame:
    """STR-09: partial counts of trends by hour, from which the shares of 48 hours, a week and two weeks are folded."""
    return samples.withWatermark(at, late).groupBy("trend", F.window(at, "1 hour").alias("w")).agg(F.count("*").alias("n"), F.sum("likes").alias("likes")).select("trend", F.col("w.start").alias("hour"), "n", "likes")


def folded(hours: DataFrame, as_of: str) -> DataFrame:
    """STR-09: the shares by age from hourly counts; ages are those of the hour's start."""
    age = (F.unix_timestamp(F.lit(as_of).cast("timestamp")) - F.unix_timestamp(F.col("hour").cast("timestamp"))) / 3600
    part = lambda c: F.coalesce(F.sum(F.when(c, F.col("n"))), F.lit(0)) / F.sum("n")
    return hours.groupBy("trend").agg(F.sum("n").alias("n"), part(age <= 48).alias("pct_last_48h"), part((age > 48) & (age <= 168)).alias("pct_last_week"), part(age > 336).alias("pct_older_2weeks"))


def bandit_counts(feedback: DataFrame) -> DataFrame:
    """STR-10: wins and losses of each variant, in update mode."""
    return feedback.groupBy("experiment", "variant").agg(F.count_if(F.col("score") >= 50).alias("wins"), F.count_if(F.col("score") < 50).alias("losses"))


def late_feedback(published: DataFrame, measured: DataFrame, least: int = 24, most: int = 168) -> DataFrame:
    """STR-11: metrics that arrive ``least`` to ``most`` hours after their content, as a stream-stream interval join."""
    p = published.withWatermark("published_at", f"{most} hours").alias("p")
    m = measured.withWatermark("measured_at", "1 hour").alias("m")
    inside = f"p.content_id = m.content_id and m.measured_at >= p.published_at + interval {least} hours and m.measured_at <= p.published_at + interval {most} hours"
    return p.join(m, F.expr(inside)).select("p.content_id", "p.published_at", "m.measured_at", "m.score")


def status(events: DataFrame) -> DataFrame:
    """STR-12: the latest metrics of each niche and target, and the best so far, from the sink of ``learned``."""
    return events.groupBy("niche", "target").agg(F.max("samples").alias("samples"), F.max_by("mae", "samples").alias("mae"), F.max_by("r2", "samples").alias("r2"), F.min("mae").alias("best_mae"), F.count_if(F.col("event") == "retrain").alias("retrains"))
