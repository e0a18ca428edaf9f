"""Joins of posts, profiles, weights, experiments and vectors, and merges into known tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def training_rows(posts: DataFrame, competitors: DataFrame, businesses: DataFrame, niche: str | None = None) -> DataFrame:
    """JOIN-01/02/11 and SRC-01: posts with their competitor and business; a niche filter reaches the scan of businesses."""
    own = businesses if niche is None else businesses.where(F.col("business_type") == niche)
    return posts.join(competitors, "competitor_id").join(own, "business_id")


def members(rows: DataFrame, ids: DataFrame, on: str) -> DataFrame:
    """JOIN-03: rows whose key is in a list of any length."""
    return rows.join(ids.select(on).distinct(), on, "left_semi")


def enriched(profiles: DataFrame, details: DataFrame, columns: list[str]) -> DataFrame:
    """JOIN-05: newer details by user name, old values where they have none."""
    key = lambda df: df.withColumn("_key", F.lower(F.trim("username")))
    newest = key(details).groupBy("_key").agg(*[F.max_by(c, F.struct(F.col(c).isNotNull(), "seen_at")).alias(f"_{c}") for c in columns])
    made = key(profiles).join(newest, "_key", "left")
    return made.withColumns({c: F.coalesce(f"_{c}", c) for c in columns}).drop("_key", *[f"_{c}" for c in columns])


def own_profile(content: DataFrame, configs: DataFrame, hashed_handle: Column) -> DataFrame:
    """JOIN-06: ``is_own`` where the author's hash is that of the user's configured handle; never for anonymous users."""
    known = configs.where(F.col("own_username").isNotNull()).select("user_id", hashed_handle.alias("_own")).distinct()
    made = content.join(known, "user_id", "left")
    return made.withColumn("is_own", F.coalesce((F.col("_own") == F.col("author_hash")) & F.col("user_id").isNotNull(), F.lit(False))).drop("_own")


def feedback_variants(feedback: DataFrame, variants: DataFrame) -> DataFrame:
    """JOIN-07 and SEQ-04: feedback (content_id, variation_of, label, score) on its experiment's variant; successes score 50 or more.

    A variation's feedback belongs to the original's experiment; without a label it is variant A. Also counted on the global
    experiment by the label in lower case.
    """
    rows = feedback.select(F.coalesce("variation_of", "content_id").alias("experiment"), F.coalesce("label", F.lit("A")).alias("variant"), "score")
    both = rows.union(rows.select(F.lit(-1).cast(rows.schema["experiment"].dataType), F.lower("variant"), "score"))
    counts = both.groupBy("experiment", "variant").agg(F.count_if(F.col("score") >= 50).alias("wins"), F.count_if(F.col("score") < 50).alias("losses"))
    made = variants.join(counts, ["experiment", "variant"], "left")
    more = lambda c: F.coalesce(F.col(c), F.lit(0))
    return made.select("experiment", "variant", (F.col("alpha") + more("wins")).alias("alpha"), (F.col("beta") + more("losses")).alias("beta"))


def experiment_report(variants: DataFrame) -> DataFrame:
    """SEQ-12: posterior means and each experiment's best variant."""
    mean = F.col("alpha") / (F.col("alpha") + F.col("beta"))
    rows = variants.withColumn("mean", mean)
    best = F.max_by("variant", F.struct("mean", F.col("alpha") + F.col("beta"), "variant")).over(Window.partitionBy("experiment"))
    return rows.withColumn("recommended", best)


def thompson(variants: DataFrame, seed: int = 42) -> DataFrame:
    """SEQ-03: one draw of Beta(alpha, beta) for each variant, and the best of each experiment.

    With whole parameters a draw is a ratio of sums of exponentials, made from keyed hashes, so it repeats with the seed.
    """
    uniform = lambda i, side: (F.pmod(F.xxhash64("experiment", "variant", i, F.lit(side), F.lit(seed)), F.lit(1 << 52)) + 0.5) / float(1 << 52)
    gamma = lambda n, side: F.aggregate(F.sequence(F.lit(1), n.cast("int")), F.lit(0.0), lambda s, i: s - F.log(uniform(i, side)))
    rows = variants.withColumns({"_a": gamma(F.col("alpha"), 0), "_b": gamma(F.col("beta"), 1)}).withColumn("draw", F.col("_a") / (F.col("_a") + F.col("_b")))
    return rows.groupBy("experiment").agg(F.max_by("variant", F.struct("draw", "variant")).alias("chosen"), F.max("draw").alias("draw"))


def weights_in_force(users: DataFrame, weights: DataFrame) -> DataFrame:
    """JOIN-09: the active weights of (user, business, niche), where a NULL niche is the general one."""
    on = [users[c].eqNullSafe(weights[c]) for c in ("user_id", "business_id", "niche")]
    return users.join(weights.where("is_active"), on[0] & on[1] & on[2], "left").select(users["*"], *[weights[c] for c in weights.columns if c not in ("user_id", "business_id", "niche")])


def upserted(known: DataFrame, new: DataFrame, keys: list[str], at: str) -> DataFrame:
    """SEQ-07/08: the latest row of each key; ties in time go to the new one."""
    both = known.withColumn("_new", F.lit(0)).unionByName(new.withColumn("_new", F.lit(1)), allowMissingColumns=True)
    place = F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc(at), F.desc("_new")))
    return both.withColumn("_p", place).where("_p = 1").drop("_p", "_new")


def merge_patterns(known: DataFrame, new: DataFrame, matches: DataFrame) -> DataFrame:
    """SEQ-06: matched patterns take 0.7 of the new engagement and one more use, others are inserted.

    Several new patterns on one known are folded in the order of their ids. Examples keep the last ten distinct.
    """
    hits = new.join(matches, new["pattern_id"] == matches["query_id"]).groupBy("known_id").agg(F.array_sort(F.collect_list(F.struct("pattern_id", "engagement", "examples"))).alias("hits"))
    rows = known.join(hits, known["pattern_id"] == hits["known_id"], "left")
    last = lambda xs: F.slice(xs, F.greatest(F.size(xs) - 9, F.lit(1)), 10)
    folded = F.aggregate(F.coalesce("hits", F.expr("cast(array() as array<struct<pattern_id: bigint, engagement: double, examples: array<string>>>)")), F.col("engagement"), lambda s, h: s * 0.3 + h["engagement"] * 0.7)
    used = F.col("usage_count") + F.coalesce(F.size("hits"), F.lit(0))
    examples = last(F.array_distinct(F.concat(F.col("examples"), F.flatten(F.coalesce(F.transform("hits", lambda h: h["examples"]), F.expr("cast(array() as array<array<string>>)"))))))
    old = rows.select("pattern_id", folded.alias("engagement"), F.when(F.col("hits").isNull(), F.col("usage_count")).otherwise(used).alias("usage_count"), F.when(F.col("hits").isNull(), F.col("examples")).otherwise(examples).alias("examples"))
    fresh = new.join(matches, new["pattern_id"] == matches["query_id"], "left_anti").select("pattern_id", "engagement", F.lit(1).cast(known.schema["usage_count"].dataType).alias("usage_count"), "examples")
    return old.unionByName(fresh)
