"""Balanced label propagation: documents of equal text gather in one shard while shards stay even in rows."""

from __future__ import annotations

from itertools import accumulate

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.ranking import ranked
from tidemark.llm.scratch import Scratch

#: What equal texts share: two checksums and the size.
_GROUP = ["link", "text_crc32", "size"]


def _numbers(values: list[int]) -> Column:
    return F.array(*[F.lit(int(v)).cast("long") for v in values])


def _seat(rank: str, free: list[int]) -> Column:
    """The shard of the seat of this number, where the shards' free seats are numbered one after the other; null beyond them."""
    bounds = list(accumulate(free))
    place = F.size(F.filter(_numbers(bounds), lambda b: b < F.col(rank))).cast("int")
    return F.when(F.col(rank) <= bounds[-1], place)


def _in_shards(df: DataFrame, shard: str, weight: Column, shards: int) -> list[int]:
    """The sum of ``weight`` in each shard."""
    sums = {r[0]: r[1] for r in df.where(F.col(shard).isNotNull()).groupBy(shard).agg(F.sum(weight)).collect()}
    return [sums.get(s, 0) for s in range(shards)]


def _settle_large(groups: list, free: list[int]) -> list[tuple]:
    """Shards for large groups: as many whole ones as each fills, then, largest first, the one with most of it for what is left.

    Takes seats from ``free``; returns (the group's key, its shards, running sums of its seats there).
    """
    taken: set[int] = set()
    homes: list[list[tuple[int, int]]] = [[] for _ in groups]
    rest = [g["members"] for g in groups]
    for i in sorted(range(len(groups)), key=lambda i: (-rest[i], groups[i]["link"])):
        held = {h["shard"]: h["n"] for h in groups[i]["held"]}
        for s in sorted(range(len(free)), key=lambda s: (-held.get(s, 0), s)):
            if s not in taken and 0 < free[s] <= rest[i]:
                taken.add(s)
                homes[i].append((s, free[s]))
                rest[i] -= free[s]
                free[s] = 0
    for i in sorted(range(len(groups)), key=lambda i: (-rest[i], groups[i]["link"])):
        held = {h["shard"]: h["n"] for h in groups[i]["held"]}
        roomy = [s for s in range(len(free)) if free[s] >= rest[i] > 0]
        if roomy:
            s = max(roomy, key=lambda s: (held.get(s, 0), -s))
            homes[i].append((s, rest[i]))
            free[s] -= rest[i]
    places = [([s for s, _ in h], list(accumulate(n for _, n in h))) for h in homes]
    return [(*[g[c] for c in _GROUP], *place) for g, place in zip(groups, places, strict=True)]


def _wish(free: list[int], round_: int) -> Column:
    """The shard that a group asks for: in odd rounds the one with most of its members of those with room for all, else one drawn by free seats."""
    room = _numbers(free)
    mine = F.filter("held", lambda h: F.element_at(room, h["shard"] + 1) >= F.col("members"))
    most = F.array_max(F.transform(mine, lambda h: F.struct(h["n"].alias("n"), F.xxhash64("link", h["shard"]).alias("by"), h["shard"].alias("shard"))))["shard"]
    ticket = F.pmod(F.xxhash64("link", F.lit(round_)), F.lit(max(1, sum(free)))) + 1
    drawn = F.size(F.filter(_numbers(list(accumulate(free))), lambda b: b < ticket)).cast("int")
    return F.coalesce(most, drawn) if round_ % 2 else drawn


def shard(docs: DataFrame, shards: int = 40, most_rounds: int = 40) -> DataFrame:
    """Deal all rows of ``docs`` (doc_id, text) into ``shards`` shards whose row counts differ by one at most.

    Documents start in a shard drawn by hash. Groups of equal texts over a sixteenth of a quota choose first: each gets as many
    whole shards as it fills, and one more for the rest. In each round the other groups ask for the shard with most of their members, or, as that
    may be full, for one drawn by free seats; a shard takes whole groups, large ones first, while it has seats. Rounds end when
    two of them settle no group; the bound on them only ends the search. Groups that found no shard are then seated one after the
    other, so that few are cut; documents without equals stay where seats are left, and the rest fill what is free.

    Null texts count as empty and equal to empty ones; rows with a null doc_id and repeated rows are dealt like any other; other
    columns are not read; an empty table gives no rows. Returns doc_id, size, text_crc32, law, shard, slot, grown_shard.
    """
    scratch = Scratch(docs.sparkSession, "sharding")
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    state = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        (F.octet_length(text) + 16).cast("long").alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"),
        F.xxhash64(text).alias("link"),
    )
    state = scratch.save(state.withColumn("start", F.pmod(F.xxhash64("doc_id", "link"), F.lit(shards)).cast("int")))
    total = state.count()
    free = [total // shards + (s < total % shards) for s in range(shards)]
    # A group is a row with its counts in the shards, of which there are ``shards`` at most.
    held = state.groupBy(*_GROUP, "start").agg(F.count("*").alias("n"))
    groups = held.groupBy(*_GROUP).agg(
        F.sum("n").alias("members"), F.collect_list(F.struct("n", F.col("start").alias("shard"))).alias("held")
    )
    groups = scratch.save(groups.where("members > 1"))
    # Fewer than 16 groups to a shard are larger than a sixteenth of a quota.
    large = F.col("members") > total // (16 * shards)
    homes = _settle_large(groups.where(large).collect(), free)
    key = "link long, text_crc32 long, size long"
    homes = docs.sparkSession.createDataFrame(homes, f"{key}, homes array<int>, ends array<long>")

    settled, waiting, idle = None, scratch.save(groups.where(~large)), 0
    for round_ in range(1, most_rounds + 1):
        asking = waiting.withColumn("want", _wish(free, round_))
        asking = ranked(asking, "want", [-F.col("members"), *[F.col(c) for c in _GROUP]], scratch, weight="members")
        fits = F.col("rank") <= F.element_at(_numbers(free), F.col("want") + 1)
        asking = scratch.save(asking.withColumn("shard", F.when(fits, F.col("want"))).drop("want", "rank"))
        taken = _in_shards(asking, "shard", F.col("members"), shards)
        free = [f - t for f, t in zip(free, taken, strict=True)]
        found = asking.where("shard is not null")
        settled = found if settled is None else settled.unionByName(found)
        waiting = asking.where("shard is null").drop("shard")
        idle = 0 if sum(taken) else idle + 1
        if idle == 2 or waiting.isEmpty():
            break

    # Joined by group and first shard, so that a large group is as many keys as it has shards.
    known = settled.unionByName(waiting.withColumn("shard", F.lit(None).cast("int")))
    known = known.select(*_GROUP, F.explode("held.shard").alias("start"), "shard", F.lit(True).alias("linked"))
    whole = state.join(F.broadcast(homes), _GROUP, "left")
    hot = ranked(whole.where("homes is not null"), "link", [F.col("doc_id")], scratch)
    place = F.size(F.filter("ends", lambda e: e < F.col("rank")))
    hot = hot.withColumn("shard", F.get("homes", place)).withColumn("linked", F.lit(True))
    rest = whole.where("homes is null").join(known, [*_GROUP, "start"], "left")
    columns = ["doc_id", *_GROUP, "start", "shard", "linked"]
    seated = scratch.save(rest.select(*columns).unionByName(hot.select(*columns)))

    order = [F.col("link"), F.col("doc_id")]
    everyone = lambda df: ranked(df.drop("shard").withColumn("all", F.lit(0)), "all", order, scratch)
    taken = _in_shards(seated, "shard", F.lit(1), shards)
    free = [total // shards + (s < total % shards) - t for s, t in enumerate(taken)]
    parted = scratch.save(everyone(seated.where("linked and shard is null")).withColumn("shard", _seat("rank", free)))
    free = [f - t for f, t in zip(free, _in_shards(parted, "shard", F.lit(1), shards), strict=True)]
    single = ranked(seated.where("linked is null").drop("shard"), "start", order, scratch)
    stays = F.col("rank") <= F.element_at(_numbers(free), F.col("start") + 1)
    single = scratch.save(single.withColumn("shard", F.when(stays, F.col("start"))).drop("rank"))
    free = [f - t for f, t in zip(free, _in_shards(single, "shard", F.lit(1), shards), strict=True)]
    spare = everyone(single.where("shard is null")).withColumn("shard", _seat("rank", free))

    columns = ["doc_id", "size", "text_crc32", "link", "shard"]
    final = seated.where("shard is not null").select(*columns)
    for part in (parted, single.where("shard is not null"), spare):
        final = final.unionByName(part.select(*columns))
    final = ranked(final, "shard", [F.col("doc_id"), F.col("link")], scratch)
    return final.select(
        "doc_id",
        "size",
        "text_crc32",
        F.lit("rows").alias("law"),
        "shard",
        (F.col("rank") - 1).cast("long").alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"),
    )
