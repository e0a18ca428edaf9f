"""Exact Jaccard self-join of documents on word shingles by grouped prefixes.

Shingles are ordered rarest first, frequent ones last; two sets as similar as asked share one of the first few, the prefix.
Documents with the same prefix and size are one group, and only groups travel. For each prefix shingle its groups form a
star around the one that shares most of its prefix; star pairs are verified and merged into components, and while many pairs
of different components may be left, further stars around other centres. Then all pairs of groups that share a prefix shingle
and lie in different components are filtered by their prefixes, expanded to members and verified. A pair inside one component
needs no look, so a large group of near copies costs its size and not its square.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm import textkit as kit
from tidemark.llm.components import components
from tidemark.llm.scratch import Scratch, bucket_keys, partitions, with_ids, without_ids

_FIRST = pa.schema([("doc_id", pa.int64()), ("node", pa.int64()), ("size", pa.int64()), ("token", pa.int64()), ("times", pa.int64())])
_PACKED = ("tokens", "gids", "sizes", "reach", "share")
_SECOND = pa.schema([("node", pa.int64()), ("gid", pa.int64()), ("size", pa.int64()), ("prefix", pa.binary()), ("bucket", pa.int32()), *[(c, pa.binary()) for c in _PACKED]])
_SHARED = pa.schema([("token", pa.int64()), ("gid", pa.int64()), ("size", pa.int64()), ("reach", pa.int64()), ("star", pa.int64()), ("share", pa.int32())])
_SECOND_TYPE = "node long, gid long, size long, prefix binary, bucket int, tokens binary, gids binary, sizes binary, reach binary, share binary"
_SHARED_TYPE = "token long, gid long, size long, reach long, star long, share int"
_SALTED = np.uint32(1 << 31)
_ENTRIES = 4_000_000  # prefix shingles in a bucket
_SHARES = [i / 16 for i in range(1, 17)]
_SETS = pa.schema([("node", pa.int64()), ("hashes", pa.binary())])


def _sets(piece: pa.RecordBatch, words: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Each row's node (a hash of its word sequence; 0 without words), and the rows and hashes of its distinct shingles."""
    data, bounds = kit.utf8(piece.column("text"))
    data = kit.lower_ascii(data)
    begin, end, first = kit.words(data, bounds)
    hashes = kit.window_hash(kit.prefix_sums(data), begin, end)
    up, down = kit._Powers.get(len(hashes) + 1)
    sums = np.zeros(len(hashes) + 1, np.uint64)
    np.cumsum(hashes * up[: len(hashes)], out=sums[1:])
    node = kit.mix((sums[first[1:]] - sums[first[:-1]]) * down[first[:-1]] + np.uint64(1))
    node[first[1:] == first[:-1]] = 0
    return node, *kit.distinct_by_row(*kit.shingles(hashes, first, words))


def _signed(x: np.ndarray) -> pa.Array:
    return pa.array(x.view(np.int64))


def _first_pass(words: int, often: int):
    """A row for each document, and one for each shingle that a task meets in ``often`` different texts or more."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []
        met: set[int] = set()
        n_held = 0

        def frequent() -> pa.RecordBatch:
            token, times = np.unique(np.concatenate(held), return_counts=True)
            token, times = token[times >= often], times[times >= often]
            none = pa.nulls(len(token), pa.int64())
            return pa.RecordBatch.from_arrays([none, none, none, _signed(token), pa.array(times.astype(np.int64))], schema=_FIRST)

        for batch in batches:
            for piece in kit.text_slices(batch, "text"):
                node, rows, hashes = _sets(piece, words)
                size = np.bincount(rows, minlength=piece.num_rows).astype(np.int64)
                none = pa.nulls(piece.num_rows, pa.int64())
                yield pa.RecordBatch.from_arrays([piece.column("doc_id"), _signed(node), pa.array(size), none, none], schema=_FIRST)
                fresh = np.array([not (x in met or met.add(x)) for x in node.tolist()], bool)
                held.append(hashes[fresh[rows]])
                n_held += len(held[-1])
                if n_held > 3_000_000:
                    yield frequent()
                    held, n_held = [], 0
                    met.clear()
        if n_held:
            yield frequent()

    return run


def _second_pass(words: int, keys: list[int], heavy: np.ndarray, heavy_times: np.ndarray, salted: int):
    """A row for each document's group, and for each bucket the prefix shingles and groups of a slice, packed."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in kit.text_slices(batch, "text"):
                node, rows, hashes = _sets(piece, words)
                if not len(rows):
                    continue
                times, at = np.zeros(len(hashes), np.int64), np.zeros(len(hashes), np.int64)
                if len(heavy):
                    at = np.minimum(np.searchsorted(heavy, hashes), len(heavy) - 1)
                    times = np.where(heavy[at] == hashes, heavy_times[at], 0)
                order = np.lexsort((hashes, times, rows))
                hashes, times, at = hashes[order], times[order], at[order]
                size = np.bincount(rows, minlength=piece.num_rows)
                start = np.concatenate([[0], np.cumsum(size)])
                place = np.arange(len(rows)) - start[rows]
                n = size[rows]
                probing = place < n - (3 * n + 3) // 4 + 1
                rows, hashes, times, at, place, n = rows[probing], hashes[probing], times[probing], at[probing], place[probing], n[probing]
                # The largest set with which this could be the first shared shingle: 7 * (n - place) >= 3 * (n + other).
                reach = ((7 * (n - place) - 3 * n) // 3).astype(np.uint32)
                there, begins = np.unique(rows, return_index=True)
                gid = np.zeros(piece.num_rows, np.uint64)
                gid[there] = kit.mix(np.add.reduceat(kit.mix(hashes), begins) + size[there].astype(np.uint64) * np.uint64(0x9E37))
                short = (hashes >> np.uint64(32)).astype(np.uint32)
                prefix = [np.unique(x).tobytes() for x in np.split(short, begins[1:])]
                none = [pa.nulls(len(there), f.type) for f in list(_SECOND)[4:]]
                yield pa.RecordBatch.from_arrays([_signed(node[there]), _signed(gid[there]), pa.array(size[there].astype(np.int64)), pa.array(prefix, pa.binary()), *none], schema=_SECOND)
                # How much of a prefix other texts have too, of 255: the less a near copy was edited, the more.
                share = (255 * np.add.reduceat((times > 0).astype(np.int64), begins) // np.diff([*begins, len(rows)])).astype(np.uint8)
                share = np.repeat(share, np.diff([*begins, len(rows)]))
                # A very frequent shingle is dealt to several buckets by group, each with a star of its own. Its token is its
                # place among the frequent ones, marked by the highest bit, so that it is one in all buckets.
                groups = gid[rows]
                salts = np.maximum(1, times // salted).astype(np.uint64)
                salt = groups % salts
                spread = kit.mix(hashes + salt * np.uint64(0xC2B2AE3D27D4EB4F))
                bucket = np.array(keys, np.int32)[(spread % np.uint64(len(keys))).astype(np.int64)]
                token = np.where(salts > 1, at.astype(np.uint32) | _SALTED, short >> np.uint32(1))
                by = np.argsort(bucket, kind="stable")
                which, cuts = np.unique(bucket[by], return_index=True)
                ends = kit.ends(cuts, len(by))
                nothing = [pa.nulls(len(which), f.type) for f in list(_SECOND)[:4]]
                columns = [x[by] for x in (token, groups, n.astype(np.uint32), reach, share)]
                cut = lambda x: pa.array([x[a:b].tobytes() for a, b in zip(cuts, ends, strict=True)], pa.binary())  # noqa: B023, E731
                yield pa.RecordBatch.from_arrays([*nothing, pa.array(which), *[cut(x) for x in columns]], schema=_SECOND)

    return run


def _shared_shingles(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of each bucket the prefix shingles that several groups share, and the group at the centre of each shingle's star.

    The centre is the group that shares most of its prefix, as its text is likely the one that the others were made from. Groups
    whose first shared shingle this can't be with any other are left out. Shingles that are dealt to several buckets have names
    below 0, and all their groups are kept.
    """
    held: dict[int, list[tuple[bytes, ...]]] = {}
    for batch in batches:
        for bucket, *parts in zip(*[batch.column(c).to_pylist() for c in ("bucket", *_PACKED)], strict=True):
            held.setdefault(bucket, []).append(tuple(parts))
    for bucket in list(held):
        parts = held.pop(bucket)
        columns = [np.frombuffer(b"".join(p[i] for p in parts), t) for i, t in enumerate((np.uint32, np.int64, np.uint32, np.uint32, np.uint8))]
        order = np.lexsort((columns[1], columns[0]))
        token, gid, size, reach, share = (x[order] for x in columns)
        new = np.ones(len(token), bool)
        new[1:] = (token[1:] != token[:-1]) | (gid[1:] != gid[:-1])
        for wanted in (new, None):
            if wanted is None:
                first = np.flatnonzero(np.concatenate([[True], token[1:] != token[:-1]]))
                count = np.diff([*first, len(token)])
                smallest, farthest = (np.repeat(f.reduceat(x, first), count) for f, x in ((np.minimum, size), (np.maximum, reach)))
                wanted = (token >= _SALTED) | ((np.repeat(count, count) > 1) & (reach >= smallest) & (size <= farthest))
            token, gid, size, reach, share = (x[wanted] for x in (token, gid, size, reach, share))
            if not len(token):
                break
        if not len(token):
            continue
        first = np.flatnonzero(np.concatenate([[True], token[1:] != token[:-1]]))
        count = np.diff([*first, len(token)])
        best = np.lexsort((gid, -share.astype(np.int64), token))[first]
        centre = np.repeat(best, count)
        star = gid[centre]
        near = (gid == star) | ((size <= reach[centre]) & (size[centre] <= reach))
        salted = token >= _SALTED
        keep = salted | (np.repeat(count, count) > 1)
        name = np.where(salted, -1 - (token & ~_SALTED).astype(np.int64), (np.int64(bucket) << np.int64(32)) | token.astype(np.int64))
        columns = [name, gid, size.astype(np.int64), reach.astype(np.int64)]
        yield pa.RecordBatch.from_arrays([*[pa.array(x[keep]) for x in columns], pa.array(star[keep], mask=~near[keep]), pa.array(share[keep].astype(np.int32))], schema=_SHARED)


def _make_sets(words: int):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in kit.text_slices(batch, "text"):
                node, rows, hashes = _sets(piece, words)
                ends = np.searchsorted(rows, np.arange(1, piece.num_rows + 1))
                starts = np.concatenate([[0], ends[:-1]])
                packed = [hashes[a:b].tobytes() for a, b in zip(starts, ends, strict=True)]
                yield pa.RecordBatch.from_arrays([_signed(node), pa.array(packed, pa.binary())], schema=_SETS)

    return run


def _overlaps(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of pairs with both sets, those as similar as asked: 7 * shared >= 3 * (sizes), which is a Jaccard index of 0.75."""
    for batch in batches:
        keep = []
        for x, y in zip(batch.column("x").to_pylist(), batch.column("y").to_pylist(), strict=True):
            x, y = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
            shared = len(np.intersect1d(x, y, assume_unique=True))
            keep.append(7 * shared >= 3 * (len(x) + len(y)))
        yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))


def _promising(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pairs whose prefixes share enough: what a pair lacks there the rest of the set whose prefix ends first must hold.

    Prefixes are compared by 32 bits a shingle; one is allowed for two shingles of a prefix that look equal.
    """
    for batch in batches:
        keep = []
        for x, y, n, m in zip(*[batch.column(c).to_pylist() for c in ("x", "y", "n", "m")], strict=True):
            shared = len(np.intersect1d(np.frombuffer(x, np.uint32), np.frombuffer(y, np.uint32), assume_unique=True))
            rest = max((3 * n + 3) // 4 - 1, (3 * m + 3) // 4 - 1)
            keep.append(7 * (shared + 1 + rest) >= 3 * (n + m))
        yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))


def _verified(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    with_x = pairs.join(sets.select(F.col("node").alias("a"), F.col("hashes").alias("x")), "a")
    with_y = with_x.join(sets.select(F.col("node").alias("b"), F.col("hashes").alias("y")), "b")
    return with_y.select("a", "b", "x", "y").mapInArrow(_overlaps, "a long, b long")


class _Join:
    """Groups of equal prefix and size, their members, and the links found so far."""

    def __init__(self, texts: DataFrame, words: int, scratch: Scratch, members: DataFrame, nodes: DataFrame):
        self.texts, self.words, self.scratch, self.members, self.nodes = texts, words, scratch, members, nodes
        self.groups = scratch.save(members.groupBy("gid").agg(F.min("node").alias("head"), F.first("size").alias("size"), F.first("prefix").alias("prefix"), F.count("*").alias("n")))
        self.links = self.found = None

    def promising(self, pairs: DataFrame) -> DataFrame:
        """Of pairs of different groups (a, b) those whose sizes and prefixes allow a link."""
        ends = lambda gid, prefix, size: self.groups.select(F.col("gid").alias(gid), F.col("prefix").alias(prefix), F.col("size").alias(size))
        both = pairs.join(ends("a", "x", "n"), "a").join(ends("b", "y", "m"), "b").where("4 * least(n, m) >= 3 * greatest(n, m)")
        return self.scratch.save(both.select("a", "b", "x", "y", "n", "m").mapInArrow(_promising, "a long, b long"))

    def verify(self, pairs: DataFrame) -> int:
        """Link those of the pairs of nodes (a, b) that are as similar as asked, by their whole texts; say how many merges there are by now."""
        scratch = self.scratch
        pairs = scratch.save(pairs)
        asked = pairs.select(F.col("a").alias("node")).union(pairs.select("b")).distinct()
        wanted = scratch.save(self.nodes.where("doc_id is not null").join(asked, "node", "left_semi").select("doc_id", F.col("node").alias("wanted")))
        chosen = with_ids(self.texts, wanted, "doc_id").select("text", "wanted")
        nameless = self.texts.where("doc_id is null").select("text", F.lit(None).cast("long").alias("wanted"))
        sets = scratch.save(chosen.union(nameless).mapInArrow(_make_sets(self.words), "node long, hashes binary").dropDuplicates(["node"]))
        links = scratch.save(_verified(pairs, sets))
        scratch.drop(sets, wanted, pairs)
        before = self.links
        self.links = links if before is None else scratch.save(before.union(links))
        found = scratch.save(components(self.links, scratch))
        scratch.drop(*[t for t in (self.found, before, links if before is not None else None) if t is not None])
        self.found = found
        return found.count() - found.select("component").distinct().count()

    def placed(self) -> DataFrame:
        """The members with their components: gid, node, component."""
        named = self.members.select("gid", "node").join(self.found, "node", "left")
        return named.select("gid", "node", F.coalesce("component", "node").alias("component"))


def classes(docs: DataFrame, words: int = 5, heaviest: int = 200_000, often: int = 2, salted: int = 20_000, most_rounds: int = 6) -> DataFrame:
    """Link documents whose sets of ``words``-word shingles have a Jaccard index of 0.75 or more, and name their components.

    Words are runs without ASCII white space with A-Z in lower case; fewer words make one shingle. Returns a row for each row
    of ``docs`` (doc_id, text): doc_id, n_shingles, component_id, the smallest doc_id that links reach. Texts without words, and
    null ones, have size 0 and no links. A null doc_id names no component; if all linked ids are null, so is component_id.
    Repeated rows are copies; rows of one doc_id with different texts are linked only by their texts. Other columns are not read.

    Word sequences and shingles are compared by 64-bit hashes. ``heaviest`` bounds the table of frequent shingles that every
    task gets; it steers only the order, so results don't depend on it, nor on ``often``, ``salted`` and ``most_rounds``.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "jaccard")
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    first = scratch.save(texts.mapInArrow(_first_pass(words, often), "doc_id long, node long, size long, token long, times long"))
    rows = first.where("token is null").select("doc_id", "node", "size")
    heavy = first.where("token is not null").groupBy("token").agg(F.sum("times").alias("times")).where("times >= 4")
    heavy = heavy.orderBy(F.desc("times"), "token").limit(heaviest).toPandas()
    token = heavy["token"].to_numpy(np.int64).view(np.uint64)
    order = np.argsort(token)
    token, times = token[order], heavy["times"].to_numpy(np.int64)[order]
    nodes = scratch.save(rows.where("size > 0").groupBy("node").agg(F.min("doc_id").alias("doc_id"), F.count("*").alias("n")))

    entries = rows.agg(F.sum(F.expr("size div 4 + 1"))).first()[0] or 0
    keys = bucket_keys(spark, max(partitions(spark), -(-entries // _ENTRIES)))
    second = scratch.save(texts.mapInArrow(_second_pass(words, keys, token, times, salted), _SECOND_TYPE))
    members = scratch.save(second.where("bucket is null").select("gid", "node", "size", "prefix").dropDuplicates(["node"]))
    dealt = second.where("bucket is not null").select("bucket", *_PACKED).repartition(len(keys), "bucket")
    shared = scratch.save(dealt.mapInArrow(_shared_shingles, _SHARED_TYPE))
    scratch.drop(second)
    work = _Join(texts, words, scratch, members, nodes)
    groups = work.groups
    least_most = lambda x, y: [F.least(x, y).alias("a"), F.greatest(x, y).alias("b")]
    heads = lambda pairs: (
        pairs.join(groups.select(F.col("gid").alias("a"), F.col("head").alias("x")), "a").join(groups.select(F.col("gid").alias("b"), F.col("head").alias("y")), "b").select(*least_most("x", "y"))
    )

    # Stars: a group's members around its head, groups around the centre of each shingle that they share. The stars of a shingle
    # that was dealt to several buckets are themselves a star around the best of them.
    several = groups.where("n > 1").select("gid", "head")
    inside = members.select("gid", "node").join(several, "gid").where("node <> head").select(*least_most("head", "node"))
    centres = shared.where("token < 0 and gid = star").select("token", "star", "share")
    best = centres.groupBy("token").agg(F.max_by("star", F.struct("share", "star")).alias("centre"))
    hubs = centres.join(best, "token").select(F.col("star").alias("gid"), F.col("centre").alias("star"))
    rays = shared.where("star is not null").select("gid", "star").union(hubs).where("gid <> star").select(*least_most("gid", "star")).distinct()
    linked = work.verify(inside.union(heads(work.promising(rays))).distinct())

    # What is left are pairs of groups with a prefix shingle in common and members in different components. While they may be
    # many, the groups meet more and more centres, drawn anew in each round.
    n_shared = shared.count()
    for round_ in range(1, most_rounds + 1):
        spans = scratch.save(work.placed().groupBy("gid").agg(F.min("component").alias("low"), F.max("component").alias("high")))
        open_ = shared.select("token", "gid", "size", "reach").join(spans, "gid")
        mixed = open_.groupBy("token").agg(F.min("low").alias("least"), F.max("high").alias("most")).where("least <> most").select("token")
        open_ = scratch.save(open_.join(mixed, "token"))
        largest = open_.groupBy("token", "low").agg(F.count("*").alias("n")).groupBy("token").agg(F.max_by("low", F.struct("n", "low")).alias("largest"), F.sum("n").alias("there"))
        ranges = open_.groupBy("token").agg(F.percentile_approx("size", _SHARES, 100).alias("sizes"), F.percentile_approx("reach", _SHARES, 100).alias("reaches"))
        counted = open_.join(scratch.save(largest.join(ranges, "token")), "token").withColumn("minor", F.expr("low <> high or low <> largest"))
        counted = scratch.save(counted)
        partners = "there * least(size(filter(sizes, x -> x <= reach)), size(filter(reaches, x -> x >= size))) / size(sizes)"
        ahead = counted.where("minor").agg(F.sum(F.expr(partners))).first()[0] or 0
        if ahead <= 2 * n_shared or round_ == most_rounds:
            break
        place = F.row_number().over(Window.partitionBy("token").orderBy(F.xxhash64("gid", F.lit(round_)), "gid"))
        some = open_.withColumn("place", place).where(F.col("place") <= 2 ** (round_ + 1)).select("token", *[F.col(c).alias(f"c_{c}") for c in ("gid", "size", "reach", "low")])
        met = open_.join(some, "token").where("gid <> c_gid and low <> c_low and size <= c_reach and c_size <= reach")
        now = work.verify(heads(work.promising(met.select(*least_most("gid", "c_gid")).distinct())))
        if now == linked:  # nothing merged, so what is counted still holds
            break
        scratch.drop(spans, open_, counted)
        linked = now

    # All that can still be linked: pairs of groups that aren't wholly of one component, for which the shingle can be the first
    # shared one. One of the two is outside the shingle's largest component, so that one is never joined with itself.
    minor = counted.where("minor").select("token", *[F.col(c).alias(f"m_{c}") for c in ("gid", "size", "reach", "low", "high")])
    apart = "not (low = high and m_low = m_high and low = m_low) and size <= m_reach and m_size <= reach"
    rest = counted.join(minor, "token").where(apart).where("not minor or gid <= m_gid").select(*least_most("gid", "m_gid")).distinct()
    rest = work.promising(rest)
    placed = scratch.save(work.placed())
    member = lambda gid, node, component: placed.select(F.col("gid").alias(gid), F.col("node").alias(node), F.col("component").alias(component))
    expanded = rest.join(member("a", "x", "cx"), "a").join(member("b", "y", "cy"), "b").where("cx <> cy")
    work.verify(expanded.select(*least_most("x", "y")).distinct())

    # The smallest doc_id of each component, for its nodes and then its rows. Written first, so that the joins' own shuffles
    # can be split where a node or component is frequent.
    named = scratch.save(nodes.join(work.found, "node", "left").select("node", "doc_id", F.coalesce("component", "node").alias("component")))
    smallest = scratch.save(named.groupBy("component").agg(F.min("doc_id").alias("component_id")))
    named = scratch.save(named.select("node", "component").join(smallest, "component").select("node", "component_id"))
    linked = rows.where("size > 0").join(named, "node").select("doc_id", F.col("size").alias("n_shingles"), "component_id")
    alone = rows.where("size = 0").select("doc_id", F.lit(0).cast("long").alias("n_shingles"), F.col("doc_id").alias("component_id"))
    return linked.unionByName(alone)


def keep_first(docs: DataFrame, words: int = 5) -> DataFrame:
    """``docs``, all columns, with one document of each component, the one of the smallest doc_id.

    Documents without words and those without a doc_id stay; rows that repeat a doc_id stay or go together.
    """
    later = classes(docs, words).where("doc_id <> component_id").select("doc_id").distinct()
    return without_ids(docs, Scratch(docs.sparkSession, "jaccard").save(later), "doc_id")
