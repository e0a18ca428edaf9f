"""How the sources of a language differ in their words: divergence of each pair of sources, and each source's own terms.

Sources of a language are compared by sorted arrays (term id, price of its count). A task for a pair of batches of sources
gets the arrays of both, cut into blocks of term ids, and prices each unordered pair once: the shorter array gallops through the
longer for the overlap, what only one side has meets the other's price of an absent term, and the terms that neither has are
counted, not listed. Both directions of a pair are made of the one sum.
"""

from __future__ import annotations

import re
from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.ranking import ranked
from tidemark.llm.scratch import Scratch
from tidemark.llm.textkit import text_slices

_LOWER = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")
_TERM = re.compile(rb"[a-z\x80-\xff]+")  # as UTF-8: ASCII letters and all that isn't ASCII
_BREAK = re.compile(rb"[^a-z\x80-\xff]")
_PIECE = 1 << 20  # bytes of a text whose terms are listed at once
_HELD = 200_000  # counts that a task holds before it hands them on
_COUNTED = pa.schema([("lang", pa.string()), ("source", pa.string()), ("term", pa.string()), ("n", pa.int64()), ("docs", pa.int64())])
_SCALE = 1_000_000_000


def _terms(text: bytes) -> Iterator[list[bytes]]:
    """The terms of a text in order, piece by piece."""
    text, begin = text.translate(_LOWER), 0
    while begin < len(text):
        cut = _BREAK.search(text, begin + _PIECE)
        end = cut.start() if cut else len(text)
        yield _TERM.findall(text, begin, end)
        begin = end


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Counts by group and term, summed over the rows that a task has met since it last handed them on."""
    held: dict[tuple[str, str], tuple[Counter, Counter]] = defaultdict(lambda: (Counter(), Counter()))

    def handed_on() -> Iterator[pa.RecordBatch]:
        for (lang, source), (times, docs) in held.items():
            terms = pa.array(times.keys(), pa.binary()).cast(pa.string())
            columns = [pa.repeat(pa.scalar(lang), len(times)), pa.repeat(pa.scalar(source), len(times)), terms, pa.array(times.values(), pa.int64()), pa.array(map(docs.__getitem__, times), pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, schema=_COUNTED)
        held.clear()

    for batch in batches:
        for piece in text_slices(batch, "text"):
            for lang, source, text in zip(piece.column("lang").to_pylist(), piece.column("source").to_pylist(), piece.column("text").cast(pa.binary()).to_pylist(), strict=True):
                times, docs = held[lang, source]
                there: set[bytes] = set()
                for found in _terms(text):
                    times.update(found)
                    there.update(found)
                docs.update(there)
            if sum(len(times) for times, _ in held.values()) > _HELD:
                yield from handed_on()
    yield from handed_on()


def _price(count: str, total: str) -> Column:
    """1 + floor(10^9 * (count + 5) / (total + 5 * terms)), exactly."""
    whole = lambda c: f"cast({c} AS decimal(19, 0))"
    return F.expr(f"1 + ({whole(_SCALE)} * ({whole(count)} + 5)) div ({whole(total)} + 5 * {whole('terms')})").cast("long")


def _differ(ids: np.ndarray, prices: np.ndarray, absent: int, other_ids: np.ndarray, other_prices: np.ndarray, other_absent: int, size: int) -> int:
    """Sum of absolute differences of two groups' prices over ``size`` terms; what an array lacks has the group's price of absence."""
    if len(ids) > len(other_ids):
        ids, prices, absent, other_ids, other_prices, other_absent = other_ids, other_prices, other_absent, ids, prices, absent
    place = np.searchsorted(other_ids, ids)  # sorted keys: each goes on from where the last was found
    met = place < len(other_ids)
    met[met] = other_ids[place[met]] == ids[met]
    partner = place[met]
    overlap = np.abs(prices[met] - other_prices[partner]).sum()
    mine = np.abs(prices[~met] - other_absent).sum()
    theirs = np.abs(other_prices - absent).sum() - np.abs(other_prices[partner] - absent).sum()
    neither = size - len(ids) - len(other_ids) + len(partner)
    return int(overlap + mine + theirs + neither * abs(absent - other_absent))


_PAIRS = "lang string, a string, b string, value long"


def _pair_task(key: tuple, left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
    """Every unordered pair of a source of the one batch and a source of the other, over one block of terms."""
    lang, _, one, other = key
    arrays = lambda side: [(s, np.asarray(i, np.int64), np.asarray(p, np.int64), int(a), int(n)) for s, i, p, a, n in zip(*(side[c] for c in ("source", "ids", "prices", "absent", "size")), strict=True)]
    rows, theirs = [], arrays(right)
    for a, ids, prices, absent, size in arrays(left):
        for b, other_ids, other_prices, other_absent, _ in theirs:
            if one != other or a < b:
                rows.append((lang, a, b, _differ(ids, prices, absent, other_ids, other_prices, other_absent, size)))
    return pd.DataFrame(rows, columns=["lang", "a", "b", "value"])


def _first(df: DataFrame) -> DataFrame:
    order = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    return df.withColumn("rank", F.row_number().over(order))


def divergence(docs: DataFrame, least_docs: int = 30, own_terms: int = 50, block: int = 32_768, batch: int = 16) -> DataFrame:
    """Compare the sources of each language of ``docs`` (lang, source, text) by smoothed shares of terms.

    Terms are runs of ASCII letters, A-Z in lower case, and of all characters beyond ASCII; a language keeps those in
    ``least_docs`` of its documents. A group, (lang, source), and a language give each kept term p = 1 + floor(10^9 * (count + 5) /
    (N + 5 * V)), N being the counts' sum and V the number of kept terms; all in whole numbers. Returns lang, source, part, item,
    value and rank: part ``pair`` has each other source of the language with the sum of the differences over all kept terms, 0
    without any; part ``term`` the first ``own_terms`` of the group's terms that are likelier in it than in its language, with the
    difference. Largest value first, ties to the smaller item by its UTF-8 bytes.

    Nulls are empty texts, and names of their own; groups without terms take part in pairs; a repeated row is a document. Other
    columns are not read; an empty table gives no rows. ``block`` terms of ``batch`` sources, on each side, are what a pair task holds.
    """
    scratch = Scratch(docs.sparkSession, "divergence")
    rows = docs.select(*[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("lang", "source", "text")])
    counted = rows.mapInArrow(_count, "lang string, source string, term string, n long, docs long")
    counted = scratch.save(counted.groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs")))
    kept = counted.groupBy("lang", "term").agg(F.sum("n").alias("lang_n"), F.sum("docs").alias("docs")).where(F.col("docs") >= least_docs)
    kept = scratch.save(ranked(kept.drop("docs"), "lang", [F.col("term")], scratch, "id"))
    held = scratch.save(counted.join(kept, ["lang", "term"]).select("lang", "source", "term", "id", "n", "lang_n"))

    groups = scratch.save(rows.select("lang", "source").distinct())
    langs = kept.groupBy("lang").agg(F.count("*").alias("terms"), F.sum("lang_n").alias("lang_total"))
    totals = held.groupBy("lang", "source").agg(F.sum("n").alias("total"))
    batches = groups.groupBy("lang").agg(F.ceil(F.count("*") / batch).cast("int").alias("batches"))
    known = groups.join(langs, "lang", "left").join(totals, ["lang", "source"], "left").join(batches, "lang").na.fill(0, ["terms", "lang_total", "total"])
    known = scratch.save(known.withColumn("batch", F.pmod(F.xxhash64("source"), "batches").cast("int")))
    priced = held.join(known.select("lang", "source", "terms", "lang_total", "total"), ["lang", "source"]).withColumn("price", _price("n", "total"))

    own = priced.select("lang", "source", F.col("term").alias("item"), (F.col("price") - _price("lang_n", "lang_total")).alias("value")).where("value > 0")
    own = _first(own).where(F.col("rank") <= own_terms).withColumn("part", F.lit("term"))

    # Each group has an entry for each block of its language, if only to say that all the block's terms are absent.
    entries = F.array_sort(F.collect_list(F.struct("id", "price")))
    arrays = priced.groupBy("lang", "source", F.expr(f"(id - 1) div {block}").alias("block")).agg(entries.alias("entries"))
    blocks = known.withColumn("block", F.explode(F.expr(f"sequence(0L, greatest(terms - 1, 0) div {block})")))
    sized = blocks.select("lang", "source", "block", "batch", "batches", F.when(F.col("terms") > 0, _price("0", "total")).otherwise(0).alias("absent"), F.expr(f"least({block}, terms - block * {block})").alias("size"))
    filled = sized.join(arrays, ["lang", "source", "block"], "left").select(*sized.columns, F.expr("coalesce(entries.id, array())").alias("ids"), F.expr("coalesce(entries.price, array())").alias("prices"))
    filled = scratch.save(filled)
    left = filled.withColumn("other", F.explode(F.expr("sequence(batch, batches - 1)"))).withColumnRenamed("batch", "one")
    right = filled.withColumn("one", F.explode(F.expr("sequence(0, batch)"))).withColumnRenamed("batch", "other")
    task = ["lang", "block", "one", "other"]
    pairs = left.groupBy(*task).cogroup(right.groupBy(*task)).applyInPandas(_pair_task, _PAIRS)
    pairs = scratch.save(pairs.groupBy("lang", "a", "b").agg(F.sum("value").alias("value")))
    ways = pairs.select("lang", F.col("a").alias("source"), F.col("b").alias("item"), "value").union(pairs.select("lang", "b", "a", "value"))
    both = _first(ways).withColumn("part", F.lit("pair"))
    columns = ["lang", "source", "part", "item", "value", F.col("rank").cast("int").alias("rank")]
    return both.select(*columns).union(own.select(*columns))
