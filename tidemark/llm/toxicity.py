"""A weighted lexicon, learned from labels, matched by Aho-Corasick over folded text.

Folding undoes look-alike letters and digits used as letters. An entry is a word stem with a log-odds weight; exception
phrases, stems in company that clean texts use, cancel the entries that they cover. A text's sum of weights, divided by a
slowly growing function of its length, goes through a logistic curve fitted on the same labels.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.scratch import bounded_batches

# Letters of other scripts that look like Latin ones, and digits or signs used as letters.
_LOOKALIKE = {
    "а": "a", "в": "b", "с": "c", "ԁ": "d", "е": "e", "һ": "h", "і": "i", "ј": "j", "к": "k", "м": "m", "о": "o",
    "р": "p", "ѕ": "s", "т": "t", "у": "y", "х": "x", "ѡ": "w", "α": "a", "ε": "e", "ι": "i", "κ": "k", "ν": "v",
    "ο": "o", "ρ": "p", "τ": "t", "υ": "u", "χ": "x", "ı": "i", "ɡ": "g", "ⅼ": "l",
    "\u200b": None, "\u200c": None, "\u200d": None, "\u2060": None, "\ufeff": None, "\xad": None,
}
_AS_LETTER = {"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "@": "a", "$": "s", "!": "i"}
_FOLD = str.maketrans(_LOOKALIKE | {chr(c + 0xFEE0): chr(c) for c in range(0x21, 0x7F)})
_ODD = re.compile("[\xadıɡͰ-ӿԁѡ\u200b-\u200d\u2060ⅼ\ufeff！-～]")
_MASK = re.compile(r"[013457@$!]+")
_WORD = re.compile(r"[^\W\d_]+")


def _unmasked(m: re.Match) -> str:
    """Digits and signs between letters as the letters they stand for; at a word's start one digit or $ before two letters, at
    its end dollar signs only, as numbers and exclamation marks stand there by right."""
    text, (begin, end), run = m.string, m.span(), m[0]
    before = text[begin - 1 : begin]
    if before.isalpha():
        fits = text[end : end + 1].isalpha() or not run.strip("$")
    else:
        fits = len(run) == 1 and run not in "@!" and not before.isalnum() and len(after := text[end : end + 2]) == 2 and after.isalpha()
    return "".join(map(_AS_LETTER.__getitem__, run)) if fits else run


def fold(text: str) -> str:
    """Lower case, look-alikes as Latin letters, digits and signs in words as the letters they stand for."""
    text = text.lower()
    if not text.isascii() and _ODD.search(text):
        text = text.translate(_FOLD).lower()
    return _MASK.sub(_unmasked, text)


@dataclass
class Lexicon:
    """Stem weights, exception phrases (stem with a neighbour word), and the logistic curve (slope, intercept)."""

    stems: dict[str, float] = field(default_factory=dict)
    exceptions: frozenset[tuple[str, str, str]] = frozenset()
    slope: float = 1.0
    intercept: float = -2.0

    def automaton(self):
        if not self.stems:
            return None
        import ahocorasick

        found = ahocorasick.Automaton()
        for stem, weight in self.stems.items():
            found.add_word(stem, (len(stem), stem, weight))
        found.make_automaton()
        return found


def _hits(text: str, automaton) -> Iterator[tuple[int, str, float]]:
    """The longest stem at each word's start; where a word starts inside folded text, letters precede it never."""
    best: dict[int, tuple[str, float]] = {}
    for end, (size, stem, weight) in automaton.iter(text):
        begin = end - size + 1
        if begin and text[begin - 1].isalpha():
            continue
        if begin not in best or len(best[begin][0]) < size:
            best[begin] = (stem, weight)
    for begin, (stem, weight) in best.items():
        yield begin, stem, weight


_BEFORE = re.compile(r"([^\W\d_]+)[^\w\n]{1,3}$")
_AFTER = re.compile(r"[^\W\d_]*[^\w\n]{1,3}([^\W\d_]+)")


def _company(text: str, begin: int, stem: str) -> list[tuple[str, str, str]]:
    before = _BEFORE.search(text, max(0, begin - 40), begin)
    after = _AFTER.match(text, begin + len(stem))
    return [(side, m[1], stem) for side, m in (("<", before), (">", after)) if m]


def weigh(text: str | None, lexicon: Lexicon, automaton) -> float:
    """The sum of the weights of a text's hits, a stem counting three times at most, over 1 + ln(1 + words / 400)."""
    if not text or automaton is None:
        return 0.0
    text = fold(text)
    seen: Counter[str] = Counter()
    total = 0.0
    for begin, stem, weight in _hits(text, automaton):
        if lexicon.exceptions and any(c in lexicon.exceptions for c in _company(text, begin, stem)):
            continue
        seen[stem] += 1
        if seen[stem] <= 3:
            total += weight
    return total / (1 + math.log1p(len(text) / 2400)) if total else 0.0


def _texts(batch: pa.RecordBatch) -> Iterator[str | None]:
    """The texts of a batch, few of them in memory as Python strings at a time."""
    for at in range(0, batch.num_rows, 256):
        yield from batch.column("text").slice(at, 256).to_pylist()


def _count_words(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        all_docs: Counter[str] = Counter()
        toxic_docs: Counter[str] = Counter()
        for text, toxic in zip(_texts(batch), batch.column("toxic").to_pylist(), strict=True):
            words = set(_WORD.findall(fold(text or "")))
            all_docs.update(words)
            if toxic:
                toxic_docs.update(words)
        yield pa.RecordBatch.from_pydict(
            {"word": list(all_docs), "docs": list(all_docs.values()), "toxic": [toxic_docs[w] for w in all_docs]},
            schema=pa.schema([("word", pa.string()), ("docs", pa.int64()), ("toxic", pa.int64())]),
        )


def _count_company(lexicon: Lexicon):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton = lexicon.automaton()
        for batch in batches:
            every: Counter[tuple[str, str, str]] = Counter()
            bad: Counter[tuple[str, str, str]] = Counter()
            for text, toxic in zip(_texts(batch), batch.column("toxic").to_pylist(), strict=True):
                folded = fold(text or "")
                found = {c for begin, stem, _ in _hits(folded, automaton) for c in _company(folded, begin, stem)}
                every.update(found)
                if toxic:
                    bad.update(found)
            keys = list(every)
            yield pa.RecordBatch.from_pydict(
                {"side": [k[0] for k in keys], "word": [k[1] for k in keys], "stem": [k[2] for k in keys], "docs": [every[k] for k in keys], "toxic": [bad[k] for k in keys]},
                schema=pa.schema([("side", pa.string()), ("word", pa.string()), ("stem", pa.string()), ("docs", pa.int64()), ("toxic", pa.int64())]),
            )

    return run


def _weigh_rows(lexicon: Lexicon):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton = lexicon.automaton()
        for batch in batches:
            raw = [weigh(t, lexicon, automaton) for t in _texts(batch)]
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in batch.schema.names if c != "text"], pa.array(raw, pa.float64())], [*[c for c in batch.schema.names if c != "text"], "raw"])

    return run


def _closed_stems(rows: list[tuple[str, int, int]]) -> dict[str, tuple[int, int]]:
    """Stems none of whose extensions has all their documents, and that no shorter stem as pure stands for."""
    table = {stem: (docs, toxic) for stem, docs, toxic in rows}
    covered = {s[:-1] for s, x in table.items() if table.get(s[:-1]) == x}
    kept: dict[str, tuple[int, int]] = {}
    for stem in sorted(set(table) - covered, key=len):
        docs, toxic = table[stem]
        shorter = [kept[stem[:n]] for n in range(1, len(stem)) if stem[:n] in kept]
        if not any(t / d >= toxic / docs - 0.02 for d, t in shorter):
            kept[stem] = (docs, toxic)
    return kept


def _logistic(points: list[tuple[float, int, int]]) -> tuple[float, float]:
    """Slope and intercept by Newton's method over (raw, rows, toxic rows), with a slight pull to small values."""
    x, n, t = (np.array(v, float) for v in zip(*points, strict=True))
    a, b = 1.0, -2.0
    for _ in range(60):
        p = 1 / (1 + np.exp(-np.clip(a * x + b, -30, 30)))
        w = n * p * (1 - p)
        g = np.array([((t - n * p) * x).sum() - 0.05 * a, (t - n * p).sum() - 0.05 * b])
        h = np.array([[(w * x * x).sum() + 0.05, (w * x).sum()], [(w * x).sum(), w.sum() + 0.05]])
        step = np.clip(np.linalg.solve(h, g), -2, 2)
        a, b = max(0.0, a + step[0]), b + step[1]
    return float(a), float(b)


def learn(docs: DataFrame, labels: DataFrame, sample: int = 40_000) -> Lexicon:
    """Learn a lexicon from labels (doc_id, toxic) of documents (doc_id, text).

    The bound: about ``sample`` labelled rows, those of the smallest hashes of doc_id; the lexicon is bounded by what stands
    out in them, and by nothing else. Equal texts count once, toxic if any copy is. A stem, the first 3 to 14 letters of words
    or a whole longer word, must stand out by its log-likelihood ratio over all candidates tested. Null labels and texts are
    left out; a doc_id with several labels is toxic if one is. Without labels or stems every text gets the same score, below a half.
    """
    bounded_batches(docs.sparkSession)
    labels = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("toxic")).where("doc_id is not null and toxic is not null")
    there = labels.count()
    if there > sample:
        labels = labels.where(F.pmod(F.xxhash64("doc_id", F.lit(11)), F.lit(1_000_000)) < F.lit(int(1_000_000 * sample / there)))
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).where("text is not null")
    train = texts.join(labels, "doc_id").groupBy(F.xxhash64("text").alias("h"), F.crc32(F.col("text").cast("binary")).alias("c"))
    train = train.agg(F.first("text").alias("text"), F.max("toxic").alias("toxic")).select("text", "toxic").persist()
    try:
        totals = train.agg(F.count("*").alias("n"), F.sum("toxic").alias("t")).first()
        n, t = totals["n"], totals["t"] or 0
        if not n or not t or n == t:
            return Lexicon(intercept=-2.0)
        rate = t / n
        words = train.mapInArrow(_count_words, "word string, docs long, toxic long")
        words = words.groupBy("word").agg(F.sum("docs").alias("docs"), F.sum("toxic").alias("toxic"))
        cut = F.explode(F.expr("array_distinct(concat(transform(sequence(3, greatest(3, least(length(word), 14))), n -> substring(word, 1, n)), array(word)))"))
        stems = words.where("length(word) >= 3").select(cut.alias("stem"), "docs", "toxic").groupBy("stem").agg(F.sum("docs").alias("docs"), F.sum("toxic").alias("toxic"))
        stems = stems.where("docs >= 3")
        tested = stems.count()
        good, bad = F.col("docs") - F.col("toxic"), F.col("toxic")
        ratio = 2 * (bad * F.log(bad / (F.col("docs") * rate)) + F.when(good > 0, good * F.log(good / (F.col("docs") * (1 - rate)))).otherwise(0.0))
        picked = stems.where("toxic >= 3").withColumn("ratio", ratio).where((bad / F.col("docs") >= 0.75) & (F.col("ratio") >= 2 * math.log(max(tested, 2)) + 4))
        rows = picked.collect()
        kept = _closed_stems([(r["stem"], r["docs"], r["toxic"]) for r in rows])
        clean = n - t
        lexicon = Lexicon({s: math.log((x + 0.5) / (t + 1) * (clean + 1) / (d - x + 0.5)) for s, (d, x) in kept.items()})
        if not lexicon.stems:
            return Lexicon(intercept=math.log(min(rate, 0.3) / (1 - min(rate, 0.3))))
        company = train.mapInArrow(_count_company(lexicon), "side string, word string, stem string, docs long, toxic long")
        company = company.groupBy("side", "word", "stem").agg(F.sum("docs").alias("docs"), F.sum("toxic").alias("toxic"))
        mild = company.where("docs >= 5 and toxic <= 0.1 * docs")
        lexicon.exceptions = frozenset((r["side"], r["word"], r["stem"]) for r in mild.collect())
        raw = train.mapInArrow(_weigh_rows(lexicon), "toxic int, raw double").groupBy(F.least(F.round("raw", 1), F.lit(50.0)).alias("raw"))
        points = raw.agg(F.count("*").alias("n"), F.sum("toxic").alias("t")).collect()
        slope, intercept = _logistic([(r["raw"], r["n"], r["t"]) for r in points])
        # A text without hits is never called toxic, even where most of the labelled ones are.
        lexicon.slope, lexicon.intercept = slope, min(intercept, -0.01)
        return lexicon
    finally:
        train.unpersist()


def score(docs: DataFrame, lexicon: Lexicon, threshold: float = 0.5) -> DataFrame:
    """Score every row of ``docs`` (doc_id, text): doc_id, score between 0 and 1, predicted.

    Null and empty texts have no hits and get the curve's value there; repeated rows are scored each; other columns are not read.
    """
    bounded_batches(docs.sparkSession)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    raw = rows.mapInArrow(_weigh_rows(lexicon), "doc_id long, raw double")
    value = 1 / (1 + F.exp(-(F.col("raw") * lexicon.slope + lexicon.intercept)))
    return raw.select("doc_id", value.alias("score")).withColumn("predicted", (F.col("score") >= threshold).cast("int"))


def keep_mild(docs: DataFrame, lexicon: Lexicon, threshold: float = 0.5) -> DataFrame:
    """The rows of ``docs``, all columns, whose score is below ``threshold``; null and empty texts have no hits and stay where
    the threshold is a half or more."""
    bounded_batches(docs.sparkSession)
    limit = math.log(threshold / (1 - threshold))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton = lexicon.automaton()
        for batch in batches:
            raw = [weigh(t, lexicon, automaton) for t in _texts(batch)]
            yield batch.filter(pa.array([r * lexicon.slope + lexicon.intercept < limit for r in raw], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)


def held_out(doc_id="doc_id"):
    """The rows that no label is learned from: a fifth, by checksum of the id."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 5 == 0, F.lit(False))
