"""Plain versions of what has no SQL, and texts of megabytes."""

import itertools
import math
import random
import re

import pytest
from pyspark.sql import functions as F


def _fewest(sizes, capacity):
    """The fewest bins by trying all ways to put items into bins."""
    best = len(sizes)

    def put(i, rooms):
        nonlocal best
        if len(rooms) >= best:
            return
        if i == len(sizes):
            best = len(rooms)
            return
        for j in range(len(rooms)):
            if rooms[j] >= sizes[i] and rooms.index(rooms[j]) == j:
                put(i + 1, [*rooms[:j], rooms[j] - sizes[i], *rooms[j + 1 :]])
        put(i + 1, [*rooms, capacity - sizes[i]])

    put(0, [])
    return best


def test_best_fit_against_all_packings():
    """The rooms left are those of a plain best-fit decreasing, and the bins one more than the fewest at most."""
    from tidemark.llm.packing import best_fit

    r = random.Random(2)
    exact = 0
    for _ in range(150):
        sizes = [r.randint(1, 20) for _ in range(r.randint(0, 8))]
        rooms = []
        for size in sorted(sizes, reverse=True):
            fits = [x for x in rooms if x >= size]
            if fits:
                rooms.remove(min(fits))
            rooms.append((min(fits) if fits else 20) - size)
        bins = best_fit(sizes, 20)
        assert sorted(20 - sum(sizes[i] for i in b) for b in bins) == sorted(rooms)
        fewest = _fewest(sizes, 20)
        assert fewest <= len(bins) <= fewest + 1
        exact += len(bins) == fewest
    assert exact > 120


def test_toxicity_scores_by_hand(spark):
    """Longest stems at the starts of words, neighbours that excuse them, three of each at most, over the length."""
    from tidemark.llm.toxicity import Lexicon, fold, score

    lexicon = Lexicon({"grump": 2.0, "grumpf": 3.0, "blarg": 1.5, "öde": 1.0}, frozenset({("<", "nice", "blarg"), (">", "cat", "grump")}), 0.8, -1.5)
    r = random.Random(4)
    words = ["grump", "grumpf", "Grumpfling", "blarg", "bl4rg", "nice", "cat", "agrump", "öde", "ödem", "plain", "x", "7", "grump2"]
    texts = [None, "", *[r.choice(["", " "]).join(w + r.choice([" ", ", ", "\n", "-", "  "]) for w in r.choices(words, k=r.randint(1, 40))) for _ in range(150)], "grumpf " * 500]

    def plain(text):
        text, total, seen = fold(text or ""), 0.0, {}
        for i in range(len(text)):
            if i and text[i - 1].isalpha():
                continue
            stem = max((s for s in lexicon.stems if text.startswith(s, i)), key=len, default=None)
            if stem is None:
                continue
            before = re.search(r"([^\W\d_]+)[^\w\n]{1,3}$", text[max(0, i - 40) : i])
            after = re.match(r"[^\W\d_]*[^\w\n]{1,3}([^\W\d_]+)", text[i + len(stem) :])
            if (before and ("<", before[1], stem) in lexicon.exceptions) or (after and (">", after[1], stem) in lexicon.exceptions):
                continue
            seen[stem] = seen.get(stem, 0) + 1
            total += lexicon.stems[stem] * (seen[stem] <= 3)
        return 1 / (1 + math.exp(-(total / (1 + math.log1p(len(text) / 2400)) * 0.8 - 1.5)))

    made = {x["doc_id"]: (x["score"], x["predicted"]) for x in score(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), lexicon).collect()}
    for i, text in enumerate(texts):
        assert abs(made[i][0] - plain(text)) < 1e-9 and made[i][1] == (made[i][0] >= 0.5)
    assert len({round(s, 6) for s, _ in made.values()}) > 20


@pytest.fixture(scope="module")
def long_docs(spark):
    r = random.Random(8)
    words = ["".join(r.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(r.randint(2, 9))) for _ in range(4000)]
    text = " ".join(r.choices(words, k=800_000))
    assert len(text) > 5_000_000
    rows = [(1, text, "en", "a"), (2, "short one", "en", "b"), (3, None, "en", "a"), (4, text[: len(text) // 2], "en", "b")]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").cache(), text


def test_texts_of_megabytes(spark, long_docs):
    """Every operator reads a text of 5 MB whole."""
    public_tokenizers = pytest.importorskip("public_tokenizers")
    from tidemark.llm import decontamination, jaccard_join, language_model, packing, pii, secrets, sharding, source_divergence, suffix_dedup, toxicity

    docs, text = long_docs
    words = text.split()
    by_id = lambda df: {x["doc_id"]: x for x in df.collect()}
    packed = packing.pack(docs, public_tokenizers.path("word_bpe_49k.json")).groupBy("doc_id").agg(F.sum("length").alias("n"), F.count("*").alias("pieces"))
    packed = by_id(packed)
    assert packed[1]["n"] >= len(words) and packed[1]["pieces"] == math.ceil(packed[1]["n"] / 4096) and packed[3]["n"] == 1
    cut = by_id(suffix_dedup.digest(docs))
    assert cut[1]["n_bytes"] == len(text) and cut[1]["n_removed"] == 0 and cut[4]["n_removed"] == cut[4]["n_bytes"] == len(text) // 2
    classes = by_id(jaccard_join.classes(docs))
    assert classes[1]["n_shingles"] == len(set(itertools.pairwise(zip(words, words[1:], words[2:], words[3:], strict=False)))) and classes[4]["component_id"] == 4
    assert by_id(language_model.score(docs))[1]["n_words"] == len(words)
    item = " ".join(words[700_000:700_020])
    found = by_id(decontamination.find(docs, spark.createDataFrame([(9, item)], "item_id long, text string")))
    assert any(text[h["begin"] : h["end"]] in item for h in found[1]["hits"]) and not found[4]["hits"] and not found[3]["hits"]
    end = text + " password=abcdefgh12 mail jo@x.org"
    tail = spark.createDataFrame([(1, end)], "doc_id long, text string")
    assert secrets.digest(tail).first()["spans"].split(",")[0] == f"assign:{len(text) + 1}:{len(text) + 20}"
    moved = pii.pseudonymise(tail, "k").first()
    assert moved["found"] == ["email"] and moved["text"].startswith(text) and not moved["text"].endswith("jo@x.org")
    assert by_id(sharding.shard(docs, 2))[1]["size"] == len(text) + 16
    lexicon = toxicity.Lexicon({words[-1]: 50.0}, frozenset(), 1.0, -1.0)
    assert by_id(toxicity.score(docs, lexicon))[1]["predicted"] == 1
    pairs = source_divergence.divergence(docs, least_docs=1).where("part = 'pair'").collect()
    assert len(pairs) == 2 and pairs[0]["value"] == pairs[1]["value"] > 0
