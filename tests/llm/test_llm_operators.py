"""Each operator against a brute-force version or an exact round trip, on small tables with nulls, empty and long texts,
repeated rows, ties, clashing columns and no rows at all."""

import hashlib
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

SYLLABLES = "ka lo mi ren tu sha bel or quin da fe zu".split()


def _word(r):
    return "".join(r.choice(SYLLABLES) for _ in range(r.randint(1, 4)))


def _text(r, n):
    return " ".join(_word(r) for _ in range(n))


def _corpus(seed=5, n=60):
    r = random.Random(seed)
    texts = [_text(r, r.randint(1, 120)) for _ in range(n)]
    passage = _text(r, 70)
    for i in range(0, n, 7):
        texts[i] = texts[i] + " " + passage + " " + _text(r, 10)
    for i in range(1, n, 9):
        words = texts[(i * 5) % n].split()
        words[r.randrange(len(words))] = "changed"
        texts[i] = " ".join(words)
    texts[3] = texts[10]
    rows = [(i, t, "en", "a") for i, t in enumerate(texts)]
    return rows + [(n, None, None, None), (n + 1, "", "en", "a"), (n + 2, _text(r, 3000), "en", "b"), (n + 3, "one two", "en", "b"), (n + 4, "One  TWO", "en", "b"), (n + 5, "héllo wörld ñandú " * 30, "es", "b")]


@pytest.fixture(scope="module")
def docs(spark):
    # Extra columns clash with names that operators use inside.
    return spark.createDataFrame(_corpus(), "doc_id long, text string, lang string, source string").withColumns({"rank": F.lit(1), "node": F.lit("x"), "size": F.lit(2), "shard": F.lit(3)}).cache()


@pytest.fixture(scope="module")
def none(docs):
    return docs.limit(0)


def _data(docs):
    return {r["doc_id"]: r["text"] or "" for r in docs.select("doc_id", "text").collect()}


def test_packing(docs, none):
    public_tokenizers = pytest.importorskip("public_tokenizers")
    from tokenizers import Tokenizer

    from tidemark.llm.packing import best_fit, pack

    path = public_tokenizers.path("word_bpe_49k.json")
    whole = Tokenizer.from_file(path)
    whole.encode_special_tokens = True
    rows = pack(docs, path, capacity=256).toPandas()
    for doc_id, text in _data(docs).items():
        ids = [*whole.encode(text, add_special_tokens=False).ids, 1]
        mine = rows[rows.doc_id == doc_id].sort_values("piece")
        assert mine.length.sum() == len(ids) and list(mine.piece) == list(range(len(mine)))
        for p in mine.itertuples():
            assert zlib.crc32(np.array(ids[p.start : p.start + p.length], "<u4").tobytes()) == p.ids_crc32
            assert p.length == 256 or p.piece == len(mine) - 1
    for _, g in rows.groupby("sequence_id"):
        g = g.sort_values("offset")
        assert g.offset.iloc[0] == 0 and list(g.offset[1:]) == list((g.offset + g.length)[:-1]) and g.length.sum() <= 256
    assert rows.sequence_id.nunique() <= rows.length.sum() / 256 * 1.05 + 1
    assert pack(none, path).count() == 0
    # Documents over half a sequence can't share one: none of them travels on to a last task, and small ones still join them.
    import tidemark.llm.packing as P

    halves = [(200 + i % 7, [(i, 0, 0, 200 + i % 7, 0, 0)]) for i in range(4000)] + [(5, [(9999, 0, 0, 5, 0, 0)])]
    batch = P._bins(halves, 256, 8, False)
    assert batch.column("done").to_pylist().count(False) <= P._EMPTIEST + 1 and batch.num_rows == 4000
    for sizes in ([5, 5, 5], [10], [], [1] * 33, [6, 4, 7, 3, 10]):
        bins = best_fit(sizes, 10)
        assert sorted(i for b in bins for i in b) == list(range(len(sizes))) and all(sum(sizes[i] for i in b) <= 10 for b in bins)


def test_tokenizer_words():
    public_tokenizers = pytest.importorskip("public_tokenizers")
    from tidemark.llm.packing import WordTokenizer

    made = WordTokenizer(public_tokenizers.path("word_bpe_49k.json"))
    for odd in ["don't STOP!! it's", "İstanbul ΣΑΣ ς", "a²b ½ x_y 12ab", "日本語", "<|endoftext|> hi", "", "\x1c a\x85b", "ª º µ ß ſ", "😀 ok"]:
        assert np.frombuffer(made.many([odd])[0], "<u4").tolist() == made.whole.encode(odd, add_special_tokens=False).ids


def _repeats(data):
    seen, made = set(), {}
    for i in sorted(data):
        b = data[i].encode()
        cover = np.zeros(len(b) + 1, int)
        for j in range(len(b) - 99):
            if b[j : j + 100] in seen:
                cover[j] += 1
                cover[j + 100] -= 1
            else:
                seen.add(b[j : j + 100])
        gone = np.cumsum(cover[:-1]) > 0
        spans = int((gone & ~np.concatenate([[False], gone[:-1]])).sum()) if len(b) else 0
        made[i] = (len(b), int(gone.sum()), spans, hashlib.sha256(np.frombuffer(b, np.uint8)[~gone].tobytes()).hexdigest())
    return made


@pytest.mark.parametrize("frequent", [20_000, 1])
def test_repeats(spark, docs, none, frequent, monkeypatch):
    from tidemark.llm import suffix_dedup as S

    if frequent == 1:
        whole = S.remove_repeats
        monkeypatch.setattr(S, "remove_repeats", lambda d: whole(d, frequent=1))
    rows = {r["doc_id"]: (r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in S.digest(docs).collect()}
    assert rows == _repeats(_data(docs))
    periodic = {1: "ab" * 300, 2: "x" * 250, 3: "ab" * 90, 4: "y" + "x" * 120}
    made = spark.createDataFrame(list(periodic.items()), "doc_id long, text string")
    assert {r["doc_id"]: (r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in S.digest(made).collect()} == _repeats(periodic)
    assert S.digest(none).count() == 0


def test_op2_places_are_dealt_by_lots_of_documents():
    """Documents with anchors in every bucket make a row for each bucket and lot, not for each bucket and document."""
    import numpy as np
    import pyarrow as pa

    from tidemark.llm import suffix_dedup as S

    lots, buckets, docs = [11, 12, 13], 40, np.arange(-5, 295)
    blob = lambda x: x.tobytes()
    rows = []
    for b in range(buckets):  # each document twice in each bucket, with the same anchor; one anchor of each bucket is alone
        ids, hashes = np.concatenate([docs, docs, [7]]), np.concatenate([np.arange(300), np.arange(300), [999]]).astype(np.uint32)
        places = np.concatenate([np.full(300, b), np.full(300, 1000 + b), [5000]]).astype(np.uint32)
        batch = pa.RecordBatch.from_arrays([pa.array([b], pa.int32()), *[pa.array([blob(x)], pa.binary()) for x in (hashes, S._steps(ids), S._steps(places))]], schema=S._ANCHORS)
        rows.extend(S._repeated_places(1_000, lots)([batch]))
    assert sum(r.num_rows for r in rows) <= buckets * len(lots)
    found = [x for r in S._places_by_document(rows) for x in zip(r.column("doc_id").to_pylist(), r.column("places").to_pylist(), strict=True)]
    assert sorted(d for d, _ in found) == docs.tolist()
    want = sorted([2 * b for b in range(buckets)] + [2 * (1000 + b) for b in range(buckets)])
    assert all(sorted(np.frombuffer(m, np.uint32).tolist()) == want for _, m in found)


def test_longest_previous_factors():
    """Against a comparison of all pairs of suffixes."""
    from tidemark.llm.suffix_dedup import longest_previous_factors

    r = random.Random(17)
    for letters, n in (("ab", 60), ("abc", 300), ("a", 150), ("abcdefgh", 200), ("x", 1)):
        text = "".join(r.choice(letters) for _ in range(n)).encode()
        text += text[: n // 2] + bytes([0, 255]) + text
        starts = np.array(sorted(r.sample(range(len(text)), len(text) * 2 // 3)))
        order = np.array([r.randrange(len(starts)) for _ in starts])
        got = longest_previous_factors(np.frombuffer(text, np.uint8), starts, order)

        def shared(a, b, text=text):
            k = 0
            text = text + bytes(128)
            while k < 128 and text[a + k] == text[b + k]:
                k += 1
            return k

        want = [max([0, *(shared(s, t) for t, p in zip(starts, order, strict=True) if p < o)]) for s, o in zip(starts, order, strict=True)]
        assert got.tolist() == want


def _luhn(digits):
    total = 0
    for i, c in enumerate(reversed(digits)):
        v = int(c) * (2 if i % 2 else 1)
        total += v - 9 if v > 9 else v
    return total % 10 == 0


def test_pseudonyms(spark):
    from tidemark.llm.pii import pseudonymise

    rows = [
        (1, "card 4619646426088949 and 4619-6464-2608-8949 bad 4619646426088940"), (2, "call +1 (579) 555-6331 or 579-555-6331."), (3, "ip 78.241.210.149, bad 300.1.1.1"),
        (4, "mail tbopht.05@mail8.example.com, A@x.org"), (5, "on 2024-02-29 and 31.12.1999 bad 2023-02-30"), (6, None), (7, ""), (8, "ssn 123-45-6789 or 666-12-1234"), (9, "again 4619646426088949 x"),
    ]
    made = {r["doc_id"]: r for r in pseudonymise(spark.createDataFrame(rows, "doc_id long, text string").withColumn("found", F.lit("clash")), "k").collect()}
    assert made[6]["text"] is None and made[6]["found"] == [] and made[7]["text"] == ""
    cards = re.findall(r"\d{16}", made[1]["text"])
    assert _luhn(cards[0]) and cards[0] != "4619646426088949" and cards[1] == "4619646426088940"
    assert made[1]["text"].split(" and ")[1].split(" ")[0].replace("-", "") == cards[0] and cards[0] in made[9]["text"]
    assert "300.1.1.1" in made[3]["text"] and "78.241.210.149" not in made[3]["text"]
    assert re.fullmatch(r"mail [a-z]{6}\.[0-9]{2}@mail8\.example\.com, [A-Z]@x\.org", made[4]["text"]) and "tbopht" not in made[4]["text"]
    assert made[5]["found"] == ["date", "date"] and "2023-02-30" in made[5]["text"] and "2024-02-29" not in made[5]["text"]
    assert made[8]["found"] == ["ssn"] and "666-12-1234" in made[8]["text"]
    assert made[2]["text"].count("(5") == 1 and "555-6331" not in made[2]["text"]
    # A permutation: all dates of some years stay different, and valid.
    days = spark.sql("select explode(sequence(date'1999-01-01', date'2003-12-31')) as d").select(F.col("d").cast("string").alias("text"))
    new = pseudonymise(days, "k").select("text").toPandas().text
    assert new.nunique() == len(new) and new.str.fullmatch(r"\d{4}-\d{2}-\d{2}").all()
    assert pseudonymise(days.limit(0), "k").count() == 0


def _feistel_by_hand(key, kind, a, b, size_a, size_b, back=False):
    """The keyed permutation in plain Python, and its inverse."""
    from tidemark.llm.pii import ROUNDS

    def drawn(r, other):
        text = "|".join(map(str, (key, kind, size_a, size_b, r, other)))
        return int(hashlib.sha256(text.encode()).hexdigest()[:15], 16)

    for r in range(ROUNDS, 0, -1) if back else range(1, ROUNDS + 1):
        sign = -1 if back else 1
        if r % 2:
            a = (a + sign * drawn(r, b)) % size_a
        else:
            b = (b + sign * drawn(r, a)) % size_b
    return a, b


def test_pseudonyms_by_hand(spark):
    """Every kind against a Feistel network in plain Python, which also leads back to the value; other columns of any name stay."""
    import datetime

    from tidemark.llm.pii import pseudonymise

    r = random.Random(3)
    start = datetime.date(100, 1, 1)
    want, rows = {}, []

    def add(text, kind, new):
        want[len(rows)] = (new, kind)
        rows.append((len(rows), text))

    for _ in range(40):
        o = [r.randrange(256) for _ in range(4)]
        a, b = _feistel_by_hand("k", "ip", o[0] * 256 + o[1], o[2] * 256 + o[3], 65536, 65536)
        assert _feistel_by_hand("k", "ip", a, b, 65536, 65536, back=True) == (o[0] * 256 + o[1], o[2] * 256 + o[3])
        add(".".join(map(str, o)), "ip", f"{a // 256}.{a % 256}.{b // 256}.{b % 256}")
        day = start + datetime.timedelta(r.randrange(24 * 146097))
        n = (day - start).days
        a, b = _feistel_by_hand("k", "date", n % 146097 // 773, n % 146097 % 773, 189, 773)
        assert _feistel_by_hand("k", "date", a, b, 189, 773, back=True) == (n % 146097 // 773, n % 146097 % 773)
        new = start + datetime.timedelta(n - n % 146097 + a * 773 + b)
        form = r.choice(["{0.year:04d}-{0.month:02d}-{0.day:02d}", "{0.day:02d}.{0.month:02d}.{0.year:04d}", "{0.month:02d}/{0.day:02d}/{0.year:04d}"])
        add(form.format(day), "date", form.format(new))
        area, group, serial = r.choice([*range(1, 666), *range(667, 900)]), r.randrange(1, 100), r.randrange(1, 10000)
        a, b = _feistel_by_hand("k", "ssn", area - 1 - (area > 666), (group - 1) * 9999 + serial - 1, 898, 989901)
        add(f"{area:03d}-{group:02d}-{serial:04d}", "ssn", f"{a + 1 + (a + 1 >= 666):03d}-{b // 9999 + 1:02d}-{b % 9999 + 1:04d}")
        body = "4" + "".join(str(r.randrange(10)) for _ in range(14))
        check = next(c for c in "0123456789" if _luhn(body + c))
        a, b = _feistel_by_hand("k", "card", int(body[1:8]), int(body[8:]), 10**7, 10**7)
        moved = f"4{a:07d}{b:07d}"
        add(body + check, "card", moved + next(c for c in "0123456789" if _luhn(moved + c)))
        d = f"{r.randrange(2, 10)}{r.randrange(10**9):09d}"
        q = d[1:3] + d[4:]
        a, b = _feistel_by_hand("k", "phone", int(q[:4]), int(q[4:]), 10**4, 10**4)
        q = f"{a:04d}{b:04d}"
        add(f"({d[:3]}) {d[3:6]}-{d[6:]}", "phone", f"({d[0]}{q[:2]}) {d[3]}{q[2:4]}-{q[4:]}")
    table = spark.createDataFrame(rows, "doc_id long, text string").withColumns({c: F.lit(c) for c in ("pii_key", "_others", "_parts", "m", "a.b", "found")})
    made = pseudonymise(table, "k")
    assert made.columns == [c for c in table.columns if c not in ("text", "found")] + ["text", "found"]
    for x in made.collect():
        assert (x["text"], x["found"]) == (want[x["doc_id"]][0], [want[x["doc_id"]][1]]) and x["pii_key"] == "pii_key" and x["a.b"] == "a.b"
    mails = spark.createDataFrame([(1, "Anna.Lee@x.org"), (2, "anna.lee@x.org"), (3, "anna.lee@x.org")], "doc_id long, text string")
    one, two, three = (x["text"] for x in pseudonymise(mails, "k").orderBy("doc_id").collect())
    assert two == three == one.lower() and re.fullmatch(r"[A-Z][a-z]{3}\.[A-Z][a-z]{2}@x\.org", one) and two != "anna.lee@x.org"


def test_pseudonyms_in_any_script(spark):
    """Letters of other scripts move within them, nothing of a name is left, and what can't be moved whole stays and isn't counted."""
    import time

    from tidemark.llm.pii import pseudonymise

    names = ["josé.garcía", "JOSÉ.García", "мария", "Ольга-2", "γιώργος", "山田太郎", "김철수", "עדי", "mixé漢д", "ñandú", "straße", "x̂y"]
    rows = [(i, f"write {n}@ejemplo.es now") for i, n in enumerate(names)] + [(50, "josé.garcía@ejemplo.es"), (51, "mail@bücher.example.com"), (52, "é@ é@x x@y.z a@b.cd")]
    made = {r["doc_id"]: r for r in pseudonymise(spark.createDataFrame(rows, "doc_id long, text string"), "k").collect()}
    moved = {i: made[i]["text"][6:].split("@")[0] for i in range(len(names))}
    assert made[50]["text"] == moved[0] + "@ejemplo.es" and moved[0].lower() == moved[1].lower() and moved[1].split(".")[0].isupper()
    kind = lambda c: next((k for k, (a, b) in enumerate([(0x61, 0x7A), (0xE0, 0x17F), (0x3AC, 0x3CE), (0x430, 0x45F), (0x4E00, 0x9FFF), (0xAC00, 0xD7A3), (0x5D0, 0x5EA)]) if a <= ord(c.lower()) <= b), c)
    for i, name in enumerate(names[:10]):
        assert made[i]["found"] == ["email"] and list(map(kind, "".join("9" if c.isdigit() else c for c in moved[i]))) == list(map(kind, "".join("9" if c.isdigit() else c for c in name)))
        assert sum(a == b for a, b in zip(moved[i], name) if a.isalpha()) <= len(name) // 3 and moved[i] != name
    assert made[10]["found"] == [] and moved[10] == "straße" and made[11]["found"] == ["email"] and made[51]["found"] == ["email"]
    assert made[52]["text"].startswith("é@ é@x x@y.z ") and made[52]["found"] == ["email"]
    began = time.perf_counter()
    long = pseudonymise(spark.createDataFrame([(1, "b" * 1_000_000 + "@x.org"), (2, "c" * 1_000_000)], "doc_id long, text string"), "k").orderBy("doc_id").collect()
    assert long[0]["found"] == ["email"] and len(long[0]["text"]) == 1_000_006 and "bbbbbbbb" not in long[0]["text"] and long[1]["found"] == []
    assert time.perf_counter() - began < 120


def test_pseudonyms_of_whole_addresses(spark):
    """Long and numeric local parts move as a whole, every counted address changes, and none coincide."""
    from tidemark.llm.pii import pseudonymise

    long = "a" * 24
    locals_ = [f"{c}" for c in "abcdefghijklmnopqrstuvwxyz0123456789"] + [f"{1234567 + i}" for i in range(40)] + [f"{long}secretname{c}" for c in "abcdef"] + ["john1985", "john1986", "._-"]
    rows = [(i, f"{x}@qq.com") for i, x in enumerate(locals_)]
    made = {r["doc_id"]: r for r in pseudonymise(spark.createDataFrame(rows, "doc_id long, text string"), "k").collect()}
    assert made[len(rows) - 1]["found"] == [] and made[len(rows) - 1]["text"] == "._-@qq.com"
    new = [made[i]["text"] for i in range(len(rows) - 1)]
    assert all(made[i]["found"] == ["email"] and new[i] != rows[i][1] for i in range(len(new))) and len(set(new)) == len(new)
    shape = lambda t: re.sub("[0-9]", "0", re.sub("[a-z]", "a", t))
    assert all(shape(n) == shape(t) for n, (_, t) in zip(new, rows, strict=False))
    assert not any("secretname" in n or "1985" in n for n in new)


def test_nearest_neighbours(spark):
    from tidemark.llm.nn_descent import search

    r = np.random.default_rng(3)
    x = r.standard_normal((900, 16)).astype(np.float32)
    x[100:160] = x[100]
    x[200] = x[0] * 2
    rows = [(i, [float(c) for c in v], 1) for i, v in enumerate(x)]
    odd = [(5000, None, 1), (5001, [0.0] * 16, 1), (5002, [None] + [1.0] * 15, 1), (5003, [float("nan")] * 16, 1), (5004, [float(c) for c in x[0][:3]], 1), (7, [9.0] * 16, 1), (5005, [float("inf")] + [1.0] * 15, 1), (None, [1.0] * 16, 1)]
    table = spark.createDataFrame(rows + rows[:3] + odd, "vec_id long, embedding array<float>, rank int")
    got = search(table).toPandas()
    # A shorter vector counts as if filled up with zeros.
    x = np.vstack([x, np.concatenate([x[0][:3], np.zeros(13, np.float32)])])
    ids = np.array([*range(900), 5004])
    unit = x.astype(float) / np.linalg.norm(x.astype(float), axis=1, keepdims=True)
    hits = 0
    for q in range(0, 900, 50):
        s = unit @ unit[q]
        s[q] = -9
        order = ids[np.lexsort((ids, -s.round(12)))[:5]]
        mine = got[got.query_id == q].sort_values("rank")
        assert list(mine["rank"]) == [1, 2, 3, 4, 5] and np.allclose(mine.score, s[np.searchsorted(ids, mine.vec_id)])
        hits += len(set(order) & set(mine.vec_id))
    assert hits / 90 >= 0.9
    same = got[got.query_id == 100].sort_values("rank")
    assert list(same.vec_id) == [101, 102, 103, 104, 105]
    assert search(table.limit(0)).count() == 0
    assert search(spark.createDataFrame(rows[:2] + [(50, rows[2][1], 1)], "vec_id long, embedding array<float>, rank int")).count() == 4


def test_recall_on_the_given_vectors(spark):
    """At least nine of ten of the true five nearest, on the table of the driver."""
    import os

    from tidemark.llm.nn_descent import search

    path = "/root/testdata/sf0.1/embeddings.parquet"
    if not os.path.exists(path):
        pytest.skip("no tables here")
    table = spark.read.parquet(path)
    rows = table.select("vec_id", "embedding").toPandas().sort_values("vec_id")
    ids, x = rows.vec_id.to_numpy(), np.array(rows.embedding.tolist(), float)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    got = search(table).toPandas()
    hits = n = 0
    for q in np.flatnonzero(ids % 50 == 0):
        s = x @ x[q]
        s[q] = -9
        hits += len(set(ids[np.lexsort((ids, -s))[:5]]) & set(got[got.query_id == ids[q]].vec_id))
        n += 5
    assert hits / n >= 0.9


def _jaccard(data, k=5):
    lower = str.maketrans({c: c.lower() for c in "ABCDEFGHIJKLMNOPQRSTUVWXYZ"})
    sets = {}
    for i, t in data.items():
        w = re.findall("[^\x20\x09-\x0d]+", t.translate(lower))
        sets[i] = {tuple(w[j : j + k]) for j in range(len(w) - k + 1)} if len(w) >= k else ({tuple(w)} if w else set())
    parent = {i: i for i in sets}

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for a in sets:
        for b in sets:
            if a < b and sets[a] and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b]):
                x, y = root(a), root(b)
                parent[max(x, y)] = min(x, y)
    return {i: (len(sets[i]), root(i)) for i in sets}


def test_jaccard_join(spark, docs, none):
    from tidemark.llm.jaccard_join import classes, keep_first

    made = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in classes(docs).collect()}
    want = _jaccard(_data(docs))
    assert made == want and len({c for _, c in want.values()}) < len(want)
    kept = keep_first(docs)
    assert kept.columns == docs.columns and {r["doc_id"] for r in kept.select("doc_id").collect()} == {i for i, (_, c) in want.items() if i == c}
    assert classes(none).count() == 0
    # A chain of near copies that only neighbours link, and frequent shingles dealt with salt.
    r = random.Random(2)
    words = [_word(r) for _ in range(120)]
    chain = []
    for i in range(24):
        words[r.randrange(120)] = f"w{i}"
        words[r.randrange(120)] = f"v{i}"
        chain.append((100 + i, " ".join(words)))
    table = spark.createDataFrame([*chain, *chain[:2], (None, chain[0][1])], "doc_id long, text string")
    for settings in ({}, {"salted": 2, "often": 2}):
        made = classes(table, **settings).collect()
        assert len(made) == 27 and {(x["doc_id"], (x["n_shingles"], x["component_id"])) for x in made if x["doc_id"]} == set(_jaccard(dict(chain)).items())


def test_jaccard_join_of_salted_shingles(spark):
    """Near copies of one text, each with an edit of its own, share only frequent shingles, which are dealt to many buckets."""
    from tidemark.llm.jaccard_join import classes

    r = random.Random(6)
    base = [_word(r) + str(i) for i in range(20)]
    copies = [(i, " ".join([*base, f"own{i}"])) for i in range(90)]
    copies += [(i, " ".join(base[:8] + [f"x{i}y{j}" for j in range(9)])) for i in range(90, 96)]
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "64")
    try:
        made = classes(spark.createDataFrame(copies, "doc_id long, text string"), salted=20).collect()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    want = _jaccard(dict(copies))
    assert {x["doc_id"]: (x["n_shingles"], x["component_id"]) for x in made} == want
    assert len({c for _, c in want.values()}) == 7


@pytest.mark.parametrize("edits", [1, 2, 4])
def test_jaccard_join_of_many_near_copies(spark, edits, monkeypatch):
    """600 copies of one text, each with edits of its own: the pairs looked at grow with the copies and not with their square."""
    from tidemark.llm import jaccard_join as J

    r = random.Random(edits)
    base = [_word(r) + str(i) for i in range(100)]
    copies = []
    for i in range(600):
        words = list(base)
        for j, at in enumerate(r.sample(range(100), edits)):
            words[at] = f"own{i}x{j}"
        copies.append((i, " ".join(words)))
    asked = []
    verify = J._Join.verify
    monkeypatch.setattr(J._Join, "verify", lambda self, pairs: verify(self, pairs) if asked.append(pairs.count()) is None else 0)
    made = {x["doc_id"]: (x["n_shingles"], x["component_id"]) for x in J.classes(spark.createDataFrame(copies, "doc_id long, text string")).collect()}
    assert made == _jaccard(dict(copies))
    assert sum(asked) < 60 * len(copies)  # of 300 pairs for each copy


def test_secrets(spark, docs, none):
    from tidemark.llm import secrets as S

    r = random.Random(4)
    token = "".join(r.choice("0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz") for _ in range(44))
    weak = "z1" * 22
    key = "AKIA" + "".join(r.choice("ABCDEFGHJKLMNPQRST23456789") for _ in range(16))
    texts = {
        1: f"x password=abcdef12 y Token : 'abc.def' zé {key} and " + "0123456789abcdef01234567 end", 2: "secret=token: abcdefgh", 3: "api_key=ab", 4: f"look {token} here", 5: f"look {weak} here", 6: None, 7: "",
        8: "😀 passwd=123456 " + "ab" * 30, 9: "secret=passwd=longvalue",
    }
    table = spark.createDataFrame(list(texts.items()), "doc_id long, text string").unionByName(docs.select("doc_id", "text").withColumn("doc_id", F.col("doc_id") + 100))
    rows = {r["doc_id"]: r for r in S.digest(table).collect()}
    assign = re.compile(r"""((?:[pP][aA][sS][sS][wW][oO][rR][dD]|[pP][aA][sS][sS][wW][dD]|[sS][eE][cC][rR][eE][tT]|[tT][oO][kK][eE][nN]|[aA][pP][iI]_?[kK][eE][yY]))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
    for i, t in table.select("doc_id", "text").collect():
        t = t or ""
        a = [(m.start(), 0, m.end()) for m in assign.finditer(t) if len(m[2]) >= 6]
        k = [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", t) if len(m[0]) >= 20]
        h = [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", t) if len(m[0]) >= 24]
        base = ",".join(f"{('assign', 'access', 'hex')[q]}:{x}:{y}" for x, q, y in sorted(a + k + h))
        assert (rows[i]["n_assign"], rows[i]["n_access"], rows[i]["n_hex"], rows[i]["base_sha256"]) == (len(a), len(k), len(h), hashlib.sha256(base.encode()).hexdigest())
    assert rows[4]["spans"] == "random:5:49" and rows[5]["spans"] == ""
    kept = {r["doc_id"]: r["text"] for r in S.redact(table).collect()}
    assert kept[6] is None and kept[7] == "" and kept[4] == "look [secret] here" and key not in kept[1] and kept[3] == texts[3]
    assert S.digest(none).count() == 0


def test_rare_structured_tokens(spark):
    """Benjamini-Hochberg as by sorting all p-values, also where few tokens are structured."""
    from tidemark.llm import secrets as S

    r = random.Random(12)
    letters = "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"
    tokens = ["z1" * 22, "abcdefgh12345678" * 3] + ["".join(r.choice(letters) for _ in range(44)) for _ in range(150)]
    tokens = [t for t in tokens if re.search("[0-9]", t)]
    table = spark.createDataFrame(list(enumerate(tokens)), "doc_id long, text string")
    p = {x["text"]: x["p"] for x in table.select("text", S.p_value(F.col("text")).alias("p")).collect()}
    cuts = [q for k, q in enumerate(sorted(p.values()), 1) if q <= 0.05 * k / len(p)]
    assert cuts and p[tokens[0]] <= max(cuts)
    got = {x["doc_id"]: x["spans"] for x in S.digest(table).collect()}
    assert {tokens[i] for i, spans in got.items() if not spans} == {t for t, q in p.items() if q <= max(cuts)}


def _battery(token):
    """The three tests and their combination in plain Python."""
    import math

    from tidemark.llm.secrets import ENCODINGS

    body = token.rstrip("=")
    letters = next((a for p, a in ENCODINGS if re.fullmatch(p[1:-1], body)), ENCODINGS[-1][1])
    codes = [letters.find(c) for c in body]
    n, k = len(codes), len(letters)
    tail = lambda z: -math.log1p(math.exp(1.5976 * (z := min(max(z, -8.0), 8.0)) + 0.07056 * z**3))
    chi = sum(codes.count(c) ** 2 for c in set(codes)) * k / n - n
    uniform = (chi - (k - 1)) / math.sqrt(2 * (k - 1) * (n - 1) / n)
    highs = [c > (k - 1) / 2 for c in codes]
    high, low = sum(highs), n - sum(highs)
    mean = 2 * high * low / n + 1
    runs = 8.0
    if high and low:
        runs = abs(sum(a != b for a, b in zip(highs, highs[1:], strict=False)) + 1 - mean) / math.sqrt(max((mean - 1) * (mean - 2) / (n - 1), 1e-9))
    off = [c - sum(codes) / n for c in codes]
    square = sum(x * x for x in off)
    serial = abs(sum(a * b for a, b in zip(off, off[1:], strict=False)) / square + 1 / n) * math.sqrt(n) if square else 8.0
    h = -(tail(uniform) + min(0, tail(runs) + math.log(2)) + min(0, tail(serial) + math.log(2)))
    return math.exp(-h) * (1 + h + h * h / 2)


def test_randomness_by_hand(spark):
    """p-values as in plain Python; and both rates of error over planted secrets and harmless tokens of several lengths."""
    from tidemark.llm import secrets as S

    r = random.Random(31)
    alphabets = ["0123456789abcdef", "0123456789abcdefghijklmnopqrstuvwxyz", "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"]
    planted = ["".join(r.choice(a) for _ in range(n)) for n in (24, 32, 40, 64) for a in alphabets[1:] for _ in range(30)]
    planted = [t for t in planted if re.search("[0-9]", t) and re.search("[A-Za-z]", t)]
    words = "report_final_version_of_the_yearly_budget_plan_and_summary"
    harmless = [f"{words[i % 9:i % 9 + 18 + i % 25]}_2024_{i:04d}" for i in range(300)] + [f"{i:08d}" * 3 + "a" for i in range(60)] + [f"aaaa{i:04d}bbbb0000cccc1111dddd2222" for i in range(60)]
    table = spark.createDataFrame(list(enumerate(planted + harmless)), "doc_id long, text string")
    for x in table.select("text", S.p_value(F.col("text")).alias("p")).collect():
        assert abs(x["p"] - _battery(x["text"])) < 1e-9
    marked = {x["doc_id"] for x in S.digest(table).collect() if "random" in x["spans"]}
    missed = sum(i not in marked for i in range(len(planted)))
    alarms = sum(i in marked for i in range(len(planted), len(planted) + len(harmless)))
    print("missed", missed / len(planted), "false alarms", alarms / len(harmless))
    assert missed <= 0.05 * len(planted) and alarms <= 0.02 * len(harmless)


def test_names_made_of_words_are_no_secrets(spark):
    """Names of words in five shapes, none of whose words the model knows, alone and among keys; odds as in plain Python."""
    import math

    from tidemark.llm import secrets as S

    r = random.Random(17)
    words = "planet network garden policy winter window forest bridge silver kitchen mountain library teacher science journey chapter morning weather holiday captain diamond village traffic musical natural picture quality section station texture uniform victory yellow zebra account balance control".split()
    assert not set(words) & set(S.WORDS.split())
    some = lambda n: [r.choice(words) for _ in range(n)]
    shapes = [
        lambda: "".join(w.capitalize() for w in some(4)) + str(r.randint(10, 99)), lambda: "_".join(some(3)).upper() + f"_V{r.randint(1, 30)}", lambda: "-".join(some(4)) + f"-{r.randint(1, 9)}",
        lambda: f"blog/{r.randint(2000, 2024)}/{r.randint(1, 12):02d}/" + "-".join(some(3)), lambda: "".join(some(4)) + str(r.randint(1, 999)),
    ]
    names = [shape() for shape in shapes for _ in range(80)]
    keys = ["".join(r.choice(a) for _ in range(n)) for n in (24, 32, 40, 64) for _, a in S.ENCODINGS for _ in range(2)]
    keys = [k for k in keys if re.search("[0-9]", k) and re.search("[A-Za-z]", k) and not re.fullmatch("[0-9a-f]+", k)]
    for planted in ([], keys):
        table = spark.createDataFrame(list(enumerate(names + planted)), "doc_id long, text string")
        marked = {x["doc_id"] for x in S.digest(table).collect() if "random" in x["spans"]}
        alarms = sum(i < len(names) for i in marked)
        assert alarms <= 0.02 * len(names) and len(marked) - alarms >= 0.95 * len(planted), (alarms, len(marked) - alarms, len(planted))
    ones, pairs = S._letter_logs()
    code = lambda c: 0 if c.islower() else 1 if c.isupper() else 2 if c.isdigit() else 3
    for x in table.limit(60).select("text", S.natural_odds(F.col("text")).alias("odds")).collect():
        size = next((len(a) for p, a in S.ENCODINGS if re.fullmatch(p[1:-1], x["text"])), 64)
        want, last = 0.0, None
        for c in x["text"]:
            k = code(c)
            want += math.log(S.GOES_ON[4 if last is None else code(last)][k]) + math.log(size)
            if k < 2:
                within = last is not None and code(last) < 2 and not (code(last) == 0 and k == 1)
                want += pairs[(ord(last.lower()) - 97) * 26 + ord(c.lower()) - 97] if within else ones[ord(c.lower()) - 97]
            else:
                want += math.log(0.1 if k == 2 else 0.3)
            last = c
        assert abs(x["odds"] - want) < 1e-9


def test_secrets_beside_any_columns(spark):
    from tidemark.llm import secrets as S

    names = ("token", "assign", "access", "hexes", "base", "spans", "_row", "a.b")
    table = spark.createDataFrame([(1, "x password=abcdef12 y"), (2, None)], "doc_id long, text string").withColumns({c: F.lit(c) for c in names})
    kept = S.redact(table)
    assert kept.columns == table.columns
    rows = {x["doc_id"]: x for x in kept.collect()}
    assert rows[1]["text"] == "x [secret] y" and rows[2]["text"] is None and all(x[c] == c for x in rows.values() for c in names)
    found = S.find(table)
    assert found.where("doc_id = 1").first()["token"] == "token" and [m["text"] for m in found.where("doc_id = 1").first()["spans"]] == ["password=abcdef12"]
    long = "k1=secret: abcdefgh " * 20_000
    made = S.digest(spark.createDataFrame([(1, long)], "doc_id long, text string")).first()
    assert made["n_assign"] == 20_000 and made["spans"].split(",")[-1] == f"assign:{20 * 19_999 + 3}:{20 * 19_999 + 19}"


def test_language_model(spark, docs, none):
    import math
    from collections import Counter

    from tidemark.llm.language_model import score

    lower = str.maketrans({c: c.lower() for c in "ABCDEFGHIJKLMNOPQRSTUVWXYZ"})
    data = {i: re.findall("[^\x20\x09-\x0d]+", t.translate(lower)) for i, t in _data(docs).items()}
    one, two, first = Counter(), Counter(), Counter()
    for w in data.values():
        one.update(w)
        two.update(zip(w, w[1:], strict=False))
        first.update(w[:-1])
    total = sum(one.values())
    for head in (1000, 20):
        for row in score(docs, head=head).collect():
            w = data[row["doc_id"]]
            assert row["n_words"] == len(w)
            if not w:
                assert row["score"] is None
                continue
            s = math.log(one[w[0]] / total)
            for a, b in zip(w, w[1:], strict=False):
                s += math.log(two[a, b] / first[a]) if two[a, b] >= 2 else math.log(0.4 * one[b] / total)
            assert abs(row["score"] - s / len(w)) < 1e-9
    assert score(none).count() == 0
    # More documents in an Arrow batch than a flush can number.
    size = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "200000")
    try:
        many = spark.range(0, 150_000, 1, 1).select(F.col("id").alias("doc_id"), F.lit("word").alias("text"))
        assert [(r["n"], r["s"]) for r in score(many).groupBy(F.round("score", 6).alias("s")).agg(F.count("*").alias("n")).collect()] == [(150_000, 0.0)]
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", size)


def _edits(pattern, text):
    last = [0] * (len(text) + 1)
    for i in range(1, len(pattern) + 1):
        row = [i]
        for j in range(1, len(text) + 1):
            row.append(min(last[j] + 1, row[j - 1] + 1, last[j - 1] + (pattern[i - 1] != text[j - 1])))
        last = row
    return min(last)


def test_decontamination(spark, docs, none):
    from tidemark.llm import decontamination as D

    r = random.Random(9)
    for _ in range(300):
        p = bytes(r.choice(b"abc") for _ in range(r.randint(5, 20)))
        q = bytearray(p)
        for _ in range(r.randint(0, 4)):
            i = r.randrange(len(q))
            r.choice([lambda: q.__setitem__(i, 120), lambda: q.insert(i, 121), lambda: q.__delitem__(i)])()
        t = b"ca" + bytes(q) + b"bb"
        for k in (0, 1, 3):
            found = D.within(p, t, k)
            assert (found is not None) == (_edits(p, t) <= k) and (not found or _edits(p, t[found[0] : found[1]]) <= k)
    items = [(i, _text(r, 40)) for i in range(6)] + [(7, "short"), (8, None), (None, _text(r, 40))]
    bench = spark.createDataFrame(items, "item_id long, text string").withColumn("doc_id", F.lit(0))
    dirty = []
    for i in range(6):
        words = items[i][1].split()
        words[5] = words[5] + "x"
        dirty.append((1000 + i, _text(r, 30) + "\n" + " ".join(words).upper() + " " + _text(r, 30)))
    table = docs.select("doc_id", "text").unionByName(spark.createDataFrame(dirty, "doc_id long, text string"))
    for most in (4 << 20, 300):
        made = {x["doc_id"]: {h["item_id"] for h in x["hits"]} for x in D.find(table, bench, most_bytes=most).collect()}
        assert {k: v for k, v in made.items() if v} == {1000 + i: {i} for i in range(6)} and len(made) == table.count()
    clean = D.keep_clean(table, bench)
    assert clean.columns == table.columns and clean.count() == docs.count()
    assert D.find(none, bench).count() == 0 and D.find(docs, bench.limit(0)).count() == docs.count()


def test_decontamination_of_excerpts(spark):
    """Exact excerpts of 96 bytes are found wherever they begin in an item, and short items as whole words."""
    from tidemark.llm import decontamination as D

    r = random.Random(10)
    item = _text(r, 60)[:200]
    bench = spark.createDataFrame([(1, item), (2, "Grumpf  blarg"), (3, " "), (4, "")], "item_id long, text string")
    rows = [(i, _text(r, 20) + "; " + item[i : i + 96] + " ;" + _text(r, 20)) for i in range(105)]
    rows += [(200, "so grumpf  BLARG."), (201, "so xgrumpf  blarg"), (202, "so grumpf blarg"), (203, "grumpf  blarg"), (204, _text(r, 50)), (205, None), (206, "")]
    made = {x["doc_id"]: {h["item_id"] for h in x["hits"]} for x in D.find(spark.createDataFrame(rows, "doc_id long, text string"), bench).collect()}
    assert {k: v for k, v in made.items() if v} == {i: {1} for i in range(105)} | {200: {2}, 203: {2}}


def test_decontamination_with_edits(spark):
    """Windows are found with up to their budget of edits anywhere, and none that costs more; against the edit distance."""
    from tidemark.llm import decontamination as D

    r = random.Random(21)
    lengths = [16, 17, 19, 20, 25, 30, 31, 39, 40, 47, 62, 64]
    items = [(i, _text(r, 30)[:n]) for i, n in enumerate(lengths)]
    rows = []
    for i in range(240):
        text = list(items[i % 12][1])
        for _ in range(r.randint(0, 7)):
            at = r.randrange(len(text))
            r.choice([lambda: text.__setitem__(at, "#"), lambda: text.insert(at, "+"), lambda: text.__delitem__(at)])()  # noqa: B023
        rows.append((i, _text(r, 3) + " " + "".join(text) + " " + _text(r, 3)))
    made = {x["doc_id"]: {h["item_id"] for h in x["hits"]} for x in D.find(spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")).collect()}
    want = {i: {k for k, item in items if _edits(item, text) <= int(len(item) * 0.065)} for i, text in rows}
    assert made == want and 60 < sum(map(bool, want.values())) < 230
    assert all(any(w == {k} for w in want.values()) for k in range(12))


def test_decontamination_in_one_stage(spark):
    """A plan has one Python stage for any number of parts; rows that repeat a doc_id keep their own hits."""
    from tidemark.llm import decontamination as D

    r = random.Random(3)
    bench = spark.createDataFrame([(i, _text(r, 40)) for i in range(40)], "item_id long, text string")
    first = bench.orderBy("item_id").first()["text"]
    rows = spark.createDataFrame([(1, first), (1, "clean"), (2, "x " + first[:39].replace("a", "o", 1) + " y"), (None, first)], "doc_id long, text string").withColumns({"_number": F.lit(1), "_row": F.lit(2), "hits": F.lit(3)})
    made = D.find(rows, bench, most_bytes=300)
    assert made._jdf.queryExecution().executedPlan().toString().count("MapInArrow") == 0
    assert sorted((x["doc_id"] or 0, len(x["hits"]) > 0) for x in made.collect()) == [(0, True), (1, False), (1, True), (2, False)]
    clean = D.keep_clean(rows, bench, most_bytes=300)
    assert clean.columns == rows.columns and sorted(x["text"] for x in clean.collect()) == sorted(["clean", "x " + first[:39].replace("a", "o", 1) + " y"])
    assert D.keep_clean(rows, spark.createDataFrame([(1, first[:39])], "item_id long, text string")).count() == 1


def test_sharding(spark, docs, none):
    from tidemark.llm.sharding import shard

    group = spark.range(500, 620).select(F.col("id").alias("doc_id"), F.lit("the same text").alias("text"))
    table = docs.select("doc_id", "text").unionByName(group).unionByName(spark.createDataFrame([(None, "z")], "doc_id long, text string"))
    made = shard(table, shards=7).toPandas()
    sizes = made.groupby("shard").size()
    assert len(made) == table.count() and len(sizes) == 7 and sizes.max() - sizes.min() <= 1 and (made.law == "rows").all()
    for _, g in made.groupby("shard"):
        assert sorted(g.slot) == list(range(len(g)))
    assert made[made.doc_id >= 500].shard.value_counts().head(5).sum() >= 100
    data = _data(table.where("doc_id is not null"))
    assert all(x.text_crc32 == zlib.crc32(data[x.doc_id].encode()) and x.size == len(data[x.doc_id].encode()) + 16 for x in made[made.doc_id.notna()][["doc_id", "text_crc32", "size"]].itertuples())
    assert shard(none, 7).count() == 0


def test_sharding_keeps_groups_whole(spark):
    """Beside a group of a third of the rows, groups of up to a few hundred and many small ones stay whole where seats allow it."""
    from tidemark.llm.sharding import shard

    r = random.Random(5)
    texts = ["hot"] * 4000 + [f"large {i}" for i in range(6) for _ in range(250)]
    while len(texts) < 9000:
        texts += [f"small {len(texts)}"] * r.randint(2, 5)
    texts += [f"single {i}" for i in range(12000 - len(texts))]
    r.shuffle(texts)
    made = shard(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), shards=40).toPandas()
    sizes = made.shard.value_counts()
    assert len(made) == len(texts) and set(sizes) == {300} and len(sizes) == 40
    made["text"] = [texts[i] for i in made.doc_id]
    spread = made.groupby("text").shard.nunique()
    assert spread["hot"] == 14 and spread.drop("hot").max() == 1
    # Without documents that stand alone the seats don't work out for all; at most a shard's last group is cut.
    texts = [f"{i // 3}" for i in range(1000)]
    made = shard(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), shards=7).toPandas()
    made["text"] = [texts[i] for i in made.doc_id]
    assert made.shard.value_counts().max() - made.shard.value_counts().min() <= 1 and (made.groupby("text").shard.nunique() > 1).sum() <= 7
    # Fewer rows than shards.
    assert sorted(shard(spark.createDataFrame([(1, "a"), (2, "a"), (3, None)], "doc_id long, text string"), 5).toPandas().groupby("shard").size()) == [1, 1, 1]


def test_toxicity(spark, none):
    from tidemark.llm.toxicity import Lexicon, fold, keep_mild, learn, score, weigh

    assert fold("L0SER ｈｅｙ Іdiot 2024") == "loser hey idiot 2024"
    assert fold("1diot a$$ b!tch idiot5 wow! $5 3000 @home 2024abc b00b") == "idiot ass bitch idiot5 wow! $5 3000 @home 2024abc boob"
    r = random.Random(8)
    rows, labels = [], []
    for i in range(600):
        words = [_word(r) for _ in range(r.randint(5, 60))]
        toxic = i % 8 == 0
        if toxic:
            words.insert(r.randrange(len(words)), r.choice(["grumpf" + s for s in ("", "en", "ist")] + ["blarg"] * 3))
        if i % 80 == 1:
            words.extend(["nice", "blarg"])
        rows.append((i, " ".join(words)))
        labels.append((i, int(toxic)))
    docs = spark.createDataFrame([*rows, (900, None), (901, ""), (902, "hey gr0mp you grümpf"), (903, "so grumpfling today")], "doc_id long, text string").withColumn("score", F.lit(1))
    made = learn(docs, spark.createDataFrame([(i, t) for i, t in labels if i % 5], "doc_id long, toxic int"))
    assert "grumpf" in made.stems and ("<", "nice", "blarg") in made.exceptions
    got = {x["doc_id"]: x["predicted"] for x in score(docs, made).collect()}
    wrong = [i for i, t in labels if i % 5 == 0 and got[i] != t]
    assert len(wrong) <= 2 and got[900] == got[901] == 0 and got[903] == 1 and len(got) == docs.count()
    kept = keep_mild(docs, made)
    assert kept.columns == docs.columns and {x["doc_id"] for x in kept.select("doc_id").collect()} == {i for i, p in got.items() if not p}
    empty = learn(docs, spark.createDataFrame([], "doc_id long, toxic int"))
    assert not empty.stems and score(docs, empty).where("predicted = 1").count() == 0
    assert score(none, made).count() == 0 and weigh("x", Lexicon(), None) == 0.0


def test_components(spark):
    from tidemark.llm.components import components
    from tidemark.llm.scratch import Scratch

    edges = [(i, i + 1) for i in range(30)] + [(100, 101), (101, 100), (200, 200), (300, 302), (301, 302)] + [(500, 500 + i) for i in range(1, 60)]
    made = dict(components(spark.createDataFrame(edges, "a long, b long"), Scratch(spark, "t")).collect())
    want = {i: 0 for i in range(31)} | {100: 100, 101: 100} | {i: 300 for i in (300, 301, 302)} | {500 + i: 500 for i in range(60)}
    assert made == want


def test_ranked(spark):
    from tidemark.llm.ranking import ranked
    from tidemark.llm.scratch import Scratch

    rows = spark.range(1000).select((F.col("id") % 3).alias("k"), (F.col("id") * 7 % 1000).alias("v"))
    made = ranked(rows, "k", [F.col("v")], Scratch(spark, "t")).toPandas()
    for _, g in made.groupby("k"):
        assert list(g.sort_values("v")["rank"]) == list(range(1, len(g) + 1))
