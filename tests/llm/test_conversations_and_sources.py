"""Conversation repair, source divergence and chat formatting against brute-force versions and an exact round trip."""

import functools
import hashlib
import itertools
import random
import re
import zlib
from collections import Counter, defaultdict
from fractions import Fraction

import pytest
from pyspark.sql import functions as F

SPACE = " \t\n\x0b\x0c\r"
ROWS = "conv_id long, turn long, role string, text string"


def _clashing(df):
    return df.withColumns({c: F.lit(1) for c in ("name", "place", "letter", "signature", "n", "block", "rank", "value", "term", "made", "loss", "id", "batch")})


def _cheapest(rows):
    """Cost, audit and rows of the best edits, tried one after the other from the front."""
    due = {"": "u", "s": "u", "u": "a", "a": "u"}
    full = {"u": "user", "a": "assistant"}

    @functools.cache
    def best(i, last, inserted):
        options = []
        if i == len(rows) and last in ("", "a"):
            options.append((0, "", ()))
        if inserted < 3:
            role = due[last]
            c, a, r = best(i, role, inserted + 1)
            options.append((c + 3, "I" + a, (full[role] + ":", *r)))
        if i < len(rows):
            role, text, fault = rows[i]
            c, a, r = best(i + 1, last, 0)
            options.append((c + 4, "D" + a, r))
            if fault not in ("blank", "duplicate"):
                extra = 3 * (fault == "truncated")
                to = due[last]
                c, a, r = best(i + 1, to, 0)
                options.append((c + extra + 3, "R" + a, (f"{full[to]}:{text}", *r)))
                first = role[:1]
                if first == to or (first, last) == ("s", ""):
                    c, a, r = best(i + 1, first, 0)
                    options.append((c + extra, "K" + a, (f"{role}:{text}", *r)))
        return min(options) if options else (10**9, "", ())

    return best(0, "", 0)


def _audited(rows, damage=True):
    by = defaultdict(list)
    want = {}
    for conv, turn, role, text in rows:
        want[conv] = None
        role, text = " " if role is None else role, " " if text is None else text
        kind = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20 if damage else 9
        if kind == 0:
            continue
        text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
        by[conv] += [(turn, "user" if kind == 4 else role, text)] * (2 if kind == 3 else 1)
    for conv in want:
        there = sorted(by[conv], key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode(), hashlib.sha256(r[2].encode()).hexdigest()))
        seen, faulty = set(), []
        for _, role, text in there:
            bare = text.rstrip(SPACE)
            faulty.append((role, text, "blank" if not bare else "duplicate" if (role, text) in seen else "" if bare[-1] in ".!?" else "truncated"))
            seen.add((role, text))
        turns = {t for t, _, _ in there if t is not None}
        cost, audit, made = _cheapest(tuple(faulty)) if faulty else (0, "", ())
        count = Counter(f for _, _, f in faulty)
        illegal = sum(a[0][:1] + b[0][:1] not in ("su", "ua", "au") for a, b in itertools.pairwise(faulty))
        want[conv] = (max(turns) - min(turns) + 1 - len(turns) if turns else 0, count["blank"], count["duplicate"], count["truncated"], illegal, cost, audit, hashlib.sha256("\n".join(made).encode()).hexdigest())
    return want


@pytest.fixture(scope="module")
def talks():
    r = random.Random(11)
    texts = ["Yes.", "No!", "Why?", "cut off", "", " \n", "a.b", "Fine. \t", "é！", None]
    rows = []
    for conv in range(250):
        odd = r.random() < 0.4
        for turn in range(r.randint(1, 9)):
            role = r.choice(["user", "assistant", "system", "tool", "", "User", None]) if odd and r.random() < 0.4 else ("assistant" if turn % 2 else "user")
            rows.append((None if conv == 7 else conv, None if r.random() < 0.03 else turn * r.choice([1, 1, 2]), role, r.choice(texts) if r.random() < 0.5 else f"Text {conv} {turn}."))
    return rows + rows[:30] + [(900, 1, "user", None), (901, None, None, None)]


def test_conversation_repair(spark, talks):
    from tidemark.llm.conversation_repair import repair

    columns = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]
    for damage in (True, False):
        made = repair(_clashing(spark.createDataFrame(talks, ROWS)), damage).collect()
        assert {x["conv_id"]: tuple(x[c] for c in columns) for x in made} == _audited(talks, damage) and len(made) == len({t[0] for t in talks})
    assert repair(_clashing(spark.createDataFrame([], ROWS))).count() == 0


def test_conversation_repair_of_long_and_equal_conversations(spark):
    from tidemark.llm import conversation_repair as R

    # One of 4,000 rows with a row that is repeated 1,500 times, two megabytes in one text, and 300 equal conversations.
    long_ = [(1, i, "user" if i % 3 else "assistant", "Again." if i < 1500 else f"Row {i}") for i in range(4000)]
    rows = [*long_, (2, 0, "user", "word " * 400_000 + "."), (2, 1, "assistant", "So."), *[(c, t, r, f"{t}.") for c in range(10, 310) for t, r in enumerate(["user", "user", "assistant"])]]
    made = {x["conv_id"]: x for x in R.repair(spark.createDataFrame(rows, ROWS), damage=False).collect()}
    assert made[1]["duplicate"] == 1498 and len(made[1]["audit"]) == 4000 + made[1]["audit"].count("I") and made[2]["audit"] == "KK"
    assert {(x["cost"], x["audit"]) for c, x in made.items() if c >= 10} == {(3, "KIKK")}
    # What ends alike is priced once.
    known = R.SharedSuffixes()
    ends = sorted("".join(s) for n in range(1, 6) for s in itertools.product("AEI", repeat=n))
    solved = {s: known.solve(s)[1] for s in ends}
    assert known.made == len(ends) < sum(map(len, ends)) and solved["IE"] == "KK"


def _divergence(rows, least, own):
    by, docs, groups = defaultdict(Counter), defaultdict(Counter), defaultdict(set)
    for lang, source, text in rows:
        lang, source, text = lang or "", source or "", text or ""
        words = ["".join(c.lower() if "A" <= c <= "Z" else c for c in w) for w in re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", text)]
        by[lang, source].update(words)
        docs[lang].update(set(words))
        groups[lang].add(source)
    want = set()
    ranked = lambda found: enumerate(sorted(found, key=lambda x: (-x[1], x[0].encode())), 1)
    for lang, sources in groups.items():
        kept = [t for t, n in docs[lang].items() if n >= least]
        whole = sum((by[lang, s] for s in sources), Counter())
        share = lambda counts: {t: 1 + int(Fraction(10**9 * (counts[t] + 5), sum(counts[k] for k in kept) + 5 * len(kept))) for t in kept}
        q, p = share(whole), {s: share(by[lang, s]) for s in sources}
        for s in sources:
            want |= {(lang, s, "pair", o, v, k) for k, (o, v) in ranked([(o, sum(abs(p[s][t] - p[o][t]) for t in kept)) for o in sources - {s}])}
            want |= {(lang, s, "term", t, v, k) for k, (t, v) in ranked([(t, p[s][t] - q[t]) for t in kept if by[lang, s][t] and p[s][t] > q[t]]) if k <= own}
    return want


def test_source_divergence(spark):
    from tidemark.llm.source_divergence import divergence

    r = random.Random(12)
    words = [*(a + b for a in ("ka", "LO", "ñe", "漢") for b in ("x", "Y", "zé", "q")), "rare"]
    line = lambda lean: " ".join(r.choices(words, [1 + (k * lean) % 7 for k in range(len(words))], k=r.randint(0, 30)))
    rows = [(r.choice(["en", "de", None]), f"s{k % 11}" if k % 5 else "hot", line(k % 11)) for k in range(400)]
    rows += [("en", None, None), ("en", "", "12 _ 34"), ("fr", "only", "un deux"), ("fr", "autre", ""), ("fr", "autre", None), ("xx", "one", "lone"), *[("de", "s1", "same same-Same")] * 40]
    docs = spark.createDataFrame(rows, "lang string, source string, text string")
    for block, batch in ((3, 2), (32_768, 16)):
        made = {tuple(x) for x in divergence(_clashing(docs), least_docs=30, own_terms=5, block=block, batch=batch).select("lang", "source", "part", "item", "value", "rank").collect()}
        assert made == _divergence(rows, 30, 5)
    assert divergence(docs.limit(0)).count() == 0


def test_source_divergence_of_long_texts(monkeypatch, spark):
    from tidemark.llm import source_divergence as D

    text = "Éa bc,d" * 1000
    terms = lambda: list(itertools.chain(*D._terms(text.encode())))
    whole = terms()
    monkeypatch.setattr(D, "_PIECE", 7)
    assert terms() == whole and Counter(whole) == Counter({"Éa".encode(): 1, b"bc": 1000, "dÉa".encode(): 999, b"d": 1})
    monkeypatch.undo()
    long_ = [("en", "a", "word " * 1_000_000), ("en", "b", "x" * 5_000_000), ("en", "b", "word other")]
    made = D.divergence(spark.createDataFrame(long_, "lang string, source string, text string"), least_docs=1).where("part = 'pair'").collect()
    assert {(x["source"], x["item"], x["rank"]) for x in made} == {("a", "b", 1), ("b", "a", 1)} and made[0]["value"] == made[1]["value"] > 0


def test_chat_round_trip(spark):
    from tidemark.llm.chat_format import digest, format_chats, masked, parse

    r = random.Random(3)
    bits = ["### ", "</turn>", "</turn>\n", "\\", "<", "##", "# ", "#", ": ", ":", " ", "\n", "assistant", "user", "é", "😀", "/turn>", "<\\/turn>", "##\\# ", ":\\ ", "</turn", "$1", "\\\\"]
    some = lambda n: "".join(r.choice(bits) for _ in range(r.randint(0, n)))
    rows = [(c, r.choice([t, t, None]), some(3) if r.random() < 0.4 else r.choice(["user", "assistant", "system", None]), None if r.random() < 0.05 else some(9)) for c in range(300) for t in range(r.randint(1, 5))]
    rows += rows[:20] + [(None, 1, "assistant", "x"), (800, 1, "assistant", "### </turn>\n" * 200_000 + "long")]
    by = defaultdict(list)
    for conv, turn, role, text in rows:
        by[conv].append((turn is not None, turn or 0, role or "", text or ""))
    want = {c: [(role, text) for *_, role, text in sorted(turns, key=lambda t: (t[0], t[1], t[2].encode(), t[3].encode()))] for c, turns in by.items()}
    made = format_chats(_clashing(spark.createDataFrame(rows, ROWS)))
    read = made.select("conv_id", parse(F.col("formatted")).alias("turns"), masked(F.col("formatted"), F.col("loss")).alias("learned")).collect()
    assert {x["conv_id"]: [tuple(t) for t in x["turns"]] for x in read} == want and len(read) == len(want)
    assert all(x["learned"] == "".join(t for role, t in want[x["conv_id"]] if role == "assistant") for x in read)
    for x in digest(made).collect():
        lines = "".join(f"{role}\n{text}\n" for role, text in want[x["conv_id"]])
        assert x["turns_sha256"] == hashlib.sha256(lines.encode()).hexdigest() and x["n_turns"] == len(want[x["conv_id"]])
    assert format_chats(spark.createDataFrame([], ROWS)).count() == 0
