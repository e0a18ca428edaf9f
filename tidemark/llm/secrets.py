"""Secrets in texts: key patterns, and tokens that a battery of randomness tests can't tell from random.

All of it is column expressions. A pattern's matches and the gaps between them give their places. Each long token is taken
to be of the smallest encoding that has its letters; under the hypothesis that it was drawn at random from that alphabet,
uniformity (chi-squared), runs about the middle and serial correlation give p-values, combined by Fisher's method. Within
classes of length, Benjamini-Hochberg says which tokens are not random. Of the others, those are secrets that can't be natural
either: names made of words pass the battery now and then, so each token's likelihood under a model of letters that follow each
other is set against that of its alphabet. The ratio bounds the p-value of a natural token, and Benjamini-Hochberg within classes
of length bounds the share of harmless tokens among those reported.
"""

from __future__ import annotations

import math
from collections import Counter

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.scratch import Scratch

# The patterns that are looked for, and the encodings with their alphabets from small to large.
ASSIGN = r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{16,}"
HEX = r"[0-9a-f]{24,}"
TOKEN = r"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{20,}+=*"
_DIGITS, _LOW, _UP = "0123456789", "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
ENCODINGS = [
    ("^[0-9a-f]+$", _DIGITS + "abcdef"),
    ("^[0-9A-F]+$", _DIGITS + "ABCDEF"),
    ("^[A-Z2-7]+$", _UP + "234567"),
    ("^[0-9a-z]+$", _DIGITS + _LOW),
    ("^[0-9A-Z]+$", _DIGITS + _UP),
    ("^[0-9A-Za-z]+$", _DIGITS + _UP + _LOW),
    ("^[0-9A-Za-z+/]+$", _UP + _LOW + _DIGITS + "+/"),
    ("^[0-9A-Za-z_-]+$", _UP + _LOW + _DIGITS + "-_"),
]
#: Classes of token length, by their least; longer tokens give the tests more power, so each class has a limit of its own.
LENGTHS = (20, 28, 40, 64)
#: Words from which the pairs of letters of natural tokens are counted: a parameter, any text of the languages at hand will do.
WORDS = """
the and that have with this from they would there their what about which when make like time just know people into year good some could
them other than then look only come over think also back after use two how our work first well even want because any these give day most
user name data file path index value type page test image config server client table query model order price market system report project
der die und nicht eine sich mit auch werden haben sein nach bei einer noch wie einem zeit oder wenn mehr schon gegen durch jahr stadt haus
arbeit leben welt kinder wasser schule freund que los del las una por con para como pero este entre cuando todo esta sobre hasta donde
quien desde nosotros ciudad trabajo tiempo mundo casa gobierno persona mujer historia nombre les des une dans pour pas sur plus avec tout
faire comme nous vous mais elle leur bien sans autre temps monde jour maison ville travail enfant homme femme histoire
"""
#: How a natural token goes on, from small letter, capital, digit or sign to each of these; the last row is how it begins.
GOES_ON = [(0.85, 0.06, 0.03, 0.06), (0.42, 0.48, 0.05, 0.05), (0.08, 0.08, 0.70, 0.14), (0.45, 0.25, 0.25, 0.05), (0.50, 0.30, 0.15, 0.05)]
_DIGIT, _SIGN = 0.1, 0.3  # of one digit among digits, one sign among signs
_FARTHEST = 140.0  # -ln of a p-value beyond which it makes no difference
_STEPS = 1_000_000  # levels for each unit of -ln p, so p-values count as equal within a millionth of themselves
_WIDE = 1 << 14  # levels in a bin; p-values are above exp(-140), so there are at most 8,600 bins
_NEVER = 1 << 62


def _literal(pattern: str) -> str:
    return "'" + pattern.replace("\\", "\\\\").replace("'", "\\'") + "'"


def _matches(text: str, pattern: str, kind: int) -> str:
    """SQL: the pattern's matches in order, each with kind, begin and end in code points.

    Places are running sums of the lengths of gaps and matches, taken in blocks of about the square root of their number, as a
    sum over all before each would take time with the square of it.
    """
    p = _literal(pattern)
    more = "(acc, x) -> concat(acc, array(element_at(acc, -1) + x))"
    parts = f"zip_with(split({text}, {p}, -1), regexp_extract_all({text}, {p}, 0), (g, m) -> named_struct('g', length(g), 'm', m))"
    step = "cast(ceil(sqrt(size(q.n))) as int)"
    blocks = f"transform(sequence(0, size(q.n) - 1, greatest({step}, 1)), i -> slice(q.n, i + 1, greatest({step}, 1)))"
    starts = "aggregate(transform(q.b, x -> aggregate(x, 0L, (s, y) -> s + y)), array(0L), {more})".replace("{more}", more)
    ends = f"flatten(transform(zip_with(q.b, slice({starts}, 1, size(q.b)), (b, s) -> named_struct('b', b, 's', s)), y -> slice(aggregate(y.b, array(y.s), {more}), 2, size(y.b))))"
    placed = "zip_with(q.p, q.e, (x, e) -> named_struct('begin', e - length(x.m), 'kind', {kind}, 'end', e, 'text', x.m))".replace("{kind}", str(kind))
    let = lambda value, body: f"element_at(transform(array({value}), q -> {body}), 1)"
    lengths = "transform(q.p, x -> cast(x.g + coalesce(length(x.m), 0) as bigint))"
    known = let(f"named_struct('p', {parts})", f"named_struct('p', q.p, 'n', {lengths})")
    known = let(known, f"named_struct('p', q.p, 'n', q.n, 'b', {blocks})")
    known = let(known, f"named_struct('p', q.p, 'e', {ends})")
    return f"filter({let(known, placed)}, m -> m.text is not null)"


_NONE = "cast(array() as array<struct<begin: bigint, kind: int, end: bigint, text: string>>)"


def _spans(docs: DataFrame, *keep: str) -> DataFrame:
    """Of ``docs`` (text) the columns ``keep``, and assign, access, hexes and token: arrays of places, tokens with their class of
    length and level; texts without a pattern's letters skip its search."""
    t = "coalesce(text, '')"
    value = f"regexp_extract(m.text, {_literal(ASSIGN)}, 1)"
    found = docs.select(
        *keep,
        F.expr(f"if({t} rlike '[:=]' and {t} rlike {_literal(ASSIGN)}, filter({_matches(t, ASSIGN, 0)}, m -> length({value}) >= 6), {_NONE})").alias("assign"),
        F.expr(f"if(contains({t}, 'AKIA'), {_matches(t, ACCESS, 1)}, {_NONE})").alias("access"),
        F.expr(f"if({t} rlike {_literal(HEX)}, {_matches(t, HEX, 2)}, {_NONE})").alias("hexes"),
        F.expr(
            f"if({t} rlike {_literal(TOKEN)}, filter({_matches(t, TOKEN, 3)}, m -> m.text rlike '[0-9]' and m.text rlike '[A-Za-z]'), {_NONE})"
        ).alias("_tokens"),
    )
    scored = F.transform("_tokens", lambda m: F.struct(m["begin"].alias("begin"), m["kind"].alias("kind"), m["end"].alias("end"), m["text"].alias("text"), _length_class(m["text"]).alias("class"), _level(m["text"]).alias("level"), _strangeness(m["text"]).alias("strange")))
    return found.withColumn("token", scored).drop("_tokens")


def _encoded(token: Column) -> tuple[Column, Column]:
    """The token without padding, and the letters of the smallest encoding that has all of its."""
    body = F.regexp_replace(token, "=+$", "")
    alphabet = F.lit(ENCODINGS[-1][1])
    for pattern, letters in reversed(ENCODINGS):
        alphabet = F.when(body.rlike(pattern), letters).otherwise(alphabet)
    return body, alphabet


def p_value(token: Column) -> Column:
    """How well ``token`` passes for random letters of its encoding: Fisher's combination of the three tests, 0 to 1."""
    body, alphabet = _encoded(token)
    made = F.array(F.struct(body.alias("body"), alphabet.alias("alphabet")))

    def tests(s: Column) -> Column:
        codes = F.transform(F.filter(F.split(s["body"], ""), lambda c: c != ""), lambda c: (F.instr(s["alphabet"], c) - 1).cast("double"))
        return F.struct(codes.alias("codes"), F.length(s["alphabet"]).cast("double").alias("k"), s["body"].alias("body"))

    def value(s: Column) -> Column:
        codes, k = s["codes"], s["k"]
        n = F.size(codes).cast("double")
        counts = F.transform(F.array_distinct(codes), lambda c: F.size(F.filter(codes, lambda d: d == c)).cast("double"))
        total = lambda xs: F.aggregate(xs, F.lit(0.0), lambda a, x: a + x)
        chi = total(F.transform(counts, lambda c: c * c)) * k / n - n
        uniform = (chi - (k - 1)) / F.sqrt(2 * (k - 1) * (n - 1) / n)
        highs = F.transform(codes, lambda c: F.when(c > (k - 1) / 2, 1.0).otherwise(0.0))
        high = total(highs)
        low = n - high
        steps = F.zip_with(F.slice(highs, 1, F.size(codes) - 1), F.slice(highs, 2, F.size(codes)), lambda a, b: F.abs(a - b))
        mean = 2 * high * low / n + 1
        spread = F.sqrt(F.greatest((mean - 1) * (mean - 2) / (n - 1), F.lit(1e-9)))
        runs = F.when((high == 0) | (low == 0), 8.0).otherwise(F.abs(total(steps) + 1 - mean) / spread)
        centre = total(codes) / n
        off = F.transform(codes, lambda c: c - centre)
        square = total(F.transform(off, lambda c: c * c))
        lag = total(F.zip_with(F.slice(off, 1, F.size(codes) - 1), F.slice(off, 2, F.size(codes)), lambda a, b: a * b))
        serial = F.when(square == 0, 8.0).otherwise(F.abs(lag / square + 1 / n) * F.sqrt(n))
        fisher = -2 * (_log_tail(uniform) + F.least(F.lit(0.0), _log_tail(runs) + F.log(F.lit(2.0))) + F.least(F.lit(0.0), _log_tail(serial) + F.log(F.lit(2.0))))
        h = fisher / 2
        return F.exp(-h) * (1 + h + h * h / 2)

    return F.transform(F.transform(made, tests), value)[0]


def _log_tail(z: Column) -> Column:
    """The logarithm of the normal upper tail, by the logistic curve 1.5976 z + 0.07056 z^3."""
    z = F.least(F.greatest(z, F.lit(-8.0)), F.lit(8.0))
    return -F.log1p(F.exp(1.5976 * z + 0.07056 * z * z * z))


def _letter_logs() -> tuple[list[float], list[float]]:
    """ln of each letter's share in ``WORDS``, and of each letter's after each other, smoothed towards it."""
    words = WORDS.split()
    ones, pairs = Counter("".join(words)), Counter(p for w in words for p in zip(w, w[1:], strict=False))
    total, before = sum(ones.values()), Counter()
    for (a, _), n in pairs.items():
        before[a] += n
    share = {c: (ones[c] + 0.5) / (total + 13) for c in _LOW}
    return [math.log(share[c]) for c in _LOW], [math.log((pairs[a, b] + 8 * share[b]) / (before[a] + 8)) for a in _LOW for b in _LOW]


def natural_odds(token: Column) -> Column:
    """ln of the token's likelihood as a natural one less that as random letters of its encoding.

    Of random tokens e to this power is 1 in the mean, and of natural ones e to less this, so e to this is a bound of the p-value
    that a natural token has it.
    """
    body, alphabet = _encoded(token)
    ones, pairs = (F.array(*[F.lit(x) for x in xs]) for xs in _letter_logs())
    goes = F.array(*[F.lit(math.log(x)) for row in GOES_ON for x in row])
    code = lambda c: F.when(c.rlike("[a-z]"), 0).when(c.rlike("[A-Z]"), 1).when(c.rlike("[0-9]"), 2).otherwise(3)
    letter = lambda c: F.ascii(F.lower(c)) - 97
    made = F.array(F.struct(F.filter(F.split(body, ""), lambda c: c != "").alias("letters"), F.log(F.length(alphabet)).alias("size")))
    coded = F.transform(made, lambda s: F.struct(s["size"].alias("size"), F.transform(s["letters"], lambda c: F.struct(code(c).alias("k"), letter(c).alias("l"))).alias("c")))

    def one(s: Column, x: Column, i: Column) -> Column:
        last = F.get(s["c"], i - 1)
        way = F.element_at(goes, F.coalesce(last["k"], F.lit(4)) * 4 + x["k"] + 1)
        within = (last["k"] <= 1) & ~((last["k"] == 0) & (x["k"] == 1))
        drawn = F.when(within, F.try_element_at(pairs, last["l"] * 26 + x["l"] + 1)).otherwise(F.try_element_at(ones, x["l"] + 1))
        return way + s["size"] + F.when(x["k"] <= 1, drawn).when(x["k"] == 2, math.log(_DIGIT)).otherwise(math.log(_SIGN))

    return F.transform(coded, lambda s: F.aggregate(F.transform(s["c"], lambda x, i: one(s, x, i)), F.lit(0.0), lambda a, x: a + x))[0]


def _length_class(token: Column) -> Column:
    return sum(F.when(F.length(token) >= least, 1).otherwise(0) for least in LENGTHS) - F.lit(1)


def _level(token: Column) -> Column:
    """-ln of the token's p-value in whole steps: the higher, the less random."""
    return F.floor(F.greatest(-F.log(p_value(token)), F.lit(0.0)) * _STEPS).cast("long")


def _strangeness(token: Column) -> Column:
    """-ln of the bound of the token's p-value as a natural one in whole steps: the higher, the less natural."""
    return F.floor(F.least(F.greatest(-natural_odds(token), F.lit(0.0)), F.lit(_FARTHEST)) * _STEPS).cast("long")


def limits(scanned: DataFrame, rates: tuple[float, float]) -> tuple[list[int], list[int]]:
    """For each length class the least level that Benjamini-Hochberg calls not random, and the least strangeness that it calls not
    natural, at the two ``rates``, over all tokens of ``scanned`` (``_spans``, saved); ``_NEVER`` where it calls none so. Counts in
    bins of levels reach the driver, then the counts of each level in those bins where the limit can be.

    The first rate bounds the share of random tokens among those let go for not being random, the second that of natural ones
    among those that are not let go for being natural.
    """
    n = len(LENGTHS)
    both = F.array(F.struct(F.col("m.class").alias("class"), F.col("m.level").alias("level")), F.struct((F.col("m.class") + n).alias("class"), F.col("m.strange").alias("level")))
    scores = scanned.select(F.explode("token").alias("m")).select(F.explode(both).alias("x")).select("x.class", "x.level")
    rate = [r for r in rates for _ in LENGTHS]
    bins = scores.groupBy("class", F.expr(f"level div {_WIDE}").alias("bin")).agg(F.count("*").alias("n")).collect()
    totals = [sum(r["n"] for r in bins if r["class"] == c) for c in range(2 * n)]
    # From the largest p-values on: bins that can hold the limit, up to one that lies below the line as a whole.
    open_bins: list[tuple[int, int, int]] = []
    for c, total in enumerate(totals):
        left = total
        for b, count in sorted((r["bin"], r["n"]) for r in bins if r["class"] == c):
            line = rate[c] * left / total
            left -= count
            if math.exp(-((b + 1) * _WIDE - 1) / _STEPS) <= line:
                open_bins.append((c, b, left))
            if math.exp(-b * _WIDE / _STEPS) <= line:
                break
    found = [_NEVER] * (2 * n)
    if open_bins:
        wanted = F.concat_ws(":", "class", F.expr(f"level div {_WIDE}")).isin([f"{c}:{b}" for c, b, _ in open_bins])
        levels = scores.where(wanted).groupBy("class", "level").agg(F.count("*").alias("n")).collect()
        for c, b, above in open_bins:
            left = above
            for level, count in sorted(((r["level"], r["n"]) for r in levels if r["class"] == c and r["level"] // _WIDE == b), reverse=True):
                left += count
                if math.exp(-level / _STEPS) <= rate[c] * left / totals[c]:
                    found[c] = min(found[c], level)
    return found[:n], found[n:]


def _found(docs: DataFrame, rates: tuple[float, float], *keep: str) -> DataFrame:
    """Of ``docs`` (text) the columns ``keep``, assign, access, hexes, base and spans. Texts are searched once, and what is found
    is written, as the limits need the tokens of all of them."""
    scanned = Scratch(docs.sparkSession, "secrets").save(_spans(docs, *keep))
    random, natural = (F.array(*[F.lit(x) for x in found]) for found in limits(scanned, rates))
    base = scanned.withColumn("base", F.array_sort(F.concat("assign", "access", "hexes")))
    clear = F.filter("token", lambda m: (m["level"] < F.element_at(random, m["class"] + 1)) & (m["strange"] >= F.element_at(natural, m["class"] + 1)) & ~F.exists("base", lambda b: (b["begin"] < m["end"]) & (m["begin"] < b["end"])))
    clear = F.transform(clear, lambda m: F.struct(*[m[c].alias(c) for c in ("begin", "kind", "end", "text")]))
    return base.withColumn("spans", F.array_sort(F.concat(F.col("base"), clear))).drop("token")


def _packed(docs: DataFrame) -> DataFrame:
    """``docs`` with all its columns in one, so that none of their names can be met, and its text."""
    return docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row"), F.col("text").cast("string").alias("text"))


RATES = (0.05, 0.01)  # of random tokens let go, and of natural ones reported


def find(docs: DataFrame, rates: tuple[float, float] = RATES) -> DataFrame:
    """Add to each row of ``docs`` (text) ``base`` and ``spans``: arrays of (begin, kind, end, text), by begin, then kind.

    Kinds: 0 assign, 1 access, 2 hex, 3 random token. Base spans are those of the first three; ``spans`` adds the random
    tokens that touch none of them. Null and empty texts have empty arrays; repeated rows come out alike; other columns are kept
    whatever their names, but for those named ``base`` or ``spans``, which are replaced.
    """
    found = _found(_packed(docs), rates, "_row")
    return found.select(*[F.col("_row").getField(c).alias(c) for c in docs.columns if c not in ("base", "spans")], "base", "spans")


def joined(spans: Column) -> Column:
    """kind:begin:end of each span, comma-joined."""
    name = lambda m: F.element_at(F.array(*[F.lit(k) for k in ("assign", "access", "hex", "random")]), m["kind"] + 1)
    return F.array_join(F.transform(spans, lambda m: F.concat_ws(":", name(m), m["begin"].cast("string"), m["end"].cast("string"))), ",")


def digest(docs: DataFrame) -> DataFrame:
    found = _found(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")), RATES, "doc_id")
    size = lambda c: F.size(c).cast("long")
    return found.select(
        "doc_id",
        size("assign").alias("n_assign"),
        size("access").alias("n_access"),
        size("hexes").alias("n_hex"),
        F.sha2(joined(F.col("base")), 256).alias("base_sha256"),
        joined(F.col("spans")).alias("spans"),
    )


def redact(docs: DataFrame, mark: str = "[secret]") -> DataFrame:
    """``docs`` with every span of its texts replaced by ``mark``; overlapping spans are one. Texts without spans stay, null
    and empty ones too, as do all other columns."""
    found = _found(_packed(docs), RATES, "_row")
    # Spans that touch are merged; what remains of the text are the gaps between them, each cut out once.
    text = "cast(_row.text as string)"
    step = "(acc, m) -> if(size(acc) > 0 and m.begin < element_at(acc, -1).end, concat(slice(acc, 1, size(acc) - 1), array(named_struct('begin', element_at(acc, -1).begin, 'end', greatest(element_at(acc, -1).end, m.end)))), concat(acc, array(named_struct('begin', m.begin, 'end', m.end))))"
    merged = f"aggregate(spans, cast(array() as array<struct<begin: bigint, end: bigint>>), {step})"
    begins = "concat(array(0L), transform(x, m -> m.end))"
    ends = f"concat(transform(x, m -> m.begin), array(cast(length({text}) as bigint)))"
    gaps = f"zip_with({begins}, {ends}, (a, z) -> substring({text}, cast(a + 1 as int), cast(z - a as int)))"
    kept = F.expr(f"if(size(spans) = 0, {text}, element_at(transform(array({merged}), x -> array_join({gaps}, {_literal(mark)})), 1))")
    return found.select(*[(kept if c == "text" else F.col("_row").getField(c)).alias(c) for c in docs.columns])
