"""Format-preserving pseudonyms for personal data, by keyed Feistel permutations. Column expressions only.

A value's digits are split into two numbers that take turns: each is shifted, modulo the size of its own set, by a keyed
hash of the other. Every round can be undone, so different values stay different, and equal values get equal pseudonyms in
all documents. What a format fixes stays fixed: separators, lengths, the first digit and check digit of a card, the leading
digits of a phone number; dates move within the 400-year cycle of the calendar, where every day is valid.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

ROUNDS = 8

# The formats, in the order in which they are tried. Validation follows.
KINDS = {
    "email": r"(?<![\p{L}\p{M}\p{N}])[\p{L}\p{M}\p{N}._%+-]++@[\p{L}\p{M}\p{N}-]+(?:\.[\p{L}\p{M}\p{N}-]+)*\.\p{L}{2,}(?![\p{L}\p{M}\p{N}])",
    "ip": r"[0-9]{1,3}(?:\.[0-9]{1,3}){3}",
    "phone": r"(?:\+?1[ .-]?)?(?:\([0-9]{3}\) ?|[2-9][0-9]{2}[ .-])[0-9]{3}[ .-][0-9]{4}",
    "ssn": r"[0-9]{3}-[0-9]{2}-[0-9]{4}",
    "date": r"[0-9]{4}-[0-9]{2}-[0-9]{2}|[0-9]{2}[./][0-9]{2}[./][0-9]{4}",
    "card": r"[0-9](?:[ -]?[0-9]){12,18}",
}
#: Alphabets within which letters of addresses move, by first and last code point and step: digits, Latin without and with
#: marks, Greek, Cyrillic, Armenian, Hebrew, Arabic, Devanagari, Thai, Georgian, Hiragana, Katakana, Han, Hangul.
LETTERS = [
    (0x30, 0x39, 1), (0x61, 0x7A, 1), (0xE0, 0xF6, 1), (0xF8, 0xFF, 1), (0x101, 0x12F, 2), (0x133, 0x137, 2), (0x13A, 0x148, 2),
    (0x14B, 0x177, 2), (0x17A, 0x17E, 2), (0x3AC, 0x3AF, 1), (0x3B1, 0x3CB, 1), (0x3CC, 0x3CE, 1), (0x430, 0x44F, 1), (0x450, 0x45F, 1),
    (0x561, 0x586, 1), (0x5D0, 0x5EA, 1), (0x621, 0x63A, 1), (0x641, 0x64A, 1), (0x904, 0x939, 1), (0xE01, 0xE2E, 1), (0x10D0, 0x10FA, 1),
    (0x3041, 0x3096, 1), (0x30A1, 0x30FA, 1), (0x4E00, 0x9FFF, 1), (0xAC00, 0xD7A3, 1),
]
_MOVES = "".join(rf"\x{{{a:X}}}-\x{{{b:X}}}" for a, b, _ in LETTERS)
_BEFORE, _AFTER = r"(?<![A-Za-z0-9._%+@-])", r"(?![A-Za-z0-9@]|[.-][0-9A-Za-z])"
ANY = _BEFORE + "(?:" + "|".join(KINDS.values()) + ")" + _AFTER


def _literal(text: str) -> str:
    return "'" + text.replace("\\", "\\\\").replace("'", "\\'") + "'"


def _feistel(kind: str, a: str, b: str, size_a: str, size_b: str) -> str:
    """SQL: the struct (a, b) after all rounds; ``a`` is below ``size_a`` and ``b`` below ``size_b``.

    The key stands in the hash that drives the rounds, next to the kind and the sizes, so each format has its own permutation.
    """
    drawn = lambda other: f"cast(conv(substring(sha2(concat_ws('|', pii_key, '{kind}', {size_a}, {size_b}, r, {other}), 256), 1, 15), 16, 10) as bigint)"
    return (
        f"aggregate(sequence(1, {ROUNDS}), named_struct('a', cast({a} as bigint), 'b', cast({b} as bigint)), (s, r) -> "
        f"if(r % 2 = 1, named_struct('a', (s.a + {drawn('s.b')} % {size_a}) % {size_a}, 'b', s.b), "
        f"named_struct('a', s.a, 'b', (s.b + {drawn('s.a')} % {size_b}) % {size_b})))"
    )


def _let(value: str, name: str, body: str) -> str:
    """SQL: ``body`` with ``name`` standing for ``value``, which is then made once."""
    return f"element_at(transform(array({value}), {name} -> {body}), 1)"


def _permuted_digits(kind: str, digits: str) -> str:
    """SQL: a digit string of the same length; ``digits`` names a variable of 2 to 36 digits."""
    left = f"(length({digits}) div 2)"
    size = lambda n: f"cast(concat('1', repeat('0', {n})) as bigint)"
    mixed = _feistel(kind, f"substring({digits}, 1, {left})", f"substring({digits}, {left} + 1)", size(left), size(f"(length({digits}) - {left})"))
    return _let(mixed, "f", f"concat(lpad(cast(f.a as string), {left}, '0'), lpad(cast(f.b as string), length({digits}) - {left}, '0'))")


def _only_digits(m: str) -> str:
    return f"regexp_replace({m}, '[^0-9]', '')"


def _refilled(m: str, digits: str) -> str:
    """SQL: ``m`` with its digits replaced, in order, by those of ``digits``."""
    return _let(digits, "w", f"array_join(transform(split({m}, '(?<=.)'), (c, i) -> if(c rlike '[0-9]', substring(w, length({_only_digits(f'substring({m}, 1, i)')}) + 1, 1), c)), '')")


def _luhn(digits: str, doubled: int) -> str:
    """SQL: the weighted digit sum; ``doubled`` is the parity of the places from the right, counted from 0, that are doubled."""
    return (
        f"aggregate(sequence(1, length({digits})), 0, (s, i) -> s + if((length({digits}) - i) % 2 = {doubled}, "
        f"element_at(array(0, 2, 4, 6, 8, 1, 3, 5, 7, 9), cast(substring({digits}, i, 1) as int) + 1), cast(substring({digits}, i, 1) as int)))"
    )


def _card(m: str) -> str:
    body = _let("substring(d, 2, length(d) - 2)", "p", _permuted_digits("card", "p"))
    whole = _let(f"concat(substring(d, 1, 1), {body})", "q", f"concat(q, cast((10 - {_luhn('q', 0)} % 10) % 10 as string))")
    return _let(_only_digits(m), "d", f"if({_luhn('d', 1)} % 10 = 0 and not d rlike '^0+$', {_refilled(m, whole)}, null)")


def _phone(m: str) -> str:
    national = f"substring({_only_digits(m)}, -10, 10)"
    moved = _let("concat(substring(d, 2, 2), substring(d, 5, 6))", "p", _permuted_digits("phone", "p"))
    new = _let(moved, "q", f"concat(substring({_only_digits(m)}, 1, length({_only_digits(m)}) - 10), substring(d, 1, 1), substring(q, 1, 2), substring(d, 4, 1), substring(q, 3, 6))")
    return _let(national, "d", _refilled(m, new))


def _ssn(m: str) -> str:
    """Area numbers 000, 666 and from 900 on aren't issued, nor group 00 or serial 0000; the last six digits move."""
    valid = "not (d rlike '^(000|666|9)' or d rlike '^...00' or d rlike '0000$')"
    area = "cast(substring(d, 1, 3) as bigint)"
    rest = "(cast(substring(d, 4, 2) as bigint) - 1) * 9999 + cast(substring(d, 6, 4) as bigint) - 1"
    moved = _feistel("ssn", f"({area} - 1 - if({area} > 666, 1, 0))", f"({rest})", "898L", "989901L")
    new = _let(moved, "f", "concat(lpad(cast(f.a + 1 + if(f.a + 1 >= 666, 1, 0) as string), 3, '0'), lpad(cast(f.b div 9999 + 1 as string), 2, '0'), lpad(cast(f.b % 9999 + 1 as string), 4, '0'))")
    return _let(_only_digits(m), "d", f"if({valid}, {_refilled(m, new)}, null)")


def _ip(m: str) -> str:
    octet = lambda i: f"cast(o[{i}] as bigint)"
    moved = _feistel("ip", f"({octet(0)} * 256 + {octet(1)})", f"({octet(2)} * 256 + {octet(3)})", "65536L", "65536L")
    new = _let(moved, "f", "concat_ws('.', f.a div 256, f.a % 256, f.b div 256, f.b % 256)")
    return _let(f"split({m}, '[.]')", "o", f"if(forall(o, x -> cast(x as int) <= 255), {new}, null)")


def _date(m: str) -> str:
    """146,097 days, a whole calendar cycle from the year 100, 500 ... 1700 ..., are 189 times 773; dates stay in their cycle."""
    iso = f"{m} rlike '^[0-9]{{4}}-'"
    day_first = f"substring({m}, 3, 1) = '.'"
    read = f"coalesce(if({iso}, try_to_date({m}, 'yyyy-MM-dd'), if({day_first}, try_to_date({m}, 'dd.MM.yyyy'), try_to_date({m}, 'MM/dd/yyyy'))))"
    number = f"datediff({read}, date'0100-01-01')"
    moved = _feistel("date", "(n % 146097 div 773)", "(n % 146097 % 773)", "189L", "773L")
    made = _let(moved, "f", "date_add(date'0100-01-01', cast(n - n % 146097 + f.a * 773 + f.b as int))")
    written = _let(made, "t", f"if({iso}, date_format(t, 'yyyy-MM-dd'), if({day_first}, date_format(t, 'dd.MM.yyyy'), date_format(t, 'MM/dd/yyyy')))")
    return _let(number, "n", f"if(n >= 0 and n < 24 * 146097, {written}, null)")


def _email(m: str) -> str:
    """All letters and digits of the local part move, each within its alphabet; signs, and which letters are capitals, stay.

    Each character is shifted by a running keyed digest of all before it, in passes from both ends, with the first one known to
    all; the first is shifted last, by the others, and never by 0, so every address that counts is changed and none coincide.
    Characters are taken in blocks, so long parts take time in proportion but for the joining of blocks. An address with a
    letter of another alphabet, or one whose small form isn't one letter, can't be moved whole: it stays and doesn't count.
    """
    number = lambda digest: f"cast(conv(substring({digest}, 1, 15), 16, 10) as bigint)"
    alphabets = "array(" + ", ".join(f"named_struct('a', {a}, 'n', {(b - a) // step + 1}, 's', {step})" for a, b, step in LETTERS) + ")"
    moves, still, strange = _literal(f"[{_MOVES}]"), _literal(f"^[^{_MOVES}]*"), _literal(rf"[\p{{L}}\p{{N}}&&[^{_MOVES}]]")

    def shifted(c: str, by: str, least: int) -> str:
        """SQL: the character moved in its alphabet, or as it is."""
        plain = " ".join(f"when {c} between '{chr(a)}' and '{chr(b)}' then char({a} + (ascii({c}) - {a} + {least} + {by} % {b - a + 1 - least}) % {b - a + 1})" for a, b, _ in LETTERS[:2])
        place = f"g.a + g.s * (((ascii({c}) - g.a) div g.s + {least} + {by} % (g.n - {least})) % g.n)"
        other = f"element_at(transform(filter({alphabets}, g -> ascii({c}) >= g.a and ascii({c}) <= g.a + g.s * (g.n - 1)), g -> decode(unhex(lpad(hex({place}), 4, '0')), 'UTF-16BE')), 1)"
        return f"case {plain} when {c} rlike {moves} then {other} else {c} end"

    step = _let(shifted("c", number("s.d"), 0), "n", "named_struct('d', sha2(concat(s.d, n), 256), 't', concat(s.t, n))")
    block = _let(f"aggregate(filter(split(b, ''), c -> c <> ''), named_struct('d', z.d, 't', ''), (s, c) -> {step})", "k", "named_struct('d', k.d, 't', concat(z.t, k.t))")
    blocks = "transform(sequence(0, cast(greatest(length(w) - 1, 0) div 1000 as int)), i -> substring(w, i * 1000 + 1, 1000))"
    seed = "sha2(concat_ws('|', pii_key, 'email', length(l), p, x, r), 256)"
    through = f"aggregate({blocks}, named_struct('d', {seed}, 't', ''), (z, b) -> {block}).t"
    rest = f"aggregate(sequence(1, 4), substring(l, length(p) + 2), (w, r) -> reverse({through}))"
    first = shifted("x", number("sha2(concat_ws('|', pii_key, 'email', length(l), p, o), 256)"), 1)
    made = _let(f"regexp_extract(l, {still}, 0)", "p", _let("substring(l, length(p) + 1, 1)", "x", _let(rest, "o", f"concat(p, {first}, o)")))
    local, domain = f"substring_index({m}, '@', 1)", f"substring_index({m}, '@', -1)"
    able = f"length(l) = length({local}) and l rlike {moves} and not l rlike {strange}"
    letters = lambda t: f"filter(split({t}, ''), c -> c <> '')"
    cased = f"array_join(zip_with({letters('n')}, {letters(local)}, (c, k) -> if(k <> lower(k), upper(c), c)), '')"
    return _let(f"lower({local})", "l", _let(f"if({able}, {made}, null)", "n", f"if(n is null, null, concat({cased}, '@', {domain}))"))


_MADE = {"email": _email, "ip": _ip, "phone": _phone, "ssn": _ssn, "date": _date, "card": _card}


def _pseudonym(m: str) -> str:
    """SQL: struct (kind, text) of a match; kind is null and the text as it was where validation fails."""
    cases = " ".join(f"when {m} rlike {_literal(f'^(?:{KINDS[k]})$')} then named_struct('kind', '{k}', 'new', {_MADE[k](m)})" for k in KINDS)
    made = f"case {cases} end"
    return _let(made, "x", f"named_struct('kind', if(x.new is null, null, x.kind), 'text', coalesce(x.new, {m}))")


def pseudonymise(docs: DataFrame, key: str) -> DataFrame:
    """``docs`` (text) with validated personal data in the text replaced by pseudonyms, and ``found``, their kinds in order.

    The kinds: e-mail addresses in scripts that ``LETTERS`` has, IPv4 addresses, North American phone numbers, US social security numbers, dates of the years
    100 to 9699, and card numbers with a right check digit. Four numbers below 256 joined by points count as an address, whatever
    they number. Null stays null with nothing found; empty texts likewise; repeated rows come out alike; other columns are kept
    whatever their names, but for one named ``found``, which is replaced. ``key`` is a secret of the deployment; the same key
    gives the same pseudonyms.
    """
    others = [c for c in docs.columns if c not in ("text", "found")]
    text = "text"
    any_, mark = _literal(ANY), f"{text} rlike '[0-9@]'"
    # The other columns travel in one, so that none of their names can be met below.
    kept = F.struct(*[F.col(f"`{c}`") for c in others]) if others else F.lit(None)
    rows = docs.select(kept.alias("_others"), F.col("text").cast("string").alias("text"), F.lit(key).alias("pii_key"))
    parts = f"zip_with(split(text, {any_}, -1), transform(regexp_extract_all(text, {any_}, 0), m -> {_pseudonym('m')}), (g, x) -> named_struct('gap', g, 'x', x))"
    none = "cast(null as array<struct<gap: string, x: struct<kind: string, text: string>>>)"
    rows = rows.withColumn("_parts", F.expr(f"if({mark} and text rlike {any_}, {parts}, {none})"))
    new = "if(_parts is null, text, array_join(transform(_parts, p -> concat(p.gap, coalesce(p.x.text, ''))), ''))"
    kinds = "if(_parts is null, cast(array() as array<string>), filter(transform(_parts, p -> p.x.kind), k -> k is not null))"
    return rows.select(*[F.col("_others").getField(c).alias(c) for c in others], F.expr(new).alias("text"), F.expr(kinds).alias("found"))
