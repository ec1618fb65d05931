"""Format-preserving pseudonyms for personal data, with DataFrame functions only.

Candidates are found by one pattern, classified and validated: payment cards (13-19 digits, Luhn),
dates that exist (1900-2099), IPv4 addresses (octets to 255), telephone numbers (7-15 digits), social
security numbers (area, group and serial that are issued), e-mail addresses (local part to 64
characters, up to 127 domain labels) and hexadecimal secrets (32-64 digits, with letters). Where digits
of a card's shape fail as a whole (a card and the number after it), the card groups inside them are
tried. What does not validate stays.

Each valid value goes through an eight-round Feistel network keyed by SHA-256: digits shift to digits,
letters to letters of their case, and separators stay, so the pseudonym has the value's format, and
the mapping is a permutation of it. A card keeps a valid check digit, a date stays a date of its
century, a social security number one that is issued, a telephone number keeps its country code, an
e-mail address its domain. Equal values, with any separators, have equal pseudonyms in all documents.
A secret's pseudonym has its length and case; one in three million of 32 digits is without letters.

Null and empty texts stay as they are. Columns of the input keep their names and values; ``found`` gets
underscores at its end where the input has a column of that name. Ids are not read.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from inkstone.llm.common import unused

ROUNDS = 8

# What each kind looks like. Repeats of groups have bounds: Java's matcher recurses on them.
PATTERNS = {
    "email": r"[A-Za-z0-9._%+-]++@(?:[A-Za-z0-9-]{1,63}\.){1,127}[A-Za-z]{2,63}+",
    "secret": r"(?:[0-9a-f]{32,64}|[0-9A-F]{32,64})(?![0-9A-Za-z])",
    "ip": r"(?:[0-9]{1,3}\.){3}[0-9]{1,3}(?![0-9A-Za-z]|\.[0-9])",
    "date": r"(?:[0-9]{4}-[0-9]{2}-[0-9]{2}|[0-9]{2}\.[0-9]{2}\.[0-9]{4}|[0-9]{2}/[0-9]{2}/[0-9]{4})(?![0-9A-Za-z]|[-/.][0-9])",
    "ssn": r"[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9A-Za-z]|-[0-9])",
    "phone": r"(?:\+[0-9]{1,3}[ .-]?)?(?:\([0-9]{2,4}\)[ .-]?|[0-9]{3}[.-])[0-9]{3,4}[ .-]?[0-9]{3,4}(?![0-9A-Za-z])|\+[0-9]{1,3}(?:[ .-]?[0-9]{2,4}){2,5}(?![0-9A-Za-z])",
    "card": r"[0-9](?:[ -]?[0-9]){12,18}(?![0-9A-Za-z])",
}
#: How cards group their digits.
CARD_GROUPS = r"(?<![0-9])(?:[0-9]{4}[ -][0-9]{4}[ -][0-9]{4}[ -][0-9]{4}|[0-9]{4}[ -][0-9]{6}[ -][0-9]{5}|[0-9]{13,16})(?![0-9])"
CANDIDATE = r"(?<![0-9A-Za-z._%+-])(?:" + "|".join(PATTERNS.values()) + ")"
KINDS = list(PATTERNS)


def _quoted(s: str) -> str:
    return "'" + s.replace("\\", "\\\\").replace("'", "\\'") + "'"


def _shift(char: str, by: str) -> str:
    """SQL: a digit, letter or other character moved by a number within its class."""
    code = f"ascii({char})"
    return (
        f"case when {char} between '0' and '9' then char(48 + (({code} - 48 + {by}) % 10))"
        f" when {char} between 'a' and 'z' then char(97 + (({code} - 97 + {by}) % 26))"
        f" when {char} between 'A' and 'Z' then char(65 + (({code} - 65 + {by}) % 26)) else {char} end"
    )


def _shift_hex(char: str, by: str) -> str:
    """SQL: a hexadecimal digit moved; ``q`` is the whole value, whose case it keeps."""
    small, large = "'0123456789abcdef'", "'0123456789ABCDEF'"
    moved = "substring({0}, ((instr({0}, {1}) - 1 + {2}) % 16) + 1, 1)"
    return f"case when q rlike '[A-F]' then {moved.format(large, char, by)} else {moved.format(small, char, by)} end"


def _feistel(value: str, kind: str, key: str, shift=_shift) -> str:
    """SQL: a string of up to 64 characters permuted within its format."""
    n = f"length({value})"
    stream = f"sha2(concat({_quoted(key)}, '|{kind}|', i, '|', length(s.l), '|', s.r), 256)"
    moved = f"array_join(transform(sequence(1, length(s.l)), p -> {shift('substring(s.l, p, 1)', 'cast(conv(substring(k, 2 * p - 1, 2), 16, 10) as int)')}), '')"
    moved = f"element_at(transform(array({stream}), k -> case when length(s.l) > 0 then {moved} else '' end), 1)"
    start = f"named_struct('l', substring({value}, 1, cast({n} / 2 as int)), 'r', substring({value}, cast({n} / 2 as int) + 1))"
    return f"aggregate(sequence(1, {ROUNDS}), {start}, (s, i) -> named_struct('l', s.r, 'r', {moved}), s -> concat(s.l, s.r))"


def _digits(m: str) -> str:
    return f"regexp_replace({m}, '[^0-9]', '')"


def _fill(m: str, digits: str) -> str:
    """SQL: the digits in the places of the digits of ``m``."""
    return (
        f"element_at(transform(array({digits}), d -> array_join(transform(sequence(1, length({m})), p -> case when substring({m}, p, 1) between '0' and '9'"
        f" then substring(d, length({_digits(f'substring({m}, 1, p)')}), 1) else substring({m}, p, 1) end), '')), 1)"
    )


def _luhn(digits: str, offset: int) -> str:
    """SQL: the Luhn sum, the last digit doubled if ``offset`` is 1."""
    return (
        f"aggregate(sequence(1, length({digits})), 0, (t, p) -> t + element_at(transform(array(cast(substring({digits}, p, 1) as int)),"
        f" x -> case when (length({digits}) - p + {offset}) % 2 = 0 then x when x > 4 then 2 * x - 9 else 2 * x end), 1))"
    )


def _date(m: str) -> str:
    iso = (
        f"case when substring({m}, 5, 1) = '-' then {m} when substring({m}, 3, 1) = '.' then concat(substring({m}, 7, 4), '-', substring({m}, 4, 2), '-', substring({m}, 1, 2))"
        f" else concat(substring({m}, 7, 4), '-', substring({m}, 1, 2), '-', substring({m}, 4, 2)) end"
    )
    return f"try_cast({iso} as date)"


def _rounds(x: str, y: str, a: int, b: int, kind: str, key: str) -> str:
    """SQL: another number under a x b for the pair (x under a, y under b): halves add hashes of each other."""
    mix = f"cast(conv(substring(sha2(concat({_quoted(key)}, '|{kind}|', {a}, '|', i, '|', case when i % 2 = 0 then s.y else s.x end), 256), 1, 12), 16, 10) as bigint)"
    step = f"case when i % 2 = 0 then named_struct('x', (s.x + {mix}) % {a}, 'y', s.y) else named_struct('x', s.x, 'y', (s.y + {mix}) % {b}) end"
    return f"aggregate(sequence(1, {ROUNDS}), named_struct('x', cast({x} as bigint), 'y', cast({y} as bigint)), (s, i) -> {step}, s -> s.x * {b} + s.y)"


def _new_date(m: str, key: str) -> str:
    """SQL: another date of the century: 36,524 days are 92 x 397, 36,525 are 75 x 487."""

    def within(first: str, a: int, b: int) -> str:
        days = f"datediff(d, date'{first}')"
        return f"date_add(date'{first}', cast({_rounds(f'{days} div {b}', f'{days} % {b}', a, b, 'date', key)} as int))"

    new = f"case when year(d) < 2000 then {within('1900-01-01', 92, 397)} else {within('2000-01-01', 75, 487)} end"
    form = f"case when substring({m}, 5, 1) = '-' then date_format(e, 'yyyy-MM-dd') when substring({m}, 3, 1) = '.' then date_format(e, 'dd.MM.yyyy') else date_format(e, 'MM/dd/yyyy') end"
    return f"element_at(transform(transform(array({_date(m)}), d -> {new}), e -> {form}), 1)"


def _new_ssn(m: str, key: str) -> str:
    """SQL: another issued number: 898 areas (001 to 899 but 666) x 99 groups, and 9,999 serials."""
    area = f"cast(substring({m}, 1, 3) as int)"
    x = f"({area} - case when {area} > 666 then 2 else 1 end) * 99 + cast(substring({m}, 5, 2) as int) - 1"
    new = _rounds(x, f"cast(substring({m}, 8, 4) as int) - 1", 898 * 99, 9999, "ssn", key)
    of_area = "lpad(cast(a div 99 + case when a div 99 >= 665 then 2 else 1 end as string), 3, '0')"
    joined = f"concat({of_area}, '-', lpad(cast(a % 99 + 1 as string), 2, '0'), '-', lpad(cast(n % 9999 + 1 as string), 4, '0'))"
    return f"element_at(transform(array({new}), n -> element_at(transform(array(n div 9999), a -> {joined}), 1)), 1)"


def _is(kind: str, m: str) -> str:
    return f"{m} rlike {_quoted('^(?:' + PATTERNS[kind] + ')$')}"


def kind_of(m: str) -> str:
    """SQL: the kind of a candidate that validates, or null."""
    octets = f"forall(split({m}, '[.]'), o -> cast(o as int) <= 255)"
    area = f"substring({m}, 1, 3) not in ('000', '666') and substring({m}, 1, 1) <> '9' and substring({m}, 5, 2) <> '00' and substring({m}, 8, 4) <> '0000'"
    n = f"length({_digits(m)})"
    return (
        f"case when {_is('email', m)} then case when instr({m}, '@') <= 65 then 'email' end"
        f" when {_is('secret', m)} and {m} rlike '[a-fA-F]' then 'secret'"
        f" when {_is('ip', m)} then case when {octets} then 'ip' end"
        f" when {_is('date', m)} then case when year({_date(m)}) between 1900 and 2099 then 'date' end"
        f" when {_is('ssn', m)} then case when {area} then 'ssn' end"
        f" when {_is('card', m)} and {_luhn(_digits(m), 0)} % 10 = 0 then 'card'"
        f" when {_is('phone', m)} and {n} between 7 and 15 then 'phone' end"
    )


def pseudonym(m: str, kind: str, key: str) -> str:
    """SQL: the pseudonym of a value of a kind."""
    payload = f"substring({_digits(m)}, 1, length({_digits(m)}) - 1)"
    card = _fill(m, f"element_at(transform(array({_feistel('q', 'card', key)}), c -> concat(c, (10 - {_luhn('c', 1)} % 10) % 10)), 1)")
    as_hex = f"array_join(transform(split({m}, '[.]'), o -> lower(lpad(hex(cast(o as int)), 2, '0'))), '')"
    ip = f"array_join(transform(sequence(1, 7, 2), p -> conv(substring(h, p, 2), 16, 10)), '.')"
    ip = f"element_at(transform(transform(array({as_hex}), q -> {_feistel('q', 'ip', key, _shift_hex)}), h -> {ip}), 1)"
    prefix = f"regexp_extract({m}, '^([+][0-9]{{1,3}})(?=[ .(-])', 1)"
    rest = f"substring({m}, length({prefix}) + 1)"
    phone = f"concat({prefix}, {_fill(rest, _with(_digits(rest), 'phone', key))})"
    email = f"concat({_with(f'substring_index({m}, {_quoted('@')}, 1)', 'email', key)}, substring({m}, instr({m}, '@')))"
    return (
        f"case {kind} when 'card' then element_at(transform(array({payload}), q -> {card}), 1)"
        f" when 'date' then {_new_date(m, key)} when 'ip' then {ip} when 'phone' then {phone}"
        f" when 'ssn' then {_new_ssn(m, key)} when 'email' then {email}"
        f" when 'secret' then {_with(m, 'secret', key, _shift_hex)} else {m} end"
    )


def _with(value: str, kind: str, key: str, shift=_shift) -> str:
    """SQL: the permuted value, which is computed once."""
    return f"element_at(transform(array({value}), q -> {_feistel('q', kind, key, shift)}), 1)"


def value_of(m: str) -> str:
    """SQL: what of a candidate is to be judged: the first valid card group where digits fail as one card, else all of it."""
    groups = f"filter(regexp_extract_all({m}, {_quoted(CARD_GROUPS)}, 0), c -> {_luhn(_digits('c'), 0)} % 10 = 0)"
    return f"case when {_is('card', m)} and {_luhn(_digits(m), 0)} % 10 <> 0 then coalesce(get({groups}, 0), {m}) else {m} end"


def pseudonymise(docs: DataFrame, key: str, text_col: str = "text") -> DataFrame:
    """The documents with pseudonyms in their texts, and ``found``: a map from kind to number of values."""
    text = F.col(text_col)
    matches, values, kinds, new, whole, counted = unused(docs, "_matches", "_values", "_kinds", "_new", "_whole", "found")
    may = text.rlike("[0-9@]")
    found = F.when(may, F.regexp_extract_all(text, F.lit(CANDIDATE), F.lit(0))).otherwise(F.array().cast("array<string>"))
    out = docs.withColumn(matches, found)
    out = out.withColumn(values, F.expr(f"transform({matches}, m -> {value_of('m')})"))
    out = out.withColumn(kinds, F.expr(f"transform({values}, m -> {kind_of('m')})"))
    hit = F.exists(kinds, lambda k: k.isNotNull())
    out = out.withColumn(new, F.when(hit, F.expr(f"zip_with({values}, {kinds}, (m, k) -> {pseudonym('m', 'k', key)})")))
    placed = f"zip_with({matches}, zip_with({values}, {new}, (v, n) -> named_struct('v', v, 'n', n)), (m, x) -> concat(substring(m, 1, instr(m, x.v) - 1), x.n, substring(m, instr(m, x.v) + length(x.v))))"
    gaps = F.split(text, CANDIDATE, -1)
    joined = F.array_join(F.flatten(F.zip_with(gaps, F.concat(F.expr(placed), F.array(F.lit(""))), lambda g, v: F.array(g, v))), "")
    out = out.withColumn(whole, F.when(F.col(new).isNotNull(), joined).otherwise(text))
    counts = F.map_from_arrays(F.array(*[F.lit(k) for k in KINDS]), F.array(*[F.expr(f"size(filter({kinds}, x -> x = '{k}'))") for k in KINDS]))
    columns = [F.col(whole).alias(c) if c == text_col else F.col(c) for c in docs.columns]
    return out.select(*columns, counts.alias(counted))
