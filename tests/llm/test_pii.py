"""Pseudonyms against a plain Python version, and texts that are hard on patterns."""

import datetime
import hashlib
import ipaddress
import random
import re
import string

import pytest

from inkstone.llm import pii
from tests.llm.helpers import docs

KEY = "k"


def luhn(digits):
    total = 0
    for i, c in enumerate(reversed(digits)):
        x = int(c) * (1 + i % 2)
        total += x // 10 + x % 10
    return total % 10 == 0


def sha(*parts):
    return hashlib.sha256("|".join(map(str, parts)).encode()).hexdigest()


def feistel(value, kind, classes=(string.digits, string.ascii_lowercase, string.ascii_uppercase)):
    left, right = value[: len(value) // 2], value[len(value) // 2 :]
    for i in range(1, 9):
        stream = bytes.fromhex(sha(KEY, kind, i, len(left), right))
        moved = ""
        for c, b in zip(left, stream):
            group = next((g for g in classes if c in g), None)
            moved += c if group is None else group[(group.index(c) + b) % len(group)]
        left, right = right, moved
    return left + right


def pair(x, y, a, b, kind):
    for i in range(1, 9):
        if i % 2:
            y = (y + int(sha(KEY, kind, a, i, x)[:12], 16)) % b
        else:
            x = (x + int(sha(KEY, kind, a, i, y)[:12], 16)) % a
    return x * b + y


def date_of(m):
    for form in ("%Y-%m-%d", "%d.%m.%Y", "%m/%d/%Y"):
        try:
            return datetime.datetime.strptime(m, form).date(), form
        except ValueError:
            pass
    return None, None


def kind_of(m):
    digits = "".join(c for c in m if c in string.digits)
    if re.fullmatch(pii.PATTERNS["email"], m):
        return "email" if m.index("@") <= 64 else None
    if re.fullmatch("[0-9a-f]{32,64}|[0-9A-F]{32,64}", m) and not m.isdigit():
        return "secret"
    if re.fullmatch(r"\d{1,3}(\.\d{1,3}){3}", m):
        return "ip" if all(int(o) < 256 for o in m.split(".")) else None
    if re.fullmatch(r"\d{4}-\d\d-\d\d|\d\d\.\d\d\.\d{4}|\d\d/\d\d/\d{4}", m):
        d, _ = date_of(m)
        return "date" if d and 1900 <= d.year <= 2099 else None
    if re.fullmatch(r"\d{3}-\d\d-\d{4}", m):
        return "ssn" if m[0] != "9" and m[:3] not in ("000", "666") and m[4:6] != "00" and m[7:] != "0000" else None
    if re.fullmatch(pii.PATTERNS["card"].split("(?!")[0], m) and luhn(digits):
        return "card"
    if re.fullmatch(pii.PATTERNS["phone"], m) and 7 <= len(digits) <= 15:
        return "phone"
    return None


def fill(m, digits):
    left = iter(digits)
    return "".join(next(left) if c in string.digits else c for c in m)


def new_value(m, kind):
    digits = "".join(c for c in m if c in string.digits)
    if kind == "email":
        local, _, domain = m.partition("@")
        return feistel(local, "email") + "@" + domain
    if kind == "secret":
        return feistel(m, "secret", ("0123456789ABCDEF" if re.search("[A-F]", m) else "0123456789abcdef",))
    if kind == "ip":
        octets = bytes(int(o) for o in m.split("."))
        return str(ipaddress.IPv4Address(bytes.fromhex(feistel(octets.hex(), "ip", ("0123456789abcdef",)))))
    if kind == "date":
        d, form = date_of(m)
        first, a, b = (datetime.date(1900, 1, 1), 92, 397) if d.year < 2000 else (datetime.date(2000, 1, 1), 75, 487)
        n = (d - first).days
        return (first + datetime.timedelta(days=pair(n // b, n % b, a, b, "date"))).strftime(form)
    if kind == "ssn":
        areas = [x for x in range(1, 900) if x != 666]
        n = pair(areas.index(int(m[:3])) * 99 + int(m[4:6]) - 1, int(m[7:]) - 1, 898 * 99, 9999, "ssn")
        x, y = divmod(n, 9999)
        return f"{areas[x // 99]:03d}-{x % 99 + 1:02d}-{y + 1:04d}"
    if kind == "card":
        payload = feistel(digits[:-1], "card")
        return fill(m, payload + next(c for c in string.digits if luhn(payload + c)))
    prefix = (re.match(r"[+]\d{1,3}(?=[ .(-])", m) or [""])[0]
    rest = m[len(prefix) :]
    return prefix + fill(rest, feistel("".join(c for c in rest if c in string.digits), "phone"))


def brute(text):
    found = dict.fromkeys(pii.KINDS, 0)

    def put(match):
        m = value = match[0]
        if re.fullmatch(pii.PATTERNS["card"].split("(?!")[0], m) and not luhn(re.sub(r"\D", "", m)):
            value = next((c for c in re.findall(pii.CARD_GROUPS, m) if luhn(re.sub(r"\D", "", c))), m)
        kind = kind_of(value)
        if kind is None:
            return m
        found[kind] += 1
        head, tail = m.split(value, 1)
        return head + new_value(value, kind) + tail

    return re.sub(pii.CANDIDATE, put, text, flags=re.ASCII), found


def made(r):
    digits = lambda n: "".join(r.choice(string.digits) for _ in range(n))
    card = digits(15)
    card += next(c for c in string.digits if luhn(card + c))
    sep = r.choice([" ", "-", ""])
    kinds = [
        lambda: sep.join(card[i : i + 4] for i in range(0, 16, 4)),
        lambda: " ".join(card[i : i + 4] for i in range(0, 16, 4)) + " " + digits(3),
        lambda: digits(r.randrange(10, 21)),
        lambda: f"{r.randrange(1890, 2110)}-{r.randrange(14):02d}-{r.randrange(33):02d}",
        lambda: f"{r.randrange(1, 32):02d}.{r.randrange(1, 13):02d}.{r.randrange(1900, 2100)}",
        lambda: f"{r.randrange(1, 13):02d}/{r.randrange(1, 29):02d}/{r.randrange(1900, 2100)}",
        lambda: ".".join(str(r.randrange(300)) for _ in range(4)),
        lambda: f"{r.choice(['000', '665', '666', '667', '899', '900', digits(3)])}-{digits(2)}-{digits(4)}",
        lambda: f"+{digits(2)} ({digits(3)}) {digits(3)}-{digits(4)}",
        lambda: f"{digits(3)}-{digits(3)}-{digits(4)}",
        lambda: f"{r.choice(['a.b', 'Jo9', 'x' * 70])}@{r.choice(['ex.org', 'a-b.co.uk.', 'x', 'b.com.12'])}",
        lambda: "".join(r.choice("0123456789abcdef") for _ in range(r.randrange(30, 66))),
        lambda: "".join(r.choice("0123456789ABCDEF") for _ in range(32)),
        lambda: r.choice(["word", "é", "漢", "\U0001f600", "12", "@", "a@"]),
    ]
    return r.choice(kinds)()


def test_against_plain_python(spark):
    r = random.Random(9)
    rows = [(i, "".join(made(r) + r.choice([" ", ", ", "\n", "; ", " x ", "."]) for _ in range(12))) for i in range(300)]
    out = pii.pseudonymise(docs(spark, rows, extra=False), KEY).collect()
    seen = dict.fromkeys(pii.KINDS, 0)
    for (_, text), got in zip(rows, out):
        want, found = brute(text)
        assert (got.text, got.found) == (want, found)
        for k, n in found.items():
            seen[k] += n
    assert min(seen.values()) > 20


def test_pseudonyms_are_of_their_kind(spark):
    r = random.Random(10)
    issued = {f"{a:03d}-{g:02d}-{s:04d}" for a in (1, 665, 667, 899) for g in (1, 99) for s in range(1, 9999, 111)}
    text = " ; ".join(sorted(issued))
    new = pii.pseudonymise(docs(spark, [(1, text)], extra=False), KEY).first().text.split(" ; ")
    assert len(set(new)) == len(issued) and all(kind_of(x) == "ssn" for x in new)
    days = {f"{r.randrange(1900, 2100)}-{r.randrange(1, 13):02d}-{r.randrange(1, 29):02d}" for _ in range(300)}
    new = pii.pseudonymise(docs(spark, [(1, " ; ".join(sorted(days)))], extra=False), KEY).first().text.split(" ; ")
    assert len(set(new)) == len(days) and all(kind_of(x) == "date" for x in new)


@pytest.mark.parametrize("text", ["x@" + "a." * 2000, "x@" + "ab." * 300_000, "a.a." * 250_000, "b@c." * 200_000, "x@" + "a" * 1_000_000, "1 " * 500_000, "12.12." * 150_000, "1" * 1_000_000, "+1 " * 300_000, "0123-" * 200_000])
def test_texts_that_are_hard_on_patterns(spark, text):
    got = pii.pseudonymise(docs(spark, [(1, text)], extra=False), KEY).first()
    assert len(got.text) == len(text)


def test_a_card_beside_another_number(spark):
    got = pii.pseudonymise(docs(spark, [(1, "4111 1111 1111 1111 123 and 12 4111-1111-1111-1111")], extra=False), KEY).first()
    assert "4111" not in got.text and got.text[19:23] == " 123" and got.found["card"] == 2
