import hashlib
import random

import numpy as np
import public_tokenizers as P
import pytest

from inkstone.llm import bpe, chat, pii, tokencount
from tests.llm.helpers import EDGE, LONG, docs

PATH = P.path("byte_bpe_50k.tiktoken")


# token counts
@pytest.mark.parametrize("rule", tokencount.RULES)
def test_token_attribution_against_brute_force(spark, rule):
    rows = [(1, "One line.\n\n\n  Two 漢字 lines\nend\n"), *EDGE]
    got = {}
    for r in tokencount.count(docs(spark, rows), PATH, rule=rule).collect():
        got.setdefault(r.doc_id, []).append(r)
    with open(PATH, "rb") as f:
        c = bpe.Codec(f.read())
    for doc, text in rows:
        data = (text or "").encode()
        ids = next(iter(c.encode_batch([text or ""])))
        starts = [0] + [i + 1 for i, b in enumerate(data) if b == 10 and i + 1 < len(data)]
        ends = [*starts[1:], len(data)]
        tokens, crossing, at = [0] * len(starts), 0, 0
        for t in ids:
            stop = at + len(c.bytes_of[t])
            shares = [max(0, min(stop, e) - max(at, s)) for s, e in zip(starts, ends)]
            inside = [k for k, x in enumerate(shares) if x]
            crossing += len(inside) > 1
            tokens[inside[0] if rule == "start" else inside[-1] if rule == "end" else max(inside, key=lambda k: (shares[k], -k))] += 1
            at = stop
        r = next(x for x in got[doc] if x.n_chars == len(text or "") and x.section_tokens == tokens)
        assert (r.n_tokens, r.n_sections, r.n_crossing, sum(r.field_tokens)) == (len(ids), len(starts), crossing, len(ids))


def test_token_counts_of_fields(spark):
    df = spark.createDataFrame([(1, "a title", "the body text"), (2, None, "x")], "doc_id bigint, title string, text string")
    got = {r.doc_id: r for r in tokencount.count(df, PATH, fields=("title", "text")).collect()}
    assert len(got[1].field_tokens) == 2 and sum(got[1].field_tokens) == got[1].n_tokens
    assert tokencount.count(docs(spark, []), PATH).count() == 0
    with pytest.raises(ValueError):
        tokencount.count(df, PATH, rule="other")


# personal data
def luhn(s):
    d = [int(c) for c in s][::-1]
    return sum(x if i % 2 == 0 else sum(divmod(2 * x, 10)) for i, x in enumerate(d)) % 10 == 0


def test_pseudonyms(spark):
    rows = [(1, "card 4111 1111 1111 1111, 4111111111111111 and 4111-1111-1111-1112"), (2, "on 2024-02-29, 29.02.2024, 02/29/2024, never 2023-02-30"), (3, "ip 10.20.30.40 or 999.1.1.1; +1 (243) 555-5526; 123-45-6789; a.b9@x.example.org"), (4, 'key = "cb1a9fee807a053cb1a9fee807a053cb"'), *EDGE]
    out = [(r.doc_id, r.text) for r in pii.pseudonymise(docs(spark, rows, extra=False), "k").collect()]
    got = {i: t for i, t in out[:4]}
    spaced, plain = got[1][5:24], got[1][26:42]
    assert spaced.replace(" ", "") == plain != "4111111111111111" and luhn(plain) and got[1].endswith("4111-1111-1111-1112")
    iso, dots, slashes = got[2][3:13], got[2][15:25], got[2][27:37]
    assert iso != "2024-02-29" and dots == ".".join(reversed(iso.split("-"))) and slashes == f"{iso[5:7]}/{iso[8:]}/{iso[:4]}" and iso.startswith("20")
    assert got[2].endswith("never 2023-02-30")
    assert all(x not in got[3] for x in ("10.20.30.40", "555-5526", "123-45-6789", "a.b9@")) and "999.1.1.1" in got[3] and "@x.example.org" in got[3] and "+1 (" in got[3]
    assert "cb1a9fee" not in got[4]
    assert sorted(map(repr, out[4:])) == sorted(map(repr, EDGE))
    other = pii.pseudonymise(docs(spark, rows[:1], extra=False), "other key").first().text
    assert other != got[1]
    assert pii.pseudonymise(docs(spark, []), "k").count() == 0


def test_pseudonyms_are_permutations(spark):
    days = [f"{y}-{m:02d}-{d:02d}" for y in (1999, 2000) for m in range(1, 13) for d in range(1, 29)]
    text = " ".join(days)
    new = pii.pseudonymise(docs(spark, [(1, text)], extra=False), "k").first().text.split()
    assert len(set(new)) == len(days)
    numbers = [f"{i:013d}" for i in range(0, 3000, 7)]
    valid = [x[:12] + next(d for d in "0123456789" if luhn(x[:12] + d)) for x in numbers]
    new = pii.pseudonymise(docs(spark, [(1, " ".join(f"{v}," for v in valid))], extra=False), "k").first().text.split()
    assert len(set(new)) == len(set(valid)) and all(luhn(x[:-1]) for x in new)


def test_pii_plan_is_native(spark):
    plan = pii.pseudonymise(docs(spark, EDGE), "k")._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan


# chat
def test_escaping_is_reversible():
    r = random.Random(1)
    for _ in range(2000):
        text = "".join(r.choice([*chat.CONTROL, "\\", "<", "|", "[", "a", "\n", "s>"]) for _ in range(r.randrange(8)))
        safe = chat.escape(text)
        assert chat.unescape(safe) == text and not any(c in safe for c in chat.CONTROL)
        assert chat.unescape_role(chat.escape_role(text)) == text and "\n" not in chat.escape_role(text)


def test_escaping_of_other_control_strings():
    mine = ("@@", "<|x|>")
    assert chat.escape("@@ <|x|> <s> <|im_end|>", mine) == "@\\@ <\\|x|> <s> <\\|im_end|>"
    assert chat.unescape(chat.escape("@@ @\\@", mine), mine) == "@@ @\\@"
    with pytest.raises(ValueError):
        chat.escape("x", ("@",))


def test_one_pass_equals_two(spark):
    rows = [(str(i), i, ["user", "assistant", None][i % 3], t) for i, t in enumerate(["a <s>", None, "<|eot_id|>", "", "é 😀 \\", LONG])]
    turns = spark.createDataFrame(rows, "conv_id string, turn bigint, role string, text string")
    one = sorted(map(tuple, chat.formatted(turns, PATH).collect()))
    assert one == sorted(map(tuple, chat.decode(chat.encode(turns, PATH), PATH).collect())) and len(one) == len(rows)
    assert chat.format_report(turns, PATH).count() == len(rows)


def test_chat_digests(spark):
    rows = [(1, 1, "assistant", "b </s>"), (1, 0, "user", "a"), (2, 0, "system", None), (2, None, "assistant", "first"), (3, 0, "assistant", LONG), (3, 0, "assistant", LONG), (None, 0, "user", "x"), (4, 0, None, "[INST]"), (5, 0, "odd\nrole", "<|im_end|>")]
    turns = spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string")
    got = {r.conv_id: r for r in chat.format_report(chat.with_probe(turns.selectExpr("*", "1 as ids", "2 as loss")), PATH).collect()}
    rows = [*rows, (-7, 0, "user", "</s>[INST] ok [/INST]"), (-7, 1, "assistant", "</s>[INST] ok [/INST]")]
    for conv in {r[0] for r in rows}:
        mine = sorted(((r[1] is not None, r[1] or 0, r[2] or "", r[3] or "") for r in rows if r[0] == conv))
        whole = "".join(f"{role}\n{text}\n" for _, _, role, text in mine)
        loss = "".join(text for _, _, role, text in mine if role == "assistant")
        formatted = sum(len(chat.START + chat.escape_role(role) + "\n" + chat.escape(text) + chat.END + "\n") for _, _, role, text in mine)
        sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
        assert tuple(got[conv])[1:] == (len(mine), sha(whole), len(loss), sha(loss), formatted)
    assert chat.format_report(turns.limit(0), PATH).count() == 0


def test_mask_covers_the_text_only():
    with open(PATH, "rb") as f:
        c = bpe.Codec(f.read())
    ids, loss, bounds = chat.assemble(c, ["assistant", "user", "assistant", "assistant"], ["hello there", "hello", "", "<s>"])
    turns = [c.decode(ids[a:b][loss[a:b]]).decode() for a, b in zip(bounds, bounds[1:])]
    assert turns == ["hello there", "", "", chat.escape("<s>")]
    assert [t[:3] for t in chat.read_back(c, ids, loss, bounds)] == [("assistant", "hello there", "hello there"), ("user", "hello", ""), ("assistant", "", ""), ("assistant", "<s>", "<s>")]
    with pytest.raises(ValueError):
        list(chat.read_back(c, ids[:-3], loss[:-3], np.append(bounds[:-1], len(ids) - 3)))


def test_no_turns_give_no_ids():
    with open(PATH, "rb") as f:
        c = bpe.Codec(f.read())
    ids, loss, bounds = chat.assemble(c, [], [])
    assert len(ids) == len(loss) == 0 and bounds.tolist() == [0] and list(chat.read_back(c, ids, loss, bounds)) == []
