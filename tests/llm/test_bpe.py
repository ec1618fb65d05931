import base64
import hashlib
import random

import public_tokenizers as P
import pytest
import tiktoken

from inkstone.llm import bpe
from tests.llm.helpers import EDGE, docs

PATH = P.path("byte_bpe_50k.tiktoken")


@pytest.fixture(scope="module")
def both():
    with open(PATH, "rb") as f:
        data = f.read()
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, data.splitlines())}
    return bpe.Codec(data), tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_random_texts_equal_tiktoken(both):
    ours, theirs = both
    r = random.Random(2)
    alphabet = "'strevmld  \n\t aéB1٣²、_-　\xa0😀\r"
    texts = ["".join(r.choice(alphabet) for _ in range(r.randrange(60))) for _ in range(4000)]
    assert list(ours.encode_batch(texts)) == [theirs.encode_ordinary(t) for t in texts]


def test_blocks_do_not_show(both, monkeypatch):
    ours, theirs = both
    monkeypatch.setattr(bpe, "BLOCK", 61)
    for t in ("a" * 500, " " * 300 + "x", "it's we'll 'tis " * 90, "x'" * 400, "é 12  \n\n b" * 80):
        assert next(iter(ours.encode_batch([t]))) == theirs.encode_ordinary(t)


def test_every_code_point(both):
    ours, theirs = both
    text = " ".join("x" + chr(c) + "1" for c in range(0, 0x110000, 3) if not 0xD800 <= c < 0xE000)
    assert next(iter(ours.encode_batch([text]))) == theirs.encode_ordinary(text)


def test_merges_agree(both):
    ours, _ = both
    r = random.Random(4)
    pieces = ["".join(r.choice("abethion ") for _ in range(r.randrange(1, 60))).encode() for _ in range(500)]
    assert ours.merge_many(pieces) == [ours.merge(p) for p in pieces]


def test_edges(spark, both):
    _, theirs = both
    got = bpe.digests(docs(spark, EDGE), PATH).collect()
    want = []
    for i, t in EDGE:
        ids = theirs.encode_ordinary(t or "")
        want.append((i, len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest()))
    assert sorted(map(repr, map(tuple, got))) == sorted(map(repr, want))
    assert bpe.digests(docs(spark, []), PATH).count() == 0


def test_round_trip_and_offsets(spark):
    encoded = bpe.encode(docs(spark, EDGE[4:]), PATH)
    back = sorted((r.doc_id, bytes(r.decoded).decode()) for r in bpe.decode(encoded, PATH).collect())
    assert back == sorted((i, t) for i, t in EDGE[4:])
    for r in encoded.collect():
        assert len(r.offsets) == r.n_tokens and list(r.offsets) == sorted(r.offsets)


def test_new_pieces_merge_in_bounded_slices(both, monkeypatch):
    codec, theirs = both
    codec.cache.clear()
    seen = []
    merge_many = codec.merge_many
    monkeypatch.setattr(bpe, "MERGED_BYTES", 500, raising=False)
    monkeypatch.setattr(codec, "merge_many", lambda pieces: seen.append(sum(map(len, pieces))) or merge_many(pieces))
    r = random.Random(5)
    text = " ".join("".join(r.choice("abcdefxyz") for _ in range(r.randrange(5, 40))) for _ in range(800))
    assert list(codec.encode_batch([text])) == [theirs.encode_ordinary(text)]
    assert len(seen) > 10 and max(seen) <= 500


def test_decoding_by_offsets(both, spark):
    ours, _ = both
    text = "é 漢字 \U0001f600 words and   spaces\n" * 3000
    ids = next(iter(ours.encode_batch([text])))
    offsets = ours.byte_offsets(ids)
    pieces = list(ours.decode_by_offsets(ids, offsets, 1000))
    assert b"".join(pieces).decode() == text and max(map(len, pieces)) < 1100 and len(pieces) > 50
    with pytest.raises(ValueError):
        list(ours.decode_by_offsets(ids[1:] + ids[:1], offsets, 1000))
    assert list(ours.decode_by_offsets([], ours.byte_offsets([]))) == []
    encoded = bpe.encode(docs(spark, EDGE), PATH)
    got = sorted((repr(r.doc_id), bytes(r.decoded).decode()) for r in bpe.decode(encoded, PATH).collect())
    assert got == sorted((repr(i), t or "") for i, t in EDGE)
