import hashlib

import public_tokenizers
import pytest
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st

from assayer.llm import bytebpe

from .fixtures import DOCS, docs, rows

PATH = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")


@pytest.fixture(scope="module")
def both():
    with open(PATH, "rb") as file:
        ranks = bytebpe.read_ranks(file.read())
    return bytebpe.ByteBPE(ranks, public_tokenizers.PATTERN), tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_perfect_hash(both):
    own = both[0]
    assert sorted(own.hash.candidate(k) for k in own.keys) == list(range(len(own.keys)))
    assert all(own.whole(k) == own.ranks[k] for k in own.keys)
    assert own.whole(b"surely not an entry of it") is None


def test_every_character(both):
    own, want = both
    for at in list(range(0x3100)) + list(range(0xFB00, 0x10000, 7)) + list(range(0x10000, 0x110000, 997)):
        if not 0xD800 <= at < 0xE000:
            text = f"a{chr(at)}{chr(at)}b 1{chr(at)} "
            assert own.encode(text) == want.encode_ordinary(text), hex(at)


def test_split_without_regex(both, monkeypatch):
    """Texts of the Basic Multilingual Plane are split by `re` alone, others by `regex`, and both as the pattern says."""
    every = "".join(chr(i) for i in range(0x10000) if not 0xD800 <= i < 0xE000)
    texts = [f"a{c}{c}b 1{c} {c}" for c in every] + ["don't  stop\n\n we'll  \t go 12x\x1c\x85 ", " '" * 9, ""]
    slow = bytebpe.regex.compile(public_tokenizers.PATTERN.replace(r"\s\p", bytebpe.SPACE[1:-1] + r"\p").replace(r"\s", bytebpe.SPACE).replace(r"\S", "[^" + bytebpe.SPACE[1:]))
    want, long = [slow.findall(x) for x in texts], "one 𝒳𝒳 two 𝟗9 \U0001f600! "
    calls = []
    real = bytebpe.regex.compile

    class Counted:
        def __init__(self, pattern):
            self.pattern, self.own = pattern, real(pattern)

        def findall(self, text):
            calls.append(text)
            return self.own.findall(text)

    monkeypatch.setattr(bytebpe.regex, "compile", Counted)
    split = bytebpe.ByteBPE(both[0].ranks, public_tokenizers.PATTERN).split
    assert [split(x) for x in texts] == want and not calls
    assert split(long) == slow.findall(long) and calls == [long]
    split = bytebpe.splitter(r"(?i:'s)|\p{Lu}\p{Ll}*|[^\r\n]")  # not for `re`
    assert split("It's ÀÉé") == ["It", "'s", " ", "À", "Éé"]


@given(st.text(max_size=80))
@settings(max_examples=200, deadline=None)
def test_texts(both, text):
    own, want = both
    ids = own.encode(text)
    assert ids == want.encode_ordinary(text)
    assert own.decode(ids) == text.encode()


def test_long_word(both):
    own, want = both
    text = "abcdefghij" * 3000
    assert own.encode(text) == want.encode_ordinary(text)


def test_memo_is_bounded(both, monkeypatch):
    monkeypatch.setattr(bytebpe, "MEMO", 20)
    own = bytebpe.ByteBPE(both[0].ranks, public_tokenizers.PATTERN)
    text = " ".join(f"w{i}x" for i in range(200)) * 2
    assert own.encode(text) == both[1].encode_ordinary(text)
    assert len(own.memo) + len(own.old) <= 20


def test_tables(spark, both):
    found = bytebpe.encode(docs(spark), PATH, public_tokenizers.PATTERN, ("ids", "n_tokens", "ids_sha256", "decoded_sha256"))
    want = []
    for r in rows():
        ids = both[1].encode_ordinary(r[1] or "")
        want.append((r[0] or -1, len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256((r[1] or "").encode()).hexdigest()))
    got = found.collect()
    assert sorted((-1 if r[0] is None else r[0] or -1, r[2], r[3], r[4]) for r in got) == sorted(want)
    back = bytebpe.decode(found, PATH, public_tokenizers.PATTERN).collect()
    assert sorted(bytes(r[1]) for r in back) == sorted((r[1] or "").encode() for r in rows())
    assert bytebpe.encode(spark.createDataFrame([], DOCS), PATH, public_tokenizers.PATTERN).count() == 0
