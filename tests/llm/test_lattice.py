import collections
import itertools
import math
import random
import re
import zlib

import numpy as np
import public_tokenizers
import pytest

from assayer.llm import lattice

from .fixtures import DOCS, docs, rows

PATH = public_tokenizers.path("piece_bpe_32k.model")


def tiny():
    bytes_of = {b: f"<0x{b:02X}>" for b in range(256)}
    p = {"▁": 0.1, "▁a": 0.2, "a": 0.1, "ab": 0.15, "b": 0.1, "abc": 0.05, "c": 0.1, "</s>": 0.1}
    p |= {name: 0.1 / 256 for name in bytes_of.values()}
    return lattice.Pieces({k: math.log(v) for k, v in p.items()}, "</s>", bytes_of)


def plain(own, text):
    """The sum over all ways to cut the text."""
    total = 0.0
    for cuts in itertools.product([0, 1], repeat=len(text) - 1):
        at = [0, *(i + 1 for i, c in enumerate(cuts) if c), len(text)]
        p = 1.0
        for a, b in zip(at, at[1:]):
            piece = text[a:b]
            if piece in own.log_p and piece != own.end:
                p *= math.exp(own.log_p[piece])
            elif len(piece) == 1:
                p *= math.exp(own.unseen(piece))
            else:
                p = 0.0
                break
        total += p
    return total


@pytest.mark.parametrize("word", ["a", "abc", "abcab", "cab", "aéb", "漢a", "aaaa", "x"])
def test_marginal(word):
    own = tiny()
    assert math.isclose(math.exp(own.word(word)), plain(own, lattice.MARK + word), rel_tol=1e-9)


def test_expected_uses_follow_the_gradient():
    own = tiny()
    uses = {}
    own.expected("abcab", 2.0, uses)
    for piece in ("ab", "abc", "▁a", "b"):
        step = 1e-6
        other = tiny()
        other.log_p[piece] += step
        other = lattice.Pieces(other.log_p, other.end, other.bytes_of)
        slope = (other.word("abcab") - own.word("abcab")) / step
        assert abs(uses.get(piece, 0.0) - 2 * slope) < 1e-3


def test_batches_agree_with_single_words():
    rng = random.Random(14)
    words = ["".join(rng.choice("abcé漢x") for _ in range(rng.randint(0, 12))) for _ in range(300)] + ["abc" * 60]
    times = np.array([rng.randint(1, 5) for _ in words], np.float64)
    own = tiny()
    batch = lattice.Batch(own)
    assert np.allclose(batch.word(words), [own.word(w) for w in words])
    uses = {}
    for w, n in zip(words, times.tolist()):
        own.expected(w, n, uses)
    assert np.allclose(batch.expected(words, times), [uses.get(p, 0.0) for p in batch.names])
    blocks = list(lattice._blocks([*words, "a" * 500, "b" * 300], most=100))
    assert sorted(i for b in blocks for i in b) == list(range(len(words) + 2))
    assert [len(words)] in blocks and [len(words) + 1] in blocks


def test_long_word_stays_finite():
    assert math.isfinite(tiny().word("abc" * 20_000))


def test_rounds_raise_the_likelihood(spark):
    df = docs(spark).select("doc_id", "text").where("text is not null")
    words = lattice.word_counts(df).cache()
    pieces = lattice.read_pieces(PATH)
    total = []
    for _ in range(3):
        total.append(sum(r["c"] * r["log10_p"] for r in lattice.word_scores(words, pieces).collect()))
        pieces = lattice.reestimated(words, pieces, 10)
    assert total[0] < total[1] < total[2]
    assert math.isclose(sum(math.exp(v) for v in pieces.log_p.values()), 1.0, rel_tol=1e-9)


def test_scores(spark, monkeypatch):
    found = lattice.score(docs(spark), PATH).collect()
    monkeypatch.setattr(lattice, "FREQUENT", 5)
    few = lattice.score(docs(spark), PATH).collect()
    texts = [(r[0], (r[1] or "").encode().lower().split()) for r in rows()]
    out = lambda i: zlib.crc32(b"" if i is None else str(i).encode()) % 5 == 1
    counts, n_docs = collections.Counter(), 0
    for i, words in texts:
        if not out(i):
            counts.update(words)
            n_docs += 1
    n = sum(counts.values()) + n_docs
    bottom = math.log10(n + 0.5 * (len(counts) + 2))
    want = sorted((str(i), out(i), len(w) + 1, sum(counts[x] > 0 for x in w) + 1, n, round(sum(math.log10(counts[x] + 0.5) - bottom for x in w) + math.log10(n_docs + 0.5) - bottom, 4)) for i, w in texts)
    for got in (found, few):
        assert sorted((str(r[0]), r[1], r[2], r[3], r[4], round(r[5], 4)) for r in got) == want
        assert all(math.isfinite(r["score"]) and r["score"] < 0 for r in got)
    key = lambda r: (str(r["doc_id"]), r["n_tokens"], round(r["score"], 4))
    assert sorted(map(key, found)) == sorted(map(key, few))
    assert lattice.score(spark.createDataFrame([], DOCS), PATH).count() == 0


def test_words_of_held_out_documents_are_frequent_too(spark):
    out = [i for i in range(200) if zlib.crc32(str(i).encode()) % 5 == 1]
    learnt = [i for i in range(200) if i not in out]
    made = [(i, "fresh " * 50) for i in out] + [(i, "known rare") for i in learnt]
    words = lattice.word_counts(spark.createDataFrame(made, "doc_id long, text string"))
    _, most = lattice.frequent(lattice.word_scores(words, lattice.read_pieces(PATH)), most=1)
    assert {w: c for w, (c, _) in most.items()} == {b"fresh": 0}


def test_words_are_cut_at_ascii_space_only():
    assert re.findall(r"[^\x20\x09-\x0D]+", "a\x1cb\u00a0c d") == ["a\x1cb\u00a0c", "d"]
    assert "a\x1cb\u00a0c d".encode().split() == ["a\x1cb\u00a0c".encode(), b"d"]
