import hashlib
import random

import numpy as np

from assayer.llm import parsing

from .fixtures import DOCS, docs, prose, rows


def names(text):
    symbols = np.frombuffer(text.encode("utf-32-le"), "<u4")
    out = []
    for level, _, found, _ in parsing.parse(symbols, np.array([len(text)])):
        out.append((level, found.tolist()))
    return out


def test_parse_ends_with_one_root():
    rng = random.Random(6)
    for text in ["a", "ab", "aaaa", "abab" * 50, "a" * 1000 + "b", prose(rng, 300), "\U0001f600é" * 9]:
        levels = names(text)
        assert len(levels[-1][1]) == 1
        sizes = [len(x) for _, x in levels]
        assert all(b <= a for a, b in zip(sizes, sizes[1:]))
        assert len(levels) < 40


def test_equal_substrings_share_names():
    rng = random.Random(7)
    shared = prose(rng, 400)
    a = {(n, x) for n, found in names(prose(rng, 50) + shared + prose(rng, 30)) for x in found}
    b = {(n, x) for n, found in names(prose(rng, 13) + shared + prose(rng, 77)) for x in found}
    own = [(n, x) for n, found in names(shared) for x in found if n <= 3]
    assert sum(x in a and x in b for x in own) > 0.95 * len(own)


def test_batching_changes_nothing():
    rng = random.Random(8)
    texts = [prose(rng, rng.randint(0, 60)) for _ in range(40)] + ["", "a", "aa", ""]
    assert parsing.sketches(texts) == [parsing.sketches([t])[0] for t in texts]


def test_likeness():
    rng = random.Random(9)
    text, other = prose(rng, 800), prose(rng, 800)
    near = parsing.edited(text, other)
    a, b, c = parsing.sketches([text, near, other])
    assert parsing.likeness(a, a) == 1.0
    assert 0.3 < parsing.likeness(a, b) < 0.75
    assert parsing.likeness(a, c) < 0.2
    assert parsing.likeness([], []) == 1.0 and parsing.likeness([], a) == 0.0


def test_edited():
    assert parsing.edited("abcdefg", "XYZW") == "abcdeXY"
    assert parsing.edited("abcdef", "X") == "abcdX"
    assert parsing.edited("ab", "X") == "ab"


def test_sketch_estimates_jaccard():
    rng = random.Random(10)
    text, other = prose(rng, 3000), prose(rng, 3000)
    near = text[: 2 * len(text) // 3] + other[: len(text) // 3]
    x, y = (set(s) for s in parsing.sketches([text, near], keep=1 << 30))
    want = len(x & y) / len(x | y)
    a, b = parsing.sketches([text, near], keep=512)
    assert abs(parsing.likeness(a, b, 512) - want) < 0.08


def test_table(spark, monkeypatch):
    found = parsing.compare_edited(docs(spark)).collect()
    assert len(found) == len(rows())
    ids = sorted({r[0] for r in rows() if r[0] is not None}, reverse=True)
    texts = {r[0]: r[1] or "" for r in rows()}
    by = {r["doc_id"]: r for r in found}
    checked = 0
    for a, b in zip(ids, ids[1:]):
        if sum(r[0] in (a,) for r in rows()) == 1:
            want = parsing.edited(texts[a], texts[b])
            assert by[a]["edited_sha256"] == hashlib.sha256(want.encode()).hexdigest(), (a, b)
            own = parsing.sketches([texts[a], want, texts[b]])
            assert (by[a]["fingerprint"], by[a]["edited_fingerprint"]) == (parsing.written(own[0]), parsing.written(own[1]))
            assert (by[a]["near_edited"], by[a]["near_next"]) == (parsing.likeness(*own[:2]), parsing.likeness(own[0], own[2]))
            checked += 1
    assert checked > 60
    last = by[None]  # null ids come last, and the first document follows
    assert last["edited_sha256"] == hashlib.sha256(parsing.edited(texts[None], texts[ids[0]]).encode()).hexdigest()
    key = lambda r: tuple(map(str, r))
    monkeypatch.setattr(parsing, "BLOCK", 200)
    monkeypatch.setattr(parsing, "MOST_BUCKETS", 1)
    assert sorted(map(key, parsing.compare_edited(docs(spark)).collect())) == sorted(map(key, found))


def test_few_documents(spark):
    assert parsing.compare_edited(spark.createDataFrame([], DOCS)).count() == 0
    one = parsing.compare_edited(spark.createDataFrame([(1, "abcdef", "en", "a", 6)], DOCS)).first()
    assert one["edited_sha256"] == hashlib.sha256(b"abcdab").hexdigest() and one["near_next"] == 1.0
    plain = parsing.fingerprints(docs(spark)).collect()
    assert len(plain) == len(rows()) and {r[1] for r in plain if r[0] in (2000, 2001)} == {""}

def test_hot_ids_are_split(spark, monkeypatch):
    """Half of all rows have no id and a third are equal; results are those of one bucket, and no bucket holds them all."""
    rng = random.Random(11)
    big = (1 << 62) + 12345  # beyond what a double holds
    table = [(None, prose(rng, 9), "en", "a", 0) for _ in range(300)] + [(None, "the same text", "en", "a", 0)] * 400 + [(big, "another text", "en", "a", 0)] * 200 + [(i, prose(rng, 9), "en", "a", 0) for i in range(300)]
    frame = spark.createDataFrame(table, DOCS).repartition(3)
    own = frame.selectExpr("coalesce(doc_id, -9223372036854775808) as key", "text")
    cuts, hot = parsing.cut_points(own, len(table), 32)
    assert set(hot) == {-(1 << 63), big} and len(cuts) > 20
    assert len({c[2] for c in cuts}) > 5  # equal rows are cut by the salt
    key = lambda r: tuple(map(str, r))
    found = sorted(map(key, parsing.compare_edited(frame).collect()))
    monkeypatch.setattr(parsing, "MOST_BUCKETS", 1)
    assert found == sorted(map(key, parsing.compare_edited(frame).collect())) and len(found) == len(table)
