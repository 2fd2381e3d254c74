import collections
import re

import numpy as np
import pytest

from assayer.llm import mixing

from .fixtures import DOCS, docs, rows


def test_targets():
    want = mixing.targets({"b": 100, "a": 10, None: 100, "c": 1000})
    # weights by code point: a 3, b 1, c 2, none 3; a is full at 20 and none at 200
    assert want["a"] == 20 and want[None] == 200 and want["b"] == 200
    assert abs(sum(want.values()) - 1815) < 1e-9
    assert mixing.targets({}) == {} and mixing.targets({"x": 0}) == {"x": 0.0}


def test_split_meets_quotas():
    for shards in (1, 2, 7, 16):
        out = mixing.split((1000, 0, 13, 500), shards)
        assert out.sum(axis=0).tolist() == [1000, 0, 13, 500] and (out >= 0).all()
        assert np.ptp(out.sum(axis=1)) <= 1
    assert (mixing.split((5, 7), 3, 1) == mixing.split((5, 7), 3, 1)).all()


def test_split_is_hypergeometric():
    first = [mixing.split((300, 700), 2, seed)[0, 0] for seed in range(400)]
    assert abs(np.mean(first) - 150) < 1.5
    assert abs(np.std(first) - (500 * 0.3 * 0.7 * 500 / 999) ** 0.5) < 0.8


@pytest.mark.parametrize("n", [1, 2, 5, 64, 1000])
def test_permutation(n):
    assert sorted(mixing.permuted(np.arange(n), n, 9).tolist()) == list(range(n))


def test_allotment(spark):
    found = mixing.allotment(docs(spark)).collect()
    word = re.compile(r"[^\x20\x09-\x0D]+")
    assert collections.Counter((r["doc_id"], r["size"]) for r in found) == collections.Counter((r[0], len(word.findall(r[1] or ""))) for r in rows())
    by = collections.defaultdict(lambda: [0, 0, 0.0, 0])
    for r in found:
        assert 0 <= r["taken"] <= 2 * r["size"]
        own = by[r["source"]]
        own[0] += r["size"]
        own[1], own[2] = r["source_size"], r["target"]
        own[3] += r["taken"]
    want = mixing.targets({s: v[0] for s, v in by.items()})
    for s, (size, told, target, taken) in by.items():
        assert size == told and abs(target - want[s]) < 1e-6
        assert abs(taken - target) <= max(1, size // mixing.FINE) + 1
    again = mixing.allotment(docs(spark).repartition(7)).collect()
    key = lambda r: tuple(str(x) for x in r)
    assert sorted(map(key, found)) == sorted(map(key, again))


def test_mix_holds_the_words_taken(spark):
    given = docs(spark)
    told = collections.Counter()
    for r in mixing.allotment(given).collect():
        told[r["doc_id"]] += r["taken"]
    for by_block in (True, False):
        out = mixing.mix(given, by_block=by_block, shard=20_000).collect()
        got = collections.Counter()
        for r in out:
            got[r["doc_id"]] += len(r["text"].split())
        # splitting at words of a text without other white space counts the same words
        assert +got == +told
        assert len({r["shard"] for r in out}) > 1
    pairs = collections.Counter((r["shard"], r["position"], r["source"], r["doc_id"]) for r in out)
    assert max(pairs.values()) == 1  # draws are disjoint


def test_whole_documents_keep_their_text(spark):
    out = mixing.mix(docs(spark), by_block=False).collect()
    texts = {r[0]: r[1] for r in rows()}
    for r in out:
        if len(r["text"].split()) == len(texts[r["doc_id"]].split()):
            assert r["text"] == texts[r["doc_id"]]


def test_empty(spark):
    assert mixing.allotment(spark.createDataFrame([], DOCS)).count() == 0
    assert mixing.mix(spark.createDataFrame([], DOCS)).count() == 0


def test_large_populations(monkeypatch):
    """Beyond numpy's range the draw follows the distribution's own probabilities."""
    import math

    good, bad, n = 30, 45, 20
    total = math.comb(good + bad, n)
    want = [math.comb(good, k) * math.comb(bad, n - k) / total for k in range(n + 1)]
    monkeypatch.setattr(mixing, "DRAWN", 1)
    rng = np.random.default_rng(1)
    got = np.bincount([mixing._hypergeometric(rng, good, bad, n) for _ in range(40_000)], minlength=n + 1) / 40_000
    assert np.abs(got - want).max() < 0.01
    assert mixing._hypergeometric(rng, 5, 0, 3) == 3 and mixing._hypergeometric(rng, 0, 5, 3) == 0 and mixing._hypergeometric(rng, 4, 4, 8) == 4
    monkeypatch.undo()
    rng = np.random.default_rng(2)
    some = [mixing._hypergeometric(rng, 4 * 10**11, 6 * 10**11, 5 * 10**11) for _ in range(60)]
    sd = (5e11 * 0.4 * 0.6 * 0.5) ** 0.5
    assert abs(np.mean(some) - 2e11) < 0.6 * sd and 0.7 * sd < np.std(some) < 1.3 * sd
    assert mixing.split((3 * 10**12, 10**12 + 7), 16).sum(axis=0).tolist() == [3 * 10**12, 10**12 + 7]


def plain_shards(plan, sizes):
    """What each shard holds, block by block: (shard, source) to the words drawn."""
    held = collections.Counter()
    for s, n in enumerate(sizes):
        for turn in range(2):
            places = mixing.permuted(np.arange(plan.blocks[s]), plan.blocks[s], plan.seed + 1_000_003 * s + turn) + turn * plan.blocks[s]
            for block, at in enumerate(places.tolist()):
                shard = int(np.searchsorted(plan.ends[:, s], at, side="right"))
                if shard < len(plan.ends):
                    held[shard, s] += min((block + 1) * plan.block[s], n) - block * plan.block[s]
    return held


def test_shards_hold_their_quotas(spark):
    given = docs(spark)
    sizes = collections.Counter()
    for r in rows():
        sizes[r[3]] += len(re.findall(r"[^\x20\x09-\x0D]+", r[1] or ""))
    plan = mixing.make_plan(dict(sizes), shard=20_000)
    want = plain_shards(plan, [sizes[s] for s in plan.names])
    for by_block in (True, False):
        got = collections.Counter()
        out = mixing.mix(given, by_block=by_block, shard=20_000).collect()
        for r in out:
            got[r["shard"], plan.names.index(r["source"])] += len(r["text"].split())
        assert +got == +want
    blocks = collections.defaultdict(list)
    for r in mixing.mix(given, by_block=True, shard=20_000).collect():
        blocks[r["shard"]].append(r["position"])
    for places in blocks.values():  # places are shared only by the two ends of a block that two documents share
        assert sorted(set(places)) == list(range(len(set(places))))


def test_what_is_taken_follows_the_tree(spark, monkeypatch):
    key = lambda r: tuple(map(str, r))
    before = sorted(map(key, mixing.allotment(docs(spark), shard=20_000).collect()))
    tree = mixing.split
    monkeypatch.setattr(mixing, "split", lambda *a: tree(*a)[::-1])
    other = sorted(map(key, mixing.allotment(docs(spark), shard=20_000).collect()))
    assert [r[:6] for r in other] == [r[:6] for r in before] and other != before
    monkeypatch.setattr(mixing, "split", lambda *a: 0 * tree(*a))
    assert {r["taken"] for r in mixing.allotment(docs(spark), shard=20_000).collect()} == {0}


def test_many_sources_and_clashing_names(spark):
    from pyspark.sql import functions as F

    made = spark.createDataFrame([(i, f"w{i} " * (1 + i % 3), "en", f"s{i}", 1) for i in range(400)], DOCS)
    told = mixing.allotment(made).collect()
    assert len(told) == 400 and all(r["taken"] <= 2 * r["size"] for r in told)
    assert mixing.make_plan({str(i): 10 for i in range(5000)}, shard=1, block=1).ends.size <= mixing.CELLS
    odd = made.withColumn("shard", F.lit(7)).withColumn("a.b", F.lit("c")).withColumn("pass", F.lit(8)).withColumn("start", F.lit(9)).withColumn("edge", F.lit(0)).withColumn("words", F.lit("x"))
    out = mixing.mix(odd)
    assert len(out.columns) == len(set(out.columns))
    assert {tuple(r) for r in out.select("shard_doc", "`a.b`", "pass_doc", "start", "edge", "words").distinct().collect()} == {(7, "c", 8, 9, 0, "x")}
