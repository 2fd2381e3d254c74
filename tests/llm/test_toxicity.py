import itertools
import math
import random
import zlib

import numpy as np

from assayer.llm import toxicity

from .fixtures import DOCS, LABELS, docs, prose, rows

CHAIN = toxicity.Chain({"bad": 1, "awful": 2}, -2.0, (0.0, 3.0, 4.0, 5.0, 6.0), (0.0, 0.5, 0.2, 0.1, 0.3), ((0.4, -0.5), (-0.3, 0.9)), (-3.0, 4.0, 2.0))


def plain_marginals(chain, strengths):
    n = len(strengths)
    get = lambda i: strengths[i] if 0 <= i < n else 0
    total, out = 0.0, [0.0] * n
    for tags in itertools.product([0, 1], repeat=n):
        score = sum(t * (chain.bias + chain.own[get(i)] + chain.beside[get(i - 1)] + chain.beside[get(i + 1)]) for i, t in enumerate(tags))
        score += sum(chain.transition[a][b] for a, b in zip(tags, tags[1:]))
        p = math.exp(score)
        total += p
        for i, t in enumerate(tags):
            out[i] += t * p
    return [x / total for x in out]


def test_marginals_are_exact():
    rng = random.Random(11)
    for _ in range(60):
        strengths = [rng.choice([0, 0, 0, 0, 1, 2, 4]) for _ in range(rng.randint(1, 11))]
        got = toxicity.marginals(CHAIN, {i: s for i, s in enumerate(strengths) if s}, len(strengths))
        want = plain_marginals(CHAIN, strengths)
        assert all(abs(p - want[i]) < 1e-9 for i, p in got.items())
        assert set(got) >= {i for i, s in enumerate(strengths) if s}


def test_forward_backward_agrees():
    rng = random.Random(12)
    rows = [[rng.choice([0, 0, 1, 2]) for _ in range(8)] for _ in range(5)]
    mask = np.array([[i < n for i in range(8)] for n in (8, 5, 1, 8, 3)])
    emission = CHAIN.emission(np.where(mask, np.array(rows), 0))
    marginal, _ = toxicity._forward_backward(emission, mask, np.array(CHAIN.transition), np.ones(5))
    for r, m, got in zip(rows, mask, marginal):
        n = int(m.sum())
        own = r[:n]
        want = plain_marginals(CHAIN, own)
        assert np.allclose(got[:n], want) and (got[n:] == 0).all()


def test_long_gaps_and_offsets():
    text = "ok " * 100_000 + "Bad, awful " + "fine " * 50_000
    found = toxicity.tags(CHAIN, text)
    hit = [text[a:b] for a, b, p in found if p >= 0.5]
    assert "Bad" in hit and "awful" in hit
    turned = "İstanbul İ bad x"  # a letter whose lower case is two
    assert [turned[a:b] for a, b, p in toxicity.tags(CHAIN, turned) if p > 0.3][-1:] == ["bad"] or "bad" in [turned[a:b] for a, b, _ in toxicity.tags(CHAIN, turned)]


def made(n=900):
    rng = random.Random(13)
    insults = ["gromp", "fleck", "snarl", "blotz"]
    out, labels = [], []
    for i in range(n):
        words = prose(rng, rng.randint(20, 60)).split()
        toxic = i % 4 == 0
        if toxic:
            for _ in range(rng.randint(1, 4)):
                words.insert(rng.randrange(len(words)), rng.choice(insults) + rng.choice(["", ",", "!"]))
        out.append((i, " ".join(words), "en", "a", 1))
        labels.append((i, 1, int(toxic)))
    return out, labels


def test_held_out_accuracy(spark):
    texts, labels = made()
    df = spark.createDataFrame(texts, DOCS)
    chain = toxicity.learn(df, spark.createDataFrame(labels, LABELS))
    found = toxicity.digest(toxicity.tag(df, chain)).collect()
    truth = {i: t for i, _, t in labels}
    held = [r for r in found if r["held_out"]]
    assert {r["doc_id"] for r in held} == {i for i in truth if zlib.crc32(str(i).encode()) % 5 == 0}
    assert sum(r["predicted"] == truth[r["doc_id"]] for r in held) > 0.97 * len(held)
    spoken = {i: t for i, t, *_ in texts}
    for r in held:
        for span in filter(None, r["offsets"].split(",")):
            a, b = map(int, span.split(":"))
            assert spoken[r["doc_id"]][a:b] in ("gromp", "fleck", "snarl", "blotz")


def test_held_out_labels_are_never_read(spark):
    texts, labels = made(300)
    df = spark.createDataFrame(texts, DOCS)
    other = [(i, q, t if toxicity.is_training(i) else 1 - t) for i, q, t in labels]
    assert toxicity.learn(df, spark.createDataFrame(labels, LABELS)) == toxicity.learn(df.repartition(5), spark.createDataFrame(other, LABELS))


def test_odd_rows(spark):
    chain = toxicity.learn(docs(spark), spark.createDataFrame([(1, 1, 1), (None, 1, 1), (2, 1, None)], LABELS))
    found = toxicity.digest(toxicity.tag(docs(spark), chain)).collect()
    assert len(found) == len(rows()) and all(0 <= r["score"] <= 1 for r in found)
    empty = toxicity.learn(spark.createDataFrame([], DOCS), spark.createDataFrame([], LABELS))
    assert toxicity.tag(spark.createDataFrame([], DOCS), empty).count() == 0
    assert all(r["score"] == 0.5 for r in toxicity.tag(docs(spark), empty).collect())
