import hashlib
import re

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from assayer.llm import pii

from .fixtures import DOCS, docs, rows

KINDS = pii.KINDS


def luhn(digits):
    total = 0
    for i, c in enumerate(reversed(digits)):
        v = int(c) * (2 if i % 2 else 1)
        total += v - 9 if v > 9 else v
    return total % 10 == 0


def plain(text):
    out = [(m.start(), 0, m.end()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text)]
    out += [(m.start(), 1, m.end()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text) if all(int(x) <= 255 for x in m[0].split("."))]
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text):
        digits = re.sub("[^0-9]", "", m[0])
        if 14 <= len(digits) <= 19 and luhn(digits):
            out.append((m.start(), 2, m.end()))
    out += [(m.start(), 3, m.end()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text) if 10 <= len(re.sub("[^0-9]", "", m[0])) <= 15]
    return sorted(out)


def listed(spans, names=pii.ALL_KINDS):
    return ",".join(f"{names[k]}:{a}:{b}" for a, k, b in spans)


TEXTS = [
    "", "mail me: a.b@c.de, x@y.z_w@v.u and @ a@b", "ips 1.2.3.4 1.2.3.4.5.6.7.8 256.1.1.1 007.1.1.1 1.2.3", "4111 1111 1111 1111 4111-1111-1111-1112 79927398713 123456789012345678901234567890",
    "+1 (017) 555-7713, +12 3 +49 30 1234567890123456", "é😀 a@b.cd 😀 10.0.0.1 +1 650 253 0000", 'token = "04dbebab91ab85687d33eeaaf9ac699e1188f962" ok', "call 650-253-0000 or (650) 253-0000", "a@b.c" * 50, "1" * 3000, "a." * 3000 + "@", "x@" * 500,
    "write to jane (at) host (dot) org", "1.1.1.1" * 40, "0" * 16, "4111111111111111 " * 30,
]


def found(spark, texts, model=None):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    return {r["doc_id"]: r for r in pii.detect(df, model).select("doc_id", "text", "pii_base", "pii_spans", pii.redacted(F.col("text"), F.col("pii_spans")).alias("red")).collect()}


def test_base_spans(spark):
    for i, r in found(spark, TEXTS).items():
        assert [(s["start"], s["rank"], s["stop"]) for s in r["pii_base"]] == plain(TEXTS[i]), TEXTS[i][:80]
        assert {tuple(s) for s in r["pii_base"]} <= {tuple(s) for s in r["pii_spans"]}


@given(st.lists(st.text(alphabet="a1.@+- ()9_%é", max_size=60), min_size=20, max_size=40))
@settings(max_examples=4, deadline=None)
def test_base_spans_of_noise(spark, texts):
    for i, r in found(spark, texts).items():
        assert [(s["start"], s["rank"], s["stop"]) for s in r["pii_base"]] == plain(texts[i]), texts[i]


def test_more_spans_and_redaction(spark):
    got = found(spark, TEXTS)
    secret = TEXTS[6]
    assert [(s["rank"], secret[s["start"] : s["stop"]]) for s in got[6]["pii_spans"]] == [(4, "04dbebab91ab85687d33eeaaf9ac699e1188f962")]
    assert got[6]["red"] == 'token = "<SECRET>" ok'
    assert got[5]["red"] == "é😀 <EMAIL> 😀 <IP> <PHONE>"
    assert got[0]["red"] == ""


def test_em_recovers_reliabilities():
    import random

    rng = random.Random(5)
    counts = {}
    for _ in range(20_000):
        true = rng.random() < 0.4
        votes = tuple((1 if (rng.random() < right) == true else -1) if rng.random() < 0.8 else 0 for right in (0.95, 0.8, 0.7))
        counts[votes] = counts.get(votes, 0) + 1
    model = pii.train([(0, v, 5, n) for v, n in sorted(counts.items())], rounds=80, belief=0.0)
    for name, want in zip(pii.LABELERS, (0.95, 0.8, 0.7)):
        assert all(abs(got - want) < 0.06 for got in model.reliability[0][name])
    assert model.weights[0][1] > 0 > model.weights[0][2]


def test_few_labelers_leave_failed_checksums_alone(spark):
    # votes as two informative labelers give them: valid cards, valid by chance, failed ones of either prefix
    counts = {(1, 1, 0): 158, (1, 0, 0): 16, (-1, 0, 0): 146, (-1, 1, 0): 11}
    for scale in (1, 100):
        model = pii.train([(2, v, 10, n * scale) for v, n in counts.items()])
        odds = {v: sum(a * b for a, b in zip(model.weights[2], pii._features(v, 10))) for v in counts}
        assert {v for v, x in odds.items() if x > 0} == {(1, 1, 0), (1, 0, 0)}
    texts = ["pay 4111111111111111 now"] * 20 + ["ref 9807915762804490 x"] * 15 + ["none"]
    got = found(spark, texts)
    assert all(len(got[i]["pii_spans"]) == (i < 20) for i in got)


def test_odd_rows(spark):
    out = pii.digest(pii.detect(docs(spark))).collect()
    want = []
    for r in rows():
        spans = plain(r[1] or "")
        want.append((str(r[0]), *(sum(k == i for _, k, _ in spans) for i in range(4)), hashlib.sha256(listed(spans).encode()).hexdigest()))
    assert sorted((str(r[0]), *r[1:6]) for r in out) == sorted(want)
    assert pii.detect(spark.createDataFrame([], DOCS)).count() == 0


def test_no_python_in_the_plan(spark):
    plan = pii.digest(pii.detect(docs(spark)))._jdf.queryExecution().toString()
    assert not re.search("Python|Pandas|ArrowEval", plan)


def test_long_values_are_found(spark):
    digest = "".join(hashlib.sha256(bytes([i])).hexdigest() for i in range(4))  # 256 digits
    local = "j" + "a" * 90
    texts = [f'token = "{digest}" ok', f'secret: "{digest[:160]}" ok', f"write to {local} (at) host{'s' * 80} (dot) organisation ok"] + [f'api_key = "{hashlib.sha1(bytes([i])).hexdigest()}" ok' for i in range(20)]
    got = found(spark, texts)
    for i, want in ((0, digest), (1, digest[:160])):
        assert [texts[i][s["start"] : s["stop"]] for s in got[i]["pii_spans"]] == [want]
    assert [c.value for c in spark.createDataFrame([(texts[2],)], "t string").select(F.explode(pii.found(F.col("t"), pii.LOOSE["email"])).alias("c")).select("c.value").collect()] == [texts[2][9:-3]]


def test_estimates_move_with_the_votes():
    """Five labelers whose reliability isn't what was believed: EM comes near the true ones, at the default belief."""
    import random

    rng = random.Random(6)
    true = {"validity": 0.9, "gazetteer": 0.9, "context": 0.65, "shape": 0.85, "edges": 0.6}
    counts = {}
    for _ in range(30_000):
        real = rng.random() < 0.15
        votes = tuple((1 if (rng.random() < right) == real else -1) if rng.random() < 0.7 else 0 for right in true.values())
        counts[votes] = counts.get(votes, 0) + 1
    model = pii.train([(0, v, 5, n) for v, n in sorted(counts.items())])
    assert abs(model.share[0] - 0.15) < 0.03
    for name, want in true.items():
        assert all(abs(got - want) < 0.06 for got in model.reliability[0][name]), (name, model.reliability[0][name])
    assert pii.train([]).weights == {}


def test_clashing_names(spark):
    odd = spark.createDataFrame([("a@b.cd", 1, 2, 3, "x"), (None, 4, 5, 6, "y")], "text string, `__c` long, c long, pii_base long, `row` string")
    out = pii.detect(odd)
    assert out.columns == ["text", "__c", "c", "row", "pii_base", "pii_spans"]
    assert sorted((r["__c"], r["c"], r["row"], len(r["pii_base"])) for r in out.collect()) == [(1, 2, "x", 1), (4, 5, "y", 0)]
