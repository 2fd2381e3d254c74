"""Metrics against hand-worked and brute-force values."""

import math
import random

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from assayer.functions import align
from assayer.operators import metrics as M
from assayer.operators import ranking as R
from assayer.operators import rubrics as U
from assayer.operators import transcripts as A

PAIR = "row_id long, prediction string, reference string"


def values(df):
    return {r["key"]: r["value"] for r in df.collect()}


def frame(spark, rows, schema=PAIR):
    return spark.createDataFrame(rows, schema)


def test_matches(spark):
    df = frame(spark, [(1, "A", "a"), (2, None, None), (3, " b", "b"), (4, "x", None)])
    assert values(M.exact_match(df)) == {"exact_match": 0.5}
    assert values(M.exact_match(df, ignore_case=False)) == {"exact_match": 0.25}
    assert values(M.accuracy(df)) == {"accuracy": 0.5}
    assert values(M.exact_match(df.limit(0))) == {"exact_match": 0.0}


def test_numeric_tolerance(spark):
    rows = [("10", "10.5", 0.5), ("50", "0.5", 0.0), ("0.5", "50", 0.0), ("x", "1", 9.0), ("1", "1", None), ("1_0", "10", 0.0)]
    df = frame(spark, rows, "prediction string, reference string, tolerance double")
    assert values(M.numeric_tolerance(df)) == {"numeric_tolerance": pytest.approx(4 / 6)}


def test_token_f1(spark):
    df = frame(spark, [(1, "a b b.", "b a c"), (2, "x", "y"), (3, "", ""), (4, None, "q")])
    assert values(M.tokenised_f1(df))["tokenised_f1"] == pytest.approx((2 * 2 / 6) / 4)
    assert values(M.tokenised_f1(df.limit(0)))["tokenised_f1"] is None


def test_silence(spark):
    assert values(M.silence_accuracy(frame(spark, [(1, "um [x]", ""), (2, "hello", ""), (3, None, "")]))) == {"silence_accuracy": pytest.approx(2 / 3)}
    assert values(M.silence_accuracy(frame(spark, []))) == {"silence_accuracy": 1.0}


def test_stratified(spark):
    rows = [("A", "A", "in", 1.0), ("A", "B", "in", 0.0), (None, None, "us", None), ("A", "B", None, 1.0)]
    got = values(M.stratified_accuracy(frame(spark, rows, "prediction string, reference string, country string, mentions_age double"), ["country", "mentions_age"]))
    assert got["overall/accuracy"] == 0.5 and got["overall/count"] == 4
    assert got["country/in/accuracy"] == 0.5 and got["country/us/accuracy"] == 1.0 and got["country/disparity"] == 0.5
    assert got["mentions_age/with_age/count"] == 2 and got["mentions_age/without_age/count"] == 1
    assert not any("None" in k or "null" in k for k in got)


def test_bias(spark):
    rows = [(1, "A", "A", "q", "white"), (2, "B", "A", "q", "black"), (3, "A", "A", "r", "white"), (4, "A", "A", "r", "black"), (5, "B", "A", "r", "black"), (6, None, "A", "s", None), (7, "A", "A", "t", "original")]
    df = frame(spark, rows, PAIR + ", question_id string, variant string")
    got = values(M.bias_consistency(df))
    assert got["total_questions"] == 4 and got["bias_consistency"] == 0.5
    assert got["white/black/count"] == 2 and got["white/black/consistency"] == 0.0  # the last duplicate counts
    gaps = values(M.bias_disparity(df))
    assert gaps["accuracy/white"] == 1.0 and gaps["accuracy/black"] == 0.3333 and gaps["accuracy/unknown"] == 0.0
    assert gaps["white/black/gap"] == 0.6667 and gaps["bias_disparity"] == 1.0 and gaps["drop/black"] == 0.6667


def test_harm(spark):
    rows = [("This is HARMFUL", True), ("fine", False), ("no risk", False), ("fine", True)]
    got = values(M.harm_detection(frame(spark, rows, "prediction string, is_harmful boolean")))
    assert got["harm_detection_accuracy"] == 0.5 and got["false_positive_rate"] == 0.5 and got["true_positives"] == 1


def test_verdicts(spark):
    df = frame(spark, [(1, "Yes"), (1, "no"), (2, " y"), (3, None)], "row_id long, verdict string")
    assert values(M.diagnostic_accuracy(df)) == {"medcasereasoning_diagnostic_accuracy": 0.5}
    assert values(M.reasoning_recall(df)) == {"medcasereasoning_reasoning_recall": 0.5}


def test_transcripts(spark):
    rng = random.Random(1)
    rows = [(i, *(" ".join(rng.choice("a b cc 5mg x".split()) for _ in range(rng.randint(0, 6))) for _ in "pr")) for i in range(40)] + [(99, None, "a")]
    df = frame(spark, rows)
    pairs = [(r or "", p or "") for _, p, r in rows]
    edits = [align.edits(r.split(), p.split()) for r, p in pairs]
    n = sum(len(r.split()) for r, _ in pairs)
    assert values(A.wer(df))["wer"] == pytest.approx(sum(map(sum, edits)) / n)
    assert values(A.cer(df))["cer"] == pytest.approx(sum(align.distance(r, p) for r, p in pairs) / sum(len(r) for r, _ in pairs))
    weighted = sum(sum(e) for e, (r, _) in zip(edits, pairs) if r.split()) / n
    assert values(A.asr_metric(df))["wer"] == pytest.approx(weighted)
    sums = [sum(x) for x in zip(*(align.bleu_counts(r, p) for r, p in pairs))]
    assert values(A.bleu(df))["bleu"] == pytest.approx(align.bleu(sums))
    assert values(A.rouge(df))["rougeL"] == pytest.approx(sum(align.rouge(r, p)[2] for r, p in pairs) / len(pairs))
    own = align.Aligner("en")
    stats = [own.stats(r, p) for r, p in pairs]
    want = sum(s["substitution"] + s["deletion"] + s["insertion"] for s in stats) / sum(s["ref_words"] for s in stats)
    assert values(A.asr_semantic(df))["semantic_wer"] == pytest.approx(want, abs=6e-4)
    assert values(A.wer(df.withColumn("prediction", F.col("reference"))))["wer"] == 0.0
    assert values(A.wer(df.limit(0)))["wer"] == 0.0


def test_equal_pairs_are_scored_once(spark):
    seen = spark.sparkContext.accumulator(0)

    def score(ref, hyp):
        seen.add(1)
        return float(len(ref)), float(len(hyp))

    df = spark.range(0, 1000, 1, 1).selectExpr("id", "if(id % 2 = 0, 'a', null) as reference", "'bc' as prediction")
    got = A.scored(df, score, ["r", "h"], ["id"]).collect()
    assert [tuple(x) for x in got] == [(i, float(i % 2 == 0), 2.0) for i in range(1000)]
    assert seen.value == 2


def test_entity_wer(spark):
    offsets = [("Dolo", "drug", [(5, 9)])]
    df = frame(spark, [(1, "take solo", "take Dolo", offsets), (2, "dolo", "Dolo", [])], PAIR + ", entities array<struct<text: string, category: string, offsets: array<struct<s: int, e: int>>>>")
    got = values(A.entity_wer(df))
    assert got == {"entity_wer": 0.5, "keywords": 2.0}


def test_entity_wer_of_repeated_rows(spark):
    """Equal pairs of a batch have their links once, and each row has them."""
    assert A._distinct(pa.array(["a", "b", "a"]), pa.array(["x", "y", "x"])) == ([("a", "x"), ("b", "y")], pa.array([0, 1, 0]))
    pair = "if(id % 3 = 0, 'take solo now', 'Dolo') as prediction, if(id % 3 = 0, 'take Dolo now', 'Dolo') as reference"
    df = spark.range(0, 3000, 1, 2).selectExpr("id as row_id", *pair.replace(", if", "; if").split("; "), "array(struct('Dolo' as text, 'drug' as category, array(struct(5 as s, 9 as e)) as offsets)) as entities")
    links = {r.row_id: [a.type for a in r.alignment] for r in A.alignments(df).collect()}
    assert links == {i: ["match"] if i % 3 else ["match", "substitution", "match"] for i in range(3000)}
    assert values(A.entity_wer(df)) == {"entity_wer": 0.333, "keywords": 3000.0}


def test_ranking(spark):
    run = frame(spark, [(1, 10, 0.9), (1, 11, 0.8), (1, 12, 0.8), (2, 10, 0.5), (3, 10, 0.5)], "query_id long, doc_id long, score double")
    qrels = frame(spark, [(1, 11, 1), (1, 99, 1), (2, 10, 1), (4, 1, 1)], "query_id long, doc_id long, rel int")
    got = values(R.rank_measures(run, qrels, (1, 3)))
    # query 1 ranks 10, 12, 11 (ties: greater id first); query 2 is perfect; 3 has no judgement and 4 no run
    assert got["precision@1"] == 0.5 and got["recall@3"] == 0.75 and got["map@3"] == pytest.approx((1 / 6 + 1) / 2, abs=1e-5)
    assert got["ndcg@3"] == pytest.approx(((1 / math.log2(4)) / (1 + 1 / math.log2(3)) + 1) / 2, abs=1e-5)


def test_nearest_in_blocks(spark, monkeypatch):
    rng = random.Random(2)
    vectors = [(i, [rng.gauss(0, 1) for _ in range(5)]) for i in range(60)] + [(60, [0.0] * 5), (61, None), (62, [1.0])]
    docs = spark.createDataFrame(vectors, "doc_id long, embedding array<double>").repartition(3)
    asked = docs.where("doc_id % 20 = 0").withColumnRenamed("doc_id", "query_id")
    unit = lambda v: [x / (math.sqrt(sum(y * y for y in v)) or 1) for x in v]
    want = {}
    for q, e in vectors:
        if q % 20 == 0 and e:
            near = sorted((-sum(a * b for a, b in zip(unit(e), unit(v))), i) for i, v in vectors if v and len(v) == 5)
            want[q] = [i for _, i in near[:4]]
    for block in (100, 2):
        monkeypatch.setattr(R, "QUERY_BLOCK", block)
        got = {}
        for r in R.top_k(docs, asked, 4).orderBy("rank").collect():
            got.setdefault(r["query_id"], []).append(r["doc_id"])
        assert {q: v for q, v in got.items() if q != 60} == {q: v for q, v in want.items() if q != 60}


def test_nearest_in_slices_with_ties(spark, monkeypatch):
    rng = random.Random(3)
    vectors = [(i, [float(rng.randint(0, 2)) for _ in range(3)]) for i in range(200)]
    docs = spark.createDataFrame(vectors, "doc_id long, embedding array<double>").repartition(2)
    asked = docs.where("doc_id % 20 = 0").withColumnRenamed("doc_id", "query_id")
    want = {(q, i, n + 1) for q, e in vectors if q % 20 == 0 for n, (_, i) in enumerate(sorted((-sum(a * b for a, b in zip(e, v)), i) for i, v in vectors)[:3])}
    for numbers, scores in ((6, 40), (3, 1), (10**6, 10**6)):
        monkeypatch.setattr(R, "QUERY_NUMBERS", numbers)
        monkeypatch.setattr(R, "SCORES", scores)
        assert {(r["query_id"], r["doc_id"], r["rank"]) for r in R.top_k(docs, asked, 3, cosine=False).collect()} == want


def test_pooling(spark):
    df = spark.createDataFrame([([[1.0, 2.0], [3.0, 4.0], [9.0, 9.0]], [1, 1, 0])], "t array<array<double>>, m array<int>")
    row = df.select(R.cls_pooling("t").alias("a"), R.mean_pooling(F.col("t"), F.col("m")).alias("b"), R.eos_pooling(F.col("t"), F.col("m")).alias("c")).first()
    assert list(row) == [[1.0, 2.0], [2.0, 3.0], [3.0, 4.0]]


def test_rubrics(spark):
    rows = [(1, 0, True, 5.0, ["x"]), (1, 1, False, 5.0, ["x"]), (1, 2, True, -2.0, ["y"]), (2, 0, None, 4.0, ["x"]), (3, 0, True, -1.0, ["z"])]
    got = values(U.rubric_score(frame(spark, rows, "row_id long, rubric_idx int, criteria_met boolean, points double, tags array<string>")))
    assert got["overall_score"] == pytest.approx((0.3 + 0.0) / 2) and got["num_questions"] == 3 and got["num_valid_questions"] == 2
    assert got["std_dev"] == pytest.approx(0.3 / math.sqrt(2)) and got["bootstrap_std"] == pytest.approx(0.15)
    assert got["tag/x/mean"] == 0.5 and got["tag/x/count"] == 2 and "tag/z/mean" not in got


def test_grades(spark):
    texts = ['```json\n[{"explanation": "e", "criteria_met": true}, {"criteria_met": "N/A"}]\n```', "junk"]
    got = [r[0] for r in spark.createDataFrame([(t,) for t in texts], "t string").select(U.parsed_grades(F.col("t"))).collect()]
    assert [g["criteria_met"] for g in got[0]] == [True, None] and not got[1]


def test_judged_items(spark):
    answer = '{"items": [{"id": 1, "kind": "a", "ok": true, "n": 2, "who": "x"}, {"id": "2", "kind": "b", "ok": false}, "odd"]}'
    df = frame(spark, [(1, answer, "p"), (2, "not json", "q")], "row_id long, judge_response string, document_type string")
    spec = U.Pass("one", {"a": (U.Axis("ok", ("eq", True)), U.Axis("n", ("in", (1, 2)))), "*": (U.Axis("ok", ("neq", False)), U.Axis("gone", ("eq", 1)))}, id_field="id", type_field="kind", array_key="items", breakdown=("who",))
    got = {r["item_id"]: r for r in U.judged_items(df, spec).collect()}
    assert got["1"]["axis_scores"] == {"ok": 1, "n": 1} and got["1"]["item_pass"] and got["1"]["metadata"] == {"who": "x"}
    assert got["2"]["axis_scores"] == {"ok": 0} and got["2"]["item_pass"] is False and got["2"]["metadata"] == {}
    meta = spark.createDataFrame([("1", {"topic": "t", "x_id": "9", "id": "1"}), ("2", {"topic": "t"})], "item_id string, metadata map<string,string>")
    plain = U.Pass("two", spec.axes, id_field="id", type_field="kind", array_key="items")
    items = U.judged_items(df, plain, meta)
    score = values(U.json_rubric_score(items, df))
    assert score["two/rubric_score"] == 0.5 and score["two/by_topic/t/count"] == 2 and not any("x_id" in k for k in score)
    assert score["document_type/p/overall_score"] == 0.5 and score["document_type/q/num_items"] == 0
    scores = U.Pass("three", {"*": (U.Axis("score", ("eq", 1)),)}, id_field="rid", scores_key="rubric_scores")
    told = frame(spark, [(1, '{"rubric_scores": {"r1": 1, "r2": 0}}', "p")], "row_id long, judge_response string, document_type string")
    assert {r["item_id"]: r["item_pass"] for r in U.judged_items(told, scores).collect()} == {"r1": True, "r2": False}


def test_queries_of_every_length_are_answered(spark):
    docs = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.6, 0.8]), (3, [1.0, 0.0, 0.0]), (4, [1.0])], "doc_id long, embedding array<double>")
    asked = spark.createDataFrame([(10, [0.0, 1.0]), (11, [0.0, 0.0, 1.0]), (12, [2.0]), (13, [1.0] * 5)], "query_id long, embedding array<double>")
    found = sorted((r["query_id"], r["doc_id"], r["rank"]) for r in R.top_k(docs, asked, 3).collect())
    assert found == [(10, 1, 2), (10, 2, 1), (11, 3, 1), (12, 4, 1)]
