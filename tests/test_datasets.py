"""Every dataset of the catalogue from a source row to its results."""

import json

import pytest
from pyspark.sql import functions as F

from assayer.operators import cache as C
from assayer.operators import judges as J
from assayer.operators import metrics as M
from assayer.operators import predict as Q
from assayer.operators import rubrics as U
from assayer.plans import registry, run
from assayer.sources import datasets as D

MAP = {"A": "x", "B": "y"}
RUBRIC = "array<struct<criterion: string, points: double, tags: array<string>>>"
#: Source rows by the function that builds samples from them.
SOURCES = {
    "nested_mcq": ([({"Question": "q", "Options": MAP, "Context": ["c"], "Correct Option": "A"},)], "data struct<Question: string, Options: map<string,string>, Context: array<string>, `Correct Option`: string>"),
    "usmle": ([("q", MAP, "A")], "question string, options map<string,string>, answer_idx string"),
    "indexed_mcq": ([("q", "x", "y", "z", None, 0)], "question string, opa string, opb string, opc string, opd string, cop int"),
    "subset_mcq": ([("q", ["x", "y"], ["A"])], "centerpiece string, options array<string>, correct_options array<string>"),
    "json_mcq": ([("q", '{"A": "x"}', "A")], "question string, options string, answer string"),
    "five_column_mcq": ([("q", "x", "y", "z", None, None, "a")], "question string, option_a string, option_b string, option_c string, option_d string, option_e string, correct_answer string"),
    "list_mcq": ([("q", ["x", "y"], "A")], "question string, options array<string>, answer string"),
    "label_mcq": ([("q", MAP, "A", [b"i"])], "question string, options map<string,string>, label string, images array<binary>"),
    "regional_mcq": ([("q", None, '{"option1": "x", "option2": "y"}', "option1", "mcq", "test", "k", 1.0, 0.0)], "question string, question_clean string, answer_options string, correct_answer string, question_type string, split string, country string, mentions_gender double, mentions_age double"),
    "regional_open": ([("q", "consumer queries")], "question string, question_type string"),
    "harm": ([("q", 1.0)], "question string, rated_harmful double"),
    "bias_variants": ([("i", "q", "d", "w", "b", "m", "f", "h", "l", MAP, "A")], "question_id string, original_question string, desensitized_question string, adv_question_white string, adv_question_black string, adv_question_male string, adv_question_female string, adv_question_high_income string, adv_question_low_income string, options map<string,string>, answer_idx string"),
    "visual": ([("q", "Yes", (b"i",))], "question string, answer string, image struct<bytes: binary>"),
    "parallel_text": ([("a", "b")], "eng_Latn string, hin_Deva string"),
    "speech": ([((b"s",), "it hurts")], "audio struct<bytes: binary>, text string"),
    "calculator": ([("q", None, "5", 0.1, "f")], "question_text string, confinement_instruction string, expected_output string, tolerance double, primary_field string"),
    "refusals": ([("p", 1)], "prompt string, harmful_level int"),
    "patient_safety": ([("p", 1)], "content string, category int"),
    "case_reasoning": ([("c", "flu", "1. a\n2. b")], "case_prompt string, final_diagnosis string, diagnostic_reasoning string"),
    "rubric_conversation": ([([("hi", "user")], [("be kind", 2.0, ["t"]), ("be brief", -1.0, None)])], f"prompt array<struct<content: string, role: string>>, rubrics {RUBRIC}"),
    "staged_rubric": ([("i", "ask", '[{"criterion": "a", "points": 2}]', '[{"criterion": "b"}]', 1)], "prompt_id string, doctor_query string, query_rubrics string, answer_rubrics string, difficulty_level int"),
    "history_summary": ([('{"hpi": "x", "dob": "2000-01-01"}', [("a", 1.0, None)])], f"prompt string, rubrics {RUBRIC}"),
    "document_json": ([("p", "r", "letter", (b"i",))], "sample_prompt string, rubrics string, document_type string, image struct<bytes: binary>"),
    "retrieval": ([(7, "t")], "query_id long, text string"),
}
SOURCES["context_mcq"] = SOURCES["nested_mcq"]
ARGUMENTS = {"parallel_text": {"source_language": "eng_Latn", "target_language": "hin_Deva"}, "speech": {"language": "en"}, "subset_mcq": {"subset": "college-chemistry"}}


def judge(prompt):
    if "rubric_scores" in prompt:
        return '{"rubric_scores": {"0": 1, "1": 0}}'
    if "Criteria:" in prompt:
        return json.dumps([{"explanation": "", "criteria_met": True}] * len(prompt.split("Criteria:\n")[1].split("\n")))
    return "Yes"


@pytest.mark.parametrize("name", sorted(D.DATASETS))
def test_evaluated(spark, name):
    d = D.DATASETS[name]
    kind = "bias_variants" if name.startswith("amqa") else d.build.__name__
    rows, schema = SOURCES[kind]
    given = dict(ARGUMENTS.get(kind, {}))
    if kind == "retrieval":
        given["qrels"] = spark.createDataFrame([(7, 1, 1)], "query_id long, doc_id long, rel int")
    source = D.numbered(spark.createDataFrame(rows, schema), name)
    samples = d.build(source, **given)
    assert samples.count() == {"amqa": 8}.get(name, 4 if kind == "bias_variants" else 1)
    answer = {"retrieval": '{"1": 0.5}', "json_mcq": "(A)", "five_column_mcq": "(A)", "list_mcq": "Final Answer: A", "label_mcq": "Final Answer: A"}.get(kind, "Final Answer: (A)")
    own = samples.withColumn("input", F.coalesce("input", F.lit("")))
    found = run.evaluate(own, lambda: Q.EchoPredictor(lambda p: answer), d.metrics, d.extract, dataset=name, task_type=d.task_type, judge=lambda: Q.EchoPredictor(judge)).collect()
    assert {r["metric"] for r in found} == set(d.metrics) and all(r["num_samples"] >= 1 for r in found)
    if kind.endswith("mcq") and kind not in ("subset_mcq",):
        assert {r["value"] for r in found if r["key"] == "exact_match"} == {1.0}
    if kind == "retrieval":
        assert {r["value"] for r in found if r["key"].endswith("@1")} == {1.0}


def test_every_metric_is_there():
    assert {m for d in D.DATASETS.values() for m in d.metrics} <= set(registry.metrics.names())
    assert len(registry.metrics.names()) >= 29


def test_judged_metrics_need_a_judge(spark):
    rows = spark.createDataFrame([(1, "p", "r", [("0", "c", 1.0, None)])], "row_id long, prediction string, input string, rubric array<struct<rubric_id: string, criterion: string, points: double, tags: array<string>>>")
    with pytest.raises(ValueError, match="judge"):
        J.rubric_evaluation(rows)


def test_criteria_are_graded_in_batches(spark):
    rubric = [(str(i), f"c{i}", 1.0, ["even" if i % 2 == 0 else "odd"]) for i in range(23)]
    rows = spark.createDataFrame([(1, "p", "r", rubric), (2, "p", "r", []), (3, "p", None, None)], "row_id long, prediction string, input string, rubric array<struct<rubric_id: string, criterion: string, points: double, tags: array<string>>>")
    prompts = J.rubric_prompts(rows, batch=10)
    assert sorted(len(r["criteria"]) for r in prompts.collect()) == [3, 10, 10]
    met = lambda p: json.dumps([{"criteria_met": "c1" in line} for line in p.split("Criteria:\n")[1].split("\n")][:9])  # noqa: E731  the tenth is left out
    graded = J.rubric_graded(J.answered(prompts, lambda: Q.EchoPredictor(met))).collect()
    got = {r["rubric_idx"]: r["criteria_met"] for r in graded}
    assert sorted(got) == list(range(23)) and got[9] is None and got[19] is None
    assert [i for i, v in got.items() if v] == [1, *range(10, 19)]
    assert J.rubric_prompts(rows, "odd").count() == 2


def test_last_metadata_counts(spark):
    told = spark.createDataFrame([(1, '{"items": [{"id": "a", "ok": 1}]}', "d")], "row_id long, judge_response string, document_type string")
    known = spark.createDataFrame([("a", {"k": "old"}, 1), ("a", {"k": "new"}, 2)], "item_id string, metadata map<string,string>, position int")
    spec = U.Pass("p", {"*": (U.Axis("ok", ("eq", 1)),)}, id_field="id", array_key="items")
    items = U.judged_items(told, spec, known).collect()
    assert [r["metadata"] for r in items] == [{"k": "new"}]
    assert len(U.judged_items(told, spec, known.drop("position")).collect()) == 1
    fails = lambda df: df.select("nothing")
    rows = U.judged_items(told, spec)
    assert U.postprocessed(rows, fails) is rows or U.postprocessed(rows, lambda df: df.limit(0)).count() == 0


def test_tokenised_f1_is_within_a_row(spark):
    df = spark.createDataFrame([(1, "a b b", "c"), (1, "c", "a b b"), (2, "a a b", "a b b"), (3, "", ""), (4, None, "x")], "row_id long, prediction string, reference string")
    assert M.tokenised_f1(df).first()["value"] == pytest.approx((2 * 2 / 6) / 5)


def test_media_are_part_of_the_key(spark):
    rows = [("q", [b"1"], None), ("q", [b"2"], None), ("q", None, b"1"), ("q", None, b"2"), ("q", None, None), ("q", [b"1"], None)]
    keys = [r["cache_key"] for r in C.with_key(spark.createDataFrame(rows, "input string, images array<binary>, audio binary"), "c").collect()]
    assert len(set(keys)) == 5 and keys[0] == keys[5]


def test_deltas_are_compacted(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(C, "DELTAS", 2)
    table = C.CacheTable(spark, str(tmp_path / "cache"))
    for i in range(4):
        table.upsert(spark.range(2).select(F.concat(F.lit("k"), F.col("id") + i).alias("cache_key"), F.lit(str(i)).alias("model_output"), F.timestamp_seconds(F.lit(i)).alias("updated_at")))
    assert {r["cache_key"]: r["model_output"] for r in table.read().collect()} == {"k0": "0", "k1": "1", "k2": "2", "k3": "3", "k4": "3"}
    assert len(table._parts()) <= 3 and any(n.startswith("snapshot-") for n in table._parts())
    two = spark.createDataFrame([("x", "b"), ("x", "a")], "config_hash string, model_id string")
    assert C.missing(two.limit(0), two, "config_hash").count() == 1


def test_row_ids_follow_from_the_rows(spark):
    df = spark.createDataFrame([("q", MAP, "A"), ("r", MAP, "A")], "question string, options map<string,string>, answer_idx string")
    ids = lambda x: sorted(r["row_id"] for r in D.numbered(x, "d").collect())
    assert ids(df) == ids(df.repartition(3)) and len(set(ids(df))) == 2
