"""A query for every family of benchmark datasets: source rows made from the driver's tables, built into samples.

The oracle spells the expected prompts and references out in SQL.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import extract as X
from ..operators import predict as Q
from ..operators import transcripts as A
from ..sources import datasets as D
from . import run
from .catalog import _table, query

_NL = "chr(10)"
_ASK = f"'Answer the multiple-choice question below. End with a line `Final Answer: (letter)`.' || {_NL} || {_NL}"


def _asked(question: str, reference: str, *more: str) -> str:
    return f"SELECT p_partkey AS row_id, {_ASK} || {question} AS input, {reference} AS reference{''.join(', ' + m for m in more)} FROM part"


def _options(*options: str) -> str:
    return "".join(f" || {_NL} || {o}" for o in options)


def _parts(spark: SparkSession, sf_dir: str, **columns: Column) -> DataFrame:
    own = _table(spark, sf_dir, "part").select(F.col("p_partkey").alias("row_id"), *(c.alias(n) for n, c in columns.items()))
    return D.numbered(own, "parts")


def _built(rows: DataFrame, name: str, *more: Column, **arguments: object) -> DataFrame:
    return D.DATASETS[name].build(rows, **arguments).select("row_id", "input", "reference", *more)


def _meta(key: str) -> Column:
    return F.try_element_at("meta", F.lit(key)).alias(key)


class _Part:
    """Columns of `part` by name, made when they are used, as there is no session on import."""

    def __getattr__(self, name: str) -> Column:
        return F.col(f"p_{name}")


P = _Part()


def _two() -> Column:
    return F.create_map(F.lit("B"), P.type, F.lit("A"), P.brand)


_TWO_SQL = _options("'A. ' || p_brand", "'B. ' || p_type")
_CONTEXT_SQL = f"CASE WHEN p_size % 2 = 0 THEN p_name || {_NL} || p_type ELSE '' END"
_IN_BLOCK_SQL = f"CASE WHEN p_size % 2 = 0 THEN 'Context:' || {_NL} || p_name || {_NL} || p_type || {_NL} || {_NL} ELSE '' END || p_name"


def _nested(spark: SparkSession, sf_dir: str) -> DataFrame:
    context = F.when(P.size % 2 == 0, F.array("p_name", "p_type"))
    data = F.struct(P.name.alias("Question"), _two().alias("Options"), context.alias("Context"), F.when(P.size % 3 == 0, "A").otherwise("B").alias("Correct Option"))
    return _parts(spark, sf_dir, data=data)


@query(_asked(f"{_IN_BLOCK_SQL}{_TWO_SQL}", "CASE WHEN p_size % 3 = 0 THEN 'A' ELSE 'B' END"))
def dataset_nested_mcq(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _built(_nested(spark, sf_dir), "medqa")


@query(f"""SELECT p_partkey AS row_id, 'Answer the question from its context. End with a line `Final Answer: (letter)`.' || {_NL} || {_NL} || {_CONTEXT_SQL} || {_NL} || {_NL} || {_IN_BLOCK_SQL}{_TWO_SQL} AS input,
  CASE WHEN p_size % 3 = 0 THEN 'A' ELSE 'B' END AS reference FROM part""")
def dataset_context_mcq(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _built(_nested(spark, sf_dir), "pubmedqa")


@query(_asked(f"'Question: ' || p_name{_TWO_SQL}", "'B'"))
def dataset_usmle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _built(_parts(spark, sf_dir, question=P.name, options=_two(), answer_idx=F.lit("B")), "medqa_usmle")


@query(_asked(f"p_name{_options("'A. ' || p_brand", "'B. ' || p_type")}", "CASE WHEN p_size % 2 = 0 THEN 'B' ELSE '' END"))
def dataset_subset_mcq(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _parts(spark, sf_dir, centerpiece=P.name, options=F.array("p_brand", "p_type"), correct_options=F.when(P.size % 2 == 0, F.array(F.lit("B"), F.lit("A"))).otherwise(F.array().cast("array<string>")))
    return _built(rows, "mmlu_subset", subset="college-chemistry")


@query(_asked(f"p_name || CASE WHEN p_size % 2 = 0 THEN ''{_options("'A. ' || p_brand", "'B. ' || p_type")} ELSE ''{_options("'A. True'", "'B. False'")} END", "CASE WHEN p_size % 2 = 0 THEN 'True' WHEN p_size % 3 = 0 THEN 'A' ELSE 'B' END"))
def dataset_json_mcq(spark: SparkSession, sf_dir: str) -> DataFrame:
    options = F.when(P.size % 2 == 0, F.to_json(F.struct(P.type.alias("B"), P.brand.alias("A"))))
    answer = F.when((P.size % 2 == 0) | (P.size % 3 == 0), "True").otherwise("False")
    return _built(_parts(spark, sf_dir, question=P.name, options=options, answer=answer), "formulary_json_mcq")


@query(_asked(f"p_name{_options("'A. ' || p_brand")} || CASE WHEN p_size % 2 = 0 THEN {_NL} || 'C. ' || p_type ELSE '' END{_options("'E. last'")}", "'C'"))
def dataset_five_column_mcq(spark: SparkSession, sf_dir: str) -> DataFrame:
    columns = {"option_a": P.brand, "option_b": F.lit("NaN"), "option_c": F.when(P.size % 2 == 0, P.type).otherwise("None"), "option_d": F.lit(None).cast("string"), "option_e": F.lit("last")}
    return _built(_parts(spark, sf_dir, question=P.name, correct_answer=F.lit("c"), **columns), "drug_mcq")


@query(_asked(f"p_name{_options("'A. ' || p_brand", "'B. ' || p_type", "'C. x'", "'D. y'")}", "'D'"))
def dataset_list_mcq(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _built(_parts(spark, sf_dir, question=P.name, options=F.array(P.brand, P.type, F.lit("x"), F.lit("y"), F.lit("z")), answer=F.lit("D")), "formulary_list_mcq")


@query(_asked(f"p_name{_TWO_SQL}", "'A'", "sha256(p_type) AS image"))
def dataset_label_mcq(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _parts(spark, sf_dir, question=P.name, options=_two(), label=F.lit("A"), images=F.array(P.type.cast("binary")))
    return _built(rows, "medxpertqa", F.sha2(F.col("images")[0], 256).alias("image"))


@query(
    _asked(
        f"CASE WHEN p_size % 2 = 0 THEN p_name ELSE p_type END{_options("'A. ' || p_brand", "'B. ' || p_type")}",
        "CASE WHEN p_size % 3 = 0 THEN 'B' WHEN p_size % 3 = 1 THEN 'A' ELSE '' END",
        "p_brand AS country",
    )
    + " WHERE p_size % 5 <> 0"
)
def dataset_regional_mcq(spark: SparkSession, sf_dir: str) -> DataFrame:
    options = F.to_json(F.struct(P.type.alias("option2"), P.brand.alias("option1"), F.lit(" N/A").alias("option3")))
    answer = F.when(P.size % 3 == 0, "option2").when(P.size % 3 == 1, P.brand).otherwise("neither")
    columns = {"question_clean": F.when(P.size % 2 == 0, P.name), "question": P.type, "answer_options": options, "correct_answer": answer, "question_type": F.lit(" MCQ"), "split": F.when(P.size % 5 == 0, "train").otherwise("test"), "country": P.brand}
    return _built(_parts(spark, sf_dir, **columns), "afrimedqa_mcq", _meta("country"))


@query(f"SELECT p_partkey AS row_id, 'Answer the question.' || {_NL} || {_NL} || CASE WHEN p_size % 2 = 0 THEN p_brand ELSE 'No context.' END || {_NL} || {_NL} || p_name AS input, p_name AS reference FROM part WHERE p_size % 3 <> 0")
def dataset_regional_open(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind = F.when(P.size % 3 != 0, "Consumer Queries ").otherwise("mcq")
    return _built(_parts(spark, sf_dir, question=P.name, question_type=kind, context=F.when(P.size % 2 == 0, P.brand).otherwise(" ")), "afrimedqa")


@query("SELECT p_partkey AS row_id, p_name AS input, CASE WHEN p_size % 3 = 1 THEN 'harmful' ELSE 'safe' END AS reference, CAST(p_size % 3 = 1 AS VARCHAR) AS is_harmful FROM part WHERE p_size % 3 <> 0 AND p_size % 7 <> 0")
def dataset_harm(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _parts(spark, sf_dir, question=F.when(P.size % 7 == 0, " ").otherwise(P.name), rated_harmful=F.when(P.size % 3 != 0, (P.size % 3 == 1).cast("double")))
    return _built(rows, "afrimedqa_harm", _meta("is_harmful"))


@query("SELECT p_partkey AS row_id, p_name AS input, lower(p_type) AS reference, sha256(p_brand) AS image FROM part")
def dataset_visual(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _parts(spark, sf_dir, question=P.name, answer=P.type, image=F.struct(P.brand.cast("binary").alias("bytes")))
    return _built(rows, "vqa_rad", F.sha2(F.col("images")[0], 256).alias("image"))


@query(f"SELECT p_partkey AS row_id, 'Translate from English to Hindi. Give the translation only.' || {_NL} || {_NL} || p_name AS input, p_type AS reference FROM part")
def dataset_parallel_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _built(_parts(spark, sf_dir, eng_Latn=P.name, hin_Deva=P.type), "parallel_conversations", source_language="eng_Latn", target_language="hin_Deva")


@query("SELECT p_partkey AS row_id, CAST(NULL AS VARCHAR) AS input, p_name AS reference, 'hi' AS language, p_brand AS recording_context, sha256(p_type) AS sound FROM part")
def dataset_speech(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _parts(spark, sf_dir, audio=F.struct(P.type.cast("binary").alias("bytes")), text=P.name, recording_context=P.brand)
    return _built(rows, "medical_speech", _meta("language"), _meta("recording_context"), F.sha2("audio", 256).alias("sound"), language="hi")


@query(f"SELECT p_partkey AS row_id, p_name || CASE WHEN p_size % 2 = 0 THEN {_NL} || p_type ELSE '' END AS input, CAST(p_size AS VARCHAR) AS reference, 0.5 AS tolerance, p_brand AS primary_field FROM part")
def dataset_calculator(spark: SparkSession, sf_dir: str) -> DataFrame:
    columns = {"question_text": P.name, "confinement_instruction": F.when(P.size % 2 == 0, P.type), "expected_output": P.size.cast("string"), "tolerance": F.lit(0.5), "primary_field": P.brand}
    out = _built(_parts(spark, sf_dir, **columns), "medical_calculator", _meta("tolerance"), _meta("primary_field"))
    return out.withColumn("tolerance", F.col("tolerance").cast("double"))


@query(f"SELECT p_partkey AS row_id, 'Read the case, think in <think></think>, and give the diagnosis in <answer></answer>.' || {_NL} || {_NL} || p_name AS input, p_type AS reference, '[\"' || p_brand || '\",\"' || p_type || '\"]' AS reasoning_steps FROM part")
def dataset_case_reasoning(spark: SparkSession, sf_dir: str) -> DataFrame:
    told = F.concat(F.lit("1. "), P.brand, F.lit("\n2. "), P.type)
    return _built(_parts(spark, sf_dir, case_prompt=P.name, final_diagnosis=P.type, diagnostic_reasoning=told), "medcasereasoning", _meta("reasoning_steps"))


@query("SELECT p_partkey AS row_id, 'user:' || p_name || '|assistant:' || p_type AS said, '0:' || p_brand || ':1|1:' || p_type || ':' || p_size || ':axis' AS rubric FROM part")
def dataset_rubric_conversation(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = F.array(F.struct(P.name.alias("content"), F.lit("user").alias("role")), F.struct(P.type.alias("content"), F.lit("assistant").alias("role")))
    none = F.lit(None)
    rubrics = F.array(F.struct(P.brand.alias("criterion"), none.cast("double").alias("points"), none.cast("array<string>").alias("tags")), F.struct(P.type.alias("criterion"), P.size.cast("double").alias("points"), F.array(F.lit("axis")).alias("tags")))
    return _rubric_shown(D.DATASETS["health_bench"].build(_parts(spark, sf_dir, prompt=turns, rubrics=rubrics)))


def _rubric_shown(samples: DataFrame) -> DataFrame:
    said = F.array_join(F.transform("conversation", lambda t: F.concat(t["role"], F.lit(":"), t["content"])), "|")
    rubric = F.array_join(F.transform("rubric", lambda r: F.concat_ws(":", r["rubric_id"], r["criterion"], r["points"].cast("int").cast("string"), F.array_join(r["tags"], "+"))), "|")
    return samples.select("row_id", said.alias("said"), rubric.alias("rubric"))


@query("SELECT p_partkey AS row_id, 'user:' || p_name AS said, '0:' || p_brand || ':' || p_size || ':stage:retrieval_query|1:' || p_type || ':1:stage:final_answer' AS rubric FROM part")
def dataset_staged_rubric(spark: SparkSession, sf_dir: str) -> DataFrame:
    asked = F.to_json(F.array(F.struct(P.brand.alias("criterion"), P.size.alias("points"))))
    answers = F.to_json(F.array(F.struct(P.type.alias("criterion"))))
    return _rubric_shown(D.DATASETS["protocol_qna"].build(_parts(spark, sf_dir, prompt_id=P.brand, doctor_query=P.name, query_rubrics=asked, answer_rubrics=answers, difficulty_level=F.lit(1))))


@query(f"""SELECT p_partkey AS row_id, 'age: ' || CAST(2024 - (1950 + p_size) AS VARCHAR) || {_NL} || 'history_of_present_illness: ' || p_name || {_NL} || 'medications: ' || p_type || ' x' AS input, CAST(NULL AS VARCHAR) AS reference FROM part""")
def dataset_history_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    record = F.to_json(F.struct(P.name.alias("hpi"), F.concat(P.type, F.lit("  \n x")).alias("rx"), F.format_string("%d-03-01", P.size + 1950).alias("dob")))
    rubrics = F.array(F.struct(P.brand.alias("criterion"), F.lit(1.0).alias("points"), F.lit(None).cast("array<string>").alias("tags")))
    return _built(_parts(spark, sf_dir, prompt=record, rubrics=rubrics), "history_summarisation")


@query("SELECT p_partkey AS row_id, p_name AS input, CAST(NULL AS VARCHAR) AS reference, p_brand AS document_type, p_type AS rubrics, sha256(p_name) AS image FROM part")
def dataset_document_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _parts(spark, sf_dir, sample_prompt=P.name, rubrics=P.type, document_type=P.brand, image=F.struct(P.name.cast("binary").alias("bytes")))
    return _built(rows, "records_parsing", _meta("document_type"), _meta("rubrics"), F.sha2(F.col("images")[0], 256).alias("image"))


@query("SELECT p_partkey AS row_id, p_name AS input, CASE WHEN p_size % 4 = 0 THEN '{}' ELSE '{\"' || p_size || '\":1}' END AS reference FROM part")
def dataset_retrieval(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _parts(spark, sf_dir, query_id=F.col("p_partkey"), text=P.name)
    qrels = _table(spark, sf_dir, "part").where(P.size % 4 != 0).select(F.col("p_partkey").alias("query_id"), P.size.alias("doc_id"), F.lit(1).alias("rel"))
    return D.DATASETS["indic_retrieval"].build(rows, qrels=qrels).select("row_id", "input", "reference")


# Metrics that ask a judge or a retriever, through a whole evaluation


def _grader(prompt: str) -> str:
    """Meets every criterion that has an e."""
    rows = [line.partition(". ")[2] for line in prompt.split("Criteria:\n")[1].split("\n")]
    return "```json\n[" + ", ".join(f'{{"explanation": "x", "criteria_met": {"true" if "e" in r else "false"}}}' for r in rows) + "]\n```"


_POINTS = "(SELECT p_partkey AS row_id, unnest([p_brand, p_name]) AS criterion, unnest([CAST(p_size AS DOUBLE), 1.0]) AS points, unnest(['stage:retrieval_query', 'stage:final_answer']) AS tag FROM part)"


def _scored(name: str, where: str, first: bool = False) -> str:
    key = " AS key" if first else ""
    row = lambda k, v, n="": f"SELECT '{name}' AS metric, {k}{n and key}, {v}{n and ' AS value'} FROM "
    q = f"(SELECT row_id, sum(CASE WHEN criterion LIKE '%e%' THEN points ELSE 0 END) / sum(points) AS s FROM {_POINTS} WHERE {where} GROUP BY row_id)"
    g = f"(SELECT tag, CAST(criterion LIKE '%e%' AS INT) AS m FROM {_POINTS} WHERE {where}) GROUP BY tag"
    parts = [row("'overall_score'", "avg(s)", "x") + q, row("'std_dev'", "stddev_samp(s)") + q, row("'bootstrap_std'", "stddev_samp(s) / sqrt(count(*))") + q, row("'num_questions'", "CAST(count(*) AS DOUBLE)") + q, row("'num_valid_questions'", "CAST(count(*) AS DOUBLE)") + q]
    parts += [row("'tag/' || tag || '/mean'", "avg(m)") + g, row("'tag/' || tag || '/std'", "stddev_samp(m)") + g, row("'tag/' || tag || '/count'", "CAST(count(*) AS DOUBLE)") + g]
    return " UNION ALL ".join(parts)


@query(" UNION ALL ".join([_scored("answer_rubric_evaluation", "tag = 'stage:final_answer'", True), _scored("query_rubric_evaluation", "tag = 'stage:retrieval_query'"), _scored("rubric_evaluation", "true")]))
def rubric_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    asked, answers = F.to_json(F.array(F.struct(P.brand.alias("criterion"), P.size.alias("points")))), F.to_json(F.array(F.struct(P.name.alias("criterion"))))
    samples = D.DATASETS["protocol_qna"].build(_parts(spark, sf_dir, prompt_id=P.brand, doctor_query=P.name, query_rubrics=asked, answer_rubrics=answers, difficulty_level=F.lit(1)))
    found = run.evaluate(samples, Q.EchoPredictor, ("answer_rubric_evaluation", "query_rubric_evaluation", "rubric_evaluation"), judge=lambda: Q.EchoPredictor(_grader))
    return found.select("metric", "key", "value")


@query("""
WITH i AS (SELECT p_partkey, p_brand AS doc, unnest(['0', '1']) AS id, unnest([1, CAST(p_size % 2 = 0 AS INT)]) AS ok FROM part), d AS (SELECT doc, avg(ok) AS r, count(DISTINCT p_partkey) AS s, count(*) AS n FROM i GROUP BY doc)
SELECT 'rubrics/rubric_score' AS key, avg(ok) AS value FROM i UNION ALL SELECT 'overall_score', avg(ok) FROM i UNION ALL SELECT 'rubrics/by_axis/score/pass_rate', avg(ok) FROM i
UNION ALL SELECT unnest(['rubrics/num_items', 'num_items', 'rubrics/by_axis/score/count']), CAST(count(*) AS DOUBLE) FROM i UNION ALL SELECT 'num_questions', CAST(count(*) AS DOUBLE) FROM part
UNION ALL SELECT 'document_type/' || doc || '/overall_score', r FROM d UNION ALL SELECT 'document_type/' || doc || '/num_samples', CAST(s AS DOUBLE) FROM d UNION ALL SELECT 'document_type/' || doc || '/num_items', CAST(n AS DOUBLE) FROM d
""")
def json_rubric_metric(spark: SparkSession, sf_dir: str) -> DataFrame:
    samples = D.DATASETS["note_generation"].build(_parts(spark, sf_dir, sample_prompt=P.size.cast("string"), rubrics=P.type, document_type=P.brand, image=F.struct(P.name.cast("binary").alias("bytes"))))
    grade = lambda p: '{"rubric_scores": {"0": 1, "1": %d}}' % (int(p.split("Response:\n")[1]) % 2 == 0)
    return run.evaluate(samples, lambda: Q.EchoPredictor(lambda p: p), ("json_rubric_evaluation",), judge=lambda: Q.EchoPredictor(grade)).select("key", "value")


@query("""
SELECT 'medcasereasoning_diagnostic_accuracy' AS key, avg(CAST(length(p_type) % 2 = 0 AS INT)) AS value FROM part
UNION ALL SELECT 'medcasereasoning_reasoning_recall', avg((CAST(length(p_brand) % 2 = 0 AS INT) + CAST(length(p_type) % 2 = 0 AS INT)) / 2) FROM part
""")
def case_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    told = F.concat(F.lit("1. "), P.brand, F.lit("\n2. "), P.type)
    d = D.DATASETS["medcasereasoning"]
    samples = d.build(_parts(spark, sf_dir, case_prompt=P.name, final_diagnosis=P.type, diagnostic_reasoning=told))
    grade = lambda p: " Yes" if len(p.rpartition(": ")[2]) % 2 == 0 else "n"
    return run.evaluate(samples, lambda: Q.EchoPredictor(lambda p: "<answer>flu</answer>"), d.metrics, d.extract, judge=lambda: Q.EchoPredictor(grade)).select("key", "value")


@query("""
WITH per AS (SELECT p_size % 3 AS place FROM part)
SELECT m || '@' || k AS key, round_even(avg(CASE WHEN place = 2 OR k <= place THEN 0 WHEN m = 'precision' THEN 1.0 / k WHEN m = 'recall' THEN 1.0 WHEN m = 'map' THEN 1.0 / (place + 1) ELSE 1 / log2(place + 2) END), 5) AS value
FROM per, (SELECT unnest(['ndcg', 'recall', 'map', 'precision']) AS m), (SELECT unnest([1, 3, 5, 10]) AS k) GROUP BY m, k
""")
def retrieval_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The one relevant document is found first, second or not at all."""
    rows = _parts(spark, sf_dir, query_id=F.col("p_partkey"), text=(P.size % 3).cast("string"))
    qrels = _table(spark, sf_dir, "part").select(F.col("p_partkey").alias("query_id"), F.lit("good").alias("doc_id"), F.lit(1).alias("rel"))
    d = D.DATASETS["indic_retrieval"]
    found = {"0": '{"good": 0.9, "x": 0.5}', "1": '{"x": 0.9, "good": 0.5}', "2": '{"x": 0.9, "y": 0.5}'}
    return run.evaluate(d.build(rows, qrels=qrels), lambda: Q.EchoPredictor(lambda p: found[p]), d.metrics).select("key", "value")


@query("""
SELECT c_custkey, md5('{"input":"' || c_mktsegment || '",' || CASE WHEN c_custkey % 2 = 0 THEN '"images":["' || sha256(c_name) || '"]' ELSE '"audio":"' || sha256(c_name) || '"' END || ',"config":"99914b932bd37a50b983c5e7c90ae93b"}') AS cache_key FROM customer
""")
def cache_key_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Samples with one question and different pictures or recordings."""
    even, name = F.col("c_custkey") % 2 == 0, F.col("c_name").cast("binary")
    own = _table(spark, sf_dir, "customer").select("c_custkey", F.col("c_mktsegment").alias("input"), F.lit(None).cast("string").alias("system_prompt"), F.when(even, F.array(name)).alias("images"), F.when(~even, name).alias("audio"))
    return run.cache.with_key(own, run.cache.config_hash({})).select("c_custkey", "cache_key")


# Text pairs whose counts are known: every second one is heard as it was said, the others not at all or as other words


def _heard(spark: SparkSession, sf_dir: str, otherwise: Column) -> DataFrame:
    part = _table(spark, sf_dir, "part").repartition(spark.sparkContext.defaultParallelism)
    return part.select(F.col("p_partkey").alias("row_id"), F.lit("the early bird caught some worms").alias("reference"), F.when(P.size % 2 == 0, "the early bird caught some worms").otherwise(otherwise).alias("prediction"))


@query("""
WITH n AS (SELECT count(*) AS n, count(*) FILTER (p_size % 2 = 0) AS s FROM part)
SELECT 'bleu' AS key, pow(((6 * s + 1) / (6 * n + 1)) * ((5 * s + 1) / (5 * n + 1)) * ((4 * s + 1) / (4 * n + 1)) * ((3 * s + 1) / (3 * n + 1)), 0.25) AS value FROM n
UNION ALL SELECT unnest(['brevity_penalty', 'length_ratio']), 1.0
""")
def bleu_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.bleu(_heard(spark, sf_dir, F.lit("no such thing was ever heard")))


@query("SELECT unnest(['rouge1', 'rouge2', 'rougeL']) AS key, avg(CAST(p_size % 2 = 0 AS INT)) AS value FROM part")
def rouge_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.rouge(_heard(spark, sf_dir, F.lit("no such thing was ever heard")))


@query("SELECT 'semantic_wer' AS key, round_even(avg(CAST(p_size % 2 = 1 AS INT)), 3) AS value FROM part UNION ALL SELECT 'semantic_cer', 0.0 UNION ALL SELECT 'num_sentences', CAST(count(*) AS DOUBLE) FROM part UNION ALL SELECT 'total_ref_words', 6.0 * count(*) FROM part")
def asr_semantic_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words that nothing is linked to have no part in the character rate."""
    return A.asr_semantic(_heard(spark, sf_dir, F.lit("")))


@query("SELECT 'semantic_wer' AS key, avg(CAST(p_size % 2 = 1 AS INT)) AS value FROM part")
def semantic_wer_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.semantic_wer(_heard(spark, sf_dir, F.lit("")))


@query("SELECT 'keyword_wer' AS key, avg(CAST(p_size % 2 = 1 AS INT)) AS value FROM part UNION ALL SELECT 'keywords', 2.0 * count(*) FROM part")
def keyword_wer_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.keyword_wer(_heard(spark, sf_dir, F.lit("")), ["bird", "some worms"])


@query("SELECT 'entity_wer' AS key, round_even(avg(CAST(p_size % 2 = 1 AS INT)), 3) AS value FROM part UNION ALL SELECT 'keywords', CAST(count(*) AS DOUBLE) FROM part")
def entity_wer_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    mark = F.array(F.struct(F.lit("x").alias("text"), F.lit("bird").alias("category"), F.array(F.struct(F.lit(10).alias("s"), F.lit(14).alias("e"))).alias("offsets")))
    return A.entity_wer(_heard(spark, sf_dir, F.lit("")).withColumn("entities", mark))


@query("SELECT p_partkey AS row_id, unnest(range(6)) AS pos, unnest(['the', 'early', 'bird', 'caught', 'some', 'worms']) AS ref, CASE WHEN p_size % 2 = 0 THEN unnest(['the', 'early', 'bird', 'caught', 'some', 'worms']) ELSE '' END AS hyp, CASE WHEN p_size % 2 = 0 THEN 'match' ELSE 'deletion' END AS type FROM part")
def word_alignment_kinds(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = A.alignments(_heard(spark, sf_dir, F.lit(""))).select("row_id", F.posexplode("alignment").alias("pos", "a"))
    return rows.select("row_id", F.col("pos").cast("long").alias("pos"), F.array_join("a.ref_words", " ").alias("ref"), F.array_join("a.hyp_words", " ").alias("hyp"), F.col("a.type").alias("type"))


# Every stage of the answer cascade and every form that the extractors read


@query("SELECT p_partkey, 'C' AS c1, 'B' AS c2, 'D' AS c3, 'true 7' AS think, 'yes' AS tag, 'I cannot help with that.' AS refused, p_name AS plain FROM part")
def extraction_forms(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = P.size.cast("string")
    return _table(spark, sf_dir, "part").select(
        "p_partkey", X.scanned_letter(F.concat(F.lit("(C) is right, "), n))["answer"].alias("c1"), X.wrapped_letter(F.concat(n, F.lit("\nFinal Answer: **(B)**")))["answer"].alias("c2"), X.leading_letter(F.concat(F.lit("(D) because "), n))["answer"].alias("c3"),
        X.think_tag(F.concat(F.lit("a <think> true 7 </think> "), n)).alias("think"), X.answer_tag(F.concat(n, F.lit(" <Answer>yes</Answer>"))).alias("tag"),
        X.refused(F.lit(" i CANNOT help with that."), F.lit(D.REFUSAL))["answer"].alias("refused"), X.stripped(F.concat(F.lit(" \n"), P.name, F.lit("\t ")))["answer"].alias("plain"),
    )
