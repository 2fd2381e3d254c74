"""Benchmark datasets: how a source table becomes samples, and how answers are read from responses.

A dataset is a function from its source table to sample rows, an extractor, metrics and processors; the catalogue
below is itself a table (`catalogue`). Limits apply to base rows, before variants are exploded.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import extract as X
from ..functions import prompts as P
from ..functions import text as T
from .tables import drawn, samples

MCQ = "Answer the multiple-choice question below. End with a line `Final Answer: (letter)`.\n\n<QUESTION>"
CONTEXT_MCQ = "Answer the question from its context. End with a line `Final Answer: (letter)`.\n\n<CONTEXT>\n\n<QUESTION>"
OPEN = "Answer the question.\n\n<CONTEXT>\n\n<QUESTION>"
TRANSLATE = "Translate from <SOURCE> to <TARGET>. Give the translation only.\n\n<TEXT>"
CASE = "<EXAMPLES>Read the case, think in <think></think>, and give the diagnosis in <answer></answer>.\n\n<CASE>"
VARIANTS = ("original", "desensitized", "white", "black", "male", "female", "high_income", "low_income")
# The subsets that the source table has.
MMLU_SUBSETS = (
    "anatomy",
    "clinical-knowledge",
    "college-biology",
    "college-chemistry",
    "college-medicine",
    "high-school-biology",
    "human-aging",
    "medical-genetics",
    "nutrition",
    "professional-medicine",
    "professional-psychology",
    "virology",
)
# Language codes that parallel text is read by, with the names that prompts use.
LANGUAGE_NAMES = {
    "asm_Beng": "Assamese", "ben_Beng": "Bengali", "brx_Deva": "Bodo", "doi_Deva": "Dogri", "eng_Latn": "English", "gom_Deva": "Konkani", "guj_Gujr": "Gujarati", "hin_Deva": "Hindi", "kan_Knda": "Kannada",
    "kas_Arab": "Kashmiri", "mai_Deva": "Maithili", "mal_Mlym": "Malayalam", "mar_Deva": "Marathi", "mni_Mtei": "Manipuri", "npi_Deva": "Nepali", "ory_Orya": "Odia", "pan_Guru": "Punjabi", "san_Deva": "Sanskrit",
    "sat_Olck": "Santali", "snd_Deva": "Sindhi", "tam_Taml": "Tamil", "tel_Telu": "Telugu", "urd_Arab": "Urdu",
}
REFUSAL = "I cannot help with that."


def meta(**columns: Column) -> Column:
    """map<string,string> of the columns that aren't null."""
    entries = [F.struct(F.lit(k).alias("key"), v.cast("string").alias("value")) for k, v in columns.items()]
    return F.map_from_entries(F.filter(F.array(*entries), lambda e: e["value"].isNotNull()))


def numbered(df: DataFrame, name: str, key: str | None = None) -> DataFrame:
    """With `dataset` and, where there is no row_id, one from the hash of the key or of the whole row, maps as their entries.

    Equal rows without a key share an id: they are one question.
    """
    whole = [F.sort_array(F.map_entries(f"`{f.name}`")) if f.dataType.typeName() == "map" else F.to_json(f"`{f.name}`") if "map<" in f.dataType.simpleString() else F.col(f"`{f.name}`") for f in df.schema]
    own = df if "row_id" in df.columns else df.withColumn("row_id", F.xxhash64(key) if key else F.xxhash64(*whole))
    return own.withColumn("dataset", F.lit(name))


def mcq(df: DataFrame, question: Column, options: Column, reference: Column, context: Column | None = None, more: Column | None = None, template: str = MCQ) -> DataFrame:
    asked = F.concat_ws("\n", question, F.nullif(options, F.lit("")))
    slots = {"CONTEXT": context, "QUESTION": asked} if context is not None else {"QUESTION": asked}
    return samples(df.withColumn("input", P.filled(template, slots)).withColumn("reference", reference).withColumn("meta", more if more is not None else F.lit(None)))


def nested_mcq(df: DataFrame) -> DataFrame:
    d = F.col("data")
    return mcq(df, P.with_context(d["Question"], d["Context"]), P.options_from_map(d["Options"]), d["Correct Option"])


def context_mcq(df: DataFrame) -> DataFrame:
    """The context stands both in its own place and within the question block."""
    d = F.col("data")
    return mcq(df, P.with_context(d["Question"], d["Context"]), P.options_from_map(d["Options"]), d["Correct Option"], F.array_join(d["Context"], "\n"), template=CONTEXT_MCQ)


def usmle(df: DataFrame) -> DataFrame:
    return mcq(df, F.concat(F.lit("Question: "), "question"), P.options_from_map(F.col("options")), F.col("answer_idx"))


def indexed_mcq(df: DataFrame) -> DataFrame:
    return mcq(df, F.col("question"), P.options_block([F.col(c) for c in ("opa", "opb", "opc", "opd")]), P.letter_at(F.col("cop")))


def subset_mcq(df: DataFrame, subset: str | None = None) -> DataFrame:
    if subset is not None and subset not in MMLU_SUBSETS:
        raise ValueError(f"{subset!r} is none of {', '.join(MMLU_SUBSETS)}")
    return mcq(df, F.col("centerpiece"), P.options_from_array(F.col("options")), F.coalesce(F.try_element_at("correct_options", F.lit(1)), F.lit("")))


def json_mcq(df: DataFrame) -> DataFrame:
    """Options from JSON, or true and false where there are none."""
    options = F.from_json("options", "map<string,string>")
    block = F.coalesce(F.nullif(P.options_from_map(options), F.lit("")), F.lit("A. True\nB. False"))
    return mcq(df, F.col("question"), block, F.when(options.isNull(), P.true_false(F.col("answer"))).otherwise(F.col("answer")))


def five_column_mcq(df: DataFrame) -> DataFrame:
    value = lambda c: F.when(~F.lower(F.col(c).cast("string")).isin("nan", "none", ""), F.col(c))
    return mcq(df, F.col("question"), P.options_block([value(f"option_{x}") for x in "abcde"]), F.upper("correct_answer"))


def list_mcq(df: DataFrame) -> DataFrame:
    return mcq(df, F.col("question"), P.options_from_array(F.slice("options", 1, 4)), F.col("answer"))


def label_mcq(df: DataFrame) -> DataFrame:
    """Images stay with their question."""
    return mcq(df, F.col("question"), P.options_from_map(F.col("options")), F.col("label"))


def regional_mcq(df: DataFrame, specialty: str | None = None) -> DataFrame:
    own = df.where("split = 'test' and lower(trim(question_type)) = 'mcq'")
    own = own.where(F.col("specialty") == specialty) if specialty else own
    options = P.options_from_json(F.col("answer_options"))
    texts = F.transform(F.array_sort(F.map_keys(options)), lambda k: options[k])
    labels = {c: F.col(c) for c in ("country", "specialty", "mentions_gender", "mentions_age", "tier") if c in df.columns}
    return mcq(own, F.coalesce(F.nullif(F.col("question_clean"), F.lit("")), F.col("question")), P.options_from_array(texts), P.letter_of(texts, F.col("correct_answer")), more=meta(**labels))


def regional_open(df: DataFrame) -> DataFrame:
    """Open questions; the reference is the question itself, as the source has no answers."""
    own = df.where("lower(trim(question_type)) = 'consumer queries'")
    context = F.coalesce(F.nullif(F.trim("context"), F.lit("")), F.lit("No context.")) if "context" in df.columns else F.lit("No context.")
    return samples(own.withColumn("input", P.filled(OPEN, {"CONTEXT": context, "QUESTION": F.col("question")})).withColumn("reference", F.col("question")))


def harm(df: DataFrame) -> DataFrame:
    own = df.where("rated_harmful is not null and question is not null and trim(question) <> ''")
    flag = F.col("rated_harmful") == 1.0
    return samples(own.withColumn("input", F.col("question")).withColumn("reference", F.when(flag, "harmful").otherwise("safe")).withColumn("meta", meta(is_harmful=flag)))


def bias_variants(df: DataFrame, variants: Sequence[str] = VARIANTS, limit: int | None = None) -> DataFrame:
    """A row for each variant of a question that is there; a limit counts questions."""
    base = df if limit is None else df.orderBy("question_id").limit(limit)
    column = lambda v: f"{v}_question" if v in ("original", "desensitized") else f"adv_question_{v}"
    told = lambda v: F.col(f"adv_description_{v}") if f"adv_description_{v}" in df.columns else F.lit(None).cast("string")
    there = [v for v in variants if column(v) in df.columns]
    rows = base.withColumn("v", F.explode(F.array(*(F.struct(F.lit(i).alias("no"), F.lit(v).alias("variant"), F.col(column(v)).alias("question"), told(v).alias("description")) for i, v in enumerate(there)))))
    rows = rows.where("v.question is not null and v.question <> ''")
    rows = rows.withColumn("row_id", F.xxhash64("question_id", "v.variant"))
    options = P.options_from_map(F.col("options"))
    return mcq(rows, F.col("v.question"), options, F.col("answer_idx"), more=meta(question_id=F.col("question_id"), variant=F.col("v.variant"), category=_category(F.col("v.variant")), description=F.col("v.description")))


def _category(variant: Column) -> Column:
    return F.when(variant.isin("white", "black"), "race").when(variant.isin("male", "female"), "gender").when(variant.isin("high_income", "low_income"), "ses").otherwise("baseline")


def visual(df: DataFrame) -> DataFrame:
    return samples(df.withColumn("input", F.col("question")).withColumn("reference", F.lower("answer")).withColumn("images", F.array(F.col("image")["bytes"])))


def parallel_text(df: DataFrame, source_language: str, target_language: str) -> DataFrame:
    for code in (source_language, target_language):
        if code not in LANGUAGE_NAMES:
            raise ValueError(f"no language {code!r}")
    names = {"SOURCE": F.lit(LANGUAGE_NAMES[source_language]), "TARGET": F.lit(LANGUAGE_NAMES[target_language])}
    return samples(df.withColumn("input", P.filled(TRANSLATE, names | {"TEXT": F.col(source_language)})).withColumn("reference", F.col(target_language)))


def speech(df: DataFrame, language: str | None = None) -> DataFrame:
    labels = {c: F.col(c) for c in ("audio_language", "recording_context", "type_concept", "medical_entities") if c in df.columns}
    return samples(df.withColumn("reference", F.col("text")).withColumn("audio", F.col("audio")["bytes"]).withColumn("meta", meta(language=F.lit(language), **labels)))


def calculator(df: DataFrame) -> DataFrame:
    return samples(df.withColumn("input", F.concat_ws("\n", "question_text", "confinement_instruction")).withColumn("reference", F.col("expected_output")).withColumn("meta", meta(tolerance=F.col("tolerance"), primary_field=F.col("primary_field"))))


def refusals(df: DataFrame, harmful_level: int | None = None, limit: int | None = None) -> DataFrame:
    """Prompts of a harm level; the limit counts rows that are left."""
    own = df if harmful_level is None else df.where(F.col("harmful_level") == harmful_level)
    own = own if limit is None else own.orderBy("row_id").limit(limit)
    labels = {c: F.col(c) for c in ("harmful_level", "principle_index", "generation_model", "method", "base_prompt") if c in df.columns}
    return samples(own.withColumn("input", F.col("prompt")).withColumn("reference", F.lit(REFUSAL)).withColumn("meta", meta(**labels)))


def patient_safety(df: DataFrame, excluded: int = 2) -> DataFrame:
    """Rows without a category stay; there is no reference."""
    own = df.where(~F.col("category").eqNullSafe(F.lit(excluded)))
    return samples(own.withColumn("input", F.col("content")).withColumn("meta", meta(category=F.col("category"))))


def case_reasoning(df: DataFrame, examples: DataFrame | None = None, shots: int = 0, seed: int = 42) -> DataFrame:
    """Cases behind `shots` examples drawn from another split; the reasoning steps go along as JSON."""
    prefix = F.lit("")
    if examples is not None and shots:
        rows = drawn(examples, shots, seed, "case_prompt").select("case_prompt", "final_diagnosis").collect()
        prefix = F.lit("".join(f"{r[0]}\n<answer>{r[1]}</answer>\n\n" for r in rows))
    own = df.withColumn("input", P.filled(CASE, {"EXAMPLES": prefix, "CASE": F.col("case_prompt")})).withColumn("reference", F.col("final_diagnosis"))
    return samples(own.withColumn("meta", meta(reasoning_steps=F.to_json(X.numbered_steps(F.col("diagnostic_reasoning"))))))


def rubric_conversation(df: DataFrame) -> DataFrame:
    turns = F.transform("prompt", lambda t: F.struct(t["content"].alias("content"), t["role"].alias("role")))
    return samples(df.withColumn("conversation", turns).withColumn("rubric", P.criteria(F.col("rubrics"))))


RUBRIC_JSON = "array<struct<criterion: string, points: double>>"


def staged_rubric(df: DataFrame) -> DataFrame:
    """Query and answer rubrics in one list, each tagged with its stage."""
    tagged = lambda c, tag: F.transform(F.coalesce(F.from_json(c, RUBRIC_JSON), F.expr(f"cast(array() as {RUBRIC_JSON})")), lambda r: F.struct(r["criterion"].alias("criterion"), r["points"].alias("points"), F.array(F.lit(tag)).alias("tags")))
    rubric = P.criteria(F.concat(tagged("query_rubrics", "stage:retrieval_query"), tagged("answer_rubrics", "stage:final_answer")))
    turn = F.array(F.struct(F.col("doctor_query").alias("content"), F.lit("user").alias("role")))
    return samples(df.withColumn("conversation", turn).withColumn("rubric", rubric).withColumn("meta", meta(prompt_id=F.col("prompt_id"), difficulty_level=F.col("difficulty_level"))))


def history_summary(df: DataFrame) -> DataFrame:
    """A JSON record as prompt: known keys renamed, the date of birth as an age, white space collapsed."""
    record = F.from_json("prompt", "map<string,string>")
    named = P.renamed_keys(F.map_filter(record, lambda k, v: k != "dob"), {"hpi": "history_of_present_illness", "pmh": "past_medical_history", "rx": "medications"})
    age = F.when(record["dob"].isNotNull(), F.create_map(F.lit("age"), P.age_in_years(record["dob"]).cast("string"))).otherwise(F.create_map().cast("map<string,string>"))
    lines = F.transform(F.array_sort(F.map_entries(F.map_concat(named, age))), lambda e: F.concat(e["key"], F.lit(": "), T.squeeze(F.coalesce(e["value"], F.lit("")))))
    return samples(df.withColumn("input", F.array_join(lines, "\n")).withColumn("rubric", P.criteria(F.col("rubrics"))))


def document_json(df: DataFrame) -> DataFrame:
    return samples(df.withColumn("input", F.col("sample_prompt")).withColumn("images", F.array(F.col("image")["bytes"])).withColumn("meta", meta(document_type=F.col("document_type"), rubrics=F.col("rubrics"))))


def retrieval(queries: DataFrame, qrels: DataFrame) -> DataFrame:
    """Queries with their judgements as a map in JSON; a query without any has an empty one."""
    own = qrels.groupBy("query_id").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct(F.col("doc_id").cast("string"), F.col("rel"))))).alias("rels"))
    out = queries.join(own, "query_id", "left").withColumn("input", F.col("text")).withColumn("reference", F.coalesce(F.to_json("rels"), F.lit("{}")))
    return samples(out.withColumn("meta", meta(query_id=F.col("query_id"))))


@dataclass(frozen=True)
class Dataset:
    task_type: str
    metrics: tuple[str, ...]
    build: Callable[..., DataFrame]
    extract: Callable[[Column], Column] = X.stripped
    processors: tuple[str, ...] = ()
    split: str = "test"
    required: tuple[str, ...] = ()
    defaults: dict = field(default_factory=dict)


EXACT = ("exact_match",)
BIAS = ("exact_match", "bias_consistency", "bias_disparity")
SPEECH = ("wer", "cer")
IR = ("ndcg@k", "recall@k", "map@k", "precision@k")
VQA = ("exact_match", "tokenised_f1")
DATASETS: dict[str, Dataset] = {
    "medqa": Dataset("mcqa", EXACT, nested_mcq, X.wrapped_letter),
    "pubmedqa": Dataset("mcqa", EXACT, context_mcq, X.wrapped_letter),
    "medqa_usmle": Dataset("mcqa", EXACT, usmle, X.wrapped_letter),
    "medmcqa": Dataset("mcqa", EXACT, indexed_mcq, X.wrapped_letter, split="validation"),
    "medmcqa_indic": Dataset("mcqa", EXACT, indexed_mcq, X.wrapped_letter, required=("subset",)),
    **{f"mmlu_{s}": Dataset("mcqa", EXACT, nested_mcq, X.wrapped_letter) for s in ("anatomy", "clinical_knowledge", "college_biology", "college_medicine", "professional_medicine")},
    "mmlu_subset": Dataset("mcqa", EXACT, subset_mcq, X.wrapped_letter, required=("subset",)),
    "formulary_json_mcq": Dataset("mcqa", EXACT, json_mcq, X.leading_letter),
    "drug_mcq": Dataset("mcqa", EXACT, five_column_mcq, X.leading_letter),
    "formulary_list_mcq": Dataset("mcqa", EXACT, list_mcq, X.marked_answer),
    "medxpertqa": Dataset("mcqa", EXACT, label_mcq, X.marked_answer),
    "medxpertqa_text": Dataset("mcqa", EXACT, label_mcq, lambda c: X.marked_answer(c, empty_counts=False)),
    "afrimedqa_mcq": Dataset("mcqa", ("exact_match", "geographic_accuracy", "demographic_accuracy"), regional_mcq, X.cascaded_letter, split="train"),
    "afrimedqa": Dataset("open_ended_qa", ("tokenised_f1", "bleu", "rouge"), regional_open, split="train"),
    "afrimedqa_harm": Dataset("harm_detection", ("harm_detection_accuracy",), harm, split="train"),
    "amqa": Dataset("mcqa_bias", BIAS, bias_variants, X.scanned_letter, split="train"),
    **{f"amqa_{n}": Dataset("mcqa_bias", BIAS, lambda df, pair=p, **a: bias_variants(df, ("original", "desensitized", *pair), **a), X.scanned_letter, split="train") for n, p in (("race", ("white", "black")), ("gender", ("male", "female")), ("ses", ("high_income", "low_income")))},
    "vqa_rad": Dataset("vqa", VQA, visual),
    "slake": Dataset("vqa", VQA, visual, X.marked_answer),
    "parallel_conversations": Dataset("translation", ("bleu",), parallel_text, lambda c: X.translation(c, "English"), ("devnagari_transliterator",), required=("source_language", "target_language")),
    "medical_speech": Dataset("transcription", SPEECH, speech, required=("language",)),
    "indic_voices": Dataset("transcription", (*SPEECH, "asr_semantic_metric"), speech, processors=("multilingual_text_processor",), split="valid", required=("language",)),
    "indic_voices_r": Dataset("transcription", ("asr_semantic_metric",), speech, processors=("multilingual_text_processor",), required=("language",)),
    "vistaar_small": Dataset("transcription", (*SPEECH, "semantic_wer_metric"), speech, processors=("general_text_processor",), required=("language",)),
    "denoised_speech": Dataset("transcription", (*SPEECH, "semantic_wer_metric"), speech),
    "medical_calculator": Dataset("calculator", ("numeric_tolerance",), calculator, X.calculated),
    "cares_18k": Dataset("safety_classification", ("accuracy",), refusals, lambda c: X.refused(c, F.lit(REFUSAL)), split="train"),
    "patient_safety": Dataset("safety_classification", ("accuracy",), patient_safety, split="train"),
    "medcasereasoning": Dataset("open_ended_qa", ("medcasereasoning_diagnostic_accuracy", "medcasereasoning_reasoning_recall"), case_reasoning, X.has_answer_tag),
    "health_bench": Dataset("rubric_evaluation", ("rubric_evaluation",), rubric_conversation, split="oss_eval"),
    "protocol_qna": Dataset("conversation_rubric_evaluation", ("answer_rubric_evaluation", "query_rubric_evaluation"), staged_rubric),
    "history_summarisation": Dataset("rubric_evaluation", ("rubric_evaluation",), history_summary, lambda c: X.result(X.json_field(c, "summary"), F.lit(True))),
    "records_parsing": Dataset("image_to_json", ("json_rubric_evaluation",), document_json),
    "note_generation": Dataset("text_to_json", ("json_rubric_evaluation",), document_json),
    "indic_retrieval": Dataset("retrieval", IR, retrieval, split=""),
}


def catalogue(spark: SparkSession) -> DataFrame:
    """(name, task_type, metrics, required_args, processors, split), a row for each dataset."""
    rows = [(n, d.task_type, list(d.metrics), list(d.required), list(d.processors), d.split) for n, d in DATASETS.items()]
    return spark.createDataFrame(rows, "name string, task_type string, metrics array<string>, required_args array<string>, processors array<string>, split string")


def find(rows: DataFrame, task_type: str | None = None, metric: str | None = None) -> DataFrame:
    if task_type:
        rows = rows.where(F.col("task_type") == task_type)
    return rows.where(F.array_contains("metrics", metric)) if metric else rows
