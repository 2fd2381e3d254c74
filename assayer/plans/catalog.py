"""Every query of the engine's own operators with its oracle SQL.

The driver's tables hold no benchmark data, so each query derives its predictions from them in a few columns;
the oracle derives the same in SQL. Queries without an oracle run Python scorers, which tests hold against brute force.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import align
from ..functions import extract as X
from ..functions import prompts as P
from ..functions import text as T
from ..operators import cache as C
from ..operators import metrics as M
from ..operators import predict as Q
from ..operators import ranking as R
from ..operators import rubrics as U
from ..operators import transcripts as A
from ..sources import datasets as D
from ..sources import tables as S
from ..streaming import ingest as I
from . import registry, run

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None) -> Callable:
    def add(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return S.read(spark, f"{sf_dir}/{name}.parquet")


# Classification: documents' quality guessed from their length

_GUESS = "CASE WHEN n_chars > 1000 THEN 1 ELSE 0 END"
_LABELLED = f"(SELECT d.doc_id AS row_id, CAST({_GUESS} AS VARCHAR) AS prediction, CAST(quality AS VARCHAR) AS reference, lang, source, toxic, text FROM documents d JOIN labels USING (doc_id))"


def _labelled(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = _table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels")
    own = docs.select("doc_id", "n_chars", "lang", "source", "text").join(labels, "doc_id")
    return own.select(F.col("doc_id").alias("row_id"), F.expr(_GUESS).cast("string").alias("prediction"), F.col("quality").cast("string").alias("reference"), "lang", "source", "toxic", "text")


@query(f"SELECT 'exact_match' AS key, avg(CAST(lower(prediction) = lower(reference) AS INT)) AS value FROM {_LABELLED}")
def exact_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    return M.exact_match(_labelled(spark, sf_dir))


@query(f"SELECT 'accuracy' AS key, avg(CAST(trim(prediction) = trim(reference) AS INT)) AS value FROM {_LABELLED}")
def accuracy(spark: SparkSession, sf_dir: str) -> DataFrame:
    return M.accuracy(_labelled(spark, sf_dir))


@query(f"SELECT 'f1' AS key, 2.0 * count(*) FILTER (prediction = '1' AND reference = '1') / (count(*) FILTER (prediction = '1') + count(*) FILTER (reference = '1')) AS value FROM {_LABELLED}")
def f1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return M.f1(_labelled(spark, sf_dir))


@query(f"""
WITH t AS {_LABELLED}, cells AS (
  SELECT 'overall' AS field, NULL AS value, avg(CAST(prediction = reference AS INT)) AS acc, count(*) AS n FROM t
  UNION ALL SELECT 'lang', lang, avg(CAST(prediction = reference AS INT)), count(*) FROM t GROUP BY lang
  UNION ALL SELECT 'source', source, avg(CAST(prediction = reference AS INT)), count(*) FROM t GROUP BY source)
SELECT concat_ws('/', field, value, 'accuracy') AS key, round_even(acc, 4) AS value FROM cells
UNION ALL SELECT concat_ws('/', field, value, 'count'), CAST(n AS DOUBLE) FROM cells
UNION ALL SELECT field || '/disparity', round_even(max(round_even(acc, 4)) - min(round_even(acc, 4)), 4) FROM cells WHERE field <> 'overall' GROUP BY field
""")
def stratified_accuracy(spark: SparkSession, sf_dir: str) -> DataFrame:
    return M.stratified_accuracy(_labelled(spark, sf_dir), ["lang", "source"])


@query(f"""
WITH t AS (SELECT regexp_matches(lower(CASE WHEN text LIKE '%idiot%' OR text LIKE '%scum%' THEN 'this is unsafe' ELSE text END), 'harmful|unsafe|dangerous|risk') AS said, toxic = 1 AS bad FROM {_LABELLED}),
c AS (SELECT count(*) FILTER (said AND bad) AS tp, count(*) FILTER (said AND NOT bad) AS fp, count(*) FILTER (NOT said AND bad) AS fn, count(*) FILTER (NOT said AND NOT bad) AS tn FROM t),
r AS (SELECT *, coalesce(tp / nullif(tp + fp, 0), 0.0) AS p, coalesce(tp / nullif(tp + fn, 0), 0.0) AS q FROM c)
SELECT 'harm_detection_accuracy' AS key, round_even((tp + tn) / (tp + tn + fp + fn), 4) AS value FROM r
UNION ALL SELECT 'precision', round_even(p, 4) FROM r UNION ALL SELECT 'recall', round_even(q, 4) FROM r
UNION ALL SELECT 'f1', round_even(coalesce(2 * p * q / nullif(p + q, 0), 0.0), 4) FROM r
UNION ALL SELECT 'false_positive_rate', round_even(coalesce(fp / nullif(fp + tn, 0), 0.0), 4) FROM r
UNION ALL SELECT 'false_negative_rate', round_even(coalesce(fn / nullif(fn + tp, 0), 0.0), 4) FROM r
UNION ALL SELECT 'true_positives', CAST(tp AS DOUBLE) FROM r UNION ALL SELECT 'false_positives', CAST(fp AS DOUBLE) FROM r
UNION ALL SELECT 'false_negatives', CAST(fn AS DOUBLE) FROM r UNION ALL SELECT 'true_negatives', CAST(tn AS DOUBLE) FROM r
""")
def harm_detection(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = _labelled(spark, sf_dir).withColumn("prediction", F.when(F.col("text").contains("idiot") | F.col("text").contains("scum"), "this is unsafe").otherwise(F.col("text")))
    return M.harm_detection(own.withColumn("is_harmful", F.col("toxic") == 1))


# Numbers: prices against list prices


@query("""
SELECT 'numeric_tolerance' AS key, avg(CAST(abs(p - r) <= t OR (r <> 0 AND (abs(p / 100 - r) <= t OR abs(p * 100 - r) <= t)) AS INT)) AS value
FROM (SELECT l_extendedprice AS p, l_quantity * p_retailprice AS r, l_discount * 200000 AS t FROM lineitem JOIN part ON l_partkey = p_partkey)
""")
def numeric_tolerance(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = _table(spark, sf_dir, "lineitem").join(_table(spark, sf_dir, "part"), F.col("l_partkey") == F.col("p_partkey"))
    return M.numeric_tolerance(lines.select(F.col("l_extendedprice").alias("prediction"), (F.col("l_quantity") * F.col("p_retailprice")).alias("reference"), (F.col("l_discount") * 200000).alias("tolerance")))


# Variants: an order's priority is the variant, its customer the question, its status the answer

_VARIANTS = {"1-URGENT": "original", "2-HIGH": "desensitized", "3-MEDIUM": "white", "4-NOT SPECIFIED": "black"}
_VARIANT_SQL = "(SELECT o_orderkey AS row_id, o_custkey AS q, CASE o_orderpriority " + " ".join(f"WHEN '{a}' THEN '{b}'" for a, b in _VARIANTS.items()) + " ELSE 'male' END AS variant, o_orderstatus AS prediction, CASE WHEN o_totalprice > 250000 THEN 'F' ELSE 'O' END AS reference FROM orders)"


def _variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    variant = F.coalesce(F.try_element_at(F.create_map(*(F.lit(x) for p in _VARIANTS.items() for x in p)), F.col("o_orderpriority")), F.lit("male"))
    return _table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("row_id"), F.col("o_custkey").alias("question_id"), variant.alias("variant"), F.col("o_orderstatus").alias("prediction"), F.when(F.col("o_totalprice") > 250000, "F").otherwise("O").alias("reference"))


@query(f"""
WITH last AS (SELECT q, variant, arg_max(prediction, row_id) AS p FROM {_VARIANT_SQL} GROUP BY q, variant),
w AS (SELECT q, count(DISTINCT p) = 1 AS same, max(p) FILTER (variant = 'original') AS o, max(p) FILTER (variant = 'desensitized') AS d,
  max(p) FILTER (variant = 'white') AS w, max(p) FILTER (variant = 'black') AS b FROM last GROUP BY q)
SELECT 'bias_consistency' AS key, avg(CAST(same AS INT)) AS value FROM w
UNION ALL SELECT 'total_questions', CAST(count(*) AS DOUBLE) FROM w
UNION ALL SELECT 'white/black/consistency', coalesce(avg(CAST(w = b AS INT)), 0.0) FROM w WHERE w IS NOT NULL AND b IS NOT NULL
UNION ALL SELECT 'white/black/count', CAST(count(*) AS DOUBLE) FROM w WHERE w IS NOT NULL AND b IS NOT NULL
UNION ALL SELECT 'original/desensitized/consistency', coalesce(avg(CAST(o = d AS INT)), 0.0) FROM w WHERE o IS NOT NULL AND d IS NOT NULL
UNION ALL SELECT 'original/desensitized/count', CAST(count(*) AS DOUBLE) FROM w WHERE o IS NOT NULL AND d IS NOT NULL
UNION ALL SELECT unnest(['male/female/consistency', 'male/female/count', 'high_income/low_income/consistency', 'high_income/low_income/count']), 0.0
""")
def bias_consistency(spark: SparkSession, sf_dir: str) -> DataFrame:
    return M.bias_consistency(_variants(spark, sf_dir))


@query(f"""
WITH a AS (SELECT variant, round_even(avg(CAST(prediction = reference AS INT)), 4) AS acc FROM {_VARIANT_SQL} GROUP BY variant),
x AS (SELECT max(acc) FILTER (variant = 'white') AS w, max(acc) FILTER (variant = 'black') AS b, max(acc) FILTER (variant = 'original') AS o FROM a)
SELECT 'bias_disparity' AS key, round_even(max(acc) - min(acc), 4) AS value FROM a
UNION ALL SELECT 'white/black/gap', round_even(abs(w - b), 4) FROM x UNION ALL SELECT 'white/black/favours_first', CAST(sign(w - b) AS DOUBLE) FROM x
UNION ALL SELECT 'accuracy/' || variant, acc FROM a
UNION ALL SELECT 'drop/' || variant, round_even(o - acc, 4) FROM a, x WHERE variant NOT IN ('original', 'desensitized')
""")
def bias_disparity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return M.bias_disparity(_variants(spark, sf_dir))


@query("""
SELECT p_partkey AS question_id, variant, question FROM (
  SELECT p_partkey, unnest(['original', 'desensitized', 'white']) AS variant, unnest([p_name, CASE WHEN p_size % 2 = 0 THEN p_type ELSE '' END, p_brand]) AS question FROM part)
WHERE question IS NOT NULL AND question <> ''
""")
def variant_explode(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = _table(spark, sf_dir, "part").select(F.col("p_partkey").alias("question_id"), F.col("p_name").alias("original_question"), F.when(F.col("p_size") % 2 == 0, F.col("p_type")).otherwise("").alias("desensitized_question"), F.col("p_brand").alias("adv_question_white"), F.create_map(F.lit("A"), F.col("p_type")).alias("options"), F.lit("A").alias("answer_idx"))
    rows = D.bias_variants(D.numbered(part, "bias", "question_id"))
    return rows.select(F.try_element_at("meta", F.lit("question_id")).cast("bigint").alias("question_id"), F.try_element_at("meta", F.lit("variant")).alias("variant"), F.regexp_extract("input", r"(?s)\n\n([^\n]*)\n", 1).alias("question"))


# Texts

_WORDS = r"[\p{L}\p{N}_]+"


@query(rf"""
WITH p AS (SELECT d.doc_id AS row_id, text AS reference, substring(text, 1, CAST(n_chars // 2 AS INT)) AS prediction FROM documents d),
t AS (SELECT row_id, unnest(regexp_extract_all(lower(replace(replace(prediction, chr(10), ''), '.', '')), '{_WORDS}')) AS tok, 1 AS p, 0 AS r FROM p
  UNION ALL SELECT row_id, unnest(regexp_extract_all(lower(replace(replace(reference, chr(10), ''), '.', '')), '{_WORDS}')), 0, 1 FROM p),
c AS (SELECT row_id, tok, sum(p) AS p, sum(r) AS r FROM t GROUP BY 1, 2),
f AS (SELECT row_id, 2.0 * sum(least(p, r)) / (sum(p) + sum(r)) AS f FROM c GROUP BY 1)
SELECT 'tokenised_f1' AS key, avg(coalesce(f, 0.0)) AS value FROM p LEFT JOIN f USING (row_id)
""")
def tokenised_f1(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    return M.tokenised_f1(docs.select(F.col("doc_id").alias("row_id"), F.col("text").alias("reference"), F.expr("substring(text, 1, cast(n_chars div 2 as int))").alias("prediction")))


_FILLER_SQL = ", ".join(f"'{w}'" for w in T.FILLERS)


@query(f"""
WITH h AS (SELECT '[' || event_type || '] um, ' || CASE WHEN event_type IN ('click', 'view') THEN 'Okay!' ELSE event_type END || ' (' || props || ') -' AS x FROM events),
c AS (SELECT trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(x, '\\[.*?\\]', '', 'g'), '<.*?>', '', 'g'), '\\(.*?\\)', '', 'g'), '[.,\\-!?;:"''\\\\/]', '', 'g'), '\\s+', ' ', 'g')) AS x FROM h)
SELECT 'silence_accuracy' AS key, avg(CAST(len(list_filter(string_split(x, ' '), lambda w: w <> '' AND lower(w) NOT IN ({_FILLER_SQL}))) = 0 AS INT)) AS value FROM c
""")
def silence_accuracy(spark: SparkSession, sf_dir: str) -> DataFrame:
    said = F.when(F.col("event_type").isin("click", "view"), "Okay!").otherwise(F.col("event_type"))
    return M.silence_accuracy(_table(spark, sf_dir, "events").select(F.concat(F.lit("["), "event_type", F.lit("] um, "), said, F.lit(" ("), "props", F.lit(") -")).alias("prediction")))


@query("SELECT 'cer' AS key, sum(levenshtein(c_mktsegment, c_name)) / sum(length(c_mktsegment)) AS value FROM customer")
def cer(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.cer(_table(spark, sf_dir, "customer").select(F.col("c_mktsegment").alias("reference"), F.col("c_name").alias("prediction")))


def _dictated(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Part names spoken as a sentence of six words; the transcript misses the third. Dealt out, as one file is one task."""
    part = _table(spark, sf_dir, "part").repartition(spark.sparkContext.defaultParallelism)
    whole = F.concat_ws(" ", "p_name", F.lower("p_type"), "p_name", F.lower("p_brand"))
    return part.select(F.col("p_partkey").alias("row_id"), whole.alias("reference"), F.concat_ws(" ", "p_name", "p_name", F.lower("p_brand")).alias("prediction"))


@query("""
WITH w AS (SELECT len(string_split(p_name, ' ')) * 2 + 2 AS n FROM part)
SELECT 'wer' AS key, count(*) / sum(n) AS value FROM w UNION ALL SELECT 'substitutions', 0.0 UNION ALL SELECT 'deletions', CAST(count(*) AS DOUBLE) FROM w
UNION ALL SELECT 'insertions', 0.0 UNION ALL SELECT 'ref_words', CAST(sum(n) AS DOUBLE) FROM w
""")
def wer(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.wer(_dictated(spark, sf_dir))


@query("""
WITH w AS (SELECT len(string_split(p_name, ' ')) * 2 + 2 AS n, length(p_name) * 2 + length(p_type) + length(p_brand) + 3 AS c, length(p_type) + 1 AS gone FROM part)
SELECT 'wer' AS key, count(*) / sum(n) AS value FROM w UNION ALL SELECT 'cer', sum(gone) / sum(c) FROM w UNION ALL SELECT 'num_sentences', CAST(count(*) AS DOUBLE) FROM w
""")
def asr_metric(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.asr_metric(_dictated(spark, sf_dir))


@query()
def bleu(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.bleu(_dictated(spark, sf_dir))


@query()
def rouge(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.rouge(_dictated(spark, sf_dir))


@query()
def asr_semantic(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.asr_semantic(_dictated(spark, sf_dir))


@query()
def semantic_wer(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.semantic_wer(_dictated(spark, sf_dir), align.Resources({"mg": ["milligram", "mg"]}, {"widget": "gadget"}))


@query()
def entity_wer(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = _dictated(spark, sf_dir)
    first = F.length(F.substring_index("reference", " ", 1))
    mark = F.array(F.struct(F.lit("x").alias("text"), F.lit("part").alias("category"), F.array(F.struct(F.lit(0).alias("s"), first.alias("e"))).alias("offsets")))
    return A.entity_wer(own.withColumn("entities", mark))


@query()
def keyword_wer(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.keyword_wer(_dictated(spark, sf_dir), ["economy", "small", "standard", "ring", "red widget"])


@query()
def word_alignments(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = A.alignments(_dictated(spark, sf_dir)).select("row_id", F.posexplode("alignment").alias("pos", "a"))
    return rows.select("row_id", "pos", F.array_join("a.ref_words", " ").alias("ref"), F.array_join("a.hyp_words", " ").alias("hyp"), F.col("a.type").alias("type"), "a.cer")


@query(r"""
SELECT event_id, trim(regexp_replace(regexp_replace(regexp_replace(lower(event_type || ' It''s ' || CAST(event_id AS VARCHAR) || 'mg/dl, 3-4!'), '(\w+)''s\b', '\1 is', 'g'), '(\d)-(\d)', '\1 - \2', 'g'), '(\d)(mg)', '\1 \2', 'g')) AS spoken,
  trim(regexp_replace(regexp_replace(event_type || ' It''s ' || CAST(event_id AS VARCHAR) || 'mg/dl, 3-4!', '[!"#$&''()*+,.:;<=>?@\[\\\]^_`{|}~]', ' ', 'g'), '\s+', ' ', 'g')) AS bare FROM events
""")
def normalised_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = F.concat(F.col("event_type"), F.lit(" It's "), F.col("event_id").cast("string"), F.lit("mg/dl, 3-4!"))
    return _table(spark, sf_dir, "events").select("event_id", T.spaced_units(T.spaced_ranges(T.expanded_contractions(F.lower(raw))), ["mg"]).alias("spoken"), T.without_punctuation(raw).alias("bare"))


@query(r"""
SELECT conv_id, turn, trim(regexp_replace(lower(regexp_replace(text, '[^\p{L}\p{N}\p{M}_\s]', '', 'g')), '\s+', ' ', 'g')) AS general FROM conversations
""")
def general_processor(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _table(spark, sf_dir, "conversations").select("conv_id", "turn", T.general_text(F.col("text")).alias("general"))


@query("SELECT c_custkey, replace(replace(lower(c_mktsegment), 'building', 'construction'), 'household', 'home') AS mapped, coalesce(nullif(c_mktsegment = 'BUILDING', false), false) AS found FROM customer")
def word_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    word = F.lower("c_mktsegment")
    units = T.matching_units(word, {"building": ["construction"]})
    return _table(spark, sf_dir, "customer").select("c_custkey", T.apply_rules(T.mapped_words(word, {"building": "construction"}), T.read_rules(["# rules", "household home"])).alias("mapped"), (F.size(units) > 0).alias("found"))


# Answer extraction: responses are built around a letter that is known

_LETTER = "substr('ABCD', CAST(p_size % 4 AS INT) + 1, 1)"


@query(f"""
SELECT p_partkey, {_LETTER} AS wrapped, CASE WHEN p_size % 5 = 4 THEN '' ELSE {_LETTER} || ' because' END AS marked, p_size % 5 <> 4 AS marked_ok,
  {_LETTER} AS leading, {_LETTER} AS cascaded, {_LETTER} AS scanned, p_size AS number, p_name AS translated, lower(p_type) AS tagged FROM part
""")
def extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = _table(spark, sf_dir, "part")
    letter = F.expr(_LETTER)
    wrapped = F.concat(F.lit("I think so.\nFinal Answer: **Final Answer: ("), letter, F.lit(")**\n"))
    marked = F.when(F.col("p_size") % 5 == 4, F.lit("no marker")).otherwise(F.concat(F.lit("x Final Answer:  "), letter, F.lit(" because Final Answer: Z")))
    m = X.marked_answer(marked)
    number = F.concat(F.lit('First {"a": 1} then {"value": '), F.col("p_size").cast("string"), F.lit("} done"))
    return part.select(
        "p_partkey", X.wrapped_letter(wrapped)["answer"].alias("wrapped"), m["answer"].alias("marked"), m["success"].alias("marked_ok"),
        X.leading_letter(F.concat(F.lit(" **("), letter, F.lit(") is it")))["answer"].alias("leading"),
        X.cascaded_letter(F.concat(F.lit("the answer is ("), F.lower(letter), F.lit(")")))["answer"].alias("cascaded"),
        X.scanned_letter(F.concat(F.lit("x ("), letter, F.lit(") y")))["answer"].alias("scanned"),
        X.calculated_field(X.calculated(number)["answer"], "value").cast("int").alias("number"),
        X.translation(F.concat(F.lit("In English:  "), "p_name"), "English")["answer"].alias("translated"),
        X.answer_tag(F.concat(F.lit("<think>a</think><answer> "), F.lower("p_type"), F.lit(" </answer>"))).alias("tagged"),
    )


@query("SELECT p_partkey, unnest(generate_series(0, 2)) AS step_no, unnest([p_name, p_type, p_brand]) AS step FROM part")
def reasoning_steps(spark: SparkSession, sf_dir: str) -> DataFrame:
    told = F.concat(F.lit("1. "), "p_name", F.lit("\n2. "), "p_type", F.lit(" 3. "), "p_brand")
    rows = _table(spark, sf_dir, "part").select("p_partkey", X.numbered_steps(told).alias("steps"))
    out = Q.fanned_out(rows, "steps")
    return out.select("p_partkey", F.col("step_no").cast("bigint").alias("step_no"), "step")


# Prompts


@query("""
SELECT p_partkey, 'A. ' || p_name || chr(10) || 'B. ' || p_type || CASE WHEN p_size % 2 = 0 THEN chr(10) || 'D. ' || p_brand ELSE '' END AS block, substr('ABCD', CAST(p_size % 4 AS INT) + 1, 1) AS letter,
  'Q: ' || p_name || ' in ' || p_brand AS filled, CASE WHEN p_size % 3 = 0 THEN 'B' ELSE '' END AS answer,
  2024 - (1950 + p_size) - CASE WHEN p_size % 12 + 1 > 7 OR (p_size % 12 + 1 = 7 AND 25 > 20) THEN 1 ELSE 0 END AS age FROM part
""")
def prompts(spark: SparkSession, sf_dir: str) -> DataFrame:
    size = F.col("p_size")
    options = [F.col("p_name"), F.col("p_type"), F.lit(None).cast("string"), F.when(size % 2 == 0, F.col("p_brand"))]
    born = F.format_string("%d-%02d-25", F.lit(1950) + size, size % 12 + 1)
    texts = F.array(F.lit("x"), F.lit("y"))
    return _table(spark, sf_dir, "part").select(
        "p_partkey", P.options_block(options).alias("block"), P.letter_at((size % 4).cast("int")).alias("letter"), P.filled("Q: <NAME> in <BRAND>", {"NAME": F.col("p_name"), "BRAND": F.col("p_brand")}).alias("filled"),
        P.letter_of(texts, F.when(size % 3 == 0, F.when(size % 2 == 0, "y").otherwise("option2")).otherwise("z")).alias("answer"), P.age_in_years(born).alias("age"),
    )


@query("""
SELECT conv_id, count(*) AS n_turns, string_agg(role || ':' || length(text), '|' ORDER BY turn) AS shape FROM conversations GROUP BY conv_id
""")
def conversations(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.collect_list(F.struct("turn", "role", "text")).alias("turns"))
    told = P.conversation(F.col("turns"))
    return rows.select("conv_id", F.size(told).cast("bigint").alias("n_turns"), F.array_join(F.transform(told, lambda t: F.concat(t["role"], F.lit(":"), F.length(t["content"]).cast("string"))), "|").alias("shape"))


@query()
def few_shot(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = _table(spark, sf_dir, "part").select(F.col("p_partkey").alias("row_id"), F.col("p_name").alias("case_prompt"), F.col("p_type").alias("final_diagnosis"), F.lit("1. look 2. think").alias("diagnostic_reasoning"))
    return D.case_reasoning(D.numbered(part, "cases"), part, shots=2).select("row_id", "input", "reference", F.to_json("meta").alias("meta"))


# Filters


@query("SELECT event_id, event_type FROM events WHERE (CASE WHEN user_id % 3 = 0 THEN NULL ELSE user_id % 3 END) IS DISTINCT FROM 2")
def null_safe_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = _table(spark, sf_dir, "events").withColumn("category", F.nullif(F.col("user_id") % 3, F.lit(0))).withColumn("content", F.col("event_type"))
    return D.patient_safety(D.numbered(own.withColumnRenamed("event_id", "row_id"), "safety")).select(F.col("row_id").alias("event_id"), F.col("input").alias("event_type"))


@query("SELECT c_custkey, c_name FROM customer WHERE c_nationkey = 3 ORDER BY c_custkey LIMIT 20")
def limit_after_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = _table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("row_id"), F.col("c_name").alias("prompt"), F.col("c_nationkey").alias("harmful_level"))
    return D.refusals(D.numbered(own, "cares"), 3, 20).select(F.col("row_id").alias("c_custkey"), F.col("input").alias("c_name"))


@query("SELECT event_id, CAST(json_extract_string(props, '$.k') AS INT) AS k FROM events")
def json_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _table(spark, sf_dir, "events").select("event_id", X.json_field(F.concat(F.lit("```json\n"), "props", F.lit("\n```")), "k").cast("int").alias("k"))


# Cache: every document is a sample, two thirds are cached


def _cached(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    docs = _table(spark, sf_dir, "documents").select(F.col("doc_id").alias("row_id"), F.md5("text").alias("cache_key"), F.length("text").cast("string").alias("output"))
    stamp = F.timestamp_seconds(F.col("row_id"))
    known = docs.where("row_id % 3 <> 0").select("cache_key", F.col("output").alias("model_output"), F.lit(True).alias("success"), stamp.alias("created_at"), stamp.alias("updated_at"))
    return docs, known


_CACHE_SQL = "docs AS (SELECT doc_id, md5(text) AS cache_key, CAST(length(text) AS VARCHAR) AS output FROM documents), known AS (SELECT DISTINCT cache_key FROM docs WHERE doc_id % 3 <> 0)"


@query(f"WITH {_CACHE_SQL} SELECT doc_id AS row_id, docs.cache_key, CASE WHEN known.cache_key IS NOT NULL THEN output END AS model_output, known.cache_key IS NOT NULL AS from_cache FROM docs LEFT JOIN known USING (cache_key)")
def cache_probe(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, known = _cached(spark, sf_dir)
    return C.probe(docs, known).select("row_id", "cache_key", "model_output", "from_cache")


@query(f"WITH {_CACHE_SQL} SELECT doc_id AS row_id FROM docs WHERE cache_key NOT IN (SELECT cache_key FROM known)")
def cache_misses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.misses(*_cached(spark, sf_dir)).select("row_id")


@query(f"""
WITH {_CACHE_SQL}, h AS (SELECT CAST(known.cache_key IS NOT NULL AS INT) AS hit FROM docs LEFT JOIN known USING (cache_key))
SELECT 'hits' AS key, CAST(sum(hit) AS DOUBLE) AS value FROM h UNION ALL SELECT 'misses', CAST(sum(1 - hit) AS DOUBLE) FROM h UNION ALL SELECT 'hit_rate', 100.0 * avg(hit) FROM h
""")
def cache_hit_rate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return M.cache_hits(C.probe(*_cached(spark, sf_dir)))


@query(f"""
WITH {_CACHE_SQL}, old AS (SELECT cache_key, max(doc_id) AS at FROM docs WHERE doc_id % 3 <> 0 GROUP BY 1), fresh AS (SELECT cache_key, max(doc_id) AS at FROM docs WHERE doc_id % 2 = 0 GROUP BY 1)
SELECT coalesce(old.cache_key, fresh.cache_key) AS cache_key, CASE WHEN fresh.cache_key IS NOT NULL THEN 'new' ELSE 'old' END AS model_output FROM old FULL JOIN fresh USING (cache_key)
""")
def cache_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, known = _cached(spark, sf_dir)
    fresh = docs.where("row_id % 2 = 0").select("cache_key", F.lit("new").alias("model_output"), F.lit(True).alias("success"), F.timestamp_seconds(F.col("row_id") + 1_000_000_000).alias("updated_at"))
    return C.upserted(known.withColumn("model_output", F.lit("old")), fresh).select("cache_key", "model_output")


@query("SELECT DISTINCT source AS config_hash, CASE WHEN length(source) = 4 THEN 'old' ELSE 'new' END AS model_id FROM documents")
def run_insert_missing(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = _table(spark, sf_dir, "documents").select(F.col("source").alias("config_hash")).distinct()
    return C.inserted(names.where("length(config_hash) = 4").withColumn("model_id", F.lit("old")), names.withColumn("model_id", F.lit("new")), "config_hash")


# Retrieval over embeddings: a vector is relevant to a query of its own label

_SEARCH = "queries AS (SELECT vec_id AS query_id, embedding AS q, label FROM embeddings WHERE vec_id % 20 = 0)"


def _found(spark: SparkSession, sf_dir: str, k: int = 10) -> tuple[DataFrame, DataFrame]:
    vectors = _table(spark, sf_dir, "embeddings")
    asked = vectors.where("vec_id % 20 = 0").select(F.col("vec_id").alias("query_id"), "embedding", "label")
    found = R.top_k(vectors.select(F.col("vec_id").alias("doc_id"), "embedding"), asked, k)
    qrels = asked.select("query_id", "label").join(vectors.select(F.col("vec_id").alias("doc_id"), "label"), "label").select("query_id", "doc_id", F.lit(1).alias("rel"))
    return found, qrels


@query(f"""
WITH {_SEARCH}, s AS (SELECT query_id, vec_id AS doc_id, list_cosine_similarity(CAST(q AS DOUBLE[]), CAST(embedding AS DOUBLE[])) AS score FROM queries, embeddings)
SELECT query_id, doc_id, round(score, 5) AS score, rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM s) WHERE rank <= 10
""")
def nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    found, _ = _found(spark, sf_dir)
    return found.select("query_id", "doc_id", F.round("score", 5).alias("score"), F.col("rank").cast("bigint").alias("rank"))


_MEASURES = "".join(
    f" UNION ALL SELECT 'ndcg@{k}', round_even(avg(g{k} / i{k}), 5) FROM per UNION ALL SELECT 'recall@{k}', round_even(avg(f{k} / n), 5) FROM per UNION ALL SELECT 'map@{k}', round_even(avg(a{k} / n), 5) FROM per UNION ALL SELECT 'precision@{k}', round_even(avg(f{k} / {k}), 5) FROM per"
    for k in R.CUTS
)
_SUMS = ", ".join(f"sum(CASE WHEN rank <= {k} THEN rel / log2(rank + 1) ELSE 0 END) AS g{k}, CAST(count(*) FILTER (rank <= {k} AND rel > 0) AS DOUBLE) AS f{k}, sum(CASE WHEN rank <= {k} AND rel > 0 THEN hits / rank ELSE 0 END) AS a{k}, (SELECT sum(1 / log2(x + 1)) FROM range(1, {k} + 1) t(x) WHERE x <= any_value(n)) AS i{k}" for k in R.CUTS)


@query(f"""
WITH {_SEARCH}, s AS (SELECT query_id, vec_id AS doc_id, CAST(queries.label = embeddings.label AS INT) AS rel, list_cosine_similarity(CAST(q AS DOUBLE[]), CAST(embedding AS DOUBLE[])) AS score FROM queries, embeddings),
top AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id DESC) AS rank, sum(rel) OVER (PARTITION BY query_id) AS n FROM s) WHERE rank <= 10),
ranked AS (SELECT *, sum(rel) OVER (PARTITION BY query_id ORDER BY rank) AS hits FROM top),
per AS (SELECT query_id, any_value(n) AS n, {_SUMS} FROM ranked GROUP BY query_id)
{_MEASURES.removeprefix(" UNION ALL ").replace("SELECT 'ndcg@1', round_even(avg(g1 / i1), 5)", "SELECT 'ndcg@1' AS key, round_even(avg(g1 / i1), 5) AS value", 1)}
""")
def rank_measures(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.rank_measures(*_found(spark, sf_dir))


# Rubrics: a conversation's turns are its criteria, graded by their length

_GRADED = "(SELECT conv_id AS row_id, turn, CASE WHEN length(text) % 7 = 0 THEN NULL ELSE length(text) % 2 = 0 END AS met, CASE WHEN turn % 4 = 3 THEN -2.0 ELSE turn + 1.0 END AS points, role AS tag FROM conversations)"


def _graded(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.length("text")
    met = F.when(n % 7 != 0, n % 2 == 0)
    points = F.when(F.col("turn") % 4 == 3, -2.0).otherwise(F.col("turn") + 1.0)
    return _table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("row_id"), F.col("turn").alias("rubric_idx"), met.alias("criteria_met"), points.alias("points"), F.array("role").alias("tags"))


@query(f"""
WITH q AS (SELECT row_id, sum(CASE WHEN met THEN points ELSE 0 END) / nullif(sum(CASE WHEN points > 0 THEN points ELSE 0 END), 0) AS score FROM {_GRADED} GROUP BY row_id),
o AS (SELECT avg(score) AS m, coalesce(stddev_samp(score), 0) AS s, count(*) AS n, count(score) AS v FROM q),
t AS (SELECT tag, avg(CAST(met AS INT)) AS m, coalesce(stddev_samp(CAST(met AS INT)), 0) AS s, count(*) AS n FROM {_GRADED} g WHERE met IS NOT NULL AND row_id IN (SELECT row_id FROM q WHERE score IS NOT NULL) GROUP BY tag)
SELECT 'overall_score' AS key, m AS value FROM o UNION ALL SELECT 'std_dev', s FROM o UNION ALL SELECT 'bootstrap_std', s / sqrt(v) FROM o UNION ALL SELECT 'num_questions', CAST(n AS DOUBLE) FROM o UNION ALL SELECT 'num_valid_questions', CAST(v AS DOUBLE) FROM o
UNION ALL SELECT 'tag/' || tag || '/mean', m FROM t UNION ALL SELECT 'tag/' || tag || '/std', s FROM t UNION ALL SELECT 'tag/' || tag || '/count', CAST(n AS DOUBLE) FROM t
""")
def rubric_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return U.rubric_score(_graded(spark, sf_dir))


@query("SELECT conv_id AS row_id, count(*) FILTER (turn % 2 = 1) AS n_answer, CAST(sum(CASE WHEN turn % 2 = 0 THEN turn + 1.0 ELSE 0 END) AS DOUBLE) AS query_points FROM conversations GROUP BY conv_id")
def rubric_by_stage(spark: SparkSession, sf_dir: str) -> DataFrame:
    tag = F.when(F.col("turn") % 2 == 1, U.ANSWER_TAG).otherwise(U.QUERY_TAG)
    item = F.struct(F.col("text").alias("criterion"), (F.col("turn") + 1.0).alias("points"), F.array(tag).alias("tags"))
    own = _table(spark, sf_dir, "conversations").groupBy(F.col("conv_id").alias("row_id")).agg(F.collect_list(item).alias("rubric"))
    own = own.withColumn("rubric", P.criteria(F.col("rubric")))
    answers = U.criteria_rows(own, tag=U.ANSWER_TAG).groupBy("row_id").agg(F.count("*").alias("n_answer"))
    asked = U.criteria_rows(own, tag=U.QUERY_TAG).groupBy("row_id").agg(F.sum("points").alias("query_points"))
    out = own.select("row_id").join(answers, "row_id", "left").join(asked, "row_id", "left")
    return out.select("row_id", F.coalesce("n_answer", F.lit(0)).cast("bigint").alias("n_answer"), F.coalesce("query_points", F.lit(0.0)).alias("query_points"))


@query("""
WITH i AS (SELECT event_id, event_type AS kind, user_id % 3 <> 0 AND value > 5 AS ok, CASE WHEN event_id % 2 = 0 THEN 'a' ELSE 'b' END AS doc FROM events),
k AS (SELECT kind, avg(CAST(ok AS INT)) AS r, count(*) AS n FROM i GROUP BY kind), d AS (SELECT doc, avg(CAST(ok AS INT)) AS r, count(*) AS n FROM i GROUP BY doc)
SELECT 'main/rubric_score' AS key, avg(CAST(ok AS INT)) AS value FROM i UNION ALL SELECT 'overall_score', avg(CAST(ok AS INT)) FROM i
UNION ALL SELECT unnest(['main/num_items', 'num_items', 'num_questions']), CAST(count(*) AS DOUBLE) FROM i
UNION ALL SELECT 'main/by_axis/seen/pass_rate', avg(CAST(user_id % 3 <> 0 AS INT)) FROM events UNION ALL SELECT 'main/by_axis/big/pass_rate', avg(CAST(value > 5 AS INT)) FROM events
UNION ALL SELECT unnest(['main/by_axis/seen/count', 'main/by_axis/big/count']), CAST(count(*) AS DOUBLE) FROM i
UNION ALL SELECT 'main/by_kind/' || kind || '/pass_rate', r FROM k UNION ALL SELECT 'main/by_kind/' || kind || '/count', CAST(n AS DOUBLE) FROM k
UNION ALL SELECT 'document_type/' || doc || '/overall_score', r FROM d UNION ALL SELECT unnest(['document_type/' || doc || '/num_samples', 'document_type/' || doc || '/num_items']), CAST(n AS DOUBLE) FROM d
""")
def json_rubric(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = _table(spark, sf_dir, "events")
    item = F.struct(F.col("event_id").cast("string").alias("item"), F.col("event_type").alias("kind"), (F.col("user_id") % 3).alias("seen"), F.when(F.col("value") > 5, "yes").otherwise("no").alias("big"))
    told = events.select(F.col("event_id").alias("row_id"), F.concat(F.lit('```json\n{"items": ['), F.to_json(item), F.lit("]}\n```")).alias("judge_response"), F.when(F.col("event_id") % 2 == 0, "a").otherwise("b").alias("document_type"))
    spec = U.Pass("main", {"*": (U.Axis("seen", ("neq", 0)), U.Axis("big", ("in", ("yes", "maybe"))))}, id_field="item", array_key="items", breakdown=("kind",))
    return U.json_rubric_score(U.judged_items(told, spec), told)


@query("""
WITH s AS (SELECT conv_id, turn, CASE WHEN length(text) % 3 = 0 THEN 0 ELSE 1 END AS yes FROM conversations)
SELECT 'medcasereasoning_diagnostic_accuracy' AS key, avg(yes) AS value FROM s
UNION ALL SELECT 'medcasereasoning_reasoning_recall', avg(r) FROM (SELECT avg(yes) AS r FROM s GROUP BY conv_id)
""")
def judge_verdicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("row_id"), F.col("text").alias("input"))
    graded = Q.predict(rows, lambda: Q.EchoPredictor(lambda p: "no" if len(p) % 3 == 0 else " Yes, it does"), output="verdict")
    return M.diagnostic_accuracy(graded).union(M.reasoning_recall(graded))


# Runs, catalogues and windows


@query("""
WITH p AS (SELECT p_partkey, 'Answer the multiple-choice question below. End with a line `Final Answer: (letter)`.' || chr(10) || chr(10) || p_name || chr(10) || 'A. ' || p_type || chr(10) || 'B. ' || p_brand AS prompt, substr('ABCD', CAST(p_size % 4 AS INT) + 1, 1) AS reference FROM part)
SELECT 'parts' AS dataset, 'mcqa' AS task_type, 'exact_match' AS metric, 'exact_match' AS key, avg(CAST(substr('ABCD', CAST(length(prompt) % 4 AS INT) + 1, 1) = reference AS INT)) AS value, count(*) AS num_samples FROM p
""")
def evaluation(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = _table(spark, sf_dir, "part").select(F.col("p_partkey").alias("row_id"), F.col("p_name").alias("question"), F.col("p_type").alias("opa"), F.col("p_brand").alias("opb"), F.lit(None).cast("string").alias("opc"), F.lit(None).cast("string").alias("opd"), (F.col("p_size") % 4).cast("int").alias("cop"))
    d = D.DATASETS["medmcqa"]
    return run.evaluate(d.build(D.numbered(part, "parts")), Q.EchoPredictor, d.metrics, d.extract, dataset="parts", task_type=d.task_type)


# What the catalogue of datasets is expected to hold.
_CATALOGUE = (
    ("medqa", "mcqa", "exact_match", "", "", "test"),
    ("pubmedqa", "mcqa", "exact_match", "", "", "test"),
    ("medqa_usmle", "mcqa", "exact_match", "", "", "test"),
    ("medmcqa", "mcqa", "exact_match", "", "", "validation"),
    ("medmcqa_indic", "mcqa", "exact_match", "subset", "", "test"),
    ("mmlu_anatomy", "mcqa", "exact_match", "", "", "test"),
    ("mmlu_clinical_knowledge", "mcqa", "exact_match", "", "", "test"),
    ("mmlu_college_biology", "mcqa", "exact_match", "", "", "test"),
    ("mmlu_college_medicine", "mcqa", "exact_match", "", "", "test"),
    ("mmlu_professional_medicine", "mcqa", "exact_match", "", "", "test"),
    ("mmlu_subset", "mcqa", "exact_match", "subset", "", "test"),
    ("formulary_json_mcq", "mcqa", "exact_match", "", "", "test"),
    ("drug_mcq", "mcqa", "exact_match", "", "", "test"),
    ("formulary_list_mcq", "mcqa", "exact_match", "", "", "test"),
    ("medxpertqa", "mcqa", "exact_match", "", "", "test"),
    ("medxpertqa_text", "mcqa", "exact_match", "", "", "test"),
    ("afrimedqa_mcq", "mcqa", "exact_match,geographic_accuracy,demographic_accuracy", "", "", "train"),
    ("afrimedqa", "open_ended_qa", "tokenised_f1,bleu,rouge", "", "", "train"),
    ("afrimedqa_harm", "harm_detection", "harm_detection_accuracy", "", "", "train"),
    ("amqa", "mcqa_bias", "exact_match,bias_consistency,bias_disparity", "", "", "train"),
    ("amqa_race", "mcqa_bias", "exact_match,bias_consistency,bias_disparity", "", "", "train"),
    ("amqa_gender", "mcqa_bias", "exact_match,bias_consistency,bias_disparity", "", "", "train"),
    ("amqa_ses", "mcqa_bias", "exact_match,bias_consistency,bias_disparity", "", "", "train"),
    ("vqa_rad", "vqa", "exact_match,tokenised_f1", "", "", "test"),
    ("slake", "vqa", "exact_match,tokenised_f1", "", "", "test"),
    ("parallel_conversations", "translation", "bleu", "source_language,target_language", "devnagari_transliterator", "test"),
    ("medical_speech", "transcription", "wer,cer", "language", "", "test"),
    ("indic_voices", "transcription", "wer,cer,asr_semantic_metric", "language", "multilingual_text_processor", "valid"),
    ("indic_voices_r", "transcription", "asr_semantic_metric", "language", "multilingual_text_processor", "test"),
    ("vistaar_small", "transcription", "wer,cer,semantic_wer_metric", "language", "general_text_processor", "test"),
    ("denoised_speech", "transcription", "wer,cer,semantic_wer_metric", "", "", "test"),
    ("medical_calculator", "calculator", "numeric_tolerance", "", "", "test"),
    ("cares_18k", "safety_classification", "accuracy", "", "", "train"),
    ("patient_safety", "safety_classification", "accuracy", "", "", "train"),
    ("medcasereasoning", "open_ended_qa", "medcasereasoning_diagnostic_accuracy,medcasereasoning_reasoning_recall", "", "", "test"),
    ("health_bench", "rubric_evaluation", "rubric_evaluation", "", "", "oss_eval"),
    ("protocol_qna", "conversation_rubric_evaluation", "answer_rubric_evaluation,query_rubric_evaluation", "", "", "test"),
    ("history_summarisation", "rubric_evaluation", "rubric_evaluation", "", "", "test"),
    ("records_parsing", "image_to_json", "json_rubric_evaluation", "", "", "test"),
    ("note_generation", "text_to_json", "json_rubric_evaluation", "", "", "test"),
    ("indic_retrieval", "retrieval", "ndcg@k,recall@k,map@k,precision@k", "", "", ""),
)
_CATALOGUE_SQL = "(VALUES " + ", ".join(str(row) for row in _CATALOGUE) + ") AS c(name, task_type, metrics, required_args, processors, split)"


@query(f"SELECT * FROM {_CATALOGUE_SQL}")
def dataset_catalogue(spark: SparkSession, sf_dir: str) -> DataFrame:
    return D.catalogue(spark).select("name", "task_type", F.array_join("metrics", ",").alias("metrics"), F.array_join("required_args", ",").alias("required_args"), F.array_join("processors", ",").alias("processors"), "split")


@query(f"""
SELECT CASE WHEN task_type IN ('image_to_json', 'vqa') THEN 'vision' WHEN task_type = 'transcription' THEN 'ears' WHEN task_type = 'retrieval' THEN 'vectors' ELSE 'text' END AS model, name AS dataset FROM {_CATALOGUE_SQL}
UNION ALL SELECT 'vision', name FROM {_CATALOGUE_SQL} WHERE task_type NOT IN ('image_to_json', 'vqa', 'transcription', 'retrieval')
""")
def compatible_datasets(spark: SparkSession, sf_dir: str) -> DataFrame:
    known = [registry.Model("text", "text_generation"), registry.Model("vision", "text_generation", ("text", "image")), registry.Model("ears", "audio_recognition", ("audio",)), registry.Model("vectors", "embedding")]
    return registry.compatible(registry.model_rows(spark, known), D.catalogue(spark))


@query("SELECT strftime(ts, '%Y-%m-%d') AS start, event_type, count(*) AS n, sum(value) AS total FROM events GROUP BY 1, 2")
def event_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return I.windowed_counts(_table(spark, sf_dir, "events")).withColumn("start", F.date_format("start", "yyyy-MM-dd"))

from . import families, forms  # noqa: E402, F401  their queries register themselves
