"""Queries for sources, normalisers, prompt parts, pair scores and pooling in the forms that the other queries leave out.

Texts are built around columns of `part`, so that the oracle can spell out what must become of them.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import align, numbers
from ..functions import prompts as P
from ..functions import text as T
from ..operators import cache as C
from ..operators import ranking as R
from ..operators import transcripts as A
from ..sources import tables as S
from . import registry
from .catalog import _LABELLED, _labelled, _table, query


def _said(*parts: Column | str) -> Column:
    """Columns and literal texts on end."""
    return F.concat(*(F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts))


def _words_sql(words: tuple[str, ...]) -> str:
    return "[" + ", ".join(f"'{w}'" for w in words) + "]"


# Sources


@query("SELECT unnest(['csv', 'json', 'orc', 'parquet']) AS format, n_nationkey, n_name, n_regionkey FROM nation WHERE n_regionkey = 1")
def source_formats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every file format, a version as a folder and a split as a partition filter."""
    folder = f"{S.shared_folder(spark)}/formats-{uuid.uuid4().hex}"
    nation = _table(spark, sf_dir, "nation").withColumn("split", F.col("n_regionkey").cast("string"))
    out = None
    for kind in ("csv", "json", "orc", "parquet"):
        nation.write.format(kind).options(**({"header": True} if kind == "csv" else {})).partitionBy("split").save(f"{folder}/{kind}/v2")
        schema = "n_nationkey int, n_name string, n_regionkey int, split string"
        rows = S.read(spark, f"{folder}/{kind}", format=kind, schema=schema, split="1", version="v2")
        rows = rows.select(F.lit(kind).alias("format"), "n_nationkey", "n_name", "n_regionkey")
        out = rows if out is None else out.union(rows)
    return out


@query("SELECT c_mktsegment, count(*) AS n FROM customer WHERE c_custkey >= 10 GROUP BY c_mktsegment")
def parameterised_sql(spark: SparkSession, sf_dir: str) -> DataFrame:
    _table(spark, sf_dir, "customer").createOrReplaceTempView("asked_customers")
    return S.query(spark, "SELECT c_mktsegment, count(*) AS n FROM asked_customers WHERE c_custkey >= :least GROUP BY c_mktsegment", least=10)


@query("SELECT r_regionkey, 'sha:' || sha256(r_name || chr(10)) AS content FROM region")
def binary_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files stay undecoded: each region's name is written as a line of a file and read as bytes."""
    folder = f"{S.shared_folder(spark)}/binary-{uuid.uuid4().hex}"
    _table(spark, sf_dir, "region").select("r_regionkey", F.col("r_name").alias("value")).write.partitionBy("r_regionkey").text(folder)
    files = S.read_binary(spark, f"{folder}/*", "*.txt")
    return files.select(F.regexp_extract("path", r"r_regionkey=(\d+)", 1).cast("int").alias("r_regionkey"), _said("sha:", F.sha2("content", 256)).alias("content"))


@query("SELECT count(DISTINCT source) - 1 AS rows, true AS has_bytes FROM documents")
def cache_table_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows are inserted where missing, one key is invalidated, and the table is counted."""
    schema = "config_hash string, model_id string, created_at timestamp"
    table = C.CacheTable(spark, f"{S.shared_folder(spark)}/cache-{uuid.uuid4().hex}", schema, "config_hash")
    fresh = _table(spark, sf_dir, "documents").select(F.col("source").alias("config_hash"), F.lit("m").alias("model_id"), F.timestamp_seconds(F.lit(1)).alias("created_at")).distinct()
    table.insert_missing(fresh)
    table.insert_missing(fresh)
    table.invalidate(fresh.agg(F.min("config_hash").alias("config_hash")))
    return table.stats().select("rows", (F.col("bytes") > 0).alias("has_bytes"))


# Strata


def _strata_sql(fields: dict[str, str]) -> str:
    cells = " UNION ALL ".join(f"SELECT '{f}' AS field, {v} AS value, avg(CAST(prediction = reference AS INT)) AS acc, count(*) AS n FROM t WHERE {v} IS NOT NULL GROUP BY 2" for f, v in fields.items())
    return f"""WITH t AS {_LABELLED}, cells AS ({cells} UNION ALL SELECT 'overall', NULL, avg(CAST(prediction = reference AS INT)), count(*) FROM t)
SELECT concat_ws('/', field, value, 'accuracy') AS key, round_even(acc, 4) AS value FROM cells UNION ALL SELECT concat_ws('/', field, value, 'count'), CAST(n AS DOUBLE) FROM cells
UNION ALL SELECT field || '/disparity', round_even(max(round_even(acc, 4)) - min(round_even(acc, 4)), 4) FROM cells WHERE field <> 'overall' GROUP BY field"""


@query(_strata_sql({"country": "nullif(lang, 'en')"}))
def geographic_accuracy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows without a country are in no group but count in all."""
    return registry.metrics.get("geographic_accuracy").make(_labelled(spark, sf_dir).withColumn("country", F.nullif(F.col("lang"), F.lit("en"))))


@query(_strata_sql({"mentions_gender": "CASE WHEN toxic > 0 THEN 'with_gender' ELSE 'without_gender' END", "mentions_age": "CASE WHEN row_id % 3 = 1 THEN 'with_age' WHEN row_id % 3 = 2 THEN 'without_age' END"}))
def demographic_accuracy(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _labelled(spark, sf_dir).withColumn("mentions_gender", F.col("toxic").cast("double"))
    rows = rows.withColumn("mentions_age", F.when(F.col("row_id") % 3 == 1, 1.0).when(F.col("row_id") % 3 == 2, 0.0))
    return registry.metrics.get("demographic_accuracy").make(rows)


# Numbers and scripts

_ENGLISH_SQL = f"""concat_ws(' ', CASE WHEN n >= 100 THEN {_words_sql(numbers.ONES)}[n // 100 + 1] || ' hundred' END,
  CASE WHEN n % 100 >= 20 THEN {_words_sql(numbers.TENS)}[n % 100 // 10 + 1] END, CASE WHEN n % 100 BETWEEN 1 AND 19 THEN {_words_sql(numbers.ONES)}[n % 100 + 1] WHEN n % 100 >= 20 AND n % 10 > 0 THEN {_words_sql(numbers.ONES)}[n % 10 + 1] END)"""
_HINDI_SQL = f"""concat_ws(' ', CASE WHEN m >= 1000 THEN {_words_sql(numbers.HINDI)}[m // 1000 + 1] || ' हजार' END,
  CASE WHEN m % 1000 >= 100 THEN {_words_sql(numbers.HINDI)}[m % 1000 // 100 + 1] || ' सौ' END, CASE WHEN m % 100 > 0 THEN {_words_sql(numbers.HINDI)}[m % 100 + 1] END)"""


@query(f"""
WITH p AS (SELECT p_partkey, p_size * 13 AS n, p_size * 1307 AS m, p_name FROM part)
SELECT p_partkey, 'take ' || {_ENGLISH_SQL} || ' mg 2x' AS english, {_HINDI_SQL} AS hindi, 'dose ' || {_ENGLISH_SQL} || ' mg daily' AS processed, 'Dose, ' || p_name || '!' AS as_is FROM p
""")
def spelled_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Numbers in words in two languages, and the general processor with its flags."""
    n = F.col("p_size") * 13
    return _table(spark, sf_dir, "part").select(
        "p_partkey", numbers.digits_to_words(_said("take ", n, " mg 2x")).alias("english"), numbers.digits_to_words((F.col("p_size") * 1307).cast("string"), "hi").alias("hindi"),
        T.general_text(_said("Dose: ", n, " mg, Daily!"), use_num2text=True).alias("processed"), T.general_text(_said(" Dose,  ", F.col("p_name"), "!"), use_punc=True, use_lowercasing=True).alias("as_is"),
    )


@query("""
SELECT p_partkey, 'दवा ' || p_name || ' "x" - ' || CAST(p_size AS VARCHAR) || 'mg ' || chr(2332) || chr(2364) || ' दुःख' || chr(2404) AS hindi,
  chr(2325 + p_size % 3) || CAST(p_size AS VARCHAR) AS script, CASE WHEN p_size % 2 = 0 THEN 'é' ELSE 'plain' END AS composed FROM part
""")
def indic_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rules, signs and spellings of Devanagari, and another script in Devanagari."""
    raw = _said("ाऔषध ​", F.col("p_name"), " “x” – ", F.col("p_size"), "mg ज़ दुःख|")
    bengali = F.element_at(F.array(*(F.lit(chr(0x0995 + i)) for i in range(3))), F.col("p_size") % 3 + 1)
    return _table(spark, sf_dir, "part").select(
        "p_partkey", T.multilingual_text(raw, [("औषध", "दवा"), ("X", "y"), ("mg", "")]).alias("hindi"), T.devanagari(_said(" ", bengali, F.col("p_size"))).alias("script"),
        T.composed(F.when(F.col("p_size") % 2 == 0, "e\u0301").otherwise("plain")).alias("composed"),
    )


# Normalisers


@query("""
SELECT p_partkey, 'I will say ' || p_name || ' will not and cannot they have what we would you are I am it is do not shall not let us' AS expanded, p_name || ' / ' || p_brand || ' x' AS spaced,
  p_name || ' millilitre html' AS replaced, p_size % 2 = 0 AS english, CASE WHEN p_size % 2 = 0 THEN 'tablets' ELSE 'tab' END AS unit FROM part
""")
def word_normalisers(spark: SparkSession, sf_dir: str) -> DataFrame:
    even = F.col("p_size") % 2 == 0
    units = T.matching_units(_said("two ", F.when(even, "Tablets").otherwise("tab"), " daily"), {"tab": ["tablet", "tablets"], "mg": ["milligram"]})
    return _table(spark, sf_dir, "part").select(
        "p_partkey", T.expanded_contractions(_said("I'll say ", F.col("p_name"), " won't and can't they've what we'd you're I'm it's don't shan't let's")).alias("expanded"),
        T.spaced_symbols(_said(F.col("p_name"), "/", F.col("p_brand"), "। x")).alias("spaced"), T.whole_word(_said(F.col("p_name"), " ML html"), "ml", "millilitre").alias("replaced"),
        T.is_english_word(F.when(even, "Dose,").otherwise("d0se")).alias("english"), units[0]["found"].alias("unit"),
    )


# Prompt parts


@query("""
SELECT p_partkey, 'A. ' || p_brand || CASE WHEN p_size % 2 = 0 THEN chr(10) || 'C. ' || p_type ELSE '' END AS block, CASE WHEN p_size % 2 = 0 THEN 'A' ELSE 'maybe' END AS truth,
  p_name AS renamed, 'Q1' || chr(10) || chr(10) || 'Q2' || chr(10) || chr(10) || p_name AS shots FROM part
""")
def prompt_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Options of a JSON object in the order of their letters without those that are n/a, truth values, renamed keys and examples."""
    even = F.col("p_size") % 2 == 0
    options = F.to_json(F.struct(F.when(even, F.col("p_type")).otherwise(" N/A ").alias("C"), F.col("p_brand").alias("A")))
    return _table(spark, sf_dir, "part").select(
        "p_partkey", P.options_from_map(P.options_from_json(options)).alias("block"), P.true_false(F.when(even, "True").otherwise("maybe")).alias("truth"),
        F.element_at(P.renamed_keys(F.create_map(F.lit("old"), F.col("p_name")), {"old": "new"}), "new").alias("renamed"), P.few_shot(F.array(F.lit("Q1"), F.lit("Q2")), F.col("p_name")).alias("shots"),
    )


# Pairs whose scores are known


@query(f"""
WITH p AS (SELECT p_partkey, p_size, p_size * 13 AS n FROM part), w AS (SELECT p_partkey, p_size, n, 'take ' || CAST(n AS VARCHAR) || ' mg now' AS reference, CASE WHEN p_size % 2 = 0 THEN 'take ' || {_ENGLISH_SQL} || ' mg now' ELSE 'take mg now' END AS prediction FROM p)
SELECT p_partkey AS row_id, CAST(CASE WHEN p_size % 2 = 0 THEN 0 ELSE 0.25 END AS DOUBLE) AS reconciled, levenshtein(reference, prediction) / length(reference) AS characters, CAST(levenshtein(reference, prediction) AS DOUBLE) AS distance, CAST(p_size % 2 = 0 AS DOUBLE) AS keywords FROM w
""")
def pair_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A number that is said in words or left out: texts brought into matching forms, plain character scores, keywords found."""
    n = F.col("p_size") * 13
    said = F.when(F.col("p_size") % 2 == 0, numbers.digits_to_words(_said("take ", n, " mg now"))).otherwise("take mg now")
    rows = _table(spark, sf_dir, "part").repartition(spark.sparkContext.defaultParallelism).select(F.col("p_partkey").alias("row_id"), _said("take ", n, " mg now").alias("reference"), said.alias("prediction"))
    using = align.Resources({"mg": ["milligram"]})

    def score(ref: str, hyp: str) -> tuple[float, ...]:
        found = align.keyword_pairs(*align.reconciled(ref, hyp, using), [align.normal_keyword(ref.split()[1], using)])
        return align.word_rate(*align.reconciled(ref, hyp, using)), align.character_rate(ref, hyp), align.distance(ref, hyp), sum(a == b for a, b in found)

    return A.scored(rows, score, ("reconciled", "characters", "distance", "keywords"), ("row_id",))


@query("SELECT p_partkey AS row_id, (length(replace(p_name, ' ', '')) - 3) / length(replace(p_name, ' ', '')) AS part, CAST(0 AS DOUBLE) AS same FROM part")
def part_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A name against its beginning: the character rate that is lenient with parts."""
    rows = _table(spark, sf_dir, "part").select(F.col("p_partkey").alias("row_id"), F.col("p_name").alias("reference"), F.substring("p_name", 1, 3).alias("prediction"))
    return A.scored(rows, lambda ref, hyp: (align.part_rate(ref, hyp), align.part_rate(ref, ref.replace(" ", "-"))), ("part", "same"), ("row_id",))


# Pooling


@query("""
WITH e AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS v, vec_id % 2 AS m FROM embeddings)
SELECT vec_id, round(CASE WHEN m = 1 THEN (v[1] + v[len(v)]) / 2 ELSE v[1] END, 5) AS mean, round(CASE WHEN m = 1 THEN v[len(v)] ELSE v[1] END, 5) AS last, round(v[1], 5) AS first FROM e
""")
def pooled_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two token vectors of which the second is masked in every other row."""
    v = F.transform("embedding", lambda x: x.cast("double"))
    rows = _table(spark, sf_dir, "embeddings").select("vec_id", F.array(v, F.reverse(v)).alias("tokens"), F.array(F.lit(1), (F.col("vec_id") % 2).cast("int")).alias("mask"))
    tokens, mask = F.col("tokens"), F.col("mask")
    return rows.select("vec_id", *(F.round(pool(tokens, mask)[0], 5).alias(n) for n, pool in (("mean", R.mean_pooling), ("last", R.eos_pooling), ("first", R.cls_pooling))))
