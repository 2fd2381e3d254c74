"""Cache, datasets, registries, reports, runs and streams."""

import json

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from assayer.operators import cache as C
from assayer.operators import predict as Q
from assayer.plans import registry, run
from assayer.sources import datasets as D
from assayer.sources import tables as S
from assayer.streaming import ingest as I


def test_cache_table(spark, tmp_path):
    table = C.CacheTable(spark, str(tmp_path / "cache"))
    assert table.read().count() == 0
    row = lambda key, out, at: spark.range(1).select(F.lit(key).alias("cache_key"), F.lit(out).alias("model_output"), F.lit(True).alias("success"), F.timestamp_seconds(F.lit(at)).alias("updated_at"))
    table.upsert(row("a", "1", 1).union(row("b", "", 1)).union(row("c", "3", 1)))
    table.upsert(row("a", "2", 2).unionByName(row("d", "4", 2)))
    table.insert_missing(row("a", "9", 9).unionByName(row("e", "5", 9)))
    assert {r["cache_key"]: r["model_output"] for r in table.read().collect()} == {"a": "2", "c": "3", "d": "4", "e": "5"}
    table.invalidate(spark.createDataFrame([("a",)], "cache_key string"))
    assert table.read().count() == 3
    assert table.stats().first()["bytes"] > 0


def test_keys(spark):
    df = spark.createDataFrame([("x", None), ("x", None), ("y", "s")], "input string, system_prompt string")
    keys = [r["cache_key"] for r in C.with_key(df, C.config_hash({"b": 1, "a": 2})).collect()]
    assert keys[0] == keys[1] != keys[2] and C.config_hash({"a": 2, "b": 1}) == C.config_hash({"b": 1, "a": 2})


def test_cached_predict_keeps_rows_together(spark):
    samples = spark.range(50).select(F.col("id").alias("row_id"), F.col("id").cast("string").alias("input"), F.md5(F.col("id").cast("string")).alias("cache_key"))
    stamp = F.lit(0).cast("timestamp")
    cached = samples.where("row_id % 3 = 0").select("cache_key", F.concat(F.lit("c"), "input").alias("model_output"), F.lit(True).alias("success"), stamp.alias("updated_at"))
    found = Q.cached_predict(samples, cached, lambda: Q.EchoPredictor(lambda p: f"m{p}")).collect()
    assert {r["row_id"]: r["raw_response"] for r in found} == {i: f"{'c' if i % 3 == 0 else 'm'}{i}" for i in range(50)}
    assert sum(r["from_cache"] for r in found) == 17


def test_threaded_retries():
    tries = {}

    def ask(prompt):
        tries[prompt] = tries.get(prompt, 0) + 1
        if tries[prompt] < 2:
            raise Q.RetryLater
        return prompt.upper()

    assert Q.threaded(ask, wait=0)(["a", "b"]) == ["A", "B"]


def test_run_with_cache(spark, tmp_path):
    rows = spark.createDataFrame([(1, "q", "x", "y", None, None, 0), (2, "r", "x", "y", "z", None, 1)], "row_id long, question string, opa string, opb string, opc string, opd string, cop int")
    samples = D.DATASETS["medmcqa"].build(D.numbered(rows, "d"))
    table = C.CacheTable(spark, str(tmp_path / "cache"))
    once = lambda: run.evaluate(samples, lambda: Q.EchoPredictor(lambda p: "Final Answer: (A)"), ["exact_match", "accuracy"], D.DATASETS["medmcqa"].extract, table=table, dataset="d").collect()
    first, again = once(), once()
    assert {(r["metric"], r["value"], r["num_samples"]) for r in first} == {("exact_match", 0.5, 2), ("accuracy", 0.5, 2)} == {(r["metric"], r["value"], r["num_samples"]) for r in again}
    assert table.read().count() == 2
    tree = S.nested(run.evaluate_all({"d": {"samples": samples, "metrics": ["exact_match"]}}, Q.EchoPredictor), {"total": 1})
    assert tree["d"]["metrics"]["exact_match"]["num_samples"] == 2
    for kind in ("json", "yaml", "csv"):
        S.write_report(tree, str(tmp_path / f"r.{kind}"), kind)
    assert S.read_report(str(tmp_path / "r.json")) == json.loads(json.dumps(tree))
    assert "exact_match" in S.shown(tree) and "_summary" not in (tmp_path / "r.csv").read_text()
    dry = run.evaluate(samples, Q.EchoPredictor, ["exact_match"], dry_run=True).first()
    assert dry["num_samples"] == 0


def test_registry():
    assert len(registry.datasets.names()) == len(D.DATASETS)
    own = registry.Registry("thing")
    own.register("x", ["a"], ["b"], {"c": 1})(lambda **k: k)
    assert own.create("x", {"a": 0}) == {"c": 1, "a": 0}
    with pytest.raises(ValueError, match="needs a"):
        own.arguments("x", {})
    with pytest.warns(UserWarning, match="doesn't know d"):
        assert own.arguments("x", {"a": 0, "d": 5})["d"] == 5
    with pytest.raises(KeyError):
        own.get("y")
    with pytest.raises(ValueError, match="already"):
        own.register("x")(print)
    assert own.remove("x") and not own.remove("x")


def test_arguments():
    assert registry.parse_nested("ds1:arg1=val1;ds2:arg2=val2,arg3=a=b") == {"ds1": {"arg1": "val1"}, "ds2": {"arg2": "val2", "arg3": "a=b"}}
    assert registry.parse_processors("org/ds.proc:k=v") == {"org/ds": {"proc": {"k": "v"}}}
    assert registry.parse_list(" a, b,,") == ["a", "b"]
    for bad in ("ds", "ds:k"):
        with pytest.raises(ValueError):
            registry.parse_nested(bad)
    base = registry.Model("m", "embedding", settings={"a": 1})
    assert base.overridden({"a": 2}, {"b": 3}).settings == {"a": 2, "b": 3} and base.settings == {"a": 1}
    with pytest.raises(ValueError):
        registry.Model("m", "odd")


def test_compatible(spark):
    models = registry.model_rows(spark, [registry.Model("t", "text_generation"), registry.Model("a", "audio_recognition", ("audio",))])
    got = {(r[0], r[1]) for r in registry.compatible(models, D.catalogue(spark)).collect()}
    assert ("t", "medqa") in got and ("t", "vqa_rad") not in got and ("a", "indic_voices") in got and ("a", "medqa") not in got


BUILT = {
    "medqa": ([({"Question": "q", "Options": {"B": "y", "A": "x"}, "Context": None, "Correct Option": "A"},)], "data struct<Question: string, Options: map<string,string>, Context: array<string>, `Correct Option`: string>", "q\nA. x\nB. y", "A"),
    "medqa_usmle": ([("q", {"A": "x"}, "A")], "question string, options map<string,string>, answer_idx string", "Question: q\nA. x", "A"),
    "mmlu_subset": ([("q", ["x", "y"], [])], "centerpiece string, options array<string>, correct_options array<string>", "q\nA. x\nB. y", ""),
    "formulary_json_mcq": ([("q", None, "True")], "question string, options string, answer string", "q\nA. True\nB. False", "A"),
    "drug_mcq": ([("q", "x", "nan", "z", None, None, "c")], "question string, option_a string, option_b string, option_c string, option_d string, option_e string, correct_answer string", "q\nA. x\nC. z", "C"),
    "vqa_rad": ([("q", "YES", (b"i",))], "question string, answer string, image struct<bytes: binary>", "q", "yes"),
    "medical_calculator": ([("q", "in mg", "5", 0.1, "f")], "question_text string, confinement_instruction string, expected_output string, tolerance double, primary_field string", "q\nin mg", "5"),
    "medcasereasoning": ([("c", "d", "1. a 2. b")], "case_prompt string, final_diagnosis string, diagnostic_reasoning string", "c", "d"),
}


@pytest.mark.parametrize("name", BUILT)
def test_samples(spark, name):
    rows, schema, asked, reference = BUILT[name]
    got = D.DATASETS[name].build(D.numbered(spark.createDataFrame(rows, schema), name)).first()
    assert got["input"].endswith(asked) and got["reference"] == reference and got["dataset"] == name


def test_regional_samples(spark):
    schema = "question string, question_clean string, answer_options string, correct_answer string, question_type string, split string, tier string, specialty string, country string, mentions_gender double, row_id long"
    rows = [("q", None, '{"option2": "y", "option1": "x", "option3": "N/A"}', "option2", " MCQ", "test", "1", "s", "k", 1.0, 1), ("q", "", '{"option1": "x"}', "x", "mcq", "train", "1", "s", "k", 1.0, 2)]
    got = D.regional_mcq(D.numbered(spark.createDataFrame(rows, schema), "r")).collect()
    assert len(got) == 1 and got[0]["reference"] == "B" and got[0]["meta"]["country"] == "k" and got[0]["input"].endswith("q\nA. x\nB. y")


def test_filters_keep_nulls_and_limits_count_rows_left(spark):
    df = spark.createDataFrame([(1, "a", None), (2, "b", 2), (3, "c", 1)], "row_id long, content string, category int")
    assert [r["row_id"] for r in D.patient_safety(D.numbered(df, "p")).orderBy("row_id").collect()] == [1, 3]
    own = spark.createDataFrame([(i, "p", i % 2) for i in range(10)], "row_id long, prompt string, harmful_level int")
    assert [r["row_id"] for r in D.refusals(D.numbered(own, "c"), 1, 2).orderBy("row_id").collect()] == [1, 3]


def test_rubric_samples(spark):
    df = spark.createDataFrame([("i", "ask", '[{"criterion": "a", "points": 2}]', '[{"criterion": "b"}]', 1)], "prompt_id string, doctor_query string, query_rubrics string, answer_rubrics string, difficulty_level int")
    got = D.staged_rubric(D.numbered(df, "p", "prompt_id")).first()
    assert [(r["criterion"], r["points"], r["tags"]) for r in got["rubric"]] == [("a", 2.0, ["stage:retrieval_query"]), ("b", 1.0, ["stage:final_answer"])]
    assert got["conversation"][0]["role"] == "user"


def test_retrieval_samples(spark):
    queries = spark.createDataFrame([(1, "t"), (2, "u")], "query_id long, text string")
    qrels = spark.createDataFrame([(1, 7, 1)], "query_id long, doc_id long, rel int")
    got = {r["input"]: r["reference"] for r in D.retrieval(D.numbered(queries, "r", "query_id"), qrels).collect()}
    assert got == {"t": '{"7":1}', "u": "{}"}


def test_parallel_text(spark):
    df = D.numbered(spark.createDataFrame([("h", "e")], "hin_Deva string, eng_Latn string"), "t")
    assert D.parallel_text(df, "eng_Latn", "hin_Deva").first()["reference"] == "h"
    with pytest.raises(ValueError):
        D.parallel_text(df, "eng_Latn", "xx")


def test_readers(spark, tmp_path):
    spark.createDataFrame([(1, "test"), (2, "train")], "a int, split string").write.parquet(str(tmp_path / "t" / "v1"))
    assert S.read(spark, str(tmp_path / "t"), version="v1", split="test").count() == 1
    (tmp_path / "b").mkdir()
    (tmp_path / "b" / "x.wav").write_bytes(b"123")
    assert bytes(S.read_binary(spark, str(tmp_path / "b"), "*.wav").first()["content"]) == b"123"
    (tmp_path / "rules.txt").write_text("# c\nab c\n")
    assert S.read_rules(spark, str(tmp_path / "rules.txt")) == [("ab", "c")]
    assert S.query(spark, "SELECT :x AS v", x=5).first()[0] == 5
    df = spark.range(20).withColumnRenamed("id", "row_id")
    assert [r[0] for r in S.first(df.repartition(5), 3).collect()] == [0, 1, 2]
    draw = {r[0] for r in S.drawn(df, 5, 1).collect()}
    assert draw == {r[0] for r in S.drawn(df.repartition(7), 5, 1).collect()} and len(draw) == 5
    assert (S.format_size(2048), S.format_duration(61), S.format_duration(3700)) == ("2.0 KB", "1m 1s", "1h 1m 40s")


def test_stream_into_cache(spark, tmp_path):
    source, table = str(tmp_path / "in"), C.CacheTable(spark, str(tmp_path / "cache"))
    row = spark.createDataFrame([("k", "out")], "cache_key string, model_output string")
    whole = spark.createDataFrame([], C.RESULTS_SCHEMA).unionByName(row.withColumn("updated_at", F.lit(0).cast("timestamp")), allowMissingColumns=True)
    whole.write.mode("append").parquet(source)
    for _ in range(2):
        I.into_cache(I.read_results(spark, source), table, str(tmp_path / "check")).awaitTermination()
    assert [(r["cache_key"], r["model_output"]) for r in table.read().collect()] == [("k", "out")]


def test_running_accuracy(spark, tmp_path):
    spark.createDataFrame([("a", "a", 0), ("a", "b", 10), ("a", "a", 7300)], "prediction string, reference string, s long").select("prediction", "reference", F.timestamp_seconds("s").alias("ts")).write.parquet(str(tmp_path / "e"))
    stream = spark.readStream.schema("prediction string, reference string, ts timestamp").parquet(str(tmp_path / "e"))
    query = I.running_accuracy(stream).writeStream.outputMode("complete").format("memory").queryName("running").start()
    query.processAllAvailable()
    query.stop()
    assert sorted((r["n"], r["accuracy"]) for r in spark.sql("SELECT * FROM running").collect()) == [(1, 1.0), (2, 0.5)]


def test_entry(spark):
    assert entry.entry(spark).count() > 10
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_traces_come_with_answers(spark):
    from assayer.operators.predict import predict_traced

    def make():
        return lambda prompts: [{"text": f" {p}! ", "tool_trace": "[1]"} if p else None for p in prompts]

    rows = spark.createDataFrame([(1, "a"), (2, None), (3, "b")], "row_id long, input string")
    got = sorted(map(tuple, predict_traced(rows, make, batch=2).select("row_id", "raw_response", "tool_trace").collect()))
    assert got == [(1, "a!", "[1]"), (2, "", ""), (3, "b!", "[1]")]


def test_encoded_texts_are_searched(spark):
    from assayer.operators.predict import encode
    from assayer.operators.ranking import top_k

    def make():
        return lambda texts: [[t.count("a"), t.count("b")] for t in texts]

    docs = encode(spark.createDataFrame([(1, "aaa"), (2, "bbb"), (3, None)], "doc_id long, text string"), make)
    asked = encode(spark.createDataFrame([(7, "ab b")], "query_id long, text string"), make, batch=1)
    assert [r["doc_id"] for r in top_k(docs, asked, 2).orderBy("rank").collect()] == [2, 1]


def test_component_catalogues(spark):
    from assayer.plans import registry

    rows = registry.model_rows(spark, [registry.Model("a", "text_generation", languages=("hi",)), registry.Model("b", "vqa", ("text", "image")), registry.Model("c", "text_generation")])
    names = lambda df: sorted(r["model"] for r in df.collect())
    assert names(registry.find_models(rows, "text_generation", "text", "hi")) == ["a", "c"]
    assert names(registry.find_models(rows, modality="image")) == ["b"] and names(registry.find_models(rows, language="ta")) == ["b", "c"]
    found = {r["name"]: r for r in registry.component_rows(spark, registry.datasets).collect()}
    assert found["parallel_conversations"]["required"] == ["source_language", "target_language"]
    assert {r["name"] for r in registry.component_rows(spark, registry.metrics).collect()} == set(registry.metrics.names())


def test_only_prompts_go_to_the_model(spark):
    """Lists, structs and maps stay in the JVM; every row is asked once and keeps its columns."""
    seen = spark.sparkContext.accumulator(0)

    def make():
        def run(prompts):
            seen.add(len(prompts))
            return [p.upper() for p in prompts]

        return run

    rows = spark.range(0, 300, 1, 2).selectExpr("id as row_id", "if(id % 3 = 0, null, concat('p', id)) as input", "array(struct(id as a, map('k', id) as m)) as nested")
    found = Q.predict(rows, make)
    assert "MapInArrow" not in found._jdf.queryExecution().executedPlan().toString()
    got = {r.row_id: (r.raw_response, r.nested[0].m["k"]) for r in found.where("raw_response <> 'x' or row_id >= 0").collect()}
    assert got == {i: ("" if i % 3 == 0 else f"P{i}", i) for i in range(300)}
    assert seen.value == 300
