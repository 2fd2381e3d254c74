"""Each stage of the pipeline against a plain version of it."""

import collections
import hashlib

import public_tokenizers
import pytest
import tiktoken
from pyspark.sql import functions as F

import corpus_pipeline
from assayer.llm import bytebpe, mixing
from assayer.llm.common import table

from .test_pii import plain as plain_pii
from .test_quality import plain as plain_quality
from .test_simhash import plain_components, plain_fingerprint


@pytest.fixture(scope="module")
def stages(spark, sf):
    """The rows that each stage leaves, beginning with the table."""
    docs = table(spark, sf, "documents")
    out = [docs.collect()]
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, sf).persist()
        out.append(docs.collect())
    return out


def test_columns(stages):
    for rows in stages[:-1]:
        assert tuple(rows[0].asDict()) == corpus_pipeline.COLUMNS


def test_quality(stages):
    want = set()
    for r in stages[0]:
        words, _, _, _, repeated = plain_quality(r["text"])
        if words >= 20 and 100 * repeated <= 30 * words:
            want.add(r["doc_id"])
    kept = {r["doc_id"] for r in stages[1]}
    assert kept <= want
    assert len(want - kept) < 0.1 * len(want)  # what the labelled cutoffs add


def test_near_duplicates(stages):
    fp = {r["doc_id"]: plain_fingerprint(r["text"]) for r in stages[1]}
    root = plain_components(set(fp.values()))
    low = {}
    for i, f in fp.items():
        low[root[f]] = min(low.get(root[f], i), i)
    assert {r["doc_id"] for r in stages[2]} == set(low.values())


def test_personal_data(stages):
    before = {r["doc_id"]: r["text"] for r in stages[2]}
    assert {r["doc_id"] for r in stages[3]} == set(before)
    names = ("EMAIL", "IP", "CARD", "PHONE")
    for r in stages[3]:
        text = before[r["doc_id"]]
        assert not plain_pii(r["text"])
        assert r["n_chars"] == len(r["text"])
        spans = plain_pii(text)
        if not any(c in text for c in "0123456789@"):
            assert r["text"] == text
        for _, k, _ in spans[:1]:
            assert f"<{names[k]}>" in r["text"]


def test_mixing(stages):
    before = {r["doc_id"]: r for r in stages[3]}
    taken = collections.Counter()
    for r in stages[4]:
        taken[r["doc_id"]] += len(r["text"].encode().split())
        assert r["source"] == before[r["doc_id"]]["source"]
    size = {i: len(r["text"].encode().split()) for i, r in before.items()}
    assert all(n <= 2 * size[i] for i, n in taken.items())
    by = collections.Counter()
    for i, n in size.items():
        by[before[i]["source"]] += n
    want = mixing.targets(dict(by))
    got = collections.Counter()
    for i, n in taken.items():
        got[before[i]["source"]] += n
    for s, target in want.items():
        assert abs(got[s] - target) <= 1 + by[s] // mixing.FINE


def test_encoding(stages):
    with open(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), "rb") as file:
        ranks = bytebpe.read_ranks(file.read())
    coder = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    want = collections.Counter((r["doc_id"], tuple(coder.encode_ordinary(r["text"])), hashlib.sha256(r["text"].encode()).hexdigest()) for r in stages[4])
    assert collections.Counter((r["doc_id"], tuple(r["ids"]), r["decoded_sha256"]) for r in stages[5]) == want


def test_repeated_rows_meet(spark, sf):
    docs = table(spark, sf, "documents").limit(5)
    null = docs.withColumn("doc_id", F.lit(None).cast("long"))
    out = corpus_pipeline.near_duplicates(spark, docs.union(docs).union(null), sf)
    assert out.where("doc_id is not null").count() <= 5 and out.where("doc_id is null").count() == 5


def made(spark, rows):
    return spark.createDataFrame([(i, text, "en", source, len(text or "")) for i, text, source in rows], "doc_id long, text string, lang string, source string, n_chars long")


def test_rows_go_by_their_own_verdict(spark, sf):
    clean = " ".join(f"word{chr(97 + i)}" for i in range(24))
    docs = made(spark, [(None, "junk", "a"), (None, clean, "b"), (1, "junk", "c"), (1, clean, "d"), (2, None, "e"), (None, None, "f"), (None, "so it goes on and on " * 20, "g")])
    assert sorted(r["source"] for r in corpus_pipeline.quality_rules(spark, docs, sf).collect()) == ["b", "d"]


def test_rows_meet_by_their_own_text(spark, sf):
    one, two, three = (" ".join(f"{c}{i}" for i in range(60)) for c in "abc")
    docs = made(spark, [(1, one, "a"), (2, one, "b"), (2, two, "c"), (3, two, "d"), (None, three, "e"), (None, three, "e"), (None, three + " end", "e"), (4, two, "f")])
    out = corpus_pipeline.near_duplicates(spark, docs, sf).collect()
    assert sorted((str(r["doc_id"]), r["source"]) for r in out if r["source"] != "e") == [("1", "a"), ("2", "c")]
    assert 1 <= sum(r["source"] == "e" for r in out) <= 2  # one more word may be too far
    copies = corpus_pipeline.near_duplicates(spark, made(spark, [(None, three, "e")] * 4 + [(2, two, "c")] * 3), sf).collect()
    assert sorted(str(r["doc_id"]) for r in copies) == ["2", "None"]


def test_no_text_is_lost_and_extra_columns_stay(spark, sf):
    one, two = (" ".join(f"{c}{i}" for i in range(60)) for c in "ab")
    docs = made(spark, [(3, two, "b3"), (5, one, "a5"), (5, two, "b5"), (None, two, "bn")]).withColumn("kept", F.lit("k")).withColumn("a.b", F.lit(1)).withColumn("row", F.lit("r"))
    out = corpus_pipeline.near_duplicates(spark, docs, sf)
    assert out.columns == docs.columns
    assert sorted(r["source"] for r in out.collect()) == ["a5", "b3", "bn"]
    for stage in (corpus_pipeline.quality_rules, corpus_pipeline.personal_data, corpus_pipeline.target_weights):
        found = stage(spark, docs, sf)
        assert found.columns == docs.columns and {tuple(r) for r in found.select("kept", "`a.b`", "row").collect()} == {("k", 1, "r")}
        assert stage(spark, docs.limit(0), sf).count() == 0


def test_cutoffs_come_from_all_labelled_texts(spark, tmp_path):
    """Junk that is found only beyond the first 5,000 proposing texts, in the order of their hashes, is proposed and goes."""
    digest, words = F.xxhash64("text"), F.array_join(F.transform(F.sequence(F.lit(1), F.lit(24)), lambda i: F.concat(F.lit("w"), F.hex(F.pmod(F.xxhash64("doc_id", i), F.lit(1 << 30))))), " ")
    made = spark.range(45_000).withColumnRenamed("id", "doc_id").withColumn("junk", F.col("doc_id") >= 42_000)
    made = made.withColumn("text", F.when(F.col("junk"), F.regexp_replace(words, " ", "### ")).otherwise(words))
    proposes, late = F.pmod(F.xxhash64(F.lit(7), digest), F.lit(3)) == 0, F.xxhash64(F.lit(8), digest) > 0
    docs = made.where(~proposes | (late == F.col("junk"))).cache()
    assert docs.where(proposes & ~F.col("junk")).count() > 5000 and docs.where(proposes & F.col("junk")).count() > 200
    docs.selectExpr("doc_id", "if(junk, 0, 1) quality", "0 toxic").write.parquet(f"{tmp_path}/labels.parquet")
    given = docs.selectExpr("doc_id", "text", "'en' lang", "'a' source", "cast(length(text) as long) n_chars", "junk")
    kept = corpus_pipeline.quality_rules(spark, given, str(tmp_path))
    assert [tuple(r) for r in kept.groupBy("junk").count().collect()] == [(False, docs.where("not junk").count())]
