"""Golden pairs and invariants of column functions."""

import pytest
from pyspark.sql import functions as F

from assayer.functions import extract as X
from assayer.functions import numbers as N
from assayer.functions import prompts as P
from assayer.functions import text as T


def value(spark, column, **columns):
    df = spark.range(1).select(*(F.lit(v).alias(k) for k, v in columns.items()))
    return df.select(column.alias("v")).first()[0]


def applied(spark, make, texts):
    """make(column) over several texts in one job."""
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    return [r[0] for r in df.orderBy("i").select(make(F.col("t")).alias("v"), "i").orderBy("i").select("v").collect()]


GOLDEN = [
    (T.spaced_ranges, {"3-4 times": "3 - 4 times", "pantop-dsr": "pantop-dsr", "10-15mg": "10 - 15mg"}),
    (lambda c: T.spaced_units(c, ["mg", "%", "g"]), {"20mg": "20 mg", "2% solution": "2 % solution", "5G": "5 g"}),
    (T.without_punctuation, {"hello, world.": "hello world", "zero-dol": "zero-dol", "mg/dl test.": "mg/dl test", "a\\b": "a b"}),
    (T.expanded_contractions, {"I'm fine": "I am fine", "doesn't hurt": "does not hurt", "He's sick": "He is sick", "can't won't": "cannot will not"}),
    (lambda c: T.mapped_words(c, {"dolo": "paracetamol", "twice": "two times"}), {"Take Dolo twice": "Take paracetamol two times"}),
    (T.spaced_symbols, {"a/b। c": "a / b c"}),
    (lambda c: T.whole_word(c, "ml", "millilitre"), {"5 ML now html": "5 millilitre now html"}),
    (lambda c: T.whole_word(c, "/", "per"), {"5 / 6 a/b": "5 per 6 a/b"}),
    (T.general_text, {" Héllo,  WORLD! ": "héllo world", "": ""}),
    (lambda c: T.general_text(c, use_num2text=True), {"Take 25 now": "take twenty five now"}),
    (T.multilingual_text, {"ाअ é": "अ é", "plain": "plain"}),
    (T.devanagari, {"ক": "क", "abc ": "abc"}),
    (T.silence_left, {"[noise] um, (x) Okay!": "", "<a> hello - uh": "hello", "": ""}),
    (T.strip, {"  \x1cab ": "ab"}),
]


@pytest.mark.parametrize(("make", "pairs"), GOLDEN)
def test_golden(spark, make, pairs):
    assert applied(spark, make, list(pairs)) == list(pairs.values())


def test_nulls(spark):
    assert applied(spark, T.general_text, [None]) == [""]
    assert applied(spark, lambda c: X.wrapped_letter(c)["success"], [None]) == [False]


def test_rules():
    assert T.read_rules(["# no", "", "ab  c d", "abc x", "z"]) == [("abc", "x"), ("ab", "c d"), ("z", "")]


WRAPPED = {
    "Final Answer: **(A)**": "A", "Final Answer: ** (C)": "C", "Final Answer:\nFinal Answer: [b]": "B", "(D)": "D", "Final Answer: A. because": "A", "Final Answer: e) x": "E", "Final Answer: F": "", "": "", "Final Answer:": "",
    "so Final Answer: \n\n `B`\nFinal Answer: C": "B", "Answer A": "", "Final Answer: (AB)": "",
}


def test_wrapped_letter(spark):
    found = applied(spark, X.wrapped_letter, list(WRAPPED))
    assert [r["answer"] for r in found] == list(WRAPPED.values())
    assert [r["success"] for r in found] == [bool(v) for v in WRAPPED.values()]


def test_cascaded_letter(spark):
    texts = {"Final Answer: (B)": "B", "final answer - c": "C", "the answer is (d)": "D", "I say\nD?": "D", "it must be a).": "A", "well B or so then": "B", "zzz": "zzz"}
    found = applied(spark, X.cascaded_letter, list(texts))
    assert [r["answer"] for r in found] == list(texts.values())
    assert [r["success"] for r in found] == [True] * 6 + [False]


def test_other_extractors(spark):
    assert [tuple(r) for r in applied(spark, X.marked_answer, ["x Final Answer: a b Final Answer: c", "none", "Final Answer: "])] == [("a b", True), ("", False), ("", True)]
    assert [tuple(r) for r in applied(spark, lambda c: X.marked_answer(c, False), ["Final Answer: "])] == [("", False)]
    assert [r["answer"] for r in applied(spark, X.leading_letter, ["(b) x", "**C", "x", ""])] == ["B", "C", "", ""]
    assert [tuple(r) for r in applied(spark, X.scanned_letter, ["a lot", "see b) or a)", "no D", "xyz", ""])] == [("A", True), ("A", True), ("D", True), ("X", False), ("", False)]
    assert [tuple(r) for r in applied(spark, X.calculated, ['{"a":1} {"b": 2}', " 7.5 ", "m2 gives 12.5 or -3", "none"])] == [('{"b":2}', True), ("7.5", True), ("-3", True), ("", False)]
    assert [r["answer"] for r in applied(spark, lambda c: X.translation(c, "Hindi"), ["In Hindi: x", "translation: y", "z"])] == ["x", "y", "z"]
    assert applied(spark, X.answer_tag, ["<ANSWER> a\n</answer> b", "x\n y \n", "z"]) == ["a", "y", "z"]
    assert applied(spark, X.think_tag, ["<think>a</think>b", " c "]) == ["a", "c"]
    assert applied(spark, X.numbered_steps, ["1. a b\n2. c 3.5 mg 10. d", ""]) == [["a b", "c 3.5 mg", "d"], []]
    assert applied(spark, lambda c: X.json_field(c, "s"), ['```json\n{"s": "t"}\n```', "plain"]) == ["t", "plain"]
    assert applied(spark, lambda c: X.calculated_field(c, "v"), ['{"v": "2.5"}', "3", "x"]) == [2.5, 3.0, None]


def test_prompts(spark):
    opt = P.options_block([F.lit("x"), F.lit(None).cast("string"), F.lit("z")])
    assert value(spark, opt, a=1) == "A. x\nC. z"
    assert value(spark, P.options_from_map(F.create_map(F.lit("B"), F.lit("y"), F.lit("A"), F.lit("x"))), a=1) == "A. x\nB. y"
    assert value(spark, P.letter_at(F.lit(9)), a=1) == "J" and value(spark, P.letter_at(F.lit(30)), a=1) is None
    texts = F.array(F.lit("p"), F.lit("q"))
    assert [value(spark, P.letter_of(texts, F.lit(a)), a=1) for a in ("q", "option1", "nope")] == ["B", "A", ""]
    assert [value(spark, P.age_in_years(F.lit(d)), a=1) for d in ("2000-07-20", "2000-07-21", "x")] == [24, 23, None]
    assert value(spark, P.with_context(F.lit("q"), F.lit(None).cast("array<string>")), a=1) == "q"
    assert value(spark, F.map_values(P.options_from_json(F.lit('{"a": "x", "b": "N/A"}'))), a=1) == ["x"]


def test_numbers():
    assert " ".join(N.english("1105", True)) == "one thousand one hundred and five"
    assert " ".join(N.english_decimal("7.05")) == "seven point zero five"
    assert N.english("0") == ["zero"] and N.english("1" + "0" * 12) == ["one"] + ["zero"] * 12
    assert " ".join(N.hindi("125")) == "एक सौ पच्चीस" and " ".join(N.hindi("२१")) == "इक्कीस"
    assert " ".join(N.hindi("250099")) == "दो लाख पचास हजार निन्यानवे"
    assert N.numbers_in_words("take 20 x20", "en") == "take twenty x20" and N.numbers_in_words("20", "xx") == "20"
