"""Answer extraction: a response column to struct<answer, success>."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import SPACE, WORD, lines, strip

# The answer marker and what may surround a letter.
MARKER = "Final Answer:"
EDGE = r"[ \t\r\n*_`~]"


def result(answer: Column, success: Column) -> Column:
    return F.struct(answer.alias("answer"), success.alias("success"))


def _or_empty(answer: Column) -> Column:
    return result(F.coalesce(answer, F.lit("")), answer.isNotNull())


def _found(text: Column, pattern: str, group: int = 1) -> Column:
    """A group of the first match, or null."""
    return F.when(text.rlike(pattern), F.regexp_extract(text, pattern, group))


def _text(response: Column) -> Column:
    return F.coalesce(response, F.lit(""))


def wrapped_letter(response: Column, letters: str = "ABCDE") -> Column:
    """One option letter after the marker, freed of emphasis, repeated markers and one pair of brackets."""
    response = _text(response)
    at = F.locate(MARKER, response)
    raw = strip(F.when(at > 0, F.substring(response, at + len(MARKER), F.length(response))).otherwise(response))
    bare = lambda x: F.regexp_replace(x, f"^{EDGE}*(?:{MARKER}{EDGE}*)*|{EDGE}+$", "")
    first = F.try_element_at(F.filter(F.transform(lines(raw), lambda x: bare(bare(x))), lambda x: x != ""), F.lit(1))
    inner = F.when(first.rlike(r"(?s)^(\(.*\)|\[.*\])$"), F.regexp_replace(F.substring(first, F.lit(2), F.length(first) - 2), f"^{EDGE}+|{EDGE}+$", "")).otherwise(first)
    one = F.when((F.length(inner) == 1) & F.upper(inner).isin(*letters.upper()), F.upper(inner))
    return _or_empty(F.coalesce(one, F.upper(_found(inner, f"^(?i)([{letters}])[.):\\s]"))))


def marked_answer(response: Column, empty_counts: bool = True) -> Column:
    """The text between the first and second marker, stripped; without a marker no success."""
    parts = F.split(_text(response), MARKER)
    answer = strip(F.try_element_at(parts, F.lit(2)))
    there = F.size(parts) > 1
    return result(F.coalesce(answer, F.lit("")), there if empty_counts else there & (answer != ""))


def leading_letter(response: Column, letters: str = "ABCDE") -> Column:
    """The first character after brackets and asterisks, if it is one of the letters."""
    first = F.substring(F.regexp_replace(strip(_text(response)), r"^[()*]+|[()*]+$", ""), 1, 1)
    return _or_empty(F.when(F.upper(first).isin(*letters), F.upper(first)))


# The patterns of the five steps below.
STEPS = (
    r"(?i)final\s*answer\s*[:\-]?\s*[(\[]?\s*([a-eA-E])\s*[)\]]?",
    r"(?i)answer\s*(?:is|:)\s*\(?([a-eA-E])\)?",
    r"([a-eA-E])\s*[).?!]?\s*$",
    r"\b([a-eA-E])\b",
)


def cascaded_letter(response: Column) -> Column:
    """Final answer, then "answer is", a short last line, a trailing letter, a lone letter near the end; else the response."""
    response = _text(response)
    whole = strip(response)
    last = strip(F.element_at(F.split(whole, "\n"), -1))
    short = F.upper(F.regexp_replace(last, "[^a-zA-Z]", ""))
    letter = F.coalesce(
        _found(response, STEPS[0]),
        _found(response, STEPS[1]),
        F.when((F.length(last) <= 5) & short.isin(*"ABCDE"), short),
        _found(whole, STEPS[2]),
        _found(F.substring(whole, F.greatest(F.length(whole) - 49, F.lit(1)), F.lit(50)), STEPS[3]),
    )
    return result(F.coalesce(F.upper(letter), whole), letter.isNotNull())


def scanned_letter(response: Column, letters: str = "ABCD") -> Column:
    """Per letter in order: at the start or before a closing bracket; then any letter that occurs; else the first character."""
    text = F.upper(strip(_text(response)))
    explicit = F.coalesce(*(F.when(text.startswith(x) | text.contains(f"{x})"), F.lit(x)) for x in letters))
    anywhere = F.coalesce(*(F.when(text.contains(x), F.lit(x)) for x in letters))
    found = F.coalesce(explicit, anywhere)
    return result(F.coalesce(found, F.substring(text, 1, 1)), found.isNotNull())


def calculated(response: Column) -> Column:
    """The last flat JSON object, else the whole as a number, else the last number that stands alone."""
    text = strip(_text(response))
    objects = F.filter(F.regexp_extract_all(text, F.lit(r"\{[^{}]*\}"), F.lit(0)), lambda x: F.try_parse_json(x).isNotNull())
    parsed = F.to_json(F.try_parse_json(F.try_element_at(objects, F.lit(-1))))
    number = F.when(text.rlike(r"^[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?$"), text.try_cast("double").cast("string"))
    alone = F.try_element_at(F.regexp_extract_all(text, F.lit(rf"(?<!{WORD})-?\d+\.?\d*(?!{WORD})"), F.lit(0)), F.lit(-1))
    return _or_empty(F.coalesce(parsed, number, alone))


def calculated_field(answer: Column, field: str) -> Column:
    """A calculator answer as a number: the object's field, or the answer itself."""
    return F.coalesce(F.get_json_object(answer, f"$.{field}").try_cast("double"), answer.try_cast("double"))


def translation(response: Column, language: str) -> Column:
    """The response without the first of the usual lead-ins that it begins with."""
    text = strip(_text(response))
    out = text
    for prefix in reversed(("Translation:", "The translation is:", f"In {language}:", f"{language} translation:")):
        out = F.when(F.lower(text).startswith(prefix.lower()), strip(F.substring(text, F.lit(len(prefix) + 1), F.length(text)))).otherwise(out)
    return result(out, F.lit(True))


def has_answer_tag(response: Column) -> Column:
    return result(_text(response), _text(response).rlike("(?is)<answer>.*?</answer>"))


def answer_tag(response: Column) -> Column:
    """Inside the answer tag; else the last line with text; else everything."""
    text = _text(response)
    last = F.try_element_at(F.filter(F.transform(lines(text), strip), lambda x: x != ""), F.lit(-1))
    return F.coalesce(strip(_found(text, "(?is)<answer>(.*?)</answer>")), last, strip(text))


def think_tag(response: Column) -> Column:
    return F.coalesce(strip(_found(_text(response), "(?is)<think>(.*?)</think>")), strip(_text(response)))


def numbered_steps(text: Column) -> Column:
    """The items of a "1. ... 2. ..." list without their numbers."""
    parts = F.split(_text(text), rf"(?:^|(?<={SPACE}))(?=\d+\.\s)")
    return F.filter(F.transform(parts, lambda x: strip(F.regexp_replace(x, r"^\d+\.\s+", ""))), lambda x: x != "")


def json_field(response: Column, field: str) -> Column:
    """A field of a JSON response, or the response without its code fence."""
    bare = unfenced(response)
    return F.coalesce(F.get_json_object(bare, f"$.{field}"), bare)


def refused(response: Column, refusal: Column) -> Column:
    """`refusal` if the response equals it without regard to case, else the stripped response."""
    same = F.lower(strip(_text(response))) == F.lower(strip(refusal))
    return result(F.when(same, refusal).otherwise(strip(_text(response))), F.lit(True))


def stripped(response: Column) -> Column:
    return result(strip(_text(response)), F.lit(True))


def unfenced(response: Column) -> Column:
    return strip(F.regexp_replace(strip(_text(response)), r"(?i)^```(?:json)?\s*|\s*```$", ""))


def judge_json(response: Column) -> Column:
    """A judge's response as a variant; null if it isn't JSON."""
    return F.try_parse_json(unfenced(response))
