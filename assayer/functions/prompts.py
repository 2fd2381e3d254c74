"""Prompt and reference construction as column expressions."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

LETTERS = "ABCDEFGHIJ"
#: The fixed date at which ages count.
AGE_DATE = "2024-07-20"


def lettered(options: Sequence[Column]) -> Column:
    """array<string> of "A. text" for the options that are there; letters go by position, so a missing one is skipped."""
    rows = [F.when(o.isNotNull() & (o.cast("string") != ""), F.concat(F.lit(f"{x}. "), o.cast("string"))) for x, o in zip(LETTERS, options)]
    return F.filter(F.array(*rows), lambda x: x.isNotNull())


def options_block(options: Sequence[Column]) -> Column:
    return F.array_join(lettered(options), "\n")


def options_from_map(options: Column) -> Column:
    """The block for a map of letter to text, in the order of its letters."""
    own = F.array_sort(F.filter(F.map_entries(options), lambda e: e["value"].isNotNull()))
    return F.array_join(F.transform(own, lambda e: F.concat(e["key"], F.lit(". "), e["value"])), "\n")


def options_from_array(options: Column) -> Column:
    letter = lambda i: F.element_at(F.array(*map(F.lit, LETTERS)), i + 1)
    return F.array_join(F.filter(F.transform(options, lambda x, i: F.concat(letter(i), F.lit(". "), x)), lambda x: x.isNotNull()), "\n")


def options_from_json(options: Column) -> Column:
    """The map of a JSON object's options without "n/a"; null if it isn't one."""
    return F.map_filter(F.from_json(options, "map<string,string>"), lambda k, v: v.isNotNull() & (F.lower(F.trim(v)) != "n/a"))


def letter_at(index: Column) -> Column:
    """0 to A, 1 to B and so on; null beyond."""
    return F.try_element_at(F.array(*map(F.lit, LETTERS)), index + 1)


def letter_of(options: Column, answer: Column) -> Column:
    """The letter of an answer given as text or as `optionN`; an empty text if it is none of the options."""
    number = F.regexp_extract(F.lower(answer), r"^option\s*(\d+)$", 1).try_cast("int")
    position = F.coalesce(F.nullif(F.array_position(options, answer), F.lit(0)), number)
    return F.coalesce(F.when(position > 0, letter_at((position - 1).cast("int"))), F.lit(""))


def true_false(answer: Column) -> Column:
    return F.when(F.lower(answer) == "true", "A").when(F.lower(answer) == "false", "B").otherwise(answer)


def filled(template: str, slots: Mapping[str, Column]) -> Column:
    """The template with each `<NAME>` replaced; a null counts as empty."""
    out = F.lit(template)
    for name, value in slots.items():
        out = F.replace(out, F.lit(f"<{name}>"), F.coalesce(value.cast("string"), F.lit("")))
    return out


def with_context(question: Column, context: Column) -> Column:
    """A context block before the question where there is context (array<string>)."""
    block = F.array_join(context, "\n")
    return F.when(F.coalesce(block, F.lit("")) == "", question).otherwise(F.concat(F.lit("Context:\n"), block, F.lit("\n\n"), question))


def conversation(turns: Column) -> Column:
    """array<struct<content, role>> of array<struct<turn, role, text>> in the order of the turns."""
    return F.transform(F.array_sort(turns), lambda t: F.struct(t["text"].alias("content"), t["role"].alias("role")))


def criteria(rubrics: Column) -> Column:
    """array<struct<rubric_id, criterion, points, tags>>; points default to 1 and an id to the position."""
    return F.transform(
        rubrics,
        lambda r, i: F.struct(i.cast("string").alias("rubric_id"), r["criterion"].alias("criterion"), F.coalesce(r["points"].cast("double"), F.lit(1.0)).alias("points"), r["tags"].alias("tags")),
    )


def few_shot(examples: Column, question: Column) -> Column:
    """Examples (array<string>) before the question, two line ends apart."""
    return F.array_join(F.concat(examples, F.array(question)), "\n\n")


def age_in_years(born: Column, at: str = AGE_DATE) -> Column:
    """Whole years at a fixed date; null for an unreadable date of birth."""
    day, born = F.lit(at).cast("date"), born.try_cast("date")
    early = (F.month(day) < F.month(born)) | ((F.month(day) == F.month(born)) & (F.dayofmonth(day) < F.dayofmonth(born)))
    return F.year(day) - F.year(born) - F.when(early, 1).otherwise(0)


def renamed_keys(values: Column, names: Mapping[str, str]) -> Column:
    """A map with known keys renamed."""
    table = F.create_map(*(F.lit(x) for pair in names.items() for x in pair))
    return F.transform_keys(values, lambda k, _: F.coalesce(F.try_element_at(table, k), k))
