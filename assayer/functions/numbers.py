"""Numbers as words."""

from __future__ import annotations

import functools
import re
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

# Number words.
ONES = (
    "zero", "one", "two", "three", "four", "five", "six", "seven", "eight", "nine",
    "ten", "eleven", "twelve", "thirteen", "fourteen", "fifteen", "sixteen", "seventeen", "eighteen", "nineteen",
)
TENS = (
    "zero", "ten", "twenty", "thirty", "forty", "fifty", "sixty", "seventy", "eighty", "ninety",
)
SCALES = ((10**9, "billion"), (10**6, "million"), (10**3, "thousand"))
HINDI = (
    "शून्य", "एक", "दो", "तीन", "चार", "पांच", "छह", "सात", "आठ", "नौ",
    "दस", "ग्यारह", "बारह", "तेरह", "चौदह", "पंद्रह", "सोलह", "सत्रह", "अठारह", "उन्नीस",
    "बीस", "इक्कीस", "बाईस", "तेईस", "चौबीस", "पच्चीस", "छब्बीस", "सत्ताईस", "अट्ठाईस", "उनतीस",
    "तीस", "इकतीस", "बत्तीस", "तैंतीस", "चौंतीस", "पैंतीस", "छत्तीस", "सैंतीस", "अड़तीस", "उनतालीस",
    "चालीस", "इकतालीस", "बयालीस", "तैंतालीस", "चवालीस", "पैंतालीस", "छियालीस", "सैंतालीस", "अड़तालीस", "उनचास",
    "पचास", "इक्यावन", "बावन", "तिरपन", "चौवन", "पचपन", "छप्पन", "सत्तावन", "अट्ठावन", "उनसठ",
    "साठ", "इकसठ", "बासठ", "तिरसठ", "चौंसठ", "पैंसठ", "छियासठ", "सड़सठ", "अड़सठ", "उनहत्तर",
    "सत्तर", "इकहत्तर", "बहत्तर", "तिहत्तर", "चौहत्तर", "पचहत्तर", "छिहत्तर", "सतहत्तर", "अठहत्तर", "उन्यासी",
    "अस्सी", "इक्यासी", "बयासी", "तिरासी", "चौरासी", "पचासी", "छियासी", "सत्तासी", "अठासी", "नवासी",
    "नब्बे", "इक्यानवे", "बानवे", "तिरानवे", "चौरानवे", "पचानवे", "छियानवे", "सत्तानवे", "अठानवे", "निन्यानवे",
)
HINDI_SCALES = ((10**5, "लाख"), (10**3, "हजार"), (10**2, "सौ"))


def english(number: str, british: bool = False) -> list[str]:
    """Words of a whole number; British with "and" after hundreds. Beyond the billions, digit by digit."""
    n = int(number or "0")
    if n >= 10**12:
        return [ONES[int(d)] for d in str(n)]

    def below_thousand(n: int) -> list[str]:
        out = [ONES[n // 100], "hundred"] if n >= 100 else []
        rest = n % 100
        if out and rest and british:
            out.append("and")
        if rest >= 20:
            out.append(TENS[rest // 10])
            rest %= 10
        return out + ([ONES[rest]] if rest else [])

    out: list[str] = []
    for scale, word in SCALES:
        if n >= scale:
            out += [*below_thousand(n // scale), word]
            n %= scale
    return out + below_thousand(n) or [ONES[0]]


def english_decimal(number: str, british: bool = False) -> list[str]:
    """Words of a number whose fraction, if any, is read digit by digit."""
    whole, _, fraction = number.partition(".")
    return english(whole, british) + (["point", *(ONES[int(d)] for d in fraction)] if fraction else [])


def hindi(number: str) -> list[str]:
    """Hindi words of a whole number in Arabic or Devanagari digits; from a crore on, digit by digit."""
    n = int(number or "0")  # int() reads Devanagari digits too
    if n >= 10**7:
        return [HINDI[int(d)] for d in str(n)]
    out: list[str] = []
    for scale, word in HINDI_SCALES:
        if n >= scale:
            out += [HINDI[n // scale], word]
            n %= scale
    return out + ([HINDI[n]] if n else []) or [HINDI[0]]


SPELLERS: dict[str, Callable[[str], list[str]]] = {"en": english, "hi": hindi}


def numbers_in_words(text: str, language: str = "en") -> str:
    """Words that are whole numbers are spelled out; languages without a speller keep them."""
    spell = SPELLERS.get(language)
    return " ".join(" ".join(spell(w)) if spell and re.fullmatch(r"\d+", w) else w for w in text.split())


@functools.cache
def _speller(language: str) -> Callable[[Column], Column]:
    @F.pandas_udf("string")
    def spell(text):  # noqa: ANN001, ANN202  the kind of UDF follows from there being no annotations
        return text.map(lambda t: numbers_in_words(t, language), na_action="ignore")

    return spell


def digits_to_words(text: Column, language: str = "en") -> Column:
    """numbers_in_words() of a column; texts without a digit skip Python."""
    return F.when(~text.rlike(r"\p{Nd}"), text).otherwise(_speller(language)(text))
