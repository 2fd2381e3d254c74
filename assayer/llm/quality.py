"""Quality rules with risk-controlled thresholds.

A rule rejects a document whose feature exceeds a cutoff. Cutoffs are chosen per stratum from labelled documents so that,
with confidence 1 - DELTA over all strata together, all rules of a stratum together reject no more than ALPHA of its good documents:

- every rule has a grid of cutoffs from lenient to strict, fixed beforehand;
- a part of the labelled texts proposes: steps (rule, cutoff) are added one by one, each the one that rejects most bad documents
  beyond those already rejected, net of GOOD_WEIGHT times the good ones. Its rows don't count below;
- the other part, the holdout, tests the sequence: after each step the number of good documents that the steps so far reject gives a
  Clopper-Pearson (exact binomial) upper bound of their true false-rejection rate. Testing stops at the first step whose bound exceeds
  ALPHA (fixed-sequence testing, which needs no correction within the sequence);
- the level of each sequence is DELTA divided by the number of strata (Bonferroni).

Of the certified lengths the one that rejects most bad documents of the holdout, net of the good ones, is used. Equal texts are
one trial, whatever their number. Strata are handled as rows of a table, so that there may be any number of them.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import arrow_map, as_bytes, cut, on_workers

ALPHA, DELTA = 0.02, 0.05
#: A rejected good document outweighs so many rejected bad ones.
GOOD_WEIGHT = 10
#: One in so many labelled texts proposes cutoffs; all others are its stratum's holdout.
PROPOSING = 3
#: Cutoffs that a sequence goes to, at most.
STEPS = 24
#: Limits of so many strata are broadcast; more are joined by a shuffle.
SENT = 50_000
WINDOW = 8
MIN_WORDS, MOST_REPEATED = 20, 0.30
SYMBOLS = b"#*$%&|<>"


@dataclass(frozen=True)
class Rule:
    """Rejects if `feature` is above a cutoff; the grid runs from lenient to strict."""

    name: str
    feature: str
    grid: tuple[float, ...]


def _grid(high: float, low: float, steps: int = 24) -> tuple[float, ...]:
    return tuple(round(high - (high - low) * i / (steps - 1), 6) for i in range(steps))


RULES = (
    Rule("symbols", "symbol_ratio", _grid(3.0, 0.02)),
    Rule("capitals", "upper_ratio", _grid(0.98, 0.10)),
    Rule("exclamations", "exclaim_ratio", _grid(2.0, 0.05)),
    Rule("repeated words", "repeat_ratio", _grid(0.98, 0.04)),
    Rule("repeated lines", "dup_line_ratio", _grid(0.98, 0.04)),
    Rule("few distinct words", "same_word_ratio", _grid(0.98, 0.30)),
    Rule("long words", "word_length", _grid(40.0, 8.0)),
)

COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_upper", "n_exclaim", "n_distinct", "n_lines")


def repeated_words(words: list[bytes], width: int = WINDOW) -> int:
    """Words in windows of `width` that are found twice or more, the first included."""
    n = len(words) - width + 1
    if n < 2:
        return 0
    own = np.fromiter(map(hash, words), np.int64, len(words)).view(np.uint64)
    rolled = np.zeros(n, np.uint64)
    for i in range(width):
        rolled = rolled * np.uint64(0x9E3779B97F4A7C15) + own[i : i + n]
    ordered = np.sort(rolled)
    twice = ordered[1:][ordered[1:] == ordered[:-1]]
    if not len(twice):
        return 0
    starts = np.flatnonzero(np.isin(rolled, twice)).tolist()  # all that can be equal; equality itself is tested
    windows = [tuple(words[i : i + width]) for i in starts]
    times: dict[tuple[bytes, ...], int] = {}
    for x in windows:
        times[x] = times.get(x, 0) + 1
    total, covered = 0, 0
    for i, x in zip(starts, windows):
        if times[x] > 1:
            total += i + width - max(i, covered)
            covered = i + width
    return total


def counts(text: bytes) -> tuple[int, ...]:
    """The values of COUNTS for a UTF-8 text."""
    words = text.split()  # ASCII white space only
    joined = b"".join(words)
    lines = [line for line in text.split(b"\n") if line.strip()]
    return (
        len(words),
        len(joined.decode()),
        len(text) - len(text.translate(None, SYMBOLS)),
        len(lines) - len(set(lines)),
        repeated_words(words),
        sum(map(str.isupper, joined.decode())) if not joined.isascii() else len(joined) - len(joined.translate(None, b"ABCDEFGHIJKLMNOPQRSTUVWXYZ")),
        text.count(b"!"),
        len(set(words)),
        len(lines),
    )


def measure(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", stratum_col: str | None = "lang", carried: tuple[str, ...] = ()) -> DataFrame:
    """(doc_id, stratum, digest, *COUNTS, *carried), one row for each row of `docs`; null texts count as empty and null strata are one of their own."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        made = list(zip(*map(counts, as_bytes(batch.column(3))))) or [[]] * len(COUNTS)
        return pa.RecordBatch.from_arrays([*batch.columns[:3], *(pa.array(x, pa.int64()) for x in made), *batch.columns[4:]], names=names)

    on_workers(docs.sparkSession)
    stratum = F.coalesce(F.col(f"`{stratum_col}`").cast("string"), F.lit("")) if stratum_col else F.lit("")
    text = F.col(f"`{text_col}`")
    more = [F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(carried)]
    names = ["doc_id", "stratum", "digest", *COUNTS, *(f"c{i}" for i in range(len(carried)))]
    own = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), stratum.alias("stratum"), F.xxhash64(F.coalesce(text, F.lit(""))).alias("digest"), text.alias("text"), *more)
    kinds = [f"{x} {t}" for x, t in docs.select(*more).dtypes]
    return own.mapInArrow(arrow_map(run, 3), ", ".join(["doc_id long", "stratum string", "digest long", *(f"{x} long" for x in COUNTS), *kinds]))


def feature(name: str) -> Column:
    words, chars = F.greatest("n_words", F.lit(1)), F.greatest("word_chars", F.lit(1))
    return {
        "symbol_ratio": F.col("n_symbols") / words,
        "upper_ratio": F.col("n_upper") / chars,
        "exclaim_ratio": F.col("n_exclaim") / words,
        "repeat_ratio": F.col("n_repeat_words") / words,
        "dup_line_ratio": F.col("n_dup_lines") / F.greatest("n_lines", F.lit(1)),
        "same_word_ratio": 1 - F.col("n_distinct") / words,
        "word_length": F.col("word_chars") / words,
    }[name]


def base_failed() -> Column:
    return (F.col("n_words") < MIN_WORDS) | (F.lit(100) * F.col("n_repeat_words") > F.lit(round(100 * MOST_REPEATED)) * F.col("n_words"))


def binomial_cdf(k: int, n: int, p: float) -> float:
    """P(X <= k) for X ~ Binomial(n, p), summed from the log of each term."""
    if p <= 0 or k >= n:
        return 1.0
    if p >= 1:
        return 0.0
    i = np.arange(k, dtype=np.float64)
    terms = n * math.log1p(-p) + np.concatenate([[0.0], np.cumsum(np.log((n - i) / (i + 1)) + math.log(p) - math.log1p(-p))])
    top = terms.max()
    return float(min(1.0, math.exp(min(0.0, top + math.log(np.exp(terms - top).sum())))))


def upper_bound(k: int, n: int, level: float) -> float:
    """The Clopper-Pearson upper bound at confidence 1 - level: the rate at which at most k of n has probability `level`."""
    if n == 0 or k >= n:
        return 1.0
    low, high = k / n, 1.0
    for _ in range(50):
        mid = (low + high) / 2
        low, high = (mid, high) if binomial_cdf(k, n, mid) > level else (low, mid)
    return high


def certified(good: list[int], bad: list[int], n_good: int, level: float, alpha: float = ALPHA) -> int | None:
    """The index of the cutoff to use, given the good and bad documents that each cutoff rejects; None: no rule."""
    best, gain = None, 0
    for i, (g, b) in enumerate(zip(good, bad)):
        if binomial_cdf(g, n_good, alpha) > level or n_good == 0:  # the bound is above alpha
            break
        if b - GOOD_WEIGHT * g > gain:
            best, gain = i, b - GOOD_WEIGHT * g
    return best


def proposed(values: np.ndarray, good: np.ndarray, rules: tuple[Rule, ...] = RULES, steps: int = STEPS) -> list[tuple[int, float]]:
    """The sequence of steps (rule, cutoff) for documents with feature values [document, rule].

    Of equal steps the one that rejects fewer good documents comes first, then the earlier rule and the more lenient cutoff. On the way
    to a cutoff, the rule's more lenient ones that reject less are steps too, so that testing can stop between. A step never
    loosens a rule: the documents rejected grow along the sequence.
    """
    out: list[tuple[int, float]] = []
    left = np.ones(len(values), bool)
    for _ in range(steps):
        counted = []
        for i, rule in enumerate(rules):
            place = len(rule.grid) - np.searchsorted(np.array(rule.grid[::-1]), values[left, i], side="left")  # the first cutoff below the value
            counted.append([np.bincount(place[good[left] == x], minlength=len(rule.grid) + 1) for x in (True, False)])
        best = best_step([g for g, _ in counted], [b for _, b in counted], rules)
        if best is None:
            break
        out += [(best[0], rules[best[0]].grid[j]) for j in best[1]]
        left &= values[:, out[-1][0]] <= out[-1][1]
    return out


def best_step(good: list[np.ndarray], bad: list[np.ndarray], rules: tuple[Rule, ...] = RULES) -> tuple[int, list[int]] | None:
    """The rule and the numbers of its cutoffs on the way to the best one, given the documents left by rule and by the first cutoff that rejects them."""
    best = None
    for i, rule in enumerate(rules):
        n = len(rule.grid)
        count = good[i][:n] + bad[i][:n]  # documents that a cutoff rejects beyond the more lenient ones
        lost = np.cumsum(good[i][:n])
        gains = np.cumsum(bad[i][:n]) - GOOD_WEIGHT * lost
        at = int(np.lexsort((np.arange(n), lost, -gains))[0])
        if gains[at] > 0 and (best is None or (gains[at], -lost[at]) > best[0]):
            best = (gains[at], -lost[at]), i, [j for j in range(at + 1) if count[j]]
    return best and best[1:]


def sequences(few: DataFrame, n_strata: int, rules: tuple[Rule, ...] = RULES, steps: int = STEPS) -> DataFrame:
    """(stratum, rule, cutoff): what proposed() gives for each stratum's rows (stratum, quality, values), however many they are.

    Rows that the same cutoffs reject are counted together; for each step, the counts by stratum, rule and cutoff are summed over all
    tasks, so that a task sees a histogram of a stratum and never its rows.
    """

    def first(i: int, rule: Rule) -> Column:
        return F.size(F.filter(F.array(*map(F.lit, rule.grid)), lambda cutoff: F.get(F.col("values"), F.lit(i)) <= cutoff))

    def choose(stratum, part):  # noqa: ANN001, ANN202
        good, bad = ([np.zeros(len(r.grid) + 1, np.int64) for r in rules] for _ in range(2))
        for i, at, g, b in zip(part["i"], part["place"], part["good"], part["bad"]):
            good[i][at] += g
            bad[i][at] += b
        best = best_step(good, bad, rules)
        i, places = best or (-1, [])
        return _frame(stratum[0], step=i, place=places[-1] if best else -1, rules=[i] * len(places), cutoffs=[rules[i].grid[j] for j in places])

    def sent(strata: DataFrame) -> DataFrame:
        return F.broadcast(strata) if n_strata <= SENT else strata

    rejected = F.array(*(first(i, r) for i, r in enumerate(rules))).alias("first")
    kinds = few.select("stratum", rejected, (F.col("quality") > 0).alias("own")).groupBy("stratum", "first").agg(F.count_if("own").alias("good"), F.count_if(~F.col("own")).alias("bad"))
    kinds = cut(kinds.where(F.exists(F.arrays_zip("first", F.array(*(F.lit(len(r.grid)) for r in rules)).alias("n")), lambda x: x["first"] < x["n"])))
    none = [F.array().cast(t).alias(c) for c, t in (("rule", "array<int>"), ("cutoff", "array<double>"))]
    state = cut(kinds.select("stratum").distinct().select("stratum", F.array_repeat(F.lit(-1), len(rules)).alias("at"), *none, F.lit(True).alias("open")))
    on_workers(few.sparkSession)
    for _ in range(steps):
        left = kinds.join(sent(state.where("open").select("stratum", "at")), "stratum").where(F.forall(F.arrays_zip("first", "at"), lambda x: x["first"] > x["at"]))
        cells = left.select("stratum", "good", "bad", F.posexplode("first").alias("i", "place")).groupBy("stratum", "i", "place").agg(F.sum("good").alias("good"), F.sum("bad").alias("bad"))
        found = cells.groupBy("stratum").applyInPandas(choose, "stratum string, step int, place int, rules array<int>, cutoffs array<double>").where("step >= 0")
        at = F.transform("at", lambda x, i: F.when(i == F.col("step"), F.col("place")).otherwise(x)).alias("at")
        more = [F.when(F.col("step").isNull(), F.col(c)).otherwise(F.concat(c, f"{c}s")).alias(c) for c in ("rule", "cutoff")]
        state = cut(state.join(sent(found), "stratum", "left").select("stratum", at, *more, F.col("step").isNotNull().alias("open")))
        if state.where("open").isEmpty():
            break
    return state.where(F.size("rule") > 0).select("stratum", "rule", "cutoff")


def tested(steps: list[tuple[int, float]], good: list[int], bad: list[int], n_good: int, level: float, alpha: float = ALPHA, width: int = len(RULES)) -> list[float | None]:
    """The limit of each rule, given the good and bad holdout documents that the first 1, 2, ... steps reject."""
    limits: list[float | None] = [None] * width
    at = certified(good, bad, n_good, level, alpha)
    for rule, cutoff in steps[: at + 1] if at is not None else ():
        limits[rule] = cutoff if limits[rule] is None else min(limits[rule], cutoff)
    return limits


def _joined(rows: DataFrame, strata: DataFrame, how: str) -> DataFrame:
    """By stratum; strata are a checkpointed table of one row each, broadcast if there are few."""
    return rows.join(F.broadcast(strata) if strata.count() <= SENT else strata, "stratum", how)


def calibrate(measured: DataFrame, labels: DataFrame, rules: tuple[Rule, ...] = RULES, alpha: float = ALPHA, delta: float = DELTA) -> DataFrame:
    """(stratum, limits): each rule's cutoff (null: none) in the strata that have any, from labels (doc_id, quality 0 or 1).

    Documents that fail the base rules don't count, as they go anyway. Null qualities or ids are left out; where labels of a text
    differ, the lowest counts. All texts that propose and all others count; what meets in a task is histograms of a stratum. The driver reads counts.
    """
    known = labels.where("doc_id is not null and quality is not null").groupBy("doc_id").agg(F.min("quality").alias("quality"))
    values = F.array(*(feature(r.feature) for r in rules)).alias("values")
    rows = measured.where(~base_failed()).select("doc_id", "stratum", "digest", values).join(known, "doc_id")
    trials = cut(rows.groupBy("stratum", "digest").agg(F.min("quality").alias("quality"), F.min("values").alias("values")))
    n_strata = trials.select("stratum").distinct().count()
    proposes = F.pmod(F.xxhash64(F.lit(7), "digest"), F.lit(PROPOSING)) == 0
    found = sequences(trials.where(proposes), n_strata, rules)
    held = _joined(trials.where(~proposes), found, "inner")
    rejects = F.transform(F.arrays_zip("rule", "cutoff"), lambda s: F.get(F.col("values"), s["rule"]) > s["cutoff"])
    step = F.array_position(rejects, True)  # the first that rejects the document; 0: none
    tall = held.groupBy("stratum", (F.col("quality") > 0).alias("good"), step.alias("step")).agg(F.count("*").alias("n"), F.first("rule").alias("rule"), F.first("cutoff").alias("cutoff"))

    def test(stratum, part):  # noqa: ANN001, ANN202
        steps = list(zip(map(int, part["rule"].iloc[0]), map(float, part["cutoff"].iloc[0])))
        seen = np.zeros((2, len(steps) + 1), np.int64)
        for good, at, n in zip(part["good"], part["step"], part["n"]):
            seen[int(good), int(at)] += n
        bad, good = np.cumsum(seen[:, 1:], axis=1).tolist()
        return _frame(stratum[0], limits=tested(steps, good, bad, int(seen[1].sum()), delta / max(1, n_strata), alpha, len(rules)))

    on_workers(measured.sparkSession)
    limits = tall.groupBy("stratum").applyInPandas(test, "stratum string, limits array<double>")
    return cut(limits.where(F.exists("limits", lambda x: x.isNotNull())))


def _frame(stratum: str, **columns: list):
    import pandas as pd

    return pd.DataFrame({"stratum": [stratum], **{k: [v] for k, v in columns.items()}})


def passes(rules: tuple[Rule, ...] = RULES) -> Column:
    """Whether a measured row with its stratum's `limits` (null: none) passes the base rules and them."""
    ok = ~base_failed()
    for i, rule in enumerate(rules):
        ok = ok & F.coalesce(feature(rule.feature) <= F.get("limits", F.lit(i)), F.lit(True))
    return ok


def judge(docs: DataFrame, labels: DataFrame, stratum_col: str | None = "lang", id_col: str = "doc_id", text_col: str = "text", carried: tuple[str, ...] = ()) -> DataFrame:
    """(doc_id, stratum, *COUNTS, base_failed, kept, *carried): one row for each row of `docs`, with the columns of it that are carried.

    Texts are read once, whole however long; the counts are checkpointed and serve calibration and verdict alike. Null texts count as
    empty, a null stratum is one of its own, and a null id has no label. Empty labels certify nothing, so that only the base rules
    reject. Repeated rows get a row each and are one trial. Ties between steps are settled in proposed(). An empty table gives an
    empty result. Columns that aren't carried are not read; a carried one must not have the name of another result column.
    """
    measured = cut(measure(docs, id_col, text_col, stratum_col, carried))
    limits = calibrate(measured, labels)
    own = _joined(measured, limits, "left")
    return own.select("doc_id", "stratum", *COUNTS, base_failed().alias("base_failed"), passes().alias("kept"), *(F.col(f"c{i}").alias(c) for i, c in enumerate(carried)))


def digest(judged: DataFrame) -> DataFrame:
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")
