"""Metrics of text pairs: edit-based rates, n-gram overlap and semantic alignment.

Pairs are scored in Arrow batches and only counts leave Python; Spark sums them up over any number of rows.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import align
from .metrics import long, ratio


def _distinct(refs: pa.Array, hyps: pa.Array) -> tuple[list[tuple[str, str]], pa.Array]:
    """The different pairs of a batch, and for each row the number of its pair."""
    places: dict[tuple[str, str], int] = {}
    at = [places.setdefault(pair, len(places)) for pair in zip(refs.to_pylist(), hyps.to_pylist())]
    return list(places), pa.array(at, pa.int64())


def scored(df: DataFrame, score: Callable[[str, str], Sequence[float]], names: Sequence[str], keep: Sequence[str] = ()) -> DataFrame:
    """`keep` columns and doubles `names` from score(reference, prediction) of every row; nulls count as empty texts. Equal pairs of a batch are scored once."""
    own = df.select(*keep, F.coalesce("reference", F.lit("")).alias("__r"), F.coalesce("prediction", F.lit("")).alias("__p"))
    n = len(keep)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            pairs, at = _distinct(batch.column(n), batch.column(n + 1))
            rows = [score(r, p) for r, p in pairs]
            values = [pa.array([float(row[i]) for row in rows], pa.float64()).take(at) for i in range(len(names))]
            yield pa.RecordBatch.from_arrays([*batch.columns[:n], *values], names=[*keep, *names])

    kinds = [f"{f.name} {f.dataType.simpleString()}" for f in own.schema.fields[:n]]
    return own.mapInArrow(run, ", ".join([*kinds, *(f"{x} double" for x in names)]))


def _edits(ref: str, hyp: str) -> tuple[float, ...]:
    r = ref.split()
    return (*align.edits(r, hyp.split()), len(r))


def wer(df: DataFrame) -> DataFrame:
    """Corpus word error rate with its substitutions, deletions and insertions."""
    rows = scored(df, _edits, ["s", "d", "i", "n"])
    s, d, i, n = (F.sum(c) for c in "sdin")
    return long(rows, wer=ratio(s + d + i, n), substitutions=s, deletions=d, insertions=i, ref_words=n)


def cer(df: DataFrame) -> DataFrame:
    """Corpus character error rate; stays in the JVM."""
    r, p = (F.coalesce(c, F.lit("")) for c in ("reference", "prediction"))
    return long(df, cer=ratio(F.sum(F.levenshtein(r, p)), F.sum(F.length(r))))


def asr_metric(df: DataFrame) -> DataFrame:
    """Rates of each utterance weighted by its length: the corpus rates, but for utterances without a reference."""
    rows = scored(df, lambda r, h: (*_edits(r, h), align.distance(r, h), len(r)), ["s", "d", "i", "n", "e", "c"])
    some, chars = F.col("n") > 0, F.col("c") > 0
    total = F.col("s") + F.col("d") + F.col("i")
    return long(rows, wer=ratio(F.sum(F.when(some, total).otherwise(0.0)), F.sum("n")), cer=ratio(F.sum(F.when(chars, F.col("e")).otherwise(0.0)), F.sum("c")), num_sentences=F.count("*"))


def bleu(df: DataFrame, max_order: int = 4, smooth: bool = True) -> DataFrame:
    """Corpus BLEU: clipped counts of each row are summed before the formula."""
    names = ["ref", "hyp", *(f"{x}{n}" for n in range(1, max_order + 1) for x in "mp")]
    rows = scored(df, lambda r, h: align.bleu_counts(r, h, max_order), names)
    sums = {n: F.coalesce(F.sum(n), F.lit(0.0)) for n in names}
    add = float(smooth)
    rates = [ratio(sums[f"m{n}"] + add, sums[f"p{n}"] + add) for n in range(1, max_order + 1)]
    mean_log = sum((F.ln(r) for r in rates[1:]), F.ln(rates[0])) / max_order
    brevity = F.when(sums["hyp"] > sums["ref"], 1.0).otherwise(F.exp(1 - F.try_divide(sums["ref"], sums["hyp"])))
    return long(rows, bleu=F.when((F.least(*rates, F.lit(1.0)) > 0) & (sums["hyp"] > 0), brevity * F.exp(mean_log)).otherwise(0.0), brevity_penalty=F.coalesce(brevity, F.lit(0.0)), length_ratio=ratio(sums["hyp"], sums["ref"]))


def rouge(df: DataFrame, use_stemmer: bool = True) -> DataFrame:
    rows = scored(df, lambda r, h: align.rouge(r, h, use_stemmer), ["rouge1", "rouge2", "rougeL"])
    return long(rows, **{n: F.avg(n) for n in ("rouge1", "rouge2", "rougeL")})


STATS = ("ref_words", "match", "substitution", "deletion", "insertion", "ref_chars", "char_errors")


def asr_semantic(df: DataFrame, language: str = "en", threshold: float = align.THRESHOLD) -> DataFrame:
    """Word and character error rates of the semantic alignment, to three places, with its counts."""
    own = _aligner(language, threshold)

    def score(ref: str, hyp: str) -> tuple[float, ...]:
        found = own().stats(ref, hyp)
        return tuple(found[n] for n in STATS)

    rows = scored(df, score, STATS)
    s = {n: F.sum(n) for n in STATS}
    rates = {"semantic_wer": ratio(s["substitution"] + s["deletion"] + s["insertion"], F.greatest(s["ref_words"], F.lit(1.0))), "semantic_cer": ratio(s["char_errors"], s["ref_chars"])}
    return long(rows, **{k: F.bround(v, 3) for k, v in rates.items()}, num_sentences=F.count("*"), total_ref_words=s["ref_words"])


def _aligner(language: str, threshold: float) -> Callable[[], align.Aligner]:
    """An aligner made once in each worker."""
    held: list[align.Aligner] = []

    def own() -> align.Aligner:
        if not held:
            held.append(align.Aligner(language, threshold))
        return held[0]

    return own


ALIGNMENT = "array<struct<ref_words: array<string>, hyp_words: array<string>, type: string, cer: double>>"


def alignments(df: DataFrame, language: str = "en", threshold: float = align.THRESHOLD) -> DataFrame:
    """(row_id, alignment): the links of each row in order."""
    make = _aligner(language, threshold)
    kind = pa.list_(pa.struct([("ref_words", pa.list_(pa.string())), ("hyp_words", pa.list_(pa.string())), ("type", pa.string()), ("cer", pa.float64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = make()
        for batch in batches:
            pairs, at = _distinct(batch.column(1), batch.column(2))
            out = []
            for ref, hyp in pairs:
                r, h = ref.split(), hyp.split()
                out.append([{"ref_words": r[slice(*x.ref)], "hyp_words": h[slice(*x.hyp)], "type": x.kind, "cer": x.rate} for x in own.align(ref, hyp)])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, kind).take(at)], names=["row_id", "alignment"])

    rows = df.select(F.col("row_id").cast("long"), F.coalesce("reference", F.lit("")).alias("r"), F.coalesce("prediction", F.lit("")).alias("p"))
    return rows.mapInArrow(run, f"row_id long, alignment {ALIGNMENT}")


def entity_wer(df: DataFrame, entities: str = "entities", language: str = "en") -> DataFrame:
    """The share of substituted or deleted ones among links whose reference words are a keyword of the whole table.

    entities: array<struct<text, category, offsets: array<struct<s, e>>>>. Keywords are the single words of all annotated
    parts; they meet the links in a semi-join, so that no set of keywords is collected.
    """
    part = lambda o: F.substring(F.col("reference"), o["s"] + 1, o["e"] - o["s"])
    own = F.flatten(F.transform(F.col(entities), lambda a: F.transform(a["offsets"], part)))
    words = df.select(F.explode(F.split(F.lower(F.array_join(own, " ")), r"\s+")).alias("word")).where("word <> ''").distinct()
    links = alignments(df, language).select(F.explode("alignment").alias("a")).select(F.lower(F.array_join("a.ref_words", " ")).alias("word"), F.col("a.type").alias("type"))
    hits = links.where("word <> ''").join(words, "word", "left_semi")
    return long(hits, entity_wer=F.bround(ratio(F.count_if(F.col("type").isin("substitution", "deletion")), F.count("*")), 3), keywords=F.count("*"))


def semantic_wer(df: DataFrame, using: align.Resources = align.Resources()) -> DataFrame:  # noqa: B008
    """Corpus word error rate after each pair's differing parts are brought into matching forms."""

    def score(ref: str, hyp: str) -> tuple[float, ...]:
        r, h = align.reconciled(ref, hyp, using)
        return _edits(r, h)

    rows = scored(df, score, ["s", "d", "i", "n"])
    return long(rows, semantic_wer=ratio(F.sum(F.col("s") + F.col("d") + F.col("i")), F.sum("n")))


def keyword_wer(df: DataFrame, keywords: Sequence[str], using: align.Resources = align.Resources()) -> DataFrame:  # noqa: B008
    """The share of keyword occurrences whose counterpart differs; keywords and texts are normalised alike."""
    wanted = sorted({align.normal_keyword(k, using) for k in keywords})

    def score(ref: str, hyp: str) -> tuple[float, float]:
        pairs = align.keyword_pairs(align.normal_keyword(ref, using), align.normal_keyword(hyp, using), wanted, using.mappings)
        return float(sum(a != b for a, b in pairs)), float(len(pairs))

    rows = scored(df, score, ["wrong", "n"])
    return long(rows, keyword_wer=ratio(F.sum("wrong"), F.sum("n")), keywords=F.sum("n"))


REGISTRY = {"wer": wer, "cer": cer, "asr_metric": asr_metric, "bleu": bleu, "rouge": rouge, "asr_semantic_metric": asr_semantic, "semantic_wer_metric": semantic_wer}
