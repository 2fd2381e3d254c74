"""Personal data by weak supervision, in DataFrame functions only.

1. Candidates: per kind, the strict base matches and looser look-alikes, with code point offsets.
2. Five labelers vote +1, -1 or 0 (abstain) on each candidate: its validity (checksums, ranges, numbering plans), a gazetteer
   (mail domains, card ranges, dialling codes, reserved address blocks), the context words in front of it, its shape, and its edges.
3. Expectation-maximisation over the counts of vote patterns estimates every labeler's reliability per
   kind. A kind has at most 3 ** labelers patterns of each size, so what comes to the driver has a fixed bound.
4. The posteriors train a logistic classifier of votes, share of digits and length, whose weights become literals of a column
   expression that scores every candidate span.

Base matches always stay; the classifier adds look-alikes it accepts where no base span of that kind is. Texts are searched
once: candidates are written to the shared folder and serve both the counts and the verdicts.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import written

KINDS = ("email", "ip", "card", "phone")
EXTRA_KINDS = ("secret",)
ALL_KINDS = KINDS + EXTRA_KINDS

# The base patterns, rewritten with possessive loops and a lookbehind so that Java neither recurses nor
# rescans a long run; \G lets a match begin where the last one ended. They match what the plain ones match.
BASE = {
    "email": r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:(?<![0-9])|\G)[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[ -]?[0-9])++",
    "phone": r"\+[0-9][ ().0-9-]+[0-9]",
}
#: Look-alikes: spelled-out addresses, national numbers, digit groups and secrets.
LOOSE = {
    "email": r"(?<![A-Za-z0-9._-])[A-Za-z0-9._-]++ ?[\[(] ?at ?[\])] ?[A-Za-z0-9-]++(?: ?[\[(] ?dot ?[\])] ?[A-Za-z]{2,}+|\.[A-Za-z]{2,}+)",
    "ip": r"(?<![0-9A-Fa-f:])(?:[0-9A-Fa-f]{1,4}+:){7}[0-9A-Fa-f]{1,4}+(?![0-9A-Fa-f:])",
    "card": r"(?<![0-9])[0-9]{4}[ .][0-9]{4}[ .][0-9]{4}[ .][0-9]{4}(?![0-9])",
    "phone": r"(?<![0-9+)(.-])(?:\([0-9]{3}\) ?|[0-9]{3}[-. ])[0-9]{3}[-. ][0-9]{4}(?![0-9])",
    "secret": r"(?<![A-Za-z0-9])(?=[A-Fa-f]*+[0-9])[A-Fa-f0-9]{32,}+(?![A-Za-z0-9])",
}
#: A text without these has no candidate of the pattern: (strict, loose) by kind.
NEEDS = {
    "email": ("@", r"[\[(] ?at ?[\])]"),
    "ip": (r"[0-9]\.[0-9]++\.[0-9]", r"[0-9A-Fa-f]:[0-9A-Fa-f]{1,4}+:[0-9A-Fa-f]"),
    "card": (r"[0-9](?:[ -]?[0-9]){12}", r"[0-9]{4}[ .][0-9]{4}[ .][0-9]{4}"),
    "phone": (r"\+[0-9]", r"[0-9]{3}\)? ?[-. ]?[0-9]{3}[-. ][0-9]{4}"),
    "secret": ("", r"[A-Fa-f0-9]{32}"),
}
#: A text without these has no candidate.
ANY = r"[0-9@]|[\[(] ?at ?[\])]|[A-Fa-f0-9]{32}"

# Fixed values of the gazetteer and context labelers.
MAIL_ENDINGS = ("com", "org", "net", "edu", "gov", "io", "de", "fr", "es", "uk", "info", "eu")
CARD_STARTS = r"^(?:4|5[1-5]|2[2-7]|3[47]|6011|65|35|30|36|38)"
DIAL_CODES = r"^\+(?:1|7|20|27|3[0-9]|4[0-9]|5[1-8]|6[0-6]|8[1246]|9[0-8])"
RESERVED_IP = r"^(?:0|127|22[4-9]|2[3-5][0-9])\.|^2001:0?[dD][bB]8:"
TOLL_FREE = "^8(?:00|33|44|55|66|77|88)"
SECRET_NAMES = r"(?i)(?:token|secret|api[_-]?key|passw(?:or)?d|pwd|auth|bearer|private[_ ]key)\W{0,6}$"
CONTEXT = {
    "email": r"(?i)(?:e-?mail|mailto|contact|write|reach)\W{0,8}\w{0,8}\W{0,4}$",
    "ip": r"(?i)(?:\bip\b|ipv[46]|host|server|addr(?:ess)?)\W{0,8}\w{0,8}\W{0,4}$",
    "card": r"(?i)(?:card|visa|mastercard|amex|credit|debit|karte|carte|tarjeta)\W{0,8}\w{0,8}\W{0,4}$",
    "phone": r"(?i)(?:phone|call|tel|mobile|fax|cell|whatsapp|telefon|teléfono|téléphone)\W{0,8}\w{0,8}\W{0,4}$",
    "secret": SECRET_NAMES,
}
#: Words before a number that speak against personal data.
AGAINST = r"(?i)(?:version|isbn|order|invoice|page|chapter|build|figure|sha|commit|checksum|md5)\W{0,8}$"
LABELERS = ("validity", "gazetteer", "context", "shape", "edges")
BEFORE = 32
ROUNDS = 40
#: Bounds of the estimated share of true candidates, and of a labeler's reliability: a checksum or numbering plan is no guess.
SHARE, LEAST, MOST = (0.02, 0.98), {"validity": 0.85, "gazetteer": 0.01, "context": 0.01, "shape": 0.01, "edges": 0.01}, 0.99
#: Candidates, half of them true, that stand for what is believed of the share.
EVEN = 20
#: How often each labeler is believed to be right before any vote is seen, and the number of votes that this belief counts as.
BELIEF = {"validity": 0.95, "gazetteer": 0.7, "context": 0.8, "shape": 0.7, "edges": 0.7}
BELIEVED = {"validity": 100, "gazetteer": 10, "context": 10, "shape": 10, "edges": 10}
#: Upper lengths of the classes of size but the last.
SIZES = (12, 16, 20, 40)


def digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def luhn(number: Column) -> Column:
    """Whether a string of digits passes the Luhn test."""

    def add(total: Column, i: Column) -> Column:
        d = F.substring(number, F.length(number) - i, F.lit(1)).cast("int") * F.when(i % 2 == 1, 2).otherwise(1)
        return total + F.when(d > 9, d - 9).otherwise(d)

    return F.aggregate(F.sequence(F.lit(0), F.length(number) - 1), F.lit(0), add) % 10 == 0


def valid(kind: str, value: Column) -> Column:
    if kind == "email":
        return F.lit(True)
    if kind == "ip":
        part = "0*(?:[0-9]{1,2}|1[0-9]{2}|2[0-4][0-9]|25[0-5])"
        return value.rlike(rf"^{part}\.{part}\.{part}\.{part}$")
    n = F.length(digits(value))
    if kind == "card":
        return F.when(n.between(14, 19), luhn(digits(value))).otherwise(False)
    return n.between(10, 15)


def found(text: Column, pattern: str, keep=lambda value: F.lit(True)) -> Column:
    """array<struct<start, stop, value>> of the leftmost non-overlapping matches that `keep` takes, in code points.

    The gaps between matches come from split() and the matches from regexp_extract_all(); running sums of
    their lengths are the offsets, so that the cost is that of two scans. The last gap has no match.
    """

    def step(acc: Column, x: Column) -> Column:
        start = acc["at"] + F.length(x["gap"])
        stop = start + F.length(x["value"])
        span = F.array(F.struct(start.alias("start"), stop.alias("stop"), x["value"].alias("value")))
        spans = F.when(x["value"].isNotNull() & keep(x["value"]), F.concat(acc["spans"], span)).otherwise(acc["spans"])
        return F.struct(F.coalesce(stop, acc["at"]).alias("at"), spans.alias("spans"))

    pairs = F.zip_with(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), F.split(text, pattern, -1), lambda v, g: F.struct(v.alias("value"), g.alias("gap")))
    empty = F.struct(F.lit(0).alias("at"), F.expr("cast(array() as array<struct<start: int, stop: int, value: string>>)").alias("spans"))
    return F.aggregate(pairs, empty, step, lambda acc: acc["spans"])


def votes(kind: str, loose: bool, value: Column, before: Column, after: Column) -> dict[str, Column]:
    """Of each labeler: 1 for, -1 against, 0 no opinion."""
    none = F.lit(False)
    vote = lambda yes, no=none: F.when(yes, 1).when(no, -1).otherwise(0)
    number = digits(value)
    if loose:
        sound = {
            "email": value.rlike(r"^[A-Za-z0-9]") & ~value.rlike(r"\.\.|--"),
            "ip": value.rlike(r"^(?:[23]...|[fF][cdCDeE]..):"),
            "card": luhn(number),
            "phone": number.rlike("^[2-9]..[2-9]"),
            "secret": F.length(value).isin(32, 40, 48, 56, 64, 96, 128),
        }[kind]
    else:
        sound = valid(kind, value)
    gazetteer = {
        "email": vote(F.lower(F.regexp_extract(value, "([A-Za-z]+)[^A-Za-z]*$", 1)).isin(*MAIL_ENDINGS)),
        "ip": vote(none, value.rlike(RESERVED_IP)),
        "card": vote(number.rlike(CARD_STARTS)),
        "phone": vote(value.rlike(DIAL_CODES)) if not loose else vote(number.rlike(TOLL_FREE)),
        "secret": vote(none, F.regexp_replace(value, F.substring(value, 1, 1), "") == ""),
    }[kind]
    kinds_of = F.size(F.array_distinct(F.split(value, "")))
    shape = {
        "email": vote(value.rlike("^[^@(\\[]*[A-Za-z]"), value.rlike(r"^[0-9._%+-]+ ?[@(\[]|\.\.")),
        "ip": vote(value.rlike(r"[0-9]{2}") & ~value.rlike(r"(?:^|\.)0[0-9]"), value.rlike(r"(?:^|\.)0[0-9]|^[0-9](?:\.[0-9]){3}$")),
        "card": vote(value.rlike(r"^[0-9]{15,16}$|^[0-9]{4}([ .-])[0-9]{4}\1[0-9]{4}\1[0-9]{4}$|^[0-9]{4}([ -])[0-9]{6}\2[0-9]{5}$"), value.rlike("[ ].*-|-.*[ ]|[ -][0-9]{1,2}[ -]")),
        "phone": vote(value.rlike(r"[0-9][ ().-]+[0-9]+[ ().-]+[0-9]"), value.rlike(r"[ ().-]{3}|[0-9]{13}")),
        "secret": vote((kinds_of >= 9) & value.rlike("[A-Fa-f]"), (kinds_of < 6) | ~value.rlike("[A-Fa-f]")),
    }[kind]
    edges = vote(before.rlike(r"(?:^|[\s(\[{<\"'`:=,;])$") & after.rlike(r"^(?:$|[\s)\]}>\"'`,;!?]|[.:](?:\s|$))"), before.rlike(r"[\w/#$.+-]$") | after.rlike(r"^[\w/@%+-]"))
    return {"validity": vote(sound, ~sound), "gazetteer": gazetteer, "context": vote(before.rlike(CONTEXT[kind]), before.rlike(AGAINST)), "shape": shape, "edges": edges}


def _candidate(text: Column, kind: str, loose: bool):
    """What is kept of a match. `size` has its share of digits, in tenths, and its class of length."""

    def struct(x: Column) -> Column:
        before = F.substring(text, F.greatest(x["start"] - BEFORE, F.lit(0)) + 1, F.least(x["start"], F.lit(BEFORE)))
        after = F.substring(text, x["stop"] + 1, F.lit(2))
        base = F.lit(False) if loose else valid(kind, x["value"])
        long = F.length(x["value"])
        share = F.floor(F.lit(10) * F.length(digits(x["value"])) / F.greatest(long, F.lit(1))).cast("int")
        length = sum(((long > n).cast("int") for n in SIZES[1:]), (long > SIZES[0]).cast("int"))
        own = [v.cast("int").alias(n) for n, v in votes(kind, loose, x["value"], before, after).items()]
        return F.struct(x["start"].alias("start"), x["stop"].alias("stop"), F.lit(ALL_KINDS.index(kind)).alias("kind"), base.alias("base"), *own, (share + 11 * length).alias("size"))

    return struct


CANDIDATES = f"array<struct<start: int, stop: int, kind: int, base: boolean, {', '.join(f'{n}: int' for n in LABELERS)}, size: int>>"


def candidates(text: Column) -> Column:
    """CANDIDATES of one text, all kinds. Texts are searched for a pattern only if they have what it needs."""
    own, none = [], F.expr(f"cast(array() as {CANDIDATES})")
    for loose, patterns in ((False, BASE), (True, LOOSE)):
        for kind, pattern in patterns.items():
            # short runs of digits are no candidates for a card
            long = (lambda v: F.length(digits(v)).between(13, 19)) if kind == "card" else (lambda v: F.lit(True))
            own.append(F.when(text.rlike(NEEDS[kind][loose]), F.transform(found(text, pattern, long), _candidate(text, kind, loose))).otherwise(none))
    return F.when(text.rlike(ANY), F.concat(*own)).otherwise(none)


@dataclass(frozen=True)
class Model:
    """Log-odds weights by kind: bias, votes for and against of each labeler, share of digits and length; and what EM estimated."""

    weights: dict[int, tuple[float, ...]]
    reliability: dict[int, dict[str, tuple[float, float]]]
    share: dict[int, float]


def _features(pattern: Sequence[int], size: int) -> list[float]:
    return [1.0, *(x for v in pattern for x in (float(v > 0), float(v < 0))), size % 11 / 10 - 0.5, size // 11 / len(SIZES) - 0.5]


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -50, 50)))


def train(patterns: list[tuple[int, tuple[int, ...], int, int]], rounds: int = ROUNDS, belief: float = 1.0) -> Model:
    """EM on (kind, votes, size, count) rows, then a logistic classifier fitted to the posteriors.

    A labeler is right with one probability on true candidates and another on false ones; an abstention says nothing. Each is
    estimated from its own expected votes and from BELIEVED votes of what is believed beforehand, so that any larger
    number of votes has the say. Validity names the classes; a labeler that votes alike on both is estimated to tell nothing,
    and none is taken to be worse than that.
    """
    weights, reliability, share = {}, {}, {}
    for kind in sorted({p[0] for p in patterns}):
        own = [p for p in patterns if p[0] == kind]
        cast, n = np.array([p[1] for p in own], float), np.array([p[3] for p in own], float)
        names = LABELERS[: cast.shape[1]]
        yes, no = (cast > 0).astype(float), (cast < 0).astype(float)
        believed = np.array([BELIEF[x] for x in names])
        right = np.stack([believed, believed])  # of a vote, given a true and a false candidate
        least = np.array([LEAST[x] for x in names])
        weight, prior = 5 + belief * np.array([BELIEVED[x] for x in names]), 0.5
        for _ in range(rounds):
            odds = np.log(prior / (1 - prior)) + yes @ (np.log(right[0]) - np.log(1 - right[1])) + no @ (np.log(1 - right[0]) - np.log(right[1]))
            post = _sigmoid(odds)
            prior = float(np.clip((post @ n + 0.5 * belief * EVEN) / (n.sum() + belief * EVEN), *SHARE))
            for side, (q, agreed) in enumerate(((post * n, yes), ((1 - post) * n, no))):
                right[side] = np.clip((q @ agreed + believed * weight) / (q @ (yes + no) + weight), least, MOST)
            right[1] = np.maximum(right[1], 1 - right[0])
        x, total = np.array([_features(p[1], p[2]) for p in own]), n.sum()
        w = np.zeros(x.shape[1])
        for _ in range(50):  # Newton steps with a little shrinkage
            p = _sigmoid(x @ w)
            hessian = (x * (p * (1 - p) * n)[:, None]).T @ x / total + 0.002 * np.eye(len(w))
            w = w - np.linalg.solve(hessian, x.T @ ((p - post) * n) / total + 0.002 * w)
        weights[kind], reliability[kind], share[kind] = tuple(map(float, w)), {x: (float(a), float(b)) for x, a, b in zip(names, *right)}, prior
    return Model(weights, reliability, share)


def told_apart(c: Column) -> Column:
    """Candidates without the look-alikes that overlap a base span of their kind."""
    base = F.filter(c, lambda b: b["base"])
    return F.filter(c, lambda x: x["base"] | ~F.exists(base, lambda b: (b["kind"] == x["kind"]) & (b["start"] < x["stop"]) & (x["start"] < b["stop"])))


def learned(found: DataFrame, column: str = "c") -> Model:
    """The model for a table of candidates: their vote patterns are counted over all rows and only the counts are collected."""
    own = found.select(F.explode(column).alias("c"))
    rows = own.groupBy("c.kind", *(f"c.{n}" for n in LABELERS), "c.size").count().collect()
    return train(sorted((r[0], tuple(r[1 : 1 + len(LABELERS)]), r[-2], r[-1]) for r in rows))


def learn(docs: DataFrame, text_col: str = "text") -> Model:
    """The model for a table of texts."""
    return learned(docs.select(candidates(F.coalesce(F.col(f"`{text_col}`"), F.lit(""))).alias("c")).select(told_apart(F.col("c")).alias("c")))


def accepted(model: Model, c: Column) -> Column:
    """Whether the classifier takes the candidate for personal data."""
    out = F.lit(False)
    for kind, w in sorted(model.weights.items()):
        odds = F.lit(w[0])
        for i, name in enumerate(LABELERS):
            odds = odds + F.when(c[name] > 0, w[1 + 2 * i]).when(c[name] < 0, w[2 + 2 * i]).otherwise(0.0)
        odds = odds + F.lit(w[-2]) * (c["size"] % 11 / 10 - 0.5) + F.lit(w[-1]) * (F.floor(c["size"] / 11) / len(SIZES) - 0.5)
        out = F.when(c["kind"] == kind, odds > 0).otherwise(out)
    return out


def detect(docs: DataFrame, model: Model | None = None, text_col: str = "text", carried: Sequence[str] | None = None) -> DataFrame:
    """`docs`' columns, all or those carried, with `pii_base` and `pii_spans`: array<struct<start, rank, stop>> in order; rank is the kind's place in ALL_KINDS.

    Null and empty texts have no spans; very long ones are searched whole. Rows, repeated ones too, are kept as they are, and an empty
    table stays empty. Of spans that begin at one place the kind listed first comes first. A column of `docs` that is called pii_base or
    pii_spans gives way; other names don't matter. There is no shuffle besides the counts of vote patterns.
    """
    kept = [c for c in (docs.columns if carried is None else carried) if c not in ("pii_base", "pii_spans")]
    row = F.struct(F.lit(0).alias("none"), *(F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(kept)))
    own = docs.select(row.alias("row"), candidates(F.coalesce(F.col(f"`{text_col}`"), F.lit(""))).alias("c"))
    if model is None:
        own = written(own, "candidates")
    own = own.withColumn("c", told_apart(F.col("c")))
    model = model or learned(own)
    span = lambda c: F.struct(c["start"].alias("start"), c["kind"].alias("rank"), c["stop"].alias("stop"))
    own = own.withColumn("base", F.array_sort(F.transform(F.filter("c", lambda c: c["base"]), span)))
    more = F.filter("c", lambda c: ~c["base"] & accepted(model, c))
    spans = F.array_sort(F.array_distinct(F.concat("base", F.transform(more, span))))
    return own.select(*(F.col(f"row.c{i}").alias(c) for i, c in enumerate(kept)), F.col("base").alias("pii_base"), spans.alias("pii_spans"))


def redacted(text: Column, spans: Column) -> Column:
    """The text with every span replaced by its kind in angle brackets; a span that begins within another is part of it."""
    name = lambda rank: F.element_at(F.array(*(F.lit(f"<{k.upper()}>") for k in ALL_KINDS)), rank + 1)

    def step(acc: Column, s: Column) -> Column:
        free = s["start"] >= acc["at"]
        return F.struct(
            F.greatest(acc["at"], s["stop"]).alias("at"),
            F.when(free, F.concat(acc["out"], F.substring(text, acc["at"] + 1, s["start"] - acc["at"]), name(s["rank"]))).otherwise(acc["out"]).alias("out"),
        )

    begin = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))
    out = F.aggregate(spans, begin, step, lambda acc: F.concat(acc["out"], F.substring(text, acc["at"] + 1, F.length(text))))
    return F.when(F.size(spans) > 0, out).otherwise(text)


def listed(spans: Column) -> Column:
    name = lambda rank: F.element_at(F.array(*map(F.lit, ALL_KINDS)), rank + 1)
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", name(s["rank"]), s["start"], s["stop"])), ",")


def digest(found: DataFrame) -> DataFrame:
    number = lambda k: F.size(F.filter("pii_base", lambda s: s["rank"] == KINDS.index(k))).cast("long").alias(f"n_{k}")
    return found.select(F.col("doc_id"), *map(number, KINDS), F.sha2(listed(F.col("pii_base")).cast("binary"), 256).alias("base_sha256"), listed(F.col("pii_spans")).alias("spans"), F.size("pii_spans").cast("long").alias("n_spans"))
