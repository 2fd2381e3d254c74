"""Toxic spans by a linear-chain conditional random field.

Token labels come from document labels: a word is a marker if it is found in toxic training texts far more
often than in clean ones, counted over all labelled training texts; markers in toxic texts are labelled 1,
everything else 0. The chain's features are a token's identity and strength where it is a marker, the strength of its two neighbours, the
tags' transitions and a bias; it is fitted by gradient steps on a bounded sample of training texts. Markers are known again in
capitals, with letters repeated, and with digits or signs in the place of letters.

Scoring is exact inference over whole texts. Tokens without a marker beside them all have the same
emission, so a stretch of them is a power of one 2 x 2 matrix, and forward-backward visits the others only.
A text's score is a logistic function of its marginals, fitted on the sample; tokens whose marginal is at least
one half are the offending ones.
"""

from __future__ import annotations

import functools
import math
import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, id_and_text, on_workers

FOLDS, LEFT_OUT = 5, 0
#: Training texts that the chain is fitted on, and their code points in all, at most: texts are drawn by hash, whole, until either is used up.
#: Only a first text that alone is longer is cut, for the fit.
SAMPLE, SAMPLE_CHARS, PIECE = 4000, 12_000_000, 64
#: Markers' least log odds and least number of toxic texts.
LEAST_ODDS, LEAST_TEXTS = 1.5, 5
#: Upper bounds of the log odds of each strength but the last; strength 0 is no marker.
STRENGTHS = (2.5, 3.5, 5.0)
#: Tokens that a worker remembers the class of, then forgets.
REMEMBERED = 300_000
#: Labels up to this number are broadcast to the texts; more are joined by a shuffle.
SENT = 500_000
#: Letters, with digits and signs that stand for letters between them.
TOKEN = re.compile(r"[^\W\d_]+(?:[@$0-9]{1,2}[^\W\d_]+)*")
#: Two like letters are ordinary spelling.
REPEATED = re.compile(r"(.)\1\1")
# Letters that digits and signs stand for.
DISGUISES = str.maketrans({"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "@": "a", "$": "s"})
STEPS, SHRINK = 200, 3e-6


def is_training(doc_id: int) -> bool:
    return zlib.crc32(str(doc_id).encode()) % FOLDS != LEFT_OUT


def training(df: DataFrame) -> DataFrame:
    return df.where(F.crc32(F.col("doc_id").cast("string").cast("binary")) % FOLDS != LEFT_OUT)


def labelled(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(doc_id, digest, chars, toxic): a label for each distinct labelled training text; where labels differ, toxic counts."""
    known = training(labels.where("doc_id is not null and toxic is not null")).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    own = training(docs.where("doc_id is not null")).select("doc_id", F.xxhash64("text").alias("digest"), F.length("text").alias("chars")).join(known, "doc_id")
    return own.groupBy("digest").agg(F.max("toxic").alias("toxic"), F.min("doc_id").alias("doc_id"), F.max("chars").alias("chars")).select("doc_id", "digest", "chars", "toxic")


def drawn(chosen: DataFrame) -> list[tuple[int, int, int]]:
    """(doc_id, digest, toxic) of the sample, in the order of the draw."""
    rows = chosen.orderBy(F.xxhash64("doc_id"), "doc_id", "digest").limit(SAMPLE).collect()
    out, used = [], 0
    for r in rows:
        used += r["chars"]
        if out and used > SAMPLE_CHARS:
            break
        out.append((r["doc_id"], r["digest"], int(r["toxic"] > 0)))
    return out


def markers(texts: DataFrame, n_toxic: int, n_clean: int) -> dict[str, float]:
    """Log odds of the markers among (text, toxic) rows. A marker is in LEAST_TEXTS toxic texts or more and rare in clean ones."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict[str, list[int]] = {}
        for batch in batches:
            for text, toxic in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                for word in {t.lower() for t in set(TOKEN.findall(text))}:
                    seen.setdefault(word, [0, 0])[int(toxic > 0)] += 1
            if len(seen) > 200_000:
                yield out(seen)
                seen = {}
        yield out(seen)

    def out(seen: dict[str, list[int]]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(list(seen), pa.string()), *(pa.array([v[i] for v in seen.values()], pa.int64()) for i in (0, 1))], names=["word", "clean", "toxic"])

    found = texts.select("text", "toxic").mapInArrow(run, "word string, clean long, toxic long").groupBy("word").agg(F.sum("clean").alias("clean"), F.sum("toxic").alias("toxic"))
    odds = F.log((F.col("toxic") + 0.5) / (n_toxic + 1.0)) - F.log((F.col("clean") + 0.5) / (n_clean + 1.0))
    spread = F.sqrt(1 / (F.col("toxic") + 0.5) + 1 / (F.col("clean") + 0.5))
    strong = found.where(F.col("toxic") >= LEAST_TEXTS).select("word", (odds - spread).alias("odds")).where(F.col("odds") >= LEAST_ODDS)
    return {r[0]: r[1] for r in strong.collect()}


def squeezed(word: str) -> str:
    """A word in lower case without disguise: letters for digits and signs, each run of a letter once."""
    return re.sub(r"(.)\1+", r"\1", word.lower().translate(DISGUISES))


def strength(odds: float) -> int:
    return 1 + sum(odds > s for s in STRENGTHS)


@dataclass(frozen=True)
class Chain:
    """Emission scores of tag 1 over tag 0, transition scores [from, to], and the scoring function's weights."""

    markers: dict[str, int]
    bias: float
    own: tuple[float, ...]
    beside: tuple[float, ...]
    transition: tuple[tuple[float, float], tuple[float, float]]
    scoring: tuple[float, float, float] = (0.0, 0.0, 0.0)

    @functools.cached_property
    def _seen(self) -> dict[str, int]:
        return {}

    @functools.cached_property
    def _plain(self) -> dict[str, int]:
        """Markers as they look without disguise; of several the one with the greatest weight."""
        return {squeezed(w): c for w, c in sorted(self.markers.items(), key=lambda x: (self.own[x[1]], x[0]))}

    def __getstate__(self) -> dict:
        return {k: v for k, v in self.__dict__.items() if not k.startswith("_")}

    def classes(self, tokens: list[str]) -> dict[int, int]:
        """The tokens that are markers, by position, with their classes."""
        seen = self._seen
        if len(seen) > REMEMBERED:
            seen.clear()
        for t in set(tokens).difference(seen):
            seen[t] = self._class(t)
        return {i: c for i, t in enumerate(tokens) if (c := seen[t])}

    def _class(self, token: str) -> int:
        word = token.lower()
        return self.markers.get(word) or (0 if word.isalpha() and not REPEATED.search(word) else self._plain.get(squeezed(word), 0))

    def emission(self, strengths: np.ndarray) -> np.ndarray:
        left, right = np.zeros_like(strengths), np.zeros_like(strengths)
        left[..., 1:], right[..., :-1] = strengths[..., :-1], strengths[..., 1:]
        return self.bias + np.array(self.own)[strengths] + np.array(self.beside)[left] + np.array(self.beside)[right]


def _forward_backward(emission: np.ndarray, mask: np.ndarray, transition: np.ndarray, weight: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Marginals of tag 1 [sequence, time] and expected transitions [2, 2] of padded sequences, each counted `weight` times."""
    n, length = emission.shape
    score = np.stack([np.zeros_like(emission), emission], axis=2)
    lse = lambda x, axis: np.logaddexp(*np.moveaxis(x, axis, 0))
    alpha, beta = np.zeros((n, length, 2)), np.zeros((n, length, 2))
    alpha[:, 0] = score[:, 0]
    for t in range(1, length):
        now = lse(alpha[:, t - 1, :, None] + transition[None], 1) + score[:, t]
        alpha[:, t] = np.where(mask[:, t, None], now, alpha[:, t - 1])
    for t in range(length - 2, -1, -1):
        after = lse(transition[None] + (score[:, t + 1] + beta[:, t + 1])[:, None, :], 2)
        beta[:, t] = np.where(mask[:, t + 1, None], after, 0.0)
    total = np.logaddexp(alpha[:, -1, 0], alpha[:, -1, 1])
    marginal = np.exp(alpha[:, :, 1] + beta[:, :, 1] - total[:, None]) * mask
    edges = np.exp(alpha[:, :-1, :, None] + transition[None, None] + (score[:, 1:] + beta[:, 1:])[:, :, None, :] - total[:, None, None, None])
    return marginal, np.einsum("ntij,nt->ij", edges, mask[:, 1:] * weight[:, None])


def fit(sample: list[tuple[str, int]], strengths: dict[str, int]) -> Chain:
    """The chain fitted to texts with labels, cut into pieces of PIECE tokens, then its scoring function.

    A marker's class is its identity. Its weight is that of its strength plus its own, which is shrunk more, so that a marker that
    the sample has hardly any of counts as others of its strength do.
    """
    classes = {w: i + 1 for i, w in enumerate(sorted(strengths))}
    levels, n = len(STRENGTHS) + 2, len(classes) + 1
    level = np.array([0, *(strengths[w] for w in sorted(strengths))])
    looks = Chain(classes, 0.0, (0.0,) * n, (), ((0.0, 0.0), (0.0, 0.0)))
    rows, wanted_tags = [], []
    for text, toxic in sample:
        tokens = TOKEN.findall(text)
        found = looks.classes(tokens)
        for at in range(0, len(tokens), PIECE):
            rows.append([found.get(i, 0) for i in range(at, min(at + PIECE, len(tokens)))])
            wanted_tags.append([int(toxic and s > 0) for s in rows[-1]])
    theta, own, transition = np.zeros(1 + 2 * levels), np.zeros(n), np.zeros((2, 2))
    theta[0] = -4.0
    if rows:
        mask = np.array([[i < len(r) for i in range(PIECE)] for r in rows])
        s = np.array([r + [0] * (PIECE - len(r)) for r in rows])
        y = np.array([t + [0] * (PIECE - len(t)) for t in wanted_tags])
        # pieces without a marker are all alike but for their length
        plain = ~s.any(axis=1)
        length, counts = np.unique(mask[plain].sum(axis=1), return_counts=True)
        weight = np.r_[np.ones((~plain).sum()), counts]
        mask = np.r_[mask[~plain], np.arange(PIECE)[None] < length[:, None]]
        s = np.r_[s[~plain], np.zeros((len(length), PIECE), s.dtype)]
        y = np.r_[y[~plain], np.zeros((len(length), PIECE), y.dtype)]
        strong = level[s]
        left, right = np.zeros_like(s), np.zeros_like(s)
        left[:, 1:], right[:, :-1] = strong[:, :-1], strong[:, 1:]
        total = (mask.sum(axis=1) * weight).sum()
        pairs = np.zeros((2, 2))
        for a in (0, 1):
            for b in (0, 1):
                pairs[a, b] = (((y[:, :-1] == a) & (y[:, 1:] == b) & mask[:, 1:]) * weight[:, None]).sum()
        speed, speed_own, speed_t = np.full_like(theta, 1e-8), np.full_like(own, 1e-8), np.full_like(transition, 1e-8)
        for _ in range(STEPS):  # gradient steps scaled by their history
            emission = theta[0] + theta[1 : 1 + levels][strong] + own[s] + theta[1 + levels :][left] + theta[1 + levels :][right]
            marginal, edges = _forward_backward(emission, mask, transition, weight)
            error = (y - marginal) * weight[:, None] * mask
            slope = np.zeros_like(theta)
            slope[0] = error.sum()
            slope[1 : 1 + levels] = np.bincount(strong.ravel(), error.ravel(), levels)
            slope[1 + levels :] = np.bincount(left.ravel(), error.ravel(), levels) + np.bincount(right.ravel(), error.ravel(), levels)
            slope[[1, 1 + levels]] = 0.0  # strength 0 is in the bias
            slope_own = np.bincount(s.ravel(), error.ravel(), n) / total - 3 * SHRINK * own
            slope_own[0] = 0.0
            slope, slope_t = slope / total - SHRINK * theta, (pairs - edges) / total - SHRINK * transition
            speed, speed_own, speed_t = 0.9 * speed + 0.1 * slope**2, 0.9 * speed_own + 0.1 * slope_own**2, 0.9 * speed_t + 0.1 * slope_t**2
            theta, transition = theta + 0.15 * slope / np.sqrt(speed), transition + 0.15 * slope_t / np.sqrt(speed_t)
            own = own + 0.05 * slope_own / np.sqrt(speed_own)
    chain = Chain(classes, float(theta[0]), tuple((theta[1 : 1 + levels][level] + own).tolist()), tuple(theta[1 + levels :][level].tolist()), tuple(map(tuple, transition.tolist())))
    if not sample:
        return chain
    features = np.array([(1.0, *summary(tags(chain, text))) for text, _ in sample])
    wanted = np.array([float(t > 0) for _, t in sample])
    w = np.zeros(3)
    for _ in range(30):  # Newton steps
        p = 1 / (1 + np.exp(-np.clip(features @ w, -30, 30)))
        hessian = (features * (p * (1 - p))[:, None]).T @ features + 0.1 * np.eye(3)
        w = w + np.linalg.solve(hessian, features.T @ (wanted - p) - 0.1 * w)
    return Chain(chain.markers, chain.bias, chain.own, chain.beside, chain.transition, tuple(w.tolist()))


def _active(strengths: dict[int, int], n: int) -> dict[int, int]:
    """Positions whose emission isn't the plain one: markers and what stands beside them."""
    return {j: strengths.get(j, 0) for i in strengths for j in (i - 1, i, i + 1) if 0 <= j < n}


def marginals(chain: Chain, strengths: dict[int, int], n: int) -> dict[int, float]:
    """The probability of tag 1 at every active position of a text of n tokens; exact forward-backward."""
    at = sorted(_active(strengths, n))
    if not at:
        return {}
    move = np.exp(np.array(chain.transition))
    plain = np.array([1.0, math.exp(chain.bias)])
    step = move * plain[None, :]  # on to a plain token
    rates, left = np.linalg.eig(step)
    back = np.linalg.inv(left)
    top = np.abs(rates).max()

    def power(k: int) -> np.ndarray:  # scaled; scales cancel in a marginal
        return ((left * ((rates / top) ** k)) @ back).real

    score = [np.array([1.0, math.exp(min(50.0, chain.bias + chain.own[strengths.get(i, 0)] + chain.beside[strengths.get(i - 1, 0)] + chain.beside[strengths.get(i + 1, 0)]))]) for i in at]
    forward, now, last = [], None, None
    for i, e in zip(at, score):
        if now is None:
            now = e if i == 0 else ((plain @ power(i - 1)) @ move) * e
        else:
            now = ((now @ power(i - last - 1)) @ move) * e if i - last > 1 else (now @ move) * e
        now, last = now / now.sum(), i
        forward.append(now)
    now = power(n - 1 - at[-1]) @ np.ones(2)
    backward = [now / now.sum()]
    for i, j, e in zip(at[-2::-1], at[:0:-1], score[:0:-1]):
        now = move @ (e * now)
        if j - i > 1:
            now = power(j - i - 1) @ now
        now = now / now.sum()
        backward.append(now)
    return {i: float((f * b)[1] / (f * b).sum()) for i, f, b in zip(at, forward, reversed(backward))}


def tags(chain: Chain, text: str) -> list[tuple[int, int, float]]:
    """(start, end, marginal) in code points for the active tokens of a text; offsets are those of the text itself."""
    tokens = TOKEN.findall(text)
    found = chain.classes(tokens)
    if not found:
        return []
    likely = marginals(chain, found, len(tokens))
    return [(m.start(), m.end(), likely[i]) for i, m in enumerate(TOKEN.finditer(text)) if i in likely]


def summary(found: list[tuple[int, int, float]]) -> tuple[float, float]:
    """The strongest marginal, and the expected number of toxic tokens, on a log scale."""
    p = [x[2] for x in found]
    return max(p, default=0.0), math.log1p(sum(p))


def score(chain: Chain, found: list[tuple[int, int, float]]) -> float:
    top, many = summary(found)
    x = chain.scoring[0] + chain.scoring[1] * top + chain.scoring[2] * many
    return 1 / (1 + math.exp(-max(-30.0, min(30.0, x))))


def learn(docs: DataFrame, labels: DataFrame) -> Chain:
    """The chain for (doc_id, text) documents. Without labels it has no markers and scores one half.

    Null texts count as empty, rows without an id have no label, and an empty table is one without labels. Equal texts count once, and very
    long ones are counted whole. Columns besides the two are not read, whatever their names.
    """
    on_workers(docs.sparkSession)
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    chosen = cut(labelled(own, labels))
    size = {bool(r[0]): r[1] for r in chosen.groupBy(F.col("toxic") > 0).count().collect()}
    few = sum(size.values()) <= SENT
    own = own.withColumn("digest", F.xxhash64("text"))
    texts = own.join(F.broadcast(chosen) if few else chosen, ["doc_id", "digest"]).select("text", "toxic")
    found = markers(texts, size.get(True, 0), size.get(False, 0))
    rows = drawn(chosen)
    wanted = docs.sparkSession.createDataFrame([(a, b) for a, b, _ in rows], "doc_id long, digest long")
    text = F.substring("text", 1, SAMPLE_CHARS)
    sample = own.join(F.broadcast(wanted), ["doc_id", "digest"]).groupBy("doc_id", "digest").agg(F.min(text).alias("text")).collect()
    spoken = {(r[0], r[1]): r[2] for r in sample}
    return fit([(spoken[a, b], t) for a, b, t in rows], {w: strength(o) for w, o in found.items()})


def tag(docs: DataFrame, chain: Chain, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, score, spans): one row for each row of `docs`; spans are array<struct<start, end, p>> of offending tokens.

    Scores depend on the text alone. Null and empty texts have no tokens: the score of a text without markers. Very long texts are
    tagged whole. Rows, repeated ones and those with a null id too, are kept; an empty table stays empty. Other columns are not read.
    """
    shared = docs.sparkSession.sparkContext.broadcast(chain)
    kind = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("p", pa.float64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        for batch in batches:
            spans, scores = [], []
            for text in batch.column(1).to_pylist():
                found = tags(own, text)
                scores.append(score(own, found))
                spans.append([{"start": a, "end": b, "p": q} for a, b, q in found if q >= 0.5])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(scores, pa.float64()), pa.array(spans, kind)], names=["doc_id", "score", "spans"])

    on_workers(docs.sparkSession)
    return id_and_text(docs, id_col, text_col).mapInArrow(run, "doc_id long, score double, spans array<struct<start:int,end:int,p:double>>")


def digest(tagged: DataFrame) -> DataFrame:
    """A null id is held out, as no label can be its."""
    out = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % FOLDS == LEFT_OUT, F.lit(True))
    offsets = F.array_join(F.transform("spans", lambda s: F.concat_ws(":", s["start"], s["end"])), ",")
    return tagged.select("doc_id", out.alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"), offsets.alias("offsets"))
