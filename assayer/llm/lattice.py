"""Document probability as the marginal over all segmentations into subword pieces.

The pieces and their first scores come from an existing vocabulary file. Every training word counts in
expectation-maximisation rounds that turn the scores into unigram probabilities of the pieces. A word's
probability is the sum over all its segmentations of the product of their pieces' probabilities, found by a
forward recursion in log space; a text's is the product over its words and one end.

Each distinct word of the corpus is scored once. Words that are frequent, of which there are at most FREQUENT
with MOST_BYTES in all, come to the documents as a broadcast dictionary; all others meet the
documents' words in a join, so that no word's rows are many and no vocabulary is ever collected whole.
"""

from __future__ import annotations

import math
import pickle
import zlib
from collections import Counter
from collections.abc import Iterator
from math import exp, log, log1p

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut, id_and_text, on_workers

FOLDS, HELD_OUT = 5, 1
ROUNDS = 2
#: Words in the broadcast dictionary at most, and their bytes.
FREQUENT, MOST_BYTES = 200_000, 16 << 20
#: Distinct words that a task counts before it passes them on.
HELD = 200_000
#: Expected uses of every piece before any is seen.
SMOOTHING = 0.05
MARK = "▁"
#: Steps of word frequency to the power of two.
STEPS = 8


class Pieces:
    """Natural log probabilities of pieces, with the prefixes that let a search stop early."""

    def __init__(self, log_p: dict[str, float], end: str, bytes_of: dict[int, str]):
        self.log_p, self.end, self.bytes_of = log_p, end, bytes_of
        self.arcs: dict[str, float | None] = {}  # piece: its score; a mere prefix of one: None
        for piece, score in log_p.items():
            if piece == end or piece in bytes_of.values():
                continue
            self.arcs[piece] = score
            for n in range(1, len(piece)):
                self.arcs.setdefault(piece[:n], None)

    def unseen(self, char: str) -> float:
        """A character that is no piece is spelled by its bytes."""
        return sum(self.log_p[self.bytes_of[b]] for b in char.encode())

    def lattice(self, text: str) -> list[list[tuple[int, float]]]:
        """For each position, the ends and scores of the pieces that begin there; scores are below 0."""
        find, n, out = self.arcs.get, len(text), []
        for i in range(n):
            own, stop, score = [], i + 1, find(text[i], 0.0)
            while score != 0.0:
                if score is not None:
                    own.append((stop, score))
                if stop == n:
                    break
                stop += 1
                score = find(text[i:stop], 0.0)
            if not own or own[0][0] != i + 1:
                own.append((i + 1, self.unseen(text[i])))
            out.append(own)
        return out

    def word(self, word: str) -> float:
        return _forward(self.lattice(MARK + word))[-1]

    def expected(self, word: str, times: float, into: dict[str, float]) -> None:
        """Adds the expected uses of each piece in `times` occurrences of the word, by forward and backward recursion."""
        text = MARK + word
        arcs = self.lattice(text)
        alpha, n = _forward(arcs), len(text)
        beta = [0.0] * (n + 1)
        total, known = alpha[n], self.arcs
        for i in range(n - 1, -1, -1):
            own, base = arcs[i], alpha[i] - total
            if len(own) == 1:
                beta[i] = own[0][1] + beta[own[0][0]]
            else:
                beta[i] = _log_sum([score + beta[stop] for stop, score in own])
            for stop, score in own:
                use = times * exp(min(0.0, base + score + beta[stop]))
                piece = text[i:stop]
                if known.get(piece) is not None:
                    into[piece] = into.get(piece, 0.0) + use
                else:
                    for b in piece.encode():
                        into[self.bytes_of[b]] = into.get(self.bytes_of[b], 0.0) + use


class Batch:
    """The lattices of many words at once.

    Arcs are found by rolling hashes of all substrings that are prefixes of pieces, one length after another. A step of
    the recursions takes all words' arcs that begin (or end) at one position; a word has at most one such arc for
    each end (or beginning), so that a step never meets a node twice.
    """

    MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)

    def __init__(self, pieces: Pieces):
        self.pieces = pieces
        self.names = list(pieces.log_p)
        number = {p: i for i, p in enumerate(self.names)}
        self.scores = np.array([pieces.log_p[p] for p in self.names])
        known = list(pieces.arcs)
        hashes = np.array([self._hash(p) for p in known], np.uint64)
        order = np.argsort(hashes)
        self.keys = hashes[order]
        if (self.keys[1:] == self.keys[:-1]).any():
            raise ValueError("two pieces have one hash")
        self.number = np.array([number[p] if pieces.arcs[p] is not None else -1 for p in known], np.int64)[order]
        self.byte = np.array([number[pieces.bytes_of[b]] for b in range(256)])

    def _hash(self, piece: str) -> int:
        h = 0
        for c in piece:
            h = (h * int(self.MULTIPLIER) + ord(c) + 1) & 0xFFFFFFFFFFFFFFFF
        return h

    def _arcs(self, words: list[str]):
        texts = [MARK + w for w in words]
        n = np.fromiter(map(len, texts), np.int64, len(texts))
        code = np.frombuffer("".join(texts).encode("utf-32-le"), "<u4").astype(np.uint64) + np.uint64(1)
        word = np.repeat(np.arange(len(texts)), n)
        first = np.cumsum(n) - n
        end = np.repeat(first + n, n)
        at, h, found = np.arange(len(code)), np.zeros(len(code), np.uint64), []
        single = np.zeros(len(code), bool)
        length = 0
        while len(at):
            h = h * self.MULTIPLIER + code[at + length]
            length += 1
            where = np.minimum(np.searchsorted(self.keys, h), len(self.keys) - 1)
            known = self.keys[where] == h
            at, h, piece = at[known], h[known], self.number[where[known]]
            whole = piece >= 0
            found.append((at[whole], np.full(int(whole.sum()), length), piece[whole]))
            if length == 1:
                single[at[whole]] = True
            go_on = at + length < end[at]
            at, h = at[go_on], h[go_on]
        odd = np.flatnonzero(~single)
        start, size, piece = (np.concatenate(x) for x in zip(*found, (odd, np.ones(len(odd), np.int64), np.full(len(odd), -1))))
        score = self.scores[piece]
        if len(odd):
            chars, which = np.unique(code[odd], return_inverse=True)
            score[len(score) - len(odd) :] = np.array([self.pieces.unseen(chr(int(c) - 1)) for c in chars])[which]
        # a word of n characters has n + 1 nodes
        return start + word[start], start + size + word[start], start - first[word[start]], size, piece, score, word[start], first + np.arange(len(texts)), n, code[odd]

    def _alpha(self, tail: np.ndarray, head: np.ndarray, place: np.ndarray, score: np.ndarray, first: np.ndarray, n: np.ndarray) -> np.ndarray:
        alpha = np.full(int((n + 1).sum()), -np.inf)
        alpha[first] = 0.0
        order = np.argsort(place, kind="stable")
        bound = np.searchsorted(place[order], np.arange(int(n.max()) + 1))
        for a, b in zip(bound[:-1], bound[1:]):
            now = order[a:b]
            alpha[head[now]] = np.logaddexp(alpha[head[now]], alpha[tail[now]] + score[now])
        return alpha

    def word(self, words: list[str]) -> np.ndarray:
        """The log probability of each word."""
        tail, head, place, _, _, score, _, first, n, _ = self._arcs(words)
        return self._alpha(tail, head, place, score, first, n)[first + n]

    def expected(self, words: list[str], times: np.ndarray) -> np.ndarray:
        """The expected uses of every piece in all words, each of which occurs so many times."""
        tail, head, place, size, piece, score, word, first, n, odd = self._arcs(words)
        alpha = self._alpha(tail, head, place, score, first, n)
        beta = np.full(len(alpha), -np.inf)
        beta[first + n] = 0.0
        stop = place + size
        order = np.argsort(-stop, kind="stable")
        bound = np.searchsorted(-stop[order], -np.arange(int(n.max()), -1, -1))
        for a, b in zip(bound[:-1], bound[1:]):
            now = order[a:b]
            beta[tail[now]] = np.logaddexp(beta[tail[now]], beta[head[now]] + score[now])
        use = times[word] * np.exp(np.minimum(0.0, alpha[tail] + score + beta[head] - alpha[first + n][word]))
        whole = piece >= 0
        out = np.bincount(piece[whole], use[whole], len(self.names))
        chars, which = np.unique(odd, return_inverse=True)
        for c, u in zip(chars.tolist(), np.bincount(which, use[len(use) - len(odd) :], len(chars)).tolist()):
            for b in chr(c - 1).encode():
                out[self.byte[b]] += u
        return out


def _blocks(words: list[str], most: int = 200_000) -> Iterator[list[int]]:
    """Word numbers in blocks of similar length with about `most` characters; a long word is a block alone."""
    own: list[int] = []
    held = 0
    for i in sorted(range(len(words)), key=lambda i: len(words[i])):
        n = len(words[i]) + 1
        if own and (held + n > most or n > LONG):
            yield own
            own, held = [], 0
        own.append(i)
        held += n
    if own:
        yield own


#: Longer words are handled one by one.
LONG = 200


def _forward(arcs: list[list[tuple[int, float]]]) -> list[float]:
    """Log of the summed probability of all segmentations of each prefix."""
    alpha: list[float | None] = [None] * (len(arcs) + 1)
    alpha[0] = 0.0
    for a, own in zip(alpha, arcs):  # every position is reached, by single characters at least
        for stop, score in own:
            x, y = alpha[stop], a + score
            if x is None:
                alpha[stop] = y
            elif x > y:
                alpha[stop] = x + log1p(exp(y - x))
            else:
                alpha[stop] = y + log1p(exp(x - y))
    return alpha


def _log_sum(terms: list[float]) -> float:
    top = max(terms)
    return top + log(sum([exp(t - top) for t in terms]))


def read_pieces(path: str) -> Pieces:
    """The vocabulary of a SentencePiece file. A merge file's scores are ranks, which stand for a power law."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    scores = {model.id_to_piece(i): model.get_score(i) for i in range(model.get_piece_size()) if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i))}
    low = min(scores.values(), default=0.0)
    if low < -100:  # ranks
        scores = {p: -math.log(10.0 - s) for p, s in scores.items()}
        low = min(scores.values())
    bytes_of = {b: f"<0x{b:02X}>" for b in range(256)}
    scores |= dict.fromkeys(bytes_of.values(), low - 3.0)
    end = model.id_to_piece(model.eos_id()) if model.eos_id() >= 0 else "</s>"
    scores[end] = max(scores.values())
    total = math.log(sum(math.exp(s) for s in scores.values()))
    return Pieces({p: s - total for p, s in scores.items()}, end, bytes_of)


def held_out(doc_id: Column) -> Column:
    """A null id counts as the empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % FOLDS == HELD_OUT


def _is_held_out(doc_id: int | None) -> bool:
    return zlib.crc32(b"" if doc_id is None else str(doc_id).encode()) % FOLDS == HELD_OUT


def word_counts(docs: DataFrame) -> DataFrame:
    """(word, c, uses): every distinct word of docs (doc_id, text), with its count in training documents and in all."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        train: Counter[bytes] = Counter()
        other: Counter[bytes] = Counter()

        def out() -> pa.RecordBatch:
            words = [*train, *(other.keys() - train.keys())]
            c = [train[w] for w in words]
            uses = [train[w] + other[w] for w in words]
            train.clear()
            other.clear()
            return pa.RecordBatch.from_arrays([pa.array(words, pa.binary()).cast(pa.string()), pa.array(c, pa.int64()), pa.array(uses, pa.int64())], names=["word", "c", "uses"])

        for batch in batches:
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).cast(pa.binary()).to_pylist()):
                words = text.lower().split()  # bytes: A-Z only, and ASCII white space only
                if _is_held_out(doc_id):
                    other.update(words)
                else:
                    train.update(words)
                if len(train) + len(other) > HELD:
                    yield out()
        yield out()

    return docs.mapInArrow(run, "word string, c long, uses long").groupBy("word").agg(F.sum("c").alias("c"), F.sum("uses").alias("uses"))


def _shipped(pieces: Pieces):
    return pickle.dumps((pieces.log_p, pieces.end, pieces.bytes_of))


_held: dict[int, Batch] = {}


def _unshipped(data: bytes) -> Batch:
    key = hash(data)
    if key not in _held:
        _held.clear()
        _held[key] = Batch(Pieces(*pickle.loads(data)))
    return _held[key]


def reestimated(words: DataFrame, pieces: Pieces, n_docs: int) -> Pieces:
    """One round of expectation-maximisation over all training words; what is collected has a row for each piece."""
    data = words.sparkSession.sparkContext.broadcast(_shipped(pieces))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = _unshipped(data.value)
        total, more = np.zeros(len(own.names)), {}
        for batch in batches:
            words, times = batch.column(0).to_pylist(), batch.column(1).to_numpy().astype(np.float64)
            for block in _blocks(words):
                if len(block) == 1 and len(words[block[0]]) >= LONG:
                    own.pieces.expected(words[block[0]], float(times[block[0]]), more)
                else:
                    total += own.expected([words[i] for i in block], times[block])
        for piece, use in more.items():
            total[own.names.index(piece)] += use
        yield pa.RecordBatch.from_arrays([pa.array(own.names, pa.string()), pa.array(total, pa.float64())], names=["piece", "uses"])

    found = dict(map(tuple, words.where("c > 0").mapInArrow(run, "piece string, uses double").groupBy("piece").agg(F.sum("uses")).collect()))
    found[pieces.end] = float(n_docs)
    uses = {p: found.get(p, 0.0) + SMOOTHING for p in pieces.log_p}
    total = math.log(sum(uses.values()))
    return Pieces({p: math.log(u) - total for p, u in uses.items()}, pieces.end, pieces.bytes_of)


def word_scores(words: DataFrame, pieces: Pieces) -> DataFrame:
    """`words` with log10_p, the marginal probability of each."""
    data = words.sparkSession.sparkContext.broadcast(_shipped(pieces))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = _unshipped(data.value)
        for batch in batches:
            words = batch.column(0).to_pylist()
            scores = np.zeros(len(words))
            for block in _blocks(words):
                long = len(block) == 1 and len(words[block[0]]) >= LONG
                scores[block] = own.pieces.word(words[block[0]]) if long else own.word([words[i] for i in block])
            scores /= math.log(10)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(scores, pa.float64())], names=["word", "c", "uses", "log10_p"])

    return words.select("word", "c", "uses").mapInArrow(run, "word string, c long, uses long, log10_p double")


def frequent(scored: DataFrame, most: int = FREQUENT, most_bytes: int = MOST_BYTES) -> tuple[Column, dict[bytes, tuple[int, float]]]:
    """A condition for the words that are most frequent in all documents, held out or not, and those words; both bounds hold."""
    step = F.floor(F.log2(F.col("uses") + 1) * STEPS)
    rows = scored.groupBy(step.alias("s")).agg(F.count("*"), F.sum(F.octet_length("word"))).collect()  # a row for each step
    n = size = 0
    floor = None
    for s, count, length in sorted(map(tuple, rows), reverse=True):
        n, size = n + count, size + length
        if n > most or size > most_bytes:
            break
        floor = s
    if floor is None:
        return F.lit(False), {}
    chosen = step >= floor
    return chosen, {r["word"].encode(): (r["c"], r["log10_p"]) for r in scored.where(chosen).collect()}


def score(docs: DataFrame, vocabulary: str, id_col: str = "doc_id", text_col: str = "text", rounds: int = ROUNDS) -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score), one row for each row of `docs`.

    Null and empty texts have one token, the end. Repeated rows are scored and, in training, counted one by one. With
    no training documents every count is 0. A null id belongs to the training documents. An empty table gives an
    empty result. Words of any length are whole; characters outside the vocabulary are spelled in bytes.
    """
    spark = docs.sparkSession
    on_workers(spark)
    own = id_and_text(docs, id_col, text_col)
    words = cut(word_counts(own))
    n_docs = own.select("doc_id").where(~held_out(F.col("doc_id"))).count()
    n_words, distinct = words.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count_if(F.col("c") > 0)).first()
    total, kinds = n_words + n_docs, distinct + (n_docs > 0)
    pieces = read_pieces(vocabulary)
    for _ in range(rounds if n_docs else 0):
        pieces = reestimated(words, pieces, n_docs)
    scored = cut(word_scores(words, pieces))
    chosen, known = frequent(scored)
    shared = spark.sparkContext.broadcast(known)
    denominator = math.log10(total + 0.5 * (kinds + 1))
    end = (math.log10(n_docs + 0.5) - denominator, pieces.log_p[pieces.end] / math.log(10))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["row", "word", "n", "doc_id", "n_tokens", "n_known", "base_score", "score"]
        table = shared.value
        for batch in batches:
            out: list[list] = [[] for _ in names]
            for row, doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).cast(pa.binary()).to_pylist()):
                tokens, n_known, (base, log_p) = text.lower().split(), int(n_docs > 0), end
                for word, n in Counter(tokens).items():
                    if (entry := table.get(word)) is not None:
                        n_known += n if entry[0] else 0
                        base += n * (math.log10(entry[0] + 0.5) - denominator)
                        log_p += n * entry[1]
                    else:
                        for column, value in zip(out, (row, word, n, None, None, None, None, None)):
                            column.append(value)
                for column, value in zip(out, (row, None, None, doc_id, len(tokens) + 1, n_known, base, log_p)):
                    column.append(value)
            kinds = (pa.int64(), pa.binary(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.float64(), pa.float64())
            arrays = [pa.array(c, k) for c, k in zip(out, kinds)]
            arrays[1] = arrays[1].cast(pa.string())
            yield pa.RecordBatch.from_arrays(arrays, names=names)

    rows = own.select(F.monotonically_increasing_id().alias("row"), "doc_id", "text").mapInArrow(run, "row long, word string, n long, doc_id long, n_tokens long, n_known long, base_score double, score double")
    rows = rows.withColumn("word", F.coalesce("word", F.concat(F.lit(" "), F.col("row").cast("string"))))  # summary rows spread out; a word has no space
    joined = rows.join(scored.where(~chosen), "word", "left")
    seen = F.col("n").isNotNull()
    return (
        joined.groupBy("row")
        .agg(
            F.max("doc_id").alias("doc_id"),
            F.max("n_tokens").alias("n_tokens"),
            F.sum(F.when(seen, F.when(F.col("c") > 0, F.col("n")).otherwise(0)).otherwise(F.col("n_known"))).alias("n_known"),
            F.sum(F.when(seen, F.col("n") * (F.log10(F.coalesce(F.col("c"), F.lit(0)) + 0.5) - denominator)).otherwise(F.col("base_score"))).alias("base_score"),
            F.sum(F.when(seen, F.col("n") * F.col("log10_p")).otherwise(F.col("score"))).alias("score"),
        )
        .select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "n_tokens", "n_known", F.lit(total).cast("long").alias("train_tokens"), "base_score", "score")
    )
