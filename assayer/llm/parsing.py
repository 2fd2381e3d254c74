"""Document fingerprints by locally consistent parsing.

A text is a row of symbols, code points at first. On every level, runs of one symbol become one symbol;
deterministic coin tossing then labels each symbol by the lowest bit in which it differs from its left
neighbour, again and again until there are at most six labels; phrases begin at the local minima of the
labels, so a cut depends on a few neighbours only. A phrase's name is a hash of its symbols, and the names
are the symbols of the next level, until one is left: the root. Equal substrings hence have the same
phrases and names inside, wherever they stand.

A fingerprint is the bottom-k sketch of the names of all levels from LEVEL on, with the root; likeness is
the sketch's estimate of their Jaccard similarity (exact for texts with at most k names).
"""

from __future__ import annotations

import hashlib
from bisect import bisect_right
from collections import Counter
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import id_and_text, on_workers

KEEP, LEVEL = 64, 2
#: Code points parsed together; a longer text is parsed alone.
BLOCK = 1 << 19
#: Buckets of neighbouring documents for each shuffle partition, and their greatest number.
BUCKETS, MOST_BUCKETS = 8, 20_000
LOWEST = -(1 << 63)

U = np.uint64
_LOWEST = np.array([0] + [(i & -i).bit_length() - 1 for i in range(1, 256)], np.uint8)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


def _coins(symbols: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Labels 0 to 5; neighbours within a text differ if the symbols do. `first` are the texts' first positions."""
    left = np.empty_like(symbols)
    left[1:] = symbols[:-1]
    left[first] = ~symbols[first]
    differ = symbols ^ left
    bit = np.bitwise_count((differ & (~differ + U(1))) - U(1)).astype(np.uint64)
    label = ((bit << U(1)) | ((symbols >> bit) & U(1))).astype(np.uint8)
    for _ in range(3):
        left = np.empty_like(label)
        left[1:] = label[:-1]
        left[first] = ~label[first]
        bit = _LOWEST[label ^ left]
        label = (bit << 1) | ((label >> bit) & 1)
    return label


def parse(symbols: np.ndarray, lengths: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
    """For each level: (level, owner of each name, names, whether the owner's parse ended with this name).

    symbols: the code points of several texts on end; lengths: theirs. Empty texts have no names.
    """
    owner = np.repeat(np.arange(len(lengths)), lengths)
    symbols = symbols.astype(np.uint64)
    level = 0
    while len(symbols):
        level += 1
        # runs
        new = np.empty(len(symbols), bool)
        new[0] = True
        new[1:] = (symbols[1:] != symbols[:-1]) | (owner[1:] != owner[:-1])
        at = np.flatnonzero(new)
        if len(at) < len(symbols):
            run = np.diff(np.r_[at, len(symbols)]).astype(np.uint64)
            symbols, owner = symbols[at], owner[at]
            many = run > 1
            symbols[many] = _mix(symbols[many] * U(0x9E3779B97F4A7C15) + run[many] * U(0xD1B54A32D192ED03) + U(level))
        # phrases
        begins = np.empty(len(symbols), bool)
        begins[0] = True
        begins[1:] = owner[1:] != owner[:-1]
        first = np.flatnonzero(begins)
        label = _coins(symbols, first)
        low = np.zeros(len(symbols), bool)
        low[1:-1] = (label[1:-1] < label[:-2]) & (label[1:-1] < label[2:])
        last = np.r_[first[1:] - 1, len(symbols) - 1]
        low[last] = False
        second = first[first < last] + 1  # a first phrase of one symbol would not shrink the text
        low[second] = False
        low[first] = True
        start = np.flatnonzero(low)
        place = (np.arange(len(symbols)) - np.repeat(start, np.diff(np.r_[start, len(symbols)]))).astype(np.uint64)
        names = _mix(np.add.reduceat(_mix(symbols + (place + U(1)) * U(0x9E3779B97F4A7C15)), start) + U(level))
        owner = owner[start]
        alone = np.ones(len(names), bool)
        alone[1:] &= owner[1:] != owner[:-1]
        alone[:-1] &= owner[:-1] != owner[1:]
        yield level, owner, names, alone
        symbols, owner = names[~alone], owner[~alone]


def sketches(texts: list[str], keep: int = KEEP, level: int = LEVEL) -> list[list[int]]:
    """For each text the `keep` smallest distinct names, cut to 32 bits and in order."""
    lengths = np.fromiter(map(len, texts), np.int64, len(texts))
    found: list[np.ndarray] = []
    symbols = np.frombuffer("".join(texts).encode("utf-32-le"), "<u4")
    for at, owner, names, alone in parse(symbols, lengths):
        used = alone if at < level else slice(None)
        found.append((owner[used].astype(np.uint64) << U(32)) | (names[used] >> U(32)))
    keys = np.unique(np.concatenate(found)) if found else np.zeros(0, np.uint64)
    owner = (keys >> U(32)).astype(np.int64)
    bound = np.searchsorted(owner, np.arange(len(texts) + 1))
    names = (keys & U(0xFFFFFFFF)).tolist()
    return [names[a : min(a + keep, b)] for a, b in zip(bound[:-1].tolist(), bound[1:].tolist())]


def likeness(a: list[int], b: list[int], keep: int = KEEP) -> float:
    """0 to 1; two empty sketches are alike."""
    if a == b:
        return 1.0
    x, y = set(a), set(b)
    union = sorted(x | y)[:keep]
    return sum(v in x and v in y for v in union) / len(union)


def written(sketch: list[int]) -> str:
    return "".join(f"{v:08x}" for v in sketch)


def edited(text: str, after: str) -> str:
    """`text` with its last third replaced by the first as many code points of `after`, or all it has."""
    n = len(text) // 3
    return text[: len(text) - n] + after[:n]


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, fingerprint): one row for each row of `docs`, without a shuffle. Empty and null texts have an empty one."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[str] = []
            for texts in blocks(batch.column(1).to_pylist()):
                out += map(written, sketches(texts))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.string())], names=["doc_id", "fingerprint"])

    on_workers(docs.sparkSession)
    return id_and_text(docs, id_col, text_col).mapInArrow(run, "doc_id long, fingerprint string")


def blocks(texts: list[str], most: int = BLOCK) -> Iterator[list[str]]:
    own: list[str] = []
    held = 0
    for text in texts:
        if own and held + len(text) > most:
            yield own
            own, held = [], 0
        own.append(text)
        held += len(text)
    if own:
        yield own


FIELDS = pa.schema([("doc_id", pa.int64()), ("n_chars", pa.int64()), ("edited_sha256", pa.string()), ("fingerprint", pa.string()), ("edited_fingerprint", pa.string()), ("near_edited", pa.float64()), ("near_next", pa.float64())])


def _compared(ids: list, texts: list[str], following: str) -> pa.RecordBatch:
    """Rows for `texts`, each followed by the next and the last by `following`."""
    after = [*texts[1:], following]
    changed = [edited(a, b) for a, b in zip(texts, after)]
    own = sketches([*texts, following])
    other = sketches(changed)
    columns = [ids, [len(t) for t in texts], [hashlib.sha256(t.encode()).hexdigest() for t in changed], [written(s) for s in own[:-1]], [written(s) for s in other], [likeness(a, b) for a, b in zip(own, other)], [likeness(a, b) for a, b in zip(own, own[1:])]]
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, FIELDS)], schema=FIELDS)


def cut_points(own: DataFrame, n: int, wanted: int) -> tuple[list[tuple[int, int, int]], list[int]]:
    """About `wanted` cuts in (~key, digest, salt), and the keys that hold more than one bucket's share.

    Such a key is cut by the digests of its texts, and a digest that holds more than a share by the salt.
    percentile_approx() reckons in doubles, so keys are looked up again and digests have 53 bits.
    """
    if wanted < 2:
        return [], []
    found = Counter(own.agg(F.percentile_approx("key", [i / wanted for i in range(1, wanted)], 10 * wanted)).first()[0])
    cuts = {(~c, LOWEST, LOWEST) for c in found}
    doubles = [float(c) for c, times in found.items() if times > 1]
    if not doubles:
        return sorted(cuts), []
    counts = own.where(F.col("key").cast("double").isin(doubles)).groupBy("key").count().where(F.col("count") > n / wanted)
    hot = {key: int(count * wanted // n) + 1 for key, count in counts.collect()}  # fewer than `wanted` keys
    fine = max(hot.values(), default=0) + 1
    grid = own.where(F.col("key").isin(list(hot))).groupBy("key").agg(F.percentile_approx(_digest(), [i / fine for i in range(1, fine)], 10 * fine)) if hot else None
    for key, digests in grid.collect() if hot else ():
        cuts.add((~key, LOWEST, LOWEST))
        for digest, times in Counter(digests[round(i * fine / (hot[key] + 1)) - 1] for i in range(1, hot[key] + 1)).items():
            width = (1 << 64) // (times + 1)
            cuts |= {(~key, digest, LOWEST + i * width) for i in range(times + 1 if times > 1 else 1)}
    return sorted(cuts), list(hot)


def _digest() -> Column:
    return F.shiftright(F.xxhash64("text"), 11)


def _bucket_of(cuts: list[tuple[int, int, int]]) -> Callable[[Column, Column, Column], Column]:
    """The number of cuts at or before (~key, digest, salt)."""
    first = np.array([c[0] for c in cuts], np.int64)

    @F.pandas_udf("int")
    def bucket(key, digest, salt):  # noqa: ANN001, ANN202  the kind of UDF follows from there being no annotations
        import pandas as pd

        own = ~key.to_numpy()
        out = np.searchsorted(first, own, side="left")
        for i in np.flatnonzero(out < np.searchsorted(first, own, side="right")):
            out[i] = bisect_right(cuts, (int(own[i]), int(digest.iloc[i]), int(salt.iloc[i])))
        return pd.Series(out, dtype="int32")

    return bucket


def compare_edited(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Each document's fingerprint against that of its edited text and of the next document, by descending id.

    Documents go to buckets of neighbouring ids; every bucket ends with a copy of the first document of the next
    one, so that each text is shuffled once and read in order as a stream. Equal ids follow in the order of their
    texts' hashes, null ids come last, and null texts count as empty. Rows of an id that many rows share, null
    ids among them, go to buckets by their texts' hashes, and equal rows that are many by an arbitrary number. A
    lone document is its own next. A text of any length is parsed whole, alone if it is long; extra columns, whatever
    their names, are not read. An empty table gives an empty result.
    """
    spark = docs.sparkSession
    on_workers(spark)
    own = id_and_text(docs, id_col, text_col).withColumn("key", F.coalesce("doc_id", F.lit(LOWEST)))
    n = own.select("key").count()
    if not n:
        return own.select("doc_id", *(F.lit(None).cast(k).alias(c) for c, k in (("n_chars", "long"), ("edited_sha256", "string"), ("fingerprint", "string"), ("edited_fingerprint", "string"), ("near_edited", "double"), ("near_next", "double"))))
    wanted = max(1, min(MOST_BUCKETS, BUCKETS * int(spark.conf.get("spark.sql.shuffle.partitions")), n // 32))
    cuts, hot = cut_points(own, n, wanted)
    zero = F.lit(0).cast("long")
    shared = F.col("key").isin(hot)
    digest, salt = (F.when(shared, _digest()), F.when(shared, F.xxhash64(F.monotonically_increasing_id()))) if hot else (F.lit(None).cast("long"), zero)
    own = own.withColumn("digest", digest).withColumn("bucket", _bucket_of(cuts)("key", F.coalesce("digest", zero), F.coalesce(salt, zero)))
    order = F.struct(F.bitwise_not("key").alias("key"), "digest")
    firsts = {b: (~first["key"], first["digest"]) for b, first in own.groupBy("bucket").agg(F.min(order)).collect()}  # a row for each bucket
    after, ends = firsts[min(firsts)], []
    for b in range(len(cuts), -1, -1):  # an empty bucket ends like the one before it
        ends.append((b, *after))
        after = firsts.get(b, after)
    ends = F.broadcast(spark.createDataFrame(ends, "bucket int, key long, digest long"))
    at = F.col("own.key").eqNullSafe(F.col("ends.key")) & F.col("own.digest").eqNullSafe(F.col("ends.digest"))
    whole = F.xxhash64("text")
    texts = own.drop("bucket").alias("own").join(ends.alias("ends"), at, "left_semi").groupBy("key", "digest", whole.alias("whole")).agg(F.min("text").alias("text"))
    heads = texts.alias("own").join(ends.alias("ends"), at).groupBy("ends.bucket").agg(F.min_by("text", "whole").alias("text"))
    rows = own.select("bucket", F.lit(0).alias("edge"), "key", "doc_id", "text").union(heads.select("bucket", F.lit(1), F.lit(LOWEST), F.lit(None), "text"))
    rows = rows.repartition("bucket").sortWithinPartitions("bucket", "edge", F.desc("key"), whole)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held_ids: list = []
        held: list[str] = []
        size = 0
        for batch in batches:
            for edge, doc_id, text in zip(*(batch.column(i).to_pylist() for i in range(3))):
                if held and (edge or size > BLOCK):
                    yield _compared(held_ids, held, text)
                    held_ids, held, size = [], [], 0
                if not edge:
                    held_ids.append(doc_id)
                    held.append(text)
                    size += len(text)

    return rows.select("edge", "doc_id", "text").mapInArrow(run, "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double")
