"""Mixing sources to target weights with a multivariate-hypergeometric splitting tree.

Sources are streams of words (their documents in a fixed order), cut into blocks of equal length.
A source's target becomes a quota of whole block draws: full passes over its blocks, then a part of
one more pass. A tree splits the quotas among the output shards: each node deals its draws to its two
halves by a multivariate-hypergeometric draw, so every quota is met exactly and shards hold what
random dealing without replacement would give them. A shard's share of a source is an interval of draw
positions; a keyed permutation of the source's block numbers maps positions to blocks, so that shards
draw disjoint blocks without talking to each other. A block that no shard's interval holds isn't drawn.
Within a shard a second keyed permutation gives every block its place, which is the local shuffle.

The driver holds one row per source and the shards' quotas, CELLS numbers at most, never documents. Draw
positions and places follow from the seed and the data alone, so that reruns agree whatever the partitioning.
"""

from __future__ import annotations

import functools
import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import arrow_map, cut, on_workers, slices

WEIGHTS, SHARE, MOST_PASSES, SEED = (3, 1, 2), 1.5, 2, 42
#: Words in a block; small sources have smaller ones, about FINE of them.
BLOCK, FINE = 64, 512
#: Words in an output shard; shards are larger where sources times shards would exceed CELLS quotas.
SHARD, CELLS = 1_000_000, 4_000_000
#: Words in a bucket in which a source's documents are put in order: their number follows the largest source.
BUCKET = 200_000
#: Blocks that are sorted together, at most; fewer where there are few pieces for each shuffle partition.
PIECE, PIECES = 1 << 14, 16
#: Bytes of compressed text that are read and searched for words at once; a longer text is searched alone.
TOGETHER = 8 << 20
#: Populations from which numpy draws.
DRAWN = 10**9


def targets(sizes: dict[str | None, int], weights: tuple[float, ...] = WEIGHTS, share: float = SHARE, passes: int = MOST_PASSES) -> dict[str | None, float]:
    """Words wanted of each source: `share` of all words by weight, none above `passes` times its size, the excess reshared."""
    names = sorted(sizes, key=lambda s: (s is None, s))
    weight = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    left, out = share * sum(sizes.values()), {}
    active = list(names)
    while active:
        total = sum(weight[s] for s in active)
        full = [s for s in active if left * weight[s] / total > passes * sizes[s]]
        if not full:
            return out | {s: left * weight[s] / total for s in active}
        for s in full:
            out[s] = float(passes * sizes[s])
        left -= sum(out[s] for s in full)
        active = [s for s in active if s not in out]
    return out


@dataclass(frozen=True)
class Plan:
    """For each source, by number: size, target, block length and blocks; and the shards' intervals of draws."""

    names: tuple[str | None, ...]
    size: tuple[int, ...]
    target: tuple[float, ...]
    block: tuple[int, ...]
    blocks: tuple[int, ...]
    ends: np.ndarray  # [shard, source]: end of the shard's interval
    seed: int

    @functools.cached_property
    def before(self) -> np.ndarray:
        """[shard, source]: draws of the shard from the sources before; the last column has all its draws."""
        own = np.diff(self.ends, axis=0, prepend=0)
        return np.concatenate([np.zeros((len(own), 1), np.int64), np.cumsum(own, axis=1)], axis=1)


def _hypergeometric(rng: np.random.Generator, good: int, bad: int, n: int) -> int:
    """Of n draws without replacement, how many are good.

    Beyond numpy's range a uniform number is looked up in the distribution itself, summed from the ratio of each probability
    to the next over ten deviations about the mode; what lies outside is less than the uniform number can tell.
    """
    total = good + bad
    if total < DRAWN:
        return int(rng.hypergeometric(good, bad, n))
    mode = (good + 1) * (n + 1) // (total + 2)
    reach = int(10 * math.sqrt(n * (good / total) * (bad / total) * ((total - n) / (total - 1)))) + 64
    low, high = max(0, n - bad, mode - reach), min(good, n, mode + reach)
    k = np.arange(low, high, dtype=np.float64)
    step = np.log(good - k) - np.log(k + 1) + np.log(n - k) - np.log(bad - n + k + 1)
    weight = np.concatenate([[0.0], np.cumsum(step)])
    reached = np.cumsum(np.exp(weight - weight.max()))
    return low + min(int(np.searchsorted(reached, rng.random() * reached[-1], side="right")), high - low)


def split(draws: tuple[int, ...], shards: int, seed: int = SEED) -> np.ndarray:
    """[shard, source]: quotas that add up to `draws` for each source and differ by at most one draw in total between shards."""
    out = np.zeros((shards, len(draws)), np.int64)
    total = sum(draws)
    bound = [total * i // shards for i in range(shards + 1)]
    todo = [(0, shards, list(draws))]
    while todo:
        low, high, own = todo.pop()
        if high - low == 1:
            out[low] = own
            continue
        mid = (low + high) // 2
        rng = np.random.default_rng([seed, low, high])
        want, rest, left = bound[mid] - bound[low], sum(own), []
        for n in own:  # one colour after another
            rest -= n
            left.append(_hypergeometric(rng, n, rest, want) if n and want else 0)
            want -= left[-1]
        todo += [(low, mid, left), (mid, high, [a - b for a, b in zip(own, left)])]
    return out


def make_plan(sizes: dict[str | None, int], weights: tuple[float, ...] = WEIGHTS, share: float = SHARE, passes: int = MOST_PASSES, block: int = BLOCK, shard: int = SHARD, seed: int = SEED) -> Plan:
    names = tuple(sorted(sizes, key=lambda s: (s is None, s)))
    want = targets(sizes, weights, share, passes)
    size = tuple(int(sizes[s]) for s in names)
    length = tuple(max(1, min(block, n // FINE)) for n in size)
    blocks = tuple(-(-n // b) for n, b in zip(size, length))
    draws = []
    for s, n, b, k in zip(names, size, length, blocks):
        full = min(passes, int(want[s] // n)) if n else 0
        draws.append(full * k + min(k if full < passes else 0, round((want[s] - full * n) / b)) if n else 0)
    shards = max(1, min(-(-int(sum(want.values())) // shard), CELLS // max(1, len(names))))
    return Plan(names, size, tuple(want[s] for s in names), length, blocks, np.cumsum(split(tuple(draws), shards, seed), axis=0), seed)


def _mix64(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def permuted(x: np.ndarray, n: int | np.ndarray, key: int | np.ndarray) -> np.ndarray:
    """Positions of 0 .. n - 1 under a keyed permutation: a Feistel network over the fewest bits, walked until it lands in the domain.

    n and key may differ by element.
    """
    size = np.broadcast_to(np.asarray(n, np.uint64), x.shape)
    bits = np.maximum(np.frexp((size - np.uint64(1)).astype(np.float64))[1], 2).astype(np.uint64)
    key = np.broadcast_to(np.asarray(key, np.uint64), x.shape) * np.uint64(0x9E3779B97F4A7C15)
    low = bits >> np.uint64(1)
    low_mask, high_mask = (np.uint64(1) << low) - np.uint64(1), (np.uint64(1) << (bits - low)) - np.uint64(1)
    turns = [np.uint64(r * 0xD1B54A32D192ED03 & 0xFFFFFFFFFFFFFFFF) for r in range(4)]
    x = x.astype(np.uint64)
    out = np.full(len(x), -1, np.int64)
    todo = np.arange(len(x))
    while len(todo):
        a, b = x >> low, x & low_mask
        for r in (0, 2):
            a = a ^ (_mix64(b + key + turns[r]) & high_mask)
            b = b ^ (_mix64(a + key + turns[r + 1]) & low_mask)
        x = (a << low) | b
        done = x < size
        out[todo[done]] = x[done]
        left = ~done
        x, todo, size, key, low, low_mask, high_mask = (v[left] for v in (x, todo, size, key, low, low_mask, high_mask))
    return out


@dataclass(frozen=True)
class Draws:
    """Blocks drawn of many documents, by document, pass and shard: words begin .. end of document `row`, and the block's place in its shard."""

    row: np.ndarray
    turn: np.ndarray
    begin: np.ndarray
    end: np.ndarray
    shard: np.ndarray
    place: np.ndarray


def drawn(plan: Plan, source: np.ndarray, offset: np.ndarray, size: np.ndarray, passes: int = MOST_PASSES) -> Draws:
    """What the shards draw of documents at `offset` of their source's stream.

    Word numbers count within the document; blocks at its ends may belong to its neighbours in part. Documents of
    a source are handled together, block by block and not one by one.
    """
    found: list[tuple[np.ndarray, ...]] = []
    for s in np.unique(source[size > 0]):
        rows = np.flatnonzero((source == s) & (size > 0))
        length, n, ends = plan.block[s], plan.blocks[s], plan.ends[:, s]
        first = offset[rows] // length
        count = (offset[rows] + size[rows] - 1) // length + 1 - first
        row = np.repeat(rows, count)
        block = np.arange(len(row)) - np.repeat(np.cumsum(count) - count, count) + np.repeat(first, count)
        for turn in range(passes):
            at = permuted(block, n, plan.seed + 1_000_003 * int(s) + turn) + turn * n
            shard = np.searchsorted(ends, at, side="right")
            taken = shard < len(ends)
            r, own, b = row[taken], shard[taken], block[taken] * length - offset[row[taken]]
            local = plan.before[own, s] + at[taken] - np.where(own > 0, ends[own - 1], 0)
            place = permuted(local, plan.before[own, -1], plan.seed + 7_368_787 * (own + 1))
            found.append((r, np.full(len(r), turn), np.maximum(b, 0), np.minimum(b + length, size[r]), own, place))
    parts = [np.concatenate(x) for x in zip(*found)] if found else [np.zeros(0, np.int64)] * 6
    order = np.lexsort((parts[2], parts[4], parts[1], parts[0]))
    return Draws(*(p[order] for p in parts))


_SPACE = np.isin(np.arange(256), [0x20, *range(0x09, 0x0E)])


@dataclass(frozen=True)
class Words:
    """The words of a column of texts: all bytes, where each text begins (and the end), where each word begins, and each text's first word."""

    data: np.ndarray
    text: np.ndarray
    start: np.ndarray
    first: np.ndarray

    @property
    def size(self) -> np.ndarray:
        return np.diff(self.first)


def words_of(column: pa.Array) -> Words:
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, offsets, data = column.buffers()
    text = np.frombuffer(offsets, np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64) if len(column) else np.zeros(1, np.int64)
    own = np.frombuffer(data, np.uint8)[text[0] : text[-1]] if data is not None else np.zeros(0, np.uint8)
    text = text - text[0]
    word = ~_SPACE[own]
    begins = word.copy()
    begins[1:] &= ~word[:-1]
    heads = text[:-1][text[:-1] < len(own)]
    begins[heads] = word[heads]
    start = np.flatnonzero(begins)
    return Words(own, text, start, np.searchsorted(start, text))


def _keyed(docs: DataFrame, id_col: str, text_col: str, source_col: str) -> list[Column]:
    text = F.coalesce(F.col(f"`{text_col}`"), F.lit(""))
    return [F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.col(f"`{source_col}`").cast("string").alias("source"), F.xxhash64(text).alias("digest"), text.alias("text")]


def sized(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """(doc_id, source, digest, size), a row for each row of `docs`; a null text has no words."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(words_of(batch.column(3)).size, pa.int64())], names=["doc_id", "source", "digest", "size"])

    on_workers(docs.sparkSession)
    return docs.select(*_keyed(docs, id_col, text_col, source_col)).mapInArrow(arrow_map(run, 3), "doc_id long, source string, digest long, size long")


def planned(rows: DataFrame, **parameters) -> Plan:
    """The plan for sized rows; the driver reads one number for each source."""
    sizes = {r[0]: r[1] for r in rows.groupBy("source").agg(F.sum("size")).limit(CELLS + 1).collect()}
    if len(sizes) > CELLS:
        raise ValueError(f"more than {CELLS} sources can't be mixed")
    return make_plan(sizes, **parameters)


def _bucket(buckets: int) -> Column:
    return F.pmod(F.xxhash64("doc_id", "digest"), F.lit(buckets)).cast("long").alias("bucket")


def _compressed(texts: DataFrame) -> DataFrame:
    """The rows with their text as zstd frames, as the text is the bulk of what is shuffled; empty texts stay empty."""
    at = texts.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        write = zstandard.ZstdCompressor(level=1).compress
        for batch in batches:
            columns = list(batch.columns)
            columns[at] = pa.array([write(x) if x else x for x in columns[at].cast(pa.binary()).to_pylist()], pa.binary())
            yield pa.RecordBatch.from_arrays(columns, names=batch.schema.names)

    return texts.mapInArrow(run, ", ".join(f"{c} {'binary' if c == 'text' else k}" for c, k in texts.dtypes))


def _heads(rows: DataFrame, buckets: int) -> DataFrame:
    """(source, bucket, start): where each bucket of documents begins in its source's stream of words."""
    words = rows.groupBy("source", _bucket(buckets)).agg(F.sum("size").alias("words"))
    before = Window.partitionBy("source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    return words.select("source", "bucket", F.coalesce(F.sum("words").over(before), F.lit(0)).cast("long").alias("start"))


def _slices(words: Words, own: Draws, by_block: bool) -> tuple[np.ndarray, list[bytes]]:
    """The first draw of each output text, and the texts: one for each block, or for each document, pass and shard.

    Neighbouring blocks are joined as they stand, others by a space.
    """
    at = words.first[own.row]
    size = words.size[own.row]
    padded = np.append(words.start, len(words.data))
    a = np.where(own.begin == 0, words.text[own.row], padded[at + own.begin])
    z = np.where(own.end == size, words.text[own.row + 1], padded[at + own.end])
    data = words.data.tobytes()
    if by_block or not len(a):
        return np.arange(len(a)), [data[i:j] for i, j in zip(a.tolist(), z.tolist())]
    group = np.ones(len(a), bool)
    group[1:] = (own.row[1:] != own.row[:-1]) | (own.turn[1:] != own.turn[:-1]) | (own.shard[1:] != own.shard[:-1])
    apart = group.copy()
    apart[1:] |= own.begin[1:] != own.end[:-1]
    first = np.flatnonzero(apart)
    parts = [data[i:j] for i, j in zip(a[first].tolist(), z[np.append(first[1:], len(a)) - 1].tolist())]
    heads = np.flatnonzero(group[first])
    out = []
    for i, j in zip(heads.tolist(), np.append(heads[1:], len(first)).tolist()):
        out.append(parts[i] if j == i + 1 else b"".join(x if x[-1:].isspace() else x + b" " for x in parts[i : j - 1]) + parts[j - 1])
    return first[heads], out


def dealt(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", by_block: bool = True, carried: tuple[str, ...] | None = None, **parameters) -> tuple[DataFrame, Plan]:
    """The drawn texts, dealt to their shards and in the order of their places, and the plan.

    Rows have `spot`, the place in the row of all shards, and `words`, the text. With `carried` columns they have shard, place and pass
    too, and the columns as a struct `row` with the fields c0, c1, ... Without, they have `start`, where the document stands in all sources'
    words, and every document has a row of its own besides, with a negative spot, its doc_id, source and size; as documents
    without a word stand nowhere, `lone` tells them apart.

    Documents of a source are ordered by bucket, then id and text digest; a bucket is a hash of these and begins with a row
    that tells where it stands in the stream, so that a source with a third of all rows is ordered in many tasks by one shuffle.
    """
    spark = docs.sparkSession
    rows = cut(sized(docs, id_col, text_col, source_col))
    plan = planned(rows, **parameters)
    passes = parameters.get("passes", MOST_PASSES)
    buckets = max(1, -(-max(plan.size, default=0) // BUCKET))
    row = [F.struct(*(F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(carried or ()))).alias("row")] if carried else []
    texts = docs.select(*_keyed(docs, id_col, text_col, source_col), *row).select("source", _bucket(buckets), F.lit(1).alias("edge"), F.lit(0).cast("long").alias("start"), "doc_id", "digest", "text", *(["row"] if carried else []))
    none = [F.lit(None).cast("long").alias("doc_id"), F.lit(0).cast("long").alias("digest"), F.lit(b"").alias("text"), *([F.lit(None).cast(texts.schema["row"].dataType).alias("row")] if carried else [])]
    stream = _compressed(texts).union(_heads(rows, buckets).select("source", "bucket", F.lit(0).alias("edge"), "start", *none))
    stream = stream.repartition("source", "bucket").sortWithinPartitions("source", "bucket", "edge", "doc_id", "digest")
    names = pa.array(plan.names, pa.string())
    base = np.cumsum((0, *plan.size), dtype=np.int64)
    shards = np.cumsum(np.append(0, plan.before[:, -1]))
    kind = "spot long, words string, start long, lone long, doc_id long, source string, size long"
    if carried is not None:
        kind = "spot long, words string, shard int, place long, pass int" + (f", row {texts.schema['row'].dataType.simpleString()}" if carried else "")
    fields = [x.split(" ")[0] for x in kind.split(", row")[0].split(", ")] + (["row"] if carried else [])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        read = zstandard.ZstdDecompressor().decompress
        offset_so_far = number_so_far = 0  # of the bucket that the last batch ended in
        for whole in batches:
            for batch in slices(whole, 6, TOGETHER):
                head = np.flatnonzero(batch.column(2).to_numpy() == 0)
                words = words_of(pa.array([read(x) if x else x for x in batch.column(6).to_pylist()], pa.large_binary()))
                size, n = words.size, batch.num_rows
                passed, place = np.cumsum(size) - size, np.arange(n)
                cell = np.zeros(n, np.int64)
                cell[head] = 1
                cell = np.cumsum(cell)
                begins = np.append(offset_so_far, batch.column(3).to_numpy()[head]) - np.append(0, passed[head])
                counts = np.append(number_so_far, np.full(len(head), -1)) - np.append(0, place[head])
                offset, number = begins[cell] + passed, counts[cell] + place
                offset_so_far, number_so_far = int(offset[-1] + size[-1]), int(number[-1] + 1)
                source = pc.index_in(batch.column(0), value_set=names).to_numpy(zero_copy_only=False).astype(np.int64)
                own = drawn(plan, source, offset, size, passes)
                first, made = _slices(words, own, by_block)
                who, shard, at = own.row[first], own.shard[first], own.place[first]
                spot, text = pa.array(shards[shard] + at, pa.int64()), pa.array(made, pa.binary()).cast(pa.string())
                if carried is not None:
                    more = [batch.column(7).take(pa.array(who, pa.int64()))] if carried else []
                    yield pa.RecordBatch.from_arrays([spot, text, pa.array(shard, pa.int32()), pa.array(at, pa.int64()), pa.array(own.turn[first], pa.int32()), *more], names=fields)
                    continue
                start = base[source] + offset
                none = [pa.nulls(len(who), t) for t in (pa.int64(), pa.int64(), pa.string(), pa.int64())]
                yield pa.RecordBatch.from_arrays([spot, text, pa.array(start[who], pa.int64()), *none], names=fields)
                real = np.flatnonzero(batch.column(2).to_numpy() == 1)
                index, empty = pa.array(real, pa.int64()), size[real] == 0
                lone = pa.array((batch.column(1).to_numpy()[real] << 32) + number[real], pa.int64(), mask=~empty)
                ids = [batch.column(4).take(index), batch.column(0).take(index), pa.array(size[real], pa.int64())]
                away = -1 - (offset[real] + number[real])  # over many pieces
                yield pa.RecordBatch.from_arrays([pa.array(away, pa.int64()), pa.array([""] * len(real), pa.string()), pa.array(np.where(empty, -1 - source[real], start[real]), pa.int64()), lone, *ids], names=fields)

    on_workers(spark)
    piece = max(1, min(PIECE, int(shards[-1]) // (PIECES * int(spark.conf.get("spark.sql.shuffle.partitions")))))
    return stream.mapInArrow(run, kind).repartition(F.floor(F.col("spot") / piece)).sortWithinPartitions("spot"), plan


def allotment(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", **parameters) -> DataFrame:
    """(doc_id, source, size, source_size, target, taken, blocks, dealt): what the mix takes of each row of `docs`.

    The mix is made: blocks are drawn, dealt to their shards with their text and put in their places there; `taken` counts the
    words of a row's blocks as the shards hold them, and `dealt` sums a hash of the blocks' places.

    A null text has no words and none are taken; a null source is a source of its own, the last in order. A null id is an id. Repeated
    rows are drawn one by one. Very long texts are cut into blocks like any other. Targets are met to within a block, ties between
    documents go by text digest, and no document is taken more than twice. An empty table gives an empty result; extra columns of any name are not read.
    """
    rows, plan = dealt(docs, id_col, text_col, source_col, **parameters)
    sizes, wanted = np.array(plan.size, np.int64), np.array(plan.target, np.float64)
    names = pa.array(plan.names, pa.string())

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(words_of(batch.column(1)).size, pa.int64()), *batch.columns[2:]], names=["spot", "taken", *batch.schema.names[2:]])

    def told(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            s = pc.index_in(batch.column(1), value_set=names).to_numpy(zero_copy_only=False).astype(np.int64)
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(sizes[s]), pa.array(wanted[s]), *batch.columns[3:]], names=["doc_id", "source", "size", "source_size", "target", "taken", "blocks", "dealt"])

    held = rows.mapInArrow(counted, "spot long, taken long, start long, lone long, doc_id long, source string, size long")
    block = F.col("spot") >= 0
    sums = [F.sum("taken").alias("taken"), F.count_if(block).alias("blocks"), F.sum(F.when(block, F.pmod(F.xxhash64("spot"), F.lit(1 << 32))).otherwise(0)).alias("dealt")]
    own = held.groupBy("start", "lone").agg(F.max("doc_id").alias("doc_id"), F.max("source").alias("source"), F.max("size").alias("size"), *sums)
    kind = "doc_id long, source string, size long, source_size long, target double, taken long, blocks long, dealt long"
    return own.select("doc_id", "source", "size", "taken", "blocks", "dealt").mapInArrow(told, kind)


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", by_block: bool = True, **parameters) -> DataFrame:
    """The mix itself: `docs`' columns with the text drawn, plus shard, position and pass, in the shards' order.

    by_block: a row for each block drawn. Otherwise a row for each document, pass and shard with all its text in that shard, at the
    place of the first of its blocks; a document that a shard takes whole keeps its text as it is. A column of `docs` that is called
    shard, position or pass is returned with `_doc` added to its name. Other odd rows are treated as in allotment().
    """
    carried = tuple(c for c in docs.columns if c != text_col)
    out, _ = dealt(docs, id_col, text_col, source_col, by_block, carried, **parameters)
    own = {"shard", "position", "pass"}
    back = {c: F.col(f"row.c{i}").alias(f"{c}_doc" if c in own else c) for i, c in enumerate(carried)}
    return out.select(*(F.col("words").alias(text_col) if c == text_col else back[c] for c in docs.columns), "shard", F.col("place").alias("position"), "pass")


def digest(found: DataFrame) -> DataFrame:
    return found.select("doc_id", "size", "source_size", "target", "taken", "blocks", "dealt")
