"""SimHash near-duplicates by a segment-popcount embedding.

Every fingerprint is cut into 32 segments of two bits. Its embedding holds the popcount of each
segment in unary (0: 00, 1: 01, 2: 11), so the popcount of the XOR of two embeddings is the
Manhattan distance of their popcount vectors, and never exceeds the Hamming distance.

The range join "Manhattan distance <= d" runs on a grid: the segments are dealt into G groups.
At most d groups can differ, so a pair within d has equal popcounts in at least G - d groups; each
fingerprint goes to one cell for every choice of G - d groups. Within a cell, pairs are held
against the Manhattan bound and then verified exactly. No pair is lost for any G > d; a larger G
makes cells smaller and more numerous, and follows the number of distinct fingerprints.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import arrow_map, as_bytes, cut, on_workers
from .components import components

SEED, SHINGLE, MOST_BITS = 42, 4, 4
SEGMENTS = 32
#: Bits of information in the popcount of two fair bits.
SEGMENT_BITS = 1.5
#: Cells with more members are searched breadth first instead of pair by pair.
SMALL_CELL = 24
#: A fingerprint that more than one in so many rows have is hot; there can't be more hot ones than this.
HOT = 10_000
LOW_BITS = 0x5555555555555555


def shingle_hashes(text: bytes, width: int = SHINGLE) -> list[int]:
    words = text.lower().split()  # bytes: A-Z only, and ASCII white space only
    if not words:
        return []
    if len(words) < width:
        return [xxhash.xxh64_intdigest(b" ".join(words), SEED)]
    joined, ends, starts, at = b" ".join(words), [], [], 0
    for word in words:
        starts.append(at)
        at += len(word)
        ends.append(at)
        at += 1
    digest = xxhash.xxh64_intdigest
    return [digest(joined[a:b], SEED) for a, b in zip(starts, ends[width - 1 :])]


def fingerprint_batch(texts: list[bytes], width: int = SHINGLE) -> np.ndarray:
    """uint64 fingerprints; 0 for texts without a word."""
    out = np.zeros(len(texts), np.uint64)
    for i, text in enumerate(texts):
        if hashes := shingle_hashes(text, width):
            votes = np.zeros(64, np.int64)
            values = np.array(hashes, np.uint64)
            for at in range(0, len(values), 1 << 16):
                part = values[at : at + (1 << 16)]
                votes += np.unpackbits(part.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
            out[i] = np.packbits(votes * 2 > len(values), bitorder="little").view("<u8")[0]
    return out


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = SHINGLE, carried: tuple[str, ...] = ()) -> DataFrame:
    """(doc_id, fp, *carried): the 64 bits of each whole text's SimHash, as a signed long, with the columns of the row that are carried."""
    own = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.col(f"`{text_col}`").alias("text"), *(F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(carried)))
    names = ["doc_id", "fp", *own.columns[2:]]

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        fp = fingerprint_batch(as_bytes(batch.column(1)), width).view(np.int64)
        return pa.RecordBatch.from_arrays([batch.column(0), pa.array(fp), *batch.columns[2:]], names=names)

    on_workers(docs.sparkSession)
    found = own.mapInArrow(arrow_map(run), ", ".join(["doc_id long", "fp long", *(f"{x} {t}" for x, t in own.dtypes[2:])]))
    return found.select("doc_id", "fp", *(F.col(f"c{i}").alias(c) for i, c in enumerate(carried)))


def embed(fp: np.ndarray) -> np.ndarray:
    low, half = np.uint64(LOW_BITS), fp >> np.uint64(1)
    return ((fp | half) & low) | (((fp & half) & low) << np.uint64(1))


def embed_column(fp: Column) -> Column:
    low, half = F.lit(LOW_BITS), F.shiftrightunsigned(fp, 1)
    return (fp.bitwiseOR(half).bitwiseAND(low)).bitwiseOR(F.shiftleft(fp.bitwiseAND(half).bitwiseAND(low), 1))


def masks(groups: int, bits: int = MOST_BITS) -> list[int]:
    """For each choice of groups - bits groups, the 64-bit mask of their segments."""
    if not bits < groups <= SEGMENTS:
        raise ValueError("more groups than bits are needed, and no more than segments")
    own = [sum(3 << (2 * s) for s in range(SEGMENTS) if s % groups == g) for g in range(groups)]
    return [sum(chosen) for chosen in combinations(own, groups - bits)]


def groups_for(distinct: int, bits: int = MOST_BITS) -> int:
    """The fewest groups whose cells hold about one of `distinct` spread-out fingerprints."""
    for groups in range(bits + 2, SEGMENTS + 1):
        if SEGMENTS * SEGMENT_BITS * (groups - bits) / groups >= math.log2(max(distinct, 1)) + 1 or math.comb(groups, bits) > 3000:
            return groups
    return SEGMENTS


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def links_in_cell(fp: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Links that connect the members of one large cell: a spanning forest, found breadth first."""
    left, code, a, b = fp, embed(fp), [], []
    while len(left):
        queue, left, code = [left[0]], left[1:], code[1:]
        while queue and len(left):
            x = queue.pop()
            near = np.bitwise_count(code ^ embed(np.array([x], np.uint64))[0]) <= bits
            near[near] = np.bitwise_count(left[near] ^ x) <= bits
            if near.any():
                found = left[near]
                queue.extend(found)
                b.append(found)
                a.append(np.full(len(found), x, np.uint64))
                left, code = left[~near], code[~near]
    empty = [np.zeros(0, np.uint64)]
    return np.concatenate(a or empty), np.concatenate(b or empty)


def links_in_cells(cell: np.ndarray, fp: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Links among rows of equal cell; rows are sorted by cell."""
    first = np.flatnonzero(np.r_[True, cell[1:] != cell[:-1]])
    size = np.diff(np.r_[first, len(cell)])
    a, b = [], []
    for at, n in zip(first[size > SMALL_CELL], size[size > SMALL_CELL]):
        x, y = links_in_cell(fp[at : at + n], bits)
        a.append(x)
        b.append(y)
    keep = np.repeat((size > 1) & (size <= SMALL_CELL), size)
    cell, fp = cell[keep], fp[keep]
    code = embed(fp)
    for step in range(1, SMALL_CELL):
        at = np.flatnonzero(cell[step:] == cell[:-step])
        if not len(at):
            break
        at = at[np.bitwise_count(code[at] ^ code[at + step]) <= bits]
        at = at[np.bitwise_count(fp[at] ^ fp[at + step]) <= bits]
        a.append(fp[at])
        b.append(fp[at + step])
    empty = [np.zeros(0, np.uint64)]
    return np.concatenate(a or empty), np.concatenate(b or empty)


NODE = "struct<none: boolean, low: bigint, fp: bigint>"


def node(low: Column, fp: Column) -> Column:
    """A fingerprint as a node of the graph: nodes are in the order of their smallest doc_id (null last), so that the root of a component has the component's."""
    return F.struct(low.isNull().alias("none"), F.coalesce(low, F.lit(0)).alias("low"), fp.alias("fp"))


def links(distinct: DataFrame, bits: int = MOST_BITS, groups: int | None = None) -> DataFrame:
    """(a, b): links between nodes that connect all fingerprints within `bits` of each other.

    distinct: (fp, low), each fingerprint once with its smallest doc_id, which travels with it, so that no join by fingerprint follows.
    """
    code = embed_column(F.col("fp"))
    cells = F.array(*(F.xxhash64(F.lit(i), code.bitwiseAND(F.lit(_signed(m)))) for i, m in enumerate(masks(groups or groups_for(distinct.count(), bits), bits))))
    rows = distinct.select(F.explode(cells).alias("cell"), "fp", F.coalesce("low", F.lit(0)).alias("low"), F.col("low").isNull().alias("none"))
    rows = rows.repartition("cell").sortWithinPartitions("cell", "fp")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def found(cell: np.ndarray, fp: np.ndarray, low: np.ndarray, none: np.ndarray) -> pa.RecordBatch:
            ends = links_in_cells(cell, fp, bits)
            order = np.argsort(fp, kind="stable")
            made = []
            for x in ends:
                at = order[np.searchsorted(fp[order], x)]
                made.append(pa.StructArray.from_arrays([pa.array(none[at]), pa.array(low[at]), pa.array(x.view(np.int64))], names=["none", "low", "fp"]))
            return pa.RecordBatch.from_arrays(made, names=["a", "b"])

        held: list[tuple[np.ndarray, ...]] = []  # of the last cell, which the next batch may go on with
        for batch in batches:
            own = (batch.column(0).to_numpy(), batch.column(1).to_numpy().view(np.uint64), batch.column(2).to_numpy(), batch.column(3).to_numpy(zero_copy_only=False))
            cell = own[0]
            if not len(cell):
                continue
            last = int(np.searchsorted(cell, cell[-1]))
            if last or (held and held[-1][0][0] != cell[0]):
                yield found(*(np.concatenate(x) for x in zip(*held, tuple(x[:last] for x in own))))
                held = []
            held.append(tuple(x[last:] for x in own))
        if held:
            yield found(*(np.concatenate(x) for x in zip(*held)))

    on_workers(distinct.sparkSession)
    return rows.mapInArrow(run, f"a {NODE}, b {NODE}").distinct()


def rooted(distinct: DataFrame, bits: int = MOST_BITS) -> DataFrame:
    """`distinct` (fp, low, ...) with `root`, the node that is its component's smallest; its own where it has no link."""
    found = components(links(distinct.select("fp", "low"), bits)).select(F.col("node.fp").alias("fp"), F.col("root").alias("found"))
    return distinct.join(found, "fp", "left").withColumn("root", F.coalesce("found", node(F.col("low"), F.col("fp")))).drop("found")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", bits: int = MOST_BITS, width: int = SHINGLE) -> DataFrame:
    """(doc_id, fp, component_id): the smallest doc_id reachable over fingerprints that differ in at most `bits` bits.

    Null texts count as empty and texts without a word have fingerprint 0, linked like any other; very long texts are read whole. Repeated
    rows each get a row, and equal ids may be in several components. A null doc_id is never the smallest unless the component has no other.
    An empty table gives an empty result; columns besides the two are not read, whatever their names. Copies meet as one distinct
    fingerprint and are never expanded into pairs; nothing is grouped or joined by component, and fingerprints of very many
    rows get theirs by a broadcast.
    """
    own = cut(fingerprints(docs, id_col, text_col, width))
    distinct = cut(own.groupBy("fp").agg(F.min("doc_id").alias("low"), F.count("*").alias("copies")))
    member = cut(rooted(distinct, bits).select("fp", "copies", F.when(~F.col("root.none"), F.col("root.low")).alias("component_id")))
    most = member.agg(F.sum("copies") / HOT).scalar()
    hot = F.broadcast(member.where(F.col("copies") > most).select("fp", "component_id"))  # HOT rows at most
    rest = own.join(hot.select("fp"), "fp", "left_anti").join(member.where(F.col("copies") <= most), "fp")
    return own.join(hot, "fp").select("doc_id", "fp", "component_id").union(rest.select("doc_id", "fp", "component_id"))


def digest(found: DataFrame) -> DataFrame:
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
