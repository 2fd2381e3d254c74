"""Byte-level BPE with a two-tier lookup.

Tier one: a minimal perfect hash over the vocabulary resolves a pre-token that is itself a
vocabulary entry with two array reads and one comparison. Tier two: any other pre-token is
merged bottom up with a heap over a linked list of its bytes, lowest rank first and leftmost
among equals. A bounded memo stands in front of both, as pre-tokens repeat.
"""

from __future__ import annotations

import base64
import functools
import hashlib
import heapq
import re
from collections.abc import Callable, Iterator
from itertools import chain

import pyarrow as pa
import regex
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import arrow_map, id_and_text, on_workers

#: Entries of the memo before the older half is dropped; bounds a worker's memory.
MEMO = 600_000
#: Vocabulary files larger than this aren't broadcast.
MOST_BYTES = 64 << 20
#: Above 2 ** 32, so that displacements reach every slot.
PRIME = 4_294_967_311
#: The pattern's classes are Unicode's; white space is the White_Space property.
SPACE = r"[\t-\r \x85\xa0  -     　]"


class PerfectHash:
    """Minimal perfect hash by hash-and-displace: n keys take the slots 0 .. n - 1."""

    def __init__(self, keys: list[bytes]):
        self.n = n = len(keys)
        self.buckets = max(1, n // 2)
        self.shift = [0] * self.buckets
        self.slot_key = [0] * n
        members: list[list[tuple[int, int, int]]] = [[] for _ in range(self.buckets)]
        for k, key in enumerate(keys):
            h = xxhash.xxh3_128_intdigest(key)
            members[(h >> 96) % self.buckets].append((h & 0xFFFFFFFF, (h >> 32) & 0xFFFFFFFF | 1, k))
        free = bytearray(b"\1") * n
        for b in sorted((b for b in range(self.buckets) if len(members[b]) > 1), key=lambda b: -len(members[b])):
            for d in range(64 * n):
                slots = []
                for low, step, _ in members[b]:
                    slot = (low + d * step) % PRIME % n
                    if not free[slot] or slot in slots:
                        break
                    slots.append(slot)
                else:
                    break
            else:
                raise ValueError("repeated keys")
            self.shift[b] = d
            for slot, (_, _, k) in zip(slots, members[b]):
                free[slot], self.slot_key[slot] = 0, k
        single = (b for b in range(self.buckets) if len(members[b]) == 1)
        for b, slot in zip(single, [slot for slot in range(n) if free[slot]]):  # a bucket with one key names its slot
            self.shift[b], self.slot_key[slot] = -1 - slot, members[b][0][2]

    def candidate(self, key: bytes) -> int:
        """The one key that `key` can be; the caller compares."""
        h = xxhash.xxh3_128_intdigest(key)
        d = self.shift[(h >> 96) % self.buckets]
        return self.slot_key[-1 - d if d < 0 else ((h & 0xFFFFFFFF) + d * ((h >> 32) & 0xFFFFFFFF | 1)) % PRIME % self.n]


def read_ranks(data: bytes) -> dict[bytes, int]:
    return {base64.b64decode(a): int(b) for a, b in (line.split() for line in data.splitlines() if line)}


@functools.cache
def _ranges(kind: str) -> str:
    """The Basic Multilingual Plane's characters of a Unicode class, as ranges for a set in `re`."""
    plane = "".join(chr(i) for i in range(0x10000) if not 0xD800 <= i < 0xE000)
    return "".join(f"\\u{ord(m[0]):04x}-\\u{ord(m[-1]):04x}" for m in regex.findall(rf"\p{{{kind}}}+", plane))


def splitter(pattern: str) -> Callable[[str], list[str]]:
    """findall() of `pattern`. Texts without characters beyond the Basic Multilingual Plane take `re`, which is faster, if `re` can tell the pattern."""
    whole = regex.compile(pattern.replace(r"[^\s", "[^" + SPACE[1:-1]).replace(r"\s", SPACE).replace(r"(?!\S)", f"(?!{'[^' + SPACE[1:]})"))
    if re.search(r"\[[^]]*\[", whole.pattern) or not re.fullmatch(r"[ '\w|?+*^()!\[\]]*", re.sub(r"\\p\{[LN]\}|\\s|\(\?!\\S\)", "", pattern)):
        return whole.findall

    def spelled(m: re.Match[str]) -> str:
        own = re.sub(r"\\p\{([LN])\}", lambda x: _ranges(x[1]), m[0])
        return own if m[0][0] == "[" else f"[{own}]"

    sets = re.sub(r"\[[^]]*\]|\\p\{[LN]\}", spelled, whole.pattern)
    plain, beyond = re.compile(sets).findall, re.compile("[\U00010000-\U0010ffff]").search
    return lambda text: plain(text) if text.isascii() or not beyond(text) else whole.findall(text)


class Memo(dict):
    """What `resolve` has found, which it puts here itself."""

    def __init__(self, resolve: Callable[[str], tuple[int, ...]]):
        super().__init__()
        self.resolve = resolve

    def __missing__(self, token: str) -> tuple[int, ...]:
        return self.resolve(token)


class ByteBPE:
    def __init__(self, ranks: dict[bytes, int], pattern: str):
        self.ranks = ranks
        self.keys = list(ranks)
        self.ids = list(ranks.values())
        self.hash = PerfectHash(self.keys)
        self.bytes_of = {i: k for k, i in ranks.items()}
        self.spelled = {i: str(i) for i in self.ids}
        self.split = splitter(pattern)
        self.memo = Memo(self._resolve)
        self.old: dict[str, tuple[int, ...]] = {}

    def whole(self, piece: bytes) -> int | None:
        """Tier one."""
        at = self.hash.candidate(piece)
        return self.ids[at] if self.keys[at] == piece else None

    def merged(self, piece: bytes) -> list[int]:
        """Tier two."""
        n, ranks, get = len(piece), self.ranks, self.ranks.get
        before, end = list(range(-1, n - 1)), list(range(1, n + 1))  # a part ends where the next one begins; 0: merged into the one before
        heap = [(r, i, i + 2) for i in range(n - 1) if (r := get(piece[i : i + 2])) is not None]
        heapq.heapify(heap)
        while heap:
            _, i, stop = heapq.heappop(heap)
            if not (j := end[i]) or j >= n or end[j] != stop:
                continue  # one of the two has been merged since
            end[i], end[j] = stop, 0
            if stop < n:
                before[stop] = i
                if (r := get(piece[i : end[stop]])) is not None:
                    heapq.heappush(heap, (r, i, end[stop]))
            if (p := before[i]) >= 0 and (r := get(piece[p:stop])) is not None:
                heapq.heappush(heap, (r, p, stop))
        out, i = [], 0
        while i < n:
            out.append(ranks[piece[i : end[i]]])
            i = end[i]
        return out

    def _resolve(self, token: str) -> tuple[int, ...]:
        if (ids := self.old.get(token)) is None:
            piece = token.encode()
            one = self.whole(piece)
            ids = (one,) if one is not None else tuple(self.merged(piece))
        if len(token) <= 64:
            if len(self.memo) >= MEMO // 2:
                self.old = dict(self.memo)
                self.memo.clear()
            self.memo[token] = ids
        return ids

    def encode(self, text: str) -> list[int]:
        return list(chain.from_iterable(map(self.memo.__getitem__, self.split(text))))

    def decode(self, ids: list[int]) -> bytes:
        return b"".join(map(self.bytes_of.__getitem__, ids))

    def digest(self, ids: list[int]) -> str:
        return hashlib.sha256(",".join(map(self.spelled.__getitem__, ids)).encode()).hexdigest()


_coders: dict[tuple[str, str], ByteBPE] = {}


def coder(data: bytes, pattern: str) -> ByteBPE:
    """One coder for each vocabulary in a worker, whatever the number of tasks."""
    key = (hashlib.sha256(data).hexdigest(), pattern)
    if key not in _coders:
        _coders[key] = ByteBPE(read_ranks(data), pattern)
    return _coders[key]


#: Columns that encode() can return besides doc_id, with their types.
OUTPUTS = {"ids": "array<int>", "decoded": "binary", "n_tokens": "long", "ids_sha256": "string", "decoded_sha256": "string"}


def vocabulary(spark: SparkSession, path: str):
    """The vocabulary file's bytes, read on the driver and broadcast; its size is checked."""
    with open(path, "rb") as file:
        data = file.read()
    if len(data) > MOST_BYTES:
        raise ValueError(f"{path} is too large to broadcast")
    return spark.sparkContext.broadcast(data)


def encode(docs: DataFrame, path: str, pattern: str, outputs: tuple[str, ...] = ("ids",), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and the asked columns of OUTPUTS, one row for each row of `docs`, in one pass without a shuffle.

    Each match of `pattern` is encoded separately, without special tokens. A null text counts as empty:
    no ids, and digests of nothing. Rows with a null or repeated doc_id are kept as they are.
    """
    data = vocabulary(docs.sparkSession, path)
    kinds = {"ids": pa.list_(pa.int32()), "decoded": pa.binary(), "n_tokens": pa.int64(), "ids_sha256": pa.string(), "decoded_sha256": pa.string()}

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        own = coder(data.value, pattern)
        made: dict[str, list] = {name: [] for name in outputs}
        for text in batch.column(1).to_pylist():
            ids = own.encode(text or "")
            decoded = own.decode(ids) if {"decoded", "decoded_sha256"} & set(outputs) else b""
            for name, rows in made.items():
                rows.append(ids if name == "ids" else decoded if name == "decoded" else len(ids) if name == "n_tokens" else own.digest(ids) if name == "ids_sha256" else hashlib.sha256(decoded).hexdigest())
        return pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(rows, kinds[name]) for name, rows in made.items())], names=["doc_id", *outputs])

    on_workers(docs.sparkSession)
    return id_and_text(docs, id_col, text_col).mapInArrow(arrow_map(run), ", ".join(["doc_id long", *(f"{x} {OUTPUTS[x]}" for x in outputs)]))


def decode(encoded: DataFrame, path: str, pattern: str, ids_col: str = "ids") -> DataFrame:
    """(doc_id, decoded binary): the inverse of encode(). Null ids decode to nothing."""
    data = vocabulary(encoded.sparkSession, path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own = coder(data.value, pattern)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([own.decode(ids or []) for ids in batch.column(1).to_pylist()], pa.binary())], names=["doc_id", "decoded"])

    on_workers(encoded.sparkSession)
    return encoded.select(F.col("doc_id").cast("long"), ids_col).mapInArrow(run, "doc_id long, decoded binary")
