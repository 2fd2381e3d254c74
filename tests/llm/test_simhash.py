import random
import re

import numpy as np
import pytest
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st

from assayer.llm import simhash
from assayer.llm.components import components

from .fixtures import DOCS, docs, rows


def plain_fingerprint(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    shingles = [" ".join(words[i : i + 4]) for i in range(len(words) - 3)] if len(words) >= 4 else [" ".join(words)] if words else []
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes)) if hashes else 0


def plain_components(values, bits=4):
    root = {v: v for v in values}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in values:
        for b in values:
            if (a ^ b).bit_count() <= bits:
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {v: find(v) for v in values}


@given(st.text(alphabet="aB \n\t\x1cé😀", max_size=60))
@settings(max_examples=100, deadline=None)
def test_fingerprint(text):
    assert int(simhash.fingerprint_batch([text.encode()])[0]) == plain_fingerprint(text)


def test_embedding_is_a_lower_bound():
    rng = np.random.default_rng(1)
    a, b = (rng.integers(0, 1 << 64, 2000, dtype=np.uint64) for _ in "ab")
    counts = lambda x: sum(np.abs(((a >> np.uint64(s)) & np.uint64(3)).astype(int) * 0 + np.bitwise_count((a >> np.uint64(s)) & np.uint64(3)).astype(int) - np.bitwise_count((x >> np.uint64(s)) & np.uint64(3)).astype(int)) for s in range(0, 64, 2))
    assert (np.bitwise_count(simhash.embed(a) ^ simhash.embed(b)) == counts(b)).all()
    assert (np.bitwise_count(simhash.embed(a) ^ simhash.embed(b)) <= np.bitwise_count(a ^ b)).all()


@pytest.mark.parametrize("groups", [6, 7, 9])
def test_no_pair_is_lost(groups):
    rng = random.Random(groups)
    for _ in range(300):
        a = rng.getrandbits(64)
        b = a
        for bit in rng.sample(range(64), rng.randint(0, 4)):
            b ^= 1 << bit
        x, y = (int(simhash.embed(np.array([v], np.uint64))[0]) for v in (a, b))
        assert any(x & m == y & m for m in simhash.masks(groups))


def test_large_cells_connect():
    rng = np.random.default_rng(2)
    base = rng.integers(0, 1 << 64, 5, dtype=np.uint64)
    fp = np.unique(np.concatenate([base, *(base ^ np.uint64(1 << i) for i in range(0, 60, 2))]))
    a, b = simhash.links_in_cell(fp, 4)
    assert (np.bitwise_count(a ^ b) <= 4).all()
    found = plain_components([int(x) for x in fp])
    root = {int(x): int(x) for x in fp}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for x, y in zip(a.tolist(), b.tolist()):
        x, y = find(x), find(y)
        root[max(x, y)] = min(x, y)
    assert {x: find(x) for x in root} == found


def test_components_of_a_chain(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, 101), (101, 100), (7, 7)]
    found = dict(map(tuple, components(spark.createDataFrame(edges, "a long, b long")).collect()))
    assert found == {**{i: 0 for i in range(41)}, 100: 100, 101: 100}


def test_near_duplicates(spark):
    given_rows = rows()
    found = simhash.near_duplicates(docs(spark)).collect()
    fp = [plain_fingerprint(r[1]) for r in given_rows]
    root = plain_components(set(fp))
    low = {}
    for r, f in zip(given_rows, fp):
        if r[0] is not None:
            low[root[f]] = min(low.get(root[f], r[0]), r[0])
    want = sorted((r[0] is not None, r[0] or 0, f, low.get(root[f])) for r, f in zip(given_rows, fp))
    assert sorted((r[0] is not None, r[0] or 0, r[1] % (1 << 64), r[2]) for r in found) == want


def test_empty(spark):
    assert simhash.near_duplicates(spark.createDataFrame([], DOCS)).count() == 0
