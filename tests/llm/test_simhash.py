"""Fingerprints, bit-sliced comparison and groups against plain Python."""

from __future__ import annotations

import random
import re

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from mound.llm import simhash
from mound.llm.components import components


def plain(text):
    lowered = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", lowered)
    if not words:
        return 0
    hashes = [xxhash.xxh64_intdigest(" ".join(words[i : i + 4]).encode(), 42) for i in range(max(1, len(words) - 3))]
    return sum(1 << k for k in range(64) if 2 * sum(h >> k & 1 for h in hashes) > len(hashes))


@pytest.mark.parametrize("text", ["", None, " \t ", "One", "a b c", "A b C d", "É x y z w \x1fq", "w " * 300, "the cat sat on the mat " * 9])
def test_fingerprint(text):
    assert simhash.fingerprint(text) == plain(text)


@pytest.mark.parametrize("radius", [0, 3, 4, 6])
def test_within(radius):
    rng = np.random.default_rng(radius)
    v = rng.integers(0, 2**63, 150, dtype=np.uint64)
    flips = [int(x) ^ sum(1 << int(k) for k in rng.choice(64, n % 9, replace=False)) for n, x in enumerate(v)]
    v = np.concatenate([v, np.array(flips, dtype=np.uint64)])
    n = len(v)
    last = rng.integers(0, n + 1, n)
    left, right = simhash.within(v, np.arange(n) + 1, last, radius)
    want = {(i, j) for i in range(n) for j in range(i + 1, last[i]) if bin(int(v[i]) ^ int(v[j])).count("1") <= radius}
    assert set(zip(left.tolist(), right.tolist())) == want


@pytest.mark.parametrize("cell,shared", [(3, 2), (2048, 2), (2048, 3)])
def test_linked(spark, cell, shared):
    rng = np.random.default_rng(1)
    fps = set()
    for x in rng.integers(0, 2**63, 40, dtype=np.uint64):
        y = int(x)
        for _ in range(12):
            y ^= sum(1 << int(k) for k in rng.choice(64, int(rng.integers(0, 6)), replace=False))
            fps.add(y)
    fps = sorted(fps)
    signed = [(x - (1 << 64) if x >> 63 else x,) for x in fps]
    got = components(simhash.linked(spark.createDataFrame(signed, "fp long"), cell=cell, shared=shared)).collect()
    root = {x: x for x in fps}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, x in enumerate(fps):
        for y in fps[:i]:
            if bin(x ^ y).count("1") <= 4:
                root[find(x)] = find(y)
    unsigned = lambda x: x & (2**64 - 1)
    groups = {}
    for r in got:
        groups.setdefault(r.component, set()).add(unsigned(r.node))
    want = {}
    for x in fps:
        want.setdefault(find(x), set()).add(x)
    assert {frozenset(g) for g in groups.values()} == {frozenset(g) for g in want.values() if len(g) > 1}


def test_components(spark):
    rng = random.Random(4)
    links = [(rng.randrange(300), rng.randrange(300)) for _ in range(220)] + [(5, None), (7, 7), (1000, 1001), (1001, 1000)]
    links += [(400 + i, 401 + i) for i in range(40)]
    got = {r.node: r.component for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    root = {}
    for a, b in links:
        if b is not None and a != b:
            for x in (a, b):
                root.setdefault(x, x)
            old, new = max(root[a], root[b]), min(root[a], root[b])
            root = {k: new if v == old else v for k, v in root.items()}
    assert got == root
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_groups_and_keep_one(documents):
    words = [f"w{i}" for i in range(400)]
    long = " ".join(words)
    near = " ".join(words[:399] + ["other"])
    rows = [(9, long), (4, near), (7, long), (3, None), (2, ""), (8, "b c d"), (8, "b c d"), (None, long), (None, None)]
    docs = documents(rows).withColumn("fp", F.lit("mine"))
    got = sorted((r.doc_id or -1, r.component_id) for r in simhash.groups(docs).collect())
    assert got == [(-1, 2), (-1, 4), (2, 2), (3, 2), (4, 4), (7, 4), (8, 8), (8, 8), (9, 4)]
    kept = simhash.keep_one(docs)
    # The rows without an id are copies of 4 and of 2.
    assert sorted(r.doc_id for r in kept.collect()) == [2, 4, 8]
    assert kept.columns == docs.columns
    assert simhash.groups(docs.limit(0)).count() == 0


def test_keep_one_of_every_group_with_repeated_ids(documents):
    one, two, three = (" ".join(f"{k}{i}" for i in range(300)) for k in "abc")
    # 5 is the smallest of the first group and not of the second; 7 is that of two groups.
    rows = [(5, one), (5, two), (3, two), (6, one), (7, three), (7, "short text"), (7, three)]
    kept = sorted((r.doc_id, r.text) for r in simhash.keep_one(documents(rows)).collect())
    assert kept == sorted([(5, one), (3, two), (7, three), (7, "short text")])


def test_keep_one_of_groups_without_ids(documents):
    """A group none of whose rows has an id keeps one; beside rows with an id, those without go."""
    one, two = (" ".join(f"{k}{i}" for i in range(300)) for k in "ab")
    near = one.rsplit(" ", 1)[0] + " other"
    assert simhash.groups(documents([(1, one), (2, near)])).filter("component_id = 1").count() == 2
    rows = [(None, one), (None, one), (None, near), (None, two), (6, two), (None, two)]
    kept = [(r.doc_id, r.text) for r in simhash.keep_one(documents(rows)).collect()]
    assert len(kept) == 2 and (6, two) in kept
    assert {k for k in kept if k[0] is None} < {(None, one), (None, near)}
