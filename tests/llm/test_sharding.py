"""Shards against a plain sort in Python."""

from __future__ import annotations

import zlib
from collections import Counter

import pytest
from pyspark.sql import functions as F

from mound.llm import sharding


def brute(rows, shards):
    """rows: (doc_id, source, h); the position of each in the order of fractional ranks."""
    per = {}
    for r in rows:
        per.setdefault(r[1], []).append(r)
    order = []
    for source, own in per.items():
        for i, r in enumerate(sorted(own, key=lambda r: r[2])):
            order.append(((i + 0.5) / len(own), "n" if source is None else "s" + source, i, r[0]))
    order.sort()
    n, out, fill = len(order), {}, Counter()
    for place, (*_, doc) in enumerate(order):
        shard = place * shards // n
        out[doc] = (shard, fill[shard])
        fill[shard] += 1
    return out


@pytest.mark.parametrize("blocks,block", [(1, 10**6), (64, 10), (7, 3)])
def test_assign(spark, documents, blocks, block):
    rows = [(i, f"t{i % 50}", "hot" if i % 3 else ("b", "c", None)[i % 7 % 3]) for i in range(500)]
    digest = sharding.digest(documents(rows)).cache()
    got = {r.doc_id: (r.shard, r.slot) for r in sharding.assign(digest, 16, blocks, block).collect()}
    assert got == brute([(r.doc_id, r.source, r._h) for r in digest.collect()], 16)


def test_shard_documents(documents):
    rows = [(i, "é" * (i % 9), "ab"[i % 5 == 0]) for i in range(333)]
    out = sharding.shard_documents(documents(rows)).collect()
    sizes = Counter(r.shard for r in out)
    assert set(sizes) == set(range(16)) and max(sizes.values()) - min(sizes.values()) <= 1
    for shard, n in sizes.items():
        assert sorted(r.slot for r in out if r.shard == shard) == list(range(n))
        share = sum(r.source == "b" for r in out if r.shard == shard) / n
        assert abs(share - 67 / 333) < 0.08
    for r in out:
        text = ("é" * (r.doc_id % 9)).encode()
        assert (r.size, r.text_crc32, r.law, r.grown_shard) == (len(text) + 1, zlib.crc32(text), "rows", None)


def test_odd_rows(documents):
    rows = [(1, None, None), (None, "", "a"), (None, None, None), (5, "x", "a"), (5, "x", "a"), (6, "y" * 200_000, "a")]
    docs = documents(rows).withColumn("shard", F.lit("mine")).withColumn("_part", F.lit(1))
    out = sharding.shard_documents(docs).collect()
    assert len(out) == 6 and len({(r.shard, r.slot) for r in out}) == 6
    assert sorted(r.size for r in out) == [1, 1, 1, 2, 2, 200_001]
    assert sharding.shard_documents(docs.limit(0)).count() == 0
