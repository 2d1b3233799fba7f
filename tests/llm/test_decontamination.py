"""Suffix arrays, hits and longest matches against brute force; odd rows; the DuckDB text."""

from __future__ import annotations

import hashlib
import random
import re

import numpy as np
import pytest

from mound.llm import decontamination as dc
from mound.llm.queries import ORACLES, QUERIES
from tests.conftest import SF
from tests.oracle_check import connect, differences

ITEM = "item_id string, text string"


def words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def brute(text, items, window=10):
    """Hit words and items of a text, by comparing every window with every place."""
    w, hit, names = words(text), set(), set()
    for name, t in items:
        x = words(t)
        size = min(window, len(x))
        for i in range(len(x) - size + 1) if x else ():
            for j in range(len(w) - size + 1):
                if w[j : j + size] == x[i : i + size]:
                    hit.update(range(j, j + size))
                    names.add(name or "")
    return len(w), hit, sorted(names)


def test_words_are_those_of_the_contract():
    text = "Ab-CD'e É9 ÑandÚ x\tÄÖ_q\x00z 東京"
    assert [w.decode() for w in dc.words_of(text)] == words(text)


@pytest.mark.parametrize("alphabet", [2, 3, 40, 5_000_000])
def test_suffix_array(alphabet):
    rng = np.random.default_rng(alphabet)
    ids = rng.integers(0, alphabet, 400)
    ids = np.concatenate([ids, ids[:150], [0], np.ones(60, int)])

    def suffix(i):
        tail = ids[i : i + 64].tolist()
        return tail[: tail.index(0)] if 0 in tail else tail

    got = dc.suffix_array(ids, 64)
    assert sorted(got.tolist()) == np.flatnonzero(ids).tolist()
    keys = [suffix(i) for i in got.tolist()]
    assert keys == sorted(keys)


def corpus(seed, n=40):
    """Texts of few words, so that windows repeat within and across items."""
    rng = random.Random(seed)
    vocabulary = ["aa", "bb", "ÉÉ", "d1", "Zz"]
    text = lambda k: " ".join(rng.choice(vocabulary) for _ in range(k))
    items = [(str(i), text(rng.choice([3, 9, 10, 11, 25]))) for i in range(12)] + [("x", "--"), ("y", ""), ("3", text(14))]
    texts = [text(rng.randint(0, 60)) for _ in range(n)] + ["", " ; "]
    texts += [f"{text(20)}, {rng.choice(items)[1]} {text(3)}" for _ in range(n)]
    return texts, items


@pytest.mark.parametrize("seed", range(6))
@pytest.mark.parametrize("size", [7, 50, 10_000])
def test_hits_against_brute_force(seed, size):
    texts, items = corpus(seed)
    spans, names = dc.leaks(texts, dc.index(items), size)
    for text, s, i in zip(texts, spans, names):
        _, hit, want = brute(text, items)
        assert [k for a, b in s for k in range(a, b)] == sorted(hit)
        assert sorted(i) == want


def test_find_in_blocks_and_odd_rows(spark):
    texts, items = corpus(9, 10)
    texts += [None, texts[-1]]
    rows = [(i if i % 7 else None, t, float(i), "mine") for i, t in enumerate(texts)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n_words double, leak string")
    bench = spark.createDataFrame([*items, (None, items[4][1]), ("z", None)], ITEM)
    want = sorted((r[0] or -1, r[2], *brute(r[1], [*items, ("", items[4][1])])[::2]) for r in rows)
    for block in (1 << 20, 60):
        got = dc.find(docs, bench, shard=100, block=block)
        assert got.columns == ["doc_id", "text", "n_words", "leak"]
        found = got.collect()
        assert sorted((r.doc_id or -1, r.n_words, r.leak.n_words, r.leak["items"]) for r in found) == want
        assert all(r.leak.n_hit == len(brute(r.text, [*items, ("", items[4][1])])[1]) for r in found)
    kept = dc.remove(docs, bench)
    assert kept.columns == docs.columns
    assert sorted(r.n_words for r in kept.collect()) == sorted(r[2] for r in rows if not brute(r[1], [*items, ("", items[4][1])])[1])


def test_very_long_text_and_hot_passage(spark):
    item = " ".join(f"w{i}" for i in range(30))
    long = "x " * 150_000 + item + " y" * 150_000 + " " + item.upper()
    docs = spark.createDataFrame([(0, long), *((i, f"a {item} b") for i in range(1, 200))], "doc_id long, text string")
    got = dc.find(docs, spark.createDataFrame([("7", item)], ITEM), shard=100_000).select("doc_id", "leak.*").collect()
    spans = {r.doc_id: [tuple(s) for s in r.spans] for r in got}
    assert spans.pop(0) == [(150_000, 150_030), (300_030, 300_060)]
    assert set(map(tuple, spans.values())) == {((1, 31),)}


def test_empty_tables(spark):
    docs = spark.createDataFrame([(1, "a b")], "doc_id long, text string")
    none = spark.createDataFrame([], ITEM)
    row = dc.digest(docs, none).first()
    assert (row.n_words, row.n_hit, row.n_items, row.contaminated) == (2, 0, 0, False)
    assert row.items_sha256 == hashlib.sha256(b"").hexdigest()
    assert dc.digest(docs.limit(0), spark.createDataFrame([("1", "a")], ITEM)).count() == 0
    assert dc.longest(docs, none).count() == 0


def test_longest_matches(spark):
    texts, items = corpus(3)
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    single = [i for k, i in enumerate(items) if i[0] not in {x[0] for x in items[:k]}]
    want = {}
    for name, t in single:
        x = words(t)
        for d, text in enumerate(texts):
            w = words(text)
            for i in range(len(x)):
                for j in range(len(w)):
                    n = 0
                    while i + n < len(x) and j + n < len(w) and x[i + n] == w[j + n]:
                        n += 1
                    if n >= 8:
                        want[name] = min(want.get(name, (0, 0, 0, 0)), (-n, d, j, i)) if name in want else (-n, d, j, i)
    got = dc.longest(docs, spark.createDataFrame(single, ITEM), least=8, shard=90).collect()
    assert {r.item_id: (-r.n_words, r.doc_id, r.doc_start, r.item_start) for r in got} == want


def test_duckdb(spark):
    assert differences(QUERIES["op11_decontamination"](spark, SF), connect(SF), ORACLES["op11_decontamination"]) == []
