"""Counts and audit against plain Python; odd rows; the DuckDB text."""

from __future__ import annotations

import random
import re
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest

from mound.llm import divergence as dv
from mound.llm.queries import ORACLES, QUERIES
from tests.conftest import SF
from tests.oracle_check import connect, differences

KIND = "lang string, source string, text string, n long"


def terms(text):
    return [re.sub("[A-Z]", lambda m: m[0].lower(), t) for t in re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", text or "")]


def brute(docs, least=3, ranks=200):
    docs = [(a or "", b or "", terms(t)) for a, b, t, *_ in docs]
    seen, counts, out = defaultdict(Counter), defaultdict(Counter), []
    for lang, source, w in docs:
        seen[lang].update(set(w))
        counts[lang, source].update(w)
        counts[lang, None].update(w)
    for lang in {d[0] for d in docs}:
        kept = sorted(t for t, n in seen[lang].items() if n >= least)

        def chances(source):
            n = {t: counts[lang, source][t] for t in kept}
            return n, {t: 1 + 10**9 * (n[t] + 1) // (sum(n.values()) + len(kept)) for t in kept}

        sources = {d[1] for d in docs if d[0] == lang}
        q_lang = chances(None)[1]
        for s in sources:
            n, p = chances(s)
            pair = []
            for other in sources - {s}:
                q = chances(other)[1]
                pair.append((-sum((p[t] - q[t]) ** 2 // q[t] for t in kept), other.encode()))
            term = [(-((p[t] - q_lang[t]) ** 2 // q_lang[t]), t.encode()) for t in kept if n[t] > 0 and p[t] > q_lang[t]]
            for part, items in (("pair", sorted(pair)), ("term", sorted(term)[:ranks])):
                out += [(lang, s, part, i.decode(), -v, k + 1) for k, (v, i) in enumerate(items)]
    return sorted(out)


def made(seed, n=120):
    rng = random.Random(seed)
    vocabulary = ["a", "the", "Été", "x" * 8, "y" * 9, "z" * 16, "ab" * 9, "ab" * 9 + "c", "ñ" * 20, "Q" * 70, "straße", "東京", "東京都千代田区"]
    vocabulary += [f"{c}{d}" for c in "bcdef" for d in "uvw"]
    rows = []
    for _ in range(n):
        source = rng.choice(["s0", "s0", "s1", "s2", None, "é"])
        some = vocabulary if source != "s1" else vocabulary[::2]
        rows.append((rng.choice(["en", "en", "de", None]), source, "".join(rng.choice(some) + rng.choice([" ", "1", "\n", "_", "- "]) for _ in range(rng.randint(0, 40))), 1))
    return [*rows, ("en", "empty", None, 1), ("en", "empty", "12 34", 1), ("xx", "alone", "word", 1), ("yy", "p", "", 1), ("yy", "q", "once", 1), rows[0]]


def frame(spark, rows):
    return spark.createDataFrame(rows, KIND)


def test_packing_sorts_by_bytes():
    words = [w.encode() for w in ["b", "ab", "abc", "", "ÿz", "abcdefgh", "abcdefghi", "a" * 16, "abcdefg"]]
    data = np.frombuffer(b"".join(words), np.uint8)
    lengths = np.array([len(w) for w in words])
    starts = np.cumsum(lengths) - lengths
    order = dv.radix_order(dv.packed(data, starts, lengths, 0), dv.packed(data, starts, lengths, 8))
    assert [words[i] for i in order] == sorted(words)


def test_radix_is_stable():
    rng = np.random.default_rng(1)
    a, b = rng.integers(0, 5, 500).astype(np.uint64) << np.uint64(45), rng.integers(0, 3, 500).astype(np.uint64)
    assert dv.radix_order(a, b).tolist() == sorted(range(500), key=lambda i: (a[i], b[i], i))


def test_terms_end_at_documents():
    texts = pa.array(["skip", "ab", "cd E", "", "É1f"]).slice(1)
    data, starts, lengths, doc = dv.terms_of(texts)
    found = [data[a : a + n].tobytes().decode() for a, n in zip(starts, lengths)]
    assert list(zip(found, doc.tolist())) == [("ab", 0), ("cd", 1), ("e", 1), ("É", 3), ("f", 3)]


@pytest.mark.parametrize("cut", [1, 50, 1 << 20])
def test_counts(spark, monkeypatch, cut):
    monkeypatch.setattr(dv, "TERMS", cut)
    rows = made(2)
    n, docs = Counter(), Counter()
    for lang, source, text, _ in rows:
        n.update((lang or "", source or "", t) for t in terms(text))
        docs.update({(lang or "", source or "", t) for t in terms(text)})
    got = {(r.lang, r.source, bytes(r.term).decode()): (r.n, r.docs) for r in dv.term_counts(frame(spark, rows)).filter("term is not null").collect()}
    assert got == {k: (n[k], docs[k]) for k in n}


@pytest.mark.parametrize(("block", "tile"), [(4_096, 32), (3, 2), (7, 1)])
def test_audit(spark, block, tile):
    rows = made(4)
    got = dv.audit(frame(spark, rows), ranks=4, block=block, tile=tile)
    assert sorted(map(tuple, got.select("lang", "source", "part", "item", "value", "rank").collect())) == brute(rows, ranks=4)


def test_one_very_long_text_and_a_hot_source(spark):
    rows = [("en", "hot", f"word other{'x' * (i % 3)} Word", 1) for i in range(300)]
    rows += [("en", "long", "word " * 100_000 + "y" * 200_000, 1), ("en", "long", "y" * 200_000, 1), ("en", "b", "y" * 200_000, 1)]
    got = dv.audit(frame(spark, rows)).select("lang", "source", "part", "item", "value", "rank")
    assert sorted(map(tuple, got.collect())) == brute(rows)


def test_empty_table(spark):
    out = dv.audit(frame(spark, []))
    assert out.columns == ["lang", "source", "part", "item", "value", "rank"] and out.count() == 0


def test_exact_at_large_counts(spark):
    n, total = 9 * 10**15, 10**16
    row = spark.sql(f"select {n}L as n, {total}L as total, 7L as kept").select(dv.probability("n", "total", "kept").alias("p")).first()
    assert row.p == 1 + 10**9 * (n + 1) // (total + 7)


def test_duckdb(spark):
    assert differences(QUERIES["op13_divergence"](spark, SF), connect(SF), ORACLES["op13_divergence"]) == []


def test_texts_are_taken_apart_in_bounded_pieces():
    texts = ["ab", None, "c" * 30, "", "d" * 5, "e" * 5, "f"]
    batch = pa.RecordBatch.from_pydict({"text": [t or "" for t in texts]}).slice(1)
    found = [p.column("text").to_pylist() for p in dv.pieces(batch, 10)]
    assert sum(found, []) == [t or "" for t in texts[1:]]
    assert all(sum(map(len, p[1:])) <= 10 for p in found) and len(found) > 2


def test_counts_do_not_depend_on_pieces(documents, monkeypatch):
    docs = documents([(i, f"same words {'x' * (i % 7)} w{i % 5} Same", "ab"[i % 2]) for i in range(60)])
    want = sorted(map(str, dv.term_counts(docs).collect()))
    monkeypatch.setattr(dv, "PIECE", 50)
    assert sorted(map(str, dv.term_counts(docs).collect())) == want
