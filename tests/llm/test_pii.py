"""Base spans against Python's expressions, discovery by context, and redaction."""

from __future__ import annotations

import hashlib
import random
import re

import pytest
from pyspark.sql import functions as F

from mound.llm import pii

PLAIN = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def luhn(digits):
    doubled = [int(c) * (1 + i % 2) for i, c in enumerate(reversed(digits))]
    return sum(v - 9 * (v > 9) for v in doubled) % 10 == 0


def holds(kind, match):
    digits = re.sub("[^0-9]", "", match)
    if kind == "ip":
        return all(int(p) <= 255 for p in match.split("."))
    if kind == "card":
        return 14 <= len(digits) <= 19 and luhn(digits)
    return kind == "email" or 10 <= len(digits) <= 15


def base(text):
    found = [(m.start(), i, f"{k}:{m.start()}:{m.end()}") for i, k in enumerate(PLAIN) for m in re.finditer(PLAIN[k], text or "") if holds(k, m[0])]
    return [s for *_, s in sorted(found)]


TEXTS = [
    None,
    "",
    "mail a.b%c+d-e@x-y.co.uk, and é@x.y z@w ü@b@c.d a@b.c_d@e.f a@b.c.@d.e",
    "1.2.3.4 1.2.3.4.5.6.7.8 256.1.1.1 000255.1.1.1 1.2.3.999 9.1.2.3.4",
    "4111 1111 1111 1111 and 4111-1111-1111-1112, 378282246310005x4111111111111111 4111  1111",
    "+1 (361) 555-8283 +44 20 7946 0958. +1 2 +12345678901234567 ++1 212 555 0100 +1 (212) 555-0100)",
    "🎉 é 4111111111111111 a@b.cd\n10.0.0.1\t+1 212 555 0100",
    "1" * 30_000 + " " + "a" * 30_000 + " a@b.c",
    "+1" + "(" * 5_000 + " 5" * 12 + " " + "1-" * 20_000,
    "x@y.z 10.20.30.40 4111111111111111 +1 212 555 0100 " * 200,
]


@pytest.mark.parametrize("extra", [0, 1])
def test_base_spans(documents, extra):
    rng = random.Random(extra)
    alphabet = "0123456789.+-@ ()ab%é\n"
    texts = TEXTS + ["".join(rng.choices(alphabet, k=60)) for _ in range(300)]
    docs = documents(list(enumerate(texts))).withColumns({"key": F.lit("mine"), "base": F.lit(1), "spans": F.lit(None)})
    got = pii.digest(docs).collect()
    assert len(got) == len(texts)
    for r in got:
        want = base(texts[r.doc_id])
        assert r.base_sha256 == hashlib.sha256(",".join(want).encode()).hexdigest()
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == [sum(s.startswith(k) for s in want) for k in PLAIN]
        assert [s for s in r.spans.split(",") if s in set(want)] == want


def test_contexts_discover_unseen(documents):
    rng = random.Random(2)
    rows = [(i, f"some words here contact me at user{i}@mail{i % 3}.example.com today") for i in range(30)]
    rows += [(100 + i, f"the number {rng.randrange(10**6)} of things") for i in range(30)]
    rows += [(200, "now contact me at jane(at)example7 today"), (201, "the number 5550100 of things"), (202, "at jane9 alone")]
    spans = {r.doc_id: r.spans for r in pii.digest(documents(rows)).collect()}
    assert spans[200] == "email:18:34"
    assert spans[201] == "" and spans[202] == ""
    assert sum(bool(s) for s in spans.values()) == 31


def test_copies_lend_no_weight(documents):
    rows = [(i, "contact me at a1@example.com today") for i in range(50)] + [(60, "contact me at x9 today")]
    spans = {r.doc_id: r.spans for r in pii.digest(documents(rows)).collect()}
    assert len(spans) == 51 and spans[60] == ""


def test_redact(spark, documents):
    rows = [(1, "é a@b.cd, 10.0.0.1!"), (1, "é a@b.cd, 10.0.0.1!"), (2, None), (3, "clean"), (None, "+x 4111111111111111"), (4, "")]
    docs = documents(rows).withColumn("_all", F.lit("mine"))
    out = pii.redact(docs)
    assert out.columns == docs.columns
    got = sorted(((r.doc_id or 0, r.text, r.n_chars) for r in out.collect()), key=str)
    text = "é [EMAIL], [IP]!"
    assert got == sorted([(1, text, 16)] * 2 + [(2, None, 0), (3, "clean", 5), (0, "+x [CARD]", 9), (4, "", 0)], key=str)
    assert pii.redact(docs.limit(0)).count() == 0
    assert pii.digest(docs.limit(0)).count() == 0


def test_contexts_with_digits_discover(documents):
    """The same words stand around a seed and a candidate, digits among them."""
    rng = random.Random(5)
    phone = lambda: f"+1 {rng.randrange(200, 999)} 555 {rng.randrange(1000, 9999)}"
    rows = [(i, f"note {i} ref 12 call {phone()} today 9 times") for i in range(30)]
    rows += [(100, "x ref 12 call 41a5550100 today 9 times"), (101, "x ref 12 send 41a5550100 soon 9 times")]
    spans = {r.doc_id: r.spans for r in pii.digest(documents(rows)).collect()}
    assert spans[100] == "phone:14:24" and spans[101] == ""


def test_many_numbers_in_one_text(documents):
    import time

    text = " ".join(f"{i}" for i in range(100_000))
    begun = time.time()
    (row,) = pii.spans(documents([(1, text + " at 10.1.2.3 a@b.cd")])).collect()
    assert [tuple(s) for s in row.base] == [(len(text) + 4, 1, len(text) + 12), (len(text) + 13, 0, len(text) + 19)]
    assert time.time() - begun < 60


def test_many_spans_and_tokens_in_one_text(documents):
    import time

    each = [f"10.0.{i % 256}.{i // 256} n{i} " for i in range(50_000)]
    begun = time.time()
    (row,) = pii.scanned(documents([(1, "".join(each))])).select(F.size("base").alias("base"), F.transform("other", lambda o: o["value"]).alias("other")).collect()
    assert row.base == 50_000 and row.other == [f"n{i}" for i in range(50_000)]
    assert time.time() - begun < 60


def test_tokens_apart_against_brute_force(documents):
    rng = random.Random(6)
    parts = ["a@b.cd", "x1", "+1 (415) 555-0100", "4111 1111 1111 1111", "word", "(10.0.0.1)", "7", "u@v", "a1a@b.cd,", "@", "9,10.0.0.2;8"]
    rows = [(i, rng.choice(["", " "]).join(rng.choice(parts) + rng.choice([" ", "  "]) for _ in range(rng.randrange(1, 600 if i % 20 == 0 else 12)))) for i in range(120)]
    docs = documents(rows)
    slots = {r.doc_id: r.s for r in docs.select("doc_id", pii._slots(F.col("text")).alias("s")).collect()}
    for r in pii.scanned(docs).collect():
        want = [s for s in slots[r.doc_id] if not any(b.start < s.end and s.start < b.end for b in r.base)]
        assert r.other == want


def test_patterns_against_brute_force(spark):
    """The rounds over the graph of patterns and instances, in plain Python, to the end."""
    import math

    rng = random.Random(8)
    edges = {(f"p{rng.randrange(12)}", f"i{k}") for k in range(90) for _ in range(3)}
    kinds = {f"i{k}": rng.choice([0, 0, 0, 1, -1, -1]) for k in range(90)}
    rows = [("t", 0, 1, kinds[i], i, p) for p, i in edges]
    found = spark.createDataFrame(rows, "key string, start int, end int, kind int, instance string, pattern string")
    good = {p for p in {p for p, _ in edges} if sum(kinds[i] >= 0 for q, i in edges if q == p) >= 5}
    size = {p: sum(q == p for q, _ in edges) for p in good}
    seeds = {(i, k): 1.0 for i, k in kinds.items() if k >= 0}
    scores, last = dict(seeds), None
    for _ in range(pii.ROUNDS):
        patterns = {}
        for p, i in edges:
            for k in (0, 1):
                if p in good and (i, k) in scores:
                    patterns[p, k] = patterns.get((p, k), 0.0) + scores[i, k] / (size[p] + 1)
        if last == {x: round(v, 6) for x, v in patterns.items()}:
            break
        last = {x: round(v, 6) for x, v in patterns.items()}
        fresh = {}
        for p, i in edges:
            for k in (0, 1):
                if kinds[i] < 0 and patterns.get((p, k), 0) >= 0.5:
                    fresh[i, k] = fresh.get((i, k), 0.0) + math.log1p(-patterns[p, k] * 0.999999)
        scores = {**seeds, **{x: 1 - math.exp(v) for x, v in fresh.items()}}
    got = {(r.pattern, r.kind): r.score for r in pii.confident(found, least_score=0.4).collect()}
    want = {x: v for x, v in patterns.items() if v >= 0.4}
    assert got.keys() == want.keys() and all(got[x] == pytest.approx(want[x], abs=1e-6) for x in want)
