"""Personal data: base patterns, and contextual extraction bootstrapped from what they find.

The spans of four regular expressions are the seeds. What stands around a seed (the last two words before
it, or the last one and the next) is a lexical pattern; the identifier-like tokens that no base span touches, those
with a digit or an at sign, are the other instances. Patterns and instances form a graph that Spark
scores in rounds: a pattern's score for a kind is the share of its different instances that are of the kind, drawn
to 0 where there are few; an instance's is the chance that not all its patterns err. Tokens
in a pattern that stands out after the last round and has seen enough seeds are new spans of that kind.

All of it is SQL expressions, joins and aggregates. Positions come from splitting at the
same expression that extracts: the lengths of gaps and matches add up to places, in code points. Texts are read once
and never shuffled. Copies of a text count once in the graph, so they do not lend weight to a pattern.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mound.llm.tables import settle, text_of

# The kinds and their base expressions, in the contract's order. The guards (after
# another character of the run only where a match has just ended) and possessive repeats
# find the same spans in linear time.
KINDS = ("email", "ip", "card", "phone")
BASE = {
    "email": r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:(?<![0-9])|\G)[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
SLOT = r"(?<![^\x20\x09-\x0D])[^\x20\x09-\x0D0-9@]*+[0-9@][^\x20\x09-\x0D]*+"
OPENING = r"^[\"'(\[{<|]*"
CLOSING = r"[\"')\]}>|.,;:!?]*$"
# Characters of a context that patterns are made of: longer words count by this end of them.
CONTEXT = 64
# Rounds end when no pattern's score moves any more, and after this many.
ROUNDS = 20
PART = 64
SPAN = "struct<start:int,kind:int,end:int,value:string,before:string,after:string>"
LEAST_SEEDS = 5
LEAST_SCORE = 0.75
PRIOR = 1.0


def _running(values: Column, step: Callable[[Column, Column], Column]) -> Column:
    """Running totals of an array under ``step``, each with its own element.

    Totals of blocks come first, so n elements take about n * PART steps. ``step`` is associative and 0 its start.
    """
    total = lambda some: F.aggregate(some, F.lit(0), step)

    def running(a: Column, per: Column) -> Column:
        before = F.transform(per, lambda _, b: total(F.slice(per, 1, b)))

        def at(place: Column, before: Column) -> Column:
            b = F.floor(place / PART).cast("int")
            return step(F.get(before, b), total(F.slice(a, b * PART + 1, place - b * PART + 1)))

        # Single-item arrays name a list once for all uses.
        return F.flatten(F.transform(F.array(before), lambda x: F.transform(a, lambda _, i: at(i, x))))

    # A list that is not named would be made again for every block.
    blocks = lambda a: F.sequence(F.lit(0), F.floor((F.size(a) - 1) / PART).cast("int"))
    per = lambda a: F.transform(blocks(a), lambda b: total(F.slice(a, b * PART + 1, PART)))
    named = F.transform(F.array(values), lambda a: F.struct(a.alias("a"), per(a).alias("per")))
    return F.flatten(F.transform(named, lambda x: running(x["a"], x["per"])))


def _matches(text: Column, pattern: str) -> Column:
    """All matches: ``start``, ``end``, ``value``, and up to ``CONTEXT`` characters ``before`` and ``after``.

    A context runs over neighbouring matches too (two before, one after), so an occurrence has the same words around it
    whichever expression found it.
    """
    gaps, found = F.split(text, pattern, -1), F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    none = F.lit("")
    # A match starts after its gap and all gaps and matches before.
    lengths = lambda p: F.transform(p["f"], lambda _, i: F.length(F.get(p["g"], i)) + F.coalesce(F.length(F.get(p["f"], i - 1)), F.lit(0)))

    def each(p: Column) -> Column:
        def at(value: Column, i: Column) -> Column:
            start = F.get(p["start"], i)
            part = lambda name, k: F.coalesce(F.get(p[name], i + k), none)
            before = F.concat(part("g", -2), part("f", -2), part("g", -1), part("f", -1), part("g", 0))
            after = F.concat(part("g", 1), part("f", 1), part("g", 2))
            return F.struct(
                start.alias("start"), (start + F.length(value)).alias("end"), value.alias("value"),
                F.right(before, F.lit(CONTEXT)).alias("before"), F.left(after, F.lit(CONTEXT)).alias("after"),
            )

        return F.transform(p["f"], at)

    # Single-item arrays name the lists once for all uses.
    places = F.transform(F.array(F.struct(gaps.alias("g"), found.alias("f"))), lambda p: F.struct(p["g"].alias("g"), p["f"].alias("f"), _running(lengths(p), lambda s, x: s + x).alias("start")))
    return F.flatten(F.transform(places, each))


def _digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def _holds(kind: str, value: Column) -> Column:
    """What a match of a kind must satisfy; failing ones are dropped."""
    n = F.length(_digits(value))
    part = r"0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[0-9]{1,2})"
    return {
        "email": F.lit(True),
        "ip": value.rlike(rf"^{part}(?:\.{part}){{3}}$"),
        "card": n.between(14, 19) & F.call_function("luhn_check", _digits(value)),
        "phone": n.between(10, 15),
    }[kind]


def _named(matches: Column, number: int) -> Column:
    return F.transform(matches, lambda m: F.struct(m["start"].alias("start"), F.lit(number).alias("kind"), m["end"].alias("end"), m["value"].alias("value"), m["before"].alias("before"), m["after"].alias("after")))


def base_spans(text: Column) -> Column:
    """Spans of the base expressions by start, then kind."""

    def of(number: int) -> Column:
        kind = KINDS[number]
        return _named(F.filter(_matches(text, BASE[kind]), lambda m: _holds(kind, m["value"])), number)

    return F.array_sort(F.concat(*map(of, range(len(KINDS)))))


def _slots(text: Column) -> Column:
    """Identifier-like tokens without outer punctuation; kind -1."""

    def trimmed(m: Column) -> Column:
        opened = F.length(m["value"]) - F.length(F.regexp_replace(m["value"], OPENING, ""))
        core = F.regexp_replace(F.regexp_replace(m["value"], OPENING, ""), CLOSING, "")
        start = m["start"] + opened
        return F.struct(
            start.alias("start"), F.lit(-1).alias("kind"), (start + F.length(core)).alias("end"), core.alias("value"),
            F.concat(m["before"], F.left(m["value"], opened)).alias("before"), m["after"].alias("after"),
        )

    return F.filter(F.transform(_matches(text, SLOT), trimmed), lambda m: m["value"] != "")


def _apart(slots: Column, base: Column) -> Column:
    """The slots that no base span touches: no span that starts before a slot's end reaches beyond its start.

    One sort of span starts and slot ends and a running maximum of where spans reach, so n of both take about n * PART steps.
    """
    # At one place a slot's end comes before a span's start: they do not touch.
    ends = F.transform(slots, lambda s: F.struct(s["end"].alias("at"), F.lit(0).alias("reach"), s.alias("slot")))
    starts = F.transform(base, lambda b: F.struct(b["start"].alias("at"), b["end"].alias("reach"), F.lit(None).cast(SPAN).alias("slot")))
    events = F.array(F.array_sort(F.concat(ends, starts)))
    named = F.transform(events, lambda e: F.struct(e.alias("e"), _running(F.transform(e, lambda x: x["reach"]), lambda s, x: F.greatest(s, x)).alias("far")))
    free = lambda x: F.filter(x["e"], lambda e, i: e["slot"].isNotNull() & (F.get(x["far"], i) <= e["slot"]["start"]))
    kept = F.flatten(F.transform(named, free))
    return F.when(F.size(base) == 0, slots).otherwise(F.transform(kept, lambda e: e["slot"]))


def scanned(docs: DataFrame) -> DataFrame:
    """``doc_id``, ``key`` of the text, ``base`` spans, and ``other`` tokens that no base span touches."""
    text = text_of("text")
    rows = docs.select("doc_id", F.md5(text.cast("binary")).alias("key"), base_spans(text).alias("base"), _slots(text).alias("slots"))
    return rows.select("doc_id", "key", "base", _apart(F.col("slots"), F.col("base")).alias("other"))


def _patterns() -> Column:
    """The lexical patterns around an occurrence ``o``; a word that touches it is told from one apart."""
    before, after = F.lower(F.col("o.before")), F.lower(F.col("o.after"))
    words = F.filter(F.split(before, r"[\x20\x09-\x0D]+"), lambda w: w != "")
    last = F.when(F.size(words) > 0, F.element_at(words, -1)).otherwise("^")
    one = F.concat(last, F.when(before.rlike(r"[\x20\x09-\x0D]$"), " _").otherwise("_"))
    two = F.concat(F.when(F.size(words) > 1, F.element_at(words, -2)).otherwise("^"), F.lit(" "), one)
    following = F.concat(one, F.lit(" "), F.regexp_extract(after, r"^[\x20\x09-\x0D]*([^\x20\x09-\x0D]*)", 1))
    return F.array(F.concat(F.lit("2 "), two), F.concat(F.lit("b "), following))


def occurrences(scan: DataFrame) -> DataFrame:
    """One row for each text, occurrence and pattern: ``key``, ``start``, ``end``, ``kind``, ``instance``, ``pattern``."""
    texts = scan.groupBy("key").agg(F.first(F.concat("base", "other")).alias("all"))
    each = texts.select("key", F.explode("all").alias("o")).withColumn("pattern", F.explode(_patterns()))
    return each.select("key", "o.start", "o.end", "o.kind", F.lower("o.value").alias("instance"), "pattern")


def confident(found: DataFrame, rounds: int = ROUNDS, least_seeds: int = LEAST_SEEDS, least_score: float = LEAST_SCORE) -> DataFrame:
    """``pattern``, ``kind`` and ``score`` of the patterns that may discover."""
    edges = settle(found.groupBy("pattern", "instance").agg(F.max("kind").alias("kind")))
    seeds = settle(edges.filter("kind >= 0").groupBy("instance").agg(F.max("kind").alias("kind")).withColumn("s", F.lit(1.0)))
    known = edges.groupBy("pattern").agg(F.count("*").alias("n"), F.count(F.when(F.col("kind") >= 0, 1)).alias("seen"))
    # A pattern with too few seeds can neither discover nor lend weight.
    known = settle(known.filter(F.col("seen") >= least_seeds))
    edges = settle(edges.select("pattern", "instance").join(known.select("pattern"), "pattern", "left_semi"))
    scores, patterns, state = seeds, None, None
    for _ in range(rounds):
        sums = edges.join(scores, "instance").groupBy("pattern", "kind").agg(F.sum("s").alias("s"))
        patterns = settle(sums.join(known, "pattern").select("pattern", "kind", (F.col("s") / (F.col("n") + PRIOR)).alias("score")))
        last, state = state, tuple(patterns.agg(F.count("*"), F.sum(F.hash("pattern", "kind", F.round("score", 6)).cast("long"))).first())
        if state == last:
            break
        err = F.exp(F.sum(F.log1p(-F.col("score") * 0.999999)))
        fresh = edges.join(patterns.filter("score >= 0.5"), "pattern").groupBy("instance", "kind").agg((1 - err).alias("s"))
        fresh = fresh.join(seeds.select("instance"), "instance", "left_anti")
        scores = settle(seeds.select("instance", "kind", "s").unionByName(fresh))
    return patterns.filter(F.col("score") >= least_score)


def spans(docs: DataFrame, **settings) -> DataFrame:
    """``doc_id``, ``key``, ``base`` and ``added``: base spans and discovered ones of every row.

    A null or empty text has no spans. Repeated rows each give a row. An overlap between kinds is kept as found.
    """
    scan = settle(scanned(docs))
    found = settle(occurrences(scan))
    best = F.max(F.struct("score", (-F.col("kind")).alias("kind"))).alias("b")
    good = confident(found, **settings).groupBy("pattern").agg(best).select("pattern", "b.score", (-F.col("b.kind")).alias("to"))
    hits = found.filter("kind < 0").join(good, "pattern")
    hits = hits.groupBy("key", "start", "end").agg(F.max(F.struct("score", (-F.col("to")).alias("kind"))).alias("b"))
    hits = hits.select("key", F.struct("start", (-F.col("b.kind")).cast("int").alias("kind"), "end").alias("s"))
    added = hits.groupBy("key").agg(F.array_sort(F.collect_list("s")).alias("added"))
    plain = F.transform("base", lambda b: F.struct(b["start"].alias("start"), b["kind"].alias("kind"), b["end"].alias("end")))
    rows = scan.select("doc_id", "key", plain.alias("base")).join(added, "key", "left")
    none = F.array().cast("array<struct<start:int,kind:int,end:int>>")
    return rows.select("doc_id", "key", "base", F.coalesce("added", none).alias("added"))


def listed(each: Column) -> Column:
    """``kind:start:end`` of every span, joined by commas."""
    kinds = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(each, lambda s: F.concat_ws(":", F.get(kinds, s["kind"]), s["start"], s["end"])), ",")


def digest(docs: DataFrame) -> DataFrame:
    """Counts and checksum of base spans, and all spans, of every row."""
    count = lambda i: F.size(F.filter("base", lambda s: s["kind"] == i)).cast("long").alias(f"n_{KINDS[i]}")
    found = spans(docs)
    base = F.sha2(listed(F.col("base")).cast("binary"), 256).alias("base_sha256")
    return found.select("doc_id", *map(count, range(len(KINDS))), base, listed(F.array_sort(F.concat("base", "added"))).alias("spans"))


def redact(docs: DataFrame) -> DataFrame:
    """The documents with every span replaced by its kind in brackets; ``n_chars``, where there is one, follows.

    Of overlapping spans the first stands for all. A null text stays null.
    """
    found = spans(docs).filter("size(base) + size(added) > 0").select("key", F.array_sort(F.concat("base", "added")).alias("spans"))
    found = found.groupBy("key").agg(F.first("spans").alias("spans"))
    # The spans grow with the documents: a merge join at every size.
    rows = docs.select(F.struct("*").alias("d"), F.md5(text_of("text").cast("binary")).alias("key")).join(found.hint("merge"), "key", "left")
    kinds = F.array(*[F.lit(f"[{k.upper()}]") for k in KINDS])
    text = F.col("d.text")

    def step(state: Column, s: Column) -> Column:
        more = F.concat(state["out"], F.array(F.substring(text, state["at"] + 1, s["start"] - state["at"]), F.get(kinds, s["kind"])))
        return F.struct(
            F.greatest(state["at"], s["end"]).alias("at"),
            F.when(s["start"] >= state["at"], more).otherwise(state["out"]).alias("out"),
        )

    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<string>").alias("out"))
    clean = F.aggregate("spans", start, step, lambda s: F.concat(F.array_join(s["out"], ""), F.substring(text, s["at"] + 1, F.length(text))))
    hit = F.size("spans") > 0
    rows = rows.select("d", hit.alias("hit"), F.when(hit, clean).otherwise(text).alias("text"))
    new = {"text": F.col("text")}
    if "n_chars" in docs.columns:
        length = F.length("text").cast(docs.schema["n_chars"].dataType)
        new["n_chars"] = F.when(F.col("hit"), length).otherwise(F.col("d.n_chars"))
    return rows.select(*[new.get(c, F.col(f"d.`{c}`")).alias(c) for c in docs.columns])
