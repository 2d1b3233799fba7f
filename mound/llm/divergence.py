"""Audit of how far the sources of a language diverge in the terms they use.

Counting is done in numpy, by length: terms of up to 8 bytes are one uint64 word, those of up
to 16 two, and both are radix-sorted (stable passes over 16-bit digits, so documents stay in
order within a term) and counted by runs; longer terms go into buckets of fixed widths, each
sorted by bytes. A task emits a row for each group and term of some ``TERMS`` terms, Spark adds
them up. A hot source or term is therefore never more than a few rows a task.

The pairs of sources are not made term by term. Terms are dealt into blocks and sources into
tiles; a task holds a block's probabilities for two tiles as a dense matrix and emits one sum a
pair. Terms that no source of the two tiles has are added as one product.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from mound.llm.tables import row_hash, settle

TERMS = 1 << 20
# Bytes of text that a task takes apart at once; a longer text is taken by itself.
PIECE = 1 << 22
LEAST = 3
RANKS = 200
BLOCK = 4_096
TILE = 32
SCALE = 1_000_000_000

# Fixed values of the contract: terms are runs of letters and of everything beyond ASCII.
TERM = r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+"
_LOWER = np.array([c + 32 if 65 <= c <= 90 else c if 97 <= c <= 122 or c > 127 else 0 for c in range(256)], dtype=np.uint8)

COUNTS = "lang string, source string, term binary, n long, docs long"


def radix_order(*words: np.ndarray) -> np.ndarray:
    """Stable order of rows by several uint64 words, the first the most significant."""
    order = np.arange(len(words[0]))
    for word in reversed(words):
        for shift in (0, 16, 32, 48):
            digit = ((word >> np.uint64(shift)) & np.uint64(0xFFFF)).astype(np.uint16)
            if len(digit) and (digit != digit[0]).any():
                order = order[np.argsort(digit[order], kind="stable")]
    return order


def packed(data: np.ndarray, starts: np.ndarray, lengths: np.ndarray, offset: int) -> np.ndarray:
    """Bytes ``offset`` to ``offset + 8`` of every term as a big-endian word, padded with zeros."""
    out = np.zeros(len(starts), np.uint64)
    for k in range(offset, offset + 8):
        there = k < lengths
        byte = data[np.where(there, starts + k, 0)]
        out = out << np.uint64(8) | np.where(there, byte, 0).astype(np.uint64)
    return out


def _runs(changed: np.ndarray, groups: np.ndarray, docs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of sorted terms: where runs of one term and group begin, their lengths and numbers of documents."""
    new = changed.copy()
    new[1:] |= groups[1:] != groups[:-1]
    doc = new.copy()
    doc[1:] |= docs[1:] != docs[:-1]
    begins = np.flatnonzero(new)
    return begins, np.diff(np.append(begins, len(new))), np.add.reduceat(doc.astype(np.int64), begins)


def counted(data: np.ndarray, starts: np.ndarray, lengths: np.ndarray, groups: np.ndarray, docs: np.ndarray) -> Iterator[tuple[np.ndarray, list[bytes], np.ndarray, np.ndarray]]:
    """By bucket of lengths: group, term, count and documents of every run.

    Terms come in the order of groups and documents; ``data`` is in lower case.
    """
    width, low = 8, 0
    while low < lengths.max(initial=0):
        some = np.flatnonzero((lengths > low) & (lengths <= width))
        if len(some):
            s, n = starts[some], lengths[some]
            if width <= 16:
                words = [packed(data, s, n, k) for k in range(0, width, 8)]
                order = radix_order(*words)
                terms = np.empty((len(order), len(words)), ">u8")
                for k, word in enumerate(words):
                    terms[:, k] = word[order]
                terms = terms.view(f"S{width}").ravel()
            else:
                text = data.tobytes()
                raw = np.array([text[a : a + b] for a, b in zip(s.tolist(), n.tolist())], dtype=f"S{width}")
                order = np.argsort(raw, kind="stable")
                terms = raw[order]
            changed = np.ones(len(terms), bool)
            changed[1:] = terms[1:] != terms[:-1]
            begins, total, many = _runs(changed, groups[some][order], docs[some][order])
            yield groups[some][order][begins], terms[begins].tolist(), total, many
        low, width = width, width * 2


def terms_of(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Lower-case bytes of all texts, and start, length and text of every term."""
    offsets = np.frombuffer(texts.buffers()[1], np.int32 if pa.types.is_string(texts.type) else np.int64)[texts.offset : texts.offset + len(texts) + 1]
    held = texts.buffers()[2]
    raw = np.frombuffer(held, np.uint8)[offsets[0] : offsets[-1]] if held else np.zeros(0, np.uint8)
    offsets = (offsets - offsets[0]).astype(np.int64)
    data = _LOWER[raw]
    word = data != 0
    edge = np.zeros(len(data) + 1, bool)
    edge[offsets] = True
    starts = np.flatnonzero(word & (edge[:-1] | ~np.concatenate([[False], word[:-1]])))
    ends = np.flatnonzero(word & (edge[1:] | ~np.concatenate([word[1:], [False]]))) + 1
    return data, starts, ends - starts, np.searchsorted(offsets, starts, "right") - 1


def pieces(batch: pa.RecordBatch, most: int) -> Iterator[pa.RecordBatch]:
    """The batch in runs of texts of some ``most`` bytes."""
    ends = np.cumsum(pc.binary_length(batch.column("text")).to_numpy(zero_copy_only=False), dtype=np.int64)
    begins = np.flatnonzero(np.diff((ends - 1) // most, prepend=-2))
    for a, b in zip(begins, np.append(begins[1:], len(ends))):
        yield batch.slice(a, b - a)


def term_counts(docs: DataFrame) -> DataFrame:
    """``lang``, ``source``, ``term`` (UTF-8), ``n`` and ``docs``, summed over the table.

    Null langs, sources and texts are read as ``''``. Every group has a row with a null term and ``n`` 0, so groups without
    terms stay. Repeated rows are documents of their own.
    """
    rows = docs.select(*[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("lang", "source", "text")])
    fields = pa.schema([("lang", pa.string()), ("source", pa.string()), ("term", pa.binary()), ("n", pa.int64()), ("docs", pa.int64())])

    def frame(names: list[tuple[str, str]], groups: np.ndarray, terms: list, n: np.ndarray, many: np.ndarray) -> pa.RecordBatch:
        lang, source = (pa.array([x[i] for x in names], pa.string()).take(pa.array(groups)) for i in (0, 1))
        return pa.RecordBatch.from_arrays([lang, source, pa.array(terms, pa.binary()), pa.array(n), pa.array(many)], schema=fields)

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (piece for whole in batches for piece in pieces(whole, PIECE)):
            of = list(zip(batch.column("lang").to_pylist(), batch.column("source").to_pylist()))
            names = sorted(set(of))
            number = {g: i for i, g in enumerate(names)}
            group = np.array([number[g] for g in of], dtype=np.int64)
            # Documents of a group stand together, so runs of a term do too.
            order = np.argsort(group, kind="stable")
            data, starts, lengths, doc = terms_of(batch.column("text").take(pa.array(order)))
            group = group[order]
            zero = np.zeros(len(names), np.int64)
            yield frame(names, np.arange(len(names)), [None] * len(names), zero, zero)
            # A cut between terms of one document would count it twice: cut at documents only.
            per = np.bincount(doc, minlength=len(group))
            part = np.repeat((np.cumsum(per) - 1) // TERMS, per)
            for p in np.unique(part):
                a, b = np.searchsorted(part, [p, p + 1])
                for g, terms, n, many in counted(data, starts[a:b], lengths[a:b], group[doc[a:b]], doc[a:b]):
                    yield frame(names, g, terms, n, many)

    parts = rows.mapInArrow(each, COUNTS)
    return parts.groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))


def probability(n: str, total: str, kept: str) -> Column:
    """1 + floor(SCALE * (n + 1) / (total + kept)), exact at any count; of no use, but no error, where no term is kept."""
    return F.expr(f"1 + (cast({n} + 1 as decimal(20,0)) * {SCALE}BD) div cast(greatest({total} + {kept}, 1) as decimal(20,0))")


def excess(p: str, q: str) -> Column:
    return F.expr(f"(({p} - {q}) * ({p} - {q})) div {q}")


def _sums(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
    """Sums over a block's terms for the pairs of two tiles, both ways.

    ``left`` has a probability for each term and source that occur together, ``right`` all sources of the tiles.
    """
    right = right.sort_values(["tile", "source"], ignore_index=True)
    names, tile = right.source.to_numpy(), right.tile.to_numpy()
    rest = right.p0.to_numpy(np.int64)
    two = bool((right.low != right.high).any())
    term, terms = pd.factorize(left.term)
    p = np.repeat(rest[None, :], len(terms), axis=0)
    p[term, pd.Index(names).get_indexer(left.source)] = left.p.to_numpy(np.int64)
    out = []
    for g in range(len(names)):
        others = np.flatnonzero((tile != tile[g]) if two else np.arange(len(names)) != g)
        q = p[:, others]
        d = p[:, g : g + 1] - q
        zero = (rest[g] - rest[others]) ** 2 // rest[others]
        out.append(pd.DataFrame({"source": names[g], "item": names[others], "value": (d * d // q).sum(axis=0), "seen": len(terms), "unseen": zero}))
    lang, kept = right.lang.iloc[0], right.kept.iloc[0]
    return pd.concat(out).assign(lang=lang, kept=kept)[["lang", "source", "item", "value", "seen", "unseen", "kept"]]


def _pairs(rows: DataFrame, groups: DataFrame, block: int, tile: int) -> DataFrame:
    """``lang``, ``source``, ``item``, ``value`` for each source and other source of its language."""
    counts = groups.groupBy("lang").agg(F.count("*").alias("sources"))
    tiles = F.greatest(F.ceil(F.col("sources") / tile), F.lit(1)).cast("int")
    blocks = F.greatest(F.ceil(F.col("kept") / block), F.lit(1)).cast("int")
    all_of = groups.join(counts, "lang").select("lang", "source", "kept", tiles.alias("tiles"), blocks.alias("blocks"), probability("0L", "total", "kept").alias("p0"))
    all_of = all_of.withColumn("tile", F.pmod(row_hash(43, "source"), F.col("tiles")).cast("int"))
    # A row meets every tile once; a pair of tiles is one task, whichever comes first.
    each = F.explode(F.sequence(F.lit(0), F.col("tiles") - 1))
    key = [F.least("tile", "b").alias("low"), F.greatest("tile", "b").alias("high")]
    here = F.pmod(F.xxhash64(F.lit(47), "term"), F.col("blocks")).cast("int").alias("block")
    left = rows.join(all_of, ["lang", "source"]).select("lang", "source", "term", "p", "tile", here, each.alias("b"))
    left = left.select("lang", "block", *key, "source", "term", "p")
    right = all_of.withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).withColumn("b", each)
    # No terms at all still leave the pairs, of value 0.
    right = right.select("lang", "block", *key, "source", "tile", "p0", "kept")
    by = ["lang", "block", "low", "high"]

    sums = left.groupBy(*by).cogroup(right.groupBy(*by)).applyInPandas(_sums, "lang string, source string, item string, value long, seen long, unseen long, kept long")
    whole = sums.groupBy("lang", "source", "item").agg(F.sum("value").alias("value"), F.sum("seen").alias("seen"), F.max("unseen").alias("unseen"), F.max("kept").alias("kept"))
    return whole.select("lang", "source", "item", F.expr("value + (kept - seen) * unseen").alias("value"))


def audit(docs: DataFrame, least: int = LEAST, ranks: int = RANKS, block: int = BLOCK, tile: int = TILE) -> DataFrame:
    """Rows ``lang``, ``source``, ``part``, ``item``, ``value``, ``rank``: how sources differ, and by which terms.

    Part ``pair`` has every other source of the language; part ``term`` the first ``ranks`` terms that a source uses
    more than its language does. A language keeps terms of at least ``least`` documents; one without such terms has
    pairs of value 0. A source alone in its language has no pair. An empty table gives no rows. Ties go by UTF-8.
    """
    counts = settle(term_counts(docs))
    terms = counts.filter("term is not null")
    kept = terms.groupBy("lang", "term").agg(F.sum("n").alias("lang_n"), F.sum("docs").alias("docs")).filter(F.col("docs") >= least)
    kept = settle(kept.select("lang", "term", "lang_n"))
    rows = settle(terms.select("lang", "source", "term", "n").join(kept, ["lang", "term"]))
    langs = kept.groupBy("lang").agg(F.count("*").alias("kept"), F.sum("lang_n").alias("lang_total"))
    per = rows.groupBy("lang", "source").agg(F.sum("n").alias("total"))
    groups = counts.filter("term is null").select("lang", "source").join(langs, "lang", "left").join(per, ["lang", "source"], "left")
    groups = settle(groups.fillna(0))
    rows = rows.join(groups, ["lang", "source"]).select(
        "lang", "source", "term", "n", probability("n", "total", "kept").alias("p"), probability("lang_n", "lang_total", "kept").alias("q")
    )
    above = rows.filter("n > 0 and p > q").select("lang", "source", "term", excess("p", "q").alias("value"))
    first = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "term")
    above = above.withColumn("rank", F.row_number().over(first)).filter(F.col("rank") <= ranks)
    above = above.select("lang", "source", F.lit("term").alias("part"), F.col("term").cast("string").alias("item"), "value", "rank")
    order = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    pairs = _pairs(rows.select("lang", "source", "term", "p"), groups, block, tile)
    pairs = pairs.select("lang", "source", F.lit("pair").alias("part"), "item", "value", F.row_number().over(order).alias("rank"))
    return pairs.unionByName(above)


ORACLE = rf"""
with d as (
  select row_number() over () as r, coalesce(lang, '') as lang, coalesce(source, '') as source,
    regexp_extract_all(coalesce(text, ''), '{TERM}') as w
  from documents),
t as (
  select r, lang, source, translate(x, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as term
  from (select r, lang, source, unnest(w) as x from d) u),
kept as (select lang, term, count(*)::hugeint as lang_n from t group by lang, term having count(distinct r) >= {LEAST}),
langs as (select lang, count(*)::hugeint as v, sum(lang_n)::hugeint as lang_total from kept group by lang),
c as (select t.lang, t.source, t.term, count(*)::hugeint as n from t join kept using (lang, term) group by all),
per as (select lang, source, sum(n)::hugeint as total from c group by all),
groups as (
  select g.lang, g.source, coalesce(v, 0) as v, coalesce(total, 0) as total, coalesce(lang_total, 0) as lang_total
  from (select distinct lang, source from d) g left join langs using (lang) left join per using (lang, source)),
p as (
  select g.lang, g.source, k.term, coalesce(c.n, 0) as n,
    1 + ({SCALE}::hugeint * (coalesce(c.n, 0) + 1)) // (g.total + g.v) as p,
    1 + ({SCALE}::hugeint * (k.lang_n + 1)) // (g.lang_total + g.v) as q
  from groups g join kept k using (lang) left join c on c.lang = g.lang and c.source = g.source and c.term = k.term),
pairs as (
  select a.lang, a.source, b.source as item, coalesce(s.value, 0) as value
  from groups a join groups b on a.lang = b.lang and a.source <> b.source
  left join (
    select a.lang, a.source, b.source as item, sum(((a.p - b.p) * (a.p - b.p)) // b.p) as value
    from p a join p b on a.lang = b.lang and a.term = b.term and a.source <> b.source group by all) s
    on s.lang = a.lang and s.source = a.source and s.item = b.source),
both_parts as (
  select lang, source, 'pair' as part, item, value from pairs
  union all
  select lang, source, 'term', term, ((p - q) * (p - q)) // q from p where n > 0 and p > q),
ranked as (select *, row_number() over (partition by lang, source, part order by value desc, item) as rank from both_parts)
select lang, source, part, item, value::bigint as value, rank::int as rank from ranked where part = 'pair' or rank <= {RANKS}
"""
