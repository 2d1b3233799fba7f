"""SimHash near-duplicates with bit-sliced comparison.

A fingerprint has a bit for each bit position set in over half the XXH64 hashes of a text's
word shingles. Fingerprints that differ in at most ``RADIUS`` bits are linked and linked
ones form groups.

Equal fingerprints are one row from the start. With the 64 bits cut into ``RADIUS + SHARED``
blocks, two fingerprints within the radius agree in ``SHARED`` blocks at least, so every choice of so many
blocks is a key and only rows of equal key are compared: nothing is lost. Two of six blocks make
15 keys of 21 bits; from some 10^9 fingerprints on, three of seven (35 keys of 27 bits) compare less. A task sorts its
keys and compares all rows of a key in vertical form: for a word of 64 neighbouring rows
each bit plane is one integer, the planes of a row and the word are XORed, and three
carry-save counter bits with a sticky overflow hold 64 distances at once. Words whose
distances all exceed the radius are dropped after every few planes.

A key with more than ``CELL`` rows is dealt into cells, and every pair of cells is a task
of its own, so a hot key spreads. Tasks return links of a spanning forest of what they
compared, at most one a row, never the pairs of a group.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mound.llm.components import components
from mound.llm.tables import settle

RADIUS = 4
SHARED = 2
SHINGLE = 4
HASH_SEED = 42
CELL = 2_048
STEP = 8
ITEMS = 1 << 17
ONES = np.uint64(0xFFFFFFFFFFFFFFFF)


def fingerprint(text: str | None, shingle: int = SHINGLE) -> int:
    """SimHash of a text; 0 if it is null or has no word."""
    found = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not found:
        return 0
    joined = [b" ".join(found[i : i + shingle]) for i in range(max(1, len(found) - shingle + 1))]
    hashes = np.fromiter((xxhash.xxh64_intdigest(s, HASH_SEED) for s in joined), dtype=np.uint64, count=len(joined))
    counts = np.zeros(64, dtype=np.int64)
    for k in range(0, len(hashes), 65_536):
        some = hashes[k : k + 65_536]
        counts += np.unpackbits(some.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    bits = np.packbits(counts * 2 > len(hashes), bitorder="little")
    return int(bits.view(np.uint64)[0])


def fingerprints(docs: DataFrame, shingle: int = SHINGLE, *more: str) -> DataFrame:
    """``doc_id`` and ``fp``, the fingerprint as a signed long; ``more`` columns of longs stay."""

    def hashed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            fp = np.array([fingerprint(t, shingle) for t in b.text], dtype=np.uint64).view(np.int64)
            yield pd.DataFrame({"doc_id": b.doc_id, "fp": fp} | {c: b[c] for c in more})

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text", *more).mapInPandas(hashed, ", ".join([f"doc_id {kind}", "fp long", *[f"{c} long" for c in more]]))


def keys(fp: str = "fp", radius: int = RADIUS, shared: int = SHARED) -> Column:
    """One key for each choice of ``shared`` of the ``radius + shared`` blocks of bits, each with its choice's number."""
    n = radius + shared
    edges = [64 * i // n for i in range(n + 1)]
    masks = [((1 << (b - a)) - 1) << a for a, b in zip(edges, edges[1:])]
    signed = lambda m: m - (1 << 64) if m >> 63 else m
    pairs = [signed(sum(some)) for some in combinations(masks, shared)]
    one = [F.struct(F.lit(i).cast("byte").alias("pair"), F.col(fp).bitwiseAND(F.lit(m)).alias("key")) for i, m in enumerate(pairs)]
    return F.array(*one)


def _planes(values: np.ndarray) -> np.ndarray:
    """Bit planes by word: [64, words], lane i of word w is bit b of value 64 w + i."""
    words = -(-len(values) // 64)
    padded = np.zeros(words * 64, dtype=np.uint64)
    padded[: len(values)] = values
    bits = np.unpackbits(padded.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    return np.packbits(np.ascontiguousarray(bits.T), axis=1, bitorder="little").view(np.uint64)


def within(values: np.ndarray, first: np.ndarray, last: np.ndarray, radius: int = RADIUS) -> tuple[np.ndarray, np.ndarray]:
    """Pairs (i, j) with ``first[i] <= j < last[i]`` whose values differ in at most ``radius`` (up to 6) bits."""
    planes = _planes(values)
    lanes = np.maximum(last - first, 0)
    words = np.where(lanes > 0, (last - 1) // 64 - first // 64 + 1, 0)
    ends = np.cumsum(words)
    left: list[np.ndarray] = []
    right: list[np.ndarray] = []
    start = 0
    while start < len(values):
        done = ends[start - 1] if start else 0
        stop = max(start + 1, int(np.searchsorted(ends, done + ITEMS, "right")))
        count = words[start:stop]
        row = np.repeat(np.arange(start, stop), count)
        word = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count) + first[row] // 64
        # Lanes outside the row's range count as too far from the start.
        low = np.clip(first[row] - word * 64, 0, 63).astype(np.uint64)
        high = np.clip(64 - (last[row] - word * 64), 0, 63).astype(np.uint64)
        far = ~((ONES << low) & (ONES >> high))
        ones, twos, fours = (np.zeros(len(row), dtype=np.uint64) for _ in range(3))
        for b in range(64):
            own = -((values[row] >> np.uint64(b)) & np.uint64(1)).astype(np.uint64)
            carry = planes[b][word] ^ own
            ones, carry = ones ^ carry, ones & carry
            twos, carry = twos ^ carry, twos & carry
            fours, carry = fours ^ carry, fours & carry
            far |= carry | _over(ones, twos, fours, radius)
            if b % STEP == STEP - 1:
                near = far != ONES
                if not near.all():
                    row, word, far, ones, twos, fours = (x[near] for x in (row, word, far, ones, twos, fours))
                if not len(row):
                    break
        if len(row):
            item, lane = np.nonzero(np.unpackbits((~far).view(np.uint8).reshape(-1, 8), axis=1, bitorder="little"))
            left.append(row[item])
            right.append(word[item] * 64 + lane)
        start = stop
    none = np.zeros(0, dtype=np.int64)
    return np.concatenate([none, *left]), np.concatenate([none, *right])


def _over(ones: np.ndarray, twos: np.ndarray, fours: np.ndarray, radius: int) -> np.ndarray:
    """Lanes whose counter (below 8) is above the radius."""
    out = np.zeros_like(ones)
    for value in range(radius + 1, 8):
        each = [c if value >> k & 1 else ~c for k, c in enumerate((ones, twos, fours))]
        out |= each[0] & each[1] & each[2]
    return out


def forest(n: int, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Links (node, root) that join what the given links join, at most one a node."""
    root = np.arange(n)
    while len(left):
        low = np.minimum(root[left], root[right])
        high = np.maximum(root[left], root[right])
        apart = low != high
        left, right, low, high = left[apart], right[apart], low[apart], high[apart]
        np.minimum.at(root, high, low)
        while (root[root] != root).any():
            root = root[root]
    node = np.flatnonzero(root != np.arange(n))
    return node, root[node]


def _compared(batches: Iterator[pd.DataFrame], radius: int) -> Iterator[pd.DataFrame]:
    """Links among rows sorted by task and side; a task may run on into the next batch."""
    kept: pd.DataFrame | None = None
    fields = ["pair", "key", "i", "j"]

    def links(b: pd.DataFrame) -> pd.DataFrame:
        v = b.fp.to_numpy().view(np.uint64)
        fresh = (b[fields] != b[fields].shift()).any(axis=1).to_numpy()
        starts = np.flatnonzero(fresh)
        stops = np.append(starts[1:], len(b))
        group = np.cumsum(fresh) - 1
        # In a task of two cells the rows of the first meet those of the second only.
        two = (b.i != b.j).to_numpy()
        side = b.side.to_numpy()
        middle = starts + np.add.reduceat((side == 0).astype(np.int64), starts)
        first = np.where(two, middle[group], np.arange(len(b)) + 1)
        last = np.where(two & (side == 1), first, stops[group])
        node, root = forest(len(b), *within(v, first, last, radius))
        return pd.DataFrame({"a": v[node].view(np.int64), "b": v[root].view(np.int64)})

    for b in batches:
        b = b if kept is None else pd.concat([kept, b], ignore_index=True)
        if not len(b):
            continue
        tail = (b[fields] == b[fields].iloc[-1]).all(axis=1).to_numpy()
        at = len(b) - int(tail.sum())
        kept = b.iloc[at:].reset_index(drop=True)
        if at:
            yield links(b.iloc[:at])
    if kept is not None and len(kept):
        yield links(kept)


def linked(fps: DataFrame, radius: int = RADIUS, cell: int = CELL, shared: int = SHARED) -> DataFrame:
    """Links ``a``, ``b`` that join all distinct ``fp`` within the radius, directly or through others."""
    one = fps.select("fp", F.explode(keys("fp", radius, shared)).alias("k")).select("fp", "k.pair", "k.key")
    sizes = one.groupBy("pair", "key").agg(F.count("*").alias("n")).filter("n > 1")
    rows = one.join(sizes, ["pair", "key"]).withColumn("cells", F.ceil(F.col("n") / cell).cast("int"))
    rows = rows.withColumn("cell", F.pmod(F.xxhash64("fp", "pair"), F.col("cells")).cast("int"))
    other = F.explode(F.sequence(F.lit(0), F.col("cells") - 1)).alias("other")
    rows = rows.select("pair", "key", "fp", "cell", other).select(
        "pair", "key", "fp", F.least("cell", "other").alias("i"), F.greatest("cell", "other").alias("j"),
        (F.col("cell") > F.col("other")).cast("byte").alias("side"),
    )
    tasks = rows.repartition("pair", "key", "i", "j").sortWithinPartitions("pair", "key", "i", "j", "side")
    return tasks.mapInPandas(lambda batches: _compared(batches, radius), "a long, b long")


def groups(docs: DataFrame, radius: int = RADIUS, shingle: int = SHINGLE, cell: int = CELL, shared: int = SHARED) -> DataFrame:
    """``doc_id``, ``fp`` and ``component_id``, the smallest ``doc_id`` of the group, for every row.

    Null and empty texts have fingerprint 0 and are linked like others. A null ``doc_id`` is kept and is
    the smallest only where its group has no other. Repeated rows each give a row.
    """
    return _grouped(settle(fingerprints(docs, shingle)), radius, cell, shared).drop("component")


def _grouped(each: DataFrame, radius: int = RADIUS, cell: int = CELL, shared: int = SHARED) -> DataFrame:
    """Fingerprinted rows with ``component`` and ``component_id``."""
    fps = settle(each.groupBy("fp").agg(F.min("doc_id").alias("least")))
    found = components(linked(fps.select("fp"), radius, cell, shared)).withColumnRenamed("node", "fp")
    named = settle(fps.join(found, "fp", "left").withColumn("component", F.coalesce("component", "fp")))
    lowest = named.groupBy("component").agg(F.min("least").alias("component_id"))
    return each.join(named.join(lowest, "component").select("fp", "component", "component_id"), "fp")


# Names that no table has.
DIGEST, FIRST, ID = "__digest_of_text", "__digest_kept", "__id_kept"


def hex_of(fp: str = "fp") -> Column:
    """16 lower-case hex digits."""
    return F.lower(F.lpad(F.hex(F.col(fp)), 16, "0"))


def keep_one(docs: DataFrame) -> DataFrame:
    """One document of every group: its smallest ``doc_id``.

    A document without an id stays only where its group has none with an id. Where texts of a group repeat the id that
    stays, or have none, that of the smallest fingerprint and hash of the text is kept, and of equal rows one; an id that
    is the smallest of several groups stays with a text of each.
    """
    text = F.xxhash64("text")
    each = settle(fingerprints(docs.select("doc_id", "text", text.alias("digest")), SHINGLE, "digest"))
    own = _grouped(each).filter("doc_id <=> component_id")
    first = own.groupBy("component").agg(F.min(F.struct("doc_id", "fp", "digest")).alias("x"))
    first = first.select(F.col("x.doc_id").alias(ID), F.col("x.digest").alias(FIRST))
    # The ids are as many as the documents: a merge join at every size, by which repeats are found too.
    named = docs.withColumn(DIGEST, text)
    same = F.col("doc_id").eqNullSafe(F.col(ID)) & (F.col(DIGEST) == F.col(FIRST))
    named = named.join(first.hint("merge"), same, "left_semi")
    return named.dropDuplicates(["doc_id", DIGEST]).select(*[F.col(f"`{c}`") for c in docs.columns])
