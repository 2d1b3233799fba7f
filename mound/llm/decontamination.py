"""Benchmark decontamination by suffix arrays over the training texts.

Words of benchmark items are numbered (a block of items of bounded size at a time), documents
become sequences of those numbers, 0 for any other word, and about ``SHARD`` words of documents at a
time get a suffix array: suffixes sorted by packed words first and by doubling after that,
ended by the next 0, as no item goes beyond it. Every suffix of every item is searched in every
shard's array by bisection; its neighbours there give the longest verbatim match, and where that is as
long as a window, the range of the window gives all its places. Windows have ``WINDOW`` words; an
item of fewer words is one window.

Documents are not shuffled and wait for no other document: a passage that a third of all
documents hold is so many places in many shards. A document longer than a shard is cut into pieces that
overlap by the longest item. Items travel as broadcasts of about ``BLOCK`` bytes of text, dealt by
hash; each further block is one more pass over the rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from mound.llm.tables import row_hash, settle, text_of

WINDOW = 10
SHARD = 1 << 20
BLOCK = 2 << 20

# Fixed values of the contract: words are runs of digits, letters and everything beyond ASCII.
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
_TABLE = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c > 127 else 32 for c in range(256))

SPANS = "array<struct<start:long,stop:long>>"
LEAK = f"struct<n_words:long,n_hit:long,spans:{SPANS},items:array<string>>"
_SPAN = pa.list_(pa.struct([("start", pa.int64()), ("stop", pa.int64())]))
_LEAK = pa.struct([("n_words", pa.int64()), ("n_hit", pa.int64()), ("spans", _SPAN), ("items", pa.list_(pa.string()))])


def words_of(text: str | None) -> list[bytes]:
    """Words in lower case, as UTF-8."""
    return (text or "").encode("utf-8", "surrogatepass").translate(_TABLE).split()


def numbered(words: list[bytes], vocabulary: dict[bytes, int]) -> np.ndarray:
    return np.fromiter(map(vocabulary.get, words, repeat(0)), np.int64, len(words))


def until_stop(ids: np.ndarray) -> np.ndarray:
    """For every place the words from there on before the next 0."""
    at = np.where(ids == 0, np.arange(len(ids)), len(ids))
    return np.minimum.accumulate(at[::-1])[::-1] - np.arange(len(ids))


def suffix_array(ids: np.ndarray, depth: int) -> np.ndarray:
    """Places of words other than 0 in the order of the suffixes there, ``depth`` words at least compared.

    A suffix ends before the next 0, and an ended one stands before those that go on.
    """
    n = len(ids)
    run = until_stop(ids)
    bits = max(1, int(ids.max(initial=0)).bit_length())
    width = max(1, min(63 // bits, depth))
    ahead = np.concatenate([ids, np.zeros(width, np.int64)])
    key = np.zeros(n, np.int64)
    for j in range(width):
        key = key << bits | np.where(run > j, ahead[j : j + n], 0)
    order = np.flatnonzero(ids)
    order = order[np.argsort(key[order], kind="stable")]
    if not len(order):
        return order
    # A rank is the place in the array of the first suffix alike, from 1; 0 for places without a suffix.
    first = np.concatenate([[True], np.diff(key[order]) != 0])
    rank = np.zeros(n + 1, np.int64)
    rank[order] = np.maximum.accumulate(np.where(first, np.arange(1, len(order) + 1), 0))
    while width < depth:
        same = np.concatenate([~first[1:], [False]]) | ~first
        tied = np.flatnonzero(same & (run[order] >= width))
        if not len(tied):
            break
        at = order[tied]
        group, then = rank[at], rank[np.minimum(at + width, n)]
        by = np.lexsort((then, group))
        at, group, then = at[by], group[by], then[by]
        order[tied] = at
        new = np.concatenate([[True], (np.diff(group) != 0) | (np.diff(then) != 0)])
        first[tied] = new
        rank[at] = np.maximum.accumulate(np.where(new, tied + 1, 0))
        width *= 2
    return order


@dataclass
class Items:
    """A block of items: their words numbered, their suffixes and windows, and whose windows they are."""

    vocabulary: dict[bytes, int]
    ids: np.ndarray  # of all items, one after the other
    starts: np.ndarray  # of every suffix
    lengths: np.ndarray  # of every suffix, to the end of its item
    windows: np.ndarray  # length of the window at that suffix; 0 if there is none
    owners: list[tuple[str, ...]]  # items with that window
    of: np.ndarray  # owners of every suffix, by number
    item: list[str]  # item of every suffix

    @property
    def depth(self) -> int:
        return int(self.lengths.max(initial=1))


def index(rows: list[tuple[str, str]], window: int = WINDOW) -> Items:
    """Items from pairs of id and text. Equal ids are one item; equal texts are searched once."""
    vocabulary: dict[bytes, int] = {}
    by_words: dict[tuple[int, ...], set[str]] = {}
    for name, text in rows:
        words = words_of(text)
        if words:
            by_words.setdefault(tuple(vocabulary.setdefault(w, len(vocabulary) + 1) for w in words), set()).add(name)
    holders: dict[tuple[int, ...], set[str]] = {}
    for words, names in by_words.items():
        size = min(window, len(words))
        for i in range(len(words) - size + 1):
            holders.setdefault(words[i : i + size], set()).update(names)
    owners: dict[tuple[str, ...], int] = {}
    ids, starts, lengths, windows, of, item, at = [], [], [], [], [], [], 0
    for words, names in by_words.items():
        size = min(window, len(words))
        for i in range(len(words)):
            held = i + size <= len(words)
            starts.append(at + i)
            lengths.append(len(words) - i)
            windows.append(size if held else 0)
            of.append(owners.setdefault(tuple(sorted(holders[words[i : i + size]])), len(owners)) if held else -1)
            item.append(min(names))
        ids.extend(words)
        at += len(words)
    whole = [np.array(x, dtype=np.int64) for x in (ids, starts, lengths, windows, of)]
    return Items(vocabulary, *whole[:4], list(owners), whole[4], item)


class Shard:
    """Word numbers of some documents with their suffix array."""

    def __init__(self, ids: np.ndarray, items: Items):
        self.items = items
        self.ids = np.concatenate([ids, [0]])
        self.array = suffix_array(self.ids, items.depth)

    def common(self, places: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Words that a suffix and (the first ``lengths`` words of) a test suffix share, and the sign of the first that differs."""
        shared, sign = np.zeros(len(places), np.int64), np.zeros(len(places), np.int64)
        left = np.arange(len(places))
        j = 0
        while len(left):
            left = left[lengths[left] > j]
            a = self.ids[np.minimum(places[left] + j, len(self.ids) - 1)]
            b = self.items.ids[starts[left] + j]
            differ = a != b
            sign[left[differ]] = np.sign(a[differ] - b[differ])
            left = left[~differ]
            shared[left] += 1
            j += 1
        return shared, sign

    def bisect(self, starts: np.ndarray, lengths: np.ndarray, after: bool) -> np.ndarray:
        """The first place in the array whose suffix is not before the test suffix, or is after all that begin with it."""
        low, high = np.zeros(len(starts), np.int64), np.full(len(starts), len(self.array))
        while (open_ := np.flatnonzero(low < high)).size:
            mid = (low[open_] + high[open_]) // 2
            sign = self.common(self.array[mid], starts[open_], lengths[open_])[1]
            up = sign <= 0 if after else sign < 0
            low[open_[up]] = mid[up] + 1
            high[open_[~up]] = mid[~up]
        return low

    def longest(self) -> tuple[np.ndarray, np.ndarray]:
        """For every test suffix the words of its longest match and one place of it."""
        x = self.items
        best, place = np.zeros(len(x.starts), np.int64), np.zeros(len(x.starts), np.int64)
        if not len(self.array):
            return best, place
        at = self.bisect(x.starts, x.lengths, False)
        for beside in (at - 1, at):
            there = np.flatnonzero((beside >= 0) & (beside < len(self.array)))
            places = self.array[beside[there]]
            shared = self.common(places, x.starts[there], x.lengths[there])[0]
            more = shared > best[there]
            best[there[more]], place[there[more]] = shared[more], places[more]
        return best, place

    def hits(self) -> tuple[np.ndarray, np.ndarray]:
        """All places of windows of items, and the suffix whose window it is (of equal windows the first)."""
        x = self.items
        found = np.flatnonzero((x.windows > 0) & (self.longest()[0] >= x.windows))
        low = self.bisect(x.starts[found], x.windows[found], False)
        high = self.bisect(x.starts[found], x.windows[found], True)
        # Equal windows have equal ranges.
        _, once = np.unique(np.stack([low, high, x.windows[found]]), axis=1, return_index=True)
        found, low, n = found[once], low[once], (high - low)[once]
        step = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        return self.array[np.repeat(low, n) + step], np.repeat(found, n)


def shards(texts: list[str | None], items: Items, size: int = SHARD) -> Iterator[tuple[Shard, np.ndarray, np.ndarray, np.ndarray]]:
    """Suffix arrays over texts: each with the begin, the document and its first word there of every piece."""
    kept: list[tuple[np.ndarray, int, int]] = []
    held = 0

    def built() -> tuple[Shard, np.ndarray, np.ndarray, np.ndarray]:
        ids = np.concatenate([np.concatenate([p, [0]]) for p, _, _ in kept])
        begins = np.cumsum([0] + [len(p) + 1 for p, _, _ in kept[:-1]])
        return Shard(ids, items), begins, np.array([d for _, d, _ in kept]), np.array([o for _, _, o in kept])

    for doc, text in enumerate(texts):
        ids = numbered(words_of(text), items.vocabulary)
        for offset in range(0, max(1, len(ids)), size):
            piece = ids[offset : offset + size + items.depth - 1]
            kept.append((piece, doc, offset))
            held += len(piece) + 1
            if held >= size:
                yield built()
                kept, held = [], 0
    if kept:
        yield built()


def _joined(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Intervals in order, those that meet as one."""
    out: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def leaks(texts: list[str | None], items: Items, size: int = SHARD) -> tuple[list[list[tuple[int, int]]], list[set[str]]]:
    """Per text: intervals of words inside occurrences of windows, and the items of those windows."""
    spans: list[list[tuple[int, int]]] = [[] for _ in texts]
    owners: list[set[int]] = [set() for _ in texts]
    for shard, begins, docs, offsets in shards(texts, items, size):
        places, suffixes = shard.hits()
        if not len(places):
            continue
        n = len(shard.ids) + 1
        cover = np.cumsum(np.bincount(places, minlength=n) - np.bincount(places + items.windows[suffixes], minlength=n)) > 0
        edges = np.flatnonzero(np.diff(np.concatenate([[False], cover]).astype(np.int8)))
        piece = np.searchsorted(begins, edges[::2], "right") - 1
        move = offsets[piece] - begins[piece]
        for d, a, b in zip(docs[piece].tolist(), (edges[::2] + move).tolist(), (edges[1::2] + move).tolist()):
            spans[d].append((a, b))
        of = docs[np.searchsorted(begins, places, "right") - 1]
        for d, o in np.unique(np.stack([of, items.of[suffixes]], axis=1), axis=0).tolist():
            owners[d].add(o)
    return [_joined(s) for s in spans], [set().union(*(items.owners[i] for i in o)) for o in owners]


def blocks(items: DataFrame, window: int, most: int) -> Iterator[Items]:
    """Items in blocks of about ``most`` bytes, by hash; each is brought to the driver and gone when the next comes."""
    rows = items.select(F.coalesce(F.col("item_id").cast("string"), F.lit("")).alias("item_id"), text_of("text").alias("text"))
    rows = settle(rows.distinct())
    total = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n = max(1, -(-total // most))
    for k in range(n):
        some = rows if n == 1 else rows.filter(F.pmod(row_hash(41, "item_id", "text"), F.lit(n)) == k)
        yield index([tuple(r) for r in some.toLocalIterator()], window)


def find(docs: DataFrame, items: DataFrame, text: str = "text", name: str = "leak", keep_text: bool = True, window: int = WINDOW, shard: int = SHARD, block: int = BLOCK) -> DataFrame:
    """Add ``name``: ``n_words``, ``n_hit``, ``spans`` of words [start, stop) and ``items`` that occur.

    ``items`` has ``item_id`` and ``text``; ids are compared as strings, a null one is ``''``,
    and rows of one id are one item. Null, empty and wordless texts of items have no window;
    those of documents have no words and no hits. All rows of ``docs`` stay, repeated
    ones too, with all columns; a column called ``name`` is replaced, and without ``keep_text`` the text goes.
    """
    rows = docs.drop(name)
    context = docs.sparkSession.sparkContext
    plain = T.StructType([*rows.schema.fields, T.StructField(name, T.StructType.fromDDL(f"x {LEAK}")["x"].dataType)])

    def search(shared, old: bool):
        def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            x = shared.value
            for batch in batches:
                texts = batch.column(text).to_pylist()
                spans, names = leaks(texts, x, shard)
                before = batch.column(name).to_pylist() if old else [None] * len(texts)
                cells = []
                for t, s, i, b in zip(texts, spans, names, before):
                    if b:
                        s = _joined(s + [(p["start"], p["stop"]) for p in b["spans"]])
                        i = i.union(b["items"])
                    n = b["n_words"] if b else len(words_of(t))
                    cells.append({"n_words": n, "n_hit": sum(q - p for p, q in s), "spans": [{"start": p, "stop": q} for p, q in s], "items": sorted(i)})
                kept = [c for c in batch.schema.names if c != name]
                yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in kept), pa.array(cells, _LEAK)], [*kept, name])

        return each

    found = rows
    for k, part in enumerate(blocks(items, window, block)):
        found = found.mapInArrow(search(context.broadcast(part), k > 0), plain)
    return found if keep_text else found.drop(text)


def remove(docs: DataFrame, items: DataFrame, text: str = "text", window: int = WINDOW) -> DataFrame:
    """The documents that hold no window of any item, with the columns they had."""
    name = "leak"
    while name in docs.columns:
        name += "_"
    return find(docs, items, text, name, window=window).filter(F.col(name)["n_hit"] == 0).drop(name)


def longest(docs: DataFrame, items: DataFrame, key: str = "doc_id", text: str = "text", least: int = WINDOW, shard: int = SHARD, block: int = BLOCK) -> DataFrame:
    """The longest verbatim match of each item, and where it is.

    ``item_id``, ``n_words``, ``item_start``, ``key``, ``doc_start`` (words from 0), for items with a match of ``least``
    words or more. Of equally long ones the smallest key, then the first place, wins. Of items with equal texts one, the
    smallest id, is named.
    """
    rows = docs.select(F.col(key).alias("key"), F.col(text).alias("text"))
    context = docs.sparkSession.sparkContext
    whose = rows.schema["key"].dataType.simpleString()

    def search(shared):
        def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            x = shared.value
            first = {t: i for i, t in reversed(list(enumerate(x.item)))}
            for batch in batches:
                out: list[tuple] = []
                keys = batch.column("key").to_pylist()
                for s, begins, of, offsets in shards(batch.column("text").to_pylist(), x, shard):
                    n, at = s.longest()
                    # The whole range of the longest match: its smallest key is wanted.
                    found = np.flatnonzero(n >= least)
                    best: dict[str, int] = {}
                    for i in found.tolist():
                        best[x.item[i]] = max(best.get(x.item[i], 0), int(n[i]))
                    found = np.array([i for i in found.tolist() if n[i] == best[x.item[i]]], dtype=np.int64)
                    low, high = (s.bisect(x.starts[found], n[found], after) for after in (False, True))
                    for i, a, b in zip(found.tolist(), low.tolist(), high.tolist()):
                        places = s.array[a:b]
                        p = np.searchsorted(begins, places, "right") - 1
                        seen = min(zip((keys[d] for d in of[p].tolist()), (offsets[p] + places - begins[p]).tolist()), key=lambda v: (v[0] is None, v))
                        out.append((x.item[i], int(n[i]), i - first[x.item[i]], *seen))
                columns = zip(*out) if out else [[]] * 5
                kinds = (pa.string(), pa.int64(), pa.int64(), batch.schema.field("key").type, pa.int64())
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], ["item_id", "n_words", "item_start", "key", "doc_start"])

        return each

    found = None
    for part in blocks(items, least, block):
        some = rows.mapInArrow(search(context.broadcast(part)), f"item_id string, n_words long, item_start long, key {whose}, doc_start long")
        found = some if found is None else found.unionByName(some)
    at = F.min(F.struct(-F.col("n_words"), F.col("key").isNull(), "key", "doc_start", "item_start", "n_words")).alias("m")
    best = found.groupBy("item_id").agg(at)
    return best.select("item_id", "m.n_words", "m.item_start", F.col("m.key").alias(key), "m.doc_start")


def digest(docs: DataFrame, items: DataFrame) -> DataFrame:
    """The contract's columns for every document."""
    leak = F.col("leak")
    found = find(docs.select("doc_id", "text"), items, keep_text=False)
    return found.select(
        "doc_id",
        leak["n_words"].alias("n_words"),
        leak["n_hit"].alias("n_hit"),
        F.size(leak["items"]).cast("long").alias("n_items"),
        F.sha2(F.array_join(leak["items"], ","), 256).alias("items_sha256"),
        (leak["n_hit"] > 0).alias("contaminated"),
    )


ORACLE = rf"""
with low as (
  select doc_id, row_number() over () as r,
    regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{WORD}') as w
  from documents),
items as (
  select coalesce(item_id::varchar, '') as item_id,
    regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{WORD}') as w
  from benchmark),
windows as (
  select distinct item_id, size, array_to_string(w[i : i + size - 1], ' ') as gram
  from (select *, least(len(w), {WINDOW}) as size from items where len(w) > 0) s,
    lateral (select unnest(range(1, len(w) - size + 2)) as i) p),
places as (
  select r, i, z.size, array_to_string(w[i : i + z.size - 1], ' ') as gram
  from low, (select distinct size from windows) z, lateral (select unnest(range(1, len(w) - z.size + 2)) as i) p),
found as (select p.r, p.i, p.size, v.item_id from places p join windows v on p.size = v.size and p.gram = v.gram),
hit as (select r, count(distinct j) as n_hit from (select r, unnest(range(i, i + size)) as j from (select distinct r, i, size from found) q) p group by r),
whose as (
  select r, count(*) as n_items, string_agg(item_id, ',' order by item_id) as names
  from (select distinct r, item_id from found) q group by r)
select doc_id, len(w)::bigint as n_words, coalesce(n_hit, 0)::bigint as n_hit, coalesce(n_items, 0)::bigint as n_items,
  sha256(coalesce(names, '')) as items_sha256, coalesce(n_hit, 0) > 0 as contaminated
from low left join hit using (r) left join whose using (r)
"""
