"""SentencePiece encoding and decoding with the tokenizers library.

The model file is read as the protobuf it is, and its normaliser, space marker, pieces with scores
and byte fallback are rebuilt as a tokenizer. A unigram model keeps its scores as they are; in a BPE
model the scores order the merges, and a merge may give a piece from any two others. Texts
are encoded in batches on ``THREADS`` threads, and by the sentencepiece library too, and the ids compared
(parity), and the pieces of the ids are put together again and compared with what
the normaliser left of it (round trip).

The model's bytes (below a megabyte) go with the task, so executors need no file.
"""

from __future__ import annotations

import os
import re
import struct
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame

MARK = "▁"
BATCH = 256
THREADS = 2
CACHED = 400_000
LINE = 512
# Fixed values of the model format.
NORMAL, UNKNOWN, BYTE = 1, 2, 6
UNIGRAM, BPE_MODEL = 1, 2


def default_model() -> str:
    """The public model file installed beside the libraries."""
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def fields(data: bytes) -> Iterator[tuple[int, int | bytes]]:
    """Number and value of each field of a protobuf message; messages and strings stay bytes."""
    at = 0

    def varint() -> int:
        nonlocal at
        value = shift = 0
        while True:
            byte = data[at]
            at += 1
            value |= (byte & 127) << shift
            if byte < 128:
                return value
            shift += 7

    while at < len(data):
        number, kind = divmod(varint(), 8)
        if kind == 0:
            yield number, varint()
            continue
        size = {1: 8, 5: 4}[kind] if kind != 2 else varint()
        yield number, data[at : at + size]
        at += size


@dataclass
class Spec:
    """What of a model matters for encoding."""

    pieces: list[tuple[str, float, int]] = field(default_factory=list)
    kind: int = UNIGRAM
    byte_fallback: bool = False
    charsmap: bytes = b""
    dummy_prefix: bool = True
    squeeze: bool = True
    escape: bool = True


def parse(data: bytes) -> Spec:
    """Read a model: pieces are field 1, the trainer's settings 2, the normaliser's 3."""
    spec = Spec()
    for number, value in fields(data):
        if number == 1:
            piece, score, kind = "", 0.0, NORMAL
            for n, v in fields(value):
                if n == 1:
                    piece = v.decode("utf-8")
                elif n == 2:
                    score = struct.unpack("<f", v)[0]
                elif n == 3:
                    kind = v
            spec.pieces.append((piece, score, kind))
        elif number == 2:
            for n, v in fields(value):
                if n == 3:
                    spec.kind = v
                elif n == 35:
                    spec.byte_fallback = bool(v)
        elif number == 3:
            for n, v in fields(value):
                if n == 2:
                    spec.charsmap = v
                elif n == 3:
                    spec.dummy_prefix = bool(v)
                elif n == 4:
                    spec.squeeze = bool(v)
                elif n == 5:
                    spec.escape = bool(v)
    return spec


def merges(spec: Spec) -> list[tuple[str, str]]:
    """Pairs of pieces that join to a piece, best score first, earlier pieces first."""
    known = {p for p, _, kind in spec.pieces if kind == NORMAL}
    found = []
    for at, (piece, score, kind) in enumerate(spec.pieces):
        if kind == NORMAL:
            found += [(-score, at, i, piece[:i], piece[i:]) for i in range(1, len(piece)) if piece[:i] in known and piece[i:] in known]
    return [(left, right) for *_, left, right in sorted(found)]


def independent_words(spec: Spec) -> bool:
    """True where no piece has a marker after another character, so that texts part before every marker."""
    return spec.escape and not any(re.search(f"[^{MARK}]{MARK}", p) for p, _, kind in spec.pieces if kind == NORMAL)


def build(spec: Spec, words: bool = False):
    """The tokenizer that encodes and decodes as the model does.

    With ``words`` it parts texts before every marker, which is the same for texts
    without two of them in a row if the model has independent words.
    """
    from tokenizers import Regex, Tokenizer, decoders, models, normalizers, pre_tokenizers

    unknown = next((i for i, p in enumerate(spec.pieces) if p[2] == UNKNOWN), 0)
    if spec.kind == UNIGRAM:
        model = models.Unigram([(p, s) for p, s, _ in spec.pieces], unk_id=unknown, byte_fallback=spec.byte_fallback)
    elif spec.kind == BPE_MODEL:
        vocabulary = {p: i for i, (p, _, _) in enumerate(spec.pieces)}
        model = models.BPE(vocabulary, merges(spec), unk_token=spec.pieces[unknown][0], fuse_unk=True, byte_fallback=spec.byte_fallback, cache_capacity=10_000)
    else:
        raise ValueError(f"models of kind {spec.kind} are neither unigram nor BPE")
    out = Tokenizer(model)
    steps = [normalizers.Precompiled(spec.charsmap)] if spec.charsmap else []
    if spec.squeeze:
        steps += [normalizers.Strip(), normalizers.Replace(Regex(" {2,}"), " ")]
    if spec.dummy_prefix:
        steps.append(normalizers.Prepend(MARK if spec.escape else " "))
    if spec.escape:
        steps.append(normalizers.Replace(" ", MARK))
    out.normalizer = normalizers.Sequence(steps)
    if words:
        out.pre_tokenizer = pre_tokenizers.Metaspace(MARK, "never", True)
    elif independent_words(spec):
        out.pre_tokenizer = pre_tokenizers.Split(Regex(f"{MARK}*[^{MARK}]+|{MARK}+"), "isolated")
    decode = [decoders.Replace(MARK, " ")] if spec.escape else []
    decode += [decoders.ByteFallback()] if spec.byte_fallback else []
    decode.append(decoders.Fuse())
    decode += [decoders.Strip(" ", 1, 0)] if spec.dummy_prefix else []
    out.decoder = decoders.Sequence(decode)
    return out


class Codec:
    """Both ways of the tokenizers library for one model.

    Where words are independent and the normaliser is a prefix and a replacement, a text is
    encoded word by word: words not met before go through the tokenizer, many to a line and
    lines in batches, and the ids are cut where a marker begins a word. Texts with
    runs of spaces or markers of their own go through it as they are. Whatever goes
    through the tokenizer goes through the sentencepiece library too, and must give the same ids.
    """

    def __init__(self, data: bytes, threads: int = 1):
        import sentencepiece

        spec = parse(data)
        self.theirs = sentencepiece.SentencePieceProcessor(model_proto=data)
        self.threads = threads
        self.whole = build(spec)
        plain = independent_words(spec) and not spec.charsmap and not spec.squeeze and spec.dummy_prefix
        self.words = build(spec, True) if plain else None
        self.odd = re.compile(f"^ |  | $|{MARK}")
        self.begins = [p.startswith(MARK) for p, _, _ in spec.pieces]
        # Ids of a word as bytes of 32-bit numbers; words that the other library encodes differently, or that decode to another.
        self.known: dict[str, bytes] = {}
        self.differ: set[str] = set()
        self.lost: set[str] = set()

    def _learn(self, words: list[str]) -> None:
        """Encode, compare and decode words not met before."""
        lines = [words[k : k + LINE] for k in range(0, len(words), LINE)]
        texts = [" ".join(x) for x in lines]
        both = zip(self.words.encode_batch_fast(texts, add_special_tokens=False), self.theirs.encode(texts, num_threads=self.threads))
        fresh: list[list[int]] = []
        for line, (e, same) in zip(lines, both):
            ids = e.ids
            cuts = [i for i, t in enumerate(ids) if self.begins[t]] + [len(ids)]
            own = [ids[i:j] for i, j in zip(cuts, cuts[1:])]
            fresh += own
            self.known.update((w, np.array(x, np.int32).tobytes()) for w, x in zip(line, own))
            if ids != same:
                # Where no single word explains it, all words of the line may.
                self.differ.update([w for w, x in zip(line, own) if x != self.theirs.encode(w)] or line)
        self.lost.update(w for w, t in zip(words, self.decode(fresh)) if w != t)

    def coded(self, texts: list[str]) -> tuple[list[bytes], list[bool], list[bool]]:
        """Ids of every text as 32-bit numbers, whether the sentencepiece library gives the same, and whether they decode
        to what the normaliser left of the text. A text of known words has what its words have."""
        out, same, back = [b""] * len(texts), [True] * len(texts), [True] * len(texts)
        odd = [i for i, t in enumerate(texts) if t and (not self.words or self.odd.search(t))]
        if odd:
            some = [texts[i] for i in odd]
            ids = [e.ids for e in self.whole.encode_batch_fast(some, add_special_tokens=False)]
            theirs = self.theirs.encode(some, num_threads=self.threads)
            for i, x, y, r in zip(odd, ids, theirs, self.returns(ids, some)):
                out[i], same[i], back[i] = np.array(x, np.int32).tobytes(), x == y, r
        if self.words:
            skip = set(odd)
            parts = [(i, t.split(" ")) for i, t in enumerate(texts) if t and i not in skip]
            if len(self.known) > CACHED:
                self.known.clear()
                self.differ.clear()
                self.lost.clear()
            known = self.known
            self._learn(sorted(set().union(*(p for _, p in parts)).difference(known)))
            for i, p in parts:
                out[i] = b"".join(map(known.__getitem__, p))
                same[i] = not self.differ or self.differ.isdisjoint(p)
                back[i] = not self.lost or self.lost.isdisjoint(p)
        return out, same, back

    def encode(self, texts: list[str]) -> tuple[list[list[int]], list[bool]]:
        """Ids of every text, and whether the sentencepiece library gives the same."""
        ids, same, _ = self.coded(texts)
        return [np.frombuffer(x, np.int32).tolist() for x in ids], same

    def decode(self, ids: list[list[int]]) -> list[str]:
        return self.whole.decode_batch(ids, skip_special_tokens=False)

    def returns(self, ids: list[list[int]], texts: list[str]) -> list[bool]:
        """Whether ids decode to what the normaliser left of each text."""
        return [a == self.normalised(t) for a, t in zip(self.decode(ids), texts)]

    def normalised(self, text: str) -> str:
        """What decoding gives back of a text."""
        return self.whole.normalizer.normalize_str(text).replace(MARK, " ").removeprefix(" ")


_built: dict[int, Codec] = {}


def _codec(data: bytes, threads: int) -> Codec:
    """The codec, built once a worker."""
    if hash(data) not in _built:
        os.environ["TOKENIZERS_PARALLELISM"] = "true" if threads > 1 else "false"
        os.environ["RAYON_NUM_THREADS"] = str(threads)
        _built.clear()
        _built[hash(data)] = Codec(data, threads)
    return _built[hash(data)]


def encode(docs: DataFrame, model: str | None = None, text: str = "text", threads: int = THREADS) -> DataFrame:
    """Add ``ids``, ``n_tokens``, ``parity`` and ``round_trip`` to every row.

    A null or empty text has no ids. Special pieces written out in a text are ordinary
    text. Columns of these names are replaced, all others stay. ``model`` is a path that the driver can read.
    """
    with open(model or default_model(), "rb") as f:
        data = f.read()
    shared = docs.sparkSession.sparkContext.broadcast(data)
    rows = docs.drop("ids", "n_tokens", "parity", "round_trip")
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema)

    def coded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ours = _codec(shared.value, threads)
        for batch in batches:
            for k in range(0, len(batch), BATCH):
                part = batch.slice(k, BATCH)
                ids, same, back = ours.coded([t or "" for t in part.column(text).to_pylist()])
                ends = np.cumsum([0] + [len(x) // 4 for x in ids], dtype=np.int32)
                listed = pa.ListArray.from_arrays(ends, np.frombuffer(b"".join(ids), np.int32))
                more = [listed, pa.array(np.diff(ends)), pa.array(same), pa.array(back)]
                yield pa.RecordBatch.from_arrays([*part.columns, *more], [*part.schema.names, "ids", "n_tokens", "parity", "round_trip"])

    return rows.mapInArrow(coded, f"{kinds}, ids array<int>, n_tokens int, parity boolean, round_trip boolean")


def decode(rows: DataFrame, model: str | None = None, ids: str = "ids", threads: int = THREADS) -> DataFrame:
    """Add ``decoded``, the text of ``ids``; null ids give a null text, no ids an empty one."""
    with open(model or default_model(), "rb") as f:
        data = f.read()
    shared = rows.sparkSession.sparkContext.broadcast(data)
    kept = rows.drop("decoded")
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kept.schema)

    def texts(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        ours = _codec(shared.value, threads)
        for batch in batches:
            for k in range(0, len(batch), BATCH):
                part = batch.iloc[k : k + BATCH].copy()
                found = ours.decode([[] if i is None else [int(x) for x in i] for i in part[ids]])
                part["decoded"] = [None if i is None else t for i, t in zip(part[ids], found)]
                yield part

    return kept.mapInPandas(texts, f"{kinds}, decoded string")
