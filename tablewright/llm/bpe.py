"""Byte-level BPE encoding and decoding.

A text is cut into pieces by the vocabulary's pattern. Each distinct piece is encoded once
per task: a segment tree stands over its adjacent pairs, each leaf holding
``rank * width + position`` of a mergeable pair, so that the root is the leftmost pair of
the lowest rank. A merge rewrites at most three leaves and their paths to the root. The
trees of many short pieces are walked together in numpy; a long piece has a tree of its own.

Defined cases: a null text counts as empty and has no ids; the strings of added tokens in a
text become their ids; ids outside the vocabulary decode to nothing; bytes that are not
UTF-8 decode to U+FFFD; texts of any length are encoded whole; repeated rows each have a row,
with or without an id; an empty table gives an empty result; other columns are kept, those
named like a result are replaced by it.
"""

from __future__ import annotations

import json
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, functions as F, types as T

from tablewright.llm.common import quoted, slices, text_lengths

#: Fixed value: the pattern of the vocabulary that cuts text before any merge.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""

NONE = np.int64(1) << 62
WIDTHS = (2, 4, 8, 16, 32, 64)       # longer pieces get a tree of their own
CACHED_PIECES = 200_000              # a worker forgets its pieces beyond this number
SLICE_BYTES = 1 << 20                # text handled at once


def byte_characters() -> list[str]:
    """The character that stands for each byte in the vocabulary file: printable Latin-1
    characters stand for themselves, the others follow from U+0100 on."""
    plain = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    out, extra = [], 0
    for b in range(256):
        out.append(chr(b) if b in plain else chr(256 + extra))
        extra += b not in plain
    return out


@dataclass
class Vocabulary:
    byte_ids: np.ndarray             # id of each byte
    pair_keys: np.ndarray            # sorted keys left * SHIFT + right of mergeable pairs
    pair_ranks: np.ndarray
    merged: np.ndarray               # by rank: id of the merged pair
    token_bytes: np.ndarray          # bytes of all tokens, one after another
    token_starts: np.ndarray         # by id, one more than ids
    added: dict[str, int] = field(default_factory=dict)

    SHIFT = 1 << 20

    def pair_rank(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        key = left.astype(np.int64) * self.SHIFT + right
        at = np.minimum(np.searchsorted(self.pair_keys, key), len(self.pair_keys) - 1)
        return np.where((self.pair_keys[at] == key) & (left >= 0) & (right >= 0), self.pair_ranks[at], NONE)


def load_vocabulary(path: str) -> Vocabulary:
    """Read a byte-level BPE vocabulary (JSON) on the driver."""
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    vocab, merges = spec["model"]["vocab"], spec["model"]["merges"]
    pairs = [tuple(m) if not isinstance(m, str) else tuple(m.split(" ")) for m in merges]
    chars = byte_characters()
    to_byte = {c: b for b, c in enumerate(chars)}
    added = {t["content"]: t["id"] for t in spec.get("added_tokens", [])}
    size = max([*vocab.values(), *added.values()]) + 1
    pieces = [b""] * size
    for token, i in vocab.items():
        pieces[i] = bytes(to_byte[c] for c in token)
    for token, i in added.items():
        pieces[i] = token.encode()
    keys = np.array([vocab[a] * Vocabulary.SHIFT + vocab[b] for a, b in pairs], np.int64)
    order = np.argsort(keys)
    return Vocabulary(
        byte_ids=np.array([vocab[c] for c in chars], np.int32),
        pair_keys=keys[order], pair_ranks=order.astype(np.int64),
        merged=np.array([vocab[a + b] for a, b in pairs], np.int32),
        token_bytes=np.frombuffer(b"".join(pieces), np.uint8),
        token_starts=np.concatenate([[0], np.cumsum([len(p) for p in pieces])]).astype(np.int64),
        added=added)


def gather(values: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """``values[start:start + length]`` of each pair, one after another."""
    total = int(lengths.sum())
    before = np.cumsum(lengths) - lengths
    return values[np.repeat(starts - before, lengths) + np.arange(total)]


def merge_short(v: Vocabulary, sym: np.ndarray, length: np.ndarray, width: int):
    """Merge rows of symbols (n x width) of the given lengths; (ids, ids per row)."""
    n = len(sym)
    edge = np.full((n, 1), -1, np.int32)
    sym = np.concatenate([sym, edge], axis=1)
    place = np.arange(width)
    alive = place < length[:, None]
    sym[:, :width][~alive] = -1
    nxt = np.where(place + 1 < length[:, None], place + 1, width)
    prv = np.tile(np.concatenate([[width], place]), (n, 1))       # prv[0] is the edge
    nxt = np.concatenate([nxt, np.full((n, 1), width)], axis=1)
    tree = np.full((n, 2 * width), NONE)
    rank = v.pair_rank(sym[:, :width].ravel(), sym[:, 1:].ravel()).reshape(n, width)
    tree[:, width:] = np.where(rank < NONE, rank * width + place, NONE)
    for node in range(width - 1, 0, -1):
        tree[:, node] = np.minimum(tree[:, 2 * node], tree[:, 2 * node + 1])

    def put(rows, leaf, value):
        node = leaf + width
        tree[rows, node] = value
        while True:
            node = node >> 1
            if not node[0]:
                break
            tree[rows, node] = np.minimum(tree[rows, 2 * node], tree[rows, 2 * node + 1])

    rows = np.flatnonzero(tree[:, 1] < NONE)
    while len(rows):
        top = tree[rows, 1]
        i = top % width
        j = nxt[rows, i]
        k = nxt[rows, j]
        sym[rows, i] = v.merged[top // width]
        nxt[rows, i] = k
        prv[rows, k] = i
        alive[rows, j] = False
        put(rows, j, NONE)
        rank = v.pair_rank(sym[rows, i], sym[rows, k])
        put(rows, i, np.where(rank < NONE, rank * width + i, NONE))
        p = prv[rows, i]
        has = np.flatnonzero(p < width)
        if len(has):
            r, q = rows[has], p[has]
            rank = v.pair_rank(sym[r, q], sym[r, i[has]])
            put(r, q, np.where(rank < NONE, rank * width + q, NONE))
        rows = rows[tree[rows, 1] < NONE]
    return sym[:, :width][alive], alive.sum(axis=1)


def merge_long(v: Vocabulary, sym: np.ndarray) -> np.ndarray:
    """Merge one row of symbols with one tree."""
    n = len(sym)
    width = 1 << (n - 1).bit_length()
    none = int(NONE)
    rank = v.pair_rank(sym[:-1], sym[1:])
    leaves = np.full(width, NONE)
    leaves[:n - 1] = np.where(rank < NONE, rank * width + np.arange(n - 1), NONE)
    levels = [leaves]
    while len(levels[-1]) > 1:
        levels.append(levels[-1].reshape(-1, 2).min(axis=1))
    tree = [none] + np.concatenate(levels[::-1]).tolist()
    ids, nxt, prv = sym.tolist(), list(range(1, n + 1)), list(range(-1, n - 1))
    ranks = dict(zip(v.pair_keys.tolist(), v.pair_ranks.tolist())) if n > 5000 else None

    def pair(a, b):
        if ranks is not None:
            return ranks.get(a * v.SHIFT + b, none)
        return int(v.pair_rank(np.array([a]), np.array([b]))[0])

    def put(leaf, value):
        node = leaf + width
        tree[node] = value
        while node > 1:
            node >>= 1
            a, b = tree[2 * node], tree[2 * node + 1]
            value = a if a < b else b
            if tree[node] == value:
                break
            tree[node] = value

    while tree[1] < none:
        r, i = divmod(tree[1], width)
        j = nxt[i]
        k = nxt[j]
        ids[i], ids[j] = int(v.merged[r]), -1
        nxt[i] = k
        put(j, none)
        if k < n:
            prv[k] = i
            r = pair(ids[i], ids[k])
            put(i, r * width + i if r < none else none)
        else:
            put(i, none)
        p = prv[i]
        if p >= 0:
            r = pair(ids[p], ids[i])
            put(p, r * width + p if r < none else none)
    out = np.array(ids, np.int32)
    return out[out >= 0]


def encode_pieces(v: Vocabulary, pieces: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Ids of all pieces one after another, and the number of ids of each."""
    length = np.fromiter(map(len, pieces), np.int64, len(pieces))
    sym = v.byte_ids[np.frombuffer(b"".join(pieces), np.uint8)]
    start = np.cumsum(length) - length
    counts = np.minimum(length, 1)
    parts: list[tuple[np.ndarray, np.ndarray]] = []
    one = np.flatnonzero(length == 1)
    parts.append((one, sym[start[one]]))
    low = 1
    for width in WIDTHS:
        rows = np.flatnonzero((length > low) & (length <= width))
        low = width
        for at in range(0, len(rows), 20_000):
            some = rows[at:at + 20_000]
            grid = start[some][:, None] + np.arange(width)
            ids, n = merge_short(v, sym[np.minimum(grid, len(sym) - 1)], length[some], width)
            counts[some] = n
            parts.append((some, ids))
    for row in np.flatnonzero(length > low).tolist():
        ids = merge_long(v, sym[start[row]:start[row] + length[row]])
        counts[row] = len(ids)
        parts.append((np.array([row]), ids))
    out = np.empty(int(counts.sum()), np.int32)
    begin = np.cumsum(counts) - counts
    for rows, ids in parts:
        n = counts[rows]
        out[gather(np.arange(len(out)), begin[rows], n)] = ids
    return out, counts


class Encoder:
    """Encodes texts piece by piece and remembers the pieces it has met."""

    def __init__(self, v: Vocabulary):
        self.v = v
        self.cut = regex.compile(PATTERN).findall
        self.split_added = regex.compile("(" + "|".join(map(regex.escape, sorted(
            v.added, key=len, reverse=True))) + ")").split if v.added else None
        self.forget()

    def forget(self):
        self.known: dict[str, int] = {}
        self.ids = np.zeros(0, np.int32)
        self.starts = np.zeros(0, np.int64)
        self.counts = np.zeros(0, np.int64)

    def pieces(self, text: str) -> list[str]:
        if self.split_added is None or not any(a in text for a in self.v.added):
            return self.cut(text)
        out = []
        for part in self.split_added(text):
            # an added token is known by a key that no piece of text can be
            out += [(part,)] if part in self.v.added else self.cut(part)
        return out

    def _learn(self, new: list):
        coded = [p for p in new if isinstance(p, str)]
        ids, counts = encode_pieces(self.v, [p.encode() for p in coded]) if coded else (
            np.zeros(0, np.int32), np.zeros(0, np.int64))
        marks = [p for p in new if not isinstance(p, str)]
        ids = np.concatenate([ids, np.array([self.v.added[p[0]] for p in marks], np.int32)])
        counts = np.concatenate([counts, np.ones(len(marks), np.int64)])
        base = len(self.starts)
        for i, p in enumerate(coded + marks):
            self.known[p] = base + i
        self.starts = np.concatenate([self.starts, len(self.ids) + np.cumsum(counts) - counts])
        self.counts = np.concatenate([self.counts, counts])
        self.ids = np.concatenate([self.ids, ids])

    def encode(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts one after another, and the number of ids of each."""
        if len(self.known) > CACHED_PIECES:
            self.forget()
        cut = [self.pieces(t) if t else [] for t in texts]
        flat = [p for c in cut for p in c]
        new = set(flat).difference(self.known)
        if new:
            self._learn(list(new))
        at = np.fromiter(map(self.known.__getitem__, flat), np.int64, len(flat))
        n = self.counts[at]
        ids = gather(self.ids, self.starts[at], n)
        upto = np.concatenate([[0], np.cumsum(n)])
        ends = np.cumsum([len(c) for c in cut]) if cut else np.zeros(0, np.int64)
        return ids, np.diff(np.concatenate([[0], upto[ends]]))


_ENCODERS: dict[str, Encoder] = {}


def _encoder(name: str, vocabulary) -> Encoder:
    if name not in _ENCODERS:
        _ENCODERS[name] = Encoder(vocabulary.value)
    return _ENCODERS[name]


def decode_ids(v: Vocabulary, ids: np.ndarray, counts: np.ndarray) -> list[str]:
    ids = ids.astype(np.int64)
    known = (ids >= 0) & (ids < len(v.token_starts) - 1)
    ids = np.where(known, ids, 0)
    length = np.where(known, v.token_starts[ids + 1] - v.token_starts[ids], 0)
    raw = gather(v.token_bytes, v.token_starts[ids], length).tobytes()
    upto = np.concatenate([[0], np.cumsum(length)])
    ends = upto[np.cumsum(counts)].tolist()
    return [raw[a:b].decode("utf-8", "replace") for a, b in zip([0] + ends[:-1], ends)]


def _add_columns(docs: DataFrame, drop: list[str], schema: str, compute) -> DataFrame:
    """``docs`` without ``drop`` and with the columns that ``compute`` makes of a batch.

    One Python stage. Batches are cut by the size of their texts or ids, so that memory does
    not follow the length of documents (a single one is handled whole).
    """
    gone = {d.lower() for d in drop}
    kept = [c for c in docs.columns if c.lower() not in gone]

    def run(batches):
        for whole in batches:
            for batch in compute.cut(whole):
                yield pa.RecordBatch.from_arrays(
                    [batch.column(c) for c in kept] + compute(batch), kept + compute.names)

    fields = docs.select(*[quoted(docs, c) for c in kept]).schema
    for f in T._parse_datatype_string(schema).fields:
        fields = fields.add(f)
    return docs.mapInArrow(run, fields)


class _Coding:
    """What a worker does with a batch: encode, decode, or encode and decode the ids."""

    def __init__(self, path, vocabulary, source, encodes, decodes, names):
        self.path, self.vocabulary, self.source, self.names = path, vocabulary, source, names
        self.encodes, self.decodes = encodes, decodes

    def cut(self, whole):
        col = whole.column(self.source)
        if self.encodes:
            return slices(whole, text_lengths(whole, self.source), SLICE_BYTES)
        return slices(whole, np.diff(col.offsets.to_numpy()), SLICE_BYTES // 4)

    def __call__(self, batch):
        col = batch.column(self.source)
        if self.encodes:
            ids, counts = _encoder(self.path, self.vocabulary).encode(col.to_pylist())
        else:
            counts = np.diff(col.offsets.to_numpy().astype(np.int64))
            ids = col.flatten().to_numpy(zero_copy_only=False)
        out = []
        if self.encodes:
            ends = np.concatenate([[0], np.cumsum(counts)]).astype(np.int32)
            out.append(pa.ListArray.from_arrays(pa.array(ends), pa.array(ids, pa.int32())))
        if self.decodes:
            out.append(pa.array(decode_ids(self.vocabulary.value, ids, counts), pa.string()))
        return out


def _broadcast(df: DataFrame, path: str):
    return df.sparkSession.sparkContext.broadcast(load_vocabulary(path))


def encode(docs: DataFrame, path: str, text_col: str = "text", ids_col: str = "ids") -> DataFrame:
    """``docs`` with a column of token ids (array of int); a column of that name is replaced."""
    coding = _Coding(path, _broadcast(docs, path), text_col, True, False, [ids_col])
    return _add_columns(docs, [ids_col], f"`{ids_col}` array<int>", coding)


def decode(coded: DataFrame, path: str, ids_col: str = "ids", text_col: str = "decoded") -> DataFrame:
    """``coded`` with the text of its token ids (null ids: empty text)."""
    coded = coded.withColumn(ids_col, F.coalesce(quoted(coded, ids_col), F.array().cast("array<int>")))
    coding = _Coding(path, _broadcast(coded, path), ids_col, False, True, [text_col])
    return _add_columns(coded, [text_col], f"`{text_col}` string", coding)


def round_trip(docs: DataFrame, path: str, text_col: str = "text", ids_col: str = "ids",
               decoded_col: str = "decoded") -> DataFrame:
    """``docs`` without its text, with the ids and the text decoded from them: both steps in
    one Python stage, for callers that want to check what they write."""
    coding = _Coding(path, _broadcast(docs, path), text_col, True, True, [ids_col, decoded_col])
    return _add_columns(docs, [text_col, ids_col, decoded_col],
                        f"`{ids_col}` array<int>, `{decoded_col}` string", coding)
