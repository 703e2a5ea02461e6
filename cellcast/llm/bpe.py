"""Byte-level BPE encoding and decoding.

Encoding works on many pieces at once. The distinct pieces of a batch are laid out
in one symbol sequence; an index maps the pairs that can merge, by rank, to all
positions at which they stand. The ranks that occur are applied in ascending order:
all occurrences of a pair are merged from left to right, and the lists of the pairs
that a merge changes are updated. Texts are then put together from their pieces.

Documents never meet, so the operator has no shuffle; its memory is bounded by the
batch and by ``MEMO_PIECES`` remembered pieces per worker.

Null texts are read as empty ones and give no tokens; columns beyond ``doc_id`` and
``text`` are not read; repeated rows are encoded each for itself; an empty table
gives an empty result.
"""

from __future__ import annotations

import hashlib
import json
import re
import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cellcast.llm.text import SLICE_BYTES, Words, mix64, slices, small_batches, utf8, word_hashes

MEMO_PIECES = 400_000
BATCH_BYTES = SLICE_BYTES
RANK_BLOCK = 512
NO_PAIR = np.int64(1 << 40)
SCHEMA = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"

# Ranges of Unicode White_Space, which the tokenizer's pattern calls \s.
WHITE_SPACE = [(0x09, 0x0D), (0x20, 0x20), (0x85, 0x85), (0xA0, 0xA0), (0x1680, 0x1680), (0x2000, 0x200A),
               (0x2028, 0x2029), (0x202F, 0x202F), (0x205F, 0x205F), (0x3000, 0x3000)]
SPACE, LETTER, NUMBER, OTHER = range(4)


@lru_cache(maxsize=1)
def char_classes() -> np.ndarray:
    """Class of every code point, as the tokenizer's pattern tells them apart."""
    group = {"L": LETTER, "N": NUMBER}
    table = np.array([group.get(unicodedata.category(chr(c))[0], OTHER) for c in range(0x110000)], np.uint8)
    table[[c for lo, hi in WHITE_SPACE for c in range(lo, hi + 1)]] = SPACE
    return table


def cut_pieces(data: np.ndarray, offs: np.ndarray) -> np.ndarray:
    """Byte positions at which the pieces of consecutive texts start.

    Pieces are runs of letters, of numbers or of other characters, each with one blank
    before it; the endings 's 't 'm 'd 're 've 'll; and white space that precedes no such
    run directly.
    """
    cp = np.frombuffer(data.tobytes().decode().encode("utf-32-le"), np.uint32)
    n = len(cp)
    if not n:
        return np.zeros(0, np.int64)
    width = 1 + (cp >= 0x80).astype(np.int64) + (cp >= 0x800) + (cp >= 0x10000)
    place = np.cumsum(width) - width
    head = np.zeros(n + 1, bool)
    head[np.searchsorted(place, offs)] = True
    head[0] = head[n] = True
    kind = char_classes()[cp]
    run = head[:n].copy()
    run[1:] |= kind[1:] != kind[:-1]
    start = run.copy()
    solid = np.flatnonzero(run & ~head[:n] & (kind != SPACE))
    solid = solid[kind[solid - 1] == SPACE]
    start[solid - 1] = True
    start[solid[cp[solid - 1] == ord(" ")]] = False
    i = np.flatnonzero(start & run & (cp == ord("'")) & ~head[1:])
    i = i[kind[i + 1] == LETTER]
    one = i[np.isin(cp[i + 1], [ord(c) for c in "stmd"])]
    two = i[(i + 2 < n) & ~head[np.minimum(i + 2, n)]]
    a, b = cp[two + 1], cp[two + 2]
    two = two[((a == ord("r")) | (a == ord("v"))) & (b == ord("e")) | (a == ord("l")) & (b == ord("l"))]
    start[one + 1] = start[two + 1] = False
    for rest in (one + 2, two + 3):
        rest = rest[rest < n]
        start[rest] |= ~head[rest] & (kind[rest] == LETTER)
    return place[start]


@lru_cache(maxsize=1)
def byte_symbols() -> dict[str, int]:
    """The printable character that byte-level vocabularies write for each byte."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in shown]
    return {chr(b): b for b in shown} | {chr(256 + k): b for k, b in enumerate(hidden)}


class Vocabulary:
    """Merges, token bytes and special tokens of a byte-level BPE file (its JSON text)."""

    def __init__(self, source: str):
        spec = json.loads(source)
        model, symbols = spec["model"], byte_symbols()
        if model["type"] != "BPE" or spec["pre_tokenizer"]["type"] != "ByteLevel":
            raise ValueError("only byte-level BPE vocabularies are read")
        self.id_of = model["vocab"]
        token_bytes = [b""] * (1 + max([*self.id_of.values(), *(t["id"] for t in spec["added_tokens"])]))
        for token, i in self.id_of.items():
            token_bytes[i] = bytes(symbols[c] for c in token)
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        for token, i in self.special.items():
            token_bytes[i] = token.encode()
        self.byte_id = np.zeros(256, np.int64)
        for c, b in symbols.items():
            self.byte_id[b] = self.id_of[c]
        made: dict[int, int] = {}
        keys, merged = [], []
        for r, pair in enumerate(model["merges"]):
            a, b = pair.split(" ") if isinstance(pair, str) else pair
            left, right, out = self.id_of[a], self.id_of[b], self.id_of[a + b]
            if out in made:
                raise ValueError("two merges make the same token")
            made[out] = r
            keys.append(left << 32 | right)
            merged.append(out)
        # Ascending ranks apply every pair only if a token's own merge ranks before those that use it.
        if any(made.get(k >> 32, -1) >= r or made.get(k & 0xFFFFFFFF, -1) >= r for r, k in enumerate(keys)):
            raise ValueError("a merge uses a token before it is made")
        order = np.argsort(np.array(keys, np.int64))
        #: pairs in order, the rank of each, and by rank the merged id
        self.pairs, self.rank_of = np.array(keys, np.int64)[order], order
        self.merged = np.array(merged, np.int64)
        #: bytes of all tokens, one after another, and where each lies
        self.token_size = np.array([len(x) for x in token_bytes], np.int64)
        self.token_at = np.cumsum(self.token_size) - self.token_size
        self.token_bytes = np.frombuffer(b"".join(token_bytes), np.uint8)
        names = sorted((x.encode() for x in self.special), key=len, reverse=True)
        self.special_pattern = re.compile(b"|".join(map(re.escape, names))) if names else None

    def ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Rank of each pair of ids, ``NO_PAIR`` where they don't merge."""
        if not len(self.pairs):
            return np.full(len(left), NO_PAIR)
        key = left << 32 | right
        at = np.minimum(np.searchsorted(self.pairs, key), len(self.pairs) - 1)
        return np.where(self.pairs[at] == key, self.rank_of[at], NO_PAIR)


def _distinct(x: np.ndarray) -> np.ndarray:
    x = np.sort(x)
    return x[np.concatenate([[True], x[1:] != x[:-1]])] if len(x) else x


def merge_pieces(vocab: Vocabulary, flat: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Token ids of all pieces, one after another, and how many each piece has.

    ``flat`` has the bytes of the pieces one after another, ``size`` their lengths.

    The pieces form one symbol sequence with links between neighbours. ``at_rank``
    holds the rank of the pair that starts at each position, and ``waiting`` the
    occurrence index: for each block of ranks, the positions of its pairs. Blocks are
    applied in ascending order; within a block every piece applies its lowest rank at
    all its positions, from left to right, and the pairs beside the merged symbols get
    new entries. Pieces are independent, so each sees its ranks in ascending order.
    """
    n = len(flat)
    sym = vocab.byte_id[flat]
    piece = np.repeat(np.arange(len(size)), size)
    nxt, prv = np.arange(1, n + 1), np.arange(-1, n - 1)
    ends = np.cumsum(size)
    nxt[ends[size > 0] - 1] = -1
    prv[(ends - size)[size > 0]] = -1
    at_rank = np.full(n, NO_PAIR)
    has = np.flatnonzero(nxt >= 0)
    at_rank[has] = vocab.ranks(sym[has], sym[has + 1])
    waiting: dict[int, list[np.ndarray]] = {}

    def index(positions: np.ndarray) -> None:
        block = at_rank[positions] // RANK_BLOCK
        order = np.argsort(block, kind="stable")
        cuts = np.flatnonzero(np.diff(block[order])) + 1
        for part in np.split(positions[order], cuts):
            if len(part):
                waiting.setdefault(int(at_rank[part[0]] // RANK_BLOCK), []).append(part)

    index(np.flatnonzero(at_rank < NO_PAIR))
    lowest = np.full(len(size), NO_PAIR)
    for block in range(-(-len(vocab.merged) // RANK_BLOCK)):
        live = np.concatenate(waiting.pop(block, [np.zeros(0, np.int64)]))
        while len(live):
            live = _distinct(live)
            live = live[at_rank[live] // RANK_BLOCK == block]  # an earlier merge may have taken a symbol
            own = piece[live]
            np.minimum.at(lowest, own, at_rank[live])
            i = live[at_rank[live] == lowest[own]]
            lowest[own] = NO_PAIR
            if not len(i):
                break
            # Positions of one pair overlap only in a run like "aaa": take every other one.
            joined = np.concatenate([[False], nxt[i[:-1]] == i[1:]])
            if joined.any():
                start = np.maximum.accumulate(np.where(joined, 0, np.arange(len(i))))
                i = i[(np.arange(len(i)) - start) % 2 == 0]
            j = nxt[i]
            k = nxt[j]
            follows = k >= 0
            sym[i] = vocab.merged[at_rank[i]]
            sym[j], at_rank[j] = -1, NO_PAIR
            nxt[i] = k
            prv[k[follows]] = i[follows]
            at_rank[i] = NO_PAIR
            at_rank[i[follows]] = vocab.ranks(sym[i[follows]], sym[k[follows]])
            before = prv[i]
            led = before >= 0
            at_rank[before[led]] = vocab.ranks(sym[before[led]], sym[i[led]])
            changed = _distinct(np.concatenate([i, before[led]]))
            changed = changed[at_rank[changed] < NO_PAIR]
            now = at_rank[changed] // RANK_BLOCK == block
            index(changed[~now])
            live = np.concatenate([live, changed[now]])
    left = sym >= 0
    return sym[left].astype("<u4"), np.bincount(piece[left], minlength=len(size))


def gather(start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Indices of the runs ``start[k] : start[k] + size[k]``, one after another."""
    ends = np.cumsum(size)
    return np.arange(ends[-1] if len(ends) else 0) + np.repeat(start - (ends - size), size)


class Encoder:
    """Encodes batches of texts; remembers the tokens of the pieces it has met.

    Pieces are known by a 64-bit hash of their bytes. ``known`` is sorted; ``at`` and
    ``size`` tell where the ids of each piece lie in ``ids``.
    """

    def __init__(self, vocab: Vocabulary):
        self.vocab = vocab
        self._forget()

    def _forget(self) -> None:
        self.known = np.zeros(0, np.uint64)
        self.at = self.size = np.zeros(0, np.int64)
        self.ids = np.zeros(0, "<u4")
        self._add(mix64(np.array([*self.vocab.special.values()], np.uint64)), np.array([*self.vocab.special.values()], "<u4"),
                  np.ones(len(self.vocab.special), np.int64))

    def _add(self, keys: np.ndarray, ids: np.ndarray, size: np.ndarray) -> None:
        at = np.concatenate([self.at, len(self.ids) + np.cumsum(size) - size])
        known, self.ids = np.concatenate([self.known, keys]), np.concatenate([self.ids, ids])
        order = np.argsort(known)
        self.known, self.at, self.size = known[order], at[order], np.concatenate([self.size, size])[order]

    def _find(self, keys: np.ndarray) -> np.ndarray:
        return np.minimum(np.searchsorted(self.known, keys), max(len(self.known) - 1, 0))

    def _segments(self, data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Bounds of the stretches between special tokens, and place and id of those."""
        place, ids, cuts = [], [], []
        if self.vocab.special_pattern:
            for m in self.vocab.special_pattern.finditer(data.tobytes()):
                row = int(np.searchsorted(offs, m.start(), side="right")) - 1
                if m.end() <= offs[row + 1]:
                    place.append(m.start())
                    ids.append(self.vocab.special[m[0].decode()])
                    cuts += [m.start(), m.end()]
        bounds = np.unique(np.concatenate([offs, np.array(cuts, np.int64)]))
        return bounds, np.array(place, np.int64), np.array(ids, np.uint64)

    def encode(self, data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts, one after another, and the offsets of each text's ids."""
        if len(self.known) > MEMO_PIECES:
            self._forget()
        bounds, place, special = self._segments(data, offs)
        start = cut_pieces(data, bounds)
        end = np.append(start[1:], len(data))
        key = word_hashes(data, Words(start, end, start))
        if len(place):
            # A special token is one piece, known by the hash of its id.
            first = np.searchsorted(start, place)
            keep = np.ones(len(start), bool)
            for a, b in zip(first, np.searchsorted(start, bounds[np.searchsorted(bounds, place) + 1]), strict=True):
                keep[a + 1:b] = False
            key[first] = mix64(special)
            start, end, key = start[keep], end[keep], key[keep]
        distinct, inverse = np.unique(key, return_inverse=True)
        at = self._find(distinct)
        new = np.flatnonzero(self.known[at] != distinct) if len(self.known) else np.arange(len(distinct))
        if len(new):
            one = np.empty(len(distinct), np.int64)
            one[inverse] = np.arange(len(key))
            one = one[new]
            size = end[one] - start[one]
            ids, count = merge_pieces(self.vocab, data[gather(start[one], size)], size)
            self._add(distinct[new], ids, count)
            at = self._find(distinct)
        at = at[inverse]
        size = self.size[at]
        ids = self.ids[gather(self.at[at], size)]
        upto = np.concatenate([[0], np.cumsum(size)])
        return ids, upto[np.searchsorted(start, offs)]

    def encode_texts(self, texts: list[str | None]) -> list[list[int]]:
        ids, offs = self.encode(*utf8(pa.array(texts, pa.string())))
        return [ids[a:b].tolist() for a, b in zip(offs[:-1], offs[1:], strict=True)]


def decode_bytes(vocab: Vocabulary, ids: np.ndarray) -> bytes:
    """UTF-8 of the text of some ids, special tokens included; malformed bytes become U+FFFD."""
    raw = vocab.token_bytes[gather(vocab.token_at[ids], vocab.token_size[ids])].tobytes()
    return raw.decode("utf-8", "replace").encode()


_loaded: dict[str, Encoder] = {}


def encoder(source: str) -> Encoder:
    """The worker's encoder for a vocabulary, built once."""
    key = hashlib.sha256(source.encode()).hexdigest()
    if key not in _loaded:
        _loaded.clear()
        _loaded[key] = Encoder(Vocabulary(source))
    return _loaded[key]


def read_vocabulary(path: str) -> str:
    with open(path, encoding="utf-8") as f:
        return f.read()


def encode(docs: DataFrame, path: str, text: str = "text", key: str = "doc_id") -> DataFrame:
    """``(doc_id, ids)``: the token ids of every whole text, as an array of integers."""
    source = docs.sparkSession.sparkContext.broadcast(read_vocabulary(path))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(source.value)
        for part in slices(batches, "text", BATCH_BYTES):
            ids, offs = enc.encode(*utf8(part.column(1)))
            lists = pa.ListArray.from_arrays(pa.array(offs.astype(np.int32)), pa.array(ids.astype(np.int32)))
            yield pa.RecordBatch.from_arrays([part.column(0), lists], ["doc_id", "ids"])

    return small_batches(docs).select(F.col(key).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text")).mapInArrow(
        run, "doc_id long, ids array<int>")


def decode(encoded: DataFrame, path: str) -> DataFrame:
    """``(doc_id, text)`` from ``(doc_id, ids)``; null ids decode to the empty text."""
    source = encoded.sparkSession.sparkContext.broadcast(read_vocabulary(path))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocab = encoder(source.value).vocab
        for batch in batches:
            texts = [decode_bytes(vocab, np.array(x or [], np.int64)).decode() for x in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], ["doc_id", "text"])

    return encoded.select("doc_id", "ids").mapInArrow(run, "doc_id long, text string")


def round_trip_digests(docs: DataFrame, path: str, text: str = "text", key: str = "doc_id") -> DataFrame:
    """Encode every whole text, decode the ids, and give count and digests of both.

    Both steps run in one pass, so neither ids nor decoded texts leave the task.
    """
    source = docs.sparkSession.sparkContext.broadcast(read_vocabulary(path))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(source.value)
        for part in slices(batches, "text", BATCH_BYTES):
            ids, offs = enc.encode(*utf8(part.column(1)))
            rows = [ids[a:b] for a, b in zip(offs[:-1], offs[1:], strict=True)]
            yield pa.RecordBatch.from_arrays([
                part.column(0),
                pa.array(np.diff(offs), pa.int64()),
                pa.array([hashlib.sha256(x).hexdigest() for x in rows], pa.string()),
                pa.array([hashlib.sha256(decode_bytes(enc.vocab, x)).hexdigest() for x in rows], pa.string()),
            ], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return small_batches(docs).select(F.col(key).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text")).mapInArrow(
        run, SCHEMA)
