"""Byte-level BPE encoding and decoding by ranks.

Two tiers resolve a pre-token.  A minimal perfect hash over the vocabulary
finds it if it is a token itself.  Otherwise its bytes form a linked list, and
a heap gives the pair of neighbours with the lowest rank, leftmost first, until
no pair can be merged: n log n steps for a pre-token of n bytes, however long.

The vocabulary fixes the size of all that is sent to the executors.  What a
Python worker remembers is bounded by the MEMO constants.
"""

from __future__ import annotations

import base64
import hashlib
from array import array
from collections.abc import Iterable, Iterator
from heapq import heapify, heappop, heappush

import numpy as np
import pyarrow as pa
import regex
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from galena.llm.caches import claim, register
from galena.llm.chunks import Pieces, slices
from galena.llm.scratch import bound_batches, fresh

#: What a worker remembers: pre-tokens, pieces between spaces, and the characters of each at most.
MEMO_PIECES, MEMO_CHUNKS, MEMO_CHARS = 150_000, 500_000, 48
#: Characters that are encoded together.
SLICE_CHARS = 6 << 20


def read_ranks(path: str) -> list[bytes]:
    """Token bytes by id, from lines of base64 and rank."""
    with open(path, "rb") as lines:
        pairs = [line.split() for line in lines if line.strip()]
    tokens: list[bytes] = [b""] * len(pairs)
    for token, rank in pairs:
        tokens[int(rank)] = base64.b64decode(token)
    return tokens


class PerfectHash:
    """Minimal perfect hash by displacement: n keys, n slots, one probe."""

    MULTIPLE = 4

    def __init__(self, keys: list[bytes]):
        n = self.size = len(keys)
        self.buckets = n // self.MULTIPLE + 1
        self.shift = [0] * self.buckets
        self.slots: list[bytes | None] = [None] * n
        self.values = [0] * n
        groups: list[list[tuple[int, int, bytes, int]]] = [[] for _ in range(self.buckets)]
        for value, key in enumerate(keys):
            bucket, low, step = self._hash(key)
            groups[bucket].append((low, step, key, value))
        order = sorted(range(self.buckets), key=lambda b: -len(groups[b]))
        free = n - 1
        for bucket in order:
            group = groups[bucket]
            if not group:
                break
            if len(group) == 1:  # any free slot will do, named by a negative shift
                while self.slots[free] is not None:
                    free -= 1
                self.shift[bucket] = -free - 1
                self.slots[free], self.values[free] = group[0][2], group[0][3]
                continue
            d = 0
            while True:
                d += 1
                spots = {self._slot(low, step, d) for low, step, _, _ in group}
                if len(spots) == len(group) and all(self.slots[s] is None for s in spots):
                    break
                if d > 1_000_000:
                    raise ValueError("two keys can't be told apart by their hash")
            self.shift[bucket] = d
            for low, step, key, value in group:
                s = self._slot(low, step, d)
                self.slots[s], self.values[s] = key, value

    def _hash(self, key: bytes) -> tuple[int, int, int]:
        h = xxhash.xxh3_128_intdigest(key)
        return (h & 0xFFFFFFFF) % self.buckets, (h >> 32) & 0xFFFFFFFF, h >> 64 | 1

    def _slot(self, low: int, step: int, d: int) -> int:
        return ((low + d) * step >> 20 & 0xFFFFFFFFFFF) % self.size

    def get(self, key: bytes) -> int | None:
        if not self.size:
            return None
        bucket, low, step = self._hash(key)
        d = self.shift[bucket]
        slot = -d - 1 if d < 0 else self._slot(low, step, d)
        return self.values[slot] if self.slots[slot] == key else None


class ByteBPE:
    """A vocabulary of ranks with the pattern that cuts texts into pre-tokens."""

    def __init__(self, tokens: list[bytes], pattern: str):
        self.tokens, self.pattern = tokens, pattern
        self.whole = PerfectHash(tokens)
        self.byte_ids = [self.whole.get(bytes([b])) for b in range(256)]
        if None in self.byte_ids:
            raise ValueError("the vocabulary lacks a byte")
        self._ready()

    def _ready(self) -> None:
        index = {token: i for i, token in enumerate(self.tokens)}
        self.pairs: dict[int, int] = {}
        for i, token in enumerate(self.tokens):
            for cut in range(1, len(token)):
                left, right = index.get(token[:cut]), index.get(token[cut:])
                if left is not None and right is not None:
                    self.pairs[left << 32 | right] = i
        self.known = Pieces(self._piece, regex.compile(self.pattern).findall, MEMO_PIECES, MEMO_CHUNKS, MEMO_CHARS)

    def __getstate__(self):
        return {k: v for k, v in self.__dict__.items() if k not in ("pairs", "known")}

    def __setstate__(self, state):
        self.__dict__.update(state)
        self._ready()

    def merge(self, raw: bytes) -> list[int]:
        """Ids of a pre-token that is no token: heap over linked bytes."""
        ids = [self.byte_ids[b] for b in raw]
        n, pairs = len(ids), self.pairs
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = [(rank, i, ids[i], ids[i + 1]) for i in range(n - 1) if (rank := pairs.get(ids[i] << 32 | ids[i + 1])) is not None]
        heapify(heap)
        while heap:
            rank, i, left, right = heappop(heap)
            j = after[i]
            if ids[i] != left or j >= n or ids[j] != right:  # one of them has been merged meanwhile
                continue
            ids[i], ids[j] = rank, -1
            after[i] = k = after[j]
            if k < n:
                before[k] = i
                if (more := pairs.get(rank << 32 | ids[k])) is not None:
                    heappush(heap, (more, i, rank, ids[k]))
            if (h := before[i]) >= 0 and (more := pairs.get(ids[h] << 32 | rank)) is not None:
                heappush(heap, (more, h, ids[h], rank))
        return [x for x in ids if x >= 0]

    def _piece(self, piece: str) -> bytes:
        raw = piece.encode()
        token = self.whole.get(raw)
        return array("I", self.merge(raw) if token is None else [token]).tobytes()

    def encode(self, text: str) -> bytes:
        """The ids as little-endian unsigned 32-bit integers."""
        return self.known.encode(text)

    def decode(self, ids: bytes) -> bytes:
        return b"".join(map(self.tokens.__getitem__, np.frombuffer(ids, "<u4").tolist()))


_OWN: dict[str, ByteBPE] = {}
register("bpe", _OWN.clear)


def _once(key: str, sent) -> ByteBPE:
    """One vocabulary for each worker process, however many tasks it runs."""
    claim("bpe", "bpe")
    if key not in _OWN:
        _OWN.clear()
        _OWN[key] = sent.value
    return _OWN[key]


#: The driver's last vocabulary: its perfect hash is built once.
_BUILT: dict[str, ByteBPE] = {}


def _sent(docs: DataFrame, tokens: list[bytes], pattern: str):
    bound_batches(docs.sparkSession)
    key = hashlib.sha256(pattern.encode() + b"\0".join(tokens)).hexdigest()
    if key not in _BUILT:
        _BUILT.clear()
        _BUILT[key] = ByteBPE(tokens, pattern)
    return key, docs.sparkSession.sparkContext.broadcast(_BUILT[key])


def encode_documents(docs: DataFrame, tokens: list[bytes], pattern: str, text_col: str = "text", keep: Iterable[str] = ("doc_id",)) -> DataFrame:
    """``keep`` columns, n_tokens, ids (binary, little-endian unsigned 32-bit), decoded_sha256, ids_sha256.

    Every whole text is encoded, then its ids are decoded again; decoded_sha256
    is the digest of the bytes that come back.  A null text is empty, an empty
    one has no ids.  Rows are independent: nulls, ties and repeated rows in other
    columns change nothing, and columns not in ``keep`` are not looked at.  A column
    in ``keep`` with the name of one that is made here is left out.
    """
    keep = [c for c in keep if c not in ("n_tokens", "ids", "ids_sha256", "decoded_sha256")]
    key, sent = _sent(docs, tokens, pattern)
    rows = docs.select(*keep, F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias(fresh()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = _once(key, sent)
        for batch in batches:
            for some, texts in slices(batch, len(keep), SLICE_CHARS):
                ids = bpe.known.encode_many(texts)
                digests, back = [hashlib.sha256(x).hexdigest() for x in ids], [hashlib.sha256(bpe.decode(x)).hexdigest() for x in ids]
                columns = [some.column(i) for i in range(len(keep))]
                columns += [pa.array([len(x) // 4 for x in ids], pa.int64()), pa.array(ids, pa.binary()), pa.array(digests), pa.array(back)]
                yield pa.RecordBatch.from_arrays(columns, names=[*keep, "n_tokens", "ids", "ids_sha256", "decoded_sha256"])

    kept = ", ".join(f"`{c}` {rows.schema[c].dataType.simpleString()}" for c in keep)
    return rows.mapInArrow(run, f"{kept}, n_tokens long, ids binary, ids_sha256 string, decoded_sha256 string")


def decode_documents(encoded: DataFrame, tokens: list[bytes], pattern: str, keep: Iterable[str] = ("doc_id",)) -> DataFrame:
    """``keep`` columns (but for text) and text: the decoded ids as UTF-8, invalid bytes replaced.

    Null ids and none give an empty text.  A row is decoded by itself: repeated
    rows and nulls in other columns change nothing.
    """
    keep = [c for c in keep if c != "text"]
    key, sent = _sent(encoded, tokens, pattern)
    rows = encoded.select(*keep, F.coalesce("ids", F.lit(b"")).alias(fresh()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = _once(key, sent)
        for batch in batches:
            texts = [bpe.decode(x).decode(errors="replace") for x in batch.column(len(keep)).to_pylist()]
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in range(len(keep))), pa.array(texts, pa.string())], names=[*keep, "text"])

    kept = ", ".join(f"`{c}` {rows.schema[c].dataType.simpleString()}" for c in keep)
    return rows.mapInArrow(run, f"{kept}, text string")
