"""How often ids are drawn, from digests of whole batches of ids, and the sums of the draws."""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa

#: Draws that one digest of 16 bytes serves.
PER_DIGEST = 16
#: Least byte of 1, 2, 3, 4 and 5 times: Poisson probabilities of mean 1 in 256ths.
STEPS = (0x5E, 0xBC, 0xEB, 0xFB, 0xFF)
#: Rows looked at together, digests made together, and numbers that a task sums in before it hands them on.
ROWS, DIGESTS, HELD = 4096, 1 << 15, 1 << 22

# MD5 (RFC 1321): shifts, constants, and which word a step takes.
_SHIFTS = [s for four in ((7, 12, 17, 22), (5, 9, 14, 20), (4, 11, 16, 23), (6, 10, 15, 21)) for s in four * 4]
_SINES = [int(abs(math.sin(i + 1)) * 2**32) for i in range(64)]
_WORD = [*range(16), *((5 * i + 1) % 16 for i in range(16, 32)), *((3 * i + 5) % 16 for i in range(32, 48)), *(7 * i % 16 for i in range(48, 64))]
_START = (0x67452301, 0xEFCDAB89, 0x98BADCFE, 0x10325476)
#: Bytes of a message that one round of MD5 takes.
_ONE_ROUND = 55


def _steps(words: list[np.ndarray | int], shape: tuple[int, int]) -> np.ndarray:
    """MD5 of messages of one round from their 16 words, each an array that broadcasts to ``shape`` or what all have: bytes, 16 to a message."""
    a, b, c, d = state = [np.full(shape, x, "u4") for x in _START]
    f = np.empty(shape, "u4")
    for i, (shift, sine, at) in enumerate(zip(_SHIFTS, _SINES, _WORD, strict=True)):
        if i < 16:
            np.bitwise_xor(c, d, out=f)
            f &= b
            f ^= d
        elif i < 32:
            np.bitwise_xor(b, c, out=f)
            f &= d
            f ^= c
        elif i < 48:
            np.bitwise_xor(b, c, out=f)
            f ^= d
        else:
            np.bitwise_not(d, out=f)
            f |= b
            f ^= c
        f += a
        word = words[at]
        if isinstance(word, int):
            f += np.uint32((word + sine) & 0xFFFFFFFF)
        else:
            f += word
            f += np.uint32(sine)
        np.left_shift(f, np.uint32(shift), out=a)
        f >>= np.uint32(32 - shift)
        a |= f
        a += b
        a, b, c, d = d, a, b, c
    out = np.empty((*shape, 4), "<u4")
    for i, (x, start) in enumerate(zip((a, b, c, d), _START, strict=True)):
        np.add(x, np.uint32(start), out=out[..., i])
    return out.view("u1")


def _words(texts: Sequence[bytes], size: int, at: int, end: bool) -> np.ndarray:
    """Words, message by message, of texts of one size that begin at a byte; with ``end`` what MD5 sets behind them."""
    whole = np.zeros((len(texts), 64), "u1")
    whole[:, at : at + size] = np.frombuffer(b"".join(texts), "u1").reshape(len(texts), size)
    if end:
        whole[:, at + size] = 0x80
    return whole.view("<u4")


def digests(seed: int, blocks: range, ids: Sequence[bytes]) -> np.ndarray:
    """MD5 of ``seed:block:id`` for every block and id: an array of blocks, ids and 16 bytes."""
    out = np.empty((len(blocks), len(ids), 16), "u1")
    sizes = np.fromiter(map(len, ids), "i8", len(ids))
    heads = [f"{seed}:{b}:".encode() for b in blocks]
    head_sizes = np.fromiter(map(len, heads), "i8", len(heads))
    for p in np.unique(head_sizes).tolist():
        own = np.flatnonzero(head_sizes == p)
        for size in np.unique(sizes).tolist():
            at = np.flatnonzero(sizes == size)
            if p + size > _ONE_ROUND:
                for i in own.tolist():
                    for j in at.tolist():
                        out[i, j] = np.frombuffer(hashlib.md5(heads[i] + ids[j], usedforsecurity=False).digest(), "u1")
                continue
            tail = _words([ids[j] for j in at.tolist()], size, p, True)
            head = _words([heads[i] for i in own.tolist()], p, 0, False)
            words: list[np.ndarray | int] = []
            for w in range(16):
                if w <= (p + size) // 4:
                    part = np.ascontiguousarray(tail[:, w])[None, :]
                    words.append(part | head[:, w, None] if 4 * w < p else part)
                else:
                    words.append(8 * (p + size) if w == 14 else 0)
            out[own[:, None], at[None, :]] = _steps(words, (len(own), len(at)))
    return out


def weights(digest: np.ndarray) -> np.ndarray:
    """How often each draw takes the row: Poisson numbers of mean 1."""
    out, more = (digest >= STEPS[0]).view("u1"), np.empty(digest.shape, bool)
    for step in STEPS[1:]:
        np.greater_equal(digest, step, out=more)
        out += more.view("u1")
    return out.astype("f8")


def _grouped(batch: pa.RecordBatch, by: int) -> tuple[np.ndarray, list[tuple]]:
    """Each row's group, and the groups' keys."""
    code = np.zeros(batch.num_rows, "i8")
    for i in range(by):
        own = batch.column(i).dictionary_encode(null_encoding="encode")
        code = np.unique(code * len(own.dictionary) + own.indices.to_numpy(zero_copy_only=False), return_inverse=True)[1]
    _, first, code = np.unique(code, return_index=True, return_inverse=True)
    return code, [tuple(batch.column(i)[at].as_py() for i in range(by)) for at in first.tolist()]


class _Sums:
    """A task's sums by group: rows, plain sums, and those of each draw."""

    def __init__(self, seed: int, blocks: int, by: int, columns: int):
        self.seed, self.blocks, self.by, self.columns = seed, blocks, by, columns
        self.groups: dict[tuple, tuple[list[int], np.ndarray, np.ndarray]] = {}

    def full(self) -> bool:
        return len(self.groups) * self.blocks * PER_DIGEST * self.columns > HELD

    def add(self, batch: pa.RecordBatch) -> None:
        code, keys = _grouped(batch, self.by)
        values = np.stack([c.to_numpy(zero_copy_only=False) for c in batch.columns[self.by + 1 :]], axis=1)
        index: dict[bytes, int] = {}
        which = np.fromiter((index.setdefault(x, len(index)) for x in batch.column(self.by).cast(pa.binary()).to_pylist()), "i8", batch.num_rows)
        ids, order = list(index), np.argsort(code, kind="stable")
        ends = np.cumsum(np.bincount(code, minlength=len(keys))).tolist()
        parts = [(order[a:b], self.groups.setdefault(k, ([0], np.zeros(self.columns), np.zeros((self.blocks, PER_DIGEST, self.columns))))) for k, a, b in zip(keys, [0, *ends], ends)]
        for rows, (n, plain, _) in parts:
            n[0] += len(rows)
            plain += values[rows].sum(axis=0)
        step = max(1, DIGESTS // len(ids))
        for at in range(0, self.blocks, step):
            some = range(at, min(at + step, self.blocks))
            drawn = weights(digests(self.seed, some, ids))
            for rows, (_, _, sums) in parts:
                own = drawn if len(parts) == 1 and len(ids) == len(rows) else drawn[:, which[rows]]
                sums[at : some.stop] += np.matmul(own.transpose(0, 2, 1), values[rows])

    def rows(self, schema: pa.Schema) -> Iterator[pa.RecordBatch]:
        """A row for each group, metric and block; block -1 has the plain sums."""
        for key, (n, plain, sums) in self.groups.items():
            for m in range(self.columns // 2):
                table = np.zeros((self.blocks + 1, 2 * PER_DIGEST))
                table[0, [0, PER_DIGEST]] = plain[2 * m : 2 * m + 2]
                table[1:] = sums[:, :, 2 * m : 2 * m + 2].transpose(0, 2, 1).reshape(self.blocks, -1)
                held = [*([k] * len(table) for k in key), [m] * len(table), range(-1, self.blocks), [n[0]] * len(table), *table.T]
                yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(held, schema, strict=True)], schema=schema)
        self.groups.clear()


def summed(seed: int, blocks: int, by: int, schema: pa.Schema):
    """For mapInArrow, rows of ``by`` keys, an id, and numerator and denominator of each metric: their sums in each draw, by group."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = None
        for batch in batches:
            sums = sums or _Sums(seed, blocks, by, batch.num_columns - by - 1)
            for at in range(0, batch.num_rows, ROWS):
                sums.add(batch.slice(at, ROWS))
                if sums.full():
                    yield from sums.rows(schema)
        if sums:
            yield from sums.rows(schema)

    return run
