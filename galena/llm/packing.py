"""Sorted 64-bit keys and other arrays, packed for a shuffle."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def squeezed(*parts: np.ndarray | bytes, level: int = 1) -> bytes:
    return zstandard.ZstdCompressor(level=level).compress(b"".join(p if isinstance(p, bytes) else p.tobytes() for p in parts))


def differences(keys: np.ndarray) -> np.ndarray:
    """Sorted keys as bytes of their differences, like bytes together: the leading ones are zero."""
    return np.ascontiguousarray(np.diff(keys, prepend=np.uint64(0)).view("u1").reshape(-1, 8).T)


def undone(raw: bytes | memoryview, n: int) -> np.ndarray:
    """What ``differences`` was given, from the first 8 * n bytes."""
    return np.cumsum(np.ascontiguousarray(np.frombuffer(raw, "u1", 8 * n).reshape(8, n).T).view("u8").reshape(-1))


def packed_keys(data: bytes, sizes: list[int]) -> Iterator[np.ndarray]:
    """Several arrays of keys, squeezed one after the other."""
    raw, at = memoryview(zstandard.ZstdDecompressor().decompress(data)), 0
    for n in sizes:
        yield undone(raw[at : at + 8 * n], n)
        at += 8 * n


def planes(values: np.ndarray, width: int) -> np.ndarray:
    """Unsigned integers as their ``width`` lower bytes, like bytes together."""
    return np.ascontiguousarray(values.astype("<u8").view("u1").reshape(-1, 8)[:, :width].T)


def from_planes(raw: bytes | memoryview, n: int, width: int) -> np.ndarray:
    """What ``planes`` was given, from the first width * n bytes."""
    out = np.zeros((n, 8), "u1")
    out[:, :width] = np.frombuffer(raw, "u1", n * width).reshape(width, n).T
    return out.view("<u8").reshape(-1)


def shard_of(keys: np.ndarray, shards: int) -> np.ndarray:
    """Equal ranges of keys, so that sorted keys lie in their shards' order; fewer than 2**31 shards."""
    return ((keys >> np.uint64(32)) * np.uint64(shards)) >> np.uint64(32)


def shard_column(key: Column, shards: int) -> Column:
    """The same, of a column of signed longs."""
    return F.shiftrightunsigned(F.shiftrightunsigned(key, 32) * F.lit(shards).cast("long"), 32).cast("int")


def dealt(keys: list[np.ndarray], shards: int) -> Iterator[tuple[int, list[slice]]]:
    """For each shard that has some of several arrays of sorted keys: where in each array its keys are."""
    owners = [shard_of(k, shards) for k in keys]
    present = np.unique(np.concatenate(owners))
    begin = [np.searchsorted(o, present) for o in owners]
    end = [np.searchsorted(o, present, "right") for o in owners]
    for i, shard in enumerate(present.tolist()):
        yield shard, [slice(a[i], b[i]) for a, b in zip(begin, end, strict=True)]


def bitmap_of(keys: DataFrame, each: int, most: int) -> np.ndarray:
    """Two bits for each key of a column ``key``, from its two halves, in a bitmap of about ``each`` bits a key and ``most`` at most."""
    bits = 1 << 15
    while bits < min(keys.count() * each, most):
        bits *= 2
    place = keys.select(F.explode(F.array(F.col("key"), F.shiftrightunsigned("key", 32))).alias("place")).select(F.col("place").bitwiseAND(F.lit(bits - 1)).alias("place"))
    cells = place.groupBy(F.shiftright("place", 15).alias("cell")).agg(F.expr("bitmap_construct_agg(place & 32767)").alias("bits"))
    out = np.zeros(bits // 8, "u1")
    for r in cells.collect():  # bits / 8 bytes at most
        out[r.cell * 4096 : (r.cell + 1) * 4096] = np.frombuffer(r.bits, "u1")
    return out


def maybe_in(bitmap: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """Whether both bits of each key are set: true for all that are in, and for few others."""
    out = np.ones(len(keys), bool)
    for shift in (0, 32):
        place = (keys >> np.uint64(shift)) & np.uint64(len(bitmap) * 8 - 1)
        out &= (bitmap[(place >> np.uint64(3)).astype("i8")] >> (place & np.uint64(7)).astype("u1")) & 1 == 1
    return out
