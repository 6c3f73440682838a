"""Cutting a text where any tokenizer of the byte-level pattern cuts it too.

Between two characters that aren't white space, a single space always starts a
new pre-token of the byte-level BPE pattern: no alternative runs from another
character into a space, and the space joins what follows.  A single line feed
there is a pre-token of its own.  So what lies between single spaces and line feeds
can be tokenized piece by piece, and the results remembered.  Where white space
touches such a space or line feed, the text is cut elsewhere.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as compute

_SAFE = re.compile(r"(?<=\S) (?=\S)")
#: All white space but space and line feed.
_RARE = [chr(c) for c in range(0x3001) if chr(c).isspace() and c not in (10, 32)]
_RARE_ASCII = [c for c in _RARE if c.isascii()]
#: Stands before the first piece of a text; texts that have it, or white space beside white space, go the slower way.
_FIRST = "\x01"
_ODD = r"[ \n][ \n]|[" + "".join(f"\\x{{{ord(c):x}}}" for c in [*_RARE, _FIRST]) + "]"


def chunks(text: str) -> list[str]:
    """Pieces of ``text``; every one but the first had a space before it, which is left out, or begins with the line feed it had."""
    if "  " in text or " \n" in text or "\n " in text or "\n\n" in text or any(c in text for c in (_RARE_ASCII if text.isascii() else _RARE)):
        return _SAFE.split(text)
    return text.replace("\n", " \n").split(" ")


def slices(batch: pa.RecordBatch, column: int, most: int = 2 << 20) -> Iterator[tuple[pa.RecordBatch, list[str]]]:
    """Slices of a batch with their texts, of about ``most`` characters: whole texts, bounded arrays."""
    start, size, texts = 0, 0, []
    for i, text in enumerate(batch.column(column)):
        texts.append(text.as_py())
        size += len(texts[-1])
        if size >= most or i == batch.num_rows - 1:
            yield batch.slice(start, i + 1 - start), texts
            start, size, texts = i + 1, 0, []


class Memo(dict):
    """Results for recent keys; two generations bound their number, ``longest`` the size of a key."""

    def __init__(self, compute: Callable[[str], bytes], limit: int, longest: int):
        self.compute, self.limit, self.longest = compute, limit, longest
        self.old: dict[str, bytes] = {}

    def __missing__(self, key: str) -> bytes:
        got = self.old.get(key)
        if got is None:
            got = self.compute(key)
        if len(key) <= self.longest:
            self[key] = got
        return got

    def age(self) -> None:
        if len(self) > self.limit:
            self.old = dict(self)
            self.clear()


#: Pieces of a text that are looked up before memos are aged.
STEP = 50_000


class Pieces:
    """Encodes texts by encoding each pre-token and each chunk once as long as it is remembered."""

    def __init__(self, encode: Callable[[str], bytes], find: Callable[[str], list[str]], pieces: int, spaced: int, longest: int, kind: str = "<u4"):
        self.find, self.kind = find, np.dtype(kind)
        self.pieces = Memo(encode, pieces, longest)
        self.spaced = Memo(self._spaced, spaced, longest)

    def _spaced(self, chunk: str) -> bytes:
        known = self.pieces
        if chunk[:1] == _FIRST:
            return self.cut(chunk[1:])
        if chunk[:1] == "\n":  # the line feed between two lines, and the first piece of the second
            return known["\n"] + self.cut(chunk[1:])
        if chunk.isalpha():  # what the pattern would find, for most chunks; remembered here, not twice
            return known.compute(f" {chunk}")
        if chunk[-1:] in (".", ",") and chunk[:-1].isalpha():
            return self.spaced[chunk[:-1]] + known[chunk[-1]]
        return self.cut(f" {chunk}")

    def cut(self, text: str) -> bytes:
        return b"".join(map(self.pieces.__getitem__, self.find(text)))

    def encode_many(self, texts: list[str]) -> list[bytes]:
        """``encode`` of each text, by way of the distinct pieces of them all."""
        whole = pa.array(texts, pa.large_string())
        odd = compute.match_substring_regex(whole, _ODD)
        out = [self.encode(t) if o else b"" for t, o in zip(texts, odd.to_pylist(), strict=True)]
        some = whole.filter(compute.invert(odd))
        if not len(some):
            return out
        lists = compute.split_pattern(compute.binary_join_element_wise(pa.scalar(_FIRST, some.type), compute.replace_substring(some, "\n", " \n"), pa.scalar("", some.type)), " ")
        coded = lists.flatten().dictionary_encode()
        pieces = list(map(self.spaced.__getitem__, coded.dictionary.to_pylist()))
        self.spaced.age()
        self.pieces.age()
        sizes = np.fromiter(map(len, pieces), "i8", len(pieces)) // self.kind.itemsize
        pool, code = np.frombuffer(b"".join(pieces), self.kind), coded.indices.to_numpy()
        n = sizes[code]
        ends = np.concatenate([[0], np.cumsum(n)])
        ids = pool[np.repeat((np.cumsum(sizes) - sizes)[code] - ends[:-1], n) + np.arange(ends[-1])]
        cuts = ends[lists.offsets.to_numpy()].tolist()
        for i, a, b in zip(np.flatnonzero(~np.asarray(odd)).tolist(), cuts, cuts[1:]):
            out[i] = ids[a:b].tobytes()
        return out

    def encode(self, text: str) -> bytes:
        if _FIRST in text:
            return self.cut(text)
        first, *rest = chunks(text)
        out = [self.cut(first)]
        for at in range(0, len(rest), STEP):  # a long text must not outgrow what is remembered
            out += map(self.spaced.__getitem__, rest[at : at + STEP])
            self.spaced.age()
            self.pieces.age()
        return b"".join(out)
