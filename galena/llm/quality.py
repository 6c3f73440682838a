"""Quality classifier: an interpolated modified Kneser-Ney trigram model of trusted text.

In training, n-grams travel and are kept as packed rows: the hashes of a row's
distinct words, sorted, and for each n-gram its words' places among them, and its
count.  A row belongs to a shard: a range of hashes of contexts (all words of an
n-gram but its last), so that the counts and the discount mass of a context are
known where its n-grams are.  Trigrams are counted in batches and added up in the
shards; bigrams and then words count the longer n-grams that end in them.  The model
is a row for each order and range of keys: sorted keys, as differences, with a and
g: what an n-gram adds to its own probability, and what it leaves to the next lower
order where it is a context.

Scoring joins the documents' n-grams to the model's shards.  A batch of documents
sends each shard one row with its distinct n-grams, sorted and as differences; the
shard joins them to its part of the model and sends back what it knows.  There the
batch, whose texts are packed, multiplies up the probabilities of its words and
sums their logarithms for each document.  As an n-gram is sent once a batch, a
frequent one weighs no more than a rare one.  Most n-grams are in no trusted text:
bitmaps of each order's keys (BITMAP_BITS at most) keep nearly all of those from
being sent; the ones that slip through find nothing.  Documents are scored in ROUNDS
parts, one after the other, and what one part has shuffled is deleted before the
next, so that disk holds one part's share.  The model's files are bucketed by shard:
no part shuffles it.

A document is rejected if its perplexity is above a high quantile of trusted
documents of its language.  Quantiles are read from histograms over all trusted
documents.  Short documents are drawn towards their language's mean, as if they
had PRIOR more words of that perplexity.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import Broadcast, TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from galena.llm.caches import claim
from galena.llm.chunks import slices
from galena.llm.packing import dealt, differences, from_planes, packed_keys, planes, shard_of, squeezed
from galena.llm.scratch import Scratch, fresh
from galena.llm.shingles import hashed, mix

#: Trusted texts the model is trained on at most, of the half with an odd hash of doc_id those of
#: the smallest hash; None: that whole half. Thresholds come from all others, which the model hasn't seen.
TRAIN_TEXTS: int | None = None
QUANTILE = 0.995
#: Room above the quantile, in nats a word.
MARGIN = 0.05
PRIOR = 25
#: Histogram cells to a nat; languages with fewer trusted documents share one threshold.
CELLS, LEAST = 128, 50
#: Characters of a batch of documents; bytes of scored text and of trusted text to a shard, roughly; parts that documents are scored in; bits of an order's bitmap for each key, and of all of it.
BATCH_CHARS, SHARD_BYTES, TRAIN_BYTES = 4 << 20, 32 << 20, 8 << 20
ROUNDS = 8
KEY_BITS, BITMAP_BITS = 16, 1 << 26
_STEP = np.uint64(0x9E3779B97F4A7C15)
_BOS, _EOS = np.uint64(0x5851F42D4C957F2D), np.uint64(0x14057B7EF767814F)


def tokens_of(text: str) -> list[bytes]:
    """What stands between white space, less commas and full stops; case and other signs count."""
    return text.encode().translate(None, b",.").split()


def _pairs(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    return mix(left * _STEP + right)


def _stream(texts: list[list[bytes]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hashes with two starts before and an end after each text, text of each, whether it is to be predicted)."""
    sizes = np.array([len(t) + 3 for t in texts], "i8")
    owner = np.repeat(np.arange(len(texts)), sizes)
    ends = np.cumsum(sizes)
    out = np.empty(ends[-1] if len(ends) else 0, "u8")
    real = np.ones(len(out), bool)
    for at, mark in ((ends - sizes, _BOS), (ends - sizes + 1, _BOS), (ends - 1, _EOS)):
        out[at] = mark
        real[at] = False
    out[real] = hashed([w for t in texts for w in t])
    real[ends - 1] = True
    return out, owner, real


class Table:
    """Values by 64-bit key."""

    def __init__(self, keys: np.ndarray, **values: np.ndarray):
        order = np.argsort(keys)
        self.keys = keys[order]
        self.values = {k: v[order].astype("f4") for k, v in values.items()}

    def find(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        if not len(self.keys):
            return np.zeros(len(keys), "i8"), np.zeros(len(keys), bool)
        at = np.minimum(np.searchsorted(self.keys, keys), len(self.keys) - 1)
        return at, self.keys[at] == keys


def discounts(of_counts: dict[int, int]) -> tuple[float, float, float]:
    """For n-grams counted once, twice and more often, from how many are counted 1 to 4 times."""
    n1, n2, n3, n4 = (of_counts.get(i, 0) for i in (1, 2, 3, 4))
    if not (n1 and n2):
        return 0.5, 0.5, 0.5
    y = n1 / (n1 + 2 * n2)
    raw = (1 - 2 * y * n2 / n1, 2 - 3 * y * n3 / n2, 3 - 4 * y * n4 / n3 if n3 else 0.0)
    return tuple(min(max(d, 0.05), i + 0.95) for i, d in enumerate(raw))


def _grams(h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Keys of the two and of the three words that end at each place."""
    bi = _pairs(np.concatenate([h[:1] * 0, h[:-1]]), h)
    return bi, _pairs(np.concatenate([bi[:1] * 0, bi[:-1]]), h)


_GRAMS = pa.schema([("shard", pa.int32()), ("sizes", pa.list_(pa.int64())), ("data", pa.binary())])
_GRAMS_DDL = "shard int, sizes array<long>, data binary"
_MERGED = _GRAMS.append(pa.field("stats", pa.list_(pa.int64())))


def _packed_ints(*columns: np.ndarray) -> list:
    """Lengths and widths of columns of unsigned integers, and the columns, squeezed."""
    widths = [max(1, (int(c.max()).bit_length() + 7) // 8) if len(c) else 1 for c in columns]
    return [[x for c, w in zip(columns, widths, strict=True) for x in (len(c), w)], squeezed(*(planes(c, w) for c, w in zip(columns, widths, strict=True)))]


def _unpacked_ints(sizes: list[int], data: bytes) -> list[np.ndarray]:
    raw, at, out = memoryview(zstandard.ZstdDecompressor().decompress(data)), 0, []
    for n, width in zip(sizes[::2], sizes[1::2], strict=True):
        out.append(from_planes(raw[at : at + n * width], n, width) if n else np.zeros(0, "u8"))
        at += n * width
    return out


class Grams(NamedTuple):
    """Distinct n-grams of one order, sorted by their words' places in ``vocab`` (sorted hashes); n: their counts."""

    vocab: np.ndarray
    words: list[np.ndarray]
    n: np.ndarray

    def packed(self) -> list:
        used = np.zeros(len(self.vocab), bool)
        for w in self.words:
            used[w] = True
        place = np.cumsum(used) - 1
        first, *others = (place[w] for w in self.words)
        return _packed_ints(np.diff(self.vocab[used], prepend=np.uint64(0)), self.n, np.diff(first, prepend=0), *others)

    def keys(self) -> tuple[np.ndarray, np.ndarray]:
        """Keys of the contexts (0 for single words) and of the n-grams."""
        context, key = np.zeros(len(self.words[0]), "u8"), self.vocab[self.words[0]]
        for w in self.words[1:]:
            context, key = key, _pairs(key, self.vocab[w])
        return context, key

    def contexts(self) -> np.ndarray:
        """Which context each n-gram has, from 0: as n-grams are sorted, equal ones lie together."""
        new = np.zeros(len(self.words[0]), bool)
        for w in self.words[:-1]:
            new[1:] |= w[1:] != w[:-1]
        return np.cumsum(new)

    def dealt(self, shards: int) -> Iterator[tuple[int, Grams]]:
        """For each shard that has some: its n-grams."""
        context, key = self.keys()
        owner = shard_of(context if len(self.words) > 1 else key, shards)
        order = np.argsort(owner, kind="stable")
        present, begin = np.unique(owner[order], return_index=True)
        for shard, at in zip(present.tolist(), np.split(order, begin[1:])):
            yield shard, Grams(self.vocab, [w[at] for w in self.words], self.n[at])


def _unpacked(sizes: list[int], data: bytes) -> Grams:
    vocab, n, first, *others = _unpacked_ints(sizes, data)
    return Grams(np.cumsum(vocab), [np.cumsum(first.view("i8")), *(w.view("i8") for w in others)], n)


def _distinct(words: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Where each distinct n-gram is first, sorted by its words' places (under 2**32), and which of them each n-gram is."""
    key = words[0].astype("u8")
    for i, w in enumerate(words[1:]):
        if i:
            key = np.unique(key, return_inverse=True)[1].astype("u8")
        key = key << np.uint64(32) | w.astype("u8")
    _, first, which = np.unique(key, return_index=True, return_inverse=True)
    return first, which


def _rows(rows: list[list], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], f.type) for i, f in enumerate(schema)], schema=schema)


def _listed(batch: pa.RecordBatch | pa.Table, *names: str) -> Iterator[tuple]:
    return zip(*(batch.column(c).to_pylist() for c in names), strict=True)


class Counts(NamedTuple):
    """Tables of one, two and three words: packed counts, a context in one row; by order the cuts and how many there are; total of the words' counts; unseen: what each word has at least."""

    tables: list[DataFrame]
    cuts: list[tuple[float, float, float]]
    sizes: list[int]
    total: int
    unseen: float


class Bitmap(NamedTuple):
    """Two bits for each key, in its shard's ``each`` bits."""

    bits: np.ndarray
    shards: int
    each: int

    def places(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        base, last = shard_of(keys, self.shards) * np.uint64(self.each), np.uint64(self.each - 1)
        return base + (keys & last), base + ((keys >> np.uint64(27)) & last)

    def maybe(self, keys: np.ndarray) -> np.ndarray:
        """Whether both bits are set: true for all that are in, and for few others."""
        out = np.ones(len(keys), bool)
        for place in self.places(keys):
            out &= (self.bits[(place >> np.uint64(3)).astype("i8")] >> (place & np.uint64(7)).astype("u1")) & 1 == 1
        return out


class Model(NamedTuple):
    """grams: order, shard and packed keys, a, g, in buckets by shard; unseen: what each word has at least; a bitmap of the keys of each order, broadcast once."""

    grams: DataFrame
    shards: int
    unseen: float
    bitmaps: Broadcast


def _trigrams(texts: DataFrame, shards: int, text_col: str) -> DataFrame:
    """Packed trigrams of all texts, counted for each batch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        claim("quality", "words")
        for batch in batches:
            for _, some in slices(batch, 0, BATCH_CHARS):
                h, _, real = _stream([tokens_of(t) for t in some])
                (vocab, at), ends = np.unique(h, return_inverse=True), np.flatnonzero(real)
                words = [at[ends - 2], at[ends - 1], at[ends]]
                first, which = _distinct(words)
                grams = Grams(vocab, [w[first] for w in words], np.bincount(which).astype("u8"))
                yield _rows([[shard, *own.packed()] for shard, own in grams.dealt(shards)], _GRAMS)

    return texts.select(F.coalesce(F.col(text_col).cast("string"), F.lit(""))).mapInArrow(run, _GRAMS_DDL)


def _endings(table: DataFrame, shards: int) -> DataFrame:
    """Packed n-grams without their first word; n says how many different ones were before it, row by row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for sizes, data in _listed(batch, "sizes", "data"):
                vocab, words, _ = _unpacked(sizes, data)
                first, which = _distinct(words[1:])
                grams = Grams(vocab, [w[first] for w in words[1:]], np.bincount(which).astype("u8"))
                yield _rows([[shard, *own.packed()] for shard, own in grams.dealt(shards)], _GRAMS)

    return table.select("sizes", "data").mapInArrow(run, _GRAMS_DDL)


def _merged(rows: pa.Table) -> pa.Table:
    """One shard's rows as one; stats: how many n-grams are counted 1, 2, 3 and 4 times, how many there are, the sum of counts."""
    parts = [_unpacked(sizes, data) for sizes, data in _listed(rows, "sizes", "data")]
    vocab = np.unique(np.concatenate([p.vocab for p in parts]))
    places = [np.searchsorted(vocab, p.vocab) for p in parts]
    words = [np.concatenate([place[p.words[i]] for p, place in zip(parts, places, strict=True)]) for i in range(len(parts[0].words))]
    n = np.concatenate([p.n for p in parts])
    del parts
    first, which = _distinct(words)
    n = np.bincount(which, n).astype("u8")
    stats = [*(int((n == i).sum()) for i in (1, 2, 3, 4)), len(n), int(n.sum())]
    return pa.Table.from_batches([_rows([[rows.column("shard")[0].as_py(), *Grams(vocab, [w[first] for w in words], n).packed(), stats]], _MERGED)])


def train(trusted: DataFrame, scratch: Scratch, text_col: str = "text") -> Counts:
    """The counts of all texts of ``trusted``. A few counts of counts are all that the driver sees of it."""
    shards = max(1, (trusted.agg(F.sum(F.octet_length(F.col(text_col).cast("string")))).first()[0] or 0) // TRAIN_BYTES)
    tables, cuts, sizes, stats = [], [], [], []
    for name in ("three", "two", "one"):
        rows = _endings(tables[0], shards) if tables else _trigrams(trusted, shards, text_col)
        tables.insert(0, scratch.keep(name, rows.groupBy("shard").applyInArrow(_merged, f"{_GRAMS_DDL}, stats array<long>"), free=True))
        stats = [x or 0 for x in tables[0].agg(*(F.sum(F.col("stats")[i]) for i in range(6))).first()]
        cuts.insert(0, discounts(dict(enumerate(stats[:4], 1))))
        sizes.insert(0, stats[4])
    once, twice, _, _, distinct, total = stats
    left = sum(n * d for n, d in zip((once, twice, distinct - once - twice), cuts[0], strict=True)) / total if total else 1.0
    return Counts(tables, cuts, sizes, total, left / (distinct + 1))


_PART = _GRAMS.append(pa.field("context", pa.bool_()))


def _shares(table: DataFrame, cut: tuple[float, float, float], shards: int, total: int | None, context: bool) -> DataFrame:
    """Packed keys and what they add (of ``total``, else of their context), or keys of contexts and what they leave."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for sizes, data in _listed(batch, "sizes", "data"):
                grams = _unpacked(sizes, data)
                (contexts, keys), own, n = grams.keys(), grams.contexts(), grams.n.astype("f8")
                whole = np.bincount(own, n)
                if context:
                    keys = contexts[np.unique(own, return_index=True)[1]]
                    values = sum(np.bincount(own, is_n) * d for is_n, d in zip((n == 1, n == 2, n > 2), cut, strict=True)) / whole
                else:
                    values = (n - np.array([0.0, *cut])[np.minimum(grams.n, 3).astype("i8")]) / (total or whole[own])
                order = np.argsort(keys)
                keys, values = keys[order], values[order].astype("f4").view("u4")
                yield _rows([[s, *_packed_ints(np.diff(keys[at], prepend=np.uint64(0)), values[at]), context] for s, (at,) in dealt([keys], shards)], _PART)

    return table.select("sizes", "data").mapInArrow(run, f"{_GRAMS_DDL}, context boolean")


def _joined(rows: pa.Table) -> pa.Table:
    """One shard's keys of one order with a (0 where it is only a context) and g (1 where it is none)."""
    parts = {True: [(np.zeros(0, "u8"), np.zeros(0, "f4"))], False: [(np.zeros(0, "u8"), np.zeros(0, "f4"))]}
    for sizes, data, context in _listed(rows, "sizes", "data", "context"):
        keys, values = _unpacked_ints(sizes, data)
        parts[context].append((np.cumsum(keys), values.astype("u4").view("f4")))
    (g_keys, g_values), (a_keys, a_values) = ([np.concatenate(x) for x in zip(*parts[c], strict=True)] for c in (True, False))
    keys = np.unique(np.concatenate([a_keys, g_keys]))
    a, g = np.zeros(len(keys), "f4"), np.ones(len(keys), "f4")
    a[np.searchsorted(keys, a_keys)] = a_values
    g[np.searchsorted(keys, g_keys)] = g_values
    return pa.Table.from_batches([_rows([[rows.column("shard")[0].as_py(), *_packed_ints(np.diff(keys, prepend=np.uint64(0)), a.view("u4"), g.view("u4"))]], _GRAMS)])


def _bitmap(grams: DataFrame, n_keys: int, shards: int) -> Bitmap:
    each = 1 << 10
    while each * 2 * shards <= min(n_keys * KEY_BITS, BITMAP_BITS):
        each *= 2

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for shard, sizes, data in _listed(batch, "shard", "sizes", "data"):
                bits = np.zeros(each, bool)
                for place in Bitmap(bits, shards, each).places(np.cumsum(_unpacked_ints(sizes, data)[0])):
                    bits[(place & np.uint64(each - 1)).astype("i8")] = True
                yield _rows([[shard, [], np.packbits(bits, bitorder="little").tobytes()]], _GRAMS)

    out = np.zeros(shards * each // 8, "u1")
    for r in grams.select("shard", "sizes", "data").mapInArrow(run, _GRAMS_DDL).collect():  # one row a shard, about BITMAP_BITS at most in all
        out[r.shard * each // 8 : (r.shard + 1) * each // 8] = np.frombuffer(r.data, "u1")
    return Bitmap(out, shards, each)


def keyed(counts: Counts, shards: int, scratch: Scratch) -> Model:
    """The model in so many shards."""
    parts = []
    for i, (table, cut) in enumerate(zip(counts.tables, counts.cuts, strict=True)):
        rows = _shares(table, cut, shards, None if i else counts.total, False)
        if i < 2:
            rows = rows.unionByName(_shares(counts.tables[i + 1], counts.cuts[i + 1], shards, None, True))
        parts.append(rows.groupBy("shard").applyInArrow(_joined, _GRAMS_DDL).select(F.lit(i + 1).alias("order"), "*"))
    # Each part of the documents reads the model where it lies: shuffled, it would be on disk twice.
    grams = scratch.keep_dealt("keys", parts, "shard", shards)
    bitmaps = [_bitmap(grams.filter(F.col("order") == i), n_keys, shards) for i, n_keys in enumerate(counts.sizes, 1)]
    return Model(grams, shards, counts.unseen, scratch.spark.sparkContext.broadcast(bitmaps))


_SENT = pa.schema([("shard", pa.int32()), ("batch", pa.int64()), ("sizes", pa.list_(pa.int64())), ("data", pa.binary())])
_SENT_DDL = "shard int, batch long, sizes array<long>, data binary"
_TEXT = pa.schema([("batch", pa.int64()), ("sizes", pa.list_(pa.int64())), ("data", pa.binary()), ("ids", pa.list_(pa.int64())), ("langs", pa.list_(pa.string()))])


def _packed(texts: DataFrame) -> DataFrame:
    """Batches of (doc_id, lang, text): their words' hashes, packed as the distinct ones and each word's place among them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        claim("quality", "words")
        batch_id = TaskContext.get().partitionId() << 32
        for batch in batches:
            for some, texts in slices(batch, 2, BATCH_CHARS):
                tokens = [tokens_of(t) for t in texts]
                vocab, at = np.unique(_stream(tokens)[0], return_inverse=True)
                sizes, data = _packed_ints(np.diff(vocab, prepend=np.uint64(0)), at.astype("u8"))
                yield _rows([[batch_id, [*sizes, *(len(t) + 3 for t in tokens)], data, some.column(0).to_pylist(), some.column(1).to_pylist()]], _TEXT)
                batch_id += 1

    return texts.mapInArrow(run, "batch long, sizes array<long>, data binary, ids array<long>, langs array<string>")


def _restored(sizes: list[int], data: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """What ``_stream`` gave for the texts of a packed batch."""
    (vocab, at), sizes = _unpacked_ints(sizes[:4], data), np.array(sizes[4:], "i8")
    begins, real = np.cumsum(sizes) - sizes, np.ones(len(at), bool)
    real[begins] = real[begins + 1] = False
    return np.cumsum(vocab)[at.view("i8")], np.repeat(np.arange(len(sizes)), sizes), real


def _wanted(h: np.ndarray, bitmaps: list[Bitmap]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Of n-grams of one to three words that the model may have: their keys, the places that have one, and which of the keys."""
    maybe = None
    for keys, bitmap in zip((h, *_grams(h)), bitmaps, strict=True):
        # The model has both shorter n-grams of each n-gram that it has.
        shorter, maybe = maybe, bitmap.maybe(keys)
        if shorter is not None:
            maybe &= shorter & np.concatenate([shorter[:1], shorter[:-1]])
        at = np.flatnonzero(maybe)
        distinct, which = np.unique(keys[at], return_inverse=True)
        yield distinct, at, which


def _asked(packed: DataFrame, sent, shards: int) -> DataFrame:
    """What each batch asks each shard: those of its n-grams that the model may have."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        claim("quality", "words")
        for batch in batches:
            for batch_id, sizes, data in zip(*(batch.column(i) for i in range(3)), strict=True):
                h, _, _ = _restored(sizes.as_py(), data.as_py())
                orders, rows = [keys for keys, _, _ in _wanted(h, sent.value)], []
                for shard, own in dealt(orders, shards):
                    parts = [keys[at] for keys, at in zip(orders, own, strict=True)]
                    rows.append([shard, batch_id.as_py(), [len(p) for p in parts], squeezed(*map(differences, parts))])
                yield _rows(rows, _SENT)

    return packed.mapInArrow(run, _SENT_DDL)


def _answered(asks: pa.Table, model: pa.Table) -> pa.Table:
    """One shard: which of each batch's keys the model has, and their a and g."""
    known = [Table(np.zeros(0, "u8"), a=np.zeros(0), g=np.zeros(0)) for _ in range(3)]
    for order, sizes, data in _listed(model, "order", "sizes", "data"):
        keys, a, g = _unpacked_ints(sizes, data)
        known[order - 1] = Table(np.cumsum(keys), a=a.astype("u4").view("f4"), g=g.astype("u4").view("f4"))
    rows = []
    for shard, batch, sizes, data in _listed(asks, "shard", "batch", "sizes", "data"):
        out, found = [], []
        for table, keys in zip(known, packed_keys(data, sizes), strict=True):
            at, hit = table.find(keys)
            out += [np.packbits(hit), *(planes(table.values[v][at[hit]].view("u4"), 4) for v in ("a", "g"))]
            found.append(int(hit.sum()))
        rows.append([shard, batch, [*sizes, *found], squeezed(*out)])
    return pa.Table.from_batches([_rows(rows, _SENT)])


def _scored(unseen: float, sent):
    """One batch: its documents with their nats, from their tokens and the shards' answers."""

    def run(batch: pa.Table, answers: pa.Table) -> pa.Table:
        claim("quality", "words")
        h, owner, real = _restored(batch.column("sizes")[0].as_py(), batch.column("data")[0].as_py())
        n_texts = len(batch.column("ids")[0])
        parts: list[list[list[np.ndarray]]] = [[[], [], []] for _ in range(3)]
        # Shards are ranges of keys, so that their answers come in the order of the keys.
        answers = answers.sort_by("shard")
        for sizes, data in _listed(answers, "sizes", "data"):
            raw, at = memoryview(zstandard.ZstdDecompressor().decompress(data)), 0
            for n, hits, columns in zip(sizes[:3], sizes[3:], parts, strict=True):
                bits = (n + 7) // 8
                columns[0].append(np.unpackbits(np.frombuffer(raw, "u1", bits, at), count=n).astype(bool))
                at += bits
                for column in columns[1:]:
                    column.append(from_planes(raw[at : at + 4 * hits], hits, 4).astype("u4").view("f4"))
                    at += 4 * hits
        # Interpolation from one word up: what the order adds, and what its context leaves to the lower ones.
        p, leaves = np.full(len(h), unseen, "f4"), np.ones(len(h), "f4")
        for (keys, at, which), columns in zip(_wanted(h, sent.value), parts, strict=True):
            hit, a, g = (np.concatenate(c) if c else np.zeros(0, k) for c, k in zip(columns, (bool, "f4", "f4"), strict=True))
            if len(hit) != len(keys):
                raise ValueError("a batch has changed between its two readings")
            adds, rest = np.zeros(len(keys), "f4"), np.ones(len(keys), "f4")
            adds[hit], rest[hit] = a, g
            p *= np.concatenate([leaves[:1], leaves[:-1]])
            p[at] += adds[which]
            leaves[:] = 1
            leaves[at] = rest[which]
        nats = -np.log(p[real].astype("f8"))
        nats, words = np.bincount(owner[real], nats, n_texts), np.bincount(owner[real], minlength=n_texts)
        columns = [pa.array(batch.column("ids")[0].as_py(), pa.int64()), pa.array(batch.column("langs")[0].as_py(), pa.string()), pa.array(nats, pa.float64()), pa.array(words, pa.int64())]
        return pa.Table.from_arrays(columns, names=["doc_id", "lang", "nats", "n_words"])

    return run


def shards_for(docs: DataFrame) -> int:
    return max(1, (docs.agg(F.sum(F.octet_length(F.col("text").cast("string")))).first()[0] or 0) // SHARD_BYTES)


def perplexities(docs: DataFrame, model: Counts | Model, shards: int | None = None) -> DataFrame:
    """doc_id, lang, nats and n_words of each row's whole text; an empty or null one has its end alone."""
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("lang").cast("string").alias("lang"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    if isinstance(model, Counts):
        model = keyed(model, shards or shards_for(texts), Scratch(docs.sparkSession, "keys"))
    # Both uses of the batches read one exchange.
    packed = _packed(texts).repartition("batch")
    answers = _asked(packed, model.bitmaps, model.shards).groupBy("shard").cogroup(model.grams.groupBy("shard")).applyInArrow(_answered, _SENT_DDL)
    return packed.groupBy("batch").cogroup(answers.groupBy("batch")).applyInArrow(_scored(model.unseen, model.bitmaps), "doc_id long, lang string, nats double, n_words long")


def _cells(scored: DataFrame) -> DataFrame:
    """lang, cell, n, sum: a histogram of rate for each language, and for null of all together."""
    cells = scored.groupBy("lang", F.floor(F.col("rate") * CELLS).alias("cell")).agg(F.count(F.lit(1)).alias("n"), F.sum("rate").alias("sum"))
    return cells.unionByName(cells.groupBy("cell").agg(F.sum("n").alias("n"), F.sum("sum").alias("sum")).withColumn("lang", F.lit(None).cast("string")))


def thresholds(scored: DataFrame, quantile: float = QUANTILE) -> DataFrame:
    """lang, limit, trusted: one row per language and one of null for all together, from trusted rows (lang, rate)."""
    within = Window.partitionBy("lang").orderBy("cell")
    ranked = _cells(scored).withColumn("upto", F.sum("n").over(within)).withColumn("all", F.sum("n").over(Window.partitionBy("lang")))
    top = F.min(F.when(F.col("upto") >= F.ceil(F.col("all") * quantile), F.col("cell")))
    return ranked.groupBy("lang").agg(((top + 1) / CELLS).alias("limit"), F.max("all").alias("trusted"))


def _by_language(scored: DataFrame, table: DataFrame, value: str, default: float) -> DataFrame:
    """``scored`` with the value of its language, or that of all where the language has fewer than LEAST trusted documents."""
    own = table.filter((F.col("trusted") >= LEAST) & F.col("lang").isNotNull()).select("lang", F.col(value).alias("own_value"))
    every = table.filter("lang is null").first()  # one row at most
    return scored.join(own, "lang", "left").withColumn(value, F.coalesce("own_value", F.lit(float(every[value]) if every else default))).drop("own_value")


def judge(docs: DataFrame, labels: DataFrame, quantile: float = QUANTILE, margin: float = MARGIN, texts: int | None = TRAIN_TEXTS) -> DataFrame:
    """doc_id, lang, n_words, perplexity, adjusted, threshold, keep: one row per row of ``docs`` (doc_id, text, lang).

    adjusted is the perplexity of the document and PRIOR words of its language's
    mean; keep says that it isn't above the threshold.  Trusted are documents
    labelled quality 1 and toxic 0 (of several labels of a doc_id, all must agree;
    null labels and ids are no trust).  A null lang is the empty string.  Languages
    with fewer than LEAST trusted documents take the mean and threshold of all
    languages; without any trusted document all are kept.  Repeated rows and ids are
    judged each by its own text.  Other columns are not looked at.
    """
    scratch = Scratch(docs.sparkSession, "quality")
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("lang").cast("string"), F.lit("")).alias("lang"), F.col("text").cast("string").alias("text"))
    good = labels.groupBy("doc_id").agg(F.min(F.coalesce((F.col("quality") == 1) & (F.col("toxic") == 0), F.lit(False))).alias("good")).filter("good and doc_id is not null")
    good = scratch.keep("good", good.select(F.col("doc_id").cast("long").alias("good_id")))
    # The ids to train on are chosen first, so that only their texts move. They are as many as labels allow, so nothing forces a broadcast.
    chosen = good.filter(F.pmod(F.xxhash64("good_id"), F.lit(2)) == 1)
    if texts is not None:
        chosen = chosen.orderBy(F.xxhash64("good_id"), "good_id").limit(texts)
    chosen = scratch.keep("chosen", chosen)
    odd = docs.filter(F.pmod(F.xxhash64("doc_id"), F.lit(2)) == 1)  # all that the join can find
    sample = odd.join(chosen, odd.doc_id == chosen.good_id, "left_semi")
    model = train(scratch.keep("sample", sample.select("text"), free=True), scratch)
    scratch.drop("sample")
    shards = shards_for(docs)
    model = keyed(model, shards, scratch)
    scratch.drop("three", "two", "one")
    rounds, scored = min(ROUNDS, shards), []
    for i in range(rounds):
        # The lowest bit says what the model may be trained on, and known n-grams are what moves: each part gets its share of them.
        part = docs.filter(F.pmod(F.shiftright(F.xxhash64("doc_id"), 1), F.lit(rounds)) == i)
        scored.append(scratch.keep(f"scored{i}", perplexities(part, model), free=True))
    model.bitmaps.destroy()  # a copy lies on each executor's disk
    scratch.drop("keys")
    scored = reduce(DataFrame.unionByName, scored)
    scored = scored.withColumn("rate", F.col("nats") / F.col("n_words"))
    unseen = scored.join(good, scored.doc_id == good.good_id, "left_semi").join(chosen, F.col("doc_id") == F.col("good_id"), "left_anti")
    means = scratch.keep("means", _cells(unseen).groupBy("lang").agg((F.sum("sum") / F.sum("n")).alias("mean"), F.sum("n").alias("trusted")))
    adjusted = ((F.col("nats") + PRIOR * F.col("mean")) / (F.col("n_words") + PRIOR)).alias("rate")
    limits = scratch.keep("limits", thresholds(_by_language(unseen, means, "mean", 0.0).select("lang", adjusted), quantile))
    judged = _by_language(_by_language(scored, means, "mean", 0.0), limits, "limit", float("inf"))
    judged = judged.select("doc_id", "lang", "n_words", F.exp("rate").alias("perplexity"), F.exp(adjusted).alias("adjusted"), F.exp(F.col("limit") + margin).alias("threshold"))
    return judged.withColumn("keep", F.col("adjusted") <= F.col("threshold"))


def keep_good(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """``docs`` without rejected documents, columns unchanged.

    Rows that share a doc_id (null is one too) go together: they stay if one of them is kept.
    """
    scratch, own = Scratch(docs.sparkSession, "good"), fresh()
    bad = judge(docs, labels).groupBy("doc_id").agg(F.max("keep").alias("any")).filter("not any").select(F.col("doc_id").alias(own))
    bad = scratch.keep("bad", bad)
    return docs.join(bad, F.col("doc_id").eqNullSafe(F.col(own)), "left_anti")
