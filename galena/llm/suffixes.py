"""Repeated passages by sparse suffix arrays.

Only suffixes at minimisers are kept: positions whose K-word shingle has the
smallest hash of some window, so that each passage of PASSAGE words or more has
one at the same place in all its copies.  Suffixes whose first K words occur in
one document only are left out.  The others are dealt to shards by those words,
sorted there by their next words and compared with their neighbours; from the
lengths of common prefixes and the words to the left, matches are extended both
ways: a passage of PASSAGE words around a suffix is repeated if another
document's suffix shares its words to the right and to the left.  All passages
that a suffix is the minimiser of are tried, so what is found is what comparing all
pairs of passages would find.

A start that many suffixes share, an eighth of what a shard is to hold, would bring
them all to one task.  The passages around those are compared by a hash of their words instead, which
deals them evenly: a batch of documents sends each of its distinct ones once, with
the first document that has it, and gets back which ones others have too.

Words are compared by 32 bits of their hash, those to
the left of a suffix by a 64-bit hash of them all.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute  # noqa: F401  used as pa.compute
import zstandard
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from galena.llm.caches import claim
from galena.llm.packing import bitmap_of, dealt, differences, maybe_in, squeezed, undone
from galena.llm.scratch import Scratch, fresh
from galena.llm.shingles import hashed, mix, words_of

PASSAGE, K = 50, 8
BATCH_CHARS = 2 << 20
#: Bits of the bitmap of repeated shingles: for each, and of all of it. With more of them it lets more others pass, which match nothing.
KEY_BITS, BITMAP_BITS = 16, 1 << 27
#: Suffixes to a shard, roughly.
SHARD_SUFFIXES = 16_000


def _window_min(x: np.ndarray, width: int) -> np.ndarray:
    """Minimum of each ``width`` neighbours, by doubling."""
    have = 1
    while have < width:
        step = min(have, width - have)
        x = np.minimum(x[:-step], x[step:])
        have += step
    return x


def minimisers(words: np.ndarray, passage: int, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(positions, hashes of their k words); none if there are fewer words than a passage."""
    if len(words) < passage:
        return np.zeros(0, "i8"), np.zeros(0, "u8")
    h = np.zeros(len(words) - k + 1, "u8")
    for i in range(k):
        h = mix(h * np.uint64(0x9E3779B97F4A7C15) + words[i : len(h) + i])
    width = passage - k + 1
    low = _window_min(h, width)
    # A position is a minimiser if it equals the largest minimum of the windows that hold it.
    edge = np.zeros(width - 1, "u8")
    best = ~_window_min(~np.concatenate([edge, low, edge]), width)
    at = np.flatnonzero(h == best)
    return at, h[at]


def _batched(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[list[int | None], list[np.ndarray]]]:
    claim("suffixes", "words")
    ids: list[int | None] = []
    words: list[np.ndarray] = []
    size = 0
    for batch in batches:
        for doc_id, text in zip(batch.column(0), batch.column(1), strict=True):
            t = text.as_py()
            ids.append(doc_id.as_py())
            words.append(hashed(words_of(t)))
            size += len(t)
            if size >= BATCH_CHARS:
                yield ids, words
                ids, words, size = [], [], 0
    if ids:
        yield ids, words


_ROWS = pa.schema([
    ("shard", pa.int32()), ("key", pa.int64()), ("doc_id", pa.int64()), ("n_words", pa.int64()), ("n", pa.int32()), ("data", pa.binary()), ("batch", pa.int64()), ("holds", pa.bool_()),
])
_SPAN = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))


def _shingle_hashes(text: DataFrame, passage: int, k: int) -> DataFrame:
    """h and times for each document that has it at a minimiser, which a text of one repeated line has often."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, words in _batched(batches):
            found = [np.unique(minimisers(w, passage, k)[1], return_counts=True) for w in words]
            h, times = (np.concatenate([f[i] for f in found]) for i in (0, 1))
            yield pa.RecordBatch.from_arrays([pa.array(h.view("i8")), pa.array(times)], names=["h", "times"])

    return text.mapInArrow(run, "h long, times long")


_BASE = 0x9E3779B97F4A7C15
_BACK = np.uint64(pow(_BASE, -1, 1 << 64))


def _passages(words: np.ndarray, at: np.ndarray, passage: int, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(starts, hashes) of the passages that hold the k words at one of the places."""
    low, high = np.maximum(at - (passage - k), 0), np.minimum(at, len(words) - passage)
    n = np.maximum(high - low + 1, 0)
    starts = np.unique(np.repeat(low - (np.cumsum(n) - n), n) + np.arange(n.sum()))
    grow = lambda base: np.cumprod(np.concatenate([np.ones(1, "u8"), np.full(len(words), base, "u8")]))
    sums = np.concatenate([np.zeros(1, "u8"), np.cumsum(words * grow(_BASE)[:-1])])
    return starts, mix((sums[starts + passage] - sums[starts]) * grow(_BACK)[starts])


def _hot_rows(batch: int, words: list[np.ndarray], hot: list[np.ndarray], passage: int, k: int, shards: int) -> list[list]:
    """What a batch asks each shard about its passages at hot starts, and what it must know to read the answers."""
    found = [(d, *_passages(w, at, passage, k)) for d, (w, at) in enumerate(zip(words, hot, strict=True)) if len(at)]
    if not found:
        return []
    doc, start, h = np.repeat([d for d, _, _ in found], [len(s) for _, s, _ in found]), *(np.concatenate([f[i] for f in found]) for i in (1, 2))
    by = np.lexsort((doc, h))
    doc, start, h = doc[by], start[by], h[by]
    new = np.concatenate([[True], h[1:] != h[:-1]])
    first = np.flatnonzero(new)
    times = np.diff(np.append(first, len(h)))
    several = doc[first] != doc[first + times - 1]
    rows = []
    for shard, (own,) in dealt([h[first]], shards):
        data = squeezed(differences(h[first][own]), several[own].astype("u1"), doc[first][own].astype("<u4"))
        rows.append([shard, None, None, None, own.stop - own.start, data, batch, False])
    held = squeezed(times.astype("<u4"), doc.astype("<u4"), start.astype("<u4"))
    return [*rows, [int(mix(np.array([batch], "u8"))[0] % np.uint64(shards)), None, None, len(first), len(h), held, batch, True]]


def _suffixes(text: DataFrame, passage: int, k: int, shards: int, wanted: np.ndarray, hot: np.ndarray) -> DataFrame:
    """A row for each document, and one for each batch and shard with its suffixes packed, and with its passages at hot starts."""
    sent = text.sparkSession.sparkContext.broadcast((wanted, hot))
    left = passage - k

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        base, pack = TaskContext.get().partitionId() << 32, zstandard.ZstdCompressor(level=1).compress
        for ids, words in _batched(batches):
            keys = np.arange(base, base + len(ids))
            own_base, base, at_hot = base, base + len(ids), []
            rows = [[int(mix(np.array([key], "u8"))[0] % np.uint64(shards)), key, i, len(w), 0, None, None, None] for key, i, w in zip(keys.tolist(), ids, words, strict=True)]
            owner, place, hashes = [], [], []
            for d, w in enumerate(words):
                at, h = minimisers(w, passage, k)
                few = maybe_in(sent.value[0], h)
                at, h = at[few], h[few]
                heat = np.isin(h, sent.value[1])
                at_hot.append(at[heat])
                at, h = at[~heat], h[~heat]
                owner.append(np.full(len(at), d))
                place.append(at)
                hashes.append(h)
            o, p, h = (np.concatenate(x) if x else np.zeros(0, "i8") for x in (owner, place, hashes))
            sizes = np.array([len(w) for w in words], "i8")
            gap = np.zeros(passage, "u4")
            stream = np.concatenate([gap, *(x for w in words for x in ((w >> np.uint64(16)).astype("u4"), gap))])
            start = passage + np.concatenate([[0], np.cumsum(sizes + passage)[:-1]])
            shard = (h >> np.uint64(32)) % np.uint64(shards)
            order = np.argsort(shard, kind="stable")
            present, begin = np.unique(shard[order], return_index=True)  # far fewer than shards, if those are many
            for s, own in zip(present.tolist(), np.split(order, begin[1:]), strict=False):
                at = start[o[own]] + p[own]
                context = stream[at[:, None] + np.arange(-left, passage)]
                rest = (sizes[o[own]] - p[own]).astype("i4")
                parts = h[own], keys[o[own]], p[own].astype("i4"), rest, context
                rows.append([s, None, None, None, len(own), pack(b"".join(np.ascontiguousarray(x).tobytes() for x in parts)), None, None])
            rows += _hot_rows(own_base, words, at_hot, passage, k, shards)
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], f.type) for i, f in enumerate(_ROWS)], schema=_ROWS)

    return text.mapInArrow(run, "shard int, key long, doc_id long, n_words long, n int, data binary, batch long, holds boolean")


def _matched(passage: int, k: int):
    """Of one shard: the ranges of passage starts that are repeated, by document, and its documents' rows."""
    left = passage - k

    def run(table: pa.Table) -> pa.Table:
        unpack = zstandard.ZstdDecompressor().decompress
        columns: list[list[np.ndarray]] = [[] for _ in range(5)]
        hot = _answers(table.filter(pa.compute.is_valid(table.column("batch"))))
        table = table.filter(pa.compute.is_null(table.column("batch")))
        for n, data in zip(table.column("n").to_pylist(), table.column("data"), strict=True):
            if not n:
                continue
            raw, at = unpack(data.as_py()), 0
            for column, kind in zip(columns, ("u8", "i8", "<i4", "<i4", f"({left + passage},)<u4"), strict=True):
                column.append(np.frombuffer(raw, kind, n, at))
                at += column[-1].nbytes
        named = table.filter(pa.compute.is_valid(table.column("key"))).select(["key", "doc_id", "n_words"])
        nothing = pa.array([None] * len(named), _SPAN)
        out = [_out(*(named.column(i) for i in range(3)), nothing, nothing, nothing), hot]
        if columns[0]:
            h, key, place, rest, context = (np.concatenate(c) for c in columns)
            # The suffix array of the shard: sorted by the first k words' hash, then word by word.
            right = context[:, left:].astype(">u4")
            sortable = np.ascontiguousarray(np.concatenate([h.astype(">u8").view("u1").reshape(-1, 8), right.view("u1").reshape(len(h), -1)], 1))
            order = np.argsort(sortable.view(f"V{sortable.shape[1]}").reshape(-1), kind="stable")
            h, key, place, rest, context = h[order], key[order], place[order], rest[order], context[order]
            differ = np.concatenate([context[1:, left:] != context[:-1, left:], np.ones((len(h) - 1, 1), bool)], 1)
            common = np.where(h[1:] == h[:-1], differ.argmax(1), 0)  # words that neighbours share to the right
            before = np.zeros(len(h), "u8")
            hits: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
            for o in range(left + 1):  # the passage that starts o words before the suffix
                if o:
                    before = mix(before * np.uint64(0x9E3779B97F4A7C15) + context[:, left - o])
                group = np.concatenate([[0], np.cumsum(common < passage - o)])
                able = np.flatnonzero((place >= o) & (rest >= passage - o))
                if len(able) < 2:
                    continue
                both = mix(before[able] + mix(group[able].astype("u8")))
                by = np.lexsort((key[able], both))
                v, who = both[by], key[able][by]
                new = np.concatenate([[True], v[1:] != v[:-1]])
                first = np.flatnonzero(new)
                run_of = np.cumsum(new) - 1
                last = np.append(first[1:], len(v)) - 1
                several = who[first] != who[last]
                hit = several[run_of]
                hits.append((who[hit], place[able][by][hit] - o, (who > who[first][run_of])[hit]))
            if hits:
                who, start, later = (np.concatenate(x) for x in zip(*hits, strict=True))
                out.append(_ranges(who, start, later, passage))
        return pa.concat_tables(out).cast(_OUT)

    return run


def _answers(table: pa.Table) -> pa.Table:
    """Of the passages at hot starts that batches ask about: which ones several documents have, and for which the batch has the first one. Rows that hold come as they are."""
    asked, rows = [], []
    for shard, n, data, batch, holds, m in zip(*(table.column(c).to_pylist() for c in ("shard", "n", "data", "batch", "holds", "n_words")), strict=True):
        if holds:
            rows.append([batch, None, m, n, data])
        else:
            raw = zstandard.ZstdDecompressor().decompress(data)
            asked.append((shard, batch, undone(memoryview(raw)[: 8 * n], n), np.frombuffer(raw, "u1", n, 8 * n), batch + np.frombuffer(raw, "<u4", n, 9 * n).astype("i8")))
    if asked:
        keys, back = np.unique(np.concatenate([a[2] for a in asked]), return_inverse=True)
        docs = np.bincount(back, 1 + np.concatenate([a[3] for a in asked]))
        who, least = np.concatenate([a[4] for a in asked]), np.full(len(keys), np.iinfo("i8").max)
        np.minimum.at(least, back, who)
        at = 0
        for shard, batch, own, _, mine in asked:
            spot = back[at : at + len(own)]
            at += len(own)
            rows.append([batch, shard, None, len(own), np.packbits(docs[spot] > 1).tobytes() + np.packbits(least[spot] == mine).tobytes()])
    none = pa.array([None] * len(rows), pa.int64())
    empty = pa.array([None] * len(rows), _SPAN)
    return _out(none, none, none, empty, empty, empty, *([r[i] for r in rows] for i in range(5)))


def _resolved(passage: int):
    """One batch: the ranges of its repeated passages at hot starts, by document."""

    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by([("shard", "ascending")])
        shards, n, m, data = (table.column(c).to_pylist() for c in ("shard", "n", "m", "data"))
        base, lead = table.column("batch")[0].as_py(), shards.index(None)
        raw = zstandard.ZstdDecompressor().decompress(data[lead])
        times = np.frombuffer(raw, "<u4", m[lead]).astype("i8")
        doc, start = (np.frombuffer(raw, "<u4", n[lead], 4 * (m[lead] + i * n[lead])).astype("i8") for i in (0, 1))
        repeated, mine = [], []
        for size, bits, shard in zip(n, data, shards, strict=True):
            if shard is not None:
                half = (size + 7) // 8
                repeated.append(np.unpackbits(np.frombuffer(bits, "u1", half), count=size).astype(bool))
                mine.append(np.unpackbits(np.frombuffer(bits, "u1", half, half), count=size).astype(bool))
        hit, ours = np.concatenate(repeated), np.concatenate(mine)
        first = np.repeat(doc[np.cumsum(times) - times], times)
        keep = np.repeat(hit, times)
        later = ~(np.repeat(ours, times) & (doc == first))
        return _ranges(base + doc[keep], start[keep], later[keep], passage)

    return run


def _out(*columns) -> pa.Table:
    """A table of _OUT from its first columns; the others are null."""
    n = len(columns[0])
    return pa.Table.from_arrays([columns[i] if i < len(columns) and not isinstance(columns[i], list) else pa.array(columns[i] if i < len(columns) else [None] * n, f.type) for i, f in enumerate(_OUT)], schema=_OUT)


_OUT = pa.schema([("key", pa.int64()), ("doc_id", pa.int64()), ("n_words", pa.int64()), ("repeated", _SPAN), ("extra", _SPAN), ("own", _SPAN), ("batch", pa.int64()), ("shard", pa.int32()), ("m", pa.int64()), ("n", pa.int64()), ("data", pa.binary())])


def _ranges(who: np.ndarray, start: np.ndarray, later: np.ndarray, passage: int) -> pa.Table:
    def spans(keys: np.ndarray, starts: np.ndarray) -> dict[int, list[dict]]:
        if not len(keys):
            return {}
        order = np.lexsort((starts, keys))
        k, s = keys[order], starts[order]
        new = np.ones(len(k), bool)
        new[1:] = (k[1:] != k[:-1]) | (s[1:] > s[:-1] + passage)
        at = np.flatnonzero(new)
        last = np.append(at[1:], len(k)) - 1
        out: dict[int, list[dict]] = {}
        for key, a, b in zip(k[at].tolist(), s[at].tolist(), (s[last] + passage).tolist(), strict=True):
            out.setdefault(key, []).append({"start": a, "end": b})
        return out

    repeated, extra, first = spans(who, start), spans(who[later], start[later]), spans(who[~later], start[~later])
    keys = list(repeated)
    none = pa.array([None] * len(keys), pa.int64())
    return _out(pa.array(keys, pa.int64()), none, none, *(pa.array([found.get(k) for k in keys], _SPAN) for found in (repeated, extra, first)))


def _merged(spans: Column) -> Column:
    """Sorted spans with those that touch made one."""
    kind = "array<struct<start:bigint,end:bigint>>"
    last = lambda acc: F.element_at(acc, -1)
    grown = lambda acc, s: F.concat(F.slice(acc, F.lit(1), F.size(acc) - 1), F.array(F.struct(last(acc).start.alias("start"), F.greatest(last(acc).end, s.end).alias("end"))))
    step = lambda acc, s: F.when((F.size(acc) > 0) & (s.start <= F.try_element_at(acc, F.lit(-1)).end), grown(acc, s)).otherwise(F.concat(acc, F.array(s)))
    return F.aggregate(F.array_sort(spans), F.array().cast(kind), step)


def repeated_passages(docs: DataFrame, passage: int = PASSAGE, k: int = K, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_words, n_repeated, n_extra, repeated, extra, own: one row per row of ``docs``.

    repeated: spans of words inside a passage of ``passage`` words that another
    row's text has too; extra: those where a row that is read earlier has it; own:
    those where this row is the first. Extra words that aren't own ones can go.  Words are compared in lower case, without the signs
    between them.  A null text is empty; shorter texts have no passage.  Rows of null
    or repeated doc_id are documents of their own; an empty table gives no rows.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "suffixes")
    text = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    several = _shingle_hashes(text, passage, k).groupBy("h").agg(F.count(F.lit(1)).alias("docs"), F.sum("times").alias("n")).filter("docs > 1")
    several = scratch.keep("several", several)
    total = several.agg(F.sum("n")).first()[0] or 0
    shards = max(1, total // SHARD_SUFFIXES)
    # What several hot starts have must fit into one shard, too. A million at most.
    hot = np.sort(several.filter(F.col("n") > max(SHARD_SUFFIXES // 8, total // 1_000_000)).select("h").toArrow().column("h").to_numpy().view("u8"))
    rows = _suffixes(text, passage, k, shards, bitmap_of(several.select(F.col("h").alias("key")), KEY_BITS, BITMAP_BITS), hot)
    span = "array<struct<start:long,end:long>>"
    fields = f"key long, doc_id long, n_words long, repeated {span}, extra {span}, own {span}, batch long, shard int, m long, n long, data binary"
    found = rows.groupBy("shard").applyInArrow(_matched(passage, k), fields)
    if len(hot):
        found = scratch.keep("found", found)
        found = found.filter("key is not null").unionByName(found.filter("batch is not null").groupBy("batch").applyInArrow(_resolved(passage), fields))
    spans = lambda c: _merged(F.flatten(F.collect_list(c))).alias(c)
    out = found.groupBy("key").agg(F.max("doc_id").alias("doc_id"), F.max("n_words").alias("n_words"), spans("repeated"), spans("extra"), spans("own"))
    words = lambda c: F.aggregate(c, F.lit(0).cast("long"), lambda acc, s: acc + s.end - s.start)
    return out.select("doc_id", "n_words", words("repeated").alias("n_repeated"), words("extra").alias("n_extra"), "repeated", "extra", "own")


def without_spans(text: str, spans: list[tuple[int, int]]) -> str:
    """``text`` without the words of spans, and what stands between and after them up to the next word."""
    if not spans:
        return text
    places = _places(text)
    out, at = [], 0
    for first, last in spans:
        out.append(text[at : places[first]])
        at = places[last] if last < len(places) else len(text)
    return "".join([*out, text[at:]])


def _rest(spans: list[tuple[int, int]], kept: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """What of sorted spans is in none of the sorted kept ones."""
    out, at = [], 0
    for a, b in spans:
        while at < len(kept) and kept[at][1] <= a:
            at += 1
        i = at
        while a < b:
            if i == len(kept) or kept[i][0] >= b:
                out.append((a, b))
                break
            if kept[i][0] > a:
                out.append((a, kept[i][0]))
            a, i = kept[i][1], i + 1
    return out


def _places(text: str) -> list[int]:
    """Where each word of words_of() begins, in characters."""
    out, inside = [], False
    for i, low in enumerate(map(str.lower, text)):
        for c in low:  # lower case may be longer
            word = c >= "\x80" or c.isalnum()
            if word and not inside:
                out.append(i)
            inside = word
    return out


def drop_repeats(docs: DataFrame, passage: int = PASSAGE, k: int = K, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with repeated passages cut out of all texts but the one that is read first; columns unchanged.

    Words stay where they are in a passage whose first text this is, so that one whole
    copy of every passage is left. Rows of null or repeated doc_id are told apart; null and short texts stay as they are.
    """
    scratch, row = Scratch(docs.sparkSession, "repeats"), fresh()
    # The written table fixes the rows' numbers, under which passages are looked for.
    held = scratch.keep("docs", docs.withColumn(row, F.monotonically_increasing_id()))
    spans = repeated_passages(held, passage, k, row, text_col).filter("n_extra > 0").select(F.col("doc_id").alias(f"{row}i"), F.struct("extra", "own").alias(f"{row}x"))
    both = held.join(spans, F.col(row) == F.col(f"{row}i"), "left")

    @F.pandas_udf("string")
    def cut(texts: pd.Series, found: pd.DataFrame) -> pd.Series:
        pairs = lambda spans: [(s["start"], s["end"]) for s in spans]
        return pd.Series([t if t is None or x is None else without_spans(t, _rest(pairs(x), pairs(own))) for t, x, own in zip(texts, found["extra"], found["own"], strict=True)])

    text = F.when(F.col(f"{row}x").isNull(), F.col(text_col)).otherwise(cut(F.col(text_col).cast("string"), F.col(f"{row}x"))).alias(text_col)
    return both.select(*[text if c == text_col else F.col(f"`{c}`") for c in docs.columns])
