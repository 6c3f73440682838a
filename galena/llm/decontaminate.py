"""Benchmark decontamination with a distributed positional inverted index.

Documents are dealt to shards of SHARD_BYTES.  A shard's words have one run of
positions, with a gap after each document, and the index stores for each shard
and word the sorted positions.  A phrase is looked up by intersecting, from its
rarest word on, the positions less the word's place in the phrase; what is left
are the starts of its occurrences.  With slop, words may have others between
them.  Shards are searched apart, so no word, however frequent, and no item
gathers its postings in one place.

Items are taken in blocks of BLOCK_WORDS, which bounds what is broadcast.  If one
block holds them all, postings of words that no item has are left out of the index;
else the index has all words, is built once whatever the number of blocks, and each
block reads the postings of its own words.  A shard tries the phrases whose rarest
word it has.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from galena.llm.caches import claim
from galena.llm.scratch import Scratch, fresh

WINDOW_WORDS = 10
SHARD_BYTES = 4 << 20
BLOCK_WORDS = 200_000

#: Bytes to what words are made of: A-Z in lower case, digits and a-z as they are, other ASCII a space.
_FOLD = bytes(ord(chr(b).lower()) if chr(b).isascii() and chr(b).isalnum() else 32 if b < 128 else b for b in range(256))


def words_of(text: str) -> list[bytes]:
    """Words in UTF-8: runs of digits, letters and whatever isn't ASCII."""
    return text.encode().translate(_FOLD).split()


def _packed(positions: np.ndarray) -> tuple[int, int, bytes]:
    steps = np.diff(positions)
    width = 1 if not len(steps) or (top := steps.max()) < 1 << 8 else 2 if top < 1 << 16 else 8
    return int(positions[0]), width, steps.astype(f"<u{width}").tobytes()


def _unpacked(first: int, width: int, steps: bytes) -> np.ndarray:
    out = np.concatenate([[first], np.frombuffer(steps, f"<u{width}").astype("i8")])
    return np.cumsum(out)


INDEX = "shard long, word string, n long, first long, width int, steps binary, doc_ids array<long>, n_words array<long>"
_ARROW = pa.schema([("shard", pa.int64()), ("word", pa.string()), ("n", pa.int64()), ("first", pa.int64()), ("width", pa.int32()), ("steps", pa.binary()), ("doc_ids", pa.list_(pa.int64())), ("n_words", pa.list_(pa.int64()))])


def build_index(docs: DataFrame, terms: list[str] | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The index: a row for each shard and word, and one with a null word for the shard's documents.

    Every row of ``docs`` is a document of its own, repeated or null doc_ids too;
    a null text has no words.  ``terms``: the words wanted, or all.
    """
    wanted = docs.sparkSession.sparkContext.broadcast(None if terms is None else {t.encode(): i for i, t in enumerate(terms)})
    everything = terms is None
    rows = docs.select(F.col(id_col).cast("long"), F.coalesce(F.col(text_col).cast("string"), F.lit("")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        claim("decontaminate")
        part, seq = TaskContext.get().partitionId(), 0
        words: list[bytes] = []
        ids: list[int | None] = []
        sizes: list[int] = []

        def closed() -> pa.RecordBatch:
            vocabulary = {w: i for i, w in enumerate(set(words))} if everything else wanted.value
            codes = np.fromiter(map(vocabulary.get, words, repeat(-1)), "i8", len(words))
            places = np.arange(len(words)) + np.repeat(np.arange(len(sizes)), sizes)
            held = np.flatnonzero(codes >= 0)
            held = held[np.argsort(codes[held], kind="stable")]
            cuts = np.flatnonzero(np.diff(codes[held])) + 1
            runs = np.split(places[held], cuts) if len(held) else []
            names = [words[i].decode() for i in held[np.concatenate([[0], cuts])]] if len(held) else []
            packed = [_packed(r) for r in runs]
            shard = part << 32 | seq
            none: list = [None] * len(runs)
            columns = [
                [shard] * (len(runs) + 1), [None, *names], [None, *map(len, runs)], [None, *(p[0] for p in packed)], [None, *(p[1] for p in packed)],
                [None, *(p[2] for p in packed)], [ids, *none], [sizes, *none],
            ]
            return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, _ARROW, strict=True)], schema=_ARROW)

        size = 0
        for batch in batches:
            for doc_id, text in zip(batch.column(0), batch.column(1), strict=True):
                found = words_of(text.as_py())
                words += found
                ids.append(doc_id.as_py())
                sizes.append(len(found))
                size += len(text.as_py())
                if size >= SHARD_BYTES:
                    yield closed()
                    words, ids, sizes, size, seq = [], [], [], 0, seq + 1
        if ids:
            yield closed()

    return rows.mapInArrow(run, INDEX)


class Phrases:
    """Item windows, each with its words from the rarest on."""

    def __init__(self, window: int, slop: int = 0):
        self.window, self.slop = window, slop
        self.items: dict[tuple[str, ...], set[str]] = {}
        self.words = 0

    def add(self, item: str, words: list[str]) -> None:
        for i in range(max(1, len(words) - self.window + 1) if words else 0):
            self.items.setdefault(tuple(words[i : i + self.window]), set()).add(item)
        self.words += len(words)

    def plan(self, counts: dict[str, int]) -> list[tuple[tuple[str, ...], list[int], list[str]]]:
        """(words, places from the rarest word on, items) of each window all of whose words occur."""
        kept = []
        for words, items in self.items.items():
            if all(w in counts for w in words):
                kept.append((words, sorted(range(len(words)), key=lambda i: (counts[words[i]], i)), sorted(items)))
        return kept


def _starts(words: tuple[str, ...], order: list[int], postings: dict[str, np.ndarray]) -> np.ndarray | None:
    found = None
    for place in order:
        if (held := postings.get(words[place])) is None:
            return None
        if found is None:
            found = held - place
        else:
            at = np.searchsorted(held, found + place)
            at[at == len(held)] = 0
            found = found[held[at] == found + place]
        if not len(found):
            return None
    return found


def _near(words: tuple[str, ...], order: list[int], postings: dict[str, np.ndarray], slop: int) -> tuple[np.ndarray, np.ndarray] | None:
    """Starts and ends of the words in order, with at most ``slop`` others between them."""
    if any(w not in postings for w in words):
        return None
    start, rare = postings[words[0]], postings[words[order[0]]]
    at = np.searchsorted(rare, start)
    reach = np.append(rare, np.iinfo("i8").max)[at]
    start = start[reach < start + len(words) + slop]
    end = start
    for word in words[1:]:
        held = np.append(postings[word], np.iinfo("i8").max // 2)
        end = held[np.minimum(np.searchsorted(held, end, "right"), len(held) - 1)]
    fits = end - start < len(words) + slop
    return (start[fits], end[fits] + 1) if fits.any() else None


def search(index: DataFrame, phrases: Phrases) -> DataFrame:
    """shard, ord, doc_id, n_words, spans (word ranges matched), items: one row per document of the index, which has the phrases' words."""
    spark = index.sparkSession
    counts = {r.word: r.n for r in index.filter("word is not null").groupBy("word").agg(F.sum("n").alias("n")).collect()}
    rarest: dict[str, list] = {}
    for words, order, items in phrases.plan(counts):
        rarest.setdefault(words[order[0]], []).append((words, order, items))
    sent = spark.sparkContext.broadcast(rarest)
    slop = phrases.slop

    def run(table: pa.Table) -> pa.Table:
        columns = {name: table.column(name).to_pylist() for name in ("word", "first", "width", "steps")}
        postings = {w: _unpacked(f, k, s) for w, f, k, s in zip(*columns.values(), strict=True) if w is not None}
        lead = columns["word"].index(None)
        ids, sizes = table.column("doc_ids")[lead].as_py(), np.array(table.column("n_words")[lead].as_py(), "i8")
        base = np.concatenate([[0], np.cumsum(sizes + 1)])
        spans: dict[int, list[tuple[int, int]]] = {}
        items: dict[int, set[str]] = {}
        for words, order, names in (phrase for word, own in sent.value.items() if word in postings for phrase in own):
            if slop:
                if (near := _near(words, order, postings, slop)) is None:
                    continue
                begin, end = near
                owner = np.searchsorted(base, begin, "right") - 1
                inside = end <= base[owner + 1] - 1  # the gap after a document is in no match
                begin, end, owner = begin[inside], end[inside], owner[inside]
            else:
                if (begin := _starts(words, order, postings)) is None:
                    continue
                end, owner = begin + len(words), np.searchsorted(base, begin, "right") - 1
            for d, a, b in zip(owner.tolist(), (begin - base[owner]).tolist(), (end - base[owner]).tolist(), strict=True):
                spans.setdefault(d, []).append((a, b))
                items.setdefault(d, set()).update(names)
        n = len(ids)
        merged = [_merged(spans[d]) if d in spans else [] for d in range(n)]
        out = [
            pa.array([table.column("shard")[0].as_py()] * n, pa.int64()), pa.array(range(n), pa.int32()), pa.array(ids, pa.int64()), pa.array(sizes, pa.int64()),
            pa.array([[{"start": a, "end": b} for a, b in m] for m in merged], pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))),
            pa.array([sorted(items.get(d, ())) for d in range(n)], pa.list_(pa.string())),
        ]
        return pa.Table.from_arrays(out, names=["shard", "ord", "doc_id", "n_words", "spans", "items"])

    return index.groupBy("shard").applyInArrow(run, "shard long, ord int, doc_id long, n_words long, spans array<struct<start:long,end:long>>, items array<string>")


def _merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def _covered(spans: Column) -> Column:
    """Words in the union of spans."""
    start = F.struct(F.lit(0).cast("long").alias("n"), F.lit(0).cast("long").alias("to"))
    step = lambda acc, s: F.struct((acc.n + F.greatest(s.end - F.greatest(s.start, acc.to), F.lit(0))).alias("n"), F.greatest(acc.to, s.end).alias("to"))
    return F.aggregate(F.array_sort(spans), start, step).n


def _postings(index: DataFrame, terms: list[str]) -> DataFrame:
    """The index's rows of some words, no more than a block has, and of its documents."""
    wanted = index.sparkSession.createDataFrame([(t,) for t in terms], "word string")
    return index.join(F.broadcast(wanted), "word", "left_semi").unionByName(index.filter("word is null"))


def matches(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW_WORDS, slop: int = 0, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: doc_id, n_words, spans, items, n_hit.

    A window is ``window`` consecutive words of an item, or all of a shorter item;
    an item without words has none.  Null texts have no words, a null item id is
    the empty string, items of equal id count as one.  Either table may be empty.
    """
    scratch = Scratch(docs.sparkSession, "decontaminate")
    items = benchmark.select(F.coalesce(F.col(item_col).cast("string"), F.lit("")).alias("item"), F.coalesce(F.col(item_text_col).cast("string"), F.lit("")).alias("text"))
    found: list[DataFrame] = []
    phrases, rows, whole = Phrases(window, slop), docs.select(F.col(id_col), F.col(text_col)), None

    def close() -> None:
        terms = sorted({w for words in phrases.items for w in words})
        index = scratch.keep("index", build_index(rows, terms, id_col, text_col)) if whole is None else _postings(whole, terms)
        found.append(scratch.keep(f"block{len(found)}", search(index, phrases)))

    for r in items.toLocalIterator():
        if phrases.words >= BLOCK_WORDS:
            if whole is None:
                whole = scratch.keep("index", build_index(rows, None, id_col, text_col))
            close()
            phrases = Phrases(window, slop)
        phrases.add(r.item, [w.decode() for w in words_of(r.text)])
    close()
    scratch.drop("index")
    total = found[0]
    if len(found) > 1:
        for more in found[1:]:
            total = total.unionByName(more)
        total = total.groupBy("shard", "ord").agg(
            F.first("doc_id").alias("doc_id"), F.first("n_words").alias("n_words"),
            F.flatten(F.collect_list("spans")).alias("spans"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"),
        )
    return total.select("doc_id", "n_words", "spans", "items", _covered(F.col("spans")).alias("n_hit"))


def contamination(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW_WORDS) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256, contaminated; edge cases as in matches."""
    digest = F.sha2(F.encode(F.array_join("items", ","), "UTF-8"), 256)
    found = matches(docs, benchmark, window)
    return found.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), digest.alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"))


def clean(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW_WORDS, id_col: str = "doc_id") -> DataFrame:
    """``docs`` without contaminated documents; columns unchanged.

    A doc_id that several rows share is contaminated if one of them is; rows of
    null doc_id likewise.
    """
    scratch, own = Scratch(docs.sparkSession, "clean"), fresh()
    hit = scratch.keep("hit", matches(docs, benchmark, window, id_col=id_col).filter("n_hit > 0").select(F.col("doc_id").alias(own)).distinct())
    return docs.join(hit, F.col(id_col).eqNullSafe(F.col(own)), "left_anti")
