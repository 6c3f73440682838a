"""Stupid-backoff scores: n-gram counts in hash shards, joined to the documents' n-grams, summed by document.

The score of a word after the ORDER - 1 words before it in its text is
count(those words and it) / count(those words) where the corpus has them
together, else ALPHA times the score after one word less; without any it is
count(word) / words, and half a count for a word that the corpus lacks.  A
document's score is the mean logarithm.

``corpus_scores`` scores the documents of a corpus by its other documents: a
document's own occurrences are left out of all counts, so that what only it says
backs off.  ``backoff_scores`` takes another corpus and has an n-gram a row.

``corpus_scores`` moves n-grams packed, as rows of one each would be many times
the corpus.  A batch of documents sends each shard one row: its distinct words, and
its distinct pairs of words with the words before them and how often.  Pairs bring
their three words to one shard, which sums the counts of all batches and joins them
back to each batch's lists: how often the others have each entry.  Back at the
batch, whose texts are packed, a document's own counts are taken off.  As an n-gram
is sent once a batch, a hot one weighs no more in its shard than any other that all
batches have.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from galena.llm.caches import claim
from galena.llm.chunks import slices
from galena.llm.packing import dealt, differences, from_planes, planes, squeezed, undone
from galena.llm.scratch import Scratch
from galena.llm.shingles import hashed, mix, words_of

ORDER, ALPHA = 3, 0.4
#: Characters of a batch of documents, and corpus bytes to a shard, roughly.
BATCH_CHARS, SHARD_BYTES = 4 << 20, 16 << 20
_STEP = np.uint64(0x9E3779B97F4A7C15)
#: Of the word before a pair its hash has so many bytes; 0 stands for none.
_BEFORE = 5


class _Lists:
    """A batch's distinct words, pairs and triples in order of their keys, how often it has each, and which each place has.

    Places without a word before them have no pair; those without two have a pair
    with nothing before it.
    """

    def __init__(self, texts: list[list[bytes]], order: int):
        sizes = np.array([len(t) for t in texts], "i8")
        self.owner = np.repeat(np.arange(len(texts)), sizes)
        self.place = np.arange(len(self.owner)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
        h = hashed([w for t in texts for w in t])
        self.words, self.word_of, self.word_times = np.unique(h, return_inverse=True, return_counts=True)
        at = self.with_pair = np.flatnonzero(self.place >= 1) if order > 1 else np.zeros(0, "i8")
        pair = mix(h[at - 1] * _STEP + h[at])
        before = np.where(self.place[at] >= 2, h[at - 2] >> np.uint64(64 - 8 * _BEFORE), np.uint64(0)) if order > 2 else np.zeros(len(at), "u8")
        by = np.lexsort((before, pair))
        pair, before = pair[by], before[by]
        new_pair = np.ones(len(at), bool)
        new_pair[1:] = pair[1:] != pair[:-1]
        new = new_pair.copy()
        new[1:] |= before[1:] != before[:-1]
        self.pairs, self.before = pair[new_pair], before[new]
        self.pair_times, self.times = (np.diff(np.append(np.flatnonzero(x), len(x))) for x in (new_pair, new))
        self.spread = np.diff(np.append((np.cumsum(new) - 1)[new_pair], len(self.before)))  # entries of each pair
        self.pair_of, self.entry_of = np.empty(len(at), "i8"), np.empty(len(at), "i8")
        self.pair_of[by], self.entry_of[by] = np.cumsum(new_pair) - 1, np.cumsum(new) - 1


_SENT = pa.schema([("shard", pa.int32()), ("batch", pa.int64()), ("sizes", pa.list_(pa.int64())), ("data", pa.binary())])
_SENT_DDL = "shard int, batch long, sizes array<long>, data binary"
_TEXT = pa.schema([("batch", pa.int64()), ("sizes", pa.list_(pa.int64())), ("data", pa.binary()), ("ids", pa.list_(pa.int64()))])


def _rows(rows: list[list], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], f.type) for i, f in enumerate(schema)], schema=schema)


def _packed(texts: DataFrame) -> DataFrame:
    """Batches of (doc_id, text): their words, packed."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        batch_id = TaskContext.get().partitionId() << 32
        for batch in batches:
            for some, texts in slices(batch, 1, BATCH_CHARS):
                lines = [b" ".join(words_of(t)) for t in texts]
                yield _rows([[batch_id, [len(x) for x in lines], squeezed(*lines, level=3), some.column(0).to_pylist()]], _TEXT)
                batch_id += 1

    return texts.mapInArrow(run, "batch long, sizes array<long>, data binary, ids array<long>")


def _words(sizes: list[int], data: bytes) -> list[list[bytes]]:
    raw, ends = zstandard.ZstdDecompressor().decompress(data), np.cumsum([0, *sizes]).tolist()
    return [raw[a:b].split(b" ") if b > a else [] for a, b in zip(ends, ends[1:])]


def _asked(packed: DataFrame, order: int, shards: int) -> DataFrame:
    """What each batch asks each shard."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        claim("backoff", "words")
        for batch in batches:
            for batch_id, sizes, data in zip(*(batch.column(i) for i in range(3)), strict=True):
                own, rows = _Lists(_words(sizes.as_py(), data.as_py()), order), []
                begin = np.concatenate([[0], np.cumsum(own.spread)])
                for shard, (w, p) in dealt([own.words, own.pairs], shards):
                    e = slice(begin[p.start], begin[p.stop])
                    parts = differences(own.words[w]), planes(own.word_times[w], 4), differences(own.pairs[p]), planes(own.spread[p], 4), planes(own.before[e], _BEFORE), planes(own.times[e], 4)
                    rows.append([shard, batch_id.as_py(), [x.stop - x.start for x in (w, p, e)], squeezed(*parts)])
                yield _rows(rows, _SENT)

    return packed.mapInArrow(run, _SENT_DDL)


def _others(table: pa.Table) -> pa.Table:
    """One shard: how often other batches have each entry of each batch's lists."""
    asked, sizes = [], table.column("sizes").to_pylist()
    for (words, pairs, entries), data in zip(sizes, table.column("data"), strict=True):
        raw, at, part = memoryview(zstandard.ZstdDecompressor().decompress(data.as_py())), 0, []
        for n, width in ((words, 8), (words, 4), (pairs, 8), (pairs, 4), (entries, _BEFORE), (entries, 4)):
            piece = raw[at : at + n * width]
            part.append(undone(piece, n) if width == 8 else from_planes(piece, n, width))
            at += n * width
        asked.append(part)
    word, word_times, pair, spread, before, times = (np.concatenate([a[i] for a in asked]) for i in range(6))
    del asked

    def rest(order: np.ndarray, new: np.ndarray, own: np.ndarray) -> np.ndarray:
        """The sum of ``own`` over equal entries, less its own."""
        group = np.cumsum(new) - 1
        out = np.empty(len(order), "i8")
        out[order] = np.bincount(group, own[order])[group] if len(order) else out
        return out - own.astype("i8")

    def changed(*columns: np.ndarray) -> np.ndarray:
        new = np.ones(len(columns[0]), bool)
        new[1:] = np.logical_or.reduce([c[1:] != c[:-1] for c in columns])
        return new

    by = np.argsort(word, kind="stable")
    words = rest(by, changed(word[by]), word_times)
    pair_times = np.add.reduceat(times, np.cumsum(spread.astype("i8")) - spread.astype("i8")) if len(pair) else times
    by = np.argsort(pair, kind="stable")
    pairs = rest(by, changed(pair[by]), pair_times)
    full = np.repeat(pair, spread.astype("i8"))
    by = np.lexsort((before, full))
    entries = rest(by, changed(full[by], before[by]), times)
    rows, at = [], [0, 0, 0]
    for shard, batch, size in zip(table.column("shard").to_pylist(), table.column("batch").to_pylist(), sizes, strict=True):
        parts = [planes(x[a : a + n], 4) for x, a, n in zip((words, pairs, entries), at, size, strict=True)]
        at = [a + n for a, n in zip(at, size, strict=True)]
        rows.append([shard, batch, size, squeezed(*parts)])
    return pa.Table.from_batches([_rows(rows, _SENT)])


def _scored(order: int, alpha: float):
    """One batch: its documents' sums but for the words of the corpus, which n_alone words are to be divided by, from their texts and what other batches have."""

    def run(batch: pa.Table, answers: pa.Table) -> pa.Table:
        claim("backoff", "words")
        texts = _words(batch.column("sizes")[0].as_py(), batch.column("data")[0].as_py())
        own = _Lists(texts, order)
        others: list[list[np.ndarray]] = [[], [], []]
        for sizes, data in zip(answers.column("sizes").to_pylist(), answers.column("data"), strict=True):
            raw, at = memoryview(zstandard.ZstdDecompressor().decompress(data.as_py())), 0
            for n, out in zip(sizes, others, strict=True):
                out.append(from_planes(raw[at : at + 4 * n], n, 4).astype("i8"))
                at += 4 * n
        order_of = np.argsort(answers.column("shard").to_numpy())
        others = [np.concatenate([o[i] for i in order_of]) if o else np.zeros(0, "i8") for o in others]
        if [len(o) for o in others] != [len(own.words), len(own.pairs), len(own.before)]:
            raise ValueError("a batch has changed between its two readings")

        def rest(of: np.ndarray, owner: np.ndarray, here: np.ndarray, elsewhere: np.ndarray) -> np.ndarray:
            """At each place, how often other documents than its own have its entry."""
            _, back, mine = np.unique(of * max(len(texts), 1) + owner, return_inverse=True, return_counts=True)
            return here[of] - mine[back] + elsewhere[of]

        n, at = len(own.owner), own.with_pair
        one, two, three = rest(own.word_of, own.owner, own.word_times, others[0]), np.zeros(n, "i8"), np.zeros(n, "i8")
        if len(at):
            two[at] = rest(own.pair_of, own.owner[at], own.pair_times, others[1])
            three[at] = np.where(own.before[own.entry_of] > 0, rest(own.entry_of, own.owner[at], own.times, others[2]), 0)
        size = np.array([len(t) for t in texts], "i8")
        score, alone = np.log(np.where(one > 0, one, 0.5)), np.ones(n, bool)
        for k, (longer, shorter) in enumerate(((two, one), (three, two))[: order - 1]):
            context = np.concatenate([shorter[:1] * 0, shorter[:-1]])
            found = longer > 0  # the longest n-gram that others have decides
            alone &= ~found
            score = np.where(found, np.log(np.where(found, longer, 1) / np.where(found, context, 1)), score + np.where(own.place > k, np.log(alpha), 0.0))
        columns = [np.bincount(own.owner, score, len(texts)).astype("f8"), np.bincount(own.owner, alone, len(texts)).astype("i8")]
        return pa.Table.from_arrays([pa.array(batch.column("ids")[0].as_py(), pa.int64()), *map(pa.array, (size, *columns))], names=["doc_id", "n_words", "part", "n_alone"])

    return run


def corpus_scores(docs: DataFrame, order: int = ORDER, alpha: float = ALPHA, id_col: str = "doc_id", text_col: str = "text", shards: int | None = None) -> DataFrame:
    """doc_id, n_words, score: one row per row of ``docs``, each scored by the counts of all other rows; ``order`` is 1, 2 or 3.

    A null text is empty; a text without words has a null score.  Rows of null or
    repeated doc_id are documents of their own, and repeated rows speak for each
    other.  An empty table gives no rows.  Other columns are not looked at.
    """
    if order not in (1, 2, 3):
        raise ValueError("order is 1, 2 or 3; backoff_scores has no such bound")
    text = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    shards = shards or max(1, (text.agg(F.sum(F.octet_length("text"))).first()[0] or 0) // SHARD_BYTES)
    # Both uses of the batches read one exchange; _scored checks that they are the same.
    packed = _packed(text).repartition("batch")
    answers = _asked(packed, order, shards).groupBy("shard").applyInArrow(_others, _SENT_DDL)
    parts = packed.groupBy("batch").cogroup(answers.groupBy("batch")).applyInArrow(_scored(order, alpha), "doc_id long, n_words long, part double, n_alone long")
    parts = Scratch(docs.sparkSession, "lm").keep("parts", parts)
    total = parts.agg(F.sum("n_words")).first()[0] or 0
    score = (F.col("part") - F.col("n_alone") * F.log(F.greatest(F.lit(total) - F.col("n_words"), F.lit(1)))) / F.col("n_words")
    return parts.select("doc_id", "n_words", F.when(F.col("n_words") > 0, score).alias("score"))


def _split(text_col: str):
    return F.filter(F.split(F.lower(F.coalesce(F.col(text_col).cast("string"), F.lit(""))), r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"), lambda w: w != "")


def ngram_counts(corpus: DataFrame, n: int) -> DataFrame:
    """gram (text), times: from (key, words)."""
    at = F.explode(F.sequence(F.lit(0), F.size("words") - n)).alias("i")
    return corpus.filter(F.size("words") >= n).select("words", at).groupBy(F.array_join(F.slice("words", F.col("i") + 1, F.lit(n)), " ").alias("gram")).agg(F.count(F.lit(1)).alias("times"))


def backoff_scores(docs: DataFrame, corpus: DataFrame, order: int = ORDER, alpha: float = ALPHA, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_words, score of ``docs`` by the counts of another ``corpus``, one row per row of ``docs``; edge cases as in corpus_scores."""
    scratch = Scratch(docs.sparkSession, "lm")
    # Rows keep a key of their own: the written table fixes it, and repeated rows stay apart.
    held = scratch.keep("docs", docs.select(F.monotonically_increasing_id().alias("key"), F.col(id_col).cast("long").alias("doc_id"), _split(text_col).alias("words")))
    known = scratch.keep("corpus", corpus.select(_split(text_col).alias("words")))
    counts = [scratch.keep(f"counts{n}", ngram_counts(known, n)) for n in range(1, order + 1)]
    total = known.agg(F.sum(F.size("words"))).first()[0] or 0
    pending, parts = held.select("key", F.posexplode("words").alias("i", "w")).select("key", "i", F.least("i", F.lit(order - 1)).alias("most")), []
    for n in range(order, 0, -1):
        gram = lambda end, size: F.array_join(F.slice("words", end - size + 2, F.lit(size)), " ")
        asked = pending.filter(F.col("most") >= n - 1).join(held.select("key", "words"), "key")
        asked = asked.select("key", "i", "most", gram(F.col("i"), n).alias("gram"), (gram(F.col("i") - 1, n - 1) if n > 1 else F.lit(None).cast("string")).alias("context"))
        asked = asked.join(counts[n - 1], "gram", "left")
        if n > 1:
            asked = asked.join(counts[n - 2].select(F.col("gram").alias("context"), F.col("times").alias("all")), "context", "left")
        else:
            asked = asked.withColumn("all", F.lit(max(total, 1))).withColumn("times", F.coalesce(F.col("times").cast("double"), F.lit(0.5)))
        looked = scratch.keep(f"order{n}", asked.select("key", "i", "most", "times", "all"))
        paid = F.log(F.col("times") / F.col("all")) + (F.col("most") - (n - 1)) * float(np.log(alpha))
        parts.append(looked.filter("times is not null").groupBy("key").agg(F.sum(paid).alias("part")))
        pending = pending.filter(F.col("most") < n - 1).unionByName(looked.filter("times is null").select("key", "i", "most"))
    sums = parts[0]
    for more in parts[1:]:
        sums = sums.unionByName(more)
    sums = sums.groupBy("key").agg(F.sum("part").alias("total"))
    size = F.size("words").cast("long")
    return held.join(sums, "key", "left").select("doc_id", size.alias("n_words"), F.when(size > 0, F.col("total") / size).alias("score"))
