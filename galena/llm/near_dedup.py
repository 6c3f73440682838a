"""Near-duplicate classes by BagMinHash over multisets of word shingles.

Signatures.  Each shingle of a text with its number of occurrences w owns
Poisson processes over the discretised weights (0,1], (1,2], (2,4], (4,8], ...
up to w.  A process yields its points in time order, each with a component of
the signature; a component keeps its earliest point.  Where w lies inside an
interval, the process is split in halves: one inherits the point, the other
has a later one, and the half above w is dropped.  All of it is drawn from the
shingle's hash, so texts agree in a component with the probability of their
weighted Jaccard similarity.  Processes stop once they are later than all
components, so long texts cost little more than one point a shingle.

Classes.  Texts of equal words are one node.  Signatures are banded; nodes that
share a band are candidates.  Buckets of few nodes give their pairs.  Nodes of
crowded buckets are dealt anew by their rarest shingles: two texts of sizes m and
n that are similar enough share a = ceil(t / (1 + t) * (m + n)) elements, so the
n - a + 1 rarest of one and the m - a + 1 rarest of the other meet.  Sizes are cut
into narrow classes, and a node has a prefix for each class it can pair with, as
short as that class allows.  Shingles that no other such text has are the rarest,
so a text changed in too many places meets none, and half-similar families fall
apart before any pair of theirs is made.  Small prefix buckets give their pairs; in
a larger one the node with most of its shingles in other texts is paired with the
others.  Pairs are verified on the whole multisets.  Then the nodes outside a
bucket's largest component are paired with its nodes of other components, until no
two nodes of a bucket are left that are neither in one component nor verified.  So
no link is lost and nodes of one component are not paired with each other.
Classes are the connected components of the links.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from galena.llm.caches import claim
from galena.llm.components import components
from galena.llm.scratch import Scratch, fresh
from galena.llm.shingles import SHINGLE_WORDS, mix, multisets, node_of, overlap, words_of

BANDS, ROWS = 24, 4
THRESHOLD = 0.8
#: Buckets of at most so many nodes give all their pairs; nodes of larger bands are dealt anew, by their rarest shingles.
SMALL = 8
#: Sizes of texts in one class differ by this part at most.
CLASS_WIDTH = 0.025
#: Ids of candidates are broadcast up to this number, else joined by shuffle.
BROADCAST_IDS = 1_000_000

_LEFT, _RIGHT, _NEXT, _PART = (np.uint64(x) for x in (0xA24BAED4963EE407, 0x9FB21C651E98DF25, 0xD6E8FEB86659FD93, 0xC2B2AE3D27D4EB4F))


def _exponential(seed: np.ndarray) -> np.ndarray:
    return -np.log1p(-(mix(seed) >> np.uint64(11)).astype("f8") * 2.0**-53)


def signatures(owner: np.ndarray, shingle: np.ndarray, times: np.ndarray, texts: int, size: int) -> np.ndarray:
    """Earliest points, texts x size; infinite for texts without shingles."""
    best = np.full((texts, size), np.inf)
    flat = best.reshape(-1)
    octaves = np.ceil(np.log2(times)).astype("i8") + 1
    pick = np.repeat(np.arange(len(owner)), octaves)
    octave = np.arange(len(pick)) - np.repeat(np.cumsum(octaves) - octaves, octaves)
    low = np.where(octave == 0, 0, 1 << np.maximum(octave - 1, 0))
    high = 1 << octave
    seed = mix(shingle[pick] + octave.astype("u8") * _PART)
    doc, w = owner[pick], times[pick]
    t = _exponential(seed) / (high - low)
    part = (mix(seed ^ _PART) % np.uint64(size)).astype("i8")
    limit = np.full(texts, np.inf)
    while len(doc):
        counts = high <= w
        np.minimum.at(flat, doc[counts] * size + part[counts], t[counts])
        live = np.unique(doc)
        limit[live] = best[live].max(axis=1)
        on = t <= limit[doc]
        doc, w, low, high, seed, t, part = (x[on] for x in (doc, w, low, high, seed, t, part))
        leaf = high - low == 1
        if leaf.all():
            seed = mix(seed + _NEXT)
            t = t + _exponential(seed)
            part = (mix(seed ^ _PART) % np.uint64(size)).astype("i8")
            continue
        a, b = np.flatnonzero(leaf), np.flatnonzero(~leaf)
        middle = (low[b] + high[b]) // 2
        seeds = [mix(seed[a] + _NEXT), mix(seed[b] + _LEFT), mix(seed[b] + _RIGHT)]
        left_has = (seed[b] >> np.uint64(63)) == 0
        later = t[b] + _exponential(mix(seed[b] ^ _NEXT)) / (middle - low[b])
        fresh = [(mix(s ^ _PART) % np.uint64(size)).astype("i8") for s in seeds]
        t = np.concatenate([t[a] + _exponential(seeds[0]), np.where(left_has, t[b], later), np.where(left_has, later, t[b])])
        part = np.concatenate([fresh[0], np.where(left_has, part[b], fresh[1]), np.where(left_has, fresh[2], part[b])])
        low, high = np.concatenate([low[a], low[b], middle]), np.concatenate([high[a], middle, high[b]])
        doc, w, seed = np.concatenate([doc[a], doc[b], doc[b]]), np.concatenate([w[a], w[b], w[b]]), np.concatenate(seeds)
        within = low < w
        doc, w, low, high, seed, t, part = (x[within] for x in (doc, w, low, high, seed, t, part))
    return best


def _banded(best: np.ndarray, bands: int, rows: int) -> np.ndarray:
    bits = best.view("u8").reshape(len(best), bands, rows)
    h = np.zeros(bits.shape[:2], "u8")
    for i in range(rows):
        h = mix(h * _LEFT + bits[:, :, i] + np.uint64(i))
    return h.view("i8")


def _batches(batch: pa.RecordBatch, column: int, most: int = 2 << 20) -> Iterator[tuple[pa.RecordBatch, list[list[bytes]]]]:
    """Slices of a batch with their words, of about ``most`` characters: whole texts, bounded arrays."""
    start, size, words = 0, 0, []
    for i, text in enumerate(batch.column(column).to_pylist()):
        words.append(words_of(text))
        size += len(text)
        if size >= most or i == batch.num_rows - 1:
            yield batch.slice(start, i + 1 - start), words
            start, size, words = i + 1, 0, []


def _text(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))


def sketch(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", bands: int = BANDS, rows: int = ROWS, words: int = SHINGLE_WORDS) -> DataFrame:
    """doc_id, node (null without words), bands: one row per row of ``docs``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        claim("near", "words")
        for batch in batches:
            for some, texts in _batches(batch, 1):
                nodes = [node_of(t) if t else None for t in texts]
                own: dict[bytes, int] = {}  # repeated texts of a batch are signed once
                place = [own.setdefault(n, len(own)) if n else None for n in nodes]
                seen: set[int] = set()
                distinct = [t for t, p in zip(texts, place, strict=True) if p is not None and not (p in seen or seen.add(p))]
                signed = _banded(signatures(*multisets(distinct, words), len(distinct), bands * rows), bands, rows) if distinct else None
                hashes = [None if p is None else signed[p] for p in place]
                yield pa.RecordBatch.from_arrays([some.column(0), pa.array(nodes, pa.binary()), pa.array(hashes, pa.list_(pa.int64()))], names=["doc_id", "node", "bands"])

    return _text(docs, id_col, text_col).mapInArrow(run, "doc_id long, node binary, bands array<long>")


class _Verifier:
    """Checks pairs of nodes on the words of their texts, which it fetches once."""

    def __init__(self, docs: DataFrame, owners: DataFrame, nodes: DataFrame, scratch: Scratch, words: int):
        self.scratch, self.words, self.done = scratch, words, 0
        ids = scratch.keep("ids", owners.join(nodes, "node", "left_semi").select(F.col("rep").alias("_id")).distinct())
        ids = F.broadcast(ids) if ids.count() <= BROADCAST_IDS else ids
        few = docs.join(ids, docs.doc_id.eqNullSafe(F.col("_id")), "left_semi")

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for _, texts in _batches(batch, 0):
                    texts = [t for t in texts if t]
                    yield pa.RecordBatch.from_arrays([pa.array(map(node_of, texts), pa.binary()), pa.array([b" ".join(t) for t in texts], pa.binary())], names=["node", "words"])

        found = few.select("text").mapInArrow(run, "node binary, words binary")
        self.texts = scratch.keep("texts", found.groupBy("node").agg(F.min("words").alias("words")))

    def verify(self, pairs: DataFrame) -> DataFrame:
        """``pairs`` (a, b) with their similarity."""
        k = self.words
        self.done += 1
        pairs = self.scratch.keep(f"pairs{self.done}", pairs.select("a", "b").distinct())
        held = pairs.join(self.texts.select(F.col("node").alias("b"), F.col("words").alias("b_words")), "b")
        held = held.join(self.texts.select(F.col("node").alias("a"), F.col("words").alias("a_words")), "a").select("a", "b", "a_words", "b_words")

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            claim("near", "words")
            last: tuple[bytes, tuple] | None = None  # rows come sorted by a
            for batch in batches:
                out = []
                for a, left, right in zip(*(batch.column(i) for i in (0, 2, 3)), strict=True):
                    if last is None or last[0] != a.as_py():
                        last = a.as_py(), multisets([left.as_py().split()], k)[1:]
                    out.append(overlap(last[1], multisets([right.as_py().split()], k)[1:]))
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(out, pa.float64())], names=["a", "b", "sim"])

        return self.scratch.keep(f"verified{self.done}", held.mapInArrow(run, "a binary, b binary, sim double"))


def near_classes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD, bands: int = BANDS, rows: int = ROWS, words: int = SHINGLE_WORDS) -> DataFrame:
    """doc_id, class_id, class_size, kept: one row per row of ``docs``.

    class_id is the smallest doc_id of the class (null only if all are null), and
    the row that has it is kept; of repeated rows that share it, one is.  Texts of
    equal words are in one class.  A text without words, null ones too, is a class
    of its own.  An empty table gives no rows.  Other columns are not looked at.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "near")
    base = _text(docs, id_col, text_col)
    # The written table fixes the rows' own keys, which tell repeated rows apart.
    rows_of = scratch.keep("rows", sketch(docs, id_col, text_col, bands, rows, words).withColumn("row", F.monotonically_increasing_id()))
    nodes = rows_of.filter("node is not null").groupBy("node").agg(F.min("doc_id").alias("rep"), F.first("bands").alias("bands"))
    nodes = scratch.keep("nodes", nodes)
    members = nodes.select("node", F.posexplode("bands").alias("band", "value"))
    members = members.select("node", F.xxhash64("band", "value").alias("k1"), F.col("value").alias("k2"))
    found = members.groupBy("k1", "k2").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    buckets = scratch.keep("buckets", found)
    comps = None
    if not buckets.isEmpty():
        members = scratch.keep("members", members.join(buckets, ["k1", "k2"]).select("k1", "k2", "node", "n"))
        comps = _linked(base, nodes, members, threshold, scratch, words)
    named = rows_of.select("doc_id", "row", "node")
    if comps is not None:
        named = named.join(comps, "node", "left").select("doc_id", "row", F.coalesce("comp", "node").alias("comp"))
    else:
        named = named.select("doc_id", "row", F.col("node").alias("comp"))
    named = scratch.keep("named", named)
    held = named.filter("comp is not null")
    best = F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "row")).alias("best")
    sizes = scratch.keep("sizes", held.groupBy("comp").agg(best, F.count(F.lit(1)).alias("class_size")))
    out = held.join(sizes, "comp").select("doc_id", F.col("best.doc_id").alias("class_id"), "class_size", (F.col("row") == F.col("best.row")).alias("kept"))
    alone = named.filter("comp is null").select("doc_id", F.col("doc_id").alias("class_id"), F.lit(1).cast("long").alias("class_size"), F.lit(True).alias("kept"))
    scratch.drop("rows", "members", "candidates", "crowd", "elements", "prefixes", "dealt", "mixed", "texts", "ids", "buckets", "nodes")
    scratch.drop(*(f"{kind}{i}" for kind in ("pairs", "verified") for i in range(1, 4)), *(f"comps{i}-{kind}" for i in range(3) for kind in ("links", "near", *range(8))))
    return out.unionByName(alone)


def _linked(base: DataFrame, nodes: DataFrame, members: DataFrame, threshold: float, scratch: Scratch, words: int) -> DataFrame | None:
    """node, comp for nodes that have a link."""
    check = _Verifier(base, nodes, members.select("node").distinct(), scratch, words)
    pairs = _all_pairs(members.filter(F.col("n") <= SMALL))
    crowd = scratch.keep("crowd", members.filter(F.col("n") > SMALL).select("node").distinct())
    dealt = None
    if not crowd.isEmpty():
        dealt = _prefixes(check.texts.join(crowd, "node", "left_semi"), threshold, words, scratch)
        hubs = dealt.groupBy("k1", "k2").agg(F.max(F.struct("central", "node")).alias("top"), F.count(F.lit(1)).alias("n")).filter("n > 1")
        dealt = scratch.keep("dealt", dealt.join(hubs.select("k1", "k2", "n", F.col("top.node").alias("hub")), ["k1", "k2"]))
        stars = dealt.filter((F.col("n") > SMALL) & (F.col("node") != F.col("hub"))).select(F.least("hub", "node").alias("a"), F.greatest("hub", "node").alias("b"))
        pairs = pairs.unionByName(_all_pairs(dealt.filter(F.col("n") <= SMALL))).unionByName(stars)
    pairs = scratch.keep("candidates", pairs.distinct())
    # Each node's pair with its smallest partner first: what that joins needs no other proof.
    first = pairs.groupBy("b").agg(F.min("a").alias("a"))
    verified = check.verify(first)
    comps = components(verified.filter(F.col("sim") >= threshold), scratch, "comps0")
    apart = _apart(pairs, comps).join(verified.select("a", "b"), ["a", "b"], "left_anti")
    verified = verified.unionByName(check.verify(apart))
    comps = components(verified.filter(F.col("sim") >= threshold), scratch, "comps1")
    if dealt is None:
        return comps
    mixed = scratch.keep("mixed", _mixed(dealt.filter(F.col("n") > SMALL), comps))
    if mixed.isEmpty():
        return comps
    verified = verified.unionByName(check.verify(_cross(mixed).distinct().join(verified.select("a", "b"), ["a", "b"], "left_anti")))
    return components(verified.filter(F.col("sim") >= threshold), scratch, "comps2")


def _all_pairs(members: DataFrame) -> DataFrame:
    """The pairs (a < b) of buckets of at most SMALL nodes."""
    held = members.groupBy("k1", "k2").agg(F.array_sort(F.collect_list("node")).alias("all"))
    return held.select(F.col("all"), F.posexplode("all").alias("i", "a")).select("a", F.explode(F.slice("all", F.col("i") + 2, F.lit(SMALL))).alias("b"))


def _cross(mixed: DataFrame) -> DataFrame:
    """Pairs of each node outside a bucket's largest component with the bucket's nodes of other components.

    Where a bucket is of two classes, pairs of one class are left to that class's own bucket.
    """
    side = ["k1", "k2"]
    other = mixed.select(*side, F.col("node").alias("y"), F.col("comp").alias("y_comp"), F.col("class").alias("y_class"))
    met = mixed.filter("comp <> largest").join(other, side).filter((F.col("comp") != F.col("y_comp")) & (F.col("alike") | (F.col("class") != F.col("y_class"))))
    return met.select(F.least("node", "y").alias("a"), F.greatest("node", "y").alias("b"))


def _edges() -> np.ndarray:
    """Smallest sizes of the classes."""
    edges = [0, 1]
    while edges[-1] < 1 << 40:
        edges.append(max(edges[-1] + 1, int(edges[-1] * (1 + CLASS_WIDTH))))
    return np.array(edges)


def _prefixes(texts: DataFrame, threshold: float, words: int, scratch: Scratch) -> DataFrame:
    """Buckets (k1, k2) of nodes that share an element (an occurrence of a shingle) among their rarest.

    k2 stands for a pair of size classes, alike if it is one class. central is the
    share of a node's elements that other nodes have.
    """

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        claim("near", "words")
        for batch in batches:
            for node, text in zip(batch.column(0), batch.column(1), strict=True):
                _, shingle, times = multisets([text.as_py().split()], words)
                nth = np.arange(times.sum()) - np.repeat(np.cumsum(times) - times, times)
                element = mix(np.repeat(shingle, times) + nth.astype("u8") * _PART).view("i8")
                columns = [pa.array([node.as_py()] * len(element), pa.binary()), pa.array(element), pa.array(np.full(len(element), len(element)))]
                yield pa.RecordBatch.from_arrays(columns, names=["node", "element", "size"])

    elements = scratch.keep("elements", texts.select("node", "words").mapInArrow(cut, "node binary, element long, size long"))
    often = elements.groupBy("element").agg(F.count(F.lit(1)).alias("often")).filter("often > 1")
    shared = elements.join(often, "element").groupBy("node", "size").agg(F.array_sort(F.collect_list(F.struct("often", "element"))).alias("all"))
    shared = shared.select("node", "size", F.col("all.element").alias("shared"))
    share = threshold / (1 + threshold)

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        edges = _edges()
        for batch in batches:
            for node, size, held in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), strict=True):
                held = np.asarray(held.values)
                least = int(np.ceil(size * threshold - 1e-6))
                own, low, high = np.searchsorted(edges, [size, least, size / threshold + 1e-6], "right") - 1
                others = np.arange(low, high + 1)
                smallest = np.maximum(edges[others], least)
                length = size - np.ceil(share * (size + smallest) - 1e-6).astype("i8") + 1
                # Elements that no other node has come first in a prefix, and meet none.
                length = np.clip(length - (size - len(held)), 0, len(held))
                first = np.repeat(np.cumsum(length) - length, length)
                partner = np.repeat(others, length)
                pair = np.minimum(own, partner) << 32 | np.maximum(own, partner)
                n = len(pair)
                columns = [
                    pa.array(held[np.arange(n) - first]), pa.array(pair), pa.array([node] * n, pa.binary()), pa.array(np.full(n, own)),
                    pa.array(partner == own), pa.array(np.full(n, len(held) / size)),
                ]
                yield pa.RecordBatch.from_arrays(columns, names=["k1", "k2", "node", "class", "alike", "central"])

    return scratch.keep("prefixes", shared.mapInArrow(deal, "k1 long, k2 long, node binary, class long, alike boolean, central double"))


def _apart(pairs: DataFrame, comps: DataFrame) -> DataFrame:
    """Pairs of nodes that no links join yet."""
    left, right = comps.select(F.col("node").alias("a"), F.col("comp").alias("ca")), comps.select(F.col("node").alias("b"), F.col("comp").alias("cb"))
    held = pairs.join(left, "a", "left").join(right, "b", "left")
    return held.filter(F.coalesce("ca", "a") != F.coalesce("cb", "b")).select("a", "b")


def _mixed(active: DataFrame, comps: DataFrame) -> DataFrame:
    """Members of buckets whose nodes are not all in one component, with comp and the bucket's largest one."""
    side = ["k1", "k2"]
    held = active.join(comps, "node", "left").withColumn("comp", F.coalesce("comp", "node"))
    sizes = held.groupBy(*side, "comp").agg(F.count(F.lit(1)).alias("m"))
    several = sizes.groupBy(*side).agg(F.max(F.struct("m", "comp")).alias("top"), F.sum("m").alias("all")).filter("all > top.m")
    return held.join(several.select(*side, F.col("top.comp").alias("largest")), side).select(*side, "node", "class", "alike", "comp", "largest")


def drop_near_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with one row of each class, columns unchanged: that of the smallest doc_id.

    Rows are told apart by doc_id: where several share one, all of them but exact
    repetitions stay if one does. Null counts as a doc_id, larger than all others.
    """
    scratch = Scratch(docs.sparkSession, "near")
    gone = near_classes(docs, id_col, text_col).groupBy("doc_id").agg(F.max("kept").alias("any"), F.min("kept").alias("all")).filter("not all")
    gone, own = scratch.keep("gone", gone), fresh()
    left = docs.join(gone.filter("not any").select(F.col("doc_id").alias(own)), F.col(id_col).eqNullSafe(F.col(own)), "left_anti")
    if gone.filter("any").isEmpty():
        return left
    return left.dropDuplicates([id_col, text_col])
