"""Audit of how filters interact: what each removes at each place of each order.

Every row becomes a mask of the filters that it fails.  Masks of the filters that
look at one text come from the text alone; whether the text is identical to one of
a smaller id is found by fingerprint: rows are routed by the xxhash of their text,
and where they meet a chain holds each full text of that hash with its least id, so
a hash collision costs a comparison and never an error.

A map task keeps the rows with the least id of each text (in blocks of bounded
size) and sends no text for the others: those fail already.  So a text that a third
of all rows hold sends one copy from each block.  Where they meet, rows are sorted by
hash, so a task holds the texts of one hash only.

Masks are then counted: ``combineByKey`` merges vectors of counts by mask, 32 masks
by (rows, good, toxic), one vector a part.  All orders and steps follow from a
part's vector.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import permutations

import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from galena.llm.scratch import fresh

FILTERS = "ABCDE"
#: Bits of the masks, by filter.
BIT = {name: 1 << i for i, name in enumerate(FILTERS)}
MIN_WORDS = 50
#: Least percentage of distinct words, most percentage of capital letters.
DISTINCT, CAPITALS = 65, 5
#: Bytes of distinct texts that a map task holds at once.
BLOCK_BYTES = 32 << 20
#: Bytes of texts for a task of the shuffle, which is an RDD's: nothing resizes its partitions later.
TASK_BYTES = 64 << 20

_NOT_CAPITAL = bytes(b for b in range(256) if not 65 <= b <= 90)
_INSIDE = bytes(range(0x80, 0xC0))
_MARKS = b"#$%&*|"
_NO_MARK = bytes(b for b in range(256) if b not in _MARKS)
_VECTOR = 3 << len(FILTERS)


def text_mask(text: bytes) -> int:
    """Bits of the filters A to D that a text in UTF-8 fails.

    A: under 50 words (runs without white space); B: under 65 % of them distinct;
    C: over 5 % of the code points are capitals A-Z; D: one of #$%&*| is there.
    """
    words = text.split()  # of bytes: space and tab to carriage return
    mask = BIT["A"] * (len(words) < MIN_WORDS) + BIT["B"] * (100 * len(set(words)) < DISTINCT * len(words))
    mask += BIT["C"] * (100 * len(text.translate(None, _NOT_CAPITAL)) > CAPITALS * len(text.translate(None, _INSIDE)))
    return mask + BIT["D"] * bool(text.translate(None, _NO_MARK))


def _hash(text: bytes, bits: int) -> int:
    return xxhash.xxh3_64_intdigest(text) & ((1 << bits) - 1)


def _routed(bits: int, block_bytes: int):
    """(hash, id), (id, parts, mask, text): text is None where rows need no comparison, as their text has a smaller id in their own block already."""

    def run(rows: Iterator) -> Iterator:
        held: dict[bytes, list] = {}
        size = unnamed = 0
        for doc_id, part, raw in rows:
            text = bytes(raw)
            mask = text_mask(text)
            if doc_id is None:  # neither smaller nor larger than another id
                unnamed += 1
                yield (xxhash.xxh3_64_intdigest(str(unnamed)), None), (None, [part], mask, None)
                continue
            best = held.get(text)
            if best is None:
                held[text] = [doc_id, mask, [part]]
                size += len(text) + 200
            elif doc_id == best[0]:
                best[2].append(part)
                size += 8
            else:
                lost, parts = (best[0], best[2]) if doc_id < best[0] else (doc_id, [part])
                if doc_id < best[0]:
                    best[0], best[2] = doc_id, [part]
                yield (xxhash.xxh3_64_intdigest(repr(lost)), lost), (lost, parts, mask | BIT["E"], None)
            if size >= block_bytes:
                yield from _sent(held, bits)
                held, size = {}, 0
        yield from _sent(held, bits)

    return run


def _sent(held: dict[bytes, list], bits: int) -> Iterator:
    for text, (doc_id, mask, parts) in held.items():
        yield (_hash(text, bits), doc_id), (doc_id, parts, mask, text)


def _chained(rows: Iterator) -> Iterator:
    """(id, part, mask) of every row: rows come by hash and id, so the first of a text has its least id."""
    now, chain = None, []
    for (h, _), (doc_id, parts, mask, text) in rows:
        if text is not None:
            if h != now:
                now, chain = h, []
            least = next((i for t, i in chain if t == text), None)
            if least is None:
                chain.append((text, doc_id))
            elif doc_id > least:
                mask |= BIT["E"]
        for part in parts:
            yield doc_id, part, mask


def _add(vector: list[int], row: tuple[int, int, int]) -> list[int]:
    mask, good, toxic = row
    vector[3 * mask] += 1
    vector[3 * mask + 1] += good
    vector[3 * mask + 2] += toxic
    return vector


def _merge(a: list[int], b: list[int]) -> list[int]:
    for i, x in enumerate(b):
        a[i] += x
    return a


def orders_of(vector: list[int]) -> Iterator[tuple]:
    """filter_order, step, filter, kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley of a vector of counts by mask."""
    masks = [m for m in range(1 << len(FILTERS)) if vector[3 * m]]
    steps = {}
    for order in permutations(FILTERS):
        before = 0
        for step, name in enumerate(order, 1):
            bit, upto = BIT[name], before | BIT[name]
            gone = [m for m in masks if m & bit and not m & before]
            steps["".join(order), step] = (
                name, sum(vector[3 * m] for m in masks if not m & upto), *(sum(vector[3 * m + i] for m in gone) for i in range(3)),
                sum(vector[3 * m] for m in masks if m & bit and m & before), vector[3 * bit],
            )
            before = upto
    shapley = dict.fromkeys(FILTERS, 0)
    for name, _, removed, *_ in steps.values():
        shapley[name] += removed
    for (order, step), (name, kept, removed, good, toxic, redundant, unique) in steps.items():
        yield order, step, name, kept, removed, redundant, unique, good, toxic, shapley[name]


def _bytes(docs: DataFrame, text_col: str) -> int:
    return docs.agg(F.sum(F.octet_length(F.col(text_col).cast("string")))).first()[0] or 0


def masks(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", part_col: str = "source", hash_bits: int = 64, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """doc_id, part, mask: the filters that each row of ``docs`` fails, as bits (A 1, B 2, C 4, D 8, E 16).

    ``hash_bits`` narrows the hash that routes texts and ``block_bytes`` what a map
    task holds; results depend on neither.  E is for a text that a row of a smaller
    id has: rows that agree in id and text don't fail by each other, and a null id is
    neither smaller nor larger than another.  A null text counts as empty, a null
    part as the empty string.
    """
    spark = docs.sparkSession
    kind = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(F.col(id_col), F.coalesce(F.col(part_col).cast("string"), F.lit("")), F.coalesce(F.col(text_col).cast("string"), F.lit("")).cast("binary"))
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-_bytes(docs, text_col) // TASK_BYTES))
    routed = rows.rdd.mapPartitions(_routed(hash_bits, block_bytes))
    met = routed.repartitionAndSortWithinPartitions(tasks, lambda key: key[0], keyfunc=lambda key: (key[0], key[1] is not None, key[1]))
    return spark.createDataFrame(met.mapPartitions(_chained), f"doc_id {kind}, part string, mask int", verifySchema=False)


def interactions(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", part_col: str = "source", hash_bits: int = 64) -> DataFrame:
    """part, filter_order, step, filter, kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley: 600 rows a part.

    ``labels`` (doc_id, quality, toxic): a document is good or toxic if one of its
    label rows says 1; without labels, or with a null id, it is neither.  Repeated rows
    of ``docs`` count as often as they are there.  A table without rows has no
    parts and gives no rows.  Edge cases of rows as in ``masks``; other columns aren't
    looked at.
    """
    spark = docs.sparkSession
    of, spread = fresh(), F.concat(F.lit("null "), F.pmod(F.monotonically_increasing_id(), F.lit(997)).cast("string"))
    key = F.concat(F.lit("="), F.col("doc_id").cast("string"))
    known = labels.filter(F.col("doc_id").isNotNull()).groupBy(key.alias(of)).agg(F.max(F.expr("cast(quality <=> 1 as int)")).alias("good"), F.max(F.expr("cast(toxic <=> 1 as int)")).alias("bad"))
    rows = masks(docs, id_col, text_col, part_col, hash_bits).withColumn("key", F.coalesce(key, spread))  # null ids meet no label, and not each other
    all_rows = rows.join(known, F.col("key") == F.col(of), "left").select("part", "mask", F.coalesce("good", F.lit(0)), F.coalesce("bad", F.lit(0)))
    keyed = all_rows.rdd.map(lambda r: (r[0], (r[1], r[2], r[3])))
    vectors = keyed.combineByKey(lambda row: _add([0] * _VECTOR, row), _add, _merge, int(spark.conf.get("spark.sql.shuffle.partitions")))
    counts = ", ".join(f"{c} long" for c in ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley"))
    return spark.createDataFrame(vectors.flatMap(lambda kv: [(kv[0], *x) for x in orders_of(kv[1])]), f"part string, filter_order string, step int, filter string, {counts}", verifySchema=False)
