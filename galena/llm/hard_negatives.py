"""Hard negatives of anchors by a pivot table.

A row's vector x is augmented by one coordinate, sqrt(M^2 - |x|^2) with M the largest
norm, and an anchor's q by 0.  Then |q' - x'|^2 = |q|^2 + M^2 - 2 q.x, so a bound of the
distance is a bound of the inner product.  The pivot table stores every row's distances to
a few pivots; by the triangle inequality |d(q,p) - d(x,p)| <= d(q,x) <= d(q,p) + d(x,p),
which brackets the score of an anchor and a row.  Only rows whose bracket reaches what is
asked for are multiplied out, in exact integers.

Rows are ordered by their nearest pivot and the distance to it and packed into blocks, so
that the least and greatest distances of a block rule out whole blocks first.  Anchors
are packed as well, and groups of anchor blocks of bounded size are broadcast to all row
blocks: the stated query set against all rows.  A task keeps for each anchor only its best
rows so far; they are merged by one window each.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from galena.llm.caches import claim
from galena.llm.scratch import Scratch

POSITIVES = NEGATIVES = 5
#: A negative's score is at least so many percent of the positive's.
LEAST_PERCENT = 80
#: Pivots, and rows of the bounded sample (smallest hashes) that they are chosen from: each is the row farthest from those before it.
PIVOTS, SAMPLE_ROWS = 8, 2048
#: Rows of a block, anchors of a block, and anchor blocks that are broadcast together: at most 65,536 anchors.
ROWS, ANCHORS, GROUP = 2048, 256, 256
#: Scores up to here are exact in double precision, partial sums included.
_EXACT = float(1 << 53)

_PACKED = "block long, n int, lo array<double>, hi array<double>, data binary"
_FOUND = "anchor long, anchor_id {0}, positive long, positive_id {0}, positive_score long, row long, vec_id {0}, score long"


def participants(rows: DataFrame, id_col: str, label_col: str, vector_col: str) -> DataFrame:
    """row, vec_id, label, v (integers), n2 of the rows that take part; labels as they count here."""
    v = F.col(vector_col)
    whole = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    kept = rows.filter(F.col(label_col).isNotNull() & v.isNotNull()).filter(whole)
    label = F.col(label_col).cast("long")
    moved = F.when(F.col(id_col).cast("long") % 7 == 0, (label + 1) % 10).otherwise(label)
    kept = kept.select(F.monotonically_increasing_id().alias("row"), F.col(id_col).alias("vec_id"), moved.alias("label"), F.transform(v, lambda x: F.floor(x.cast("double") * 256)).alias("v"))
    n2 = F.aggregate("v", F.lit(0.0), lambda acc, x: acc + x.cast("double") * x.cast("double"))
    checked = F.when(n2 < _EXACT, n2).otherwise(F.raise_error(F.lit("a vector's integer norm is beyond exact scores")))
    return kept.withColumn("n2", checked)


def _matrix(lists: pa.Array, width: int) -> np.ndarray:
    """Rows of float64; shorter vectors are padded with zeros."""
    sizes = np.diff(lists.offsets.to_numpy())
    out = np.zeros((len(sizes), width))
    out[np.repeat(np.arange(len(sizes)), sizes), np.arange(sizes.sum()) - np.repeat(np.cumsum(sizes) - sizes, sizes)] = lists.flatten().to_numpy(zero_copy_only=False)
    return out


def _distances(x: np.ndarray, pivots: np.ndarray, m2: float, query: bool = False) -> np.ndarray:
    """Of augmented rows, or of queries, to augmented pivots."""
    rest = lambda v: np.sqrt(np.maximum(m2 - (v * v).sum(1), 0))
    own = (x * x).sum(1)[:, None] + m2 if query else 2 * m2 - 2 * np.outer(rest(x), rest(pivots))
    return np.sqrt(np.maximum(own - 2 * (x @ pivots.T), 0))


def choose_pivots(rows: DataFrame, m2: float, width: int, n: int = PIVOTS, sample: int = SAMPLE_ROWS) -> np.ndarray:
    """Rows of a sample of bounded size, each the farthest from those chosen before."""
    taken = rows.select("v", F.xxhash64("vec_id", "v").alias("h")).orderBy("h", "v").limit(sample).select("v").collect()
    x = np.zeros((len(taken), width))
    for i, r in enumerate(taken):
        x[i, : len(r[0])] = r[0]
    chosen = [0]
    near = _distances(x, x[:1], m2)[:, 0]
    while len(chosen) < min(n, len(x)):
        chosen.append(int(near.argmax()))
        near = np.minimum(near, _distances(x, x[chosen[-1:]], m2)[:, 0])
    return x[chosen]


def pivot_table(rows: DataFrame, pivots: np.ndarray, m2: float) -> DataFrame:
    """``rows`` with d: their distances to the pivots, near: the nearest pivot, and its distance."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        claim("pivots")
        for b in batches:
            d = _distances(_matrix(b["v"], pivots.shape[1]), pivots, m2)
            near = d.argmin(1).astype("i4")
            lists = pa.ListArray.from_arrays(np.arange(len(d) + 1, dtype="i4") * d.shape[1], d.ravel())
            yield pa.RecordBatch.from_arrays([*b.columns, lists, pa.array(near), pa.array(d[np.arange(len(d)), near])], schema=pa.schema([*b.schema, ("d", lists.type), ("near", pa.int32()), ("near_d", pa.float64())]))

    names = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.schema)
    return rows.mapInArrow(run, f"{names}, d array<double>, near int, near_d double")


def _packed(rows: DataFrame, size: int, width: int) -> DataFrame:
    """Blocks of up to ``size`` rows, as an Arrow table with vectors of one width; lo and hi: least and greatest distance to each pivot."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        claim("pivots")
        held: list[pa.RecordBatch] = []
        for b in batches:
            for start in range(0, b.num_rows, size):
                held.append(b.slice(start, size))
                if sum(x.num_rows for x in held) >= size:
                    whole = pa.Table.from_batches(held).combine_chunks()
                    yield _block(whole.slice(0, size))
                    held = whole.slice(size).to_batches()
        if held and sum(x.num_rows for x in held):
            yield _block(pa.Table.from_batches(held))

    def _block(t: pa.Table) -> pa.RecordBatch:
        sink = pa.BufferOutputStream()
        with pa.ipc.new_stream(sink, t.schema) as out:
            out.write_table(t.combine_chunks())
        d = np.asarray(t["d"].combine_chunks().flatten()).reshape(t.num_rows, -1)
        return pa.RecordBatch.from_pydict({"block": [t["row"][0].as_py()], "n": pa.array([t.num_rows], pa.int32()), "lo": [d.min(0).tolist()], "hi": [d.max(0).tolist()], "data": [sink.getvalue().to_pybytes()]})

    return rows.mapInArrow(run, _PACKED)


def _unpacked(data: bytes, width: int) -> tuple[pa.Table, np.ndarray]:
    t = pa.ipc.open_stream(data).read_all().combine_chunks()
    return t, _matrix(t["v"].chunk(0), width)


def _order(ids: list, rows: np.ndarray) -> np.ndarray:
    """Places in the order of ids, null last, then of rows."""
    order = sorted(range(len(ids)), key=lambda i: (ids[i] is None, 0 if ids[i] is None else ids[i], rows[i]))
    place = np.empty(len(ids), "i8")
    place[order] = np.arange(len(ids))
    return place


class _Search:
    """One group of anchors against the row blocks that a task meets; keeps each wish's best rows."""

    def __init__(self, data: list[bytes], width: int, pivots: np.ndarray, m2: float, negatives: bool, most: int):
        self.parts = []
        self.negatives, self.most, self.m2, self.width = negatives, most, m2, width
        for raw in data:
            t, q = _unpacked(raw, width)
            wishes = t["wishes"].to_pylist() if negatives else [[None]] * t.num_rows
            self.parts.append((t["row"].to_pylist(), t["vec_id"].to_pylist(), t["label"].to_numpy(), q, (q * q).sum(1), _distances(q, pivots, m2, True), [[(w, []) for w in ws] for ws in wishes]))

    def _range(self, kept: list) -> tuple[float, float]:
        """Least and greatest score that can still matter to an anchor."""
        low, high = np.inf, -np.inf
        for w, best in kept:
            floor = -np.inf if len(best) < self.most else -best[-1][0]
            low = min(low, floor if w is None else max(floor, LEAST_PERCENT * w["score"] / 100))
            high = max(high, np.inf if w is None else w["score"])
        return low, high

    def meet(self, lo: np.ndarray, hi: np.ndarray, data: bytes) -> None:
        t = None
        slack = 1 + 1e-9 * self.m2
        for rows, _, labels, q, n2, dq, kept in self.parts:
            want = np.array([self._range(k) for k in kept]).reshape(-1, 2)
            # Of a whole block: the distances that its least and greatest allow.
            near = np.maximum(np.maximum(lo - dq, dq - hi), 0).max(1)
            far = (dq + hi).min(1)
            top, bottom = (n2 + self.m2 - near**2) / 2 + slack, (n2 + self.m2 - far**2) / 2 - slack
            live = np.flatnonzero((top >= want[:, 0]) & (bottom <= want[:, 1]))
            if not len(live):
                continue
            if t is None:
                t, x = _unpacked(data, self.width)
                d = np.asarray(t["d"].chunk(0).flatten()).reshape(len(x), -1)
                own, label, ids = t["row"].to_numpy(), t["label"].to_numpy(), t["vec_id"].to_pylist()
                place = _order(ids, own)
            # Of each row: a pivot at a time, while anything is ruled out.
            near, far = np.zeros((len(live), len(x))), np.full((len(live), len(x)), np.inf)
            for j in range(d.shape[1]):
                np.maximum(near, np.abs(dq[live, j, None] - d[None, :, j]), out=near)
                np.minimum(far, dq[live, j, None] + d[None, :, j], out=far)
            base = (n2[live] + self.m2)[:, None]
            open_ = ((base - near**2) / 2 + slack >= want[live, 0, None]) & ((base - far**2) / 2 - slack <= want[live, 1, None])
            open_ &= (labels[live, None] != label[None, :]) if self.negatives else (labels[live, None] == label[None, :])
            a, b = open_.any(1), np.flatnonzero(open_.any(0))
            live, open_ = live[a], open_[a][:, b]
            scores = q[live] @ x[b].T  # whole numbers below 2^53
            for i, at in enumerate(live):
                hit = b[open_[i]]
                s = scores[i, open_[i]]
                if not self.negatives:
                    other = own[hit] != rows[at]
                    hit, s = hit[other], s[other]
                for w, best in kept[at]:
                    low = -np.inf if len(best) < self.most else -best[-1][0]
                    fits = s >= low if w is None else (s >= low) & (100 * s >= LEAST_PERCENT * w["score"]) & (s <= w["score"])
                    if not fits.any():
                        continue
                    some, ss = hit[fits], s[fits]
                    some = some[np.lexsort((place[some], -ss))][: self.most]
                    score_of = dict(zip(hit[fits].tolist(), ss.tolist(), strict=True))
                    best += [(-score_of[r], ids[r] is None, ids[r], int(own[r])) for r in some.tolist()]
                    best.sort(key=lambda c: (c[0], c[1], 0 if c[1] else c[2], c[3]))
                    del best[self.most :]

    def rows(self) -> Iterator[tuple]:
        for rows, ids, *_, kept in self.parts:
            for row, vec_id, wishes in zip(rows, ids, kept, strict=True):
                for w, best in wishes:
                    w = w or {"row": None, "vec_id": None, "score": None}
                    for less, _, found_id, found in best:
                        yield row, vec_id, w["row"], w["vec_id"], w["score"], found, found_id, int(-less)


def _found(blocks: DataFrame, anchors: DataFrame, kind: str, width: int, pivots: np.ndarray, m2: float, negatives: bool, most: int, scratch: Scratch, name: str) -> DataFrame:
    """Each anchor's (or anchor's and positive's) best rows, from every task that read blocks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        claim("pivots")
        search = None
        for batch in batches:
            for r in range(batch.num_rows):
                if search is None:  # the same anchors in every row
                    search = _Search(batch["anchors"][r].as_py(), width, pivots, m2, negatives, most)
                search.meet(np.array(batch["lo"][r].as_py()), np.array(batch["hi"][r].as_py()), batch["data"][r].as_py())
        out = list(search.rows()) if search else []
        for at in range(0, len(out), 65536):
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out[at : at + 65536], strict=True), schema, strict=True)], schema=schema)

    packed = scratch.keep(f"{name}_anchors", _packed(anchors, ANCHORS, width))
    order = packed.select("block").orderBy("block").collect()  # a number for each block of anchors
    ids = pa.string() if kind == "string" else pa.int64() if kind == "bigint" else pa.int32()
    schema = pa.schema([("anchor", pa.int64()), ("anchor_id", ids), ("positive", pa.int64()), ("positive_id", ids), ("positive_score", pa.int64()), ("row", pa.int64()), ("vec_id", ids), ("score", pa.int64())])
    parts = []
    for i in range(0, max(len(order), 1), GROUP):
        some = [r[0] for r in order[i : i + GROUP]]
        group = packed.filter(F.col("block").isin(some)).agg(F.collect_list("data").alias("anchors"))  # at most GROUP blocks: one bounded row
        met = blocks.select("lo", "hi", "data").crossJoin(F.broadcast(group)).mapInArrow(run, _FOUND.format(kind))
        parts.append(scratch.keep(f"{name}{i // GROUP}", met))
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def hard_negatives(rows: DataFrame, is_anchor: Column, id_col: str = "vec_id", label_col: str = "label", vector_col: str = "embedding", positives: int = POSITIVES, negatives: int = NEGATIVES) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score: for each anchor and positive its first negatives.

    Rows with a null label, a null vector or a component that is null or not finite take no
    part.  Components count as floor(256 x), scores are integer inner products, a higher score
    comes first, then the smaller id (null last).  Where an id is divisible by 7 the label is
    the next one of ten.  ``is_anchor`` is a condition on vec_id.  Positives are the first
    other rows of the anchor's label, negatives the first rows of other labels with a score of 80
    to 100 % of the positive's; so a negative positive score has none, and 0 only 0.

    Repeated rows are rows by themselves: each can be the other's positive, and an anchor that is
    there twice has its rows twice.  Shorter vectors count as padded with zeros; an
    empty vector's scores are 0.  Vectors whose squared integer norm is 2^53 or more are an error.
    An empty table, or one without anchors, gives no rows.  Other columns aren't looked at.
    ids are integers or strings of integers.
    """
    spark = rows.sparkSession
    scratch = Scratch(spark, "negatives")
    kind = rows.schema[id_col].dataType.simpleString()
    held = scratch.keep("vectors", participants(rows, id_col, label_col, vector_col))
    top = held.agg(F.max("n2"), F.max(F.size("v"))).first()
    m2, width = float(top[0] or 0), int(top[1] or 0)
    pivots = choose_pivots(held, m2, width) if top[0] is not None else np.zeros((0, width))
    out = "anchor_id {0}, positive_id {0}, rank int, negative_id {0}, positive_score long, negative_score long".format(kind)
    if not len(pivots):
        return spark.createDataFrame([], out)
    table = scratch.keep("pivots", pivot_table(held, pivots, m2))
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    near = table.repartitionByRange(parts, "near", "near_d", "row").sortWithinPartitions("near", "near_d", "row")
    blocks = scratch.keep("blocks", _packed(near.drop("n2", "near", "near_d"), ROWS, width))
    anchors = scratch.keep("anchors", table.filter(is_anchor).select("row", "vec_id", "label", "v", "d"))

    first = lambda df, by, n: df.withColumn("rank", F.row_number().over(Window.partitionBy(*by).orderBy(F.desc("score"), F.col("vec_id").asc_nulls_last(), "row"))).filter(F.col("rank") <= n)
    found = _found(blocks, anchors, kind, width, pivots, m2, False, positives, scratch, "positives")
    best = first(found, ["anchor"], positives).groupBy("anchor").agg(F.collect_list(F.struct("row", "vec_id", "score")).alias("wishes"))
    wished = scratch.keep("wished", anchors.join(best, F.col("row") == F.col("anchor")).drop("anchor"))
    found = _found(blocks, wished, kind, width, pivots, m2, True, negatives, scratch, "negatives")
    scratch.drop("vectors", "pivots", "anchors", "wished", "blocks")
    return first(found, ["anchor", "positive"], negatives).select("anchor_id", "positive_id", "rank", F.col("vec_id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score"))
