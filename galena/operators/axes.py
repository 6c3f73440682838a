"""Cells of a table compared on several axes, each on the ids that its cells share.

A cell is an arm with a seed; there are few of them.  An id becomes one row: its cells'
values, and for each axis a bit for each cell that has a value.  Coverage floors, exclusions
and intersections over any group of cells are then bit operations on that row, and all groups
are summed in one pass; no set of ids is joined with another.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Cells whose bits one word holds.
WORD = 62


def folded(rows: DataFrame, id_col: str, cell: str, axes: Sequence[str], more: Sequence[str] = ()) -> DataFrame:
    """id, cells: array<struct<cell, axes, more>>, and has_<axis>: words of bits, of rows with a number ``cell`` from 0 and one row for each id and cell. A null is no value."""
    words = range(_words(rows.agg(F.max(cell)).first()[0]))
    bit = lambda axis, w: F.when(F.col(axis).isNotNull() & (F.floor(F.col(cell) / WORD) == w), F.call_function("shiftleft", F.lit(1).cast("long"), (F.col(cell) % WORD).cast("int")))
    masks = [F.array(*[F.coalesce(F.bit_or(bit(a, w)), F.lit(0).cast("long")) for w in words]).alias(f"has_{a}") for a in axes]
    return rows.groupBy(F.col(id_col).alias("id")).agg(F.collect_list(F.struct(F.col(cell).alias("cell"), *axes, *more)).alias("cells"), *masks)


def _words(most: int | None) -> int:
    return 1 if most is None else most // WORD + 1


def bits(cells: Sequence[int], words: int = 1) -> list[int]:
    """Words that hold the bits of some cells."""
    return [sum(1 << (c % WORD) for c in set(cells) if c // WORD == w) for w in range(words)]


def holds(mask: Column, cells: Sequence[int]) -> Column:
    """Whether all of ``cells`` have their bit."""
    out = F.lit(True)
    for w, word in enumerate(bits(cells, _words(max(cells, default=None)))):
        if word:
            out = out & (F.coalesce(F.get(mask, w), F.lit(0).cast("long")).bitwiseAND(F.lit(word)) == word)
    return out


def coverage(rows: DataFrame, cell: str, counts: Mapping[str, Column]) -> dict[int, dict[str, int]]:
    """How many of a cell's rows fulfil each condition: one pass, a row for each cell to the driver."""
    found = rows.groupBy(cell).agg(*[F.count_if(c).alias(k) for k, c in counts.items()])
    return {r[cell]: {k: r[k] for k in counts} for r in found.collect()}


def on_common(folds: DataFrame, groups: Mapping[str, Sequence[int]], sets: Mapping[str, Sequence[str]], values: Mapping[str, Sequence[str]], only: bool = True) -> DataFrame:
    """group, cell and, for each set, n_<set>, in_<set> and the means of its values.

    A set is some axes: an id belongs to a group's set if all cells of the group have all its
    axes. n is the number of such ids, in_<set> those where this cell has them too, and means are over
    these. With ``only`` a group has rows for its own cells, else for all.
    """
    named = F.array(*[F.struct(F.lit(g).alias("group"), F.array(*[F.lit(c) for c in cells]).alias("members"), *[_every(axes, cells).alias(f"is_{s}") for s, axes in sets.items()]) for g, cells in groups.items()])
    split = folds.select("cells", F.explode(named).alias("g")).filter(_any([F.col(f"g.is_{s}") for s in sets]))
    rows = split.select("g.*", F.explode("cells").alias("c"))
    if only:
        rows = rows.filter(F.array_contains("members", F.col("c.cell")))
    out = []
    for s, axes in sets.items():
        here = F.col(f"is_{s}")
        for a in axes:
            here = here & F.col(f"c.{a}").isNotNull()
        out += [F.count_if(here).alias(f"in_{s}"), *[F.avg(F.when(here, F.col(f"c.{v}"))).alias(v) for v in values[s]]]
    sums = rows.groupBy("group", F.col("c.cell").alias("cell")).agg(*out)
    sizes = split.groupBy("g.group").agg(*[F.count_if(F.col(f"g.is_{s}")).alias(f"n_{s}") for s in sets])
    return sums.join(F.broadcast(sizes), "group")  # a row for each group


def every(cells: Sequence[int], among: Column, values: Sequence[Column]) -> Column:
    """Whether an id belongs to what ``cells`` share: it is ``among`` the ids of the axes, and all their values are there. Without cells every id does."""
    out = F.lit(True)
    for there in [among, *[v.isNotNull() for v in values]] if cells else []:
        out = out & there
    return F.coalesce(out, F.lit(False))


def on_sets(rows: DataFrame, cell: str, sets: Mapping[str, Sequence[str]], values: Mapping[str, Sequence[str]]) -> DataFrame:
    """cell and, for each set, n_<set>, in_<set> and the means of its values: ``on_common`` of rows that know which sets (is_<set>) their id belongs to.

    Every id has a row for every cell, so that a cell's rows count the ids; all sets are summed in one pass.
    """
    out = []
    for s, axes in sets.items():
        here = F.col(f"is_{s}")
        out.append(F.count_if(here).alias(f"n_{s}"))
        for a in axes:
            here = here & F.col(a).isNotNull()
        out += [F.count_if(here).alias(f"in_{s}"), *[F.avg(F.when(here, F.col(v))).alias(v) for v in values[s]]]
    return rows.groupBy(cell).agg(*out)


def _every(axes: Sequence[str], cells: Sequence[int]) -> Column:
    out = F.lit(True)
    for a in axes:
        out = out & holds(F.col(f"has_{a}"), cells)
    return out


def _any(conditions: Sequence[Column]) -> Column:
    out = F.lit(False)
    for c in conditions:
        out = out | c
    return out
