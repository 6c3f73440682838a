"""Percentile intervals from one resampling that all cells and metrics share.

How often an id is drawn depends on the seed, the draw and the id alone: a Poisson
number of mean 1, read from a digest.  So one pass over the rows gives the interval of
every cell, metric and difference; a difference of two arms is resampled in pairs
without joining anything, a recomputed task draws the same, and SQL can say it.
Sums combine before they are shuffled, so a cell's size is no task's size.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from galena.operators.resampling import PER_DIGEST, STEPS, summed


class Convention(NamedTuple):
    """How many draws, their seed, and the 0-based places of the bounds among the sorted draws."""

    draws: int
    seed: int
    low: int
    high: int


#: Conventions of reports (fixed values); the audit's upper bound is one place lower than the others'.
CONVENTIONS = {
    "tables": Convention(1000, 0, 25, 975),
    "ranks": Convention(1000, 0, 25, 975),
    "ghost": Convention(2000, 67, 50, 1950),
    "coverage": Convention(2000, 67, 50, 1950),
    "audit": Convention(2000, 0, 50, 1949),
    "official": Convention(5000, 67, 125, 4875),
}

def spread(rows: DataFrame) -> DataFrame:
    """``rows`` dealt evenly: a row is worth as much work as there are draws, so a small table has many tasks, too."""
    spark = rows.sparkSession
    return rows.repartition(max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism))


def draws(rows: DataFrame, by: Sequence[str], id_col: str, metrics: Mapping[str, tuple[Column, Column]], convention: Convention, dealt: bool = False) -> DataFrame:
    """by, n, and for each metric its value and <metric>_draws: the value of each draw in turn, null where it takes nothing.

    An id's digests are made once for those of its rows that stand together. With ``dealt`` rows stay in their
    partitions, for callers that have spread ids before they made several rows of each.
    """
    blocks, both = _blocks(convention), [(num, den, num.isNotNull() & den.isNotNull()) for num, den in metrics.values()]
    held = [F.coalesce(F.when(there, c).cast("double"), F.lit(0.0)).alias(f"_{part}{i}") for i, (num, den, there) in enumerate(both) for part, c in (("num", num), ("den", den))]
    narrow = rows.select(*by, F.coalesce(F.col(id_col).cast("string"), F.lit("")).alias("_id"), *held)
    parts = [f"_{part}{j}" for part in ("a", "b") for j in range(PER_DIGEST)]
    schema = T.StructType([*(narrow.schema[k] for k in by), T.StructField("_metric", T.IntegerType()), T.StructField("_block", T.IntegerType()), T.StructField("_n", T.LongType()), *(T.StructField(p, T.DoubleType()) for p in parts)])
    found = (narrow if dealt else spread(narrow)).mapInArrow(summed(convention.seed, blocks, len(by), to_arrow_schema(schema)), schema)
    sums = found.groupBy(*by, "_metric", "_block").agg(F.sum("_n").alias("_n"), *[F.sum(p).alias(p) for p in parts])
    values = F.array(*[F.when(F.col(f"_b{j}") != 0, F.col(f"_a{j}") / F.col(f"_b{j}")) for j in range(PER_DIGEST)])
    shown = F.sort_array(F.collect_list(F.struct("_metric", "_block", "_n", values.alias("_v")))).alias("_all")
    sums = sums.groupBy(*by).agg(shown) if by else sums.agg(shown).filter(F.size("_all") > 0)
    out = [F.col("_all")[0]["_n"].alias("n")]
    for i, name in enumerate(metrics):
        at = i * (blocks + 1)
        drawn = F.slice(F.flatten(F.slice("_all", at + 2, blocks)["_v"]), 1, convention.draws)
        out += [F.col("_all")[at]["_v"][0].alias(name), drawn.alias(f"{name}_draws")]
    return sums.select(*by, *out)


def _blocks(convention: Convention) -> int:
    return -(-convention.draws // PER_DIGEST)


def _bounds(ordered: Column, convention: Convention) -> tuple[Column, Column]:
    """Of the sorted draws that took something: the places keep their share."""
    at = lambda place: F.get(ordered, F.floor(F.size(ordered) * place / convention.draws).cast("int"))
    return at(convention.low), at(convention.high)


def _sorted(drawn: Column) -> Column:
    return F.sort_array(F.filter(drawn, lambda v: v.isNotNull()))


def intervals(rows: DataFrame, by: Sequence[str], id_col: str, metrics: Mapping[str, tuple[Column, Column]], convention: Convention, dealt: bool = False) -> DataFrame:
    """by, n and for each metric its value, <metric>_lo and <metric>_hi.

    A metric is a sum over another, (num, den): a mean has den 1.  A row counts for it where
    both are there; all rows of an id are drawn together.  n is the number of rows.  Draws
    that take nothing are left out, and bounds keep their share of the others.
    """
    found = draws(rows, by, id_col, metrics, convention, dealt)
    return _bounded(found, by, metrics, convention)


def _bounded(found: DataFrame, by: Sequence[str], metrics: Sequence[str], convention: Convention) -> DataFrame:
    found = found.withColumns({f"{m}_draws": _sorted(F.slice(f"{m}_draws", 1, convention.draws)) for m in metrics})
    out = []
    for m in metrics:
        low, high = _bounds(F.col(f"{m}_draws"), convention)
        out += [F.col(m), low.alias(f"{m}_lo"), high.alias(f"{m}_hi")]
    return found.select(*by, "n", *out)


def by_convention(rows: DataFrame, by: Sequence[str], id_col: str, metrics: Mapping[str, tuple[Column, Column]], conventions: Mapping[str, Convention]) -> DataFrame:
    """``intervals`` of several conventions, named in a column ``convention``: those of one seed take the first of the same draws."""
    out = None
    for seed in sorted({c.seed for c in conventions.values()}):
        own = {name: c for name, c in conventions.items() if c.seed == seed}
        found, each = draws(rows, by, id_col, metrics, max(own.values(), key=lambda c: c.draws)), []
        for name, c in own.items():
            bounds = {m: _bounds(_sorted(F.slice(f"{m}_draws", 1, c.draws)), c) for m in metrics}
            each.append(F.struct(F.lit(name).alias("convention"), *[x for m, (low, high) in bounds.items() for x in (F.col(m).alias(m), low.alias(f"{m}_lo"), high.alias(f"{m}_hi"))]))
        one = found.select(*by, "n", F.inline(F.array(*each))).select("convention", *by, "n", *[f"{m}{end}" for m in metrics for end in ("", "_lo", "_hi")])
        out = one if out is None else out.unionByName(one)
    return out


def independent(rows: DataFrame, by: Sequence[str], id_col: str, left: Column, right: Column, convention: Convention) -> DataFrame:
    """by, n, delta, lo, hi: the mean of right - left over rows that have both, with an interval from draws of either side by itself.

    The point is paired, the interval is that of two independent samples: the right side's draws have the next seed.
    """
    both = rows.filter(left.isNotNull() & right.isNotNull())
    one = F.lit(1)
    a = draws(both, by, id_col, {"l": (left, one)}, convention)
    b = draws(both, by, id_col, {"r": (right, one)}, convention._replace(seed=convention.seed + 1)).drop("n")
    b = b.select(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(by)], "r", "r_draws")
    same = F.lit(True)
    for i, k in enumerate(by):
        same = same & F.col(k).eqNullSafe(F.col(f"_k{i}"))
    met = a.join(b, same) if by else a.crossJoin(F.broadcast(b))  # one row without groups
    met = met.withColumn("_d", _sorted(F.zip_with("l_draws", "r_draws", lambda x, y: y - x)))
    low, high = _bounds(F.col("_d"), convention)
    return met.select(*by, "n", (F.col("r") - F.col("l")).alias("delta"), low.alias("lo"), high.alias("hi"))


def draws_sql(rows: str, by: Sequence[str], id_col: str, metrics: Mapping[str, tuple[str, str]], convention: Convention) -> str:
    """``draws`` as SQL: a SELECT over the table or expression named ``rows``; metrics are SQL expressions."""
    keys = "".join(f"{k}, " for k in by)
    group = f"GROUP BY {', '.join(by)}" if by else ""
    step = lambda j: "CASE " + " ".join(f"WHEN substr(h, {2 * j + 1}, 2) < '{s:02x}' THEN {n}" for n, s in enumerate(STEPS)) + f" ELSE {len(STEPS)} END"
    sums = ", ".join(f"[{', '.join(f'sum(w{j} * num{i}) / nullif(sum(w{j} * den{i}), 0)' for j in range(PER_DIGEST))}] AS m{i}" for i in range(len(metrics)))
    held = ", ".join(f"CASE WHEN ({n}) IS NOT NULL AND ({d}) IS NOT NULL THEN {n} END AS num{i}, CASE WHEN ({n}) IS NOT NULL AND ({d}) IS NOT NULL THEN {d} END AS den{i}" for i, (n, d) in enumerate(metrics.values()))
    cells = ", ".join(f"num{i}, den{i}" for i in range(len(metrics)))
    values = ", ".join(f"sum(num{i}) / nullif(sum(den{i}), 0) AS {m}" for i, m in enumerate(metrics))
    drawn = ", ".join(f"flatten(list(m{i} ORDER BY block))[1:{convention.draws}] AS {m}_draws" for i, m in enumerate(metrics))
    joined = f"JOIN _d USING ({', '.join(by)})" if by else ", _d"
    return f"""(WITH _r AS (SELECT {keys}CAST({id_col} AS VARCHAR) AS _id, {held} FROM {rows}),
      _h AS (SELECT {keys}block, {cells}, md5('{convention.seed}:' || block || ':' || _id) AS h FROM _r, range({_blocks(convention)}) AS _b(block)),
      _w AS (SELECT {keys}block, {cells}, {', '.join(f'{step(j)} AS w{j}' for j in range(PER_DIGEST))} FROM _h),
      _m AS (SELECT {keys}block, {sums} FROM _w GROUP BY {keys}block), _d AS (SELECT {keys}{drawn} FROM _m {group}),
      _v AS (SELECT {keys}count(*) AS n, {values} FROM _r {group})
      SELECT {keys}n, {', '.join(f'{m}, {m}_draws' for m in metrics)} FROM _v {joined})"""


def _sorted_sql(drawn: str) -> str:
    return f"list_sort(list_filter({drawn}, lambda x: x IS NOT NULL))"


def _at_sql(ordered: str, place: int, convention: Convention) -> str:
    return f"{ordered}[CAST(floor(len({ordered}) * {place} / {convention.draws}) AS BIGINT) + 1]"


def intervals_sql(rows: str, by: Sequence[str], id_col: str, metrics: Mapping[str, tuple[str, str]], convention: Convention) -> str:
    """``intervals`` as SQL."""
    keys = "".join(f"{k}, " for k in by)
    out = ", ".join(f"{m}, {_at_sql(f'd{i}', convention.low, convention)} AS {m}_lo, {_at_sql(f'd{i}', convention.high, convention)} AS {m}_hi" for i, m in enumerate(metrics))
    ordered = ", ".join(f"{m}, {_sorted_sql(f'{m}_draws')} AS d{i}" for i, m in enumerate(metrics))
    return f"(SELECT {keys}n, {out} FROM (SELECT {keys}n, {ordered} FROM {draws_sql(rows, by, id_col, metrics, convention)}))"


def independent_sql(rows: str, by: Sequence[str], id_col: str, left: str, right: str, convention: Convention) -> str:
    """``independent`` as SQL."""
    keys = "".join(f"{k}, " for k in by)
    both = f"(SELECT * FROM {rows} WHERE ({left}) IS NOT NULL AND ({right}) IS NOT NULL)"
    a = draws_sql(both, by, id_col, {"l": (left, "1")}, convention)
    b = draws_sql(both, by, id_col, {"r": (right, "1")}, convention._replace(seed=convention.seed + 1))
    met = f"JOIN (SELECT {keys}r, r_draws FROM {b}) _y USING ({', '.join(by)})" if by else f", (SELECT r, r_draws FROM {b}) _y"
    return f"""(SELECT {keys}n, r - l AS delta, {_at_sql('_d', convention.low, convention)} AS lo, {_at_sql('_d', convention.high, convention)} AS hi
      FROM (SELECT {keys}n, l, r, {_sorted_sql(f'list_transform(range(1, {convention.draws} + 1), lambda i: r_draws[i] - l_draws[i])')} AS _d FROM {a} _x {met}))"""
