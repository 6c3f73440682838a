"""Splits, samples, dedupe and schedules that reruns reproduce."""

from __future__ import annotations

import hashlib
import math
import random
from collections.abc import Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def hash_sample(rows: DataFrame, id_col: str, n: int) -> DataFrame:
    """The n rows of the smallest SHA-1 of the id."""
    return rows.orderBy(F.sha1(F.col(id_col).cast("string")), id_col).limit(n)


def stratified_hash_sample(rows: DataFrame, id_col: str, stratum: str, n: int) -> DataFrame:
    """About n rows, strata in proportion (quotas rounded half to even), each by hash order; then cut or filled to n by it.

    No row beyond place 2n of its stratum can be chosen or fill up, so each task sends so many rows of a stratum at most.
    """
    h = F.sha1(F.col(id_col).cast("string"))
    sizes = rows.groupBy(stratum).agg(F.count(F.lit(1)).alias("_c"))
    whole = rows.agg(F.count(F.lit(1)).alias("_t"))
    quota = sizes.crossJoin(F.broadcast(whole)).select(F.col(stratum).alias("_s"), F.bround(n * F.col("_c") / F.col("_t")).cast("long").alias("_q"))  # one row
    ranked = rows.withColumn("_h", h).withColumn("_r", F.row_number().over(Window.partitionBy(stratum).orderBy("_h", id_col))).filter(F.col("_r") <= 2 * n)
    chosen = ranked.join(quota, F.col(stratum).eqNullSafe(F.col("_s"))).withColumn("_in", F.col("_r") <= F.col("_q"))
    return chosen.orderBy(F.desc("_in"), "_h", id_col).limit(n).select(*rows.columns)


#: Rows whose order the standard library may make in the driver.
MOST_SEEDED = 1_000_000


def seeded_positions(n: int, k: int, seed: int) -> list[int]:
    """Draw order of the standard library's sample, which no Spark generator reproduces."""
    return random.Random(seed).sample(range(n), k)


def seeded_sample(rows: DataFrame, pos: str, n: int, k: int, seed: int) -> DataFrame:
    """k of n rows by position 0 .. n-1, with draw_pos, in the standard library's order.

    For samples of a bounded size: its positions come from the driver and are broadcast, and more
    than MOST_SEEDED are an error. ``keyed_place`` has no such bound.
    """
    if k > MOST_SEEDED:
        raise ValueError(f"{k} positions are too many for the driver; take keyed_place")
    drawn = list(enumerate(seeded_positions(n, k, seed)))
    spark = rows.sparkSession
    return rows.join(F.broadcast(spark.createDataFrame(drawn, f"draw_pos int, {pos} long")), pos)


def shuffled(rows: DataFrame, pos: str, n: int, seed: int) -> DataFrame:
    """``rows`` with their place (draw_pos) in the standard library's shuffle of positions 0 .. n-1; for n up to MOST_SEEDED, as in ``seeded_sample``."""
    if n > MOST_SEEDED:
        raise ValueError(f"{n} positions are too many for the driver; take keyed_place")
    order = list(range(n))
    random.Random(seed).shuffle(order)
    drawn = pd.DataFrame({pos: order, "draw_pos": range(n)}, dtype="int64")
    return rows.join(rows.sparkSession.createDataFrame(drawn, f"{pos} long, draw_pos long"), pos)


#: A prime below 2^31, so that products stay within 64 bits.
_PRIME = (1 << 31) - 1
#: Rounds of a permutation, and how often it is applied at most until a place lies in the range.
ROUNDS, WALKS = 6, 24


def permutation_keys(seed: int) -> list[tuple[int, int, int]]:
    """Three numbers below the prime for each round."""
    word = lambda i, j: int(hashlib.sha256(f"{seed}:{i}:{j}".encode()).hexdigest()[:12], 16) % (_PRIME - 1) + 1
    return [(word(i, 0), word(i, 1), word(i, 2)) for i in range(ROUNDS)]


def keyed_place(pos: Column, n: int, seed: int) -> Column:
    """Where a keyed permutation of 0 .. n-1 puts ``pos``: every row works out its own place.

    A place is written with two digits, l * b + r, on a grid a * b that is a little larger than n;
    each round adds a function of one digit to the other (Feistel rounds), and a place beyond n is
    permuted again until it lies below. Few do: the grid has at most about the square root of n
    places more. A place that still lies beyond after WALKS times raises.
    """
    a = math.isqrt(max(n, 1) - 1) + 1
    b = -(-max(n, 1) // a)
    rounds = F.array(*[F.struct(*[F.lit(k).cast("long").alias(x) for k, x in zip(key, "pqs", strict=True)], F.lit(i % 2 == 0).alias("left")) for i, key in enumerate(permutation_keys(seed))])

    def mixed(digit: Column, key: Column) -> Column:
        t = (digit % _PRIME * key["p"] + key["q"]) % _PRIME
        return (t * t + key["s"]) % _PRIME

    def step(state: Column, key: Column) -> Column:
        left = F.when(key["left"], (state["l"] + mixed(state["r"], key)) % a).otherwise(state["l"])
        right = F.when(key["left"], state["r"]).otherwise((state["r"] + mixed(state["l"], key)) % b)
        return F.struct(left.alias("l"), right.alias("r"))

    def once(x: Column) -> Column:
        digits = F.struct(((x - x % b) / b).cast("long").alias("l"), (x % b).alias("r"))
        return F.aggregate(rounds, digits, step, lambda state: state["l"] * b + state["r"])

    found = F.aggregate(F.sequence(F.lit(1), F.lit(WALKS)), once(pos.cast("long")), lambda x, _: F.when(x < n, x).otherwise(once(x)))
    return F.when(found < n, found).otherwise(F.raise_error(F.lit("no place below n")).cast("long"))


def keyed_place_sql(rows: str, pos: str, seed: int) -> str:
    """The same as SQL: a SELECT of all columns of ``rows`` and draw_pos; ``pos`` is 0 .. n-1 over all its rows."""
    mixed = lambda d, k: f"(((({d} % {_PRIME} * {k[0]} + {k[1]}) % {_PRIME}) * (({d} % {_PRIME} * {k[0]} + {k[1]}) % {_PRIME}) + {k[2]}) % {_PRIME})"
    chain, l, r = "x // b AS l0, x % b AS r0", "l0", "r0"  # noqa: E741
    for i, key in enumerate(permutation_keys(seed)):
        if i % 2 == 0:
            chain, l = f"{chain}, ({l} + {mixed(r, key)}) % a AS l{i + 1}", f"l{i + 1}"  # noqa: E741
        else:
            chain, r = f"{chain}, ({r} + {mixed(l, key)}) % b AS r{i + 1}", f"r{i + 1}"
    once = lambda source: f"SELECT _p, n, a, b, {l} * b + {r} AS x FROM (SELECT *, {chain} FROM ({source}))"
    sized = f"SELECT *, CAST((n + a - 1) // a AS BIGINT) AS b FROM (SELECT *, CAST(ceil(sqrt(n)) AS BIGINT) AS a FROM (SELECT CAST({pos} AS BIGINT) AS _p, CAST({pos} AS BIGINT) AS x, count(*) OVER () AS n FROM {rows}))"
    return f"""(WITH RECURSIVE _walk AS ({once(sized)} UNION ALL {once('SELECT _p, x, n, a, b FROM _walk WHERE x >= n')})
      SELECT t.*, w.x AS draw_pos FROM {rows} t JOIN _walk w ON w._p = t.{pos} AND w.x < w.n)"""


def placed(rows: DataFrame, id_col: str, pos: str) -> tuple[DataFrame, int]:
    """Rows with their place 0 .. n-1 in the order of a distinct id, and n; ranges of ids are ranked apart, as a global window is one task."""
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    cuts = sorted(set(rows.agg(F.percentile_approx(id_col, [i / parts for i in range(1, parts)] or [0.5])).first()[0] or []))
    bucket = F.size(F.filter(F.array(*map(F.lit, cuts)), lambda c: c < F.col(id_col))) if cuts else F.lit(0)
    dealt = rows.withColumn("_b", bucket)
    held = {r["_b"]: r["count"] for r in dealt.groupBy("_b").count().collect()}
    before = F.array(*[F.lit(sum(held.get(b, 0) for b in range(i))).cast("long") for i in range(len(cuts) + 1)])
    place = F.row_number().over(Window.partitionBy("_b").orderBy(id_col)) - 1 + F.get(before, F.col("_b"))
    return dealt.withColumn(pos, place).drop("_b"), sum(held.values())


def disjoint_split(rows: DataFrame, id_col: str, shares: dict[str, int]) -> DataFrame:
    """split by the leading hash digits of the id: a row's split never depends on other rows."""
    bucket = F.conv(F.substring(F.sha1(F.col(id_col).cast("string")), 1, 8), 16, 10).cast("long") % sum(shares.values())
    split, upto = None, 0
    for name, share in shares.items():
        upto += share
        split = F.when(bucket < upto, name) if split is None else split.when(bucket < upto, name)
    return rows.withColumn("split", split)


def shard_of(id_col: Column, shards: int) -> Column:
    """The 160-bit SHA-1 of the id modulo ``shards``, in 32-bit steps."""
    digest, out = F.sha1(id_col.cast("string")), F.lit(0).cast("long")
    for i in range(5):
        word = F.conv(F.substring(digest, 8 * i + 1, 8), 16, 10).cast("long")
        out = (out * ((1 << 32) % shards) + word) % shards
    return out


def cyclic_next(rows: DataFrame, pos: str, n: int, value: str, name: str) -> DataFrame:
    """Each row's value of the next position, the last one's of position 0: a join, as a global window is one task."""
    after = rows.select(((F.col(pos) + n - 1) % n).alias(pos), F.col(value).alias(name))
    return rows.join(after, pos)


def drop_reasons(rows: DataFrame, key: Column, pos: Column, tests: Sequence[tuple[str, Column]], empty: Column) -> DataFrame:
    """reason of each row: empty, dup, the first failing test, or kept.

    A row is dup if an earlier row of its key was kept; a failing earlier copy shadows nothing.
    Only rows that pass are grouped, by a digest of their key, so a key that many empty or
    failing rows share gathers nowhere, and texts don't travel.
    """
    passes = ~empty
    for _, bad in tests:
        passes = passes & ~bad
    marked = rows.withColumns({"_key": F.when(~empty, F.sha2(key.cast("string"), 256)), "_pos": pos, "_pass": F.coalesce(passes, F.lit(False))})
    first = marked.filter("_pass").groupBy("_key").agg(F.min("_pos").alias("_first"))
    marked = marked.join(first, "_key", "left")
    reason = F.when(empty, "empty").when(F.col("_pos") > F.col("_first"), "dup")
    for name, bad in tests:
        reason = reason.when(bad, name)
    return marked.withColumn("reason", reason.otherwise("kept")).drop("_key", "_pos", "_pass", "_first")


def schedule(ids: DataFrame, pos: str, n: int, steps: int, groups: int, size: int, alpha: float, middle: float) -> DataFrame:
    """One row per step, group and member: the id that cycles there, lambda of the step and the member's strength."""
    slots = ids.sparkSession.range(steps * groups).select((F.col("id") % n).alias(pos), F.floor(F.col("id") / groups).alias("step"), F.col("id").alias("slot"))
    lam = 1 / (1 + F.exp(alpha * (F.col("step") / steps - middle)))
    placed = slots.join(ids, pos).withColumn("lam", lam).withColumn("member", F.explode(F.sequence(F.lit(0), F.lit(size - 1))))
    return placed.withColumn("strength", F.col("lam") * (1 - F.col("member") / max(size - 1, 1)))
