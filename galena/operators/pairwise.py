"""Pairwise verdicts under order swap, and benchmark scores."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Strength of an arena label and the side it favours.
ARENA = {"A>>B": (3.0, 1.0), "A>B": (1.0, 1.0), "A=B": (1.0, 0.5), "B>A": (1.0, 0.0), "B>>A": (3.0, 0.0)}


def swapped(log: DataFrame, keys: Sequence[str]) -> DataFrame:
    """keys, w0, w1: the winners of both orders side by side (one group, not a self-join)."""
    return log.groupBy(*keys).agg(*[F.max(F.when(F.col("order") == o, F.col("winner"))).alias(f"w{o}") for o in (0, 1)])


def stable_wins(log: DataFrame, keys: Sequence[str], by: Sequence[str]) -> DataFrame:
    """Wins, losses and ties: a win needs the same winner in both orders; a rate leaves ties out."""
    both = swapped(log, keys).filter("w0 is not null and w1 is not null")
    same = F.col("w0") == F.col("w1")
    out = both.groupBy(*by).agg(F.count_if(same & (F.col("w0") == "x")).alias("wins"), F.count_if(same & (F.col("w0") == "y")).alias("losses"), F.count(F.lit(1)).alias("n"))
    return out.withColumn("ties", F.col("n") - F.col("wins") - F.col("losses")).withColumn("rate", F.try_divide(F.col("wins"), F.col("wins") + F.col("losses")))


def first_position(log: DataFrame, by: Sequence[str]) -> DataFrame:
    """How often whoever is shown first wins; ties aside."""
    first = F.when(F.col("order") == 0, "x").otherwise("y")
    return log.filter(F.col("winner").isin("x", "y")).groupBy(*by).agg(F.avg((F.col("winner") == first).cast("double")).alias("first_share"), F.count(F.lit(1)).alias("n"))


def sign_agreement(pairs: DataFrame, by: Sequence[str]) -> DataFrame:
    """Of stable wins with a score difference, how many have its sign."""
    kept = pairs.filter((F.col("w0") == F.col("w1")) & F.col("w0").isin("x", "y") & (F.col("delta") != 0))
    return kept.groupBy(*by).agg(F.avg(((F.col("delta") > 0) == (F.col("w0") == "x")).cast("double")).alias("agreement"), F.count(F.lit(1)).alias("n"))


def arena_score(games: DataFrame, by: Sequence[str]) -> DataFrame:
    """Strength-weighted share of games for the candidate, over ids with a label in both orders."""
    strength = F.create_map(*[F.lit(x) for k, v in ARENA.items() for x in (k, v[0])])
    side = F.create_map(*[F.lit(x) for k, v in ARENA.items() for x in (k, v[1])])
    whole = games.filter(F.col("verdict").isin(*ARENA)).withColumns({"s": strength[F.col("verdict")], "o": F.when(F.col("order") == 0, side[F.col("verdict")]).otherwise(1 - side[F.col("verdict")])})
    both = whole.groupBy(*by, "id").agg(F.count_distinct("order").alias("orders"), F.sum(F.col("s") * F.col("o")).alias("won"), F.sum("s").alias("played")).filter("orders = 2")
    return both.groupBy(*by).agg(F.try_divide(F.sum("won"), F.sum("played")).alias("score"), F.count(F.lit(1)).alias("ids"))


def criterion_mean(grades: DataFrame, keys: Sequence[str], k: str, score: str, n: str) -> DataFrame:
    """Mean score of keys whose criteria are exactly 0 .. n-1."""
    out = grades.groupBy(*keys).agg(F.count_distinct(k).alias("seen"), F.min(k).alias("lo"), F.max(k).alias("hi"), F.max(n).alias("whole"), F.avg(score).alias("score"))
    return out.filter("seen = whole and lo = 0 and hi = whole - 1").select(*keys, "score")


def criterion_mean_of(grades: DataFrame, keys: Sequence[str], k: str, score: str) -> DataFrame:
    """``criterion_mean`` where n is the key's number of rows: two aggregations, no join of the rows with their count."""
    per = grades.groupBy(*keys, k).agg(F.count(F.lit(1)).alias("_rows"), F.sum(score).alias("_sum"), F.count(score).alias("_n"))
    out = per.groupBy(*keys).agg(F.count(k).alias("seen"), F.min(k).alias("lo"), F.max(k).alias("hi"), F.sum("_rows").alias("whole"), F.try_divide(F.sum("_sum"), F.sum("_n")).alias("score"))
    return out.filter("seen = whole and lo = 0 and hi = whole - 1").select(*keys, "score")


def inverted_mean(scores: DataFrame, keys: Sequence[str], metric: str, score: str, negative: Sequence[str], top: float) -> DataFrame:
    """Mean of metrics, those where less is better turned round."""
    value = F.when(F.col(metric).isin(*negative), top - F.col(score)).otherwise(F.col(score))
    return scores.groupBy(*keys).agg(F.avg(value).alias("score"))


def batched_coverage(batches: DataFrame, keys: Sequence[str], size: str, width: int = 8) -> DataFrame:
    """Mean of (s - 1) / 4 over all labels, where every batch of ``width`` is there and their number is right."""
    parts = F.array_sort(F.collect_list(F.struct("batch", "scores")))
    out = batches.groupBy(*keys).agg(parts.alias("parts"), F.max(size).alias("size"))
    flat = F.flatten(F.transform("parts", lambda p: p.scores))
    starts = F.transform("parts", lambda p: p.batch) == F.sequence(F.lit(0), F.col("size") - 1, F.lit(width))
    mean = F.aggregate(flat, F.lit(0.0), lambda acc, s: acc + (s - 1) / 4) / F.size(flat)
    return out.filter(starts & (F.size(flat) == F.col("size"))).select(*keys, mean.alias("coverage"))
