"""Judged evaluations: task lists, passes, summaries, tables of cells."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from galena.functions.rubric import weighted_score


def task_list(questions: DataFrame, arms: DataFrame, done: DataFrame) -> DataFrame:
    """arm, id, k, criterion of every question (id, r), arm and place that has no row in ``done`` (arm, id, k).

    Arms are a parameter table of a few rows, so the product is one row per call to make.
    """
    tasks = questions.crossJoin(F.broadcast(arms)).select("arm", "id", F.posexplode("r").alias("p", "c")).select("arm", "id", (F.col("p") + 1).alias("k"), F.col("c.criterion").alias("criterion"))
    return tasks.join(done.select("arm", "id", "k"), ["arm", "id", "k"], "left_anti")


def passes(attempts: DataFrame, keys: Sequence[str], met: str, order: Sequence[str], most: int) -> DataFrame:
    """keys, met, tries: each key's first verdict among its first ``most`` attempts; keys that never succeed stay, with null.

    As retries only ever ask for what is pending, a key's n-th attempt is its n-th row: one window instead of a loop of anti-joins.
    """
    nth = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    tried = attempts.withColumn("_n", nth).filter(F.col("_n") <= most)
    good = F.min_by(met, F.when(F.col(met).isNotNull(), F.col("_n")))
    first = F.min(F.when(F.col(met).isNotNull(), F.col("_n")))
    return tried.groupBy(*keys).agg(F.when(first.isNotNull(), good).alias(met), F.coalesce(first, F.max("_n")).cast("long").alias("tries"))


def passes_of_arms(attempts: DataFrame, keys: Sequence[str], arms: Sequence[str], order: Sequence[str], most: int) -> DataFrame:
    """arm, keys, met, tries: ``passes`` of attempts that call every arm, whose verdicts are columns: an attempt's place is the same for all arms, so rows are ordered once, not once an arm."""
    nth = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    tried = attempts.select(*keys, *order, *arms).withColumn("_n", nth).filter(F.col("_n") <= most)
    at = lambda arm: F.when(F.col(arm).isNotNull(), F.col("_n"))
    each = [F.struct(F.lit(a).alias("arm"), F.min_by(a, at(a)).alias("met"), F.coalesce(F.min(at(a)), F.max("_n")).cast("long").alias("tries")) for a in arms]
    return tried.groupBy(*keys).agg(F.array(*each).alias("_arms")).select(*keys, F.inline("_arms")).select("arm", *keys, "met", "tries")


def paired(scores: DataFrame, arms: int) -> DataFrame:
    """Rows of ids that all ``arms`` have."""
    ids = scores.groupBy("id").agg(F.count_distinct("arm").alias("_n")).filter(F.col("_n") == arms).select("id")
    return scores.join(ids, "id", "left_semi")


def folded_runs(criteria: DataFrame, arms: Sequence[str]) -> DataFrame:
    """id, runs: array<struct<arm, score, wide_score, same, n>> in order of arms.

    ``criteria`` (id, k, weight, and for each arm a struct<met, wide> that is null without a verdict) has a row for each
    criterion. An arm is in ``runs`` if it has a verdict on all of an id's criteria, and the id positive weight. One aggregation.
    """
    w, whole = F.col("weight"), F.count(F.lit(1))

    def run(arm: str) -> Column:
        met, wide = F.col(f"{arm}.met"), F.col(f"{arm}.wide")
        score = lambda said: weighted_score(w, said, strict=False)
        row = F.struct(F.lit(arm).alias("arm"), score(met).alias("score"), score(wide).alias("wide_score"), F.count_if(met == wide).alias("same"), F.count(met).alias("n"))
        return F.when(F.count(met) == whole, row)

    folded = criteria.groupBy("id").agg(F.array(*[run(arm) for arm in arms]).alias("runs"))
    return folded.select("id", F.filter("runs", lambda x: x.isNotNull() & x["score"].isNotNull()).alias("runs")).filter(F.size("runs") > 0)


def strict_summary(runs: DataFrame, arms: int) -> DataFrame:
    """kind, name, value, n of ``folded_runs``: means of both judges on the ids that every arm has fully graded, agreement on all of an arm's, and paired deltas.

    Every id gives its terms at once, and one aggregation sums them.
    """
    every, places = F.size("runs") == arms, F.sequence(F.lit(0), F.size("runs") - 1)
    term = lambda kind, name, total, n: F.struct(F.lit(kind).alias("kind"), name.alias("name"), total.cast("double").alias("total"), n.cast("long").alias("n"))
    means = F.flatten(F.transform("runs", lambda r: F.array(term("strict", r["arm"], r["score"], F.lit(1)), term("training", r["arm"], r["wide_score"], F.lit(1)))))
    agreement = F.transform("runs", lambda r: term("agreement", r["arm"], r["same"], r["n"]))
    pair = lambda a, b: F.array(*[term(kind, F.concat(b["arm"], F.lit(" minus "), a["arm"]), b[c] - a[c], F.lit(1)) for kind, c in (("strict delta", "score"), ("training delta", "wide_score"))])
    deltas = F.flatten(F.flatten(F.transform(places, lambda i: F.transform(F.slice("runs", i + 2, F.size("runs")), lambda b: pair(F.get("runs", i), b)))))
    terms = runs.select(F.inline(F.when(every, F.concat(agreement, means, deltas)).otherwise(agreement)))
    return terms.groupBy("kind", "name").agg((F.sum("total") / F.sum("n")).alias("value"), F.sum("n").alias("n"))


def rederived(scores: DataFrame, value: str, again: str, tolerance: float = 1e-6) -> DataFrame:
    """checked, mismatches: rows with both values, and how many differ."""
    both = F.col(value).isNotNull() & F.col(again).isNotNull()
    return scores.agg(F.count_if(both).alias("checked"), F.count_if(both & (F.abs(F.col(value) - F.col(again)) > tolerance)).alias("mismatches"))


def rounded_then_averaged(values: DataFrame, by: Sequence[str], seed: str, value: str, digits: int = 2) -> DataFrame:
    """Mean and sample sd over seeds of each seed's rounded mean; sd is null for one seed."""
    seeds = values.groupBy(*by, seed).agg(F.bround(F.avg(value), digits).alias("_v"))
    return seeds.groupBy(*by).agg(F.avg("_v").alias("mean"), F.stddev_samp("_v").alias("sd"), F.count("_v").alias("k"))


def complete_files(files: DataFrame, cell: str, suite: str, n: str, cell_floor: float = 0.9, suite_floor: float = 0.95) -> DataFrame:
    """Files with nearly as many rows as the largest of their cell and suite, and of their suite."""
    over = lambda *keys: F.max(n).over(Window.partitionBy(*keys))
    marked = files.withColumns({"_cell": over(cell, suite), "_suite": over(suite)})
    return marked.filter((F.col(n) >= cell_floor * F.col("_cell")) & (F.col(n) >= suite_floor * F.col("_suite"))).drop("_cell", "_suite")


def grouped_draws(draws: DataFrame, keys: Sequence[str], k: str, met: str, score: str) -> DataFrame:
    """keys, score, sd, met: draws of a group averaged, with their population sd, and each criterion's strict majority in order of ``k``."""
    per = draws.groupBy(*keys, k).agg(F.count(F.lit(1)).alias("_n"), F.count_if(F.col(met)).alias("_yes"))
    majority = per.groupBy(*keys).agg(F.transform(F.array_sort(F.collect_list(F.struct(k, (2 * F.col("_yes") > F.col("_n")).alias("m")))), lambda x: x.m).alias("met"))
    means = draws.groupBy(*keys).agg(F.avg(score).alias("score"), F.stddev_pop(score).alias("sd"))
    return means.join(majority, list(keys))


def rewards(rollouts: DataFrame, group: Column, n: Column, score: Column, failed: Column) -> DataFrame:
    """``rollouts`` with group_id, reward and disposition: a group one of whose members failed earns nothing, all of it."""
    marked = rollouts.withColumns({"group_id": group, "_score": score, "_bad": F.coalesce(failed, F.lit(True)) | score.isNull() | (n == 0)})
    any_bad = F.max("_bad").over(Window.partitionBy("group_id"))
    return marked.withColumn("disposition", F.when(any_bad, "failed_closed").otherwise("scored")).withColumn("reward", F.when(any_bad, 0.0).otherwise(F.col("_score"))).drop("_score", "_bad")


#: Points by which a domain has to fall (fixed value).
FALL = 3.0


def reading(mean: Column, low: Column, high: Column) -> Column:
    """Of a difference from the untrained arm in points: collapse if it is FALL below or more and the interval lies below zero, no collapse if the interval lies above -FALL, else mixed."""
    return F.when((mean <= -FALL) & (high < 0), "collapse").when(low > -FALL, "no collapse").otherwise("mixed")


def recovers(over_reference: Column, over_untrained: Column) -> Column:
    """Of lower bounds: better than the reference arm, and not FALL below the untrained one."""
    return (over_reference > 0) & (over_untrained > -FALL)
