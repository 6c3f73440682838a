"""Verdict logs: which verdicts count, which questions are complete, which sets are common."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def last_success(log: DataFrame, keys: Sequence[str], value: str, order: Sequence[str]) -> DataFrame:
    """The latest non-null ``value`` of each key; failed calls (null) never replace a verdict."""
    return log.filter(F.col(value).isNotNull()).groupBy(*keys).agg(F.max_by(value, F.struct(*order)).alias(value))


def last_write(log: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """The latest row of each key, whatever it says."""
    held = [c for c in log.columns if c not in keys]
    return log.groupBy(*keys).agg(F.max_by(F.struct(*held), F.struct(*order)).alias("_row")).select(*keys, "_row.*")


def last_good_or_first(log: DataFrame, keys: Sequence[str], ok: Column, order: Sequence[str]) -> DataFrame:
    """A later row replaces an earlier one only if it is ok: the last ok row, else the first row."""
    held = [c for c in log.columns if c not in keys]
    row, at = F.struct(*held), F.struct(*order)
    marked = log.withColumn("_ok", ok)
    picked = marked.groupBy(*keys).agg(F.max_by(F.when(F.col("_ok"), row), F.when(F.col("_ok"), at)).alias("_good"), F.min_by(row, at).alias("_first"))
    return picked.select(*keys, F.coalesce("_good", "_first").alias("_row")).select(*keys, "_row.*")


def first_file_wins(rows: DataFrame, keys: Sequence[str], value: str, score: str, order: Sequence[str]) -> DataFrame:
    """Value of the first row of a key, score of its first row that has one."""
    at = F.struct(*order)
    return rows.groupBy(*keys).agg(F.min_by(value, at).alias(value), F.min_by(F.col(score), F.when(F.col(score).isNotNull(), at)).alias(score))


def complete(criteria: DataFrame, grades: DataFrame, keys: Sequence[str] = ("arm",)) -> DataFrame:
    """Rows (keys, id, k, weight, met) of questions all of whose criteria have a verdict."""
    whole = criteria.groupBy("id").agg(F.count(F.lit(1)).alias("n_criteria"))
    held = criteria.join(grades, ["id", "k"])
    ready = held.groupBy(*keys, "id").agg(F.count("met").alias("n")).join(whole, "id").filter("n = n_criteria").select(*keys, "id")
    return held.join(ready, [*keys, "id"], "left_semi")


def graded_cells(grades: DataFrame, rubrics: DataFrame, by: Sequence[str] = ("path", "arm")) -> DataFrame:
    """by, id, verdicts, full, score of every cell and id that was tried: full if each of the id's criteria has a verdict, with its weighted score if it has positive weight, else null.

    ``grades`` (by, id, k, met), met null where every call failed; ``rubrics`` (id, r: array<struct<k, weight>>). Verdicts
    on criteria that a question doesn't have, and ids without a rubric, don't count.
    """
    per = grades.groupBy(*by, "id").agg(F.map_from_entries(F.collect_list(F.struct("k", "met"))).alias("said")).join(rubrics, "id")
    met = lambda c: F.try_element_at("said", c["k"])
    add = lambda value: F.aggregate(F.transform("r", value), F.lit(0.0), lambda acc, x: acc + x)
    full, whole = F.forall("r", lambda c: met(c).isNotNull()), add(lambda c: F.greatest(c["weight"], F.lit(0.0)))
    score = F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.try_divide(add(lambda c: F.when(met(c), c["weight"]).otherwise(0.0)), whole)))
    return per.select(*by, "id", F.size(F.filter("r", lambda c: met(c).isNotNull())).alias("verdicts"), full.alias("full"), F.when(full & (whole > 0), score).alias("score"))


def common_ids(cells: DataFrame, cell: str, n_cells: int | None = None) -> DataFrame:
    """Ids that every cell has: relational division by counting, one shuffle for any number of cells."""
    wanted = F.lit(n_cells) if n_cells is not None else None
    per_id = cells.groupBy("id").agg(F.count_distinct(cell).alias("n"))
    if wanted is None:
        whole = cells.agg(F.count_distinct(cell).alias("n_cells"))
        return per_id.crossJoin(F.broadcast(whole)).filter("n = n_cells").select("id")  # one row
    return per_id.filter(F.col("n") == wanted).select("id")


def coverage_floor(counts: DataFrame, cell: str, suite: str, n: str, of_cell: float, of_suite: float) -> DataFrame:
    """Cells whose count reaches both shares: of the cell's best file, and of the suite's best."""
    best = counts.withColumn("cell_max", F.max(n).over(Window.partitionBy(cell, suite))).withColumn("suite_max", F.max(n).over(Window.partitionBy(suite)))
    return best.withColumn("counts", (F.col(n) >= of_cell * F.col("cell_max")) & (F.col(n) >= of_suite * F.col("suite_max")))


def pending(tasks: DataFrame, done: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Tasks without a successful row: what a resumed run has to do."""
    return tasks.join(done.select(*keys).distinct(), list(keys), "left_anti")


def pending_calls(log: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """``pending`` where tasks and results are one log: keys without a successful row, in one aggregation. A key with a null equals none, so it stays."""
    null = F.lit(False)
    for k in keys:
        null = null | F.col(k).isNull()
    return log.groupBy(*keys).agg(F.count(value).alias("_n")).filter((F.col("_n") == 0) | null).select(*keys)


def ghost_share(verdicts: DataFrame, by: Sequence[str]) -> DataFrame:
    """Among positively weighted criteria met by the wide judge, how many the strict one denies."""
    good = F.col("weight") > 0
    return verdicts.groupBy(*by).agg(
        F.count_if(good & F.col("wide")).alias("wide_met"), F.count_if(good & F.col("wide") & ~F.col("strict")).alias("ghost"),
        F.count_if(good & ~F.col("wide") & F.col("strict")).alias("strict_only"),
    ).withColumn("ghost_share", F.try_divide(F.col("ghost"), F.col("wide_met")))


def greedy_arms(cells: DataFrame, core: Sequence[str], extra: Sequence[str], share: float = 0.9) -> tuple[list[str], DataFrame]:
    """Arms in order join while they cover ``share`` of the ids so far, which then shrink.

    The fold is sequential by definition, over a few arms; each step is a count.
    """
    ids = common_ids(cells.filter(F.col("arm").isin(*core)), "arm", len(core))
    n, joined = ids.count(), list(core)
    for arm in extra:
        both = ids.join(cells.filter(F.col("arm") == arm).select("id").distinct(), "id", "left_semi")
        m = both.count()
        if m >= share * n:
            ids, n = both, m
            joined.append(arm)
    return joined, ids


def state_transitions(before_after: DataFrame) -> DataFrame:
    """Verdict arrays before and after: state -> n, fixed and lost shares, with all states together.

    States: zero, one_short, middle, all; rows of unequal length are left out.
    """
    met = lambda c: F.size(F.filter(c, lambda x: x))
    rows = before_after.filter((F.size("before") == F.size("after")) & (F.size("before") > 0)).withColumn("k", F.size("before")).withColumn("b", met(F.col("before")))
    state = F.when(F.col("b") == F.col("k"), "all").when(F.col("b") == 0, "zero").when(F.col("b") == F.col("k") - 1, "one_short").otherwise("middle")
    fixed = F.size(F.filter(F.arrays_zip("before", "after"), lambda x: ~x.before & x.after))
    lost = F.size(F.filter(F.arrays_zip("before", "after"), lambda x: x.before & ~x.after))
    rows = rows.select(state.alias("state"), fixed.alias("fixed"), lost.alias("lost"), "k", "b", met(F.col("after")).alias("a"))
    return rows.rollup("state").agg(
        F.count(F.lit(1)).alias("n"), F.count_if(F.col("a") == F.col("k")).alias("to_all"), F.sum("fixed").alias("fixed"), F.sum("lost").alias("lost"),
        F.try_divide(F.sum("fixed"), F.sum(F.col("k") - F.col("b"))).alias("fix_rate"), F.try_divide(F.sum("a"), F.sum("k")).alias("dim_sat"),
    ).withColumn("state", F.coalesce("state", F.lit("overall")))
