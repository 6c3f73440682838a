"""Releases: packaging by rules, control arms, schedules, checks of sets."""

from __future__ import annotations

import random
from collections.abc import Callable, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf

from galena.functions import rubric as R


def packaged(questions: DataFrame, made: DataFrame, manual: DataFrame, least: int = 2, most: int = 5) -> DataFrame:
    """id, r, groups, repaired, reason, dimensions, generation: every question with the first rule it breaks (null: kept).

    ``questions`` (id, r: checklist), ``made`` (id, valid, repaired, model, groups: 1-based
    indices), ``manual`` (id, why). Both joins are left joins, so no question is lost.
    """
    rows = questions.join(made.withColumn("_made", F.lit(True)), "id", "left").join(manual, "id", "left")
    n, groups = F.size("r"), F.col("groups")
    flat = F.flatten(groups)
    weight = lambda g: R.group_weight(F.col("r"), g)
    in_range = F.forall(flat, lambda i: (i >= 1) & (i <= n))
    reason = (
        F.when(F.col("_made").isNull(), "no_generation").when(F.col("why").isNotNull(), F.concat(F.lit("manual:"), "why"))
        .when(~(F.col("valid") | F.col("repaired")), "invalid:unknown").when(~F.size(groups).between(least, most), F.concat(F.lit("n_criteria_out_of_range:"), F.size(groups).cast("string")))
        .when(F.exists(groups, lambda g: F.size(g) == 0), "criterion_without_indices").when(~in_range, "index_out_of_range")
        .when(~R.covers_once(groups, n), "coverage_not_exactly_once").when(F.exists(groups, lambda g: weight(g) <= 0), "nonpositive_weight")
    )
    rows = rows.withColumn("reason", reason)
    text = lambda g: F.array_join(F.transform(g, lambda i: F.concat(F.lit("item "), i.cast("string"))), " ")
    dims = F.transform(groups, lambda g, i: F.struct(F.concat(F.lit("group "), (i + 1).cast("string")).alias("name"), F.concat(F.lit("all "), text(g)).alias("criterion"), weight(g).alias("weight"), g.alias("indices")))
    kept = F.col("reason").isNull()
    said = F.to_json(F.struct(F.transform(groups, lambda g, i: F.concat(F.lit("group "), (i + 1).cast("string"))).alias("names"), groups.alias("atomic_indices"), "repaired", "model"))
    return rows.select("id", "r", "groups", "repaired", "reason", F.when(kept, dims).alias("dimensions"), F.when(kept, said).alias("generation"))


def dealt_back(dimensions: DataFrame) -> DataFrame:
    """Of (id, r, at, x: dimension): a row for each of its criteria, with the dimension's weight in proportion."""
    atoms = F.transform("x.indices", lambda i: F.element_at("r", i))
    dealt = R.split_weight(F.transform(atoms, lambda a: a.weight), F.col("x.weight"))
    rows = dimensions.select("id", "at", F.explode(F.arrays_zip(F.col("x.indices").alias("atom"), F.transform(atoms, lambda a: a.criterion).alias("criterion"), dealt.alias("weight"))).alias("y"))
    return rows.select("id", "at", "y.atom", "y.criterion", "y.weight")


def rewritten(old: DataFrame, new: DataFrame) -> DataFrame:
    """``old`` (id, old) with ``new``'s criteria (id, ok, new). Raises where one is missing, or differs in length or in a prefix."""
    prefix = lambda t: F.regexp_extract(t, r"^([^:\n]{1,40}:\s*)", 1)
    same = F.forall(F.zip_with("old", "new", lambda a, b: prefix(a) == prefix(b)), lambda x: x)
    checks = F.coalesce(
        F.assert_true(F.col("new").isNotNull(), "a rewrite is missing"), F.assert_true(F.size("old") == F.size("new"), "a rewrite has another length"), F.assert_true(same, "a prefix has changed")
    )
    return old.join(new, "id", "left").withColumn("_checked", checks).filter("_checked is null").select("id", "ok", F.col("new").alias("criteria"))


def scaffold_members(rows: DataFrame, step: str, steps: int, size: int, alpha: float, middle: float, n: str) -> DataFrame:
    """``size`` members for each row: lambda_step, lam (linear in the member) and k = lam * n, rounded half to even."""
    strength = 1 / (1 + F.exp(alpha * (F.col(step) / float(steps) - middle)))
    out = rows.withColumn("lambda_step", strength).withColumn("member", F.explode(F.sequence(F.lit(1), F.lit(size))))
    out = out.withColumn("lam", F.col("lambda_step") * (size - F.col("member")) / float(max(size - 1, 1)))
    return out.withColumn("k", F.rint(F.col("lam") * F.col(n)).cast("long"))


def seeded_subset(seed: Column, n: Column, k: Column) -> Column:
    """k of 0 .. n-1 by the standard library's generator under a text seed, sorted: each row by itself."""

    @pandas_udf("array<int>")
    def drawn(seeds: pd.Series, ns: pd.Series, ks: pd.Series) -> pd.Series:
        return pd.Series([sorted(random.Random(s).sample(range(int(a)), int(b))) for s, a, b in zip(seeds, ns, ks, strict=True)])

    return drawn(seed, n, k)


def keyed_subset(seed: Column, n: Column, k: Column) -> Column:
    """k of 0 .. n-1, those of the smallest SHA-1 of the seed and the place, sorted: no generator, so SQL and any engine draw the same."""
    ranked = F.array_sort(F.transform(F.sequence(F.lit(1), F.greatest(n, F.lit(1)).cast("int")), lambda i: F.struct(F.sha1(F.concat(seed, F.lit(":"), i.cast("string"))).alias("h"), (i - 1).alias("i"))))
    return F.when(n > 0, F.array_sort(F.transform(F.slice(ranked, F.lit(1), F.greatest(k, F.lit(0)).cast("int")), lambda x: x["i"]))).otherwise(F.array().cast("array<int>"))


def scaffold_records(members: DataFrame, id_col: str, step: str, messages: str, rubric: str, head: str, seed: int, draw: Callable[[Column, Column, Column], Column] = keyed_subset) -> DataFrame:
    """uid, prompt, lambda_step, lambda, k, n_criteria of ``scaffold_members`` rows: some criteria are shown behind the last user turn.

    ``draw`` (seed text, n, k) says which; ``keyed_subset`` or ``seeded_subset``. A member shown none, or without a user turn, has the prompt as it was.
    """
    text = F.concat_ws(":", F.lit(str(seed)), F.col(id_col).cast("string"), F.col(step).cast("string"), F.col("member").cast("string"))
    drawn = members.withColumn("_shown", draw(text, F.size(rubric).cast("long"), F.col("k")))
    listed = F.concat(F.lit("\n\n" + head), F.array_join(F.transform("_shown", lambda i: F.concat(F.lit("- "), F.get(F.col(rubric), i)["criterion"])), "\n"))
    bare = F.col(messages)
    last = F.array_max(F.transform(bare, lambda m, i: F.when(F.lower(m["role"]) == "user", i)))
    trimmed = F.transform(bare, lambda m, i: F.struct(m["role"].alias("role"), F.when(i == last, F.concat(F.regexp_replace(m["text"], r"(?U)\s+$", ""), listed)).otherwise(m["text"]).alias("text")))
    prompt = F.when(F.col("k") > 0, trimmed).otherwise(F.transform(bare, lambda m: F.struct(m["role"].alias("role"), m["text"].alias("text"))))
    uid = F.concat_ws(":", F.lit("scaffold"), F.col(step).cast("string"), F.col(id_col).cast("string"), F.col("member").cast("string"))
    return drawn.select(uid.alias("uid"), prompt.alias("prompt"), F.round("lambda_step", 4).alias("lambda_step"), F.round("lam", 4).alias("lambda"), "k", F.size(rubric).cast("long").alias("n_criteria"))


def histogram_place(rows: DataFrame, by: Sequence[str], value: str, place: Callable[[Column], Column]) -> DataFrame:
    """The value at a 0-based place of each group's ascending order (``place`` of its n), and n.

    Counts of distinct values are ranked, not rows: a group's window holds one row per
    distinct value, combined before the shuffle.
    """
    counts = rows.filter(F.col(value).isNotNull()).groupBy(*by, value).agg(F.count(F.lit(1)).alias("_c"))
    over = Window.partitionBy(*by) if by else Window.partitionBy(F.lit(0))
    ranked = counts.withColumn("_upto", F.sum("_c").over(over.orderBy(value).rowsBetween(Window.unboundedPreceding, 0))).withColumn("n", F.sum("_c").over(over))
    at = place(F.col("n"))
    return ranked.filter((F.col("_upto") > at) & (F.col("_upto") - F.col("_c") <= at)).select(*by, value, "n")


def set_equality(parts: DataFrame, whole: DataFrame, key: str) -> DataFrame:
    """n, ids, equal: whether ``parts`` holds each key of ``whole`` once and nothing else. One aggregation of both sides."""
    both = parts.select(key, F.lit(1).alias("p"), F.lit(0).alias("w")).unionByName(whole.select(key, F.lit(0).alias("p"), F.lit(1).alias("w")))
    per = both.groupBy(key).agg(F.sum("p").alias("p"), F.max("w").alias("w"))
    return per.agg(F.sum("p").alias("n"), F.count_if(F.col("p") > 0).alias("ids"), F.coalesce(F.min((F.col("p") == 1) & (F.col("w") == 1)), F.lit(True)).alias("equal"))


def subset_missing(part: DataFrame, whole: DataFrame, key: str) -> DataFrame:
    """The keys of ``part`` that ``whole`` lacks: none if it is a subset."""
    return part.select(key).distinct().join(whole.select(key).distinct(), key, "left_anti")
