"""Statistics over seeds, questions and raters."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Two-sided 95 % quantiles of Student's t for 1 to 10 degrees of freedom (fixed values).
T_QUANTILES = (12.706, 4.303, 3.182, 2.776, 2.571, 2.447, 2.365, 2.306, 2.262, 2.228)


#: Ranges that a group's values are cut into before one of them is ranked.
RANGES = 64


def mean_sd(values: DataFrame, by: Sequence[str], value: str, n_seeds: int | None = None) -> DataFrame:
    """Mean, sample sd and count; with ``n_seeds`` only where every seed is there."""
    whole = F.count(value)
    ready = F.lit(True) if n_seeds is None else whole == n_seeds
    return values.groupBy(*by).agg(F.when(ready, F.avg(value)).alias("mean"), F.when(ready & (whole > 1), F.stddev_samp(value)).alias("sd"), whole.alias("n"))


def paired_t(values: DataFrame, by: Sequence[str], pair: str, arm: str, left: str, right: str, value: str) -> DataFrame:
    """Per group: mean difference left - right over pairs that have both, and its t interval."""
    sides = values.groupBy(*by, pair).agg(F.avg(F.when(F.col(arm) == left, F.col(value))).alias("l"), F.avg(F.when(F.col(arm) == right, F.col(value))).alias("r"))
    both = sides.filter("l is not null and r is not null").withColumn("d", F.col("l") - F.col("r"))
    out = both.groupBy(*by).agg(F.avg("d").alias("delta"), F.stddev_samp("d").alias("sd"), F.count("d").alias("n"))
    # More degrees of freedom than the table has give no interval rather than that of ten.
    quantile = F.try_element_at(F.array(*map(F.lit, T_QUANTILES)), F.greatest(F.col("n") - 1, F.lit(1)).cast("int"))
    half = F.when(F.col("n") > 1, quantile * F.col("sd") / F.sqrt("n"))
    return out.withColumns({"lo": F.col("delta") - half, "hi": F.col("delta") + half})


def upper_median(rows: DataFrame, by: Sequence[str], value: str) -> DataFrame:
    """Place n // 2: the higher of the two middle values."""
    return _at_place(rows, by, value, lambda n: F.floor(n / 2), "upper_median")


def floor_percentile(rows: DataFrame, by: Sequence[str], value: str, p: float) -> DataFrame:
    """Place floor(p * n), without interpolation."""
    return _at_place(rows, by, value, lambda n: F.floor(n * p), "percentile")


def _at_place(rows: DataFrame, by: Sequence[str], value: str, place, name: str) -> DataFrame:
    """The value at a 0-based place of each group's ascending order, and n; nulls don't count.

    A first pass finds, by approximate quantiles, ranges of values of nearly equal size; counts
    of the ranges say which one holds the place, and only that range is ranked. So a large group
    is no single task's work.
    """
    held = rows.filter(F.col(value).isNotNull()).select(*by, F.col(value).alias("_v"))
    cuts = held.groupBy(*by).agg(F.percentile_approx("_v", [i / RANGES for i in range(1, RANGES)]).alias("_cuts"))
    same = lambda x, y: reduce(Column.__and__, [F.col(f"{x}.{k}").eqNullSafe(F.col(f"{y}.{k}")) for k in by], F.lit(True))
    ranged = held.alias("h").join(cuts.alias("c"), same("h", "c")).select(*[F.col(f"h.{k}").alias(k) for k in by], "_v", F.size(F.filter("_cuts", lambda c: c < F.col("_v"))).alias("_range"))
    counts = ranged.groupBy(*by, "_range").agg(F.count(F.lit(1)).alias("_c"))
    within = Window.partitionBy(*by)
    counts = counts.withColumn("_before", F.sum("_c").over(within.orderBy("_range")) - F.col("_c")).withColumn("n", F.sum("_c").over(within))
    wanted = counts.withColumn("_at", place(F.col("n"))).filter((F.col("_before") <= F.col("_at")) & (F.col("_at") < F.col("_before") + F.col("_c")))
    few = ranged.alias("r").join(wanted.alias("w"), same("r", "w") & (F.col("r._range") == F.col("w._range"))).select(*[F.col(f"r.{k}").alias(k) for k in by], "_v", "n", "_before", "_at")
    per = few.groupBy(*by, "_v", "n", "_before", "_at").agg(F.count(F.lit(1)).alias("_c"))
    upto = F.col("_before") + F.sum("_c").over(within.orderBy("_v"))
    ranked = per.withColumn("_upto", upto)
    return ranked.filter((F.col("_upto") > F.col("_at")) & (F.col("_upto") - F.col("_c") <= F.col("_at"))).select(*by, F.col("_v").alias(name), "n")


def tie_table(rows: DataFrame, by: Sequence[str], value: str, weight: Column | None = None) -> DataFrame:
    """by, _v, rank: each distinct value's rank from 1, ties at their mean; nulls don't count.

    Values are counted first. Approximate quantiles of a group's distinct values cut them into
    ranges, and a value's rank is what the ranges before hold and what its own holds before it; so
    neither a large group nor a value that many rows share is one task's work.
    """
    ties = rows.filter(F.col(value).isNotNull()).groupBy(*by, F.col(value).alias("_v")).agg(F.sum(F.lit(1) if weight is None else weight).alias("_c"))
    parts = max(RANGES, int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    cuts = ties.groupBy(*by).agg(F.percentile_approx("_v", [i / parts for i in range(1, parts)]).alias("_cuts"))
    ranged = ties.alias("h").join(cuts.alias("c"), _same(by, "h", "c")).select(*[F.col(f"h.{k}").alias(k) for k in by], "_v", "_c", F.size(F.filter("_cuts", lambda c: c < F.col("_v"))).alias("_range"))
    held = ranged.groupBy(*by, "_range").agg(F.sum("_c").alias("_in"))
    held = held.withColumn("_before", F.sum("_in").over(Window.partitionBy(*by).orderBy("_range")) - F.col("_in"))  # a row for each range
    joined = ranged.alias("r").join(held.alias("w"), _same(by, "r", "w") & (F.col("r._range") == F.col("w._range")))
    joined = joined.select(*[F.col(f"r.{k}").alias(k) for k in by], "_v", "_c", F.col("r._range").alias("_range"), "_before")
    upto = F.sum("_c").over(Window.partitionBy(*by, "_range").orderBy("_v"))
    return joined.withColumn("rank", F.col("_before") + upto - (F.col("_c") - 1) / 2).select(*by, "_v", "_c", "rank")


def _same(by: Sequence[str], x: str, y: str) -> Column:
    return reduce(Column.__and__, [F.col(f"{x}.{k}").eqNullSafe(F.col(f"{y}.{k}")) for k in by], F.lit(True))


def average_rank(rows: DataFrame, by: Sequence[str], value: str, name: str) -> DataFrame:
    """``rows`` with ranks from 1, ties at their mean; a null has none."""
    ties = tie_table(rows, by, value).select(*[F.col(k).alias(f"_t{i}") for i, k in enumerate(by)], F.col("_v").alias("_tv"), F.col("rank").alias(name))
    same = reduce(Column.__and__, [F.col(k).eqNullSafe(F.col(f"_t{i}")) for i, k in enumerate(by)], F.col(value) == F.col("_tv"))
    return rows.join(ties, same, "left").drop("_tv", *[f"_t{i}" for i in range(len(by))])


def spearman(rows: DataFrame, by: Sequence[str], x: str, y: str) -> DataFrame:
    """by, rho, n over rows that have both values.

    Equal pairs are one row with their number; mean ranks are known, so one pass of sums gives the
    correlation. rho is null where a side is all ties.
    """
    pairs = rows.filter(F.col(x).isNotNull() & F.col(y).isNotNull()).groupBy(*by, F.col(x).alias("_px"), F.col(y).alias("_py")).agg(F.count(F.lit(1)).alias("_pc"))
    ranked = pairs
    for side in ("x", "y"):
        ties = tie_table(pairs, by, f"_p{side}", F.col("_pc")).select(*[F.col(k).alias(f"_t{i}") for i, k in enumerate(by)], F.col("_v").alias("_tv"), F.col("rank").alias(f"_r{side}"))
        same = reduce(Column.__and__, [F.col(k).eqNullSafe(F.col(f"_t{i}")) for i, k in enumerate(by)], F.col(f"_p{side}") == F.col("_tv"))
        ranked = ranked.join(ties, same).drop("_tv", *[f"_t{i}" for i in range(len(by))])
    n = F.sum("_pc")
    moment = lambda a, b: F.sum(F.col("_pc") * F.col(a) * F.col(b)) - n * (n + 1) / 2 * ((n + 1) / 2)
    rho = F.try_divide(moment("_rx", "_ry"), F.sqrt(moment("_rx", "_rx") * moment("_ry", "_ry")))
    return ranked.groupBy(*by).agg(rho.alias("rho"), n.alias("n"))


def best_two(rows: DataFrame, by: Sequence[str], value: str, digits: int = 1) -> DataFrame:
    """Rows with the best or second best distinct rounded value."""
    place = F.dense_rank().over(Window.partitionBy(*by).orderBy(F.round(value, digits).desc()))
    return rows.withColumn("place", place).filter("place <= 2")


def half_even(value: Column, digits: int) -> Column:
    return F.bround(value, digits)


def bootstrap(values: DataFrame, by: Sequence[str], value: str, draws: int = 1000, seed: int = 0, upper_less_one: bool = False, chunk: int = 8192) -> DataFrame:
    """Percentile interval of the mean, n of n values drawn with replacement, from one seed a group."""
    means = bootstrap_means(values, by, value, draws, seed, chunk)
    lo, hi = _bounds(F.slice("means", 2, draws), draws, upper_less_one)
    return means.select(*by, F.col("means")[0].alias("mean"), lo.alias("lo"), hi.alias("hi"), "n")


def independent_delta(values: DataFrame, by: Sequence[str], left: str, right: str, draws: int = 1000, seed: int = 0) -> DataFrame:
    """Mean of right - left over rows that have both, with an interval from draws of either side by itself.

    The point is paired, the interval is not: it is that of two independent samples.
    """
    rows = values.filter(F.col(left).isNotNull() & F.col(right).isNotNull())
    sides = [bootstrap_means(rows, by, c, draws, seed + i).withColumnsRenamed({"means": f"_{i}", "n": f"_n{i}"}) for i, c in enumerate((left, right))]
    both = sides[0].join(sides[1], list(by)) if by else sides[0].crossJoin(sides[1])  # one row without groups
    delta = F.zip_with("_0", "_1", lambda a, b: b - a)
    lo, hi = _bounds(F.slice(delta, 2, draws), draws, False)
    return both.select(*by, delta[0].alias("delta"), lo.alias("lo"), hi.alias("hi"), F.col("_n0").alias("n"))


def _bounds(sample: Column, draws: int, upper_less_one: bool) -> tuple[Column, Column]:
    ordered = F.array_sort(sample)
    return ordered[int(0.025 * draws)], ordered[min(draws - 1, int(0.975 * draws)) - upper_less_one]


def bootstrap_means(values: DataFrame, by: Sequence[str], value: str, draws: int = 1000, seed: int = 0, chunk: int = 8192) -> DataFrame:
    """by, means (the mean, then those of the draws), n.

    A group's distinct values are dealt by hash into chunks of about ``chunk``. Every chunk makes the same multinomial split of a draw over the chunks and draws
    its own share, which is the draw from the whole group; no task holds more than a chunk and ``draws`` numbers for each 64 chunks.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for own, v, c, chunks, sizes in zip(pdf["chunk"], pdf["v"], pdf["c"], pdf["chunks"], pdf["sizes"], strict=True):
                n, v, c = sum(sizes), np.asarray(v, "f8"), np.asarray(c)
                sums = [float(c @ v)]
                if c.sum():
                    shares = np.random.default_rng([seed, 0]).multinomial(n, np.asarray(sizes) / n, draws)[:, list(chunks).index(own)]
                    rng, p = np.random.default_rng([seed, 1 + own]), c / c.sum()
                    sums += [float(rng.multinomial(k, p) @ v) for k in shares]
                out.append(sums if len(sums) > 1 else [0.0] * (draws + 1))
            yield pdf[keys].assign(chunk=pdf["chunk"], n=[sum(x) for x in pdf["sizes"]], sums=out)

    def joined(left: DataFrame, right: DataFrame) -> DataFrame:
        named = right.withColumnsRenamed({k: f"{k}_" for k in keys})
        return left.join(named, reduce(Column.__and__, [F.col(k).eqNullSafe(F.col(f"{k}_")) for k in keys], F.lit(True))).drop(*[f"{k}_" for k in keys])

    def added(rows: DataFrame, at: list[str]) -> DataFrame:
        """The sums of some chunks, in the order of chunks."""
        whole = rows.groupBy(*keys, "n", *at).agg(F.array_sort(F.collect_list(F.struct(F.col("chunk").alias("i"), "sums"))).alias("x"))
        return whole.withColumn("sums", F.aggregate(F.slice("x", 2, F.size("x")), F.col("x")[0]["sums"], lambda acc, y: F.zip_with(acc, y["sums"], lambda l, r: l + r))).drop("x")

    keys = [f"k{i}" for i in range(len(by))]
    kinds = "".join(f"k{i} {values.schema[k].dataType.simpleString()}, " for i, k in enumerate(by))
    held = values.select(*[F.col(k).alias(f"k{i}") for i, k in enumerate(by)], F.col(value).cast("double").alias("v"))
    held = held.withColumn("v", F.when(~F.isnan("v"), F.col("v"))).groupBy(*keys, "v").agg(F.count("v").alias("c"))
    parts = joined(held, held.groupBy(*keys).agg(F.ceil(F.count(F.lit(1)) / chunk).alias("parts")))
    parts = parts.withColumn("chunk", F.pmod(F.xxhash64("v"), "parts")).groupBy(*keys, "chunk")
    parts = parts.agg(F.array_sort(F.collect_list(F.struct(F.coalesce("v", F.lit(0.0)).alias("v"), "c"))).alias("x"), F.sum("c").alias("size"))
    sizes = parts.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("chunk", "size"))).alias("s")).select(*keys, F.col("s.chunk").alias("chunks"), F.col("s.size").alias("sizes"))
    dealt = joined(parts.select(*keys, "chunk", F.col("x.v").alias("v"), F.col("x.c").alias("c")), sizes)
    tasks = int(values.sparkSession.conf.get("spark.sql.shuffle.partitions"))  # small rows with much to draw, which AQE would put into one task
    drawn = dealt.repartition(tasks).mapInPandas(run, f"{kinds}chunk long, n long, sums array<double>")
    some = added(drawn.withColumn("part", F.floor(F.col("chunk") / 64)), ["part"]).withColumnRenamed("part", "chunk")
    means = added(some, []).withColumn("sums", F.transform("sums", lambda x: F.try_divide(x, F.col("n"))))
    return means.select(*[F.col(f"k{i}").alias(k) for i, k in enumerate(by)], F.col("sums").alias("means"), "n")


def balanced_f1(labels: DataFrame, by: Sequence[str], truth: str, guess: str) -> DataFrame:
    """Mean of the F1 of both classes."""
    t, g = F.col(truth), F.col(guess)
    f1 = lambda yes: F.try_divide(2 * F.count_if(yes(t) & yes(g)), F.count_if(yes(t)) + F.count_if(yes(g)))
    return labels.groupBy(*by).agg(((f1(lambda c: c) + f1(lambda c: ~c)) / 2).alias("balanced_f1"), F.count(F.lit(1)).alias("n"))


def pooled_f1(labels: DataFrame, judged: DataFrame, keys: Sequence[str], cluster: str, rater: str) -> DataFrame:
    """cluster, judge, raters, percentile, n_raters, n: a judge against a pool of raters, and each rater against the others.

    ``labels`` (keys, cluster, rater, label) and ``judged`` (keys, cluster, label). Who labels is compared with every other
    label of the item: those of an item are its sums less the rater's own, so nothing is paired. The F1 of
    either class is taken over a cluster's comparisons and both are averaged. raters is the raters' mean weighted by
    their comparisons, percentile the share of them below the judge. A rater or judge without one of the
    classes has no F1 and doesn't count.
    """
    sums = labels.filter(F.col("label").isNotNull()).groupBy(*keys, cluster).agg(F.count_if("label").alias("_yes"), F.count("label").alias("_all"))
    own = F.col("label").cast("int")
    one = labels.filter(F.col("label").isNotNull()).join(sums, [*keys, cluster]).select(cluster, F.col(rater).cast("string").alias("_who"), "label", (F.col("_yes") - own).alias("_yes"), (F.col("_all") - 1).alias("_all"))
    judge = judged.filter(F.col("label").isNotNull()).join(sums, [*keys, cluster]).select(cluster, F.lit(None).cast("string").alias("_who"), "label", "_yes", "_all")
    yes, no = F.col("_yes"), F.col("_all") - F.col("_yes")
    said = F.col("label")
    add = lambda where, count: F.sum(F.when(where, count).otherwise(0))
    f1 = lambda mine, theirs, others: F.try_divide(2 * add(mine, theirs), 2 * add(mine, theirs) + add(mine, others) + add(~mine, theirs))
    per = one.unionByName(judge).groupBy(cluster, F.col("_who").isNull().alias("_judge"), "_who").agg(((f1(said, yes, no) + f1(~said, no, yes)) / 2).alias("_f1"), F.sum("_all").alias("_n"))
    own_f1 = F.max(F.when(F.col("_judge"), F.col("_f1"))).over(Window.partitionBy(cluster))  # a row for each rater of a cluster
    per = per.withColumn("_model", own_f1)
    rated = ~F.col("_judge") & F.col("_f1").isNotNull()
    below = F.count_if(rated & (F.col("_f1") < F.col("_model")))
    mean = F.try_divide(F.sum(F.when(rated, F.col("_n") * F.col("_f1"))), F.sum(F.when(rated, F.col("_n"))))
    share = F.when(F.max("_model").isNotNull(), F.try_divide(100.0 * below, F.count_if(rated)))
    return per.groupBy(cluster).agg(F.max("_model").alias("judge"), mean.alias("raters"), share.alias("percentile"), F.count_if(rated).alias("n_raters"), F.sum(F.when(F.col("_judge"), F.col("_n"))).alias("n"))
