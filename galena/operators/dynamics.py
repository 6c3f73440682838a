"""Training logs: merging, sampling, spikes, drift, re-exposure."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from galena.operators.stats import upper_median


#: What errors of a failed edit hold: its length was out of bounds, or the endpoint failed (fixed values).
BAND_ERROR, ENDPOINT_ERRORS = "LengthOutOfBand", ("JudgeUnavailable", "JSONDecode")


def merged_log(events: DataFrame, keys: Sequence[str], value: str, order: Sequence[str]) -> DataFrame:
    """Of resumed runs the later value of each key."""
    return events.groupBy(*keys).agg(F.max_by(value, F.struct(*order)).alias(value))


def spikes(log: DataFrame, by: Sequence[str], step: str, value: str, times: float) -> DataFrame:
    """Steps whose value is over ``times`` the group's median."""
    middle = log.groupBy(*by).agg(F.median(value).alias("median"))
    return log.join(middle, list(by)).filter(F.col(value) > times * F.col("median")).select(*by, step, value, "median")


def drift(log: DataFrame, by: Sequence[str], step: str, value: str, early: tuple[int, int], late: tuple[int, int], least: int) -> DataFrame:
    """Mean of the late window less that of the early one; null where a window has too few steps."""
    held = {n: F.col(step).between(*w) for n, w in (("early", early), ("late", late))}
    mean = lambda n: F.when(F.count_if(held[n]) >= least, F.avg(F.when(held[n], F.col(value)))).alias(n)
    return log.groupBy(*by).agg(mean("early"), mean("late")).withColumn("drift", F.col("late") - F.col("early"))


def stability(log: DataFrame, arm: str, seed: str, original: Column, step: str, norm: str, entropy: str, early: tuple[int, int], late: tuple[int, int], least: int, times: float = 3.0, margin: float = 0.05) -> DataFrame:
    """Of every replicate (runs that aren't ``original``): steps, norm_median, spikes, drift, most (the largest drift of its arm's originals) and flagged.

    spikes are the steps whose norm is over ``times`` the run's median, by step; a replicate is flagged if its drift is
    over ``most`` by more than ``margin``. One aggregation by run, joined with its own medians only for the spikes.
    """
    runs = log.withColumn("_original", original)
    moved = drift(runs, [arm, seed, "_original"], step, entropy, early, late, least)
    most = moved.filter("_original").groupBy(arm).agg(F.max("drift").alias("most"))
    held = runs.filter(~F.col("_original"))
    whole = held.groupBy(arm, seed).agg(F.max(step).alias("steps"), F.median(norm).alias("norm_median"))
    high = spikes(held.filter(F.col(norm).isNotNull()), [arm, seed], step, norm, times).groupBy(arm, seed).agg(F.array_sort(F.collect_list(F.struct(F.col(step).alias("step"), F.col(norm).alias("norm")))).alias("spikes"))
    out = whole.join(moved.filter(~F.col("_original")).select(arm, seed, "drift"), [arm, seed]).join(most, arm, "left").join(high, [arm, seed], "left")
    return out.withColumn("flagged", F.coalesce(F.col("drift") > F.col("most") + margin, F.lit(False)))


def pair_diagnostics(pairs: DataFrame, tolerance: float = 0.25) -> DataFrame:
    """what, n, median: why pairs of edits were or weren't matched, and how well the matched ones are.

    ``pairs`` (size, left, right, left_error, right_error): characters of the original, and of what each edit added (null if there is no
    text). Reasons: matched, unmatched (they differ by more than ``tolerance`` of the larger), not_attempted (a side has
    neither text nor error), missing_length_band, missing_endpoint and missing_other, by the errors. Then upper medians, to one
    digit, of the added percentages, of the difference within pairs, and of the original's size inside and outside the matched ones.
    """
    left, right, size = F.col("left"), F.col("right"), F.greatest(F.coalesce("size", F.lit(0)), F.lit(1))
    error = lambda side: F.coalesce(f"{side}_error", F.lit(""))
    untried = lambda side: F.col(side).isNull() & (error(side) == "")
    errors, most = F.concat_ws(" ", error("left"), error("right")), F.greatest(left, right)
    reason = (
        F.when(untried("left") | untried("right"), "not_attempted").when(left.isNotNull() & right.isNotNull(), F.when(F.abs(left - right) <= tolerance * most, "matched").otherwise("unmatched"))
        .when(errors.contains(BAND_ERROR), "missing_length_band").when(errors.rlike("|".join(ENDPOINT_ERRORS)), "missing_endpoint").otherwise("missing_other")
    )
    rows = pairs.select(reason.alias("what"), left.alias("l"), right.alias("r"), size.cast("double").alias("size"))
    counts = rows.groupBy("what").agg(F.count(F.lit(1)).alias("n")).withColumn("median", F.lit(None).cast("double"))
    inside = F.col("what") == "matched"
    value = lambda name, x: F.struct(F.lit(name).alias("what"), x.cast("double").alias("v"))
    own = F.array(value("left_percent", 100 * F.col("l") / F.col("size")), value("right_percent", 100 * F.col("r") / F.col("size")), value("difference_percent", F.try_divide(100.0 * F.abs(F.col("l") - F.col("r")), F.greatest("l", "r"))), value("size_in", F.col("size")))
    long = rows.filter(F.col("what") != "not_attempted").select(F.inline(F.when(inside, own).otherwise(F.array(value("size_out", F.col("size"))))))
    medians = upper_median(long, ["what"], "v").select("what", "n", F.bround("upper_median", 1).alias("median"))
    return counts.unionByName(medians)


def group_decisions(attempts: DataFrame, group: str, member: str, attempt: str, ok: Column, score: str, error: str) -> DataFrame:
    """group, member, disposition, reward, attempts, error: what becomes of each member of a judged group.

    A group's attempt counts if all its members' calls went well. The first of at most two that counts gives the rewards; if
    neither does, the whole group earns nothing and carries the last attempt's first error. One aggregation by group: members stay within its row.
    """
    tries = attempts.filter(F.col(attempt) < 2).groupBy(group, attempt).agg(
        F.min(ok).alias("_ok"), F.array_sort(F.collect_list(F.struct(F.col(member).alias("member"), F.col(score).cast("double").alias("score")))).alias("_members"), F.min_by(error, F.when(F.col(error).isNotNull(), F.col(member))).alias("_error"),
    )
    good = F.when(F.coalesce("_ok", F.lit(False)), F.col(attempt))
    groups = tries.groupBy(group).agg(F.min_by("_members", good).alias("_good"), F.max_by("_members", attempt).alias("_last"), F.max_by("_error", attempt).alias("_error"), F.coalesce(F.min(good), F.max(attempt)).alias("_at"))
    failed = F.col("_good").isNull()
    rows = groups.withColumn("_m", F.explode(F.when(failed, F.col("_last")).otherwise(F.col("_good"))))
    return rows.select(
        group, F.col("_m.member").alias(member), F.when(failed, "failed").otherwise("accepted").alias("disposition"), F.when(failed, 0.0).otherwise(F.col("_m.score")).alias("reward"),
        (F.col("_at") + 1).cast("int").alias("attempts"), F.when(failed, F.col("_error")).alias("error"),
    )


def reexposure(rollouts: DataFrame, key: str, order: Sequence[str], state: str, stage: str, bin_col: str, fixed: str) -> DataFrame:
    """Every later exposure against the first, in cells (state), (state, stage) and (state, bin)."""
    w = Window.partitionBy(key).orderBy(*order)
    first = rollouts.withColumns({"_s": F.first(state).over(w), "_b": F.first(bin_col).over(w), "_n": F.row_number().over(w)})
    later = first.filter("_n > 1").select(F.col("_s").alias("state"), F.col(stage).alias("stage"), F.col("_b").alias("bin"), F.col(fixed).cast("double").alias("fixed"))
    cells = later.groupingSets([["state"], ["state", "stage"], ["state", "bin"]], "state", "stage", "bin").agg(F.avg("fixed").alias("rate"), F.count(F.lit(1)).alias("n"))
    return cells.withColumns({c: F.coalesce(F.col(c).cast("string"), F.lit("all")) for c in ("stage", "bin")})


def edit_deltas(scores: DataFrame, keys: Sequence[str], variant: str, base: str, score: str) -> DataFrame:
    """Per variant: mean change against the base variant, share up and down beyond 1e-9, unchanged."""
    orig = scores.filter(F.col(variant) == base).groupBy(*keys).agg(F.max(score).alias("_base"))
    d = scores.filter(F.col(variant) != base).join(orig, list(keys)).withColumn("d", F.col(score) - F.col("_base"))
    return d.groupBy(variant).agg(F.avg("d").alias("delta"), F.avg((F.col("d") > 1e-9).cast("double")).alias("up"), F.avg((F.col("d") < -1e-9).cast("double")).alias("down"), F.count_if(F.abs("d") <= 1e-9).alias("zero"), F.count(F.lit(1)).alias("n"))


def matched_pairs(edits: DataFrame, keys: Sequence[str], variant: str, size: str, left: str, right: str, tolerance: float = 0.25) -> DataFrame:
    """Keys with both variants, and why others or unequal ones are left out."""
    side = edits.groupBy(*keys).agg(F.max(F.when(F.col(variant) == left, F.col(size))).alias("l"), F.max(F.when(F.col(variant) == right, F.col(size))).alias("r"))
    reason = (
        F.when(F.col("l").isNull() & F.col("r").isNull(), "no_both").when(F.col("l").isNull(), "no_left").when(F.col("r").isNull(), "no_right")
        .when(F.abs(F.col("l") - F.col("r")) > tolerance * F.greatest("l", "r"), "length").otherwise("matched")
    )
    return side.withColumn("reason", reason)


def identical_share(log: DataFrame, by: Sequence[str], names: Sequence[str], metrics: str = "data") -> DataFrame:
    """100 less the mean percentage of mixed groups, by the first metric name that is there."""
    value = F.coalesce(*[F.col(metrics)[n] for n in names])
    return log.groupBy(*by).agg((100 * (1 - F.avg(value))).alias("identical"), F.count(value).alias("steps"))


def repeat_merge(draws: DataFrame, keys: Sequence[str], k: str, met: str) -> DataFrame:
    """Verdict of each criterion by strict majority of its draws."""
    return draws.groupBy(*keys, k).agg((2 * F.count_if(F.col(met)) > F.count(met)).alias(met), F.count(met).alias("draws"))


def fail_closed(attempts: DataFrame, group: str, attempt: str, ok: str, reward: str) -> DataFrame:
    """A group's reward by its first attempt that worked, of two; zero if none did."""
    tries = attempts.groupBy(group, attempt).agg(F.min(F.coalesce(ok, F.lit(False))).alias("ok"), F.avg(reward).alias("reward"))
    best = tries.groupBy(group).agg(F.min_by("reward", F.when(F.col("ok") & (F.col(attempt) < 2), F.col(attempt))).alias("reward"))
    return best.withColumn("failed", F.col("reward").isNull()).withColumn("reward", F.coalesce("reward", F.lit(0.0)))


def rolling_rate(requests: DataFrame, by: Sequence[str], ts: str, tokens: str, seconds: int = 60) -> DataFrame:
    """Requests and tokens of the last ``seconds`` at each request."""
    w = Window.partitionBy(*by).orderBy(F.unix_micros(F.col(ts).cast("timestamp"))).rangeBetween(-seconds * 1_000_000, 0)
    return requests.withColumns({"requests": F.count(F.lit(1)).over(w), "tokens": F.sum(tokens).over(w)})
