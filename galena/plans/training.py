"""Queries on training logs, audits, dataset builds and streams."""

from __future__ import annotations

import json

from pyspark.sql import functions as F

from galena.functions import rubric as R
from galena.functions import text as X
from galena.operators import dynamics as D
from galena.operators import grades as G
from galena.operators import judge as J
from galena.plans import views as V
from galena.sources.shared import shared_folder
from galena.streaming import logs as L

QUERIES, SQL = {}, {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            SQL[f.__name__] = V.SQL_WITH + sql
        return f

    return add


def _events(spark, d):
    return V.table(spark, d, "events").select("event_id", "ts", "user_id", F.col("event_type").alias("metric"), F.dayofmonth("ts").alias("step"), "value")


@query("SELECT metric, step, value FROM (SELECT event_type AS metric, day(ts) AS step, value, row_number() OVER (PARTITION BY event_type, day(ts) ORDER BY ts DESC, event_id DESC) AS r FROM events) WHERE r = 1")
def event_log_merge(spark, d):
    return D.merged_log(_events(spark, d), ["metric", "step"], "value", ["ts", "event_id"])


SQL_DAILY = "daily AS (SELECT event_type AS metric, day(ts) AS step, sum(value) AS v FROM events GROUP BY ALL)"


def _daily(spark, d):
    return _events(spark, d).groupBy("metric", "step").agg(F.sum("value").alias("v"))


@query(f", {SQL_DAILY}, m AS (SELECT metric, median(v) AS med FROM daily GROUP BY metric) SELECT metric, step, round(v, 4) AS v, round(med, 4) AS median FROM daily JOIN m USING (metric) WHERE v > 1.1 * med")
def grad_spikes(spark, d):
    return D.spikes(_daily(spark, d), ["metric"], "step", "v", 1.1).select("metric", "step", F.round("v", 4).alias("v"), F.round("median", 4).alias("median"))


@query(f""", {SQL_DAILY}, w AS (SELECT metric, CASE WHEN count(*) FILTER (WHERE step BETWEEN 1 AND 10) >= 8 THEN avg(v) FILTER (WHERE step BETWEEN 1 AND 10) END AS early,
    CASE WHEN count(*) FILTER (WHERE step BETWEEN 21 AND 30) >= 8 THEN avg(v) FILTER (WHERE step BETWEEN 21 AND 30) END AS late FROM daily GROUP BY metric)
    SELECT metric, round(late - early, 4) AS drift FROM w""")
def entropy_drift(spark, d):
    return D.drift(_daily(spark, d), ["metric"], "step", "v", (1, 10), (21, 30), 8).select("metric", F.round("drift", 4).alias("drift"))


SQL_STABLE = """d AS (SELECT event_type AS arm, user_id % 4 AS seed, day(ts) AS step, sum(value) AS norm, avg(value) AS entropy FROM events GROUP BY ALL),
    w AS (SELECT arm, seed, CASE WHEN count(*) FILTER (WHERE step BETWEEN 21 AND 30) >= 8 THEN avg(entropy) FILTER (WHERE step BETWEEN 21 AND 30) END - CASE WHEN count(*) FILTER (WHERE step BETWEEN 1 AND 10) >= 8 THEN avg(entropy) FILTER (WHERE step BETWEEN 1 AND 10) END AS drift,
      max(step) AS steps, median(norm) AS med FROM d GROUP BY ALL)"""


@query(f""", {SQL_STABLE}, o AS (SELECT arm, max(drift) AS most FROM w WHERE seed < 2 GROUP BY arm),
    x AS (SELECT arm, seed, count(*) AS n, string_agg(CAST(step AS VARCHAR), ',' ORDER BY step) AS places FROM d JOIN w USING (arm, seed) WHERE norm > 1.15 * med GROUP BY ALL)
    SELECT arm, seed, CAST(steps AS INTEGER) AS steps, round(med, 4) AS norm_median, coalesce(n, 0) AS n_spikes, coalesce(places, '') AS spikes, round(drift, 4) AS drift, round(most, 4) AS most, coalesce(drift > most + 0.05, false) AS flagged
    FROM w LEFT JOIN o USING (arm) LEFT JOIN x USING (arm, seed) WHERE seed >= 2""")
def stability_flags(spark, d):
    """Replicates of each arm: spikes over the run's median, and whether their drift exceeds that of all original seeds."""
    daily = _events(spark, d).groupBy(F.col("metric").alias("arm"), (F.col("user_id") % 4).alias("seed"), "step").agg(F.sum("value").alias("norm"), F.avg("value").alias("entropy"))
    out = D.stability(daily, "arm", "seed", F.col("seed") < 2, "step", "norm", "entropy", (1, 10), (21, 30), 8, 1.15)
    at = F.coalesce(F.array_join(F.transform("spikes", lambda x: x["step"].cast("string")), ","), F.lit(""))
    return out.select("arm", "seed", F.col("steps").cast("int").alias("steps"), F.round("norm_median", 4).alias("norm_median"), F.coalesce(F.size("spikes"), F.lit(0)).cast("long").alias("n_spikes"), at.alias("spikes"), F.round("drift", 4).alias("drift"), F.round("most", 4).alias("most"), "flagged")


@query(""", e AS (SELECT length(coalesce(text, '')) AS n, doc_id FROM documents),
    p AS (SELECT greatest(n, 1) AS size, CASE WHEN doc_id % 11 > 0 THEN 40 + n % 97 END AS l, CASE WHEN doc_id % 7 > 0 THEN 30 + doc_id % 89 END AS r, CASE doc_id % 3 WHEN 0 THEN 'LengthOutOfBand' WHEN 1 THEN 'JudgeUnavailable: x' END AS le, CASE WHEN doc_id % 2 = 0 THEN 'ValueError' END AS re FROM e),
    w AS (SELECT *, CASE WHEN (l IS NULL AND le IS NULL) OR (r IS NULL AND re IS NULL) THEN 'not_attempted' WHEN l IS NOT NULL AND r IS NOT NULL THEN CASE WHEN abs(l - r) <= 0.25 * greatest(l, r) THEN 'matched' ELSE 'unmatched' END
      WHEN contains(coalesce(le, '') || ' ' || coalesce(re, ''), 'LengthOutOfBand') THEN 'missing_length_band' WHEN contains(coalesce(le, ''), 'JudgeUnavailable') THEN 'missing_endpoint' ELSE 'missing_other' END AS what FROM p),
    v AS (SELECT 'left_percent' AS what, 100 * l / size AS v FROM w WHERE what = 'matched' UNION ALL SELECT 'right_percent', 100 * r / size FROM w WHERE what = 'matched' UNION ALL SELECT 'difference_percent', 100 * abs(l - r) / greatest(l, r) FROM w WHERE what = 'matched'
      UNION ALL SELECT CASE WHEN what = 'matched' THEN 'size_in' ELSE 'size_out' END, size FROM w WHERE what <> 'not_attempted')
    SELECT what, count(*) AS n, CAST(NULL AS DOUBLE) AS median FROM w GROUP BY what UNION ALL SELECT what, count(*), round_even(list_sort(list(CAST(v AS DOUBLE)))[count(*) // 2 + 1], 1) FROM v GROUP BY what""")
def pair_diagnostics(spark, d):
    """Why pairs of edits were or weren't matched, with medians in and out."""
    n, i = F.length(F.coalesce("text", F.lit(""))), F.col("doc_id")
    pairs = V.table(spark, d, "documents").select(
        n.alias("size"), F.when(i % 11 > 0, 40 + n % 97).alias("left"), F.when(i % 7 > 0, 30 + i % 89).alias("right"),
        F.when(i % 3 == 0, "LengthOutOfBand").when(i % 3 == 1, "JudgeUnavailable: x").alias("left_error"), F.when(i % 2 == 0, "ValueError").alias("right_error"),
    )
    return D.pair_diagnostics(pairs)


@query(""", a AS (SELECT l_orderkey AS g, u.t AS attempt, l_linenumber * 1000000 + l_partkey AS m, l_quantity + u.t AS score, CASE WHEN (l_partkey + l_suppkey + u.t * 3) % 13 = 0 THEN 'call ' || CAST(l_partkey AS VARCHAR) END AS err FROM lineitem, (VALUES (0), (1), (2)) u(t)),
    t AS (SELECT g, attempt, count(err) = 0 AS ok FROM a WHERE attempt < 2 GROUP BY ALL), b AS (SELECT g, min(attempt) FILTER (WHERE ok) AS good FROM t GROUP BY g)
    SELECT a.g, m, CASE WHEN good IS NULL THEN 'failed' ELSE 'accepted' END AS disposition, CASE WHEN good IS NULL THEN 0 ELSE score END AS reward, CAST(coalesce(good, 1) + 1 AS INTEGER) AS attempts,
      CASE WHEN good IS NULL THEN arg_min(err, m) FILTER (WHERE err IS NOT NULL) OVER (PARTITION BY a.g) END AS error FROM a JOIN b ON b.g = a.g AND a.attempt = coalesce(good, 1)""")
def group_decisions(spark, d):
    """Groups judged at most twice: the first attempt without a failed call counts, and a group without one earns nothing."""
    tries = F.explode(F.array(*[F.lit(t) for t in range(3)]))
    rows = V.table(spark, d, "lineitem").select(F.col("l_orderkey").alias("g"), (F.col("l_linenumber") * 1000000 + F.col("l_partkey")).alias("m"), "l_partkey", "l_suppkey", "l_quantity", tries.alias("attempt"))
    err = F.when((F.col("l_partkey") + F.col("l_suppkey") + F.col("attempt") * 3) % 13 == 0, F.concat(F.lit("call "), F.col("l_partkey").cast("string")))
    rows = rows.withColumns({"err": err, "score": F.col("l_quantity") + F.col("attempt")})
    return D.group_decisions(rows, "g", "m", "attempt", F.col("err").isNull(), "score", "err")


@query(""", x AS (SELECT *, row_number() OVER w AS n, first_value(floor(value / 25)) OVER w AS s, first_value(event_type) OVER w AS b FROM events
      WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
    y AS (SELECT s AS state, CASE WHEN day(ts) <= 15 THEN 'early' ELSE 'late' END AS stage, b AS bin, CAST(value > 50 AS INTEGER) AS fixed FROM x WHERE n > 1)
    SELECT CAST(state AS BIGINT) AS state, coalesce(stage, 'all') AS stage, coalesce(bin, 'all') AS bin, round(avg(fixed), 6) AS rate, count(*) AS n
    FROM y GROUP BY GROUPING SETS ((state), (state, stage), (state, bin))""")
def reexposure_grouping_sets(spark, d):
    rows = _events(spark, d).withColumns({"state": F.floor(F.col("value") / 25), "stage": F.when(F.col("step") <= 15, "early").otherwise("late"), "fixed": F.col("value") > 50})
    return D.reexposure(rows, "user_id", ["ts", "event_id"], "state", "stage", "metric", "fixed").withColumn("rate", F.round("rate", 6))


@query(f""", {SQL_DAILY}, p AS (SELECT step % 3 AS run, step, coalesce(max(CASE WHEN metric = (SELECT min(metric) FROM daily) AND step % 2 = 0 THEN v END), max(CASE WHEN metric = (SELECT max(metric) FROM daily) THEN v END)) / 100000 AS f FROM daily GROUP BY step)
    SELECT run, round(100 * (1 - avg(f)), 4) AS identical, count(f) AS steps FROM p GROUP BY run""")
def identical_reward_share(spark, d):
    daily = _daily(spark, d)
    lo, hi = daily.agg(F.min("metric"), F.max("metric")).first()
    steps = daily.filter(~((F.col("metric") == lo) & (F.col("step") % 2 == 1))).groupBy((F.col("step") % 3).alias("run"), "step")
    data = steps.agg(F.map_from_entries(F.collect_list(F.struct("metric", F.col("v") / 100000))).alias("data"))
    return D.identical_share(data, ["run"], [lo, hi]).withColumn("identical", F.round("identical", 4))


SQL_EDITS = "e AS (SELECT user_id AS id, event_type AS variant, max(value) AS score FROM events GROUP BY ALL), b AS (SELECT min(variant) AS base, max(variant) AS other FROM e)"


def _edits(spark, d):
    return V.table(spark, d, "events").groupBy(F.col("user_id").alias("id"), F.col("event_type").alias("variant")).agg(F.max("value").alias("score"))


@query(f""", {SQL_EDITS}, x AS (SELECT a.variant, a.score - o.score AS d FROM e a JOIN e o ON o.id = a.id AND o.variant = (SELECT base FROM b) WHERE a.variant <> (SELECT base FROM b))
    SELECT variant, round(avg(d), 6) AS delta, round(avg(CAST(d > 1e-9 AS INTEGER)), 6) AS up, round(avg(CAST(d < -1e-9 AS INTEGER)), 6) AS down, count(*) FILTER (WHERE abs(d) <= 1e-9) AS zero, count(*) AS n FROM x GROUP BY variant""")
def edit_delta_table(spark, d):
    edits = _edits(spark, d)
    out = D.edit_deltas(edits, ["id"], "variant", edits.agg(F.min("variant")).first()[0], "score")
    return out.withColumns({c: F.round(c, 6) for c in ("delta", "up", "down")})


@query(f""", {SQL_EDITS}, x AS (SELECT id, max(CASE WHEN variant = base THEN score END) AS l, max(CASE WHEN variant = other THEN score END) AS r FROM e, b GROUP BY id)
    SELECT CASE WHEN l IS NULL AND r IS NULL THEN 'no_both' WHEN l IS NULL THEN 'no_left' WHEN r IS NULL THEN 'no_right' WHEN abs(l - r) > 0.05 * greatest(l, r) THEN 'length' ELSE 'matched' END AS reason, count(*) AS n FROM x GROUP BY 1""")
def matched_pairs(spark, d):
    edits = _edits(spark, d)
    lo, hi = edits.agg(F.min("variant"), F.max("variant")).first()
    return D.matched_pairs(edits, ["id"], "variant", "score", lo, hi, 0.05).groupBy("reason").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT status, round(avg(CAST(NOT met AS INTEGER)), 6) AS unmet, count(*) AS n FROM (SELECT id, status, met FROM log WHERE met IS NOT NULL QUALIFY row_number() OVER (PARTITION BY id, status ORDER BY k DESC, ts DESC, p DESC, s DESC) = 1) GROUP BY status")
def unmet_rate_by_variant(spark, d):
    """The verdict of the last criterion of each question, by variant."""
    last = V.log(spark, d).filter("met is not null").groupBy("id", "status").agg(F.max_by("met", F.struct("k", *V.LATEST)).alias("met"))
    return last.groupBy("status").agg(F.round(F.avg((~F.col("met")).cast("double")), 6).alias("unmet"), F.count(F.lit(1)).alias("n"))


@query("SELECT id, k, 2 * count(*) FILTER (WHERE met) > count(met) AS met, count(met) AS draws FROM log GROUP BY id, k")
def repeat_majority(spark, d):
    return D.repeat_merge(V.log(spark, d), ["id"], "k", "met")


@query(""", t AS (SELECT id, k % 3 AS attempt, min(CAST(met IS NOT NULL AS INTEGER)) AS ok, avg(w) AS reward FROM log GROUP BY ALL),
    b AS (SELECT id, arg_min(reward, attempt) FILTER (WHERE ok = 1 AND attempt < 2) AS reward FROM t GROUP BY id)
    SELECT id, round(coalesce(reward, 0), 6) AS reward, reward IS NULL AS failed FROM b""")
def group_fail_closed(spark, d):
    rows = V.log(spark, d).select("id", (F.col("k") % 3).alias("attempt"), F.col("met").isNotNull().alias("ok"), "w")
    return D.fail_closed(rows, "id", "attempt", "ok", "w").select("id", F.round("reward", 6).alias("reward"), "failed")


@query("""SELECT event_id, count(*) OVER w AS requests, round(sum(value) OVER w, 4) AS tokens FROM events
    WINDOW w AS (PARTITION BY user_id ORDER BY ts RANGE BETWEEN INTERVAL 6 HOURS PRECEDING AND CURRENT ROW)""")
def rolling_qpm_window(spark, d):
    out = D.rolling_rate(V.table(spark, d, "events"), ["user_id"], "ts", "value", 6 * 3600)
    return out.select("event_id", "requests", F.round("tokens", 4).alias("tokens"))


@query("SELECT date_trunc('day', ts) AS start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY ALL")
def tumbling_window(spark, d):
    """Ours: logs of the kind this library reads have no wall-clock windows."""
    return L.tumbling(V.table(spark, d, "events"), "ts", "1 day", ["event_type"], "value").withColumn("total", F.round("total", 4))


@query(""", x AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) < INTERVAL 6 HOURS THEN 0 ELSE 1 END AS fresh, event_id FROM events),
    y AS (SELECT *, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS s FROM x)
    SELECT user_id, min(ts) AS start, max(ts) + INTERVAL 6 HOURS AS "end", count(*) AS n FROM y GROUP BY user_id, s""")
def session_window(spark, d):
    """Ours, likewise."""
    return L.sessions(V.table(spark, d, "events"), "ts", "6 hours", ["user_id"])


@query("""SELECT 'q' || CAST(id AS VARCHAR) AS id, len(r) AS n_criteria, list_transform(r, lambda c: c.weight) AS weights, round(list_sum(list_transform(r, lambda c: abs(c.weight))), 6) AS whole FROM rubric""")
def export_projection(spark, d):
    r = F.col("r")
    return V.rubric(spark, d).select(F.concat(F.lit("q"), F.col("id").cast("string")).alias("id"), F.size(r).cast("long").alias("n_criteria"), F.col("r.weight").alias("weights"), F.round(R.total(r, lambda c: F.abs(c.weight)), 6).alias("whole"))


@query("""SELECT count(*) AS rows, min(len(r)) AS fewest, max(len(r)) AS most, round(avg(len(r)), 6) AS mean, sum(len(list_filter(r, lambda c: c.weight < 0)))::BIGINT AS negative, count(*) FILTER (WHERE len(list_filter(r, lambda c: c.weight < 0)) > 0) AS rows_negative FROM rubric""")
def manifest_stats(spark, d):
    n, bad = F.size("r").cast("long"), F.size(F.filter("r", lambda c: c.weight < 0))
    return V.rubric(spark, d).agg(F.count(F.lit(1)).alias("rows"), F.min(n).alias("fewest"), F.max(n).alias("most"), F.round(F.avg(n), 6).alias("mean"), F.sum(bad).alias("negative"), F.count_if(bad > 0).alias("rows_negative"))


@query("SELECT conv_id, CAST(sum(length(text)) AS BIGINT) AS chars FROM conversations GROUP BY conv_id HAVING sum(length(text)) <= 1500")
def length_budget(spark, d):
    chars = F.aggregate("m", F.lit(0).cast("long"), lambda acc, x: acc + F.length(x.text))
    return V.messages(spark, d).select("conv_id", chars.alias("chars")).filter("chars <= 1500")


@query("""SELECT r.id, CASE WHEN o.o_orderkey IS NULL THEN 'no_generation' WHEN o.o_orderstatus = 'P' THEN 'invalid' WHEN len(r.r) < 2 OR len(r.r) > 5 THEN 'count' WHEN list_sum(list_transform(r.r, lambda c: c.weight)) <= 0 THEN 'weight' ELSE 'kept' END AS reason
    FROM rubric r LEFT JOIN (SELECT * FROM orders WHERE o_orderkey % 10 <> 0) o ON o.o_orderkey = r.id""")
def keep_rule_reasons(spark, d):
    """The first rule that fails, with missing generations as the left join leaves them."""
    made = V.table(spark, d, "orders").filter("o_orderkey % 10 <> 0").select(F.col("o_orderkey").alias("id"), "o_orderstatus")
    n = F.size("r")
    reason = F.when(F.col("o_orderstatus").isNull(), "no_generation").when(F.col("o_orderstatus") == "P", "invalid").when((n < 2) | (n > 5), "count").when(R.total(F.col("r"), lambda c: c.weight) <= 0, "weight").otherwise("kept")
    return V.rubric(spark, d).join(made, "id", "left").select("id", reason.alias("reason"))


@query("SELECT 'Task: ' || p_name || chr(10) || 'Kind: ' || p_type || chr(10) AS text, p_partkey FROM part")
def template_fill(spark, d):
    return V.table(spark, d, "part").select("p_partkey", X.filled("Task: <<name>>\nKind: <<kind>>\n", name=F.col("p_name"), kind=F.col("p_type")).alias("text"))


@query("""SELECT n_name, r_name, round(avg(c), 6) AS mean, round(avg(s), 6) AS supplied, sum(n)::BIGINT AS n FROM
    (SELECT c_nationkey AS k, avg(c_acctbal) AS c, count(*) AS n FROM customer GROUP BY 1) JOIN (SELECT s_nationkey AS k, avg(s_acctbal) AS s FROM supplier GROUP BY 1) USING (k)
    JOIN nation ON n_nationkey = k JOIN region ON r_regionkey = n_regionkey GROUP BY n_name, r_name""")
def cell_summary(spark, d):
    """Cells by two-level names: both sides aggregate before they join."""
    c = V.table(spark, d, "customer").groupBy(F.col("c_nationkey").alias("k")).agg(F.avg("c_acctbal").alias("c"), F.count(F.lit(1)).alias("n"))
    s = V.table(spark, d, "supplier").groupBy(F.col("s_nationkey").alias("k")).agg(F.avg("s_acctbal").alias("s"))
    names = V.table(spark, d, "nation").join(V.table(spark, d, "region"), F.col("n_regionkey") == F.col("r_regionkey")).select(F.col("n_nationkey").alias("k"), "n_name", "r_name")
    return c.join(s, "k").join(names, "k").groupBy("n_name", "r_name").agg(F.round(F.avg("c"), 6).alias("mean"), F.round(F.avg("s"), 6).alias("supplied"), F.sum("n").alias("n"))


@query("SELECT vec_id, round(list_sum(list_transform(e, lambda x: abs(x))), 4) AS mass FROM (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings)")
def array_mass(spark, d):
    return V.table(spark, d, "embeddings").select("vec_id", F.round(R.total(F.col("embedding").cast("array<double>"), F.abs), 4).alias("mass"))


@query("""SELECT vec_id, round(0.5 * list_sum(list_transform(p, lambda v: v * ln((v + 1e-12) / (0.5 * v + 0.125 + 1e-12)))) + 0.5 * list_sum(list_transform(p, lambda v: 0.25 * ln((0.25 + 1e-12) / (0.5 * v + 0.125 + 1e-12)))), 8) AS jsd
    FROM (SELECT vec_id, list_transform(x, lambda v: v / list_sum(x)) AS p FROM (SELECT vec_id, list_reverse_sort(list_transform(CAST(embedding AS DOUBLE[]), lambda v: exp(v)))[1:4] AS x FROM embeddings))""")
def truncated_divergence(spark, d):
    """Jensen-Shannon divergence of the four largest of a vector's probabilities, made to sum to 1 again, against uniform ones."""
    x = F.slice(F.sort_array(F.transform(F.col("embedding").cast("array<double>"), F.exp), asc=False), 1, 4)
    p = F.transform(x, lambda v: v / R.total(x))
    return V.table(spark, d, "embeddings").select("vec_id", F.round(R.truncated_jsd(p, F.array(*[F.lit(0.25)] * 4)), 8).alias("jsd"))


class Throttled(Exception):
    status = 429


class Unavailable(Exception):
    status_code = 503


class FakeJudge:
    """Answers by rules of the prompt's text: throttled at times, down, or unreadable at temperature 0."""

    def __init__(self):
        self.seen: set[str] = set()

    def __call__(self, prompt: str, temperature: float) -> str:
        key = int(prompt.rpartition("#")[2])
        if key % 5 == 0 and prompt not in self.seen:
            self.seen.add(prompt)
            raise Throttled("slow down")
        if key % 11 == 0:
            raise Unavailable("down")
        if key % 7 == 0 and temperature == 0:
            return "I think so."
        return json.dumps({"met": "ring" in prompt or key % 3 == 0})


def _read(reply: str) -> bool | None:
    try:
        said = json.loads(reply).get("met")
    except ValueError:
        return None
    return said if isinstance(said, bool) else None


@query("""SELECT p_partkey, p_name || ' #' || p_partkey AS prompt, CASE WHEN p_partkey % 11 <> 0 THEN contains(p_name || ' #', 'ring') OR p_partkey % 3 = 0 END AS met, CASE WHEN p_partkey % 11 = 0 THEN 'Unavailable: down' END AS err,
    CASE WHEN p_partkey % 11 = 0 THEN 3 WHEN p_partkey % 7 = 0 THEN 2 ELSE 1 END AS tries FROM part""")
def judge_adapter(spark, d):
    """A judge that is throttled, down and unreadable at times: throttling costs no try, the other two do, and no row is lost."""
    tasks = V.table(spark, d, "part").select("p_partkey", F.concat("p_name", F.lit(" #"), F.col("p_partkey").cast("string")).alias("prompt"))
    return J.judged(tasks, FakeJudge(), _read, "prompt", "met", "boolean", J.Calls(pause=0.0))


@query("""SELECT event_type AS metric, day(ts) AS step, arg_max(value, (ts, event_id)) AS value FROM events WHERE value >= 5 GROUP BY ALL""")
def streamed_event_log(spark, d):
    """The event log, cut into files in no order, is read as a stream in batches; an upsert keeps each key's last successful value (under 5: failed)."""
    root = shared_folder(spark, "events")
    events = V.table(spark, d, "events").select(F.col("event_type").alias("metric"), F.dayofmonth("ts").alias("step"), F.when(F.col("value") >= 5, F.col("value")).alias("value"), "ts", "event_id")
    events.repartition(4, F.pmod(F.xxhash64("event_id"), F.lit(4))).write.parquet(f"{root}/in")
    stream = spark.readStream.schema(events.schema).option("maxFilesPerTrigger", 1).parquet(f"{root}/in")
    L.upsert(stream, f"{root}/out", f"{root}/state", ["metric", "step"], "value", ["ts", "event_id"]).awaitTermination()
    return L.current(spark, f"{root}/out", ["metric", "step"], "value", ["ts", "event_id"]).select("metric", "step", "value")


# Three groups claim places of a checklist of two to seven criteria: twice, beyond the end, none; or one group lacks its name.
@query(""", g AS (SELECT p_partkey, CAST(p_size % 6 + 2 AS INTEGER) AS n, p_size % 4 <> 0 AS named, [1 + p_partkey % 3, 1 + p_partkey % 3, 9, 1 + p_partkey % 5] AS one, [p_size % 6 + 2, 1 + p_partkey % 2] AS two FROM part),
    want AS (SELECT p_partkey, n, named, list_filter(list_distinct(one), lambda i: i <= n) AS a, two FROM g),
    had AS (SELECT p_partkey, n, CASE WHEN named THEN a ELSE [] END AS a, list_filter(list_distinct(two), lambda i: i <= n AND NOT (named AND list_contains(a, i))) AS b FROM want),
    fold(p_partkey, n, a, b, i) AS (SELECT p_partkey, n, CAST(a AS BIGINT[]), CAST(b AS BIGINT[]), CAST(0 AS BIGINT) FROM had),
    done AS (WITH RECURSIVE f AS (SELECT * FROM fold UNION ALL
        SELECT p_partkey, n, CASE WHEN free AND near_a THEN list_append(a, i + 1) ELSE a END, CASE WHEN free AND NOT near_a THEN list_append(b, i + 1) ELSE b END, i + 1
        FROM (SELECT *, NOT list_contains(a, i + 1) AND NOT list_contains(b, i + 1) AS free,
          CASE WHEN len(a) = 0 AND len(b) = 0 THEN true WHEN len(a) = 0 THEN false WHEN len(b) = 0 THEN true ELSE abs(list_sum(a) / len(a) - (i + 1)) <= abs(list_sum(b) / len(b) - (i + 1)) END AS near_a FROM f WHERE i < n)) SELECT * FROM f WHERE i = n)
    SELECT p_partkey, list_concat(CASE WHEN len(a) > 0 THEN ['lead=' || CAST(CAST(list_sum(a) AS BIGINT) AS VARCHAR) || '.0'] ELSE [] END, CASE WHEN len(b) > 0 THEN ['last=' || CAST(CAST(list_sum(b) AS BIGINT) AS VARCHAR) || '.0'] ELSE [] END) AS weights,
      list_concat(CASE WHEN len(a) > 0 THEN [list_sort(a)] ELSE [] END, CASE WHEN len(b) > 0 THEN [list_sort(b)] ELSE [] END) AS groups FROM done""")
def auto_repair(spark, d):
    """Criteria that claim indices twice or out of range, or lack a name, made to cover each index once."""
    n, key = (F.col("p_size") % 6 + 2).cast("int"), F.col("p_partkey").cast("int")
    criterion = lambda name, own: F.struct(name.alias("name"), F.lit("says so").alias("description"), own.alias("atomic_indices"))
    lead = criterion(F.when(F.col("p_size") % 4 != 0, "lead"), F.array(1 + key % 3, 1 + key % 3, F.lit(9), 1 + key % 5))
    criteria = F.array(lead, criterion(F.lit("last"), F.array(n, 1 + key % 2)), criterion(F.lit("none"), F.array().cast("array<int>")))
    weights = F.transform(F.sequence(F.lit(1), n), lambda i: F.when(i % 2 == 0, -i).otherwise(i).cast("double"))
    made = J.repaired(criteria, weights, n)
    return V.table(spark, d, "part").select("p_partkey", F.transform(made, lambda c: F.concat(c["name"], F.lit("="), c.weight.cast("string"))).alias("weights"), F.transform(made, lambda c: F.array_sort(c.atomic_indices).cast("array<bigint>")).alias("groups"))


@query("""SELECT p.arm, count(*) AS todo FROM (SELECT DISTINCT arm, id, k FROM log) p LEFT JOIN grades g ON g.arm = p.arm AND g.id = p.id AND g.k = p.k WHERE g.id IS NULL GROUP BY p.arm""")
def pending_by_arm(spark, d):
    return G.pending_calls(V.dealt(V.log(spark, d), "id"), ["arm", "id", "k"], "met").groupBy("arm").agg(F.count(F.lit(1)).alias("todo"))
