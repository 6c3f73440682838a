"""Queries on verdict logs, scores, sets and statistics."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from galena.functions.rubric import weighted_score
from galena.operators import grades as G
from galena.operators import intervals as I
from galena.operators import stats as S
from galena.plans import views as V
from galena.sources.scans import grades_of
from galena.sources.shared import shared_folder

QUERIES, SQL = {}, {}


def query(sql: str | None = None, shared: bool = True):
    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            SQL[f.__name__] = (V.SQL_WITH if shared else "") + sql
        return f

    return add


def _grades(spark: SparkSession, d: str) -> DataFrame:
    return G.last_success(V.log(spark, d), ["arm", "id", "k"], "met", V.LATEST)


def _flat(spark: SparkSession, d: str) -> DataFrame:
    return G.last_success(V.log(spark, d), ["id", "k"], "met", V.LATEST)


def _scores(spark: SparkSession, d: str) -> DataFrame:
    """id, score of complete questions with positive weight."""
    out = V.judged(spark, d).groupBy("id").agg(weighted_score(F.col("weight"), F.col("met"), strict=False).alias("score"), F.count("met").alias("g"), F.count(F.lit(1)).alias("n"))
    return out.filter("g = n and score is not null").select("id", "score")


SQL_SCORES = """scores AS (
    SELECT id, greatest(0, least(1, sum(weight * CAST(met AS INTEGER)) / nullif(sum(greatest(weight, 0)), 0))) AS score
    FROM criteria LEFT JOIN flat USING (id, k) GROUP BY id HAVING count(met) = count(*) AND sum(greatest(weight, 0)) > 0)"""


@query("SELECT arm, id, k, met FROM grades")
def last_success_grades(spark, d):
    return _grades(spark, d)


@query("SELECT id, k, met, status, arm FROM log QUALIFY row_number() OVER (PARTITION BY id, k ORDER BY ts DESC, p DESC, s DESC) = 1")
def last_write_log(spark, d):
    return G.last_write(V.log(spark, d).select("id", "k", "met", "status", "arm", *V.LATEST), ["id", "k"], V.LATEST).select("id", "k", "met", "status", "arm")


@query("""SELECT id, k, status, p FROM log
    QUALIFY row_number() OVER (PARTITION BY id, k ORDER BY met IS NULL, CASE WHEN met IS NOT NULL THEN -epoch_us(ts) ELSE epoch_us(ts) END,
        CASE WHEN met IS NOT NULL THEN -p ELSE p END, CASE WHEN met IS NOT NULL THEN -s ELSE s END) = 1""")
def last_good_or_first(spark, d):
    rows = V.log(spark, d).select("id", "k", "status", "met", "ts", "p", "s")
    return G.last_good_or_first(rows, ["id", "k"], F.col("met").isNotNull(), V.LATEST).select("id", "k", "status", "p")


@query("""SELECT a.id, a.status, b.w AS score FROM
    (SELECT id, status FROM log QUALIFY row_number() OVER (PARTITION BY id ORDER BY ts, p, s, k) = 1) a LEFT JOIN
    (SELECT id, w FROM log WHERE met IS NOT NULL QUALIFY row_number() OVER (PARTITION BY id ORDER BY ts, p, s, k) = 1) b USING (id)""")
def first_file_merge(spark, d):
    rows = V.log(spark, d).withColumn("score", F.when(F.col("met").isNotNull(), F.col("w")))
    return G.first_file_wins(rows, ["id"], "status", "score", [*V.LATEST, "k"]).select("id", "status", "score")


@query(f""", {SQL_SCORES} SELECT id, round(score, 6) AS score FROM scores""")
def score_weighted_clipped(spark, d):
    return _scores(spark, d).select("id", F.round("score", 6).alias("score"))


@query(""", tagged AS (SELECT id, k, weight, unnest([CASE WHEN k % 2 = 0 THEN 'even' ELSE 'odd' END, CASE WHEN abs(weight) >= 25 THEN 'heavy' ELSE 'light' END]) AS tag FROM criteria)
    SELECT id, tag, round(greatest(0, least(1, sum(weight * CAST(met AS INTEGER)) / sum(greatest(weight, 0)))), 6) AS score
    FROM tagged JOIN flat USING (id, k) GROUP BY id, tag HAVING sum(greatest(weight, 0)) > 0""")
def score_by_tag(spark, d):
    tags = F.array(F.when(F.col("k") % 2 == 0, "even").otherwise("odd"), F.when(F.abs("weight") >= 25, "heavy").otherwise("light"))
    held = V.judged(spark, d).filter("met is not null").withColumn("tag", F.explode(tags))
    out = held.groupBy("id", "tag").agg(weighted_score(F.col("weight"), F.col("met"), strict=False).alias("score"))
    return out.filter("score is not null").withColumn("score", F.round("score", 6))


@query(""", whole AS (SELECT id, count(*) AS n FROM criteria GROUP BY id),
    ready AS (SELECT arm, id FROM grades JOIN whole USING (id) GROUP BY arm, id, n HAVING count(met) = n)
    SELECT arm, id, count(*) AS n_criteria, count(*) FILTER (WHERE met) AS n_met FROM grades JOIN ready USING (arm, id) GROUP BY arm, id""")
def completeness_filter(spark, d):
    whole = V.log(spark, d).groupBy("id").agg(F.count_distinct("k").alias("whole"))
    done = _grades(spark, d).groupBy("arm", "id").agg(F.count(F.lit(1)).alias("n_criteria"), F.count_if("met").alias("n_met"))
    return done.join(whole, "id").filter("n_criteria = whole").select("arm", "id", "n_criteria", "n_met")


@query("SELECT id FROM grades GROUP BY id HAVING count(DISTINCT arm) = (SELECT count(DISTINCT arm) FROM grades)")
def common_ids_division(spark, d):
    return G.common_ids(_grades(spark, d).select("arm", "id"), "arm")


@query(""", per AS (SELECT arm, id, sum(w) AS v FROM log GROUP BY arm, id),
    shared AS (SELECT id FROM per GROUP BY id HAVING count(*) = 3)
    SELECT arm, round(avg(v) * 100, 4) AS mean, count(*) AS n FROM per JOIN shared USING (id) GROUP BY arm""")
def paired_arm_means(spark, d):
    per = V.log(spark, d).groupBy("arm", "id").agg(F.sum("w").alias("v"))
    shared = G.common_ids(per, "arm", 3)
    return per.join(shared, "id", "left_semi").groupBy("arm").agg(F.round(F.avg("v") * 100, 4).alias("mean"), F.count(F.lit(1)).alias("n"))


@query("""SELECT arm, status, n, n >= 0.9 * max(n) OVER (PARTITION BY arm, status) AND n >= 0.95 * max(n) OVER (PARTITION BY status) AS counts
    FROM (SELECT arm, status, count(DISTINCT id) AS n FROM log GROUP BY arm, status)""")
def coverage_floors(spark, d):
    n = V.log(spark, d).groupBy("arm", "status").agg(F.count_distinct("id").alias("n"))
    return G.coverage_floor(n, "arm", "status", "n", 0.9, 0.95).select("arm", "status", "n", "counts")


@query("""SELECT DISTINCT l.id, l.k, l.arm FROM log l ANTI JOIN grades g ON l.id = g.id AND l.k = g.k AND l.arm = g.arm""")
def resume_anti_join(spark, d):
    return G.pending_calls(V.dealt(V.log(spark, d), "id"), ["id", "k", "arm"], "met")


@query(""", v AS (SELECT id, k, max(CASE WHEN arm = 'a0' THEN CAST(met AS INTEGER) END) AS wide, max(CASE WHEN arm = 'a1' THEN CAST(met AS INTEGER) END) AS strict FROM grades GROUP BY id, k)
    SELECT k, count(*) FILTER (WHERE weight > 0 AND wide = 1) AS wide_met, count(*) FILTER (WHERE weight > 0 AND wide = 1 AND strict = 0) AS ghost,
           count(*) FILTER (WHERE weight > 0 AND wide = 0 AND strict = 1) AS strict_only,
           round(count(*) FILTER (WHERE weight > 0 AND wide = 1 AND strict = 0) / nullif(count(*) FILTER (WHERE weight > 0 AND wide = 1), 0), 6) AS ghost_share
    FROM v JOIN criteria USING (id, k) WHERE wide IS NOT NULL AND strict IS NOT NULL GROUP BY k""")
def ghost_share(spark, d):
    arm = lambda a: V.latest("met", F.col("arm") == a)
    v = V.log(spark, d).groupBy("id", "k").agg(arm("a0").alias("wide"), arm("a1").alias("strict"), V.latest("w").alias("weight")).filter("wide is not null and strict is not null")
    return G.ghost_share(v, ["k"]).withColumn("ghost_share", F.round("ghost_share", 6))


@query(""", v AS (SELECT id, k, max(CASE WHEN arm = 'a0' THEN CAST(met AS INTEGER) END) AS a, max(CASE WHEN arm = 'a1' THEN CAST(met AS INTEGER) END) AS b FROM grades GROUP BY id, k)
    SELECT k, round(avg(CAST(a = b AS INTEGER)), 6) AS agreement, count(*) AS n FROM v WHERE a IS NOT NULL AND b IS NOT NULL GROUP BY k""")
def verdict_agreement(spark, d):
    arm = lambda a: V.latest("met", F.col("arm") == a)
    v = V.log(spark, d).groupBy("id", "k").agg(arm("a0").alias("a"), arm("a1").alias("b")).filter("a is not null and b is not null")
    return v.groupBy("k").agg(F.round(F.avg((F.col("a") == F.col("b")).cast("double")), 6).alias("agreement"), F.count(F.lit(1)).alias("n"))


@query(""", seeds AS (SELECT o_orderpriority AS arm, 42 + o_orderkey % 3 AS seed, avg(o_totalprice) AS v FROM orders GROUP BY ALL)
    SELECT arm, round(avg(v), 4) AS mean, round(stddev_samp(v), 4) AS sd, count(v) AS n FROM seeds GROUP BY arm""")
def seed_mean_sd(spark, d):
    seeds = V.table(spark, d, "orders").groupBy(F.col("o_orderpriority").alias("arm"), (42 + F.col("o_orderkey") % 3).alias("seed")).agg(F.avg("o_totalprice").alias("v"))
    return S.mean_sd(seeds, ["arm"], "v").select("arm", F.round("mean", 4).alias("mean"), F.round("sd", 4).alias("sd"), "n")


@query(""", x AS (SELECT o_orderpriority AS domain, 42 + o_orderkey % 5 AS seed, avg(CASE WHEN o_orderstatus = 'O' THEN o_totalprice END) - avg(CASE WHEN o_orderstatus = 'F' THEN o_totalprice END) AS d FROM orders GROUP BY ALL),
    y AS (SELECT domain, avg(d) AS delta, stddev_samp(d) AS sd, count(d) AS n FROM x WHERE d IS NOT NULL GROUP BY domain)
    SELECT domain, round(delta, 3) AS delta, n, round(delta - 2.776 * sd / sqrt(n), 3) AS lo, round(delta + 2.776 * sd / sqrt(n), 3) AS hi FROM y WHERE n = 5""")
def t_interval(spark, d):
    rows = V.table(spark, d, "orders").select(F.col("o_orderpriority").alias("domain"), (42 + F.col("o_orderkey") % 5).alias("seed"), "o_orderstatus", "o_totalprice")
    out = S.paired_t(rows, ["domain"], "seed", "o_orderstatus", "O", "F", "o_totalprice").filter("n = 5")
    return out.select("domain", "n", *[F.round(c, 3).alias(c) for c in ("delta", "lo", "hi")])


@query(""", r AS (SELECT o_orderpriority AS g, rank() OVER (PARTITION BY o_orderpriority ORDER BY x) + (count(*) OVER (PARTITION BY o_orderpriority, x) - 1) / 2 AS a,
      rank() OVER (PARTITION BY o_orderpriority ORDER BY y) + (count(*) OVER (PARTITION BY o_orderpriority, y) - 1) / 2 AS b
      FROM (SELECT o_orderpriority, floor(o_totalprice / 1000) AS x, o_custkey % 97 AS y FROM orders))
    SELECT g, round(corr(a, b), 6) AS rho, count(*) AS n FROM r GROUP BY g""")
def spearman_rank(spark, d):
    rows = V.table(spark, d, "orders").select(F.col("o_orderpriority").alias("g"), F.floor(F.col("o_totalprice") / 1000).alias("x"), (F.col("o_custkey") % 97).alias("y"))
    return S.spearman(rows, ["g"], "x", "y").withColumn("rho", F.round("rho", 6))


@query("SELECT o_orderpriority AS g, list_sort(list(o_totalprice))[count(*) // 2 + 1] AS upper_median, count(*) AS n FROM orders GROUP BY g")
def upper_median(spark, d):
    return S.upper_median(V.table(spark, d, "orders").withColumnRenamed("o_orderpriority", "g"), ["g"], "o_totalprice")


@query("SELECT o_orderpriority AS g, list_sort(list(o_totalprice))[CAST(floor(count(*) * 0.9) AS INTEGER) + 1] AS percentile, count(*) AS n FROM orders GROUP BY g")
def floor_percentile(spark, d):
    return S.floor_percentile(V.table(spark, d, "orders").withColumnRenamed("o_orderpriority", "g"), ["g"], "o_totalprice", 0.9)


@query("""SELECT p_brand, p_type, v, place FROM (SELECT p_brand, p_type, v, dense_rank() OVER (PARTITION BY p_brand ORDER BY round(v, 1) DESC) AS place
    FROM (SELECT p_brand, p_type, CAST(sum(p_size) AS DOUBLE) AS v FROM part GROUP BY ALL)) WHERE place <= 2""")
def best_second(spark, d):
    v = V.table(spark, d, "part").groupBy("p_brand", "p_type").agg(F.sum("p_size").cast("double").alias("v"))
    return S.best_two(v, ["p_brand"], "v")


@query(""", b AS (SELECT id, list(met ORDER BY k) AS met FROM flat GROUP BY id),
    x AS (SELECT a.met AS before, c.met AS after, len(a.met) AS k FROM b a JOIN b c ON c.id = a.id + 1 AND len(c.met) = len(a.met)),
    y AS (SELECT k, len(list_filter(before, lambda q: q)) AS nb, len(list_filter(after, lambda q: q)) AS na,
        len(list_filter(range(1, k + 1), lambda i: NOT before[i] AND after[i])) AS fixed, len(list_filter(range(1, k + 1), lambda i: before[i] AND NOT after[i])) AS lost FROM x),
    z AS (SELECT CASE WHEN nb = k THEN 'all' WHEN nb = 0 THEN 'zero' WHEN nb = k - 1 THEN 'one_short' ELSE 'middle' END AS state, * FROM y)
    SELECT coalesce(state, 'overall') AS state, count(*) AS n, count(*) FILTER (WHERE na = k) AS to_all, CAST(sum(fixed) AS BIGINT) AS fixed, CAST(sum(lost) AS BIGINT) AS lost,
      round(sum(fixed) / nullif(sum(k - nb), 0), 6) AS fix_rate, round(sum(na) / sum(k), 6) AS dim_sat FROM z GROUP BY ROLLUP (state)""")
def state_transition(spark, d):
    rows = _flat(spark, d).groupBy("id").agg(F.array_sort(F.collect_list(F.struct("k", "met"))).alias("m"))
    rows = rows.select("id", F.col("m.met").alias("met"))
    pairs = rows.select("id", F.col("met").alias("before")).join(rows.select((F.col("id") - 1).alias("id"), F.col("met").alias("after")), "id")
    return G.state_transitions(pairs).withColumns({c: F.round(c, 6) for c in ("fix_rate", "dim_sat")})


@query(""", x AS (SELECT doc_id, lang, quality = 1 AS truth, toxic = 0 AS guess FROM labels JOIN documents USING (doc_id)),
    f AS (SELECT lang, 2 * count(*) FILTER (WHERE truth AND guess) / nullif(count(*) FILTER (WHERE truth) + count(*) FILTER (WHERE guess), 0) AS yes,
      2 * count(*) FILTER (WHERE NOT truth AND NOT guess) / nullif(count(*) FILTER (WHERE NOT truth) + count(*) FILTER (WHERE NOT guess), 0) AS no, count(*) AS n FROM x GROUP BY lang)
    SELECT lang, round((yes + no) / 2, 6) AS balanced_f1, n FROM f""")
def balanced_f1(spark, d):
    rows = V.table(spark, d, "labels").join(V.table(spark, d, "documents").select("doc_id", "lang"), "doc_id").select("lang", (F.col("quality") == 1).alias("truth"), (F.col("toxic") == 0).alias("guess"))
    return S.balanced_f1(rows, ["lang"], "truth", "guess").withColumn("balanced_f1", F.round("balanced_f1", 6))


@query(""", w AS (SELECT id, arm FROM grades GROUP BY id, arm HAVING count(*) >= 2) SELECT arm, count(*) AS n FROM w
    WHERE id IN (SELECT id FROM w WHERE arm = 'a0') AND id IN (SELECT id FROM w WHERE arm = 'a1') GROUP BY arm""")
def prompt_set(spark, d):
    w = _grades(spark, d).groupBy("id", "arm").agg(F.count(F.lit(1)).alias("n")).filter("n >= 2").select("id", "arm")
    both = G.common_ids(w.filter(F.col("arm").isin("a0", "a1")), "arm", 2)
    return w.join(both, "id", "left_semi").groupBy("arm").agg(F.count(F.lit(1)).alias("n"))


@query(""", c AS (SELECT DISTINCT arm, id FROM log), i0 AS (SELECT id FROM c WHERE arm = 'a0'), m1 AS (SELECT id FROM i0 SEMI JOIN (SELECT id FROM c WHERE arm = 'a1') USING (id)),
    k1 AS (SELECT (SELECT count(*) FROM m1) >= 0.5 * (SELECT count(*) FROM i0) AS ok), i1 AS (SELECT id FROM i0 WHERE NOT (SELECT ok FROM k1) OR id IN (SELECT id FROM m1)),
    m2 AS (SELECT id FROM i1 SEMI JOIN (SELECT id FROM c WHERE arm = 'a2') USING (id)), k2 AS (SELECT (SELECT count(*) FROM m2) >= 0.5 * (SELECT count(*) FROM i1) AS ok),
    i2 AS (SELECT id FROM i1 WHERE NOT (SELECT ok FROM k2) OR id IN (SELECT id FROM m2))
    SELECT id, 'a0' || CASE WHEN (SELECT ok FROM k1) THEN ',a1' ELSE '' END || CASE WHEN (SELECT ok FROM k2) THEN ',a2' ELSE '' END AS arms FROM i2""")
def greedy_extra_arms(spark, d):
    cells = V.log(spark, d).select("arm", "id").distinct()
    joined, ids = G.greedy_arms(cells, ["a0"], ["a1", "a2"], 0.5)
    return ids.select("id", F.lit(",".join(joined)).alias("arms"))


@query()
def bootstrap_ci(spark, d):
    rows = V.table(spark, d, "orders").select(F.col("o_orderpriority").alias("g"), (F.col("o_totalprice") / 1000).alias("v"))
    return S.bootstrap(rows, ["g"], "v")


@query(""", files AS (SELECT 'f' || CAST(id % 3 AS VARCHAR) AS file, * FROM log), cells(file, arm) AS (VALUES ('f0', 'a0'), ('f0', 'a1'), ('f1', 'a1'), ('f2', 'a2')),
    tried AS (SELECT DISTINCT file, arm, id FROM files JOIN cells USING (file, arm)),
    done AS (SELECT t.file, t.arm, t.id, len(r) AS whole, count(g.met) AS n, sum(CASE WHEN g.met THEN c.weight ELSE 0 END) AS e, sum(greatest(c.weight, 0)) AS plus
      FROM tried t JOIN rubric USING (id) JOIN criteria c ON c.id = t.id LEFT JOIN grades g ON g.arm = t.arm AND g.id = t.id AND g.k = c.k GROUP BY ALL)
    SELECT file, arm, count(*) AS attempted, count(*) FILTER (WHERE n > 0) AS graded, count(*) FILTER (WHERE n = whole) AS complete,
      round(100 * avg(CASE WHEN n = whole AND plus > 0 THEN greatest(0, least(1, e / plus)) END), 4) AS score FROM done GROUP BY file, arm""")
def grades_by_cell(spark, d):
    """Three logs are written as JSON lines, and four cells, each an arm of one log, read from them: ids attempted, with verdicts, complete, and their score."""
    root = shared_folder(spark, "grades")
    lines = V.log(spark, d).select("id", F.concat(F.lit("f"), (F.col("id") % 3).cast("string")).alias("file"), "ts", "p", "s", F.to_json(F.struct("arm", F.col("id").cast("string").alias("id"), "k", "met")).alias("value"))
    lines.repartition("id").sortWithinPartitions("file", *V.LATEST).select("file", "value").write.partitionBy("file").text(root)  # a key's calls stay in order
    cells = [(f"{root}/file={f}", a) for f, a in (("f0", "a0"), ("f0", "a1"), ("f1", "a1"), ("f2", "a2"))]
    calls = V.dealt(V.log(spark, d).select(F.col("id").cast("string").alias("id"), "k", "w", *V.LATEST), "id")
    criteria = calls.groupBy("id", "k").agg(F.max_by("w", F.struct(*V.LATEST)).alias("weight"))
    rubrics = criteria.groupBy("id").agg(F.array_sort(F.collect_list(F.struct("k", "weight"))).alias("r"))
    found = G.graded_cells(grades_of(spark, cells), rubrics)
    return found.groupBy(F.regexp_extract("path", "file=(.*)$", 1).alias("file"), "arm").agg(
        F.count(F.lit(1)).alias("attempted"), F.count_if(F.col("verdicts") > 0).alias("graded"), F.count_if("full").alias("complete"), F.round(100 * F.avg("score"), 4).alias("score"),
    )


@query(" UNION ALL ".join(f"SELECT '{name}' AS convention, c_nationkey, n, round(v, 4) AS mean, round(v_lo, 4) AS lo, round(v_hi, 4) AS hi FROM {I.intervals_sql('customer', ['c_nationkey'], 'c_custkey', {'v': ('c_acctbal', '1')}, c)}" for name, c in I.CONVENTIONS.items()), shared=False)
def interval_conventions(spark, d):
    """The mean balance of each nation's customers with its interval, as each kind of report draws and bounds it."""
    rows = V.table(spark, d, "customer").select("c_nationkey", "c_custkey", "c_acctbal")
    found = I.by_convention(rows, ["c_nationkey"], "c_custkey", {"v": (F.col("c_acctbal"), F.lit(1))}, I.CONVENTIONS)
    return found.select("convention", "c_nationkey", "n", *[F.round(c, 4).alias(k) for k, c in (("mean", "v"), ("lo", "v_lo"), ("hi", "v_hi"))])
