"""Queries on benchmark tables, probes, audits and record parsing."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from galena.functions import parsing as X
from galena.functions import rubric as R
from galena.operators import grades as G
from galena.operators import intervals as I
from galena.operators import sampling as S
from galena.plans import views as V

QUERIES, SQL = {}, {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            SQL[f.__name__] = V.SQL_WITH + sql
        return f

    return add


def _flat(spark, d):
    return G.last_success(V.log(spark, d), ["id", "k"], "met", V.LATEST)


@query("""SELECT l_orderkey AS id, round(greatest(0, least(1, sum(w * g / 3) / sum(greatest(w, 0)))), 6) AS score FROM
    (SELECT l_orderkey, CASE WHEN l_discount >= 0.08 THEN -l_quantity ELSE l_quantity END AS w, l_partkey % 4 AS g FROM lineitem) GROUP BY l_orderkey HAVING sum(greatest(w, 0)) > 0""")
def score_graded(spark, d):
    w = F.when(F.col("l_discount") >= 0.08, -F.col("l_quantity")).otherwise(F.col("l_quantity"))
    out = V.table(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("id")).agg(X.graded_score(w, F.col("l_partkey") % 4).alias("score"))
    return out.filter("score is not null").withColumn("score", F.round("score", 6))


@query("SELECT p_partkey, CASE WHEN p_size BETWEEN 1 AND 10 THEN round((p_size - 1) / 9, 6) END AS score FROM part")
def score_likert(spark, d):
    return V.table(spark, d, "part").select("p_partkey", F.round(X.likert(F.col("p_size")), 6).alias("score"))


@query(""", c AS (SELECT o_orderpriority AS col, o_orderkey % 3 AS seed, o_orderstatus AS cell, avg(o_totalprice) AS v FROM orders GROUP BY ALL),
    m AS (SELECT cell, col, avg(v) AS v FROM c GROUP BY ALL) SELECT cell, round(avg(v), 3) AS average FROM m GROUP BY cell HAVING count(*) = 5""")
def full_benchmark_average(spark, d):
    """Mean of column means, only for cells that have all five columns."""
    seeds = V.table(spark, d, "orders").groupBy(F.col("o_orderstatus").alias("cell"), F.col("o_orderpriority").alias("col"), (F.col("o_orderkey") % 3).alias("seed")).agg(F.avg("o_totalprice").alias("v"))
    columns = seeds.groupBy("cell", "col").agg(F.avg("v").alias("v"))
    return columns.groupBy("cell").agg(F.avg("v").alias("v"), F.count(F.lit(1)).alias("n")).filter("n = 5").select("cell", F.round("v", 3).alias("average"))


SQL_RUNS = """runs AS (SELECT 'a' || CAST(l_suppkey % 3 AS VARCHAR) AS run, l_orderkey AS id, avg(l_quantity) AS v FROM lineitem GROUP BY ALL),
    every_run AS (SELECT id FROM runs GROUP BY id HAVING count(*) = 3),
    deltas AS (SELECT b.run || ' minus ' || a.run AS name, id, b.v - a.v AS d FROM runs a JOIN runs b USING (id) WHERE a.run < b.run)"""


@query(f""", {SQL_RUNS} SELECT 'run' AS kind, run AS name, count(*) AS n, round(avg(v), 4) AS value, CAST(NULL AS DOUBLE) AS lo, CAST(NULL AS DOUBLE) AS hi,
      round(avg(CASE WHEN e.id IS NOT NULL THEN v END), 4) AS common_mean, count(e.id) AS common_n FROM runs r LEFT JOIN every_run e ON e.id = r.id GROUP BY run
    UNION ALL SELECT 'delta', name, n, round(v, 4), round(v_lo, 4), round(v_hi, 4), NULL, NULL
    FROM {I.intervals_sql("deltas", ["name"], "id", {"v": ("d", "1")}, I.CONVENTIONS["official"])}""")
def paired_summary(spark, d):
    """Every run's own and common mean, and every pair's difference with its interval: an id's runs pair within its row."""
    runs = V.log(spark, d).groupBy("id", "arm").agg(F.avg(F.abs("w")).alias("v")).groupBy("id").agg(F.array_sort(F.collect_list(F.struct("arm", "v"))).alias("r"))
    one = runs.withColumn("c", F.size("r") == 3).select("c", F.explode("r").alias("a")).groupBy(F.col("a.arm").alias("name"))
    one = one.agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("a.v"), 4).alias("value"), F.round(F.avg(F.when(F.col("c"), F.col("a.v"))), 4).alias("common_mean"), F.count_if("c").alias("common_n"))
    left = I.spread(runs).select("id", "r", F.posexplode("r").alias("i", "a"))
    both = left.select("id", "a", F.explode(F.slice("r", F.col("i") + 2, F.size("r"))).alias("b"))
    deltas = both.select("id", F.concat("b.arm", F.lit(" minus "), "a.arm").alias("name"), (F.col("b.v") - F.col("a.v")).alias("d"))
    found = I.intervals(deltas, ["name"], "id", {"v": (F.col("d"), F.lit(1))}, I.CONVENTIONS["official"], dealt=True)
    found = found.select(F.lit("delta").alias("kind"), "name", "n", *[F.round(c, 4).alias(k) for k, c in (("value", "v"), ("lo", "v_lo"), ("hi", "v_hi"))])
    return one.withColumn("kind", F.lit("run")).unionByName(found, allowMissingColumns=True)


@query(""", p AS (SELECT id, avg(CAST(met AS INTEGER)) AS macro, min(CAST(met AS INTEGER)) AS four FROM flat GROUP BY id HAVING count(*) = 4)
    SELECT round(avg(macro), 6) AS macro, round(avg(four), 6) AS all_rate, count(*) AS n FROM p""")
def probe_macro(spark, d):
    per = _flat(spark, d).groupBy("id").agg(F.avg(F.col("met").cast("double")).alias("macro"), F.min(F.col("met").cast("int")).alias("four"), F.count(F.lit(1)).alias("n")).filter("n = 4")  # a probe has four
    return per.agg(F.round(F.avg("macro"), 6).alias("macro"), F.round(F.avg("four"), 6).alias("all_rate"), F.count(F.lit(1)).alias("n"))


@query(""", m AS (SELECT l_suppkey % 4 AS arm, l_linenumber AS step, avg(l_quantity) AS v FROM lineitem GROUP BY ALL), e AS (SELECT arm, min(v) AS lo, max(v) AS hi FROM m GROUP BY arm)
    SELECT a.arm AS x, b.arm AS y, a.hi < b.lo AS apart FROM e a, e b WHERE a.arm <> b.arm""")
def arm_separation(spark, d):
    """Whether all values of one arm lie below all of another; the arms are a handful of rows."""
    m = V.table(spark, d, "lineitem").groupBy((F.col("l_suppkey") % 4).alias("arm"), "l_linenumber").agg(F.avg("l_quantity").alias("v"))
    ends = m.groupBy("arm").agg(F.min("v").alias("lo"), F.max("v").alias("hi")).groupBy().agg(F.collect_list(F.struct("arm", "lo", "hi")).alias("all"))
    pairs = ends.select("all", F.explode("all").alias("a")).select("a", F.explode("all").alias("b")).filter("a.arm <> b.arm")
    return pairs.select(F.col("a.arm").alias("x"), F.col("b.arm").alias("y"), (F.col("a.hi") < F.col("b.lo")).alias("apart"))


@query("""SELECT 'documents' AS name, count(*) AS n FROM documents UNION ALL SELECT 'benchmark', count(*) FROM benchmark UNION ALL SELECT 'conversations', count(DISTINCT conv_id) FROM conversations""")
def evaluation_sizes(spark, d):
    count = lambda name, what: V.table(spark, d, name).agg(what.alias("n")).select(F.lit(name).alias("name"), "n")
    one = F.count(F.lit(1))
    return count("documents", one).unionByName(count("benchmark", one)).unionByName(count("conversations", F.count_distinct("conv_id")))


@query(""", m AS (SELECT *, lang IN ('en') AS mine FROM documents) SELECT doc_id FROM m WHERE mine OR NOT (SELECT bool_or(lang IS NOT NULL) FROM m)""")
def domain_marker_filter(spark, d):
    """Rows of the domain; all rows if none carries a marker."""
    docs = V.table(spark, d, "documents").select("doc_id", "lang")
    marked = docs.agg(F.max(F.col("lang").isNotNull()).alias("any"))
    return docs.crossJoin(F.broadcast(marked)).filter((F.col("lang") == "en") | ~F.coalesce("any", F.lit(False))).select("doc_id")  # one row


@query("SELECT doc_id, lang, n_chars FROM documents QUALIFY row_number() OVER (PARTITION BY lang ORDER BY n_chars DESC, doc_id) <= 5")
def per_group_limit(spark, d):
    rank = F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("n_chars"), "doc_id"))
    return V.table(spark, d, "documents").select("doc_id", "lang", "n_chars").withColumn("r", rank).filter("r <= 5").drop("r")


@query("""SELECT o_orderkey AS id, CASE WHEN n IS NULL THEN 'missing id' WHEN n < 3 THEN 'empty response' END AS error, CASE WHEN n >= 3 THEN n END AS lines
    FROM orders LEFT JOIN (SELECT l_orderkey, count(*) AS n FROM lineitem GROUP BY 1) ON l_orderkey = o_orderkey""")
def gated_records(spark, d):
    """Questions without a usable response become error rows; none is lost."""
    n = V.table(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("id")).agg(F.count(F.lit(1)).alias("n"))
    error = F.when(F.col("n").isNull(), "missing id").when(F.col("n") < 3, "empty response")
    return V.table(spark, d, "orders").select(F.col("o_orderkey").alias("id")).join(n, "id", "left").select("id", error.alias("error"), F.when(F.col("n") >= 3, F.col("n")).alias("lines"))


@query("""SELECT p_partkey, CASE WHEN style BETWEEN 0 AND 20 THEN style END AS style, CASE WHEN plot BETWEEN 0 AND 20 THEN plot END AS plot FROM (SELECT p_partkey, TRY_CAST(regexp_extract(tail, 'style:\\s*(-?[0-9]+(\\.[0-9]+)?)', 1) AS DOUBLE) AS style, TRY_CAST(regexp_extract(tail, 'plot:\\s*\\[?(-?[0-9]+(\\.[0-9]+)?)', 1) AS DOUBLE) AS plot
    FROM (SELECT p_partkey, string_split(p_name || ' [Scores] style: 9' || chr(10) || CASE WHEN p_partkey % 5 > 0 THEN '[Scores]' || chr(10) ELSE '' END || CASE WHEN p_partkey % 7 > 0 THEN CASE WHEN p_partkey % 5 > 0 THEN 'style: ' || CAST(p_size - 3 AS VARCHAR) ELSE '' END || chr(10) ELSE '' END
      || 'plot: ' || CASE WHEN p_partkey % 2 = 0 THEN '[' || CAST((p_partkey % 43) / 2.0 AS VARCHAR) || ']' ELSE CAST((p_partkey % 43) / 2.0 AS VARCHAR) END || chr(10) || 'voice: none', '[Scores]')[-1] AS tail FROM part))""")
def named_score_parse(spark, d):
    """Scores of the last block, from each row's columns: missing, out of range, in brackets or bare."""
    k, nl = F.col("p_partkey"), F.lit("\n")
    plot = ((k % 43) / 2.0).cast("string")
    style = F.when((k % 7 > 0) & (k % 5 > 0), F.concat(F.lit("style: "), (F.col("p_size") - 3).cast("string"))).otherwise("")
    block = F.concat(F.when(k % 5 > 0, "[Scores]\n").otherwise(""), style, nl, F.lit("plot: "), F.when(k % 2 == 0, F.concat(F.lit("["), plot, F.lit("]"))).otherwise(plot), F.lit("\nvoice: none"))
    scores = X.named_scores(F.concat("p_name", F.lit(" [Scores] style: 9\n"), block))
    return V.table(spark, d, "part").select("p_partkey", *[F.try_element_at(scores, F.lit(n)).alias(n) for n in ("style", "plot")])


@query("""SELECT p_partkey, CASE WHEN len(found) = 3 THEN found END AS labels FROM (SELECT p_partkey, list_filter(list_transform(string_split(reply, chr(10)), lambda x: CASE WHEN starts_with(lower(regexp_replace(x, '^\\s*([-*]|[0-9]+[.)])?\\s*', '')), 'completely') THEN 5
      WHEN starts_with(lower(regexp_replace(x, '^\\s*([-*]|[0-9]+[.)])?\\s*', '')), 'moderately') THEN 3 WHEN starts_with(lower(regexp_replace(x, '^\\s*([-*]|[0-9]+[.)])?\\s*', '')), 'not at all') THEN 1 END), lambda x: x IS NOT NULL) AS found
    FROM (SELECT p_partkey, array_to_string(list_transform(range(1, 5), lambda i: ['1. ', '- ', ' * ', '2) ', ''][1 + (p_partkey + i) % 5] || ['Completely', 'moderately so', 'NOT AT ALL: ', 'unsure, ', p_name][1 + (p_partkey * i + p_size) % 5] || ' ' || p_type), chr(10)) AS reply FROM part))""")
def listed_label_parse(spark, d):
    """Four lines made of each row's columns, with bullets and numbers; three labels are wanted."""
    k, size = F.col("p_partkey"), F.col("p_size")
    pick = lambda values, at: F.get(F.array(*[v if not isinstance(v, str) else F.lit(v) for v in values]), at.cast("int"))
    line = lambda i: F.concat(pick(["1. ", "- ", " * ", "2) ", ""], (k + i) % 5), pick(["Completely", "moderately so", "NOT AT ALL: ", "unsure, ", F.col("p_name")], (k * i + size) % 5), F.lit(" "), F.col("p_type"))
    labels = {"completely": 5, "moderately": 3, "not at all": 1}
    return V.table(spark, d, "part").select("p_partkey", X.listed_labels(F.array_join(F.array(*map(line, range(1, 5))), "\n"), labels, F.lit(3)).alias("labels"))


@query("""SELECT p_partkey, CASE WHEN p_size % 2 = 0 THEN 'Kind: ' ELSE '' END AS prefix, p_type AS body, p_name || ' (new)' AS edited, CASE WHEN p_size % 5 = 0 THEN 'anchor missing' END AS error FROM part""")
def split_and_edit(spark, d):
    split = X.prefixed(F.when(F.col("p_size") % 2 == 0, F.concat(F.lit("Kind: "), "p_type")).otherwise(F.col("p_type")))
    anchor = F.when(F.col("p_size") % 5 == 0, "@@").otherwise(F.col("p_name"))
    edit = X.inserted(F.col("p_name"), anchor, F.lit(" (new)"))
    rows = V.table(spark, d, "part").select("p_partkey", split.alias("s"), edit.alias("e"), "p_name")
    return rows.select("p_partkey", "s.prefix", "s.body", F.coalesce("e.text", F.concat("p_name", F.lit(" (new)"))).alias("edited"), "e.error")


@query("SELECT 'a' || CAST(l_suppkey % 3 AS VARCHAR) || '/s' || CAST(42 + l_orderkey % 3 AS VARCHAR) || '/st' || lpad(CAST(l_linenumber AS VARCHAR), 3, '0') AS point, l_linenumber AS step, count(*) AS n FROM lineitem GROUP BY ALL")
def point_keys(spark, d):
    log = V.log(spark, d)
    point = X.point_key(F.col("arm"), (42 + F.col("id") % 3).cast("string"), F.col("k"))
    out = log.groupBy(point.alias("point")).agg(F.count(F.lit(1)).alias("n"))
    return out.select("point", X.point_parts(F.col("point")).step.alias("step"), "n")


@query("SELECT id, len(r) AS items, len(list_filter(r, lambda c: c.weight < 0)) AS negative FROM rubric")
def judge_payload(spark, d):
    rows = V.rubric(spark, d).select("id", F.from_json(X.criteria_payload(F.col("r")), "array<struct<index:int,criterion:string,weight:double,polarity:string>>").alias("p"))
    return rows.select("id", F.size("p").cast("long").alias("items"), F.size(F.filter("p", lambda c: c.polarity == "negative")).cast("long").alias("negative"))


@query("SELECT p_partkey, CASE WHEN p_type LIKE 'ECONOMY%' THEN 'cheap' WHEN p_type LIKE 'STANDARD%' THEN 'usual' ELSE 'other' END AS theme FROM part")
def theme_lookup(spark, d):
    return V.table(spark, d, "part").select("p_partkey", X.theme(F.col("p_type"), {"ECONOMY": "cheap", "STANDARD": "usual"}).alias("theme"))


@query("""SELECT id, round(list_sum(list_transform(r, lambda c: CASE WHEN c.criterion IN ('c1', 'c2') THEN c.weight ELSE 0 END)) / nullif(list_sum(list_transform(r, lambda c: abs(c.weight))), 0), 6) AS share FROM rubric""")
def weight_share(spark, d):
    picked = R.total(F.filter("r", lambda c: c.criterion.isin("c1", "c2")), lambda c: c.weight)
    return V.rubric(spark, d).select("id", F.round(F.try_divide(picked, R.total(F.col("r"), lambda c: F.abs(c.weight))), 6).alias("share"))


@query(f""", pool AS (SELECT doc_id, row_number() OVER (ORDER BY doc_id) - 1 AS place, count(*) OVER () AS n_all FROM documents),
    dealt AS (SELECT * FROM {S.keyed_place_sql("pool", "place", 42)}), drawn AS (SELECT * FROM dealt WHERE draw_pos < n_all // 2)
    SELECT a.draw_pos AS pos, a.doc_id, b.doc_id AS next_id, CASE WHEN a.draw_pos < a.n_all // 10 THEN 'held_out' ELSE 'train' END AS split
    FROM drawn a JOIN drawn b ON b.draw_pos = (a.draw_pos + 1) % (a.n_all // 2)""")
def pool_split(spark, d):
    """Half of all documents drawn by a keyed permutation, a tenth held out and the others for training, each with its neighbour in draw order."""
    placed, n = S.placed(V.table(spark, d, "documents").select("doc_id"), "doc_id", "place")
    drawn = placed.withColumn("pos", S.keyed_place(F.col("place"), n, 42)).filter(F.col("pos") < n // 2).drop("place")
    return S.cyclic_next(drawn, "pos", n // 2, "doc_id", "next_id").withColumn("split", F.when(F.col("pos") < n // 10, "held_out").otherwise("train"))
