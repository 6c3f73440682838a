"""Single records: scoring, benchmark replies, fallbacks, sets, orders, schedules of calls."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from galena.functions import records as C
from galena.functions import rubric as R
from galena.functions import text as T
from galena.operators import builds as B
from galena.operators import stats as S
from galena.plans import views as V
from galena.sources import scans

QUERIES, SQL = {}, {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            SQL[f.__name__] = V.SQL_WITH + sql
        return f

    return add


def _flat(spark, d):
    return V.log(spark, d).filter("met is not null").groupBy("id", "k").agg(F.max_by("met", F.struct(*V.LATEST)).alias("met"))


SQL_RECORDS = """answers AS (SELECT id, count(met) AS g, CASE WHEN sum(greatest(weight, 0)) > 0 THEN greatest(0, least(1, sum(weight * CAST(met AS INTEGER)) / sum(greatest(weight, 0)))) END AS score, sum(k * 100) AS chars FROM criteria LEFT JOIN flat USING (id, k) GROUP BY id),
    wholes AS (SELECT id, count(*) AS n FROM criteria GROUP BY id)"""


@query(f""", {SQL_RECORDS} SELECT o_orderkey AS id, CASE WHEN a.id IS NULL THEN 'missing id' WHEN o_orderstatus = 'P' THEN 'skipped' WHEN a.g < n THEN 'unjudged' WHEN score IS NULL THEN 'no positive weight' END AS error,
      CASE WHEN a.id IS NOT NULL AND o_orderstatus <> 'P' AND a.g = n THEN round(score, 6) END AS score, CASE WHEN a.id IS NOT NULL AND o_orderstatus <> 'P' AND a.g = n THEN round(score - 0.1 * (chars - 500) / 500, 6) END AS adjusted
    FROM orders LEFT JOIN answers a ON a.id = o_orderkey LEFT JOIN wholes w ON w.id = a.id""")
def record_scoring(spark, d):
    """A row for every question: its score and the length-adjusted one, or why there is none."""
    held = V.criteria(spark, d).join(_flat(spark, d), ["id", "k"], "left")
    earned, whole = F.sum(F.col("weight") * F.col("met").cast("double")), F.sum(F.greatest("weight", F.lit(0.0)))
    a = held.groupBy("id").agg(F.count("met").alias("g"), F.count(F.lit(1)).alias("n"), R.clipped(F.try_divide(earned, whole)).alias("s"), F.sum(F.col("k") * 100).alias("chars"))
    rows = V.table(spark, d, "orders").select(F.col("o_orderkey").alias("id"), "o_orderstatus").join(a, "id", "left")
    error = F.when(F.col("n").isNull(), "missing id").when(F.col("o_orderstatus") == "P", "skipped").when(F.col("g") < F.col("n"), "unjudged").when(F.col("s").isNull(), "no positive weight")
    good = error.isNull()
    return rows.select("id", error.alias("error"), F.when(good, F.round("s", 6)).alias("score"), F.when(good, F.round(R.length_adjusted(F.col("s"), F.col("chars"), 500.0, 0.1), 6)).alias("adjusted"))


@query("""SELECT event_id, CASE event_id % 4 WHEN 0 THEN 'A,B,C' WHEN 1 THEN 'A,B,C,D,E' WHEN 2 THEN 'A,B,C,D' ELSE 'A,B' END AS choices, CASE WHEN event_id % 3 = 0 THEN event_type WHEN event_id % 3 = 1 THEN 'B' ELSE NULL END AS gold FROM events""")
def mcq_choices(spark, d):
    """Letters from an options map, a count or the usual four; the gold answer from the first of its names."""
    turn, third = F.col("event_id") % 4, F.col("event_id") % 3
    none = F.create_map().cast("map<string,string>")
    options = F.when(turn == 0, F.create_map(F.lit("C"), F.lit("z"), F.lit("A"), F.lit("x"), F.lit("B"), F.lit("y"))).otherwise(none)
    count = F.when(turn == 1, 5).when(turn == 3, 2).otherwise(0)
    gold = C.first_text(F.when(third == 0, F.col("event_type")), F.when(third == 1, F.lit("B")), F.lit(" "))
    return V.table(spark, d, "events").select("event_id", F.array_join(C.choices(options, count), ",").alias("choices"), gold.alias("gold"))


@query("""SELECT l_orderkey AS id, count(DISTINCT l_linenumber) AS n, round(avg(g), 6) AS score FROM
    (SELECT l_orderkey, l_linenumber, 1 + l_partkey % 10 AS g FROM lineitem QUALIFY row_number() OVER (PARTITION BY l_orderkey, l_linenumber ORDER BY l_shipdate DESC, l_partkey DESC, l_suppkey DESC) = 1) GROUP BY l_orderkey
    HAVING bool_and(g <> 10) AND max(l_linenumber) = count(DISTINCT l_linenumber)""")
def writing_scores(spark, d):
    """Mean of criterion grades parsed from JSON replies, where every criterion has one; a grade without reason is none."""
    rows = V.log(spark, d).groupBy("id", "k").agg(F.max_by("p", F.struct(*V.LATEST)).alias("p"))
    number = 1 + F.col("p") % 10
    reply = F.concat(F.lit('Grade: {"score": '), number.cast("string"), F.lit(', "reason": "'), F.when(number == 10, " ").otherwise("because"), F.lit('"}'))
    graded = rows.select("id", "k", C.graded_reply(reply).alias("g"))
    return graded.groupBy("id").agg(F.count(F.lit(1)).alias("n"), F.count("g").alias("m"), F.max("k").alias("last"), F.round(F.avg("g"), 6).alias("score")).filter("n = m and last = n").select("id", "n", "score")


SQL_ARENA = """v AS (SELECT l_orderkey AS id, l_linenumber % 2 AS ord, max_by(l_partkey % 5, l_partkey * 1000 + l_suppkey) AS g FROM lineitem GROUP BY ALL),
    o AS (SELECT id, ord, CASE g WHEN 0 THEN 1.0 WHEN 1 THEN 1.0 WHEN 2 THEN 0.5 ELSE 0.0 END AS win, CASE WHEN g IN (0, 4) THEN 3 ELSE 1 END AS strength FROM v),
    m AS (SELECT id, sum(CASE WHEN ord = 0 THEN win ELSE 1 - win END * strength) AS s, sum(strength) AS t FROM o GROUP BY id HAVING count(*) = 2)"""


def _arena(spark, d):
    """id, s, t: strength-weighted wins of the candidate, and strengths, of ids judged in both orders."""
    g = F.max_by(F.col("l_partkey") % 5, F.col("l_partkey") * 1000 + F.col("l_suppkey"))
    v = V.table(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("id"), (F.col("l_linenumber") % 2).alias("ord")).agg(g.alias("g"))
    label = T.arena_label(F.concat(F.lit("My verdict is [["), F.element_at(F.array(*map(F.lit, ("A>>B", "A>B", "A=B", "B>A", "B>>A"))), (F.col("g") + 1).cast("int")), F.lit("]]")))
    win = F.when(label.isin("A>>B", "A>B"), 1.0).when(label == "A=B", 0.5).otherwise(0.0)
    o = v.select("id", "ord", win.alias("win"), F.when(label.isin("A>>B", "B>>A"), 3).otherwise(1).alias("strength"))
    own = F.when(F.col("ord") == 0, F.col("win")).otherwise(1 - F.col("win"))
    return o.groupBy("id").agg(F.sum(own * F.col("strength")).alias("s"), F.sum("strength").alias("t"), F.count(F.lit(1)).alias("n")).filter("n = 2")


@query(f""", {SQL_ARENA} SELECT o_orderpriority AS category, round(100 * sum(s) / sum(t), 4) AS win_rate, count(*) AS n FROM m JOIN orders ON o_orderkey = id GROUP BY 1""")
def arena_categories(spark, d):
    """Win rate of each category of games, from the candidate's side in both orders."""
    rows = _arena(spark, d).join(V.table(spark, d, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_orderpriority").alias("category")), "id")
    return rows.groupBy("category").agg(F.round(100 * F.sum("s") / F.sum("t"), 4).alias("win_rate"), F.count(F.lit(1)).alias("n"))


@query("""SELECT item_id, strip_prefix AS id, n FROM (SELECT item_id, CASE WHEN item_id % 2 = 0 THEN CAST(item_id AS VARCHAR) ELSE 'x:' || CAST(item_id AS VARCHAR) END AS strip_prefix, len(string_split(coalesce(text, ''), '. ')) AS n FROM benchmark)""")
def rubric_sizes(spark, d):
    """Questions of a benchmark under ids without their prefix, with the number of their criteria."""
    named = F.concat(F.when(F.col("item_id") % 2 == 0, "rq:").otherwise("x:"), F.col("item_id").cast("string"))
    return V.table(spark, d, "benchmark").select("item_id", C.without_prefix(named, "rq:").alias("id"), F.size(F.split(F.coalesce("text", F.lit("")), r"\. ")).cast("long").alias("n"))


@query("""SELECT p_partkey, p_name || chr(10) || 'brand: ' || p_brand || chr(10) || 'type: ' || p_type AS criterion FROM part""")
def criterion_text(spark, d):
    """A criterion's name and its other keys, a line each, in the order of the keys."""
    other = F.create_map(F.lit("type"), F.col("p_type"), F.lit("brand"), F.col("p_brand"))
    lines = F.transform(F.array_sort(F.map_entries(other)), lambda e: F.concat(e.key, F.lit(": "), e.value))
    return V.table(spark, d, "part").select("p_partkey", F.concat_ws("\n", "p_name", F.array_join(lines, "\n")).alias("criterion"))


@query("""SELECT p_partkey, CASE p_size % 4 WHEN 0 THEN p_type || chr(10) || chr(10) || p_brand WHEN 1 THEN p_type WHEN 2 THEN p_brand ELSE '(none)' END AS anchor FROM part""")
def anchor_texts(spark, d):
    k = F.col("p_size") % 4
    return V.table(spark, d, "part").select("p_partkey", C.anchor_text(F.when(k < 2, F.col("p_type")).when(k == 2, " "), F.when(k.isin(0, 2), F.col("p_brand"))).alias("anchor"))


@query("""SELECT p_partkey, p_name || CASE WHEN p_size % 2 = 0 THEN p_type ELSE '' END AS content FROM part""")
def reply_contents(spark, d):
    """A reply's text, or its parts put together."""
    part = lambda c: F.struct(F.lit("text").alias("type"), c.alias("text"))
    content = F.when(F.col("p_size") % 2 == 0, F.to_json(F.array(part(F.col("p_name")), part(F.col("p_type"))))).otherwise(F.col("p_name"))
    return V.table(spark, d, "part").select("p_partkey", C.content_text(content).alias("content"))


@query("""SELECT conv_id, left(array_to_string(list_transform(m, lambda x: x.text), chr(10) || chr(10)), 600) AS question, len(array_to_string(list_transform(m, lambda x: x.text), chr(10) || chr(10))) > 600 AS cut FROM chat""")
def labelled_questions(spark, d):
    """All messages of a question, apart by blank lines, as much as a labeller is shown."""
    whole = F.array_join(F.transform("m", lambda x: x.text), "\n\n")
    return V.messages(spark, d).select("conv_id", F.left(whole, F.lit(600)).alias("question"), (F.length(whole) > 600).alias("cut"))


@query("""SELECT p_partkey, p_size BETWEEN 10 AND 40 AS in_band, round(length(p_name) / length(p_type), 6) AS ratio, CASE WHEN length(p_name) / length(p_type) BETWEEN 0.8 AND 1.25 THEN NULL ELSE 'length' END AS error FROM part""")
def length_bands(spark, d):
    ratio = F.length("p_name") / F.length("p_type")
    return V.table(spark, d, "part").select("p_partkey", F.col("p_size").between(10, 40).alias("in_band"), F.round(ratio, 6).alias("ratio"), F.when(~ratio.between(0.8, 1.25), "length").alias("error"))


@query("""SELECT o_orderkey AS id, coalesce(CASE WHEN o_orderkey % 3 = 0 THEN o_orderpriority END, CASE WHEN o_orderkey % 3 = 1 THEN 'c' || CAST(o_custkey AS VARCHAR) END, 'unknown') AS group_id,
    CASE WHEN o_orderkey % 2 = 0 THEN o_orderpriority ELSE o_orderstatus || chr(10) || o_orderpriority END AS problem, CASE WHEN o_orderkey % 4 = 0 THEN o_orderstatus END AS reference FROM orders""")
def field_fallbacks(spark, d):
    """The group id, problem and reference answer of a row, each from the first of its names that has text."""
    k = F.col("o_orderkey")
    group = C.group_id(F.when(k % 3 == 0, F.col("o_orderpriority")), F.when(k % 3 == 1, F.concat(F.lit("c"), F.col("o_custkey").cast("string"))), F.lit("  "))
    raw = F.array_join(F.array("o_orderstatus", "o_orderpriority"), "\n")
    return V.table(spark, d, "orders").select(k.alias("id"), group.alias("group_id"), C.first_text(F.when(k % 2 == 0, F.col("o_orderpriority")), raw).alias("problem"), C.first_text(F.lit(""), F.when(k % 4 == 0, F.col("o_orderstatus"))).alias("reference"))


@query("""SELECT id, ok, CASE WHEN ok THEN len(r) ELSE 0 END AS n, CASE WHEN ok THEN len(list_filter(r, lambda c: c.weight < 0)) ELSE 0 END AS negative FROM (SELECT *, list_max(list_transform(r, lambda c: c.weight)) > 0 AND id % 5 <> 0 AS ok FROM rubric)""")
def reward_rubrics(spark, d):
    """Checklists from JSON text: negative weights stay, an empty criterion or no positive weight makes the row unusable."""
    text = F.to_json(F.transform("r", lambda c: F.struct(F.when(F.col("id") % 5 == 0, "  ").otherwise(c.criterion).alias("criterion"), c.weight.alias("weight"))))
    rows = V.rubric(spark, d).select("id", C.reward_rubric(text).alias("c"))
    own = F.coalesce("c", F.array().cast("array<struct<criterion:string,weight:double>>"))
    return rows.select("id", F.col("c").isNotNull().alias("ok"), F.size(own).cast("long").alias("n"), F.size(F.filter(own, lambda x: x.weight < 0)).cast("long").alias("negative"))


@query("""SELECT p_partkey, CASE WHEN w IN ('1', 'true', 'yes', 'on') THEN true WHEN w IN ('0', 'false', 'no', 'off', '') THEN false END AS value FROM (SELECT p_partkey, lower(trim(said)) AS w FROM
    (SELECT p_partkey, CASE WHEN p_partkey % 3 = 0 THEN upper(w) WHEN p_partkey % 3 = 1 THEN ' ' || w ELSE w || ' ' END AS said FROM (SELECT p_partkey, CASE p_size % 7 WHEN 0 THEN 'true' WHEN 1 THEN 'false' WHEN 2 THEN p_name WHEN 3 THEN 'On' WHEN 4 THEN 'no' WHEN 5 THEN CAST(p_size AS VARCHAR) ELSE CAST(p_partkey % 2 AS VARCHAR) END AS w FROM part)))""")
def option_values(spark, d):
    """Options in several spellings, and words and numbers that are none."""
    turn, third = F.col("p_size") % 7, F.col("p_partkey") % 3
    w = F.when(turn == 0, "true").when(turn == 1, "false").when(turn == 2, F.col("p_name")).when(turn == 3, "On").when(turn == 4, "no").when(turn == 5, F.col("p_size").cast("string")).otherwise((F.col("p_partkey") % 2).cast("string"))
    said = F.when(third == 0, F.upper(w)).when(third == 1, F.concat(F.lit(" "), w)).otherwise(F.concat(w, F.lit(" ")))
    return V.table(spark, d, "part").select("p_partkey", C.option(said).alias("value"))


@query("""SELECT coalesce(lang, '') AS lang, coalesce(source, '') AS source, coalesce(n_chars, 0) AS n_chars, 'none' AS note, doc_id AS id FROM documents""")
def conformed_rows(spark, d):
    """Rows in a fixed schema: what is absent or null takes a default, what the schema lacks goes."""
    docs = V.table(spark, d, "documents")
    schema = {"lang": "", "source": "", "n_chars": 0, "note": "none"}
    return docs.select(*C.conformed({c: F.col(c) for c in docs.columns}, schema), F.col("doc_id").alias("id"))


@query("""SELECT p_partkey, CASE WHEN status = 429 OR contains(said, '429') OR contains(lower(said), 'too many requests') THEN 'throttled' WHEN status BETWEEN 500 AND 599 THEN 'retryable' ELSE 'final' END AS class
    FROM (SELECT p_partkey, CASE WHEN p_partkey % 5 > 0 THEN 400 + (p_partkey * 7 + p_size) % 200 END AS status, CASE WHEN p_partkey % 6 = 0 THEN p_name || ' ' || CAST(p_partkey * 13 AS VARCHAR) WHEN p_partkey % 6 = 1 THEN 'Too Many Requests' WHEN p_partkey % 6 < 5 THEN p_type ELSE '' END AS said FROM part)""")
def error_classes(spark, d):
    """Statuses from 400 to 599 or none, beside messages of which some name the limit."""
    k, text = F.col("p_partkey") % 6, F.col("p_name")
    status = F.when(F.col("p_partkey") % 5 > 0, 400 + (F.col("p_partkey") * 7 + F.col("p_size")) % 200)
    said = F.when(k == 0, F.concat(text, F.lit(" "), (F.col("p_partkey") * 13).cast("string"))).when(k == 1, "Too Many Requests").when(k < 5, F.col("p_type")).otherwise("")
    return V.table(spark, d, "part").select("p_partkey", C.error_class(status, said).alias("class"))


@query("""SELECT user_id % 10 AS worker, CAST(sum(CAST(json_extract(props, '$.k') AS BIGINT)) AS BIGINT) AS tokens, count(*) AS calls, CAST(sum(CASE WHEN event_id % 3 = 0 THEN CAST(json_extract(props, '$.k') AS BIGINT) ELSE 0 END) AS BIGINT) AS reasoning FROM events GROUP BY 1""")
def usage_totals(spark, d):
    """Usage summed over calls, nested reasoning tokens too, which not every call reports."""
    k = F.get_json_object("props", "$.k").cast("long")
    usage = F.create_map(F.lit("total"), k, F.lit("reasoning"), F.when(F.col("event_id") % 3 == 0, k))
    rows = V.table(spark, d, "events").select((F.col("user_id") % 10).alias("worker"), usage.alias("u"))
    return rows.groupBy("worker").agg(F.sum(F.col("u")["total"]).alias("tokens"), F.count(F.lit(1)).alias("calls"), F.sum(F.coalesce(F.col("u")["reasoning"], F.lit(0))).alias("reasoning"))


@query("""SELECT o_orderpriority AS arm, coalesce(stddev_samp(v), 0) > 0 AS several, round(stddev_samp(v), 4) AS sd, round(stddev_pop(v), 4) AS spread, count(*) AS n FROM (SELECT o_orderpriority, CASE WHEN o_orderpriority = '5-LOW' THEN 0 ELSE o_custkey % 2 END AS seed, round(avg(o_totalprice), 6) AS v FROM orders GROUP BY ALL) GROUP BY 1""")
def sample_and_population_sd(spark, d):
    """Both deviations of seeds' means; the sample's is null for one seed."""
    seed = F.when(F.col("o_orderpriority") == "5-LOW", 0).otherwise(F.col("o_custkey") % 2)
    v = V.table(spark, d, "orders").groupBy(F.col("o_orderpriority").alias("arm"), seed.alias("seed")).agg(F.round(F.avg("o_totalprice"), 6).alias("v"))
    sd = F.stddev_samp("v")
    return v.groupBy("arm").agg((F.coalesce(sd, F.lit(0.0)) > 0).alias("several"), F.round(sd, 4).alias("sd"), F.round(F.stddev_pop("v"), 4).alias("spread"), F.count(F.lit(1)).alias("n"))


@query("""SELECT o_orderkey AS id, o_orderpriority AS domain, n, w FROM orders JOIN (SELECT id, len(r) AS n, list_sum(list_transform(r, lambda c: c.weight)) AS w FROM rubric) r ON r.id = o_orderkey WHERE o_orderstatus IN ('O', 'F')""")
def question_answers(spark, d):
    """Questions with their checklists, of a set of sources."""
    q = V.table(spark, d, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_orderpriority").alias("domain"), "o_orderstatus")
    wanted = spark.createDataFrame([("O",), ("F",)], "o_orderstatus string")
    return q.join(F.broadcast(wanted), "o_orderstatus", "left_semi").join(V.rubric(spark, d), "id").select("id", "domain", F.size("r").cast("long").alias("n"), R.total(F.col("r"), lambda c: c.weight).alias("w"))


@query("""SELECT b.user_id, b.event_id, b.value - a.value AS change FROM (SELECT user_id, event_id, value FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) = 1) a
    JOIN events b ON b.user_id = a.user_id AND b.event_id <> a.event_id""")
def later_exposures(spark, d):
    """Every later exposure against the first of its key, without a join of the table with itself."""
    over = Window.partitionBy("user_id").orderBy("ts", "event_id")
    rows = V.table(spark, d, "events").select("user_id", "event_id", "value", F.first("value").over(over).alias("first"), F.row_number().over(over).alias("r"))
    return rows.filter("r > 1").select("user_id", "event_id", (F.col("value") - F.col("first")).alias("change"))


@query("""SELECT count(*) AS missing FROM (SELECT DISTINCT l_orderkey FROM lineitem WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders))""")
def frozen_subset(spark, d):
    """How many ids of a frozen list the live one lacks."""
    frozen = V.table(spark, d, "lineitem").select(F.col("l_orderkey").alias("id"))
    return B.subset_missing(frozen, V.table(spark, d, "orders").select(F.col("o_orderkey").alias("id")), "id").agg(F.count(F.lit(1)).alias("missing"))


@query("""SELECT id, max_by(prompt, f) AS prompt FROM (SELECT conv_id AS id, text AS prompt, turn AS f FROM conversations WHERE role = 'user') GROUP BY id""")
def prompts_by_id(spark, d):
    """Prompts of several files under one id: the last file's stays."""
    rows = V.table(spark, d, "conversations").filter("role = 'user'").select(F.col("conv_id").alias("id"), F.col("text").alias("prompt"), F.col("turn").alias("f"))
    return rows.groupBy("id").agg(F.max_by("prompt", "f").alias("prompt"))


@query("""SELECT l_orderkey AS id, max_by(l_quantity, (l_shipdate, l_partkey, l_suppkey)) AS score FROM lineitem WHERE l_returnflag <> 'N' GROUP BY 1""")
def clean_scores(spark, d):
    """The last score that isn't null, of each question."""
    rows = V.table(spark, d, "lineitem").select(F.col("l_orderkey").alias("id"), F.when(F.col("l_returnflag") != "N", F.col("l_quantity")).alias("score"), F.struct("l_shipdate", "l_partkey", "l_suppkey").alias("ln"))
    return rows.filter("score is not null").groupBy("id").agg(F.max_by("score", "ln").alias("score"))


@query("""SELECT o_orderkey AS id, row_number() OVER (ORDER BY length(CAST(o_orderkey AS VARCHAR)), CAST(o_orderkey AS VARCHAR)) AS place FROM orders QUALIFY place <= 40""")
def first_ids(spark, d):
    """The first ids as people sort numbers in text: by length, then as text."""
    text = F.col("id").cast("string")
    top = V.table(spark, d, "orders").select(F.col("o_orderkey").alias("id")).orderBy(F.length(text), text).limit(40)
    return top.withColumn("place", F.row_number().over(Window.orderBy(F.length(text), text)))  # 40 rows


@query("""SELECT l.pos, o_orderkey AS id, o_totalprice AS v FROM orders JOIN (VALUES (1, 32), (2, 7), (3, 1), (4, 3)) l(pos, id) ON l.id = o_orderkey""")
def list_order(spark, d):
    """Rows of a list of ids, with their place in it."""
    wanted = spark.createDataFrame([(1, 32), (2, 7), (3, 1), (4, 3)], "pos int, id long")
    return V.table(spark, d, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_totalprice").alias("v")).join(F.broadcast(wanted), "id").select("pos", "id", "v")


@query("""SELECT id, CASE n_true WHEN 0 THEN 'zero' WHEN k THEN 'all' ELSE CASE WHEN n_true = k - 1 THEN 'one_short' ELSE 'middle' END END AS state, majority FROM
    (SELECT id, count(*) AS k, count(*) FILTER (WHERE m) AS n_true, string_agg(CAST(CAST(m AS INTEGER) AS VARCHAR), '' ORDER BY k) AS majority FROM
      (SELECT id, k, avg(CAST(met AS INTEGER)) > 0.5 AS m FROM log WHERE met IS NOT NULL GROUP BY id, k) GROUP BY id)""")
def majority_states(spark, d):
    """Each criterion's majority over attempts, and the state of the whole vector."""
    per = V.log(spark, d).filter("met is not null").groupBy("id", "k").agg((F.avg(F.col("met").cast("int")) > 0.5).alias("m"))
    rows = per.groupBy("id").agg(F.array_sort(F.collect_list(F.struct("k", "m"))).alias("v"))
    yes, n = F.size(F.filter("v", lambda x: x.m)), F.size("v")
    state = F.when(yes == 0, "zero").when(yes == n, "all").when(yes == n - 1, "one_short").otherwise("middle")
    return rows.select("id", state.alias("state"), F.array_join(F.transform("v", lambda x: x.m.cast("int").cast("string")), "").alias("majority"))


@query("""SELECT id, list_sum(list_transform(r, lambda c: c.weight)) AS whole, array_to_string(list_transform(list_filter(r, lambda c: c.weight > 0), lambda c: c.criterion), '+') AS positive FROM rubric""")
def arm_maps(spark, d):
    """Checklists by arm as a map, looked up again."""
    rows = V.rubric(spark, d).select("id", F.create_map(F.lit("whole"), F.col("r"), F.lit("positive"), F.filter("r", lambda c: c.weight > 0)).alias("arms"))
    return rows.select("id", R.total(F.col("arms")["whole"], lambda c: c.weight).alias("whole"), F.array_join(F.transform(F.col("arms")["positive"], lambda c: c.criterion), "+").alias("positive"))


@query("""SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events""")
def text_or_struct(spark, d):
    """A column that one source has as JSON text and another as a struct."""
    rows = V.table(spark, d, "events")
    parsed = F.from_json("props", "k long")
    as_text, as_struct = rows.filter("event_id % 2 = 0").select("event_id", parsed.alias("p")), rows.filter("event_id % 2 = 1").select("event_id", F.struct(F.get_json_object("props", "$.k").cast("long").alias("k")).alias("p"))
    return as_text.unionByName(as_struct).select("event_id", "p.k")


@query("""SELECT bucket, round(avg(v), 6) AS mean, count(*) AS n FROM (SELECT l_linenumber * 10 AS step, l_linenumber % 2 AS bucket, l_quantity AS v FROM lineitem) WHERE step % 20 = 0 GROUP BY bucket""")
def sampled_steps(spark, d):
    """Every second of the steps, as checkpoints are taken."""
    rows = V.table(spark, d, "lineitem").select((F.col("l_linenumber") * 10).alias("step"), (F.col("l_linenumber") % 2).alias("bucket"), F.col("l_quantity").alias("v"))
    return rows.filter("step % 20 = 0").groupBy("bucket").agg(F.round(F.avg("v"), 6).alias("mean"), F.count(F.lit(1)).alias("n"))


@query("""SELECT v AS x, round_even(v, 0) AS whole, round(1 / (1 + exp(v / 10.0 - 2)), 6) AS strength FROM (SELECT DISTINCT p_size + 0.5 AS v FROM part)""")
def half_even_rounding(spark, d):
    v = V.table(spark, d, "part").select((F.col("p_size") + 0.5).alias("v")).distinct()
    return v.select(F.col("v").alias("x"), S.half_even(F.col("v"), 0).alias("whole"), F.round(1 / (1 + F.exp(F.col("v") / 10.0 - 2)), 6).alias("strength"))


@query(""", rep AS (SELECT id, met, row_number() OVER (PARTITION BY id ORDER BY ts, p, s, k) AS i FROM log WHERE met IS NOT NULL) SELECT id, string_agg(CAST(CAST(met AS INTEGER) AS VARCHAR), '' ORDER BY i) FILTER (WHERE i <= 3) AS first_draw FROM rep GROUP BY id""")
def first_draws(spark, d):
    """The first draw of a repeated row's verdicts, whether they come as arrays or as JSON."""
    rows = V.log(spark, d).filter("met is not null").groupBy("id").agg(F.array_sort(F.collect_list(F.struct("ts", "p", "s", "k", "met"))).alias("v"))
    draws = F.transform(F.sequence(F.lit(0), F.size("v") - 1, F.lit(3)), lambda i: F.transform(F.slice("v", i + 1, F.lit(3)), lambda x: x.met))
    text = rows.select("id", F.to_json(draws).alias("satisfied"))
    first = F.element_at(F.from_json("satisfied", "array<array<boolean>>"), 1)
    return text.select("id", F.array_join(F.transform(first, lambda m: m.cast("int").cast("string")), "").alias("first_draw"))


@query("""SELECT CAST(o_orderkey AS VARCHAR) AS id, 'user' AS first_role, CASE WHEN o_orderkey % 2 = 0 THEN o_orderpriority ELSE '' END AS first_text, CASE WHEN o_orderkey % 2 = 0 THEN o_orderpriority ELSE 'asks ' || o_orderstatus END AS problem, n, w FROM orders
    JOIN (SELECT id, len(r) AS n, list_sum(list_transform(r, lambda c: c.weight)) AS w FROM rubric WHERE list_max(list_transform(r, lambda c: c.weight)) > 0) r ON r.id = o_orderkey""")
def contract_rows(spark, d):
    """Questions of another shape (messages without role or content, a checklist under other names, the id in extra_info) as contract rows."""
    orders = V.table(spark, d, "orders").select(F.col("o_orderkey").alias("id"), F.when(F.col("o_orderkey") % 2 == 0, F.col("o_orderpriority")).alias("said"), F.when(F.col("o_orderkey") % 2 == 1, F.concat(F.lit(" asks "), "o_orderstatus")).alias("problem"))
    fit = V.rubric(spark, d).filter(F.exists("r", lambda c: c.weight > 0))
    turn = F.struct(F.lit(None).cast("string").alias("role"), F.col("said").alias("content"))
    strange = F.transform("r", lambda c: F.struct(F.concat(F.lit(" "), c.criterion).alias("text"), c.weight.cast("int").alias("points")))
    rows = orders.join(fit, "id").select(F.array(turn).alias("messages"), strange.alias("criteria"), F.struct(F.col("id").alias("uid"), "problem").alias("extra_info"))
    out = scans.contract(rows)
    first = F.element_at("messages", 1)
    return out.select("id", first.role.alias("first_role"), first.text.alias("first_text"), "problem", F.size("rubric").cast("long").alias("n"), R.total(F.col("rubric"), lambda c: c.weight).alias("w"))


@query("""SELECT doc_id AS id, length(text) AS chars FROM documents WHERE coalesce(source, 'src1') = 'src1' AND doc_id % 7 <> 0 AND length(text) > 0""")
def gated_responses(spark, d):
    """Responses of a suite, or of none, without an error and not empty."""
    rows = V.table(spark, d, "documents").select(F.col("doc_id").alias("id"), F.col("text").alias("response"), F.col("source").alias("data_source"), F.when(F.col("doc_id") % 7 == 0, "down").alias("error"))
    return scans.gated(rows, "src1").select("id", F.length("response").cast("long").alias("chars"))


@query("""SELECT p_partkey, CASE WHEN p_size % 3 = 2 THEN p_type || ' ```x' ELSE p_type END AS inside, p_type AS bare, '{"a": "' || p_brand || '"}' AS object, p_size % 3 = 0 AS cjk, regexp_replace(p_name || '/' || p_type, '[^A-Za-z0-9._-]+', '_', 'g') AS file FROM part""")
def text_cleaning(spark, d):
    """Replies in code fences of three kinds, objects inside prose, a language mark and safe file names."""
    k = F.col("p_size") % 3
    fenced = F.when(k == 0, F.concat(F.lit("```json\n"), "p_type", F.lit("\n```"))).when(k == 1, F.concat(F.lit(" ```text\n"), "p_type")).otherwise(F.concat("p_type", F.lit("\n")))
    prose = F.concat(F.lit('so {"a": "'), "p_brand", F.lit('"} it is'))
    said = F.when(k == 0, F.concat("p_name", F.lit(" \u6f22"))).otherwise(F.col("p_name"))
    titled = F.when(k == 2, F.concat(F.lit(" "), "p_type", F.lit(" ```x"))).otherwise(F.concat(F.lit("```json title="), "p_name", F.lit("\n"), "p_type", F.when(k == 0, "\n``` ").otherwise("\n")))
    return V.table(spark, d, "part").select("p_partkey", T.without_fence_line(titled).alias("inside"), T.without_fence(fenced).alias("bare"), T.embedded_object(prose).alias("object"), T.has_cjk(said).alias("cjk"), T.safe_name(F.concat_ws("/", "p_name", "p_type")).alias("file"))
