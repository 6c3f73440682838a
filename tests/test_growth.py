"""Steps that used to move or sort rows several times, against plain Python, and by what their plans hold."""

import random

from pyspark.sql import functions as F

from galena.operators import axes as A
from galena.operators import evaluation as E
from galena.operators import grades as G
from galena.operators import pairwise as P
from galena.plans import REGISTRY


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_passes_of_arms_are_each_arms_passes(spark):
    r = random.Random(6)
    rows = [(k, i, r.choice([None, True, False]), r.choice([None, None, True])) for k in range(30) for i in range(r.randint(1, 6))]
    df = spark.createDataFrame(rows, "k int, i int, a boolean, b boolean")
    got = {(x.arm, x.k, x.met, x.tries) for x in E.passes_of_arms(df, ["k"], ["a", "b"], ["i"], 3).collect()}
    assert got == {(arm, x.k, x.met, x.tries) for arm in "ab" for x in E.passes(df, ["k"], arm, ["i"], 3).withColumnRenamed(arm, "met").collect()}


def test_pending_calls_need_no_join(spark):
    rows = [(1, "a", None), (1, "a", True), (2, "a", None), (None, "a", False), (3, None, None), (2, "b", False)]
    df = spark.createDataFrame(rows, "id int, arm string, met boolean")
    want = G.pending(df.select("id", "arm").distinct(), df.filter("met is not null"), ["id", "arm"])
    got = G.pending_calls(df, ["id", "arm"], "met")
    assert set(map(tuple, got.collect())) == set(map(tuple, want.collect())) and "Join" not in plan_of(got)


def test_complete_means_need_no_join(spark):
    rows = [("a", 0, 1.0), ("a", 1, None), ("b", 0, 1.0), ("b", 0, 2.0), ("c", 1, 1.0), ("d", 0, 5.0), ("e", None, 1.0), (None, 0, 2.0)]
    df = spark.createDataFrame(rows, "id string, k int, score double")
    got = P.criterion_mean_of(df, ["id"], "k", "score")
    assert set(map(tuple, got.collect())) == {("a", 1.0), ("d", 5.0), (None, 2.0)} and "Join" not in plan_of(got)


def test_sets_of_a_row_are_summed_in_one_pass(spark):
    r = random.Random(3)
    rows = [(i, c, r.choice([None, 1.0, 2.0])) for i in range(50) for c in (0, 1)]
    df = spark.createDataFrame(rows, "id int, cell int, v double").withColumn("is_x", F.col("id") < 20).withColumn("is_y", F.lit(True))
    got = {x.cell: x for x in A.on_sets(df, "cell", {"x": ("v",), "y": ("v",)}, {"x": ("v",), "y": ()}).collect()}
    for c in (0, 1):
        own = [v for i, k, v in rows if k == c and i < 20 and v is not None]
        assert (got[c].n_x, got[c].in_x, got[c].n_y) == (20, len(own), 50) and got[c].v == sum(own) / len(own)


def test_logs_are_dealt_once_by_id(spark, tmp_path):
    kinds = "l_orderkey long, l_partkey long, l_suppkey long, l_linenumber int, l_quantity double, l_discount double, l_tax double, l_returnflag string, l_linestatus string, l_shipdate timestamp"
    spark.createDataFrame([], kinds).write.parquet(str(tmp_path / "lineitem.parquet"))
    for name in ("probe_grades", "retry_passes", "folded_calls", "repeat_average", "resume_anti_join", "criterion_complete_mean"):
        plan = plan_of(REGISTRY[name](spark, str(tmp_path)))
        assert plan.count("Exchange hashpartitioning") == 1 and "Join" not in plan, name


def test_logs_and_rubrics_are_each_dealt_once(spark):
    plan = plan_of(REGISTRY["grades_by_cell"](spark, "/root/testdata/sf0.001"))
    assert plan.count("Exchange hashpartitioning") == 3  # calls by id, rubrics by id, the cells
