"""The star-schema tables in the roles of an evaluation run.

lineitem is the verdict log: id is the order, k the line number, the return flag
the verdict (N: the call failed), the supplier's remainder the arm.  orders are
the questions, conversations the prompts, events the training log.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

LATEST = ["ts", "p", "s"]

SQL_LOG = """log AS (
    SELECT 'a' || CAST(l_suppkey % 3 AS VARCHAR) AS arm, l_orderkey AS id, l_linenumber AS k,
           CASE l_returnflag WHEN 'R' THEN true WHEN 'A' THEN false END AS met,
           CASE WHEN l_discount >= 0.08 THEN -l_quantity ELSE l_quantity END AS w,
           l_linestatus AS status, l_shipdate AS ts, l_partkey AS p, l_suppkey AS s FROM lineitem)"""
SQL_CRITERIA = """criteria AS (
    SELECT id, k, w AS weight FROM log QUALIFY row_number() OVER (PARTITION BY id, k ORDER BY ts DESC, p DESC, s DESC) = 1)"""
SQL_GRADES = """grades AS (
    SELECT arm, id, k, met FROM log WHERE met IS NOT NULL
    QUALIFY row_number() OVER (PARTITION BY arm, id, k ORDER BY ts DESC, p DESC, s DESC) = 1)"""
SQL_FLAT = """flat AS (
    SELECT id, k, met FROM log WHERE met IS NOT NULL
    QUALIFY row_number() OVER (PARTITION BY id, k ORDER BY ts DESC, p DESC, s DESC) = 1)"""
SQL_RUBRIC = "rubric AS (SELECT id, list(struct_pack(criterion := 'c' || CAST(k AS VARCHAR), weight := weight) ORDER BY k) AS r FROM criteria GROUP BY id)"
SQL_MESSAGES = """chat AS (
    SELECT conv_id, list(struct_pack(role := role, text := text) ORDER BY turn) AS m FROM conversations GROUP BY conv_id)"""
SQL_WITH = f"WITH {SQL_LOG}, {SQL_CRITERIA}, {SQL_GRADES}, {SQL_FLAT}, {SQL_RUBRIC}, {SQL_MESSAGES} "


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def dealt(rows: DataFrame, key: str) -> DataFrame:
    """``rows`` by key in as many partitions as shuffles have; a fixed number, as small raw rows put together would be much for one task to group."""
    return rows.repartition(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), key)


def log(spark: SparkSession, sf_dir: str) -> DataFrame:
    flag, w = F.col("l_returnflag"), F.col("l_quantity")
    return table(spark, sf_dir, "lineitem").select(
        F.concat(F.lit("a"), (F.col("l_suppkey") % 3).cast("string")).alias("arm"), F.col("l_orderkey").alias("id"), F.col("l_linenumber").alias("k"),
        F.when(flag == "R", True).when(flag == "A", False).alias("met"), F.when(F.col("l_discount") >= 0.08, -w).otherwise(w).alias("w"),
        F.col("l_linestatus").alias("status"), F.col("l_shipdate").alias("ts"), F.col("l_partkey").alias("p"), F.col("l_suppkey").alias("s"),
    )


def criteria(spark: SparkSession, sf_dir: str) -> DataFrame:
    return log(spark, sf_dir).groupBy("id", "k").agg(F.max_by("w", F.struct(*LATEST)).alias("weight"))


def latest(value: str, where: Column | None = None) -> Column:
    """Aggregate: the value of the last row that has one (and fulfils ``where``)."""
    held = F.col(value).isNotNull()
    return F.max_by(value, F.when(held if where is None else held & where, F.struct(*LATEST)))


def judged(spark: SparkSession, sf_dir: str) -> DataFrame:
    """id, k, weight, met: each criterion with its last successful verdict, null without one; the log is read and dealt once."""
    return log(spark, sf_dir).groupBy("id", "k").agg(latest("w").alias("weight"), latest("met").alias("met"))


def rubric(spark: SparkSession, sf_dir: str) -> DataFrame:
    """id, r: array<struct<criterion, weight>> in order of k."""
    rows = criteria(spark, sf_dir).groupBy("id").agg(F.array_sort(F.collect_list(F.struct("k", "weight"))).alias("r"))
    return rows.select("id", F.transform("r", lambda c: F.struct(F.concat(F.lit("c"), c.k.cast("string")).alias("criterion"), c.weight.alias("weight"))).alias("r"))


def messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "role", "text"))).alias("m"))
    return rows.select("conv_id", F.transform("m", lambda x: F.struct(x.role.alias("role"), x.text.alias("text"))).alias("m"))
