"""Queries of the plain relational shapes over the star-schema tables."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from askloom.plans.common import table

QUERIES, SQL = {}, {}


def query(name: str, sql: str):
    def add(f):
        QUERIES[name], SQL[name] = f, sql
        return f

    return add


@query("pricing_summary", "SELECT l_returnflag, l_linestatus, round(sum(l_quantity), 2) AS qty, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue, count(*) AS n FROM lineitem WHERE l_shipdate <= TIMESTAMP '1998-09-02' GROUP BY ALL")
def pricing_summary(spark, d):
    rows = table(spark, d, "lineitem").where("l_shipdate <= TIMESTAMP '1998-09-02'")
    return rows.groupBy("l_returnflag", "l_linestatus").agg(F.round(F.sum("l_quantity"), 2).alias("qty"), F.round(F.sum(F.expr("l_extendedprice * (1 - l_discount)")), 2).alias("revenue"), F.count("*").alias("n"))


@query("revenue_by_nation", "SELECT n_name, r_name, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY ALL")
def revenue_by_nation(spark, d):
    t = lambda n: table(spark, d, n)
    facts = t("lineitem").join(t("orders"), F.col("l_orderkey") == F.col("o_orderkey")).join(t("customer"), F.col("o_custkey") == F.col("c_custkey"))
    full = facts.join(t("nation"), F.col("c_nationkey") == F.col("n_nationkey")).join(t("region"), F.col("n_regionkey") == F.col("r_regionkey"))
    return full.groupBy("n_name", "r_name").agg(F.round(F.sum(F.expr("l_extendedprice * (1 - l_discount)")), 2).alias("revenue"))


@query("customers_without_low", "SELECT c_custkey FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderpriority = '5-LOW')")
def customers_without_low(spark, d):
    """Customers without an order of low priority; every customer of the tables has some order."""
    low = table(spark, d, "orders").where("o_orderpriority = '5-LOW'")
    return table(spark, d, "customer").join(low, F.col("c_custkey") == F.col("o_custkey"), "left_anti").select("c_custkey")


@query("customers_with_urgent", "SELECT c_custkey FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders WHERE o_orderpriority = '1-URGENT')")
def customers_with_urgent(spark, d):
    urgent = table(spark, d, "orders").where("o_orderpriority = '1-URGENT'")
    return table(spark, d, "customer").join(urgent, F.col("c_custkey") == F.col("o_custkey"), "left_semi").select("c_custkey")


@query("segment_rollup", "SELECT coalesce(c_mktsegment, 'ALL') AS segment, coalesce(o_orderstatus, 'ALL') AS status, count(*) AS n FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY ROLLUP (c_mktsegment, o_orderstatus)")
def segment_rollup(spark, d):
    rows = table(spark, d, "orders").join(table(spark, d, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    out = rows.rollup("c_mktsegment", "o_orderstatus").agg(F.count("*").alias("n"))
    return out.select(F.coalesce("c_mktsegment", F.lit("ALL")).alias("segment"), F.coalesce("o_orderstatus", F.lit("ALL")).alias("status"), "n")


@query("top_orders", "SELECT o_custkey, o_orderkey, rn FROM (SELECT o_custkey, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS rn FROM orders) WHERE rn <= 3")
def top_orders(spark, d):
    rn = F.row_number().over(Window.partitionBy("o_custkey").orderBy(F.desc("o_totalprice"), "o_orderkey"))
    return table(spark, d, "orders").select("o_custkey", "o_orderkey", rn.cast("long").alias("rn")).where("rn <= 3")


@query("running_value", "SELECT event_id, round(sum(value) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), 4) AS running, lag(event_id) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS before FROM events")
def running_value(spark, d):
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    return table(spark, d, "events").select("event_id", F.round(F.sum("value").over(w.rowsBetween(Window.unboundedPreceding, 0)), 4).alias("running"), F.lag("event_id").over(w).alias("before"))


@query("hourly_events", "SELECT date_trunc('hour', ts) AS hour, event_type, count(*) AS n, round(avg(value), 6) AS mean FROM events GROUP BY ALL")
def hourly_events(spark, d):
    return table(spark, d, "events").groupBy(F.date_trunc("hour", "ts").alias("hour"), "event_type").agg(F.count("*").alias("n"), F.round(F.avg("value"), 6).alias("mean"))


@query("set_operations", "SELECT k, 'except' AS op FROM (SELECT c_nationkey AS k FROM customer EXCEPT SELECT s_nationkey FROM supplier WHERE s_acctbal > 0) UNION ALL SELECT k, 'intersect' FROM (SELECT c_nationkey AS k FROM customer INTERSECT SELECT s_nationkey FROM supplier WHERE s_acctbal > 0)")
def set_operations(spark, d):
    c = table(spark, d, "customer").select(F.col("c_nationkey").alias("k"))
    s = table(spark, d, "supplier").where("s_acctbal > 0").select(F.col("s_nationkey").alias("k"))
    return c.subtract(s).withColumn("op", F.lit("except")).unionByName(c.intersect(s).withColumn("op", F.lit("intersect")))


@query("part_types", "SELECT p_brand, count(DISTINCT p_type) AS types, max(p_size) AS largest, round(avg(p_retailprice), 2) AS price FROM part GROUP BY p_brand")
def part_types(spark, d):
    return table(spark, d, "part").groupBy("p_brand").agg(F.count_distinct("p_type").alias("types"), F.max("p_size").alias("largest"), F.round(F.avg("p_retailprice"), 2).alias("price"))
