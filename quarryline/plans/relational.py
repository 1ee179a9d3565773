"""Relational extras: join and aggregate shapes that the engine's own operators are made of, over the star schema."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from quarryline.plans.roles import table


def revenue_by_nation(spark, sf):
    li, o, c, n = (table(spark, sf, t) for t in ("lineitem", "orders", "customer", "nation"))
    return li.join(o, li["l_orderkey"] == o["o_orderkey"]).join(c, o["o_custkey"] == c["c_custkey"]).join(n, c["c_nationkey"] == n["n_nationkey"]).groupBy("n_name").agg(F.round(F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))), 2).alias("revenue"))


def pricing_summary(spark, sf):
    li = table(spark, sf, "lineitem").where("l_shipdate <= TIMESTAMP_NTZ '1998-09-02'")
    return li.groupBy("l_returnflag", "l_linestatus").agg(F.sum("l_quantity").alias("sum_qty"), F.round(F.sum("l_extendedprice"), 2).alias("sum_price"), F.round(F.avg("l_discount"), 6).alias("avg_disc"), F.count(F.lit(1)).alias("n"))


def customers_without_orders(spark, sf):
    c, o = table(spark, sf, "customer"), table(spark, sf, "orders")
    return c.join(o, c["c_custkey"] == o["o_custkey"], "left_anti").select("c_custkey")


def customers_with_urgent_orders(spark, sf):
    c, o = table(spark, sf, "customer"), table(spark, sf, "orders")
    return c.join(o.where("o_orderpriority = '1-URGENT'"), c["c_custkey"] == o["o_custkey"], "left_semi").select("c_custkey")


def orders_cube(spark, sf):
    return table(spark, sf, "orders").cube("o_orderstatus", "o_orderpriority").agg(F.count(F.lit(1)).alias("n"), F.grouping_id().alias("g"))


def status_pivot(spark, sf):
    o = table(spark, sf, "orders")
    return o.groupBy("o_orderpriority").pivot("o_orderstatus", ["F", "O", "P"]).agg(F.count(F.lit(1))).na.fill(0)


def running_spend(spark, sf):
    w = Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey")
    return table(spark, sf, "orders").select("o_orderkey", F.round(F.sum("o_totalprice").over(w.rowsBetween(Window.unboundedPreceding, 0)), 2).alias("spent"), F.row_number().over(w).cast("long").alias("nth"))


def last_event_before_order(spark, sf):
    """As-of join: for each error event the last purchase of its user, by one window over the union of both sides."""
    e = table(spark, sf, "events")
    kinds = ["event_id", "user_id", "ts", "event_type"]
    w = Window.partitionBy("user_id").orderBy("ts", F.col("event_type").cast("string"), "event_id").rowsBetween(Window.unboundedPreceding, -1)
    found = e.select(*kinds).withColumn("last_purchase", F.last(F.when(F.col("event_type") == "purchase", F.col("event_id")), ignorenulls=True).over(w))
    return found.where("event_type = 'error'").select("event_id", "last_purchase")


def suppliers_of_sized_parts(spark, sf):
    """Range join by buckets of ten sizes, so that it is an equality join first."""
    p = table(spark, sf, "part")
    bands = spark.range(5).select((F.col("id") * 10 + 1).alias("lo"), (F.col("id") * 10 + 10).alias("hi"), F.col("id").alias("bucket"))
    return p.withColumn("bucket", F.floor((F.col("p_size") - 1) / 10)).join(bands, "bucket").where("p_size BETWEEN lo AND hi").groupBy("lo", "hi").agg(F.count(F.lit(1)).alias("n"))


def segments_both(spark, sf):
    c = table(spark, sf, "customer")
    return c.where("c_acctbal > 5000").select("c_nationkey").intersect(c.where("c_mktsegment = 'BUILDING'").select("c_nationkey"))


def nations_without_suppliers(spark, sf):
    n, s = table(spark, sf, "nation"), table(spark, sf, "supplier")
    return n.select(F.col("n_nationkey").alias("k")).exceptAll(s.select(F.col("s_nationkey").alias("k")).distinct())


def event_props(spark, sf):
    return table(spark, sf, "events").select("event_id", F.get_json_object("props", "$.k").cast("long").alias("k"))


QUERIES = {
    "revenue_by_nation": (revenue_by_nation, "SELECT n_name, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey GROUP BY 1"),
    "pricing_summary": (pricing_summary, "SELECT l_returnflag, l_linestatus, sum(l_quantity) AS sum_qty, round(sum(l_extendedprice), 2) AS sum_price, round(avg(l_discount), 6) AS avg_disc, count(*) AS n FROM lineitem WHERE l_shipdate <= TIMESTAMP '1998-09-02' GROUP BY ALL"),
    "customers_without_orders": (customers_without_orders, "SELECT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders)"),
    "customers_with_urgent_orders": (customers_with_urgent_orders, "SELECT c_custkey FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders WHERE o_orderpriority = '1-URGENT')"),
    "orders_cube": (orders_cube, "SELECT o_orderstatus, o_orderpriority, count(*) AS n, grouping_id(o_orderstatus, o_orderpriority) AS g FROM orders GROUP BY CUBE (o_orderstatus, o_orderpriority)"),
    "status_pivot": (status_pivot, "SELECT o_orderpriority, count(*) FILTER (o_orderstatus = 'F') AS \"F\", count(*) FILTER (o_orderstatus = 'O') AS \"O\", count(*) FILTER (o_orderstatus = 'P') AS \"P\" FROM orders GROUP BY 1"),
    "running_spend": (running_spend, "SELECT o_orderkey, round(sum(o_totalprice) OVER w, 2) AS spent, row_number() OVER w AS nth FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)"),
    "last_event_before_order": (last_event_before_order, "SELECT event_id, last_purchase FROM (SELECT event_id, event_type, last_value(CASE WHEN event_type = 'purchase' THEN event_id END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY ts, event_type, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS last_purchase FROM events) WHERE event_type = 'error'"),
    "suppliers_of_sized_parts": (suppliers_of_sized_parts, "SELECT b * 10 + 1 AS lo, b * 10 + 10 AS hi, count(*) AS n FROM (SELECT CAST(floor((p_size - 1) / 10) AS BIGINT) AS b FROM part) GROUP BY b"),
    "segments_both": (segments_both, "SELECT c_nationkey FROM customer WHERE c_acctbal > 5000 INTERSECT SELECT c_nationkey FROM customer WHERE c_mktsegment = 'BUILDING'"),
    "nations_without_suppliers": (nations_without_suppliers, "SELECT n_nationkey AS k FROM nation WHERE n_nationkey NOT IN (SELECT s_nationkey FROM supplier)"),
    "event_props": (event_props, "SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events"),
}
