"""Engine extras: relational queries over the star schema, beyond the file and stream operators."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from lumenflow.registry import query
from lumenflow.session import table


def _t(spark, sf_dir, *names):
    return [table(spark, sf_dir, n) for n in names]


def _money(c):
    return F.sum(c.cast("decimal(18,4)")).cast("double")


_REV = "sum((l_extendedprice * (1 - l_discount))::DECIMAL(18,4))::DOUBLE"


@query(f"SELECT l_returnflag, l_linestatus, sum(l_quantity::DECIMAL(18,4))::DOUBLE AS sum_qty, {_REV} AS revenue, avg(l_discount) AS avg_disc, count(*) AS n FROM lineitem WHERE l_shipdate <= TIMESTAMP '1998-09-02' GROUP BY ALL")
def pricing_summary(spark, sf_dir):
    (li,) = _t(spark, sf_dir, "lineitem")
    rev = F.col("l_extendedprice") * (1 - F.col("l_discount"))
    kept = li.where(F.col("l_shipdate") <= F.lit("1998-09-02").cast("timestamp_ntz"))
    return kept.groupBy("l_returnflag", "l_linestatus").agg(_money(F.col("l_quantity")).alias("sum_qty"), _money(rev).alias("revenue"), F.avg("l_discount").alias("avg_disc"), F.count(F.lit(1)).alias("n"))


@query(f"SELECT n_name, {_REV} AS revenue FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey GROUP BY n_name")
def revenue_by_nation(spark, sf_dir):
    li, o, c, n = _t(spark, sf_dir, "lineitem", "orders", "customer", "nation")
    rev = _money(F.col("l_extendedprice") * (1 - F.col("l_discount"))).alias("revenue")
    # Summed by order's customer before the dimension joins, so that few rows reach them.
    per = li.join(o.select("o_orderkey", "o_custkey"), F.col("l_orderkey") == F.col("o_orderkey")).join(c.select("c_custkey", "c_nationkey"), F.col("o_custkey") == F.col("c_custkey"))
    return per.join(n.select("n_nationkey", "n_name"), F.col("c_nationkey") == F.col("n_nationkey")).groupBy("n_name").agg(rev)


@query("SELECT r_name, n_name, grouping(n_name)::BIGINT AS level, count(*) AS customers FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY GROUPING SETS ((r_name, n_name), (r_name), ())")
def grouping_sets(spark, sf_dir):
    c, n, r = _t(spark, sf_dir, "customer", "nation", "region")
    j = c.join(n, F.col("c_nationkey") == F.col("n_nationkey")).join(r, F.col("n_regionkey") == F.col("r_regionkey"))
    return j.groupingSets([["r_name", "n_name"], ["r_name"], []], "r_name", "n_name").agg(F.grouping("n_name").cast("long").alias("level"), F.count(F.lit(1)).alias("customers"))


@query("SELECT o_orderstatus, o_orderpriority, count(*) AS n FROM orders GROUP BY CUBE (o_orderstatus, o_orderpriority)")
def cube(spark, sf_dir):
    return table(spark, sf_dir, "orders").cube("o_orderstatus", "o_orderpriority").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT c_custkey FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders WHERE o_totalprice > 300000)")
def semi_join(spark, sf_dir):
    c, o = _t(spark, sf_dir, "customer", "orders")
    return c.join(o.where("o_totalprice > 300000"), F.col("c_custkey") == F.col("o_custkey"), "left_semi").select("c_custkey")


@query("SELECT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_totalprice > 300000)")
def anti_join(spark, sf_dir):
    c, o = _t(spark, sf_dir, "customer", "orders")
    return c.join(o.where("o_totalprice > 300000"), F.col("c_custkey") == F.col("o_custkey"), "left_anti").select("c_custkey")


@query("(SELECT c_nationkey AS k FROM customer INTERSECT SELECT s_nationkey FROM supplier)")
def intersect(spark, sf_dir):
    c, s = _t(spark, sf_dir, "customer", "supplier")
    return c.select(F.col("c_nationkey").alias("k")).intersect(s.select("s_nationkey"))


@query("SELECT p_partkey AS k FROM part EXCEPT SELECT l_partkey FROM lineitem WHERE l_quantity > 45")
def except_(spark, sf_dir):
    p, li = _t(spark, sf_dir, "part", "lineitem")
    return p.select(F.col("p_partkey").alias("k")).subtract(li.where("l_quantity > 45").select("l_partkey"))


@query("SELECT o_custkey, o_orderkey, rank() OVER w AS rank, ntile(4) OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS quarter, round(avg(o_totalprice) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey ROWS BETWEEN 2 PRECEDING AND CURRENT ROW), 4) AS moving FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_totalprice DESC)")
def ranking_windows(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    by = Window.partitionBy("o_custkey")
    price = by.orderBy(F.desc("o_totalprice"), "o_orderkey")
    moving = F.avg("o_totalprice").over(by.orderBy("o_orderdate", "o_orderkey").rowsBetween(-2, 0))
    return o.select("o_custkey", "o_orderkey", F.rank().over(by.orderBy(F.desc("o_totalprice"))).cast("long").alias("rank"), F.ntile(4).over(price).cast("long").alias("quarter"), F.round(moving, 4).alias("moving"))


@query("SELECT a.l_shipmonth, a.n, b.n AS before FROM (SELECT date_trunc('month', l_shipdate) AS l_shipmonth, count(*) AS n FROM lineitem GROUP BY 1) a LEFT JOIN (SELECT date_trunc('month', l_shipdate) AS l_shipmonth, count(*) AS n FROM lineitem GROUP BY 1) b ON b.l_shipmonth = a.l_shipmonth - INTERVAL 1 MONTH")
def month_over_month(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem")
    m = li.groupBy(F.date_trunc("month", "l_shipdate").cast("timestamp_ntz").alias("l_shipmonth")).agg(F.count(F.lit(1)).alias("n"))
    before = m.select((F.col("l_shipmonth") + F.expr("interval 1 month")).alias("l_shipmonth"), F.col("n").alias("before"))
    return m.join(before, "l_shipmonth", "left")


@query("SELECT l_returnflag, count(DISTINCT l_suppkey) AS suppliers, sum(CASE WHEN l_linestatus = 'O' THEN 1 ELSE 0 END)::BIGINT AS open_lines, sum(CASE WHEN l_linestatus = 'F' THEN 1 ELSE 0 END)::BIGINT AS closed_lines FROM lineitem GROUP BY l_returnflag")
def distinct_and_pivot(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem")
    lines = lambda s: F.count_if(F.col("l_linestatus") == s)
    return li.groupBy("l_returnflag").agg(F.count_distinct("l_suppkey").alias("suppliers"), lines("O").alias("open_lines"), lines("F").alias("closed_lines"))
