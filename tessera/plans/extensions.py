"""Relational queries over the star tables, for users who want more than lookups: engine extensions, all built-in operators.

Each is one declarative plan; the optimiser picks the joins. Money is summed as whole cents, so sums don't depend on order.
"""

from __future__ import annotations

from pyspark.sql import Window, functions as F

from .queries import query, table

_CENTS = "round({} * 100)::BIGINT"


def _cents(c):
    return F.round(F.col(c) * 100).cast("long")


@query(f"SELECT n_name, count(DISTINCT c_custkey) AS customers, count(o_orderkey) AS orders, coalesce(sum({_CENTS.format('o_totalprice')}), 0)::BIGINT AS cents FROM nation LEFT JOIN customer ON c_nationkey = n_nationkey LEFT JOIN orders ON o_custkey = c_custkey GROUP BY n_name")
def ext_left_joins(spark, d):
    n, c, o = (table(spark, d, t) for t in ("nation", "customer", "orders"))
    # Orders are summed by customer before the join: the shuffle carries one row a customer.
    per = o.groupBy("o_custkey").agg(F.count("*").alias("k"), F.sum(_cents("o_totalprice")).alias("s"))
    j = c.join(per, c["c_custkey"] == per["o_custkey"], "left").groupBy("c_nationkey").agg(F.count("*").alias("customers"), F.sum("k").alias("orders"), F.sum("s").alias("cents"))
    j = n.join(j, n["n_nationkey"] == j["c_nationkey"], "left")
    return j.select("n_name", *[F.coalesce(x, F.lit(0)).alias(x) for x in ("customers", "orders", "cents")])


@query("SELECT p_partkey, p_name FROM part WHERE p_partkey NOT IN (SELECT l_partkey FROM lineitem WHERE l_quantity > 45)")
def ext_anti_join(spark, d):
    big = table(spark, d, "lineitem").where("l_quantity > 45").select(F.col("l_partkey").alias("p_partkey"))
    return table(spark, d, "part").join(big, "p_partkey", "left_anti").select("p_partkey", "p_name")


@query(f"SELECT l_returnflag, l_linestatus, grouping(l_returnflag, l_linestatus) AS level, count(*) AS n, sum({_CENTS.format('l_extendedprice')})::BIGINT AS cents FROM lineitem GROUP BY CUBE (l_returnflag, l_linestatus)")
def ext_cube(spark, d):
    return table(spark, d, "lineitem").cube("l_returnflag", "l_linestatus").agg(F.grouping_id().alias("level"), F.count("*").alias("n"), F.sum(_cents("l_extendedprice")).alias("cents"))


@query("SELECT event_id, user_id, row_number() OVER w AS nth, coalesce(event_id - lag(event_id) OVER w, -1) AS gap, count(*) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN 4 PRECEDING AND CURRENT ROW) AS last_five FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)")
def ext_window_frames(spark, d):
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    e = table(spark, d, "events")
    return e.select("event_id", "user_id", F.row_number().over(w).alias("nth"), F.coalesce(F.col("event_id") - F.lag("event_id").over(w), F.lit(-1)).alias("gap"), F.count("*").over(w.rowsBetween(-4, 0)).alias("last_five"))


@query("SELECT epoch(time_bucket(INTERVAL 1 day, ts))::BIGINT AS day, event_type, count(*) AS n FROM events GROUP BY ALL")
def ext_tumbling(spark, d):
    # Times without a zone stay so: the result doesn't depend on the session's zone.
    g = table(spark, d, "events").groupBy(F.window("ts", "1 day").alias("w"), "event_type").agg(F.count("*").alias("n"))
    return g.select((F.unix_date(F.col("w.start").cast("date")).cast("long") * 86400).alias("day"), "event_type", "n")


@query("SELECT p.event_id, max_by(c.event_id, (c.ts, c.event_id)) AS last_click FROM events p LEFT JOIN events c ON c.user_id = p.user_id AND c.event_type = 'click' AND c.ts <= p.ts WHERE p.event_type = 'purchase' GROUP BY p.event_id")
def ext_as_of(spark, d):
    """Each purchase with the user's last click before it: one union and one running maximum, no range join."""
    e = table(spark, d, "events").where("event_type in ('click', 'purchase')")
    w = Window.partitionBy("user_id").orderBy("ts", F.col("event_type") == "purchase", "event_id").rowsBetween(Window.unboundedPreceding, 0)
    last = F.last(F.when(F.col("event_type") == "click", F.col("event_id")), ignorenulls=True).over(w)
    return e.select("event_id", "event_type", last.alias("last_click")).where("event_type = 'purchase'").drop("event_type")
