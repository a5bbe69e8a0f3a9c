"""The relational surface on the star tables: joins, aggregates, windows, sets."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tiesmith.session import table

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events")

#: One text serves both engines: plain SQL over views.
SQL = {
    "pricing_summary": """SELECT l_returnflag, l_linestatus, CAST(sum(l_quantity) AS DOUBLE) AS sum_qty, round(sum(l_extendedprice), 2) AS sum_price, round(sum(l_extendedprice * (1 - l_discount)), 2) AS sum_disc,
      round(avg(l_quantity), 4) AS avg_qty, count(*) AS n FROM lineitem WHERE l_shipdate <= TIMESTAMP '1998-09-02 00:00:00' GROUP BY l_returnflag, l_linestatus""",
    "revenue_by_nation": """SELECT n_name, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue FROM customer JOIN orders ON c_custkey = o_custkey JOIN lineitem ON l_orderkey = o_orderkey
      JOIN supplier ON l_suppkey = s_suppkey AND c_nationkey = s_nationkey JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY n_name""",
    "order_priority": """SELECT o_orderpriority, count(*) AS n FROM orders WHERE EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey AND l_quantity > 25) GROUP BY o_orderpriority""",
    "customers_without_urgent_orders": "SELECT c_custkey, c_name FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderpriority = '1-URGENT')",
    "brand_rollup": "SELECT coalesce(p_brand, 'all') AS brand, coalesce(p_type, 'all') AS type, count(*) AS n, round(avg(p_retailprice), 4) AS price FROM part GROUP BY ROLLUP (p_brand, p_type)",
    "running_value": """SELECT event_id, user_id, round(sum(value) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), 4) AS running,
      row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS nth FROM events""",
    "sessions": """SELECT user_id, session, count(*) AS events, min(ts) AS began, max(ts) AS ended FROM (SELECT *, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS session FROM
      (SELECT *, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) <= INTERVAL '30' MINUTE THEN 0 ELSE 1 END AS fresh FROM events) a) b GROUP BY user_id, session""",
    "suppliers_and_customers": "SELECT s_nationkey AS nationkey FROM supplier INTERSECT SELECT c_nationkey FROM customer",
    "parts_never_in_bulk": "SELECT p_partkey FROM part EXCEPT SELECT l_partkey FROM lineitem WHERE l_quantity > 49",
    "top_parts": """SELECT l_partkey, n, r FROM (SELECT l_partkey, count(*) AS n, rank() OVER (ORDER BY count(*) DESC, l_partkey) AS r FROM lineitem GROUP BY l_partkey) t WHERE r <= 20""",
    "small_orders": """SELECT l_partkey, round(sum(l_extendedprice) / 7.0, 2) AS yearly FROM lineitem JOIN (SELECT l_partkey AS k, 0.5 * avg(l_quantity) AS q FROM lineitem GROUP BY l_partkey) a ON k = l_partkey WHERE l_quantity < q GROUP BY l_partkey""",
    "event_hours": "SELECT date_trunc('hour', ts) AS hour, event_type, count(*) AS n, round(avg(value), 4) AS mean FROM events GROUP BY date_trunc('hour', ts), event_type",
}


def _run(sql: str) -> Callable[[SparkSession, str], DataFrame]:
    def run(spark: SparkSession, d: str) -> DataFrame:
        for name in TABLES:
            if name in sql:
                table(spark, d, name).createOrReplaceTempView(name)
        return spark.sql(sql)

    return run


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: _run(sql) for name, sql in SQL.items()}


def oracle_sql() -> dict[str, str]:
    return dict(SQL)
