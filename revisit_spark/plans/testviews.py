"""The star-schema test tables seen as job history, in Spark and, for comparison, in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def jobs(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders, lines = table(spark, sf_dir, "orders"), table(spark, sf_dir, "lineitem")
    customers = table(spark, sf_dir, "customer").join(table(spark, sf_dir, "nation"), F.col("c_nationkey") == F.col("n_nationkey")).select("c_custkey", "n_regionkey")
    used = lines.groupBy("l_orderkey").agg(F.min("l_partkey").alias("equipment_id"), F.min("l_suppkey").alias("technician_id"))
    key, day = F.col("o_orderkey"), F.to_date("o_orderdate")
    rows = orders.join(customers, F.col("o_custkey") == F.col("c_custkey")).join(used, key == F.col("l_orderkey"), "left")
    return rows.select(
        F.col("n_regionkey").alias("organization_id"),
        key.alias("id"),
        F.col("o_custkey").alias("customer_id"),
        F.when(key % 3 != 0, F.col("o_custkey") * 10 + key % 2).alias("location_id"),
        "equipment_id",
        "technician_id",
        F.col("o_orderpriority").alias("category_id"),
        day.alias("service_date"),
        F.when(key % 4 != 0, F.timestamp_seconds(F.unix_date(day).cast("long") * 86400 + key % 24 * 3600)).alias("started_at"),
        F.when(F.col("o_orderstatus") == "F", "completed").when(F.col("o_orderstatus") == "O", "unknown").otherwise("cancelled").alias("status"),
        F.when(key % 7 == 0, None).when(key % 5 == 0, 0).otherwise(F.col("o_totalprice")).cast("decimal(14,2)").alias("revenue"),
        (F.col("o_orderpriority") == "1-URGENT").alias("is_warranty"),
        F.lower("o_orderpriority").alias("raw_category"),
        F.when(key % 50 == 0, "Planned multi-visit project").when(key % 11 == 0, None).otherwise("Service").alias("raw_job_type"),
    )


def equipment(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("p_partkey")
    until = F.date_add(F.lit("1995-01-01").cast("date"), (key % 2400).cast("int"))
    return table(spark, sf_dir, "part").select(key.alias("id"), F.concat(F.lit("SN-"), key.cast("string")).alias("serial_number"), F.when(F.col("p_size") % 10 != 0, until).alias("warranty_expires_on"))


def line_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind = F.when(F.col("l_returnflag") == "R", "part").otherwise("labor")
    return table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("job_id"), kind.alias("kind"), F.col("l_partkey").cast("string").alias("code"), F.col("l_extendedprice").cast("decimal(14,2)").alias("amount"))


JOBS_SQL = """WITH jobs AS (
  SELECT n_regionkey AS organization_id, o_orderkey AS id, o_custkey AS customer_id,
    CASE WHEN o_orderkey % 3 <> 0 THEN o_custkey * 10 + o_orderkey % 2 END AS location_id, equipment_id, technician_id, o_orderpriority AS category_id,
    CAST(o_orderdate AS DATE) AS service_date,
    CASE WHEN o_orderkey % 4 <> 0 THEN CAST(CAST(o_orderdate AS DATE) AS TIMESTAMP) + to_hours(o_orderkey % 24) END AS started_at,
    CASE o_orderstatus WHEN 'F' THEN 'completed' WHEN 'O' THEN 'unknown' ELSE 'cancelled' END AS status,
    CASE WHEN o_orderkey % 7 = 0 THEN NULL WHEN o_orderkey % 5 = 0 THEN 0 ELSE o_totalprice END::DECIMAL(14,2) AS revenue,
    o_orderpriority = '1-URGENT' AS is_warranty, lower(o_orderpriority) AS raw_category,
    CASE WHEN o_orderkey % 50 = 0 THEN 'Planned multi-visit project' WHEN o_orderkey % 11 = 0 THEN NULL ELSE 'Service' END AS raw_job_type
  FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey
    LEFT JOIN (SELECT l_orderkey, min(l_partkey) AS equipment_id, min(l_suppkey) AS technician_id FROM lineitem GROUP BY l_orderkey) ON l_orderkey = o_orderkey
)"""


def pairs_sql(window: int = 30, cap: int = 25) -> str:
    return f"""{JOBS_SQL}, visits AS (
  SELECT *, coalesce(started_at, service_date::TIMESTAMP) AS order_ts FROM jobs WHERE status IN ('completed', 'unknown')
), pairs AS (
  SELECT p.organization_id, p.id AS prior_id, f.id AS followup_id, coalesce(f.customer_id, p.customer_id) AS customer_id,
    coalesce(f.location_id, p.location_id) AS location_id, coalesce(f.equipment_id, p.equipment_id) AS equipment_id,
    p.technician_id AS prior_technician_id, f.technician_id AS followup_technician_id, (f.service_date - p.service_date)::INTEGER AS days_between
  FROM visits p JOIN visits f ON p.organization_id = f.organization_id
    AND (p.customer_id = f.customer_id OR p.equipment_id = f.equipment_id OR p.location_id = f.location_id)
    AND f.service_date BETWEEN p.service_date AND p.service_date + {window}
    AND (f.service_date, f.order_ts, f.id) > (p.service_date, p.order_ts, p.id)
  QUALIFY row_number() OVER (PARTITION BY p.organization_id, p.id ORDER BY f.service_date, f.order_ts, f.id) <= {cap}
)"""
