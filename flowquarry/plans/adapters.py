"""Network-record views over the driver's tables, for Spark (DataFrames) and for the oracle (CTE texts)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

EPOCH = "timestampdiff(MICROSECOND, timestamp_ntz'1970-01-01 00:00:00', {})"


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def flows(spark: SparkSession, sf: str) -> DataFrame:
    """events as unidirectional flow records."""
    e = table(spark, sf, "events").withColumn("k", F.regexp_extract("props", "([0-9]+)", 1).cast("long"))
    port = F.when(F.col("event_type") == "click", 443).when(F.col("event_type") == "view", 80).when(F.col("event_type") == "error", 445).when(F.col("event_type") == "purchase", 8443).otherwise(53)
    return e.select(
        F.col("event_id").alias("flow_id"),
        F.expr(EPOCH.format("ts")).alias("ts_us"),
        F.format_string("10.0.%d.%d", F.expr("user_id div 250"), F.col("user_id") % 250 + 1).alias("src_ip"),
        F.when(F.col("k") % 4 == 0, F.format_string("192.168.1.%d", F.col("k") + 1)).otherwise(F.format_string("45.60.7.%d", F.col("k") + 1)).alias("dst_ip"),
        port.cast("int").alias("dst_port"),
        (F.col("event_id") % 20000 + 1024).cast("int").alias("src_port"),
        F.when(port == 53, 17).otherwise(6).alias("proto"),
        (F.floor(F.col("value") * 100) * F.when(F.col("event_id") % 53 == 0, 60).otherwise(1)).cast("long").alias("bytes_out"),
        F.when(F.col("event_type") == "error", 0).otherwise((F.col("k") + 1) * 10).cast("long").alias("bytes_in"),
        (F.col("k") % 7 + 1).alias("pkts"),
        F.when(F.col("event_type") == "error", 2).otherwise(18).alias("flags"),
        (F.col("event_id") % 40 * 500000).alias("duration_us"),
    )


def packets(spark: SparkSession, sf: str) -> DataFrame:
    """lineitem as packets in day-grained time."""
    li = table(spark, sf, "lineitem")
    day = F.expr(EPOCH.format("l_shipdate"))
    return li.select(
        day.alias("ts_us"),
        F.col("l_suppkey").cast("string").alias("dst_ip"),
        (F.col("l_partkey") % 64).cast("string").alias("src_ip"),
        F.col("l_quantity").cast("int").alias("dst_port"),
        F.when(F.col("l_linenumber") == 3, 17).when(F.col("l_linenumber") == 5, 1).otherwise(6).alias("proto"),
        F.floor("l_extendedprice").cast("long").alias("bytes"),
        F.when(F.col("l_returnflag") == "A", 2).when(F.col("l_returnflag") == "R", 18).otherwise(16).alias("flags"),
    )


def dns(spark: SparkSession, sf: str) -> DataFrame:
    """The hosts of pages as DNS queries."""
    host = F.lower(F.regexp_extract("url", "^https?://([^/:?#]+)", 1))
    return table(spark, sf, "pages").select(
        F.col("page_id").alias("query_id"),
        (F.col("page_id") * 1000000).alias("ts_us"),
        F.concat(F.lit("10.1.0."), (F.col("page_id") % 20).cast("string")).alias("src_ip"),
        host.alias("domain"),
        F.when(F.col("page_id") % 3 == 0, 16).when(F.col("page_id") % 3 == 1, 1).otherwise(28).alias("qtype"),
    )


def conversations(spark: SparkSession, sf: str) -> DataFrame:
    """Turns as the payload packets of bidirectional flows; the user's are outbound."""
    return table(spark, sf, "conversations").select(F.col("conv_id").alias("flow_id"), "turn", (F.col("role") == "user").alias("forward"), F.length("text").cast("long").alias("length"), (F.col("turn") * 1000000 + F.length("text") * 1000).cast("long").alias("ts_us"))


def channels(spark: SparkSession, sf: str) -> DataFrame:
    """orders as connection starts of channels."""
    return table(spark, sf, "orders").select((F.col("o_custkey") % 200).alias("channel"), F.col("o_orderkey").alias("flow_id"), F.expr(EPOCH.format("o_orderdate")).alias("ts_us"), F.floor("o_totalprice").cast("long").alias("size"))


def iocs(spark: SparkSession, sf: str) -> DataFrame:
    """Indicators by a rule: every seventh destination, every third registered domain."""
    ips = flows(spark, sf).select("dst_ip").distinct().select(F.lit("ip").alias("kind"), F.col("dst_ip").alias("value"))
    ips = ips.where(F.regexp_extract("value", r"(\d+)$", 1).cast("int") % 7 == 0)
    names = dns(spark, sf).select(F.regexp_extract("domain", r"([^.]+\.[^.]+\.[^.]+)$", 1).alias("value")).where("value <> ''").distinct().select(F.lit("domain").alias("kind"), "value").where(F.length("value") % 3 == 0)
    both = ips.unionByName(names)
    return both.select("kind", "value", F.when(F.length("value") % 2 == 0, "c2").otherwise("malware").alias("category"), ((F.length("value") % 5) / 10.0 + 0.5).cast("double").alias("confidence"))


#: The same views for the oracle.
CTE = {
    "flows": """flows AS (SELECT event_id AS flow_id, epoch_us(ts) AS ts_us,
  concat('10.0.', user_id // 250, '.', user_id % 250 + 1) AS src_ip,
  CASE WHEN k % 4 = 0 THEN concat('192.168.1.', k + 1) ELSE concat('45.60.7.', k + 1) END AS dst_ip,
  CASE event_type WHEN 'click' THEN 443 WHEN 'view' THEN 80 WHEN 'error' THEN 445 WHEN 'purchase' THEN 8443 ELSE 53 END AS dst_port,
  CAST(event_id % 20000 + 1024 AS INTEGER) AS src_port,
  CASE WHEN event_type IN ('click','view','error','purchase') THEN 6 ELSE 17 END AS proto,
  CAST(floor(value * 100) AS BIGINT) * CASE WHEN event_id % 53 = 0 THEN 60 ELSE 1 END AS bytes_out,
  CASE WHEN event_type = 'error' THEN 0 ELSE (k + 1) * 10 END AS bytes_in, k % 7 + 1 AS pkts,
  CASE WHEN event_type = 'error' THEN 2 ELSE 18 END AS flags, event_id % 40 * 500000 AS duration_us
  FROM (SELECT *, CAST(regexp_extract(props, '([0-9]+)', 1) AS BIGINT) AS k FROM events))""",
    "packets": """packets AS (SELECT epoch_us(l_shipdate) AS ts_us, CAST(l_suppkey AS VARCHAR) AS dst_ip, CAST(l_partkey % 64 AS VARCHAR) AS src_ip,
  CAST(l_quantity AS INTEGER) AS dst_port, CASE l_linenumber WHEN 3 THEN 17 WHEN 5 THEN 1 ELSE 6 END AS proto,
  CAST(floor(l_extendedprice) AS BIGINT) AS bytes, CASE l_returnflag WHEN 'A' THEN 2 WHEN 'R' THEN 18 ELSE 16 END AS flags FROM lineitem)""",
    "dns": """dns AS (SELECT page_id AS query_id, page_id * 1000000 AS ts_us, concat('10.1.0.', page_id % 20) AS src_ip,
  lower(regexp_extract(url, '^https?://([^/:?#]+)', 1)) AS domain, CASE page_id % 3 WHEN 0 THEN 16 WHEN 1 THEN 1 ELSE 28 END AS qtype FROM pages)""",
    "conv": """conv AS (SELECT conv_id AS flow_id, turn, role = 'user' AS forward, CAST(length(text) AS BIGINT) AS length, turn * 1000000 + length(text) * 1000 AS ts_us FROM conversations)""",
    "channels": """channels AS (SELECT o_custkey % 200 AS channel, o_orderkey AS flow_id, epoch_us(o_orderdate) AS ts_us, CAST(floor(o_totalprice) AS BIGINT) AS size FROM orders)""",
    "iocs": """iocs AS (SELECT kind, value, CASE WHEN length(value) % 2 = 0 THEN 'c2' ELSE 'malware' END AS category, CAST((length(value) % 5) / 10.0e0 + 0.5e0 AS DOUBLE) AS confidence FROM (
  SELECT DISTINCT 'ip' AS kind, dst_ip AS value FROM flows WHERE CAST(regexp_extract(dst_ip, '([0-9]+)$', 1) AS INTEGER) % 7 = 0
  UNION ALL SELECT DISTINCT 'domain', regexp_extract(domain, '([^.]+\\.[^.]+\\.[^.]+)$', 1) AS value FROM dns WHERE regexp_matches(domain, '[^.]+\\.[^.]+\\.[^.]+$') AND length(regexp_extract(domain, '([^.]+\\.[^.]+\\.[^.]+)$', 1)) % 3 = 0))""",
}


def oracle(query: str, *views: str) -> str:
    return "WITH " + ",\n".join(CTE[v] for v in views) + "\n" + query.strip()
