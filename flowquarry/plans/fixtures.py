"""Views over the events in which every detector both fires and stays silent, for Spark and (CTE texts) for the oracle.

They are rules over event_id, so they grow with the table: scans and answered probes, floods of every class, beats with
jitter and noise, tunnels and plain names, generated and spelled-out domains, records of several types.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .adapters import table


def _events(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "events").select(F.col("event_id").alias("i"))


def _select(spark: SparkSession, sf: str, *columns: str, where: str = "true") -> DataFrame:
    return _events(spark, sf).where(where).selectExpr(*columns)


def probes(spark: SparkSession, sf: str) -> DataFrame:
    """Blocks of 100 events by one source: scans over hosts, over ports, over both, and answered traffic with replies."""
    out = _select(
        spark, sf, "i * 2 AS flow_id", "i * 40000 AS ts_us", "concat('10.0.0.', i div 100 % 11) AS src_ip",
        "CASE i div 100 % 4 WHEN 0 THEN concat('45.60.', i div 250 % 250, '.', i % 90) WHEN 1 THEN '45.61.0.9' WHEN 2 THEN concat('45.62.0.', i % 33) ELSE concat('45.63.0.', i % 3) END AS dst_ip",
        "CAST(20000 + i % 30000 AS INT) AS src_port", "CAST(CASE i div 100 % 4 WHEN 0 THEN 445 WHEN 1 THEN i % 97 + 1 WHEN 2 THEN i % 61 + 1 ELSE 443 END AS INT) AS dst_port",
        "CASE WHEN i % 13 = 0 THEN 17 ELSE 6 END AS proto", "CASE WHEN i % 13 = 0 THEN 0 WHEN i % 29 = 0 THEN 16 ELSE 2 END AS flags",
    )
    back = out.where("(flow_id div 2 div 100 % 4 = 3 AND flow_id div 2 % 5 > 0) OR flow_id div 2 % 23 = 0").selectExpr(
        "flow_id + 1 AS flow_id", "ts_us + 15000 AS ts_us", "dst_ip AS src_ip", "src_ip AS dst_ip", "dst_port AS src_port", "src_port AS dst_port", "proto", "CASE WHEN flow_id % 7 = 0 THEN 4 WHEN flow_id % 7 = 1 THEN 20 ELSE 18 END AS flags"
    )
    return out.unionByName(back)


def attack_windows(spark: SparkSession, sf: str) -> DataFrame:
    """Windows of eight victims: quiet for twenty, then a flood of each victim's kind for six, then a rise."""
    rows = _select(spark, sf, "i div 8 AS bucket", "concat('v', i % 8) AS dst_ip", "i % 8 AS v", "i div 8 % 30 AS phase", "CAST(800 + i * 37 % 300 AS DOUBLE) AS base")
    return rows.selectExpr(
        "bucket", "dst_ip", "CASE WHEN phase < 20 THEN base WHEN phase < 26 THEN base * 40 * (1 + v div 4) ELSE base * 1.5 END AS pps", "CASE WHEN phase BETWEEN 20 AND 25 AND v IN (0, 2, 4, 6) THEN 900 ELSE 3 END AS unique_src",
        "CAST(CASE WHEN phase BETWEEN 20 AND 25 AND v IN (0, 2, 4, 6) THEN 7 ELSE 1 END AS DOUBLE) AS src_entropy", "CASE WHEN phase BETWEEN 20 AND 25 AND v % 4 = 0 THEN base * 38 ELSE base * 0.05 END AS syn_rate",
        "CASE WHEN phase BETWEEN 20 AND 25 AND v % 4 = 1 THEN base * 39 ELSE base * 0.1 END AS udp_rate", "CAST(CASE WHEN v = 5 THEN 6 ELSE 1 END AS DOUBLE) AS class_ratio", "CAST(CASE WHEN v = 5 THEN 6 ELSE 0 END AS DOUBLE) AS in_out",
        "CAST(CASE WHEN v < 4 THEN 1 ELSE 0 END AS DOUBLE) AS burstiness", "CAST(CASE WHEN v < 4 THEN 0.2 ELSE 1 END AS DOUBLE) AS std_iat", "CAST(CASE WHEN phase BETWEEN 20 AND 25 THEN 2 ELSE base END AS DOUBLE) AS syn_ack",
    )


def beats(spark: SparkSession, sf: str) -> DataFrame:
    """Forty channels a minute: twenty with jitter, dropped beats and steady sizes (five of them to a popular host), the others noise."""
    return _select(
        spark, sf, "i AS flow_id", "(i div 40) * 60000000 + CASE WHEN i % 40 < 20 THEN (i * 7919 % 11) * 200000 ELSE (i * 7919 % 53) * 1000000 END AS ts_us",
        "CASE WHEN i % 40 < 30 THEN concat('10.0.0.', i % 40) ELSE concat('10.9.0.', i % 35) END AS src_ip", "CASE WHEN i % 40 BETWEEN 15 AND 19 OR i % 40 >= 30 THEN '203.0.113.9' ELSE concat('45.60.1.', i % 40) END AS dst_ip",
        "CAST(443 AS INT) AS dst_port", "CAST(6 AS INT) AS proto", "CAST(CASE WHEN i % 40 < 20 THEN 500 + i * 31 % 7 + (i % 40) * (i * 17 % 40) ELSE i * 37 % 5000 END AS BIGINT) AS bytes_out", where="i * 13 % 17 <> 0",
    )


def tunnel_queries(spark: SparkSession, sf: str) -> DataFrame:
    """Hosts that query long changing labels, short ones, a repeated one, and a name with many sources."""
    return _select(
        spark, sf, "i AS query_id", "(i div 12) * 700000 + i % 12 AS ts_us", "CASE WHEN i % 12 >= 10 THEN concat('10.2.0.', i div 12 % 40 div 2) ELSE concat('10.1.0.', i % 12) END AS src_ip",
        "CASE WHEN i % 12 < 4 THEN concat(md5(CAST(i AS STRING)), substring(md5(CAST(i + 7 AS STRING)), 1, 4 * (i % 12)), '.t.evil', i % 12, '.co.uk') WHEN i % 12 < 8 THEN concat('www.shop', i % 9, '.com') "
        "WHEN i % 12 < 10 THEN 'samelabelagain.Host.example.org.' WHEN i % 12 = 10 THEN concat(md5(CAST(i AS STRING)), '.cdn.net') ELSE 'mail.cdn.net' END AS domain",
        "CASE WHEN i % 12 IN (0, 2, 10) THEN 16 ELSE 1 END AS qtype", "i % 19 = 0 AS is_response",
    )


def dga_queries(spark: SparkSession, sf: str) -> DataFrame:
    """Queries of twenty hosts for generated names, names made of words, and names that are skipped."""
    return _select(
        spark, sf, "i AS query_id", "(i div 20) * 4000000 + i % 20 AS ts_us", "concat('10.3.0.', i % 20) AS src_ip",
        "CASE WHEN i % 20 < 5 THEN concat(translate(substring(md5(CAST(i div 45 AS STRING)), 1, 9 + i % 6), 'aeiou0123456789', 'bcdfgqwrtzxvkpm'), '.net') WHEN i % 20 < 8 THEN concat('blueGreen', CASE i % 3 WHEN 0 THEN 'lemon' WHEN 1 THEN 'orange' ELSE 'salmon' END, '.com') "
        "WHEN i % 20 < 10 THEN concat(substring(md5(CAST(i AS STRING)), 1, 12), '.co.uk') WHEN i % 20 = 10 THEN 'a.google.com' WHEN i % 20 = 11 THEN 'printer.local' WHEN i % 20 = 12 THEN 'x_y.example.com' WHEN i % 20 = 13 THEN 'xn--abcdefgh.com' ELSE 'short.com' END AS domain",
    )


def records(spark: SparkSession, sf: str) -> DataFrame:
    """Records of four types with the fields that threat intelligence looks at."""
    return _select(
        spark, sf, "i AS record_id", "i * 3000000 AS ts_us", "CASE i % 4 WHEN 0 THEN 'dns' WHEN 1 THEN 'tls_hello' WHEN 2 THEN 'flow' ELSE 'window' END AS record_type", "concat('10.0.0.', i % 30) AS src_ip",
        "CASE WHEN i % 3 = 0 THEN '192.168.1.1' ELSE concat('45.60.7.', i % 40) END AS dst_ip", "CASE WHEN i % 4 = 0 THEN concat('a.b', i % 6, '.name', i % 10, '.org') END AS domain",
        "CASE WHEN i % 4 IN (1, 2) THEN md5(CAST(i % 9 AS STRING)) END AS ja3", "CASE WHEN i % 4 = 1 THEN concat('t13d', i % 7) END AS ja4", "CASE WHEN i % 4 = 1 AND i % 5 > 0 THEN concat('www.name', i % 10, '.org') END AS sni",
    )


def record_iocs(spark: SparkSession) -> DataFrame:
    return spark.sql(IOC_ROWS)


IOC_ROWS = """SELECT kind, value, category, CAST(confidence AS DOUBLE) AS confidence FROM (
  SELECT 'ip' AS kind, concat('45.60.7.', id * 5) AS value, 'c2' AS category, 0.6 + id / 20 AS confidence FROM range(8) UNION ALL
  SELECT 'domain', concat('name', id * 3, '.org'), 'phishing', 0.7 FROM range(4) UNION ALL SELECT 'ja3', md5(CAST(id * 4 AS STRING)), 'malware', 0.85 FROM range(3) UNION ALL SELECT 'ja4', 't13d3', 'malware', 0.5)"""

_M = "md5(CAST({} AS VARCHAR))"
CTE = {
    "probes": """p0 AS (SELECT event_id AS i FROM events), p1 AS (SELECT i * 2 AS flow_id, i * 40000 AS ts_us, concat('10.0.0.', i // 100 % 11) AS src_ip,
  CASE i // 100 % 4 WHEN 0 THEN concat('45.60.', i // 250 % 250, '.', i % 90) WHEN 1 THEN '45.61.0.9' WHEN 2 THEN concat('45.62.0.', i % 33) ELSE concat('45.63.0.', i % 3) END AS dst_ip,
  20000 + i % 30000 AS src_port, CASE i // 100 % 4 WHEN 0 THEN 445 WHEN 1 THEN i % 97 + 1 WHEN 2 THEN i % 61 + 1 ELSE 443 END AS dst_port,
  CASE WHEN i % 13 = 0 THEN 17 ELSE 6 END AS proto, CASE WHEN i % 13 = 0 THEN 0 WHEN i % 29 = 0 THEN 16 ELSE 2 END AS flags FROM p0),
probes AS (SELECT * FROM p1 UNION ALL SELECT flow_id + 1, ts_us + 15000, dst_ip, src_ip, dst_port, src_port, proto, CASE flow_id % 7 WHEN 0 THEN 4 WHEN 1 THEN 20 ELSE 18 END FROM p1
  WHERE (flow_id // 2 // 100 % 4 = 3 AND flow_id // 2 % 5 > 0) OR flow_id // 2 % 23 = 0)""",
    "attack_windows": """a0 AS (SELECT event_id // 8 AS bucket, concat('v', event_id % 8) AS dst_ip, event_id % 8 AS v, event_id // 8 % 30 AS phase, CAST(800 + event_id * 37 % 300 AS DOUBLE) AS base FROM events),
attack_windows AS (SELECT bucket, dst_ip, CASE WHEN phase < 20 THEN base WHEN phase < 26 THEN base * 40 * (1 + v // 4) ELSE base * 1.5e0 END AS pps, CASE WHEN phase BETWEEN 20 AND 25 AND v IN (0, 2, 4, 6) THEN 900e0 ELSE 3e0 END AS unique_src,
  CASE WHEN phase BETWEEN 20 AND 25 AND v IN (0, 2, 4, 6) THEN 7e0 ELSE 1e0 END AS src_entropy, CASE WHEN phase BETWEEN 20 AND 25 AND v % 4 = 0 THEN base * 38 ELSE base * 0.05e0 END AS syn_rate,
  CASE WHEN phase BETWEEN 20 AND 25 AND v % 4 = 1 THEN base * 39 ELSE base * 0.1e0 END AS udp_rate, CASE WHEN v = 5 THEN 6e0 ELSE 1e0 END AS class_ratio, CASE WHEN v = 5 THEN 6e0 ELSE 0e0 END AS in_out,
  CASE WHEN v < 4 THEN 1e0 ELSE 0e0 END AS burstiness, CASE WHEN v < 4 THEN 0.2e0 ELSE 1e0 END AS std_iat, CASE WHEN phase BETWEEN 20 AND 25 THEN 2e0 ELSE base END AS syn_ack FROM a0)""",
    "beats": """beats AS (SELECT i AS flow_id, i // 40 * 60000000 + CASE WHEN i % 40 < 20 THEN (i * 7919 % 11) * 200000 ELSE (i * 7919 % 53) * 1000000 END AS ts_us,
  CASE WHEN i % 40 < 30 THEN concat('10.0.0.', i % 40) ELSE concat('10.9.0.', i % 35) END AS src_ip, CASE WHEN i % 40 BETWEEN 15 AND 19 OR i % 40 >= 30 THEN '203.0.113.9' ELSE concat('45.60.1.', i % 40) END AS dst_ip,
  443 AS dst_port, 6 AS proto, CASE WHEN i % 40 < 20 THEN 500 + i * 31 % 7 + (i % 40) * (i * 17 % 40) ELSE i * 37 % 5000 END AS bytes_out FROM (SELECT event_id AS i FROM events) WHERE i * 13 % 17 <> 0)""",
    "tunnel_queries": f"""tunnel_queries AS (SELECT i AS query_id, i // 12 * 700000 + i % 12 AS ts_us, CASE WHEN i % 12 >= 10 THEN concat('10.2.0.', i // 12 % 40 // 2) ELSE concat('10.1.0.', i % 12) END AS src_ip,
  CASE WHEN i % 12 < 4 THEN concat({_M.format('i')}, substr({_M.format('i + 7')}, 1, CAST(4 * (i % 12) AS INTEGER)), '.t.evil', i % 12, '.co.uk') WHEN i % 12 < 8 THEN concat('www.shop', i % 9, '.com')
  WHEN i % 12 < 10 THEN 'samelabelagain.Host.example.org.' WHEN i % 12 = 10 THEN concat({_M.format('i')}, '.cdn.net') ELSE 'mail.cdn.net' END AS domain,
  CASE WHEN i % 12 IN (0, 2, 10) THEN 16 ELSE 1 END AS qtype, i % 19 = 0 AS is_response FROM (SELECT event_id AS i FROM events))""",
    "dga_queries": f"""dga_queries AS (SELECT i AS query_id, i // 20 * 4000000 + i % 20 AS ts_us, concat('10.3.0.', i % 20) AS src_ip,
  CASE WHEN i % 20 < 5 THEN concat(translate(substr({_M.format('i // 45')}, 1, CAST(9 + i % 6 AS INTEGER)), 'aeiou0123456789', 'bcdfgqwrtzxvkpm'), '.net') WHEN i % 20 < 8 THEN concat('blueGreen', CASE i % 3 WHEN 0 THEN 'lemon' WHEN 1 THEN 'orange' ELSE 'salmon' END, '.com')
  WHEN i % 20 < 10 THEN concat(substr({_M.format('i')}, 1, 12), '.co.uk') WHEN i % 20 = 10 THEN 'a.google.com' WHEN i % 20 = 11 THEN 'printer.local' WHEN i % 20 = 12 THEN 'x_y.example.com' WHEN i % 20 = 13 THEN 'xn--abcdefgh.com' ELSE 'short.com' END AS domain
  FROM (SELECT event_id AS i FROM events))""",
    "records": f"""records AS (SELECT i AS record_id, i * 3000000 AS ts_us, CASE i % 4 WHEN 0 THEN 'dns' WHEN 1 THEN 'tls_hello' WHEN 2 THEN 'flow' ELSE 'window' END AS record_type, concat('10.0.0.', i % 30) AS src_ip,
  CASE WHEN i % 3 = 0 THEN '192.168.1.1' ELSE concat('45.60.7.', i % 40) END AS dst_ip, CASE WHEN i % 4 = 0 THEN concat('a.b', i % 6, '.name', i % 10, '.org') END AS domain,
  CASE WHEN i % 4 IN (1, 2) THEN {_M.format('i % 9')} END AS ja3, CASE WHEN i % 4 = 1 THEN concat('t13d', i % 7) END AS ja4, CASE WHEN i % 4 = 1 AND i % 5 > 0 THEN concat('www.name', i % 10, '.org') END AS sni FROM (SELECT event_id AS i FROM events)),
record_iocs AS (SELECT 'ip' AS kind, concat('45.60.7.', id * 5) AS value, 'c2' AS category, 0.6e0 + id / 20e0 AS confidence FROM range(8) t(id) UNION ALL SELECT 'domain', concat('name', id * 3, '.org'), 'phishing', 0.7e0 FROM range(4) t(id)
  UNION ALL SELECT 'ja3', {_M.format('id * 4')}, 'malware', 0.85e0 FROM range(3) t(id) UNION ALL SELECT 'ja4', 't13d3', 'malware', 0.5e0)""",
}


def oracle(query: str, *views: str, recursive: bool = False) -> str:
    return ("WITH RECURSIVE " if recursive else "WITH ") + ",\n".join(CTE[v] for v in views) + "\n" + query.strip()
