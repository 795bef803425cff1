"""Named queries over the adapter views, each with its oracle where SQL can express it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import scalars as S
from ..operators import flows as FL
from ..operators import history as H
from ..operators import joins as J
from ..operators import windows as W
from . import adapters as A
from .adapters import oracle
from .registry import query

HOUR, DAY = 3_600_000_000, 86_400_000_000


def _as_packets(f: DataFrame) -> DataFrame:
    return f.withColumn("bytes", F.col("bytes_out"))


def _dst_sql(us: int, least: int, view: str) -> str:
    return f"""
, i AS (SELECT ts_us // {us} AS bucket, dst_ip, src_ip, count(*) AS n, sum({'bytes_out' if view == 'flows' else 'bytes'}) AS b,
  count(*) FILTER (flags & 2 <> 0 AND flags & 16 = 0) AS syn, count(*) FILTER (proto = 17) AS udp, count(*) FILTER (proto IN (1, 58)) AS icmp FROM {view} GROUP BY ALL),
o AS (SELECT bucket, dst_ip, sum(n) AS p, sum(b) AS b, sum(syn) AS syn, sum(udp) AS udp, sum(icmp) AS icmp, count(*) AS u, max(n) AS top,
  greatest(log2(sum(n)) - sum(n * log2(n)) / sum(n), 0) AS h FROM i GROUP BY ALL HAVING sum(n) >= {least})
SELECT bucket, dst_ip, CAST(p AS BIGINT) AS pkts, CAST(b AS BIGINT) AS bytes, round(p / {us / 1e6}e0, 6) AS pps, round(b / {us / 1e6}e0, 6) AS bytes_per_sec,
  CAST(syn AS BIGINT) AS syn_pkts, CAST(udp AS BIGINT) AS udp_pkts, CAST(icmp AS BIGINT) AS icmp_pkts, u AS unique_src, round(h, 6) AS src_entropy,
  round(CASE WHEN u > 1 THEN h / log2(u) ELSE 0e0 END, 6) AS src_entropy_norm, round(top / p, 6) AS top_src_share FROM o"""


@query("AGG-01", "AGG-07", "FIL-03", "TOP-01", "STR-02", sql=oracle(_dst_sql(DAY, 5, "flows"), "flows"))
def win_dst_agg(spark: SparkSession, sf: str) -> DataFrame:
    return W.by_destination(_as_packets(A.flows(spark, sf)), DAY)


@query("AGG-01", sql=oracle(_dst_sql(30 * DAY, 5, "packets"), "packets"))
def win_dst_packets_30d(spark: SparkSession, sf: str) -> DataFrame:
    return W.by_destination(A.packets(spark, sf), 30 * DAY)


@query("FIL-03", sql=oracle(f", c AS (SELECT ts_us // {DAY} AS bucket, dst_ip, count(*) AS pkts FROM flows GROUP BY ALL) SELECT bucket, CAST(count(*) AS BIGINT) AS kept FROM c WHERE pkts >= 5 GROUP BY ALL", "flows"))
def window_min_volume(spark: SparkSession, sf: str) -> DataFrame:
    return W.by_destination(_as_packets(A.flows(spark, sf)), DAY).groupBy("bucket").agg(F.count("*").alias("kept"))


@query("AGG-02", sql=oracle(f"""
, p AS (SELECT ts_us // {DAY} AS bucket, src_ip, dst_port, count(*) AS n, sum(bytes_out) AS b FROM flows GROUP BY ALL),
e AS (SELECT bucket, src_ip, sum(n) AS p, sum(b) AS b, count(*) AS np, greatest(log2(sum(n)) - sum(n * log2(n)) / sum(n), 0) AS h FROM p GROUP BY ALL HAVING sum(n) >= 5),
t AS (SELECT ts_us // {DAY} AS bucket, src_ip, count(DISTINCT dst_ip) AS nd, least(count(DISTINCT (dst_ip, dst_port)), 20000) AS nt FROM flows GROUP BY ALL)
SELECT bucket, src_ip, CAST(p AS BIGINT) AS pkts, CAST(b AS BIGINT) AS bytes, round(p / 86400e0, 6) AS pps, nd AS unique_dst_ip, np AS unique_dst_port, CAST(nt AS BIGINT) AS unique_targets,
round(h, 6) AS dport_entropy, round(nd / p, 6) AS fanout_ratio_ip, round(np / p, 6) AS fanout_ratio_port, round(nt / nd, 6) AS ports_per_dst FROM e JOIN t USING (bucket, src_ip)""", "flows"))
def win_src_agg(spark: SparkSession, sf: str) -> DataFrame:
    return W.by_source(_as_packets(A.flows(spark, sf)), DAY)


@query("AGG-02", sql=oracle("""SELECT ts_us // 60000000 AS bucket, src_ip, count(*) AS dns_queries, count(*) FILTER (qtype IN (16, 10)) AS dns_txt_null, least(count(DISTINCT domain), 2000) AS dns_unique_names FROM dns GROUP BY ALL""", "dns"))
def win_dns_velocity(spark: SparkSession, sf: str) -> DataFrame:
    return W.dns_velocity(A.dns(spark, sf), 60_000_000)


@query("AGG-17", "STR-16", sql=oracle(f"""SELECT ts_us // {HOUR} AS bucket, count(*) AS flows, CAST(sum(bytes_out + bytes_in) AS BIGINT) AS bytes, round(sum(bytes_out + bytes_in) * 8 / 3600e0 / 1e9, 12) AS gbps,
round(count(*) / 3600e0, 9) AS flows_per_sec, round(quantile_cont(CAST(bytes_out + bytes_in AS DOUBLE), 0.95), 6) AS p95_bytes FROM flows GROUP BY ALL""", "flows"))
def telemetry_rollup(spark: SparkSession, sf: str) -> DataFrame:
    return W.telemetry(A.flows(spark, sf), HOUR)


@query("JOIN-05", "WIN-11", sql=oracle(f"""
, k AS (SELECT *, dense_rank() OVER (ORDER BY ts_us // {HOUR}) AS ord FROM flows),
s AS (SELECT ord + 1 AS ord, dst_ip, count(*) AS f, count(DISTINCT src_ip) AS u FROM k GROUP BY ALL)
SELECT flow_id, coalesce(f, 0) AS dst_win_flows, coalesce(u, 0) AS dst_win_unique_src FROM k LEFT JOIN s USING (ord, dst_ip)""", "flows"))
def prev_window_context(spark: SparkSession, sf: str) -> DataFrame:
    return W.previous_context(A.flows(spark, sf), HOUR)


@query("AGG-03", "SF-12", sql=oracle("""
SELECT flow_id, count(*) FILTER (forward) AS pkts_out, count(*) FILTER (NOT forward) AS pkts_in, CAST(coalesce(sum(length) FILTER (forward), 0) AS BIGINT) AS bytes_out,
CAST(coalesce(sum(length) FILTER (NOT forward), 0) AS BIGINT) AS bytes_in, max(ts_us) - min(ts_us) AS duration_us, CAST(count(*) FILTER (NOT forward) = 0 AS INTEGER) AS half_duplex,
round(coalesce(sum(length) FILTER (forward), 0) / greatest(coalesce(sum(length) FILTER (NOT forward), 0), 1), 6) AS out_in_byte_ratio FROM conv GROUP BY ALL""", "conv"))
def flow_stats(spark: SparkSession, sf: str) -> DataFrame:
    return FL.flow_stats(A.conversations(spark, sf))


@query("AGG-04", "WIN-04", "STR-17", sql=oracle("""
, g AS (SELECT src_ip, greatest(ts_us - lag(ts_us) OVER (PARTITION BY src_ip ORDER BY ts_us, flow_id), 0) / 1e6 AS g FROM flows),
a AS (SELECT src_ip, count(*) AS n, avg(g) AS m, coalesce(var_samp(g), 0) AS v FROM g WHERE g IS NOT NULL GROUP BY ALL)
SELECT src_ip, n AS iat_n, round(m, 4) AS iat_mean, round(sqrt(v), 3) AS iat_std, round(CASE WHEN m > 0 THEN sqrt(v) / m ELSE 0e0 END, 6) AS iat_cv FROM a""", "flows"))
def flow_iat_moments(spark: SparkSession, sf: str) -> DataFrame:
    return FL.iat_moments(A.flows(spark, sf), "src_ip")


@query("AGG-05", "AGG-06", sql=oracle("""
, r AS (SELECT *, row_number() OVER (PARTITION BY flow_id ORDER BY turn) AS rn FROM conv WHERE length > 0)
SELECT flow_id, string_agg(CAST(CASE WHEN forward THEN length ELSE -length END AS VARCHAR), ',' ORDER BY rn) AS splt_len FROM r WHERE rn <= 20 GROUP BY ALL""", "conv"))
def flow_splt(spark: SparkSession, sf: str) -> DataFrame:
    return FL.splt(A.conversations(spark, sf))


@query("STR-05", sql=oracle("""
, r AS (SELECT *, row_number() OVER (PARTITION BY flow_id ORDER BY turn) AS rn, sum(length) OVER (PARTITION BY flow_id ORDER BY turn ROWS UNBOUNDED PRECEDING) AS s FROM conv WHERE length > 0)
SELECT flow_id, turn, CAST(s AS BIGINT) AS payload_seen FROM r WHERE rn = 3""", "conv"))
def flow_early(spark: SparkSession, sf: str) -> DataFrame:
    return FL.early(A.conversations(spark, sf), n=3)


@query("STR-04", sql=oracle(f"""
, n AS (SELECT src_ip, ts_us, flow_id, CASE WHEN coalesce(ts_us - lag(ts_us) OVER w, {6 * HOUR} + 1) > {6 * HOUR} THEN 1 ELSE 0 END AS new FROM flows WINDOW w AS (PARTITION BY src_ip ORDER BY ts_us, flow_id)),
s AS (SELECT *, sum(new) OVER (PARTITION BY src_ip ORDER BY ts_us, flow_id ROWS UNBOUNDED PRECEDING) AS session FROM n)
SELECT src_ip, CAST(session AS BIGINT) AS session, min(ts_us) AS start_us, max(ts_us) AS end_us, count(*) AS records FROM s GROUP BY ALL""", "flows"))
def flow_sessions_idle(spark: SparkSession, sf: str) -> DataFrame:
    return FL.idle_sessions(A.flows(spark, sf), "src_ip", 6 * HOUR)


@query("STR-04", sql=oracle(f"""
, o AS (SELECT src_ip, ts_us, flags, row_number() OVER (PARTITION BY src_ip ORDER BY ts_us, flow_id) AS k, count(*) OVER (PARTITION BY src_ip) AS total FROM flows),
w AS (SELECT src_ip, k, total, ts_us AS s, ts_us AS e, 1 AS n, flags & 1 AS fins, CASE WHEN flags & 4 <> 0 THEN ts_us END AS closed, CAST(NULL AS STRUCT(s BIGINT, e BIGINT, n INTEGER, r VARCHAR)) AS done FROM o WHERE k = 1
UNION ALL SELECT src_ip, k, total, CASE WHEN r IS NULL THEN s ELSE t END, CASE WHEN r IS NULL THEN greatest(e, t) ELSE t END, CASE WHEN r IS NULL THEN n + 1 ELSE 1 END, CASE WHEN r IS NULL THEN fins ELSE 0 END + (f & 1),
  CASE WHEN r IS NULL AND closed IS NOT NULL THEN closed WHEN f & 4 <> 0 OR CASE WHEN r IS NULL THEN fins ELSE 0 END + (f & 1) >= 2 THEN t END, CASE WHEN r IS NOT NULL THEN {{'s': s, 'e': e, 'n': n, 'r': r}} END FROM (
  SELECT w.* EXCLUDE (k, done), o.k, o.ts_us AS t, o.flags AS f, CASE WHEN o.ts_us - e > {6 * HOUR} THEN CASE WHEN closed IS NOT NULL THEN 'closed' ELSE 'idle' END WHEN closed IS NOT NULL AND o.flags & 2 <> 0 AND o.flags & 16 = 0 THEN 'reuse' WHEN closed IS NOT NULL AND o.ts_us - closed > {HOUR} THEN 'closed' WHEN o.ts_us - s > {DAY} THEN 'active' END AS r
  FROM w JOIN o ON o.src_ip = w.src_ip AND o.k = w.k + 1)),
x AS (SELECT src_ip, done.s AS s, done.e AS e, done.n AS n, done.r AS r FROM w WHERE done IS NOT NULL UNION ALL SELECT src_ip, s, e, n, CASE WHEN closed IS NOT NULL THEN 'closed' ELSE 'flush' END FROM w WHERE k = total)
SELECT src_ip, s AS start_us, e AS end_us, CAST(n AS BIGINT) AS records, r AS end_reason FROM x""", "flows").replace("WITH ", "WITH RECURSIVE ", 1))
def flow_sessions_full(spark: SparkSession, sf: str) -> DataFrame:
    return FL.full_sessions(A.flows(spark, sf), "src_ip", 6 * HOUR, DAY, HOUR)


@query("STR-03", sql=oracle(f"""
, a AS (SELECT src_ip, list(ts_us ORDER BY ts_us, flow_id) AS ts FROM flows GROUP BY ALL),
f AS (SELECT src_ip, unnest(ts) AS t, unnest(generate_series(1, len(ts))) AS i, ts FROM a),
r AS (SELECT src_ip, i, list_reduce(list_slice(ts, 1, i), lambda s, x: CASE WHEN x - s >= {DAY} THEN x ELSE s END) AS anchor FROM f)
SELECT src_ip, anchor AS start_us, count(*) AS records FROM r GROUP BY ALL""", "flows"))
def host_tumbling_anchored(spark: SparkSession, sf: str) -> DataFrame:
    return FL.anchored_windows(A.flows(spark, sf), "src_ip", DAY)


@query("AGG-13", sql=oracle("""
, g AS (SELECT src_ip, ts_us, flow_id, (ts_us - lag(ts_us) OVER (PARTITION BY src_ip ORDER BY ts_us, flow_id)) / 1e6 AS g FROM flows),
c AS (SELECT *, g - avg(g) OVER (PARTITION BY src_ip) AS c FROM g WHERE g IS NOT NULL),
p AS (SELECT *, c * lag(c) OVER (PARTITION BY src_ip ORDER BY ts_us, flow_id) AS p FROM c)
SELECT src_ip, count(*) AS n, round(CASE WHEN sum(c * c) > 0 THEN sum(p) / sum(c * c) ELSE 0e0 END, 5) AS periodicity FROM p GROUP BY ALL HAVING count(*) > 2""", "flows"))
def lag1_autocorr(spark: SparkSession, sf: str) -> DataFrame:
    return FL.lag1_autocorrelation(A.flows(spark, sf), "src_ip")


@query("AGG-11", sql=oracle("""
, g AS (SELECT *, greatest(ts_us - lag(ts_us) OVER (PARTITION BY src_ip ORDER BY ts_us, flow_id), 0) / 1e6 AS g FROM flows)
SELECT src_ip, count(*) AS flow_count, round(coalesce(avg(g), 0), 4) AS mean_gap, round(coalesce(stddev_pop(g), 0), 3) AS std_gap, CAST(sum(bytes_out) AS BIGINT) AS total_bytes,
count(*) FILTER (bytes_out >= 20000) AS burst_count, (min(ts_us) // 60000000) % 1440 AS time_of_day FROM g GROUP BY ALL""", "flows"))
def host_temporal(spark: SparkSession, sf: str) -> DataFrame:
    return FL.host_temporal(A.flows(spark, sf), 20000)


@query("AGG-18", sql=oracle("SELECT src_ip, count(*) AS flow_count, round(avg(bytes_out), 4) AS mean_bytes, round(stddev_pop(bytes_out), 4) AS std_bytes FROM flows GROUP BY ALL", "flows"))
def host_baseline(spark: SparkSession, sf: str) -> DataFrame:
    return A.flows(spark, sf).groupBy("src_ip").agg(F.count("*").alias("flow_count"), F.round(F.avg("bytes_out"), 4).alias("mean_bytes"), F.round(F.stddev_pop("bytes_out"), 4).alias("std_bytes"))


@query("WIN-01", sql=oracle("""SELECT flow_id, round(avg(bytes_out) OVER w, 4) AS base_mean, round(stddev_pop(bytes_out) OVER w, 4) AS base_std, count(*) OVER w AS base_n FROM flows
WINDOW w AS (PARTITION BY src_ip ORDER BY ts_us, flow_id ROWS BETWEEN 30 PRECEDING AND 1 PRECEDING)""", "flows"))
def exfil_baseline(spark: SparkSession, sf: str) -> DataFrame:
    return H.baseline(A.flows(spark, sf)).select("flow_id", F.round("base_mean", 4).alias("base_mean"), F.round("base_std", 4).alias("base_std"), "base_n")


@query("WIN-03", sql=oracle("SELECT flow_id, CAST(row_number() OVER (PARTITION BY src_ip, dst_ip ORDER BY ts_us, flow_id) = 1 AS INTEGER) AS novel FROM flows", "flows"))
def dest_novelty(spark: SparkSession, sf: str) -> DataFrame:
    return H.baseline(A.flows(spark, sf)).select("flow_id", "novel")


@query("WIN-05", "STR-07", "STR-01", sql=oracle(f"""SELECT flow_id, src_ip, count(DISTINCT dst_ip) OVER w AS unique_dst, count(DISTINCT dst_port) OVER w AS unique_ports, count(*) OVER w AS attempts FROM flows
WINDOW w AS (PARTITION BY src_ip ORDER BY ts_us RANGE BETWEEN {DAY} PRECEDING AND CURRENT ROW)""", "flows"))
def sliding_fanout(spark: SparkSession, sf: str) -> DataFrame:
    return H.sliding_fanout(A.flows(spark, sf), DAY)


@query("WIN-05", sql=oracle(f"""
, j AS (SELECT a.flow_id, b.dst_ip, count(DISTINCT b.dst_port) AS p FROM flows a JOIN flows b ON a.src_ip = b.src_ip AND b.ts_us BETWEEN a.ts_us - {DAY} AND a.ts_us GROUP BY ALL)
SELECT flow_id, max(p) AS max_ports FROM j GROUP BY ALL""", "flows"))
def sliding_ports_per_dst(spark: SparkSession, sf: str) -> DataFrame:
    return H.sliding_ports(A.flows(spark, sf), DAY)


@query("WIN-08", "WIN-10", sql=oracle("""
, r AS (SELECT channel, flow_id, row_number() OVER (PARTITION BY channel ORDER BY ts_us, flow_id) AS rn, count(*) OVER w AS ring_n, min(ts_us) OVER w AS ring_start, CAST(sum(size) OVER w AS BIGINT) AS ring_bytes
FROM channels WINDOW w AS (PARTITION BY channel ORDER BY ts_us, flow_id ROWS BETWEEN 63 PRECEDING AND CURRENT ROW))
SELECT channel, flow_id, CAST(rn AS INTEGER) AS rn, ring_n, ring_start, ring_bytes FROM r WHERE rn >= 8 AND (rn - 8) % 2 = 0""", "channels"))
def channel_ring(spark: SparkSession, sf: str) -> DataFrame:
    return H.channel_ring(A.channels(spark, sf), "channel")


_BEACON = """
, g AS (SELECT channel, ts_us, size, ts_us - lag(ts_us) OVER (PARTITION BY channel ORDER BY ts_us, flow_id) AS g FROM channels),
s AS (SELECT channel, count(*) AS n, avg(size) AS m, stddev_pop(size) AS sd, max(ts_us) - min(ts_us) AS span_us FROM g GROUP BY ALL),
m AS (SELECT channel, quantile_cont(CAST(g AS DOUBLE), 0.5) AS med, count(*) AS gaps FROM g WHERE g > 1000 GROUP BY ALL),
d AS (SELECT channel, quantile_cont(abs(g - med), 0.5) AS mad, count(*) FILTER (abs(g - greatest(round_even(g / med, 0), 1) * med) <= 0.25e0 * med) AS near FROM g JOIN m USING (channel) WHERE g > 1000 GROUP BY ALL),
b AS (SELECT channel, n, gaps, med AS median_us, mad AS mad_us, near, span_us, round(sd / greatest(m, 1), 6) AS size_cv FROM m JOIN d USING (channel) JOIN s USING (channel) WHERE gaps >= 7)"""


@query("AGG-10", "FIL-14", "WIN-12", sql=oracle(_BEACON + " SELECT * FROM b", "channels"))
def beacon_stats(spark: SparkSession, sf: str) -> DataFrame:
    return H.beacon_stats(A.channels(spark, sf), "channel")


@query("AGG-19", "JOIN-08", sql=oracle("SELECT flow_id, least(u, 100) AS dst_sources FROM flows JOIN (SELECT dst_ip, count(DISTINCT src_ip) AS u FROM flows GROUP BY ALL) USING (dst_ip)", "flows"))
def beacon_rarity(spark: SparkSession, sf: str) -> DataFrame:
    f = A.flows(spark, sf)
    u = f.groupBy("dst_ip", "src_ip").agg(F.lit(1).alias("one")).groupBy("dst_ip").agg(F.count("*").alias("u"))
    return f.join(u, "dst_ip").select("flow_id", F.least("u", F.lit(100)).alias("dst_sources"))


@query("WIN-09", sql=oracle("""SELECT channel, flow_id, count(*) OVER w AS pair_conn_count, round((max(ts_us) OVER w - min(ts_us) OVER w) / 1e6 / greatest(count(*) OVER w - 1, 1), 6) AS pair_iat_mean
FROM channels WINDOW w AS (PARTITION BY channel ORDER BY ts_us, flow_id ROWS BETWEEN 255 PRECEDING AND CURRENT ROW)""", "channels"))
def pair_history(spark: SparkSession, sf: str) -> DataFrame:
    return H.pair_history(A.channels(spark, sf), "channel")


@query("WIN-13", "STR-12", sql=oracle("""
, o AS (SELECT src_ip, bytes_out >= 8000 AS hit, row_number() OVER (PARTITION BY src_ip ORDER BY ts_us, flow_id) AS k FROM flows),
w AS (SELECT DISTINCT src_ip, CAST(0 AS BIGINT) AS k, 0e0 AS s, 0 AS streak FROM o
UNION ALL SELECT o.src_ip, o.k, s * 0.35e0 + CASE WHEN hit THEN least(1e0, (streak + 1) / 3e0) ELSE 0e0 END * (1 - 0.35e0), CASE WHEN hit THEN streak + 1 ELSE greatest(streak - 1, 0) END FROM w JOIN o ON o.src_ip = w.src_ip AND o.k = w.k + 1)
SELECT src_ip, round(arg_max(s, k), 6) AS persistence, arg_max(streak, k) AS streak FROM w GROUP BY ALL""", "flows").replace("WITH ", "WITH RECURSIVE ", 1))
def persistence_fold(spark: SparkSession, sf: str) -> DataFrame:
    return H.persistence(A.flows(spark, sf), "src_ip", F.col("bytes_out") >= 8000)


@query("AGG-09", "TOP-05")
def lombscargle(spark: SparkSession, sf: str) -> DataFrame:
    return H.periodicity(A.flows(spark, sf), "src_ip")
