"""Records, feature vectors, feeds, sinks and captures, with oracles from the rules that made their inputs."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..functions import scalars as S
from ..ml import tabular as ML
from ..operators import alerts as AL
from ..operators import history as H
from ..operators import joins as J
from ..operators import records as R
from ..sources import captures, feeds
from . import adapters as A
from . import fixtures as X
from .queries_bytes import _scratch
from .registry import query

HOUR, DAY = 3_600_000_000, 86_400_000_000

PACKETS_SQL = """flow_packets AS (SELECT event_id AS packet_id, event_id % 25 AS flow_id, event_id * 10000 + (event_id * 7919 % 5) * 7000 AS ts_us, event_id * 31 % 3 > 0 AS forward,
  CASE WHEN event_id % 4 = 0 THEN 0 ELSE event_id * 17 % 1400 END AS payload_len, 40 + CASE WHEN event_id % 4 = 0 THEN 0 ELSE event_id * 17 % 1400 END AS ip_len,
  CASE WHEN event_id < 25 THEN 2 WHEN event_id % 97 = 0 THEN 17 WHEN event_id % 89 = 0 THEN 4 WHEN event_id % 4 = 0 THEN 16 ELSE 24 END AS flags FROM events)"""


def _packets(spark: SparkSession, sf: str) -> DataFrame:
    i = A.table(spark, sf, "events").select(F.col("event_id").alias("i"))
    return i.selectExpr(
        "i AS packet_id", "i % 25 AS flow_id", "i * 10000 + (i * 7919 % 5) * 7000 AS ts_us", "i * 31 % 3 > 0 AS forward", "CASE WHEN i % 4 = 0 THEN 0 ELSE i * 17 % 1400 END AS payload_len",
        "40 + CASE WHEN i % 4 = 0 THEN 0 ELSE i * 17 % 1400 END AS ip_len", "CASE WHEN i < 25 THEN 2 WHEN i % 97 = 0 THEN 17 WHEN i % 89 = 0 THEN 4 WHEN i % 4 = 0 THEN 16 ELSE 24 END AS flags",
    )


_FLOWREC = f"""WITH {PACKETS_SQL},
w AS (SELECT *, row_number() OVER o AS rn, greatest(ts_us - max(ts_us) OVER (o ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) / 1e6 AS g, count(*) FILTER (payload_len > 0) OVER (o ROWS UNBOUNDED PRECEDING) AS prn,
  max(CASE WHEN payload_len > 0 THEN ts_us END) OVER (o ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS lp FROM flow_packets WINDOW o AS (PARTITION BY flow_id ORDER BY ts_us, packet_id)),
r AS (SELECT flow_id, min(ts_us) AS s, max(ts_us) AS e, count(*) FILTER (forward) AS po, count(*) FILTER (NOT forward) AS pi, coalesce(sum(ip_len) FILTER (forward), 0) AS bo, coalesce(sum(ip_len) FILTER (NOT forward), 0) AS bi,
  coalesce(sum(payload_len) FILTER (forward), 0) AS lo, coalesce(sum(payload_len) FILTER (NOT forward), 0) AS li, count(*) FILTER (flags & 2 <> 0) AS syn, count(*) FILTER (flags & 1 <> 0) AS fin, count(*) FILTER (flags & 4 <> 0) AS rst, count(*) FILTER (flags & 16 <> 0) AS ack, count(*) FILTER (flags & 8 <> 0) AS psh,
  count(g) AS n, coalesce(avg(g), 0) AS m, coalesce(var_samp(g), 0) AS v, list(g ORDER BY rn) FILTER (rn BETWEEN 2 AND 129) AS iats, list(ts_us ORDER BY rn) FILTER (rn <= 512) AS times,
  list(CASE WHEN forward THEN payload_len ELSE -payload_len END ORDER BY rn) FILTER (payload_len > 0 AND prn <= 20) AS splt, list(CASE WHEN prn = 1 THEN 0e0 ELSE greatest(ts_us - lp, 0) / 1e3 END ORDER BY rn) FILTER (payload_len > 0 AND prn <= 20) AS splt_ms FROM w GROUP BY ALL)"""


@query("AGG-03", "AGG-04", "AGG-05", "AGG-06", "SF-22", "SF-24", sql=_FLOWREC + """
SELECT flow_id, po AS pkts_out, pi AS pkts_in, CAST(bo AS BIGINT) AS bytes_out, CAST(bi AS BIGINT) AS bytes_in, CAST(lo AS BIGINT) AS payload_out, CAST(li AS BIGINT) AS payload_in, syn AS syn_cnt, fin AS fin_cnt, rst AS rst_cnt, ack AS ack_cnt, psh AS psh_cnt, n AS iat_n,
round(m, 6) AS iat_mean, round(v, 6) AS iat_var, round((po + pi) / ((e - s) / 1e6), 6) AS pps, round((bo + bi) / ((e - s) / 1e6), 4) AS bytes_per_sec, round(bo / greatest(bi, 1), 6) AS out_in_byte_ratio, CAST(len(iats) AS INTEGER) AS n_iat, round(list_sum(iats), 6) AS sum_iat,
CAST(len(times) AS INTEGER) AS n_times, CAST(list_sum(times) AS BIGINT) AS sum_times, array_to_string(splt, ',') AS splt_len, round(list_sum(splt_ms), 6) AS sum_splt_ms FROM r""")
def flow_records(spark: SparkSession, sf: str) -> DataFrame:
    total = lambda c, zero: F.aggregate(c, F.lit(zero), lambda a, x: a + x)
    r = R.flow_records(_packets(spark, sf))
    return r.select(
        "flow_id", "pkts_out", "pkts_in", "bytes_out", "bytes_in", "payload_out", "payload_in", "syn_cnt", "fin_cnt", "rst_cnt", "ack_cnt", "psh_cnt", "iat_n", F.round("iat_mean", 6).alias("iat_mean"), F.round("iat_var", 6).alias("iat_var"),
        F.round("pps", 6).alias("pps"), F.round("bytes_per_sec", 4).alias("bytes_per_sec"), F.round("out_in_byte_ratio", 6).alias("out_in_byte_ratio"), F.size("iat_seq").alias("n_iat"), F.round(total("iat_seq", 0.0), 6).alias("sum_iat"),
        F.size("times").alias("n_times"), F.expr("aggregate(times, 0L, (a, x) -> a + x)").alias("sum_times"),
        F.array_join(F.transform("splt_len", lambda x: x.cast("string")), ",").alias("splt_len"), F.round(total("splt_iat_ms", 0.0), 6).alias("sum_splt_ms"),
    )


@query("PRJ-03", "SF-24", sql=_FLOWREC + """
, x AS (SELECT *, list_transform(splt, lambda y: abs(y)) AS sizes, (e - s) / 1e6 AS d, (bo + bi) / greatest(po + pi, 1) AS mean, CASE WHEN len(splt) > 1 THEN list_stddev_pop(list_transform(splt, lambda y: abs(y))) ELSE 0e0 END AS sd FROM r)
SELECT flow_id, round(d, 6) AS duration, CAST(po + pi AS DOUBLE) AS packet_count, CAST(bo + bi AS DOUBLE) AS byte_count, round((po + pi) / d, 6) AS packet_rate, round((bo + bi) / d, 6) AS byte_rate, round(mean, 6) AS packet_size_mean, round(sd, 6) AS packet_size_std, round(sd / mean, 6) AS packet_size_cv,
CAST(sizes[1] AS DOUBLE) AS first_packet_size, CAST(sizes[-1] AS DOUBLE) AS last_packet_size, round(m, 6) AS iat_mean, round(sqrt(v), 6) AS iat_std, round(list_max(iats) / 1000, 9) AS iat_max, round(sqrt(v) / m, 6) AS iat_cv, 0e0 AS periodicity_score, CASE WHEN flow_id % 2 = 0 THEN 1e0 ELSE 0e0 END AS tls_present,
771e0 AS tls_version, 0e0 AS server_hello, 0e0 AS ja3_hash_freq, 0e0 AS ja3s_hash_freq FROM x""")
def tls_vectors(spark: SparkSession, sf: str) -> DataFrame:
    r = R.flow_records(_packets(spark, sf)).withColumns({"ja3": F.when(F.col("flow_id") % 2 == 0, "x"), "tls_version": F.lit(771)})
    v = R.tls_vectors(r)
    return v.select("flow_id", *[F.round(c, 9 if c == "iat_max" else 6).alias(c) for c in R.TLS_FEATURES])


@query("AGG-13", sql=f"""WITH {PACKETS_SQL}, g AS (SELECT *, (ts_us - lag(ts_us) OVER (PARTITION BY flow_id, forward ORDER BY ts_us, packet_id)) / 1e6 AS g FROM flow_packets),
c AS (SELECT *, g - avg(g) OVER (PARTITION BY flow_id, forward) AS c FROM g), p AS (SELECT *, c * lag(c) OVER (PARTITION BY flow_id, forward ORDER BY ts_us, packet_id) AS p FROM c),
a AS (SELECT flow_id, forward, greatest((max(ts_us) - min(ts_us)) / 1e6, 0.000001e0) AS d, count(*) AS n, sum(ip_len) AS b, avg(ip_len) AS sm, stddev_pop(ip_len) AS ss, arg_min(ip_len, (ts_us, packet_id)) AS f, arg_max(ip_len, (ts_us, packet_id)) AS l, avg(g) AS gm, stddev_pop(g) AS gs, max(g) AS gx, sum(p) AS num, sum(c * c) AS den FROM p GROUP BY ALL)
SELECT flow_id, forward, round(d, 6) AS duration, n AS packet_count, CAST(b AS DOUBLE) AS byte_count, round(n / d, 6) AS packet_rate, round(b / d, 4) AS byte_rate, round(sm, 6) AS packet_size_mean, round(ss, 6) AS packet_size_std, round(ss / sm, 6) AS packet_size_cv, CAST(f AS DOUBLE) AS first_packet_size, CAST(l AS DOUBLE) AS last_packet_size,
round(gm, 6) AS iat_mean, round(gs, 6) AS iat_std, round(gx, 6) AS iat_max, round(gs / gm, 6) AS iat_cv, round(CASE WHEN den > 0 THEN num / den ELSE 0e0 END, 5) AS periodicity_score FROM a""")
def training_features(spark: SparkSession, sf: str) -> DataFrame:
    f = R.training_features(_packets(spark, sf), ["flow_id", "forward"])
    return f.select(*[F.round(c, 4 if c == "byte_rate" else 5 if c == "periodicity_score" else 6).alias(c) if k == "double" else F.col(c) for c, k in f.dtypes])


@query("SF-01", "SF-04", "SF-05", "SF-08", "AGG-08", "STR-06", "FIL-02", sql=X.oracle("""
, q AS (SELECT query_id, qtype, domain AS name, string_split(domain, '.') AS l FROM tunnel_queries WHERE NOT is_response), p AS (SELECT *, CASE WHEN len(l) > 1 THEN l[-2] ELSE l[1] END AS sld FROM q),
n AS (SELECT DISTINCT s FROM (SELECT replace(name, '.', '') AS s FROM p UNION ALL SELECT sld FROM p)), ch AS (SELECT s, c, count(*) AS n FROM (SELECT s, unnest(string_split(s, '')) AS c FROM n WHERE s <> '') GROUP BY ALL), h AS (SELECT s, greatest(log2(sum(n)) - sum(n * log2(n)) / sum(n), 0) AS h FROM ch GROUP BY ALL),
x AS (SELECT *, length(regexp_replace(sld, '[^aeiou]', '', 'g')) AS v, length(regexp_replace(sld, '[^A-Za-z]', '', 'g')) AS le, length(sld) AS sn, list_transform(generate_series(1, length(sld) - 1), lambda i: substr(sld, i, 2)) AS bi, list_transform(generate_series(1, length(sld) - 2), lambda i: substr(sld, i, 3)) AS tri FROM p)
SELECT query_id, sld, l[-1] AS tld, CAST(qtype IN (16, 10) AS INTEGER) AS is_txt_null, CAST(length(name) AS INTEGER) AS query_len, CAST(len(l) AS INTEGER) AS label_count, CAST(list_max(list_transform(l, lambda y: length(y))) AS INTEGER) AS max_label_len, CAST(sn AS INTEGER) AS sld_len, round(a.h, 6) AS char_entropy, round(coalesce(b.h, 0), 6) AS sld_entropy,
round(CASE WHEN sn > 0 THEN length(regexp_replace(sld, '[^0-9]', '', 'g')) / sn ELSE 0e0 END, 6) AS digit_ratio, round(CASE WHEN sn > 0 THEN v / sn ELSE 0e0 END, 6) AS vowel_ratio, round(CASE WHEN le - v > 0 THEN v / (le - v) ELSE CAST(v AS DOUBLE) END, 6) AS vowel_consonant_ratio,
concat('{', array_to_string(list_transform(list_sort(list_distinct(bi)), lambda g: concat('"', g, '":', len(list_filter(bi, lambda z: z = g)))), ','), '}') AS ngram2, concat('{', array_to_string(list_transform(list_sort(list_distinct(tri)), lambda g: concat('"', g, '":', len(list_filter(tri, lambda z: z = g)))), ','), '}') AS ngram3,
round(len(list_distinct(bi)) / greatest(sn - 1, 1), 6) AS ngram2_unique_ratio FROM x LEFT JOIN h a ON a.s = replace(name, '.', '') LEFT JOIN h b ON b.s = sld""", "tunnel_queries"))
def dns_records(spark: SparkSession, sf: str) -> DataFrame:
    return R.dns_records(X.tunnel_queries(spark, sf).where("not is_response"))


_IOC_ROWS = "SELECT CASE event_id % 6 WHEN 0 THEN 'url' WHEN 1 THEN 'domain' ELSE 'ip' END AS kind, concat(' Name', event_id % 40, '.ORG ') AS value, CASE WHEN event_id % 3 > 0 THEN concat('c', event_id % 4) END AS category, CASE WHEN event_id % 5 > 0 THEN event_id % 10 / 10e0 END AS confidence, event_id AS seq FROM events"


@query("SRC-07", "SNK-07", sql=f"WITH r AS ({_IOC_ROWS}) SELECT kind, lower(trim(value)) AS value, arg_max(coalesce(category, 'unknown'), seq) AS category, round(arg_max(coalesce(confidence, 0.9e0), seq), 6) AS confidence, max(seq) AS seq FROM r WHERE kind <> 'url' GROUP BY ALL")
def ioc_csv_import(spark: SparkSession, sf: str) -> DataFrame:
    """Indicators written as CSV, read back with their defaults and upserted; the row's number stands for its line."""
    path = _scratch(spark)
    i = F.col("event_id")
    rows = A.table(spark, sf, "events").select(
        F.when(i % 6 == 0, "url").when(i % 6 == 1, "domain").otherwise("ip").alias("kind"), F.concat(F.lit(" Name"), (i % 40).cast("string"), F.lit(".ORG ")).alias("value"),
        F.when(i % 3 > 0, F.concat(F.lit("c"), (i % 4).cast("string"))).alias("category"), F.when(i % 5 > 0, i % 10 / 10.0).alias("confidence"), i.cast("string").alias("source"),
    )
    rows.write.option("header", "true").option("ignoreLeadingWhiteSpace", "false").option("ignoreTrailingWhiteSpace", "false").csv(path)
    return J.upsert(feeds.read_iocs(spark, path).withColumn("seq", F.col("source").cast("long"))).withColumn("confidence", F.round("confidence", 6))


@query("SRC-08", "SNK-01", "SNK-02", "SF-25", sql=A.oracle("""
, r AS (SELECT CASE WHEN flow_id % 17 = 0 THEN 'malformed' ELSE CASE WHEN dst_port = 445 THEN 'scan' ELSE 'beacon' END END AS threat_class, count(*) AS n, CAST(sum(CASE WHEN flow_id % 17 = 0 THEN 0 ELSE bytes_out END) AS BIGINT) AS bytes FROM flows GROUP BY ALL) SELECT * FROM r""", "flows"))
def json_lines(spark: SparkSession, sf: str) -> DataFrame:
    """Alerts appended as JSON lines, some of them cut off, read back with a count of the malformed ones."""
    path = _scratch(spark)
    kind = F.when(F.col("dst_port") == 445, "scan").otherwise("beacon")
    whole = A.flows(spark, sf).select("flow_id", kind.alias("threat_class"), F.struct("src_ip", "dst_ip").alias("flow_identifier"), "bytes_out")
    feeds.write_lines(whole.where("flow_id % 17 <> 0"), path)
    whole.where("flow_id % 17 = 0").select(F.expr("substring(to_json(struct(*)), 1, 20)").alias("value")).write.mode("append").text(path)
    good, bad = feeds.read_lines(spark, path, StructType.fromDDL("flow_id long, threat_class string, flow_identifier struct<src_ip: string, dst_ip: string>, bytes_out long"))
    counts = good.groupBy("threat_class").agg(F.count("*").alias("n"), F.sum("bytes_out").alias("bytes"))
    return counts.unionByName(bad.agg(F.count("*").alias("n")).select(F.lit("malformed").alias("threat_class"), "n", F.lit(0).cast("long").alias("bytes")))


@query("SRC-06", sql=A.oracle("SELECT CASE WHEN flow_id % 9 = 0 OR flow_id % 14 = 0 THEN 'rejected' ELSE 'accepted' END AS verdict, count(*) AS n FROM flows GROUP BY ALL", "flows"))
def ingest_checked(spark: SparkSession, sf: str) -> DataFrame:
    rows = A.flows(spark, sf).withColumn("src_port", F.when(F.col("flow_id") % 9 == 0, 70000).otherwise(F.col("src_port"))).withColumn("bytes_in", F.when(F.col("flow_id") % 14 == 0, -1).otherwise(F.col("bytes_in")))
    good, bad = feeds.ingest(rows)
    return good.agg(F.count("*").alias("n")).withColumn("verdict", F.lit("accepted")).unionByName(bad.agg(F.count("*").alias("n")).withColumn("verdict", F.lit("rejected")))


@query("SRC-09", "SNK-03", sql=A.oracle("SELECT max(ts_us // 3600000000) AS timestamp, count(*) AS flows, CAST(sum(bytes_out) AS BIGINT) AS bytes FROM flows WHERE ts_us // 3600000000 = (SELECT max(ts_us // 3600000000) FROM flows)", "flows"))
def telemetry_snapshot(spark: SparkSession, sf: str) -> DataFrame:
    """The state of every hour in turn (here of the last two) replaces the one before; what is read is the last."""
    path = _scratch(spark)
    spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).mkdirs(spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path))
    hours = A.flows(spark, sf).groupBy(F.expr("ts_us div 3600000000").alias("timestamp")).agg(F.count("*").alias("flows"), F.sum("bytes_out").alias("bytes"))
    for skip in (1, 0):
        feeds.put_snapshot(spark, hours.orderBy(F.desc("timestamp")).offset(skip).limit(1), f"{path}/telemetry.json")
    return feeds.get_snapshot(spark, path, "timestamp long, flows long, bytes long")


@query("SNK-04", "SNK-06", "TOP-03", sql=A.oracle(", s AS (SELECT flow_id AS alert_id, ts_us, row_number() OVER (ORDER BY ts_us, flow_id) AS seq FROM flows) SELECT alert_id, seq FROM s WHERE seq > (SELECT max(seq) FROM s) - 150 AND seq > 600", "flows"))
def alerts_since(spark: SparkSession, sf: str) -> DataFrame:
    s = feeds.sequenced(A.flows(spark, sf).select(F.col("flow_id").alias("alert_id"), "ts_us"), ["ts_us", "alert_id"])
    return feeds.since(s, 600, ring=150).select("alert_id", "seq")


@query("TOP-09", sql=A.oracle("SELECT flow_id AS alert_id, src_ip, dst_ip FROM flows WHERE flow_id = 77", "flows"))
def alert_lookup(spark: SparkSession, sf: str) -> DataFrame:
    return feeds.by_id(A.flows(spark, sf).select(F.col("flow_id").alias("alert_id"), "src_ip", "dst_ip"), 77)


@query("SRC-14", sql="""WITH l AS (SELECT lower(trim(string_split(concat(n_nationkey, ', ', n_name, '-networks', CASE WHEN n_nationkey % 5 > 0 THEN '.co.uk' ELSE '' END), ',')[-1])) AS d FROM nation), s AS (SELECT string_split(d, '.')[1] AS label FROM l WHERE contains(d, '.'))
SELECT label FROM s WHERE length(label) >= 7 ORDER BY md5(concat('1', label)), label LIMIT 10""")
def domain_list(spark: SparkSession, sf: str) -> DataFrame:
    n = A.table(spark, sf, "nation").select(F.concat(F.col("n_nationkey").cast("string"), F.lit(", "), "n_name", F.lit("-networks"), F.when(F.col("n_nationkey") % 5 > 0, ".co.uk").otherwise("")).alias("value"))
    return feeds.load_domains(n, limit=10)


@query("SRC-13", sql="""WITH d AS (SELECT id, CAST(concat('0x', substr(md5(concat('7:class:', id)), 1, 6)) AS BIGINT) % 100 AS s FROM range(2000) t(id))
SELECT CASE WHEN s < 30 THEN 'Botnet C2 Beaconing' WHEN s < 50 THEN 'Port Scan' WHEN s < 65 THEN 'DDoS Flood' WHEN s < 80 THEN 'DGA Domain' WHEN s < 90 THEN 'DNS Tunneling' ELSE 'Data Exfiltration' END AS threat_class, count(*) AS n FROM d GROUP BY ALL""")
def mock_feed(spark: SparkSession, sf: str) -> DataFrame:
    return feeds.mock_alerts(spark, 2000).groupBy("threat_class").agg(F.count("*").alias("n"))


@query("SRC-12", "AGG-24")
def simulated_truth(spark: SparkSession, sf: str) -> DataFrame:
    """The beacon detector over simulated traffic, against its ground truth, with the first alert of each pair."""
    from ..detectors import beacon

    path = _scratch(spark)
    feeds.simulated_flows(spark, 40, 3600).write.parquet(path)  # random, so it is drawn once
    f = spark.read.parquet(path)
    cfg = beacon.BeaconConfig(allowed_ports=(123,))
    alerts = beacon.beacons(f, cfg).join(f.select("flow_id", "ts_us"), "flow_id")
    counts = J.truth_counts(alerts, f.where("is_beacon"), ["src_ip", "dst_ip"])
    return counts.join(F.broadcast(J.first_alerts(alerts).agg(F.count("*").alias("pairs"), F.min("first_us").alias("first_us"))))


@query("SRC-01", "PAR-01", "PAR-02", "PAR-03", "PAR-04", "PAR-05", "PAR-06", "PAR-12", "AGG-20", "SNK-08", sql="""WITH f AS (SELECT event_id AS i FROM events WHERE event_id < 400)
SELECT CASE WHEN i % 10 = 9 THEN 'skipped' WHEN i % 10 < 4 THEN 'dns' ELSE 'tcp' END AS record, count(*) AS packets, CAST(sum(CASE WHEN i % 10 = 9 THEN 0 WHEN i % 10 < 4 THEN 28 + 12 + 5 + length(concat('h', i, '.example.org')) + 1 WHEN i % 10 = 8 THEN 28 ELSE 40 + i % 50 END) AS BIGINT) AS bytes FROM f GROUP BY ALL""")
def capture_report(spark: SparkSession, sf: str) -> DataFrame:
    """Captures of several link types written by rule, read back: packets and bytes by kind, malformed frames counted as skipped."""
    return captures.report(captures.read_packets(spark, captures.write_fixture(spark, _scratch(spark), captures.mixed_frames(400))))


@query("SRC-10", sql="SELECT * FROM (VALUES ('link0', 0, 100), ('link1', 0, 100), ('link101', 0, 100), ('link113', 0, 100), ('link1', 1, 16 * 3 + 4 * 2)) AS t(capture_id, label, packets)")
def capture_labels(spark: SparkSession, sf: str) -> DataFrame:
    """Captures found below a folder, labelled by where they lie."""
    path = _scratch(spark)
    captures.write_fixture(spark, path, captures.mixed_frames(400))
    captures.write_fixture(spark, path, captures.hello_frames(20), "malware")
    return captures.labelled(captures.read_packets(spark, path)).groupBy("capture_id", "label").agg(F.count("*").alias("packets"))


@query("PAR-07", "PAR-08", "PAR-11", "SRC-04", "SRC-11", sql="""WITH f AS (SELECT unnest(generate_series(0, 19)) AS i) SELECT concat('10.0.0.', i + 1) AS src_ip, concat('site', i % 7, '.example.com') AS sni, md5(concat('771,', 4865 + i % 3, '-49195,0-10-11,29-23,0')) AS ja3, concat('t12d0203', '00_', substr(sha256(array_to_string(list_sort([printf('%04x', 4865 + i % 3), 'c02b']), ',')), 1, 12), '_', substr(sha256('000a,000b'), 1, 12)) AS ja4 FROM f WHERE i % 5 <> 4""")
def capture_hellos(spark: SparkSession, sf: str) -> DataFrame:
    """Hellos in three segments, out of order in the file; every fifth flow never completes one."""
    p = captures.read_packets(spark, captures.write_fixture(spark, _scratch(spark), captures.hello_frames(20)))
    return captures.hellos(p).select("src_ip", "sni", "ja3", "ja4")


@query("PAR-10", sql="""SELECT p_partkey, md5(concat('771,2570-', p_size, '-4865,', p_size, '-', p_partkey % 60, ',29-23,0')) AS ja3_raw, md5(concat('771,', p_size, ',', p_partkey % 60, '-43')) AS ja3s FROM part""")
def ja3_raw_and_server(spark: SparkSession, sf: str) -> DataFrame:
    p = A.table(spark, sf, "part")
    size, ext = F.col("p_size").cast("int"), (F.col("p_partkey") % 60).cast("int")
    raw = S.ja3(F.lit(771), F.array(F.lit(0x0A0A), size, F.lit(4865)), F.array(size, ext), F.array(F.lit(29), F.lit(23)), F.array(F.lit(0)), drop_grease=False)
    return p.select("p_partkey", raw["md5"].alias("ja3_raw"), S.ja3s(F.lit(771), size, F.array(ext, F.lit(43)))["md5"].alias("ja3s"))


@query("SRC-02", sql=A.oracle(", f AS (SELECT min(ts_us) AS a FROM flows) SELECT flow_id, CAST(floor((ts_us - a) / 4e0) AS BIGINT) AS release_us FROM flows, f", "flows"))
def paced_replay(spark: SparkSession, sf: str) -> DataFrame:
    return R.paced(A.flows(spark, sf).select("flow_id", "ts_us"), 4.0).select("flow_id", "release_us")


@query("PRJ-01", sql=A.oracle("SELECT k.name, count(*) AS n, CAST(sum(CASE k.name WHEN 'recon' THEN CASE WHEN flags & 2 <> 0 THEN 2 ELSE 0 END WHEN 'beacon' THEN bytes_out ELSE bytes_out + bytes_in + duration_us END) AS BIGINT) AS total FROM flows, (VALUES ('beacon'), ('recon'), ('exfil')) k(name) GROUP BY ALL", "flows"))
def record_adapters(spark: SparkSession, sf: str) -> DataFrame:
    a = R.adapted(A.flows(spark, sf))
    sums = {"beacon": F.sum("bytes_out"), "recon": F.sum("flags").cast("long"), "exfil": F.sum(F.col("bytes_out") + F.col("bytes_in") + F.col("duration_us"))}
    out = [a[k].agg(F.count("*").alias("n"), sums[k].alias("total")).withColumn("name", F.lit(k)) for k in a]
    return out[0].unionByName(out[1]).unionByName(out[2])


@query("FIL-11", "AGG-16", sql=A.oracle("""
, a AS (SELECT *, CASE pkts WHEN 1 THEN 'CRITICAL' WHEN 2 THEN 'HIGH' ELSE 'LOW' END AS severity, CASE WHEN dst_port = 445 THEN 'scan' WHEN dst_port = 53 THEN 'dga' ELSE 'beacon' END AS cls, CASE WHEN flow_id % 8 = 0 THEN 'EARLY_EXIT_TI_OVERRIDE' ELSE 'c2' END AS path FROM flows), f AS (SELECT * FROM a WHERE severity IN ('CRITICAL', 'HIGH') AND cls IN ('scan', 'beacon'))
SELECT count(*) AS alerts, count(*) FILTER (severity = 'CRITICAL') AS critical, count(*) FILTER (path = 'EARLY_EXIT_TI_OVERRIDE') AS early_exits, round(count(*) FILTER (flow_id % 3 = 0) / count(*), 6) AS hit_ratio, count(*) FILTER (severity = 'CRITICAL') - 10 AS critical_delta FROM f""", "flows"))
def dashboard_kpis(spark: SparkSession, sf: str) -> DataFrame:
    sev = F.when(F.col("pkts") == 1, "CRITICAL").when(F.col("pkts") == 2, "HIGH").otherwise("LOW")
    cls = F.when(F.col("dst_port") == 445, "scan").when(F.col("dst_port") == 53, "dga").otherwise("beacon")
    a = A.flows(spark, sf).withColumns({"severity": sev, "threat_class": cls, "path": F.when(F.col("flow_id") % 8 == 0, "EARLY_EXIT_TI_OVERRIDE").otherwise("c2"), "cache_hit": F.col("flow_id") % 3 == 0})
    return AL.kpis(AL.filtered(a, ["CRITICAL", "HIGH"], ["scan", "beacon"]), {"critical": 10})


@query("AGG-18", "WIN-01", sql=A.oracle("""
, r AS (SELECT *, bytes_out / greatest(duration_us / 1e6, 1e0) AS rate FROM flows) SELECT flow_id, round(coalesce(avg(rate) OVER w, 0), 6) AS base_rate, count(*) OVER w AS base_n FROM r WINDOW w AS (PARTITION BY src_ip ORDER BY ts_us, flow_id ROWS BETWEEN 30 PRECEDING AND 1 PRECEDING)""", "flows"))
def rate_baseline(spark: SparkSession, sf: str) -> DataFrame:
    f = A.flows(spark, sf).withColumn("rate", F.col("bytes_out") / F.greatest(F.col("duration_us") / 1e6, F.lit(1.0)))
    return H.baseline(f).select("flow_id", F.round(F.coalesce("base_rate", F.lit(0.0)), 6).alias("base_rate"), "base_n")


@query("SF-13", sql=A.oracle("""SELECT flow_id, bytes_out + bytes_in AS total_bytes, round(CASE WHEN duration_us > 0 THEN bytes_out / (duration_us / 1e6) ELSE 0e0 END, 6) AS out_rate, round(CASE WHEN duration_us > 0 THEN bytes_in / (duration_us / 1e6) ELSE 0e0 END, 6) AS in_rate, round(CASE WHEN duration_us > 0 THEN (bytes_out + bytes_in) / (duration_us / 1e6) ELSE 0e0 END, 6) AS total_rate,
round(CASE WHEN duration_us > 0 THEN pkts / (duration_us / 1e6) ELSE 0e0 END, 6) AS packet_rate FROM flows""", "flows"))
def volume_rates(spark: SparkSession, sf: str) -> DataFrame:
    return S.volume_features(A.flows(spark, sf))


@query("JOIN-06", "WIN-09", sql=X.oracle("""
, h AS (SELECT src_ip, dst_ip, dst_port, proto, ts_us, flow_id, count(*) OVER w AS n, (max(ts_us) OVER w - min(ts_us) OVER w) / 1e6 AS span FROM beats WINDOW w AS (PARTITION BY src_ip, dst_ip, dst_port, proto ORDER BY ts_us, flow_id ROWS BETWEEN 255 PRECEDING AND CURRENT ROW))
SELECT a.flow_id, arg_max(h.n, (h.ts_us, h.flow_id)) AS pair_conn_count, round(arg_max(CASE WHEN n > 1 THEN span / (n - 1) ELSE 0e0 END, (h.ts_us, h.flow_id)), 6) AS pair_iat_mean FROM beats a JOIN h ON a.src_ip = h.src_ip AND a.dst_ip = h.dst_ip AND a.dst_port = h.dst_port AND a.proto = h.proto AND h.ts_us <= a.ts_us + 90000000 GROUP BY ALL""", "beats"))
def pair_features_at_emit(spark: SparkSession, sf: str) -> DataFrame:
    """Flows that are emitted 90 s after their start, with the pair history as it stands then."""
    b = X.beats(spark, sf)
    return H.pair_features(b, b.withColumn("emit_us", F.col("ts_us") + 90_000_000)).select("flow_id", "pair_conn_count", F.round("pair_iat_mean", 6).alias("pair_iat_mean"))


@query("JOIN-10", "ML-03", "ML-04", sql="""WITH c AS (SELECT DISTINCT o_custkey AS capture, CAST(o_custkey % 2 AS INTEGER) AS label FROM orders), s AS (SELECT capture, CASE WHEN row_number() OVER w <= ceil(count(*) OVER (PARTITION BY label) * 0.6e0) THEN 0 WHEN row_number() OVER w <= ceil(count(*) OVER (PARTITION BY label) * 0.8e0) THEN 1 ELSE 2 END AS split FROM c WINDOW w AS (PARTITION BY label ORDER BY md5(CAST(capture AS VARCHAR)))),
r AS (SELECT o_custkey AS capture, CASE o_orderpriority WHEN '1-URGENT' THEN 0 WHEN '2-HIGH' THEN 1 ELSE -1 END AS protocol FROM orders) SELECT CAST(split AS INTEGER) AS split, protocol, count(*) AS n FROM r JOIN s USING (capture) GROUP BY ALL""")
def split_training_rows(spark: SparkSession, sf: str) -> DataFrame:
    """Training rows with their capture's split and the encoded protocol, identifiers dropped."""
    o = A.table(spark, sf, "orders")
    splits = ML.split_captures(o.select(F.col("o_custkey").alias("capture"), (F.col("o_custkey") % 2).cast("int").alias("label")).distinct())
    rows = o.select(F.col("o_custkey").alias("capture"), F.when(F.col("o_orderpriority") == "1-URGENT", "tcp").when(F.col("o_orderpriority") == "2-HIGH", "UDP").otherwise("icmp").alias("protocol"), F.lit("x").alias("src_ip"))
    return ML.with_split(ML.encoded(rows, drop=("src_ip",)), splits).groupBy("split", "protocol").agg(F.count("*").alias("n"))


@query("AGG-22", sql="""WITH e AS (SELECT doc_id, quality AS y, least(1e0, n_chars / 20000e0) >= 0.1e0 AS hit FROM labels JOIN documents USING (doc_id)), c AS (SELECT count(*) FILTER (hit AND y = 1) AS tp, count(*) FILTER (hit AND y = 0) AS fp, count(*) FILTER (NOT hit AND y = 1) AS fn, count(*) FILTER (NOT hit AND y = 0) AS tn FROM e)
SELECT 0 AS class, round(CASE WHEN tn + fn > 0 THEN tn / (tn + fn) ELSE 0e0 END, 6) AS precision, round(CASE WHEN tn + fp > 0 THEN tn / (tn + fp) ELSE 0e0 END, 6) AS recall, round(2 * tn / greatest(2 * tn + fn + fp, 1), 6) AS f1, tn + fp AS support FROM c
UNION ALL SELECT 1, round(CASE WHEN tp + fp > 0 THEN tp / (tp + fp) ELSE 0e0 END, 6), round(CASE WHEN tp + fn > 0 THEN tp / (tp + fn) ELSE 0e0 END, 6), round(2 * tp / greatest(2 * tp + fp + fn, 1), 6), tp + fn FROM c""")
def classification_report(spark: SparkSession, sf: str) -> DataFrame:
    from .queries_more import _eval

    return ML.report(_eval(spark, sf), 0.1)


@query("STR-08", sql=A.oracle(f"""
, k AS (SELECT ts_us // {DAY} AS bucket, src_ip, min((ts_us, flow_id)) AS seen, count(*) AS n FROM flows GROUP BY ALL), r AS (SELECT *, row_number() OVER (PARTITION BY bucket ORDER BY seen) AS rank FROM k)
SELECT bucket, CAST(coalesce(sum(n) FILTER (rank > 5), 0) AS BIGINT) AS dropped_rows, count(*) FILTER (rank > 5) AS dropped_keys FROM r GROUP BY ALL""", "flows"))
def state_bounds(spark: SparkSession, sf: str) -> DataFrame:
    return R.bounded_keys(A.flows(spark, sf).withColumn("bucket", F.expr(f"ts_us div {DAY}")), ["src_ip"], "bucket", 5)[1]


@query("STR-11", "FIL-01", sql=X.oracle("""
, m(consumer, t) AS (VALUES ('ddos','window'),('ddos','flow'),('c2','flow'),('dga','dns'),('dns_tunnel','dns'),('dns_tunnel','window'),('tls','tls_hello'),('tls','flow_early'),('tls','flow'),('portscan','window'),('portscan','flow'),('exfil','flow'),('ti','flow'),('ti','dns'),('ti','tls_hello')),
r AS (SELECT consumer, record_id, ts_us, ts_us // 9000000 AS slot, (row_number() OVER (PARTITION BY consumer, ts_us // 9000000 ORDER BY ts_us, record_id) - 1) // 2 AS part FROM records JOIN m ON record_type = t)
SELECT consumer, count(*) AS records, min(ts_us) AS first_us, 0 AS dropped FROM r GROUP BY consumer, slot, part""", "records"))
def dispatch_batches(spark: SparkSession, sf: str) -> DataFrame:
    return R.dispatched(AL.route(X.records(spark, sf)), "record_id", size=2, wait_us=9_000_000)


@query("TOP-08", sql=A.oracle("SELECT flow_id, row_number() OVER (ORDER BY ts_us, flow_id) AS place FROM flows", "flows"))
def time_ordered(spark: SparkSession, sf: str) -> DataFrame:
    return feeds.sequenced(A.flows(spark, sf).select("flow_id", "ts_us"), ["ts_us", "flow_id"]).select("flow_id", F.col("seq").alias("place"))


@query("SET-08", "AGG-15", sql=X.oracle("""
, t AS (SELECT record_id, 0 AS ord, 'ti' AS path FROM records WHERE record_id % 6 = 0 UNION ALL SELECT record_id, 1, 'c2' FROM records WHERE record_id % 4 = 0 UNION ALL SELECT record_id, 2, 'recon' FROM records WHERE record_id % 10 = 0) SELECT record_id, path, CAST(row_number() OVER (PARTITION BY record_id ORDER BY ord) AS INTEGER) AS place FROM t""", "records"))
def merged_alerts(spark: SparkSession, sf: str) -> DataFrame:
    r = X.records(spark, sf).select("record_id")
    return AL.merged([("ti", r.where("record_id % 6 = 0")), ("c2", r.where("record_id % 4 = 0")), ("recon", r.where("record_id % 10 = 0"))], "record_id")


@query("SF-15", "SF-20", "PRJ-05", sql=A.oracle("""SELECT flow_id, concat(src_ip, ':', src_port, '>', dst_ip, ':', dst_port, '/', proto) AS flow_key, strftime(make_timestamp(ts_us), '%Y-%m-%dT%H:%M:%S.') || lpad(CAST(ts_us // 1000 % 1000 AS VARCHAR), 3, '0') || 'Z' AS timestamp, CAST(ts_us // 60000000 % 1440 AS INTEGER) AS minute_of_day, round(least(1e0, bytes_out / 1e4), 6) AS confidence, 'HIGH' AS severity FROM flows""", "flows"))
def alert_envelopes(spark: SparkSession, sf: str) -> DataFrame:
    f = A.flows(spark, sf).withColumns({"confidence": F.col("bytes_out") / 1e4, "severity": F.lit("high")})
    e = AL.envelope(f, "Data Exfiltration", "exfiltration_detector", F.struct("bytes_out"))
    return e.select(F.col("flow_identifier.flow_id").alias("flow_id"), "flow_identifier.flow_key", "timestamp", S.minute_of_day(S.event_micros("timestamp")).alias("minute_of_day"), F.round("confidence_score", 6).alias("confidence"), "severity")


@query("DET-09", "ML-01", "ML-02", "ML-05", "ML-06", "SNK-09", "TOP-07")
def model_comparison(spark: SparkSession, sf: str) -> DataFrame:
    """Forest and boosted trees on the flow vectors: metrics on the held-out captures, ranked; the best is saved, loaded and applied."""
    from ..ml import models

    r = R.flow_records(_packets(spark, sf).withColumn("flow_id", F.col("packet_id") % 200)).withColumn("ja3", F.when(F.col("flow_id") % 2 == 0, "x"))
    rows = R.tls_vectors(r).withColumns({"label": (F.col("flow_id") % 3 == 0).cast("int"), "split": (F.col("flow_id") % 5).cast("int")})
    rows = rows.withColumn("packet_size_std", F.col("packet_size_std") + 400 * F.col("label"))
    path = f"{_scratch(spark)}/{uuid.uuid4().hex}"
    table = models.compare(rows, list(R.TLS_FEATURES), {"forest": models.forest(trees=20, depth=6), "boosted": models.boosted(rounds=8, depth=4)}, path)
    scored = models.predict(spark, rows.drop("packet_rate"), path).agg(F.avg(((F.col("probability") >= F.col("threshold")) == (F.col("label") == 1)).cast("int")).alias("served_accuracy"))
    return table.join(F.broadcast(scored))

