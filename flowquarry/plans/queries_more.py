"""Scalar, join, alert and learning queries with their oracles."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import scalars as S
from ..ml import tabular as ML
from ..operators import alerts as AL
from ..operators import joins as J
from . import adapters as A
from .adapters import oracle
from .registry import query

HOUR, DAY = 3_600_000_000, 86_400_000_000


def _labels(spark: SparkSession, sf: str) -> DataFrame:
    """Distinct first labels of the hosts and the customers' segments as second-level names."""
    hosts = A.dns(spark, sf).select(F.split("domain", r"\.")[0].alias("label"))
    parts = A.table(spark, sf, "part").select(F.lower(F.regexp_replace("p_name", "[^A-Za-z0-9]", "")).alias("label"))
    return hosts.unionByName(parts).where("label <> ''").distinct()


_LABELS = """, labels_ AS (SELECT DISTINCT label FROM (SELECT string_split(domain, '.')[1] AS label FROM dns UNION ALL SELECT lower(regexp_replace(p_name, '[^A-Za-z0-9]', '', 'g')) FROM part) WHERE label <> '')"""
_ENT = "(SELECT -sum(c / t * log2(c / t)) FROM (SELECT count(*) AS c, max(length(label)) AS t FROM (SELECT unnest(string_split(label, '')) AS ch) GROUP BY ch))"


@query("SF-05", "SF-08", sql=oracle(_LABELS + """
, c AS (SELECT label, ch, count(*) AS c FROM (SELECT label, unnest(string_split(label, '')) AS ch FROM labels_) GROUP BY ALL),
e AS (SELECT label, log2(sum(c)) - sum(c * log2(c)) / sum(c) AS h FROM c GROUP BY ALL)
SELECT label, CAST(length(label) AS INTEGER) AS query_len, round(greatest(h, 0), 5) AS char_entropy, round(length(regexp_replace(label, '[^0-9]', '', 'g')) / length(label), 6) AS digit_ratio,
round(length(regexp_replace(label, '[^aeiou]', '', 'g')) / length(label), 6) AS vowel_ratio FROM labels_ JOIN e USING (label)""", "dns"))
def dns_lexical(spark: SparkSession, sf: str) -> DataFrame:
    n = F.length("label")
    return _labels(spark, sf).select("label", n.alias("query_len"), F.round(F.greatest(S.char_entropy("label"), F.lit(0.0)), 5).alias("char_entropy"), F.round(S.count_of("label", "0-9") / n, 6).alias("digit_ratio"), F.round(S.count_of("label", "aeiou") / n, 6).alias("vowel_ratio"))


@query("SF-02", sql=oracle("""
, l AS (SELECT query_id, string_split(domain, '.') AS l FROM dns)
SELECT query_id, l[-2] AS sld, l[-1] AS suffix, concat(l[-2], '.', l[-1]) AS registered, array_to_string(l[:-3], '.') AS subdomain FROM l""", "dns"))
def domain_split_psl(spark: SparkSession, sf: str) -> DataFrame:
    return A.dns(spark, sf).select("query_id", S.domain_parts("domain").alias("p")).select("query_id", "p.sld", "p.suffix", "p.registered", "p.subdomain")


@query("AGG-08", sql=oracle(_LABELS + """
, g AS (SELECT label, unnest(list_transform(generate_series(1, length(label) - 1), lambda i: substr(label, i, 2))) AS g FROM labels_ WHERE length(label) >= 2)
SELECT label, CAST(count(*) AS BIGINT) AS n, CAST(count(DISTINCT g) AS BIGINT) AS kinds FROM g GROUP BY ALL""", "dns"))
def ngram_counts(spark: SparkSession, sf: str) -> DataFrame:
    g = S.ngrams("label", 2)
    return _labels(spark, sf).where(F.length("label") >= 2).select("label", F.size(g).cast("long").alias("n"), F.size(F.array_distinct(g)).cast("long").alias("kinds"))


@query("SF-06", "SF-07", sql=oracle(_LABELS + """
SELECT label, CAST(coalesce(list_max(list_transform(regexp_extract_all(label, '[bcdfghjklmnpqrstvwxyz]+'), lambda x: length(x))), 0) AS INTEGER) AS consonant_run,
CAST(coalesce(list_max(list_transform(regexp_extract_all(label, '[0-9]+'), lambda x: length(x))), 0) AS INTEGER) AS digit_run, CAST(regexp_matches(label, '^[0-9a-f]{12,}$') AS INTEGER) AS hex_like FROM labels_""", "dns"))
def run_lengths(spark: SparkSession, sf: str) -> DataFrame:
    return _labels(spark, sf).select("label", S.longest_run("label", "bcdfghjklmnpqrstvwxyz").alias("consonant_run"), S.longest_run("label", "0-9").alias("digit_run"), F.col("label").rlike("^[0-9a-f]{12,}$").cast("int").alias("hex_like"))


@query("AGG-21", "SF-17", sql=oracle(_LABELS + """
, c AS (SELECT concat('^^', label, '$') AS w FROM labels_), t AS (SELECT w, unnest(generate_series(3, length(w))) AS i FROM c)
SELECT substr(w, i - 2, 2) AS ctx, substr(w, i, 1) AS ch, count(*) AS n, round(count(*) * ln(2), 5) AS weight FROM t GROUP BY ALL""", "dns"))
def trigram_lm(spark: SparkSession, sf: str) -> DataFrame:
    lm = ML.trigram_counts(_labels(spark, sf).withColumn("count", F.lit(1)), "label")
    return lm.select("ctx", "ch", "n", F.round("weight", 5).alias("weight"))


@query("SF-09", sql=oracle(_LABELS + """
, c AS (SELECT label, concat('^^', label, '$') AS w FROM labels_), t AS (SELECT label, w, unnest(generate_series(3, length(w))) AS i FROM c),
g AS (SELECT label, substr(w, i - 2, 2) AS ctx, substr(w, i, 1) AS ch FROM t), m AS (SELECT ctx, ch, count(*) * ln(2) AS n FROM g GROUP BY ALL), s AS (SELECT ctx, sum(n) AS tot FROM m GROUP BY ALL)
SELECT label, round(avg(ln((n + 0.05e0) / (tot + 1.9e0))), 5) AS trigram_logp FROM g JOIN m USING (ctx, ch) JOIN s USING (ctx) GROUP BY ALL""", "dns"))
def trigram_logp(spark: SparkSession, sf: str) -> DataFrame:
    names = _labels(spark, sf)
    return ML.trigram_logp(names, ML.trigram_counts(names.withColumn("count", F.lit(1)), "label"), "label")


@query("SF-10", "JOIN-12", sql=A.oracle(_LABELS.replace("WITH ", "") + """
, ws AS (SELECT list(DISTINCT w) AS ws FROM (SELECT unnest(string_split(lower(p_name), ' ')) AS w FROM part) WHERE length(w) BETWEEN 3 AND 15), s AS (SELECT label, regexp_replace(label, '[^a-z]', '', 'g') AS s FROM labels_),
cv AS (SELECT DISTINCT s, CAST(0 AS BIGINT) AS i, [CAST(0 AS BIGINT)] AS best FROM s
UNION ALL SELECT s, i + 1, list_append(best, greatest(best[i + 1], coalesce(list_max(list_transform(list_filter(generate_series(3, least(15, i + 1)), lambda k: list_contains(ws, substr(s, i + 2 - k, k))), lambda k: best[i + 2 - k] + k)), 0))) FROM cv, ws WHERE i < length(s))
SELECT label, round(best[-1] / length(label), 6) AS coverage FROM s JOIN cv USING (s) WHERE i = length(s)""", "dns").replace("WITH ", "WITH RECURSIVE ", 1))
def word_coverage(spark: SparkSession, sf: str) -> DataFrame:
    words = A.table(spark, sf, "part").select(F.explode(F.split(F.lower("p_name"), " ")).alias("word")).distinct()
    return ML.word_coverage(_labels(spark, sf), words, "label").withColumn("coverage", F.round("coverage", 6))


@query("SF-12", sql=oracle("""SELECT flow_id, round(CASE WHEN bytes_in > 0 THEN least(bytes_out / bytes_in, 1000e0) WHEN bytes_out > 0 THEN 1000e0 ELSE 0e0 END, 6) AS byte_ratio,
round(CASE WHEN bytes_out + bytes_in > 0 THEN bytes_out / (bytes_out + bytes_in) ELSE 0e0 END, 6) AS outbound_share, round(CASE WHEN pkts > 0 THEN bytes_out / pkts ELSE 0e0 END, 6) AS avg_size FROM flows""", "flows"))
def ratio_features(spark: SparkSession, sf: str) -> DataFrame:
    f = A.flows(spark, sf)
    return f.select("flow_id", F.round(S.capped_ratio("bytes_out", "bytes_in"), 6).alias("byte_ratio"), F.round(S.guarded("bytes_out", F.col("bytes_out") + F.col("bytes_in")), 6).alias("outbound_share"), F.round(S.guarded("bytes_out", "pkts"), 6).alias("avg_size"))


@query("SF-18", sql=oracle("""SELECT flow_id, bytes_out + bytes_in AS total_bytes, round(CASE WHEN pkts > 0 THEN bytes_out / pkts ELSE 0e0 END, 6) AS bytes_rate, coalesce(TRY_CAST(dst_ip AS DOUBLE), -1) AS parsed FROM flows""", "flows"))
def volume_features(spark: SparkSession, sf: str) -> DataFrame:
    return A.flows(spark, sf).select("flow_id", (F.col("bytes_out") + F.col("bytes_in")).alias("total_bytes"), F.round(S.guarded("bytes_out", "pkts"), 6).alias("bytes_rate"), S.safe_double("dst_ip", -1.0).alias("parsed"))


@query("SF-22", sql=oracle("SELECT src_ip, count(*) FILTER (flags & 2 <> 0) AS syn, count(*) FILTER (flags & 16 <> 0) AS ack, count(*) FILTER (flags & 2 <> 0 AND flags & 16 = 0) AS bare_syn FROM flows GROUP BY ALL", "flows"))
def flag_counts(spark: SparkSession, sf: str) -> DataFrame:
    syn, ack = S.has_flag("flags", S.SYN), S.has_flag("flags", S.ACK)
    return A.flows(spark, sf).groupBy("src_ip").agg(F.count_if(syn).alias("syn"), F.count_if(ack).alias("ack"), F.count_if(syn & ~ack).alias("bare_syn"))


@query("SF-20", "SF-23", sql=oracle("SELECT concat_ws('|', proto, least(src_ip, dst_ip), greatest(src_ip, dst_ip)) AS flow_key, count(*) AS n FROM flows GROUP BY ALL", "flows"))
def canonical_flow_key(spark: SparkSession, sf: str) -> DataFrame:
    return A.flows(spark, sf).groupBy(F.concat_ws("|", F.col("proto").cast("string"), F.least("src_ip", "dst_ip"), F.greatest("src_ip", "dst_ip")).alias("flow_key")).agg(F.count("*").alias("n"))


_ADDRESSES = "(VALUES ('10.1.2.3'), ('172.16.0.1'), ('172.32.0.1'), ('192.168.3.4'), ('127.0.0.1'), ('169.254.9.9'), ('224.0.0.5'), ('0.1.2.3'), ('8.8.8.8'), ('192.0.2.7'), ('198.51.100.1'), ('203.0.113.9'), ('198.18.5.5'), ('240.0.0.1'), ('255.255.255.255'), ('1.2.3')) AS t(ip)"
_NUMBER = "CASE WHEN regexp_full_match(ip, '[0-9]+[.][0-9]+[.][0-9]+[.][0-9]+') THEN (CAST(split_part(ip, '.', 1) AS BIGINT) * 256 + CAST(split_part(ip, '.', 2) AS BIGINT)) * 65536 + CAST(split_part(ip, '.', 3) AS BIGINT) * 256 + CAST(split_part(ip, '.', 4) AS BIGINT) END"


def _ranges(ranges) -> str:
    return " OR ".join(f"n >> {32 - b} = {S._quad(ip) >> (32 - b)}" for ip, b in ranges)


def _addresses(spark: SparkSession, sf: str) -> DataFrame:
    own = A.flows(spark, sf).select(F.col("dst_ip").alias("ip")).distinct()
    return own.unionByName(spark.sql(f"SELECT ip FROM {_ADDRESSES}")).distinct()


@query("FIL-09", sql=oracle(f", a AS (SELECT ip, {_NUMBER} AS n FROM (SELECT dst_ip AS ip FROM flows UNION SELECT ip FROM {_ADDRESSES})) SELECT ip, CAST(n IS NULL OR {_ranges(S.INTERNAL_V4)} AS INTEGER) AS internal FROM a", "flows"))
def cidr_internal(spark: SparkSession, sf: str) -> DataFrame:
    return _addresses(spark, sf).select("ip", S.is_internal("ip").cast("int").alias("internal"))


@query("FIL-10", sql=oracle(f", a AS (SELECT ip, {_NUMBER} AS n FROM (SELECT dst_ip AS ip FROM flows UNION SELECT ip FROM {_ADDRESSES})) SELECT ip, CAST(n IS NOT NULL AND ({_ranges(S.PRIVATE_V4)}) AS INTEGER) AS private FROM a", "flows"))
def cidr_private(spark: SparkSession, sf: str) -> DataFrame:
    return _addresses(spark, sf).select("ip", S.is_private("ip").cast("int").alias("private"))


@query("SF-16", sql=oracle("SELECT CASE proto WHEN 6 THEN 'TCP' WHEN 17 THEN 'UDP' WHEN 1 THEN 'ICMP' ELSE CAST(proto AS VARCHAR) END AS protocol, count(*) AS n FROM packets GROUP BY ALL", "packets"))
def protocol_name(spark: SparkSession, sf: str) -> DataFrame:
    return A.packets(spark, sf).groupBy(S.protocol_name("proto").alias("protocol")).agg(F.count("*").alias("n"))


@query("PAR-08", "SF-19", sql="""SELECT p_partkey, md5(concat('771,', p_size, '-4865,', p_size, '-', p_partkey % 60, ',29-23,0')) AS ja3 FROM part""")
def ja3_hash(spark: SparkSession, sf: str) -> DataFrame:
    p = A.table(spark, sf, "part")
    lists = (F.array(F.lit(0x0A0A), F.col("p_size").cast("int"), F.lit(4865)), F.array(F.col("p_size").cast("int"), (F.col("p_partkey") % 60).cast("int")), F.array(F.lit(29), F.lit(23)), F.array(F.lit(0)))
    return p.select("p_partkey", S.ja3(F.lit(771), *lists)["md5"].alias("ja3"))


@query("PAR-09", sql="""SELECT p_partkey, concat('t13d0203h2_', substr(sha256(array_to_string(list_sort([printf('%04x', p_size), '1301']), ',')), 1, 12), '_',
substr(sha256(concat(array_to_string(list_sort(['000a', printf('%04x', 100 + p_partkey % 50)]), ','), '_0403')), 1, 12)) AS ja4 FROM part""")
def ja4_hash(spark: SparkSession, sf: str) -> DataFrame:
    p = A.table(spark, sf, "part")
    ciphers = F.array(F.lit(0x1A1A), F.col("p_size").cast("int"), F.lit(0x1301))
    exts = F.array(F.lit(0), F.lit(10), (F.col("p_partkey") % 50 + 100).cast("int"))
    return p.select("p_partkey", S.ja4(F.lit(0x0304), ciphers, exts, F.array(F.lit(0x0403)), F.lit("h2"), F.lit(True)).alias("ja4"))


def _alerts(spark: SparkSession, sf: str) -> DataFrame:
    f = A.flows(spark, sf)
    sev = F.when(F.col("pkts") == 1, "critical").when(F.col("pkts") == 2, " High").when(F.col("pkts") == 3, "bogus").otherwise("low")
    return f.select(F.when(F.col("flow_id") % 11 != 0, F.col("flow_id")).alias("alert_id"), sev.alias("severity"), F.when(F.col("flow_id") % 7 == 0, "x").otherwise((F.col("bytes_out") / 10000.0).cast("string")).alias("confidence"), F.col("proto").alias("protocol"), "src_ip", "dst_ip", "ts_us", F.when(F.col("dst_port") == 445, "scan").otherwise("beacon").alias("threat_class"))


_ALERTS = """, al AS (SELECT CASE WHEN flow_id % 11 <> 0 THEN flow_id END AS alert_id, CASE pkts WHEN 1 THEN 'critical' WHEN 2 THEN ' High' WHEN 3 THEN 'bogus' ELSE 'low' END AS severity,
CASE WHEN flow_id % 7 = 0 THEN NULL ELSE bytes_out / 10000e0 END AS confidence, proto, src_ip, dst_ip, ts_us, CASE WHEN dst_port = 445 THEN 'scan' ELSE 'beacon' END AS threat_class, alert_id IS NOT NULL AND pkts <> 3 AND flow_id % 7 <> 0 AS ok FROM flows)"""


@query("FIL-12", sql=oracle(_ALERTS + " SELECT alert_id, upper(trim(severity)) AS severity, round(least(1e0, greatest(0e0, confidence)), 6) AS confidence, CASE proto WHEN 6 THEN 'TCP' ELSE 'UDP' END AS protocol FROM al WHERE ok", "flows"))
def alert_validate(spark: SparkSession, sf: str) -> DataFrame:
    return AL.validate(_alerts(spark, sf))[0].select("alert_id", "severity", F.round("confidence", 6).alias("confidence"), "protocol")


@query("FIL-12", sql=oracle(_ALERTS + " SELECT threat_class, count(*) AS rejected FROM al WHERE NOT ok GROUP BY ALL", "flows"))
def alert_rejects(spark: SparkSession, sf: str) -> DataFrame:
    return AL.validate(_alerts(spark, sf))[1].groupBy("threat_class").agg(F.count("*").alias("rejected"))


@query("PRJ-04", sql=oracle(_ALERTS + " SELECT alert_id, CAST(ts_us AS VARCHAR) AS timestamp, upper(trim(severity)) AS severity, threat_class, round(least(1e0, greatest(0e0, confidence)), 6) AS confidence, src_ip, dst_ip, 443 AS dst_port, CASE proto WHEN 6 THEN 'TCP' ELSE 'UDP' END AS protocol, CAST(NULL AS VARCHAR) AS ioc_matched, 'FULL' AS path FROM al WHERE ok", "flows"))
def alert_flatten(spark: SparkSession, sf: str) -> DataFrame:
    a = AL.validate(_alerts(spark, sf))[0]
    nested = a.select(
        "alert_id", F.col("ts_us").cast("string").alias("timestamp"), "severity", "threat_class", F.round("confidence", 6).alias("confidence_score"),
        F.struct("src_ip", "dst_ip", F.lit(443).alias("dst_port"), "protocol").alias("flow_identifier"), F.struct(F.lit(None).cast("string").alias("ioc_matched")).alias("threat_intelligence"), F.struct(F.lit("FULL").alias("path_taken")).alias("system_telemetry"),
    )
    return AL.flatten(nested)


@query("SF-21", sql=oracle("SELECT flow_id, concat_ws('; ', CASE WHEN bytes_out > 10000 THEN concat('outbound ', bytes_out, ' bytes') END, CASE WHEN pkts > 5 THEN concat(pkts, ' packets') END) AS evidence FROM flows", "flows"))
def evidence_text(spark: SparkSession, sf: str) -> DataFrame:
    return A.flows(spark, sf).select("flow_id", AL.evidence((F.col("bytes_out") > 10000, "outbound %d bytes", "bytes_out"), (F.col("pkts") > 5, "%d packets", "pkts")).alias("evidence"))


_MATCH = """, x AS (SELECT flow_id, dst_ip AS value FROM flows WHERE dst_ip LIKE '45.%' UNION ALL SELECT flow_id, src_ip FROM flows WHERE src_ip LIKE '45.%'), m AS (SELECT flow_id, 'ip' AS kind, value, category, confidence FROM x JOIN iocs USING (value) WHERE kind = 'ip')"""


@query("JOIN-01", sql=oracle(_MATCH + " SELECT flow_id, kind, value, category, round(confidence, 6) AS confidence FROM m", "flows", "dns", "iocs"))
def ioc_ip_match(spark: SparkSession, sf: str) -> DataFrame:
    m = J.match(J.indicators(A.flows(spark, sf)), A.iocs(spark, sf))
    return m.select("flow_id", "kind", "value", "category", F.round("confidence", 6).alias("confidence"))


@query("JOIN-02", sql=oracle("""
, l AS (SELECT query_id, string_split(domain, '.') AS l FROM dns), c AS (SELECT query_id, i, array_to_string(l[i:], '.') AS value FROM (SELECT query_id, l, unnest(generate_series(1, least(len(l) - 1, 4))) AS i FROM l)),
j AS (SELECT query_id, i, value, category, confidence FROM c JOIN iocs USING (value) WHERE kind = 'domain')
SELECT query_id, arg_min(value, i) AS value, arg_min(category, i) AS category, arg_min(confidence, i) AS confidence FROM j GROUP BY ALL""", "flows", "dns", "iocs"))
def ioc_domain_suffix(spark: SparkSession, sf: str) -> DataFrame:
    return J.domain_match(A.dns(spark, sf), A.iocs(spark, sf))


@query("JOIN-03", sql=oracle("SELECT flow_id, 'ip' AS kind, dst_ip AS value FROM flows WHERE dst_ip LIKE '45.%'", "flows"))
def ioc_indicator_expand(spark: SparkSession, sf: str) -> DataFrame:
    return J.indicators(A.flows(spark, sf))


@query("DET-07", "TOP-06", sql=oracle(_MATCH + " SELECT flow_id, count(*) AS matches, max(confidence) AS confidence, CAST(max(confidence) >= 0.9e0 OR count(DISTINCT kind) >= 2 AS INTEGER) AS early_exit FROM m GROUP BY ALL", "flows", "dns", "iocs"))
def ti_verdict(spark: SparkSession, sf: str) -> DataFrame:
    return J.verdict(J.match(J.indicators(A.flows(spark, sf)), A.iocs(spark, sf)))


def _legs(spark: SparkSession, sf: str) -> DataFrame:
    """Flows between few hosts, so that reverse legs exist."""
    f = A.flows(spark, sf)
    return f.select("flow_id", "ts_us", (F.col("flow_id") * 7 % 12).cast("string").alias("src_ip"), (F.col("pkts") % 12).cast("string").alias("dst_ip"))


@query("JOIN-04", sql=oracle(f"""
, f AS (SELECT flow_id, ts_us, CAST(flow_id * 7 % 12 AS VARCHAR) AS src_ip, CAST(pkts % 12 AS VARCHAR) AS dst_ip FROM flows)
SELECT p.flow_id, min(r.ts_us) AS reply_us FROM f p JOIN f r ON p.src_ip = r.dst_ip AND p.dst_ip = r.src_ip AND r.ts_us BETWEEN p.ts_us AND p.ts_us + {6 * HOUR} AND r.flow_id <> p.flow_id GROUP BY ALL""", "flows"))
def reply_match(spark: SparkSession, sf: str) -> DataFrame:
    return J.replies(_legs(spark, sf), 6 * HOUR)


@query("JOIN-07", "DET-08", "STR-14", sql=oracle(f"""
, a AS (SELECT flow_id AS alert_id, ts_us, src_ip, dst_ip, (flow_id % 10) / 10e0 AS base FROM flows WHERE flow_id % 5 = 0),
h AS (SELECT flow_id AS hit_id, ts_us AS h_us, CASE flow_id % 3 WHEN 0 THEN concat(src_ip, '>', dst_ip) WHEN 1 THEN dst_ip ELSE src_ip END AS key FROM flows WHERE flow_id % 4 = 1),
k AS (SELECT *, unnest([0, 1, 2]) AS p, unnest([concat(src_ip, '>', dst_ip), dst_ip, src_ip]) AS key FROM a),
j AS (SELECT alert_id, k.key, row_number() OVER (PARTITION BY alert_id ORDER BY p, h_us DESC, hit_id) AS rn FROM k JOIN h ON k.key = h.key AND h_us <= ts_us AND ts_us < h_us + {DAY}),
c AS (SELECT a.alert_id, j.key, CASE WHEN j.key IS NOT NULL AND base >= 0.3e0 THEN greatest(base + 0.45e0 * (1 - base), 0.75e0) ELSE base END AS c FROM a LEFT JOIN j ON a.alert_id = j.alert_id AND rn = 1)
SELECT alert_id, round(c, 6) AS confidence, key AS ti_key, CASE WHEN c >= 0.92e0 THEN 'CRITICAL' WHEN c >= 0.75e0 THEN 'HIGH' WHEN c >= 0.55e0 THEN 'MEDIUM' ELSE 'LOW' END AS severity FROM c""", "flows"))
def fusion_boost(spark: SparkSession, sf: str) -> DataFrame:
    f = A.flows(spark, sf)
    alerts = f.where("flow_id % 5 = 0").select(F.col("flow_id").alias("alert_id"), "ts_us", "src_ip", "dst_ip", (F.col("flow_id") % 10 / 10.0).cast("double").alias("base"))
    key = F.when(F.col("flow_id") % 3 == 0, F.concat_ws(">", "src_ip", "dst_ip")).when(F.col("flow_id") % 3 == 1, F.col("dst_ip")).otherwise(F.col("src_ip"))
    hits = f.where("flow_id % 4 = 1").select(F.col("flow_id").alias("hit_id"), "ts_us", key.alias("key"), F.lit(0.9).alias("confidence"))
    return J.fuse(alerts, hits, DAY)


@query("JOIN-09", "FIL-04", sql=oracle("SELECT flow_id FROM flows WHERE dst_ip NOT IN (SELECT value FROM iocs WHERE kind = 'ip') AND dst_port NOT IN (53, 80)", "flows", "dns", "iocs"))
def allowlist_anti(spark: SparkSession, sf: str) -> DataFrame:
    return A.flows(spark, sf).where(~F.col("dst_port").isin(53, 80)).join(A.iocs(spark, sf).where("kind = 'ip'").select(F.col("value").alias("dst_ip")), "dst_ip", "left_anti").select("flow_id")


@query("AGG-24", "JOIN-11", "SET-07", sql=oracle("""
, f AS (SELECT DISTINCT src_ip, dst_ip FROM flows WHERE bytes_out > 9000), t AS (SELECT DISTINCT src_ip, dst_ip FROM flows WHERE pkts >= 6),
c AS (SELECT (SELECT count(*) FROM f SEMI JOIN t USING (src_ip, dst_ip)) AS tp, (SELECT count(*) FROM f ANTI JOIN t USING (src_ip, dst_ip)) AS fp, (SELECT count(*) FROM t ANTI JOIN f USING (src_ip, dst_ip)) AS fn)
SELECT tp, fp, fn, round(tp / greatest(tp + fp, 1), 6) AS precision, round(tp / greatest(tp + fn, 1), 6) AS recall FROM c""", "flows"))
def truth_eval(spark: SparkSession, sf: str) -> DataFrame:
    f = A.flows(spark, sf)
    return J.truth_counts(f.where("bytes_out > 9000"), f.where("pkts >= 6"), ["src_ip", "dst_ip"])


@query("SET-07", "SET-06", sql=oracle("SELECT src_ip, dst_ip FROM flows WHERE bytes_out > 9000 INTERSECT SELECT src_ip, dst_ip FROM flows WHERE pkts >= 6", "flows"))
def pair_set_ops(spark: SparkSession, sf: str) -> DataFrame:
    f = A.flows(spark, sf)
    return f.where("bytes_out > 9000").select("src_ip", "dst_ip").intersect(f.where("pkts >= 6").select("src_ip", "dst_ip"))


@query("SNK-07", sql=oracle("""
, r AS (SELECT CASE pkts WHEN 1 THEN 'url' ELSE 'ip' END AS kind, lower(trim(concat(' ', dst_ip, ' '))) AS value, flow_id AS seq, CASE WHEN dst_port = 445 THEN 'c2' ELSE 'scan' END AS category, bytes_out / 1e5 AS confidence FROM flows)
SELECT kind, value, arg_max(category, seq) AS category, round(arg_max(confidence, seq), 6) AS confidence, max(seq) AS seq FROM r WHERE kind = 'ip' GROUP BY ALL""", "flows"))
def ioc_upsert(spark: SparkSession, sf: str) -> DataFrame:
    f = A.flows(spark, sf)
    rows = f.select(F.when(F.col("pkts") == 1, "url").otherwise("ip").alias("kind"), F.concat(F.lit(" "), F.col("dst_ip"), F.lit(" ")).alias("value"), F.col("flow_id").alias("seq"), F.when(F.col("dst_port") == 445, "c2").otherwise("scan").alias("category"), (F.col("bytes_out") / 1e5).alias("confidence"))
    return J.upsert(rows).withColumn("confidence", F.round("confidence", 6))


@query("FIL-01", sql=oracle("""
, r AS (SELECT CASE pkts WHEN 1 THEN 'dns' WHEN 2 THEN 'tls_hello' WHEN 3 THEN 'window' WHEN 4 THEN 'flow_early' ELSE 'flow' END AS t FROM flows),
m(consumer, t) AS (VALUES ('ddos','window'),('ddos','flow'),('c2','flow'),('dga','dns'),('dns_tunnel','dns'),('dns_tunnel','window'),('tls','tls_hello'),('tls','flow_early'),('tls','flow'),('portscan','window'),('portscan','flow'),('exfil','flow'),('ti','flow'),('ti','dns'),('ti','tls_hello'))
SELECT consumer, r.t AS record_type, count(*) AS n FROM r JOIN m ON r.t = m.t GROUP BY ALL""", "flows"))
def record_routing(spark: SparkSession, sf: str) -> DataFrame:
    k = F.when(F.col("pkts") == 1, "dns").when(F.col("pkts") == 2, "tls_hello").when(F.col("pkts") == 3, "window").when(F.col("pkts") == 4, "flow_early").otherwise("flow")
    return AL.route(A.flows(spark, sf).select(k.alias("record_type"))).groupBy("consumer", "record_type").agg(F.count("*").alias("n"))


@query("AGG-15", sql=oracle(_ALERTS + " SELECT threat_class, upper(trim(severity)) AS severity, count(*) AS n FROM al WHERE ok GROUP BY ALL", "flows"))
def alerts_by_class_severity(spark: SparkSession, sf: str) -> DataFrame:
    return AL.rollup_classes(AL.validate(_alerts(spark, sf))[0])


@query("AGG-16", sql=oracle(_ALERTS + " SELECT count(*) AS total, count(*) FILTER (severity = 'critical') AS critical, round(count(*) FILTER (severity = 'critical') / count(*), 6) AS critical_share FROM al WHERE ok", "flows"))
def kpi_scalars(spark: SparkSession, sf: str) -> DataFrame:
    c = F.count_if(F.col("severity") == "CRITICAL")
    return AL.validate(_alerts(spark, sf))[0].agg(F.count("*").alias("total"), c.alias("critical"), F.round(c / F.count("*"), 6).alias("critical_share"))


@query("TOP-03", "TOP-04", "SNK-04", sql=oracle(_ALERTS + " SELECT alert_id, ts_us FROM al WHERE ok ORDER BY ts_us DESC, alert_id LIMIT 200", "flows"))
def latest_alerts(spark: SparkSession, sf: str) -> DataFrame:
    return J.latest(AL.validate(_alerts(spark, sf))[0].select("alert_id", "ts_us"), 200)


@query("TOP-02", sql=oracle("""
, c AS (SELECT src_ip, dst_ip, count(*) AS flows FROM flows GROUP BY ALL), r AS (SELECT *, row_number() OVER (PARTITION BY src_ip ORDER BY flows DESC, dst_ip) AS rank FROM c)
SELECT src_ip, dst_ip, flows, CAST(rank AS INTEGER) AS rank FROM r WHERE rank <= 3""", "flows"))
def top3_targets(spark: SparkSession, sf: str) -> DataFrame:
    return J.top_targets(A.flows(spark, sf))


@query("STR-10", sql=oracle(f"""
, o AS (SELECT dst_ip AS key, ts_us, CAST(regexp_extract(dst_ip, '([0-9]+)$', 1) AS INTEGER) % 7 = 0 AS listed, row_number() OVER (PARTITION BY dst_ip ORDER BY ts_us, flow_id) AS k FROM flows),
w AS (SELECT DISTINCT key, CAST(0 AS BIGINT) AS k, CAST(-1 AS BIGINT) AS until, 0 AS hits, 0 AS negative, 0 AS misses FROM o
UNION ALL SELECT o.key, o.k, CASE WHEN ts_us < until THEN until ELSE ts_us + CASE WHEN listed THEN {HOUR} ELSE 600000000 END END, hits + CAST(ts_us < until AND listed AS INTEGER), negative + CAST(ts_us < until AND NOT listed AS INTEGER), misses + CAST(ts_us >= until AS INTEGER)
  FROM w JOIN o ON o.key = w.key AND o.k = w.k + 1)
SELECT key, CAST(arg_max(hits, k) AS BIGINT) AS hits, CAST(arg_max(negative, k) AS BIGINT) AS negative, CAST(arg_max(misses, k) AS BIGINT) AS misses FROM w GROUP BY ALL""", "flows").replace("WITH ", "WITH RECURSIVE ", 1))
def cache_sim(spark: SparkSession, sf: str) -> DataFrame:
    f = A.flows(spark, sf).select(F.col("dst_ip").alias("key"), "ts_us", "flow_id", (F.regexp_extract("dst_ip", r"(\d+)$", 1).cast("int") % 7 == 0).alias("listed"))
    return J.cache_classes(f, HOUR, 10 * 60 * 1_000_000)


@query("AGG-14", sql="SELECT o.o_orderkey, CAST(coalesce(c.n, 0) AS BIGINT) AS freq FROM orders o LEFT JOIN (SELECT o_orderpriority, count(*) AS n FROM orders WHERE o_orderkey % 5 < 3 GROUP BY ALL) c USING (o_orderpriority)")
def freq_encoding(spark: SparkSession, sf: str) -> DataFrame:
    o = A.table(spark, sf, "orders")
    return ML.frequency_encode(o, o.where("o_orderkey % 5 < 3"), "o_orderpriority").select("o_orderkey", "freq")


def _eval(spark: SparkSession, sf: str) -> DataFrame:
    d = A.table(spark, sf, "documents").select("doc_id", "n_chars")
    return A.table(spark, sf, "labels").join(d, "doc_id").select("doc_id", F.col("quality").alias("y"), F.least(F.lit(1.0), F.col("n_chars") / 20000.0).cast("double").alias("score"))


_EVAL = "WITH e AS (SELECT doc_id, quality AS y, least(1e0, n_chars / 20000e0) AS score FROM labels JOIN documents USING (doc_id))"


@query("AGG-22", sql=_EVAL + ", c AS (SELECT count(*) FILTER (score >= 0.1e0 AND y = 1) AS tp, count(*) FILTER (score >= 0.1e0 AND y = 0) AS fp, count(*) FILTER (score < 0.1e0 AND y = 1) AS fn, count(*) FILTER (score < 0.1e0 AND y = 0) AS tn FROM e) SELECT *, round((tp + tn) / (tp + fp + fn + tn), 6) AS accuracy, round(2 * tp / greatest(2 * tp + fp + fn, 1), 6) AS f1 FROM c")
def confusion_metrics(spark: SparkSession, sf: str) -> DataFrame:
    return ML.confusion(_eval(spark, sf), 0.1)


@query("AGG-22", sql=_EVAL + ", r AS (SELECT y, rank() OVER (ORDER BY score) + (count(*) OVER (PARTITION BY score) - 1) / 2e0 AS r FROM e) SELECT round((sum(CASE WHEN y = 1 THEN r END) - count(*) FILTER (y = 1) * (count(*) FILTER (y = 1) + 1) / 2e0) / (count(*) FILTER (y = 1) * count(*) FILTER (y = 0)), 6) AS auc FROM r")
def roc_auc_rank(spark: SparkSession, sf: str) -> DataFrame:
    return ML.auc(_eval(spark, sf))


@query("AGG-23", sql=_EVAL + ", t AS (SELECT unnest(generate_series(10, 90)) AS t), c AS (SELECT t, count(*) FILTER (score >= t / 100e0 AND y = 1) AS tp, count(*) FILTER (score >= t / 100e0 AND y = 0) AS fp, count(*) FILTER (score < t / 100e0 AND y = 1) AS fn FROM e, t GROUP BY ALL) SELECT CAST(t AS INTEGER) AS threshold_pct, round(2 * tp / greatest(2 * tp + fp + fn, 1), 6) AS f1 FROM c ORDER BY 2 * tp / greatest(2 * tp + fp + fn, 1) DESC, t LIMIT 1")
def threshold_sweep(spark: SparkSession, sf: str) -> DataFrame:
    return ML.sweep(_eval(spark, sf))


@query("ML-03", "JOIN-10", sql="SELECT capture, label, CAST(CASE WHEN rn <= ceil(n * 0.6e0) THEN 0 WHEN rn <= ceil(n * 0.8e0) THEN 1 ELSE 2 END AS INTEGER) AS split FROM (SELECT capture, label, row_number() OVER (PARTITION BY label ORDER BY md5(CAST(capture AS VARCHAR))) AS rn, count(*) OVER (PARTITION BY label) AS n FROM (SELECT DISTINCT o_custkey AS capture, CAST(o_custkey % 2 AS INTEGER) AS label FROM orders))")
def capture_split(spark: SparkSession, sf: str) -> DataFrame:
    rows = A.table(spark, sf, "orders").select(F.col("o_custkey").alias("capture"), (F.col("o_custkey") % 2).cast("int").alias("label")).distinct()
    return ML.split_captures(rows)


@query("ML-01", "ML-05")
def rf_train_score(spark: SparkSession, sf: str) -> DataFrame:
    f = A.flows(spark, sf).withColumn("label", (F.col("dst_port") == 445).cast("int"))
    return ML.forest_scores(f, ["bytes_out", "bytes_in", "pkts", "flags", "src_port"], "label", "flow_id")


@query("FIL-13", "SET-06", sql="SELECT count(*) AS kept FROM (SELECT DISTINCT l_orderkey, l_linenumber, l_quantity FROM lineitem WHERE l_quantity IS NOT NULL AND NOT isinf(l_quantity))")
def clean_rows(spark: SparkSession, sf: str) -> DataFrame:
    li = A.table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity")
    return ML.clean(li).agg(F.count("*").alias("kept"))


@query("AGG-07", sql="WITH c AS (SELECT s_suppkey, ch, count(*) AS c FROM (SELECT s_suppkey, unnest(string_split(s_name, '')) AS ch FROM supplier) GROUP BY ALL) SELECT s_suppkey, round(log2(sum(c)) - sum(c * log2(c)) / sum(c), 5) AS entropy FROM c GROUP BY ALL")
def string_entropy(spark: SparkSession, sf: str) -> DataFrame:
    return A.table(spark, sf, "supplier").select("s_suppkey", F.round(S.char_entropy("s_name"), 5).alias("entropy"))


@query("SF-14", sql=oracle("""
, b AS (SELECT src_ip, avg(bytes_out) AS m, stddev_pop(bytes_out) AS s FROM flows GROUP BY ALL)
SELECT flow_id, round(CASE WHEN m > 0 THEN bytes_out / m ELSE 0e0 END, 6) AS outbound_ratio, round(CASE WHEN s > 0 THEN abs(bytes_out - m) / s ELSE 0e0 END, 5) AS deviation FROM flows JOIN b USING (src_ip)""", "flows"))
def baseline_features(spark: SparkSession, sf: str) -> DataFrame:
    f = A.flows(spark, sf)
    b = f.groupBy("src_ip").agg(F.avg("bytes_out").alias("m"), F.stddev_pop("bytes_out").alias("s"))
    return f.join(b, "src_ip").select("flow_id", F.round(S.guarded("bytes_out", "m"), 6).alias("outbound_ratio"), F.round(S.guarded(F.abs(F.col("bytes_out") - F.col("m")), "s"), 5).alias("deviation"))


@query("AGG-15", sql=oracle(_ALERTS + """
, p AS (SELECT 'c2' AS path FROM al WHERE ok AND threat_class = 'beacon' UNION ALL SELECT 'recon' FROM al WHERE ok AND threat_class = 'scan' UNION ALL SELECT 'ti' FROM al WHERE ok AND dst_ip LIKE '45.%')
SELECT path, count(*) AS n FROM p GROUP BY ALL""", "flows"))
def alerts_by_path(spark: SparkSession, sf: str) -> DataFrame:
    a = AL.validate(_alerts(spark, sf))[0]
    each = F.array_compact(F.array(F.when(F.col("dst_ip").startswith("45."), "ti"), F.when(F.col("threat_class") == "beacon", "c2").otherwise("recon")))
    return a.select(F.explode(each).alias("path")).groupBy("path").agg(F.count("*").alias("n"))


@query("TOP-07", sql=_EVAL + """, m AS (SELECT unnest(['low', 'middle', 'high']) AS model, unnest([0.05e0, 0.1e0, 0.2e0]) AS t),
c AS (SELECT model, count(*) FILTER (score >= t AND y = 1) AS tp, count(*) FILTER (score >= t AND y = 0) AS fp, count(*) FILTER (score < t AND y = 1) AS fn FROM e, m GROUP BY ALL)
SELECT model, round(2 * tp / greatest(2 * tp + fp + fn, 1), 6) AS f1, CAST(row_number() OVER (ORDER BY 2 * tp / greatest(2 * tp + fp + fn, 1) DESC, model) AS INTEGER) AS rank FROM c""")
def model_rank(spark: SparkSession, sf: str) -> DataFrame:
    e = _eval(spark, sf)
    all_models = [ML.confusion(e, t).select(F.lit(name).alias("model"), "f1") for name, t in (("low", 0.05), ("middle", 0.1), ("high", 0.2))]
    union = all_models[0].unionByName(all_models[1]).unionByName(all_models[2])
    return union.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("f1"), "model")))


@query("SF-26", "SF-15", sql=oracle("SELECT flow_id, md5(concat(src_ip, '|', dst_ip, '|', flow_id)) AS alert_key, strftime(make_timestamp(ts_us), '%Y-%m-%dT%H:%M:%S') AS at FROM flows", "flows"))
def alert_keys(spark: SparkSession, sf: str) -> DataFrame:
    at = F.date_format(F.expr("timestamp_ntz'1970-01-01 00:00:00' + make_dt_interval(0, 0, 0, ts_us div 1000000)"), "yyyy-MM-dd'T'HH:mm:ss")
    return A.flows(spark, sf).select("flow_id", F.md5(F.concat_ws("|", "src_ip", "dst_ip", F.col("flow_id").cast("string")).cast("binary")).alias("alert_key"), at.alias("at"))
