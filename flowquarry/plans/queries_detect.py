"""The detectors over their fixture views, each with an oracle written from the detector's formula."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..detectors import beacon, ddos, dga, recon, scores
from ..functions import scalars as S
from ..ml import tabular as ML
from ..operators import alerts as AL
from ..operators import joins as J
from ..operators.sliding import sliding_counts
from . import adapters as A
from . import fixtures as X
from .registry import query

HOUR, DAY = 3_600_000_000, 86_400_000_000
#: The exfiltration detector over the test flows: bursts of 20 kB in a day.
EXFIL = scores.ExfilConfig(burst_bytes=20_000, window_us=DAY)


def _ramp(x: str, low: float, high: float) -> str:
    return f"least(1e0, greatest(0e0, (({x}) - {low!r}e0) / ({high!r}e0 - {low!r}e0)))"


def _sent(view: str, key: str, order: str, us: int, rise: str = "") -> str:
    """CTE ``sent``: rows of view left by the cooldown: the fold keeps the last emitted row, and a row is emitted if the fold over the rows up to it ends with it."""
    again = f"x.t - a.t >= {us}" + (f" OR x.c >= a.c + {rise}" if rise else "")
    return f"""seqs AS (SELECT *, list({{'t': ts_us, 'c': conf, 'id': {order}}}) OVER (PARTITION BY {key} ORDER BY ts_us, {order} ROWS UNBOUNDED PRECEDING) AS l FROM {view}),
sent AS (SELECT * EXCLUDE (l) FROM seqs WHERE list_reduce(l, lambda a, x: CASE WHEN {again} THEN x ELSE a END).id = {order})"""


_EXFIL = f"""
, r AS (SELECT *, bytes_out / greatest(duration_us / 1e6, 1e0) AS rate FROM flows),
f AS (SELECT *, coalesce(avg(bytes_out) OVER w, 0) AS m, coalesce(stddev_pop(bytes_out) OVER w, 0) AS sd, coalesce(avg(rate) OVER w, 0) AS mr, row_number() OVER (PARTITION BY src_ip, dst_ip ORDER BY ts_us, flow_id) = 1 AS novel,
  count(*) FILTER (bytes_out >= 20000) OVER (PARTITION BY src_ip ORDER BY ts_us RANGE BETWEEN {DAY} PRECEDING AND CURRENT ROW) AS bursts
  FROM r WINDOW w AS (PARTITION BY src_ip ORDER BY ts_us, flow_id ROWS BETWEEN 30 PRECEDING AND 1 PRECEDING)),
g AS (SELECT *, CASE WHEN m > 0 THEN bytes_out / m ELSE 0e0 END AS ob, CASE WHEN bytes_in = 0 THEN 0e0 ELSE least(bytes_out / bytes_in, 1000e0) END AS br, CASE WHEN sd > 0 THEN abs(bytes_out - m) / sd ELSE 0e0 END AS dv, CASE WHEN mr > 0 THEN rate / mr ELSE 0e0 END AS rr FROM f),
s AS (SELECT *, CASE WHEN ob >= 10 THEN 30 ELSE 0 END + CASE WHEN br >= 20 THEN 20 ELSE 0 END + CASE WHEN dv >= 3 THEN 20 ELSE 0 END + CASE WHEN rr >= 5 THEN 15 ELSE 0 END + CASE WHEN bursts >= 2 THEN 15 ELSE 0 END
  + CASE WHEN novel AND dst_ip LIKE '45.%' THEN 10 ELSE 0 END AS score FROM g)"""


@query("DET-05", "SF-12", "SF-14", "WIN-01", "WIN-03", sql=A.oracle(_EXFIL + """
SELECT flow_id, src_ip, dst_ip, ts_us, score AS risk_score, CASE WHEN score >= 80 THEN 'CRITICAL' WHEN score >= 60 THEN 'HIGH' WHEN score >= 30 THEN 'MEDIUM' ELSE 'LOW' END AS severity, CAST(score >= 60 AS INTEGER) AS suspicious FROM s""", "flows"))
def exfil_detect(spark: SparkSession, sf: str) -> DataFrame:
    return scores.exfil(A.flows(spark, sf), EXFIL).drop("reasons")


@query("SF-21", sql=A.oracle(_EXFIL + """
SELECT flow_id, concat_ws('; ', CASE WHEN ob >= 10 THEN printf('outbound volume %d times the baseline', CAST(floor(ob) AS BIGINT)) END, CASE WHEN br >= 20 THEN printf('%d times as much sent as received', CAST(floor(br) AS BIGINT)) END, CASE WHEN dv >= 3 THEN printf('%d deviations from the baseline', CAST(floor(dv) AS BIGINT)) END,
  CASE WHEN rr >= 5 THEN printf('transfer rate %d times the baseline', CAST(floor(rr) AS BIGINT)) END, CASE WHEN bursts >= 2 THEN printf('%d large transfers in the window', bursts) END, CASE WHEN novel AND dst_ip LIKE '45.%' THEN '1 new external destination' END) AS reasons FROM s WHERE score >= 60""", "flows"))
def exfil_evidence(spark: SparkSession, sf: str) -> DataFrame:
    return scores.exfil(A.flows(spark, sf), EXFIL).where("suspicious = 1").select("flow_id", "reasons")


_TUNNEL = f"""
, q AS (SELECT query_id, ts_us, src_ip, qtype, string_split(regexp_replace(lower(trim(domain)), '[.]+$', ''), '.') AS l FROM tunnel_queries WHERE NOT is_response),
d AS (SELECT *, CASE WHEN array_to_string(l[-2:], '.') = 'co.uk' AND len(l) > 2 THEN 3 ELSE 2 END AS k FROM q), p AS (SELECT query_id, ts_us, src_ip, qtype, array_to_string(l[-k:], '.') AS registered, l[1:len(l) - k] AS sub FROM d),
pf AS (SELECT registered, src_ip, min((ts_us, query_id)) AS seen FROM p GROUP BY ALL), pn AS (SELECT registered, seen, row_number() OVER (PARTITION BY registered ORDER BY seen) AS nth FROM pf), pop AS (SELECT registered, seen FROM pn WHERE nth = 25),
b AS (SELECT *, list_reduce(list_concat([''], sub), lambda a, x: CASE WHEN length(x) > length(a) THEN x ELSE a END) AS label FROM p),
e AS (SELECT * FROM b WHERE length(label) >= 8 AND regexp_full_match(label, '[a-z0-9]+')),
ch AS (SELECT label, c, count(*) AS n FROM (SELECT label, unnest(string_split(label, '')) AS c FROM (SELECT DISTINCT label FROM e)) GROUP BY ALL), en AS (SELECT label, log2(sum(n)) - sum(n * log2(n)) / sum(n) AS h FROM ch GROUP BY ALL),
r AS (SELECT *, list({{'t': ts_us, 'label': label, 'h': h, 'txt': CASE WHEN qtype IN (16, 10) THEN 1e0 ELSE 0e0 END}}) OVER (PARTITION BY src_ip, registered ORDER BY ts_us, query_id ROWS 255 PRECEDING) AS ring FROM e JOIN en USING (label)),
x AS (SELECT * EXCLUDE (ring), list_filter(ring, lambda y: ts_us - y.t <= 120000000) AS x FROM r),
g AS (SELECT *, len(x) AS n, list_filter(list_transform(generate_series(2, len(x)), lambda i: (x[i].t - x[i - 1].t) / 1e6), lambda v: v > 0) AS gaps FROM x WHERE len(x) >= 8),
m AS (SELECT *, list_avg(gaps) AS gm, sqrt(list_avg(list_transform(gaps, lambda v: (v - list_avg(gaps)) * (v - list_avg(gaps))))) AS gs FROM g),
t AS (SELECT m.*, {_ramp("list_avg(list_transform(x, lambda y: length(y.label)))", 20.0, 50.0)} * 0.25e0 + {_ramp("list_avg(list_transform(x, lambda y: y.h))", 2.5, 3.8)} * 0.25e0 + {_ramp("len(list_distinct(list_transform(x, lambda y: y.label))) / n", 0.5, 0.95)} * 0.25e0
  + {_ramp("n / greatest((ts_us - x[1].t) / 1e6, 1e0)", 0.1, 5.0)} * 0.10e0 + CASE WHEN gm > 0 THEN greatest(0e0, 1 - gs / gm / 0.75e0) ELSE 0e0 END * 0.10e0 + list_avg(list_transform(x, lambda y: y.txt)) * 0.05e0 AS raw, pop.seen AS popular_at FROM m LEFT JOIN pop USING (registered)),
s AS (SELECT query_id, ts_us, src_ip, registered, n, round(least(1e0, raw * CASE WHEN popular_at IS NOT NULL AND (ts_us, query_id) >= popular_at THEN 0.6e0 ELSE 1e0 END), 4) AS conf FROM t)"""
_TUNNEL_LEVEL = "CASE WHEN conf >= 0.92e0 THEN 'CRITICAL' WHEN conf >= 0.8e0 THEN 'HIGH' ELSE 'MEDIUM' END AS severity"


@query("DET-04", "AGG-12", "WIN-06", "FIL-02", "FIL-06", "SF-03", sql=X.oracle(_TUNNEL + f" SELECT query_id, src_ip, registered, n, conf AS score, CAST(conf >= 0.65e0 AS INTEGER) AS alert, {_TUNNEL_LEVEL} FROM s", "tunnel_queries"))
def dns_tunnel_detect(spark: SparkSession, sf: str) -> DataFrame:
    return scores.tunnel_scores(X.tunnel_queries(spark, sf).where("not is_response")).drop("ts_us")


@query("DET-04", "SET-02", sql=X.oracle(_TUNNEL + ", a AS (SELECT * FROM s WHERE conf >= 0.65e0), " + _sent("a", "src_ip, registered", "query_id", 300_000_000, "0.1e0") + f" SELECT query_id, ts_us, src_ip, registered, n, conf AS score, {_TUNNEL_LEVEL} FROM sent", "tunnel_queries"))
def dns_tunnel_alerts(spark: SparkSession, sf: str) -> DataFrame:
    return scores.tunnel_alerts(X.tunnel_queries(spark, sf).where("not is_response"))


_RECON = """
, able AS (SELECT * FROM probes WHERE NOT (src_port > 0 AND src_port < 1024 AND dst_port >= 1024) AND NOT (proto = 6 AND flags <> 0 AND flags & 2 = 0)),
met AS (SELECT p.flow_id, r.flow_id AS rid, r.ts_us AS seen, r.proto = 6 AND r.flags & 4 <> 0 AND r.flags & 16 = 0 AS refused FROM able p JOIN probes r ON p.src_ip = r.dst_ip AND p.dst_ip = r.src_ip AND p.dst_port = r.src_port
  AND r.ts_us BETWEEN p.ts_us AND p.ts_us + 5000000 AND r.flow_id <> p.flow_id),
tries AS (SELECT a.*, (SELECT min(seen) FROM met WHERE met.flow_id = a.flow_id AND NOT refused) AS answered FROM able a WHERE flow_id NOT IN (SELECT rid FROM met)),
w AS (SELECT a.flow_id, a.ts_us, a.src_ip, a.dst_ip, b.dst_ip AS d, b.dst_port AS p, CASE WHEN b.answered <= a.ts_us THEN 1 ELSE 0 END AS ok FROM tries a JOIN tries b ON a.src_ip = b.src_ip AND b.ts_us BETWEEN a.ts_us - 5000000 AND a.ts_us),
per AS (SELECT flow_id, d, count(DISTINCT p) AS np FROM w GROUP BY ALL), top AS (SELECT flow_id, max(np) AS mp FROM per GROUP BY ALL),
m AS (SELECT flow_id, ts_us, src_ip, dst_ip, count(DISTINCT d) AS nd, count(DISTINCT p) AS up, count(*) AS tried, sum(ok) AS ok, any_value(mp) AS mp FROM w JOIN top USING (flow_id) GROUP BY ALL),
s AS (SELECT *, CASE WHEN nd >= 20 AND mp >= 20 THEN 'combined_scan' WHEN nd >= 20 THEN 'horizontal_scan' ELSE 'vertical_scan' END AS sub_type, round((tried - ok) / tried, 3) AS failed FROM m WHERE nd >= 20 OR mp >= 20),
c AS (SELECT *, round(least(1e0, 0.55e0 * least(1e0, greatest(CASE WHEN nd >= 20 THEN nd / 40e0 ELSE 0e0 END, CASE WHEN mp >= 20 THEN mp / 40e0 ELSE 0e0 END)) + 0.30e0 * failed + 0.15e0 * least(1e0, tried / 80e0)), 2) AS conf FROM s)"""


@query("JOIN-04", "FIL-07", "FIL-08", sql=X.oracle(_RECON + " SELECT flow_id, answered AS answered_us FROM tries", "probes"))
def recon_attempts(spark: SparkSession, sf: str) -> DataFrame:
    return recon.attempts(X.probes(spark, sf)).select("flow_id", "answered_us")


@query("WIN-05", "STR-07", sql=X.oracle(_RECON + " SELECT flow_id, CAST(nd AS BIGINT) AS unique_dst, CAST(up AS BIGINT) AS unique_ports, CAST(mp AS BIGINT) AS max_ports, CAST(tried AS BIGINT) AS attempts, CAST(ok AS BIGINT) AS answered FROM m", "probes"))
def recon_windows(spark: SparkSession, sf: str) -> DataFrame:
    return recon.recon_metrics(X.probes(spark, sf)).select("flow_id", "unique_dst", "unique_ports", "max_ports", "attempts", "answered")


@query("DET-06", "WIN-05", "JOIN-04", "FIL-07", "FIL-08", "SET-04", sql=X.oracle(_RECON + ", a AS (SELECT * FROM c WHERE conf >= 0.5e0), " + _sent("a", "src_ip, sub_type", "flow_id", 10_000_000) + """
SELECT flow_id, src_ip, ts_us, sub_type, conf AS confidence, CASE WHEN conf >= 0.9e0 THEN 'critical' WHEN conf >= 0.75e0 THEN 'high' WHEN conf >= 0.6e0 THEN 'medium' ELSE 'low' END AS severity FROM sent""", "probes"))
def recon_detect(spark: SparkSession, sf: str) -> DataFrame:
    return recon.recon(X.probes(spark, sf)).select("flow_id", "src_ip", "ts_us", "sub_type", "confidence", "severity")


@query("TOP-02", sql=X.oracle(_RECON + ", a AS (SELECT * FROM c WHERE conf >= 0.5e0), " + _sent("a", "src_ip, sub_type", "flow_id", 10_000_000) + """
, n AS (SELECT flow_id, d AS dst_ip, count(*) AS flows FROM w WHERE flow_id IN (SELECT flow_id FROM sent) GROUP BY ALL), k AS (SELECT *, row_number() OVER (PARTITION BY flow_id ORDER BY flows DESC, dst_ip) AS rank FROM n)
SELECT flow_id, dst_ip, flows, CAST(rank AS INTEGER) AS rank FROM k WHERE rank <= 3""", "probes"))
def recon_targets(spark: SparkSession, sf: str) -> DataFrame:
    f = X.probes(spark, sf)
    return recon.evidence_targets(recon.recon(f), f)


@query("TOP-09", sql=X.oracle(_RECON + " SELECT flow_id, CAST(nd AS BIGINT) AS unique_dst, CAST(tried AS BIGINT) AS attempts, CAST(mp AS BIGINT) AS max_ports FROM m WHERE src_ip = '10.0.0.3' ORDER BY ts_us DESC, flow_id DESC LIMIT 1", "probes"))
def recon_snapshot(spark: SparkSession, sf: str) -> DataFrame:
    return recon.snapshot_of(X.probes(spark, sf), "10.0.0.3").select("flow_id", "unique_dst", "attempts", "max_ports")


_SUB = f"""
, sub AS (SELECT bucket, dst_ip, pps, class_ratio, round(0.6e0 * round({_ramp('src_entropy', 3.0, 6.5)}, 4) + 0.4e0 * round({_ramp('unique_src', 5.0, 50.0)}, 4), 4) AS source,
round(0.4e0 * round({_ramp('syn_rate / greatest(1e0, syn_ack)', 1.5, 5.0)}, 4) + 0.35e0 * round({_ramp('syn_rate', 500.0, 2000.0)}, 4) + 0.25e0 * round({_ramp('syn_rate / greatest(1e0, pps)', 0.4, 0.7)}, 4), 4) AS tcp,
round(0.45e0 * round({_ramp('udp_rate', 1000.0, 3000.0)}, 4) + 0.35e0 * round({_ramp('udp_rate / greatest(1e0, pps)', 0.3, 0.75)}, 4) + 0.2e0 * round({_ramp('in_out', 1.5, 4.0)}, 4), 4) AS udp,
round(0.5e0 * least(1e0, burstiness) + 0.5e0 * greatest(0e0, 1 - least(1e0, std_iat)), 4) AS temporal FROM attack_windows)"""


@query("DET-01", "SF-11", sql=X.oracle(_SUB + " SELECT * FROM sub", "attack_windows"))
def ddos_subscores(spark: SparkSession, sf: str) -> DataFrame:
    return ddos.sub_scores(X.attack_windows(spark, sf))


_VERDICT = """
, o AS (SELECT *, row_number() OVER (PARTITION BY dst_ip ORDER BY bucket) AS k FROM sub),
walk AS (SELECT dst_ip, CAST(0 AS BIGINT) AS k, CAST(0 AS BIGINT) AS bucket, CAST([] AS DOUBLE[]) AS quiet, 0e0 AS state, 0 AS streak, 'NORMAL' AS kind, 0e0 AS score, 0e0 AS sure, 0e0 AS pps FROM (SELECT DISTINCT dst_ip FROM o)
UNION ALL SELECT dst_ip, k, bucket, CASE WHEN (kind <> 'NORMAL' AND score >= 0.45e0) OR rate >= 0.5e0 THEN quiet ELSE list_append(quiet, pps)[-30:] END, state, streak, kind, score,
  round(CASE kind WHEN 'SYN_FLOOD' THEN 0.6e0 * t2 + 0.4e0 * r2 WHEN 'UDP_REFLECTION_AMPLIFICATION' THEN 0.6e0 * u2 + 0.4e0 * r2 WHEN 'UDP_FLOOD' THEN 0.55e0 * u2 + 0.45e0 * r2 WHEN 'SPOOFED_SOURCE_FLOOD' THEN 0.55e0 * s2 + 0.45e0 * r2 WHEN 'SUSPICIOUS_FLOOD' THEN r2 ELSE 0e0 END, 2), pps FROM (
  SELECT *, round(0.9e0 * now + 0.1e0 * state, 2) AS score, CASE WHEN t2 >= 0.7e0 AND r2 >= 0.5e0 THEN 'SYN_FLOOD' WHEN u2 >= 0.7e0 AND r2 >= 0.5e0 THEN CASE WHEN class_ratio >= 4 THEN 'UDP_REFLECTION_AMPLIFICATION' ELSE 'UDP_FLOOD' END
    WHEN s2 >= 0.75e0 AND r2 >= 0.65e0 THEN 'SPOOFED_SOURCE_FLOOD' WHEN r2 >= 0.6e0 THEN 'SUSPICIOUS_FLOOD' ELSE 'NORMAL' END AS kind FROM (
  SELECT * EXCLUDE (streak, state), round(rate, 2) AS r2, round(source, 2) AS s2, round(tcp, 2) AS t2, round(udp, 2) AS u2, CASE WHEN now >= 0.45e0 THEN streak + 1 ELSE greatest(0, streak - 1) END AS streak,
    round(state * 0.35e0 + CASE WHEN now >= 0.45e0 THEN least(1e0, (streak + 1) / 3e0) ELSE 0e0 END * 0.65e0, 2) AS state FROM (
  SELECT *, 0.25e0 * rate + 0.2e0 * source + 0.2e0 * tcp + 0.15e0 * udp + 0.1e0 * temporal AS now FROM (
  SELECT o.dst_ip, o.k, o.bucket, o.pps, class_ratio, source, tcp, udp, temporal, quiet, state, streak, round(least(1e0, greatest(0e0, (round((o.pps - CASE WHEN len(quiet) >= 5 THEN list_avg(quiet) ELSE 1000e0 END) / greatest(CASE WHEN len(quiet) >= 5 THEN list_stddev_samp(quiet) ELSE 100e0 END, 1e0), 2) - 1.5e0) / 4.5e0)), 4) AS rate
  FROM walk JOIN o ON o.dst_ip = walk.dst_ip AND o.k = walk.k + 1))))),
v AS (SELECT *, CAST(kind <> 'NORMAL' AND score >= 0.45e0 AS INTEGER) AS detected FROM walk WHERE k > 0), z AS (SELECT *, CASE WHEN detected = 1 THEN round(least(1e0, 0.7e0 * sure + 0.3e0 * state), 2) ELSE 0e0 END AS conf FROM v)
SELECT bucket, dst_ip, CASE WHEN detected = 1 THEN kind ELSE 'NORMAL' END AS attack_class, detected, score, conf AS confidence, state AS persistence,
CASE WHEN kind = 'NORMAL' OR conf < 0.45e0 THEN 'LOW' WHEN conf >= 0.92e0 OR (conf >= 0.8e0 AND pps >= 50000) THEN 'CRITICAL' WHEN conf >= 0.82e0 THEN 'HIGH' WHEN conf >= 0.65e0 THEN 'MEDIUM' ELSE 'LOW' END AS severity FROM z"""


@query("DET-01", "WIN-02", "WIN-13", "STR-12", "STR-13", sql=X.oracle(_SUB + _VERDICT, "attack_windows", recursive=True))
def ddos_detect(spark: SparkSession, sf: str) -> DataFrame:
    return ddos.ddos(X.attack_windows(spark, sf))


@query("PRJ-02", sql=A.oracle(f"""
, i AS (SELECT ts_us // {HOUR} AS bucket, dst_ip, src_ip, count(*) AS n, count(*) FILTER (flags & 2 <> 0 AND flags & 16 = 0) AS syn, count(*) FILTER (proto = 17) AS udp FROM flows GROUP BY ALL)
SELECT bucket, dst_ip, round(sum(n) / 3600e0, 6) AS pps, count(*) AS unique_src, round(greatest(log2(sum(n)) - sum(n * log2(n)) / sum(n), 0), 6) AS src_entropy, round(sum(syn) / 3600e0, 9) AS syn_rate, round(sum(udp) / 3600e0, 9) AS udp_rate FROM i GROUP BY ALL HAVING sum(n) >= 2""", "flows"))
def ddos_window_features(spark: SparkSession, sf: str) -> DataFrame:
    from ..operators import windows as W

    f = ddos.features_of_windows(W.by_destination(A.flows(spark, sf).withColumn("bytes", F.col("bytes_out")), HOUR, least=2), 3600.0)
    return f.withColumns({"syn_rate": F.round("syn_rate", 9), "udp_rate": F.round("udp_rate", 9)})


_BEATS = """
, n AS (SELECT *, row_number() OVER w AS rn, list({'t': ts_us, 's': CAST(bytes_out AS DOUBLE)}) OVER (w ROWS 63 PRECEDING) AS ring FROM beats WINDOW w AS (PARTITION BY src_ip, dst_ip, dst_port, proto ORDER BY ts_us, flow_id)),
g AS (SELECT *, list_filter(list_transform(generate_series(2, len(ring)), lambda i: (ring[i].t - ring[i - 1].t) / 1e6), lambda v: v > 0.001e0) AS gaps, list_transform(ring, lambda x: x.s) AS sizes FROM n WHERE rn >= 8 AND (rn - 8) % 2 = 0),
m AS (SELECT *, list_median(gaps) AS med FROM g WHERE len(gaps) >= 7), k AS (SELECT *, 1.4826e0 * list_median(list_transform(gaps, lambda v: abs(v - med))) / med AS rcv,
  list_avg(list_transform(gaps, lambda v: CASE WHEN abs(v - greatest(1e0, round_even(v / med, 0)) * med) <= 0.25e0 * med THEN 1e0 ELSE 0e0 END)) AS cons, CASE WHEN list_avg(sizes) > 0 THEN list_stddev_pop(sizes) / list_avg(sizes) ELSE 1e0 END AS cv FROM m WHERE med BETWEEN 1 AND 21600),
fs AS (SELECT dst_ip, src_ip, min((ts_us, flow_id)) AS seen FROM beats GROUP BY ALL),
u AS (SELECT k.flow_id, least(count(*), 100) AS n_src FROM k JOIN fs ON k.dst_ip = fs.dst_ip AND fs.seen <= (k.ts_us, k.flow_id) GROUP BY ALL),
c AS (SELECT k.* EXCLUDE (ring), n_src, len(sizes) AS cnt, least(1e0, (0.35e0 * greatest(0e0, 1 - rcv / 0.4e0) + 0.30e0 * cons + 0.15e0 * greatest(0e0, 1 - cv / 0.5e0) + 0.10e0 * least(1e0, len(sizes) / 20e0) + 0.10e0 * least(1e0, greatest(0e0, 1 - (n_src - 1) / 24e0)))
  * CASE WHEN cons < 0.6e0 THEN 0.5e0 ELSE 1e0 END * CASE WHEN n_src >= 25 THEN 0.6e0 ELSE 1e0 END) AS conf FROM k JOIN u USING (flow_id))"""


@query("AGG-10", "FIL-14", "WIN-08", "WIN-10", "WIN-12", "AGG-19", "JOIN-08", sql=X.oracle(_BEATS + " SELECT flow_id, cnt AS n, round(med, 3) AS period_s, round(rcv, 4) AS robust_cv, round(cons, 3) AS consistency, round(cv, 4) AS size_cv, CAST(n_src AS INTEGER) AS n_src, round(conf, 4) AS confidence FROM c", "beats"))
def c2_evaluations(spark: SparkSession, sf: str) -> DataFrame:
    s = beacon.scored(X.beats(spark, sf))
    return s.select("flow_id", "n", F.round("med", 3).alias("period_s"), F.round("rcv", 4).alias("robust_cv"), F.round("consistency", 3).alias("consistency"), F.round("size_cv", 4).alias("size_cv"), "n_src", F.round("confidence", 4).alias("confidence"))


@query("DET-02", "SET-01", sql=X.oracle(_BEATS + ", a AS (SELECT * FROM c WHERE conf >= 0.6e0), " + _sent("a", "src_ip, dst_ip, dst_port, proto", "flow_id", 300_000_000, "0.1e0") + """
SELECT flow_id, src_ip, dst_ip, dst_port, proto, cnt AS n, round(med, 3) AS period_s, round(rcv, 4) AS robust_cv, round(cons, 3) AS consistency, round(cv, 4) AS size_cv, CAST(n_src AS INTEGER) AS n_src, round(conf, 4) AS confidence, CASE WHEN conf >= 0.9e0 THEN 'HIGH' WHEN conf >= 0.75e0 THEN 'MEDIUM' ELSE 'LOW' END AS severity FROM sent""", "beats"))
def c2_detect(spark: SparkSession, sf: str) -> DataFrame:
    return beacon.beacons(X.beats(spark, sf))


@query("FIL-04", sql=X.oracle(", b AS (SELECT * FROM beats WHERE dst_ip NOT IN ('203.0.113.9') AND dst_port NOT IN (123)), r AS (SELECT flow_id, row_number() OVER (PARTITION BY src_ip, dst_ip, dst_port, proto ORDER BY ts_us, flow_id) AS rn FROM b) SELECT src_ip, count(*) AS n FROM r JOIN b USING (flow_id) WHERE rn = 8 GROUP BY ALL", "beats"))
def c2_allowlists(spark: SparkSession, sf: str) -> DataFrame:
    cfg = beacon.BeaconConfig(ring=8, every=10**9, least_median=0.0, most_median=1e12, allowed_ips=("203.0.113.9",), allowed_ports=(123,))
    return beacon.evaluations(X.beats(spark, sf), cfg).groupBy("src_ip").agg(F.count("*").alias("n"))


def _words(spark: SparkSession, sf: str) -> DataFrame:
    return A.table(spark, sf, "part").select(F.explode(F.split(F.lower("p_name"), " ")).alias("word")).where("word <> ''")


def _dga_scores(spark: SparkSession, sf: str) -> DataFrame:
    words = _words(spark, sf).groupBy("word").agg(F.count("*").alias("count"))
    names = dga.eligible(X.dga_queries(spark, sf)).select("label").distinct()
    return dga.score_domains(names, ML.trigram_counts(words, "word"), words.select("word"))


_NAMES = """
, q AS (SELECT query_id, ts_us, src_ip, regexp_replace(lower(trim(domain)), '[.]+$', '') AS name FROM dga_queries), l AS (SELECT *, string_split(name, '.') AS l FROM q), k AS (SELECT *, CASE WHEN array_to_string(l[-2:], '.') = 'co.uk' AND len(l) > 2 THEN 3 ELSE 2 END AS k FROM l),
p AS (SELECT query_id, ts_us, src_ip, name, l[-k] AS label, array_to_string(l[-k:], '.') AS registered FROM k),
el AS (SELECT * FROM p WHERE NOT contains(name, '_') AND registered NOT IN ('google.com') AND length(label) >= 7 AND NOT starts_with(label, 'xn--') AND NOT suffix(name, '.local')), nm AS (SELECT DISTINCT label FROM el)"""
_LEX = """
, ch AS (SELECT label, c, count(*) AS n FROM (SELECT label, unnest(string_split(label, '')) AS c FROM nm) GROUP BY ALL), en AS (SELECT label, log2(sum(n)) - sum(n * log2(n)) / sum(n) AS h, count(*) AS kinds FROM ch GROUP BY ALL),
lx AS (SELECT label, length(label) AS n, coalesce(list_max(list_transform(regexp_extract_all(label, '[bcdfghjklmnpqrstvwxyz]+'), lambda x: length(x))), 0) AS run, coalesce(list_max(list_transform(regexp_extract_all(label, '[0-9]+'), lambda x: length(x))), 0) AS drun, h, kinds / length(label) AS uniq,
  length(regexp_replace(label, '[^0-9]', '', 'g')) / length(label) AS d, length(regexp_replace(label, '[^-]', '', 'g')) AS hy, CAST(regexp_matches(label, '^[0-9a-f]{12,}$') AS INTEGER) AS hx,
  length(regexp_replace(regexp_replace(label, '[^0-9]+', 'a', 'g'), '[0-9]+', '0', 'g')) AS turned FROM nm JOIN en USING (label))"""


@query("SF-06", "SF-07", "SF-08", sql=X.oracle(_NAMES + _LEX + " SELECT label, CAST(n AS INTEGER) AS length, CAST(run AS INTEGER) AS max_consonant_run, CAST(drun AS INTEGER) AS max_digit_run, round(h, 6) AS entropy, round(d, 6) AS digit_ratio, CAST(turned - 1 AS INTEGER) AS switches, CAST(hy AS INTEGER) AS hyphens, round(uniq, 6) AS unique_ratio, hx AS hex_like FROM lx", "dga_queries"))
def dga_lexical(spark: SparkSession, sf: str) -> DataFrame:
    f = dga.lexical(dga.eligible(X.dga_queries(spark, sf)).select("label").distinct())
    return f.withColumns({c: F.round(c, 6) for c in ("entropy", "digit_ratio", "unique_ratio")})


@query("FIL-05", "SF-02", "SF-03", sql=X.oracle(_NAMES + " SELECT query_id, registered, label FROM el", "dga_queries"))
def dga_eligible(spark: SparkSession, sf: str) -> DataFrame:
    return dga.eligible(X.dga_queries(spark, sf)).select("query_id", "registered", "label")


_SCORE = f"""
, wd AS (SELECT w AS word, count(*) AS cnt FROM (SELECT unnest(string_split(lower(p_name), ' ')) AS w FROM part) WHERE w <> '' GROUP BY ALL),
tg AS (SELECT concat('^^', word, '$') AS w, cnt, unnest(generate_series(3, length(word) + 3)) AS i FROM wd), lm AS (SELECT substr(w, i - 2, 2) AS ctx, substr(w, i, 1) AS c, sum(ln(1e0 + cnt)) AS n FROM tg GROUP BY ALL), lt AS (SELECT ctx, sum(n) AS tot FROM lm GROUP BY ALL),
ng AS (SELECT label, concat('^^', label, '$') AS w, unnest(generate_series(3, length(label) + 3)) AS i FROM nm), lp AS (SELECT label, avg(ln((coalesce(lm.n, 0) + 0.05e0) / (coalesce(lt.tot, 0) + 1.9e0))) AS lp FROM (SELECT label, substr(w, i - 2, 2) AS ctx, substr(w, i, 1) AS c FROM ng) LEFT JOIN lm USING (ctx, c) LEFT JOIN lt USING (ctx) GROUP BY ALL),
ws AS (SELECT list(word) AS ws FROM wd WHERE length(word) BETWEEN 3 AND 15),
cv AS (SELECT label, CAST(0 AS BIGINT) AS i, [CAST(0 AS BIGINT)] AS best, ws FROM (SELECT DISTINCT regexp_replace(label, '[^a-z]', '', 'g') AS label FROM nm), ws UNION ALL SELECT label, i + 1, list_append(best, greatest(best[i + 1], coalesce(list_max(list_transform(list_filter(generate_series(3, least(15, i + 1)), lambda k: list_contains(ws, substr(label, i + 2 - k, k))), lambda k: best[i + 2 - k] + k)), 0))), ws FROM cv WHERE i < length(label)),
co AS (SELECT nm.label, cv.best[-1] / length(nm.label) AS cov FROM nm JOIN cv ON cv.label = regexp_replace(nm.label, '[^a-z]', '', 'g') AND i = length(cv.label)),
tm AS (SELECT label, n, round(0.35e0 * {_ramp('-lp', 2.4, 3.3)}, 3) AS trigram_logp, round(0.25e0 * (1 - {_ramp('cov', 0.0, 0.85)}), 3) AS word_coverage, round(0.15e0 * {_ramp('run', 3.0, 6.0)}, 3) AS max_consonant_run, round(0.10e0 * {_ramp('h', 3.0, 3.9)}, 3) AS entropy,
  round(0.15e0 * {_ramp('n', 8.0, 14.0)}, 3) AS length, round(0.15e0 * {_ramp('d', 0.1, 0.4)}, 3) AS digit_ratio, round(0.10e0 * hx, 3) AS hex_like FROM lx JOIN lp USING (label) JOIN co USING (label)),
sc AS (SELECT * EXCLUDE (n), round(least(1e0, (trigram_logp + word_coverage + max_consonant_run + entropy + length + digit_ratio + hex_like) * least(1e0, n / 10e0)), 3) AS score FROM tm)"""
_DGA = """
, cf AS (SELECT query_id, ts_us, src_ip, registered, score, least(1e0, count(DISTINCT CASE WHEN score >= 0.6e0 THEN registered END) OVER (PARTITION BY src_ip ORDER BY ts_us RANGE BETWEEN 60000000 PRECEDING AND CURRENT ROW) / 5e0) AS burst FROM el JOIN sc USING (label)),
al AS (SELECT *, round(least(1e0, 0.7e0 * score + 0.3e0 * burst), 2) AS conf FROM cf), rk AS (SELECT *, CASE WHEN conf >= 0.92e0 THEN 3 WHEN conf >= 0.8e0 THEN 2 WHEN conf >= 0.68e0 THEN 1 ELSE 0 END AS rk, row_number() OVER (PARTITION BY src_ip ORDER BY ts_us, query_id) AS k FROM al WHERE conf >= 0.6e0),
wk AS (SELECT DISTINCT src_ip, CAST(0 AS BIGINT) AS k, CAST([] AS STRUCT(name VARCHAR, till BIGINT)[]) AS held, CAST(0 AS BIGINT) AS until, -1 AS rank, CAST(NULL AS BIGINT) AS query_id FROM rk
UNION ALL SELECT src_ip, k, CASE WHEN ok THEN list_append(held, {'name': registered, 'till': ts_us + 300000000}) ELSE held END, CASE WHEN ok THEN ts_us + 10000000 ELSE until END, CASE WHEN ok THEN rk ELSE rank END, CASE WHEN ok THEN query_id END FROM (
  SELECT rk.*, wk.held, wk.until, wk.rank, len(list_filter(wk.held, lambda x: x.name = rk.registered AND x.till > rk.ts_us)) = 0 AND NOT (wk.until > rk.ts_us AND rk.rk <= wk.rank) AS ok FROM wk JOIN rk ON rk.src_ip = wk.src_ip AND rk.k = wk.k + 1))
SELECT query_id, src_ip, registered, ts_us, score, round(burst, 6) AS burst, conf AS confidence, ['LOW', 'MEDIUM', 'HIGH', 'CRITICAL'][rk + 1] AS severity FROM rk WHERE query_id IN (SELECT query_id FROM wk WHERE query_id IS NOT NULL)"""



@query("WIN-07", sql=X.oracle("SELECT query_id, count(DISTINCT CASE WHEN starts_with(domain, 'blue') THEN domain END) OVER (PARTITION BY src_ip ORDER BY ts_us RANGE BETWEEN 60000000 PRECEDING AND CURRENT ROW) AS names FROM dga_queries", "dga_queries"))
def burst_names(spark: SparkSession, sf: str) -> DataFrame:
    q = X.dga_queries(spark, sf)
    marked = q.where(F.col("domain").startswith("blue")).select("src_ip", "ts_us", "domain")
    return sliding_counts(marked, ["src_ip"], 60_000_000, {"names": ["domain"]}, probes=q.select("query_id", "src_ip", "ts_us")).select("query_id", "names")


@query("DET-03", "SF-09", "SF-10", "SF-11", "JOIN-12", sql=X.oracle(_NAMES + _LEX + _SCORE + " SELECT * FROM sc", "dga_queries", recursive=True))
def dga_score_terms(spark: SparkSession, sf: str) -> DataFrame:
    s = _dga_scores(spark, sf)
    return s.select("label", *[F.col(f"terms.{t}").alias(t) for t in dga.TERMS], "score")


@query("DET-03", "SET-03", "FIL-05", "WIN-07", sql=X.oracle(_NAMES + _LEX + _SCORE + _DGA, "dga_queries", recursive=True))
def dga_detect(spark: SparkSession, sf: str) -> DataFrame:
    words = _words(spark, sf).groupBy("word").agg(F.count("*").alias("count"))
    return dga.dga(X.dga_queries(spark, sf), ML.trigram_counts(words, "word"), words.select("word")).withColumn("burst", F.round("burst", 6))


_TI = """
, lk AS (SELECT record_id, 'domain' AS kind, d, 10 + i AS pos, string_split(lower(d), '.') AS l, i FROM (SELECT record_id, CASE record_type WHEN 'dns' THEN domain ELSE sni END AS d, unnest([1, 2, 3, 4]) AS i FROM records WHERE record_type IN ('dns', 'tls_hello', 'flow_early', 'flow')) WHERE d IS NOT NULL),
ex AS (SELECT record_id, 10 + i AS pos, kind, array_to_string(l[i:], '.') AS value FROM lk WHERE i <= len(l) - 1 UNION ALL SELECT record_id, 1, 'ja3', ja3 FROM records WHERE ja3 IS NOT NULL UNION ALL SELECT record_id, 2, 'ja4', ja4 FROM records WHERE ja4 IS NOT NULL
  UNION ALL SELECT record_id, 20, 'ip', dst_ip FROM records WHERE record_type IN ('tls_hello', 'flow') AND dst_ip LIKE '45.%')"""
_TI_V = _TI + """
, hit AS (SELECT ex.*, category, confidence FROM ex LEFT JOIN record_iocs USING (kind, value)),
v AS (SELECT record_id, count(*) AS lookups, count(confidence) AS matches, max(confidence) AS top, count(DISTINCT CASE WHEN confidence IS NOT NULL THEN kind END) AS kinds, arg_min({'kind': kind, 'value': value, 'category': category}, (-confidence, pos)) FILTER (confidence IS NOT NULL) AS best,
  array_to_string(list_sort(list_distinct(list(concat(kind, ':', value)) FILTER (confidence IS NOT NULL))), ',') AS indicators FROM hit GROUP BY ALL HAVING count(confidence) > 0),
vv AS (SELECT record_id, lookups, matches, top AS confidence, CAST(top >= 0.9e0 OR kinds >= 2 AS INTEGER) AS early_exit, best.kind AS ioc_kind, best.value AS ioc_matched, best.category AS ioc_category, indicators FROM v)"""


@query("JOIN-02", "JOIN-03", sql=X.oracle(_TI + " SELECT record_id, kind, value FROM ex", "records"))
def ti_record_indicators(spark: SparkSession, sf: str) -> DataFrame:
    return J.record_indicators(X.records(spark, sf)).drop("pos")


@query("DET-07", "JOIN-01", "TOP-06", sql=X.oracle(_TI_V + " SELECT record_id, lookups, matches, round(confidence, 6) AS confidence, early_exit, ioc_kind, ioc_matched, ioc_category, indicators FROM vv", "records"))
def ti_record_verdict(spark: SparkSession, sf: str) -> DataFrame:
    return J.record_verdicts(X.records(spark, sf), X.record_iocs(spark)).withColumn("confidence", F.round("confidence", 6))


@query("DET-08", "SET-05", sql=X.oracle(_TI_V + ", a AS (SELECT r.record_id, r.ts_us, r.src_ip, r.dst_ip, indicators, ioc_matched, greatest(confidence, 0.95e0) AS conf FROM vv JOIN records r USING (record_id) WHERE early_exit = 1), " + _sent("a", "src_ip, dst_ip, indicators", "record_id", 60_000_000) + " SELECT record_id, ts_us, src_ip, dst_ip, round(conf, 2) AS confidence, ioc_matched, indicators, 'CRITICAL' AS severity FROM sent", "records"))
def ti_early_exit(spark: SparkSession, sf: str) -> DataFrame:
    r = X.records(spark, sf)
    return J.observe(r, J.record_verdicts(r, X.record_iocs(spark)))


@query("DET-08", "JOIN-07", "STR-14", sql=X.oracle(_TI_V + """
, h AS (SELECT record_id AS hit_id, ts_us AS h_us, unnest(list_distinct(list_filter([concat(src_ip, '>', dst_ip), CASE WHEN dst_ip LIKE '45.%' THEN dst_ip END, CASE WHEN record_type IN ('dns', 'tls_hello') THEN src_ip END], lambda x: x IS NOT NULL))) AS key FROM vv JOIN records USING (record_id)),
al AS (SELECT record_id AS alert_id, ts_us, src_ip, dst_ip, (record_id % 10) / 10e0 AS base FROM records WHERE record_type = 'window'), kk AS (SELECT *, unnest([0, 1, 2]) AS p, unnest([concat(src_ip, '>', dst_ip), dst_ip, src_ip]) AS key FROM al),
j AS (SELECT alert_id, kk.key, row_number() OVER (PARTITION BY alert_id ORDER BY p, h_us DESC, hit_id) AS rn FROM kk JOIN h ON kk.key = h.key AND h_us <= ts_us AND ts_us < h_us + 60000000),
c AS (SELECT al.alert_id, j.key, CASE WHEN j.key IS NOT NULL AND base >= 0.3e0 THEN greatest(base + 0.45e0 * (1 - base), 0.75e0) ELSE base END AS c FROM al LEFT JOIN j ON al.alert_id = j.alert_id AND rn = 1)
SELECT alert_id, round(c, 6) AS confidence, key AS ti_key, CASE WHEN c >= 0.92e0 THEN 'CRITICAL' WHEN c >= 0.75e0 THEN 'HIGH' WHEN c >= 0.55e0 THEN 'MEDIUM' ELSE 'LOW' END AS severity FROM c""", "records"))
def ti_fused_alerts(spark: SparkSession, sf: str) -> DataFrame:
    r = X.records(spark, sf)
    alerts = r.where("record_type = 'window'").select(F.col("record_id").alias("alert_id"), "ts_us", "src_ip", "dst_ip", (F.col("record_id") % 10 / 10.0).cast("double").alias("base"))
    return J.fuse(alerts, J.memory_keys(r, J.record_verdicts(r, X.record_iocs(spark))), 60_000_000)


@query("JOIN-01", sql=X.oracle(" SELECT kind, category, count(*) AS n, round(avg(confidence), 6) AS mean_confidence FROM record_iocs GROUP BY ALL", "records"))
def ti_store_counts(spark: SparkSession, sf: str) -> DataFrame:
    return J.store_counts(X.record_iocs(spark))


@query("SET-04", "SET-01", sql=A.oracle(_EXFIL + ", a AS (SELECT flow_id, src_ip, ts_us, score / 110e0 AS conf FROM s WHERE score >= 30), " + _sent("a", "src_ip", "flow_id", DAY, "0.1e0") + " SELECT flow_id, src_ip, ts_us, round(conf, 6) AS confidence FROM sent", "flows"))
def dedupe_cooldown(spark: SparkSession, sf: str) -> DataFrame:
    a = scores.exfil(A.flows(spark, sf), EXFIL).withColumn("confidence", F.col("risk_score") / 110.0).where("risk_score >= 30")
    return AL.cooldown(a.select("flow_id", "src_ip", "ts_us", "confidence"), ["src_ip"], DAY, 0.1).withColumn("confidence", F.round("confidence", 6))
