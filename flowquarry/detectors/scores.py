"""Exfiltration and DNS-tunnel scores as expressions over feature columns."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import capped_ratio, char_entropy, domain_parts, guarded, is_private, normal_domain, ramp, severity
from ..operators.alerts import cooldown, evidence
from ..operators.history import baseline
from ..operators.sliding import sliding_counts


@dataclass(frozen=True)
class ExfilConfig:
    """Thresholds and weights of the exfiltration score; the weights sum to 110."""

    baseline_ratio: tuple[float, int] = (10.0, 30)
    byte_ratio: tuple[float, int] = (20.0, 20)
    deviation: tuple[float, int] = (3.0, 20)
    rate_ratio: tuple[float, int] = (5.0, 15)
    burst: tuple[int, int] = (2, 15)
    new_external: int = 10
    burst_bytes: int = 10 * 1024 * 1024
    window_us: int = 300_000_000
    detect: int = 60


def exfil_features(flows: DataFrame, cfg: ExfilConfig = ExfilConfig()) -> DataFrame:
    """Features of each flow against its source's previous thirty and the bursts of its last window; half-duplex flows
    have no byte ratio, and a source without history no baseline."""
    seconds = F.greatest(F.col("duration_us") / 1e6, F.lit(1.0))
    f = baseline(flows.withColumn("rate", F.col("bytes_out") / seconds))
    mean, std, rate = (F.coalesce(c, F.lit(0.0)) for c in ("base_mean", "base_std", "base_rate"))
    f = f.withColumns({
        "outbound_vs_baseline": guarded("bytes_out", mean), "byte_ratio": F.when(F.col("bytes_in") == 0, 0.0).otherwise(capped_ratio("bytes_out", "bytes_in")),
        "deviation": guarded(F.abs(F.col("bytes_out") - mean), std), "rate_vs_baseline": guarded("rate", rate), "external": (~is_private("dst_ip")).cast("int"),
    })
    big = f.where(F.col("bytes_out") >= cfg.burst_bytes).select("src_ip", "ts_us", "flow_id")
    return sliding_counts(big, ["src_ip"], cfg.window_us, {"burst_count": ["flow_id"]}, probes=f)


def exfil(flows: DataFrame, cfg: ExfilConfig = ExfilConfig()) -> DataFrame:
    """Risk score, severity and reasons of each flow."""
    f = exfil_features(flows, cfg)
    hit = {
        "outbound_vs_baseline": F.col("outbound_vs_baseline") >= cfg.baseline_ratio[0], "byte_ratio": F.col("byte_ratio") >= cfg.byte_ratio[0], "deviation": F.col("deviation") >= cfg.deviation[0],
        "rate_vs_baseline": F.col("rate_vs_baseline") >= cfg.rate_ratio[0], "burst_count": F.col("burst_count") >= cfg.burst[0], "novel": (F.col("novel") == 1) & (F.col("external") == 1),
    }
    points = dict(zip(hit, (cfg.baseline_ratio[1], cfg.byte_ratio[1], cfg.deviation[1], cfg.rate_ratio[1], cfg.burst[1], cfg.new_external), strict=True))
    score = sum((F.when(c, points[k]).otherwise(0) for k, c in hit.items()), F.lit(0))
    level = F.when(score >= 80, "CRITICAL").when(score >= 60, "HIGH").when(score >= 30, "MEDIUM").otherwise("LOW")
    texts = {"outbound_vs_baseline": "outbound volume %d times the baseline", "byte_ratio": "%d times as much sent as received", "deviation": "%d deviations from the baseline", "rate_vs_baseline": "transfer rate %d times the baseline", "burst_count": "%d large transfers in the window", "novel": "%d new external destination"}
    return f.select("flow_id", "src_ip", "dst_ip", "ts_us", score.alias("risk_score"), level.alias("severity"), (score >= cfg.detect).cast("int").alias("suspicious"), evidence(*((hit[k], texts[k], k) for k in hit)).alias("reasons"))


@dataclass(frozen=True)
class TunnelConfig:
    """Fixed values of the tunnel detector."""

    window_us: int = 120_000_000
    window_queries: int = 256
    least_n: int = 8
    least: float = 0.65
    popular: int = 25
    damping: float = 0.6
    least_label: int = 8
    cooldown_us: int = 300_000_000
    rise: float = 0.1
    suffixes: tuple[str, ...] = ("co.uk", "org.uk", "ac.uk", "gov.uk", "com.au", "net.au", "co.in", "co.jp")


def tunnel_scores(queries: DataFrame, cfg: TunnelConfig = TunnelConfig()) -> DataFrame:
    """The whole tunnel score of (query_id, ts_us, src_ip, domain, qtype), queries only, from ``least_n`` payload labels on.

    The payload is the longest label below the registered name; queries whose payload is short or not alphanumeric are
    skipped, but their sources count for the name's popularity.
    """
    q = queries.select("query_id", "ts_us", F.coalesce("src_ip", F.lit("?")).alias("src_ip"), "qtype", normal_domain("domain").alias("fqdn")).where("fqdn <> ''")
    q = q.withColumn("d", domain_parts("fqdn", cfg.suffixes)).select("query_id", "ts_us", "src_ip", "qtype", "d.registered", F.split("d.subdomain", r"\.").alias("sub"))
    # The moment at which the name has met its ``popular``-th source.
    first = q.groupBy("registered", "src_ip").agg(F.min(F.struct("ts_us", "query_id")).alias("at"))
    nth = F.row_number().over(Window.partitionBy("registered").orderBy("at"))
    known = first.withColumn("nth", nth).where(F.col("nth") == cfg.popular).select("registered", F.col("at").alias("popular_at"))
    longest = F.aggregate("sub", F.lit(""), lambda a, x: F.when(F.length(x) > F.length(a), x).otherwise(a))
    p = q.withColumn("label", longest).where((F.length("label") >= cfg.least_label) & F.col("label").rlike(r"^[\p{L}\p{N}]+$"))
    order = Window.partitionBy("src_ip", "registered").orderBy("ts_us", "query_id")
    p = p.withColumns({"h": char_entropy("label"), "gap": (F.col("ts_us") - F.lag("ts_us").over(order)) / 1e6, "is_txt": F.coalesce(F.col("qtype").isin(16, 10), F.lit(False)).cast("double")})
    ring = F.collect_list(F.struct("ts_us", "label", "h", "gap", "is_txt")).over(order.rowsBetween(1 - cfg.window_queries, 0))
    p = p.select("query_id", "ts_us", "src_ip", "registered", ring.alias("ring"))
    p = p.withColumn("x", F.filter("ring", lambda x: F.col("ts_us") - x["ts_us"] <= cfg.window_us)).withColumn("n", F.size("x")).where(F.col("n") >= cfg.least_n)

    def mean(items, value) -> Column:
        return F.aggregate(items, F.lit(0.0), lambda a, y: a + value(y)) / F.greatest(F.size(items), F.lit(1))

    p = p.withColumn("gaps", F.filter(F.transform(F.slice("x", 2, F.col("n")), lambda y: y["gap"]), lambda g: g > 0))
    p = p.withColumn("gap", mean(F.col("gaps"), lambda g: g))
    spread = F.sqrt(mean(F.col("gaps"), lambda g: (g - F.col("gap")) * (g - F.col("gap"))))
    cadence = F.when(F.col("gap") > 0, F.greatest(F.lit(0.0), 1 - spread / F.col("gap") / 0.75)).otherwise(0.0)
    span = (F.col("ts_us") - F.get("x", F.lit(0))["ts_us"]) / 1e6
    x = F.col("x")
    p = p.select(
        "query_id", "ts_us", "src_ip", "registered", F.col("n").cast("long").alias("n"), cadence.alias("cadence"),
        mean(x, lambda y: F.length(y["label"]).cast("double")).alias("mean_len"), mean(x, lambda y: y["h"]).alias("mean_h"), mean(x, lambda y: y["is_txt"]).alias("txt"),
        (F.size(F.array_distinct(F.transform(x, lambda y: y["label"]))) / F.col("n")).alias("uniq"), (F.col("n") / F.greatest(span, F.lit(1.0))).alias("rate"),
    )
    raw = 0.25 * ramp("mean_len", 20.0, 50.0) + 0.25 * ramp("mean_h", 2.5, 3.8) + 0.25 * ramp("uniq", 0.5, 0.95) + 0.10 * ramp("rate", 0.1, 5.0) + 0.10 * F.col("cadence") + 0.05 * F.col("txt")
    p = p.withColumn("raw", raw).join(known, "registered", "left")
    popular = F.coalesce(F.struct("ts_us", "query_id") >= F.col("popular_at"), F.lit(False))
    score = F.round(F.least(F.lit(1.0), F.col("raw") * F.when(popular, cfg.damping).otherwise(1.0)), 4)
    return p.select("query_id", "ts_us", "src_ip", "registered", "n", score.alias("score"), (score >= cfg.least).cast("int").alias("alert"), severity(score, ((0.92, "CRITICAL"), (0.80, "HIGH")), "MEDIUM").alias("severity"))


def tunnel_alerts(queries: DataFrame, cfg: TunnelConfig = TunnelConfig()) -> DataFrame:
    """Alerts left by the cooldown of each source and name, which a risen score breaks."""
    a = tunnel_scores(queries, cfg).where("alert = 1").withColumn("confidence", F.col("score"))
    return cooldown(a, ["src_ip", "registered"], cfg.cooldown_us, cfg.rise, tie="query_id").drop("confidence", "alert")
