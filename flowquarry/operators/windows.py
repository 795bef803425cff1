"""Tumbling-window aggregates: two levels of hash aggregation, so no key's members are gathered in one row."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import ACK, SYN, has_flag


def bucket(us: int, ts: str = "ts_us") -> Column:
    return F.expr(f"{ts} div {us}")


def entropy_from(total: Column, n_log_n: Column) -> Column:
    """log2(T) - sum(n log2 n) / T."""
    return F.log2(total.cast("double")) - n_log_n / total


def by_destination(packets: DataFrame, us: int, least: int = 5, size: str = "bytes") -> DataFrame:
    """Per bucket and destination: volume, protocol mix, sources and their entropy; rows below ``least`` packets go."""
    syn = has_flag("flags", SYN) & ~has_flag("flags", ACK)
    inner = packets.groupBy(bucket(us).alias("bucket"), "dst_ip", "src_ip").agg(
        F.count("*").alias("n"), F.sum(size).alias("b"), F.count_if(syn).alias("syn"), F.count_if(F.col("proto") == 17).alias("udp"), F.count_if(F.col("proto").isin(1, 58)).alias("icmp")
    )
    seconds = us / 1e6
    n = F.col("n").cast("double")
    out = inner.groupBy("bucket", "dst_ip").agg(
        F.sum("n").alias("pkts"), F.sum("b").alias("bytes"), F.sum("syn").alias("syn_pkts"), F.sum("udp").alias("udp_pkts"), F.sum("icmp").alias("icmp_pkts"),
        F.count("*").alias("unique_src"), F.sum(n * F.log2(n)).alias("nlog"), F.max("n").alias("top"),
    ).where(F.col("pkts") >= least)
    h = F.greatest(entropy_from(F.col("pkts"), F.col("nlog")), F.lit(0.0))
    return out.select(
        "bucket", "dst_ip", "pkts", "bytes", F.round(F.col("pkts") / seconds, 6).alias("pps"), F.round(F.col("bytes") / seconds, 6).alias("bytes_per_sec"), "syn_pkts", "udp_pkts", "icmp_pkts", "unique_src",
        F.round(h, 6).alias("src_entropy"),
        F.round(F.when(F.col("unique_src") > 1, h / F.log2(F.col("unique_src").cast("double"))).otherwise(0.0), 6).alias("src_entropy_norm"),
        F.round(F.col("top") / F.col("pkts"), 6).alias("top_src_share"),
    )


def by_source(packets: DataFrame, us: int, least: int = 5, targets: int = 20000, size: str = "bytes") -> DataFrame:
    """Per bucket and source: fan-out over addresses, ports and targets."""
    pairs = packets.groupBy(bucket(us).alias("bucket"), "src_ip", "dst_ip", "dst_port").agg(F.count("*").alias("n"), F.sum(size).alias("b"))
    key = ["bucket", "src_ip"]
    ports = pairs.groupBy(*key, "dst_port").agg(F.sum("n").alias("n"), F.sum("b").alias("b"), F.count("*").alias("t"))
    n = F.col("n").cast("double")
    per_port = ports.groupBy(*key).agg(F.sum("n").alias("pkts"), F.sum("b").alias("bytes"), F.count("*").alias("unique_dst_port"), F.sum("t").alias("all_targets"), F.sum(n * F.log2(n)).alias("nlog")).where(F.col("pkts") >= least)
    dsts = pairs.groupBy(*key, "dst_ip").agg(F.lit(1).alias("one")).groupBy(*key).agg(F.count("*").alias("unique_dst_ip"))
    seconds = us / 1e6
    out = per_port.join(dsts, key).withColumn("unique_targets", F.least("all_targets", F.lit(targets)))
    return out.select(
        *key, "pkts", "bytes", F.round(F.col("pkts") / seconds, 6).alias("pps"), "unique_dst_ip", "unique_dst_port", "unique_targets",
        F.round(F.greatest(entropy_from(F.col("pkts"), F.col("nlog")), F.lit(0.0)), 6).alias("dport_entropy"),
        F.round(F.col("unique_dst_ip") / F.col("pkts"), 6).alias("fanout_ratio_ip"), F.round(F.col("unique_dst_port") / F.col("pkts"), 6).alias("fanout_ratio_port"),
        F.round(F.col("unique_targets") / F.col("unique_dst_ip"), 6).alias("ports_per_dst"),
    )


def dns_velocity(queries: DataFrame, us: int, cap: int = 2000) -> DataFrame:
    names = queries.groupBy(bucket(us).alias("bucket"), "src_ip", "domain").agg(F.count("*").alias("n"), F.count_if(F.col("qtype").isin(16, 10)).alias("t"))
    return names.groupBy("bucket", "src_ip").agg(F.sum("n").alias("dns_queries"), F.sum("t").alias("dns_txt_null"), F.least(F.count("*"), F.lit(cap)).alias("dns_unique_names"))


def telemetry(flows: DataFrame, us: int) -> DataFrame:
    """Per bucket: throughput, flow rate, 95th percentile."""
    s = us / 1e6
    total = F.col("bytes_out") + F.col("bytes_in")
    return flows.groupBy(bucket(us).alias("bucket")).agg(
        F.count("*").alias("flows"), F.sum(total).alias("bytes"), F.round(F.sum(total) * 8 / s / 1e9, 12).alias("gbps"), F.round(F.count("*") / s, 9).alias("flows_per_sec"), F.round(F.percentile(total, 0.95), 6).alias("p95_bytes"),
    )


def previous_context(flows: DataFrame, us: int) -> DataFrame:
    """Each flow with its destination's figures in the last bucket before its own that had any traffic (zeros if none)."""
    # One row for each bucket with traffic: a few, whatever the number of flows.
    buckets = flows.select(bucket(us).alias("bucket")).distinct().withColumn("ord", F.row_number().over(Window.orderBy("bucket")))
    keyed = flows.withColumn("bucket", bucket(us)).join(buckets, "bucket")
    stats = keyed.groupBy((F.col("ord") + 1).alias("ord"), "dst_ip").agg(F.count("*").alias("dst_win_flows"), F.countDistinct("src_ip").alias("dst_win_unique_src"))
    return keyed.join(stats, ["ord", "dst_ip"], "left").select("flow_id", F.coalesce("dst_win_flows", F.lit(0)).alias("dst_win_flows"), F.coalesce("dst_win_unique_src", F.lit(0)).alias("dst_win_unique_src"))
