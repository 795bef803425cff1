"""Scan detection: connection attempts, answers, fan-out over the last seconds, cooldown."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import ACK, RST, SYN, has_flag, severity
from ..operators.alerts import cooldown
from ..operators.joins import top_targets
from ..operators.sliding import sliding_counts


@dataclass(frozen=True)
class ReconConfig:
    """Fixed values of the scan detector."""

    window_us: int = 5_000_000
    horizontal: int = 20
    vertical: int = 20
    least: float = 0.5
    cooldown_us: int = 10_000_000


def looks_like_response() -> Column:
    """A service port that answers an ephemeral one."""
    return (F.col("src_port") > 0) & (F.col("src_port") < 1024) & (F.col("dst_port") >= 1024)


def is_midstream() -> Column:
    return (F.col("proto") == 6) & (F.col("flags") != 0) & ~has_flag("flags", SYN)


def attempts(flows: DataFrame, cfg: ReconConfig = ReconConfig()) -> DataFrame:
    """Connection attempts of (flow_id, ts_us, src_ip, dst_ip, src_port, dst_port, proto, flags) with ``answered_us``.

    A flow that is the reverse leg of a possible attempt in the window before it is a reply, not an attempt; a bare
    reset is a reply that answers nothing. Every reverse leg counts as a reply, also after the first answer.
    """
    us = cfg.window_us
    able = flows.where(~looks_like_response() & ~is_midstream())
    legs = flows.select(
        F.col("flow_id").alias("rid"), F.col("ts_us").alias("r_us"), F.col("src_ip").alias("rs"), F.col("dst_ip").alias("rd"), F.col("src_port").alias("rp"), F.expr(f"ts_us div {us}").alias("rcell"),
        ((F.col("proto") == 6) & has_flag("flags", RST) & ~has_flag("flags", ACK)).alias("refused"),
    )
    cell = F.expr(f"ts_us div {us}")
    probes = able.select("flow_id", "ts_us", "src_ip", "dst_ip", "dst_port", F.explode(F.array(cell, cell + 1)).alias("cell"))
    met = probes.join(legs, (F.col("src_ip") == F.col("rd")) & (F.col("dst_ip") == F.col("rs")) & (F.col("dst_port") == F.col("rp")) & (F.col("cell") == F.col("rcell")))
    met = met.where((F.col("r_us") >= F.col("ts_us")) & (F.col("r_us") <= F.col("ts_us") + us) & (F.col("rid") != F.col("flow_id")))
    replies = met.select(F.col("rid").alias("flow_id")).distinct()
    answers = met.where(~F.col("refused")).groupBy("flow_id").agg(F.min("r_us").alias("answered_us"))
    return able.join(replies, "flow_id", "left_anti").join(answers, "flow_id", "left")


def recon_metrics(flows: DataFrame, cfg: ReconConfig = ReconConfig()) -> DataFrame:
    """Each attempt with its source's figures over the window."""
    a = attempts(flows, cfg).select("flow_id", "src_ip", "dst_ip", "dst_port", "ts_us", "answered_us")
    return sliding_counts(
        a, ["src_ip"], cfg.window_us, {"unique_dst": ["dst_ip"], "unique_ports": ["dst_port"], "attempts": []},
        {"max_ports": (["dst_ip"], ["dst_port"])}, {"answered": (F.col("answered_us"), F.col("ts_us") + cfg.window_us)},
    ).drop("answered_us")


def recon_scores(flows: DataFrame, cfg: ReconConfig = ReconConfig()) -> DataFrame:
    m = recon_metrics(flows, cfg)
    hor, ver = F.col("unique_dst") >= cfg.horizontal, F.col("max_ports") >= cfg.vertical
    fan = F.least(F.lit(1.0), F.greatest(F.when(hor, F.col("unique_dst") / (2.0 * cfg.horizontal)).otherwise(0.0), F.when(ver, F.col("max_ports") / (2.0 * cfg.vertical)).otherwise(0.0)))
    failed = F.round((F.col("attempts") - F.col("answered")) / F.col("attempts"), 3)
    volume = F.least(F.lit(1.0), F.col("attempts") / (4.0 * max(cfg.horizontal, cfg.vertical)))
    conf = F.round(F.least(F.lit(1.0), 0.55 * fan + 0.30 * failed + 0.15 * volume), 2)
    kind = F.when(hor & ver, "combined_scan").when(hor, "horizontal_scan").otherwise("vertical_scan")
    out = m.where(hor | ver).withColumns({"sub_type": kind, "failed_ratio": failed, "confidence": conf})
    return out.withColumn("severity", severity("confidence", ((0.9, "critical"), (0.75, "high"), (0.6, "medium")), "low"))


def recon(flows: DataFrame, cfg: ReconConfig = ReconConfig()) -> DataFrame:
    """Alerts: one for each source and kind of scan within the cooldown."""
    found = recon_scores(flows, cfg).where(F.col("confidence") >= cfg.least)
    return cooldown(found.drop("dst_port"), ["src_ip", "sub_type"], cfg.cooldown_us)


def snapshot_of(flows: DataFrame, source: str, cfg: ReconConfig = ReconConfig()) -> DataFrame:
    """The latest figures of one source."""
    m = recon_metrics(flows, cfg).where(F.col("src_ip") == source)
    return m.orderBy(F.desc("ts_us"), F.desc("flow_id")).limit(1)


def evidence_targets(alerts: DataFrame, flows: DataFrame, cfg: ReconConfig = ReconConfig()) -> DataFrame:
    """(flow_id, dst_ip, flows, rank): the three targets with the most attempts in the window of each alert."""
    us = cfg.window_us
    a = attempts(flows, cfg).select(F.col("src_ip").alias("s"), F.col("dst_ip").alias("d"), F.col("ts_us").alias("t"), F.expr(f"ts_us div {us}").alias("c"))
    cell = F.expr(f"ts_us div {us}")
    near = alerts.select("flow_id", "src_ip", "ts_us", F.explode(F.array(cell, cell - 1)).alias("cell"))
    j = near.join(a, (F.col("src_ip") == F.col("s")) & (F.col("cell") == F.col("c")) & F.col("t").between(F.col("ts_us") - us, F.col("ts_us")))
    return top_targets(j.select(F.col("flow_id").alias("src_ip"), F.col("d").alias("dst_ip"))).withColumnRenamed("src_ip", "flow_id")
