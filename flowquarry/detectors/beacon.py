"""C2 beacons: robust statistics over a ring of each channel's last flows, rarity of the destination, cooldown."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import severity
from ..operators.alerts import cooldown

CHANNEL = ("src_ip", "dst_ip", "dst_port", "proto")


@dataclass(frozen=True)
class BeaconConfig:
    """Fixed values of the beacon detector."""

    ring: int = 64
    least_events: int = 8
    every: int = 2
    least_median: float = 1.0
    most_median: float = 6 * 3600.0
    tolerance: float = 0.25
    least: float = 0.60
    cooldown_us: int = 300_000_000
    rise: float = 0.10
    popular: int = 25
    known_sources: int = 100
    allowed_ips: tuple[str, ...] = ()
    allowed_ports: tuple[int, ...] = ()


def _mean(xs: Column, f=lambda x: x) -> Column:
    return F.aggregate(xs, F.lit(0.0), lambda a, x: a + f(x)) / F.size(xs)


def _median(sorted_xs: Column) -> Column:
    n = F.size(sorted_xs)
    return (F.get(sorted_xs, F.floor((n - 1) / 2).cast("int")) + F.get(sorted_xs, F.floor(n / 2).cast("int"))) / 2.0


def _once(rows: DataFrame, **made: Column) -> DataFrame:
    """``rows`` with more columns, each computed once: as plain columns their whole expressions would be repeated in every later use and filter."""
    one = F.struct(*[c.alias(n) for n, c in made.items()])
    return rows.select("*", F.explode(F.array(one)).alias("__made")).select("*", "__made.*").drop("__made")


def evaluations(flows: DataFrame, cfg: BeaconConfig = BeaconConfig()) -> DataFrame:
    """Statistics of the ring at every evaluated flow of a channel: from the eighth on every second one, where enough
    intervals above a millisecond have a median between a second and six hours."""
    if cfg.allowed_ips:
        flows = flows.where(~F.col("dst_ip").isin(*cfg.allowed_ips))
    if cfg.allowed_ports:
        flows = flows.where(~F.col("dst_port").isin(*cfg.allowed_ports))
    order = Window.partitionBy(*CHANNEL).orderBy("ts_us", "flow_id")
    rows = flows.select("flow_id", "ts_us", *CHANNEL, F.row_number().over(order).alias("rn"), F.collect_list(F.struct("ts_us", F.col("bytes_out").cast("double").alias("size"))).over(order.rowsBetween(1 - cfg.ring, 0)).alias("ring"))
    rows = rows.where((F.col("rn") >= cfg.least_events) & ((F.col("rn") - cfg.least_events) % cfg.every == 0))
    n = F.size("ring")
    gaps = F.zip_with(F.slice("ring", 2, F.greatest(n - 1, F.lit(1))), F.slice("ring", 1, F.greatest(n - 1, F.lit(1))), lambda b, a: (b["ts_us"] - a["ts_us"]) / 1e6)
    rows = _once(rows, gaps=F.array_sort(F.filter(gaps, lambda g: g > 1e-3))).where(F.size("gaps") >= cfg.least_events - 1)
    rows = _once(rows, med=_median(F.col("gaps"))).where(F.col("med").between(cfg.least_median, cfg.most_median))
    rows = _once(rows, away=F.array_sort(F.transform("gaps", lambda g: F.abs(g - F.col("med")))), mean_size=_mean(F.col("ring"), lambda x: x["size"]))
    rcv = 1.4826 * _median(F.col("away")) / F.col("med")
    beat = lambda g: F.when(F.abs(g - F.greatest(F.lit(1.0), F.rint(g / F.col("med"))) * F.col("med")) <= cfg.tolerance * F.col("med"), 1.0).otherwise(0.0)
    spread = F.sqrt(_mean(F.col("ring"), lambda x: (x["size"] - F.col("mean_size")) * (x["size"] - F.col("mean_size"))))
    rows = _once(rows, rcv=rcv, consistency=_mean(F.col("gaps"), beat), size_cv=F.when(F.col("mean_size") > 0, spread / F.col("mean_size")).otherwise(1.0))
    return rows.select("flow_id", "ts_us", *CHANNEL, n.alias("n"), "med", "rcv", "consistency", "size_cv")


def sources_known(flows: DataFrame, at: DataFrame, most: int = 100) -> DataFrame:
    """``at`` (flow_id, ts_us, dst_ip, ...) with n_src: the destination's distinct sources up to then, ``most`` at most."""
    first = flows.groupBy("dst_ip", "src_ip").agg(F.min(F.struct("ts_us", "flow_id")).alias("at"))
    nth = F.row_number().over(Window.partitionBy("dst_ip").orderBy("at"))
    firsts = first.withColumn("nth", nth).where(F.col("nth") <= most).groupBy("dst_ip").agg(F.collect_list("at").alias("firsts"))
    return at.join(firsts, "dst_ip").withColumn("n_src", F.size(F.filter("firsts", lambda x: x <= F.struct(F.col("ts_us"), F.col("flow_id"))))).drop("firsts")


def scored(flows: DataFrame, cfg: BeaconConfig = BeaconConfig()) -> DataFrame:
    clip = lambda c: F.least(F.lit(1.0), F.greatest(F.lit(0.0), c))
    e = sources_known(flows, evaluations(flows, cfg), cfg.known_sources)
    raw = 0.35 * clip(1 - F.col("rcv") / 0.4) + 0.30 * F.col("consistency") + 0.15 * clip(1 - F.col("size_cv") / 0.5) + 0.10 * clip(F.col("n") / 20.0) + 0.10 * clip(1 - (F.col("n_src") - 1) / float(cfg.popular - 1))
    conf = clip(raw * F.when(F.col("consistency") < 0.6, 0.5).otherwise(1.0) * F.when(F.col("n_src") >= cfg.popular, 0.6).otherwise(1.0))
    return e.withColumn("confidence", conf)


def beacons(flows: DataFrame, cfg: BeaconConfig = BeaconConfig()) -> DataFrame:
    """Alerts of (flow_id, ts_us, src_ip, dst_ip, dst_port, proto, bytes_out), one within the cooldown unless the confidence rises."""
    found = cooldown(scored(flows, cfg).where(F.col("confidence") >= cfg.least), list(CHANNEL), cfg.cooldown_us, cfg.rise)
    return found.select(
        "flow_id", *CHANNEL, "n", F.round("med", 3).alias("period_s"), F.round("rcv", 4).alias("robust_cv"), F.round("consistency", 3).alias("consistency"), F.round("size_cv", 4).alias("size_cv"), "n_src",
        F.round("confidence", 4).alias("confidence"), severity("confidence", ((0.9, "HIGH"), (0.75, "MEDIUM")), "LOW").alias("severity"),
    )
