"""Per-key history: baselines, novelty, sliding windows, rings, beacon statistics, folds."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .sliding import sliding_counts


def baseline(flows: DataFrame, n: int = 30) -> DataFrame:
    """Mean and population deviation of volume, and mean rate where there is one, over the source's n flows before each flow, and destination novelty."""
    w = Window.partitionBy("src_ip").orderBy("ts_us", "flow_id").rowsBetween(-n, -1)
    new = F.row_number().over(Window.partitionBy("src_ip", "dst_ip").orderBy("ts_us", "flow_id")) == 1
    more = {"base_rate": F.avg("rate").over(w)} if "rate" in flows.columns else {}
    return flows.withColumns({"base_mean": F.avg("bytes_out").over(w), "base_std": F.stddev_pop("bytes_out").over(w), "base_n": F.count("*").over(w), "novel": new.cast("int")} | more)


def sliding_fanout(flows: DataFrame, us: int) -> DataFrame:
    """Distinct destinations, distinct ports and attempts of the source in the last ``us`` up to each flow."""
    rows = flows.select("flow_id", "src_ip", "ts_us", "dst_ip", "dst_port")
    return sliding_counts(rows, ["src_ip"], us, {"unique_dst": ["dst_ip"], "unique_ports": ["dst_port"], "attempts": []}).select("flow_id", "src_ip", "unique_dst", "unique_ports", "attempts")


def sliding_ports(flows: DataFrame, us: int) -> DataFrame:
    """The most distinct ports on one destination in the last ``us`` up to each flow."""
    rows = flows.select("flow_id", "src_ip", "ts_us", "dst_ip", "dst_port")
    return sliding_counts(rows, ["src_ip"], us, {}, {"max_ports": (["dst_ip"], ["dst_port"])}).select("flow_id", "max_ports")


def channel_ring(rows: DataFrame, key: str, n: int = 64, least: int = 8, every: int = 2) -> DataFrame:
    """The last n records up to each evaluated one: from the least-th on, every other one."""
    w = Window.partitionBy(key).orderBy("ts_us", "flow_id")
    ring = w.rowsBetween(-(n - 1), 0)
    out = rows.select(key, "flow_id", F.row_number().over(w).alias("rn"), F.count("*").over(ring).alias("ring_n"), F.min("ts_us").over(ring).alias("ring_start"), F.sum("size").over(ring).alias("ring_bytes"))
    return out.where((F.col("rn") >= least) & ((F.col("rn") - least) % every == 0))


def beacon_stats(rows: DataFrame, key: str, least_events: int = 8, size: str = "size") -> DataFrame:
    """Median and MAD of the gaps, share of gaps near a multiple of the median, size variation, span; in microseconds."""
    w = Window.partitionBy(key).orderBy("ts_us", "flow_id")
    g = rows.select(key, "ts_us", size, (F.col("ts_us") - F.lag("ts_us").over(w)).alias("g"))
    sizes = g.groupBy(key).agg(F.count("*").alias("n"), F.avg(size).alias("m"), F.stddev_pop(size).alias("s"), (F.max("ts_us") - F.min("ts_us")).alias("span_us"))
    live = g.where("g > 1000")
    med = live.groupBy(key).agg(F.percentile("g", 0.5).alias("median_us"), F.count("*").alias("gaps"))
    dev = live.join(med, key).withColumn("d", F.abs(F.col("g") - F.col("median_us")))
    times = F.greatest(F.rint(F.col("g") / F.col("median_us")), F.lit(1.0))
    near = F.abs(F.col("g") - times * F.col("median_us")) <= 0.25 * F.col("median_us")
    mad = dev.groupBy(key).agg(F.percentile("d", 0.5).alias("mad_us"), F.count_if(near).alias("near"))
    return med.join(mad, key).join(sizes, key).where(F.col("gaps") >= least_events - 1).select(key, "n", "gaps", "median_us", "mad_us", "near", "span_us", F.round(F.col("s") / F.greatest("m", F.lit(1.0)), 6).alias("size_cv"))


def pair_history(rows: DataFrame, key: str, n: int = 256) -> DataFrame:
    """Number of starts in the ring and mean gap over it, at each record."""
    w = Window.partitionBy(key).orderBy("ts_us", "flow_id").rowsBetween(-(n - 1), 0)
    c = F.count("*").over(w)
    return rows.select(key, "flow_id", c.alias("pair_conn_count"), F.round((F.max("ts_us").over(w) - F.min("ts_us").over(w)) / 1e6 / F.greatest(c - 1, F.lit(1)), 6).alias("pair_iat_mean"))


def pair_features(starts: DataFrame, emitted: DataFrame, n: int = 256) -> DataFrame:
    """``emitted`` (flow_id, emit_us, the channel's columns) with the channel's history at that time: the number of starts
    in the ring and their mean gap. Both kinds of event go through one window, so no pair of them is joined."""
    key = ["src_ip", "dst_ip", "dst_port", "proto"]
    order = Window.partitionBy(*key).orderBy("ts_us", "flow_id")
    ring = order.rowsBetween(1 - n, 0)
    own = starts.withColumns({"pair_conn_count": F.count("*").over(ring), "span": (F.max("ts_us").over(ring) - F.min("ts_us").over(ring)) / 1e6})
    own = own.withColumn("h", F.struct("pair_conn_count", F.when(F.col("pair_conn_count") > 1, F.col("span") / (F.col("pair_conn_count") - 1)).otherwise(0.0).alias("pair_iat_mean")))
    both = own.select(*key, F.col("ts_us").alias("at"), F.lit(0).alias("kind"), "flow_id", "h").unionByName(emitted.select(*key, F.col("emit_us").alias("at"), F.lit(1).alias("kind"), "flow_id", F.lit(None).cast(own.schema["h"].dataType).alias("h")))
    seen = F.last("h", ignorenulls=True).over(Window.partitionBy(*key).orderBy("at", "kind", "flow_id"))
    return both.withColumn("seen", seen).where("kind = 1").select("flow_id", F.coalesce("seen.pair_conn_count", F.lit(0)).alias("pair_conn_count"), F.coalesce("seen.pair_iat_mean", F.lit(0.0)).alias("pair_iat_mean"))


def persistence(rows: DataFrame, key: str, hit: Column, decay: float = 0.35) -> DataFrame:
    """Exponential persistence: s <- decay * s + (1 - decay) * gain, gain = min(1, k / 3), k the run of hits (down by 1 on a miss)."""
    seq = F.array_sort(F.collect_list(F.struct("ts_us", "flow_id", hit.alias("h"))))
    start = F.struct(F.lit(0.0).alias("s"), F.lit(0).alias("k"))

    def step(acc, x):
        k = F.when(x["h"], acc["k"] + 1).otherwise(F.greatest(acc["k"] - 1, F.lit(0)))
        gain = F.when(x["h"], F.least(F.lit(1.0), k / 3.0)).otherwise(0.0)
        return F.struct((acc["s"] * decay + gain * (1 - decay)).alias("s"), k.alias("k"))

    return rows.groupBy(key).agg(F.aggregate(seq, start, step).alias("x")).select(key, F.round("x.s", 6).alias("persistence"), F.col("x.k").alias("streak"))


def _series(times: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """Centres and centred counts of equal cells over the event times, four to the median gap but ``most`` at most."""
    start, end = times[0], times[-1]
    width = max(np.median(np.diff(times)) / 4, (end - start) / most, 1e-6)
    counts = np.bincount(((times - start) / width).astype(int), minlength=int((end - start) / width) + 1)
    return (np.arange(len(counts)) + 0.5) * width, counts - counts.mean()


def _power(at: np.ndarray, y: np.ndarray, frequencies: np.ndarray) -> np.ndarray:
    """Share of the variance of y that a sine wave of each frequency explains: the sum of squares of the projections on a
    cosine and a sine that the shift tau makes orthogonal."""
    w = 2 * np.pi * frequencies[:, None]
    tau = np.arctan2(np.sin(2 * w * at).sum(1), np.cos(2 * w * at).sum(1))[:, None] / (2 * w)
    total = 0.0
    for wave in (np.cos(w * (at - tau)), np.sin(w * (at - tau))):
        total = total + (wave @ y) ** 2 / np.maximum((wave * wave).sum(1), 1e-12)
    return total / (y @ y)


def lomb_scargle(times: np.ndarray, bins: int = 4096, freqs: int = 256) -> tuple[float, float, float, int]:
    """Peak power, its period, peak over median, and n, of the binned event series; zeros where there is too little."""
    t = np.sort(np.asarray(times, float))
    if len(t) < 8 or t[-1] <= t[0]:
        return 0.0, 0.0, 0.0, len(t)
    at, y = _series(t, bins)
    if y @ y <= 0:
        return 0.0, 0.0, 0.0, len(t)
    f = np.geomspace(2 / (t[-1] - t[0]), 1 / (at[0] * 4), freqs)
    power = _power(at, y, f)
    best = int(power.argmax())
    return float(power[best]), float(1 / f[best]), float(power[best] / (np.median(power) + 1e-12)), len(t)


def periodicity(rows: DataFrame, key: str, ring: int = 512) -> DataFrame:
    """Lomb-Scargle of each key's last ``ring`` starts; a row is sent to Python once, as one array."""
    w = Window.partitionBy(key).orderBy(F.desc("ts_us"), F.desc("flow_id"))
    last = rows.withColumn("rn", F.row_number().over(w)).where(F.col("rn") <= ring)
    series = last.groupBy(key).agg(F.array_sort(F.collect_list(F.col("ts_us") / 1e6)).alias("times"))
    kind = dict(rows.dtypes)[key]

    def part(frames):
        for g in frames:
            out = [lomb_scargle(x) for x in g["times"]]
            yield pd.DataFrame({key: g[key], "ls_peak_power": [x[0] for x in out], "ls_peak_period_s": [x[1] for x in out], "ls_snr": [x[2] for x in out], "ls_n_events": [x[3] for x in out]})

    return series.mapInPandas(part, f"{key} {kind}, ls_peak_power double, ls_peak_period_s double, ls_snr double, ls_n_events int")
