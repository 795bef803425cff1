"""Flow aggregates and sessions."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def flow_stats(packets: DataFrame, key: str = "flow_id") -> DataFrame:
    """Bidirectional totals of (key, ts_us, forward, length)."""
    out, back = F.col("forward"), ~F.col("forward")
    agg = packets.groupBy(key).agg(
        F.count_if(out).alias("pkts_out"), F.count_if(back).alias("pkts_in"),
        F.coalesce(F.sum(F.when(out, F.col("length"))), F.lit(0)).alias("bytes_out"), F.coalesce(F.sum(F.when(back, F.col("length"))), F.lit(0)).alias("bytes_in"),
        (F.max("ts_us") - F.min("ts_us")).alias("duration_us"),
    )
    return agg.select(key, "pkts_out", "pkts_in", "bytes_out", "bytes_in", "duration_us", (F.col("pkts_in") == 0).cast("int").alias("half_duplex"), F.round(F.col("bytes_out") / F.greatest("bytes_in", F.lit(1)), 6).alias("out_in_byte_ratio"))


def gap_us(key: str, ts: str = "ts_us", tie: str = "flow_id", clamp: bool = True) -> Column:
    """Microseconds since the key's latest earlier record; never negative with clamp."""
    w = Window.partitionBy(key).orderBy(ts, tie)
    g = F.col(ts) - F.lag(ts).over(w)
    return F.greatest(g, F.lit(0)) if clamp else g


def iat_moments(rows: DataFrame, key: str, tie: str = "flow_id") -> DataFrame:
    """Number, mean, sample variance and variation of the gaps of each key, in seconds."""
    g = rows.select(key, (gap_us(key, tie=tie) / 1e6).alias("g")).where("g is not null")
    agg = g.groupBy(key).agg(F.count("*").alias("iat_n"), F.avg("g").alias("m"), F.var_samp("g").alias("v"))
    v = F.coalesce("v", F.lit(0.0))
    return agg.select(key, "iat_n", F.round("m", 4).alias("iat_mean"), F.round(F.sqrt(v), 3).alias("iat_std"), F.round(F.when(F.col("m") > 0, F.sqrt(v) / F.nullif(F.col("m"), F.lit(0.0))).otherwise(0.0), 6).alias("iat_cv"))


def splt(packets: DataFrame, key: str = "flow_id", order: str = "turn", n: int = 20) -> DataFrame:
    """Signed lengths of the first n payload packets."""
    w = Window.partitionBy(key).orderBy(order)
    rows = packets.where("length > 0").withColumn("rn", F.row_number().over(w)).where(F.col("rn") <= n)
    signed = F.when(F.col("forward"), F.col("length")).otherwise(-F.col("length"))
    seq = F.array_sort(F.collect_list(F.struct("rn", signed.alias("s"))))
    return rows.groupBy(key).agg(F.array_join(F.transform(seq, lambda x: x["s"].cast("string")), ",").alias("splt_len"))


def early(packets: DataFrame, key: str = "flow_id", order: str = "turn", n: int = 20) -> DataFrame:
    """The record each flow emits at its nth payload packet."""
    w = Window.partitionBy(key).orderBy(order)
    rows = packets.where("length > 0").withColumn("rn", F.row_number().over(w)).withColumn("seen", F.sum("length").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return rows.where(F.col("rn") == n).select(key, order, F.col("seen").alias("payload_seen"))


def idle_sessions(rows: DataFrame, key: str, idle_us: int, tie: str = "flow_id") -> DataFrame:
    """Sessions split where the gap exceeds idle_us."""
    w = Window.partitionBy(key).orderBy("ts_us", tie)
    new = (F.coalesce(F.col("ts_us") - F.lag("ts_us").over(w), F.lit(idle_us + 1)) > idle_us).cast("long")
    return rows.withColumn("new", new).withColumn("session", F.sum("new").over(w)).groupBy(key, "session").agg(F.min("ts_us").alias("start_us"), F.max("ts_us").alias("end_us"), F.count("*").alias("records"))


class SessionFold:
    """The flow of one key that is open: idle and active timeouts, FIN twice or RST closes after a grace, SYN on a closed
    flow starts another."""

    def __init__(self, idle: int, active: int, grace: int):
        self.idle, self.active, self.grace = idle, active, grace
        self.start = None

    def feed(self, t: int, flags: int) -> tuple | None:
        """Take a record in; returns (start, end, records, reason) of the flow that it ended, if it did."""
        done = None
        if self.start is not None:
            reason = None
            if self.closed is not None and flags & 2 and not flags & 16:
                reason = "reuse"
            elif self.closed is not None and t - self.closed > self.grace:
                reason = "closed"
            elif t - self.last > self.idle:
                reason = "idle"
            elif t - self.start > self.active:
                reason = "active"
            if reason:
                done, self.start = (self.start, self.last, self.n, reason), None
        if self.start is None:
            self.start, self.last, self.n, self.fins, self.closed = t, t, 0, 0, None
        self.last, self.n = max(self.last, t), self.n + 1
        self.fins += flags & 1
        if self.closed is None and (flags & 4 or self.fins >= 2):
            self.closed = t
        return done

    def end(self, reason: str) -> tuple:
        out = (self.start, self.last, self.n, "closed" if self.closed is not None else reason)
        self.start = None
        return out


def fold_sessions(times: list[int], flags: list[int], idle: int, active: int, grace: int) -> list[tuple[int, int, int, str]]:
    """(start, end, records, reason) of one key's records in time order; what is left is flushed."""
    fold = SessionFold(idle, active, grace)
    out = [x for t, f in zip(times, flags, strict=True) if (x := fold.feed(t, f))]
    return [*out, fold.end("flush")] if times else out


def full_sessions(rows: DataFrame, key: str, idle_us: int = 15_000_000, active_us: int = 120_000_000, grace_us: int = 2_000_000, tie: str = "flow_id") -> DataFrame:
    """Flow expiry with every end reason. A key's rows stream through the fold in order; it holds one open flow, however
    long the key's history is."""
    w = Window.partitionBy(key).orderBy("ts_us", tie)
    nxt = F.lead("ts_us").over(w)
    # What follows a row: 0 more of the stretch, 1 a gap that ends it, 2 nothing.
    ends = F.when(nxt.isNull(), 2).when(nxt - F.col("ts_us") > idle_us, 1).otherwise(0)
    dealt = rows.select(key, "ts_us", "flags", tie, ends.alias("ends")).sortWithinPartitions(key, "ts_us", tie)
    kind = dict(rows.dtypes)[key]

    def part(frames):
        fold = SessionFold(idle_us, active_us, grace_us)
        for g in frames:
            out = []
            for k, t, f, e in zip(g[key], g["ts_us"], g["flags"], g["ends"], strict=True):
                if done := fold.feed(t, f):
                    out.append((k, *done))
                if e:
                    out.append((k, *fold.end("idle" if e == 1 else "flush")))
            yield pd.DataFrame(out, columns=[key, "start_us", "end_us", "records", "end_reason"])

    return dealt.mapInPandas(part, f"{key} {kind}, start_us long, end_us long, records long, end_reason string")


def anchored_windows(rows: DataFrame, key: str, us: int, tie: str = "flow_id") -> DataFrame:
    """Windows that open at a key's first record and close when ``us`` have passed; the next record opens another."""
    w = Window.partitionBy(key).orderBy("ts_us", tie)
    dealt = rows.select(key, "ts_us", tie, (F.lead("ts_us").over(w).isNull()).alias("final")).sortWithinPartitions(key, "ts_us", tie)
    kind = dict(rows.dtypes)[key]

    def part(frames):
        start, n = None, 0
        for g in frames:
            out = []
            for k, t, final in zip(g[key], g["ts_us"], g["final"], strict=True):
                if start is not None and t - start >= us:
                    out.append((k, start, n))
                    start = None
                if start is None:
                    start, n = t, 0
                n += 1
                if final:
                    out.append((k, start, n))
                    start = None
            yield pd.DataFrame(out, columns=[key, "start_us", "records"])

    return dealt.mapInPandas(part, f"{key} {kind}, start_us long, records long")


def lag1_autocorrelation(rows: DataFrame, key: str, tie: str = "flow_id") -> DataFrame:
    """Sum of products of neighbouring centred gaps over the sum of squares; needs more than two gaps."""
    w = Window.partitionBy(key).orderBy("ts_us", tie)
    g = rows.select(key, "ts_us", tie, ((F.col("ts_us") - F.lag("ts_us").over(w)) / 1e6).alias("g")).where("g is not null")
    c = g.withColumn("c", F.col("g") - F.avg("g").over(Window.partitionBy(key)))
    p = c.withColumn("p", F.col("c") * F.lag("c").over(Window.partitionBy(key).orderBy("ts_us", tie)))
    agg = p.groupBy(key).agg(F.count("*").alias("n"), F.sum("p").alias("num"), F.sum(F.col("c") * F.col("c")).alias("den"))
    return agg.where("n > 2").select(key, "n", F.round(F.when(F.col("den") > 0, F.col("num") / F.nullif(F.col("den"), F.lit(0.0))).otherwise(0.0), 5).alias("periodicity"))


def host_temporal(flows: DataFrame, burst: int) -> DataFrame:
    """Count, mean and population deviation of gaps, volume, bursts, time of day of the first flow."""
    g = flows.withColumn("g", gap_us("src_ip") / 1e6)
    return g.groupBy("src_ip").agg(
        F.count("*").alias("flow_count"), F.round(F.coalesce(F.avg("g"), F.lit(0.0)), 4).alias("mean_gap"), F.round(F.coalesce(F.stddev_pop("g"), F.lit(0.0)), 3).alias("std_gap"),
        F.sum("bytes_out").alias("total_bytes"), F.count_if(F.col("bytes_out") >= burst).alias("burst_count"), (F.expr("min(ts_us) div 60000000") % 1440).alias("time_of_day"),
    )
