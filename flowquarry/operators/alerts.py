"""Alert contract: validation, flattening, cooldown, roll-ups."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import flow_key, iso_millis, protocol_name

SEVERITIES = ("LOW", "MEDIUM", "HIGH", "CRITICAL")
#: Which record types each consumer gets.
ROUTES = {"ddos": ("window", "flow"), "c2": ("flow",), "dga": ("dns",), "dns_tunnel": ("dns", "window"), "tls": ("tls_hello", "flow_early", "flow"), "portscan": ("window", "flow"), "exfil": ("flow",), "ti": ("flow", "dns", "tls_hello")}


def validate(alerts: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(valid, rejected) of (alert_id, severity, confidence, protocol, ...)."""
    sev = F.upper(F.trim(F.col("severity")))
    conf = F.col("confidence").try_cast("double")
    ok = F.coalesce(F.col("alert_id").isNotNull() & sev.isin(*SEVERITIES) & conf.isNotNull() & ~F.isnan(conf), F.lit(False))
    good = alerts.where(ok).withColumns({"severity": sev, "confidence": F.least(F.lit(1.0), F.greatest(F.lit(0.0), conf)), "protocol": protocol_name("protocol")})
    return good, alerts.where(~ok)


def flatten(alerts: DataFrame) -> DataFrame:
    f, t = "flow_identifier", "threat_intelligence"
    return alerts.select("alert_id", "timestamp", "severity", "threat_class", F.col("confidence_score").alias("confidence"), f"{f}.src_ip", f"{f}.dst_ip", f"{f}.dst_port", f"{f}.protocol", f"{t}.ioc_matched", F.col("system_telemetry.path_taken").alias("path"))


def route(records: DataFrame, routes: dict[str, tuple[str, ...]] = ROUTES) -> DataFrame:
    """Each record once for every consumer of its type."""
    pairs = [F.when(F.col("record_type").isin(*kinds), F.lit(name)) for name, kinds in sorted(routes.items())]
    return records.withColumn("consumer", F.explode(F.array_compact(F.array(*pairs))))


class Cooldown:
    """The fold of one key's alerts: none within ``us`` of the last emitted one, unless the score has risen by ``rise``."""

    def __init__(self, us: int, rise: float | None):
        self.us, self.rise = us, rise
        self.start()

    def start(self) -> None:
        self.last, self.score = None, 0.0

    def emits(self, t: int, score: float) -> bool:
        if self.last is None or t - self.last >= self.us or (self.rise is not None and score >= self.score + self.rise):
            self.last, self.score = t, score
            return True
        return False


def cooldown_fold(times: list[int], scores: list[float], us: int, rise: float | None) -> list[bool]:
    """Which of one key's alerts are emitted."""
    fold = Cooldown(us, rise)
    return [fold.emits(t, s) for t, s in zip(times, scores, strict=True)]


def in_stretches(rows: DataFrame, key: list[str], us: int, tie: str = "flow_id") -> DataFrame:
    """``rows`` with ``__new``: whether a key's first row, or one after a pause of ``us``, comes here. Each key's rows lie
    together and in order, so a fold can run over them as they stream by, starting anew where ``__new`` is set."""
    w = Window.partitionBy(*key).orderBy("ts_us", tie)
    return rows.withColumn("__new", F.coalesce(F.col("ts_us") - F.lag("ts_us").over(w) >= us, F.lit(True))).sortWithinPartitions(*key, "ts_us", tie)


def cooldown(alerts: DataFrame, key: list[str], us: int, rise: float | None = None, tie: str = "flow_id") -> DataFrame:
    """Alerts left by the cooldown. After a pause of ``us`` the next alert is emitted whatever came before; the fold holds
    one alert's time and score, however many a key has."""

    def part(frames):
        fold = Cooldown(us, rise)
        for f in frames:
            keep = []
            for new, t, s in zip(f["__new"], f["ts_us"], f["confidence"], strict=True):
                if new:
                    fold.start()
                keep.append(fold.emits(t, s))
            yield f[keep]

    cut = in_stretches(alerts, key, us, tie)
    return cut.mapInPandas(part, cut.schema).drop("__new")


def rollup_classes(alerts: DataFrame) -> DataFrame:
    return alerts.groupBy("threat_class", "severity").agg(F.count("*").alias("n"))


def evidence(*pairs: tuple[Column, str, str]) -> Column:
    """Sentences (with one %d, the whole part of a column) whose condition holds, joined by '; '."""
    each = [F.when(c, F.format_string(text, F.floor(F.col(col)).cast("long"))) for c, text, col in pairs]
    return F.array_join(F.array_compact(F.array(*each)), "; ")


def filtered(alerts: DataFrame, severities: list[str], classes: list[str]) -> DataFrame:
    return alerts.where(F.col("severity").isin(*severities) & F.col("threat_class").isin(*classes))


def kpis(alerts: DataFrame, targets: dict[str, int]) -> DataFrame:
    """One row: alerts, critical ones, early exits, cache hit ratio, and the difference of each target's figure from it."""
    n = F.count("*")
    one = alerts.agg(n.alias("alerts"), F.count_if(F.col("severity") == "CRITICAL").alias("critical"), F.count_if(F.col("path") == "EARLY_EXIT_TI_OVERRIDE").alias("early_exits"), F.round(F.count_if("cache_hit") / F.greatest(n, F.lit(1)), 6).alias("hit_ratio"))
    return one.withColumns({f"{k}_delta": F.col(k) - v for k, v in targets.items()})


def merged(parts: list[tuple[str, DataFrame]], record: str) -> DataFrame:
    """Alerts of several detectors (path, alerts) in one table, each record's in the order of the detectors."""
    rows = None
    for i, (path, a) in enumerate(parts):
        a = a.withColumns({"path": F.lit(path), "__ord": F.lit(i)})
        rows = a if rows is None else rows.unionByName(a, allowMissingColumns=True)
    return rows.withColumn("place", F.row_number().over(Window.partitionBy(record).orderBy("__ord"))).drop("__ord")


def envelope(rows: DataFrame, threat_class: str, module: str, evidence_fields: Column, metric: str = "") -> DataFrame:
    """Detector rows as alerts of the common shape: nested identifier, intelligence, evidence as JSON, telemetry."""
    conf = F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.col("confidence").cast("double")))
    return rows.select(
        F.concat(F.lit("ALT-"), F.substring(F.md5(F.concat_ws("|", F.lit(module), F.col("flow_id").cast("string"), F.col("ts_us").cast("string")).cast("binary")), 1, 10)).alias("alert_id"), iso_millis("ts_us").alias("timestamp"), F.upper("severity").alias("severity"),
        F.lit(threat_class).alias("threat_class"), conf.alias("confidence_score"), F.struct("flow_id", flow_key().alias("flow_key"), "src_ip", "dst_ip", "src_port", "dst_port", protocol_name("proto").alias("protocol")).alias("flow_identifier"),
        F.struct(F.lit(False).alias("cache_hit"), F.lit(None).cast("string").alias("ioc_matched"), F.lit(None).cast("string").alias("ioc_category"), F.lit(False).alias("ti_override_applied")).alias("threat_intelligence"),
        F.struct(F.lit(metric).alias("primary_metric"), F.to_json(evidence_fields).alias("feature_attributions")).alias("supporting_evidence"), F.struct(F.lit(module).alias("path_taken"), F.lit("PASSIVE_UNIDIRECTIONAL").alias("enclave_mode")).alias("system_telemetry"),
    )
