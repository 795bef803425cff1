"""Indicator lookups, reply matching, fusion, truth comparison."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import is_internal


def candidates(domain, limit: int = 4):
    """The name and its parents, most specific first, never a bare top-level domain."""
    labels = F.split(domain, r"\.")
    n = F.size(labels)
    return F.when(n >= 2, F.transform(F.sequence(F.lit(0), F.least(n - 2, F.lit(limit - 1))), lambda i: F.array_join(F.slice(labels, i + 1, n - i), "."))).otherwise(F.array().cast("array<string>"))


def indicators(flows: DataFrame) -> DataFrame:
    """(flow_id, kind, value): public addresses of both ends."""
    each = F.explode(F.array(F.struct(F.lit("ip").alias("kind"), F.col("dst_ip").alias("value")), F.struct(F.lit("ip").alias("kind"), F.col("src_ip").alias("value"))))
    return flows.select("flow_id", each.alias("i")).select("flow_id", "i.kind", "i.value").where(~is_internal("value"))


def record_indicators(records: DataFrame) -> DataFrame:
    """(record_id, pos, kind, value) of typed records: DNS names and their parents; of TLS and flow records the
    fingerprints, the server name and its parents, and public addresses. pos is the order in which they are looked up."""
    one = lambda kind, value: F.struct(F.lit(kind).alias("kind"), F.lower(value).alias("value"))
    names = lambda c: F.transform(candidates(F.lower(F.col(c))), lambda v: F.struct(F.lit("domain").alias("kind"), v.alias("value")))
    none = F.array().cast("array<struct<kind:string,value:string>>")
    some = lambda c, x: F.when(F.col(c).isNotNull() & (F.col(c) != ""), x).otherwise(none)
    address = lambda c: F.when(F.col(c).isNotNull() & ~is_internal(c), F.array(one("ip", F.col(c)))).otherwise(none)
    tls = F.concat(some("ja3", F.array(one("ja3", F.col("ja3")))), some("ja4", F.array(one("ja4", F.col("ja4")))), some("sni", names("sni")), address("dst_ip"), address("src_ip"))
    found = F.when(F.col("record_type") == "dns", some("domain", names("domain"))).when(F.col("record_type").isin("tls_hello", "flow_early", "flow"), tls).otherwise(none)
    return records.select("record_id", F.posexplode(found).alias("pos", "x")).select("record_id", "pos", "x.kind", "x.value")


def record_verdicts(records: DataFrame, iocs: DataFrame, early: float = 0.9) -> DataFrame:
    """Per record with a match: lookups, matches, confidence, early exit, and the surest match (the first looked up of equals)."""
    found = record_indicators(records)
    hits = found.join(iocs, ["kind", "value"], "left")
    hit = F.col("confidence").isNotNull()
    agg = hits.groupBy("record_id").agg(
        F.count("*").alias("lookups"), F.count_if(hit).alias("matches"), F.max("confidence").alias("top"), F.count_distinct(F.when(hit, F.col("kind"))).alias("kinds"),
        F.min_by(F.struct("kind", "value", "category"), F.when(hit, F.struct(-F.col("confidence"), "pos"))).alias("best"),
        F.array_sort(F.collect_set(F.when(hit, F.concat_ws(":", "kind", "value")))).alias("keys"),
    )
    agg = agg.where("matches > 0")
    return agg.select("record_id", "lookups", "matches", F.col("top").alias("confidence"), ((F.col("top") >= early) | (F.col("kinds") >= 2)).cast("int").alias("early_exit"), F.col("best.kind").alias("ioc_kind"), F.col("best.value").alias("ioc_matched"), F.col("best.category").alias("ioc_category"), F.array_join("keys", ",").alias("indicators"))


def memory_keys(records: DataFrame, verdicts: DataFrame) -> DataFrame:
    """(key, ts_us, hit_id, confidence): under which keys a hit is remembered: the pair, each public end, and the source of DNS and hello records."""
    r = records.join(verdicts.select("record_id", "confidence"), "record_id")
    public = lambda c: F.when(F.col(c).isNotNull() & ~is_internal(c), F.col(c))
    host = F.when(F.col("record_type").isin("dns", "tls_hello"), F.col("src_ip"))
    keys = F.array_distinct(F.array_compact(F.array(F.when(F.col("src_ip").isNotNull() & F.col("dst_ip").isNotNull(), F.concat_ws(">", "src_ip", "dst_ip")), public("src_ip"), public("dst_ip"), host)))
    return r.select(F.explode(keys).alias("key"), "ts_us", F.col("record_id").alias("hit_id"), "confidence")


def observe(records: DataFrame, verdicts: DataFrame, us: int = 60_000_000) -> DataFrame:
    """Alerts of early-exit verdicts: critical, confidence 0.95 at least, one for each source, destination and set of matches in ``us``."""
    from .alerts import cooldown

    sure = verdicts.where("early_exit = 1").select("record_id", F.greatest("confidence", F.lit(0.95)).alias("confidence"), "ioc_matched", "indicators")
    rows = records.select("record_id", "ts_us", "src_ip", "dst_ip").join(sure, "record_id")
    return cooldown(rows, ["src_ip", "dst_ip", "indicators"], us, None, tie="record_id").withColumn("severity", F.lit("CRITICAL")).withColumn("confidence", F.round("confidence", 2))


def match(rows: DataFrame, iocs: DataFrame) -> DataFrame:
    """Equi-join of (kind, value) with the indicator table; Spark broadcasts the table while it is small."""
    return rows.join(iocs, ["kind", "value"])


def domain_match(queries: DataFrame, iocs: DataFrame) -> DataFrame:
    """The most specific listed name of each query."""
    each = queries.select("query_id", F.posexplode(candidates(F.col("domain"))).alias("pos", "value")).withColumn("kind", F.lit("domain"))
    hit = each.join(iocs, ["kind", "value"])
    return hit.groupBy("query_id").agg(F.min_by(F.struct("value", "category", "confidence"), "pos").alias("m")).select("query_id", "m.value", "m.category", "m.confidence")


def verdict(matches: DataFrame, early: float = 0.9) -> DataFrame:
    """Per flow: confidence, number of matches, early exit on a sure one or on two kinds."""
    agg = matches.groupBy("flow_id").agg(F.count("*").alias("matches"), F.countDistinct("kind").alias("kinds"), F.max("confidence").alias("confidence"))
    return agg.select("flow_id", "matches", "confidence", ((F.col("confidence") >= early) | (F.col("kinds") >= 2)).cast("int").alias("early_exit"))


def replies(flows: DataFrame, us: int) -> DataFrame:
    """Probes and the time of their first reply: the reverse leg within ``us``, bucketed so the interval is an equi-join."""
    p = flows.select("flow_id", "src_ip", "dst_ip", "ts_us").withColumn("cell", F.explode(F.array(F.expr(f"ts_us div {us}"), F.expr(f"ts_us div {us} + 1"))))
    r = flows.select(F.col("src_ip").alias("rs"), F.col("dst_ip").alias("rd"), F.col("ts_us").alias("rt"), F.col("flow_id").alias("rid"), F.expr(f"ts_us div {us}").alias("rcell"))
    j = p.join(r, (p.src_ip == r.rd) & (p.dst_ip == r.rs) & (p.cell == r.rcell) & (F.col("rt") >= F.col("ts_us")) & (F.col("rt") <= F.col("ts_us") + us) & (F.col("rid") != F.col("flow_id")))
    return j.groupBy("flow_id").agg(F.min("rt").alias("reply_us"))


def fuse(alerts: DataFrame, hits: DataFrame, ttl: int) -> DataFrame:
    """Alerts raised by a recent hit on their pair, destination or source, in that order; the newest hit of a key counts."""
    keys = F.array(F.struct(F.lit(0).alias("p"), F.concat_ws(">", "src_ip", "dst_ip").alias("key")), F.struct(F.lit(1).alias("p"), F.col("dst_ip").alias("key")), F.struct(F.lit(2).alias("p"), F.col("src_ip").alias("key")))
    a = alerts.select("alert_id", "ts_us", "base", F.explode(keys).alias("k")).select("alert_id", "ts_us", "base", "k.p", "k.key")
    a = a.withColumn("cell", F.explode(F.array(F.expr(f"ts_us div {ttl}"), F.expr(f"ts_us div {ttl} - 1"))))
    h = hits.select("key", F.col("ts_us").alias("h_us"), "hit_id", "confidence").withColumn("cell", F.expr(f"h_us div {ttl}"))
    j = a.join(h, ["key", "cell"]).where((F.col("h_us") <= F.col("ts_us")) & (F.col("ts_us") < F.col("h_us") + ttl))
    best = j.groupBy("alert_id").agg(F.min_by(F.struct("p", "key", "confidence"), F.struct("p", -F.col("h_us"), "hit_id")).alias("b"))
    out = alerts.join(best, "alert_id", "left")
    boosted = F.greatest(F.col("base") + 0.45 * (1 - F.col("base")), F.lit(0.75))
    conf = F.when(F.col("b").isNotNull() & (F.col("base") >= 0.30), boosted).otherwise(F.col("base"))
    return out.select("alert_id", F.round(conf, 6).alias("confidence"), F.col("b.key").alias("ti_key"), F.when(conf >= 0.92, "CRITICAL").when(conf >= 0.75, "HIGH").when(conf >= 0.55, "MEDIUM").otherwise("LOW").alias("severity"))


def truth_counts(found: DataFrame, truth: DataFrame, keys: list[str]) -> DataFrame:
    """TP, FP, FN, precision and recall of two sets of keys."""
    f, t = found.select(*keys).distinct().withColumn("f", F.lit(1)), truth.select(*keys).distinct().withColumn("t", F.lit(1))
    agg = f.join(t, keys, "full").agg(F.count_if(F.col("f").isNotNull() & F.col("t").isNotNull()).alias("tp"), F.count_if(F.col("t").isNull()).alias("fp"), F.count_if(F.col("f").isNull()).alias("fn"))
    return agg.select("tp", "fp", "fn", F.round(F.col("tp") / F.greatest(F.col("tp") + F.col("fp"), F.lit(1)), 6).alias("precision"), F.round(F.col("tp") / F.greatest(F.col("tp") + F.col("fn"), F.lit(1)), 6).alias("recall"))


def first_alerts(alerts: DataFrame, keys: tuple[str, ...] = ("src_ip", "dst_ip")) -> DataFrame:
    """The time of the first alert of each pair."""
    return alerts.groupBy(*keys).agg(F.min("ts_us").alias("first_us"))


def upsert(rows: DataFrame) -> DataFrame:
    """Normalised (kind, value); the last writer by seq wins; unknown kinds and blank values go."""
    clean = rows.withColumn("value", F.lower(F.trim("value"))).where(F.col("kind").isin("ip", "domain", "ja3", "ja4") & (F.col("value") != ""))
    return clean.groupBy("kind", "value").agg(F.max_by(F.struct("category", "confidence", "seq"), "seq").alias("m")).select("kind", "value", "m.category", "m.confidence", "m.seq")


def store_counts(iocs: DataFrame) -> DataFrame:
    """Indicators of each kind and category, with the mean confidence."""
    return iocs.groupBy("kind", "category").agg(F.count("*").alias("n"), F.round(F.avg("confidence"), 6).alias("mean_confidence"))


def point_lookup(iocs: DataFrame, kind: str, value: str) -> DataFrame:
    """The indicator of a kind and a value, as the store spells it."""
    return iocs.where((F.col("kind") == kind) & (F.col("value") == value.strip().lower())).limit(1)


def cache_classes(lookups: DataFrame, positive_us: int, negative_us: int) -> DataFrame:
    """Hit, negative or miss of each lookup (key, ts_us, listed): an entry lives from the miss that made it."""
    seq = F.array_sort(F.collect_list(F.struct("ts_us", "flow_id", "listed")))
    start = F.struct(F.lit(None).cast("long").alias("until"), F.lit(0).cast("long").alias("hits"), F.lit(0).cast("long").alias("negative"), F.lit(0).cast("long").alias("misses"))

    def step(a, x):
        live = a["until"].isNotNull() & (x["ts_us"] < a["until"])
        until = F.when(live, a["until"]).otherwise(x["ts_us"] + F.when(x["listed"], positive_us).otherwise(negative_us))
        one = lambda c: F.when(c, 1).otherwise(0)
        return F.struct(until.cast("long").alias("until"), (a["hits"] + one(live & x["listed"])).alias("hits"), (a["negative"] + one(live & ~x["listed"])).alias("negative"), (a["misses"] + one(~live)).alias("misses"))

    return lookups.groupBy("key").agg(F.aggregate(seq, start, step).alias("x")).select("key", "x.hits", "x.negative", "x.misses")


def latest(rows: DataFrame, n: int) -> DataFrame:
    return rows.orderBy(F.desc("ts_us"), "alert_id").limit(n)


def top_targets(flows: DataFrame, n: int = 3) -> DataFrame:
    """The n destinations with the most flows of each source."""
    c = flows.groupBy("src_ip", "dst_ip").agg(F.count("*").alias("flows"))
    w = Window.partitionBy("src_ip").orderBy(F.desc("flows"), "dst_ip")
    return c.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= n)
