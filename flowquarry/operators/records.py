"""Whole flow records and the feature vectors made of them; record adapters; reassembly; bounded state and dispatch."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import ACK, FIN, PSH, RST, SYN, char_counts, entropy_of, has_flag, ngrams


def _mean(xs: Column) -> Column:
    return F.when(F.size(xs) > 0, F.aggregate(xs, F.lit(0.0), lambda a, x: a + x) / F.size(xs)).otherwise(0.0)


def array_stats(xs: Column) -> Column:
    """struct(mean, pstd, most) of an array of doubles; zeros where it is empty."""
    mean = _mean(xs)
    return F.struct(mean.alias("mean"), F.sqrt(_mean(F.transform(xs, lambda x: (x - mean) * (x - mean)))).alias("pstd"), F.coalesce(F.array_max(xs), F.lit(0.0)).alias("most"))


def flow_records(packets: DataFrame, key: str = "flow_id", tie: str = "packet_id", n_iat: int = 128, n_times: int = 512, n_splt: int = 20) -> DataFrame:
    """One record for each flow of (key, tie, ts_us, forward, ip_len, payload_len, flags): totals of both directions, flag
    counts, rates, gap moments, and the first gaps, times, and signed payload lengths with their gaps in milliseconds.
    The lists are cut before they are gathered, so no row grows with its flow."""
    w = Window.partitionBy(key).orderBy("ts_us", tie)
    before = w.rowsBetween(Window.unboundedPreceding, -1)
    some = F.col("payload_len") > 0
    rows = packets.withColumns({
        "rn": F.row_number().over(w), "gap": F.greatest(F.col("ts_us") - F.max("ts_us").over(before), F.lit(0)) / 1e6,
        "prn": F.sum(some.cast("int")).over(w.rowsBetween(Window.unboundedPreceding, 0)), "last_payload": F.last(F.when(some, F.col("ts_us")), ignorenulls=True).over(before),
    })
    out, back = F.col("forward"), ~F.col("forward")
    total = lambda c, d: F.coalesce(F.sum(F.when(d, F.col(c))), F.lit(0))
    first = lambda cond, value: F.transform(F.array_sort(F.collect_list(F.when(cond, F.struct("rn", value.alias("x"))))), lambda s: s["x"])
    splt = some & (F.col("prn") <= n_splt)
    agg = rows.groupBy(key).agg(
        F.min("ts_us").alias("start_us"), F.max("ts_us").alias("end_us"), F.count_if(out).alias("pkts_out"), F.count_if(back).alias("pkts_in"), total("ip_len", out).alias("bytes_out"), total("ip_len", back).alias("bytes_in"),
        total("payload_len", out).alias("payload_out"), total("payload_len", back).alias("payload_in"),
        *[F.count_if(has_flag("flags", bit)).alias(f"{name}_cnt") for name, bit in (("syn", SYN), ("fin", FIN), ("rst", RST), ("ack", ACK), ("psh", PSH))],
        F.count("gap").alias("iat_n"), F.coalesce(F.avg("gap"), F.lit(0.0)).alias("iat_mean"), F.coalesce(F.var_samp("gap"), F.lit(0.0)).alias("iat_var"),
        first(F.col("rn").between(2, n_iat + 1), F.col("gap")).alias("iat_seq"), first(F.col("rn") <= n_times, F.col("ts_us")).alias("times"),
        first(splt, F.when(out, F.col("payload_len")).otherwise(-F.col("payload_len"))).alias("splt_len"),
        first(splt, F.when(F.col("prn") == 1, 0.0).otherwise(F.greatest(F.col("ts_us") - F.col("last_payload"), F.lit(0)) / 1e3)).alias("splt_iat_ms"),
    )
    seconds, pkts, size = (F.col("end_us") - F.col("start_us")) / 1e6, F.col("pkts_out") + F.col("pkts_in"), F.col("bytes_out") + F.col("bytes_in")
    rate = lambda x: F.when(seconds > 0, x / F.nullif(seconds, F.lit(0.0))).otherwise(x.cast("double"))
    std = F.sqrt("iat_var")
    return agg.withColumns({
        "duration": seconds, "half_duplex": ((F.col("pkts_in") == 0) | (F.col("pkts_out") == 0)).cast("int"), "bytes_total": size, "pps": rate(pkts), "bytes_per_sec": rate(size),
        "out_in_byte_ratio": F.col("bytes_out") / F.greatest("bytes_in", F.lit(1)), "iat_std": std, "iat_cv": F.when(F.col("iat_mean") > 0, std / F.nullif(F.col("iat_mean"), F.lit(0.0))).otherwise(0.0),
    })


#: The feature vector of the flow classifier, in its order.
TLS_FEATURES = (
    "duration", "packet_count", "byte_count", "packet_rate", "byte_rate", "packet_size_mean", "packet_size_std", "packet_size_cv", "first_packet_size", "last_packet_size",
    "iat_mean", "iat_std", "iat_max", "iat_cv", "periodicity_score", "tls_present", "tls_version", "server_hello", "ja3_hash_freq", "ja3s_hash_freq",
)


def tls_vectors(records: DataFrame, key: str = "flow_id", gaps_in_ms: bool = True) -> DataFrame:
    """(key, features) of flow records, optionally with ja3, tls_version and pair_ls_peak_power.

    With ``gaps_in_ms`` the largest gap is divided by 1000 as if the gaps were milliseconds, which is what the trained
    models expect although the gaps are seconds. Two features are always absent on the wire side, and zero.
    """
    have = lambda c: F.coalesce(F.col(c).cast("double"), F.lit(0.0)) if c in records.columns else F.lit(0.0)
    sizes = F.transform("splt_len", lambda x: F.abs(x).cast("double"))
    pkts = F.greatest(F.col("pkts_out") + F.col("pkts_in"), F.lit(1))
    r = records.withColumn("__sizes", sizes).withColumn("__s", array_stats(F.col("__sizes"))).withColumn("__mean", F.col("bytes_total") / pkts)
    std = F.when(F.size("__sizes") > 1, F.col("__s.pstd")).otherwise(0.0)
    ja3 = F.col("ja3").isNotNull().cast("double") if "ja3" in records.columns else F.lit(0.0)
    values = {
        "duration": F.col("duration"), "packet_count": pkts, "byte_count": F.col("bytes_total"), "packet_rate": F.col("pps"), "byte_rate": F.col("bytes_per_sec"), "packet_size_mean": F.col("__mean"),
        "packet_size_std": std, "packet_size_cv": F.when(F.col("__mean") != 0, std / F.nullif(F.col("__mean"), F.lit(0.0))).otherwise(0.0), "first_packet_size": F.coalesce(F.get("__sizes", F.lit(0)), F.lit(0.0)),
        "last_packet_size": F.coalesce(F.try_element_at("__sizes", F.lit(-1)), F.lit(0.0)), "iat_mean": F.col("iat_mean"), "iat_std": F.col("iat_std"), "iat_max": F.coalesce(F.array_max("iat_seq"), F.lit(0.0)) / (1000.0 if gaps_in_ms else 1.0),
        "iat_cv": F.col("iat_cv"), "periodicity_score": have("pair_ls_peak_power"), "tls_present": ja3, "tls_version": have("tls_version"), "server_hello": F.lit(0.0), "ja3_hash_freq": F.lit(0.0), "ja3s_hash_freq": F.lit(0.0),
    }
    return r.select(key, *[values[f].cast("double").alias(f) for f in TLS_FEATURES])


def training_features(packets: DataFrame, key: list[str], tie: str = "packet_id", size: str = "ip_len") -> DataFrame:
    """Features of each directional flow for training: rates over at least a microsecond, population deviations, largest gap, lag-1 autocorrelation of the gaps, first and last size."""
    w = Window.partitionBy(*key).orderBy("ts_us", tie)
    rows = packets.select(*key, "ts_us", tie, F.col(size).cast("double").alias("size"), ((F.col("ts_us") - F.lag("ts_us").over(w)) / 1e6).alias("g"))
    mean = F.avg("g").over(Window.partitionBy(*key))
    rows = rows.withColumn("c", F.col("g") - mean).withColumn("p", F.col("c") * F.lag("c").over(w))
    order = F.struct("ts_us", tie)
    agg = rows.groupBy(*key).agg(
        F.greatest((F.max("ts_us") - F.min("ts_us")) / 1e6, F.lit(0.000001)).alias("duration"), F.count("*").alias("packet_count"), F.sum("size").alias("byte_count"), F.avg("size").alias("packet_size_mean"), F.stddev_pop("size").alias("packet_size_std"),
        F.min_by("size", order).alias("first_packet_size"), F.max_by("size", order).alias("last_packet_size"), F.coalesce(F.avg("g"), F.lit(0.0)).alias("iat_mean"), F.coalesce(F.stddev_pop("g"), F.lit(0.0)).alias("iat_std"), F.coalesce(F.max("g"), F.lit(0.0)).alias("iat_max"),
        F.count("g").alias("n"), F.sum("p").alias("num"), F.sum(F.col("c") * F.col("c")).alias("den"),
    )
    over = lambda a, b: F.when(F.col(b) > 0, F.col(a) / F.nullif(F.col(b), F.lit(0.0))).otherwise(0.0)
    return agg.select(
        *key, "duration", "packet_count", "byte_count", (F.col("packet_count") / F.col("duration")).alias("packet_rate"), (F.col("byte_count") / F.col("duration")).alias("byte_rate"), "packet_size_mean", "packet_size_std",
        over("packet_size_std", "packet_size_mean").alias("packet_size_cv"), "first_packet_size", "last_packet_size", "iat_mean", "iat_std", "iat_max", over("iat_std", "iat_mean").alias("iat_cv"),
        F.when((F.col("n") > 2) & (F.col("den") > 0), F.col("num") / F.nullif(F.col("den"), F.lit(0.0))).otherwise(0.0).alias("periodicity_score"),
    )


def dns_records(queries: DataFrame) -> DataFrame:
    """Lexical fields of DNS records (query_id, domain, qtype): naive split, lengths, entropies, ratios, n-gram counts as JSON."""
    name = F.coalesce(F.col("domain"), F.lit(""))
    labels = F.split(name, r"\.")
    sld = F.when(F.size(labels) > 1, F.try_element_at(labels, F.lit(-2))).otherwise(F.get(labels, F.lit(0)))
    q = queries.select("query_id", "qtype", name.alias("name"), labels.alias("labels"), sld.alias("sld"), F.try_element_at(labels, F.lit(-1)).alias("tld"))
    letters = F.regexp_replace("sld", r"[^\p{L}]", "")
    vowels, n = F.length(F.regexp_replace(letters, "[^aeiou]", "")), F.length("sld")
    consonants = F.length(letters) - vowels
    share = lambda x: F.when(n > 0, x / F.nullif(n, F.lit(0))).otherwise(0.0)
    plain = F.regexp_replace("name", r"\.", "")
    entropy = lambda x: F.when(F.length(x) > 0, entropy_of(char_counts(x))).otherwise(0.0)

    def counts(k: int) -> Column:
        g = ngrams("sld", k)
        return F.to_json(F.map_from_entries(F.transform(F.array_sort(F.array_distinct(g)), lambda x: F.struct(x, F.size(F.filter(g, lambda y: y == x))))))

    bi = ngrams("sld", 2)
    return q.select(
        "query_id", "sld", "tld", F.col("qtype").isin(16, 10).cast("int").alias("is_txt_null"), F.length("name").alias("query_len"), F.size("labels").alias("label_count"), F.array_max(F.transform("labels", F.length)).alias("max_label_len"), n.alias("sld_len"),
        F.round(entropy(plain), 6).alias("char_entropy"), F.round(entropy(F.col("sld")), 6).alias("sld_entropy"), F.round(share(F.length(F.regexp_replace("sld", "[^0-9]", ""))), 6).alias("digit_ratio"), F.round(share(vowels), 6).alias("vowel_ratio"),
        F.round(F.when(consonants > 0, vowels / F.nullif(consonants, F.lit(0))).otherwise(vowels.cast("double")), 6).alias("vowel_consonant_ratio"), counts(2).alias("ngram2"), counts(3).alias("ngram3"),
        F.round(F.size(F.array_distinct(bi)) / F.greatest(n - 1, F.lit(1)), 6).alias("ngram2_unique_ratio"),
    )


def adapted(flows: DataFrame) -> dict[str, DataFrame]:
    """Flow records as the inputs of the beacon, scan and exfiltration detectors; only SYN is known of a finished flow's flags."""
    base = ["flow_id", "ts_us", "src_ip", "dst_ip", "src_port", "dst_port"]
    syn = F.when(has_flag("flags", SYN), SYN).otherwise(0)
    return {
        "beacon": flows.select(*base, "proto", "bytes_out"), "recon": flows.select(*base, "proto", syn.alias("flags")),
        "exfil": flows.select(*base, "proto", "bytes_out", "bytes_in", F.greatest("duration_us", F.lit(0)).alias("duration_us")),
    }


def hello_bytes(packets: DataFrame, key: list[str], most: int = 16384) -> DataFrame:
    """The first ``most`` payload bytes that each side of a TCP flow sent, in order, for the ClientHello parser."""
    w = Window.partitionBy(*key).orderBy("ts_us", "packet_id")
    before = F.coalesce(F.sum(F.length("payload")).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    rows = packets.where((F.col("proto") == 6) & (F.length("payload") > 0)).withColumn("__before", before).where(F.col("__before") < most)
    parts = F.transform(F.array_sort(F.collect_list(F.struct("ts_us", "packet_id", "payload"))), lambda x: x["payload"])
    return rows.groupBy(*key).agg(F.aggregate(parts, F.lit(b"").cast("binary"), lambda a, x: F.concat(a, x)).alias("data"))


def bounded_keys(rows: DataFrame, key: list[str], bucket: str, most: int) -> tuple[DataFrame, DataFrame]:
    """(rows of the first ``most`` keys of each bucket in order of arrival, overflow count of each bucket)."""
    first = rows.groupBy(bucket, *key).agg(F.min(F.struct("ts_us", "flow_id")).alias("__at"), F.count("*").alias("__n"))
    rank = first.withColumn("__rank", F.row_number().over(Window.partitionBy(bucket).orderBy("__at")))
    kept = rank.where(F.col("__rank") <= most).select(bucket, *key)
    lost = rank.groupBy(bucket).agg(F.sum(F.when(F.col("__rank") > most, F.col("__n")).otherwise(0)).alias("dropped_rows"), F.count_if(F.col("__rank") > most).alias("dropped_keys"))
    return rows.join(kept, [bucket, *key], "left_semi"), lost


def dispatched(records: DataFrame, order: str, size: int = 256, wait_us: int = 50_000, queue: int = 2000) -> DataFrame:
    """(consumer, batch, records, first_us, dropped) of routed records: a batch closes after ``size`` records or when its
    first one has waited; batches beyond the queue's length within a second are counted as dropped."""
    slot = F.expr(f"ts_us div {wait_us}")
    rows = records.withColumn("slot", slot).withColumn("n", F.row_number().over(Window.partitionBy("consumer", "slot").orderBy("ts_us", order)))
    batches = rows.groupBy("consumer", "slot", F.expr(f"(n - 1) div {size}").alias("part")).agg(F.count("*").alias("records"), F.min("ts_us").alias("first_us"))
    second = F.expr("first_us div 1000000")
    place = F.row_number().over(Window.partitionBy("consumer", second).orderBy("first_us", "slot", "part"))
    return batches.withColumn("dropped", (place > queue).cast("int")).drop("part", "slot")


def paced(packets: DataFrame, speed: float, ts: str = "ts_us") -> DataFrame:
    """Packets with ``release_us``, the time after the start at which a replay at this speed lets them out; 0 is at once."""
    if speed <= 0:
        return packets.withColumn("release_us", F.lit(0).cast("long"))
    first = packets.agg(F.min(ts).alias("__first"))
    return packets.join(F.broadcast(first)).withColumn("release_us", F.floor((F.col(ts) - F.col("__first")) / F.lit(float(speed))).cast("long")).drop("__first")
