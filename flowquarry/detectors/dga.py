"""Generated-domain detection: names are scored once each, then joined to the queries."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import char_entropy, count_of, domain_parts, longest_run, normal_domain, ramp, severity
from ..ml.tabular import trigram_logp, word_coverage
from ..operators.alerts import in_stretches
from ..operators.sliding import sliding_counts

#: Names that are never scored.
SKIP_SUFFIXES = (".arpa", ".local", ".lan", ".internal", ".localdomain", ".home", ".corp")
#: Registered names that are never scored.
ALLOWED = ("google.com", "gstatic.com", "googleapis.com", "cloudfront.net", "amazonaws.com", "akamaiedge.net", "akamai.net", "microsoft.com", "windowsupdate.com", "office.com", "apple.com", "icloud.com", "cloudflare.com")
#: Weight and ramp of each term; the last two can only add.
TERMS = {"trigram_logp": (0.35, 2.4, 3.3), "word_coverage": (0.25, 0.0, 0.85), "max_consonant_run": (0.15, 3.0, 6.0), "entropy": (0.10, 3.0, 3.9), "length": (0.15, 8.0, 14.0), "digit_ratio": (0.15, 0.1, 0.4), "hex_like": (0.10, 0.0, 1.0)}
CUTOFFS = ((0.92, "CRITICAL"), (0.80, "HIGH"), (0.68, "MEDIUM"))


@dataclass(frozen=True)
class DgaConfig:
    """Fixed values of the generated-domain detector."""

    least: float = 0.60
    suspicious: float = 0.60
    burst_us: int = 60_000_000
    burst_target: int = 5
    dedupe_us: int = 300_000_000
    host_us: int = 10_000_000
    least_length: int = 7


def eligible(queries: DataFrame, least: int = 7) -> DataFrame:
    """(query_id, src_ip, ts_us, registered, label) of the queries that are scored."""
    name = normal_domain("domain")
    q = queries.withColumn("name", name).withColumn("p", domain_parts("name"))
    skip = (F.col("name") == "") | ~F.col("name").contains(".") | F.col("name").contains("_") | F.col("p.registered").isin(*ALLOWED) | (F.length("p.sld") < least) | F.col("p.sld").startswith("xn--")
    for s in SKIP_SUFFIXES:
        skip |= F.col("name").endswith(s)
    return q.where(~skip).select("query_id", "src_ip", "ts_us", F.col("p.registered").alias("registered"), F.col("p.sld").alias("label"))


def lexical(names: DataFrame, label: str = "label") -> DataFrame:
    """Features of each name that need neither model nor dictionary, unrounded."""
    n = F.length(label)
    chars = F.split(F.col(label), "")
    # Every change between digits and other symbols leaves two runs beside each other.
    turns = F.length(F.regexp_replace(F.regexp_replace(F.col(label), "[^0-9]+", "a"), "[0-9]+", "0")) - 1
    return names.select(
        label, n.alias("length"), longest_run(label, "bcdfghjklmnpqrstvwxyz").alias("max_consonant_run"), longest_run(label, "0-9").alias("max_digit_run"), char_entropy(label).alias("entropy"),
        (count_of(label, "0-9") / F.greatest(n, F.lit(1))).alias("digit_ratio"), turns.alias("switches"), count_of(label, r"\-").alias("hyphens"),
        (F.size(F.array_distinct(F.filter(chars, lambda c: c != ""))) / F.greatest(n, F.lit(1))).alias("unique_ratio"), F.col(label).rlike("^[0-9a-f]{12,}$").cast("int").alias("hex_like"),
    )


def contribution(name: str, value: Column) -> Column:
    """A term's share of the score, rounded to 3 places."""
    weight, low, high = TERMS[name]
    x = ramp(-value if name == "trigram_logp" else value.cast("double"), low, high)
    return F.round(weight * (1 - x if name == "word_coverage" else x), 3)


def score_domains(names: DataFrame, lm: DataFrame, words: DataFrame) -> DataFrame:
    """(label, terms, score) of distinct labels: each term rounded, the sum damped for short names, at most 1."""
    logp, cover = trigram_logp(names, lm, "label", digits=None), word_coverage(names, words, "label").withColumnRenamed("coverage", "word_coverage")
    f = lexical(names).join(logp, "label").join(cover, "label")
    terms = [contribution(t, F.col(t)).alias(t) for t in TERMS]
    total = sum((F.col(f"terms.{t}") for t in TERMS), F.lit(0.0))
    out = f.select("label", "length", F.struct(*terms).alias("terms"))
    return out.select("label", "terms", F.round(F.least(F.lit(1.0), total * F.least(F.lit(1.0), F.col("length") / 10.0)), 3).alias("score"))


def model_score(probability: Column, threshold: float) -> Column:
    """A classifier's probability rescaled so that its threshold is one half."""
    below, above = probability * 0.5 / threshold, 0.5 + 0.5 * (probability - threshold) / (1 - threshold + 1e-9)
    return F.when(probability < threshold, F.least(F.lit(1.0), below)).otherwise(above)


class Emission:
    """The fold of one host's alerts: none of a name within the dedupe time, and none within the host's interval unless it is graver than the last."""

    def __init__(self, cfg: DgaConfig):
        self.cfg = cfg
        self.start()

    def start(self) -> None:
        self.sent: dict[str, int] = {}
        self.until, self.rank = None, -1

    def emits(self, t: int, name: str, rank: int) -> bool:
        if self.sent.get(name, t) > t or (self.until is not None and self.until > t and rank <= self.rank):
            return False
        self.until, self.rank, self.sent[name] = t + self.cfg.host_us, rank, t + self.cfg.dedupe_us
        if len(self.sent) > 10_000:
            self.sent = {k: v for k, v in self.sent.items() if v > t}
        return True


def confidences(queries: DataFrame, scores: DataFrame, cfg: DgaConfig = DgaConfig()) -> DataFrame:
    """Each eligible query with its name's score, its host's burst of suspicious names, and the confidence of both."""
    s = eligible(queries, cfg.least_length).join(scores.select("label", "score"), "label")
    marked = s.where(F.col("score") >= cfg.suspicious).select("src_ip", "ts_us", "registered")
    j = sliding_counts(marked, ["src_ip"], cfg.burst_us, {"names": ["registered"]}, probes=s)
    burst = F.least(F.lit(1.0), F.col("names") / float(cfg.burst_target))
    return j.withColumn("burst", burst).withColumn("confidence", F.round(F.least(F.lit(1.0), 0.7 * F.col("score") + 0.3 * F.col("burst")), 2))


def dga(queries: DataFrame, lm: DataFrame, words: DataFrame, cfg: DgaConfig = DgaConfig()) -> DataFrame:
    """Alerts of (query_id, src_ip, ts_us, domain): confidence from the least on, thinned out by name and by host."""
    names = eligible(queries, cfg.least_length).select("label").distinct()
    # The scores of distinct names are read several times; kept, they are also a plan of their own.
    scores = score_domains(names, lm, words).select("label", "score").persist()
    a = confidences(queries, scores, cfg).where(F.col("confidence") >= cfg.least)
    a = a.select("query_id", "src_ip", "registered", "ts_us", "score", "burst", "confidence", severity("confidence", CUTOFFS, "LOW").alias("severity"))
    order = {"LOW": 0, "MEDIUM": 1, "HIGH": 2, "CRITICAL": 3}

    def part(frames):
        fold = Emission(cfg)
        for f in frames:
            keep = []
            for new, t, name, level in zip(f["__new"], f["ts_us"], f["registered"], f["severity"], strict=True):
                if new:
                    fold.start()
                keep.append(fold.emits(t, name, order[level]))
            yield f[keep]

    # After a pause as long as the dedupe time nothing is remembered.
    cut = in_stretches(a, ["src_ip"], cfg.dedupe_us, "query_id")
    return cut.mapInPandas(part, cut.schema).drop("__new")
