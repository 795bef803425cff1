"""Operator 5: secret scans with an incremental blob ledger, in DataFrame functions only.

Every version of every text is addressed by its SHA-256. Only (blob, rule, rule version) triples that the ledger does
not hold are scanned, each blob once however many paths carry it; the findings are then joined back to all paths.

Positions come from two aligned functions: the pieces between matches (``split``) and the matches
(``regexp_extract_all``) of one pattern have lengths that add up to each match's place in code points.

Defined cases: null text counts as empty; an empty table gives no rows; repeated rows and copies get the same findings;
a rule whose version changes is scanned again for all blobs; extra columns are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Rule:
    kind: str
    version: int
    #: matches are leftmost and do not overlap
    pattern: str
    #: a match counts if this group has ``least`` characters
    group: int
    least: int
    #: texts without this string need no scan
    hint: str | None = None


#: Fixed values of the contract; a run of at least ``least`` characters is the same match as a long enough maximal run.
RULES = (
    Rule("assign", 1, r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6),
    Rule("access", 1, r"AKIA[A-Z0-9]{16,}", 0, 20, "AKIA"),
    Rule("hex", 1, r"[0-9a-f]{24,}", 0, 24),
)
SPANS = "array<struct<start:int,end:int>>"
SCANS = f"array<struct<rule:string,version:int,spans:{SPANS}>>"


def _spans(found: Column, keys: Column, gaps: Column, rule: Rule) -> Column:
    """Start and end (exclusive) of the matches that count, from the matches, their key groups and the text between."""
    rows = F.arrays_zip(found.alias("m"), keys.alias("k"), F.slice(gaps, 1, F.size(found)).alias("g"))
    start = F.struct(F.lit(0).alias("at"), F.array().cast(SPANS).alias("out"))

    def step(acc, x):
        lo = acc["at"] + F.length(x["g"])
        hi = lo + F.length(x["m"])
        one = F.array(F.struct(lo.alias("start"), hi.alias("end")))
        return F.struct(hi.alias("at"), F.when(F.length(x["k"]) >= rule.least, F.concat(acc["out"], one)).otherwise(acc["out"]).alias("out"))

    return F.aggregate(rows, start, step, lambda acc: acc["out"])


def scan(blobs: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """(sha, scans) of (sha, text, todo): todo holds the ``kind:version`` names that are to be scanned."""
    wanted = {r: F.array_contains("todo", f"{r.kind}:{r.version}") for r in rules}

    def matches(r: Rule, group: int) -> Column:
        ask = wanted[r] if r.hint is None else wanted[r] & F.contains("text", F.lit(r.hint))
        return F.when(ask, F.regexp_extract_all("text", F.lit(r.pattern), F.lit(group))).otherwise(F.array().cast("array<string>"))

    out = blobs.select("sha", "text", "todo", *[matches(r, 0).alias(f"m_{r.kind}") for r in rules])
    hit = {r: F.size(f"m_{r.kind}") > 0 for r in rules}
    none = F.array().cast("array<string>")
    out = out.select(
        "sha", "todo", *[f"m_{r.kind}" for r in rules],
        *[F.when(hit[r], F.regexp_extract_all("text", F.lit(r.pattern), F.lit(r.group)) if r.group else F.col(f"m_{r.kind}")).otherwise(none).alias(f"k_{r.kind}") for r in rules],
        *[F.when(hit[r], F.split("text", r.pattern, -1)).otherwise(none).alias(f"g_{r.kind}") for r in rules],
    )
    each = [F.when(wanted[r], F.struct(F.lit(r.kind).alias("rule"), F.lit(r.version).alias("version"), _spans(F.col(f"m_{r.kind}"), F.col(f"k_{r.kind}"), F.col(f"g_{r.kind}"), r).alias("spans"))) for r in rules]
    return out.select("sha", F.array_compact(F.array(*each)).cast(SCANS).alias("scans"))


def addressed(versions: DataFrame, path: str = "path") -> DataFrame:
    """(path, sha, text) with null texts as empty ones."""
    text = F.coalesce("text", F.lit(""))
    return versions.select(F.col(path).alias("path"), F.unhex(F.sha2(text.cast("binary"), 256)).alias("sha"), text.alias("text"))


def unseen(versions: DataFrame, ledger: DataFrame | None, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """(sha, text, todo) of the distinct blobs with at least one rule version that the ledger lacks."""
    blobs = versions.groupBy("sha").agg(F.first("text").alias("text"))
    names = F.array(*[F.lit(f"{r.kind}:{r.version}") for r in rules])
    if ledger is None:
        return blobs.withColumn("todo", names)
    done = ledger.select("sha", F.explode("scans").alias("s")).groupBy("sha").agg(F.collect_set(F.concat_ws(":", "s.rule", "s.version")).alias("done"))
    todo = F.array_except(names, F.coalesce("done", F.array().cast("array<string>")))
    return blobs.join(done, "sha", "left").withColumn("todo", todo).where(F.size("todo") > 0).select("sha", "text", "todo")


def findings(versions: DataFrame, ledger: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """(path, sha, spans): every path of (path, sha) with its spans, ordered by start, then as the rules are listed."""
    order = {r.kind: i for i, r in enumerate(rules)}
    current = F.array(*[F.lit(f"{r.kind}:{r.version}") for r in rules])
    kept = F.filter("scans", lambda s: F.array_contains(current, F.concat_ws(":", s["rule"], s["version"].cast("string"))) & (F.size(s["spans"]) > 0))
    rank = F.create_map(*[F.lit(x) for kv in order.items() for x in kv])
    flat = F.flatten(F.transform(F.col("scans"), lambda s: F.transform(s["spans"], lambda x: F.struct(x["start"].alias("start"), rank[s["rule"]].alias("rank"), x["end"].alias("end"), s["rule"].alias("kind")))))
    hits = ledger.withColumn("scans", kept).where(F.size("scans") > 0).select("sha", F.explode(flat).alias("x"))
    # A blob's scans may lie in several ledger entries; blobs without findings stay out of the join.
    by_blob = hits.groupBy("sha").agg(F.array_sort(F.collect_list("x")).alias("spans"))
    return versions.select("path", "sha").join(by_blob, "sha", "left").select("path", "sha", F.coalesce("spans", F.array().cast("array<struct<start:int,rank:int,end:int,kind:string>>")).alias("spans"))


def scan_versions(versions: DataFrame, ledger: DataFrame | None = None, rules: tuple[Rule, ...] = RULES, path: str = "path") -> tuple[DataFrame, DataFrame]:
    """Findings of all paths of (path, text), and the ledger with what was scanned just now (written to the shared folder)."""
    from .common import stash

    known = addressed(versions, path)
    new = stash(scan(unseen(known, ledger, rules), rules), "secret-ledger")
    full = new if ledger is None else ledger.unionByName(new)
    return findings(known, full, rules), full


def spelled(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))), ",")


def redact(text: Column, spans: Column, mark: str = "[REDACTED]") -> Column:
    """The text with each stretch covered by spans (ordered by start) replaced by one mark."""
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<string>").alias("out"))

    def step(acc, x):
        fresh = x["start"] >= acc["at"]
        piece = F.array(F.substring(text, acc["at"] + 1, F.greatest(x["start"] - acc["at"], F.lit(0))), F.lit(mark))
        return F.struct(F.greatest(acc["at"], x["end"]).alias("at"), F.when(fresh, F.concat(acc["out"], piece)).otherwise(acc["out"]).alias("out"))

    done = F.aggregate(spans, start, step, lambda acc: F.concat(F.concat_ws("", acc["out"]), F.substring(text, acc["at"] + 1, F.length(text))))
    return F.when(F.size(spans) > 0, done).otherwise(text)


def digest(documents: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """op5: counts, checksum and spelled spans per document."""
    found, _ = scan_versions(documents, None, rules, "doc_id")
    base = F.filter("spans", lambda x: x["kind"].isin("assign", "access", "hex"))

    def count(kind: str) -> Column:
        return F.size(F.filter("spans", lambda x: x["kind"] == kind)).cast("long").alias(f"n_{kind}")

    return found.select(F.col("path").alias("doc_id"), *map(count, ("assign", "access", "hex")), F.sha2(spelled(base).cast("binary"), 256).alias("base_sha256"), spelled(F.col("spans")).alias("spans"))
