"""Sliding windows as running sums of changes.

An event adds one to a count at its own time and takes it away again when it leaves the window; the count at any time
is the sum of the changes up to it. No row holds a window's members, and the time axis is cut into cells as long as
the window: an event is known in its own cell and the next one, so a busy key is dealt out by its cells. Everything
within a (key, cell) happens after one shuffle, by local sorts. Events at the same time count together.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

CHANGE = "array<struct<at:bigint,name:string,d:int>>"


def _change(cond: Column | None, at: Column, name: str, d: int) -> Column:
    x = F.struct(at.cast("long").alias("at"), F.lit(name).alias("name"), F.lit(d).alias("d"))
    return x if cond is None else F.when(cond, x)


def _stay(us: int, name: str) -> list[Column]:
    """When an item enters and leaves the window, given its times before and after; a repeat within it prolongs the stay."""
    t, before, after = F.col("__t"), F.col(f"__before_{name}"), F.col(f"__after_{name}")
    return [_change(before.isNull() | (t - before > us), t, name, 1), _change(after.isNull() | (after - t > us), t + us + 1, name, -1)]


def _most_of(rows: DataFrame, place: list[str], group: list[str], us: int, name: str) -> DataFrame:
    """Changes whose running sum is the largest count of any one group: one unit for each level that some group has reached."""
    stay = rows.select(*place, *group, F.explode(F.array_compact(F.array(*_stay(us, name)))).alias("x")).select(*place, *group, "x.at", "x.d")
    inner = Window.partitionBy(*place, *group).orderBy("at", F.desc("d")).rowsBetween(Window.unboundedPreceding, 0)
    count = stay.withColumn("n", F.sum("d").over(inner))
    level = count.select(*place, "at", "d", F.when(F.col("d") > 0, F.col("n")).otherwise(F.col("n") + 1).alias("level"))
    net = level.groupBy(*place, "level", "at").agg(F.sum("d").alias("d")).where("d <> 0")
    held = net.withColumn("held", F.sum("d").over(Window.partitionBy(*place, "level").orderBy("at").rowsBetween(Window.unboundedPreceding, 0)))
    now, was = (F.col("held") > 0).cast("int"), (F.col("held") - F.col("d") > 0).cast("int")
    return held.select(*place, "at", F.lit(name).alias("name"), (now - was).cast("int").alias("d")).where("d <> 0")


def sliding_counts(events: DataFrame, key: list[str], us: int, distinct: dict[str, list[str]], most: dict[str, tuple[list[str], list[str]]] | None = None, spans: dict[str, tuple[Column, Column]] | None = None, probes: DataFrame | None = None) -> DataFrame:
    """``probes`` (ts_us, key, ...; the events themselves where none are given) with counts of events over the last ``us``.

    distinct: column name -> columns whose combinations are counted (none: the events themselves). most: column name ->
    (group columns, item columns): the most distinct items of any one group. spans: column name -> first and last time
    at which an event counts, both within the window after it; null times do not count.
    """
    most, spans = most or {}, spans or {}
    used = sorted({c for item in distinct.values() for c in item} | {c for g, i in most.values() for c in (*g, *i)})
    edges = [F.struct(a.cast("long").alias("a"), b.cast("long").alias("b")).alias(f"__span_{n}") for n, (a, b) in spans.items()]
    asked = events if probes is None else probes
    payload = F.struct(*[F.col(f"`{c}`") for c in asked.columns])
    cols = [*[F.col(k).alias(f"__k{i}") for i, k in enumerate(key)], F.col("ts_us").cast("long").alias("__t")]
    rows = events.select(*cols, *[F.col(c).alias(f"__i_{c}") for c in used], *edges, F.lit(True).alias("__event"), (payload if probes is None else F.lit(None)).alias("__row"))
    if probes is not None:
        rows = rows.drop("__row").unionByName(probes.select(*cols, payload.alias("__row"), F.lit(False).alias("__event")), allowMissingColumns=True)
    cell = F.expr(f"__t div {us}")
    place = [*[f"__k{i}" for i in range(len(key))], "__cell"]
    rows = rows.withColumn("__cell", F.explode(F.when(F.col("__event"), F.array(cell, cell + 1)).otherwise(F.array(cell)))).repartition(*place)
    for name, item in [*((n, i) for n, i in distinct.items() if i), *((n, [*g, *i]) for n, (g, i) in most.items())]:
        w = Window.partitionBy(*place, "__event", *[f"__i_{c}" for c in item]).orderBy("__t")
        rows = rows.withColumns({f"__before_{name}": F.lag("__t").over(w), f"__after_{name}": F.lead("__t").over(w)})
    entries = []
    for name, item in distinct.items():
        entries += _stay(us, name) if item else [_change(None, F.col("__t"), name, 1), _change(None, F.col("__t") + us + 1, name, -1)]
    for name in spans:
        a, b = F.col(f"__span_{name}.a"), F.col(f"__span_{name}.b")
        some = a.isNotNull() & (a <= b)
        entries += [_change(some, a, name, 1), _change(some, b + 1, name, -1)]
    own = F.when(F.col("__row").isNotNull() & (F.col("__cell") == cell), F.array(_change(None, F.col("__t"), "", 0)))
    none = F.array().cast(CHANGE)
    of_event = F.when(F.col("__event"), F.array_compact(F.array(*entries)).cast(CHANGE)).otherwise(none) if entries else none
    changes = rows.select(*place, "__row", F.explode(F.concat(of_event, F.coalesce(own.cast(CHANGE), none))).alias("x"))
    changes = changes.select(*place, "x.at", "x.name", "x.d", F.when(F.col("x.name") == "", F.col("__row")).alias("__row"))
    for name, (group, _) in most.items():
        more = _most_of(rows.where("__event"), place, [f"__i_{c}" for c in group], us, name)
        changes = changes.unionByName(more, allowMissingColumns=True)
    w = Window.partitionBy(*place).orderBy("at").rangeBetween(Window.unboundedPreceding, 0)
    names = [*distinct, *most, *spans]
    sums = changes.select("*", *[F.sum(F.when(F.col("name") == n, F.col("d")).otherwise(0)).over(w).alias(f"__n_{n}") for n in names])
    return sums.where("name = ''").select("__row.*", *[F.col(f"__n_{n}").alias(n) for n in names])
