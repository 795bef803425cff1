"""Training-table preparation, metrics and models."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def clean(df: DataFrame) -> DataFrame:
    """Infinite values become null; then distinct rows without nulls."""
    cols = [F.when(F.abs(F.col(c)) == float("inf"), None).otherwise(F.col(c)).alias(c) if t in ("double", "float") else F.col(c) for c, t in df.dtypes]
    return df.select(*cols).dropna().dropDuplicates()


def frequency_encode(rows: DataFrame, train: DataFrame, column: str) -> DataFrame:
    """The count of the row's category in the training rows; 0 for unseen ones."""
    counts = train.groupBy(column).agg(F.count("*").alias("freq"))
    return rows.join(counts, column, "left").withColumn("freq", F.coalesce("freq", F.lit(0)))


def split_captures(rows: DataFrame, train: float = 0.6, valid: float = 0.8) -> DataFrame:
    """0 train, 1 validation, 2 test: whole captures, stratified by label, in an order given by a hash."""
    w = Window.partitionBy("label")
    rn = F.row_number().over(w.orderBy(F.md5(F.col("capture").cast("string").cast("binary"))))
    out = rows.select("capture", "label", rn.alias("rn"), F.count("*").over(w).alias("n"))
    return out.select("capture", "label", F.when(F.col("rn") <= F.ceil(F.col("n") * train), 0).when(F.col("rn") <= F.ceil(F.col("n") * valid), 1).otherwise(2).alias("split"))


def confusion(e: DataFrame, threshold: float) -> DataFrame:
    hit, y = F.col("score") >= threshold, F.col("y") == 1
    c = e.agg(F.count_if(hit & y).alias("tp"), F.count_if(hit & ~y).alias("fp"), F.count_if(~hit & y).alias("fn"), F.count_if(~hit & ~y).alias("tn"))
    n = F.col("tp") + F.col("fp") + F.col("fn") + F.col("tn")
    return c.select("tp", "fp", "fn", "tn", F.round((F.col("tp") + F.col("tn")) / n, 6).alias("accuracy"), F.round(2 * F.col("tp") / F.greatest(2 * F.col("tp") + F.col("fp") + F.col("fn"), F.lit(1)), 6).alias("f1"))


def encoded(rows: DataFrame, drop: tuple[str, ...] = ("flow_id", "src_ip", "dst_ip", "path")) -> DataFrame:
    """Rows for training: TCP 0, UDP 1, other protocols -1; identifiers dropped."""
    p = F.upper(F.trim("protocol"))
    return rows.drop(*drop).withColumn("protocol", F.when(p == "TCP", 0).when(p == "UDP", 1).otherwise(-1))


def with_split(rows: DataFrame, splits: DataFrame) -> DataFrame:
    """Rows with the split of their capture."""
    return rows.join(splits.select("capture", "split"), "capture")


def report(e: DataFrame, threshold: float) -> DataFrame:
    """(class, precision, recall, f1, support) of both classes."""
    c = confusion(e, threshold)
    part = lambda a, b: F.round(F.when(F.col(a) + F.col(b) > 0, F.col(a) / F.nullif(F.col(a) + F.col(b), F.lit(0))).otherwise(0.0), 6)
    f1 = lambda a, b, d: F.round(2 * F.col(a) / F.greatest(2 * F.col(a) + F.col(b) + F.col(d), F.lit(1)), 6)
    rows = [F.struct(F.lit(k).alias("class"), part(a, b).alias("precision"), part(a, d).alias("recall"), f1(a, b, d).alias("f1"), (F.col(a) + F.col(d)).alias("support")) for k, a, b, d in ((0, "tn", "fn", "fp"), (1, "tp", "fp", "fn"))]
    return c.select(F.explode(F.array(*rows)).alias("r")).select("r.*")


def auc(e: DataFrame, cells: int = 4096) -> DataFrame:
    """Rank-sum AUC from the counts of each distinct score. The scores (0 to 1) are cut into cells; a first prefix sum runs
    over the cells' totals, of which there are ``cells``, and a second one within each cell."""
    v = e.groupBy("score").agg(F.count_if(F.col("y") == 1).alias("p"), F.count_if(F.col("y") == 0).alias("q"))
    v = v.withColumn("cell", F.least(F.greatest(F.floor(F.col("score") * cells), F.lit(0)), F.lit(cells)).cast("int"))
    totals = v.groupBy("cell").agg(F.sum("q").alias("t"))
    before = totals.select("cell", F.coalesce(F.sum("t").over(Window.orderBy("cell").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"))
    within = F.coalesce(F.sum("q").over(Window.partitionBy("cell").orderBy("score").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    s = v.join(F.broadcast(before), "cell").withColumn("w", F.col("p") * (F.col("before") + within + F.col("q") / 2.0))
    return s.agg(F.round(F.sum("w") / (F.sum("p").cast("double") * F.sum("q")), 6).alias("auc"))


def sweep(e: DataFrame, low: int = 10, high: int = 90) -> DataFrame:
    """The threshold with the best F1, the first of equals, from one histogram of scores in hundredths."""
    # A row counts for the thresholds up to its score; floor is corrected for products just below a hundredth.
    cell = F.greatest(F.lit(low - 1), F.least(F.lit(high), F.floor(F.col("score") * 100)))
    cell = F.when((cell < high) & (F.col("score") >= (cell + 1) / 100.0), cell + 1).when((cell >= low) & (F.col("score") < cell / 100.0), cell - 1).otherwise(cell)
    h = e.groupBy(cell.cast("int").alias("c")).agg(F.count_if(F.col("y") == 1).alias("p"), F.count_if(F.col("y") == 0).alias("q"))
    t = e.sparkSession.range(low, high + 1).select(F.col("id").cast("int").alias("t"), F.explode(F.sequence(F.lit(low - 1), F.lit(high))).alias("c"))
    s = t.join(F.broadcast(h), "c", "left").groupBy("t").agg(*[F.coalesce(F.sum(F.when(x, F.col(k))), F.lit(0)).alias(n) for x, k, n in ((F.col("c") >= F.col("t"), "p", "tp"), (F.col("c") >= F.col("t"), "q", "fp"), (F.col("c") < F.col("t"), "p", "fn"))])
    f1 = 2 * F.col("tp") / F.greatest(2 * F.col("tp") + F.col("fp") + F.col("fn"), F.lit(1))
    return s.select(F.col("t").alias("threshold_pct"), f1.alias("f")).orderBy(F.desc("f"), "threshold_pct").limit(1).select("threshold_pct", F.round("f", 6).alias("f1"))


def trigram_counts(words: DataFrame, column: str) -> DataFrame:
    """(ctx, ch, n, weight): sums of log1p(count) over the positions of ^^word$."""
    w = F.concat(F.lit("^^"), F.col(column), F.lit("$"))
    at = words.select(w.alias("w"), "count").select("w", "count", F.explode(F.sequence(F.lit(3), F.length("w"))).alias("i"))
    return at.groupBy(F.expr("substring(w, i - 2, 2)").alias("ctx"), F.expr("substring(w, i, 1)").alias("ch")).agg(F.count("*").alias("n"), F.sum(F.log1p(F.col("count").cast("double"))).alias("weight"))


def trigram_logp(names: DataFrame, lm: DataFrame, column: str, add: float = 0.05, symbols: int = 38, digits: int | None = 5) -> DataFrame:
    """Mean log probability of each name's trigrams; the model is joined to the distinct names' trigrams."""
    w = F.concat(F.lit("^^"), F.col(column), F.lit("$"))
    g = names.select(column, w.alias("w")).select(column, "w", F.explode(F.sequence(F.lit(3), F.length("w"))).alias("i"))
    g = g.select(column, F.expr("substring(w, i - 2, 2)").alias("ctx"), F.expr("substring(w, i, 1)").alias("ch"))
    total = lm.groupBy("ctx").agg(F.sum("weight").alias("tot"))
    j = g.join(lm, ["ctx", "ch"], "left").join(total, "ctx", "left")
    p = F.log((F.coalesce("weight", F.lit(0.0)) + add) / (F.coalesce("tot", F.lit(0.0)) + add * symbols))
    mean = F.avg(p)
    return j.groupBy(column).agg((mean if digits is None else F.round(mean, digits)).alias("trigram_logp"))


def word_coverage(names: DataFrame, words: DataFrame, column: str, least: int = 3, most: int = 15) -> DataFrame:
    """Share of each distinct name that disjoint dictionary words cover; symbols other than letters are left out first.

    The names' substrings are joined with the dictionary, and a fold over the name's places keeps the most symbols
    covered so far, so the dictionary may be of any size.
    """
    n = names.select(column).distinct().withColumn("__s", F.regexp_replace(column, r"[^\p{L}]", ""))
    ends = n.where(F.length("__s") >= least).select("__s").distinct().select("__s", F.explode(F.sequence(F.lit(least), F.length("__s"))).alias("e"))
    subs = ends.select("__s", "e", F.explode(F.sequence(F.lit(least), F.least(F.lit(most), F.col("e")))).alias("k")).withColumn("word", F.expr("substring(__s, e - k + 1, k)"))
    hits = subs.join(words.select("word").distinct(), "word").groupBy("__s").agg(F.collect_list(F.struct("e", "k")).alias("hits"))
    best = F.expr("""aggregate(sequence(1, length(__s)), array(0), (b, i) -> concat(b, array(greatest(element_at(b, -1),
        array_max(concat(array(0), transform(filter(hits, h -> h.e = i), h -> element_at(b, i - h.k + 1) + h.k)))))), b -> element_at(b, -1))""")
    out = n.join(hits, "__s", "left")
    return out.select(column, F.when(F.col("hits").isNull(), 0.0).otherwise(best / F.length(column)).alias("coverage"))


def forest_scores(rows: DataFrame, features: list[str], label: str, key: str, trees: int = 10) -> DataFrame:
    """Train a random forest on the rows whose key hashes below 60 %, score all; missing features count as 0."""
    from pyspark.ml.classification import RandomForestClassifier
    from pyspark.ml.feature import VectorAssembler
    from pyspark.ml.functions import vector_to_array

    filled = rows.select(key, label, *[F.coalesce(F.col(c).cast("double"), F.lit(0.0)).alias(c) for c in features])
    data = VectorAssembler(inputCols=features, outputCol="features").transform(filled)
    model = RandomForestClassifier(labelCol=label, featuresCol="features", numTrees=trees, maxDepth=5, seed=7).fit(data.where(F.pmod(F.xxhash64(key), F.lit(10)) < 6))
    return model.transform(data).select(key, label, F.round(vector_to_array("probability")[1], 6).alias("probability"))
