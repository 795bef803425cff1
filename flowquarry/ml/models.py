"""Flow classifiers: forests and boosted trees, compared on held-out captures, saved with their threshold, and served."""

from __future__ import annotations

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import GBTClassifier, RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.scalars import severity
from .tabular import auc, confusion, sweep


def forest(trees: int = 300, depth: int = 20, seed: int = 42) -> RandomForestClassifier:
    return RandomForestClassifier(labelCol="label", featuresCol="features", weightCol="weight", numTrees=trees, maxDepth=depth, seed=seed)


def boosted(rounds: int = 300, depth: int = 5, step: float = 0.05, seed: int = 42) -> GBTClassifier:
    return GBTClassifier(labelCol="label", featuresCol="features", weightCol="weight", maxIter=rounds, maxDepth=depth, stepSize=step, seed=seed)


def _filled(rows: DataFrame, features: list[str]) -> DataFrame:
    """The features as doubles, 0 where one is null, not finite or missing."""
    def value(c: str):
        if c not in rows.columns:
            return F.lit(0.0).alias(c)
        x = F.col(c).cast("double")
        return F.when(x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")), 0.0).otherwise(x).alias(c)

    return rows.select(*[c for c in rows.columns if c not in features], *[value(c) for c in features])


def _scored(model: PipelineModel, rows: DataFrame, features: list[str]) -> DataFrame:
    return model.transform(_filled(rows, features)).withColumn("score", vector_to_array("probability")[1])


def importances(model: PipelineModel, features: list[str], most: int = 20) -> list[tuple[str, float]]:
    values = model.stages[-1].featureImportances.toArray()
    return sorted(zip(features, map(float, values), strict=True), key=lambda x: (-x[1], x[0]))[:most]


def compare(rows: DataFrame, features: list[str], kinds: dict, path: str, train: int = 2) -> DataFrame:
    """Train each kind on the rows whose split is up to ``train``, choose its threshold on the next split, test on the
    rest. Saves the best by F1 (model, features, threshold) and the comparison as CSV; returns the comparison, best first."""
    spark = rows.sparkSession
    share = rows.where(F.col("split") <= train).agg(F.avg("label").alias("p")).first().p or 0.5
    data = _filled(rows, features).withColumn("weight", F.when(F.col("label") == 1, (1 - share) / max(share, 1e-9)).otherwise(1.0))
    found = []
    for name, kind in kinds.items():
        model = Pipeline(stages=[VectorAssembler(inputCols=features, outputCol="features"), kind]).fit(data.where(F.col("split") <= train))
        s = _scored(model, data, features).select("split", F.col("label").alias("y"), "score")
        valid, test = s.where(F.col("split") == train + 1), s.where(F.col("split") > train + 1)
        threshold = sweep(valid).first().threshold_pct / 100.0
        m, area = confusion(test, threshold).first(), auc(test).first().auc
        top = importances(model, features, 1)[0][0]
        found.append((float(m.f1), name, threshold, float(m.accuracy), float(area or 0.0), top, model))
    found.sort(key=lambda x: (-x[0], x[1]))
    best = found[0]
    best[-1].write().overwrite().save(f"{path}/model")
    side = [(f, i, best[1], best[2]) for i, f in enumerate(features)]
    spark.createDataFrame(side, "feature string, place int, model string, threshold double").coalesce(1).write.mode("overwrite").json(f"{path}/sidecar")
    table = spark.createDataFrame([(i + 1, n, f1, t, a, u, top) for i, (f1, n, t, a, u, top, _) in enumerate(found)], "rank int, model string, f1 double, threshold double, accuracy double, auc double, top_feature string")
    table.coalesce(1).write.mode("overwrite").option("header", "true").csv(f"{path}/comparison")
    return table


def predict(spark: SparkSession, rows: DataFrame, path: str, need_ja3: bool = False) -> DataFrame:
    """``rows`` with probability, verdict, confidence in it, and severity, by the saved model; missing features count as 0.

    With ``need_ja3`` only flows that show a fingerprint are judged, as in the integrated path."""
    side = spark.read.json(f"{path}/sidecar").orderBy("place").collect()
    features, threshold = [r.feature for r in side], side[0].threshold
    if need_ja3:
        rows = rows.where("ja3 is not null")
    scored = _scored(PipelineModel.load(f"{path}/model"), rows, features)
    p = F.col("probability")
    out = scored.drop("probability", "features", "rawPrediction", "prediction").withColumnRenamed("score", "probability")
    bad = p >= threshold
    return out.withColumns({"threshold": F.lit(threshold), "malware": bad.cast("int"), "confidence": F.when(bad, p).otherwise(1 - p), "severity": F.when(bad, severity("probability", ((0.9, "HIGH"), (0.7, "MEDIUM")), "LOW"))})
