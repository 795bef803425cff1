"""Command line: ``spark-submit -m flowquarry`` or ``python -m flowquarry COMMAND``.

  list                                   names of the catalogue's queries
  run QUERY --data DIR --out DIR         a query over a folder of tables, written as Parquet
  parse CAPTURES --out DIR               captures as packet records (JSON lines) with the parser's report
  import-iocs CSV --out DIR [--into DIR] indicators from CSV, upserted into a table
  train ROWS --out DIR                   a classifier from Parquet rows with label, split and the vector's features
  predict ROWS --model DIR --out DIR     its verdicts
"""

from __future__ import annotations

import argparse

from pyspark.sql import SparkSession
from pyspark.sql import functions as F


def _session() -> SparkSession:
    return SparkSession.builder.appName("flowquarry").config("spark.sql.session.timeZone", "UTC").getOrCreate()


def main(argv: list[str] | None = None) -> int:
    p = argparse.ArgumentParser(prog="flowquarry", description=__doc__, formatter_class=argparse.RawDescriptionHelpFormatter)
    sub = p.add_subparsers(dest="command", required=True)
    sub.add_parser("list")
    for name, first in (("run", "query"), ("parse", "source"), ("import-iocs", "source"), ("train", "source"), ("predict", "source")):
        s = sub.add_parser(name)
        s.add_argument(first)
        s.add_argument("--out", required=True)
        s.add_argument("--data")
        s.add_argument("--into")
        s.add_argument("--model")
    a = p.parse_args(argv)
    if a.command == "list":
        from .plans import all_queries

        print("\n".join(sorted(all_queries()[0])))
        return 0
    spark = _session()
    if a.command == "run":
        from .plans import all_queries

        all_queries()[0][a.query](spark, a.data).write.mode("overwrite").parquet(a.out)
    elif a.command == "parse":
        from .sources import captures

        packets = captures.read_packets(spark, a.source)
        packets.where("proto is not null").drop("payload").write.mode("overwrite").json(f"{a.out}/records")
        captures.report(packets).coalesce(1).write.mode("overwrite").json(f"{a.out}/report")
    elif a.command == "import-iocs":
        from .operators.joins import upsert
        from .sources.feeds import read_iocs

        rows = read_iocs(spark, a.source).withColumn("seq", F.lit(1))
        if a.into:
            rows = rows.unionByName(spark.read.parquet(a.into).withColumn("seq", F.lit(0)), allowMissingColumns=True)
        upsert(rows).drop("seq").write.mode("overwrite").parquet(a.out)
    elif a.command == "train":
        from .ml import models
        from .operators.records import TLS_FEATURES

        models.compare(spark.read.parquet(a.source), list(TLS_FEATURES), {"forest": models.forest(), "boosted": models.boosted()}, a.out).show(truncate=False)
    else:
        from .ml import models

        models.predict(spark, spark.read.parquet(a.source), a.model).write.mode("overwrite").parquet(a.out)
    return 0


if __name__ == "__main__":
    raise SystemExit(main())
