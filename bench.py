"""Times the headline queries; prints one line of JSON."""

from __future__ import annotations

import json
import os
import time

from pyspark.sql import SparkSession

from proselens.plans import registry

HEADLINE = ["rule_014_cliche", "rule_015_hedging", "rule_016_vocabulary", "rule_017_parallelism", "rule_018_dashes", "rule_030_fragmentation", "rule_033_overlong", "rule_034_rotation", "rule_041_uniformity", "pipeline_suppression", "pipeline_baseline", "corpus_scoreboard", "corpus_pooled", "corpus_phrases"]


def main() -> None:
    sf_dir, cpus = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1"), os.environ.get("BENCH_CPUS", "4")
    spark = SparkSession.builder.master(f"local[{cpus}]").config("spark.sql.shuffle.partitions", str(2 * int(cpus))).config("spark.sql.files.maxPartitionBytes", "2m").config("spark.sql.files.openCostInBytes", "64k").config("spark.driver.memory", "4g").config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    queries, took = registry.queries(), {}
    queries[HEADLINE[0]](spark, sf_dir).write.format("noop").mode("overwrite").save()  # start-up isn't timed
    for name in HEADLINE:
        began = time.time()
        queries[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        took[name] = round(time.time() - began, 3)
    print(json.dumps({"metric": "total_wall", "value": round(sum(took.values()), 3), "unit": "sec", "queries": took, "sf": os.path.basename(sf_dir.rstrip("/"))}))
    spark.stop()


if __name__ == "__main__":
    main()
