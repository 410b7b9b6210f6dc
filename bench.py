"""Times headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line."""

from __future__ import annotations

import json
import os
import sys
import tempfile
import time
from pathlib import Path

ROOT = str(Path(__file__).resolve().parent)
sys.path.insert(0, ROOT)
os.environ["PYTHONPATH"] = ":".join(x for x in (ROOT, os.environ.get("PYTHONPATH", "")) if x)
HEADLINE = ["clean_punct", "preprocess", "tokenize", "norm", "valid_phonetics", "gate_author_list", "parser_frequency", "batch_votes", "batch_pattern", "route_ppvys", "route_pp", "normalize_names", "paper_names"]


def main() -> None:
    from pyspark.sql import SparkSession

    from onomast.plans.catalogue import QUERIES

    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .config("spark.driver.memory", "8g")
        .config("spark.sql.shuffle.partitions", cpus)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    spark.sparkContext.setCheckpointDir("file://" + tempfile.mkdtemp(prefix="bench-"))
    spark.range(1).count()
    took = {}
    for name in HEADLINE:
        began = time.time()
        QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        took[name] = round(time.time() - began, 3)
        print(name, took[name], file=sys.stderr, flush=True)
    print(json.dumps({"metric": "total_sec", "value": round(sum(took.values()), 3), "unit": "sec", "queries": took, "sf": Path(sf_dir).name}))


if __name__ == "__main__":
    main()
