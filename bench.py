"""Time every registered query and print one JSON line.

``BENCH_SF_DIR`` is the table folder, ``BENCH_CPUS`` the local cores, ``BENCH_QUERIES`` an
optional comma-separated list of names.
"""

from __future__ import annotations

import json
import os
import time

from pyspark.sql import SparkSession

from coverlay.queries import QUERIES


def session(cpus: int) -> SparkSession:
    return (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("coverlay-bench")
        .config("spark.driver.memory", "8g")
        .config("spark.sql.shuffle.partitions", str(cpus))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.python.sql.dataFrameDebugging.enabled", "false")
        # The given tables are single files of one row group: deal them out to all cores.
        .config("spark.coverlay.scanPartitions", str(cpus))
        .config("spark.checkpoint.dir", os.environ.get("BENCH_CHECKPOINTS", "/tmp/coverlay-bench"))
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    chosen = [n for n in os.environ.get("BENCH_QUERIES", "").split(",") if n] or list(QUERIES)
    spark = session(int(os.environ.get("BENCH_CPUS", "8")))
    spark.sparkContext.setLogLevel("ERROR")
    seconds: dict[str, float] = {}
    # Start the JVM and the Python workers before timing.
    QUERIES["projected_scan"](spark, folder).count()
    QUERIES["building_measures"](spark, folder).count()
    for name in chosen:
        begin = time.perf_counter()
        QUERIES[name](spark, folder).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.perf_counter() - begin, 3)
    total = round(sum(seconds.values()), 3)
    scale = os.path.basename(folder.rstrip("/")).removeprefix("sf")
    print(json.dumps({"metric": "all_queries", "value": total, "unit": "sec", "queries": seconds, "sf": scale}))
    spark.stop()


if __name__ == "__main__":
    main()
