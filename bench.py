"""Time the headline queries: one JSON line.

    BENCH_SF_DIR=/root/testdata/sf0.1 BENCH_CPUS=8 python bench.py
"""

from __future__ import annotations

import json
import os
import time

from pyspark.sql import SparkSession


def main() -> None:
    sf = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("bench")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "12g")
        .config("spark.sql.shuffle.partitions", cpus)
        .config("spark.sql.session.timeZone", "UTC")
        # row groups of the small test files are the only unit of parallelism
        .config("spark.sql.files.maxPartitionBytes", "2m")
        .config("spark.sql.files.openCostInBytes", "0")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")

    from veilspan import ScanConfig
    from veilspan.functions.validators import id_quality_report
    from veilspan.operators.patterns import match_patterns
    from veilspan.operators.reports import leak_profile
    from veilspan.plans.scan import redact_table, scan
    from veilspan.sources.documents import spread
    from veilspan.sources.rules import load_catalog
    from workload.checks import VALUES

    # the table is one row group, which a single task would scan; dealing it out is part of each time
    docs = spread(spark.read.parquet(f"{sf}/documents.parquet"), 2 * int(cpus))
    orders = spread(spark.read.parquet(f"{sf}/orders.parquet"), 2 * int(cpus))
    kinds = ("luhn", "pesel", "isin", "us_ssn")
    ids = orders.selectExpr(*[f"{VALUES[k].replace('{s}', 'string')} AS {k}" for k in kinds])
    every = ScanConfig(enable_deep_scan=True, enable_entropy=True)
    runs = {
        "pattern_scan": lambda: match_patterns(docs, load_catalog(spark), gate=True),
        "redact_marker": lambda: redact_table(docs, ScanConfig()),
        "full_scan_deep_entropy": lambda: scan(docs, every),
        "leak_profile": lambda: leak_profile(
            match_patterns(docs, load_catalog(spark), gate=True), docs, "lang"
        ),
        "id_quality_report": lambda: id_quality_report(ids, {k: k for k in kinds}),
    }
    times: dict[str, float] = {}  # first run, with planning and compiling
    planned: dict[str, float] = {}  # of it, until the plan was there
    again: dict[str, float] = {}  # second run of the same plan
    for name, make in runs.items():
        start = time.time()
        df = make()
        planned[name] = round(time.time() - start, 3)
        df.write.format("noop").mode("overwrite").save()
        times[name] = round(time.time() - start, 3)
        start = time.time()
        df.write.format("noop").mode("overwrite").save()
        again[name] = round(time.time() - start, 3)
    n, size = docs.selectExpr("count(*)", "sum(octet_length(text))").first()
    print(
        json.dumps(
            {
                "metric": "total_seconds",
                "value": round(sum(times.values()), 3),
                "unit": "sec",
                "queries": times,
                "sf": os.path.basename(sf.rstrip("/")).removeprefix("sf"),
                "planned": planned,
                "second_run": again,
                "documents": n,
                "mb_per_s": {
                    k: round(size / 1e6 / times[k], 2)
                    for k in ("pattern_scan", "redact_marker", "full_scan_deep_entropy")
                },
            }
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()
