"""Headline queries, second (warm) run of each: prints one JSON line."""

import json
import os
import time

from pyspark.sql import SparkSession

SF = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
CPUS = os.environ.get("BENCH_CPUS", "8")


def main() -> None:
    spark = (
        SparkSession.builder.master(f"local[{CPUS}]").config("spark.sql.shuffle.partitions", CPUS).config("spark.driver.memory", "12g")
        .config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    from panelforge.library.alpha101 import alpha101
    from panelforge.library.alpha158 import alpha158
    from panelforge.plans.compiler import compile_factors
    from panelforge.queries import panel

    p = panel(spark, SF).cache()
    rows = p.count()
    jobs = {"alpha101": ["alpha101"], "alpha001": ["alpha001"], "alpha029": ["alpha029"], "alpha031": ["alpha031"], "alpha101_all": None}
    plans = {k: compile_factors(alpha101(v)) for k, v in jobs.items()} | {"alpha158": compile_factors(alpha158())}
    runs = {k: (lambda plan=plan: plan.run(p)) for k, plan in plans.items()}
    try:
        from panelforge.llm.registry import QUERIES

        runs |= {k: (lambda f=f: f(spark, SF)) for k, f in QUERIES.items()}
    except ModuleNotFoundError:
        pass
    took, rate = {}, {}
    for name, make in runs.items():
        for _ in range(2):
            t = time.time()
            make().write.format("noop").mode("overwrite").save()
            took[name] = round(time.time() - t, 3)
        if name in plans:
            rate[name] = round(rows * len(plans[name].outputs) / took[name])
    print(json.dumps({"metric": "seconds of all queries", "value": round(sum(took.values()), 3), "unit": "sec", "queries": took, "sf": SF, "panel_rows": rows, "cells_per_s": rate}))


if __name__ == "__main__":
    main()
