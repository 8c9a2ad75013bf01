"""Time the steps of a selection over a generated pool of $POOL_ROWS records (3.3 million) with 30 metrics; prints one JSON line.

The driver, which in local mode is the executor too, gets $POOL_MEMORY (4g).
"""

import json
import os
import shutil
import sys
import tempfile
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))


def main() -> None:
    from pyspark.sql import SparkSession
    from pyspark.sql import functions as F

    from scoresieve.operators import normalize, scoring, selection
    from scoresieve.plans.search import select
    from scoresieve.sources import index

    rows, cpus = int(os.environ.get("POOL_ROWS", "3300000")), os.environ.get("BENCH_CPUS", "8")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]").config("spark.sql.shuffle.partitions", cpus).config("spark.driver.memory", os.environ.get("POOL_MEMORY", "4g"))
        .config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false").getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    folder, keys, times = tempfile.mkdtemp(), [f"m{i}" for i in range(30)], {}

    def timed(name, f):
        began = time.time()
        out = f()
        times[name] = round(time.time() - began, 2)
        return out

    noop = lambda df: df.write.format("noop").mode("overwrite").save()
    try:
        made = spark.range(rows).select(F.col("id").alias("line_idx"), *(F.randn(i).alias(k) if i % 3 else F.floor(F.rand(i) * 1000).cast("double").alias(k) for i, k in enumerate(keys)))
        timed("write the index", lambda: index.save_index(made, f"{folder}/index", 16))
        table = index.load_index(spark, f"{folder}/index")
        limits = normalize.bounds_dict(timed("exact percentiles of 30 metrics", lambda: normalize.bounds(table, keys, 5, 95)))
        timed("normalise all", lambda: noop(normalize.normalized(table, limits)))
        weights = {k: 1 / 30 for k in keys}
        timed("top 1500, from files", lambda: select(table, weights, 1500).collect())
        held = table.persist()
        held.count()
        for _ in range(3):
            timed("top 1500, index in memory", lambda: select(held, weights, 1500).collect())
        timed("top 10 %, file order", lambda: noop(selection.top_percent(scoring.weighted(held, weights).select("line_idx", "_weighted_score"), "_weighted_score", 10)))
    finally:
        shutil.rmtree(folder, ignore_errors=True)
    print(json.dumps({"rows": rows, "metrics": 30, "cpus": int(cpus), "seconds": times}))


if __name__ == "__main__":
    main()
