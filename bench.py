"""Times the registered queries and prints one JSON line.

BENCH_SF_DIR names the table folder, BENCH_CPUS the local cores, BENCH_QUERIES (optional) a comma list.
Each query is run in full into Spark's no-op sink, after a warm-up. Three steps are timed by themselves
as well, as the median of three runs: training with the newer and the older settings, packing a model's items into
"""

from __future__ import annotations

import json
import os
import re
import statistics
import time

from pyspark.sql import DataFrame, SparkSession

from starpath.plans import als, fixtures
from starpath.plans.catalog import QUERIES
from starpath.session import build_session, cut_lineage

STEPS = ("als_fit_rank12_iter20", "als_fit_rank10_iter10", "als_pack_items", "als_score_one_user")
REPEATS = 3


def run(df: DataFrame) -> None:
    df.write.format("noop").mode("overwrite").save()


def time_steps(spark: SparkSession, folder: str) -> dict[str, float]:
    """Median seconds for the steps in ``STEPS``; the first user of the ratings is the one scored."""
    ratings = fixtures.ratings(spark, folder)
    rated = ratings.select("user_id", "item_id")
    one = cut_lineage(rated.join(rated.select("user_id").orderBy("user_id").limit(1), "user_id", "left_semi"))
    taken: dict[str, list[float]] = {step: [] for step in STEPS}
    for _ in range(REPEATS):
        start = time.perf_counter()
        model = als.train(ratings)
        newer = time.perf_counter()
        als.train(ratings, als.OLDER)
        older = time.perf_counter()
        blocks = als.packed_items(model, fixtures.stores(spark, folder))
        packed = time.perf_counter()
        run(als.recommend(model, one, fixtures.stores(spark, folder), blocks=blocks))
        for step, value in zip(STEPS, (newer - start, older - newer, packed - older, time.perf_counter() - packed)):
            taken[step].append(value)
    return {step: round(statistics.median(values), 3) for step, values in taken.items()}


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    wanted = os.environ.get("BENCH_QUERIES")
    names = [name for name in wanted.split(",") if name != "steps"] if wanted else list(QUERIES)
    spark = build_session(f"local[{cpus}]", int(cpus) if cpus.isdigit() else 8, **{
        "spark.ui.enabled": "false",
        "spark.driver.memory": "12g",
        "spark.ui.showConsoleProgress": "false",
    })
    spark.sparkContext.setLogLevel("ERROR")
    for warm_up in ("ratings_summary", "ratings_by_slice"):
        run(QUERIES[warm_up](spark, folder))
    seconds: dict[str, float] = {}
    for name in names:
        start = time.perf_counter()
        run(QUERIES[name](spark, folder))
        seconds[name] = round(time.perf_counter() - start, 3)
    if not wanted or "steps" in wanted.split(","):
        seconds.update(time_steps(spark, folder))
    scale = re.search(r"sf([0-9.]+)", folder)
    print(json.dumps({
        "metric": "total_query_time",
        "value": round(sum(seconds.values()), 3),
        "unit": "sec",
        "queries": seconds,
        "sf": float(scale.group(1)) if scale else None,
    }))
    spark.stop()


if __name__ == "__main__":
    main()
