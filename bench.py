"""Time the headline queries and print one JSON line.

BENCH_SF_DIR (default /root/testdata/sf0.1) and BENCH_CPUS (default 8) choose data and cores.
"""
from __future__ import annotations

import json
import os
import time

from spatialscore.session import local_session

HEADLINE = [
    "b06_flagged_subset_report", "a10_all_scores", "b01_scores_by_distance", "b02_equal_count_bins", "b21_score_spread",
    "a10_all_scores_from_draws", "d04_areal_draws", "d09_urban_threshold", "d17_weighted_quantiles", "d18_grid_variogram",
    "j03_point_in_polygon", "j05_nearest_observation", "j07_stratified_distances", "j09_k_nearest", "j10_bilinear_raster",
    "j17_basis_entries", "u06_stratified_folds", "w01_rank_methods", "m03_block_likelihood", "m05_local_kriging", "m07_trend_fit",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = int(os.environ.get("BENCH_CPUS", "8"))
    only = [n for n in os.environ.get("BENCH_ONLY", "").split(",") if n]
    spark = local_session(cpus, shuffle_partitions=cpus, memory="16g")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "2m")  # the bench's tables are small files
    spark.range(1000).selectExpr("sum(id)").collect()  # start the executors before the clock
    from spatialscore.plans.catalogue import QUERIES
    times = {}
    for name in only or HEADLINE:
        start = time.perf_counter()
        QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        times[name] = round(time.perf_counter() - start, 3)
    print(json.dumps({"metric": "headline_queries_total", "value": round(sum(times.values()), 3), "unit": "sec",
                      "queries": times, "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf")}))
    spark.stop()


if __name__ == "__main__":
    main()
