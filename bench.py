"""Time the headline queries. Prints one JSON line.

BENCH_SF_DIR (default /root/testdata/sf0.1) and BENCH_CPUS (default 8) choose data and cores. Every result is
written to the no-op sink, so all rows and columns are computed.
"""

from __future__ import annotations

import json
import os
import time

from souklens.plans.registry import all_queries, runner
from souklens.session import build_session

HEADLINE = [
    "w01_product_velocity", "j16_trending", "a08_velocity_summary", "w05_price_drops", "w06_price_series", "a29_price_trends",
    "j08_knn", "j10_match_tiered", "j12_title_match", "c05_leader_clusters", "j21_hamming_join",
    "s06_upsert_coalesce", "u03_merge_catalogues", "c01_classify_keywords", "a35_taxonomy_counts", "x04_extract_amazon_grid",
    "p12_extract_keywords", "p32_compute_margins", "j05_unmatched_bestsellers", "a02_category_stats", "a19_category_summary",
    "a30_detect_opportunities", "a34_price_bands", "c09_product_report", "t03_velocity_stream",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = build_session("souklens-bench", master=f"local[{cpus}]", **{
        "spark.sql.shuffle.partitions": cpus, "spark.ui.enabled": "false", "spark.driver.memory": "16g"})
    spark.sparkContext.setLogLevel("OFF")
    found = all_queries()
    spark.range(1000).selectExpr("sum(id)").collect()
    runner(found["j08_knn"])(spark, sf_dir).limit(1).collect()  # starts the Python workers
    timings: dict[str, float] = {}
    for name in HEADLINE:
        start = time.perf_counter()
        runner(found[name])(spark, sf_dir).write.format("noop").mode("overwrite").save()
        timings[name] = round(time.perf_counter() - start, 3)
    print(json.dumps({"metric": "headline_queries_total", "value": round(sum(timings.values()), 3), "unit": "sec", "queries": timings,
                      "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf"), "cpus": int(cpus)}))
    spark.stop()


if __name__ == "__main__":
    main()
