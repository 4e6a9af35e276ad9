"""Time the headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; one JSON line."""
from __future__ import annotations

import json
import os
import time

HEADLINE = ("sta01_scorecard", "agg14_reference_summary", "sta02_quantile_functions", "sta03_wasserstein", "sta06_spearman",
            "run03_observable_mask", "run08_merge_intervals", "run10_claims", "jn01_close_pairs", "jn03_crossings",
            "jn04_pair_records", "jn10_inside_taken", "agg06_visibility", "agg13_share_by_cnr", "path01_arclength",
            "ker02_gaussian", "cc01_components", "skl01_pixel_graph", "agg22_junction_reach", "rul06_observable_type",
            "top11_pair_arms", "itr06_pressures")


def main() -> None:
    sf = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    from filigrane.plans import catalog
    from filigrane.session import local_session
    spark = local_session(cpus, int(cpus) if cpus.isdigit() else 8, "bench")
    spark.sparkContext.setLogLevel("ERROR")
    spark.read.parquet(f"{sf}/lineitem.parquet").count()
    times = {}
    for name in HEADLINE:
        t = time.time()
        catalog.QUERIES[name](spark, sf).write.format("noop").mode("overwrite").save()
        times[name] = round(time.time() - t, 3)
    print(json.dumps({"metric": "headline_queries_total", "value": round(sum(times.values()), 3), "unit": "sec",
                      "queries": times, "sf": os.path.basename(sf.rstrip("/")).replace("sf", "")}))
    spark.stop()


if __name__ == "__main__":
    main()
