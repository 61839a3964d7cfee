"""Times headline queries: one JSON line. BENCH_SF_DIR, BENCH_CPUS."""

import json
import os
import time

from tessera.plans import registry
from tessera.session import session

NAMES = ["demand_supply_jsd", "indicators", "label_top_quartile", "snapshot_latest", "jsd_monthly_delta", "ctfidf_topterms", "ppr_topk", "bridge_score", "kalman_level", "bocpd_shortrun", "fusion_score", "random_forest"]


def main() -> None:
    sf = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = session(f"local[{cpus}]", int(cpus), **{"spark.driver.memory": "8g"})
    spark.sparkContext.setLogLevel("ERROR")
    registry.QUERIES["demand_supply_jsd"](spark, sf).collect()  # warms up
    took = {}
    for name in NAMES:
        began = time.time()
        registry.QUERIES[name](spark, sf).write.format("noop").mode("overwrite").save()
        took[name] = round(time.time() - began, 3)
    print(json.dumps({"metric": "headline queries", "value": round(sum(took.values()), 3), "unit": "sec", "queries": took, "sf": sf}))


if __name__ == "__main__":
    main()
