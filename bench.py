"""Headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; one JSON line."""

import json
import os
import time

from thicket import registry
from thicket.session import session

NAMES = ("scm_iter1", "sum_rows", "rule_risk", "pack_bits", "kmer_extract", "kmer_matrix", "scm_fit_conj", "cart_depth2", "predict_conj", "src_matrix_unpivot")


def main() -> None:
    sf, cpus = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1"), os.environ.get("BENCH_CPUS", "8")
    spark = session(f"local[{cpus}]", **{"spark.sql.shuffle.partitions": cpus, "spark.driver.memory": "12g", "spark.ui.enabled": "false", "spark.ui.showConsoleProgress": "false"})
    spark.sparkContext.setLogLevel("ERROR")
    took, queries = {}, registry.queries()
    spark.range(1000).selectExpr("sum(id)").collect()
    for name in NAMES:
        spark.catalog.clearCache()
        t = time.time()
        queries[name](spark, sf).write.format("noop").mode("overwrite").save()
        took[name] = round(time.time() - t, 3)
    print(json.dumps({"metric": "headline queries, total", "value": round(sum(took.values()), 3), "unit": "sec", "queries": took, "sf": os.path.basename(sf).removeprefix("sf")}))


if __name__ == "__main__":
    main()
