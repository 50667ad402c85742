"""Time the headline queries on $BENCH_SF_DIR with local[$BENCH_CPUS]; prints one JSON line."""

import json
import os
import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent))

from vigilake.plans import catalog  # noqa: E402
from vigilake.session import build  # noqa: E402

HEADLINE = (
    "hit_spans", "shipped_taxonomies", "keyword_hits", "final_verdicts", "redact_overlapping", "exchange_verdicts",
    "sanitize", "receipt_hashes", "receipt_verify", "report_by_class", "translate_nodes", "circular_flag", "ingest_runs",
    "parent_lookup", "trap_summary", "traffic_texts", "sse_assembly", "swap_back", "strip_blocks",
)


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = build(
        "vigilake-bench", f"local[{cpus}]",
        **{"spark.sql.shuffle.partitions": cpus, "spark.ui.enabled": "false", "spark.driver.memory": "12g"},
    )
    spark.sparkContext.setLogLevel("ERROR")
    # The first job pays for starting the JVM's threads and class loading, not for a query.
    spark.read.parquet(f"{sf_dir}/documents.parquet").selectExpr("sum(length(text))").collect()
    queries, seconds = catalog.all_queries(), {}
    for name in os.environ.get("BENCH_QUERIES", ",".join(HEADLINE)).split(","):
        started = time.perf_counter()
        # Every row and column is produced; nothing is collected.
        queries[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.perf_counter() - started, 3)
    total = round(sum(seconds.values()), 3)
    print(json.dumps({"metric": "headline_total", "value": total, "unit": "sec", "queries": seconds, "sf": Path(sf_dir).name}))
    spark.stop()


if __name__ == "__main__":
    main()
