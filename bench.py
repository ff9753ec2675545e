"""Time the headline queries and print one JSON line.

Every query runs twice and the faster run counts: the first one mostly measures class loading and
code generation of a fresh JVM.
"""

from __future__ import annotations

import json
import os
import sys
import time

from flowmill.session import build_session

# One or two queries per operator family; every query writes its full result to the noop sink.
HEADLINE = [
    "projected_scan", "event_stream", "canonical_events", "causal_features", "file_ordering_audit",
    "asof_strict", "trade_reconciliation", "order_lifecycle", "market_order_class", "clearing_price",
    "book_features", "stock_day_atomic", "daily_quotes", "forward_returns_supplier_days", "execution_panel",
    "training_labels", "daily_rank_ic", "supplier_rank_ic", "quantile_returns", "topk_grid",
    "head_ranking_metrics", "neutralised_returns", "regime_features", "priority_sample", "quantile_edges",
    "token_table", "copy_baseline", "cross_asset_context", "pooled_last_k", "purged_cv_folds",
    "padded_token_windows", "table_quality_report", "stream_running_vwap",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = build_session(
        "flowmill-bench", f"local[{cpus}]", spark__sql__shuffle__partitions=cpus, spark__ui__enabled="false",
        spark__driver__memory=os.environ.get("BENCH_MEMORY", "16g"), spark__ui__showConsoleProgress="false",
    )
    spark.sparkContext.setLogLevel("OFF")
    from flowmill.plans import QUERIES

    names = sys.argv[1:] or HEADLINE
    QUERIES["signed_flow"](spark, sf_dir).write.format("noop").mode("overwrite").save()  # JVM warm-up
    took = {}
    for name in names:
        runs = []
        while len(runs) < 2:
            start = time.perf_counter()
            QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
            runs.append(time.perf_counter() - start)
        took[name] = round(min(runs), 3)
    print(json.dumps({
        "metric": "headline_queries_total", "value": round(sum(took.values()), 3), "unit": "sec", "queries": took,
        "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf"),
    }))
    spark.stop()


if __name__ == "__main__":
    main()
