"""Benchmark of the headline queries: one warm-up and three timed runs each, noop sink."""

from __future__ import annotations

import json
import os
import statistics
import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent))

from docmill.queries import book  # noqa: E402
from docmill.session import local_session  # noqa: E402

HEADLINE = [
    "pi_mask_documents",
    "pi_hit_counts",
    "page_assemble",
    "digital_confidence",
    "ocr_lines_conf",
    "cascade_hybrid",
    "model_cost_items",
    "request_costs",
    "iso_dates",
    "extract_identity_card",
    "extract_tax_number",
    "extract_business_identification_number",
    "extract_tax_entity",
    "mrz_parse",
    "extract_business_deed",
    "extract_identity_stay",
    "extract_certificate_local_value",
    "extract_bank_account",
    "extract_certificate_education",
    "extract_certificate_competency",
    "extract_mixed",
    "extract_one_pass",
    "prompt_render",
    "payload_repair",
    "corpus_results",
    "batch_results",
    "batch_cost",
    "log_tiers",
    "trace_hybrid",
]
#: Queries that run jobs of their own before they return; for these the call counts too.
EAGER = {"corpus_results"}
RUNS = 3


def timed(df, before: float = 0.0) -> float:
    start = time.perf_counter()
    df.write.format("noop").mode("overwrite").save()
    return time.perf_counter() - start + before


def timed_call(query, spark, sf_dir) -> float:
    start = time.perf_counter()
    df = query(spark, sf_dir)
    return timed(df, time.perf_counter() - start)


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cores = os.environ.get("BENCH_CPUS", "8")
    spark = local_session("docmill-bench", cores=cores, partitions=int(cores))
    queries = book.queries()
    seconds = {}
    for name in HEADLINE:
        df = queries[name](spark, sf_dir)
        timed(df)
        runs = (timed_call(queries[name], spark, sf_dir) if name in EAGER else timed(df) for _ in range(RUNS))
        seconds[name] = round(statistics.median(runs), 3)
        print(f"{name}: {seconds[name]}", file=sys.stderr, flush=True)
    print(
        json.dumps(
            {
                "metric": "total_query_seconds",
                "value": round(sum(seconds.values()), 3),
                "unit": "sec",
                "queries": seconds,
                "sf": Path(sf_dir).name.removeprefix("sf"),
            }
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()
