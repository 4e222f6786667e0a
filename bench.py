"""Headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line."""

from __future__ import annotations

import json
import os
import sys
import tempfile
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from codesift.session import local_session  # noqa: E402
from workload import corpus  # noqa: E402
from workload.queries import QUERIES  # noqa: E402

HEADLINE = (
    "strip_comments", "rule_matches", "findings_enriched", "contract_report", "summary", "top_risky", "severity_rollup",
    "source_dedup", "findings_with_external", "contract_report_external", "report_json", "report_markdown",
    "report_html_fragment", "noted_scan", "custom_rule_pack", "stream_scan",
)


def run(frame) -> None:
    """Compute every row and column without keeping them."""
    frame.write.format("noop").mode("overwrite").save()


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cores = os.environ.get("BENCH_CPUS", str(os.cpu_count() or 8))
    spark = local_session(cores, spark__checkpoint__dir=tempfile.mkdtemp(prefix="bench-"))
    size = corpus.contracts(spark, sf_dir).selectExpr(
        "count(*) AS texts", "sum(octet_length(content)) / 1e6 AS mb"
    ).first()
    run(QUERIES["contract_report"](spark, sf_dir))  # warms the JVM up

    seconds: dict[str, float] = {}
    for name in HEADLINE:
        started = time.perf_counter()
        run(QUERIES[name](spark, sf_dir))
        seconds[name] = round(time.perf_counter() - started, 3)

    scan = seconds["contract_report"]
    print(json.dumps({
        "metric": "headline_total", "value": round(sum(seconds.values()), 3), "unit": "sec", "queries": seconds,
        "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf"), "texts": size.texts, "mb": round(float(size.mb), 1),
        "texts_per_sec": round(size.texts / scan), "mb_per_sec": round(float(size.mb) / scan, 2),
    }))
    spark.stop()


if __name__ == "__main__":
    main()
