"""Times the headline queries and prints one JSON line.

BENCH_SF_DIR (default /root/testdata/sf0.1) names the tables, BENCH_CPUS the local cores.
Each query is planned and run in full; results go to the ``noop`` sink.
"""

from __future__ import annotations

import json
import os
import re
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from vitrine.registry import REGISTRY, Tables  # noqa: E402
from vitrine.session import local_session  # noqa: E402

HEADLINE = [
    "page_visible_text", "page_images", "merchant_crawl_facts", "merchant_products", "host_network_safety", "robots_verdicts",
    "merchant_crawl_status", "download_candidates", "perceptual_clusters", "representative_selection", "similar_pairs",
    "catalogue_matches", "identity_coherence", "cross_merchant_matches", "match_statuses", "logo_consistency",
    "colour_histograms", "manipulation_scores", "dual_source_evidence", "evidence_risk", "decision_reasons",
    "claim_evidence_matrix", "baseline_predictions", "method_metrics", "job_states", "job_sessions", "cross_merchant_index",
    "merchant_decisions",
]


def main() -> None:
    directory = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    names = sys.argv[1:] or HEADLINE
    spark = local_session("bench", cpus)
    tables = Tables(spark, directory)
    tables.table("part").write.format("noop").mode("overwrite").save()  # start the JVM paths once
    spark.range(8).mapInPandas(lambda it: it, "id long").write.format("noop").mode("overwrite").save()
    seconds = {}
    for name in names:
        start = time.perf_counter()
        REGISTRY[name].build(tables).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.perf_counter() - start, 3)
        print(name, seconds[name], file=sys.stderr)
    scale = re.search(r"sf([0-9.]+)", directory)
    print(json.dumps({
        "metric": "total_seconds_headline_queries",
        "value": round(sum(seconds.values()), 3),
        "unit": "sec",
        "queries": seconds,
        "sf": float(scale.group(1)) if scale else None,
        "cpus": cpus,
    }))


if __name__ == "__main__":
    main()
