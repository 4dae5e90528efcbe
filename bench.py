"""Time the headline queries: one JSON line with seconds per query.

    BENCH_SF_DIR (default /root/testdata/sf0.1), BENCH_CPUS (default 8)
"""

from __future__ import annotations

import json
import os
import time

from credalis.plans import registry
from credalis.session import local_session

HEADLINE = (
    "calibration_overview group_summary ece reliability_bins level_table band_table auroc auroc_pooled stratified_auroc "
    "average_precision risk_coverage selective_at matched_coverage spearman entropy proper_scores replicate_mean replicate_spread "
    "score_items bootstrap_mean bootstrap_mean_levels auroc_interval paired_auroc_difference equal_confidence "
    "month_block_bootstrap within_value_permutation_levels random_months_null smece smece_interval change_point cutoff_stats "
    "split_selection cross_fitted_maps nearest_distractors mask_dates normalise_answer log_coverage compare_tables "
    "stratified_sample balanced_sample sample_distractors"
).split()


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    spark = local_session(os.environ.get("BENCH_CPUS", "8"))
    # start-up and code generation are not part of any query
    registry.QUERIES["ece"](spark, sf_dir).write.format("noop").mode("overwrite").save()
    seconds: dict[str, float] = {}
    for name in HEADLINE:
        start = time.perf_counter()
        registry.QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.perf_counter() - start, 3)
    sf = os.path.basename(sf_dir.rstrip("/")).removeprefix("sf")
    print(json.dumps({"metric": "headline_queries_total", "value": round(sum(seconds.values()), 3), "unit": "sec", "queries": seconds, "sf": float(sf) if sf.replace(".", "", 1).isdigit() else sf}))


if __name__ == "__main__":
    main()
