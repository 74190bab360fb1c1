"""Wall time of the headline queries: one cold run, then the better of two warm runs. Prints one JSON line."""

from __future__ import annotations

import json
import os
import sys
import time

from rollmill.plans import QUERIES
from rollmill.session import build_session

HEADLINE = [
    "score_kl_advantage", "pass_at_k", "agg_question_level", "val_metrics_by_source_difficulty", "val_metrics_best_worst_maj",
    "majority_vote", "adv_grpo", "adv_rloo", "adv_rfpp_baseline", "adv_longest_correct", "adv_gae", "adv_rfpp",
    "masked_whiten", "policy_clip_stats", "data_metrics", "grade_exact", "grade_boxed_equiv", "grade_minerva", "grade_dispatch",
    "replay_dedup_keep_last", "cumulative_tokens", "join_token_interp", "history_summary", "diversity_group_similarity",
    "epoch_batches", "batch_slice", "augment_mixed", "question_stats", "rollout_summary", "multiturn_loss_mask",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = build_session(
        "bench", f"local[{cpus}]",
        **{"spark.sql.shuffle.partitions": cpus, "spark.driver.memory": "8g", "spark.ui.enabled": "false",
           "spark.ui.showConsoleProgress": "false"},
    )
    spark.sparkContext.setLogLevel("ERROR")
    names = sys.argv[1:] or HEADLINE
    seconds, cold = {}, {}
    for name in names:
        times = []
        for _ in range(3):
            start = time.perf_counter()
            QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
            times.append(time.perf_counter() - start)
        cold[name], seconds[name] = round(times[0], 3), round(min(times[1:]), 3)
    print(json.dumps({
        "metric": "headline_queries_total", "value": round(sum(seconds.values()), 3), "unit": "sec",
        "queries": seconds, "cold": cold, "sf": sf_dir.rsplit("sf", 1)[-1], "cpus": int(cpus),
    }))
    spark.stop()


if __name__ == "__main__":
    main()
