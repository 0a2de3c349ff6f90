"""Times registered queries and prints one JSON line. BENCH_SF_DIR, BENCH_CPUS and BENCH_QUERIES (names with commas, or
``all``) choose the data, the cores and the queries."""

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

HEADLINE = ["length_cdf", "align_sharegpt", "render_chat", "encode_sft", "encode_pairwise", "encode_feedback", "vocab_build",
            "encode_tokens", "encode_pretrain", "pack_blocks", "pack_knapsack", "pack_materialise", "mix_interleave_over",
            "mix_interleave_prob_over", "split_ratio", "sample_num", "tool_call_extract", "mcq_prompt", "seq_logps", "seq_logps_ld",
            "loss_bco", "dpo_report", "accuracy_by_rank", "loss_asft", "loss_eaft", "bleu4", "rouge_n", "rouge_l", "ema_smooth",
            "running_moments", "win_rate", "gram", "project_vectors", "media_resolve"]


def main():
    from prefmill.plans import catalog
    from prefmill.session import build_session
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    wanted = os.environ.get("BENCH_QUERIES", "")
    names = list(catalog.QUERIES) if wanted == "all" else [n for n in wanted.split(",") if n] or HEADLINE
    runs = int(os.environ.get("BENCH_RUNS", "1"))
    spark = build_session(f"local[{cpus}]", int(cpus) if cpus.isdigit() else 8,
                          **{"spark.driver.memory": "16g", "spark.ui.showConsoleProgress": "false"})
    spark.sparkContext.setLogLevel("ERROR")

    def run(name):
        start = time.time()
        catalog.QUERIES[name](spark, folder).write.format("noop").mode("overwrite").save()
        return time.time() - start

    run("align_sharegpt")  # start the workers and load classes
    seconds = {}
    for name in names:
        times = sorted(run(name) for _ in range(runs))
        seconds[name] = round(times[len(times) // 2], 3)
        print(f"{seconds[name]:8.2f} {name}", file=sys.stderr, flush=True)
    print(json.dumps({"metric": "total_seconds", "value": round(sum(seconds.values()), 3), "unit": "sec", "queries": seconds,
                      "sf": os.path.basename(folder).removeprefix("sf")}))


if __name__ == "__main__":
    main()
