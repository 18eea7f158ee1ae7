"""Benchmark: run the headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS].

Prints ONE JSON line: {"metric", "value", "unit", "queries": {name: sec}, "sf"}.
Each query is executed completely with the `noop` sink (no collect to the
driver), twice: "queries" holds the second (warm: code generated, JIT
compiled) wall-clock time per query, "cold_total" the sum of first runs.
"""

from __future__ import annotations

import json
import os
import re
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from bytelane import catalog  # noqa: E402
from bytelane.session import local_session  # noqa: E402

HEADLINE = [
    "byte_windows",
    "byte_windows_sharded",
    "masked_windows",
    "masked_windows_fast",
    "shuffled_batches",
    "safe_decode",
    "batches",
    "patches",
    "qa_samples",
    "ce_loss",
    "gumbel_sample",
    "top_checkpoints",
    "running_elements",
    "eval_mean",
]


def masked_windows_fast(spark, d):
    """The production hash mode; `masked_windows` measures the mode its SQL can repeat."""
    from bytelane.operators import windows as W

    p = catalog.MASKED
    w, _ = W.byte_windows(catalog.documents(spark, d), p["L"], include_tail=True)
    return W.masked_sample(w, p["L"], masking_proba=p["p"], seed=p["seed"], epoch=p["epoch"])


BENCHED = {**catalog.QUERIES, "masked_windows_fast": masked_windows_fast}


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    names = sys.argv[1:] or [n for n in HEADLINE if n in BENCHED]
    spark = local_session(cpus, shuffle_partitions=int(os.environ.get("BENCH_SHUFFLE_PARTITIONS", "16")))
    # warm-up: JIT and session start are not part of any query
    catalog.QUERIES["kind_counts"](spark, sf_dir).write.format("noop").mode("overwrite").save()
    times, cold = {}, {}
    for name in names:
        runs = []
        for _ in range(2):
            t0 = time.time()
            BENCHED[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
            runs.append(time.time() - t0)
        cold[name] = round(runs[0], 3)
        times[name] = round(runs[1], 3)
    m = re.search(r"sf([0-9.]+)", sf_dir)
    print(
        json.dumps(
            {
                "metric": "headline_queries_total",
                "value": round(sum(times.values()), 3),
                "unit": "sec",
                "queries": times,
                "cold_total": round(sum(cold.values()), 3),
                "sf": float(m.group(1)) if m else sf_dir,
            }
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()
