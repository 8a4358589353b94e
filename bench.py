"""Times the headline queries and prints one JSON line.

BENCH_SF_DIR names the tables (default sf0.1), BENCH_CPUS the local threads. Each query writes its whole answer
to a sink that keeps nothing. One query runs first, untimed, so that starting the JVM is not counted.
"""

from __future__ import annotations

import json
import os
import time

from provenant.plans import QUERIES, load_all
from provenant.session import local_session

HEADLINES = [
    "reproductions", "producers", "users_with_signer", "included_and_excluded", "agreed_environment", "files_of_two_signers",
    "federated_union", "source_status", "latest_versions", "latest_time_per_subject", "replaced_by", "claim_count", "chain_positions", "seal_verdict",
    "lineage_of_last_states", "file_versions", "task_outputs", "links_in_session", "trapezoid_per_subject", "compared_files", "feed_page",
]


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    load_all()
    spark = local_session(os.environ.get("BENCH_CPUS", "8"), "provenant-bench")
    spark.sparkContext.setLogLevel("OFF")
    run = lambda name: QUERIES[name](spark, folder).write.format("noop").mode("overwrite").save()
    run("reading_work_file")
    times = {}
    for name in HEADLINES:
        t0 = time.perf_counter()
        run(name)
        times[name] = round(time.perf_counter() - t0, 3)
    print(json.dumps({"metric": "headline queries, total wall time", "value": round(sum(times.values()), 3), "unit": "sec", "queries": times,
                      "sf": folder.rstrip("/").rsplit("sf", 1)[-1]}))
    spark.stop()


if __name__ == "__main__":
    main()
