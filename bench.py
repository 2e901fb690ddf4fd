"""Benchmark the headline queries.

env: BENCH_SF_DIR (default /root/testdata/sf0.1), BENCH_CPUS (default 8),
BENCH_RUNS (timed runs per query, default 3; one untimed warm-up first).

Each query is executed in full with the ``noop`` sink (no collection to
the driver). Prints ONE JSON line: total of per-query medians.
"""

from __future__ import annotations

import json
import os
import statistics
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

HEADLINE = [
    "daily_top5",          # flagship: window -> latest N -> enrich -> top 5
    "daily_report",        # full Markdown report dataset
    "enrich_a",            # window enrichment incl. extractive summaries
    "extractive_summary",  # every document summarised
    "dedup_url",           # union of sources + first-wins per URL
    "trend_terms_regex",   # all terms of all texts
    "scan_html_links",     # anchors of every page
    "canonicalize_url",
    "html_to_text",
    "categorize_a_freq",
    "rule_match_join",
    "scan_rss",            # render + land + parse feeds
]
#: Timed as well, but not part of the total, which stays comparable with earlier rounds.
STORE = [
    "append_store",        # two batches written, published and read
    "not_stored",          # store, key index, lookup of new links
    "store_enriched",      # two batches, three enrichments, fold, read
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    runs = int(os.environ.get("BENCH_RUNS", "3"))
    from presswork.plans import registry
    from presswork.session import get_spark

    spark = get_spark(master=f"local[{cpus}]", shuffle_partitions=int(cpus) * 2)
    out = {}
    for name in HEADLINE + STORE:
        fn = registry.QUERIES[name]
        times = []
        for i in range(runs + 1):
            t0 = time.perf_counter()
            fn(spark, sf_dir).write.format("noop").mode("overwrite").save()
            dt = time.perf_counter() - t0
            if i > 0:
                times.append(dt)
        out[name] = round(statistics.median(times), 3)
        print(f"{name}: {out[name]}s {times}", file=sys.stderr)
    sf = os.path.basename(sf_dir.rstrip("/")).replace("sf", "")
    print(json.dumps({"metric": "headline_total_median", "value": round(sum(out[n] for n in HEADLINE), 3), "unit": "sec",
                      "queries": out, "sf": float(sf) if sf.replace(".", "").isdigit() else sf}))


if __name__ == "__main__":
    main()
