"""Time the headline queries on one folder and print one JSON line.

BENCH_SF_DIR (default /root/testdata/sf0.1), BENCH_CPUS (default all cores),
BENCH_RUNS timed runs per query after one warm run (default 1; the median counts),
BENCH_QUERIES a comma-separated list instead of the headline queries.
"""

from __future__ import annotations

import json
import os
import re
import statistics
import time

from workbench.check import local_session
from workbench.queries import registered

HEADLINE = (
    "clean_content", "area_frequencies", "tokenize_sentences", "mask_numeric_expressions", "term_frequency",
    "doc_frequency", "tfidf_bow", "paper_embedding_weighted_mean", "knn_papers", "knn_to_journals",
    "journal_centroids", "journal_year_centroids", "area_onehot", "latest_hindex",
    "hindex_percentile_by_journal", "academic_authority", "percentile_normalize", "author_ambiguity",
    "coauthor_pairs", "coauthor_pairs_distinct", "cojournal_counts", "coauthor_pagerank_fixed",
    "coauthor_pagerank_repeated_fixed", "originality_distances", "trending_reference", "trending_scores",
    "scope_match_scores", "scope_contrast_papers",
)


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cores = int(os.environ.get("BENCH_CPUS", os.cpu_count() or 8))
    runs = int(os.environ.get("BENCH_RUNS", "1"))
    names = [n for n in os.environ.get("BENCH_QUERIES", "").split(",") if n] or HEADLINE
    spark, known, seconds = local_session(cores), registered(), {}
    for name in names:
        times = []
        for _ in range(runs + 1):
            start = time.perf_counter()
            known[name](spark, folder).write.format("noop").mode("overwrite").save()
            times.append(time.perf_counter() - start)
        seconds[name] = round(statistics.median(times[1:]), 3)
    scale = re.search(r"sf([0-9.]+)", folder)
    print(json.dumps({
        "metric": "total seconds of the headline queries", "value": round(sum(seconds.values()), 3),
        "unit": "sec", "queries": seconds, "sf": float(scale.group(1)) if scale else None,
    }))
    spark.stop()


if __name__ == "__main__":
    main()
