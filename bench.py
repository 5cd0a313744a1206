"""Time the headline queries; prints one JSON line.

BENCH_SF_DIR, BENCH_CPUS and BENCH_RUNS choose the tables, cores and repetitions.
"""

from __future__ import annotations

import json
import os
import statistics
import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent))

from revuelens.plans import catalog  # noqa: E402
from revuelens.session import local_session  # noqa: E402

HEADLINE = [
    "helpfulness_percentiles",
    "facts_percentiles",
    "describe_numeric",
    "box_helpfulness_by_category",
    "histogram_helpfulness",
    "kde_scores",
    "corr_matrix",
    "crosstab_margins",
    "monthly_trend",
    "standardize",
    "stratified_sample",
    "stratified_split",
    "prepared_balance",
    "clean_text",
    "top_bigrams_by_rating",
    "top_words_by_category",
    "bigram_diversity",
    "lexicon_sentiment",
    "embed_text",
    "coherence_by_rating",
    "roc_auc",
    "ks_two_sample",
    "fit_conditional_density",
    "loglik_by_category",
    "char_perplexity",
    "classification_report",
    "nearest_in_stratum",
    "token_ids",
    "topic_terms",
    "generate_reviews",
]
WARM_UP = ["scan_profile", "describe_numeric", "clean_text"]


def run(spark, function, sf: str) -> float:
    start = time.perf_counter()
    function(spark, sf).write.format("noop").mode("overwrite").save()
    return time.perf_counter() - start


def main() -> None:
    sf = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cores = os.environ.get("BENCH_CPUS", "8")
    runs = int(os.environ.get("BENCH_RUNS", "2"))
    spark = local_session(cores, int(cores) if cores.isdigit() else 8)
    spark.sparkContext.setLogLevel("ERROR")
    queries, _ = catalog.load()
    for name in WARM_UP:
        run(spark, queries[name], sf)
    seconds = {}
    for name in sys.argv[1:] or HEADLINE:
        seconds[name] = round(statistics.median(run(spark, queries[name], sf) for _ in range(runs)), 3)
    line = {
        "metric": "headline_queries_total",
        "value": round(sum(seconds.values()), 3),
        "unit": "sec",
        "queries": seconds,
        "sf": Path(sf).name,
    }
    print(json.dumps(line))


if __name__ == "__main__":
    main()
