"""Wall time of the headline queries at $BENCH_SF_DIR; prints one JSON line."""

from __future__ import annotations

import json
import os
import time

from chatterlake.plans.queries import QUERIES
from chatterlake.session import local_session

HEADLINE = (
    "cleaned_sentiment_per_day", "daily_trends", "events_per_day", "clean_posts", "dedupe_by_text",
    "clean_text", "chinese_flag", "parse_local", "parse_remote", "word_freq", "top50_words",
    "stopword_removal", "segment_with_dictionary", "translation_route", "resume_merge", "enrich_local",
    "enrich_called", "bag_of_words", "vocabulary", "window_cooccurrence", "coherence_by_lang",
    "relevance_by_lang", "model_labels",
)


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    spark = local_session(os.environ.get("BENCH_CPUS", "8"), "bench")
    QUERIES["posts_per_day"](spark, sf_dir).collect()  # starts the workers
    seconds = {}
    for name in HEADLINE:
        started = time.perf_counter()
        QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.perf_counter() - started, 3)
    print(
        json.dumps(
            {
                "metric": "headline_queries_total",
                "value": round(sum(seconds.values()), 3),
                "unit": "sec",
                "queries": seconds,
                "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf"),
            }
        )
    )


if __name__ == "__main__":
    main()
