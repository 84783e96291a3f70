"""Time the headline queries at ``$BENCH_SF_DIR`` on ``local[$BENCH_CPUS]``; prints one JSON line."""

from __future__ import annotations

import json
import os
import sys
import tempfile
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from lingospan.config import build_session  # noqa: E402
from lingospan.plans.queries import QUERIES  # noqa: E402

HEADLINE = [
    "zero_shot_eval", "zero_shot_report", "compare_models", "macro_prf", "confusion_by_language",
    "error_records", "rows_checked", "error_summary_sets", "category_distribution", "suggest_category",
    "unpivot_languages", "select_lang_first", "align_languages", "pairs_from_turns", "validate_pairs",
    "label_distribution", "dataset_sizes", "char_script_counts", "script_histogram", "token_word_ratio",
    "text_length_stats", "epoch_loss", "best_epoch", "assign_batches", "number_rows_by_language", "fit_vocab",
    "encode_pairs", "encode_longest", "decode_ner_tags", "score_pairs", "score_callable", "stream_score_pairs",
    "zero_shot_transfer", "encode_longest_all", "decode_ids", "sample_rows", "first_n_large", "bulk_score_csv",
    "union_language_errors", "compare_models_failed", "fit_vocab_all",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    only = sys.argv[1:] or HEADLINE
    spark = build_session(
        "bench",
        f"local[{cpus}]",
        **{
            "spark.sql.shuffle.partitions": cpus,
            "spark.driver.memory": "12g",
            "spark.checkpoint.dir": tempfile.mkdtemp(prefix="bench-shared-"),
            "spark.ui.enabled": "false",
            "spark.ui.showConsoleProgress": "false",
        },
    )
    spark.sparkContext.setLogLevel("ERROR")
    times, first = {}, {}
    for name in only:
        # The second run is reported: the first also loads classes, compiles and starts Python workers.
        for runs in (first, times):
            began = time.perf_counter()
            QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
            runs[name] = round(time.perf_counter() - began, 3)
    spark.stop()
    print(
        json.dumps(
            {
                "metric": "total seconds of headline queries",
                "value": round(sum(times.values()), 3),
                "unit": "sec",
                "queries": times,
                "first_run": first,
                "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf"),
            }
        )
    )


if __name__ == "__main__":
    main()
