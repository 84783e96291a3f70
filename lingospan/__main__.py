"""Command line: ``python -m lingospan train|eval|errors|score``."""

from __future__ import annotations

import argparse
from dataclasses import replace

from lingospan.config import EVAL_LANGUAGES, Config, build_session
from lingospan.operators.transfer import load_model
from lingospan.plans import workflows


def main(argv: list[str] | None = None) -> None:
    parser = argparse.ArgumentParser(prog="lingospan")
    parser.add_argument("mode", choices=["train", "eval", "errors", "score"])
    parser.add_argument("--data", default=Config.data_dir, help="pair corpus (Parquet)")
    parser.add_argument("--checkpoint", default=f"{Config.checkpoint_dir}/pair_pipeline", help="saved pipeline")
    parser.add_argument("--checkpoint-dir", default=Config.checkpoint_dir, help="where train saves the pipeline")
    parser.add_argument("--langs", nargs="+", default=EVAL_LANGUAGES)
    parser.add_argument("--source-lang", default=Config.source_lang)
    parser.add_argument("--output-dir", default=Config.output_dir)
    parser.add_argument("--input", help="CSV of pairs to score")
    parser.add_argument("--format", choices=["csv", "json"], default="csv")
    args = parser.parse_args(argv)
    spark = build_session("lingospan")
    config = replace(
        Config(),
        data_dir=args.data,
        checkpoint_dir=args.checkpoint_dir,
        eval_langs=args.langs,
        source_lang=args.source_lang,
        output_dir=args.output_dir,
    )
    if args.mode == "train":
        workflows.report(workflows.train(spark, config).scores, config).show(truncate=False)
        return
    model = load_model(args.checkpoint)
    if args.mode == "score":
        schema = "premise STRING, hypothesis STRING"
        workflows.bulk_score(spark, args.input, schema, args.output_dir, model, args.format).show()
        return
    if args.mode == "eval":
        workflows.report(workflows.score_eval_split(spark, config, model), config).show(truncate=False)
        return
    found = workflows.mine_errors_early(spark, workflows.eval_pairs(spark, config), model, config)
    for name, table in found.summaries.items():
        print(name)
        table.show(truncate=False)


if __name__ == "__main__":
    main()
