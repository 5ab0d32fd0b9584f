"""Command line: build, augment, analyze, evaluate, prepare."""

from __future__ import annotations

import argparse

from pyspark.sql import SparkSession

from glossmill.functions.scoring import DATA_SOURCE_PREFIX
from glossmill.operators.analyze import as_table
from glossmill.plans import pipelines


def main(argv: list[str] | None = None) -> None:
    parser = argparse.ArgumentParser(prog="glossmill")
    commands = parser.add_subparsers(dest="command", required=True)

    build = commands.add_parser("build", help="samples from essay corpora")
    build.add_argument("--data-dir", required=True)
    build.add_argument("--output-dir", required=True)
    build.add_argument("--max-source-len", type=int, default=1024)
    build.add_argument("--max-target-len", type=int, default=1024)
    build.add_argument("--prefix", default=DATA_SOURCE_PREFIX, help="of file names and data sources")

    augment = commands.add_parser("augment", help="identity and noisy samples, balanced languages")
    augment.add_argument("--input", required=True)
    augment.add_argument("--output", required=True)
    augment.add_argument("--stage", default="sft", choices=sorted(pipelines.STAGE_DEFAULTS))
    augment.add_argument("--identity-ratio", type=float)
    augment.add_argument("--noise-ratio", type=float)
    augment.add_argument("--noise-rate", type=float)
    augment.add_argument("--noise-type")
    augment.add_argument("--balance-strategy", default="sqrt")
    augment.add_argument("--seed", type=int, default=42)

    analyze = commands.add_parser("analyze", help="profile of one file, or of two")
    which = analyze.add_mutually_exclusive_group(required=True)
    which.add_argument("--input")
    which.add_argument("--before")
    analyze.add_argument("--after")
    analyze.add_argument("--output")

    evaluate = commands.add_parser("evaluate", help="predictions against references")
    evaluate.add_argument("--predictions", required=True)
    evaluate.add_argument("--references", required=True)
    evaluate.add_argument("--output")

    prepare = commands.add_parser("prepare", help="training tables")
    prepare.add_argument("--input", required=True)
    prepare.add_argument("--sft-output")
    prepare.add_argument("--rl-output")
    prepare.add_argument("--max-samples", type=int)
    prepare.add_argument("--prefix", default=DATA_SOURCE_PREFIX, help="of data sources")

    args = parser.parse_args(argv)
    if args.command == "analyze" and args.before and not args.after:
        parser.error("--after is required with --before")
    spark = SparkSession.builder.appName("glossmill").getOrCreate()
    if args.command == "build":
        pipelines.build_dataset(spark, args.data_dir, args.output_dir, args.max_source_len, args.prefix, args.max_target_len).orderBy("lang", "corpus", "split").show(1000, truncate=False)
    elif args.command == "augment":
        pipelines.augment_dataset(
            spark, args.input, args.output, stage=args.stage, identity_ratio=args.identity_ratio, noise_ratio=args.noise_ratio,
            noise_rate=args.noise_rate, noise_type=args.noise_type, balance_strategy=args.balance_strategy, seed=args.seed,
        ).show(1000)
    elif args.command == "analyze":
        print(pipelines.analyze_files(spark, args.input or args.before, args.after, args.output))
    elif args.command == "evaluate":
        metrics = pipelines.evaluate_files(spark, args.predictions, args.references, args.output)
        print(as_table([{"lang": "all", **metrics["overall"]}, *({"lang": k, **m} for k, m in metrics["per_language"].items())]))
    else:
        pipelines.prepare(spark, args.input, args.sft_output, args.rl_output, args.max_samples, args.prefix)


if __name__ == "__main__":
    main()
