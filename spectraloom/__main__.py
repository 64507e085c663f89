"""``python -m spectraloom``: shorten one text, or run a suite, the quality evaluation or the latency profile."""

from __future__ import annotations

import argparse
import json
import sys
import time
from importlib import import_module

from spectraloom.functions.pins import INSTRUCTION_PRESET, section_patterns
from spectraloom.functions.strip import LEVELS
from spectraloom.functions.text import STRATEGIES
from spectraloom.plans.kernel import Options, optimize


def _fail(why: str) -> None:
    print(f"Error: {why}", file=sys.stderr)
    raise SystemExit(1)


def _text(args: argparse.Namespace) -> str:
    from spectraloom.sources import checked_path

    if args.file:
        from pathlib import Path

        text = Path(checked_path(args.file, "--file")).read_text(encoding="utf-8")
    else:
        text = " ".join(args.text) if args.text else sys.stdin.read()
    if not text.strip():
        raise ValueError("no text")
    return text


def shorten(args: argparse.Namespace) -> None:
    from spectraloom.plans.compress import one

    text = _text(args)
    if not 0 < args.target < 1:
        raise ValueError("--target must be between 0 and 1")
    pins = [*(INSTRUCTION_PRESET if args.pin_instructions else ()), *args.pin_regex, *(section_patterns(args.pin_sections.split(","), text) if args.pin_sections else ())]
    options = Options(args.target, args.strategy, not args.no_protect, pins=tuple(pins))
    began = time.perf_counter()
    _, out, ratio, saved, lam, total, removed, stages = one(text, args.pre_strip, args.post_strip, args.strip_only, options)
    spent = round(time.perf_counter() - began, 4)
    if args.json:
        said: dict = {"compressed": out} if args.strip_only else {"compressed": out, "compression_ratio": ratio, "tokens_saved": saved, "algebraic_connectivity": lam, "chunks_total": total, "chunks_removed": removed}
        said["elapsed_seconds"] = spent
        if args.verbose and not args.strip_only and not args.pre_strip:
            r = optimize(text, options)
            said |= {"removed_chunks": r.removed_chunks, "chunk_scores": r.chunk_scores}
        if args.pre_strip or args.post_strip or args.strip_only:
            first, last = stages[0]["input_tokens"], stages[-1]["output_tokens"]
            said["pipeline"] = {"stages": stages, "total_input_tokens": first, "total_output_tokens": last, "total_compression_ratio": round(1 - last / first, 6) if first else 0.0}
        print(json.dumps(said, indent=2))
    else:
        print(f"Compression ratio: {ratio:.1%}\nTokens saved: {saved}\nChunks: {total} total, {removed} removed\nAlgebraic connectivity: {lam:.6f}\n\nOutput:\n{out}")


def _session():  # noqa: ANN202
    from pyspark.sql import SparkSession

    return SparkSession.builder.getOrCreate()


def benchmark(args: argparse.Namespace) -> None:
    from pyspark.sql import functions as F

    from spectraloom import sources
    from spectraloom.plans import compress, evaluate, reports
    from spectraloom.sources import generators

    spark = _session()
    if args.kind == "latency":
        out = reports.latency(reports.profile(spark, args.sizes, args.runs))
    elif args.kind == "quality":
        if not args.completer:
            raise ValueError("--completer module:name is needed")
        module, _, name = args.completer.partition(":")
        samples, scorer = evaluate.dataset(spark, args.dataset, args.data, args.limit, args.dry_run, shots=args.shots)
        pins = INSTRUCTION_PRESET if args.pin_instructions else ()
        got = evaluate.answers(samples, getattr(import_module(module), name), args.multipliers, pins, args.pin_tool_results)
        out = evaluate.labelled(evaluate.summary(evaluate.results(got, scorer)))
    else:
        rows = sources.suite(spark, args.suite).select("name", "text") if args.suite else generators.small_suite(spark)
        done = compress.compress(rows, Options(args.target), key="name").join(rows, "name")
        out = done.select("name", "compression_ratio", "tokens_saved", F.floor(F.char_length("text") / 4).alias("tokens")).groupBy("name").agg(F.sum("tokens_saved").alias("tokens_saved"), F.sum("tokens").alias("tokens"))
        total = out.agg(F.lit("all").alias("name"), F.sum("tokens_saved").alias("tokens_saved"), F.sum("tokens").alias("tokens"))
        out = out.unionByName(total).withColumn("saved_share", F.col("tokens_saved") / F.greatest("tokens", F.lit(1)))
    if args.output:
        sources.write_json(out, sources.checked_output(args.output))
    print(sources.markdown(out))


def main(argv: list[str] | None = None) -> None:
    top = argparse.ArgumentParser(prog="spectraloom", description=__doc__)
    subs = top.add_subparsers(dest="command", required=True)
    o = subs.add_parser("optimize")
    o.add_argument("text", nargs="*")
    o.add_argument("--file")
    o.add_argument("--target", type=float, default=0.2)
    o.add_argument("--strategy", choices=STRATEGIES, default="adaptive")
    o.add_argument("--no-protect", action="store_true")
    o.add_argument("--pin-instructions", action="store_true")
    o.add_argument("--pin-regex", action="append", default=[])
    o.add_argument("--pin-sections")
    o.add_argument("--json", action="store_true")
    o.add_argument("--verbose", action="store_true")
    modes = o.add_mutually_exclusive_group()
    for flag in ("--pre-strip", "--post-strip", "--strip-only"):
        modes.add_argument(flag, nargs="?", const="full", choices=LEVELS)
    b = subs.add_parser("benchmark")
    b.add_argument("kind", nargs="?", choices=("suite", "quality", "latency"), default="suite")
    b.add_argument("--suite")
    b.add_argument("--target", type=float, default=0.2)
    b.add_argument("--dataset", default="system_prompts", help="one of the sets in plans.evaluate")
    b.add_argument("--data", help="folder with the tables of a public set, as Parquet")
    b.add_argument("--limit", type=int, help="samples at most, by id")
    b.add_argument("--dry-run", action="store_true", help="ten samples at most")
    b.add_argument("--shots", type=int, default=8, help="worked examples before a question")
    b.add_argument("--pin-instructions", action="store_true")
    b.add_argument("--pin-tool-results", action="store_true")
    b.add_argument("--completer", help="module:name of a callable from prompt to answer")
    b.add_argument("--multipliers", type=float, nargs="+", default=[2.0, 4.0])
    b.add_argument("--sizes", type=int, nargs="+", default=[100, 500, 1000, 5000, 10000])
    b.add_argument("--runs", type=int, default=10)
    b.add_argument("--output")
    args = top.parse_args(argv)
    try:
        (shorten if args.command == "optimize" else benchmark)(args)
    except ValueError as why:
        _fail(str(why))


if __name__ == "__main__":
    main()
