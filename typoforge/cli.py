"""Command line: compile text tables into rules and write them with reports."""

from __future__ import annotations

import argparse
import logging
import time

log = logging.getLogger("typoforge")
NUMBERS = {"top_n": int, "max_corrections": int, "freq_ratio": float, "min_word_length": int, "max_word_length": int, "min_typo_length": int, "max_entries_per_file": int, "typo_freq_threshold": float, "max_iterations": int}


def create_parser() -> argparse.ArgumentParser:
    from .config import PLATFORMS

    p = argparse.ArgumentParser(prog="typoforge", description=__doc__)
    p.add_argument("--documents", required=True, help="Parquet table with lang and text")
    p.add_argument("--benchmark", required=True, help="Parquet table with text: the user's words")
    p.add_argument("--config", help="JSON file of settings; flags win over it")
    p.add_argument("--platform", choices=sorted(PLATFORMS))
    p.add_argument("--output", default="out", help="file or folder; - writes YAML to standard output")
    p.add_argument("--reports", help="folder for CSV reports")
    p.add_argument("--include", help="word list, one word a line")
    p.add_argument("--exclude", help="exclusion rules, one a line")
    p.add_argument("--adjacent-letters", help="lines of 'key -> neighbours'")
    p.add_argument("--all-words", action="store_true", help="take all validation words of fitting length, whatever --top-n or the file says")
    p.add_argument("--debug-words", help="words to trace, with commas")
    p.add_argument("--debug-typos", help="typo patterns to trace, with commas")
    p.add_argument("--verbose", action="store_true")
    p.add_argument("--debug", action="store_true")
    p.add_argument("--log-file", help="also log to this file")
    for name, kind in NUMBERS.items():
        p.add_argument(f"--{name.replace('_', '-')}", type=kind)
    return p


def set_up_logs(verbose: bool, debug: bool, path: str | None = None) -> None:
    """Messages to standard error and, if a path is given, to a file: warnings, or more where asked for."""
    log.setLevel(logging.DEBUG if debug else logging.INFO if verbose else logging.WARNING)
    for h in list(log.handlers):
        log.removeHandler(h)
        h.close()
    for h in (logging.StreamHandler(), *([logging.FileHandler(path, encoding="utf-8")] if path else [])):
        h.setFormatter(logging.Formatter("%(asctime)s %(levelname)s %(message)s"))
        log.addHandler(h)


def settings(args: argparse.Namespace):
    """The run's configuration: flags over the file over the defaults."""
    from dataclasses import replace

    from .config import Config

    words = lambda x: tuple(w.strip() for w in x.split(",") if w.strip()) if x else None
    c = Config.load(args.config, platform=args.platform, debug_words=words(args.debug_words), debug_typos=words(args.debug_typos), **{n: getattr(args, n) for n in NUMBERS})
    return replace(c, top_n=None) if args.all_words else c


def run(args: argparse.Namespace) -> list[str]:
    from pyspark.sql import SparkSession

    from .config import TYPO_RULES, WORD_RULES
    from .functions.names import human_time
    from .plans import reports, sinks
    from .plans.engine import Engine
    from .plans.solver import solve
    from .sources import adjacency_file, exclusion_file, include_file

    config = settings(args)
    spark = SparkSession.builder.appName("typoforge").getOrCreate()
    times: dict[str, float] = {}

    def done(stage: str, began: float) -> None:
        times[stage] = time.time() - began
        log.info("%s took %s", stage, human_time(times[stage]))

    began = time.time()
    rules = (WORD_RULES, TYPO_RULES)
    if args.exclude:  # a hand-written file of rules
        lines = sorted(r["rule"] for r in exclusion_file(spark, args.exclude).collect())
        rules = (tuple(r for r in lines if "->" not in r), tuple(r for r in lines if "->" in r))
    engine = Engine(spark, spark.read.parquet(args.documents), spark.read.parquet(args.benchmark), config, include_file(spark, args.include) if args.include else None, adjacency_file(spark, args.adjacent_letters) if args.adjacent_letters else None, rules)
    log.info("%d source words", engine.words.count())
    done("dictionaries", began)
    began = time.time()
    result = solve(engine)
    if not result.converged:
        log.warning("stopped after %d iterations before the rules settled; raise --max-iterations", result.iterations)
    log.info("%d iterations", result.iterations)
    done("solver", began)
    if config.debug_words or config.debug_typos:
        for r in reports.debug_corrections(result.engine).orderBy("typo", "word", "boundary").toLocalIterator():
            log.debug("traced: %s -> %s (%s)", r["typo"], r["word"], r["boundary"])
    began = time.time()
    if args.output == "-":
        sinks.print_espanso(result.rules)
        written = []
    elif config.platform == "qmk":
        written = [sinks.write_qmk(result.engine.ranked_rules, args.output)]
    else:
        written = sinks.write_espanso(result.rules, args.output, config.max_entries_per_file)
    done("output", began)
    if args.reports:
        reports.write_reports(result.engine, args.reports, config.platform, times)
    return written


def main(argv: list[str] | None = None) -> int:
    args = create_parser().parse_args(argv)
    set_up_logs(args.verbose, args.debug, args.log_file)
    try:
        for path in run(args):
            print(path)
    except (FileNotFoundError, PermissionError, IsADirectoryError, UnicodeDecodeError, ValueError) as e:
        log.error("%s: %s", type(e).__name__, e)
        return 1
    return 0


if __name__ == "__main__":
    raise SystemExit(main())
