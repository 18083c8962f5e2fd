"""Command line: build, merge, cat, search."""

from __future__ import annotations

import argparse
import sys

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from lexiloom.functions.bytesview import to_binary, unescape_separator
from lexiloom.operators.assembly import Options
from lexiloom.operators.kernels.genetic import Settings
from lexiloom.operators.membership import contains_word
from lexiloom.operators.merging import merge_archives
from lexiloom.plans.build import build_dictionary
from lexiloom.sources.archive import read_archive, read_header
from lexiloom.sources.text import read_separated, read_tokenizer


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="lexiloom", description="Compressed immutable string dictionaries on Spark.")
    sub = top.add_subparsers(dest="command", required=True)
    b = sub.add_parser("build")
    b.add_argument("-i", "--input", required=True)
    b.add_argument("-o", "--output", required=True)
    b.add_argument("-k", "--min-overlap", type=int, default=3)
    b.add_argument("--dp-limit", type=int, default=15)
    b.add_argument("--unordered", action="store_true")
    b.add_argument("--sep", default="\\n")
    b.add_argument("-v", "--verbose", action="store_true")
    b.add_argument("--ga-time", type=float, default=0.0, metavar="SECONDS")
    b.add_argument("--ga-iters", type=int, default=0)
    b.add_argument("--ga-seed", type=int, default=1)
    b.add_argument("--ga-pop", type=int, default=0)
    b.add_argument("--ga-tourney", type=int, default=0)
    b.add_argument("--ga-stag", type=int, default=0)
    b.add_argument("--tiktoken", action="store_true")
    b.add_argument("--metadata")
    m = sub.add_parser("merge")
    m.add_argument("--primary", required=True)
    m.add_argument("--update", required=True)
    m.add_argument("-o", "--output", required=True)
    m.add_argument("-v", "--verbose", action="store_true")
    c = sub.add_parser("cat")
    c.add_argument("file")
    s = sub.add_parser("search")
    s.add_argument("word")
    s.add_argument("file")
    return top


def _build(spark: SparkSession, a: argparse.Namespace) -> int:
    separator = unescape_separator(a.sep)
    corpus = read_tokenizer(spark, a.input) if a.tiktoken else read_separated(spark, a.input, separator)
    ga = None
    if a.ga_time > 0 or a.ga_iters > 0:
        ga = Settings(max(0, a.ga_pop), max(0, a.ga_tourney), max(0, a.ga_stag), a.ga_iters or 10**9, a.ga_time or None, a.ga_seed)
    built = build_dictionary(corpus, Options(a.min_overlap, a.dp_limit, a.ga_time, ga, verbose=a.verbose), not a.unordered, separator)
    size = built.write(a.output, a.metadata)
    if a.verbose:
        print(f"{a.output}: {size} bytes, payload/raw {built.compression():.3f}", file=sys.stderr)
    return 0


def _cat(spark: SparkSession, a: argparse.Namespace) -> int:
    separator = read_header(a.file).separator
    for row in read_archive(spark, a.file).select("ordinal", to_binary(F.col("b")).alias("data")).orderBy("ordinal").toLocalIterator():
        sys.stdout.buffer.write(bytes(row["data"]) + separator)
    sys.stdout.buffer.flush()
    return 0


def _search(spark: SparkSession, a: argparse.Namespace) -> int:
    hit = contains_word(read_archive(spark, a.file), a.word.encode("utf-8", "surrogateescape").decode("latin-1"))
    print("Match found" if hit else "Not found")
    return 0 if hit else 1


def _merge(spark: SparkSession, a: argparse.Namespace) -> int:
    size = merge_archives(spark, a.primary, a.update).write(a.output)
    if a.verbose:
        print(f"{a.output}: {size} bytes", file=sys.stderr)
    return 0


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> int:
    args = parser().parse_args(argv)
    try:
        spark = spark or SparkSession.builder.appName("lexiloom").getOrCreate()
        return {"build": _build, "merge": _merge, "cat": _cat, "search": _search}[args.command](spark, args)
    except Exception as e:
        print(f"error: {e}", file=sys.stderr)
        return 1


if __name__ == "__main__":
    sys.exit(main())
