"""Detects the encodings of files: ``python -m byteloom.cli [options] [files ...]``; without files, of standard input."""

from __future__ import annotations

import argparse
import sys
from collections.abc import Sequence

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from byteloom import __version__
from byteloom.operators import names
from byteloom.operators.detect import detect
from byteloom.operators.options import MAX_BYTES, DetectOptions
from byteloom.sources.files import read_files
from byteloom.tables.registry import Era


def _list(text: str) -> tuple[str, ...]:
    return tuple(part.strip() for part in text.split(","))


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="byteloom", description="Detect character encoding of files.")
    p.add_argument("files", nargs="*")
    p.add_argument("--minimal", action="store_true", help="output only the encoding name")
    p.add_argument("-l", "--language", action="store_true", help="include the detected language")
    p.add_argument("-e", "--encoding-era", default="ALL", metavar="ERA", help=f"one of {', '.join(Era.__members__)}; any other means ALL")
    p.add_argument("-i", "--include-encodings", type=_list, metavar="LIST", help="comma-separated encodings to consider")
    p.add_argument("-x", "--exclude-encodings", type=_list, metavar="LIST", help="comma-separated encodings to leave out")
    p.add_argument("--no-match-encoding", default="cp1252", metavar="ENC", help="for inconclusive input (default: cp1252)")
    p.add_argument("--empty-input-encoding", default="utf-8", metavar="ENC", help="for empty input (default: utf-8)")
    p.add_argument("--version", action="version", version=f"byteloom {__version__}")
    return p


def main(argv: Sequence[str] | None = None, stdin: bytes | None = None, spark: SparkSession | None = None, write=None, write_error=None) -> int:
    """Exit status 1 if no file at all could be read."""
    write, write_error = write or sys.stdout.write, write_error or sys.stderr.write
    args = parser().parse_args(argv)
    era = Era.__members__.get(args.encoding_era.upper().replace("-", "_"), Era.ALL)
    options = DetectOptions(era, args.include_encodings, args.exclude_encodings, no_match_encoding=args.no_match_encoding, empty_input_encoding=args.empty_input_encoding)
    spark = spark or SparkSession.builder.appName("byteloom").getOrCreate()
    failed = 0
    if args.files:
        frames = []
        for at, path in enumerate(args.files):
            try:
                # The plan is made for each file alone, so one that is missing doesn't fail the others.
                frames.append(read_files(spark, path).select(F.lit(at).alias("at"), F.lit(path).alias("label"), "content"))
            except Exception as e:
                write_error(f"byteloom: {path}: {e}\n")
                failed += 1
        if not frames:
            return 1
        data = frames[0]
        for f in frames[1:]:
            data = data.unionByName(f)
    else:
        content = sys.stdin.buffer.read(MAX_BYTES) if stdin is None else stdin[:MAX_BYTES]
        data = spark.createDataFrame([(0, "stdin", bytearray(content))], "at int, label string, content binary")
    found = detect(data, options=options)
    lines = found.select("at", names.report(F.col("label"), F.col("detected"), args.minimal, args.language).alias("line"))
    for r in lines.orderBy("at").toLocalIterator():
        write(r["line"] + "\n")
    return int(bool(args.files) and failed == len(args.files))


if __name__ == "__main__":
    sys.exit(main())
