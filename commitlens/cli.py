"""Command line: prints the report as a table."""

from __future__ import annotations

import logging
import subprocess
import sys

from commitlens.options import logging_level, parse

VERSION = "0.1.0"


def version_line() -> str:
    done = subprocess.run(["git", "rev-parse", "HEAD"], cwd=__file__.rsplit("/", 1)[0], capture_output=True, text=True, check=False)
    return f"version: {VERSION}, git commit: {done.stdout.strip() or 'unknown'}"


def table(rows) -> str:
    """Rows under the headings FILE, LINE, FUNCTION, FREQUENCY."""
    cells = [("FILE", "LINE", "FUNCTION", "FREQUENCY"), *((r[0], str(r[1]), r[2], str(r[3])) for r in rows)]
    wide = [max(len(c[k]) for c in cells) for k in range(4)]
    lines = ["  ".join(v.ljust(w) for v, w in zip(c, wide, strict=True)).rstrip() for c in cells]
    return "\n".join([lines[0], "-" * len(lines[0]), *lines[1:]])


def main(argv: list[str] | None = None) -> int:
    options = parse(argv)
    logging.basicConfig(level=logging_level(options.log_level))
    if options.command == "version":
        print(version_line())
        return 0
    from pyspark.sql import SparkSession

    from commitlens.plans import hotspots
    from commitlens.sources.git import NotARepository

    # Progress of the tasks goes to a terminal.
    progress = str(sys.stderr.isatty()).lower()
    spark = SparkSession.builder.appName("commitlens").config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", progress).getOrCreate()
    try:
        print(table(hotspots.run(spark, options).collect()))
    except NotARepository as e:
        print(f"not a git repository: {e}", file=sys.stderr)
        return 1
    except hotspots.NoFilesFound as e:
        print(f"no files found in {e}", file=sys.stderr)
        return 1
    finally:
        spark.stop()
    return 0
