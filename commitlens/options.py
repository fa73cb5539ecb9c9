"""Options of the report, from Python or the command line."""

from __future__ import annotations

import argparse
import logging
from dataclasses import dataclass


@dataclass(frozen=True)
class ReportOptions:
    total: int = 50
    skip: int = 0
    log_level: int = 0
    prefix: tuple[str, ...] = ()
    invert_match: tuple[str, ...] = ()
    exclude_func: tuple[str, ...] = ()
    root: str = "."
    #: "parity": a name is a search pattern for git as it is; "literal": its special characters are escaped.
    mode: str = "parity"
    command: str | None = None


def logging_level(count: int) -> int:
    """Of the times -V was given: off, errors, warnings, information, all."""
    return (logging.CRITICAL + 10, logging.ERROR, logging.WARNING, logging.INFO, logging.DEBUG)[max(0, min(count, 4))]


def parse(argv: list[str] | None = None) -> ReportOptions:
    p = argparse.ArgumentParser(prog="commitlens", description="Rank the functions of a source tree by the commits that touched them.")
    p.add_argument("-t", "--total", type=_count, default=50, help="rows to print")
    p.add_argument("-s", "--skip", type=_count, default=0, help="rows to leave out first")
    p.add_argument("-V", "--log-level", action="count", default=0, help="more logging each time it is given")
    p.add_argument("-p", "--prefix", nargs="+", action="extend", default=[], help="only files below these paths")
    p.add_argument("-v", "--invert-match", nargs="+", action="extend", default=[], help="no files whose path contains one of these")
    p.add_argument("-F", "--exclude-func", nargs="+", action="extend", default=[], help="no functions whose name contains one of these")
    p.add_argument("-r", "--root", default=".", help="the source tree, inside a git work tree")
    p.add_argument("--mode", choices=("parity", "literal"), default="parity", help="how names are given to git")
    p.add_subparsers(dest="command").add_parser("version", help="print the version")
    a = p.parse_args(argv)
    return ReportOptions(a.total, a.skip, a.log_level, tuple(a.prefix), tuple(a.invert_match), tuple(a.exclude_func), a.root, a.mode, a.command)


def _count(text: str) -> int:
    n = int(text)
    if n < 0:
        raise argparse.ArgumentTypeError("must not be negative")
    return n
