"""History of functions from git.

``line_history`` asks git once for each different (file, name), which may be a
search pattern of git's or, in mode "literal", its escaped form. What git says
is taken as it is: a name can bind to another function's line, and no match is
an empty log. ``status`` tells why a log is empty. Logs that aren't UTF-8 are
decoded with replacement. The work tree must be mounted on all executors.
"""

from __future__ import annotations

import os
import re
import subprocess

import pandas as pd
from pyspark.sql import DataFrame

from commitlens.schema import GIT_LOG


class NotARepository(Exception):
    pass


def check_repository(root: str) -> None:
    """Fails if git doesn't accept ``root`` as part of a repository; its exit status alone counts."""
    try:
        code = subprocess.run(["git", "rev-parse", "--is-inside-work-tree"], cwd=root, capture_output=True, check=False).returncode
    except OSError as e:
        raise NotARepository(f"{root}: {e}") from e
    if code:
        raise NotARepository(root)


def pattern_of(name: str, mode: str) -> str:
    """What git is to search: the name itself, or with all that is special in a basic regular expression escaped."""
    return name if mode == "parity" else re.sub(r"([.\[\]*^$\\])", r"\\\1", name)


def log_of(root: str, file: str, name: str, mode: str = "parity") -> tuple[str, str]:
    """Log text and status: ok, no_match, untracked, bad_regex or error, by git's messages in its own language."""
    command = ["git", "--no-pager", "log", "--no-color", "--pretty=medium", "-L", f":{pattern_of(name, mode)}:{file.removeprefix('./')}"]
    try:
        done = subprocess.run(command, cwd=root, capture_output=True, check=False, env=os.environ | {"LC_ALL": "C"})
    except OSError:
        return "", "error"
    if not done.returncode:
        return done.stdout.decode("utf-8", "replace"), "ok"
    said = done.stderr.decode("utf-8", "replace")
    for words, status in (("no match", "no_match"), ("There is no path", "untracked"), ("does not exist", "untracked"), ("no path", "untracked"), ("regex", "bad_regex"), ("-L parameter", "bad_regex")):
        if words in said:
            return "", status
    return "", "error"


def line_history(keys: DataFrame, root: str, mode: str = "parity", tasks: int | None = None) -> DataFrame:
    """file, name, log, status of each different (file, name) of ``keys``."""
    n = tasks or keys.sparkSession.sparkContext.defaultParallelism

    def ask(batches):
        for b in batches:
            got = [log_of(root, f, m, mode) for f, m in zip(b["file"], b["name"], strict=True)]
            yield pd.DataFrame({"file": b["file"], "name": b["name"], "log": [x for x, _ in got], "status": [s for _, s in got]})

    return keys.select("file", "name").distinct().repartition(n, "file", "name").mapInPandas(ask, GIT_LOG)
