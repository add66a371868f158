"""A workspace's files as a DataFrame.

The walk runs on the driver, since Spark's file sources skip names that begin with `_` or
`.`; it yields paths only. Contents are read by the executors, in the tasks that use them,
so the workspace has to be on a file system that they share.
"""

from __future__ import annotations

import os
import subprocess
from collections.abc import Iterator
from pathlib import Path

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textloom.functions.paths import IGNORED_DIRS, ignore_rules, is_ignored, language, matches_rules

#: Largest file, and seconds that git may take.
MOST_BYTES, GIT_SECONDS = 2 * 1024 * 1024, 10
IGNORE_FILE = ".indexignore"

FILES = "path string, mtime double, size long"


def scan_roots(workspace: str, paths: list[str] | None = None) -> list[str]:
    """The given folders or files as paths relative to the workspace; outside: ValueError."""
    top = Path(workspace).resolve()
    found = []
    for p in paths or ["."]:
        full = (top / p).resolve()
        if not full.is_relative_to(top):
            raise ValueError(f"{p} is outside {workspace}")
        found.append(full.relative_to(top).as_posix())
    return found


def _walk(workspace: str, roots: list[str]) -> Iterator[tuple[str, float, int]]:
    for root in roots:
        full = os.path.join(workspace, root)
        if os.path.isfile(full):
            stat = os.stat(full)
            yield root, stat.st_mtime, stat.st_size
        for folder, names, files in os.walk(full):
            names[:] = sorted(n for n in names if n not in IGNORED_DIRS and not n.startswith("."))
            for name in files:
                path = os.path.join(folder, name)
                try:
                    stat = os.stat(path)
                except OSError:
                    continue  # gone since the listing
                yield os.path.relpath(path, workspace).replace(os.sep, "/"), stat.st_mtime, stat.st_size


def scan(spark: SparkSession, workspace: str, paths: list[str] | None = None) -> DataFrame:
    """path, mtime, size, language, and why a file isn't eligible (skipped; null: eligible)."""
    rows = sorted(set(_walk(workspace, scan_roots(workspace, paths))))
    ignore = Path(workspace) / IGNORE_FILE
    rules = ignore_rules(ignore.read_text("utf-8", "ignore")) if ignore.is_file() else []
    return decided(spark.createDataFrame(rows, FILES), rules)


def decided(files: DataFrame, rules: list[tuple[bool, str]]) -> DataFrame:
    """`files` (path, size) with language, and why a file isn't eligible (null: it is)."""
    files = files.withColumn("language", language(F.col("path")))
    why = F.when(is_ignored(F.col("path")) | matches_rules(F.col("path"), rules), "ignored").when(F.col("language").isNull(), "unsupported").when(F.col("size") > MOST_BYTES, "too big")
    return files.withColumn("skipped", why)


def with_content(files: DataFrame, workspace: str) -> DataFrame:
    """`files` (path, …) with content (UTF-8, undecodable bytes dropped) and sha256 of the
    bytes; files that can't be read are left out."""
    columns = files.columns

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import hashlib

        for batch in batches:
            for start in range(0, len(batch), 64):
                part = batch.iloc[start : start + 64].copy()
                data = []
                for p in part["path"]:
                    try:
                        with open(os.path.join(workspace, p), "rb") as f:
                            data.append(f.read())
                    except OSError:
                        data.append(None)
                part["content"] = [None if d is None else d.decode("utf-8", "ignore") for d in data]
                part["sha256"] = [None if d is None else hashlib.sha256(d).hexdigest() for d in data]
                yield part[part["content"].notna()]

    schema = ", ".join(f"`{c}` {t}" for c, t in files.dtypes) + ", content string, sha256 string"
    return files.select(*columns).mapInPandas(read, schema)


def git_head(workspace: str) -> str | None:
    try:
        done = subprocess.run(["git", "rev-parse", "HEAD"], cwd=workspace, capture_output=True, text=True, timeout=GIT_SECONDS)
    except (OSError, subprocess.TimeoutExpired):
        return None
    return done.stdout.strip() or None if done.returncode == 0 else None
