"""Snapshots of an index: folders of Parquet tables, published by a small manifest.

All tables of a version are written to its folder first; replacing the manifest is the commit,
so readers see the old version or the new one and never a half of it. A reader pins the
version once (`Store.snapshot`) and then reads its tables only.
"""

from __future__ import annotations

import fcntl
import json
import os
import shutil
from collections.abc import Iterator
from contextlib import contextmanager
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

#: Versions of the index format.
LEAST_VERSION, VERSION = "2.0.0", "2.1.0"
MANIFEST, LOCK = "manifest.json", "reindex.lock"


def version_key(text: str) -> tuple[int, ...]:
    """Components as numbers, 0 for those that aren't."""
    return tuple(int(p) if p.isdigit() else 0 for p in text.split("."))


class Snapshot:
    """The tables of one version."""

    def __init__(self, spark: SparkSession, folder: Path, manifest: dict):
        self.spark, self.folder, self.manifest = spark, folder, manifest

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(str(self.folder / name))

    def put(self, name: str, df: DataFrame, by: str | None = None) -> DataFrame:
        """Write a table (in folders of the values of `by`) and read it back."""
        writer = df.write.mode("overwrite")
        (writer.partitionBy(by) if by else writer).parquet(str(self.folder / name))
        return self.table(name)

    def drop(self, *names: str) -> None:
        """Remove tables that were only needed to make the others."""
        for name in names:
            shutil.rmtree(self.folder / name, ignore_errors=True)


class Store:
    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, Path(folder)

    def exists(self) -> bool:
        return (self.folder / MANIFEST).is_file()

    def manifest(self) -> dict:
        """The published manifest; FileNotFoundError without one, RuntimeError if too old."""
        found = json.loads((self.folder / MANIFEST).read_text("utf-8"))
        if version_key(found.get("index_version", "0")) < version_key(LEAST_VERSION):
            raise RuntimeError("the index is too old: index the workspace again")
        return found

    def snapshot(self) -> Snapshot:
        """The published version, pinned."""
        return Snapshot(self.spark, self.folder / self.manifest()["snapshot"], self.manifest())

    def draft(self) -> Snapshot:
        """A new version that nobody reads before it is committed."""
        number = int(self.manifest()["snapshot"].removeprefix("v")) + 1 if self.exists() else 1
        return Snapshot(self.spark, self.folder / f"v{number}", {})

    def commit(self, draft: Snapshot, facts: dict) -> dict:
        """Make a draft, whose tables are all written, the published version."""
        manifest = facts | {"snapshot": draft.folder.name, "index_version": VERSION}
        self.folder.mkdir(parents=True, exist_ok=True)
        new = self.folder / f"{MANIFEST}.new"
        new.write_text(json.dumps(manifest, ensure_ascii=False), "utf-8")
        os.replace(new, self.folder / MANIFEST)
        self._prune(draft.folder.name)
        return manifest

    def _prune(self, current: str) -> None:
        """Remove versions older than the one before `current`, which readers may still have."""
        number = int(current.removeprefix("v"))
        for old in self.folder.glob("v[0-9]*"):
            if old.name.removeprefix("v").isdigit() and int(old.name.removeprefix("v")) < number - 1:
                shutil.rmtree(old, ignore_errors=True)

    @contextmanager
    def lock(self) -> Iterator[bool]:
        """Whether this process may write: never waits for another that does."""
        self.folder.mkdir(parents=True, exist_ok=True)
        with open(self.folder / LOCK, "w") as f:
            try:
                fcntl.flock(f, fcntl.LOCK_EX | fcntl.LOCK_NB)
            except OSError:
                yield False
                return
            try:
                yield True
            finally:
                fcntl.flock(f, fcntl.LOCK_UN)

    def is_locked(self) -> bool:
        try:
            with open(self.folder / LOCK) as f:
                fcntl.flock(f, fcntl.LOCK_EX | fcntl.LOCK_NB)
                fcntl.flock(f, fcntl.LOCK_UN)
            return False
        except BlockingIOError:
            return True
        except OSError:
            return False
