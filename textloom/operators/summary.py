"""Status, symbol map, dry-run counts, staleness, and the difference of two file lists."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Folders that a partial run prefers, files of a large workspace, seconds.
PREFERRED, LARGE, RECOMMENDED, DEBOUNCE_S = ("src", "docs", "app", "apps", "packages", "backend", "frontend"), 200, 3, 300


def status(chunks: DataFrame) -> DataFrame:
    """One row: chunks, and the sorted repositories and languages."""
    return chunks.agg(F.count(F.lit(1)).alias("total_chunks"), F.sort_array(F.collect_set("repo")).alias("repos"), F.sort_array(F.collect_set("language")).alias("languages"))


def symbol_map(symbols: DataFrame, max_depth: int = 3) -> DataFrame:
    """entry, n_symbols, n_files for symbols (file_path, scope_type, scope_name).

    Deeper files than max_depth + 1 components come together as `<first components>/...`
    without symbols; modules are not listed as symbols.
    """
    parts = F.split("file_path", "/")
    deep = F.size(parts) > max_depth + 1
    entry = F.when(deep, F.concat(F.array_join(F.slice(parts, 1, max_depth), "/"), F.lit("/..."))).otherwise(F.col("file_path"))
    listed = ~deep & (F.col("scope_type") != "module")
    return symbols.groupBy(entry.alias("entry")).agg(F.sum(listed.cast("long")).alias("n_symbols"), F.countDistinct("file_path").alias("n_files"))


def map_totals(symbols: DataFrame, max_depth: int = 3) -> DataFrame:
    """One row: total_files, before deep ones come together, and total_symbols, those listed."""
    listed = (F.size(F.split("file_path", "/")) <= max_depth + 1) & (F.col("scope_type") != "module")
    return symbols.agg(F.countDistinct("file_path").alias("total_files"), F.coalesce(F.sum(listed.cast("long")), F.lit(0)).alias("total_symbols"))


def map_lines(symbols: DataFrame, max_depth: int = 3) -> DataFrame:
    """The map's text lines in order: an entry, then its symbols as `  label name`."""
    parts = F.split("file_path", "/")
    deep = F.size(parts) > max_depth + 1
    entry = F.when(deep, F.concat(F.array_join(F.slice(parts, 1, max_depth), "/"), F.lit("/..."))).otherwise(F.col("file_path"))
    label = F.when(F.col("scope_type") == "class", "class").when(F.col("scope_type") == "function", "func").when(F.col("scope_type") == "method", "method").otherwise(F.col("scope_type"))
    heads = symbols.select(entry.alias("entry"), F.lit("").alias("name"), entry.alias("line")).distinct()
    below = symbols.where(~deep & (F.col("scope_type") != "module")).select(entry.alias("entry"), F.col("scope_name").alias("name"), F.concat_ws(" ", F.lit(" "), label, "scope_name").alias("line"))
    return heads.unionByName(below).orderBy("entry", "name", "line")


def dry_run(files: DataFrame) -> DataFrame:
    """path and eligible files of each top-level entry of files (path)."""
    return files.groupBy(F.element_at(F.split("path", "/"), 1).alias("path")).agg(F.count(F.lit(1)).alias("eligible_files"))


def recommended(counts: DataFrame) -> DataFrame:
    """The entries to begin with in a large workspace: at most three, the fullest first."""
    total = counts.agg(F.sum("eligible_files").alias("total"))
    usable = counts.where(F.col("path").isin(*PREFERRED) | (F.col("eligible_files") > 1))
    return usable.join(F.broadcast(total)).where(F.col("total") > LARGE).drop("total").orderBy(F.desc("eligible_files"), "path").limit(RECOMMENDED)


def is_stale(indexed_sha: Column, head_sha: Column) -> Column:
    return F.coalesce(indexed_sha != head_sha, F.lit(False))


def is_debounced(indexed_at: Column, now: Column, indexed_sha: Column, head_sha: Column) -> Column:
    """Whether the last run is so recent, and of the same known commit, that none is due."""
    age = now.cast("double") - indexed_at.cast("double")
    return F.coalesce((age < DEBOUNCE_S) & (indexed_sha == head_sha), F.lit(False))


def file_diff(current: DataFrame, known: DataFrame, *, full: bool = False) -> DataFrame:
    """path and status (new, changed, unchanged, touched, deleted) of two file lists.

    Both have path, mtime, size, sha256. With equal time and size the hash need not be
    known (null) and doesn't count; `full` makes every known file changed.
    """
    new = current.select("path", F.struct("mtime", "size", "sha256").alias("now"))
    old = known.select("path", F.struct("mtime", "size", "sha256").alias("was"))
    same_meta = (F.col("now.mtime") == F.col("was.mtime")) & (F.col("now.size") == F.col("was.size"))
    state = (
        F.when(F.col("now").isNull(), "deleted")
        .when(F.col("was").isNull(), "new")
        .when(F.lit(full), "changed")
        .when(same_meta, "unchanged")
        .when(F.col("now.sha256") == F.col("was.sha256"), "touched")
        .otherwise("changed")
    )
    return new.join(old, "path", "full_outer").select("path", state.alias("status"))


def replaced(chunks: DataFrame, gone: DataFrame, added: DataFrame) -> DataFrame:
    """The next snapshot: `chunks` without those of the paths in `gone`, and `added`."""
    kept = chunks.join(gone.select(F.col("path").alias("file_path")), "file_path", "left_anti")
    return kept.select(*chunks.columns).unionByName(added.select(*chunks.columns))
