"""Resolution joins: notes by stem, links by path or stem, anchors by slug, imports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textloom.functions.paths import folder, normalised, stem, suffix
from textloom.functions.text import slugify

#: What a relative script import may end with, in order of preference.
SCRIPT_SUFFIXES = (".ts", ".tsx", ".js", ".jsx", "/index.ts", "/index.tsx", "/index.js", "/index.jsx")


def resolve_notes(refs: DataFrame, documents: DataFrame) -> DataFrame:
    """`refs` (with key) with note_path and candidates: documents (path) whose lower-cased
    stem is the key or, if there is none, begins with the key and a hyphen.

    The exact stem is an equality join. For the rest every hyphen-bounded prefix of a stem is
    a key of its own, so the prefix match is an equality join too, not a nested loop.
    """
    docs = documents.select("path", F.lower(stem(F.col("path"))).alias("stem"))
    exact = docs.groupBy(F.col("stem").alias("key")).agg(F.sort_array(F.collect_set("path")).alias("exact"))
    words = F.split("stem", "-")
    prefixes = F.transform(F.sequence(F.lit(1), F.size(words) - 1), lambda n: F.array_join(F.slice(words, F.lit(1), n), "-"))
    longer = docs.where(F.size(words) > 1).select("path", F.explode(prefixes).alias("key"))
    longer = longer.groupBy("key").agg(F.sort_array(F.collect_set("path")).alias("longer"))
    found = refs.join(exact, "key", "left").join(longer, "key", "left")
    paths = F.coalesce("exact", "longer", F.array().cast("array<string>"))
    one = F.size(paths) == 1
    return found.select(*[c for c in refs.columns], F.when(one, paths[0]).alias("note_path"), F.when(one, F.array().cast("array<string>")).otherwise(paths).alias("candidates"))


def resolve_links(links: DataFrame, files: DataFrame) -> DataFrame:
    """`links` (target, stem, …) with resolved and candidates: an explicit target resolves to
    itself if it is a file, a bare stem to the only Markdown file of that stem."""
    paths = files.select(F.col("path").alias("target"), F.col("path").alias("__file"))
    stems = files.where(F.lower("path").endswith(".md")).groupBy(F.lower(stem(F.col("path"))).alias("stem")).agg(F.sort_array(F.collect_set("path")).alias("__paths"))
    found = links.join(paths, "target", "left").join(stems, "stem", "left")
    several = F.coalesce("__paths", F.array().cast("array<string>"))
    resolved = F.when(F.col("target").isNotNull(), F.col("__file")).when(F.size(several) == 1, several[0])
    return found.select(*links.columns, resolved.alias("resolved"), F.when(F.col("target").isNull() & (F.size(several) > 1), several).otherwise(F.array().cast("array<string>")).alias("candidates"))


def resolve_anchors(links: DataFrame, sections: DataFrame) -> DataFrame:
    """`links` (file_path, anchor) with the first section of that file whose name has the
    anchor's slug: section, null if there is none."""
    named = sections.select("file_path", slugify(F.col("scope_name")).alias("__slug"), "scope_name", "start_line")
    first = named.groupBy("file_path", "__slug").agg(F.min_by("scope_name", F.struct("start_line", "scope_name")).alias("section"))
    slugged = links.withColumn("__slug", slugify(F.col("anchor")))
    return slugged.join(first, ["file_path", "__slug"], "left").select(*links.columns, "section")


def python_candidates(path: Column, raw: Column) -> Column:
    """Paths that a Python import may mean, best first: each dot beyond the first climbs a
    folder; absolute names give up components from the right."""
    dots = F.length(F.regexp_extract(raw, r"^(\.*)", 1))
    parts = F.filter(F.split(F.regexp_replace(raw, r"^\.+", ""), r"\."), lambda x: x != "")
    up = F.concat(folder(path), F.repeat(F.lit("/.."), dots - 1))
    base = normalised(F.concat_ws("/", up, F.array_join(parts, "/")))
    both = lambda b: F.array(F.concat(b, F.lit(".py")), F.concat(b, F.lit("/__init__.py")))
    shorter = F.transform(F.sequence(F.size(parts), F.lit(1), F.lit(-1)), lambda n: both(F.array_join(F.slice(parts, F.lit(1), n), "/")))
    return F.when(dots > 0, both(base)).when(F.size(parts) > 0, F.flatten(shorter)).otherwise(F.array().cast("array<string>"))


def script_candidates(path: Column, raw: Column) -> Column:
    """Paths that a relative script import may mean; other imports are packages."""
    base = normalised(F.concat_ws("/", folder(path), raw))
    ends = F.array(*[F.concat(base, F.lit(s)) for s in SCRIPT_SUFFIXES])
    return F.when(raw.rlike(r"^\.\.?/"), ends).otherwise(F.array().cast("array<string>"))


def import_edges(imports: DataFrame, files: DataFrame) -> DataFrame:
    """path, raw_import, resolved: the first candidate that is a file, other than itself."""
    path, raw = F.col("path"), F.col("raw_import")
    found = F.when(suffix(path) == ".py", python_candidates(path, raw)).otherwise(script_candidates(path, raw))
    tried = imports.select("path", "raw_import", F.posexplode(found).alias("nth", "candidate"))
    hits = tried.join(files.select(F.col("path").alias("candidate")), "candidate")
    best = hits.groupBy("path", "raw_import").agg(F.min_by("candidate", "nth").alias("resolved"))
    return best.where("path <> resolved")
