"""What search hits refer to: links of Markdown hits, citations and notes of code hits."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textloom.functions.refs import decoded_refs, markdown_links
from textloom.operators.resolve import resolve_anchors, resolve_links, resolve_notes


def markdown_references(hits: DataFrame, files: DataFrame, sections: DataFrame, id_column: str = "id") -> DataFrame:
    """id, n (order), file_path, anchor, alias, candidates and resolved_section of each link in
    the Markdown `hits` (id, language, file_path, content).

    A link's file need not be indexed; a bare wikilink resolves to the only document of its
    stem (`files`: path), and an anchor to the first section (`sections`) of that file with its
    slug. `hits` are the few rows of one search.
    """
    links = hits.where("language = 'markdown'").select(F.col(id_column).alias("id"), F.posexplode(markdown_links(F.col("content"), F.col("file_path"))).alias("n", "l")).select("id", "n", "l.*")
    found = resolve_links(links, files)
    path = F.coalesce("target", "resolved").alias("file_path")
    return resolve_anchors(found.select("id", "n", path, "anchor", "alias", "candidates"), sections).withColumnRenamed("section", "resolved_section").withColumnRenamed("id", id_column)


def code_references(hits: DataFrame, files: DataFrame, id_column: str = "id") -> DataFrame:
    """id, n, kind, key, text, note_path and candidates of each reference of the `hits`
    (id, language, references) that aren't Markdown: a citation or wikilink resolves to the
    only document (`files`: path) that fits, several are candidates; annotations have a text."""
    refs = hits.where("language <> 'markdown'").select(F.col(id_column).alias("id"), F.posexplode(decoded_refs(F.col("references"))).alias("n", "r")).select("id", "n", "r.*")
    documents = files.where(F.lower("path").endswith(".md")).select("path")
    noted = F.col("kind") == "annotation"
    found = resolve_notes(refs, documents)
    none = F.array().cast("array<string>")
    return found.select(F.col("id").alias(id_column), "n", "kind", "key", "text", F.when(~noted, F.col("note_path")).alias("note_path"), F.when(noted, none).otherwise(F.col("candidates")).alias("candidates"))
