"""Chunkers for texts: packing of lines and paragraphs, truncation, Markdown sections."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from textloom.functions.paths import stem
from textloom.functions.text import count_of, strip

#: Characters of a chunk, lines kept of a long one, and the line between.
CHUNK_CHARS, HEAD_LINES, TAIL_LINES, SHORT_LINES = 1000, 7, 3, 10
CUT_MARK = "# ... [conteúdo truncado para respeitar limites do modelo] ..."


def packed(parts: Column, most: int, between: int) -> Column:
    """Array of runs of consecutive parts: a run closes before the part that would take it
    beyond `most` characters; each further part costs `between` characters more."""
    empty = F.array().cast("array<string>")
    start = F.struct(F.array().cast("array<array<string>>").alias("done"), empty.alias("run"), F.lit(0).alias("size"))

    def step(state: Column, part: Column) -> Column:
        full = (state["size"] + F.length(part) > most) & (F.size(state["run"]) > 0)
        return F.struct(
            F.when(full, F.concat(state["done"], F.array(state["run"]))).otherwise(state["done"]).alias("done"),
            F.when(full, F.array(part)).otherwise(F.concat(state["run"], F.array(part))).alias("run"),
            F.when(full, F.length(part)).otherwise(state["size"] + F.length(part) + between).alias("size"),
        )

    return F.aggregate(parts, start, step, lambda s: F.when(F.size(s["run"]) > 0, F.concat(s["done"], F.array(s["run"]))).otherwise(s["done"]))


def truncated(content: Column, most: int = CHUNK_CHARS) -> Column:
    """A text of more than `most` characters and ten lines as its head and tail lines."""
    lines = F.split(F.regexp_replace(content, r"(\r\n|[\n\r\x0b\x0c\x1c-\x1e\x{85}\x{2028}\x{2029}])$", ""), r"\r\n|[\n\r\x0b\x0c\x1c-\x1e\x{85}\x{2028}\x{2029}]")
    short = F.concat(F.slice(lines, 1, HEAD_LINES), F.array(F.lit(CUT_MARK)), F.slice(lines, -TAIL_LINES, TAIL_LINES))
    return F.when((F.length(content) > most) & (F.size(lines) > SHORT_LINES), F.array_join(short, "\n")).otherwise(content)


def line_chunks(content: Column, most: int = CHUNK_CHARS) -> Column:
    """Array of chunks of whole lines; a text that fits is one chunk, a single long line
    is truncated."""
    lines = F.filter(F.split(content, r"(?<=\n)"), lambda x: x != "")
    runs = F.transform(packed(lines, most, 0), lambda run: F.regexp_replace(F.array_join(run, ""), r"\n+$", ""))
    whole = (F.length(content) <= most) | (F.size(lines) <= 1)
    return F.when(whole, F.array(truncated(content, most))).otherwise(runs)


def paragraph_chunks(content: Column, most: int = CHUNK_CHARS) -> Column:
    """Array of chunks of whole paragraphs (parted by blank lines), stripped and joined."""
    parts = F.filter(F.transform(F.split(content, "\n\n"), strip), lambda p: p != "")
    return F.transform(packed(parts, most, 2), lambda run: F.array_join(run, "\n\n"))


def chunk_id(content: Column, path: Column, start: Column, end: Column) -> Column:
    """First 16 digits of the SHA-256 of content, relative path and line range."""
    return F.substring(F.sha2(F.concat(content, path, F.concat_ws("-", start.cast("string"), end.cast("string"))), 256), 1, 16)


def start_lines(chunks: Column, content: Column, first: Column) -> Column:
    """The line of each paragraph chunk in its text, which begins at line `first`; each is
    looked for behind the one before, so repeated paragraphs have their own lines."""
    start = F.struct(F.lit(1).alias("at"), F.lit(1).alias("past"), first.cast("int").alias("line"), F.array().cast("array<int>").alias("lines"))

    def step(state: Column, chunk: Column) -> Column:
        found = F.position(F.substring_index(chunk, "\n\n", 1), content, state["past"])
        at = F.when(found > 0, found).otherwise(state["past"])
        line = (state["line"] + count_of(F.substring(content, state["at"], at - state["at"]), "\n")).cast("int")
        # In its text a chunk is as long as it is or longer: paragraphs are only stripped.
        return F.struct(at.alias("at"), (at + F.length(chunk)).alias("past"), line.alias("line"), F.concat(state["lines"], F.array(line)).alias("lines"))

    return F.aggregate(chunks, start, step, lambda s: s["lines"])


def explode_paragraphs(files: DataFrame, path: str = "file_path", content: str = "content", most: int = CHUNK_CHARS, keep: tuple[str, ...] = ()) -> DataFrame:
    """A row per paragraph chunk with its name and lines, and the columns `keep` of `files`."""
    rows = files.withColumn("__chunks", paragraph_chunks(F.col(content), most))
    rows = rows.select("*", F.posexplode(F.arrays_zip(F.col("__chunks").alias("c"), start_lines(F.col("__chunks"), F.col(content), F.lit(1)).alias("l"))).alias("__n", "__chunk"))
    name = F.when(F.size("__chunks") > 1, F.concat(stem(F.col(path)), F.lit("_chunk_"), (F.col("__n") + 1).cast("string"))).otherwise(stem(F.col(path)))
    start, chunk = F.col("__chunk.l"), F.col("__chunk.c")
    return rows.select(F.col(path).alias("file_path"), *keep, name.alias("scope_name"), F.lit("chunk").alias("scope_type"), start.alias("start_line"), (start + count_of(chunk, "\n")).alias("end_line"), chunk.alias("content"))


def markdown_sections(files: DataFrame, path: str = "file_path", content: str = "content", most: int = CHUNK_CHARS) -> DataFrame:
    """file_path, scope_name, scope_type, start_line, end_line and content of each section.

    A section runs from a heading to the line of the next one (which its end_line still
    counts); text before the first heading is the section `Intro`. A section of more than
    `most` characters comes in paragraph chunks, named `<title> (Parte n)`; a file without
    headings in plain paragraph chunks.
    """
    heading = r"(?m)^(?=#+[ \t]+\S)"
    headed = F.col(content).rlike(r"(?m)^#+[ \t]+\S")
    plain = explode_paragraphs(files.where(~headed), path, content, most)
    parts = files.where(headed).select(F.col(path).alias("file_path"), F.posexplode(F.split(content, heading)).alias("n", "part"))
    upward = Window.partitionBy("file_path").orderBy("n").rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.withColumn("first", (F.coalesce(F.sum(count_of(F.col("part"), "\n")).over(upward), F.lit(0)) + 1).cast("int")).where(strip(F.col("part")) != "")
    title = F.when(F.col("part").rlike(r"^#+[ \t]+\S"), strip(F.regexp_extract("part", r"^#+[ \t]+([^\n]*)", 1))).otherwise(F.lit("Intro"))
    parts, whole = parts.withColumn("title", title), F.length(strip(F.col("part"))) <= most
    short = parts.where(whole).select("file_path", F.col("title").alias("scope_name"), F.lit("section").alias("scope_type"), F.col("first").alias("start_line"), (F.col("first") + count_of(F.col("part"), "\n")).alias("end_line"), strip(F.col("part")).alias("content"))
    long = parts.where(~whole).withColumn("chunks", paragraph_chunks(F.col("part"), most))
    long = long.select("file_path", "title", F.size("chunks").alias("many"), F.posexplode(F.arrays_zip(F.col("chunks").alias("c"), start_lines(F.col("chunks"), F.col("part"), F.col("first")).alias("l"))).alias("k", "z"))
    name = F.when(F.col("many") > 1, F.concat("title", F.lit(" (Parte "), (F.col("k") + 1).cast("string"), F.lit(")"))).otherwise(F.col("title"))
    long = long.select("file_path", name.alias("scope_name"), F.lit("section").alias("scope_type"), F.col("z.l").alias("start_line"), (F.col("z.l") + count_of(F.col("z.c"), "\n")).alias("end_line"), F.col("z.c").alias("content"))
    return short.unionByName(long).unionByName(plain)
