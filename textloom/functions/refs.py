"""References in texts: citations, notes, annotations and Markdown links, as columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from textloom.functions.paths import folder, joined
from textloom.functions.text import strip

#: The patterns of citations, annotations and links.
CITE = r"(?iuU)\b(DECISAO|DECISÃO|ADR|RFC|DEC)[-_ ]?(\d{1,4})\b"
ANNOTATION = r"(?imuU)^\s*(?:#|//|--|\*)\s*(NOTE|WHY):+\s*(.+)$"
WIKILINK = r"\[\[([^\]|#]*)(?:#([^\]|]*))?(?:\|([^\]]*))?\]\]"
LINK = r"\[([^\]]*)\]\(([^)\s]+)\)"
#: Prefixes of citations that mean the same, longest text of an annotation.
DECISION_PREFIXES, ANNOTATION_CHARS = ("decisao", "decisão", "dec"), 200


def _all(text: Column, pattern: str, group: int) -> Column:
    return F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(pattern), F.lit(group))


def cite_key(prefix: Column, number: Column) -> Column:
    """`dec-007` for any spelling of a decision; other prefixes in lower case."""
    low = F.lower(prefix)
    return F.concat(F.when(low.isin(*DECISION_PREFIXES), F.lit("dec")).otherwise(low), F.lit("-"), F.format_string("%03d", number.cast("int")))


def wikilink_key(target: Column) -> Column:
    """Lower-cased last component without `.md`; null for other suffixes or nothing."""
    name = F.element_at(F.split(strip(target), "/"), -1)
    bare = F.when(F.lower(name).endswith(".md"), F.substring(name, 1, F.length(name) - 3)).when(~name.contains("."), name)
    key = F.lower(strip(bare))
    return F.when(key != "", key)


def rationale_refs(content: Column) -> Column:
    """array<struct<kind, key, text>>: citations, then wikilinks, then annotations, each
    in text order and once."""
    cites = F.zip_with(_all(content, CITE, 1), _all(content, CITE, 2), lambda p, n: F.struct(F.lit("cite").alias("kind"), cite_key(p, n).alias("key"), F.lit(None).cast("string").alias("text")))
    wikis = F.transform(_all(content, WIKILINK, 1), lambda t: F.struct(F.lit("wikilink").alias("kind"), wikilink_key(t).alias("key"), F.lit(None).cast("string").alias("text")))
    notes = F.zip_with(
        _all(content, ANNOTATION, 1),
        _all(content, ANNOTATION, 2),
        lambda k, t: F.struct(F.lit("annotation").alias("kind"), F.lower(k).alias("key"), F.substring(strip(t), 1, ANNOTATION_CHARS).alias("text")),
    )
    kept = F.filter(F.concat(cites, wikis, notes), lambda r: r["key"].isNotNull() & (F.coalesce(r["text"], F.lit("-")) != ""))
    return F.array_distinct(kept)


def encode_ref(ref: Column) -> Column:
    """`cite:key`, `wikilink:key`, or `note:text` and `why:text` for annotations."""
    return F.when(ref["kind"] == "annotation", F.concat_ws(":", ref["key"], ref["text"])).otherwise(F.concat_ws(":", ref["kind"], ref["key"]))


def encoded_refs(content: Column) -> Column:
    return F.transform(rationale_refs(content), encode_ref)


def decoded_refs(refs: Column) -> Column:
    """array<struct<kind, key, text>> of encoded references, the inverse of `encode_ref`;
    what isn't one is left out."""

    def one(ref: Column) -> Column:
        head, rest = F.substring_index(ref, ":", 1), F.regexp_extract(ref, r"(?s)^[^:]*:(.*)$", 1)
        noted = head.isin("note", "why")
        known = (noted | head.isin("cite", "wikilink")) & (rest != "")
        return F.when(known, F.struct(F.when(noted, "annotation").otherwise(head).alias("kind"), F.when(noted, head).otherwise(rest).alias("key"), F.when(noted, rest).alias("text")))

    return F.array_compact(F.transform(F.coalesce(refs, F.array().cast("array<string>")), one))


def decode_refs(text: Column) -> Column:
    """A JSON list of strings as an array; anything else gives an empty one."""
    return F.coalesce(F.from_json(text, "array<string>"), F.array().cast("array<string>"))


def _md(path: Column) -> Column:
    return F.lower(path).endswith(".md")


def markdown_links(content: Column, source_path: Column) -> Column:
    """array<struct<target, stem, anchor, alias>> of links to Markdown files.

    `target` is a path seen from the source's folder; for a bare wikilink it is null and
    `stem` (lower case) has to be looked up among all files. Links to other schemes, pure
    anchors and other suffixes are left out; each link counts once.
    """
    base = folder(source_path)
    none = F.lit(None).cast("string")
    blank = lambda c: F.when(strip(c) != "", strip(c))

    def plain(dest: Column) -> Column:
        cut = F.split(dest, "#", 2)
        anchor = F.when(F.size(cut) > 1, F.element_at(cut, -1))
        usable = _md(cut[0]) & ~F.lower(dest).rlike("^(?:https?://|mailto:)")
        return F.when(usable, F.struct(joined(base, cut[0]).alias("target"), none.alias("stem"), F.when(anchor != "", anchor).alias("anchor"), none.alias("alias")))

    def wiki(raw: Column, anchor: Column, alias: Column) -> Column:
        target = strip(raw)
        explicit = target.startswith(".") | target.contains("/")
        dotted = F.element_at(F.split(target, "/"), -1).contains(".")
        path = F.when(dotted, target).otherwise(F.concat(target, F.lit(".md")))
        stem = F.lower(F.when(target.contains("."), F.substring(target, 1, F.length(target) - 3)).otherwise(target))
        return F.when(
            (target != "") & (~dotted | _md(target)),
            F.struct(F.when(explicit, joined(base, path)).alias("target"), F.when(~explicit, stem).alias("stem"), blank(anchor).alias("anchor"), blank(alias).alias("alias")),
        )

    links = F.transform(_all(content, LINK, 2), plain)
    triples = F.arrays_zip(_all(content, WIKILINK, 1).alias("a"), _all(content, WIKILINK, 2).alias("b"), _all(content, WIKILINK, 3).alias("c"))
    wikis = F.transform(triples, lambda t: wiki(t["a"], t["b"], t["c"]))
    return F.array_distinct(F.array_compact(F.concat(links, wikis)))
