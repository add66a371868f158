"""Paths as Spark columns, languages by suffix, and ignore rules."""

from __future__ import annotations

import re
from urllib.parse import unquote, urlsplit

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Directories that are never indexed.
IGNORED_DIRS = (".git", "node_modules", ".venv", "venv", "env", "__pycache__", "dist", "build", ".tox", ".mypy_cache", ".pytest_cache", ".code-index")

#: The language of each suffix.
LANGUAGES = {
    ".py": "python", ".js": "javascript", ".jsx": "javascript", ".ts": "typescript", ".tsx": "typescript", ".go": "go",
    ".md": "markdown", ".txt": "text", ".cs": "csharp", ".java": "java", ".xml": "xml", ".razor": "razor",
    ".dart": "dart", ".pas": "pascal", ".dfm": "pascal", ".bas": "vb6", ".cls": "vb6", ".frm": "vb6",
    ".rs": "rust", ".rb": "ruby", ".php": "php", ".c": "c", ".h": "c", ".cpp": "cpp",
    ".hpp": "cpp", ".cc": "cpp", ".kt": "kotlin", ".kts": "kotlin", ".swift": "swift", ".sql": "sql",
    ".sh": "bash", ".bash": "bash", ".yaml": "yaml", ".yml": "yaml", ".json": "json", ".toml": "toml",
    ".vue": "vue", ".scala": "scala", ".lua": "lua", ".html": "html", ".css": "css", ".scss": "scss",
    ".ex": "elixir", ".exs": "elixir",
}


def suffix(path: Column) -> Column:
    """The lower-cased suffix with its dot, empty if there is none."""
    return F.lower(F.regexp_extract(path, r"[^/](\.[^./]*)$", 1))


def stem(path: Column) -> Column:
    """The last component without its suffix."""
    return F.regexp_extract(path, r"([^/]+?)(?:\.[^./]*)?$", 1)


def folder(path: Column) -> Column:
    """What stands before the last slash, empty if there is none."""
    return F.regexp_extract(path, "^(.*)/[^/]*$", 1)


def language(path: Column) -> Column:
    """Language by suffix, null for unknown ones: a lookup in a literal map."""
    known = F.create_map(*[F.lit(x) for pair in LANGUAGES.items() for x in pair])
    return F.try_element_at(known, suffix(path))


def normalised(path: Column) -> Column:
    """A path without `.` and, as far as possible, `..` components and empty ones."""
    up = F.lit("..")

    def step(done: Column, part: Column) -> Column:
        pops = (part == up) & (F.size(done) > 0) & (F.coalesce(F.element_at(F.concat(F.array(up), done), -1), up) != up)
        return F.when(pops, F.slice(done, 1, F.greatest(F.size(done) - 1, F.lit(0)))).when((part == "") | (part == "."), done).otherwise(F.concat(done, F.array(part)))

    return F.array_join(F.aggregate(F.split(path, "/"), F.array().cast("array<string>"), step), "/")


def joined(base: Column, path: Column) -> Column:
    """`path` seen from the folder `base`, normalised; an absolute one stays by itself."""
    return normalised(F.when(path.startswith("/") | (base == ""), path).otherwise(F.concat_ws("/", base, path)))


def prefix(text: str, strict: bool = True) -> str:
    """A path prefix to filter by: forward slashes; strict keeps a folder's last slash."""
    clean = re.sub("/{2,}", "/", text.replace("\\", "/"))
    clean = clean.removeprefix("./")
    return clean if strict else clean.rstrip("/")


def is_ignored(path: Column) -> Column:
    """Whether some component is an ignored or hidden folder, at any depth."""
    parts = F.split(path, "/")
    folders = F.slice(parts, 1, F.greatest(F.size(parts) - 1, F.lit(0)))
    return F.exists(parts, lambda x: x.isin(*IGNORED_DIRS)) | F.exists(folders, lambda x: x.startswith("."))


def _glob(pattern: str) -> str:
    """A pattern of an ignore file as a regular expression over a whole path."""
    anchored = "/" in pattern.rstrip("/")
    body = pattern.strip("/")
    found, i = "", 0
    while i < len(body):
        if body.startswith("**/", i):
            found, i = found + "(?:.*/)?", i + 3
        elif body.startswith("**", i):
            found, i = found + ".*", i + 2
        elif body[i] == "*":
            found, i = found + "[^/]*", i + 1
        elif body[i] == "?":
            found, i = found + "[^/]", i + 1
        elif body[i] == "[" and "]" in body[i + 1 :]:
            end = body.index("]", i + 1)
            found, i = found + "[" + body[i + 1 : end].replace("!", "^", 1) + "]", end + 1
        else:
            found, i = found + re.escape(body[i]), i + 1
    below = "/.*" if pattern.endswith("/") else "(?:/.*)?"
    return ("" if anchored else "(?:.*/)?") + found + below


def ignore_rules(text: str) -> list[tuple[bool, str]]:
    """(whether it ignores, regular expression) of each pattern of an ignore file."""
    rules = []
    for line in text.splitlines():
        line = line.rstrip() if not line.endswith("\\ ") else line
        if line and not line.startswith("#"):
            negated = line.startswith("!")
            rules.append((not negated, _glob(line[negated:].removeprefix("\\"))))
    return rules


def matches_rules(path: Column, rules: list[tuple[bool, str]]) -> Column:
    """Whether the rules ignore a path: the last rule that matches decides."""
    verdict = F.lit(False)
    for ignores, pattern in rules:
        verdict = F.when(path.rlike(f"^(?:{pattern})$"), F.lit(ignores)).otherwise(verdict)
    return verdict


def path_of_uri(uri: str) -> str:
    """The path that a `file://` URI names, its escapes decoded; anything else stays as it is."""
    parts = urlsplit(uri)
    if parts.scheme.lower() != "file":
        return uri
    path = unquote(parts.path)
    return path[1:] if re.match(r"^/[A-Za-z]:", path) else path
