"""Column functions on paths and texts: extensions, languages, stems, folders, line ends."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Languages by extension, for files, for diffs, and for embedding.
EXTENSIONS = {"py": "python", "java": "java", "js": "javascript", "mjs": "javascript", "ts": "typescript", "go": "go", "rb": "ruby", "rs": "rust"}
DIFF_EXTENSIONS = {"py": "python", "js": "javascript", "ts": "typescript", "java": "java", "go": "go", "rb": "ruby", "rs": "rust"}
DETECTED_EXTENSIONS = {
    "py": "python", "java": "java", "ts": "typescript", "js": "javascript", "go": "go", "kt": "kotlin",
    "scala": "scala", "cpp": "cpp", "c": "c", "cs": "csharp", "rb": "ruby", "rs": "rust",
}


def extension(path: Column | str) -> Column:
    return F.lower(F.regexp_extract(path, r"\.([A-Za-z0-9]+)$", 1))


def language(path: Column | str, names: dict[str, str] = EXTENSIONS) -> Column:
    """The language of a path's extension, or unknown."""
    ext, out = extension(path), F.lit("unknown")
    for e, name in names.items():
        out = F.when(ext == e, name).otherwise(out)
    return out


def stem(path: Column | str) -> Column:
    """The last part of a path without its last extension; a leading dot is no extension."""
    return F.regexp_extract(F.element_at(F.split(path, "/"), -1), r"^(.+?)(?:\.[^.]*)?$", 1)


def one_line_end(text: Column) -> Column:
    return F.replace(F.replace(text, F.lit("\r\n"), F.lit("\n")), F.lit("\r"), F.lit("\n"))


def folder(path: Column | str) -> Column:
    return F.regexp_replace(path, "/?[^/]*$", "")


def normal(path: Column) -> Column:
    """A path without . and .. parts; null where it leaves the root."""
    step = lambda acc, s: F.when(s.isin("", "."), acc).when(s == "..", F.when(F.size(acc) > 0, F.slice(acc, F.lit(1), F.size(acc) - 1))).otherwise(F.concat(acc, F.array(s)))
    parts = F.aggregate(F.split(path, "/"), F.array().cast("array<string>"), lambda acc, s: F.when(acc.isNotNull(), step(acc, s)))
    return F.when(F.size(parts) > 0, F.array_join(parts, "/"))
