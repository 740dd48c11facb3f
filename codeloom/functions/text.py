"""Text expressions shared by the operators. All of them run inside the JVM."""

from __future__ import annotations

import unicodedata
from functools import lru_cache

from pyspark.sql import Column
from pyspark.sql import functions as F


def compact_text(text: Column, limit: int = 160) -> Column:
    """One line: runs of white space become one blank, and what is longer than ``limit`` ends in an ellipsis."""
    line = F.trim(F.regexp_replace(text, r"(?U)\s+", " "))
    short = F.concat(F.rtrim(F.substring(line, 1, limit - 1)), F.lit("…"))
    return F.when(F.length(line) <= limit, line).otherwise(short)


def slugify(text: Column) -> Column:
    """Lower case, other characters than a-z and 0-9 as single dashes; ``project`` where nothing is left."""
    slug = F.regexp_replace(F.regexp_replace(F.lower(text), "[^a-z0-9]+", "-"), "^-+|-+$", "")
    return F.when(slug == "", "project").otherwise(slug)


def parse_properties(column: Column, schema: str) -> Column:
    """The JSON column as a struct; text that is no JSON object gives null fields."""
    return F.from_json(column, schema)


def json_tokens(json: Column) -> Column:
    """Estimated tokens of a JSON text: a quarter of its length, at least 1."""
    return F.greatest(F.lit(1), F.ceil(F.length(json) / 4)).cast("long")


def scope_is_path(entry: Column) -> Column:
    """Whether a scope entry names a file: it holds a slash or ends in .py, .ts or .js."""
    return entry.rlike(r"/|\.(py|ts|js)$")


@lru_cache(maxsize=1)
def _accents() -> tuple[str, str]:
    """Letters that decompose into a plain letter and combining marks, and those plain letters."""
    marked, plain = [], []
    for code in range(0xC0, 0x1F00):
        parts = unicodedata.normalize("NFD", chr(code))
        if len(parts) > 1 and all(unicodedata.combining(p) for p in parts[1:]):
            marked.append(chr(code))
            plain.append(parts[0])
    return "".join(marked), "".join(plain)


def fold(text: Column) -> Column:
    """Lower case without accents."""
    marked, plain = _accents()
    return F.regexp_replace(F.translate(F.lower(text), marked, plain), r"\p{Mn}", "")


def tokens(text: Column) -> Column:
    """Array of words: runs of letters and digits of the folded text."""
    return F.regexp_extract_all(fold(F.coalesce(text, F.lit(""))), F.lit(r"[\p{L}\p{N}\p{Co}]+"), 0)
