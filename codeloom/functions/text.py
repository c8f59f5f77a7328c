"""Text expressions: search tokens, token counts, previews, fingerprints."""

from __future__ import annotations

import unicodedata
from functools import cache

from pyspark.sql import Column
from pyspark.sql import functions as F

#: A token is a name, a number, or any other single character that is not white space.
CODE_TOKEN = r"(?U)[A-Za-z_][A-Za-z0-9_]*|[0-9]+|[^\s\x{1c}-\x{1f}]"


@cache
def _fold_table() -> tuple[str, str]:
    """Letters that are one base letter and marks, and their base letter (a rule, not a list)."""
    found = {}
    for code in range(0xA0, 0x2000):
        c = chr(code)
        plain = "".join(x for x in unicodedata.normalize("NFD", c) if not unicodedata.combining(x))
        if len(plain) == 1 and plain != c and c == c.lower():
            found[c] = plain
    return "".join(found), "".join(found.values())


def search_tokens(c: Column) -> Column:
    """Runs of letters and digits, lower case, without diacritics; null and blank give an empty array."""
    letters, plain = _fold_table()
    lower = F.lower(F.coalesce(c, F.lit("")))
    folded = F.when(lower.rlike(r"[^\x00-\x7f]"), F.translate(lower, letters, plain)).otherwise(lower)
    return F.regexp_extract_all(folded, F.lit(r"([\p{L}\p{N}]+)"), 1)


def code_tokens(c: Column) -> Column:
    """Tokens that a context budget counts; null counts 0."""
    return F.coalesce(F.regexp_count(c, F.lit(CODE_TOKEN)), F.lit(0)).cast("int")


def preview(c: Column, width: int = 120) -> Column:
    """The first line with white space collapsed, cut to ``width`` characters."""
    line = F.btrim(F.regexp_replace(F.split(F.coalesce(c, F.lit("")), "\n")[0], r"\s+", " "))
    return F.when(F.length(line) > width, F.concat(F.substring(line, 1, width - 3), F.lit("..."))).otherwise(line)


def base_name(c: Column) -> Column:
    """The last component of a qualified name, without C++ parameters."""
    return F.regexp_extract(F.regexp_replace(c, r"\(.*$", ""), r"([^.:]+)$", 1)


def dense_document(name: Column, signature: Column, source: Column) -> Column:
    """The text that is embedded for a unit."""
    return F.concat(F.lit("symbol: "), name, F.lit("\nsignature: "), F.coalesce(signature, F.lit("")), F.lit("\ncode:\n"), F.coalesce(source, F.lit("")))
