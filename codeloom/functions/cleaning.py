"""Column expressions that bring names, statuses, paths and hashes to one spelling."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

BLANKS = " \t\r\n\v\f"


def trimmed(c: Column) -> Column:
    """White space around a name does not count; an empty name is none."""
    return F.nullif(F.btrim(c, F.lit(BLANKS)), F.lit(""))


def status(c: Column) -> Column:
    return F.lower(trimmed(c))


def relative_path(c: Column) -> Column:
    """Forward slashes, no repeats, no leading ``./`` or ``/``, no blanks around it.

    Patterns are only tried on paths that hold what they look for, as most are clean.
    """
    path = F.replace(F.btrim(c, F.lit(BLANKS)), F.lit("\\"), F.lit("/"))
    odd = F.contains(path, F.lit("//")) | path.startswith("/") | path.startswith("./") | F.contains(path, F.lit("/."))
    out = F.regexp_replace(F.regexp_replace(path, "/{2,}", "/"), r"^(\./|/)+", "")
    return F.nullif(F.when(odd, F.regexp_replace(out, r"(/\.)+(?=/|$)", "")).otherwise(path), F.lit(""))


def hex_digest(c: Column) -> Column:
    """The hex digits of a digest in lower case, without an algorithm's name before them."""
    lower = F.lower(F.btrim(c, F.lit(BLANKS)))
    named = F.regexp_extract(lower, r"^(?:[a-z0-9_-]+[:=])?\s*(?:0x)?([0-9a-f]+)$", 1)
    return F.nullif(F.when(lower.rlike("^[0-9a-f]+$"), lower).otherwise(named), F.lit(""))
