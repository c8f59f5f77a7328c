"""Source files that do not parse, found by derivatives of their language's grammar."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from codeloom.functions.cleaning import trimmed
from codeloom.llm import cpp_syntax, python_syntax
from codeloom.llm.derivatives import Grammar

PYTHON, CPP = "python", "cpp"
EXTENSIONS = {PYTHON: ("py", "pyi"), CPP: ("cpp", "cc", "cxx", "c++", "hpp", "hh", "hxx", "h++", "h", "ipp", "tpp", "inl", "cppm", "ixx")}
_SCHEMA = "file_id long, repo string, language string, has_syntax_errors boolean, failure string, failing_token int, n_tokens int"
_GRAMMARS: dict[str, Grammar] = {}


def language_of(path: Column) -> Column:
    """The language that the extension of ``path`` names, in either case; null for others."""
    extension = F.lower(F.regexp_extract(trimmed(path), r"\.([^./\\]+)$", 1))
    out = F.lit(None).cast("string")
    for language, extensions in EXTENSIONS.items():
        out = F.when(extension.isin(*extensions), F.lit(language)).otherwise(out)
    return out


def _grammar(language: str) -> Grammar:
    """One grammar with its memoised derivatives per worker process."""
    if language not in _GRAMMARS:
        _GRAMMARS[language] = (python_syntax if language == PYTHON else cpp_syntax).grammar()
    return _GRAMMARS[language]


def check_text(text: str, language: str) -> tuple[bool, str | None, int | None, int]:
    """(invalid, 'error' or 'truncated', index of the failing token, number of tokens)."""
    tokens = (python_syntax if language == PYTHON else cpp_syntax).tokens(text)
    truncated, at = _grammar(language).verdict(tokens)
    n = len(tokens.classes) if tokens.end is None else tokens.end
    return at is not None, None if at is None else "truncated" if truncated else "error", at, n


def _check(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    columns = ["file_id", "repo", "language", "has_syntax_errors", "failure", "failing_token", "n_tokens"]
    for pdf in batches:
        rows = [(f, r, g, *check_text(t, g)) for f, r, g, t in zip(pdf["file_id"], pdf["repo"], pdf["language"], pdf["content"])]
        out = pd.DataFrame(rows, columns=columns)
        yield out.astype({"failing_token": "Int32", "n_tokens": "int32", "has_syntax_errors": bool})


def check_files(files: DataFrame) -> DataFrame:
    """Verdict of every file of (file_id, repo, path, content); other columns are ignored.

    Files of other languages and files without content (null) have no verdict and
    no row; an empty file is valid.  Rows that repeat a file_id each get a row.
    ``failing_token`` is the index of the token with an empty derivative, or the
    number of tokens where the text breaks off (failure ``truncated``).
    """
    rows = files.select(F.col("file_id").cast("long").alias("file_id"), trimmed(F.col("repo")).alias("repo"), language_of(F.col("path")).alias("language"), "content")
    return rows.where("language is not null and content is not null").mapInPandas(_check, _SCHEMA)


def error_rates(checked: DataFrame) -> DataFrame:
    """Files and invalid files per repository and language."""
    counts = checked.groupBy("repo", "language").agg(F.count(F.lit(1)).alias("n_files"), F.count_if("has_syntax_errors").alias("n_invalid"))
    return counts.withColumn("rate", F.round(F.col("n_invalid") / F.col("n_files"), 6))
