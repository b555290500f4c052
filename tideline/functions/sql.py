"""The library's functions in SQL: `register(spark)` names them in a session.

Scalar functions are bodies in SQL, so they become part of the plan like built-in ones. Functions of tables are Python and
are given whole rows of texts at a time.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import SparkSession
from pyspark.sql.functions import udtf

from .splitting import split_text

#: name(arguments) RETURNS type RETURN body
SCALARS = {
    "clamp01": ("x DOUBLE", "DOUBLE", "greatest(0D, least(1D, x))"),
    "mastery_step": ("mastery DOUBLE, weight DOUBLE", "DOUBLE", "greatest(0D, least(1D, mastery + weight))"),
    "risk_level": ("score DOUBLE", "STRING", "CASE WHEN score >= 0.65 THEN 'high' WHEN score >= 0.4 THEN 'medium' ELSE 'low' END"),
    "health_status": ("score DOUBLE", "STRING", "CASE WHEN score >= 70 THEN 'Good' WHEN score >= 45 THEN 'Fair' ELSE 'At Risk' END"),
    "slug": ("words STRING", "STRING", "coalesce(nullif(substring(regexp_replace(regexp_replace(lower(coalesce(words, '')), '[^a-z0-9]+', '_'), '^_+|_+$', ''), 1, 200), ''), 'general')"),
    "token_length": ("words STRING", "INT", "greatest(1, CAST(floor(length(coalesce(words, '')) / 4) AS INT))"),
    "row_digest": ("a STRING, b STRING", "STRING", "sha2(concat_ws(':', coalesce(a, ''), coalesce(b, '')), 256)"),
}


@udtf(returnType="ordinal int, chunk string")
class SplitText:
    """The pieces of a text of so many tokens at most, each repeating the end of the one before; a token is four characters."""

    def eval(self, text: str, tokens: int, overlap: int) -> Iterator[tuple[int, str]]:
        yield from enumerate(split_text(text or "", 4 * tokens, 4 * overlap))


@udtf(returnType="line int, place int, value string")
class MarkdownCells:
    """The cells of the pipe rows of a text, header first; the rule line under it is no row."""

    def eval(self, text: str) -> Iterator[tuple[int, int, str]]:
        rows = [x.strip() for x in (text or "").split("\n")]
        rows = [x for x in rows if len(x) > 1 and x[0] == x[-1] == "|" and set(x) - set("|:- \t")]
        for i, row in enumerate(rows):
            for j, cell in enumerate(row[1:-1].split("|")):
                yield i, j, cell.strip()


TABLES = {"split_text": SplitText, "markdown_cells": MarkdownCells}


def register(spark: SparkSession) -> list[str]:
    """Names the library's functions in the session and returns the names; registering again replaces them."""
    for name, (arguments, kind, body) in SCALARS.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}({arguments}) RETURNS {kind} RETURN {body}")
    for name, function in TABLES.items():
        spark.udtf.register(name, function)
    return [*SCALARS, *TABLES]
