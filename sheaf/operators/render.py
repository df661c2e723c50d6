"""Rendered answers: frontmatter and fenced content."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def frontmatter(entries: Column, not_found: Column) -> Column:
    """Lines between --- marks from array<struct<key, values>>: null and empty values are skipped, one
    value is a scalar, more are a list; names that were asked for and not found come last, quoted."""
    kept = F.filter(entries, lambda e: F.size(F.coalesce(e["values"], F.array().cast("array<string>"))) > 0)
    lines = F.transform(
        kept,
        lambda e: F.when(F.size(e["values"]) == 1, F.concat(e["key"], F.lit(": "), e["values"][0])).otherwise(F.concat(e["key"], F.lit(":\n"), F.array_join(F.transform(e["values"], lambda v: F.concat(F.lit("  - "), v)), "\n"))),
    )
    lost = F.when(F.size(not_found) > 0, F.concat(F.lit("sections_not_found:\n"), F.array_join(F.transform(not_found, lambda v: F.concat(F.lit('  - "'), v, F.lit('"'))), "\n")))
    return F.concat_ws("\n", F.lit("---"), F.nullif(F.array_join(lines, "\n"), F.lit("")), lost, F.lit("---"))
