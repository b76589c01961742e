"""Markdown and JSON reports of small aggregates (one row a show; what is rendered is bounded by the number of shows)."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame


def markdown_table(df: DataFrame, most: int = 1000) -> str:
    """A frame's first ``most`` rows as a Markdown table."""
    rows = df.limit(most).collect()
    cell = lambda v: "" if v is None else str(v).replace("|", "\\|")
    return "\n".join(["| " + " | ".join(df.columns) + " |", "|" + "---|" * len(df.columns), *("| " + " | ".join(cell(v) for v in r) + " |" for r in rows)])


def comprehensive(title: str, sections: dict[str, DataFrame]) -> str:
    """A report of titled sections, each the table of an aggregate."""
    return "\n\n".join([f"# {title}", *(f"## {name}\n\n{markdown_table(df)}" for name, df in sections.items())]) + "\n"


def as_json(sections: dict[str, DataFrame], most: int = 1000) -> str:
    return json.dumps({name: [r.asDict(True) for r in df.limit(most).collect()] for name, df in sections.items()}, default=str, ensure_ascii=False, indent=1)
