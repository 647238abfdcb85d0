"""Reports as CSV and HTML."""

from __future__ import annotations

import html
from collections.abc import Iterable
from typing import IO

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stratafold.functions.text import csv_safe
from stratafold.operators.reports import COLUMNS
from stratafold.sources.stores import atomic_file


def write_csv(rows: DataFrame, folder: str, columns: Iterable[str] = COLUMNS) -> None:
    """Report rows with a header in every part file; text that a spreadsheet would take for a formula is quoted. Parts are
    written by the tasks that hold them, so a report of any length needs no single writer."""
    kinds = dict(rows.dtypes)
    safe = [csv_safe(F.col(f"`{c}`")).alias(c) if kinds[c] == "string" else F.col(f"`{c}`") for c in columns]
    rows.select(*safe).write.mode("errorifexists").option("header", True).option("escape", '"').csv(folder)


def write_merge_plan(plan: DataFrame, folder: str) -> None:
    """(size, source, target, kind): what a merge would transfer."""
    kind = F.when(F.col("bucket") == "symlink", "symlink").otherwise("")
    write_csv(plan.select("size", "source", "target", kind.alias("kind")), folder, ["size", "source", "target", "kind"])


def write_html(summary: DataFrame, rows: DataFrame, path: str, title: str = "Report") -> None:
    """One page without scripts: the summary, a row per record type, and a table of all rows. Rows come to the driver a partition at a
    time and go on to the file one by one, so the page is never held in memory."""

    def table(f: IO[str], df: DataFrame) -> None:
        cell = lambda v: f"<td>{html.escape('' if v is None else str(v))}</td>"
        f.write(f"<table><tr>{''.join(f'<th>{html.escape(c)}</th>' for c in df.columns)}</tr>\n")
        for row in df.toLocalIterator():
            f.write(f"<tr>{''.join(cell(v) for v in row)}</tr>\n")
        f.write("</table>\n")

    with atomic_file(path) as f:
        f.write(f'<!doctype html><meta charset="utf-8"><title>{html.escape(title)}</title><h1>{html.escape(title)}</h1>\n')
        table(f, summary)
        table(f, rows)
