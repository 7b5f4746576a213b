"""Results out: CSV that spreadsheets cannot execute, pages, nested snapshots."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from grainwise.functions import cells

FORMULA = "^[" + cells.BLANKS + "]*[=+@-]"
PAGE_ROWS = 25
# About so many bytes of text go into a CSV file: one with line breaks in its cells is read by a single task.
FILE_BYTES = 64 << 20


def formula_guard(df: DataFrame) -> DataFrame:
    """Text cells and column names a spreadsheet would run get a leading quote.

    Numbers are typed columns and stay as they are.
    """
    out = []
    for name in df.columns:
        c = cells.col(name)
        if cells.is_text(df, name):
            c = F.when(c.rlike(FORMULA), F.concat(F.lit("'"), c)).otherwise(c)
        out.append(c.alias(f"'{name}" if re.match(FORMULA, name) else name))
    return df.select(*out)


def write_csv(df: DataFrame, path: str, guard: bool = True, bom: bool = False, delimiter: str = ",") -> None:
    """CSV files, each starting with the header: quotes only where needed, NULL as an empty cell, numbers in plain digits.

    An empty result is one file with the header. ``bom`` starts every file with a byte order mark, for spreadsheets that
    take UTF-8 for another encoding without it. Lines end with a line feed: the writer would put a longer line end
    in place of the line breaks inside cells, too. A file holds about FILE_BYTES by the mean length of a row, however
    much a task writes.
    """
    safe = formula_guard(df) if guard else df
    texts = safe.select(*[cells.raw_text(safe, n).alias(f"\ufeff{n}" if bom and i == 0 else n) for i, n in enumerate(safe.columns)])
    length = sum((F.coalesce(F.octet_length(cells.col(n)), F.lit(0)) + 1 for n in texts.columns), F.lit(0))
    mean = texts.agg(F.avg(length)).first()[0] if texts.columns else None
    rows = max(1, int(FILE_BYTES / mean)) if mean else 0
    (texts.write.mode("errorifexists").option("maxRecordsPerFile", rows).option("header", True).option("sep", delimiter).option("quote", '"').option("escape", '"')
     .option("nullValue", "").option("emptyValue", "").option("lineSep", "\n")
     .option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False).csv(path))


def _numbered(rows: DataFrame, order: list[Column], start: int) -> DataFrame:
    return rows.withColumn("row_number", F.row_number().over(Window.orderBy(*order)) + F.lit(start))


def page(df: DataFrame, order: list[Column], number: int, size: int = PAGE_ROWS) -> DataFrame:
    """One page by number, rows numbered as in the whole result.

    Meant for the first pages: Spark must find the first (number + 1) * size
    rows. For deep paging use ``page_after``, whose cost does not grow.
    """
    start = number * size
    return _numbered(df.orderBy(*order).offset(start).limit(size), order, start)


def page_after(df: DataFrame, key: str, last: object | None, start: int, size: int = PAGE_ROWS) -> DataFrame:
    """The page after the row whose unique ``key`` was ``last``.

    The key filter is pushed to the scan and the rest is a top-``size``.
    """
    rest = df if last is None else df.filter(cells.col(key) > F.lit(last))
    return _numbered(rest.orderBy(cells.col(key)).limit(size), [cells.col(key)], start)


def write_snapshot(sections: DataFrame, path: str) -> None:
    """A nested snapshot frame as JSON lines."""
    sections.write.mode("errorifexists").json(path)
