"""CSV files of unknown dialect as one table: survey every file, read each kind with one reader, match columns by name."""

from __future__ import annotations

from dataclasses import dataclass
from urllib.parse import unquote

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from grainwise.functions import cells
from grainwise.session import scratch_path
from grainwise.sources import csv


@dataclass(frozen=True)
class Intake:
    """``rows``: all cells as text under the names of their files' headers. ``survey``: one row per file with how it was read."""

    rows: DataFrame
    survey: DataFrame


def dialects(spark: SparkSession, path: str) -> DataFrame:
    """(file, delimiter, multiline, width): how each file must be read.

    One scan of the lines gives, per file, the delimiter of its first non-blank line, whether a cell holds a line break (a line with an
    odd number of quotes) and the most cells of a line. Only in files with such cells lines are put together to records first;
    those are the files that one task has to read from end to end anyway.
    """
    lines = csv.lines(spark, path)
    line = F.col("line")
    odd = (F.length(line) - F.length(F.replace(line, F.lit('"'), F.lit("")))) % 2 == 1
    counts = [csv._outside_quotes(line, d).alias(f"n{i}") for i, d in enumerate(csv.DELIMITERS)]
    widest = lines.groupBy("file").agg(F.max(odd).alias("multiline"), *[F.max(c).alias(f"w{i}") for i, c in enumerate(counts)])
    chosen = csv.delimiter_survey(lines).select(F.col("file").alias("f"), "delimiter")
    simple = widest.join(chosen, F.col("file") == F.col("f")).drop("f")
    return simple.filter("NOT multiline").select("file", "delimiter", "multiline", (_of("w") + 1).alias("width")).union(
        _records(lines, simple.filter("multiline").select(F.col("file").alias("f"), "delimiter")))


def _of(prefix: str) -> Column:
    """The column of a file's own delimiter."""
    return F.coalesce(*[F.when(F.col("delimiter") == d, F.col(f"{prefix}{i}")) for i, d in enumerate(csv.DELIMITERS)])


def _records(lines: DataFrame, files: DataFrame) -> DataFrame:
    """Widths of the files whose cells hold line breaks: a record ends where the quotes up to there are even in number."""
    mine = lines.join(files, F.col("file") == F.col("f")).drop("f")
    upto = Window.partitionBy("file").orderBy("place").rowsBetween(Window.unboundedPreceding, -1)
    quotes = F.length("line") - F.length(F.replace("line", F.lit('"'), F.lit("")))
    inside = mine.withColumn("quotes", quotes).withColumn("open", F.coalesce(F.sum("quotes").over(upto), F.lit(0)) % 2 == 1)
    closed = (F.col("quotes") % 2 == 1) == F.col("open")
    numbered = inside.withColumn("record", F.coalesce(F.sum(closed.cast("int")).over(upto), F.lit(0)))
    whole = F.when(F.col("open"), F.concat(F.lit('"'), F.col("line"))).otherwise(F.col("line"))
    counts = [csv._outside_quotes(whole, d).alias(f"n{i}") for i, d in enumerate(csv.DELIMITERS)]
    per_line = numbered.select("file", "delimiter", "record", *counts)
    per_record = per_line.groupBy("file", "delimiter", "record").agg(F.sum(_of("n")).alias("n"))
    return per_record.groupBy("file", "delimiter").agg((F.max("n") + 1).alias("width")).select("file", "delimiter", F.lit(True).alias("multiline"), "width")


def read(spark: SparkSession, path: str) -> Intake:
    """All CSV files below a path as one table of texts.

    First the dialects of the files, then one reader per (delimiter, with or without line breaks in cells); files without such
    cells are split like any text. The cells are stored once as Parquet with the number of their record, so no later pass parses
    CSV again. Per file, the rows up to its header, found among its first twenty, are left out. A column is known by its name,
    wherever it stands; a file without it has NULL there. Cells beyond the header are kept under positional names. Rows without
    any value are dropped. Columns come in the order of the first file that has them. Texts keep their blanks.
    """
    found = dialects(spark, path).collect()
    if not found:
        raise csv.EmptyTable(f"no lines below {path}")
    width = max(r["width"] for r in found)
    names = [f"c{i}" for i in range(width)]
    folder = scratch_path(spark, "intake")
    for delimiter, multiline in sorted({(r["delimiter"], r["multiline"]) for r in found}):
        # Metadata names files as URIs, readers take them as paths.
        files = [unquote(r["file"]) for r in found if (r["delimiter"], r["multiline"]) == (delimiter, multiline)]
        reader = (spark.read.schema(", ".join(f"{n} string" for n in names)).option("sep", delimiter).option("quote", '"').option("escape", '"')
                  .option("multiLine", multiline).option("header", False).option("maxColumns", max(20_480, width))
                  .option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False))
        place = F.struct(F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("n"))
        reader.csv(files).select(F.col("_metadata.file_path").alias("file"), place.alias("place"), F.array(*names).alias("cells")).write.mode("append").parquet(folder)
    widths = spark.createDataFrame([(r["file"], r["delimiter"], r["multiline"], r["width"]) for r in found], "f string, delimiter string, multiline boolean, width int")
    rows = (spark.read.parquet(folder).join(widths.select("f", "width"), F.col("file") == F.col("f"))
            .select("file", "place", F.slice("cells", F.lit(1), F.col("width")).alias("cells")))
    headers = csv.header_survey(rows)
    survey = widths.join(headers, F.col("f") == F.col("file")).select("file", "delimiter", "multiline", "width", "header_row", "names")
    known = survey.orderBy("file").select("file", "header_row", "names").collect()
    order = list(dict.fromkeys(n for r in known for n in r["names"]))
    # Where each name stands in each file; the rows that end with the header, by their place.
    stands = F.map_from_arrays("names", F.sequence(F.lit(1), F.size("names")))
    first = _firsts(rows).join(survey.select(F.col("file").alias("f"), "header_row"), F.col("file") == F.col("f")).filter(F.col("nth") == F.col("header_row"))
    heads = first.select(F.col("file").alias("h"), F.col("place").alias("header"))
    at = survey.select(F.col("file").alias("f"), stands.alias("at"))
    data = rows.join(at, F.col("file") == F.col("f")).join(heads, F.col("file") == F.col("h")).filter(F.col("place") > F.col("header"))
    return Intake(csv.drop_empty_rows(data.select(*[F.get("cells", F.col("at")[n] - 1).alias(n) for n in order])), survey)


def _firsts(rows: DataFrame) -> DataFrame:
    """The first rows with any text of every file, numbered as the header survey numbers them."""
    some = cells.trimmed(F.array_join("cells", "")) != ""
    nth = F.row_number().over(Window.partitionBy("file").orderBy("place"))
    return rows.filter(some).withColumn("nth", nth).filter(F.col("nth") <= csv.HEADER_ROWS)
