"""CSV in: dialect survey, header survey, all-text scan, intake limits."""

from __future__ import annotations

from functools import reduce

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from grainwise.functions import cells
from grainwise.operators.metrics import check_rows

# Fixed values.
DELIMITERS = [",", "\t", ";"]
HEADER_ROWS = 20
HEADER_WORD = (
    "(?i)id|编号|编码|名称|日期|时间|状态|金额|价格|数量|类型|类别|地区|字段|含义|说明|描述|备注|单位|表名|用途|角色"
    "|rate|date|time|amount|price|status|name|type|count|description|note|unit|value"
)
BLANK_NAME = "未命名列 "
EXTENSIONS = ["csv"]


def lines(spark: SparkSession, path: str) -> DataFrame:
    """(file, place, line) of text files; place orders the lines of a file."""
    raw = spark.read.text(path)
    return raw.select(
        F.col("_metadata.file_path").alias("file"),
        F.struct(F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("n")).alias("place"),
        F.regexp_replace("value", "^﻿", "").alias("line"),
    )


def first_lines(text: Column) -> Column:
    """The beginning of a text, up to the end of the last line in which a header is looked for; the whole text if it has fewer.

    No quantifier gives back what it took, so a text is read up to there at most, and once.
    """
    return F.regexp_extract(text, rf"\A(?:[{cells.BLANKS}]*+[^\n]++\n?+){{0,{HEADER_ROWS}}}+", 0)


def _outside_quotes(line: Column, delimiter: str) -> Column:
    bare = F.regexp_replace(line, r'"[^"]*("|$)', "")
    return F.length(bare) - F.length(F.translate(bare, delimiter, ""))


def delimiter_survey(text_lines: DataFrame) -> DataFrame:
    """Per file, the delimiter its first non-blank line uses most.

    Only the first line of each file survives the map side, so surveying a
    folder costs one scan and one row per file.
    """
    blank = cells.trimmed(F.col("line")) == ""
    first = text_lines.filter(~blank).groupBy("file").agg(F.min_by("line", "place").alias("line"))
    counts = [_outside_quotes(F.col("line"), d) for d in DELIMITERS]
    most = F.greatest(*counts)
    choice = F.coalesce(*[F.when(n == most, F.lit(d)) for n, d in zip(counts, DELIMITERS)])
    return first.select(
        "file", choice.alias("delimiter"), most.cast("bigint").alias("count"),
        *[n.cast("bigint").alias(f"count_{i}") for i, n in enumerate(counts)],
    )


def header_survey(rows: DataFrame) -> DataFrame:
    """Per file, which of its first rows is the header, and its clean names.

    ``rows``: file, place, cells (array of texts). ``row_number() <= 20`` is a
    group limit, so at most twenty rows per file and task are shuffled. A header
    is recognised by distinct, non-repeated texts and by the words it uses;
    later rows are slightly penalised and the first best row wins.
    """
    present_somewhere = cells.trimmed(F.array_join("cells", "")) != ""
    place = Window.partitionBy("file").orderBy("place")
    head = (
        rows.filter(present_somewhere)
        .withColumn("nth", F.row_number().over(place))
        .filter(F.col("nth") <= HEADER_ROWS)
        .withColumn("row", F.col("nth") - 1)
    )
    texts = F.filter(F.transform("cells", lambda c: cells.present_text(c)), lambda c: c.isNotNull())
    scored = head.withColumn("texts", texts).filter(F.size("texts") > 0).withColumns({
        "present": F.size("texts"),
        "unique": F.size(F.array_distinct("texts")),
        "words": F.size(F.filter("texts", lambda t: t.rlike(HEADER_WORD))),
    })
    score = (
        F.col("unique") * 2 + F.col("words") * 3 + F.col("present") * 0.25
        - (F.col("present") - F.col("unique")) * 2 - F.col("row") * 0.15
    )
    best = F.max_by(F.struct("row", "cells", score.alias("score")), F.struct(score, -F.col("row"))).alias("b")
    return scored.groupBy("file").agg(best).select(
        "file", (F.col("b.row") + 1).cast("bigint").alias("header_row"),
        F.round("b.score", 4).alias("score"), header_names(F.col("b.cells")).alias("names"),
    )


def header_names(raw: Column) -> Column:
    """Trimmed names; a blank one is positional, a repeated one gets its number."""
    base = F.transform(raw, lambda c, i: F.when(
        F.coalesce(cells.trimmed(c), F.lit("")) == "", F.concat(F.lit(BLANK_NAME), (i + 1).cast("string"))
    ).otherwise(cells.trimmed(c)))
    nth = F.transform(base, lambda c, i: F.struct(c.alias("name"), F.size(
        F.filter(F.slice(base, F.lit(1), i + 1), lambda x: x == c)).alias("n")))
    return F.transform(nth, lambda s: F.when(s["n"] == 1, s["name"]).otherwise(
        F.concat(s["name"], F.lit("（"), s["n"].cast("string"), F.lit("）"))))


def clean_names(names: list[str]) -> list[str]:
    """The same naming rule for a header already on the driver."""
    seen: dict[str, int] = {}
    out = []
    for i, name in enumerate(names):
        base = (name or "").strip(cells.BLANKS) or f"{BLANK_NAME}{i + 1}"
        seen[base] = seen.get(base, 0) + 1
        out.append(base if seen[base] == 1 else f"{base}（{seen[base]}）")
    return out


def read_csv(spark: SparkSession, path: str, delimiter: str = ",", header: bool = True) -> DataFrame:
    """All cells as text: quoted fields, doubled quotes, embedded line breaks.

    Types are a finding of the profile, never an implicit cast. Rows without any
    value are dropped. ``multiLine`` makes a file the unit of parallelism, so
    large inputs should come as many files.
    """
    reader = (
        spark.read.option("sep", delimiter).option("quote", '"').option("escape", '"').option("multiLine", True)
        .option("inferSchema", False).option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False)
    )
    raw = reader.option("header", header).csv(path)
    if header:
        # the reader renames blank and repeated names itself, so they are read as a row
        first = reader.option("header", False).csv(path).first()
        raw = raw.toDF(*clean_names([(n or "").lstrip("\ufeff") for n in first]))
    return drop_empty_rows(raw)


def drop_empty_rows(df: DataFrame) -> DataFrame:
    """Rows with at least one present cell."""
    return df.filter(reduce(lambda a, b: a | b, [~cells.missing(df, n) for n in df.columns]))


class EmptyTable(ValueError):
    """There is a header but no data."""


def require_data(df: DataFrame) -> DataFrame:
    if df.isEmpty():
        raise EmptyTable("the table has no data rows")
    return df


def intake_checks(df: DataFrame, max_rows: int | None = None, max_columns: int | None = None) -> DataFrame:
    """(check, passed) of a table against optional ceilings and binary content."""
    zero_bytes = reduce(
        lambda a, b: a | b, [F.coalesce(F.contains(cells.col(n), F.lit("\u0000")), F.lit(False))
                             for n in df.columns if cells.is_text(df, n)], F.lit(False))
    facts = df.agg(F.count(F.lit(1)).alias("rows"), F.count_if(zero_bytes).alias("binary"))
    return check_rows(facts, [
        ("has_rows", F.col("rows") > 0),
        ("rows_within_limit", F.lit(True) if max_rows is None else F.col("rows") <= max_rows),
        ("columns_within_limit", F.lit(max_columns is None or len(df.columns) <= max_columns)),
        ("no_binary_content", F.col("binary") == 0),
    ])


def file_checks(spark: SparkSession, path: str, max_bytes: int | None = None) -> DataFrame:
    """(file, bytes, extension_ok, size_ok) from file metadata; content is not read."""
    extension = F.lower(F.regexp_extract("path", r"\.([^./]+)$", 1))
    size_ok = F.lit(True) if max_bytes is None else F.col("length") <= max_bytes
    return spark.read.format("binaryFile").load(path).select(
        F.col("path").alias("file"), F.col("length").alias("bytes"),
        extension.isin(EXTENSIONS).alias("extension_ok"), size_ok.alias("size_ok"),
    )


def scan_tables(spark: SparkSession, folder: str, tables: dict[str, T.StructType]) -> dict[str, DataFrame]:
    """Typed scans of <folder>/<name>.csv, every missing file named at once.

    The schema lists the columns wanted; the reader matches them by header name
    and parses nothing else.
    """
    found, absent = {}, []
    for name, schema in tables.items():
        try:
            header = spark.read.option("header", True).csv(f"{folder}/{name}.csv").columns
        except AnalysisException:
            absent.append(name)
            continue
        full = T.StructType([
            next((f for f in schema.fields if f.name == h), T.StructField(h, T.StringType())) for h in header
        ])
        found[name] = (
            spark.read.option("header", True).option("quote", '"').option("escape", '"').schema(full)
            .csv(f"{folder}/{name}.csv").select(*[f.name for f in schema.fields])
        )
    if absent:
        raise FileNotFoundError(f"missing source files: {', '.join(sorted(absent))}")
    return found


def manifest(tables: dict[str, DataFrame]) -> DataFrame:
    """(source, rows) per table, plus their total."""
    counts = reduce(DataFrame.unionByName, [
        df.agg(F.count(F.lit(1)).alias("rows")).select(F.lit(name).alias("source"), "rows")
        for name, df in sorted(tables.items())
    ])
    return counts.rollup("source").agg(F.sum("rows").alias("rows")).na.fill({"source": "(total)"})
