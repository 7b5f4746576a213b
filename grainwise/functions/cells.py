"""Cell semantics: what counts as missing, as a number, as a date, as one value.

Every helper takes the frame and a column name, because the right expression
depends on the column's Spark type. Text columns get the full rules. Typed
columns (numbers, timestamps, booleans) skip the text work, so predicates on
them still reach the Parquet scan and distinct counts shuffle native values.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Fixed values ---------------------------------------------------------------
# Characters removed from both ends of a cell (all Unicode white space, not
# only the ASCII space that plain trim removes).
BLANKS = (
    "\t\n\u000b\f\r \u00a0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008"
    "\u2009\u200a\u2028\u2029\u202f\u205f\u3000\ufeff"
)
# Trimmed, lower-cased texts that mean "no value".
MISSING_WORDS = ["", "null", "undefined", "__null__"]
LONGEST_MISSING_WORD = max(len(w) for w in MISSING_WORDS)
# Trimmed, lower-cased texts that are booleans.
BOOLEAN_WORDS = ["true", "false", "是", "否"]
# A measure: no exponent, no plus sign, no thousands separator.
NUMBER_PATTERN = r"^-?(?:\d+\.?\d*|\.\d+)$"
# A filter operand may also carry a sign and an exponent.
OPERAND_PATTERN = r"^[+-]?(?:\d+\.?\d*|\.\d+)(?:[eE][+-]?\d+)?$"
# The calendar part of a date cell; years below 100 are not accepted.
DAY_PATTERN = r"^(?!00)\d{4}[-/]\d{1,2}[-/]\d{1,2}(?=$|[ T])"
# ----------------------------------------------------------------------------

CLASSES = ("date", "number", "boolean", "text")
GRAINS = ("day", "week", "month", "quarter")
NORMAL = "normalised_cell"


def data_type(df: DataFrame, name: str) -> T.DataType:
    return df.schema[name].dataType


def is_text(df: DataFrame, name: str) -> bool:
    return isinstance(data_type(df, name), (T.StringType, T.VarcharType, T.CharType))


def family(df: DataFrame, name: str) -> str:
    """text, number, date, boolean, or other (nested types)."""
    kind = data_type(df, name)
    if is_text(df, name):
        return "text"
    if isinstance(kind, T.NumericType):
        return "number"
    if isinstance(kind, (T.DateType, T.TimestampType, T.TimestampNTZType)):
        return "date"
    if isinstance(kind, T.BooleanType):
        return "boolean"
    return "other"


def col(name: str) -> Column:
    """Column by exact name, dots and all."""
    return F.col("`" + name.replace("`", "``") + "`")


def trimmed(c: Column) -> Column:
    return F.btrim(c, F.lit(BLANKS))


def present_text(c: Column) -> Column:
    """Trimmed text, or NULL where the cell means "no value".

    No missing word is longer than nine bytes, so long texts are not lower-cased.
    """
    t = trimmed(c)
    return F.when((F.octet_length(t) > LONGEST_MISSING_WORD) | ~F.lower(t).isin(MISSING_WORDS), t)


def _shifted(shown: Column) -> Column:
    """A number that prints with an exponent, without it: its digits moved to their places, none of them rounded."""
    digits = F.regexp_replace(F.substring_index(shown, "E", 1), "[-.]|0+$", "")
    power = F.substring_index(shown, "E", -1).try_cast("int")
    small = F.concat(F.lit("0."), F.repeat(F.lit("0"), -power - 1), digits)
    whole = F.rpad(F.substring(digits, F.lit(1), power + 1), power + 1, F.lit("0"))
    rest = F.substring(digits, power + 2, F.length(digits))
    large = F.concat(whole, F.when(rest != "", F.concat(F.lit("."), rest)).otherwise(F.lit("")))
    return F.concat(F.when(F.startswith(shown, F.lit("-")), F.lit("-")).otherwise(F.lit("")), F.when(power < 0, small).otherwise(large))


def raw_text(df: DataFrame, name: str) -> Column:
    """Untrimmed text form of a cell; whole floating numbers print without '.0', none with an exponent."""
    c = col(name)
    kind = data_type(df, name)
    if is_text(df, name):
        return c
    if isinstance(kind, (T.DoubleType, T.FloatType)):
        whole = (c == F.floor(c)) & (F.abs(c) < F.lit(1e15))
        shown = c.cast("string")
        exponent = F.contains(shown, F.lit("E"))
        return F.when(whole, c.cast("bigint").cast("string")).when(exponent, _shifted(shown)).otherwise(shown)
    if isinstance(kind, (T.TimestampType, T.TimestampNTZType)):
        return F.date_format(c, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'")
    if family(df, name) == "other":
        return F.to_json(c)
    return c.cast("string")


def is_normal(df: DataFrame, name: str) -> bool:
    """Was this text column already normalised (see ``normalised``)?"""
    return bool(df.schema[name].metadata.get(NORMAL))


def normalised(df: DataFrame, names: list[str]) -> DataFrame:
    """The named columns with text cells trimmed and missing ones NULL.

    Operators begin with this projection. A cell is trimmed once per row however
    many rules look at it, and a table that was normalised and stored is not
    trimmed again: the column carries a mark in its metadata. Typed columns pass
    through untouched.
    """
    require(df, list(names))
    out = []
    for name in dict.fromkeys(names):
        c = col(name)
        if is_text(df, name) and not is_normal(df, name):
            c = present_text(c).alias(name, metadata={NORMAL: True})
        out.append(c)
    return df.select(*out)


def text(df: DataFrame, name: str) -> Column:
    """Trimmed text, NULL when missing: the normalised cell of every operator."""
    raw = raw_text(df, name)
    return present_text(raw) if is_text(df, name) and not is_normal(df, name) else raw


def _trimmed(df: DataFrame, name: str) -> Column:
    return col(name) if is_normal(df, name) else trimmed(col(name))


def missing(df: DataFrame, name: str) -> Column:
    c = col(name)
    return text(df, name).isNull() if is_text(df, name) else c.isNull()


def identity(df: DataFrame, name: str) -> Column:
    """Value to count distinct entities by: case-sensitive, NULL when missing."""
    return text(df, name) if is_text(df, name) else col(name)


def key_part(df: DataFrame, name: str) -> Column:
    """Value to match join keys by: case-insensitive text, native otherwise."""
    return F.lower(text(df, name)) if is_text(df, name) else col(name)


def number(df: DataFrame, name: str) -> Column:
    """Finite number of a measure cell, else NULL."""
    kind = family(df, name)
    c = col(name)
    if kind == "number":
        value = c.cast("double")
        if isinstance(data_type(df, name), (T.DoubleType, T.FloatType)):
            return F.when(~F.isnan(value) & (F.abs(value) != F.lit(float("inf"))), value)
        return value
    if kind == "text":
        t = _trimmed(df, name)
        value = F.when(t.rlike(NUMBER_PATTERN), t.try_cast("double"))
        return F.when(F.abs(value) != F.lit(float("inf")), value)
    return F.lit(None).cast("double")


def day(df: DataFrame, name: str) -> Column:
    """Calendar day of a date cell, else NULL (impossible days are NULL)."""
    kind = family(df, name)
    c = col(name)
    if kind == "date":
        return c.cast("date")
    if kind != "text":
        return F.lit(None).cast("date")
    return day_of_text(_trimmed(df, name))


def day_of_text(t: Column) -> Column:
    head = F.translate(F.regexp_extract(t, DAY_PATTERN, 0), "/", "-").try_cast("date")
    clockless = ~(F.contains(t, F.lit(" ")) | F.contains(t, F.lit("T")))
    clock_ok = clockless | F.translate(t, "/", "-").try_cast("timestamp").isNotNull()
    # only a separator in fifth place is worth the pattern
    return F.when(F.substring(t, 5, 1).isin("-", "/"), F.when(clock_ok, head))


def cell_class(df: DataFrame, name: str) -> Column:
    """date, number, boolean or text for a present cell; NULL when missing."""
    kind = family(df, name)
    c = col(name)
    if kind != "text":
        label = "text" if kind == "other" else kind
        return F.when(c.isNotNull(), F.lit(label))
    return class_of_text(text(df, name))


def class_of_text(t: Column) -> Column:
    """Class of a normalised text; NULL stays NULL."""
    return (
        F.when(t.isNull(), F.lit(None).cast("string"))
        .when(t.rlike(NUMBER_PATTERN), F.lit("number"))
        .when(day_of_text(t).isNotNull(), F.lit("date"))
        .when(F.lower(t).isin(BOOLEAN_WORDS), F.lit("boolean"))
        .otherwise(F.lit("text"))
    )


def period(d: Column, grain: str) -> Column:
    """First day of the period a day falls in; weeks start on Monday (ISO)."""
    if grain not in GRAINS:
        raise ValueError(f"time grain must be one of {GRAINS}, not {grain!r}")
    return d if grain == "day" else F.trunc(d, grain)


def period_label(start: Column, grain: str) -> Column:
    """Sortable label of a period, from any of its days.

    Formatting is slow, so operators group by ``period`` and label the groups.
    """
    if grain == "day":
        return F.date_format(start, "yyyy-MM-dd")
    if grain == "week":
        label = F.format_string("%d-W%02d", F.extract(F.lit("YEAROFWEEK"), start), F.weekofyear(start))
        return F.when(start.isNotNull(), label)
    if grain == "month":
        return F.date_format(start, "yyyy-MM")
    return F.concat(F.date_format(start, "yyyy"), F.lit("-Q"), F.quarter(start).cast("string"))


def row_digest(df: DataFrame, names: list[str] | None = None) -> Column:
    """256-bit digest of a row's trimmed cells.

    Two rows share it exactly when all trimmed cells agree; NULL differs from an
    empty text. Each cell is length-prefixed, so no cell content can imitate a
    separator. Grouping on 32 bytes keeps long texts out of the shuffle.
    """
    pieces = []
    for name in names or df.columns:
        raw = raw_text(df, name)
        cell = trimmed(raw) if is_text(df, name) else raw
        pieces.append(F.coalesce(F.concat(F.length(cell).cast("string"), F.lit(":"), cell), F.lit("~")))
    return F.unhex(F.sha2(F.concat(*pieces), 256))


def safe_divide(a: Column, b: Column) -> Column:
    """a / b as double, NULL when b is zero."""
    return a.cast("double") / F.nullif(b.cast("double"), F.lit(0.0))


def require(df: DataFrame, names: list[str | None]) -> None:
    absent = sorted({n for n in names if n and n not in df.columns})
    if absent:
        raise ValueError(f"no such field: {', '.join(absent)}")
