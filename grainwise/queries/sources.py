"""Surveys, intake, manifests, sinks and pages.

Documents stand in for files: a document is one file, its lines are the file's
lines. The readers themselves are tested on real files in tests/.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from grainwise.functions import cells
from grainwise.operators.profile import column_stats
from grainwise.queries.base import TABLE_NAMES, Tables, query, rounded, trim, txt
from grainwise.session import scratch_path
from grainwise.sources import csv, intake, sinks


def _lines(t: Tables) -> DataFrame:
    """The lines that surveys look at, in their places: none beyond the twentieth with any text."""
    return t.documents.select(F.col("doc_id").alias("file"), F.posexplode(F.split(csv.first_lines(F.col("text")), "\n")).alias("place", "line"))


LINES = """parts AS (SELECT doc_id AS file, string_split(text, chr(10)) AS parts FROM documents),
    lines AS (SELECT file, unnest(parts) AS line, unnest(range(len(parts))) AS place FROM parts)"""


def _outside(delimiter: str) -> str:
    bare = "regexp_replace(line, '\"[^\"]*(\"|$)', '', 'g')"
    return f"(length({bare}) - length(replace({bare}, {delimiter}, '')))"


@query("delimiter_survey", "S2", f"""WITH {LINES},
    first AS (SELECT file, min_by(line, place) AS line FROM lines WHERE {trim('line')} <> '' GROUP BY file),
    n AS (SELECT file, {_outside("','")} AS a, {_outside("chr(9)")} AS b, {_outside("';'")} AS c FROM first)
    SELECT file, CASE WHEN a >= b AND a >= c THEN ',' WHEN b >= c THEN chr(9) ELSE ';' END AS delimiter,
      greatest(a, b, c) AS count, a AS count_0, b AS count_1, c AS count_2 FROM n""")
def delimiter_survey(t: Tables) -> DataFrame:
    return csv.delimiter_survey(_lines(t))


@query("header_survey", "S3", f"""WITH {LINES},
    cut AS (SELECT file, place, string_split(line, ' ') AS cells FROM lines WHERE {trim('line')} <> ''),
    head AS (SELECT *, row_number() OVER (PARTITION BY file ORDER BY place) - 1 AS row FROM cut
      QUALIFY row_number() OVER (PARTITION BY file ORDER BY place) <= 20),
    texts AS (SELECT file, row, [x FOR x IN [{txt('c')} FOR c IN cells] IF x IS NOT NULL] AS t FROM head),
    scored AS (SELECT file, row, len(list_distinct(t)) * 2
      + len(list_filter(t, lambda x: regexp_matches(x, '{csv.HEADER_WORD}'))) * 3 + len(t) * 0.25::DOUBLE
      - (len(t) - len(list_distinct(t))) * 2 - row * 0.15::DOUBLE AS score FROM texts WHERE len(t) > 0)
    SELECT file, row + 1 AS header_row, round(score, 4) AS score FROM scored
    QUALIFY row_number() OVER (PARTITION BY file ORDER BY score DESC, row) = 1""")
def header_survey(t: Tables) -> DataFrame:
    rows = _lines(t).select("file", "place", F.split("line", " ").alias("cells"))
    return csv.header_survey(rows).drop("names")


@query("drop_empty_rows", "S4", f"""SELECT count(*) AS rows FROM (SELECT CASE WHEN value < 30 THEN ' null ' END AS a,
    CASE WHEN event_type = 'view' THEN chr(9) ELSE event_type END AS b FROM events)
    WHERE ({txt('a')}) IS NOT NULL OR ({txt('b')}) IS NOT NULL""")
def drop_empty_rows(t: Tables) -> DataFrame:
    df = t.events.selectExpr("CASE WHEN value < 30 THEN ' null ' END AS a",
                             "CASE WHEN event_type = 'view' THEN '\t' ELSE event_type END AS b")
    return csv.require_data(csv.drop_empty_rows(df)).agg(F.count(F.lit(1)).alias("rows"))


@query("intake_checks", "S5", """SELECT 'has_rows' AS "check", count(*) > 0 AS passed FROM documents
    UNION ALL SELECT 'rows_within_limit', count(*) <= 100000 FROM documents
    UNION ALL SELECT 'columns_within_limit', FALSE UNION ALL SELECT 'no_binary_content', count(*) FILTER (contains(text, chr(0))) = 0
    FROM documents""")
def intake_checks(t: Tables) -> DataFrame:
    return csv.intake_checks(t.documents, max_rows=100_000, max_columns=3)


@query("source_manifest", "S7", "SELECT * FROM (" + " UNION ALL ".join(
    f"SELECT '{n}' AS source, count(*) AS rows FROM {n}" for n in TABLE_NAMES
) + ") UNION ALL SELECT '(total)', " + " + ".join(f"(SELECT count(*) FROM {n})" for n in TABLE_NAMES))
def source_manifest(t: Tables) -> DataFrame:
    return csv.manifest({n: getattr(t, n) for n in TABLE_NAMES})


RISKY = "CASE WHEN event_type = 'view' THEN concat('=SUM(A', CAST(user_id AS STRING), ')') WHEN event_type = 'error' THEN " \
        "concat('\u00a0-', CAST(user_id AS STRING)) WHEN event_type = 'click' THEN '\u3000@cmd' ELSE event_type END"


@query("formula_guard", "S9", f"""SELECT event_id, CASE WHEN regexp_matches({trim('n')}, '^[=+@-]') THEN '''' || n ELSE n END AS "'=note", value
    FROM (SELECT event_id, {RISKY} AS n, value FROM events)""")
def formula_guard(t: Tables) -> DataFrame:
    return sinks.formula_guard(t.events.selectExpr("event_id", f"{RISKY} AS `=note`", "value"))


@query("result_page", "S10", """SELECT o_orderkey, o_totalprice, row_number() OVER (ORDER BY o_totalprice DESC, o_orderkey) AS row_number
    FROM orders QUALIFY row_number BETWEEN 51 AND 75""")
def result_page(t: Tables) -> DataFrame:
    order = [F.col("o_totalprice").desc(), F.col("o_orderkey").asc()]
    rows = sinks.page(t.orders.select("o_orderkey", "o_totalprice"), order, 2)
    return rows.withColumn("row_number", F.col("row_number").cast("bigint"))


@query("result_page_after", "S10", """SELECT o_orderkey, o_totalprice, row_number() OVER (ORDER BY o_orderkey) AS row_number
    FROM orders QUALIFY o_orderkey > 74 AND row_number <= 100""")
def result_page_after(t: Tables) -> DataFrame:
    rows = sinks.page_after(t.orders.select("o_orderkey", "o_totalprice"), "o_orderkey", 74, 75)
    return rows.withColumn("row_number", F.col("row_number").cast("bigint"))


@query("typed_columns", "S11 P2", """SELECT 'o_orderkey' AS "column", 'number' AS inferred_type, count(*) AS present FROM orders
    UNION ALL SELECT 'o_orderstatus', 'text', count(*) FROM orders UNION ALL SELECT 'o_totalprice', 'number', count(*) FROM orders
    UNION ALL SELECT 'o_orderdate', 'date', count(*) FROM orders""")
def typed_columns(t: Tables) -> DataFrame:
    return column_stats(t.orders, ["o_orderkey", "o_orderstatus", "o_totalprice", "o_orderdate"]).select(
        "column", "inferred_type", "present")


@query("trimmed_text", "P1 N2", f"""SELECT doc_id, length({trim('text')}) AS length, ({txt('text')}) IS NULL AS missing FROM documents""")
def trimmed_text(t: Tables) -> DataFrame:
    df = t.documents
    return df.select("doc_id", F.length(cells.trimmed(F.col("text"))).cast("bigint").alias("length"),
                     cells.missing(df, "text").alias("missing"))


@query("csv_round_trip", "S1 S8", """SELECT CAST(doc_id AS VARCHAR) AS doc_id, lang, source, CAST(n_chars AS VARCHAR) AS n_chars, length(text) AS length,
    md5(text) AS digest FROM documents""")
def csv_round_trip(t: Tables) -> DataFrame:
    """All documents written as CSV and scanned back: quotes, commas and line breaks survive."""
    path = scratch_path(t.spark, "documents")
    sinks.write_csv(t.documents, path, guard=False, bom=True)
    back = intake.read(t.spark, path).rows
    return back.select("doc_id", "lang", "source", "n_chars", F.length("text").cast("bigint").alias("length"), F.md5("text").alias("digest"))


# Four kinds of files: a title above the header; semicolons, columns swapped and quotes in cells; tabs and cells beyond the
# header; line breaks in cells. Ranks 0 and 1 are the title and the header.
FILES = {
    0: (",", "['Customers, all', NULL, NULL, NULL]", "['customer id', 'name', 'balance', NULL]", "[id, c_name, balance, NULL]"),
    1: (";", "['Kunden', NULL, NULL, NULL]", "['balance', 'customer id', 'name', NULL]", "[balance, id, concat(c_name, '; \"x\"'), NULL]"),
    2: ("\t", None, "['customer id', 'balance', 'name', NULL]", "[id, balance, c_name, CASE WHEN c_acctbal < 0 THEN 'owes' END]"),
    3: (",", None, "['name', 'balance', 'customer id', NULL]", "[concat(c_name, chr(10), 'second, line'), balance, id, NULL]"),
}
_CELLS = "SELECT c_custkey % 4 AS kind, CAST(c_custkey AS STRING) AS id, c_name, CAST(c_acctbal AS STRING) AS balance, c_acctbal FROM customer"


def _customer_files(t: Tables) -> str:
    """The customers as CSV files of the four kinds, eight files each."""
    path, rows = scratch_path(t.spark, "customers"), t.customer.selectExpr(
        "c_custkey % 4 AS kind", "CAST(c_custkey AS STRING) AS id", "c_name", "CAST(c_acctbal AS STRING) AS balance", "c_acctbal")
    for kind, (delimiter, title, header, row) in FILES.items():
        mine = rows.filter(F.col("kind") == kind).withColumn("part", F.pmod(F.xxhash64("id"), F.lit(8)))
        parts = mine.select("part").distinct()
        lists = [parts.selectExpr("part", f"{i} AS rank", "'' AS id", f"array({text[1:-1]}) AS cells") for i, text in enumerate((title, header)) if text]
        data = mine.selectExpr("part", "2 AS rank", "id", f"array({row[1:-1]}) AS cells")
        for one in lists:
            data = data.unionByName(one)
        placed = data.repartition("part").sortWithinPartitions("part", "rank", "id")
        # Without a surplus cell a line has no fourth place.
        wide = placed.select("part", *[F.get("cells", F.lit(i)).alias(f"c{i}") for i in range(4 if kind == 2 else 3)])
        wide.write.partitionBy("part").option("sep", delimiter).option("quote", '"').option("escape", '"').option("emptyValue", "").csv(f"{path}/kind={kind}")
    return path


@query("csv_intake", "S1 S2 S3 S4", f"""WITH c AS ({_CELLS}) SELECT id AS "customer id",
    CASE kind WHEN 1 THEN concat(c_name, '; "x"') WHEN 3 THEN concat(c_name, chr(10), 'second, line') ELSE c_name END AS name, balance,
    CASE WHEN kind = 2 AND c_acctbal < 0 THEN 'owes' END AS "{csv.BLANK_NAME}4" FROM c""")
def csv_intake(t: Tables) -> DataFrame:
    """Files of different delimiters, header rows and column orders as one table; nothing about them is told."""
    return intake.read(t.spark, _customer_files(t)).rows


@query("csv_intake_survey", "S2 S3", f"""WITH c AS ({_CELLS}), f AS (SELECT kind, count(*) AS rows FROM c GROUP BY kind)
    SELECT CASE kind WHEN 1 THEN ';' WHEN 2 THEN chr(9) ELSE ',' END AS delimiter, kind = 3 AS multiline, CASE WHEN kind < 2 THEN 2 ELSE 1 END AS header_row, rows FROM f""")
def csv_intake_survey(t: Tables) -> DataFrame:
    """How the files were read, by kind, and how many rows each kind gave."""
    path = _customer_files(t)
    found = intake.read(t.spark, path)
    kind = F.regexp_extract("file", "kind=([0-9])", 1).cast("bigint")
    files = found.survey.select(kind.alias("kind"), "delimiter", "multiline", "header_row").distinct()
    rows = found.rows.groupBy((F.col("customer id").try_cast("bigint") % 4).alias("k")).agg(F.count(F.lit(1)).alias("rows"))
    return files.join(rows, F.col("kind") == F.col("k")).select("delimiter", "multiline", F.col("header_row").cast("int").alias("header_row"), "rows")


@query("csv_typed_scan", "S6", """SELECT o_orderstatus, strftime(o_orderdate, '%Y-%m') AS month, count(*) AS orders,
    round(sum(o_totalprice), 2) AS amount FROM orders GROUP BY ALL""")
def csv_typed_scan(t: Tables) -> DataFrame:
    """Orders as CSV, scanned with a schema that names three of the six columns."""
    folder = scratch_path(t.spark, "tables")
    sinks.write_csv(t.orders, f"{folder}/orders.csv", guard=False)
    schema = T.StructType([
        T.StructField("o_orderstatus", T.StringType()), T.StructField("o_totalprice", T.DoubleType()),
        T.StructField("o_orderdate", T.TimestampType()),
    ])
    orders = csv.scan_tables(t.spark, folder, {"orders": schema})["orders"]
    found = orders.groupBy("o_orderstatus", F.date_format("o_orderdate", "yyyy-MM").alias("month")).agg(
        F.count(F.lit(1)).alias("orders"), F.sum("o_totalprice").alias("amount"))
    return rounded(found, 2)
