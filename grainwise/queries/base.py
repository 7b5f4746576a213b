"""Registry of queries and the SQL that checks them."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

TABLE_NAMES = (
    "region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings",
    "pages", "benchmark", "labels", "conversations",
)


class Tables:
    """The Parquet tables of one folder, opened when first used."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark = spark
        self.folder = folder

    def __getattr__(self, name: str) -> DataFrame:
        if name not in TABLE_NAMES:
            raise AttributeError(name)
        return self.spark.read.parquet(f"{self.folder}/{name}.parquet")


@dataclass(frozen=True)
class Query:
    name: str
    ids: str  # rows of the operator inventory it exercises
    run: Callable[[Tables], DataFrame]
    sql: str | None


REGISTRY: dict[str, Query] = {}


def query(name: str, ids: str, sql: str | None = None):
    def register(run: Callable[[Tables], DataFrame]):
        if name in REGISTRY:
            raise ValueError(f"query {name} is registered twice")
        REGISTRY[name] = Query(name, ids, run, sql)
        return run
    return register


def rounded(df: DataFrame, digits: int = 4, *names: str) -> DataFrame:
    """Doubles rounded, so that the order of a sum does not show."""
    wanted = names or [f.name for f in df.schema.fields if f.dataType.simpleString() == "double"]
    return df.withColumns({n: F.round(n, digits) for n in wanted})


# Data with the defects the operators are about, derived from the events table.
# The expressions are plain SQL that both engines read alike.
DIRTY = {
    "event_id": "event_id",
    "customer_id": "CASE WHEN value < 1 THEN '' WHEN value < 2 THEN ' NULL ' WHEN value < 3 THEN NULL "
                   "WHEN value < 40 THEN concat('  u-', CAST(user_id AS STRING)) "
                   "ELSE concat('U-', CAST(user_id AS STRING), ' ') END",
    "purchase_date": "CASE WHEN value < 5 THEN '2024-02-31' WHEN value < 6 THEN 'not-a-date' WHEN value < 8 THEN NULL "
                     "WHEN value < 9 THEN '__null__' "
                     "WHEN value < 40 THEN replace(CAST(CAST(ts AS DATE) AS STRING), '-', '/') "
                     "WHEN value < 60 THEN concat(CAST(CAST(ts AS DATE) AS STRING), ' 10:30:00') "
                     "ELSE CAST(CAST(ts AS DATE) AS STRING) END",
    "amount": "CASE WHEN value > 120 THEN 'bad' WHEN value > 110 THEN '' WHEN value > 105 THEN '1e3' "
              "WHEN value > 100 THEN '+5' WHEN value > 60 THEN concat(' ', CAST(value AS STRING), ' ') "
              "ELSE CAST(value AS STRING) END",
    "region": "CASE event_type WHEN 'error' THEN NULL WHEN 'view' THEN ' East' WHEN 'click' THEN 'East ' "
              "WHEN 'signup' THEN 'South' ELSE 'undefined' END",
    "status": "CASE WHEN value < 20 THEN 'delivered' WHEN value < 30 THEN ' Delivered ' WHEN value < 50 THEN 'shipped' "
              "WHEN value < 55 THEN '' ELSE 'cancelled' END",
}
DIRTY_SQL = "SELECT " + ", ".join(f"{expr} AS {name}" for name, expr in DIRTY.items()) + " FROM events"


def dirty_events(t: Tables) -> DataFrame:
    return t.events.selectExpr(*[f"{expr} AS {name}" for name, expr in DIRTY.items()])


# DuckDB text of the cell rules, stated independently of the Spark expressions.
BLANKS = "concat(' ', chr(9), chr(10), chr(11), chr(12), chr(13), chr(160), chr(12288), chr(65279))"


def trim(x: str) -> str:
    return f"trim({x}, {BLANKS})"


def txt(x: str) -> str:
    return f"CASE WHEN lower({trim(x)}) NOT IN ('', 'null', 'undefined', '__null__') THEN {trim(x)} END"


def num(x: str) -> str:
    return (f"CASE WHEN regexp_full_match({trim(x)}, '-?([0-9]+[.]?[0-9]*|[.][0-9]+)') "
            f"THEN TRY_CAST({trim(x)} AS DOUBLE) END")


def day(x: str) -> str:
    return (f"CASE WHEN regexp_full_match({trim(x)}, '[0-9]{{4}}[-/][0-9]{{1,2}}[-/][0-9]{{1,2}}([ T].*)?') THEN "
            f"TRY_CAST(replace(regexp_extract({trim(x)}, '^[0-9]{{4}}[-/][0-9]{{1,2}}[-/][0-9]{{1,2}}'), '/', '-') AS DATE) END")


def cls(x: str) -> str:
    return (f"CASE WHEN ({txt(x)}) IS NULL THEN NULL WHEN ({day(x)}) IS NOT NULL THEN 'date' "
            f"WHEN ({num(x)}) IS NOT NULL THEN 'number' "
            f"WHEN lower({trim(x)}) IN ('true', 'false', '是', '否') THEN 'boolean' ELSE 'text' END")


# The dirty events with every cell already normalised (DuckDB side).
CLEAN_CTE = f"""dirty AS ({DIRTY_SQL}),
cells AS (SELECT event_id, {txt('customer_id')} AS customer_id, {txt('purchase_date')} AS purchase_date,
  {txt('amount')} AS amount, {txt('region')} AS region, {txt('status')} AS status,
  {num('amount')} AS number, {day('purchase_date')} AS day FROM dirty)"""
