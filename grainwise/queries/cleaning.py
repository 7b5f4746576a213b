"""Repairs, receipts, scope."""

from __future__ import annotations

from pyspark.sql import DataFrame

from grainwise.functions.predicates import FilterRule
from grainwise.operators import cleaning, metrics
from grainwise.operators.cleaning import Repair
from grainwise.operators.audit import union_all
from grainwise.queries.base import CLEAN_CTE, DIRTY, Tables, dirty_events, query, rounded, trim
from pyspark.sql import functions as F

SHAPE = ["event_id", "customer_id", "region", "status"]  # repeats once the ordinal is set aside
KEPT = ", ".join(f"trim({c}, ' ')" for c in SHAPE[1:])
REPAIRS = [Repair("drop_missing", "customer_id"), Repair("drop_missing", "region"), Repair("deduplicate_exact")]


@query("clean_dedupe", "C1", f"""
    SELECT min(doc_id) AS doc_id, count(*) AS copies FROM documents
    GROUP BY {trim('text')}, {trim('lang')} """)
def clean_dedupe(t: Tables) -> DataFrame:
    docs = t.documents.select("doc_id", "text", "lang")
    kept = cleaning.keep_first(docs, ["doc_id"]).select("doc_id")
    digest = cleaning.cells.row_digest(docs, ["text", "lang"])
    copies = docs.groupBy(digest.alias("d")).agg(F.min("doc_id").alias("doc_id"), F.count(F.lit(1)).alias("copies"))
    return kept.join(copies.select("doc_id", "copies"), "doc_id")


@query("clean_drop_missing", "C2", f"""WITH {CLEAN_CTE}
    SELECT event_id FROM cells WHERE customer_id IS NOT NULL""")
def clean_drop_missing(t: Tables) -> DataFrame:
    return cleaning.clean(dirty_events(t), [Repair("drop_missing", "customer_id")]).select("event_id")


@query("clean_drop_invalid_date", "C3", f"""WITH {CLEAN_CTE}
    SELECT event_id FROM cells WHERE purchase_date IS NULL OR day IS NOT NULL""")
def clean_drop_invalid_date(t: Tables) -> DataFrame:
    return cleaning.clean(dirty_events(t), [Repair("drop_invalid_date", "purchase_date")]).select("event_id")


@query("clean_plan", "C1 C2 C4", f"""WITH {CLEAN_CTE}
    SELECT min(d.event_id) AS event_id FROM dirty d JOIN cells c USING (event_id)
    WHERE c.customer_id IS NOT NULL AND c.region IS NOT NULL
    GROUP BY {', '.join(f"trim(d.{c}, ' ')" for c in SHAPE[1:])}""")
def clean_plan(t: Tables) -> DataFrame:
    return cleaning.clean(dirty_events(t).select(*SHAPE), REPAIRS, ["event_id"]).select("event_id")


@query("clean_receipt", "C4 C5", f"""WITH {CLEAN_CTE},
    firsts AS (SELECT min(event_id) AS event_id FROM dirty GROUP BY {KEPT}),
    left0 AS (SELECT c.* FROM cells c JOIN firsts USING (event_id)),
    n AS (SELECT (SELECT count(*) FROM cells) AS s, (SELECT count(*) FROM left0) AS a,
      (SELECT count(*) FROM left0 WHERE customer_id IS NOT NULL) AS b,
      (SELECT count(*) FROM left0 WHERE customer_id IS NOT NULL AND region IS NOT NULL) AS c)
    SELECT CAST(0 AS BIGINT) AS step, 'deduplicate_exact' AS action, s - a AS affected_rows, a AS rows_after FROM n
    UNION ALL SELECT 1, 'drop_missing(customer_id)', a - b, b FROM n
    UNION ALL SELECT 2, 'drop_missing(region)', b - c, c FROM n""")
def clean_receipt(t: Tables) -> DataFrame:
    return cleaning.receipt(dirty_events(t).select(*SHAPE), REPAIRS, ["event_id"])


@query("clean_before_after", "C5", f"""WITH {CLEAN_CTE},
    kept AS (SELECT min(d.event_id) AS event_id FROM dirty d JOIN cells c USING (event_id)
      WHERE c.customer_id IS NOT NULL AND c.region IS NOT NULL
      GROUP BY {', '.join(f"trim(d.{c}, ' ')" for c in SHAPE[1:])}),
    after AS (SELECT c.* FROM cells c JOIN kept USING (event_id))
    SELECT (SELECT count(*) FROM cells) AS source_rows, (SELECT count(*) FROM kept) AS result_rows,
      (SELECT count(*) FROM cells) - (SELECT count(*) FROM kept) AS removed_rows,
      1 + CAST((SELECT count(*) > count(customer_id) FROM cells) AS BIGINT)
        + CAST((SELECT count(*) > count(region) FROM cells) AS BIGINT)
        + CAST((SELECT count(*) > count(status) FROM cells) AS BIGINT)
        + CAST((SELECT count(*) > count(DISTINCT lower(customer_id)) FROM cells WHERE customer_id IS NOT NULL) AS BIGINT)
        AS issues_before,
      CAST((SELECT count(*) > count(status) FROM after) AS BIGINT)
        + CAST((SELECT count(*) > count(DISTINCT lower(customer_id)) FROM after) AS BIGINT) AS issues_after,
      CAST(0 AS BIGINT) AS checks_skipped_after""")
def clean_before_after(t: Tables) -> DataFrame:
    source = dirty_events(t).select(*SHAPE)
    derived = cleaning.clean(source, REPAIRS, ["event_id"])
    names = SHAPE[1:]
    return cleaning.before_and_after(
        source.select(*names), derived.select(*names), ids=["customer_id"], dates=[]
    )


@query("clean_scope", "C6", f"""WITH {CLEAN_CTE}
    SELECT 'source' AS version, count(*) AS rows, count(DISTINCT customer_id) AS distinct_entities FROM cells
    UNION ALL SELECT 'derived', count(*), count(DISTINCT customer_id) FROM cells
      WHERE region IS NOT NULL AND (purchase_date IS NULL OR day IS NOT NULL)""")
def clean_scope(t: Tables) -> DataFrame:
    source = dirty_events(t)
    derived = cleaning.clean(source, [Repair("drop_missing", "region"), Repair("drop_invalid_date", "purchase_date")])
    return cleaning.scope(source, derived, "customer_id")


STRICT = f"""WITH {CLEAN_CTE},
    strict AS (SELECT * FROM cells WHERE customer_id IS NOT NULL AND region IS NOT NULL AND day IS NOT NULL)"""


@query("clean_strict", "C7", f"{STRICT} SELECT event_id, customer_id, region FROM strict")
def clean_strict(t: Tables) -> DataFrame:
    kept = cleaning.strict_clean(dirty_events(t), ["customer_id", "region"], "purchase_date")
    return kept.select("event_id", cleaning.cells.text(kept, "customer_id").alias("customer_id"),
                       cleaning.cells.text(kept, "region").alias("region"))


@query("clean_strict_metrics", "A11", f"""{STRICT}
    SELECT 'count' AS metric, CAST(count(DISTINCT customer_id) AS DOUBLE) AS value FROM strict
    UNION ALL SELECT 'amount', round(sum(number), 4) FROM strict
    UNION ALL SELECT 'average', round(sum(number) / count(DISTINCT CASE WHEN number IS NOT NULL THEN customer_id END), 4)
      FROM strict
    UNION ALL SELECT 'ratio', round(count(DISTINCT CASE WHEN region = 'East' THEN customer_id END)
      / count(DISTINCT customer_id), 4) FROM strict""")
def clean_strict_metrics(t: Tables) -> DataFrame:
    kept = cleaning.strict_clean(dirty_events(t), ["customer_id", "region"], "purchase_date")
    rows = []
    for kind in metrics.KINDS:
        metric = metrics.Metric(kind, "customer_id", "amount", numerator=FilterRule("region", "equals", "East"))
        rows.append(metrics.evaluate(kept, metric).select(F.lit(kind).alias("metric"), "value"))
    return rounded(union_all(rows))
