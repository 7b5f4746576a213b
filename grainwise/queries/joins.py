"""Keys, relationships, joins, enrichment, reconciliation."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from grainwise.operators import joins, keys, reconcile
from grainwise.operators.audit import union_all
from grainwise.operators.joins import JoinSpec, Step
from grainwise.queries.base import CLEAN_CTE, Tables, dirty_events, query, rounded

ORDER_LINES = [("o_orderkey", "l_orderkey")]
ORDER_CUSTOMER = [("o_custkey", "c_custkey")]


def unprefixed(name: str) -> str:
    """o_custkey and c_custkey are the same field under the tables' one-letter prefixes."""
    return keys.normal_name(re.sub(r"^[a-z]{1,2}_", "", name))


def _key_sql(table: str, columns: list[str], label: str) -> str:
    whole = " AND ".join(f"{c} IS NOT NULL" for c in columns)
    return f"""SELECT '{label}' AS "key", CAST(sum(n) AS BIGINT) AS rows,
      CAST(coalesce(sum(n) FILTER (NOT ({whole})), 0) AS BIGINT) AS null_rows, count(*) FILTER ({whole}) AS distinct_keys,
      count(*) FILTER ({whole} AND n > 1) AS duplicated_keys,
      CAST(coalesce(sum(n) FILTER ({whole} AND n > 1), 0) AS BIGINT) AS rows_in_duplicated_keys,
      count(*) FILTER ({whole}) = sum(n) AS "unique"
      FROM (SELECT {', '.join(columns)}, count(*) AS n FROM {table} GROUP BY ALL)"""


@query("key_profile", "J1 J11 N10", f"WITH {CLEAN_CTE}, low AS (SELECT lower(customer_id) AS c FROM cells) " + " UNION ALL ".join([
    _key_sql("orders", ["o_orderkey"], "orders"), _key_sql("lineitem", ["l_orderkey", "l_linenumber"], "lines"),
    _key_sql("low", ["c"], "dirty customers"),
]))
def key_profile(t: Tables) -> DataFrame:
    parts = [("orders", t.orders, ["o_orderkey"]), ("lines", t.lineitem, ["l_orderkey", "l_linenumber"]),
             ("dirty customers", dirty_events(t), ["customer_id"])]
    return union_all([keys.key_profile(df, f).withColumn("key", F.lit(name)) for name, df, f in parts])


def _relationship_sql(left: str, right: str) -> str:
    """left and right: (k, n) count queries."""
    return f"""l AS ({left}), r AS ({right}),
    b AS (SELECT l.k AS lk, r.k AS rk, l.n AS ln, r.n AS rn FROM l FULL JOIN r ON l.k = r.k),
    f AS (SELECT CAST(coalesce(sum(ln), 0) AS BIGINT) AS left_rows, CAST(coalesce(sum(rn), 0) AS BIGINT) AS right_rows,
      CAST(coalesce(sum(ln) FILTER (lk IS NULL), 0) AS BIGINT) AS left_null_rows,
      CAST(coalesce(sum(rn) FILTER (rk IS NULL), 0) AS BIGINT) AS right_null_rows,
      count(*) FILTER (ln IS NOT NULL AND (lk IS NULL OR ln > 1)) = 0 AS left_unique,
      count(*) FILTER (rn IS NOT NULL AND (rk IS NULL OR rn > 1)) = 0 AS right_unique,
      CAST(coalesce(sum(ln) FILTER (lk = rk), 0) AS BIGINT) AS matched_left_rows,
      CAST(coalesce(sum(rn) FILTER (lk = rk), 0) AS BIGINT) AS matched_right_rows,
      CAST(coalesce(sum(ln) FILTER (rn IS NULL), 0) AS BIGINT) AS left_orphan_rows,
      CAST(coalesce(sum(rn) FILTER (ln IS NULL), 0) AS BIGINT) AS right_orphan_rows,
      count(*) FILTER (rn IS NULL AND lk IS NOT NULL) AS left_orphan_keys,
      count(*) FILTER (ln IS NULL AND rk IS NOT NULL) AS right_orphan_keys,
      CAST(coalesce(sum(ln * coalesce(rn, 1)) FILTER (ln IS NOT NULL), 0) AS BIGINT) AS left_join_rows,
      CAST(coalesce(sum(ln * rn), 0) AS BIGINT) AS inner_join_rows FROM b)
    SELECT *, CASE WHEN left_unique AND right_unique THEN '1:1' WHEN left_unique THEN '1:N' WHEN right_unique THEN 'N:1'
      ELSE 'N:N' END AS cardinality, round(matched_left_rows / left_rows, 4) AS left_coverage,
      round(matched_right_rows / right_rows, 4) AS right_coverage, round(left_join_rows / left_rows, 4) AS expansion,
      NOT right_unique AS measure_risk, NOT left_unique AND NOT right_unique AS blocked FROM f"""


def _counts(table: str, key: str) -> str:
    return f"SELECT {key} AS k, count(*) AS n FROM {table} GROUP BY 1"


@query("relationship_profile", "J2 J3 J4", "WITH " + _relationship_sql(
    _counts("orders", "o_orderkey"), _counts("lineitem", "l_orderkey")))
def relationship_profile(t: Tables) -> DataFrame:
    return rounded(keys.relationship(t.orders, t.lineitem, ORDER_LINES))


USER_TEXT = "CASE WHEN user_id < 20 THEN ' null' WHEN user_id < 60 THEN concat('u-', CAST(user_id AS STRING)) " \
            "ELSE concat(' U-', CAST(user_id AS STRING)) END"


@query("relationship_dirty_keys", "J3 J12 N6 N10", f"WITH {CLEAN_CTE}, " + _relationship_sql(
    _counts("cells", "lower(customer_id)"),
    f"SELECT CASE WHEN u NOT IN ('null') THEN u END AS k, count(*) AS n "
    f"FROM (SELECT DISTINCT lower(trim({USER_TEXT})) AS u, user_id FROM events) GROUP BY 1"))
def relationship_dirty_keys(t: Tables) -> DataFrame:
    people = t.events.groupBy("user_id").agg(F.lit(1).alias("x")).selectExpr(f"{USER_TEXT} AS person")
    return rounded(keys.relationship(dirty_events(t), people, [("customer_id", "person")]))


@query("relationship_type_tag", "J12 N6", """SELECT (SELECT count(*) FROM orders) AS left_rows, CAST(0 AS BIGINT) AS
    matched_left_rows, (SELECT count(*) FROM orders) AS left_orphan_rows, (SELECT count(*) FROM customer) AS right_orphan_rows""")
def relationship_type_tag(t: Tables) -> DataFrame:
    """The number 1 and the text '1' are different keys."""
    as_text = t.customer.select(F.col("c_custkey").cast("string").alias("c_custkey"))
    return keys.relationship(t.orders, as_text, ORDER_CUSTOMER).select(
        "left_rows", "matched_left_rows", "left_orphan_rows", "right_orphan_rows")


@query("orphan_keys", "J4 W7", """
    SELECT DISTINCT o_orderkey AS k0, 'left' AS side, CAST(1 AS BIGINT) AS rows FROM orders
    WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem)
    UNION ALL SELECT l_orderkey, 'right', count(*) FROM lineitem
    WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders) GROUP BY l_orderkey""")
def orphan_keys(t: Tables) -> DataFrame:
    return keys.orphan_keys(t.orders, t.lineitem, ORDER_LINES)


def _candidate_sql(left: str, right: str, lk: list[str], rk: list[str]) -> str:
    def counts(table: str, columns: list[str]) -> str:
        return f"(SELECT {', '.join(f'{c} AS k{i}' for i, c in enumerate(columns))}, count(*) AS n FROM {table} GROUP BY ALL)"
    on = " AND ".join(f"l.k{i} = r.k{i}" for i in range(len(lk)))
    return f"""SELECT '{left}' AS left_table, '{right}' AS right_table, '{"+".join(lk)}' AS left_fields,
      '{"+".join(rk)}' AS right_fields, CASE WHEN max(l.n) = 1 AND max(r.n) = 1 THEN '1:1' WHEN max(l.n) = 1 THEN '1:N'
        WHEN max(r.n) = 1 THEN 'N:1' ELSE 'N:N' END AS cardinality,
      CAST(coalesce(sum(l.n) FILTER (r.n IS NULL), 0) AS BIGINT) AS left_orphan_rows,
      CAST(coalesce(sum(r.n) FILTER (l.n IS NULL), 0) AS BIGINT) AS right_orphan_rows
      FROM {counts(left, lk)} l FULL JOIN {counts(right, rk)} r ON {on}"""


@query("relationship_candidates", "J5", "WITH c AS (" + " UNION ALL ".join([
    _candidate_sql("orders", "customer", ["o_custkey"], ["c_custkey"]),
    _candidate_sql("orders", "lineitem", ["o_orderkey"], ["l_orderkey"]),
    _candidate_sql("customer", "nation", ["c_nationkey"], ["n_nationkey"]),
]) + """) SELECT *, left_orphan_rows + right_orphan_rows + CASE WHEN cardinality = 'N:N' THEN 10 ELSE 0 END AS score FROM c""")
def relationship_candidates(t: Tables) -> DataFrame:
    tables = {"orders": t.orders, "customer": t.customer, "lineitem": t.lineitem, "nation": t.nation}
    return keys.join_candidates(tables, unprefixed).select(
        "left_table", "right_table", "left_fields", "right_fields", "cardinality", "left_orphan_rows",
        "right_orphan_rows", "score")


@query("bridge_candidates", "J6", "WITH c AS (" + " UNION ALL ".join([
    _candidate_sql("customer", "nation", ["c_nationkey"], ["n_nationkey"]),
    _candidate_sql("supplier", "nation", ["s_nationkey"], ["n_nationkey"]),
    _candidate_sql("customer", "nation", ["c_name"], ["n_name"]),
    _candidate_sql("supplier", "nation", ["s_name"], ["n_name"]),
]) + """) SELECT left_table, left_fields, right_fields, cardinality, left_orphan_rows, right_orphan_rows FROM c""")
def bridge_candidates(t: Tables) -> DataFrame:
    included = {"customer": t.customer, "supplier": t.supplier}
    return keys.bridge_candidates(included, "nation", t.nation, unprefixed).select(
        "left_table", "left_fields", "right_fields", "cardinality", "left_orphan_rows", "right_orphan_rows")


@query("key_samples", "J7 W6 W7", """
    WITH l AS (SELECT DISTINCT CAST(o_orderkey AS VARCHAR) AS k FROM orders),
      r AS (SELECT DISTINCT CAST(l_orderkey AS VARCHAR) AS k FROM lineitem)
    (SELECT 'matched' AS kind, k AS key FROM l WHERE k IN (SELECT k FROM r) ORDER BY k LIMIT 3)
    UNION ALL (SELECT 'left_orphan', k FROM l WHERE k NOT IN (SELECT k FROM r) ORDER BY k LIMIT 3)
    UNION ALL (SELECT 'right_orphan', k FROM r WHERE k NOT IN (SELECT k FROM l) ORDER BY k LIMIT 3)""")
def key_samples(t: Tables) -> DataFrame:
    return keys.key_samples(t.orders, t.lineitem, ORDER_LINES)


LEFT_CUSTOMER = JoinSpec(tuple(ORDER_CUSTOMER), "left", "N:1", "left").confirm("one row per order")
INNER_LINES = JoinSpec(tuple(ORDER_LINES), "inner", "1:N", "right").confirm("one row per matched line")


@query("join_preview", "J8", """
    SELECT 'inner' AS how, '1:N' AS cardinality, (SELECT count(*) FROM orders JOIN lineitem ON o_orderkey = l_orderkey) AS
      output_rows, round((SELECT count(*) FROM orders JOIN lineitem ON o_orderkey = l_orderkey)
      / (SELECT count(*) FROM orders), 4) AS expansion,
      (SELECT count(*) FROM orders WHERE o_orderkey IN (SELECT l_orderkey FROM lineitem)) AS matched_left_rows,
      (SELECT count(*) FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem)) AS left_orphan_rows,
      CAST(0 AS BIGINT) AS right_orphan_rows""")
def join_preview(t: Tables) -> DataFrame:
    return rounded(joins.preview(t.orders, t.lineitem, INNER_LINES))


PERSON = [("customer_id", "person")]
PEOPLE_SQL = "SELECT concat('U-', CAST(user_id AS STRING)) AS person, count(*) AS visits FROM events " \
             "WHERE event_type = 'purchase' AND value > 60 GROUP BY user_id"


def _people(t: Tables) -> DataFrame:
    return t.events.filter("event_type = 'purchase' AND value > 60").groupBy("user_id").agg(
        F.count(F.lit(1)).alias("visits")).select(F.expr("concat('U-', CAST(user_id AS STRING))").alias("person"), "visits")


@query("join_left", "J9 J12 J14", f"""WITH {CLEAN_CTE}, people AS ({PEOPLE_SQL})
    SELECT d.event_id AS e__event_id, c.region AS region, p.person AS p__person, p.visits AS p__visits,
      p.person IS NOT NULL AS matched
    FROM dirty d JOIN cells c USING (event_id) LEFT JOIN people p ON lower(c.customer_id) = lower(p.person)""")
def join_left(t: Tables) -> DataFrame:
    left, right = dirty_events(t), _people(t)
    facts = joins.measured(left, right, PERSON)
    spec = joins.propose(left, right, PERSON, facts).confirm("one row per event")
    joined = joins.controlled_join(left, right, spec, "e", "p", facts=facts)
    return joined.select("e__event_id", joins.cells.text(joined, "e__region").alias("region"), "p__person", "p__visits",
                         "matched")


@query("join_inner", "J10 J14 F14", """SELECT o_orderkey AS o__o_orderkey, o_totalprice AS o__o_totalprice,
    l_linenumber AS l__l_linenumber, l_extendedprice AS l__l_extendedprice, TRUE AS matched
    FROM orders JOIN lineitem ON o_orderkey = l_orderkey""")
def join_inner(t: Tables) -> DataFrame:
    orders = t.orders.select("o_orderkey", "o_totalprice")
    lines = t.lineitem.select("l_orderkey", "l_linenumber", "l_extendedprice")
    return joins.controlled_join(orders, lines, INNER_LINES, "o", "l").drop("l__l_orderkey")


@query("join_composite_key", "J11", """
    WITH returns AS (SELECT l_orderkey, l_linenumber, count(*) AS returned FROM lineitem WHERE l_returnflag = 'R' GROUP BY ALL)
    SELECT l.l_orderkey AS l__l_orderkey, l.l_linenumber AS l__l_linenumber, l.l_quantity AS l__l_quantity,
      r.returned AS r__returned, r.l_orderkey IS NOT NULL AS matched
    FROM lineitem l LEFT JOIN returns r ON l.l_orderkey = r.l_orderkey AND l.l_linenumber = r.l_linenumber""")
def join_composite_key(t: Tables) -> DataFrame:
    pair = (("l_orderkey", "l_orderkey"), ("l_linenumber", "l_linenumber"))
    returns = t.lineitem.filter("l_returnflag = 'R'").groupBy("l_orderkey", "l_linenumber").agg(
        F.count(F.lit(1)).alias("returned"))
    lines = t.lineitem.select("l_orderkey", "l_linenumber", "l_quantity")
    joined = joins.equi_join(lines, returns, JoinSpec(pair), "l", "r")
    return joined.drop("r__l_orderkey", "r__l_linenumber")


@query("join_validation", "J13", """SELECT * FROM (VALUES ('versions_unchanged', FALSE), ('cardinality_as_confirmed', FALSE),
    ('not_many_to_many', TRUE), ('key_meaning_confirmed', FALSE), ('relationship_confirmed', FALSE),
    ('grain_confirmed', FALSE), ('orphans_acknowledged', FALSE), ('expansion_acknowledged', FALSE),
    ('grain_kept_by_join', FALSE), ('no_orphans_in_right_grain', FALSE), ('join_type_supported', TRUE),
    ('spec_confirmed', FALSE)) AS v("check", passed)""")
def join_validation(t: Tables) -> DataFrame:
    draft = JoinSpec(tuple(ORDER_LINES), "left", "N:1", "left", versions=("a", "b"))
    return joins.validation(keys.relationship(t.orders, t.lineitem, ORDER_LINES), draft, ("a", "c"))


@query("join_warnings", "J13", """
    WITH n AS (SELECT (SELECT count(*) FROM orders) AS o, (SELECT count(*) FROM lineitem) AS l,
      (SELECT count(*) FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem)) AS x)
    SELECT 'left_rows_unmatched' AS warning, x AS rows FROM n UNION ALL SELECT 'rows_added_by_join', l + x - o FROM n
    UNION ALL SELECT 'left_measures_may_repeat', l + x FROM n UNION ALL SELECT 'rows_dropped_by_inner_join', x FROM n""")
def join_warnings(t: Tables) -> DataFrame:
    return joins.warnings(keys.relationship(t.orders, t.lineitem, ORDER_LINES), INNER_LINES)


@query("join_recommendation", "J2 J14", """SELECT 'orders-lineitem' AS pair, '1:N' AS cardinality, 'right' AS grain, 'inner' AS how
    UNION ALL SELECT 'orders-customer', 'N:1', 'left', 'left' UNION ALL SELECT 'lineitem-events', 'N:N', NULL, 'left'""")
def join_recommendation(t: Tables) -> DataFrame:
    pairs = [("orders-lineitem", t.orders, t.lineitem, ORDER_LINES), ("orders-customer", t.orders, t.customer, ORDER_CUSTOMER),
             ("lineitem-events", t.lineitem, t.events, [("l_orderkey", "user_id")])]
    c = F.col("cardinality")
    return union_all([
        keys.relationship(a, b, on).select(F.lit(n).alias("pair"), "cardinality",
                                           joins.recommended_grain(c).alias("grain"), joins.default_type(c).alias("how"))
        for n, a, b, on in pairs])


@query("join_structural_checks", "J17", """SELECT * FROM (VALUES ('cardinality_stable', TRUE), ('rows_as_previewed', TRUE),
    ('not_many_to_many', TRUE), ('versions_unchanged', TRUE)) AS v("check", passed)""")
def join_structural_checks(t: Tables) -> DataFrame:
    rel = keys.relationship(t.orders, t.lineitem, ORDER_LINES)
    return joins.structural_checks(joins.equi_join(t.orders, t.lineitem, INNER_LINES, "o", "l"), rel, INNER_LINES)


def _reconcile_sql(label: str, field: str, rows: str) -> str:
    """rows: one row per source row with columns v (amount) and times."""
    return f"""SELECT '{label}' AS "table", '{field}' AS field, round(sum(v), 2) AS source_total,
      round(sum(v * times), 2) AS output_total, count(v) AS valid_source_rows,
      CAST(sum(times) FILTER (v IS NOT NULL) AS BIGINT) AS output_value_rows,
      count(v) FILTER (times > 1) AS duplicated_source_rows, count(v) FILTER (times = 0) AS excluded_source_rows,
      round(coalesce(sum(v * (times - 1)) FILTER (times > 1), 0), 2) AS duplication_impact,
      round(coalesce(sum(v) FILTER (times = 0), 0), 2) AS exclusion_impact,
      round(sum(v * times) - sum(v), 2) AS net_delta, round((sum(v * times) - sum(v)) / abs(sum(v)), 2) AS net_delta_rate,
      CASE WHEN count(v) FILTER (times > 1) > 0 AND count(v) FILTER (times = 0) > 0 THEN 'mixed'
        WHEN count(v) FILTER (times > 1) > 0 THEN 'duplicated' WHEN count(v) FILTER (times = 0) > 0 THEN 'excluded'
        ELSE 'balanced' END AS status FROM ({rows})"""


@query("join_reconcile", "J16", " UNION ALL ".join([
    _reconcile_sql("orders", "o_totalprice", """SELECT o_totalprice AS v,
      (SELECT count(*) FROM lineitem WHERE l_orderkey = o_orderkey) AS times FROM orders"""),
    _reconcile_sql("lineitem", "l_extendedprice", """SELECT l_extendedprice AS v,
      (SELECT count(*) FROM orders WHERE l_orderkey = o_orderkey) AS times FROM lineitem"""),
    _reconcile_sql("lineitem", "l_tax", """SELECT l_tax AS v,
      (SELECT count(*) FROM orders WHERE l_orderkey = o_orderkey) AS times FROM lineitem"""),
]))
def join_reconcile(t: Tables) -> DataFrame:
    taxes = reconcile.amount_fields(t.lineitem.columns)  # l_tax by name; the prices must be named
    found = reconcile.reconcile_join(t.orders, t.lineitem, ORDER_LINES, "inner", ["o_totalprice"],
                                     ["l_extendedprice", *taxes], "orders", "lineitem")
    return rounded(found, 2)


@query("join_unbalanced", "J21", """SELECT 'orders' AS "table", 'o_totalprice' AS field, 'mixed' AS status,
    round((SELECT sum(o_totalprice) FROM orders JOIN lineitem ON o_orderkey = l_orderkey)
      - (SELECT sum(o_totalprice) FROM orders), 2) AS net_delta""")
def join_unbalanced(t: Tables) -> DataFrame:
    found = reconcile.reconcile_join(t.orders, t.lineitem, ORDER_LINES, "inner", ["o_totalprice"], ["l_extendedprice"],
                                     "orders", "lineitem")
    return rounded(reconcile.unbalanced(found), 2)


ENRICH = JoinSpec(tuple(ORDER_LINES), "left", "1:N", "left").confirm("one row per order")


def _listed(column: str, name: str) -> str:
    return f"string_agg(DISTINCT {column}, '、' ORDER BY {column}) AS l__{name}_distinct_list"


@query("join_enrichment", "J18", f"""SELECT o_orderkey AS o__o_orderkey, o_totalprice AS o__o_totalprice,
    {_listed('l_returnflag', 'l_returnflag')}, {_listed('l_linestatus', 'l_linestatus')}, count(l_orderkey) > 0 AS matched
    FROM orders LEFT JOIN lineitem ON o_orderkey = l_orderkey GROUP BY o_orderkey, o_totalprice""")
def join_enrichment(t: Tables) -> DataFrame:
    orders = t.orders.select("o_orderkey", "o_totalprice")
    enriched = joins.enrich(orders, t.lineitem, ENRICH, ["l_returnflag", "l_linestatus"], "o", "l")
    return enriched.drop("l__l_returnflag_values", "l__l_linestatus_values")


@query("join_enrichment_checks", "J19 J22", """SELECT * FROM (VALUES ('left_grain_kept', TRUE), ('unmatched_rows_kept', TRUE),
    ('one_to_many_stable', TRUE), ('amounts_balanced', TRUE), ('versions_unchanged', TRUE), ('one_to_many', TRUE),
    ('left_join', TRUE), ('left_grain', TRUE), ('key_meaning_confirmed', TRUE), ('relationship_confirmed', TRUE),
    ('grain_confirmed', TRUE), ('orphans_acknowledged', TRUE), ('expansion_acknowledged', TRUE), ('some_field', TRUE),
    ('descriptive_fields_only', FALSE), ('spec_confirmed', TRUE)) AS v("check", passed)""")
def join_enrichment_checks(t: Tables) -> DataFrame:
    rel = keys.relationship(t.orders, t.lineitem, ORDER_LINES)
    enriched = joins.enrich(t.orders, t.lineitem, ENRICH, ["l_returnflag"], "o", "l")
    amounts = reconcile.reconcile_rows(enriched, t.orders, "o_orderkey", "o__o_orderkey", ["o_totalprice"], "orders")
    bad = reconcile.unbalanced(amounts).agg(F.count(F.lit(1))).scalar()
    types = {"l_returnflag": "text", "l_quantity": "number"}
    return joins.enrichment_checks(t.orders, enriched, rel, bad).unionByName(
        joins.enrichment_validation(rel, ENRICH, ["l_returnflag", "l_quantity"], types))


def _steps() -> list[Step]:
    return [
        Step("lineitem", "orders", JoinSpec((("l_orderkey", "o_orderkey"),)).confirm("one row per line")),
        Step("orders", "customer", JoinSpec((("o_custkey", "c_custkey"),)).confirm("lines with their customer")),
        Step("customer", "nation", JoinSpec((("c_nationkey", "n_nationkey"),)).confirm("lines with their nation")),
    ]


def _chain_tables(t: Tables) -> dict[str, DataFrame]:
    return {"lineitem": t.lineitem, "orders": t.orders.filter("o_orderstatus <> 'P'"), "customer": t.customer,
            "nation": t.nation}


CHAIN_SQL = """FROM lineitem LEFT JOIN (SELECT * FROM orders WHERE o_orderstatus <> 'P') o ON l_orderkey = o_orderkey
    LEFT JOIN customer ON o_custkey = c_custkey LEFT JOIN nation ON c_nationkey = n_nationkey"""


@query("join_steps", "J20 J15", f"""SELECT n_name AS nation__n_name, count(*) AS rows, count(o_orderkey) AS with_order,
    round(sum(l_extendedprice), 2) AS revenue {CHAIN_SQL} GROUP BY n_name""")
def join_steps(t: Tables) -> DataFrame:
    joined = joins.chain(_chain_tables(t), _steps())
    return rounded(joined.groupBy("nation__n_name").agg(
        F.count(F.lit(1)).alias("rows"), F.count_if("matched_1").alias("with_order"),
        F.sum("lineitem__l_extendedprice").alias("revenue")), 2)


@query("join_step_accounting", "J20", f"""WITH c AS (SELECT count(*) AS n, count(o_orderkey) AS a, count(c_custkey) AS b,
      count(n_nationkey) AS d {CHAIN_SQL})
    SELECT CAST(1 AS BIGINT) AS step, 'orders' AS "table", n AS rows_before, n AS rows_after, a AS matched_rows,
      n - a AS unmatched_rows, TRUE AS no_fan_out FROM c
    UNION ALL SELECT 2, 'customer', n, n, b, n - b, TRUE FROM c UNION ALL SELECT 3, 'nation', n, n, d, n - d, TRUE FROM c""")
def join_step_accounting(t: Tables) -> DataFrame:
    return joins.step_accounting(_chain_tables(t), _steps())


@query("join_step_cardinality", "J20 X12", f"""WITH c AS (SELECT count(*) AS n, count(c_custkey) AS b, count(n_nationkey) AS d {CHAIN_SQL})
    SELECT CAST(2 AS BIGINT) AS step, 'N:1' AS cardinality, n AS left_join_rows, b AS inner_join_rows, TRUE AS keeps_rows FROM c
    UNION ALL SELECT 3, 'N:1', n, d, TRUE FROM c""")
def join_step_cardinality(t: Tables) -> DataFrame:
    return joins.intermediate_checks(_chain_tables(t), _steps())


@query("join_lineage", "J15 J16 S13", " UNION ALL ".join([
    _reconcile_sql("orders", "o_totalprice", """SELECT o_totalprice AS v,
      (SELECT count(*) FROM lineitem WHERE l_orderkey = o_orderkey) AS times FROM orders WHERE o_orderstatus <> 'P'"""),
    _reconcile_sql("lineitem", "l_extendedprice", "SELECT l_extendedprice AS v, 1 AS times FROM lineitem"),
]))
def join_lineage(t: Tables) -> DataFrame:
    """Amounts traced through three joins by row: key of the order, file position of the line."""
    tables = _chain_tables(t)
    tables["lineitem"] = reconcile.with_row_number(tables["lineitem"])
    joined = joins.chain(tables, _steps())
    orders = reconcile.reconcile_rows(joined, tables["orders"], "o_orderkey", "orders__o_orderkey", ["o_totalprice"], "orders")
    lines = reconcile.reconcile_rows(joined, tables["lineitem"], "row_ref", "lineitem__row_ref", ["l_extendedprice"],
                                     "lineitem")
    return rounded(orders.unionByName(lines), 2)


@query("join_control_totals", "J25", """
    SELECT 'source' AS scope, count(*) AS rows, count(DISTINCT o_orderkey) AS distinct_entities,
      round(sum(o_totalprice), 2) AS amount FROM orders
    UNION ALL SELECT 'left', count(*), count(DISTINCT o_orderkey), round(sum(o_totalprice), 2)
      FROM orders LEFT JOIN lineitem ON o_orderkey = l_orderkey
    UNION ALL SELECT 'inner', count(*), count(DISTINCT o_orderkey), round(sum(o_totalprice), 2)
      FROM orders JOIN lineitem ON o_orderkey = l_orderkey""")
def join_control_totals(t: Tables) -> DataFrame:
    return rounded(joins.control_totals(t.orders, t.lineitem, ORDER_LINES, "o_orderkey", "o_totalprice"), 2)


@query("join_validated_merge", "J23 J24", """
    WITH items AS (SELECT l_orderkey, sum(l_extendedprice) AS gmv FROM lineitem GROUP BY 1)
    SELECT o_orderkey AS order_id, c_mktsegment AS segment, round(gmv, 2) AS gmv, l_orderkey IS NOT NULL AS has_items
    FROM orders LEFT JOIN items ON o_orderkey = l_orderkey LEFT JOIN customer ON o_custkey = c_custkey""")
def join_validated_merge(t: Tables) -> DataFrame:
    """One-to-one and many-to-one are asserted inside the plan; a violation fails the job."""
    items = t.lineitem.groupBy("l_orderkey").agg(F.sum("l_extendedprice").alias("gmv"))
    orders = keys.assert_unique(t.orders, ["o_orderkey"])
    customers = keys.assert_unique(t.customer, ["c_custkey"])
    merged = orders.join(items, F.col("o_orderkey") == F.col("l_orderkey"), "left").join(
        customers, F.col("o_custkey") == F.col("c_custkey"), "left")
    return merged.select(F.col("o_orderkey").alias("order_id"), F.col("c_mktsegment").alias("segment"),
                         F.round("gmv", 2).alias("gmv"), F.col("l_orderkey").isNotNull().alias("has_items"))
