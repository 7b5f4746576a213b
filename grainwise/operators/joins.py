"""Joins that are confirmed, checked and reconciled before their result is used."""

from __future__ import annotations

from dataclasses import dataclass, field, replace
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from grainwise.functions import cells
from grainwise.operators import keys
from grainwise.operators.metrics import check_rows
from grainwise.session import settled

SALTS = 64
JOIN_TYPES = ("left", "inner")
DESCRIPTIVE = ("text", "mixed", "boolean")


@dataclass(frozen=True)
class JoinSpec:
    """What was agreed about a join: keys, type, cardinality, output grain."""

    on: tuple[tuple[str, str], ...]
    how: str = "left"
    cardinality: str = "N:1"
    grain: str = "left"  # which side one output row stands for
    grain_description: str = ""
    key_meaning_confirmed: bool = False
    relationship_confirmed: bool = False
    grain_confirmed: bool = False
    orphans_acknowledged: bool = False
    expansion_acknowledged: bool = False
    confirmed: bool = False
    versions: tuple[str, str] | None = None  # fingerprints both tables were confirmed on

    @property
    def pairs(self) -> keys.Pairs:
        return list(self.on)

    def confirm(self, grain_description: str) -> JoinSpec:
        return replace(
            self, grain_description=grain_description, key_meaning_confirmed=True, relationship_confirmed=True,
            grain_confirmed=True, orphans_acknowledged=True, expansion_acknowledged=True, confirmed=True,
        )


def recommended_grain(cardinality: Column) -> Column:
    """Side whose rows the output keeps: left for 1:1 and N:1, right for 1:N."""
    return F.when(cardinality.isin("1:1", "N:1"), F.lit("left")).when(cardinality == "1:N", F.lit("right"))


def default_type(cardinality: Column) -> Column:
    return F.when(cardinality == "1:N", F.lit("inner")).otherwise(F.lit("left"))


def measured(left: DataFrame, right: DataFrame, on: keys.Pairs) -> DataFrame:
    """The one-row relationship, computed now, to be shared by the steps of a join."""
    return settled(keys.relationship(left, right, on))


def propose(left: DataFrame, right: DataFrame, on: keys.Pairs, facts: DataFrame | None = None, **settings) -> JoinSpec:
    """Draft spec with the measured cardinality and the defaults that follow from it."""
    rel = measured(left, right, on) if facts is None else facts
    row = rel.select(
        "cardinality", default_type(F.col("cardinality")).alias("how"),
        F.coalesce(recommended_grain(F.col("cardinality")), F.lit("left")).alias("grain"),
    ).first()
    return replace(JoinSpec(tuple(on), row["how"], row["cardinality"], row["grain"]), **settings)


def validation(rel: DataFrame, spec: JoinSpec, versions: tuple[str, str] | None = None) -> DataFrame:
    """(check, passed): every rule a join must satisfy before it may run.

    ``rel`` is the one-row relationship frame, so the rules cost nothing on top
    of the profile.
    """
    measured = F.col("cardinality")
    grain = recommended_grain(measured)
    orphans = (F.col("left_orphan_rows") > 0) | (F.col("right_orphan_rows") > 0)
    mixed_grain = (measured == "1:N") & F.lit(spec.how == "left") & (F.col("left_orphan_rows") > 0)
    return check_rows(rel, [
        ("versions_unchanged", F.lit(spec.versions is None or spec.versions == versions)),
        ("cardinality_as_confirmed", measured == spec.cardinality),
        ("not_many_to_many", measured != "N:N"),
        ("key_meaning_confirmed", F.lit(spec.key_meaning_confirmed)),
        ("relationship_confirmed", F.lit(spec.relationship_confirmed)),
        ("grain_confirmed", F.lit(spec.grain_confirmed and bool(spec.grain_description.strip()))),
        ("orphans_acknowledged", ~orphans | F.lit(spec.orphans_acknowledged)),
        ("expansion_acknowledged", (F.col("expansion") <= 1) | F.lit(spec.expansion_acknowledged)),
        ("grain_kept_by_join", grain.isNull() | (grain == spec.grain)),
        ("no_orphans_in_right_grain", ~mixed_grain),
        ("join_type_supported", F.lit(spec.how in JOIN_TYPES)),
        ("spec_confirmed", F.lit(spec.confirmed)),
    ])


def warnings(rel: DataFrame, spec: JoinSpec) -> DataFrame:
    """(warning, rows): what does not block the join but must be said."""
    l, r = F.col("left_orphan_rows"), F.col("right_orphan_rows")
    notes = [
        ("null_keys", F.col("left_null_rows") + F.col("right_null_rows")),
        ("left_rows_unmatched", l),
        ("right_rows_unmatched", r),
        ("rows_added_by_join", F.col("left_join_rows") - F.col("left_rows")),
        ("left_measures_may_repeat", F.when(F.col("measure_risk"), F.col("left_join_rows")).otherwise(F.lit(0))),
    ]
    if spec.how == "inner":
        notes.append(("rows_dropped_by_inner_join", l + r))
    rows = F.array(*[F.struct(F.lit(n).alias("warning"), c.cast("bigint").alias("rows")) for n, c in notes])
    return rel.select(F.inline(rows)).filter("rows > 0")


class JoinRefused(ValueError):
    """A join rule failed."""


def require_passed(checks: DataFrame, what: str) -> None:
    """Raise naming the failed checks (a handful of rows)."""
    failed = [r["check"] for r in checks.filter(~F.col("passed")).select("check").collect()]
    if failed:
        raise JoinRefused(f"{what}: {', '.join(sorted(failed))}")


def qualified(alias: str, column: str) -> str:
    return f"{alias}__{column}"


def _spread(df: DataFrame) -> Column:
    return (F.pmod(F.xxhash64(*[cells.col(c) for c in df.columns]), F.lit(SALTS)) + 1).cast("tinyint")


def _keyed(df: DataFrame, fields: list[str], tags: list[bool], side: str, spread_nulls: bool, spread: str | None = None) -> DataFrame:
    """Adds normalised keys and, if asked for, a salt.

    Rows with a NULL key match nothing but would all hash to one partition of a
    shuffle join. The salt spreads them; it is a hash of the row, so a retried
    task computes the same one. Without NULL keys it is left out, which keeps a
    table bucketed on a native key co-located. ``spread`` names a column that
    holds the hash already; no other column is kept for its sake.
    """
    parts = keys.key_parts(df, fields, tags)
    out = df.select("*", *[p.alias(f"__{side}{i}") for i, p in enumerate(parts)])
    if not spread_nulls:
        return out
    whole = reduce(lambda a, b: a & b, [F.col(f"__{side}{i}").isNotNull() for i in range(len(parts))])
    salt = _spread(df) if spread is None else F.col(spread)
    return out.withColumn(f"__{side}salt", F.when(whole, F.lit(0).cast("tinyint")).otherwise(salt))


def _same(n: int, left: str, right: str, spread_nulls: bool) -> Column:
    pairs = [F.col(f"{left}{i}") == F.col(f"{right}{i}") for i in range(n)]
    if spread_nulls:
        pairs.append(F.col(f"{left}salt") == F.col(f"{right}salt"))
    return reduce(lambda a, b: a & b, pairs)


def _helpers(n: int, spread_nulls: bool) -> list[str]:
    names = [f"__{s}{i}" for s in "lr" for i in range(n)]
    return names + (["__lsalt", "__rsalt"] if spread_nulls else [])


def attach(
    current: DataFrame, right: DataFrame, left_fields: list[str], right_fields: list[str], how: str, right_alias: str,
    flag: str, tags: list[bool], spread_nulls: bool = True, spread: str | None = None,
) -> DataFrame:
    """Join ``right`` (to be qualified) to a frame of already qualified columns.

    ``flag`` is true on rows that found a partner. Which side is broadcast, if
    any, is left to AQE, which knows the measured sizes.
    """
    n = len(left_fields)
    l = _keyed(current, left_fields, tags, "l", spread_nulls, spread)
    r = _keyed(right, right_fields, tags, "r", spread_nulls)
    added = [c for c in r.columns if c not in right.columns]
    r = r.select(
        *[cells.col(c).alias(qualified(right_alias, c)) for c in right.columns], *added, F.lit(True).alias("__partner")
    )
    joined = l.join(r, _same(n, "__l", "__r", spread_nulls), how)
    return joined.withColumn(flag, F.coalesce("__partner", F.lit(False))).drop(*_helpers(n, spread_nulls), "__partner")


def qualify(df: DataFrame, alias: str) -> DataFrame:
    return df.select(*[cells.col(c).alias(qualified(alias, c)) for c in df.columns])


def equi_join(
    left: DataFrame, right: DataFrame, spec: JoinSpec, left_alias: str, right_alias: str, flag: str = "matched",
    spread_nulls: bool = True,
) -> DataFrame:
    """Left or inner join on normalised keys; columns come out as alias__column."""
    if spec.how not in JOIN_TYPES:
        raise JoinRefused(f"join type must be one of {JOIN_TYPES}")
    lf, rf = [a for a, _ in spec.on], [b for _, b in spec.on]
    keys.check_fields(left, lf)
    keys.check_fields(right, rf)
    tags = keys.type_tags(left, right, spec.pairs)
    return attach(
        qualify(left, left_alias), right, [qualified(left_alias, f) for f in lf], rf, spec.how, right_alias, flag, tags,
        spread_nulls,
    )


def controlled_join(
    left: DataFrame, right: DataFrame, spec: JoinSpec, left_alias: str, right_alias: str,
    versions: tuple[str, str] | None = None, facts: DataFrame | None = None,
) -> DataFrame:
    """The join, refused unless every rule holds on the data as it is now."""
    facts = measured(left, right, spec.pairs) if facts is None else facts
    require_passed(validation(facts, spec, versions), "join not allowed")
    nulls = facts.select("left_null_rows").first()[0] > 0
    return equi_join(left, right, spec, left_alias, right_alias, spread_nulls=nulls)


def preview(left: DataFrame, right: DataFrame, spec: JoinSpec) -> DataFrame:
    """Size of the join without running it, one row."""
    rows = F.col("left_join_rows") if spec.how == "left" else F.col("inner_join_rows")
    return keys.relationship(left, right, spec.pairs).select(
        F.lit(spec.how).alias("how"), "cardinality", rows.alias("output_rows"),
        F.coalesce(cells.safe_divide(rows, F.col("left_rows")), F.lit(0.0)).alias("expansion"),
        "matched_left_rows", "left_orphan_rows", "right_orphan_rows",
    )


def structural_checks(
    joined: DataFrame, rel: DataFrame, spec: JoinSpec, versions: tuple[str, str] | None = None
) -> DataFrame:
    """(check, passed) after the join: cardinality, predicted rows, versions."""
    predicted = F.col("left_join_rows") if spec.how == "left" else F.col("inner_join_rows")
    actual = joined.agg(F.count(F.lit(1))).scalar()
    return check_rows(rel, [
        ("cardinality_stable", F.col("cardinality") == spec.cardinality),
        ("rows_as_previewed", predicted == actual),
        ("not_many_to_many", F.col("cardinality") != "N:N"),
        ("versions_unchanged", F.lit(spec.versions is None or spec.versions == versions)),
    ])


def enrichment_validation(
    rel: DataFrame, spec: JoinSpec, fields: list[str], right_types: dict[str, str],
    versions: tuple[str, str] | None = None,
) -> DataFrame:
    """Rules for adding descriptive right-hand fields without changing the left grain."""
    key_fields = {b for _, b in spec.on}
    usable = [f for f in fields if f not in key_fields and right_types.get(f) in DESCRIPTIVE]
    orphans = (F.col("left_orphan_rows") > 0) | (F.col("right_orphan_rows") > 0)
    return check_rows(rel, [
        ("versions_unchanged", F.lit(spec.versions is None or spec.versions == versions)),
        ("one_to_many", F.col("cardinality") == "1:N"),
        ("left_join", F.lit(spec.how == "left")),
        ("left_grain", F.lit(spec.grain == "left")),
        ("key_meaning_confirmed", F.lit(spec.key_meaning_confirmed)),
        ("relationship_confirmed", F.lit(spec.relationship_confirmed)),
        ("grain_confirmed", F.lit(spec.grain_confirmed and bool(spec.grain_description.strip()))),
        ("orphans_acknowledged", ~orphans | F.lit(spec.orphans_acknowledged)),
        ("expansion_acknowledged", F.lit(spec.expansion_acknowledged)),
        ("some_field", F.lit(bool(fields))),
        ("descriptive_fields_only", F.lit(len(usable) == len(fields))),
        ("spec_confirmed", F.lit(spec.confirmed)),
    ])


LIST_SEPARATOR = "、"


def distinct_lists(right: DataFrame, right_fields: list[str], fields: list[str], tags: list[bool]) -> DataFrame:
    """Per key: each field's distinct values, sorted, as an array.

    Values are made distinct per (key, field, value) first. That shuffle spreads
    a hot key over its values and drops repeats on the map side; only distinct
    values reach the list. Values that differ in case only count as one, shown
    in its first spelling.
    """
    right = cells.normalised(right, [*right_fields, *fields])
    parts = keys.key_parts(right, right_fields, tags)
    kn = [f"k{i}" for i in range(len(parts))]
    entries = [F.struct(F.lit(i).alias("slot"), cells.text(right, f).alias("shown")) for i, f in enumerate(fields)]
    whole = reduce(lambda a, b: a & b, [F.col(k).isNotNull() for k in kn])
    values = (
        right.select(*[p.alias(k) for p, k in zip(parts, kn)], F.inline(F.array(*entries)))
        .filter(whole).distinct()
    )
    # a key whose fields are all missing keeps its row: the NULL entries are dropped by collect_list
    lists = values.groupBy(*kn).agg(*[
        F.collect_list(F.when((F.col("slot") == i) & F.col("shown").isNotNull(),
                              F.struct(F.lower("shown").alias("same"), F.col("shown").alias("shown")))).alias(f"v{i}")
        for i in range(len(fields))
    ])
    return lists.select(*kn, *[_one_spelling(F.array_sort(f"v{i}")).alias(f"v{i}") for i in range(len(fields))])


def _one_spelling(pairs: Column) -> Column:
    """Texts of a list sorted by (lower case, text), the first of each lower case."""
    fresh = F.filter(pairs, lambda p, i: (i == 0) | (p["same"] != F.get(pairs, i - 1)["same"]))
    return F.transform(fresh, lambda p: p["shown"])


def enrich(
    left: DataFrame, right: DataFrame, spec: JoinSpec, fields: list[str], left_alias: str, right_alias: str
) -> DataFrame:
    """Left rows, each with the distinct right-hand values under its key.

    Per field an array column alias__field_values and the joined text
    alias__field_distinct_list (NULL when there is none). The list serves lookup
    and display; a left measure must not be split over its members.
    """
    fields = list(dict.fromkeys(fields))
    cells.require(right, fields)
    rf = [b for _, b in spec.on]
    tags = keys.type_tags(left, right, spec.pairs)
    lists = distinct_lists(right, rf, fields, tags)
    lf = [a for a, _ in spec.on]
    l = qualify(_keyed(left, lf, tags, "l", True), left_alias)
    n = len(lf)
    # lists have one row per complete key; their salt is the one complete keys get
    keyed = lists.withColumn("ksalt", F.when(F.col("k0").isNotNull(), F.lit(0)).otherwise(F.lit(1)))
    joined = l.join(keyed, _same(n, qualified(left_alias, "__l"), "k", True), "left")
    out = [F.col(qualified(left_alias, c)) for c in left.columns]
    for i, f in enumerate(fields):
        values = F.coalesce(F.col(f"v{i}"), F.array().cast("array<string>"))
        out.append(values.alias(qualified(right_alias, f"{f}_values")))
        out.append(
            F.when(F.size(values) > 0, F.array_join(values, LIST_SEPARATOR))
            .alias(qualified(right_alias, f"{f}_distinct_list"))
        )
    out.append(F.col("v0").isNotNull().alias("matched"))
    return joined.select(*out)


def enrichment_checks(left: DataFrame, enriched: DataFrame, rel: DataFrame, unbalanced: Column | None = None) -> DataFrame:
    """(check, passed): rows kept, unmatched rows kept, relationship stable, amounts balanced."""
    counts = enriched.agg(F.count(F.lit(1)).alias("rows"), F.count_if("matched").alias("hits"))
    rows, hits = counts.select("rows").scalar(), counts.select("hits").scalar()
    checks = [
        ("left_grain_kept", F.col("left_rows") == rows),
        ("unmatched_rows_kept", rows - hits == F.col("left_orphan_rows")),
        ("one_to_many_stable", F.col("cardinality") == "1:N"),
    ]
    if unbalanced is not None:
        checks.append(("amounts_balanced", unbalanced == 0))
    return check_rows(rel, checks)


@dataclass(frozen=True)
class Step:
    """Attach ``table`` to the tables joined so far, starting from ``source``."""

    source: str
    table: str
    spec: JoinSpec = field(default_factory=lambda: JoinSpec(()))


def chain(tables: dict[str, DataFrame], steps: list[Step], check: bool = True) -> DataFrame:
    """Several joins in a row; step i sets the flag column matched_i.

    Each step's rules are checked against its source tables before anything
    runs, and the order of the steps must be connected. Rows are hashed once,
    where they are read, so that a join carries no column that the result does not need.
    """
    first = steps[0].source
    included = {first}
    current = qualify(tables[first], first)
    current = current.withColumn("__spread", _spread(current))
    for i, step in enumerate(steps, 1):
        if step.source not in included:
            raise JoinRefused(f"step {i}: {step.source} has not been joined yet")
        if step.table in included:
            raise JoinRefused(f"step {i}: {step.table} is joined already")
        left, right = tables[step.source], tables[step.table]
        if check:
            rel = keys.relationship(left, right, step.spec.pairs)
            require_passed(validation(rel, step.spec), f"step {i} not allowed")
        tags = keys.type_tags(left, right, step.spec.pairs)
        current = attach(
            current, right, [qualified(step.source, a) for a, _ in step.spec.on], [b for _, b in step.spec.on],
            step.spec.how, step.table, f"matched_{i}", tags, spread="__spread",
        )
        included.add(step.table)
    return current.drop("__spread")


def step_accounting(tables: dict[str, DataFrame], steps: list[Step]) -> DataFrame:
    """(step, table, rows_before, rows_after, matched_rows, unmatched_rows, no_fan_out).

    Only join keys are read: every other column is pruned from the scans.
    """
    before = tables[steps[0].source].agg(F.count(F.lit(1))).scalar()
    parts = []
    for i in range(1, len(steps) + 1):
        partial = chain(tables, steps[:i], check=False)
        counts = partial.agg(F.count(F.lit(1)).alias("rows_after"), F.count_if(f"matched_{i}").alias("matched_rows"))
        spec = steps[i - 1].spec
        dimension = F.lit(spec.how == "left" and spec.cardinality in ("1:1", "N:1"))
        parts.append(counts.select(
            F.lit(i).cast("bigint").alias("step"), F.lit(steps[i - 1].table).alias("table"),
            before.alias("rows_before"), "rows_after", "matched_rows",
            (F.col("rows_after") - F.col("matched_rows")).alias("unmatched_rows"),
            (~dimension | (F.col("rows_after") == before)).alias("no_fan_out"),
        ))
        before = counts.select("rows_after").scalar()
    return reduce(DataFrame.unionByName, parts)


def intermediate_checks(tables: dict[str, DataFrame], steps: list[Step]) -> DataFrame:
    """Cardinality of every later step measured on the joined rows, not only on its source."""
    parts = []
    for i in range(2, len(steps) + 1):
        step = steps[i - 1]
        current = chain(tables, steps[: i - 1], check=False)
        on = [(qualified(step.source, a), b) for a, b in step.spec.on]
        rel = keys.relationship(current, tables[step.table], on)
        parts.append(rel.select(
            F.lit(i).cast("bigint").alias("step"), "cardinality", "left_join_rows", "inner_join_rows",
            F.col("right_unique").alias("keeps_rows"),
        ))
    return reduce(DataFrame.unionByName, parts)


def control_totals(left: DataFrame, right: DataFrame, on: keys.Pairs, entity: str, amount: str) -> DataFrame:
    """Rows, distinct entities and amount of the source, its left join and its inner join.

    All three come from one frame of (key, entity) totals joined to the other
    side's key counts; no joined row is materialised.
    """
    tags = keys.type_tags(left, right, on)
    parts = keys.key_parts(left, [a for a, _ in on], tags)
    l = left.groupBy(*parts, cells.identity(left, entity).alias("entity")).agg(
        F.count(F.lit(1)).alias("rows"), F.sum(cells.number(left, amount)).alias("total")
    ).alias("l")
    r = keys.key_counts(right, [b for _, b in on], "right_n", tags).alias("r")
    same = reduce(lambda a, b: a & b, [F.col(f"l.k{i}") == F.col(f"r.k{i}") for i in range(len(on))])
    per_entity = l.join(r, same, "left").groupBy("entity").agg(
        *[
            agg
            for name, times in (("source", F.lit(1)), ("left", F.coalesce("right_n", F.lit(1))),
                                ("inner", F.coalesce("right_n", F.lit(0))))
            for agg in (F.sum(F.col("rows") * times).alias(f"{name}_rows"),
                        F.sum(F.col("total") * times).alias(f"{name}_total"))
        ]
    )
    sums = per_entity.agg(*[
        agg
        for name in ("source", "left", "inner")
        for agg in (F.sum(f"{name}_rows").alias(f"{name}_rows"),
                    F.count_if(F.col("entity").isNotNull() & (F.col(f"{name}_rows") > 0)).alias(f"{name}_entities"),
                    F.sum(F.when(F.col(f"{name}_rows") > 0, F.col(f"{name}_total"))).alias(f"{name}_total"))
    ])
    return sums.select(F.inline(F.array(*[
        F.struct(F.lit(name).alias("scope"), F.col(f"{name}_rows").alias("rows"),
                 F.col(f"{name}_entities").alias("distinct_entities"), F.col(f"{name}_total").alias("amount"))
        for name in ("source", "left", "inner")
    ])))
