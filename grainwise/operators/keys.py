"""Key profiles, relationship profiles, orphan keys and join candidates.

Everything here works on per-key row counts, combined on the map side. Two
tables are compared by joining their count frames (one row per key), never
their rows, so the size of a join is known before it is run and a hot key is
one row.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from grainwise.functions import cells

# Fixed value: names preferred as join keys.
KEY_NAME = r"(?i)id|key|code|no|number|编号|编码|单号"

Pairs = list[tuple[str, str]]


def check_fields(df: DataFrame, fields: list[str]) -> None:
    if not fields:
        raise ValueError("a key has one field, or two that form a composite key")
    if len(set(fields)) != len(fields):
        raise ValueError("a composite key cannot repeat a field")
    cells.require(df, fields)


def key_parts(df: DataFrame, fields: list[str], tags: list[bool] | None = None) -> list[Column]:
    """Normalised key columns k0, k1: trimmed, case-insensitive, NULL when missing.

    A tagged part is text prefixed with its type, so that the text '1' and the
    number 1 stay different keys instead of being cast to one another.
    """
    parts = []
    for i, name in enumerate(fields):
        part = cells.key_part(df, name)
        if tags and tags[i]:
            part = F.concat(F.lit(cells.family(df, name) + ":"), part.cast("string"))
        parts.append(part.alias(f"k{i}"))
    return parts


def type_tags(left: DataFrame, right: DataFrame, on: Pairs) -> list[bool]:
    return [cells.family(left, a) != cells.family(right, b) for a, b in on]


def _complete(n: int) -> Column:
    return reduce(lambda a, b: a & b, [F.col(f"k{i}").isNotNull() for i in range(n)])


def key_counts(
    df: DataFrame, fields: list[str], count: str = "n", tags: list[bool] | None = None, extra: list[Column] | None = None
) -> DataFrame:
    """One row per key: its row count (and ``extra`` aggregates). NULL parts stay."""
    check_fields(df, fields)
    parts = key_parts(df, fields, tags)
    return df.groupBy(*parts).agg(F.count(F.lit(1)).alias(count), *(extra or []))


def key_profile(df: DataFrame, fields: list[str]) -> DataFrame:
    """One row: rows, NULL-key rows, distinct and duplicated keys, uniqueness.

    A single NULL key already makes the key not unique.
    """
    whole, n = _complete(len(fields)), F.col("n")
    return key_counts(df, fields).agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("rows"),
        F.coalesce(F.sum(F.when(~whole, n)), F.lit(0)).alias("null_rows"),
        F.count_if(whole).alias("distinct_keys"),
        F.count_if(whole & (n > 1)).alias("duplicated_keys"),
        F.coalesce(F.sum(F.when(whole & (n > 1), n)), F.lit(0)).alias("rows_in_duplicated_keys"),
    ).withColumn("unique", (F.col("null_rows") == 0) & (F.col("distinct_keys") == F.col("rows")))


def assert_unique(df: DataFrame, fields: list[str]) -> DataFrame:
    """The frame itself, failing the job when a key occurs twice.

    The check is part of the plan: the profile is a scalar subquery guarded by
    ``assert_true`` and evaluated once per query.
    """
    ok = key_profile(df, fields).select("unique").scalar()
    message = f"key {', '.join(fields)} is not unique"
    return df.filter(F.assert_true(ok, message).isNull())


def matched_counts(left: DataFrame, right: DataFrame, on: Pairs) -> DataFrame:
    """One row per key of either side with both row counts (NULL where absent)."""
    tags = type_tags(left, right, on)
    l = key_counts(left, [a for a, _ in on], "left_n", tags).alias("l")
    r = key_counts(right, [b for _, b in on], "right_n", tags).alias("r")
    same = reduce(lambda a, b: a & b, [F.col(f"l.k{i}") == F.col(f"r.k{i}") for i in range(len(on))])
    keys = [F.coalesce(F.col(f"l.k{i}"), F.col(f"r.k{i}")).alias(f"k{i}") for i in range(len(on))]
    return l.join(r, same, "full_outer").select(*keys, "left_n", "right_n")


def relationship(left: DataFrame, right: DataFrame, on: Pairs) -> DataFrame:
    """One row: cardinality, coverage, orphans and the size of the join."""
    counts = matched_counts(left, right, on)
    return _judged(counts.agg(*_facts(_complete(len(on)), F.col("left_n"), F.col("right_n"))))


def _facts(whole: Column, l: Column, r: Column) -> list[Column]:
    """Aggregates over rows with the row counts of one key on both sides; a key that is not whole matches nothing."""
    both = whole & l.isNotNull() & r.isNotNull()

    def total(value: Column, where: Column) -> Column:
        return F.coalesce(F.sum(F.when(where, value)), F.lit(0)).cast("bigint")

    return [
        total(l, F.lit(True)).alias("left_rows"),
        total(r, F.lit(True)).alias("right_rows"),
        total(l, ~whole).alias("left_null_rows"),
        total(r, ~whole).alias("right_null_rows"),
        (F.count_if(whole & (l > 1)) + F.count_if(~whole & l.isNotNull()) == 0).alias("left_unique"),
        (F.count_if(whole & (r > 1)) + F.count_if(~whole & r.isNotNull()) == 0).alias("right_unique"),
        total(l, both).alias("matched_left_rows"),
        total(r, both).alias("matched_right_rows"),
        total(l, ~whole | r.isNull()).alias("left_orphan_rows"),
        total(r, ~whole | l.isNull()).alias("right_orphan_rows"),
        F.count_if(whole & r.isNull()).alias("left_orphan_keys"),
        F.count_if(whole & l.isNull()).alias("right_orphan_keys"),
        total(l * F.when(both, r).otherwise(F.lit(1)), l.isNotNull()).alias("left_join_rows"),
        total(l * r, both).alias("inner_join_rows"),
    ]


def _judged(facts: DataFrame) -> DataFrame:
    zero = F.lit(0.0)
    return (
        facts.withColumn("cardinality", cardinality(F.col("left_unique"), F.col("right_unique")))
        .withColumn("left_coverage", F.coalesce(cells.safe_divide(F.col("matched_left_rows"), F.col("left_rows")), zero))
        .withColumn(
            "right_coverage", F.coalesce(cells.safe_divide(F.col("matched_right_rows"), F.col("right_rows")), zero))
        .withColumn("expansion", F.coalesce(cells.safe_divide(F.col("left_join_rows"), F.col("left_rows")), zero))
        .withColumn("measure_risk", F.col("cardinality").isin("1:N", "N:N"))
        .withColumn("blocked", F.col("cardinality") == "N:N")
    )


def cardinality(left_unique: Column, right_unique: Column) -> Column:
    return (
        F.when(left_unique & right_unique, F.lit("1:1")).when(left_unique, F.lit("1:N"))
        .when(right_unique, F.lit("N:1")).otherwise(F.lit("N:N"))
    )


def orphan_keys(left: DataFrame, right: DataFrame, on: Pairs) -> DataFrame:
    """Every key present on one side only, with its rows; NULL keys are not keys."""
    side = F.when(F.col("right_n").isNull(), F.lit("left")).otherwise(F.lit("right"))
    return (
        matched_counts(left, right, on)
        .filter(_complete(len(on)) & (F.col("left_n").isNull() | F.col("right_n").isNull()))
        .select(*[f"k{i}" for i in range(len(on))], side.alias("side"), F.coalesce("left_n", "right_n").alias("rows"))
    )


def shown_key(n: int) -> Column:
    return F.concat_ws(" + ", *[F.col(f"k{i}").cast("string") for i in range(n)])


def key_samples(left: DataFrame, right: DataFrame, on: Pairs, n: int = 3) -> DataFrame:
    """The first n matched, left-only and right-only keys, in text order.

    Which sides have a key is one number per key, so keys are neither counted nor joined: one aggregate, one row per key and side
    shuffled by each task, nothing sorted.
    """
    tags = type_tags(left, right, on)
    sides = [
        df.select(*[p.alias(f"k{i}") for i, p in enumerate(key_parts(df, fields, tags))], F.lit(bit).alias("side")).filter(_complete(len(on)))
        for df, fields, bit in ((left, [a for a, _ in on], 1), (right, [b for _, b in on], 2))
    ]
    check_fields(left, [a for a, _ in on])
    check_fields(right, [b for _, b in on])
    seen = sides[0].unionByName(sides[1]).groupBy(*[f"k{i}" for i in range(len(on))]).agg(F.bit_or("side").alias("sides"))
    parts = [
        seen.filter(F.col("sides") == bits).select(F.lit(kind).alias("kind"), shown_key(len(on)).alias("key")).orderBy("key").limit(n)
        for kind, bits in (("matched", 3), ("left_orphan", 1), ("right_orphan", 2))
    ]
    return reduce(DataFrame.unionByName, parts)


def normal_name(name: str) -> str:
    return re.sub(r"[\s_-]+", "", name.strip().lower())


def _comparable(a: str | None, b: str | None) -> bool:
    return a == b or {a, b} <= {"text", "mixed"}


def candidate_pairs(
    left: DataFrame,
    right: DataFrame,
    same: Callable[[str], str] = normal_name,
    left_types: dict[str, str] | None = None,
    right_types: dict[str, str] | None = None,
) -> tuple[Pairs, list[Pairs]]:
    """(single-field pairs, two-field pairs) with matching names and types.

    Types come from a profile when given, from the schema otherwise. Names that
    read as keys are preferred; without one, every common name is a candidate.
    """
    lt = left_types or {n: cells.family(left, n) for n in left.columns}
    rt = right_types or {n: cells.family(right, n) for n in right.columns}
    common = [(a, b) for a in left.columns for b in right.columns if same(a) == same(b) and _comparable(lt[a], rt[b])]
    named = [(a, b) for a, b in common if re.search(KEY_NAME, a) or re.search(KEY_NAME, b)]
    composite = [[named[i], named[j]] for i in range(len(named)) for j in range(i + 1, len(named))]
    return named or common, composite


def _compared_as(left: DataFrame, a: str, right: DataFrame, b: str) -> str:
    """Type in which two columns are compared as keys: text, tagged text (other families), nested values, or a SQL type."""
    kinds = cells.family(left, a), cells.family(right, b)
    if kinds[0] != kinds[1]:
        return "tagged"
    if kinds[0] in ("text", "other"):
        return kinds[0]
    both = left.select(cells.col(a).alias("k")).union(right.select(cells.col(b).alias("k")))
    common = both.schema["k"].dataType
    return "bigint" if isinstance(common, T.IntegralType) else common.simpleString()


def _as_text(df: DataFrame, name: str, kind: str) -> Column:
    """A key part as text: two parts have the same text just if they are equal in the type they are compared in."""
    part = cells.key_part(df, name)
    if kind == "text":
        return part
    if kind == "tagged":
        return F.concat(F.lit(cells.family(df, name) + ":"), part.cast("string"))
    if kind == "other":
        return F.when(part.isNotNull(), F.to_json(F.struct(part.alias("k"))))
    part = part.cast(kind)
    if kind in ("double", "float"):
        part = part.cast("double") + F.lit(0.0)
    return (F.unix_micros(part) if kind == "timestamp" else part).cast("string")


def relationships(tables: dict[str, DataFrame], wanted: list[tuple[str, str, Pairs]]) -> DataFrame:
    """What ``relationship`` says of many pairs of fields, one row each, from one scan of every table.

    Each table is unpivoted to rows (field list, key) and folded to counts in its tasks; the counts of a key meet in one
    row, from which every pair that knows the key gets its two counts. Shuffled are distinct keys per field list; a row
    of a key holds one count per field list.
    """
    sides: dict[tuple, int] = {}
    pairs = []
    for a, b, on in wanted:
        kinds = tuple(_compared_as(tables[a], x, tables[b], y) for x, y in on)
        ends = ((a, tuple(x for x, _ in on)), (b, tuple(y for _, y in on)))
        pairs.append([sides.setdefault((*end, kinds), len(sides)) for end in ends])
    unpivoted = []
    for name, df in tables.items():
        own = [
            F.struct(F.lit(side).alias("side"), F.array(*[_as_text(df, f, k) for f, k in zip(fields, kinds, strict=True)]).alias("key"))
            for (table, fields, kinds), side in sides.items() if table == name
        ]
        if own:
            unpivoted.append(df.select(F.inline(F.array(*own))))
    seen = (
        reduce(DataFrame.unionAll, unpivoted).groupBy("key", "side").agg(F.count(F.lit(1)).alias("n"))
        .groupBy("key").agg(F.map_from_entries(F.collect_list(F.struct("side", "n"))).alias("counts"))
    )
    listed = F.array(*[
        F.struct(F.lit(i).alias("pair"), F.lit(l).alias("l"), F.lit(r).alias("r")) for i, (l, r) in enumerate(pairs)])
    known = F.filter(listed, lambda p: F.map_contains_key("counts", p["l"]) | F.map_contains_key("counts", p["r"]))
    counted = seen.select(F.forall("key", lambda k: k.isNotNull()).alias("whole"), "counts", F.inline(known)).select(
        "pair", "whole", F.try_element_at("counts", "l").alias("l"), F.try_element_at("counts", "r").alias("r"))
    # A row without counts per pair, so that pairs of empty tables are listed as well.
    nothing = F.lit(None).cast("bigint")
    blank = seen.sparkSession.range(len(pairs)).select(F.col("id").cast("int"), F.lit(False), nothing, nothing)
    facts = counted.unionAll(blank).groupBy("pair").agg(*_facts(F.col("whole"), F.col("l"), F.col("r")))
    names = F.array(*[
        F.struct(F.lit(a).alias("left_table"), F.lit(b).alias("right_table"), F.lit("+".join(x for x, _ in on)).alias("left_fields"),
                 F.lit("+".join(y for _, y in on)).alias("right_fields"), F.lit(len(on)).alias("width")) for a, b, on in wanted])
    return _judged(facts.select(F.get(names, F.col("pair")).alias("of"), *facts.columns).select("of.*", *facts.columns).drop("pair"))


def join_candidates(tables: dict[str, DataFrame], same: Callable[[str], str] = normal_name) -> DataFrame | None:
    """Every plausible relationship between the tables, best first; one scan per table.

    The score is the number of orphan rows, plus ten for a many-to-many pair. A
    composite pair is kept only when it is unique on one side.
    """
    wanted = []
    names = list(tables)
    for i, a in enumerate(names):
        for b in names[i + 1:]:
            singles, composites = candidate_pairs(tables[a], tables[b], same)
            wanted += [(a, b, on) for on in ([[pair] for pair in singles] + composites)]
    if not wanted:
        return None
    penalty = F.when(F.col("blocked"), F.lit(10)).otherwise(F.lit(0))
    return (
        relationships(tables, wanted)
        .filter((F.col("width") == 1) | F.col("left_unique") | F.col("right_unique")).drop("width")
        .withColumn("score", (penalty + F.col("left_orphan_rows") + F.col("right_orphan_rows")).cast("bigint"))
        .orderBy("score", "left_table", "right_table", "left_fields")
    )


def bridge_candidates(
    included: dict[str, DataFrame], third_name: str, third: DataFrame, same: Callable[[str], str] = normal_name
) -> DataFrame | None:
    """How a third table can be attached to tables already joined, best first; one scan per table."""
    wanted = [(name, third_name, [(a, b)]) for name, table in included.items()
              for a in table.columns for b in third.columns if same(a) == same(b)]
    if not wanted:
        return None
    penalty = F.when(F.col("blocked"), F.lit(100)).otherwise(F.lit(0))
    score = penalty + F.col("left_orphan_rows") + F.col("right_orphan_rows") - F.col("left_coverage")
    found = relationships(included | {third_name: third}, wanted).drop("width")
    return found.withColumn("score", score.cast("double")).orderBy("score", "left_table", "left_fields")
