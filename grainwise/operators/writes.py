"""Compare-and-set of snapshots: which writes of a log were saved, replayed or refused.

A write names its task, a key of its own and the revision that its writer last saw. In the order of the log it is

* ``replayed`` if its key was saved before for the same task,
* ``conflict`` if its key was saved before for another task, or if the revision it names is not the task's current one,
* ``saved`` otherwise: the task's revision grows by one and the key is recorded. Only a save does either.

Whether a write is saved depends on all saves before it, but only on those of its own task and of tasks that use a key of it. Tasks
linked by shared keys are a group; a group of up to ``alone`` rows is folded row by row, one beside the other, in one pass.

A larger group would be one long chain, so it is cut twice. Within a task the rows are cut into chunks; a chunk is a function from the
revision before it to the one after it, which one backward pass over the chunk gives for every revision that its rows name (any
other revision passes unchanged). Chaining the chunks of a task needs only the entries for revisions that some chunk of the task ends
with. Between tasks only keys that are used more than once matter: who owns them, and from when, is guessed from the first use
and corrected by the saves found, until nothing changes. Every round settles at least the next wrong row of the log, so the result is
that of the fold.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from grainwise.session import scratch_path

SAVED, REPLAYED, CONFLICT = "saved", "replayed", "conflict"


# Rows of a group that one task folds, which holds the keys that the group saved.
ALONE = 500_000
# Rounds of hooking for groups of linked tasks; what is not closed by then is cut into chunks.
HOOKS = 8


def classify_writes(
    log: DataFrame, task: str, write_key: str, revision: str, order: list[str], chunk: Column,
    revisions: DataFrame | None = None, owners: DataFrame | None = None, alone: int = ALONE,
) -> DataFrame:
    """The log with ``current_revision`` (before the write) and ``outcome``.

    ``order`` orders the log totally; ``chunk`` cuts it and must agree with the order (later chunk, later row). ``revisions`` (task,
    revision) and ``owners`` (write_key, task) are what was saved before the log began. A write without a task or a
    revision is a conflict, one without a key is never a replay. Groups of more than ``alone`` rows are folded by chunks.
    """
    kept = _stored(log.select(F.struct(*log.columns).alias("__row"), chunk.alias("__chunk")), "writes")
    row = F.col("__row")
    rows = kept.select("*", *[row[c].alias(n) for c, n in {task: "__task", write_key: "__key", revision: "__based"}.items()],
                       F.struct(*[row[c].alias(c) for c in order]).alias("__at"))
    if owners is not None:
        before = owners.select(F.col(owners.columns[0]).alias("__k"), F.col(owners.columns[1]).alias("__before"))
        rows = _stored(rows.join(before, F.col("__key") == F.col("__k"), "left").drop("__k"), "writes")
    else:
        rows = rows.withColumn("__before", F.lit(None).cast(rows.schema["__task"].dataType))
    starts = None if revisions is None else revisions.select(F.col(revisions.columns[0]).alias("__t"), F.col(revisions.columns[1]).cast("bigint").alias("__start"))
    rows = rows.withColumn("__id", F.xxhash64("__task"))
    groups, crossing = _groups(rows)
    member, group = F.col("__id") == F.col("__m"), F.coalesce("__root", "__id")
    sizes = rows.filter("__task IS NOT NULL").groupBy("__id").agg(F.count("*").alias("n")).join(groups, member, "left").groupBy(group.alias("__g")).agg(F.sum("n").alias("n"))
    large = sizes.filter(F.col("n") > alone).select("__g")
    large = _stored(large if crossing is None else large.union(crossing.select("__g")).distinct(), "large")
    grouped = rows.join(groups, member, "left").withColumn("__g", group).drop("__m", "__root")
    if large.isEmpty():
        return _one_by_one(grouped, starts, task, write_key, order)
    by_chunks = _by_chunks(_stored(grouped.join(large, "__g", "left_semi").select(*rows.columns).drop("__id"), "writes"), starts)
    return by_chunks.unionByName(_one_by_one(grouped.join(large, "__g", "left_anti"), starts, task, write_key, order))


def _groups(rows: DataFrame) -> tuple[DataFrame, DataFrame | None]:
    """(__m, __root) of the linked tasks, by their hashes, and the (__g) of groups that links still cross, if any.

    Two tasks of one hash are only folded together, two keys of one hash only link more tasks.
    """
    uses = rows.filter("__task IS NOT NULL AND __key IS NOT NULL AND __before IS NULL AND __chunk IS NOT NULL").select(F.xxhash64("__key").alias("k"), F.col("__id").alias("b"))
    shared = uses.groupBy("k").agg(F.min("b").alias("a"), F.max("b").alias("z")).filter("a <> z").select(F.col("k").alias("s"), "a")
    links = _stored(uses.join(shared, F.col("k") == F.col("s")).filter("a <> b").select("a", "b").distinct(), "links")
    both = links.union(links.select("b", "a"))
    known = _stored(both.groupBy(F.col("a").alias("__m")).agg(F.least(F.min("b"), F.col("a")).alias("__root")), "groups")
    for n in range(HOOKS + 1):
        near, far = known.select(F.col("__m").alias("a"), F.col("__root").alias("from")), known.select(F.col("__m").alias("b"), F.col("__root").alias("to"))
        crossing = _stored(links.join(near, "a").join(far, "b").filter("from <> to")
                           .select(F.greatest("from", "to").alias("__g"), F.least("from", "to").alias("to")).distinct(), "crossing")
        if crossing.isEmpty():
            return known, None
        if n < HOOKS:  # Every root goes under the smallest one that it meets, and at once under that one's.
            under = _stored(crossing.groupBy("__g").agg(F.min("to").alias("to")), "under")
            above = under.select(F.col("__g").alias("to"), F.col("to").alias("top"))
            under = under.join(above, "to", "left").select("__g", F.coalesce("top", "to").alias("to"))
            known = _stored(known.join(under, F.col("__root") == F.col("__g"), "left").select("__m", F.coalesce("to", "__root").alias("__root")), "groups")
    return known, crossing.select("__g").union(crossing.select("to")).distinct()


def _one_by_one(grouped: DataFrame, starts: DataFrame | None, task: str, write_key: str, order: list[str]) -> DataFrame:
    """The fold of every group, in the order of the log."""
    based = F.when(F.col("__chunk").isNotNull(), F.col("__based")).cast("bigint").alias("__able")
    placed = grouped.select("__g", "__row", "__before", F.col("__chunk").isNotNull().alias("__placed"), based, "__task")
    if starts is None:
        placed = placed.withColumn("__start", F.lit(0).cast("bigint"))
    else:
        placed = placed.join(starts, F.col("__task") == F.col("__t"), "left").withColumn("__start", F.coalesce("__start", F.lit(0).cast("bigint")))
    # Writes without a task wait for nobody and are dealt by themselves.
    alone = F.when(F.col("__task").isNull(), F.xxhash64(*[F.col("__row")[c] for c in order])).otherwise(F.col("__g"))
    by = (placed.withColumn("__g", alone).drop("__t", "__task").repartition("__g")
          .sortWithinPartitions("__g", *[F.col("__row")[c] for c in order]))
    out = T.StructType([T.StructField("__row", grouped.schema["__row"].dataType), T.StructField("current_revision", T.LongType()), T.StructField("outcome", T.StringType())])
    return by.mapInArrow(_replay(task, write_key), out).select("__row.*", "current_revision", "outcome")


def _by_chunks(rows: DataFrame, starts: DataFrame | None) -> DataFrame:
    """The fold of groups of any size: chunks side by side, in rounds until the owners of reused keys are settled."""
    uses = rows.filter("__key IS NOT NULL AND __before IS NULL").groupBy("__key").agg(F.min("__at").alias("from"), F.count("*").alias("n")).filter("n > 1")
    reused = _stored(uses.select(F.col("__key").alias("__k"), "from"), "reused")
    taken = _stored(_owned(rows, reused, F.col("__at") == F.col("from")), "taken")
    folded, fresh = None, rows
    while True:
        blocked = fresh.join(taken, F.col("__key") == F.col("__k"), "left").withColumn(
            "__owner", F.coalesce("__before", F.when(F.col("__at") > F.col("__from"), F.col("__by")))).drop("__k", "__from", "__by")
        again = _fold(blocked, starts)
        folded = _stored(again if folded is None else folded.join(tasks, F.col("__task") == F.col("__t"), "left_anti").unionByName(again), "folded")
        found = _stored(_owned(folded, reused, F.col("__saved")), "taken")
        # Only tasks that use a key whose owner turned out to be another, or to own it from another row on, are folded again.
        moved = rows.join(_changed(taken, found), F.col("__key") == F.col("k"), "left_semi")
        tasks = _stored(moved.select(F.col("__task").alias("__t")).distinct(), "tasks")
        if tasks.isEmpty():
            break
        taken, fresh = found, rows.join(tasks, F.col("__task") == F.col("__t"), "left_semi")
    outcome = (F.when(F.col("__owner").isNull(), F.when(F.col("__saved"), F.lit(SAVED)).otherwise(F.lit(CONFLICT)))
               .when(F.col("__owner") == F.col("__task"), F.lit(REPLAYED)).otherwise(F.lit(CONFLICT)))
    return folded.select("__row.*", F.col("__current").alias("current_revision"), outcome.alias("outcome"))


def latest_snapshots(writes: DataFrame, task: str, revision: str, columns: list[str]) -> DataFrame:
    """The newest saved snapshot of each task: an aggregate, never a sort per task."""
    picked = F.max_by(F.struct(*[F.col(c) for c in columns]), F.col(revision)).alias("s")
    return (
        writes.filter(F.col("outcome") == SAVED).groupBy(task)
        .agg((F.max(revision) + 1).cast("bigint").alias("stored_revision"), picked)
        .select(task, "stored_revision", "s.*")
    )


def _stored(df: DataFrame, name: str) -> DataFrame:
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def _owned(rows: DataFrame, reused: DataFrame, where: Column) -> DataFrame:
    """(__k, __from, __by): of the keys used more than once, the first row that meets the condition and its task."""
    met = rows.join(reused, F.col("__key") == F.col("__k")).filter(where & F.col("__task").isNotNull())
    return met.groupBy("__k").agg(F.min("__at").alias("__from"), F.min_by("__task", "__at").alias("__by"))


def _changed(a: DataFrame, b: DataFrame) -> DataFrame:
    """The keys that the two say something else about."""
    other = b.select(F.col("__k").alias("k2"), F.col("__from").alias("f2"))
    return a.join(other, F.col("__k") == F.col("k2"), "full").filter("NOT __from <=> f2").select(F.coalesce("__k", "k2").alias("k"))


def _fold(rows: DataFrame, starts: DataFrame | None) -> DataFrame:
    """The rows with the revision before each and whether it was saved."""
    if starts is None:
        rows = rows.withColumn("__start", F.lit(0).cast("bigint"))
    else:
        rows = rows.join(starts, F.col("__task") == F.col("__t"), "left").drop("__t").withColumn("__start", F.coalesce("__start", F.lit(0).cast("bigint")))
    able = F.when(F.col("__owner").isNull(), F.col("__based")).cast("bigint").alias("__able")
    placed = rows.filter("__task IS NOT NULL AND __chunk IS NOT NULL")
    sorted_rows = placed.select("__task", "__chunk", "__at", "__start", able).repartition("__task", "__chunk").sortWithinPartitions("__task", "__chunk", "__at")
    kinds = {f.name: f.dataType for f in placed.schema.fields}
    schema = T.StructType([T.StructField("__task", kinds["__task"]), T.StructField("__chunk", kinds["__chunk"]), T.StructField("__start", T.LongType()),
                           T.StructField("named", T.LongType()), T.StructField("then", T.LongType())])
    steps = _stored(sorted_rows.mapInArrow(_functions(), schema), "steps")
    # The revision before a chunk is the task's first one, or one that an earlier chunk ended with.
    ends = steps.select(F.col("__task").alias("t"), F.col("then").alias("v")).distinct()
    reachable = steps.join(ends, (F.col("__task") == F.col("t")) & (F.col("named") == F.col("v")), "left").filter("t IS NOT NULL OR named = __start OR named IS NULL").drop("t", "v")
    chained = reachable.repartition("__task").sortWithinPartitions("__task", "__chunk", "named").mapInArrow(_chain(), T.StructType([*schema.fields[:2], T.StructField("__entry", T.LongType())]))
    entries = _stored(chained.select(F.col("__task").alias("t"), F.col("__chunk").alias("c"), "__entry"), "entries")
    full = (placed.join(entries, (F.col("__task") == F.col("t")) & (F.col("__chunk") == F.col("c"))).drop("t", "c").select("*", able)
            .repartition("__task", "__chunk").sortWithinPartitions("__task", "__chunk", "__at"))
    out = T.StructType([*rows.schema.fields, T.StructField("__current", T.LongType()), T.StructField("__saved", T.BooleanType())])
    done = full.select(*rows.columns, "__entry", "__able").mapInArrow(_advance(), out)
    apart = rows.filter("__task IS NULL OR __chunk IS NULL").withColumns({"__current": F.lit(None).cast("bigint"), "__saved": F.lit(False)})
    return done.unionByName(apart)


def _functions():
    """Per (task, chunk): the revision after the chunk for every revision that one of its rows can save; one row without any says the chunk is there."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[int | None] = []
        last = None

        def out() -> pa.RecordBatch:
            then: dict[int, int] = {}
            for v in reversed(held):
                if v is not None:
                    then[v] = then.get(v + 1, v + 1)
            n = 1 + len(then)
            return pa.RecordBatch.from_arrays([pa.array([last[0]] * n, kinds[0]), pa.array([last[1]] * n, kinds[1]), pa.array([last[2]] * n, pa.int64()),
                                               pa.array([None, *then], pa.int64()), pa.array([None, *then.values()], pa.int64())],
                                              names=["__task", "__chunk", "__start", "named", "then"])
        for batch in batches:
            kinds = [batch.column(n).type for n in ("__task", "__chunk")]
            for task, chunk, start, able in zip(*(batch.column(n).to_pylist() for n in ("__task", "__chunk", "__start", "__able")), strict=True):
                if last is None or (task, chunk) != last[:2]:
                    if last is not None:
                        yield out()
                    held, last = [], (task, chunk, start)
                held.append(able)
        if last is not None:
            yield out()
    return run


def _chain():
    """The revision before every chunk of a task, from the sorted functions of its chunks."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task = chunk = now = entry = None
        for batch in batches:
            out = []
            for t, c, start, named, then in zip(*(batch.column(n).to_pylist() for n in ("__task", "__chunk", "__start", "named", "then")), strict=True):
                if t != task:
                    task, now = t, start
                if named is None:
                    chunk, entry = c, now
                    out.append((t, c, now))
                elif c == chunk and named == entry:
                    now = then
            yield pa.RecordBatch.from_arrays([pa.array([o[0] for o in out], batch.column("__task").type), pa.array([o[1] for o in out], batch.column("__chunk").type),
                                              pa.array([o[2] for o in out], pa.int64())], names=["__task", "__chunk", "__entry"])
    return run


def _advance():
    """The fold itself, from the revision before each chunk."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last = now = None
        for batch in batches:
            before, saved = [], []
            for task, chunk, entry, able in zip(*(batch.column(n).to_pylist() for n in ("__task", "__chunk", "__entry", "__able")), strict=True):
                if (task, chunk) != last:
                    last, now = (task, chunk), entry
                before.append(now)
                saved.append(able == now)
                now += able == now
            names = [n for n in batch.schema.names if n not in ("__entry", "__able")]
            yield pa.RecordBatch.from_arrays([*(batch.column(n) for n in names), pa.array(before, pa.int64()), pa.array(saved)], names=[*names, "__current", "__saved"])
    return run


def _replay(task: str, write_key: str):
    """Row after row of a group: the revision of each of its tasks and who saved which key."""
    def plain(column: pa.Array) -> list:
        values = column.to_pylist()
        return [None if v is None else repr(v) for v in values] if pa.types.is_nested(column.type) else values

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, now, saved = None, {}, {}
        for batch in batches:
            rows = batch.column("__row")
            current, told = [], []
            columns = [plain(c) for c in (rows.field(task), rows.field(write_key), batch.column("__before"))]
            for group, t, key, before, able, start, placed in zip(
                    batch.column("__g").to_pylist(), *columns, *(batch.column(n).to_pylist() for n in ("__able", "__start", "__placed")), strict=True):
                if group != last:
                    last, now, saved = group, {}, {}
                if t is None:
                    current.append(None)
                    told.append(CONFLICT)
                    continue
                revision = now.get(t, start)
                owner = saved.get(key) if before is None else before
                current.append(revision if placed else None)
                if owner is not None:
                    told.append(REPLAYED if owner == t else CONFLICT)
                elif able is not None and able == revision:
                    now[t] = revision + 1
                    if key is not None:
                        saved[key] = t
                    told.append(SAVED)
                else:
                    told.append(CONFLICT)
            yield pa.RecordBatch.from_arrays([rows, pa.array(current, pa.int64()), pa.array(told, pa.string())], names=["__row", "current_revision", "outcome"])
    return run
