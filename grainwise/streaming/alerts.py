"""Service alerts: one notification per incident, update and recovery.

The rules, per service and in order of its monitoring cycles:

* the monitor itself failing twice in a row opens a P1 incident;
* an unreachable site opens a P1 incident, or raises an open P2 one;
* active error keys open a P2 incident; only keys that were not active in the
  last successful cycle make an update;
* a healthy cycle closes an open incident with one recovery.

``batch`` states this with windows over monitoring cycles, ``stream`` applies it to every micro-batch of a stream. A cycle is
one row whatever the traffic. Of the cycles of earlier micro-batches a stream keeps only those that later ones depend on:
at most four per service.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

FAILURES_TO_ALERT = 2


def batch(cycles: DataFrame, errors: DataFrame) -> DataFrame:
    """Alert state and notification of every cycle.

    ``cycles``: service, cycle, monitor_ok, site_ok - one row per cycle.
    ``errors``: service, cycle, key - the error keys active in a cycle. Keys stay
    rows: which ones are new is an anti-join with the previous successful cycle,
    so an hour with a million errors is never one array.
    """
    return _told(_facts(cycles.withColumn("weight", F.lit(1)), errors))


def _facts(cycles: DataFrame, errors: DataFrame) -> DataFrame:
    """What happened in every cycle. A failed cycle counts for ``weight`` failures in a row."""
    by_service = Window.partitionBy("service").orderBy("cycle")
    earlier = by_service.rowsBetween(Window.unboundedPreceding, -1)
    seen = cycles.withColumn(
        "previous_ok", F.last(F.when(F.col("monitor_ok"), F.col("cycle")), ignorenulls=True).over(earlier)
    )
    keys = errors.select("service", "cycle", "key").distinct()
    now = keys.join(seen.filter("monitor_ok").select("service", "cycle", "previous_ok"), ["service", "cycle"])
    before = keys.select(F.col("service").alias("s"), F.col("cycle").alias("c"), F.col("key").alias("k"))
    fresh = now.join(
        before, (F.col("service") == F.col("s")) & (F.col("previous_ok") == F.col("c")) & (F.col("key") == F.col("k")),
        "left",
    )
    per_cycle = fresh.groupBy("service", "cycle").agg(
        F.count(F.lit(1)).alias("active_keys"), F.count_if(F.col("k").isNull()).alias("new_keys")
    )
    facts = seen.join(per_cycle, ["service", "cycle"], "left").withColumns({
        "active_keys": F.coalesce("active_keys", F.lit(0)), "new_keys": F.coalesce("new_keys", F.lit(0)),
    })
    ok, site = F.col("monitor_ok"), F.col("site_ok")
    facts = facts.withColumns({
        "kind": F.when(~ok, F.lit("monitor_failed")).when(~site, F.lit("site_down"))
        .when(F.col("active_keys") > 0, F.lit("errors")).otherwise(F.lit("healthy")),
        # cycles since the monitor last worked, this one included
        "run": F.sum(ok.cast("int")).over(by_service.rowsBetween(Window.unboundedPreceding, 0)),
    })
    in_run = Window.partitionBy("service", "run").orderBy("cycle").rowsBetween(Window.unboundedPreceding, 0)
    kind = F.col("kind")
    facts = facts.withColumns({
        "failures": F.sum(F.when(kind == "monitor_failed", F.col("weight")).otherwise(0)).over(in_run),
        # every healthy cycle starts a new episode after it
        "episode": F.coalesce(F.sum((kind == "healthy").cast("int")).over(earlier), F.lit(0)),
    })
    trigger = (
        F.when((kind == "monitor_failed") & (F.col("failures") >= FAILURES_TO_ALERT), F.lit("monitor"))
        .when(kind == "site_down", F.lit("site")).when(kind == "errors", F.lit("errors"))
    )
    return facts.withColumn("trigger", trigger)


def _told(facts: DataFrame) -> DataFrame:
    """State and notification of every cycle from what happened since the last healthy one."""
    kind = F.col("kind")
    episode = Window.partitionBy("service", "episode").orderBy("cycle").rowsBetween(Window.unboundedPreceding, -1)
    facts = facts.withColumns({
        "first_trigger": F.first("trigger", ignorenulls=True).over(episode),
        "site_before": F.max((F.col("trigger") == "site").cast("int")).over(episode),
    })
    degraded = F.col("first_trigger").isNotNull()
    severe = (F.coalesce("site_before", F.lit(0)) == 1) | F.coalesce(F.col("first_trigger") == "monitor", F.lit(False))
    severity_before = F.when(degraded, F.when(severe, F.lit("P1")).otherwise(F.lit("P2")))
    opened = F.when(degraded, F.lit("failure_update")).otherwise(F.lit("failure"))
    monitor_alarm = (F.col("trigger") == "monitor") & ~degraded
    site_alarm = (kind == "site_down") & (~degraded | ~severe)
    error_alarm = (kind == "errors") & (~degraded | (F.col("new_keys") > 0))
    recovered = (kind == "healthy") & degraded
    return facts.select(
        "service", "cycle", "kind", F.col("active_keys"), F.col("new_keys"),
        F.when(kind == "monitor_failed", F.col("failures")).otherwise(F.lit(0)).cast("bigint").alias("failures"),
        F.when(kind == "healthy", F.lit("healthy")).when(degraded | F.col("trigger").isNotNull(), F.lit("degraded"))
        .otherwise(F.lit("healthy")).alias("phase"),
        F.when(monitor_alarm, F.lit("failure")).when(site_alarm | error_alarm, opened)
        .when(recovered, F.lit("recovery")).alias("notification"),
        F.when(monitor_alarm | site_alarm, F.lit("P1")).when(error_alarm, F.lit("P2"))
        .when(recovered, severity_before).alias("severity"),
        F.when(monitor_alarm, F.lit("monitor_failed_twice")).when(site_alarm, F.lit("site_unavailable"))
        .when(error_alarm, F.lit("worker_error")).when(recovered, F.lit("site_healthy_no_active_errors")).alias("reason"),
    )


def _kept(facts: DataFrame) -> DataFrame:
    """The cycles that later ones depend on: the last successful one, a failure at the end, and of the open incident its first cause and
    the first time the site was down. A failed cycle stands for the failures of its run that are not kept."""
    healthy = (F.col("kind") == "healthy").cast("int")
    ends = facts.groupBy("service").agg(F.sum(healthy).alias("open"), F.max("cycle").alias("last"), F.max(F.when(F.col("monitor_ok"), F.col("cycle"))).alias("last_ok"))
    now = facts.join(ends, "service")
    mine = F.col("episode") == F.col("open")
    firsts = now.filter(mine).groupBy("service").agg(F.min(F.when(F.col("trigger").isNotNull(), F.col("cycle"))).alias("opener"),
                                                     F.min(F.when(F.col("trigger") == "site", F.col("cycle"))).alias("site"))
    named = now.join(firsts, "service", "left")
    at = F.col("cycle")
    kept = named.filter(at.eqNullSafe(F.col("last_ok")) | at.eqNullSafe(F.col("opener")) | at.eqNullSafe(F.col("site"))
                        | ((at == F.col("last")) & ~F.col("monitor_ok")))
    run = Window.partitionBy("service", "run").orderBy("cycle")
    before = F.coalesce(F.lag("failures").over(run), F.lit(0))
    return kept.select("service", "cycle", "monitor_ok", "site_ok", (at == F.col("last_ok")).alias("whole"),
                       F.when(F.col("kind") == "monitor_failed", F.col("failures") - before).otherwise(1).cast("int").alias("weight"))


def stream(observations: DataFrame, sink: Callable[[DataFrame, int], None], state: str, checkpoint: str) -> StreamingQuery:
    """The same rules over a stream of service, cycle, monitor_ok, site_ok, keys array<string>; the cycles of a service come in order.

    ``state`` is a folder that all executors share. It holds two snapshots of the kept cycles and their keys: micro-batch n reads
    the one of n - 1 and overwrites the one of n - 2, so a retry gives the same. Of a kept cycle that is not the last
    successful one, one key is enough.
    """
    def advance(fresh: DataFrame, number: int) -> None:
        spark = fresh.sparkSession
        new = _written(fresh, f"{state}/new-{number % 2}")
        keyed = new.select("service", "cycle", F.explode("keys").alias("key")).distinct()
        cycles = new.select("service", "cycle", "monitor_ok", "site_ok", F.lit(1).alias("weight"))
        errors = keyed
        if number > 0:
            cycles = cycles.unionByName(spark.read.parquet(f"{state}/cycles-{(number - 1) % 2}"))
            errors = errors.unionByName(spark.read.parquet(f"{state}/errors-{(number - 1) % 2}"))
        facts = _written(_facts(cycles, errors), f"{state}/facts-{number % 2}")
        kept = _kept(facts)
        _written(kept.drop("whole"), f"{state}/cycles-{number % 2}")
        known = errors.join(kept.select("service", "cycle", "whole"), ["service", "cycle"])
        one = known.filter("NOT whole").groupBy("service", "cycle").agg(F.min("key").alias("key"))
        _written(known.filter("whole").select("service", "cycle", "key").unionByName(one), f"{state}/errors-{number % 2}")
        sink(_told(facts).join(new.select("service", "cycle"), ["service", "cycle"], "left_semi"), number)

    return observations.writeStream.foreachBatch(advance).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def _written(df: DataFrame, path: str) -> DataFrame:
    df.write.mode("overwrite").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
