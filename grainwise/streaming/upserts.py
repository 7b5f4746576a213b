"""Compare-and-set of snapshots as a stream."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from grainwise.operators.writes import SAVED, classify_writes


def stream(
    writes: DataFrame, sink: Callable[[DataFrame, int], None], state: str, checkpoint: str, order: list[str], chunk: str = "hour", keep: str = "7 days",
) -> StreamingQuery:
    """Outcomes of a stream of writes: task, write_key, based_on, at and the columns of ``order``, which goes on from one micro-batch to the next.

    Every micro-batch is folded as a log of its own, from the revisions and keys that earlier ones saved. ``state`` is a folder
    that all executors share; it holds two snapshots of both: micro-batch n reads that of n - 1 and overwrites that of n - 2, so a
    retry gives the same. A revision is one row per task. A key is forgotten when the newest write is later than
    its save by ``keep``; a replay after that is judged by its revision.
    """
    def advance(fresh: DataFrame, number: int) -> None:
        spark = fresh.sparkSession
        new = _written(fresh, f"{state}/new-{number % 2}")
        kinds = {f.name: f.dataType.simpleString() for f in new.schema.fields}
        before = (number - 1) % 2
        revisions = _known(spark, number, f"{state}/revisions-{before}", f"task {kinds['task']}, revision bigint")
        owners = _known(spark, number, f"{state}/owners-{before}", f"write_key {kinds['write_key']}, task {kinds['task']}, saved_at {kinds['at']}")
        mine = owners.join(new.select("write_key").distinct(), "write_key", "left_semi").select("write_key", "task")
        now = revisions.join(new.select("task").distinct(), "task", "left_semi")
        told = _written(classify_writes(new, "task", "write_key", "based_on", order, F.date_trunc(chunk, "at"), now, mine), f"{state}/told-{number % 2}")
        saved = told.filter(F.col("outcome") == SAVED)
        grown = saved.groupBy("task").agg((F.max("based_on") + 1).alias("grown"))
        _written(revisions.join(grown, "task", "full").select("task", F.coalesce("grown", "revision").alias("revision")), f"{state}/revisions-{number % 2}")
        newest = new.agg(F.max("at").alias("newest"))
        live = owners.join(F.broadcast(newest)).filter(F.expr(f"newest IS NULL OR saved_at >= newest - INTERVAL {keep}")).drop("newest")
        _written(live.unionByName(saved.filter("write_key IS NOT NULL").select("write_key", "task", F.col("at").alias("saved_at"))), f"{state}/owners-{number % 2}")
        sink(told, number)

    return writes.writeStream.foreachBatch(advance).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def _known(spark, number: int, path: str, schema: str) -> DataFrame:
    return spark.read.schema(schema).parquet(path) if number > 0 else spark.createDataFrame([], schema)


def _written(df: DataFrame, path: str) -> DataFrame:
    df.write.mode("overwrite").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
