"""Fixed-window request counters. The same functions run on batch and stream frames."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

REQUEST_LIMIT = 30
WINDOW = "60 seconds"


def request_counts(
    requests: DataFrame, at: str, route: Column, subject: Column, every: str = WINDOW, late: str | None = None
) -> DataFrame:
    """Requests per (route, subject, fixed window).

    ``late`` sets the watermark on a stream: closed windows leave the state
    after it, which is also what expires old counters.
    """
    source = requests if late is None else requests.withWatermark(at, late)
    return source.groupBy(
        route.alias("route"), subject.alias("subject"), F.window(at, every).alias("w")
    ).agg(F.count(F.lit(1)).alias("requests")).select(
        "route", "subject", F.col("w.start").alias("window_start"), F.col("w.end").alias("reset_at"), "requests"
    )


def with_limit(counts: DataFrame, limit: int = REQUEST_LIMIT) -> DataFrame:
    """Counters with what is left of the limit and whether it was exceeded."""
    return counts.withColumns({
        "remaining": F.greatest(F.lit(0), F.lit(limit) - F.col("requests")).cast("bigint"),
        "refused": F.greatest(F.lit(0), F.col("requests") - F.lit(limit)).cast("bigint"),
        "exceeded": F.col("requests") > F.lit(limit),
    })
