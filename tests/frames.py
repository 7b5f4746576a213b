"""Small helpers of the tests."""


def text_frame(spark, names, rows):
    """All-text frame, the shape a CSV arrives in."""
    schema = ", ".join(f"`{n}` string" for n in names)
    return spark.createDataFrame([tuple(r) for r in rows], schema)


def as_set(df):
    return {tuple(r) for r in df.collect()}


def passed(checks):
    return {r["check"]: r["passed"] for r in checks.collect()}
