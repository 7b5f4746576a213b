from pyspark.sql import functions as F

from grainwise.sources import csv


def test_header_survey_reads_the_first_lines_only(spark):
    texts = ["", "\n \n　\n", "a", "\n".join(f"l{i}" for i in range(60)), "\n\t\n" + "\n\n".join(f" l{i} x" for i in range(60)) + "\n", "\n" * 300_000 + "end\n", None]
    df = spark.createDataFrame(list(enumerate(texts)), "i int, text string")
    for i, text, head in df.select("i", "text", csv.first_lines(F.col("text")).alias("head")).collect():
        if text is None:
            assert head is None
            continue
        full = [(n, x) for n, x in enumerate(text.split("\n")) if x.strip(" \t　")]
        assert text.startswith(head) and [(n, x) for n, x in enumerate(head.split("\n")) if x.strip(" \t　")] == full[:20], i
