from pyspark.sql import functions as F

from grainwise.sources import intake, sinks


def test_csv_files_stay_small_however_much_a_task_writes(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(sinks, "FILE_BYTES", 2_000)
    df = spark.range(200).select("id", F.concat(F.lit('a "line"\n'), F.repeat(F.lit("x"), 100)).alias("text")).coalesce(1)
    sinks.write_csv(df, str(tmp_path / "out"), guard=False)
    files = list((tmp_path / "out").glob("part-*.csv"))
    assert len(files) > 8 and max(f.stat().st_size for f in files) < 4_000
    back = intake.read(spark, str(tmp_path / "out")).rows
    assert sorted(tuple(r) for r in back.collect()) == sorted((str(r["id"]), r["text"]) for r in df.collect())
