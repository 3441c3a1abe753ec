"""How the queries' own files are written."""

from pathlib import Path

from pyspark.sql import functions as F

from patchloom.plans import queries_files


def test_many_small_files_are_written_by_many_tasks(spark):
    rows = spark.range(60).select(F.concat(F.lit("x"), "id").alias("value"), F.col("id").alias("n"))
    path = Path(queries_files._stored(spark, rows, "code", "n").removeprefix("file://"))
    parts = list(path.glob("n=*/part-*"))
    assert len(parts) == 60 and len({p.name[:10] for p in parts}) > 1
    assert {(p.parent.name, p.read_text()) for p in parts} == {(f"n={i}", f"x{i}\n") for i in range(60)}
