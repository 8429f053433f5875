"""Exam sessions, stored and streamed."""

from datetime import datetime, timedelta

from pyspark.sql import functions as F

from quizlake.operators import sessions
from quizlake.streaming.sessions import consume_once

T = datetime(2024, 1, 1, 8)
AT = lambda h, m=0, s=0: T + timedelta(hours=h, minutes=m, seconds=s)


def test_stored_sessions(spark):
    rows = [("a", AT(0), AT(1)), ("a", AT(0), AT(1)), ("b", AT(0), AT(2)), ("c", AT(0), AT(2, 0, 1)), ("d", AT(0), None), ("e", AT(1), AT(0)), (None, AT(0), AT(1)), ("f", None, AT(1))]
    df = spark.createDataFrame(rows, "exam_id string, creada_at timestamp_ntz, enviada_at timestamp_ntz")
    assert sorted(r["exam_id"] for r in sessions.used_up(df).collect()) == ["a", "b"]
    now = F.lit(str(AT(2))).cast("timestamp_ntz")
    assert sorted(r["exam_id"] for r in sessions.active(df, now).collect()) == ["c", "d"]


def test_streamed_sessions(spark, tmp_path):
    batches = [
        [("a", "generar", AT(0)), ("b", "generar", AT(0)), ("c", "entregar", AT(0, 5)), (None, "generar", AT(0))],
        [("a", "entregar", AT(1)), ("a", "entregar", AT(1, 1)), ("d", "generar", AT(1, 30))],
        [("z", "generar", AT(9))],
        [("z", "entregar", AT(9, 1)), ("b", "entregar", AT(9, 2))],
    ]
    source = tmp_path / "in"
    source.mkdir()
    schema = "exam_id string, clase string, ts timestamp"
    for i, b in enumerate(batches):
        spark.createDataFrame(b, schema).coalesce(1).write.parquet(str(tmp_path / f"b{i}"))
        part = next((tmp_path / f"b{i}").glob("*.parquet"))
        part.rename(source / f"{i}.parquet")
        import os

        os.utime(source / f"{i}.parquet", (1_700_000_000 + i, 1_700_000_000 + i))
    events = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(source))
    query = consume_once(events).writeStream.format("memory").queryName("sesiones").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    query.awaitTermination(120)
    got = sorted((r["exam_id"], r["estado"]) for r in spark.table("sesiones").collect())
    assert got == sorted([("c", "desconocido"), ("a", "calificado"), ("a", "desconocido"), ("b", "caducado"), ("b", "desconocido"), ("d", "caducado"), ("z", "calificado")])
    ends = {r["exam_id"]: r["ts"] for r in spark.table("sesiones").where("estado = 'caducado'").collect()}
    assert ends == {"b": AT(2), "d": AT(3, 30)}
