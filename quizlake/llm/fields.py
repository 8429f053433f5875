"""The texts of the question bank as rows: one per field."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def question_fields(preguntas: DataFrame) -> DataFrame:
    """(num, campo, texto): ``enunciado`` and every option by its letter. Null texts and null keys give no row."""
    stem = F.struct(F.lit("enunciado").alias("campo"), F.col("enunciado").alias("texto"))
    options = F.transform(F.coalesce(F.map_entries("opciones"), F.array()), lambda e: F.struct(e["key"].alias("campo"), e["value"].alias("texto")))
    return preguntas.select("num", F.inline(F.concat(F.array(stem), options))).where(F.col("texto").isNotNull() & F.col("num").isNotNull())
