"""Operators over the question bank: filters, distinct values, names, and the catalogue of exams."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quizlake.functions import text


def chosen(questions: DataFrame, categories: Sequence[str] | None = None, years: Sequence[int] | None = None, communities: Sequence[str] | None = None) -> DataFrame:
    """Questions that meet all lists given; no list, or an empty one, asks nothing. Null never meets a list."""
    for column, values in (("categoria", categories), ("anio", years), ("comunidad_autonoma", communities)):
        if values:
            questions = questions.where(F.col(column).isin(list(values)))
    return questions


def exactly(questions: DataFrame, **wanted: object) -> DataFrame:
    """Questions whose columns equal the values given; a value None asks nothing."""
    for column, value in wanted.items():
        if value is not None:
            questions = questions.where(F.col(column) == F.lit(value))
    return questions


def stats(questions: DataFrame) -> DataFrame:
    """One row: questions, categories (null counts as one), years and communities."""
    return questions.agg(
        F.count(F.lit(1)).alias("preguntas"),
        F.countDistinct(F.coalesce("categoria", F.lit(""))).alias("categorias"),
        F.countDistinct("anio").alias("anios"),
        F.countDistinct("community").alias("comunidades"),
    )


def by_category(questions: DataFrame) -> DataFrame:
    """Questions per category; null counts as the empty one."""
    return questions.groupBy(F.coalesce("categoria", F.lit("")).alias("categoria")).agg(F.count(F.lit(1)).alias("preguntas"))


def category_names(questions: DataFrame, order: str = "num") -> DataFrame:
    """(id, nombre): the first name of each category that is not blank, by ``order``; else a default."""
    name = F.min_by("categoria_nombre", F.when(~text.blank(F.col("categoria_nombre")), F.col(order)))
    named = questions.where(F.col("categoria").isNotNull()).groupBy(F.col("categoria").alias("id")).agg(name.alias("nombre"), F.count_if(~text.blank(F.col("categoria_nombre"))).alias("_n"))
    return named.select("id", F.when(F.col("_n") > 0, F.col("nombre")).otherwise(F.concat(F.lit("Categoría "), "id")).alias("nombre"))


def distinct_values(questions: DataFrame, column: str, ascending: bool = True) -> DataFrame:
    """The distinct values of a column, without null, in order."""
    return questions.select(column).where(F.col(column).isNotNull()).distinct().orderBy(F.col(column).asc() if ascending else F.col(column).desc())


def unknown(requested: DataFrame, questions: DataFrame, column: str = "community") -> DataFrame:
    """Requested values which no question has."""
    return requested.join(questions.select(column).distinct(), column, "left_anti")


def refuse_unknown(questions: DataFrame, communities: Sequence[str] | None) -> None:
    """Raises ValueError for the first community that no question has, naming those there are. None and [] pass."""
    if communities:
        there = [r[0] for r in distinct_values(questions, "community").collect()]  # names of communities
        for c in communities:
            if c not in there:
                raise ValueError(f"unknown community {c!r}; known are: {', '.join(there)}")


def catalogue(questions: DataFrame) -> DataFrame:
    """(community, anio, convocatoria, pruebas): the test codes of every call, in order, joined by commas."""
    whole = questions.where(F.col("community").isNotNull() & F.col("anio").isNotNull() & F.col("convocatoria").isNotNull())
    return whole.groupBy("community", "anio", "convocatoria").agg(F.array_join(F.array_sort(F.collect_set("test_code")), ",").alias("pruebas"))


def nested_catalogue(questions: DataFrame) -> DataFrame:
    """(community, anios map<int, map<string, array<string>>>): year -> call -> test codes."""
    calls = catalogue(questions).select("community", "anio", "convocatoria", F.filter(F.split("pruebas", ","), lambda x: x != "").alias("p"))
    years = calls.groupBy("community", "anio").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("convocatoria", "p")))).alias("m"))
    return years.groupBy("community").agg(F.map_from_entries(F.collect_list(F.struct("anio", "m"))).alias("anios"))


def calls(questions: DataFrame, community: str, year: int) -> DataFrame:
    """The distinct calls of a community and year, in order."""
    return distinct_values(exactly(questions, community=community, anio=year), "convocatoria")


def exams(rows: DataFrame, order: Column) -> DataFrame:
    """The catalogue of exams under their computed keys, the first row of each key by ``order``; rows with null parts are left out."""
    kept = ["title", "subtitle", "community", "anio", "convocatoria", "test_code", "total_questions"]
    keyed = rows.withColumn("id", text.exam_key(F.col("community"), F.col("anio"), F.col("convocatoria"), F.col("test_code"))).where(F.col("id").isNotNull())
    first = keyed.groupBy("id").agg(F.min_by(F.struct(*kept), order).alias("_f"))
    return first.select("id", *(F.col(f"_f.{c}").alias(c) for c in kept))
