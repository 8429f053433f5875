"""Duplicates that differ in formatting only: one record each, with the number of its copies."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quizlake.operators.skew import split_join
from quizlake.session import stage

#: Between the parts of a canonical text; no letter or numeral.
SEPARATOR = "\x1f"


def fold_case(text: Column) -> Column:
    """Text without case: signs whose upper or lower form is shared become one (final sigma, sharp s, micro sign)."""
    return F.translate(F.lower(F.upper(text)), "ς", "σ")


def bare(text: Column) -> Column:
    """The letters and numerals of a text in order, without case. Null counts as empty."""
    return F.regexp_replace(fold_case(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}]+", "")


def canonical(ordered: list[Column], unordered: Column | None = None) -> Column:
    """One text for all that are the same but for formatting.

    ``ordered``: texts which must agree one by one; ``unordered``: an array of texts which must agree as a collection,
    with repetitions. Null texts count as empty ones, a null array as an empty one.
    """
    parts = F.array(*(bare(c) for c in ordered))
    if unordered is not None:
        parts = F.concat(parts, F.array_sort(F.transform(F.coalesce(unordered, F.array().cast("array<string>")), bare)))
    return F.array_join(parts, SEPARATOR)


def keyed(df: DataFrame, id_col: str, text: Column) -> DataFrame:
    """(id, clave): the 128-bit MD5 of the canonical text, followed by a 64-bit hash of another family and its length.

    Two texts are taken as one only if all three agree; where only the MD5 agrees, ``collisions`` shows it.
    """
    check = F.concat(F.hex(F.xxhash64("_t")), F.lpad(F.hex(F.length("_t")), 8, "0"))
    return df.select(F.col(id_col).alias("id"), text.alias("_t")).select("id", F.unhex(F.concat(F.md5("_t"), F.lpad(check, 24, "0"))).alias("clave"))


def groups(keys: DataFrame) -> DataFrame:
    """(clave, primero, copias) per distinct text; counts are combined before the shuffle. A null id is counted, never first unless alone."""
    return keys.groupBy("clave").agg(F.min("id").alias("primero"), F.count(F.lit(1)).alias("copias"))


def collisions(keys: DataFrame) -> DataFrame:
    """MD5 values that stand for more than one text; normally empty."""
    return keys.select(F.substring("clave", 1, 16).alias("md5"), "clave").distinct().groupBy("md5").agg(F.count(F.lit(1)).alias("textos")).where("textos > 1")


def members(keys: DataFrame) -> DataFrame:
    """(id, primero) of every row whose text occurs more than once. Groups of any size: see ``split_join``."""
    several = groups(keys).where("copias > 1").select("clave", "primero")
    return split_join(keys, several, "clave", "inner").select("id", "primero")


def question_keys(preguntas: DataFrame) -> DataFrame:
    """The staged keys of questions: ``enunciado`` in order, options as a collection."""
    return stage(keyed(preguntas, "num", canonical([F.col("enunciado")], F.map_values("opciones"))), "keys")


def same_questions(preguntas: DataFrame) -> DataFrame:
    """(num_a, num_b): the smallest ``num`` of a group, and each further member."""
    found = members(question_keys(preguntas)).where(F.col("id") != F.col("primero"))
    return found.select(F.col("primero").alias("num_a"), F.col("id").alias("num_b"))


def distinct_questions(preguntas: DataFrame) -> DataFrame:
    """(num, copias): one record per question, under its smallest ``num``."""
    return groups(question_keys(preguntas)).select(F.col("primero").alias("num"), "copias")
