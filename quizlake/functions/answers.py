"""Expressions over answers and answer keys.

A key is a letter, a comma list of letters, or a mark that the question is voided. Case never counts. Parts of a list are
trimmed, a lone key and the answer itself are not.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from quizlake.functions.text import blank, stripped

VOIDED = "anulada"
LETTERS = ("a", "b", "c", "d")
NO_TEXT = "Opción no encontrada"


def voided(key: Column) -> Column:
    """Whether a key voids its question; false for null."""
    return F.coalesce(F.lower(key) == VOIDED, F.lit(False))


def accepted(key: Column) -> Column:
    """The accepted letters: all four if voided, the trimmed parts of a list, else the key itself. Null gives an empty array."""
    low = F.lower(key)
    return (
        F.when(key.isNull(), F.array().cast("array<string>"))
        .when(voided(key), F.array(*(F.lit(c) for c in LETTERS)))
        .when(F.contains(low, F.lit(",")), F.transform(F.split(low, ",", -1), lambda x: stripped(x)))
        .otherwise(F.array(low))
    )


def right(answer: Column, key: Column) -> Column:
    """Whether an answer is right. Blank answers never are, not even for voided questions; a null key makes all others wrong."""
    return F.when(blank(answer), F.lit(False)).when(voided(key), F.lit(True)).otherwise(F.array_contains(accepted(key), F.lower(answer)))


def option_text(options: Column, letter: Column) -> Column:
    """Text of the option under the letter as it stands, NO_TEXT if there is none."""
    return F.coalesce(F.try_element_at(options, letter), F.lit(NO_TEXT))


def accepted_texts(options: Column, key: Column) -> Column:
    """The options under accepted letters, as a map."""
    return F.map_filter(options, lambda k, v: F.array_contains(accepted(key), k))


def written(options: Column) -> Column:
    """Options as one text: "letter: text" in the order of the letters, joined by " | ". Null texts are empty; null stays null."""
    parts = F.transform(F.array_sort(F.map_entries(options)), lambda e: F.concat(e["key"], F.lit(": "), F.coalesce(e["value"], F.lit(""))))
    return F.array_join(parts, " | ")
