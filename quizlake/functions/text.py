"""Expressions over texts, with Unicode-aware white space and code-point order."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: White space as Python's str.split knows it, as a Java (and RE2) character class.
SPACE = r"[\t-\r\x{1C}-\x{20}\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]"
#: Between the parts of a content key.
PART = "||"


def stripped(text: Column) -> Column:
    """Without white space of any kind at both ends. Null stays null."""
    return F.regexp_replace(text, f"^{SPACE}+|{SPACE}+$", "")


def collapsed(text: Column) -> Column:
    """``stripped``, with every inner run of white space as one blank."""
    return F.regexp_replace(stripped(text), f"{SPACE}+", " ")


def blank(text: Column) -> Column:
    """True for null, empty and white-space texts."""
    return F.coalesce(stripped(text), F.lit("")) == ""


def content_key(stem: Column, options: Column) -> Column:
    """The stem and the option texts in code-point order, all collapsed; letters, order and keys of options do not count.

    A null stem or null option text counts as empty, null options as none.
    """
    texts = F.transform(F.coalesce(F.map_values(options), F.array().cast("array<string>")), lambda x: collapsed(F.coalesce(x, F.lit(""))))
    return F.array_join(F.concat(F.array(collapsed(F.coalesce(stem, F.lit("")))), F.array_sort(texts)), PART)


def content_hash(stem: Column, options: Column) -> Column:
    """SHA-256 of the content key, in hexadecimal."""
    return F.sha2(content_key(stem, options), 256)


def clipped(text: Column, most: int = 80) -> Column:
    """The first signs of a text, with three dots if any are left out."""
    return F.when(F.length(text) > most, F.concat(F.substring(text, 1, most), F.lit("..."))).otherwise(text)


def capitalised(text: Column) -> Column:
    """First sign in capitals, all others small (``initcap`` would do so for every word)."""
    return F.concat(F.upper(F.substring(text, 1, 1)), F.lower(F.substring(text, F.lit(2), F.length(text))))


def display_name(code: Column, names: dict[str, str] | None = None) -> Column:
    """The name of a code: from ``names``, else the code with blanks for underscores and its first sign in capitals."""
    spaced = F.replace(code, F.lit("_"), F.lit(" "))
    plain = F.concat(F.upper(F.substring(spaced, 1, 1)), F.substring(spaced, F.lit(2), F.length(spaced)))
    if not names:
        return plain
    known = F.create_map(*(F.lit(x) for pair in sorted(names.items()) for x in pair))
    return F.coalesce(F.try_element_at(known, code), plain)


def exam_key(community: Column, year: Column, call: Column, test_code: Column) -> Column:
    """``community_year_call_testcode`` with the community in small letters; null if any part is null."""
    return F.concat(F.lower(community), F.lit("_"), year.cast("string"), F.lit("_"), call, F.lit("_"), test_code)


def parsed_key(key: Column) -> Column:
    """struct(estado, community, anio, convocatoria, test_code) of an exam key.

    ``estado`` is ok, formato (not four parts) or anio (second part no whole number); the fields are null unless ok. A null
    key has the state formato.
    """
    parts = F.split(key, "_", -1)
    year = F.try_element_at(parts, F.lit(2)).try_cast("int")
    state = F.when(key.isNull() | (F.size(parts) != 4), "formato").when(year.isNull(), "anio").otherwise("ok")
    ok = state == "ok"
    return F.struct(
        state.alias("estado"),
        F.when(ok, capitalised(F.try_element_at(parts, F.lit(1)))).alias("community"),
        F.when(ok, year).alias("anio"),
        F.when(ok, F.try_element_at(parts, F.lit(3))).alias("convocatoria"),
        F.when(ok, F.try_element_at(parts, F.lit(4))).alias("test_code"),
    )
