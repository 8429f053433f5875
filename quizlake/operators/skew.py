"""Joins of a large table on a key that may be hot."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: A key is hot if it has more than one row in so many. So there are at most as many hot keys.
HOT_SHARE = 400
#: Keys which the counting keeps for each that may be hot; every key above its share is among them.
TRACKED = 25


def hot_keys(keys: DataFrame, key: str, share: int = HOT_SHARE) -> dict[int, int]:
    """64-bit hash of a hot key -> number of parts its rows are to be split into: at most ``share`` keys, whatever the input.

    One aggregate of bounded size (a sketch of the commonest keys, merged from task to task) in one job; no key is shuffled.
    Null keys are never hot (they match nothing in a join). The numbers only set the parts, no row depends on them.
    """
    known = keys.where(F.col(key).isNotNull()).select(F.xxhash64(key).alias("_h"))
    got = known.agg(F.count(F.lit(1)).alias("n"), F.expr(f"approx_top_k(_h, {share}, {share * TRACKED})").alias("top")).first()
    part = max(1, got["n"] // share)
    return {r["item"]: -(-r["count"] // part) for r in got["top"] or [] if r["count"] > part}


def split_join(rows: DataFrame, side: DataFrame, key: str, how: str, on: Column | None = None, share: int = HOT_SHARE, counted: DataFrame | None = None) -> DataFrame:
    """``rows`` joined to ``side`` by equality of ``key`` (a column of both, kept once), for any skew of ``rows``.

    The rows of a hot key are split by a hash of their other columns, and its side rows are repeated for every part; no part
    has more than about 1/``share`` of all distinct rows. Rows that are equal in all columns stay together: where there may be
    many, callers make them distinct or count them first. The side grows by twice ``share`` times the copies of a hot key at most.
    Nothing is broadcast by this. ``how``: inner, left, left_semi or left_anti. ``on``: a further condition, over columns of
    both. ``counted``: a table to count the keys in, if cheaper than ``rows`` (it only sets the number of parts). Null keys never match; with left and
    left_anti they stay.
    """
    parts = hot_keys(counted if counted is not None else rows, key, share)
    right = side.withColumnRenamed(key, "__split_key")
    cond = F.col(key) == F.col("__split_key")
    if on is not None:
        cond = cond & on
    if not parts:
        return rows.join(right, cond, how).drop("__split_key")
    of = F.create_map(*(x for h, n in parts.items() for x in (F.lit(h), F.lit(n))))
    count = lambda k: F.coalesce(F.try_element_at(of, F.xxhash64(k)), F.lit(1))
    others = [F.col(f"`{f.name}`") for f in rows.schema.fields if f.name != key and not isinstance(f.dataType, T.MapType)]
    split = rows.withColumn("__split_part", F.pmod(F.xxhash64(*others) if others else F.lit(0), count(key)).cast("int"))
    repeated = right.withColumn("__split_of", F.explode(F.sequence(F.lit(0), count("__split_key") - 1)))
    return split.join(repeated, cond & (F.col("__split_part") == F.col("__split_of")), how).drop("__split_key", "__split_part", "__split_of")
