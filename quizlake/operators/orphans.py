"""References to records that do not exist, or not at the time of the reference.

A Bloom filter of the parents' keys proves most orphans at once; only references that pass it go to the exact join. The
filter is broadcast up to a size bound; beyond it, it is partitioned and references are shuffled to its blocks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quizlake.operators import bloom
from quizlake.operators.skew import split_join

COLUMNS = ("tabla", "campo", "clave", "periodo")


def month(ts: Column) -> Column:
    """``YYYY-MM`` of a naive timestamp; null stays null."""
    return F.substring(ts.cast("string"), 1, 7)


def orphan_references(refs: DataFrame, ref: str, parents: DataFrame, key: str, at: str | None = None, since: str | None = None, until: str | None = None, bits_per_key: int = bloom.BITS_PER_KEY, max_filter_bytes: int = bloom.MAX_BYTES) -> DataFrame:
    """The rows of ``refs`` whose ``ref`` has no parent in force.

    A parent is a row of ``parents`` with ``key`` equal to ``ref``; with ``at`` given, it is in force if ``since`` <= ``at``
    and ``until`` is null or > ``at`` (a null ``since`` counts as always, a null ``at`` is within no bounded time).
    Several rows of one key: one in force is enough. A null ``ref`` is an orphan. Rows repeat as often as in ``refs``.
    An empty ``parents`` makes every reference an orphan. Only the named columns of ``parents`` are read.
    """
    kept = [F.col(key).alias("__ref_parent")] + [F.col(c).alias(n) for c, n in ((since, "__ref_since"), (until, "__ref_until")) if c]
    side = parents.select(*kept).where(F.col("__ref_parent").isNotNull())
    inside = None
    if at:
        inside = F.lit(True)
        if since:
            inside = inside & (F.col("__ref_since").isNull() | (F.col("__ref_since") <= F.col(at)))
        if until:
            inside = inside & (F.col("__ref_until").isNull() | (F.col("__ref_until") > F.col(at)))
    flagged = _probed(refs, ref, side, "__ref_parent", "__ref_maybe", bits_per_key, max_filter_bytes)
    missing = flagged.where(~F.col("__ref_maybe")).drop("__ref_maybe")
    maybe = flagged.where(F.col("__ref_maybe")).drop("__ref_maybe")
    exact = side.withColumnRenamed("__ref_parent", ref)
    return missing.unionByName(split_join(maybe, exact, ref, "left_anti", inside, counted=refs.select(ref)))


def _probed(refs: DataFrame, ref: str, parents: DataFrame, key: str, flag: str, bits_per_key: int = bloom.BITS_PER_KEY, max_bytes: int = bloom.MAX_BYTES) -> DataFrame:
    """``refs`` with ``flag``: false where the filter of the parents' keys proves that ``ref`` is none of them."""
    n = parents.count()
    blocks = bloom.block_count(n, bits_per_key)
    return bloom.probe(refs, ref, bloom.build(parents, key, blocks), blocks, flag, bloom.fits(n, bits_per_key, max_bytes))


def bad_letters(letters: Column, options: Column) -> Column:
    """Whether a key names a letter which ``options`` (a map) lacks.

    The key is split at commas, trimmed, in either case. Null, blank and voided keys (``anulada``) name none; blank parts
    of a list name none. Null or empty options lack every letter.
    """
    parts = F.filter(F.transform(F.split(F.lower(letters), ","), lambda x: F.regexp_replace(x, r"(?U)^\s+|\s+$", "")), lambda x: x != "")
    have = F.coalesce(F.transform(F.map_keys(options), lambda k: F.lower(k)), F.array().cast("array<string>"))
    voided = F.regexp_replace(F.lower(letters), r"(?U)^\s+|\s+$", "") == "anulada"
    return F.coalesce(~voided & (F.size(F.array_except(parts, have)) > 0), F.lit(False))


def answer_orphans(preguntas: DataFrame, respuestas: DataFrame, entregas: DataFrame) -> DataFrame:
    """Orphans of answers and answer keys, as (tabla, campo, clave, periodo), distinct.

    Answers are read once: both references of a row are held against their filters side by side, and what passes is made
    distinct (so copies of a row count once) and checked in one exact join against the parents of both kinds.
    """
    refs = respuestas.select(F.col("respuesta_id").cast("bigint").alias("clave"), "question_id", "exam_id", "respondida_at")
    flagged = _probed(_probed(refs, "question_id", preguntas, "id", "_q"), "exam_id", entregas, "exam_id", "_e")
    kinds = (("question_id", "q", "_q"), ("exam_id", "e", "_e"))
    # A reference and its parents carry the letter of their kind, so both kinds are joined at once.
    marked = lambda column, letter: F.concat(F.lit(letter), F.col(column))
    each = F.array(*(F.struct(F.lit(c).alias("campo"), marked(c, k).alias("ref"), F.col(f).alias("maybe")) for c, k, f in kinds))
    rows = flagged.select("clave", F.col("respondida_at").alias("at"), F.inline(each))
    parents = preguntas.select(marked("id", "q").alias("ref"), F.col("cargada_at").alias("_since"), F.col("retirada_at").alias("_until"))
    never = [F.lit(None).cast(parents.schema[c].dataType).alias(c) for c in ("_since", "_until")]
    parents = parents.unionByName(entregas.select(marked("exam_id", "e").alias("ref"), *never)).where(F.col("ref").isNotNull()).distinct()
    inside = (F.col("_since").isNull() | (F.col("_since") <= F.col("at"))) & (F.col("_until").isNull() | (F.col("_until") > F.col("at")))
    counted = refs.select(F.explode(F.array(*(marked(c, k) for c, k, _ in kinds))).alias("ref"))
    maybe = rows.where("maybe").drop("maybe").distinct()
    missing = rows.where("not maybe").drop("maybe").unionByName(split_join(maybe, parents, "ref", "left_anti", inside, counted=counted))
    key = preguntas.where(bad_letters(F.col("respuesta_correcta"), F.col("opciones")))
    found = missing.select(F.lit("respuestas").alias("tabla"), "campo", "clave", month(F.col("at")).alias("periodo"))
    found = found.unionByName(key.select(F.lit("preguntas").alias("tabla"), F.lit("respuesta_correcta").alias("campo"), F.col("num").cast("bigint").alias("clave"), month(F.col("cargada_at")).alias("periodo")))
    return found.distinct()


def orphan_report(orphans: DataFrame) -> DataFrame:
    """Orphans counted per table, field and month."""
    return orphans.groupBy("tabla", "campo", "periodo").agg(F.count(F.lit(1)).alias("huerfanas"))
