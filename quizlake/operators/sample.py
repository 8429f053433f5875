"""Drawing exams from a bank: distinct contents, flat or by quotas, repeatable by a seed.

A content's place in the draw is the least key of its copies, so a content with more copies is likelier to come early,
as if the bank were shuffled and repeats skipped.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quizlake.functions import text


def seeded_key(seed: str | int, id_col: Column) -> Column:
    """A random-looking key that depends on seed and id only."""
    return F.sha2(F.concat(F.lit(f"{seed}|"), id_col.cast("string")), 256)


def distinct_contents(questions: DataFrame, key: Column, by: list[str] | None = None, id_col: str = "num") -> DataFrame:
    """(by..., content, id_col, _key): of every content the row with the least key; ``by`` sets the scope of being distinct.

    Rows without an id cannot be drawn.
    """
    by = by or []
    rows = questions.where(F.col(id_col).isNotNull()).select(*by, text.content_hash(F.col("enunciado"), F.col("opciones")).alias("contenido"), F.col(id_col), key.alias("_key"))
    return rows.groupBy(*by, "contenido").agg(F.min_by(id_col, F.struct("_key", id_col)).alias(id_col), F.min("_key").alias("_key"))


def unique_sample(questions: DataFrame, n: int, seed: str | int = 42, id_col: str = "num") -> DataFrame:
    """(id_col, posicion): n questions of distinct content in random order. Fewer if there are fewer contents."""
    drawn = distinct_contents(questions, seeded_key(seed, F.col(id_col)), id_col=id_col).orderBy("_key", id_col).limit(n)
    return drawn.withColumn("posicion", F.row_number().over(Window.orderBy("_key", id_col))).select(id_col, "posicion")  # n rows


def flat_exam(questions: DataFrame, n: int, exam_id: str, kind: str, seed: str | int = 42) -> DataFrame:
    """An exam of n questions: new ids by position; the key column only for kinds that show it. Raises if too few questions or contents."""
    if not 1 <= n <= 100:
        raise ValueError("an exam has 1 to 100 questions")
    if questions.limit(n).count() < n:
        raise ValueError(f"fewer than {n} questions meet the criteria")
    drawn = unique_sample(questions, n, seed)
    got = drawn.count()
    if got < n:
        raise ValueError(f"only {got} of {n} questions have distinct content")
    rows = questions.select("num", "enunciado", "opciones", "respuesta_correcta", "categoria").join(F.broadcast(drawn), "num").dropDuplicates(["num"])  # n rows
    key = F.col("respuesta_correcta") if kind in ("normal", "per") else F.lit(None).cast("string")
    return rows.select(F.concat(F.lit(f"{exam_id}_q"), F.col("posicion").cast("string")).alias("id"), "posicion", "enunciado", "opciones", key.alias("respuesta_correcta"), "categoria").orderBy("posicion")


def quota_exam(questions: DataFrame, quotas: dict[int, int], seed: str | int = 42, id_col: str = "num") -> DataFrame:
    """(cat, id_col, posicion): for every category as many questions as its quota, of contents distinct within it.

    Categories are read as whole numbers; others are passed over. Contents are grouped first; of what is left, each task keeps
    no more rows of a category than the largest quota before they are ranked.
    """
    rows = questions.withColumn("cat", F.col("categoria").try_cast("int")).where(F.col("cat").isin(list(quotas)))
    unique = distinct_contents(rows, seeded_key(seed, F.col(id_col)), ["cat"], id_col)
    quota = F.element_at(F.create_map(*(F.lit(x) for pair in quotas.items() for x in pair)), F.col("cat"))
    ranked = unique.withColumn("_rn", F.row_number().over(Window.partitionBy("cat").orderBy("_key", id_col))).where(F.col("_rn") <= max(quotas.values(), default=0)).where(F.col("_rn") <= quota)
    return ranked.withColumn("posicion", F.row_number().over(Window.orderBy("cat", "_rn"))).select("cat", id_col, "posicion")  # as many rows as the quotas say


def feasibility(questions: DataFrame, quotas: dict[int, int]) -> DataFrame:
    """(cat, cuota, preguntas, contenidos, estado): estado is ok, faltan_preguntas, or faltan_contenidos."""
    spark = questions.sparkSession
    wanted = spark.createDataFrame(sorted(quotas.items()), "cat int, cuota int")
    rows = questions.select(F.col("categoria").try_cast("int").alias("cat"), text.content_hash(F.col("enunciado"), F.col("opciones")).alias("h"))
    per = rows.groupBy("cat", "h").agg(F.count(F.lit(1)).alias("n")).groupBy("cat").agg(F.sum("n").alias("preguntas"), F.count(F.lit(1)).alias("contenidos"))
    got = F.broadcast(wanted).join(per, "cat", "left").fillna(0, ["preguntas", "contenidos"])
    state = F.when(F.col("preguntas") < F.col("cuota"), "faltan_preguntas").when(F.col("contenidos") < F.col("cuota"), "faltan_contenidos").otherwise("ok")
    return got.select("cat", "cuota", "preguntas", "contenidos", state.alias("estado"))


def mock_exam(questions: DataFrame, quotas: dict[int, int], exam_id: str, seed: str | int = 42) -> DataFrame:
    """A mock exam as its rows: (id, posicion, num, cat, enunciado, opciones), categories in order, without answer keys.

    Raises ValueError, with different texts, if a category has fewer questions than its quota, or fewer distinct contents.
    The quotas are checked first, in one small aggregate.
    """
    for r in feasibility(questions, quotas).where("estado <> 'ok'").orderBy("cat").collect():  # one row per quota at most
        if r["estado"] == "faltan_preguntas":
            raise ValueError(f"category {r['cat']} has {r['preguntas']} of {r['cuota']} questions")
        raise ValueError(f"category {r['cat']} has only {r['contenidos']} of {r['cuota']} questions of distinct content")
    drawn = quota_exam(questions, quotas, seed)
    rows = questions.select("num", "enunciado", "opciones").join(F.broadcast(drawn), "num").dropDuplicates(["cat", "num"])  # as many rows as the quotas say
    return rows.select(F.concat(F.lit(f"{exam_id}_q"), F.col("posicion").cast("string")).alias("id"), "posicion", "num", "cat", "enunciado", "opciones").orderBy("posicion")


def specific_exam(questions: DataFrame, key: str, exam_id: str) -> DataFrame:
    """The questions of the exam named by ``key``, in their order (null numbers first), renumbered, without answer keys.

    Raises ValueError, with different texts, for a key of another form, for a year that is no number, and for no rows.
    """
    named = questions.sparkSession.range(1).select(text.parsed_key(F.lit(key)).alias("k")).first()["k"]
    if named["estado"] == "formato":
        raise ValueError(f"{key!r} is not of the form community_year_call_test")
    if named["estado"] == "anio":
        raise ValueError(f"the second part of {key!r} is no year")
    rows = questions
    for part in ("community", "anio", "convocatoria", "test_code"):
        rows = rows.where(F.col(part) == F.lit(named[part]))
    if rows.limit(1).count() == 0:
        raise ValueError(f"no questions for {key!r}")
    place = F.row_number().over(Window.orderBy(F.coalesce("numero_pregunta", F.lit(0)), "num"))  # one exam
    return rows.withColumn("posicion", place).select(F.concat(F.lit(f"{exam_id}_q"), F.col("posicion").cast("string")).alias("id"), "posicion", "num", "numero_pregunta", "enunciado", "categoria").orderBy("posicion")


def new_exam_id(kind: str, seed: Column | None = None) -> Column:
    """``kind_`` and eight hexadecimal digits, random or from a seed."""
    digits = F.replace(F.expr("uuid()"), F.lit("-"), F.lit("")) if seed is None else F.sha2(seed.cast("string"), 256)
    return F.concat(F.lit(f"{kind}_"), F.substring(digits, 1, 8))


def repeats(questions: DataFrame, by: str, id_col: str = "num") -> DataFrame:
    """(by, repetidas): copies beyond the first (by id) of their content, counted per value, most first."""
    rows = questions.select(F.col(by).alias("_by"), id_col, text.content_hash(F.col("enunciado"), F.col("opciones")).alias("h"))
    firsts = rows.groupBy("h").agg(F.min_by("_by", id_col).alias("_by")).groupBy("_by").agg(F.count(F.lit(1)).alias("_f"))
    total = rows.groupBy("_by").agg(F.count(F.lit(1)).alias("_n"))
    both = total.alias("t").join(firsts.alias("f"), F.col("t._by").eqNullSafe(F.col("f._by")), "left")
    extra = both.select(F.col("t._by").alias(by), (F.col("_n") - F.coalesce("_f", F.lit(0))).alias("repetidas")).where("repetidas > 0")
    return extra.orderBy(F.desc("repetidas"), F.col(by).asc_nulls_first())


def repeat_details(questions: DataFrame) -> DataFrame:
    """(hash, copias, muestra, claves) of all contents that occur more than once, those with most copies first."""
    return repeat_groups(questions).orderBy(F.desc("copias"), "contenido").select(F.substring("contenido", 1, 16).alias("hash"), "copias", text.clipped(F.col("muestra")).alias("muestra"), "claves")


def repeat_groups(questions: DataFrame) -> DataFrame:
    """(contenido, copias, claves, muestra): contents that occur more than once, their copies, and how many answer keys they have."""
    rows = questions.select("num", "enunciado", F.lower("respuesta_correcta").alias("_k"), text.content_hash(F.col("enunciado"), F.col("opciones")).alias("contenido"))
    per_key = rows.groupBy("contenido", "_k").agg(F.count(F.lit(1)).alias("n"), F.min_by("enunciado", "num").alias("e"), F.min("num").alias("m"))
    got = per_key.groupBy("contenido").agg(F.sum("n").alias("copias"), F.count("_k").alias("claves"), F.min_by("e", "m").alias("muestra"))
    return got.where("copias > 1")


def repeat_report(questions: DataFrame, threshold: int = 10) -> DataFrame:
    """Details of repeated contents if there are no more than ``threshold``, else their numbers per community and year.

    (tipo, valor, repetidas), tipo being contenido, community or anio.
    """
    found = repeat_groups(questions)
    if found.limit(threshold + 1).count() <= threshold:
        return found.select(F.lit("contenido").alias("tipo"), text.clipped(F.col("muestra")).alias("valor"), (F.col("copias") - 1).alias("repetidas"))
    parts = [repeats(questions, c).select(F.lit(c).alias("tipo"), F.col(c).cast("string").alias("valor"), "repetidas") for c in ("community", "anio")]
    return parts[0].unionByName(parts[1])
