"""Audit of a question bank: rules per question and exam, rates, and a gate."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quizlake.functions import answers as A
from quizlake.functions import numbers as N
from quizlake.functions import text
from quizlake.sources import yaml_bank

EXPECTED = A.LETTERS


def _keys() -> Column:
    return F.array_sort(F.coalesce(F.map_keys("opciones"), F.array().cast("array<string>")))


def option_issue(expected: tuple[str, ...] = EXPECTED) -> Column:
    """Kind of fault in a question's option keys: ninguna, faltan, sobran, distintas; null if they are as expected."""
    want = F.array(*(F.lit(c) for c in expected))
    n = F.size(_keys())
    return F.when(n == 0, "ninguna").when(n < len(expected), "faltan").when(n > len(expected), "sobran").when(F.size(F.array_except(want, _keys())) > 0, "distintas")


def options(questions: DataFrame, expected: tuple[str, ...] = EXPECTED) -> DataFrame:
    """(num, fallo, faltan, sobran) of the questions whose option keys are not as expected."""
    want = F.array(*(F.lit(c) for c in expected))
    rows = questions.select("num", option_issue(expected).alias("fallo"), F.array_join(F.array_sort(F.array_except(want, _keys())), ",").alias("faltan"), F.array_join(F.array_sort(F.array_except(_keys(), want)), ",").alias("sobran"))
    return rows.where(F.col("fallo").isNotNull())


def answer_issue() -> Column:
    """Fault of a question's answer key: vacia, or desconocida (a part which is no option as it is written); null if none."""
    key = F.col("respuesta_correcta")
    parts = F.when(F.contains(key, F.lit(",")), F.transform(F.split(F.lower(key), ",", -1), lambda x: text.stripped(x))).otherwise(F.array(F.lower(key)))
    return F.when(text.blank(key), "vacia").when(A.voided(key), None).when(F.size(F.array_except(parts, _keys())) > 0, "desconocida")


def answers(questions: DataFrame) -> DataFrame:
    """(num, respuesta_correcta, fallo) of the questions with a faulty answer key."""
    return questions.select("num", "respuesta_correcta", answer_issue().alias("fallo")).where(F.col("fallo").isNotNull())


def missing_parts() -> Column:
    """Names of what is blank in a question: enunciado, opciones, respuesta_correcta, and options by opcion_x."""
    empty = F.filter(F.coalesce(F.map_entries("opciones"), F.array()), lambda e: text.blank(e["value"]))
    fields = F.array_compact(
        F.array(
            F.when(text.blank(F.col("enunciado")), F.lit("enunciado")),
            F.when(F.size(_keys()) == 0, F.lit("opciones")),
            F.when(text.blank(F.col("respuesta_correcta")), F.lit("respuesta_correcta")),
        )
    )
    return F.concat(fields, F.array_sort(F.transform(empty, lambda e: F.concat(F.lit("opcion_"), e["key"]))))


def structure(questions: DataFrame) -> DataFrame:
    """(num, faltan) of the questions in which something is blank."""
    return questions.select("num", F.array_join(missing_parts(), ",").alias("faltan")).where(F.col("faltan") != "")


def repeated_numbers(questions: DataFrame) -> DataFrame:
    """(exam_identifier, numero_pregunta, veces, categorias): numbers that occur more than once in an exam, with their categories."""
    rows = questions.where(F.col("exam_identifier").isNotNull() & F.col("numero_pregunta").isNotNull())
    per = rows.groupBy("exam_identifier", "numero_pregunta").agg(F.count(F.lit(1)).alias("veces"), F.array_join(F.array_sort(F.collect_set("categoria")), ",").alias("categorias"))
    return per.where("veces > 1")


def histogram(questions: DataFrame) -> DataFrame:
    """(exam_identifier, categoria, preguntas)."""
    return questions.groupBy("exam_identifier", F.coalesce("categoria", F.lit("")).alias("categoria")).agg(F.count(F.lit(1)).alias("preguntas"))


def distribution(questions: DataFrame, quotas: dict[int, int]) -> DataFrame:
    """(exam_identifier, total, diferencia, iguales, cuadra): each exam against the official quotas.

    ``diferencia`` is the sum of what is over or short in the official categories; others count in the total alone. An exam
    fits if all agree and the total is theirs.
    """
    cat = F.col("categoria").try_cast("int")
    aggs = [F.count_if(F.coalesce(cat == F.lit(c), F.lit(False))).alias(f"_{c}") for c in quotas]
    per = questions.where(F.col("exam_identifier").isNotNull()).groupBy("exam_identifier").agg(F.count(F.lit(1)).alias("total"), *aggs)
    gaps = [F.col(f"_{c}") - F.lit(q) for c, q in quotas.items()]
    same = F.lit(True)
    for g in gaps:
        same = same & (g == 0)
    return per.select("exam_identifier", "total", sum(gaps, F.lit(0)).cast("bigint").alias("diferencia"), same.alias("iguales"), (same & (F.col("total") == sum(quotas.values()))).alias("cuadra"))


def quota_gaps(questions: DataFrame, quotas: dict[int, int]) -> DataFrame:
    """(exam_identifier, cat, oficial, hay, diferencia): every official category of every exam, 0 where it has none."""
    cat = F.col("categoria").try_cast("int")
    aggs = [F.count_if(F.coalesce(cat == F.lit(c), F.lit(False))).alias(f"_{c}") for c in quotas]
    per = questions.where(F.col("exam_identifier").isNotNull()).groupBy("exam_identifier").agg(*aggs)
    rows = F.array(*(F.struct(F.lit(c).alias("cat"), F.lit(q).alias("oficial"), F.col(f"_{c}").alias("hay")) for c, q in quotas.items()))
    return per.select("exam_identifier", F.inline(rows)).withColumn("diferencia", F.col("hay") - F.col("oficial"))


#: Rules of the audit, in the order of its rates.
RULES = ("distribucion", "opciones", "respuestas", "estructura", "numeros")
#: What an exam whose header names no number of questions is held against.
EXPECTED_QUESTIONS = 45


def per_exam(questions: DataFrame, exams: DataFrame, quotas: dict[int, int]) -> DataFrame:
    """Per exam whether each rule holds: (exam_identifier, estado, esperadas, preguntas, distribucion_ok, opciones_ok, ...).

    ``exams`` has exam_identifier and esperadas, one row per exam file; an exam without any question, unreadable or empty, has
    the state ``error`` and null for every rule. Exams of ``questions`` that ``exams`` lacks are audited too, those without a
    name are not. An exam fits if its categories have the official numbers and its total is what its header expects.
    """
    cat = F.col("categoria").try_cast("int")
    counts = [F.count_if(F.coalesce(cat == F.lit(c), F.lit(False))).alias(f"_{c}") for c in quotas]
    rows = questions.where(F.col("exam_identifier").isNotNull()).select("exam_identifier", "numero_pregunta", "categoria", option_issue().isNull().alias("o"), answer_issue().isNull().alias("a"), (F.size(missing_parts()) == 0).alias("s"))
    per_number = rows.groupBy("exam_identifier", "numero_pregunta").agg(F.count(F.lit(1)).alias("n"), F.bool_and("o").alias("o"), F.bool_and("a").alias("a"), F.bool_and("s").alias("s"), *counts)
    same = F.lit(True)
    for c, q in quotas.items():
        same = same & (F.sum(f"_{c}") == q)
    found = per_number.groupBy("exam_identifier").agg(
        F.sum("n").alias("preguntas"),
        same.alias("_d"),
        F.bool_and("o").alias("opciones_ok"),
        F.bool_and("a").alias("respuestas_ok"),
        F.bool_and("s").alias("estructura_ok"),
        F.bool_and(F.col("numero_pregunta").isNull() | (F.col("n") == 1)).alias("numeros_ok"),
    )
    files = exams.where(F.col("exam_identifier").isNotNull()).groupBy("exam_identifier").agg(F.max("esperadas").alias("esperadas"))
    both = files.join(found, "exam_identifier", "full").withColumns({"esperadas": F.coalesce("esperadas", F.lit(EXPECTED_QUESTIONS)), "preguntas": F.coalesce("preguntas", F.lit(0))})
    fits = F.when(F.col("_d").isNotNull(), F.col("_d") & (F.col("preguntas") == F.col("esperadas"))).alias("distribucion_ok")
    state = F.when(F.col("preguntas") == 0, "error").otherwise("ok").alias("estado")
    return both.select("exam_identifier", state, "esperadas", "preguntas", fits, *(f"{r}_ok" for r in RULES[1:]))


def _totals(audited: DataFrame) -> DataFrame:
    return audited.agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("estado") == "error").alias("errores"), *(F.count_if(f"{r}_ok").alias(r) for r in RULES))


def rates(audited: DataFrame) -> DataFrame:
    """(regla, validos, examenes, tasa): share of all exams, those in error among them, for which each rule holds; percent, one decimal."""
    rows = F.array(*(F.struct(F.lit(r).alias("regla"), F.col(r).alias("validos")) for r in RULES))
    return _totals(audited).select("n", F.inline(rows)).select("regla", "validos", F.col("n").alias("examenes"), N.percent(F.col("validos"), F.col("n"), 1).alias("tasa"))


def gate(audited: DataFrame) -> DataFrame:
    """(errores, fallos, pasa): exams in error, and with them the exams that break a rule, counted per rule and summed; passes at 0."""
    broken = sum((F.col("n") - F.col("errores") - F.col(r) for r in RULES), F.col("errores"))
    return _totals(audited).select("errores", broken.alias("fallos"), (broken == 0).alias("pasa"))


def report(questions: DataFrame, audited: DataFrame, quotas: dict[int, int]) -> DataFrame:
    """(seccion, exam_identifier, linea): the audit as lines of a console report.

    Sections: resumen (exams valid and faulty by each rule), error (exams in error), one per rule with what breaks it, exam
    by exam and question by question, and tasa (the rates).
    """
    def lines(df: DataFrame, section: str, *parts: Column | str, exam: Column | None = None) -> DataFrame:
        text_ = [F.lit(p) if isinstance(p, str) else F.coalesce(p.cast("string"), F.lit("-")) for p in parts]
        return df.select(F.lit(section).alias("seccion"), (F.col("exam_identifier") if exam is None else exam).alias("exam_identifier"), F.concat(*text_).alias("linea"))

    none = F.lit(None).cast("string")
    named = questions.where(F.col("exam_identifier").isNotNull())
    one = _totals(audited)
    summary = one.select("n", "errores", F.inline(F.array(*(F.struct(F.lit(r).alias("regla"), F.col(r).alias("validos")) for r in RULES))))
    rate = rates(audited)
    shown = F.concat(F.rpad("regla", 12, " "), F.lpad(F.col("validos").cast("string"), 6, " "), F.lit("/"), F.rpad(F.col("examenes").cast("string"), 6, " "), F.lpad(N.one_decimal(F.col("tasa")), 6, " "), F.lit(" %"))
    place = (F.col("categoria"), " | ", F.col("numero_pregunta"), " | ")
    keys = F.coalesce(F.nullif(F.array_join(_keys(), ", "), F.lit("")), F.lit("ninguna"))
    parts = [
        lines(summary, "resumen", F.col("regla"), ": ", F.col("validos"), " validos, ", F.col("n") - F.col("errores") - F.col("validos"), " con fallos, ", F.col("errores"), " con errores, ", F.col("n"), " en total", exam=none),
        lines(audited.where("estado = 'error'"), "error", "sin preguntas"),
        lines(audited.where("not distribucion_ok"), "distribucion", F.col("preguntas"), " preguntas, esperadas ", F.col("esperadas")),
        lines(quota_gaps(questions, quotas).where("diferencia <> 0"), "distribucion", "categoria ", F.col("cat"), ": ", F.col("hay"), " de ", F.col("oficial"), " (", N.signed(F.col("diferencia")), ")"),
        lines(named.withColumn("_i", option_issue()).where("_i is not null"), "opciones", *place, keys, " | ", F.col("_i")),
        lines(named.withColumn("_i", answer_issue()).where("_i is not null"), "respuestas", *place, F.col("respuesta_correcta"), " | ", keys, " | ", F.col("_i")),
        lines(named.withColumn("_i", F.array_join(missing_parts(), ",")).where("_i <> ''"), "estructura", *place, F.col("_i")),
        lines(repeated_numbers(questions), "numeros", F.col("numero_pregunta"), " | ", F.col("veces"), " veces | ", F.col("categorias")),
        lines(rate, "tasa", shown, exam=none),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def files(spark: SparkSession, folder: str, quotas: dict[int, int]) -> tuple[DataFrame, DataFrame]:
    """(questions, audited) of the exam files below a folder; an exam is its file, and its state is the reader's.

    ``audited`` is ``per_exam`` with the reader's complaint in ``error``. Files that cannot be read, of another form or
    without questions are exams in error.
    """
    yaml_bank.register(spark)
    source = spark.read.format("exam_yaml")
    state = source.option("errors", "true").load(folder)
    questions = source.option("errors", "false").load(folder).withColumn("exam_identifier", F.col("archivo"))
    audited = per_exam(questions, state.select(F.col("archivo").alias("exam_identifier"), "esperadas"), quotas)
    return questions, audited.join(state.select(F.col("archivo").alias("exam_identifier"), "error"), "exam_identifier", "left")
