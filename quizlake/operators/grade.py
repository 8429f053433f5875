"""Grading: all questions of an exam with their answers, results per question, exam and category, and rules with reasons.

Rules are tables, not code: the thresholds are the caller's.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quizlake.functions import answers as A
from quizlake.functions import numbers as N
from quizlake.functions import text


def last_answers(respuestas: DataFrame) -> DataFrame:
    """(exam_id, question_id, letra, segundos): the last answer to each question of an exam; equal times go by respuesta_id.

    Rows without exam or question are left out. Combined before the shuffle, for any number of answers.
    """
    rows = respuestas.where(F.col("exam_id").isNotNull() & F.col("question_id").isNotNull())
    last = rows.groupBy("exam_id", "question_id").agg(F.max_by(F.struct("letra", "segundos"), F.struct("respondida_at", "respuesta_id")).alias("_l"))
    return last.select("exam_id", "question_id", "_l.letra", "_l.segundos")


def from_json(rows: DataFrame, column: str = "value") -> DataFrame:
    """(exam_id, question_id, letra) of submissions written as JSON: {"exam_id": ..., "respuestas": {question: letter}}.

    What is no such JSON gives no rows; an answer of null stays.
    """
    parsed = F.from_json(F.col(column), "exam_id string, respuestas map<string,string>", {"mode": "PERMISSIVE"})
    return rows.select(parsed.alias("_s")).where("_s.exam_id is not null").select("_s.exam_id", F.explode("_s.respuestas").alias("question_id", "letra"))


def as_json(rows: DataFrame) -> DataFrame:
    """(value): every row as a JSON object, with its null fields."""
    return rows.select(F.to_json(F.struct("*"), {"ignoreNullFields": "false"}).alias("value"))


def exam_questions(preguntas: DataFrame, entregas: DataFrame) -> DataFrame:
    """(exam_id, question_id): what was asked in the submissions that name an exam of the bank.

    It is the exam's questions by their numbers, as many as the submission says (all if it says nothing); of several
    questions of one number the first by ``num`` is meant, so a submission never gets more rows than an exam has numbers.
    """
    known = F.col("exam_identifier").isNotNull()
    made = entregas.where(known & F.col("exam_id").isNotNull()).groupBy("exam_id").agg(F.min("exam_identifier").alias("exam_identifier"), F.max("num_preguntas").alias("_most"))
    numbered = preguntas.where(known & F.col("id").isNotNull() & F.col("numero_pregunta").isNotNull())
    numbered = numbered.groupBy("exam_identifier", "numero_pregunta").agg(F.min_by("id", F.struct("num", "id")).alias("question_id"))
    asked = made.join(numbered, "exam_identifier").where(F.col("_most").isNull() | (F.col("numero_pregunta") <= F.col("_most")))
    return asked.select("exam_id", "question_id").distinct()


def exam_rows(respuestas: DataFrame, asked: DataFrame) -> DataFrame:
    """(exam_id, question_id, letra, segundos): every question of every exam with its last answer, nulls if there is none.

    The questions of an exam are those of ``asked`` (exam_id, question_id) and those that were answered in it. Both meet in
    one aggregate, combined before the shuffle, so neither a hot exam nor a hot question is one task's work.
    """
    columns = ("exam_id", "question_id", "letra", "segundos", "respondida_at", "respuesta_id")
    answers = respuestas.where(F.col("exam_id").isNotNull() & F.col("question_id").isNotNull()).select(*columns, F.lit(1).alias("_a"))
    empty = {f.name: f.dataType for f in respuestas.schema.fields}
    rest = asked.select("exam_id", "question_id", *(F.lit(None).cast(empty[c]).alias(c) for c in columns[2:]), F.lit(0).alias("_a"))
    last = answers.unionByName(rest).groupBy("exam_id", "question_id").agg(F.max_by(F.struct("letra", "segundos"), F.struct("_a", "respondida_at", "respuesta_id")).alias("_l"))
    return last.select("exam_id", "question_id", "_l.letra", "_l.segundos")


def exams(entregas: DataFrame) -> DataFrame:
    """(exam_id, tipo_examen): every exam once, of the smallest type if its rows differ."""
    return entregas.where(F.col("exam_id").isNotNull()).groupBy("exam_id").agg(F.min("tipo_examen").alias("tipo_examen"))


def graded(respuestas: DataFrame, preguntas: DataFrame, entregas: DataFrame, texts: bool = False) -> DataFrame:
    """Every question of every exam with its last answer and whether that is right; a question without an answer is wrong.

    (exam_id, question_id, letra, segundos, tipo_examen, categoria, respuesta_correcta, es_correcta), with ``texts`` also
    opciones and enunciado. Unknown exams and questions are left out; of repeated ones one row counts (the first by ``num``).
    The questions of an exam are ``exam_questions`` and all that were answered in it: what else it may have asked is not in
    the tables. A hot question is left to the adaptive skew join, which splits it.
    """
    kept = ("categoria", "respuesta_correcta", *(("opciones", "enunciado") if texts else ()))
    questions = preguntas.where(F.col("id").isNotNull()).groupBy("id").agg(F.min_by(F.struct(*kept), "num").alias("_q")).select(F.col("id").alias("question_id"), "_q.*")
    rows = exam_rows(respuestas, exam_questions(preguntas, entregas)).join(questions, "question_id").join(exams(entregas), "exam_id")
    first = ("exam_id", "question_id", "letra", "segundos", "tipo_examen")
    return rows.select(*first, *kept).withColumn("es_correcta", A.right(F.col("letra"), F.col("respuesta_correcta")))


def question_results(g: DataFrame) -> DataFrame:
    """One row per question of ``graded(texts=True)``, with the texts of the given and of the right answers.

    ``texto_respuesta`` is null if the letter, as it was given, is no option; ``texto_correcta`` says so in words. ``opciones``
    and ``textos_correctas`` are written as "letter: text" in the order of the letters, joined by " | ".
    """
    key = A.accepted(F.col("respuesta_correcta"))
    first = F.try_element_at(key, F.lit(1))
    return g.select(
        "exam_id",
        "question_id",
        "letra",
        F.try_element_at("opciones", F.col("letra")).alias("texto_respuesta"),
        F.array_join(key, ",").alias("letras_correctas"),
        first.alias("letra_correcta"),
        A.option_text(F.col("opciones"), first).alias("texto_correcta"),
        F.size(A.accepted_texts(F.col("opciones"), F.col("respuesta_correcta"))).alias("opciones_correctas"),
        A.written(A.accepted_texts(F.col("opciones"), F.col("respuesta_correcta"))).alias("textos_correctas"),
        A.voided(F.col("respuesta_correcta")).alias("anulada"),
        "es_correcta",
        "categoria",
        "enunciado",
        A.written(F.col("opciones")).alias("opciones"),
    )


def exam_summary(g: DataFrame, all_exams: DataFrame, pass_mark: float = 65.0) -> DataFrame:
    """(exam_id, tipo_examen, correctas, total, puntuacion, porcentaje, aprobado) of all exams.

    One without questions has 0/0, 0 percent, and is not passed. The mark is held against the unrounded share.
    """
    per = g.groupBy("exam_id").agg(F.count_if("es_correcta").alias("_k"), F.count(F.lit(1)).alias("_n"))
    rows = all_exams.select("exam_id", "tipo_examen").join(per, "exam_id", "left")
    rows = rows.select("exam_id", "tipo_examen", F.coalesce("_k", F.lit(0)).alias("correctas"), F.coalesce("_n", F.lit(0)).alias("total"))
    k, n = F.col("correctas"), F.col("total")
    passed = (n > 0) & (N.share(k, n) >= pass_mark)
    return rows.select("*", N.fraction(k, n).alias("puntuacion"), N.percent(k, n).alias("porcentaje"), passed.alias("aprobado"))


def by_category(g: DataFrame) -> DataFrame:
    """(exam_id, categoria, correctas, total, porcentaje); questions without a category count in no row."""
    per = g.where(F.col("categoria").isNotNull()).groupBy("exam_id", "categoria").agg(F.count_if("es_correcta").alias("correctas"), F.count(F.lit(1)).alias("total"))
    return per.withColumn("porcentaje", N.percent(F.col("correctas"), F.col("total")))


#: The category of the rule that counts all questions.
TOTAL = "total"
#: Kinds of exam that are passed by rules; all others are passed by their share.
BY_RULES = ("simulacro", "especifico")
# The reasons as they are worded.
REASON_TOTAL = "No alcanza el mínimo de {} respuestas correctas (obtenidas: {})"
REASON_CATEGORY = "No alcanza el mínimo en {}: {}/{} (mínimo requerido: {})"
REASON_SHARE = "No alcanza el porcentaje mínimo de {}% (obtenido: {}%)"


def checked(g: DataFrame, rules: DataFrame, by_rules: tuple[str, ...] = BY_RULES) -> DataFrame:
    """Every rule (orden, categoria, nombre, minimo) held against every exam that is passed by rules and has questions.

    (exam_id, orden, categoria, nombre, correctas, total, minimo, cumplido, avance, marca). The rule of the category TOTAL
    counts all questions; a category without any scores 0 of 0. ``avance`` and ``marca`` are the right answers and the minimum
    as percent of the questions, 0 if there are none. Each exam's counts are folded into one map by its categories and
    the table of rules is one array, so exams and rules are not joined and nothing reaches the driver.
    """
    rows = g.where(F.col("tipo_examen").isin(list(by_rules)))
    per = rows.groupBy("exam_id", "categoria").agg(F.count_if("es_correcta").alias("k"), F.count(F.lit(1)).alias("n"))
    named = F.when(F.col("categoria").isNotNull() & (F.col("categoria") != TOTAL), F.struct("categoria", F.struct("k", "n")))
    folded = per.groupBy("exam_id").agg(F.sum("k").alias("_k"), F.sum("n").alias("_n"), F.map_from_entries(F.collect_list(named)).alias("_c"))  # one entry per category
    table = rules.select(F.array_sort(F.collect_list(F.struct("orden", "categoria", "nombre", "minimo")))).scalar()
    each = folded.withColumn("_r", F.explode(table)).select("exam_id", "_k", "_n", F.try_element_at("_c", F.col("_r.categoria")).alias("_m"), "_r.*")
    whole = F.col("categoria") == TOTAL
    count = lambda all_, one: F.when(whole, F.col(all_)).otherwise(F.coalesce(F.col(f"_m.{one}"), F.lit(0)))
    each = each.select("exam_id", "orden", "categoria", "nombre", count("_k", "k").alias("correctas"), count("_n", "n").alias("total"), "minimo")
    progress = {"avance": N.percent(F.col("correctas"), F.col("total")), "marca": N.percent(F.col("minimo"), F.col("total"))}
    return each.withColumn("cumplido", F.col("correctas") >= F.col("minimo")).withColumns(progress)


def verdicts(summary: DataFrame, checks: DataFrame, by_rules: tuple[str, ...] = BY_RULES, pass_mark: float = 65.0) -> DataFrame:
    """(exam_id, por_reglas, cumplidos, requisitos, aprobado, motivos) of every exam of ``exam_summary``.

    By rules: passed if no rule failed, with a reason for each that did, in the rules' order. Other kinds: passed by their
    share. Reasons are joined by "; ", null if there are none. An exam without questions is not passed and has no reasons.
    """
    write = lambda form, *values: F.format_string(form.replace("{}", "%s"), *(v.cast("string") for v in values))
    k, n, m = F.col("correctas"), F.col("total"), F.col("minimo")
    reason = F.when(F.col("categoria") == TOTAL, write(REASON_TOTAL, m, k)).otherwise(write(REASON_CATEGORY, F.col("nombre"), k, n, m))
    per = checks.groupBy("exam_id").agg(
        F.count_if("cumplido").alias("_ok"),
        F.count(F.lit(1)).alias("_all"),
        F.array_sort(F.collect_list(F.when(~F.col("cumplido"), F.struct("orden", reason.alias("m"))))).alias("_m"),  # one per rule at most
    )
    rows = summary.join(per, "exam_id", "left")
    ruled = F.coalesce(F.col("tipo_examen").isin(list(by_rules)), F.lit(False))
    low = F.format_string(REASON_SHARE.replace("%", "%%").replace("{}", "%s"), F.lit(str(float(pass_mark))), N.one_decimal(N.share(k, n)))
    reasons = F.when(ruled, F.when(F.size("_m") > 0, F.array_join(F.transform("_m", lambda x: x["m"]), "; "))).otherwise(F.when((n > 0) & ~F.col("aprobado"), low))
    passed = F.when(ruled, (n > 0) & (F.coalesce("_ok", F.lit(0)) == F.coalesce("_all", F.lit(0)))).otherwise(F.col("aprobado"))
    return rows.select("exam_id", ruled.alias("por_reglas"), F.coalesce("_ok", F.lit(0)).alias("cumplidos"), F.coalesce("_all", F.lit(0)).alias("requisitos"), passed.alias("aprobado"), reasons.alias("motivos"))


def result_documents(g: DataFrame, all_exams: DataFrame, pass_mark: float = 65.0) -> DataFrame:
    """(exam_id, value): each exam's result as one JSON document, with its summary and its categories.

    The categories of an exam are collected into one array: as many as the bank has.
    """
    per = by_category(g).groupBy("exam_id").agg(F.array_sort(F.collect_list(F.struct("categoria", "correctas", "total", "porcentaje"))).alias("categorias"))
    rows = exam_summary(g, all_exams, pass_mark).join(per, "exam_id", "left").withColumn("categorias", F.coalesce("categorias", F.array().cast(per.schema["categorias"].dataType)))
    return rows.select("exam_id", F.to_json(F.struct("exam_id", "puntuacion", "porcentaje", "aprobado", "categorias")).alias("value"))


def _marked(g: DataFrame, helped: DataFrame) -> DataFrame:
    rows = helped.select("exam_id", "question_id").distinct().withColumn("_h", F.lit(True))
    return g.join(rows, ["exam_id", "question_id"], "left").withColumn("_h", F.col("_h").isNotNull())


def help_usage(g: DataFrame, helped: DataFrame) -> DataFrame:
    """(exam_id, sin_ayuda, con_ayuda, incorrectas): right answers by whether (exam_id, question_id) is among ``helped``."""
    right, h = F.col("es_correcta"), F.col("_h")
    return _marked(g, helped).groupBy("exam_id").agg(F.count_if(right & ~h).alias("sin_ayuda"), F.count_if(right & h).alias("con_ayuda"), F.count_if(~right).alias("incorrectas"))


def unanswered(g: DataFrame) -> DataFrame:
    """(exam_id, sin_responder, total) of exams with questions whose answer is blank or was never given."""
    per = g.groupBy("exam_id").agg(F.count_if(text.blank(F.col("letra"))).alias("sin_responder"), F.count(F.lit(1)).alias("total"))
    return per.where("sin_responder > 0")


def option_marks(g: DataFrame, helped: DataFrame) -> DataFrame:
    """One row per option of every question of ``graded(texts=True)``: (exam_id, question_id, opcion, correcta, mal_elegida, ayudada).

    An option was chosen if the answer is its letter as it stands. ``ayudada``: chosen, in a question that is among ``helped``.
    """
    key = A.accepted(F.col("respuesta_correcta"))
    rows = _marked(g, helped).select("exam_id", "question_id", "letra", "_h", key.alias("_k"), "es_correcta", F.explode("opciones").alias("opcion", "texto"))
    chosen = F.coalesce(F.col("letra") == F.col("opcion"), F.lit(False))
    return rows.select("exam_id", "question_id", "opcion", F.array_contains("_k", F.col("opcion")).alias("correcta"), (chosen & ~F.col("es_correcta")).alias("mal_elegida"), (chosen & F.col("_h")).alias("ayudada"))


def masked(rows: DataFrame, kind: Column, shown: tuple[str, ...] = ("normal", "per")) -> DataFrame:
    """``rows`` with the answer key only where the kind of exam shows it."""
    return rows.withColumn("respuesta_correcta", F.when(kind.isin(*shown), F.col("respuesta_correcta")))
