"""Queries over question banks and exam results, with their SQL.

Bindings: the bank is ``preguntas``, the catalogue ``examenes``, graded exams are ``respuestas`` with ``entregas``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quizlake.functions import answers as A
from quizlake.functions import numbers as N
from quizlake.functions import text
from quizlake.operators import audit, bank, grade, sample, sessions
from quizlake.session import table

# Questions per category of a mock exam.
QUOTAS = {1: 4, 2: 2, 3: 4, 4: 2, 5: 5, 6: 10, 7: 2, 8: 3, 9: 4, 10: 5, 11: 4}
#: (orden, categoria, nombre, minimo) as the queries use them.
RULES = [(0, grade.TOTAL, "Total", 10), (1, "6", "Reglamento", 2), (2, "5", "Balizas", 1), (3, "11", "Carta", 1)]
PASS_MARK = 45.0
EXAM = "galicia_2023_junio_test02"
BAD_KEYS = ["sinpartes", "murcia_mmxx_mayo_test09", "a_2020_b_c_d", "", "LAS PALMAS_2021_junio_x"]
#: Seconds from which an answer counts as given with help.
HELPED = 90


def _q(name: str):  # noqa: ANN202
    return lambda spark, sf_dir: table(spark, sf_dir, name)


_bank, _exams = _q("preguntas"), _q("examenes")


def _graded(spark: SparkSession, sf_dir: str, texts: bool = False) -> DataFrame:
    return grade.graded(table(spark, sf_dir, "respuestas"), _bank(spark, sf_dir), table(spark, sf_dir, "entregas"), texts)


def _helped(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "respuestas").where(F.col("segundos") >= HELPED)


def _summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return grade.exam_summary(_graded(spark, sf_dir), grade.exams(table(spark, sf_dir, "entregas")), PASS_MARK)


def _audited(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = _exams(spark, sf_dir).select("exam_identifier", F.col("total_questions").alias("esperadas"))
    return audit.per_exam(_bank(spark, sf_dir), files, QUOTAS)


def bank_stats(spark, sf_dir):  # noqa: ANN001, ANN201
    return bank.stats(_bank(spark, sf_dir))


def count_by_category(spark, sf_dir):  # noqa: ANN001, ANN201
    return bank.by_category(_bank(spark, sf_dir))


def category_names(spark, sf_dir):  # noqa: ANN001, ANN201
    return bank.category_names(_bank(spark, sf_dir))


def available_years(spark, sf_dir):  # noqa: ANN001, ANN201
    return bank.distinct_values(_bank(spark, sf_dir), "anio")


def available_years_descending(spark, sf_dir):  # noqa: ANN001, ANN201
    return bank.distinct_values(_exams(spark, sf_dir), "anio", ascending=False)


def available_communities(spark, sf_dir):  # noqa: ANN001, ANN201
    return bank.distinct_values(_bank(spark, sf_dir), "community")


def filter_by_criteria(spark, sf_dir):  # noqa: ANN001, ANN201
    return bank.chosen(_bank(spark, sf_dir), ["5", "6"], [2019, 2020, 2023], ["Galicia", "Valencia"]).select("num", "id", "categoria", "anio", "comunidad_autonoma")


def filter_no_criteria(spark, sf_dir):  # noqa: ANN001, ANN201
    return bank.chosen(_bank(spark, sf_dir), [], None, []).agg(F.count(F.lit(1)).alias("preguntas"))


def unknown_communities(spark, sf_dir):  # noqa: ANN001, ANN201
    wanted = spark.createDataFrame([("Galicia",), ("Atlantis",), ("Narnia",)], "community string")
    return bank.unknown(wanted, _bank(spark, sf_dir))


def catalogue_hierarchy(spark, sf_dir):  # noqa: ANN001, ANN201
    return bank.catalogue(_exams(spark, sf_dir))


def calls_for_community_year(spark, sf_dir):  # noqa: ANN001, ANN201
    return bank.calls(_exams(spark, sf_dir), "Galicia", 2023)


def available_tests(spark, sf_dir):  # noqa: ANN001, ANN201
    return bank.exams(_exams(spark, sf_dir), F.col("exam_identifier"))


def exam_id_parse(spark, sf_dir):  # noqa: ANN001, ANN201
    keys = _exams(spark, sf_dir).select("exam_identifier").unionByName(spark.createDataFrame([(k,) for k in BAD_KEYS], "exam_identifier string"))
    return keys.select("exam_identifier", text.parsed_key(F.col("exam_identifier")).alias("p")).select("exam_identifier", "p.*")


def specific_exam(spark, sf_dir):  # noqa: ANN001, ANN201
    return sample.specific_exam(_bank(spark, sf_dir), EXAM, "specific_00000000").drop("enunciado")


def content_hash(spark, sf_dir):  # noqa: ANN001, ANN201
    return _bank(spark, sf_dir).select("num", text.content_hash(F.col("enunciado"), F.col("opciones")).alias("contenido"))


def duplicate_groups(spark, sf_dir):  # noqa: ANN001, ANN201
    return sample.repeat_groups(_bank(spark, sf_dir)).select("contenido", "copias", "claves")


def duplicate_details(spark, sf_dir):  # noqa: ANN001, ANN201
    return sample.repeat_details(_bank(spark, sf_dir))


def duplicates_by_community(spark, sf_dir):  # noqa: ANN001, ANN201
    return sample.repeats(_bank(spark, sf_dir), "community")


def duplicates_by_year(spark, sf_dir):  # noqa: ANN001, ANN201
    return sample.repeats(_bank(spark, sf_dir), "anio")


def unique_sample_seeded(spark, sf_dir):  # noqa: ANN001, ANN201
    return sample.unique_sample(_bank(spark, sf_dir), 45, 42)


def mock_exam_seeded(spark, sf_dir):  # noqa: ANN001, ANN201
    return sample.quota_exam(_bank(spark, sf_dir), QUOTAS, 42)


def flat_exam(spark, sf_dir):  # noqa: ANN001, ANN201
    """A flat exam of 45 questions with its answer keys; options written in the order of their letters."""
    got = sample.flat_exam(_bank(spark, sf_dir), 45, "per_00000000", "per", 42)
    return got.withColumn("opciones", A.written(F.col("opciones")))


def mock_exam(spark, sf_dir):  # noqa: ANN001, ANN201
    """A mock exam by the official quotas, without answer keys."""
    return sample.mock_exam(_bank(spark, sf_dir), QUOTAS, "simulacro_00000000", 42).withColumn("opciones", A.written(F.col("opciones")))


def nested_catalogue(spark, sf_dir):  # noqa: ANN001, ANN201
    """The nested catalogue, written as one line per community, year and call."""
    nested = bank.nested_catalogue(_exams(spark, sf_dir))
    calls = nested.select("community", F.explode("anios").alias("anio", "_c")).select("community", "anio", F.explode("_c").alias("convocatoria", "_p"))
    return calls.select("community", "anio", "convocatoria", F.array_join("_p", ",").alias("pruebas"))


def sample_feasibility(spark, sf_dir):  # noqa: ANN001, ANN201
    return sample.feasibility(_bank(spark, sf_dir), {**QUOTAS, 12: 3, 2: 5_000})


def client_projection_masked(spark, sf_dir):  # noqa: ANN001, ANN201
    return grade.masked(_graded(spark, sf_dir), F.col("tipo_examen")).select("exam_id", "question_id", "tipo_examen", "respuesta_correcta")


def last_answer_wins(spark, sf_dir):  # noqa: ANN001, ANN201
    return grade.last_answers(table(spark, sf_dir, "respuestas"))


def answer_correct(spark, sf_dir):  # noqa: ANN001, ANN201
    return _graded(spark, sf_dir).select("exam_id", "question_id", "letra", "respuesta_correcta", "es_correcta")


def correct_answer_list(spark, sf_dir):  # noqa: ANN001, ANN201
    key = A.accepted(F.col("respuesta_correcta"))
    first = F.try_element_at(key, F.lit(1))
    return _bank(spark, sf_dir).select("num", F.array_join(key, ",").alias("letras"), first.alias("primera"), A.option_text(F.col("opciones"), first).alias("texto"))


def question_results(spark, sf_dir):  # noqa: ANN001, ANN201
    return grade.question_results(_graded(spark, sf_dir, texts=True))


def grade_exam_summary(spark, sf_dir):  # noqa: ANN001, ANN201
    return _summary(spark, sf_dir)


def grade_by_category(spark, sf_dir):  # noqa: ANN001, ANN201
    return grade.by_category(_graded(spark, sf_dir))


def _rules(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(RULES, "orden int, categoria string, nombre string, minimo int")


def requirements_check(spark, sf_dir):  # noqa: ANN001, ANN201
    return grade.checked(_graded(spark, sf_dir), _rules(spark))


def _verdicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return grade.verdicts(_summary(spark, sf_dir), requirements_check(spark, sf_dir), pass_mark=PASS_MARK)


def pass_fail_special(spark, sf_dir):  # noqa: ANN001, ANN201
    return _verdicts(spark, sf_dir).select("exam_id", "por_reglas", "cumplidos", "requisitos", "aprobado")


def failure_reasons(spark, sf_dir):  # noqa: ANN001, ANN201
    return _verdicts(spark, sf_dir).select("exam_id", "motivos")


def help_usage_stats(spark, sf_dir):  # noqa: ANN001, ANN201
    return grade.help_usage(_graded(spark, sf_dir), _helped(spark, sf_dir))


def unanswered(spark, sf_dir):  # noqa: ANN001, ANN201
    return grade.unanswered(_graded(spark, sf_dir))


def option_annotations(spark, sf_dir):  # noqa: ANN001, ANN201
    return grade.option_marks(_graded(spark, sf_dir, texts=True), _helped(spark, sf_dir))


def dq_options(spark, sf_dir):  # noqa: ANN001, ANN201
    return audit.options(_bank(spark, sf_dir))


def dq_answers(spark, sf_dir):  # noqa: ANN001, ANN201
    return audit.answers(_bank(spark, sf_dir))


def dq_structure(spark, sf_dir):  # noqa: ANN001, ANN201
    return audit.structure(_bank(spark, sf_dir))


def dq_unique_ids(spark, sf_dir):  # noqa: ANN001, ANN201
    return audit.repeated_numbers(_bank(spark, sf_dir))


def dq_histogram(spark, sf_dir):  # noqa: ANN001, ANN201
    return audit.histogram(_bank(spark, sf_dir))


def dq_distribution(spark, sf_dir):  # noqa: ANN001, ANN201
    return audit.distribution(_bank(spark, sf_dir), QUOTAS)


def dq_quota_gaps(spark, sf_dir):  # noqa: ANN001, ANN201
    return audit.quota_gaps(_bank(spark, sf_dir), QUOTAS)


def dq_per_exam(spark, sf_dir):  # noqa: ANN001, ANN201
    return _audited(spark, sf_dir)


def dq_rates(spark, sf_dir):  # noqa: ANN001, ANN201
    return audit.rates(_audited(spark, sf_dir))


def dq_gate(spark, sf_dir):  # noqa: ANN001, ANN201
    return audit.gate(_audited(spark, sf_dir))


def dq_report(spark, sf_dir):  # noqa: ANN001, ANN201
    return audit.report(_bank(spark, sf_dir), _audited(spark, sf_dir), QUOTAS)


def active_exams(spark, sf_dir):  # noqa: ANN001, ANN201
    return sessions.active(table(spark, sf_dir, "entregas"), F.lit("2025-06-01 12:00:00").cast("timestamp_ntz"), "30 days")


def active_exam_count(spark, sf_dir):  # noqa: ANN001, ANN201
    return sessions.active_count(table(spark, sf_dir, "entregas"), F.lit("2025-06-01 12:00:00").cast("timestamp_ntz"), "30 days")


def duplicate_report(spark, sf_dir):  # noqa: ANN001, ANN201
    return sample.repeat_report(_bank(spark, sf_dir), 10)


def category_display(spark, sf_dir):  # noqa: ANN001, ANN201
    names = {str(c): f"Tema {c}" for c in QUOTAS}
    return _bank(spark, sf_dir).where("categoria is not null").select("categoria").distinct().select("categoria", text.display_name(F.col("categoria"), names).alias("nombre"))


def answers_round_trip(spark, sf_dir):  # noqa: ANN001, ANN201
    """Answers written as one JSON document per answer and read back."""
    one = grade.last_answers(table(spark, sf_dir, "respuestas")).select("exam_id", F.create_map("question_id", "letra").alias("respuestas"))
    return grade.from_json(grade.as_json(one))


def consume_once(spark, sf_dir):  # noqa: ANN001, ANN201
    return sessions.used_up(table(spark, sf_dir, "entregas"), "45 minutes")


def elapsed_format(spark, sf_dir):  # noqa: ANN001, ANN201
    seconds = F.unix_timestamp(F.date_trunc("second", F.col("enviada_at").cast("timestamp"))) - F.unix_timestamp(F.date_trunc("second", F.col("creada_at").cast("timestamp")))
    return table(spark, sf_dir, "entregas").where("enviada_at is not null").select("exam_id", N.minutes_seconds(seconds).alias("duracion"))


def progress(spark, sf_dir):  # noqa: ANN001, ANN201
    """Share of each submission's questions that were answered, and of its longest exam, in percent."""
    answered = grade.last_answers(table(spark, sf_dir, "respuestas")).where(~text.blank(F.col("letra"))).groupBy("exam_id").agg(F.count(F.lit(1)).alias("respondidas"))
    made = table(spark, sf_dir, "entregas").groupBy("exam_id").agg(F.max("num_preguntas").alias("num_preguntas"))
    return made.join(answered, "exam_id", "left").select("exam_id", F.coalesce("respondidas", F.lit(0)).alias("respondidas"), N.percent(F.coalesce("respondidas", F.lit(0)), F.coalesce("num_preguntas", F.lit(0))).alias("avance"))


_NAMES = """bank_stats count_by_category category_names available_years available_years_descending available_communities filter_by_criteria
filter_no_criteria unknown_communities catalogue_hierarchy calls_for_community_year available_tests exam_id_parse specific_exam content_hash
duplicate_groups duplicate_details duplicates_by_community duplicates_by_year unique_sample_seeded mock_exam_seeded flat_exam mock_exam nested_catalogue sample_feasibility
client_projection_masked last_answer_wins answer_correct correct_answer_list question_results grade_exam_summary grade_by_category
requirements_check pass_fail_special failure_reasons help_usage_stats unanswered option_annotations dq_options dq_answers dq_structure
dq_unique_ids dq_histogram dq_distribution dq_quota_gaps dq_per_exam dq_rates dq_gate dq_report active_exams active_exam_count duplicate_report category_display answers_round_trip consume_once elapsed_format progress""".split()
QUERIES = {n: globals()[n] for n in _NAMES}

# ---- SQL

_S = text.SPACE
_STRIP = lambda x: f"regexp_replace({x}, '^{_S}+|{_S}+$', '', 'g')"
_COLLAPSE = lambda x: f"regexp_replace({_STRIP(x)}, '{_S}+', ' ', 'g')"
_BLANK = lambda x: f"(coalesce({_STRIP(x)}, '') = '')"
_HASH = (
    "sha256(array_to_string(list_concat([" + _COLLAPSE("coalesce(enunciado, '')") + "], list_sort(list_transform(coalesce(map_values(opciones), []), lambda x: " + _COLLAPSE("coalesce(x, '')") + "))), '||'))"
)
_KEY = lambda k: f"case when {k} is null then [] when lower({k}) = 'anulada' then ['a','b','c','d'] when contains({k}, ',') then list_transform(string_split(lower({k}), ','), lambda x: {_STRIP('x')}) else [lower({k})] end"
_RIGHT = f"(case when {_BLANK('letra')} then false when lower(coalesce(respuesta_correcta, '')) = 'anulada' then true else list_contains({_KEY('respuesta_correcta')}, lower(letra)) end)"
_TEXT = lambda k: f"coalesce(opciones[{k}], 'Opción no encontrada')"
_ANSWERED = "exam_id is not null and question_id is not null"
_LAST = f"""(select exam_id, question_id, l.letra as letra, l.segundos as segundos from (
  select exam_id, question_id, arg_max({{'letra': letra, 'segundos': segundos}}, {{'t': respondida_at, 'r': respuesta_id}}) as l
  from respuestas where {_ANSWERED} group by exam_id, question_id))"""
_ASKED = """(select distinct m.exam_id, n.question_id
  from (select exam_id, min(exam_identifier) as x, max(num_preguntas) as most from entregas
        where exam_id is not null and exam_identifier is not null group by exam_id) m
  join (select exam_identifier, numero_pregunta, arg_min(id, {'n': num, 'i': id}) as question_id from preguntas
        where exam_identifier is not null and id is not null and numero_pregunta is not null group by exam_identifier, numero_pregunta) n
  on n.exam_identifier = m.x and (m.most is null or n.numero_pregunta <= m.most))"""
_ROWS = f"""(select exam_id, question_id, l.letra as letra, l.segundos as segundos from (
  select exam_id, question_id, arg_max({{'letra': letra, 'segundos': segundos}}, {{'a': a, 't': respondida_at, 'r': respuesta_id}}) as l from (
    select exam_id, question_id, letra, segundos, respondida_at, respuesta_id, 1 as a from respuestas where {_ANSWERED}
    union all select exam_id, question_id, null, null, null, null, 0 from {_ASKED}) group by exam_id, question_id))"""
_EXAMS = "(select exam_id, min(tipo_examen) as tipo_examen from entregas where exam_id is not null group by exam_id)"
_QUESTIONS = """(select id, q.* from (
  select id, arg_min({'categoria': categoria, 'respuesta_correcta': respuesta_correcta, 'opciones': opciones, 'enunciado': enunciado}, num) as q
  from preguntas where id is not null group by id))"""
_GRADED = f"""(select *, {_RIGHT} as es_correcta from (
  select a.exam_id, a.question_id, a.letra, a.segundos, e.tipo_examen, q.categoria, q.respuesta_correcta, q.opciones, q.enunciado
  from {_ROWS} a join {_EXAMS} e on e.exam_id = a.exam_id join {_QUESTIONS} q on q.id = a.question_id))"""
_SUMMARY = f"""(select e.exam_id, e.tipo_examen, coalesce(k, 0) as correctas, coalesce(n, 0) as total, coalesce(k / n * 100, 0.0) as parte
  from {_EXAMS} e left join (select exam_id, count(*) filter (es_correcta) as k, count(*) as n from {_GRADED} group by exam_id) g on g.exam_id = e.exam_id)"""
_WRITTEN = lambda m: f"array_to_string(list_transform(list_sort(map_entries({m})), lambda e: e.key || ': ' || coalesce(e.value, '')), ' | ')"
_HELPED = f"(select distinct exam_id, question_id from respuestas where segundos >= {HELPED})"
_KEYS = "list_sort(coalesce(map_keys(opciones), []))"
_ISSUE_O = f"case when len({_KEYS}) = 0 then 'ninguna' when len({_KEYS}) < 4 then 'faltan' when len({_KEYS}) > 4 then 'sobran' when {_KEYS} <> ['a','b','c','d'] then 'distintas' end"
_PARTS = f"case when contains(respuesta_correcta, ',') then list_transform(string_split(lower(respuesta_correcta), ','), lambda x: {_STRIP('x')}) else [lower(respuesta_correcta)] end"
_ISSUE_A = f"case when {_BLANK('respuesta_correcta')} then 'vacia' when lower(respuesta_correcta) = 'anulada' then null when len(list_filter({_PARTS}, lambda x: not list_contains({_KEYS}, x))) > 0 then 'desconocida' end"
_MISSING = f"""array_to_string(list_concat(
  list_filter([case when {_BLANK('enunciado')} then 'enunciado' end, case when len({_KEYS}) = 0 then 'opciones' end, case when {_BLANK('respuesta_correcta')} then 'respuesta_correcta' end], lambda x: x is not null),
  list_sort(list_transform(list_filter({_KEYS}, lambda k: {_BLANK('opciones[k]')}), lambda k: 'opcion_' || k))), ',')"""
_CAT = "try_cast(categoria as int)"
_RULE_NAMES = ("distribucion", "opciones", "respuestas", "estructura", "numeros")
_PER_EXAM = f"""(select coalesce(x.exam_identifier, p.exam_identifier) as exam_identifier, case when coalesce(preguntas, 0) = 0 then 'error' else 'ok' end as estado,
  coalesce(esperadas, 45) as esperadas, coalesce(preguntas, 0) as preguntas, case when d is not null then d and preguntas = coalesce(esperadas, 45) end as distribucion_ok,
  opciones_ok, respuestas_ok, estructura_ok, numeros_ok
  from (select exam_identifier, max(total_questions) as esperadas from examenes where exam_identifier is not null group by exam_identifier) x
  full join (
    select exam_identifier, cast(sum(n) as bigint) as preguntas, bool_and(o) as opciones_ok, bool_and(a) as respuestas_ok, bool_and(s) as estructura_ok,
           bool_and(numero_pregunta is null or n = 1) as numeros_ok, {" and ".join(f"sum(c{c}) = {q}" for c, q in QUOTAS.items())} as d
    from (select exam_identifier, numero_pregunta, count(*) as n, bool_and({_ISSUE_O} is null) as o, bool_and({_ISSUE_A} is null) as a, bool_and({_MISSING} = '') as s,
                 {", ".join(f"count(*) filter ({_CAT} = {c}) as c{c}" for c in QUOTAS)}
          from preguntas where exam_identifier is not null group by exam_identifier, numero_pregunta)
    group by exam_identifier) p on p.exam_identifier = x.exam_identifier)"""
_RATES = "(" + " union all ".join(
    f"select '{c}' as regla, count(*) filter ({c}_ok) as validos, count(*) as examenes, "
    f"case when count(*) = 0 then 0.0 else round_even(count(*) filter ({c}_ok) / count(*) * 100, 1) end as tasa from audited" for c in _RULE_NAMES
) + ")"
_GATE = f"""(select count(*) filter (estado = 'error') as errores,
  count(*) filter (estado = 'error') + {" + ".join(f"count(*) filter (not {c}_ok)" for c in _RULE_NAMES)} as fallos from audited)"""
_AUDITED = f"with audited as materialized {_PER_EXAM} "
_CHECKED = "(" + " union all ".join(
    f"select exam_id, {o} as orden, '{c}' as categoria, '{n}' as nombre, count(*) filter ({w} and es_correcta) as correctas, count(*) filter ({w}) as total, {m} as minimo, "
    f"count(*) filter ({w} and es_correcta) >= {m} as cumplido, "
    f"case when count(*) filter ({w}) = 0 then 0.0 else round_even(count(*) filter ({w} and es_correcta) / count(*) filter ({w}) * 100, 2) end as avance, "
    f"case when count(*) filter ({w}) = 0 then 0.0 else round_even({m} / count(*) filter ({w}) * 100, 2) end as marca "
    f"from {_GRADED} where tipo_examen in ('simulacro', 'especifico') group by exam_id"
    for o, c, n, m in RULES for w in ["true" if c == grade.TOTAL else f"categoria = '{c}'"]
) + ")"
_REASON = """case when categoria = 'total' then 'No alcanza el mínimo de ' || minimo || ' respuestas correctas (obtenidas: ' || correctas || ')'
  else 'No alcanza el mínimo en ' || nombre || ': ' || correctas || '/' || total || ' (mínimo requerido: ' || minimo || ')' end"""
_VERDICTS = f"""(select s.exam_id, coalesce(tipo_examen in ('simulacro', 'especifico'), false) as por_reglas, coalesce(ok, 0) as cumplidos, coalesce(todas, 0) as requisitos,
  case when coalesce(tipo_examen in ('simulacro', 'especifico'), false) then total > 0 and coalesce(ok, 0) = coalesce(todas, 0) else total > 0 and parte >= {PASS_MARK} end as aprobado,
  case when coalesce(tipo_examen in ('simulacro', 'especifico'), false) then m
       when total > 0 and parte < {PASS_MARK} then 'No alcanza el porcentaje mínimo de {PASS_MARK}% (obtenido: ' || printf('%.1f', round_even(parte, 1)) || '%)' end as motivos
  from {_SUMMARY} s left join (
    select exam_id, count(*) filter (cumplido) as ok, count(*) as todas, string_agg({_REASON}, '; ' order by orden) filter (not cumplido) as m
    from {_CHECKED} group by exam_id) c on c.exam_id = s.exam_id)"""
_UNIQUE = lambda by: f"(select {by} h, arg_min(num, {{'k': k, 'n': num}}) as num, min(k) as k from (select {by} num, {_HASH} as h, sha256('42|' || cast(num as varchar)) as k from src) group by {by} h)"
_QUOTA_ROWS = lambda q: ", ".join(f"({c}, {n})" for c, n in q.items())
_KEYS_SQL = "select exam_identifier from examenes union all select unnest([" + ", ".join(f"'{k}'" for k in BAD_KEYS) + "])"
_PARSE = "string_split(coalesce(exam_identifier, ''), '_')"
_OK = f"(len({_PARSE}) = 4 and try_cast({_PARSE}[2] as int) is not null)"

_GAPS = f"with q(cat, oficial) as (values {_QUOTA_ROWS(QUOTAS)}), x as (select distinct exam_identifier from preguntas where exam_identifier is not null), h as (select exam_identifier, {_CAT} as cat, count(*) as n from preguntas group by all) select x.exam_identifier, q.cat, q.oficial, coalesce(n, 0) as hay, coalesce(n, 0) - q.oficial as diferencia from x cross join q left join h on h.exam_identifier = x.exam_identifier and h.cat = q.cat"
_NUMBERS = "select exam_identifier, numero_pregunta, count(*) as veces, coalesce(string_agg(distinct categoria, ',' order by categoria), '') as categorias from preguntas where exam_identifier is not null and numero_pregunta is not null group by exam_identifier, numero_pregunta having count(*) > 1"
_PLACE = "coalesce(categoria, '-') || ' | ' || coalesce(cast(numero_pregunta as varchar), '-') || ' | '"
_SHOWN_KEYS = f"case when len({_KEYS}) = 0 then 'ninguna' else array_to_string({_KEYS}, ', ') end"
_ONE_ROW = "(select distinct on (num) num, enunciado, opciones, respuesta_correcta, categoria from preguntas order by num)"
_FLAT = f"(select num, row_number() over (order by k, num) as posicion from (select * from {_UNIQUE('')} order by k, num limit 45))"
_MOCK = f"(select cat, num, row_number() over (order by cat, rn) as posicion from (select u.kat as cat, num, row_number() over (partition by u.kat order by k, num) as rn, cuota from {_UNIQUE('kat,')} u join q on q.cat = u.kat) where rn <= cuota)"

SQL = {
    "bank_stats": "select count(*) as preguntas, count(distinct coalesce(categoria, '')) as categorias, count(distinct anio) as anios, count(distinct community) as comunidades from preguntas",
    "count_by_category": "select coalesce(categoria, '') as categoria, count(*) as preguntas from preguntas group by 1",
    "category_names": f"select categoria as id, coalesce(arg_min(categoria_nombre, num) filter (not {_BLANK('categoria_nombre')}), 'Categoría ' || categoria) as nombre from preguntas where categoria is not null group by categoria",
    "available_years": "select distinct anio from preguntas where anio is not null order by anio",
    "available_years_descending": "select distinct anio from examenes where anio is not null order by anio desc",
    "available_communities": "select distinct community from preguntas where community is not null order by community",
    "filter_by_criteria": "select num, id, categoria, anio, comunidad_autonoma from preguntas where categoria in ('5', '6') and anio in (2019, 2020, 2023) and comunidad_autonoma in ('Galicia', 'Valencia')",
    "filter_no_criteria": "select count(*) as preguntas from preguntas",
    "unknown_communities": "select c as community from (values ('Galicia'), ('Atlantis'), ('Narnia')) v(c) where c not in (select community from preguntas where community is not null)",
    "catalogue_hierarchy": "select community, anio, convocatoria, coalesce(string_agg(distinct test_code, ',' order by test_code), '') as pruebas from examenes where community is not null and anio is not null and convocatoria is not null group by community, anio, convocatoria",
    "calls_for_community_year": "select distinct convocatoria from examenes where community = 'Galicia' and anio = 2023 and convocatoria is not null order by 1",
    "available_tests": "select id, f.title, f.subtitle, f.community, f.anio, f.convocatoria, f.test_code, f.total_questions from (select lower(community) || '_' || anio || '_' || convocatoria || '_' || test_code as id, arg_min({'title': title, 'subtitle': subtitle, 'community': community, 'anio': anio, 'convocatoria': convocatoria, 'test_code': test_code, 'total_questions': total_questions}, exam_identifier) as f from examenes group by 1) where id is not null",
    "exam_id_parse": f"select exam_identifier, case when len({_PARSE}) <> 4 then 'formato' when not {_OK} then 'anio' else 'ok' end as estado, case when {_OK} then upper({_PARSE}[1][1:1]) || lower({_PARSE}[1][2:]) end as community, case when {_OK} then try_cast({_PARSE}[2] as int) end as anio, case when {_OK} then {_PARSE}[3] end as convocatoria, case when {_OK} then {_PARSE}[4] end as test_code from ({_KEYS_SQL})",
    "specific_exam": "select 'specific_00000000_q' || posicion as id, posicion, num, numero_pregunta, categoria from (select *, row_number() over (order by coalesce(numero_pregunta, 0), num) as posicion from preguntas where community = 'Galicia' and anio = 2023 and convocatoria = 'junio' and test_code = 'test02')",
    "content_hash": f"select num, {_HASH} as contenido from preguntas",
    "duplicate_groups": f"select contenido, count(*) as copias, count(distinct lower(respuesta_correcta)) as claves from (select *, {_HASH} as contenido from preguntas) group by contenido having count(*) > 1",
    "duplicate_details": f"select substr(contenido, 1, 16) as hash, copias, case when length(muestra) > 80 then substr(muestra, 1, 80) || '...' else muestra end as muestra, claves from (select contenido, count(*) as copias, arg_min(enunciado, num) as muestra, count(distinct lower(respuesta_correcta)) as claves from (select *, {_HASH} as contenido from preguntas) group by contenido having count(*) > 1)",
    "duplicates_by_community": f"select community, count(*) as repetidas from (select community, row_number() over (partition by {_HASH} order by num) as rn from preguntas) where rn > 1 group by community",
    "duplicates_by_year": f"select anio, count(*) as repetidas from (select anio, row_number() over (partition by {_HASH} order by num) as rn from preguntas) where rn > 1 group by anio",
    "unique_sample_seeded": f"with src as (select * from preguntas where num is not null) select num, row_number() over (order by k, num) as posicion from (select * from {_UNIQUE('')} order by k, num limit 45)",
    "mock_exam_seeded": f"with src as (select *, {_CAT} as kat from preguntas where num is not null), q(cat, cuota) as (values {_QUOTA_ROWS(QUOTAS)}) select cat, num, row_number() over (order by cat, rn) as posicion from (select u.kat as cat, num, row_number() over (partition by u.kat order by k, num) as rn, cuota from {_UNIQUE('kat,')} u join q on q.cat = u.kat) where rn <= cuota",
    "flat_exam": f"with src as (select * from preguntas where num is not null) select 'per_00000000_q' || posicion as id, posicion, enunciado, {_WRITTEN('opciones')} as opciones, respuesta_correcta, categoria from {_FLAT} f join {_ONE_ROW} p on p.num = f.num",
    "mock_exam": f"with src as (select *, {_CAT} as kat from preguntas where num is not null), q(cat, cuota) as (values {_QUOTA_ROWS(QUOTAS)}) select 'simulacro_00000000_q' || posicion as id, posicion, f.num, cat, enunciado, {_WRITTEN('opciones')} as opciones from {_MOCK} f join {_ONE_ROW} p on p.num = f.num",
    "nested_catalogue": "select community, anio, convocatoria, coalesce(string_agg(distinct test_code, ',' order by test_code), '') as pruebas from examenes where community is not null and anio is not null and convocatoria is not null group by community, anio, convocatoria",
    "sample_feasibility": f"with q(cat, cuota) as (values {_QUOTA_ROWS({**QUOTAS, 12: 3, 2: 5_000})}), p as (select {_CAT} as cat, count(*) as n, count(distinct {_HASH}) as u from preguntas group by 1) select q.cat, q.cuota, coalesce(n, 0) as preguntas, coalesce(u, 0) as contenidos, case when coalesce(n, 0) < cuota then 'faltan_preguntas' when coalesce(u, 0) < cuota then 'faltan_contenidos' else 'ok' end as estado from q left join p on p.cat = q.cat",
    "client_projection_masked": f"select exam_id, question_id, tipo_examen, case when tipo_examen in ('normal', 'per') then respuesta_correcta end as respuesta_correcta from {_GRADED}",
    "last_answer_wins": f"select * from {_LAST}",
    "answer_correct": f"select exam_id, question_id, letra, respuesta_correcta, es_correcta from {_GRADED}",
    "correct_answer_list": f"select num, array_to_string(k, ',') as letras, k[1] as primera, {_TEXT('k[1]')} as texto from (select num, opciones, {_KEY('respuesta_correcta')} as k from preguntas)",
    "question_results": f"""select exam_id, question_id, letra, opciones[letra] as texto_respuesta, array_to_string(k, ',') as letras_correctas, k[1] as letra_correcta, {_TEXT('k[1]')} as texto_correcta,
      len(list_filter(map_keys(opciones), lambda x: list_contains(k, x))) as opciones_correctas,
      case when opciones is not null then array_to_string(list_transform(list_sort(list_filter(map_entries(opciones), lambda e: list_contains(k, e.key))), lambda e: e.key || ': ' || coalesce(e.value, '')), ' | ') end as textos_correctas,
      lower(coalesce(respuesta_correcta, '')) = 'anulada' as anulada, es_correcta, categoria, enunciado, {_WRITTEN('opciones')} as opciones
      from (select *, {_KEY('respuesta_correcta')} as k from {_GRADED})""",
    "grade_exam_summary": f"select exam_id, tipo_examen, correctas, total, correctas || '/' || total as puntuacion, round_even(parte, 2) as porcentaje, total > 0 and parte >= {PASS_MARK} as aprobado from {_SUMMARY}",
    "grade_by_category": f"select exam_id, categoria, k as correctas, n as total, round_even(k / n * 100, 2) as porcentaje from (select exam_id, categoria, count(*) filter (es_correcta) as k, count(*) as n from {_GRADED} where categoria is not null group by exam_id, categoria)",
    "requirements_check": f"select * from {_CHECKED}",
    "pass_fail_special": f"select exam_id, por_reglas, cumplidos, requisitos, aprobado from {_VERDICTS}",
    "failure_reasons": f"select exam_id, motivos from {_VERDICTS}",
    "help_usage_stats": f"select g.exam_id, count(*) filter (es_correcta and h.exam_id is null) as sin_ayuda, count(*) filter (es_correcta and h.exam_id is not null) as con_ayuda, count(*) filter (not es_correcta) as incorrectas from {_GRADED} g left join {_HELPED} h on h.exam_id = g.exam_id and h.question_id = g.question_id group by g.exam_id",
    "unanswered": f"select exam_id, count(*) filter ({_BLANK('letra')}) as sin_responder, count(*) as total from {_GRADED} group by exam_id having count(*) filter ({_BLANK('letra')}) > 0",
    "option_annotations": f"""select exam_id, question_id, e.key as opcion, list_contains(k, e.key) as correcta, coalesce(letra = e.key, false) and not es_correcta as mal_elegida,
      coalesce(letra = e.key, false) and ayuda as ayudada
      from (select g.exam_id, g.question_id, letra, es_correcta, h.exam_id is not null as ayuda, {_KEY('respuesta_correcta')} as k, unnest(map_entries(opciones)) as e
            from {_GRADED} g left join {_HELPED} h on h.exam_id = g.exam_id and h.question_id = g.question_id)""",
    "dq_options": f"select num, fallo, array_to_string(list_filter(['a','b','c','d'], lambda x: not list_contains(ks, x)), ',') as faltan, array_to_string(list_filter(ks, lambda x: not list_contains(['a','b','c','d'], x)), ',') as sobran from (select num, {_KEYS} as ks, {_ISSUE_O} as fallo from preguntas) where fallo is not null",
    "dq_answers": f"select num, respuesta_correcta, {_ISSUE_A} as fallo from preguntas where {_ISSUE_A} is not null",
    "dq_structure": f"select num, {_MISSING} as faltan from preguntas where {_MISSING} <> ''",
    "dq_unique_ids": _NUMBERS,
    "dq_histogram": "select exam_identifier, coalesce(categoria, '') as categoria, count(*) as preguntas from preguntas group by 1, 2",
    "dq_distribution": "select exam_identifier, total, cast(dif as bigint) as diferencia, iguales, iguales and total = " + str(sum(QUOTAS.values())) + " as cuadra from (select exam_identifier, count(*) as total, " + " + ".join(f"(count(*) filter ({_CAT} = {c}) - {q})" for c, q in QUOTAS.items()) + " as dif, " + " and ".join(f"count(*) filter ({_CAT} = {c}) = {q}" for c, q in QUOTAS.items()) + " as iguales from preguntas where exam_identifier is not null group by exam_identifier)",
    "dq_quota_gaps": _GAPS,
    "dq_per_exam": f"select * from {_PER_EXAM}",
    "dq_rates": _AUDITED + f"select * from {_RATES}",
    "dq_gate": _AUDITED + f"select errores, cast(fallos as bigint) as fallos, fallos = 0 as pasa from {_GATE}",
    "dq_report": _AUDITED
    + f"""select 'resumen' as seccion, null as exam_identifier, regla || ': ' || validos || ' validos, ' || (examenes - errores - validos) || ' con fallos, ' || errores || ' con errores, ' || examenes || ' en total' as linea from {_RATES}, (select count(*) filter (estado = 'error') as errores from audited)
      union all select 'error', exam_identifier, 'sin preguntas' from audited where estado = 'error'
      union all select 'distribucion', exam_identifier, preguntas || ' preguntas, esperadas ' || esperadas from audited where not distribucion_ok
      union all select 'distribucion', exam_identifier, 'categoria ' || cat || ': ' || hay || ' de ' || oficial || ' (' || printf('%+d', diferencia) || ')' from ({_GAPS}) where diferencia <> 0
      union all select 'opciones', exam_identifier, {_PLACE} || {_SHOWN_KEYS} || ' | ' || i from (select *, {_ISSUE_O} as i from preguntas) where exam_identifier is not null and i is not null
      union all select 'respuestas', exam_identifier, {_PLACE} || coalesce(respuesta_correcta, '-') || ' | ' || {_SHOWN_KEYS} || ' | ' || i from (select *, {_ISSUE_A} as i from preguntas) where exam_identifier is not null and i is not null
      union all select 'estructura', exam_identifier, {_PLACE} || i from (select *, {_MISSING} as i from preguntas) where exam_identifier is not null and i <> ''
      union all select 'numeros', exam_identifier, numero_pregunta || ' | ' || veces || ' veces | ' || categorias from ({_NUMBERS})
      union all select 'tasa', null, rpad(regla, 12, ' ') || lpad(cast(validos as varchar), 6, ' ') || '/' || rpad(cast(examenes as varchar), 6, ' ') || lpad(printf('%.1f', tasa), 6, ' ') || ' %' from {_RATES}""",
    "active_exams": "select exam_id, creada_at from (select exam_id, min(creada_at) as creada_at, min(enviada_at) as enviada_at from entregas group by exam_id) where creada_at <= timestamp '2025-06-01 12:00:00' and (enviada_at is null or enviada_at > timestamp '2025-06-01 12:00:00') and timestamp '2025-06-01 12:00:00' <= creada_at + interval 30 days",
    "active_exam_count": "select count(*) as activos from (select min(creada_at) as c, min(enviada_at) as e from entregas where exam_id is not null group by exam_id) where c <= timestamp '2025-06-01 12:00:00' and (e is null or e > timestamp '2025-06-01 12:00:00') and timestamp '2025-06-01 12:00:00' <= c + interval 30 days",
    "duplicate_report": f"""with r as (select num, enunciado, community, anio, {_HASH} as h, row_number() over (partition by {_HASH} order by num) as rn from preguntas),
      g as (select h, count(*) as n, arg_min(enunciado, num) as e from r group by h having count(*) > 1)
      select 'contenido' as tipo, case when length(e) > 80 then substr(e, 1, 80) || '...' else e end as valor, n - 1 as repetidas from g where (select count(*) from g) <= 10
      union all select 'community', community, count(*) from r where rn > 1 and (select count(*) from g) > 10 group by community
      union all select 'anio', cast(anio as varchar), count(*) from r where rn > 1 and (select count(*) from g) > 10 group by anio""",
    "category_display": "select distinct categoria, case when try_cast(categoria as int) between 1 and 11 and categoria = cast(try_cast(categoria as int) as varchar) then 'Tema ' || categoria else upper(replace(categoria, '_', ' ')[1:1]) || replace(categoria, '_', ' ')[2:] end as nombre from preguntas where categoria is not null",
    "answers_round_trip": f"select exam_id, question_id, letra from {_LAST}",
    "consume_once": "select exam_id, creada_at, enviada_at from (select exam_id, min(creada_at) as creada_at, min(enviada_at) as enviada_at from entregas group by exam_id) where enviada_at >= creada_at and enviada_at <= creada_at + interval 45 minutes",
    "elapsed_format": "select exam_id, case when s // 60 < 10 then '0' else '' end || (s // 60) || ':' || lpad(cast(s % 60 as varchar), 2, '0') as duracion from (select exam_id, epoch(date_trunc('second', enviada_at))::bigint - epoch(date_trunc('second', creada_at))::bigint as s from entregas where enviada_at is not null)",
    "progress": f"select e.exam_id, coalesce(n, 0) as respondidas, case when coalesce(num_preguntas, 0) = 0 then 0.0 else round_even(coalesce(n, 0) / num_preguntas * 100, 2) end as avance from (select exam_id, max(num_preguntas) as num_preguntas from entregas group by exam_id) e left join (select exam_id, count(*) as n from {_LAST} where not {_BLANK('letra')} group by exam_id) a on a.exam_id = e.exam_id",
}
