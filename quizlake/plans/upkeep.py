"""Queries over changing schemas (p1_) and missing references (p4_), with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from quizlake.operators import drift, orphans
from quizlake.session import stage, table


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every change of a feed's fields: (archivo_id, campo, cambio)."""
    return drift.changes(stage(drift.profile(table(spark, sf_dir, "registros_crudos")), "profile"))


def p1_unified(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All valid records in one table with one name per column."""
    raw = table(spark, sf_dir, "registros_crudos")
    return drift.unify(raw, drift.columns(stage(drift.profile(raw), "profile")))


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every orphan reference: (tabla, campo, clave, periodo)."""
    return orphans.answer_orphans(*(table(spark, sf_dir, t) for t in ("preguntas", "respuestas", "entregas")))


def p4_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orphans counted per table, field and month."""
    return orphans.orphan_report(p4_found(spark, sf_dir))


QUERIES = {"p1_found": p1_found, "p1_unified": p1_unified, "p4_found": p4_found, "p4_report": p4_report}

_P4 = """
select distinct 'respuestas' as tabla, 'question_id' as campo, r.respuesta_id as clave, substr(cast(r.respondida_at as varchar), 1, 7) as periodo
from respuestas r
where not exists (select 1 from preguntas p where p.id = r.question_id and p.cargada_at <= r.respondida_at
                  and (p.retirada_at is null or p.retirada_at > r.respondida_at))
union
select 'respuestas', 'exam_id', r.respuesta_id, substr(cast(r.respondida_at as varchar), 1, 7)
from respuestas r where not exists (select 1 from entregas e where e.exam_id = r.exam_id)
union
select 'preguntas', 'respuesta_correcta', num, substr(cast(cargada_at as varchar), 1, 7)
from preguntas
where lower(trim(respuesta_correcta)) <> 'anulada'
  and len(list_filter(string_split(lower(respuesta_correcta), ','),
                      lambda x: trim(x) <> '' and not list_contains(list_transform(map_keys(opciones), lambda k: lower(k)), trim(x)))) > 0
"""

SQL = {
    "p4_found": _P4,
    "p4_report": f"select tabla, campo, periodo, count(*) as huerfanas from ({_P4}) group by tabla, campo, periodo",
}
