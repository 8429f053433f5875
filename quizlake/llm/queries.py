"""Queries of the subpackage, and the SQL of those that SQL can express."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quizlake.llm import canonical, leaks, lookalike, mojibake, neardup, quota, sentences, tokens
from quizlake.llm.fields import question_fields
from quizlake.session import spread, table


def _questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spread(table(spark, sf_dir, "preguntas").select("num", "enunciado", "opciones"))


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spread(table(spark, sf_dir, "documents").select("doc_id", "text"))


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows that are the same but for formatting: (num_a, num_b), the smallest number first."""
    return canonical.same_questions(table(spark, sf_dir, "preguntas"))


def p2_copies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One record per question with its number of copies."""
    return canonical.distinct_questions(table(spark, sf_dir, "preguntas"))


def p2_collisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hashes of 128 bits that stand for more than one text; normally none."""
    got = canonical.collisions(canonical.question_keys(table(spark, sf_dir, "preguntas")))
    return got.select(F.lower(F.hex("md5")).alias("md5"), "textos")


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fields decoded with a wrong encoding: (num, campo)."""
    return mojibake.garbled(question_fields(_questions(spark, sf_dir))).select("num", "campo").distinct()


def p3_restored(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same fields with their text as it stands and as it was meant."""
    return mojibake.garbled(question_fields(_questions(spark, sf_dir)))


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Plans and categories that cannot be filled: (plan_id, categoria)."""
    return quota.unmet(table(spark, sf_dir, "preguntas"), table(spark, sf_dir, "cuotas"))


def p5_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Needed, available and reachable questions of every plan and category."""
    return quota.report(table(spark, sf_dir, "preguntas"), table(spark, sf_dir, "cuotas"))


def p5_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The share wanted and the share drawn of every plan and category."""
    return quota.shares(table(spark, sf_dir, "preguntas"), table(spark, sf_dir, "cuotas"))


def p5_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows that each plan draws, counted in its sample: (plan_id, filas)."""
    return p5_sample(spark, sf_dir).groupBy("plan_id").agg(F.count(F.lit(1)).alias("filas"))


def p5_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The samples themselves: (plan_id, num, categoria)."""
    return quota.sample(table(spark, sf_dir, "preguntas"), table(spark, sf_dir, "cuotas"))


def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fields with other characters than they seem to have: (num, campo)."""
    return lookalike.consistent(question_fields(_questions(spark, sf_dir))).select("num", "campo").distinct()


def p6_consistent(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same fields with the kinds of deviation and their consistent form."""
    got = lookalike.consistent(question_fields(_questions(spark, sf_dir)))
    return got.select("num", "campo", "texto", F.array_join("clases", ",").alias("clases"), "forma", F.array_join("restantes", ",").alias("restantes"))


def p7_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of questions with a similarity of 0.7 or more, but for those of p2: (num_a, num_b)."""
    return neardup.revised_questions(_questions(spark, sf_dir))


def p7_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per question with its group and its number of links."""
    return neardup.question_groups(_questions(spark, sf_dir))


def p9_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents with twelve successive words of an item: (doc_id, item_id)."""
    return leaks.contained(_documents(spark, sf_dir), table(spark, sf_dir, "eval_items"))


def p9_leaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents with literal or paraphrased items, and what they share."""
    return leaks.leaks(_documents(spark, sf_dir), table(spark, sf_dir, "eval_items"))


def p8_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token ids of every document: (doc_id, ids)."""
    return tokens.encode(_documents(spark, sf_dir))


def p8_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents and tokens per source."""
    return tokens.totals(spread(table(spark, sf_dir, "documents").select("doc_id", "text", "source")), "source")


def p10_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Places of all sentences: (doc_id, start_char, end_char)."""
    return p10_sentences(spark, sf_dir).select("doc_id", "start_char", "end_char").distinct()


def p10_sentences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All sentences with their places and texts."""
    return sentences.sentences(_documents(spark, sf_dir))


QUERIES = {f.__name__: f for f in (p2_found, p2_copies, p2_collisions, p3_found, p3_restored, p5_found, p5_report, p5_shares, p5_sizes, p5_sample, p6_found, p6_consistent, p7_found, p7_groups, p8_ids, p8_totals, p9_found, p9_leaks, p10_found, p10_sentences)}

_CANON = r"""
select num, regexp_replace(replace(lower(upper(coalesce(enunciado, ''))), 'ς', 'σ'), '[^\p{L}\p{N}]+', '', 'g') as e,
       list_sort(list_transform(coalesce(map_values(opciones), []),
                 lambda x: regexp_replace(replace(lower(upper(coalesce(x, ''))), 'ς', 'σ'), '[^\p{L}\p{N}]+', '', 'g'))) as o
from preguntas
"""

_P7 = rf"""
with base as materialized (select num, list_distinct(regexp_extract_all(lower(concat_ws(' ', enunciado, array_to_string(map_values(opciones), ' '))), '[\p{{L}}\p{{N}}]+')) as ws from preguntas),
canon as materialized ({_CANON}),
w as materialized (select num, unnest(ws) as word from base),
pairs as (select a.num as num_a, b.num as num_b, count(*) as comunes from w a join w b on a.word = b.word and a.num < b.num group by all)
select p.num_a, p.num_b from pairs p join base a on a.num = p.num_a join base b on b.num = p.num_b
join canon x on x.num = p.num_a join canon y on y.num = p.num_b
where 10 * comunes >= 7 * (len(a.ws) + len(b.ws) - comunes) and (x.e <> y.e or x.o <> y.o)
"""
_P7_GROUPS = rf"""
with recursive base as materialized (select num, list_sort(list_distinct(regexp_extract_all(lower(concat_ws(' ', enunciado, array_to_string(map_values(opciones), ' '))), '[\p{{L}}\p{{N}}]+'))) as ws from preguntas where num is not null),
canon as materialized ({_CANON}),
fila as materialized (select b.num, ws, e, o, min(b.num) over (partition by ws, e, o) as nodo, min(b.num) over (partition by e, o) as primero from base b join canon c on c.num = b.num),
n as materialized (select * from fila where num = nodo),
w as materialized (select num, unnest(ws) as word from n),
comun as (select a.num as a, b.num as b, count(*) as k from w a join w b on a.word = b.word and a.num < b.num group by all),
par as materialized (select p.a, p.b from comun p join n x on x.num = p.a join n y on y.num = p.b where 10 * k >= 7 * (len(x.ws) + len(y.ws) - k) and (x.e <> y.e or x.o <> y.o)),
arco as materialized (select a, b from par union select b, a from par union select num, primero from n union select primero, num from n),
alcance(a, b) as (select a, b from arco union select r.a, s.b from alcance r join arco s on s.a = r.b),
grupo as (select a, min(b) as grupo from alcance group by a),
enlace as (select a, count(*) as k from (select a, b from par union all select b, a from par) group by a)
select f.num, least(g.grupo, f.nodo) as grupo, coalesce(k, 0) as enlaces from fila f join grupo g on g.a = f.nodo left join enlace l on l.a = f.nodo
"""
_RUNS = lambda t, key: f"select {key}, ws[i:i + 11] as run from (select {key}, ws, unnest(generate_series(1, len(ws) - 11)) as i from (select {key}, regexp_extract_all(strip_accents(lower(text)), '[\\p{{L}}\\p{{N}}]+') as ws from {t} where text is not null))"

_NEED = """
with nombres as (select lower(trim(nombre)) as n, min(categoria) as c from cuotas group by 1),
filas as (
  select p.community, coalesce(try_cast(trim(p.categoria) as int), a.c, try_cast(trim(p.categoria_nombre) as int), b.c) as cat
  from preguntas p left join nombres a on a.n = lower(trim(p.categoria)) left join nombres b on b.n = lower(trim(p.categoria_nombre))),
hay as (select community, cat, count(*) as n from filas where cat is not null group by all),
planes as (select plan_id, min(comunidad) as comunidad, categoria, max(greatest(n_objetivo, minimo)) as necesarias from cuotas group by plan_id, categoria),
informe as (
  select cast(q.plan_id as bigint) as plan_id, cast(q.categoria as bigint) as categoria, cast(q.necesarias as bigint) as necesarias,
         cast(coalesce(sum(h.n), 0) as bigint) as disponibles
  from planes q left join hay h on h.cat = q.categoria and (q.comunidad is null or q.comunidad = h.community) group by q.plan_id, q.categoria, q.necesarias)
"""

SQL = {
    "p2_found": f"with c as ({_CANON}), w as (select num, min(num) over (partition by e, o) as primero from c) select primero as num_a, num as num_b from w where num <> primero",
    "p2_copies": f"with c as ({_CANON}) select min(num) as num, count(*) as copias from c group by e, o",
    "p2_collisions": f"with c as ({_CANON}) select md5(array_to_string(list_concat([e], o), chr(31))) as md5, count(distinct (e, o)) as textos from c group by 1 having count(distinct (e, o)) > 1",
    "p7_found": _P7,
    "p7_groups": _P7_GROUPS,
    "p9_found": f"select distinct d.doc_id, e.item_id from ({_RUNS('documents', 'doc_id')}) d join ({_RUNS('eval_items', 'item_id')}) e on d.run = e.run",
    "p5_found": _NEED + "select plan_id, categoria from informe where disponibles < necesarias",
    "p5_sizes": _NEED
    + """, hay_aqui as (select q.plan_id, q.categoria, any_value(q.tamano) as tamano, max(q.minimo) as minimo, max(q.proporcion) as parte, coalesce(any_value(i.disponibles), 0) as hay
         from cuotas q join informe i on i.plan_id = q.plan_id and i.categoria = q.categoria group by q.plan_id, q.categoria)
    select plan_id, cast(greatest(sum(least(minimo, hay)), least(max(tamano), sum(case when parte > 0 then hay else least(minimo, hay) end))) as bigint) as filas
    from hay_aqui group by plan_id having filas > 0""",
    "p5_report": _NEED + "select plan_id, categoria, necesarias, disponibles, least(disponibles, necesarias) as alcanzables, greatest(necesarias - disponibles, 0) as faltan from informe",
}
