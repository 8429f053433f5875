"""Joins under skew, Bloom filters, drawing, grading and schema drift on small tables."""

import json
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

import tables
from quizlake.operators import audit, bank, bloom, drift, grade, orphans, sample
from quizlake.operators.skew import hot_keys, split_join
from quizlake.session import stage, table


@pytest.mark.parametrize("how", ["inner", "left", "left_semi", "left_anti"])
@pytest.mark.parametrize("kind", ["int", "binary"])
def test_split_join_is_a_join(spark, how, kind):
    rows = spark.range(3000).select("id", F.when(F.col("id") % 3 == 0, 7).when(F.col("id") % 11 == 0, None).otherwise(F.col("id") % 50).cast("int").alias("k"))
    side = spark.createDataFrame([(7, "x"), (7, "y"), (3, "z"), (99, "w"), (None, "n")], "k int, v string")
    if kind == "binary":
        rows, side = (d.withColumn("k", F.col("k").cast("string").cast("binary")) for d in (rows, side))
    assert len(hot_keys(rows, "k", 10)) >= 1
    want = rows.join(side, "k", how)
    got = split_join(rows, side, "k", how, share=10)
    key = lambda r: str([bytes(x) if isinstance(x, bytearray) else x for x in r])
    assert sorted(map(key, got.select(*want.columns).collect())) == sorted(map(key, want.collect()))


def test_bloom_filter_misses_nothing(spark):
    keys = spark.range(2000).select(F.concat(F.lit("k"), "id").alias("k"))
    blocks = bloom.block_count(2000)
    others = spark.range(2000, 22000).select(F.concat(F.lit("k"), "id").alias("k"))
    table_ = bloom.build(keys, "k", blocks)
    assert bloom.probe(keys, "k", table_, blocks, "f").where("not f").count() == 0
    assert bloom.probe(others, "k", table_, blocks, "f").where("f").count() < 600
    assert bloom.probe(spark.createDataFrame([(None,)], "k string"), "k", table_, blocks, "f").first()["f"] is False
    assert not bloom.fits(10**9)


def test_orphans_with_a_partitioned_filter_agree(spark, folders):
    p, r, e = (table(spark, folders["odd"], t) for t in ("preguntas", "respuestas", "entregas"))
    a = orphans.orphan_references(r, "question_id", p, "id", "respondida_at", "cargada_at", "retirada_at")
    b = orphans.orphan_references(r, "question_id", p, "id", "respondida_at", "cargada_at", "retirada_at", max_filter_bytes=0)
    assert sorted(map(str, a.select(r.columns).collect())) == sorted(map(str, b.select(r.columns).collect()))
    assert a.where("question_id is null").count() == 2


def test_answer_keys_that_name_no_option(spark):
    rows = [("a, h", {"a": "x"}), ("A", {"a": "x"}), ("anulada ", {"a": "x"}), (None, {"a": "x"}), (" ", None), ("a,,", {"a": "x"}), ("b", None)]
    got = spark.createDataFrame(rows, "k string, o map<string,string>").select(orphans.bad_letters(F.col("k"), F.col("o"))).collect()
    assert [g[0] for g in got] == [True, False, False, False, False, False, True]


def test_draws(spark, folders):
    q = table(spark, folders["plain"], "preguntas")
    one, two = sample.unique_sample(q, 20, 1).collect(), sample.unique_sample(q, 20, 1).collect()
    assert one == two and sorted(r["posicion"] for r in one) == list(range(1, 21))
    exam = sample.flat_exam(q, 10, "exam_1", "per").collect()
    assert [r["id"] for r in exam] == [f"exam_1_q{i}" for i in range(1, 11)] and exam[0]["respuesta_correcta"]
    assert sample.flat_exam(q, 10, "e", "simulacro").where("respuesta_correcta is not null").count() == 0
    for n, text in ((0, "1 to 100"), (500, "1 to 100"), (100, None)):
        if text:
            with pytest.raises(ValueError, match=text):
                sample.flat_exam(q, n, "e", "per")
    copies = spark.createDataFrame([(i, "same", {"a": "x"}) for i in range(15)], "num long, enunciado string, opciones map<string,string>")
    with pytest.raises(ValueError, match="only 1 of 5"):
        sample.flat_exam(copies.selectExpr("*", "'' as respuesta_correcta", "'1' as categoria"), 5, "e", "per")
    with pytest.raises(ValueError, match="form"):
        sample.specific_exam(q, "bad", "e")
    with pytest.raises(ValueError, match="no year"):
        sample.specific_exam(q, "a_b_c_d", "e")


def test_catalogue(spark, folders):
    e = table(spark, folders["plain"], "examenes")
    nested = {r["community"]: r["anios"] for r in bank.nested_catalogue(e).collect()}
    assert nested["Galicia"][2020]["junio"] == ["test00", "test01", "test02"]
    bank.refuse_unknown(e, [])
    with pytest.raises(ValueError, match="Atlantis"):
        bank.refuse_unknown(e, ["Galicia", "Atlantis"])


BANK = "num long, id string, categoria string, respuesta_correcta string, opciones map<string,string>, enunciado string, exam_identifier string, numero_pregunta int"
ANSWERS = "respuesta_id long, exam_id string, question_id string, letra string, respondida_at timestamp_ntz, segundos int"
SENT = "exam_id string, tipo_examen string, exam_identifier string, num_preguntas int"


def small_exams(spark):
    q = [(1, "q1", "5", "a", {"a": "x", "b": "y"}, "e", "x1", 1), (2, "q2", "5", "anulada", {"a": "x"}, "e", "x1", 2), (3, "q3", None, "a,b", {"a": "x"}, "e", "x1", 3), (4, "q4", "6", "a", {"a": "x"}, "e", "x1", 4), (5, "q4b", "6", "a", {}, "e", "x1", 4), (6, "q5", "6", "a", None, "e", "x1", 5)]
    t = datetime(2024, 1, 1)
    a = [(1, "e", "q1", "b", t, 1), (2, "e", "q1", "A", t, 1), (3, "e", "q2", "z", t, 100), (4, "e", "q3", None, t, 1), (5, "e", "qx", "a", t, 1), (6, "s", "q1", "a", t, 1), (7, "nobody", "q1", "a", t, 1)]
    sent = [("e", "per", None, 3), ("e", "per", None, 3), ("s", "especifico", "x1", 4), ("none", "per", None, 0)]
    return spark.createDataFrame(a, ANSWERS), spark.createDataFrame(q, BANK), spark.createDataFrame(sent, SENT)


def test_grading(spark):
    a, q, sent = small_exams(spark)
    g = grade.graded(a, q, sent, texts=True)
    found = {r["exam_id"]: r for r in grade.exam_summary(g, grade.exams(sent)).collect()}
    s = found["e"]
    assert (s["correctas"], s["total"], s["puntuacion"], s["porcentaje"], s["aprobado"]) == (2, 3, "2/3", 66.67, True)
    # Four questions of the named exam, one answered: the others are wrong. An exam without questions has 0 of 0.
    assert (found["s"]["puntuacion"], found["s"]["porcentaje"], found["s"]["aprobado"]) == ("1/4", 25.0, False)
    assert (found["none"]["puntuacion"], found["none"]["porcentaje"], found["none"]["aprobado"]) == ("0/0", 0.0, False) and len(found) == 3
    assert {(r["exam_id"], r["categoria"], r["correctas"], r["total"]) for r in grade.by_category(g).collect()} == {("e", "5", 2, 2), ("s", "5", 1, 2), ("s", "6", 0, 1)}
    assert {tuple(r) for r in grade.unanswered(g).collect()} == {("e", 1, 3), ("s", 3, 4)}
    texts = {(r["exam_id"], r["question_id"]): r for r in grade.question_results(g).collect()}
    assert texts["e", "q1"]["letra"] == "A" and texts["e", "q1"]["texto_respuesta"] is None and texts["e", "q2"]["texto_respuesta"] is None
    assert texts["s", "q1"]["texto_respuesta"] == "x" and texts["s", "q2"]["textos_correctas"] == "a: x" and texts["s", "q1"]["opciones"] == "a: x | b: y"
    marks = {(r["question_id"], r["opcion"]): (r["correcta"], r["mal_elegida"], r["ayudada"]) for r in grade.option_marks(g, a.where("segundos > 0 and exam_id = 's'")).where("exam_id = 's'").collect()}
    assert marks["q1", "a"] == (True, False, True) and marks["q1", "b"] == (False, False, False) and marks["q2", "a"] == (True, False, False)


def test_rules_and_reasons(spark):
    a, q, sent = small_exams(spark)
    g = grade.graded(a, q, sent)
    rules = spark.createDataFrame([(0, "total", "Total", 1), (1, "5", "Balizas", 2), (2, "7", "Otra", 1)], "orden int, categoria string, nombre string, minimo int")
    checks = grade.checked(g, rules)
    assert {(r["exam_id"], r["categoria"]): (r["correctas"], r["total"], r["cumplido"], r["avance"], r["marca"]) for r in checks.collect()} == {("s", "total"): (1, 4, True, 25.0, 25.0), ("s", "5"): (1, 2, False, 50.0, 100.0), ("s", "7"): (0, 0, False, 0.0, 0.0)}
    v = {r["exam_id"]: r for r in grade.verdicts(grade.exam_summary(g, grade.exams(sent), 70), checks, pass_mark=70).collect()}
    assert (v["s"]["por_reglas"], v["s"]["cumplidos"], v["s"]["requisitos"], v["s"]["aprobado"]) == (True, 1, 3, False)
    assert v["s"]["motivos"] == "No alcanza el mínimo en Balizas: 1/2 (mínimo requerido: 2); No alcanza el mínimo en Otra: 0/0 (mínimo requerido: 1)"
    assert v["e"]["motivos"] == "No alcanza el porcentaje mínimo de 70.0% (obtenido: 66.7%)" and not v["e"]["aprobado"]
    assert v["none"]["motivos"] is None and not v["none"]["aprobado"]
    total = grade.verdicts(grade.exam_summary(g, grade.exams(sent)), grade.checked(g, rules.where("orden = 0").withColumn("minimo", F.lit(2))))
    assert {r["exam_id"]: r["motivos"] for r in total.collect()}["s"] == "No alcanza el mínimo de 2 respuestas correctas (obtenidas: 1)"


def test_grading_reads_no_texts_and_runs_nothing_early(spark, folders):
    a, q, sent = (table(spark, folders["plain"], t) for t in ("respuestas", "preguntas", "entregas"))  # reading a schema is a job
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", "plans")
    got = grade.exam_summary(grade.graded(a, q, sent), grade.exams(sent))
    jobs = spark.sparkContext.statusTracker().getJobIdsForGroup("plans")
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert not jobs
    assert "enunciado" not in plan and "opciones" not in plan


def test_audit_of_exams(spark):
    quotas = {1: 2, 2: 1}
    opts = {c: c for c in "abcd"}
    rows = [(1, "x", 1, "1", "a", opts), (2, "x", 2, "1", "b", opts), (3, "x", 3, "2", "c", opts), (4, "y", 1, "1", "e", opts), (5, "y", 1, "2", "a", {"a": "x"}), (6, None, 1, "1", "a", opts)]
    q = spark.createDataFrame([(*r, "texto") for r in rows], "num long, exam_identifier string, numero_pregunta int, categoria string, respuesta_correcta string, opciones map<string,string>, enunciado string")
    files = spark.createDataFrame([("x", 3), ("y", None), ("leer", 3)], "exam_identifier string, esperadas int")
    audited = audit.per_exam(q, files, quotas)
    got = {r["exam_identifier"]: tuple(r)[1:] for r in audited.collect()}
    assert got["x"] == ("ok", 3, 3, True, True, True, True, True) and got["y"] == ("ok", 45, 2, False, False, False, True, False) and got["leer"][:3] == ("error", 3, 0)
    assert {r["regla"]: (r["validos"], r["examenes"], r["tasa"]) for r in audit.rates(audited).collect()} == {"distribucion": (1, 3, 33.3), "opciones": (1, 3, 33.3), "respuestas": (1, 3, 33.3), "estructura": (2, 3, 66.7), "numeros": (1, 3, 33.3)}
    assert tuple(audit.gate(audited).first()) == (1, 5, False)
    lines = {(r["seccion"], r["exam_identifier"], r["linea"]) for r in audit.report(q, audited, quotas).collect()}
    assert ("error", "leer", "sin preguntas") in lines and ("distribucion", "y", "categoria 1: 1 de 2 (-1)") in lines and ("opciones", "y", "2 | 1 | a | faltan") in lines
    assert ("respuestas", "y", "1 | 1 | e | a, b, c, d | desconocida") in lines and ("numeros", "y", "1 | 2 veces | 1,2") in lines


def test_mock_exam_and_its_errors(spark):
    q = spark.createDataFrame([(i, f"t{i if i < 6 else 6}", {"a": "x"}, "1" if i < 6 else "2") for i in range(12)], "num long, enunciado string, opciones map<string,string>, categoria string")
    got = sample.mock_exam(q, {1: 3, 2: 1}, "simulacro_1").collect()
    assert [r["id"] for r in got] == [f"simulacro_1_q{i}" for i in range(1, 5)] and [r["cat"] for r in got] == [1, 1, 1, 2] and "respuesta_correcta" not in got[0].asDict()
    with pytest.raises(ValueError, match="has 6 of 7 questions"):
        sample.mock_exam(q, {1: 7}, "s")
    with pytest.raises(ValueError, match="only 1 of 3 questions of distinct"):
        sample.mock_exam(q, {2: 3}, "s")


def test_audit_kinds(spark):
    rows = [(1, {}, "a"), (2, {"a": "x"}, "b"), (3, {c: c for c in "abcde"}, "e"), (4, {c: c for c in "abce"}, "a, e"), (5, {c: c for c in "abcd"}, " "), (6, {"a": " ", "b": "y", "c": "z", "d": "w"}, "ANULADA")]
    q = spark.createDataFrame(rows, "num long, opciones map<string,string>, respuesta_correcta string").withColumn("enunciado", F.lit("e"))
    assert {r["num"]: r["fallo"] for r in audit.options(q).collect()} == {1: "ninguna", 2: "faltan", 3: "sobran", 4: "distintas"}
    assert {r["num"]: r["fallo"] for r in audit.answers(q).collect()} == {1: "desconocida", 2: "desconocida", 5: "vacia"}
    assert {r["num"]: r["faltan"] for r in audit.structure(q).collect()} == {1: "opciones", 5: "respuesta_correcta", 6: "opcion_a"}


def feed(spark, files, gap=20):
    rows = [(i + 1, "f", datetime(2024, 1, 1) + timedelta(days=gap * i), j, json.dumps(r) if r is not None else "no") for i, recs in enumerate(files) for j, r in enumerate(recs)]
    return spark.createDataFrame(rows, "archivo_id long, feed string, exportado_at timestamp_ntz, registro_no int, payload string")


def test_drift_changes(spark):
    years, places = [2019, 2020, 2021], ["Galicia", "Murcia", "Galicia"]
    files = [
        [{"id": f"a{i}", "year": years[i], "place": {"community": places[i]}, "gone": "x"} for i in range(3)],
        [{"id": f"b{i}", "anio": str(years[i]), "place": {"community": [places[i]]}, "empty": None} for i in range(3)] + [None],
        [{"id": f"c{i}", "anio": years[i] + 0.5, "comunidad": places[i], "title": "T"} for i in range(3)],
        [{"id": f"d{i}", "anio": years[i] + 0.5, "comunidad": places[i], "title": "T"} for i in range(3)],
    ]
    raw = feed(spark, files)
    profiled = stage(drift.profile(raw.unionByName(raw)), "p")
    got = sorted((r["archivo_id"], r["campo"], r["cambio"]) for r in drift.changes(profiled).collect())
    assert got == sorted([(2, "anio", "renamed"), (2, "anio", "type_changed"), (2, "place.community", "type_changed"), (2, "gone", "removed"), (3, "anio", "type_changed"), (3, "comunidad", "renamed"), (3, "comunidad", "type_changed"), (3, "title", "added")])
    names = drift.columns(profiled)
    assert set(names["anio"]) == {"anio", "year"} and set(names["comunidad"]) == {"comunidad", "place.community"}
    table_ = drift.unify(raw, names)
    assert table_.count() == 12 and table_.where("anio = 2019 and comunidad = 'Galicia'").count() == 2
    assert dict(table_.dtypes)["anio"] == "double" and dict(table_.dtypes)["comunidad"] == "string"


def test_values_of_further_names_are_kept(spark):
    raw = feed(spark, [[{"anio": 2020, "year": 2020, "codigo": "007"}, {"anio": 2021, "year": [2019]}, {"year": "2018"}]])
    got = drift.unify(raw, {"anio": ["anio", "year"], "codigo": ["codigo"]}).orderBy("registro_no").collect()
    assert [(r["anio"], r["codigo"], r["otros_valores"]) for r in got] == [(2020, "007", None), (2021, None, '{"year": "2019"}'), (2018, None, None)]


def test_forms_are_of_whole_values_in_any_order(spark):
    values = [f"{'b' * 50}-{'1' * (i % 40 + 1)}" for i in range(300)]
    assert len({drift.form("palabra " * 9 + t) for t in ("1", "1.5")}) == 2 and drift.form("sin cifras") == "" and drift.form("año 2020") == "a 9999"
    one, two = (drift.profile(feed(spark, [[{"c": v} for v in order]])).first() for order in (values, values[::-1]))
    assert one["formas"] == two["formas"] and one["valores"] == two["valores"] and len(one["formas"]) > 3


def test_domains_merge_in_stages(spark, monkeypatch):
    monkeypatch.setattr(drift, "FOLD", 1)
    rows = [(f"n{i % 3}", sorted(hash((i, j)) for j in range(40))) for i in range(60)]
    got = {r["campo"]: r["dominio"] for r in drift.domains(spark.createDataFrame(rows, "campo string, valores array<long>").repartition(5)).collect()}
    assert got == {n: sorted({v for m, vs in rows if m == n for v in vs})[: drift.SKETCH] for n in ("n0", "n1", "n2")}


def test_neighbours_across_chunks(spark):
    rows = [(i, "f" if i % 4 else None, datetime(2020, 1, 1) + timedelta(days=(i * 37) % 300)) for i in range(60)] + [(100, "f", None)]
    files = spark.createDataFrame(rows, "archivo_id long, feed string, exportado_at timestamp_ntz").withColumn("p", F.col("archivo_id"))
    got = {r["archivo_id"]: r["_before"] and r["_before"]["p"] for r in drift.consecutive(files, "feed", ("exportado_at", "archivo_id"), "p", 86_400 * 11).collect()}
    want = {}
    for f in ("f", None):
        mine = sorted((r for r in rows if r[1] == f), key=lambda r: (r[2] is not None, r[2] or datetime(1, 1, 1), r[0]))
        want |= {b[0]: a and a[0] for a, b in zip([None, *mine], mine)}
    assert got == want


def test_drift_reads_what_json_gives():
    assert drift.record("[1]") is None and drift.record("{") is None and drift.record(None) is None
    assert dict(drift.leaves({"a": {"b": [1], "c": {}}, "d": None})) == {"a.b": [1], "d": None}
    assert [drift.plain(v) for v in ([2020], "2020", 2020.0, 2020, " 2020 ")] == ["2020"] * 5
    assert [drift.TYPES[drift.kind(v)] for v in ("x", 1, 1.5, [1], True)] == ["string", "whole", "decimal", "list", "other"]


def test_fixture_tables_are_documented():
    assert set(tables.rows()) == set(tables.SCHEMAS)


def test_submissions_as_json(spark):
    rows = [('{"exam_id": "e", "respuestas": {"q1": "a", "q2": null}}',), ("{broken",), ('{"respuestas": {"q1": "a"}}',), (None,), ('{"exam_id": "f", "respuestas": {}}',)]
    got = {tuple(r) for r in grade.from_json(spark.createDataFrame(rows, "value string")).collect()}
    assert got == {("e", "q1", "a"), ("e", "q2", None)}
    assert grade.as_json(spark.createDataFrame([(1, None)], "a int, b string")).first()["value"] == '{"a":1,"b":null}'


def test_result_documents(spark, folders):
    sent = table(spark, folders["plain"], "entregas")
    g = grade.graded(*(table(spark, folders["plain"], t) for t in ("respuestas", "preguntas")), sent)
    got = [json.loads(r["value"]) for r in grade.result_documents(g, grade.exams(sent)).collect()]
    assert len(got) == 5 and all(sum(c["total"] for c in d["categorias"]) <= int(d["puntuacion"].split("/")[1]) for d in got)


def test_repeat_report_changes_its_form(spark):
    q = spark.createDataFrame([(i, f"t{i // 2}", {"a": "x"}, "k", "G", 2020) for i in range(30)], "num long, enunciado string, opciones map<string,string>, respuesta_correcta string, community string, anio int")
    assert {r["tipo"] for r in sample.repeat_report(q, 20).collect()} == {"contenido"}
    assert {(r["tipo"], r["valor"], r["repetidas"]) for r in sample.repeat_report(q, 10).collect()} == {("community", "G", 15), ("anio", "2020", 15)}


def test_repeat_details_has_every_repeated_content(spark):
    q = spark.createDataFrame([(i, f"t{i // 2}", {"a": "x"}, "k") for i in range(30)] + [(99, "once", {"a": "x"}, "k")], "num long, enunciado string, opciones map<string,string>, respuesta_correcta string")
    assert sorted((r["muestra"], r["copias"]) for r in sample.repeat_details(q).collect()) == sorted((f"t{i}", 2) for i in range(15))


def test_spread_keeps_rows(spark):
    from quizlake.session import spread

    df = spark.range(100).coalesce(1)
    assert sorted(r["id"] for r in spread(df).collect()) == list(range(100)) and spread(df).rdd.getNumPartitions() > 1
    wide = spark.range(100).repartition(64)
    assert spread(wide) is wide
