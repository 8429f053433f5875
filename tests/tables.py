"""Small tables of the documented schemas, in three variants: plain, odd (null rows, repeated rows, further columns with
names the operators use themselves, a long text) and empty."""

import json
from datetime import datetime, timedelta

import pyarrow as pa
import pyarrow.parquet as pq

T0 = datetime(2024, 1, 10, 8, 0, 0)
TS = pa.timestamp("us")
S, L, I, D = pa.string(), pa.int64(), pa.int32(), pa.float64()
SCHEMAS = {
    "preguntas": [("num", L), ("id", S), ("enunciado", S), ("opciones", pa.map_(S, S)), ("respuesta_correcta", S), ("title", S), ("subtitle", S), ("total_questions", I), ("community", S), ("comunidad_autonoma", S), ("anio", I), ("convocatoria", S), ("test_code", S), ("exam_identifier", S), ("categoria", S), ("categoria_nombre", S), ("numero_pregunta", I), ("cargada_at", TS), ("retirada_at", TS)],
    "respuestas": [("respuesta_id", L), ("exam_id", S), ("question_id", S), ("letra", S), ("exam_identifier", S), ("respondida_at", TS), ("recibida_at", TS), ("segundos", I)],
    "entregas": [("exam_id", S), ("alumno", S), ("tipo_examen", S), ("exam_identifier", S), ("num_preguntas", I), ("creada_at", TS), ("enviada_at", TS)],
    "examenes": [("exam_identifier", S), ("title", S), ("subtitle", S), ("community", S), ("anio", I), ("convocatoria", S), ("test_code", S), ("total_questions", I)],
    "registros_crudos": [("archivo_id", L), ("feed", S), ("archivo", S), ("exportado_at", TS), ("recibido_at", TS), ("registro_no", I), ("payload", S)],
    "cuotas": [("plan_id", I), ("comunidad", S), ("tamano", I), ("categoria", I), ("nombre", S), ("proporcion", D), ("n_objetivo", I), ("minimo", I)],
    "eval_items": [("item_id", L), ("categoria", I), ("text", S)],
    "documents": [("doc_id", L), ("text", S), ("lang", S), ("source", S), ("n_chars", L), ("tipo", S), ("categoria", I), ("publicado_at", TS)],
}
WORDS = "ancla boya cabo driza escota faro grillete hélice imbornal jarcia lumbrera mástil noray obenque proa quilla rezón sonda timón vela".split()


def stem(n):
    return " ".join(WORDS[(n * 7 + i * (1 + n % 5)) % len(WORDS)] for i in range(12)) + f" número {n}"


def question(n, **other):
    row = dict(num=n, id=f"q{n}", enunciado=stem(n), opciones=[(c, f"{c} {WORDS[(n + k) % 20]} {WORDS[(n * 3 + k) % 20]}") for k, c in enumerate("abcd")], respuesta_correcta="abcd"[n % 4], title="T", subtitle="S", total_questions=45, community=("Galicia", "Valencia")[n % 2], comunidad_autonoma=("Galicia", "Valencia")[n % 2], anio=2020 + n % 4, convocatoria="junio", test_code=f"test0{n % 3}", exam_identifier=f"galicia_{2020 + n % 4}_junio_test0{n % 3}", categoria=str(n % 11 + 1), categoria_nombre=f"Cat {n % 11 + 1}", numero_pregunta=n, cargada_at=T0, retirada_at=None)
    return row | other


def rows():
    qs = [question(n) for n in range(1, 121)]
    qs += [
        question(201, enunciado=stem(1).upper().replace(" ", "  ") + "!", opciones=[("d", "A " + question(1)["opciones"][0][1][2:] + "."), *question(1)["opciones"][1:]]),
        question(202, enunciado=stem(2).encode().decode("cp1252")),
        question(203, enunciado="hélice".encode().decode("latin-1") + " " + stem(3)),
        question(204, enunciado=stem(4) + " ａｎｃｌａ", opciones=[("a", "rézon x"), ("b", "so​nda"), ("c", "vеla"), ("d", "fa ro")]),
        question(205, enunciado=stem(5) + " más", opciones=question(5)["opciones"]),
        question(206, respuesta_correcta="a, h"), question(207, respuesta_correcta="ANULADA"), question(208, respuesta_correcta="b,c"),
        question(209, enunciado="anclado � roto"), question(210, categoria=" Cat 3 ", numero_pregunta=210), question(211, categoria=None, categoria_nombre="CAT 4"),
        question(213, community="Galicia", anio=2023, convocatoria="junio", test_code="test02"),
    ]
    answers = [dict(respuesta_id=n, exam_id=f"e{n % 6}", question_id=f"q{n % 130 + 1}", letra=["a", "B", "", None, "d", "z"][n % 6], exam_identifier=None, respondida_at=T0 + timedelta(hours=n), recibida_at=T0 + timedelta(hours=n + 1), segundos=n % 200) for n in range(1, 301)]
    subs = [dict(exam_id=f"e{n}", alumno="x", tipo_examen=["per", "simulacro"][n % 2], exam_identifier=None, num_preguntas=10 * n, creada_at=T0, enviada_at=T0 + timedelta(minutes=30 * n)) for n in range(5)]
    exams = [dict(exam_identifier=f"galicia_{y}_junio_test0{c}", title="T", subtitle=None, community="Galicia", anio=y, convocatoria="junio", test_code=f"test0{c}", total_questions=45) for y in (2020, 2021, 2023) for c in range(3)]
    raw = []
    for f in range(4):
        for r in range(3):
            rec = {"id": f"{f}-{r}", "numero_pregunta": r + 1, ("year" if f < 2 else "anio"): [2020, "2020", 2020, [2021]][f], "exam": {"community": "Galicia"}}
            if f == 3:
                rec["title"] = "Prueba"
            raw.append(dict(archivo_id=f + 1, feed="f", archivo=f"f/{f}.json", exportado_at=T0 + timedelta(days=20 * f), recibido_at=T0, registro_no=r, payload=json.dumps(rec)))
    raw.append(dict(archivo_id=4, feed="f", archivo="f/3.json", exportado_at=T0 + timedelta(days=60), recibido_at=T0, registro_no=9, payload="{no json"))
    plans = [dict(plan_id=p, comunidad=[None, "Galicia"][p - 1], tamano=30, categoria=c, nombre=f"Cat {c}", proporcion=1 / 11, n_objetivo=[3, 9][p - 1], minimo=1) for p in (1, 2) for c in range(1, 12)]
    items = [dict(item_id=n, categoria=1, text=stem(n * 17) + "? a) " + stem(n + 40) + " b) " + stem(n + 60)) for n in (1, 2, 3)]
    docs = [dict(doc_id=n, text=f"El Sr. Pérez midió {n},5 m. ¿Seguro? {stem(n + 300).capitalize()}. «¡Ya! ¡Ahora!», gritó. Fin… y siguió.\n\n- uno;\n- dos\n\n海は静か。船が出た！", lang="es", source=f"src{n % 3}", n_chars=1, tipo="foro", categoria=1, publicado_at=T0) for n in range(1, 31)]
    docs += [dict(doc_id=101, text="Nota. " + items[0]["text"][10:].upper() + " Fin."), dict(doc_id=102, text=""), dict(doc_id=103, text=" \n "), dict(doc_id=104, text=None)]
    return {"preguntas": qs, "respuestas": answers + answers[:3], "entregas": subs + subs[:1], "examenes": exams, "registros_crudos": raw, "cuotas": plans, "eval_items": items, "documents": docs}


CLASHING = ["_t", "_key", "_n", "_part", "_chunk", "clave", "campo", "texto", "posicion", "cat", "w", "key", "estado", "nodo", "start_char", "ids", "n", "h", "_text", "x1", "grupo", "copias"]


def write(folder, variant):
    for name, content in rows().items():
        fields = list(SCHEMAS[name])
        if variant == "empty":
            content = []
        if variant == "odd":
            content = content + [{f: None for f, _ in fields}] * 2 + content[:2]
            long = "ancla " * 30_000
            content.append(content[0] | ({"num": 900, "id": "q900", "enunciado": long} if name == "preguntas" else {"doc_id": 900, "text": long + ". Fin."} if name == "documents" else {}))
            taken = {f.lower() for f, _ in fields}
            fields += [(c, S) for c in CLASHING if c not in taken]
        schema = pa.schema([pa.field(f, t) for f, t in fields])
        pq.write_table(pa.Table.from_pylist([{f: r.get(f) for f, _ in fields} for r in content], schema=schema), f"{folder}/{name}.parquet")
    return str(folder)
