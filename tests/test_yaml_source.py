"""The YAML data source on files written here."""

import pytest
from pyspark.sql import functions as F

yaml = pytest.importorskip("yaml")

from quizlake.operators import audit  # noqa: E402
from quizlake.sources import yaml_bank  # noqa: E402

GOOD = {"exam_info": {"title": "T", "community": "Murcia", "year": 2021, "call": "abril", "expected_questions": 2}, "categories": {1: {"name": "Uno", "questions": [{"id": 7, "question": "¿q?", "options": {"a": "x", "b": "y"}, "correct_answer": "ANULADA"}, {"question": "sin id", "options": {"a": "x"}}]}, 2: {"questions": []}}}
PLAIN = {"metadata": {"exam_type": "per"}, "preguntas": [{"id": "p1", "enunciado": "e", "opciones": {}, "respuesta_correcta": "a", "metadata": {"title": "T", "subtitle": "S", "total_questions": 45, "community": "C", "year": 2020, "call": "x", "test_code": "01", "categoria": "3"}}]}


@pytest.fixture
def folder(tmp_path):
    def put(path, content):
        p = tmp_path / path
        p.parent.mkdir(parents=True, exist_ok=True)
        p.write_text(content if isinstance(content, str) else yaml.safe_dump(content, allow_unicode=True), encoding="utf-8")

    put("a/good.yaml", GOOD)
    put("a/b/plain.yaml", PLAIN)
    put("a/broken.yaml", "categories: [")
    put("a/other.yaml", {"x": 1})
    put("a/list.yaml", {"categories": []})
    put("a/faulty.yaml", {"categories": {1: {"name": "n", "questions": [{"id": 1, "question": "ok", "options": {}}, {"id": "abc", "question": "bad id"}]}}})
    put("a/My_BACKUP.yaml", GOOD)
    put("a/bk_x.yaml", GOOD)
    put("a/x.bak.yaml", GOOD)
    put("a/skip.yml", GOOD)
    return str(tmp_path)


def test_rows(spark, folder):
    yaml_bank.register(spark)
    rows = spark.read.format("exam_yaml").load(folder).orderBy("archivo", "ordinal").collect()
    assert [r["id"] for r in rows] == ["p1", "7", "good_1_1"]
    q = rows[1]
    assert (q["respuesta_correcta"], q["community"], q["anio"], q["test_code"], q["total_questions"], q["categoria"], q["numero_pregunta"]) == ("ANULADA", "Murcia", 2021, "Test01", 45, "1", 7)
    assert rows[2]["respuesta_correcta"] == "a" and rows[2]["numero_pregunta"] == 0
    assert rows[0]["comunidad_autonoma"] is None and rows[0]["categoria"] == "3"


def test_errors_and_fallback(spark, folder, tmp_path):
    yaml_bank.register(spark)
    got = {r["archivo"].rpartition("/")[2]: (r["filas"], r["error"] is None) for r in spark.read.format("exam_yaml").option("errors", "true").load(folder).collect()}
    assert got == {"good.yaml": (2, True), "plain.yaml": (1, True), "broken.yaml": (0, False), "other.yaml": (0, False), "list.yaml": (0, True), "faulty.yaml": (0, False)}
    assert spark.read.format("exam_yaml").load(folder + "/none").count() == 0
    assert spark.read.format("exam_yaml").option("fallback", folder + "/a").load(folder + "/none").count() == 2


def test_audit_of_files(spark, folder):
    questions, audited = audit.files(spark, folder, {1: 2, 3: 1})
    got = {r["exam_identifier"].rpartition("/")[2]: (r["estado"], r["esperadas"], r["preguntas"], r["distribucion_ok"], r["error"] is None) for r in audited.collect()}
    assert got["good.yaml"] == ("ok", 2, 2, False, True) and got["plain.yaml"] == ("ok", 45, 1, False, True)
    assert all(got[f][0] == "error" and got[f][2] == 0 for f in ("broken.yaml", "other.yaml", "list.yaml", "faulty.yaml")) and not got["broken.yaml"][4] and got["list.yaml"][4]
    assert audit.gate(audited).first()["errores"] == 4 and questions.count() == 3


def test_store_prunes_partitions(spark, folder, tmp_path):
    yaml_bank.store(spark, folder, str(tmp_path / "bank"))
    kept = spark.read.parquet(str(tmp_path / "bank")).where(F.col("community") == "Murcia")
    assert kept.count() == 2 and "PartitionFilters: [isnotnull(community" in kept._jdf.queryExecution().toString()
