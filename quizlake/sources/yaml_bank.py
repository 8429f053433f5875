"""Exam files in YAML as a Spark data source: ``spark.read.format("exam_yaml").load(folder)``.

Files are found below a folder, one partition each, without those that are backups by their names. Two dialects are read:
categories of questions under a header (``exam_info``, ``categories``), and plain lists (``metadata``, ``preguntas``). A file
that is broken, of another form, or with one faulty record gives no rows; with ``option("errors", "true")`` the reader gives
one row per file instead: its path, number of rows, the number of questions its header expects (null if it names none) and
what was wrong.
"""

from __future__ import annotations

import os
from collections.abc import Iterator
from pathlib import Path

from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from quizlake.session import ready

SCHEMA = (
    "id string, enunciado string, opciones map<string,string>, respuesta_correcta string, title string, subtitle string, "
    "total_questions int, community string, anio int, convocatoria string, test_code string, comunidad_autonoma string, "
    "categoria string, categoria_nombre string, numero_pregunta int, archivo string, ordinal int"
)
ERRORS = "archivo string, filas int, esperadas int, error string"
# What a header lacks is taken to be.
DEFAULTS = {"title": "EXAMEN DE PATRÓN DE EMBARCACIONES DE RECREO", "subtitle": "Código de Test", "total_questions": 45, "community": "Madrid", "year": 2025, "call": "Ordinaria", "test_code": "Test01"}
BACKUP = ("backup", "bk_", ".bak")


def exam_files(folder: str, recursive: bool = True) -> list[str]:
    """Paths of the exam files in order; names that look like backups, in any case, are left out."""
    found = Path(folder).rglob("*.yaml") if recursive else Path(folder).glob("*.yaml")
    return sorted(str(p) for p in found if p.is_file() and not any(b in p.name.lower() for b in BACKUP))


def _text(value: object, field: str) -> str:
    if not isinstance(value, str):
        raise ValueError(f"{field} is no text")
    return value


def _number(value: object, field: str) -> int:
    if isinstance(value, bool) or not isinstance(value, (int, str)):
        raise ValueError(f"{field} is no whole number")
    return int(value)


def _options(value: object) -> dict[str, str]:
    if not isinstance(value, dict):
        raise ValueError("options are no mapping")
    return {_text(k, "option letter"): _text(v, "option") for k, v in value.items()}


def rows_of(content: object, path: str) -> list[tuple]:
    """The rows of a parsed file; ValueError if it is of another form or any record is faulty."""
    stem, out = Path(path).stem, []
    if isinstance(content, dict) and "categories" in content:
        given = content.get("exam_info") or {}
        head = {k: given.get(k, v) for k, v in DEFAULTS.items()}
        title, subtitle, community, call, code = (_text(head[k], k) for k in ("title", "subtitle", "community", "call", "test_code"))
        total, year = _number(head["total_questions"], "total_questions"), _number(head["year"], "year")
        groups = content["categories"]
        if not isinstance(groups, dict):
            return []
        for category, group in groups.items():
            name = _text(group.get("name", f"Categoría {category}"), "name")
            for q in group.get("questions") or []:
                ident = str(q.get("id", f"{stem}_{category}_{len(out)}"))
                number = _number(q.get("id", 0), "id")
                out.append((ident, _text(q.get("question", ""), "question"), _options(q.get("options") or {}), _text(q.get("correct_answer", "a"), "correct_answer"), title, subtitle, total, community, year, call, code, community, str(category), name, number, path, len(out)))
    elif isinstance(content, dict) and "metadata" in content and "preguntas" in content:
        for q in content["preguntas"]:
            m = q["metadata"]
            opt = lambda k, kind=_text: None if m.get(k) is None else kind(m[k], k)  # noqa: B023, E731
            out.append((_text(q["id"], "id"), _text(q["enunciado"], "enunciado"), _options(q["opciones"]), _text(q["respuesta_correcta"], "respuesta_correcta"), *(_text(m[k], k) for k in ("title", "subtitle")), _number(m["total_questions"], "total_questions"), _text(m["community"], "community"), _number(m["year"], "year"), _text(m["call"], "call"), _text(m["test_code"], "test_code"), opt("comunidad_autonoma"), opt("categoria"), opt("categoria_nombre"), opt("numero_pregunta", _number), path, len(out)))
    else:
        raise ValueError("neither dialect")
    return out


def expected(content: object) -> int | None:
    """The number of questions that a parsed file's header expects; None if it says nothing of the kind."""
    head = content.get("exam_info") if isinstance(content, dict) else None
    number = head.get("expected_questions") if isinstance(head, dict) else None
    return number if isinstance(number, int) and not isinstance(number, bool) else None


def read_file(path: str) -> tuple[list[tuple], int | None, str | None]:
    """(rows, expected number of rows, what was wrong); all rows of a file or none."""
    try:
        import yaml
    except ImportError as e:
        raise RuntimeError("reading exam files needs PyYAML") from e
    wanted = None
    try:
        with open(path, encoding="utf-8") as f:
            content = yaml.safe_load(f)
        wanted = expected(content)
        return rows_of(content, path), wanted, None
    except (OSError, UnicodeDecodeError, yaml.YAMLError, ValueError, KeyError, TypeError, AttributeError) as e:
        return [], wanted, f"{type(e).__name__}: {e}"[:500]


class _File(InputPartition):
    def __init__(self, path: str):
        super().__init__(path)
        self.path = path


class _Reader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        self.folder, self.errors = options["path"], options.get("errors", "false").lower() == "true"
        self.fallback = options.get("fallback")

    def partitions(self) -> list[InputPartition]:
        if os.path.isdir(self.folder):
            paths = exam_files(self.folder)
        else:  # without the folder, the files directly in another one
            paths = exam_files(self.fallback, recursive=False) if self.fallback and os.path.isdir(self.fallback) else []
        return [_File(p) for p in paths] or [_File("")]

    def read(self, partition: _File) -> Iterator[tuple]:
        if not partition.path:
            return
        rows, wanted, wrong = read_file(partition.path)
        if self.errors:
            yield (partition.path, len(rows), wanted, wrong)
        else:
            yield from rows


class ExamYaml(DataSource):
    @classmethod
    def name(cls) -> str:
        return "exam_yaml"

    def schema(self) -> str:
        return ERRORS if self.options.get("errors", "false").lower() == "true" else SCHEMA

    def reader(self, schema) -> DataSourceReader:  # noqa: ANN001
        return _Reader(dict(self.options))


def register(spark: SparkSession) -> None:
    ready(spark)
    spark.dataSource.register(ExamYaml)


def store(spark: SparkSession, folder: str, target: str) -> None:
    """Load all exam files once and keep them as Parquet, in folders by community and year that later filters can skip."""
    register(spark)
    spark.read.format("exam_yaml").load(folder).write.partitionBy("community", "anio").mode("overwrite").parquet(target)
