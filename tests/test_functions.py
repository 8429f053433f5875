"""Truth tables of the scalar expressions, and solvers against brute force."""

from itertools import permutations

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from quizlake.functions import answers as A
from quizlake.functions import numbers as N
from quizlake.functions import text
from quizlake.functions.matching import DisjointSets, Flow, assignment
from quizlake.functions.version import UNKNOWN, project_version


def values(spark, rows, schema, *columns):
    return [tuple(r) for r in spark.createDataFrame(rows, schema).select(*columns).collect()]


def test_right_answers(spark):
    table = [("A", "a", True), (None, "a", False), ("", "anulada", False), (" ", "anulada", False), ("b", "a,b", True), ("B", "a, B", True), ("z", "ANULADA", True), ("c", "a,b", False), ("a ", "a", False), ("a", " a", False), ("a", None, False)]
    got = values(spark, [(a, k) for a, k, _ in table], "a string, k string", A.right(F.col("a"), F.col("k")))
    assert [g[0] for g in got] == [w for _, _, w in table]


def test_accepted_letters(spark):
    table = [("A, B, C", ["a", "b", "c"]), ("anulada", ["a", "b", "c", "d"]), ("D", ["d"]), (None, [])]
    assert [g[0] for g in values(spark, [(k,) for k, _ in table], "k string", A.accepted(F.col("k")))] == [w for _, w in table]


def test_option_texts(spark):
    rows = [({"a": "x", "b": "y"}, "a"), ({"a": "x"}, "A"), (None, "a")]
    assert values(spark, rows, "o map<string,string>, l string", A.option_text(F.col("o"), F.col("l"))) == [("x",), (A.NO_TEXT,), (A.NO_TEXT,)]


def test_white_space_is_unicode(spark):
    rows = [("  a \n b \x1f",), (None,), ("　",)]
    assert values(spark, rows, "t string", text.collapsed(F.col("t")), text.blank(F.col("t"))) == [("a b", False), (None, True), ("", True)]


def test_content_hash_ignores_letters_order_and_spaces(spark):
    rows = [("q  x", {"a": "1", "b": "2"}), (" q x", {"b": "1", "d": " 2"}), ("Q x", {"a": "1", "b": "2"}), ("q x", {"a": "1", "b": "1"}), (None, None)]
    h = [g[0] for g in values(spark, rows, "e string, o map<string,string>", text.content_hash(F.col("e"), F.col("o")))]
    assert h[0] == h[1] and len(set(h)) == 4


def test_exam_keys(spark):
    rows = [("andalucía_2020_junio_test01",), ("a_x_b_c",), ("a_b",), (None,), ("castilla la mancha_2020_j_1",)]
    got = [g[0] for g in values(spark, rows, "k string", text.parsed_key(F.col("k")))]
    assert [g["estado"] for g in got] == ["ok", "anio", "formato", "formato", "ok"]
    assert got[0]["community"] == "Andalucía" and got[4]["community"] == "Castilla la mancha"


def test_percent_rounds_half_to_even(spark):
    rows = [(k, n) for n in range(0, 101) for k in range(n + 1)]
    got = values(spark, rows, "k long, n long", N.percent(F.col("k"), F.col("n")))
    assert [g[0] for g in got] == [round(k / n * 100, 2) if n else 0.0 for k, n in rows]


def test_times(spark):
    got = values(spark, [(5,), (65,), (6000,), (None,)], "s long", N.minutes_seconds(F.col("s")))
    assert got == [("00:05",), ("01:05",), ("100:00",), (None,)]


@settings(max_examples=60, deadline=None)
@given(st.integers(1, 5).flatmap(lambda n: st.integers(n, 6).flatmap(lambda m: st.lists(st.lists(st.integers(-9, 9), min_size=m, max_size=m), min_size=n, max_size=n))))
def test_assignment_is_cheapest(cost):
    got = assignment(cost)
    assert len(set(got)) == len(got)
    best = min(sum(cost[i][j] for i, j in enumerate(p)) for p in permutations(range(len(cost[0])), len(cost)))
    assert sum(cost[i][j] for i, j in enumerate(got)) == best


def test_flow_and_sets():
    f = Flow(4)
    a, b, _, _ = f.edge(0, 1, 3), f.edge(0, 2, 2), f.edge(1, 3, 2), f.edge(2, 3, 9)
    assert f.run(0, 3) == 4 and (f.used(a), f.used(b)) == (2, 2)
    s = DisjointSets()
    for x, y in (("b", "a"), ("c", "d"), ("d", "b")):
        s.join(x, y)
    assert s.classes() == {"a": ["a", "b", "c", "d"]}


def test_version(tmp_path):
    good = tmp_path / "p.toml"
    good.write_text('[project]\nversion = "1.2"\n')
    assert project_version(str(good)) == "1.2"
    assert project_version(str(tmp_path / "none.toml")) == UNKNOWN


@pytest.mark.parametrize("kind", ["exam", "simulacro"])
def test_exam_ids(spark, kind):
    from quizlake.operators.sample import new_exam_id

    got = spark.range(20).select(new_exam_id(kind).alias("a"), new_exam_id(kind, F.col("id")).alias("b")).collect()
    assert len({r["a"] for r in got}) == 20 and all(r["b"].startswith(kind + "_") and len(r["b"]) == len(kind) + 9 for r in got)


def test_names_and_hours(spark):
    got = values(spark, [("test_uno",), ("x",), (None,)], "c string", text.display_name(F.col("c"), {"x": "Equis"}), N.hours(F.lit(7200)))
    assert got == [("Test uno", "2.0 horas"), ("Equis", "2.0 horas"), (None, "2.0 horas")]
