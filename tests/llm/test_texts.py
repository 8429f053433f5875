"""Formatting duplicates, encodings, look-alikes and sentences."""

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from quizlake.llm import canonical, lookalike, mojibake, sentences

CLEAN = [
    "¿A qué rumbo gobernará el patrón si avista «Ñandú» a 350º por la aleta? Según el capitán, más tarde…",
    "La capitanía dispone de un guardín; además, él avisó: «¡Ya!» — véase nota 3",
    "En «São Brandão», en «Føroy» y en «Île-aux-Âmes» hay ½ milla (Δ = 74º E).",
    "En «Ilha da Conceição» y «Älvö», «Château-Mer», «NAVEGAÇÃO», «Заря»: 1ª edición",
]


@pytest.mark.parametrize("text", CLEAN)
def test_proper_text_is_no_case(text):
    assert mojibake.restore(text) == (text, False)


FOREIGN = """Straße Straßen Fuß groß weiß Maße GROẞ œuvre cœur sœur bœuf Œdipe fœtus œsophage voilà là déjà perché già città qualità più così
    smörgåsbord Åland år blåbær Ærø øl Søren Gdańsk Łódź złoty śnieg Þór það Kraków coração São não ações àvila l'Hospitalet col·legi paral·lel
    Öl über Çelik ağaç İzmir ştiinţă český žluťoučký Dvořák Ljubljana č ÎLE Île-aux-Âmes château forêt naïve Noël""".split()


@pytest.mark.parametrize("word", FOREIGN)
def test_right_words_of_other_languages_stay(word):
    for text in (word, f"él dijo {word}", f"En «{word}», según él, más tarde", f"{word} y {word}: {word}."):
        assert mojibake.restore(text) == (text, False)


def test_any_number_of_layers():
    text = bad = "según el patrón, más allá"
    for _ in range(7):
        bad = bad.encode().decode("latin-1")
    assert mojibake.restore(bad) == (text, True)


@pytest.mark.parametrize("read_as", ["latin-1", "cp1252", "cp850", "cp437", "mac_roman"])
@pytest.mark.parametrize("text", CLEAN[:3])
def test_utf8_read_otherwise_is_restored(text, read_as):
    raw = text.encode()
    try:
        bad = raw.decode(read_as)
    except UnicodeDecodeError:
        bad = "".join(bytes([b]).decode(read_as) if read_as != "cp1252" or b not in (0x81, 0x8D, 0x8F, 0x90, 0x9D) else chr(b) for b in raw)
    assert mojibake.restore(bad) == (text, True)


@pytest.mark.parametrize("text", CLEAN[:2])
def test_two_layers(text):
    assert mojibake.restore(text.encode().decode("latin-1").encode().decode("latin-1")) == (text, True)


@pytest.mark.parametrize("read_as", ["mac_roman", "cp850"])
def test_one_byte_encodings_taken_for_each_other(read_as):
    text = "La embarcación «Selmar» gobernará a 350º según el patrón; después avistó una caña"
    assert mojibake.restore(text.encode("cp1252").decode(read_as)) == (text, True)


def test_part_of_a_text_and_what_is_lost():
    assert mojibake.restore("El patrón avistó una caÃ±a") == ("El patrón avistó una caña", True)
    assert mojibake.restore("seg�n") == ("seg�n", True)
    assert mojibake.restore("") == ("", False)


@settings(max_examples=150, deadline=None)
@given(st.text(alphabet="abcdeoñáéíóú ¿?.,«»", max_size=60))
def test_restoring_is_stable(text):
    once = mojibake.restore(text.encode().decode("latin-1"))[0]
    assert mojibake.restore(once)[0] == once


def test_suspect_never_hides_a_case(spark):
    texts = [t.encode().decode(e, "replace") for t in CLEAN[:2] for e in ("latin-1", "cp850", "cp437", "mac_roman")] + ["a�b", "plain", None, "más"]
    rows = spark.createDataFrame([(t,) for t in texts], "t string").select("t", mojibake.suspect(F.col("t")).alias("s")).collect()
    assert all(r["s"] or r["t"] is None or not mojibake.restore(r["t"])[1] for r in rows)


def test_suspect_passes_all_that_costs(spark):
    signs = {s for e in (*mojibake.READ_AS, *sum(mojibake.SWAPPED, ())) for s in mojibake._bytes_of(e)} | set("\xad\u0301\u0489\u200b\u20dd\u3000Ａａ１！")
    near = ["", *"aZnN1. (-\t\x1f\x7féÚñº¿»–…", "\xa0", "ａ", "Ａ", "１", "\u0301"]
    texts = [b + s + a for s in sorted(signs) for b in near for a in near]
    passed = spark.createDataFrame([(t,) for t in texts], "t string").where(mojibake.suspect(F.col("t"))).collect()
    assert {t for t in texts if mojibake.cost(t) > 0} <= {r["t"] for r in passed}


def test_ordinary_signs_in_odd_places_are_restored(spark):
    pairs = {"de travÚs": "de través", "un cap¡tulo": "un capítulo", "el patr—n": "el patrón", "un a–o": "un año", "tren Madrid–Vigo, norte–sur, Él—Ella": None, "más, según él: «¿Ñandú?» – 3.º": None}
    fields = spark.createDataFrame([(i, "a", t) for i, t in enumerate(pairs)], "num long, campo string, texto string")
    assert {r["texto"]: r["restaurado"] for r in mojibake.garbled(fields).collect()} == {k: v for k, v in pairs.items() if v}


def test_canonical_text(spark):
    rows = [("¡Hola, Mundo!", ["b x", "A"]), ("hola mun do", ["a.", "B-X"]), ("HOLA MUNDO", ["A", "bx", ""]), (None, None), ("", []), ("ΣΑΣ", []), ("σας", [])]
    t = [r[0] for r in spark.createDataFrame(rows, "e string, o array<string>").select(canonical.canonical([F.col("e")], F.col("o"))).collect()]
    assert t[0] == t[1] != t[2] and t[3] == t[4] and t[5] == t[6]


def test_copies_and_collisions(spark):
    keys = canonical.keyed(spark.createDataFrame([(i, "x" if i % 3 else f"y{i % 2}") for i in range(30)], "id long, t string"), "id", F.col("t"))
    assert sorted((r["primero"], r["copias"]) for r in canonical.groups(keys).collect()) == [(0, 5), (1, 20), (3, 5)]
    assert {(r["id"], r["primero"]) for r in canonical.members(keys).collect()} == {(i, 1 if i % 3 else 0 if i % 2 == 0 else 3) for i in range(30)}
    assert canonical.collisions(keys).count() == 0


def test_lookalike_classes_are_transitive():
    of = {m: i for i, g in enumerate(lookalike.classes(True)) for m in g}
    assert of["ａ"] == of["a"] == of["а"] == of["α"] and of["é"] == of["é"] and of["​"] == of[""] and of["　"] == of[" "]
    assert len({of[x] for x in "abcdefg"}) == 7


def test_lookalike_rewriting():
    counts = {"a": 9, "o": 9, "e": 9, " ": 50}
    one, two = (lookalike.automaton(lookalike.rewriting(counts, m)) for m in (False, True))
    fix = lambda t: lookalike.rewrite(t, one, two)
    assert fix("ｖｅｌａ　más​ lejos") == "vela más lejos"
    assert fix("vеlа «Заря» Δ = 3") == "vela «Заря» Δ = 3"
    assert fix("") == "" and fix("ñ") == "ñ" and fix("ñ") == "ñ" and fix("́") == "́"


def test_lookalike_kinds(spark):
    table = [("ｖela", ["ancho"]), ("á", ["combinado"]), ("a\u2060b", ["invisible"]), ("a\xa0b", ["espacio"]), ("vеla", ["mezcla"]), ("1º ½ … “x” «Заря» Δ\t\n", []), ("", [])]
    table[1] = ("a\u0301", ["combinado"])
    assert [lookalike.kinds(t) for t, _ in table] == [w for _, w in table]
    got = spark.createDataFrame([(t,) for t, _ in table] + [(None,)], "t string").select(lookalike.suspect(F.col("t"))).collect()
    assert all(g[0] for g, (_, w) in zip(got, table) if w) and not got[-1][0] and not got[-2][0]


def test_rows_come_from_the_rewriting(spark):
    texts = ["￠ y ￡", "👩\u200d🚀 sale", "q\u0301", "más\u200b", "vеla", "wжw", "Заря", "más", "⚠\ufe0f", "｟x｠", None, ""]
    got = {r["texto"]: (r["forma"], r["restantes"]) for r in lookalike.consistent(spark.createDataFrame([(i, "a", t) for i, t in enumerate(texts)], "num long, campo string, texto string")).collect()}
    assert got == {"￠ y ￡": ("¢ y £", []), "👩\u200d🚀 sale": ("👩\u200d🚀 sale", ["invisible"]), "q\u0301": ("q\u0301", ["combinado"]), "más\u200b": ("más", []), "vеla": ("vela", []), "wжw": ("wжw", ["mezcla"]), "⚠\ufe0f": ("⚠\ufe0f", ["combinado"]), "｟x｠": ("⦅x⦆", [])}


def test_whole_classes_are_rewritten_to_plain_members(spark):
    fields = spark.createDataFrame([(1, "a", "\xa0" * 50 + "uno dos"), (2, "a", "a b")], "num long, campo string, texto string")
    got = {r["num"]: r["forma"] for r in lookalike.consistent(fields).collect()}
    assert got == {1: " " * 50 + "uno dos"}


def test_representatives_follow_the_corpus(spark):
    fields = spark.createDataFrame([(1, "enunciado", "vela")] + [(i, "enunciado", "велa") for i in range(2, 9)], "num long, campo string, texto string")
    counts = lookalike.frequencies(fields)
    assert counts["е"] == 7 and counts["e"] == 1
    assert lookalike.rewriting(counts, True)["e"] == "е"


SENTENCES = [
    ["El Sr. Pérez, D. Juan y J. M. Díaz llegaron a las 6.30 h.", "Midió 13,5 m (aprox. 40.1 pies) en el art. 4, p. ej. con prisa.", "¿Seguro?", "¡Sí!"],
    ["«¡Arriar! ¡Ya!», gritó el patrón, pero nadie oyó.", "El cuaderno dice: “Fondear. Esperar.” y nada más.", "Fin."],
    ["Dudó un momento… y siguió.", "Se ve un cabo…", "La carta es vieja.", "—¿Y la boya? —preguntó el timonel."],
    ["The U.S. chart uses feet vs. metres, etc.", "Dr. Smith left at 6.30 a.m. with Capt. Jones.", "No. 8 buoy is missing.", "No.", "\"Drop it! Now!\" shouted the skipper.", "She asked: \"Is it lit?\"", "Yes."],
    ["Man braucht Westen usw.", "Am 9. Juni lag die Tonne Nr. 3 vor Kiel, d. h. im Hafen, z. B. nachts.", "„Leinen los!“, rief er."],
    ["Ο κ. Μαρέλης μέτρησε 4 κόμβους.", "Κρατάει η άγκυρα;", "Τι νύχτα!"],
    ["डॉ. सागर ने हवा नापी।", "कितनी डरावनी रात थी!"],
    ["La cía. Pol de los EE. UU. fabricó el archivo v3.43 núm. 34.", "Quedó en 15º 44,9' E.", "Vale 🙂", ],
]


@pytest.mark.parametrize("parts", SENTENCES)
@pytest.mark.parametrize("gap", [" ", "\n", "  "])
def test_sentences_in_a_paragraph(spark, parts, gap):
    text = gap.join(parts)
    got = sentences.sentences(spark.createDataFrame([(1, text)], "doc_id long, text string")).orderBy("start_char").collect()
    assert [r["oracion"] for r in got] == parts
    assert all(text[r["start_char"] : r["end_char"]] == r["oracion"] for r in got)


def test_sentences_of_other_scripts_and_layouts(spark):
    table = [
        ("海は静か。「見えません。」と答えた。船が出た！", ["海は静か。", "「見えません。」と答えた。", "船が出た！"]),
        ("“我看不见。”他说。等到……再过。锚好吗？", ["“我看不见。”他说。", "等到……再过。", "锚好吗？"]),
        ("น้ำลึก9.9เมตร ลมแรง\nคลื่นสูง", ["น้ำลึก9.9เมตร", "ลมแรง", "คลื่นสูง"]),
        ("Tema 1. Balizas\n\nUna. Dos.\n\n- uno: p. ej. x. y;\n* dos\n1) tres.\n\nvale, voy jajaja... 👍🏽", ["Tema 1. Balizas", "Una.", "Dos.", "- uno: p. ej. x. y;", "* dos", "1) tres.", "vale, voy jajaja... 👍🏽"]),
        ("", []), (None, []), (" \n\t ", []), ("👍🏽 a. B", ["👍🏽 a.", "B"]), ("x", ["x"]),
    ]
    docs = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(table)], "doc_id long, text string")
    rows = sentences.sentences(docs).orderBy("doc_id", "start_char").collect()
    assert [[r["oracion"] for r in rows if r["doc_id"] == i] for i in range(len(table))] == [w for _, w in table]


@pytest.mark.parametrize("words", [3, 60, 2000])
def test_quotations_of_any_length_cut_alike(spark, words):
    inside = " ".join(["una voz"] * words)
    texts = [f'Dijo: "{inside}." luego siguió.', f'Dijo: "{inside}." ahora vale. Fin.', f'"{inside.upper()}." VALE AHORA. FIN.']
    rows = sentences.sentences(spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")).groupBy("doc_id").count().collect()
    assert {r["doc_id"]: r["count"] for r in rows} == {0: 1, 1: 3, 2: 2}


def test_sentence_places_in_a_very_long_text(spark):
    text = "🙂 Una frase corta. " * 20_000
    rows = sentences.sentences(spark.createDataFrame([(1, text)], "doc_id long, text string"))
    assert rows.count() == 20_001 - 1 or rows.count() == 20_001
    last = rows.orderBy(F.desc("start_char")).first()
    assert text[last["start_char"] : last["end_char"]] == last["oracion"]
